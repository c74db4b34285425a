"""Data sets, features, models and metrics for predicting recurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.plans.lineage import cut


def supervised(labels: DataFrame, texts: DataFrame | None = None, run: str = "run_time", key: str = "incident_id", cutoff: str | None = None) -> DataFrame:
    """The rows of the latest label run, with texts joined by key and split_name by cutoff where given."""
    latest = labels.agg(F.max(run).alias("_latest"))
    rows = labels.crossJoin(F.broadcast(latest)).where(F.col(run) == F.col("_latest")).drop("_latest")
    if texts is not None:
        rows = rows.join(texts, key, "left")
    return rows if cutoff is None else rows.withColumn("split_name", F.when(F.col("ts") >= F.lit(cutoff).cast("timestamp"), "test").otherwise("train"))


def impute(rows: DataFrame, numeric: list[str], categorical: list[str], fit: DataFrame | None = None) -> DataFrame:
    """`rows` with nulls filled by the exact median or the most frequent value (ties: the least) of `fit` or of themselves."""
    source = fit if fit is not None else rows
    medians = source.agg(*[F.median(c).alias(c) for c in numeric]).first() if numeric else {}
    fills = {c: medians[c] for c in numeric if medians[c] is not None}
    for c in categorical:
        best = source.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).first()
        if best:
            fills[c] = best[c]
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def balance(rows: DataFrame, label: str) -> DataFrame:
    """`rows` with weight: n / (classes * n of the row's class)."""
    per = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = per.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    weights = per.crossJoin(F.broadcast(total)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return rows.join(F.broadcast(weights), label)


def pipeline(numeric: list[str], categorical: list[str], classifier: str = "logistic", label: str = "label", text: str | None = None, seed: int = 42):
    """An ML pipeline: one-hot categories (unknown ones all zero), scaled numbers, optional word TF-IDF, and a weighted classifier.

    classifier is logistic, forest, svm or boosted. All steps are fitted on what the pipeline is fitted on, so on training rows alone.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as C
    from pyspark.ml import feature as X

    stages, inputs = [], []
    if categorical:
        indexed, hot = [f"{c}_i" for c in categorical], [f"{c}_h" for c in categorical]
        stages += [X.StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"), X.OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True)]
        inputs += hot
    if numeric:
        stages += [X.VectorAssembler(inputCols=numeric, outputCol="_numbers", handleInvalid="keep"), X.StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=False)]
        inputs.append("_scaled")
    if text:
        stages += [X.RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"), X.HashingTF(inputCol="_words", outputCol="_counts", numFeatures=1 << 15), X.IDF(inputCol="_counts", outputCol="_idf")]
        inputs.append("_idf")
    stages.append(X.VectorAssembler(inputCols=inputs, outputCol="features"))
    common = {"featuresCol": "features", "labelCol": label, "weightCol": "weight"}
    stages.append({
        "logistic": lambda: C.LogisticRegression(maxIter=50, **common),
        "forest": lambda: C.RandomForestClassifier(numTrees=50, seed=seed, **common),
        "svm": lambda: C.LinearSVC(maxIter=50, **common),
        "boosted": lambda: C.GBTClassifier(maxIter=20, seed=seed, **common),
    }[classifier]())
    return Pipeline(stages=stages)


def scored(predictions: DataFrame) -> DataFrame:
    """`predictions` with score: the probability of class 1, or the logistic of the raw decision where there is none."""
    from pyspark.ml.functions import vector_to_array

    if "probability" in predictions.columns:
        return predictions.withColumn("score", vector_to_array("probability")[1])
    return predictions.withColumn("score", sigmoid(vector_to_array("rawPrediction")[1]))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def stratified(rows: DataFrame, label: str, shares: dict[str, float], key: str, seed: int = 42) -> DataFrame:
    """`rows` with split_name: each class dealt to the splits by shares, in a seeded order of keys. The last split takes the rest."""
    w = W.partitionBy(label)
    place = (F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), key), key)) - 0.5) / F.count("*").over(w)
    rows = rows.withColumn("_p", place)
    names, upto, out = list(shares), 0.0, None
    for name in names[:-1]:
        upto += shares[name]
        out = F.when(F.col("_p") < upto, name) if out is None else out.when(F.col("_p") < upto, name)
    return rows.withColumn("split_name", out.otherwise(names[-1]) if out is not None else F.lit(names[0])).drop("_p")


def folds(rows: DataFrame, label: str, k: int, key: str, seed: int = 42) -> DataFrame:
    """`rows` with fold from 0 to k - 1, even within each class.

    A class is dealt in the order of seeded hashes. Places are counted within ranges of hashes, so no task sorts a whole class.
    """
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_range", F.shiftright("_h", 54))
    sizes = rows.groupBy(F.col(label).alias("_label"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_label").orderBy("_r").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_label", "_r", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy(label, "_range").orderBy("_h", key))
    dealt = rows.withColumn("_place", place).join(F.broadcast(starts), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_r")))
    return dealt.withColumn("fold", ((F.col("_start") + F.col("_place") - 1) % k).cast("int")).drop("_h", "_range", "_label", "_r", "_start", "_place")


def cross_predict(rows: DataFrame, k: int, build, label: str = "label", key: str = "id") -> DataFrame:
    """`rows` with prediction and score of the model that was fitted without the row's fold.

    The dealt rows are kept once, since each fit reads them several times; so give no more columns than the model needs.
    """
    dealt, out = cut(folds(rows, label, k, key)), None
    for i in range(k):
        model = build().fit(balance(dealt.where(F.col("fold") != i), label))
        part = scored(model.transform(dealt.where(F.col("fold") == i).withColumn("weight", F.lit(1.0)))).select(key, label, "fold", "prediction", "score")
        out = part if out is None else out.union(part)
    return out


def curve(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, tp, fp, precision, recall, fpr), one row for each distinct score, from high to low.

    Rows are counted by score first, so the running sums pass over distinct scores.
    """
    per = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    total = per.agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    run = W.orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    c = per.withColumn("tp", F.sum("p").over(run)).withColumn("fp", F.sum(F.col("n") - F.col("p")).over(run)).crossJoin(F.broadcast(total))
    return c.select(F.col(score).alias("score"), "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "_p").alias("recall"), F.try_divide("fp", F.col("_n") - F.col("_p")).alias("fpr"))


def areas(c: DataFrame) -> DataFrame:
    """Average precision (sum of recall steps times precision) and the area under the ROC curve (trapezoids), in one row."""
    w = W.orderBy(F.desc("score"))
    before = lambda x: F.coalesce(F.lag(x).over(w), F.lit(0.0))
    rows = c.select(((F.col("recall") - before("recall")) * F.col("precision")).alias("a"), ((F.col("fpr") - before("fpr")) * (F.col("recall") + before("recall")) / 2).alias("r"))
    return rows.agg(F.sum("a").alias("average_precision"), F.sum("r").alias("roc_auc"))


def choose_threshold(c: DataFrame, how: str = "f1", least: float = 0.0) -> DataFrame:
    """The row of the curve of the greatest F1, of the greatest recall at a precision of `least` or more ("recall"), or of the greatest
    precision at such a recall ("precision"); where none is left, that of the greatest F1."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-12)
    rows = c.withColumn("f1", f1)
    good = F.lit(True) if how == "f1" else (F.col("precision") >= least) if how == "recall" else (F.col("recall") >= least)
    value = F.col("f1") if how == "f1" else F.col(how)
    best = rows.agg(F.max_by(F.struct(*rows.columns), F.struct(good.cast("int"), F.when(good, value).otherwise(F.col("f1")), F.col("score"))).alias("b"))
    return best.select("b.*")


def confusion(rows: DataFrame, predicted: Column, label: str = "label", keys: list[str] | None = None, null_on_zero: bool = False) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 within `keys`; an empty denominator gives 0, or null."""
    y, p = F.col(label) == 1, predicted
    n = rows.groupBy(*(keys or [])).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.try_divide(a, b) if null_on_zero else F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def threshold_sweep(rows: DataFrame, thresholds: list[float], label: str = "label", score: str = "sim", missing: float | None = None) -> DataFrame:
    """Confusion and rates for each threshold, score >= threshold being positive. Rows without a score go, or count as `missing`."""
    rows = rows.where(F.col(score).isNotNull()) if missing is None else rows.withColumn(score, F.coalesce(F.col(score), F.lit(missing)))
    each = rows.select(label, score, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return confusion(each, F.col(score) >= F.col("threshold"), label, ["threshold"], null_on_zero=True)


def top_k_features(ranks: DataFrame, key: str = "id", k: int = 5) -> DataFrame:
    """(key, sim_1 .. sim_k, mean_sim, std_sim, gap12) from (key, topk_rank, cosine_sim); the deviation is that of a sample."""
    kept = ranks.where(F.col("topk_rank") <= k)
    each = [F.max(F.when(F.col("topk_rank") == i, F.col("cosine_sim"))).alias(f"sim_{i}") for i in range(1, k + 1)]
    wide = kept.groupBy(key).agg(*each, F.avg("cosine_sim").alias("mean_sim"), F.stddev("cosine_sim").alias("std_sim"))
    return wide.withColumn("gap12", F.col("sim_1") - F.col("sim_2"))


def with_history(rows: DataFrame, facts: DataFrame, levels: list[list[str]], values: list[str], prefer: tuple[str, str] = ("tgl_submit", "event_time"), longest: int = 3650) -> DataFrame:
    """`rows` with history `values` by the first level of keys that has any, and gap_days since the last fact of that level's finest key.

    Times are the first of `prefer` that is known. gap_days lies between 0 and `longest`, 0 where there is no earlier time.
    """
    from reprise.operators.relational import with_fallback

    time = F.coalesce(*[F.col(c) for c in prefer if c in facts.columns])
    keys = levels[-1]
    last = facts.groupBy(*keys).agg(F.max(time).alias("last_time"))
    out = with_fallback(rows, facts, levels, values).join(last, keys, "left")
    own = F.coalesce(*[F.col(c) for c in prefer if c in rows.columns])
    return out.withColumn("gap_days", F.coalesce(F.least(F.lit(longest), F.greatest(F.lit(0), F.datediff(own, "last_time"))), F.lit(0)))
