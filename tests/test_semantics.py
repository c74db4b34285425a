"""Small fixtures with known values for the semantics that are easy to get wrong."""

import datetime as dt
import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from reprise.functions import rules, text
from reprise.operators import density, evaluation, labeling, learning, quality, similarity, temporal, vectors
from reprise.plans.components import connected_components
from reprise.sources import files, tables


@pytest.fixture(scope="module")
def sequence(spark):
    d = lambda day, hour, month=1: dt.datetime(2024, month, day, hour)
    rows = [("A", 1, d(1, 9)), ("A", 2, d(8, 9)), ("A", 3, d(16, 9)), ("A", 4, d(16, 10)), ("A", 5, d(1, 9, 3)), ("B", 6, d(1, 9)), ("B", 7, d(9, 9)), ("C", 8, d(1, 9)), ("C", 9, d(10, 9))]
    rows += [("D", 10, d(1, 9)), ("D", 11, d(8, 9)), ("D", 12, d(15, 9)), ("E", 13, d(1, 1)), ("E", 14, d(8, 23)), ("N", 15, None)]
    return spark.createDataFrame(rows, "cluster_id string, incident_id long, ts timestamp")


def test_sessions(spark, sequence):
    got = {r["incident_id"]: (r["gap_days"], r["temporal_cluster_no"]) for r in temporal.sessionize(sequence, [7], "all").collect()}
    assert [got[i] for i in range(1, 6)] == [(None, 1), (7, 1), (8, 2), (0, 2), (45, 3)]
    assert got[14] == (7, 1) and 15 not in got
    exact = {r["incident_id"]: r["episode_no"] for r in temporal.sessionize_timestamps(sequence, 7).collect()}
    assert exact[14] == 2 and exact[15] == 1
    for rule, want in (("span_days_strict", (3, 2, 1, 6, 2.0)), ("span_days_gt", (4, 3, 1, 8, 2.0)), ("all", (5, 3, 2, 9, 1.8))):
        s = temporal.window_summary(temporal.sessionize(sequence, [7], rule), [7]).first()
        assert (s["n_clusters_eligible"], s["n_clusters_split"], s["n_clusters_stable"], s["total_episodes"], s["avg_episode"]) == want
    empty = temporal.window_summary(temporal.sessionize(sequence.limit(0), [7]), [7]).first()
    assert empty["n_clusters_eligible"] == 0 and empty["median_episode"] == 0


def test_streamed_episodes_equal_batch_episodes(spark, sequence):
    from reprise.streaming.episodes import stream_episodes

    batch = temporal.sessionize(sequence, [7], "all").groupBy("cluster_id", "temporal_cluster_no").count()
    assert stream_episodes(sequence.where("ts IS NOT NULL"), 7).count() == batch.count()


def test_labels(spark, sequence):
    s = temporal.sessionize(sequence.where("cluster_id = 'A'"), [7])
    got = {r["incident_id"]: r["label_berulang"] for r in labeling.label_recurrence(s, 3, 2, 2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0}
    assert labeling.label_recurrent_clusters(s, 1, 2).agg(F.sum("label_berulang")).first()[0] == 5
    assert labeling.label_recurrent_clusters(s, 2, 2).agg(F.sum("label_berulang")).first()[0] == 0


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


def test_normalisation(spark):
    raw = "Mohon bantuan, WP lapor PPh21 ke KPP Pratama <NPWP> hubungi a@b.com"
    norm = _one(spark, raw, text.normalize)
    assert norm == "mohon bantuan wajib_pajak lapor pajak_penghasilan 21 ke kantor_pelayanan_pajak pratama hubungi _ph_email_"
    assert "bantuan" in _one(spark, norm, text.syntactic_tokens) and "mohon" not in _one(spark, norm, text.syntactic_tokens)
    assert _one(spark, None, text.normalize) == ""
    assert _one(spark, "x" * 40, lambda t: text.truncate(t, 20)) == "x" * 8 + " … " + "x" * 9
    assert _one(spark, "y" * 40, lambda t: text.truncate(t, 13)) == "y" * 13


def test_text_functions_against_regular_expressions(spark):
    samples = ["wp op lapor spt masa, DE dé éde de", "ＫＰＰ​ x\x07y", "e filing NPWP15 nik. nik.a pph4(2) acct rep", "12.345.678.9-012.345 081234567890 http://a.b/c?d 1.2.3.4 inc-12345", "terima  kasih selamat pagi dunia", "a é 5 ö9 e", ""]
    df = spark.createDataFrame(list(enumerate(samples)), "i long, t string")
    c = F.col("t")
    got = {r["i"]: r for r in df.select("i", text.word_forms(c).alias("w"), text.standard_terms(c).alias("s"), text.strip_control(c).alias("n"), text.drop_short_tokens(c, ("e",)).alias("d"), text.cut_stop_phrases(c).alias("p")).collect()}
    squeeze = lambda s: re.sub(r"\s{2,}", " ", s).strip()
    for i, s in enumerate(samples):
        w = t = s
        for a, b in rules.WORD_FORMS:
            w = re.sub(r"\b" + re.escape(a) + r"\b", b, w, flags=re.I)
        for a, b in rules.TERM_PATTERNS:
            t = re.sub(a, b, t, flags=re.I)
        n = re.sub(r"[\x00-\x1F\x7F-\x9F]", " ", re.sub("[​-‍﻿]", "", unicodedata.normalize("NFKC", s)))
        d = " ".join(x for x in re.findall(r"\b\w+\b", s) if len(x) > 1 or x == "e" or x.isdigit())
        p = re.sub("|".join(f"(?:{x})" for x in rules.STOP_PHRASES), " ", s, flags=re.I)
        assert (got[i]["w"], got[i]["s"], got[i]["n"], got[i]["d"], got[i]["p"]) == (squeeze(w), squeeze(t), squeeze(n), d, squeeze(p))
    for r in text.redact(df, "t").collect():
        want, counts = samples[r["i"]], {}
        for _, token, pattern in rules.REDACTIONS:
            want, k = re.subn(pattern, token, want)
            if k:
                counts[token] = counts.get(token, 0) + k
        assert r["redacted"] == want and dict(r["counts"]) == counts
    for r in text.redact_wide(df, "t").collect():
        want, hits = samples[r["i"]], []
        for name, pattern in rules.WIDE_REDACTIONS[1:]:
            hits += [(name, m[0]) for m in re.finditer(pattern, want)]
            want = re.sub(pattern, f" __{name}__ ", want)
        assert r["redacted"] == re.sub(r"\s+", " ", want).strip() and [tuple(h) for h in r["hits"]] == hits


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, ["b", "c", "d"])], "doc_id long, tokens array<string>")
    w = {(r["doc_id"], r["term"]): round(r["weight"], 6) for r in vectors.tfidf(docs, 2, 0.95).collect()}
    assert w == {(1, "a"): 0.643841, (1, "b"): 0.643841, (2, "a"): 0.858455, (2, "c"): 0.429227, (3, "b"): 0.429227, (3, "c"): 0.429227}
    assert vectors.tfidf(docs, 2, 0.6).count() == 0


def _topics(docs, bigrams=True):
    """(cluster, term) to score, by the definition."""
    terms = {d: (c, list(w) + [f"{a} {b}" for a, b in zip(w, w[1:])] * bigrams) for c, d, w in docs}
    n, df, scores = {}, {}, {}
    for c, t in terms.values():
        n[c] = n.get(c, 0) + 1
        for x in set(t):
            df[c, x] = df.get((c, x), 0) + 1
    for c, t in terms.values():
        w = {x: t.count(x) * (math.log((1 + n[c]) / (1 + df[c, x])) + 1) for x in set(t)}
        for x, v in w.items():
            scores[c, x] = scores.get((c, x), 0) + v / math.sqrt(sum(y * y for y in w.values()))
    return scores


@pytest.mark.parametrize("share", [25, 10**6])
def test_topics_of_shared_clusters(spark, monkeypatch, share):
    """LBL-06: documents of one cluster in many buckets, words with a blank, and no row for each document and term."""
    from reprise.operators import topics

    monkeypatch.setattr(topics, "SHARE", share), monkeypatch.setattr(topics, "BUCKET", 60), monkeypatch.setattr(topics, "PART", 100)
    r = np.random.default_rng(5)
    docs = [("AB"[i % 2], i, [str(w) for w in r.choice(["a", "b", "a b", "c", "é", "d"] + [f"w{j}" for j in range(15)], r.integers(1, 12))]) for i in range(80)]
    rows = spark.createDataFrame(docs + [("C", 200, ["x"]), ("A", 201, []), (None, 202, ["a"])], "cluster_id string, doc_id long, tokens array<string>")
    found = labeling.cluster_topics(rows, 7)
    got = {(x["cluster_id"], x["term"]): (x["rank"], x["score"]) for x in found.collect()}
    want = _topics(docs + [("A", 201, [])])
    for c in "AB":
        best = sorted((-round(v, 9), t) for (k, t), v in want.items() if k == c)[:7]
        assert [t for (k, t), _ in sorted(got.items(), key=lambda x: x[1][0]) if k == c] == [t for _, t in best]
        assert all(math.isclose(got[c, t][1], -v, abs_tol=1e-8) for v, t in best)
    assert len(got) == 14 and "Generate" not in found._jdf.queryExecution().toString()


def test_topics_move_terms_not_entries(spark):
    """LBL-05: a term of a cluster's many documents leaves a bucket once."""
    rows = spark.createDataFrame([("A", i, ["a", "b", "c"]) for i in range(300)], "cluster_id string, doc_id long, tokens array<string>")
    found = labeling.cluster_topics(rows, 10)
    assert [(r["rank"], r["term"], round(r["score"], 6)) for r in found.orderBy("rank").collect()] == [(i + 1, t, round(300 / math.sqrt(5), 6)) for i, t in enumerate(["a", "a b", "b", "b c", "c"])]
    assert all("doc_id" not in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip(" :+-").startswith("Aggregate"))


def test_topics_send_pressed_documents_and_few_terms(spark, monkeypatch):
    """LBL-05: documents filled the disk with a row of words each, and buckets sent most terms back as candidates."""
    from reprise.operators import topics

    for name, size in (("SHARE", 200), ("BUCKET", 400), ("GROUP", 600), ("PART", 1000)):
        monkeypatch.setattr(topics, name, size, raising=False)
    r = np.random.default_rng(7)
    docs = [("A", i, ["x", "y", *(f"w{min(int(j), 60)}" for j in r.zipf(1.3, 8)), f"own{i}"]) for i in range(400)]
    rows = spark.createDataFrame(docs, "cluster_id string, doc_id long, tokens array<string>")
    scores = topics.topic_scores(rows, 2, 2, True)
    want, got = _topics(docs), {(x["cluster_id"], x["term"]): x["score"] for x in scores.collect()}
    best = sorted(want, key=lambda k: -want[k])[:2]
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in best) and max(got, key=got.get) == best[0]
    assert len(got) < 60 < len(want)  # 191 before
    assert "MapInArrow" in scores._jdf.queryExecution().optimizedPlan().toString()  # presses them before they are dealt


def test_purity(spark):
    p = evaluation.purity(spark.createDataFrame([("s1", "y1", 3), ("s1", "y2", 1), ("s2", "y1", 2)], "cluster_a string, cluster_b string, n long"))
    got = {r["cluster_a"]: (r["purity"], round(r["entropy"], 6), round(r["entropy_norm"], 6), r["k"], r["dominant"]) for r in p.collect()}
    assert got == {"s1": (0.75, 0.811278, 0.811278, 2, "y1"), "s2": (1.0, 0.0, 0.0, 1, "y1")}
    a = evaluation.alignment(p).first()
    assert (round(a["purity"], 6), round(a["entropy_norm"], 6)) == (0.833333, 0.540852)
    none = spark.createDataFrame([], "k long")
    assert evaluation.set_agreement(none, none, "k").first()["jaccard"] == 1.0


def test_similarity_graph(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "id long, vector array<double>")
    for t, want in ((0.75, [{1, 2, 4}, {3}]), (0.6, [{1, 2, 3, 4}]), (0.9, [{1, 4}, {2}, {3}])):
        parts = {}
        for r in similarity.cluster_by_graph(rows, similarity.knn_edges(similarity.dense_pairs(rows, t), 3, t)).collect():
            parts.setdefault(r["cluster_id"], set()).add(r["id"])
        assert sorted(parts.values(), key=sorted) == sorted(want, key=sorted)
    kept = similarity.cluster_by_graph(rows, similarity.knn_edges(similarity.dense_pairs(rows, 0.75), 3, 0.75), 2)
    assert {r["id"] for r in kept.where("cluster_id = -1").collect()} == {3}


def test_sparse_pairs_are_all_found(spark):
    r = np.random.default_rng(1)
    data = [(int(i), f"t{j}", float(r.random())) for i in range(40) for j in r.choice(30, 6, replace=False)]
    m = np.zeros((40, 30))
    for i, t, w in data:
        m[i, int(t[1:])] = w
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if s[a, b] >= 0.5}
    got = {(x["a"], x["b"]): x["sim"] for x in similarity.sparse_pairs(spark.createDataFrame(data, "doc_id long, term string, weight double"), 0.5).collect()}
    assert set(got) == want and all(math.isclose(v, s[k], abs_tol=1e-9) for k, v in got.items())


def _sparse(spark, seed=2):
    r = np.random.default_rng(seed)
    data = [(int(i), "xy"[i % 2], f"t{j}", float(r.random())) for i in range(60) for j in r.choice(30, 6, replace=False)]
    m = np.zeros((60, 30))
    for i, _, t, w in data:
        m[i, int(t[1:])] = w
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return spark.createDataFrame(data, "doc_id long, g string, term string, weight double"), m @ m.T


@pytest.mark.parametrize("dense", [0.05, 0.3, 2.0])
def test_sparse_pairs_of_many_blocks(spark, monkeypatch, dense):
    """JN-14: all pairs over blocks that meet as a product; no candidate pairs are shuffled."""
    monkeypatch.setattr(similarity, "BLOCK_ENTRIES", 70), monkeypatch.setattr(similarity, "DENSE", dense)
    rows, s = _sparse(spark)
    found = similarity.sparse_pairs(rows.drop("g"), 0.45)
    got = {(x["a"], x["b"]): x["sim"] for x in found.collect()}
    assert set(got) == {(a, b) for a in range(60) for b in range(a + 1, 60) if s[a, b] >= 0.45} and all(math.isclose(v, s[k], abs_tol=1e-9) for k, v in got.items())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_forest_of_sparse_pairs_links_the_same_documents(spark, monkeypatch):
    """CLU-04: fewer edges than pairs, the same segments, within each group."""
    monkeypatch.setattr(similarity, "BLOCK_ENTRIES", 70)
    rows, _ = _sparse(spark)
    every, few = (similarity.sparse_pairs(rows, 0.3, ["g"], forest=f) for f in (False, True))
    assert every.where("a % 2 <> b % 2").count() == 0 and few.count() < every.count()
    parts = [{(r["id"], r["component"]) for r in connected_components(e, "a", "b").collect()} for e in (every, few)]
    assert parts[0] == parts[1]


def _texts(seed=5):
    """Tokens of documents of two languages, with copies, near copies, short ones and ones without tokens; and their pairs by brute force."""
    r = np.random.default_rng(seed)
    docs = []
    for i in range(150):
        words = r.zipf(1.5, int(r.integers(1, 60))) % 80
        docs.append([f"{'xy'[i % 2]}{w}" for w in words])
    docs += [docs[k][:-1] + ["z"] for k in range(20)] + [docs[3]] * 3 + [[], None]
    n = len(docs)
    df = {}
    for d in docs:
        for t in set(d or []):
            df[t] = df.get(t, 0) + 1
    kept = {t: k for k, t in enumerate(t for t in sorted(df) if 3 <= df[t] <= 0.5 * n)}
    m = np.zeros((n, len(kept)))
    for i, d in enumerate(docs):
        for t in d or []:
            if t in kept:
                m[i, kept[t]] += math.log((1 + n) / (1 + df[t])) + 1
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = m @ m.T
    return docs, m, {(a, b): s[a, b] for a in range(n) for b in range(a + 1, n) if s[a, b] >= 0.8}


@pytest.mark.parametrize("tile, docs", [(1024, 16_384), (16, 40)])
def test_text_pairs_are_those_of_brute_force(spark, monkeypatch, tile, docs):
    """JN-14: blocks by level, of which most pairs are out by a bound."""
    from reprise.operators import textpairs

    monkeypatch.setattr(textpairs, "TILE", tile), monkeypatch.setattr(textpairs, "BLOCK_DOCS", docs)
    texts, _, want = _texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens array<string>").repartition(3)
    found = textpairs.text_pairs(rows, 0.8, 3, 0.5).collect()
    got = {(x["a"], x["b"]): x["sim"] for x in found}
    assert len(found) == len(got) and set(got) == set(want) and all(math.isclose(v, want[k], abs_tol=1e-9) for k, v in got.items())
    assert textpairs.text_pairs(rows.where("doc_id < 0"), 0.8, 3, 0.5).count() == 0


@pytest.mark.parametrize("light", [0, 1e9])
@pytest.mark.parametrize("full", [0, 2])
def test_text_pairs_out_by_a_bound_are_not_worked_out(monkeypatch, light, full):
    """JN-14: every pair of documents was worked out."""
    import pyarrow as pa

    from reprise.operators import textpairs

    monkeypatch.setattr(textpairs, "LIGHT", light), monkeypatch.setattr(textpairs, "FULL", full)
    _, m, want = _texts()
    m = m[m.any(axis=1)]
    m = m[:, np.argsort((m > 0).sum(axis=0), kind="stable")]
    levels = np.arange(9, m.shape[1] + 9, 10).clip(max=m.shape[1] - 1)
    upto = np.cumsum(m**2, axis=1)[:, levels]
    tiles = []
    for rows in np.array_split(np.argsort((upto < 0.4).sum(axis=1), kind="stable"), 4):
        t, d = np.nonzero(m[rows].T)
        tiles.append(textpairs._Tile(pa.array(rows), t, d, m[rows].T[t, d], int((upto[rows] < 0.4).sum(axis=1).max()), levels))
    worked, plain, got, place = [], textpairs._cosines, {}, np.full(m.shape[1], -1)
    monkeypatch.setattr(textpairs, "_cosines", lambda x, y, p, r, c: (worked.append(len(r)), plain(x, y, p, r, c))[1])
    for j, y in enumerate(tiles):
        place[:] = -1
        place[y.terms] = np.arange(len(y.terms))
        for x in tiles[: j + 1]:
            got |= {tuple(sorted((x.ids[int(a)].as_py(), y.ids[int(b)].as_py()))): v for a, b, v in zip(*textpairs._near(x, y, place, 0.8))}
    s = m @ m.T
    a, b = np.nonzero(np.triu(s >= 0.8, 1))
    assert set(got) == set(zip(a.tolist(), b.tolist())) and all(math.isclose(v, s[k], abs_tol=1e-9) for k, v in got.items())
    assert len(got) <= sum(worked) < len(m) * (len(m) - 1) / 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 51), (52, 51), (60, 60), (7, 3), (None, 4)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and {got[50], got[51], got[52]} == {50}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_threshold_sweep(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (None, 1)], "sim double, label int")
    a = learning.threshold_sweep(rows, [0.75]).first()
    assert (a["tp"], a["fn"], a["fp"], a["tn"], a["precision"], a["recall"], a["f1"]) == (1, 1, 1, 0, 0.5, 0.5, 0.5)
    b = learning.threshold_sweep(rows, [0.75], missing=-1.0).first()
    assert b["fn"] == 2 and round(b["recall"], 6) == 0.333333 and round(b["f1"], 6) == 0.4
    assert learning.threshold_sweep(rows, [0.95]).first()["precision"] is None
    assert learning.confusion(rows, F.col("sim") >= 0.95).first()["precision"] == 0


def test_crossed_rows_are_made_once_and_dealt_as_one_order(spark):
    """ML-10: every fit reads the dealt rows, not their plan; folds follow the hashes over the whole class."""
    from pyspark.sql import Window as W

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    base = spark.range(0, 400, 1, 2).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("price"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("site"))
    out = learning.cross_predict(base.mapInArrow(count, base.schema), 4, lambda: learning.pipeline(["price"], ["site"]))
    got = {r["id"]: r["fold"] for r in out.collect()}
    place = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64(F.lit(42), "id"), "id"))
    assert got == {r["id"]: (r["p"] - 1) % 4 for r in base.select("id", place.alias("p")).collect()}
    assert made.value <= 2 * 400


def test_crossed_query_returns_what_the_models_predict(spark, monkeypatch):
    """ML-10: only rows were counted, whatever the fitted models said."""
    from reprise.catalog import prediction

    base = spark.range(200).select(F.col("id").alias("incident_id"), F.lit("x").alias("site"), (F.col("id") % 10).cast("double").alias("price"))
    for high in (1, 0):
        monkeypatch.setattr(prediction, "_data", lambda spark, sf: base.withColumn("label", F.when(F.col("price") >= 5, high).otherwise(1 - high)))
        got = {r["incident_id"]: r for r in prediction.crossed(spark, "").collect()}
        assert len(got) == 200 and {r["fold"] for r in got.values()} == set(range(5))
        assert all(r["prediction"] == r["label"] == (high if i % 10 >= 5 else 1 - high) and (r["score"] > 0.5) == (r["label"] == 1) for i, r in got.items())


def test_eligibility(spark):
    rows = spark.createDataFrame([(1, "X", "alpha"), (2, "X", "beta"), (3, "X", " alpha "), (4, None, "gamma"), (5, "Y", "delta"), (6, "Y", "alpha")], "id long, modul string, d string")
    got = {r["id"]: r["reason"] for r in quality.mark_eligibility(rows, ["modul", "d"], "d", "modul", ["id"], 2).collect()}
    assert got == {1: "kept", 2: "kept", 3: "duplicate", 4: "null", 5: "low_module", 6: "duplicate"}


def test_density():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 0.3, (60, 3)), r.normal(4, 0.3, (50, 3)), r.uniform(-3, 8, (15, 3))])
    labels, prob, outlier = density.hdbscan(x, 8)
    assert len(set(labels[:60]) - {-1}) == 1 and len(set(labels[60:110]) - {-1}) == 1 and labels[:60].max() != labels[60:110].max()
    assert ((prob >= 0) & (prob <= 1)).all() and ((outlier >= 0) & (outlier <= 1)).all() and (prob[labels < 0] == 0).all()
    assert density.dbcv(x, labels) > 0.5 and density.dbcv(x, np.zeros(len(x), int)) is None


@pytest.mark.parametrize("leaf", [False, True])
def test_density_of_many_blocks(spark, monkeypatch, leaf):
    """CLU-08, CLU-09: more points than one task holds were an error."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 0.3, (60, 3)), r.normal(4, 0.3, (50, 3)), r.uniform(-3, 8, (25, 3))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    monkeypatch.setattr(density, "MAX_POINTS", 100), monkeypatch.setattr(density, "BLOCK_POINTS", 30)
    got = density.cluster_density(rows, 8, leaf=leaf).orderBy("id").toPandas()
    labels, prob, outlier = density.hdbscan(x, 8, leaf=leaf)
    assert got["cluster_id"].tolist() == labels.tolist()
    assert np.allclose(got["prob"], prob) and np.allclose(got["outlier_score"], outlier)


def test_density_thins_edges_in_squares(spark, monkeypatch):
    """CLU-09: one task got the edges of every two blocks."""
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(0, 0.3, (60, 3)), r.normal(4, 0.3, (50, 3)), r.uniform(-3, 8, (25, 3))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    for name, size in (("MAX_POINTS", 100), ("BLOCK_POINTS", 20), ("SQUARE", 2)):
        monkeypatch.setattr(density, name, size, raising=False)
    found = density.cluster_density(rows, 8, leaf=True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 2
    got = found.orderBy("id").toPandas()
    monkeypatch.setattr(density, "SQUARE", 1000)
    want = density.cluster_density(rows, 8, leaf=True).orderBy("id").toPandas()
    assert got.equals(want) and len(got) == 135 and got["cluster_id"].max() >= 1


def test_validity_of_many_blocks(spark, monkeypatch):
    """EVC-03: the index over blocks, where one task held every distance between two clusters."""
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(0, 0.5, (40, 3)), r.normal(4, 0.5, (35, 3)), r.uniform(-3, 8, (20, 3)), [[9.0, 9.0, 9.0]]])
    c = np.r_[np.zeros(40, int), np.ones(35, int), np.full(20, -1), 2]
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c))], "id long, vector array<double>, cluster_id int")
    assert density.validity(rows).first()[0] == pytest.approx(density.dbcv(x, c), abs=1e-9)
    monkeypatch.setattr(density, "BLOCK_POINTS", 20)
    assert density.validity(rows).first()[0] == pytest.approx(density.dbcv(x, c), abs=0.05)  # equal edges make other trees of the same weight
    w = density._between(x, x)
    parts = [(i, j) for i in range(0, 96, 32) for j in range(i, 96, 32)]
    ends = [(a + i, b + j) for i, j in parts for a, b in zip(*density._forest_of_blocks(w[i : i + 32, j : j + 32], i == j))]
    a, b = np.array(ends).T
    assert w[a, b][density._forest(a, b, w[a, b])].sum() == pytest.approx(density._spanning_tree(w)[:, 2].sum())
    assert density.validity(rows.where("cluster_id <> 1")).first()[0] is None


def test_silhouettes(spark):
    r = np.random.default_rng(3)
    x, c = np.concatenate([r.normal(0, 1, (15, 4)) + [4, 0, 0, 0], r.normal(0, 1, (15, 4)) + [0, 4, 0, 0]]), [0] * 15 + [1] * 15
    rows = spark.createDataFrame([(i, c[i], x[i].tolist()) for i in range(30)], "id long, cluster_id long, vector array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    own = np.array([d[i, [j for j in range(30) if c[j] == c[i] and j != i]].mean() for i in range(30)])
    other = np.array([d[i, [j for j in range(30) if c[j] != c[i]]].mean() for i in range(30)])
    assert evaluation.euclidean_silhouette(rows).first()[0] == pytest.approx(((other - own) / np.maximum(own, other)).mean())


def test_files(spark, tmp_path):
    assert files.detect_delimiter("a;b;c\n1;2,5;3\n") == ";" and files.detect_delimiter_by_count("a|b|c,d") == "|"
    assert files.detect_encoding("é".encode()) == "utf-8" and files.detect_encoding(b"\xe9t\xe9 \x80") == "cp1252" and files.detect_encoding(b"\x81") == "latin-1"
    (tmp_path / "t.csv").write_text("a,b\n1,\n2,x\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv")).orderBy("a").collect()] == [("1", ""), ("2", "x")]
    raw = files.canonical(spark.createDataFrame([(" a ", "None")], "site string, modul string")).first()
    assert raw["site"] == "a" and raw["modul"] is None and raw["assignee"] is None


def test_upsert_with_null_keys(spark):
    old = spark.createDataFrame([(None, 1), (1, 1), (2, 1)], "k long, v long")
    new = spark.createDataFrame([(None, 2), (1, 3), (1, 2)], "k long, v long")
    assert sorted((str(r["k"]), r["v"]) for r in tables.upsert(old, new, ["k"]).collect()) == [("1", 2), ("2", 1), ("None", 2)]
