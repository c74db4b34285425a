"""Queries of the corpus operators with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.llm.common import id_remainder, table

#: (host, path, verdict): the rules that the URL query applies.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reprise.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reprise.llm.langid import fit_languages, identify_languages

    docs = table(spark, sf_dir, "documents")
    held = id_remainder(F.col("doc_id"), 4) == 2
    model = fit_languages(docs, ~held)
    return identify_languages(docs, model).withColumn("held_out", held)


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reprise.llm.syncmers import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reprise.llm.repeats import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reprise.llm.urlfilter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH u AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(h, pp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
       (SELECT h || pp FROM r WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, pp) ORDER BY length(h || pp) DESC, length(h) DESC LIMIT 1) AS rule,
       coalesce((SELECT v FROM r WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, pp) ORDER BY length(h || pp) DESC, length(h) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reprise.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reprise.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    return score_toxicity(docs, model).withColumn("held_out", held)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from reprise.llm.tokencount import count_tokens

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return count_tokens(table(spark, sf_dir, "documents"), definition)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reprise.llm.decontam import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), 10) AS l, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS t
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT doc_id, s, l, array_to_string(w[s : s + l - 1], ' ') AS t
  FROM d, lens, unnest(range(1, len(w) - l + 2)) AS u(s) WHERE len(w) >= l),
h AS (SELECT dw.doc_id, dw.s, dw.l, bw.item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.l = bw.l),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(s, s + l)) AS u(p) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reprise.llm.license import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])
    names = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return found.select("row.doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), names(base).alias("base_labels"), names(F.col("matches")).alias("labels"), score.alias("score"))


def _op10_sql() -> str:
    from reprise.llm.license import templates

    rows = ", ".join(f"({u}, '{label}', '{' '.join(words)}', '{' '.join(phrase)}', {base})" for u, (label, words, phrase, base) in enumerate(templates()))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT u, label, base, string_split(words, ' ') AS t, string_split(phrase, ' ') AS p FROM (VALUES {rows}) AS v(u, label, words, phrase, base)),
o AS (SELECT u, label, base, t, p, list_filter(range(0, len(t) - len(p) + 1), lambda i: t[i + 1 : i + len(p)] = p)[1] AS o FROM k),
terms AS (SELECT DISTINCT unnest(t) AS term FROM k),
f AS (SELECT term, count(r) AS df FROM terms LEFT JOIN (SELECT DISTINCT r, unnest(w) AS term FROM d) USING (term) GROUP BY term),
pl AS (SELECT u, o, len(p) AS np, i AS k, t[i + 1] AS term, i = list_position(t, t[i + 1]) - 1 AS first FROM o, unnest(range(0, len(t))) AS x(i)),
rk AS (SELECT pl.*, df, row_number() OVER (PARTITION BY u, first ORDER BY df, k) AS a, row_number() OVER (PARTITION BY u, k >= o AND k < o + np ORDER BY df, k) AS b FROM pl JOIN f USING (term)),
ix AS (SELECT u, k, term, df, k >= o AND k < o + np AND b = 1 AS anchor FROM rk WHERE (first AND a <= 8) OR (k >= o AND k < o + np AND b = 1)),
vo AS (SELECT term, min(df) AS df, bool_or(anchor) AS key FROM ix GROUP BY term),
lk AS (SELECT r, term FROM (SELECT r, term, key, row_number() OVER (PARTITION BY r ORDER BY df, term) AS n FROM (SELECT DISTINCT r, unnest(w) AS term FROM d) JOIN vo USING (term)) WHERE n <= 64 OR key),
c AS (SELECT r, u, s - 1 - o AS shift, s - 1 AS start FROM d, o, unnest(range(1, len(w) - len(p) + 2)) AS x(s) WHERE list_contains(w, p[1]) AND w[s] = p[1] AND w[s : s + len(p) - 1] = p),
g AS (
  SELECT c.r, c.u, c.start, count(*) FILTER (WHERE lk.term IS NOT NULL AND list_contains(w[greatest(shift + k - 8, 0) + 1 : greatest(shift + k + 9, 0)], ix.term)) / count(*) AS score
  FROM c JOIN ix USING (u) JOIN d USING (r) LEFT JOIN lk ON lk.r = c.r AND lk.term = ix.term GROUP BY c.r, c.u, c.start),
m AS (SELECT r, start, score, label, base FROM g JOIN k USING (u) WHERE base OR score >= 0.5),
b AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM m WHERE base GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM m GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_language, op3_syncmers, op4_repeats, op5_url_rules, op6_mixing, op7_toxicity, op8_tokens, op9_decontamination, op10_licenses, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_rules": OP5_SQL, "op9_decontamination": OP9_SQL, "op10_licenses": _op10_sql()}
