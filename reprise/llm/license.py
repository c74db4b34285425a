"""License scans over a positional index of rare license words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.llm.common import alnum_words, let
from reprise.llm.licensetexts import BASE, MENTIONS, SPDX, TEXTS
from reprise.llm.positional import agreeing, document_frequencies, small, stands, with_candidates
from reprise.plans.lineage import cut


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def templates() -> list[tuple[str, list[str], list[str], bool]]:
    """(label, words, key phrase, base) of every template: texts, mentions, SPDX headers and the base phrases."""
    known = [(label, _words(text), _words(phrase), False) for label, text, phrase in TEXTS]
    known += [(label, _words(p), _words(p), False) for label, p in MENTIONS]
    known += [(f"spdx:{i}", _words(f"SPDX-License-Identifier: {i}"), _words(f"SPDX-License-Identifier: {i}"), False) for i in SPDX]
    return known + [(label, _words(p), _words(p), True) for label, p in BASE]


def _indexed(known: list[tuple], df: dict[str, int], rare: int) -> list[tuple[int, list[int], int, int]]:
    """(template, places, anchor, offset): the places of a template's `rare` rarest words and of the anchor, the rarest word of its key phrase.

    A word counts at its first place in the text, ties go to the earlier place; offset is where the key phrase begins.
    """
    out = []
    for unit, (_, words, phrase, _) in enumerate(known):
        offset = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        firsts = [i for i, w in enumerate(words) if w not in words[:i]]
        anchor = min(range(offset, offset + len(phrase)), key=lambda i: (df[words[i]], i))
        places = sorted(firsts, key=lambda i: (df[words[i]], i))[:rare]
        out.append((unit, sorted({*places, anchor}), anchor, offset))
    return out


def scan_licenses(docs: DataFrame, known: list[tuple] | None = None, rare: int = 8, looked_up: int = 64, reach: int = 8, least: float = 0.5) -> DataFrame:
    """(row, n_words, matches) for every row of `docs` (doc_id, text and any others); row is the whole input row.

    matches lists (label, base, start, score): the places where a template's mandatory key phrase stands word by word and at least
    `least` of its indexed words stand within `reach` words of their places relative to it; base templates need the phrase alone. start is
    the phrase's first word, score that share. `known` lists templates as `templates` does.

    One scan counts the document frequencies of all template words over all documents. Of each template its `rare` words of highest IDF and the rarest
    word of its key phrase are indexed with their places. Each row looks up the indexed words of highest IDF that it has, `looked_up` of them, and
    all key words: its postings of these, shifted by the places in the templates, are intersected by relative position. Where a key word
    agrees with enough others, the phrase is verified on the row's words. The index holds a few words for each template, so it is
    made on the driver and broadcast.

    Null and empty texts have no words and no matches; rows that repeat are judged each; no rows give no rows.
    """
    spark, known = docs.sparkSession, templates() if known is None else known
    terms = cut(spark.createDataFrame(sorted({(w,) for _, words, _, _ in known for w in words}), "term string"))
    df = {r["term"]: r["df"] for r in document_frequencies(docs, terms).collect()}
    index = _indexed(known, df, rare)
    lookups = cut(spark.createDataFrame([(known[u][1][k], u, k) for u, places, _, _ in index for k in places], "term string, unit int, k int"))
    by_idf = sorted({known[u][1][k] for u, places, _, _ in index for k in places}, key=lambda w: (df[w], w))
    keys = sorted({known[u][1][a] for u, _, a, _ in index})
    listed = lambda ws: F.array(*[F.lit(w) for w in ws])
    wanted = lambda ws: F.array_union(F.slice(F.array_intersect(listed(by_idf), ws), 1, looked_up), F.array_intersect(listed(keys), ws))
    found = agreeing(docs, lookups, reach, wanted)
    facts = [(u, a, label, base, phrase, offset, len(places)) for (u, places, a, offset), (label, _, phrase, base) in zip(index, known)]
    units = cut(spark.createDataFrame(facts, "unit int, k int, label string, base boolean, p array<string>, o int, n int"))
    met = found.join(small(units), ["unit", "k"]).withColumn("score", F.size("near") / F.col("n")).where(F.col("base") | (F.col("score") >= least))
    candidate = F.struct("label", "base", (F.col("shift") + F.col("o")).alias("start"), "score", "p")
    candidates = cut(met.groupBy("h1", "h2").agg(F.sort_array(F.collect_set(candidate)).alias("found")))
    none = F.array().cast(candidates.schema["found"].dataType)

    def verified(ws: Column) -> Column:
        fits = F.filter(F.coalesce("found", none), lambda c: stands(ws, c["start"], c["p"]))
        match = F.transform(fits, lambda c: F.struct(c["label"].alias("label"), c["base"].alias("base"), c["start"].alias("start"), c["score"].alias("score")))
        return F.struct(F.size(ws).cast("long").alias("n_words"), match.alias("matches"))

    rows = with_candidates(docs, candidates).select("row", let(alnum_words(F.col("body")), verified).alias("v"))
    return rows.select("row", "v.n_words", "v.matches")
