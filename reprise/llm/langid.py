"""Language identification by compression against one dictionary for each language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language code, all of about one size."""

    contents: tuple[tuple[str, bytes], ...]


def letters(text: str | None) -> bytes:
    """The lower-cased letters of a text, in UTF-8, with single spaces for all else; empty where no character is a letter (Unicode category L)."""
    found = _OTHER.sub(" ", (text or "").lower()).strip()
    return found.encode() if any(map(str.isalpha, found)) else b""


def fit_languages(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", rows_per_lang: int = 256, slice_chars: int = 1024, dict_bytes: int = 131072, max_langs: int = 256) -> LanguageModel:
    """Dictionaries from a bounded sample: at most `rows_per_lang` slices of `slice_chars` characters for each language.

    Rows where `train` holds and text and language are known take part; a text counts once for each language, however often it
    is repeated. Each language is thinned by a hash to about twice the distinct texts it needs, then the first `rows_per_lang` slices
    by that hash are taken, language by language. More than `max_langs` languages are an error. Without
    training rows the model is empty and every prediction is `und`.
    """
    rows = docs.where(train).where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("k"))
    counts = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.approx_count_distinct(F.xxhash64("t")).alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return LanguageModel(())
    mixed = F.pmod(F.xxhash64(F.lit(7), "t"), F.lit(1_000_000))
    quota = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1_000_000, 2_000_000 * rows_per_lang // max(1, n) + 1))])
    start = F.lit(1) + F.pmod(F.xxhash64(F.lit(11), "t"), F.greatest(F.lit(1), F.length("t") - slice_chars)).cast("int")
    picked = rows.where(mixed < F.element_at(quota, F.col("k"))).select("k", mixed.alias("m"), F.substring(F.col("t"), start, F.lit(slice_chars)).alias("s")).distinct()
    ranked = picked.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("m", "s"))).where(F.col("r") <= rows_per_lang)
    pool: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in ranked.orderBy("k", "r").collect():
        pool[r["k"]].append(letters(r["s"]))
    return LanguageModel(tuple((k, b" ".join(pool[k])[:dict_bytes]) for k in sorted(pool)))


class Judge:
    """Compressed sizes of texts under every dictionary of a model."""

    def __init__(self, model: LanguageModel, window_bytes: int, margin: float) -> None:
        self.window, self.margin = window_bytes, margin
        self.codes = [k for k, _ in model.contents]
        self.packers = []
        how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, window_log=17, hash_log=14, chain_log=14, search_log=3, min_match=4, write_content_size=False, write_dict_id=False)
        for _, content in model.contents:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
            self.packers.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, confidence from 0 to 1, whether the margin is too narrow to accept it)."""
        data = letters(text)
        if not data or not self.codes:
            return "und", 0.0, True
        parts = [data[i : i + self.window] for i in range(0, len(data), self.window)]
        sizes = [sum(len(p.compress(x)) for x in parts) for p in self.packers]
        best = min(sizes)
        at = sizes.index(best)
        others = sizes[:at] + sizes[at + 1 :]
        score = 1 / sum(2.0 ** max(-60, best - s) for s in sizes)
        return self.codes[at], score, bool(others) and min(others) - best < self.margin * best


def identify_languages(docs: DataFrame, model: LanguageModel, window_bytes: int = 4096, margin: float = 0.01) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of `docs` (doc_id, text).

    The whole text is compressed, window by window, once with each language's dictionary; the smallest
    sum names the language (ties: the first code). score weighs the languages by 2 to the minus bytes. rejected is
    true where the runner-up needs less than `margin` more bytes, and for texts that are null or have no
    letter, whose language is `und` with score 0. Repeated rows are judged each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model, window_bytes, margin)
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
