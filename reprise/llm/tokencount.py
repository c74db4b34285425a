"""Token counts by a two-tier table of pre-token lengths."""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the byte-level pre-tokenizer of the vocabulary splits text. White space is the Unicode property, as in the
#: library; Python's own \s would add U+001C to U+001F.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

#: A pre-token of more characters than this is encoded wherever it stands, never kept; an entry of the cache is taken to need ENTRY bytes beside its text.
LONGEST, ENTRY = 64, 160

#: One encoder and one cache of misses for each worker process, by tokenizer definition.
_WORKER: dict = {}


class _Encoder:
    """Lengths of pre-tokens: the broadcast table first, then this worker's cache, then the library."""

    def __init__(self, definition: str, frequent: dict[str, int], cache_bytes: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = regex.compile(PRETOKEN).findall
        specials = sorted((t["content"] for t in json.loads(definition).get("added_tokens", [])), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.frequent, self.cache_bytes = frequent, cache_bytes
        self.known, self.held = dict(frequent), 0

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special tokens stand between them."""
        if self.specials is None or not self.specials.search(text):
            return self.split(text), 0
        parts = self.specials.split(text)
        return [p for part in parts for p in self.split(part)], len(parts) - 1

    def lengths(self, pretokens: list[str]) -> dict[str, int]:
        encoded = self.tokenizer.encode_batch(pretokens, add_special_tokens=False)
        return {p: len(e) for p, e in zip(pretokens, encoded)}

    def count(self, text: str) -> int:
        tokens, total = self.pretokens(text)
        try:
            return total + sum(map(self.known.__getitem__, tokens))
        except KeyError:
            own = {t for t in tokens if t not in self.known}
        found = self.lengths(sorted(own))
        total += sum(found[t] if t in found else self.known[t] for t in tokens)
        for t, n in found.items():
            if len(t) <= LONGEST:
                self.known[t] = n
                self.held += ENTRY + 4 * len(t)
        if self.held > self.cache_bytes:
            self.known, self.held = dict(self.frequent), 0
        return total


def check_definition(definition: str) -> None:
    """Refuse a tokenizer whose counts are not sums over pre-tokens of the byte-level pattern."""
    d = json.loads(definition)
    pre = d.get("pre_tokenizer") or {}
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) for t in d.get("added_tokens", []))
    if d.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
        raise ValueError("only byte-level tokenizers without normalizer and prefix space are counted by pre-token")


def frequent_lengths(docs: DataFrame, definition: str, entries: int, sample_rows: int, sample_chars: int = 8192) -> dict[str, int]:
    """Lengths of up to `entries` frequent pre-tokens, learned from `sample_rows` rows picked by a hash, `sample_chars` characters of each at most.

    The table only saves work: a pre-token that it lacks is encoded by the worker that meets it. Rows are picked by one scan; a repeated
    text is picked once.
    """
    encoder, seen = _Encoder(definition, {}, 0), Counter()
    mixed = F.xxhash64(F.lit(5), "text")
    start = F.lit(1) + F.pmod(mixed, F.greatest(F.lit(1), F.length("text") - sample_chars)).cast("int")
    sliced = docs.where("text IS NOT NULL").select(mixed.alias("m"), F.substring(F.col("text"), start, F.lit(sample_chars)).alias("t"))
    picked = docs.where("text IS NOT NULL").select(mixed.alias("m")).distinct().orderBy("m").limit(sample_rows).agg(F.max("m")).first()[0]
    for row in (sliced.where(F.col("m") <= picked).distinct().collect() if picked is not None else []):
        seen.update(encoder.pretokens(row["t"])[0])
    most = nlargest(entries, seen, key=lambda t: (seen[t], t))
    return encoder.lengths([t for t in most if seen[t] > 1 and len(t) <= LONGEST])


def count_tokens(docs: DataFrame, definition: str, limit: int = 1024, entries: int = 32768, sample_rows: int = 2000, cache_bytes: int = 96 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of `docs` (doc_id, text).

    `definition` is the JSON of a byte-level tokenizer. Tier one is a broadcast table of at most
    `entries` pre-token lengths; tier two is a cache of about `cache_bytes` in each worker, filled by
    encoding what it lacks and emptied when full. No pre-token is shuffled. Special strings inside a text count as the
    library counts them by default: one token each. A null text is empty: 0 bytes, 0 tokens.
    Repeated rows are counted each. Other columns of `docs` are not read.
    """
    check_definition(definition)
    sent = docs.sparkSession.sparkContext.broadcast((definition, frequent_lengths(docs, definition, entries, sample_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = sent.value
        encoder = _WORKER.get((own, cache_bytes))
        if encoder is None or encoder.frequent is not table:
            _WORKER.clear()
            encoder = _WORKER[own, cache_bytes] = _Encoder(own, table, cache_bytes)
        for batch in batches:
            texts = batch.column(1)
            counts, sizes = [], []
            for value in texts:
                text = value.as_py() or ""
                counts.append(encoder.count(text))
                sizes.append(len(text.encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
