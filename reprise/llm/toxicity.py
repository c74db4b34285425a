"""Toxicity by compression distance between a toxic and an ordinary dictionary."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEPARATORS = re.compile(rb"[^a-z0-9\x80-\xff]+")
#: Bytes of the strings by which toxic and ordinary texts are told apart when a dictionary is trained.
_GRAM = 7


@dataclass(frozen=True)
class ToxicityModel:
    """Contents of the two dictionaries and the calibration of their length differences."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    window_words: int = 8
    step_words: int = 6
    threshold: int = 3


def _words(text: str | None) -> list[bytes]:
    return _SEPARATORS.sub(b" ", (text or "").encode().lower()).split()


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text's words with single spaces, and the _GRAM bytes from each place on, packed."""
    data = np.frombuffer(b" " + b" ".join(_words(text)) + b" " + b"\0" * 8, dtype=np.uint8)
    n = len(data) - 8
    packed = np.zeros(n, dtype=np.uint64)
    for i in range(_GRAM):
        packed = (packed << np.uint64(8)) | data[i : i + n]
    return data[:n], packed[: max(0, n - _GRAM + 1)]


def _unlike(own: list[str], other: list[str], ratio: float, least: int) -> list[bytes]:
    """What the texts of `own` say unlike those of `other`: their bytes covered by strings of _GRAM that at least `least` of them have, `ratio` times as often."""
    def held(texts):
        return np.unique(np.concatenate([np.unique(_grams(t)[1]) for t in texts]), return_counts=True)

    runs, n = held(own)
    runs, n = runs[n >= least], n[n >= least]
    known, m = held(other)
    at = np.minimum(np.searchsorted(known, runs), max(0, len(known) - 1))
    m = np.where(known[at] == runs, m[at], 0) if len(known) else np.zeros(len(runs))
    runs = runs[(n + 0.5) / (len(own) + 1) >= ratio * (m + 0.5) / (len(other) + 1)]
    out = []
    for text in own:
        data, packed = _grams(text)
        covered = np.zeros(len(data) + 2, dtype=np.int8)
        for i in np.flatnonzero(np.isin(packed, runs)):
            covered[i + 1 : i + 1 + _GRAM] = 1
        edges = np.flatnonzero(np.diff(covered)).tolist()
        body = data.tobytes()
        out += [body[i:j] for i, j in zip(edges[0::2], edges[1::2])]
    return out


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A zstandard dictionary of about `size` bytes trained on samples; of too few for the trainer, the last bytes of the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _windows(words: list[bytes], size: int, step: int) -> list[bytes]:
    """Windows of `size` words, `step` apart, so that neighbours share words and a phrase of a few words lies whole in some window."""
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, max(1, len(words) - size + step), step) if words]


class Meter:
    """How many bytes fewer a window takes with the toxic dictionary than with the ordinary one."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, window_log=16, hash_log=15, chain_log=15, search_log=4, min_match=6, write_content_size=False, write_dict_id=False)
        self.toxic, self.ordinary = [
            zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress for c in (model.toxic, model.ordinary)
        ]

    def windows(self, text: str | None) -> tuple[list[bytes], list[int]]:
        parts = _windows(_words(text), self.model.window_words, self.model.step_words)
        toxic, ordinary = self.toxic, self.ordinary
        return parts, [len(ordinary(p)) - len(toxic(p)) for p in parts]

    def features(self, saved: list[int]) -> list[float]:
        if not saved:
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        over = [s for s in saved if s >= self.model.threshold]
        return [1.0, max(saved) / 4, math.log1p(len(over)), 4 * len(over) / len(saved), sum(saved) / len(saved)]

    def score(self, saved: list[int]) -> float:
        z = sum(w * x for w, x in zip(self.model.weights, self.features(saved)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * len(y) * 0.01 * np.eye(len(w)), x.T @ (y - p) - penalty * len(y) * 0.01 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sampled(docs: DataFrame, labels: DataFrame, train: Column, rows: int, chars: int) -> list[tuple[str, int]]:
    """At most `rows` labelled texts in hash order, each in full or as eight even slices of `chars` characters in all."""
    known = labels.where(train).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(rows).collect()
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame(chosen, known.schema)
    step = chars // 8
    cuts = F.concat_ws(" ", *[F.substring("text", (F.lit(1) + (F.length("text") - step) * i / 7).cast("int"), F.lit(step)) for i in range(8)])
    whole = F.when(F.length("text") <= chars, F.col("text")).otherwise(cuts)
    taken = docs.where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").select("doc_id", whole.alias("t"), "toxic")
    return [(r["t"], int(r["toxic"] > 0)) for r in taken.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id", "t").limit(2 * rows).collect()]


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, rows: int = 4000, chars: int = 16384, toxic_bytes: int = 1024, ordinary_bytes: int = 16384, ratio: float = 15.0, least: int = 6) -> ToxicityModel:
    """Dictionaries and calibration from a bounded sample: at most `rows` labelled rows, `chars` characters of each.

    `labels` has (doc_id, toxic); rows where `train` holds take part, repeated ids with their highest label. zstandard's trainer makes the
    ordinary dictionary of windows of ordinary texts, and the toxic one of what toxic texts say unlike ordinary ones (`_unlike`): trained on whole
    windows, of which a few words at most are toxic, it would hold ordinary text. A window is compressed with the toxic dictionary in front of the
    ordinary one, and with padding of the same length in its place, so that only the toxic one makes a difference.

    Thresholds are calibrated across two halves of the sample: each half is measured with dictionaries of the other, so no text is measured with
    a dictionary that it was trained on; the final dictionaries are of the whole sample. With one class only, or no rows, every
    score is that class's smoothed share.
    """
    sample = _sampled(docs, labels, train, rows, chars)
    n, positive = len(sample), sum(y for _, y in sample)
    prior = math.log((positive + 0.5) / (n - positive + 0.5))
    flat = (prior, 0.0, 0.0, 0.0, 0.0)
    if not 0 < positive < n:
        return ToxicityModel(b" ", b" ", flat)

    def trained(part: list[tuple[str, int]]) -> ToxicityModel:
        toxic, ordinary = [t for t, y in part if y], [t for t, y in part if not y]
        if not toxic or not ordinary:
            return ToxicityModel(b" ", b" ", flat)
        base = _trained([w for t in ordinary for w in _windows(_words(t), 8, 8)], ordinary_bytes, 64)
        told = _trained(_unlike(toxic, ordinary, ratio, min(least, 1 + len(toxic) // 8)), toxic_bytes, 16)
        return ToxicityModel(told + base, b"#" * len(told) + base, flat)

    halves = sample[0::2], sample[1::2]
    meters = Meter(trained(halves[1])), Meter(trained(halves[0]))
    x = np.array([m.features(m.windows(t)[1]) for m, half in zip(meters, halves) for t, _ in half])
    y = np.array([v for half in halves for _, v in half], dtype=float)
    final = trained(sample)
    return ToxicityModel(final.toxic, final.ordinary, tuple(map(float, _logistic(x, y))))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted, n_windows, worst) for every row of `docs` (doc_id, text).

    The whole text is cut into windows of a few words; each is compressed with either dictionary. The saving of
    the toxic one, at its highest, over all windows and over those beyond the threshold, is mapped to a score
    from 0 to 1; predicted is 1 from 0.5 on. worst is the window with the largest saving (ties: the first), null
    without words. Null and empty texts, and texts without words, get the score of no evidence. Repeated rows are scored each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model)
        for batch in batches:
            scores, counts, worst = [], [], []
            for value in batch.column(1):
                parts, saved = meter.windows(value.as_py())
                scores.append(meter.score(saved))
                counts.append(len(saved))
                worst.append(parts[saved.index(max(saved))].decode("utf-8", "replace").strip() if saved else None)
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(counts, pa.int64()), pa.array(worst, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "n_windows", "worst"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_windows long, worst string")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs`, with all their columns, that `score_toxicity` does not predict as toxic.

    Null and empty texts have no evidence and stay, unless the labels are mostly toxic; rows that repeat stay or go alike; no rows give no rows.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model)
        for batch in batches:
            yield batch.filter(pa.array([meter.score(meter.windows(t.as_py())[1]) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
