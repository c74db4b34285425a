"""Removal of byte strings that occurred before, by anchored shards and run-length indexes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.llm.positional import small
from reprise.llm.runindex import FINE, WINDOW, RunIndex, segments
from reprise.plans.lineage import cut

#: An anchor with more different segments than this is dealt again by longer anchors, which split its contexts.
MANY = 256
#: Strings of at most so many bytes go into one index.
SHARD = 1 << 18
#: Texts of about so many bytes are marked at a time.
MARKED = 12 << 20
#: Stands for a null id; such rows come first.
NULL_ID = -(1 << 63)

_SEGMENT, _DONE, _STRINGS, _HOT = 0, 1, 2, 3
_ROW = "part int, kind int, blob binary"


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes, each in the smallest unsigned type; signed 64-bit ones as they are."""
    out = [len(columns[0]).to_bytes(8, "little"), bytes([len(columns)])]
    for c in columns:
        kind = c.dtype.str
        if c.dtype == np.int64 and len(c) and c.min() >= 0:
            kind = np.min_scalar_type(int(c.max())).str
        body = np.ascontiguousarray(c, dtype=kind).tobytes()
        out += [kind.encode().ljust(4), body]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    n, k, at, out = int.from_bytes(blob[:8], "little"), blob[8], 9, []
    for _ in range(k):
        kind = np.dtype(blob[at : at + 4].decode().strip())
        at += 4
        column = np.frombuffer(blob, dtype=kind, count=n, offset=at)
        at += n * kind.itemsize
        out.append(column if kind == np.uint64 and kind.itemsize == 8 else column.astype(np.int64))
    return out


def _xxh64(v: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of 64-bit integers, each with a seed of its own, as Spark's xxhash64 of one long column."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = seed + p5 + np.uint64(8)
    h ^= turn(v.astype(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _bucket(ids: np.ndarray, ties: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of each document, as Spark's pmod(xxhash64(id, tie), parts)."""
    one = _xxh64(ids.astype(np.int64).view(np.uint64), np.full(len(ids), 42, np.uint64))
    return np.mod(_xxh64(ties.astype(np.int64).view(np.uint64), one).view(np.int64), parts)


def _split(part: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One row (part, kind, blob) for each part."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    columns = [c[order] for c in columns]
    for a, b in zip(cuts, np.r_[cuts[1:], len(part)]):
        yield int(part[a]), kind, _pack(*[c[a:b] for c in columns])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "blob"])


def _flushed(rows: Iterator[tuple[int, int, bytes]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size >= limit or len(held) >= 20_000:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _by_bucket(found: Iterator[tuple], parts: int, limit: int = 1 << 18) -> Iterator[tuple[int, int, bytes]]:
    """(kind, doc, tie, more columns) put together over many parts, then dealt by the document's bucket.

    A task so sends each bucket a few rows, not one for each of its parts.
    """
    held: dict[int, list[tuple]] = {}
    size = 0

    def out():
        for kind, rows in held.items():
            doc, tie, *rest = (np.concatenate(c) for c in zip(*rows))
            yield from _split(_bucket(doc, tie, parts), kind, doc, tie, *rest)

    for kind, *columns in found:
        if not len(columns[0]):
            continue
        held.setdefault(kind, []).append(tuple(columns))
        size += len(columns[0])
        if size >= limit:
            yield from out()
            held, size = {}, 0
    yield from out()


def _firsts(groups: list[np.ndarray], ids: np.ndarray, ties: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which rows stand at the least (id, tie, place) of their group, which all of `groups` tell apart."""
    order = np.lexsort((places, ties, ids, *groups))
    i, t, p = ids[order], ties[order], places[order]
    new = np.r_[True, np.logical_or.reduce([g[order][1:] != g[order][:-1] for g in groups])]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.empty(len(order), bool)
    out[order] = (i == i[head]) & (t == t[head]) & (p == p[head])
    return out


def _runs(ids: np.ndarray, ties: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows at (id, tie, place) as (id, tie, start, length) of the byte runs that windows in a row cover."""
    if not len(ids):
        return ids, ties, places, places
    order = np.lexsort((places, ties, ids))
    ids, ties, places = ids[order], ties[order], places[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]) | (places[1:] > places[:-1] + 1)]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(ids)] - 1
    return ids[at], ties[at], places[at], places[last] - places[at] + WINDOW


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """(part, blobs by kind) from rows that come sorted by part."""
    part, held = None, {}
    for batch in batches:
        for p, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                if held:
                    yield part, held
                part, held = p, {}
            held.setdefault(kind, []).append(blob)
    if held:
        yield part, held


def _joined(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*map(_unpack, blobs))]


def _mark(parts: int):
    """Segments of each batch of documents, dealt by anchor; those that the batch has seen before are done."""
    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
        ids, ties = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), dtype=np.int64) for c in (0, 1))
        order = np.lexsort((ties, ids))
        texts = [(batch.column(2)[int(i)].as_py() or "").encode() for i in order]
        text, anchor, content, check, left, right, start, span = segments(texts)
        if not len(text):
            return
        doc, tie = ids[order][text], ties[order][text]
        first = _firsts([content, check], doc, tie, start)
        rest = ~first
        yield from _split(np.full(int(rest.sum()), int(ids[0]) % parts), _DONE, doc[rest], tie[rest], start[rest], span[rest] + WINDOW)
        # Within a part 32 bits of the anchor tell its groups apart well enough: two in one group only share an index.
        part, anchor = (anchor >> np.uint64(20)).astype(np.int64) % parts, (anchor >> np.uint64(32)).astype(np.int64)
        yield from _split(part[first], _SEGMENT, anchor[first], content[first], check[first], left[first], right[first], doc[first], tie[first], start[first], span[first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, step = batch.num_rows, max(1, MARKED * batch.num_rows // max(1, batch.nbytes))
            for at in range(0, rest, step):
                yield from _flushed(rows(batch.slice(at, step)))
            pa.default_memory_pool().release_unused()

    return run


def _met(anchor: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which rows have a side that another row of their anchor has too."""
    _, inverse, counts = np.unique((anchor << 16) | side, return_inverse=True, return_counts=True)
    return (side > 0) & (counts[inverse] > 1)


def _classify(parts: int):
    """Of each anchor's segments: repeated contents are done, and of different ones with a side in common the first of each goes on."""
    def found(batches) -> Iterator[tuple]:
        for part, held in _by_part(batches):
            for blob in held.get(_DONE, []):
                yield _DONE, *_unpack(blob)
            if _SEGMENT not in held:
                continue
            anchor, content, check, left, right, doc, tie, start, span = _joined(held[_SEGMENT])
            first = _firsts([content, check], doc, tie, start)
            rest = ~first
            yield _DONE, doc[rest], tie[rest], start[rest], span[rest] + WINDOW
            anchor, left, right, doc, tie, start, span = (c[first] for c in (anchor, left, right, doc, tie, start, span))
            met = _met(anchor, left) | _met(anchor, right)  # the others share no window with any
            anchor, doc, tie, start, span = (c[met] for c in (anchor, doc, tie, start, span))
            _, inverse, counts = np.unique(anchor, return_inverse=True, return_counts=True)
            shared = counts[inverse]
            few, many = (shared > 1) & (shared <= MANY), shared > MANY
            yield _STRINGS, doc[few], tie[few], start[few], span[few], anchor[few], np.full(int(few.sum()), part)
            yield _HOT, doc[many], tie[many], start[many], span[many]

    return lambda batches: _flushed(_by_bucket(found(batches), parts))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[int], list, pa.RecordBatch | None]]:
    """Documents in the order of their buckets, each with its bucket's blobs: (bucket, blobs by kind, row, batch)."""
    bucket, held = None, {}
    for batch in batches:
        part, kinds, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for row, (p, kind) in enumerate(zip(part, kinds)):
            if p != bucket:
                bucket, held = p, {}
            if kind >= 0:
                held.setdefault(kind, []).append(blobs[row].as_py())
            else:
                yield bucket, held, row, batch


class _Lookup:
    """What a bucket's blobs say of one document."""

    def __init__(self) -> None:
        self.bucket, self.columns = None, {}

    def __call__(self, bucket: int, held: dict, kind: int, doc: int, tie: int) -> list[np.ndarray] | None:
        if bucket != self.bucket:
            self.bucket, self.columns = bucket, {}
            for k, blobs in held.items():
                columns = _joined(blobs)
                order = np.lexsort((columns[1], columns[0]))
                columns = [c[order] for c in columns]
                at = np.flatnonzero(np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])
                spans = zip(columns[0][at].tolist(), columns[1][at].tolist(), at.tolist(), [*at[1:].tolist(), len(order)])
                self.columns[k] = {(d, t): (a, b) for d, t, a, b in spans}, columns[2:]
        places, columns = self.columns.get(kind, ({}, []))
        a, b = places.get((doc, tie), (0, 0))
        return [c[a:b] for c in columns] if b > a else None


def _fetch(parts: int):
    """The bytes of segments that wait for an index, dealt by anchor; those of a hot anchor are cut into finer segments, dealt by their longer anchors."""
    def rows(batches) -> Iterator[tuple[int, int, bytes]]:
        lookup = _Lookup()
        found, strings, size = [], [], 0
        for bucket, held, row, batch in _streamed(batches):
            if not held:
                continue
            doc, tie = batch.column(3)[row].as_py(), batch.column(4)[row].as_py()
            few, hot = lookup(bucket, held, _STRINGS, doc, tie), lookup(bucket, held, _HOT, doc, tie)
            if few is None and hot is None:
                continue
            text = (batch.column(5)[row].as_py() or "").encode()
            own = [few] if few is not None else []
            if hot is not None:
                pieces = [text[s : s + n + WINDOW] for s, n in zip(hot[0].tolist(), hot[1].tolist())]
                piece, anchor, _, _, _, _, start, span = segments(pieces, FINE)
                own.append([hot[0][piece] + start, span, (anchor >> np.uint64(32)).astype(np.int64), (anchor >> np.uint64(20)).astype(np.int64) % parts])
            for start, span, anchor, part in own:
                found.append((part, anchor, np.full(len(start), doc), np.full(len(start), tie), start, span))
                strings += [text[s : s + n] for s, n in zip(start.tolist(), (span + WINDOW).tolist())]
                size += int(span.sum()) + WINDOW * len(span)
            if size >= 4 << 20:
                yield from _strings(found, strings)
                found, strings, size = [], [], 0
        if found:
            yield from _strings(found, strings)

    return lambda batches: _flushed(rows(batches))


def _strings(found: list[tuple], strings: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """One row for each part: its columns (anchor, doc, tie, start, span), and then the bytes of its strings."""
    part, *columns = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
        own = order[a:b]
        head = _pack(*[c[own] for c in columns])
        yield int(part[own[0]]), _STRINGS, len(head).to_bytes(8, "little") + head + b"".join([strings[i] for i in own.tolist()])


def _index(parts: int):
    """Run-length indexes over the strings of each part; windows that an earlier place matches are done."""
    def resolve(anchor, doc, tie, start, strings):
        """Windows to remove, from indexes of whole anchor groups of about SHARD bytes; of strings that repeat, only the first is indexed."""
        seen: dict[bytes, int] = {}
        keep = []
        for i in np.lexsort((start, tie, doc, anchor)).tolist():
            first = seen.setdefault(strings[i], i)
            if first == i:
                keep.append(i)
            elif (doc[i], tie[i], start[i]) != (doc[first], tie[first], start[first]):  # a row that repeats has one verdict
                n = len(strings[i]) - WINDOW + 1
                yield np.full(n, doc[i]), np.full(n, tie[i]), np.arange(start[i], start[i] + n)
        order = np.array(keep)
        sizes = np.array([len(strings[i]) for i in order])
        new = np.r_[True, anchor[order][1:] != anchor[order][:-1]]
        groups = np.flatnonzero(new)
        shard = (np.cumsum(sizes)[groups] - sizes[groups]) // SHARD
        for s in np.unique(shard):
            g = np.flatnonzero(shard == s)
            a, b = groups[g[0]], groups[g[-1] + 1] if g[-1] + 1 < len(groups) else len(order)
            own = order[a:b]
            string, place, match = RunIndex([strings[i] for i in own]).stream()
            ids, ties, at = doc[own][string], tie[own][string], start[own][string] + place
            rest = ~_firsts([match], ids, ties, at)
            yield ids[rest], ties[rest], at[rest]

    def removed(batches) -> Iterator[tuple]:
        for _, held in _by_part(batches):
            columns, strings = [], []
            for blob in held[_STRINGS]:
                n = int.from_bytes(blob[:8], "little")
                columns.append(_unpack(blob[8 : 8 + n]))
                at = 8 + n
                for span in columns[-1][4].tolist():
                    strings.append(blob[at : at + span + WINDOW])
                    at += span + WINDOW
            anchor, doc, tie, start, _ = (np.concatenate(c) for c in zip(*columns))
            found = list(resolve(anchor, doc, tie, start, strings))
            yield _DONE, *_runs(*(np.concatenate(c) for c in zip(*found)))

    return lambda batches: _flushed(_by_bucket(removed(batches), parts))


def _merged(start: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) that the given ones cover, within `size` bytes."""
    order = np.argsort(start, kind="stable")
    a, b = np.minimum(start[order], size), np.minimum(start[order] + length[order], size)
    reach = np.maximum.accumulate(b)
    new = np.r_[True, a[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    a, b = a[at], reach[np.r_[at[1:], len(reach)] - 1]
    return a[b > a], b[b > a]


def _whole(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs without the characters that they hold in part."""
    a, b = [], []
    for s, e in zip(starts.tolist(), ends.tolist()):
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if e > s:
            a.append(s)
            b.append(e)
    return np.array(a, np.int64), np.array(b, np.int64)


def _remove(as_text: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup()
        found: list = []

        def out(batch, taken):
            rows, sizes, kept, spans = zip(*taken)
            body = pa.array([k.decode() for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            spans = pa.array([[{"start": int(a), "end": int(b)} for a, b in zip(*s)] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            return pa.RecordBatch.from_arrays([batch.column(6).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), body, spans], names)

        last, size = None, 0
        for bucket, held, row, batch in _streamed(batches):
            if batch is not last or size >= 4 << 20:
                if found:
                    yield out(last, found)
                found, last, size = [], batch, 0
            data = (batch.column(5)[row].as_py() or "").encode()
            done = lookup(bucket, held, _DONE, batch.column(3)[row].as_py(), batch.column(4)[row].as_py()) if held else None
            starts, ends = _merged(*done, len(data)) if done is not None else (np.zeros(0, np.int64),) * 2
            if as_text:
                starts, ends = _whole(data, starts, ends)
            edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(data)]
            found.append((row, len(data), b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2])), (starts, ends)))
            size += len(data)
        if found:
            yield out(last, found)

    return run


def _parts(docs: DataFrame) -> int:
    """Shards for about a MB of text each up to a GB, and in the measure of the square root beyond: 32 MB each at a TB."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(64, min(total >> 19, 1024 * math.sqrt(total / (1 << 29)))))


def _ties(rows: DataFrame) -> DataFrame:
    """`rows` (id, text and others) with `tie`: 0 where all rows of an id have one text, else the rank of the row's text among those of its id."""
    known = rows.select("id", F.xxhash64("text").alias("h")).distinct()
    shared = known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    ranked = cut(known.join(shared, "id").select("id", "h", F.row_number().over(W.partitionBy("id").orderBy("h")).cast("long").alias("tie")))
    return rows.withColumn("h", F.xxhash64("text")).join(small(ranked), ["id", "h"], "left").withColumn("tie", F.coalesce("tie", F.lit(0).cast("long"))).drop("h")


def remove_repeats(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """`docs` (doc_id, text and any other columns) as (row, n_bytes, kept, spans): what stays once repeated bytes go.

    Every byte goes that lies in a 100-byte string of its text (as UTF-8) that also starts earlier: in a smaller doc_id, or in the same
    one at a smaller start. Strings are judged on the input; overlaps count. row is the whole input row, kept the remaining
    bytes, spans the maximal removed runs. With `as_text`, characters that a run holds in part stay and kept is a string (empty for a null text).

    1. Each 100-byte window is assigned its minimal 24-byte string. Windows in a row with one such anchor make a segment;
       segments are dealt by anchor, as packed columns, after each batch has dropped those that it holds twice.
    2. Segments of one content, which 128 bits of hash tell apart, have one match: the earliest stays and the others go as a whole. Where an anchor has
       several contents that agree for half a window's length on one side of it, their strings are fetched from the texts and put into run-length BWT indexes, shard by shard.
       Streaming each string through its index, with matching statistics that start from the samples at run ends, tells
       which places match for 100 bytes; of the places of one match all but the earliest go.
    3. The segments of an anchor of more than MANY contents, such as a common line, are cut again by the minimal 96-byte strings of their
       windows and dealt by these, so that its contexts spread over many shards; they go through indexes like the others.

    Equal windows have equal anchors, so no match is lost. Null texts are empty. Texts under 100 bytes lose nothing. A null id comes before all.
    Rows that share an id, or have none, are documents of their own, in the order of a hash of their texts; rows that repeat both id and text are one document
    and lose alike. No rows give no rows.
    """
    rest = F.struct(*docs.columns)
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    parts = _parts(docs)
    docs = _ties(docs.select(ids.alias("id"), F.col("text").alias("text"), rest.alias("row")))
    dealt = docs.select("id", "tie", "text").mapInArrow(_mark(parts), _ROW).repartition("part").sortWithinPartitions("part")
    state = cut(dealt.mapInArrow(_classify(parts), _ROW))
    bucket = F.pmod(F.xxhash64("id", "tie"), F.lit(parts)).cast("int").alias("part")
    none = lambda kind: F.lit(None).cast(kind)

    def streamed(blobs: DataFrame, row) -> DataFrame:
        kind = docs.select(row.alias("row")).schema["row"].dataType
        rows = docs.select(bucket, F.lit(-1).alias("kind"), none("binary").alias("blob"), "id", "tie", "text", row.alias("row"))
        both = blobs.select("part", "kind", "blob", none("long").alias("id"), none("long").alias("tie"), none("string").alias("text"), none(kind).alias("row")).unionByName(rows)
        return both.repartition("part").sortWithinPartitions("part", F.col("kind").desc())

    waiting = state.where(F.col("kind") > _DONE)
    fetched = streamed(waiting, none("int")).mapInArrow(_fetch(parts), _ROW)
    resolved = fetched.repartition("part").sortWithinPartitions("part").mapInArrow(_index(parts), _ROW)
    done = state.where(F.col("kind") == _DONE).union(resolved)
    kind = docs.schema["row"].dataType.simpleString()
    body = "string" if as_text else "binary"
    return streamed(done, F.col("row")).mapInArrow(_remove(as_text, ["row", "n_bytes", "kept", "spans"]), f"row {kind}, n_bytes long, kept {body}, spans array<struct<start:long,end:long>>")
