"""Anchored segments and run-length indexes for exact repeated substrings."""

from __future__ import annotations

import numpy as np

#: Length in bytes of the strings that count as repeated.
WINDOW = 100
#: Length in bytes of an anchor, and of the longer one that splits an anchor of many contexts.
ANCHOR, FINE = 24, 96
#: Texts are worked on in pieces of at most this many bytes.
PIECE = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(a: np.ndarray, b: np.ndarray, m: np.uint64) -> np.ndarray:
    h = a * m + b
    h ^= h >> np.uint64(32)
    h *= _ODD
    h ^= h >> np.uint64(29)
    return h


def _hashes(data: np.ndarray, anchor: int = ANCHOR) -> dict[int, np.ndarray]:
    """Hashes of the 8-, 16- and `anchor`-byte strings at each place, by length."""
    h = {1: (data.astype(np.uint64) + np.uint64(1)) * _ODD}
    for k, m in zip((1, 2, 4, 8), _MULTIPLIERS):
        h[2 * k] = _mix(h[k][: len(h[k]) - k], h[k][k:], m)
    n = len(data) - anchor + 1
    own = h[16][:n]
    for at in [*range(16, anchor - 16, 16), anchor - 16]:
        own = _mix(own, h[16][at : at + n], _MULTIPLIERS[4])
    h[anchor] = own
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    done, out = 1, values
    while 2 * done <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(texts: list[bytes], length: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, anchor, content, check, left, right, start, span) of every segment of some texts, in order.

    The anchor of a 100-byte window is its string of `length` bytes of the least hash, the first of equals. Windows in a row that
    have the same anchor at the same place make a segment: `span` + 1 windows, from the byte `start` on. Windows that are equal
    have anchors that are equal, at the same distance. anchor is the hash of that string; content and check together are 128 bits of hash over
    all the segment's bytes and the anchor's distance, so segments that agree in both have equal windows in equal order. left and right are 16 bits of
    hash over the half of a window's other bytes that stand before the anchor, and behind it; 0 where the segment has fewer. Two segments that
    share a window agree in one of these, since the window holds one half or the other.
    """
    parts, block, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(0, len(text) - WINDOW + 1), PIECE):
            piece = text[at : at + PIECE + WINDOW - 1]
            if size and size + len(piece) > PIECE + WINDOW:
                parts.append(_block(block, length))
                block, size = [], 0
            block.append((k, at, piece))
            size += len(piece)
    if block:
        parts.append(_block(block, length))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*parts))


def _block(pieces: list[tuple[int, int, bytes]], length: int):
    """Segments of pieces (text, offset in it, bytes), all long enough, worked on as one array."""
    data = np.frombuffer(b"".join(p for _, _, p in pieces), dtype=np.uint8)
    sizes = np.array([len(p) for _, _, p in pieces], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    h = _hashes(data, length)
    own = h[length]
    low = np.uint64((1 << 20) - 1)
    least = (_least((own & ~low) | np.arange(len(own), dtype=np.uint64), WINDOW - length + 1) & low).astype(np.int64)
    windows = sizes - WINDOW + 1
    inside = np.concatenate([np.arange(b, b + w) for b, w in zip(begins, windows)]) if len(pieces) > 1 else np.arange(windows[0])
    mine = least[inside]
    new = np.r_[True, (mine[1:] != mine[:-1]) | (inside[1:] != inside[:-1] + 1)]
    first = inside[new]
    last = inside[np.r_[np.flatnonzero(new)[1:], len(inside)] - 1]
    anchor = mine[new]
    found = []
    for m in (_MULTIPLIERS[2], _MULTIPLIERS[3]):
        content = _mix(_mix(own[anchor], (anchor - first).astype(np.uint64), m), (last - first).astype(np.uint64), _MULTIPLIERS[1])
        for step in (0, 16, 32, 48, 64, 80, 84):  # the first window, then what the last one adds to it
            content = _mix(content, h[16][first + step], m)
        for step in (16, 32, 48, 64, 80, 84):
            content = _mix(content, h[16][last + step], m)
        found.append(content)
    half, sides = (WINDOW - length) // 2, []
    for at, whole in ((anchor - half, anchor - half >= first), (anchor + length, anchor + length + half <= last + WINDOW)):
        key = np.zeros(len(first), np.int64)
        if half >= 32:
            at = at[whole]
            side = _mix(_mix(h[16][at], h[16][at + 16], _MULTIPLIERS[2]), h[16][at + half - 16], _MULTIPLIERS[3])
            key[whole] = (side >> np.uint64(48)).astype(np.int64) % 65535 + 1
        sides.append(key)
    piece = np.searchsorted(begins, first, side="right") - 1
    text = np.array([k for k, _, _ in pieces], dtype=np.int64)[piece]
    offset = np.array([a for _, a, _ in pieces], dtype=np.int64)[piece]
    return text, own[anchor], *found, *sides, first - begins[piece] + offset, last - first


class RunIndex:
    """A run-length Burrows-Wheeler index of many short strings, with the suffix array sampled at both ends of each run.

    Each string ends in a mark of its own, in the order of the strings. Kept are the runs of the transform (their
    symbol, first row and how many of that symbol stand before), where each symbol's rows begin, the samples and the strings. The suffix
    array itself is dropped once these are taken from it.
    """

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.count, self.sizes = len(strings), sizes
        ends = np.cumsum(sizes + 1) - 1
        self.data = np.frombuffer(b"\0".join(strings) + b"\0" * 9, dtype=np.uint8)
        symbols = self.data[: ends[-1] + 1].astype(np.int64) + self.count
        symbols[ends] = np.arange(self.count)
        self.starts, self.ends = ends - sizes, ends
        order = self._sorted()
        before = symbols[order - 1]  # of the first string, the last mark
        heads = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        self.heads, self.symbols = heads, before[heads]
        lengths = np.diff(np.r_[heads, len(before)])
        by_symbol = np.argsort(self.symbols, kind="stable")
        summed = np.cumsum(lengths[by_symbol]) - lengths[by_symbol]
        new = np.flatnonzero(np.r_[True, np.diff(self.symbols[by_symbol]) != 0])
        summed -= np.repeat(summed[new], np.diff(np.r_[new, len(summed)]))
        self.rank = np.empty_like(summed)
        self.rank[by_symbol] = summed
        totals = np.bincount(symbols, minlength=self.count + 256)
        self.first = np.cumsum(totals) - totals
        self.tops, self.bottoms = order[heads], order[np.r_[heads[1:], len(before)] - 1]

    def _sorted(self) -> np.ndarray:
        """The suffix array, by prefix doubling from seven symbols on; marks differ, so it ends once the prefixes are as long as the strings."""
        n, width = int(self.ends[-1]) + 1, 7
        symbols = self.data[:n].astype(np.uint64) + np.uint64(1)
        symbols[self.ends] = 0
        padded = np.r_[symbols, np.zeros(width, np.uint64)]
        key = np.zeros(n, np.uint64)
        ended = np.zeros(n, bool)
        for i in range(width):  # what stands behind a mark does not count: the mark decides
            key = (key << np.uint64(9)) | np.where(ended, np.uint64(0), padded[i : i + n])
            ended |= padded[i : i + n] == 0
        order = np.argsort(key, kind="stable")  # equal ones that hold a mark stay in the order of their strings
        ordered = key[order]
        new = np.r_[True, (ordered[1:] != ordered[:-1]) | ended[order][1:]]
        while not new.all():
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            nxt = np.r_[rank[width:], np.zeros(min(width, n), np.int64)][:n]
            key = (rank << 32) | nxt
            order = np.argsort(key)
            ordered = key[order]
            new = np.r_[True, ordered[1:] != ordered[:-1]]
            width *= 2
        return order

    def step(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the symbol before its suffix, and the row of the suffix that begins with it."""
        run = np.searchsorted(self.heads, rows, side="right") - 1
        symbol = self.symbols[run]
        return symbol, self.first[symbol] + self.rank[run] + rows - self.heads[run]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at the places `a` and `b` of the strings have in common, up to their strings' ends."""
        most = np.minimum(*[self.ends[np.searchsorted(self.ends, x)] - x for x in (a, b)])
        words = np.lib.stride_tricks.sliding_window_view(self.data, 8)
        out, left = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(left):
            differ = words[a[left] + out[left]] != words[b[left] + out[left]]
            any_, at = differ.any(axis=1), differ.argmax(axis=1)
            out[left] += np.where(any_, at, 8)
            left = left[~any_ & (out[left] < most[left])]
        return np.minimum(out, most)

    def matching_lengths(self) -> np.ndarray:
        """For each place of the strings, marks included, the length of its match with the suffix one row above: matching statistics of the strings against themselves.

        Only where a run begins is a length found by comparing bytes, between the sample at its first row and that at the last row of the run
        above. Elsewhere the same symbol stands before both suffixes, so the match is that of the place before, less one byte.
        """
        n = int(self.ends[-1]) + 1
        at = np.zeros(n, bool)
        known = np.zeros(n, np.int64)
        at[self.tops] = True
        known[self.tops[1:]] = self._common(self.tops[1:], self.bottoms[:-1])
        place = np.arange(n)
        last = np.maximum.accumulate(np.where(at, place, -1))
        return np.where(last >= 0, known[last] - (place - last), 0)

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, place, class) of every place of the strings with WINDOW bytes to go, streamed through the transform from right to left.

        All strings step together, from the rows of their end marks, and each place is met with its row and matching length. Places of one class
        match for WINDOW bytes or more: no shorter match stands between their rows.
        """
        lengths = self.matching_lengths()
        rows, places = np.arange(self.count), self.sizes.copy()
        active = np.arange(self.count)
        found = []
        while len(active):
            active = active[places[active] > 0]
            _, rows[active] = self.step(rows[active])
            places[active] -= 1
            ready = active[places[active] <= self.sizes[active] - WINDOW]
            if len(ready):
                found.append((ready, places[ready], rows[ready], lengths[self.starts[ready] + places[ready]]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        string, place, row, length = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(row, kind="stable")
        match = np.empty(len(row), np.int64)
        match[order] = np.cumsum(length[order] < WINDOW)
        return string, place, match
