"""Periodic runs of words, by longest previous factors.

A run is a stretch of consecutive words that repeats with a smallest period of q
words, is ``max(6, 4 * q)`` words long at least and cannot be extended on either
side. In each text:

1. Ranks of the blocks of 1, 2, 4, ... words (each level made from the one before by
   sorting pairs) end in the suffix array; equal ranks tell how far two places agree, forwards
   and backwards, which gives the LCP array.
2. Taking places from last to first out of the suffix array leaves each with its neighbours among
   earlier places: the longest previous factor (LPF) and where it stands. LPF cuts the text
   into LZ blocks.
3. Main's extensions: for every border of blocks and every period that a run across it can have
   (up to the block on the right, and twice the block on the left besides) the agreement on both
   sides of the border is one run, if it reaches a period. All borders and periods of a
   batch are one array operation.
4. A run strictly inside a block is a copy of one in the block's source: blocks are gone through from
   left to right, runs stand in buckets by their start, and a bucket is copied by the block's distance.

A text without two equal blocks of four words has no run, since a run repeats five words or
more; such texts are done after the third level. Texts are worked through in batches of ``BATCH`` words or
one text, each task on its own: nothing is shuffled, and a lost executor's texts are read again.
Memory grows with the words of the longest text, times the levels of its longest repeat.

A null or empty text, or one of white space, has no words and no run; a null doc_id has no checksum,
so its text is taken as it is. Repeated rows are rows of their own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run's least length in words and in periods.
MIN_LENGTH, MIN_PERIODS = 6, 4
#: Words of a batch of texts.
BATCH = 200_000
#: Equal blocks of 2 ** LEAST words are in every text that has a run.
LEAST = 2

Run = tuple[int, int, int]


def altered(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words: by the id's checksum, one text in ten repeats a stretch up to its end."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


class _Blocks:
    """Ranks of blocks of 1, 2, 4, ... words of several texts; ``ends`` are the texts' ends in ``ids``."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        _, first = np.unique(text * (ids.max() + 1) + ids, return_inverse=True)
        self.start, self.end = np.append(0, ends[:-1])[text], ends[text]
        self.levels = [first]
        for _ in range(LEAST):
            self._double()
        _, rank, times = np.unique(self.levels[-1], return_inverse=True, return_counts=True)
        #: Numbers of the texts that can have a run; only their words go on.
        self.texts = np.unique(text[times[rank] > 1])
        kept = np.zeros(len(ends), bool)
        kept[self.texts] = True
        kept = kept[text]
        moved = np.append(0, np.cumsum(kept))
        self.start, self.end = moved[self.start[kept]], moved[self.end[kept]]
        self.levels = [x[kept] for x in self.levels]
        while len(self.start) and len(np.unique(self.levels[-1])) < len(self.start):
            self._double()
        # A place behind the last text, unlike all others.
        self.levels = [np.append(x, -1) for x in self.levels]

    def _double(self) -> None:
        """The ranks of blocks twice as long; what goes beyond the text's end is below all words."""
        last, width = self.levels[-1], 1 << (len(self.levels) - 1)
        at = np.arange(len(last)) + width
        second = np.where(at < self.end, last[np.minimum(at, len(last) - 1)] + 1, 0)
        _, rank = np.unique(last * (last.max() + 2) + second, return_inverse=True)
        self.levels.append(rank)

    def forwards(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Words that agree from places u and v on (u < v, of one text)."""
        out = np.zeros(len(u), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            r = self.levels[k]
            out += (r[u + out] == r[v + out]).astype(np.int64) << k
        return out

    def backwards(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Words that agree before places u and v."""
        out, start = np.zeros(len(u), np.int64), self.start[u]
        for k in range(len(self.levels) - 1, -1, -1):
            r, x, y = self.levels[k], u - out - (1 << k), v - out - (1 << k)
            out += ((x >= start) & (r[np.maximum(x, 0)] == r[np.maximum(y, 0)])).astype(np.int64) << k
        return out

    def previous_factors(self) -> tuple[list[int], list[int]]:
        """(LPF, source) of each place: the longest stretch from there that also starts earlier in the text, and where."""
        n = len(self.start)
        suffixes = np.argsort(self.levels[-1][:-1])
        rank = np.empty(n, np.int64)
        rank[suffixes] = np.arange(n)
        a, b = np.minimum(suffixes[:-1], suffixes[1:]), np.maximum(suffixes[:-1], suffixes[1:])
        # Before the first and behind the last suffix nothing agrees.
        lcp = [0, *self.forwards(a, b).tolist(), 0]
        sa, rank_of = [*suffixes.tolist(), 0], rank.tolist()
        before, after = list(range(-1, n)), list(range(1, n + 2))
        lpf, source = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            r = rank_of[i]
            p, q = before[r], after[r]
            up, down = lcp[r], lcp[q]
            if up >= down:
                lpf[i], source[i], lcp[q] = up, sa[p], down
            else:
                lpf[i], source[i], lcp[q] = down, sa[q], up
            before[q], after[p] = p, q
        return lpf, source


def _ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number its index, so many times, and beside it 1, 2, ... up to the number."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def _across(blocks: _Blocks, borders: np.ndarray, left: np.ndarray, right: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs of two periods or more that touch a border between LZ blocks of these sizes."""
    of, p = _ranges(right)
    u, v = [borders[of]], [borders[of] + p]
    of, p = _ranges(np.minimum(2 * left + right, borders - starts))
    u, v = np.concatenate([*u, borders[of] - p]), np.concatenate([*v, borders[of]])
    words = blocks.levels[0]
    behind = (u > 0) & (words[np.maximum(u, 1) - 1] == words[np.maximum(v, 1) - 1])
    some = (words[u] == words[v]) | behind
    u, v = u[some], v[some]
    back, on, p = blocks.backwards(u, v), blocks.forwards(u, v), v - u
    reached = back + on >= p
    found = np.stack([(u - back)[reached], (v + on)[reached], p[reached]], axis=1)
    found = found[np.lexsort(found.T[::-1])]
    # A multiple of a period spans the same words: the smallest is the run's.
    distinct = np.ones(len(found), bool)
    distinct[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[distinct]


def _copied(buckets: dict[int, list], factors: list[tuple[int, int, int]]) -> None:
    """Add the runs strictly inside LZ blocks (start, size, source) to the buckets by start."""
    for start, size, source in factors:
        away, end = start - source, start + size
        for x in range(start + 1, end):
            for e, p in buckets.get(x - away, ()):
                if e + away < end:
                    buckets.setdefault(x, []).append((e + away, p))


def runs_of(texts: list[list[int]]) -> list[list[Run]]:
    """The runs (start, length, period) of each text, a list of word numbers, by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    blocks = _Blocks(np.concatenate([np.asarray(texts[k], np.int64) for k in full]), np.cumsum(sizes[full]))
    lpf, source = blocks.previous_factors() if len(blocks.start) else ([], [])
    factors: list[list[tuple[int, int, int]]] = []
    rows: list[tuple[int, int, int, int]] = []
    at = 0
    for k in blocks.texts.tolist():
        begin, end = at, at + int(sizes[full[k]])
        mine, before = [], 0
        while at < end:
            size = max(1, lpf[at])
            rows.append((at, before, size, begin))
            mine.append((at, size, source[at]))
            at, before = at + size, size
        rows.append((end, before, 0, begin))
        factors.append(mine)
    if not rows:
        return out
    found = _across(blocks, *np.array(rows, np.int64).T)
    texts_at = np.append(0, np.cumsum(sizes[full[blocks.texts]]))
    for k, some in zip(blocks.texts.tolist(), np.split(found, np.searchsorted(found[:, 0], texts_at[1:-1])), strict=True):
        if not len(some):
            factors.pop(0)
            continue
        buckets: dict[int, list] = {}
        for s, e, p in some.tolist():
            buckets.setdefault(s, []).append((e, p))
        _copied(buckets, factors.pop(0))
        begin = int(blocks.start[some[0, 0]])
        out[full[k]] = sorted((s - begin, e - s, p) for s, ends in buckets.items() for e, p in ends if e - s >= max(MIN_LENGTH, MIN_PERIODS * p))
        out[full[k]].sort(key=lambda r: (r[0], r[2]))
    return out


def _result(doc_id: str | None, words: list[bytes], runs: list[Run]) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period = best or (None, None, None)
    if runs:
        gone = bytearray(len(words))
        for s, n, q in runs:
            gone[s + q : s + n] = b"\1" * (n - q)
        words = [w for w, x in zip(words, gone, strict=True) if not x]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    text = b" ".join(words)
    return doc_id, len(runs), start, length, period, length and 1000 * length // period, hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest(), text


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]


def _judged(held: list[tuple[str | None, list[bytes]]]) -> pd.DataFrame:
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    runs = runs_of([list(map(ids.__getitem__, words)) for _, words in held])
    out = pd.DataFrame([_result(d, words, r) for (d, words), r in zip(held, runs, strict=True)], columns=COLUMNS)
    return out.astype(dict.fromkeys(COLUMNS[2:6], "Int64"))


def _run_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            words = altered(None if doc_id is None else int(doc_id), (text or "").encode("utf-8", "surrogatepass").split())
            held.append((doc_id, words))
            n += len(words)
            if n >= BATCH:
                yield _judged(held)
                held, n = [], 0
    if held:
        yield _judged(held)


def periodic_runs(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """A row for each row of docs (doc_id, text): number of runs, the longest one, digests, and the text without repeats.

    with_text: False leaves out ``collapsed``. Other columns of docs are left out.
    """
    # Ids travel as strings: beside a null, pandas would make floats of them.
    source = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string"))
    schema = "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if with_text:
        out = source.mapInPandas(_run_rows, f"{schema}, collapsed binary").withColumn("collapsed", F.decode("collapsed", "UTF-8"))
    else:
        out = source.mapInPandas(lambda batches: (x.drop(columns="collapsed") for x in _run_rows(batches)), schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
