"""Spelling variants: words grouped under the frequent word one edit away.

1. ``word_counts`` (Arrow batches, numpy) takes the maximal runs of letters of every
   whole text, lower-cases A-Z, applies the contract's deletions and counts the
   results; each task sums as it goes and hands on partial counts, so that a word
   of every document is a few rows.
2. ``candidates`` generates the full neighbourhood of each word: all distinct deletions,
   replacements and insertions over the observed alphabet, as rolling hashes (a candidate's
   hash is made from the word's prefix hashes in a few operations). A Bloom filter of the
   vocabulary, of at most ``FILTER_BITS`` bits whatever the vocabulary's size, drops most of
   those that are no words; the rest is spelled out.
3. A hash join of the spelled candidates with the vocabulary leaves the near words. A
   candidate is one edit away by construction, so no distance is verified; the join compares
   whole strings, so the filter can only let too many through, never lose one.
4. A word's form is its near word of largest n, and roots come from pointer doubling over
   the forms (n at least doubles at each step, so there are few rounds).

A null text has no words; a null doc_id is spelled ``null`` in the checksum. Repeated rows
count as often as they come. A word's neighbourhood is worked through in slices, so that
very long runs need no more memory than their own length. Without documents, or without
words frequent enough, the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written

#: A word has so many code points and so many occurrences at least.
MIN_LENGTH, MIN_COUNT = 5, 3
#: The runs whose checksum this divides lose a code point.
DIVISOR = 97
#: A form occurs so many times as often as the word at least.
FORM_FACTOR = 2
#: Bits of the vocabulary's filter at most (32 MB), and bits a word up to there.
FILTER_BITS, BITS_A_WORD, PROBES = 1 << 28, 32, 4
#: Candidates that are held at a time.
SLICE = 1 << 20
#: Words that a generating task gets, about, and distinct runs that a counting task holds.
TASK_WORDS, MOST_RUNS = 20_000, 300_000
#: Bytes of a ``bitmap_or_agg`` bitmap.
CHUNK = 4096

#: [A-Za-zÀ-ÿ]+ in UTF-8, after lower-casing A-Z.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Runs of up to so many bytes have their checksums made by tables.
_SHORT = 48


def _crc_table() -> np.ndarray:
    """The checksum register's step over a zero byte, by its low byte."""
    return np.array([zlib.crc32(b"\0", b) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


class _Counts:
    """Counts of the runs of a task. crc32(prefix + run) is crc32(run) XOR the prefix's checksum shifted by the run's bytes."""

    def __init__(self) -> None:
        self.table = _crc_table()
        self.clear()

    def clear(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.n = np.zeros(0, np.int64)
        self.changed: Counter[str] = Counter()
        self.runs: list[bytes] = []
        self.crc = np.zeros(0, np.uint32)
        self.bytes = np.zeros(0, np.int64)

    def add(self, starts: list[int], sizes: list[int], at: list[int]) -> None:
        """Runs of some documents: the prefixes' checksums, the numbers of runs, and the runs' ids one after the other."""
        new = list(self.ids)[len(self.runs) :] if len(self.ids) > len(self.runs) else []
        self.runs += new
        self.crc = np.append(self.crc, np.fromiter(map(zlib.crc32, new), np.uint32, len(new)))
        self.bytes = np.append(self.bytes, np.fromiter(map(len, new), np.int64, len(new)))
        ids = np.array(at, np.int64)
        self.n = np.append(self.n, np.zeros(len(new), np.int64)) + np.bincount(ids, minlength=len(self.runs))
        shifted = np.empty((_SHORT + 1, len(starts)), np.uint32)
        shifted[0] = starts
        for k in range(_SHORT):
            shifted[k + 1] = self.table[shifted[k] & np.uint32(255)] ^ (shifted[k] >> np.uint32(8))
        doc, size = np.repeat(np.arange(len(starts)), sizes), self.bytes[ids]
        h = self.crc[ids] ^ shifted[np.minimum(size, _SHORT), doc]
        for k in np.flatnonzero(size > _SHORT).tolist():
            h[k] = zlib.crc32(self.runs[at[k]], starts[doc[k]])
        for k in np.flatnonzero(h % np.uint32(DIVISOR) == 0).tolist():
            run = self.runs[at[k]].decode()
            i = int(h[k]) % len(run)
            self.n[at[k]] -= 1
            self.changed[run[:i] + run[i + 1 :]] += 1

    def taken(self) -> pd.DataFrame:
        """The counts so far, which start again."""
        words = [run.decode() for run in self.runs] + list(self.changed)
        out = pd.DataFrame({"word": words, "n": [*self.n.tolist(), *self.changed.values()]})
        self.clear()
        return out[(out["n"] > 0) & (out["word"].str.len() >= MIN_LENGTH)] if len(out) else out.astype({"word": str, "n": "int64"})


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = _Counts()
    for pdf in batches:
        starts, sizes, at = [], [], []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            runs = _RUN.findall((text or "").encode("utf-8", "surrogatepass").lower())
            starts.append(zlib.crc32(f"{doc_id}:".encode()))
            sizes.append(len(runs))
            at.extend(map(counts.ids.__getitem__, runs))
            if len(at) > SLICE or len(counts.ids) > MOST_RUNS:
                counts.add(starts, sizes, at)
                starts, sizes, at = [], [], []
                if len(counts.ids) > MOST_RUNS:
                    yield counts.taken()
        if starts:
            counts.add(starts, sizes, at)
    yield counts.taken()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of docs (doc_id, text): the words of MIN_LENGTH code points that occur MIN_COUNT times or more."""
    # Ids travel as strings: beside a null, pandas would make floats of them.
    source = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).alias("doc_id"), F.col("text").cast("string"))
    counted = source.mapInPandas(_count_rows, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _codes(words: list[str], code: dict[str, int]) -> np.ndarray:
    """The letters' numbers from 1, a row for each of the words, all of one length."""
    table = np.zeros(256, np.uint64)
    for c, k in code.items():
        table[ord(c)] = k
    return table[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(len(words), -1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _prefixes(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes: the sum of letter times BASE ** place, modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        sums = np.cumsum(codes * powers[None, : codes.shape[1]], axis=1, dtype=np.uint64)
    return np.concatenate([np.zeros((len(codes), 1), np.uint64), sums], axis=1)


def _probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The filter's bit of each hash for probe k; bits is a power of two."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(29))) * (_MIX + np.uint64(2 * k))
    return (x >> np.uint64(64 - int(bits).bit_length() + 1)).astype(np.int64)


class Filter:
    """A Bloom filter over the words' hashes."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(bits // 8, np.uint8) if data is None else data

    def add(self, h: np.ndarray) -> None:
        for k in range(PROBES):
            at = _probe(h, k, self.bits)
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes that may be words; each probe sees only what the one before let through."""
        left = np.arange(len(h))
        for k in range(PROBES):
            at = _probe(h[left], k, self.bits)
            left = left[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        return left


def _by_length(words: list[str]) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    yield from groups.values()


def neighbours(words: list[str], letters: str, known: Filter) -> tuple[list[str], list[str]]:
    """(words, candidates) of words of one length: the members of their full neighbourhoods that pass the filter."""
    code = {c: k + 1 for k, c in enumerate(letters)}
    n, a = len(words[0]), len(letters)
    x = np.arange(1, a + 1, dtype=np.uint64)
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    out_words: list[str] = []
    out: list[str] = []
    rows = max(1, SLICE // (n * a))
    for first in range(0, len(words), rows):
        some = words[first : first + rows]
        codes, powers = _codes(some, code), _powers(n + 1)
        before = _prefixes(codes, powers)
        whole = before[:, -1:]
        places = max(1, SLICE // (len(some) * a))
        for lo in range(0, n + 1, places):
            hi = min(lo + places, n)
            own, p = codes[:, lo:hi], powers[None, lo:hi]
            with np.errstate(over="ignore"):
                deleted = before[:, lo:hi] + (whole - before[:, lo + 1 : hi + 1]) * inverse
                replaced = (whole - own * p)[:, :, None] + (p[:, :, None] * x)
                end = min(lo + places, n + 1)
                inserted = (before[:, lo:end] + (whole - before[:, lo:end]) * np.uint64(_BASE))[:, :, None] + powers[None, lo:end, None] * x
            # Of a stretch of one letter the last deletion counts; a letter goes in before its equals, never after one.
            after = np.zeros(own.shape, bool)
            after[:, : min(hi, n - 1) - lo] = codes[:, lo : min(hi, n - 1)] == codes[:, lo + 1 : min(hi, n - 1) + 1]
            left = np.zeros((len(some), end - lo), np.uint64)
            left[:, max(0, 1 - lo) :] = codes[:, max(lo, 1) - 1 : end - 1]
            for kind, h, distinct in ((0, deleted, ~after), (1, replaced, own[:, :, None] != x), (2, inserted, left[:, :, None] != x)):
                at = np.flatnonzero(distinct)
                at = at[known.maybe(h.ravel()[at])]
                shape = h.shape if kind else (*h.shape, 1)
                for w, i, k in zip(*(v.tolist() for v in np.unravel_index(at, shape)), strict=True):
                    word, i = some[w], i + lo
                    out_words.append(word)
                    out.append(word[:i] + (letters[k] if kind else "") + word[i + (kind < 2) :])
    return out_words, out


def _filter_of(words: DataFrame, letters: str, n_words: int) -> Filter:
    """The filter of the vocabulary: each task makes one, they are united chunk by chunk, and the driver gets FILTER_BITS at most."""
    bits = min(FILTER_BITS, 1 << max(15, (n_words * BITS_A_WORD - 1).bit_length()))
    code = {c: k + 1 for k, c in enumerate(letters)}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = Filter(bits)
        for pdf in batches:
            for group in _by_length(pdf["word"].tolist()):
                mine.add(_prefixes(_codes(group, code), _powers(len(group[0]) + 1))[:, -1])
        chunks = mine.data.reshape(-1, CHUNK)
        used = np.flatnonzero(chunks.any(axis=1)).tolist()
        yield pd.DataFrame({"chunk": used, "bits": [chunks[k].tobytes() for k in used]}).astype({"chunk": "int64"})

    parts = words.select("word").mapInPandas(rows, "chunk long, bits binary").groupBy("chunk").agg(F.bitmap_or_agg("bits").alias("bits"))
    data = np.zeros((bits // 8 // CHUNK, CHUNK), np.uint8)
    for r in parts.toLocalIterator():
        data[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return Filter(bits, data.ravel())


def candidates(words: DataFrame) -> DataFrame:
    """(word, near) of a written table words (word): the neighbourhoods' members that the vocabulary's filter lets through."""
    n_words = words.count()
    # At most the 90 letters of the contract.
    letters = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()))
    shared = words.sparkSession.sparkContext.broadcast(_filter_of(words, letters, n_words).__dict__)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Filter(**shared.value)
        for pdf in batches:
            for group in _by_length(pdf["word"].tolist()):
                word, near = neighbours(group, letters, known)
                yield pd.DataFrame({"word": word, "near": near}, dtype=str)

    return words.select("word").repartition(max(1, -(-n_words // TASK_WORDS)), "word").mapInPandas(rows, "word string, near string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table forms (word, form): the end of each chain, by pointer doubling."""
    links = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        hop = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = links.join(hop, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        links = written(joined, "spelling-roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text); other columns are left out."""
    words = written(word_counts(docs), "spelling-words")
    near = candidates(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    larger = -F.col("best.order") >= F.col("n") * FORM_FACTOR
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(larger, F.col("best.near")).alias("form"), F.when(larger, -F.col("best.order")).alias("form_n"))
    judged = written(joined, "spelling-forms")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
