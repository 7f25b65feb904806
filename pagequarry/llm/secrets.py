"""Secret scans: base patterns, and character Markov models for strings of any form.

Two second-order models give the probability of a character after the two before
it: one of random strings, one of ordinary identifiers. Every maximal run of
``[A-Za-z0-9+/_-]`` of a text, whatever its length and wherever it stands, is scored
by its log-likelihood ratio, the sum over its characters; it is reported as kind
"random" where the sum passes the model's threshold, so short runs need stronger
evidence for each character than long ones. Up to two ``=`` at its end belong to
the span. A run that a base pattern covers is scored too: "random" beside "assign"
says that the value is no placeholder, a "hex" without it that it is a number.

The models are trained on labelled samples (``labelled_samples``). Labelled random are
the values that base patterns found in the sampled texts (numbers are ordinary), and
seeded strings over the usual alphabets of keys, ``random_samples`` in all at least.
Labelled ordinary are the other runs of these texts, and pairs of words joined as
identifiers are. The sample is bounded by ``sample_docs`` documents (those with the
smallest hashes) and ``runs_per_doc`` runs and values of each: bounds on fitting
alone, every text is scanned whole. A quarter of each label is held out; the
threshold lies ``MARGIN`` above the highest score of a held-out ordinary run, without
the share ``UNLABELLED`` of them that may be secrets which no pattern knows.

Nulls: a null text counts as empty; a null doc_id stays null. Spans are code points,
end exclusive; equal spans of different kinds are ordered assign, access, hex,
random. Repeated rows have equal spans; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_or_empty

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 16 or more: what the shorter runs would match is dropped anyway.
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS = 12, 18

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Number of the state between runs.
OUTSIDE = len(ALPHABET)
STATES = OUTSIDE + 1
#: Bounds of the training sample, and the number of random strings at least.
SAMPLE_DOCS = 2000
RUNS_PER_DOC = 200
RANDOM_SAMPLES = 4000
SEED = 11
#: Shares of contexts of two characters, of one, of none, and of chance in a probability; the last bounds what an unseen character can weigh.
SHARES = (0.6, 0.3, 0.05, 0.05)
#: Natural log-likelihood ratio between the held-out ordinary runs and the threshold.
MARGIN = math.log(1000)
UNLABELLED = 1e-5

_CODES = np.full(129, OUTSIDE, np.int64)
_CODES[[ord(c) for c in ALPHABET]] = np.arange(OUTSIDE)


class Model(NamedTuple):
    """Log ratios (random over ordinary) by two characters and the next, and the threshold of a run's sum."""

    table: np.ndarray
    threshold: float


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _states(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each code point of " " + text as a state, and its context (the two states before it; nothing before a run counts)."""
    points = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32)
    now = _CODES[np.minimum(points, 128)]
    last, before = np.full(len(now), OUTSIDE), np.full(len(now), OUTSIDE)
    last[1:], before[2:] = now[:-1], now[:-2]
    before[last == OUTSIDE] = OUTSIDE
    return now, last, before


def runs(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, sums of log ratios) of the maximal runs of a text."""
    now, last, before = _states(text)
    inside = now != OUTSIDE
    starts = np.flatnonzero(inside & (last == OUTSIDE))
    if not len(starts):
        return starts, starts, np.empty(0)
    sums = np.add.reduceat(np.where(inside, table[before, last, now], 0.0), starts)
    ends = np.flatnonzero(np.append(inside[:-1] & ~inside[1:], inside[-1])) + 1
    return starts - 1, ends - 1, sums


def log_probabilities(samples: list[str]) -> np.ndarray:
    """Log probability of a character after two others: the contexts' relative frequencies, mixed by SHARES."""
    now, last, before = _states(" ".join(samples))
    of = now != OUTSIDE
    triples = np.zeros((STATES, STATES, STATES))
    np.add.at(triples, (before[of], last[of], now[of]), 1.0)
    triples = triples[:, :, :OUTSIDE]  # OUTSIDE is never a next character
    single = np.bincount(now[of], minlength=STATES)[:OUTSIDE] + 1.0
    p0 = single / single.sum()
    pairs = triples.sum(axis=0)
    # One observation of the shorter context stands for contexts without any.
    p1 = (pairs + p0) / (pairs.sum(axis=1, keepdims=True) + 1)
    p2 = (triples + p1) / (triples.sum(axis=2, keepdims=True) + 1)
    out = np.zeros((STATES, STATES, STATES))
    out[:, :, :OUTSIDE] = np.log(SHARES[0] * p2 + SHARES[1] * p1 + SHARES[2] * p0 + SHARES[3] / OUTSIDE)
    return out


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, runs_per_doc: int = RUNS_PER_DOC, random_samples: int = RANDOM_SAMPLES, seed: int = SEED) -> tuple[list[str], list[str]]:
    """(random, ordinary) strings from a bounded sample of texts and from the generators, in a fixed order."""
    hashed = docs.select(text_or_empty().alias("text")).withColumn("h", F.xxhash64(F.lit(seed), "text"))
    smallest = hashed.select("h").distinct().orderBy("h").limit(sample_docs).collect()
    last = smallest[-1]["h"] if smallest else 0
    base = "|".join((rf"(?:{ASSIGN.pattern})".replace("(password", "(?i:password").replace("([A-Za-z0-9+/_.=-]+)", "(?:[A-Za-z0-9+/_.=-]+)"), ACCESS.pattern, HEX.pattern))
    text = F.col("text")
    found = F.slice(F.regexp_extract_all(text, F.lit(base), F.lit(0)), 1, runs_per_doc)
    words = F.slice(F.regexp_extract_all(F.regexp_replace(text, F.lit(base), F.lit(" ")), F.lit(r"[A-Za-z0-9+/_-]+"), F.lit(0)), 1, runs_per_doc)
    sample = hashed.where(F.col("h") <= last).dropDuplicates(["h"])
    rows = sample.select("h", words.alias("words"), found.alias("found")).collect()
    rows.sort(key=lambda r: r["h"])
    rng = random.Random(seed)
    values = [re.split(r"[\"'\x20:=]+", x.rstrip("="))[-1] for r in rows for x in r["found"]]
    random_ = [v for v in values if len(v) >= MIN_ASSIGN and not v.isdigit()]
    ordinary = [v for v in values if v.isdigit()]
    alphabets = (ALPHABET[:64], ALPHABET[:62], "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:26] + "0123456789")
    while len(random_) < random_samples:
        letters = rng.choice(alphabets)
        random_.append("".join(rng.choice(letters) for _ in range(rng.randint(16, 48))))
    for r in rows:
        ws = list(r["words"])
        ordinary += ws
        for a, b in zip(ws[::2], ws[1::2], strict=False):
            ordinary.append(rng.choice((a + "_" + b, a + b.capitalize(), a + "-" + b, a + "/" + b, a.upper() + "_" + b.upper(), f"{a}_{rng.randint(0, 99)}", f"{a}{rng.randint(1900, 2100)}-{b}")))
    return random_, ordinary


def fit(random_: list[str], ordinary: list[str], seed: int = SEED) -> Model:
    """The model of three quarters of the labelled strings, its threshold from the others. Without ordinary strings nothing passes."""
    order = random.Random(seed)
    fitted: list[str] = []
    held: list[str] = []
    for x in ordinary:
        (held if order.random() < 0.25 else fitted).append(x)
    table = log_probabilities([x for x in random_ if order.random() >= 0.25]) - log_probabilities(fitted)
    sums = np.sort(runs(" ".join(held), table)[2])
    highest = sums[: len(sums) - int(len(sums) * UNLABELLED)]
    return Model(table.astype(np.float32), float(max(highest[-1], 0.0) + MARGIN) if len(highest) else math.inf)


def train(docs: DataFrame, **bounds: int) -> Model:
    """The model of a table of texts; ``bounds`` are those of ``labelled_samples``."""
    return fit(*labelled_samples(docs, **bounds), seed=bounds.get("seed", SEED))


def scan(text: str, model: Model) -> tuple[list, list]:
    """(base matches, all spans) of a text, each (start, kind number, end)."""
    base = base_matches(text)
    starts, ends, sums = runs(text, model.table)
    added = []
    for k in np.flatnonzero(sums > model.threshold).tolist():
        start, end = int(starts[k]), int(ends[k])
        added.append((start, 3, end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))))
    return base, sorted(base + added)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans) of each row of docs (doc_id, text); other columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                base, spans = scan(text or "", shared.value)
                kinds = [k for _, k, _ in spans]
                out.append((doc_id, *(kinds.count(k) for k in range(4)), _joined(base), _joined(spans)))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans"])

    # Ids travel as strings: beside a null, pandas would make floats of them.
    source = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string"))
    found = source.mapInPandas(rows, "doc_id string, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
