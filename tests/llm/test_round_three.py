"""Spelling variants, periodic runs and decontamination against brute-force versions, with the edge cases of each."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagequarry.llm import decontaminate, periodic_runs, spelling

DOCS = "doc_id long, text string, n long, word string, items string, start long"


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, 1, "x", "y", 2) for d, t in rows], DOCS)


# --- spelling variants


def brute_counts(rows):
    total = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_counts(rows)
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


@pytest.fixture(scope="module")
def spelled():
    r = random.Random(4)
    stems = ["color", "hello", "cafés", "aaaaa", "rÉsum", "banana", "winters"]
    rows = []
    for d in range(60):
        out = []
        for _ in range(60):
            w = r.choice(stems)
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                i = r.randrange(len(w) + 1)
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcoé") + w[i + 1 :], w[:i] + r.choice("abcoé") + w[i:]])
            out.append(w.upper() if r.random() < 0.1 else w)
        rows.append((d, r.choice([" ", "-", "1", "Ж"]).join(out)))
    long_ = "ab" * 300
    return [*rows, (None, "hello hello color"), (60, None), (61, ""), (62, "   "), (3, rows[3][1]), (3, rows[3][1]), (63, f"{long_} {long_} {long_} {long_}c {long_}c {long_}c {long_[1:]} {long_[1:]} {long_[1:]}")]


def test_spelling_variants_match_brute_force(spark, spelled):
    found = spelling.spelling_variants(docs_of(spark, spelled))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = found.collect()
    assert len(rows) == len({r.word for r in rows})
    assert {tuple(r) for r in rows} == brute_variants(spelled)
    assert any(r.root not in (r.word, r.form) for r in rows)


def test_spelling_of_nothing(spark):
    for rows in ([], [(1, None), (2, ""), (3, "one two")]):
        assert spelling.spelling_variants(docs_of(spark, rows)).collect() == []


def test_counting_in_small_pieces_changes_nothing(spark, spelled, monkeypatch):
    import pandas as pd

    whole = pd.DataFrame([(str(d) if d is not None else "null", t) for d, t in spelled], columns=["doc_id", "text"])
    monkeypatch.setattr(spelling, "MOST_RUNS", 20)
    monkeypatch.setattr(spelling, "SLICE", 50)
    got = Counter()
    for part in spelling._count_rows(iter([whole[:7], whole[7:]])):
        for w, n in zip(part["word"], part["n"], strict=True):
            got[w] += n
    assert {w: n for w, n in got.items() if n >= 3} == brute_counts(spelled)


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_neighbourhood_is_whole_and_distinct(monkeypatch, step):
    class All:
        def maybe(self, h):
            return np.arange(len(h))

    class Hashes:
        """Keeps the hashes, to hold them against those of the spelled candidates."""

        def __init__(self):
            self.seen = []

        def maybe(self, h):
            self.seen += h.tolist()
            return np.arange(len(h))

    monkeypatch.setattr(spelling, "SLICE", step)
    letters = "abcé"
    for word in ("aabba", "abcab", "ccccc", "éabca"):
        want = {word[:i] + word[i + 1 :] for i in range(5)} | {word[:i] + c + word[i + 1 :] for i in range(5) for c in letters} - {word}
        want |= {word[:i] + c + word[i:] for i in range(6) for c in letters}
        _, got = spelling.neighbours([word], letters, All())
        assert len(got) == len(set(got)) and set(got) == want
    hashes = Hashes()
    words, got = spelling.neighbours(["aabba", "abcab"], letters, hashes)
    code = {c: k + 1 for k, c in enumerate(letters)}
    made = [int(spelling._prefixes(spelling._codes([w], code), spelling._powers(8))[0, -1]) for w in got]
    assert sorted(made) == sorted(hashes.seen)


def test_filter_loses_nothing_when_it_is_full(spark, spelled, monkeypatch):
    monkeypatch.setattr(spelling, "FILTER_BITS", 1 << 15)
    monkeypatch.setattr(spelling, "TASK_WORDS", 10)
    assert {tuple(r) for r in spelling.spelling_variants(docs_of(spark, spelled)).collect()} == brute_variants(spelled)


# --- periodic runs


def brute_runs(t):
    n, best = len(t), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            if j - i >= q:
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in best.items() if e - s >= max(6, 4 * q)), key=lambda r: (r[0], r[2]))


def brute_row(d, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if d is not None and n and zlib.crc32(str(d).encode()) % 10 == 0:
        g = zlib.crc32(str(d).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return d, len(runs), s, m, q, m and 1000 * m // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(left), left


@pytest.fixture(scope="module")
def repeated():
    r = random.Random(8)
    rows = []
    for d in range(150):
        t = [f"w{r.randrange(r.choice([1, 2, 3, 40]))}" for _ in range(r.choice([0, 1, 5, 6, 30, 120]))]
        if t and r.random() < 0.5:
            a, p = r.randrange(len(t)), r.randrange(1, 7)
            t = t[:a] + t[a : a + p] * r.randrange(2, 9) + t[a:]
        rows.append((d, r.choice([" ", "\n", " \t "]).join(t)))
    return [*rows, (None, "a b " * 9), (None, None), (500, None), (501, ""), (502, " \n "), (3, rows[3][1]), (3, rows[3][1]), (503, "x" * 50_000), (504, "u " * 30_000), (505, "é y " * 8)]


def test_periodic_runs_match_brute_force(spark, repeated):
    found = periodic_runs.periodic_runs(docs_of(spark, repeated))
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted((brute_row(d, t) for d, t in repeated), key=str)
    short = periodic_runs.periodic_runs(docs_of(spark, repeated), with_text=False)
    assert short.columns == found.columns[:-1]
    assert sorted((tuple(r) for r in short.collect()), key=str) == sorted((x[:-1] for x in got), key=str)


def test_periodic_runs_of_small_alphabets():
    r = random.Random(2)
    for _ in range(150):
        texts = [[r.randrange(k) for _ in range(r.choice([0, 3, 9, 50, 90]))] for k in (1, 2, 2, 3, 4)]
        texts = [t + t[a : a + 5] * b for t in texts for a, b in ((r.randrange(len(t) + 1), r.randrange(9)),)]
        assert periodic_runs.runs_of(texts) == [brute_runs(t) for t in texts]


def test_batches_of_one_text_change_nothing(spark, repeated, monkeypatch):
    import pandas as pd

    pdf = pd.DataFrame([(None if d is None else str(d), t) for d, t in repeated], columns=["doc_id", "text"], dtype=object)
    whole = pd.concat(periodic_runs._run_rows(iter([pdf])))
    monkeypatch.setattr(periodic_runs, "BATCH", 1)
    assert pd.concat(periodic_runs._run_rows(iter([pdf]))).reset_index(drop=True).equals(whole.reset_index(drop=True))


def test_periodic_runs_of_an_empty_table(spark):
    assert periodic_runs.periodic_runs(docs_of(spark, [])).collect() == []


# --- decontamination


def leak_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_leaks(docs, items):
    wins = {}
    for item, t in items:
        w = leak_words(t)
        for i in range(max(len(w) - 9, 1) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for d, t in docs:
        w, hit, got = leak_words(t), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in wins:
                    hit |= set(range(i, i + size))
                    got |= wins[x]
        out.append((d, len(w), len(hit), tuple(sorted(str(x) for x in got if x is not None)), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaks():
    r = random.Random(6)
    word = lambda: r.choice(["Ab", "the", "of", "x1", "Été", "zoo", *(f"q{r.randrange(300)}" for _ in range(3))])
    items = [(k, " ".join(word() for _ in range(r.choice([1, 2, 4, 5, 7, 9, 10, 11, 40])))) for k in range(40)]
    items += [(40, items[3][1]), (3, "another text of item three with more than ten words in it all"), (None, "a null id still marks these ten words of it here"), (41, None), (42, ""), (43, "?!"), (44, "the the the the the the the the the the the the")]
    docs = []
    for d in range(80):
        t = [word() for _ in range(r.choice([0, 3, 30, 90]))]
        for _ in range(r.randrange(3)):
            w = leak_words(r.choice(items)[1])
            a = r.randrange(len(t) + 1)
            b = r.randrange(len(w) + 1) if r.random() < 0.3 else 0
            t[a:a] = w[b : b + r.choice([3, 10, 14, 50])]
        docs.append((d, r.choice([" ", "... ", "\n"]).join(t)))
    docs += [(None, items[0][1]), (None, None), (90, None), (91, ""), (92, ".,"), (5, docs[5][1]), (5, docs[5][1]), (93, "the " * 5000), (94, "!" + items[20][1].upper() + "!"), (95, items[-1][1])]
    return docs, items


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 0])
def test_leaks_match_brute_force(spark, leaks, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    docs, items = leaks
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in items], "item_id long, text string, window string, size int")
    rows = decontaminate.find_leaks(docs_of(spark, docs), table).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in rows), key=str)
    assert got == brute_leaks(docs, items)
    assert any(x[4] for x in got) and not all(x[4] for x in got)


def test_leaks_of_empty_tables(spark, leaks):
    docs, items = leaks
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contaminated and r["items"] == [] for r in decontaminate.find_leaks(docs_of(spark, docs[:9]), none).collect())
    assert decontaminate.find_leaks(docs_of(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []
