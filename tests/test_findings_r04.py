"""What the findings of round four asked for, on small fixtures."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pagequarry.operators import clusters, packed_pairs
from pagequarry.plans import registry


def met(rows):
    """Shared urls of each pair of keywords."""
    urls = {}
    for k, u in rows:
        if k is not None and u is not None:
            urls.setdefault(u, set()).add(k)
    return dict(Counter(pair for ks in urls.values() for pair in itertools.combinations(sorted(ks), 2)))


def test_pairs_of_numbers_are_not_shuffled_as_rows(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(-40, 40), rng.randrange(60)) for _ in range(900)] + [(None, 1), (3, None)]
    got = clusters.result_overlap(spark.createDataFrame(rows, "keyword long, url long"))
    assert {(r.k1, r.k2): r.shared for r in got.collect()} == met(rows)
    exchanges = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert exchanges and all("task#" in x and "k1#" not in x for x in exchanges)


def test_frequent_urls_and_keywords_with_many_pairs(spark, monkeypatch):
    """Lists of four keywords, tasks of 400 pairs: the url 0 has 40 lists, keyword 0 is on every url, and its pairs are spread."""
    monkeypatch.setattr(clusters, "PAIR_BLOCK", 4)
    monkeypatch.setattr(clusters, "TASK_PAIRS", 400)
    rng = random.Random(7)
    rows = [(k, 0) for k in range(160)] + [(0, u) for u in range(80)] + [(rng.randrange(200), rng.randrange(80)) for _ in range(400)]
    rows += [(k, 100) for k in range(8)] + [(k, 101) for k in range(9)]
    got = clusters.result_overlap(spark.createDataFrame(rows * 2, "keyword int, url long"))
    assert dict(got.dtypes) == {"k1": "int", "k2": "int", "shared": "bigint", "band": "string"}
    found = got.collect()
    assert len(found) == len({(r.k1, r.k2) for r in found}) and {(r.k1, r.k2): r.shared for r in found} == met(rows)
    least = clusters.result_overlap(spark.createDataFrame(rows, "keyword int, url long"), least=2)
    assert {(r.k1, r.k2): r.shared for r in least.collect()} == {p: n for p, n in met(rows).items() if n > 1}


def lists(rows):
    by = {}
    for k, u in set(rows):
        by.setdefault(u, []).append(k)
    xs = [sorted(ks, reverse=True) for ks in by.values()]
    return pa.record_batch([pa.array(xs, pa.list_(pa.int64())), pa.nulls(len(xs), pa.list_(pa.int64()))], ["xs", "ys"])


def test_packed_pairs_are_small_and_whole(monkeypatch):
    """Lists as of the larger tables: 30 of 60,000 keywords a url, 200 tasks; before, a pair was a row of ten bytes."""
    rng = np.random.default_rng(2)
    rows = [(int(k), u) for u in range(4000) for k in rng.choice(60_000, 30, replace=False)]
    batch = lists(rows)
    packed = list(packed_pairs.pack([batch], 200, 1))
    assert sum(len(p) for b in packed for p in b.column("packed").to_pylist()) < 2 * 4000 * 435
    for split in (1, 3):
        for at_once in (packed_pairs.PAIRS_AT_ONCE, 5000):
            monkeypatch.setattr(packed_pairs, "PAIRS_AT_ONCE", at_once)
            few = batch.slice(0, 300)
            by = {}
            for b in packed_pairs.pack([few.slice(0, 100), few.slice(100)], 7, split):
                for k, task in enumerate(b.column("task").to_pylist()):
                    by.setdefault(task, []).append(b.slice(k, 1))
            parts = {t: pa.Table.from_batches(list(packed_pairs.count(iter(bs), 1000, 1))) for t, bs in by.items()}
            got = [r for t in parts.values() for r in zip(*(c.to_pylist() for c in t.columns), strict=True)]
            wanted = met([(k, u) for u, ks in enumerate(few.column("xs").to_pylist()) for k in ks])
            assert len(got) == len(wanted) and {(a, b): n for a, b, n in got} == wanted and set(parts) == set(range(7))
            assert all(t.to_pylist() == sorted(t.to_pylist(), key=lambda r: (r["k1"], r["k2"])) for t in parts.values())


def test_packed_pairs_of_the_farthest_numbers():
    rows = [(k, u) for u in range(3) for k in (-(2**63), 2**63 - 1, 0, -1, 2**62, 5 + u)]
    got = pa.Table.from_batches(list(packed_pairs.count(packed_pairs.pack([lists(rows)], 1, 1), 10, 1)))
    assert {(r["k1"], r["k2"]): r["shared"] for r in got.to_pylist()} == met(rows)
    assert list(packed_pairs.count(packed_pairs.pack([lists([(1, 1), (2, 2)])], 4, 1), 10, 1)) == []


def test_both_names_of_the_overlap_keep_its_pairs_packed(spark):
    for name in ("j15_result_overlap", "j15_result_overlap_whole"):
        got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "packed#" in plan and "hashpartitioning(k1" not in plan
        found = [(r.k1, r.k2) for part in got.rdd.glom().collect() for r in part]
        assert len(set(found)) == len(found) > 0 and all(a < b for a, b in found)
