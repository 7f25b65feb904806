"""Sequences, sets, graphs, places and stores on small fixtures, against brute-force versions."""

import datetime
import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import asof, clusters, links, locales, paged, quantiles, reuse
from pagequarry.sources import places, snapshot_table, web_graph


def test_page_reuse_matches_brute_force(spark):
    r = random.Random(1)
    word = lambda: r.choice(["a", "b", "the", *(f"w{r.randrange(40)}" for _ in range(4))])
    shared = [[word() for _ in range(n)] for n in (4, 9, 30)]
    texts = {}
    for p in range(40):
        t = [word() for _ in range(r.choice([0, 2, 5, 30]))]
        for s in shared:
            if r.random() < 0.4:
                a = r.randrange(len(t) + 1)
                t[a:a] = s
        texts[p] = t
    texts[40] = texts[7]
    rows = [(p, r.choice([" ", ", ", "\n"]).join(t)) for p, t in texts.items()] + [(41, None), (42, "")]
    got = {x.page_id: x for x in reuse.page_reuse(spark.createDataFrame(rows, "page_id long, text string"), width=4).collect()}
    owners = {}
    for p, t in texts.items():
        for i in range(len(t) - 3):
            owners.setdefault(tuple(t[i : i + 4]), set()).add(p)
    assert len(got) == len(rows)
    for p, t in {**texts, 41: [], 42: []}.items():
        covered, sources = set(), {}
        for i in range(len(t) - 3):
            others = owners[tuple(t[i : i + 4])] - {p}
            if others:
                covered |= set(range(i, i + 4))
                sources[min(others)] = sources.get(min(others), 0) + 1
        best = min(sources, key=lambda s: (-sources[s], s), default=None)
        assert (got[p].words, got[p].shared_words, got[p].best_source, got[p].source_windows) == (len(t), len(covered), best, sources.get(best))
        assert got[p].near_duplicate == (bool(t) and 100 * len(covered) >= 80 * len(t))


def test_plain_text(spark):
    html = "<p>One<!-- no --> two</p><script>var a = '<b>';</script><STYLE>p{}</STYLE><b>three</b>"
    assert spark.createDataFrame([(html,)], "h string").select(reuse.plain_text(F.col("h"))).first()[0].split() == ["One", "two", "three"]


@pytest.mark.parametrize("stretch", ["1 day", "1 hour", "1000 days"])
def test_as_of_join_matches_brute_force(spark, stretch):
    r = random.Random(2)
    day = datetime.datetime(2024, 1, 1)
    time = lambda: day + datetime.timedelta(minutes=r.choice([r.randrange(20_000), 60 * r.randrange(300)]))
    left = [(i, r.choice([1, 1, 1, 2, 3, None]), r.choice([time(), time(), None]) if i % 9 == 0 else time(), "x") for i in range(300)]
    right = [(i, r.choice([1, 1, 2, 4, None]), time() if i % 11 else None, i * 2) for i in range(200)]
    a = spark.createDataFrame(left, "id long, k long, t timestamp, value string")
    b = spark.createDataFrame(right, "n long, k long, ts timestamp, value long")
    got = {x.id: x for x in asof.as_of_join(a, b, "k", "t", "ts", ["n", "value"], "n", stretch).collect()}
    near = {x.id: x.n for x in asof.as_of_join(a, b, "k", "t", "ts", ["n"], "n", stretch, tolerance="2 hours").collect()}
    assert len(got) == len(left)
    for i, k, t, _ in left:
        found = max(((ts, n, v) for n, k2, ts, v in right if k is not None and k2 == k and ts and t and ts <= t), default=None)
        assert (got[i].n, got[i].right_value, got[i].value) == ((found[1], found[2], "x") if found else (None, None, "x"))
        assert near[i] == (found[1] if found and t - found[0] <= datetime.timedelta(hours=2) else None)
    assert asof.as_of_join(a, b.limit(0), "k", "t", "ts", ["n"], "n").where("n is not null").isEmpty()


def depths(start, edges):
    out, front = dict.fromkeys(start, 0), list(start)
    for d in itertools.count(1):
        front = [b for a, b in edges if a in set(front) and b not in out and not out.update({b: d})]
        if not front:
            return out


def test_clicks_on_chains_rings_and_random_graphs(spark):
    r = random.Random(3)
    chain = [(i, i + 1) for i in range(1000)]
    ring = [(2000, 2001), (2001, 2002), (2002, 2000)]
    random_ = [(5000 + r.randrange(60), 5000 + r.randrange(60)) for _ in range(90)]
    tails = [(500, 3000), *((3000 + i, 3001 + i) for i in range(40)), (3040, 5000), (5007, 5007), (10, 990)]
    edges = chain + ring + random_ + tails
    got = links.clicks_from(spark.createDataFrame([(0,), (None,)], "node long"), spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {x.node: x.clicks for x in got} == depths([0], edges) and len(got) == len({x.node for x in got})
    near = links.clicks_from(spark.createDataFrame([(0,), (3000,)], "node long"), spark.createDataFrame(edges, "src long, dst long"), 12).collect()
    assert {x.node: x.clicks for x in near} == {k: v for k, v in depths([0, 3000], edges).items() if v <= 12}
    assert [tuple(x) for x in links.clicks_from(spark.createDataFrame([(7,)], "node long"), spark.createDataFrame([], "src long, dst long")).collect()] == [(7, 0)]


def test_snapshot_store_is_read_without_a_shuffle(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("p"), (F.col("id") % 40).cast("string")).alias("url_hash"), "id", (F.col("id") * 7 % 11).alias("title"))
    spark.sql("DROP TABLE IF EXISTS store_a")
    spark.sql("DROP TABLE IF EXISTS store_b")
    snapshot_table.create_store(rows.where("id < 300"), "store_a", str(tmp_path), 4)
    snapshot_table.create_store(rows.where("id < 200"), "store_b", str(tmp_path), 4)
    for lo, hi in ((300, 350), (350, 400)):
        snapshot_table.append(rows.where(f"id >= {lo} and id < {hi}"), "store_a")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    newest = {x.url_hash: x.id for x in snapshot_table.latest(spark, "store_a").collect()}
    assert newest == {f"p{k}": 360 + k for k in range(40)}
    assert {x.url_hash: x.id for x in snapshot_table.as_of(spark, "store_a", 250).collect()} == {f"p{k}": 240 + k if k <= 10 else 200 + k for k in range(40)}
    want = {(f"p{k}", (160 + k) * 7 % 11, (360 + k) * 7 % 11) for k in range(40)}
    for _ in range(2):
        for df in (snapshot_table.latest(spark, "store_a"), snapshot_table.as_of(spark, "store_a", 250), snapshot_table.changes(spark, "store_b", "store_a", "title")):
            assert "Exchange" not in plan(df)
        assert {tuple(x) for x in snapshot_table.changes(spark, "store_b", "store_a", "title").collect()} == {x for x in want if x[1] != x[2]}
        snapshot_table.compact(spark, "store_a", keep=2)
    assert len(spark.table("store_a").inputFiles()) == 4 and spark.table("store_a").count() == 80
    assert {x.url_hash: x.id for x in snapshot_table.latest(spark, "store_a").collect()} == newest


@pytest.mark.parametrize("most", [10**6, 40, 1])
def test_percentiles_are_exact(spark, most):
    r = random.Random(4)
    groups = {"flat": [float(r.randrange(10**6)) for _ in range(700)], "ties": [1.0] * 300 + [2.0] * 300 + [1.5], "one": [7.25], "same": [3.0] * 200, "few": [float(r.randrange(3)) for _ in range(400)], None: [r.gauss(0, 1) for _ in range(90)], "skew": [1.0] * 500 + [float(x) for x in range(100)]}
    rows = [(g, 1, v) for g, vs in groups.items() for v in vs] + [("none", 1, None), ("flat", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {x.g: x.q for x in quantiles.exact_percentiles(df, ["g", "h"], "v", shares, most).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        vs = sorted(vs)
        for s, q in zip(shares, got[g], strict=True):
            spot = (len(vs) - 1) * s
            want = vs[math.floor(spot)] + (vs[math.ceil(spot)] - vs[math.floor(spot)]) * (spot - math.floor(spot))
            assert q == pytest.approx(want, abs=1e-9)
    assert quantiles.exact_percentiles(df.where("v is not null and g = 'flat'"), [], "v", [0.5], most).first().q[0] == pytest.approx(statistics.median(groups["flat"]))
    assert quantiles.exact_percentiles(df.limit(0), ["g"], "v", [0.5], most).collect() == []


def test_places_from_saved_responses(spark):
    node = lambda i, lat, lon, tags="null": f'{{"type":"node","id":{i},"lat":{lat},"lon":{lon},"tags":{tags}}}'
    square = [node(1, 50, 179.999), node(2, 50, -179.999), node(3, 50.001, -179.999), node(4, 50.001, 179.999)]
    ways = ['{"type":"way","id":1,"nodes":[1,2,3,4,1],"tags":{"amenity":"cafe","name":"Ring","addr:city":"X"}}', '{"type":"way","id":2,"nodes":[1,2,99],"tags":{"shop":"car"}}', '{"type":"way","id":3,"nodes":[98],"tags":{"shop":"car"}}', '{"type":"way","id":4,"nodes":[1,2],"tags":{"highway":"path"}}']
    named = [node(5, 50.0005, 179.9995, '{"amenity":"bar","name":"Dot"}'), node(6, -89.99, 5, '{"tourism":"hotel"}'), node(7, -89.99, -175, '{"office":"lawyer"}')]
    bodies = ['{"elements":[' + ",".join(square + ways[:2]) + "]}", '{"elements":[' + ",".join([*named, node(5, 50.0005, 179.9995), *ways[2:]]) + "]}", "no json", None, "{}"]
    found = places.places(places.elements(spark.createDataFrame([(b,) for b in bodies], "body string")))
    rows = {x.place: x for x in found.collect()}
    assert rows.keys() == {"way/1", "way/2", "node/5", "node/6", "node/7"}
    assert (rows["way/1"].lat, abs(rows["way/1"].lng)) == (pytest.approx(50.0005), pytest.approx(180)) and rows["way/1"].city == "X" and rows["node/5"].category == "amenity=bar"
    assert (rows["way/2"].lat, abs(rows["way/2"].lng)) == (pytest.approx(50), pytest.approx(180))
    centres = spark.createDataFrame([("a", 50.0005, -179.9999), ("pole", -90.0, 0.0)], "centre string, lat double, lng double")
    assert {(x.centre, x.place) for x in places.near(found, centres, 2.0).collect()} == {("a", "way/1"), ("a", "way/2"), ("a", "node/5"), ("pole", "node/6"), ("pole", "node/7")}
    assert {x.place for x in places.near(found, centres, 2.0, ["amenity=bar"]).collect()} == {"node/5"}
    assert {x.place for x in places.in_box(found, 49, 179, 51, -179).collect()} == {"way/1", "way/2", "node/5"}
    assert {x.place for x in places.in_box(found, -90, 0, 0, 10).collect()} == {"node/6"}


@pytest.mark.parametrize("radius", [30.0, 900.0, 12_000.0, 25_000.0])
def test_radius_join_over_the_whole_globe(spark, radius):
    r = random.Random(5)
    point = lambda: (r.choice([-90.0, 90.0, 89.999, -89.99, r.uniform(-90, 90)]), r.choice([180.0, -180.0, 179.99, -179.99, r.uniform(-180, 180)]))
    cs, ps = [(i, *point()) for i in range(25)], [(i, *point()) for i in range(60)]
    got = clusters.within_radius(spark.createDataFrame(cs, "centre long, lat double, lng double"), spark.createDataFrame(ps, "place long, lat double, lng double"), radius).collect()

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    assert {(x.centre, x.place) for x in got} == {(c[0], p[0]) for c in cs for p in ps if round(km(c, p), 6) <= radius}
    assert len(got) == len({(x.centre, x.place) for x in got})


def test_alternate_sets(spark):
    full = lambda pages: [(a, lang, b) for a, _ in pages for b, lang in pages]
    good = [("https://a/en", "en"), ("https://a/de", "de-AT"), ("https://a/zh", "zh-Hant-TW"), ("https://a/", "x-default")]
    bad = [("https://b/1", "eng"), ("http://b/2", "en-UK"), ("https://b/3", "fr"), ("https://b/4", "fr"), ("https://b/5", "x-default"), ("https://b/6", "x-default")]
    tags = full(good) + [t for t in full(bad) if t[:2] != ("https://b/3", "eng") and t != ("https://b/4", "fr", "https://b/4")] + [(None, "en", "https://c"), ("https://d", "be", None), ("https://e", None, "https://e")]
    pages = spark.createDataFrame([(u, None if u == "https://a/" else u + "x" * (u == "https://b/6")) for u, _ in good + bad], "url string, canonical string")
    got = {x.set: x for x in locales.judged_sets(spark.createDataFrame(tags, "page_url string, lang string, href string"), pages, locales.iso_codes(spark)).collect()}
    assert got.keys() == {"https://a/", "http://b/2", "https://e"}
    assert (got["https://a/"].problems, got["https://a/"].pages, got["https://a/"].alternates) == ("", 4, 16)
    assert got["http://b/2"].problems == "bad-code,missing-return,missing-self,mixed-protocol,non-canonical,several-defaults,several-pages"
    assert got["https://e"].problems == "no-default"
    codes = {"en": None, "EN-gb": None, "zh-Hans-US": None, "es-419": None, "x-default": None, "jp": "unknown-language", "eng": "malformed", "en-uk": "unknown-country", "es-LA": None, "en_US": "malformed", "de-EU": "unknown-country", "be": None}
    judged = locales.judged_codes(spark.createDataFrame([(c,) for c in [*codes, None]], "lang string"), locales.iso_codes(spark)).collect()
    assert {x.lang: x.code_problem for x in judged} == {**codes, None: None}


def test_paged_totals(spark):
    link = lambda *pairs: [{"url": u, "count": n} for u, n in pairs]
    rows = [
        ("whole", 0, "success", 2, link(("a", 3), ("b", 1))), ("whole", 1, "success", 2, link(("a", 5), ("", 9), (None, 9))), ("whole", 2, "success", 2, link(("late", 1))),
        ("capped", 0, "success", 99, link(("a", 1))), ("capped", 1, "success", 99, link(("b", 2))), ("capped", 2, "success", 99, link(("c", 4))),
        ("fails", 0, "success", 3, link(("a", 7))), ("fails", 1, "error", 3, None), ("fails", 2, "success", 3, link(("b", 1))),
        ("never", 0, "error", None, None), ("never", 1, "success", 2, link(("b", 1))), ("gap", 0, "success", 3, link(("a", -4))), ("gap", 2, "success", 3, link(("b", 1))),
        ("one", 0, "success", None, None), ("late", 1, "success", 2, link(("b", 1))), ("grows", 0, "success", 1, link(("a", 1))), ("grows", 1, "success", 2, link(("b", 1))), (None, 0, "success", 1, None), ("none", None, "success", 1, None),
    ]
    df = spark.createDataFrame(rows, "site string, page int, status string, total_pages int, links array<struct<url:string,count:long>>")
    got = {x.site: tuple(x)[1:] for x in paged.paged_totals(df, most_pages=3).collect()}
    assert got == {
        "whole": ("success", 2, 2, 2, 6, True), "capped": ("partial", 3, 99, 3, 7, False), "fails": ("partial", 1, 3, 1, 7, False), "never": ("error", 0, None, 0, 0, False), "gap": ("partial", 1, 3, 1, 0, False),
        "one": ("success", 1, 1, 0, 0, True), "late": ("error", 0, None, 0, 0, False), "grows": ("success", 1, 1, 1, 1, True),
    }
    assert paged.paged_totals(df, most_pages=None).where("site = 'capped'").first().pages_fetched == 3
    assert paged.paged_totals(df, most_pages=2).where("site = 'capped'").first().links == 3


def test_daily_quota(spark):
    rows = [("a", i, f"u{i}" if i % 10 else " ", None) for i in range(300)] + [("b", i, f"u{i}", "HTTP 429: quota" if i in (3, 5) else "HTTP 500" if i == 1 else None) for i in range(6)] + [("c", 0, None, None)]
    got = {x.day: tuple(x)[1:] for x in paged.notified(spark.createDataFrame(rows, "day string, position long, url string, error string")).collect()}
    assert got == {"a": (300, 180, 180, 0, False, 20), "b": (6, 4, 2, 2, True, 198), "c": (1, 0, 0, 0, False, 200)}


def test_web_graph_lookup_reads_little(spark, tmp_path):
    rows = [(k, 1.0 / k, k * 2, 0.5 if k % 5 else 0.0, f"com.site{k:05d}", k % 3) for k in range(1, 3001)] + [(4000, 0.1, 1, 0.2, "com.site00009", 1)]
    ranks = spark.createDataFrame(rows, "harmonic_pos long, harmonic_val double, pagerank_pos long, pagerank_val double, host_rev string, n_hosts long")
    web_graph.write_index(ranks, f"{tmp_path}/ranks", 3)
    web_graph.write_index(spark.createDataFrame([("com.site00005",), ("com.tiny",)], "host_rev string"), f"{tmp_path}/vertices", 1)
    asked = spark.createDataFrame([(d,) for d in ("site00009.com", "https://www.Site00007.com:8080/a?b", "site00005.com", "tiny.com", "absent.org", None)], "domain string")
    got = {x.domain: x for x in web_graph.domain_metrics(spark, f"{tmp_path}/ranks", f"{tmp_path}/vertices", asked).collect()}
    assert {d: x.found for d, x in got.items()} == {"site00009.com": "ranked", "https://www.Site00007.com:8080/a?b": "ranked", "site00005.com": "crawled", "tiny.com": "crawled", "absent.org": "absent", None: "absent"}
    assert (got["site00009.com"].harmonic_centrality_rank, got["site00009.com"].pagerank_rank, got["site00005.com"].pagerank) == (9, 18, None)
    few = web_graph.asked_rows(spark, f"{tmp_path}/ranks", spark.createDataFrame([("com.site00007",), ("com.site02999",)], "host_rev string"))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "In(host_rev" in plan and "Join" not in plan and few.count() == 2
    many = web_graph.asked_rows(spark, f"{tmp_path}/ranks", spark.createDataFrame([(f"com.site{k:05d}",) for k in range(100, 130)], "host_rev string"))
    assert "GreaterThanOrEqual(host_rev" in many._jdf.queryExecution().executedPlan().toString() and many.count() == 30


def test_heavy_hitters_and_overlaps_within_an_intent(spark):
    r = random.Random(6)
    rows = [(f"k{k}", "https://all/" if r.random() < 0.95 else f"u{k}", k % 2) for k in range(60)] + [(f"k{r.randrange(60)}", f"u{r.randrange(25)}", None) for _ in range(500)]
    rows = [(k, u, int(k[1:]) % 2) for k, u, _ in rows]
    df = spark.createDataFrame(rows, "keyword string, url string, intent int")
    n = {}
    for k, u, _ in set(rows):
        n[u] = n.get(u, 0) + 1
    distinct = df.select("keyword", "url").distinct()
    for slots in (100_000, 1):
        assert {x.url: x.n for x in clusters.heavy_hitters(distinct, "url", 20, slots).collect()} == {u: c for u, c in n.items() if c > 20}
    got = {(x.k1, x.k2): x.shared for x in clusters.result_overlap(df, "intent", 30, least=2).collect()}
    of = {}
    for k, u, _ in rows:
        if n[u] <= 30:
            of.setdefault(k, set()).add(u)
    want = {(a, b): len(of[a] & of[b]) for a in of for b in of if a < b and int(a[1:]) % 2 == int(b[1:]) % 2 and len(of[a] & of[b]) >= 2}
    assert got == want


def test_common_keys_of_sets_of_domains(spark):
    r = random.Random(7)
    sets = {d: {r.randrange(90_000) if r.random() < 0.3 else r.randrange(50) for _ in range(80)} for d in "abcde"}
    rows = [(d, k) for d, ks in sets.items() for k in ks] + [("a", next(iter(sets["a"]))), (None, 1), ("z", None), ("y", -3)]
    got = {x.parts: (x.n_parts, x.shared) for x in links.common_keys(spark.createDataFrame(rows, "d string, k long"), "d", "k", 4).collect()}
    want = {",".join(c): (m, n) for m in (1, 2, 3, 4) for c in itertools.combinations("abcde", m) for n in (len(set.intersection(*[sets[d] for d in c])),) if n}
    assert got == want


def test_quota_stream_keeps_two_numbers_a_day(spark, tmp_path):
    from pagequarry.streaming import monitors

    schema = "site string, ts timestamp, position long, url string, error string"
    rows = [("a", "2024-01-01 10:00:00", i, f"u{i}", "HTTP 429" if i == 3 else None) for i in range(5)] + [("b", "2024-01-01 11:00:00", i, f"v{i}", None) for i in range(3)]
    late = [("a", "2024-01-01 12:00:00", 9, "w", None), ("b", "2024-01-01 12:00:00", 7, "w7", None), ("b", "2024-01-01 12:00:01", 8, "w8", None), ("a", "2024-01-02 00:10:00", 10, "x", None)]
    after = [("c", "2024-01-05 00:00:00", 0, "y", None)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, part in enumerate((rows, late, after)):
            df = spark.createDataFrame(part, "site string, t string, position long, url string, error string").select("site", F.to_timestamp("t").alias("ts"), "position", "url", "error")
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            query = monitors.quota_gate(source, quota=4).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            assert query.awaitTermination(60)
            left = query.lastProgress.stateOperators[0].numRowsTotal if k == 2 else None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(x.site, x.position): x.verdict for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {("a", i): "sent" if i <= 3 else "stopped" for i in range(5)} | {("b", i): "sent" for i in range(3)} | {("a", 9): "stopped", ("b", 7): "sent", ("b", 8): "over-quota", ("a", 10): "sent", ("c", 0): "sent"}
    assert got == want
    assert left is not None and left <= 4


def test_drift_monitor_forgets_pages(spark, tmp_path):
    from pagequarry.streaming import monitors

    schema = "url_hash string, version long, title string, html_hash string, ts timestamp"
    for version, (page, title, day) in enumerate([("h", "a", 1), ("h", "b", 2), ("g", "x", 30), ("g", "y", 31), ("h", "c", 32)], 1):
        df = spark.createDataFrame([(page, version, title, "x", datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day))], schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = monitors.drift_monitor(source, "ts", 10 * 86_400_000).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    got = [(x.url_hash, x.old_value, x.new_value) for x in spark.read.parquet(str(tmp_path / "out")).orderBy("version").collect()]
    assert got == [("h", "a", "b"), ("g", "x", "y")]
