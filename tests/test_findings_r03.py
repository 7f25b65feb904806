"""What the findings of round three asked for, on small fixtures."""

import math
import random


from pagequarry.operators import audits, clusters, html, locales, text_quality


def test_cluster_gates_count_menu_links_without_making_them(spark):
    rng = random.Random(5)
    posts = [(f"c{k % 4}", k, k < 4, f"k{k}", 5, 5) for k in range(60)]
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(60)]
    shows = sorted({(f"m{rng.randrange(5)}", rng.randrange(60)) for _ in range(25)})
    lists = sorted({(f"m{rng.randrange(5)}", rng.randrange(60)) for _ in range(120)})
    every = sorted({*links, *((s, d) for m, s in shows for n, d in lists if m == n)})
    p = spark.createDataFrame(posts, "cluster string, url long, is_pillar boolean, keyword string, words int, target_words int")
    edges = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    got = audits.cluster_gates(p, edges(links), spark.createDataFrame(shows, "menu string, src long"), spark.createDataFrame(lists, "menu string, dst long")).collect()
    assert sorted(got) == sorted(audits.cluster_gates(p, edges(every)).collect()) and len(got) == 4
    # A menu over all pages, shown by three of them: these have two links, all others three.
    full = spark.createDataFrame([("m", k) for k in range(60)], "menu string, dst long")
    for shown, gates in ((range(0, 12), (False, True)), (range(0, 16), (True, True)), (range(0, 4), (False, False))):
        menu = spark.createDataFrame([("m", k) for k in shown], "menu string, src long")
        got = audits.cluster_gates(p, edges([(0, 0)]), menu, full).select("enough_incoming", "no_orphans").distinct().collect()
        assert [tuple(r) for r in got] == [gates]


def test_references_without_semicolon_stay_where_asked(spark):
    page = (
        '<title>a &amp; b&amp</title><script type="application/ld+json">{"@type": "X", "u": "/?a=1&b=2"}</script><h1>&lt;x&gt; &#65; &copy</h1>'
        '<a href="/p?a=1&amp;b=2&lt">&amp&amp;</a><meta property="og:title" content="t"><img src="/i.png" class="lazy">'
    )
    df = spark.createDataFrame([(1, "https://x.example/", page), (2, None, None)], "page_id long, url string, html string")
    strict, lenient = (html.parse_pages(df, ended_only=e).orderBy("page_id").first().parsed for e in (True, False))
    assert (strict.title, strict.h1, strict.links_internal[0].href, strict.links_internal[0].text) == ("a & b&amp", ["<x> A &copy"], "https://x.example/p?a=1&b=2&lt", "&amp&")
    assert (lenient.title, lenient.h1) == ("a & b&", ["<x> A \u00a9"])
    assert strict.schema == lenient.schema == ['{"@type": "X", "u": "/?a=1&b=2"}'] and strict.open_graph == {"og:title": "t"} and strict.images[0].lazy_method == "js-generic"


def test_pages_are_handed_on_in_slices(spark):
    """Every page once, in its place, over more slices than one; no slice is larger than it may be."""
    assert html.PAGES_AT_ONCE <= 256
    df = spark.range(1000, numPartitions=2).selectExpr("id AS page_id", "'https://x.example/' AS url", "concat('<h1>h', id, '</h1><p>', repeat('w ', int(id)), '</p>') AS html")
    got = html.parse_pages(df).select("page_id", "parsed.h1", "parsed.word_count").collect()
    assert {(r.page_id, r.h1[0], r.word_count) for r in got} == {(k, f"h{k}", k + 1) for k in range(1000)} and len(got) == 1000


def test_places_at_one_point_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "POINT_BLOCK", 3)
    rng = random.Random(3)
    spots = [(rng.uniform(50, 51), rng.uniform(7, 8)) for _ in range(15)] + [(90.0, 0.0), (90.0, 120.0), (0.0, 180.0), (0.0, -180.0)]
    cs = [(k, *spots[k % len(spots)]) for k in range(60)] + [(99, None, 7.0)]
    ps = [(k, *rng.choice(spots)) for k in range(90)] + [(5, *spots[0]), (91, 50.0, None)]
    schema = "long, lat double, lng double"
    got = clusters.within_radius(spark.createDataFrame(cs, f"centre {schema}"), spark.createDataFrame(ps, f"place {schema}"), 40.0).collect()

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * clusters.EARTH_KM * math.asin(math.sqrt(min(h, 1.0)))

    known = [(c, p, km(a, b, x, y)) for c, a, b in cs if a is not None for p, x, y in ps if y is not None]
    assert sorted((r.centre, r.place) for r in got) == sorted((c, p) for c, p, d in known if d <= 40.0)
    assert all(sorted(r.rank for r in got if r.centre == c) == list(range(1, 1 + sum(r.centre == c for r in got))) for c in range(60))


def test_pairs_are_counted_in_tasks_of_bounded_pairs(spark, monkeypatch):
    monkeypatch.setattr(clusters, "TASK_PAIRS", 10)
    rows = [(f"k{k:02d}", u) for u in range(6) for k in range(30) if k % (u + 1) == 0]
    got = clusters.result_overlap(spark.createDataFrame(rows, "keyword string, url long"))
    urls = {k: {u for x, u in rows if x == k} for k, _ in rows}
    assert {(r.k1, r.k2): r.shared for r in got.collect()} == {(a, b): len(urls[a] & urls[b]) for a in urls for b in urls if a < b and urls[a] & urls[b]}
    # 435 pairs at url 0, 105 at url 1, 45, 28, 15 and 10 at the others, counted without sums before the shuffle.
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString() and ", 64)" in got._jdf.queryExecution().executedPlan().toString()


def test_uniqueness_shuffles_words_not_texts_words(spark):
    df = spark.createDataFrame([(1, "A b b c"), (2, "a d"), (3, "D!"), (4, "..."), (5, None), (6, "e e")], "doc_id long, text string")
    out = text_quality.uniqueness(df)
    assert {tuple(r) for r in out.collect()} == {(1, 4, 3, 75.0), (2, 2, 0, 0.0), (3, 1, 0, 0.0), (6, 2, 2, 100.0)}
    assert "hashpartitioning(doc_id#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", word#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_links_between_alternates_grow_with_pages(spark, monkeypatch):
    """A set whose 40 pages all name each other: 1,600 tags are about 40 links between pages."""
    tags = [(f"https://x.example/{a:02d}", "en", f"https://x.example/{b:02d}") for a in range(40) for b in range(40)] + [("https://y.example/1", "de", "https://y.example/2"), ("https://y.example/3", None, "https://y.example/2")]
    seen = []
    real = locales.components
    monkeypatch.setattr(locales, "components", lambda ways: seen.append(ways.count()) or real(ways))
    df = spark.createDataFrame(tags, "page_url string, lang string, href string")
    got = {r.page_url: r.set for r in locales.alternate_sets(df).collect()}
    assert got == {f"https://x.example/{k:02d}": "https://x.example/00" for k in range(40)} | {f"https://y.example/{k}": "https://y.example/1" for k in (1, 2, 3)}
    assert seen[0] <= 50
