"""Pages: main text and WARC archives."""

import hashlib
import random

import pytest

from pagequarry.llm import html_main, warc

SCHEMA = "page_id long, url string, html string"


def longest(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_common_subsequence_is_longest():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 14))] for _ in range(2))
        pairs = html_main.common_subsequence(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize(
    "html,texts",
    [
        ('<p>a <b>b<br>c<p>d &amp e &lt;x&gt; < 3 <script>var t="</p>";x</script> z', ["a b c", "d & e <x> < 3", "z"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1 2", "3"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ('text <a href="x>y">link</a> <!-- c --> more<div', ["text link more"]),
        (None, []),
    ],
)
def test_blocks(html, texts):
    assert [b[0] for b in html_main.page_blocks(html)] == texts


@pytest.mark.parametrize(
    "html,kept",
    [
        ("<article><div class='post-header'><h1>The title</h1></div><p>x</p></article>", ["The title", "x"]),
        ("<article><p class='related-work'>a</p><p class='lead share-price'>b</p><section id='search-algorithms'>c</section></article>", ["a", "b", "c"]),
        ("<article><p>a <span class='ad'>x <span>y</span> LEAK</span> b</p></article>", ["a b"]),
        ("<div class='site-header'>s</div><div id='cookieBanner'>s</div><div role='navigation'>s</div><div class='ad-slot-2'>s</div><div class=Comments><p>s</div><article>a</article>", ["a"]),
        ("<p><b class='ad'>not closed</p><p>kept</p>", ["not closed", "kept"]),
    ],
)
def test_names_of_what_is_no_content(html, kept):
    assert [t for t, named, *_ in html_main.page_blocks(html) if not named] == kept


def brute_main_text(site):
    """Texts of a site {path: (blocks, wrapped)} by a quadratic common subsequence with the pages before and after; wrapped pages keep their article."""

    def aligned(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    out, order = {}, sorted(site)
    for k, path in enumerate(order):
        blocks, wrapped = site[path]
        gone = set()
        for other in order[max(0, k - 1) : k] + order[k + 1 : k + 2]:
            theirs = site[other][0]
            assert aligned(blocks, theirs) == len(set(blocks) & set(theirs))  # blocks of a page differ and stand in one order
            gone |= set(blocks) & set(theirs)
        out[path] = "\n\n".join(b for b in blocks if (b.startswith("own") if wrapped else b not in gone))
    return out


def test_main_text_equals_brute_force_over_a_site(spark):
    r = random.Random(3)
    rows, expected = [], {}
    for host in ("p", "q"):
        site = {}
        for i in range(30):
            shared = sorted(r.sample(range(12), r.randint(5, 12)))
            head, foot = [f"t{k:02d}" for k in shared if k < 6], [f"t{k:02d}" for k in shared if k >= 6]
            own = [f"own {i} {k}" for k in range(r.randint(2, 5))] + ["own passage of all"] * (host == "q")
            site[f"/{i:02d}"] = ([*head, *own, *foot], host == "q")
            div = lambda xs: "".join(f"<div>{x}</div>" for x in xs)
            body = "".join(f"<p>{x}</p>" for x in own)
            html = f"<html><body>{div(head)}{'<article>' + body + '</article>' if host == 'q' else body}{div(foot)}</body></html>"
            rows.append((len(rows), f"http://{host}/{i:02d}", html))
        expected |= {f"http://{host}{path}": text for path, text in brute_main_text(site).items()}
    got = html_main.main_text(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {x.url: x.text for x in got} == expected
    assert sum(x.n_shared for x in got if "//p/" in x.url) > 150


def test_ids_beside_nulls_clashing_columns_long_and_repeated_pages(spark):
    big = 2**60 + 1
    long_ = "".join(f"<p>paragraph {k}</p>" for k in range(20_000))
    rows = [(big, "http://z/1", long_), (None, "http://z/2", "<p>b</p>"), (big + 2, "http://z/1", long_), (big, "http://z/1", long_), *[(7, "http://y/1", "<p>same</p>")] * 100]
    df = spark.createDataFrame([(*x, 1.5, "x") for x in rows], SCHEMA + ", n_chars double, host string").coalesce(1)
    got = html_main.main_text(df).collect()
    assert sorted((x.page_id or 0) for x in got) == sorted((x[0] or 0) for x in rows)
    assert all(x.text == "\n\n".join(f"paragraph {k}" for k in range(20_000)) for x in got if x.url == "http://z/1") and {x.text for x in got if x.page_id == 7} == {"same"}
    back = warc.payload_report(warc.reassemble(warc.read_archives(spark, warc.write_archives(df)))).collect()
    assert sorted((x.page_id or 0) for x in back) == sorted((x[0] or 0) for x in rows)
    assert {x.refers_to for x in back if x.page_id == big} == {big + 2}


def test_main_text(spark):
    page = "<body><nav><a>Home</a></nav><div class='top'>Our site</div><article><h1>T{0}</h1><p>Own {0}.<p>Shared passage.</article><div class=ad>Buy {0}</div><footer>f</footer>"
    plain = "<body><div>Our plain site</div><div>First {0}</div><div>Second {0}</div><div>Imprint</div>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(4)]
    rows += [(10 + i, f"http://b.example/x/{i}?q", plain.format(i)) for i in range(4)]
    rows += [(20, None, None), (21, "http://c.example/", ""), (22, "http://d.example/1", "<p>copy</p>"), (23, "http://d.example/2", "<p>copy</p>"), (22, "http://d.example/1", "<p>copy</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", text string")
    got = [(r.page_id, r.text) for r in html_main.main_text(df).orderBy("page_id").collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert all(by[i] == f"T{i}\n\nOwn {i}.\n\nShared passage." for i in range(4))
    assert all(by[10 + i] == f"First {i}\n\nSecond {i}" for i in range(4))
    assert (by[20], by[21], by[22], by[23]) == ("", "", "copy", "copy")
    assert html_main.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_template_goes_where_most_of_a_page_is_template(spark):
    lines = "".join(f"<div>Template line {k}</div>" for k in range(20))
    own = lambda i, n=2: "".join(f"<div>Own {k} of {i}</div>" for k in range(n))
    mine = lambda i, n=2: "\n\n".join(f"Own {k} of {i}" for k in range(n))
    rows = [(i, f"http://a/{i}", lines + own(i)) for i in range(4)]  # 20 of 22 blocks are shared
    rows += [(10, "http://b/0", lines), (11, "http://b/1", lines + own(11, 9))]  # a stub of template
    rows += [(20 + i, f"http://c/{i}", lines + own(20, 9)) for i in range(5)]  # equal pages
    rows += [(30, "http://c/9", lines + own(30, 9))]
    once = own(40, 9).replace("</div>", "!</div>", 1)
    rows += [(40 + i, f"http://d/{i}", lines + h) for i, h in enumerate([own(40, 9), once, own(40, 9) + "<div>?</div>", own(43, 9)])]  # copies that differ a little
    for n in (1, 5):
        by = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()}
        assert all(by[i] == mine(i) for i in range(4))
        assert (by[10], by[11]) == ("", mine(11, 9))
        assert all(by[20 + i] == mine(20, 9) for i in range(5)) and by[30] == mine(30, 9)
        assert (by[40], by[41], by[42], by[43]) == (mine(40, 9), mine(40, 9).replace("40", "40!", 1), mine(40, 9) + "\n\n?", mine(43, 9))


def test_neighbours_do_not_depend_on_partitions(spark):
    r = random.Random(6)
    rows = [(i, i * 7, f"h{r.randint(0, 2)}", f"/{r.randint(0, 50)}") for i in range(300)]
    df = spark.createDataFrame(rows, "page long, hh long, host string, path string")
    ordered = sorted((h, p, i, k) for i, k, h, p in rows)
    expected = {(b[2], a[2]) for a, b in zip(ordered, ordered[1:], strict=False) if a[0] == b[0]}
    for n in (1, 7):
        assert {(x.page, x.page0) for x in html_main.neighbours(df.repartition(n)).collect()} == expected


def test_chunked_framing():
    for payload in (b"", b"x", "é".encode() * 9000, b"\r\n0\r\n\r\n" * 3000):
        assert warc.unchunked(warc.chunked(payload)) == payload
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab\r\n0\r\n\r\n")


def test_warc_round_trip(spark):
    big, long_ = "é" * 60_000 + "\r\n\r\nWARC/1.1\r\n", "same " * 400
    rows = [(1, "http://a/ b", long_), (5, None, long_), (3, "u", long_), (7, "u", "short"), (8, "u", "short"), (9, "u", None), (10, "u", ""), (11, "u", big), (12, "u", big), (None, "u", "x" * 2000), (11, "u", big)]
    df = spark.createDataFrame(rows, SCHEMA)
    records = warc.read_archives(spark, warc.write_archives(df))
    kinds = {r["type"]: r["n"] for r in records.groupBy("type").count().withColumnRenamed("count", "n").collect()}
    assert kinds["continuation"] > 2
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.payload_report(warc.reassemble(records)).collect()), key=str)
    heads = {long_: 5, big: 12}
    expected = []
    for i, _, html in rows:
        raw = (html or "").encode()
        head = heads.get(html, i)
        expected.append((i or -1, len(raw), hashlib.sha1(raw).hexdigest(), "response" if head == i else "revisit", None if head == i else head))
    assert got == sorted(expected, key=str)
    payloads = {r.page_id: bytes(r.payload).decode() for r in warc.reassemble(records).where("payload is not null").collect()}
    assert payloads[12] == big and payloads[9] == ""
    empty = warc.read_archives(spark, warc.write_archives(spark.createDataFrame([], SCHEMA)))
    assert warc.payload_report(warc.reassemble(empty)).collect() == []


def test_missing_segments_fail(spark):
    df = spark.createDataFrame([(1, "u", "x" * 100_000)], SCHEMA)
    records = warc.read_archives(spark, warc.write_archives(df)).where("segment is null or segment <> 2")
    with pytest.raises(Exception, match="segments missing"):
        warc.reassemble(records).collect()
