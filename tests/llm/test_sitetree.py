"""Site style trees: importances against brute force, texts against known articles."""

import html as entities
import math
import os
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import sitetree

PAGES = "page_id long, url string, html string, text string, host string, mark int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], PAGES)


def texts(spark, rows, **how):
    return sorted(((r["page_id"], r["text"]) for r in sitetree.extracted(pages(spark, rows), **how).collect()), key=str)


def one(html):
    return sitetree.Branches(html).text({i for i, m in zip(sitetree.Branches(html).ids, sitetree.Branches(html).marks) if m == sitetree.AROUND})


def test_landmarks_blocks_and_references():
    assert one("<body><nav>menu</nav><header>site</header><article><header><h1>T &amp; U</h1></header><p>one<b>two</b> three<br>four<ul><li>five<li>six</ul><aside>x</aside></article><footer>f</footer>") == "T & U onetwo three four five six"
    assert one("<div class='sideBar'>x</div><div id=cookie-banner>y</div><main><p>a\n\t b<p>c&nbsp;d&#x41;&notin;</main>") == "a b c dA∉"
    assert one("<article><p>a</p><div class=comments><article class='comment'>no</article></div><form>name<input><button>go</button></form><script>var t='</p>';</script><style>p{}</style></article>") == "a"
    assert one("<div class='page has-sidebar'><article>kept</article></div>") == "kept"
    assert one("<article>a <span class=ad>buy</span> b</article>") == "a b"
    assert one("<table><tr><td>1<td>2<tr><td>3</table><select><option>o</select>") == "1 2 3"
    assert one("<title>no</title>plain &am text <!-- c -->") == "plain &am text"
    assert one("") == ""
    assert one("<dl><dt>a<dd>b<dt>c</dl><p>x</b>y</p>z") == "a b c xy z"


def test_depth_is_bounded_and_no_text_lost():
    deep = "".join(f"<div>{i} " for i in range(20_000)) + "</div>" * 20_000 + "<p>end"
    assert one(deep) == " ".join(map(str, range(20_000))) + " end"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<b>", "</b>", "<li>", "<![", "<!--", "-->", "<!", "</", "<", "&", "&#", "<![CDATA[x]]>", "<![if IE]>", "<?php ?>", "text ", "é", "<a b='", "'>", "\x00", "<td>", "<script>", "</script>", "<svg/>"]), max_size=25))
def test_any_markup_is_read(parts):
    assert isinstance(one("".join(parts)), str)


def brute(rows):
    """(host, node): (pages, importance), page by page."""
    count, marks, digests, styles = Counter(), {}, defaultdict(Counter), defaultdict(Counter)
    for host, html in rows:
        for node, mark, kind, digest in sitetree.Branches(html).statistics():
            key = (host, node)
            marks[key] = mark
            count[key] += kind == 0
            if kind:
                (digests if kind == 1 else styles)[key][digest] += 1
    out = {}
    for key, m in count.items():
        log = lambda n: math.log(n) / math.log(m)
        content = 1 if m < 2 else 1 - (sum(map(log, digests[key].values())) / len(digests[key]) if digests[key] else 0)
        look = 1 if m < 2 else -sum(n / m * (log(n) - 1) for n in styles[key].values())
        fade = 0.9 ** len(styles[key])
        tree = (1 - fade) * look + fade * content
        said = {sitetree.AROUND: 0.0, sitetree.ARTICLE: 1.0}.get(marks[key])
        out[key] = (m, tree if said is None else 0.6 * said + 0.4 * tree)
    return out


def site(n, host="h.example", boiler="<div class=x1><p>Breaking: buy now</p></div>"):
    return [(i, f"http://{host}/{i}", f"<html><body><div class=x0><p>Home</p></div>{boiler}<div class=x2><h1>Title {i}</h1><p>Body of {i}.</p>{'<ul><li>k</ul>' * (i % 2)}</div></body></html>") for i in range(n)]


def test_importances_match_brute_force(spark):
    rows = site(20) + site(3, "few.example") + [(90, "http://one.example/", "<body><nav>a</nav><article><p>b</p></article>")]
    df = spark.createDataFrame([(u.split("/")[2], h) for _, u, h in rows], "host string, html string")
    got = {(r["host"], r["node"]): (r["pages"], r["importance"]) for r in sitetree.importances(df).collect()}
    want = brute([(u.split("/")[2], h) for _, u, h in rows])
    assert got.keys() == want.keys()
    for key, (m, importance) in want.items():
        assert got[key] == (m, pytest.approx(importance, abs=1e-9))


def test_entropy_removes_what_repeats_where_html_says_nothing(spark):
    for most in (500_000, 0):
        got = dict(texts(spark, site(20) + [(100 + i, u, h) for i, u, h in site(3, "few.example")], most_broadcast=most))
        assert got[4] == "Title 4 Body of 4."  # on 20 pages: the repeated branches are gone
        assert got[5] == "Title 5 Body of 5."  # as is the list of every second page
        assert got[101] == "Home Breaking: buy now Title 1 Body of 1. k"  # on 3 pages nothing is known


def test_copies_nulls_and_repeated_rows(spark):
    same = "<body><div><p>all alike</p></div></body>"
    rows = [(1, f"http://c.example/{i}", same) for i in range(30)] + [(2, None, same), (None, "no host", None), (3, "http://c.example/x", ""), (4, "http://c.example/x", "<nav>only a menu</nav>")]
    rows += [(5, "HTTP://C.example?x", "<article>" + "long text " * 300_000 + "</article>")]
    for most in (500_000, 0):
        got = texts(spark, rows, most_broadcast=most)
        assert got == sorted([(1, "all alike")] * 30 + [(2, "all alike"), (None, ""), (3, ""), (4, ""), (5, ("long text " * 300_000).strip())], key=str)
    assert texts(spark, []) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test data not present")
def test_articles_of_the_test_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in sitetree.extracted(df).collect()}
    for row in df.collect():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article))
        assert got[row["page_id"]] == " ".join(b for b in blocks if b)
