"""Extraction against pages whose main text is known because the test wrote them."""

import html as entities
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import extract

DATA = "/root/testdata/sf0.01"
SCHEMA = "page_id bigint, url string, html string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(n)).capitalize() + "."


def site(rng, kind):
    """A page of one of four layouts, with its main text."""
    title, parts = sentence(rng, 5), [sentence(rng, rng.randint(3, 60)) + rng.choice(["", " & <x>", "   é"]) for _ in range(rng.randint(2, 6))]
    shown = [entities.escape(p).replace(" ", rng.choice([" ", "\n  ", " <b>", " </i>"]), 1) for p in parts]
    body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<p>{}<br>"]).format(p) for p in shown)
    noise = sentence(rng, rng.randint(4, 40))
    links = "<ul>" + "".join(f"<li><a href='/{i}'>{sentence(rng, 2)}</a>" for i in range(6)) + "</ul>"
    comments = "".join(f"<div class=comment><p>{sentence(rng, 30)}</p></div>" for _ in range(8))
    top = f"<html><head><title>{noise}</title><style>p{{a:b}}</style><script>if (a<b) '</p><article>{noise}'</script></head><body class='with-sidebar'><!-- <p>{noise}</p> -->"
    end = f"<form><p>{noise}</p><select><option>{noise}</select></form><footer>&copy; {noise}</footer>"
    if kind == 0:
        page = f"{top}<nav>{links}</nav><article><h1>{title}</h1>{body}<aside>{noise}</aside></article><section id=comments>{comments}</section>{end}</body></html>"
    elif kind == 1:
        page = f"{top}<header><h2>{noise}</h2></header><div class='cookie-notice'>{noise}</div><main><h2>{title}</h2><div class=body-text>{body}</div></main><div class='sidebar left'>{links}</div>{end}"
    elif kind == 2:
        page = f"{top}<div id=menu>{links}</div><div class='page p{rng.randint(1, 99)}'><div class='post-{rng.randint(1, 999)} entry'><h1>{title}</h1>{body}</div><div class='comments-area' id=respond>{comments}</div></div><div role=complementary>{noise}</div>{end}"
    else:
        page = f"{top}<div class=ad>{noise}</div><article><header><h1>{title}</h1></header>{body}<div class='newsletter signup'>{noise}</div><article class=comment>{comments}</article>"
    return page, "\n".join(" ".join(x.split()) for x in [title, *parts])


def test_planted_pages(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(300):
        host = "big" if i % 3 == 0 else f"h{i % 7}"
        page, want[i] = site(rng, hash_of(host))
        rows.append((i, f"https://{host}.example.org/p/{i}", page))
    pages = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"broadcast_bytes": 0}):
        got = extract.extracted(pages, **options).collect()
        assert {r.page_id: r.text for r in got} == want
        assert all(r.by_consensus and r.n_chars == len(r.text) for r in got)


def hash_of(host):
    return sum(map(ord, host)) % 4


def test_consensus_decides(spark):
    """A page whose longest part is another one follows its host; alone on its host it follows itself."""
    def page(text, other):
        return f"<body><div class=story><p>{text}</p></div><div class=box><p>{other}</p></div>"

    rng = random.Random(1)
    long_, short = sentence(rng, 40), sentence(rng, 5)
    odd = page(sentence(rng, 30), sentence(rng, 39))
    rows = [(i, "http://a.org/", page(long_, short)) for i in range(9)] + [(9, "http://a.org/x?y", odd), (10, "http://b.org", odd)]
    got = {r.page_id: r.text for r in extract.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == long_ and got[9].count(" ") == 29 and got[10].count(" ") == 38
    paths = {r.host: r.paths for r in extract.host_paths(extract.page_rows(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert paths == {"a.org": ["body>div.story"], "b.org": ["body>div.box"]}


def test_hard_pages(spark):
    """Null and empty pages and urls, broken markup, long and deep pages, repeats, no rows, clashing columns."""
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    rows = [(1, None, None), (2, "no scheme", ""), (None, "http://x/", "<p>a<p>b"), (3, "http://x/", "1 < 2 &amp;lt; &#233;&nbsp;3 <"), (4, "http://x/", "<table><tr><td>a<td>b</table>"), (5, "http://y/", deep), (6, "http://y/", "<article>" + "<p>w</p>" * 20_000), (7, "http://z", "<p class='x>y</p>"), (7, "http://z", "<p class='x>y</p>"), (8, "http://z", "<script>only"), (9, "http://q", "<a href=x>all in a link</a>"), (10, "http://r", "<!-- open <p>x</p>")]
    pages = spark.createDataFrame(rows, SCHEMA)
    clashing = pages.select("*", *[F.lit(1).alias(c) for c in ("host", "paths", "path", "text", "n_chars", "votes", "_salt")])
    got = sorted(((r.page_id, r.text) for r in extract.extracted(clashing).collect()), key=str)
    want = [(1, ""), (2, ""), (None, "a\nb"), (3, "1 < 2 &lt; é 3 <"), (4, "a\nb"), (5, "core"), (6, "\n".join(["w"] * 20_000)), (7, "y"), (7, "y"), (8, ""), (9, "all in a link"), (10, "")]
    assert got == sorted(want, key=str)
    assert extract.extracted(pages.limit(0)).count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_query_on_whole_table(spark):
    """The given pages: heading and paragraphs of the article, cut out by expressions of the test."""
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = extract.op12_html_extraction(spark, DATA).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?p>|</?h1>|<br>", inside)]
        assert text[r.page_id] == "\n".join(x for x in parts if x)
