import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from normspark.llm import html_text as H
from tests.llm.conftest import prose

KIND = "page_id long, url string, html string"


def blocks(seed, n=4):
    return [prose(seed * 10 + i, 20 + 9 * ((seed + i) % 5)).capitalize() + "." for i in range(n)]


def para(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


JUNK = {
    "menu": "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>All the news of today</a></li></ul>",
    "note": "<p>We use cookies to make this site better for you and for us. Accept all of them or leave.</p>",
    "talk": "".join(f"<div class='c'><b>User {i}</b><p>{prose(900 + i, 25)}</p></div>" for i in range(3)),
    "ad": "<p>Buy one, get one. Only today and only here.</p>",
}


def plain_article(title, lines, i):
    return f"<!DOCTYPE html><html><head><title>{title} - Site</title><style>p{{}}</style></head><body><header><h2>The Site</h2></header><nav>{JUNK['menu']}</nav><div class='cookie-notice'>{JUNK['note']}</div><main><article><header><h1>{title}</h1><p>By somebody</p></header>{para(lines)}<aside>{JUNK['ad']}</aside></article><section id='comments'>{JUNK['talk']}</section></main><footer>Imprint of the site</footer></body></html>"


def div_layout(title, lines, i):
    return f"<html><body><div id='top' class='site-header'><p>The Site, all you need to know</p>{JUNK['menu']}</div><div class='wrap with-sidebar'><div class='sidebar'>{JUNK['menu']}{JUNK['note']}</div><div class='post-{i} entry'><h1>{title}</h1>{para(lines)}<div class='advert'>{JUNK['ad']}</div></div><div class='comment-list'>{JUNK['talk']}</div></div><div class='site-footer'>Imprint of the site</div></body></html>"


def old_table(title, lines, i):
    cells = "".join(f"<p>{x}" for x in lines)
    return f"<HTML><BODY><TABLE><TR><TD class=menu>{JUNK['menu']}<TD class=text><H1>{title}</H1>{cells}<form><p>Search <input></p></form></TABLE><!-- <p>gone</p> --><script>document.write('<p>no</p>')</script>"


def bare(title, lines, i):
    return f"<h1>{title}</h1>\n{para(lines)}\n<footer>Imprint</footer>"


TEMPLATES = [plain_article, div_layout, old_table, bare]


@pytest.mark.parametrize("template", TEMPLATES)
def test_articles_of_each_layout(spark, template):
    rows, want = [], {}
    for i in range(25):
        title, lines = f"Title {i} of it", blocks(i, 1 + i % 6)
        rows.append((i, f"https://a{i % 2}.example/{i}", template(title, lines, i)))
        want[i] = "\n".join([title, *lines])
    got = {r.page_id: (r.text, r.n_chars) for r in H.digest(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_hosts_with_several_layouts(spark):
    rows, want = [], {}
    for i in range(60):
        title, lines = f"Piece {i}", blocks(i, 2 + i % 3)
        rows.append((i, "http://Mixed.example" + f"?p={i}", TEMPLATES[i % 3](title, lines, i)))
        want[i] = "\n".join([title, *lines])
    assert {r.page_id: r.text for r in H.digest(spark.createDataFrame(rows, KIND)).collect()} == want


def test_the_hosts_path_wins_over_a_page_of_long_comments(spark):
    """Unmarked talk is longer than the article of one page; the host's other pages tell what the article is."""
    page = lambda lines, talk: f"<body><div class='story'>{para(lines)}</div><div class='below'>{para(talk)}</div></body>"
    rows = [(i, "http://x.example/", page(blocks(i), ["Fine."])) for i in range(20)] + [(99, "http://x.example/", page(blocks(99, 3), blocks(98, 4)))]
    rows += [(100, "http://alone.example/", page(blocks(99, 3), ["Fine."] ))]
    got = {r.page_id: r.text for r in H.digest(spark.createDataFrame(rows, KIND)).collect()}
    assert got[99] == "\n".join(blocks(99, 3)) == got[100]


def test_blocks_and_references():
    read = lambda s: H.text_of(s, None)
    assert read("<article><p>a&nbsp;&amp;  b\n\tc</p><p>&lt;x&gt; &#233;&#x1F600; &copy</p></article>") == "a & b c\n<x> é😀 ©"
    assert read("<article><p>one<b>two</b> <i>three</i><br>four<p>five<ul><li>six<li>seven</ul>eight</article>") == "onetwo three four\nfive\nsix\nseven\neight"
    assert read("<article><p>open <b>bold<p>next</article><footer>no</footer>") == "open bold\nnext"
    assert read("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert read("<article><table><tr><td>a<td>b<tr><td>c</table></article>") == "a b\nc"
    assert read("<div><p>kept</p><p style='display: none'>no</p><div hidden>no</div></div>") == "kept"
    assert read("<article>x<script>if (a < b) { '</p>' }</script>y<textarea>no</textarea></article>") == "xy"
    assert read("<article><p>unclosed script<script>var a = '") == "unclosed script"
    assert read("<nav>only a menu</nav>") == "" == read("") == read(None)
    assert read("no markup at all") == "no markup at all"
    assert read("<p>" * 3000 + "deep" + "<div>" * 5000 + "er") == "deep\ner"


def test_equals_plain_consensus(spark):
    """Votes, winners and texts as loops over all pages give them."""
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        url = rnd.choice(["http://a.example/x", "https://B.example:80/y#z", "nothing", None, "http://c.example?x"])
        rows.append((i, url, rnd.choice(TEMPLATES)(f"T {i}", blocks(i, rnd.randrange(1, 5)), i)))
    rows += [(200, "http://a.example/", None), (201, None, ""), (202, "http://a.example/", "<p>" + "x y " * 50000), (None, "http://a.example/", "<p>no id"), rows[0], rows[0]]
    votes = defaultdict(lambda: defaultdict(int))
    name = lambda u: u.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].lower() if u and "://" in u else ""
    for _, url, page in rows:
        for p, s in H.votes_of(page):
            votes[name(url)][p] += int(s * 16 + 0.5)
    paths = {h: [p for p in sorted(v, key=lambda p: (-v[p], -p.count("/"), p)) if v[p] >= H.SHARE * max(v.values())] for h, v in votes.items()}
    docs = spark.createDataFrame(rows, KIND).repartition(6).select("*", *(F.lit("q").alias(c) for c in ("text", "host", "paths", "n_chars", "__host", "path", "main")))
    assert {r.host: r.paths for r in H.consensus(docs).collect()} == paths
    want = sorted(((i, u, H.text_of(h, paths.get(name(u)))) for i, u, h in rows), key=str)
    got = H.digest(docs)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id, r.url, r.text) for r in got.collect()), key=str) == want


def test_empty_table(spark):
    assert H.digest(spark.createDataFrame([], KIND)).collect() == []
