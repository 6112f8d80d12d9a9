"""Main text of web pages by consensus of a host's pages on the path of their article.

Each page is read into a tree. Its containers are named by a generalised path (tags with their classes, digits as ``#``)
and scored by the article text inside them (less for text in an inner container, more with the page's title), times
the share that it has of all text inside them. A page votes with that score for its best container; Spark adds the votes
by (host, path) and keeps each host's strongest paths (``SHARE`` of the best one's votes). A second pass reads every page again and takes the first of its host's paths that the page has text at; a page with none of them,
or on a host without votes, takes its own best container.

Boilerplate inside a container is left out by kind: elements (``nav``, ``aside``, ``form``, ``script`` ...), roles, and
class or id words (``ad``, ``menu``, ``cookie``, ``comments`` ...). Class words don't count on an element that holds the page's
article or title (``layout-with-sidebar``), nor where nothing else would be left. Headings of an article's own ``header`` stay.

Defined results: a null or empty page, and one without article text, gives '' and 0; a null url or one without a host votes with
the pages of host ''; repeated rows vote as often as they occur and repeat their result; ties go to the path first in byte order; ``br`` and table cells
separate words, not blocks; an unclosed element ends with its parent; pages of any length are read whole, in time
and memory proportional to their length; an empty table gives an empty result; columns of any name may come along, they are dropped.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import per_text, small_side, stored

#: Elements whose content is no text of the page, up to their end tag.
_RAW = frozenset("script style textarea title noscript template iframe noframes noembed xmp svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Elements that stand for whole parts of a page and so can hold an article.
_HOLDS = frozenset("article main section div td body".split())
#: Elements that are never part of the article.
_DROP = frozenset("head nav aside footer form menu dialog button select option input label search object audio video canvas map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class or id that mark boilerplate.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination paywall popup promo promoted promotion recommended related respond responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?][^>]*>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
#: An open element of these ends where one of the same set begins, unless a list or table lies between.
_SIBLINGS = {**{t: (frozenset(["li"]), frozenset(["ul", "ol", "menu"])) for t in ["li"]}, **{t: (frozenset(["dd", "dt"]), frozenset(["dl"])) for t in ("dd", "dt")}}
_SIBLINGS |= {"tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"]))}

#: A path counts for a host from this share of the votes of the host's best path on.
SHARE = 0.25
#: Link text counts against a container; text within an inner container counts less for the outer one; the page's title adds
#: this share of the page's text to the containers around it.
LINKS, DECAY, TITLE = 0.3, 0.9, 0.15


class Page:
    """Elements of a page in order of their start tags, and runs of text: (element, text)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.path, self.drop, self.marked, self.heading = ["#"], [-1], [""], [False], [False], [False]
        self.text: list[tuple[int, str]] = []
        self.breaks: list[int] = []  # numbers of text runs before which a block ends
        self.article = [False]
        self._read(source)
        self._weigh()

    def _open(self, tag: str, attributes: str) -> None:
        at = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        classes = sorted(set(_DIGITS.sub("#", at.get("class", "")).split()))
        words = {w.lower() for w in _PART.findall(at.get("class", "") + " " + at.get("id", ""))}
        role = at.get("role", "").lower()
        up = self.parent_now
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(f"{self.path[up]}/{'.'.join([tag, *classes])}")
        hidden = "hidden" in at or at.get("aria-hidden", "") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower()
        self.drop.append(tag in _DROP or role in _ROLES or hidden or tag == "header")
        self.article.append(tag in ("article", "main") or role in ("main", "article") or at.get("itemprop", "") == "articleBody")
        self.marked.append(bool(words & _WORDS) and tag not in ("html", "body"))
        self.parent_now = len(self.tag) - 1

    def _read(self, source: str) -> None:
        self.parent_now = 0
        open_tags: dict[str, int] = {}
        at, end = 0, len(source)

        def shut(i: int) -> None:
            """Close elements up to and with ``i``."""
            while True:
                now = self.parent_now
                open_tags[self.tag[now]] -= 1
                self.parent_now = self.parent[now]
                if now == i:
                    return

        def nearest(tags: frozenset | set, stop: frozenset | set) -> int:
            if not any(open_tags.get(t) for t in tags):
                return 0
            i = self.parent_now
            while i and self.tag[i] not in stop:
                if self.tag[i] in tags:
                    return i
                i = self.parent[i]
            return 0

        while at < end:
            m = _TAG.search(source, at)
            text = source[at : m.start() if m else end]
            if text:
                self.text.append((self.parent_now, text))
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if tag in _BLOCK:
                self.breaks.append(len(self.text))
            elif tag in ("br", "td", "th"):
                self.text.append((self.parent_now, " "))
            if m[1]:
                if i := nearest({tag}, set()):
                    shut(i)
            elif tag in _RAW:
                if not m[3].endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    at = close.end() if close else end
            elif tag not in _VOID:
                if tag in _BLOCK and (i := nearest({"p"}, {"button", "table", "td", "th"})):
                    shut(i)  # a block ends an open paragraph
                if tag in _SIBLINGS and (i := nearest(*_SIBLINGS[tag])):
                    shut(i)
                self._open(tag, m[3])
                open_tags[tag] = open_tags.get(tag, 0) + 1

    def _weigh(self) -> None:
        n = len(self.tag)
        size, links, holds = [0] * n, [0] * n, list(self.article)
        self.decoded = [html.unescape(t) if "&" in t else t for _, t in self.text]
        for (i, _), t in zip(self.text, self.decoded, strict=True):
            size[i] += sum(map(len, t.split()))
        in_link = [False] * n
        in_drop = [False] * n
        in_article = [False] * n
        for i in range(1, n):
            up = self.parent[i]
            in_link[i] = in_link[up] or self.tag[i] == "a"
            in_article[i] = in_article[up] or self.article[i]
            in_drop[i] = in_drop[up] or self.drop[i]
            links[i] = size[i] if in_link[i] else 0
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
        title = next((i for i in range(n) if self.tag[i] == "h1" and not in_drop[i]), 0)
        titled = [False] * n
        while title > 0:
            titled[title], title = True, self.parent[title]
        titled[0] = any(titled)
        self.gone = self._left_out(holds, in_article, titled, True)
        if not any(size[i] and not self.gone[i] for i in range(n)):
            self.gone = self._left_out(holds, in_article, titled, False)
        good, every, credit = [0.0] * n, list(size), [0.0] * n
        for i in range(n - 1, -1, -1):
            if not self.gone[i]:
                own = size[i] - links[i] - LINKS * links[i]
                good[i] += own
                credit[i] += own
            if i:
                good[self.parent[i]] += good[i]
                every[self.parent[i]] += every[i]
                credit[self.parent[i]] += credit[i] * (DECAY if self.tag[i] in _HOLDS else 1)
        self.good, self.every, self.credit, self.titled = good, every, credit, titled

    def _left_out(self, holds: list[bool], in_article: list[bool], titled: list[bool], by_words: bool) -> list[bool]:
        """Which elements are boilerplate or lie in it."""
        n = len(self.tag)
        gone = [False] * n
        for i in range(1, n):
            up = self.parent[i]
            own = self.drop[i] and not (self.tag[i] == "header" and holds[i])
            word = by_words and self.marked[i] and not titled[i] and (in_article[up] or not holds[i] or self.tag[i] == "article")
            heading = self.tag[up] == "header" and in_article[up] and self.tag[i] in ("h1", "h2", "h3", "hgroup")
            gone[i] = (gone[up] and not (heading and not gone[self.parent[up]])) or own or word
        return gone

    def scores(self) -> dict[str, float]:
        """Score by generalised path of the containers; the highest of those that share a path."""
        out: dict[str, float] = {}
        for i in range(len(self.tag)):
            if (self.tag[i] in _HOLDS or not i) and not self.gone[i] and self.good[i] > 0:
                weight = 2.0 if self.article[i] else 1.0
                score = weight * self.credit[i] * self.good[i] / self.every[i] + (TITLE * self.good[0] if self.titled[i] else 0.0)
                out[self.path[i]] = max(out.get(self.path[i], 0.0), score)
        return out

    def extract(self, path: str) -> str:
        """Blocks of the elements at ``path`` without boilerplate, one a line."""
        n = len(self.tag)
        inside = [False] * n
        inside[0] = path == ""
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or (self.path[i] == path and self.tag[i] in _HOLDS)
        blocks, run, edges = [], [], set(self.breaks)
        for k, ((i, _), t) in enumerate(zip(self.text, self.decoded, strict=True)):
            if k in edges and run:
                blocks.append(run)
                run = []
            if inside[i] and not self.gone[i]:
                run.append(t)
        blocks.append(run)
        lines = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def best(scores: dict[str, float]) -> str | None:
    """The path with the highest score; equal ones: the deepest, then the first."""
    return min(scores, key=lambda p: (-scores[p], -p.count("/"), p)) if scores else None


def votes_of(source: str | None) -> list[tuple[str, float]]:
    """A page's vote: the path of its best container with its score; none without text."""
    scores = Page(source or "").scores()
    own = best(scores)
    return [] if own is None else [(own, scores[own])]


def text_of(source: str | None, paths: list[str] | None) -> str:
    """Main text by the first of ``paths`` with text on this page, else by the page's own best container."""
    page = Page(source or "")
    scores = page.scores()
    top = max(scores.values(), default=0.0)
    for path in paths or ():
        if scores.get(path, 0.0) >= SHARE * top > 0:
            return page.extract(path)
    own = best(scores)
    return "" if own is None else page.extract(own)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def consensus(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """``host, paths``: each host's strongest paths, best first. Votes are added map-side, so a hot host is a few rows a task."""

    def run(sources: list[str | None]) -> tuple[list, list]:
        got = [votes_of(s) for s in sources]
        return [[p for p, _ in g] for g in got], [[s for _, s in g] for g in got]

    found = per_text(pages.select(host(F.col("url")).alias("host"), F.col("html").alias("text")), ["host"], "paths array<string>, scores array<double>", run)
    each = found.select("__keep.host", F.explode(F.arrays_zip("paths", "scores")).alias("v")).select("host", "v.paths", "v.scores")
    # whole numbers add up alike in any order
    votes = each.groupBy("host", F.col("paths").alias("path")).agg(F.sum(F.round(F.col("scores") * 16).cast("long")).alias("votes"))
    top = F.max("votes").over(Window.partitionBy("host"))
    kept = votes.withColumn("top", top).where(F.col("votes") >= share * F.col("top"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), (-F.size(F.split("path", "/"))).alias("depth"), "path")))
    return kept.groupBy("host").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))


def extracted(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """``page_id, url, text`` by the hosts' ``paths``."""
    named = small_side(paths.select(F.col("host").alias("__host"), F.col("paths").alias("__paths")), 50_000)  # at most 1 / SHARE paths a host can have so large a share
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("__host")).join(named, "__host", "left")

    def run(sources: list) -> tuple[list]:
        # one column goes to Python: the page and behind it its host's paths
        return ([text_of(s[0] if s else None, s[1:] if s else None) for s in sources],)

    packed = rows.select("page_id", "url", F.concat(F.array("html"), F.coalesce("__paths", F.array().cast("array<string>"))).alias("text"))
    return per_text(packed, ["page_id", "url"], "main string", run).select("__keep.page_id", "__keep.url", F.col("main").alias("text"))


def digest(pages: DataFrame) -> DataFrame:
    """The columns of query ``op13_html_text``."""
    rows = extracted(pages, stored(consensus(pages), "paths"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def oracle_sql() -> str:
    """DuckDB SQL for pages whose article is one ``article`` element of headings and paragraphs with the usual named references."""
    body = "regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1)"
    lines = f"string_split_regex(regexp_replace({body}, '(?i)<br>', ' ', 'g'), '(?i)</?(p|h1|h2|ul|li|div)[^>]*>')"
    plain = "regexp_replace(x, '<[^>]*>', '', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("amp", "&")):
        plain = f"regexp_replace({plain}, '&{name};?', '{char}', 'g')"
    text = f"array_to_string(list_filter(list_transform({lines}, lambda x: trim(regexp_replace({plain}, '\\s+', ' ', 'g'))), lambda y: y <> ''), chr(10))"
    return f"SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, {text} AS text FROM pages)"
