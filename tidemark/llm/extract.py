"""Main text of web pages by paths on which a host's pages agree.

A first pass scores each page's containers by the text without links that their blocks hold, a block's parents in full and
its grandparents by half. Each page votes for the path of tags and classes of its best container; votes are summed by
host, and paths with at least a fifth of a host's votes win, so a host has five at most. A second pass extracts from each
page what lies under the first winning path that it has, or under its own best container where it has none or little there.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go, by their tags, roles and
the words of their class and id; a header within an article that holds its heading stays. A block's white space becomes one
blank, line breaks within a block count as white space, character references are decoded once, blocks are joined by a line
feed. Unclosed and crossing tags are taken as browsers take them. Each row is a page, also repeated ones; null and empty
pages have an empty text, a null url belongs to no host, whose pages vote for nothing together. Text is never cut; equal
scores go to the container that begins first, equal votes to the lesser path. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, durable, salted_join

#: A tag with quoted values, else a comment, else a declaration; a lone < is text.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)|<[!?][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("article main section div td body".split())
GONE_TAGS = frozenset("head nav footer aside form script style textarea title noscript template xmp noembed noframes iframe svg math button select option object canvas audio video menu dialog".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
GONE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription comment comments commentlist disqus respond share sharing social related recommended widget toolbar "
    "pagination pager copyright disclaimer login signup".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
#: Words that say an element only stands beside such a part.
BESIDE = frozenset("has with no without".split())
PARAGRAPH = frozenset(("p",))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What the start of a block closes, where it is open and no other container lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tbody thead tfoot tr td th div section article main body blockquote".split())
IN_HEAD = frozenset("title meta link base style script noscript template".split())
#: A page that holds less than this share of its own best text under a host's path is extracted by its own container.
LEAST_SHARE = 0.5


def words_of(value: str) -> list[str]:
    return re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", value).lower())


class Page:
    """Elements in page order, each with its parent and whether it goes, and blocks of text with the element they lie in."""

    def __init__(self, html: str):
        self.tags, self.parents, self.gone, self.names = ["html"], [-1], [False], [""]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.stack, self.links, self.pieces = [0], 0, []
        at, end = 0, len(html)
        find = TOKEN.finditer
        tokens = find(html)
        while (m := next(tokens, None)) is not None:
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            if (tag := m[2]) is None:
                continue
            tag = tag.lower()
            if m[1]:
                self.close(tag)
            elif tag == "br":
                self.text(" ")
            elif tag not in VOID:
                self.open(tag, m[3])
                if tag in RAW:  # no markup in it: up to its own end tag
                    stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                    at = stop.start() if stop else end
                    tokens = find(html, at)
            elif tag == "hr":
                self.cut()
        if at < end:
            self.text(html[at:])
        self.cut()

    def cut(self) -> None:
        """Ends the current block."""
        if self.pieces:
            whole = unescape("".join(p for p, _ in self.pieces))
            if text := " ".join(whole.split()):
                linked = sum(len(p) for p, in_link in self.pieces if in_link)
                self.blocks.append((self.held, text, linked))
            self.pieces = []

    def text(self, piece: str) -> None:
        if not self.gone[self.stack[-1]]:
            if not self.pieces:
                self.held = next(i for i in reversed(self.stack) if self.tags[i] not in INLINE)
            self.pieces.append((piece, self.links > 0))

    def pop(self, depth: int) -> None:
        """Takes the stack down to so many elements."""
        for i in self.stack[depth:]:
            tag = self.tags[i]
            if tag == "a":
                self.links -= 1
            elif tag not in INLINE:
                self.cut()
        del self.stack[depth:]

    def depth_of(self, tags: set | frozenset, until: frozenset) -> int | None:
        """Where the innermost open element of these tags lies, not looking beyond elements of ``until``."""
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[depth]]
            if tag in tags:
                return depth
            if tag in until:
                return None
        return None

    def open(self, tag: str, attributes: str) -> None:
        if tag == "html" or tag == "body" and "body" in self.tags:
            return
        if tag not in INLINE:
            self.cut()
            if tag not in IN_HEAD and len(self.stack) > 1 and self.tags[self.stack[1]] == "head":
                self.pop(1)
            if (depth := self.depth_of(PARAGRAPH, HOLDS)) is not None:
                self.pop(depth)
            if (closes := CLOSES.get(tag)) and (depth := self.depth_of(closes, HOLDS - closes)) is not None:
                self.pop(depth)
            if tag in HEADINGS and (depth := self.depth_of(HEADINGS, HOLDS)) is not None:
                self.pop(depth)
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        by_word = False
        if found and tag not in ("body", "main"):
            words = {*words_of(found.get("class", "")), *words_of(found.get("id", ""))}
            by_word = words & (COMMENT_WORDS if tag == "article" else GONE_WORDS) and not words & BESIDE
        above = self.stack[-1]
        self.tags.append(tag)
        self.parents.append(above)
        self.gone.append(bool(self.gone[above] or tag in GONE_TAGS or by_word or found and found.get("role", "").lower() in GONE_ROLES))
        if tag in CONTAINERS:
            kinds = sorted({"-".join(words_of(c)) for c in found["class"].split()} - {""}) if "class" in found else ()
            self.names.append(".".join([tag, *kinds]))
        else:
            self.names.append("")
        self.stack.append(len(self.tags) - 1)
        self.links += tag == "a"

    def close(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in INLINE:
            for depth in range(len(self.stack) - 1, 0, -1):
                here = self.tags[self.stack[depth]]
                if here == tag:
                    self.pop(depth)
                    return
                if here not in INLINE:
                    return
            return
        until = frozenset(("table", "td")) if tag not in ("table", "td", "tr", "tbody") else frozenset()
        if (depth := self.depth_of({tag}, until - {tag})) is not None:
            self.pop(depth)
        else:
            self.cut()

    def path(self, element: int) -> str:
        """Names of the containers from the outermost to this one."""
        out = []
        while element >= 0:
            if self.names[element]:
                out.append(self.names[element])
            element = self.parents[element]
        return ">".join(reversed(out))

    def headers(self) -> None:
        """A header goes with its blocks, unless it lies in an article and holds a heading."""
        if "header" not in self.tags:
            return
        kept = set()
        for element, _, _ in self.blocks:
            chain = self.above(element)
            tags = [self.tags[i] for i in chain]
            if "header" in tags and HEADINGS & set(tags) and "article" in tags[tags.index("header") :]:
                kept.add(chain[tags.index("header")])
        self.blocks = [b for b in self.blocks if all(self.tags[i] != "header" or i in kept for i in self.above(b[0]))]

    def above(self, element: int) -> list[int]:
        out = []
        while element >= 0:
            out.append(element)
            element = self.parents[element]
        return out

    def best(self) -> int:
        """The container with the most text of its own, an article or main part counting fourfold; the whole page (0) if none.

        Within an article or main part it is that part; else the nearest container around it with more than half of the page's text.
        """
        held: dict[int, int] = {}
        for element, text, linked in self.blocks:
            held[element] = held.get(element, 0) + max(0, len(text) - 2 * linked)
        scores, below = dict.fromkeys(held, 0), dict.fromkeys(held, 0)
        for element, size in held.items():
            share = 4 * size
            for i in self.above(element):
                below[i] = below.get(i, 0) + size
                if share and self.names[i]:
                    part = self.tags[i] in ("article", "main")
                    scores[i] = scores.get(i, 0) + (4 * share if part else share)
                    share = 0 if part else share // 2
        top = max((i for i in scores if self.names[i] and scores[i]), key=lambda i: (scores[i], -i), default=0)
        for tag in ("article", "main"):
            for i in self.above(top):
                if self.tags[i] == tag:
                    return i
        return next((i for i in self.above(top) if self.names[i] and 2 * below[i] > below[0]), 0)

    def below(self, elements: set[int]) -> list[str]:
        """The blocks under any of these elements, in page order."""
        under = {e: not elements.isdisjoint(self.above(e)) for e in {b[0] for b in self.blocks}}
        return [text for element, text, _ in self.blocks if under[element]]

    def at_path(self, path: str) -> set[int]:
        last = path.rsplit(">", 1)[-1]
        return {i for i, name in enumerate(self.names) if name == last and not self.gone[i] and self.path(i) == path}


def parsed(html: str) -> Page:
    page = Page(html)
    page.headers()
    return page


def main_text(html: str, paths: list[str]) -> tuple[str, bool]:
    """The text of a page whose host agrees on these paths, and whether one of them gave it."""
    page = parsed(html)
    own = page.below({page.best()})
    for path in paths:
        if chosen := page.at_path(path):
            text = page.below(chosen)
            if sum(map(len, text)) >= LEAST_SHARE * sum(map(len, own)):
                return "\n".join(text), True
    return "\n".join(own), False


def host_of(url: Column) -> Column:
    """What stands behind the first :// up to the next / ? or #, A-Z in lower case; empty without ://."""
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def page_rows(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), host_of(url).alias("host"), F.col("html").cast("string").alias("html"))


def host_paths(rows: DataFrame, share: float = 0.2) -> DataFrame:
    """host, paths: the paths with at least this share of a host's votes, most votes first."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for html in batch.column("html").to_pylist():
                page = parsed(html or "")
                top = page.best()
                paths.append(page.path(top) if top else None)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    votes = rows.where("host <> ''").select("host", "html").mapInArrow(vote, "host string, path string").where("path is not null")
    counts = durable(votes.groupBy("host", "path").agg(F.count("*").alias("votes")), "host-votes")
    least = counts.groupBy("host").agg((F.sum("votes") * share).alias("least"))
    ranked = counts.join(least, "host").where(F.col("votes") >= F.col("least")).groupBy("host")
    return ranked.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "path"))), lambda x: x["path"]).alias("paths"))


def extracted(pages: DataFrame, share: float = 0.2, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text, n_chars, by_consensus of pages(page_id, url, html).

    Winning paths go to all executors if they take at most broadcast_bytes, which is measured; else pages meet them in a
    join that deals a large host over many tasks.
    """
    bounded_batches(pages)
    rows = page_rows(pages)
    winners = durable(host_paths(rows, share), "host-paths")
    size = winners.agg(F.sum(F.length("host") + F.length(F.concat_ws(">", "paths")) + 64)).first()[0] or 0
    met = rows.join(F.broadcast(winners), "host", "left") if size <= broadcast_bytes else salted_join(rows, winners, "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html or "", paths or []) for html, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([c for _, c in texts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "by_consensus"])

    return met.select("page_id", "url", "html", "paths").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, by_consensus boolean")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
