"""Main text of web pages by container paths that the pages of a host agree on.

First scan: each page's containers are scored, and every container near the page's best one is a vote for its path, the tags,
classes and ids from the root with numbers made alike. Spark sums the votes by host and path and takes a host's winning path. Second
scan: the text is taken anew from the containers at the winning path; a page that has none there is read from its own best container.

Score of a container: the sum over its blocks of the length of their text less twice that of links and, outside of headings and of
article elements, less SHORT, so that long paragraphs add to it and short or linked blocks take from it; what the markup
names as no part of an article (menus, headers, footers, asides, forms, adverts, notices, comments, by tag, role, class or id)
takes its whole length, and is never text. An article or main element weighs a quarter more. The header of an article keeps its
headings alone.

The winners are broadcast where they are WINNERS at most, else joined by salted host, so that no host's pages need share a task.

Defined results: null html or html without an article gives empty text; unclosed tags end where HTML lets them end, or with their
parent, and elements nested more than DEEP times are not told apart; a script, style or comment that never ends reaches to the end; references are decoded as HTML5 says, unknown ones stay;
pages without a host (null or odd url) vote together as one; of paths with equal votes the longer one wins, then the smaller; repeated rows each get
their text; an empty table gives no rows; other columns, whatever their names, are not read. A page is one Python string in memory.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm._store import written
from strandflow.llm._text import slices

SHORT, NEAR, SHARP, SALTS, WINNERS, DEEP, LEVELS = 25, 0.5, 8, 32, 200_000, 500, 48
# fixed values: elements of HTML by role in a page
RAW = "script style noscript template textarea title iframe svg select object canvas video audio head".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption section article main nav header footer aside form fieldset legend details summary address hr center menu dialog hgroup search".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
DROPPED = frozenset("nav header footer aside form fieldset button menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NOISE = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr
    notice notices notification alert popup popover modal overlay lightbox newsletter subscribe subscription signup paywall nav navbar navigation menu
    submenu menubar breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer foot header masthead topbar toolbar comment comments commentlist disqus
    respond replies reply share sharing social related recommended recommendations pagination pager login search searchform hidden toc""".split()
)
TALK = frozenset("comments comment comment-list commentlist comments-area comment-section disqus_thread respond".split())
STORY = frozenset("article content entry post story".split())
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NUMBER, _HIDDEN, _BODY = re.compile(r"\d+"), re.compile(r"(?:^|\s)hidden(?:\s|$|=)"), re.compile(r"<body\b", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*+>", re.I) for t in RAW}


@dataclass
class Node:
    """A block-level element. first, last: its blocks are [first, last) of the page's; noise: it is no part of an article;
    named: its class, id or role names noise; head: it is a header, of an article if `own`."""

    tag: str
    path: str
    up: int
    noise: bool = False
    named: bool = False
    head: bool = False
    own: bool = False
    first: int = 0
    last: int = 0


@dataclass
class Block:
    text: str
    linked: int
    node: int


def _node(tag: str, raw: str, up: int, above: str, level: int, first: int) -> Node:
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)} if "=" in raw else {}
    names = found.get("class", "").split()
    words = {w.lower() for n in [*names, found.get("id", "")] for w in _WORDS.findall(n)}
    unseen = found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower() or bool(_HIDDEN.search(raw))
    talk = not TALK.isdisjoint([*names, found.get("id", "")]) and tag not in ("html", "body", "main", "article")
    kind = _NUMBER.sub("0", "".join(f".{n}" for n in sorted(names)) + (f"#{found['id']}" if "id" in found else ""))
    path = f"{above}/{tag}{kind}" if level <= LEVELS else above
    named = found.get("role", "").lower() in ROLES or not NOISE.isdisjoint(words)
    return Node(tag, path, up, tag in DROPPED or unseen or talk, named, tag == "header" or "header" in words, not STORY.isdisjoint(words), first)


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """The page's block elements, in order, and its blocks of text: what stands between two tags of block elements."""
    nodes, blocks, at = [Node("", "", -1)], [], 0
    stack, text, links, inside = [0], [], 0, 0

    def end_block() -> None:
        nonlocal links
        said = " ".join(html.unescape("".join(text)).split())
        if said:
            blocks.append(Block(said, min(links, len(said)), stack[-1]))
        text.clear()
        links = 0

    def close(tags: set[str], within: set[str]) -> None:
        nonlocal inside
        for depth in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[depth]].tag
            if tag in tags:
                for n in stack[depth:]:
                    nodes[n].last = len(blocks)
                del stack[depth:]
                inside = inside if inside <= depth else 0
                return
            if tag in within:
                return

    while at < len(page):
        m = _TOKEN.search(page, at)
        said = page[at : m.start() if m else len(page)]
        if said:
            text.append(said)
            links += len(said) if inside else 0
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW_END:
            end = None if closing else _RAW_END[tag].search(page, at)
            if not closing and tag == "head":
                body = _BODY.search(page, at)
                at = min([x for x in (end and end.end(), body and body.start()) if x is not None], default=at)
            elif not closing and not m[3].endswith("/"):
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            inside = 0 if closing else len(stack)
        if tag == "br":
            text.append(" ")
        if tag not in BLOCK and tag != "button":
            continue
        end_block()
        if closing:
            close({tag}, {"table", "td", "article"} if tag not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "article", "body", "html") else set())
            continue
        if tag in ENDS_P:
            close({"p"}, {"div", "td", "th", "article", "section", "button", "blockquote", "li"})
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE[tag])
        if tag in VOID:
            continue
        if len(stack) <= DEEP:
            nodes.append(_node(tag, m[3], stack[-1], nodes[stack[-1]].path, len(stack), len(blocks)))
            stack.append(len(nodes) - 1)
    end_block()
    for n in stack:
        nodes[n].last = len(blocks)
    return nodes, blocks


def mark(nodes: list[Node]) -> list[bool]:
    """Settles which elements are noise; whether each is in an article. Names make noise only of what holds no article that is free of them."""
    story = [n.tag in ("article", "main") for n in nodes]
    holds = [s and not n.named and not n.noise for s, n in zip(story, nodes, strict=True)]
    for k in range(len(nodes) - 1, 0, -1):
        holds[nodes[k].up] |= holds[k] and not nodes[k].noise
    within = [False] * len(nodes)
    for k, n in enumerate(nodes[1:], 1):
        up = nodes[n.up]
        n.noise |= n.named and not holds[k] and not story[k] and n.tag not in ("html", "body")
        if up.noise:
            n.noise = not (up.head and (within[n.up] or up.own) and n.tag in HEADING and not n.named)
            n.head, n.own = n.head or up.head, up.own or within[n.up]
        within[k] = (within[n.up] or story[k]) and not (story[k] and n.noise)
    return within


def scores(nodes: list[Node], blocks: list[Block]) -> list[float]:
    """The score of every element; marks what is noise."""
    within, sums = mark(nodes), [0]
    for b in blocks:
        n = nodes[b.node]
        sums.append(sums[-1] + (-len(b.text) if n.noise else len(b.text) - 2 * b.linked - (0 if within[b.node] or n.tag in HEADING else SHORT)))
    return [(sums[n.last] - sums[n.first]) * (1.25 if n.tag in ("article", "main") else 1.0) if not n.noise and n.tag not in ("p", *HEADING) else float("-inf") for n in nodes]


def votes(page: str) -> list[tuple[str, int]]:
    """(path, vote) of the containers near the best one, which has 1000, others much less; all, so that nothing depends on their order."""
    nodes, blocks = parse(page)
    score = scores(nodes, blocks)
    best = max(score, default=0)
    out: dict[str, int] = {}
    for n, s in zip(nodes, score, strict=True):
        if best > 0 and s >= NEAR * best:
            out[n.path] = max(out.get(n.path, 0), int(1000 * (s / best) ** SHARP))
    return sorted(out.items())


def article(page: str, path: str | None) -> str:
    """The text of the containers at the path that score above 0, else of the best one there, else of the page's best container."""
    nodes, blocks = parse(page)
    score = scores(nodes, blocks)
    there = [k for k, n in enumerate(nodes) if n.path == path and score[k] > float("-inf")]
    chosen = [k for k in there if score[k] > 0] or [max(there or range(len(nodes)), key=lambda k: (score[k], k))]
    out, seen = [], 0
    for k in chosen:
        out += [b.text for b in blocks[max(nodes[k].first, seen) : nodes[k].last] if not nodes[b.node].noise]
        seen = max(seen, nodes[k].last)
    return "\n\n".join(out)


def host_of(url: str = "url") -> F.Column:
    """The host of a url, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path): the winning path of every host with a vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "html"):
                hosts = b.column(0).to_pylist()
                rows = [(hosts[i], path, vote) for i, said in enumerate(b.column(1).to_pylist()) for path, vote in votes(said or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["host", "path", "vote"])

    cast = pages.select(host_of(url).alias("host"), F.col(page).alias("html")).mapInArrow(run, "host string, path string, vote long")
    total = cast.groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    best = F.min_by("path", F.struct(-F.col("votes"), -F.length("path"), "path"))
    return total.groupBy("host").agg(best.alias("path"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", most: int = WINNERS) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), host_of(url).alias("host"))
    winners = written(host_paths(pages, url, page), "paths")
    if winners.count() <= most:
        joined = p.join(F.broadcast(winners), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = p.withColumn("salt", salt).join(winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "html"):
                said = [article(h or "", path) for h, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array([len(t) for t in said], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")
