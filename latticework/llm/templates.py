"""Main text of web pages by site template removal.

Each page is parsed once into blocks of text. Every element, and every box inside an article, is
hashed as a subtree (tags, classes and text); Spark counts in how many different pages of its host each subtree
occurs, and subtrees that recur are deleted with all they hold: in ``least`` pages, or in as many as
the binary logarithm of the host's pages if that is more. What is never main text by its element,
role or class goes in any case: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments.

Within an article only boxes (``BOXES``) can be templates: its own paragraphs, headings and lists are
main text however often they recur, as copied pages and quoted passages do. A page that would lose
more than half of its article is a copy and keeps it.

An ``article`` or ``main`` element is a hint only: where it holds half or more of what is left of
the page, it is the main text alone, else all that is left is. Pages whose article (or, where that is
the smaller part, whose whole text) is equal count once for a subtree, so copies of a page don't make
its paragraphs a template.

Character references are decoded, white space within a block becomes one space, and blocks are
joined in page order by two line feeds. A null html has an empty text; so has a page without any
main text. Null and odd urls share an empty host, where nothing is a template. Rows are kept one by
one: ties, repeated rows and repeated or null ids stay; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field as attribute
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import column, field, map_batches, materialise, own_name

# Parts of a tag; none of them gives back what it has matched, so a scan takes time in proportion.
BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)>")
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
GAP = re.compile(r"[\s/]*+")
NAME = re.compile(r"=?[^\s/>=]*+")
EQUALS = re.compile(r"\s*+=\s*+")
PLAIN = re.compile(r"[^\s>]*+")
# Elements as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}
# What is never main text.
DROP_TAGS = frozenset("script style noscript template iframe object embed svg canvas audio video form button select option input textarea nav aside footer head dialog".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
# Names that can only mean something else than main text; recurrence decides about all others.
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements sponsored gdpr cookie newsletter"
    " nav navbar breadcrumb breadcrumbs pagination pager sidebar masthead footer"
    " comment comments commentlist disqus".split()
)
CONTENT = ("article", "main")
BOXES = frozenset("div section details figure".split())  # what is counted within an article: not its prose
BUCKETS = 1 << 20
DEEPEST = 512  # elements below are siblings, as in browsers; all their text stays
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    dropped: bool
    own: bool  # within the page's own article
    inline: bool
    sign: str = ""
    number: int = -1  # of its subtree, -1 if it isn't counted by itself
    parts: list[str] = attribute(default_factory=list)


@dataclass
class Page:
    """Blocks in page order: text and whether in an article; hash, first block and past block of
    each counted subtree."""

    blocks: list[tuple[str, bool]]
    subtrees: list[list[int]]


def is_dropped(tag: str, attributes: dict[str, str], in_own: bool) -> bool:
    if tag in DROP_TAGS:
        return True
    if tag in ("header", "menu") and not in_own:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if attributes.get("role", "").lower() in DROP_ROLES:
        return True
    if tag in ("body", "html") or tag in CONTENT:
        return False
    if in_own:  # whole class names only
        names = attributes.get("class", "").lower().split()
    else:
        names = WORDS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
    return not DROP_WORDS.isdisjoint(names)


def next_tag(html: str, pos: int, last: dict[str, int]) -> tuple[int, int, bool, str, dict[str, str], bool] | None:
    """(from, to, end tag, name, attributes, ``/`` before ``>``) of the first tag from ``pos`` on, by
    HTML's states of attributes: a quote opens a value right after ``=`` only. ``last`` has the last
    place of each quote, so that one that is never closed is a sign like others and no sign is read
    twice. Comments, declarations and unfinished tags have no name."""
    while (at := html.find("<", pos)) >= 0:
        if m := BARE.match(html, at):
            return at, m.end(), bool(m[1]), m[2].lower(), {}, False
        if m := OPEN.match(html, at):
            pos, attributes = m.end(), {}
            while True:
                gap = GAP.match(html, pos)
                pos = gap.end()
                if pos >= len(html):
                    return at, pos, False, "", {}, False
                if html[pos] == ">":
                    return at, pos + 1, bool(m[1]), m[2].lower(), attributes, gap[0].endswith("/")
                name = NAME.match(html, pos)
                pos, value = name.end(), ""
                if eq := EQUALS.match(html, pos):
                    pos = eq.end()
                    quote = html[pos : pos + 1]
                    if last.get(quote, -1) > pos:
                        end = html.index(quote, pos + 1)
                        value, pos = html[pos + 1 : end], end + 1
                    else:
                        plain = PLAIN.match(html, pos)
                        value, pos = plain[0], plain.end()
                attributes.setdefault(name[0].lower(), entities.unescape(value))
        for start, stop in (("<!--", "-->"), ("<!", ">"), ("<?", ">"), ("</", ">")):
            if html.startswith(start, at):
                end = html.find(stop, at + len(start))
                return at, end + len(stop) if end >= 0 else len(html), False, "", {}, False
        pos = at + 1  # a sign of the text
    return None


def parse(html: str) -> Page:
    """One pass over the tags, closing elements as browsers do."""
    root = Node("", False, False, False)
    stack, blocks, subtrees = [root], [], []
    buffer: list[str] = []
    there: Counter[str] = Counter()  # open elements by tag
    pos = 0

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
        buffer.clear()
        top = stack[-1]
        if text and not top.dropped:
            blocks.append((text, top.own))

    def say(text: str) -> None:
        if text:
            top = stack[-1]
            if not top.dropped:
                buffer.append(text)
                top.parts.append(SPACE.sub(" ", text))

    def close(n: int) -> None:
        """Close the innermost ``n`` elements."""
        for _ in range(n):
            if not stack[-1].inline:
                flush()
            node = stack.pop()
            there[node.tag] -= 1
            if node.sign:
                whole = f"{node.sign}{''.join(node.parts)}</>"
                digest = xxhash.xxh3_64_intdigest(whole.encode("utf-8", "surrogatepass")) - (1 << 63)
                if node.number >= 0:
                    subtrees[node.number][::2] = digest, len(blocks)
                stack[-1].parts.append(f"{digest:x}")
            elif node.tag in INLINE:
                node.parts.append("</>")

    def depth_of(tags: set[str], scope: set[str]) -> int:
        """How many elements to close to end the innermost of ``tags`` within ``scope``."""
        if any(there[t] for t in tags):
            for k in range(1, len(stack)):
                if stack[-k].tag in tags:
                    return k
                if stack[-k].tag in scope:
                    return 0
        return 0

    def opened(tag: str, attributes: dict[str, str], slash: bool, pos: int) -> int:
        """Begin an element; where to read on."""
        if tag in VOID:
            if tag not in INLINE:
                flush()
            else:
                say(" " if tag in ("br", "wbr", "img") else "")
            return pos
        if tag in CLOSES_P:
            close(depth_of({"p"}, {"article", "main", "div", "section", "td", "li", "body", "table", "button"}))
        if tag in SIBLINGS:
            close(depth_of(SIBLINGS[tag], SCOPES[tag]))
        close(max(0, len(stack) - DEEPEST))
        up = stack[-1]
        inline = tag in INLINE
        dropped = up.dropped or is_dropped(tag, attributes, up.own)
        own = up.own or (tag in CONTENT and not dropped)
        if not inline or dropped != up.dropped:
            flush()
        node = Node(tag, dropped, own, inline and dropped == up.dropped)
        if inline:  # its text belongs to the subtree of the block around it
            node.parts = up.parts
            node.parts.append(f"<{tag}>")
        if not dropped and not inline and tag not in ("html", "body", "head"):
            node.sign = f"<{tag} {attributes.get('class', '')}>"
            if not up.own or tag in BOXES:
                node.number = len(subtrees)
                subtrees.append([0, len(blocks), 0])
        stack.append(node)
        there[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*+>", re.I).search(html, pos)
            if not dropped and tag != "title":
                say(html[pos : end.start() if end else len(html)])
            pos = end.end() if end else len(html)
            close(1)
        elif slash and tag in ("svg", "path"):
            close(1)
        return pos

    last = {q: html.rfind(q) for q in "\"'"}
    while found := next_tag(html, pos, last):
        at, end, closing, tag, attributes, slash = found
        say(html[pos:at])
        pos = end
        if closing:
            if tag == "br":
                say(" ")
            elif tag not in VOID:
                close(depth_of({tag}, set() if tag not in INLINE else {"article", "main", "div", "section", "td", "li", "body"}))
        elif tag:
            pos = opened(tag, attributes, slash, pos)
    say(html[pos:])
    close(len(stack) - 1)
    flush()
    return Page(blocks, subtrees)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url).hostname or "") if url else ""
    except ValueError:
        return ""


def parsed(pages: DataFrame, *, carry: list[str], url: str, html: str) -> DataFrame:
    """``carry`` and a struct ``_p``: uid, host, digest (of the main blocks), blocks and the subtrees
    that hold any, with their first and past block."""
    inner = T.StructType([field("uid", "bigint"), field("host", "string"), field("digest", "bigint"), field("blocks", "array<struct<text:string,own:boolean>>"), field("subtrees", "array<struct<hash:bigint,first:int,past:int>>")])
    own = [own_name(pages, x) for x in ("_uid", "_url", "_html")]
    schema = T.StructType([*[pages.schema[c] for c in carry], field(own_name(pages, "_p"), inner)])
    kind = to_arrow_schema(T.StructType([field("p", inner)])).field(0).type

    def run(batches):
        for b in batches:
            out = []
            for uid, url_, raw in zip(*(column(b, n).to_pylist() for n in own), strict=True):
                page = parse(raw or "")
                all_, mine = "\n\n".join(t for t, _ in page.blocks), "\n\n".join(t for t, inside in page.blocks if inside)
                main = mine if 2 * len(mine) >= len(all_) else all_
                out.append({
                    "uid": uid, "host": host_of(url_), "digest": xxhash.xxh3_64_intdigest(main.encode("utf-8", "surrogatepass")) - (1 << 63),
                    "blocks": [{"text": t, "own": inside} for t, inside in page.blocks],
                    "subtrees": [{"hash": h, "first": a, "past": z} for h, a, z in page.subtrees if z > a],
                })
            yield [*[b.column(i) for i in range(len(carry))], pa.array(out, kind)]

    picked = pages.select(*carry, F.monotonically_increasing_id().alias(own[0]), F.col(url).alias(own[1]), F.col(html).alias(own[2]))
    return materialise(map_batches(picked, run, schema, text=own[2]), "parsed")


def templates(rows: DataFrame, p: str, *, least: int = 5) -> DataFrame:
    """``host, subtree, pages``: subtrees in at least ``least`` different pages of the host, and in
    no fewer than the binary logarithm of its pages. Counts are summed within tasks before they are dealt."""
    r = F.col(p)
    there = rows.filter(r["host"] != "").select(r["host"].alias("host"), r["digest"].alias("digest"), F.array_distinct(r["subtrees"]["hash"]).alias("subtrees"))
    pages = there.select("host", "digest").distinct().groupBy(F.col("host").alias("h")).agg(F.count("*").alias("of"))
    seen = there.select("host", "digest", F.explode("subtrees").alias("subtree")).distinct().groupBy("host", "subtree").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)
    return seen.join(pages, F.col("host") == F.col("h")).filter(F.col("pages") >= F.log2("of")).select("host", "subtree", "pages")


def extract(pages: DataFrame, *, url: str = "url", html: str = "html", carry: list[str] | None = None, least: int = 5) -> DataFrame:
    """``carry`` (all columns but ``html`` if None) and ``text`` (or longer, if that is taken)."""
    carry = [c for c in pages.columns if c != html] if carry is None else carry
    rows = parsed(pages, carry=carry, url=url, html=html)
    p = rows.columns[-1]
    r = F.col(p)
    found = templates(rows, p, least=least)
    there = rows.select(r["uid"].alias("uid"), r["host"].alias("host"), F.explode(r["subtrees"]).alias("t"))
    gone = there.join(found.select(F.col("host").alias("h"), F.col("subtree").alias("s")), (F.col("host") == F.col("h")) & (F.col("t.hash") == F.col("s"))).groupBy(F.col("uid").alias("of")).agg(F.collect_set(F.struct("t.first", "t.past")).alias("_gone"))
    gone = materialise(gone, "gone")
    # pages that hold no template aren't dealt out; the table of buckets has ``BUCKETS`` rows at most
    bucket = lambda uid: F.pmod(F.xxhash64(uid), F.lit(BUCKETS)).cast("int")
    used = gone.select(bucket(F.col("of")).alias("_b")).distinct()
    hit = bucket(r["uid"]) == F.col("_b")
    dealt = rows.join(F.broadcast(used), hit, "left_semi").join(gone.hint("merge"), r["uid"] == F.col("of"), "left")
    whole = rows.join(F.broadcast(used), hit, "left_anti").withColumn("_gone", F.lit(None).cast(gone.schema["_gone"].dataType))
    name = "text"
    while name in carry:
        name = f"_{name}"
    together = lambda blocks: F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
    kept = F.filter(r["blocks"], lambda _, i: ~F.coalesce(F.exists("_gone", lambda g: (g["first"] <= i) & (i < g["past"])), F.lit(False)))
    whole_, mine, all_ = together(F.filter(r["blocks"], lambda b: b["own"])), together(F.filter(kept, lambda b: b["own"])), together(kept)
    mine = F.when(2 * F.length(mine) < F.length(whole_), whole_).otherwise(mine)
    text = F.when(2 * F.length(mine) >= F.length(all_), mine).otherwise(all_)
    cols = [F.col(c) for c in carry]
    return whole.select(*cols, text.alias(name)).unionByName(dealt.select(*cols, text.alias(name)))
