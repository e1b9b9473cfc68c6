"""HTML extraction with site template removal.

A tolerant parser builds a tree of the page's block elements. What HTML itself marks as no part of the
article (menus, footers, asides, forms, scripts, hidden elements, ...) goes with its tag. All else is
decided by counting: Spark hashes element subtrees, counts for each host the distinct pages that hold
each, and deletes subtrees that recur on MIN_PAGES pages and MIN_SHARE of the host's pages. A subtree
has a key of its whole content; one whose class, id or role names it an advert, notice, comment, ... has
also a key of that name alone, as its text differs from page to page. Such a name is template if it
recurs on the host, or on MIN_HOSTS hosts; a name that doesn't recur deletes nothing.

A subtree that holds half of the page's text, the article element itself (without one, the innermost
element with half of the text) and single text blocks (paragraphs, headings) in it are never template
by content: pages that copy one another keep their text. Text outside an article element stays if it
isn't template.

Defined results: null or empty html gives the empty text; a null url is the host of no name; cut-off
and badly nested pages are read as far as they go; repeated rows count as one page and give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from matrixloom.llm.common import cut, lookup, small_batches, table

MIN_PAGES, MIN_SHARE, MIN_HOSTS = 5, 0.001, 3
#: Templates of all hosts up to which they are broadcast, 8 bytes each.
BROADCAST_KEYS = 2_000_000

# Kinds of HTML elements, and words in class, id or role that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROP = frozenset(
    "head script style noscript template iframe object embed applet svg canvas math audio video map nav footer aside form button select option "
    "optgroup datalist textarea fieldset input label legend dialog menu title xmp noembed noframes progress meter".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption tr tbody body html article main br hr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip status".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies responses reactions alert alerts cookie cookiebar cookiebanner cookies consent gdpr disclaimer footer foot menu menus nav navbar "
    "navigation navigational newsletter notice notices notification notifications pager pagination popup modal overlay promo promotion promoted related recommended recommendations share sharing shares sidebar sidebars aside skip social "
    "sponsor sponsored sponsors subscribe subscription signup login toolbar topbar widget widgets print hidden toc".split()
)
TOPS = frozenset("header masthead".split())
#: Words that don't change what a mark beside them says: "ad-box", "comment-list", "related-posts", but not "share-price".
BESIDE = frozenset(
    "area bar block body box button buttons container content entry form group holder inner item items line link links list listing main module outer page pane panel post posts row section site slot stories "
    "articles text thread title top bottom left right unit user wrap wrapper".split()
)
TOKEN = re.compile(
    r"<(?:!--(?:.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))",
    re.DOTALL,
)
ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "children", "drop", "name", "size", "key")

    def __init__(self, tag: str, drop: bool = False, name: str = ""):
        self.tag, self.children, self.drop, self.name, self.size, self.key = tag, [], drop, name, 0, 0


def naming(value: str, inside: bool) -> str:
    """The tokens of a class or id that say, as a whole, that the element is no part of the article."""
    found = []
    for token in value.split():
        words = {w.lower() for w in WORDS.findall(token)}
        marks = words & (MARKS if inside else MARKS | TOPS)
        if marks and words <= marks | BESIDE:
            found.append(" ".join(sorted(words)))
    return " ".join(sorted(set(found)))


def marked(tag: str, attrs: str, inside: bool) -> tuple[bool, str]:
    """Whether the element is no part of the article by what it is, and what it's called if that may be template."""
    names = []
    if tag in DROP or tag == "header" and not inside:
        return True, ""
    if not attrs or attrs.isspace():
        return False, ""
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True, ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, ""
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            names.append(naming(value, inside))
    return False, " ".join(filter(None, names))


def parse(page: str) -> Node:
    """The tree. Inline elements are part of their block's text unless they are marked."""
    root = Node("html")
    stack = [root]
    opened: Counter[str] = Counter()  # tags on the stack: what isn't there needn't be looked for
    at, end = 0, len(page)

    def shut(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in ("html", "body") or not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in INLINE and any(x.tag not in INLINE for x in stack[i + 1 :]):
                        break
                    shut(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    shut(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag][0]):
            ends, wall = CLOSES[tag]
            low = len(stack)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in wall:
                    break
                if stack[i].tag in ends:
                    low = i
                elif low < len(stack):
                    break
            shut(low)
        drop, name = marked(tag, attrs, opened["article"] + opened["main"] > 0)
        if tag in RAW:
            over = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if tag in INLINE and not drop and not name:
            continue
        if tag == "br" or tag == "img":
            stack[-1].children.append(" ")
            continue
        node = Node(tag, drop, name)
        if tag in ("article", "main") and not drop and not name and not opened[tag]:  # what wraps the article isn't what it's called
            for x in stack:
                x.name = ""
        stack[-1].children.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def weigh(node: Node) -> None:
    """size: letters of text below that isn't dropped; key: hash of the subtree, its text's white space collapsed."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if type(c) is not str]
    for x in reversed(order):
        parts, size = [x.tag], 0
        for c in x.children:
            if type(c) is str:
                if t := " ".join(c.split()):
                    parts.append(t)
                    size += len(t)
            else:
                parts.append(str(c.key))
                size += 0 if c.drop else c.size
        x.size = size
        x.key = content_key(parts)


def content_key(parts: list[str]) -> int:
    """A 63-bit number, even; keys of names are odd."""
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) >> 1 & ~1


def name_key(tag: str, name: str) -> int:
    return xxhash.xxh64_intdigest(f"{tag} {name}".encode("utf-8", "surrogatepass")) >> 1 | 1


def articles(tree: Node) -> set[int]:
    """The outermost main and article elements with text; without one the body()."""
    found, todo = set(), [tree]
    while todo:
        x = todo.pop()
        if x.tag in ("article", "main") and not x.name and x.size:
            found.add(id(x))
        todo += [c for c in x.children if type(c) is not str and not c.drop]
    return found or {id(body(tree))}


def body(tree: Node) -> Node:
    """For pages without an article element: the innermost element that isn't a text block and holds half of the text."""
    node = tree
    while inner := [c for c in node.children if type(c) is not str and not c.drop and c.size and c.size * 2 >= tree.size and (c.tag not in TEXT_BLOCKS or c.tag in ("html", "body"))]:
        node = inner[0]
    return node


def candidates(tree: Node) -> dict[int, list[Node]]:
    """Subtrees that may be template, by their keys: by content those with text, but not half of the page's, and no
    text block of an article; by name those that have one and don't hold the article."""
    total = max(1, tree.size)
    article = articles(tree)
    out: dict[int, list[Node]] = {}
    todo = [(c, id(tree) in article) for c in tree.children if type(c) is not str and not c.drop]
    while todo:
        x, inside = todo.pop()
        inside = inside or id(x) in article
        if id(x) not in article:
            if x.name:
                out.setdefault(name_key(x.tag, x.name), []).append(x)
            if x.size and x.size * 2 < total and not (inside and x.tag in TEXT_BLOCKS):
                out.setdefault(x.key, []).append(x)
        todo += [(c, inside) for c in x.children if type(c) is not str and not c.drop]
    return out


def text_of(tree: Node) -> str:
    blocks, buffer = [], []

    def flush() -> None:
        if t := " ".join(entities.unescape("".join(buffer)).split()):
            blocks.append(t)
        buffer.clear()

    todo: list = [tree]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif type(x) is str:
            buffer.append(x)
        elif not x.drop:
            if x.tag in INLINE:
                todo += reversed(x.children)
            else:
                flush()
                todo.append(None)
                todo += reversed(x.children)
    flush()
    return "\n".join(blocks)


def subtrees(page: str | None) -> list[int]:
    """Keys of the page's subtrees that may be template, each once."""
    if not page:
        return []
    tree = parse(page)
    weigh(tree)
    return list(candidates(tree))


def extract(page: str | None, among: Callable[[list[int]], Iterable[int]] = lambda keys: ()) -> str:
    """The main text of a page; among(keys): those that are templates of its host."""
    if not page:
        return ""
    tree = parse(page)
    weigh(tree)
    own = candidates(tree)
    for key in among(list(own)):
        for x in own[key]:
            x.drop = True
    return text_of(tree)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


def with_hashes(pages: DataFrame) -> DataFrame:
    """pages' page_id, url, html, and host (its hash, 0 for none) and page (hash of url and html)."""
    return pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("string"), F.xxhash64(host(F.col("url"))).alias("host"), F.xxhash64("url", "html").alias("page"))


def keys_of(rows: DataFrame) -> DataFrame:
    """host, page, key: of each row its subtrees, and 0 for the page itself."""
    schema = StructType.fromDDL("host long, page long, key long")
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [[0, *subtrees(x)] for x in batch.column(2).to_pylist()]
            n = np.array([len(x) for x in keys], np.int64)
            host, page = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), n) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.int64()), pa.array(page, pa.int64()), pa.array([k for x in keys for k in x], pa.int64())], schema=kinds)

    return rows.select("host", "page", "html").mapInArrow(run, schema)


def templates(keys: DataFrame) -> DataFrame:
    """host, key, n (pages): the templates of each host; those of all hosts under every host that has the name."""
    counts = cut(keys.groupBy("host", "key").agg(F.count_distinct("page").alias("n")), "subtrees")
    pages = counts.where("key = 0").select("host", F.greatest(F.lit(MIN_PAGES), F.ceil(MIN_SHARE * F.col("n"))).alias("least"))
    seen = counts.where("key != 0")
    often = seen.where(F.col("n") >= MIN_PAGES).join(pages, "host").where("n >= least").select("host", "key", "n")
    names = seen.where("key % 2 = 1")
    wide = names.groupBy("key").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= MIN_HOSTS).select("key")
    return often.unionByName(names.join(wide, "key").select("host", "key", "n")).distinct()


def mixed(host: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for a host and a key."""
    x = host.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ key.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def extract_pages(pages: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark, rows = pages.sparkSession, with_hashes(pages)
    keys = keys_of(rows)
    known = cut(templates(keys), "templates")
    schema = StructType.fromDDL("page_id long, url string, text string, n_chars long")
    kinds = to_arrow_schema(schema)

    def result(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=kinds)

    if known.count() <= most:
        got = known.select("host", "key").toPandas()  # the count is checked; no column has nulls
        shared = spark.sparkContext.broadcast(np.sort(mixed(got["host"].to_numpy(np.int64), got["key"].to_numpy(np.int64))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value

            def text(html: str | None, host: int) -> str:
                def among(keys: list[int]) -> list[int]:
                    own = mixed(np.full(len(keys), host, np.int64), np.array(keys, np.int64))
                    at = np.searchsorted(table, own)
                    hit = table[np.minimum(at, len(table) - 1)] == own if len(table) else np.zeros(len(keys), bool)
                    return [keys[i] for i in np.flatnonzero(hit)]

                return extract(html, among)

            for batch in batches:
                yield result(batch, [text(x, h) for x, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])

        return rows.select("page_id", "url", "html", "host").mapInArrow(run, schema)

    # each page's own templates: its keys meet the hosts' templates, then the page; hot keys and hot pages don't go to one task
    both = F.xxhash64("host", "key").alias("t")
    own = cut(keys.where("key != 0").distinct(), "page_keys")
    met = lookup(own.select("host", "page", "key", both), known.select(both, "n"), "t", "n", own.count())
    per = rows.groupBy("host", "page").agg(F.count(F.lit(1)).alias("n"))
    found = per.join(met.groupBy("host", "page").agg(F.collect_set("key").alias("keys")), ["host", "page"], "left")
    named = cut(found.select(F.xxhash64("host", "page").alias("hp"), "n", F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys")), "page_templates")
    whole = lookup(rows.withColumn("hp", F.xxhash64("host", "page")).drop("host", "page"), named, "hp", "n", rows.count())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield result(batch, [extract(x, lambda keys, t=set(t): t.intersection(keys)) for x, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])

    return whole.select("page_id", "url", "html", "keys").mapInArrow(each, schema)


def op9_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_pages(table(spark, sf_dir, "pages"))
