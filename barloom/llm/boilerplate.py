"""Main text of web pages: site templates, found by counting element subtrees per host, and boilerplate go.

A page becomes a tree. Each element subtree gets a hash of its tags, classes and text; Spark
counts on how many pages of its host it occurs, and subtrees that recur across many of them
are the site's template. Pages of one main part count as one, so copies of a page don't make
its parts a template. Extraction first deletes template subtrees from the whole page, also
within articles; then it takes the page's article if it marks one (else its main part, else
its body), deletes what is boilerplate by tag, role, class or id (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments), and gives the text.

Inside an article or main part a recurring paragraph, heading or inline element is content,
as sites do repeat passages; all other elements that recur go there too. A subtree with half
of a page's text or more is never taken for template, and if it holds the heading or main
part it isn't boilerplate by tag or name either: it is a wrapper of the page. A class that
only speaks of boilerplate (`comments-open`, `content-sidebar-wrap`) isn't taken for it.

Counting is by partial sums, so a host with a third of all pages is no hot key. What recurs
in a share of a host's pages is at most subtrees per page / that share, so a host's list is
bounded. Lists meet the pages by broadcast below a checked size, else in a join that
spreads each host over several salts.

Null and empty html give an empty text. A null url is a host of its own. A host of fewer
than LEAST_PAGES different pages has no template. Repeated rows are extracted each for
itself; further columns, whatever their names, are left out unless they are asked for.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .urlfilter import parts

#: A subtree is template if so many pages of its host have it, and such a share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.2
SALTS = 16

# Elements of HTML by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
GONE = set("nav footer aside form script style noscript template iframe object embed button select textarea input svg canvas menu dialog head title audio video".split())
#: What stays in an article or main part though it recurs.
KEPT = set("p h1 h2 h3 h4 h5 h6".split()) | INLINE
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of class and id names that mark boilerplate.
MARKS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments commentlist reply replies disqus respond discussion related recommended recommendations search searchbox pagination pager widget toolbar masthead skiplink".split()
)
HEADS = {"header", "banner"}
# Words of such names that say where or what kind of box it is, and words that say how something else is.
NEUTRAL = set("area bar block bottom box buttons button column container floating global group inner item items left links list main page panel post posts primary right section secondary site slot sticky the top user widget wrap wrapper".split())
STATES = set("allow allowed closed disabled enabled has hide is no not off on open show with without".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[a-zA-Z/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SCOPES = {"article", "main", "section", "div", "td", "th", "li", "dd", "blockquote", "body", "figure", "aside", "nav", "header", "footer", "form", "button"}


class Node:
    __slots__ = ("tag", "names", "parent", "kids", "hash", "size", "head")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None):
        self.tag, self.names, self.parent, self.kids = tag, names, parent, []


def attributes(raw: str) -> tuple[str, ...]:
    """What of a tag's attributes matters: names of class and id as words joined by `-`, role:..., hidden:, body: for an itemprop."""
    if "=" not in raw and "hidden" not in raw:
        return ()
    out: list[str] = []
    for key, value in ATTRIBUTE.findall(raw):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            out += ["-".join(w.lower() for w in NAMES.findall(part)) for part in value.split()]
        elif key == "role":
            out.append(f"role:{value.strip().lower()}")
        elif key == "hidden":
            out.append("hidden:")
        elif key == "itemprop" and value.lower() == "articlebody":
            out.append("body:")
    return tuple(out)


@functools.lru_cache(100_000)
def tells(name: str, marks: str) -> bool:
    """Whether a class or id names boilerplate (or a header): a name of one or two words by either, a longer one by its last word, or by all but neutral ones."""
    words = [w for w in name.split("-") if len(w) > 1]
    known = MARKS if marks == "marks" else HEADS
    if known.isdisjoint(words) or not STATES.isdisjoint(words):
        return False
    return len(words) <= 2 or words[-1] in known or all(w in known or w in NEUTRAL for w in words)


def parse(html: str) -> Node:
    """The page as a tree; tags that weren't closed are closed where HTML closes them, or with their parent."""
    root = node = Node("#page", (), None)
    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            node.kids.append(html[at:])
            break
        if m.start() > at:
            node.kids.append(html[at : m.start()])
        at = m.end()
        closed, opened = m.group(1), m.group(2)
        if closed:
            tag = closed.lower()
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if not opened:
            continue
        tag = opened.lower()
        if tag not in INLINE and tag != "br":
            up = node  # an open paragraph ends where a block starts
            while up is not root and up.tag not in SCOPES:
                if up.tag == "p":
                    node = up.parent
                    break
                up = up.parent
        if tag in CLOSES:
            up = node
            while up is not root and up.tag not in WALLS[tag]:
                if up.tag in CLOSES[tag]:
                    node = up.parent
                up = up.parent
        raw = m.group(3)
        child = Node(tag, attributes(raw) if raw else (), node)
        node.kids.append(child)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            child.kids.append(html[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID:  # a slash at the end of a tag means nothing in HTML
            node = child
    return root


def walk(root: Node) -> list[Node]:
    """Every element, parents first."""
    out, left = [], [root]
    while left:
        n = left.pop()
        out.append(n)
        left += [k for k in reversed(n.kids) if type(k) is Node]
    return out


def hashes(root: Node) -> list[Node]:
    """Give each element its subtree's hash and amount of text, and whether it holds the page's heading or main part."""
    nodes = walk(root)
    for n in reversed(nodes):
        parts_, size, head = [n.tag, *n.names], 0, n.tag in ("h1", "main")
        for k in n.kids:
            if type(k) is Node:
                parts_.append(k.hash)
                size += k.size
                head = head or k.head
            else:
                t = " ".join(k.split())
                if t:
                    parts_.append(t)
                    size += len(t) if n.tag not in GONE else 0
        n.size, n.head = size, head
        n.hash = xxhash.xxh3_64_hexdigest("\x00".join(parts_))
    return nodes


def boilerplate(n: Node, inside: bool, whole: int) -> bool:
    """Whether an element is boilerplate by tag, role, class or id. whole: the page's amount of text."""
    if n.tag in ("html", "body", "main", "#page"):
        return False
    if n.tag == "form" and 10 * n.size >= 9 * whole > 0 or n.head and 2 * n.size >= whole > 0:
        return False
    if n.tag in GONE:
        return True
    names = n.names
    if n.tag == "header" or any(tells(x, "heads") for x in names):
        if not (inside and any(k.tag == "h1" for k in walk(n))):
            return True
    return "hidden:" in names or any(x[5:] in ROLES if x.startswith("role:") else tells(x, "marks") for x in names)


def from_template(n: Node, template: frozenset[str] | set[str], inside: bool, whole: int) -> bool:
    return n.hash in template and 2 * n.size < whole and not (inside and n.tag in KEPT)


def roots(root: Node, template: frozenset[str] | set[str] = frozenset()) -> tuple[list[Node], bool]:
    """(elements that hold the main text, whether the page marks them), of what the template leaves."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    left = [root]
    while left:
        n = left.pop()
        if template and n is not root and from_template(n, template, False, root.size):
            continue
        if n.tag == "article" or "body:" in n.names:
            if not boilerplate(n, False, root.size):
                found["article"].append(n)
            continue
        if n.tag == "main" or "role:main" in n.names:
            found["main"].append(n)
        if n.tag == "body":
            found["body"].append(n)
        if not boilerplate(n, False, root.size):
            left += [k for k in reversed(n.kids) if type(k) is Node]
    for kind in ("article", "main"):
        if found[kind]:
            return found[kind] if kind == "article" else found[kind][:1], True
    return found["body"] or [root], False


def text_of(root: Node, template: frozenset[str] | set[str]) -> str:
    """The main text."""
    hashes(root)
    tops, marked = roots(root, template)
    out: list[str] = []
    for top in tops:
        left: list = [top]
        while left:
            n = left.pop()
            if type(n) is str:
                out.append(n)
                continue
            if n is not top and (template and from_template(n, template, marked, root.size) or boilerplate(n, marked, root.size)):
                out.append(" ") if n.tag not in INLINE else None
                continue
            if n.tag not in INLINE:
                out.append(" ")
                left.append(" ")
            left += reversed(n.kids)
    text = "".join(out)
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def subtree_rows(pages: DataFrame) -> DataFrame:
    """(_host, _hash, _main): the subtrees of each page that have text, each once, and one row with a null hash; with the hash of the page's main part."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("_host", "_hash", "_main")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, found, main = [], [], []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = parse(page or "")
                nodes = hashes(root)
                own = {n.hash for n in nodes if n.size and n.tag not in INLINE and 2 * n.size < root.size}
                tops, marked = roots(root)
                host += [h] * (len(own) + 1)
                found += [None, *own]
                main += ["".join(n.hash for n in tops) if marked else root.hash] * (len(own) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (host, found, main)], names=schema.names)

    return pages.select("_host", "_html").mapInArrow(common.tidy(run), schema)


def templates(pages: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """(_host, _template): the hashes of each host's recurring subtrees. Different pages are counted, then subtrees, each with partial sums."""
    each = subtree_rows(pages).groupBy("_host", "_hash", F.xxhash64("_main").alias("_main")).agg(F.lit(1).alias("_one"))
    counts = common.work_table(each.groupBy("_host", "_hash").agg(F.sum("_one").alias("_n")).where(F.col("_hash").isNull() | (F.col("_n") >= least_pages)), "page-subtrees")
    total = counts.where("_hash is null").select("_host", F.col("_n").alias("_pages"))
    many = counts.where("_hash is not null").join(total, "_host").where(F.col("_n") >= least_share * F.col("_pages"))
    out = common.work_table(many.groupBy("_host").agg(F.collect_list("_hash").alias("_template")), "page-templates")
    common.drop_table(counts)
    return out


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url"), least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """The kept columns with text and n_chars of each row."""
    host = F.coalesce(parts(F.col(url))[0], F.lit(""))
    rows = common.ready(pages).select(*keep, host.alias("_host"), F.col(html).alias("_html"))
    found = templates(rows, least_pages, least_share)
    n = found.count()
    size = found.agg(F.coalesce(F.sum(F.size("_template")), F.lit(0))).first()[0] * 32 + 64 * n
    if size <= common.BROADCAST_BYTES:
        joined = rows.join(F.broadcast(found), "_host", "left")
    else:
        salted = found.withColumn("_salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left")
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                out = [text_of(parse(h), frozenset(t or ())) if h else "" for h, t in zip(some.column(some.num_columns - 2).to_pylist(), some.column(some.num_columns - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*some.columns[:-2], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=schema.names)

    return joined.select(*keep, "_html", "_template").mapInArrow(common.tidy(run), schema)
