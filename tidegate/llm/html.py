"""Main text of web pages by site style trees (operator 6).

Pages are read into a light tree of elements. The trees of one host are merged
by path (tags, with their class or id words): the site style tree. Which branches
are removed from a host's pages is decided in its tree alone, from

* presentation importance: the entropy of the child sequences below a path over
  the host's distinct pages;
* content importance: the entropy of the texts of a path's own blocks and, for one
  block, how rare it is among the pages;
* evidence: what tags and names announce (a menu, an advert, a form, or an
  article), weighed by how much of the host's varied text they hold.

A path is of low importance if the composite of both entropies is low, or if it
announces no content. A name that only tells a place does not count on what holds
LEAST_SHARE or more of the host's text: a wrapper called "side" that holds the articles stays.
If article and main elements hold at least LEAST_SHARE of what is left on the host's pages that
have one, these pages are reduced to them; an article element that only holds teasers
decides nothing.

Counts are of distinct pages (by a digest of the whole html), so copies of one
page on a host do not make its article look like a repeated notice. Entropies of
few pages tell little, so they are drawn towards 1 by PRIOR_PAGES pages that differ
in everything; the evidence counts at any number of pages.

Defined cases: null or empty html gives the empty text; unclosed, nested or
broken markup is read as far as it goes, at any depth and length; repeated rows are each
extracted; pages without a host in their url are one host; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm._common import stored

#: Pages that differ in everything, added to each path's own when its entropies are judged.
PRIOR_PAGES = 4
#: A block or branch on at least this share of a host's distinct pages (with the prior ones) carries no content.
COMMON_SHARE = 0.6
#: Share of a host's varied text that makes the branch that holds it its content.
LEAST_SHARE = 0.5
#: Composite importance below which a branch is removed.
LEAST_IMPORTANCE = 0.15
#: The share of a path's own texts in its importance, against its child sequences.
DAMPING = 0.9
#: Entries of site style trees that are sent to all tasks at most.
SENT_ENTRIES = 100_000
#: Parts in which a path's features are counted before they meet, and a host's pages are dealt.
SALTS = 16

# Fixed values of HTML and of its use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search center".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form menu button select option input dialog head search label datalist".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar side header masthead footer cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login comment comments reply replies discussion disqus respond share sharing social related recommended widget toolbar pagination pager skip "
    "copyright disclaimer legal".split()
)
#: Words that stand beside a listed one in names, as in "share-buttons". A name with any other word announces nothing, as in "share-price".
BESIDE_NAMES = frozenset(
    "area bar block bottom box button buttons column container content group header holder icons inner item items left link links list main mobile outer page panel primary right row "
    "secondary section site slot small sticky top unit wrap wrapper zone".split()
)
#: Names that only say where a thing stands: not heeded inside an article, nor on what holds most of a host's text.
PLACES = frozenset("header side sidebar banner widget legal menu nav".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements that a start tag of the same kind closes, and elements that stop the search for them.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article section div ul ol dl table main body aside nav header footer form blockquote td th".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_NAME = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Node:
    """An element: its label, whether it announces no content (dull) and does so by a name of its place only (weak), and its children (nodes and text runs).

    path: the digest of the parent's path and the own label, so that it stands for
    all labels from the root down at any depth. inside: whether it is, or is in, an article.
    """

    __slots__ = ("tag", "label", "dull", "weak", "children", "path", "inside")

    def __init__(self, tag: str, label: str, dull: bool, weak: bool, path: str, inside: bool):
        self.tag, self.label, self.dull, self.weak, self.path, self.inside = tag, label, dull, weak, path, inside
        self.children: list[Node | str] = []


@lru_cache(maxsize=1 << 14)
def announced(value: str) -> frozenset[str]:
    """The listed words of a class or id attribute, of names that hold no words but these and those that stand beside them."""
    said: set[str] = set()
    for name in value.split():
        words = set(_WORDS.findall(name))
        if words - BESIDE_NAMES <= BOILERPLATE_NAMES:
            said |= words & BOILERPLATE_NAMES
    return frozenset(said)


def _element(tag: str, attributes: str, parent: Node) -> Node:
    names: list[str] = []
    inside, strong = parent.inside, False
    dull = tag in BOILERPLATE_TAGS or tag == "header" and not inside
    if "=" in attributes:
        for name, a, b, c in _NAME.findall(attributes):
            value, name = (a or b or c).lower(), name.lower()
            if name in ("class", "id"):
                names += _WORDS.findall(value)
                said = announced(value)
                strong = strong or bool(said - PLACES)
                dull = dull or tag not in ("html", "body") and bool(said - PLACES if inside else said)
            elif name == "role":
                dull = dull or value in BOILERPLATE_ROLES
            elif name == "aria-hidden":
                dull = dull or value == "true"
    label = ".".join([tag, *names])
    weak = dull and tag in ("div", "section") and not strong
    return Node(tag, label, dull, weak, f"{path_digest(parent.path)}/{label}", inside or label.startswith(("article", "main")))


def parse(text: str) -> Node:
    """The tree of a page."""
    root = Node("#root", "", False, False, "", False)
    stack, pos = [root], 0
    while m := _TOKEN.match(text, pos):
        said, tag, pos = m[0], (m[2] or "").lower(), m.end()
        if not tag:
            if said[0] != "<" or said == "<":
                stack[-1].children.append(said)
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break
            continue
        if tag == "br":
            stack[-1].children.append("\n")
            continue
        if tag in RAW:  # what it holds is not the page's text
            if end := _ENDS[tag].search(text, pos):
                pos = end.end()
            elif tag in ("script", "style"):
                break
            continue
        if closes := CLOSES.get(tag):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        elif tag in BLOCK:  # a block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        node = _element(tag, m[3], stack[-1])
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
    return root


def blocks(root: Node, removed: Callable[[Node], bool]) -> list[tuple[tuple[Node, ...], str]]:
    """The page's text blocks in order, each with its elements from the root down, without the branches that are removed."""
    found: list[tuple[tuple[Node, ...], str]] = []
    run: list[str] = []
    owner: tuple[Node, ...] = ()

    def end() -> None:
        if text := " ".join(html.unescape("".join(run)).split()):
            found.append((owner, text))
        run.clear()

    stack: list[tuple[Node, Iterator[Node | str], tuple[Node, ...]]] = [(root, iter(root.children), ())]
    while stack:
        node, children, above = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if node.tag in BLOCK:
                end()
        elif isinstance(child, str):
            if not run:
                owner = above
            run.append(child)
        else:
            if child.tag in BLOCK:
                end()
            if removed(child):
                continue  # an inline one goes from within its neighbours' block
            stack.append((child, iter(child.children), (*above, child)))
    end()
    return found


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


@lru_cache(maxsize=1 << 16)
def path_digest(path: str) -> int:
    """The digest of a path; the paths of a site's templates are met on every page."""
    return digest(path)


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _style(root: Node) -> dict[str, str]:
    """For each path of a page, its child sequences (repeats of a label once)."""
    out: dict[str, list[str]] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        said: list[str] = []
        for child in node.children:
            label = "#text" if isinstance(child, str) else child.label
            if not said or said[-1] != label:
                said.append(label)
            if isinstance(child, Node):
                todo.append(child)
        if node.path:
            out.setdefault(node.path, []).append(",".join(said))
    return {path: "|".join(dict.fromkeys(kinds)) for path, kinds in out.items()}


#: Kinds of rows of a page: child sequences of a path, a block of a path, and the characters that a dull path or the
#: page (path 0) holds. The last are told apart by their features.
STYLE, CONTENT, MASS = 0, 1, 2
STRONG, WEAK, IN_PAGE, IN_ARTICLE, BESIDE = 1, 2, 3, 4, 5


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page digest, kind, path digest, feature (digest of a style or block), chars (of MASS rows).

    A block's characters count for every dull path that holds it, for the page, and, on pages
    with articles, for what is in or beside these (if nothing announces it to be no content).
    """
    for batch in batches:
        urls, pages = batch.column("url").to_pylist(), batch.column("html").to_pylist()
        for at in range(0, len(urls), 256):
            rows: set[tuple[str, int, int, int, int, int]] = set()
            for url, page in zip(urls[at : at + 256], pages[at : at + 256]):
                if not page:
                    continue
                name, own, root = host(url), digest(page), parse(page)
                for path, kinds in _style(root).items():
                    rows.add((name, own, STYLE, path_digest(path), path_digest(kinds), 0))
                masses: dict[tuple[int, int], int] = {}
                beside, in_article = 0, 0
                for owner, text in blocks(root, lambda node: False):
                    rows.add((name, own, CONTENT, path_digest(owner[-1].path if owner else ""), digest(text), 0))
                    keys = [(0, IN_PAGE), *((path_digest(n.path), WEAK if n.weak else STRONG) for n in owner if n.dull)]
                    for key in keys:
                        masses[key] = masses.get(key, 0) + len(text)
                    if any(n.inside for n in owner):
                        in_article += len(text) * (not any(n.dull and not n.weak for n in owner))
                    else:
                        beside += len(text) * (not any(n.dull for n in owner))
                if in_article:
                    masses |= {(0, IN_ARTICLE): in_article, (0, BESIDE): beside}
                rows.update((name, own, MASS, path, feature, chars) for (path, feature), chars in masses.items())
            if rows:
                types = (pa.string(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["host", "page", "kind", "path", "feature", "chars"])


def site_style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, removed, common: the paths of low importance, those with common blocks (digests), and as path 0 the hosts whose articles are their content.

    Each page is read once, and its rows are kept in the shared folder. Copies of a page
    count once. Features are counted before they meet by path, so a host or path that
    holds most pages is spread over all tasks; a path's common features are few by
    definition (at most 1 / COMMON_SHARE per page's number of them) and listed.
    """
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    seen = stored(rows.mapInArrow(_page_rows, "host string, page long, kind byte, path long, feature long, chars long")).distinct()
    on, held = ["host", "path"], {"strong": STRONG, "weak": WEAK, "in_page": IN_PAGE, "in_article": IN_ARTICLE, "beside": BESIDE}
    # Styles, blocks and masses are told apart, and their pages counted, in one pass; sums of a path meet in SALTS parts first.
    counted = seen.groupBy("host", "kind", "path", "feature").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    salted = counted.groupBy("host", "kind", "path", F.pmod("feature", F.lit(SALTS)).alias("salt")).agg(
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.log("n")).alias("n_log_n"),
        *[F.sum(F.when(F.col("feature") == which, F.col("chars"))).alias(name) for name, which in held.items()],
    )
    sums = stored(salted.groupBy("host", "kind", "path").agg(*[F.sum(c).alias(c) for c in ("total", "n_log_n", *held)]))
    # A page has one style of each path, so styles count its pages.
    sizes = sums.filter(F.col("kind") == STYLE).select(*on, F.col("total").alias("n_pages"))
    total = F.col("total") + F.lit(PRIOR_PAGES)
    entropy = F.least(F.lit(1.0), (F.log(total) - F.col("n_log_n") / total) / F.log(F.col("n_pages") + F.lit(PRIOR_PAGES)))
    judged = sums.filter(F.col("kind") != MASS).join(sizes, on).select(*on, "kind", entropy.alias("entropy"))
    of_kind = [F.max(F.when(F.col("kind") == kind, F.col("entropy"))).alias(name) for kind, name in ((STYLE, "presentation"), (CONTENT, "content"))]
    composite = (1 - DAMPING) * F.coalesce("presentation", F.lit(0.0)) + DAMPING * F.col("content")
    # A path without text of its own is judged by its children.
    plain = judged.groupBy(*on).agg(*of_kind).filter(composite < LEAST_IMPORTANCE).select(*on, F.lit(True).alias("removed"))
    masses = sums.filter(F.col("kind") == MASS)
    hosts = masses.filter("path = 0")
    holds = F.col("strong").isNull() & (F.col("weak") >= LEAST_SHARE * F.col("page"))
    announced = masses.filter("path <> 0").join(hosts.select("host", F.col("in_page").alias("page")), "host").select(*on, (~holds).alias("removed"))
    trusted = hosts.filter(F.col("in_article") >= LEAST_SHARE * (F.col("in_article") + F.col("beside"))).select(*on, F.lit(True).alias("removed"))
    common = (
        counted.filter(F.col("kind") == CONTENT)
        .join(sizes, on)
        .filter(F.col("n") >= (F.col("n_pages") + F.lit(PRIOR_PAGES)) * COMMON_SHARE)
        .groupBy(*on)
        .agg(F.collect_list("feature").alias("common"))
    )
    nothing = F.lit(None).cast("array<long>").alias("common")
    decided = plain.unionByName(announced).unionByName(trusted).select(*on, "removed", nothing).unionByName(common.select(*on, F.lit(None).cast("boolean").alias("removed"), "common"))
    return decided.groupBy(*on).agg(F.max("removed").alias("removed"), F.flatten(F.collect_list("common")).alias("common"))


#: A host's decisions by path: True (removed) or False (it stays whatever it announces), and its common blocks.
Tree = tuple[dict[int, bool], dict[int, frozenset[int]]]
NO_TREE: Tree = ({}, {})


def as_tree(rows: list) -> Tree:
    return {x["path"]: x["removed"] for x in rows if x["removed"] is not None}, {x["path"]: frozenset(x["common"]) for x in rows if x["common"]}


def main_text(page: str | None, tree: Tree) -> str:
    """Text of a page after the branches that its host's tree removes."""
    if not page:
        return ""
    decided, common = tree
    found = blocks(parse(page), lambda node: decided.get(path_digest(node.path), False))
    kept = [(owner, text) for owner, text in found if not (owner and digest(text) in common.get(path_digest(owner[-1].path), ()))]
    if decided.get(0):
        for tag in ("article", "main"):
            inside = [x for x in kept if any(n.tag == tag for n in x[0])]
            if inside:
                kept = inside
                break
    return "\n".join(text for _, text in kept)


def _extracted(part: pa.RecordBatch, trees: list[Tree]) -> Iterator[pa.RecordBatch]:
    for at in range(0, part.num_rows, 128):
        some = part.slice(at, 128)
        found = [main_text(page, tree) for page, tree in zip(some.column("html").to_pylist(), trees[at : at + 128])]
        yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sent_entries: int = SENT_ENTRIES) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page.

    Up to sent_entries of the trees' decisions (some megabytes, counted before) are
    sent to all tasks and no page is moved. Beyond that they meet the pages in tasks
    dealt by host, and by a hashed part of its pages, so that a host with most pages is
    not one task: a task reads the host's decisions once, then its pages.
    """
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    tree = stored(site_style_tree(named))
    types = dict(named.dtypes)
    out = f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long"
    entries = tree.agg(F.sum(1 + F.size("common"))).first()[0] or 0
    if entries <= sent_entries:
        by_host: dict[str, list] = {}
        for row in tree.collect():
            by_host.setdefault(row["host"], []).append(row)
        sent = pages.sparkSession.sparkContext.broadcast({name: as_tree(rows) for name, rows in by_host.items()})

        def at_hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _extracted(batch, [sent.value.get(host(u), NO_TREE) for u in batch.column("url").to_pylist()])

        return named.mapInArrow(at_hand, out)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host(u) for u in batch.column("url").to_pylist()], pa.string())], ["page_id", "url", "html", "host"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by host and part: first the decisions (page_at null), then the pages."""
        name, rows, tree = None, [], NO_TREE
        for batch in batches:
            hosts, is_page = batch.column("host").to_pylist(), batch.column("is_page").to_pylist()
            paths, gone, listed = (batch.column(c) for c in ("path", "removed", "common"))
            trees: list[Tree] = []
            at = []
            for k, (own, page) in enumerate(zip(hosts, is_page)):
                if own != name:
                    name, rows, tree = own, [], NO_TREE
                if not page:
                    rows.append({"path": paths[k].as_py(), "removed": gone[k].as_py(), "common": listed[k].as_py()})
                    continue
                if rows:
                    tree, rows = as_tree(rows), []
                at.append(k)
                trees.append(tree)
            if at:
                yield from _extracted(batch.select(["page_id", "url", "html"]).take(pa.array(at)), trees)

    whole = f"page_id {types['page_id']}, url {types['url']}, html {types['html']}, host string"
    with_host = named.mapInArrow(placed, whole)
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("part")
    page_rows = with_host.select("host", part, F.lit(True).alias("is_page"), "page_id", "url", "html", *[F.lit(None).cast(t).alias(c) for c, t in (("path", "long"), ("removed", "boolean"), ("common", "array<long>"))])
    spread = tree.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tree_rows = spread.select("host", "part", F.lit(False).alias("is_page"), *[F.lit(None).cast(types[c]).alias(c) for c in ("page_id", "url", "html")], "path", "removed", "common")
    dealt = page_rows.unionByName(tree_rows).repartition("host", "part").sortWithinPartitions("host", "part", "is_page")
    return dealt.mapInArrow(met, out)
