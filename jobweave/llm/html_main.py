"""Main text of web pages by site style trees.

The document trees of a host's pages are merged into one style tree: an element
is its path of tags and first classes, and for boxes alike also their place
among the boxes around them; its styles are the sequences of its
children, its contents the texts and links right in it. An element whose
styles or contents differ from page to page is important, one that looks and
reads the same everywhere is not; both are measured as entropies over the
pages that have it. Branches of low importance leave every page, and so do
those whose tag or role is page furniture; ``article`` and ``main`` hold what
is looked for wherever they exist. A class or id that sounds like furniture
removes nothing by itself: it only asks more importance of its box.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import parallel, stage

#: Elements by what they are in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption body html legend".split())
#: A start tag ends an open element of its own family, unless one of the holders comes first.
FAMILIES = (("li", "li", "ul ol menu"), ("dt dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td th", "td th", "tr table"), ("option", "option", "select"), ("tbody thead tfoot", "tbody thead tfoot tr td th", "table"))
IMPLIED = {tag: (frozenset(ends.split()), frozenset(holders.split())) for tags, ends, holders in FAMILIES for tag in tags.split()}
#: What never is main text, by tag and by role; and words of class and id that make a box suspect.
FURNITURE_TAGS = frozenset("nav footer aside form script style noscript template head title button input select textarea option iframe object embed svg canvas dialog menu noembed noframes xmp".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FURNITURE_WORDS = frozenset("header ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar widget widgets related recommended share sharing social cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search comment comments commentlist respond disqus discussion pagination pager toolbar skip".split())
#: An article within an article and under such a name is a comment on it, as HTML means nested articles.
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
COMMENTED = re.compile("comment|disqus", re.I)
COMMENT_BOXES = frozenset("div section ul ol dl table aside details".split())
MAIN_TAGS, HOLDERS = frozenset(("article", "main")), frozenset(("html", "body", "article", "main"))
#: Only boxes are removed for low importance, never a paragraph or heading on its own.
BOXES = frozenset("div section ul ol dl table figure header details center fieldset".split())
#: What a page is laid out with; the other boxes are also found within running text.
LAYOUT = frozenset("div section header details center fieldset article main nav aside footer form".split())

#: A quote opens a value only behind an equals sign; any other is a character of the tag.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "label", "children", "furniture", "named", "comments", "main", "header", "href")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.label, self.children, self.href = tag, tag, [], None
        self.furniture, self.main, self.header = tag in FURNITURE_TAGS, tag in MAIN_TAGS, tag == "header"
        self.named = self.comments = False
        if attributes.strip():
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        found = {}
        for name, *values in ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), entities.unescape(next((v for v in values if v), "")))
        if found.get("class", "").split():
            self.label = f"{self.tag}.{found['class'].split()[0][:40].replace('/', '_').replace('@', '_')}"
        self.href, role = found.get("href"), found.get("role", "").lower()
        words = {w.lower() for key in ("class", "id") for w in NAME_PARTS.findall(found.get(key, ""))}
        self.main = self.main or role == "main" or found.get("itemprop") == "articleBody"
        self.named, self.comments = bool(words & FURNITURE_WORDS), bool(words & COMMENT_WORDS)
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
        if self.tag not in ("html", "body", "main"):
            self.furniture = self.furniture or role in FURNITURE_ROLES or bool(hidden)


def parse(text: str) -> Node:
    """The tree of a page; what isn't closed is closed where HTML closes it."""
    root = Node("#root")
    open_, at = [root], 0
    while True:
        found = TOKEN.search(text, at)
        end = found.start() if found else len(text)
        if end > at:
            open_[-1].children.append(entities.unescape(text[at:end]))
        if not found:
            if COMMENTED.search(text):
                _mark_comments(root)
            return root
        at = found.end()
        if found.group(2) is None:
            if found.group().startswith("<![CDATA["):
                open_[-1].children.append(found.group()[9:].removesuffix("]]>"))
            continue
        tag = found.group(2).lower()
        if found.group(1):
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    del open_[i:]
                    break
                if open_[i].tag in HOLDERS and tag not in BLOCKS:
                    break  # a stray inline end tag closes nothing around it
            continue
        ends, holders = IMPLIED.get(tag, (frozenset(("p",)) if tag in CLOSES_P else frozenset(), HOLDERS | frozenset(("td", "th", "li", "div", "section", "blockquote", "button"))))
        cut = None
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in ends:
                cut = i
                if tag not in IMPLIED:
                    break
            elif open_[i].tag in holders:
                break
        if cut is not None:
            del open_[cut:]
        node = Node(tag, found.group(3))
        open_[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(text, at)
            node.children.append(text[at:stop.start() if stop else len(text)])
            at = stop.end() if stop else len(text)
        elif tag not in VOID and not (found.group(3).endswith("/") and tag in ("svg", "path")):
            open_.append(node)


def children_of(node: Node) -> list[tuple[Node, str]]:
    """The elements in a node with their names in its path.

    Boxes without class, or with one that a sibling has too, are told apart by
    the tags of the boxes in the node (of those for layout, for a box for layout)
    and their place among them. How much text and how many paragraphs stand
    between them doesn't matter.
    """
    children = [c for c in node.children if not isinstance(c, str)]
    labels = Counter(c.label for c in children if c.tag in BOXES)
    if not labels:
        return [(c, c.label) for c in children]
    rows = [[c.tag for c in children if c.tag in kinds] for kinds in (LAYOUT, LAYOUT | BOXES)]
    prints = [f"{zlib.crc32(' '.join(row).encode('utf-8', 'surrogatepass')):08x}" for row in rows]
    out, at = [], [0, 0]
    for c in children:
        k, name = int(c.tag not in LAYOUT), c.label
        if c.tag in BOXES and len(rows[k]) > 1 and (labels[name] > 1 or name == c.tag):
            name = f"{name}@{prints[k]}:{at[k]}"
        at[0] += c.tag in LAYOUT
        at[1] += c.tag in LAYOUT or c.tag in BOXES
        out.append((c, name))
    return out


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null and hostless URLs share the host ''."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def observations(page: str) -> Iterator[tuple[str, str, int]]:
    """(path, kind, value) of one page, each once: 'page' for its elements, 'style' and 'content'."""
    import xxhash

    digest = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - 2**63
    styles: dict[str, list[str]] = {}
    contents: dict[str, set[int]] = {}
    waiting = [("", parse(page))]
    while waiting:
        path, node = waiting.pop()
        style, own = styles.setdefault(path, []), contents.setdefault(path, set())
        own.update(digest(" ".join(c.split())) for c in node.children if isinstance(c, str) and c.strip())
        for child, name in children_of(node):
            if not style or style[-1] != child.label:
                style.append(child.label)
            if child.href:
                own.add(digest("href " + child.href))
            if child.tag not in RAW:
                waiting.append((f"{path}/{name}", child))
    for path, style in styles.items():
        yield path, "page", 0
        yield path, "style", digest(">".join(style)) if style else 0
        for value in contents[path]:
            yield path, "content", value


def style_trees(pages: DataFrame, gamma: float = 0.9, min_tasks: int = 1) -> DataFrame:
    """(host, path, pages, presentation, content, importance) of every element of every host's style tree.

    With m pages having the element, presentation is the entropy of its styles
    to the base m. A text or link found on k of the pages has the entropy
    log_m k; content is 1 minus their mean over the branch. Importance weighs the two,
    presentation the more the more styles there are; with one page it is 1.
    Copies of a page on its host count once (the one with the smallest
    page_id), else an article published twice would look like furniture.
    """
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), "html").withColumn("print", F.xxhash64("html"))
    # Only pages that have copies: broadcast by the planner where small, else a join whose hot pages are split.
    copied = pages.groupBy("host", "print").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    pages = pages.join(stage(copied, "copied"), ["host", "print"], "left").where("first is null or page_id = first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [(*k, n) for k, n in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["host", "path", "kind", "value", "n"])

        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.update((host, *o) for o in observations(text.as_py() or ""))
                if len(seen) > 200_000:
                    yield out()
        yield out()

    read = parallel(pages.select("host", "html"), min_tasks)
    counts = read.mapInArrow(run, "host string, path string, kind string, value long, n long").groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0))
    spread = F.col("n") * F.ln("n")
    own = counts.groupBy("host", "path").agg(
        of("page", F.col("n")).alias("pages"), of("style", F.lit(1)).alias("styles"), of("style", (F.col("value") != 0).cast("int")).alias("boxed"), of("style", spread).alias("style_spread"),
        of("content", F.col("n")).alias("texts"), of("content", spread).alias("text_spread"))
    log_pages = F.nullif(F.ln("pages"), F.lit(0.0))
    own = stage(own.withColumns({
        "presentation": F.coalesce(1 - F.col("style_spread") / (F.col("pages") * log_pages), F.lit(1.0)),
        "repeated": F.coalesce(F.col("text_spread") / log_pages, F.lit(0.0)),
    }), "elements")
    # The contents of a branch count for all elements above them.
    parts = F.split("path", "/")
    above = own.where("texts > 0").select("host", "texts", "repeated", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path"))
    branch = above.groupBy("host", "path").agg((1 - F.sum("repeated") / F.sum("texts")).alias("content"))
    tree = own.join(branch, ["host", "path"], "left").withColumn("content", F.coalesce("content", F.lit(0.0)))
    weight = F.when(F.col("boxed") == 0, 1.0).otherwise(F.pow(F.lit(gamma), F.col("styles")))  # only text: content alone
    importance = F.when(F.col("pages") <= 1, 1.0).otherwise((1 - weight) * F.col("presentation") + weight * F.col("content"))
    return tree.select("host", "path", "pages", "presentation", "content", importance.alias("importance"))


def _mark_comments(root: Node) -> None:
    """A box named for comments that holds elements so named themselves is a list of them: furniture."""
    waiting, seen_below = [(root, False)], set()  # elements with something named for comments in them
    while waiting:
        node, done = waiting.pop()
        children = [c for c in node.children if not isinstance(c, str)]
        if not done:
            waiting.append((node, True))
            waiting.extend((c, False) for c in children)
            continue
        if any(c.comments or id(c) in seen_below for c in children):
            seen_below.add(id(node))
            if node.comments and node.tag in COMMENT_BOXES:
                node.furniture = True


def _mains(root: Node) -> tuple[set[int], set[int]]:
    """(the outermost main elements that are no furniture and are in none, all elements that hold one of them), as ids."""
    found, holders, waiting = set(), set(), [(root, None)]
    while waiting:
        above = waiting.pop()
        node, up = above
        if node.furniture:
            continue
        if node.main:
            found.add(id(node))
            while up and id(up[0]) not in holders:
                holders.add(id(up[0]))
                up = up[1]
        else:
            waiting.extend((c, above) for c in node.children if not isinstance(c, str))
    return found, holders


def _only_teasers(root: Node, mains: set[int]) -> bool:
    """Whether the page's own heading and most of its running text lie outside its main elements: those tease other pages."""
    inside = outside = 0
    heading, waiting = False, [(root, False)]
    while waiting:
        node, within = waiting.pop()
        if node.furniture or node.href is not None or node.header and not within:
            continue
        within = within or id(node) in mains
        heading = heading or node.tag == "h1" and not within
        for child in node.children:
            if not isinstance(child, str):
                waiting.append((child, within))
            elif within:
                inside += len(child.strip())
            else:
                outside += len(child.strip())
    return heading and outside > inside


def main_text(page: str | None, low: frozenset[str] = frozenset(), weak: frozenset[str] = frozenset()) -> str:
    """The blocks of a page's main text, one a line, without furniture, the boxes at ``low`` paths and those named like furniture at ``weak`` ones.

    No box that is or holds an article or main element leaves by its path or name.
    """
    root = parse(page or "")
    mains, holders = _mains(root)
    teasers = mains if mains and _only_teasers(root, mains) else set()
    mains, holders = (set(), set()) if teasers else (mains, holders)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = " ".join("".join(run).split())
        if line:
            blocks.append(line)
        run.clear()

    # (node, path, within main text, only headings, in an article: 1, and in its comments: 2); a string or None to end a block
    waiting: list = [(root, "", not mains, False, 0)]
    while waiting:
        item = waiting.pop()
        if item is None:
            flush()
            continue
        if isinstance(item, str):
            run.append(item)
            continue
        node, path, inside, headings, depth = item
        inside = inside or id(node) in mains
        unimportant = node.tag in BOXES and (path in low or node.named and path in weak) and id(node) not in mains and id(node) not in holders
        if node.furniture or unimportant or id(node) in teasers or node.main and depth == 2:
            if node.tag in BLOCKS:
                flush()
            continue
        depth = 1 if node.tag == "article" and not depth else 2 if depth and node.comments else depth
        if node.header and node.tag not in HOLDERS:
            if not mains:
                flush()
                continue
            headings = True
        if headings and re.fullmatch("h[1-6]", node.tag):
            headings = False
        if node.tag == "br":
            run.append(" ")
            continue
        block = node.tag in BLOCKS
        if block:
            flush()
            waiting.append(None)
        names = children_of(node)
        for child in reversed(node.children):
            if not isinstance(child, str):
                waiting.append((child, f"{path}/{names.pop()[1]}", inside, headings, depth))
            elif inside and not headings:
                waiting.append(child)
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, least_importance: float = 0.25, named_importance: float = 0.5, least_pages: int = 4, min_tasks: int = 1) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages of furniture only, give an empty text. Only elements seen on
    ``least_pages`` pages of a host are judged by importance: boxes need ``least_importance``, those
    whose class or id sounds like furniture ``named_importance``. Repeated rows and
    null ids or URLs are pages like any other; other columns are ignored.
    """
    trees = style_trees(pages, min_tasks=min_tasks)
    low = trees.where((F.col("importance") < max(least_importance, named_importance)) & (F.col("pages") >= least_pages))
    low = low.where(F.regexp_extract("path", r"([^/.@]*)[^/]*$", 1).isin(sorted(BOXES)))
    # A row per host with its unimportant boxes: broadcast by the planner where small, else a join whose hot hosts are split.
    low = stage(low.groupBy("host").agg(*[F.collect_set(F.when(F.col("importance") < least, F.col("path"))).alias(name) for name, least in (("low", least_importance), ("weak", named_importance))]), "unimportant")
    rows = parallel(pages.select("page_id", "url", "html"), min_tasks).withColumn("host", host_of(F.col("url"))).join(low, "host", "left").select("page_id", "url", "html", "low", "weak")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), frozenset(low.as_py() or ()), frozenset(weak.as_py() or ())) for page, low, weak in zip(*batch.columns[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = dict((f.name, f.dataType) for f in pages.schema.fields)
    schema = T.StructType([T.StructField("page_id", types["page_id"]), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema)
