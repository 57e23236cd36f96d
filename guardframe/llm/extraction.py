"""Main text of web pages by wrapper induction.

The block elements of a page are a tree, in which neighbours of one kind are one repeated node.
Trees of pages of one host are aligned by simple tree matching and merged into the host's
template. All pages are then aligned with it, and the texts at every node are counted. Texts that
stand at the same node of most pages are template; what varies is content. Landmarks and the usual
roles of elements say which varying slots are not the article; the names in classes and ids only
count where the template has such a slot.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import ceil

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardframe.sources.scratch import materialize

#: Deepest level of a tree, most nodes of a template, fewest pages of a host to learn from, share of its
#: pages that makes a text constant, and share of the varying text that a child must hold to be the content slot.
DEPTH, NODES, PAGES, CONSTANT, SLOT = 40, 400, 3, 0.5, 0.6
#: Counts that a task holds before it hands them on.
HELD = 200_000

# How elements are laid out and what they are for.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr"
    " ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noframes".split())
NOT_TEXT = RAW | frozenset("head svg math object audio video canvas select button option datalist map".split())
NOT_ARTICLE = frozenset("nav aside footer form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation"
    " menu menubar breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar toolbar comment comments"
    " commentlist respond reply replies disqus cookie cookies consent gdpr notice notices notification alert popup modal"
    " overlay share sharing social related recommended newsletter subscribe subscription signup login search pagination"
    " pager skip".split())
#: Words beside names that say nothing of what an element is for.
PLAIN = frozenset(
    "area bar block body bottom box button col container content group heading inner item items js left link links list"
    " module outer panel right row section side slot text title top unit wrap wrapper zone".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")


#: Whether an element's names say what it is for: not at all, beside other words, or with plain words only.
NO, PARTLY, WHOLLY = range(3)


class Block:
    """A block element of a page; ``inside`` an article or main element, ``article`` in one of the former."""
    __slots__ = ("kind", "parent", "children", "aside", "named", "landmark", "inside", "article", "template", "chars", "path")

    def __init__(self, kind: str, parent: Block | None, aside: bool = False, landmark: bool = False, named: int = NO):
        self.kind, self.parent, self.children = kind, parent, []
        self.aside, self.named, self.landmark, self.template, self.chars = aside, named, landmark, None, 0
        tag = kind.split(" ")[0]
        self.article = tag == "article" or parent is not None and parent.article
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.path = xxhash.xxh64_hexdigest((parent.path if parent else "") + " " + kind)
        if parent is not None:
            parent.children.append(self)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _apart(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is not the article's text by its kind, role or style; inside a landmark or not."""
    if tag in NOT_ARTICLE or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "").lower()):
        return True
    return attributes.get("role", "").lower() in ROLES


def _named(tag: str, attributes: dict[str, str], nested: bool = False) -> int:
    """What class and id say of an element; an article counts where it is nested in another."""
    found = NO
    if attributes and tag not in ("html", "body", "main") and (tag != "article" or nested):
        for attribute in ("class", "id"):
            words = set(_NAME.findall(attributes.get(attribute, "").lower()))
            if words & NAMES:
                found = max(found, WHOLLY if words <= NAMES | PLAIN else PARTLY)
    return found


def parse(page: str | None) -> tuple[Block, list[tuple[Block, str]]]:
    """The tree of blocks, and the texts with the block they stand in, in page order."""
    root = Block("#", None)
    texts: list[tuple[Block, str]] = []
    stack: list[tuple[str, Block, bool]] = [("#", root, False)]  # open elements: tag, block, not text
    opened: Counter = Counter()  # open elements by tag
    depths = [0]  # where in the stack blocks are
    run: list[str] = []
    page = page or ""
    at = 0

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                texts.append((stack[-1][1], text))
            run.clear()

    def close(depth: int) -> None:
        if depths[-1] >= depth:
            flush()
        while depths[-1] >= depth:
            depths.pop()
        opened.subtract(tag for tag, _, _ in stack[depth:])
        del stack[depth:]

    while True:
        token = _TOKEN.search(page, at)
        if not stack[-1][2]:
            run.append(page[at:token.start() if token else len(page)])
        if token is None:
            break
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            if opened[tag] > 0:
                close(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth][0] == tag))
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if not stack[-1][2]:
                run.append(" ")
            continue
        if tag in VOID and tag != "hr":
            if not stack[-1][2]:
                run.append(" " if tag == "br" else "")
            continue
        if tag == "body" and opened["head"] > 0:
            close(next(depth for depth in range(1, len(stack)) if stack[depth][0] == "head"))
        _, block, silent = stack[-1]
        if tag not in BLOCKS:
            attributes = _attributes(token[3]) if token[3] else {}
            apart = tag in NOT_TEXT or _apart(tag, attributes, block.landmark) or _named(tag, attributes) == WHOLLY
            if not token[3].endswith("/") or tag not in NOT_TEXT:
                stack.append((tag, block, silent or apart))
                opened[tag] += 1
            continue
        flush()
        last = stack[depths[-1]][0]
        if last == "p" or last in CLOSES.get(tag, ()):
            close(depths[-1])
        if tag == "hr":
            continue
        _, block, silent = stack[-1]
        attributes = _attributes(token[3]) if token[3] else {}
        landmark = block.landmark or tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
        names = " ".join(sorted(set(_NAME.findall(attributes.get("class", "").lower()))))
        aside = block.aside or _apart(tag, attributes, block.landmark)
        block = Block(f"{tag} {names}".strip(), block, aside, landmark, _named(tag, attributes, block.article))
        depths.append(len(stack))
        stack.append((tag, block, silent))
        opened[tag] += 1
    flush()
    return root, texts


class Node:
    """A node of a template, or of a page's folded tree."""
    __slots__ = ("kind", "pages", "texts", "children", "blocks", "number", "paths")

    def __init__(self, kind: str, pages: int = 0, texts: dict[str, int] | None = None):
        self.kind, self.pages, self.texts = kind, pages, texts or {}
        self.children: list[Node] = []
        self.blocks: list[Block] = []
        self.number = 0
        self.paths: dict[str, dict[str, int]] = {}  # of a root: texts of blocks that have no node, by kinds

    def dump(self) -> list:
        return [self.kind, self.pages, self.texts, [c.dump() for c in self.children]]

    @staticmethod
    def load(data: list) -> Node:
        node = Node(data[0], data[1], data[2])
        node.children = [Node.load(c) for c in data[3]]
        return node

    def count(self) -> int:
        return 1 + sum(c.count() for c in self.children)

    def all(self) -> list[Node]:
        """All nodes, level by level."""
        level, out = [self], []
        while level:
            out += level
            level = [c for n in level for c in n.children]
        return out

    def take(self, counts: Iterable[tuple[str, str, str]]) -> Node:
        """Set the counted texts, each with its place: a node's number, or kinds."""
        every = self.all()
        for n, node in enumerate(every):
            node.number, node.texts = n, {}
        for place, text, n in counts:
            texts = every[int(place[1:])].texts if place[0] == "n" else self.paths.setdefault(place, {})
            texts[text] = int(n)
        return self


def digest(text: str) -> str:
    return format(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")), "x")


def folded(root: Block) -> Node:
    """A page's tree with neighbours of one kind as one node."""
    def fold(blocks: list[Block], depth: int) -> Node:
        node = Node(blocks[0].kind, 1)
        node.blocks = blocks
        if depth < DEPTH:
            lots: list[list[Block]] = []
            for child in (c for b in blocks for c in b.children):
                if lots and lots[-1][0].kind == child.kind:
                    lots[-1].append(child)
                else:
                    lots.append([child])
            node.children = [fold(lot, depth + 1) for lot in lots]
        return node
    return fold([root], 0)


def matching(a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the size of the largest ordered matching, and the matched children."""
    if a.kind != b.kind:
        return 0, []
    n, m = len(a.children), len(b.children)
    score = [[0] * (m + 1) for _ in range(n + 1)]
    pair = [[0] * m for _ in range(n)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            if x.kind == y.kind:
                pair[i][j] = matching(x, y)[0] if x.children and y.children else 1
            score[i + 1][j + 1] = max(score[i][j + 1], score[i + 1][j], score[i][j] + pair[i][j])
    matched, i, j = [], n, m
    while i and j:
        if pair[i - 1][j - 1] and score[i][j] == score[i - 1][j - 1] + pair[i - 1][j - 1]:
            matched.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif score[i][j] == score[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + score[n][m], matched[::-1]


def merge(template: Node, page: Node) -> None:
    """Align a tree with the template and count it in; nodes without a partner are put between."""
    template.pages += page.pages
    partner = {j: i for i, j in matching(template, page)[1]}
    out, at = [], 0
    for j, child in enumerate(page.children):
        if j in partner:
            i = partner[j]
            out += template.children[at:i]
            merge(template.children[i], child)
            out.append(template.children[i])
            at = i + 1
        else:
            fresh = Node(child.kind)
            merge(fresh, child)
            out.append(fresh)
    template.children = out + template.children[at:]


def prune(template: Node) -> None:
    """Keep a template of bounded size: the nodes of most pages, upper ones first, stay."""
    if template.count() <= NODES:
        return
    # no node has more pages than its parent, so the order keeps the parents
    kept = {id(n) for n in sorted(template.all(), key=lambda n: -n.pages)[:NODES]}
    for node in template.all():
        node.children = [c for c in node.children if id(c) in kept]


def mark(template: Node, page: Node) -> None:
    """Give the page's blocks their template nodes."""
    for block in page.blocks:
        block.template = template
    for i, j in matching(template, page)[1]:
        mark(template.children[i], page.children[j])


def main_text(page: str | None, template: Node | None) -> str:
    """The article's blocks, one to a line."""
    root, texts = parse(page)
    learned = template is not None and template.pages >= PAGES
    if learned:
        mark(template, folded(root))
    set_apart(root, template if learned else None)
    texts = [(b, t) for b, t in texts if not b.aside]
    inside = [(b, t) for b, t in texts if b.inside]
    if inside:
        # all landmarks of a page make its article, with what they hold but what is set apart
        return "\n".join(t for _, t in (_own(inside, template) if learned else inside))
    if learned:
        texts = [(b, t) for b, t in texts if _often(b, t, template) < CONSTANT * template.pages] or texts
    slot = {id(b) for b in _below(_slot(root, texts))}
    return "\n".join(t for b, t in texts if id(b) in slot)


def _below(block: Block) -> list[Block]:
    """A block and all blocks in it, parents first."""
    out = [block]
    for b in out:
        out += b.children
    return out


def set_apart(root: Block, template: Node | None) -> None:
    """Set blocks apart whose names say so, with all blocks in them.

    A name counts if the template has the element: on ``PAGES`` pages where nothing but names and plain
    words is said, on the share of pages that makes a text constant where other words are said too.
    Where no template or none of its nodes can tell, only the former count.
    """
    for block in _below(root):
        if block.parent is not None and block.parent.aside:
            block.aside = True
        elif block.named and template is not None and block.template is not None:
            often = PAGES if block.named == WHOLLY else max(PAGES, CONSTANT * template.pages)
            block.aside |= block.template.pages >= often
        elif block.named == WHOLLY:
            block.aside = True


def _often(block: Block, text: str, template: Node) -> int:
    """On how many of the host's pages the text stands at the block's node, or below the same kinds if it has none."""
    texts = template.paths.get("p" + block.path, {}) if block.template is None else block.template.texts
    return texts.get(digest(text), 0)


def _own(texts: list[tuple[Block, str]], template: Node) -> list[tuple[Block, str]]:
    """The texts of a page's landmarks without the nodes of which all text is constant.

    A constant text beside others of its node may be the article's, and where constant texts are
    half of all the pages share an article; both stay.
    """
    least = max(PAGES, CONSTANT * template.pages)
    constant = [_often(b, t, template) >= least for b, t in texts]
    if 2 * sum(len(t) for (_, t), c in zip(texts, constant) if c) >= sum(len(t) for _, t in texts):
        return texts
    varying = {_place(b) for (b, _), c in zip(texts, constant) if not c}
    return [(b, t) for b, t in texts if _place(b) in varying]


def _place(block: Block) -> int:
    return id(block if block.template is None else block.template)


def _slot(root: Block, texts: list[tuple[Block, str]]) -> Block:
    """The deepest block that holds most of the varying text."""
    for block, text in texts:
        block.chars += len(text)
    for block in reversed(_below(root)):
        if block.parent is not None:
            block.parent.chars += block.chars
    slot = root
    while slot.children:
        best = max(slot.children, key=lambda c: c.chars)
        if best.chars < SLOT * max(1, slot.chars) or not best.children:
            return slot
        slot = best
    return slot


def _host(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return found[1].lower() if found else ""


_INDUCED = ["host", "salt", "template"]
_INDUCED_DDL = "host string, salt int, template string"


def _templates(rows: list[tuple[str, int, Node]]) -> pa.RecordBatch:
    columns = list(zip(*((h, s, json.dumps(n.dump())) for h, s, n in rows))) if rows else [()] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string()))], names=_INDUCED)


def _learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates of the hosts of a split."""
    salt = TaskContext.get().partitionId() % 64
    known: dict[str, Node] = {}
    for batch in batches:
        for url, page in zip(batch.column("url"), batch.column("html")):
            host = _host(url.as_py())
            if not host:
                continue
            if len(known) >= 2000 and host not in known:
                yield _templates([(h, salt, n) for h, n in known.items()])
                known = {}
            template = known.setdefault(host, Node("#"))
            root, _ = parse(page.as_py())
            merge(template, folded(root))
            prune(template)
    yield _templates([(h, salt, n) for h, n in known.items()])


def _join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the templates that follow each other with one host and salt."""
    now, template = None, None
    for batch in batches:
        for host, salt, data in zip(*(c.to_pylist() for c in batch.columns)):
            if (host, salt) != now:
                if now is not None:
                    yield _templates([(*now, template)])
                now, template = (host, salt), Node.load(json.loads(data))
            else:
                merge(template, Node.load(json.loads(data)))
                prune(template)
    if now is not None:
        yield _templates([(*now, template)])


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Templates of all hosts, learned from all pages: (host, template).

    Every split merges its own pages into one template per host; these meet first by host and a
    split's remainder, then by host, so a host of a third of all pages sends each task a few trees
    of bounded size.
    """
    own = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = own.mapInArrow(_learn, _INDUCED_DDL)
    for _ in range(2):
        found = found.repartition("host", "salt").sortWithinPartitions("host", "salt").mapInArrow(_join, _INDUCED_DDL)
        found = found.withColumn("salt", F.lit(0))
    return found.select("host", "template")


class _Known:
    """The templates read last."""

    def __init__(self) -> None:
        self.nodes: dict[tuple, Node] = {}

    def get(self, data: str | None, counts: str | None = None) -> Node | None:
        if data is None:
            return None
        if (data, counts) not in self.nodes:
            if len(self.nodes) > 500:
                self.nodes.clear()
            self.nodes[data, counts] = Node.load(json.loads(data)).take(json.loads(counts or "[]"))
        return self.nodes[data, counts]


_COUNTS = {"host": pa.string(), "place": pa.string(), "text": pa.string(), "n": pa.int64(), "least": pa.int64()}


def count(pages: Iterable[str | None], template: Node) -> Iterator[tuple[str, str]]:
    """For every page and place, a node of the template or kinds of elements, each text that stands there, once."""
    for page in pages:
        root, texts = parse(page)
        texts = [(b, t) for b, t in texts if not b.aside]
        mark(template, folded(root))
        found = set()
        for block, text in texts:
            key = digest(text)
            found.add(("p" + block.path, key))
            if block.template is not None:
                found.add((f"n{block.template.number}", key))
        yield from found


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pages of a split have a text at a place, and how many make it constant."""
    known, held = _Known(), Counter()

    def out() -> pa.RecordBatch:
        columns = list(zip(*((*key[:3], n, key[3]) for key, n in held.items()))) if held else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _COUNTS.values())], names=list(_COUNTS))

    for batch in batches:
        for host, page, data in zip(*(c.to_pylist() for c in batch.columns)):
            template = known.get(data)
            if template is None or template.pages < PAGES:
                continue
            least = ceil(CONSTANT * template.pages)
            held.update((host, place, text, least) for place, text in count([page], template))
            if len(held) >= HELD:
                yield out()
                held.clear()
    yield out()


def constants(pages: DataFrame) -> DataFrame:
    """The texts that are constant on the pages of a host, which come with its template: (host, constant)."""
    return pages.where("template is not null").select("host", "html", "template") \
        .mapInArrow(_count, "host string, place string, text string, n long, least long") \
        .groupBy("host", "place", "text").agg(F.sum("n").alias("n"), F.max("least").alias("least")).where("n >= least") \
        .groupBy("host").agg(F.to_json(F.collect_list(F.array("place", "text", F.col("n").cast("string")))).alias("constant"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The article of every page: (page_id, url, text).

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments and text
    that most pages of the host have at the same place are left out. Character references are
    decoded, white space within a block is one space, blocks are joined by line feeds. Null html is
    empty, an empty page has empty text; a page without a host is read without a template. Rows
    with null or repeated ids are kept; further columns are ignored. Time is in proportion to a page's
    length, however deep or broken its elements are; a template knows ``DEPTH`` levels of them.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    # pages without a host get keys of their own, so that they do not meet in one task
    lone = F.concat(F.lit(" "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    own = own.withColumn("host", F.when(host == "", lone).otherwise(host))
    templates = materialize(induce(own), "templates")
    counted = constants(own.join(templates, "host", "left"))
    # stored, so that its size is known and pages need no shuffle where it is small
    templates = materialize(templates.join(counted, "host", "left"), "constants")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            out = [main_text(page, known.get(data, constant)) for page, data, constant in
                   zip(*(batch.column(c).to_pylist() for c in ("html", "template", "constant")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])
    return own.join(templates, "host", "left").select("page_id", "url", "html", "template", "constant") \
        .mapInArrow(run, "page_id long, url string, text string")
