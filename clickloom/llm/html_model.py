"""Main-text extraction: a tree of DOM nodes as a graphical model."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import column_batch, small_batches, table
from clickloom.llm.html_pages import labelled_pages

ROWS_AT_ONCE = 200
#: Counts added to every cell of the model's tables.
PRIOR = 0.5
#: Lengths of a block's text that are told apart, in characters.
LENGTHS = [("small", 25), ("line", 80), ("sentence", 160), ("long", 320), ("essay", math.inf)]
#: Part of the parent-child pairs that are taken to be other than on the labelled pages.
DOUBT = 0.02
#: Class and id words seen on fewer labelled nodes say nothing.
LEAST_SEEN = 2

# Elements of HTML by how their text is laid out and how they end.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "script style title head noscript template iframe svg math object textarea select "
    "button datalist audio video canvas map noembed noframes xmp".split()
)
BLOCK = frozenset(
    "html body head address article aside blockquote center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav "
    "ol p pre search section summary table tbody td tfoot th thead tr ul caption legend "
    "title script style noscript template iframe svg math object textarea select button "
    "datalist audio video canvas map noembed noframes xmp optgroup option".split()
)
#: An open element of these ends where one of those begins.
CLOSED_BY = {
    "p": BLOCK - {"title", "script", "style", "template", "button", "svg", "math", "select"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "th": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "tbody": {"tbody", "tfoot", "thead"},
    "thead": {"tbody", "tfoot", "thead"},
    "option": {"option", "optgroup"},
    "head": {"body"},
}
#: No element beyond one of these is ended by an element inside it.
FENCE = frozenset("table td th ul ol dl div article section main body html blockquote".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.DOTALL,
)
_MARK = re.compile(
    r"(?:^|[\s/])(class|id|role|hidden|data-keep|style|aria-hidden)"
    r"(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?",
    re.IGNORECASE,
)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    """A block element: its parent, the words of its class, id and role, its own text."""

    __slots__ = ("tag", "parent", "words", "hidden", "texts", "size", "linked", "keep")

    def __init__(self, tag: str, parent: int, words: tuple, hidden: bool, keep: bool | None):
        self.tag, self.parent, self.words = tag, parent, words
        self.hidden, self.keep = hidden, keep
        self.size = self.linked = 0


def _marks(attributes: str) -> tuple[tuple, bool, bool | None]:
    """Words of class, id and role; whether the element is hidden; its label, if it has one."""
    words, hidden, keep = [], False, None
    for name, value in _MARK.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            words += [w.lower() for w in _NAME_PARTS.findall(value)]
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden = hidden or value.lower() == "true"
        elif name == "style":
            hidden = hidden or bool(_UNSHOWN.search(value))
        else:
            keep = value == "1"
    return tuple(dict.fromkeys(words)), hidden, keep


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements of a page, parents first, and its blocks of text (node, text).

    Inline elements belong to the block around them. A block of text ends where a
    block element begins or ends; a line break is white space. Text in links is
    counted for its block.
    """
    nodes = [Node("#page", -1, (), False, None)]
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements, and the block they lie in
    blocks: list[tuple[int, str]] = []
    pieces: list[str] = []
    links = 0

    def add(text: str) -> None:
        if text:
            pieces.append(text)
            if links:
                nodes[stack[-1][1]].linked += len(text)

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                at = stack[-1][1]
                nodes[at].size += len(text)
                blocks.append((at, text))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if tag in BLOCK:
                flush()
            elif depth and any(name in FENCE for name, _ in stack[depth:]):
                depth = 0
            if depth:
                links -= sum(name == "a" for name, _ in stack[depth:])
                del stack[depth:]
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if tag in BLOCK:
            flush()
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k][0]
            if tag in CLOSED_BY.get(name, ()):
                links -= sum(x == "a" for x, _ in stack[k:])
                del stack[k:]
            elif name in FENCE:
                break
        block = stack[-1][1]
        words, hidden, keep = _marks(attributes) if attributes else ((), False, None)
        if tag in BLOCK or hidden:
            nodes.append(Node(tag, block, words, hidden or tag in HIDDEN, keep))
            block = len(nodes) - 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        links += tag == "a"
        stack.append((tag, block))
    flush()
    return nodes, blocks


def features(nodes: list[Node]) -> list[list[str]]:
    """What the model sees of each node: element, class words, share of links, length.

    The last word of each entry is a value, the words before it what it is a value of;
    the share of links is judged among elements of the same name.
    """
    out = []
    for node in nodes:
        seen = [f"tag {node.tag}", *(f"word {w}" for w in node.words)]
        if node.size:
            share = node.linked / node.size
            links = "all" if share > 0.8 else "many" if share > 0.3 else "few"
            length = next(name for name, most in LENGTHS if node.size < most)
            seen += [f"links {node.tag} {links}", f"size {length}"]
        out.append(seen)
    return out


#: Elements that stand apart from what is around them, whatever that is.
APART = frozenset("header footer aside nav form".split())


def _kind(parent: Node, child: Node) -> tuple[str, str]:
    """Pairs of parent and child in which states go together alike.

    A menu or footer is no content inside an article as outside, so it tells little of
    its parent; nor does a child with a name of its own tell what one without does.
    """
    outer = "page" if parent.tag in ("#page", "html", "body") else "box"
    inner = "apart" if child.tag in APART else "named" if child.words else "plain"
    return outer, inner


KINDS = [(outer, inner) for outer in ("page", "box") for inner in ("apart", "named", "plain")]


class TreeModel:
    """Hidden state of each node (1: part of the content), given what is seen of it.

    Potentials: of a state with each thing seen, and of a parent's state with a
    child's. All are counted on labelled pages. A node is labelled by its nearest
    marked ancestor or itself.
    """

    def __init__(self, pages: list[str]):
        prior = [PRIOR, PRIOR]
        seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        pairs = {k: [[PRIOR, PRIOR], [PRIOR, PRIOR]] for k in KINDS}
        groups: Counter = Counter()
        for page in pages:
            nodes, _ = parse(page)
            state: list[int] = []
            for node, things in zip(nodes, features(nodes), strict=True):
                up = state[node.parent] if node.parent >= 0 else 1
                own = up if node.keep is None else int(node.keep)
                state.append(own)
                prior[own] += 1
                if node.parent >= 0:
                    pairs[_kind(nodes[node.parent], node)][up][own] += 1
                for thing in things:
                    seen[thing][own] += 1
                    groups[thing.rpartition(" ")[0], own] += 1
        self.unary = {}
        for thing, n in seen.items():
            group = thing.rpartition(" ")[0]
            if group == "word" and sum(n) < LEAST_SEEN:
                continue
            total = prior if group in ("word", "tag") else [groups[group, 0], groups[group, 1]]
            self.unary[thing] = tuple((n[s] + PRIOR) / (total[s] + 2 * PRIOR) for s in (0, 1))
        # Of the children of either kind of parent, DOUBT are taken to be of either state: a
        # label says less than its count, and one child must not decide about a whole article.
        self.pair = {
            k: tuple(tuple((1 - DOUBT) * x / sum(row) + DOUBT / 2 for x in row) for row in rows)
            for k, rows in pairs.items()
        }

    def potential(self, things: list[str]) -> tuple[float, float]:
        """What is seen of a node, for either state. Its class words count as one thing, by
        their geometric mean, as they are one name."""
        a = b = 1.0
        words = []
        for thing in things:
            p = self.unary.get(thing)
            if p and thing.startswith("word "):
                words.append(p)
            elif p:
                a *= p[0]
                b *= p[1]
        if words:
            a *= math.prod(p[0] for p in words) ** (1 / len(words))
            b *= math.prod(p[1] for p in words) ** (1 / len(words))
        return a, b

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of state 1 of each node, by messages up the tree and down again."""
        n = len(nodes)
        own = []
        for things in features(nodes):
            a, b = self.potential(things)
            own.append([a / (a + b), b / (a + b)])
        up = [(1.0, 1.0)] * n
        gathered = [list(x) for x in own]  # own potential times the messages from below
        pair = [self.pair[_kind(nodes[x.parent], x)] if x.parent >= 0 else None for x in nodes]
        for k in range(n - 1, 0, -1):
            (aa, ab), (ba, bb) = pair[k]
            g0, g1 = gathered[k]
            m0, m1 = aa * g0 + ab * g1, ba * g0 + bb * g1
            total = m0 + m1
            up[k] = (m0 / total, m1 / total)
            p = gathered[nodes[k].parent]
            p[0] *= up[k][0]
            p[1] *= up[k][1]
            total = p[0] + p[1]
            p[0] /= total
            p[1] /= total
        belief = [0.0] * n
        both = [(0.0, 1.0)] * n  # the page as a whole holds content
        belief[0] = 1.0
        tiny = math.ulp(0.0)
        for k in range(1, n):
            q0, q1 = both[nodes[k].parent]
            u0, u1 = up[k]
            r0, r1 = q0 / max(u0, tiny), q1 / max(u1, tiny)  # all but what came from here
            (aa, ab), (ba, bb) = pair[k]
            b0 = (r0 * aa + r1 * ba) * gathered[k][0]
            b1 = (r0 * ab + r1 * bb) * gathered[k][1]
            total = b0 + b1
            both[k] = (b0 / total, b1 / total)
            belief[k] = both[k][1]
        return belief


def main_text(page: str, model: TreeModel) -> str:
    """Blocks of the nodes whose marginal is over one half, in page order."""
    nodes, blocks = parse(page)
    belief = model.marginals(nodes)
    unseen = [False] * len(nodes)
    for k, node in enumerate(nodes):
        unseen[k] = node.hidden or (node.parent >= 0 and unseen[node.parent])
    return "\n\n".join(text for k, text in blocks if belief[k] > 0.5 and not unseen[k])


def extract(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages.

    The model is trained on the labelled pages (marked by `data-keep`), a list of
    fixed size unless given, and goes out with the job. Each page is parsed and
    judged in the task that read it; nothing is shuffled.

    Null or empty html, and pages without content, give an empty text. Nulls in
    page_id and url stay. Repeated rows are judged each on its own, other columns
    are ignored, and an empty table gives no rows.
    """
    model = pages.sparkSession.sparkContext.broadcast(
        TreeModel(labelled_pages() if labelled is None else labelled)
    )
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, ROWS_AT_ONCE):
            texts = [main_text(p, model.value) if p else "" for p in batch.column(2).to_pylist()]
            yield column_batch(
                schema,
                [batch.column(0), batch.column(1).cast(pa.string()), texts, [len(t) for t in texts]],
            )

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
