"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a node with two states: boilerplate, or holding or being content.  A node's
shape (tag, names, text, links) gives its own potential; the state of its parent, by the child's tag, gives the
potential of the edge.  Sum-product messages go up from the leaves and down again, and each node's marginal
decides over its text.  The potentials are smoothed counts over labelled pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups, text_of
from .labelled_pages import labelled_pages

#: Labelled pages the model is fitted on.
TRAINING_PAGES = 2000
#: Added to each count of a feature.
SMOOTHING = 0.05
#: Children of one parent resemble each other: their messages weigh as much as so many at most.
SIBLINGS = 3.0

# Fixed values of HTML: elements inside a line of text, elements without text of their own, elements whose
# inside is no markup, elements that end an open element of the same kind.
_INLINE = frozenset(
    "a abbr acronym area b bdi bdo big br cite code data del dfn em embed font i img ins kbd label map mark nobr q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub "
    "msubsup msup mtable mtd mtext mtr munder munderover none param semantics".split())
_SKIPPED = frozenset("annotation annotation-xml button datalist iframe input meter noembed noframes optgroup option progress "
                     "script select style svg template textarea title canvas audio video".split())
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
# Elements that stand in a line of text or around blocks.
_EITHER = frozenset("noscript object".split())
_LINES = frozenset("dt figcaption h1 h2 h3 h4 h5 h6 p pre".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

_BEGIN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_SPECIAL = re.compile("""[>"']""")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Labels of training pages.
_LABELS = {"0": 0, "1": 1}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_KNOWN = frozenset("article aside blockquote body dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section "
                   "table tbody td th thead tr ul".split())

# Words in class, id and role attributes that tell what a part is for.
_BOILERPLATE = frozenset(
    "ad ads adsense advert advertisement advertising alert aside author banner bar bio bottom branding breadcrumb breadcrumbs byline colophon "
    "comment comments consent contact contentinfo cookie cookies copyright dialog discussion disqus follow foot footer form gdpr header legal "
    "login logo masthead menu menubar meta modal nav navbar navigation newsletter notice overlay pager pagination popular popup promo promotion "
    "rail recommended related replies reply responses search share sharing side sidebar signup skip social sponsor sponsored subscribe tags "
    "teaser toc toolbar top topnav trending widget widgets".split())
_CONTENT = frozenset("article body content entry main page post story text".split())


#: Log potentials of a child's states, by the parent's state.
_Edge = tuple[tuple[float, float], tuple[float, float]]


class _Node:
    __slots__ = ("tag", "parent", "names", "label", "kind", "own", "linked", "children")

    def __init__(self, tag: str, parent: int, names: str, label: int, kind: str):
        self.tag, self.parent, self.names, self.label, self.kind = tag, parent, names, label, kind
        self.own = self.linked = self.children = 0


def _names(attributes: str, label: int, labelled: bool) -> tuple[str, int]:
    """Kind of the element's names, and its label if the page is a labelled one; elsewhere that attribute means nothing."""
    kinds = set()
    for key, *values in _NAMED.findall(attributes):
        value = "".join(values)
        if key.lower() == "data-y":
            label = _LABELS.get(value, label) if labelled else label
            continue
        parts = {p.lower() for p in _PARTS.findall(value)}
        kinds |= {"boilerplate"} if parts & _BOILERPLATE else {"content"} if parts & _CONTENT else {"other"}
    return ("boilerplate" if "boilerplate" in kinds else "content" if "content" in kinds else "other" if kinds else "none"), label


class _Markup:
    """Comments, declarations and tags of a page, each decided once: the reader only moves forward.

    A tag ends at the first ``>`` outside quotes, or with the page.  One with a quote that nothing closes is text; the
    quotes that lead there are kept, so no later ``<`` follows them again.
    """

    def __init__(self, source: str):
        self.source, self.lost, self.clear = source, set(), (0, 0)

    def _special(self, at: int) -> int:
        """Place of the next ``>`` or quote, or the end; ``clear`` is a stretch without any."""
        if not self.clear[0] <= at < self.clear[1]:
            found = _SPECIAL.search(self.source, at)
            self.clear = (at, found.start() if found else len(self.source))
        return self.clear[1]

    def _tag_end(self, at: int) -> int:
        """The place of a tag's ``>``, the end of the page, or -1."""
        opened = []
        while True:
            at = self._special(at)
            if at == len(self.source) or self.source[at] == ">":
                return at
            opened.append(at)
            closing = -1 if at in self.lost else self.source.find(self.source[at], at + 1)
            if closing < 0:
                self.lost.update(opened)
                return -1
            at = closing + 1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether an end tag, name (empty: no element) and attributes of the next markup."""
        while m := _BEGIN.search(self.source, at):
            if not m[2]:
                stop = self.source.find("-->" if m[0] == "<!--" else ">", m.end())
                return m.start(), len(self.source) if stop < 0 else stop + (3 if m[0] == "<!--" else 1), False, "", ""
            stop = self._tag_end(m.end())
            if stop >= 0:
                return m.start(), min(stop + 1, len(self.source)), bool(m[1]), m[2].lower(), self.source[m.end():stop]
            at = m.end()
        return None


class _Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, nodes: list[_Node]):
        self.nodes, self.stack, self.places = nodes, [0], defaultdict(list)

    def push(self, node: int) -> None:
        self.places[self.nodes[node].tag].append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.nodes[self.stack.pop()].tag].pop()


def parse(source: str, labelled: bool = False) -> tuple[list[_Node], list[tuple[int, str]]]:
    """Block elements in page order, parents first, and the text blocks: (node, text), white space folded.

    Tags that don't match are passed over; a missing end is where the parent ends.  Nesting is kept on a stack
    of its own, so depth has no limit.  What may stand in a head has no text, so a head needs no end.
    """
    nodes, blocks = [_Node("body", -1, "none", 1, "body")], []
    opened, markup = _Open(nodes), _Markup(source)
    stack, text, linked, at, skip = opened.stack, [], 0, 0, ""

    def close() -> None:
        whole = " ".join("".join(text).split())
        text.clear()
        if whole:
            blocks.append((stack[-1], whole))
            nodes[stack[-1]].own += len(whole)

    # Each search starts where the last tag or script ended: markup that seems to begin inside a script is none.
    while m := markup.next(at):
        start, stop, end, tag, attributes = m
        if start > at and not skip:
            piece = html.unescape(source[at:start])
            text.append(piece)
            if linked:
                nodes[stack[-1]].linked += len(piece)
        at = stop
        if not tag:
            continue
        if tag in _RAW and tag in _SKIPPED and not end:
            # In a drawing these are plain elements: they may be empty, and end with the drawing.
            if skip != "svg" or not attributes.endswith("/"):
                ended = re.compile(rf"</(?:{tag}{'|svg' if skip == 'svg' else ''})(?=[\s/>])", re.I).search(source, at)
                at = ended.start() if ended else len(source)
            continue
        if skip:
            skip = "" if end and tag == skip else skip
            continue
        if tag in _SKIPPED:
            if end:
                continue
            if tag not in _VOID and not attributes.endswith("/"):
                skip = tag
            continue
        if tag in _INLINE:
            linked = linked + (-1 if end else 1) if tag == "a" else linked
            linked = max(0, linked)
            if tag == "br":
                text.append(" ")
            continue
        if tag in ("html", "head", "body"):
            continue
        if tag in _EITHER and (not opened.last([tag]) if end else nodes[stack[-1]].tag in _LINES or any(map(str.strip, text))):
            continue  # part of the line
        close()
        linked = 0
        if end:
            if place := opened.last([tag]):
                opened.cut(place)
            continue
        if tag in _VOID:
            continue
        if nodes[stack[-1]].tag == "p" and len(stack) > 1:
            opened.cut(len(stack) - 1)  # a block ends a paragraph
        if tag in _ENDS:
            place = opened.last(_ENDS[tag])
            if place > opened.last(_STOPS.get(tag, ())):
                opened.cut(place)
        parent = stack[-1]
        kind, label = _names(attributes, nodes[parent].label, labelled)
        nodes[parent].children += 1
        inner = tag == "header" and bool(opened.last(("article", "main")))
        nodes.append(_Node(tag, parent, kind, label, "inner header" if inner else tag if tag in _KNOWN else "other"))
        opened.push(len(nodes) - 1)
    if at < len(source) and not skip:
        text.append(html.unescape(source[at:]))
    close()
    return nodes, blocks


def features(nodes: list[_Node], blocks: list[tuple[int, str]]) -> list[tuple[str, ...]]:
    """What each node looks like: tag, share of links and names together (a list of links is no list of sentences),
    the names alone for shapes never seen, amount of text, punctuation."""
    below, links, stops = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for node, text in blocks:
        stops[node] += sum(map(text.count, ".!?,"))
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        below[i] += node.own
        links[i] += node.linked
        if node.parent >= 0:
            below[node.parent] += below[i]
            links[node.parent] += links[i]
    out = []
    for i, node in enumerate(nodes):
        # What only wraps another element has that one's text: it's evidence there, not once more here.
        size = "child's" if node.children == 1 and not node.own else below[i].bit_length() // 2
        share = "none" if not links[i] else "few" if 3 * links[i] < below[i] else "some" if 4 * links[i] < 3 * below[i] else "all"
        prose = "empty" if not node.own else "prose" if stops[i] else "words"
        out.append((f"shape={node.kind}/{share}/{node.names}", f"names={node.names}", f"size={size}", f"own={prose}"))
    return out


def _edge(node: _Node) -> str:
    return f"edge={node.kind}"


def count_labels(pages: DataFrame, page: str = "html") -> dict[tuple[str, str, int], int]:
    """Counts over labelled pages: (feature, "", state), and (child's tag, parent's state, child's state) for edges."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str, int]] = Counter()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                nodes, blocks = parse(source, labelled=True)
                for node, own in zip(nodes, features(nodes, blocks), strict=True):
                    seen.update((f, "", node.label) for f in own)
                    if node.parent >= 0:
                        seen[_edge(node), str(nodes[node.parent].label), node.label] += 1
        if seen:
            yield pa.RecordBatch.from_pydict({
                "what": [k[0] for k in seen], "given": [k[1] for k in seen], "state": [k[2] for k in seen], "n": list(seen.values())},
                schema=pa.schema([("what", pa.string()), ("given", pa.string()), ("state", pa.int64()), ("n", pa.int64())]))

    counts = pages.select(text_of(pages, page).alias("html")).mapInArrow(count, "what string, given string, state long, n long")
    # As many rows as there are features and kinds of edge, whatever the number of pages.
    return {(r[0], r[1], r[2]): r[3] for r in counts.groupBy("what", "given", "state").agg(F.sum("n")).collect()}


class ContentModel:
    """Potentials from counts, and marginals by messages up and down the tree."""

    def __init__(self, counts: dict[tuple[str, str, int], int]):
        totals = Counter()
        values: dict[str, set[str]] = {}
        for (what, given, state), n in counts.items():
            if not given:
                group = what.partition("=")[0]
                totals[group, state] += n
                values.setdefault(group, set()).add(what)
        self.own: dict[str, tuple[float, float]] = {}
        for group, whats in values.items():
            for what in whats:
                self.own[what] = tuple(
                    math.log((counts.get((what, "", s), 0) + SMOOTHING) / (totals[group, s] + SMOOTHING * (len(whats) + 1))) for s in (0, 1))  # type: ignore[assignment]
        # An edge potential is the child's state given the parent's; rare tags lean on all edges.
        self.edge: dict[str, _Edge] = {}
        overall = self._rows(counts, None)
        for kind in {w for w, g, _ in counts if g}:
            self.edge[kind] = self._rows(counts, kind, overall)
        self.any_edge = overall

    @staticmethod
    def _rows(counts: dict[tuple[str, str, int], int], kind: str | None, prior: _Edge | None = None) -> _Edge:
        rows = []
        for parent in (0, 1):
            n = [sum(v for (w, g, s), v in counts.items() if g == str(parent) and s == state and kind in (None, w)) for state in (0, 1)]
            if prior:
                n = [a + 4 * math.exp(p) for a, p in zip(n, prior[parent], strict=True)]
            else:
                n = [a + 0.1 for a in n]
            rows.append((math.log(n[0] / sum(n)), math.log(n[1] / sum(n))))
        return rows[0], rows[1]

    def known(self, seen: tuple[str, ...]) -> tuple[str, ...]:
        """The features that count: the names stand in for a shape that no labelled page has."""
        return (seen[0] if seen[0] in self.own else seen[1], *seen[2:])

    def marginals(self, nodes: list[_Node], own: list[tuple[str, ...]]) -> list[float]:
        """Probability of each node to hold content."""
        up0, up1 = [0.0] * len(nodes), [0.0] * len(nodes)
        for i, seen in enumerate(own):
            for f in self.known(seen):
                a, b = self.own.get(f, (0.0, 0.0))
                up0[i] += a
                up1[i] += b
        edges = [self.edge.get(_edge(n), self.any_edge) for n in nodes]
        message: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children stand after their parents
            e, p = edges[i], nodes[i].parent
            weight = min(1.0, SIBLINGS / nodes[p].children)
            message[i] = weight * _add(e[0][0] + up0[i], e[0][1] + up1[i]), weight * _add(e[1][0] + up0[i], e[1][1] + up1[i])
            up0[p] += message[i][0]
            up1[p] += message[i][1]
        # The body holds whatever content the page has.
        down = [(-30.0, 0.0)] * len(nodes)
        out = [0.0] * len(nodes)
        for i, node in enumerate(nodes):
            if i:
                p, e = node.parent, edges[i]
                rest0, rest1 = down[p][0] + up0[p] - message[i][0], down[p][1] + up1[p] - message[i][1]
                top = max(rest0, rest1)
                rest0, rest1 = rest0 - top, rest1 - top
                down[i] = _add(rest0 + e[0][0], rest1 + e[1][0]), _add(rest0 + e[0][1], rest1 + e[1][1])
            gap = down[i][0] + up0[i] - down[i][1] - up1[i]
            out[i] = 1 / (1 + math.exp(min(700.0, gap)))
        return out

    def main_text(self, source: str) -> str:
        nodes, blocks = parse(source)
        if not blocks:
            return ""
        content = self.marginals(nodes, features(nodes, blocks))
        return "\n".join(text for node, text in blocks if content[node] >= 0.5)


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def fit(spark: SparkSession, pages: list[str] | None = None) -> ContentModel:
    """The model of the labelled pages (those of this package by default: ``TRAINING_PAGES`` of them)."""
    pages = labelled_pages(TRAINING_PAGES) if pages is None else pages
    return ContentModel(count_labels(spark.createDataFrame([(p,) for p in pages], "html string").repartition(4)))


def main_texts(df: DataFrame, keep: list[str], model: ContentModel | None = None, page: str = "html") -> DataFrame:
    """Columns ``c0``, ``c1``, ... (those of ``keep``) and ``text``, the main text of every page.

    Blocks are joined by a newline; a page without main text, an empty page and a null have the empty text.
    Repeated rows stay.  Empty table: no rows.  No page stops the job: attributes are never read as numbers, broken tags
    are text, and a long page, also of tags or quotes that nothing closes, takes time in proportion to its length.
    Other columns are not read, and kept ones may have any name.
    """
    model = model or fit(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in groups(batch, "html"):
                texts = pa.array([model.main_text(h) for h in own.column("html").to_pylist()], pa.string())
                fields = [own.schema.field(i) for i in range(own.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], texts], schema=pa.schema([*fields, ("text", pa.string())]))

    narrow = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), text_of(df, page).alias("html"))
    kept = [f"c{i} {narrow.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return narrow.mapInArrow(run, ", ".join([*kept, "text string"]))
