"""Rendered pages as rows of elements.

A page is parsed once, by the standard library's tokenizer inside `mapInArrow`, into one row
that holds the page and an array of its elements. Selecting, text and attributes are then
column expressions inside that row: no join, no shuffle, and no second parse. Elements keep
byte ranges into the page's HTML and text, so the row stays about as large as the page
however deep it nests.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import trim

# Workers need no copy of the package: what they run travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes plaintext".split())
HEAD_LIKE = frozenset("base basefont bgsound link meta noframes script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
ITEMS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
SCOPE = frozenset("applet button caption html marquee object table td template th".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CELLS = frozenset("td th caption".split())
BODIES = frozenset("tbody thead tfoot".split())
STRUCTURE = CELLS | BODIES | frozenset("tr colgroup col".split())
TABLE_PARTS = BODIES | frozenset("table tr colgroup".split())
OPTIONS = frozenset("option optgroup".split())
SPECIAL = CLOSES_P | STRUCTURE | frozenset("li dt dd button body html".split())

NODE = (
    "struct<pre: int, last: int, parent: int, depth: int, nth: int, nth_of_type: int, siblings: int, tag: string, "
    "attrs: map<string,string>, ancestors: array<int>, html: struct<start: int, stop: int>, "
    "text: struct<start: int, stop: int>, parts: array<struct<is_text: boolean, start: int, stop: int>>>"
)
FLUSH_BYTES = 1 << 20


class _Comment(str):
    pass


class _Tree(HTMLParser):
    """Elements of a fragment as lists `[tag, attrs, children]`; children that are text are strings.

    As in a fragment of a body, `head` and `body` tags are ignored, and so are parts of tables outside one. Elements
    whose end may be left out close where the standard says: paragraphs, list items, options, and the parts of a
    table, whose missing bodies and rows are put in. What does not belong into a table goes before it. Formatting
    elements left open are opened again in the next block, at most three alike, and those that end across a block are
    split.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["html", {}, []]
        self.open = [self.root]
        # Open formatting elements; None where a cell or caption begins, beyond which nothing is opened again.
        self.formatting: list[list | None] = []
        self.above: dict[int, list] = {}

    def _cut(self, i: int) -> None:
        """Close the open elements from place i on."""
        for node in self.open[i:]:
            if node[0] in CELLS and None in self.formatting:
                last = len(self.formatting) - 1 - self.formatting[::-1].index(None)
                del self.formatting[last:]
        del self.open[i:]

    def _close(self, tags, barrier) -> bool:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i][0]
            if tag in tags:
                self._cut(i)
                return True
            if tag in barrier:
                return False
        return False

    def _put(self, node, foster: bool = False) -> None:
        """Append to the current element, or put what a table cannot hold before the table."""
        here = self.open[-1]
        if foster and here[0] in TABLE_PARTS:
            at = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == "table" or i == 0)
            table, here = self.open[at], self.open[max(at - 1, 0)]
            place = next((i for i, k in enumerate(here[2]) if k is table), len(here[2]))
            here[2].insert(place, node)
        else:
            here[2].append(node)
        if type(node) is list:
            self.above[id(node)] = here

    def _push(self, tag, attrs, foster: bool = False):
        node = [tag, attrs, []]
        self._put(node, foster)
        if tag not in VOID:
            self.open.append(node)
        return node

    def _reopen(self):
        if self.open[-1][0] in TABLE_PARTS:
            return
        first = len(self.formatting)
        while first and self.formatting[first - 1] is not None and not any(o is self.formatting[first - 1] for o in self.open):
            first -= 1
        for i in range(first, len(self.formatting)):
            node = self.formatting[i]
            self.formatting[i] = self._push(node[0], dict(node[1]))

    def _in_table(self) -> bool:
        return any(n[0] == "table" for n in self.open)

    def _table_part(self, tag) -> bool:
        """Close and put in what must be around a part of a table; false if there is no table."""
        if not self._in_table():
            return False
        to = {"td": {"tr"}, "th": {"tr"}, "tr": BODIES, "col": {"colgroup"}}.get(tag, set()) | {"table"}
        while self.open[-1][0] not in to:
            self._cut(len(self.open) - 1)
        if self.open[-1][0] == "table":
            if tag in ("td", "th", "tr"):
                self._push("tbody", {})
            elif tag == "col":
                self._push("colgroup", {})
        if tag in ("td", "th") and self.open[-1][0] in BODIES:
            self._push("tr", {})
        return True

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body"):
            return
        foster = False
        if tag in STRUCTURE:
            # A row inside a cell ends the cell; a cell of a table within a cell stays there.
            if tag in ("td", "th") and self.open[-1][0] in BODIES:
                self._push("tr", {})
            elif not self._table_part(tag):
                return
        else:
            if tag == "table" and self.open[-1][0] in TABLE_PARTS:
                self._close({"table"}, ())
            if tag in ITEMS:
                self._close(ITEMS[tag], SPECIAL - ITEMS[tag] - {"p", "div", "address"})
            if tag in OPTIONS and self.open[-1][0] == "option":
                self._cut(len(self.open) - 1)
            if tag == "optgroup" and self.open[-1][0] == "optgroup":
                self._cut(len(self.open) - 1)
            if tag in CLOSES_P or tag in ITEMS:
                self._close({"p"}, SCOPE)
            elif tag not in HEAD_LIKE:
                if tag == "a":
                    self._end_formatting("a")
                self._reopen()
            foster = tag not in ("script", "style", "template")
        values: dict[str, str] = {}
        for k, v in attrs:
            values.setdefault(k, v or "")
        node = self._push(tag, values, foster)
        if tag in CELLS:
            self.formatting.append(None)
        if tag in FORMATTING:
            alike = [f for f in self.formatting if f is not None and f[:2] == node[:2]]
            if len(alike) == 3:
                self.formatting = [f for f in self.formatting if f is not alike[0]]
            self.formatting.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _move(self, node, to) -> None:
        """Take an element out of where it is and append it to another."""
        kids = self.above[id(node)][2]
        del kids[next(i for i, k in enumerate(kids) if k is node)]
        to[2].append(node)
        self.above[id(node)] = to

    def _end_formatting(self, tag):
        """End a formatting element. If a block is open inside it, the block moves out of it and its content into a
        copy of it; eight such blocks at most, as the standard has it."""
        where = lambda rows, node: next((i for i, o in enumerate(rows) if o is node), None)
        for _ in range(8):
            rest = self.formatting[::-1]
            rest = rest[: rest.index(None)] if None in rest else rest
            node = next((f for f in rest if f[0] == tag), None)
            if node is None:
                self._close({tag}, SPECIAL)
                return
            at, listed = where(self.open, node), where(self.formatting, node)
            if at is None:
                del self.formatting[listed]
                return
            if any(o[0] in SCOPE for o in self.open[at + 1 :]):
                return
            far = next((k for k in range(at + 1, len(self.open)) if self.open[k][0] in SPECIAL), None)
            if far is None:
                del self.formatting[listed]
                self._cut(at)
                return
            around, block = self.open[at - 1], self.open[far]
            moved, kept = block, []
            for inner in self.open[at + 1 : far][::-1]:
                i = where(self.formatting, inner)
                if i is None:
                    continue  # closed with what it held so far
                copy = [inner[0], dict(inner[1]), []]
                self.formatting[i] = copy
                self.above[id(copy)] = self.above[id(inner)]
                self.above[id(inner)][2].append(copy)
                self._move(moved, copy)
                moved = copy
                kept.insert(0, copy)
            self._move(moved, around)
            copy = [node[0], dict(node[1]), block[2][:]]
            for k in copy[2]:
                if type(k) is list:
                    self.above[id(k)] = copy
            block[2][:] = [copy]
            self.above[id(copy)] = block
            del self.formatting[where(self.formatting, node)]
            self.formatting.append(copy)
            self.open[at : far + 1] = [*kept, block, copy]

    def handle_endtag(self, tag):
        if tag in ("html", "head", "body") or tag in VOID:
            return
        if tag in FORMATTING:
            self._end_formatting(tag)
        elif tag == "p":
            if not self._close({"p"}, SCOPE):
                self._push("p", {})
                self.open.pop()
        elif tag in STRUCTURE or tag == "table":
            self._close({tag}, {"table"} - {tag})
        else:
            self._close({tag}, SCOPE if tag in SPECIAL else SPECIAL)

    def handle_comment(self, data):
        self.open[-1][2].append(_Comment(data))

    def handle_data(self, data):
        if self.open[-1][0] not in RAW_TEXT | {"title", "textarea"}:
            self._reopen()
        self._put(data, foster=bool(data.strip()))


def _escaped(s: str) -> str:
    return escape(s, quote=False).replace("\u00a0", "&nbsp;")


def _opening(tag: str, attrs: dict[str, str]) -> str:
    quoted = ((k, v.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace('"', "&quot;")) for k, v in attrs.items())
    return "<" + tag + "".join(f' {k}="{v}"' for k, v in quoted) + ">"


_FIELDS = (
    "pre last parent depth nth nth_of_type siblings tag attrs ancestors html_start html_stop text_start text_stop parts"
).split()


def _parse(page: str) -> tuple[bytes, bytes, list[list]]:
    """Serialized page, its text, and its elements in document order as lists of `_FIELDS`."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    html, text, nodes = bytearray(), bytearray(), []
    # An explicit stack, since pages may nest deeper than Python can recurse: what is on it is
    # an element to open, the number of one to close, or text with the number of its parent.
    todo: list = [(tree.root, None, 0, 1, 1, 1)]
    while todo:
        item = todo.pop()
        if type(item) is int:
            node = nodes[item]
            if node[7] not in VOID:
                html += b"</" + node[7].encode() + b">"
            node[1], node[11], node[13] = len(nodes) - 1, len(html), len(text)
            if node[2] is not None:
                nodes[node[2]][14].append((False, node[10], node[11]))
            continue
        if len(item) == 2:
            words, parent = item
            if type(words) is _Comment:
                html += f"<!--{words}-->".encode("utf-8", "replace")
                continue
            raw = words.encode("utf-8", "replace")
            start = len(text)
            text += raw
            nodes[parent][14].append((True, start, len(text)))
            html += raw if nodes[parent][7] in RAW_TEXT else _escaped(words).encode("utf-8", "replace")
            continue
        (tag, attrs, kids), parent, depth, nth, nth_of_type, siblings = item
        pre, start = len(nodes), len(html)
        html += _opening(tag, attrs).encode("utf-8", "replace")
        above = [] if parent is None else [*nodes[parent][9], parent]
        nodes.append(
            [pre, pre, parent, depth, nth, nth_of_type, siblings, tag, list(attrs.items()), above, start, start, len(text), len(text), []]
        )
        todo.append(pre)
        if kids:
            below, of_type = [], {}
            elements = [k for k in kids if type(k) is list]
            n = 0
            for k in kids:
                if type(k) is list:
                    n += 1
                    of_type[k[0]] = of_type.get(k[0], 0) + 1
                    below.append((k, pre, depth + 1, n, of_type[k[0]], len(elements)))
                else:
                    below.append((k, pre))
            below.reverse()
            todo += below
    return bytes(html), bytes(text), nodes


def _arrow_nodes(pages: list[list[list]]) -> pa.Array:
    """Element lists of several pages as one Arrow list column, built column by column."""
    columns = dict(zip(_FIELDS, zip(*(n for nodes in pages for n in nodes), strict=True), strict=True))
    ints = lambda name: pa.array(columns[name], pa.int32())
    span = lambda name: pa.StructArray.from_arrays([ints(f"{name}_start"), ints(f"{name}_stop")], fields=list(_SPAN))
    parts = columns["parts"]
    flat = [p for one in parts for p in one]
    is_text, start, stop = zip(*flat, strict=True) if flat else ((), (), ())
    part_rows = pa.StructArray.from_arrays(
        [pa.array(is_text, pa.bool_()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], fields=list(_PART)
    )
    rows = pa.StructArray.from_arrays(
        [
            *[ints(n) for n in _FIELDS[:7]],
            pa.array(columns["tag"], pa.string()),
            pa.array(columns["attrs"], pa.map_(pa.string(), pa.string())),
            pa.array(columns["ancestors"], pa.list_(pa.int32())),
            span("html"),
            span("text"),
            pa.ListArray.from_arrays(_offsets(parts), part_rows),
        ],
        fields=list(_ARROW_NODE),
    )
    return pa.ListArray.from_arrays(_offsets(pages), rows)


def _offsets(lists) -> pa.Array:
    out = [0]
    for one in lists:
        out.append(out[-1] + len(one))
    return pa.array(out, pa.int32())


_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_PART = pa.struct([("is_text", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32())])
_ARROW_NODE = pa.struct(
    [(n, pa.int32()) for n in ("pre", "last", "parent", "depth", "nth", "nth_of_type", "siblings")]
    + [
        ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("ancestors", pa.list_(pa.int32())),
        ("html", _SPAN),
        ("text", _SPAN),
        ("parts", pa.list_(_PART)),
    ]
)


def _parsed(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    def flush(key_type: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
        keys, pages_html, texts, nodes = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, key_type), pa.array(pages_html, pa.binary()), pa.array(texts, pa.binary()), _arrow_nodes(nodes)],
            [key, "page_html", "page_text", "nodes"],
        )

    for batch in batches:
        # Written out in pieces: a batch of long pages must not pile up in the worker.
        rows, size = [], 0
        for k, page in zip(batch.column(0), batch.column(1), strict=True):
            if page.is_valid:
                rows.append((k.as_py(), *_parse(page.as_py())))
                size += len(rows[-1][1])
                if size > FLUSH_BYTES:
                    yield flush(batch.schema.types[0], rows)
                    rows, size = [], 0
        if rows:
            yield flush(batch.schema.types[0], rows)


def parse_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows `(key, page_html, page_text, nodes)`: the page as serialized, all its text, its elements.

    Pages are independent, so this is a map over the scan's own partitions.
    """
    kind = pages.schema[key].dataType.simpleString()

    whole = pages.select(key, html)
    parsed = whole.where(F.col(html).isNotNull()).mapInArrow(lambda it: _parsed(it, key), f"{key} {kind}, page_html binary, page_text binary, nodes array<{NODE}>")
    # A page without HTML stays a row, of nulls; only such rows are read a second time.
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in parsed.schema.fields[1:]]
    return parsed.unionByName(whole.where(F.col(html).isNull()).select(key, *absent))


def html_nodes(parsed: DataFrame, key: str) -> DataFrame:
    """One row per element in document order `pre`."""
    flat = parsed.select(key, F.inline("nodes"))
    return flat.withColumns({"id": node_attr_of(F.col("attrs"), "id"), "classes": classes_of(F.col("attrs"))})


def _slice(buffer: Column, start: Column, stop: Column) -> Column:
    return F.substring(buffer, start + 1, stop - start).cast("string")


def node_text(text: Column, node: Column) -> Column:
    """All text inside the element, script and style included, trimmed."""
    return F.when(node.isNotNull(), trim(_slice(text, node["text"]["start"], node["text"]["stop"])))


def list_text(text: Column, nodes: Column) -> Column:
    """Texts of a node list joined by one space."""
    return F.array_join(F.transform(nodes, lambda n: node_text(text, n)), " ")


def node_html(html: Column, node: Column) -> Column:
    """Outer HTML."""
    return F.when(node.isNotNull(), _slice(html, node["html"]["start"], node["html"]["stop"]))


def node_inner(html: Column, text: Column, node: Column) -> Column:
    """Inner HTML: child elements as HTML, the element's own text as plain text, comments left out."""
    parts = F.transform(
        node["parts"],
        lambda p: F.when(p["is_text"], _slice(text, p["start"], p["stop"])).otherwise(
            _slice(html, p["start"], p["stop"])
        ),
    )
    return F.when(node.isNotNull(), F.array_join(parts, ""))


def node_attr_of(attrs: Column, name: str) -> Column:
    return F.try_element_at(attrs, F.lit(name))


def node_attr(node: Column, name: str) -> Column:
    return node_attr_of(node["attrs"], name)


def list_attr(nodes: Column, name: str) -> Column:
    """The attribute of every element of a list, null where it is absent."""
    return F.transform(nodes, lambda n: node_attr(n, name))


def classes_of(attrs: Column) -> Column:
    words = F.split(F.coalesce(node_attr_of(attrs, "class"), F.lit("")), r"\s+")
    return F.filter(words, lambda w: w != "")


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))
