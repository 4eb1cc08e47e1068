"""Pages as element trees: selectors and rendered text of detail pages (OP-03, OP-21, OP-22).

A task parses the pages of its Arrow batches one after the other and hands on the extracted columns only.  The standard
library's tokenizer finds tags, attributes, comments, raw text and entities; ``Tree`` keeps the stack of open elements and
applies HTML's rules for void elements, implied end tags and stray end tags.

Text is what a browser's ``innerText`` gives with default styles: white space collapsed, ``br`` and blocks as new lines, paragraphs
apart by an empty line, cells by tabs; scripts, styles and hidden elements are left out.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.operators import envelope as E

# Fixed values of HTML: elements without content, with raw content, that aren't rendered, and that are blocks.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NOT_RENDERED = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "select", "textarea", "audio", "video", "canvas", "datalist"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "ul",
}
CELLS, SECTIONS = {"td", "th"}, {"thead", "tbody", "tfoot"}
# Fixed values of HTML: a start tag closes open elements of the first set, looked for up to one of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": (CELLS, {"tr", "table"}), "th": (CELLS, {"tr", "table"}), **{s: (SECTIONS | {"tr", "caption", "colgroup"}, {"table"}) for s in SECTIONS},
}
# Fixed values of HTML: start tags that end an open paragraph, and elements whose inside an end tag can't close from.
ENDS_PARAGRAPH = (BLOCKS - {"body", "html", "caption", "legend", "optgroup", "option"}) | {"hr", "xmp", "plaintext", "listing"}
SCOPE = CELLS | {"table", "caption", "html", "template", "button", "object"}
SPACES = re.compile("[ \t\n\r\f]+")
DEEPEST = 512  # open elements; further ones are closed at once, as browsers do


class Element:
    __slots__ = ("tag", "attributes", "parent", "children")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def descendants(self) -> Iterator[Element]:
        """In document order, the element itself left out."""
        waiting = self.children[::-1]
        while waiting:
            x = waiting.pop()
            if isinstance(x, Element):
                yield x
                waiting += x.children[::-1]

    def matches(self, selector: list[tuple[str, frozenset[str]]]) -> bool:
        """Whether the last part fits the element and the others, in order, elements around it."""
        *outer, (tag, classes) = selector
        if not self._fits(tag, classes):
            return False
        x = self.parent
        while outer and x is not None:
            if x._fits(*outer[-1]):
                outer.pop()
            x = x.parent
        return not outer

    def _fits(self, tag: str, classes: frozenset[str]) -> bool:
        return tag in ("", self.tag) and (not classes or classes <= set(SPACES.split(self.attributes.get("class", ""))))

    def select(self, selector: str) -> Iterator[Element]:
        """Descendants that fit a selector of tags and classes such as ``table.wide tr``, in document order."""
        parts = parse_selector(selector)
        return (x for x in self.descendants() if x.matches(parts))

    def first(self, selector: str) -> Element | None:
        return next(self.select(selector), None)

    def text(self) -> str:
        """The rendered text."""
        return rendered(self)


@functools.cache
def parse_selector(selector: str) -> list[tuple[str, frozenset[str]]]:
    out = []
    for part in selector.split():
        if not re.fullmatch(r"[\w-]*(\.[\w-]+)*", part):
            raise ValueError(f"only tags and classes can be selected, not {part}")
        tag, *classes = part.split(".")
        out.append((tag.lower(), frozenset(classes)))
    return out


class Tree(HTMLParser):
    """The tree below ``root`` of what is fed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.open = [self.root]

    def _close(self, tags: set[str], upto: set[str], outermost: bool = False) -> None:
        found = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                found = k
                if not outermost:
                    break
            elif self.open[k].tag in upto:
                break
        if found is not None:
            del self.open[found:]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, SCOPE)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag], outermost=True)
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")  # the first of an attribute counts
        x = Element(tag, given, self.open[-1])
        self.open[-1].children.append(x)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(x)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close({tag}, set() if tag in ("table", "html", "body") else {"table"} if tag in CELLS | SECTIONS | {"tr", "caption"} else SCOPE - {tag})

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Element:
    tree = Tree()
    tree.feed((html or "").replace("\x00", ""))
    tree.close()
    return tree.root


def _hidden(x: Element) -> bool:
    return x.tag in NOT_RENDERED or "hidden" in x.attributes or re.search(r"display\s*:\s*none", x.attributes.get("style", ""), re.I) is not None


def rendered(top: Element) -> str:
    """Strings and, as numbers, how many new lines are wanted between them at least; then put together."""
    items: list[str | int] = []
    waiting: list = [(x, False) for x in top.children[::-1]]
    while waiting:
        x, pre = waiting.pop()
        if isinstance(x, (int, str)) and pre is None:
            items.append(x)
        elif isinstance(x, str):
            items.append(x if pre else SPACES.sub(" ", x))
        elif x.tag == "br":
            items.append("\n")
        elif not _hidden(x):
            around = 2 if x.tag == "p" else 1 if x.tag in BLOCKS or x.tag in SECTIONS or x.tag == "tr" else 0
            cell = x.tag in CELLS and any(isinstance(s, Element) and s.tag in CELLS for s in _after(x))
            if around:
                items.append(around)
            waiting += [(around, None)] * bool(around) + [("\t", None)] * cell + [(c, pre or x.tag == "pre") for c in x.children[::-1]]
    out, wanted = [], 0
    for x in items:
        if isinstance(x, int):
            wanted = max(wanted, x)
            continue
        if wanted and x.strip(" ") == "":
            continue  # white space between blocks
        if wanted and out:
            out.append("\n" * wanted)
        out.append(x)
        wanted = 0
    text = re.sub(" +", " ", "".join(out)) if not any(e.tag == "pre" for e in top.descendants()) else "".join(out)
    return re.sub(" *([\n\t]) *", r"\1", text).strip(" \n\t") if text else ""


def _after(x: Element) -> list:
    siblings = x.parent.children
    return siblings[next(k for k, s in enumerate(siblings) if s is x) + 1 :]


# ---------------------------------------------------------------- Spark


def select_text(pages: DataFrame, selectors: dict[str, str], html: str = "html") -> DataFrame:
    """``pages`` with an array column for each selector: the rendered texts of the elements that fit it, in document order."""
    return _extract(pages, html, {name: T.ArrayType(T.StringType()) for name in selectors}, lambda root: [[x.text() for x in root.select(s)] for s in selectors.values()])


def select_attribute(pages: DataFrame, column: str, selector: str, attribute: str, html: str = "html") -> DataFrame:
    """``pages`` with an array of (value, text) of the elements that fit ``selector`` and have ``attribute``."""
    kind = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("text", T.StringType())]))
    return _extract(pages, html, {column: kind}, lambda root: [[{"value": x.attributes[attribute], "text": x.text()} for x in root.select(selector) if attribute in x.attributes]])


def details(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``descripcion`` and ``especificaciones`` of store A's detail pages; a page without its table has the defaults."""
    pairs = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))

    def read(root: Element) -> list:
        if root.first(f"table.{E.TABLE_CLASS}") is None:
            return [None, []]
        text, found = root.first(f".{E.TEXT_CLASS}"), {}
        for row in root.select(f"table.{E.TABLE_CLASS} tr"):
            name, value = row.first(f".{E.NAME_CLASS}"), row.first(f".{E.VALUE_CLASS}")
            if name is not None and value is not None:
                found[name.text().strip()] = value.text().strip()
        return [text.text().replace("\n", " ").strip() if text is not None else None, [{"k": k, "v": v} for k, v in found.items()]]

    out = _extract(pages, html, {"descripcion": T.StringType(), "__pairs": pairs}, read)
    return out.withColumns({"descripcion": F.coalesce("descripcion", F.lit(E.NO_DESCRIPTION)), "especificaciones": F.map_from_entries("__pairs")}).drop("__pairs")


def _extract(pages: DataFrame, html: str, fields: dict[str, T.DataType], read) -> DataFrame:
    clash = [c for c in pages.columns if c in fields]
    if clash:
        raise ValueError(f"columns of the pages have the names of results: {clash}")
    src = pages.select(F.struct("*").alias("row"), F.col(html).alias("html"))
    schema = T.StructType([src.schema["row"], *(T.StructField(k, v) for k, v in fields.items())])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(v) for v in fields.values()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [read(parse(page)) for page in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], names=["row", *fields])

    return src.mapInArrow(run, schema).select("row.*", *fields)
