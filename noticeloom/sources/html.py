"""Readers of HTML and word-processor files: Arrow functions of a batch of texts, each giving an array for a text."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from noticeloom.functions.text import trusted_url

SPACES = re.compile(r"\s+")
CELL = pa.struct([("class", pa.string()), ("text", pa.string()), ("hrefs", pa.list_(pa.string()))])
ROW = pa.struct([("attrs", pa.map_(pa.string(), pa.string())), ("cells", pa.list_(CELL))])
TABLE = pa.struct([("id", pa.string()), ("depth", pa.int32()), ("closed", pa.bool_()), ("rows", pa.list_(ROW))])
ROW_SQL = "struct<attrs:map<string,string>,cells:array<struct<class:string,text:string,hrefs:array<string>>>>"
TABLE_SQL = f"struct<id:string,depth:int,closed:boolean,rows:array<{ROW_SQL}>>"


def batched(returns: str, kind: pa.DataType, read, *columns: Column) -> Column:
    """read(value, ...) of each row, a batch of rows at a time."""

    def one(a: pa.Array) -> pa.Array:
        return pa.array([read(x) for x in a.to_pylist()], kind)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([read(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    return arrow_udf((one, two)[len(columns) - 1], returns)(*columns)


def _joined(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


@dataclass
class Table:
    """A table while it is read. Whatever opens or ends later ends the cell and row that are open."""

    id: str | None
    depth: int
    closed: bool = False
    rows: list[dict] = field(default_factory=list)
    cells: list[dict] | None = None
    attrs: dict = field(default_factory=dict)
    open_cell: dict | None = None

    def end_cell(self) -> None:
        if self.open_cell is not None:
            self.cells.append({**self.open_cell, "text": _joined(self.open_cell["text"])})
            self.open_cell = None

    def end_row(self) -> None:
        self.end_cell()
        if self.cells:
            self.rows.append({"attrs": list(self.attrs.items()), "cells": self.cells})
        self.cells = None

    def start_row(self, attrs: dict) -> None:
        self.end_row()
        self.cells, self.attrs = [], attrs

    def start_cell(self, attrs: dict) -> None:
        self.end_cell()
        if self.cells is not None:
            self.open_cell = {"class": attrs.get("class", ""), "text": [], "hrefs": []}


class Tables(HTMLParser):
    """All tables of a page, in the order in which they open. A nested table's text and links are its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[Table] = []
        self.path: list[Table] = []

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "table":
            self.path.append(Table(given.get("id"), len(self.path) + 1))
            self.found.append(self.path[-1])
            return
        inner = self.path[-1] if self.path else None
        if inner and tag == "tr":
            inner.start_row(given)
        elif inner and tag in ("td", "th"):
            inner.start_cell(given)
        elif inner and tag == "a" and inner.open_cell and given.get("href"):
            inner.open_cell["hrefs"].append(given["href"])

    def handle_endtag(self, tag):
        if not self.path:
            return
        if tag in ("td", "th"):
            self.path[-1].end_cell()
        elif tag in ("tr", "tbody", "thead"):
            self.path[-1].end_row()
        elif tag == "table":
            self.path[-1].end_row()
            self.path.pop().closed = True

    def handle_data(self, data):
        if self.path and self.path[-1].open_cell:
            self.path[-1].open_cell["text"].append(data)


# Pages of these tags and texts alone mean the same to HTMLParser, which takes several times as long: no references, comments,
# slashes in tags, and none of the elements whose content isn't markup.
ATTRIBUTE = r"""[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9-]*(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[a-zA-Z0-9_.-]+))?"""
PLAIN = re.compile(rf"<([a-zA-Z][a-zA-Z0-9]*)((?:{ATTRIBUTE})*)[ \t\n\r\f]*>|</([a-zA-Z][a-zA-Z0-9]*)>|([^<&]+)")
PLAIN_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9-]*)(?:=(?:"([^"]*)"|'([^']*)'|([a-zA-Z0-9_.-]+)))?""")
RAW_TEXT = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "svg", "math"))


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(name.lower(), a or b or c) for name, a, b, c in PLAIN_ATTRIBUTE.findall(text)]


def _plain(html: str, known: dict[str, list]) -> list[tuple] | None:
    """(tag, attributes, end tag, text) of a page one after the other, or None where it isn't plain. known: attributes by their text."""
    at, out = 0, []
    for m in PLAIN.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        tag, given, end, text = m.groups()
        if tag and tag.lower() in RAW_TEXT:
            return None
        if given and given not in known:
            known[given] = _attributes(given)
        out.append((tag and tag.lower(), known[given] if given else (), end and end.lower(), text))
    return out if at == len(html) else None


def read_tables(html: str | None, known: dict[str, list]) -> list[Table]:
    parser, plain = Tables(), _plain(html or "", known)
    if plain is None:
        parser.feed(html)
        parser.close()
    else:
        for tag, given, end, text in plain:
            if text:
                parser.handle_data(text)
            elif tag:
                parser.handle_starttag(tag, given)
            else:
                parser.handle_endtag(end)
    for x in parser.path:
        x.end_row()
    return parser.found


def tables_of(html: str | None) -> list[dict]:
    return [{"id": x.id, "depth": x.depth, "closed": x.closed, "rows": x.rows} for x in read_tables(html, {})]


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(sizes)], pa.int32()), values)


def _structs(kind: pa.StructType, *arrays: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(arrays), fields=list(kind))


def table_arrays(pages: list[list[Table]]) -> pa.Array:
    """list<TABLE> for each page, made column by column."""
    tables = [t for p in pages for t in p]
    rows = [r for t in tables for r in t.rows]
    cells = [c for r in rows for c in r["cells"]]
    pairs = [x for r in rows for x in r["attrs"]]
    text = lambda xs: pa.array(xs, pa.string())
    hrefs = _lists([len(c["hrefs"]) for c in cells], text([h for c in cells for h in c["hrefs"]]))
    cell = _structs(CELL, text([c["class"] for c in cells]), text([c["text"] for c in cells]), hrefs)
    at = pa.array([0, *itertools.accumulate(len(r["attrs"]) for r in rows)], pa.int32())
    attrs = pa.MapArray.from_arrays(at, text([k for k, _ in pairs]), text([v for _, v in pairs]))
    row = _structs(ROW, attrs, _lists([len(r["cells"]) for r in rows], cell))
    kinds = (text([t.id for t in tables]), pa.array([t.depth for t in tables], pa.int32()), pa.array([t.closed for t in tables], pa.bool_()))
    return _lists([len(p) for p in pages], _structs(TABLE, *kinds, _lists([len(t.rows) for t in tables], row)))


def html_tables(html: Column) -> Column:
    """Every table of a page with its id, depth (1: in no other), whether it ends, and its rows with cells. Null: none."""

    def read(pages: pa.Array) -> pa.Array:
        known: dict[str, list] = {}
        return table_arrays([read_tables(x, known) for x in pages.to_pylist()])

    return arrow_udf(read, f"array<{TABLE_SQL}>")(html)


def table_named(tables: Column, name: str) -> Column:
    """The first table with the id that is in no other table, or null."""
    return F.try_element_at(F.filter(tables, lambda t: (t["id"] == name) & (t["depth"] == 1)), F.lit(1))


# What a tag does to the tables of a page, for all tags of many pages at once.
OPENS, CLOSES, ROW_STARTS, CELL_STARTS, CELL_ENDS, ROW_ENDS, NOT_PLAIN = range(1, 8)
DOES = {"table": OPENS, "tr": ROW_STARTS, "td": CELL_STARTS, "th": CELL_STARTS} | dict.fromkeys(RAW_TEXT, NOT_PLAIN)
ENDS = {"table": CLOSES, "td": CELL_ENDS, "th": CELL_ENDS, "tr": ROW_ENDS, "tbody": ROW_ENDS, "thead": ROW_ENDS}
PAGE_BYTES = 8 << 20
LEAN_ROW = pa.struct([("attrs", pa.list_(pa.string())), ("classes", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
LEAN = pa.struct([("closed", pa.bool_()), ("rows", pa.list_(LEAN_ROW))])
LEAN_SQL = "struct<closed:boolean,rows:array<struct<attrs:array<string>,classes:array<string>,texts:array<string>>>>"


def _tag(text: str) -> tuple[int, dict]:
    """What a tag, given without its end, does, and its attributes. Nothing at all stands for the end of a page."""
    m = PLAIN.fullmatch(text + ">") if text else None
    if m is None:
        return NOT_PLAIN if text else 0, {}
    return (DOES.get(m[1].lower(), 0), dict(_attributes(m[2]))) if m[1] else (ENDS.get(m[3].lower(), 0), {})


def _tags(tags: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[pa.Array]]:
    """What each tag does, and for each name the values of that attribute. Tags that differ in quoted values alone are looked at once."""
    single = pc.match_substring(tags, "'")  # a quote within these may be part of a value
    shapes = pc.if_else(single, tags, pc.replace_substring_regex(tags, '"[^"]*"', '""')).dictionary_encode()
    shape, parts = shapes.indices.to_numpy(), pc.split_pattern(tags, '"')
    at, values = parts.offsets.to_numpy()[:-1], parts.flatten()
    does, constants, where = [], [], np.full((len(names), len(shapes.dictionary)), -1)
    for i, text in enumerate(shapes.dictionary.to_pylist()):
        pieces = text.split('""') if "'" not in text else [text]
        act, given = _tag("".join(f'{x}"\0{j}"' for j, x in enumerate(pieces[:-1])) + pieces[-1])
        does.append(act)
        for k, name in enumerate(names):
            value = given.get(name)
            if value and value[0] == "\0" and "'" not in text:
                where[k, i] = 2 * int(value[1:]) + 1  # a quoted value: the part after so many quotes
            else:
                constants.append(value)
                where[k, i] = -len(constants)
    known = pa.concat_arrays([values, pa.array(constants, pa.string())])
    pick = lambda w: known.take(pa.array(np.where(w[shape] > 0, at + w[shape], len(values) - 1 - w[shape])))
    return np.array(does, np.int8)[shape], [pick(w) for w in where]


def _last(where: np.ndarray) -> np.ndarray:
    """For each place the last one up to it that is marked."""
    return np.maximum.accumulate(np.where(where, np.arange(len(where), dtype=np.int32), 0))


def _slow(html: str | None, name: str, attributes: tuple[str, ...]) -> dict | None:
    for t in read_tables(html, {}):
        if t.id == name and t.depth == 1:
            rows = [{"attrs": [dict(r["attrs"]).get(a) for a in attributes], "classes": [c["class"] for c in r["cells"]], "texts": [c["text"] for c in r["cells"]]} for r in t.rows]
            return {"closed": t.closed, "rows": rows}
    return None


def named_tables(pages: pa.Array, name: str, attributes: tuple[str, ...]) -> pa.Array:
    """LEAN for each page: what read_tables says of the first table with the id that is in no other, or null.

    Tags and texts of all pages are told apart, matched to rows and cells, and made whole as arrays; different tags and different texts
    are looked at once. A page that isn't plain, or closes more tables than it opens, is read by itself.
    """
    n = len(pages)
    at = np.frombuffer(pages.buffers()[1], np.int32)[pages.offset : pages.offset + n + 1]
    content = np.frombuffer(pages.buffers()[2], np.uint8)[at[0] : at[-1]] if pages.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = (at - at[0]).astype(np.int32)
    # Where tags begin and end, by turns; a page ends with an empty tag, so that texts stay in their page.
    marks = np.flatnonzero((content == 60) | (content == 62)).astype(np.int32)
    first = np.searchsorted(marks, at)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    bad = np.diff(first) % 2 > 0
    begins = (np.arange(len(marks), dtype=np.int32) - np.repeat(first[:-1].astype(np.int32), np.diff(first))) & 1 == 0
    bad[owner[(content[marks] == 60) != begins]] = True
    bad[np.searchsorted(at, np.flatnonzero(content == 38), "right") - 1] = True
    good = np.flatnonzero(~bad)
    if bad.any():
        keep = ~bad[owner]
        marks, owner = marks[keep], owner[keep]
    ends = np.repeat(np.searchsorted(owner, good, "right"), 2)
    bounds = np.insert(marks, ends, np.repeat(at[good + 1], 2))
    page = np.insert(owner, ends, np.repeat(good, 2))[::2]
    pieces = pa.StringArray.from_buffers(max(len(bounds) - 1, 0), pa.py_buffer(bounds), pa.py_buffer(content))
    tags = pieces.take(pa.array(np.arange(0, len(pieces), 2))).dictionary_encode()
    does, (ids, classes, *values) = _tags(tags.dictionary, ("id", "class", *attributes))
    code = tags.indices.to_numpy()
    does = does[code]
    bad[page[does == NOT_PLAIN]] = True
    last = np.flatnonzero(np.diff(page, append=n))  # the last tag of each page
    depth = np.cumsum((does == OPENS).astype(np.int8) - (does == CLOSES).astype(np.int8), dtype=np.int32)
    depth -= np.repeat(np.concatenate(([0], depth[last[:-1]])) if len(last) else [], np.diff(last, prepend=-1)).astype(np.int32)
    bad[page[depth < 0]] = True
    # The table: from its tag to the one that closes it or to the end of the page; what is nested in it isn't its own.
    opened = np.flatnonzero((does == OPENS) & (depth == 1) & pc.equal(ids, name).fill_null(False).to_numpy(zero_copy_only=False)[code] & ~bad[page])
    opened = opened[np.unique(page[opened], return_index=True)[1]]
    shut = np.concatenate((np.flatnonzero((does == CLOSES) & (depth == 0)), [len(page)]))
    close, end = shut[np.searchsorted(shut, opened)], last[np.searchsorted(last, opened)]
    inside = np.zeros(len(page) + 1, np.int8)
    inside[opened] += 1
    inside[np.minimum(close, end)] -= 1
    own = np.flatnonzero((np.cumsum(inside[:-1], dtype=np.int8) > 0) & (depth == 1))
    does, code = does[own], code[own]
    row = _last((does == OPENS) | (does == ROW_STARTS) | (does == ROW_ENDS))
    is_cell = (does == CELL_STARTS) & (does[row] == ROW_STARTS)
    cells = np.flatnonzero(is_cell)
    said = _last((does != 0) & (does != CLOSES))
    said = np.where(is_cell[said] & (bounds[2 * own + 2] - bounds[2 * own + 1] > 1), said, -1)  # the cell that the text after a tag stands in
    spoken = np.flatnonzero(said >= 0)
    words = pieces.take(pa.array(2 * own[spoken] + 1)).dictionary_encode()
    raw, word, cell = pc.utf8_slice_codeunits(words.dictionary, 1), words.indices.to_numpy(), (np.cumsum(is_cell) - 1)[said[spoken]]
    whole = np.arange(len(raw))  # where a text stands as a whole: letters and digits alone stay as they are
    spaced = np.flatnonzero(~pc.match_substring_regex(raw, "^[!-~]*$").to_numpy(zero_copy_only=False))
    whole[spaced] = len(raw) + 1 + np.arange(len(spaced))
    more = ["", *(_joined([x]) for x in raw.take(pa.array(spaced)).to_pylist())]
    of = np.full(len(cells), len(raw))
    of[cell] = whole[word]
    again = np.flatnonzero(np.bincount(cell, minlength=len(cells))[cell] > 1)
    several: dict[int, list[str]] = {}
    for i, x in zip(cell[again].tolist(), raw.take(pa.array(word[again])).to_pylist(), strict=True):
        several.setdefault(i, []).append(x)
    for i, parts in several.items():
        of[i] = len(raw) + len(more)
        more.append(_joined(parts))
    rows, n_cells = np.unique(row[cells], return_counts=True)
    text = lambda xs: pa.array(xs, pa.string())
    lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)
    k, n_tags = len(attributes), len(tags.dictionary)
    given = pa.concat_arrays([text([]), *values]).take(pa.array((code[rows][:, None] + n_tags * np.arange(k)).ravel()))
    classes = classes.fill_null("").take(pa.array(code[cells]))
    read = _structs(LEAN_ROW, lists(np.full(len(rows), k), given), lists(n_cells, classes), lists(n_cells, pa.concat_arrays([raw, text(more)]).take(pa.array(of))))
    closed, none = np.zeros(n, bool), np.ones(n, bool)
    closed[page[opened]], none[page[opened]] = close <= end, False
    out = pa.StructArray.from_arrays([pa.array(closed), lists(np.bincount(page[own][rows], minlength=n), read)], fields=list(LEAN), mask=pa.array(none))
    if not bad.any():
        return out
    rest = pa.array([_slow(x, name, attributes) for x in pages.filter(pa.array(bad)).to_pylist()], LEAN)
    order = np.arange(n)
    order[bad] = n + np.arange(bad.sum())
    return pa.concat_arrays([out, rest]).take(pa.array(order))


def html_table(html: Column, name: str, *attributes: str) -> Column:
    """The first table of a page with the id that is in no other table, or null: whether it ends, and its rows with the values of some
    attributes (null: it has none) and the classes and texts of their cells. The same as table_named of html_tables, for a fraction of its work."""

    def read(pages: pa.Array) -> pa.Array:
        pages, out, at = pages.cast(pa.string()).fill_null(""), [], 0
        sizes = np.cumsum(pc.binary_length(pages).to_numpy(zero_copy_only=False))
        while at < len(pages):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PAGE_BYTES, "right")))
            out.append(named_tables(pages.slice(at, upto - at), name, attributes))
            at = upto
        return pa.concat_arrays(out) if out else pa.array([], LEAN)

    return arrow_udf(read, LEAN_SQL)(html)


def table_rows(tables: Column) -> Column:
    """The rows of all tables, one array."""
    return F.flatten(F.transform(tables, lambda t: t["rows"]))


class Links(HTMLParser):
    """Links with their text; a link ends where the next begins."""

    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.href, self.parts, self.found = base, None, [], []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.end()
            href = dict(attrs).get("href")
            self.href = urljoin(self.base or "", href) if href else None

    def handle_endtag(self, tag):
        if tag == "a":
            self.end()

    def handle_data(self, data):
        if self.href:
            self.parts.append(data)

    def end(self):
        if self.href:
            self.found.append({"href": self.href, "label": _joined(self.parts)})
        self.href, self.parts = None, []


def links_in(html: str | None, base: str | None) -> list[dict]:
    parser = Links(base)
    parser.feed(html or "")
    parser.close()
    parser.end()
    return parser.found


def html_links(html: Column, base: Column) -> Column:
    """Every link of a page in order, absolute where the base (or null) allows it, with its text."""
    kind = pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())]))
    return batched("array<struct<href:string,label:string>>", kind, links_in, html, base)


# What names of documents end with, and words of links that lead to a notice's document or to other papers.
EXTENSIONS = r"\.(?:pdf|hwpx?|docx?)"
NOTICE_WORDS, FILE_WORDS, OTHER_PAPERS = r"공고문|모집공고|첨부파일|notice", r"download|file|attach|atch", r"팜플렛|위임장|작성예시|유치금|동호수배치|분양신청서"


def document_links(html: Column, base: Column, hosts: tuple[str, ...]) -> Column:
    """The links of a page to its notice's documents, in order and once each: on trusted hosts, and a document by their name, or by
    the words of label and target together; other papers only where the label speaks of a notice. None of a page that isn't trusted itself."""
    def wanted(x: Column) -> Column:
        label, target = F.lower(F.coalesce(x["label"], F.lit(""))), F.lower(x["href"])
        document = target.rlike(EXTENSIONS) | label.rlike(EXTENSIONS) | (label.rlike(NOTICE_WORDS) & target.rlike(FILE_WORDS))
        return trusted_url(x["href"], hosts) & document & ~(label.rlike(OTHER_PAPERS) & ~label.contains("공고"))

    found = F.array_distinct(F.transform(F.filter(html_links(html, base), wanted), lambda x: x["href"]))
    return F.when(trusted_url(base, hosts), found).otherwise(F.filter(found, lambda _: F.lit(False)))


PUSH = re.compile(r"(\w+)\.push\(\s*\{(.*?)\}\s*\)", re.S)
PAIR = re.compile(r"""["']?(\w+)["']?\s*:\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([^,"'\s}]+))""")


def objects_in(script: str | None) -> list[dict]:
    return [{"name": m[1], "item": [(p[1], next((x for x in (p[2], p[3], p[4]) if x is not None), "")) for p in PAIR.finditer(m[2])]} for m in PUSH.finditer(script or "")]


def pushed_objects(script: Column) -> Column:
    """The flat objects that a page's script pushes to arrays, in order, read by pattern and never run."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("item", pa.map_(pa.string(), pa.string()))]))
    return batched("array<struct<name:string,item:map<string,string>>>", kind, objects_in, script)


def sections_in(content: bytes | None) -> list[str]:
    if not content or content[:2] != b"PK":
        return []
    with zipfile.ZipFile(io.BytesIO(content)) as whole:
        names = sorted((int(m[1]), n) for n in whole.namelist() if (m := re.search(r"section(\d+)\.xml$", n, re.I)))
        out = []
        for _, name in names:
            last = lambda e: e.tag.rsplit("}", 1)[-1]
            paragraphs = ["".join(t.text or "" for t in p.iter() if last(t) == "t") for p in ElementTree.fromstring(whole.read(name)).iter() if last(p) == "p"]
            out.append("\n".join(x for x in paragraphs if x))
    return out


def hwpx_pages(content: Column) -> Column:
    """The whole text of each section of a zipped word-processor file, in numeric order; other content gives none."""
    return batched("array<string>", pa.list_(pa.string()), sections_in, content)


# How files begin.
MAGIC = {"pdf": "25504446", "hwp": "D0CF11E0A1B11AE1", "zip": "504B0304", "gzip": "1F8B", "png": "89504E47", "jpeg": "FFD8FF"}


def file_format(content: Column) -> Column:
    """What a file is by its first bytes, html by its first tag; else unknown."""
    start = F.hex(F.substring(content, 1, 8))
    out = F.when(F.lower(F.substring(content, 1, 256).cast("string")).rlike(r"^\s*<(?:!doctype html|html)"), "html").otherwise("unknown")
    for name, magic in MAGIC.items():
        out = F.when(start.startswith(magic), name).otherwise(out)
    return F.when(content.isNotNull(), out)
