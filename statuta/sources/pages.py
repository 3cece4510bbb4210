"""Structured legal pages: whole files, size gate, and the flat node table.

The parser knows nothing about law. It turns a page into rows in document order; which node is an
article, a paragraph or a point is decided afterwards by DataFrame rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.text import SPACES

NODE_DDL = (
    "seq int, end_seq int, depth int, parent_seq int, path array<int>, tag string, node_id string, "
    "class string, text string, up array<struct<seq: int, tag: string, id: string>>, "
    "label struct<cells: int, first: string, label: string, text_cell: int>"
)
UP = pa.list_(pa.struct([("seq", pa.int32()), ("tag", pa.string()), ("id", pa.string())]))
LABEL = pa.struct([("cells", pa.int32()), ("first", pa.string()), ("label", pa.string()), ("text_cell", pa.int32())])
ROWS_PER_BATCH = 10_000
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset(("script", "style", "noscript"))
NO_TEXT = frozenset(("html", "head", "body"))
CLOSES = {
    "p": ("p",),
    "li": ("li", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "tr": ("tr", "td", "th", "p"),
}
SCOPE = frozenset(("table", "ul", "ol", "div", "body", "article"))
RUN, LINES = re.compile("[ \t]+"), re.compile("\n{3,}")
#: White space as `strip` has it.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: page_id (path), html, bytes, as_of (modification date)."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(path, wholetext=True)  # as an option it would be overridden by this argument's default
        .select(
            F.col("_metadata.file_path").alias("page_id"),
            F.col("value").alias("html"),
            F.col("_metadata.file_size").alias("bytes"),
            F.to_date("_metadata.file_modification_time").alias("as_of"),
        )
    )


def size_gate(pages: DataFrame, minimum: int, html: str = "html") -> DataFrame:
    """Adds `accepted`: pages below the minimum size are truncated downloads."""
    return pages.withColumn("accepted", F.octet_length(html) >= minimum)


class _Nodes(HTMLParser):
    """Collects element rows and the text pieces between them, and the cells of every table's first row."""

    def __init__(self, wanted: Callable[[str, str | None, str | None], bool] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted = wanted
        self.rows: list[list] = []
        self.open: list[int] = []
        self.pieces: list[str] = []
        self.first: list[int] = []
        self.top_row: dict[int, int] = {}
        self.cells: dict[int, list[int]] = {}
        self.kept: list[int] = []
        self.dropped = 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in DROPPED:
            self.dropped += 1
        if self.dropped:
            return
        self._imply(tag)
        at = dict(attrs)
        seq = len(self.rows)
        row = [seq, seq, len(self.open), self.open[-1] if self.open else None, None, tag, at.get("id"), at.get("class"), None, None, None]
        if self.wanted is None or self.wanted(tag, row[6], row[7]):
            self.kept.append(seq)
            row[4], row[9] = list(self.open), self._named()
        self.rows.append(row)
        if tag == "tr":
            for table in self._tables():
                self.top_row.setdefault(table, seq)
        elif tag in ("td", "th"):
            for table in self._tables():
                if self.top_row.get(table) in self.open:
                    self.cells.setdefault(table, []).append(seq)
        self.first.append(len(self.pieces))
        if tag not in VOID:
            self.open.append(seq)

    def _named(self) -> list[dict]:
        """What encloses the next row and has an id, from the outside in."""
        return [{"seq": s, "tag": self.rows[s][5], "id": self.rows[s][6]} for s in self.open if self.rows[s][6] is not None]

    def _tables(self) -> list[int]:
        return [s for s in self.open if self.rows[s][5] == "table"]

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _imply(self, tag) -> None:
        for closed in CLOSES.get(tag, ()):
            for seq in reversed(self.open):
                if self.rows[seq][5] == closed:
                    self._close(seq)
                    break
                if self.rows[seq][5] in SCOPE:
                    break

    def handle_endtag(self, tag) -> None:
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
            return
        if self.dropped:
            return
        for seq in reversed(self.open):
            if self.rows[seq][5] == tag:
                self._close(seq)
                return

    def _close(self, seq: int) -> None:
        while self.open:
            top = self.open.pop()
            self._finish(top)
            if top == seq:
                return

    def _finish(self, seq: int) -> None:
        row = self.rows[seq]
        row[1] = len(self.rows) - 1
        if row[5] not in NO_TEXT:
            row[8] = len(self.pieces)

    def handle_data(self, data) -> None:
        data = data.strip()
        if data and not self.dropped:
            self.pieces.append(_tidy(data))

    def _text(self, seq: int) -> str | None:
        """The pieces inside a node, as `normalise_space` would give them: only joints can add to what pieces lack."""
        end = self.rows[seq][8]
        if end is None:
            return None
        text = " ".join(self.pieces[self.first[seq] : end])
        return (RUN.sub(" ", text) if "  " in text else text).strip(BLANKS)

    def finish(self) -> list[list]:
        self.close()
        while self.open:
            self._finish(self.open.pop())
        for table, cells in self.cells.items():
            if self.rows[table][9] is None:
                continue
            texts = [self._text(c) for c in cells[:-1]]
            at = next((i for i, t in enumerate(texts) if t), None)
            label = None if at is None else cells[at]
            after = None if label is None else next((c for c in cells if c > label), None)
            first = texts[0] if texts else self._text(cells[0])
            self.rows[table][10] = {"cells": len(cells), "first": first, "label": None if at is None else texts[at], "text_cell": after}
        return [self.rows[seq][:8] + [self._text(seq)] + self.rows[seq][9:] for seq in self.kept]


def _tidy(piece: str) -> str:
    """A piece with blank variants as blanks, hard hyphens as hyphens, runs collapsed, at most one empty line."""
    for space in SPACES:
        piece = piece.replace(space, " ")
    piece = piece.replace("\u2011", "-")
    if "  " in piece or "\t" in piece:
        piece = RUN.sub(" ", piece)
    return LINES.sub("\n\n", piece) if "\n\n\n" in piece else piece


def node_table(
    pages: DataFrame, key: str = "page_id", html: str = "html", wanted: Callable[[str, str | None, str | None], bool] | None = None
) -> DataFrame:
    """pages → (page_id, seq, end_seq, depth, parent_seq, path, tag, node_id, class, text, up, label).

    `up` names the enclosing nodes that have an id. `label` is set for tables with cells in their first row: the
    number of these, the text of the first, of the first that is not empty among all but the last, and the cell
    behind that one. Where nodes of some kinds are read only, `wanted` (tag, id, class) tells which; the others are
    counted and looked through, but their rows and texts never leave the parser.

    Streams batch by batch; a worker holds the nodes of some 10,000 rows, or of one long page.
    """
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        int32, text = pa.int32(), pa.string()
        types = [int32, int32, int32, int32, pa.list_(int32), text, text, text, text, UP, LABEL]
        names = [key, "seq", "end_seq", "depth", "parent_seq", "path", "tag", "node_id", "class", "text", "up", "label"]

        def emit(ids: list, columns: list[list], id_type: pa.DataType) -> pa.RecordBatch:
            arrays = [pa.array(ids, id_type), *[pa.array(c, t) for c, t in zip(columns, types)]]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            sources = batch.column(html)
            id_type = batch.schema.field(key).type
            ids: list = []
            columns: list[list] = [[] for _ in types]
            for page, source in zip(batch.column(key).to_pylist(), sources):
                nodes = _Nodes(wanted)
                nodes.feed(source.as_py() or "")
                rows = nodes.finish()
                ids.extend([page] * len(rows))
                for column, values in zip(columns, zip(*rows)):
                    column.extend(values)
                if len(ids) >= ROWS_PER_BATCH:
                    yield emit(ids, columns, id_type)
                    ids, columns = [], [[] for _ in types]
            if ids:
                yield emit(ids, columns, id_type)

    return pages.select(key, html).mapInArrow(parse, f"{key} {kind}, {NODE_DDL}")


def rename_anchors(nodes: DataFrame, rules: list[tuple[str, str]], key: str = "page_id") -> DataFrame:
    """Give nodes the ids the unit rules look for: (SQL predicate, SQL expression for the id).

    `up` falls away, as it holds the ids given before.
    """
    chain = None
    for predicate, new_id in rules:
        test, value = F.expr(predicate), F.expr(new_id)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return nodes.withColumn("node_id", F.coalesce(chain, F.col("node_id"))).drop("up")
