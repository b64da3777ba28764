"""Tables of HTML pages as grids: nested tables apart, spanned cells in every place that they span."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TABLES = "array<struct<caption:string,depth:int,rows:array<array<string>>>>"
#: Limits of HTML itself on spans.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534


def table_grids(html: Column) -> Column:
    """Every table of a page, in the order of their beginnings, with its caption, the number of tables around it, and its rows.

    One fold over the tags with a stack of open tables: a cell's text goes to the innermost open one, and a cell or row
    ends where the next one or its table does.  A cell that spans columns or rows is repeated in its places; a row span
    ends with its table.  Scripts, styles and comments are left out, references decoded, white space squeezed."""
    import html as codec
    import re

    tags = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)|<(/?)(table|caption|tr|t[dh])\b([^>]*)>|<[^>]*>", re.I | re.S)
    spans = re.compile(r"""\b(col|row)span\s*=\s*["']?\s*(\d+)""", re.I)

    def clean(parts):
        return re.sub(r"[\s ]+", " ", codec.unescape("".join(parts))).strip()

    class Grid:
        def __init__(self, depth):
            self.depth, self.caption, self.rows = depth, None, []
            self.cell = self.row = self.span = None
            self.above: dict[int, tuple[str, int]] = {}  # column: text of a row above and the rows that it still spans
            self.below: dict[int, tuple[str, int]] = {}  # the same for the next row

        def end_cell(self):
            if self.cell is None:
                return
            text, self.cell = clean(self.cell), None
            if self.span is None:
                self.caption = text if self.caption is None else self.caption
                return
            columns, rows = self.span
            for _ in range(columns):
                at = self.fill()
                self.row.append(text)
                if rows > 1:
                    self.below[at] = text, rows - 1

        def fill(self):
            """Put what spans down from above; the first free column."""
            while len(self.row) in self.above:
                at = len(self.row)
                text, rows = self.above.pop(at)
                self.row.append(text)
                if rows > 1:
                    self.below[at] = text, rows - 1
            return len(self.row)

        def begin_row(self):
            self.end_row()
            self.row, self.above, self.below = [], self.below, {}

        def end_row(self):
            self.end_cell()
            if self.row is not None:
                self.fill()
                # Beyond columns that this row doesn't have, spans go on.
                self.below |= {at: (text, rows - 1) for at, (text, rows) in self.above.items() if rows > 1}
                self.rows.append(self.row)
                self.row = None

    def parse(page):
        found, open_, at = [], [], 0
        for m in tags.finditer(page):
            top = open_[-1] if open_ else None
            if top is not None and top.cell is not None:
                top.cell += [page[at:m.start()], " "]
            at = m.end()
            name = (m.group(3) or "").lower()
            if not name:
                continue
            if name == "table":
                if not m.group(2):
                    found.append(Grid(len(open_)))
                    open_.append(found[-1])
                elif top is not None:
                    open_.pop().end_row()
            elif top is None:
                continue
            elif name == "caption":
                top.end_cell()
                if not m.group(2):
                    top.cell, top.span = [], None
            elif name == "tr":
                if m.group(2):
                    top.end_row()
                else:
                    top.begin_row()
            elif m.group(2):
                top.end_cell()
            else:
                top.end_cell()
                if top.row is None:
                    top.begin_row()
                own = {k.lower(): int(v[:6]) for k, v in spans.findall(m.group(4))}
                top.cell, top.span = [], (min(max(own.get("col", 1), 1), MAX_COLSPAN), min(max(own.get("row", 1), 1), MAX_ROWSPAN))
        while open_:
            open_.pop().end_row()
        return [{"caption": t.caption, "depth": t.depth, "rows": t.rows} for t in found]

    kind = pa.list_(pa.struct([("caption", pa.string()), ("depth", pa.int32()), ("rows", pa.list_(pa.list_(pa.string())))]))

    @F.arrow_udf(TABLES)
    def grids(pages: pa.Array) -> pa.Array:
        return pa.array([parse(p) if p and "<" in p else [] for p in pages.to_pylist()], kind)

    return grids(html)
