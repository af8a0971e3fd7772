"""Workbooks as a Spark data source: a row for each non-empty cell, a partition for each sheet.

    spark.dataSource.register(XlsxCells)
    spark.read.format("xlsx_cells").load("/path/or/folder")

Only the standard library reads the files: a sheet is streamed from its zip entry, so a partition holds one
element at a time. `write_workbook` makes small files for tests.
"""

from __future__ import annotations

import bisect
import datetime as dt
import glob
import hashlib
import heapq
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridlake.functions.formula import column_number

SCHEMA = (
    "workbook_id string, cell_id string, sheet string, row int, col string, col_ix int, v_num double, v_str string, v_bool boolean, v_date date, "
    "formula_raw string, data_type string, is_merged boolean, merge_range string, format_code string"
)
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show dates.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def letters(n: int) -> str:
    out = ""
    while n:
        n, d = divmod(n - 1, 26)
        out = chr(65 + d) + out
    return out


class SheetPartition(InputPartition):
    def __init__(self, path: str, sheet: str, entry: str) -> None:
        super().__init__((path, sheet, entry))
        self.path, self.sheet, self.entry = path, sheet, entry


def sheets(path: str) -> list[tuple[str, str]]:
    """Names of a workbook's sheets and their zip entries, in order."""
    with zipfile.ZipFile(path) as z:
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        return [(s.get("name"), "xl/" + rels[s.get(_REL + "id")].removeprefix("/xl/")) for s in book.iter(_MAIN + "sheet")]


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]


def _formats(z: zipfile.ZipFile) -> list[tuple[str, bool]]:
    """Format code and whether it shows a date, by style."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    codes = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(_MAIN + "numFmt")}
    out = []
    for group in root.iter(_MAIN + "cellXfs"):
        for xf in group:
            k = int(xf.get("numFmtId", 0))
            code = codes.get(k, "General" if k == 0 else str(k))
            plain = re.sub(r'"[^"]*"|\[[^\]]*\]', "", code)
            out.append((code, k in DATE_FORMATS or k in codes and bool(re.search("[ymdhs]", plain, re.I))))
    return out


def _merged(z: zipfile.ZipFile, entry: str) -> tuple[dict[tuple[int, int], str], list[tuple[int, int, int, int]]]:
    heads, boxes = {}, []
    with z.open(entry) as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == _MAIN + "mergeCell":
                a, _, b = e.get("ref").partition(":")
                (r1, c1), (r2, c2) = _place(a), _place(b or a)
                heads[r1, c1] = e.get("ref")
                boxes.append((r1, c1, r2, c2))
            elif e.tag == _MAIN + "row":
                e.clear()
    return heads, boxes


def _place(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref)
    return int(m[2]), column_number(m[1])


def _shift(formula: str, rows: int, cols: int) -> str:
    """A shared formula, seen from another cell."""

    def move(m: re.Match) -> str:
        c, r = m[2], int(m[4])
        return f"{m[1]}{c if m[1] else letters(column_number(c) + cols)}{m[3]}{r if m[3] else r + rows}"

    parts = re.split(r'("[^"]*"|\'[^\']*\'!)', formula)
    return "".join(p if k % 2 else re.sub(r"(\$?)\b([A-Z]{1,3})(\$?)(\d+)\b(?!\()", move, p) for k, p in enumerate(parts))


class MergedCells:
    """Which cells lie in merged ranges (first row, first column, last row, last column), asked row by row: ranges that have begun and not
    ended are held by their first column, so a cell is found among them by bisection and each range enters and leaves once. Ranges do not overlap."""

    def __init__(self, boxes: list[tuple[int, int, int, int]]) -> None:
        self.boxes = sorted(boxes, reverse=True)
        self._restart()

    def _restart(self) -> None:
        self.row, self.coming, self.open, self.ends = 0, list(self.boxes), [], []

    def _move_to(self, row: int) -> None:
        self.row = row
        while self.ends and self.ends[0][0] < row:
            _, first, last = heapq.heappop(self.ends)
            del self.open[bisect.bisect_left(self.open, (first, last))]
        while self.coming and self.coming[-1][0] <= row:
            _, first, end, last = self.coming.pop()
            if end >= row:
                bisect.insort(self.open, (first, last))
                heapq.heappush(self.ends, (end, first, last))

    def holds(self, row: int, col: int) -> bool:
        if row < self.row:
            self._restart()
        if row > self.row:
            self._move_to(row)
        at = bisect.bisect_right(self.open, (col, float("inf"))) - 1
        return at >= 0 and self.open[at][1] >= col


def read_sheet(path: str, sheet: str, entry: str) -> Iterator[tuple]:
    book = os.path.basename(path)
    with zipfile.ZipFile(path) as z:
        strings, formats, (heads, boxes), shared = _shared(z), _formats(z), _merged(z, entry), {}
        merged = MergedCells(boxes)
        with z.open(entry) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == _MAIN + "row":
                    e.clear()
                if e.tag != _MAIN + "c":
                    continue
                (row, col), kind = _place(e.get("r")), e.get("t", "n")
                value, formula = e.find(_MAIN + "v"), e.find(_MAIN + "f")
                raw = value.text if value is not None else None
                if kind == "inlineStr":
                    raw = "".join(t.text or "" for t in e.iter(_MAIN + "t"))
                code, is_date = formats[int(e.get("s", 0))] if formats else ("General", False)
                text = None
                if formula is not None:
                    text = formula.text
                    if formula.get("t") == "shared":
                        if text:
                            shared[formula.get("si")] = (text, row, col)
                        elif formula.get("si") in shared:
                            master, r0, c0 = shared[formula.get("si")]
                            text = _shift(master, row - r0, col - c0)
                    text = "=" + text if text else None
                if raw is None and text is None:
                    continue
                num = string = flag = date = None
                if raw is not None:
                    if kind == "s":
                        string = strings[int(raw)]
                    elif kind in ("str", "inlineStr", "e"):
                        string = raw
                    elif kind == "b":
                        flag, num = raw == "1", float(raw)
                    else:
                        num = float(raw)
                        if is_date and 0 < num < 2958466:
                            date = dt.date(1899, 12, 30) + dt.timedelta(days=int(num))
                what = "formula" if text else "boolean" if flag is not None else "date" if date else "number" if num is not None else "text"
                inside = merged.holds(row, col)
                name = letters(col)
                yield (book, f"{sheet}_{row}_{name}", sheet, row, name, col, num, string, flag, date, text, what, inside, heads.get((row, col)), code)


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.paths = sorted(glob.glob(f"{path}/*.xlsx")) if os.path.isdir(path) else [path]

    def partitions(self) -> list[SheetPartition]:
        return [SheetPartition(p, name, entry) for p in self.paths for name, entry in sheets(p)]

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        yield from read_sheet(partition.path, partition.sheet, partition.entry)


class XlsxCells(DataSource):
    """Reads one workbook, or all of a folder that every executor can reach."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"].removeprefix("file:"))


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(XlsxCells)
    return spark.read.format("xlsx_cells").load(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, file_hash, bytes of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.md5("content").alias("file_hash"), F.col("length").alias("bytes"))


def write_workbook(path: str, content: dict[str, dict[str, object]], merged: dict[str, list[str]] | None = None) -> str:
    """A small workbook from {sheet: {"A1": value or "=formula" or (formula, value)}}; returns its hash."""

    def cell(ref: str, v: object) -> str:
        if isinstance(v, tuple):
            return f'<c r="{ref}"><f>{escape(v[0].lstrip("="))}</f><v>{v[1]}</v></c>'
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, dt.date):
            return f'<c r="{ref}" s="1"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>'
        if isinstance(v, int | float):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if str(v).startswith("="):
            return f'<c r="{ref}"><f>{escape(str(v)[1:])}</f></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(content)
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for k, n in enumerate(names, 1):
            rows: dict[int, list[str]] = {}
            for ref, v in content[n].items():
                rows.setdefault(_place(ref)[0], []).append(cell(ref, v))
            body = "".join(f'<row r="{r}">{"".join(cells)}</row>' for r, cells in sorted(rows.items()))
            boxes = "".join(f'<mergeCell ref="{m}"/>' for m in (merged or {}).get(n, []))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData>{f'<mergeCells>{boxes}</mergeCells>' if boxes else ''}</worksheet>")
    with open(path, "rb") as f:
        return hashlib.md5(f.read()).hexdigest()
