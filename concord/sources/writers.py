"""Sinks: JSON lines, JSON arrays of bounded sets, append-only logs, sheets, results split by outcome."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.shared import file_system


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; nulls are left out of records. append: each call adds the files of one batch."""
    df.write.mode("append" if append else "overwrite").json(path)


def _put(df: DataFrame, path: str, data: bytes) -> None:
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_array(df: DataFrame, path: str, most: int = 100_000) -> int:
    """One file with a JSON array, two spaces to a level, characters as they are; for sets of at most `most` rows."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write_lines has no such bound")
    _put(df, path, json.dumps([json.loads(r[0]) for r in rows], ensure_ascii=False, indent=2).encode())
    return len(rows)


def write_sheet(df: DataFrame, path: str) -> None:
    """A sheet as CSV with a header and no index."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}  # fixed values: the parts of a workbook with one sheet
#: Characters that XML can't hold; workbooks write them as _xHHHH_.
_UNSAFE = re.compile(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    text = _UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>', "</sheetData></worksheet>"


def _row(values: Iterable[object]) -> str:
    return f"<row>{''.join(map(_cell, values))}</row>"


class _Book:
    """A workbook of one sheet, compressed as its rows come in."""

    def __init__(self, header: Sequence[str]):
        self.sink, self.rows, self.size, head = io.BytesIO(), 0, 0, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
        self.book = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_DEFLATED)
        for name, part in _PARTS.items():
            self.book.writestr(name, head + part)
        self.sheet = self.book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write((head + _SHEET[0] + _row(header)).encode())

    def add(self, values: Iterable[object]) -> None:
        data = _row(values).encode()
        self.sheet.write(data)
        self.rows, self.size = self.rows + 1, self.size + len(data)

    def done(self, comment: bytes = b"") -> bytes:
        self.sheet.write(_SHEET[1].encode())
        self.sheet.close()
        self.book.comment = comment
        self.book.close()
        return self.sink.getvalue()


def write_excel(df: DataFrame, path: str, most: int = 100_000) -> int:
    """A sheet as a workbook with a header and no index; for sets of at most `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write_workbooks and write_sheet have no such bound")
    book = _Book(df.columns)
    for r in rows:
        book.add(r)
    _put(df, path, book.done())
    return len(rows)


def write_workbooks(df: DataFrame, path: str, most: int = 100_000, size: int = 32 << 20) -> None:
    """A sheet of any length as a new folder of workbooks, written by the tasks; each has the header, at most `most` rows, and is closed once its XML has `size` bytes."""
    columns = df.columns

    def books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = None

        def give() -> pa.RecordBatch:
            # Spark's writer of texts ends each with a line feed: the last byte of the workbook, its comment
            return pa.RecordBatch.from_arrays([pa.array([book.done(b"\n")[:-1]], pa.binary())], names=["value"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                for values in zip(*(c.to_pylist() for c in batch.slice(lo, 1000).columns), strict=True):
                    book = book or _Book(columns)
                    book.add(values)
                    if book.rows >= most or book.size >= size:
                        yield give()
                        book = None
        if book:
            yield give()

    df.mapInArrow(books, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)
    fs, folder = file_system(df.sparkSession, path)
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    jvm = df.sparkSession.sparkContext._jvm
    written = [n for n in names if n.startswith("part-") and fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(folder, n)).getLen()]
    for n in names:
        if n in written:
            fs.rename(jvm.org.apache.hadoop.fs.Path(folder, n), jvm.org.apache.hadoop.fs.Path(folder, n.removesuffix(".txt") + ".xlsx"))
        elif n.startswith("part-"):  # of a task without rows
            fs.delete(jvm.org.apache.hadoop.fs.Path(folder, n), False)
    if not written:
        _put(df, f"{path}/part-00000.xlsx", _Book(columns).done())


def write_outcomes(df: DataFrame, results: str, rejects: str) -> None:
    """Rows with outcome 'ok' or 'insufficient' go to results, 'filtered' to rejects; others are retried next time. df is read once: its rows may cost calls."""
    spark = df.sparkSession
    held = f"{results.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(held)
    once = spark.read.schema(df.schema).parquet(held)
    write_lines(once.where(F.col("outcome").isin("ok", "insufficient")), results, append=True)
    write_lines(once.where("outcome = 'filtered'"), rejects, append=True)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(held)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
