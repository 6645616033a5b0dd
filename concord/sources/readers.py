"""Scans: JSON arrays, JSON lines (strict or tolerant), delimited labels, whole documents, optional inputs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that Spark reads it by."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with one JSON array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_log(spark: SparkSession, path: str, schema: str, strict: bool = False, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines. strict: a malformed line raises an error; else it is left out, as are rows without a required field."""
    found = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return found.dropna(subset=list(required)) if required else found


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of a log that aren't records."""
    # parsed from text, so that the check doesn't depend on which columns are read
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.where(parsed["_bad"].isNotNull()).select("value")


def read_labels(spark: SparkSession, path: str, sep: str = ";", null: str = "NULL") -> DataFrame:
    """A delimited file with a header; names of columns are trimmed."""
    found = spark.read.csv(path, sep=sep, header=True, nullValue=null)
    return found.toDF(*[c.strip() for c in found.columns])


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet, as they are parsed."""
    unescape = lambda t: re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), t)

    def value(c) -> str | None:
        text = c.find(f"{_MAIN}is/{_MAIN}t") if c.get("t") == "inlineStr" else c.find(f"{_MAIN}v")
        return None if text is None else unescape(text.text or "")

    with zipfile.ZipFile(io.BytesIO(content)) as book, book.open("xl/worksheets/sheet1.xml") as sheet:
        held = None  # the rows' element, emptied of what was given
        for event, x in ElementTree.iterparse(sheet, ("start", "end")):
            if event == "start" and x.tag == f"{_MAIN}sheetData":
                held = x
            elif event == "end" and x.tag == f"{_MAIN}row":
                yield [value(c) for c in x]
                held.clear()


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook that `write_excel` wrote, or of all in a folder by `write_workbooks`, all columns as strings; a workbook is one task's work."""
    found = spark.read.format("binaryFile").load(path).select("content")

    def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([next(_sheet_rows(content.as_py()))], pa.list_(pa.string()))], names=["header"])

    names = found.limit(1).mapInArrow(header, "header array<string>").head()[0]
    schema = pa.schema([(n, pa.string()) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = _sheet_rows(content.as_py())
                if (own := next(rows)) != names:
                    raise ValueError(f"workbooks of one folder differ in their columns: {names}, {own}")
                while some := list(islice(rows, 1000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], schema=schema)

    return found.mapInArrow(read, StructType([StructField(n, StringType()) for n in names]))


def read_optional(spark: SparkSession, path: str, schema: str, reader=read_log) -> DataFrame:
    """What reader finds at path, or no rows if there is no such path."""
    return reader(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], StructType.fromDDL(schema))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A file as one row: value."""
    return spark.read.text(path, wholetext=True)


def first_incomplete(df: DataFrame, *fields: str) -> DataFrame:
    """A row that lacks one of the fields, if there is any: a probe that reads no more than it needs."""
    lacking = F.lit(False)
    for f in fields:
        lacking = lacking | F.col(f).isNull()
    return df.where(lacking).limit(1)
