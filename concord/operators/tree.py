"""Leaves of nested JSON documents with their paths: one parse a document, and one pass over it with a stack.

Objects are walked by key, which joins the path; lists are walked without. An
object within a list that has all key fields is a leaf and isn't entered; such an
object as the value of a key is walked on. Scalars are ignored, texts that look
like objects or lists included. Where an object repeats a key, its last value
counts, at the first one's place. A key field that is no whole number of 32 bits,
as a number or as text, gives null.

Documents are worked on in parallel, each by one task, in time and memory in
proportion to its length; a depth of thousands is no matter. A document that is null
or isn't JSON has no leaves. No setting of the session is touched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_WHOLE = re.compile(r"\s*[+-]?[0-9]+\s*")


def _whole(value: object) -> int | None:
    """value as a number of 32 bits, if it is one or spells one."""
    if isinstance(value, str) and _WHOLE.fullmatch(value):
        value = int(value)
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**31) <= value < 2**31 else None


def walk(text: str | None, keys: Sequence[str]) -> Iterator[tuple[list[int | None], list[str], list[int]]]:
    """Key fields, path and place (child numbers from the root) of each leaf, in the document's order."""
    try:
        root = json.loads(text) if text else None
    except ValueError:
        return
    waiting = [(root, False, (), ())]  # paths as nested pairs: a child shares its parent's
    while waiting:
        node, in_list, path, place = waiting.pop()
        if isinstance(node, dict):
            if in_list and all(k in node for k in keys):
                yield [_whole(node[k]) for k in keys], _unrolled(path), _unrolled(place)
            else:
                waiting += [(v, False, (path, k), (place, i)) for i, (k, v) in reversed([*enumerate(node.items())]) if isinstance(v, dict | list)]
        elif isinstance(node, list):
            waiting += [(v, True, path, (place, i)) for i, v in reversed([*enumerate(node)]) if isinstance(v, dict | list)]


def _unrolled(pairs: tuple) -> list:
    out = []
    while pairs:
        pairs, x = pairs
        out.append(x)
    return out[::-1]


def leaves(documents: DataFrame, keys: Sequence[str] = ("surah", "ayat"), column: str = "value", carry: Sequence[str] = (), batch: int = 10_000) -> DataFrame:
    """carry (columns of the document), keys (int), path and ord (sort by it for document order) of the leaves of JSON texts."""
    own = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(column).cast("string").alias("value"))
    schema = T.StructType([
        *own.schema.fields[:-1], *[T.StructField(f"k{i}", T.IntegerType()) for i in range(len(keys))],
        T.StructField("path", T.ArrayType(T.StringType())), T.StructField("ord", T.ArrayType(T.IntegerType())),
    ])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[len(carry) :]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(source: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            of = [source.column(i).take(pa.array(at, pa.int64())) for i in range(len(carry))]
            found = [pa.array([r[0][i] for r in rows], kinds[i]) for i in range(len(keys))] + [pa.array([r[j] for r in rows], kinds[j - 1 + len(keys)]) for j in (1, 2)]
            return pa.RecordBatch.from_arrays([*of, *found], names=schema.names)

        for source in batches:
            at, rows = [], []
            for n in range(source.num_rows):
                for leaf in walk(source.column(len(carry))[n].as_py(), keys):
                    at.append(n)
                    rows.append(leaf)
                    if len(rows) == batch:
                        yield packed(source, at, rows)
                        at, rows = [], []
            if rows:
                yield packed(source, at, rows)

    return own.mapInArrow(work, schema).toDF(*carry, *keys, "path", "ord")


def distinct_leaves(documents: DataFrame, keys: Sequence[str] = ("surah", "ayat"), column: str = "value") -> DataFrame:
    """The distinct keys of all leaves, in order."""
    return leaves(documents, keys, column).select(*keys).distinct().orderBy(*keys)
