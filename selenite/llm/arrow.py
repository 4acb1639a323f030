"""Whole texts through Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parse

#: Rows of a batch that are turned into Python values at a time.
ROWS = 1000
#: Spark's settings of a batch: their defaults, and smaller ones, so that a worker holds a few dozen MB of text.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(ROWS)), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(32 << 20))}


def bounded_batches(spark) -> None:
    """Sets what the session left at its default; a plan reads these only when it runs. A user's own settings stay."""
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, so many at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _arrow(kinds: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kinds)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], list]], schema: str) -> DataFrame:
    """For each batch, the columns as lists go to the function that make() built once in the task; it returns lists (or Arrow arrays) in the schema's order."""
    bounded_batches(df.sparkSession)
    kinds: StructType = parse(schema)
    arrow = _arrow(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in pieces(batches):
            f = f or make()
            out = f({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(out, arrow)], schema=arrow)
            del out
        pa.default_memory_pool().release_unused()  # the worker stays, and would keep it

    return df.mapInArrow(run, kinds)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: str) -> DataFrame:
    """The same for functions that take a batch of Arrow columns and return such columns."""
    bounded_batches(df.sparkSession)
    kinds: StructType = parse(schema)
    arrow = _arrow(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in pieces(batches, ROWS // 2):
            f = f or make()
            yield pa.RecordBatch.from_arrays([x if x.type == t.type else x.cast(t.type) for x, t in zip(f(b), arrow)], schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker stays, and would keep it

    return df.mapInArrow(run, kinds)


def plain(names: list[str]) -> list[str]:
    """Names c0, c1, ... to work under, so that no column can clash with ours and none needs quoting."""
    return [f"c{i}" for i in range(len(names))]


def beside(df: DataFrame, need: list[str], make: Callable[[], Callable[[dict], list]], schema: str, without: tuple[str, ...] = ()) -> DataFrame:
    """df's own columns but for `without`, untouched, under their plain() names, and beside them those of schema, row for row.

    Only the columns that are needed become Python values; the others pass as they are, whatever their names and types.
    """
    bounded_batches(df.sparkSession)
    own, at = plain(df.columns), {n: df.columns.index(n) for n in need}
    # names within a column may hold anything, so a struct's fields are told to Spark by its own types
    kept = [i for i, n in enumerate(df.columns) if n not in without]
    kinds = StructType([StructField(own[i], df.schema[i].dataType) for i in kept] + parse(schema).fields)
    arrow = _arrow(parse(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in pieces(batches):
            f = f or make()
            new = f({n: b.column(i).to_pylist() for n, i in at.items()})
            more = [pa.array(x, t.type) for x, t in zip(new, arrow)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *more], schema=pa.schema([*(b.schema.field(i) for i in kept), *arrow]))
            del new, more
        pa.default_memory_pool().release_unused()

    return df.toDF(*own).mapInArrow(run, kinds)


def free(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until none of the taken ones is equal but for case."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name
