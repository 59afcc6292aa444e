"""Helpers shared by the operators: stored tables, whole-text passes, words."""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir

#: Words of the contracts: runs of anything but the six ASCII blanks.
BLANKS = " \t\n\x0b\f\r"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps start from the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names; whatever else ``df`` holds can't clash."""
    return df.select(*[column(c).alias(k) for k, c in names.items()])


def per_row(df: DataFrame, schema: StructType | str, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """One output row for each input row, in Python over Arrow batches.

    ``make`` runs once per task and returns ``row(*input columns) -> tuple``.
    """
    return per_batch(df, schema, lambda: _rows(make()))


def _rows(row):
    return lambda *cols: map(row, *cols)


def per_batch(df: DataFrame, schema: StructType | str, make: Callable[[], Callable[..., Iterator[tuple]]], step: int = 500) -> DataFrame:
    """As :func:`per_row`, for functions that take lists of column values and yield any number of rows.

    Batches are cut to ``step`` rows, so that long texts are held in small numbers.
    ``make`` may return a pair: the second function yields rows at the task's end.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out, work = to_arrow_schema(schema), make()
        work, rest = work if isinstance(work, tuple) else (work, tuple)

        def packed(rows):
            while some := list(islice(rows, 100_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), out)], schema=out)

        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                yield from packed(iter(work(*[c.to_pylist() for c in part.columns])))
        yield from packed(iter(rest()))

    return df.mapInArrow(run, schema)


def shipped(spark: SparkSession, value):
    """A broadcast of ``value`` that brings its classes along; call the result inside a task, once, to get it."""
    from pyspark import cloudpickle

    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def per_process(name: tuple, make: Callable):
    """``make()`` once in a Python worker, kept from task to task: tokenizers and what they have encoded.

    The functions here travel with the job and have no module on the executors, so
    the objects stay in a module of their own.
    """
    kept = sys.modules.setdefault("tallywork_worker", types.ModuleType("tallywork_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII blanks; ``bytes`` methods know no other letters and blanks."""
    return text.encode().lower().split() if text else []


_EDGE = re.compile(r"\s\s|^\s|\s$")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def at_spaces(text: str) -> list[str]:
    """The parts between single spaces that stand between two non-blanks.

    The byte-level pattern never puts such a space behind other characters, so
    ``parts[0]`` and each later ``" " + part`` can be encoded by themselves.
    """
    return _CUT.split(text) if _EDGE.search(text) else text.split(" ")


def with_text(df: DataFrame, text_col: str, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``df`` with each text that isn't null put through a function; every other column passes as it is."""
    at = df.columns.index(text_col)

    def run(batches):
        change = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [None if t is None else change(t) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
