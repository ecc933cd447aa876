"""What the operators share: ASCII lower case, Arrow-batched row functions, shared folders and binary files in them."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import scratch_dir

#: Fixed value: bytes of words in lower case; all others become spaces. Bytes over 0x7F belong to words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Fixed value: A-Z to a-z and nothing else.
LOWER = {c: c + 32 for c in range(65, 91)}


def map_batches(df: DataFrame, make: Callable[[], Callable[[list[dict]], list[tuple]]], schema: T.StructType, mb: float = 2) -> DataFrame:
    """df through a function from some rows (about mb MB, dicts) to output tuples. make() runs once a task and may hold caches."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            names, step = batch.schema.names, max(1, int(batch.num_rows * mb * 1e6 // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = f([dict(zip(names, r, strict=True)) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], Iterator[tuple]]], schema: T.StructType) -> DataFrame:
    """map_batches row by row."""

    def some() -> Callable[[list[dict]], list[tuple]]:
        f = make()
        return lambda rows: [o for r in rows for o in f(r)]

    return map_batches(df, some, schema)


def struct(text: str) -> T.StructType:
    """Flat "name type, ..." of string, long, int, double, boolean and binary."""
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "longs": T.ArrayType(T.LongType()), "ints": T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(n, kinds[t]) for n, t in (c.split() for c in text.split(", "))])


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the folder that all executors share."""
    return f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"


_MADE = threading.local()


def note(path: str) -> str:
    """path, which the operator at work deletes when it has its result."""
    if scopes := getattr(_MADE, "scopes", []):
        scopes[-1].append(path)
    return path


def files_of(df: DataFrame, rows: int, per: int = 20_000) -> DataFrame:
    """df, which has so many rows at most, in a partition for each per of them and not in one for each of its last shuffle: many small files
    cost more than they hold."""
    return df.coalesce(max(1, -(-rows // per)))


def store(df: DataFrame, kind: str, rows: int | None = None, per: int = 20_000) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, and lost executors cost nothing. rows: how many it has
    at most, if that is known, for files_of()."""
    path = note(fresh_dir(df.sparkSession, kind))
    (df if rows is None else files_of(df, rows, per)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables and files that were made in it."""
    outer = getattr(_MADE, "scopes", [])
    _MADE.scopes = [*outer, made := []]
    try:
        yield
    finally:
        _MADE.scopes = outer
        for path in made:
            delete(spark, path)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on a DataFrame whose result is stored, after which all else that it made is deleted."""

    @wraps(operator)
    def run(df: DataFrame, *args: object, **kwargs: object) -> DataFrame:
        spark = df.sparkSession
        path = note(fresh_dir(spark, operator.__name__))
        with scope(spark):
            out = operator(df, *args, **kwargs)
            out.write.parquet(path)
            return spark.read.schema(out.schema).parquet(path)

    return run


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df, which has so many rows, each a task's work, by ranges of by: in as many tasks as the session has partitions or the rows allow.
    The number is told, so adaptive execution, which only sees the rows' few bytes, leaves it."""
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return df.repartitionByRange(max(1, min(rows, max(int(conf), df.sparkSession.sparkContext.defaultParallelism))), *by)


def file_system(uri: str):  # noqa: ANN201
    """pyarrow's file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def renamed(df: DataFrame, taken: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns named as those of taken out of the way, in any case of letters, and what names them back and drops all others."""
    low = {c.lower() for c in taken}
    names = [f"column {i} of df" if c.lower() in low else c for i, c in enumerate(df.columns)]
    return df.toDF(*names), lambda out: out.select(*(out[f"`{n}`"].alias(c) for n, c in zip(names, df.columns, strict=True)))
