"""What the operators of this subpackage share: scratch tables, checked broadcasts and joins that survive hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as listed by the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: A side of a join is broadcast up to so many bytes of its values; beyond, Spark shuffles it.
BROADCAST_BYTES = 32 << 20
#: A key is hot from this part of all rows on, so there are at most so many hot keys, whatever the data.
HOT_KEYS = 4096
#: An Arrow batch has a fixed number of rows, whatever their size; a step gets parts of about so many bytes.
STEP_BYTES = 2 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a temporary folder serves sessions whose tasks all run on this machine; others have to set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cairnflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared scratch folder and read again: cuts the lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `saved` has written and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(df.scratch)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def value_bytes(df: DataFrame) -> int:
    """Bytes of all values of `df`: the length of texts, eight for each number and each item of an array."""

    def size(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.octet_length(name)
        return F.size(name) * 8 if kind.startswith("array") else F.lit(8)

    width = reduce(lambda a, b: a + b, [F.coalesce(size(n, k), F.lit(8)) for n, k in df.dtypes])
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` (saved) with a broadcast hint if its values have `limit` bytes at most; else Spark plans the join."""
    return F.broadcast(df) if value_bytes(df) <= limit else df


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """`rows` left-joined to `table` (one row per `key`) where a few keys may hold most rows.

    A table of BROADCAST_BYTES at most is broadcast. Beyond that, `weight` counts the rows of a key and `total` counts all
    rows, so no more than HOT_KEYS keys can be hot; those are broadcast, and the rows of all other keys are shuffled. Both
    inputs should be saved tables. Keys are not null.
    """
    if value_bytes(table) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, "left")
    hot = F.broadcast(table.where(F.col(weight) * HOT_KEYS >= F.lit(total)))
    cold = table.where(F.col(weight) * HOT_KEYS < F.lit(total))
    first = rows.join(hot, key, "inner")
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key, "left")
    return first.unionByName(rest)


def parts(batches: Iterator[pa.RecordBatch], size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in parts of about `size` bytes, one row at least: what a step holds as Python objects is bounded."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow with `make()()`: called once per task, then once per part of a batch to give the output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in parts(batches):
            yield pa.RecordBatch.from_pydict(step(part), schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)
