"""Helpers shared by the training-text operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Rows of an Arrow batch: whole texts, so a batch is kept to a few MB.
ARROW_ROWS = "500"
#: Most rows, of two or three numbers each, of a side that is broadcast.
BROADCAST_ROWS = 1_000_000
#: Most bytes of arrays in the rows of a side that is broadcast.
BROADCAST_BYTES = 16 << 20
#: Most rows, of two or three numbers each, that are grouped in one task: a shuffle would cost the driver a task for each of its partitions.
ONE_TASK = 10_000

#: Bound of the keys that a join takes out of the shuffle, and the fewest rows of such a key.
HOT_KEYS, LEAST_HOT = 20_000, 1000

#: Bits of a table of hash classes for each of its members, and the largest table, 2**28 bits or 32 MB.
SPACE, MOST_BITS = 8, 28

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``.

    Only where that setting is absent in a local session, as in tests, a
    temporary folder stands in for it; on a cluster that is an error, as each
    machine would write to a disk of its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="marlinspike-")
        _roots[app] = f"{base.rstrip('/')}/marlinspike-{app}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, root)


class Scratch:
    """Tables written to the shared folder; they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, df: DataFrame, key: str) -> DataFrame:
        path = f"{shared_root(self.spark)}/{self.name}-{key}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        self.drop(key)
        self.paths[key] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keys: str) -> None:
        """Delete tables that no frame still to be computed reads."""
        for key in keys:
            if path := self.paths.pop(key, None):
                _delete(self.spark, path)


def prepare(spark: SparkSession) -> None:
    """Bound the memory of Python workers, which hold a batch of whole texts each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def broadcast_if_small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised frame of a few numbers a row for broadcast if its row count allows; otherwise it is shuffled."""
    return F.broadcast(df) if df.count() <= most_rows else df


def in_one_task(df: DataFrame, rows: int) -> DataFrame:
    """A materialised frame of so few counted rows as one partition, which needs no shuffle to be grouped or joined; a larger one as it is."""
    return df.coalesce(1) if rows <= ONE_TASK else df


def arrays_fit(df: DataFrame, arrays: str) -> bool:
    """Whether a materialised frame, ``arrays`` being the bytes of a row's arrays, is small enough to broadcast."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.expr(arrays)), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def table_bits(count: int) -> int:
    """Bits of a table for so many values: SPACE each, 2**MOST_BITS at most."""
    return min(max((SPACE * count).bit_length(), 12), MOST_BITS)


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of 2**bits classes that holds a value of the one column, a uniform hash.

    Its size is bounded whatever the corpus.  Other values may share a class:
    that adds work where the table is a first filter, never a result.
    """
    name = hashes.columns[0]
    mask = F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({name}, {64 - bits}) & 63 as int))"))
    table = hashes.groupBy(F.shiftright(F.shiftrightunsigned(F.col(name), 64 - bits), 6).alias("word")).agg(mask.alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[table["word"].to_numpy()] = table["mask"].to_numpy()
    return out


def has_bit(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - (len(table).bit_length() + 5))).astype(np.int64)
    return ((table[at >> 6] >> (at & 63)) & 1).astype(bool)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join with a side of one row a key, whose ``count`` says how many rows the left has of it.

    ``total`` is the number of rows of the left, a materialised frame.  Keys of
    more than one in HOT_KEYS rows, so fewer than HOT_KEYS keys, are broadcast
    and their rows stay where they are; the others are shuffled.
    """
    limit = max(total // HOT_KEYS, LEAST_HOT)
    hot = F.broadcast(right.where(F.col(count) > limit))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(count) <= limit), keys)
    return left.join(hot, keys).select(*rest.columns).unionByName(rest)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_column(df: DataFrame, name: str, ddl: str, compute) -> DataFrame:
    """Add a column that ``compute`` makes, as a list or Arrow array, from each Arrow batch."""
    kind = T._parse_datatype_string(ddl)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def add(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        for batch in batches:
            made = compute(batch)
            made = made if isinstance(made, (pa.Array, pa.ChunkedArray)) else pa.array(made, arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return df.mapInArrow(add, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
