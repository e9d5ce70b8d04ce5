"""What the operators of this subpackage share: staging, Arrow slices, word tables and hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names as spark.checkpoint.dir.  In
    local mode, where one machine is all there is, a temporary one if none is named; on a cluster
    that is an error, for executors would not see it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    The reread table has no known partitioning, so a later join shuffles both sides and Spark
    can split a skewed partition of either.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more: all that came of them is staged itself."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def with_carried(fields: str, docs: DataFrame, carry: dict[str, str] | None) -> T.StructType:
    """A schema of fields and, after them, the columns of docs that `carry` names, as it renames them."""
    carried = [T.StructField(new, docs.schema[old].dataType) for old, new in (carry or {}).items()]
    return T.StructType([*T.StructType.fromDDL(fields).fields, *carried])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Words in a text, without Python: pieces between blanks, minus the empty ends."""
    return F.size(F.array_remove(F.split(text, BLANK), "")).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut batches, without copying, so that each holds about `most` bytes of `column`, one row at least."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        ends = offsets(batch.column(at))
        row = 0
        while row < batch.num_rows:
            to = int(np.searchsorted(ends, ends[row] + most, "right")) - 1
            to = min(max(to, row + 1), batch.num_rows)
            yield batch.slice(row, to - row)
            row = to


def offsets(strings: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    raw = np.frombuffer(strings.buffers()[1], kind)
    return raw[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)


def utf8(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, end to end, and where each row begins and ends."""
    at = offsets(strings)
    data = strings.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and the index of the first word of each row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    solid = ~_BLANK[data]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_R = np.uint64(0x9E3779B97F4A7C17)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, from one running sum (mod 2**64)."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_R, len(values)), dtype=np.uint64, out=sums[1:])
    back = _powers(_R_INVERSE, len(values) + 1)
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(_BYTE[data], starts, ends)
