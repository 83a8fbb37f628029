"""Dense 1-based position of each row inside its group, skew-proof.

``row_number() over (partition by g order by o)`` puts a whole group into one
task. A catalog can hold a third of all entries, so this operator numbers in
balanced passes instead:

1. range-partition on ``(g, o)`` and sort inside partitions: a big group is
   cut into contiguous slices on many tasks (``spark.sql.shuffle.partitions``
   ranges, which AQE may merge when small); the slice is the partition id and
   the row's place in it comes from ``monotonically_increasing_id``;
2. write that once as a table in the shared checkpoint folder — slice ids
   must stay fixed (the range partitioner re-samples with a per-plan seed), and
   the write also cuts lineage, so a lost executor never renumbers rows;
3. per ``(g, slice)``: first index and row count (partial aggregation, at most
   ``slices + groups`` rows) turned into running offsets by a window that only
   sees one row per slice;
4. join the offsets back: ``ordinal = offset + index - first_index + 1``.

The result equals the single-window ``row_number`` for any total order ``o``.
``running_total`` sums a column over the earlier rows of the group in the same passes.
Group columns must be non-null.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from potable.session import run_folder

_PID = "__slice"
_IDX = "__slice_idx"
_MIN = "__slice_first"
_CNT = "__slice_n"
_OFF = "__slice_off"
_LOW_BITS = (1 << 33) - 1


def _orders(order: list[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


_SCOPES = threading.local()


@contextmanager
def scratch(spark: SparkSession, keep: bool = False) -> Iterator[None]:
    """Tables made in here by ``materialize`` are deleted at the end (``keep``: they are not).

    For steps whose result is written before they end: what they only read goes with them,
    so the disk holds the tables of one step and not those of a whole job."""
    scopes = _SCOPES.__dict__.setdefault("stack", [])
    own: list[str] | None = None if keep else []
    scopes.append(own)
    try:
        yield
    finally:
        scopes.pop()
        for path in own or []:
            delete(spark, path)


def scratch_folder(spark: SparkSession, label: str, outlives: int = 0) -> str:
    """A new folder's path; it goes with the current ``scratch``, or with one further out by ``outlives``."""
    path = run_folder(spark, f"{label}-{uuid.uuid4().hex}")
    scopes = _SCOPES.__dict__.get("stack", [])
    if outlives < len(scopes) and (own := scopes[len(scopes) - 1 - outlives]) is not None:
        own.append(path)
    return path


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in here go when it is written, not when the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, codec: str | None = None, outlives: int = 0) -> DataFrame:
    """Write ``df`` as parquet in the shared checkpoint folder and read it back.

    ``codec`` sets another compression than the session's (tables that hold all texts);
    ``outlives``: how many ``scratch`` blocks it is needed behind."""
    spark = df.sparkSession
    path = scratch_folder(spark, label, outlives)
    with short_shuffles(spark):
        df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.parquet(path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


def n_bytes(spark: SparkSession, path: str) -> int:
    """Length of all files under ``path`` (a pattern's: of all that it names)."""
    files, at = _file_system(spark, path)
    return sum(files.getContentSummary(x.getPath()).getLength() for x in files.globStatus(at) or [])


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there completely."""
    return exists(spark, path.rstrip("/") + "/_SUCCESS")


def once(spark: SparkSession, make: Callable[[], DataFrame], path: str) -> DataFrame:
    """The table at ``path``; made and written only if it isn't there from an earlier try."""
    if not finished(spark, path):
        with scratch(spark), short_shuffles(spark):
            make().write.mode("overwrite").parquet(path, compression="zstd")
    return spark.read.parquet(path)


def _sliced(df: DataFrame, groups: list[str], order: list[str | Column], num_slices: int | None) -> DataFrame:
    """The written table of ``df`` in slices, with each row's place in its slice."""
    keys = [F.col(g) for g in groups] + _orders(order)
    # Without an explicit count AQE may coalesce adjacent ranges (small inputs
    # get few slices); slice ids are read inside the single job that writes
    # the table, so they are consistent either way.
    ranged = df.repartitionByRange(num_slices, *keys) if num_slices else df.repartitionByRange(*keys)
    sliced = (
        ranged.sortWithinPartitions(*keys)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_IDX, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)))
    )
    return materialize(sliced, "ordinal", "zstd")


def _small(offsets: DataFrame) -> DataFrame:
    """Written, so that its size is known before the rows are joined with it: they are not shuffled for a small one."""
    return materialize(offsets, "offsets")


def dense_ordinal(
    df: DataFrame,
    groups: list[str],
    order: list[str | Column],
    out: str,
    num_slices: int | None = None,
) -> DataFrame:
    """Add ``out`` = position (1-based, bigint) of each row in its group under ``order``.

    ``order`` should be a total order inside a group.
    """
    m = _sliced(df, groups, order, num_slices)
    stats = m.groupBy(*groups, _PID).agg(F.min(_IDX).alias(_MIN), F.count(F.lit(1)).alias(_CNT))
    before = Window.partitionBy(*groups).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = _small(stats.select(*groups, _PID, _MIN, F.coalesce(F.sum(_CNT).over(before), F.lit(0)).alias(_OFF)))
    return (
        m.join(offsets, on=[*groups, _PID], how="inner")
        .withColumn(out, (F.col(_OFF) + F.col(_IDX) - F.col(_MIN) + 1).cast("bigint"))
        .drop(_PID, _IDX, _MIN, _OFF)
    )


def running_total(
    df: DataFrame,
    groups: list[str],
    order: list[str | Column],
    value: str,
    out: str,
    num_slices: int | None = None,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` (bigint, not null) over the rows of the group that come earlier under ``order``."""
    m = _sliced(df, groups, order, num_slices)
    inside = Window.partitionBy(*groups, _PID).orderBy(_IDX).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*groups).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    sums = m.groupBy(*groups, _PID).agg(F.sum(value).alias(_CNT))
    offsets = _small(sums.select(*groups, _PID, F.coalesce(F.sum(_CNT).over(before), F.lit(0)).alias(_OFF)))
    return (
        m.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, on=[*groups, _PID], how="inner")
        .withColumn(out, (F.col(_OFF) + F.col(out)).cast("bigint"))
        .drop(_PID, _IDX, _OFF)
    )
