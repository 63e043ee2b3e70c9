"""Tables that grow by whole micro-batches, and their compaction beside a running
stream (SNK-5, SNK-6, STR-10, AGG-11).

    base/_commits/<b>                           batch b is complete
    base/<table>/[<part>=../]batch_id=<b>/      rows of batch b; a replay rewrites them
    base/<table>/_compacted/<c>/[<part>=../]    rows in place of all batches up to c
    base/<table>/_compactions/<c>               ... once this marker is there

Readers take the compacted rows of the last marker and the committed batches after it, so
a compaction shows at once, when its marker does, and the stream goes on writing batch
folders of one layout meanwhile.  What a compaction replaces is removed by the next one: a
reader that began before the marker still finds its files.  A compaction that fails leaves
folders without a marker, which nobody reads and the next one removes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickwise.sources import fs

Frames = Callable[[DataFrame], DataFrame]


def committed_batch(spark: SparkSession, base: str) -> int | None:
    """The last batch whose tables are complete."""
    return max((int(n) for n in fs.child_dirs(spark, f"{base.rstrip('/')}/_commits")), default=None)


def commit(spark: SparkSession, base: str, batch_id: int) -> None:
    commits = f"{base.rstrip('/')}/_commits"
    fs.mkdirs(spark, f"{commits}/{batch_id}")
    for n in fs.child_dirs(spark, commits):
        if int(n) < batch_id:
            fs.delete(spark, f"{commits}/{n}")


def is_batch_table(spark: SparkSession, base: str) -> bool:
    return fs.exists(spark, f"{base.rstrip('/')}/_commits")


def _compactions(spark: SparkSession, table: str) -> list[int]:
    return sorted(int(n) for n in fs.child_dirs(spark, f"{table}/_compactions"))


def compacted_folder(spark: SparkSession, table: str) -> str | None:
    """The folder of the compacted rows in force."""
    done = _compactions(spark, table)
    return f"{table}/_compacted/{done[-1]}" if done else None


def read_batches(spark: SparkSession, base: str, name: str, upto: int | None = None, where=None,
                 only: list[int] | None = None) -> DataFrame | None:
    """Rows of the table's batches up to ``upto`` (default: the last committed one), the compacted
    ones with the batch their compaction reached; ``where`` is applied to both parts' scans, and
    ``only`` names the batches that matter (of a table without further partitions).  None if
    there is nothing yet."""
    table = f"{base.rstrip('/')}/{name}"
    last = committed_batch(spark, base) if upto is None else upto
    if last is None:
        return None
    done = [c for c in _compactions(spark, table) if c <= last]
    parts = []
    if done and fs.size_bytes(spark, f"{table}/_compacted/{done[-1]}"):  # no file: no row was left
        parts.append(spark.read.parquet(f"{table}/_compacted/{done[-1]}").withColumn("batch_id", F.lit(done[-1]).cast("long")))
    after = done[-1] if done else -1
    folders = [table] if only is None else [f"{table}/batch_id={b}" for b in only if after < b <= last]
    if folders and fs.child_dirs(spark, table):
        live = spark.read.option("basePath", table).parquet(*folders).withColumn("batch_id", F.col("batch_id").cast("long"))
        parts.append(live.filter((F.col("batch_id") <= last) & (F.col("batch_id") > after)))
    if not parts:
        return None
    if where is not None:
        parts = [p.filter(where) for p in parts]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def _remove(spark: SparkSession, table: str, upto: int, keep: int) -> None:
    """Remove the batch folders up to ``upto`` and every compaction but ``keep`` and the one before."""
    def batches_in(folder):
        for d in fs.child_dirs(spark, folder):
            if d.startswith("batch_id=") and int(d.split("=")[1]) <= upto:
                fs.delete(spark, f"{folder}/{d}")
    batches_in(table)
    for part in fs.child_dirs(spark, table):
        if not part.startswith("batch_id="):
            batches_in(f"{table}/{part}")
            fs.delete_if_empty(spark, f"{table}/{part}")
    for kind in ("_compactions", "_compacted"):  # the marker first
        for n in fs.child_dirs(spark, f"{table}/{kind}"):
            if int(n) not in (upto, keep) and int(n) < keep:
                fs.delete(spark, f"{table}/{kind}/{n}")


def compact(spark: SparkSession, base: str, name: str, resolve: Frames, write: Callable[[DataFrame, str], None]) -> int | None:
    """AGG-11 on one table: ``resolve`` turns the rows of all committed batches into the rows that
    stay, ``write`` writes them (without ``batch_id``) to a folder.  Returns the batch reached."""
    table, last = f"{base.rstrip('/')}/{name}", committed_batch(spark, base)
    before = max(_compactions(spark, table), default=-1)
    if last is None or last == before:
        return None
    rows = read_batches(spark, base, name, last)
    if rows is None:
        return None
    fs.delete(spark, f"{table}/_compacted/{last}")  # left by a failed attempt
    write(resolve(rows).drop("batch_id"), f"{table}/_compacted/{last}")
    fs.mkdirs(spark, f"{table}/_compactions/{last}")
    _remove(spark, table, before, last)
    return last
