"""Filesystem helpers on the Hadoop FileSystem of a path, so they work the
same on local disk, HDFS and object stores."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    fs.delete(p, True)


def delete_if_empty(spark: SparkSession, path: str) -> None:
    """Remove a folder that holds nothing (a folder that was filled meanwhile stays)."""
    fs, p = _fs_path(spark, path)
    if fs.exists(p) and not len(fs.listStatus(p)):
        try:
            fs.delete(p, False)
        except Exception:  # filled between the two calls
            if not fs.exists(p):
                raise


def size_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs_path(spark, path)
    return int(fs.getContentSummary(p).getLength())


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Partition column names of a table folder, outermost first, read from
    its ``key=value`` directory levels."""
    fs, p = _fs_path(spark, path)
    cols = []
    while True:
        dirs = [st.getPath() for st in fs.listStatus(p)
                if st.isDirectory() and "=" in st.getPath().getName()
                and not st.getPath().getName().startswith(("_", "."))]
        if not dirs:
            return cols
        cols.append(dirs[0].getName().split("=", 1)[0])
        p = dirs[0]


def child_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path`` (hidden ones left out)."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def swap(spark: SparkSession, new: str, target: str) -> None:
    """Put the finished folder ``new`` in the place of ``target``.

    The old folder is renamed aside (hidden from readers) before the new one
    moves in, and deleted last; ``recover`` puts it back after a crash between."""
    fs, t = _fs_path(spark, target)
    _, n = _fs_path(spark, new)
    old = t.getParent().suffix(f"/_old_{t.getName()}")
    fs.mkdirs(t.getParent())
    if fs.exists(t):
        fs.delete(old, True)
        if not fs.rename(t, old):
            raise OSError(f"cannot move {target} aside")
    if not fs.rename(n, t):
        raise OSError(f"cannot move {new} to {target}")
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> None:
    """Undo swaps under ``path`` that a crash left half done."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("_old_"):
            target = p.suffix("/" + name[len("_old_"):])
            if fs.exists(target):
                fs.delete(st.getPath(), True)
            else:
                fs.rename(st.getPath(), target)
