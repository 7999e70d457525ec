"""Files by whatever file system a path names: the cluster's own, not this machine's."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def join(*parts: str) -> str:
    return "/".join([*(x.rstrip("/") for x in parts[:-1]), parts[-1]])


def resolve(base: str, path: str) -> str:
    """`path` as it is if it is absolute or has a scheme, else below `base`."""
    return path if path.startswith("/") or "://" in path or path.startswith("file:") else join(base, path)


def parent(path: str) -> str:
    head, slash, _ = path.rstrip("/").rpartition("/")
    return head if slash else "."


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def version(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a file was last changed, and its length."""
    fs, p = _at(spark, path)
    status = fs.getFileStatus(p)
    return status.getModificationTime(), status.getLen()


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def children(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Paths of a folder's entries that match a glob pattern, in order."""
    fs, _ = _at(spark, path)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(join(path, pattern)))
    return sorted(x.getPath().toString() for x in found or [])


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written apart and renamed, so that readers see the old text or the new, never a part."""
    fs, p = _at(spark, path + ".new")
    stream = fs.create(p, True)
    try:
        stream.write(text.encode("utf-8"))
    finally:
        stream.close()
    replace(spark, path + ".new", path)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file over another one."""
    jvm = spark._jvm
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    fs, p = _at(spark, source)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(p), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(target)), over)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _at(spark, source)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} can't be moved to {target}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def make_dir(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
