"""Reading the shared tables, and writing intermediate ones where every executor can reach them."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str, **columns: str) -> DataFrame:
    """The named columns of a table, cast to the given types; any other column is left out."""
    return pick(spark.read.parquet(f"{sf_dir}/{name}.parquet"), **columns)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only these columns with these types, so that no further column of the input can clash."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo the divisor; the empty text stands for a null id."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which the driver and all executors share.

    The folder is removed when the driver's Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write the rows to the shared folder once and return a scan of them; cuts the lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    scan = df.sparkSession.read.schema(df.schema).parquet(path)
    scan._kinloom_path = path
    return scan


def discard(*scans: DataFrame) -> None:
    """Delete the files of scans that stored() returned and that nothing will read again."""
    for scan in scans:
        _delete(scan.sparkSession, scan._kinloom_path)
        _written.remove((scan.sparkSession, scan._kinloom_path))


def keyed(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns of docs with a column key, a number that tells rows apart; kept on disk.

    monotonically_increasing_id() depends on how a scan packs files into splits, which another scan of the same
    files may do in another way. So keys are written down once, and all later steps read the written ones.
    """
    return stored(pick(docs, **columns).withColumn("key", F.monotonically_increasing_id()), "keyed")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
