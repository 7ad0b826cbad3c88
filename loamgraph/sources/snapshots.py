"""Snapshots of a table set, the audit log, and the manifest of applied steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(tables: dict[str, DataFrame], root: str, name: str) -> None:
    """Write each table under root/name; an existing snapshot is not overwritten."""
    for table, df in sorted(tables.items()):
        df.write.mode("errorifexists").parquet(f"{root}/{name}/{table}")


def load(spark: SparkSession, root: str, name: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/{table}")


def names(spark: SparkSession, root: str) -> list[str]:
    """Snapshots under root, in order of name; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def delete(spark: SparkSession, root: str, name: str) -> bool:
    """Remove one snapshot; names with path parts are refused."""
    if not name or "/" in name or name in (".", ".."):
        raise ValueError(f"no snapshot name: {name!r}")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def manifest(steps: DataFrame) -> DataFrame:
    """(name, checksum): steps (name, body) in order of name with the md5 of their body, as applied steps are recorded."""
    return steps.select("name", F.md5("body").alias("checksum")).orderBy("name")


def pending(steps: DataFrame, applied: DataFrame) -> DataFrame:
    """(name, state) of steps to apply: new ones, and changed ones whose checksum differs from the recorded one."""
    m, a = manifest(steps), applied.select(F.col("name").alias("n"), F.col("checksum").alias("c"))
    state = F.when(F.col("c").isNull(), "new").when(F.col("c") != F.col("checksum"), "changed")
    return m.join(a, F.col("name") == F.col("n"), "left").select("name", state.alias("state")).where("state is not null")


def health(spark: SparkSession, tables: list[str]) -> DataFrame:
    """(table, readable) for Parquet paths: whether their schema can be read."""
    out = []
    for t in tables:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(t)
            there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
            out.append((t, bool(there and spark.read.parquet(t).columns)))
        except Exception:  # noqa: BLE001 - any failure means the table cannot be read
            out.append((t, False))
    return spark.createDataFrame(out, "table string, readable boolean")
