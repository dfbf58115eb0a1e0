"""Written tables that cut lineage, in the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temp folder in local mode, else one in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        local = spark.sparkContext.master.startswith("local")
        if local and not spark.sparkContext.master.startswith("local-cluster"):
            at = tempfile.mkdtemp(prefix="tandemlake-")
        else:
            at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Parquet tables of one run; a lost executor's part is read again from there."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.held: dict[str, str | None] = {}  # path: name in the catalogue

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df, and return what reads it back."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.held[path] = None
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def bucketed(self, df: DataFrame, key: str, buckets: int, *parts: str) -> DataFrame:
        """Write df in buckets of the key, a file each, apart by `parts`: joins on the key move the other side only."""
        name = f"scratch_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        out = df.repartition(buckets, key).write
        (out.partitionBy(*parts) if parts else out).bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        self.held[path] = name
        out = self.spark.table(name)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for path in [df._scratch_path for df in tables]:
            self._delete(path)

    def clear(self, *but: DataFrame) -> None:
        """Delete all tables of this run but those given."""
        for path in set(self.held) - {df._scratch_path for df in but}:
            self._delete(path)

    def _delete(self, path: str) -> None:
        if name := self.held.pop(path, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
