"""Tables on disk that are changed by key: rows lie in buckets of the key's hash, and a write replaces the touched buckets alone."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

BUCKET = "_bucket"


class KeyedTable:
    """A Parquet table in `path`, one partition for each bucket of `key`.

    A write reads the buckets that its keys fall into, and puts them back by a dynamic partition overwrite: other buckets' files are
    neither read nor written. Buckets are swapped one after another when a write commits. A write that fails there is done again from the
    same rows and then gives the same table, so callers repeat it; two writers at a time aren't supported. The number of buckets is that
    of the first write: give the same one each time. Null keys are a key of their own.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def stored(self) -> DataFrame | None:
        """All rows with their buckets; None before the first write."""
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def read(self) -> DataFrame:
        rows = self.stored()
        if rows is None:
            raise ValueError(f"nothing has been written to {self.path}")
        return rows.drop(BUCKET)

    def _put(self, rows: DataFrame) -> None:
        rows = rows.repartition(BUCKET)
        rows.write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def replace(self, fresh: DataFrame, gone: DataFrame | None = None) -> None:
        """Puts fresh rows in place of all rows of their keys; keys of `gone` (a frame with the key column) lose their rows too."""
        fresh = written(self.bucketed(fresh), "fresh")  # it is looked at three times
        old = self.stored()
        keys = fresh.select(self.key, BUCKET)
        if gone is not None:
            keys = keys.unionByName(self.bucketed(gone.select(self.key)))
        if old is None:
            self._put(fresh)
            return
        touched = [r[0] for r in keys.select(BUCKET).distinct().collect()]  # `buckets` numbers at most
        if not touched:
            return
        old = old.where(F.col(BUCKET).isin(touched)).select(*fresh.columns)
        same = keys.select(F.col(self.key).alias("_key")).distinct()
        left = old.join(same, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
        rows = left.unionByName(fresh)
        # a bucket that loses its last row must still be written: an overwrite leaves out buckets without rows
        emptied = sorted(set(touched) - {r[0] for r in rows.select(BUCKET).distinct().collect()})
        self._put(rows)
        if emptied:
            fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
            for b in emptied:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}"), True)

    def upsert(self, batch: DataFrame, order: str, merge=None) -> None:
        """Of each key the batch's row of greatest `order`, which is not stored, in place of the stored one. merge(fresh, old) may make
        the new rows from both; old has the stored rows of the touched buckets, or is None."""
        last = Window.partitionBy(self.key).orderBy(F.desc(order), F.xxhash64(*batch.columns))
        fresh = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", order)
        if merge is not None:
            old = self.stored()
            if old is not None:
                touched = [r[0] for r in self.bucketed(fresh.select(self.key)).select(BUCKET).distinct().collect()]
                old = old.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
            fresh = merge(fresh, old)
        self.replace(fresh)
