"""Tables kept in hash buckets, replaced bucket by bucket behind a manifest.

Below the store's folder, ``manifest/commit=N`` holds one row a bucket: the version in which its current rows were
written. A change reads the buckets it touches, writes their new state to folders of its own version, and writes the
manifest last; readers follow the newest manifest, so a call that fails leaves the state before it, and its repetition
writes over what it left. Untouched buckets are neither read nor written.

One writer at a time. Old versions stay for readers that hold them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.runtime import path_exists

_MANIFEST = "bucket int, version int, commit int"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class BucketStore:
    """A folder of bucketed tables; ``buckets`` is fixed when it is first written."""

    spark: SparkSession
    path: str
    buckets: int = 16

    def state(self) -> tuple[int, dict[int, int]]:
        """The newest commit (0 for none) and the version of each bucket."""
        if not path_exists(self.spark, f"{self.path}/manifest"):
            return 0, {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect()  # one row a bucket and commit
        newest = max((r["commit"] for r in rows), default=0)
        return newest, {r["bucket"]: r["version"] for r in rows if r["commit"] == newest}

    def current(self, folder: str, schema: str, partition: str, versions: dict[int, int]) -> DataFrame:
        """Rows of the buckets' current versions; the partition filters keep all other folders unread."""
        if not versions:
            return self.spark.createDataFrame([], f"{schema}, {partition}")
        rows = self.spark.read.schema(f"{schema}, {partition}, version int").parquet(f"{self.path}/{folder}")
        live = F.lit(False)
        for version in sorted(set(versions.values())):
            own = [b for b, v in versions.items() if v == version]
            live = live | ((F.col("version") == version) & F.col("bucket").isin(own))
        return rows.filter(F.col("version").isin(sorted(set(versions.values()))) & live).drop("version")

    def write(self, rows: DataFrame, folder: str, version: int) -> None:
        """New state of the touched buckets; ``rows`` have ``bucket``."""
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}/version={version}")

    def publish(self, commit: int, versions: dict[int, int]) -> None:
        """Make a commit the newest; a commit that is not published does not exist for readers."""
        manifest = self.spark.createDataFrame(sorted(versions.items()), "bucket int, version int").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/commit={commit}")

