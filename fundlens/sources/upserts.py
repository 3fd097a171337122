"""Tables with one row per key, where a batch rewrites only the buckets its keys fall into."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import delete, discard, folder_names, materialize, read_text, write_text

#: Buckets of a table; fixed when it is first written.
BUCKETS = 64


class UpsertTable:
    """The row that ``newest`` picks per key, over all batches so far.

    Keys are dealt to buckets by a hash.  A batch reads and rewrites the buckets of its own
    keys and leaves all others alone: it writes ``bucket=.../version=<number>`` by dynamic
    partition overwrite, and then one small manifest that names the version of every bucket.
    Readers follow the newest manifest, so they never see half a batch.  A batch given again
    under its number starts from the manifest before it and overwrites its own version.  What
    the last two manifests do not name is deleted.
    """

    def __init__(
        self, spark: SparkSession, key: str, newest: Callable[[DataFrame], DataFrame], path: str, buckets: int = BUCKETS
    ) -> None:
        self.spark, self.key, self.newest, self.path, self.buckets = spark, key, newest, path, buckets

    def _manifest(self, version: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/manifest/{version}"))

    def versions(self) -> list[int]:
        """Batches whose manifest is there; the last one is current."""
        names = folder_names(self.spark, f"{self.path}/manifest")
        return sorted(int(n) for n in names if n.isdigit())

    def _folder(self, bucket: int | str, version: int) -> str:
        return f"{self.path}/bucket={bucket}/version={version}"

    def _read(self, manifest: dict, buckets: Iterable[int | str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [self._folder(b, manifest["versions"][str(b)]) for b in buckets if str(b) in manifest["versions"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def upsert(self, batch: DataFrame, number: int) -> None:
        before = [v for v in self.versions() if v < number]
        manifest = self._manifest(before[-1]) if before else {"buckets": self.buckets, "schema": batch.schema.jsonValue(), "versions": {}}
        # A hot key leaves one row per task before anything is shuffled.
        newest = materialize(self.newest(batch), "upsert-batch")
        bucket = F.pmod(F.hash(self.key), F.lit(manifest["buckets"])).alias("bucket")
        touched = sorted(r.bucket for r in newest.select(bucket).distinct().collect())
        if touched:
            both = self._read(manifest, touched).unionByName(newest).select("*", bucket, F.lit(number).alias("version"))
            # A bucket is one task and one file.
            merged = self.newest(both).repartition("bucket")
            writer = merged.write.partitionBy("bucket", "version").mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)
        discard(newest)
        versions = manifest["versions"] | {str(b): number for b in touched}
        write_text(self.spark, f"{self.path}/manifest/{number}", json.dumps(manifest | {"versions": versions}))
        self._forget([*before, number])

    def _forget(self, versions: list[int]) -> None:
        for old, following in zip(versions[:-2], versions[1:-1]):
            kept = self._manifest(following)["versions"]
            for bucket, version in self._manifest(old)["versions"].items():
                if kept[bucket] != version:
                    delete(self.spark, self._folder(bucket, version))
            delete(self.spark, f"{self.path}/manifest/{old}")

    def table(self) -> DataFrame:
        versions = self.versions()
        if not versions:
            raise ValueError("no batch has been processed")
        manifest = self._manifest(versions[-1])
        return self._read(manifest, manifest["versions"])
