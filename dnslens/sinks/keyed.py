"""Tables with one row per key, brought up to date by numbered batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.session import delete_folder, folder_exists, folder_names

COMMIT = "bucket int, version bigint, batch bigint"


class KeyedTable:
    """The newest row of each key, in files bucketed by the key's hash.

    A batch rewrites only the buckets of its keys, into a folder of its own number; then one
    small file, the commit, says for every bucket which folder holds it. Readers follow the newest commit,
    so they see all of a batch or nothing. A batch that has been committed is not merged again, and one
    that failed before its commit starts over from the commit before: repeating a batch changes nothing.
    ``buckets`` bounds the size of a commit and what a batch must rewrite; it stays as it is for the life of a table.
    Batches must be merged one after another, with rising numbers, by one writer. The columns ``kept_version``,
    ``kept_bucket`` and ``_row`` are the table's own.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: str, buckets: int = 64) -> None:
        self._spark, self._path, self._keys, self._order, self._buckets = spark, path.rstrip("/"), list(keys), order, buckets

    def _commits(self) -> DataFrame | None:
        path = f"{self._path}/commits"
        return self._spark.read.schema(COMMIT).parquet(path) if folder_exists(self._spark, path) else None

    def last_batch(self) -> int | None:
        """Number of the newest committed batch."""
        commits = self._commits()
        return None if commits is None else commits.agg(F.max("batch")).first()[0]

    def _versions(self) -> dict[int, int]:
        """Folder number of each bucket by the newest commit; at most ``buckets`` entries."""
        last = self.last_batch()
        if last is None:
            return {}
        return {row["bucket"]: row["version"] for row in self._commits().filter(F.col("batch") == last).collect()}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self._path}/data/kept_version={version}/kept_bucket={bucket}" for bucket, version in sorted(versions.items())]
        return self._spark.read.option("basePath", f"{self._path}/data").parquet(*paths).drop("kept_version", "kept_bucket")

    def merge(self, rows: DataFrame, batch: int) -> bool:
        """Bring ``rows`` in; false if the batch had been committed before. Rows with equal ``order`` have no rank among them."""
        last = self.last_batch()
        if last is not None and batch <= last:
            return False
        bucket = F.pmod(F.xxhash64(*self._keys), F.lit(self._buckets)).cast("int")
        fresh = self._newest(rows)
        versions = self._versions()
        touched = {row["bucket"] for row in fresh.select(bucket.alias("bucket")).distinct().collect()}
        held = {bucket: version for bucket, version in versions.items() if bucket in touched}
        merged = self._newest(self._read(held).unionByName(fresh, allowMissingColumns=True)) if held else fresh
        merged.withColumn("kept_bucket", bucket).repartition("kept_bucket").write.mode("overwrite").partitionBy("kept_bucket").parquet(
            f"{self._path}/data/kept_version={batch}")
        commit = {**versions, **dict.fromkeys(touched, batch)}
        rows_ = self._spark.createDataFrame(sorted(commit.items()), "bucket int, version bigint")
        rows_.coalesce(1).write.mode("overwrite").parquet(f"{self._path}/commits/batch={batch}")
        return True

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row per key; a plain aggregate, so a key's repeats are folded before the shuffle."""
        rest = [name for name in rows.columns if name not in self._keys]
        found = rows.groupBy(*self._keys).agg(F.max_by(F.struct(*rest), self._order).alias("_row"))
        return found.select(*self._keys, *[F.col(f"_row.`{name}`").alias(name) for name in rest])

    def read(self) -> DataFrame | None:
        """The rows as of the newest commit; none before the first."""
        versions = self._versions()
        return self._read(versions) if versions else None

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that the newest ``keep`` commits do not name; how many.

        Readers that started before the oldest commit kept must have ended, and no merge may be under way.
        """
        commits = self._commits()
        if commits is None:
            return 0
        numbers = [row["batch"] for row in commits.select("batch").distinct().orderBy(F.desc("batch")).collect()]
        first = numbers[:keep][-1]
        live = {row["version"] for row in commits.filter(F.col("batch") >= first).select("version").distinct().collect()}
        gone = [name for name in folder_names(self._spark, f"{self._path}/data") if name.startswith("kept_version=") and int(name.split("=")[1]) not in live]
        for number in numbers[keep:]:
            delete_folder(self._spark, f"{self._path}/commits/batch={number}")
        for name in gone:
            delete_folder(self._spark, f"{self._path}/data/{name}")
        return len(gone)
