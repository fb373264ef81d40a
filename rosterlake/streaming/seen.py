"""Which changes a feed has delivered already, kept by day.

A day's ids lie in one folder of the store. A batch reads the folders of the days it
delivers itself, and no others, whatever the number of days and batches before; it adds one part
to each of them, and after ``MERGE_AFTER`` parts writes the day anew as one. What a batch
wrote carries its number: a batch that is tried again sees only what earlier ones wrote and
overwrites its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import write_and_read

#: Parts a day's folder may hold before they are written as one.
MERGE_AFTER = 8


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_version(rows: DataFrame, store: str, key: str, kind: str, batch_id: int) -> None:
    """Write rows as a batch's version of the folders ``key`` names, in one job; a second try replaces the first."""
    named = rows.withColumn("version", F.lit(f"{kind}-{batch_id}"))
    writer = named.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(key, "version").parquet(store)


def versions(spark: SparkSession, folder: str, batch_id: int) -> list[tuple[int, str]]:
    """(batch, name) of what lies in a folder: the last whole version before ``batch_id`` and the parts since.

    Older ones, which no batch will ask for again, are removed.
    """
    path, files = _hadoop(spark, folder)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    known = sorted((int(n.rsplit("-", 1)[1]), n) for n in names if n.startswith("version="))
    known = [(b, name) for b, name in known if b < batch_id]
    start = max((b for b, name in known if "whole" in name), default=None)
    if start is not None:
        for b, name in known:
            if b < start:
                files.delete(_hadoop(spark, f"{folder}/{name}")[0], True)
        known = [(b, name) for b, name in known if b >= start]
    return known


def new_changes(batch: DataFrame, batch_id: int, store: str) -> DataFrame:
    """The changes of a batch that no earlier batch delivered, each once; their ids are stored.

    Changes are told apart by ``change_id`` and the day of ``changed_at``; the days of one batch, a
    handful of dates, come to the driver to name the folders. Changes without a time share a folder.
    """
    spark = batch.sparkSession
    day = F.coalesce(F.to_date("changed_at").cast("string"), F.lit("none"))
    batch = write_and_read(batch.dropDuplicates(["change_id"]).withColumn("day", day), "delivered")
    days = sorted(r["day"] for r in batch.select("day").distinct().collect())
    held = {d: versions(spark, f"{store}/day={d}", batch_id) for d in days}
    earlier = [f"{store}/day={d}/{name}" for d in days for _, name in held[d]]
    seen = None
    if earlier:
        seen = spark.read.schema("change_id long, day string, version string").option("basePath", store).parquet(*earlier)
        seen = seen.filter(F.col("day").isin(days)).select("day", "change_id")
        new = write_and_read(batch.join(seen, ["day", "change_id"], "left_anti"), "new_changes")
    else:
        new = batch
    ids = new.select("day", "change_id")
    merged = [d for d in days if len(held[d]) >= MERGE_AFTER]
    old = F.col("day").isin(merged)
    write_version(ids.filter(~old), store, "day", "part", batch_id)
    if merged:
        write_version(ids.filter(old).unionByName(seen.filter(old)), store, "day", "whole", batch_id)
    return new.drop("day")
