"""Incremental refresh: newly landed events re-aggregate the sessions they touch, and what is derived from these entities.

A table is kept in a fixed number of buckets by entity. A batch merges into the buckets it touches: each gets a new version,
``b=<bucket>/v=<batch>``, with the rows of the version before it and the batch's in place of those with the same keys. Readers take the
newest version of every bucket; versions older than the one before it are deleted, so the folder holds two versions at most. A batch that runs
again after a failure starts from versions older than its own and replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 16


def landed(spark: SparkSession, path: str, schema, files: int = 8) -> DataFrame:
    """A stream over the Parquet files of a folder or of one file, ``files`` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def session_totals(events: DataFrame, entity: str, ts: str, session: str, measures: dict[str, Column], late: str = "2 days") -> DataFrame:
    """Totals of tumbling sessions by entity; events later than the watermark are left out."""
    timed = events.withWatermark(ts, late)
    return timed.groupBy(F.window(ts, session), F.col(entity)).agg(*[c.alias(n) for n, c in measures.items()])


def versions(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """The versions of each bucket that has any, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    if store.exists(path):
        for found in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/b=*/v=*")):
            bucket, version = found.getPath().getParent().getName(), found.getPath().getName()
            out.setdefault(int(bucket[2:]), []).append(int(version[2:]))
    return {b: sorted(v) for b, v in out.items()}


def _delete(spark: SparkSession, table: str, which: Sequence[tuple[int, int]]) -> None:
    for b, v in which:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/b={b}/v={v}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _read(spark: SparkSession, table: str, which: Sequence[tuple[int, int]]) -> DataFrame | None:
    paths = [f"{table}/b={b}/v={v}" for b, v in which]
    return spark.read.option("basePath", table).parquet(*paths) if paths else None


def _bucket(entity: str) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(BUCKETS)).cast("int")


def upsert(rows: DataFrame, table: str, keys: Sequence[str], entity: str, number: int) -> list[int]:
    """Merge ``rows`` into the buckets of their entities as version ``number``; the buckets that were touched.

    Of rows with one key those of ``rows`` count, which have each key once. Other buckets are neither read nor written.
    """
    spark = rows.sparkSession
    dealt = rows.withColumns({"b": _bucket(entity), "_new": F.lit(1)})
    touched = sorted(r["b"] for r in dealt.select("b").distinct().collect())
    have = versions(spark, table)
    _delete(spark, table, [(b, v) for b in touched for v in have.get(b, []) if v >= number])
    old = _read(spark, table, [(b, max(v for v in have[b] if v < number)) for b in touched if any(v < number for v in have.get(b, []))])
    if old is not None:
        dealt = dealt.unionByName(old.drop("v").withColumn("_new", F.lit(0)))
    newest = F.row_number().over(Window.partitionBy("b", *keys).orderBy(F.desc("_new")))
    kept = dealt.withColumn("_row", newest).where("_row = 1").drop("_row", "_new").withColumn("v", F.lit(number))
    kept.repartition("b").write.mode("append").partitionBy("b", "v").parquet(table)
    _delete(spark, table, [(b, v) for b in touched for v in sorted(x for x in have.get(b, []) if x < number)[:-1]])
    return touched


def current(spark: SparkSession, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The rows of the newest version of every bucket, or of some."""
    rows = _read(spark, table, [(b, v[-1]) for b, v in sorted(versions(spark, table).items()) if buckets is None or b in buckets])
    if rows is None:
        raise FileNotFoundError(f"{table} has no version of any bucket")
    return rows.drop("b", "v")


def refresh(stream: DataFrame, table: str, keys: Sequence[str], checkpoint: str, entity: str, derive: Callable[[DataFrame], DataFrame] | None = None, derived: str | None = None) -> None:
    """Run what has landed to its end, upsert changed sessions into ``table`` and what follows for their entities into ``derived``.

    Update mode gives each session's newest totals. ``derive`` takes all rows of the entities that a batch changed and gives one
    row an entity; nobody else's rows are derived again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            spark = batch.sparkSession
            touched = upsert(batch, table, keys, entity, number)
            if derive is not None and touched:
                changed = batch.select(entity).distinct()
                rows = current(spark, table, touched).join(changed, entity, "left_semi")
                upsert(derive(rows), derived, [entity], entity, number)
        finally:
            batch.unpersist()

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()
