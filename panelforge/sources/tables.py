"""Reading and writing of events, panels, logs and models."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = (
    "run_ts timestamp, phase string, type string, label string, tag string, feats array<string>, n long, n_transitions int, "
    "r double, k_bias_hi double, k_bias_lo double, rmse double, score double"
)


def own_folder(spark: SparkSession) -> str:
    """A new folder among those that the driver and all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to a shared folder and read again: computed once, with a known size, and safe against lost executors."""
    path, schema = own_folder(df.sparkSession), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything, on whatever store Spark reads it from."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; those that are absent as typed NULLs, NaN as NULL."""
    out = []
    for f in schema.fields:
        c = F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name in df.columns:
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def scan_events(spark: SparkSession, path: str, seasons: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """An event dataset partitioned by season: seasons prune folders, columns prune the scan."""
    df = spark.read.parquet(path)
    if seasons is not None:
        df = df.where(F.col("season").isin(*seasons))
    return df.select(*columns) if columns else df


def scan_seasons(spark: SparkSession, path: str, wanted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Events of the seasons that ``wanted`` (a row a season) holds; the scan prunes folders by what it finds there at run time."""
    # Spark prunes at run time only by a side that a comparison filters; a boolean column alone is none to it.
    seasons = wanted.select("season").distinct().where(F.col("season") > F.lit(-(2**31)))
    return scan_events(spark, path, columns=columns).join(F.broadcast(seasons), "season")


def read_csv(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """The first CSV that exists, with its header, under an explicit schema."""
    path = first_existing(spark, paths)
    if path is None:
        raise FileNotFoundError(", ".join(paths))
    return spark.read.csv(path, header=True, schema=schema)


def union_seasons(spark: SparkSession, paths: Mapping[int, str]) -> DataFrame | None:
    """Files of single seasons as one frame with ``season``; absent ones are passed over."""
    out = None
    for season, path in sorted(paths.items()):
        if exists(spark, path):
            part = spark.read.parquet(path).withColumn("season", F.lit(season))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def join_optional(df: DataFrame, path: str, on: Sequence[str], schema: T.StructType) -> DataFrame:
    """A side table joined where it is there, else its columns as typed NULLs."""
    if exists(df.sparkSession, path):
        side = with_schema(df.sparkSession.read.parquet(path), schema)
        return df.join(side, list(on), "left")
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in on})


def cached_panel(spark: SparkSession, path: str, seasons: Sequence[int], build) -> DataFrame:
    """A panel kept by season: only seasons that the table lacks are built, and they alone are written."""
    missing = list(seasons)
    if exists(spark, path):
        have = {r["season"] for r in spark.read.parquet(path).select("season").distinct().collect()}
        missing = [s for s in seasons if s not in have]
    if missing:
        build(missing).write.mode("append").partitionBy("season").parquet(path)
    return spark.read.parquet(path).where(F.col("season").isin(*seasons))


def write_seasons(df: DataFrame, path: str) -> None:
    """Overwrite the seasons that ``df`` has and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add evaluation records under the fixed schema."""
    with_schema(df, T.StructType.fromDDL(LOG_SCHEMA)).write.mode("append").parquet(path)


def stats_from_json(df: DataFrame, payload: str, fields: Mapping[str, str]) -> DataFrame:
    """Rows of the ``data`` array of JSON payloads, with fields renamed and cast; absent ones are NULL."""
    inner = ", ".join(f"`{old}`: STRING" for old in fields)
    parsed = F.from_json(payload, f"STRUCT<data: ARRAY<STRUCT<{inner}>>>")
    rows = df.select(F.explode(parsed["data"]).alias("row"))
    return rows.select(*[F.col("row")[old].alias(new) for old, new in fields.items()])


def as_json_records(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))


def save_model(spark: SparkSession, path: str, fit, metrics: Mapping[str, float]) -> None:
    """A linear model as two tables: coefficients and metadata."""
    rows = [(f, float(c), float(s)) for f, c, s in zip(fit.features, fit.coefficients, fit.standardized)]
    spark.createDataFrame(rows, "feature string, coefficient double, standardized double").write.mode("overwrite").parquet(f"{path}/coefficients")
    meta = [("intercept", fit.intercept), ("alpha", fit.alpha), *((k, float(v)) for k, v in metrics.items())]
    spark.createDataFrame(meta, "name string, value double").write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str):
    from ..operators.linear import Fit
    import numpy as np

    rows = spark.read.parquet(f"{path}/coefficients").orderBy("feature").collect()
    meta = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/metadata").collect()}
    return Fit([r["feature"] for r in rows], np.array([r["coefficient"] for r in rows]), meta["intercept"], meta["alpha"], np.array([r["standardized"] for r in rows]))
