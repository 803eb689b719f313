"""Ranks and exact quantiles of groups that no single task could hold.

Approximate quantiles of a group (a sketch of bounded size) cut its values into buckets; values that equal a cut, which
may be many, have a bucket of their own, cut again by a second column. Buckets are counted, counts are summed up in order, and a
row's rank is what lies before its bucket and its rank within. The cuts decide only how even the buckets are: ranks
and quantiles are exact. Rows are read from a written copy, so that all passes see the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Groups whose cuts are broadcast; with more groups, the cuts are joined by sort and merge.
FEW_GROUPS = 10_000


def _few(df: DataFrame) -> DataFrame:
    return df.hint("broadcast" if df.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else "merge")


def _cuts(df: DataFrame, by: Sequence[str], values: dict[str, str], buckets: int) -> DataFrame:
    """Distinct approximate quantiles of each of ``values`` (result name to column) by group."""
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    aggs = [F.array_sort(F.array_distinct(F.percentile_approx(c, shares, F.lit(20 * buckets)))).alias(out) for out, c in values.items()]
    return cut(df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs))


def _bucketed(df: DataFrame, cuts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``_b``: twice the cuts under a value, and one more if it equals a cut; a missing value has one under 0."""
    joined = df.join(_few(cuts), list(by)) if by else df.crossJoin(F.broadcast(cuts))
    below = F.size(F.filter("_cuts", lambda e: e < F.col(value)))
    return joined.withColumn("_b", F.when(F.col(value).isNotNull(), 2 * below + F.array_contains("_cuts", F.col(value)).cast("int")))


def with_ranks(df: DataFrame, by: Sequence[str], value: str, tie: str, descending: bool = False, buckets: int = 64) -> DataFrame:
    """Every row with its place among the rows of its group that have a value, in order of a numeric ``value``.

    Adds ``_n`` (such rows of the group), ``_rank`` (ties share the better one), ``_ties`` (rows with the value), ``_position`` (ties by
    ascending ``tie``, a number). Rows without a value have nothing in all four. No task holds more than a bucket, unless
    rows are equal in both columns.
    """
    order = -F.col(value) if descending else F.col(value)
    rows = cut(df.withColumn("_v", order.cast("double")))
    at = [*by, "_b", "_s"]
    keyed = _bucketed(rows, _cuts(rows, by, {"_cuts": "_v", "_tie_cuts": tie}, buckets), by, "_v")
    equal = F.col("_b") % 2 == 1
    keyed = keyed.withColumn("_s", F.when(equal, F.size(F.filter("_tie_cuts", lambda e: e < F.col(tie)))).otherwise(0)).drop("_cuts", "_tie_cuts")
    # Rows without a value are spread over buckets that no count has.
    spread = -1 - F.pmod(F.xxhash64(tie), F.lit(buckets)).cast("int")
    keyed = keyed.withColumn("_b", F.coalesce("_b", spread))
    counts = keyed.where("_v is not null").groupBy(*at).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    bucket = Window.partitionBy(*by, "_b")
    starts = counts.withColumns({"_before": F.coalesce(F.sum("_c").over(earlier), F.lit(0)), "_n": F.sum("_c").over(group)})
    starts = starts.withColumns({"_start": F.min("_before").over(bucket), "_of_bucket": F.sum("_c").over(bucket)}).drop("_c")
    placed = keyed.join(cut(starts).hint("merge"), at, "left")
    own = Window.partitionBy(*at)
    placed = placed.withColumns(
        {
            "_position": F.col("_before") + F.row_number().over(own.orderBy("_v", tie)),
            "_rank": F.col("_start") + F.when(equal, F.lit(1)).otherwise(F.rank().over(own.orderBy("_v"))),
            "_ties": F.when(F.col("_n").isNotNull(), F.when(equal, F.col("_of_bucket")).otherwise(F.count("*").over(Window.partitionBy(*at, "_v")))),
        }
    )
    return placed.select(*df.columns, "_n", "_rank", "_ties", "_position")


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), out: str = "quantiles", buckets: int = 256) -> DataFrame:
    """Exact quantiles with linear interpolation by group, as an array; missing values don't count, a group of these alone has NULL.

    Only the rows of the buckets in which a wanted position falls are sorted: about 1 / ``buckets`` of them for each share.
    """
    rows = cut(df.select(*by, F.col(value).cast("double").alias("_v")))
    cuts = _cuts(rows, by, {"_cuts": "_v"}, buckets)
    keyed = _bucketed(rows.where("_v is not null"), cuts, by, "_v")
    group = Window.partitionBy(*by)
    counts = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_c"), F.first("_v").alias("_same"))
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_c").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_c").over(group)})
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(float(s)) * (F.col("_n") - 1)), F.ceil(F.lit(float(s)) * (F.col("_n") - 1))) for s in shares])))
    wanted = F.filter(places, lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_c")))
    counts = cut(counts.withColumn("_k", wanted).where(F.size("_k") > 0))
    # All values of an odd bucket are one; the others' rows are sorted.
    same = counts.where("_b % 2 = 1").select(*by, "_n", F.explode("_k").alias("_k"), F.col("_same").alias("_v"))
    others = counts.where("_b % 2 = 0").select(*by, "_b", "_n", "_before", "_k")
    near = keyed.select(*by, "_b", "_v").join(_few(others), [*by, "_b"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_v")) - 1
    found = near.withColumn("_at", place).where(F.array_contains("_k", F.col("_at"))).select(*by, "_n", F.col("_at").alias("_k"), "_v")
    both = same.unionByName(found)
    aggs = [F.max("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m")]
    held = both.groupBy(*by).agg(*aggs) if by else both.agg(*aggs)
    picked = []
    for s in shares:
        place = F.lit(float(s)) * (F.col("_n") - 1)
        low, high = F.try_element_at("_m", F.floor(place)), F.try_element_at("_m", F.ceil(place))
        picked.append(F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place))))
    told = held.select(*by, F.when(F.col("_n").isNotNull(), F.array(*picked)).alias(out))
    if not by:
        return told
    return cuts.select(*by).join(told, list(by), "left")
