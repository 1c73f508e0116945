"""Stored usage: one small table a day of what each service sent, which adds up over days and is compared between periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.scalars import ID_CLASSES, classify_value
from tracelake.operators.usage import KEY_HINTS, KEYS, counted

DAY_MS = 86_400_000
LG_SIZE = 12  # of sketches: 4 KB each at most, counts within 1.6 %

_ROW = [*KEYS, "class"]


def usage_days(records: DataFrame, points: DataFrame) -> DataFrame:
    """(day, KEYS, class, n, bytes, first_ms, last_ms, sketch): a day's records by attribute and class of value.

    Rows without a key hold the records themselves; those of metrics have a sketch of their series, those of attributes one of their
    values. Values are counted by day before they are classified, so each distinct value is looked at once a day.
    """
    day = F.floor(F.col("time_ms") / DAY_MS).cast("bigint")
    counts = counted(records.withColumn("day", day), "day")
    kind = F.when(F.col("key").isNotNull(), classify_value(F.col("value")))
    sums = [F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms")]
    rows = counts.withColumn("class", kind).groupBy("day", *_ROW).agg(*sums, F.hll_sketch_agg("value", F.lit(LG_SIZE)).alias("sketch"))
    series = F.to_json(F.struct("instance_id", F.array_sort(F.map_entries("attrs")).alias("labels")))
    drawn = points.groupBy(day.alias("day"), "service", "metric").agg(F.hll_sketch_agg(series, F.lit(LG_SIZE)).alias("series"))
    rows = rows.withColumn("_own", F.when(F.col("key").isNull(), F.col("metric"))).alias("r").join(drawn.alias("s"), F.col("r.day").eqNullSafe(F.col("s.day")) & (F.col("r.service") == F.col("s.service")) & (F.col("r._own") == F.col("s.metric")), "left")
    return rows.select(*(F.col(f"r.{c}") for c in ("day", *_ROW, "n", "bytes", "first_ms", "last_ms")), F.coalesce("s.series", "r.sketch").alias("sketch"))


def save_usage(days: DataFrame, path: str) -> None:
    """Write days, each replacing what the table has of that day."""
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def load_usage(spark: SparkSession, path: str, first_day: int, last_day: int) -> DataFrame:
    """Days of the table from first_day to last_day; others are not read."""
    return spark.read.parquet(path).where(F.col("day").between(first_day, last_day))


def added(days: DataFrame) -> DataFrame:
    """One row for each attribute and class over all days: counts add up, sketches are united."""
    sums = [F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms")]
    return days.groupBy(*_ROW).agg(*sums, F.hll_union_agg("sketch").alias("sketch"))


def attribute_summary(days: DataFrame, dominant: float = 0.8) -> DataFrame:
    """(KEYS, n_distinct, occurrences, class): values of different classes differ, so their estimates add up."""
    each = added(days).where("key is not null").withColumn("k", F.hll_sketch_estimate("sketch"))
    stats = each.groupBy(*KEYS).agg(F.sum("k").alias("n_distinct"), F.sum("n").alias("occurrences"), F.max(F.struct("k", "class")).alias("top"))
    return stats.select(*KEYS, "n_distinct", "occurrences", F.when(F.col("top.k") >= dominant * F.col("n_distinct"), F.col("top.class")).alias("class"))


def metric_summary(days: DataFrame) -> DataFrame:
    """(service, metric, n_series)."""
    whole = added(days).where("key is null and metric is not null")
    return whole.select("service", "metric", F.hll_sketch_estimate("sketch").alias("n_series"))


def volume_summary(days: DataFrame) -> DataFrame:
    """(service, signal, per_minute, bytes_per_minute) over the time from the first record of all to the last, a minute at least."""
    whole = days.where("key is null")
    minutes = whole.agg(F.greatest(F.lit(1.0), (F.max("last_ms") - F.min("first_ms")) / 60_000)).scalar()
    sums = whole.groupBy("service", "signal").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    return sums.select("service", "signal", (F.col("n") / minutes).alias("per_minute"), (F.col("bytes") / minutes).alias("bytes_per_minute"))


def _same(columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on &= F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    return on


def _both(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    joined = before.alias("b").join(after.alias("a"), _same(keys), "full_outer")
    rest = [c for c in before.columns if c not in keys]
    return joined.select(*(F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys), *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ba" for c in rest))


#: Columns of a change.
CHANGE = ("kind", "verdict", "service", "signal", "scope", "metric", "key", "class", "base", "current")


def usage_changes(before: DataFrame, after: DataFrame, min_distinct: int = 100, min_ratio: float = 0.1, id_min: int = 20, max_series: int = 500, grown: float = 2.0, volume: float = 0.25) -> DataFrame:
    """What changed between two periods' days, rows of CHANGE.

    attribute and metric: flagged now and not before (new), flagged in both and grown (grown times as many values and min_distinct
    more), or flagged before only (resolved); an attribute is flagged as by rules R1 and R2, a metric by its series. volume: a signal's
    records a minute moved by a share of volume or more, or began. service: added, missing. A service that is gone resolves nothing.
    """
    known = [k for keys in KEY_HINTS.values() for k in keys]
    services = _both(*(d.select("service").distinct().withColumn("there", F.lit(True)) for d in (before, after)), ["service"])
    present = services.where("a_there").select("service")

    def verdict(flag_before: Column, flag_after: Column, base: Column, current: Column) -> Column:
        was, now = F.coalesce(flag_before, F.lit(False)), F.coalesce(flag_after, F.lit(False))
        more = (current >= grown * base) & (current - base >= min_distinct)
        return F.when(now & ~was, "new").when(now & was & more, "grown").when(was & ~now, "resolved")

    def flagged(s: str) -> Column:
        n, occurrences = F.col(f"{s}_n_distinct"), F.col(f"{s}_occurrences")
        id_like = F.coalesce(F.col(f"{s}_class").isin(*ID_CLASSES), F.lit(False)) | F.col("key").isin(*known)
        return ((n >= min_distinct) & (n / occurrences >= min_ratio)) | (id_like & (n >= id_min))

    def rows(df: DataFrame, kind: str, how: Column, **columns: Column) -> DataFrame:
        df = df.withColumns({"verdict": how, "kind": F.lit(kind)} | columns).where("verdict is not null")
        missing = {c: F.lit(None).cast("double" if c in ("base", "current") else "string") for c in CHANGE if c not in df.columns}
        return df.withColumns(missing).select(*CHANGE[:8], F.col("base").cast("double").alias("base"), F.col("current").cast("double").alias("current"))

    attributes = _both(*(attribute_summary(d).where("scope <> 'metric'") for d in (before, after)), KEYS).join(present, "service", "left_semi")
    base, current = F.col("b_n_distinct"), F.col("a_n_distinct")
    out = rows(attributes, "attribute", verdict(flagged("b"), flagged("a"), base, current), base=base, current=current, **{"class": F.coalesce("a_class", "b_class")})
    metrics = _both(*(metric_summary(d) for d in (before, after)), ["service", "metric"]).join(present, "service", "left_semi")
    base, current = F.col("b_n_series"), F.col("a_n_series")
    out = out.unionByName(rows(metrics, "metric", verdict(base >= max_series, current >= max_series, base, current), base=base, current=current, signal=F.lit("metrics")))
    volumes = _both(*(volume_summary(d) for d in (before, after)), ["service", "signal"])
    both = services.where("a_there and b_there").select("service")
    base, current = F.coalesce("b_per_minute", F.lit(0.0)), F.coalesce("a_per_minute", F.lit(0.0))
    moved = F.when((base == 0) | (F.abs(current / F.when(base > 0, base) - 1) >= volume), "volume")
    out = out.unionByName(rows(volumes.join(both, "service", "left_semi"), "volume", moved, base=base, current=current))
    return out.unionByName(rows(services, "service", F.when(F.col("b_there").isNull(), "added").when(F.col("a_there").isNull(), "missing")))
