"""Baselines: capture call statistics with samples, and compare two captures by tests and floors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tracelake.operators.ordered import running
from tracelake.operators.store import stored

KEYS = ["source", "target", "operation"]
#: A capture keeps about SAMPLES durations in all, and of each entry between the two bounds where it has as many.
SAMPLES, LEAST_SAMPLES, MOST_SAMPLES = 200_000, 100, 1000
ALPHA = 0.05


def thin_samples(rows: DataFrame, keys: list[str], entries: DataFrame) -> DataFrame:
    """(keys, samples): an entry's durations in order; of more than the cap, evenly spaced ones. entries: keys and n_calls.

    The cap is SAMPLES divided by the number of entries, within its bounds. Rows are counted by duration first, so a
    task sees an entry's distinct durations, each with its place in the order and the number of samples that fall there.
    """
    number = entries.agg(F.count("*").alias("_entries")).withColumn("_one", F.lit(1))
    cap = F.least(F.lit(MOST_SAMPLES), F.greatest(F.lit(LEAST_SAMPLES), F.floor(F.lit(SAMPLES) / F.greatest(F.col("_entries"), F.lit(1)))))
    named = [F.coalesce(F.col(k), F.lit("\x00")).alias(f"_{k}") for k in keys]
    counts = rows.groupBy(*named, F.round("ms", 2).alias("ms")).agg(F.count("*").alias("_n"))
    sizes = entries.select(*named, F.col("n_calls").alias("_all"), F.lit(1).alias("_one")).join(F.broadcast(number), "_one")  # one row
    sizes = sizes.withColumn("_cap", F.least(cap, F.col("_all"))).drop("_one", "_entries")
    counts = counts.join(sizes, [f"_{k}" for k in keys])
    upto = F.sum("_n").over(Window.partitionBy(*(f"_{k}" for k in keys)).orderBy("ms"))
    # Sample j stands at the place (j + 0.5) * all / cap: so many lie before place x.
    before = lambda x: F.greatest(F.lit(0), F.least(F.col("_cap"), F.ceil(F.col("_cap") * x / F.col("_all") - 0.5)))
    counts = counts.withColumn("_upto", upto).withColumn("_take", (before(F.col("_upto")) - before(F.col("_upto") - F.col("_n"))).cast("int")).where("_take > 0")
    held = counts.groupBy(*(f"_{k}" for k in keys)).agg(F.array_sort(F.collect_list(F.struct("ms", "_take"))).alias("held"))  # at most the cap
    plain = [F.when(F.col(f"_{k}") != "\x00", F.col(f"_{k}")).alias(k) for k in keys]
    return held.select(*plain, F.flatten(F.transform("held", lambda x: F.array_repeat(x["ms"], x["_take"]))).alias("samples"))


def capture_baseline(calls: DataFrame, since_ms: Column | None = None, until_ms: Column | None = None, operations: int = 50) -> DataFrame:
    """Entries for (target), (source, target) and each with the operation: calls, errors, quantiles, samples, examples.

    calls: rows of servicemap.calls. Of a scope's operations the most called are kept; is_truncated says of the scope's
    own entry that there were more. Samples are those of thin_samples, so no entry grows with its calls.
    """
    rows = calls
    if since_ms is not None:
        rows = rows.where(F.col("end_ms") >= since_ms)
    if until_ms is not None:
        rows = rows.where(F.col("end_ms") < until_ms)
    none = F.lit(None).cast("string")
    rows = rows.withColumn("operation", F.explode(F.array(none, F.col("operation"))))
    found = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n_calls"), F.count_if("is_error").alias("n_errors"), F.percentile("ms", F.lit(0.5)).alias("p50_ms"), F.percentile("ms", F.lit(0.95)).alias("p95_ms"),
        F.max_by("trace_id", F.struct("ms", "trace_id")).alias("slowest"), F.max_by("trace_id", F.when(F.col("is_error"), F.struct("end_ms", "trace_id"))).alias("last_error"),
    )
    scope = Window.partitionBy("source", "target")
    order = scope.orderBy(F.col("operation").isNotNull(), F.desc("n_calls"), "operation")
    found = found.withColumn("_n", F.row_number().over(order)).withColumn("is_truncated", F.col("operation").isNull() & (F.count("operation").over(scope) > operations))
    found = stored(found.where(F.col("_n") <= operations + 1).drop("_n"))
    samples = thin_samples(rows, KEYS, found)
    match = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in KEYS]
    return found.alias("l").join(samples.alias("r"), match[0] & match[1] & match[2], "left").select("l.*", "r.samples")


def scope_counts(calls: DataFrame, since_ms: Column | None = None, until_ms: Column | None = None) -> DataFrame:
    """A capture's own entries of nodes and edges (operation null) with their calls: all that fanout() and coverage() read of one."""
    rows = calls if since_ms is None else calls.where(F.col("end_ms") >= since_ms)
    rows = rows if until_ms is None else rows.where(F.col("end_ms") < until_ms)
    return rows.groupBy("source", "target").agg(F.count("*").alias("n_calls")).withColumn("operation", F.lit(None).cast("string"))


def mann_whitney(samples: DataFrame, keys: list[str]) -> DataFrame:
    """U test per key on rows (keys, side 0 or 1, x): z with tie and continuity correction, positive if side 1 is larger."""
    pool = Window.partitionBy(*keys)
    ranked = samples.withColumn("low", F.rank().over(pool.orderBy("x"))).withColumn("same", F.count("*").over(Window.partitionBy(*keys, "x")))
    ranked = ranked.withColumn("r", F.col("low") + (F.col("same") - 1) / 2)
    s = ranked.groupBy(*keys).agg(
        F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"), F.sum(F.when(F.col("side") == 1, F.col("r"))).alias("r1"),
        F.sum(F.col("same").cast("double") * F.col("same") - 1).alias("ties"),
    )
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = n0 + n1
    u = F.coalesce("r1", F.lit(0.0)) - n1 * (n1 + 1) / 2
    mean = n0 * n1 / 2
    variance = n0 * n1 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    off = F.greatest(F.lit(0.0), F.abs(u - mean) - 0.5)
    z = F.when((n0 > 0) & (n1 > 0) & (n > 1) & (variance > 0), F.signum(u - mean) * off / F.sqrt(variance)).otherwise(0.0)
    return s.select(*keys, "n0", "n1", F.coalesce(z, F.lit(0.0)).alias("z"))


@pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a normal score."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))


@pandas_udf(DoubleType())
def fisher_p(k0: pd.Series, n0: pd.Series, k1: pd.Series, n1: pd.Series) -> pd.Series:
    """Two-sided exact test of k0 of n0 against k1 of n1."""
    log = _log_factorials(int(max((n0 + n1).max(), 1)) if len(n0) else 1)

    def one(a, m, b, n):
        k, total = a + b, m + n
        lo, hi = max(0, k - n), min(k, m)
        x = np.arange(lo, hi + 1)
        p = log[m] - log[x] - log[m - x] + log[n] - log[k - x] - log[n - k + x] - (log[total] - log[k] - log[total - k])
        return float(min(1.0, np.exp(p[p <= p[a - lo] + 1e-7]).sum()))

    return pd.Series([one(*map(int, r)) for r in zip(k0, n0, k1, n1, strict=True)], dtype=float)


def proportion_z(k0: Column, n0: Column, k1: Column, n1: Column) -> Column:
    """Pooled z of two shares; null where an expected count is under 5 and the exact test is due."""
    pooled = (k0 + k1) / (n0 + n1)
    enough = (F.least(n0, n1) * F.least(pooled, 1 - pooled)) >= 5
    return F.when(enough, (k1 / n1 - k0 / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1)))


def proportion_test(df: DataFrame, k0: str, n0: str, k1: str, n1: str) -> DataFrame:
    """df with z and p of the difference of two shares."""
    rows = df.withColumn("z", proportion_z(*(F.col(c) for c in (k0, n0, k1, n1))))
    exact = fisher_p(*(F.col(c) for c in (k0, n0, k1, n1)))
    return rows.withColumn("p", F.when(F.col("z").isNull(), exact).otherwise(two_sided_p(F.col("z"))))


def bh_adjust(df: DataFrame, p: str, to: str = "q") -> DataFrame:
    """Benjamini-Hochberg: q is the least of p * n / rank among this and larger p. One row for each key tested; without p no q.

    Equal p share the largest of their ranks, which the least then comes from anyway, so distinct p are ranked with their numbers, and
    both sweeps run over partitions of the order: no task holds all keys.
    """
    sizes = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_same"))
    ranked = running(sizes, [], ["_p"], _rank="_same")
    ranked = stored(ranked)
    whole = ranked.agg(F.max("_rank")).scalar()
    scaled = ranked.select("_p", (-F.col("_p")).alias("_down"), (F.col("_p") * whole / F.col("_rank")).alias("_q"))
    swept = running(scaled, [], ["_down"], least={"_least": F.col("_q")})
    return df.join(swept.select(F.col("_p").alias(p), F.least(F.lit(1.0), "_least").alias(to)), p, "left").select(*df.columns, to)


def _sign(c: Column) -> Column:
    return F.coalesce(F.signum(c), F.lit(0.0))


def compare_baseline(before: DataFrame, after: DataFrame, min_calls: int = 20, min_ms: float = 5.0, min_percent: float = 20.0, min_points: float = 2.0, min_fanout: float = 1.0) -> DataFrame:
    """Each entry's changes and verdict: new, untracked, removed, insufficient, regressed, improved or unchanged.

    Where both sides have min_calls, three tests are made: p50 by ranks of the samples, p95 by how often each side reaches
    the pooled p95 (tail_test), errors by their shares. Their p are adjusted together. A quantile has changed if its
    test is significant and it moved that way by min_ms and min_percent; the error rate if its test is and it moved by
    min_points hundredths; calls for each call into the source if they moved by min_fanout. One regressed figure makes
    a regressed entry. An operation that only the later side has is untracked where the earlier one left some out.
    """
    columns = ("n_calls", "n_errors", "p50_ms", "p95_ms", "samples", "is_truncated")
    part = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in (*KEYS, *columns)))
    match = [F.col(f"b_{k}").eqNullSafe(F.col(f"a_{k}")) for k in KEYS]
    both = part(before, "b").join(part(after, "a"), match[0] & match[1] & match[2], "full_outer")
    both = both.withColumns({k: F.coalesce(f"b_{k}", f"a_{k}") for k in KEYS}).drop(*(f"{p}_{k}" for p in "ab" for k in KEYS))
    both = stored(both.withColumn("key", F.concat_ws("\x1f", *(F.coalesce(F.col(k), F.lit("\x00")) for k in KEYS))))
    enough = both.where(F.least("b_n_calls", "a_n_calls") >= min_calls).where("b_n_calls is not null and a_n_calls is not null")
    sides = [enough.select("key", F.lit(s).alias("side"), F.explode(f"{c}_samples").alias("x")) for s, c in ((0, "b"), (1, "a"))]
    samples = stored(sides[0].unionByName(sides[1]))
    ranks = mann_whitney(samples, ["key"]).select("key", F.lit("p50").alias("test"), F.col("z").alias("way"), two_sided_p(F.col("z")).alias("p"))
    shares = lambda df, name, k0, n0, k1, n1: proportion_test(df, k0, n0, k1, n1).select("key", F.lit(name).alias("test"), (F.col(k1) / F.col(n1) - F.col(k0) / F.col(n0)).alias("way"), "p")
    tails = shares(tail_test(samples, ["key"]), "p95", "k0", "n0", "k1", "n1")
    errors = shares(enough, "error", "b_n_errors", "b_n_calls", "a_n_errors", "a_n_calls")
    tests = bh_adjust(stored(ranks.unionByName(tails).unionByName(errors)), "p")
    pick = lambda t, c: F.max(F.when(F.col("test") == t, F.col(c)))
    tests = tests.groupBy("key").agg(*(pick(t, c).alias(f"{t}_{c}") for t in ("p50", "p95", "error") for c in ("way", "q")))
    into = both.where("source is null and operation is null").select(F.col("target").alias("source"), F.col("b_n_calls").alias("b_into"), F.col("a_n_calls").alias("a_into"))
    scopes = both.where("operation is null").select(F.coalesce("source", F.lit("\x00")).alias("_source"), "target", F.col("b_is_truncated").alias("_hidden"))
    rows = both.drop("b_samples", "a_samples").join(tests, "key", "left").join(into, "source", "left").withColumn("_source", F.coalesce("source", F.lit("\x00"))).join(scopes, ["_source", "target"], "left")

    change = lambda c: F.col(f"a_{c}") - F.col(f"b_{c}")
    moved = lambda c: (F.abs(change(c)) >= min_ms) & ((F.col(f"b_{c}") <= 0) | (F.abs(change(c)) / F.col(f"b_{c}") * 100 >= min_percent))

    def quantile(t: str) -> Column:
        way = _sign(F.col(f"{t}_way"))
        return F.when((F.col(f"{t}_q") < ALPHA) & (way == _sign(change(f"{t}_ms"))) & moved(f"{t}_ms"), way)

    rate = F.col("a_n_errors") / F.col("a_n_calls") - F.col("b_n_errors") / F.col("b_n_calls")
    fan = F.when(F.col("source").isNotNull(), F.col("a_n_calls") / F.col("a_into") - F.col("b_n_calls") / F.col("b_into"))
    ways = [quantile("p50"), quantile("p95"), F.when((F.col("error_q") < ALPHA) & (F.abs(rate) * 100 >= min_points), _sign(F.col("error_way"))), F.when(F.col("p50_q").isNotNull() & (F.abs(fan) >= min_fanout), _sign(fan))]
    any_ = lambda w: F.greatest(*(F.coalesce(x == w, F.lit(False)) for x in ways))
    verdict = (
        F.when(F.col("b_n_calls").isNull(), F.when(F.col("operation").isNotNull() & F.coalesce("_hidden", F.lit(False)), "untracked").otherwise("new"))
        .when(F.col("a_n_calls").isNull(), F.when(F.col("b_n_calls") >= min_calls, "removed").otherwise("insufficient"))
        .when(F.least("a_n_calls", "b_n_calls") < min_calls, "insufficient").when(any_(1), "regressed").when(any_(-1), "improved").otherwise("unchanged")
    )
    return rows.select(*KEYS, "b_n_calls", "a_n_calls", "b_p50_ms", "b_p95_ms", change("p50_ms").alias("p50_change"), change("p95_ms").alias("p95_change"), rate.alias("rate_change"), fan.alias("fanout_change"), "p50_q", "p95_q", "error_q", verdict.alias("verdict"))


#: Parts of a comparison: nodes, edges, and the operations of either.
SCOPES = {"services": "source is null and operation is null", "calls": "source is not null and operation is null", "operations": "operation is not null", "all": "true"}


def comparison_summary(compared: DataFrame, scope: str = "all") -> DataFrame:
    return compared.where(SCOPES[scope]).groupBy("verdict").agg(F.count("*").alias("n_entries"))


def ranked_changes(compared: DataFrame, limit: int = 20, scope: str = "all") -> DataFrame:
    """Changed entries of a scope (one of SCOPES): by verdict, then the size of the p95 change relative to the earlier p95, then calls.

    An earlier p95 of 0, or none, counts as 1.
    """
    order = F.array_position(F.array(*map(F.lit, ("regressed", "improved", "new", "removed"))), F.col("verdict"))
    base = F.when(F.coalesce("b_p95_ms", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("b_p95_ms"))
    relative = F.abs(F.coalesce("p95_change", F.lit(0.0)) / base)
    return compared.where(SCOPES[scope]).where(order > 0).orderBy(order, F.desc(relative), F.desc(F.coalesce("a_n_calls", F.lit(0))), *KEYS).limit(limit)


def fanout(entries: DataFrame) -> DataFrame:
    """Calls over each edge for one call into its source."""
    into = entries.where("source is null and operation is null").select(F.col("target").alias("source"), F.col("n_calls").alias("into_calls"))
    edges = entries.where("source is not null and operation is null")
    return edges.join(into, "source", "left").select("source", "target", (F.col("n_calls") / F.col("into_calls")).alias("fanout"))


def tail_test(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each side at or above the pooled 95th value (by floor of 0.95 (n - 1)), and the z of their difference."""
    pool = Window.partitionBy(*keys)
    ranked = samples.withColumn("_r", F.row_number().over(pool.orderBy("x", "side"))).withColumn("_n", F.count("*").over(pool))
    ranked = ranked.withColumn("_cut", F.max(F.when(F.col("_r") == F.floor(0.95 * (F.col("_n") - 1)) + 1, F.col("x"))).over(pool))
    count = lambda s, c: F.count_if((F.col("side") == s) & c)
    above = F.col("x") >= F.col("_cut")
    rows = ranked.groupBy(*keys).agg(count(0, above).alias("k0"), count(0, F.lit(True)).alias("n0"), count(1, above).alias("k1"), count(1, F.lit(True)).alias("n1"))
    return rows.withColumn("z", proportion_z(*(F.col(c) for c in ("k0", "n0", "k1", "n1"))))


def coverage(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: current nodes, how many the baseline lacks, and nodes that only the baseline has."""
    nodes = lambda df: df.where("source is null and operation is null").select("target").distinct()
    both = nodes(before).withColumn("b", F.lit(1)).join(nodes(after).withColumn("a", F.lit(1)), "target", "full_outer")
    return both.agg(F.count("a").alias("n_nodes"), F.count_if(F.col("b").isNull()).alias("n_missing"), F.count_if(F.col("a").isNull()).alias("n_ghosts"))
