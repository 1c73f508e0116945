"""Stored usage days: they add up, replace themselves, and compare as their records do; adjusted p-values against a plain loop."""

from __future__ import annotations

import random

from tracelake.operators import baseline, summaries, usage

DAY = summaries.DAY_MS
KIND = "service string, signal string, scope string, metric string, time_ms double, bytes long, attrs map<string,string>, events array<map<string,string>>"
POINT = "service string, metric string, instance_id string, attrs map<string,string>, time_ms double"


def span(service, day, k, **attrs):
    return (service, "traces", "span", None, float(day * DAY + k), 100, attrs, [])


def days_of(spark, rows, points=()):
    return summaries.usage_days(spark.createDataFrame(rows, KIND), spark.createDataFrame(list(points), POINT))


def changes(before, after, **limits):
    return {(r["kind"], r["verdict"], r["service"], r["key"] or r["metric"] or r["signal"]) for r in summaries.usage_changes(before, after, **limits).collect()}


def test_days_add_up(spark, tmp_path):
    rows = [span("a", d, k, **{"user.id": str(k % (10 * (d + 1))), "zone": "z"}) for d in range(3) for k in range(60)]
    path = str(tmp_path / "usage")
    summaries.save_usage(days_of(spark, rows), path)
    summaries.save_usage(days_of(spark, [r for r in rows if r[4] >= DAY and r[4] < 2 * DAY]), path)  # the same day again
    all_ = {r["key"]: (r["n_distinct"], r["occurrences"]) for r in summaries.attribute_summary(summaries.load_usage(spark, path, 0, 9)).collect()}
    assert all_ == {"user.id": (30, 180), "zone": (1, 180)}
    first = {r["key"]: (r["n_distinct"], r["occurrences"]) for r in summaries.attribute_summary(summaries.load_usage(spark, path, 0, 0)).collect()}
    assert first == {"user.id": (10, 60), "zone": (1, 60)}


def test_changes(spark):
    before = [span("a", 0, k, **{"user.id": str(k % 30), "old": f"{k:08d}"}) for k in range(300)] + [span("gone", 0, k, **{"user.id": str(k)}) for k in range(50)]
    after = [span("a", 1, k, **{"user.id": str(k % 400), "fresh": f"{k:08d}"}) for k in range(500)] + [span("late", 1, 1, x="y")]
    points = [("a", "m", "i", {"l": str(k)}, float(DAY + k)) for k in range(40)]
    a = days_of(spark, before)
    b = days_of(spark, [*after, *(("a", "metrics", "metric", "m", p[4], 10, p[3], []) for p in points)], points)
    assert changes(a, b, max_series=30) == {
        ("attribute", "grown", "a", "user.id"), ("attribute", "resolved", "a", "old"), ("attribute", "new", "a", "fresh"), ("metric", "new", "a", "m"),
        ("volume", "volume", "a", "traces"), ("volume", "volume", "a", "metrics"), ("service", "added", "late", None), ("service", "missing", "gone", None),
    }
    assert changes(a, a) == set()


def test_adjusted_p(spark):
    r = random.Random(9)
    ps = [round(r.random() ** 3, 3) for _ in range(2000)] + [None, 0.0, 1.0, 1.0]
    got = baseline.bh_adjust(spark.createDataFrame([(k, p) for k, p in enumerate(ps)], "k int, p double").repartition(6), "p").collect()
    known = sorted((p, k) for k, p in enumerate(ps) if p is not None)
    want, least = {}, 1.0
    for rank in range(len(known), 0, -1):
        p, k = known[rank - 1]
        least = min(least, p * len(known) / rank)
        want[k] = least
    out = {x["k"]: x["q"] for x in got}
    assert len(got) == len(ps) and out[2000] is None and all(abs(out[k] - q) < 1e-12 for k, q in want.items())


def test_attributes_of_events_are_apart(spark):
    rows = [("a", "traces", "span", None, 1.0, 50, {"k": "x"}, [{"k": "y"}, {"k": "y", "m": None}]), ("a", "traces", "span", None, 2.0, 50, None, [])]
    got = {(r["scope"], r["key"], r["value"]): r["n"] for r in usage.counted(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {("span", None, None): 2, ("span", "k", "x"): 1, ("span.event", "k", "y"): 2}
