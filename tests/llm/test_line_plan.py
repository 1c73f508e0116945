"""What line dedup reads and shuffles."""

from __future__ import annotations

from tracelake.llm import line_dedup


def test_minima_are_folded_where_their_line_is(spark):
    """Equal lines are shingled once, and only whole lines are dealt out: no exchange stands above the shingles."""
    line = "a line that is well over forty-eight characters long, so that it gets bands of minima"
    lines = spark.createDataFrame([(line,), (line,), (line + " and more",), ("short",)], "line string").repartition(3)
    bands = line_dedup._long_bands(lines)
    plan = bands._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")
    rows = bands.collect()
    assert len({r["h"] for r in rows}) == 2 and len(rows) == len(set(rows)) <= 2 * line_dedup.BANDS
