"""Log templates: likeness, first words beyond a maximum, shapes of typed bodies, the cap, order of rows, parts that are merged."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import logs as log_ops
from tracelake.operators import metrics, templates


def logs_of(spark, bodies):
    return spark.createDataFrame([("s", b, float(k)) for k, b in enumerate(bodies)], "service string, body string, time_ms double")


def found(df):
    return {r["template"]: r["n_logs"] for r in df.collect()}


def test_words_that_vary(spark):
    bodies = ["joined from 10.1.1.1", "joined from 10.1.1.2", "Code word 0xCAFEBABE", "member anna came in", "member bert came in"]
    assert found(templates.log_templates(logs_of(spark, bodies))) == {"joined from <IP>": 2, "member <*> came in": 2, "Code word 0xCAFEBABE": 1}


def test_first_words_beyond_the_maximum(spark):
    assert found(templates.log_templates(logs_of(spark, ["k q", "l q", "m q", "n q"]), max_children=3)) == {"k q": 1, "l q": 1, "<*> q": 2}


def test_shapes(spark):
    wide = {f"f{k:02d}": k for k in range(40)}
    bodies = [{"z": 1, "y": {"x": 2}}, {"y": 0, "z": [1]}, [1, 2], 5, 7.5, True, None, "   ", "", wide, "plain words 5"]
    df = spark.createDataFrame([("s", json.dumps(b), float(k)) for k, b in enumerate(bodies)], "service string, j string, time_ms double").withColumn("body", F.parse_json("j"))
    shape = "{" + ",".join(f"f{k:02d}" for k in range(32)) + ",…}"
    out = {r["template"]: (r["n_logs"], r["sample"]) for r in templates.log_templates(df.select("service", "body", "time_ms")).collect()}
    assert {k: v[0] for k, v in out.items()} == {"{y,z}": 2, "[array]": 1, "<NUM>": 2, "<BOOL>": 1, "<empty>": 3, shape: 1, "plain words <NUM>": 1}
    assert out["{y,z}"][1] == '{"y":{"x":2},"z":1}' and out["plain words <NUM>"][1] == "plain words 5"


def test_samples_are_redacted_then_cut(spark):
    secret = "token " + "x" * 100 + " password=opensesame-and-more-of-it " + "y" * 300
    row = templates.log_templates(logs_of(spark, [secret])).first()
    assert len(row["sample"]) == 121 and row["sample"].endswith("…") and "opensesame" not in row["sample"]


def test_cap_keeps_all_counts(spark):
    bodies = ["one", "two words", "two words", "three words here", "four words are here"]
    got = found(templates.log_templates(logs_of(spark, bodies), most=2))
    assert got == {"two words": 2, "one": 1, "(other)": 2}


def test_parts_and_order(spark):
    """Many distinct patterns of one first word, dealt to parts of a few rows: the same templates as at once, in any order of rows."""
    r = random.Random(4)
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    bodies = [f"login {name()} accepted by {name()} now" for _ in range(3000)] + [f"login refused after {name()} retries" for _ in range(500)] + ["login page shown"] * 40
    rows = logs_of(spark, bodies).repartition(7)
    want = {"login <*> accepted by <*> now": 3000, "login refused after <*> retries": 500, "login page shown": 40}
    assert found(templates.log_templates(rows)) == want
    patterns = templates.log_patterns(rows)
    merged = templates.merge_templates(patterns, part=200)
    assert {" ".join(x["tokens"]): x["n"] for x in merged.collect()} == want
    # Tables of templates of two halves add up to those of all.
    halves = [templates.merge_templates(templates.log_patterns(rows.where(F.pmod(F.xxhash64("body"), F.lit(2)) == k))) for k in range(2)]
    both = templates.merge_templates(halves[0].unionByName(halves[1]))
    assert {" ".join(x["tokens"]): (x["n"], x["bytes"]) for x in both.collect()} == {k: (n, sum(len(b) for b in bodies if len(b.split()) == len(k.split()))) for k, n in want.items()}


def test_million_patterns_of_one_word(spark):
    rows = spark.range(1_000_000).select(F.lit("s").alias("service"), F.concat(F.lit("user "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" signed in")).alias("body"), F.col("id").cast("double").alias("time_ms"))
    assert found(templates.log_templates(rows)) == {"user <*> signed in": 1_000_000}


@pytest.mark.parametrize("kind", ["string", "variant"])
def test_no_logs(spark, kind):
    none = spark.createDataFrame([], "service string, body string, time_ms double")
    assert templates.log_templates(none.withColumn("body", F.col("body").cast(kind))).count() == 0


def test_sort_of_mixed_types(spark):
    values = [True, "b", 10, {"k": 1}, None, "2", [3], "a", 1.5, False, "-1"]
    rows = spark.createDataFrame([(json.dumps(v), k) for k, v in enumerate(values)], "j string, seq int").withColumn("v", F.parse_json("j"))
    up = [json.loads(r["j"]) for r in log_ops.sort_logs(rows, F.col("v")).collect()]
    assert up == ["-1", 1.5, "2", 10, "a", "b", False, True, {"k": 1}, [3], None]
    down = [json.loads(r["j"]) for r in log_ops.sort_logs(rows, F.col("v"), descending=True).collect()]
    assert down == [{"k": 1}, [3], True, False, "b", "a", 10, "2", 1.5, "-1", None]


def test_rollup_keeps_all_points(spark):
    points = spark.createDataFrame([("a", 0.0, 1.0, 0), ("a", 12_000 * 60_000.0, 1.0, 1), ("b", 0.0, 2.0, 0), ("b", 180_000.0, 3.0, 1)], "k string, time_ms double, value double, seq int")
    got = metrics.rollup_over_time(points, ["k"], 60_000, "sum").collect()
    assert sum(r["sum"] or 0 for r in got if r["k"] == "a") == 2.0 and sum(r["k"] == "a" for r in got) == 2
    assert sorted((r["bucket_ms"], r["sum"]) for r in got if r["k"] == "b") == [(0, 2.0), (60_000, None), (120_000, None), (180_000, 3.0)]
