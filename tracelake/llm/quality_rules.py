"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text, after plain counts.

Method, in DataFrame functions only: every text is cut into runs of letters and digits and runs of other signs;
its unigrams and bigrams of these are hashed into a fixed number of buckets. Two multinomials over the buckets,
one of the trusted documents and one of all documents, are counted over whole texts with add-one smoothing. A
document's score is the mean over its n-grams of log(p_trusted / p_raw), so length does not matter, and it is
kept when the score reaches a fixed threshold and the plain rules hold. Only per-bucket counts and one row per
document are shuffled; the table of log ratios has as many rows as there are buckets, whatever the input's size,
and that bound is why it may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import BROADCAST_ROWS, semi_join_ids, stored, words

BUCKETS = 1 << 16  # a power of two
#: Mean log ratio below which a document is unlike the trusted ones. Trusted text scores about 0 or a little more.
THRESHOLD = -0.3
MIN_WORDS = 50
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"


def _buckets(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket): the hashed unigrams and bigrams of df's text, a row each; a text without any has one null.

    Neighbours are exploded together and hashed afterwards, as plain columns: hashing inside the arrays is slower.
    """
    df = df.withColumn("tokens", F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKENS), F.lit(0)))
    both = F.arrays_zip(F.col("tokens").alias("x"), F.slice("tokens", F.lit(2), F.size("tokens")).alias("y"))
    df = df.select(*keys, F.explode_outer(both).alias("t"))
    hashed = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    one = F.when(F.col("t.x").isNotNull(), hashed(F.col("t.x")))
    two = F.when(F.col("t.y").isNotNull(), hashed(F.col("t.x"), F.col("t.y")))
    return df.select(*keys, F.explode(F.array(one, two)).alias("bucket"))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, weight): log(p_trusted / p_raw) of each bucket that occurs; no trusted text gives weights of 0.

    docs: doc_id, text. trusted: doc_id of the trusted documents; ids may repeat or be unknown. Few ids are
    broadcast; more than BROADCAST_ROWS are joined by a shuffle.
    """
    ids = stored(trusted.where("doc_id is not null").select("doc_id").distinct())
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    marked = docs.join(ids.withColumn("good", F.lit(1)), "doc_id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))
    rows = _buckets(marked, "good").where("bucket is not null")
    # A bucket's counts are summed in each task before they move.
    counts = stored(rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")))
    total = counts.agg(F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good")).first()
    n_raw, n_good = total["n_raw"] or 0, total["n_good"] or 0
    if not n_good:
        return counts.select("bucket", F.lit(0.0).alias("weight"))
    ratio = F.log((F.col("good") + 1) / F.lit(float(n_good + BUCKETS))) - F.log((F.col("raw") + 1) / F.lit(float(n_raw + BUCKETS)))
    return counts.select("bucket", ratio.alias("weight"))


def plain_counts(docs: DataFrame) -> DataFrame:
    """docs (row, doc_id, text) with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("words", words(F.col("text")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    n = F.size("words")
    windows = F.greatest(n - 2, F.lit(0))
    df = df.withColumn("w3", F.arrays_zip(F.slice("words", F.lit(1), windows).alias("a"), F.slice("words", F.lit(2), windows).alias("b"), F.slice("words", F.lit(3), windows).alias("c")))
    df = df.withColumn("h", F.transform("w3", lambda w: F.xxhash64(w["a"], w["b"], w["c"])))
    # Windows in order of their hash, with their places: equal neighbours are windows found twice or more.
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    place = F.when(repeats, F.sort_array(F.arrays_zip(F.col("h").alias("h"), F.sequence(F.lit(0), F.size("h") - 1).alias("at"))))
    df = df.withColumn("sorted", place)
    at = F.col("sorted")
    # Each neighbour's hash beside it, so that no lookup by index is needed.
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(at["h"], F.lit(1), F.size(at) - 1))
    after = F.concat(F.slice(at["h"], F.lit(2), F.size(at) - 1), F.array(F.lit(None).cast("bigint")))
    df = df.withColumn("sides", F.when(at.isNotNull(), F.arrays_zip(at["h"].alias("h"), at["at"].alias("at"), before.alias("before"), after.alias("after"))))
    twice = F.filter("sides", lambda x: (x["h"] == x["before"]) | (x["h"] == x["after"]))
    df = df.withColumn("places", F.transform(twice, lambda x: x["at"]))
    covered = F.array_union(F.array_union("places", F.transform("places", lambda p: p + 1)), F.transform("places", lambda p: p + 2))
    return df.select(
        "row", "doc_id", "text",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def quality_rules(docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """Plain counts, base_failed, log-ratio score and kept for every row of docs.

    base_failed: fewer than min_words words, or over half the words in 3-word windows found twice or more in the
    text. kept: not base_failed and score >= threshold. Null text counts as empty: no words, score 0, not kept.
    Repeated rows each get their own row; a null doc_id is never trusted. Empty tables give an empty result, and
    no trusted document scores of 0. Columns other than the two named are ignored.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    weights = F.broadcast(stored(log_ratios(docs, trusted.select("doc_id"))))  # BUCKETS rows at most
    base = plain_counts(docs.withColumn("row", F.monotonically_increasing_id()))
    keys = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = _buckets(base, *keys).join(weights, "bucket", "left").groupBy(*keys).agg((F.coalesce(F.sum("weight"), F.lit(0.0)) / F.greatest(F.count("bucket"), F.lit(1))).alias("score"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold)).drop("row")


def keep_good(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns; docs has doc_id and text."""
    # Written first: a filter on the verdict would be pushed below it and repeat the work on arrays many times over.
    verdict = stored(quality_rules(docs, trusted, **options).select("doc_id", "kept"))
    good = verdict.where("kept and doc_id is not null").select("doc_id").distinct()
    return semi_join_ids(docs, stored(good), "doc_id")
