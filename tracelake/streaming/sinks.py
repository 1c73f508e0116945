"""Sinks of streams: tables that a batch writes under its id, so that a batch that runs again replaces what it wrote.

Each start() begins a stream and returns its query; each reader gives the whole result so far, and can run beside the stream.
Tables grow by one folder a batch; compact() folds the closed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tracelake.streaming.operators import COPY_ORDER, latest_spans


def _write(path: str, rows: DataFrame, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def _started(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_latest_spans(spans: DataFrame, path: str, checkpoint: str, late: str = "60 minutes", width: str = "1 hour", once: bool = False) -> StreamingQuery:
    """Keep of each span the copy that ends last, also of copies in different batches, at path.

    State holds one copy of each span and window until the watermark passes; a better copy is written again and replaces the earlier one
    in read_latest_spans(), whatever batch or window it came in.
    """
    return _started(latest_spans(spans, late, width).writeStream.outputMode("update").foreachBatch(lambda rows, k: _write(path, rows, k)), checkpoint, once)


def start_span_copies(spans: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep all copies of spans with ids at path as they come, for read_latest_spans(): no state, no shuffle, and nothing is late.

    For streams whose spans are too many for a state; start_latest_spans() keeps a smaller table where most copies are worse ones.
    """
    known = spans.where((F.coalesce("trace_id", F.lit("")) != "") & (F.coalesce("span_id", F.lit("")) != "")).drop("ts")
    return _started(known.writeStream.outputMode("append").foreachBatch(lambda rows, k: _write(path, rows, k)), checkpoint, once)


def read_latest_spans(spark: SparkSession, path: str) -> DataFrame:
    """Of all copies at path that of each span that ends last. Rows are sorted once, after the shuffle, by a hash before the long ids."""
    rows = _read(spark, path).drop("batch").withColumn("_h", F.xxhash64("trace_id", "span_id")).repartition("_h")
    best = Window.partitionBy("_h", "trace_id", "span_id").orderBy(*(F.col(c).desc_nulls_last() for c in COPY_ORDER))
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_h")


def start_volume(records: DataFrame, path: str, checkpoint: str, width_ms: int = 60_000, keep: int = 60, once: bool = False) -> StreamingQuery:
    """Count records (service, signal, time_ms, bytes) by buckets of width_ms; those older than keep buckets when they come count as late.

    The newest time that a batch knows is that of the batches before it and its own, read from the table, so a batch that runs again
    decides alike. Nothing is dropped: late records are in the totals.
    """

    def add(rows: DataFrame, batch_id: int) -> None:
        at = F.floor(F.col("time_ms") / width_ms).cast("bigint")
        sums = rows.groupBy("service", "signal", at.alias("at")).agg(F.count("*").alias("n_records"), F.sum("bytes").alias("bytes")).persist()
        newest = sums.agg(F.max("at")).first()[0]
        if batch_id:
            before = _read(rows.sparkSession, path).where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
            newest = max((x for x in (newest, before) if x is not None), default=None)
        _write(path, sums.withColumn("newest", F.lit(newest).cast("bigint")).withColumn("is_late", F.col("at") <= F.lit(newest).cast("bigint") - keep), batch_id)
        sums.unpersist()

    return _started(records.writeStream.outputMode("append").foreachBatch(add), checkpoint, once)


def read_volume(spark: SparkSession, path: str, width_ms: int = 60_000, keep: int = 60) -> tuple[DataFrame, DataFrame]:
    """(from_ms, service, signal, n_records, bytes) of the newest keep buckets, without what came late; and totals of all records with
    n_late, those that came late."""
    rows = _read(spark, path)
    newest = rows.agg(F.max("newest")).first()[0]
    sums = (F.sum("n_records").alias("n_records"), F.sum("bytes").alias("bytes"))
    kept = rows.where(~F.col("is_late") & (F.col("at") > F.lit(newest).cast("bigint") - keep))
    buckets = kept.groupBy((F.col("at") * width_ms).alias("from_ms"), "service", "signal").agg(*sums)
    return buckets, rows.groupBy("service", "signal").agg(*sums, F.sum(F.when(F.col("is_late"), F.col("n_records")).otherwise(0)).alias("n_late"))


def start_distinct(rows: DataFrame, path: str, checkpoint: str, late: str = "60 minutes", width: str = "1 day", once: bool = False) -> StreamingQuery:
    """Sketches of the distinct values of (key, value, ts), by key and window of ts, written again whenever they change."""
    sketches = rows.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.hll_sketch_agg("value", F.lit(11)).alias("sketch"))
    flat = sketches.select(F.col("window.start").alias("from_ts"), "key", "sketch")
    return _started(flat.writeStream.outputMode("update").foreachBatch(lambda out, k: _write(path, out, k)), checkpoint, once)


def read_distinct(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(key, n_distinct) over all windows, or those of where (a condition on from_ts): sketches add up."""
    rows = _read(spark, path) if where is None else _read(spark, path).where(where)
    return rows.groupBy("key").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def start_distinct_values(rows: DataFrame, path: str, checkpoint: str, width: str = "1 day", once: bool = False) -> StreamingQuery:
    """The distinct values themselves of each batch of (key, value, ts), by key and window of ts: exact for any number, without state, and
    nothing is late. Tables are as large as the values of each batch; compact() with distinct() folds them. start_distinct() keeps sketches.
    """

    def add(batch: DataFrame, k: int) -> None:
        _write(path, batch.select(F.window("ts", width)["start"].alias("from_ts"), "key", "value").distinct(), k)

    return _started(rows.writeStream.outputMode("append").foreachBatch(add), checkpoint, once)


def read_distinct_values(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(key, n_distinct), exact, over all windows or those of where (a condition on from_ts); missing values don't count."""
    rows = _read(spark, path) if where is None else _read(spark, path).where(where)
    return rows.groupBy("key").agg(F.count_distinct("value").alias("n_distinct"))


def compact(spark: SparkSession, path: str, fold, before: int) -> int:
    """Fold the batches below before (closed ones) into one table, batch -1; fold gets their rows. Returns how many were folded.

    The folded table is written first, so a reader that starts in between may see rows twice, never miss them; run it between batches.
    """
    batches = [r["batch"] for r in _read(spark, path).where(F.col("batch") < before).select("batch").distinct().collect()]
    if len(batches) > 1:
        rows = fold(_read(spark, path).where(F.col("batch").isin(*batches)).drop("batch"))
        made = f"{path}/made"
        rows.write.mode("overwrite").parquet(made)
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for b in batches:
            fs.delete(fs_path(f"{path}/batch={b}"), True)
        fs.rename(fs_path(made), fs_path(f"{path}/batch=-1"))
    return len(batches)
