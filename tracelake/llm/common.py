"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition used throughout: space, tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"

#: Rows above which a key list is no longer broadcast (8 bytes each: about 4 MB).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local one in local mode (tests), else an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tracelake-"))  # the setting itself is fixed once a session runs
        folder = context.getCheckpointDir()
    return folder


_recorded: list[str] | None = None


@contextmanager
def recorded(paths: list[str]):
    """Within it, the paths of stored tables are added to paths."""
    global _recorded
    before, _recorded = _recorded, paths
    try:
        yield
    finally:
        _recorded = before


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more, and empty the list."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends here and its size is known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    if _recorded is not None:
        _recorded.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text) -> object:
    """Array of the words of a text column; null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def semi_join_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose column is in ids, a stored one-column table. Few ids are broadcast, more are shuffled."""
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, column, "left_semi")


def anti_join_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose column is null or not in ids, a stored one-column table. Few ids are broadcast, more are shuffled."""
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, column, "left_anti")


#: Rows of a stored table that one file of it is meant for.
FILE_ROWS = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label the smallest node reachable.

    By contraction: in a round every node moves to the first, in an order drawn anew by hash, of itself and its neighbours, and
    the edges follow; nodes that meet are one from then on. A round leaves under half of the nodes, and a star needs two, a pair
    one. Then the moves are followed from the last round back, and each end gets the smallest of its nodes. Tables are written in
    as few files as their rows need; only numbers of edges reach the driver. Null ends are left out.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    edges = stored(edges.distinct())
    moves: list[DataFrame] = []
    while n := edges.count():
        files = 1 + n // FILE_ROWS
        drawn = lambda c, k=len(moves): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("to"))
        ends = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min(drawn("b")).alias("first"))
        moved = stored(ends.select(F.col("a").alias("node"), F.least("first", drawn("a"))["to"].alias("to")).coalesce(files))
        moves.append(moved)
        side = F.broadcast(moved) if n <= BROADCAST_ROWS // 2 else moved  # no more nodes than two for each edge
        to = lambda c: side.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        both = edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        edges = stored(both.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct().coalesce(files))
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    ends = moves.pop().withColumnRenamed("to", "end")
    while moves:
        later = ends.withColumnRenamed("node", "to")
        ends = moves.pop().join(later, "to", "left").select("node", F.coalesce("end", "to").alias("end"))
    ends = stored(ends)
    least = ends.groupBy("end").agg(F.min("node").alias("label"))
    return ends.join(least, "end").select("node", "label")
