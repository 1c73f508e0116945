"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors are one class from the start, represented by its smallest id. Each of CURVES orderings projects the
normalised vectors on DIMS random orthogonal directions, shifts them by a random part of a cell, and takes the
place of the cell on a Hilbert curve as key. Spark range-partitions the keys and sorts them; the ranks within a
curve cut it into blocks of neighbouring keys, so that no block grows, however many keys are equal. A query is
compared with all blocks within its window, by exact cosine in double precision; the blocks' best are merged over
the curves, and the classes found are expanded to ids again.

The window is fitted to the table: for PROBES vectors (those first by hash) the exact neighbours are found by one
scan, and the window is the rank distance within which RECALL of them lie on at least one curve, WINDOW at least.
So a table of any size or kind has that recall, within the error of the probes, and pays for it in work: where
vectors have clusters the window stays small; without any structure it is a share of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import stored

CURVES = 24
DIMS = 12
BITS = 4
WINDOW = 256
BLOCK = 8192  # rows of a block at most; a wider window takes more blocks
PROBES = 100
RECALL = 0.96
SALTS = 32
SCORES = 1 << 21  # scores held at once
MARGIN = 1e-9  # more than rounding can move a score


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (n x d integers below 2**bits); d * bits is at most 62.

    Gray-code descent, one level of all rows at a time: at each level the cell's corner is turned into the frame of
    the current subcube (an entry corner and a direction), ranked by its Gray code, and the frame moves on.
    """
    n, d = cells.shape
    key = np.zeros(n, np.int64)
    entry, turn = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = (1 << d) - 1
    weights = np.int64(1) << np.arange(d, dtype=np.int64)

    def rotate_right(x, k):
        return ((x >> k) | (x << (d - k))) & full

    for level in range(bits - 1, -1, -1):
        corner = ((cells >> level) & 1) @ weights
        local = rotate_right(corner ^ entry, (turn + 1) % d)
        rank = local.copy()  # inverse Gray code
        step = 1
        while step < d:
            rank ^= rank >> step
            step *= 2
        key = (key << d) | rank
        # Entry corner and direction of the subcube with this rank.
        before = np.where(rank > 0, ((rank - 1) // 2) * 2, 0)
        start = np.where(rank > 0, before ^ (before >> 1), 0)
        odd = np.where(rank % 2 == 0, rank - 1, rank)
        ones = np.zeros(n, np.int64)  # trailing ones of odd
        rest = np.maximum(odd, 0)
        while (more := (rest & 1) == 1).any():
            ones += more
            rest = np.where(more, rest >> 1, 0)
        move = np.where(rank == 0, 0, ones % d)
        back = (turn + 1) % d
        entry ^= ((start << back) | (start >> (d - back))) & full
        turn = (turn + move + 1) % d
    return key


def _curve(number: int, size: int, dims: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shift of a curve for vectors of this size, from its number alone."""
    r = np.random.default_rng([20240611, number, size])
    q, _ = np.linalg.qr(r.standard_normal((size, min(dims, size))))
    return q, r.random(q.shape[1])


def usable(vector):
    """Neither null, empty nor zero, and all components finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _classes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (rep, vector) and their k + 1 smallest ids (rep, vec_id); a large class is cut in two steps."""
    rows = rows.withColumn("h", F.xxhash64("vector"))
    salted = Window.partitionBy("h", "vector", "salt").orderBy("vec_id")
    whole = Window.partitionBy("h", "vector").orderBy("vec_id")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= k + 1).withColumn("rep", F.min("vec_id").over(Window.partitionBy("h", "vector")))
    few = stored(few.select("rep", "vec_id", "n", F.when(F.col("n") == 1, F.col("vector")).alias("vector")))
    return few.where("n = 1").select("rep", "vector"), few.select("rep", "vec_id")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of one length, in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of rows u[i] and v[i] of x: sums over the entries in their order, so that it does not depend on the company; 1 at most."""
    out = np.empty(len(u))
    squares = np.zeros(len(x))
    for j in range(x.shape[1]):
        squares += x[:, j] * x[:, j]
    size = np.sqrt(squares)
    for a in range(0, len(u), SCORES):
        i, m = u[a : a + SCORES], v[a : a + SCORES]
        dot = np.zeros(len(i))
        for j in range(x.shape[1]):
            dot += x[i, j] * x[m, j]
        out[a : a + SCORES] = dot / (size[i] * size[m])
    return np.minimum(out, 1.0)


def fitted_window(classes: DataFrame, places: DataFrame, k: int, probes: int = PROBES, recall: float = RECALL) -> int:
    """Rank distance within which a share of recall of the probes' k nearest classes lie on some curve.

    classes: rep, vector. places: curve, rep, place. The probes are a bounded number of rows, compared with all rows.
    """
    some = classes.orderBy(F.xxhash64("rep"), "rep").limit(probes).collect()
    by_size: dict[int, list] = {}
    for r in some:
        by_size.setdefault(len(r["vector"]), []).append(r)
    held = {d: (np.array([r["rep"] for r in rows]), _unit(np.array([r["vector"] for r in rows], np.float64))) for d, rows in by_size.items()}

    def best(batches):
        for batch in batches:
            size = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for d, (ids, q) in held.items():
                part = batch.filter(pa.array(size == d))
                if part.num_rows:
                    rep = part.column("rep").to_numpy(zero_copy_only=False)
                    score = np.where(ids[:, None] == rep, -np.inf, q @ _unit(_matrix(part.column("vector"))).T)
                    n = min(k, len(rep))
                    at = np.argpartition(-score, n - 1, axis=1)[:, :n]
                    yield pa.record_batch({"probe": pa.array(np.repeat(ids, n)), "rep": pa.array(rep[at].ravel()), "score": pa.array(np.take_along_axis(score, at, axis=1).ravel())})

    found = classes.mapInArrow(best, "probe long, rep long, score double").where(F.col("score") > -2)
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "rep")
    pairs = stored(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("probe", "rep"))
    pairs = F.broadcast(pairs)  # probes * k rows at most
    mine = places.join(pairs, "rep").select("curve", "probe", "rep", "place")
    theirs = places.join(F.broadcast(pairs.select("probe").distinct()), F.col("rep") == F.col("probe")).select("curve", "probe", F.col("place").alias("own"))
    far = mine.join(theirs, ["curve", "probe"]).groupBy("probe", "rep").agg(F.min(F.abs(F.col("place") - F.col("own"))).alias("far"))
    return int(far.agg(F.percentile("far", F.lit(recall))).first()[0] or 0)


def nearest(vectors: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, window: int | None = None) -> DataFrame:
    """The k nearest rows found for each row that meets is_query, by cosine: query_id, rank, vec_id, score.

    Nearest first, ties to the smaller id; a query is no candidate of its own. Vectors that are null, zero, or hold
    a null or a component that is not finite take no part, nor do rows without an id; vectors of different sizes
    are searched apart. Rows that repeat an id count as one where the vectors are equal. With fewer candidates
    than k, all that are found are returned. Every row is indexed; only is_query limits the queries. window fixes
    the rank distance searched instead of fitting it.
    """
    kind = "array<float>" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(kind).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id", "vector").agg(F.max("ask").alias("ask"))
    classes, members = _classes(rows.select("vec_id", "vector"), k)
    asked = stored(rows.where("ask").select("vec_id", "vector").join(classes, "vector").select("vec_id", "rep"))
    queries = asked.select("rep").distinct().withColumn("ask", F.lit(True))

    def keys(batches):
        for batch in batches:
            size = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            reps = batch.column("rep").to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = _unit(_matrix(batch.column("vector").take(pa.array(at))))
                for c in range(curves):
                    q, shift = _curve(c, int(d), dims, bits)
                    cells = (x @ q * np.sqrt(d) / 6 + 0.5) * (1 << bits) + shift - 0.5
                    key = hilbert_keys(np.clip(np.floor(cells), 0, (1 << bits) - 1).astype(np.int64), bits)
                    yield pa.record_batch({"curve": pa.array(np.full(len(at), int(d) * 1000 + c, np.int64)), "key": pa.array(key), "rep": pa.array(reps[at])})

    parts = max(8, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["curve", "key", "rep"]
    ranked = classes.mapInArrow(keys, "curve long, key long, rep long").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = stored(ranked.select("curve", "rep", F.monotonically_increasing_id().alias("at")))
    # Rank within a curve: place in the partition, less the curve's first place there, plus what earlier partitions hold.
    part = F.shiftright("at", 33).alias("part")
    sums = ranked.groupBy("curve", part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")
    sums = sums.select("curve", "part", "first", earlier.alias("earlier"))
    places = ranked.withColumn("part", part).join(F.broadcast(sums), ["curve", "part"])  # curves times partitions
    places = stored(places.select("curve", "rep", (F.col("at") - F.col("first") + F.col("earlier")).alias("place")))
    wide = max(WINDOW, fitted_window(classes, places, k)) if window is None else window
    block = min(wide, BLOCK)
    reach = -(-wide // block)
    placed = places.select("curve", "rep", F.floor(F.col("place") / block).alias("block"))
    placed = placed.join(classes, "rep").join(queries, "rep", "left").select("curve", "block", "rep", "vector", F.coalesce("ask", F.lit(False)).alias("ask"))
    # A row lies in its own block; a query also asks in those within the window.
    beside = F.when(F.col("ask"), F.sequence(F.lit(-reach), F.lit(reach))).otherwise(F.array(F.lit(0)))
    spread = placed.withColumn("by", F.explode(beside)).select("curve", (F.col("block") + F.col("by")).alias("block"), "rep", "vector", "ask", (F.col("by") == 0).alias("there"))

    def search(group: pa.Table) -> pa.Table:
        rep = group.column("rep").to_numpy()
        there = group.column("there").to_numpy(zero_copy_only=False)
        ask = group.column("ask").to_numpy(zero_copy_only=False)
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if ask.any() and there.any():
            own = _matrix(group.column("vector"))
            x = _unit(own)
            t, q = np.flatnonzero(there), np.flatnonzero(ask)
            parts, step, n = [], max(1, SCORES // len(t)), min(k + 1, len(t))
            for a in range(0, len(q), step):
                score = x[q[a : a + step]] @ x[t].T
                # All that may be among the best but for rounding are scored by the measure itself, whose ties go to the smaller id.
                least = -np.partition(-score, n - 1, axis=1)[:, n - 1]
                u, v = np.nonzero(score >= least[:, None] - MARGIN)
                u, v = q[a : a + step][u], t[v]
                exact = cosines(own, u, v)
                order = np.lexsort((rep[v], -exact, rep[u]))
                u, v, exact = u[order], v[order], exact[order]
                new = np.r_[True, rep[u[1:]] != rep[u[:-1]]]
                place = np.arange(len(u)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                parts.append((rep[u[place < n]], rep[v[place < n]], exact[place < n]))
            out = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table({"query": out[0], "rep": out[1], "score": out[2]})

    found = spread.groupBy("curve", "block").applyInArrow(search, "query long, rep long, score double")
    found = found.groupBy("query", "rep").agg(F.max("score").alias("score"))  # the same wherever a pair met
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    found = stored(found.withColumn("n", best).where(F.col("n") <= k + 1).select("query", "rep", "score"))
    # Each query of a class, against the ids of the classes found.
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    pairs = asked.join(found, "query").join(members, "rep").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
