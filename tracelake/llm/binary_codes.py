"""Embedding near-dedup by binary codes of randomly rotated vectors.

Method.

* Equal vectors are one class from the start; only classes are compared.
* Index, for every class: the signs of its randomly rotated unit vector o (a code of one bit for each entry), and the stored
  correction factor <code, o>, with which <code, q> / <code, o> is an unbiased estimate of <o, q> for any unit vector q; and
  for its own use as q, its rotated entries in four bits each (rounded with a random offset, so unbiased too), their least and
  their step. An estimate is four counts of common bits.
* Confidence bound: over rotations, the estimate of a pair at the threshold spreads by
  sqrt((1 - f**2) (1 - t**2) / (f**2 (d - 1)) + step**2 / (12 f**2)), f the factor and t the threshold. Pairs whose estimate lies
  more than SPREADS of it below the threshold are dismissed (at most one pair in 30,000 that should link, fewer above it); all
  others are recomputed exactly in double precision, and only those at or above the threshold link.
* Candidates: BANDS keys of BITS signs each of more rotated directions. A pair at angle a shares a key with probability
  1 - (1 - (1 - a / pi) ** BITS) ** BANDS, which is 0.999 at the threshold. BITS follows the number of classes so that a
  key of vectors without structure holds about FILL of them; BANDS follows BITS. So work grows little more than the table.
* A key with more than BLOCK classes is cut into blocks by hash, and each two of its blocks are a task's group, so no key is
  one task's, and no pair leaves a group: it gives each class its number of links, counted in the first key that a pair shares,
  and a spanning forest of the links for the components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.ann_curves import usable
from tracelake.llm.common import BROADCAST_ROWS, components, stored

FILL = 256
MISS = 1e-3  # probability of sharing no key at the threshold
BLOCK = 1024
SPREADS = 4.0
FEWEST = 8  # entries below which no bound is used: every candidate is recomputed
PLANES = 4
SEED = 20250117


def plan(classes: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of keys for so many classes."""
    bits = min(60, max(4, math.ceil(math.log2(max(classes, 1) / FILL))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-share)))


def rotation(d: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, from the size and a number alone."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d, number]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny entries would not be finite or not be above zero
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """Codes of unit vectors: signs, factor; and four-bit entries as planes, least and step."""

    def __init__(self, signs: np.ndarray, factor: np.ndarray, planes: np.ndarray, least: np.ndarray, step: np.ndarray, d: int):
        self.signs, self.factor, self.planes, self.least, self.step, self.d = signs, factor, planes, least, step, d

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        d = unit.shape[1]
        turned = unit @ rotation(d, 0)
        least = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - least) / ((1 << PLANES) - 1), 1e-300)
        offset = np.random.default_rng([SEED, d, 1 << 20]).random(d)
        level = np.clip(np.floor((turned - least[:, None]) / step[:, None] + offset), 0, (1 << PLANES) - 1).astype(np.uint8)
        planes = np.stack([_packed(level >> p & 1) for p in range(PLANES)], axis=1)
        return cls(_packed(turned > 0), np.abs(turned).sum(axis=1) / math.sqrt(d), planes, least, step, d)

    def estimates(self, other: Codes) -> np.ndarray:
        """Estimated cosine of each of these (by code) with each of other (by four-bit entries)."""
        total = np.zeros((len(self.factor), len(other.factor)))
        for p in range(PLANES):
            for w in range(self.signs.shape[1]):
                total += np.bitwise_count(self.signs[:, None, w] & other.planes[None, :, p, w]) * float(1 << p)
        ones = np.bitwise_count(self.signs).sum(axis=1, dtype=float)
        whole = sum(np.bitwise_count(other.planes[:, p]).sum(axis=1, dtype=float) * (1 << p) for p in range(PLANES))
        dot = other.step * (2 * total - whole) + np.outer(2 * ones - self.d, other.least)
        return dot / (math.sqrt(self.d) * self.factor[:, None])

    def spread(self, other: Codes, threshold: float) -> np.ndarray:
        """Standard deviation of the estimates of pairs at the threshold."""
        f = self.factor[:, None] ** 2
        return np.sqrt(np.maximum(1 - f, 0) * (1 - threshold**2) / (f * max(1, self.d - 1)) + other.step**2 / (12 * f))

    def possible(self, other: Codes, threshold: float) -> np.ndarray:
        """Pairs whose upper bound reaches the threshold."""
        if self.d < FEWEST:
            return np.ones((len(self.factor), len(other.factor)), bool)
        return self.estimates(other) + SPREADS * self.spread(other, threshold) >= threshold


def band_keys(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Keys (rows x bands) of signs along random directions, orthogonal in groups."""
    d = unit.shape[1]
    signs = np.hstack([unit @ rotation(d, 1 + k) > 0 for k in range(-(-bits * bands // d))])[:, : bits * bands]
    return signs.reshape(len(unit), bands, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _index(plans: dict[int, tuple[int, int]]):
    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            size = column.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                unit = _unit(_matrix(column.take(pa.array(at))))
                code = Codes.of(unit)
                keys = band_keys(unit, *plans[int(d)])
                binary = lambda words: pa.array([x.tobytes() for x in words], pa.binary())
                yield pa.record_batch({
                    "node": batch.column("node").take(pa.array(at)), "copies": batch.column("copies").take(pa.array(at)), "d": pa.array(np.full(len(at), int(d), np.int32)), "vector": column.take(pa.array(at)),
                    "signs": binary(code.signs), "factor": pa.array(code.factor), "planes": binary(code.planes), "least": pa.array(code.least), "step": pa.array(code.step),
                    "keys": pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel())),
                })

    return run


def cosines(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of row u[i] of x with row v[i] of y, both of length one, in double precision."""
    rows, columns = np.unique(u), np.unique(v)
    if len(rows) * len(columns) <= 8 * len(u):  # most pairs of a group are asked
        return (x[rows] @ y[columns].T)[np.searchsorted(rows, u), np.searchsorted(columns, v)]
    step = max(1, (1 << 22) // x.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", x[u[a : a + step]], y[v[a : a + step]]) for a in range(0, len(u), step)])


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For n rows and their links the smallest row that each is connected with."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], least)
        np.minimum.at(new, root[v], least)
        while (up := new[new] != new).any():
            new[up] = new[new[up]]
        if (new == root).all():
            return root
        root = new


def _block(threshold: float):
    """Links within a group: of two blocks of a key (i, j), or of one (i = j)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        number = lambda c: group.column(c).to_numpy()
        node, copies, side, d = number("node"), number("copies"), number("side"), int(group.column("d")[0].as_py())
        band, i, j = (int(group.column(c)[0].as_py()) for c in ("band", "i", "j"))
        rows, columns = np.flatnonzero(side == i), np.flatnonzero(side == j)
        none = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        if not len(rows) or not len(columns) or len(node) < 2:
            return none
        words = -(-d // 64)
        joined = lambda c, shape: np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint64).reshape(-1, *shape)
        code = Codes(joined("signs", (words,)), number("factor"), joined("planes", (PLANES, words)), number("least"), number("step"), d)
        part = lambda at: Codes(code.signs[at], code.factor[at], code.planes[at], code.least[at], code.step[at], d)
        u, v = np.nonzero(part(rows).possible(part(columns), threshold))
        u, v = rows[u], columns[v]
        if i == j:
            u, v = u[u < v], v[u < v]
        keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        step = max(1, (1 << 22) // keys.shape[1])
        first = np.concatenate([(keys[u[a : a + step]] == keys[v[a : a + step]]).argmax(axis=1) for a in range(0, len(u), step)] or [np.empty(0, int)])
        u, v = u[first == band], v[first == band]  # other keys that a pair shares leave it to its first
        if not len(u):
            return none
        unit = _unit(_matrix(group.column("vector")))
        near = cosines(unit, unit, u, v) >= threshold
        u, v = u[near], v[near]
        links = np.bincount(u, copies[v], len(node)) + np.bincount(v, copies[u], len(node))
        some = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[some]), "links": pa.array(links[some].astype(np.int64)), "other": pa.array(node[_forest(len(node), u, v)[some]])})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """A row for each row of vectors: vec_id, n_links, component_id, kept.

    n_links counts the other rows at cosine threshold or more; component_id is the smallest id reachable by links; kept is
    whether it is the row's own. Vectors that are null, empty or zero or hold null or non-finite entries, and those of different
    sizes, link with nothing. Rows that repeat an id are vectors of their own. A row without an id links with nothing, has no
    component and is not kept.
    """
    kind = "array<float>" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(kind).alias("vector"))
    rows = rows.withColumn("vector", F.when(F.col("vec_id").isNotNull() & usable(F.col("vector")), F.col("vector")))
    good = rows.where("vector is not null")
    classes = good.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    plans = {d: plan(n, threshold) for d, n in sizes.items()}
    index = "node long, copies long, d int, vector %s, signs binary, factor double, planes binary, least double, step double, keys array<long>" % kind
    indexed = stored(classes.mapInArrow(_index(plans), index))
    hot = stored(indexed.select("d", F.posexplode("keys").alias("band", "key")).groupBy("d", "band", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    spread = indexed.select("*", F.posexplode("keys").alias("band", "key")).join(hot, ["d", "band", "key"], "left")
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    spread = spread.withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("n")
    spread = spread.withColumn("i", F.least("side", "with")).withColumn("j", F.greatest("side", "with")).drop("with")
    found = spread.groupBy("d", "band", "key", "i", "j").applyInArrow(_block(threshold), "node long, links long, other long")
    found = stored(found)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = classes.select("node", "rep").join(labels, "node")
    linked = stored(linked.select("node", "rep", "label"))
    least = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = linked.join(least, "label").select("node", "component_id")
    some = classes.join(counts, "node", "left").join(linked, "node", "left").where("copies > 1 or links is not null")
    some = stored(some.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")))
    if some.count() * max(sizes, default=1) * 8 <= BROADCAST_ROWS * 8:
        some = F.broadcast(some)
    out = rows.join(some, "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
