"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, and the groups they form.

Method: a global rare-first order of n-grams, prefix filtering on it, the length, positional and suffix
filters, a join on prefix n-grams, and one exact verification for each pair.

* Order: n-grams are hashed to 64 bits. A table of counts of fixed size (2**sketch_bits, summed over all
  documents) gives each its frequency class (four times the binary logarithm of its bucket's count); the order is
  (class, hash). Any total order is right for prefix filtering, this one puts frequent n-grams last.
* Prefix: of a set of n elements, the first n - ceil(t * n) + 1. Two sets of Jaccard t or more share one.
* Length filter: t * |x| <= |y|. Positional filter: 1 + min(rest of x, rest of y) must reach the overlap needed.
  Suffix filter: each set's counts in about as many hash ranges as it has elements; the sum of the smaller
  counts bounds the overlap closely, at a byte for an element, so few pairs that don't link reach verification.
  Before that, a bitmap of the parity of the counts in BITS hash ranges travels with the prefix n-grams: two sets
  differ in at least as many elements as their bitmaps differ in bits, which the join itself can test.
* Groups: only the components matter, so within one prefix n-gram every member is first compared with the most
  central member (most shared prefix n-grams). What those links join needs no further pair; of the rest, every
  pair in different components that shares a prefix n-gram and passes the filters is verified. The components
  are therefore exactly those of all pairs, without writing out all pairs of a group of near copies.

Exact copies (same words) are one class from the start and never multiply pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import BROADCAST_ROWS, anti_join_ids, components, semi_join_ids, stored

BITS = 512
CHUNK = 8192  # counts in one row of the sketch
SLICE_BYTES = 1 << 19  # text hashed at a time; a longer text is a slice of its own

_RANDOM = np.random.default_rng(20240607)
_TABLE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = []  # for slices of the usual size: 16 bytes for each byte of a slice


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each. Only tables of the usual size are kept."""
    if _powers and n <= len(_powers[0]):
        return _powers[0], _powers[1]
    size = max(n, 3 * SLICE_BYTES // 2)
    out = []
    for step in (_BASE, _INVERSE):
        p = np.full(size, step, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size == 3 * SLICE_BYTES // 2:
        _powers[:] = out
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def normalized(text: str | None) -> bytes:
    """Words with A-Z in lower case, one space between them. bytes.split() splits at exactly \\x20\\x09-\\x0D."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingle_hashes(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each normalized text the hashes of its word n-grams in order; a text of fewer words is one n-gram."""
    used = [t for t in texts if t]
    out: list[np.ndarray] = []
    if used:
        buf = np.frombuffer(b" ".join(used), np.uint8)
        power, inverse = _power_tables(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * power[: len(buf)], out=sums[1:])
        gaps = np.flatnonzero(buf == 32)
        start = np.concatenate(([0], gaps + 1))
        end = np.concatenate((gaps, [len(buf)]))
        size = np.fromiter((t.count(b" ") + 1 for t in used), np.int64, len(used))
        first = np.cumsum(size) - size
        for a, k in zip(first.tolist(), size.tolist(), strict=True):
            m = max(1, k - n + 1)
            s, e = start[a : a + m], end[a + min(n, k) - 1 : a + min(n, k) - 1 + m]
            out.append(_mix((sums[e] - sums[s]) * inverse[s]))
    found = iter(out)
    return [next(found) if t else np.empty(0, np.uint64) for t in texts]


def slices(batches, text_column: str):
    """(batch slice, normalized texts) with about SLICE_BYTES of text at a time."""
    for batch in batches:
        texts = batch.column(text_column)
        a, held, size = 0, [], 0
        for i in range(batch.num_rows):
            held.append(normalized(texts[i].as_py()))
            size += len(held[-1])
            if size >= SLICE_BYTES:
                yield batch.slice(a, i + 1 - a), held
                a, held, size = i + 1, [], 0
        if held:
            yield batch.slice(a), held


def _frequency_classes(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """Frequency class of every bucket; the table has 2**bits entries whatever the input's size."""
    shift = np.uint64(64 - bits)

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for _, texts in slices(batches, "text"):
            h = shingle_hashes(texts, n)
            total += np.bincount((np.concatenate(h) >> shift).astype(np.int64), minlength=1 << bits)
        if total.any():
            yield pa.record_batch({"chunk": pa.array(range(len(total) // CHUNK), pa.int32()), "counts": pa.array([c.tobytes() for c in total.astype(np.uint32).reshape(-1, CHUNK)], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.uint32).astype(np.int64)
        if sums:
            yield pa.record_batch({"chunk": pa.array(sums.keys(), pa.int32()), "counts": pa.array([np.asarray(c, np.int64).tobytes() for c in sums.values()], pa.binary())})

    schema = "chunk int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect()
    total = np.zeros((1 << bits) // CHUNK * CHUNK, np.int64).reshape(-1, CHUNK)
    for r in rows:
        total[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return (4 * np.log2(total.ravel() + 1)).astype(np.uint8)


def _signatures(docs: DataFrame, classes: np.ndarray, n: int, percent: int, bits: int) -> DataFrame:
    """doc_id, key of its words, set size, prefix in the global order, and bitmap of parities."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    shift = np.uint64(64 - bits)

    def run(batches):
        klass = shared.value
        for batch, texts in slices(batches, "text"):
            keys, sizes, prefixes, bitmaps = [], [], [], []
            for t, h in zip(texts, shingle_hashes(texts, n), strict=True):
                h = np.unique(h)
                k = len(h)
                if k:
                    order = (klass[(h >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                    p = k - (percent * k + 99) // 100 + 1
                    first = np.argpartition(order, p - 1)[:p] if p < k else np.arange(k)
                    first = first[np.argsort(order[first], kind="stable")]
                    prefixes.append(h[first].view(np.int64))
                else:
                    prefixes.append(np.empty(0, np.int64))
                parity = np.bincount((h % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
                bitmaps.append(np.packbits(parity.astype(bool)).view(np.int64))
                keys.append(hashlib.blake2b(t, digest_size=16).digest())
                sizes.append(k)
            ends = np.cumsum([0, *map(len, prefixes)])
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "node": batch.column("node"), "key": pa.array(keys, pa.binary()), "n_shingles": pa.array(sizes, pa.int64()),
                "bitmap": pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * (BITS // 64), pa.int32()), pa.array(np.concatenate(bitmaps))),
                "prefix": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes))),
            })

    return docs.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node long, key binary, n_shingles long, bitmap array<long>, prefix array<long>")


def _overlap_needed(percent: int):
    """Smallest overlap of sets of na and nb elements that reaches the threshold."""
    return F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))


def _range_counts(h: np.ndarray) -> np.ndarray:
    """Counts of distinct hashes in a power of two of ranges, a half to all of their number."""
    bits = max(5, len(h).bit_length() - 1)
    return np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def _of_docs(docs: DataFrame, ids: DataFrame, make, column: str) -> DataFrame:
    """(node, column): make(normalized texts) of the docs whose node is in the stored ids."""

    def run(batches):
        for batch, texts in slices(batches, "text"):
            yield pa.record_batch({"node": batch.column("node"), column: pa.array(make(texts), pa.binary())})

    return semi_join_ids(docs, ids, "node").select("node", "text").mapInArrow(run, f"node long, {column} binary")


def _ids_of(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())


def _verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of stored distinct pairs (a, b, na, nb), those that link. docs: node, text.

    Counts by hash range are made for all nodes of the pairs; words, which are many times larger, only for the
    nodes of the pairs that the suffix filter leaves. Each of these is looked at once.
    """

    def suffix_filter(batches):
        for batch in batches:
            keep = []
            for x, y, k in zip(batch.column("ranges_a").to_pylist(), batch.column("ranges_b").to_pylist(), batch.column("need").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
                while len(u) > len(v):
                    u = u.reshape(-1, 2).sum(axis=1)
                while len(v) > len(u):
                    v = v.reshape(-1, 2).sum(axis=1)
                keep.append(int(np.minimum(u, v).sum()) >= k)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("words_a"), batch.column("words_b"), strict=True):
                u, v = (np.unique(h) for h in shingle_hashes([x.as_py(), y.as_py()], n))
                same = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(same * (100 + percent) >= percent * (len(u) + len(v)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def ranges(texts):
        return [_range_counts(np.unique(h)).astype(np.uint16).tobytes() for h in shingle_hashes(texts, n)]

    def both(rows: DataFrame, held: DataFrame, column: str) -> DataFrame:
        side = lambda k: held.select(F.col("node").alias(k), F.col(column).alias(f"{column}_{k}"))
        return rows.join(side("a"), "a").join(side("b"), "b")

    need = pairs.select("a", "b", _overlap_needed(percent).cast("long").alias("need"))
    counted = both(need, stored(_of_docs(docs, _ids_of(pairs), ranges, "ranges")), "ranges")
    left = stored(counted.select("a", "b", "need", "ranges_a", "ranges_b").mapInArrow(suffix_filter, "a long, b long"))
    worded = both(left, _of_docs(docs, _ids_of(left), list, "words"), "words")
    return worded.select("a", "b", "words_a", "words_b").mapInArrow(verify, "a long, b long")


def ngram_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = 3, percent: int = 90, sketch_bits: int = 20) -> DataFrame:
    """Documents linked when 100 * |intersection| >= percent * |union| of their word n-gram sets.

    Returns doc_id, n_shingles, component_id and is_kept (one document of each component: the smallest id),
    one row for each row of docs. Text that is null or has no word has an empty set and links with nothing.
    Rows that repeat a doc_id are one document with several texts: what any of them links with is in its group.
    A null doc_id joins no group and has a null component. Very long texts are taken whole. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    # A node is a text: its doc_id, or for ids that repeat a number of its own, from the least upwards.
    twice = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    repeated = twice.count()
    docs = docs.withColumn("node", F.col("doc_id"))
    if repeated:
        again = (F.broadcast(twice) if repeated <= BROADCAST_ROWS else twice).withColumn("again", F.lit(True))
        docs = docs.join(again, "doc_id", "left")
        docs = stored(docs.select("doc_id", "text", F.when(F.col("again"), F.monotonically_increasing_id() + F.lit(-(2**63))).otherwise(F.col("node")).alias("node")))
    classes = _frequency_classes(docs, n, sketch_bits)
    rows = stored(_signatures(docs, classes, n, percent, sketch_bits))
    known = rows.where("doc_id is not null and n_shingles > 0")
    groups = stored(known.groupBy("key").agg(F.min("node").alias("node"), F.count("*").alias("copies")))
    copies = known.select("key", F.col("node").alias("own")).join(groups.where("copies > 1"), "key").where("own <> node")
    nodes = anti_join_ids(known, stored(copies.select(F.col("own").alias("node")).distinct()), "node").select("node", "n_shingles", "bitmap", "prefix")

    # Prefix n-grams that at least two classes hold. Size and place share a column, for narrower rows.
    by_gram = Window.partitionBy("gram")
    postings = nodes.select("node", "n_shingles", F.posexplode("prefix").alias("pos", "gram"))
    postings = postings.select("gram", "node", (F.shiftleft("n_shingles", 32) + F.col("pos")).alias("packed"))
    postings = postings.withColumn("held", F.count("*").over(by_gram)).where("held > 1")
    unpacked = {"n_shingles": F.shiftright("packed", 32), "pos": F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF))}
    postings = stored(postings.withColumns(unpacked).select("gram", "node", "n_shingles", "pos"))
    # The most central member has the fewest prefix n-grams that it alone holds.
    prefix = F.col("n_shingles") - F.floor((F.col("n_shingles") * percent + 99) / 100) + 1
    shared = postings.groupBy("node", "n_shingles").agg((prefix - F.count("*")).alias("alone"))
    postings = stored(postings.join(shared, ["node", "n_shingles"]))

    def candidates(found: DataFrame) -> DataFrame:
        """Length and positional filter on pairs (x, y, nx, ny, ix, iy); the distinct pairs left, a < b."""
        swap = F.col("x") > F.col("y")
        found = found.withColumns({"na": F.col("nx"), "nb": F.col("ny")})
        need = _overlap_needed(percent)
        found = found.where(
            (F.col("nx") * percent <= F.col("ny") * 100) & (F.col("ny") * percent <= F.col("nx") * 100)
            & (F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) + F.least("ix", "iy") >= need)
        )
        pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
        return found.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("nx", "ny").alias("na"), pick("ny", "nx").alias("nb")).distinct()

    # First every member against the most central one of its n-gram.
    center = F.min(F.struct("alone", "node", "n_shingles", "pos")).over(by_gram)
    star = postings.withColumn("c", center).where("c.node <> node")
    star = star.select(F.col("c.node").alias("x"), F.col("node").alias("y"), F.col("c.n_shingles").alias("nx"), F.col("n_shingles").alias("ny"), F.col("c.pos").alias("ix"), F.col("pos").alias("iy"))
    tested = stored(candidates(star))
    texts = docs.select("node", "text")
    links = stored(_verified(texts, tested, n, percent))
    labels = components(links)

    # Then what may still join different components.
    label = F.coalesce("label", "node")
    open_ = postings.join(labels, "node", "left").withColumn("label", label)
    open_ = stored(open_.withColumn("many", F.min("label").over(by_gram) != F.max("label").over(by_gram)).where("many").select("gram", "node", "n_shingles", "pos", "label"))
    bits = [F.get("bitmap", F.lit(k)).alias(f"m{k}") for k in range(BITS // 64)]
    open_ = open_.join(nodes.select("node", *bits), "node")
    side = lambda p: open_.select("gram", *(F.col(c).alias(f"{p}_{c}") for c in open_.columns if c != "gram"))
    x, y = side("x"), side("y")
    total = F.col("x_n_shingles") + F.col("y_n_shingles")
    need = F.ceil(F.lit(percent) * total / F.lit(100 + percent))
    apart = sum((F.bit_count(F.col(f"x_m{k}").bitwiseXOR(F.col(f"y_m{k}"))) for k in range(BITS // 64)), F.lit(0))
    near = (F.col("x_n_shingles") * percent <= F.col("y_n_shingles") * 100) & (F.col("y_n_shingles") * percent <= F.col("x_n_shingles") * 100)
    other = (F.col("x_node") < F.col("y_node")) & (F.col("x_label") != F.col("y_label"))
    rest = x.join(y, (x["gram"] == y["gram"]) & other & near & (apart <= total - 2 * need))
    named = {"node": "", "n_shingles": "n", "pos": "i"}
    rest = rest.select(*(F.col(f"{p}_{c}").alias(f"{v}{p}") for p in "xy" for c, v in named.items()))
    rest = stored(candidates(rest).join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    links = links.union(_verified(texts, rest, n, percent))

    if repeated:  # the texts of one doc_id belong together
        own = known.join(again, "doc_id").join(groups.withColumnRenamed("node", "a"), "key").select("doc_id", "a")
        links = links.union(own.join(own.groupBy("doc_id").agg(F.min("a").alias("b")), "doc_id").select("a", "b"))
    labels = components(links)

    # Links between nodes, then the class of each row.
    final = groups.join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("component_id"))
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    keyed = rows.select("doc_id", "key", "n_shingles")
    hot = keyed.where("n_shingles > 0 and doc_id is not null").join(final, "key").select("doc_id", "n_shingles", "component_id")
    if repeated:  # a label may be the number of a text
        hot = stored(hot)
        least = hot.groupBy("component_id").agg(F.min("doc_id").alias("least"))
        hot = hot.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    rest = keyed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", alone.alias("component_id"))
    return hot.union(rest).withColumn("is_kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs of which ngram_join keeps the document: one of each group of near copies.

    Of rows that repeat a doc_id the one with the smallest text stays. Rows without an id all stay.
    """
    gone = ngram_join(docs, **options).where("not is_kept").select("doc_id").distinct()
    left = anti_join_ids(docs, stored(gone), "doc_id")
    twice = stored(left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not twice.limit(1).count():
        return left
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    one = semi_join_ids(left, twice, "doc_id").select(F.struct(*left.columns).alias("row"), number.alias("number")).where("number = 1").select("row.*")
    return anti_join_ids(left, twice, "doc_id").unionByName(one)
