"""Line dedup: near copies of lines over all documents, of which each group keeps one.

Method, in DataFrame functions only. A shingle is a run of SHINGLE UTF-16 units of a line.

* Lines are told apart by two 64-bit hashes; equal lines are one class from the start.
* Signature of a line of over RING characters: MinHash with one permutation. Each shingle's hash falls into one of
  BANDS * ROWS bins, and a bin keeps its smallest hash; ROWS bins make a band. Two lines of Jaccard similarity s share a
  band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.997 at 0.8, 0.9998 at 0.87. The shingles are exploded, hashed and
  folded into their bins as plain columns in the task that has their line; equal lines are made one before. Of a long line
  only hashes small enough to be a minimum are folded: below a bound that leaves FULL for each bin on average. A bin
  that gets none (probability exp(-FULL) = 0.0003) counts as empty; the chance of sharing a band falls by under 0.0005.
* Lines of up to 1.25 * RING characters have too few shingles for as many bins. Their hashes are sorted into a ring; each
  of RING_BANDS fixed points of it gives a band: the RING_ROWS hashes that follow it. Points with no hash before the next
  point give that point's band again, which is written once. Lines in between have both kinds, since a near copy may be
  longer. (Only a line that repeats itself can be a near copy of one much shorter; that pair is not found across RING.)
* Lines of at most SHORT shingles are banded exactly: of n shingles a line shares m = ceil(0.8 n) or more with any near
  copy, so the two smallest hashes shared are among its n - m + 2 smallest; each two of these make a band. Lines just
  under SHORT have both kinds.
* Banding: lines that share a band are candidates. Each is compared with the band's most common line; then, after the links
  found so are joined, whatever shares a band across two components is compared too. So the groups are those of all
  candidate pairs, without writing out the pairs of a large group.
* Before verification, a bitmap of the parities of a line's shingles in BITS hash ranges: two sets differ in at least as
  many shingles as their bitmaps differ in bits, so most pairs that are not near copies never meet as texts.
* Verification: Jaccard similarity of the sets of all shingles (by 64-bit hash) of the two lines.
* Distributed union-find joins the links; of each component the line of the smallest (doc_id, line number) stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import BROADCAST_ROWS, components, semi_join_ids, stored

SHINGLE = 8
RING = 48  # characters
BANDS = 8  # a power of two
ROWS = 3
FULL = 8  # hashes that a bin gets on average of those looked at
RING_BANDS = 12
RING_ROWS = 4
SHORT = 24
PERCENT = 80
TASK_LINES = 2000  # lines whose shingles one task tells apart
BITS = 1024  # enough to tell 0.77 from 0.8 for lines of 600 characters

_SHINGLES = "(?s)(?=(.{%d}))" % SHINGLE
_WORD = r"[^\x20\x09-\x0D]"


#: What tells a line's place: a row is its doc_id and its text's hash t, so rows that share an id stay apart.
_PLACE = ["doc_id", "n", "t"]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n, t, line) of the lines with a word, n from 0; documents without id are left out."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike(_WORD))


def _shingles(line):
    """Distinct hashes of a line's shingles; a line shorter than a shingle is one."""
    hashed = F.transform(F.regexp_extract_all(line, F.lit(_SHINGLES), F.lit(1)), lambda s: F.xxhash64(F.encode(s, "UTF-16BE")))
    return F.when(F.char_length(line) < SHINGLE, F.array(F.xxhash64(F.encode(line, "UTF-16BE")))).otherwise(F.array_distinct(hashed))


def _exploded(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, x): the hash of every shingle of the lines, a row each, repeated ones too. All of it is generated code."""
    units = F.octet_length("units") / 2
    lines = lines.select(*keys, F.encode("line", "UTF-16BE").alias("units"))
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), (units - SHINGLE).cast("int")))
    return lines.select(*keys, "units", F.explode(places).alias("i")).select(*keys, F.xxhash64(F.substr("units", F.col("i") * 2 + 1, F.lit(2 * SHINGLE))).alias("x"))


def _long_bands(lines: DataFrame) -> DataFrame:
    """(h, band) of lines of over RING characters. They are dealt out by h, so their minima need not be."""
    bound = (F.lit(FULL * BANDS * ROWS << 44) / F.char_length("line")).cast("long")
    lines = lines.where(F.char_length("line") > RING).select(F.xxhash64("line").alias("h"), "line").dropDuplicates(["h"])
    rows = _exploded(lines.select("h", bound.alias("bound"), "line"), "h", "bound")
    rows = rows.where(F.shiftrightunsigned("x", 20) < F.col("bound"))
    row = F.shiftright(F.shiftright("x", 3).bitwiseAND(F.lit(0xFFFF)) * ROWS, 16)
    rows = rows.select("h", F.col("x").bitwiseAND(F.lit(BANDS - 1)).alias("b"), row.alias("r"), F.shiftrightunsigned("x", 20).alias("v"))
    minima = [F.min(F.when(F.col("r") == k, F.col("v"))).alias(f"v{k}") for k in range(ROWS)]
    return rows.groupBy("h", "b").agg(*minima).select("h", F.xxhash64("b", *(F.coalesce(f"v{k}", F.lit(-1)) for k in range(ROWS))).alias("band"))


def _ring_bands(lines: DataFrame, percent: int) -> DataFrame:
    """(h, band) of lines of up to 1.25 * RING characters. Short lines' bands hold any near copy if percent is over 50."""
    lines = lines.where(F.char_length("line") <= RING * 100 // percent).select(F.xxhash64("line").alias("h"), "line")
    lines = lines.withColumn("s", F.sort_array(_shingles(F.col("line")))).withColumn("n_s", F.size("s"))
    n = F.col("n_s")
    # Where on the ring of hashes each point's next hash stands: the first hash of each of RING_BANDS ranges.
    part = lambda i: F.shiftright(F.shiftrightunsigned(F.element_at("s", i), 32) * RING_BANDS, 32)
    first = F.filter(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, True).otherwise(part(i) != part(F.greatest(i - 1, F.lit(1)))))
    lines = lines.withColumn("first", F.when(n * 100 > SHORT * percent, first)).withColumn("ring", F.when(F.col("first").isNotNull(), F.concat("s", F.slice("s", 1, RING_ROWS - 1))))
    long = F.transform("first", lambda i: F.xxhash64(F.slice("ring", i, RING_ROWS)))
    few = F.slice("s", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 2)
    lines = lines.withColumn("few", F.when(n <= SHORT, few))
    two = F.flatten(F.transform("few", lambda x, i: F.transform(F.slice("few", i + 2, SHORT), lambda y: F.xxhash64(x, y))))
    short = F.when(n == 1, F.transform("s", lambda x: F.xxhash64(x))).otherwise(two)
    none = F.array().cast("array<bigint>")
    return lines.select("h", F.explode(F.array_distinct(F.concat(F.coalesce(long, none), F.coalesce(short, none)))).alias("band"))


def _candidates(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (id, line) and bitmaps (id, size, m0, m1, ...) of the lines of wanted (id and place).

    Dealing out the texts by id serves all the groupings, so no shingle is shuffled. TASK_LINES keep a task's shingles in memory.
    """
    n = wanted.count()
    side = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
    texts = _lines(docs).join(side, _PLACE).where(F.xxhash64("line") == F.col("id"))
    texts = stored(texts.select("id", "line").dropDuplicates(["id"]))
    word = F.shiftright("x", 6).bitwiseAND(F.lit(BITS // 64 - 1)).cast("int").alias("w")
    shingles = _exploded(texts.repartition(1 + n // TASK_LINES, "id"), "id").groupBy("id", "x").agg(F.lit(1).alias("one"))
    parts = shingles.groupBy("id", word).agg(F.count("*").alias("k"), F.bit_xor(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits"))
    marks = [F.coalesce(F.max(F.when(F.col("w") == k, F.col("bits"))), F.lit(0)).alias(f"m{k}") for k in range(BITS // 64)]
    return texts, stored(parts.groupBy("id").agg(F.sum("k").alias("size"), *marks))


def _may_link(x: str, y: str, percent: int):
    """Whether the sizes and bitmaps of two sides, their columns named with the prefixes x and y, allow a link."""
    nx, ny = F.col(f"{x}size"), F.col(f"{y}size")
    need = F.ceil(F.lit(percent) * (nx + ny) / F.lit(100 + percent))
    apart = sum((F.bit_count(F.col(f"{x}m{k}").bitwiseXOR(F.col(f"{y}m{k}"))) for k in range(BITS // 64)), F.lit(0))
    return (nx * percent <= ny * 100) & (ny * percent <= nx * 100) & (apart <= nx + ny - 2 * need)


def _verified(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of stored pairs (c, m) of lines' ids, those of Jaccard percent / 100 or more, as (a, b). A pair is one row throughout."""
    side = lambda k: texts.select(F.col("id").alias(k), F.col("line").alias(f"line_{k}"))
    both = pairs.join(side("c"), "c").join(side("m"), "m")
    both = both.select("c", "m", _shingles(F.col("line_c")).alias("x"), _shingles(F.col("line_m")).alias("y"))
    both = both.withColumn("same", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("same") * (100 + percent) >= percent * (F.size("x") + F.size("y"))).select(F.least("c", "m").alias("a"), F.greatest("c", "m").alias("b"))


def _groups(docs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Classes of lines with more than one line or a link: h, g, and the place (first) that stays."""
    by_class = ["h", "g"]
    classes = lines.groupBy(*by_class).agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("copies"))
    classes = stored(classes.select(*by_class, "first.*", "copies"))
    by_band = Window.partitionBy("band")
    short = lines.where("short is not null").select(F.col("short").alias("line"))
    postings = _long_bands(_lines(docs)).union(_ring_bands(short, percent).distinct()).select("band", F.col("h").alias("id"))
    postings = postings.withColumn("many", F.min("id").over(by_band) != F.max("id").over(by_band))
    postings = stored(postings.where("many").select("band", "id"))
    # A node is a line's first hash. Should two lines share it, the smaller one of them takes part.
    wanted = semi_join_ids(classes.withColumnRenamed("h", "id"), stored(postings.select("id").distinct()), "id")
    wanted = stored(wanted.groupBy("id").agg(F.min(F.struct(*_PLACE, "copies")).alias("first")).select("id", "first.*"))
    center = F.max(F.struct("copies", "id")).over(by_band)["id"]
    postings = stored(postings.join(wanted.select("id", "copies"), "id").select("band", "id", center.alias("center")))
    wanted = wanted.drop("copies")
    texts, bitmaps = _candidates(docs, wanted)
    side = lambda key, p: bitmaps.select(F.col("id").alias(key), *(F.col(c).alias(f"{p}{c}") for c in bitmaps.columns if c != "id"))
    star = postings.where("center <> id").select(F.col("center").alias("c"), F.col("id").alias("m")).distinct()
    tested = stored(star.join(side("c", "x_"), "c").join(side("m", "y_"), "m").where(_may_link("x_", "y_", percent)).select("c", "m"))
    links = stored(_verified(texts, tested, percent))
    labels = components(links)
    open_ = postings.select("band", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    open_ = open_.withColumn("many", F.min("label").over(by_band) != F.max("label").over(by_band)).where("many").drop("many")
    open_ = stored(open_.join(bitmaps, "id"))
    part = lambda p: open_.select("band", *(F.col(c).alias(f"{p}{c}") for c in open_.columns if c != "band"))
    x, y = part("x_"), part("y_")
    rest = x.join(y, (x["band"] == y["band"]) & (F.col("x_id") < F.col("y_id")) & (F.col("x_label") != F.col("y_label")) & _may_link("x_", "y_", percent))
    rest = rest.select(F.col("x_id").alias("c"), F.col("y_id").alias("m")).distinct()
    known = tested.select(F.least("c", "m").alias("c"), F.greatest("c", "m").alias("m"))
    rest = stored(rest.join(known, ["c", "m"], "left_anti"))
    labels = components(links.union(_verified(texts, rest, percent)))
    # First line of each component, then back to the classes.
    linked = stored(wanted.join(labels.withColumnRenamed("node", "id"), "id"))
    least = linked.groupBy("label").agg(F.min(F.struct(*_PLACE)).alias("first"))
    linked = stored(linked.join(least, "label").select(*_PLACE, "first"))
    if linked.count() <= BROADCAST_ROWS:
        linked = F.broadcast(linked)
    found = classes.join(linked, _PLACE, "left").where("copies > 1 or first is not null")
    return stored(found.select(*by_class, F.coalesce("first", F.struct(*_PLACE)).alias("first")))


def dropped_lines(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, t, chars) of all lines with a word, and (doc_id, n, t) of those that another line stands for.

    docs has doc_id and text. Lines without a word are never dropped and stand for none. Documents whose text or
    id is null have no lines here. t is the hash of a row's text: rows that repeat both doc_id and text are one document,
    of which a line is never dropped for the same line of a repeated row; rows that share only the id are documents of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = F.char_length("line")
    short = F.when(chars <= RING * 100 // percent, F.col("line")).alias("short")  # what _ring_bands reads
    lines = _lines(docs).select(*_PLACE, F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"), chars.alias("chars"), short)
    lines = stored(lines)
    groups = _groups(docs, lines, percent)
    gone = lines.select(*_PLACE, "h", "g").join(groups, ["h", "g"]).where("first.doc_id <> doc_id or first.n <> n or first.t <> t").select(*_PLACE)
    return lines.select(*_PLACE, "chars"), stored(gone.distinct())


def line_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines (with a word), n_dropped and kept_chars (of the lines kept), one row for each doc_id of docs."""
    lines, gone = dropped_lines(docs, percent)
    marked = lines.join(gone.withColumn("gone", F.lit(1)), _PLACE, "left")
    sums = marked.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("gone").alias("n_dropped"), F.sum(F.when(F.col("gone").isNull(), F.col("chars")).otherwise(0)).alias("kept_chars"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_lines", "n_dropped", "kept_chars")}
    return ids.join(sums, "doc_id", "left").withColumns(zero)


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the dropped lines, all columns kept. A row all of whose lines were dropped goes; others stay."""
    _, gone = dropped_lines(docs, percent)
    count = gone.count()
    per_row = gone.groupBy("doc_id", F.col("t").alias("_t")).agg(F.collect_list("n").alias("_gone"))  # as many as one document has lines
    rows = docs.withColumn("_t", F.xxhash64("text")).join(F.broadcast(per_row) if count <= BROADCAST_ROWS else per_row, ["doc_id", "_t"], "left")
    split = F.split("text", "\n")
    kept = F.filter(F.arrays_zip(split.alias("line"), F.sequence(F.lit(0), F.size(split) - 1).alias("n")), lambda x: ~F.array_contains("_gone", x["n"]))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    rows = rows.withColumn("text", text)
    return rows.where(F.col("_gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
