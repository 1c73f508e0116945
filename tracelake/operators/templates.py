"""Log patterns: bodies with their variable parts masked, and templates that join bodies of like words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import typed
from tracelake.functions.redact import redact_text
from tracelake.functions.scalars import EMAIL, IP, UUID, is_hex, is_id_segment, is_time, is_token
from tracelake.functions.typed import let
from tracelake.operators.store import stored

MAX_TOKENS = 64
MAX_CHARS = 2048
SIMILARITY = 0.4
MAX_CHILDREN = 100  # first words of a service and length that are groups of their own
MAX_TEMPLATES = 1000
SAMPLE, SAMPLE_READ = 120, 8192  # signs of a sample, and those read for it before secrets are taken out
PART = 20_000  # patterns that one task joins
ANY, OTHER = "<*>", "(other)"


# What may stand around a token's value, numbers with a unit, schemes, and quoted text.
_HEAD, _TAIL = r"""^[(\[{<"']*""", r"""[)\]}>"',;.:!?]*$"""
_NUMBER = r"(?i)^[-+]?[0-9]+(\.[0-9]+)?([a-z%µ]{1,3})?$"
_SCHEME = r"(?i)^[a-z][a-z0-9+.-]{0,15}://"
_QUOTED = r'"[^"\n]{0,200}"'


def _path(text: Column) -> Column:
    """A path with its segments that are addresses or ids masked, and its query."""
    segments = F.transform(F.split(F.regexp_replace(text, r"\?.*$", ""), "/"), lambda x: F.when(x == "", x).when(x.rlike(IP), "<IP>").when(is_id_segment(x), "<ID>").otherwise(x))
    return F.concat(F.array_join(segments, "/"), F.when(F.contains(text, F.lit("?")), "?<QUERY>").otherwise(""))


def _value(text: Column) -> Column:
    return (
        F.when(text.rlike(_NUMBER), F.concat(F.lit("<NUM>"), F.regexp_extract(text, _NUMBER, 2))).when(text.rlike(f"^{UUID}$"), "<UUID>").when(is_time(text), "<TS>")
        .when(text.rlike(IP), "<IP>").when(text.rlike(EMAIL), "<EMAIL>").when(text.rlike(_SCHEME), "<URL>").when(text.startswith("/"), _path(text))
        .when(is_hex(text, 8), "<HEX>").when(is_token(text), "<TOKEN>").otherwise(text)
    )


def _mask(token: Column) -> Column:
    """A token with its value masked; a key= or key: before it and marks around it stay.

    Every part is bound by let, so the rules stand once in the plan: they see the whole value and, where a key stands before, the rest.
    """

    def cut(head: Column) -> Column:
        rest = F.substr(token, F.char_length(head) + 1)
        return let(F.regexp_extract(rest, _TAIL, 0), lambda tail: let(F.left(rest, F.char_length(rest) - F.char_length(tail)), lambda core: around(head, core, tail)))

    def around(head: Column, core: Column, tail: Column) -> Column:
        key = F.when(~core.rlike(_SCHEME), F.regexp_extract(core, "^[^=:]+[=:](?=.)", 0)).otherwise("")
        return let(key, lambda k: let(F.transform(F.array(core, F.substr(core, F.char_length(k) + 1)), _value), lambda both: F.concat(head, chosen(core, k, both), tail)))

    def chosen(core: Column, key: Column, both: Column) -> Column:
        return F.when((both[0] != core) | (key == ""), both[0]).otherwise(F.concat(key, both[1]))

    # Only tokens with a digit or one of @ / = : can vary.
    return F.when(token.rlike("[0-9@/=:]"), let(F.regexp_extract(token, _HEAD, 0), cut)).otherwise(token)


def mask_tokens(body: Column) -> Column:
    """The first 64 tokens of the body's first 2048 signs, masked; text in double quotes is one token."""
    text = F.regexp_replace(F.left(body, F.lit(MAX_CHARS)), _QUOTED, "<STR>")
    return F.transform(F.slice(F.array_remove(F.split(text, r"[\x00-\x20]+"), ""), 1, MAX_TOKENS), _mask)


class Templates:
    """Templates of one length: each row of words joins the most alike one, or starts its own. A set of them can be added to another.

    Likeness: share of places with the same word, places that vary (ANY) not counted; of equals the one with more such places, then
    the first. Words are numbers here, 0 for ANY, so a row is compared with all templates at once.
    """

    def __init__(self, size: int, similarity: float):
        self.size, self.similarity = size, similarity
        self.words, self.code = [ANY], {ANY: 0}
        self.held = np.zeros((16, size), np.int64)
        self.sums: list[list] = []  # count, bytes, first, last, sample

    def add(self, tokens: list[str], count: int, bytes_: int, first: float, last: float, sample: str) -> None:
        for t in tokens:
            if t not in self.code:
                self.code[t] = len(self.words)
                self.words.append(t)
        row = np.array([self.code[t] for t in tokens])
        held = self.held[: len(self.sums)]
        if len(held):
            same = ((held == row) & (held != 0)).sum(axis=1)
            best = int((same * (self.size + 1) + (held == 0).sum(axis=1)).argmax())
            if same[best] / self.size >= self.similarity:
                held[best][held[best] != row] = 0
                s = self.sums[best]
                first_of = min((s[2], s[4]), (first, sample))
                self.sums[best] = [s[0] + count, s[1] + bytes_, first_of[0], max(s[3], last), first_of[1]]
                return
        if len(self.sums) == len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[len(self.sums)] = row
        self.sums.append([count, bytes_, first, last, sample])

    def rows(self):
        for row, s in zip(self.held, self.sums, strict=False):
            yield [self.words[c] for c in row], *s


_PARTIAL = "service string, size int, head string, tokens array<string>, n long, bytes long, first_ms double, last_ms double, sample string"


def _joined(similarity: float, most: int):
    """Patterns or templates of one group to its templates; beyond most of them the rarest (then latest) go to OTHER, which counts them."""

    def run(group: pa.Table) -> pa.Table:
        group = group.select([f.split()[0] for f in _PARTIAL.split(", ")])
        size, out, other = group.column("size")[0].as_py(), None, []
        rows = group.sort_by([("first_ms", "ascending"), ("sample", "ascending")]).to_pylist()
        rows.sort(key=lambda r: (r["first_ms"], r["tokens"]))
        if size == 0:  # shapes and OTHER are told apart by their head alone
            sums: dict = {}
            for r in rows:
                s = sums.setdefault(r["head"], [0, 0, r["first_ms"], r["last_ms"], r["sample"]])
                first = min((s[2], s[4] or ""), (r["first_ms"], r["sample"] or ""))
                sums[r["head"]] = [s[0] + r["n"], s[1] + r["bytes"], first[0], max(s[3], r["last_ms"]), first[1]]
            out = [([], *s) for s in sums.values()]
        else:
            found = Templates(size, similarity)
            for r in rows:
                found.add(r["tokens"], r["n"], r["bytes"], r["first_ms"], r["last_ms"], r["sample"])
            out = sorted(found.rows(), key=lambda t: (-t[1], t[3]))
            out, other = out[:most], out[most:]
        key = {"service": group.column("service")[0].as_py(), "size": size, "head": group.column("head")[0].as_py()}
        names = ("tokens", "n", "bytes", "first_ms", "last_ms", "sample")
        table = [key | dict(zip(names, t, strict=True)) for t in out]
        if other:
            table.append(key | {"size": 0, "head": OTHER} | dict(zip(names, ([], sum(t[1] for t in other), sum(t[2] for t in other), min(t[3] for t in other), max(t[4] for t in other), ""), strict=True)))
        kinds = {"size": pa.int32(), "tokens": pa.list_(pa.string()), "n": pa.int64(), "bytes": pa.int64(), "first_ms": pa.float64(), "last_ms": pa.float64()}
        return pa.table({n: pa.array([r[n] for r in table], kinds.get(n, pa.string())) for n in [f.split()[0] for f in _PARTIAL.split(", ")]})

    return run


def merge_templates(partial: DataFrame, similarity: float = SIMILARITY, most: int = MAX_TEMPLATES, part: int = PART) -> DataFrame:
    """Templates of patterns or of earlier tables of templates (columns of _PARTIAL), which may be added together.

    Words of one service, length and head are dealt to parts of about part rows by hash, each part makes its templates, and these are
    dealt again to fewer parts until one part for each group is left. A part gives most templates at most, so rounds end.
    """
    rows = partial
    while True:
        groups = rows.groupBy("service", "size", "head").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")
        hot = stored(groups)
        split = hot.limit(1).count() > 0
        if not split:
            return rows.groupBy("service", "size", "head").applyInArrow(_joined(similarity, most), _PARTIAL)
        dealt = rows.join(hot, ["service", "size", "head"], "left")
        dealt = dealt.withColumn("at", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("tokens"), F.col("parts"))).otherwise(F.lit(0)))
        rows = stored(dealt.groupBy("service", "size", "head", "at").applyInArrow(_joined(similarity, min(most, part // 2)), _PARTIAL))


def log_patterns(logs: DataFrame, max_children: int = MAX_CHILDREN) -> DataFrame:
    """Distinct masked bodies of logs, counted (columns of _PARTIAL): what merge_templates takes.

    The head is the first word; words with a digit, and words beyond the first max_children - 1 of a service and length, go to ANY.
    A body that is no text, or has no words, is a shape: size 0, its head the shape.
    """
    kind = logs.schema["body"].dataType.simpleString()
    body = F.col("body")
    text = body if kind == "string" else F.when(typed.kind(body) == "text", F.try_variant_get(body, "$", "string"))
    shape = F.lit("<empty>") if kind == "string" else typed.shape(body)
    whole = F.coalesce(body, F.lit("")) if kind == "string" else F.coalesce(F.try_variant_get(body, "$", "string"), F.to_json(body), F.lit(""))
    rows = logs.select("service", F.col("time_ms").cast("double").alias("time_ms"), F.left(whole, F.lit(SAMPLE_READ)).alias("whole"), F.octet_length(whole).alias("bytes"), mask_tokens(text).alias("tokens"), shape.alias("shape"))
    rows = rows.withColumn("shape", F.when(F.coalesce(F.size("tokens"), F.lit(0)) == 0, F.col("shape"))).withColumn("tokens", F.when(F.col("shape").isNull(), F.col("tokens")).otherwise(F.array().cast("array<string>")))
    counted = rows.groupBy("service", "tokens", "shape").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"), F.min(F.struct("time_ms", "whole"))["whole"].alias("sample"))
    word = F.get("tokens", F.lit(0))
    head = F.coalesce("shape", F.when(word.rlike("[0-9]"), ANY).otherwise(word))
    counted = stored(counted.select("service", F.size("tokens").alias("size"), head.alias("head"), "tokens", "n", "bytes", "first_ms", "last_ms", "sample"))
    heads = counted.where("size > 0").groupBy("service", "size", "head").agg(F.min("first_ms").alias("first_ms"))
    rank = F.row_number().over(Window.partitionBy("service", "size").orderBy("first_ms", "head"))  # Spark keeps the first few of each task
    kept = heads.withColumn("rank", rank).where(F.col("rank") <= max_children - 1).select("service", "size", "head", F.lit(True).alias("kept"))
    rows = counted.join(kept, ["service", "size", "head"], "left")
    return rows.withColumn("head", F.when((F.col("size") == 0) | F.col("kept"), F.col("head")).otherwise(ANY)).drop("kept")


def log_templates(logs: DataFrame, similarity: float = SIMILARITY, most: int = MAX_TEMPLATES, max_children: int = MAX_CHILDREN) -> DataFrame:
    """Templates per service: text, logs, bytes, times, and the first body without secrets, cut to 120 signs.

    Bodies may be text or typed values; those that are no text count by shape. A service has most templates at most: the rarest beyond
    are counted in one named (other), so that counts and bytes add up to all logs. Rows in any order give the same templates.
    """
    found = merge_templates(log_patterns(logs, max_children), similarity, most)
    found = found.withColumn("template", F.when(F.col("size") > 0, F.array_join("tokens", " ")).otherwise(F.col("head")))
    order = Window.partitionBy("service").orderBy(F.col("template") == OTHER, F.desc("n"), "first_ms", "template")
    found = found.withColumn("template", F.when(F.row_number().over(order) <= most, F.col("template")).otherwise(OTHER))
    found = found.groupBy("service", "template").agg(F.sum("n").alias("n_logs"), F.sum("bytes").alias("bytes"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.min(F.struct("first_ms", "sample"))["sample"].alias("sample"))
    clean = redact_text(F.col("sample"))
    cut = F.when(F.char_length(clean) > SAMPLE, F.concat(F.left(clean, F.lit(SAMPLE)), F.lit("…"))).otherwise(clean)
    return found.withColumn("sample", F.when(F.col("template") != OTHER, cut))
