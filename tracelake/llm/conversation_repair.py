"""Conversation structure repair: the cheapest edits that give every conversation the roles (system?) (user assistant)+.

A conversation's rows stand in order of turn (nulls first); rows of one turn by role, the text's first characters and a
hash. Each row's first fault counts: blank (no character but white space), duplicate (role and text seen earlier in the
conversation), truncated (the last character that is no white space is none of . ! ?). Edits and their letters: Keep costs 0,
Rerole to user or assistant 3, Delete 4 (the only one for blank and duplicate rows), Insert of an empty user or assistant row 3;
a truncated row that stays adds 3. Of the cheapest edit sequences the one whose letters are least in ASCII counts.

Method.

* Rows become symbols (role initial and fault) in Spark; first occurrences are found by aggregation and joined by row number,
  so that a text or conversation that holds much of the table is never one task's group.
* Symbols are range-partitioned in order and cut into fragments of at most FRAGMENT; a conversation of any length is many
  fragments. Equal fragments, of whatever conversation, are solved once.
* Each task runs Re-Pair over its distinct fragments: the most frequent pair of neighbouring symbols becomes a rule, until no
  pair occurs twice. Bottom-up, each rule gets its (min, +) transfer matrix over the four states of the role automaton, the
  product of its two symbols' matrices. An entry holds a cost and an audit rope: the least cheapest letters as a tree that
  shares its parts with other entries, compared by length and hash, so that a rule costs no more than its depth.
* The fragments' matrices of a conversation are folded in order, streaming over sorted partitions; then its rows stream once
  past its audit, which gives the repaired rows. A task holds one batch of rows and one audit at a time.

The cheapest letters between two states are prefix-free (a proper prefix that covers the same rows lacks only inserts, which
cost), so the least of a concatenation is the concatenation of the least.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored

FRAGMENT = 4096  # symbols
BATCH = 200_000  # symbols of distinct fragments that share one grammar
HEAD = 64  # characters of role and text that order rows of one turn
FLAT = 48  # letters up to which a rope is one string

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3

#: States of the role automaton: nothing yet, after system, after user, after assistant. The first and last accept.
STATES = range(4)
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = STATES
ACCEPTING = (START, AFTER_ASSISTANT)
STEPS = {"s": {START: AFTER_SYSTEM}, "u": {START: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_ASSISTANT: AFTER_USER}, "a": {AFTER_USER: AFTER_ASSISTANT}}
WRITTEN = {"u": "user", "a": "assistant"}  # roles that an edit gives
LEGAL = ("su", "ua", "au")

_WHITE = " \t\n\x0b\x0c\r"
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Rope:
    """Letters as a string or as two ropes; equal length and hash are taken as equal letters."""

    __slots__ = ("hash", "left", "n", "power", "right", "text")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is None:
            self.n, self.power = left.n + right.n, left.power * right.power % _PRIME
            self.hash = (left.hash * right.power + right.hash) % _PRIME
        else:
            self.n, self.power, self.hash = len(text), pow(_BASE, len(text), _PRIME), 0
            for c in text:
                self.hash = (self.hash * _BASE + ord(c)) % _PRIME

    def __add__(self, other: Rope) -> Rope:
        if not self.n or not other.n:
            return other if not self.n else self
        if self.n + other.n <= FLAT:
            return Rope(str(self) + str(other))
        return Rope(None, self, other)

    def __str__(self) -> str:
        parts, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.text is None:
                todo += (x.right, x.left)
            else:
                parts.append(x.text)
        return "".join(parts)

    def __lt__(self, other: Rope) -> bool:
        mine, theirs = [self], [other]
        while mine and theirs:
            x, y = mine.pop(), theirs.pop()
            if x is y or (x.n == y.n and x.hash == y.hash):
                continue
            if x.text is None and (y.text is not None or x.n >= y.n):
                mine += (x.right, x.left)
                theirs.append(y)
            elif y.text is None:
                theirs += (y.right, y.left)
                mine.append(x)
            else:
                n = min(x.n, y.n)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                mine += [Rope(x.text[n:])] if x.n > n else []
                theirs += [Rope(y.text[n:])] if y.n > n else []
        return bool(theirs) and not mine


Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]  # from state, to state


def _better(new: Entry, old: Entry | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and new[1] < old[1])


def times(left: list[list[Entry | None]], right: Matrix) -> list[list[Entry | None]]:
    """(min, +) product of rows of entries with a matrix; of equal costs the least letters."""
    out = []
    for row in left:
        new: list[Entry | None] = [None] * len(STATES)
        for x, through in zip(row, right, strict=True):
            if x is not None:
                for j, y in enumerate(through):
                    if y is not None:
                        cost = x[0] + y[0]
                        if new[j] is None or cost < new[j][0]:
                            new[j] = (cost, x[1] + y[1])
                        elif cost == new[j][0] and (letters := x[1] + y[1]) < new[j][1]:
                            new[j] = (cost, letters)
        out.append(new)
    return out


def inserts() -> Matrix:
    """The fewest inserts from each state to each."""
    out: Matrix = [[None] * len(STATES) for _ in STATES]
    for i in STATES:
        reached, n = {i}, 0
        while reached:
            for j in reached:
                out[i][j] = out[i][j] or (INSERT_COST * n, Rope(INSERT * n))
            reached, n = {STEPS[r][j] for r in WRITTEN for j in reached if j in STEPS[r] and out[i][STEPS[r][j]] is None}, n + 1
    return out


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts before one row, then its edit. Symbols: x (must go), or the role's initial (o: another), a capital if truncated."""
    edit: Matrix = [[None] * len(STATES) for _ in STATES]
    extra = TRUNCATED_COST if symbol.isupper() else 0
    for i in STATES:
        ways = [(DELETE_COST, Rope(DELETE), i)]
        if symbol != "x":
            ways += [(REROLE_COST + extra, Rope(REROLE), STEPS[r][i]) for r in WRITTEN if i in STEPS[r]]
            if i in STEPS.get(symbol.lower(), ()):
                ways.append((extra, Rope(KEEP), STEPS[symbol.lower()][i]))
        for cost, letter, j in ways:
            if _better((cost, letter), edit[i][j]):
                edit[i][j] = (cost, letter)
    return times(inserts(), edit)


def re_pair(sequences: list[str]) -> tuple[list[tuple], list[list]]:
    """Rules (left, right) and the sequences in symbols left over: letters, or the numbers of rules, each after its parts.

    The most frequent pair of neighbours is replaced everywhere until none occurs twice; time is linear in the symbols but
    for the heap.
    """
    sym: list = []
    for s in sequences:
        sym += [*s, None]
    before, after = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
    places: dict[tuple, set[int]] = {}
    for i in range(len(sym) - 1):
        if sym[i] is not None and sym[i + 1] is not None:
            places.setdefault((sym[i], sym[i + 1]), set()).add(i)
    key = lambda p: tuple((isinstance(x, str), str(x) if isinstance(x, str) else -x) for x in p)  # noqa: E731  any fixed order
    heap = [(-len(at), key(p), p) for p, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple] = []

    def forget(i: int, j: int) -> None:
        if i >= 0 and sym[i] is not None and j < len(sym) and sym[j] is not None:
            places[sym[i], sym[j]].discard(i)

    def learn(i: int, j: int) -> None:
        if i >= 0 and sym[i] is not None and j < len(sym) and sym[j] is not None:
            at = places.setdefault((sym[i], sym[j]), set())
            at.add(i)
            if len(at) > 1:
                heapq.heappush(heap, (-len(at), key((sym[i], sym[j])), (sym[i], sym[j])))

    while heap:
        count, _, pair = heapq.heappop(heap)
        at = places.get(pair, ())
        if len(at) != -count:
            if len(at) > 1:
                heapq.heappush(heap, (-len(at), key(pair), pair))
            continue
        new, first = len(rules), True
        for i in sorted(at):
            j = after[i]
            if sym[i] != pair[0] or j >= len(sym) or sym[j] != pair[1]:
                continue  # overlaps with the one replaced just before
            if first:
                rules.append(pair)
                first = False
            h, k = before[i], after[j]
            forget(h, i)
            forget(i, j)
            forget(j, k)
            sym[i], sym[j], after[i] = new, None, k
            if k < len(sym):
                before[k] = i
            learn(h, i)
            learn(i, k)
        places.pop(pair, None)
    out, i = [], 0
    for s in sequences:
        left, end = [], i + len(s)
        while i < end:
            left.append(sym[i])
            i = after[i]
        out.append(left)
        i = end + 1
    return rules, out


def solved(sequences: list[tuple[str, bool]]) -> Iterator[list[list[Entry | None]]]:
    """For each (symbols, cut): the entries from the start state, or from all states if it is cut."""
    letters = {c: symbol_matrix(c) for c in set("".join(s for s, _ in sequences))}
    rules, rest = re_pair([s for s, _ in sequences])
    rule: list[Matrix] = []
    of = lambda x: letters[x] if isinstance(x, str) else rule[x]
    for left, right in rules:
        rule.append(times(of(left), of(right)))
    one = (0, Rope(""))
    for (_, cut), symbols in zip(sequences, rest, strict=True):
        rows = [[one if i == j else None for j in STATES] for i in (STATES if cut else (START,))]
        for x in symbols:
            rows = times(rows, of(x))
        yield rows


def finished(row: list[Entry | None]) -> Entry:
    """The cheapest way from a row of entries to an accepting state."""
    ends = times([row], inserts())[0]
    best = None
    for j in ACCEPTING:
        if ends[j] is not None and _better(ends[j], best):
            best = ends[j]
    return best


def repairable(conversations: DataFrame, *keys: str) -> DataFrame:
    """conv_id, turn, role and text of conversations, a null role or text as one space; keys are kept besides."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"), *keys)


_ORDER = ("turn", "role_head", "text_head", "text_md5")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with what orders them within a turn."""
    head = lambda c: F.substring(c, 1, HEAD).alias(f"{c}_head")
    return rows.select("*", head("role"), head("text"), F.unhex(F.md5(F.encode(F.concat(F.char_length("role"), F.lit(":"), "role", "text"), "UTF-8"))).alias("text_md5"))


_FRAGMENT = "conv_id long, at long, cut boolean, symbols string, blank long, duplicate long, truncated long, illegal long, opening string, closing string, first_turn long, last_turn long, turns long"


def _fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, initial, fault, symbol) to fragments, in order over all partitions by at."""
    part = TaskContext.get().partitionId() << 33
    made = 0
    names = [f.split()[0] for f in _FRAGMENT.split(", ")]
    open_: dict | None = None
    out: list[dict] = []

    def shut(cut: bool) -> None:
        nonlocal made
        symbols = "".join(open_.pop("parts"))
        out.append(open_ | {"at": part + made, "symbols": symbols, "cut": cut or open_["cut"]})
        made += 1

    def batch() -> pa.RecordBatch:
        table = {n: [x[n] for x in out] for n in names}
        out.clear()
        kinds = {"cut": pa.bool_(), "symbols": pa.string(), "opening": pa.string(), "closing": pa.string()}
        return pa.record_batch([pa.array(table[n], kinds.get(n, pa.int64())) for n in names], names)

    fresh = True  # a conversation at a partition's edge may go on in the next
    for b in batches:
        for conv, turn, initial, fault, symbol in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "symbol")), strict=True):
            same = open_ is not None and open_["conv_id"] == conv
            full = same and len(open_["parts"]) >= FRAGMENT
            if not same or full:
                cut = full or (fresh and open_ is None)
                if open_ is not None:
                    shut(full)
                open_ = {"conv_id": conv, "cut": cut, "parts": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "opening": initial, "closing": None, "first_turn": None, "last_turn": None, "turns": 0}
                fresh = False
            if open_["parts"] and open_["closing"] + initial not in LEGAL:
                open_["illegal"] += 1
            open_["closing"] = initial
            open_["parts"].append(symbol)
            if fault:
                open_[fault] += 1
            if turn is not None and turn != open_["last_turn"]:
                open_["turns"] += 1
                open_["last_turn"] = turn
                if open_["first_turn"] is None:
                    open_["first_turn"] = turn
        if len(out) >= 2000:
            yield batch()
    if open_ is not None:
        shut(True)
    if out:
        yield batch()


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (symbols, cut) to costs and audits by from and to state (row-major), each batch of them by one grammar."""

    def flush(todo: list[tuple[str, bool]]) -> pa.RecordBatch:
        rows = list(solved(todo))
        flat = [[x for row in r for x in row] for r in rows]
        return pa.record_batch({
            "symbols": pa.array([s for s, _ in todo]), "cut": pa.array([c for _, c in todo]),
            "costs": pa.array([[None if x is None else x[0] for x in r] for r in flat], pa.list_(pa.int64())),
            "audits": pa.array([[None if x is None else str(x[1]) for x in r] for r in flat], pa.list_(pa.string())),
        })

    todo, size = [], 0
    for b in batches:
        for s, cut in zip(b.column("symbols").to_pylist(), b.column("cut").to_pylist(), strict=True):
            todo.append((s, cut))
            size += len(s)
            if size >= BATCH:
                yield flush(todo)
                todo, size = [], 0
    if todo:
        yield flush(todo)


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments sorted by conversation and place, with their entries, to a report of each conversation."""
    names = [f.split()[0] for f in _REPORT.split(", ")]
    counts = ("blank", "duplicate", "truncated", "illegal")
    now: dict | None = None

    def shut() -> list:
        cost, audit = finished(now["row"])
        gaps = 0 if now["first_turn"] is None else now["last_turn"] - now["first_turn"] + 1 - now["turns"]
        return [now["conv_id"], gaps, *(now[c] for c in counts), cost, str(audit)]

    for b in batches:
        out = []
        for x in b.to_pylist():
            n = len(STATES)
            entries = [None if c is None else (c, Rope(a)) for c, a in zip(x["costs"], x["audits"], strict=True)]
            matrix = [entries[i : i + n] for i in range(0, len(entries), n)]
            if now is None or now["conv_id"] != x["conv_id"]:
                if now is not None:
                    out.append(shut())
                now = {k: x[k] for k in ("conv_id", *counts, "closing", "first_turn", "last_turn", "turns")} | {"row": matrix[START]}
                continue
            now["row"] = times([now["row"]], matrix)[0]
            for c in counts:
                now[c] += x[c]
            now["illegal"] += now["closing"] + x["opening"] not in LEGAL
            now["closing"] = x["closing"]
            now["turns"] += x["turns"] - (x["first_turn"] is not None and x["first_turn"] == now["last_turn"])
            now["first_turn"] = x["first_turn"] if now["first_turn"] is None else now["first_turn"]
            now["last_turn"] = now["last_turn"] if x["last_turn"] is None else x["last_turn"]
        if out:
            yield pa.record_batch([pa.array(c, pa.string() if k == "audit" else pa.int64()) for k, c in zip(names, zip(*out, strict=True), strict=True)], names)
    if now is not None:
        yield pa.record_batch([pa.array([c], pa.string() if k == "audit" else pa.int64()) for k, c in zip(names, shut(), strict=True)], names)


def repair_report(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of rows (those of repairable): gaps, blank, duplicate, truncated, illegal, cost and audit.

    gaps: turns missing between the first and the last. illegal: neighbouring role initials that are not su, ua or au. A null
    conv_id is a conversation of its own; repeated rows are neighbours, the later ones duplicates. Without rows there is no report.
    An empty role has no initial and cannot be kept.
    """
    last = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    lean = _keyed(rows).select("conv_id", *_ORDER, F.substring("role", 1, 1).alias("initial"), (last == "").alias("is_blank"), (~last.isin(".", "!", "?")).alias("is_truncated"), F.monotonically_increasing_id().alias("uid"))
    lean = stored(lean)
    firsts = lean.groupBy("conv_id", "text_md5").agg(F.min(F.struct("turn", "uid"))["uid"].alias("uid")).select("uid", F.lit(True).alias("first"))
    fault = F.when(F.col("is_blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("is_truncated"), "truncated")
    kept = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kept)).otherwise(kept)
    marked = lean.join(firsts, "uid", "left").withColumn("fault", fault).select("conv_id", *_ORDER, "uid", "initial", "fault", symbol.alias("symbol"))
    order = ["conv_id", *_ORDER, "uid"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "initial", "fault", "symbol")
    fragments = stored(ordered.mapInArrow(_fragments, _FRAGMENT))
    entries = fragments.select("symbols", "cut").distinct().mapInArrow(_solve, "symbols string, cut boolean, costs array<long>, audits array<string>")
    both = fragments.join(entries, ["symbols", "cut"]).drop("symbols", "cut")
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_fold, _REPORT)


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), edit (K, R or I), turn (null if inserted), role and text.

    Rows come in order of place and those of a conversation in one partition. They stream past the audit; a task holds one
    audit and one batch.
    """

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place = None, "", 0, START, 0
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        out: list[tuple] = []

        def put(edit, turn, role, text):
            nonlocal state, place
            if edit != KEEP:
                initial = "a" if state == AFTER_USER else "u"
                role = WRITTEN[initial]
            else:
                initial = role[:1]
            state = STEPS[initial][state]
            out.append((conv, place, edit, turn, role, text))
            place += 1

        def added() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == INSERT:
                put(INSERT, None, None, "")
                at += 1

        for b in batches:
            for c, letters, turn, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "audit", "turn", "role", "text")), strict=True):
                if letters is not None:  # the audit comes before its rows
                    added()
                    conv, audit, at, state, place = c, letters, 0, START, 0
                    continue
                added()
                if audit[at] != DELETE:
                    put(audit[at], turn, role, text)
                at += 1
            if out:
                yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "place", "edit", "turn", "role", "text"])
                out = []
        added()
        if out:
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "place", "edit", "turn", "role", "text"])

    keyed = _keyed(rows).withColumn("kind", F.lit(1))
    audits = report.select("conv_id", "audit", F.lit(0).alias("kind"))
    both = keyed.unionByName(audits, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER).select("conv_id", "audit", "turn", "role", "text")
    return both.mapInArrow(apply, "conv_id long, place long, edit string, turn long, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of each conversation's role:text lines, of rows straight from repaired()."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for b in batches:
            out = []
            for c, place, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], ["conv_id", "sha256"])
        if digest is not None:
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "sha256"])

    return rows.mapInArrow(run, "conv_id long, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with faults that a hash of conv_id and turn sets: one in 20 each is dropped, emptied, loses its
    sentence marks, is repeated, or becomes the user's. Nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    rows = repairable(conversations, hit.alias("hit")).where("hit <> 0")
    rows = rows.withColumn("text", F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", "role", "text")
