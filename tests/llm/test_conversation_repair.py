"""Conversation repair against every edit sequence (short ones), a plain dynamic program (all), and on awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tracelake.llm import conversation_repair as repair
from tracelake.llm import queries

FOLDER = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile("(s?(ua)+)?")


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit) by trying every edit from each state, rows one after the other."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for r in "ua":
                    if (state, r) in step:
                        new, key = (cost + 3, audit + "I"), step[state, r]
                        best[key] = min(best.get(key, new), new)
        return best

    best = {"": (0, "")}
    for (_, role, _), fault in zip(rows, fault_of(rows), strict=True):
        new: dict = {}
        for state, (cost, audit) in inserted(best).items():
            ways = [(cost + 4, audit + "D", state)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways += [(cost + 3 + more, audit + "R", step[state, r]) for r in "ua" if (state, r) in step]
                if (state, role[:1]) in step:
                    ways.append((cost + more, audit + "K", step[state, role[:1]]))
            for c, a, key in ways:
                new[key] = min(new.get(key, (c, a)), (c, a))
        best = new
    best = inserted(best)
    return min(best[k] for k in ("", "a") if k in best)


def every_repair(rows):
    """(cost, audit) by writing out every edit sequence with up to three inserts at each place."""
    best = None
    faults = fault_of(rows)
    gaps = [p for n in range(4) for p in itertools.product("ua", repeat=n)]
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product(("K", "Ru", "Ra", "D"), repeat=len(rows)):
            cost, audit, roles = 3 * len(inserts[0]), "I" * len(inserts[0]), "".join(inserts[0])
            for (_, role, _), fault, e, after in zip(rows, faults, edits, inserts[1:], strict=True):
                if fault in ("blank", "duplicate") and e != "D":
                    break
                cost += {"K": 0, "R": 3, "D": 4}[e[0]] + 3 * (fault == "truncated" and e != "D") + 3 * len(after)
                audit += e[0] + "I" * len(after)
                roles += (role[:1] if e == "K" else e[1:] if e[0] == "R" else "") + "".join(after)
            else:
                if GRAMMAR.fullmatch(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def report_of(rows):
    """All columns of a conversation's sorted rows, by plain rules."""
    faults = fault_of(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = plain_repair(rows)
    out, at, roles = [], 0, ""
    for edit in audit:
        if edit == "I":
            role, text = ("assistant" if roles[-1:] == "u" else "user"), ""
        else:
            _, role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = "assistant" if roles[-1:] == "u" else "user"
        roles += role[:1]
        out.append(f"{role}:{text}")
    assert GRAMMAR.fullmatch(roles)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(conv, turn, role, text):
    one = lambda v: " " if v is None else v
    hit = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
    role, text = one(role), one(text)
    if hit == 0:
        return []
    if hit == 1:
        text = ""
    if hit == 2:
        text = re.sub("[.!?]", "", text)
    return [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)


def expected(table):
    by: dict = {}
    for conv, turn, role, text in table:
        by.setdefault(conv, []).extend(damage(conv, turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {c: report_of(sorted(rows, key=order)) for c, rows in by.items()}


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_every_edit_sequence():
    texts = ["a.", "b", ""]
    kinds = [(r, t) for r in ("system", "user", "assistant", "tool") for t in texts]
    for n in (0, 1, 2):
        for rows in itertools.product(kinds, repeat=n):
            rows = [(i, r, t + str(i) + t if t else t) for i, (r, t) in enumerate(rows)]
            assert plain_repair(rows) == every_repair(rows)


@pytest.mark.parametrize("seed", range(6))
def test_grammar_and_matrices(seed):
    """Any sequences, many alike, cut anywhere: the same as the plain program."""
    r = random.Random(seed)
    words = ["".join(r.choice("suaoSUAOx") for _ in range(r.randint(1, 9))) for _ in range(5)]
    sequences = list({"".join(r.choice(words) if r.random() < 0.8 else r.choice("uax") for _ in range(r.randint(0, 40))) for _ in range(60)})
    rules, rest = repair.re_pair(sequences)

    def spelled(x):
        return x if isinstance(x, str) else "".join(map(spelled, rules[x]))

    assert ["".join(map(spelled, s)) for s in rest] == sequences
    assert sum(map(len, rest)) + 2 * len(rules) < sum(map(len, sequences))
    left = [p for s in rest for p in zip(s, s[1:], strict=False) if p[0] != p[1]]
    assert len(left) == len(set(left))  # no pair is left twice
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    whole = [repair.finished(rows[0]) for rows in repair.solved([(s, False) for s in sequences])]
    for s, (cost, audit) in zip(sequences, whole, strict=True):
        rows = [(i, role.get(c.lower(), "user"), "" if c == "x" else f"t{i}" + "." * c.islower()) for i, c in enumerate(s)]
        assert (cost, str(audit)) == plain_repair(rows)
    for s, w in list(zip(sequences, whole, strict=True))[:20]:
        at = r.randint(0, len(s))
        a, b = repair.solved([(s[:at], True), (s[at:], True)])
        cost, audit = repair.finished(repair.times(a, b)[0])
        assert (cost, str(audit)) == (w[0], str(w[1]))


def test_ropes():
    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("DIKR") for _ in range(r.randint(0, 300))) for _ in range(2))
        if r.random() < 0.6:
            b = a[: r.randint(0, len(a))] + b[: r.randint(0, 3)]

        def rope(s):
            if len(s) < 60:
                return repair.Rope(s)
            k = r.randint(1, len(s) - 1)
            return rope(s[:k]) + rope(s[k:])

        assert str(rope(a)) == a and (rope(a) < rope(b)) == (a < b)


def test_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_conversation_repair(spark, FOLDER)) == expected(table)


def test_odd_conversations(spark, tmp_path, monkeypatch):
    """Null ids, turns, roles and texts, ties, repeated rows, a long conversation in many fragments, clashing columns, no rows."""
    r = random.Random(1)
    rows = [(None, 0, "user", "No id."), (None, 1, "assistant", None), (1, None, "system", "s."), (1, None, None, "x."), (1, 3, "user", "Hi."), (1, 3, "user", "Hi."), (1, 3, "assistant", "Ho"), (2, None, None, None), (3, 5, "", "no role."), (3, 9, "tool", "t!"), (4, 7, "user", "")]
    rows += [(5, t // 2, r.choice(["user", "assistant", "system", "bot"]), r.choice(["ok.", "no", "why? ", f"{t}."])) for t in range(3000)]
    rows += [(6 + t % 40, t, ("user", "assistant")[t // 40 % 2], f"Text {t}.") for t in range(400)]
    monkeypatch.setattr(repair, "FRAGMENT", 64)
    kind = "conv_id long, turn long, role string, text string, cost string, audit int, symbols string, hit int, at string, id string"
    spark.createDataFrame([(*x, "c", 1, "y", 3, None, "i") for x in rows], kind).repartition(3).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert got(queries.op11_conversation_repair(spark, f"{tmp_path}/a")) == expected(rows)
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert got(queries.op11_conversation_repair(spark, f"{tmp_path}/b")) == {}
