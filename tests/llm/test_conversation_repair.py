"""Conversation repair against a plain dynamic program and plain Python rows."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import conversation_repair as repair

BLANK = " \t\n\x0b\x0c\r"


def cheapest(symbols):
    """Least (cost, audit) by carrying the best of every state forward: 'ok', 'cut' or 'go' with a role initial."""
    follows = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    given = {"": "u", "s": "u", "u": "a", "a": "u"}

    def closed(best):
        while True:
            before = dict(best)
            for state, (cost, audit) in before.items():
                more = (cost + 3, audit + "I")
                best[given[state]] = min(best.get(given[state], more), more)
            if best == before:
                return best

    best = {"": (0, "")}
    for initial, fault in symbols:
        after = {}
        for state, (cost, audit) in closed(best).items():
            ways = [(cost + 4, audit + "D", state)]
            if fault != "go":
                extra = 3 if fault == "cut" else 0
                ways.append((cost + 3 + extra, audit + "R", given[state]))
                if initial in follows[state]:
                    ways.append((cost + extra, audit + "K", follows[state][initial]))
            for c, a, s in ways:
                after[s] = min(after.get(s, (c, a)), (c, a))
        best = after
    best = closed(best)
    return min(best[s] for s in ("", "a") if s in best)


CODE = {"ok": None, "cut": "truncated", "go": "blank"}


@pytest.mark.parametrize("stretch", [1024, 3])
def test_cheapest_audits(monkeypatch, stretch):
    monkeypatch.setattr(repair, "STRETCH", stretch)
    rnd, repairer = random.Random(2), repair.Repairer()
    for _ in range(1500):
        rows = [r for r in [(rnd.choice("suax"), rnd.choice(["ok", "ok", "cut", "go"])) for _ in range(rnd.randint(0, 7))]
                for _ in range(rnd.choice([1, 1, 1, 2, 5, 17]))]
        runs = [(s, len(list(g))) for s, g in itertools.groupby(repair.symbol_of(i, CODE[f]) for i, f in rows)]
        assert repairer.solve([s for s, _ in runs], [n for _, n in runs]) == cheapest(rows), rows


def test_long_runs_take_few_steps():
    repairer = repair.Repairer()
    user = repair.symbol_of("u", None)
    cost, audit = repairer.solve([user, repair.symbol_of("u", "truncated")], [300_001, 300_000])
    assert (cost, audit) == (450_000 + 6 + 4 * 299_999, "KR" * 150_000 + "KD" + "D" * 299_998 + "R")
    assert max(map(len, repairer.powers)) <= 20
    assert len(repairer.met) < 10_000


def plain(conversation):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and digest of rows (turn, role, text)."""
    rows = sorted(conversation, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        told = text.rstrip(BLANK)
        faults.append("blank" if not told else "duplicate" if (role, text) in seen else "" if told[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    symbols = [(r[1][:1], {"": "ok", "truncated": "cut"}.get(f, "go")) for r, f in zip(rows, faults)]
    cost, audit = cheapest(symbols)
    written, left = [], iter(rows)
    for letter in audit:
        row = next(left) if letter != "I" else (None, None, "")
        if letter == "K":
            written.append((row[1], row[2]))
        elif letter != "D":
            written.append(("assistant" if written and written[-1][0][0] == "u" else "user", row[2]))
    text = "\n".join(f"{r}:{t}" for r, t in written)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), written


def random_rows(seed):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why?  ", "cut off", "", " \t", "é.", "a\nb.", "." * 3, None]
    rows = []
    for conv in [None, *range(60)]:
        turn = rnd.randint(-3, 3)
        for _ in range(rnd.choice([1, 2, 4, 8, 30])):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "agent"])
            rows.append((conv, rnd.choice([turn] * 9 + [None]), role, rnd.choice(texts), "x", "x"))
            turn += rnd.choice([0, 1, 1, 1, 3])
    return rows + [(77, i, "user", "the same.", "x", "x") for i in range(4000)] + [(78, 1, "user", "word. " * 100_000, "x", "x")]


SCHEMA = "conv_id long, turn long, role string, text string, key string, audit string"


def test_repairs_by_brute_force(spark):
    rows = random_rows(5)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = {}
    for conv, turn, role, text, *_ in rows:
        expected.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    found = {r[0]: tuple(r)[1:] for r in repair.audit_conversations(frame).collect()}
    solved = {conv: plain(own) for conv, own in expected.items()}
    assert found == {conv: s[0] for conv, s in solved.items()}
    turns = repair.repair_conversations(frame).collect()
    for conv, (found_, written) in solved.items():
        own = [t for t in turns if t["conv_id"] == conv]
        kept = sorted((t for t in own if t["rank"] is not None), key=lambda t: t["rank"])
        assert [(t["role"], t["text"]) for t in kept] == written
        assert sorted(t["edit"] for t in own) == sorted(found_[6])


def test_damage(spark):
    rows = random_rows(6)
    frame = repair.damaged(spark.createDataFrame(rows, SCHEMA))
    expected = []
    for conv, turn, role, text, *_ in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        expected += [(conv, turn, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(expected, key=str)
    done = repair.audit_conversations(frame, gone=F.col("gone"))
    by_conv = {r[0]: [] for r in rows}
    for conv, turn, role, text, gone in expected:
        if not gone:
            by_conv[conv].append((turn, role, text))
    assert {r[0]: tuple(r)[1:] for r in done.collect()} == {c: plain(own)[0] for c, own in by_conv.items()}


def test_nothing_and_only_dropped_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.audit_conversations(empty).collect() == [] and repair.repair_conversations(empty).collect() == []
    frame = spark.createDataFrame([("a", 1, "user", "x."), ("a", 2, "user", "x.")], "conv_id string, turn int, role string, text string")
    gone = repair.audit_conversations(frame, gone=F.lit(True)).collect()
    assert [tuple(r) for r in gone] == [("a", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
