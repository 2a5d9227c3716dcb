"""Perfect hash and line deduplication against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import line_dedup
from millrace.llm.perfect_hash import CountIndex, CountShard, shard_of

BLANK = " \t\n\x0b\x0c\r"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def keys(n, seed=1):
    values = np.frombuffer(np.random.default_rng(seed).bytes(16 * n), np.uint64).reshape(2, n)
    return values[0], values[1]


@pytest.mark.parametrize("n", [0, 1, 63, 5000, 300_000])
def test_perfect_hash_is_minimal(n):
    high, low = keys(n)
    counts = np.arange(n, dtype=np.int64) + 1
    shard = CountShard.build(high, low, counts)
    assert sorted(shard.slots(high, low).tolist()) == list(range(n))
    assert (shard.lookup(high, low) == counts).all()
    assert not shard.lookup(*keys(1000, 2)).any()
    assert shard.bits.nbytes * 8 <= 4 * n + 64 * len(shard.levels)
    again = CountShard.of_row(*[c[0].as_py() for c in shard.row(3).columns[1:]])
    assert (again.lookup(high, low) == counts).all()


def test_perfect_hash_of_large_counts_and_equal_halves():
    high, low = np.array([1, 2, 1], np.uint64), np.array([7, 7, 8], np.uint64)
    counts = np.array([1 << 40, 5, 6])
    shard = CountShard.build(high, low, counts)
    assert CountShard.of_row(*[c[0].as_py() for c in shard.row(0).columns[1:]]).lookup(high, low).tolist() == counts.tolist()


def test_index_of_shards():
    high, low = keys(20_000)
    own = shard_of(low, 7)
    assert set(own.tolist()) == set(range(7))
    shards = {s: CountShard.build(high[own == s], low[own == s], np.full((own == s).sum(), 9)) for s in range(6)}
    found = CountIndex(7, shards).lookup(high, low)
    assert (found == np.where(own < 6, 9, 0)).all()


def brute(texts, least, min_chars):
    split = [(t or "").split("\n") for t in texts]
    named = [[line.strip(BLANK).translate(LOWER) for line in lines] for lines in split]
    found = Counter(k for own in named for k in set(own) if len(k) >= min_chars)
    gone = {k for k, n in found.items() if n >= least}
    return [
        (len(lines), sum(k in gone for k in own), "\n".join(x for x, k in zip(lines, own) if k not in gone))
        for lines, own in zip(split, named)
    ]


@pytest.mark.parametrize("way", [{}, {"resident_bytes": 0, "shard_keys": 3}, {"min_chars": 3}, {"min_documents": 1}])
def test_lines_by_brute_force(spark, way, monkeypatch):
    monkeypatch.setattr(line_dedup, "COLLECTED_KEYS", 50)
    monkeypatch.setattr(line_dedup, "COLLECTED_BYTES", 2000)
    rnd = random.Random(4)
    line = lambda: rnd.choice(["", " ", "A b", "a B ", "\ta b\r", "É x", "é x", " a b", "日本", "x\x1c", f"only {rnd.random()}"])
    texts = [None, "", "\n", "\n\n a b", "a b\r\n"] + ["\n".join(line() for _ in range(rnd.randint(1, 9))) for _ in range(120)]
    texts += ["the same text\nof a third"] * 60 + ["\n".join(f"line {i % 977}" for i in range(50_000)), "word " * 300_000]
    rows = [(i % 150 if i % 40 else None, t, "x", "x", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, digest string, n_lines int").repartition(5)
    done = line_dedup.drop_common_lines(docs, **{"min_documents": 10, **way})
    assert done.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    expected = Counter(
        (row[0], *e) for row, e in zip(rows, brute(texts, way.get("min_documents", 10), way.get("min_chars", 1)))
    )
    assert Counter(tuple(r) for r in done.collect()) == expected


@pytest.mark.parametrize("resident", [line_dedup.RESIDENT_BYTES, -1])
def test_no_documents_and_other_key_types(spark, resident):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert line_dedup.drop_common_lines(docs, resident_bytes=resident).collect() == []
    docs = spark.createDataFrame([("a", "x\ny"), ("b", "X"), ("b", "X")], "name string, body string")
    done = line_dedup.drop_common_lines(docs, "name", "body", min_documents=3, resident_bytes=resident)
    assert Counter(map(tuple, done.collect())) == Counter({("a", 2, 1, "y"): 1, ("b", 1, 1, ""): 2})
