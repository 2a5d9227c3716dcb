"""Benchmark decontamination: token windows of documents against a set of benchmark n-grams.

Words are runs of 0-9, a-z (A-Z lower-cased) and anything outside ASCII. A window is ``WINDOW``
consecutive words of an item; an item with fewer words is one window. The windows go to the
tasks as a broadcast set of rolling hashes over word numbers; every position of a document
whose hash is in the set is verified against the window's word numbers, which are exact.

The set is held in arrays, all items' words as numbers and per window its hash, sorted, and where
it stands, beside a dictionary of the distinct words. That comes to ``WORD_BYTES`` per word and
``DISTINCT_BYTES`` per distinct word of the benchmark, which are counted first; it is cut into blocks
of about ``BLOCK_BYTES`` of index by a hash of the rows, so the broadcast is bounded. Documents pass the blocks one after another,
carrying the words hit so far; with one block, the usual case, that is a map without a shuffle.

Defined cases: null texts, and texts without words, have no words, are clean and, as items,
match nothing. Repeated items count as one id; items with a null id mark words but are not
listed. Repeated documents are judged one by one. Columns beside key and text are ignored when
matching, kept when cleaning.
"""

from __future__ import annotations

import math
import re
import string
import sys
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, frugal, portions, table

WINDOW = 10
BLOCK_BYTES = 64 << 20
#: Bytes of index per word (window hash 8, place 4, number 4) and per distinct word (entry, text, number).
WORD_BYTES = 16
DISTINCT_BYTES = 200

_IN_WORDS = set(string.digits.encode() + string.ascii_lowercase.encode()) | set(range(128, 256))
_WORD_BYTES = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else b if b in _IN_WORDS else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # of a text not lower-cased yet
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


def _hashes(numbers: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every ``width`` consecutive numbers."""
    spread = (numbers.astype(np.uint64) + np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
    spread ^= spread >> np.uint64(32)
    total = np.zeros(max(0, len(numbers) - width + 1), np.uint64)
    for offset in range(width):
        total = total * _BASE + spread[offset : offset + len(total)]
    return total


class WindowIndex:
    """The windows of benchmark items (id, text)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.items: list[str | None] = []
        self.numbers: dict[bytes, int] = {}
        coded = []
        for item, text in items:
            words = words_of(text)
            if words:
                self.items.append(item)
                coded.append(np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int32))
        self.words = np.concatenate([np.empty(0, np.int32), *coded])
        sizes = np.array([len(c) for c in coded], np.int64)
        self.begins = np.cumsum(sizes) - sizes  # of items, in ``words``
        self.seed = 0
        while not self._build(sizes, window):
            self.seed += 1

    def _build(self, sizes: np.ndarray, window: int) -> bool:
        """Hashes and places of windows by width; fails if two different windows have one hash."""
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        widths = np.minimum(sizes, window)
        for width in np.unique(widths).tolist():
            own = widths == width
            counts = sizes[own] - width + 1
            firsts = np.repeat(self.begins[own] - (np.cumsum(counts) - counts), counts)
            starts = (firsts + np.arange(counts.sum())).astype(np.int32)
            hashes = _hashes(self.words, width, self.seed)[starts]
            order = np.argsort(hashes, kind="stable")
            hashes, starts = hashes[order], starts[order]
            equal = np.flatnonzero(hashes[1:] == hashes[:-1])
            for begin in range(0, len(equal), 1 << 16):
                part = equal[begin : begin + (1 << 16)]
                if not self._same(starts[part], self.words, starts[part + 1], width).all():
                    return False
            self.windows[width] = hashes, starts
        return True

    def _same(self, starts: np.ndarray, words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Whether the windows at ``starts`` are those at ``at`` in other words."""
        steps = np.arange(width)
        return (self.words[starts[:, None] + steps] == words[at[:, None] + steps]).all(axis=1)

    def nbytes(self) -> int:
        """Bytes in memory; words are taken at what a short one costs in a dictionary."""
        arrays = self.words.nbytes + self.begins.nbytes + sum(a.nbytes + b.nbytes for a, b in self.windows.values())
        return arrays + sys.getsizeof(self.numbers) + sum(sys.getsizeof(w) + 32 for w in self.numbers)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items that own those windows."""
        numbered = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int32, len(words))
        marks = np.zeros(len(words) + 1, np.int64)
        owners: list[np.ndarray] = []
        strange = np.concatenate([[0], np.cumsum(numbered < 0)])
        for width, (known, starts) in self.windows.items():
            if len(words) < width:
                continue
            possible = np.flatnonzero(strange[width:] == strange[:-width])
            if not len(possible):
                continue
            hashes = _hashes(numbered, width, self.seed)[possible]
            first = np.searchsorted(known, hashes)
            found = known[np.minimum(first, len(known) - 1)] == hashes
            at, first, hashes = possible[found], first[found], hashes[found]
            real = self._same(starts[first], numbered, at, width)
            at, first, hashes = at[real], first[real], hashes[real]
            marks[at] += 1
            marks[at + width] -= 1
            runs, where = np.unique(first, return_index=True)
            ends = np.searchsorted(known, hashes[where], "right")
            owners += [np.unique(np.searchsorted(self.begins, starts[b:e], "right") - 1) for b, e in zip(runs, ends)]
        items = {self.items[k] for k in np.unique(np.concatenate(owners)).tolist()} if owners else set()
        return np.cumsum(marks[:-1]) > 0, items - {None}


def benchmark_blocks(
    items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> Iterator[WindowIndex]:
    """Indexes over all items, each of about ``block_bytes`` at most."""
    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    words = rows.select(F.explode(F.regexp_extract_all("text", F.lit(_WORD.pattern), F.lit(0))).alias("word"))
    counted = words.agg(F.count("word").alias("all"), F.count_distinct("word").alias("distinct")).first()
    blocks = max(1, math.ceil((counted["all"] * WORD_BYTES + counted["distinct"] * DISTINCT_BYTES) / block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for k in range(blocks):
        part = rows.where(block == k).distinct().collect()  # bounded by block_bytes
        yield WindowIndex([(r["item"], r["text"]) for r in part], window)


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns ``key``, n_words, hit_words (positions), items (ids as strings, sorted)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, text string, n_words long, hit_words array<int>, items array<string>"
    state = docs.select(
        key,
        F.col(text).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("hit_words"),
        F.array().cast("array<string>").alias("items"),
    )
    indexes = benchmark_blocks(items, item_key, window=window, block_bytes=block_bytes)
    for number, index in enumerate(indexes):
        if number:
            state = checkpointed(state)
        state = state.mapInArrow(frugal(_matcher(state, index)), schema)
    return state.drop("text")


def _matcher(docs: DataFrame, index: WindowIndex):
    shared = docs.sparkSession.sparkContext.broadcast(index)  # one block

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                counts, positions, owners = [], [], []
                for text, before, named in zip(*(part.column(n) for n in ("text", "hit_words", "items"))):
                    words = words_of(text.as_py())
                    hit, items = shared.value.hits(words)
                    hit[before.values.to_numpy()] = True
                    counts.append(len(words))
                    positions.append(np.flatnonzero(hit))
                    owners.append(sorted(items.union(named.as_py())))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column("text"),
                        pa.array(counts, pa.int64()),
                        pa.array(positions, pa.list_(pa.int32())),
                        pa.array(owners, pa.list_(pa.string())),
                    ],
                    names=part.schema.names,
                )

    return match


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", window: int = WINDOW
) -> DataFrame:
    """Rows of ``docs``, all columns, in which no benchmark window occurs; a filter in place."""
    for number, index in enumerate(benchmark_blocks(items, item_key, window=window)):
        if number:
            docs = checkpointed(docs)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not shared.value.hits(words_of(t.as_py()))[0].any() for t in batch.column(text)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(frugal(keep), docs.schema)
    return docs


def cut_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", window: int = WINDOW
) -> DataFrame:
    """``docs``, all rows and columns, with every stretch of hit words cut out of the text."""
    for number, index in enumerate(benchmark_blocks(items, item_key, window=window)):
        if number:
            docs = checkpointed(docs)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def cut(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t and without(t, shared.value.hits(words_of(t))[0]) for t in batch.column(text).to_pylist()]
                at = batch.schema.get_field_index(text)
                field = batch.schema.field(at)
                yield batch.set_column(at, field, pa.array(texts, field.type))

        docs = docs.mapInArrow(cut, docs.schema)
    return docs


def without(text: str, hit: np.ndarray) -> str:
    """``text`` without the stretches from the first to the last word of each run of hit words."""
    if not hit.any():
        return text
    spans = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()
    parts, done = [], 0
    for first, stop in zip(edges[::2], edges[1::2]):
        parts.append(text[done : spans[first][0]])
        done = spans[stop - 1][1]
    return "".join(parts) + text[done:]


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE = {
    "op2_decontamination": f"""
        WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
             b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
             s AS (SELECT item, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
             g AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k
                   FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM s)),
             p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
                   FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
                         FROM d, (SELECT DISTINCT n FROM s))),
             h AS (SELECT DISTINCT doc_id, n, i, item FROM p JOIN g USING (n, k)),
             c AS (SELECT doc_id, count(DISTINCT j) AS n_hit
                   FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM h) GROUP BY doc_id),
             t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                   FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
