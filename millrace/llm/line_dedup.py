"""Line deduplication: lines that many documents have go from all of them.

A line's key is the line without blanks at both ends, A-Z in lower case. Keys are counted as
128-bit hashes: a task counts the documents of each key in a collection of texts and sends one
row per key, Spark adds them up. The distinct hashes found in enough documents are dealt into
shards, and each shard becomes a minimal perfect hash that indexes an array of fingerprints and
one of counts (``perfect_hash``). The shards are written once; documents hash their lines and
probe the arrays, lines are never joined.

How documents reach the arrays depends on the measured size of these. Up to ``RESIDENT_BYTES``
all shards are sent to the tasks, which probe while they read: no text is shuffled. Beyond that
tasks deal the hashes of a collection's lines by shard, every shard answers which of them it
holds, and the answers meet the texts by text digest. Both ways give the same rows.

Keys are equal when their 128 bits are; a line that is not in the index passes for one that is
only if it agrees in the 64 bits of a fingerprint: about 3 * 10^-8 such lines are expected in
100 TB of text.

Defined cases: a null or empty text is one empty line. A text ends after its last line feed with
one more line, which may be empty. Every row is a document of its own, also where ids repeat or
are null. Empty keys, and keys shorter than ``min_chars``, are never counted and stay. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, portions, table
from millrace.llm.perfect_hash import KEY_BYTES, SHARDS, CountIndex, CountShard, shard_of

MIN_DOCUMENTS = 10
MIN_CHARS = 1
SHARD_KEYS = 1_000_000
RESIDENT_BYTES = 64 << 20
COLLECTED_KEYS = 200_000
COLLECTED_BYTES = 32 << 20

Hashes = tuple[np.ndarray, np.ndarray]


def lines_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def keys_of(text: bytes | None, min_chars: int) -> list[bytes]:
    """Key of each line; empty where the line is never counted."""
    keys = [line.strip() for line in lines_of((text or b"").lower())]  # bytes: 20 and 09 to 0D, A to Z only
    return keys if min_chars <= 1 else [k if len(k.decode()) >= min_chars else b"" for k in keys]


def hashes_of(keys: list[bytes]) -> Hashes:
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
    return digests[:, 0], digests[:, 1]


def _texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def count_lines(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Columns high, low, documents: in how many documents each key occurs, by hash."""

    def rows(counts: Counter) -> pa.RecordBatch:
        high, low = hashes_of(list(counts))
        arrays = [high.view(np.int64), low.view(np.int64), np.fromiter(counts.values(), np.int64, len(counts))]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["high", "low", "documents"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = Counter(), 0
        for batch in batches:
            for text_ in _texts(batch):
                keys = set(keys_of(text_, min_chars))
                counts.update(keys)
                held += len(text_ or b"")
                if len(counts) >= COLLECTED_KEYS or held >= COLLECTED_BYTES:
                    counts.pop(b"", None)
                    yield rows(counts)
                    counts, held = Counter(), 0
        counts.pop(b"", None)
        yield rows(counts)

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "high long, low long, documents long")
    return counted.groupBy("high", "low").agg(F.sum("documents").alias("documents"))


def line_index(counts: DataFrame, min_documents: int = MIN_DOCUMENTS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """The shards over the keys of at least ``min_documents`` documents, written once, their number and that of their keys."""
    common = checkpointed(counts.where(F.col("documents") >= min_documents))
    keys = common.count()
    shards = max(1, math.ceil(keys / shard_keys))
    number = F.shiftrightunsigned(F.shiftrightunsigned("low", 32) * shards, 32).cast("int")  # as shard_of

    def build(part: pa.Table) -> pa.Table:
        high, low = (part.column(n).to_numpy().view(np.uint64) for n in ("high", "low"))
        return CountShard.build(high, low, part.column("documents").to_numpy()).row(part.column("shard")[0].as_py())

    return checkpointed(common.withColumn("shard", number).groupBy("shard").applyInArrow(build, SHARDS)), shards, keys


def _dropping(key: str, min_chars: int, is_common: Callable[[pa.RecordBatch, list[bytes], Hashes], np.ndarray]):
    """Task that drops the lines whose key ``is_common`` names, given the distinct keys of some texts."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                texts = _texts(part)
                keys = [keys_of(t, min_chars) for t in texts]
                distinct = list(set().union(*keys) - {b""})
                common = is_common(part, distinct, hashes_of(distinct))
                gone = set(map(distinct.__getitem__, np.flatnonzero(common).tolist()))
                sizes, dropped, kept = [], [], []
                for text, own in zip(texts, keys):
                    sizes.append(len(own))
                    if gone.isdisjoint(own):
                        kept.append(text or b"")
                        dropped.append(0)
                    else:
                        stay = [line for line, k in zip(lines_of(text), own) if k not in gone]
                        kept.append(b"\n".join(stay))
                        dropped.append(len(own) - len(stay))
                arrays = [pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("key"), *arrays], names=[key, "n_lines", "n_dropped", "kept"])

    return drop


def _probe_here(docs: DataFrame, shards: DataFrame, number: int, drop_schema: str, key: str, min_chars: int) -> DataFrame:
    """All shards in every task."""
    rows = shards.collect()  # at most RESIDENT_BYTES, measured by the caller
    shared = docs.sparkSession.sparkContext.broadcast(
        CountIndex(number, {r["shard"]: CountShard.of_row(*list(r)[1:]) for r in rows})
    )

    def is_common(part, keys, hashes):
        return shared.value.lookup(*hashes) > 0

    return docs.select("key", "text").mapInArrow(_dropping(key, min_chars, is_common), drop_schema)


REQUESTS = "shard int, digests binary, owners binary, high binary, low binary"
ANSWERS = "digest binary, found binary"


def _ask(number: int, min_chars: int):
    """Lines of some texts by shard; each text stands there once, by its digest."""

    def rows(texts: dict[bytes, Hashes]) -> pa.RecordBatch:
        out = []
        if texts:
            digests = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, 32)
            sizes = [len(h) for h, _ in texts.values()]
            owners = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
            high, low = (np.concatenate(a) for a in zip(*texts.values()))
            shard = shard_of(low, number)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            for at in np.split(order, cuts) if len(order) else ():
                own, local = np.unique(owners[at], return_inverse=True)
                packed = (digests[own], local.astype(np.int32), high[at], low[at])
                out.append((int(shard[at[0]]), *(np.ascontiguousarray(p).tobytes() for p in packed)))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int32(), *[pa.binary()] * 4)
        names = [part.split()[0] for part in REQUESTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = {}, 0
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), _texts(batch)):
                if digest not in texts:
                    keys = list(set(keys_of(text, min_chars)) - {b""})
                    texts[digest] = hashes_of(keys)
                    held += 64 + 16 * len(keys)
                    if held >= COLLECTED_BYTES:
                        yield rows(texts)
                        texts, held = {}, 0
        yield rows(texts)

    return ask


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's arrays come before the requests to it; one shard is held at a time."""
    number, shard = None, None
    for batch in batches:
        digests, found = [], []
        for row in batch.to_pylist():
            if row["fingerprints"] is not None:
                number = row["shard"]
                shard = CountShard.of_row(row["levels"], row["bits"], row["fingerprints"], row["counts"])
            elif row["shard"] == number:
                high, low = (np.frombuffer(row[n], np.uint64) for n in ("high", "low"))
                owners = np.frombuffer(row["owners"], np.int32)
                hit = np.flatnonzero(shard.lookup(high, low) > 0)
                hit = hit[np.lexsort((high[hit], low[hit], owners[hit]))]  # equal texts get equal answers
                pairs = np.stack([high[hit], low[hit]], axis=1)
                for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(owners[hit])) + 1):
                    if len(part):
                        own = int(owners[hit[part[0]]])
                        digests.append(row["digests"][32 * own : 32 * own + 32])
                        found.append(pairs[part].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(found, pa.binary())], names=["digest", "found"])


def _probe_there(docs: DataFrame, shards: DataFrame, number: int, drop_schema: str, key: str, min_chars: int) -> DataFrame:
    """Hashes go to the shards, answers come back to the texts."""
    digested = docs.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    requests = digested.select("digest", "text").mapInArrow(_ask(number, min_chars), REQUESTS)
    both = shards.unionByName(requests, allowMissingColumns=True).withColumn("later", F.col("fingerprints").isNull())
    met = both.repartition("shard").sortWithinPartitions("shard", "later").drop("later")
    # a text that repeats asks once per collection and always gets the same answers: as a set they are no more than its lines
    answers = met.mapInArrow(_answer, ANSWERS).groupBy("digest").agg(F.collect_set("found").alias("found"))
    joined = digested.join(answers, "digest", "left").select("key", "text", "found")

    def is_common(part, keys, hashes):
        flat = b"".join(f for found in part.column("found").to_pylist() for f in found or ())
        there = np.unique(np.frombuffer(flat, np.dtype([("high", np.uint64), ("low", np.uint64)])))
        own = np.empty(len(keys), there.dtype)
        own["high"], own["low"] = hashes
        return np.isin(own, there)

    return joined.mapInArrow(_dropping(key, min_chars, is_common), drop_schema)


def drop_common_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
    shard_keys: int = SHARD_KEYS,
    resident_bytes: int = RESIDENT_BYTES,
) -> DataFrame:
    """Columns ``key``, n_lines, n_dropped, kept (the other lines joined by line feeds)."""
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shards, number, keys = line_index(count_lines(picked, "text", min_chars), min_documents, shard_keys)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_lines long, n_dropped long, kept string"
    probe = _probe_here if keys * KEY_BYTES <= resident_bytes else _probe_there
    return probe(picked, shards, number, schema, key, min_chars)


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the lines that ten or more of them have."""
    done = drop_common_lines(table(spark, folder, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op13_line_dedup": op13_line_dedup}
ORACLE = {
    "op13_line_dedup": f"""
        WITH l AS (SELECT doc_id, n, i, lines[i] AS line,
                          translate(trim(lines[i], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
                   FROM (SELECT doc_id, n, lines, unnest(generate_series(1, len(lines))) AS i
                         FROM (SELECT doc_id, row_number() OVER () AS n,
                                      string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
             c AS (SELECT k FROM l WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT n) >= {MIN_DOCUMENTS})
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.k IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN c ON l.k = c.k GROUP BY n"""
}
