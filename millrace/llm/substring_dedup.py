"""Substring deduplication: windows of words that an earlier document has as well.

Every window of ``WIDTH`` consecutive words gets a Rabin-Karp hash. Tasks collect the windows of
some documents, keep the smallest document of each hash and send one entry per hash, packed by
ranges of hashes; what repeats within the collection is marked on the spot, so a passage that a
third of all rows share is one entry per collection. Ranges are counted by Spark: a hash that
several entries hold is marked for all but the smallest document. The marks go back to their
documents, where the windows are hashed again and marked ones merge into maximal intervals.

Memory: a collection holds about ``COLLECTED`` windows, a range of hashes about those of
``RANGE_BYTES`` of text; the number of ranges, a power of two, follows the measured size of the
table, so ranges stay alike at any size. A collection is cut into at most ``2**COARSE_BITS``
ranges, so its rows and the windows of a row stay alike as well; where there must be more ranges
(from some 32 GB of text on), entries of a coarse range are brought together first and cut again
there, some million windows at a time. Hashes have 64 bits: among n different windows about
n^2 / 2^65 pairs share one by chance (0.0004 pairs for the 125 million windows of 0.9 GB of text).

Defined cases: null and empty texts have no words and lose none. A row with a null id keeps all
words and makes no other row lose any. Rows with the same id do not count as earlier than one
another; they are told apart by a hash of the text. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import portions, table
from millrace.llm.hashing import WordHashes, window_hashes

WIDTH = 50
COLLECTED = 1_000_000
COLLECTED_DOCUMENTS = 60_000
RANGE_BYTES = 8 << 20
COARSE_BITS = 12
REFINED = 2_000_000

ENTRIES = "range int, doc_id long, digest long, whole boolean, documents binary, owners binary, hashes binary"
MARKS = "doc_id long, digest long, whole boolean, hash long"
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
#: A document of an entry: its id and the hash of its text.
DOCUMENT = np.dtype([("id", np.int64), ("digest", np.int64)])


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # splits at 20 and 09 to 0D only


def _pack(values: np.ndarray) -> bytes:
    """Byte planes: those of sorted numbers compress well in the shuffle."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()


def _unpack(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _range_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _entries(documents: np.ndarray, owners: np.ndarray, hashes: np.ndarray, bits: int) -> list[tuple]:
    """Rows of ``ENTRIES`` by range, of sorted hashes."""
    rows = []
    for number, part in _runs(_range_of(hashes, bits), np.arange(len(hashes))):
        own, local = np.unique(owners[part], return_inverse=True)
        packed = _pack(local.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32))
        rows.append((number, None, None, None, documents[own].tobytes(), packed, _pack(hashes[part])))
    return rows


class _Collection:
    """Distinct windows of some documents."""

    def __init__(self, bits: int):
        self.bits = bits
        self.documents: dict[tuple[int, int], np.ndarray] = {}
        self.windows = 0

    def add(self, document: int, digest: int, hashes: np.ndarray) -> None:
        if len(hashes) and (document, digest) not in self.documents:
            own = self.documents[document, digest] = np.unique(hashes)
            self.windows += len(own)

    def full(self) -> bool:
        return self.windows >= COLLECTED or len(self.documents) >= COLLECTED_DOCUMENTS

    def rows(self) -> list[tuple]:
        """Entries by range, and marks for what repeats within the collection."""
        if not self.documents:
            return []
        order = sorted(self.documents)
        documents = np.array(order, DOCUMENT)
        ids = documents["id"]
        sizes = np.array([len(self.documents[d]) for d in order])
        hashes = np.concatenate([self.documents[d] for d in order])
        owners = np.repeat(np.arange(len(ids)), sizes)
        at = np.argsort(hashes, kind="stable")  # equal hashes stay by document
        hashes, owners = hashes[at], owners[at]
        first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        group = np.flatnonzero(first)[np.cumsum(first) - 1]
        marked = ids[owners] > ids[owners[group]]
        rows = []
        at = np.argsort(owners[marked], kind="stable")
        for owner, found in _runs(owners[marked][at], hashes[marked][at]):
            whole = len(found) == sizes[owner]
            name = (owner & ((1 << self.bits) - 1), *map(int, documents[owner].tolist()))
            rows.append((*name, whole, None, None, b"" if whole else found.tobytes()))
        # of one id, every text has to hear of an earlier document: each of the smallest id stays
        smallest = ids[owners] == ids[owners[group]]
        self.documents, self.windows = {}, 0
        return rows + _entries(documents, owners[smallest], hashes[smallest], self.bits)


def _runs(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Values by key, of arrays sorted by key."""
    if len(keys):
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            yield int(keys[begin]), values[begin:end]


def _batch(rows: list[tuple], kinds: tuple[pa.DataType, ...], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _collector(width: int, bits: int):
    names = [part.split()[0] for part in ENTRIES.split(", ")]

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of, collection = WordHashes(), _Collection(bits)
        for batch in batches:
            for document, digest, text in zip(*(batch.column(n) for n in ("doc_id", "digest", "text"))):
                if document.is_valid:
                    hashes = window_hashes(hashes_of.of(words_of(text.as_py())), width)
                    collection.add(document.as_py(), digest.as_py(), hashes)
                    if collection.full():
                        yield _batch(collection.rows(), _KINDS, names)
        yield _batch(collection.rows(), _KINDS, names)

    return collect


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each window of an entry."""
    hashes = _unpack(row["hashes"], np.uint64)
    kind = np.uint16 if len(row["owners"]) == 2 * len(hashes) else np.uint32
    return np.frombuffer(row["documents"], DOCUMENT)[_unpack(row["owners"], kind)], hashes


def _refiner(coarse: int, bits: int):
    """Cuts the entries of coarse ranges, which come one after the other, into fine ranges."""
    names = [part.split()[0] for part in ENTRIES.split(", ")]

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows, current = [], 0, None

        def rows() -> list[tuple]:
            owners, hashes = (np.concatenate(parts) for parts in zip(*held))
            order = np.argsort(hashes, kind="stable")
            documents, local = np.unique(owners[order], return_inverse=True)
            return _entries(documents, local, hashes[order], bits)

        for batch in batches:
            for row in batch.to_pylist():
                if row["doc_id"] is not None:
                    yield _batch([tuple(row[n] for n in names)], _KINDS, names)
                    continue
                if held and (row["range"] != current or windows >= REFINED):
                    yield _batch(rows(), _KINDS, names)
                    held, windows = [], 0
                current = row["range"]
                held.append(_unpacked(row))
                windows += len(held[-1][1])
        if held:
            yield _batch(rows(), _KINDS, names)

    return refine


def _count_range(entries: pa.Table) -> pa.Table:
    """Marks of one range: hashes of several entries, for all documents but the smallest.

    One row per mark, so that their number follows the input whatever the number of ranges.
    """
    owners, hashes, marked_documents, marked, whole = [], [], [], [], []
    for row in entries.to_pylist():
        if row["doc_id"] is None:
            documents, found = _unpacked(row)
            owners.append(documents)
            hashes.append(found)
        elif row["whole"]:
            whole.append((row["doc_id"], row["digest"]))
        else:
            marked.append(np.frombuffer(row["hashes"], np.uint64))
            marked_documents.append(np.full(len(marked[-1]), np.array((row["doc_id"], row["digest"]), DOCUMENT)))
    if hashes:
        all_owners, all_hashes = np.concatenate(owners), np.concatenate(hashes)
        order = np.lexsort((all_owners["id"], all_hashes))
        all_owners, all_hashes = all_owners[order], all_hashes[order]
        first = np.concatenate([[True], all_hashes[1:] != all_hashes[:-1]])
        later = np.flatnonzero(all_owners["id"] > all_owners["id"][np.flatnonzero(first)[np.cumsum(first) - 1]])
        marked_documents.append(all_owners[later])
        marked.append(all_hashes[later])
    found = np.concatenate([np.array(whole, DOCUMENT), *marked_documents])
    is_whole = np.arange(len(found)) < len(whole)
    values = np.concatenate([np.zeros(len(whole), np.int64), *(m.view(np.int64) for m in marked)])
    arrays = [pa.array(np.ascontiguousarray(found[n])) for n in ("id", "digest")]
    arrays += [pa.array(is_whole), pa.array(values, mask=is_whole)]
    return pa.table(arrays, names=[part.split()[0] for part in MARKS.split(", ")])


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Columns doc_id, digest, whole, hash: a row per marked window, or one where all of a document are."""
    picked = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1.0, size / RANGE_BYTES))))
    coarse = min(bits, COARSE_BITS)
    entries = picked.mapInArrow(_collector(width, coarse), ENTRIES)
    if bits > coarse:
        entries = entries.repartition("range").sortWithinPartitions("range").mapInArrow(_refiner(coarse, bits), ENTRIES)
    return entries.groupBy("range").applyInArrow(_count_range, MARKS)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Columns ``key``, n_words, removed (intervals of words), kept (words joined by spaces)."""
    marks = (
        find_repeats(docs, key, text, width)
        .groupBy("doc_id", "digest")
        .agg(F.collect_set("hash").alias("marks"), F.max("whole").alias("whole"))  # no more than the windows of a text
    )
    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    same = (picked["key"].cast("long") == marks["doc_id"]) & (F.xxhash64(picked["text"]) == marks["digest"])
    joined = picked.join(marks, same, "left").drop("doc_id", "digest")
    schema = f"`{key}` {kind}, n_words long, removed array<struct<begin: int, end: int>>, kept string"
    interval = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = WordHashes()
        for batch in batches:
            for part in portions(batch, "text"):
                rows = []
                for value, marked, whole in zip(*(part.column(n) for n in ("text", "marks", "whole"))):
                    words = words_of(value.as_py())
                    edges = _intervals(words, marked.as_py(), whole.as_py(), width, hashes_of)
                    kept, done = [], 0
                    for begin, end in edges:
                        kept += words[done:begin]
                        done = end
                    kept += words[done:]
                    spans = [{"begin": b, "end": e} for b, e in edges]
                    rows.append((len(words), spans, b" ".join(kept).decode()))
                columns = list(zip(*rows)) or [()] * 3
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), interval, pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *arrays], names=[key, "n_words", "removed", "kept"]
                )

    return joined.select("key", "text", "marks", "whole").mapInArrow(remove, schema)


def _intervals(words, marked, whole, width: int, hashes_of: WordHashes) -> list[tuple[int, int]]:
    """Maximal intervals of words that marked windows cover."""
    if len(words) < width:
        return []
    if whole:
        return [(0, len(words))]
    if not marked:
        return []
    hashes = window_hashes(hashes_of.of(words), width)
    starts = np.flatnonzero(np.isin(hashes, np.array(marked, np.int64).view(np.uint64)))
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > width)
    begins = starts[np.concatenate([[0], cuts + 1])]
    ends = starts[np.concatenate([cuts, [len(starts) - 1]])] + width
    return list(zip(begins.tolist(), ends.tolist()))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stay when windows an earlier document has are removed."""
    done = remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


_SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE = {
    "op6_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
             p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WIDTH} - 1], ' ')) AS k
                   FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WIDTH} + 1)) AS i FROM d)),
             m AS (SELECT k, min(doc_id) AS owner FROM p GROUP BY k),
             r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {WIDTH} - 1)) AS j
                   FROM p JOIN m USING (k) WHERE doc_id > owner),
             e AS (SELECT doc_id, list(j) AS js FROM r GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN js IS NULL THEN w
                   ELSE list_filter(w, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN e USING (doc_id)"""
}
