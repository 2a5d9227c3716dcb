"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find groups.

A document's set holds the hashes of its distinct word shingles. Its signature is a
SuperMinHash: every element runs through the slots in the order of its own random permutation,
visiting slot p(j) with the value j + r; a slot keeps its least value. Since values of step j
lie below those of step j + 1, all elements take a step together and stop once every slot is
filled. Signatures are cut into ``BANDS`` bands of ``ROWS`` slots; documents that share a band
are candidates. With 32 bands of 4 rows two documents of similarity 0.85 share none with a
probability of 6e-11, those of 0.8 with 5e-8.

Equal sets are one class, represented by its smallest id, before anything is paired. Links
between classes are then found in two passes, each confirmed on full sets:

1. Every class of a band is compared with the band's least class, its hub. Hubs of many
   candidates are dealt out in portions, each with the hub's set.
2. Classes that candidates connect but links so far do not are compared with one another in
   blocks of bounded size: each class outside the largest linked part with every other class of
   its cluster. Only confirmed links leave a task, pairs are never listed.

So no link between candidates is lost and no pair within a linked group is looked at twice.
Links become groups by union-find (components.py).

Defined cases: null and empty texts, or texts without words, have the empty set and are linked
with nothing: each is a group of its own. Fewer words than a shingle make one shingle of all.
Rows with the same id are told apart by their sets, which are all compared; a row with a null id
is not compared, its group is null and it is kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, frugal, table
from millrace.llm.components import Forest, connected_components
from millrace.llm.hashing import WordHashes, mixed, window_hashes

BANDS = 32
ROWS = 4
HUB_PORTION = 500
SALTS = 32
BLOCK_SHINGLES = 200_000
BLOCK_CLASSES = 400
COLUMNS_AT_ONCE = 4096

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``words`` words; links at ``percent`` % of the union or more."""

    words: int = 5
    percent: int = 80

    def linked(self, shared, left, right):
        """Exact, on whole numbers or arrays of them."""
        return 100 * shared >= self.percent * (left + right - shared)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []  # splits at 20 and 09 to 0D


def shingles(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a document."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes.of(words), min(size, len(words))))


def superminhash(elements: np.ndarray, slots: int = BANDS * ROWS) -> np.ndarray:
    """Signature of a set of hashes: per slot the step in the high half, r in the low half."""
    signature = np.full(slots, np.iinfo(np.int64).max, np.int64)
    orders = None  # per element its permutation, as far as it has been drawn
    for step in range(slots if len(elements) else 0):
        drawn = mixed(elements + np.uint64((step + 1) * _STEP & (1 << 64) - 1))
        value = (drawn & np.uint64(0xFFFFFFFF)).astype(np.int64) | (step << 32)
        at = step + ((drawn >> np.uint64(32)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
        if step == 0:
            visited, first = at, at
        else:
            if orders is None:
                orders = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                every = np.arange(len(elements))
                orders[every, first], orders[every, 0] = 0, first
            visited = orders[every, at].astype(np.int64)
            orders[every, at] = orders[every, step]
        np.minimum.at(signature, visited, value)
        if (signature < (step + 1) << 32).all():
            break
    return signature


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band."""
    parts = signature.reshape(bands, -1)
    return np.array(
        [xxhash.xxh3_64_intdigest(part.tobytes(), seed=k) for k, part in enumerate(parts)], np.uint64
    ).view(np.int64)


def sketch(docs: DataFrame, key: str, text: str, similarity: Similarity) -> DataFrame:
    """Columns doc_id, n_shingles, set_digest, bands; one row per input row."""
    schema = "doc_id long, n_shingles long, set_digest binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, digests, bands = [], [], []
            for value in batch.column(1):
                found = shingles(words_of(value.as_py()), similarity.words, hashes)
                counts.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(band_keys(superminhash(found)) if len(found) else np.empty(0, np.int64))
            arrays = [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_shingles", "set_digest", "bands"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(frugal(run), schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, similarity: Similarity) -> DataFrame:
    """Columns id, shingles (packed) of the ids in ``wanted``, a row for each row of such an id."""
    schema = "id long, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(words_of(t.as_py()), similarity.words, hashes) for t in batch.column(1)]
            packed = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["id", "shingles"])

    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return named.join(wanted, "id", "left_semi").mapInArrow(frugal(run), schema)


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _confirm_with_hub(similarity: Similarity):
    """Links of hubs with members that follow them, in partitions sorted by hub, portion, member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, open_ = None, [], False
        for batch in batches:
            found = []
            for center, member, packed in zip(*(batch.column(n) for n in ("hub", "member", "shingles"))):
                center, member = center.as_py(), member.as_py()
                values = np.frombuffer(packed.as_py(), np.uint64)
                if member is None:  # a portion begins with the hub, one row per set of that id
                    hub, own, open_ = center, [*own, values] if open_ and hub == center else [values], True
                    continue
                open_ = False
                if hub == center and any(similarity.linked(_shared(o, values), len(o), len(values)) for o in own):
                    found.append((center, member))
            yield _links(found)

    return run


def hub_links(pairs: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """Columns a, b: the pairs (hub, member) that are links."""
    portions = F.ceil(F.count("*") / HUB_PORTION).cast("int")
    hubs = pairs.groupBy("hub").agg(portions.alias("portions"))
    # members of one hub are looked up in as many tasks as there are salts
    salted = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("member", F.lit(9)), F.lit(SALTS)).cast("int")
    portion = F.pmod(F.xxhash64("member"), F.col("portions").cast("long")).cast("int")
    members = pairs.withColumn("salt", salt).join(salted, ["hub", "salt"])
    members = members.select("hub", portion.alias("portion"), "member")
    members = members.join(sets, members["member"] == sets["id"]).select("hub", "portion", "member", "shingles")
    centers = hubs.join(sets, hubs["hub"] == sets["id"]).select(
        "hub",
        F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"),
        F.lit(None).cast("long").alias("member"),
        "shingles",
    )
    dealt = members.unionByName(centers).repartition("hub", "portion")
    ordered = dealt.sortWithinPartitions("hub", "portion", F.col("member").asc_nulls_first())
    return ordered.mapInArrow(frugal(_confirm_with_hub(similarity)), "a long, b long")


def _counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of 0/1 tiles."""
    total = np.zeros((len(left), len(right)), np.float32)
    known = np.unique(np.concatenate(left))
    known = np.intersect1d(known, np.unique(np.concatenate(right)), assume_unique=True)
    sides = []
    for sets in (left, right):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        columns = np.searchsorted(known, values)
        inside = (columns < len(known)) & (known[np.minimum(columns, len(known) - 1)] == values) if len(known) else rows < 0
        rows, columns = rows[inside], columns[inside]
        order = np.argsort(columns, kind="stable")
        sides.append((rows[order], columns[order], len(sets)))
    for begin in range(0, len(known), COLUMNS_AT_ONCE):
        tiles = []
        for rows, columns, size in sides:
            part = slice(*np.searchsorted(columns, [begin, begin + COLUMNS_AT_ONCE]))
            tile = np.zeros((size, min(COLUMNS_AT_ONCE, len(known) - begin)), np.float32)
            tile[rows[part], columns[part] - begin] = 1
            tiles.append(tile)
        total += tiles[0] @ tiles[1].T
    return total.astype(np.int64)


def _confirm_block(rows: list[tuple], similarity: Similarity) -> list[tuple[int, int]]:
    """Links between parts of a block: rows are (id, part, set, on the left side, on the right)."""
    left, right = [r for r in rows if r[3]], [r for r in rows if r[4]]
    if not left or not right:
        return []
    sizes = [np.array([len(r[2]) for r in side]) for side in (left, right)]
    counts = _counts([r[2] for r in left], [r[2] for r in right])
    good = similarity.linked(counts, sizes[0][:, None], sizes[1][None, :])
    good &= np.array([r[1] for r in left])[:, None] != np.array([r[1] for r in right])[None, :]
    forest, found = Forest(), []
    for i, j in np.argwhere(good).tolist():
        a, b = left[i][1], right[j][1]
        if forest.root(a) != forest.root(b):
            forest.join(a, b)
            found.append((min(a, b), max(a, b)))
    return found


def _confirm_blocks(similarity: Similarity):
    """Links between parts, in partitions sorted by cluster and pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            found = []
            names = ("cluster", "first", "second", "id", "part", "shingles", "left", "right")
            for *task, id_, part, packed, left, right in zip(*(batch.column(n).to_pylist() for n in names)):
                if task != current:
                    found += _confirm_block(rows, similarity)
                    current, rows = task, []
                rows.append((id_, part, np.frombuffer(packed, np.uint64), left, right))
            yield _links(found)
        yield _links(_confirm_block(rows, similarity))

    return run


def block_links(classes: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """Columns a, b: links between parts of the same cluster.

    ``classes`` has id, part, cluster, n_shingles. The largest part of a cluster is its main
    part; blocks of the other classes meet one another and the blocks of the main part.
    """
    sized = classes.groupBy("cluster", "part").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight"))
    clusters = sized.groupBy("cluster").agg(
        F.max(F.struct("size", "part")).alias("top"),
        F.sum("size").alias("size"),
        F.sum("weight").alias("weight"),
        F.max(F.struct("size", "part", "weight"))["weight"].alias("main_weight"),
        F.count("*").alias("parts"),
    )

    def blocks(size, weight):
        needed = F.greatest(F.ceil(size / BLOCK_CLASSES), F.ceil(weight / BLOCK_SHINGLES))
        return F.greatest(F.lit(1), needed.cast("int"))

    # a cluster of one part is done; one of two classes was compared with its hub
    open_clusters = clusters.where((F.col("parts") > 1) & (F.col("size") > 2)).select(
        "cluster",
        F.col("top.part").alias("main"),
        blocks(F.col("size") - F.col("top.size"), F.col("weight") - F.col("main_weight")).alias("others"),
        blocks(F.col("top.size"), F.col("main_weight")).alias("mains"),
    )
    # classes of one cluster are looked up in as many tasks as there are salts
    salted = open_clusters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(SALTS)).cast("int")
    joined = classes.withColumn("salt", salt).join(salted, ["cluster", "salt"]).join(sets, "id")
    is_main = F.col("part") == F.col("main")
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.when(is_main, F.col("mains")).otherwise(F.col("others")).cast("long"))
    placed = joined.withColumn("own", own.cast("int")).withColumn("is_main", is_main)
    # tasks of a block: (first, second), first a block of others, second of others or, behind them, of main
    numbers = F.sequence(F.lit(0), F.col("others") - 1)
    mains = F.sequence(F.col("others"), F.col("others") + F.col("mains") - 1)
    me = F.col("own")
    as_first = F.transform(
        F.concat(F.filter(numbers, lambda k: k >= me), mains), lambda k: F.struct(me.alias("first"), k.alias("second"))
    )
    as_second = F.transform(
        F.filter(numbers, lambda k: k < me), lambda k: F.struct(k.alias("first"), me.alias("second"))
    )
    as_main = F.transform(numbers, lambda k: F.struct(k.alias("first"), (F.col("others") + me).alias("second")))
    tasks = F.when(F.col("is_main"), as_main).otherwise(F.concat(as_first, as_second))
    dealt = placed.withColumn("task", F.explode(tasks)).select(
        "cluster",
        F.col("task.first").alias("first"),
        F.col("task.second").alias("second"),
        "id",
        "part",
        "shingles",
        (~F.col("is_main") & (F.col("task.first") == me)).alias("left"),
        F.when(F.col("is_main"), F.lit(True)).otherwise(F.col("task.second") == me).alias("right"),
    )
    ordered = dealt.repartition("cluster", "first", "second").sortWithinPartitions("cluster", "first", "second")
    return ordered.mapInArrow(frugal(_confirm_blocks(similarity)), "a long, b long")


def group_near_duplicates(
    docs: DataFrame, similarity: Similarity = Similarity(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Columns doc_id, n_shingles, component_id (smallest id of the group), kept; one row per row."""
    sketches = checkpointed(sketch(docs, key, text, similarity))
    usable = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = usable.groupBy("set_digest").agg(
        F.min(F.struct("doc_id", "n_shingles", "bands")).alias("least")
    ).select("set_digest", F.col("least.doc_id").alias("id"), "least.n_shingles", "least.bands")

    banded = classes.select("id", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last")
    pairs = banded.join(hubs.drop("last"), "band").where("hub <> id").select("hub", F.col("id").alias("member"))
    pairs = checkpointed(pairs.distinct())
    wanted = pairs.select(F.col("hub").alias("id")).union(pairs.select("member")).distinct()
    sets = checkpointed(shingle_sets(docs, wanted, key, text, similarity))

    first = connected_components(hub_links(pairs, sets, similarity))
    # parts that candidates connect, though links do not
    parts = wanted.join(first, wanted["id"] == first["node"], "left").select(
        "id", F.coalesce("root", "id").alias("part")
    )
    parts = checkpointed(parts)
    ends = pairs.join(parts.select(F.col("id").alias("hub"), F.col("part").alias("a")), "hub").join(
        parts.select(F.col("id").alias("member"), F.col("part").alias("b")), "member"
    )
    clusters = connected_components(ends.where("a <> b").select("a", "b").distinct())
    placed = (
        parts.join(clusters, parts["part"] == clusters["node"], "left")
        .select("id", "part", F.coalesce("root", "part").alias("cluster"))
        .join(classes.select("id", "n_shingles"), "id")
    )
    second = connected_components(block_links(placed, sets, similarity))
    grouped = parts.join(second, parts["part"] == second["node"], "left").select(
        "id", F.coalesce("root", "part").alias("component_id")
    )
    rooted = classes.select("set_digest", "id").join(grouped, "id", "left").select(
        "set_digest", F.coalesce("component_id", "id").alias("component_id")
    )
    linked = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), linked)
    return sketches.join(rooted, "set_digest", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (component.isNull() | (component == F.col("doc_id"))).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, similarity: Similarity = Similarity(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, without those whose group has a smaller id.

    Rows that repeat an id are all kept or all dropped by the smallest group of that id.
    """
    groups = group_near_duplicates(docs, similarity, key, text)
    dropped = groups.where(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(dropped, docs[key].cast("long") == dropped["__dropped"], "left_anti")


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents that share 85 % of their three-word shingles, directly or by others."""
    return group_near_duplicates(table(spark, folder, "documents"), Similarity(3, 85))


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x20\x09-\x0D]+')"
)

QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLE = {
    "op9_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k
                   FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i
                         FROM d WHERE len(w) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
                   FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                   WHERE 100 * c >= 85 * (x.n + y.n - c)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r AS (SELECT DISTINCT a AS node, a AS reached FROM e
                   UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
             g AS (SELECT node, min(reached) AS root FROM r GROUP BY node)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id,
               coalesce(root, doc_id) = doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g ON g.node = d.doc_id"""
}
