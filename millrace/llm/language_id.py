"""Language identification by compression.

A text is compressed once per language, each time with a raw-content zstandard dictionary of
that language; the smallest output names the language. Texts are lower-cased and their ASCII
non-letters become spaces, so that digits and markup do not decide. Long texts are compressed
in pieces, all of them, and the sizes are summed. Where the two smallest sizes lie closer than
``narrow`` (relative), the document is rejected: the name is still given.

Bounded: the ``LANGUAGES`` most frequent labels are learned, however many values a dirty column
has. A dictionary holds at most ``DICTIONARY_TEXTS`` pieces of ``DICTIONARY_CHARS`` characters,
texts and places in them drawn by a hash over the whole training table.

Defined cases: a null text, or one without any letter, gives ``und``, score 0 and is rejected.
Rows with a null ``lang`` or id are never learned from but are predicted. Sizes that tie go to
the language with more training rows, then to the smaller name, with margin 0. With nothing to
learn from, every row is ``und``. Repeated rows are predicted one by one. Columns of the input
other than the key and the text are ignored here; clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import frugal, remainder, table

DICTIONARY_TEXTS = 256
DICTIONARY_CHARS = 512
LANGUAGES = 64
PIECE_BYTES = 16384
NARROW = 0.005
UNKNOWN = "und"

_LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_SETTINGS = {
    "search_log": 4,
    "min_match": 4,
    "strategy": zstandard.STRATEGY_LAZY2,
    "write_content_size": False,
    "write_checksum": False,
}


def settings(content: bytes) -> zstandard.ZstdCompressionParameters:
    """Tables and a window that hold all of a dictionary and a piece of text."""
    log = max(14, (len(content) + PIECE_BYTES - 1).bit_length())
    return zstandard.ZstdCompressionParameters(window_log=log, hash_log=log, chain_log=log, **_SETTINGS)


def letters(text: str) -> bytes:
    return text.lower().encode().translate(_LETTERS_ONLY)


@dataclass(frozen=True)
class LanguageModel:
    """Per language, most frequent first: its name and its dictionary content."""

    dictionaries: tuple[tuple[str, bytes], ...]

    def classifier(self):
        """Function of a text giving language, score and whether the margin is wide enough."""
        compressors = []
        for name, content in self.dictionaries:
            chosen = settings(content)
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=chosen)
            compressors.append((name, zstandard.ZstdCompressor(dict_data=dictionary, compression_params=chosen)))

        def classify(text: str | None) -> tuple[str, float]:
            if not compressors or not text or not any(c.isalpha() for c in text):
                return UNKNOWN, 0.0
            plain = letters(text)
            pieces = [plain[i : i + PIECE_BYTES] for i in range(0, len(plain), PIECE_BYTES)]
            sizes = sorted(
                (sum(len(compressor.compress(piece)) for piece in pieces), rank)
                for rank, (_, compressor) in enumerate(compressors)
            )
            best, rank = sizes[0]
            margin = (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0
            return compressors[rank][0], margin

        return classify


def fit_languages(
    training: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    texts: int = DICTIONARY_TEXTS,
    chars: int = DICTIONARY_CHARS,
    languages: int = LANGUAGES,
) -> LanguageModel:
    """Dictionaries from a bounded sample of the rows of the ``languages`` most frequent labels.

    A first aggregate counts the rows of every label; the rate of the hashed draw follows
    from it, so that about four times ``texts`` rows of a language give a piece of ``chars``
    characters, from a place drawn by a hash, and the first ``texts`` of them by hash are kept.
    Other labels are not learned.
    """
    place = F.pmod(F.xxhash64(key, F.lit(5)), F.greatest(F.lit(1), F.length(text) - chars + 1)) + 1
    usable = training.where(
        F.col(label).isNotNull() & F.col(key).isNotNull() & (F.length(text) > 0)
    ).select(
        F.col(key).alias("key"), F.substring(F.col(text), place.cast("int"), F.lit(chars)).alias("text"), F.col(label).alias("label")
    )
    frequent = usable.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(languages)
    counts = {r["label"]: r["n"] for r in frequent.collect()}
    if not counts:
        return LanguageModel(())
    draw = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    rate = F.create_map(*[F.lit(x) for n, c in counts.items() for x in (n, 4.0 * texts / c)])
    drawn = usable.withColumn("draw", draw).where(F.col("draw") < rate[F.col("label")])
    order = Window.partitionBy("label").orderBy("draw", "key", "text")
    kept = drawn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= texts)
    samples: dict[str, list[str]] = {}
    for row in kept.orderBy("label", "rank").collect():
        samples.setdefault(row["label"], []).append(row["text"])
    ordered = sorted(samples, key=lambda n: (-counts[n], n))
    return LanguageModel(tuple((n, b" ".join(letters(t) for t in samples[n])) for n in ordered))


def identify_languages(
    docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", narrow: float = NARROW
) -> DataFrame:
    """Columns ``key``, lang_pred, score (relative margin), accepted; one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by its parameters

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = shared.value.classifier()
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[0] != UNKNOWN and f[1] >= narrow for f in found], pa.bool_()),
                ],
                names=[key, "lang_pred", "score", "accepted"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, lang_pred string, score double, accepted boolean"
    return docs.select(key, text).mapInArrow(frugal(predict), schema)


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text", narrow: float = NARROW) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is told with a wide enough margin.

    A filter within the batches of the table: no shuffle, no join back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = shared.value.classifier()
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(text)]
            yield batch.filter(pa.array([f[0] != UNKNOWN and f[1] >= narrow for f in found], pa.bool_()))

    return docs.mapInArrow(frugal(keep), docs.schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: those whose crc32(doc_id as text) mod 4 is not 2."""
    return docs.where(remainder(F.col("doc_id"), 4) != 2)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; a quarter of the rows, by crc32 of the id, is held out."""
    docs = table(spark, folder, "documents")
    found = identify_languages(docs, fit_languages(learning_rows(docs)))
    return found.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "accepted",
    )


QUERIES = {"op10_language_id": op10_language_id}
ORACLE: dict[str, str] = {}
