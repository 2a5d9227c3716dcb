"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` cuts the lineage between stages, so that no stage computes
an earlier one again.

1. ``language_id`` drops documents whose language compression cannot tell.
2. ``near_dedup`` keeps the smallest id of each group of near copies (five-word shingles,
   similarity 0.8).
3. ``decontamination`` drops documents in which a benchmark window occurs.
4. ``secret_scan`` replaces secrets in the texts; ``n_chars`` follows.
5. ``bpe`` encodes the texts and decodes them again.

Null and empty texts have no language and leave with the first stage; an empty table passes
through. Columns that ``documents`` has beside the named ones are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import encode_texts
from millrace.llm.common import checkpointed, table
from millrace.llm.decontamination import drop_contaminated
from millrace.llm.language_id import fit_languages, keep_identified, learning_rows
from millrace.llm.near_dedup import Similarity, keep_one_of_each
from millrace.llm.secrets import redact_secrets
from millrace.session import ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_identified(docs, fit_languages(learning_rows(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_one_of_each(docs, Similarity(words=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    clean = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns doc_id, n_tokens, token_ids, decoded."""
    ship_package(spark)
    done = encode_texts(docs, decode=True)
    return done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        if number:
            docs = checkpointed(docs)
        docs = stage(spark, docs, sf_dir)
    return docs


#: Compression, tokenisers and rejections by margin have no SQL; tests compare with brute force.
ORACLE_SQL = None
