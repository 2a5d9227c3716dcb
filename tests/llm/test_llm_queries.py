"""Registered queries of the training-data operators against SQL or brute force."""

import collections
import hashlib
import re
import zlib

import duckdb
import public_tokenizers
import pytest
from oracle import connect, differences
from tokenizers import Tokenizer

import __spark_entry__ as contract
from millrace.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def documents():
    return duckdb.connect().execute(f"SELECT doc_id, text, lang FROM '{FOLDER}/documents.parquet'").fetchall()


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, db, name):
    assert differences(QUERIES[name](spark, FOLDER), db, ORACLE[name]) == []


def test_secrets_by_brute_force(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op1_secrets"](spark, FOLDER).collect()}
    assert len(rows) == len(documents)
    words = [a for k in ("password", "passwd", "secret", "token", "api_key", "apikey") for a in [k]]
    key = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)
    for doc, text, _ in documents:
        spans = []
        for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
            spans += [(m.start(), 0, "assign", m.end())] * (len(m[2]) >= 8)
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        row, count = rows[doc], collections.Counter(s[2] for s in spans)
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == (count["assign"], count["access"], count["hex"])
        assert row["base_sha256"] == digest(",".join(f"{k}:{b}:{e}" for b, _, k, e in sorted(spans)))


def test_bpe_equals_the_library(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r["doc_id"]: r for r in QUERIES["op4_bpe"](spark, FOLDER).collect()}
    for doc, text, _ in documents:
        ids = library.encode(text, add_special_tokens=False).ids
        assert rows[doc]["n_tokens"] == len(ids)
        assert rows[doc]["ids_sha256"] == digest(" ".join(map(str, ids)))
        assert rows[doc]["decoded_sha256"] == digest(library.decode(ids, skip_special_tokens=False))


def test_quality_held_out(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = duckdb.connect().execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(rows[d], q) for d, q in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r["held_out"] and 0 <= r["score"] <= 1 for r, _ in held)
    assert sum(r["predicted"] == q for r, q in held) >= 0.9 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())


def test_languages_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, folder).collect()}
    documents = duckdb.connect().execute(f"SELECT doc_id, lang FROM '{folder}/documents.parquet'").fetchall()
    held = [(rows[d], lang) for d, lang in documents if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(rows) == len(documents)
    assert all(r["held_out"] and 0 <= r["score"] <= 1 for r, _ in held)
    assert sum(r["lang_pred"] == lang for r, lang in held) >= 0.97 * len(held)
