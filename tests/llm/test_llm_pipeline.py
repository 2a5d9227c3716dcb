"""The corpus pipeline against a plain version of its stages."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import near_dedup, secrets
from millrace.llm.common import table
from millrace.llm.language_id import fit_languages, learning_rows
from test_llm_operators import brute_groups

FOLDER = "/root/testdata/sf0.001"


def plain_words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower)


def plain_windows(words, width):
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def base_spans(text):
    """The three base patterns by plain regular expressions."""
    key = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    found = [m.span() for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return found + [m.span() for m in re.finditer("[0-9a-f]{32,}", text)]


def test_pipeline_by_brute_force(spark):
    documents = table(spark, FOLDER, "documents")
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    classify = fit_languages(learning_rows(documents)).classifier()  # tested by direct compression
    rows = {d: t for d, t in rows.items() if classify(t)[0] != "und" and classify(t)[1] >= 0.005}
    groups = brute_groups(list(rows.items()), near_dedup.Similarity(5, 80))
    rows = {d: t for d, t in rows.items() if groups[d][1] == d}
    benchmark = [plain_words(r["text"]) for r in table(spark, FOLDER, "benchmark").collect()]
    forbidden = {}
    for words in benchmark:
        width = min(10, len(words))
        forbidden.setdefault(width, set()).update(plain_windows(words, width) if width else ())
    hit = lambda words: any(plain_windows(words, n) & own for n, own in forbidden.items())
    rows = {d: t for d, t in rows.items() if not hit(plain_words(t))}
    encoding = secrets.vocabulary(secrets._ranks(secrets.RANKS_PATH))
    for doc, text in rows.items():
        spans = base_spans(text)
        beside = [(b, e) for b, e, kind in secrets.find_secrets(text, encoding) if kind == "random"]
        covered = sorted(spans + beside)
        parts, done = [], 0
        for begin, end in covered:
            if begin >= done:
                parts += [text[done:begin], "[secret]"]
            done = max(done, end)
        rows[doc] = "".join(parts) + text[done:]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {d: library.encode(t, add_special_tokens=False).ids for d, t in rows.items()}
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"]: r["token_ids"] for r in found} == expected
    for r in found:
        assert r["n_tokens"] == len(r["token_ids"])
        assert r["decoded"] == library.decode(r["token_ids"], skip_special_tokens=False)


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_columns_and_bear_odd_rows(spark, number):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __dropped long, kept string"
    rows = [(1, None, None, None, None, 1, "x"), (2, "", "en", "s", 0, 1, "x"), (None, "a b", "en", "s", 3, 1, "x")]
    rows += [(3, "the cat and the dog " * 50, "en", "s", 1000, 1, "x")] * 2
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        done = corpus_pipeline.STAGES[number][1](spark, frame, FOLDER)
        assert done.columns == docs.columns
        assert done.count() <= frame.count()
