"""BPE encoding and decoding over a trie of words.

The distinct words of a portion of documents go into a trie, which is held as the sorted words
and the lengths of the prefixes that neighbours share: in this order a word is the branch that
leaves the path of the word before it. The depth-first walk gives every node the last token
of the encoding of its prefix: the token ``t`` for which the prefix without ``t`` ends in a
token that can stand before ``t``. Exactly one token fits, since every prefix of a byte-pair
encoding is the encoding of what it spells. Prefixes that words share are thus encoded once,
and a word is read off by stepping back from its last token.

Two tokens can stand side by side when merging the symbols of both gives just these two.
Special tokens in a text are cut out first; normalisation and splitting into words are the
tokenizer file's own, done by the library for any text that is not plain Latin.

A portion of texts is split, numbered by distinct stretches between white space and by distinct
words, and put together again from the words' tokens as Arrow arrays; only distinct words are
looked at one by one.

Bounded: a trie holds the new words of one portion of texts (``PORTION_BYTES``). A worker
remembers words in two generations of about ``KNOWN_SYMBOLS`` symbols each: when the younger is
full it becomes the older, and what was not asked for meanwhile is forgotten. A long word costs
its length.

Defined cases: a null or empty text has no tokens and decodes to the empty text. An id outside
the vocabulary decodes to nothing, as in the library. Repeated rows are encoded one by one;
columns beside key and text are ignored.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.common import frugal, portions, table

TOKENIZER_PATH = public_tokenizers.path("word_bpe_49k.json")
KNOWN_SYMBOLS = 4_000_000
KNOWN_PAIRS = 400_000
KNOWN_STEPS = 200_000
PORTION_BYTES = 2 << 20

# The normaliser and splitter of the file named above. With these, a text of ASCII
# (no control characters but white space) and Latin letters splits by _PLAIN_WORD after
# lower-casing, word by word between white space; any other text goes through the library.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u024f"
_PLAIN_WORD = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+"
# Latin letters whose lower case is one letter of the same class; schwa and others have theirs outside.
_LATIN = [c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and re.fullmatch(f"[{_LETTERS}]", c.lower())]
_PLAIN_SYMBOLS = f"\t-\r -~{''.join(_LATIN)}"
_PLAIN = re.compile(f"[{_PLAIN_SYMBOLS}]*")
# Byte-level symbols: printable bytes stand for themselves, the others for 256 and on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_SYMBOLS = "".join(chr(256 + _OTHERS.index(b) if b in _OTHERS else b) for b in range(256))
_SYMBOLS = _SYMBOLS.replace(_SYMBOLS[ord("\n")], "\n")  # stands between words, never in one
HEAD = 24  # symbols of words that are compared all at once
EACH = 8  # what an entry costs beside its symbols
_LAST = 0x10000  # added to the code point of a word's last symbol, which carries the word end


def _closed(word: str) -> str:
    """``word`` with its last symbol marked as the end of a word."""
    return word[:-1] + chr(ord(word[-1]) + _LAST)


#: The symbols it stands for, the end one symbol on, and the tokens that can be last there, longest
#: first: how long, which, and whether they can follow a token, as far as known.
End = tuple[str, dict[str, "End"], list[tuple[int, int, Callable[[int], bool | None]]]]


class TrieEncoder:
    """Encodes sets of words by the vocabulary and merges of a tokenizer file."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[list[str]], word_end: str):
        def plain(token: str) -> str:
            return _closed(token.removesuffix(word_end)) if token.endswith(word_end) and token != word_end else token

        self.ids = {plain(token): i for token, i in vocabulary.items()}
        self.ranks = {(plain(a), plain(b)): rank for rank, (a, b) in enumerate(merges)}
        self.origins: dict[str, tuple[int, str, str] | None] = {}
        self.names = {i: token for token, i in self.ids.items()}
        self.lengths = {i: len(token) for i, token in self.names.items()}
        self.begins = {token[:n] for token in self.ids for n in range(len(token) + 1)}
        self.neighbours: dict[int, dict[int, bool]] = {}  # by token, then by the token before it
        self.ends: dict[str, End] = {}
        self.known_pairs = self.known_steps = 0

    def _origin(self, token: str) -> tuple[int, str, str] | None:
        """Rank and parts of the last merge that makes a token; rank -1 for one symbol.

        None if merging the token's symbols ends in something else.
        """
        if token in self.origins:
            return self.origins[token]
        parts, last = list(token), (-1, token, "")
        while len(parts) > 1:
            ranked = [self.ranks.get(pair, len(self.ranks)) for pair in zip(parts, parts[1:])]
            best = min(ranked)  # the lowest rank, then the leftmost pair
            if best == len(self.ranks):
                break
            at = ranked.index(best)
            last = (best, parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.origins[token] = last if len(parts) == 1 else None
        return self.origins[token]

    def _side_by_side(self, left: str, right: str) -> bool:
        """Whether merging the symbols of both tokens leaves just these two.

        Goes back in time: the part that was merged last is taken apart, and a pair across the
        border counts if its turn came while both its sides were there.
        """
        until = len(self.ranks)
        while True:
            if self.ranks.get((left, right), until) < until:
                return False
            left_rank, _, left_end = self._origin(left)
            right_rank, right_begin, _ = self._origin(right)
            if left_rank < 0 and right_rank < 0:
                return True
            if right_rank >= left_rank:
                until, right = right_rank + 1, right_begin  # of equal ranks the left goes first
            else:
                until, left = left_rank, left_end

    def _fits(self, before: int, token: int) -> bool:
        """Whether a prefix that ends in token ``before`` (-1 for none) may go on with ``token``."""
        name = self.names[token]
        if self._origin(name) is None:
            return False
        return before < 0 or self._side_by_side(self.names[before], name)

    def _end(self, spelled: str) -> End:
        """The end of a prefix by the longest of its last symbols that begin a token."""
        if spelled not in self.ends:
            fitting = [i for k in range(len(spelled)) if (i := self.ids.get(spelled[k:])) is not None]
            after = [(self.lengths[i], i, self.neighbours.setdefault(i, {}).get) for i in fitting]
            self.ends[spelled] = spelled, {}, after
        return self.ends[spelled]

    def _step(self, end: End, symbol: str) -> End:
        """The end of a prefix that goes on with ``symbol``."""
        spelled = end[0] + symbol
        while spelled not in self.begins:
            spelled = spelled[1:]
        if self.known_steps >= KNOWN_STEPS:
            self.known_steps = 0
            for _, steps, _ in self.ends.values():
                steps.clear()
        self.known_steps += 1
        longer = end[1][symbol] = self._end(spelled)
        return longer

    def _pair_fits(self, before: int, token: int) -> bool:
        if self.known_pairs >= KNOWN_PAIRS:
            self.known_pairs = 0
            for known in self.neighbours.values():
                known.clear()
        self.known_pairs += 1
        fits = self.neighbours[token][before] = self._fits(before, token)
        return fits

    def encode(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Token ids of every distinct non-empty word."""
        trie = sorted(map(_closed, words))
        encoded = {}
        lasts = [-1]  # by length of prefix; nothing precedes the first token
        ends = [self._end("")]  # likewise
        lengths = self.lengths
        for word, shared in zip(trie, _shared_prefixes(trie)):
            del lasts[shared + 1 :], ends[shared + 1 :]
            end = ends[shared]
            for symbol in word[shared:]:
                end = end[1].get(symbol) or self._step(end, symbol)
                for size, token, fits_after in end[2]:
                    fits = fits_after(before := lasts[-size])
                    if fits or (fits is None and self._pair_fits(before, token)):
                        lasts.append(token)
                        ends.append(end)
                        break
                else:
                    raise ValueError(f"no token of the vocabulary ends {word[: len(lasts)]!r}")
            tokens, at = [], len(word)
            while at:
                tokens.append(lasts[at])
                at -= lengths[lasts[at]]
            encoded[word[:-1] + chr(ord(word[-1]) - _LAST)] = tuple(reversed(tokens))
        return encoded


def _shared_prefixes(words: list[str]) -> list[int]:
    """How many first symbols each word shares with the one before it."""
    if not words:
        return []
    heads = np.array(words, f"<U{HEAD}").view(np.uint32).reshape(len(words), HEAD)
    differ = heads[1:] != heads[:-1]
    shared = [0, *np.where(differ.any(axis=1), differ.argmax(axis=1), HEAD).tolist()]
    for k, n in enumerate(shared):
        if n == HEAD:
            shared[k] = len(os.path.commonprefix(words[k - 1 : k + 1]))
    return shared


class Memory:
    """What was found by text; forgets what was not asked for while ``limit`` symbols of others came in."""

    def __init__(self, limit: int):
        self.limit, self.held = limit, 0
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def recall(self, texts: list[str]) -> list[object | None]:
        """What was found by each of the distinct texts, None if it is not remembered."""
        found = list(map(self.young.get, texts))
        missing = [k for k, value in enumerate(found) if value is None]
        again = {}
        for k, value in zip(missing, [self.old.get(texts[k]) for k in missing]):
            if value is not None:
                again[texts[k]] = found[k] = value
        self.add(again)  # young again
        return found

    def add(self, found: dict[str, object]) -> None:
        self.young.update(found)
        self.held += sum(map(len, found)) + EACH * len(found)

    def age(self) -> None:
        """Between portions, when nothing is in use."""
        if self.held >= self.limit:
            self.old, self.young, self.held = self.young, {}, 0


def _in_order(parts: list[pa.Array], second: pa.Array) -> pa.Array:
    """Rows of two arrays as one, taken from the second where ``second`` says so."""
    order = np.argsort(second.to_numpy(zero_copy_only=False), kind="stable")
    return pa.concat_arrays(parts).take(pa.array(np.argsort(order)))


def _joined(lists: pa.ListArray, groups: pa.ListArray) -> pa.ListArray:
    """Lists end to end, as many at a time as each of ``groups`` has members."""
    counts = pc.list_value_length(groups).to_numpy()
    borders = np.cumsum(np.concatenate([[0], counts]))
    return pa.ListArray.from_arrays(lists.offsets.take(pa.array(borders)), lists.values)


class BpeCodec:
    """Texts to token ids and back, as the tokenizer file defines."""

    def __init__(self, definition: str):
        content = json.loads(definition)
        model = content["model"]
        unsupported = [k for k in ("dropout", "unk_token", "continuing_subword_prefix") if model.get(k)]
        unsupported += [k for k in ("byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
        unsupported += [k for k in ("post_processor", "decoder") if content.get(k)]
        added = content["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            unsupported.append("added_tokens")
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or unsupported:
            raise ValueError(f"a BPE file with word ends is needed; not supported: {unsupported}")
        library = Tokenizer.from_str(definition)
        self.normalize = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.encoder = TrieEncoder(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in added}
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, by_length)) + ")").split if added else None
        self.pieces = {i: t for t, i in chain(model["vocab"].items(), self.special.items())}
        self.spelled = pa.array(map(self.pieces.get, range(max(self.pieces, default=-1) + 1)), pa.string())
        self.usual = (content["normalizer"], content["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER)
        self.words = Memory(KNOWN_SYMBOLS)

    def _chunks(self, text: str) -> list[str]:
        """A text as plain stretches between white space, or else " " and a special token or "  "
        and a word as the library splits it; no plain stretch has a space."""
        found: list[str] = []
        for k, part in enumerate(self.cut(text) if self.cut else [text]):
            if k % 2:
                found.append(" " + part)
            elif self.usual and _PLAIN.fullmatch(part):
                found += part.lower().split()
            elif part:
                found += ["  " + word for word, _ in self.split(self.normalize(part))]
        return found

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """``_chunks`` of every text, in one go for plain texts; a chunk may be empty."""
        library = pc.match_substring_regex(texts, f"[^{_PLAIN_SYMBOLS}]" if self.usual else "")
        for special in self.special:
            library = pc.or_(library, pc.match_substring(texts, special))
        if not library.true_count:
            return pc.ascii_split_whitespace(pc.utf8_lower(texts))
        plain = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(pc.invert(library))))
        others = pa.array(map(self._chunks, texts.filter(library).to_pylist()), plain.type)
        return _in_order([plain, others], library)

    def _words(self, chunks: pa.Array) -> pa.ListArray:
        """Words of every chunk; of an empty one, and after those that are cut, an empty word."""
        one = pc.or_(pc.utf8_is_alpha(chunks), pc.starts_with(chunks, " "))
        alone = chunks.filter(one)
        alone = pa.ListArray.from_arrays(pa.array(range(len(alone) + 1), pa.int32()), alone)
        spaced = pc.replace_substring_regex(chunks.filter(pc.invert(one)), f"({_PLAIN_WORD})", r"\1 ")
        return _in_order([pc.split_pattern(spaced, " "), alone], one)

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """Token ids of every text; none for null."""
        split = self._split(texts.fill_null(""))
        chunks = split.flatten().dictionary_encode()
        cut = self._words(chunks.dictionary)
        words = cut.flatten().dictionary_encode()
        ids = self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        offsets = np.cumsum(np.fromiter(chain([0], map(len, ids)), np.int64, len(ids) + 1))
        tokens = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])
        by_word = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens))
        by_chunk = _joined(by_word.take(words.indices), cut)
        if pc.list_value_length(by_chunk).to_numpy()[chunks.indices.to_numpy()].sum(dtype=np.int64) >= 1 << 31:
            raise ValueError("a portion of texts holds more than 2^31 tokens")
        return _joined(by_chunk.take(chunks.indices), split)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        encoded = self.encode_array(pa.array(texts, pa.string()))
        offsets, tokens = encoded.offsets.to_numpy(), encoded.values.to_numpy()
        return [tokens[begin:end] for begin, end in zip(offsets, offsets[1:])]

    def _ids(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of every one of distinct words."""
        self.words.age()
        ids = self.words.recall(words)
        new = [word for word, known in zip(words, ids) if known is None]
        found = {word: (self.special[word[1:]],) for word in new if word[:1] == " " != word[1:2]} | {"": ()}
        plain = [word for word in new if word and word[0] != " "]
        symbols = codecs.charmap_decode("\n".join(plain).encode(), "strict", _SYMBOLS)[0].split("\n")
        spelled = dict(zip(plain, symbols)) | {word: word[2:] for word in new if word[:2] == "  "}
        ids_of = self.encoder.encode(set(spelled.values()))
        found |= {word: ids_of[own] for word, own in spelled.items()}
        self.words.add(found)
        return [found[word] if known is None else known for word, known in zip(words, ids)]

    def decode(self, ids: Iterable[int]) -> str:
        pieces = self.pieces
        return " ".join([pieces[i] for i in ids if i in pieces])

    def decode_array(self, encoded: pa.ListArray) -> pa.Array:
        """``decode`` of every list of ids of the vocabulary."""
        return pc.binary_join(pa.ListArray.from_arrays(encoded.offsets, self.spelled.take(encoded.values)), " ")


@lru_cache(maxsize=2)
def codec(definition: str) -> BpeCodec:
    """One codec per worker process and file."""
    return BpeCodec(definition)


def encode_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER_PATH, decode: bool = False
) -> DataFrame:
    """Columns ``key``, token_ids and, if asked for, decoded: one row per input row."""
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    BpeCodec(definition)  # refuses other kinds of file on the driver already
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # one vocabulary file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value)
        for batch in batches:
            for part in portions(batch, text, PORTION_BYTES):
                columns = [part.column(0), coder.encode_array(part.column(1))]
                if decode:
                    columns.append(coder.decode_array(columns[1]))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "token_ids", "decoded"][: len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, token_ids array<int>" + ", decoded string" * decode
    return docs.select(key, text).mapInArrow(frugal(encode), schema)


def decode_ids(
    encoded: DataFrame, key: str = "doc_id", ids: str = "token_ids", path: str = TOKENIZER_PATH
) -> DataFrame:
    """Columns ``key`` and decoded for lists of token ids; a null list decodes to the empty text."""
    with open(path, encoding="utf-8") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value)
        for batch in batches:
            texts = [coder.decode(i for i in row if i is not None) if row else "" for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(decode, f"`{key}` {kind}, decoded string")


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of every document."""
    done = encode_texts(table(spark, folder, "documents"), decode=True)
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op4_bpe": op4_bpe}
ORACLE: dict[str, str] = {}
