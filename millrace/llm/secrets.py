"""Secret scans: fixed patterns, and strings that a vocabulary of ordinary text spells badly.

Three base patterns stand first. The added test takes every unbroken run of key characters
outside the base spans and counts its tokens under a byte-pair vocabulary: ordinary words need
few tokens, random strings many. A run with fewer than ``RATIO`` characters per token is a
secret of kind ``random``, unless it is a known digest (hexadecimal of a usual length, alone or
behind an algorithm's name) or an identifier (UUID, number, date, address, words joined by
separators or capitals, if the vocabulary spells them in few tokens). What a base span leaves of a run is tested like a run. Where a whole run
passes, its stretches between known words, digests and UUIDs are tested, and windows of ``WINDOW``
characters within these, so that ordinary words beside a secret do not hide it.

Runs and stretches of ``SHORTEST`` to ``LONG`` - 1 characters are tested more strictly, as few tokens tell
little: they must have letters and digits and fewer than ``SHORT_RATIO`` characters per token, and
those of hexadecimal digits alone pass for identifiers. Shorter ones are not tested.

Positions are code points, ends exclusive. Every text is scanned whole; runs are tokenised in
pieces of ``PIECE`` characters, so that a run of any length costs in proportion.

Defined cases: a null text is empty; an empty text has no spans and its digest is that of the
empty string. Repeated rows are scanned one by one; other columns are ignored when scanning and
kept when redacting.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import frugal, table

RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RATIO = 2.2
SHORTEST, LONG = 12, 20
SHORT_RATIO = 1.8
WINDOW, STRIDE = 40, 10
PIECE = 256
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
_DIGEST = re.compile(
    r"(?:(?:md5|sha-?(?:1|224|256|384|512))[-_=/]?)?"
    r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})",
    re.IGNORECASE,
)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_KNOWN_PART = re.compile(rf"(?<![A-Za-z0-9])(?:{_UUID.pattern}|{_DIGEST.pattern})(?![A-Za-z0-9])", re.IGNORECASE)
_SHORT_ID = re.compile(r"[0-9a-f]{1,19}|[0-9A-F]{1,19}")
_NUMBERS = re.compile(r"[0-9+/_=-]+")
_SEPARATORS = re.compile(r"[+/_=-]+")
_PART = re.compile(r"[^+/_=-]+")
_WORD = re.compile(r"[A-Za-z]*[0-9]{0,4}")
_HUMP = re.compile(r"[A-Z]+[a-z]*|[a-z]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the three base patterns."""
    spans = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(*m.span(), "hex") for m in _LONG_HEX.finditer(text)]
    return spans


def is_benign(run: str, encoding: tiktoken.Encoding, ratio: float = RATIO) -> bool:
    """Whether a run of key characters is a known digest or an identifier."""
    if any(p.fullmatch(run) for p in (_DIGEST, _UUID, _NUMBERS)):
        return True
    return all(_is_name(part, encoding, ratio) for part in _SEPARATORS.split(run))


def _is_name(part: str, encoding: tiktoken.Encoding, ratio: float) -> bool:
    """Letters with few digits behind them whose humps are words: few tokens spell them.

    A hump counts as it stands or in lower case behind a space, whichever takes fewer tokens;
    a part of up to four characters is too short to tell.
    """
    if not _WORD.fullmatch(part):
        return False
    humps = _HUMP.findall(part)
    if len(part) <= 4 or not humps:
        return True
    return sum(map(len, humps)) >= ratio * sum(_hump_tokens(hump, encoding) for hump in humps)


def _hump_tokens(hump: str, encoding: tiktoken.Encoding) -> int:
    tokens = 0
    for i in range(0, len(hump), PIECE):
        piece = hump[i : i + PIECE]
        tokens += min(len(encoding.encode_ordinary(s)) for s in (piece, " " + piece.lower()))
    return tokens


@lru_cache(maxsize=2)
def vocabulary(ranks: str) -> tiktoken.Encoding:
    """One vocabulary per worker process, from the lines of a rank file."""
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding(
        "secrets",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs},
        special_tokens={},
    )


def characters_per_token(run: str, encoding: tiktoken.Encoding) -> float:
    pieces = [run[i : i + PIECE] for i in range(0, len(run), PIECE)]
    return len(run) / sum(len(encoding.encode_ordinary(piece)) for piece in pieces)


def _badly_spelled(run: str, encoding: tiktoken.Encoding, ratio: float) -> bool:
    """The token test of a run or a part of one."""
    if len(run) >= LONG:
        return characters_per_token(run, encoding) < ratio
    if len(run) < SHORTEST or not any(map(str.isdigit, run)) or not any(map(str.isalpha, run)):
        return False
    return not _SHORT_ID.fullmatch(run) and characters_per_token(run, encoding) < min(ratio, SHORT_RATIO)


def _hides_random(part: str, encoding: tiktoken.Encoding, ratio: float) -> bool:
    """Whether a window of a long part is spelled badly."""
    return len(part) > WINDOW and any(
        characters_per_token(part[i : i + WINDOW], encoding) < ratio
        for i in range(0, len(part) - WINDOW + STRIDE, STRIDE)
    )


def _stretches(run: str, encoding: tiktoken.Encoding, ratio: float) -> Iterator[tuple[int, int]]:
    """Begin and end of what lies between the names of a run, known digests and UUIDs."""
    begin = end = -1
    pieces = [(m.start(), m.end(), True) for m in _KNOWN_PART.finditer(run)]
    edges = [0, *(edge for piece in pieces for edge in piece[:2]), len(run)]
    for low, high in zip(edges[::2], edges[1::2]):
        pieces += [(low + m.start(), low + m.end(), False) for m in _PART.finditer(run[low:high])]
    for low, high, known in sorted(pieces):
        part = run[low:high]
        if not known and len(part) <= 4:
            continue  # too short to tell, and to end a stretch
        if known or part.isdigit() or (_is_name(part, encoding, ratio) and not _hides_random(part, encoding, ratio)):
            if begin >= 0:
                yield begin, end
            begin = -1
            continue
        begin, end = (low if begin < 0 else begin), high
    if begin >= 0:
        yield begin, end


def _random_parts(run: str, encoding: tiktoken.Encoding, ratio: float) -> list[tuple[int, int]]:
    """Spans of random strings in a run: all of it, or stretches or windows of it."""
    if len(run) < SHORTEST:
        return []
    if len(run) < LONG:
        return [(0, len(run))] if _badly_spelled(run, encoding, ratio) and not is_benign(run, encoding, ratio) else []
    benign = is_benign(run, encoding, ratio)
    if benign and not any(_hides_random(p, encoding, ratio) for p in _PART.findall(run)):
        return []
    if not benign and _badly_spelled(run, encoding, ratio):
        return [(0, len(run))]
    spans: list[tuple[int, int]] = []
    for begin, end in _stretches(run, encoding, ratio):
        stretch = run[begin:end]
        if len(stretch) < SHORTEST or is_benign(stretch, encoding, ratio) and not _hides_random(stretch, encoding, ratio):
            continue
        if _badly_spelled(stretch, encoding, ratio):
            spans.append((begin, end))
            continue
        for low in range(begin, end - WINDOW + STRIDE, STRIDE):
            high = min(low + WINDOW, end)
            if high - low >= LONG and characters_per_token(run[low:high], encoding) < ratio:
                if spans and low <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], high)
                else:
                    spans.append((low, high))
    return spans


def find_secrets(text: str | None, encoding: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """All spans of a text: by start, then kind as in ``KINDS``."""
    if not text:
        return []
    spans = base_spans(text)
    taken = sorted(span[:2] for span in spans)
    passed, covered = 0, 0  # base spans that begin before the run ends, and how far they reach
    for match in _RUN.finditer(text):
        at, end = match.span()
        at = max(at, covered)
        while passed < len(taken) and taken[passed][0] < end:
            low, high = taken[passed]
            spans += [(at + b, at + e, "random") for b, e in _random_parts(text[at:low], encoding, ratio)]
            at, covered, passed = max(at, high), max(covered, high), passed + 1
        if at < end:
            spans += [(at + b, at + e, "random") for b, e in _random_parts(text[at:end], encoding, ratio)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """``text`` with each stretch of overlapping spans replaced by ``mark``."""
    parts, done = [], 0
    for begin, end, _ in sorted(spans):
        if begin >= done:
            parts += [text[done:begin], mark]
        done = max(done, end)
    return "".join(parts) + text[done:]


def _ranks(path: str) -> str:
    with open(path, encoding="ascii") as file:
        return file.read()


def scan_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANKS_PATH, ratio: float = RATIO
) -> DataFrame:
    """Columns ``key`` and secrets (array of kind, begin, end), one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(_ranks(path))  # one vocabulary file
    span = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(shared.value)
        for batch in batches:
            found = [
                [{"kind": k, "begin": b, "end": e} for b, e, k in find_secrets(t.as_py(), encoding, ratio)]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=[key, "secrets"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, secrets array<struct<kind: string, begin: int, end: int>>"
    return docs.select(key, text).mapInArrow(frugal(scan), schema)


def redact_secrets(docs: DataFrame, text: str = "text", path: str = RANKS_PATH, ratio: float = RATIO) -> DataFrame:
    """``docs``, all rows and columns, with secrets in the text replaced; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(_ranks(path))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(shared.value)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(text)]
            texts = [t and redact(t, find_secrets(t, encoding, ratio)) for t in texts]
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(frugal(clean), docs.schema)


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers and positions of the secrets of every document."""
    found = scan_secrets(table(spark, folder, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_listed(of("assign", "access", "hex")), 256).alias("base_sha256"),
        _listed(F.col("secrets")).alias("spans"),
    )


QUERIES = {"op1_secrets": op1_secrets}
ORACLE: dict[str, str] = {}
