"""Repair of conversations whose turns are missing, blank, repeated, cut off or out of role.

A repaired conversation has the roles of a training example: maybe a system turn, then a user
and an assistant turn in alternation, or no turn at all. The cheapest edits that give that are
found by dynamic programming over four states (nothing written, system, user or assistant turn
written last). A row enters it as one of nine symbols, the class of its role and its fault;
equal consecutive symbols are one run. A symbol is a min-plus matrix of four by four, insertions
included, and a run of n rows is applied by the cached binary powers of its matrix, in about
log n steps. From the costs at the ends of runs the choices are unrolled in order, which gives
the audit: one letter per edit, of equal costs the least in ASCII.

Edits: K keeps a row (0), R gives it the role user or assistant (3), D deletes it (4; blank and
repeated rows must be), I inserts an empty turn (3). A row that is cut off and stays costs 3.

Rows pass twice. Once without texts, in the order of their conversation, to find the audit; once
with texts beside the audits, to write the repaired turns. Repeated rows are told by a digest.
Both times a conversation lies in one task, sorted there with spilling; held are its runs
(nine bytes each) and its audit (a byte a row), not its texts. A conversation that holds a third of all rows is one
long task: its audit is one value and the digest of its turns one chain.

Defined cases: a null role or text is one space, so the row is blank or has no legal role. Rows
are ordered by turn (null first), role, digest of the text; rows equal in all of these are equal.
Rows with a null conversation id form one conversation. Turn numbers may repeat and have gaps.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import table

BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3

EMPTY, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: What may be written next: by state, the state after a kept turn with that initial.
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: State after an inserted or a reroled turn, and the role it is given.
GIVEN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (EMPTY, ASSISTANT)

INITIALS = "sua"
MUST_GO = 2 * len(INITIALS) + 2  # the last symbol; the others are class of role * 2 + cut off
NEVER = 1 << 60
STRETCH = 1024
REMEMBERED = 100_000

Vector = tuple[int, ...]


def symbol_of(initial: str, fault: str | None) -> int:
    if fault in ("blank", "duplicate"):
        return MUST_GO
    kind = INITIALS.index(initial) if initial and initial in INITIALS else len(INITIALS)
    return 2 * kind + (fault == "truncated")


def _row_choices(symbol: int) -> list[dict[str, tuple[int, int]]]:
    """By state: cost and next state of each edit that uses up a row with the symbol."""
    choices = []
    for state in STATES:
        edits = {"D": (DELETE, state)}
        if symbol != MUST_GO:
            extra = CUT_OFF if symbol % 2 else 0
            kept = FOLLOWS[state].get((INITIALS + "?")[symbol // 2])
            if kept is not None:
                edits["K"] = (KEEP + extra, kept)
            edits["R"] = (REROLE + extra, GIVEN[state])
        choices.append(edits)
    return choices


def _insertions() -> list[list[int]]:
    """Least cost from state to state by insertions alone."""
    costs = [[NEVER] * len(STATES) for _ in STATES]
    for state in STATES:
        at, cost = state, 0
        while costs[state][at] > cost:
            costs[state][at] = cost
            at, cost = GIVEN[at], cost + INSERT
    return costs


def _product(left: list[list[int]], right: list[list[int]]) -> list[list[int]]:
    return [[min(NEVER, *(a + right[k][j] for k, a in enumerate(row))) for j in STATES] for row in left]


def _matrix(symbol: int) -> list[list[int]]:
    row = [[NEVER] * len(STATES) for _ in STATES]
    for state, edits in enumerate(_row_choices(symbol)):
        for cost, after in edits.values():
            row[state][after] = min(row[state][after], cost)
    return _product(_insertions(), row)


class Repairer:
    """Finds audits; keeps matrix powers and the steps between vectors of costs it has met."""

    def __init__(self):
        self.choices = [_row_choices(s) for s in range(MUST_GO + 1)]
        self.powers = [[_matrix(s)] for s in range(MUST_GO + 1)]
        self.met: dict[tuple, Vector] = {}
        self.end = tuple(min(row[a] for a in ACCEPTED) for row in _insertions())

    def before(self, symbol: int, rows: int, after: Vector) -> Vector:
        """Least costs to the end from before a run, given those from after it."""
        low = min(after)
        known = (symbol, rows, *(c - low for c in after))
        vector = self.met.get(known)
        if vector is None:
            vector, powers = known[2:], self.powers[symbol]
            for bit in range(rows.bit_length()):
                if bit == len(powers):
                    powers.append(_product(powers[-1], powers[-1]))
                if rows >> bit & 1:
                    vector = tuple(min(c + v for c, v in zip(row, vector)) for row in powers[bit])
            if len(self.met) >= REMEMBERED:
                self.met.clear()
            self.met[known] = vector
        return tuple(c + low for c in vector)

    def solve(self, symbols: Sequence[int], rows: Sequence[int]) -> tuple[int, str]:
        """Least cost and the audit of a conversation given as the symbols of its runs and their rows.

        Vectors are kept at every ``STRETCH``-th run; those between are found again when they are unrolled.
        """
        begins = range(0, len(symbols), STRETCH)
        marks, vector = [], self.end
        for begin in reversed(begins):
            marks.append(vector)  # from after the stretch that begins here
            for run in reversed(range(begin, min(begin + STRETCH, len(symbols)))):
                vector = self.before(symbols[run], rows[run], vector)
        cost, here, state, letters = vector[EMPTY], vector, EMPTY, bytearray()
        for begin in begins:
            runs = range(begin, min(begin + STRETCH, len(symbols)))
            ends = [marks.pop()]
            for run in reversed(runs[1:]):
                ends.append(self.before(symbols[run], rows[run], ends[-1]))
            for run in runs:
                for after in self._afters(symbols[run], rows[run], ends.pop()):
                    state = self._unroll(self.choices[symbols[run]], state, here, after, letters)
                    here = after
        while state not in ACCEPTED:
            letters += b"I"
            state = GIVEN[state]
        return cost, letters.decode()

    def _afters(self, symbol: int, rows: int, after: Vector) -> Iterator[Vector]:
        """Costs to the end from after each row of a run, in order, a stretch at a time."""
        while rows:
            stretch = min(rows, STRETCH)
            rows -= stretch
            vectors = [self.before(symbol, rows, after) if rows else after]
            for _ in range(stretch - 1):
                vectors.append(self.before(symbol, 1, vectors[-1]))
            yield from reversed(vectors)

    @staticmethod
    def _unroll(choices: list[dict], state: int, here: Vector, after: Vector, letters: bytearray) -> int:
        """State after a row; adds the least letters among the cheapest ways."""
        while True:
            edits, cost = choices[state], here[state]
            if edits["D"][0] + after[state] == cost:
                letters += b"D"
                return state
            if INSERT + here[GIVEN[state]] == cost:
                letters += b"I"
                state = GIVEN[state]
                continue
            for letter in ("K", "R"):
                price, then = edits.get(letter, (NEVER, EMPTY))
                if price + after[then] == cost:
                    letters += letter.encode()
                    return then


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns ``key``, ``turn``, ``role``, ``text``, gone: a share of the rows dropped (they stay, marked), emptied, cut, repeated, reroled."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col(key).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    content = F.coalesce(F.col(text), space)
    told = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(content, "[.!?]", "")).otherwise(content)
    spoken = F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), space))
    copies = F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))
    return rows.select(
        F.col(key), F.col(turn), spoken.alias(role), told.alias(text), (kind == 0).alias("gone"), F.explode(copies).alias("copy")
    ).drop("copy")


def _ordered(rows: DataFrame, key: str, turn: str, role: str, text: str, gone: Column) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(
        F.col(key).alias("key"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        content.alias("text"),
        F.unhex(F.sha2(content, 256)).alias("digest"),
        gone.alias("gone"),
    )


def _fault() -> Column:
    """First fault of a row that has a rank among those with its role and text."""
    told = F.rtrim("text", F.lit(BLANKS))
    return (
        F.when(F.col("gone"), F.lit("gone"))
        .when(told == "", F.lit("blank"))
        .when(~F.right(told, F.lit(1)).isin(*ENDINGS), F.lit("truncated"))
    )


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_FOUND_NAMES = [part.split()[0] for part in FOUND.split(", ")]
_FOUND_KINDS = (*[pa.int64()] * 6, pa.string())


class _Conversation:
    """What a conversation's rows say so far."""

    def __init__(self):
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.symbols, self.rows = bytearray(), array("q")  # of the runs
        self.first = self.last = self.initial = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        if fault == "gone":
            return
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if fault:
            self.counts[fault] += 1
        symbol = symbol_of(initial, fault)
        if self.symbols and self.symbols[-1] == symbol:
            self.rows[-1] += 1
        else:
            self.symbols.append(symbol)
            self.rows.append(1)

    def result(self, repairer: Repairer) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (gaps, *self.counts.values(), self.illegal, *repairer.solve(self.symbols, self.rows))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current: object = _find  # no key equals this
    state, repairer, kind = _Conversation(), Repairer(), None

    def table_of(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * (1 + len(_FOUND_NAMES))
        arrays = [pa.array(c, t) for c, t in zip(columns, (kind, *_FOUND_KINDS))]
        return pa.RecordBatch.from_arrays(arrays, names=["key", *_FOUND_NAMES])

    for batch in batches:
        kind, done = batch.schema.field("key").type, []
        for key, turn, initial, fault in zip(*(batch.column(n).to_pylist() for n in ("key", "turn", "initial", "fault"))):
            if key != current:
                if current is not _find:
                    done.append((current, *state.result(repairer)))
                current, state = key, _Conversation()
            state.add(turn, initial, fault)
        yield table_of(done)
    if current is not _find:
        yield table_of([(current, *state.result(repairer))])


def _find_repairs(rows: DataFrame) -> DataFrame:
    """Columns key and those of ``FOUND``, from what ``_ordered`` gives."""
    narrow = rows.select(
        "key", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), _fault().alias("fault")
    ).repartition("key")
    gone = F.col("fault") == "gone"
    same = Window.partitionBy("key", "role", "digest", F.coalesce(gone, F.lit(False))).orderBy(F.asc_nulls_first("turn"))
    repeated = (F.row_number().over(same) > 1) & F.coalesce(F.col("fault") == "truncated", F.lit(True))
    faults = narrow.withColumn("seen", repeated).withColumn("fault", F.when(F.col("seen"), F.lit("duplicate")).otherwise(F.col("fault")))
    order = faults.sortWithinPartitions("key", "turn", "role", "digest", "seen")
    kind = rows.schema["key"].dataType.simpleString()
    return order.select("key", "turn", "initial", "fault").mapInArrow(_find, f"key {kind}, {FOUND}")


def _met(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Rows of a conversation in order, behind what was found of it."""
    told = rows.where(~F.col("gone")).select("key", "turn", "role", "digest", "text")
    both = repairs.unionByName(told, allowMissingColumns=True).withColumn("row", F.col("audit").isNull())
    return both.repartition("key").sortWithinPartitions("key", "row", "turn", "role", "digest")


def _apply(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """(values of ``columns``, None) for a conversation, then (letter, turn, role, text) for each of its edits."""
    audit, at, state = "", 0, EMPTY

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, GIVEN[state]
            yield None, ("I", None, ROLE[state], "")

    for batch in batches:
        found = batch.column("audit").to_pylist()
        told = list(zip(*(batch.column(n).to_pylist() for n in ("turn", "role", "text"))))
        for i, own in enumerate(found):
            if own is not None:
                audit, at, state = own, 0, EMPTY
                yield tuple(batch.column(n)[i].as_py() for n in columns), None
            else:
                turn, role, text = told[i]
                letter, at = audit[at], at + 1
                if letter == "K":
                    state = FOLLOWS[state][role[0]]
                elif letter == "R":
                    state = GIVEN[state]
                    role = ROLE[state]
                yield None, (letter, turn, role, text)
            yield from inserted()


EDITED = "rank int, edit string, turn long, role string, text string"


def repair_conversations(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The repaired turns: ``key``, rank (null for deleted rows), edit (K, R, D or I), turn, role, text."""
    ordered = _ordered(rows, key, turn, role, text, F.lit(False))
    kind = rows.schema[key].dataType.simpleString()

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rank = type_ = None

        def noted(batches):
            nonlocal type_
            for batch in batches:
                type_ = batch.schema.field("key").type
                yield batch

        def table_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = (type_, pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string())
            names = [key, *(part.split()[0] for part in EDITED.split(", "))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        out, held = [], 0
        for found, edit in _apply(noted(batches), ["key"]):
            if edit is None:
                own, rank = found[0], 0
                continue
            out.append((own, None if edit[0] == "D" else rank, *edit))
            rank += edit[0] != "D"
            held += len(edit[3])
            if len(out) >= 4096 or held >= 4 << 20:
                yield table_of(out)
                out, held = [], 0
        if out:
            yield table_of(out)

    return _met(ordered, _find_repairs(ordered)).mapInArrow(repair, f"`{key}` {kind}, {EDITED}")


def audit_conversations(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None
) -> DataFrame:
    """A row per conversation: ``key``, what ``FOUND`` names, repaired_sha256 (of ``role:text``, a turn a line).

    Rows for which ``gone`` holds take no part, but name their conversation.
    """
    ordered = _ordered(rows, key, turn, role, text, F.lit(False) if gone is None else gone)
    kind = rows.schema[key].dataType.simpleString()
    columns = ["key", *_FOUND_NAMES]

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_ = None

        def noted(batches):
            nonlocal type_
            for batch in batches:
                type_ = batch.schema.field("key").type
                yield batch

        def table_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = (type_, *_FOUND_KINDS, pa.string())
            arrays = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=[key, *_FOUND_NAMES, "repaired_sha256"])

        own, turns, digest, out = None, 0, hashlib.sha256(), []
        for found, edit in _apply(noted(batches), columns):
            if edit is None:
                if own is not None:
                    out.append((*own, digest.hexdigest()))
                own, turns, digest = found, 0, hashlib.sha256()
                if len(out) >= 4096:
                    yield table_of(out)
                    out = []
            elif edit[0] != "D":
                digest.update(f"{chr(10) if turns else ''}{edit[2]}:{edit[3]}".encode())
                turns += 1
        if own is not None:
            yield table_of([*out, (*own, digest.hexdigest())])

    return _met(ordered, _find_repairs(ordered)).mapInArrow(audit, f"`{key}` {kind}, {FOUND}, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, damaged by a hash of their turns and repaired."""
    rows = damaged(table(spark, folder, "conversations"))
    return audit_conversations(rows, gone=F.col("gone"))


def _plus(state: str, cost: int | str, letters: str) -> str:
    """A state of the dynamic program in SQL, a text of cost (9 digits) and audit, with edits added; '9' is unreachable."""
    return (
        f"CASE WHEN {state} = '9' THEN '9' ELSE "
        f"printf('%09d', CAST(substr({state}, 1, 9) AS BIGINT) + {cost}) || substr({state}, 10) || '{letters}' END"
    )


def _sql() -> str:
    inserted = [
        "s0",
        "s1",
        f"least(s2, {', '.join(_plus(s, INSERT, 'I') for s in ('s0', 's1', 's3'))})",
        f"least(s3, {_plus('s2', INSERT, 'I')}, {', '.join(_plus(s, 2 * INSERT, 'II') for s in ('s0', 's1'))})",
    ]
    kept = lambda s, c: f"CASE WHEN initial = '{c}' THEN {_plus(s, 'extra', 'K')} ELSE '9' END"
    reroled = lambda s: _plus(s, f"{REROLE} + extra", "R")
    entered = [
        [],
        [kept("i0", "s")],
        [e for s in ("i0", "i1", "i3") for e in (kept(s, "u"), reroled(s))],
        [kept("i2", "a"), reroled("i2")],
    ]
    gone = [_plus(f"i{s}", DELETE, "D") for s in STATES]
    moved = [
        f"CASE WHEN must_go THEN {gone[s]} ELSE least({', '.join([gone[s], *entered[s]])}) END" if entered[s] else gone[s]
        for s in STATES
    ]
    inserts = ", ".join(f"{value} AS i{s}" for s, value in enumerate(inserted))
    moves = ", ".join(f"{value} AS s{s}" for s, value in enumerate(moved))
    blanks = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    return f"""
        WITH RECURSIVE
        bits AS (SELECT v, v AS x, 0 AS k FROM (SELECT unnest(range(256)) AS v)
                 UNION ALL SELECT v, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, k + 1
                 FROM bits WHERE k < 8),
        crc AS (SELECT list(x ORDER BY v) AS tab FROM bits WHERE k = 8),
        named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
                  FROM conversations),
        kinds AS (SELECT n.*, xor(4294967295, list_reduce(
                      list_prepend(4294967295, list_transform(range(1, len(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)),
                      lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]))) % 20 AS kind
                  FROM named n, crc),
        rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
                  FROM kinds, (SELECT unnest(range(2)) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n
                   FROM rows_),
        seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
                        rtrim(text, {blanks}) AS told, substr(role, 1, 1) AS initial,
                        lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
                 FROM placed),
        faults AS (SELECT *, told = '' AS blank, told <> '' AND again AS duplicate,
                          told <> '' AND NOT again AND right(told, 1) NOT IN ('.', '!', '?') AS truncated
                   FROM seen),
        coded AS (SELECT *, blank OR duplicate AS must_go, CASE WHEN truncated THEN {CUT_OFF} ELSE 0 END AS extra FROM faults),
        steps AS (SELECT conv_id, 0 AS n, '000000000' AS s0, '9' AS s1, '9' AS s2, '9' AS s3
                  FROM (SELECT DISTINCT conv_id FROM conversations)
                  UNION ALL
                  SELECT conv_id, n, {moves}
                  FROM (SELECT c.conv_id, c.n, initial, must_go, extra, {inserts}
                        FROM steps p JOIN coded c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.n + 1)),
        ends AS (SELECT conv_id, least(s0, i3) AS best
                 FROM (SELECT conv_id, n, s0, {inserts} FROM steps
                       QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)),
        solved AS (SELECT conv_id, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM ends),
        letters AS (SELECT conv_id, p, substr(audit, p, 1) AS letter
                    FROM (SELECT conv_id, audit, unnest(generate_series(1, len(audit))) AS p FROM solved)),
        edits AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS n, count(*) FILTER (letter <> 'D') OVER w AS place
                  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
        written AS (SELECT e.conv_id, e.place, e.letter, c.role AS old, CASE WHEN e.letter <> 'I' THEN c.text ELSE '' END AS text,
                           max(CASE WHEN e.place = 1 AND e.letter = 'K' AND c.initial = 's' THEN 1 ELSE 0 END)
                               OVER (PARTITION BY e.conv_id) AS systems
                    FROM edits e LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.n = e.n
                    WHERE e.letter <> 'D'),
        repaired AS (SELECT conv_id, string_agg(
                         CASE WHEN letter = 'K' THEN old WHEN (place - systems) % 2 = 1 THEN 'user' ELSE 'assistant' END
                         || ':' || text, chr(10) ORDER BY place) AS turns
                     FROM written GROUP BY conv_id),
        counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                           count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                           count(*) FILTER (truncated) AS truncated,
                           count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
                    FROM coded GROUP BY conv_id)
        SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
               sha256(coalesce(turns, '')) AS repaired_sha256
        FROM solved s LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id
                      LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM s.conv_id"""


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLE = {"op12_conversation_repair": _sql()}
