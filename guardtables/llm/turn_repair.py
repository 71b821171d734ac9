"""Conversation structure repair: least-cost edits by a rank-convergence parallel Viterbi.

Rows of a conversation are edited so that their role initials read ``(s?(ua)+)?``. States are what the repaired
conversation ends with: nothing, s, u or a; a row is kept, given another role or deleted, and turns can be inserted.
``costs[i][state]`` is the least cost of all rows from i on. It is computed backwards, chunk by chunk, where a chunk is
what one partition holds of a conversation:

1. every chunk that is not its conversation's last starts from a speculative vector, that of a conversation's end;
2. fix-up passes start chunks again from the vector that the chunk after them has reached, and stop inside a chunk as
   soon as the vector differs from the one found before by a constant only; they end when no chunk's start changes;
3. each chunk tells for every state it may begin in where it ends, so the driver links the chunks of a conversation (at
   most two a partition);
4. every chunk follows the least edits forwards from its true state. Pieces of a conversation in several partitions are
   put together as a stream.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import tidy
from .sequences import PART_ROWS, ordered

# States, and what follows a turn of a role in each; the state after a user's turn is 2, after an assistant's 3.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
# The one role that may come next in each state, when a turn is inserted or given another role.
WANTED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# Costs after the last row: only nothing and an assistant's turn may end a conversation.
END = (0, 6, 3, 0)
# A vector is kept for every so many rows of a chunk.
STRIDE = 64
FAULTS = ("", "blank", "duplicate", "truncated")


def step(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row from those after it. A symbol is 4 times the fault plus the place of the initial in "sua?"."""
    return insertions([min(c for _, c, _ in choices(symbol, state, after)) for state in range(4)])


def choices(symbol: int, state: int, after: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """What can be done with a row in a state: initial of the edit, cost with all that follows, next state."""
    fault, initial = FAULTS[symbol >> 2], "sua?"[symbol & 3]
    found = [("D", DELETE + after[state], state)]
    if fault in ("blank", "duplicate"):
        return found
    extra = TRUNCATED if fault == "truncated" else 0
    following = NEXT[initial][state] if initial in NEXT else None
    if following is not None:
        found.append(("K", KEEP + extra + after[following], following))
    return found + [("R", REROLE + extra + after[WANTED[state]], WANTED[state])]


def insertions(costs: list[int]) -> tuple[int, ...]:
    """Costs when turns may be inserted as well: no more than two are ever needed."""
    one = [min(c, INSERT + costs[WANTED[s]]) for s, c in enumerate(costs)]
    return tuple(min(c, INSERT + one[WANTED[s]]) for s, c in enumerate(one))


_STEPS: dict[tuple, tuple] = {}


def relative(costs: tuple[int, ...]) -> tuple[int, ...]:
    """A vector without its constant: parallel vectors become equal."""
    least = min(costs)
    return tuple(c - least for c in costs)


def backward(symbols: bytes, end: tuple[int, ...], known: list[tuple[int, ...]] | None = None):
    """The relative vector before the first row, and vectors at every ``STRIDE``-th row.

    ``known`` are those vectors from an earlier pass: the pass stops where it meets one, as all before it stay as they were.
    """
    vector, marks = relative(end), list(known) if known else [()] * (len(symbols) // STRIDE + 1)
    for i in range(len(symbols) - 1, -1, -1):
        vector = step_back(symbols[i], vector)
        if i % STRIDE == 0:
            if known and known[i // STRIDE] == vector:
                return known[0], marks
            marks[i // STRIDE] = vector
    return vector, marks


def step_back(symbol: int, vector: tuple[int, ...]) -> tuple[int, ...]:
    """``step`` on relative vectors, of which there are few."""
    found = _STEPS.get((symbol, vector))
    if found is None:
        found = _STEPS[symbol, vector] = relative(step(symbol, vector))
    return found


def all_vectors(symbols: bytes, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Relative vectors before every row and after the last."""
    found = [relative(end)]
    for symbol in reversed(symbols):
        found.append(step_back(symbol, found[-1]))
    return found[::-1]


def trace(symbols: bytes, vectors: list[tuple[int, ...]], state: int, ends: bool) -> tuple[int, list[str], int]:
    """Least edits from a state: the state after them, the edits before and on each row (and after the last), cost.

    Of the edits on a cheapest way the ASCII-least initial is taken each time. No cheapest sequence begins another, as
    further edits would cost, so this gives the least sequence.
    """
    edits, cost = [], 0
    for i, symbol in enumerate(symbols):
        after, here = vectors[i + 1], ""
        rows = [choices(symbol, s, after) for s in range(4)]
        bare = [min(c for _, c, _ in r) for r in rows]
        whole = insertions(bare)
        while True:
            options = [(e, c, s) for e, c, s in rows[state] if c == whole[state]]
            if INSERT + whole[WANTED[state]] == whole[state]:
                options.append(("I", 0, WANTED[state]))
            edit, _, following = min(options)
            here += edit
            if edit == "I":
                cost, state = cost + INSERT, following
                continue
            cost += {"D": DELETE, "K": KEEP, "R": REROLE}[edit]
            if edit != "D" and FAULTS[symbol >> 2] == "truncated":
                cost += TRUNCATED
            state = following
            break
        edits.append(here)
    here = ""
    while ends and state not in (START, ASSISTANT):
        here, cost, state = here + "I", cost + INSERT, WANTED[state]
    return state, [*edits, here], cost


def reached(symbols: bytes, end: tuple[int, ...]) -> list[int]:
    """The state after the chunk for every state before it."""
    vectors = all_vectors(symbols, end)
    return [trace(symbols, vectors, state, False)[0] for state in range(4)]


# --- rows --------------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage of the contract, by crc32(``conv_id:turn``) % 20; nulls in texts and keys are one space.

    ``row_no`` numbers the rows; a repeated row has two numbers.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")),
        F.monotonically_increasing_id().alias("row_no"),
    )
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    hit = F.crc32(key.cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(hit == 4, "user").otherwise(F.col("role"))
    copies = F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(hit != 0).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), "row_no", F.explode(copies).alias("copy")
    ).withColumn("row_no", F.col("row_no") * 2 + F.col("copy")).drop("copy")


def with_symbols(rows: DataFrame) -> DataFrame:
    """Rows with ``symbol``: 4 times the first fault (1 blank, 2 duplicate, 3 truncated) plus the initial's place in "sua?"."""
    one, two = F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "text", "role")
    rows = rows.withColumns({"d1": one, "d2": two})
    # The first of equal rows of a conversation, where there are several.
    first = rows.groupBy("conv_id", "d1", "d2").agg(
        F.min(F.struct("turn", "row_no"))["row_no"].alias("first_no"), F.count("*").alias("n")
    ).where("n > 1").select(F.col("conv_id").alias("c"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), "first_no")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    marked = rows.join(first, same, "left")
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1)
        .when(F.col("first_no") != F.col("row_no"), 2)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)
    )
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return marked.select("conv_id", "turn", "role", "text", "row_no", (fault * 4 + place).alias("symbol"))


def runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list[list]]]:
    """What a partition holds of each conversation, by its place in the partition: lists of the named columns."""
    number, group, held = 0, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        convs = batch.column("conv_id").to_pylist()
        columns = [batch.column(n).to_pylist() for n in names]
        at = 0
        while at < len(convs):
            upto = at + 1
            while upto < len(convs) and convs[upto] == convs[at]:
                upto += 1
            if held is not None and convs[at] == group:
                for kept, c in zip(held, columns, strict=True):
                    kept += c[at:upto]
            else:
                if held is not None:
                    yield number, group, held
                    number += 1
                group, held = convs[at], [c[at:upto] for c in columns]
            at = upto
    if held is not None:
        yield number, group, held


# --- chunks at the ends of partitions ------------------------------------------------------------------------------------

CHUNK = "part int, last boolean, single boolean, conv_id long, symbols binary, marks binary, vector array<int>"


def coded(marks: list[tuple[int, ...]]) -> bytes:
    return bytes(c for m in marks for c in m)


def decoded(marks: bytes) -> list[tuple[int, ...]]:
    return [tuple(marks[i : i + 4]) for i in range(0, len(marks), 4)]


def _chunk(part, last, single, conv, symbols, marks, vector) -> dict:
    return {
        "part": part, "last": last, "single": single, "conv_id": conv, "symbols": symbols, "marks": coded(marks),
        "vector": list(vector),
    }


_CHUNK_TYPE = pa.schema([
    ("part", pa.int32()), ("last", pa.bool_()), ("single", pa.bool_()), ("conv_id", pa.int64()), ("symbols", pa.binary()),
    ("marks", pa.binary()), ("vector", pa.list_(pa.int32())),
])


def _border_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last chunk of a partition, backwards from the vector of a conversation's end."""
    kept = []
    for number, conv, (symbols, parts) in runs(batches, ("symbol", "part")):
        entry = (parts[0], conv, bytes(symbols))
        kept = [entry] if number == 0 else [kept[0], entry]
    found = []
    for at, (part, conv, symbols) in enumerate(kept):
        vector, marks = backward(symbols, END)
        found.append(_chunk(part, at == len(kept) - 1, len(kept) == 1, conv, symbols, marks, vector))
    if found:
        yield pa.RecordBatch.from_pylist(found, _CHUNK_TYPE)


def _fixed(ends: dict):
    """Chunks again from the vectors that the chunks after them reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                end = ends.get((r["part"], r["last"]))
                if end is not None:
                    vector, marks = backward(r["symbols"], end, decoded(r["marks"]))
                    r |= {"vector": list(vector), "marks": coded(marks)}
                found.append(r)
            yield pa.RecordBatch.from_pylist(found, _CHUNK_TYPE)

    return run


def _reached(ends: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([r["part"] for r in rows], pa.int32()), "last": [r["last"] for r in rows],
                "states": pa.array([reached(r["symbols"], ends[r["part"], r["last"]]) for r in rows], pa.list_(pa.int32())),
            })

    return run


def linked(chunks: DataFrame) -> tuple[dict, dict, int]:
    """True end vectors and start states of chunks whose conversation goes on in another partition, and the passes run.

    Keys are (part, whether it is the partition's last chunk). Only vectors and states reach the driver.
    """
    def summaries() -> list:
        return chunks.select("part", "last", "single", "conv_id", "vector").orderBy("part", "last").collect()

    listed = summaries()
    follows = {}  # the chunk after a chunk of the same conversation
    for a, b in zip(listed, listed[1:]):
        if a["last"] and a["part"] != b["part"] and a["conv_id"] == b["conv_id"]:
            follows[a["part"], a["last"]] = (b["part"], b["last"])
    ends, passes = {key: END for key in follows}, 0
    while follows:
        vectors = {(r["part"], r["last"]): tuple(r["vector"]) for r in listed}
        changed = {k: vectors[n] for k, n in follows.items() if relative(ends[k]) != vectors[n]}
        if not changed:
            break
        ends |= changed
        chunks = cut(chunks.mapInArrow(_fixed(changed), CHUNK))
        listed, passes = summaries(), passes + 1
    begins = {}
    if follows:
        border = set(follows) | set(follows.values())
        true_ends = {(r["part"], r["last"]): ends.get((r["part"], r["last"]), END) for r in listed}
        states = {
            (r["part"], r["last"]): r["states"]
            for r in chunks.mapInArrow(_reached(true_ends), "part int, last boolean, states array<int>").collect()
        }
        heads = border - set(follows.values())
        for key in heads:
            state = START
            while True:
                begins[key] = state
                if key not in follows:
                    break
                state, key = states[key][state], follows[key]
    return ends, begins, passes


# --- edits and digests -----------------------------------------------------------------------------------------------------

PIECE = (
    "conv_id long, part int, piece int, audit string, text string, rows long, blank long, duplicate long, truncated long, "
    "illegal long, cost long, turns long, first_turn long, last_turn long, first_initial string, last_initial string"
)
_PIECE_TYPE = pa.schema([
    (f.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]]) for f in PIECE.split(", ")
])
# Characters of text in one piece, about.
PIECE_CHARS = 1 << 20


def repaired(symbols: bytes, edits: list[str], roles: list[str], texts: list[str], state: int) -> Iterator[str]:
    """Lines ``role:text`` of the repaired rows."""
    for i, here in enumerate(edits):
        for edit in here:
            if edit == "I":
                state = WANTED[state]
                yield ROLE[state] + ":"
            elif edit == "K":
                state = NEXT["sua?"[symbols[i] & 3]][state]
                yield f"{roles[i]}:{texts[i]}"
            elif edit == "R":
                state = WANTED[state]
                yield f"{ROLE[state]}:{texts[i]}"


def illegal(before: str | None, after: str | None) -> bool:
    return before is not None and after is not None and before + after not in ("su", "ua", "au")


def chunk_pieces(conv, part: int, columns: list[list], end: tuple | None, state: int) -> Iterator[dict]:
    """One chunk's edits and lines, in pieces; the first piece holds the counts. ``end`` is None at a conversation's end."""
    turns, roles, texts, symbols = columns
    symbols = bytes(symbols)
    _, edits, cost = trace(symbols, all_vectors(symbols, end or END), state, end is None)
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    faults = [symbols.count(bytes([4 * f + i])) for f in (1, 2, 3) for i in range(4)]
    counts = {
        "rows": len(symbols), "blank": sum(faults[:4]), "duplicate": sum(faults[4:8]), "truncated": sum(faults[8:]),
        "illegal": sum(illegal(a, b) for a, b in zip(initials, initials[1:])), "cost": cost, "turns": len(set(known)),
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
        "first_initial": initials[0], "last_initial": initials[-1],
    }
    lines, chars, piece = [], 0, 0
    base = {"conv_id": conv, "part": part}
    audit = "".join(edits)
    for line in repaired(symbols, edits, roles, texts, state):
        if chars > PIECE_CHARS:
            yield base | counts | {"piece": piece, "audit": audit, "text": "\n".join(lines)}
            lines, chars, piece, counts, audit = [], 0, piece + 1, {}, ""
        lines.append(line)
        chars += len(line)
    yield base | counts | {"piece": piece, "audit": audit, "text": "\n".join(lines) if lines else None}


def _pieces(ends: dict, begins: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size = None, [], 0

        def made(entry, is_last: bool) -> Iterator[dict]:
            number, conv, (parts, *columns) = entry
            # Only the first and the last chunk of a partition (one, if it is the only one) may go on in another partition.
            key = (parts[0], is_last) if is_last or number == 0 else None
            yield from chunk_pieces(conv, parts[0], columns, ends.get(key), begins.get(key, START))

        def given(entry, is_last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal out, size
            for row in made(entry, is_last):
                out.append(row)
                size += len(row["text"] or "") + 100
                if size > PIECE_CHARS:
                    yield pa.RecordBatch.from_pylist(out, _PIECE_TYPE)
                    out, size = [], 0

        for entry in runs(batches, ("part", "turn", "role", "text", "symbol")):
            if held is not None:
                yield from given(held, False)
            held = entry
        if held is not None:
            yield from given(held, True)
        if out:
            yield pa.RecordBatch.from_pylist(out, _PIECE_TYPE)

    return run


RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
_RESULT_TYPE = pa.schema([
    (f.split()[0], {"long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in RESULT.split(", ")
])


class Conversation:
    """A conversation whose pieces come in order."""

    def __init__(self, conv):
        self.conv, self.sums, self.audit = conv, dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0), []
        self.turns, self.first, self.last, self.initial = 0, None, None, None
        self.hash, self.empty = hashlib.sha256(), True

    def add(self, r: dict) -> None:
        if r["rows"] is not None:
            for name in self.sums:
                self.sums[name] += r[name]
            self.sums["illegal"] += illegal(self.initial, r["first_initial"])
            self.initial = r["last_initial"]
            if r["first_turn"] is not None:
                self.turns += r["turns"] - (self.last == r["first_turn"])
                self.first = r["first_turn"] if self.first is None else self.first
                self.last = r["last_turn"]
            self.audit.append(r["audit"])
        if r["text"] is not None:
            self.hash.update((b"" if self.empty else b"\n") + r["text"].encode())
            self.empty = False

    def row(self) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {
            "conv_id": self.conv, "gaps": gaps, **self.sums, "audit": "".join(self.audit),
            "repaired_sha256": self.hash.hexdigest(),
        }


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_, out = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if open_ is None or open_.conv != r["conv_id"]:
                if open_ is not None:
                    out.append(open_.row())
                open_ = Conversation(r["conv_id"])
            open_.add(r)
        if out:
            yield pa.RecordBatch.from_pylist(out, _RESULT_TYPE)
            out = []
    if open_ is not None:
        yield pa.RecordBatch.from_pylist([open_.row()], _RESULT_TYPE)


def repair_pieces(conversations: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The repaired conversations in pieces (``PIECE``): edits, lines and counts of each chunk, in order of part and piece."""
    rows = with_symbols(damaged(conversations))
    kept = ["conv_id", "turn", "role", "text", "symbol"]
    turns = ordered(rows, ["conv_id", "turn", "role", "text", "row_no"], kept, conversations.count(), part_rows)
    chunks = cut(turns.select("conv_id", "symbol", "part").mapInArrow(tidy(_border_chunks), CHUNK))
    ends, begins, _ = linked(chunks)
    return turns.mapInArrow(tidy(_pieces(ends, begins)), PIECE)


def repair(conversations: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Faults and least edits of each damaged conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256``.

    Rows are in the order of turn (null first), then role and text as damaged; rows equal in all of these are equal. Rows
    with a null conv_id make one conversation, whose id is null. A null role or text is one space. Other columns are not read. A
    table without rows has no result; a conversation that loses all rows has zeros, an empty audit and the hash of
    nothing. A text may have any length that fits one row. A conversation may be spread over any number of partitions;
    only its finished lines pass one task, as a stream, for the hash.
    """
    pieces = repair_pieces(conversations, part_rows)
    whole = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(tidy(_joined), RESULT)
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    zero = F.lit(0).cast("long")
    values: list[Column] = [F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(whole, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *values, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
