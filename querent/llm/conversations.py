"""Repair of the structure of conversations by least-cost edits.

A conversation's role initials must read `(s?(ua)+)?`: nothing, or an optional system row and then pairs of user and
assistant. Rows are kept (cost 0), reroled to user or assistant (2) or deleted (3); empty rows of either role are inserted
(2). Blank and duplicate rows must be deleted; a truncated row that is not deleted adds 1. Of the cheapest edits those of
the ASCII-least string of initials (D, I, K, R) are taken.

Method: a DAG whose nodes are (rows read, state of the grammar). The weight of a path is one integer: its cost in the high
digits, and below them a digit of three bits for each edit, in order, at places of fixed width; places not reached hold
zero. The integer minimum of the paths that meet in a node decides alone. That is exact: two paths into a node have read
the same rows, so where one string of edits begins with the other, the rest are inserts, which cost; equal costs therefore
differ at a place that both have, and no continuation changes their order. A pair of inserts next to each other never pays,
so a node is relaxed once for inserts. The number of edits so far is read off the lowest digit that is set. Every FLUSH
rows the digits so far become one, the rank of their string among those of the nodes, and the strings are set aside as lists
that share their beginnings: they end in the letter of the same row, so they differ at a place that all have (inserts after
that letter stay digits). Weights thus stay short however long a conversation is.

Rows of a conversation pass through one task, as its result is one string and one hash: sorted by Spark (which spills), and
held in a temporary file of the task beyond HELD bytes; a row's symbol of one byte is all that stays for the decisions.

Defined results: the order is turn (nulls first), then role and text, then input place for equal rows. Nulls in role and
text count as one space. A null conv_id is a conversation. A role's initial is its first character; roles with any other
initial than s, u or a, or an empty role, cannot be kept. A conversation without rows has no edits. Clashing columns are
left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import tempfile
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Digits of the edits, in ASCII order; 0 is padding.
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
_NAMES = "\0DIKR"
_BITS = 3
#: Rows between two times that strings are set aside.
FLUSH = 128
#: Bytes of a conversation that a task holds in memory; beyond it they go to a temporary file of the task.
HELD = 16 << 20
#: States: nothing yet, after system, after user, after assistant. Where a role leads from each; None: nowhere.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
ENDS = (START, ASSISTANT)
#: A row's symbol: the place of its initial in this string, with bits for `must go` and `truncated`.
INITIALS = "sua?"
MUST_GO, CUT = 4, 8

_WORD_CHARACTER = re.compile(r"[^ \t-\r]")
#: All but the last character; the pattern of Spark's and Python's regular expressions alike.
NOT_SPACE = r"[^\x20\x09-\x0D]"


def _places(weight: int, width: int) -> int:
    """How many digits are set: they follow each other from the first place."""
    letters = weight & ((1 << _BITS * width) - 1)
    return width - ((letters & -letters).bit_length() - 1) // _BITS if letters else 0


def cheapest(symbols: bytes) -> tuple[int, str]:
    """Least cost and least string of edits of a conversation's rows."""
    if len(symbols) <= 2 * FLUSH:
        return _cheapest_short(symbols)
    return _cheapest(symbols)


@lru_cache(100_000)
def _cheapest_short(symbols: bytes) -> tuple[int, str]:
    return _cheapest(symbols)


def _cheapest(symbols: bytes) -> tuple[int, str]:
    # the first digit is a rank; past holds what it stands for
    width, best, past = 1, {START: 1}, {1: None}
    for first in range(0, max(len(symbols), 1), FLUSH):
        some = symbols[first : first + FLUSH]
        more = 2 * len(some) + 2  # an edit and an insert a row, and the inserts at both ends
        best, width = {q: w << _BITS * more for q, w in best.items()}, width + more
        best = _read(some, _inserted(best, width), width)
        if first + FLUSH < len(symbols):
            best, width, past = _ranked(best, width, past)
    weight = min(w for q, w in best.items() if q in ENDS)
    digits = _digits(weight, width)
    ends, before = [_letters(digits[1:])], past[digits[0]]
    while before:
        before, letters = before
        ends.append(letters)
    return weight >> _BITS * width, "".join(reversed(ends))


def _digits(weight: int, width: int) -> list[int]:
    return [weight >> _BITS * (width - 1 - k) & 7 for k in range(_places(weight, width))]


def _letters(digits: list[int]) -> str:
    return "".join(_NAMES[d] for d in digits)


def _ranked(best: dict[int, int], width: int, past: dict):
    """The nodes with one digit for the string up to the letter of the last row, and what these digits stand for."""
    split = {}
    for q, w in best.items():
        digits = _digits(w, width)
        n = len(digits)
        while digits[n - 1] == LETTERS["I"]:
            n -= 1
        split[q] = w >> _BITS * width, tuple(digits[:n]), digits[n:]
    ranks = {base: k + 1 for k, base in enumerate(sorted({base for _, base, _ in split.values()}))}
    width = 1 + max(len(tail) for _, _, tail in split.values())
    packed = {}
    for q, (cost, base, tail) in split.items():
        packed[q] = cost << _BITS * width
        for k, d in enumerate([ranks[base], *tail]):
            packed[q] |= d << _BITS * (width - 1 - k)
    return packed, width, {k: (past[base[0]], _letters(base[1:])) for base, k in ranks.items()}


def _inserted(best: dict[int, int], width: int) -> dict[int, int]:
    """The nodes with what an insert makes of them."""
    out, cost = dict(best), INSERT << _BITS * width
    for q, w in best.items():
        digit = LETTERS["I"] << _BITS * (width - 1 - _places(w, width))
        for role in "ua":
            to = NEXT[role][q]
            if to is not None and w + cost + digit < out.get(to, w + cost + digit + 1):
                out[to] = w + cost + digit
    return out


def _read(symbols: bytes, best: dict[int, int], width: int) -> dict[int, int]:
    unit = 1 << _BITS * width
    for symbol in symbols:
        out: dict[int, int] = {}
        extra = TRUNCATED * unit if symbol & CUT else 0
        for q, w in best.items():
            shift = _BITS * (width - 1 - _places(w, width))
            edges = [(q, DELETE * unit + (LETTERS["D"] << shift))]
            if not symbol & MUST_GO:
                kept = NEXT.get(INITIALS[symbol & 3], (None,) * 4)[q]
                edges.append((kept, extra + (LETTERS["K"] << shift)))
                edges += [(NEXT[role][q], REROLE * unit + extra + (LETTERS["R"] << shift)) for role in "ua"]
            for to, weight in edges:
                if to is not None and (to not in out or w + weight < out[to]):
                    out[to] = w + weight
        best = _inserted(out, width)
    return best


def symbol_of(role: str, fault: str | None) -> int:
    k = INITIALS.find(role[:1]) if role[:1] in ("s", "u", "a") else 3
    return k | (MUST_GO if fault in ("blank", "duplicate") else CUT if fault == "truncated" else 0)


def _output(rows, edits: str):
    """(edit, place of the row or None, role, text) of each edit; roles follow from the state."""
    q, rows = START, iter(rows)
    for e in edits:
        if e == "I":
            role = "assistant" if q == USER else "user"
            yield e, None, role, ""
        else:
            place, had, text = next(rows)
            role = had if e in "DK" else "assistant" if q == USER else "user"
            yield e, place, role, text
        if e != "D":
            q = NEXT[role[:1]][q]


class _Held:
    """Rows of one conversation, in memory up to HELD bytes and in a file of the task beyond."""

    def __init__(self):
        self.file, self.symbols, self.rows, self.size = None, bytearray(), [], 0

    def add(self, row, symbol):
        self.symbols.append(symbol)
        self.rows.append(row)
        self.size += len(row[2]) + 64
        if self.size > HELD:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file)
            self.rows, self.size = [], 0

    def all(self):
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
            self.file.close()
        yield from self.rows


#: Faults in the order in which they count.
FAULTS = ("blank", "duplicate", "truncated")
EDITS = "conv_id long, place long, edit string, role string, text string, turn long, fault string, illegal boolean, cost long"
_ROWS, _BYTES = 512, 4 << 20


def faulty(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text; nulls filled) dealt by conversation and in its order, each with its first fault."""
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    # partitions by conv_id serve the window too: one shuffle, two sorts
    rows = rows.repartition("conv_id").withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1)
    last = F.regexp_extract("text", rf"({NOT_SPACE})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(NOT_SPACE), "blank").when(F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault")).sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)


def repairs(rows: DataFrame) -> DataFrame:
    """A row for each edit, by conversation and in order: place (from 0), edit, role and text after it, and of the row read
    its turn, fault and whether its initial may not follow the one before; cost is that of the edit. Parts hold whole
    conversations, so they can be folded without another shuffle."""
    small_batches(rows.sparkSession)
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = faulty(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), fill("role"), fill("text")))
    names = [c.split()[0] for c in EDITS.split(", ")]
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("turn", pa.int64()), ("fault", pa.string()), ("illegal", pa.bool_()), ("cost", pa.int64())])

    def edited(conv_id, held):
        _, edits = cheapest(bytes(held.symbols))
        facts = []

        def texts():
            for turn, role, text, fault, illegal in held.all():
                facts[:] = [(turn, fault, illegal)]
                yield None, role, text

        for place, (e, _, role, text) in enumerate(_output(texts(), edits)):
            turn, fault, illegal = facts[0] if e != "I" else (None, None, False)
            cost = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[e] + (TRUNCATED if fault == "truncated" and e != "D" else 0)
            yield conv_id, place, e, role, text, turn, fault, illegal, cost

    def conversations(batches):
        now, held, before = None, None, ""
        for batch in batches:
            for conv_id, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or conv_id != now:
                    if held:
                        yield from edited(now, held)
                    now, held, before = conv_id, _Held(), None
                illegal = before is not None and before + role[:1] not in ("su", "ua", "au")
                held.add((turn, role, text, fault, illegal), symbol_of(role, fault))
                before = role[:1]
        if held:
            yield from edited(now, held)

    def run(batches):
        kept, size = [], 0
        for row in conversations(batches):
            kept.append(row)
            size += len(row[4])
            if len(kept) >= _ROWS or size >= _BYTES:
                yield _batch(kept, names, schema)
                kept, size = [], 0
        if kept:
            yield _batch(kept, names, schema)

    return rows.mapInArrow(run, EDITS)


def _batch(rows, names, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], schema=schema)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reports(edits: DataFrame) -> DataFrame:
    """repairs() folded to a row for each conversation, in its own partitions and one row at a time."""

    def fold(conv_id, rows):
        sha, audit, some = hashlib.sha256(), [], False
        counts, illegal, cost = dict.fromkeys(FAULTS, 0), 0, 0
        low = last = None
        turns = 0
        for e, role, text, turn, fault, wrong, price in rows:
            audit.append(e)
            if e != "D":
                sha.update(f"{'\n' if some else ''}{role}:{text}".encode())
                some = True
            if fault:
                counts[fault] += 1
            illegal, cost = illegal + wrong, cost + price
            if turn is not None and turn != last:  # in order of turn
                low, last, turns = turn if low is None else low, turn, turns + 1
        return conv_id, 0 if low is None else last - low + 1 - turns, *counts.values(), illegal, cost, "".join(audit), sha.hexdigest()

    names = [c.split()[0] for c in REPORT.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])

    def run(batches):
        from itertools import groupby

        rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6, 7, 8)), strict=True))
        kept = []
        for conv_id, group in groupby(rows, lambda r: r[0]):
            kept.append(fold(conv_id, (r[1:] for r in group)))
            if len(kept) >= _ROWS:
                yield _batch(kept, names, schema)
                kept = []
        if kept:
            yield _batch(kept, names, schema)

    return edits.mapInArrow(run, REPORT)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults planted by the CRC-32 of `conv_id:turn` modulo 20; nulls count as one space there, and become
    one in role and text. 0: the row is lost, 1: its text emptied, 2: without .!?, 3: it is there twice, 4: its role is user."""
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), fill("role").alias("role"), fill("text").alias("text"))
    kind = F.crc32(F.concat(fill("conv_id"), F.lit(":"), fill("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role: Column = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("kind", kind).where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind")
    return rows.select("conv_id", "turn", "role", "text", twice.alias("copy")).drop("copy")


def repair_reports(conversations: DataFrame) -> DataFrame:
    """The report of every conv_id of a table whose rows are damaged first."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = reports(repairs(damaged(conversations)))
    rows = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return rows.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
