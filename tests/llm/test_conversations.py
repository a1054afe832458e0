import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querent.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, place string"


def brute(symbols):
    """Uniform-cost search over whole (cost, string) pairs, inserts unbounded but for cost: the first goal is the answer."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, edits, i, roles = heapq.heappop(heap)
        state = roles if len(roles) < 2 else roles[-1] + "+"
        if i == len(symbols) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, edits
        if (i, state, edits) in seen:
            continue
        seen.add((i, state, edits))

        def push(more, letter, j, role):
            new = roles + role
            if re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, edits + letter, j, new))

        if not edits.endswith("II"):
            push(2, "I", i, "u")
            push(2, "I", i, "a")
        if i < len(symbols):
            x = symbols[i]
            push(3, "D", i + 1, "")
            if not x & c.MUST_GO:
                t = 1 if x & c.CUT else 0
                if c.INITIALS[x & 3] != "?":
                    push(t, "K", i + 1, c.INITIALS[x & 3])
                push(2 + t, "R", i + 1, "u")
                push(2 + t, "R", i + 1, "a")
    raise AssertionError


ROWS = st.lists(st.sampled_from([0, 1, 2, 3, 5, 8, 9, 10, 11]), max_size=6).map(bytes)


@settings(max_examples=150, deadline=None)
@given(ROWS)
def test_cheapest_edits_match_a_search_over_all(symbols):
    assert c.cheapest(symbols) == brute(symbols)


def test_flushed_digits_change_nothing(monkeypatch):
    import random

    rng = random.Random(4)
    for n in (0, 1, 7, 60, 300):
        symbols = bytes(rng.choice([0, 1, 1, 1, 2, 2, 2, 3, 5, 9, 10]) for _ in range(n))
        monkeypatch.setattr(c, "FLUSH", 10_000)
        whole = c._cheapest(symbols)
        for flush in (1, 2, 5, 64):
            monkeypatch.setattr(c, "FLUSH", flush)
            assert c._cheapest(symbols) == whole
    monkeypatch.setattr(c, "FLUSH", 128)
    cost, edits = c.cheapest(b"\x01" * 100_000)  # 50,000 users too many
    assert cost == 100_000 and edits == "KR" * 50_000


def whole_result(rows):
    """A plain reading of the contract, in tuples."""
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, items in by.items():
        after = []
        for turn, role, text in items:
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if k == 1:
                text = ""
            if k == 2:
                text = re.sub("[.!?]", "", text)
            if k == 4:
                role = "user"
            after += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        after.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        n, seen, symbols = dict.fromkeys(c.FAULTS, 0), set(), []
        for turn, role, text in after:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            symbols.append(c.symbol_of(role, fault))
        cost, audit = brute(bytes(symbols))
        q, left, final = "", list(after), []
        for e in audit:
            if e == "I":
                final.append(("assistant" if q == "u" else "user", ""))
            else:
                _, role, text = left.pop(0)
                if e == "D":
                    continue
                final.append((role if e == "K" else "assistant" if q == "u" else "user", text))
            q = final[-1][0][:1]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        turns = {t for t, _, _ in after if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()))
    return out


def check(spark, rows):
    got = c.repair_reports(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(whole_result(rows), key=repr)


def test_matches_brute_force(spark):
    import random

    rng = random.Random(9)
    rows = []
    for conv in range(300):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn + 3 * (rng.random() < 0.1), rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Fine.", "no end", "Why? ", f"text {turn}!", "x"]), "clash"))
    check(spark, rows)


def test_nulls_ties_repeats_and_odd_roles(spark):
    rows = [(None, None, None, None, None), (None, 1, "user", "a.", ""), (1, None, "user", "b.", ""), (1, None, None, "c.", ""), (1, 0, "assistant", None, "")]
    rows += [(2, 5, "user", "same.", "")] * 4 + [(3, 1, "tool", "x.", ""), (3, 2, "", "y.", ""), (3, 2, "User", "z.", ""), (3, 9, "s", "t.", "")]
    rows += [(4, 1, "assistant", "b.", ""), (4, 1, "user", "a.", ""), (4, 1, "assistant", "a.\n", "")]
    check(spark, rows)
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "all rows are lost.", "")])
    assert c.repair_reports(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversations_and_texts_spill(spark, monkeypatch):
    rows = [(7, k, "user" if k % 3 else "assistant", f"row {k}" + "." * (k % 2), "") for k in range(3000)] + [(8, 0, "user", "é" * 3_000_000 + ".", "")]
    want = {r.conv_id: r for r in c.repair_reports(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(want[7].audit) >= 2500 and want[8].audit in ("KI", "RI", "D", "IK", "KDI", "RDI")
    held = c._Held()
    monkeypatch.setattr(c, "HELD", 500)
    for k in range(100):
        held.add((k, "user", f"t{k}", None, False), 1)
    assert held.file and [r[0] for r in held.all()] == list(range(100))


def test_edits_hold_the_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Cut off")]
    got = c.repairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("place").collect()
    assert [(r.edit, r.role, r.text, r.fault, r.cost) for r in got] == [("D", "user", "Hi.", None, 3), ("K", "user", "Again.", None, 0), ("K", "assistant", "Cut off", "truncated", 1)] or "".join(r.edit for r in got) == "KIKK"


@pytest.mark.parametrize("symbols,want", [([], (0, "")), ([0], (3, "D")), ([1, 2], (0, "KK")), ([2], (2, "IK")), ([0, 1, 2], (0, "KKK")), ([5], (3, "D")), ([1, 1], (2, "KR"))])
def test_small_cases(symbols, want):
    assert c.cheapest(bytes(symbols)) == want
