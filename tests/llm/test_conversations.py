from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest

from barflow.llm import conversations as C


def cheapest(faults, initials):
    """Least (cost, edits) by trying all edits of a conversation, with two insertions in a row at most."""
    best, n = (math.inf, ""), len(faults)

    def go(i, roles, cost, edits, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == n and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, edits))
        if i < n:
            go(i + 1, roles, cost + 3, edits + "D", 0)
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                go(i + 1, roles + initials[i], cost + extra, edits + "K", 0)
                for x in "ua":
                    go(i + 1, roles + x, cost + 2 + extra, edits + "R", 0)
        if inserted < 2:
            for x in "ua":
                go(i, roles + x, cost + 2, edits + "I", inserted + 1)

    go(0, "", 0, "", 0)
    return best


def letter(fault, initial):
    kind = {"": C.SOUND, "truncated": C.CUT_OFF, "duplicate": C.DUPLICATE, "blank": C.BLANK}[fault]
    return chr(65 + "sua-".index(initial) + 4 * kind)


def test_prices_and_edits_against_all_edits():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randrange(1, 6)
        faults, initials = rnd.choices(["", "", "", "truncated", "duplicate", "blank"], k=n), rnd.choices("sua-", k=n)
        codes = "".join(map(letter, faults, initials))
        levels = C.prices(codes, C._CLOSE)
        edits, state = C.trace(codes, levels, C.START)
        assert (levels[0][0], edits + C.closing(state)) == cheapest(faults, initials)
        for cut in range(1, n):  # segments give the same prices
            ends = C._through([C.matrix(codes[:cut]), C.matrix(codes[cut:])], C._CLOSE)
            assert ends[:2] == [tuple(levels[0]), tuple(levels[cut])]


def hurt(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind != 0:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))


def plain(rows, damaged=True):
    """The whole contract, a conversation at a time."""
    after = list(hurt(rows)) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        seen, faults = set(), []
        for _, _, role, text in own:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] if r[2][:1] in ("s", "u", "a") else "-" for r in own]
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, edits = cheapest(faults, initials) if own else (0, "")
        told, it, roles = [], iter(own), ""
        for e in edits:
            due = "assistant" if roles[-1:] == "u" else "user"
            row = next(it) if e != "I" else None
            if e != "D":
                told.append((row[2], row[3]) if e == "K" else (due, row[3] if row else ""))
                roles += told[-1][0][0]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, edits, digest))
    return sorted(out, key=str)


def table(seed, conversations=60, most=6):
    rnd = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for _ in range(rnd.randrange(1, most)):
            turn = rnd.choice([None, *range(8), *range(8)])
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rnd.choice(["Yes.", "No", "Well, then!  \n", "", " \t\x0b", None, "é?", " ", "a. ", "one", "two.", "three?"])
            rows.append((conv, turn, role, text))
    return rows


SHAPE = "conv_id bigint, turn bigint, role string, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shift", [C.SHIFT, 1])
def test_against_all_edits(spark, shift):
    rows = table(1)
    df = spark.createDataFrame(rows, SHAPE).coalesce(1).selectExpr("*", "1 AS key", "'x' AS at", "2 AS kind", "3 AS file", "4 AS n")
    assert rows_of(C.report(df, C.damage, shift)) == plain(rows)


def test_long_conversations_in_small_segments(spark):
    """One segment or blocks of blocks: equal results, and the messages give the digest."""
    rnd = random.Random(3)
    rows = [(1, k, rnd.choice(["user", "assistant", "system"]), f"text {rnd.randrange(250)}" + rnd.choice(["", ".", "!"])) for k in range(400)]
    rows += [(2, k, "user", "same.") for k in range(300)] + [(3, 0, "user", "x" * 1_500_000 + "."), (3, 1, "user", "y" * 1_500_000)]
    df = spark.createDataFrame(rows, SHAPE)
    whole, small = (rows_of(C.report(df, shift=s)) for s in (C.SHIFT, 2))
    assert whole == small and [r[0] for r in whole] == [1, 2, 3]
    assert whole[1][7] == "K" + "D" * 298 + "R" or whole[1][6] == 3 * 299 + 2
    told = {}
    for r in C.repair(df, shift=2).orderBy("conv_id", "turn").collect():
        told.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {r[0]: r[8] for r in whole} == {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in told.items()}


def test_an_empty_table(spark):
    df = spark.createDataFrame([], SHAPE)
    assert C.report(df, C.damage).count() == 0 and C.repair(df).count() == 0
