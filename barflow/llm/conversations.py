"""Conversation repair: the cheapest edits to a legal order of roles, by an auction algorithm for shortest paths."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow import session
from barflow.llm import text as T

# Fixed values of the contract.
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FOLLOWS = {"su", "ua", "au"}
# A segment holds the rows of a conversation among 2 ** SHIFT neighbours of the sorted layout; so many segments make a block.
SHIFT = 10

# What the kept roles end with: nothing, the system's turn, the user's, the assistant's. Conversations may end in 0 and 3.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = ("user", "user", "assistant", "user")
# What it costs to end after each, by insertions.
_CLOSE = (0, 2 * INSERT, INSERT, 0)
# A row's code is a letter: its role's initial (s, u, a, other), and four times its fault.
_INITIALS = "sua"
SOUND, CUT_OFF, DUPLICATE, BLANK = range(4)
_FIRST = ord("A")
_COST = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}


def damage(rows: DataFrame) -> DataFrame:
    """The faults of the contract, by a checksum of conversation and turn: 1 in 20 rows each goes, loses its text or its stops,
    is repeated, or becomes the user's. Other columns of `rows` are kept."""
    named = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))
    kind = F.crc32(named) % 20
    hurt = rows.withColumn("_kind", kind).filter("_kind != 0").withColumns(
        {
            "role": F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))),
            "text": F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(F.coalesce("text", F.lit(" ")), STOPS, ""))
            .otherwise(F.coalesce("text", F.lit(" "))),
        }
    )
    times = F.when(F.col("_kind") == 3, 2).otherwise(1)
    return hurt.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_kind", "_copy")


def _arcs(code: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits of a row with this code, in the order of their letters: (letter, cost, state after it)."""
    fault, initial = divmod(code, 4)
    extra = TRUNCATED if fault == CUT_OFF else 0
    out = []
    for state, after in enumerate(_NEXT):
        arcs = [("D", DELETE, state)]
        if fault in (SOUND, CUT_OFF):
            if initial == 0 and state == START:
                arcs.append(("K", extra, SYSTEM))
            if initial < 3 and _INITIALS[initial] == _ROLE[state][0]:
                arcs.append(("K", extra, after))
            arcs.append(("R", REROLE + extra, after))
        out.append(tuple(arcs))
    return tuple(out)


_ARCS = {chr(_FIRST + code): _arcs(code) for code in range(16)}


def prices(codes: str, end: tuple[float, ...]) -> list[list[float]]:
    """Converged dual prices of every node (rows done, state): what it costs from there to the end, given the prices there.

    The lattice has an arc for each edit; prices never exceed an arc's cost plus the price behind it. Origins are served from
    the last row to the first, and keep the prices of those served before. An origin's path is extended along an arc that
    is tight, and contracted with a higher price at a node where none is, until it meets a node whose price has converged:
    then the whole path is tight, and so its prices are distances. Prices are whole numbers, or infinite where no edits lead on.
    """
    levels = [list(end)]
    for code in reversed(codes):
        after, arcs = levels[-1], _ARCS[code]
        low = min(after) + (0 if any(a[0] == "K" for s in arcs for a in s) else REROLE if len(arcs[0]) > 1 else DELETE)
        price, served = [low] * 4, [False] * 4
        for origin in range(4):
            path = [origin]
            while not served[path[-1]]:
                tip = path[-1]
                best, ahead = min((cost + after[to], -1) for _, cost, to in arcs[tip])
                more = INSERT + price[_NEXT[tip]]
                if more < best:
                    best, ahead = more, _NEXT[tip]
                if price[tip] < best < math.inf:
                    price[tip] = best
                    if len(path) > 1:
                        path.pop()
                elif ahead >= 0 and best < math.inf:
                    path.append(ahead)
                else:
                    price[tip] = best
                    served[tip] = True
            for node in path:
                served[node] = True
        levels.append(price)
    return levels[::-1]


def trace(codes: str, levels: list[list[float]], state: int) -> tuple[str, int]:
    """The least string of edits along tight arcs from `state` at the first row, and the state after the last."""
    out = []
    for i, code in enumerate(codes):
        here, after = levels[i], levels[i + 1]
        while True:
            tight = [(letter, to) for letter, cost, to in _ARCS[code][state] if here[state] == cost + after[to]]
            if here[state] == INSERT + here[_NEXT[state]]:
                tight.append(("I", _NEXT[state]))
            letter, state = min(tight)
            out.append(letter)
            if letter != "I":
                break
    return "".join(out), state


def closing(state: int) -> str:
    return "I" * (_CLOSE[state] // INSERT)


@lru_cache(maxsize=20_000)
def _short(codes: str) -> tuple[str, str]:
    edits, state = trace(codes, prices(codes, _CLOSE), START)
    return edits, str(state)


def _solved(codes: str) -> tuple[str, str]:
    """Edits of a whole conversation, and the state they end in; those of short ones are remembered, as few differ."""
    return _short(codes) if len(codes) <= 64 else _short.__wrapped__(codes)


def matrix(codes: str) -> list[int]:
    """What the edits of a segment cost from each state before it to each after it, -1 where none lead there."""
    out = [[math.inf] * 4 for _ in range(4)]
    for to in range(4):
        end = tuple(0 if s == to else math.inf for s in range(4))
        first = _reachable(codes, end, to)
        for s in range(4):
            out[s][to] = first[s]
    return [-1 if x == math.inf else int(x) for row in out for x in row]


def _reachable(codes: str, end: tuple[float, ...], to: int) -> list[float]:
    if to >= USER:
        return prices(codes, end)[0]
    # only deletions stay before the user's first turn, and at most one kept system row
    cost = list(end)
    for code in reversed(codes):
        arcs = _ARCS[code]
        cost = [min((c + cost[t] for _, c, t in arcs[s] if t <= SYSTEM), default=math.inf) if s <= to else math.inf for s in range(4)]
    return cost


def _through(ms, end: tuple[float, ...]) -> list[tuple[float, ...]]:
    """Prices at the end of each of several consecutive segments, from those at the end of the last; then those before all."""
    out = [end]
    for m in reversed(ms):
        end = tuple(min(math.inf if m[4 * s + t] < 0 else m[4 * s + t] + end[t] for t in range(4)) for s in range(4))
        out.append(end)
    return out[::-1]


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"key": batch["key"], "seg": batch["seg"], "m": [matrix(c) for c in batch["codes"]]})


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = []
        for ms in batch["ms"]:
            ends = [_through([x["m"] for x in ms], tuple(0 if s == to else math.inf for s in range(4)))[0] for to in range(4)]
            made.append([-1 if ends[to][s] == math.inf else int(ends[to][s]) for s in range(4) for to in range(4)])
        yield pd.DataFrame({"key": batch["key"], "seg": batch["seg"], "m": made})


def _pushed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, segs, ends = [], [], []
        for key, ms, end in zip(batch["key"], batch["ms"], batch["end"], strict=True):
            after = _through([x["m"] for x in ms], tuple(math.inf if e < 0 else e for e in end))[1:]
            keys += [key] * len(ms)
            segs += [x["seg"] for x in ms]
            ends += [[-1 if x == math.inf else int(x) for x in e] for e in after]
        yield pd.DataFrame({"key": keys, "seg": segs, "end": ends})


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each segment its edits from every state before it, and the states after them."""
    for batch in batches:
        edits, after = [], []
        for codes, end in zip(batch["codes"], batch["end"], strict=True):
            if end is None:
                made, state = _solved(codes)
                edits.append([made])
                after.append(state)
                continue
            levels = prices(codes, tuple(math.inf if e < 0 else e for e in end))
            ways = [trace(codes, levels, s) if levels[0][s] < math.inf else ("", START) for s in range(4)]
            edits.append([w for w, _ in ways])
            after.append("".join(str(s) for _, s in ways))
        yield pd.DataFrame({"key": batch["key"], "seg": batch["seg"], "codes": batch["codes"], "edits": edits, "after": after})


def _blocks(ms: DataFrame, shift: int) -> DataFrame:
    """key, seg (of the block), ms: consecutive segments' matrices, 2 ** shift of them at most."""
    block = F.shiftright("seg", shift).alias("block")
    return ms.groupBy("key", block).agg(F.array_sort(F.collect_list(F.struct("seg", "m"))).alias("ms")).withColumnRenamed("block", "seg")


def _ends(segments: DataFrame, shift: int) -> DataFrame:
    """key, seg, end: the prices after each segment of conversations with several.

    Matrices are multiplied in blocks, blocks of blocks and so on until each conversation is one; prices then come down the
    same way. No task holds more than 2 ** shift matrices of 16 numbers, however long a conversation.
    """
    shape = "key string, seg bigint, m array<bigint>"
    levels = [session.settle(segments.mapInPandas(_matrices, shape), "matrices")]
    while not levels[-1].groupBy("key").count().filter("count > 1").isEmpty():
        levels.append(session.settle(_blocks(levels[-1], shift).mapInPandas(_products, shape), "products"))
    ends = levels[-1].select("key", "seg", F.array(*map(F.lit, _CLOSE)).cast("array<bigint>").alias("end"))
    for level in reversed(levels[:-1]):
        down = _blocks(level, shift).join(ends.hint("merge"), ["key", "seg"])
        ends = session.settle(down.mapInPandas(_pushed, "key string, seg bigint, end array<bigint>"), "prices")
    return ends


Fault = Callable[[DataFrame], DataFrame]


def _rows(conversations: DataFrame, fault: Fault | None) -> DataFrame:
    """key (conv_id as text), known (whether turn is), turn, role, text, file, row: rows in order by all but the texts."""
    placed = T.located(conversations.select("conv_id", "turn", "role", "text"), "turns")
    rows = placed.select(*(F.col("doc")[c].alias(c) for c in ("conv_id", "turn", "role", "text")), "at.file", "at.row")
    rows = fault(rows) if fault else rows
    return rows.select(
        _key(F.col("conv_id")).alias("key"),
        F.col("turn").isNotNull().alias("known"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        "file",
        "row",
    )


def _key(conv_id: Column) -> Column:
    return F.when(conv_id.isNull(), "-").otherwise(F.concat(F.lit("+"), conv_id.cast("string")))


_ORDER = ("key", "known", "turn", "file", "row")


def segments(rows: DataFrame, shift: int = SHIFT) -> DataFrame:
    """key, seg, codes: the rows' roles and faults as letters, in order, in segments of at most 2 ** shift rows.

    Rows without their texts are range-sorted over all conversations, so a long one is dealt to many tasks, and written;
    a row's number there gives its segment. A row is a duplicate if its role and text, by 128 bits of hash, stood earlier.
    """
    bare = F.btrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(*STOPS), CUT_OFF).otherwise(SOUND)
    initial = F.instr(F.lit(_INITIALS), F.substring("role", 1, 1)) - 1
    narrow = rows.select(
        *_ORDER, F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "role", "text").alias("b"), fault.alias("fault"),
        F.when((initial < 0) | (F.col("role") == ""), 3).otherwise(initial).alias("initial"),
    )
    placed = narrow.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select(
        "key", "a", "b", "fault", "initial", F.monotonically_increasing_id().alias("at")
    )
    placed = session.settle(placed, "turns")
    again = placed.groupBy("key", "a", "b").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = session.settle(again, "again")
    fault = F.when((F.col("at") > F.col("first")) & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))
    code = F.char(_FIRST + F.col("initial") + 4 * fault)
    coded = placed.join(again.hint("merge"), ["key", "a", "b"], "left").select("key", "at", code.alias("code"))
    whole = coded.groupBy("key", F.shiftright("at", shift).alias("seg")).agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("c"))
    return session.settle(whole.select("key", "seg", F.array_join(F.col("c.code"), "").alias("codes")), "segments")


def edited(rows: DataFrame, shift: int = SHIFT) -> DataFrame:
    """key, seg, codes, edits, after: of every segment, by the state before it."""
    session.ship(rows.sparkSession)
    parts = segments(rows, shift)
    several = parts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    long = session.settle(parts.join(several.hint("merge"), "key", "left_semi"), "long")
    ends = _ends(long, shift)
    with_end = parts.join(ends.hint("merge"), ["key", "seg"], "left")
    shape = "key string, seg bigint, codes string, edits array<string>, after string"
    return session.settle(with_end.mapInPandas(_edits, shape), "edits")


def _stream(rows: DataFrame, edits: DataFrame, every: DataFrame) -> DataFrame:
    """Each conversation in one task in order: its mark, its segments' edits, then its rows."""
    none = {"known": F.lit(False), "turn": F.lit(0).cast("bigint"), "role": F.lit(""), "text": F.lit(""), "file": F.lit(""), "row": F.lit(0).cast("bigint")}
    blank = {"seg": F.lit(0).cast("bigint"), "codes": F.lit(""), "edits": F.array().cast("array<string>"), "after": F.lit("")}
    both = (
        every.withColumns({"kind": F.lit(0)} | none | blank)
        .unionByName(edits.withColumns({"kind": F.lit(1)} | none))
        .unionByName(rows.withColumns({"kind": F.lit(2)} | blank))
    )
    return both.repartition("key").sortWithinPartitions("key", "kind", "seg", "known", "turn", "file", "row")


class _Replay:
    """One conversation: its counts, and its rows one by one with the edits applied."""

    def __init__(self, key: str):
        self.key, self.edits, self.state, self.last = key, [], START, ""
        self.counts, self.illegal, self.cost = [0] * 4, 0, 0
        self.low = self.high = None
        self.turns, self.given, self.said, self.script = 0, 0, hashlib.sha256(), None

    def segment(self, codes: str, edits, after: str) -> None:
        self.edits.append(edits[self.state])
        self.state = int(after[self.state])
        for c in codes:
            fault, initial = divmod(ord(c) - _FIRST, 4)
            self.counts[fault] += 1
            now = _INITIALS[initial] if initial < 3 else "-"
            self.illegal += self.last != "" and self.last + now not in FOLLOWS
            self.last = now
        rows = iter(codes)
        for letter in self.edits[-1]:
            self.cost += _COST[letter]
            if letter != "I" and (ord(next(rows)) - _FIRST) // 4 == CUT_OFF and letter != "D":
                self.cost += TRUNCATED

    def ready(self) -> None:
        if self.script is None:
            self.edits.append(closing(self.state))
            self.cost += _CLOSE[self.state]
            self.audit = "".join(self.edits)
            self.script, self.state = iter(self.audit), START

    def _inserted(self) -> tuple[str, str]:
        role = _ROLE[self.state]
        self.state = _NEXT[self.state]
        return role, ""

    def row(self, known: bool, turn: int, role: str, text: str) -> Iterator[tuple[str, str]]:
        self.ready()
        if known:
            self.turns += self.high is None or turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        for letter in self.script:
            if letter == "I":
                yield self._inserted()
                continue
            if letter == "K":
                self.state = SYSTEM if self.state == START and role[:1] == "s" else _NEXT[self.state]
                yield role, text
            elif letter == "R":
                yield self._inserted()[0], text
            return

    def rest(self) -> Iterator[tuple[str, str]]:
        self.ready()
        for _ in self.script:
            yield self._inserted()

    def gaps(self) -> int:
        return 0 if self.high is None else int(self.high) - int(self.low) + 1 - self.turns


def _conversations(batches: Iterator[pd.DataFrame], on_row, on_end) -> Iterator[list]:
    """Goes through sorted records; `on_row(replay, messages)` for what a row gives, `on_end(replay, messages)` at the end."""
    replay = None
    for batch in batches:
        out = []
        for key, kind, codes, edits, after, known, turn, role, text in zip(
            *(batch[c] for c in ("key", "kind", "codes", "edits", "after", "known", "turn", "role", "text")), strict=True
        ):
            if replay is None or key != replay.key:
                if replay is not None:
                    out += on_end(replay, replay.rest())
                replay = _Replay(key)
            if kind == 1:
                replay.segment(codes, edits, after)
            elif kind == 2:
                out += on_row(replay, replay.row(known, turn, role, text))
        yield out
    if replay is not None:
        yield on_end(replay, replay.rest())


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def feed(r: _Replay, messages) -> list:
        for role, text in messages:
            r.said.update(("\n" if r.given else "").encode() + f"{role}:{text}".encode())
            r.given += 1
        return []

    def close(r: _Replay, messages) -> list:
        feed(r, messages)
        c = r.counts
        return [(r.key, r.gaps(), c[BLANK], c[DUPLICATE], c[CUT_OFF], r.illegal, r.cost, r.audit, r.said.hexdigest())]

    names = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    for rows in _conversations(batches, feed, close):
        yield pd.DataFrame(rows, columns=names)


def _messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def take(r: _Replay, messages) -> list:
        out = []
        for role, text in messages:
            out.append((r.key, r.given, role, text))
            r.given += 1
        return out

    for rows in _conversations(batches, take, take):
        yield pd.DataFrame(rows, columns=["key", "turn", "role", "text"])


def _streamed(conversations: DataFrame, fault: Fault | None, shift: int) -> DataFrame:
    rows = _rows(conversations, fault)
    every = conversations.select(_key(F.col("conv_id")).alias("key")).distinct()
    return _stream(rows, edited(rows, shift), every)


def _named(df: DataFrame, conversations: DataFrame) -> DataFrame:
    kind = conversations.schema["conv_id"].dataType
    conv_id = F.when(F.col("key") != "-", F.expr("substring(key, 2)").cast(kind)).alias("conv_id")
    return df.select(conv_id, *(c for c in df.columns if c != "key"))


def report(conversations: DataFrame, fault: Fault | None = None, shift: int = SHIFT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; one row per conv_id of `conversations`.

    Rows of a conversation are taken by turn, null first, rows of one turn as they lie in the files; `fault` may change them
    first. Blank rows, and rows whose role and text stood earlier, must go; other rows may go, stay, or change to the user's
    or the assistant's, and empty turns of these may be put in, so that the roles' initials are an s or none and then pairs
    of u and a, or nothing. The edits cost the least, and of these their initials are the least string.

    Null roles and texts count as one space; null ids are a conversation; a conversation that has lost all rows costs nothing.
    Repeated rows are duplicates of each other. The auction sees a letter for each row, in segments of at most 2 ** shift
    rows; a conversation of any length is solved by many tasks (see _ends). Its digest and its string of edits are one value
    each, so its texts then pass through one task, row by row, with no more in memory than a batch and that string.
    Texts may have any length. An empty table gives no rows.
    """
    shape = "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return _named(_streamed(conversations, fault, shift).mapInPandas(_report, shape), conversations)


def repair(conversations: DataFrame, fault: Fault | None = None, shift: int = SHIFT) -> DataFrame:
    """conv_id, turn (from 0), role, text: the repaired conversations. See report."""
    shape = "key string, turn bigint, role string, text string"
    return _named(_streamed(conversations, fault, shift).mapInPandas(_messages, shape), conversations)


def _sql() -> str:
    """The contract in SQL: rows are gone through from the last on, with the least (cost, edits) from each state and the lines
    they leave; a checksum goes through the bytes of its text."""
    bits = "list_reduce(range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    crc = f"xor(list_reduce(list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT), lambda c, b: {bits}, 4294967295), 4294967295)"

    def edit(letter: str, cost: str, line: str, to: int) -> str:
        return f"{{'c': (v{to}).c + {cost}, 'a': '{letter}' || (v{to}).a, 't': {line} || (v{to}).t}}"

    def line(role: str, text: str) -> str:
        return f"chr(10) || {role} || ':' || {text}"

    rows = []
    for state, after in enumerate(_NEXT):
        role, never = _ROLE[state], 1_000_000
        ways = [
            edit("D", str(DELETE), "''", state),
            edit("K", f"CASE WHEN must THEN {never} WHEN initial = '{role[0]}' THEN cut ELSE {never} END", line("role", "text"), after),
            edit("R", f"CASE WHEN must THEN {never} ELSE {REROLE} + cut END", line(f"'{role}'", "text"), after),
        ]
        if state == START:
            ways.append(edit("K", f"CASE WHEN must THEN {never} WHEN initial = 's' THEN cut ELSE {never} END", line("role", "text"), SYSTEM))
        rows.append(f"list_sort([{', '.join(ways)}])[1] AS w{state}")

    def put(state: int, name: str, into: str) -> str:
        added = f"{{'c': ({into}).c + {INSERT}, 'a': 'I' || ({into}).a, 't': {line(repr(_ROLE[state]), repr(''))} || ({into}).t}}"
        return f"list_sort([{name}, {added}])[1]"

    user, assistant = (line(repr(r), repr("")) for r in ("user", "assistant"))
    return f"""
WITH RECURSIVE n AS (
  SELECT row_number() OVER () AS o, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s
  FROM conversations),
k AS (SELECT *, {crc} % 20 AS kind FROM n),
d AS (
  SELECT o, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy, conv_id, turn,
         CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k WHERE kind <> 0),
i AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS size,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, o, copy) AS seen,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS initial,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, o, copy)),
r AS (
  SELECT *, last = '' AS blank, last <> '' AND seen > 1 AS duplicate, last <> '' AND seen = 1 AND last NOT IN ('.', '!', '?') AS truncated,
         last = '' OR seen > 1 AS must, (last NOT IN ('.', '!', '?'))::BIGINT AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prior
  FROM i),
p AS (
  SELECT DISTINCT conv_id, size + 1 AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS v0, {{'c': 4::BIGINT, 'a': 'II', 't': {user} || {assistant}}} AS v1,
         {{'c': 2::BIGINT, 'a': 'I', 't': {assistant}}} AS v2, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS v3
  FROM r
  UNION ALL
  SELECT conv_id, i, {put(0, "w0", "x2")}, {put(1, "w1", "x2")}, x2, x3
  FROM (
    SELECT *, {put(2, "w2", "w3")} AS x2, {put(3, "w3", "w2")} AS x3
    FROM (
      SELECT p.conv_id, p.i - 1 AS i, {", ".join(rows)}
      FROM p JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = p.i - 1))),
f AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce((v0).c, 0) AS cost, coalesce((v0).a, '') AS audit, sha256(coalesce(substr((v0).t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = 1
"""


SQL = _sql()
