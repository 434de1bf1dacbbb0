"""Substring dedup: runs of several consecutive sentences, joined globally; repeated ones leave all texts but the first."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow import session
from barflow.llm import text as T

# A run is the shortest stretch from a sentence on with so many sentences and words.
RUN_SENTENCES, RUN_WORDS = 2, 12
# A stretch of repeated sentences goes if it has at least so many words: every one does, as it has a run's words.
LEAST_WORDS = RUN_WORDS
# A sentence ends at one of these before a space, at a line's end, or before a word with a capital.
ENDERS = ".!?…。！？"
_BASE = 0x9E3779B97F4A7C15
_SPACE, _LINE, _CAPITAL, _ENDER = 1, 2, 4, 8

_kinds: np.ndarray | None = None


def _kind_of() -> np.ndarray:
    """What each code point is, as bits."""
    global _kinds
    if _kinds is None:
        chars = map(chr, range(0x110000))
        _kinds = np.fromiter((_SPACE * c.isspace() | _CAPITAL * (unicodedata.category(c) == "Lu") for c in chars), np.uint8, 0x110000)
        _kinds[ord("\n")] |= _LINE
        _kinds[[ord(c) for c in ENDERS]] |= _ENDER
    return _kinds


def split(text: str) -> list[tuple[int, int]]:
    """First and last character (exclusive) of every sentence: what stands between the spaces that end one."""
    n = len(text)
    if not n:
        return []
    kinds = _kind_of()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = np.zeros(n + 2, np.int8)
    space[1:-1] = kinds & _SPACE
    turns = np.flatnonzero(np.diff(space))
    first, last = turns[::2], turns[1::2]  # runs of spaces
    lines = np.cumsum(np.r_[0, (kinds & _LINE) > 0])
    stop = (lines[last] > lines[first]) | (kinds[first - 1] & _ENDER > 0) | (kinds[np.minimum(last, n - 1)] & _CAPITAL > 0)
    stop |= (first == 0) | (last == n)
    begin, end = np.r_[0, last[stop]].tolist(), np.r_[first[stop], n].tolist()
    return [(a, b) for a, b in zip(begin, end, strict=True) if a < b]


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, last sentence and 64-bit key of every run; case and spaces don't count."""
    parts = [text[a:b].lower().split() for a, b in split(text)]
    n = len(parts)
    none = np.zeros(0, np.int64)
    if n < RUN_SENTENCES:
        return none, none, none
    codes = np.frombuffer(b"".join(hashlib.blake2b(" ".join(p).encode("utf-8", "replace"), digest_size=8).digest() for p in parts), "<u8")
    total = np.cumsum([0, *map(len, parts)])
    last = np.maximum(np.searchsorted(total, total[:-1] + RUN_WORDS), np.arange(n) + RUN_SENTENCES)
    first = np.flatnonzero(last <= n)
    last = last[first]
    sizes = last - first
    key = np.zeros(len(first), np.uint64)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        live = sizes > k
        mixed = (key[live] ^ (key[live] >> np.uint64(31))) * np.uint64(_BASE) + codes[first[live] + k]
        key[live] = mixed
    return first, last - 1, (key ^ (key >> np.uint64(29))).view(np.int64)


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [runs(t or "") for t in batch["text"]]
        first, last, keys = ([f[k] for f in found] for k in range(3))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "h": batch["h"], "first": first, "last": last, "keys": keys})


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, sentences, gone, words = [], [], [], []
        for text, cuts in zip(batch["text"], batch["cuts"], strict=True):
            spans = split(text or "")
            sentences.append(len(spans))
            out, lost = _cut(text, spans, cuts) if cuts is not None and len(cuts) else (text, [])
            texts.append(out)
            gone.append(len(lost))
            words.append(sum(len(text[a:b].split()) for a, b in lost))
        out = batch.drop(columns=["text", "cuts"])
        yield out.assign(text=texts, n_sentences=sentences, n_removed=gone, removed_words=words)


def _cut(text: str, spans: list[tuple[int, int]], cuts) -> tuple[str, list[tuple[int, int]]]:
    """The text without its repeated stretches, and the sentences that went."""
    covered = np.zeros(len(spans) + 1, int)
    for c in cuts:
        covered[c["first"]] += 1
        covered[c["last"] + 1] -= 1
    covered = np.cumsum(covered)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(int)))
    kept, lost, at = [], [], 0
    for a, b in edges.reshape(-1, 2).tolist():
        low, high = spans[a][0], spans[b - 1][1]
        if len(text[low:high].split()) >= LEAST_WORDS:
            kept.append(text[at:low])
            lost += spans[a:b]
            at = high
    return "".join([*kept, text[at:]]), lost


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text (without what is repeated), n_sentences, n_removed, removed_words; one row per row of `docs`.

    All runs of all texts are joined by key. Of equal runs the first is that with the least doc_id (null before all), then by
    content and place; sentences inside any other are repeated and go, the rest of the text stays as it is. So of a repeated
    passage what stays is the sentences cut at its ends, or all if no two whole sentences with RUN_WORDS words lie in it. A run in very many texts is counted in every task before it is shuffled, and its
    rows are joined with one row, which Spark may split. Runs are equal if their 64-bit keys are.

    Null text stays null; texts with fewer than RUN_SENTENCES sentences or RUN_WORDS words have no runs. A text repeated as a
    whole under another id goes as a whole, but for what is too short; rows equal in doc_id and text count as one and stay.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    session.ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    spread = texts.mapInPandas(
        _spread, f"doc_id {kind}, h bigint, first array<int>, last array<int>, keys array<bigint>"
    ).select("doc_id", "h", F.explode(F.arrays_zip("first", "last", "keys")).alias("r"))
    spread = session.settle(spread.select("doc_id", "h", "r.first", "r.last", F.col("r.keys").alias("key")), "runs")
    place = F.struct("doc_id", "h", F.col("first"))
    # written, so that both sides of the join are plain exchanges, and Spark may split a key with very many rows
    seen = session.settle(spread.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("origin")).filter("n > 1"), "seen")
    again = spread.join(seen.hint("merge"), "key").filter(~place.eqNullSafe(F.col("origin")))
    cuts = again.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(
        F.collect_set(F.struct("first", "last")).alias("cuts")
    )
    cuts = session.settle(cuts, "cuts")
    rows = texts.join(cuts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    shape = f"doc_id {kind}, text string, n_sentences int, n_removed int, removed_words int"
    return rows.select("doc_id", "text", "cuts").mapInPandas(_without, shape)
