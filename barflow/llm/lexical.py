"""Ranked lexical search over bit-sliced Bloom signatures: slices bound every score, and what they can't exclude is rescored."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barflow import session
from barflow.llm import text as T

DEPTH = 10
# Bits of a signature for each of its entries, and bits an entry sets. Wider signatures than 2 ** WIDEST fill up.
BITS, HASHES, NARROWEST, WIDEST = 8, 3, 8, 20
# Documents of one block, at most; fewer where signatures are wide.
BLOCK_DOCS, BLOCK_BITS = 1024, 1 << 21
# A term has an entry for each of these that its occurrences reach.
LEVELS = np.array([1, 2, 3, 4, *(x << k for k in range(1, 30) for x in (3, 4))], np.int64)
# Documents with the highest bounds that are scored for each item to find what its results must reach.
PROBES = 24
# Items of one pass over the signatures, and their terms.
ITEMS, TERMS, TERMS_AT_ONCE = 256, 65_536, 4096
_CHUNK = 1 << 20

# Fixed values of the contract: bytes that end a term become spaces, A-Z is lower-cased.
_ENDS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(0x20 if b in _ENDS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def occurrences(text: str | None) -> Counter[bytes]:
    """How often each term stands in the text. A long text is counted a stretch at a time."""
    data = (text or "").encode("utf-8", "replace").translate(_TABLE)
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= _CHUNK else data.find(b" ", at + _CHUNK)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def damping(n: int, documents: int, length: int) -> int:
    return 100 - 90 + (90 * n * documents) // length


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def slices(codes: np.ndarray, levels: np.ndarray | int, width: int) -> np.ndarray:
    """The HASHES slices of each entry (term code, level) among 2 ** width."""
    entry = codes * _MIX + np.asarray(levels, np.uint64) * _STEP
    out = np.empty((len(codes), HASHES), np.int64)
    for k in range(HASHES):
        x = (entry ^ (entry >> np.uint64(29))) * _STEP
        entry = x ^ (x >> np.uint64(32))
        out[:, k] = (entry >> np.uint64(64 - width)).astype(np.int64)
    return out


def _codes(terms) -> np.ndarray:
    return np.fromiter(map(crc32, terms), np.uint64, len(terms))


class _Block:
    """Signatures of documents of one width class, a row of bits (slice) for each position and a column for each document."""

    def __init__(self, width: int):
        self.width = width
        self.room = min(BLOCK_DOCS, max(8, BLOCK_BITS >> width))
        self.bits = np.zeros((1 << width, self.room // 8), np.uint8)
        self.file, self.row, self.n, self.peak = [], [], [], []

    def add(self, file: int, row: int, tf: np.ndarray, codes: np.ndarray, levels: np.ndarray) -> None:
        k = len(self.n)
        self.bits[slices(codes, levels, self.width).ravel(), k // 8] |= np.uint8(128 >> k % 8)
        for held, value in ((self.file, file), (self.row, row), (self.n, int(tf.sum())), (self.peak, int(tf.max()))):
            held.append(value)

    def out(self) -> dict:
        return {"width": self.width, "bits": self.bits.tobytes(), "file": self.file, "row": self.row, "n": self.n, "peak": self.peak}


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of signatures; of each width class one block is open at a time."""
    open_: dict[int, _Block] = {}
    for batch in batches:
        full = []
        for file, row, text in zip(batch["file"].tolist(), batch["row"].tolist(), batch["text"], strict=True):
            found = occurrences(text)
            if not found:
                continue
            tf = np.fromiter(found.values(), np.int64, len(found))
            reached = np.searchsorted(LEVELS, tf, "right")
            codes = np.repeat(_codes(found), reached)
            levels = np.arange(len(codes)) - np.repeat(np.cumsum(reached) - reached, reached)
            width = min(WIDEST, max(NARROWEST, (BITS * len(codes) - 1).bit_length()))
            if width not in open_:
                open_[width] = _Block(width)
            block = open_[width]
            block.add(file, row, tf, codes, levels)
            if len(block.n) == block.room:
                full.append(open_.pop(width).out())
        if full:
            yield pd.DataFrame(full)
    if open_:
        yield pd.DataFrame([b.out() for b in open_.values()])


_SHAPE = "width int, bits binary, file array<bigint>, row array<bigint>, n array<bigint>, peak array<bigint>"


@dataclass
class Index:
    """Signatures of all documents with a term, how many those are, and their terms with repeats."""

    blocks: DataFrame
    rows: DataFrame
    documents: int
    length: int


def index(docs: DataFrame) -> Index:
    """The index of (doc_id, text); one pass over the texts. It does not depend on what is searched for."""
    session.ship(docs.sparkSession)
    rows = T.located(docs.select("doc_id", "text"), "search")
    rows = rows.select(F.xxhash64("at.file").alias("file"), "at.row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    blocks = session.settle(rows.select("file", "row", "text").mapInPandas(_signed, _SHAPE), "signatures")
    all_ = blocks.agg(F.sum(F.size("n")).alias("d"), F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("l")).first()
    return Index(blocks, rows, all_.d or 0, all_.l or 0)


@dataclass
class _Query:
    """A block of items: terms with their weights, and each item's terms by number."""

    terms: list[bytes]
    weights: list[int]
    items: list[np.ndarray]
    documents: int
    length: int


def _held(terms: list[bytes]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = {t: k for k, t in enumerate(terms)}
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(wanted[t] for t in wanted.keys() & occurrences(text).keys())
        yield pd.DataFrame({"term": list(counts.keys()), "df": list(counts.values())}, dtype="int64")

    return run


def _bounds(q: _Query, block: dict) -> np.ndarray:
    """For each item and document of the block a number its score does not exceed."""
    width, docs = block["width"], len(block["n"])
    bits = np.frombuffer(block["bits"], np.uint8).reshape(1 << width, -1)[:, : (docs + 7) // 8]
    m = [damping(int(x), q.documents, q.length) for x in block["n"]]
    peak = np.asarray(block["peak"])
    deepest = int(np.searchsorted(LEVELS, peak.max(), "right"))
    most = [  # what a term adds at most whose entries end at this level
        np.array([impact(int(min(p, LEVELS[k + 1] - 1)), x) for p, x in zip(peak, m, strict=True)], np.float32) for k in range(deepest)
    ]
    total = np.zeros((len(q.items), docs))
    codes, weights = _codes(q.terms), np.asarray(q.weights, np.float64)
    for start in range(0, len(q.terms), TERMS_AT_ONCE):
        some = codes[start : start + TERMS_AT_ONCE]
        alive = np.arange(len(some))
        held, adds = None, np.zeros((len(some), docs), np.float32)
        for level in range(deepest):
            at = slices(some[alive], level, width)
            hit = bits[at[:, 0]]
            for k in range(1, HASHES):
                hit = hit & bits[at[:, k]]
            held = hit if held is None else held & hit
            left = held.any(axis=1)
            alive, held = alive[left], held[left]
            if not len(alive):
                break
            there = np.unpackbits(held, axis=1, count=docs).view(bool)
            adds[alive] = np.where(there, most[level], adds[alive])
        for i, own in enumerate(q.items):
            own = own[(own >= start) & (own < start + TERMS_AT_ONCE)]
            if len(own):
                total[i] += weights[own] @ adds[own - start].astype(np.float64)
    return total


def _candidates(q: _Query, floors: list[int] | None, keep: int):
    """(q, file, row, bound): documents whose bound reaches the item's floor, or without floors the task's `keep` highest."""

    def blocks(batches):
        for batch in batches:
            for block in batch.to_dict("records"):
                yield block, _bounds(q, block)

    def reaching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = np.maximum(np.asarray(floors, np.float64), 1)[:, None]
        for block, bound in blocks(batches):
            item, doc = np.nonzero(bound >= least)
            yield pd.DataFrame({"q": item, "file": np.asarray(block["file"])[doc], "row": np.asarray(block["row"])[doc], "bound": bound[item, doc].astype(np.int64)})

    def highest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list] = defaultdict(list)
        least = np.ones(len(q.items))
        for block, bound in blocks(batches):
            for i, k in zip(*(x.tolist() for x in np.nonzero(bound >= least[:, None])), strict=True):
                best[i].append((int(bound[i, k]), int(block["file"][k]), int(block["row"][k])))
                if len(best[i]) >= 4 * keep:
                    best[i] = sorted(best[i], reverse=True)[:keep]
                    least[i] = best[i][-1][0]
        found = [(i, f, r, b) for i, held in best.items() for b, f, r in sorted(held, reverse=True)[:keep]]
        yield pd.DataFrame(found, columns=["q", "file", "row", "bound"])

    return highest if floors is None else reaching


def _scores(q: _Query):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place, item, score = [], [], []
            for k, (text, items) in enumerate(zip(batch["text"], batch["items"], strict=True)):
                found = occurrences(text)
                m = damping(sum(found.values()), q.documents, q.length)
                for i in items:
                    own = ((q.weights[t], found.get(q.terms[t], 0)) for t in q.items[i].tolist())
                    place.append(k)
                    item.append(i)
                    score.append(sum(w * impact(tf, m) for w, tf in own if tf))
            yield pd.DataFrame({"q": item, "doc_id": batch["doc_id"].array[place], "file": batch["file"].array[place], "row": batch["row"].array[place], "score": score})

    return run


def _rescored(found: DataFrame, at: Index, q: _Query) -> DataFrame:
    """q, doc_id, file, row, score of candidates with a score. Spark sends them to the texts if they are few, else joins by place."""
    kind = at.rows.schema["doc_id"].dataType.simpleString()
    wanted = session.settle(found.groupBy("file", "row").agg(F.collect_set("q").alias("items")), "wanted")
    rows = at.rows.join(wanted, ["file", "row"]).select("doc_id", "file", "row", "text", "items")
    shape = f"q int, doc_id {kind}, file bigint, row bigint, score bigint"
    return session.settle(rows.mapInPandas(_scores(q), shape).filter("score > 0"), "scores")


def _best(rows: DataFrame, by: list, depth: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*by))).filter(F.col("rank") <= depth)


def _search(at: Index, texts: list[str | None], depth: int) -> DataFrame:
    """q (number of the item), rank, doc_id, score."""
    sets = [sorted(occurrences(t)) for t in texts]
    terms = sorted(set().union(*sets))
    df = {r.term: r.df for r in at.rows.select("text").mapInPandas(_held(terms), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weights = [weight(at.documents, df.get(k, 0)) for k in range(len(terms))]
    number = {t: k for k, t in enumerate(terms)}
    # a term that no document has can't add anything
    items = [np.array([k for t in s if (k := number[t]) in df and weights[k] > 0], np.int64) for s in sets]
    q = _Query(terms, weights, items, at.documents, at.length)
    shape = "q int, file bigint, row bigint, bound bigint"
    probes = _best(at.blocks.mapInPandas(_candidates(q, None, PROBES), shape), [F.col("bound").desc(), "file", "row"], PROBES)
    reached = _best(_rescored(probes, at, q), [F.col("score").desc()], depth).filter(F.col("rank") == depth).select("q", "score").collect()
    floors = [0] * len(texts)
    for r in reached:
        floors[r.q] = r.score
    found = session.settle(at.blocks.mapInPandas(_candidates(q, floors, 0), shape), "candidates")
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "file", "row"]
    return session.settle(_best(_rescored(found, at, q), by, depth).select("q", "rank", "doc_id", "score"), "ranked")


def _in_blocks(items: DataFrame) -> Iterator[list]:
    """The items, ITEMS at a time, or fewer where their texts are long; only so many are with the driver."""
    rows, block, size = items.toLocalIterator(), [], 0
    for row in rows:
        terms = len(row.text or "") // 2
        if block and (len(block) == ITEMS or size + terms > TERMS):
            yield block
            block, size = [], 0
        block.append(row)
        size += terms
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, depth: int = DEPTH, at: Index | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `depth` documents of the highest score above 0; pass `at` to use an index again.

    A document's signature is a Bloom filter of its terms, each with an entry for every level its number of occurrences
    reaches; signatures of 1,024 documents of like size lie as bit slices, one for each position. The slices of a term's
    entries, ANDed, show every document that has it so often, and some that don't. So they give the most that the term can
    add to a score; weighted and summed, these bound an item's scores from above. The documents with the highest
    bounds are scored by their texts; then every document whose bound reaches the last of these results' scores is. What is not scored is thus
    proved not to belong to the results, ties included.

    Items are taken in blocks of ITEMS rows, each a pass over the texts (how many documents hold a term), two over the
    signatures and the texts that are scored. Equal scores go by doc_id (nulls last), then by place. Each row of `items` is
    an item, each row of `docs` a document, repeated rows too. Null and empty texts have no terms: they find nothing, and are
    found by none. A very long text is counted a stretch at a time, and its signature fills up beyond 2 ** WIDEST bits: its bound
    is loose then, and its score exact. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((items, "item_id"), (docs, "doc_id"))]
    out = spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score bigint")
    at = at or index(docs)
    if not at.documents:
        return out
    for block in _in_blocks(items.select("item_id", "text")):
        found = _search(at, [r.text for r in block], depth)
        ids = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(block)], f"q int, item_id {kinds[0]}")
        out = out.unionByName(found.join(ids, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
i AS (
  SELECT row_number() OVER () AS q, item_id,
         list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts
  FROM benchmark),
a AS (SELECT count(*) AS nd, sum(len(ts))::BIGINT AS ld FROM d WHERE len(ts) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, a GROUP BY term),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(ts) * nd) // ld) AS m FROM d, a WHERE len(ts) > 0),
s AS (
  SELECT q, any_value(item_id) AS item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score, any_value(doc_id) AS doc_id
  FROM (SELECT q, item_id, unnest(ts) AS term FROM i) JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r)
  GROUP BY q, r),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
