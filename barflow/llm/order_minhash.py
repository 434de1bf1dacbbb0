"""Near-duplicates by order MinHash: sketches keep the order of their minima, and candidates are aligned within a band."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barflow import session
from barflow.llm import graph
from barflow.llm import text as T

WIDTH, SIMILARITY = 5, 0.8
# Sketches of a text, and minima in each: at the least similarity 0.8 a pair of long texts shares a sketch with 1 - (1 - 0.8^5)^20 = 0.9996.
BANDS, MINIMA = 20, 5
# Texts of at most so many k-mers meet any other at the least similarity for certain.
FEW = 30
# Leaders of a bucket in the first of the later rounds, and how many times more in each that follows.
LEADERS, MORE = 2, 8
# Members of a bucket that one row of a leader meets.
SHARE = 4096
_WORD = re.compile(r"\w+")
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
# Words whose codes a task remembers, and the longest of them: about 40 MB.
_MOST_KNOWN, _LONGEST = 200_000, 64
# Bits of a text's parities.
_BITS = 1024


class _Codes(dict):
    """64-bit codes of words, the same in every process. A task forgets them at its end, as workers live on."""

    def __missing__(self, word: str) -> int:
        code = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        if len(word) <= _LONGEST:
            if len(self) >= _MOST_KNOWN:
                self.clear()
            self[word] = code
        return code


_codes = _Codes()


def word_codes(text: str | None) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _STEP
    return x ^ (x >> np.uint64(29))


def labelled_kmers(codes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A code of each run of `width` words with its occurrence number in the text, in order: no two are equal.

    A text of fewer words is one run; a text without words has none.
    """
    n = len(codes)
    if n == 0:
        return codes
    span = min(n, width)
    runs = np.zeros(n - span + 1, np.uint64)
    for k in range(span):
        runs = _mixed(runs * _MIX + codes[k : n - span + 1 + k])
    order = np.argsort(runs, kind="stable")
    by = runs[order]
    fresh = np.r_[True, by[1:] != by[:-1]]
    if fresh.all():
        return runs
    at = np.arange(len(by))
    occurrence = np.empty(len(by), np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return np.where(occurrence == 0, runs, _mixed(runs + occurrence * _MIX))


_SEEDS = _mixed(np.arange(1, 513, dtype=np.uint64) * _MIX) | np.uint64(1)


def sketches(kmers: np.ndarray, bands: int = BANDS, minima: int = MINIMA) -> np.ndarray:
    """One key per band: the k-mers with the least hash values of that band, in the order they have in the text."""
    n = len(kmers)
    keys = np.empty(bands, np.uint64)
    some = max(1, 2_000_000 // max(n, 1))  # bands hashed at once, which bounds memory for long texts
    for start in range(0, bands if n else 0, some):
        seeds = _SEEDS[start : min(bands, start + some), None]
        if n > minima:
            hashed = _mixed(kmers[None, :] * seeds)
            at = np.sort(np.argpartition(hashed, minima - 1, axis=1)[:, :minima], axis=1)
        else:
            at = np.broadcast_to(np.arange(n), (len(seeds), n))
        key = seeds[:, 0].copy()
        for k in range(at.shape[1]):
            key = _mixed(key * _MIX + kmers[at[:, k]])
        keys[start : start + len(seeds)] = key
    return keys if n else keys[:0]


def exact_keys(kmers: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Keys of a text of few k-mers: it has one in common with any text that is similar to it, if one of both has at most FEW.

    Two texts of n and m k-mers are similar if at most d = (n + m) * (1 - least) / (1 + least) of these are in one text alone.
    So if k-mers are dealt by hash into d + 1 groups, one group is equal in both; for each d that occurs with a text of the
    allowed lengths there is a key for each group's k-mers. An empty group has no key: texts with one also have the k-mers
    of least hash, so many that similar texts share one of them, as keys.
    """
    n, part = len(kmers), (1 - least) / (1 + least)
    low, high = int(np.ceil(least * n - 1e-9)), int(n / least + 1e-9)
    if n > FEW:
        high = FEW
    if n == 0 or low > high:
        return kmers[:0]
    mixed, keys, empty = _mixed(kmers * _MIX), [], False
    for d in range(int((n + low) * part + 1e-9), int((n + high) * part + 1e-9) + 1):
        of = (_mixed(mixed * _SEEDS[d]) % np.uint64(d + 1)).astype(np.int64)
        held = np.zeros(d + 1, np.uint64)
        np.add.at(held, of, mixed)
        full = np.bincount(of, minlength=d + 1) > 0
        empty |= not full.all()
        keys.append(_mixed((held ^ _SEEDS[256 + d]) * _STEP + np.arange(d + 1, dtype=np.uint64))[full])
    if empty:
        keys.append(np.sort(mixed)[: n - int(np.ceil(least * n - 1e-9)) + 1])
    return np.unique(np.concatenate(keys))


def all_keys(kmers: np.ndarray) -> np.ndarray:
    """The buckets of a text. Texts of at most FEW k-mers need no sketches: what is similar to them has exact keys too."""
    exact = exact_keys(kmers)
    return np.r_[exact, sketches(kmers)] if len(kmers) > FEW else exact


def parities(kmers: np.ndarray) -> np.ndarray:
    """Whether an odd number of the k-mers fall on each of _BITS bits: two texts differ by one bit at most for each k-mer of one alone."""
    at = _mixed(kmers * _STEP) >> np.uint64(65 - _BITS.bit_length())
    odd = np.bincount(at.astype(np.int64), minlength=_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Order-preserving matches of two labelled k-mer sequences over their union, by an alignment within a band.

    With at least `least` in common no more than (1 - least) / (1 + least) of all k-mers lie outside the matches, so matches
    further from the diagonal than that can't count. Equal k-mers match once, so the alignment is a longest rising run.
    0 if the similarity is below `least` by the number of shared k-mers alone.
    """
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    band = total * (1 - least) / (1 + least) + 1
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < least * (total - len(i)):
        return 0.0
    close = np.abs(i - j) <= band
    i, j = i[close], j[close]
    ends: list[int] = []
    for x in j[np.argsort(i)].tolist():
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
    return len(ends) / (total - len(ends))


def _forgetful(run):
    """A function of batches that leaves no codes of words behind."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            _codes.clear()

    return wrapped


@_forgetful
def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        nodes, sizes, keys, odd = [], [], [], []
        for text in batch["text"]:
            codes = word_codes(text)
            kmers = labelled_kmers(codes)
            nodes.append(hashlib.blake2b(codes.tobytes(), digest_size=12).digest())
            sizes.append(len(kmers))
            keys.append(all_keys(kmers).view(np.int64))
            odd.append(parities(kmers))
        yield pd.DataFrame({"id": batch["id"], "file": batch["file"], "row": batch["row"], "node": nodes, "n": sizes, "keys": keys, "odd": odd})


@_forgetful
def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, kmers = None, None
    for batch in batches:
        keep = []
        for lead, first, second in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
            if lead != last:
                last, kmers = lead, labelled_kmers(word_codes(first))
            keep.append(similarity(kmers, labelled_kmers(word_codes(second))) >= SIMILARITY)
        yield batch.loc[keep, ["a", "b"]]


def _candidates(points: DataFrame, leaders: DataFrame) -> DataFrame:
    """Pairs (leader a, member b) of a bucket whose lengths allow the similarity."""
    n, m = F.col("n"), F.col("lead.n")
    return (
        points.join(leaders.hint("merge"), "key")
        .filter((F.col("node") != F.col("lead.node")) & (F.least(n, m) >= SIMILARITY * F.greatest(n, m)))
        .select(F.col("lead.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )


def _open_pairs(tied: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs (a, b) of different components, one a leader of rank low + 1 to high in a bucket and the other after it there.

    `tied` has key, size (of the bucket), node, n, odd, by (the order of nodes), of. Pairs that can't be similar by their
    lengths or parities are left out. A leader meets a large bucket in shares of SHARE members.
    """
    shares = F.ceil(F.col("size") / SHARE).cast("int")
    rank = F.row_number().over(W.partitionBy("key").orderBy("by"))
    lead = F.struct("by", "node", "n", "odd", "of").alias("lead")
    leaders = (
        tied.withColumn("rank", rank).filter(F.col("rank") <= high).filter(F.col("rank") > low)
        .select("key", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), lead)
    )
    n, m = F.col("n"), F.col("lead.n")
    differ = sum((F.bit_count(F.col("odd")[k].bitwiseXOR(F.col("lead.odd")[k])) for k in range(_BITS // 64)), F.lit(0))
    most = (n + m) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    return (
        tied.withColumn("share", F.pmod(F.xxhash64("node"), shares).cast("int")).join(leaders.hint("merge"), ["key", "share"])
        .filter((F.col("by") > F.col("lead.by")) & (F.col("of") != F.col("lead.of")))
        .filter((F.least(n, m) >= SIMILARITY * F.greatest(n, m)) & (differ <= most))
        .select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
        .distinct()
    )


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    first = bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(second.hint("merge"), "b").join(first.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInPandas(_aligned, "a binary, b binary")


def _decided(rows: DataFrame) -> DataFrame:
    """For each of the located rows: doc_id, file, row, class_id, class_size, kept.

    Texts with equal words (case and punctuation aside) are one node. A node has BANDS sketches, or exact keys if
    it has few k-mers (see exact_keys); nodes with one in common form a bucket. First each bucket's members are aligned with the node with the least content hash, which is mostly
    the same one in all buckets of a group; groups join through components. While a bucket holds more than one component, its
    members are aligned with further leaders, those first that have most company over all such buckets, such as the
    original among its copies. Rounds go on, with MORE times the leaders each, until every member has been a leader: a pair
    that shares a bucket is left unaligned only if both are in one component already, or if lengths or parities exclude the
    similarity. So work grows with the members of a bucket where they are one group, and with its pairs, compared by
    their parities alone, where they are not. Texts are one class when linked by pairs with a similarity of SIMILARITY or more.

    class_id is the least doc_id of the class (null ids last); that row stays, and among rows with the same id the first in
    the files. Null and empty texts have no words and are one class. Fewer words than WIDTH are one k-mer. An empty table
    gives no rows.
    """
    session.ship(rows.sparkSession)
    read = rows.select(F.col("doc.doc_id").alias("id"), "at.file", "at.row", F.col("doc.text").alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    points = session.settle(
        read.mapInPandas(_sketch, f"id {kind}, file string, row bigint, node binary, n int, keys array<bigint>, odd array<bigint>"), "sketches"
    )
    spread = points.select("node", "n", F.explode("keys").alias("key"))

    def buckets(df: DataFrame, by: str, *values) -> DataFrame:
        return df.groupBy("key").agg(*values, F.min(by).alias("one"), F.max(by).alias("other")).filter("one != other")

    shared = session.settle(buckets(spread, "node", F.min(F.struct("node", "n")).alias("low")).select("key", "low"), "buckets")
    pairs = session.settle(_candidates(spread, shared.select("key", F.col("low").alias("lead"))), "pairs")
    # texts of all nodes in a shared bucket, one row each
    wanted = spread.join(shared.select("key").hint("merge"), "key", "left_semi").select("node").distinct()
    chosen = points.join(wanted.hint("merge"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("file", "row")).alias("at"))
    texts = rows.select(F.col("at.file").alias("file"), F.col("at.row").alias("row"), F.col("doc.text").alias("text"))
    places = chosen.select("node", "at.file", "at.row")
    bodies = session.settle(texts.join(places.hint("merge"), ["file", "row"]).select("node", "text"), "bodies")

    found = graph.components(session.settle(_verified(pairs, bodies), "links"))
    within = found.select("node", F.col("component").alias("of"))
    tied = spread.join(shared.select("key").hint("merge"), "key", "left_semi").join(within.hint("merge"), "node", "left")
    split = session.settle(buckets(tied.withColumn("of", F.coalesce("of", "node")), "of").select("key"), "split")
    loose = session.settle(spread.join(split.hint("merge"), "key", "left_semi").distinct(), "loose")
    sizes = session.settle(loose.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    company = loose.join(sizes.hint("merge"), "key").groupBy("node").agg(F.sum("size").alias("company"))
    odd = points.join(company.select("node").hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("odd").alias("odd"))
    known = session.settle(
        company.join(odd.hint("merge"), "node").select("node", "odd", F.struct(-F.col("company"), F.col("node")).alias("by")), "known"
    )
    loose = session.settle(loose.join(known.hint("merge"), "node").join(sizes.hint("merge"), "key"), "loose")
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    low, high = 0, LEADERS
    while True:
        within = found.select("node", F.col("component").alias("of"))
        tied = loose.join(within.hint("merge"), "node", "left").withColumn("of", F.coalesce("of", "node"))
        split = session.settle(buckets(tied, "of", F.max("size").alias("most")).filter(F.col("most") > low + 1).select("key"), "split")
        if split.isEmpty():
            break
        tied = session.settle(tied.join(split.hint("merge"), "key", "left_semi"), "tied")
        again = session.settle(_open_pairs(tied, low, high).join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        more = session.settle(_verified(again, bodies), "links")
        if not more.isEmpty():
            found = graph.components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        tried = session.settle(tried.unionByName(again), "tried")
        low, high = high, high * MORE

    member = session.settle(
        points.join(found.hint("merge"), "node", "left").select("id", "file", "row", F.coalesce("component", "node").alias("of")), "members"
    )
    first = member.groupBy("of").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "file", "row")).alias("first"), F.count("*").alias("size")
    )
    return member.join(first.hint("merge"), "of").select(
        F.col("id").alias("doc_id"),
        "file",
        "row",
        F.col("first.id").alias("class_id"),
        F.col("size").alias("class_size"),
        ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("kept"),
    )


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept; one row per row of `docs`. See _decided."""
    return _decided(T.located(docs, "near")).select("doc_id", "class_id", "class_size", "kept")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: one of each class."""
    rows = T.located(docs, "near")
    stay = _decided(rows).filter("kept").select("file", "row")
    placed = rows.select("doc", F.col("at.file").alias("file"), F.col("at.row").alias("row"))
    return T.unpacked(placed.join(stay.hint("merge"), ["file", "row"], "left_semi"), docs.columns)
