"""Mixture-controlled packing: deficit round-robin over source queues into windows of tokens."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barflow import session

WINDOW = 2048
# Tokens a queue sends at a time: what it may send is saved up until it can afford so many. Divides WINDOW.
QUANTUM = 128
END = 1
ROUNDS_PER_BLOCK = 4096
# Cells of a queue that one row stands for until they are dealt out to tasks.
RANGE = 65_536
# Rows, and bytes of their texts or ids, that a task works on at a time, or one row.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 4 << 20
# Bytes that remembered words, chunks and their ids may take with what Python adds to each, and the longest of them.
_MOST_BYTES, _LONGEST, _OVERHEAD = 96 << 20, 64, 200


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else one past 255."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts as bytes of little-endian unsigned 32-bit numbers.

    Texts of plain Latin letters are cut into words here and each distinct word goes through the tokenizer once; that gives
    what the tokenizer gives if it cuts and lower-cases text in the way stated below. Any other text, or a tokenizer with
    other rules, goes through the tokenizer as it is.
    """

    # The rules of the tokenizer file for which words may be looked up one by one.
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # No character here changes under NFC, is a space other than these, or lower-cases to more than one.
    PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ňŊ-ž]*")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        normal = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        cut, *after = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = (
            normal == self.NORMALIZERS and cut.get("pattern") == {"Regex": self.SPLIT} and cut.get("invert") is True
            and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in after] == [("ByteLevel", False, False)]
        )
        chars = [chr(c) for c in range(0x180)]
        letters, numbers = (re.escape("".join(c for c in chars if unicodedata.category(c)[0] == k)) for k in "LN")
        self.words = re.compile(self.SPLIT.replace(r"\p{L}", letters).replace(r"\p{N}", numbers))
        self.marks = [x["content"] for x in rules.get("added_tokens", [])]
        self.model = self.tokenizer.model
        # words of one token share its bytes
        self.tokens = [k.to_bytes(4, "little") for k in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        self.bytes = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        made = self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes))
        tokens = self.tokens
        return tokens[made[0].id] if len(made) == 1 else b"".join([tokens[t.id] for t in made])

    def _keep(self, part: str, ids: bytes) -> None:
        if len(part) <= _LONGEST:
            self.held += len(part) + len(ids) + _OVERHEAD
            if self.held > _MOST_BYTES:
                self.known.clear()
                self.held = 0
            self.known[part] = ids

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between spaces: cut into words, each new word goes through the tokenizer's model.

        A chunk of several words is remembered once all of them are: most new words come once, and so do their chunks.
        """
        if chunk.isalpha():
            self._keep(chunk, ids := self._word(chunk))
            return ids
        if chunk[:-1].isalpha() and not chunk[-1].isnumeric():
            words = (chunk[:-1], chunk[-1])
        else:
            words = self.words.findall(chunk)
        out, new = [], False
        for word in words:
            ids = self.known.get(word)
            if ids is None:
                self._keep(word, ids := self._word(word))
                new = True
            out.append(ids)
        ids = out[0] if len(out) == 1 else b"".join(out)
        if len(out) != 1 and not new:
            self._keep(chunk, ids)
        return ids

    def _plain(self, text: str) -> bytes:
        known = self.known
        chunks = text.lower().split()
        found = list(map(known.get, chunks))
        if None in found:
            found = [known.get(c) or self._chunk(c) if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        return b"".join(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = (self.by_word and self.PLAIN.fullmatch(t) and not any(m in t for m in self.marks) for t in texts)
        return [self._plain(t) if p else self._ids(t) for t, p in zip(texts, plain, strict=True)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """A few rows at a time, so that a task holds the tokens of those only."""
    for batch in batches:
        start = size = 0
        for k, value in enumerate(batch[column]):
            if k - start == ROWS_AT_ONCE or (k > start and size + len(value or "") > BYTES_AT_ONCE):
                yield batch.iloc[start:k]
                start, size = k, 0
            size += len(value or "")
        if start < len(batch):
            yield batch.iloc[start:]


def _tokens(path: str, end: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task = _encoder(path), TaskContext.get().partitionId()
        close, sent = np.asarray([end], "<u4").tobytes(), defaultdict(int)
        for batch in _slices(batches, "text"):
            ids = [x + close for x in encoder.encode([text or "" for text in batch["text"]])]
            counts, starts = [len(x) // 4 for x in ids], []
            for source, n in zip(batch["queue"], counts, strict=True):
                starts.append(sent[source])
                sent[source] += n
            yield pd.DataFrame({"id": batch["id"], "queue": batch["queue"], "task": task, "start": starts, "n": counts, "ids": ids})

    return run


def _cut(quantum: int, keep_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, "ids"):
            first = batch["first"].to_numpy(np.int64)
            n = batch["n"].to_numpy(np.int64)
            cells = (first + n - 1) // quantum - first // quantum + 1
            doc = np.repeat(np.arange(len(batch)), cells)
            step = np.arange(len(doc)) - np.repeat(np.cumsum(cells) - cells, cells)
            cell = first[doc] // quantum + step
            low = np.maximum(cell * quantum, first[doc])
            high = np.minimum((cell + 1) * quantum, (first + n)[doc])
            start = low - first[doc]
            ids, crc, kept = batch["ids"].tolist(), [], []
            for d, a, b in zip(doc.tolist(), (4 * start).tolist(), (4 * (high - first[doc])).tolist(), strict=True):
                piece = ids[d][a:b]
                crc.append(zlib.crc32(piece))
                kept.append(piece if keep_ids else None)
            yield pd.DataFrame({
                "doc_id": batch["id"].array[doc], "queue": batch["queue"].to_numpy()[doc], "cell": cell,
                "inside": low - cell * quantum, "start": start, "length": high - low, "ids_crc32": crc, "doc_tokens": n[doc],
                "ids": kept,
            })

    return run


def _cells(q: DataFrame) -> DataFrame:
    """queue, turn, share, cell of every full cell: ranges of cells are dealt out first, as all queues come from one task."""
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.floor((F.col("full") - 1) / RANGE).cast("long")
    ranges = q.filter("full > 0").select("queue", "turn", "share", "full", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("range"))
    low, high = F.col("range") * RANGE, F.least((F.col("range") + 1) * RANGE, F.col("full")) - 1
    return ranges.repartition(tasks, "queue", "range").select("queue", "turn", "share", F.explode(F.sequence(low, high)).alias("cell"))


def schedule(queues: DataFrame, window: int = WINDOW, quantum: int = QUANTUM) -> DataFrame:
    """queue, cell, sequence_id, at: where each run of `quantum` tokens of a queue goes.

    `queues` has queue, total (tokens) and weight. In every round a queue's deficit grows by its share of a window; as soon
    as it covers a quantum, the queue sends one, and keeps the rest for the next round. Round r thus has every quantum whose
    end lies in (r, r + 1] shares of the window, in the order of the queues. Rounds are numbered through in blocks, so no
    task sees them all. What is left in the queues, less than a quantum each, fills sequences of its own at the end.
    """
    every = W.partitionBy()
    q = queues.filter("total > 0").withColumn("turn", F.row_number().over(W.orderBy(F.col("queue").asc_nulls_last())))
    q = q.withColumn("share", F.lit(float(window)) * F.col("weight") / F.sum("weight").over(every))
    q = q.withColumn("full", F.floor(F.col("total") / quantum)).withColumn("rest", F.col("total") % quantum)
    cells = _cells(q).select(
        "queue", "turn", "cell", F.greatest(F.lit(1), F.ceil((F.col("cell") + 1) * quantum / F.col("share"))).alias("round")
    ).withColumn("block", F.floor(F.col("round") / ROUNDS_PER_BLOCK))
    sums = cells.groupBy("block").agg(F.count("*").alias("_n"))
    before = sums.select(
        F.col("block").alias("_block"),
        F.coalesce(F.sum("_n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    number = F.row_number().over(W.partitionBy("block").orderBy("round", "turn", "cell")) - 1
    place = (F.col("_before") + F.col("_k")) * quantum
    main = cells.withColumn("_k", number).join(before.hint("merge"), F.col("block") == F.col("_block")).select(
        "queue", "cell", F.floor(place / window).alias("sequence_id"), (place % window).alias("at")
    )
    used = F.ceil(F.sum("full").over(every) * quantum / F.lit(window))
    left = q.withColumn("_used", used).filter("rest > 0")
    left = left.withColumn("_from", F.sum("rest").over(W.orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("rest"))
    left = left.withColumn("_seq", F.floor(F.col("_from") / (window - quantum)))
    last = left.select(
        "queue",
        F.col("full").alias("cell"),
        (F.col("_used") + F.col("_seq")).alias("sequence_id"),
        (F.col("_from") - F.min("_from").over(W.partitionBy("_seq"))).alias("at"),
    )
    return main.unionByName(last)


def pack(
    docs: DataFrame, tokenizer: str, weights: DataFrame | None = None, window: int = WINDOW, quantum: int = QUANTUM,
    end: int = END, keep_ids: bool = True,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, ids (bytes, or null).

    Every document is a token sequence that ends with `end`; null text is empty, so it is that id alone. A source is a queue
    (null is one too) of its documents in the order of the input's partitions. Queues are cut at multiples of `quantum`, and
    each cut run goes where `schedule` puts it: at the end of every round each source has sent its share, give or take a
    quantum, and what it could not send yet is carried on. The
    shares are `weights` (source, weight), else what each source has of all tokens: then all queues end together. A source
    that `weights` leave out or set to 0 counts as 1 of all the others' sum. Tokens are counted within each partition and
    partitions are added up per source, so a source of any size goes through all tasks. Sequences are full but for the last
    ones. Equal ids or repeated rows are packed as they come. An empty table gives no rows.
    """
    assert window % quantum == 0
    spark = docs.sparkSession
    session.ship(spark)
    read = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("queue"), "text")
    kind = read.schema["id"].dataType.simpleString()
    path = session.scratch(spark, "tokens")
    made = read.mapInPandas(_tokens(tokenizer, end), f"id {kind}, queue string, task int, start bigint, n bigint, ids binary")
    made.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.parquet(path)
    parts = tokens.groupBy("queue", "task").agg(F.sum("n").alias("n"))
    base = session.settle(
        parts.select(
            F.col("queue").alias("_queue"),
            F.col("task").alias("_task"),
            F.coalesce(F.sum("n").over(W.partitionBy("queue").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
            "n",
        ),
        "queues",
    )
    totals = base.groupBy(F.col("_queue").alias("queue")).agg(F.sum("n").alias("total"))
    if weights is None:
        totals = totals.withColumn("weight", F.col("total"))
    else:
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("_weight")).filter("_weight > 0")
        totals = totals.join(given, F.col("queue").eqNullSafe(F.col("_source")), "left").select(
            "queue", "total", F.coalesce("_weight", F.sum("_weight").over(W.partitionBy()), F.lit(1.0)).alias("weight")
        )
    rows = tokens.join(base.drop("n"), F.col("queue").eqNullSafe(F.col("_queue")) & (F.col("task") == F.col("_task")))
    rows = rows.select("id", "queue", "n", (F.col("base") + F.col("start")).alias("first"), "ids")
    pieces = rows.mapInPandas(
        _cut(quantum, keep_ids),
        f"doc_id {kind}, queue string, cell bigint, inside bigint, start bigint, length bigint, ids_crc32 bigint, "
        "doc_tokens bigint, ids binary",
    )
    where = schedule(totals, window, quantum).select(F.col("queue").alias("_q"), F.col("cell").alias("_c"), "sequence_id", "at")
    return pieces.join(where.hint("merge"), F.col("queue").eqNullSafe(F.col("_q")) & (F.col("cell") == F.col("_c"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"),
        (F.col("at") + F.col("inside")).cast("long").alias("offset"), "queue", "ids",
    )
