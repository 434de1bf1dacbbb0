from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.llm import packing, queries

LONG = "la vie, c'est  l'été!\n" * 3000
ROWS = [(i, f"Word{i % 7} don't stop 12 {'x' * (i % 40)}. " * (1 + i % 25), f"s{i % 4}") for i in range(120)] + [
    (200, None, "s0"), (201, "", None), (202, LONG, "big"), (203, "日本語 テキスト <|endoftext|> İstanbul", "s1"), (None, "no id", "s2"),
    (5, "same", "s0"), (5, "same", "s0"),
]
SAMPLES = [
    "", " ", "It's we'LL they'd 'sit' ''s x's", "Größe ÄÖÜ ñandú ŒUVRE ŉ ſ İ ı", "a b c\x1cd\x85e", "½ ² ³4 １２",
    "été", "ΣΑΣ σας", "<|startoftext|> hi", "a_b-c--d!!'s", "tab\tnew\nline\r\x0b\x0c", "\xad soft", "don''t!'s 'S",
]


def test_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer())
    encoder = packing.Encoder(queries.tokenizer())
    assert encoder.by_word
    rng = random.Random(1)
    letters = [chr(c) for c in range(9, 0x180)] + [" "] * 60 + ["'"] * 9 + list("strvmlde") * 9
    texts = SAMPLES + ["".join(rng.choices(letters, k=60)) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


@pytest.mark.parametrize("weighted", [False, True])
def test_pack(spark, documents, weighted, monkeypatch):
    monkeypatch.setattr(packing, "ROUNDS_PER_BLOCK", 3)
    weights = spark.createDataFrame([("s0", 3.0), ("s1", 1.0), ("big", 2.0), ("s2", 0.0)], "source string, weight double") if weighted else None
    rows = packing.pack(documents(ROWS).repartition(3), queries.tokenizer(), weights).collect()
    encoder = packing.Encoder(queries.tokenizer())
    want = Counter(encoder.encode([t or ""])[0] + b"\x01\0\0\0" for _, t, _ in ROWS)
    used, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0 and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        used[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
    assert sorted(used) == list(range(len(used)))
    total = sum(r.length for r in rows)
    assert total == sum(len(x) // 4 * k for x, k in want.items()) and len(used) <= total / packing.WINDOW + 2
    for i, t, _ in ROWS:
        if i == 5 and t == "same":
            continue
        own = encoder.encode([t or ""])[0] + b"\x01\0\0\0"
        mine = sorted(p for p in parts[i] if p[3] == len(own) // 4)
        assert b"".join(p[2] for p in mine) == own and [p[0] for p in mine] == list(np.cumsum([0, *(p[1] for p in mine)])[:-1])


def test_every_window_has_the_mixture(spark):
    totals = {"a": 60_000, "b": 30_000, "c": 10_000, "d": 300}
    queues = spark.createDataFrame([(k, v, float(v)) for k, v in totals.items()], "queue string, total bigint, weight double")
    cells = packing.schedule(queues).collect()
    filled, last = defaultdict(Counter), max(r.sequence_id for r in cells)
    for r in cells:
        filled[r.sequence_id][r.queue] += packing.QUANTUM
    sent = Counter()
    for s in range(last - 1):
        sent.update(filled[s])
        for q, n in totals.items():
            assert abs(sent[q] - (s + 1) * packing.WINDOW * n / sum(totals.values())) <= (1 + len(totals)) * packing.QUANTUM, (s, q)


def test_cells_come_from_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 100)
    q = spark.createDataFrame([("a", 1, 1.0, 2050), (None, 2, 1.0, 100), ("c", 3, 1.0, 1)], "queue string, turn int, share double, full bigint")
    rows = packing._cells(q.coalesce(1)).select("queue", "cell", F.spark_partition_id().alias("task")).collect()
    assert sorted((str(r.queue), r.cell) for r in rows) == sorted((str(k), c) for k, n in (("a", 2050), (None, 100), ("c", 1)) for c in range(n))
    assert len({r.task for r in rows}) > 1 and max(Counter(r.task for r in rows).values()) < 2050


def test_empty(documents):
    assert packing.pack(documents([]), queries.tokenizer()).count() == 0


def test_the_cache_is_bounded_by_bytes(monkeypatch):
    """Texts of 10 MB, one of them without a space, and more words than fit: nothing long is remembered."""
    monkeypatch.setattr(packing, "_MOST_BYTES", 100_000)
    encoder = packing.Encoder(queries.tokenizer())
    plain = encoder.tokenizer
    texts = ["ab,cd." * 1_700_000, " ".join(f"w{k}x" for k in range(1_500_000)), "x" * 70 + " y"]
    made = encoder.encode(texts)
    assert encoder.held <= 100_000 and sum(len(k) + len(v) for k, v in encoder.known.items()) <= encoder.held
    assert max(map(len, encoder.known)) <= 64
    assert made[2] == np.asarray(plain.encode(texts[2], add_special_tokens=False).ids, "<u4").tobytes()
    assert made[0][-400:] == np.asarray(plain.encode("ab,cd." * 200, add_special_tokens=False).ids, "<u4").tobytes()[-400:]


def test_a_chunk_is_remembered_once_its_words_are(monkeypatch):
    """A new word costs one look-up and one place, whatever stands next to it; the ids are the tokenizer's either time."""
    encoder = packing.Encoder(queries.tokenizer())
    calls, word = [], encoder._word
    monkeypatch.setattr(encoder, "_word", lambda w: calls.append(w) or word(w))
    texts = ["thanstti, été! thanstti² don't x's", "a_b--c 12 thanstti.", "ªº\xad ñandú\xb7 y1 '' 's ½"]
    due = [np.asarray(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == due
    assert calls.count("thanstti") == 1 and "thanstti" in encoder.known and "thanstti," not in encoder.known
    assert encoder.encode(texts) == due == encoder.encode(texts)
    assert len(calls) == len(set(calls)) and "thanstti," in encoder.known
    assert encoder.known["thanstti,"] == encoder.known["thanstti"] + encoder.known[","]
