from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from barflow.llm import graph
from barflow.llm import order_minhash as M

rng = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(4000)]
PASSAGE = " ".join(rng.choices(VOCABULARY, k=70))


def near(text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


def rows():
    out, base = [], " ".join(rng.choices(VOCABULARY, k=200))
    out += [near(base, 2) for _ in range(40)]  # a group around one text
    for _ in range(15):
        text = " ".join(rng.choices(VOCABULARY, k=rng.randint(40, 400)))
        out += [text, near(text, 1), near(text, max(1, len(text.split()) // 60))]
        words = text.split()
        out.append(" ".join(words[len(words) // 2 :] + words[: len(words) // 2]))  # same k-mers, other order
    out += [PASSAGE + " " + " ".join(rng.choices(VOCABULARY, k=rng.randint(20, 90))) for _ in range(60)]
    out += [" ".join(rng.choices(VOCABULARY, k=k)) for k in (1, 2, 3, 4, 5, 6, 9) for _ in range(3)]
    out += ["spam " * 300, "spam " * 299, "Spam, " * 300, None, "", "...", "a b c d e", "A b; c d e", "x" * 100_000, " ".join(rng.choices(VOCABULARY, k=20_000))]
    return out


def brute(texts):
    """Smallest index of each text's class: all pairs, then components."""
    kmers = [M.labelled_kmers(M.word_codes(t)) for t in texts]
    codes = [M.word_codes(t).tobytes() for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if codes[i] == codes[j] or (len(kmers[i]) and len(kmers[j]) and M.similarity(kmers[i], kmers[j]) >= M.SIMILARITY):
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_classes_equal_all_pairs(documents):
    texts = rows()
    got = {r.doc_id: r for r in M.classes(documents(list(enumerate(texts)))).collect()}
    want = brute(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].kept == (i == want[i]) and got[i].class_size == want.count(want[i]) for i in range(len(texts)))
    assert len(set(want)) > 80


def test_copies_of_one_original_and_chains_of_versions(documents):
    r = random.Random(8)

    def edited(words, at):
        out = list(words)
        for k in at:
            out[k] = r.choice(VOCABULARY)
        return out

    base = r.choices(VOCABULARY, k=200)
    star = [base] + [edited(base, r.sample(range(5, 195), r.choice((3, 4)))) for _ in range(300)]
    chain = [r.choices(VOCABULARY, k=200)]
    for k in range(60):
        chain.append(edited(chain[-1], [(37 * k + 50 * j) % 190 + 5 for j in range(4)]))
    texts = [" ".join(w) for w in star + chain]
    got = {x.doc_id: x.class_id for x in M.classes(documents(list(enumerate(texts)))).collect()}
    assert {got[i] for i in range(len(star))} == {0}
    assert {got[i] for i in range(len(star), len(texts))} == {len(star)}


def test_short_texts_and_their_ends(documents):
    r = random.Random(9)
    texts = []
    for n in (8, 9, 10, 11, 13, 17, 18, 24, 30, 34, 38, 41):
        for _ in range(6):
            words = r.choices(VOCABULARY, k=n)
            some = (n - 4) // 5 or 1  # as many k-mers may go
            texts += [words, words[some:], words[:-some], words[some // 2 : n - (some + 1) // 2]]
    texts = [" ".join(w) for w in texts]
    got = {x.doc_id: x.class_id for x in M.classes(documents(list(enumerate(texts)))).collect()}
    assert got[4 * 6] == got[4 * 6 + 1] == got[4 * 6 + 2]  # 9 words against 8
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_exact_keys_miss_no_pair():
    r = np.random.default_rng(2)
    for _ in range(20_000):
        n = int(r.integers(1, M.FEW + 1))
        a = r.integers(0, 2**63, n).astype(np.uint64)
        m = int(r.integers(np.ceil(0.8 * n - 1e-9), int(n / 0.8 + 1e-9) + 1))
        common = -(-4 * (n + m) // 9)
        if common > min(n, m):
            continue
        b = np.r_[r.choice(a, common, replace=False), r.integers(0, 2**63, m - common).astype(np.uint64)]
        assert set(M.all_keys(a).tolist()) & set(M.all_keys(b).tolist()), (n, m)


def slow_similarity(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1] / (len(a) + len(b) - table[-1, -1])


@pytest.mark.parametrize("seed", range(30))
def test_alignment(seed):
    r = random.Random(seed)
    text = [r.choice("abcdefghij") if seed % 3 else f"w{k}" for k in range(r.randint(8, 90))]
    other = [w for w in text if r.random() > 0.02]
    for _ in range(r.randint(0, 3)):
        other.insert(r.randrange(len(other) + 1), "new")
    a, b = (M.labelled_kmers(M.word_codes(" ".join(t))) for t in (text, other))
    want, got = slow_similarity(a.tolist(), b.tolist()), M.similarity(a, b)
    assert (got >= M.SIMILARITY) == (want >= M.SIMILARITY) and (got in (0.0,) or want < M.SIMILARITY or got == want)


def test_dedup_keeps_ties_and_columns(documents):
    docs = documents([(7, "one two three four five six"), (7, "one two three four five six"), (None, "one two three four five six"), (9, "other words here")])
    out = M.dedup(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [7, 9]
    assert M.dedup(documents([])).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(1000, 1000 + k) for k in range(1, 300)]
    edges += [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(150)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
