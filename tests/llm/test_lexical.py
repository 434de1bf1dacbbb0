from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from barflow.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, depth=10):
    """Every score of every document."""
    counts = [Counter(terms(t)) for _, t in docs]
    held = [c for c in counts if c]
    n, length = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    out = []
    for item, text in items:
        ranked = []
        for (doc, _), c in zip(docs, counts):
            m = 10 + (90 * sum(c.values()) * n) // length if c else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                ranked.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, r[3], -r[0]) for k, r in enumerate(sorted(ranked)[:depth], 1)]
    return sorted(out, key=str)


def test_terms():
    text = "Ab_c9 ÀB\x00x\u0085y Ż-É\x7f1.5 日本"
    assert X.occurrences(text) == Counter(t.encode() for t in terms(text))
    long = "aB " * 700_000 + "c" * 1_500_000
    assert X.occurrences(long) == {b"ab": 700_000, b"c" * 1_500_000: 1}
    assert not X.occurrences(None) and not X.occurrences("-- !")


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(k, " ".join(rnd.choices(words, k=int(rnd.paretovariate(0.5)) % 3000 + 1))) for k in range(n)]
    docs += [(k, docs[0][1]) for k in range(n, n + 15)] + [(n, docs[0][1])] * 2  # ties and repeated rows
    docs += [(None, docs[1][1]), (-1, None), (-2, ""), (-3, "?!"), (-4, " ".join(words) * 40), (-5, "W1 " * 400_000 + "rare")]
    items = [(k, " ".join(rnd.choices(words, k=rnd.randrange(1, 40)))) for k in range(25)]
    items += [(25, docs[0][1]), (26, None), (26, ""), (None, "w1 W1 w1"), (27, "absent words"), (28, "rare"), (28, "rare")]
    return docs, items


@pytest.mark.parametrize("per_block", [X.ITEMS, 10])
def test_against_all_scores(spark, documents, monkeypatch, per_block):
    docs, items = corpus(2, 300)
    monkeypatch.setattr(X, "ITEMS", per_block)
    df = documents(docs).withColumnsRenamed({"size": "q", "n": "score", "task": "rank"})
    got = X.rank(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, items)


def test_bounds_hold_and_exclude():
    """No score exceeds its bound, not even in full signatures, and most documents are excluded."""
    import pandas as pd

    docs, items = corpus(7, 400)
    docs = [d for d in docs if terms(d[1])]
    batch = pd.DataFrame({"file": 1, "row": range(len(docs)), "text": [t for _, t in docs]})
    counts = [Counter(terms(t)) for _, t in docs]
    n, length = len(docs), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    names = sorted(df)
    number = {t: k for k, t in enumerate(names)}
    sets = [X.np.array(sorted(number[t] for t in set(terms(x)) if t in df), X.np.int64) for _, x in items]
    q = X._Query([t.encode() for t in names], [X.weight(n, df[t]) for t in names], sets, n, length)
    scores = {(i, d): s for i, (_, x) in enumerate(items) for d, s in enumerate(
        sum(X.weight(n, df[t]) * X.impact(c[t], X.damping(sum(c.values()), n, length)) for t in set(terms(x)) if c[t]) for c in counts)}
    seen = 0
    for widest in (X.WIDEST, 9):
        X.WIDEST, keep = widest, X.WIDEST
        try:
            blocks = [b for out in X._signed([batch]) for b in out.to_dict("records")]
        finally:
            X.WIDEST = keep
        assert sorted(r for b in blocks for r in b["row"]) == list(range(len(docs)))
        for b in blocks:
            bound = X._bounds(q, b)
            for k, d in enumerate(b["row"]):
                for i in range(len(items)):
                    assert bound[i, k] >= scores[i, d]
                    seen += widest == keep and bound[i, k] <= 1.3 * scores[i, d]
    assert seen > 0.8 * len(scores)


def test_nothing_to_search(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert X.rank(documents([(1, "a b")]), none).count() == 0
    assert X.rank(documents([(1, "a b")]).limit(0), some).count() == 0
    assert X.rank(documents([(1, None), (2, "")]), some).count() == 0
    assert X.rank(documents([(1, "a b")]), some).collect()[0][:3] == (1, 1, 1)
