from __future__ import annotations

import random
import re
from collections import defaultdict

from barflow.llm import sentences as S

rng = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(3000)]


def prose(n):
    out = []
    while n > 0:
        k = min(n, rng.randint(1, 14))
        out.append(" ".join(rng.choices(VOCABULARY, k=k)).capitalize() + rng.choice([". ", "! ", ".\n", "? "]))
        n -= k
    return "".join(out)


PASSAGE, LINE = prose(70).strip(), "W1 common line. Of all. Pages here."


def rows():
    out = [prose(rng.randint(20, 200)) for _ in range(30)]
    out += [prose(40) + "unfinished words " + PASSAGE + " and then " + prose(40) for _ in range(6)]
    out += [LINE + "\n" + prose(60) for _ in range(20)]
    out += [out[0], out[1].upper(), PASSAGE + "\n" + PASSAGE, None, "", "...", "one", "x" * 200_000, "no end " * 9000, "A. B. C. D. " * 400]
    return list(enumerate(out)) + [(5, out[5]), (None, out[6])]


def brute(rows):
    """Every run of every text in a dictionary; sentences in a run that is not the first of its kind, in long stretches."""
    first, places = {}, []
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        parts = [(t or "")[a:b].lower().split() for a, b in S.split(t or "")]
        for a in range(len(parts)):
            b = a + S.RUN_SENTENCES
            while b <= len(parts) and sum(map(len, parts[a:b])) < S.RUN_WORDS:
                b += 1
            if b <= len(parts):
                key = tuple(map(tuple, parts[a:b]))
                places.append((key, (i, t), a, b))
                first.setdefault(key, ((i, t), a))
    gone = defaultdict(set)
    for key, row, a, b in places:
        if first[key] != (row, a):
            gone[row].update(range(a, b))
    return gone


def expected(text, gone):
    spans = S.split(text or "")
    out, at, k = [], 0, 0
    while k < len(spans):
        end = k
        while end < len(spans) and end in gone:
            end += 1
        if end > k:
            low, high = spans[k][0], spans[end - 1][1]
            if len(text[low:high].split()) >= S.LEAST_WORDS:
                out.append(text[at:low])
                at = high
        k = max(end, k + 1)
    return "".join(out) + text[at:] if out or at else text


def test_dedup_equals_brute_force(documents):
    table = rows()
    got = S.dedup(documents(table)).collect()
    gone = brute(table)
    want = sorted(((i, expected(t, gone[(i, t)])) for i, t in table), key=str)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    with_passage = [r for r in got if r.doc_id is not None and 30 <= r.doc_id < 36]
    assert sum(PASSAGE.split("\n")[0] in r.text for r in with_passage) <= 1
    assert all(r.n_removed == 0 for r in got if r.doc_id is not None and 36 <= r.doc_id < 56)


def test_passages_of_few_sentences_or_cut_ends(documents):
    def sentence(n):
        return " ".join(rng.choices(VOCABULARY, k=n)).capitalize() + "."

    two = sentence(30) + " " + sentence(30)
    ends, inner = [" ".join(rng.choices(VOCABULARY, k=15)) for _ in range(2)], sentence(11) + " " + sentence(11)
    cut = ends[0] + ". " + inner + " " + ends[1].capitalize()
    table = [(i, f"{prose(40)}{two} {prose(40)}") for i in range(3)]
    table += [(i, f"{prose(40)}Begun {i} {cut} that {i} goes on. {prose(40)}") for i in range(3, 6)]
    got = {r.doc_id: r for r in S.dedup(documents(table)).collect()}
    assert all((two in got[i].text) == (i == 0) for i in range(3))
    assert all((inner in got[i].text) == (i == 3) for i in range(3, 6))
    assert [got[i].removed_words for i in range(6)] == [0, 60, 60, 0, 22, 22]


def test_split_at_spaces():
    texts = [t for _, t in rows() if t and len(t) < 3000] + ["Eins zwei. drei  Vier\n\n fünf!? Sechs", " .a. b", "A", "\n", "x\u00a0Y z.\u2003w", "Ab Él. 。 c"]
    for text in texts:
        want, at = [], 0
        for gap in re.finditer(r"\s+", text):
            before, after = text[: gap.start()], text[gap.end() :]
            if not before or not after or before[-1] in S.ENDERS or "\n" in gap.group() or after[0].isupper():
                want += [(at, gap.start())] * (at < gap.start())
                at = gap.end()
        want += [(at, len(text))] * (at < len(text))
        assert S.split(text) == want, text


def test_same_row_twice_stays(documents):
    text = prose(90)
    assert [r.text for r in S.dedup(documents([(1, text), (1, text)])).collect()] == [text, text]
    assert S.dedup(documents([])).count() == 0
