from __future__ import annotations

import random
import re

from barflow.llm import licenses as L

FILLER = [f"w{i}" for i in range(500)]
rng = random.Random(2)


def filler(n):
    return " ".join(rng.choices(FILLER, k=n))


MIT = L.TEMPLATES[1][1]
TEXTS = {
    0: None, 1: "", 2: "Released under the MIT License.", 3: "UNDER the\n\nmit, license under the MIT-license",
    4: "Apache License, Version 2.0 and CC BY-NC 4.0", 5: filler(80) + " " + MIT + " " + filler(50),
    6: filler(30) + " " + MIT.replace("free of charge", "at no charge whatsoever") + filler(9),
    7: filler(400), 8: "permission is hereby granted by nobody to anyone", 9: "Öunder the mit license", 10: "ünder the mit license_x",
    11: "under the mit " * 40_000, 12: "This work is licensed under the GNU General Public License, version 3.", 13: "cc by nc " * 300,
    14: "cc by nd, cc-by-nc", 15: "one", 16: "under the mit", 17: " ".join(MIT.split()[::-1]),
}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = sorted(i for i, _ in places)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, sorted({x for _, x in places})


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_base_and_spans(documents):
    docs = documents([*TEXTS.items(), (None, TEXTS[2]), (5, TEXTS[5])])
    got = L.labels(L.scan(docs)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[2]
        want = brute(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, r.doc_id
        assert set(r.base_labels) <= set(r.labels) and r.labels == sorted(set(r.labels)) and 0 <= r.score <= 1
        if r.doc_id != 11:
            words = L._split(text or "")
            for s in r.spans or []:
                template = L._split(L.TEMPLATES[s.template][1])
                assert lcs(words[max(0, s.first - 3) : s.last + 4], template) >= L.COVERED * len(template)
    by = {r.doc_id: r for r in got}
    assert by[5].labels == ["mit"] and by[5].n_base == 0 and by[5].score == 1.0 and by[5].spans[0].first == 80
    assert by[6].labels == ["mit"] and by[6].score < 1 and by[12].labels == ["gpl-3"] and by[4].labels == ["apache-2", "cc-by-nc"]
    assert by[7].labels == by[8].labels == by[14].labels[:0] and by[7].score == 0 and by[17].labels == []


def test_empty(documents):
    assert L.labels(L.scan(documents([]))).count() == 0


def test_words_in_another_order_and_repeated_copies(documents):
    words = MIT.split()
    triples = [words[k : k + 3] for k in range(0, len(words), 3)]
    notice = L.TEMPLATES[0][1]
    docs = documents([(1, " ".join(w for t in reversed(triples) for w in t)), (2, (notice + " ") * 50), (3, f"{MIT} {filler(4)} {MIT}")])
    by = {r.doc_id: r for r in L.labels(L.scan(docs)).collect()}
    assert by[1].labels == [] and by[1].spans is None
    assert [(s.first, s.last) for s in by[2].spans if s.template == 0] == [(5 * k, 5 * k + 4) for k in range(50)]
    size = len(L._split(MIT))
    assert [(s.first, s.last, s.score) for s in by[3].spans] == [(0, size - 1, 1.0), (size + 4, 2 * size + 3, 1.0)]


def test_alignment_in_order_against_longest_common_runs():
    rnd = random.Random(6)
    for _ in range(200):
        template = [f"t{k}" for k in range(rnd.randrange(8, 30))]
        text = list(template)
        for _ in range(rnd.randrange(0, 4)):
            k = rnd.randrange(len(text))
            text[k : k + rnd.randrange(0, 2)] = ["x"] * rnd.randrange(0, 2)
        at = {tuple(template[k : k + L.GRAM]): k for k in range(len(template) - L.GRAM + 1)}
        votes = [(k, at[g]) for k in range(len(text) - L.GRAM + 1) if (g := tuple(text[k : k + L.GRAM])) in at]
        covered = {a + j for _, a in votes for j in range(L.GRAM)}
        found = L.in_order(votes, len(template), 0.8)
        assert bool(found) == (len(covered) / len(template) >= 0.8)
        if found:
            assert len(found) == 1 and found[0][2] == len(covered) / len(template)
