"""Language of text: script ranges narrow the languages of a word, Viterbi with a switching penalty labels spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow import session

BUCKETS = 1 << 15
# Nats a change of language from one word to the next must gain.
SWITCH = 8.0
MOST_LANGUAGES = 512
UNDETERMINED = "und"
_CHARS_AT_ONCE = 2_000_000
_OTHER_SCRIPT = -60.0
# Scores of trigrams looked up at once.
_CELLS = 4_000_000

# Blocks of code points by script, first and last.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("gurmukhi", ((0xA00, 0xA7F),)),
    ("gujarati", ((0xA80, 0xAFF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("telugu", ((0xC00, 0xC7F),)),
    ("kannada", ((0xC80, 0xCFF),)),
    ("malayalam", ((0xD00, 0xD7F),)),
    ("sinhala", ((0xD80, 0xDFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("lao", ((0xE80, 0xEFF),)),
    ("tibetan", ((0xF00, 0xFFF),)),
    ("burmese", ((0x1000, 0x109F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("ethiopic", ((0x1200, 0x137F),)),
    ("khmer", ((0x1780, 0x17FF),)),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)

_tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _letters_and_scripts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each code point can stand in a word (a letter or a mark on one), whether it is a letter, and the bit of its script
    (bit 0: any other)."""
    global _tables
    if _tables is None:
        kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        joined, letters = (np.fromiter((k in wanted for k in kinds), bool, 0x110000) for wanted in ("LM", "L"))
        scripts = np.ones(0x110000, np.uint32)
        for bit, (_, blocks) in enumerate(SCRIPTS, 1):
            for first, last in blocks:
                scripts[first : last + 1] = 1 << bit
        _tables = joined, letters, scripts
    return _tables


class _Words:
    """Words (runs of letters and marks with a letter at least) of some texts: bucket of each letter's trigram, and each word's
    text, size and scripts."""

    def __init__(self, texts: list[str]):
        joined, letters, scripts = _letters_and_scripts()
        low = [t.lower() for t in texts]
        codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in low])
        inside = joined[codes]
        x = np.where(inside, codes, 0).astype(np.uint64)
        at = np.flatnonzero(inside)
        if len(at):  # marks alone are no word
            starts = np.flatnonzero(~inside[at - 1])
            real = np.logical_or.reduceat(letters[codes[at]], starts)
            at = at[np.repeat(real, np.diff(np.append(starts, len(at))))]
        mixed = (x[at - 1] * np.uint64(0x9E3779B97F4A7C15) + x[at]) * np.uint64(0xBF58476D1CE4E5B9) + x[at + 1]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.buckets = (mixed >> np.uint64(49)).astype(np.int64)
        self.starts = np.flatnonzero(~inside[at - 1]) if len(at) else at
        self.letters = np.diff(np.append(self.starts, len(at)))
        self.bits = scripts[codes[at]]
        self.text = np.searchsorted(ends, at[self.starts], side="right")
        self.scripts = np.bitwise_or.reduceat(self.bits, self.starts) if len(self.starts) else self.bits


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram buckets and scripts (numbered on from BUCKETS) by language, summed over the task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            own = sums.setdefault(lang, np.zeros(BUCKETS + 32, np.int64))
            for part in _parts([t for t in texts if t]):
                words = _Words(part)
                own[:BUCKETS] += np.bincount(words.buckets, minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(np.log2(words.bits).astype(int), minlength=32)
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > _CHARS_AT_ONCE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


class Model:
    """Log-probability of every trigram bucket in every language, and the scripts each language is written in."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        grams = counts[:, :BUCKETS] + 0.2
        self.scores = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32).copy()
        letters = counts[:, BUCKETS:]
        used = letters > 0.002 * letters.sum(1, keepdims=True)
        self.scripts = (used * (1 << np.arange(32, dtype=np.int64))).sum(1).astype(np.uint32)

    def spans(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Of each text: its language by letters, their share, and its spans of words (first, last, language)."""
        out: list = [(UNDETERMINED, 0.0, [])] * len(texts)
        if not self.languages:
            return out
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        done = 0
        for part in _parts([texts[i] for i in order]):
            for k, result in enumerate(self._label(part)):
                if result is not None:
                    out[order[done + k]] = result
            done += len(part)
        return out

    def _scored(self, words: _Words) -> np.ndarray:
        """Log-probability of each word in each language; the trigrams' are looked up for some words at a time."""
        out = np.empty((len(words.starts), len(self.languages)))
        ends = np.append(words.starts, len(words.buckets))
        most, first = max(1, _CELLS // len(self.languages)), 0
        while first < len(words.starts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
            some = words.buckets[ends[first] : ends[last]]
            out[first:last] = np.add.reduceat(self.scores[some], words.starts[first:last] - ends[first], axis=0)
            first = last
        return out

    def _label(self, texts: list[str]) -> list:
        words = _Words(texts)
        n, languages = len(words.starts), len(self.languages)
        out: list = [None] * len(texts)
        if not n:
            return out
        scores = self._scored(words)
        allowed = (words.scripts[:, None] & self.scripts[None, :]) != 0
        allowed |= ~allowed.any(1, keepdims=True)
        scores = np.where(allowed, scores, scores + _OTHER_SCRIPT * words.letters[:, None])
        path = _viterbi(scores, words.text)
        share = np.bincount(words.text * languages + path, words.letters, len(texts) * languages).reshape(len(texts), languages)
        fresh = np.flatnonzero(np.r_[True, (words.text[1:] != words.text[:-1]) | (path[1:] != path[:-1])])
        last = np.r_[fresh[1:], n] - 1
        first_word = np.searchsorted(words.text, np.arange(len(texts)))
        best, total = share.argmax(1), share.sum(1)
        spans: list[list] = [[] for _ in texts]
        for t, a, b, lang in zip(words.text[fresh].tolist(), fresh.tolist(), last.tolist(), path[fresh].tolist(), strict=True):
            spans[t].append((a - first_word[t], b - first_word[t], self.languages[lang]))
        for t in np.flatnonzero(total).tolist():
            out[t] = (self.languages[best[t]], float(share[t, best[t]] / total[t]), spans[t])
        return out


def _viterbi(scores: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Best state of every word, with SWITCH off for each change; all texts step through their words side by side."""
    sizes = np.bincount(text)
    rank = np.empty(len(sizes), np.int64)
    rank[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))
    step = np.arange(len(text)) - np.searchsorted(text, text)
    order = np.lexsort((rank[text], step))
    scores = scores[order]
    active = np.bincount(step)
    offset = np.cumsum(active) - active
    stay = np.ones(scores.shape, bool)
    best = np.zeros(len(scores), np.int64)
    final = np.zeros(len(sizes), np.int64)
    value = scores[: active[0]]
    for k in range(1, len(active)):
        a, b = offset[k], offset[k] + active[k]
        if len(value) > active[k]:
            final[active[k] : len(value)] = value[active[k] :].argmax(1)
            value = value[: active[k]]
        top = value.argmax(1)
        jump = value[np.arange(len(top)), top][:, None] - SWITCH
        np.greater_equal(value, jump, out=stay[a:b])
        best[a:b] = top
        value = np.maximum(value, jump) + scores[a:b]
    final[: len(value)] = value.argmax(1)
    path = np.empty(len(scores), np.int64)
    state = final.copy()
    rows = np.arange(len(sizes))
    for k in range(len(active) - 1, -1, -1):
        a, n = offset[k], active[k]
        now = state[:n]
        path[a : a + n] = now
        if k:
            state[:n] = np.where(stay[a : a + n][rows[:n], now], now, best[a : a + n])
    out = np.empty(len(path), np.int64)
    out[order] = path
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from. A null id counts as an empty one, which is learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def learn(docs: DataFrame) -> Model:
    """A model from all rows of (text, lang) with both. Counts are summed per task and then by Spark; what reaches the driver
    has at most BUCKETS + 32 rows for a language, and more than MOST_LANGUAGES languages are refused."""
    session.ship(docs.sparkSession)
    known = docs.filter("text is not null and lang is not null").select("text", "lang")
    counts = known.mapInPandas(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = session.settle(counts, "trigrams")
    languages = sorted(r.lang for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.zeros((len(languages), BUCKETS + 32))
    rows = counts.toPandas()
    table[np.searchsorted(languages, rows["lang"]) if len(rows) else [], rows["bucket"]] = rows["n"]
    return Model(languages, table)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, spans; one row per row of `docs`, from the whole text and nothing else.

    A text is cut into words, runs of letters and marks with a letter at least. The scripts of a word narrow its languages to those learned from texts with
    that script (all, if none); a word's score in a language is the log-probability of its letter trigrams. Viterbi over the
    words with a penalty per change labels spans; lang_pred is the language with most letters (the first by name in a tie)
    and score its share of the letters. Null text and text without letters are `und` with score 0 and no spans. Equal texts
    have equal results. A very long text is one row of work: its words' scores in each language are held, its trigrams' a part at a time. An empty table gives no rows.
    """
    session.ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = model.spans([t or "" for t in batch["text"]])
            spans = [[{"first": a, "last": b, "lang": x} for a, b, x in f[2]] for f in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "spans": spans})

    shape = f"doc_id {kind}, lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>"
    return docs.select("doc_id", "text").mapInPandas(run, shape)
