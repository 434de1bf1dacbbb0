"""Text and JSON column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a headline relevant to an asset.
KEYWORDS = {
    "BTC": ["bitcoin", "btc", "crypto"],
    "ETH": ["ethereum", "eth", "ether"],
    "GOLD": ["gold", "xau", "precious"],
    "OIL": ["oil", "crude", "wti", "opec"],
}

# Default word lists of the built-in scorer.
POSITIVE = ("gain", "gains", "rally", "surge", "rise", "rises", "record", "strong", "bullish", "profit", "up")
NEGATIVE = ("loss", "losses", "selloff", "crash", "fall", "falls", "weak", "bearish", "fear", "drop", "down")

# Label of a sentiment and its score.
LABEL_SCORES = {"positive": 1, "neutral": 0, "negative": -1}

ALPHAS = tuple(f"alpha_{i}" for i in range(1, 6))


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def mentions(text: Column, items: Sequence[str]) -> Column:
    """Whether the lower-cased text contains any of the items; False for NULL."""
    return reduce(lambda a, b: a | b, [F.contains(_low(text), F.lit(w.lower())) for w in items], F.lit(False))


def first_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """The first phrase, in dictionary order, contained in the text; NULL if none is.

    A chain of cases compiles, lowers the text once and stops at the first hit.
    """
    out = F.when(F.lit(False), F.lit(""))
    for p in phrases:
        out = out.when(F.contains(_low(text), F.lit(p.lower())), F.lit(p))
    return out


def tagged(tags: Column, asset: str | Column) -> Column:
    """Case-insensitive membership; False for a NULL or empty list."""
    want = F.upper(F.lit(asset) if isinstance(asset, str) else asset)
    return F.coalesce(F.exists(tags, lambda t: F.upper(t) == want), F.lit(False))


def text_for_sentiment(title: Column, full: Column | None = None) -> Column:
    """The full text, trimmed, where it is longer than the title, else the title."""
    t = F.coalesce(title, F.lit(""))
    if full is None:
        return t
    body = F.trim(full)
    return F.when(F.length(body) > F.length(t), body).otherwise(t)


def truncate(text: Column, size: int = 512) -> Column:
    return F.substring(text, 1, size)


def lexicon_score(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """struct(label, confidence, score) from counting listed words over the whole text.

    Score is the sign of positives minus negatives, confidence their gap over their
    sum; empty text or no listed word is neutral with confidence 0.
    """
    def count(words: Sequence[str]) -> Column:
        # a listed word with no letter on either side
        return F.regexp_count(_low(text), F.lit(f"(?<![a-z])(?:{'|'.join(words)})(?![a-z])"))

    pos, neg = count(positive), count(negative)
    label = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")
    return F.struct(
        label.alias("label"),
        F.coalesce(F.try_divide(F.abs(pos - neg).cast("double"), (pos + neg).cast("double")), F.lit(0.0)).alias("confidence"),
        label_score(label).alias("score"),
    )


def label_score(label: Column) -> Column:
    """1, 0 or -1; unknown labels count as neutral."""
    out = F.lit(0)
    for name, score in LABEL_SCORES.items():
        out = F.when(F.lower(label) == name, score).otherwise(out)
    return out


def parse_alphas(text: Column) -> Column:
    """struct(alpha_1..alpha_5) from a JSON reply, code fences allowed.

    Missing signals are 0, others are clamped to [-1, 1]; text that is no JSON
    object, or holds a value that is no number, gives zeros.
    """
    bare = F.trim(F.regexp_replace(F.trim(text), r"^```(json)?|```[\s\S]*$", ""))
    raw = F.from_json(bare, "map<string,string>")
    values = [F.try_element_at(raw, F.lit(a)) for a in ALPHAS]
    numbers = [v.try_cast("double") for v in values]
    bad = F.lit(False)
    for v, n in zip(values, numbers):
        bad = bad | (v.isNotNull() & n.isNull())
    return F.struct(
        *[
            F.when(bad, F.lit(0.0)).otherwise(F.greatest(F.least(F.coalesce(n, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))).alias(a)
            for n, a in zip(numbers, ALPHAS)
        ]
    )


def parse_seen(text: Column) -> Column:
    """Feed time such as 20260401T101500Z, NULL if it is none."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmssX"))


def published(seen: Column | None, stored: Column | None = None, latency: str = "0 minutes") -> Column:
    """Time of an article: the feed's, where the feed gives any; else the stored one as UTC; later by the latency."""
    at = parse_seen(seen) if seen is not None else F.coalesce(stored, F.lit(None)).cast("timestamp")
    return at + F.expr(f"INTERVAL {latency}")
