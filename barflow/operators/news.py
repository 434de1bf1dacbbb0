"""News: tagging, scoring, hourly sentiment, alignment to bars, dashboard aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow import session
from barflow.functions import text as X
from barflow.operators.asof import asof_backward, asof_forward
from barflow.operators.features import SENTIMENT
from barflow.operators.indicators import carry_forward
from barflow.operators.series import arrange
from barflow.operators.windows import every_nth, on_spine

# Phrases up to which a dictionary is a literal in the plan, and phrases of one pass beyond that.
LITERAL_PHRASES, PHRASES_PER_PASS = 1_000, 200_000


def tag_by_phrase(df: DataFrame, phrases: dict[str, Sequence[str]], text: str = "title", url: str = "url") -> DataFrame:
    """One row per (URL, asset) with the first phrase of the asset's list in the text, whatever its case.

    An article may be tagged with several assets. Copies of a URL combine before the shuffle. A short dictionary is a
    literal in the plan. A longer one becomes an Aho-Corasick automaton in each task, which finds all phrases in one
    look at each character; the largest are cut into passes. All give the same rows.
    """
    if sum(len(p) for p in phrases.values()) <= LITERAL_PHRASES:
        return _tagged(_literal_hits(df, phrases, text, url))
    session.ship(df.sparkSession)
    entries = [(a, i, p) for a, ps in phrases.items() for i, p in enumerate(ps)]
    passes = [_automaton_hits(df, entries[k : k + PHRASES_PER_PASS], text, url) for k in range(0, len(entries), PHRASES_PER_PASS)]
    return _tagged(reduce(DataFrame.unionByName, passes))


def _tagged(hits: DataFrame) -> DataFrame:
    return hits.groupBy("url", "asset").agg(F.min_by("query", "place").alias("query"))


def _literal_hits(df: DataFrame, phrases: dict[str, Sequence[str]], text: str, url: str) -> DataFrame:
    """url, asset, query, place (in the asset's list)."""
    hits = F.array(
        *[
            F.struct(F.lit(a).alias("asset"), X.first_phrase(F.col(text), p).alias("query"))
            for a, p in phrases.items()
        ]
    )
    places: dict[str, int] = {}
    for a, ps in phrases.items():
        for i, p in enumerate(ps):
            places.setdefault(f"{a}\x01{p}", i)
    rank = F.create_map(*[x for name, i in places.items() for x in (F.lit(name), F.lit(i))])
    rows = df.select(F.col(url).alias("url"), F.explode(hits).alias("h")).filter(F.col("h.query").isNotNull())
    order = F.try_element_at(rank, F.concat_ws("\x01", "h.asset", "h.query"))
    return rows.select("url", F.col("h.asset").alias("asset"), F.col("h.query").alias("query"), order.alias("place"))


def _automaton_hits(df: DataFrame, entries: Sequence[tuple[str, int, str]], text: str, url: str) -> DataFrame:
    shape = T.StructType(
        [T.StructField("url", df.schema[url].dataType), T.StructField("asset", T.StringType()), T.StructField("query", T.StringType()), T.StructField("place", T.IntegerType())]
    )
    shared = df.sparkSession.sparkContext.broadcast(list(entries))  # at most PHRASES_PER_PASS phrases

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine, everywhere = ahocorasick.Automaton(), []
        for asset, place, phrase in shared.value:
            key = phrase.lower()
            if key:
                machine.add_word(key, [*machine.get(key, ()), (asset, place, phrase)])
            else:
                everywhere.append((asset, place, phrase))
        if len(machine):
            machine.make_automaton()
        for batch in batches:
            rows = []
            for link, body in zip(batch["url"], batch["text"], strict=True):
                best: dict[str, tuple[int, str]] = {}
                found = {id(own): own for _, own in machine.iter(body or "")} if len(machine) else {}
                for asset, place, phrase in [*everywhere, *(x for own in found.values() for x in own)]:
                    best[asset] = min(best.get(asset, (place, phrase)), (place, phrase))
                rows += [(link, asset, phrase, place) for asset, (place, phrase) in best.items()]
            yield pd.DataFrame(rows, columns=["url", "asset", "query", "place"])

    return df.select(F.col(url).alias("url"), F.lower(F.col(text)).alias("text")).mapInPandas(find, shape)


def score(df: DataFrame, text: str = "text_for_sentiment", **lists: Sequence[str]) -> DataFrame:
    """Built-in scorer as column expressions: adds label, confidence, score."""
    return df.withColumn("_s", X.lexicon_score(F.col(text), **lists)).select("*", "_s.*").drop("_s")


def score_with(
    df: DataFrame, make_scorer: Callable[[], Callable[[list[str]], Sequence[tuple[str, float]]]], text: str = "text_for_sentiment"
) -> DataFrame:
    """Score with a model: `make_scorer()` runs once per task and returns a batch scorer.

    The scorer gives (label, confidence) per text. Empty texts, unknown labels and
    failing batches are neutral; a failing batch is retried text by text first.
    """
    session.ship(df.sparkSession)
    added = [
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("score", T.IntegerType()),
    ]
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()

        def attempt(texts: list[str]) -> list[tuple[str, float]]:
            try:
                out = [(str(a).lower(), float(c)) for a, c in scorer(texts)]
                if len(out) != len(texts):
                    raise ValueError("scorer changed the number of texts")
                return out
            except Exception:
                if len(texts) == 1:
                    return [("neutral", 0.0)]
                return [r for t in texts for r in attempt([t])]

        for batch in batches:
            texts = batch[text].fillna("").tolist()
            full = [i for i, t in enumerate(texts) if t.strip()]
            result = [("neutral", 0.0)] * len(texts)
            if full:
                for i, r in zip(full, attempt([texts[i] for i in full])):
                    result[i] = r
            batch["label"] = [a for a, _ in result]
            batch["confidence"] = [c for _, c in result]
            batch["score"] = pd.array([X.LABEL_SCORES.get(a, 0) for a, _ in result], dtype="int32")
            yield batch

    return df.mapInPandas(run, schema)


def hourly_columns() -> list[Column]:
    s = F.col("sentiment_score")
    return [
        F.avg(s).alias("sentiment_mean"),
        F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("sentiment_std"),
        F.count("url").cast("double").alias("news_volume"),
        F.avg(F.when(s == 1, 1.0).otherwise(0.0)).alias("positive_ratio"),
        F.avg(F.when(s == -1, 1.0).otherwise(0.0)).alias("negative_ratio"),
        F.avg("confidence").alias("avg_confidence"),
    ]


def hourly(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Sentiment of each asset and non-empty hour.

    Volume counts articles with a URL while the ratios divide by all articles; the
    deviation of a single article is 0.
    """
    return df.filter(F.col(ts).isNotNull()).groupBy("asset", F.date_trunc("hour", ts).alias("ts")).agg(*hourly_columns())


def shift(buckets: DataFrame, mode: str = "bucket") -> DataFrame:
    """Make an hour's news known later, so that no bar sees its own hour.

    `bucket` moves values to the next non-empty hour (zeros first), `calendar` to
    the next hour.
    """
    if mode == "calendar":
        filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in SENTIMENT}
        return buckets.withColumns(filled).withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))
    if mode != "bucket":
        raise ValueError(f"unknown mode {mode!r}")

    def fn(d, w):
        return d.select("*", *[F.lag(c, 1).over(w).alias(f"_p_{c}") for c in SENTIMENT]).withColumns(
            {c: F.coalesce(F.col(f"_p_{c}"), F.lit(0.0)) for c in SENTIMENT}
        ).drop(*[f"_p_{c}" for c in SENTIMENT])

    return arrange(buckets, ["asset"], ["ts"]).bounded(fn, back=1).frame()


def to_wide(df: DataFrame, asset: str, feed: str = "gdelt") -> DataFrame:
    """One asset's hourly table under its export names."""
    return df.filter(F.col("asset") == asset).select(
        F.col("ts").alias("timestamp_utc"), *[F.col(c).alias(f"{asset.lower()}_{feed}_{c}") for c in SENTIMENT]
    )


def align_to_bars(articles: DataFrame, bars: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Each article with the first bar at or after it; articles after the last bar drop."""
    out = asof_forward(articles, bars.select("asset", "ts"), ["asset"], [], left_ts=ts, right_ts="ts", matched_ts="bar_ts")
    return out.filter(F.col("bar_ts").isNotNull())


def news_windows(bars: DataFrame, articles: DataFrame, window: int = 24, every: int = 4, ts: str = "timestamp_utc") -> DataFrame:
    """Bars with n_articles, has_news (any in the last `window` bars) and sampled.

    `sampled` marks every `every`-th bar among those with news.
    """
    counts = align_to_bars(articles, bars, ts).groupBy("asset", F.col("bar_ts").alias("ts")).agg(
        F.count(F.lit(1)).alias("n_articles")
    )
    joined = bars.join(counts, ["asset", "ts"], "left").fillna({"n_articles": 0})

    def fn(d, w):
        return d.withColumn("has_news", F.sum("n_articles").over(w.rowsBetween(-(window - 1), 0)) > 0)

    s = arrange(joined, ["asset"], ["ts"], bound=[bars, articles]).bounded(fn, back=window - 1)
    return every_nth(s, F.col("has_news"), every, "sampled").frame()


def carry_signals(flags: DataFrame, sampled: DataFrame, cols: Sequence[str] = X.ALPHAS) -> DataFrame:
    """Sampled signals carried forward over bars with news; 0 before any and without news."""
    joined = flags.join(sampled.select("asset", "ts", *cols), ["asset", "ts"], "left")
    at = {c: F.when(F.col("sampled"), F.coalesce(F.col(c), F.lit(0.0))) for c in cols}
    s = carry_forward(arrange(joined.withColumns(at), ["asset"], ["ts"], bound=[flags, sampled]), cols)
    return s.frame().withColumns(
        {c: F.when(F.col("has_news"), F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.lit(0.0)) for c in cols}
    )


def last_bars(bars: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """The last k bars up to and including each bar, oldest first."""
    return arrange(bars, ["asset"], ["ts"]).bounded(
        lambda d, w: d.withColumn("last_bars", F.collect_list(F.struct("ts", *cols)).over(w.rowsBetween(-(k - 1), 0))),
        back=k - 1,
    ).frame()


def last_headlines(bars: DataFrame, articles: DataFrame, k: int = 5, ts: str = "timestamp_utc", tie: str = "event_id") -> DataFrame:
    """The last k titles at or before each bar, oldest first; an empty list if none.

    Every article carries the k titles up to its own; a bar takes those of its latest
    article, so no list longer than k is ever built.
    """
    heads = arrange(
        articles.filter(F.col(ts).isNotNull()).select("asset", ts, tie, F.coalesce("title", F.lit("")).alias("title")),
        ["asset"],
        [ts, tie],
    ).bounded(
        lambda d, w: d.withColumn("headlines", F.collect_list("title").over(w.rowsBetween(-(k - 1), 0))), back=k - 1
    ).frame()
    out = asof_backward(bars.select("asset", "ts"), heads, ["asset"], ["headlines"], right_ts=ts, tie=[tie])
    return out.withColumn("headlines", F.coalesce("headlines", F.array().cast("array<string>")))


def bucket_mean(df: DataFrame, step: str, value: str = "sentiment_score", ts: str = "timestamp_utc") -> DataFrame:
    """Mean per asset and bucket, NULL in empty buckets between the first and last."""
    got = (
        df.filter(F.col(ts).isNotNull() & F.col(value).isNotNull())
        .groupBy("asset", F.window(ts, step).start.alias("ts"))
        .agg(F.avg(value).alias("mean"))
    )
    return on_spine(got, ["asset"], "ts", step)


def bucket_counts(df: DataFrame, step: str = "6 hours", ts: str = "timestamp_utc") -> DataFrame:
    got = (
        df.filter(F.col(ts).isNotNull())
        .groupBy("asset", F.window(ts, step).start.alias("ts"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return on_spine(got, ["asset"], "ts", step, fill={"n": 0})


def label_ratios(df: DataFrame, step: str = "6 hours", ts: str = "timestamp_utc") -> DataFrame:
    """Share of positive and negative labels; neutral is the rest. NULL in empty buckets."""
    def share(name: str):
        return F.avg(F.when(F.col("label") == name, 1.0).otherwise(0.0))

    got = (
        df.filter(F.col(ts).isNotNull())
        .groupBy("asset", F.window(ts, step).start.alias("ts"))
        .agg(share("positive").alias("positive"), share("negative").alias("negative"))
    )
    return on_spine(got, ["asset"], "ts", step).withColumn("neutral", 1 - F.col("positive") - F.col("negative"))


def daily_sentiment(df: DataFrame, assets: Sequence[str], ts: str = "timestamp_utc") -> DataFrame:
    """Day by asset mean, one column per asset; days without news of an asset are 0."""
    return (
        df.filter(F.col(ts).isNotNull() & F.col("sentiment_score").isNotNull())
        .groupBy(F.date_trunc("day", ts).alias("day"))
        .pivot("asset", list(assets))
        .agg(F.avg("sentiment_score"))
        .fillna(0.0)
    )


SKETCH_SIZE = 12  # 2**12 registers: a relative standard error of 1.6 %


def coverage_sketches(df: DataFrame, keys: Sequence[str] = ("asset",), ts: str = "timestamp_utc", distinct: Sequence[str] = ("domain", "sourcecountry")) -> DataFrame:
    """Per key and day: rows, rows with sentiment, and a mergeable sketch of each column's distinct values.

    A stored day needs no second look: longer spans merge its sketches, of a few KB each whatever the number of articles.
    """
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count("sentiment_score").alias("with_sentiment"),
        *[F.hll_sketch_agg(c, F.lit(SKETCH_SIZE)).alias(f"{c}_sketch") for c in distinct],
    )


def coverage_estimate(sketches: DataFrame, keys: Sequence[str] = ("asset",), distinct: Sequence[str] = ("domain", "sourcecountry")) -> DataFrame:
    """`coverage_sketches` merged to fewer keys: exact counts, and distinct values up to the sketch's error (none for a few)."""
    return sketches.groupBy(*keys).agg(
        F.sum("total").alias("total"),
        F.sum("with_sentiment").alias("with_sentiment"),
        *[F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(f"{c}_estimate") for c in distinct],
    )


def coverage(df: DataFrame) -> DataFrame:
    """Articles, scored articles, distinct domains and countries per asset."""
    return df.groupBy("asset").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("sentiment_score").alias("with_sentiment"),
        F.count_distinct("domain").alias("domains"),
        F.count_distinct("sourcecountry").alias("countries"),
    )


def daily_counts(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    return df.groupBy("asset", F.date_trunc("day", ts).alias("day")).agg(F.count(F.lit(1)).alias("articles"))
