"""Feeds, tagging, scoring, hourly sentiment and its joins to bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions import text as TX
from barflow.functions.output import tidy
from barflow.operators import features as X
from barflow.operators import news as N
from barflow.operators import reports as R
from barflow.plans.oracle import ARTICLES, BARS_H, WA, frame, rd, rds, ts, with_
from barflow.plans.registry import query
from barflow.sources import adapters as A
from barflow.sources import normalize as Z

PHRASES = {
    "NORTH": ["by the", "of the", "and the", "with"],
    "SOUTH": ["de la", "le la", "que", "pour"],
    "EAST": ["der", "und", "copyright", "license"],
}
POS, NEG = ("the", "and", "with", "le"), ("of", "by", "la", "que", "to")


def _in(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "s06_normalize_ohlcv",
    f"""WITH k AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
      CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS close,
      row_number() OVER (PARTITION BY o_orderpriority, date_trunc('day', o_orderdate) ORDER BY o_orderkey) AS rn FROM orders)
    SELECT symbol, {ts()}, {rds('close')}, {rd('close', 'open')} FROM k WHERE rn = 1""",
)
def _(spark, sf):
    raw = A.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Datetime"),
        F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("Close"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_totalprice").cast("string")).alias("Open"),
        "o_orderpriority",
        "o_orderkey",
    )
    out = Z.normalize_ohlcv(raw, F.col("o_orderpriority"), order=["o_orderkey"])
    return tidy(out.select("symbol", "ts", "close", "open"))


@query(
    "s07_nested_news",
    f"""SELECT text AS title, 'doc/' || doc_id AS url, lang AS source, '' AS summary,
      {ts("CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '1970-01-01' ELSE TIMESTAMP '2023-11-14 22:13:20' + to_seconds(doc_id * 60) END", 'published_at')}
    FROM documents""",
)
def _(spark, sf):
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct(
        F.col("text").alias("title"),
        F.when(F.col("doc_id") % 7 == 0, "soon").otherwise(stamp).alias("pubDate"),
        F.struct(F.concat(F.lit("doc/"), "doc_id").alias("url")).alias("canonicalUrl"),
        F.struct(F.col("lang").alias("displayName")).alias("provider"),
    )
    raw = A.table(spark, sf, "documents").select(F.to_json(F.struct(item.alias("content"))).alias("json"))
    return tidy(Z.flatten_nested_news(raw))


@query(
    "s08_flat_feed",
    """SELECT CASE WHEN role = 'user' THEN text ELSE role END AS title, text AS summary, 'feed' AS source,
      'c/' || conv_id AS url, strftime(TIMESTAMP '2023-11-14 22:13:20' + to_seconds(turn * 3600), '%Y-%m-%dT%H:%M:%SZ') AS published_at
    FROM conversations""",
)
def _(spark, sf):
    raw = A.table(spark, sf, "conversations").select(
        F.to_json(
            F.struct(
                (F.lit(1_700_000_000) + F.col("turn") * 3600).alias("datetime"),
                F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("headline"),
                F.col("role").alias("title"),
                F.concat(F.lit("c/"), "conv_id").alias("url"),
                F.col("text").alias("summary"),
            )
        ).alias("json")
    )
    return tidy(Z.flatten_feed(raw))


@query(
    "s09_normalize_articles",
    """WITH k AS (SELECT url, html, page_id, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM pages)
    SELECT page_id, url, html AS title, NULL::VARCHAR AS seendate, NULL::VARCHAR AS domain, NULL::VARCHAR AS language,
      NULL::VARCHAR AS sourcecountry, 'BTC' AS asset, 'bitcoin' AS query FROM k WHERE rn = 1""",
)
def _(spark, sf):
    raw = A.table(spark, sf, "pages").select("page_id", F.col("url").alias("URL"), F.col("html").alias("Title"))
    return Z.normalize_articles(raw, "btc", "bitcoin", order=["page_id"])


@query(
    "p04_keyword_filter",
    "SELECT doc_id, "
    + ", ".join(
        "(" + " OR ".join(f"contains(lower(text), '{k}')" for k in ks) + f") AS {a.lower()}" for a, ks in TX.KEYWORDS.items()
    )
    + " FROM documents WHERE "
    + " OR ".join(f"contains(lower(text), '{k}')" for ks in TX.KEYWORDS.values() for k in ks),
)
def _(spark, sf):
    d = A.table(spark, sf, "documents").select(
        "doc_id", *[TX.mentions(F.col("text"), ks).alias(a.lower()) for a, ks in TX.KEYWORDS.items()]
    )
    return d.filter(F.col("btc") | F.col("eth") | F.col("gold") | F.col("oil"))


def _phrase_sql():
    parts = []
    for a, ps in PHRASES.items():
        case = " ".join(f"WHEN contains(lower(text), '{p}') THEN {i}" for i, p in enumerate(ps))
        parts.append(f"SELECT source || '/' || lang AS url, '{a}' AS asset, CASE {case} END AS i FROM documents")
    names = " ".join(f"WHEN asset = '{a}' AND i = {i} THEN '{p}'" for a, ps in PHRASES.items() for i, p in enumerate(ps))
    return (
        f"WITH h AS ({' UNION ALL '.join(parts)}), g AS (SELECT url, asset, min(i) AS i FROM h WHERE i IS NOT NULL GROUP BY 1, 2) "
        f"SELECT url, asset, CASE {names} END AS query FROM g"
    )


@query("p05_phrase_tags", _phrase_sql())
def _(spark, sf):
    d = A.table(spark, sf, "documents").withColumn("url", F.concat_ws("/", "source", "lang"))
    return N.tag_by_phrase(d, PHRASES, text="text")


@query(
    "p06_tag_membership",
    "SELECT asset_lang, count(*) AS n FROM (SELECT lang AS asset_lang, source FROM documents) WHERE upper(source) = 'SRC7' OR upper(asset_lang) = 'FR' GROUP BY 1",
)
def _(spark, sf):
    d = A.table(spark, sf, "documents").withColumn("tags", F.array("lang", "source"))
    hit = d.filter(TX.tagged(F.col("tags"), "Src7") | TX.tagged(F.col("tags"), "FR"))
    return hit.groupBy(F.col("lang").alias("asset_lang")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p07_usable_records",
    with_(ARTICLES) + "SELECT event_id FROM a WHERE confidence >= 0.1::DOUBLE AND label <> 'neutral'",
)
def _(spark, sf):
    a = A.articles(spark, sf).select(
        "event_id",
        F.when(F.col("confidence") >= 0.1, F.col("url")).otherwise("").alias("url"),
        F.when(F.col("label") != "neutral", F.col("timestamp_utc")).alias("published_at"),
    )
    return Z.usable(a).select("event_id")


@query(
    "p26_text_choice",
    """SELECT item, CASE WHEN length(trim(body)) > length(title) THEN trim(body) ELSE title END AS text_for_sentiment FROM (
      SELECT d.doc_id AS item, coalesce(d.text, '') AS body, coalesce(c.text, '') AS title
      FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = 0)""",
)
def _(spark, sf):
    d = A.table(spark, sf, "documents")
    c = A.table(spark, sf, "conversations").filter("turn = 0").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("title"))
    return d.join(c, "doc_id", "left").select(
        F.col("doc_id").alias("item"), TX.text_for_sentiment(F.col("title"), F.col("text")).alias("text_for_sentiment")
    )


@query("p27_truncate", "SELECT doc_id, substring(text, 1, 512) AS text FROM documents")
def _(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", TX.truncate(F.col("text")).alias("text"))


@query(
    "f01_lexicon_score",
    f"""WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z]+') AS t FROM documents),
    s AS (SELECT doc_id, len(list_filter(t, lambda x: list_contains({_in(POS)}, x))) AS p, len(list_filter(t, lambda x: list_contains({_in(NEG)}, x))) AS n FROM w)
    SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS label, sign(p - n)::INT AS score,
      {rd('CASE WHEN p + n = 0 THEN 0 ELSE abs(p - n)::DOUBLE / (p + n) END', 'confidence')} FROM s""",
)
def _(spark, sf):
    d = A.table(spark, sf, "documents")
    return tidy(N.score(d, text="text", positive=POS, negative=NEG).select("doc_id", "label", "score", "confidence"))


def vowel_scorer():
    """A stand-in model for the batch scorer: compares two letters' counts."""
    def run(texts):
        return [
            (("positive" if t.count("a") > t.count("e") else "negative"), abs(t.count("a") - t.count("e")) / len(t))
            for t in texts
        ]

    return run


@query(
    "f01_batch_score",
    f"""WITH c AS (SELECT doc_id, text, length(text) - length(replace(text, 'a', '')) AS a, length(text) - length(replace(text, 'e', '')) AS e FROM documents)
    SELECT doc_id, CASE WHEN trim(text) = '' THEN 'neutral' WHEN a > e THEN 'positive' ELSE 'negative' END AS label,
      CASE WHEN trim(text) = '' THEN 0 WHEN a > e THEN 1 ELSE -1 END AS score,
      {rd("CASE WHEN trim(text) = '' THEN 0 ELSE abs(a - e)::DOUBLE / length(text) END", 'confidence')} FROM c""",
)
def _(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "text")
    return tidy(N.score_with(d, vowel_scorer, text="text").select("doc_id", "label", "score", "confidence"))


S = X.SENTIMENT
HOURLY = """h AS (SELECT asset, date_trunc('hour', timestamp_utc) AS ts, avg(sentiment_score) AS sentiment_mean,
  coalesce(stddev_samp(sentiment_score), 0) AS sentiment_std, count(url)::DOUBLE AS news_volume,
  avg((sentiment_score = 1)::INT) AS positive_ratio, avg((sentiment_score = -1)::INT) AS negative_ratio,
  avg(confidence) AS avg_confidence FROM a GROUP BY 1, 2)"""
# scores that differ within an asset and URLs that may be missing
VARIED = """a AS (SELECT * REPLACE (CASE WHEN confidence > 0.6 THEN 1 WHEN confidence < 0.3 THEN -1 ELSE 0 END AS sentiment_score,
  CASE WHEN confidence >= 0.05 THEN url END AS url) FROM a0)"""
ART0 = ARTICLES.replace("a AS (", "a0 AS (", 1)


def _varied(spark, sf):
    c = F.col("confidence")
    return A.articles(spark, sf).withColumns(
        {
            "sentiment_score": F.when(c > 0.6, 1).when(c < 0.3, -1).otherwise(0),
            "url": F.when(c >= 0.05, F.col("url")),
        }
    )


@query("a01_hourly_sentiment", with_(ART0, VARIED, HOURLY) + f"SELECT asset, {ts()}, {rds(*S)} FROM h")
def _(spark, sf):
    return tidy(N.hourly(_varied(spark, sf)))


@query(
    "w19_leakage_shift",
    with_(ART0, VARIED, HOURLY)
    + f"SELECT asset, {ts()}, {', '.join(rd(f'coalesce(lag({c}) OVER ({WA}), 0)', c) for c in S)} FROM h",
)
def _(spark, sf):
    return tidy(N.shift(N.hourly(_varied(spark, sf))))


@query(
    "w19_calendar_shift",
    with_(ART0, VARIED, HOURLY)
    + f"SELECT asset, {ts('ts + INTERVAL 1 HOUR', 'ts')}, {', '.join(rd(f'coalesce({c}, 0)', c) for c in S)} FROM h",
)
def _(spark, sf):
    return tidy(N.shift(N.hourly(_varied(spark, sf)), mode="calendar"))


SHIFTED = f"hs AS (SELECT asset, ts, {', '.join(f'coalesce(lag({c}) OVER ({WA}), 0) AS {c}' for c in S)} FROM h)"
# All articles, moved back in time so that hours, or whole days, have none.
STRONG = "a AS (SELECT * REPLACE (timestamp_utc - to_hours((hour(timestamp_utc) % 3)::INT) AS timestamp_utc) FROM a0)"
RARE = """a AS (SELECT * REPLACE (timestamp_utc - to_days((date_diff('day', DATE '1970-01-01', timestamp_utc::DATE) % 4)::INT)
  AS timestamp_utc) FROM a0)"""


def _moved(articles, seconds):
    return articles.withColumn("timestamp_utc", F.timestamp_micros(F.unix_micros("timestamp_utc") - F.lit(1_000_000).cast("long") * seconds))


def _strong(spark, sf):
    return _moved(A.articles(spark, sf), F.hour("timestamp_utc") % 3 * 3600)


def _rare(spark, sf):
    return _moved(A.articles(spark, sf), F.unix_date(F.to_date("timestamp_utc")).cast("long") % 4 * 86_400)


@query(
    "j04_sentiment_join",
    with_(BARS_H, ART0, STRONG, HOURLY, SHIFTED)
    + f"SELECT b.asset, {ts('b.ts')}, {', '.join(rd(f'coalesce(hs.{c}, 0)', c) for c in S)} FROM b LEFT JOIN hs ON hs.asset = b.asset AND hs.ts = b.ts",
)
def _(spark, sf):
    bars = A.bars_hourly(spark, sf).select("asset", "ts")
    return tidy(X.join_sentiment(bars, N.shift(N.hourly(_strong(spark, sf)))))


@query(
    "j04_filled_cells",
    with_(BARS_H, ART0, STRONG, HOURLY)
    + f"SELECT b.asset, {', '.join(f'count(*) - count(h.{c}) AS {c}' for c in S[:3])} FROM b LEFT JOIN h ON h.asset = b.asset AND h.ts = b.ts GROUP BY 1",
)
def _(spark, sf):
    return X.filled_cells(A.bars_hourly(spark, sf), N.hourly(_strong(spark, sf)), S[:3])


@query(
    "j07_forward_align",
    with_(BARS_H, ARTICLES)
    + f"SELECT a.event_id, a.asset, {ts('b.ts', 'bar_ts')} FROM a ASOF JOIN b ON a.asset = b.asset AND a.timestamp_utc <= b.ts",
)
def _(spark, sf):
    out = N.align_to_bars(A.articles(spark, sf), A.bars_hourly(spark, sf))
    return tidy(out.select("event_id", "asset", "bar_ts"))


@query(
    "j08_last_bars",
    with_(BARS_H)
    + f"SELECT asset, {ts()}, array_to_string(list(printf('%.2f', close)) {frame(4)}, '|') AS closes FROM b",
)
def _(spark, sf):
    out = N.last_bars(A.bars_hourly(spark, sf), ["close"])
    text = F.transform("last_bars", lambda x: F.format_string("%.2f", x["close"]))
    return tidy(out.select("asset", "ts", F.array_join(text, "|").alias("closes")))


@query(
    "j08_last_headlines",
    with_(
        BARS_H,
        ART0,
        STRONG,
        "l AS (SELECT asset, timestamp_utc, list(url) OVER (PARTITION BY asset ORDER BY timestamp_utc, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS urls FROM a)",
    )
    + f"SELECT b.asset, {ts('b.ts')}, coalesce(array_to_string(l.urls, '|'), '') AS headlines FROM b ASOF LEFT JOIN l ON b.asset = l.asset AND b.ts >= l.timestamp_utc",
)
def _(spark, sf):
    out = N.last_headlines(A.bars_hourly(spark, sf), _strong(spark, sf).withColumn("title", F.col("url")))
    return tidy(out.withColumn("headlines", F.array_join("headlines", "|")))


PRESENCE = f"""n AS (SELECT a.asset, b.ts, count(*) AS c FROM a ASOF JOIN b ON a.asset = b.asset AND a.timestamp_utc <= b.ts GROUP BY 1, 2),
p0 AS (SELECT b.asset, b.ts, b.close, coalesce(n.c, 0) AS n_articles FROM b LEFT JOIN n ON n.asset = b.asset AND n.ts = b.ts),
p1 AS (SELECT *, sum(n_articles) {frame(23)} > 0 AS has_news FROM p0),
p AS (SELECT *, has_news AND (sum(has_news::INT) OVER ({WA} ROWS UNBOUNDED PRECEDING) - 1) % 4 = 0 AS sampled FROM p1)"""


def _windows(spark, sf):
    return N.news_windows(A.bars_hourly(spark, sf), _rare(spark, sf))


@query("w13_news_presence", with_(BARS_H, ART0, RARE, PRESENCE) + f"SELECT asset, {ts()}, n_articles, has_news FROM p")
def _(spark, sf):
    return tidy(_windows(spark, sf).select("asset", "ts", "n_articles", "has_news"))


@query("w14_every_nth", with_(BARS_H, ART0, RARE, PRESENCE) + f"SELECT asset, {ts()}, sampled FROM p")
def _(spark, sf):
    return tidy(_windows(spark, sf).select("asset", "ts", "sampled"))


@query(
    "w15_news_carry",
    with_(BARS_H, ART0, RARE, PRESENCE)
    + f"""SELECT asset, {ts()}, {rd(f'CASE WHEN has_news THEN coalesce(last_value(CASE WHEN sampled THEN close / 1000 END IGNORE NULLS) OVER ({WA} ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END', 'alpha_1')} FROM p""",
)
def _(spark, sf):
    flags = _windows(spark, sf)
    signals = flags.filter("sampled").select("asset", "ts", (F.col("close") / 1000).alias("alpha_1"))
    return tidy(N.carry_signals(flags, signals, ["alpha_1"]).select("asset", "ts", "alpha_1"))


@query(
    "x_alpha_json",
    f"""SELECT event_id, {rd("CASE WHEN value > 95 THEN 0 ELSE greatest(least(value / 50 - 1, 1), -1) END", 'alpha_1')},
      {rd("CASE WHEN value > 95 THEN 0 ELSE least(json_extract(props, '$.k')::DOUBLE, 1) END", 'alpha_2')}, 0.0::DOUBLE AS alpha_3 FROM events""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events")
    body = F.concat(
        F.lit('{"alpha_1": '), (F.col("value") / 50 - 1).cast("string"), F.lit(', "alpha_2": '),
        F.from_json("props", "k string")["k"],
        F.when(F.col("value") > 95, F.lit(', "alpha_4": "high"}')).otherwise("}"),
    )
    reply = F.when(F.col("event_type") == "view", body).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    out = e.select("event_id", TX.parse_alphas(reply).alias("s")).select("event_id", "s.alpha_1", "s.alpha_2", "s.alpha_3")
    return tidy(out)


def _bins(step, agg):
    return f"""g AS (SELECT asset, time_bucket(INTERVAL {step}, timestamp_utc) AS ts, {agg} FROM a GROUP BY 1, 2),
sp AS (SELECT asset, unnest(generate_series(min(ts), max(ts), INTERVAL {step})) AS ts FROM g GROUP BY 1)"""


for _name, _step, _sql in (("a20_sentiment_1h", "1 hour", "1 HOUR"), ("a20_sentiment_6h", "6 hours", "6 HOUR")):

    def _mean(spark, sf, step=_step):
        return tidy(N.bucket_mean(_strong(spark, sf).withColumn("sentiment_score", F.col("confidence")), step))

    query(
        _name,
        with_(ART0, STRONG, _bins(_sql, "avg(confidence) AS mean"))
        + f"SELECT sp.asset, {ts('sp.ts')}, {rds('mean')} FROM sp LEFT JOIN g ON g.asset = sp.asset AND g.ts = sp.ts",
    )(_mean)


@query(
    "a21_news_volume_6h",
    with_(ART0, RARE, _bins("6 HOUR", "count(*) AS n"))
    + f"SELECT sp.asset, {ts('sp.ts')}, coalesce(n, 0) AS n FROM sp LEFT JOIN g ON g.asset = sp.asset AND g.ts = sp.ts",
)
def _(spark, sf):
    return tidy(N.bucket_counts(_rare(spark, sf)))


@query(
    "a22_label_ratios_6h",
    with_(
        "a AS (SELECT lang AS asset, TIMESTAMP '2024-01-01' + to_seconds(n_chars * 600) AS timestamp_utc, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label FROM documents JOIN labels USING (doc_id))",
        _bins("6 HOUR", "avg((label = 'positive')::INT) AS p, avg((label = 'negative')::INT) AS n"),
    )
    + f"SELECT sp.asset, {ts('sp.ts')}, {rd('p', 'positive')}, {rd('n', 'negative')}, {rd('1 - p - n', 'neutral')} FROM sp LEFT JOIN g ON g.asset = sp.asset AND g.ts = sp.ts",
)
def _(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(A.table(spark, sf, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    a = d.select(
        F.col("lang").alias("asset"),
        F.timestamp_seconds(F.unix_timestamp(start) + F.col("n_chars") * 600).alias("timestamp_utc"),
        label.alias("label"),
    )
    return tidy(N.label_ratios(a))


TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "a23_daily_heatmap",
    with_(ART0, RARE)
    + f"SELECT {ts('day', 'day')}, "
    + ", ".join(rd(f"coalesce(avg(confidence) FILTER (asset = '{t}'), 0)", t) for t in TYPES)
    + " FROM (SELECT *, date_trunc('day', timestamp_utc)::TIMESTAMP AS day FROM a) GROUP BY day",
)
def _(spark, sf):
    a = _rare(spark, sf).withColumn("sentiment_score", F.col("confidence"))
    return tidy(N.daily_sentiment(a, TYPES))


@query(
    "a24_top_domains",
    with_(ARTICLES) + "SELECT domain AS value, count(*) AS n FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
)
def _(spark, sf):
    return R.value_counts(A.articles(spark, sf), "domain", 15)


@query("a24_countries", with_(ARTICLES) + "SELECT sourcecountry AS value, count(*) AS n FROM a GROUP BY 1")
def _(spark, sf):
    return R.value_counts(A.articles(spark, sf), "sourcecountry")


@query(
    "a29_coverage",
    with_(ARTICLES)
    + "SELECT asset, count(*) AS total, count(sentiment_score) AS with_sentiment, count(DISTINCT domain) AS domains, count(DISTINCT sourcecountry) AS countries FROM a GROUP BY 1",
)
def _(spark, sf):
    return N.coverage(A.articles(spark, sf))


@query(
    "a29_coverage_sketch",
    with_(ARTICLES)
    + "SELECT asset, count(*) AS total, count(sentiment_score) AS with_sentiment, count(DISTINCT domain) AS domain_estimate, count(DISTINCT sourcecountry) AS sourcecountry_estimate FROM a GROUP BY 1",
)
def _(spark, sf):
    return N.coverage_estimate(N.coverage_sketches(A.articles(spark, sf)))


@query(
    "a30_daily_counts",
    with_(ARTICLES)
    + f"SELECT asset, {ts('day', 'day')}, count(*) AS articles FROM (SELECT asset, date_trunc('day', timestamp_utc)::TIMESTAMP AS day FROM a) GROUP BY asset, day",
)
def _(spark, sf):
    return tidy(N.daily_counts(A.articles(spark, sf)))


@query(
    "s09_feed_times",
    "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN strftime(date_trunc('second', ts) + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') END AS seen, "
    "strftime(ts + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS stored FROM events",
)
def _(spark, sf):
    e = A.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 7 != 0, F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")).otherwise("20261301T99")
    e = e.withColumn("seen", TX.published(raw, latency="5 minutes"))
    return tidy(e.withColumn("stored", TX.published(None, F.col("ts"), "5 minutes")).select("event_id", "seen", "stored"))


@query(
    "s16_wide_sentiment",
    with_(ART0, VARIED, HOURLY)
    + f"SELECT {ts('ts', 'timestamp_utc')}, {', '.join(rd(c, f'view_gdelt_{c}') for c in S)} FROM h WHERE asset = 'view'",
)
def _(spark, sf):
    return tidy(N.to_wide(N.hourly(_varied(spark, sf)), "view"))
