"""Quality rules: base limits, and a decision list learned from labelled statistics by sequential covering."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow import session
from barflow.llm import text as T

# Fixed values of the contract.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW, SYMBOLS = 10, 20, 5, "[#*$%&|<>]"

# None of these drifts with the length of a clean text.
FEATURES = (
    "mean_word", "symbol_share", "mark_share", "upper_share", "digit_share", "echo_share", "repeat_share", "dup_line_share",
)
QUANTILES = (0.005, 0.01, 0.02, *(k / 20 for k in range(1, 20)), 0.98, 0.99, 0.995)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.feature) > self.limit if self.above else F.col(self.feature) <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule))


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the first rule that holds names the reason, else null."""
    branches = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        branches = branches.when(_holds(rule), F.lit(" and ".join(map(str, rule))))
    return branches.otherwise(F.lit(None).cast("string"))


def window_keys(hashes: str, width: int) -> Column:
    """A hash of each run of `width` words, in order; `hashes` names a column of word hashes."""
    last = F.size(hashes) - width
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(F.col(hashes), i + k) for k in range(width))))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(keys: str, order: str) -> Column:
    """Words inside windows that come twice or more; `order` names the sorted (key, position) of all windows."""
    at = F.col(order)
    twice = F.filter(
        at, lambda x, j: (x["k"] == F.get(at, j - 1)["k"]) | (x["k"] == F.get(at, j + 1)["k"])
    )
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
    return F.aggregate(starts, none, step, lambda acc: acc["n"].cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """`doc` and its counts and FEATURES as columns. Null text counts as empty, and all shares of empty text are 0.

    Windows are compared by 64-bit hashes. All of it is array and regular-expression functions, so cost grows with the
    text's length (times its logarithm where windows repeat), and only the columns asked for are computed.
    """
    df = docs.select(T.packed(docs), T.filled("text").alias("_t"))
    df = df.withColumn("_w", T.words(F.col("_t"))).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(T.SPACED_WORD)))
    df = df.withColumn("_k", window_keys("_h", WINDOW))
    df = df.withColumn(
        "_p",
        F.when(
            F.size(F.array_distinct("_k")) < F.size("_k"),
            F.sort_array(F.transform("_k", lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
        ),
    )
    df = df.select(
        "doc",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_p").isNotNull(), _repeated_words("_k", "_p")).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_l").alias("_lines"),
        F.size(F.filter("_h", lambda w, i: w == F.get(F.col("_h"), i - 1))).alias("_echoes"),
        F.regexp_count("_t", F.lit("[!?]")).alias("_marks"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).alias("_upper"),
        F.regexp_count("_t", F.lit(r"\p{Nd}")).alias("_digits"),
    )

    def share(part: str, of: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(of)), F.lit(0.0)).alias

    return df.select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words")("mean_word"),
        share("n_symbols", "word_chars")("symbol_share"),
        share("_marks", "n_words")("mark_share"),
        share("_upper", "word_chars")("upper_share"),
        share("_digits", "word_chars")("digit_share"),
        share("_echoes", "n_words")("echo_share"),
        share("n_repeat_words", "n_words")("repeat_share"),
        share("n_dup_lines", "_lines")("dup_line_share"),
    )


def base_failed() -> Column:
    repeats = 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    return (F.col("n_words") < LEAST_WORDS) | repeats


def learn(
    rows: DataFrame, most_rules: int = 8, most_conditions: int = 4, precision: float = 0.97, support: int = 5
) -> list[Rule]:
    """Ordered rules that reject, from rows with FEATURES and `bad` (1 or 0; null rows don't count).

    Two thirds of the rows, by a hash of their statistics, grow a rule: the condition with the largest information gain
    over all features and limits is added until none gains. The other third prunes it: the shortest-best start of the rule
    by (hits - errors) / (hits + errors) stays, and the list ends at a rule whose hits there are too few or whose precision
    is too low. Covered rows leave before the next rule. Limits lie halfway between
    quantiles over all rows. Every step is one aggregation
    over all labelled rows whose result has a row for each feature and limit, whatever the size of the input.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col("bad").isNotNull()).select(*FEATURES, F.col("bad").cast("int"))
    rows = session.settle(rows.withColumn("grow", F.pmod(F.xxhash64(*FEATURES), F.lit(3)) > 0), "labelled")
    found = rows.agg(*(F.percentile_approx(f, list(QUANTILES), 1000).alias(f) for f in FEATURES)).first()
    if found[FEATURES[0]] is None:
        return []
    steps = {f: sorted(set(found[f])) for f in FEATURES}
    limits = {f: [(a + b) / 2 for a, b in zip(steps[f], steps[f][1:])] or steps[f] for f in FEATURES}
    # as bins, so that one grouping by feature and bin has the counts of every condition: bin b holds limit[b-1] < x <= limit[b]
    bins = F.array(*(reduce(lambda a, b: a + b, ((F.col(f) > x).cast("int") for x in limits[f])) for f in FEATURES))
    rows = session.settle(rows.withColumn("bins", bins).coalesce(max(2, spark.sparkContext.defaultParallelism)), "binned")

    def counts(df: DataFrame) -> dict[str, list[list[int]]]:
        table = {f: [[0, 0] for _ in range(len(limits[f]) + 1)] for f in FEATURES}
        binned = df.select("bad", F.posexplode("bins").alias("f", "b"))
        for r in binned.groupBy("f", "b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect():
            table[FEATURES[r.f]][r.b] = [r.p, r.n]
        return table

    def best(table: dict[str, list[list[int]]]) -> Condition | None:
        total = [sum(x[i] for x in table[FEATURES[0]]) for i in (0, 1)]
        if not total[0] or not total[1]:
            return None
        old, top, gain = math.log2(total[0] / sum(total)), None, 1e-9
        for f in FEATURES:
            p = n = 0
            for b, limit in enumerate(limits[f]):
                p, n = p + table[f][b][0], n + table[f][b][1]
                for above, hits, errors in ((False, p, n), (True, total[0] - p, total[1] - n)):
                    if hits >= support and (got := hits * (math.log2(hits / (hits + errors)) - old)) > gain:
                        top, gain = Condition(f, above, float(limit)), got
        return top

    rules: list[Rule] = []
    left = rows
    while len(rules) < most_rules:
        rule: Rule = ()
        while len(rule) < most_conditions:
            inside = left.filter("grow")
            if (more := best(counts(inside.filter(_holds(rule)) if rule else inside))) is None:
                break
            rule = (*rule, more)
        if not rule:
            break
        starts = [rule[: k + 1] for k in range(len(rule))]
        seen = left.filter("not grow").agg(
            *(F.coalesce(F.sum(F.when(_holds(r), x)), F.lit(0)) for r in starts for x in (F.col("bad"), 1 - F.col("bad")))
        ).first()
        scored = [(seen[2 * k], seen[2 * k + 1], r) for k, r in enumerate(starts) if seen[2 * k] + seen[2 * k + 1]]
        if not scored:
            break
        hits, errors, rule = max(scored, key=lambda x: ((x[0] - x[1]) / (x[0] + x[1]), x[0]))
        if hits < support or hits < precision * (hits + errors):
            break
        rules.append(rule)
        left = left.filter(~_holds(rule))
    return rules


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the labelled documents within the base limits; `bad` is 1 where quality is 0, in any of its labels."""
    bad = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    return stats.join(bad.withColumnRenamed("doc_id", "_id").hint("merge"), F.col("doc_id") == F.col("_id")).filter(~base_failed()).drop("_id")


def _flat(stats: DataFrame) -> DataFrame:
    return stats.select(F.col("doc.doc_id").alias("doc_id"), *(c for c in stats.columns if c != "doc"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, reason (of the learned list, else null), kept; one row per row of `docs`.

    Without labels, or with labels of one class, no rule is learned and the base limits decide. Null ids are judged but
    not learned from. An empty table gives no rows.
    """
    stats = session.settle(_flat(statistics(docs)), "statistics")
    rules = learn(labelled(stats, labels))
    return (
        stats.withColumn("base_failed", base_failed())
        .withColumn("reason", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("reason").isNull())
    )


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept. Statistics are taken again while filtering, which moves no text.

    Spark would write the statistics' formulas out in the filter's condition, each as often as it is used, which is beyond
    compiling; it leaves a filter alone above a column that depends on the task.
    """
    stats = _flat(statistics(docs)).select("doc_id", "n_words", "n_repeat_words", *FEATURES)
    rules = learn(labelled(session.settle(stats, "statistics"), labels))
    taken = statistics(docs).withColumn("task", F.spark_partition_id())
    kept = taken.filter((F.col("task") >= 0) & ~base_failed() & verdict(rules).isNull())
    return T.unpacked(kept, docs.columns)
