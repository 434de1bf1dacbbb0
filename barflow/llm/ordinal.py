"""Quality classifier: cumulative-link regression on ordered grades over hashed words."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow import session
from barflow.llm import text as T

# Grades in order: toxic, poor, good.
GRADES = 3
BUCKETS = 1 << 17
# Labelled rows a model is fitted on at most, but for chance: rows are drawn by a hash of their id.
MOST_ROWS = 20_000
_TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]+"


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null without a quality label."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality.isNotNull(), 2)


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id, grade: the lowest of a document's labels."""
    own = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(grade(F.col("quality"), F.col("toxic"))).alias("grade"))
    return own.filter("grade is not null")


def hashed(df: DataFrame, text: Column) -> DataFrame:
    """`df` with buckets: those of the text's words and runs of signs, each once, and of two shapes, the share of words in
    capitals and of words equal to the one before, in tenths. Null text has the shapes of an empty one."""
    df = df.withColumn("_tokens", T.words(T.filled(text), _TOKEN)).withColumn("_low", F.transform("_tokens", F.lower))
    size = F.greatest(F.size("_tokens"), F.lit(1))
    loud = F.size(F.filter("_tokens", lambda t: (F.length(t) > 1) & (F.upper(t) == t) & (F.lower(t) != t)))
    echo = F.size(F.filter("_low", lambda t, i: t == F.get(F.col("_low"), i - 1)))
    shapes = F.array(*(F.concat(F.lit(f"{name}="), F.ceil(10 * n / size).cast("string")) for name, n in (("caps", loud), ("echo", echo))))
    every = F.concat(F.array_distinct("_low"), F.transform(shapes, lambda x: F.concat(F.lit(" "), x)))
    bucket = F.transform(every, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("string"))
    return df.withColumn("buckets", F.array_distinct(bucket)).drop("_tokens", "_low")


def _with_thresholds(df: DataFrame, marks: list[Column]) -> DataFrame:
    marked = df.withColumn("_above", array_to_vector(F.array(*(m.cast("double") for m in marks))))
    return VectorAssembler(inputCols=["words", "_above"], outputCol="features").transform(marked).drop("_above")


@dataclass
class Ordinal:
    """P(grade > k) = logistic(score + thresholds[k]), one score for all k; thresholds fall as k rises."""

    model: LogisticRegressionModel | None
    thresholds: list[float]
    buckets: CountVectorizerModel | None = None

    def rate(self, df: DataFrame, text: Column) -> DataFrame:
        """`df` with above (P(grade > k) for each k), expected (grade) and score. Without a model score is 0 and all grades
        are equally likely."""
        if self.model is None:
            rated = df.withColumn("score", F.lit(0.0))
        else:
            words = self.buckets.transform(hashed(df, text))
            scored = self.model.transform(_with_thresholds(words, [F.lit(0.0)] * (GRADES - 1)))
            rated = scored.withColumn("score", vector_to_array("rawPrediction")[1]).select(*df.columns, "score")
        above = F.array(*(1 / (1 + F.exp(-(F.col("score") + t))) for t in self.thresholds))
        rated = rated.withColumn("above", above)
        return rated.withColumn("expected", reduce(lambda a, b: a + b, (F.col("above")[k] for k in range(GRADES - 1))))


def telling(sample: DataFrame, least_rows: int = 8, least_z: float = 4.0) -> list[str]:
    """Buckets in at least `least_rows` rows whose share of rows above some threshold is off by `least_z` deviations."""
    above = [F.avg((F.col("grade") > k).cast("double")).alias(f"p{k}") for k in range(GRADES - 1)]
    share = sample.agg(*above).first()
    counts = sample.select("grade", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("n"), *(F.sum((F.col("grade") > k).cast("int")).alias(f"n{k}") for k in range(GRADES - 1))
    )
    off = [
        F.abs(F.col(f"n{k}") - F.col("n") * p) >= least_z * F.sqrt(F.col("n") * p * (1 - p))
        for k in range(GRADES - 1) for p in [share[k]] if 0 < p < 1
    ]
    found = counts.filter((F.col("n") >= least_rows) & reduce(lambda a, b: a | b, off))
    return sorted(r.bucket for r in found.select("bucket").collect())


def fit(rows: DataFrame, most_rows: int = MOST_ROWS, penalty: float = 1e-4, steps: int = 50) -> Ordinal:
    """From rows of (doc_id, text, grade), of which at most about `most_rows` are taken.

    Words are hashed to BUCKETS buckets, of which those that tell grades apart are used. Each row stands once for each
    threshold k, as the question whether its grade is above k, with a mark for k beside its words. One logistic regression
    without intercept over these rows has a weight for each bucket, shared by all thresholds, and one for each mark, the
    threshold; since fewer rows are above a higher k, the thresholds come out in order. Spark sums the gradients over tasks.
    Without two different grades, or words that tell them apart, nothing is fitted.
    """
    counts = {r.grade: r.n for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect() if r.grade is not None}
    total = sum(counts.values())
    nothing = Ordinal(None, [0.6931, -0.6931])
    if len(counts) < 2:
        return nothing
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most_rows / total)))
    sample = session.settle(hashed(drawn, F.col("text")).select("buckets", "grade"), "graded")
    vocabulary = telling(sample)
    if not vocabulary:
        return nothing
    buckets = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="buckets", outputCol="words")
    asked = buckets.transform(sample).withColumn("k", F.explode(F.array(*map(F.lit, range(GRADES - 1)))))
    asked = _with_thresholds(asked, [F.col("k") == k for k in range(GRADES - 1)])
    asked = session.settle(asked.select("features", (F.col("grade") > F.col("k")).cast("double").alias("label")), "asked")
    fitted = LogisticRegression(
        maxIter=steps, regParam=penalty, fitIntercept=False, standardization=False, family="binomial"
    ).fit(asked.coalesce(max(2, rows.sparkSession.sparkContext.defaultParallelism)))
    marks = fitted.coefficients.toArray()[-(GRADES - 1) :]
    return Ordinal(fitted, sorted((float(m) for m in marks), reverse=True), buckets)


def select(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, score, p_above_0, p_above_1, expected, kept; one row per row of `docs`.

    Kept are rows whose probability of the top grade is `least` or more. Only documents with a rating are learned from, but
    all are rated, by their whole texts. Null and empty texts have no words, so the thresholds alone rate them; ties have
    equal results; null ids are rated but not learned from. An empty table gives no rows.
    """
    known = ratings(labels).withColumnRenamed("doc_id", "_id")
    graded = docs.select("doc_id", "text").join(known.hint("merge"), F.col("doc_id") == F.col("_id"))
    model = fit(graded.select("doc_id", "text", "grade"))
    rated = model.rate(docs.select("doc_id", "text"), F.col("text"))
    return rated.select(
        "doc_id", "score", F.col("above")[0].alias("p_above_0"), F.col("above")[1].alias("p_above_1"), "expected",
        (F.col("above")[GRADES - 2] >= least).alias("kept"),
    )
