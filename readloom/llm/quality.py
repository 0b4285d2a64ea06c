"""Quality rules and a hashed n-gram log-likelihood ratio, with DataFrame operations only.

Words and word pairs of every text are hashed to ``n_buckets``. Two smoothed multinomials are estimated over the
buckets: one from trusted texts, one from the raw corpus. A text's score is the mean over its n-grams of
``ln(p_trusted / p_raw)``; every text with a score of at least ``threshold`` passes, the others do not.
Counts of the raw corpus cover all rows. Trusted texts are all those named by a table of labels but for one fold. Up to
``SENT`` ids of them go to all tasks; more are joined by a shuffle of the texts.

The threshold is read off all labelled rows of the table at hand that are not trusted: one of ``HELD_FOLDS`` folds of
the good ones, and the rows of quality 0. Their scores are counted in steps of 1 / STEPS, and the threshold is the one
with the largest sum of shares of good rows kept and bad rows dropped. Rows that fail the base rules are not counted.
Scores are written before the threshold is known, so each text is scored once and only scores meet the labels.

Rules: null text has no words; a text without words has score 0 and fails the base rules; ids of null are never
trusted. An id is good if all its labels are (quality 1, not toxic; without a quality it is not), and bad if one has
quality 0, so contradictory labels make it bad. A repeated window is found by a 64-bit hash of its five words. Only
the id column is carried along. The result is written, so a filter on ``kept`` computes nothing anew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import SPACES, WORD, discard, materialise, spread

N_BUCKETS = 1 << 14
#: So many ids of trusted texts go to all tasks.
SENT = 1_000_000
HELD_FOLDS = 5
STEPS = 1000
#: Where no held-out good row is at hand: a text passes that is at least as likely under trusted texts.
THRESHOLD = 0.0
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def _up_to(n: Column) -> Column:
    """1 .. n, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def with_grams(df: DataFrame, text: Column, n_buckets: int) -> DataFrame:
    """Adds hw, the words' hashes, and grams, the buckets of all words and of all pairs of neighbours."""
    df = df.withColumn("hw", F.transform(_words(text), lambda w: F.xxhash64(w)))
    pair = lambda i: F.pmod(F.xxhash64(F.get("hw", i - 1), F.get("hw", i)), F.lit(n_buckets)).cast("int")
    ones = F.transform("hw", lambda h: F.pmod(h, F.lit(n_buckets)).cast("int"))
    return df.withColumn("grams", F.concat(ones, F.transform(_up_to(F.size("hw") - 1), pair)))


def _fold(key: Column) -> Column:
    """Another hash than the one that orders ids."""
    return F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(HELD_FOLDS))


def _good(labels: DataFrame, id_col: str) -> DataFrame:
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    named = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("t_id")).agg(F.bool_and(good).alias("all_good"))
    return named.filter("all_good").select("t_id")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return _good(labels, id_col).filter(_fold(F.col("t_id")) != 0).withColumn("trusted", F.lit(1))


def held_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """t_id, good: labelled rows that are not trusted, and bad ones."""
    good = _good(labels, id_col).filter(_fold(F.col("t_id")) == 0)
    bad = labels.filter((F.col("quality") == 0) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("t_id")).distinct()
    return good.withColumn("good", F.lit(1)).union(bad.withColumn("good", F.lit(0)))


def fit_ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = N_BUCKETS, alpha: float = 1.0) -> list[float]:
    """ln(p_trusted / p_raw) of each bucket. The driver gets n_buckets rows, whatever the input."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    trusted = F.broadcast(trusted) if trusted.count() <= SENT else trusted
    rows = rows.join(trusted, rows["id"] == trusted["t_id"], "left").select("text", F.coalesce("trusted", F.lit(0)).cast("long").alias("trusted"))
    # explode() would make the optimiser filter on the array's size below the projections, where it is computed anew
    # for each word; explode_outer() does not.
    grams = with_grams(rows, F.col("text"), n_buckets).select(F.explode_outer("grams").alias("bucket"), "trusted")
    counts = grams.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("good"))
    seen = counts.collect()
    n_raw, n_good = (sum(c[x] for c in seen) + alpha * n_buckets for x in ("raw", "good"))
    weights = [0.0] * n_buckets
    for bucket, raw, good in seen:
        weights[bucket] = round(math.log((good + alpha) / n_good) - math.log((raw + alpha) / n_raw), 9)
    return weights


def score_quality(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, window: int = 5) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    rows = rows.withColumn("lines", F.when(F.instr(text, "\n") > 0, lines))
    rows = with_grams(rows, F.col("text"), len(weights)).select(
        "id", "hw", "grams",
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
    )
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to a literal
    total = F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    window_hash = lambda i: F.xxhash64(*[F.get("hw", i + (j - 1)) for j in range(window)])
    rows = rows.select(
        "id", "word_chars", "n_symbols", "n_dup_lines",
        F.size("hw").cast("long").alias("n_words"),
        F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0).alias("score"),
        F.transform(_up_to(F.size("hw") - (window - 1)), window_hash).alias("windows"),
    )
    # Most texts repeat no window; the others sort theirs, so that equal ones are neighbours.
    places = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("places", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), places))
    h = lambda i: F.get("places", i)["h"]
    again = F.filter("places", lambda x, i: F.coalesce(x["h"] == h(i - 1), F.lit(False)) | F.coalesce(x["h"] == h(i + 1), F.lit(False)))
    rows = rows.withColumn("starts", F.array_sort(F.transform(again, lambda x: x["i"])))
    covered = F.transform("starts", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("starts", i + 1) - p, F.lit(window))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
    return rows.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def learn_threshold(scored: DataFrame, held: DataFrame) -> float:
    """scored has id, base_failed, score. The driver gets one row for each step of the score that occurs."""
    rows = scored.join(held, F.col("id") == F.col("t_id")).withColumn("step", F.floor(F.col("score") * STEPS).cast("int"))
    cells = rows.groupBy("step", "base_failed").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).collect()
    cells = sorted((c["step"], c["good"], c["bad"]) for c in cells if not c["base_failed"])
    n_good, n_bad = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not n_good:
        return THRESHOLD
    at = min(step for step, good, _ in cells if good) / STEPS  # without bad rows, or if none can be told apart
    best, lost, caught = (0.0, 0), 0, 0
    for (step, good, bad), (after, _, _) in zip(cells, cells[1:], strict=False):
        lost, caught = lost + good, caught + bad
        # of cuts of equal worth, the middle of the longest gap
        found = (round(caught / max(n_bad, 1) - lost / n_good, 12), after - step)
        if found[0] > 0 and found > best:
            best, at = found, (step + 1 + after) / 2 / STEPS
    return at


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    weights = fit_ratio(docs, trusted_ids(labels, id_col), id_col, text_col)
    if threshold is not None:
        return materialise(score_quality(docs, weights, id_col, text_col, threshold), "quality")
    scored = materialise(score_quality(docs, weights, id_col, text_col), "scores")
    threshold = learn_threshold(scored, held_ids(labels, id_col))
    kept = materialise(scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)), "quality")
    discard(scored)
    return kept


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).withColumnRenamed("id", "doc_id")
