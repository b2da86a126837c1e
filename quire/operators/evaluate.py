"""Answer scoring (X4): first usable reply (W6), positional match to gold (J12),
confusion counts and metrics (A10), exact-match accuracy (A11, F12), per-table
rollup (A12) and running accuracy (W3).

Inputs: ``prompts(group_id, answers array<string> [, table_name])`` and
``responses(group_id, attempt int, text string)``.  A prompt's lists are bounded by
its token budget; everything across prompts is an aggregate or a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.replies import parse_json_reply, parse_yes_no
from quire.functions.strings import normalise_gold, normalise_reply
from quire.session import cut_lineage

MAX_ATTEMPTS = 30  # fixed value: tries per prompt


def first_valid_reply(prompts: DataFrame, responses: DataFrame, kind: str = "yes_no",
                      max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Per prompt the first attempt (<= max_attempts) that parses.

    yes_no: one verdict per gold answer; json: a JSON object.  Output
    ``(group_id, attempt, parsed)``; prompts with no usable reply are absent."""
    r = responses.where(F.col("attempt") <= max_attempts)
    if kind == "yes_no":
        r = r.join(prompts.select("group_id", F.size("answers").alias("_n")), "group_id") \
            .withColumn("parsed", parse_yes_no(F.col("text"))) \
            .where(F.size("parsed") == F.col("_n"))
        agg = F.min_by("parsed", "attempt")
    elif kind == "json":
        r = r.withColumn("parsed", parse_json_reply(F.col("text"))).where(F.col("parsed").isNotNull())
        agg = F.min_by("parsed", "attempt")
    else:
        raise ValueError(f"unknown reply kind {kind!r}")
    return r.groupBy("group_id").agg(F.min("attempt").alias("attempt"), agg.alias("parsed"))


def er_counts(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """J12 + A10 per prompt: ``(group_id, tp, fp, tn, fn)``; unanswered prompts count 0."""
    j = prompts.select("group_id", "answers").join(replies.select("group_id", "parsed"), "group_id", "left")
    z = F.arrays_zip(F.coalesce(F.col("parsed"), F.array().cast("array<int>")).alias("v"),
                     F.col("answers").alias("a"))

    def count(cond) -> F.Column:
        return F.size(F.filter(z, lambda x: x["v"].isNotNull() & x["a"].isNotNull() & cond(x)))

    gold_one = lambda x: x["a"].cast("int") == 1
    gold_zero = lambda x: x["a"].cast("int") == 0
    return j.select(
        "group_id",
        count(lambda x: (x["v"] == 1) & gold_one(x)).alias("tp"),
        count(lambda x: (x["v"] == 1) & ~gold_one(x)).alias("fp"),
        count(lambda x: (x["v"] == 0) & gold_zero(x)).alias("tn"),
        count(lambda x: (x["v"] == 0) & ~gold_zero(x)).alias("fn"),
        F.col("parsed").isNull().alias("unanswered"))


def _ratio(num, den) -> F.Column:
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def er_metrics(counts: DataFrame) -> DataFrame:
    """A10 totals: precision and recall are both 0 when either denominator is 0."""
    t = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")],
                   F.count("*").alias("n_prompts"), F.count_if("unanswered").alias("unanswered"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    both = ((tp + fp) != 0) & ((tp + fn) != 0)
    return t.select(
        "tp", "fp", "tn", "fn",
        _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        F.when(both, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
        F.when(both, tp / (tp + fn)).otherwise(F.lit(0.0)).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "n_prompts", "unanswered")


def eval_er(prompts: DataFrame, responses: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    return er_metrics(er_counts(prompts, first_valid_reply(prompts, responses, "yes_no", max_attempts)))


def exact_matches(prompts: DataFrame, replies: DataFrame, task: str = "code") -> DataFrame:
    """A11/F12 per prompt: ``(group_id, [table_name,] correct, total)``.

    A missing ``QuestionN`` counts wrong; a prompt with no usable reply leaves the
    denominator (``total`` NULL).  QA gold ``true``/``false`` reads as yes/no."""
    cols = ["group_id", "answers"] + (["table_name"] if "table_name" in prompts.columns else [])
    j = prompts.select(*cols).join(replies.select("group_id", "parsed"), "group_id", "left")
    gold = (lambda a: F.when(F.lower(a) == "true", F.lit("yes")).when(F.lower(a) == "false", F.lit("no"))
            .otherwise(a)) if task == "qa" else (lambda a: a)
    hits = F.filter(F.transform(F.col("answers"), lambda a, i: F.struct(
        normalise_reply(F.element_at(F.col("parsed"), F.concat(F.lit("Question"), (i + 1).cast("string"))))
        .alias("got"), normalise_gold(gold(a)).alias("want"))),
        lambda x: x["got"].isNotNull() & (x["got"] == x["want"]))
    answered = F.col("parsed").isNotNull()
    return j.select(*[c for c in cols if c != "answers"],
                    F.when(answered, F.size(hits)).alias("correct"),
                    F.when(answered, F.size("answers")).alias("total"))


def accuracy(matches: DataFrame) -> DataFrame:
    t = matches.agg(F.coalesce(F.sum("correct"), F.lit(0)).cast("long").alias("correct"),
                    F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"),
                    F.count_if(F.col("total").isNull()).alias("unanswered"))
    return t.select("correct", "total", _ratio(F.col("correct"), F.col("total")).alias("accuracy"), "unanswered")


def eval_exact(prompts: DataFrame, responses: DataFrame, task: str = "code",
               max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    return accuracy(exact_matches(prompts, first_valid_reply(prompts, responses, "json", max_attempts), task))


def eval_rollup(matches: DataFrame) -> DataFrame:
    """Accuracy per table and over all tables (``table_name`` NULL = all)."""
    r = matches.rollup("table_name").agg(F.coalesce(F.sum("correct"), F.lit(0)).cast("long").alias("correct"),
                                         F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"))
    return r.select("table_name", "correct", "total", _ratio(F.col("correct"), F.col("total")).alias("accuracy"))


def running_sums(df: DataFrame, order_cols: list[str], sum_cols: list[str], n_parts: int | None = None,
                 keys: list[str] | None = None) -> DataFrame:
    """Cumulative sums in ``order_cols`` order (per ``keys`` if given) without a
    single-task window.

    Range-partition by (keys, order), total each (partition, key) slice, turn those
    totals into offsets (one row per slice), and add them to per-slice running sums."""
    keys = keys or []
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # materialised once: two plans of the same range exchange would each sample their own boundaries
    parted = cut_lineage(df.repartitionByRange(n, *keys, *order_cols).withColumn("_pid", F.spark_partition_id()))
    totals = parted.groupBy("_pid", *keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wp = (W.partitionBy(*keys) if keys else W).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    # one row per (partition, key) slice: bounded by the slices, not by the rows
    offsets = totals.select("_pid", *keys, *[F.coalesce(F.sum(f"_t_{c}").over(wp), F.lit(0)).alias(f"_o_{c}")
                                             for c in sum_cols])
    wl = W.partitionBy("_pid", *keys).orderBy(*order_cols).rowsBetween(W.unboundedPreceding, 0)
    out = parted.join(offsets, ["_pid", *keys])
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(wl) + F.col(f"_o_{c}"))
    return out.drop("_pid", *[f"_o_{c}" for c in sum_cols])


def eval_running(counts: DataFrame, kind: str = "er", by: list[str] | None = None) -> DataFrame:
    """Accuracy after each prompt in ``group_id`` order (on per-prompt aggregates);
    ``by=["table_name"]`` keeps one running figure per table (transform task)."""
    by = by or []
    if kind == "er":
        base = counts.select(*by, "group_id", (F.col("tp") + F.col("tn")).alias("right"),
                             (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("seen"))
    else:
        base = counts.select(*by, "group_id", F.coalesce("correct", F.lit(0)).alias("right"),
                             F.coalesce("total", F.lit(0)).alias("seen"))
    r = running_sums(base, ["group_id"], ["right", "seen"], keys=by)
    return r.select(*by, "group_id", F.col("cum_right").cast("long").alias("cum_right"),
                    F.col("cum_seen").cast("long").alias("cum_seen"),
                    _ratio(F.col("cum_right"), F.col("cum_seen")).alias("running_accuracy"))
