"""An n-gram model of command sequences: counts, smoothed scores, decay, thresholds, calibration.

Counts are tables (ngram: array of words, n); contexts have totals and numbers of
continuations. Every step is a group-by, a window within one sequence or a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Smoothing of unigrams, discount of higher orders, buckets of the score histogram and its range.
ALPHA, DISCOUNT, BUCKETS, RANGE = 0.1, 0.5, 128, 50.0
ORDERS = (1, 2, 3, 4)


def _ordered(events: DataFrame) -> DataFrame:
    """seq, pos, w and the three words before; sequences with an empty or overlong word are left out."""
    bad = events.filter((F.col("w") == "") | (F.octet_length("w") > 1023) | F.col("w").isNull()).select("seq").distinct()
    by = W.partitionBy("seq").orderBy("pos")
    rows = events.join(bad, "seq", "left_anti")
    return rows.withColumns({f"l{k}": F.lag("w", k).over(by) for k in (1, 2, 3)}).withColumn("i", F.row_number().over(by))


def _gram(order: int) -> list[str]:
    return [*(f"l{k}" for k in range(order - 1, 0, -1)), "w"]


def ngram_counts(events: DataFrame, order: int) -> DataFrame:
    """The order's words (l3, l2, l1, w as far as it has them) and n; events: seq, pos, w."""
    cols = _gram(order)
    rows = _ordered(events)
    return rows.filter(F.col("i") >= order).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def model(events: DataFrame) -> dict[int, DataFrame]:
    rows = _ordered(events)
    return {k: rows.filter(F.col("i") >= k).groupBy(*_gram(k)).agg(F.count(F.lit(1)).alias("n")) for k in ORDERS}


def context_totals(counts: DataFrame, order: int) -> DataFrame:
    """Per context (all words but the last): total, kinds (distinct continuations)."""
    return counts.groupBy(*_gram(order)[:-1]).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))


def scores(events: DataFrame, of: dict[int, DataFrame]) -> DataFrame:
    """seq, score: mean bits per word from the fourth on (three words: of the third); null stands for
    infinity, of sequences under three words."""
    total, kinds = of[1].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    unknown = (kinds + ALPHA) / (total + kinds + ALPHA * (kinds + 1))
    rows = _ordered(events)
    size = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("size"))
    # Each different n-gram is looked up once.
    grams = rows.filter(F.col("i") >= 3).withColumn("l3", F.when(F.col("i") >= 4, F.col("l3"))).select("l3", "l2", "l1", "w").distinct()
    p = grams.join(of[1].select("w", F.col("n").alias("c1")), "w", "left")
    p = p.withColumn("p", F.when(F.col("c1") > 0, (F.col("c1") + ALPHA) / (total + ALPHA * kinds)).otherwise(F.lit(unknown)))
    for k in ORDERS[1:]:
        cols = _gram(k)
        seen = of[k].join(context_totals(of[k], k), cols[:-1]).select(*cols, F.col("n").alias("c"), "total", "kinds")
        p = p.join(seen, cols, "left")
        level = F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / F.col("total") + DISCOUNT * F.col("kinds") / F.col("total") * F.col("p")
        p = p.withColumn("p", F.when(F.col("c").isNotNull(), level).otherwise(F.col("p"))).drop("c", "total", "kinds")
    keyed = [F.coalesce("l3", F.lit("")).alias("k3"), F.col("l2"), F.col("l1"), F.col("w")]
    at = rows.join(size, "seq").filter((F.col("i") >= 4) | ((F.col("size") == 3) & (F.col("i") == 3)))
    at = at.select("seq", F.when(F.col("i") >= 4, F.col("l3")).alias("l3"), "l2", "l1", "w").select("seq", *keyed)
    bits = at.join(p.select(*keyed, "p"), ["k3", "l2", "l1", "w"]).groupBy("seq").agg(F.avg(-F.log2("p")).alias("score"))
    return size.select("seq").join(bits, "seq", "left")


def decay(counts: DataFrame, scale: float) -> DataFrame:
    """Counts times scale, cut to whole numbers, without those below one. Contexts' totals decay on their own."""
    if not 0 < scale < 1:
        return counts
    name = "n" if "n" in counts.columns else "total"
    return counts.withColumn(name, F.floor(F.col(name) * scale).cast("long")).filter(F.col(name) >= 1)


def prune(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(F.col("n" if "n" in counts.columns else "total") >= least)


def adaptive_thresholds(scored: DataFrame, window: int, k: float) -> DataFrame:
    """seq, at, score, threshold: mean + k population deviations of the last `window` scores of the same gate before
    each one; null until there are as many. scored: gate, at, score."""
    last = W.partitionBy("gate").orderBy("at").rowsBetween(-window, -1)
    n = F.count("score").over(last)
    return scored.withColumn("threshold", F.when(n == window, F.avg("score").over(last) + k * F.stddev_pop("score").over(last)))


def histogram(scored: DataFrame) -> DataFrame:
    """bucket, n, below (scores in lower buckets), of finite scores from 0 on."""
    bucket = F.least(F.floor(F.col("score") / RANGE * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    rows = scored.filter(F.col("score").isNotNull() & (F.col("score") >= 0)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("below", F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # at most BUCKETS rows


def log_odds(hist: DataFrame) -> DataFrame:
    """bucket, odds: ln(F / (1 - F)) of the smoothed mid-rank share F of scores up to the bucket."""
    total = F.sum("n").over(W.partitionBy())
    share = (F.col("below") + 0.5 * F.col("n") + 0.5) / (total + 1.0)
    return hist.select("bucket", F.ln(share / (1.0 - share)).alias("odds"))


def combine(raw: Column, kind: Column, w_raw: float, w_kind: float) -> Column:
    """Weighted sum; null (infinite) where a weighted part is."""
    if min(w_raw, w_kind) < 0 or not 0.99 <= w_raw + w_kind <= 1.01:
        raise ValueError("weights are not negative and sum to 1")
    part = lambda x, w: F.lit(0.0) if w == 0 else x * w
    return part(raw, w_raw) + part(kind, w_kind)


def roc(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per threshold: tp, fp, tn, fn, tpr, fpr, precision, f1; scored: score, anomalous. Scores are first counted by how
    many thresholds they pass, so each is read once whatever the number of thresholds (a fixed list)."""
    levels = sorted(r["threshold"] for r in thresholds.select("threshold").distinct().collect())
    passed = sum((F.coalesce(F.col("score"), F.lit(float("inf"))) > t).cast("int") for t in levels)
    counts = scored.groupBy(passed.alias("passed"), "anomalous").agg(F.count(F.lit(1)).alias("n"))
    table = scored.sparkSession.createDataFrame(list(enumerate(levels, 1)), "need int, threshold double")
    rows = table.join(counts, F.lit(True))  # thresholds by as many counts
    over, bad = F.col("passed") >= F.col("need"), F.col("anomalous")
    count = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0))
    rows = rows.groupBy("threshold").agg(count(over & bad).alias("tp"), count(over & ~bad).alias("fp"), count(~over & ~bad).alias("tn"), count(~over & bad).alias("fn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rows = rows.withColumns({"tpr": div(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": div(F.col("fp"), F.col("fp") + F.col("tn")), "precision": div(F.col("tp"), F.col("tp") + F.col("fp"))})
    return rows.withColumn("f1", div(2 * F.col("precision") * F.col("tpr"), F.col("precision") + F.col("tpr")))


def auc(curve: DataFrame) -> DataFrame:
    """auc of a curve with few points (roc()), by trapezoids from (0, 0) to (1, 1)."""
    ends = curve.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr double, tpr double")
    by = W.orderBy("fpr", "tpr")
    points = curve.select("fpr", "tpr").union(ends)
    area = (F.col("fpr") - F.lag("fpr").over(by)) * (F.col("tpr") + F.lag("tpr").over(by)) / 2
    return points.select(area.alias("a")).agg(F.sum("a").alias("auc"))


def best_f1(curve: DataFrame) -> DataFrame:
    return curve.orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1")
