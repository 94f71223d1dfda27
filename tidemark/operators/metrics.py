"""Evaluation metrics from a score curve: one row per distinct score with cumulative counts.

Every ranking metric is an aggregate over that table, so ties collapse by construction and nothing
needs the rows of one class, or of one stratum, in one place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.plans.cut import written
from tidemark.plans.values import exact_quantiles, score_curve, sums_at_or_above

c = F.col


def known(df: DataFrame, y: str = "y") -> DataFrame:
    return df.filter(c(y).isin(0, 1))


def curve(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = (), **sums: Column) -> DataFrame:
    """Score curve of the labelled rows: pos / neg per distinct score, above it, and in total."""
    return score_curve(known(df, y), c(score), by, pos=(c(y) == 1).cast("long"), neg=(c(y) == 0).cast("long"), **sums)


def curve_metrics(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (average ties) and average precision per group; null without both classes."""
    P, N = c("total_pos"), c("total_neg")
    beats = c("pos") * ((N - c("above_neg") - c("neg")) + c("neg") / 2.0)
    tp, fp = c("above_pos") + c("pos"), c("above_neg") + c("neg")
    out = table.groupBy(*by).agg(
        F.max(P).alias("n_pos"), F.max(N).alias("n_neg"),
        F.sum(beats).alias("__b"), F.sum(c("pos") * tp / (tp + fp)).alias("__ap"),
    )
    both = (c("n_pos") > 0) & (c("n_neg") > 0)
    return out.select(
        *by, "n_pos", "n_neg", F.when(both, c("__b") / (c("n_pos") * c("n_neg"))).alias("roc_auc"),
        F.when(c("n_pos") > 0, c("__ap") / c("n_pos")).alias("average_precision"),
    )


def roc_auc(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return curve_metrics(curve(df, score, y, by), by).select(*by, "n_pos", "n_neg", "roc_auc")


def average_precision(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return curve_metrics(curve(df, score, y, by), by).select(*by, "n_pos", "n_neg", "average_precision")


def pr_curve(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each distinct score."""
    tp, fp = c("above_pos") + c("pos"), c("above_neg") + c("neg")
    return curve(df, score, y, by).select(
        *by, c("score").alias("threshold"), (tp / (tp + fp)).alias("precision"), (tp / c("total_pos")).alias("recall"))


def recall_at_fpr_from(table: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """Recall where at most floor(target * negatives) negatives reach the threshold.

    The threshold is the lowest *negative* score that keeps within the budget; when none does it lies
    just above every negative, and only higher-scored positives count.
    """
    k = F.floor(F.lit(target) * c("total_neg"))
    reach = c("above_neg") + c("neg")
    ok = (c("neg") > 0) & (reach <= k)
    out = table.groupBy(*by).agg(
        F.max("total_pos").alias("n_pos"), F.max("total_neg").alias("n_neg"),
        F.min(F.when(ok, c("score"))).alias("__t"), F.max(F.when(c("neg") > 0, c("score"))).alias("__top"),
        F.max(F.when(ok, reach)).alias("__fp"), F.max(F.when(ok, c("above_pos") + c("pos"))).alias("__tp"),
        F.sum(F.when(c("above_neg") + c("neg") == 0, c("pos"))).alias("__clear"),
        F.max(k).alias("__k"), F.max(F.when(c("neg") > 0, F.struct(c("score"), reach, c("above_pos") + c("pos")))).alias("__first"),
    )
    both = (c("n_pos") > 0) & (c("n_neg") > 0)
    # All negatives tied above the budget: with a budget the tie itself is the threshold, and the overflow shows.
    tied = (c("__k") > 0) & c("__t").isNull()
    t = F.when(tied, c("__first.score")).otherwise(F.coalesce(c("__t"), c("__top")))
    fp = F.when(tied, c("__first.col2")).otherwise(F.coalesce(c("__fp"), F.lit(0)))
    tp = F.when(tied, c("__first.col3")).otherwise(F.coalesce(c("__tp"), c("__clear"), F.lit(0)))
    return out.select(
        *by, "n_pos", "n_neg", F.when(both, t).alias("threshold"),
        F.when(both, fp / c("n_neg")).alias("realised_fpr"), F.when(both, tp / c("n_pos")).alias("recall"))


def recall_at_fpr(df: DataFrame, target: float, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return recall_at_fpr_from(curve(df, score, y, by), target, by)


def precision_at_k(df: DataFrame, k: int, k_provenance: str, score: str = "score", y: str = "y", tie: str = "event_id") -> DataFrame:
    """Precision of the k highest-scored labelled rows (ties by id), with its Wilson interval."""
    if not k_provenance.strip():
        raise ValueError("precision at k needs a sentence saying where k comes from")
    top = known(df, y).orderBy(F.desc(score), tie).limit(max(k, 1))
    out = top.agg(F.sum((c(y) == 1).cast("long")).alias("hits"), F.count(F.lit(1)).alias("k_effective"))
    lo, hi = S.wilson(c("hits"), c("k_effective"))
    return out.select("hits", "k_effective", (c("hits") / F.nullif(c("k_effective"), F.lit(0))).alias("precision_at_k"),
                      lo.alias("ci_lo"), hi.alias("ci_hi"), F.lit(k_provenance).alias("k_provenance"))


def confusion(df: DataFrame, threshold: Column | float, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall, F1, FPR and accuracy at a threshold, with Wilson intervals."""
    hit, pos = c(score) >= threshold, c(y) == 1
    n = lambda cond: F.sum(cond.cast("long"))
    t = known(df, y).groupBy(*by).agg(n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & pos).alias("fn"), n(~hit & ~pos).alias("tn"))
    one = lambda x: F.greatest(x, F.lit(1))
    flagged, positives = one(c("tp") + c("fp")), one(c("tp") + c("fn"))
    p, r = c("tp") / flagged, c("tp") / positives
    p_lo, p_hi = S.wilson(c("tp"), flagged)
    r_lo, r_hi = S.wilson(c("tp"), positives)
    return t.select(
        *by, "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"),
        (2 * p * r / F.greatest(p + r, F.lit(1e-12))).alias("f1"), (c("fp") / one(c("fp") + c("tn"))).alias("fpr"),
        ((c("tp") + c("tn")) / one(c("tp") + c("fp") + c("fn") + c("tn"))).alias("accuracy"),
        p_lo.alias("precision_lo"), p_hi.alias("precision_hi"), r_lo.alias("recall_lo"), r_hi.alias("recall_hi"))


def value_detection(df: DataFrame, threshold: Column | float, amount: str, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Fraud value caught over fraud value attempted, next to the count recall."""
    fraud = known(df, y).filter(c(y) == 1)
    hit = c(score) >= threshold
    t = fraud.groupBy(*by).agg(F.sum(amount).alias("attempted"), F.sum(F.when(hit, c(amount)).otherwise(0.0)).alias("caught"),
                               F.avg(S.flag(hit)).alias("count_recall"))
    return t.withColumn("vdr", F.when(c("attempted") > 0, c("caught") / c("attempted")))


def recall_by(df: DataFrame, threshold: Column | float, by: str, score: str = "score", y: str = "y", underpowered_below: int = 20) -> DataFrame:
    """Recall per stratum at one threshold, with Wilson bounds; strata without positives are left out."""
    rows = df.filter((c(y) == 1) & c(by).isNotNull())
    if dict(df.dtypes)[by] == "string":
        rows = rows.filter(c(by) != "")
    t = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_positives"), F.sum((c(score) >= threshold).cast("long")).alias("caught"))
    lo, hi = S.wilson(c("caught"), c("n_positives"))
    return t.select(by, "n_positives", "caught", (c("caught") / c("n_positives")).alias("recall"), lo.alias("ci_lo"), hi.alias("ci_hi"),
                    (c("n_positives") < underpowered_below).alias("underpowered"), (c("caught") == 0).alias("zero_recall"))


# Names of the age strata.
AGE_STRATA = {0: "0-1d", 1: "1-7d", 2: "7-30d", 3: "30d+", -1: "unknown"}


def recall_by_age(df: DataFrame, threshold: Column | float, band: str, score: str = "score", y: str = "y") -> DataFrame:
    named = df.withColumn("stratum", S.mapped(c(band).cast("int"), AGE_STRATA))
    return recall_by(named, threshold, "stratum", score, y)


def cohort_fpr(df: DataFrame, threshold: Column | float, tag: str = "cohort_tag", score: str = "score", y: str = "y",
               base_rate: float = 0.001) -> DataFrame:
    """False-positive rate of benign rows per cohort tag and per block, with the smallest detectable move.

    Blocks are the tag prefixes hb12_ and hbb_ and the ordinary rows; a null tag marks the block total.
    """
    block = F.when(c(tag).startswith("hb12_"), "hard_benign_12").when(c(tag).startswith("hbb_"), "hard_benign_b").when(c(tag) == "ordinary", "ordinary")
    rows = df.filter(c(y) != 1).withColumn("block", block).filter(c("block").isNotNull())
    t = rows.rollup("block", tag).agg(F.count(F.lit(1)).alias("n"), F.sum((c(score) >= threshold).cast("long")).alias("false_positives"))
    t = t.filter(c("block").isNotNull())
    lo, hi = S.wilson(c("false_positives"), c("n"))
    return t.select("block", tag, "n", "false_positives", (c("false_positives") / c("n")).alias("fpr"), lo.alias("ci_lo"), hi.alias("ci_hi"),
                    F.when(c("n") > 1, S.realised_mde(base_rate, c("n"))).alias("realised_mde_pp"))


def per_group(df: DataFrame, by: str, target_fpr: float = 0.001, score: str = "score", y: str = "y") -> DataFrame:
    """Every core metric per rail (or other group); not reportable without both classes."""
    table = curve(df, score, y, [by])
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    out = sizes.join(curve_metrics(table, [by]), by, "left").join(
        recall_at_fpr_from(table, target_fpr, [by]).select(by, "threshold", "realised_fpr", "recall"), by, "left")
    return out.fillna({"n_pos": 0, "n_neg": 0}).withColumn("reportable", (c("n_pos") > 0) & (c("n_neg") > 0))


# --- bootstrap on counts -------------------------------------------------------------------------------

_HALVES, _RUNS = 12, 16


def _poisson_cdf(mean: int) -> list[float]:
    out, p, k = [], math.exp(-mean), 0
    while not out or (out[-1] < 1.0 - 1e-13 and k < 20 * mean + 60):
        out.append((out[-1] if out else 0.0) + p)
        k += 1
        p *= mean / k
    return out


def _uniform(text: Column) -> Column:
    """A number in [0, 1) from 48 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") / float(1 << 48)


def _draw(mean: int, u: Column) -> Column:
    """A Poisson(mean) draw from a uniform number: how many steps of the distribution lie at or below it.

    ``u`` must be a plain value: it is read once per step.
    """
    edges = F.array(*[F.lit(v) for v in _poisson_cdf(mean)])
    return F.size(F.filter(edges, lambda e: e <= u))


def resampled(n: Column, text: Column) -> Column:
    """How many of ``n`` rows a Poisson(1) resample holds, a Poisson(n) draw: the digits of n in base 16 are drawn each.

    A sum of independent Poisson draws is one of the summed mean, so digit d of 16^k is d draws of mean 16^k; means above 256
    are normal to well within the resolution of a replicate and use the rounded normal quantile of twelve uniforms.
    """
    def digit_draws(k: int, unit: int) -> Column:
        digit = F.pmod(F.floor(n / unit), F.lit(16)).cast("int")
        turns = F.when(digit > 0, F.sequence(F.lit(1), digit)).otherwise(F.array().cast("array<int>"))
        uniforms = F.transform(turns, lambda i: _uniform(F.concat(text, F.lit(f"|{k}|"), i.cast("string"))))
        return F.aggregate(uniforms, F.lit(0), lambda a, u: a + _draw(unit, u))  # one hash per draw

    small = digit_draws(0, 1) + digit_draws(1, 16) + digit_draws(2, 256)
    rest = (F.floor(n / 4096) * 4096).cast("double")
    halves = [_uniform(F.concat(text, F.lit(f"|z|{i}"))) for i in range(_HALVES)]
    z = sum(halves[1:], halves[0]) - _HALVES / 2
    return small + F.when(rest > 0, F.greatest(F.round(rest + F.sqrt(rest) * z), F.lit(0.0))).otherwise(F.lit(0.0)).cast("long")


def replicate_counts(cells: DataFrame, keys: Sequence[str], count: str, replicates: int, seed: int) -> DataFrame:
    """Rows of (keys, count) once per replicate with ``w``, the rows of the cell the replicate holds; replicate 0 is the data.

    The draw hashes the keys' text, the replicate and the seed with MD5: any engine can repeat it, and a lost task does.
    """
    text = F.concat_ws("|", *[c(k).cast("string") for k in keys], c("rep").cast("string"), F.lit(str(seed)))
    tasks = 2 * cells.sparkSession.sparkContext.defaultParallelism  # a small table becomes much work
    runs = min(_RUNS, replicates + 1)  # of replicates: cells are dealt out once per run, not once per replicate
    dealt = cells.withColumn("__run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).repartition(tasks, "__run", *keys)
    reps = dealt.withColumn("rep", F.explode(F.sequence(c("__run"), F.lit(replicates), F.lit(runs)))).drop("__run")
    return reps.withColumn("w", F.when(c("rep") == 0, c(count).cast("long")).otherwise(resampled(c(count), text).cast("long")))


def bootstrap_interval(df: DataFrame, value: Column, replicates: int = 100, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean of a column of few distinct values: one draw per (value, replicate), not per row."""
    cells = df.select(value.cast("double").alias("value")).filter(c("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("cell", F.round(c("value") * 1_000_000).cast("long"))
    reps = replicate_counts(cells, ["cell"], "n", replicates, seed).filter("rep > 0").groupBy("rep").agg((F.sum(c("w") * c("value")) / F.sum("w")).alias("v"))
    return reps.agg(F.count(F.lit(1)).alias("replicates"), F.percentile("v", [alpha / 2, 0.5, 1 - alpha / 2]).alias("q")).select(
        "replicates", c("q")[0].alias("lo"), c("q")[1].alias("mid"), c("q")[2].alias("hi"))


def controlled_comparison(df: DataFrame, ours: str, others: Sequence[str], target_fpr: float = 0.001, y: str = "y", replicates: int = 300, seed: int = 11,
                          cells: int | None = None) -> DataFrame:
    """Recall of one score against each other arm at a fixed FPR on the same rows, with a paired bootstrap interval per arm.

    Rows are counted by (every arm's score, label); replicates draw these counts, so both arms of a pair are resampled
    together and rows that agree in all of these are drawn at once.  Replicates use the scores themselves, as the point
    estimate does; only where ``cells`` is given they use scores cut to that many cells a unit.
    """
    arms = [ours, *others]
    rows = known(df, y).select(c(y).cast("int").alias("y"), *[c(a).cast("double").alias(a) for a in arms])
    exact = rows.select("y", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), c(a).alias("s")) for a in arms])).alias("e")).select("y", "e.arm", "e.s")
    point = recall_at_fpr_from(score_curve(exact, c("s"), ["arm"], pos=F.when(c("y") == 1, 1).otherwise(0), neg=F.when(c("y") == 0, 1).otherwise(0)), target_fpr, ["arm"])
    keys = [f"k{i}" for i in range(len(arms))]
    counted = rows.select("y", *[(c(a) if cells is None else F.floor(c(a) * cells).cast("long")).alias(k) for a, k in zip(arms, keys, strict=True)]).groupBy("y", *keys).agg(F.count(F.lit(1)).alias("n"))
    # Drawn once, where the replicates were dealt: a filter on ``w`` would otherwise draw before that, in the few tasks of the cells.
    drawn = written(replicate_counts(counted, ["y", *keys], "n", replicates, seed).filter("rep > 0")).filter("w > 0")
    long = drawn.select("rep", "y", "w", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), c(k).cast("double").alias("s")) for a, k in zip(arms, keys, strict=True)])).alias("e"))
    side = lambda label: F.sum(F.when(c("y") == label, c("w")).otherwise(0))
    per_cell = written(long.select("rep", "y", "w", "e.arm", "e.s").groupBy("rep", "arm", "s").agg(side(1).alias("pos"), side(0).alias("neg")))  # drawn once
    curve_ = score_curve(per_cell, c("s"), ["rep", "arm"], pos=c("pos"), neg=c("neg"))
    recall = recall_at_fpr_from(curve_, target_fpr, ["rep", "arm"]).select("rep", "arm", "recall")
    own = recall.filter(c("arm") == ours).select("rep", c("recall").alias("ours"))
    deltas = recall.filter(c("arm") != ours).join(own, "rep").withColumn("d", c("ours") - c("recall"))
    spans = deltas.groupBy("arm").agg(F.percentile("d", [0.025, 0.975]).alias("q"), F.count(F.lit(1)).alias("replicates"))
    mine = point.filter(c("arm") == ours).select(c("recall").alias("recall_ours"))
    out = point.filter(c("arm") != ours).select("arm", c("recall").alias("recall_other")).crossJoin(F.broadcast(mine)).join(spans, "arm")
    out = out.select("arm", "recall_ours", "recall_other", (c("recall_ours") - c("recall_other")).alias("delta"), c("q")[0].alias("lo"), c("q")[1].alias("hi"), "replicates")
    return out.withColumn("reported_as", no_effect(c("delta"), c("lo"), c("hi")))


def no_effect(delta: Column, lo: Column, hi: Column) -> Column:
    return F.when((lo <= 0) & (hi >= 0), "no measured effect").otherwise("effect")


def approval_delta(df: DataFrame, ours: str, incumbent: str, amount: str, y: str = "y", n_quantiles: int = 120) -> DataFrame:
    """Approval-rate change at the incumbent's realised fraud basis points.

    The incumbent declines its top decile; ours is searched over quantiles for the closest basis points.
    """
    rows = known(df, y)
    step = (0.9999 - 0.50) / (n_quantiles - 1)
    grid = [0.50 + i * step for i in range(n_quantiles)]
    inc = exact_quantiles(rows, c(incumbent), [0.90]).select(c("value").alias("t_inc"))
    base = rows.crossJoin(F.broadcast(inc))
    fraud = F.when(c(y) == 1, c(amount)).otherwise(0.0)
    ref = base.agg(
        F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(c(incumbent) < c("t_inc"), fraud).otherwise(0.0)).alias("f"), F.avg(S.flag(c(incumbent) < c("t_inc"))).alias("incumbent_approval"),
        F.sum(fraud).alias("fraud_total"),
    ).select("n", "total", "fraud_total", "incumbent_approval", (10_000.0 * c("f") / c("total")).alias("target_bps"))
    cands = exact_quantiles(rows, c(ours), grid).select(c("q_idx"), c("value").alias("t"))
    at = sums_at_or_above(rows, c(ours), cands, af=fraud, an=F.lit(1))
    scored = at.crossJoin(F.broadcast(ref)).withColumn("bps", 10_000.0 * (c("fraud_total") - c("af")) / c("total")).withColumn(
        "gap", F.abs(c("bps") - c("target_bps")))
    # Equal gaps (runs of tied candidates) go to the first candidate; rounding keeps float noise out of the choice.
    best = scored.orderBy(F.round("gap", 9), "q_idx").limit(1)
    return best.select("target_bps", c("bps").alias("realised_bps"), "incumbent_approval", ((c("n") - c("an")) / c("n")).alias("our_approval"),
                       (100.0 * ((c("n") - c("an")) / c("n") - c("incumbent_approval"))).alias("approval_delta_pp"))


def sibling_recall(df: DataFrame, threshold: Column | float, score: str = "score", y: str = "y") -> DataFrame:
    """Recall on held-out siblings per mutated slot at the pre-retrain threshold, with its tier."""
    t = df.filter(c(y) == 1).groupBy("mutated_slot", "cell_crossing").agg(
        F.count(F.lit(1)).alias("n_positives"), F.sum((c(score) >= threshold).cast("long")).alias("caught"))
    lo, hi = S.wilson(c("caught"), c("n_positives"))
    tier = F.when(c("cell_crossing") & (c("mutated_slot") == "EVASION"), "headline").when(~c("cell_crossing"), "same-cell").otherwise("cross-cell")
    return t.select("mutated_slot", "cell_crossing", "n_positives", "caught", (c("caught") / c("n_positives")).alias("recall"), lo.alias("ci_lo"), hi.alias("ci_hi"), tier.alias("tier"))


def view_ablation(per_view: DataFrame, full: str = "all") -> DataFrame:
    """Recall per view against the full view's: difference and share."""
    base = per_view.filter(c("view") == full).agg(F.max("recall").alias("__full"))
    return per_view.filter(c("view") != full).crossJoin(F.broadcast(base)).select(
        "view", "recall", (c("recall") - c("__full")).alias("delta_vs_full"), (c("recall") / F.nullif(c("__full"), F.lit(0.0))).alias("share_of_full"))


def sealed_recall(df: DataFrame, threshold: Column | float, sealed: str = "sealed", score: str = "score", y: str = "y") -> DataFrame:
    """Recall on sealed against trainable positives."""
    return recall_by(df.withColumn("__side", F.when(c(sealed), "sealed").otherwise("trainable")), threshold, "__side", score, y).withColumnRenamed("__side", "side")


def reportable(df: DataFrame, y: str = "y", minimum: int = 100) -> DataFrame:
    return df.agg(F.sum((c(y) == 1).cast("long")).alias("n_positives")).withColumn("reportable", c("n_positives") >= minimum)


def channel_metrics(df: DataFrame, channels: Sequence[str], target_fpr: float = 0.001, y: str = "y") -> DataFrame:
    """Each score channel on its own: AP, AUC, recall at FPR and lift of AP over the base rate."""
    long = known(df, y).select(y, F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), c(n).cast("double").alias("score")) for n in channels])).alias("e"))
    rows = long.select(y, "e.channel", "e.score")
    table = curve(rows, "score", y, ["channel"])
    out = curve_metrics(table, ["channel"]).join(recall_at_fpr_from(table, target_fpr, ["channel"]).select("channel", "recall"), "channel")
    rate = c("n_pos") / (c("n_pos") + c("n_neg"))
    return out.withColumn("lift", c("average_precision") / F.nullif(rate, F.lit(0.0)))


def head_to_head(df: DataFrame, channels: Sequence[str], seen: Column, target_fpr: float = 0.001, y: str = "y", least: int = 50) -> DataFrame:
    """Channel metrics on the rows no arm was fitted on and, for comparison, on all; ``reported`` needs ``least`` positives."""
    parts = [channel_metrics(df.filter(~seen), channels, target_fpr, y).withColumn("rows_used", F.lit("clean")),
             channel_metrics(df, channels, target_fpr, y).withColumn("rows_used", F.lit("contaminated"))]
    return parts[0].unionByName(parts[1]).withColumn("reported", (c("n_pos") >= least) & (c("rows_used") == "clean"))


def union_truth(*flags: Column) -> Column:
    """1 where any source of truth says so."""
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return F.when(F.coalesce(out, F.lit(False)), 1).otherwise(0)
