"""Append-only labels read point in time, time splits, and the audits that keep both honest.

A label record is ``(event_id, channel, as_of_ts, label, poisoned)``; many per event, arriving late.
Nothing after the reading time T may be seen, a missing label is not a label of 0, and a stronger
channel beats a fresher one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.plans.cut import written
from tidemark.plans.ordered import Running, ordered
from tidemark.plans.values import exact_quantiles, lookup

DAY = 86_400.0
# Channel precedence, split shares in time order, full label maturity.
PRECEDENCE = {"analyst": 1, "issuer_tag": 2, "chargeback": 3}
SHARES = {"train": 0.55, "purge": 0.04, "stats": 0.10, "embargo": 0.04, "test": 0.27}
MATURITY_DAYS = 120.0
SEALED_SHARE = 0.18


def visible(labels: DataFrame, at: Column | float) -> DataFrame:
    """Records that had arrived by the time T (inclusive)."""
    return labels.filter(F.col("as_of_ts") <= at)


def resolve(labels: DataFrame, at: Column | float) -> DataFrame:
    """One row per event with a visible record: winning label and channel, disagreement, latest arrival."""
    rank = S.mapped(F.col("channel"), PRECEDENCE, 0)
    key = F.struct(rank, F.col("as_of_ts"), F.col("label"))
    return visible(labels, at).groupBy("event_id").agg(
        F.max_by("label", key).alias("label"),
        F.max_by("channel", key).alias("channel"),
        (F.min("label") != F.max("label")).alias("disagree"),
        F.max("as_of_ts").alias("as_of"),
        F.count(F.lit(1)).alias("n_records"),
    )


def resolve_onto(events: DataFrame, labels: DataFrame, at: Column | float) -> DataFrame:
    """Events with ``y`` (1, 0, or -1 without a visible label) and ``a``, the latest visible arrival (-1 if none)."""
    won = resolve(labels, at).select("event_id", F.col("label").cast("long").alias("y"), F.col("as_of").alias("a"))
    return events.join(won, "event_id", "left").fillna({"y": -1, "a": -1.0})


def maturity(events: DataFrame, labels: DataFrame, at: Column | float) -> DataFrame:
    """Share of events with a visible record: per channel, and from any."""
    seen = visible(labels, at).select("event_id", "channel").distinct()
    per = events.select("event_id").join(seen, "event_id", "left").groupBy("event_id").agg(
        *[F.max(S.flag(F.col("channel") == c)).alias(c) for c in PRECEDENCE],
        F.max(S.flag(F.col("channel").isNotNull())).alias("any"),
    )
    return per.agg(F.count(F.lit(1)).alias("n_events"), *[F.avg(c).alias(c) for c in (*PRECEDENCE, "any")])


def positives_visible(events: DataFrame, labels: DataFrame, at: Column | float) -> DataFrame:
    y = resolve_onto(events.select("event_id"), labels, at)
    return y.agg(F.sum((F.col("y") == 1).cast("long")).alias("n_positives"))


def disagreement(events: DataFrame, labels: DataFrame, at: Column | float) -> DataFrame:
    """Among events with at least two visible records, the share whose records differ; -1 without any."""
    won = resolve(labels, at).join(events.select("event_id"), "event_id", "left_semi").filter(F.col("n_records") >= 2)
    return won.agg(F.count(F.lit(1)).alias("n_compared"),
                   F.coalesce(F.avg(S.flag(F.col("disagree"))), F.lit(-1.0)).alias("disagreement_rate"))


def label_stats(labels: DataFrame) -> DataFrame:
    return labels.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n_records"), F.countDistinct("event_id").alias("n_events"),
        F.sum((F.col("label") == 1).cast("long")).alias("n_positives"),
        F.sum(F.col("poisoned").cast("long")).alias("n_poisoned"),
    )


def maturity_report(rows: DataFrame, by: str = "split") -> DataFrame:
    """Per window of resolved rows (columns ts, y, a): visible share, unlabelled share, median days to label."""
    seen = F.col("a") > 0
    base = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(S.flag(seen)).alias("share_visible"),
        F.sum((seen & (F.col("y") == 1)).cast("long")).alias("n_visible_positives"),
        F.sum((~seen).cast("long")).alias("n_unlabelled"), F.avg(S.flag(~seen)).alias("share_unlabelled"),
    )
    days = (F.col("a") - F.col("ts")) / DAY
    mid = exact_quantiles(rows.filter(seen), days, [0.5], by=[by]).select(by, F.col("value").alias("median_days_to_label"))
    return base.join(mid, by, "left").fillna({"median_days_to_label": -1.0})


def maturity_weight(ts: Column, a: Column, window_end: Column | float, full_days: float = MATURITY_DAYS) -> Column:
    """0 without a label, else 0.25 rising to 1 as the row ages to full maturity."""
    age = (F.lit(window_end) if isinstance(window_end, (int, float)) else window_end) - ts
    grown = F.greatest(F.least(age / DAY / full_days, F.lit(1.0)), F.lit(0.0))
    return F.when(a > 0, 0.25 + 0.75 * grown).otherwise(0.0)


def queue_pressure(
    queued: DataFrame, day: str, capacity: float, base: float = 0.08, knee: float = 1.0, slope: float = 0.12, cap: float = 0.45,
) -> DataFrame:
    """Per day: depth of the review queue, depth over capacity, and the wrong-disposition rate it implies."""
    depth = queued.groupBy(day).agg(F.count(F.lit(1)).alias("queue_depth"))
    p = F.col("queue_depth") / float(capacity)
    wrong = F.when(p <= knee, F.lit(base)).otherwise(F.least(F.lit(cap), base + slope * (p - knee)))
    return depth.select(day, "queue_depth", p.alias("pressure"), wrong.alias("wrong_rate"))


# --- splits ----------------------------------------------------------------------------------------


def split_bounds(df: DataFrame, ts: str = "ts", shares: Mapping[str, float] = SHARES) -> DataFrame:
    """One row with the closing time of each window: exact quantiles of the event time."""
    if abs(sum(shares.values()) - 1.0) > 1e-6:
        raise ValueError("split shares must sum to 1")
    names, edges, acc = list(shares), [], 0.0
    for n in names:
        acc += shares[n]
        edges.append(min(acc, 1.0))
    q = exact_quantiles(df, F.col(ts), edges)
    return q.groupBy().agg(*[F.max(F.when(F.col("q_idx") == i, F.col("value"))).alias(f"{n}_end") for i, n in enumerate(names)])


def temporal_split(df: DataFrame, ts: str = "ts", shares: Mapping[str, float] = SHARES, keep_bounds: bool = False) -> DataFrame:
    """Add ``split``: each row is in exactly one window, in time order; late ties go to the last."""
    bounds = split_bounds(df, ts, shares)
    names = list(shares)
    where = S.first_match([(F.col(ts) <= F.col(f"{n}_end"), n) for n in names[:-1]], F.lit(names[-1]))
    out = df.crossJoin(F.broadcast(bounds)).withColumn("split", where)  # bounds is one row
    return out if keep_bounds else out.drop(*[f"{n}_end" for n in names])


def split_report(split: DataFrame, ts: str = "ts") -> DataFrame:
    total = split.agg(F.count(F.lit(1)).alias("__n"))
    per = split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return per.crossJoin(F.broadcast(total)).select("split", "n_rows", (F.col("n_rows") / F.col("__n")).alias("share"), "first_ts", "last_ts")


def split_gaps(bounds: DataFrame) -> DataFrame:
    return bounds.select(((F.col("purge_end") - F.col("train_end")) / DAY).alias("purge_days"),
                         ((F.col("embargo_end") - F.col("stats_end")) / DAY).alias("embargo_days"))


def entity_disjoint_folds(df: DataFrame, entity: str, order: Sequence[str], n_folds: int = 4) -> DataFrame:
    """Forward folds as (fold, role, row) with validation rows of already-trained entities removed.

    Each row's position in time is one running count; an entity is trained in fold f exactly when its
    first row lies before the fold's boundary, so one minimum per entity replaces the per-fold joins.
    """
    placed = ordered(df.withColumn("__all", F.lit(0)), ["__all"], list(order), {"__pos": Running("count", F.lit(1))})
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    first = placed.groupBy(entity).agg(F.min("__pos").alias("__first"))
    rows = lookup(placed, first, [entity], order[-1]).filter(F.col(entity).isNotNull()).crossJoin(F.broadcast(total))  # a hot entity is salted
    n = F.col("__n")
    width = F.greatest(F.lit(1), F.floor(n / (n_folds + 1)))
    # Half to even, as a round of the exact boundary gives.
    folds = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda i: F.struct(
        i.alias("fold"), F.bround(n * (i + 1) / F.lit(float(n_folds + 1))).alias("b"))))
    spread = rows.withColumn("__f", folds)
    b, pos = F.col("__f.b"), F.col("__pos")
    role = F.when(pos < b, "train").when((pos < b + width) & (F.col("__first") >= b), "validate")
    return spread.withColumn("role", role).withColumn("fold", F.col("__f.fold")).filter(F.col("role").isNotNull()).drop(
        "__all", "__pos", "__first", "__n", "__f")


def entity_pool(key: Column, share: float = SEALED_SHARE) -> Column:
    """'sealed' for a stable hashed share of the ids, 'train' for the rest."""
    return F.when(S.hash_unit(key, "pool") < share, "sealed").otherwise("train")


# --- audits ----------------------------------------------------------------------------------------


def label_time_audit(rows: DataFrame, window_end: Column | float) -> DataFrame:
    """Resolved rows whose label arrived after the window's end or before its own event."""
    got = F.col("a") > 0
    late, early = got & (F.col("a") > window_end + 1e-6), got & (F.col("a") < F.col("ts") - 1e-6)
    out = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(got.cast("long")).alias("n_resolved"),
        F.sum(late.cast("long")).alias("n_future_labels"), F.sum(early.cast("long")).alias("n_backwards_labels"),
    )
    bad = F.col("n_future_labels") + F.col("n_backwards_labels") > 0
    return out.withColumn("status", F.when(bad, "FAIL").otherwise("PASS"))


def entity_audit(df: DataFrame, train: Column, holdout: Column, keys: Sequence[str]) -> DataFrame:
    """Per key column: ids that occur on both sides (count and up to 20 in order)."""
    long = df.select(train.alias("__t"), holdout.alias("__h"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("id")) for k in keys])).alias("e"))
    sides = long.filter((F.col("e.id") != "") & F.col("e.id").isNotNull()).groupBy("e.key", "e.id").agg(
        F.max(F.col("__t").cast("int")).alias("t"), F.max(F.col("__h").cast("int")).alias("h"))
    shared = sides.filter((F.col("t") == 1) & (F.col("h") == 1))
    # A prefix of ranks per key: the partial limit keeps 20 rows per key and task before the shuffle.
    ranked = shared.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("r") <= 20)
    sample = ranked.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("sample"))
    return shared.groupBy("key").agg(F.count(F.lit(1)).alias("n_shared")).join(sample, "key")


def statistic_fit_audit(stats_scalars: DataFrame, bounds: DataFrame) -> DataFrame:
    """Frozen statistics must come from at least one row and end within the training window."""
    joined = stats_scalars.crossJoin(F.broadcast(bounds))
    empty, late = F.col("n_fit") <= 0, F.col("window_end_ts") > F.col("train_end") + 1e-6
    reach = (F.col("embargo_end") > 0) & (F.col("window_end_ts") >= F.col("embargo_end"))
    return joined.select(
        "n_fit", "window_end_ts", "train_end", empty.alias("no_rows"), late.alias("beyond_train"), reach.alias("past_embargo"),
        F.when(empty | late | reach, "FAIL").otherwise("PASS").alias("status"))


def unpivot_features(df: DataFrame, names: Sequence[str], *carry: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(*carry, F.explode(pairs).alias("__e")).select(*carry, "__e.feature", "__e.value")


def one_sided_separators(df: DataFrame, names: Sequence[str], attack: str) -> DataFrame:
    """Per feature: rows above -1 on each side, flagged when only attacks carry it."""
    long = unpivot_features(df, names, attack)
    has, bad = F.col("value") > -1.0, F.col(attack)
    out = long.groupBy("feature").agg(F.sum((has & bad).cast("long")).alias("n_attack"), F.sum((has & ~bad).cast("long")).alias("n_benign"))
    return out.withColumn("one_sided", (F.col("n_attack") > 0) & (F.col("n_benign") == 0))


def artefact_audit(df: DataFrame, names: Sequence[str], attack: str, target_fpr: float = 0.001,
                   system_recall: float | None = None) -> DataFrame:
    """What each single feature explains: support by class, recall alone at the FPR, best gap, AUC and AP on support."""
    from tidemark.operators.metrics import curve_metrics
    from tidemark.plans.values import score_curve

    # One pass over rows x features: what follows reads the counts per value.
    sides = [F.sum(v.cast("long")).alias(n) for n, v in (("pos", F.col(attack)), ("neg", ~F.col(attack)))]
    long = written(unpivot_features(df, names, attack).groupBy("feature", "value").agg(*sides))
    pos, neg = F.col("pos"), F.col("neg")
    curve = score_curve(long.filter(F.col("value") > -1.0), F.col("value"), by=["feature"], pos=pos, neg=neg)
    on_support = curve_metrics(curve, by=["feature"]).select("feature", F.col("roc_auc").alias("auc_on_support"), F.col("average_precision").alias("ap_on_support"))
    sizes = long.groupBy("feature").agg(F.sum(pos).alias("P"), F.sum(neg).alias("N"),
                                        F.sum(F.when(F.col("value") > -1.0, pos).otherwise(0)).alias("p_support"),
                                        F.sum(F.when(F.col("value") > -1.0, neg).otherwise(0)).alias("n_support"))
    steps = curve.join(F.broadcast(sizes), "feature")  # one row per feature
    tpr, fpr = (F.col("above_pos") + F.col("pos")) / F.col("P"), (F.col("above_neg") + F.col("neg")) / F.col("N")
    alone = steps.groupBy("feature").agg(
        F.coalesce(F.max(F.when(fpr <= target_fpr, tpr)), F.lit(0.0)).alias("recall_alone"),
        F.greatest(F.max(tpr - fpr), F.lit(0.0)).alias("best_gap"),
    )
    out = sizes.join(alone, "feature", "left").join(on_support, "feature", "left").select(
        "feature", (F.col("n_support") / F.col("N")).alias("support_benign"), (F.col("p_support") / F.col("P")).alias("support_attack"),
        F.coalesce("recall_alone", F.lit(0.0)).alias("recall_alone"), F.coalesce("best_gap", F.lit(0.0)).alias("best_gap"),
        "auc_on_support", "ap_on_support")
    share = F.lit(False) if system_recall is None else F.col("recall_alone") >= 0.25 * system_recall
    return out.withColumn("flagged", share | F.coalesce(F.col("auc_on_support") >= 0.90, F.lit(False)))


def flag_holdout(events: DataFrame, sealed: DataFrame | None = None, withheld: Mapping[str, str] | None = None, tie: str = "event_id") -> DataFrame:
    """Add ``holdout``: sealed pool, a sealed composition, or a withheld slot value in the composition."""
    out = events
    composed = F.lit(False)
    if sealed is not None:
        marked = sealed.select(F.col("composition").alias("attack_grammar_str")).distinct().withColumn("__sealed", F.lit(True))
        out = lookup(out, marked, ["attack_grammar_str"], tie)  # benign rows share one string, which is salted
        composed = F.coalesce(F.col("__sealed"), F.lit(False))
    for slot, value in (withheld or {}).items():
        composed = composed | F.col("attack_grammar_str").contains(f"{slot}={value}")
    return out.withColumn("holdout", (F.col("entity_pool") == "sealed") | composed).drop("__sealed")


def partition_training(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trainable, withheld) rows by the holdout flag."""
    return events.filter(~F.col("holdout")), events.filter(F.col("holdout"))
