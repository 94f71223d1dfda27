"""From component scores to actions: rank fusion, calibration, capacity, action bands, reason codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import catalogue as C
from tidemark.operators.calibration import calibrate, fit_isotonic  # noqa: F401
from tidemark.operators.metrics import curve, curve_metrics, recall_at_fpr_from
from tidemark.plans.cut import cut
from tidemark.plans.values import below, exact_quantiles, lookup, rank_against, settled, sums_at_or_above, value_table, with_total
from tidemark.sources.versions import load_set, save_set

c = F.col

# Component weights, tail floor, costs, capacity, friction caps, action ladder.
COMPONENTS = ("g1", "g2_conformal", "g2_density", "sketch", "gate_b")
WEIGHTS = {"g1": 0.62, "g2_conformal": 0.10, "g2_density": 0.06, "sketch": 0.10, "gate_b": 0.12}
TAIL_EPS = 1e-3
REFERENCE_VOLUME = 10_000_000
ALERT_BUDGET = 40 * 60 * 1 / REFERENCE_VOLUME
FRICTION_CAPS = {
    "card-cnp-3ds": 0.060, "card-cnp-keyed": 0.060, "card-cp-emv": 0.010, "card-clearing-dispute": 0.020,
    "card-token-provisioning": 0.040, "upi-pay": 0.008, "upi-collect": 0.015, "upi-autopay-mandate": 0.010,
    "a2a-credit-transfer": 0.020, "upi-lite-offline": 0.004, "aeps-microatm": 0.010, "agentic-commerce": 0.030,
}
DEFAULT_FRICTION_CAP = 0.020
LADDER = {  # rail: (friction, review, decline)
    "card-cnp-3ds": ("threeds_challenge", "review", "decline"), "card-cnp-keyed": ("threeds_challenge", "review", "decline"),
    "card-cp-emv": ("refer", "review", "decline"), "card-clearing-dispute": ("review", "review", "review"),
    "card-token-provisioning": ("threeds_challenge", "review", "decline"), "upi-pay": ("interstitial", "review", "cooling_delay"),
    "upi-collect": ("collect_suppress", "review", "collect_suppress"), "upi-autopay-mandate": ("mandate_refuse", "review", "mandate_refuse"),
    "a2a-credit-transfer": ("name_mismatch_warn", "review", "hold"), "upi-lite-offline": ("interstitial", "review", "cooling_delay"),
    "aeps-microatm": ("refer", "review", "decline"), "agentic-commerce": ("mandate_refuse", "review", "mandate_refuse"),
}
FAMILY_CODE = {
    "velocity_panel": "G1_VELOCITY_SELF_SPIKE", "velocity_distinct": "G1_FANOUT_DEGREE", "temporal": "G1_TEMPORAL_UNIFORMITY",
    "sequence_artefacts": "G1_RETRY_CHAIN", "trust_envelope": "G1_TRUST_TELEMETRY_IMPLAUSIBLE", "mandate_deltas": "G1_MANDATE_HEADROOM",
    "threshold_geometry": "G1_THRESHOLD_HUGGING", "cross_message": "G1_CLEARING_DIVERGENCE", "graph_sketches": "G1_FANOUT_DEGREE",
    "beneficiary_side": "GB_IN_OUT_SKEW", "onboarding_cohort": "G1_ONBOARDING_COHORT", "entity_age": "G1_COLD_ENTITY_PRIOR",
    "habit_deviation": "G1_HABIT_DEVIATION", "merchant_side": "G1_MERCHANT_RAMP", "device_session": "G1_IDENTITY_TRANSITION",
    "rail_context": "G1_INCUMBENT_AGREES", "channel_context": "G1_INCUMBENT_AGREES",
}


@dataclass(frozen=True)
class Costs:
    """Per-event costs of the four actions."""

    fraud_multiplier: float = 1.0
    fraud_handling: float = 350.0
    interchange_bps: float = 90.0
    false_decline: float = 4200.0
    abandonment: float = 0.11
    friction: float = 45.0
    review: float = 180.0
    wrong_rate: float = 0.08

    def loss(self, amount: Column) -> Column:
        return amount * self.fraud_multiplier + self.fraud_handling

    def fee(self, amount: Column) -> Column:
        return amount * (self.interchange_bps / 10_000.0)

    def approve(self, amount: Column, fraud: Column) -> Column:
        return F.when(fraud, self.loss(amount)).otherwise(-self.fee(amount))

    def decline(self, amount: Column, fraud: Column) -> Column:
        return F.when(fraud, 0.0).otherwise(self.false_decline + self.fee(amount))

    def challenge(self, amount: Column, fraud: Column) -> Column:
        kept = F.when(fraud, (1.0 - self.abandonment) * self.loss(amount)).otherwise(self.abandonment * (self.false_decline + self.fee(amount)))
        return self.friction + kept

    def manual(self, amount: Column, fraud: Column) -> Column:
        return self.review + self.wrong_rate * F.when(fraud, self.loss(amount)).otherwise(F.lit(self.false_decline))


# --- fusion --------------------------------------------------------------------------------------------


def ecdf_ranks(rows: DataFrame, fit: DataFrame, components: Sequence[str], key: str = "event_id") -> DataFrame:
    """(key, rank per component) of each score against the stored fit scores, ties at mid-rank, in [0, 1]."""
    def long(df: DataFrame, *keep: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("f"), c(n).cast("double").alias("x")) for n in components])
        return df.select(*keep, F.explode(pairs).alias("e")).select(*keep, c("e.f").alias("f"), c("e.x").alias("x"))
    placed = rank_against(long(rows, key), long(fit), c("x"), c("x"), by=["f"], tie=key)
    mid = (c("n_less") + (c("n_equal") - 1) / 2.0) / F.nullif(c("n_ref") - 1, F.lit(0))
    # Strictly between two fit scores n_equal is 0 and the mid-rank is half a step below n_less.
    r = F.least(F.greatest(mid, F.lit(0.0)), F.lit(1.0))
    return placed.groupBy(key).agg(*[F.max(F.when(c("f") == n, r)).alias(f"r_{n}") for n in components])


def fused(components: Sequence[str], weights: Mapping[str, float] = WEIGHTS, tail: bool = False, eps: float = TAIL_EPS, max_rule: bool = False) -> Column:
    """Weighted mean of the ranks ``r_*`` present; of their log tails with ``tail``; the largest with ``max_rule``."""
    ranks = {n: c(f"r_{n}") for n in components}
    if max_rule:
        return F.greatest(*ranks.values()) if len(ranks) > 1 else next(iter(ranks.values()))
    total = sum(weights.get(n, 0.0) for n in components)
    if total <= 0:
        parts = list(ranks.values())
        return sum(parts[1:], parts[0]) / len(parts)
    if tail:
        ranks = {n: -F.ln(F.least(F.greatest(1.0 - r, F.lit(eps)), F.lit(1.0))) for n, r in ranks.items()}
    parts = [F.lit(weights.get(n, 0.0) / total) * r for n, r in ranks.items()]
    return sum(parts[1:], parts[0])


def contributions(components: Sequence[str], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Map of component to weighted rank."""
    total = sum(weights.get(n, 0.0) for n in components) or 1.0
    return F.map_from_arrays(F.array(*[F.lit(n) for n in components]), F.array(*[F.lit(weights.get(n, 0.0) / total) * c(f"r_{n}") for n in components]))


def saturation_report(ranks: DataFrame, components: Sequence[str]) -> DataFrame:
    """Per component: rows, share at rank 1 and distinct ranks."""
    long = ranks.select(F.explode(F.array(*[F.struct(F.lit(n).alias("component"), c(f"r_{n}").alias("r")) for n in components])).alias("e"))
    counts = long.groupBy("e.component", F.round("e.r", 12).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    top = F.sum(F.when(c("r") >= 1.0 - 1e-12, c("n")).otherwise(0))
    return counts.groupBy("component").agg(F.sum("n").alias("n"), (top / F.sum("n")).alias("share_at_rank_1"), F.count(F.lit(1)).alias("n_distinct_ranks"))


# The fusion arms.
_DROP = {"g1": 0.62, "g2_conformal": 0.10, "g2_density": 0.06, "sketch": 0.0, "gate_b": 0.0}
ARMS: dict[str, tuple[dict[str, float], bool]] = {
    "current": (WEIGHTS, False), "g1_only": ({"g1": 1.0}, False), "drop_dead_channels": (_DROP, False),
    "g1_conformal_90_10": ({"g1": 0.90, "g2_conformal": 0.10}, False), "g1_conformal_75_25": ({"g1": 0.75, "g2_conformal": 0.25}, False),
    "equal": (dict.fromkeys(COMPONENTS, 1.0), False), "fisher_current_weights": (WEIGHTS, True), "fisher_drop_dead": (_DROP, True),
}


def fusion_arm_grid(ranks: DataFrame, target_fpr: float = 0.001, y: str = "y", arms=ARMS) -> DataFrame:
    """Each arm's AP, AUC and recall at FPR on the same labelled rows; all arms in one grouped curve."""
    scores = F.array(*[F.struct(F.lit(a).alias("arm"), F.round(fused(COMPONENTS, w, tail), 9).alias("score")) for a, (w, tail) in arms.items()])
    long = ranks.select(y, F.explode(scores).alias("e")).select(y, "e.arm", "e.score")
    table = curve(long, "score", y, ["arm"])
    return curve_metrics(table, ["arm"]).join(recall_at_fpr_from(table, target_fpr, ["arm"]).select("arm", "recall", "realised_fpr"), "arm")


def select_arm(grid: DataFrame, feasible: DataFrame | None = None, minimum_positives: int = 200, tolerance: float = 0.01, arms=ARMS) -> DataFrame:
    """One row: the chosen arm, or null and a reason.

    Among arms with an intact ladder and within 1 percent of the best AP: fewest channels, no tail, best AP.
    """
    spark = grid.sparkSession
    shape = spark.createDataFrame([(a, sum(v > 0 for v in w.values()), t) for a, (w, t) in arms.items()], "arm string, n_channels int, tail boolean")
    rows = grid.join(F.broadcast(shape), "arm")
    if feasible is not None:
        rows = rows.join(feasible.filter("feasible"), "arm", "left_semi")
    best = rows.agg(F.max("average_precision").alias("top"), F.max("n_pos").alias("np"))
    tied = rows.crossJoin(F.broadcast(best)).filter(c("average_precision") >= c("top") * (1.0 - tolerance))
    pick = tied.groupBy().agg(F.min(F.struct("n_channels", "tail", (-c("average_precision")).alias("ap"), "arm")).alias("b"), F.max("np").alias("np"))
    enough = F.coalesce(c("np") >= minimum_positives, F.lit(False))
    return pick.select(F.when(enough, c("b.arm")).alias("arm"), F.when(~enough, "too few positives to tell arms apart").alias("refused"))


# --- capacity and action table -------------------------------------------------------------------------


def capacity_threshold(rows: DataFrame, score: str, budget: Column, by: Sequence[str] = ()) -> DataFrame:
    """Threshold per group that alerts at most ``budget`` of it, and what it alerts.

    The k-th largest score with k = floor(budget * n); where its tie would exceed k the next higher
    score; where everything is one tie that tie, reported as overflow; with k = 0 nothing is alerted
    and the threshold lies above the maximum (reported with ``above_max``).
    ``budget`` may use the columns of ``by`` and ``total_n``.
    """
    table = below(value_table(rows, by, -c(score), __n=F.lit(1)), __above="__n")
    table = with_total(table, total_n="__n").select(*[c(f"__grp.{b}").alias(b) for b in by], (F.lit(0.0) - c("__val")).alias("s"), "__n", "__above", "total_n")
    k = F.floor(budget * c("total_n"))
    reach = c("__above") + c("__n")
    marked = table.withColumn("k", k).withColumn("reach", reach)
    out = marked.groupBy(*by).agg(
        F.max("total_n").alias("n"), F.max("k").alias("k"), F.max("s").alias("top"), F.max_by("reach", "s").alias("top_reach"),
        F.min(F.when(c("reach") <= c("k"), c("s"))).alias("fit_t"), F.max(F.when(c("reach") <= c("k"), c("reach"))).alias("fit_n"),
        F.max(F.when(c("reach") >= c("k"), c("s"))).alias("kth"))
    none = c("k") <= 0
    over = ~none & c("fit_t").isNull()
    alerts = F.when(none, F.lit(0)).when(over, c("top_reach")).otherwise(c("fit_n"))
    return out.select(
        *by, F.when(none | over, c("top")).otherwise(c("fit_t")).alias("threshold"), none.alias("above_max"), over.alias("overflow"),
        alerts.cast("long").alias("n_alerts"), "n", (alerts / c("n")).alias("realised_share"))


def friction_cap(rail: Column) -> Column:
    return S.mapped(rail, FRICTION_CAPS, DEFAULT_FRICTION_CAP)


def _next_up(v: Column) -> Column:
    """A value just above, far below any gap between scores."""
    return v + F.greatest(F.abs(v) * 1e-12, F.lit(1e-12))


def total_cost_at(rows: DataFrame, candidates: DataFrame, t_friction: Column, costs: Costs, score: str, amount: str, y: str) -> DataFrame:
    """(q_idx, t, cost) when declining at each candidate and challenging from ``t_friction`` up to it."""
    fraud = c(y) == 1
    known = rows.filter(c(y) >= 0)
    a = c(amount)
    below_cost = F.when(c(score) >= t_friction, costs.challenge(a, fraud)).otherwise(costs.approve(a, fraud))
    base = known.agg(F.sum(below_cost).alias("__base"))
    moved = sums_at_or_above(known, c(score), candidates, __moved=costs.decline(a, fraud) - below_cost)
    return moved.crossJoin(F.broadcast(base)).select("q_idx", "t", (c("__base") + c("__moved")).alias("cost"))


def fit_action_table(rows: DataFrame, score: str = "score", rail: str = "rail", amount: str = "amount", y: str = "y",
                     costs: Costs = Costs(), budget: float = ALERT_BUDGET) -> DataFrame:
    """Thresholds per rail: ``t_friction <= t_review <= t_decline``, each fixed by its own constraint.

    Decline minimises total cost over 40 tail quantiles at or above the median provisional friction
    point; review spends the alert budget on the band below decline; friction spends each rail's cap on
    the band below review.
    """
    # Four columns are kept; each step below returns one row, so the lineage never nests.
    live = cut(rows.select(score, rail, amount, y))
    at = lambda df: F.when(c("above_max"), _next_up(c("threshold"))).otherwise(c("threshold"))
    first = capacity_threshold(live, score, friction_cap(c(rail)), [rail])
    t_fr = first.agg(F.percentile(at(first), 0.5)).first()[0]
    step = (0.99999 - 0.90) / 39
    cands = exact_quantiles(live, c(score), [*[0.90 + i * step for i in range(40)], 0.999]).select("q_idx", c("value").alias("t"))
    cost = total_cost_at(live, cands, F.lit(t_fr), costs, score, amount, y)
    # Equal costs go to the lowest candidate, as in a sweep upwards; rounding hides summation order.
    swept = F.when((c("t") >= t_fr) & (c("q_idx") < 40), F.struct(F.round("cost", 4).alias("cost"), c("t")))
    best = cost.agg(F.min(swept).alias("b"), F.max(F.when(c("q_idx") == 40, c("t"))).alias("q999")).first()
    t_decline = max(best["q999"] if best["b"] is None else best["b"]["t"], t_fr)
    declined = live.agg(F.avg(S.flag(c(score) >= t_decline))).first()[0]
    review = capacity_threshold(live, score, F.lit(min(1.0, budget + declined)))
    t_review = min(max(review.select(at(review)).first()[0], t_fr), t_decline)
    over = live.groupBy(rail).agg(F.avg(S.flag(c(score) >= t_review)).alias("__over"))
    second = capacity_threshold(lookup(live.withColumn("__row", F.xxhash64(*live.columns)), over, [rail], "__row").filter(c(rail).isNotNull()), score, F.least(F.lit(1.0), friction_cap(c(rail)) + c("__over")), [rail, "__over"])
    fr = F.least(at(second), F.lit(t_review))
    table = second.select(rail, fr.alias("t_friction"), F.greatest(F.lit(t_review), fr).alias("t_review"))
    return table.withColumn("t_decline", F.greatest(F.lit(t_decline), c("t_review")))


def collapsed_bands(table: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    return table.withColumns({"review_is_friction": F.abs(c("t_review") - c("t_friction")) <= tolerance,
                              "decline_is_review": F.abs(c("t_decline") - c("t_review")) <= tolerance})


def with_band(rows: DataFrame, table: DataFrame, score: str = "score", rail: str = "rail", guard: Column | None = None, abstained: Column | None = None) -> DataFrame:
    """Add ``band`` and ``action``: rail thresholds (a rail the fit never saw takes the medians), guards and abstention."""
    usual = table.agg(*[F.percentile(t, 0.5).alias(f"__d_{t}") for t in ("t_friction", "t_review", "t_decline")])
    joined = lookup(rows.withColumn("__row", F.xxhash64(score, rail)), table, [rail], "__row").drop("__row").crossJoin(F.broadcast(usual))
    t = {n: F.coalesce(c(n), c(f"__d_{n}")) for n in ("t_friction", "t_review", "t_decline")}
    band = S.first_match([(c(score) >= t["t_decline"], "auto_decline"), (c(score) >= t["t_review"], "review"), (c(score) >= t["t_friction"], "friction")], F.lit("approve"))
    if guard is not None:
        band = F.when(guard, "auto_decline").otherwise(band)
    out = joined.withColumn("band", band).drop(*t, *[f"__d_{n}" for n in t])
    if abstained is not None:
        out = out.withColumn("band", F.when(abstained & (c("band") == "approve"), "friction").otherwise(c("band")))
    return out.withColumn("action", action_for(c(rail), c("band")))


def action_for(rail: Column, band: Column) -> Column:
    step = lambda i, name: S.mapped(rail, {r: v[i] for r, v in LADDER.items()}, name)
    return S.first_match([(band == "approve", "approve"), (band == "friction", step(0, "friction")), (band == "review", step(1, "review")),
                          (band == "auto_decline", step(2, "decline"))], band)


def band_decomposition(banded: DataFrame, reference_volume: int = REFERENCE_VOLUME) -> DataFrame:
    total = banded.agg(F.count(F.lit(1)).alias("__n"))
    share = c("n") / c("__n")
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select(
        "band", "n", share.alias("share"), F.round(share * reference_volume).cast("long").alias("scaled_daily_count"))


def band_diagnosis(banded: DataFrame, rail: str = "rail", score: str = "score", y: str = "y") -> DataFrame:
    """Per rail: band shares, distinct scores and visible positives."""
    share = lambda b: F.avg(S.flag(c("band") == b)).alias(f"share_{b}")
    return banded.groupBy(rail).agg(F.count(F.lit(1)).alias("n"), *[share(b) for b in ("approve", "friction", "review", "auto_decline")],
                                    F.countDistinct(score).alias("n_distinct_scores"), F.sum((c(y) == 1).cast("long")).alias("n_visible_positives"))


def outcome_split(banded: DataFrame, attack: str = "is_attack", abstained: str = "abstained") -> DataFrame:
    """Attacks partitioned into caught, abstained, blocked by a guard, and slipped."""
    state = S.first_match([(c("guard"), "blocked"), (c(abstained), "abstained"), (c("band") != "approve", "caught")], F.lit("slipped"))
    return banded.filter(c(attack)).groupBy(state.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def value_stopped(banded: DataFrame, amount: str = "amount", y: str = "y") -> DataFrame:
    """Fraud value attempted and stopped, and good value declined or challenged."""
    fraud, acted = c(y) == 1, c("band") != "approve"
    s = lambda cond: F.sum(F.when(cond, c(amount)).otherwise(0.0))
    return banded.agg(s(fraud).alias("fraud_attempted"), s(fraud & acted).alias("fraud_stopped"), s(~fraud & (c("band") == "auto_decline")).alias("good_declined"),
                      s(~fraud & (c("band") == "friction")).alias("good_challenged"), F.sum((fraud & acted).cast("long")).alias("n_fraud_stopped"))


# --- abstention and reason codes -----------------------------------------------------------------------


def abstain(p: Column, density: Column | None = None, alpha: float = 0.02) -> Column:
    out = p <= alpha
    return out if density is None else out | (density >= 1.0)


def reason_codes(band: Column, abstained: Column, p: Column, density: Column, attributions: Column, guard_codes: Column, alpha: float = 0.02) -> Column:
    """Guard codes, the families of positive top attributions, novelty codes; never empty on an actioned row."""
    family_of = {n: FAMILY_CODE[f] for n, (f, _) in C.FEATURES.items() if f in FAMILY_CODE}
    names = F.transform(F.filter(F.array_sort(F.transform(F.map_entries(attributions), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("f")))),
                                 lambda a: a["neg"] < 0), lambda a: S.mapped(a["f"], family_of))
    from_model = F.when(band != "approve", F.filter(names, lambda n: n.isNotNull())).otherwise(F.array().cast("array<string>"))
    novel, dense = abstained & (p <= alpha), abstained & (density >= 1.0)
    codes = F.array_distinct(F.concat(guard_codes, from_model, F.array_compact(F.array(F.when(novel, "G2_CONFORMAL_NOVEL"), F.when(dense, "G2_DENSITY_OUTLIER")))))
    empty = F.size(codes) == 0
    return F.when(empty & abstained & ~novel & ~dense, F.array(F.lit("G2_ABSTAIN_UNATTRIBUTED"))).when(
        empty & (band != "approve"), F.array(F.lit("POLICY_RAIL_LADDER"))).otherwise(codes)


def unknown_codes(rows: DataFrame, codes: str, vocabulary: Sequence[str]) -> DataFrame:
    """Codes in use that the fixed vocabulary lacks; must be empty."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(v,) for v in vocabulary], "code string")
    return rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(known), "code", "left_anti")


def explain_codes(rows: DataFrame, codes: str, catalogue: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per code with its text and what to do about it."""
    return rows.select(key, F.posexplode(codes).alias("position", "code")).join(F.broadcast(catalogue), "code", "left")


@dataclass(frozen=True)
class Bundle:
    """Everything scoring needs, as tables: component fit scores, action table, calibration knots."""

    fit_scores: DataFrame
    action_table: DataFrame
    calibration: DataFrame | None = None
    components: Sequence[str] = COMPONENTS
    view: str = "issuer"
    model_version: str = ""

    def save(self, folder: str) -> int:
        """Publish as the next version of the folder; its number."""
        tables = {"fit_scores": self.fit_scores, "action_table": self.action_table}
        if self.calibration is not None:
            tables["calibration"] = self.calibration
        return save_set(self.fit_scores.sparkSession, folder, tables, {"components": list(self.components), "view": self.view, "model_version": self.model_version})

    @classmethod
    def load(cls, spark, folder: str, version: int | None = None) -> Bundle:
        """A published version, the latest by default; refused where its tables are not the ones that were published."""
        tables, meta = load_set(spark, folder, version)
        return cls(tables["fit_scores"], tables["action_table"], tables.get("calibration"), tuple(meta["components"]), meta["view"], meta["model_version"])


def score_batch(rows: DataFrame, bundle: Bundle, components: Sequence[str] | None = None, guards: DataFrame | None = None, guards_only: bool = False,
                alpha: float = 0.02, key: str = "event_id") -> DataFrame:
    """Ranks, fused and calibrated score, abstention, band, action and reason codes of scored rows.

    ``rows`` carries the components, ``rail``, ``conformal_p`` and (optionally) ``attributions``.
    ``guards`` comes from ``rules.structural_guards``; with ``guards_only`` nothing else decides.
    """
    components = bundle.components if components is None else components
    empty = F.array().cast("array<string>")
    out = rows
    if guards is not None:
        out = out.join(guards.select(key, c("reason_codes").alias("guard_codes"), c("refuse").alias("guard")), key, "left")
    else:
        out = out.withColumns({"guard_codes": empty, "guard": F.lit(False)})
    out = out.withColumns({"guard_codes": F.coalesce("guard_codes", empty), "guard": F.coalesce("guard", F.lit(False))})
    if guards_only:
        band = F.when(c("guard"), "auto_decline").otherwise("approve")
        return out.withColumns({"score": S.flag(c("guard")), "abstained": F.lit(False), "band": band, "action": action_for(c("rail"), band),
                                "reason_codes": F.concat("guard_codes", F.array(F.lit("POLICY_KILL_SWITCH_G0_ONLY")))})
    out = settled(out)  # ranked, joined to its ranks and counted by score and by rail: guards and ranks are worked out once
    ranks = ecdf_ranks(out.select(key, *components), bundle.fit_scores, components, key)
    out = settled(out.join(ranks, key).withColumn("fused", fused(components)))
    out = settled(calibrate(bundle.calibration, out, "fused", "score"))
    out = out.withColumn("abstained", abstain(c("conformal_p"), c("g2_density") if "g2_density" in components else None, alpha))
    out = with_band(out, bundle.action_table, guard=c("guard"), abstained=c("abstained"))
    attributions = c("attributions") if "attributions" in rows.columns else F.create_map().cast("map<string,double>")
    density = c("g2_density") if "g2_density" in components else F.lit(0.0)
    return out.withColumns({
        "contributions": contributions(components),
        "reason_codes": reason_codes(c("band"), c("abstained"), c("conformal_p"), density, attributions, c("guard_codes"), alpha),
    })
