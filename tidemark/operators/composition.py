"""Analytics over six-slot compositions: type checks, cells, coverage, siblings, distinctness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.plans.components import components
from tidemark.schema import RAILS

c = F.col

# The slots in order and their values.
SLOTS = {
    "ACCESS": ("stolen-credential", "enumerated-credential", "synthetic-identity", "authorised-but-deceived-payer", "account-takeover",
               "merchant-onboarding-fraud", "delegated-agent-mandate", "first-party-misuse"),
    "TRUST": ("tokenised", "threeds-authenticated", "mandated", "cdcvm", "agent-attested", "kyc-passed", "aged-account"),
    "RAIL": RAILS,
    "EVASION": ("velocity-splitting", "threshold-hugging", "trust-inheritance", "graph-camouflage", "label-attack", "oracle-probing",
                "low-visibility-rail", "cohort-splitting"),
    "MONETISATION": ("goods-resale", "mule-chain-cashout", "biller-giftcard-resale", "merchant-settlement", "credit-line-drawdown",
                     "refund-chargeback-recovery", "crypto-offramp"),
    "LABEL": ("victim-complains", "victim-blames-self", "never-labelled", "label-poisoned", "label-delayed"),
}
SLOT_ORDER = tuple(SLOTS)

# Id, kind, antecedent slot and value, consequent slot and its values.
CONSTRAINTS = (
    ("TY-T01", "requires", "TRUST", "cdcvm", "RAIL", ("card-cp-emv", "card-token-provisioning", "card-cnp-3ds", "upi-pay", "upi-lite-offline",)),
    ("TY-T02", "requires", "TRUST", "threeds-authenticated", "RAIL", ("card-cnp-3ds", "card-token-provisioning", "card-clearing-dispute",)),
    ("TY-T03", "requires", "TRUST", "mandated", "RAIL",
     ("upi-autopay-mandate", "card-cnp-3ds", "card-cnp-keyed", "card-clearing-dispute", "agentic-commerce", "a2a-credit-transfer",)),
    ("TY-T04", "requires", "TRUST", "agent-attested", "RAIL", ("agentic-commerce", "card-cnp-3ds", "card-cnp-keyed", "upi-pay",)),
    ("TY-T05", "requires", "TRUST", "tokenised", "RAIL",
     ("card-cnp-3ds", "card-cnp-keyed", "card-cp-emv", "card-token-provisioning", "card-clearing-dispute", "agentic-commerce",)),
    ("TY-T06", "requires", "TRUST", "kyc-passed", "RAIL",
     ("upi-pay", "upi-collect", "upi-autopay-mandate", "a2a-credit-transfer", "upi-lite-offline", "aeps-microatm", "card-token-provisioning",)),
    ("TY-T07", "requires", "TRUST", "mandated", "MONETISATION",
     ("merchant-settlement", "credit-line-drawdown", "biller-giftcard-resale", "goods-resale",)),
    ("TY-A01", "requires", "ACCESS", "merchant-onboarding-fraud", "RAIL",
     ("card-cnp-keyed", "card-cnp-3ds", "card-cp-emv", "card-clearing-dispute", "upi-collect", "upi-pay", "upi-autopay-mandate", "a2a-credit-transfer", "agentic-commerce",)),
    ("TY-A02", "requires", "ACCESS", "authorised-but-deceived-payer", "RAIL",
     ("upi-pay", "upi-collect", "upi-autopay-mandate", "a2a-credit-transfer", "upi-lite-offline", "card-cnp-3ds", "card-cnp-keyed", "agentic-commerce", "aeps-microatm",)),
    ("TY-A03", "requires", "ACCESS", "first-party-misuse", "RAIL",
     ("card-cnp-3ds", "card-cnp-keyed", "card-cp-emv", "card-clearing-dispute", "upi-pay", "agentic-commerce",)),
    ("TY-A04", "requires", "ACCESS", "enumerated-credential", "RAIL",
     ("card-cnp-keyed", "card-cnp-3ds", "card-cp-emv", "upi-collect", "a2a-credit-transfer",)),
    ("TY-A05", "requires", "ACCESS", "delegated-agent-mandate", "RAIL",
     ("agentic-commerce", "card-cnp-3ds", "card-cnp-keyed", "upi-autopay-mandate",)),
    ("TY-A06", "forbids", "ACCESS", "first-party-misuse", "TRUST", ("kyc-passed",)),
    ("TY-A07", "forbids", "ACCESS", "enumerated-credential", "TRUST", ("cdcvm", "agent-attested", "mandated", "threeds-authenticated",)),
    ("TY-A08", "requires", "ACCESS", "merchant-onboarding-fraud", "TRUST", ("kyc-passed", "aged-account", "mandated",)),
    ("TY-A09", "requires", "ACCESS", "delegated-agent-mandate", "TRUST", ("agent-attested", "mandated", "tokenised",)),
    ("TY-A10", "forbids", "ACCESS", "account-takeover", "TRUST", ("kyc-passed",)),
    ("TY-A11", "forbids", "ACCESS", "stolen-credential", "TRUST", ("kyc-passed", "agent-attested",)),
    ("TY-A12", "forbids", "ACCESS", "authorised-but-deceived-payer", "TRUST", ("agent-attested",)),
    ("TY-A13", "requires", "ACCESS", "synthetic-identity", "LABEL", ("never-labelled", "label-delayed", "label-poisoned",)),
    ("TY-A14", "requires", "ACCESS", "first-party-misuse", "LABEL", ("label-poisoned", "victim-complains",)),
    ("TY-A15", "forbids", "ACCESS", "stolen-credential", "LABEL", ("never-labelled",)),
    ("TY-A16", "forbids", "ACCESS", "account-takeover", "LABEL", ("never-labelled",)),
    ("TY-A17", "forbids", "ACCESS", "enumerated-credential", "LABEL", ("never-labelled",)),
    ("TY-T08", "requires", "LABEL", "never-labelled", "TRUST", ("kyc-passed", "aged-account", "mandated",)),
    ("TY-A18", "requires", "ACCESS", "first-party-misuse", "MONETISATION", ("goods-resale", "refund-chargeback-recovery", "credit-line-drawdown",)),
    ("TY-A19", "requires", "ACCESS", "merchant-onboarding-fraud", "MONETISATION",
     ("merchant-settlement", "biller-giftcard-resale", "crypto-offramp", "mule-chain-cashout",)),
    ("TY-A20", "requires", "ACCESS", "synthetic-identity", "MONETISATION",
     ("credit-line-drawdown", "goods-resale", "mule-chain-cashout", "merchant-settlement", "biller-giftcard-resale",)),
    ("TY-E01", "requires", "EVASION", "low-visibility-rail", "RAIL",
     ("upi-lite-offline", "aeps-microatm", "upi-collect", "agentic-commerce", "a2a-credit-transfer",)),
    ("TY-E02", "requires", "EVASION", "trust-inheritance", "RAIL",
     ("card-cnp-3ds", "card-token-provisioning", "card-cp-emv", "upi-autopay-mandate", "agentic-commerce", "card-clearing-dispute", "a2a-credit-transfer",)),
    ("TY-E03", "requires", "EVASION", "label-attack", "RAIL",
     ("card-clearing-dispute", "card-cnp-3ds", "card-cnp-keyed", "upi-pay", "a2a-credit-transfer", "upi-autopay-mandate",)),
    ("TY-E04", "requires", "EVASION", "oracle-probing", "RAIL",
     ("card-cnp-keyed", "card-cnp-3ds", "card-cp-emv", "upi-collect", "a2a-credit-transfer", "agentic-commerce",)),
    ("TY-E05", "requires", "EVASION", "graph-camouflage", "RAIL",
     ("upi-pay", "a2a-credit-transfer", "upi-collect", "upi-lite-offline", "card-token-provisioning", "aeps-microatm",)),
    ("TY-E06", "requires", "EVASION", "label-attack", "LABEL", ("label-poisoned", "never-labelled", "label-delayed",)),
    ("TY-M01", "requires", "MONETISATION", "merchant-settlement", "RAIL",
     ("card-cnp-keyed", "card-cnp-3ds", "card-cp-emv", "card-clearing-dispute", "upi-collect", "upi-pay", "upi-autopay-mandate", "agentic-commerce",)),
    ("TY-M02", "requires", "MONETISATION", "credit-line-drawdown", "RAIL",
     ("card-cnp-3ds", "card-cnp-keyed", "card-cp-emv", "card-clearing-dispute", "card-token-provisioning", "upi-pay", "upi-autopay-mandate",)),
    ("TY-M03", "requires", "MONETISATION", "refund-chargeback-recovery", "RAIL",
     ("card-clearing-dispute", "card-cnp-3ds", "card-cnp-keyed", "upi-pay", "a2a-credit-transfer",)),
    ("TY-M04", "requires", "MONETISATION", "mule-chain-cashout", "RAIL",
     ("upi-pay", "upi-collect", "a2a-credit-transfer", "upi-lite-offline", "aeps-microatm", "card-token-provisioning", "card-cnp-keyed", "card-cnp-3ds",)),
    ("TY-M05", "forbids", "MONETISATION", "biller-giftcard-resale", "RAIL", ("aeps-microatm", "card-clearing-dispute",)),
    ("TY-M06", "requires", "MONETISATION", "goods-resale", "RAIL",
     ("card-cnp-3ds", "card-cnp-keyed", "card-cp-emv", "card-token-provisioning", "upi-pay", "upi-collect", "agentic-commerce", "card-clearing-dispute",)),
    ("TY-M07", "requires", "MONETISATION", "crypto-offramp", "RAIL",
     ("upi-pay", "a2a-credit-transfer", "card-cnp-keyed", "card-cnp-3ds", "upi-collect",)),
)

# Projections onto cell axes, minimum depths, infeasible cell patterns, sealed families.
RAIL_CLASS = {
    "card-cnp-3ds": "card-auth", "card-cnp-keyed": "card-auth", "card-cp-emv": "card-auth", "card-clearing-dispute": "card-post-auth",
    "card-token-provisioning": "card-token", "upi-pay": "upi-realtime", "upi-collect": "upi-realtime", "upi-autopay-mandate": "mandate-recurring",
    "a2a-credit-transfer": "a2a-assisted", "upi-lite-offline": "upi-realtime", "aeps-microatm": "a2a-assisted", "agentic-commerce": "mandate-recurring",
}
LOCUS = {
    "stolen-credential": "stolen-credential", "enumerated-credential": "stolen-credential", "synthetic-identity": "synthetic-identity",
    "authorised-but-deceived-payer": "authorised-but-deceived-victim", "account-takeover": "stolen-credential",
    "merchant-onboarding-fraud": "synthetic-identity", "delegated-agent-mandate": "delegated-agent-mandate",
    "first-party-misuse": "authorised-but-deceived-victim",
}
RAIL_CLASSES = ("card-auth", "card-post-auth", "card-token", "upi-realtime", "mandate-recurring", "a2a-assisted")
LOCI = ("stolen-credential", "synthetic-identity", "authorised-but-deceived-victim", "delegated-agent-mandate")
DEPTHS = (1, 2, 3)
MONETISATION_DEPTH = {"goods-resale": 1, "mule-chain-cashout": 2, "biller-giftcard-resale": 2, "merchant-settlement": 2, "credit-line-drawdown": 1,
                      "refund-chargeback-recovery": 2, "crypto-offramp": 2}
TWO_STAGE_RAILS = ("card-clearing-dispute", "card-token-provisioning", "upi-autopay-mandate", "agentic-commerce")
TWO_STAGE_ACCESS = ("synthetic-identity", "delegated-agent-mandate")
INFEASIBLE = {
    "FC-01": {"evasion": "graph-camouflage", "depth": 1}, "FC-02": {"rail_class": "card-post-auth", "depth": 1},
    "FC-03": {"rail_class": "card-token", "depth": 1}, "FC-04": {"rail_class": "mandate-recurring", "depth": 1},
    "FC-05": {"locus": "delegated-agent-mandate", "rail_class": "card-post-auth"}, "FC-06": {"locus": "delegated-agent-mandate", "rail_class": "a2a-assisted"},
    "FC-08": {"rail_class": "card-token", "evasion": "low-visibility-rail"}, "FC-09": {"rail_class": "card-post-auth", "evasion": "oracle-probing"},
    "FC-10": {"locus": "synthetic-identity", "depth": 1}, "FC-11": {"locus": "delegated-agent-mandate", "depth": 1},
}
SEALED = {  # family: (ACCESS, RAIL, EVASION, depth)
    "SEALED-01": ("stolen-credential", "card-cnp-3ds", "trust-inheritance", 2), "SEALED-02": ("enumerated-credential", "card-cnp-keyed", "oracle-probing", 3),
    "SEALED-03": ("stolen-credential", "card-token-provisioning", "graph-camouflage", 2), "SEALED-04": ("authorised-but-deceived-payer", "a2a-credit-transfer", "graph-camouflage", 3),
    "SEALED-05": ("authorised-but-deceived-payer", "upi-pay", "graph-camouflage", 3), "SEALED-06": ("synthetic-identity", "upi-pay", "cohort-splitting", 2),
    "SEALED-07": ("synthetic-identity", "a2a-credit-transfer", "graph-camouflage", 3), "SEALED-08": ("stolen-credential", "upi-autopay-mandate", "threshold-hugging", 2),
    "SEALED-09": ("stolen-credential", "card-clearing-dispute", "label-attack", 2), "SEALED-10": ("delegated-agent-mandate", "agentic-commerce", "trust-inheritance", 2),
    "SEALED-11": ("stolen-credential", "aeps-microatm", "low-visibility-rail", 2), "SEALED-12": ("synthetic-identity", "upi-pay", "label-attack", 3),
}
WITHHELD_EVASION = "low-visibility-rail"
CELL_PRESERVING, CELL_CROSSING = ("TRUST", "MONETISATION", "LABEL"), ("EVASION",)


def raw_space(spark: SparkSession) -> DataFrame:
    """Every combination of slot values."""
    return _product(spark, SLOTS)


def _product(spark: SparkSession, axes: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of short literal lists, as nested explodes of one row."""
    out = spark.range(0, 1, 1, 1)
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("id")


def to_text(sep: str = "/") -> Column:
    return F.concat_ws(sep, *[F.concat(F.lit(f"{s}="), c(s)) for s in SLOT_ORDER])


def parse(df: DataFrame, column: str, sep: str = "/") -> DataFrame:
    """Six slot columns from ``SLOT=value/...`` strings, whatever the slot order."""
    pairs = df.withColumn("__m", F.str_to_map(c(column), F.lit(sep), F.lit("=")))
    return pairs.withColumns({s: c("__m")[s] for s in SLOT_ORDER}).drop("__m")


def _holds(con) -> Column:
    _, kind, ws, wv, ts, tv = con
    inside = c(ts).isin(*tv)
    return (c(ws) == wv) & (~inside if kind == "requires" else inside)


def violations(df: DataFrame) -> DataFrame:
    """Add ``violated``: the sorted ids of broken constraints, one projection for all 41."""
    ids = F.array_compact(F.array(*[F.when(_holds(con), con[0]) for con in CONSTRAINTS]))
    return df.withColumn("violated", F.array_sort(ids))


def explain_violations(df: DataFrame, key: str) -> DataFrame:
    """(key, constraint_id, reason): one row per broken constraint, with what it asks and what was found."""
    def reason(con) -> Column:
        _, kind, ws, wv, ts, tv = con
        return F.concat(F.lit(f"{ws}={wv} {kind} {ts} in {'|'.join(tv)}, found "), c(ts))

    found = F.array_compact(F.array(*[
        F.when(_holds(con), F.struct(F.lit(con[0]).alias("constraint_id"), reason(con).alias("reason"))) for con in CONSTRAINTS]))
    return df.select(key, F.inline(found))


def _none(broken: Sequence[Column]) -> Column:
    """No condition is true; a condition over a missing value is not."""
    return reduce(lambda a, b: a & b, [~F.coalesce(x, F.lit(False)) for x in broken], F.lit(True))


def filter_legal(df: DataFrame) -> DataFrame:
    return df.filter(_none([_holds(con) for con in CONSTRAINTS]))


def legal_changes(df: DataFrame, slots: Sequence[str] = SLOT_ORDER) -> tuple[DataFrame, dict[tuple[str, str], Column]]:
    """The frame with a column per slot, and per (slot, value): is the composition legal with that slot changed to the value?

    The constraints that do not name the slot are the same for all its values, so they are looked at once, in the added column;
    of the others only those that the value can break are left.
    """
    out = {}
    for s in slots:
        for v in SLOTS[s]:
            broken = []
            for _, kind, ws, wv, ts, tv in CONSTRAINTS:
                if s == ws and v == wv:
                    inside = c(ts).isin(*tv)
                    broken.append(~inside if kind == "requires" else inside)
                elif s == ts and (v in tv) == (kind == "forbids"):
                    broken.append(c(ws) == wv)
            out[s, v] = c(f"__rest_{s}") & _none(broken)
    return df.withColumns({f"__rest_{s}": _none([_holds(con) for con in CONSTRAINTS if s not in (con[2], con[4])]) for s in slots}), out


def constraint_binds(df: DataFrame) -> DataFrame:
    """Compositions each constraint rejects."""
    return violations(df).select(F.explode("violated").alias("constraint_id")).groupBy("constraint_id").agg(F.count(F.lit(1)).alias("n_bound"))


def slot_marginals(df: DataFrame) -> DataFrame:
    """Counts per slot value."""
    pairs = F.array(*[F.struct(F.lit(s).alias("slot"), c(s).alias("value")) for s in SLOT_ORDER])
    return df.select(F.explode(pairs).alias("e")).groupBy("e.slot", "e.value").agg(F.count(F.lit(1)).alias("n"))


def variants(df: DataFrame, slots: Sequence[str] = SLOT_ORDER) -> DataFrame:
    """Every one-slot change of each composition: adds ``slot``, ``value`` and replaces the slot's column."""
    options = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(v).alias("value")) for s in slots for v in SLOTS[s]])
    out = df.withColumn("__o", F.explode(options)).select("*", "__o.slot", "__o.value").drop("__o")
    was = S.first_match([(c("slot") == s, c(s)) for s in SLOT_ORDER], F.lit(None))
    return out.withColumn("was", was).withColumns({s: F.when(c("slot") == s, c("value")).otherwise(c(s)) for s in SLOT_ORDER})


def legal_values(df: DataFrame, key: str, slots: Sequence[str] = SLOT_ORDER) -> DataFrame:
    """(key, slot, legal_values): the values of each slot that keep the composition legal, the other five fixed."""
    rows, legal = legal_changes(df, slots)
    # One bit a value, in sorted order; rows that share a key join their values.
    ordered = {s: sorted(SLOTS[s]) for s in slots}
    bits = {s: reduce(lambda a, b: a.bitwiseOR(b), [F.when(legal[s, v], 1 << i).otherwise(0) for i, v in enumerate(ordered[s])]) for s in slots}
    held = rows.select(key, *[bits[s].alias(f"__{s}") for s in slots]).groupBy(key).agg(*[F.bit_or(f"__{s}").alias(f"__{s}") for s in slots])
    values = {s: F.array_compact(F.array(*[F.when(c(f"__{s}").bitwiseAND(F.lit(1 << i)) != 0, v) for i, v in enumerate(ordered[s])])) for s in slots}
    told = F.array(*[F.struct(F.lit(s).alias("slot"), values[s].alias("legal_values")) for s in slots])
    return held.select(key, F.inline(told)).filter(F.size("legal_values") > 0)


def min_depth(at: Mapping[str, Column] | None = None) -> Column:
    """The fewest stages of a composition; ``at`` stands for some of its slots."""
    rail, access, evasion, money = ((at or {}).get(s, c(s)) for s in ("RAIL", "ACCESS", "EVASION", "MONETISATION"))
    floor = S.mapped(money, MONETISATION_DEPTH, 1)
    two = rail.isin(*TWO_STAGE_RAILS) | access.isin(*TWO_STAGE_ACCESS) | (evasion == "graph-camouflage")
    return F.greatest(floor, F.when(two, 2).otherwise(1))


def with_axes(df: DataFrame) -> DataFrame:
    return df.withColumns({"rail_class": S.mapped(c("RAIL"), RAIL_CLASS), "locus": S.mapped(c("ACCESS"), LOCUS), "evasion": c("EVASION")})


def cell_id() -> Column:
    return F.concat_ws("|", "rail_class", "locus", "evasion", F.concat(F.lit("d"), c("depth").cast("string")))


def cell_of(df: DataFrame, stages: Column) -> DataFrame:
    """Add the cell of a composition realised in ``stages`` steps (three or more count as three)."""
    return with_axes(df).withColumn("depth", F.least(stages, F.lit(3)).cast("int")).withColumn("cell_id", cell_id())


def occupiable(df: DataFrame) -> DataFrame:
    """One row per composition and admissible depth, with its cell."""
    return with_axes(df).withColumn("depth", F.explode(F.sequence(min_depth(), F.lit(3)))).withColumn("cell_id", cell_id())


def cell_index(df: DataFrame) -> DataFrame:
    """Compositions that can occupy each cell: their number and the first in order."""
    text = to_text()
    return occupiable(df).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_compositions"), F.min(text).alias("first_composition"))


def all_cells(spark: SparkSession) -> DataFrame:
    axes = {"rail_class": RAIL_CLASSES, "locus": LOCI, "evasion": SLOTS["EVASION"], "depth": DEPTHS}
    return _product(spark, axes).withColumn("cell_id", cell_id())


def blocking_rules() -> Column:
    """Array of the infeasibility rules a cell matches."""
    hit = lambda m: reduce(lambda a, b: a & b, [c(k) == v for k, v in m.items()])
    return F.array_compact(F.array(*[F.when(hit(m), i) for i, m in INFEASIBLE.items()]))


def feasible(cells: DataFrame) -> DataFrame:
    return cells.filter(F.size(blocking_rules()) == 0)


def feasibility_audit(cells: DataFrame) -> DataFrame:
    """Per rule: cells matched, and cells nothing else blocks."""
    rows = cells.withColumn("rules", blocking_rules())
    return rows.select(F.explode("rules").alias("rule_id"), (F.size("rules") == 1).alias("alone")).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("cells_matched"), F.sum(c("alone").cast("long")).alias("cells_uniquely_blocked"))


def consistency(reachable: DataFrame, feasible_cells: DataFrame) -> DataFrame:
    """Cells on one side only: reachable yet infeasible, and feasible yet unreached."""
    r, f = reachable.select("cell_id").distinct(), feasible_cells.select("cell_id").distinct()
    return r.subtract(f).withColumn("finding", F.lit("contradiction")).unionByName(f.subtract(r).withColumn("finding", F.lit("unreached")))


def siblings(df: DataFrame, key: str, stages: str = "n_stages", prefer: str = "EVASION") -> DataFrame:
    """The preferred legal one-slot change per composition: the favoured slot first, then slot and value order.

    A candidate must admit the plan's depth.
    """
    options = [(s, v) for s in [prefer, *[s for s in SLOT_ORDER if s != prefer]] for v in SLOTS[s]]  # in order of preference
    rows, legal = legal_changes(df)
    tried = [F.when(legal[s, v] & (c(s) != v) & (c(stages) >= min_depth({s: F.lit(v)})), F.lit(i)) for i, (s, v) in enumerate(options)]
    best = rows.select(key, *SLOT_ORDER, F.coalesce(*tried, F.lit(len(options))).alias("r"))  # one change a row, before rows meet
    table = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(v).alias("value")) for s, v in [*options, ("", "")]])
    moved = best.withColumn("__o", table[c("r")]).select("*", "__o.slot", "__o.value").drop("__o")
    moved = moved.withColumns({s: F.when(c("slot") == s, c("value")).otherwise(c(s)) for s in SLOT_ORDER})
    axes_before = with_axes(df.select(key, *SLOT_ORDER)).select(key, F.concat_ws("|", "rail_class", "locus", "evasion").alias("before"))
    picked = with_axes(moved).groupBy(key).agg(F.min(F.struct(c("r"), c("slot"), c("value"), to_text().alias("sibling"),
                                                           F.concat_ws("|", "rail_class", "locus", "evasion").alias("after"))).alias("b")).filter(c("b.r") < len(options))
    return picked.join(axes_before, key).select(key, "b.slot", "b.value", "b.sibling", (c("b.after") != c("before")).alias("cell_crossing"))


def mutation_category(slot: Column) -> Column:
    return S.first_match([(slot.isin(*CELL_PRESERVING), "always-preserving"), (slot.isin(*CELL_CROSSING), "always-crossing")], F.lit("conditional"))


def mutation_effects(df: DataFrame, key: str) -> DataFrame:
    """(slot, n, n_crossing, category): legal one-slot changes and those that leave the cell; rows that share a key meet."""
    axes = lambda at: F.concat_ws("|", S.mapped(at.get("RAIL", c("RAIL")), RAIL_CLASS), S.mapped(at.get("ACCESS", c("ACCESS")), LOCUS), at.get("EVASION", c("EVASION")))
    before = df.select(key, axes({}).alias("before"))
    rows, legal = legal_changes(df.join(before, key).withColumn("__own", axes({})))
    # Counted in the row: no change is ever a row of its own.
    n = {s: sum((F.coalesce(legal[s, v] & (c(s) != v), F.lit(False)).cast("int") for v in SLOTS[s]), F.lit(0)) for s in SLOT_ORDER}
    crossing = {}
    for s in SLOT_ORDER:
        after = {v: axes({s: F.lit(v)}) if s in ("RAIL", "ACCESS", "EVASION") else c("__own") for v in SLOTS[s]}
        crossing[s] = sum((F.coalesce(legal[s, v] & (c(s) != v) & (after[v] != c("before")), F.lit(False)).cast("int") for v in SLOTS[s]), F.lit(0))
    sums = rows.select(*[n[s].alias(f"n_{s}") for s in SLOT_ORDER], *[crossing[s].alias(f"x_{s}") for s in SLOT_ORDER])
    one = sums.agg(*[F.sum(x).alias(x) for x in sums.columns])
    told = F.array(*[F.struct(F.lit(s).alias("slot"), c(f"n_{s}").alias("n"), c(f"x_{s}").alias("n_crossing")) for s in SLOT_ORDER])
    return one.select(F.inline(told)).filter("n > 0").withColumn("category", mutation_category(c("slot")))


def hamming(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    return sum(((a[s] != b[s]).cast("int") for s in SLOT_ORDER[1:]), (a[SLOT_ORDER[0]] != b[SLOT_ORDER[0]]).cast("int"))


def sealed_family() -> Column:
    """The sealed family a composition belongs to at an admissible depth, else null."""
    cases = [((c("ACCESS") == a) & (c("RAIL") == r) & (c("EVASION") == e) & (min_depth() <= d), f) for f, (a, r, e, d) in SEALED.items()]
    return S.first_match(cases, F.lit(None))


def sealed_members(df: DataFrame) -> DataFrame:
    """Legal compositions withheld from training, by family or by the withheld slot value."""
    rows = filter_legal(df).withColumns({"family": sealed_family(), "withheld_value": c("EVASION") == WITHHELD_EVASION})
    return rows.filter(c("family").isNotNull() | c("withheld_value"))


def sealed_audit(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row per holdout arm, the sealed families and the withheld value: what it holds and what is wrong with it.

    ``df`` are the compositions that can occur, ``seeds`` the ones written by hand.  A family without a legal member,
    or a withheld value that no seed uses, is a holdout in name only.
    """
    arm = f"EVASION={WITHHELD_EVASION}"
    depth = S.mapped(c("family"), {f: d for f, (_, _, _, d) in SEALED.items()}, 0)

    def members(rows: DataFrame) -> DataFrame:
        """(arm, composition, cell), each once; cells at the depth of the family."""
        held = with_axes(sealed_members(rows)).withColumn("depth", depth)
        both = F.array_compact(F.array(
            F.when(c("family").isNotNull(), F.struct(c("family").alias("arm"), cell_id().alias("cell"))),
            F.when(c("withheld_value"), F.struct(F.lit(arm).alias("arm"), F.lit(None).cast("string").alias("cell")))))
        return held.select(to_text().alias("composition"), F.inline(both)).distinct()

    found = members(df).groupBy("arm").agg(F.count(F.lit(1)).alias("n_members"), F.array_join(F.array_sort(F.collect_set("cell")), ",").alias("cells"))
    used = members(seeds).groupBy("arm").agg(F.count(F.lit(1)).alias("n_seeds"))
    arms = df.sparkSession.createDataFrame([(f,) for f in (*SEALED, arm)], "arm string")
    out = arms.join(F.broadcast(found), "arm", "left").join(F.broadcast(used), "arm", "left").fillna({"n_members": 0, "n_seeds": 0, "cells": ""})
    problem = F.when(c("n_members") == 0, "no legal member").when((c("arm") == arm) & (c("n_seeds") == 0), "no seed uses the withheld value").otherwise("")
    return out.withColumn("problem", problem)


def sealed_share(df: DataFrame) -> DataFrame:
    """Distinct legal compositions, those withheld by family, by value and by either, and the share withheld."""
    rows = filter_legal(df).withColumns({"composition": to_text(), "f": sealed_family().isNotNull(), "v": c("EVASION") == WITHHELD_EVASION})
    out = rows.select("composition", "f", "v").distinct().agg(
        F.count(F.lit(1)).alias("n_legal"), F.sum(c("f").cast("long")).alias("n_by_family"), F.sum(c("v").cast("long")).alias("n_by_value"),
        F.sum((c("f") | c("v")).cast("long")).alias("n_withheld"))
    return out.withColumn("share_withheld", F.coalesce(c("n_withheld") / F.nullif(c("n_legal"), F.lit(0)), F.lit(0.0)))


def withhold_mask(rows: DataFrame, composition: str, withheld: DataFrame) -> DataFrame:
    """Flag rows of a withheld composition, by identity of the string."""
    w = withheld.select(c("composition").alias(composition)).distinct().withColumn("withheld", F.lit(True))
    return rows.join(w, composition, "left").fillna({"withheld": False})


# --- archive -------------------------------------------------------------------------------------------


def elite_per_cell(candidates: DataFrame, fitness: str = "fitness", order: str = "seq", seeds: DataFrame | None = None) -> DataFrame:
    """Best feasible candidate per cell; the earlier one keeps a tie.  With evaluations and the emergent flag."""
    rows = candidates.withColumn("__blocked", F.size(blocking_rules()))
    best = rows.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.max_by(F.struct(*[c(n) for n in candidates.columns if n != "cell_id"]), F.when(c("__blocked") == 0, F.struct(c(fitness), -c(order)))).alias("b"),
        F.max(c("__blocked")).alias("__blocked")).filter(c("__blocked") == 0)
    out = best.select("cell_id", "evaluations", "b.*")
    if seeds is None:
        return out
    known = seeds.select("cell_id").distinct().withColumn("__seed", F.lit(True))
    return out.join(known, "cell_id", "left").withColumn("emergent", c("family_id").startswith("GEN-") & c("__seed").isNull()).drop("__seed")


def coverage(elites: DataFrame, n_feasible: int) -> DataFrame:
    n = lambda cond: F.sum(cond.cast("long"))
    return elites.agg(F.count(F.lit(1)).alias("elites"), n(~c("ruined")).alias("solvent"), F.avg("evaluations").alias("mean_evaluations")).select(
        "elites", "solvent", (c("elites") / n_feasible).alias("coverage_all"), (c("solvent") / n_feasible).alias("coverage_solvent"), "mean_evaluations")


def js_pairs(elites: DataFrame, key: str, attribution: str) -> DataFrame:
    """Base-2 Jensen-Shannon divergence of each pair of attribution maps that share a key.

    Maps are normalised and exploded; only pairs with a common key meet (the others diverge by 1).
    Elites number at most one per feasible cell, so pairs are bounded whatever the traffic.
    """
    flat = elites.select(key, F.explode(attribution).alias("k", "v")).withColumn("v", F.greatest(c("v"), F.lit(0.0)))
    total = flat.groupBy(key).agg(F.sum("v").alias("t")).filter("t > 0")
    p = flat.join(total, key).select(key, "k", (c("v") / c("t")).alias("p")).filter("p > 0")
    a, b = p.select(c(key).alias("a"), "k", c("p").alias("pa")), p.select(c(key).alias("b"), "k", c("p").alias("pb"))
    both = a.join(b, "k").filter(c("a") < c("b"))
    # 0.5 * KL(p|m) + 0.5 * KL(q|m): keys on one side only contribute half their mass.
    m = (c("pa") + c("pb")) / 2
    part = (c("pa") * F.log2(c("pa") / m) + c("pb") * F.log2(c("pb") / m)) / 2
    return both.groupBy("a", "b").agg((F.sum(part) + (1 - F.sum("pa")) / 2 + (1 - F.sum("pb")) / 2).alias("js"))


def js_merge(elites: DataFrame, key: str, attribution: str, threshold: float = 0.05) -> DataFrame:
    """(key, component): elites whose attributions are not separable fall together, however long the chain."""
    empty = elites.filter(F.coalesce(F.aggregate(F.map_values(attribution), F.lit(0.0), lambda s, v: s + F.greatest(v, F.lit(0.0))), F.lit(0.0)) <= 0).select(c(key).alias("e"))
    near = js_pairs(elites, key, attribution).filter(c("js") < threshold).select("a", "b")
    # An empty attribution diverges by 0 from every other, so one empty elite links all: one row of the smallest.
    hub = empty.agg(F.min("e").alias("a")).filter("a is not null")
    near = near.unionByName(elites.select(c(key).alias("b")).crossJoin(F.broadcast(hub)).select("a", "b"))
    group = components(near)
    return elites.select(c(key).alias("node")).distinct().join(group, "node", "left").select(
        c("node").alias(key), F.coalesce("component", "node").alias("component"))


def observable_delta(elites: DataFrame, delta: str = "observable_delta") -> DataFrame:
    """Per slot: values seen, mean absolute delta over values and its spread, and whether anything was measured."""
    pairs = F.array(*[F.struct(F.lit(s).alias("slot"), c(s).alias("value")) for s in SLOT_ORDER])
    per = elites.select(F.abs(c(delta)).alias("d"), F.explode(pairs).alias("e")).groupBy("e.slot", "e.value").agg(F.avg("d").alias("m"))
    return per.groupBy("slot").agg(F.count(F.lit(1)).alias("n_values"), F.avg("m").alias("mean_abs_delta"), F.stddev_pop("m").alias("spread"),
                                   (F.max("m") > 0).alias("measured"))
