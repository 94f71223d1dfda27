"""Composition analytics on compositions derived from ``orders``: one per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import composition as X
from tidemark.queries.registry import query, rounded, split_columns, table

c = F.col


def _slot(name: str, index: str) -> str:
    vals = X.SLOTS[name]
    return f"CASE ({index}) % {len(vals)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(vals)) + f" END AS {name}"


_COLUMNS = ", ".join([
    "o_orderkey AS id", _slot("ACCESS", "o_orderkey"), _slot("TRUST", "o_custkey"), _slot("RAIL", "CAST(FLOOR(o_orderkey / 8.0) AS BIGINT)"),
    _slot("EVASION", "o_custkey * 5 + o_orderkey * 3"), _slot("MONETISATION", "o_orderkey * 11 + o_custkey"),
    _slot("LABEL", "CAST(FLOOR(o_custkey / 7.0) AS BIGINT) + o_orderkey"), "o_orderkey % 4 + 1 AS n_stages", "o_totalprice AS fitness",
    "o_custkey % 3 = 0 AS ruined", "CONCAT(CASE WHEN o_custkey % 4 = 0 THEN 'GEN-' ELSE 'ATK-' END, CAST(o_custkey % 9 AS STRING)) AS family_id",
])


def comps(spark, sf):
    return table(spark, sf, "orders").selectExpr(*split_columns(_COLUMNS))


def _broken(con) -> str:
    cid, kind, ws, wv, ts, tv = con
    inside = f"{ts} IN ({', '.join(repr(v) for v in tv)})"
    return f"CASE WHEN {ws} = '{wv}' AND {'NOT ' if kind == 'requires' else ''}({inside}) THEN '{cid}' END"


_LIST = "[" + ", ".join(_broken(x) for x in X.CONSTRAINTS) + "]"
_depth = ("greatest(CASE WHEN MONETISATION IN ('goods-resale', 'credit-line-drawdown') THEN 1 ELSE 2 END, CASE WHEN RAIL IN ('card-clearing-dispute', 'card-token-provisioning', 'upi-autopay-mandate', "
          "'agentic-commerce') OR ACCESS IN ('synthetic-identity', 'delegated-agent-mandate') OR EVASION = 'graph-camouflage' THEN 2 ELSE 1 END)")
_class = "CASE RAIL " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.RAIL_CLASS.items()) + " END"
_locus = "CASE ACCESS " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LOCUS.items()) + " END"
_TEXT = " || '/' || ".join(f"'{s}=' || {s}" for s in X.SLOT_ORDER)
COMP = f"""co AS (SELECT {_COLUMNS} FROM orders), ch AS (SELECT *, list_sort(list_filter({_LIST}, lambda x: x IS NOT NULL)) AS bad, {_depth} AS min_depth, {_class} AS rail_class, {_locus} AS locus, {_TEXT} AS txt FROM co),
    ok AS (SELECT * FROM ch WHERE len(bad) = 0), occ AS (SELECT *, unnest(range(min_depth, 4)) AS depth FROM ok), cells AS (SELECT *, rail_class || '|' || locus || '|' || EVASION || '|d' || depth AS cell_id FROM occ),
    run AS (SELECT *, least(n_stages, 3) AS d, rail_class || '|' || locus || '|' || EVASION || '|d' || least(n_stages, 3) AS cell_id FROM ch)"""


def _rule(m: dict, depth: str) -> str:
    name = {"evasion": "EVASION", "depth": depth, "rail_class": "rail_class", "locus": "locus"}
    return " AND ".join(f"{name[k]} = {v!r}" for k, v in m.items())


_blocked = "list_filter([" + ", ".join(f"CASE WHEN {_rule(m, 'd')} THEN '{i}' END" for i, m in X.INFEASIBLE.items()) + "], lambda x: x IS NOT NULL)"


@query("composition_parse", f"WITH {COMP} SELECT id, ACCESS, LABEL, RAIL FROM ch")
def _parse(spark, sf):
    text = comps(spark, sf).select("id", X.to_text().alias("txt"))
    return X.parse(text, "txt").select("id", "ACCESS", "LABEL", "RAIL")


@query("type_check", f"WITH {COMP} SELECT id, array_to_string(bad, ',') AS violated FROM ch")
def _check(spark, sf):
    return X.violations(comps(spark, sf)).select("id", F.concat_ws(",", "violated").alias("violated"))


def _reason(con) -> str:
    cid, kind, ws, wv, ts, tv = con
    return f"{_broken(con)[:-len(repr(cid)) - 4]}struct_pack(i := '{cid}', r := '{ws}={wv} {kind} {ts} in {'|'.join(tv)}, found ' || {ts}) END"


@query("type_check_reasons", f"""WITH {COMP}, u AS (SELECT id, unnest(list_filter([{', '.join(_reason(x) for x in X.CONSTRAINTS)}], lambda x: x IS NOT NULL)) AS b FROM ch)
    SELECT id, b.i AS constraint_id, b.r AS reason FROM u""")
def _reasons(spark, sf):
    return X.explain_violations(comps(spark, sf), "id")


@query("legal_space", f"WITH {COMP} SELECT count(*) AS n_legal, count(DISTINCT txt) AS n_distinct FROM ok")
def _legal(spark, sf):
    return X.filter_legal(comps(spark, sf)).agg(F.count(F.lit(1)).alias("n_legal"), F.countDistinct(X.to_text()).alias("n_distinct"))


@query("constraint_binds", f"WITH {COMP}, u AS (SELECT unnest(bad) AS constraint_id FROM ch) SELECT constraint_id, count(*) AS n_bound FROM u GROUP BY 1")
def _binds(spark, sf):
    return X.constraint_binds(comps(spark, sf))


@query("slot_marginals", f"WITH {COMP} " + " UNION ALL ".join(f"SELECT '{s}' AS slot, {s} AS value, count(*) AS n FROM ok GROUP BY 2" for s in X.SLOT_ORDER))
def _marginals(spark, sf):
    return X.slot_marginals(X.filter_legal(comps(spark, sf)))


VARIANTS = f"""{COMP}, opt AS (SELECT unnest({[s for s in X.SLOT_ORDER for _ in X.SLOTS[s]]!r}) AS slot, unnest({[v for s in X.SLOT_ORDER for v in X.SLOTS[s]]!r}) AS value, unnest(range({sum(map(len, X.SLOTS.values()))})) AS pos),
    va AS (SELECT id, n_stages, slot, value, pos, {', '.join(f"CASE WHEN slot = '{s}' THEN value ELSE {s} END AS {s}" for s in X.SLOT_ORDER)},
      CASE slot {' '.join(f"WHEN '{s}' THEN {s}" for s in X.SLOT_ORDER)} END AS was, rail_class || '|' || locus || '|' || EVASION AS before FROM ch, opt WHERE id % 10 < 10),
    vl AS (SELECT *, {_TEXT} AS txt, {_depth} AS min_depth, {_class} || '|' || {_locus} || '|' || EVASION AS after FROM va WHERE len(list_filter({_LIST}, lambda x: x IS NOT NULL)) = 0)""".replace(" WHERE id % 10 < 10", "")


@query("legal_values", f"WITH {VARIANTS} SELECT id, slot, string_agg(value, ',' ORDER BY value) AS legal_values FROM vl GROUP BY id, slot")
def _values(spark, sf):
    return X.legal_values(comps(spark, sf), "id").withColumn("legal_values", F.concat_ws(",", "legal_values"))


@query("siblings", f"""WITH {VARIANTS}, p AS (SELECT id, arg_min(struct_pack(slot := slot, value := value, sibling := txt, x := after <> before), (CASE WHEN slot = 'EVASION' THEN 0 ELSE 1 END, pos)) AS b
    FROM vl WHERE value <> was AND n_stages >= min_depth GROUP BY id) SELECT id, b.slot AS slot, b.value AS value, b.sibling AS sibling, b.x AS cell_crossing FROM p""")
def _siblings(spark, sf):
    return X.siblings(comps(spark, sf), "id")


@query("mutation_effects", f"""WITH {VARIANTS} SELECT slot, CASE WHEN slot IN ('TRUST', 'MONETISATION', 'LABEL') THEN 'always-preserving' WHEN slot = 'EVASION' THEN 'always-crossing' ELSE 'conditional' END AS category,
    count(*) AS n, count(*) FILTER (after <> before) AS n_crossing FROM vl WHERE value <> was GROUP BY slot""")
def _mutations(spark, sf):
    return X.mutation_effects(comps(spark, sf), "id")


@query("cell_projection", f"WITH {COMP} SELECT id, cell_id FROM run")
def _cell(spark, sf):
    return X.cell_of(comps(spark, sf), c("n_stages")).select("id", "cell_id")


@query("cell_index", f"WITH {COMP} SELECT cell_id, count(*) AS n_compositions, min(txt) AS first_composition FROM cells GROUP BY cell_id")
def _index(spark, sf):
    return X.cell_index(X.filter_legal(comps(spark, sf)))


@query("feasibility_audit", f"""WITH {COMP}, u AS (SELECT DISTINCT cell_id, rail_class, locus, EVASION, d FROM run), b AS (SELECT {_blocked} AS rules FROM u), x AS (SELECT unnest(rules) AS rule_id, len(rules) AS n FROM b)
    SELECT rule_id, count(*) AS cells_matched, count(*) FILTER (n = 1) AS cells_uniquely_blocked FROM x GROUP BY rule_id""")
def _audit(spark, sf):
    cells = X.cell_of(comps(spark, sf), c("n_stages")).select("cell_id", "rail_class", "locus", "evasion", "depth").distinct()
    return X.feasibility_audit(cells)


@query("consistency", f"""WITH {COMP}, f AS (SELECT DISTINCT cell_id FROM run WHERE len({_blocked}) = 0), r AS (SELECT DISTINCT cell_id FROM cells)
    SELECT cell_id, 'contradiction' AS finding FROM (SELECT * FROM r EXCEPT SELECT * FROM f) UNION ALL SELECT cell_id, 'unreached' FROM (SELECT * FROM f EXCEPT SELECT * FROM r)""")
def _consistency(spark, sf):
    """Cells legal compositions reach against the feasible cells that were run."""
    rows = comps(spark, sf)
    ran = X.feasible(X.cell_of(rows, c("n_stages")))
    return X.consistency(X.occupiable(X.filter_legal(rows)), ran)


_fam = "CASE " + " ".join(f"WHEN ACCESS = '{a}' AND RAIL = '{r}' AND EVASION = '{e}' AND min_depth <= {d} THEN '{f}'" for f, (a, r, e, d) in X.SEALED.items()) + " END"


@query("sealed_members", f"WITH {COMP}, x AS (SELECT id, {_fam} AS family, EVASION = 'low-visibility-rail' AS withheld_value FROM ok) SELECT * FROM x WHERE family IS NOT NULL OR withheld_value")
def _sealed(spark, sf):
    return X.sealed_members(comps(spark, sf)).select("id", "family", "withheld_value")


SEALED_FAMILY = _fam
_ARM = f"EVASION={X.WITHHELD_EVASION}"
_SEALED_DEPTH = "CASE family " + " ".join(f"WHEN '{f}' THEN {d}" for f, (_, _, _, d) in X.SEALED.items()) + " END"


@query("sealed_audit", f"""WITH {COMP}, x AS (SELECT *, {_fam} AS family FROM ok),
    m AS (SELECT family AS arm, txt, rail_class || '|' || locus || '|' || EVASION || '|d' || {_SEALED_DEPTH} AS cell, id % 9 = 0 AS seed FROM x WHERE family IS NOT NULL
      UNION ALL SELECT '{_ARM}', txt, NULL, id % 9 = 0 FROM x WHERE EVASION = '{X.WITHHELD_EVASION}'),
    a AS (SELECT unnest({[*X.SEALED, _ARM]!r}) AS arm),
    g AS (SELECT arm, count(DISTINCT txt) AS n_members, coalesce(string_agg(DISTINCT cell, ',' ORDER BY cell), '') AS cells, count(DISTINCT CASE WHEN seed THEN txt END) AS n_seeds FROM a LEFT JOIN m USING (arm) GROUP BY arm)
    SELECT *, CASE WHEN n_members = 0 THEN 'no legal member' WHEN arm = '{_ARM}' AND n_seeds = 0 THEN 'no seed uses the withheld value' ELSE '' END AS problem FROM g""")
def _sealed_audit(spark, sf):
    """Every ninth order counts as a seed."""
    rows = comps(spark, sf)
    return X.sealed_audit(rows, rows.filter("id % 9 = 0"))


@query("sealed_share", f"""WITH {COMP}, x AS (SELECT DISTINCT txt, {_fam} IS NOT NULL AS f, EVASION = '{X.WITHHELD_EVASION}' AS v FROM ok)
    SELECT count(*) AS n_legal, count(*) FILTER (f) AS n_by_family, count(*) FILTER (v) AS n_by_value, count(*) FILTER (f OR v) AS n_withheld, round(count(*) FILTER (f OR v) / count(*), 9) AS share_withheld FROM x""")
def _sealed_share(spark, sf):
    return rounded(X.sealed_share(comps(spark, sf)), 9)


@query("withhold_mask", f"WITH {COMP}, w AS (SELECT DISTINCT txt FROM ok WHERE id % 50 = 0) SELECT id, txt IN (SELECT txt FROM w) AS withheld FROM ch")
def _withhold(spark, sf):
    rows = comps(spark, sf).withColumn("txt", X.to_text())
    held = X.filter_legal(rows.filter("id % 50 = 0")).select(c("txt").alias("composition"))
    return X.withhold_mask(rows, "txt", held).select("id", "withheld")


ELITES = f"""{COMP}, sd AS (SELECT DISTINCT cell_id FROM run WHERE id % 9 = 0), el AS (SELECT cell_id, count(*) AS evaluations, arg_max(id, (fitness, -id)) AS id FROM run WHERE len({_blocked}) = 0 GROUP BY cell_id),
    ee AS (SELECT el.cell_id, evaluations, run.* EXCLUDE (cell_id), family_id LIKE 'GEN-%' AND el.cell_id NOT IN (SELECT cell_id FROM sd) AS emergent FROM el JOIN run ON el.id = run.id)"""


def elites(spark, sf):
    ran = X.cell_of(comps(spark, sf), c("n_stages"))
    return X.elite_per_cell(ran, order="id", seeds=ran.filter("id % 9 = 0"))


@query("elite_per_cell", f"WITH {ELITES} SELECT cell_id, evaluations, id, fitness, emergent FROM ee")
def _elites(spark, sf):
    return elites(spark, sf).select("cell_id", "evaluations", "id", "fitness", "emergent")


@query("coverage", f"WITH {ELITES} SELECT count(*) AS elites, count(*) FILTER (NOT ruined) AS solvent, round(count(*) / 380.0, 9) + 0e0 AS coverage_all, round(count(*) FILTER (NOT ruined) / 380.0, 9) + 0e0 AS coverage_solvent, round(avg(evaluations), 9) AS mean_evaluations FROM ee")
def _coverage(spark, sf):
    return rounded(X.coverage(elites(spark, sf), 380), 9)


_ATTR = {"amount": "id % 7 + 1", "velocity": "id % 3", "graph": "id % 5", "device": "id % 2"}


def attributed(spark, sf):
    e = elites(spark, sf)
    return e.withColumn("attribution", F.create_map(*[x for k, v in _ATTR.items() for x in (F.lit(k), F.expr(f"CAST({v} AS DOUBLE)"))]))


_P = ", ".join(f"CAST({v} AS DOUBLE) / ({' + '.join(f'({x})' for x in _ATTR.values())}) AS p_{k}" for k, v in _ATTR.items())
_KL = " + ".join(f"CASE WHEN a.p_{k} > 0 THEN a.p_{k} * log2(a.p_{k} / ((a.p_{k} + b.p_{k}) / 2)) ELSE 0 END + CASE WHEN b.p_{k} > 0 THEN b.p_{k} * log2(b.p_{k} / ((a.p_{k} + b.p_{k}) / 2)) ELSE 0 END" for k in _ATTR)
JS = f"{ELITES}, pr AS (SELECT cell_id, {_P} FROM ee), js AS (SELECT a.cell_id AS a, b.cell_id AS b, ({_KL}) / 2 AS js FROM pr a JOIN pr b ON a.cell_id < b.cell_id)"


@query("js_divergence", f"WITH {JS} SELECT a, b, round(greatest(js, 0), 6) + 0e0 AS js FROM js")
def _js(spark, sf):
    out = X.js_pairs(attributed(spark, sf), "cell_id", "attribution")
    return rounded(out.withColumn("js", F.greatest(c("js"), F.lit(0.0))))


@query("js_merge", f"""WITH RECURSIVE {JS}, ed AS (SELECT a, b FROM js WHERE js < 0.0004 UNION ALL SELECT b, a FROM js WHERE js < 0.0004),
    w(n, l) AS (SELECT cell_id, cell_id FROM pr UNION SELECT ed.b, w.l FROM w JOIN ed ON ed.a = w.n) SELECT n AS cell_id, min(l) AS component FROM w GROUP BY n""")
def _merge(spark, sf):
    return X.js_merge(attributed(spark, sf), "cell_id", "attribution", threshold=0.0004)


@query("observable_delta", f"WITH {ELITES}, v AS (" + " UNION ALL ".join(f"SELECT '{s}' AS slot, {s} AS value, avg(abs(CAST(id % 11 AS DOUBLE) - 5)) AS m FROM ee GROUP BY 2" for s in X.SLOT_ORDER) + """)
    SELECT slot, count(*) AS n_values, round(avg(m), 9) AS mean_abs_delta, round(stddev_pop(m), 9) AS spread, max(m) > 0 AS measured FROM v GROUP BY slot""")
def _delta(spark, sf):
    return rounded(X.observable_delta(elites(spark, sf).withColumn("observable_delta", (c("id") % 11).cast("double") - 5)), 9)
