"""Queries over many causal graphs at once: one for every three orders, for each nation, for each part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import graph, identify
from tideline.operators.observations import HOURS
from tideline.session import table

#: The graphs: one for every three orders, over nine constructs c0 to c8. A line of an order is an arrow from its part's
#: construct to its supplier's; c9 is in no graph. c8 is the outcome; the graph's number picks what is hidden, invariant
#: or exogenous.
NODE = {
    "observed": "n = 8 OR (key + n) % 4 <> 0", "varying": "n = 8 OR (key + 2 * n) % 5 <> 0", "is_outcome": "n = 8",
    "role": "CASE WHEN n <> 8 AND (key + n) % 6 = 0 THEN 'exogenous' ELSE 'endogenous' END",
    "granularity": "CASE WHEN NOT (n = 8 OR (key + 2 * n) % 5 <> 0) THEN NULL WHEN n % 3 = 0 THEN 'hourly' WHEN n % 3 = 1 THEN 'daily' ELSE 'weekly' END",
}
#: Ends of the arrows: as they come, or ordered upward so that there is no cycle.
ANY, UPWARD = ("l_partkey % 9", "l_suppkey % 10"), ("least(l_partkey % 9, l_suppkey % 9)", "greatest(l_partkey % 9, l_suppkey % 9)")


def _graphs(spark, sf_dir, ends=ANY):
    li = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 3 AS key", f"{ends[0]} AS a", f"{ends[1]} AS b", "l_linenumber > 4 AS lagged")
    arrows = li.where("a <> b").groupBy("key", "a", "b").agg(F.min("lagged").alias("lagged")).selectExpr("key", "concat('c', a) AS cause", "concat('c', b) AS effect", "lagged")
    nodes = li.select("key").distinct().selectExpr("key", "explode(sequence(0, 8)) AS n")
    return nodes.selectExpr("key", "concat('c', n) AS name", *[f"{rule} AS {c}" for c, rule in NODE.items()]), arrows


def _graphs_sql(ends) -> str:
    return f"""li AS (SELECT l_orderkey // 3 AS key, {ends[0]} AS a, {ends[1]} AS b, l_linenumber > 4 AS lagged FROM lineitem),
c AS (SELECT key, 'c' || n AS name, {', '.join(f'{rule} AS {k}' for k, rule in NODE.items())} FROM (SELECT DISTINCT key FROM li), range(0, 9) r(n)),
e AS (SELECT key, 'c' || a AS cause, 'c' || b AS effect, min(lagged) AS lagged FROM li WHERE a <> b GROUP BY ALL)"""


_SQL = """WITH RECURSIVE GRAPHS,
d(key, a, n) AS (SELECT key, cause, effect FROM e UNION SELECT d.key, d.a, e.effect FROM d JOIN e ON d.key = e.key AND d.n = e.cause),
outcome AS (SELECT key, name FROM c WHERE is_outcome),
t AS (SELECT DISTINCT d.key, a AS x FROM d JOIN outcome o ON d.key = o.key AND n = o.name AND a <> o.name JOIN c ON c.key = d.key AND a = c.name),
ends AS (SELECT e.key, cause, effect, lagged, p.varying AS cv, q.varying AS ev, p.granularity AS cg, q.granularity AS eg FROM e JOIN c p ON e.key = p.key AND cause = p.name JOIN c q ON e.key = q.key AND effect = q.name),
steps(s) AS (VALUES ('_t'), ('_{t-1}')),
u AS (
  SELECT key, cause, effect FROM ends WHERE NOT cv AND NOT ev
  UNION SELECT key, cause, effect || s FROM ends, steps WHERE NOT cv AND ev
  UNION SELECT key, cause || '_{t-1}', effect || '_t' FROM ends WHERE cv AND ev AND lagged
  UNION SELECT key, cause || s, effect || s FROM ends, steps WHERE cv AND ev AND NOT lagged
  UNION SELECT key, name || '_{t-1}', name || '_t' FROM c WHERE varying AND observed
),
un AS (SELECT key, name || s AS node, name, observed FROM c, steps WHERE varying UNION SELECT key, name, name, observed FROM c WHERE NOT varying),
hid AS (SELECT u.* FROM u JOIN un ON u.key = un.key AND cause = node AND NOT observed),
hr(key, a, n) AS (SELECT key, cause, effect FROM hid UNION SELECT hr.key, hr.a, hid.effect FROM hr JOIN hid ON hr.key = hid.key AND hr.n = hid.cause),
past(key, x, a, n) AS (SELECT key, x, cause, effect FROM t JOIN e USING (key) WHERE cause <> x AND effect <> x
  UNION SELECT past.key, x, a, e.effect FROM past JOIN e ON past.key = e.key AND past.n = e.cause WHERE e.effect <> x),
cut(key, x, a, n) AS (SELECT key, x, cause, effect FROM t JOIN e USING (key) WHERE effect <> x UNION SELECT cut.key, x, a, e.effect FROM cut JOIN e ON cut.key = e.key AND cut.n = e.cause WHERE e.effect <> x),
causes AS (SELECT DISTINCT cut.key, x, a FROM cut JOIN outcome o ON cut.key = o.key AND n = o.name),
barred AS (SELECT key, x, a FROM causes UNION SELECT key, x, n FROM cut JOIN causes USING (key, x, a)),
now(key, a, n) AS (SELECT key, cause, effect FROM e WHERE NOT lagged UNION SELECT now.key, now.a, e.effect FROM now JOIN e ON now.key = e.key AND now.n = e.cause WHERE NOT lagged),
both_ways AS (SELECT key, cause, effect FROM e UNION SELECT key, effect, cause FROM e),
w(key, a, n) AS (SELECT key, cause, effect FROM both_ways UNION SELECT w.key, w.a, b.effect FROM w JOIN both_ways b ON w.key = b.key AND w.n = b.cause)
"""
G, DAG = _SQL.replace("GRAPHS", _graphs_sql(ANY)), _SQL.replace("GRAPHS", _graphs_sql(UPWARD))
H_SQL = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {h}" for k, h in HOURS.items()) + " ELSE 0 END"


def _problems(spark, sf_dir):
    return graph.edge_problems(*_graphs(spark, sf_dir), HOURS)


def _lags(spark, sf_dir):
    c, e = _graphs(spark, sf_dir)
    end = lambda side, grain: c.select("key", F.col("name").alias(side), F.col("granularity").alias(grain))
    wide = e.join(end("cause", "cg"), ["key", "cause"]).join(end("effect", "eg"), ["key", "effect"])
    return wide.select("key", "cause", "effect", graph.lag_hours(F.col("cg"), F.col("eg"), F.col("lagged"), HOURS).alias("lag_hours"))


def _loadings(spark, sf_dir):
    """A part is an indicator of its construct in the graph of its orders; the smallest part key comes first."""
    own = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 3 AS key", "concat('i', l_partkey) AS indicator", "concat('c', l_partkey % 9) AS construct", "l_partkey AS pos").distinct()
    return graph.loading_mask(own)


def _nation_graphs(spark, sf_dir):
    """One graph for each nation: customers of its region's other nations are reached over suppliers' keys modulo 12."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), (F.col("s_suppkey") % 12).alias("cause"), (F.col("s_suppkey") * 7 % 12).alias("effect")).distinct()
    return graph.closure(s.select("key", F.col("cause").alias("start")).distinct(), s).groupBy("key").agg(F.count("*").alias("pairs"), F.count_if(F.col("start") == F.col("node")).alias("cyclic"))


def _on(f, ends=ANY):
    return lambda spark, sf_dir: f(*_graphs(spark, sf_dir, ends))


def _identified(spark, sf_dir):
    return identify.effects(*_parts(spark, sf_dir)).select(
        "key", "treatment", "identifiable", "method", F.array_join("instruments", " ").alias("instruments"),
        F.array_join("blockers", " ").alias("blockers")
    )


def _roles(spark, sf_dir):
    nodes, arrows = _parts(spark, sf_dir)
    return identify.unobserved_roles(nodes, identify.effects(nodes, arrows)).select("key", "construct", "can_marginalize", F.array_join("blocks", " ").alias("blocks"))


def _fix(spark, sf_dir):
    nodes, arrows = _parts(spark, sf_dir)
    return identify.to_fix(nodes, identify.effects(nodes, arrows))


def _parts(spark, sf_dir):
    """One graph for each part: what its suppliers' keys modulo 9 lead to is ordered upward, so that there is no cycle; 8 is
    the outcome and keys that the part's number picks are hidden."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"), F.least(F.col("l_suppkey") % 9, F.col("l_orderkey") % 9).alias("a"),
        F.greatest(F.col("l_suppkey") % 9, F.col("l_orderkey") % 9).alias("b"), (F.col("l_linenumber") > 4).alias("lagged")
    )
    arrows = li.where("a < b").groupBy("key", "a", "b").agg(F.min("lagged").alias("lagged")).select(
        "key", F.col("a").cast("string").alias("cause"), F.col("b").cast("string").alias("effect"), "lagged"
    )
    n = F.explode(F.sequence(F.lit(0), F.lit(8)))
    nodes = li.select("key").distinct().select("key", n.alias("n"))
    return nodes.select(
        "key", F.col("n").cast("string").alias("name"), ((F.col("n") == 8) | ((F.col("key") + F.col("n")) % 4 != 0)).alias("observed"),
        F.lit(True).alias("varying"), (F.col("n") == 8).alias("is_outcome")
    ), arrows


def _many(spark, sf_dir):
    return identify.effects(*_parts(spark, sf_dir)).groupBy("treatment", "method").agg(F.count("*").alias("graphs"), F.sum(F.size("blockers")).alias("blockers"))


def _summary(spark, sf_dir):
    return identify.summary(*_parts(spark, sf_dir))


PARTS_SQL = """li AS (SELECT l_partkey AS key, least(l_suppkey % 9, l_orderkey % 9) AS a, greatest(l_suppkey % 9, l_orderkey % 9) AS b, l_linenumber > 4 AS lagged FROM lineitem),
arrows AS (SELECT key, a, b, min(lagged) AS lagged FROM li WHERE a < b GROUP BY ALL), keys AS (SELECT DISTINCT key FROM li)"""

BLOCKING = """SELECT DISTINCT past.key, past.x AS treatment, past.a AS confounder FROM past JOIN d ON d.key = past.key AND d.a = past.a AND d.n = past.x JOIN outcome o ON past.key = o.key AND past.n = o.name
JOIN c h ON past.key = h.key AND past.a = h.name AND NOT h.observed AND NOT h.is_outcome
JOIN (SELECT e.key, cause FROM e JOIN c ON e.key = c.key AND effect = name AND observed) k ON past.key = k.key AND past.a = k.cause"""

QUERIES = {
    "treatments": _on(graph.treatments),
    "ancestors": _on(graph.descendants),
    "unroll_dag": _on(graph.unroll),
    "confounders_hidden": _on(graph.hidden_confounders),
    "admg_bidirected": _on(graph.bidirected),
    "blocking_confounders": _on(graph.blocking_confounders),
    "blocking_confounders_acyclic": _on(graph.blocking_confounders, UPWARD),
    "treatments_acyclic": _on(graph.treatments, UPWARD),
    "instruments": _on(graph.instruments, UPWARD),
    "lag_hours": _lags,
    "contemporaneous_cycles": _on(graph.cycles),
    "edge_validation": _problems,
    "drift_mask": _on(graph.drift_mask),
    "loading_mask": _loadings,
    "drift_components": _on(graph.components),
    "closure_of_many_graphs": _nation_graphs,
    "admg_directed": _on(graph.projected),
    "identify_effects": _identified,
    "identify_roles": _roles,
    "identify_to_fix": _fix,
    "identify_many_graphs": _many,
    "graph_summary": _summary,
}

ORACLES = {
    "treatments": G + "SELECT key, x AS treatment FROM t",
    "ancestors": G + "SELECT d.key, a AS ancestor, n AS node FROM d JOIN c ON d.key = c.key AND a = name",
    "unroll_dag": G + "SELECT key, cause, effect FROM u",
    "confounders_hidden": G + "SELECT u.key, cause AS node, h.name AS construct, count(DISTINCT effect) AS children FROM u JOIN un h ON u.key = h.key AND cause = h.node AND NOT h.observed JOIN un s ON u.key = s.key AND effect = s.node AND s.observed GROUP BY ALL HAVING count(DISTINCT effect) >= 2",
    "admg_bidirected": G + "SELECT DISTINCT x.key, x.n AS a, y.n AS b FROM hr x JOIN hr y ON x.key = y.key AND x.a = y.a AND x.n < y.n JOIN un p ON x.key = p.key AND x.n = p.node AND p.observed JOIN un q ON y.key = q.key AND y.n = q.node AND q.observed",
    "blocking_confounders": G + BLOCKING,
    "blocking_confounders_acyclic": DAG + BLOCKING,
    "treatments_acyclic": DAG + "SELECT key, x AS treatment FROM t",
    "instruments": DAG + "SELECT DISTINCT t.key, x AS treatment, cause AS instrument FROM t JOIN e ON t.key = e.key AND effect = x JOIN c ON e.key = c.key AND cause = name AND observed WHERE NOT EXISTS (SELECT 1 FROM barred b WHERE b.key = t.key AND b.x = t.x AND b.a = cause)",
    "lag_hours": G + f"SELECT key, cause, effect, CASE WHEN cg IS DISTINCT FROM eg OR lagged THEN greatest({H_SQL('cg')}, {H_SQL('eg')}) ELSE 0 END AS lag_hours FROM ends",
    "contemporaneous_cycles": G + "SELECT now.key, a AS node FROM now JOIN c ON now.key = c.key AND a = name WHERE a = n",
    "edge_validation": G + """SELECT e.key, cause, effect, 'unknown cause' AS problem FROM e LEFT JOIN c ON e.key = c.key AND cause = name WHERE name IS NULL
UNION ALL SELECT e.key, cause, effect, 'unknown effect' FROM e LEFT JOIN c ON e.key = c.key AND effect = name WHERE name IS NULL
UNION ALL SELECT e.key, cause, effect, 'exogenous effect' FROM e JOIN c ON e.key = c.key AND effect = name WHERE role = 'exogenous'
UNION ALL SELECT key, cause, effect, 'grains differ' FROM ends WHERE NOT lagged AND cv AND ev AND cg IS DISTINCT FROM eg""",
    "drift_mask": G + "SELECT key, effect, cause FROM e UNION SELECT key, name, name FROM c",
    "loading_mask": "SELECT key, indicator, construct, row_number() OVER (PARTITION BY key, construct ORDER BY pos) > 1 AS free FROM (SELECT DISTINCT l_orderkey // 3 AS key, 'i' || l_partkey AS indicator, 'c' || (l_partkey % 9) AS construct, l_partkey AS pos FROM lineitem)",
    "drift_components": G + "SELECT c.key, name, least(name, min(n)) AS component FROM c LEFT JOIN w ON w.key = c.key AND a = name GROUP BY c.key, name",
    "closure_of_many_graphs": "WITH RECURSIVE s AS (SELECT DISTINCT s_nationkey AS key, s_suppkey % 12 AS cause, s_suppkey * 7 % 12 AS effect FROM supplier), d(key, a, n) AS (SELECT key, cause, effect FROM s UNION SELECT d.key, d.a, s.effect FROM d JOIN s ON d.key = s.key AND d.n = s.cause) SELECT key, count(*) AS pairs, count(*) FILTER (WHERE a = n) AS cyclic FROM d GROUP BY key",
    "admg_directed": G + """, thru(key, a, n) AS (SELECT u.key, cause, effect FROM u JOIN un ON u.key = un.key AND cause = node AND observed UNION SELECT thru.key, thru.a, hid.effect FROM thru JOIN hid ON thru.key = hid.key AND thru.n = hid.cause)
SELECT DISTINCT thru.key, a AS cause, n AS effect FROM thru JOIN un ON thru.key = un.key AND n = node AND observed""",
    "graph_summary": f"WITH {PARTS_SQL} SELECT keys.key::VARCHAR AS key, 9::BIGINT AS constructs, (SELECT count(*) FROM range(0, 9) r(n) WHERE n = 8 OR (keys.key + n) % 4 <> 0) AS observed, 9::BIGINT AS varying, (SELECT count(*) FROM arrows WHERE arrows.key = keys.key) AS edges, (SELECT count(*) FROM arrows WHERE arrows.key = keys.key AND lagged) AS lagged, '8' AS outcome FROM keys",
}
