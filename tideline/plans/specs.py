"""Queries over model specifications: one for every eight parts, with faults at known places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.aggregates import REGISTRY
from tideline.operators import specs
from tideline.operators.observations import HOURS
from tideline.session import table

#: Columns as SQL that both engines read; k: the specification, p: the part's key.
KEY = "CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT)"


def _pick(by: str, values: list[str | None], rest: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + f" ELSE '{rest}' END"


CONSTRUCTS = {
    "name": "concat('c', CAST(CASE WHEN p_partkey % 41 = 5 THEN 0 ELSE p_partkey % 8 END AS VARCHAR(9)))",
    "role": "CASE WHEN p_partkey % 8 IN (1, 2, 3) THEN 'exogenous' WHEN p_partkey % 71 = 9 THEN 'odd' ELSE 'endogenous' END",
    "temporal_status": "CASE WHEN p_partkey % 11 = 0 THEN 'time_invariant' ELSE 'time_varying' END",
    "granularity": f"CASE WHEN p_partkey % 11 = 0 AND p_partkey % 3 > 0 THEN NULL ELSE {_pick('p_partkey % 29', [None, 'fortnightly', 'weekly', 'hourly'], 'daily')} END",
    "is_outcome": "(p_partkey % 8 = 7 AND p_partkey % 5 <> 0) OR p_partkey % 37 = 3",
}
EDGES = {
    "cause": "concat('c', CAST(p_partkey * 3 % 8 AS VARCHAR(9)))",
    "effect": "concat('c', CAST(CASE WHEN p_partkey % 19 = 0 THEN 9 ELSE (p_partkey * 3 % 8 + 1 + p_partkey % 4) % 8 END AS VARCHAR(9)))",
    "lagged": "p_partkey % 4 = 0",
}
INDICATORS = {
    "name": "concat('i', CAST(CASE WHEN p_partkey % 31 = 2 THEN 1 ELSE p_partkey % 8 END AS VARCHAR(9)))",
    "construct": "concat('c', CAST(CASE WHEN p_partkey % 43 = 0 THEN 9 ELSE p_partkey * 5 % 8 - p_partkey % 2 END AS VARCHAR(9)))",
    "granularity": _pick("p_partkey % 23", ["monthly", "hourly", "never", "weekly", "finest"], "daily"),
    "dtype": _pick("p_partkey % 7", ["binary", "count", "ordinal", "categorical"], "continuous"),
    "aggregation": _pick("p_partkey % 47", ["mode", "sum", "p90"], "mean"),
    "how_to_measure": "CASE WHEN p_partkey % 3 = 0 THEN 'count the messages of a day that were answered within an hour' ELSE 'count' END",
}
LIKELIHOODS = {
    "variable": "concat('i', CAST(p_partkey % 7 AS VARCHAR(9)))",
    "distribution": _pick("p_partkey % 11", ["bernoulli", "poisson", "negative_binomial", "student_t", "gamma", "beta", "ordered_logistic", "categorical", "weird"], "gaussian"),
    "link": _pick("p_partkey % 9", ["logit", "log", "probit", "softmax", "cumulative_logit", "odd"], "identity"),
}
PARAMETERS = {
    "name": "concat('b', CAST(p_partkey % 6 AS VARCHAR(9)))",
    "role": _pick("p_partkey % 6", ["ar_coefficient", "residual_sd", "loading", "correlation", "odd"], "fixed_effect"),
    "constraint": _pick("p_partkey % 5", ["unit_interval", "positive", "correlation", "loose"], "none"),
}
EXTRACTIONS = {
    "indicator": "concat('i', CAST(p_partkey % 9 AS VARCHAR(9)))",
    "value": _pick("p_partkey % 6", ["0", "2.5", None, "true", "-1"], "4"),
    "kind": _pick("p_partkey % 5", ["string", "integer", "boolean"], "number"),
}
TABLES = {"constructs": CONSTRUCTS, "edges": EDGES, "indicators": INDICATORS, "likelihoods": LIKELIHOODS, "params": PARAMETERS, "extractions": EXTRACTIONS}


def part(spark, sf_dir, name: str):
    columns = [f"{KEY} AS key", *[f"{sql} AS {c}" for c, sql in TABLES[name].items()]]
    return table(spark, sf_dir, "part").selectExpr(*columns)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _rows(pairs: dict[str, list[str]]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, own in pairs.items() for v in own) + ")"


GRAIN_HOURS = "(VALUES " + ", ".join(f"('{k}', {h})" for k, h in HOURS.items()) + ")"
HEAD = "WITH RECURSIVE " + ", ".join(f"{name} AS (SELECT {KEY} AS key, {', '.join(f'{sql} AS {c}' for c, sql in own.items())} FROM part)" for name, own in TABLES.items()) + f""",
cf AS (SELECT key, name, unnest([
    CASE WHEN role NOT IN ('endogenous', 'exogenous') THEN 'unknown role' END,
    CASE WHEN temporal_status = 'time_varying' AND granularity IS NULL THEN 'granularity missing' END,
    CASE WHEN temporal_status = 'time_varying' AND granularity NOT IN {_in(HOURS)} THEN 'unknown granularity' END,
    CASE WHEN temporal_status <> 'time_varying' AND granularity IS NOT NULL THEN 'granularity not allowed' END,
    CASE WHEN is_outcome AND role <> 'endogenous' THEN 'outcome not endogenous' END]) AS issue, role, temporal_status, granularity, is_outcome FROM constructs),
cbad AS (SELECT DISTINCT key, name, role, temporal_status, granularity, is_outcome FROM cf WHERE issue IS NOT NULL),
sound AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY key, name ORDER BY role, temporal_status, granularity NULLS FIRST, is_outcome) AS r FROM (
  SELECT c.* FROM constructs c LEFT JOIN cbad b ON c.key = b.key AND c.name = b.name AND c.role = b.role AND c.temporal_status = b.temporal_status AND c.granularity IS NOT DISTINCT FROM b.granularity AND c.is_outcome = b.is_outcome WHERE b.key IS NULL)) WHERE r = 1),
ef AS (SELECT e.*, CASE WHEN c.name IS NULL THEN 'unknown cause' WHEN f.name IS NULL THEN 'unknown effect' WHEN f.role = 'exogenous' THEN 'exogenous effect'
    WHEN NOT lagged AND c.granularity <> f.granularity THEN 'grains differ' END AS fault
  FROM edges e LEFT JOIN sound c ON e.key = c.key AND e.cause = c.name LEFT JOIN sound f ON e.key = f.key AND e.effect = f.name),
oc AS (SELECT k.key, count(s.name) AS n, max(s.name) AS outcome FROM (SELECT DISTINCT key FROM constructs) k LEFT JOIN sound s ON k.key = s.key AND s.is_outcome GROUP BY k.key),
loops(key, a, n) AS (SELECT key, cause, effect FROM ef WHERE fault IS NULL AND NOT lagged UNION SELECT l.key, l.a, e.effect FROM loops l JOIN ef e ON l.key = e.key AND l.n = e.cause AND e.fault IS NULL AND NOT e.lagged),
latent AS (
  SELECT key, 'construct' AS part, name, issue, 'error' AS severity FROM cf WHERE issue IS NOT NULL
  UNION ALL SELECT key, 'construct', name, 'duplicate name', 'error' FROM (SELECT key, name, row_number() OVER (PARTITION BY key, name) AS r FROM constructs) WHERE r > 1
  UNION ALL SELECT key, 'edge', cause || ' -> ' || effect, fault, 'error' FROM ef WHERE fault IS NOT NULL
  UNION ALL SELECT key, 'model', '', CASE WHEN n = 0 THEN 'no outcome' ELSE 'several outcomes' END, 'error' FROM oc WHERE n <> 1
  UNION ALL SELECT key, 'model', outcome, 'outcome without cause', 'error' FROM oc WHERE n = 1 AND (key, outcome) NOT IN (SELECT key, effect FROM ef WHERE fault IS NULL)
  UNION ALL SELECT key, 'model', min(a), 'contemporaneous cycle', 'error' FROM loops WHERE a = n GROUP BY key),
inf AS (SELECT *, unnest([CASE WHEN aggregation NOT IN {_in(REGISTRY)} THEN 'unknown aggregation' END, CASE WHEN granularity NOT IN {_in(['finest', *HOURS])} THEN 'unknown granularity' END]) AS issue FROM indicators),
measured AS (
  SELECT key, 'indicator' AS part, name, issue, 'error' AS severity FROM inf WHERE issue IS NOT NULL
  UNION ALL SELECT key, 'indicator', name, 'duplicate name', 'error' FROM (SELECT key, name, row_number() OVER (PARTITION BY key, name) AS r FROM indicators) WHERE r > 1
  UNION ALL SELECT i.key, 'indicator', i.name, CASE WHEN s.name IS NULL THEN 'unknown construct' ELSE 'coarser than its construct' END, 'error'
    FROM indicators i LEFT JOIN sound s ON i.key = s.key AND i.construct = s.name LEFT JOIN {GRAIN_HOURS} h(g, own) ON i.granularity = g LEFT JOIN {GRAIN_HOURS} hc(gc, causal) ON s.granularity = gc
    WHERE i.aggregation IN {_in(REGISTRY)} AND i.granularity IN {_in(['finest', *HOURS])} AND (s.name IS NULL OR s.temporal_status = 'time_varying' AND own > causal)),
dtypes AS (SELECT key, name, max(dtype) AS dtype FROM indicators GROUP BY key, name),
model AS (
  SELECT key, 'likelihood' AS part, variable AS name, 'duplicate name' AS issue, 'error' AS severity FROM (SELECT key, variable, row_number() OVER (PARTITION BY key, variable) AS r FROM likelihoods) WHERE r > 1
  UNION ALL SELECT key, 'parameter', name, 'duplicate name', 'error' FROM (SELECT key, name, row_number() OVER (PARTITION BY key, name) AS r FROM params) WHERE r > 1
  UNION ALL SELECT key, 'likelihood', variable, 'unknown distribution', 'error' FROM likelihoods WHERE distribution NOT IN {_in(specs.LINKS_OF_DISTRIBUTION)}
  UNION ALL SELECT key, 'likelihood', variable, 'unknown link', 'error' FROM likelihoods WHERE link NOT IN {_in(specs.LINKS)}
  UNION ALL SELECT key, 'likelihood', variable, 'link does not fit the distribution', 'error' FROM likelihoods WHERE distribution IN {_in(specs.LINKS_OF_DISTRIBUTION)} AND link IN {_in(specs.LINKS)} AND (distribution, link) NOT IN (SELECT * FROM {_rows(specs.LINKS_OF_DISTRIBUTION)})
  UNION ALL SELECT key, 'parameter', name, 'unknown role', 'error' FROM params WHERE role NOT IN {_in(specs.CONSTRAINT_OF_ROLE)}
  UNION ALL SELECT key, 'parameter', name, 'unknown constraint', 'error' FROM params WHERE "constraint" NOT IN {_in(specs.CONSTRAINTS)}
  UNION ALL SELECT key, 'parameter', name, 'unexpected constraint', 'warning' FROM params WHERE "constraint" IN {_in(specs.CONSTRAINTS)} AND role IN {_in(specs.CONSTRAINT_OF_ROLE)} AND (role, "constraint") NOT IN (SELECT * FROM {_rows({k: [v] for k, v in specs.CONSTRAINT_OF_ROLE.items()})})
  UNION ALL SELECT l.key, 'likelihood', variable, 'distribution does not fit the dtype', 'error' FROM likelihoods l JOIN dtypes d ON l.key = d.key AND variable = d.name WHERE distribution IN {_in(specs.LINKS_OF_DISTRIBUTION)} AND (dtype, distribution) NOT IN (SELECT * FROM {_rows(specs.DISTRIBUTIONS_OF_DTYPE)})
  UNION ALL SELECT key, 'likelihood', name, 'no likelihood', 'warning' FROM dtypes WHERE (key, name) NOT IN (SELECT key, variable FROM likelihoods)),
ex AS (SELECT e.*, d.name IS NOT NULL AS known, CASE WHEN value IS NULL THEN true
    WHEN dtype = 'continuous' THEN kind <> 'string'
    WHEN dtype = 'binary' THEN kind = 'boolean' OR kind <> 'string' AND TRY_CAST(value AS DOUBLE) IN (0, 1) OR kind = 'string' AND value IN ('0', '1', 'true', 'false', 'True', 'False')
    WHEN dtype = 'count' THEN kind IN ('integer', 'boolean') OR kind = 'number' AND TRY_CAST(value AS DOUBLE) = floor(TRY_CAST(value AS DOUBLE)) AND TRY_CAST(value AS DOUBLE) >= 0
    WHEN dtype = 'ordinal' THEN true WHEN dtype = 'categorical' THEN kind = 'string' ELSE true END AS fits FROM extractions e LEFT JOIN dtypes d ON e.key = d.key AND indicator = d.name)
"""


def _score_inputs(spark, sf_dir):
    """Verdicts of no graph: every third specification has two treatments open before proxies, every fourth one after."""
    keys = part(spark, sf_dir, "constructs").select("key").distinct()
    two = keys.where("key % 3 = 0").select("key", F.explode(F.array(F.lit(False), F.lit(False))).alias("identifiable"))
    return two, keys.where("key % 4 = 0").select("key", F.lit(False).alias("identifiable"))


#: Names for constructs by the digit of theirs, and how parameters shorten them.
SAID = ["deep sleep", "stress", "work load", "mood", "cognitive focus", "activity", "caffeine", "pain"]
SHORT = ["sleep", "str", "work", "mood", "cog", "act", "caf", "pa"]
_said = lambda column: "CASE " + " ".join(f"WHEN {column} = 'c{i}' THEN '{w}'" for i, w in enumerate(SAID)) + " ELSE 'other' END"
_PARAM = f"concat({_pick('p_partkey % 3', ['ar_', 'beta_'], 'sigma_')}, {_pick('p_partkey * 7 % 8', SHORT, '')}, '_', {_pick('p_partkey * 3 % 8', [w.replace(' ', '_') for w in SAID], '')})"


def _functional(spark, sf_dir):
    named = lambda df, *cs: df.withColumns({c: F.expr(_said(c)) for c in cs})
    params = table(spark, sf_dir, "part").selectExpr(f"{KEY} AS key", f"{_PARAM} AS name", f"{PARAMETERS['role']} AS role", f"{PARAMETERS['constraint']} AS constraint")
    edges = part(spark, sf_dir, "edges").where("cause in ('c0', 'c3') and effect <> 'c9'")
    return specs.functional_score(named(part(spark, sf_dir, "constructs"), "name"), named(edges, "cause", "effect"), part(spark, sf_dir, "indicators"), part(spark, sf_dir, "likelihoods"), params)


QUERIES = {
    "spec_constructs": lambda s, d: specs.construct_issues(part(s, d, "constructs")),
    "spec_latent": lambda s, d: specs.latent_issues(part(s, d, "constructs"), part(s, d, "edges")),
    "spec_measurement": lambda s, d: specs.measurement_issues(part(s, d, "indicators"), part(s, d, "constructs")),
    "spec_causal": lambda s, d: specs.causal_issues(part(s, d, "constructs"), part(s, d, "edges"), part(s, d, "indicators")).groupBy("part", "issue").agg(F.count("*").alias("n")),
    "spec_model": lambda s, d: specs.model_issues(part(s, d, "likelihoods"), part(s, d, "params"), part(s, d, "indicators")),
    "spec_extractions": lambda s, d: specs.extraction_issues(part(s, d, "extractions"), part(s, d, "indicators")),
    "score_extractions": lambda s, d: specs.extraction_score(part(s, d, "extractions"), part(s, d, "indicators")),
    "score_latent": lambda s, d: specs.latent_score(part(s, d, "constructs"), part(s, d, "edges")),
    "score_functional": _functional,
    "score_measurement": lambda s, d: specs.measurement_score(part(s, d, "indicators"), part(s, d, "constructs"), *_score_inputs(s, d)),
}

ORACLES = {
    "spec_constructs": HEAD + "SELECT * FROM latent WHERE part = 'construct'",
    "spec_latent": HEAD + "SELECT * FROM latent",
    "spec_measurement": HEAD + "SELECT * FROM measured",
    "spec_causal": HEAD + "SELECT part, issue, count(*) AS n FROM (SELECT * FROM latent UNION ALL SELECT * FROM measured) GROUP BY part, issue",
    "spec_model": HEAD + "SELECT * FROM model",
    "spec_extractions": HEAD + "SELECT key, 'extraction' AS part, indicator AS name, CASE WHEN known THEN 'value does not fit the dtype' ELSE 'unknown indicator' END AS issue, 'error' AS severity FROM ex WHERE NOT known OR NOT fits",
    "score_extractions": HEAD + "SELECT key, CASE WHEN bool_or(known AND NOT fits) THEN 0 ELSE 10 + count(*) END AS score FROM ex GROUP BY key",
    "score_latent": HEAD + """, grains AS (SELECT DISTINCT key, name, granularity FROM constructs),
a AS (SELECT key, sum(CASE WHEN granularity IS NULL THEN 3 ELSE 4 END) AS a, count(*) AS n FROM constructs GROUP BY key),
b AS (SELECT e.key, sum(CASE WHEN c.granularity IS DISTINCT FROM f.granularity THEN 5 ELSE 4 END) AS b, count(*) AS m FROM edges e JOIN grains c ON e.key = c.key AND cause = c.name JOIN grains f ON e.key = f.key AND effect = f.name GROUP BY e.key),
p AS (SELECT key, CASE WHEN key IN (SELECT key FROM latent) THEN 0 ELSE a + coalesce(b, 0) END AS score, 4 * (n + coalesce(m, 0)) AS most FROM a LEFT JOIN b USING (key))
SELECT key, CAST(score AS BIGINT) AS score, least(1.0::DOUBLE, CAST(score AS DOUBLE) / CAST(most AS DOUBLE)) AS share FROM p""",
    "score_measurement": HEAD + """, i AS (SELECT i.*, EXISTS (SELECT 1 FROM constructs c WHERE c.key = i.key AND c.name = i.construct) AS known FROM indicators i),
p AS (SELECT key, sum(CASE WHEN known THEN 2 ELSE 0 END + 2 + CASE WHEN length(how_to_measure) > 50 THEN 1 ELSE 0 END) AS points FROM i GROUP BY key),
m AS (SELECT key, sum(more) AS more FROM (SELECT key, 2 * (count(*) - 1) AS more FROM i WHERE known GROUP BY key, construct) GROUP BY key)
SELECT key, CAST(CASE WHEN key IN (SELECT key FROM measured WHERE issue IN ('unknown aggregation', 'unknown granularity', 'duplicate name')) THEN 0
  ELSE points + coalesce(more, 0) + CASE WHEN key % 4 <> 0 THEN CASE WHEN key % 3 = 0 THEN 15 ELSE 10 END WHEN key % 3 = 0 THEN 5 ELSE 0 END END AS BIGINT) AS score FROM p LEFT JOIN m USING (key)""",
}

_WORDS = lambda x: f"[w FOR w IN string_split_regex(lower({x}), '\\s+') IF w <> '']"
_NAMES = lambda c, p: f"""(contains(lower({p}), replace(lower({c}), ' ', '_')) OR contains(lower({p}), lower({c})) OR len({_WORDS(c)}) > 0 AND 2 * len([a FOR a IN {_WORDS(c)}
  IF len([b FOR b IN {_WORDS(f"replace({p}, '_', ' ')")} IF b NOT IN {_in(specs.NOT_NAMES)} AND (starts_with(a, b) OR starts_with(b, a))]) > 0]) >= len({_WORDS(c)}))"""  # noqa: E731
ORACLES["score_functional"] = HEAD + f""", pr AS (SELECT {KEY} AS key, {_PARAM} AS name, {PARAMETERS['role']} AS role, {PARAMETERS['constraint']} AS "constraint" FROM part),
cs AS (SELECT key, {_said("name")} AS name, role, temporal_status FROM constructs), es AS (SELECT DISTINCT key, {_said("cause")} AS cause, {_said("effect")} AS effect FROM edges WHERE cause IN ('c0', 'c3') AND effect <> 'c9'),
ch AS (SELECT key, variable AS name, max((distribution, link)) AS l FROM likelihoods GROUP BY key, variable),
hi AS (SELECT i.key, ch.key IS NOT NULL AS there, coalesce((coalesce(dtype, 'continuous'), l[1]) IN (SELECT * FROM {_rows(specs.DISTRIBUTIONS_OF_DTYPE)}), false) AS fits, coalesce((l[1], l[2]) IN (SELECT * FROM {_rows(specs.LINKS_OF_DISTRIBUTION)}), false) AS linked
  FROM indicators i LEFT JOIN ch ON i.key = ch.key AND i.name = ch.name),
gi AS (SELECT key, count(*) AS n, count_if(fits) AS fit, count_if(fits AND linked) AS linked, bool_and(there) AS covered FROM hi GROUP BY key),
gp AS (SELECT key, count(*) AS n, count_if(role NOT IN {_in(specs.CONSTRAINT_OF_ROLE)} OR (role, "constraint") IN (SELECT * FROM {_rows({k: [v] for k, v in specs.CONSTRAINT_OF_ROLE.items()})})) AS held FROM pr GROUP BY key),
gc AS (SELECT key, count(*) AS n, count_if(EXISTS (SELECT 1 FROM pr WHERE pr.key = cs.key AND pr.role = 'ar_coefficient' AND {_NAMES("cs.name", "pr.name")})) AS lagged FROM cs WHERE temporal_status = 'time_varying' AND role = 'endogenous' GROUP BY key),
ge AS (SELECT key, bool_and(EXISTS (SELECT 1 FROM pr WHERE pr.key = es.key AND {_NAMES("cause", "pr.name")} AND {_NAMES("effect", "pr.name")})) AS spoken FROM es GROUP BY key),
t AS (SELECT gi.key, 2 * fit AS likelihood, linked AS link, 3 * coalesce(lagged, 0) AS own_lag, held AS "constraint", CASE WHEN covered THEN 5 ELSE 0 END + CASE WHEN coalesce(spoken, false) THEN 3 ELSE 0 END AS bonus, 3 * gi.n + 3 * coalesce(gc.n, 0) + gp.n + 8 AS most
  FROM gi JOIN gp ON gi.key = gp.key LEFT JOIN gc ON gi.key = gc.key LEFT JOIN ge ON gi.key = ge.key)
SELECT key, CAST(likelihood AS BIGINT) AS likelihood, CAST(link AS BIGINT) AS link, CAST(own_lag AS BIGINT) AS own_lag, CAST("constraint" AS BIGINT) AS "constraint", CAST(bonus AS BIGINT) AS bonus,
  CAST(likelihood + link + own_lag + "constraint" + bonus AS BIGINT) AS score, CAST(most AS BIGINT) AS most, CAST(likelihood + link + own_lag + "constraint" + bonus AS DOUBLE) / CAST(most AS DOUBLE) AS share FROM t"""
