"""Roles, patterns, quality and repository queries over documents as functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import graph as C
from quillgraph.operators import quality as Q
from quillgraph.operators import roles as R
from quillgraph.operators import rollup as A
from quillgraph.plans import views as V
from quillgraph.plans.graph_queries import CHAINS_SQL, CLOSURE_SQL, PATHS_SQL, function_graph
from quillgraph.plans.registry import query

# The stand-in functions are shorter and less connected than source code, so the limits are lower.
LIMITS = Q.Limits(lines=(60, 20), fan_out=(2, 1), external=0, hub=3, depth=4)


def roled(spark, sf):
    return R.assign_roles(V.node_facts(spark, sf))


def linked_roled(spark, sf):
    nodes, edges = function_graph(spark, sf)
    return R.assign_roles(C.with_links(nodes, edges)), edges


def analysis(spark, sf) -> A.FileAnalysis:
    return A.analyse(V.node_facts(spark, sf), V.function_edges(spark, sf), LIMITS)


def profile(spark, sf):
    run = analysis(spark, sf)
    return run, A.file_profile(run, V.file_structure(spark, sf))


TX, FX = "list_contains(transforms, '{}')", "list_contains(effects, '{}')"
RULES_SQL = {
    "transformer": "n_params > 0 AND list_contains(transforms, 'arithmetic') AND len(effects) = 0",
    "predicate": "list_contains(transforms, 'comparison') AND complexity >= 2 AND len(effects) = 0",
    "aggregator": "list_contains(transforms, 'array_ops') AND n_params >= 1",
    "factory": "list_contains(transforms, 'object_ops') AND len(effects) = 0 AND n_params > 0",
    "orchestrator": "n_calls >= 3 AND complexity <= 3 AND len(transforms) <= 1",
    "io-handler": "(list_contains(effects, 'io') OR list_contains(effects, 'network') OR list_contains(effects, 'dom'))",
    "async-handler": "(is_async OR list_contains(effects, 'async'))",
    "validator": "list_contains(effects, 'throws') AND list_contains(transforms, 'comparison')",
    "iterator": "list_contains(transforms, 'iteration') AND NOT list_contains(transforms, 'array_ops')",
    "router": "complexity >= 4 AND list_contains(transforms, 'conditional') AND n_calls >= 2",
    "initializer": "n_writes >= 3 AND complexity <= 2 AND n_calls <= 2",
    "pure-function": "len(effects) = 0 AND n_params > 0 AND n_outer_writes = 0",
    "closure": "kind IN ('arrow', 'expression')",
    "middleware": "n_params >= 2 AND calls_next",
    "event-handler": "has_event_param",
    "generator-fn": "is_generator",
}
ROLE_SQL = "CASE " + " ".join(f"WHEN {RULES_SQL[r]} THEN '{r}'" for r in R.ROLE_PRIORITY if r in RULES_SQL) + " ELSE 'utility' END"
NODES = "WITH" + V.NODES_SQL
ROLED = NODES + f",\nroled AS (SELECT *, {ROLE_SQL} AS role FROM nodes)"
LINKED_BODY = V.NODES_SQL + V.FN_EDGES_SQL + V.CLASSIFIED_SQL + f",\nroled AS (SELECT *, {ROLE_SQL} AS role FROM linked)"
LINKED = "WITH" + LINKED_BODY
RECURSIVE = "WITH RECURSIVE" + LINKED_BODY


@query("r1_role_rules", NODES + " SELECT file, fn, " + ", ".join(
    f'({sql}) AS "{name}"' for name, sql in RULES_SQL.items()) + " FROM nodes")
def r1(spark, sf):
    return V.node_facts(spark, sf).select("file", "fn", *[c.alias(name) for name, c in R.role_rules().items()])


@query("r2_role_priority", ROLED + " SELECT file, fn, role FROM roled")
def r2(spark, sf):
    return roled(spark, sf).select("file", "fn", "role")


PATTERNS_SQL = """,
deco AS (SELECT DISTINCT a.file FROM ce a JOIN ce b ON a.file = b.file AND a.to_fn = b.to_fn AND a.from_fn <> b.from_fn
  JOIN roled f ON f.file = a.file AND f.fn = a.from_fn AND f.role = 'factory' AND f.n_params >= 1
  JOIN roled g ON g.file = b.file AND g.fn = b.from_fn AND g.kind IN ('arrow', 'expression')),
pf AS (SELECT file, bool_or(writes_instance AND complexity >= 2) AS singleton, bool_or(calls_observer) AS observer,
  count(*) FILTER (WHERE role = 'factory') >= 2 AS factory, count(*) FILTER (WHERE role = 'middleware') >= 2 AS middleware,
  count(*) FILTER (WHERE fan_out = 1 AND fan_in <= 1) >= 2 AS chain, bool_or(role = 'orchestrator' AND has_strategy_param) AS strategy,
  bool_or(reads_cache AND len(effects) = 0) AS memo, count(*) FILTER (WHERE len(effects) = 0 AND n_calls >= 2 AND role = 'factory') >= 3 AS builder FROM roled GROUP BY 1),
patterns AS (SELECT file, 1 AS o, 'Singleton' AS pattern FROM pf WHERE singleton UNION ALL SELECT file, 2, 'Observer/EventEmitter' FROM pf WHERE observer
  UNION ALL SELECT file, 3, 'Factory' FROM pf WHERE factory UNION ALL SELECT file, 4, 'Middleware Chain' FROM pf WHERE middleware
  UNION ALL SELECT file, 5, 'Pipeline' FROM pf WHERE chain UNION ALL SELECT file, 6, 'Strategy' FROM pf WHERE strategy
  UNION ALL SELECT file, 7, 'Decorator/HOF' FROM deco UNION ALL SELECT file, 8, 'Memoization' FROM pf WHERE memo
  UNION ALL SELECT file, 9, 'Builder' FROM pf WHERE builder
  UNION ALL SELECT DISTINCT file, 10, 'Recursive Descent' FROM ce WHERE from_fn = to_fn)"""


@query("r3_file_patterns", LINKED + PATTERNS_SQL + " SELECT file, pattern FROM patterns")
def r3(spark, sf):
    return R.file_patterns(*linked_roled(spark, sf)).select("file", "pattern")


TOP_ROLES_SQL = """,
rc AS (SELECT file, role, count(*) AS n, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, role) AS rank FROM roled GROUP BY 1, 2)"""


@query("r5_dominant_roles", ROLED + TOP_ROLES_SQL + " SELECT file, role, n, rank::INTEGER AS rank FROM rc WHERE rank <= 3")
def r5(spark, sf):
    return R.dominant_roles(roled(spark, sf))


EFFECT_SQL = """,
fe AS (SELECT file, effect, count(*) AS n, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, effect) AS rank
  FROM (SELECT file, unnest(effects) AS effect FROM nodes) GROUP BY 1, 2)"""


@query("r6_dominant_effect", NODES + EFFECT_SQL + " SELECT file, effect, n FROM fe WHERE rank = 1")
def r6(spark, sf):
    return R.dominant_effect(V.node_facts(spark, sf))


FACTS_SQL = PATHS_SQL + """,
sig AS (SELECT *, (len(transforms) > 5)::INTEGER + (len(effects) > 3)::INTEGER + (complexity > 8 AND n_calls > 5)::INTEGER AS signals FROM roled),
coh AS (SELECT *, signals >= 2 AS is_god, signals < 2 AND len(transforms) > 3 AND len(effects) >= 2 AS is_mixed FROM sig),
facts AS (SELECT file, count(*) AS n_nodes, round(avg(complexity), 1) AS avg_complexity, max(nesting) AS max_nesting,
  count(*) FILTER (WHERE lines > 20) AS n_long, sum(fan_out)::BIGINT AS sum_fan_out, count(*) FILTER (WHERE fan_in + fan_out > 0) AS n_linked,
  count(*) FILTER (WHERE is_god) AS n_god, count(*) FILTER (WHERE is_mixed) AS n_mixed,
  count(*) FILTER (WHERE n_params = 0 AND n_reads > 3) AS n_global_readers,
  count(*) FILTER (WHERE is_async AND NOT list_contains(effects, 'throws') AND NOT calls_catch) AS n_uncaught,
  count(*) FILTER (WHERE list_contains(effects, 'mutation') AND n_params > 0) AS n_mutators, count(*) FILTER (WHERE role = 'utility') AS n_utility,
  count(*) FILTER (WHERE role = 'pure-function') AS n_pure, count(*) FILTER (WHERE is_async) AS n_async,
  count(*) FILTER (WHERE role IN ('io-handler', 'event-handler') OR (n_params > 0 AND role <> 'factory')) AS n_inputs FROM coh GROUP BY 1),
fd AS (SELECT * FROM facts JOIN depth USING (file)),
debt AS (SELECT file, 1 AS sub, 'medium' AS severity, 'global coupling' AS category, n_global_readers AS n, n_global_readers || ' functions read outer state without parameters' AS message FROM fd WHERE n_global_readers > 0
  UNION ALL SELECT file, 2, 'high', 'error handling', n_uncaught, n_uncaught || ' asynchronous functions without error handling' FROM fd WHERE n_uncaught > 0
  UNION ALL SELECT file, 3, 'medium', 'mutation', n_mutators, n_mutators || ' functions change what they are given' FROM fd WHERE n_mutators > 0
  UNION ALL SELECT file, 4, 'low', 'structure', 1, floor(n_utility / n_nodes * 100 + 0.5)::BIGINT || ' percent of functions unclassified' FROM fd WHERE n_utility / n_nodes > 0.4 AND n_nodes > 4
  UNION ALL SELECT file, 5, 'medium', 'depth', 1, 'calls nest ' || max_call_depth || ' deep' FROM fd WHERE max_call_depth > 4),
dsum AS (SELECT file, sum(CASE severity WHEN 'high' THEN 18 WHEN 'medium' THEN 8 ELSE 3 END) AS penalty,
  round(sum(CASE severity WHEN 'high' THEN 3.0 * n WHEN 'medium' THEN 1.5 * n ELSE 0.5 END)::DOUBLE, 1) AS hours FROM debt GROUP BY 1),
scores AS (SELECT fd.*, greatest(0, least(100, floor(100.0::DOUBLE - (avg_complexity - 1) * 8 - max_nesting * 5 - (n_long / n_nodes) * 20 + 0.5)))::BIGINT AS complexity_score,
  greatest(0, least(100, floor(100.0::DOUBLE - sum_fan_out / n_nodes * 6 - least(n_linked, 5) * 4 + 0.5)))::BIGINT AS coupling_score,
  greatest(0, least(100, 100 - n_god * 20 - n_mixed * 8))::BIGINT AS cohesion_score,
  greatest(0, least(100, 100 - coalesce(penalty, 0)))::BIGINT AS debt_score, coalesce(hours, 0)::DOUBLE AS refactor_hours FROM fd LEFT JOIN dsum USING (file)),
final AS (SELECT *, floor(complexity_score * 0.30::DOUBLE + coupling_score * 0.25::DOUBLE + cohesion_score * 0.25::DOUBLE + debt_score * 0.20::DOUBLE + 0.5)::BIGINT AS score FROM scores)"""
SCORED = RECURSIVE + FACTS_SQL


@query("r7_complexity_class", SCORED + """
SELECT file, CASE WHEN avg_complexity > 5 OR max_call_depth > 4 THEN 'high' WHEN avg_complexity > 3 THEN 'medium' ELSE 'low' END AS complexity_class FROM fd""")
def r7(spark, sf):
    run = analysis(spark, sf)
    return run.facts.select("file", R.complexity_class(F.col("avg_complexity"), F.col("max_call_depth")).alias("complexity_class"))


def _words_sql(col: str, words: dict[str, str], joiner: str, n: int | None = None) -> str:
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items())
    named = f"list_transform({col}, lambda t: CASE t {case} ELSE t END)"
    return f"array_to_string({named}{f'[1:{n}]' if n else ''}, '{joiner}')"


KINDS_OF_WORK = f"CASE WHEN len(transforms) = 0 THEN 'general operations' ELSE {_words_sql('transforms', R.TRANSFORM_WORDS, ', ', 3)} END"
VIA = "CASE WHEN n_calls > 0 THEN ' through ' || n_calls || ' calls' ELSE '' END"
NUMERIC = "CASE WHEN list_contains(transforms, 'arithmetic') THEN '{}' ELSE '{}' END"


@query("r8_function_explanations", ROLED + f""",
b AS (SELECT *, CASE role WHEN 'transformer' THEN 'turns ' || n_params || ' inputs into a new value by ' || {KINDS_OF_WORK}
  WHEN 'predicate' THEN 'tests ' || (complexity - 1) || ' conditions for a yes or no'
  WHEN 'aggregator' THEN 'walks a collection and ' || {NUMERIC.format('computes a figure', 'picks or reorders items')}
  WHEN 'factory' THEN 'builds a structure from ' || n_params || ' parameters' WHEN 'orchestrator' THEN 'coordinates ' || n_calls || ' calls'
  WHEN 'io-handler' THEN 'deals with ' || CASE WHEN len(effects) = 0 THEN 'an outside system' ELSE {_words_sql('effects', R.EFFECT_WORDS, ' and ')} END
  WHEN 'async-handler' THEN 'runs a deferred flow' || {VIA} WHEN 'validator' THEN 'checks data against ' || (complexity - 1) || ' rules'
  WHEN 'iterator' THEN 'steps through a structure ' || {NUMERIC.format('computing on each item', 'handling each item')}
  WHEN 'router' THEN 'sends the flow down one of ' || (complexity - 1) || ' paths' WHEN 'initializer' THEN 'sets up ' || n_writes || ' variables'
  WHEN 'pure-function' THEN 'computes from ' || n_params || ' parameters without effects' WHEN 'middleware' THEN 'intercepts a request and hands it on'
  WHEN 'event-handler' THEN 'reacts to an event' WHEN 'generator-fn' THEN 'yields values on demand from ' || complexity || ' points'
  WHEN 'closure' THEN 'captures outer state' || {VIA} ELSE 'supports with ' || {KINDS_OF_WORK} END AS base,
  concat_ws(', ', CASE WHEN is_async THEN 'asynchronous' END, CASE WHEN is_generator THEN 'as a generator' END,
    CASE WHEN complexity > 8 THEN 'complex with ' || complexity || ' paths' END, CASE WHEN nesting > 4 THEN 'nested ' || nesting || ' deep' END) AS extra FROM roled)
SELECT file, fn, CASE WHEN extra = '' THEN base ELSE base || '; ' || extra END AS explanation FROM b""")
def r8(spark, sf):
    return R.explain_function(roled(spark, sf)).select("file", "fn", "explanation")


GROUPS_SQL = """,
free AS (SELECT r.file, r.fn, r.role FROM roled r WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.file = r.file AND cl.member = r.fn)),
rg AS (SELECT file, fn, role, count(*) OVER (PARTITION BY file, role) AS group_size FROM free)"""


@query("c14_role_groups", RECURSIVE + CLOSURE_SQL + GROUPS_SQL + """
SELECT file, fn, role, group_size, CASE WHEN group_size >= 2 THEN 'role-group' ELSE 'singleton' END AS group_type FROM rg""")
def c14(spark, sf):
    return C.role_groups(*linked_roled(spark, sf))


@query("r8_group_explanations", RECURSIVE + CLOSURE_SQL + GROUPS_SQL + """,
k AS (SELECT cl.file, cl.start_fn, r.role, count(*) AS k FROM cl JOIN roled r ON r.file = cl.file AND r.fn = cl.member GROUP BY 1, 2, 3),
t AS (SELECT file, start_fn, sum(k)::BIGINT AS n, array_to_string((list(role ORDER BY k DESC, role))[1:3], ', ') AS roles FROM k GROUP BY 1, 2)
SELECT file, 'cluster' AS group_type, start_fn AS lead, n, 'subsystem of ' || n || ' functions, mostly ' || roles AS explanation FROM t
UNION ALL SELECT file, CASE WHEN count(*) >= 2 THEN 'role-group' ELSE 'singleton' END, role, count(*),
  CASE WHEN count(*) >= 2 THEN count(*) || ' variations of ' || role ELSE 'stands alone as ' || role END FROM free GROUP BY file, role""")
def r8_groups(spark, sf):
    run = analysis(spark, sf)
    members = C.clusters(run.nodes.select("file", "fn"), run.edges)
    return R.explain_groups(members, C.role_groups(run.nodes, run.edges), run.nodes)


PROFILE_SQL = V.STRUCTURE_SQL + FACTS_SQL + PATTERNS_SQL + TOP_ROLES_SQL + EFFECT_SQL + CHAINS_SQL + """,
pl AS (SELECT file, list(pattern ORDER BY o) AS patterns FROM patterns GROUP BY 1),
tr AS (SELECT file, string_agg(role, ', ' ORDER BY rank) AS top_roles FROM rc WHERE rank <= 3 GROUP BY 1),
lc AS (SELECT file, max(len(chain)) AS longest_chain, min_by(array_to_string(chain, ' > '), from_fn || to_fn) AS first_chain FROM chains GROUP BY 1),
ae AS (SELECT file, list(DISTINCT e) AS all_effects FROM (SELECT file, unnest(effects) AS e FROM nodes) GROUP BY 1),
atx AS (SELECT file, list(DISTINCT t ORDER BY t) AS all_transforms FROM (SELECT file, unnest(transforms) AS t FROM nodes) GROUP BY 1),
pr AS (SELECT f.*, coalesce(pl.patterns, []) AS patterns, tr.top_roles, coalesce(lc.longest_chain, 0) AS longest_chain, lc.first_chain,
  fe.effect AS dominant_effect, s.repo, n_classes, n_inheriting, n_imports, n_exports, coalesce(all_effects, []) AS all_effects, coalesce(all_transforms, []) AS all_transforms
  FROM final f JOIN structure s USING (file) LEFT JOIN pl USING (file) LEFT JOIN tr USING (file) LEFT JOIN lc USING (file) LEFT JOIN ae USING (file) LEFT JOIN atx USING (file)
  LEFT JOIN fe ON fe.file = f.file AND fe.rank = 1),
st AS (SELECT *, concat_ws(' + ', CASE WHEN n_inheriting > 0 THEN 'objects with inheritance' WHEN n_classes > 0 THEN 'objects' END,
  CASE WHEN list_contains(patterns, 'Pipeline') AND list_contains(patterns, 'Middleware Chain') THEN 'staged middleware'
    WHEN list_contains(patterns, 'Pipeline') OR longest_chain >= 3 THEN 'staged processing' WHEN list_contains(patterns, 'Middleware Chain') THEN 'middleware chain' END,
  CASE WHEN list_contains(patterns, 'Observer/EventEmitter') THEN 'event-driven' END, CASE WHEN list_contains(patterns, 'Singleton') AND n_imports > 3 THEN 'shared state' END,
  CASE WHEN n_pure / n_nodes > 0.5 THEN 'functional' END, CASE WHEN n_async / n_nodes > 0.3 THEN 'asynchronous' END) AS signals FROM pr),
styled AS (SELECT *, CASE WHEN signals <> '' THEN signals WHEN n_nodes <= 3 THEN 'small utility' ELSE 'unstructured procedures' END AS style FROM st)"""
PROFILE = RECURSIVE + PROFILE_SQL


@query("r9_architecture_style", PROFILE + " SELECT file, style FROM styled")
def r9(spark, sf):
    return profile(spark, sf)[1].select("file", "style")


NARRATIVE_SQL = """concat_ws('; ', CASE WHEN n_inheriting > 0 THEN 'object system of ' || n_classes || ' classes, ' || n_inheriting || ' inheriting'
    WHEN n_classes > 0 THEN 'class-based, ' || n_classes || ' classes' ELSE 'functional, ' || n_nodes || ' functions' END,
  CASE WHEN n_exports > 0 THEN 'exports ' || n_exports END, CASE WHEN n_imports > 0 THEN 'imports ' || n_imports END, 'mostly ' || top_roles,
  CASE WHEN len(patterns) > 0 THEN 'patterns ' || array_to_string(patterns, ', ') END,
  CASE WHEN dominant_effect IN ('network', 'io', 'dom') THEN 'oriented to ' || dominant_effect END,
  CASE WHEN max_call_depth > 0 THEN 'call depth ' || max_call_depth END,
  CASE WHEN avg_complexity > 5 OR max_call_depth > 4 THEN 'high structural complexity' END)"""


@query("r8_file_narratives", PROFILE + f""",
z AS (SELECT file, {NARRATIVE_SQL} AS narrative, concat_ws('; ', CASE WHEN n_inputs > 0 THEN 'takes data at ' || n_inputs || ' points' END,
  CASE WHEN len(all_transforms) > 0 THEN 'applies ' || {_words_sql('all_transforms', R.TRANSFORM_WORDS, ', ', 4)} END,
  'main flow ' || first_chain, CASE WHEN list_contains(all_effects, 'network') THEN 'uses the network' END,
  CASE WHEN list_contains(all_effects, 'io') THEN 'reads or writes files' END, CASE WHEN list_contains(all_effects, 'dom') THEN 'changes the page' END,
  CASE WHEN list_contains(all_effects, 'mutation') THEN 'keeps mutable state' END, CASE WHEN n_exports > 0 THEN 'exposes ' || n_exports || ' symbols' END) AS behaviour FROM styled)
SELECT file, narrative, CASE WHEN behaviour = '' THEN 'internal, no public interface seen' ELSE behaviour END AS behaviour FROM z""")
def r8_files(spark, sf):
    return profile(spark, sf)[1].select("file", "narrative", "behaviour")


def _issue_sql(source: str, section: int, rows: list[tuple[str, str, int, str, str, str]]) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT file, {section} AS section, seq::BIGINT AS seq, {sub} AS sub, '{severity}' AS severity, fn AS scope, '{metric}' AS metric, "
        f"({value})::DOUBLE AS value, {message} AS message FROM {source} WHERE {cond}"
        for cond, severity, sub, metric, value, message in rows)


CX_SQL = _issue_sql("roled", 1, [
    ("complexity > 10", "high", 1, "cyclomatic", "complexity", "complexity || ' paths: very hard to test'"),
    ("complexity > 7 AND complexity <= 10", "medium", 1, "cyclomatic", "complexity", "complexity || ' paths: complex'"),
    ("nesting > 4", "high", 2, "nesting", "nesting", "'nested ' || nesting || ' deep: refactor'"),
    ("nesting > 3 AND nesting <= 4", "medium", 2, "nesting", "nesting", "'nested ' || nesting || ' deep'"),
    ("lines > 60", "high", 3, "length", "lines", "lines || ' lines: very long'"),
    ("lines > 20 AND lines <= 60", "medium", 3, "length", "lines", "lines || ' lines: split it'"),
    ("n_params > 5", "medium", 4, "parameters", "n_params", "n_params || ' parameters: pass an object'")])
CP_SQL = _issue_sql("roled", 2, [
    ("fan_out > 2", "high", 1, "fan-out", "fan_out", "'calls ' || fan_out || ' functions: too dependent'"),
    ("fan_out > 1 AND fan_out <= 2", "medium", 1, "fan-out", "fan_out", "'calls ' || fan_out || ' functions'"),
    ("n_external > 0", "medium", 2, "external-calls", "n_external", "n_external || ' external calls: tightly bound'")])
HUB_SQL = _issue_sql("(SELECT file, fn, fan_in + fan_out AS s, 1000000000 + row_number() OVER (PARTITION BY file ORDER BY fan_in + fan_out DESC, fn) AS seq FROM roled WHERE fan_in + fan_out > 0)", 2, [
    ("s > 3 AND seq <= 1000000005", "medium", 3, "hub", "s", "'central with ' || s || ' links: single point of failure'")])
CO_SQL = _issue_sql("coh", 3, [
    ("is_god", "high", 1, "cohesion", "len(transforms)", "len(transforms) || ' kinds of work: too many duties'"),
    ("is_mixed", "medium", 1, "cohesion", "len(transforms)", "len(transforms) || ' kinds of work mixed with effects'")])
ISSUE_COLS = ("file", "section", "seq", "sub", "severity", "scope", "metric", "value", "message")
COH_SQL = """,
sig AS (SELECT *, (len(transforms) > 5)::INTEGER + (len(effects) > 3)::INTEGER + (complexity > 8 AND n_calls > 5)::INTEGER AS signals FROM roled),
coh AS (SELECT *, signals >= 2 AS is_god, signals < 2 AND len(transforms) > 3 AND len(effects) >= 2 AS is_mixed FROM sig)"""
ISSUES_SQL = f""",
issues AS ({CX_SQL}
  UNION ALL {CP_SQL}
  UNION ALL {HUB_SQL}
  UNION ALL {CO_SQL}
  UNION ALL SELECT file, 4, 0, sub, severity, category, category, n::DOUBLE, message FROM debt)"""


@query("q1_complexity_issues", ROLED + " " + CX_SQL)
def q1(spark, sf):
    return Q.complexity_issues(roled(spark, sf), LIMITS)


@query("q3_coupling_issues", LINKED + " " + CP_SQL + " UNION ALL " + HUB_SQL)
def q3(spark, sf):
    return Q.coupling_issues(linked_roled(spark, sf)[0], LIMITS)


@query("q5_cohesion_issues", ROLED + COH_SQL + " " + CO_SQL)
def q5(spark, sf):
    return Q.cohesion_issues(roled(spark, sf))


@query("q6_redundant_groups", ROLED + """,
k AS (SELECT file, fn, array_to_string(list_sort(transforms), ':') AS transform_key FROM roled WHERE role = 'pure-function' AND len(transforms) > 0),
c AS (SELECT *, count(*) OVER (PARTITION BY file, transform_key) AS group_size FROM k)
SELECT * FROM c WHERE group_size >= 2""")
def q6(spark, sf):
    return Q.redundant_groups(roled(spark, sf))


@query("q6_redundant_groups_by_corpus", ROLED + """,
k AS (SELECT 'corpus' AS file, file || '#' || fn AS fn, array_to_string(list_sort(transforms), ':') AS transform_key FROM roled WHERE role = 'pure-function' AND len(transforms) > 0),
c AS (SELECT *, count(*) OVER (PARTITION BY file, transform_key) AS group_size FROM k)
SELECT * FROM c WHERE group_size >= 2""")
def q6_corpus(spark, sf):
    whole = roled(spark, sf).withColumn("fn", F.concat("file", F.lit("#"), "fn")).withColumn("file", F.lit("corpus"))
    return Q.redundant_groups(whole)


@query("q6_redundant_groups_io", ROLED + """,
k AS (SELECT file, fn, array_to_string(list_sort(transforms), ':') AS transform_key FROM roled WHERE role = 'io-handler' AND len(transforms) > 0),
c AS (SELECT *, count(*) OVER (PARTITION BY file, transform_key) AS group_size FROM k)
SELECT * FROM c WHERE group_size >= 2""")
def q6_io(spark, sf):
    return Q.redundant_groups(roled(spark, sf), "io-handler")


@query("q2_complexity_score", NODES + """,
f AS (SELECT file, round(avg(complexity), 1) AS a, max(nesting) AS m, count(*) FILTER (WHERE lines > 20) / count(*) AS l FROM nodes GROUP BY 1)
SELECT file, greatest(0, least(100, floor(100.0::DOUBLE - (a - 1) * 8 - m * 5 - l * 20 + 0.5)))::BIGINT AS complexity_score FROM f""")
def q2(spark, sf):
    # Links are not needed for this score.
    nodes = roled(spark, sf).withColumn("fan_in", F.lit(0)).withColumn("fan_out", F.lit(0))
    return Q.file_facts(nodes, LIMITS).select("file", Q.complexity_score().alias("complexity_score"))


@query("q4_coupling_score", LINKED + """,
f AS (SELECT file, sum(fan_out) / count(*) AS a, least(5, count(*) FILTER (WHERE fan_in + fan_out > 0)) AS h FROM linked GROUP BY 1)
SELECT file, greatest(0, least(100, floor(100.0::DOUBLE - a * 6 - h * 4 + 0.5)))::BIGINT AS coupling_score FROM f""")
def q4(spark, sf):
    return Q.file_facts(linked_roled(spark, sf)[0], LIMITS).select("file", Q.coupling_score().alias("coupling_score"))


@query("q7_cohesion_score", ROLED + COH_SQL + """
SELECT file, greatest(0, least(100, 100 - 20 * count(*) FILTER (WHERE is_god) - 8 * count(*) FILTER (WHERE is_mixed)))::BIGINT AS cohesion_score FROM coh GROUP BY 1""")
def q7(spark, sf):
    nodes = roled(spark, sf).withColumn("fan_in", F.lit(0)).withColumn("fan_out", F.lit(0))
    return Q.file_facts(nodes, LIMITS).select("file", Q.cohesion_score().alias("cohesion_score"))


@query("q9_debt_items", SCORED + " SELECT file, sub, severity, category, n, message FROM debt")
def q9(spark, sf):
    return Q.debt_items(analysis(spark, sf).facts, LIMITS)


@query("q10_debt_score", SCORED + " SELECT file, debt_score FROM scores")
def q10(spark, sf):
    return Q.with_debt(analysis(spark, sf).facts, LIMITS).select("file", "debt_score")


@query("q11_refactor_hours", SCORED + " SELECT file, refactor_hours FROM scores")
def q11(spark, sf):
    return Q.with_debt(analysis(spark, sf).facts, LIMITS).select("file", "refactor_hours")


@query("q12_global_score", SCORED + " SELECT file, complexity_score, coupling_score, cohesion_score, debt_score, score FROM final")
def q12(spark, sf):
    return Q.with_scores(analysis(spark, sf).facts, LIMITS).select(
        "file", "complexity_score", "coupling_score", "cohesion_score", "debt_score", "score")


@query("q13_hotspots", NODES + " SELECT file, fn, complexity, nesting FROM nodes WHERE complexity > 7 OR nesting > 3")
def q13(spark, sf):
    return Q.hotspots(V.node_facts(spark, sf), LIMITS).select("file", "fn", "complexity", "nesting")


RECOMMEND_SQL = ISSUES_SQL + """,
ri AS (SELECT *, row_number() OVER (PARTITION BY file, severity ORDER BY section, seq, sub) AS i FROM issues),
hs AS (SELECT file, fn, row_number() OVER (PARTITION BY file ORDER BY seq, fn) AS i FROM roled WHERE complexity > 7 OR nesting > 3),
us AS (SELECT file, fn, row_number() OVER (PARTITION BY file ORDER BY seq, fn) AS i FROM roled WHERE fan_in + fan_out > 0 AND round(fan_out / (fan_in + fan_out), 2) > 0.8),
ga AS (SELECT file, i AS place, 'high' AS priority, scope, message AS action FROM ri WHERE severity = 'high' AND i <= 4
  UNION ALL SELECT file, 10 + i, 'medium', scope, message FROM ri WHERE severity = 'medium' AND i <= 3
  UNION ALL SELECT file, 21, 'high', string_agg(fn, ', ' ORDER BY i), 'break into smaller functions' FROM hs WHERE i <= 3 GROUP BY file
  UNION ALL SELECT file, 31, 'medium', string_agg(fn, ', ' ORDER BY i), 'lower instability by inverting dependencies' FROM us WHERE i <= 3 GROUP BY file),
de AS (SELECT *, row_number() OVER (PARTITION BY file, substr(action, 1, 60) ORDER BY place) AS i FROM ga),
rec AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY place)::INTEGER AS place, priority, scope, action FROM de WHERE i = 1),
wk AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY section, seq, sub)::INTEGER AS rank, scope, message FROM issues WHERE severity = 'high')"""


@query("q14_recommendations", SCORED + RECOMMEND_SQL + " SELECT file, place, priority, scope, action FROM rec")
def q14(spark, sf):
    run = analysis(spark, sf)
    return Q.recommendations(run.nodes, run.issues, LIMITS)


@query("q15_top_weaknesses", SCORED + RECOMMEND_SQL + " SELECT file, rank, scope, message FROM wk WHERE rank <= 3")
def q15(spark, sf):
    return Q.top_weaknesses(analysis(spark, sf).issues)


def _top_sql(source: str, value: str, n: int) -> str:
    return f""",
g AS (SELECT repo, {value}, count(*) AS n, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, {value}) AS rank FROM {source} GROUP BY 1, 2)
SELECT repo, {value}, n, rank::INTEGER AS rank FROM g WHERE rank <= {n}"""


@query("a1_role_counts", ROLED + _top_sql("roled", "role", 8))
def a1(spark, sf):
    return R.value_counts(roled(spark, sf).select("repo", "role"), "repo", "role", A.TOP_ROLES)


@query("a2_pattern_counts", LINKED + PATTERNS_SQL + _top_sql("(SELECT split_part(file, '/', 1) AS repo, pattern FROM patterns)", "pattern", 6))
def a2(spark, sf):
    patterns = R.file_patterns(*linked_roled(spark, sf)).select(F.substring_index("file", "/", 1).alias("repo"), "pattern")
    return R.value_counts(patterns, "repo", "pattern", A.TOP_PATTERNS)


@query("a3_effect_counts", NODES + _top_sql("(SELECT repo, unnest(effects) AS effect FROM nodes)", "effect", 5))
def a3(spark, sf):
    return R.value_counts(V.node_facts(spark, sf).select("repo", F.explode("effects").alias("effect")), "repo", "effect", A.TOP_EFFECTS)


@query("a4_style_counts", PROFILE + _top_sql("styled", "style", 4))
def a4(spark, sf):
    return R.value_counts(profile(spark, sf)[1].select("repo", "style"), "repo", "style", A.TOP_STYLES)


WEAK = "(SELECT split_part(file, '/', 1) AS repo, message FROM wk WHERE rank <= 3)"


@query("a5_weakness_counts", SCORED + RECOMMEND_SQL + _top_sql(WEAK, "message", 5))
def a5(spark, sf):
    weak = Q.top_weaknesses(analysis(spark, sf).issues).select(F.substring_index("file", "/", 1).alias("repo"), "message")
    return R.value_counts(weak, "repo", "message", A.TOP_WEAKNESSES)


def scored_files(spark, sf):
    return Q.with_scores(analysis(spark, sf).facts, LIMITS).withColumn("repo", F.substring_index("file", "/", 1))


@query("a6_avg_quality", SCORED + """
SELECT split_part(file, '/', 1) AS repo, floor(avg(score) + 0.5)::BIGINT AS avg_quality FROM final GROUP BY 1""")
def a6(spark, sf):
    return A.quality_distribution(scored_files(spark, sf), ["repo"]).select("repo", "avg_quality")


@query("a7_quality_distribution", SCORED + """
SELECT split_part(file, '/', 1) AS repo, count(*) AS n_files, floor(avg(score) + 0.5)::BIGINT AS avg_quality, count(*) FILTER (WHERE score >= 80) AS excellent,
  count(*) FILTER (WHERE score >= 60 AND score < 80) AS good, count(*) FILTER (WHERE score >= 40 AND score < 60) AS fair, count(*) FILTER (WHERE score < 40) AS poor
FROM final GROUP BY 1""")
def a7(spark, sf):
    return A.quality_distribution(scored_files(spark, sf), ["repo"])


@query("a8_file_counters", """
WITH p AS (SELECT event_type AS repo, CASE WHEN event_type = 'error' THEN 'fetch_failed' END AS error,
  CASE WHEN json_valid(props) AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 THEN NULL ELSE 'parse_failed' END AS parse_error FROM events)
SELECT repo, count(*) AS n_files, count(*) FILTER (WHERE error IS NULL AND parse_error IS NULL) AS n_analysed, count(error) AS n_fetch_errors,
  count(*) FILTER (WHERE error IS NULL AND parse_error IS NOT NULL) AS n_parse_errors FROM p GROUP BY 1""")
def a8(spark, sf):
    from quillgraph.session import table

    k = F.get_json_object("props", "$.k").try_cast("long")
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("repo"), F.when(F.col("event_type") == "error", "fetch_failed").alias("error"),
        F.when(F.coalesce(k >= 50, F.lit(False)), None).otherwise("parse_failed").alias("parse_error"))
    return A.file_counters(rows, ["repo"])


@query("a9_file_summary", PROFILE + """,
rl AS (SELECT file, string_agg(role || '=' || n, ',' ORDER BY role || '=' || n) AS roles FROM rc GROUP BY 1)
SELECT file, style, score, roles FROM styled LEFT JOIN rl USING (file)""")
def a9(spark, sf):
    run, files = profile(spark, sf)
    return A.file_summary(files, run.nodes)


FACETS = PROFILE + RECOMMEND_SQL + """,
fa AS (SELECT repo, 'role' AS facet, role AS value FROM roled UNION ALL SELECT repo, 'effect', unnest(effects) FROM nodes
  UNION ALL SELECT split_part(file, '/', 1), 'pattern', pattern FROM patterns UNION ALL SELECT repo, 'style', style FROM styled
  UNION ALL SELECT split_part(file, '/', 1), 'weakness', message FROM wk WHERE rank <= 3),
fr AS (SELECT repo, facet, value, count(*) AS n, row_number() OVER (PARTITION BY repo, facet ORDER BY count(*) DESC, value) AS rank FROM fa GROUP BY 1, 2, 3)"""


@query("a10_facet_top_n", FACETS + """
SELECT repo, facet, value, n, rank::INTEGER AS rank FROM fr WHERE rank <= CASE facet WHEN 'role' THEN 8 WHEN 'pattern' THEN 6 WHEN 'style' THEN 4 ELSE 5 END""")
def a10(spark, sf):
    run, files = profile(spark, sf)
    return A.repo_facets(run.nodes, files, R.file_patterns(run.nodes, run.edges), Q.top_weaknesses(run.issues))


@query("s9_report_json", PROFILE + RECOMMEND_SQL + f""",
rel AS (SELECT file, least(20, count(*)) AS n FROM ce GROUP BY 1), cn AS (SELECT file, least(5, count(*)) AS n FROM chains GROUP BY 1)
SELECT s.file, n_nodes::VARCHAR AS n_nodes, coalesce(rel.n, 0) AS n_relations, coalesce(cn.n, 0) AS n_chains, style, score::VARCHAR AS score, {NARRATIVE_SQL} AS narrative,
  (SELECT count(*) FROM rec WHERE rec.file = s.file) AS n_recommendations, (SELECT action FROM rec WHERE rec.file = s.file AND place = 1) AS first_action,
  (SELECT message FROM wk WHERE wk.file = s.file AND rank = 1) AS first_weakness FROM styled s LEFT JOIN rel USING (file) LEFT JOIN cn USING (file)""")
def s9(spark, sf):
    run, files = profile(spark, sf)
    field = lambda path: F.get_json_object("report", path)
    length = lambda path: F.coalesce(F.json_array_length(field(path)), F.lit(0)).cast("long")
    return A.report_json(run, files).select(
        "file", field("$.structure.n_nodes").alias("n_nodes"), length("$.graph.relations").alias("n_relations"),
        length("$.graph.chains").alias("n_chains"), field("$.synthesis.style").alias("style"), field("$.quality.score").alias("score"),
        field("$.intent.narrative").alias("narrative"), length("$.quality.recommendations").alias("n_recommendations"),
        field("$.quality.recommendations[0].action").alias("first_action"), field("$.synthesis.weaknesses[0].message").alias("first_weakness"))


@query("s9_report_lines", ROLED + " SELECT file, seq::INTEGER AS seq, fn, role, complexity::VARCHAR AS complexity FROM roled")
def s9_lines(spark, sf):
    field = lambda name: F.get_json_object("line", f"$.{name}").alias(name)
    return A.report_lines(analysis(spark, sf)).select("file", "seq", field("fn"), field("role"), field("complexity"))
