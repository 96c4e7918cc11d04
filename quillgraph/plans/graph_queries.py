"""Graph queries over days of events, documents as functions, and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions.text import hashed_choice
from quillgraph.operators import graph as C
from quillgraph.plans import views as V
from quillgraph.plans.registry import query

DAYS = V.DAYS_SQL + V.CLASSIFIED_SQL


def day_graph(spark, sf):
    nodes = V.day_nodes(spark, sf)
    return nodes, C.call_edges(V.day_edges(spark, sf), nodes)


def linked_days(spark, sf):
    nodes, edges = day_graph(spark, sf)
    return C.with_links(nodes, edges), edges


@query("c1_call_edges", DAYS + " SELECT file, from_fn, to_fn, kind FROM ce")
def c1(spark, sf):
    return day_graph(spark, sf)[1]


@query("c2_adjacency", DAYS + """
SELECT n.file, n.fn, ce.to_fn AS callee FROM nodes n LEFT JOIN ce ON ce.file = n.file AND ce.from_fn = n.fn AND ce.kind = 'internal'""")
def c2(spark, sf):
    return C.adjacency(*day_graph(spark, sf))


@query("c3_fan_in_out", DAYS + " SELECT file, fn, fan_in, fan_out, n_external FROM linked")
def c3(spark, sf):
    return linked_days(spark, sf)[0].select("file", "fn", "fan_in", "fan_out", "n_external")


SUPPLY = V.SUPPLY_SQL + """,
i AS (SELECT e.* FROM edges e JOIN nodes n ON n.fn = e.to_fn),
deg AS (SELECT n.fn, coalesce(a.n, 0) AS fan_in, coalesce(b.n, 0) AS fan_out, coalesce(x.n, 0) AS n_external FROM nodes n
  LEFT JOIN (SELECT to_fn, count(*) AS n FROM i GROUP BY 1) a ON a.to_fn = n.fn
  LEFT JOIN (SELECT from_fn, count(*) AS n FROM i GROUP BY 1) b ON b.from_fn = n.fn
  LEFT JOIN (SELECT from_fn, count(*) AS n FROM edges WHERE to_fn NOT IN (SELECT fn FROM nodes) GROUP BY 1) x ON x.from_fn = n.fn)"""


def linked_supply(spark, sf):
    nodes = V.supply_nodes(spark, sf)
    edges = C.call_edges(V.supply_edges(spark, sf), nodes)
    return C.with_links(nodes, edges), edges


@query("c3_fan_in_out_supply", SUPPLY + " SELECT fn, fan_in, fan_out, n_external FROM deg")
def c3_supply(spark, sf):
    return linked_supply(spark, sf)[0].select("fn", "fan_in", "fan_out", "n_external")


@query("c4_hubs", DAYS + """,
z AS (SELECT file, fn, fan_in + fan_out AS score, row_number() OVER (PARTITION BY file ORDER BY fan_in + fan_out DESC, fn) AS rank FROM linked WHERE fan_in + fan_out > 0)
SELECT file, fn, score, rank::INTEGER AS rank FROM z WHERE rank <= 5""")
def c4(spark, sf):
    return C.hubs(linked_days(spark, sf)[0])


@query("c4_hubs_supply", SUPPLY + """
SELECT fn, fan_in + fan_out AS score, row_number() OVER (ORDER BY fan_in + fan_out DESC, fn)::INTEGER AS rank FROM deg
WHERE fan_in + fan_out > 0 ORDER BY score DESC, fn LIMIT 5""")
def c4_supply(spark, sf):
    return C.hubs(linked_supply(spark, sf)[0]).select("fn", "score", "rank")


@query("c5_isolated_nodes", DAYS + " SELECT file, fn FROM linked WHERE fan_in = 0 AND fan_out = 0")
def c5(spark, sf):
    return C.isolated_nodes(linked_days(spark, sf)[0])


@query("c6_roots", DAYS + " SELECT file, fn FROM linked WHERE fan_in = 0 AND fan_out > 0")
def c6(spark, sf):
    return C.roots(linked_days(spark, sf)[0])


FUNCTIONS = "WITH" + V.NODES_SQL + V.FN_EDGES_SQL + V.CLASSIFIED_SQL


def function_graph(spark, sf):
    nodes = V.node_facts(spark, sf)
    return nodes, C.call_edges(V.function_edges(spark, sf), nodes.select("file", "fn"))


@query("c7_graph_summary", FUNCTIONS + V.STRUCTURE_SQL + """,
a AS (SELECT file, count(*) AS n_nodes, round(avg(complexity), 1) AS avg_complexity FROM nodes GROUP BY 1),
b AS (SELECT file, count(*) AS n_edges, count(*) FILTER (WHERE kind = 'internal') AS n_internal,
  count(DISTINCT CASE WHEN kind = 'external' THEN to_fn END) AS n_external_callees FROM ce GROUP BY 1)
SELECT a.file, n_nodes, avg_complexity, coalesce(n_edges, 0) AS n_edges, coalesce(n_internal, 0) AS n_internal,
  coalesce(n_external_callees, 0) AS n_external_callees, n_imports FROM a LEFT JOIN b USING (file) JOIN structure s ON s.file = a.file""")
def c7(spark, sf):
    return C.graph_summary(*function_graph(spark, sf)).join(V.file_structure(spark, sf).select("file", "n_imports"), "file")


PATHS_SQL = """,
paths AS (SELECT file, fn AS at, [fn] AS path FROM linked WHERE fan_in = 0 AND fan_out > 0
  UNION ALL SELECT p.file, ce.to_fn, list_append(p.path, ce.to_fn) FROM paths p JOIN ce ON ce.file = p.file AND ce.from_fn = p.at
  AND ce.kind = 'internal' AND NOT list_contains(p.path, ce.to_fn)),
depth AS (SELECT f.file, coalesce(max(len(path) - 1), 0)::INTEGER AS max_call_depth FROM (SELECT DISTINCT file FROM nodes) f LEFT JOIN paths USING (file) GROUP BY 1)"""


@query("c8_max_call_depth", DAYS.replace("WITH", "WITH RECURSIVE", 1) + PATHS_SQL + " SELECT file, max_call_depth FROM depth")
def c8(spark, sf):
    return C.max_call_depth(*linked_days(spark, sf))


@query("c8_max_call_depth_functions", FUNCTIONS.replace("WITH", "WITH RECURSIVE", 1) + PATHS_SQL + " SELECT file, max_call_depth FROM depth")
def c8_functions(spark, sf):
    nodes, edges = function_graph(spark, sf)
    return C.max_call_depth(C.with_links(nodes.select("file", "fn"), edges), edges)


@query("c9_instability", DAYS + """
SELECT file, fn, CASE WHEN fan_in + fan_out > 0 THEN round(fan_out / (fan_in + fan_out), 2) ELSE 0 END AS instability FROM linked""")
def c9(spark, sf):
    return C.instability(linked_days(spark, sf)[0])


@query("c9_instability_supply", SUPPLY + """
SELECT fn, CASE WHEN fan_in + fan_out > 0 THEN round(fan_out / (fan_in + fan_out), 2) ELSE 0 END AS instability FROM deg""")
def c9_supply(spark, sf):
    return C.instability(linked_supply(spark, sf)[0]).select("fn", "instability")


@query("c10_self_loops", DAYS + " SELECT file, from_fn AS fn FROM ce WHERE from_fn = to_fn")
def c10(spark, sf):
    return C.self_loops(day_graph(spark, sf)[1])


CHAINS_SQL = """,
nx AS (SELECT file, from_fn AS at, min(to_fn) AS next_fn FROM ce WHERE kind = 'internal' GROUP BY 1, 2),
ch AS (SELECT file, from_fn, to_fn, [from_fn, to_fn] AS chain FROM ce WHERE kind = 'internal' AND from_fn <> to_fn
  UNION ALL SELECT c.file, c.from_fn, c.to_fn, list_append(c.chain, n.next_fn) FROM ch c JOIN nx n ON n.file = c.file AND n.at = c.chain[-1] AND NOT list_contains(c.chain, n.next_fn)),
longest AS (SELECT file, from_fn, to_fn, max_by(chain, len(chain)) AS chain FROM ch GROUP BY 1, 2, 3),
chains AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY from_fn, to_fn) AS rank FROM longest WHERE len(chain) >= 3)"""


@query("c11_transform_chains", DAYS.replace("WITH", "WITH RECURSIVE", 1) + CHAINS_SQL + """
SELECT file, array_to_string(chain, ' > ') AS chain, rank::INTEGER AS rank FROM chains WHERE rank <= 8""")
def c11(spark, sf):
    chains = C.transform_chains(day_graph(spark, sf)[1])
    return chains.select("file", C.chain_text(F.col("chain")).alias("chain"), "rank")


FLOWS = V.ACCESS_SQL + """,
pairs AS (SELECT w.file, w.fn AS from_fn, w.variable, r.fn AS to_fn FROM acc w JOIN acc r ON w.file = r.file AND w.variable = r.variable
  AND w.is_write AND NOT r.is_write AND w.fn <> r.fn)"""


@query("c12_variable_flows", FLOWS + " SELECT file, from_fn, variable, count(*) AS n_to FROM pairs GROUP BY 1, 2, 3")
def c12(spark, sf):
    return C.variable_flows(V.variable_accesses(spark, sf))


@query("c12_flow_consumers", FLOWS + " SELECT file, variable, to_fn, count(*) AS n_from FROM pairs GROUP BY 1, 2, 3")
def c12_consumers(spark, sf):
    return C.flow_consumers(V.variable_accesses(spark, sf))


CLOSURE_SQL = """,
reach AS (SELECT file, fn AS start_fn, fn AS member FROM (SELECT DISTINCT file, fn FROM nodes)
  UNION SELECT r.file, r.start_fn, ce.to_fn FROM reach r JOIN ce ON ce.file = r.file AND ce.from_fn = r.member AND ce.kind = 'internal'),
opening AS (SELECT DISTINCT r.file, r.start_fn FROM reach r WHERE r.member <> r.start_fn
  AND NOT EXISTS (SELECT 1 FROM reach q WHERE q.file = r.file AND q.member = r.start_fn AND q.start_fn < r.start_fn)),
cl AS (SELECT r.file, r.start_fn, r.member FROM reach r JOIN opening USING (file, start_fn))"""


@query("c13_clusters", DAYS.replace("WITH", "WITH RECURSIVE", 1) + CLOSURE_SQL + " SELECT file, start_fn, member FROM cl")
def c13(spark, sf):
    return C.clusters(*day_graph(spark, sf))


@query("q8_flow_isolated", FLOWS + """,
n AS (SELECT DISTINCT file, fn FROM acc WHERE ('0x' || substr(md5(fn || '|calls'), 1, 8))::BIGINT % 10 = 0)
SELECT file, fn FROM n WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.file = n.file AND p.to_fn = n.fn)""")
def q8(spark, sf):
    accesses = V.variable_accesses(spark, sf)
    nodes = accesses.select("file", "fn").distinct().withColumn("n_calls", hashed_choice(F.col("fn"), "calls", 10))
    return C.flow_isolated(nodes, accesses)


@query("x10_data_deps", V.ACCESS_SQL + """
SELECT file, fn, count(DISTINCT variable) FILTER (WHERE NOT is_write) AS n_reads, count(DISTINCT variable) FILTER (WHERE is_write) AS n_writes FROM acc GROUP BY 1, 2""")
def x10(spark, sf):
    own = C.access_summary(V.variable_accesses(spark, sf))
    return own.groupBy("file", "fn").agg(F.sum("reads").alias("n_reads"), F.sum("writes").alias("n_writes"))


@query("r4_chain_links", DAYS + """,
k AS (SELECT file, fn, count(*) OVER (PARTITION BY file) AS n_links FROM linked WHERE fan_out = 1 AND fan_in <= 1)
SELECT file, fn, n_links FROM k WHERE n_links >= 2""")
def r4(spark, sf):
    return C.chain_links(linked_days(spark, sf)[0])
