"""How the driver tables stand in for source facts, and the same views for the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.text import hashed_choice
from quillgraph.session import table

# Documents stand for functions; a file is what one source published within a run of 200 ids, so
# no file holds more than 200 functions however large a source is.
FILE_SPAN = 200
EFFECTS = ("async", "dom", "io", "mutation", "network", "throws")
TRANSFORMS = ("arithmetic", "array_ops", "comparison", "conditional", "iteration", "object_ops", "string_ops")
KINDS = ("declaration", "arrow", "expression", "method")


def _count_of(text, mark: str):
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def function_keys(spark, sf, *measures) -> DataFrame:
    """Functions with their place in their file. Measures of the text are taken in the scan, so no exchange carries a text."""
    repo = F.col("source")
    file = F.concat(repo, F.lit("/"), F.expr(f"doc_id div {FILE_SPAN}").cast("string"))
    docs = table(spark, sf, "documents").select("doc_id", repo.alias("repo"), file.alias("file"), *measures)
    seq = F.row_number().over(W.partitionBy("file").orderBy("doc_id"))
    return docs.withColumn("seq", seq).withColumn("fn", F.concat(F.lit("f"), F.lpad(F.col("seq").cast("string"), 3, "0")))


def node_facts(spark, sf) -> DataFrame:
    d, t = F.col("doc_id"), F.col("text")
    u = lambda name, m: hashed_choice(d, name, m)
    present = lambda names, tag, m: F.array_compact(F.array(*[F.when(u(f"{tag}_{n}", m) == 0, F.lit(n)) for n in names]))
    measured = function_keys(
        spark, sf, F.size(F.split(t, "\n")).cast("long").alias("lines"),
        (F.lit(1) + F.least(F.lit(13), F.floor(_count_of(t, ".") / 6))).cast("long").alias("complexity"),
        F.least(F.lit(6), F.floor(_count_of(t, ",") / 8)).cast("long").alias("nesting"))
    return measured.select(
        "repo", "file", "fn", "seq",
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), (u("kind", 4) + 1).cast("int")).alias("kind"),
        "lines", "complexity", "nesting",
        u("par", 8).alias("n_params"), u("calls", 10).alias("n_calls"), u("wr", 6).alias("n_writes"), u("rd", 8).alias("n_reads"),
        u("wo", 2).alias("n_outer_writes"), (u("as", 5) == 0).alias("is_async"), (u("gen", 20) == 0).alias("is_generator"),
        (u("next", 25) == 0).alias("calls_next"), (u("ev", 25) == 0).alias("has_event_param"),
        (u("inst", 15) == 0).alias("writes_instance"), (u("obs", 12) == 0).alias("calls_observer"),
        (u("strat", 6) == 0).alias("has_strategy_param"), (u("cache", 8) == 0).alias("reads_cache"),
        (u("catch", 3) == 0).alias("calls_catch"),
        present(EFFECTS, "e", 6).alias("effects"), present(TRANSFORMS, "t", 3).alias("transforms"))


def function_edges(spark, sf) -> DataFrame:
    """Calls between the functions of a file; a target past the last function is external."""
    d, seq = F.col("doc_id"), F.col("seq")
    u = lambda name, m: hashed_choice(d, name, m)
    targets = F.array_compact(F.array(
        F.when(u("has1", 3) > 0, seq + 1 + u("hop1", 3)),
        F.when(u("has2", 3) == 0, seq + 2 + u("hop2", 4)),
        F.when(u("self", 40) == 0, seq.cast("long"))))
    named = lambda n: F.concat(F.lit("f"), F.lpad(n.cast("string"), 3, "0"))
    return function_keys(spark, sf).select(
        "file", F.col("fn").alias("from_fn"), F.explode(F.array_distinct(targets)).alias("_t")).select(
        "file", "from_fn", named(F.col("_t")).alias("to_fn"))


def file_structure(spark, sf) -> DataFrame:
    """Class, import and export counts per file, drawn by hash from the file name."""
    u = lambda name, m: hashed_choice(F.col("file"), name, m)
    files = function_keys(spark, sf).select("repo", "file").distinct()
    return files.select(
        "repo", "file", F.greatest(u("cls", 4) - 1, F.lit(0)).cast("long").alias("n_classes"),
        F.when(u("cls", 4) > 1, u("inh", 2)).otherwise(F.lit(0)).cast("long").alias("n_inheriting"),
        u("imp", 6).alias("n_imports"), u("exp", 4).alias("n_exports"))


U = "(('0x' || substr(md5(doc_id || '|{0}'), 1, 8))::BIGINT % {1})"
UF = "(('0x' || substr(md5(file || '|{0}'), 1, 8))::BIGINT % {1})"


def u_sql(name: str, m: int) -> str:
    return U.format(name, m)


def _present_sql(names, tag, m) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {u_sql(f'{tag}_{n}', m)} = 0 THEN '{n}' END" for n in names) + "], lambda x: x IS NOT NULL)"


KEYS_SQL = f"""
fk AS (SELECT *, 'f' || lpad(seq::VARCHAR, 3, '0') AS fn FROM (SELECT doc_id, text, source AS repo, source || '/' || (doc_id // {FILE_SPAN}) AS file,
  row_number() OVER (PARTITION BY source, doc_id // {FILE_SPAN} ORDER BY doc_id) AS seq FROM documents))"""
NODES_SQL = KEYS_SQL + f""",
nodes AS (SELECT repo, file, fn, seq, ['declaration', 'arrow', 'expression', 'method'][{u_sql('kind', 4)} + 1] AS kind,
  len(string_split(text, chr(10))) AS lines, 1 + least(13, (length(text) - length(replace(text, '.', ''))) // 6) AS complexity,
  least(6, (length(text) - length(replace(text, ',', ''))) // 8) AS nesting,
  {u_sql('par', 8)} AS n_params, {u_sql('calls', 10)} AS n_calls, {u_sql('wr', 6)} AS n_writes, {u_sql('rd', 8)} AS n_reads,
  {u_sql('wo', 2)} AS n_outer_writes, {u_sql('as', 5)} = 0 AS is_async, {u_sql('gen', 20)} = 0 AS is_generator,
  {u_sql('next', 25)} = 0 AS calls_next, {u_sql('ev', 25)} = 0 AS has_event_param, {u_sql('inst', 15)} = 0 AS writes_instance,
  {u_sql('obs', 12)} = 0 AS calls_observer, {u_sql('strat', 6)} = 0 AS has_strategy_param, {u_sql('cache', 8)} = 0 AS reads_cache,
  {u_sql('catch', 3)} = 0 AS calls_catch, {_present_sql(EFFECTS, 'e', 6)} AS effects, {_present_sql(TRANSFORMS, 't', 3)} AS transforms FROM fk)"""
FN_EDGES_SQL = f""",
ft AS (SELECT file, fn AS from_fn, seq + 1 + {u_sql('hop1', 3)} AS t FROM fk WHERE {u_sql('has1', 3)} > 0
  UNION SELECT file, fn, seq + 2 + {u_sql('hop2', 4)} FROM fk WHERE {u_sql('has2', 3)} = 0
  UNION SELECT file, fn, seq FROM fk WHERE {u_sql('self', 40)} = 0),
edges AS (SELECT file, from_fn, 'f' || lpad(t::VARCHAR, 3, '0') AS to_fn FROM ft)"""
STRUCTURE_SQL = f""",
structure AS (SELECT repo, file, greatest({UF.format('cls', 4)} - 1, 0)::BIGINT AS n_classes,
  CASE WHEN {UF.format('cls', 4)} > 1 THEN {UF.format('inh', 2)} ELSE 0 END AS n_inheriting, {UF.format('imp', 6)} AS n_imports, {UF.format('exp', 4)} AS n_exports
  FROM (SELECT DISTINCT repo, file FROM fk))"""
CLASSIFIED_SQL = """,
ce AS (SELECT e.file, e.from_fn, e.to_fn, CASE WHEN k.fn IS NULL THEN 'external' ELSE 'internal' END AS kind
  FROM edges e LEFT JOIN (SELECT DISTINCT file, fn FROM nodes) k ON k.file = e.file AND k.fn = e.to_fn),
linked AS (SELECT n.*, (SELECT count(*) FROM ce WHERE ce.file = n.file AND ce.to_fn = n.fn AND kind = 'internal') AS fan_in,
  (SELECT count(*) FROM ce WHERE ce.file = n.file AND ce.from_fn = n.fn AND kind = 'internal') AS fan_out,
  (SELECT count(*) FROM ce WHERE ce.file = n.file AND ce.from_fn = n.fn AND kind = 'external') AS n_external FROM nodes n)"""


# Events stand for calls: a user's day is a file, an event type a node, the next event the callee.
def day_events(spark, sf) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), ts.cast("date").cast("string")).alias("file"),
        F.hour(ts).alias("_hour"), F.struct(ts.alias("ts"), "event_id").alias("_at"), "event_type")


def day_nodes(spark, sf) -> DataFrame:
    return day_events(spark, sf).filter("event_type <> 'error'").select("file", F.col("event_type").alias("fn")).distinct()


def day_edges(spark, sf) -> DataFrame:
    """Distinct successions of event types.

    Within an hour the next event comes from a window on (file, hour); across hours only the first
    and last event of each hour matter, at most 24 rows per file. No task sees a whole busy user.
    """
    events = day_events(spark, sf)
    inside = events.withColumn(
        "to_fn", F.lead("event_type").over(W.partitionBy("file", "_hour").orderBy("_at"))
    ).filter("to_fn IS NOT NULL").select("file", F.col("event_type").alias("from_fn"), "to_fn")
    ends = events.groupBy("file", "_hour").agg(
        F.min_by("event_type", "_at").alias("first"), F.max_by("event_type", "_at").alias("from_fn"))
    across = ends.withColumn("to_fn", F.lead("first").over(W.partitionBy("file").orderBy("_hour"))).filter(
        "to_fn IS NOT NULL").select("file", "from_fn", "to_fn")
    return inside.unionByName(across).filter("from_fn <> 'error'").distinct()


DAYS_SQL = """WITH d AS (SELECT user_id || '/' || ts::DATE AS file, ts, event_id, event_type FROM events),
nodes AS (SELECT DISTINCT file, event_type AS fn FROM d WHERE event_type <> 'error'),
s AS (SELECT file, event_type AS from_fn, lead(event_type) OVER (PARTITION BY file ORDER BY ts, event_id) AS to_fn FROM d),
edges AS (SELECT DISTINCT file, from_fn, to_fn FROM s WHERE to_fn IS NOT NULL AND from_fn <> 'error')"""


# Line items as one large graph from suppliers to parts.
def supply_edges(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.lit("lineitem").alias("file"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("from_fn"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to_fn")).distinct()


def supply_nodes(spark, sf) -> DataFrame:
    """Every supplier, and the parts that cost less than 1 000; dearer parts are external callees."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("fn"))
    p = table(spark, sf, "part").filter("p_retailprice < 1000").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("fn"))
    return s.unionByName(p).select(F.lit("lineitem").alias("file"), "fn")


SUPPLY_SQL = """WITH edges AS (SELECT DISTINCT 'lineitem' AS file, 's' || l_suppkey AS from_fn, 'p' || l_partkey AS to_fn FROM lineitem),
nodes AS (SELECT 'lineitem' AS file, 's' || s_suppkey AS fn FROM supplier UNION ALL SELECT 'lineitem', 'p' || p_partkey FROM part WHERE p_retailprice < 1000)"""


# Line items as variable accesses: an order's function in a supplier's file reads or writes a part.
def variable_accesses(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("fn"), F.col("l_partkey").alias("variable"),
        (F.col("l_returnflag") == "R").alias("is_write"))


ACCESS_SQL = """WITH acc AS (SELECT DISTINCT l_suppkey AS file, l_orderkey AS fn, l_partkey AS variable, l_returnflag = 'R' AS is_write FROM lineitem)"""
