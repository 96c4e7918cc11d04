"""Call-graph operators over edge rows (file, from_fn, to_fn).

Keys are (file, fn), so the work of one large file spreads over its nodes. Recursive operators are
rounds of equi-joins over a shrinking frontier, each cut by a reliable checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.numbers import count_where, flag
from quillgraph.session import cut_lineage

# Lengths of the ranked lists.
N_HUBS = 5
# Fixed value: consumers listed for a flow.
N_CONSUMERS = 8
N_CHAINS = 8
MIN_CHAIN = 3


def call_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``kind``: internal when the callee is a node of the same file."""
    known = nodes.select("file", F.col("fn").alias("to_fn")).distinct().withColumn("_known", F.lit(True))
    return edges.join(known, ["file", "to_fn"], "left").select(
        "file", "from_fn", "to_fn",
        F.when(F.col("_known"), F.lit("internal")).otherwise(F.lit("external")).alias("kind"))


def adjacency(nodes: DataFrame, classified: DataFrame) -> DataFrame:
    """Rows (file, fn, callee); a node without internal callee stays with a null.

    The list per node stays rows: a node may call a large part of the graph.
    """
    internal = classified.filter("kind = 'internal'").select("file", F.col("from_fn").alias("fn"), F.col("to_fn").alias("callee"))
    return nodes.select("file", "fn").distinct().join(internal, ["file", "fn"], "left")


def link_counts(classified: DataFrame) -> DataFrame:
    """fan_in, fan_out, external calls and self calls per touched (file, fn) in one shuffle."""
    internal = flag(F.col("kind") == "internal")
    both = F.array(
        F.struct(F.col("from_fn").alias("fn"), internal.alias("o"), F.lit(0).alias("i"),
                 (F.lit(1) - internal).alias("x"), flag(F.col("from_fn") == F.col("to_fn")).alias("s")),
        F.struct(F.col("to_fn").alias("fn"), F.lit(0).alias("o"), internal.alias("i"), F.lit(0).alias("x"), F.lit(0).alias("s")),
    )
    return classified.select("file", F.inline(both)).groupBy("file", "fn").agg(
        F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.sum("x").alias("n_external"), F.sum("s").alias("n_self"))


def with_links(nodes: DataFrame, classified: DataFrame) -> DataFrame:
    """Node rows with their link counts; zero where nothing touches the node."""
    counts = ["fan_in", "fan_out", "n_external", "n_self"]
    return nodes.join(link_counts(classified), ["file", "fn"], "left").fillna(0, counts)


def hubs(linked: DataFrame, n: int = N_HUBS) -> DataFrame:
    """Best-connected nodes per file. The rank filter also runs before the shuffle."""
    scored = linked.select("file", "fn", (F.col("fan_in") + F.col("fan_out")).alias("score")).filter("score > 0").distinct()
    order = W.partitionBy("file").orderBy(F.desc("score"), "fn")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def isolated_nodes(linked: DataFrame) -> DataFrame:
    return linked.filter("fan_in = 0 AND fan_out = 0").select("file", "fn")


def roots(linked: DataFrame) -> DataFrame:
    return linked.filter("fan_in = 0 AND fan_out > 0").select("file", "fn").distinct()


def instability(linked: DataFrame) -> DataFrame:
    total = F.col("fan_in") + F.col("fan_out")
    place = [c for c in ("seq",) if c in linked.columns]
    return linked.select("file", "fn", *place, F.when(total > 0, F.round(F.col("fan_out") / total, 2)).otherwise(0.0).alias("instability"))


def self_loops(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("from_fn") == F.col("to_fn")).select("file", F.col("from_fn").alias("fn"))


def chain_links(linked: DataFrame, at_least: int = 2) -> DataFrame:
    """Nodes with one way out and at most one way in, for files with enough of them."""
    links = linked.filter("fan_out = 1 AND fan_in <= 1").select("file", "fn")
    enough = links.groupBy("file").agg(F.count(F.lit(1)).alias("n_links")).filter(F.col("n_links") >= at_least)
    return links.join(enough, "file")


def graph_summary(nodes: DataFrame, classified: DataFrame) -> DataFrame:
    """Node and edge counts per file, average complexity with one digit."""
    of_nodes = nodes.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.round(F.avg("complexity"), 1).alias("avg_complexity"))
    of_edges = classified.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_edges"),
        count_where(F.col("kind") == "internal").alias("n_internal"),
        F.count_distinct(F.when(F.col("kind") == "external", F.col("to_fn"))).alias("n_external_callees"))
    return of_nodes.join(of_edges, "file", "left").fillna(0, ["n_edges", "n_internal", "n_external_callees"])


def _arcs(classified: DataFrame) -> DataFrame:
    return classified.filter("kind = 'internal' AND from_fn <> to_fn").select("file", "from_fn", "to_fn").distinct()


def _merged(rows: DataFrame) -> DataFrame:
    """The side of a join that rounds repeat. Tables are broadcast by their compressed size and each round would send them through the
    driver again, as often as the graph is deep; a merge join leaves them with the executors."""
    return rows.hint("merge")


def cycle_core(arcs: DataFrame) -> DataFrame:
    """Arcs left after peeling, round by round, those that start at a source or end in a sink.

    What remains lies on cycles or between them; an acyclic graph leaves nothing.
    """
    core = cut_lineage(arcs)
    size = core.count()
    while size:
        entered = core.select("file", F.col("to_fn").alias("from_fn")).distinct()
        left = core.select("file", F.col("from_fn").alias("to_fn")).distinct()
        core = cut_lineage(core.join(_merged(entered), ["file", "from_fn"], "left_semi").join(_merged(left), ["file", "to_fn"], "left_semi"))
        shrunk = core.count()
        if shrunk == size:
            break
        size = shrunk
    return core.select("file", "from_fn", "to_fn")


def max_call_depth(linked: DataFrame, classified: DataFrame) -> DataFrame:
    """Longest simple path, in edges, from any root of a file; 0 for a file without roots.

    A walk only has to remember visited nodes that lie on a cycle, so states are (node, visited
    part of the cycle core) without duplicates: polynomial wherever the graph has no cycles.
    """
    arcs = _arcs(classified)
    on_cycle = cycle_core(arcs).select("file", F.col("from_fn").alias("to_fn")).distinct().withColumn("_c", F.lit(True))
    steps = cut_lineage(arcs.join(_merged(on_cycle), ["file", "to_fn"], "left").select(
        "file", "from_fn", "to_fn", F.coalesce("_c", F.lit(False)).alias("on_cycle")))
    fn_type = classified.schema["to_fn"].dataType
    state = roots(linked).select("file", F.col("fn").alias("at"), F.array().cast(f"array<{fn_type.simpleString()}>").alias("seen"))
    reached, depth = [], 0
    while True:
        depth += 1
        onward = state.join(_merged(steps), (steps.file == state.file) & (steps.from_fn == state.at)).select(
            state.file, "to_fn", "on_cycle", "seen").filter(~F.array_contains("seen", F.col("to_fn")))
        seen = F.when(F.col("on_cycle"), F.array_sort(F.array_append("seen", F.col("to_fn")))).otherwise(F.col("seen"))
        state = cut_lineage(onward.select("file", F.col("to_fn").alias("at"), seen.alias("seen")).distinct())
        if state.isEmpty():
            break
        reached.append(state.select("file", F.lit(depth).alias("depth")).distinct())
    files = linked.select("file").distinct()
    if not reached:
        return files.withColumn("max_call_depth", F.lit(0))
    deepest = reduce(lambda a, b: a.unionByName(b), reached).groupBy("file").agg(F.max("depth").alias("max_call_depth"))
    return files.join(deepest, "file", "left").fillna(0, ["max_call_depth"])


def transform_chains(classified: DataFrame, n: int | None = N_CHAINS, at_least: int = MIN_CHAIN) -> DataFrame:
    """Chains (file, from_fn, to_fn, chain): each edge followed along first callees until the end
    or a repeat. The first callee is the smallest name. ``n`` keeps the first chains of each file."""
    internal = classified.filter("kind = 'internal'").select("file", "from_fn", "to_fn").distinct()
    follow = cut_lineage(internal.groupBy("file", F.col("from_fn").alias("at")).agg(F.min("to_fn").alias("next_fn")))
    active = internal.filter("from_fn <> to_fn").select(
        "file", "from_fn", "to_fn", F.array("from_fn", "to_fn").alias("chain"), F.col("to_fn").alias("at"))
    done = []
    while True:
        stepped = active.join(_merged(follow), ["file", "at"], "left")
        ended = F.col("next_fn").isNull() | F.array_contains("chain", F.col("next_fn"))
        stepped = cut_lineage(stepped.withColumn("_end", F.coalesce(ended, F.lit(True))))
        done.append(stepped.filter("_end").select("file", "from_fn", "to_fn", "chain"))
        active = stepped.filter("NOT _end").select(
            "file", "from_fn", "to_fn", F.array_append("chain", F.col("next_fn")).alias("chain"), F.col("next_fn").alias("at"))
        if active.isEmpty():
            break
    chains = reduce(lambda a, b: a.unionByName(b), done).filter(F.size("chain") >= at_least)
    if n is None:
        return chains
    order = W.partitionBy("file").orderBy("from_fn", "to_fn")
    return chains.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def reachable(starts: DataFrame, arcs: DataFrame) -> DataFrame:
    """Rows (file, start_fn, member) for everything a start reaches, itself included."""
    frontier = cut_lineage(starts.select("file", F.col("fn").alias("start_fn"), F.col("fn").alias("member")).distinct())
    found = [frontier]
    while True:
        onward = frontier.join(_merged(arcs), (frontier.file == arcs.file) & (frontier.member == arcs.from_fn)).select(
            frontier.file, "start_fn", F.col("to_fn").alias("member")).distinct()
        known = reduce(lambda a, b: a.unionByName(b), found)
        frontier = cut_lineage(onward.join(_merged(known), ["file", "start_fn", "member"], "left_anti"))
        if frontier.isEmpty():
            return known
        found.append(frontier)


def cluster_starts(nodes: DataFrame, arcs: DataFrame, order: str = "fn") -> DataFrame:
    """Nodes that open a cluster: they call something, and nothing earlier in the order reaches them.

    Taking nodes in order and skipping those already covered gives the same set: whatever covers a
    node is itself covered by, or is, an opening node that comes earlier still. So the smallest
    order value that reaches a node decides, and it spreads over the arcs in rounds.
    """
    own = nodes.select("file", "fn", F.col(order).alias("least")).groupBy("file", "fn").agg(F.min("least").alias("least"))
    labels = cut_lineage(own)
    moved = labels
    while True:
        offers = moved.join(_merged(arcs), (moved.file == arcs.file) & (moved.fn == arcs.from_fn)).select(
            moved.file, F.col("to_fn").alias("fn"), "least").groupBy("file", "fn").agg(F.min("least").alias("offer"))
        moved = cut_lineage(labels.join(_merged(offers), ["file", "fn"]).filter("offer < least").select(
            "file", "fn", F.col("offer").alias("least")))
        if moved.isEmpty():
            break
        labels = cut_lineage(labels.join(_merged(moved.withColumnRenamed("least", "_better")), ["file", "fn"], "left").select(
            "file", "fn", F.coalesce("_better", "least").alias("least")))
    callers = arcs.select("file", F.col("from_fn").alias("fn")).distinct()
    opening = labels.join(_merged(own.withColumnRenamed("least", "_own")), ["file", "fn"]).filter("least = _own").select("file", "fn")
    return opening.join(_merged(callers), ["file", "fn"], "left_semi")


def clusters(nodes: DataFrame, classified: DataFrame, order: str = "fn") -> DataFrame:
    """Members (file, start_fn, member) of every cluster of two or more nodes; clusters may overlap."""
    arcs = cut_lineage(_arcs(classified))
    return reachable(cluster_starts(nodes, arcs, order), arcs)


def role_groups(linked: DataFrame, classified: DataFrame) -> DataFrame:
    """Nodes outside every cluster with their group: two or more of one role, or alone.

    A node is in some cluster exactly when a call to or from another node touches it.
    """
    arcs = _arcs(classified)
    touched = arcs.select("file", F.explode(F.array("from_fn", "to_fn")).alias("fn")).distinct()
    free = linked.join(touched, ["file", "fn"], "left_anti").select("file", "fn", "role")
    sizes = free.groupBy("file", "role").agg(F.count(F.lit(1)).alias("group_size"))
    kind = F.when(F.col("group_size") >= 2, F.lit("role-group")).otherwise(F.lit("singleton"))
    return free.join(sizes, ["file", "role"]).withColumn("group_type", kind)


def access_summary(accesses: DataFrame) -> DataFrame:
    """One row per (file, fn, variable) with reads and writes flags, and who else uses the variable."""
    own = accesses.groupBy("file", "fn", "variable").agg(
        F.max(flag(F.col("is_write"))).alias("writes"), F.max(flag(~F.col("is_write"))).alias("reads"))
    totals = own.groupBy("file", "variable").agg(F.sum("writes").alias("n_writers"), F.sum("reads").alias("n_readers"))
    return own.join(totals, ["file", "variable"])


def variable_flows(accesses: DataFrame) -> DataFrame:
    """Flow heads (file, from_fn, variable, n_to): writers whose variable another function reads.

    Writers and readers of a variable are never paired: the number of other readers is the group's
    count less the writer's own read. ``flow_consumers`` holds the other end.
    """
    others = F.col("n_readers") - F.col("reads")
    return access_summary(accesses).filter((F.col("writes") == 1) & (others > 0)).select(
        "file", F.col("fn").alias("from_fn"), "variable", others.alias("n_to"))


def flow_consumers(accesses: DataFrame) -> DataFrame:
    """Readers (file, variable, to_fn, n_from) of a variable that some other function writes."""
    others = F.col("n_writers") - F.col("writes")
    return access_summary(accesses).filter((F.col("reads") == 1) & (others > 0)).select(
        "file", "variable", F.col("fn").alias("to_fn"), others.alias("n_from"))


def flow_lists(accesses: DataFrame, most: int = N_CONSUMERS) -> DataFrame:
    """Flows (file, from_fn, variable, n_to, to): each writer with the number of other readers and the first ones by name.

    The first readers of a variable are ranked once, one more than are listed, so that a writer can leave itself out;
    writers and readers are not paired.
    """
    own = access_summary(accesses)
    first = W.partitionBy("file", "variable").orderBy("fn")
    ranked = own.filter("reads = 1").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most + 1)
    readers = ranked.groupBy("file", "variable").agg(F.array_sort(F.collect_list("fn")).alias("_readers"))
    heads = own.withColumn("n_to", F.col("n_readers") - F.col("reads")).filter((F.col("writes") == 1) & (F.col("n_to") > 0))
    return heads.join(readers, ["file", "variable"]).select(
        "file", F.col("fn").alias("from_fn"), "variable", "n_to",
        F.slice(F.filter("_readers", lambda r: r != F.col("fn")), 1, most).alias("to"))


def flow_isolated(nodes: DataFrame, accesses: DataFrame) -> DataFrame:
    """Nodes without calls that consume no variable flow."""
    consumers = flow_consumers(accesses).select("file", F.col("to_fn").alias("fn"))
    return nodes.filter("n_calls = 0").select("file", "fn").distinct().join(consumers, ["file", "fn"], "left_anti")


def chain_text(chain: Column) -> Column:
    return F.array_join(chain.cast("array<string>"), " > ")
