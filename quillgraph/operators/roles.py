"""Rule tables over function facts: roles, file patterns, style and explanations.

A function row carries counts, flags and two small tag arrays; every rule is one boolean
expression over it, so classification is a projection behind the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.numbers import count_where
from quillgraph.functions.rows import settle

# Winner among matching roles, first listed wins.
ROLE_PRIORITY = (
    "middleware", "generator-fn", "event-handler", "validator", "io-handler", "async-handler", "router", "orchestrator",
    "aggregator", "iterator", "initializer", "factory", "transformer", "predicate", "closure", "pure-function", "utility",
)
OUTSIDE_EFFECTS = ("io", "network", "dom")
# Names that mark a singleton, a cache, a strategy, an observer, an event parameter.
INSTANCE_WORD = "instance"
CACHE_WORDS = ("cache", "memo", "map")
STRATEGY_WORDS = ("strategy", "handler", "fn")
OBSERVER_CALLS = (".on", ".emit", ".addEventListener")
EVENT_PARAMS = ("e", "evt")


def function_features(functions: DataFrame) -> DataFrame:
    """Counts and flags from array-valued facts (params, calls, reads, writes) for the rules."""
    some = lambda col, test: F.exists(col, test)
    any_of = lambda x, words: F.array_contains(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(x), w)), True)
    ends = lambda x, words: F.array_contains(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.endswith(x, w)), True)
    return functions.select(
        *[c for c in functions.columns if c not in ("n_params", "n_calls", "n_reads", "n_writes")],
        F.size("params").alias("n_params"), F.size("calls").alias("n_calls"),
        F.size("reads").alias("n_reads"), F.size("writes").alias("n_writes"),
        F.size(F.array_except("writes", "params")).alias("n_outer_writes"),
        some("calls", lambda c: F.contains(c, F.lit("next"))).alias("calls_next"),
        some("calls", lambda c: F.contains(c, F.lit("catch"))).alias("calls_catch"),
        some("calls", lambda c: ends(c, OBSERVER_CALLS)).alias("calls_observer"),
        some("params", lambda p: F.contains(F.lower(p), F.lit("event")) | p.isin(*EVENT_PARAMS)).alias("has_event_param"),
        some("params", lambda p: any_of(p, STRATEGY_WORDS)).alias("has_strategy_param"),
        some("writes", lambda w: F.contains(F.lower(w), F.lit(INSTANCE_WORD))).alias("writes_instance"),
        some("reads", lambda r: any_of(r, CACHE_WORDS)).alias("reads_cache"),
    )


def role_rules() -> dict[str, Column]:
    """One boolean per role over the function row. The conditions and their limits."""
    tx = lambda t: F.array_contains("transforms", t)
    fx = lambda e: F.array_contains("effects", e)
    no_effects = F.size("effects") == 0
    has_params = F.col("n_params") > 0
    return {
        "transformer": has_params & tx("arithmetic") & no_effects,
        "predicate": tx("comparison") & (F.col("complexity") >= 2) & no_effects,
        "aggregator": tx("array_ops") & has_params,
        "factory": tx("object_ops") & no_effects & has_params,
        "orchestrator": (F.col("n_calls") >= 3) & (F.col("complexity") <= 3) & (F.size("transforms") <= 1),
        "io-handler": F.arrays_overlap("effects", F.array(*[F.lit(e) for e in OUTSIDE_EFFECTS])),
        "async-handler": F.col("is_async") | fx("async"),
        "validator": fx("throws") & tx("comparison"),
        "iterator": tx("iteration") & ~tx("array_ops"),
        "router": (F.col("complexity") >= 4) & tx("conditional") & (F.col("n_calls") >= 2),
        "initializer": (F.col("n_writes") >= 3) & (F.col("complexity") <= 2) & (F.col("n_calls") <= 2),
        "pure-function": no_effects & has_params & (F.col("n_outer_writes") == 0),
        "closure": F.col("kind").isin("arrow", "expression"),
        "middleware": (F.col("n_params") >= 2) & F.col("calls_next"),
        "event-handler": F.col("has_event_param"),
        "generator-fn": F.col("is_generator"),
    }


def assign_roles(functions: DataFrame) -> DataFrame:
    """Adds ``role``: the first matching rule in priority order, else utility."""
    rules = role_rules()
    ladder = [F.when(rules[name], F.lit(name)) for name in ROLE_PRIORITY if name in rules]
    return settle(functions.withColumn("role", F.coalesce(*ladder, F.lit("utility"))), "role")


def decorating_files(with_roles: DataFrame, classified: DataFrame) -> DataFrame:
    """Files where a factory with parameters calls something that an inline function also calls.

    Callers of one callee are counted by kind, never paired.
    """
    callers = with_roles.select(
        "file", F.col("fn").alias("from_fn"),
        ((F.col("role") == "factory") & (F.col("n_params") >= 1)).alias("_outer"),
        F.col("kind").isin("arrow", "expression").alias("_inner")).filter("_outer OR _inner")
    shared = classified.join(callers, ["file", "from_fn"]).groupBy("file", "to_fn").agg(
        count_where(F.col("_outer")).alias("o"), count_where(F.col("_inner")).alias("i"),
        count_where(F.col("_outer") & F.col("_inner")).alias("b"))
    return shared.filter("o * i > b").select("file").distinct()


def file_patterns(with_roles: DataFrame, classified: DataFrame) -> DataFrame:
    """Rows (file, pattern) for every file-level pattern. ``with_roles`` also carries link counts."""
    no_effects = F.size("effects") == 0
    is_factory = F.col("role") == "factory"
    facts = with_roles.groupBy("file").agg(
        F.bool_or(F.col("writes_instance") & (F.col("complexity") >= 2)).alias("singleton"),
        F.bool_or("calls_observer").alias("observer"),
        count_where(is_factory).alias("n_factories"),
        count_where(F.col("role") == "middleware").alias("n_middleware"),
        count_where((F.col("fan_out") == 1) & (F.col("fan_in") <= 1)).alias("n_links"),
        F.bool_or((F.col("role") == "orchestrator") & F.col("has_strategy_param")).alias("strategy"),
        F.bool_or(F.col("reads_cache") & no_effects).alias("memo"),
        count_where(no_effects & (F.col("n_calls") >= 2) & is_factory).alias("n_builders"),
        F.bool_or(F.col("n_self") > 0).alias("recursive"),
    ).join(decorating_files(with_roles, classified).withColumn("decorator", F.lit(True)), "file", "left")
    named = lambda condition, name: F.when(condition, F.lit(name))
    found = F.array_compact(F.array(
        named(F.col("singleton"), "Singleton"), named(F.col("observer"), "Observer/EventEmitter"),
        named(F.col("n_factories") >= 2, "Factory"), named(F.col("n_middleware") >= 2, "Middleware Chain"),
        named(F.col("n_links") >= 2, "Pipeline"), named(F.col("strategy"), "Strategy"), named(F.col("decorator"), "Decorator/HOF"),
        named(F.col("memo"), "Memoization"), named(F.col("n_builders") >= 3, "Builder"),
        named(F.col("recursive"), "Recursive Descent")))
    return facts.select("file", F.posexplode(found).alias("place", "pattern"))


def value_counts(rows: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """The n most frequent values per group, ties by value; pre-aggregated before any shuffle."""
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(by).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def dominant_roles(with_roles: DataFrame, by: str = "file", n: int = 3) -> DataFrame:
    return value_counts(with_roles.select(by, "role"), by, "role", n)


def dominant_effect(functions: DataFrame, by: str = "file") -> DataFrame:
    return value_counts(functions.select(by, F.explode("effects").alias("effect")), by, "effect", 1).drop("rank")


def complexity_class(avg_complexity: Column, depth: Column) -> Column:
    return F.when((avg_complexity > 5) | (depth > 4), "high").when(avg_complexity > 3, "medium").otherwise("low")


TRANSFORM_WORDS = {
    "arithmetic": "numeric work", "comparison": "comparisons", "array_ops": "list handling", "string_ops": "text handling",
    "object_ops": "object handling", "conditional": "branching", "iteration": "looping",
}
EFFECT_WORDS = {
    "io": "files or console", "network": "the network", "dom": "the page", "async": "deferred work",
    "mutation": "shared structures", "throws": "raised errors",
}


def _worded(tags: Column, words: dict[str, str], joiner: str, n: int | None = None) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    named = F.transform(tags, lambda t: F.coalesce(F.try_element_at(lookup, t), t))
    return F.array_join(F.slice(named, 1, n) if n else named, joiner)


def explain_function(with_roles: DataFrame) -> DataFrame:
    """Adds ``explanation``: a sentence by role, then up to four qualifiers."""
    n = lambda c: F.col(c).cast("string")
    branches = (F.col("complexity") - 1).cast("string")
    numeric = F.array_contains("transforms", "arithmetic")
    kinds = F.when(F.size("transforms") == 0, "general operations").otherwise(_worded(F.col("transforms"), TRANSFORM_WORDS, ", ", 3))
    outside = F.when(F.size("effects") == 0, "an outside system").otherwise(_worded(F.col("effects"), EFFECT_WORDS, " and "))
    via = F.when(F.col("n_calls") > 0, F.concat(F.lit(" through "), n("n_calls"), F.lit(" calls"))).otherwise("")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    sentences = {
        "transformer": say("turns ", n("n_params"), " inputs into a new value by ", kinds),
        "predicate": say("tests ", branches, " conditions for a yes or no"),
        "aggregator": say("walks a collection and ", F.when(numeric, "computes a figure").otherwise("picks or reorders items")),
        "factory": say("builds a structure from ", n("n_params"), " parameters"),
        "orchestrator": say("coordinates ", n("n_calls"), " calls"),
        "io-handler": say("deals with ", outside),
        "async-handler": say("runs a deferred flow", via),
        "validator": say("checks data against ", branches, " rules"),
        "iterator": say("steps through a structure ", F.when(numeric, "computing on each item").otherwise("handling each item")),
        "router": say("sends the flow down one of ", branches, " paths"),
        "initializer": say("sets up ", n("n_writes"), " variables"),
        "pure-function": say("computes from ", n("n_params"), " parameters without effects"),
        "middleware": say("intercepts a request and hands it on"),
        "event-handler": say("reacts to an event"),
        "generator-fn": say("yields values on demand from ", n("complexity"), " points"),
        "closure": say("captures outer state", via),
        "utility": say("supports with ", kinds),
    }
    base = F.coalesce(*[F.when(F.col("role") == role, text) for role, text in sentences.items()])
    qualifiers = F.concat_ws(
        ", ", F.when(F.col("is_async"), "asynchronous"), F.when(F.col("is_generator"), "as a generator"),
        F.when(F.col("complexity") > 8, say("complex with ", n("complexity"), " paths")),
        F.when(F.col("nesting") > 4, say("nested ", n("nesting"), " deep")))
    return with_roles.withColumn("explanation", F.when(qualifiers == "", base).otherwise(F.concat(base, F.lit("; "), qualifiers)))


def explain_groups(cluster_members: DataFrame, grouped_roles: DataFrame, with_roles: DataFrame) -> DataFrame:
    """One line per cluster, role group and single node: (file, group_type, lead, n, explanation)."""
    roles = with_roles.select("file", F.col("fn").alias("member"), "role")
    per_role = cluster_members.join(roles, ["file", "member"]).groupBy("file", "start_fn", "role").agg(F.count(F.lit(1)).alias("k"))
    # At most one row per role, seventeen in all, is gathered per cluster.
    top = per_role.groupBy("file", "start_fn").agg(
        F.sum("k").alias("n"),
        F.array_join(F.slice(F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "role"))), lambda s: s["role"]), 1, 3), ", ").alias("roles"))
    clusters = top.select(
        "file", F.lit("cluster").alias("group_type"), F.col("start_fn").alias("lead"), "n",
        F.concat(F.lit("subsystem of "), F.col("n").cast("string"), F.lit(" functions, mostly "), "roles").alias("explanation"))
    rest = grouped_roles.groupBy("file", "group_type", "role").agg(F.count(F.lit(1)).alias("n")).select(
        "file", "group_type", F.col("role").alias("lead"), "n",
        F.when(F.col("group_type") == "singleton", F.concat(F.lit("stands alone as "), "role")).otherwise(
            F.concat(F.col("n").cast("string"), F.lit(" variations of "), "role")).alias("explanation"))
    return clusters.unionByName(rest)


def architecture_style(files: DataFrame) -> Column:
    """Signals joined by " + " over a file row (see ``file_profile``)."""
    has = lambda p: F.array_contains("patterns", p)
    share = lambda c: F.col(c) / F.col("n_nodes")
    flow = has("Pipeline") | (F.col("longest_chain") >= 3)
    signals = F.concat_ws(
        " + ",
        F.when(F.col("n_inheriting") > 0, "objects with inheritance").when(F.col("n_classes") > 0, "objects"),
        F.when(has("Pipeline") & has("Middleware Chain"), "staged middleware").when(flow, "staged processing")
        .when(has("Middleware Chain"), "middleware chain"),
        F.when(has("Observer/EventEmitter"), "event-driven"),
        F.when(has("Singleton") & (F.col("n_imports") > 3), "shared state"),
        F.when(share("n_pure") > 0.5, "functional"),
        F.when(share("n_async") > 0.3, "asynchronous"))
    return F.when(signals != "", signals).when(F.col("n_nodes") <= 3, "small utility").otherwise("unstructured procedures")


def narrative(files: DataFrame) -> Column:
    """One line about a whole file from its row."""
    s = lambda c: F.col(c).cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.concat_ws(
        "; ",
        F.when(F.col("n_inheriting") > 0, say("object system of ", s("n_classes"), " classes, ", s("n_inheriting"), " inheriting"))
        .when(F.col("n_classes") > 0, say("class-based, ", s("n_classes"), " classes"))
        .otherwise(say("functional, ", s("n_nodes"), " functions")),
        F.when(F.col("n_exports") > 0, say("exports ", s("n_exports"))),
        F.when(F.col("n_imports") > 0, say("imports ", s("n_imports"))),
        F.when(F.size("top_roles") > 0, say("mostly ", F.array_join("top_roles", ", "))),
        F.when(F.size("patterns") > 0, say("patterns ", F.array_join("patterns", ", "))),
        F.when(F.col("dominant_effect").isin("network", "io", "dom"), say("oriented to ", F.col("dominant_effect"))),
        F.when(F.col("max_call_depth") > 0, say("call depth ", s("max_call_depth"))),
        F.when((F.col("avg_complexity") > 5) | (F.col("max_call_depth") > 4), "high structural complexity"))


def behaviour(files: DataFrame) -> Column:
    """Inputs, transforms, main chain, effects and exports of a file in one line."""
    s = lambda c: F.col(c).cast("string")
    has = lambda e: F.array_contains("all_effects", e)
    text = F.concat_ws(
        "; ",
        F.when(F.col("n_inputs") > 0, F.concat(F.lit("takes data at "), s("n_inputs"), F.lit(" points"))),
        F.when(F.size("all_transforms") > 0, F.concat(F.lit("applies "), _worded(F.col("all_transforms"), TRANSFORM_WORDS, ", ", 4))),
        F.when(F.col("first_chain").isNotNull(), F.concat(F.lit("main flow "), F.col("first_chain"))),
        F.when(has("network"), "uses the network"), F.when(has("io"), "reads or writes files"),
        F.when(has("dom"), "changes the page"), F.when(has("mutation"), "keeps mutable state"),
        F.when(F.col("n_exports") > 0, F.concat(F.lit("exposes "), s("n_exports"), F.lit(" symbols"))))
    return F.when(text == "", "internal, no public interface seen").otherwise(text)
