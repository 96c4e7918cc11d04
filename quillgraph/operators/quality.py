"""Quality issues, scores, debt and recommendations from function rows with roles and links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.numbers import clamp_score, count_where, round_half_up
from quillgraph.operators.graph import N_HUBS, hubs, instability


# The limits above which something is an issue.
@dataclass(frozen=True)
class Limits:
    complexity: tuple[int, int] = (10, 7)
    nesting: tuple[int, int] = (4, 3)
    lines: tuple[int, int] = (150, 80)
    params: int = 5
    fan_out: tuple[int, int] = (7, 4)
    external: int = 5
    hub: int = 10
    readers: int = 3
    utility_share: float = 0.4
    utility_nodes: int = 4
    depth: int = 6
    unstable: float = 0.8


# Penalties per severity and weights of the four scores.
COHESION_PENALTY = {"high": 20, "medium": 8}
DEBT_PENALTY = {"high": 18, "medium": 8, "low": 3}
HOURS = {"high": 3.0, "medium": 1.5, "low": 0.5}
WEIGHTS = {"complexity_score": 0.30, "coupling_score": 0.25, "cohesion_score": 0.25, "debt_score": 0.20}
N_HIGH, N_MEDIUM, N_NAMES, N_WEAKNESSES, SAME_TEXT = 4, 3, 3, 3, 60
SECTIONS = {"complexity": 1, "coupling": 2, "cohesion": 3, "debt": 4}


def _issue(condition: Column, severity: str, sub: int, metric: str, value: Column, text: str) -> Column:
    """``text`` has one %s for the value."""
    before, after = text.split("%s")
    message = F.concat(F.lit(before), value.cast("string"), F.lit(after))
    return F.when(condition, F.struct(
        F.lit(severity).alias("severity"), F.lit(sub).alias("sub"), F.lit(metric).alias("metric"),
        value.cast("double").alias("value"), message.alias("message")))


def _two_steps(value: Column, limits: tuple[int, int], sub: int, metric: str, high: str, medium: str) -> list[Column]:
    top, mid = limits
    return [
        _issue(value > top, "high", sub, metric, value, high),
        _issue((value > mid) & (value <= top), "medium", sub, metric, value, medium),
    ]


def _exploded(nodes: DataFrame, section: str, candidates: list[Column]) -> DataFrame:
    return nodes.select("file", "fn", "seq", F.inline(F.array_compact(F.array(*candidates)))).select(
        "file", F.lit(SECTIONS[section]).alias("section"), F.col("seq").cast("long").alias("seq"), "sub", "severity",
        F.col("fn").alias("scope"), "metric", "value", "message")


def complexity_issues(nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _exploded(nodes, "complexity", [
        *_two_steps(F.col("complexity"), limits.complexity, 1, "cyclomatic", "%s paths: very hard to test", "%s paths: complex"),
        *_two_steps(F.col("nesting"), limits.nesting, 2, "nesting", "nested %s deep: refactor", "nested %s deep"),
        *_two_steps(F.col("lines"), limits.lines, 3, "length", "%s lines: very long", "%s lines: split it"),
        _issue(F.col("n_params") > limits.params, "medium", 4, "parameters", F.col("n_params"), "%s parameters: pass an object"),
    ])


def coupling_issues(nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``nodes`` carry link counts. Hub issues follow all node issues of a file."""
    of_nodes = _exploded(nodes, "coupling", [
        *_two_steps(F.col("fan_out"), limits.fan_out, 1, "fan-out", "calls %s functions: too dependent", "calls %s functions"),
        _issue(F.col("n_external") > limits.external, "medium", 2, "external-calls", F.col("n_external"), "%s external calls: tightly bound"),
    ])
    central = hubs(nodes).filter(F.col("score") > limits.hub).withColumn("seq", F.lit(1_000_000_000) + F.col("rank"))
    return of_nodes.unionByName(_exploded(central, "coupling", [
        _issue(F.lit(True), "medium", 3, "hub", F.col("score"), "central with %s links: single point of failure")]))


def cohesion_flags(nodes: DataFrame) -> DataFrame:
    """Adds ``is_god`` (two of three overload signals) and ``is_mixed`` (logic mixed with effects)."""
    signals = (
        F.when(F.size("transforms") > 5, 1).otherwise(0)
        + F.when(F.size("effects") > 3, 1).otherwise(0)
        + F.when((F.col("complexity") > 8) & (F.col("n_calls") > 5), 1).otherwise(0)
    )
    return nodes.withColumn("is_god", signals >= 2).withColumn(
        "is_mixed", (signals < 2) & (F.size("transforms") > 3) & (F.size("effects") >= 2))


def cohesion_issues(nodes: DataFrame) -> DataFrame:
    kinds = F.size("transforms")
    return _exploded(cohesion_flags(nodes), "cohesion", [
        _issue(F.col("is_god"), "high", 1, "cohesion", kinds, "%s kinds of work: too many duties"),
        _issue(F.col("is_mixed"), "medium", 1, "cohesion", kinds, "%s kinds of work mixed with effects"),
    ])


def redundant_groups(nodes: DataFrame, role: str = "pure-function") -> DataFrame:
    """Pure functions that share one transform set with another: (file, transform_key, fn, group_size)."""
    pure = nodes.filter((F.col("role") == role) & (F.size("transforms") > 0)).select(
        "file", F.array_join(F.array_sort("transforms"), ":").alias("transform_key"), "fn")
    sizes = pure.groupBy("file", "transform_key").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size >= 2")
    return pure.join(sizes, ["file", "transform_key"])


def hotspots(nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return nodes.filter((F.col("complexity") > limits.complexity[1]) | (F.col("nesting") > limits.nesting[1]))


def file_facts(nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All per-file counts the scores, debt items and styles need, in one aggregation."""
    fx = lambda e: F.array_contains("effects", e)
    role = F.col("role")
    no_params = F.col("n_params") == 0
    return cohesion_flags(nodes).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.round(F.avg("complexity"), 1).alias("avg_complexity"),
        F.max("nesting").alias("max_nesting"),
        count_where(F.col("lines") > limits.lines[1]).alias("n_long"),
        F.sum("fan_out").alias("sum_fan_out"),
        count_where(F.col("fan_in") + F.col("fan_out") > 0).alias("n_linked"),
        count_where(F.col("is_god")).alias("n_god"),
        count_where(F.col("is_mixed")).alias("n_mixed"),
        count_where(no_params & (F.col("n_reads") > limits.readers)).alias("n_global_readers"),
        count_where(F.col("is_async") & ~fx("throws") & ~F.col("calls_catch")).alias("n_uncaught"),
        count_where(fx("mutation") & ~no_params).alias("n_mutators"),
        count_where(role == "utility").alias("n_utility"),
        count_where(role == "pure-function").alias("n_pure"),
        count_where(F.col("is_async")).alias("n_async"),
        count_where(role.isin("io-handler", "event-handler") | (~no_params & (role != "factory"))).alias("n_inputs"),
    )


def complexity_score() -> Column:
    share_long = F.col("n_long") / F.col("n_nodes")
    return clamp_score(F.lit(100.0) - (F.col("avg_complexity") - 1) * 8 - F.col("max_nesting") * 5 - share_long * 20)


def coupling_score() -> Column:
    n_hubs = F.least(F.col("n_linked"), F.lit(N_HUBS))
    return clamp_score(F.lit(100.0) - F.col("sum_fan_out") / F.col("n_nodes") * 6 - n_hubs * 4)


def cohesion_score() -> Column:
    return clamp_score(F.lit(100.0) - F.col("n_god") * COHESION_PENALTY["high"] - F.col("n_mixed") * COHESION_PENALTY["medium"])


def debt_candidates(limits: Limits = Limits()) -> list[Column]:
    """Debt items of a file row, in order; null where one does not apply."""
    share = F.col("n_utility") / F.col("n_nodes")
    spec = [
        (F.col("n_global_readers") > 0, "medium", "global coupling", F.col("n_global_readers"), "%s functions read outer state without parameters"),
        (F.col("n_uncaught") > 0, "high", "error handling", F.col("n_uncaught"), "%s asynchronous functions without error handling"),
        (F.col("n_mutators") > 0, "medium", "mutation", F.col("n_mutators"), "%s functions change what they are given"),
        ((share > limits.utility_share) & (F.col("n_nodes") > limits.utility_nodes), "low", "structure",
         round_half_up(share * 100), "%s percent of functions unclassified"),
        (F.col("max_call_depth") > limits.depth, "medium", "depth", F.col("max_call_depth"), "calls nest %s deep"),
    ]
    items = []
    for sub, (condition, severity, category, value, text) in enumerate(spec, 1):
        # A counted item weighs by its count; the share and the depth count once.
        n = value.cast("long") if sub <= 3 else F.lit(1).cast("long")
        before, after = text.split("%s")
        items.append(F.when(condition, F.struct(
            F.lit(sub).alias("sub"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), n.alias("n"),
            F.concat(F.lit(before), value.cast("string"), F.lit(after)).alias("message"))))
    return items


def debt_items(facts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows per debt item; ``facts`` has ``max_call_depth`` beside the file counts."""
    return facts.select("file", F.inline(F.array_compact(F.array(*debt_candidates(limits)))))


def with_debt(facts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds ``debt_score`` and ``refactor_hours`` from the at most five items of a file."""
    total = lambda per_item: F.aggregate("_debt", F.lit(0.0), lambda acc, i: acc + per_item(i))
    by = lambda table, i: F.coalesce(*[F.when(i["severity"] == s, F.lit(float(v))) for s, v in table.items()])
    hours = lambda i: F.when(i["severity"] == "low", F.lit(HOURS["low"])).otherwise(by(HOURS, i) * i["n"])
    return (
        facts.withColumn("_debt", F.array_compact(F.array(*debt_candidates(limits))))
        .withColumn("debt_score", clamp_score(F.lit(100.0) - total(lambda i: by(DEBT_PENALTY, i))))
        .withColumn("refactor_hours", F.round(total(hours), 1))
        .drop("_debt")
    )


def with_scores(facts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds the four scores, their weighted ``score`` and the refactoring hours."""
    scored = with_debt(
        facts.withColumn("complexity_score", complexity_score()).withColumn("coupling_score", coupling_score())
        .withColumn("cohesion_score", cohesion_score()), limits)
    weighted = sum((F.col(c) * F.lit(w) for c, w in list(WEIGHTS.items())[1:]),
                   F.col("complexity_score") * F.lit(WEIGHTS["complexity_score"]))
    return scored.withColumn("score", round_half_up(weighted))


def all_issues(nodes: DataFrame, facts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Issues of all four sections in their report order (section, seq, sub)."""
    debt = debt_items(facts, limits).select(
        "file", F.lit(SECTIONS["debt"]).alias("section"), F.lit(0).cast("long").alias("seq"), "sub", "severity",
        F.col("category").alias("scope"), F.col("category").alias("metric"), F.col("n").cast("double").alias("value"), "message")
    return complexity_issues(nodes, limits).unionByName(coupling_issues(nodes, limits)).unionByName(
        cohesion_issues(nodes)).unionByName(debt)


def _first_names(rows: DataFrame) -> DataFrame:
    """Scope text of the first few functions of each file; the rank filter runs before the shuffle."""
    order = W.partitionBy("file").orderBy("seq", "fn")
    first = rows.select("file", "fn", "seq").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= N_NAMES)
    return first.groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "fn"))), lambda s: s["fn"]), ", ").alias("scope"))


def recommendations(nodes: DataFrame, issues: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows (file, place, priority, scope, action): first high and medium issues, hotspots, unstable
    nodes; of actions that begin alike only the first stays. At most nine rows per file meet."""
    order = W.partitionBy("file", "severity").orderBy("section", "seq", "sub")

    def first(severity: str, n: int, base: int, priority: str) -> DataFrame:
        chosen = issues.filter(F.col("severity") == severity).withColumn("_r", F.row_number().over(order))
        return chosen.filter(F.col("_r") <= n).select(
            "file", (F.lit(base) + F.col("_r")).alias("place"), F.lit(priority).alias("priority"), "scope", F.col("message").alias("action"))

    def line(rows: DataFrame, place: int, priority: str, action: str) -> DataFrame:
        return _first_names(rows).select(
            "file", F.lit(place).alias("place"), F.lit(priority).alias("priority"), "scope", F.lit(action).alias("action"))

    unstable = instability(nodes).filter(F.col("instability") > limits.unstable)
    gathered = (
        first("high", N_HIGH, 0, "high").unionByName(first("medium", N_MEDIUM, 10, "medium"))
        .unionByName(line(hotspots(nodes, limits), 21, "high", "break into smaller functions"))
        .unionByName(line(unstable, 31, "medium", "lower instability by inverting dependencies"))
    )
    alike = W.partitionBy("file", F.substring("action", 1, SAME_TEXT)).orderBy("place")
    kept = gathered.withColumn("_r", F.row_number().over(alike)).filter("_r = 1").drop("_r")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("file").orderBy("place")))


def top_weaknesses(issues: DataFrame, n: int = N_WEAKNESSES) -> DataFrame:
    """First high issues of a file in report order."""
    order = W.partitionBy("file").orderBy("section", "seq", "sub")
    high = issues.filter("severity = 'high'").withColumn("rank", F.row_number().over(order))
    return high.filter(F.col("rank") <= n).select("file", "rank", "scope", "message")
