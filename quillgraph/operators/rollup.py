"""File reports and their aggregation over repositories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.numbers import count_where, round_half_up
from quillgraph.operators import graph as C
from quillgraph.operators import quality as Q
from quillgraph.operators import roles as R
from quillgraph.session import cut_lineage

# Lengths of the report lists and of the repository lists.
N_RELATIONS, N_REPORT_CHAINS = 20, 5
TOP_ROLES, TOP_PATTERNS, TOP_EFFECTS, TOP_STYLES, TOP_WEAKNESSES = 8, 6, 5, 4, 5


@dataclass
class FileAnalysis:
    """The fact tables one analysis run shares between its reports."""

    nodes: DataFrame
    edges: DataFrame
    facts: DataFrame
    limits: Q.Limits

    @property
    def issues(self) -> DataFrame:
        return Q.all_issues(self.nodes, self.facts, self.limits)


def analyse(features: DataFrame, edges: DataFrame, limits: Q.Limits = Q.Limits()) -> FileAnalysis:
    """Roles, links, depth and file counts. Function rows are written once: every report reads them."""
    classified = cut_lineage(C.call_edges(edges, features.select("file", "fn")))
    nodes = cut_lineage(R.assign_roles(C.with_links(features, classified)))
    facts = Q.file_facts(nodes, limits).join(C.max_call_depth(nodes.select("file", "fn", "fan_in", "fan_out"), classified), "file")
    return FileAnalysis(nodes, classified, cut_lineage(facts), limits)


def file_profile(run: FileAnalysis, structure: DataFrame) -> DataFrame:
    """One row per file: counts, scores, patterns, roles, effects, chains, style and texts.

    Only short lists are gathered per file: ten patterns, three roles, seventeen kinds of tag.
    """
    patterns = R.file_patterns(run.nodes, run.edges).groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "pattern"))), lambda s: s["pattern"]).alias("patterns"))
    top_roles = R.dominant_roles(run.nodes).groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "role"))), lambda s: s["role"]).alias("top_roles"))
    tags = run.nodes.select("file", F.explode(F.concat(
        F.transform("effects", lambda e: F.struct(F.lit("effect").alias("kind"), e.alias("tag"))),
        F.transform("transforms", lambda t: F.struct(F.lit("transform").alias("kind"), t.alias("tag"))))).alias("_t")).select("file", "_t.*")
    of_kind = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("tag"))))
    tag_sets = tags.groupBy("file").agg(of_kind("effect").alias("all_effects"), of_kind("transform").alias("all_transforms"))
    main_effect = R.dominant_effect(run.nodes).select("file", F.col("effect").alias("dominant_effect"))
    chains = C.transform_chains(run.edges, n=None).groupBy("file").agg(
        F.max(F.size("chain")).alias("longest_chain"),
        F.min_by(C.chain_text(F.col("chain")), F.struct("from_fn", "to_fn")).alias("first_chain"))
    files = Q.with_scores(run.facts, run.limits)
    for part in (patterns, top_roles, tag_sets, main_effect, chains, structure.drop("repo")):
        files = files.join(part, "file", "left")
    none = F.array().cast("array<string>")
    files = files.fillna(0, ["longest_chain", "n_classes", "n_inheriting", "n_imports", "n_exports"])
    for c in ("patterns", "top_roles", "all_effects", "all_transforms"):
        files = files.withColumn(c, F.coalesce(c, none))
    return (
        files.withColumn("repo", F.substring_index("file", "/", 1))
        .withColumn("style", R.architecture_style(files))
        .withColumn("complexity_class", R.complexity_class(F.col("avg_complexity"), F.col("max_call_depth")))
        .withColumn("narrative", R.narrative(files))
        .withColumn("behaviour", R.behaviour(files))
    )


def report_json(run: FileAnalysis, profile: DataFrame) -> DataFrame:
    """One JSON report per file. Lists are the capped ones; function lines are ``report_lines``."""
    def first(rows: DataFrame, n: int, order: list, fields: list[str], name: str) -> DataFrame:
        ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("file").orderBy(*order))).filter(F.col("_r") <= n)
        return ranked.groupBy("file").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_r", *fields))), lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))

    parts = [
        first(run.edges, N_RELATIONS, ["from_fn", "to_fn"], ["from_fn", "to_fn", "kind"], "relations"),
        first(C.transform_chains(run.edges, N_REPORT_CHAINS).withColumn("chain", C.chain_text(F.col("chain"))),
              N_REPORT_CHAINS, ["rank"], ["chain"], "chains"),
        first(C.hubs(run.nodes), C.N_HUBS, ["rank"], ["fn", "score"], "hubs"),
        first(Q.recommendations(run.nodes, run.issues, run.limits), 9, ["place"], ["priority", "scope", "action"], "recommendations"),
        first(Q.top_weaknesses(run.issues), Q.N_WEAKNESSES, ["rank"], ["message"], "weaknesses"),
    ]
    report = profile
    for part in parts:
        report = report.join(part, "file", "left")
    section = lambda *cols: F.struct(*cols)
    return report.select("file", F.to_json(F.struct(
        section("n_nodes", "n_classes", "n_imports", "n_exports").alias("structure"),
        section("relations", "chains", "hubs", "max_call_depth", "avg_complexity").alias("graph"),
        section("top_roles", "patterns", "all_effects", "all_transforms").alias("semantics"),
        section("narrative", "behaviour", "complexity_class").alias("intent"),
        section("score", "complexity_score", "coupling_score", "cohesion_score", "debt_score", "refactor_hours",
                "recommendations").alias("quality"),
        section("style", "weaknesses", "dominant_effect").alias("synthesis"),
    )).alias("report"))


def report_lines(run: FileAnalysis) -> DataFrame:
    """The uncapped part of the reports: one JSON line per function."""
    fields = ["fn", "role", "explanation", "complexity", "nesting", "lines", "is_async", "effects", "transforms", "fan_in", "fan_out"]
    return R.explain_function(run.nodes).select("file", "seq", F.to_json(F.struct(*fields)).alias("line"))


def repo_facets(nodes: DataFrame, profile: DataFrame, patterns: DataFrame, weaknesses: DataFrame, by: str = "repo") -> DataFrame:
    """Roles, effects, patterns, styles and weaknesses per repository, each with its own list length.

    Function rows are counted under both of their facets in one pass; file-level facets join the
    counts after they have shrunk to one row per value.
    """
    repo = F.substring_index("file", "/", 1).alias(by)
    of_functions = nodes.select(repo, F.explode(F.concat(
        F.array(F.struct(F.lit("role").alias("facet"), F.col("role").alias("value"))),
        F.transform("effects", lambda e: F.struct(F.lit("effect").alias("facet"), e.alias("value"))))).alias("_f")).select(by, "_f.*")
    of_files = (
        patterns.select(repo, F.lit("pattern").alias("facet"), F.col("pattern").alias("value"))
        .unionByName(profile.select(repo, F.lit("style").alias("facet"), F.col("style").alias("value")))
        .unionByName(weaknesses.select(repo, F.lit("weakness").alias("facet"), F.col("message").alias("value")))
    )
    counts = of_functions.unionByName(of_files).groupBy(by, "facet", "value").agg(F.count(F.lit(1)).alias("n"))
    lengths = {"role": TOP_ROLES, "pattern": TOP_PATTERNS, "effect": TOP_EFFECTS, "style": TOP_STYLES, "weakness": TOP_WEAKNESSES}
    order = W.partitionBy(by, "facet").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(lengths.values()))
    keep = F.coalesce(*[F.when(F.col("facet") == facet, F.col("rank") <= n) for facet, n in lengths.items()])
    return ranked.filter(keep)


def quality_distribution(profile: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    s = F.col(score)
    return profile.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(round_half_up(F.avg(s)), F.lit(0)).cast("long").alias("avg_quality"),
        count_where(s >= 80).alias("excellent"), count_where((s >= 60) & (s < 80)).alias("good"),
        count_where((s >= 40) & (s < 60)).alias("fair"), count_where(s < 40).alias("poor"))


def file_counters(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` has fetch ``error`` and ``parse_error``; both are kept apart from the analysed files."""
    failed = F.col("error").isNotNull()
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        count_where(~failed & F.col("parse_error").isNull()).alias("n_analysed"),
        count_where(failed).alias("n_fetch_errors"),
        count_where(~failed & F.col("parse_error").isNotNull()).alias("n_parse_errors"))


def file_summary(profile: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per file: style, score and its roles as role=count, at most one entry per role."""
    counts = nodes.groupBy("file", "role").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat("role", F.lit("="), F.col("n").cast("string")))), ",").alias("roles"))
    return profile.select("file", "style", "score").join(listed, "file", "left")
