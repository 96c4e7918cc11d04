"""Mutation queries: every part is rendered as a small seed function."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import augment as G
from quillgraph.plans.registry import query
from quillgraph.session import table

SEED = "seed-11"
VARIANTS = 4


def seeds(spark, sf):
    """One function per part; its words, size and key make the text."""
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    code = F.concat(
        F.lit("function "), word(2), key, F.lit("("), word(1), F.lit(", scale) { let sum = 0; for (let i = 0; i < "), size,
        F.lit("; i++) { sum += "), word(1), F.lit(" * "), word(1), F.lit("; } return sum + Math.pow(scale, 2); }"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), F.col("p_type").alias("category"), code.alias("code"),
        word(1).alias("w1"), word(2).alias("w2"))


V8 = """WITH seeds AS (SELECT p_partkey AS id, p_brand AS label, p_type AS category, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_size,
  'function ' || w2 || p_partkey || '(' || w1 || ', scale) { let sum = 0; for (let i = 0; i < ' || p_size || '; i++) { sum += ' || w1 || ' * ' || w1 || '; } return sum + Math.pow(scale, 2); }' AS code FROM part)"""


def h_sql(purpose: str, key: str = "id") -> str:
    return f"('0x' || substr(md5('{SEED}|' || {key} || '|{purpose}'), 1, 8))::BIGINT"


def order_sql(purpose: str, item: str, key: str = "id") -> str:
    return f"('0x' || substr(md5({h_sql(purpose, key)} || '|' || {item}), 1, 8))::BIGINT"


def pick_sql(names, purpose: str) -> str:
    return f"{list(names)!r}[{h_sql(purpose)} % {len(names)} + 1]"


def one_per_seed(spark, sf, fn):
    return seeds(spark, sf).select("id", fn(F.col("code"), G.drawer(SEED, "id")).alias("source"))


@query("g1_extract_params", V8 + " SELECT id, w1 || ',scale' AS params FROM seeds")
def g1(spark, sf):
    return seeds(spark, sf).select("id", F.array_join(G.extract_params(F.col("code")), ",").alias("params"))


@query("g1_extract_params_documents", """
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_extract(text, '\\(([^)]*)\\)', 1), ','), lambda p: trim(p)), lambda p: p <> ''), '|') AS params FROM documents""")
def g1_documents(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(G.extract_params(F.col("text"), r"\(([^)]*)\)"), "|").alias("params"))


@query("g2_rename_whole_words", V8 + f""",
pools(k, pool) AS (VALUES {', '.join(f'({i}, {list(p)!r})' for i, p in enumerate(G.PARAMETER_POOLS))}),
n AS (SELECT id, unnest(pool) AS name FROM seeds JOIN pools ON k = {h_sql('pool')} % {len(G.PARAMETER_POOLS)}),
s AS (SELECT id, list(name ORDER BY {order_sql('names', 'name')}, name) AS names FROM n GROUP BY 1)
SELECT id, regexp_replace(regexp_replace(code, '\\b' || w1 || '\\b', names[1], 'g'), '\\bscale\\b', names[2], 'g') AS source FROM seeds JOIN s USING (id)""")
def g2(spark, sf):
    return one_per_seed(spark, sf, lambda code, draw: G.rename_whole_words(code, G.extract_params(code), draw))


def _noise_sql() -> str:
    return "[" + ", ".join("'" + n.replace("\n", "") + "' || chr(10)" for n in G.NOISE) + "]"


@query("g3_inject_noise", V8 + f""",
n AS (SELECT id, unnest({_noise_sql()}) AS name FROM seeds),
s AS (SELECT id, list(name ORDER BY {order_sql('noise', 'name')}, name) AS names FROM n GROUP BY 1)
SELECT id, regexp_replace(code, '\\{{', '{{' || chr(10) || array_to_string(names[1:({h_sql('n_noise')} % 3 + 1)], '')) AS source FROM seeds JOIN s USING (id)""")
def g3(spark, sf):
    return one_per_seed(spark, sf, G.inject_noise)


@query("g3_inject_noise_pages", f"""
WITH seeds AS (SELECT page_id AS id, html AS code FROM pages), n AS (SELECT id, unnest({_noise_sql()}) AS name FROM seeds),
s AS (SELECT id, list(name ORDER BY {order_sql('noise', 'name')}, name) AS names FROM n GROUP BY 1)
SELECT id, md5(regexp_replace(code, '\\{{', '{{' || chr(10) || array_to_string(names[1:({h_sql('n_noise')} % 3 + 1)], ''))) AS digest FROM seeds JOIN s USING (id)""")
def g3_pages(spark, sf):
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("code"))
    return rows.select("id", F.md5(G.inject_noise(F.col("code"), G.drawer(SEED, "id"))).alias("digest"))


# The seed texts are known, so the two back-reference mutations have plain twins here.
@query("g4_loop_form_swap", V8 + f""",
k AS (SELECT *, {pick_sql(G.LOOP_NAMES, 'loop')} AS v FROM seeds)
SELECT id, replace(code, 'for (let i = 0; i < ' || p_size || '; i++) {{', 'let ' || v || ' = 0;' || chr(10) || 'while (' || v || ' < ' || p_size || ') {{' || chr(10) || v || '++;') AS source FROM k""")
def g4(spark, sf):
    return one_per_seed(spark, sf, G.loop_form_swap)


@query("g5_square_to_pow", V8 + " SELECT id, replace(code, w1 || ' * ' || w1, 'Math.pow(' || w1 || ', 2)') AS source FROM seeds")
def g5(spark, sf):
    return one_per_seed(spark, sf, G.square_to_pow)


@query("g6_pow_to_square", V8 + r""" SELECT id, regexp_replace(code, 'Math\.pow\((\w+),\s*2\)', '\1 * \1', 'g') AS source FROM seeds""")
def g6(spark, sf):
    return one_per_seed(spark, sf, G.pow_to_square)


@query("g7_extract_intermediate", V8 + f""",
k AS (SELECT *, {pick_sql(G.TEMPORARY_NAMES, 'temporary')} AS v FROM seeds)
SELECT id, regexp_replace(code, 'return\\s+([^;{{}}]+);', 'const ' || v || ' = \\1;' || chr(10) || '  return ' || v || ';') AS source FROM k""")
def g7(spark, sf):
    return one_per_seed(spark, sf, G.extract_intermediate)


@query("g8_rename_accumulator", V8 + f""",
k AS (SELECT *, {pick_sql(G.ACCUMULATOR_NAMES, 'accumulator')} AS v FROM seeds)
SELECT id, CASE WHEN v = 'sum' THEN code ELSE regexp_replace(code, '\\bsum\\b', v, 'g') END AS source FROM k""")
def g8(spark, sf):
    return one_per_seed(spark, sf, G.rename_accumulator)


@query("g9_rename_entity", V8 + f"""
SELECT id, regexp_replace(code, 'function\\s+\\w+\\s*\\(', 'function ' || {pick_sql(G.ENTITY_NAMES, 'entity')} || '(') AS source FROM seeds""")
def g9(spark, sf):
    return one_per_seed(spark, sf, G.rename_entity)


@query("g10_wrap_return", V8 + r""" SELECT id, regexp_replace(code, 'return\s+([^;{}(][^;{}]*);', 'return (\1);') AS source FROM seeds""")
def g10(spark, sf):
    return one_per_seed(spark, sf, G.wrap_return)


VKEY = "id || '|' || variant"
CHOICES = V8 + f""",
v AS (SELECT *, unnest(generate_series(0, {VARIANTS}))::INTEGER AS variant FROM seeds),
mw(name, w) AS (VALUES {', '.join(f"('{n}', {w})" for n, w in G.WEIGHTS.items())}),
kk AS (SELECT id, variant, name, {order_sql('order', 'name', VKEY)} AS o FROM v, mw WHERE variant > 0
  AND ('0x' || substr(md5('{SEED}|' || {VKEY} || '|keep_' || name), 1, 8))::BIGINT / 4294967296.0::DOUBLE < w),
ls AS (SELECT id, variant, list(name ORDER BY o, name) AS names FROM kk GROUP BY 1, 2),
ch AS (SELECT v.*, variant > 0 AND {h_sql('rename', VKEY)} / 4294967296.0::DOUBLE < 0.88 AS renames,
  array_to_string(coalesce(names, [])[1:({h_sql('n_mutations', VKEY)} % 4 + 1)], ',') AS mutations FROM v LEFT JOIN ls USING (id, variant))"""


@query("g11_weighted_mutation_sampling", CHOICES + " SELECT id, variant, renames, mutations FROM ch")
def g11(spark, sf):
    chosen = G.with_choices(G.expand_variants(seeds(spark, sf), "id", VARIANTS), "id", SEED)
    return chosen.select("id", "variant", "renames", F.array_join("mutations", ",").alias("mutations"))


@query("g12_expand_variants", CHOICES + """
SELECT id, label, category, variant, CASE WHEN NOT renames AND mutations = '' THEN code END AS untouched, contains(mutations, 'loop_form_swap') AS meaning_changed FROM ch""")
def g12(spark, sf):
    rows = G.labelled_corpus(seeds(spark, sf), "id", SEED, VARIANTS)
    untouched = F.when(~F.col("renames") & (F.size("mutations") == 0), F.col("source"))
    return rows.select("id", "label", "category", "variant", untouched.alias("untouched"), "meaning_changed")


@query("g12_labelled_corpus")
def g12_corpus(spark, sf):
    """The whole corpus: every seed with all its variants, not the few that the twins above enumerate."""
    return G.labelled_corpus(seeds(spark, sf), "id", SEED).select("id", "label", "category", "variant", "source")


@query("g13_category_distribution", """
SELECT 'type' AS dimension, p_type AS category, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2""")
def g13(spark, sf):
    parts = G.category_distribution(table(spark, sf, "part").withColumnRenamed("p_type", "category"), "category")
    langs = G.category_distribution(table(spark, sf, "documents").select(F.col("lang").alias("category")), "category")
    return parts.select(F.lit("type").alias("dimension"), "category", "n").unionByName(langs.select(F.lit("lang").alias("dimension"), "category", "n"))
