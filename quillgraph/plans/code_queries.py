"""Source-fact queries: every part is rendered as a small module; pages and documents as plain text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import facts as X
from quillgraph.operators import graph as C
from quillgraph.operators import quality as Q
from quillgraph.operators import roles as R
from quillgraph.operators import rollup as A
from quillgraph.plans.corpus_queries import sql_text
from quillgraph.plans.registry import query
from quillgraph.session import cut_lineage, dealt, table

# A module per part, as alternating text and column pieces. {w1} and {w2} are the words of the
# part's name, {id} its key, {size} its size, {k} repeats a line up to three times.
MODULE = """import store, { load as fetchRow } from 'lib_<brand>';
const fs = require('type_<type>');
let LIMIT = <size>;
// builds <name>() by hand
function <w2><id>(<w1>Val, scale = 2, ...rest) {
  let total = 0;
  for (let i = 0; i < <size>; i++) {
    if (i > 2 && <w1>Val) { total += <w1>Val * <w1>Val; }
  }
<extra>  console.log(scale);
  return total + Math.pow(scale, 2);
}
const <w1>Of = async (x) => { await load(x); return x * 2; };
[1, 2].map(v => v + <size>);
<w1>Of(1, function () { return 2; });
<class>(function () { <w2><id>(1); })();
module.exports = { <w2><id> };
export default <w1>Of;
"""
EXTRA_LINE = "  if (scale > 3) { scale = 1; }\n"
CLASS_TEXT = """class <w2>Box extends Base {
  constructor(n) { this.n = n; }
  static make() { return new Base(1); }
}
"""


def _pieces(template: str) -> list[tuple[bool, str]]:
    """(is a name, text) pieces of a template."""
    out, rest = [], template
    while "<" in rest and ">" in rest[rest.index("<"):]:
        i = rest.index("<")
        j = rest.index(">", i)
        name = rest[i + 1:j]
        if name in ("brand", "type", "size", "name", "w1", "w2", "id", "extra", "class"):
            out += [(False, rest[:i]), (True, name)]
            rest = rest[j + 1:]
        else:
            out.append((False, rest[:i + 1]))
            rest = rest[i + 1:]
    return out + [(False, rest)]


def parts(spark, sf, *columns):
    """Parts to be rendered; the texts weigh far more than the rows they are made from."""
    return dealt(table(spark, sf, "part").select("p_partkey", *columns), "p_partkey")


def modules(spark, sf):
    part = parts(spark, sf, "p_brand", "p_type", "p_size", "p_name")
    cols = {
        "brand": F.replace("p_brand", F.lit("#"), F.lit("_")), "type": F.col("p_type"), "size": F.col("p_size").cast("string"), "name": F.col("p_name"),
        "w1": F.split_part("p_name", F.lit(" "), F.lit(1)), "w2": F.split_part("p_name", F.lit(" "), F.lit(2)), "id": F.col("p_partkey").cast("string"),
        "extra": F.repeat(F.lit(EXTRA_LINE), F.col("p_size") % 4)}
    fill = lambda template: F.concat(*[cols[t] if named else F.lit(t) for named, t in _pieces(template)])
    cols["class"] = F.when(F.col("p_size") <= 25, fill(CLASS_TEXT)).otherwise("")
    return part.select(F.col("p_partkey").cast("string").alias("file"), fill(MODULE).alias("text"))


def scan(spark, sf, *operators):
    """Tokens of the modules with what the operators read of them."""
    return X.tokens(modules(spark, sf), only=[field for operator in operators for field in X.READS[operator]])


def _fill_sql(template: str) -> str:
    cols = {
        "brand": "replace(p_brand, '#', '_')", "type": "p_type", "size": "p_size", "name": "p_name", "w1": "split_part(p_name, ' ', 1)",
        "w2": "split_part(p_name, ' ', 2)", "id": "p_partkey", "extra": f"repeat({sql_text(EXTRA_LINE)}, p_size % 4)", "class": ""}
    if "<class>" in template:
        cols["class"] = f"(CASE WHEN p_size <= 25 THEN {_fill_sql(CLASS_TEXT)} ELSE '' END)"
    return " || ".join(cols[t] if named else sql_text(t) for named, t in _pieces(template))


V9 = f"""WITH code AS (SELECT p_partkey::VARCHAR AS file, p_size, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_type, replace(p_brand, '#', '_') AS brand, p_partkey AS id,
  {_fill_sql(MODULE)} AS text FROM part)"""
# Line of the first occurrence of a mark.
LINE = "len(string_split(split_part(text, {}, 1), chr(10)))"
MAIN = "'function ' || w2 || id"


@query("x1_functions", V9 + f"""
SELECT file, w2 || id AS fn, 'declaration' AS kind, {LINE.format(MAIN)} AS start_line, {LINE.format("'const ' || w1 || 'Of'")} - 1 AS end_line, false AS is_async FROM code
UNION ALL SELECT file, w1 || 'Of', 'arrow', {LINE.format("'const ' || w1 || 'Of'")}, {LINE.format("'const ' || w1 || 'Of'")}, true FROM code
UNION ALL SELECT file, 'map.cb', 'arrow', {LINE.format("'[1, 2]'")}, {LINE.format("'[1, 2]'")}, false FROM code
UNION ALL SELECT file, w1 || 'Of.cb2', 'expression', {LINE.format("'Of(1, f'")}, {LINE.format("'Of(1, f'")}, false FROM code
UNION ALL SELECT file, '<anonymous>', 'expression', {LINE.format("'(function ()'")}, {LINE.format("'(function ()'")}, false FROM code
UNION ALL SELECT file, 'constructor', 'constructor', {LINE.format("'constructor'")}, {LINE.format("'constructor'")}, false FROM code WHERE p_size <= 25
UNION ALL SELECT file, 'make', 'method', {LINE.format("'static make'")}, {LINE.format("'static make'")}, false FROM code WHERE p_size <= 25""")
def x1(spark, sf):
    fns = X.functions(scan(spark, sf, "function_headers"), ("fn", "kind", "start_line", "end_line", "is_async"))
    return fns.select("file", "fn", "kind", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "is_async")


@query("x1_token_counts", f"""
WITH f AS (SELECT 'page/' || page_id AS file, html AS text FROM pages UNION ALL SELECT 'document/' || doc_id, text FROM documents),
t AS (SELECT file, unnest(regexp_extract_all(text, {sql_text(X.SOURCE_PATTERN)})) AS tok FROM f)
SELECT file, count(*) AS n_tokens, count(*) FILTER (WHERE tok IN ('(', '{{', '[')) AS n_opening FROM t WHERE NOT starts_with(tok, '//') AND NOT starts_with(tok, '/*') GROUP BY 1""")
def x1_tokens(spark, sf):
    pages = table(spark, sf, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("file"), F.col("html").alias("text"))
    docs = table(spark, sf, "documents").select(F.concat(F.lit("document/"), F.col("doc_id").cast("string")).alias("file"), "text")
    return X.code_tokens(pages.unionByName(docs)).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count(F.when(F.col("tok").isin(*X.OPENING), 1)).alias("n_opening"))


@query("x2_param_normalise", V9 + """
SELECT file, w2 || id AS fn, w1 || 'Val|scale|...rest' AS params FROM code UNION ALL SELECT file, w1 || 'Of', 'x' FROM code UNION ALL SELECT file, 'map.cb', 'v' FROM code
UNION ALL SELECT file, w1 || 'Of.cb2', '' FROM code UNION ALL SELECT file, '<anonymous>', '' FROM code UNION ALL SELECT file, 'constructor', 'n' FROM code WHERE p_size <= 25
UNION ALL SELECT file, 'make', '' FROM code WHERE p_size <= 25""")
def x2(spark, sf):
    return X.functions(scan(spark, sf, "function_headers"), ("fn", "params")).select("file", "fn", F.array_join("params", "|").alias("params"))


@query("x3_classes", V9 + """
SELECT file, w2 || 'Box' AS name, 'Base' AS parent, 'constructor:constructor:false|make:method:true' AS methods FROM code WHERE contains(text, 'class ')""")
def x3(spark, sf):
    toks = scan(spark, sf, "function_headers", "classes")
    listed = X.class_methods(toks).groupBy("file", F.col("class_name").alias("name")).agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws(":", "name", "kind", F.col("is_static").cast("string")))), "|").alias("methods"))
    return X.classes(toks).select("file", "name", "parent").join(listed, ["file", "name"], "left")


@query("x4_imports", V9 + r"""
SELECT file, regexp_extract(text, 'from ''([^'']*)''', 1) AS source, 'esm' AS kind FROM code
UNION ALL SELECT file, regexp_extract(text, '= require\(''([^'']*)''', 1), 'cjs' FROM code""")
def x4(spark, sf):
    return X.imports(scan(spark, sf, "imports")).select("file", "source", "kind")


@query("x5_exports", V9 + " SELECT file, 'module.exports' AS name, 'cjs' AS kind FROM code UNION ALL SELECT file, 'default', 'default' FROM code")
def x5(spark, sf):
    return X.exports(scan(spark, sf, "exports")).select("file", "name", "kind")


@query("x6_globals", V9 + r"""
SELECT file, d[1] AS kind, d[2] AS name FROM (SELECT file, string_split(unnest(regexp_extract_all(text, '(?m)^(?:let|const) \w+')), ' ') AS d FROM code)""")
def x6(spark, sf):
    return X.globals_of(scan(spark, sf, "globals_of")).select("file", "kind", "name")


@query("x7_entry_points", V9 + f"""
SELECT file, 'IIFE' AS type, {LINE.format("'(function ()'")} AS line FROM code UNION ALL SELECT file, 'default-export', {LINE.format("'export default'")} FROM code""")
def x7(spark, sf):
    return X.entry_points(scan(spark, sf, "entry_points")).select("file", "type", F.col("line").cast("long").alias("line"))


@query("x8_infer_names", V9 + """
SELECT file, unnest([w1 || 'Of', 'map.cb', w1 || 'Of.cb2', '<anonymous>']) AS fn FROM code""")
def x8(spark, sf):
    return X.functions(scan(spark, sf, "function_headers"), ("fn", "kind")).filter("kind IN ('arrow', 'expression')").select("file", "fn")


@query("x9_calls", V9 + """
SELECT file, unnest([w2 || id || ' > console.log', w2 || id || ' > Math.pow', w1 || 'Of > load', '<anonymous> > ' || w2 || id]) AS call FROM code""")
def x9(spark, sf):
    edges = X.edges_of(X.function_facts(modules(spark, sf), only=("fn", "calls")))
    return edges.select("file", F.concat_ws(" > ", "from_fn", "to_fn").alias("call"))


@query("x9_page_calls", r"""
WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '<script>(.*?)</script>', 1)) AS script FROM pages)
SELECT page_id, 'track' AS callee, count(*) AS n FROM s WHERE regexp_matches(script, 'track\(') GROUP BY 1""")
def x9_pages(spark, sf):
    scripts = F.regexp_extract_all("html", F.lit("<script>(.*?)</script>"), F.lit(1))
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(scripts).alias("n", "text")).withColumn(
        "file", F.concat_ws("/", F.col("page_id").cast("string"), F.col("n").cast("string")))
    sites = X.calls(X.tokens(rows, only=X.READS["calls"]))
    return sites.groupBy(F.split_part("file", F.lit("/"), F.lit(1)).cast("long").alias("page_id"), "callee").agg(F.count(F.lit(1)).alias("n"))


@query("x11_decision_points", V9 + """
SELECT file, w2 || id AS fn, 4 + p_size % 4 AS complexity FROM code""")
def x11(spark, sf):
    return X.function_facts(modules(spark, sf), only=("fn", "kind", "complexity")).filter("kind = 'declaration'").select("file", "fn", F.col("complexity").cast("int").alias("complexity"))


DECISIONS = ", ".join(sql_text(d) for d in X.DECISIONS)


@query("x11_decision_points_text", f"""
SELECT doc_id, len(list_filter(regexp_extract_all(text, {sql_text(X.SOURCE_PATTERN)}), lambda t: t IN ({DECISIONS}))) + 1 AS complexity FROM documents""")
def x11_text(spark, sf):
    toks = F.regexp_extract_all("text", F.lit(X.SOURCE_PATTERN), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", X.count_decisions(toks).alias("complexity"))


@query("x12_max_nesting", V9 + """
SELECT file, w2 || id AS fn, 2 AS nesting FROM code UNION ALL SELECT file, w1 || 'Of', 0 FROM code UNION ALL SELECT file, 'map.cb', 0 FROM code
UNION ALL SELECT file, w1 || 'Of.cb2', 0 FROM code UNION ALL SELECT file, '<anonymous>', 0 FROM code
UNION ALL SELECT file, unnest(['constructor', 'make']), 0 FROM code WHERE p_size <= 25""")
def x12(spark, sf):
    return X.function_facts(modules(spark, sf), only=("fn", "nesting")).select("file", "fn", F.col("nesting").cast("int").alias("nesting"))


def _balance_sql(id_col: str, source: str, marks: str, opens: str, closes: str) -> str:
    return f"""SELECT {id_col} AS id, coalesce(max(b), 0) AS nesting FROM (SELECT {id_col}, sum(CASE m WHEN {opens} THEN 1 WHEN {closes} THEN -1 ELSE 0 END) OVER (PARTITION BY {id_col} ORDER BY i) AS b
  FROM (SELECT {id_col}, unnest({marks}) AS m, generate_subscripts({marks}, 1) AS i FROM {source})) GROUP BY 1"""


@query("x12_max_nesting_text", f"""
WITH p AS ({_balance_sql('doc_id', 'documents', "regexp_extract_all(text, '[()]')", "'('", "')'")}),
q AS ({_balance_sql('page_id', 'pages', "regexp_extract_all(html, '</?(?:div|ul|li|p|article|nav)')", "'<div'", "'</div'")})
SELECT 'document' AS kind, d.doc_id AS id, greatest(0, coalesce(p.nesting, 0))::BIGINT AS nesting FROM documents d LEFT JOIN p ON p.id = d.doc_id
UNION ALL SELECT 'page', d.page_id, greatest(0, coalesce(q.nesting, 0))::BIGINT FROM pages d LEFT JOIN q ON q.id = d.page_id""")
def x12_text(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), X.max_balance(
        F.regexp_extract_all("text", F.lit("[()]"), F.lit(0)), "(", ")").alias("nesting"))
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), X.max_balance(
        F.regexp_extract_all("html", F.lit("</?(?:div|ul|li|p|article|nav)"), F.lit(0)), "<div", "</div").alias("nesting"))
    return docs.unionByName(pages)


def _tags_sql(patterns) -> str:
    cases = ", ".join("CASE WHEN " + " OR ".join(f"contains(text, {sql_text(p)})" for p in ps) + f" THEN '{n}' END" for n, ps in patterns.items())
    return f"""
WITH f AS (SELECT 'page' AS kind, page_id AS id, html AS text FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT kind, id, concat_ws(',', {cases}) AS tags FROM f"""


def _tagged(spark, sf, patterns):
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return pages.unionByName(docs).select("kind", "id", F.array_join(X.tags(F.col("text"), patterns), ",").alias("tags"))


# Prose has no code, so the effect words of the stand-in are words and marks it does have.
TEXT_EFFECTS = {"io": ("http:", "track("), "network": ("www.", "@", "example.com"), "dom": ("<div", "document"), "async": ("then", "class=")}


@query("x13_effect_tags", _tags_sql({**X.EFFECT_PATTERNS, **{f"text_{k}": v for k, v in TEXT_EFFECTS.items()}}))
def x13(spark, sf):
    return _tagged(spark, sf, {**X.EFFECT_PATTERNS, **{f"text_{k}": v for k, v in TEXT_EFFECTS.items()}})


@query("x14_transform_tags", _tags_sql(X.TRANSFORM_PATTERNS))
def x14(spark, sf):
    return _tagged(spark, sf, X.TRANSFORM_PATTERNS)


@query("x13_function_effects", V9 + """
SELECT file, w2 || id AS fn, 'io' AS effects, 'arithmetic,comparison,conditional,iteration' AS transforms FROM code
UNION ALL SELECT file, w1 || 'Of', 'async', 'arithmetic' FROM code UNION ALL SELECT file, 'map.cb', '', 'arithmetic' FROM code
UNION ALL SELECT file, w1 || 'Of.cb2', '', '' FROM code UNION ALL SELECT file, '<anonymous>', '', '' FROM code
UNION ALL SELECT file, 'constructor', 'mutation', '' FROM code WHERE p_size <= 25 UNION ALL SELECT file, 'make', '', '' FROM code WHERE p_size <= 25""")
def x13_functions(spark, sf):
    facts = X.function_facts(modules(spark, sf), only=("fn", "effects", "transforms"))
    return facts.select("file", "fn", F.array_join("effects", ",").alias("effects"), F.array_join("transforms", ",").alias("transforms"))


@query("source_quality")
def source_quality(spark, sf):
    """From module texts to one scored line per file: facts, roles, links, scores."""
    # Links, roles and counts read the facts several times; the texts are scanned once.
    facts = cut_lineage(X.function_facts(modules(spark, sf)))
    run = A.analyse(R.function_features(facts), X.edges_of(facts))
    return Q.with_scores(run.facts).select("file", "n_nodes", "avg_complexity", "max_call_depth", "score")


# Modules of several shapes, chosen by the part's key. Of each: its text, its functions (name, calls, nesting, complexity) and its
# flows (writer, variable, readers). A shape without functions does not parse.
SHAPES = (
    ("function <w2><id>(x) { return `v ${<w1>F(x)} ${`in ${<w2>G(`${x}`)}`} it's`; }\n",
     [("<w2><id>", ["<w1>F", "<w2>G"], 0, 1)], []),
    ("const <w2><id> = s => /[(`${]/.test(s) && <w1>F(s);\n",
     [("<w2><id>", ["<w1>F", "Literal.test"], 0, 2)], []),
    ("const <w2><id> = x => x + <size>\n<w1>F()\nconst <w1>B = y =>\n  y\n  .trim()\n",
     [("<w2><id>", [], 0, 1), ("<w1>B", ["y.trim"], 0, 1)], []),
    ("function <w2><id>(a) {\n  if (a > 3) { <w1>F(); } else if (a > 2) { a.b.<w2>G(); } else if (a) { [a].map(<w1>F); }\n}\n",
     [("<w2><id>", ["<w1>F", "ArrayExpression.map", "MemberExpression.<w2>G"], 3, 4)], []),
    ("function <w2><id>(a) {\n  if (a) for (const b of a) if (b) <w1>F(b);\n  <w2>G()\n  if (a) { a[0].<w1>H() }\n}\n",
     [("<w2><id>", ["<w1>F", "<w2>G", "MemberExpression.<w1>H"], 3, 5)], []),
    ("const <w1>Box = { get <w2><id>() { return <w1>F(1); }, <w1>Open(k) { while (k) k = this.<w2>G(k); } };\n",
     [("<w2><id>", ["<w1>F"], 0, 1), ("<w1>Open", ["ThisExpression.<w2>G"], 1, 2)], []),
    ("let <w1>Sum = 0;\nfunction <w2><id>(x) { <w1>Sum = x; }\nfunction <w1>R(y) { return <w1>Sum + y; }\nfunction <w1>S() { <w1>Sum += 2; return <w1>R(1); }\n",
     [("<w2><id>", [], 0, 1), ("<w1>R", [], 0, 1), ("<w1>S", ["<w1>R"], 0, 1)],
     [("<w2><id>", "<w1>Sum", ["<w1>R", "<w1>S"]), ("<w1>S", "<w1>Sum", ["<w1>R", "<w2><id>"])]),
    ("function <w2><id>(a) {\n  try { switch (a) { case 1: <w1>F(); break; default: <w2>G().<w1>H(); } } catch (e) { throw e; }\n}\n",
     [("<w2><id>", ["<w1>F", "<w2>G", "CallExpression.<w1>H"], 2, 4)], []),
    ("function <w2><id>(a { return <w1>F(a); }\n", [], []),
)


def shaped_modules(spark, sf):
    # Dealt out by file before they are rendered, as tokens() asks for, so the texts themselves are not sent.
    part = dealt(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("file"), "p_partkey", "p_size", "p_name"), "file")
    cols = {"size": F.col("p_size").cast("string"), "id": F.col("p_partkey").cast("string"),
            "w1": F.split_part("p_name", F.lit(" "), F.lit(1)), "w2": F.split_part("p_name", F.lit(" "), F.lit(2))}
    fill = lambda template: F.concat(*[cols[t] if named else F.lit(t) for named, t in _pieces(template)])
    shape = F.element_at(F.array(*[fill(text) for text, _, _ in SHAPES]), (F.col("p_partkey") % len(SHAPES) + 1).cast("int"))
    return part.select("file", shape.alias("text"))


def _listed_sql(templates: list[str]) -> str:
    return f"array_to_string(list_sort([{', '.join(map(_fill_sql, templates))}]::VARCHAR[]), ',')"


def _by_shape(rows) -> str:
    """One SELECT for each row of each shape."""
    return " UNION ALL ".join(
        f"SELECT p_partkey::VARCHAR AS file, {select} FROM part WHERE p_partkey % {len(SHAPES)} = {k}"
        for k, shape in enumerate(SHAPES) for select in rows(shape))


def parsed_facts(spark, sf, *only):
    """Facts of the modules that parse. The place of a function in its file is not asked for, so its rows are not sorted by file."""
    return cut_lineage(X.function_facts(shaped_modules(spark, sf), only=only, parsed=True).drop("seq"))


@query("x9_facts_by_shape", _by_shape(lambda shape: [
    f"{_fill_sql(fn)} AS fn, {_listed_sql(calls)} AS calls, {nesting}::BIGINT AS nesting, {complexity}::BIGINT AS complexity"
    for fn, calls, nesting, complexity in shape[1]]))
def facts_by_shape(spark, sf):
    return parsed_facts(spark, sf, "fn", "complexity", "nesting", "calls").select("file", "fn", F.array_join("calls", ",").alias("calls"), "nesting", "complexity")


@query("s7_parse_errors_by_shape", _by_shape(lambda shape: [] if shape[1] else ["'parse_failed' AS error"]))
def errors_by_shape(spark, sf):
    return X.parse_errors(X.tokens(shaped_modules(spark, sf), only=X.READS["parse_errors"]))


@query("c12_flow_lists_source", _by_shape(lambda shape: [
    f"{_fill_sql(fn)} AS from_fn, {_fill_sql(variable)} AS variable, {len(to)}::BIGINT AS n_to, {_listed_sql(to)} AS \"to\"" for fn, variable, to in shape[2]]))
def flows_by_shape(spark, sf):
    return C.flow_lists(X.accesses_of(parsed_facts(spark, sf, "fn", "reads", "writes"))).select("file", "from_fn", "variable", "n_to", F.array_join("to", ",").alias("to"))


@query("q8_flow_isolated_source", _by_shape(lambda shape: [
    f"{_fill_sql(fn)} AS fn" for fn, calls, _, _ in shape[1] if not calls and not any(fn in to for _, _, to in shape[2])]))
def isolated_by_shape(spark, sf):
    facts = parsed_facts(spark, sf, "fn", "calls", "reads", "writes")
    return C.flow_isolated(facts.select("file", "fn", F.size("calls").alias("n_calls")), X.accesses_of(facts))
