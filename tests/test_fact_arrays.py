"""Facts from arrays of tokens: one exchange of texts, and places that a brute-force reading confirms."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quillgraph.functions.brackets import FIELDS, PLACES, placed, placed_batches, placed_rows
from quillgraph.operators import facts as X
from quillgraph.plans import code_queries as Q


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_neither_exchanged_nor_written(spark):
    files = spark.createDataFrame([("a", "export default function f(x) { return g(x); }")], "file string, text string")
    plan = plan_of(X.exports(X.tokens(files)))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan
    assert "Join" not in plan_of(X.function_facts(files))
    assert [tuple(r) for r in X.exports(X.tokens(files)).select("name", "kind").collect()] == [("f", "default")]


def test_places_of_brackets():
    random.seed(3)
    for _ in range(300):
        raws = [random.choice(["{", "}", "(", ")", "[", "]", ",", " x", ";", "\n", " if", "// z"]) for _ in range(30)]
        known = dict(zip(FIELDS, placed(raws)))
        toks, depth, levels = [r.strip(" ") for r in raws if r != "\n" and r != "// z"], 0, []
        for t in toks:
            depth += t in "{(["
            levels.append(depth)
            depth -= t in "})]"
        assert known["tok"] == toks and known["level"] == levels
        for i, t in enumerate(toks):
            opens = [j for j in range(i + 1) if toks[j] in "{([" and levels[j] == levels[i]]
            assert known["encl"][i] == (opens[-1] + 1 if opens else None)
            if t in "{([":
                after = [j for j in range(i + 1, len(toks)) if toks[j] in "{}()[]" and levels[j] == levels[i]]
                assert known["pair"][i] == (after[0] + 1 if after else None)
            ends = [j for j in range(i + 1, len(toks)) if levels[j] == levels[i] and (toks[j] in (",", ";", "}", ")", "]", "if") or known["new_statement"][j])]
            assert known["term_idx"][i] == (ends[0] + 1 if ends else None)


def test_rows_of_one_file_name_are_read_in_turn(spark):
    files = spark.createDataFrame([("a", "let x = 1;"), ("a", "let x = 1;"), ("b", None), (None, "let y = 2;")], "file string, text string")
    row = X.tokens(files).filter("file = 'a'").select(F.col("_tok")).first()
    assert row[0] == ["let", "let", "x", "x", "=", "=", "1", "1", ";", ";"]
    assert {r.file for r in X.tokens(files).collect()} == {"a", None}


def test_rows_of_a_batch_do_not_touch():
    random.seed(4)
    words = ["{", "}", "(", ")", ",", " x", ";", "\n", " if", "else", "class", "// z", "let", "`t`", "=", "function"]
    rows = [[random.choice(words) for _ in range(random.choice([0, 1, 40]))] for _ in range(60)]
    got = placed_rows(pa.array([[r] for r in rows], pa.list_(pa.list_(pa.string()))))
    for k, raws in enumerate(rows):
        known = {f: got[f][k].as_py() for f in got}
        assert tuple(known[f] for f in FIELDS) == placed(raws)
        after = [*known["tok"][1:], None]
        assert known["sites"] == [i + 1 for i, t in enumerate(after) if t == "("]
        assert known["words"] == [i + 1 for i, t in enumerate(known["tok"]) if t[0].isalpha()]
        assert known["n_words"] == [sum(w <= i + 1 for w in known["words"]) for i in range(len(known["tok"]))]


def test_named_facts_alone_are_worked_out(spark):
    files = spark.createDataFrame([("a", "function f(x) { if (x) { let y = g(x); } }\nconst h = async (z) => { await f(z); };")], "file string, text string")
    every = {r.fn: r for r in X.function_facts(files).collect()}
    for only in (("fn", "calls"), ("fn", "params", "nesting", "writes", "effects")):
        few = X.function_facts(files, only=only)
        assert few.columns == ["file", "seq", *[c for c in X.FACTS if c in only]]
        assert {r.fn: r.asDict() for r in few.collect()} == {fn: {c: r[c] for c in few.columns} for fn, r in every.items()}
    plan = plan_of(X.function_facts(files, only=("fn", "calls")).select("file", "calls"))
    assert "_open_before" not in plan and "console." not in plan and "Window" not in plan


def test_rows_of_a_file_meet_across_batches():
    rows = [("a", ["x"])] * 3 + [("b", [" y"])] * 450 + [("c", None), (None, ["z"]), (None, ["w"])]
    kind = pa.schema([("file", pa.string()), ("raws", pa.list_(pa.string()))])
    batch = pa.RecordBatch.from_pylist([{"file": f, "raws": r} for f, r in rows], kind)
    for cut in (1, 3, 250, 453, 455):
        got = [r for b in placed_batches(iter([batch.slice(0, cut), batch.slice(cut)]), ("tok",)) for r in b.to_pylist()]
        assert [(r["file"], r["n_texts"], r["_tok"]) for r in got] == [
            ("a", 3, ["x"] * 3), ("b", 450, ["y"] * 450), ("c", 1, []), (None, 2, ["z", "w"])]


def test_named_fields_are_those_of_all():
    raws = pa.array([[["function", " f", "(", "x", ")", "{", "if", "(", "x", ")", "\n", "y", "=", "`t`", ";", "}"]], []], pa.list_(pa.list_(pa.string())))
    every = placed_rows(raws)
    assert list(every) == [*FIELDS, *PLACES]
    for f in every:
        assert placed_rows(raws, (f,)) == {f: every[f]}


def test_texts_are_scanned_once_by_many_tasks(spark):
    shaped = Q.shaped_modules(spark, "/root/testdata/sf0.001")
    plan = plan_of(X.function_facts(shaped, only=("fn", "reads"), parsed=True))
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and "Aggregate" not in plan and "Union" not in plan
    assert X.tokens(shaped, only=()).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_what_an_operator_reads_is_enough(spark):
    files = spark.createDataFrame([
        ("a", "import b from 'c'; export default function f(x, y) { if (x) { let q = g(`v ${x}`); a.b = [1].map(k => k); } throw y; }"),
        ("b", "class P extends Q { static m() { return new R(); } }\nlet u = 1, v = 2;\n(function () { f(); })(); export { u, v };"),
        ("b", "let w = 3;"), ("c", "f("), ("d", None)], "file string, text string")
    for name, read in X.READS.items():
        # A field that is not there fails when the plan is made.
        assert "file" in getattr(X, name)(X.tokens(files, only=read)).columns
    fns = sorted((r.file, r.fn) for r in X.function_facts(files, only=("fn",), parsed=True).collect())
    assert [f for f in fns if f[0] == "b"] == [("b", "<anonymous>")] * 2 + [("b", "m")] * 2 and {f[0] for f in fns} == {"a", "b"}


def test_places_are_narrow_and_lose_nothing():
    random.seed(5)
    words = ["{", "}", "(", ")", ",", " x", ";", "if", "for", "else", "let", "=", "+=", "function", "=>", ".", "of", "async"]
    rows = [[random.choice(words) for _ in range(random.choice([0, 1, 60]))] for _ in range(80)]
    got = placed_rows(pa.array([[r] for r in rows], pa.list_(pa.list_(pa.string()))))
    for k, raws in enumerate(rows):
        known = {f: got[f][k].as_py() for f in got}
        tok, pair = ["", *known["tok"], ""], [None, *known["pair"], None]
        each = range(1, len(tok) - 1)
        goes_on = lambda i: pair[i + 1] is not None and tok[pair[i + 1]] == ")" and tok[pair[i + 1] + 1] == "{"
        assert known["starts"] == [i for i in each if tok[i] in ("function", "=>") or (tok[i][0].isalpha() and tok[i + 1] == "(" and goes_on(i))]
        assert known["blocks"] == [i for i in each if (tok[i] == "{" and tok[i - 1] in (")", "else", "=>")) or (tok[i] in ("if", "for") and tok[i + 1] == "(")]
        names = [i for i in each if tok[i][0].isalpha() and tok[i - 1] != "." and (tok[i] == "x" or tok[i + 1] == "(")]
        assert known["names"] == names and known["n_names"] == [sum(n <= i for n in names) for i in each]
        assert known["targets"] == [i for i in names if tok[i + 1] in ("=", "+=") or tok[i - 1] == "let" or (tok[i - 1] == "," and known["declares"][i - 1])]
        assert known["declared"] == [i for i in each if tok[i][0].isalpha() and known["level"][i - 1] == 0 and tok[i - 1] in ("let", ",")]
        assert [w and tok[w] for w in known["word_idx"]] == known["word"]


def test_functions_are_rows_before_they_are_measured(spark):
    files = spark.createDataFrame([("a", "class C { m() { return [1].map(x => f(x)); } }\nconst o = { g() { if (o) { h(); } }, k: function () {} };")], "file string, text string")
    assert "explode(_starts" in plan_of(X.function_facts(files, only=("fn", "nesting"))) and "explode(_declared" in plan_of(X.globals_of(X.tokens(files)))
    got = {r.fn: (r.nesting, r.calls, r.reads) for r in X.function_facts(files).collect()}
    assert got == {
        "m": (1, ["ArrayExpression.map", "f"], ["f", "x"]), "map.cb": (0, ["f"], ["f", "x"]), "g": (1, ["h"], ["h", "o"]), "k": (0, [], [])}
    assert [tuple(r) for r in X.globals_of(X.tokens(files)).collect()] == [("a", "o", "const")]


def test_parsed_facts_are_not_sorted_by_file(spark, monkeypatch):
    plans, cut = [], Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df: plans.append(plan_of(df)) or cut(df))
    got = Q.parsed_facts(spark, "/root/testdata/sf0.001", "fn", "reads")
    assert got.columns == ["file", "fn", "reads"] and got.count() > 0
    assert plans[0].count("Exchange hashpartitioning") == 1 and "Window" not in plans[0]
