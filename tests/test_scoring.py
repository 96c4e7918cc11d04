import math
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import duplicates as D
from quillgraph.operators import ensemble as M
from quillgraph.operators import scoring as P
from quillgraph.operators import training as T
from quillgraph.functions.text import djb2_fingerprint


def distribution(spark, rows):
    df = spark.createDataFrame(rows, "id string, logits array<double>")
    df = df.withColumn("classes", F.sequence(F.lit(0), F.size("logits") - 1))
    return P.top_1(P.entropy_ood(P.ranked(P.softmax(df))))


def test_softmax_rank_entropy(spark):
    rows = {r.id: r for r in distribution(spark, [("flat", [1.0, 1.0, 1.0, 1.0]), ("sure", [50.0, 0.0, 0.0, 0.0]), ("tie", [0.0, 9.0, 9.0, 0.0])]).collect()}
    assert rows["flat"].is_ood and rows["flat"].normalized_entropy == 1.0 and rows["flat"].confidence == 25.0
    assert not rows["sure"].is_ood and rows["sure"].class_id == 0 and rows["sure"].confidence == 100.0
    assert rows["tie"].class_id == 1
    top = P.top_k(distribution(spark, [("long", [float(i) for i in range(20)])]), "id", 50).collect()
    assert len(top) == P.MAX_TOP_K and [r.rank for r in top] == list(range(1, 11))


def plain_state(vector, centers):
    scores = {c: sum(a * b for a, b in zip(vector, center)) + bias for c, center, bias in centers}
    peak = max(scores.values())
    mass = sum(math.exp(x - peak) for x in scores.values())
    probs = {c: math.exp(x - peak) / mass for c, x in scores.items()}
    return scores, probs, -sum(p * math.log(p) for p in probs.values() if p > 1e-12)


@pytest.mark.parametrize("per_block", [1, 7, 50, 1000])
def test_blocks_of_any_size_give_one_state(spark, per_block):
    dice = random.Random(5)
    vectors = [(i, dice.randrange(50), [dice.gauss(0, 3) for _ in range(4)]) for i in range(30)]
    classes = [(c, [dice.gauss(0, 3) for _ in range(4)], dice.gauss(0, 1)) for c in range(50)]
    items = spark.createDataFrame(vectors, "id int, label int, v array<double>").repartition(3)
    centers = spark.createDataFrame(classes, "class_id int, center array<double>, bias double")
    rows = P.top_1(P.state_entropy(P.score_states(items, centers, "id", "v", "dot", 1.0, "label", per_block))).collect()
    assert len(rows) == 30
    for r in rows:
        scores, probs, h = plain_state(vectors[r.id][2], classes)
        order = sorted(probs, key=lambda c: (-scores[c], c))[:P.MAX_TOP_K]
        assert r.n_classes == 50 and [b.class_id for b in r.ranking] == order and r.class_id == order[0]
        assert all(abs(-b.neg - probs[b.class_id]) < 1e-12 for b in r.ranking)
        assert abs(r.entropy - h) < 6e-5 and abs(r.target - scores[r.label]) < 1e-9
    long = P.linear_scores(items, centers, "id", "v", "dot", 1.0, per_block)
    probs = P.probabilities(long, P.score_states(items, centers, "id", "v", "dot", 1.0, per_block=per_block), "id").collect()
    assert len(probs) == 30 * 50
    assert all(abs(r.prob - plain_state(vectors[r.id][2], classes)[1][r.class_id]) < 1e-12 for r in probs[:200])


def test_states_without_items_or_label(spark):
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "class_id int, center array<double>")
    items = spark.createDataFrame([(1, [1000.0, -1000.0], None)], "id int, v array<double>, label int")
    row = P.state_entropy(P.score_states(items, centers, "id", "v", "dot", 1.0, "label", 1)).first()
    assert row.target is None and row.entropy == 0.0 and not row.is_ood and [b.neg for b in row.ranking] == [-1.0, 0.0]
    assert P.score_states(items.filter("false"), centers, "id", "v").count() == 0
    assert P.score_states(items, centers.filter("false"), "id", "v").count() == 0


def test_duplicates(spark):
    scored = spark.createDataFrame(
        [("a", 1, 70.0, False), ("b", 1, 90.0, False), ("c", 1, 69.99, False), ("d", 2, 99.0, False), ("e", 1, 95.0, True), ("f", None, 0.0, None)],
        "name string, class_id int, confidence double, is_ood boolean")
    assert {r.name for r in D.duplicate_groups(scored, "name").collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        D.require_two(scored.limit(1))
    named = D.name_inputs(spark.createDataFrame([(None, 1), ("x", 2)], "name string, seq int"))
    assert {r.name for r in named.collect()} == {"function_1", "x"}


def test_merge(spark):
    rows = [(1, "m", 0, 1, "A", 80.0, None), (1, "m", 0, 2, "B", 10.0, None), (1, "n", 1, 1, "A", 60.0, None), (1, "n", 1, 2, "A", 60.0, None),
            (1, "o", 2, None, None, None, "down"), (2, "m", 0, None, None, None, "down"), (2, "n", 1, 1, "C", 50.0, None)]
    df = spark.createDataFrame(rows, "item int, engine string, engine_order int, rank int, class_id string, confidence double, error string")
    union = {(r.item, r.class_id): (r.votes, r.avg_confidence, r.rank) for r in M.engine_union(df).collect()}
    assert union == {(1, "A"): (2, 70.0, 1), (1, "B"): (1, 10.0, 2), (2, "C"): (1, 50.0, 1)}
    assert {(r.item, r.class_id) for r in M.engine_intersection(df).collect()} == {(1, "A"), (2, "C")}
    assert {(r.item, r.engine, r.class_id) for r in M.engine_first(df).collect()} == {(1, "m", "A"), (1, "m", "B"), (2, "n", "C")}


def test_fingerprint(spark):
    assert spark.range(1).select(djb2_fingerprint(F.lit("64:4:4:128:117:128"))).first()[0] == "6f3b942a"


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 137])
def test_split_is_exact(spark, n):
    rows = T.split_train_val(spark.range(n).select(F.col("id").alias("k")), "k", "s").collect()
    assert len(rows) == n and sum(r.is_train for r in rows) == int(0.9 * n)


def test_early_stop(spark):
    improving = [("up", e, e / 100) for e in range(1, 21)]
    flat = [("flat", e, 0.5) for e in range(1, 21)]
    tracked = T.best_and_patience(spark.createDataFrame(improving + flat, "run string, epoch int, val double"))
    stops = {r.run: r.stop_epoch for r in T.early_stop(tracked, 20, patience=3).collect()}
    assert stops == {"flat": 7}


def test_core_paths_stay_in_the_jvm(spark):
    from __spark_entry__ import queries

    for name in ("p3_top_k", "x13_effect_tags", "r2_role_priority", "c3_fan_in_out", "c12_variable_flows", "m1_engine_union"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan, name
