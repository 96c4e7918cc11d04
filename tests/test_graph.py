"""Graph operators against brute force on small graphs with cycles, stars, loops and lone nodes."""

import random

import pytest

from quillgraph.operators import graph as C


def random_files(seed):
    rng = random.Random(seed)
    nodes, edges = [], []
    for f in range(6):
        n = rng.randint(1, 7)
        names = [f"n{i}" for i in range(n)]
        nodes += [(f"f{f}", x) for x in names]
        pairs = {(a, b) for a in names for b in names + ["outside"] if rng.random() < 0.28}
        edges += [(f"f{f}", a, b) for a, b in sorted(pairs)]
    return nodes, edges


def frames(spark, nodes, edges):
    n = spark.createDataFrame(nodes, "file string, fn string")
    e = spark.createDataFrame(edges, "file string, from_fn string, to_fn string")
    return n, C.call_edges(e, n)


def adjacency(nodes, edges, file):
    names = [x for f, x in nodes if f == file]
    return names, {a: sorted(b for f, x, b in edges if f == file and x == a and b in names) for a in names}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_depth_chains_clusters(spark, seed):
    nodes, edges = random_files(seed)
    n, classified = frames(spark, nodes, edges)
    linked = C.with_links(n, classified)
    depth = {r.file: r.max_call_depth for r in C.max_call_depth(linked, classified).collect()}
    chains = {(r.file, tuple(r.chain)) for r in C.transform_chains(classified, n=None).collect()}
    members = {(r.file, r.start_fn, r.member) for r in C.clusters(n, classified).collect()}
    want_depth, want_chains, want_members = {}, set(), set()
    for file in {f for f, _ in nodes}:
        names, adj = adjacency(nodes, edges, file)
        entered = {b for a in names for b in adj[a]}

        def longest(at, seen):
            return max([1 + longest(b, seen | {b}) for b in adj[at] if b not in seen], default=0)

        want_depth[file] = max([longest(r, {r}) for r in names if r not in entered and adj[r]], default=0)
        for a in names:
            for b in adj[a]:
                chain, at = [a], b
                while at is not None and at not in chain:
                    chain.append(at)
                    at = adj[at][0] if adj[at] else None
                if len(chain) >= 3:
                    want_chains.add((file, tuple(chain)))
        assigned = set()
        for start in names:
            if start in assigned:
                continue
            group, queue = set(), [start]
            while queue:
                at = queue.pop()
                if at not in group:
                    group.add(at)
                    queue += adj[at]
            if len(group) >= 2:
                assigned |= group
                want_members |= {(file, start, m) for m in group}
    assert depth == want_depth
    assert chains == want_chains
    assert members == want_members


def test_link_counts_and_hubs(spark):
    nodes = [("f", x) for x in ("a", "b", "c", "d", "alone")]
    edges = [("f", x, "a") for x in ("b", "c", "d")] + [("f", "a", "a"), ("f", "b", "log")]
    n, classified = frames(spark, nodes, edges)
    rows = {r.fn: r for r in C.with_links(n, classified).collect()}
    assert (rows["a"].fan_in, rows["a"].fan_out, rows["a"].n_self) == (4, 1, 1)
    assert rows["b"].n_external == 1
    linked = C.with_links(n, classified)
    assert C.hubs(linked).orderBy("rank").first().fn == "a"
    assert [r.fn for r in C.isolated_nodes(linked).collect()] == ["alone"]
    assert {r.fn for r in C.roots(linked).collect()} == {"b", "c", "d"}


def test_flows_equal_pairs(spark):
    rng = random.Random(5)
    acc = {("f%d" % rng.randint(0, 2), rng.randint(0, 5), rng.randint(0, 3), rng.random() < 0.4) for _ in range(60)}
    df = spark.createDataFrame(sorted(acc), "file string, fn int, variable int, is_write boolean")
    pairs = {(f, a, v, b) for f, a, v, w in acc if w for g, b, u, x in acc if (g, u) == (f, v) and not x and a != b}
    heads = {(r.file, r.from_fn, r.variable): r.n_to for r in C.variable_flows(df).collect()}
    tails = {(r.file, r.variable, r.to_fn): r.n_from for r in C.flow_consumers(df).collect()}
    assert heads == {k: len({p for p in pairs if (p[0], p[1], p[2]) == k}) for k in {(p[0], p[1], p[2]) for p in pairs}}
    assert tails == {k: len({p for p in pairs if (p[0], p[2], p[3]) == k}) for k in {(p[0], p[2], p[3]) for p in pairs}}


def test_rounds_send_no_table_through_the_driver(spark, monkeypatch):
    plans, cut = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    names = [f"f{k}" for k in range(6)]
    nodes = spark.createDataFrame([("a", n) for n in names], "file string, fn string")
    edges = spark.createDataFrame([("a", x, y) for x, y in zip(names, names[1:])] + [("a", "f5", "f4")], "file string, from_fn string, to_fn string")
    classified = cut(C.call_edges(edges, nodes))
    linked = cut(C.with_links(nodes, classified))
    assert {(r.start_fn, r.member) for r in C.clusters(nodes, classified).collect()} == {("f0", n) for n in names}
    assert C.max_call_depth(linked, classified).first().max_call_depth == 5
    assert C.transform_chains(classified).count() > 0
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]
