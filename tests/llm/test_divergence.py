"""Source divergence beside a plain version, with digests of a few bits so that most terms collide."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import quillgraph.llm.divergence as divergence
from quillgraph.llm.divergence import SMOOTHING, UNIT, _digests, _Digests, kept_terms, op13_divergence, share, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, digest long, part string, p long, item string"


def some_rows():
    dice = random.Random(11)
    terms = ["".join(dice.choice("abcdeé漢") for _ in range(dice.randrange(1, 5))) for _ in range(60)]
    rows = []
    for i in range(160):
        lang, source = dice.choice(["en", "en", "fr", None, ""]), dice.choice(["s1", "s2", "s3", None, "é", "Z"])
        words = [dice.choice(terms[:8] if source == "s1" else terms) for _ in range(dice.randrange(0, 40))]
        rows.append((i % 120, dice.choice([" ", ", ", "\n9"]).join(w.upper() if dice.random() < 0.1 else w for w in words), lang, source))
    return rows + [(1, None, "en", "s1"), (None, "", "en", "lone"), (2, "x9x X", "de", "only"), (3, "a " * 30_000, "fr", "s1")]


def plain_report(rows, least, most):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))
            for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in df if df[t] >= least]
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if df[t] >= least)
        total = sum(counts.values(), Counter())
        p = {s: {t: 1 + UNIT * (c[t] + SMOOTHING) // (sum(c.values()) + SMOOTHING * len(kept)) for t in kept} for s, c in counts.items()}
        q = {t: 1 + UNIT * (total[t] + SMOOTHING) // (sum(total.values()) + SMOOTHING * len(kept)) for t in kept}
        for s, c in counts.items():
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if c[t] and p[s][t] > q[t]]
            for part, items, last in (("pair", pairs, None), ("term", terms, most)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:last], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, "i") for r in rows], SCHEMA).repartition(3)


def report(docs, **kw):
    return [tuple(r) for r in source_divergence(docs, **kw).collect()]


@pytest.mark.parametrize("bits, least, most", [(64, 4, 5), (3, 4, 50), (1, 9, 3), (64, 1000, 5)])
def test_report_is_the_plain_one(spark, bits, least, most):
    rows = some_rows()
    got = report(frame(spark, rows), least_docs=least, most=most, digest_bits=bits)
    assert len(got) == len(set(got)) and set(got) == plain_report(rows, least, most)


def test_tiles_and_blocks_of_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 7)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    rows = some_rows()
    assert set(report(frame(spark, rows), least_docs=3, most=50)) == plain_report(rows, 3, 50)


def test_empty_and_lone_groups(spark):
    assert report(frame(spark, [])) == []
    assert report(frame(spark, [(1, "a b", "en", "s")]), least_docs=1) == []
    got = report(frame(spark, [(1, None, "en", "s"), (1, None, "en", None)]))
    assert sorted(got) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, terms = 3 * 10**14 + 7, 10**15 + 1, 10**8
    got = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long").select(share("n", "total", "terms")).first()[0]
    assert got == 1 + UNIT * (n + SMOOTHING) // (total + SMOOTHING * terms)


def test_query_columns(spark):
    out = op13_divergence(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert out.filter(F.col("part") == "pair").count() > 0


def test_a_term_is_digested_once_in_a_while(monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    digests = _Digests(0xFF)
    for terms in ([b"a", b"b", b"a"], [b"b", b"c", b"d"], [b"e", b"a"], []):
        assert digests.of(terms).tolist() == _digests(terms, 0xFF).tolist()
        assert len(digests) <= 3 + len(terms)


def test_counts_are_summed_before_they_are_joined(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(divergence, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    kept_terms(frame(spark, some_rows()).select("lang", "source", "text").na.fill(""), 4)
    counts = next(p for p in plans if "sum(n" in p and "source" in p)
    assert counts.index("LeftSemi") < counts.index("Aggregate [lang")
