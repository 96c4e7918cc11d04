import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.sources import corpus as S
from quillgraph.sources import sinks
from quillgraph.streaming.incremental import current_facts, process_arrivals
from quillgraph.streaming.quota import admit_sorted, anchored_quota, use_state_store


def test_read_corpus(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.js").write_text("let a = 1;\nlet b = 2;\n")
    (tmp_path / "two.txt").write_text("x")
    rows = S.read_corpus(spark, str(tmp_path), "*.js").collect()
    assert [(r.text, r.size) for r in rows] == [("let a = 1;\nlet b = 2;\n", 22)]
    assert S.read_corpus(spark, str(tmp_path / "missing")).count() == 0


def test_filter_corpus(spark):
    paths = [("src/a.js", 10), ("src/B.TSX", 10), ("src/c.py", 10), ("dist/a.js", 10), ("src/a.min.js", 10), ("src/a.test.js", 10), ("src/.js", 10),
             ("src/big.js", 200_000), ("src/edge.mjs", 199_999)]
    kept = S.filter_corpus(spark.createDataFrame(paths, "path string, size long"))
    assert {r.path for r in kept.collect()} == {"src/a.js", "src/B.TSX", "src/edge.mjs"}


def test_urls_and_admission(spark):
    urls = spark.createDataFrame([("https://github.com/o/r/tree/dev",), ("o/r",), ("https://github.com/only",)], "url string")
    got = {r.url: (r.owner, r.repo, r.branch, r.reason) for r in S.parse_repo_url(urls, "url").collect()}
    assert got == {"https://github.com/o/r/tree/dev": ("o", "r", "dev", None), "o/r": ("o", "r", "HEAD", None),
                   "https://github.com/only": (None, None, None, "invalid_repo_url")}
    raw = spark.range(1).select(S.canonical_raw_url(F.lit("https://github.com/o/r/blob/main/blob/x.js"))).first()[0]
    assert raw == "https://raw.githubusercontent.com/o/r/main/blob/x.js"
    good, bad = S.admit(spark.createDataFrame([("ok",), ("",), (None,), ("x" * 9,)], "text string"), max_chars=8)
    assert good.count() == 1 and {r.reject_reason for r in bad.collect()} == {"missing_source", "too_long"}


def test_write_dataset(spark, tmp_path):
    samples = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "y", 3)], "label string, category string, v int")
    sinks.write_dataset(samples, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "samples")).filter("label = 'a'").count() == 2
    manifest = json.loads(spark.read.text(str(tmp_path / "manifest")).first()[0])
    assert manifest["n_samples"] == 3 and manifest["label_index"] == ["a", "b"] and manifest["vocab_size"] == 117


def walk(times, window, limit):
    """The quota one event at a time."""
    out, count, reset = [], 0, -1
    for t in times:
        if reset < 0 or t > reset:
            count, reset = 1, t + window
            out.append(True)
        elif count >= limit:
            out.append(False)
        else:
            count += 1
            out.append(True)
    return out


def test_quota_against_a_walk():
    rng = np.random.default_rng(3)
    for _ in range(200):
        times = np.sort(rng.integers(0, 60, rng.integers(1, 40)))
        window, limit = int(rng.integers(1, 15)), int(rng.integers(1, 5))
        cut = int(rng.integers(0, len(times) + 1))
        a, _, count, reset = admit_sorted(times[:cut], 0, -1, window, limit)
        b, _, _, _ = admit_sorted(times[cut:], count, reset, window, limit)
        assert list(a) + list(b) == walk(times, window, limit)


def test_quota_edges():
    allowed, counts, count, reset = admit_sorted(np.array([0, 5, 10, 10, 11]), 0, -1, 10, 3)
    assert list(allowed) == [True, True, True, False, True] and list(counts) == [1, 2, 3, 3, 1] and (count, reset) == (1, 21)


def test_stream_equals_batch(spark, tmp_path):
    use_state_store(spark)
    start = dt.datetime(2024, 1, 1)
    # One key falls silent at once, the others stay busy past every watermark.
    rows = [("quiet" if i == 0 else f"k{i % 3}", i, start + dt.timedelta(seconds=7 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp")
    # Three arrivals in time order.
    for n in range(3):
        df.filter((F.col("event_id") >= n * 20) & (F.col("event_id") < n * 20 + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {(r.key, r.event_id): r.allowed for r in anchored_quota(df, 60_000, 2).filter("kind = 'verdict'").collect()}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = anchored_quota(stream, 60_000, 2)
    run = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.key, r.event_id): r.allowed for r in got if r.kind == "verdict"} == batch
    assert any(not v for v in batch.values())
    closed = {(r.key, r.ts, r.n_in_window) for r in anchored_quota(df, 60_000, 2).filter("kind = 'closed'").collect()}
    assert {(r.key, r.ts, r.n_in_window) for r in got if r.kind == "closed"} == closed and closed
    # The silent key's window is over too: a timer reports it, and it has no state left.
    end = start + dt.timedelta(seconds=60)
    assert ("quiet", end, 1) in closed
    last = start + dt.timedelta(seconds=7 * 59)
    assert all(t < last for _, t, _ in closed)
    state = spark.read.format("statestore").option("stateVarName", "slot").load(str(tmp_path / "cp"))
    held = {r["key"]["key"] for r in state.collect()}
    assert "quiet" not in held and held <= {"k0", "k1", "k2"}


def test_no_event_is_lost_in_any_order_of_arrival(spark, tmp_path):
    use_state_store(spark)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", i, start + dt.timedelta(seconds=7 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp")
    for n in (3, 0, 4, 1, 2):
        df.filter(F.col("event_id") % 5 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = anchored_quota(stream, 60_000, 2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    got = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.kind in ("verdict", "late")]
    assert sorted(r.event_id for r in got) == list(range(60))
    assert {r.kind for r in got} == {"verdict", "late"}


def test_incremental_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", i % 3) for i in range(30)], "id int, text string, v int")
    docs.repartition(6, "id").write.parquet(str(tmp_path / "in"))
    facts = lambda batch: batch.select("id", F.length("text").alias("n"))
    steps = process_arrivals(spark, str(tmp_path / "in"), docs.schema, facts, str(tmp_path / "facts"), str(tmp_path / "cp"), bytes_per_step="3k")
    steps = {r.step: r.rows for r in steps.collect()}
    assert len(steps) >= 2 and sum(steps.values()) == 30
    now = {r.id: r.n for r in current_facts(spark, str(tmp_path / "facts"), "id").collect()}
    assert now == {i: len(f"text {i}") for i in range(30)}
    # A file that comes again replaces its rows.
    docs.filter("id = 5").withColumn("text", F.lit("longer text now")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    process_arrivals(spark, str(tmp_path / "in"), docs.schema, facts, str(tmp_path / "facts"), str(tmp_path / "cp"), bytes_per_step="3k")
    again = {r.id: r.n for r in current_facts(spark, str(tmp_path / "facts"), "id").collect()}
    assert again == {**now, 5: len("longer text now")}


def test_arrivals_are_written_by_as_many_tasks_as_the_session_has(spark, tmp_path, monkeypatch):
    """No task of w3_incremental_corpus takes a fixed quarter of the corpus."""
    from quillgraph.plans import streaming_queries as S

    docs = [(i, "en", f"s{i % 2}", f"line {i}\nend", 10) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(S, "_scratch", lambda session: f"{tmp_path}/scratch")
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "9")
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = S.w3(own, str(tmp_path)).orderBy("repo").collect()
    assert [tuple(r) for r in rows] == [("s0", 100, 1000, 200), ("s1", 100, 1000, 200)]
    assert len(list((tmp_path / "scratch" / "in").glob("*.parquet"))) == 18


def test_a_key_costs_one_frame_and_no_needless_state():
    """Late and decided rows and ended windows of a frame come as one; a timer is set when the end of the window moves only."""
    import pandas as pd

    from quillgraph.streaming.quota import QuotaProcessor

    asked = []

    class Slot:
        held = None
        get = lambda self: asked.append("get") or self.held

        def update(self, value):
            asked.append("update")
            self.held = value

    class Handle:
        getValueState = lambda self, *_: Slot()
        registerTimer = lambda self, ms: asked.append(ms)

    class Times:
        getCurrentWatermarkInMs = lambda self: 0

    def rows(*events):
        return iter([pd.DataFrame({"key": "k", "event_id": [e for e, _ in events], "ts": pd.to_datetime([t for _, t in events], unit="s")})])

    run = QuotaProcessor(60_000_000, 2, None)
    run.init(Handle())
    first = list(run.handleInputRows(("k",), rows((1, 10), (2, 20), (3, 100)), Times()))
    assert len(first) == 1 and [*first[0].kind] == ["verdict"] * 3 + ["closed"] and [*first[0].n_in_window] == [1, 2, 1, 2]
    assert asked == ["get", "update", 160_001]
    asked.clear()
    second = list(run.handleInputRows(("k",), rows((4, 110), (5, 50)), Times()))
    assert len(second) == 1 and [*second[0].kind] == ["late", "verdict"] and [*second[0].event_id] == [5, 4]
    assert asked == ["get", "update"]


def test_listing_is_bounded_and_the_setting_stays(spark, tmp_path):
    from quillgraph.sources import corpus as S

    for k in range(40):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "a.txt").write_text(str(k))
    spark.conf.set(S.LISTING_TASKS, "5000")
    assert S.read_corpus(spark, str(tmp_path), "*.txt").count() == 40
    assert spark.conf.get(S.LISTING_TASKS) == "5000"
    spark.conf.unset(S.LISTING_TASKS)
