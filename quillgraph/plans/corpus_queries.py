"""Corpus preparation, encoding and training-set queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph.functions.text import WORD_PATTERN, djb2_fingerprint
from quillgraph.functions.vocabulary import SOURCE_PATTERN, TOKEN_ID, VOCABULARY, encoding_table
from quillgraph.operators import encoding as E
from quillgraph.operators import training as T
from quillgraph.plans.registry import query
from quillgraph.session import shared_dir, table
from quillgraph.sources import corpus as S
from quillgraph.sources import sinks
from quillgraph.sources.catalogue import with_catalogue
from quillgraph.functions.vectors import total

DIM = 64


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def corpus(spark, sf):
    """Documents as a corpus: repo, path, text, size."""
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("repo"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        "text", F.col("n_chars").alias("size"), "lang")


V1 = """WITH v AS (SELECT doc_id, source AS repo, source || '/' || doc_id || '.' || lang AS path, text, n_chars AS size, lang FROM documents)"""


@query("s1_read_corpus", """
SELECT source || '/' || doc_id || '.' || lang AS path, length(text) AS size, md5(text) AS digest FROM documents
UNION ALL SELECT url, length(html), md5(html) FROM pages""")
def s1(spark, sf):
    docs = corpus(spark, sf).select("path", "text")
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("text"))
    return docs.unionByName(pages).select(
        "path", F.length("text").cast("long").alias("size"), F.md5("text").alias("digest"))


@query("s1_read_corpus_files", """
SELECT source AS repo, doc_id // 200 AS span, strlen(string_agg(text, chr(10) ORDER BY doc_id)) + 1 AS size, md5(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS digest
FROM documents GROUP BY 1, 2""")
def s1_files(spark, sf):
    """The documents as source files in the shared folder, read back as a corpus; a file holds the texts of a run of 200 ids."""
    folder = f"{shared_dir(spark)}/quillgraph/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").select(F.col("source").alias("repo"), F.expr("doc_id div 200").alias("span"), "doc_id", "text")
    rows.repartition("repo", "span").sortWithinPartitions("repo", "span", "doc_id").select("repo", "span", "text").write.partitionBy("repo", "span").option(
        # Tasks put their files in place; with version 1 the driver renames every one of them in turn.
        "mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    return S.read_corpus(spark, folder, "*.txt").select(
        part("repo=([^/]*)/").alias("repo"), part("span=([0-9]+)/").cast("long").alias("span"), F.col("size").cast("long").alias("size"), F.md5("text").alias("digest"))


@query("s2_filter_corpus", V1 + """
SELECT path, size FROM v WHERE lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) IN ('.en', '.fr')
  AND NOT contains(path, 'src13') AND NOT contains(path, '.es') AND size < 5000""")
def s2(spark, sf):
    kept = S.filter_corpus(corpus(spark, sf), extensions=(".en", ".fr"), skip=("src13", ".es"), max_size=5000)
    return kept.select("path", "size")


@query("s3_limit_corpus", V1 + """
SELECT repo, path FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS i FROM v) WHERE i <= 30""")
def s3(spark, sf):
    return S.limit_per_repo(corpus(spark, sf), 30).select("repo", "path")


@query("s3_limit_corpus_total", V1 + " SELECT repo, path FROM v ORDER BY path LIMIT 100")
def s3_total(spark, sf):
    return S.limit_corpus(corpus(spark, sf), 100).select("repo", "path")


@query("s4_parse_repo_url", """
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '^[^/]*example\\.(com|net|org)/', '') AS rest FROM pages),
b AS (SELECT page_id, list_filter(string_split(rest, '/'), lambda x: x <> '') AS parts FROM a)
SELECT page_id, CASE WHEN len(parts) >= 2 THEN parts[1] END AS owner, CASE WHEN len(parts) >= 2 THEN parts[2] END AS repo,
  CASE WHEN len(parts) >= 2 THEN coalesce(parts[4], 'HEAD') END AS branch, CASE WHEN len(parts) < 2 THEN 'invalid_repo_url' END AS reason FROM b""")
def s4(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return S.parse_repo_url(pages, "url", host=r"[^/]*example\.(com|net|org)").drop("url")


@query("s5_canonical_raw_url", """
SELECT page_id, CASE WHEN contains(url, 'example.com') THEN regexp_replace(regexp_replace(url, 'example\\.com', 'raw.example.com'), '/en/', '/') ELSE url END AS raw_url FROM pages""")
def s5(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", S.canonical_raw_url(F.col("url"), "example.com", "raw.example.com", "/en/").alias("raw_url"))


@query("s6_admission_filter", """
SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'missing_source' WHEN length(text) > 2000 THEN 'too_long' END AS predict_reason,
  CASE WHEN text IS NULL OR text = '' THEN 'missing_source' WHEN length(text) > 8000 THEN 'too_long' END AS semantic_reason FROM documents""")
def s6(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", S.reject_reason(F.col("text"), 2000).alias("predict_reason"),
        S.reject_reason(F.col("text"), 8000).alias("semantic_reason"))


@query("s7_error_rows", """
WITH p AS (SELECT 'event' AS kind, event_id AS id, props AS payload FROM events UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT kind, id, CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract_string(payload, '$.k') AS BIGINT) END AS k,
  CASE WHEN json_valid(payload) THEN NULL ELSE 'parse_failed' END AS error, CASE WHEN json_valid(payload) THEN NULL ELSE substr(payload, 1, 100) END AS excerpt FROM p""")
def s7(spark, sf):
    events = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("payload"))
    docs = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("payload"))
    parsed = S.parse_json_rows(events.unionByName(docs), "payload")
    return parsed.select("kind", "id", F.get_json_object("payload", "$.k").try_cast("long").alias("k"), "error", "excerpt")


@query("s8_write_dataset", V1 + f""",
g AS (SELECT lang, count(*) AS n FROM v GROUP BY 1)
SELECT '1.1' AS version, sum(n)::BIGINT AS n_samples, count(*) AS n_labels, {len(VOCABULARY)} AS vocab_size, 128 AS sequence_length,
  string_agg(lang, ',' ORDER BY lang) AS label_index, string_agg(lang || '=' || n, ',' ORDER BY lang) AS distribution FROM g""")
def s8(spark, sf):
    manifest = sinks.dataset_manifest(corpus(spark, sf).select(F.col("lang").alias("label"), F.col("lang").alias("category")))
    return manifest.select(
        "version", "n_samples", "n_labels", "vocab_size", "sequence_length",
        F.array_join("label_index", ",").alias("label_index"),
        F.array_join(F.transform("category_distribution", lambda s: F.concat(s["category"], F.lit("="), s["n"].cast("string"))), ",").alias("distribution"))


@query("s10_dimension_catalogue", """
SELECT p_partkey, p_size AS class_id, coalesce(n_name, p_size::VARCHAR) AS label, coalesce(r_name, 'unknown') AS category
FROM part LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON n_nationkey = p_size""")
def s10(spark, sf):
    from quillgraph.plans.scoring_queries import class_catalogue

    parts = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("class_id"))
    return with_catalogue(parts, class_catalogue(spark, sf)).select("p_partkey", "class_id", "label", "category")


WORDS = f"regexp_extract_all(text, {sql_text(WORD_PATTERN)})"
VOCAB = f"""WITH w AS (SELECT unnest({WORDS}) AS token FROM documents), k AS (SELECT token, count(*) AS n FROM w GROUP BY 1),
vocab AS (SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 1)::INTEGER AS id FROM k ORDER BY n DESC, token LIMIT {len(VOCABULARY) - 2})"""


@query("e1_build_vocab", VOCAB + " SELECT token, id, n FROM vocab")
def e1(spark, sf):
    return E.build_vocabulary(table(spark, sf, "documents"), "text")


ENCODED = VOCAB + f""",
t AS (SELECT doc_id, unnest(({WORDS})[1:128]) AS token, generate_subscripts(({WORDS})[1:128], 1) AS pos FROM documents),
i AS (SELECT doc_id, pos, coalesce(id, 1) AS id FROM t LEFT JOIN vocab USING (token))"""


@query("e2_encode_tokens", ENCODED + """,
s AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM i GROUP BY 1)
SELECT d.doc_id, array_to_string(list_resize(coalesce(s.ids, []), 128, 0), ' ') AS ids FROM documents d LEFT JOIN s USING (doc_id)""")
def e2(spark, sf):
    docs = table(spark, sf, "documents")
    encoded = E.encode_tokens(docs.select("doc_id", "text"), "text", E.build_vocabulary(docs, "text"))
    return encoded.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def _source_encoding_sql() -> str:
    rows = ", ".join(f"({sql_text(t)}, {ids!r}::INTEGER[])" for t, ids in encoding_table().items())
    tokens = f"regexp_extract_all(text, {sql_text(SOURCE_PATTERN)})"
    balanced = " AND ".join(
        f"length(text) - length(replace(text, '{a}', '')) = length(text) - length(replace(text, '{b}', ''))"
        for a, b in ("()", "[]", "{}"))
    return f"""WITH mp(tok, ids) AS (VALUES {rows}),
a AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages),
t AS (SELECT kind, id, unnest({tokens}) AS tok, generate_subscripts({tokens}, 1) AS pos FROM a WHERE {balanced}),
m AS (SELECT kind, id, pos, CASE WHEN mp.tok IS NOT NULL THEN mp.ids
  WHEN starts_with(t.tok, '//') OR starts_with(t.tok, '/*') THEN []::INTEGER[]
  WHEN t.tok[1] IN ('"', '''') THEN [{TOKEN_ID['Literal']}] WHEN t.tok[1] = '`' THEN [{TOKEN_ID['TemplateLiteral']}]
  WHEN starts_with(t.tok, 'Math.') THEN [{TOKEN_ID['MemberExpression']}] WHEN regexp_matches(t.tok, '^[0-9]') THEN [{TOKEN_ID['Literal']}]
  WHEN regexp_matches(t.tok, '^[A-Za-z_$]') THEN [{TOKEN_ID['Identifier']}] ELSE [1] END AS ids FROM t LEFT JOIN mp ON mp.tok = t.tok),
s AS (SELECT kind, id, flatten(list(ids ORDER BY pos)) AS ids FROM m GROUP BY 1, 2)
SELECT a.kind, a.id, array_to_string(list_resize(coalesce(s.ids, []), 128, 0), ' ') AS ids FROM a LEFT JOIN s USING (kind, id)"""


@query("e3_sub_token_interleave", _source_encoding_sql())
def e3(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    encoded = E.encode_source(docs.unionByName(pages), "text")
    return encoded.select("kind", "id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("e4_masked_mean_pool", ENCODED + f""",
x AS (SELECT vec_id % {len(VOCABULARY)} AS id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
tv AS (SELECT id, d, avg(v) AS v FROM x GROUP BY 1, 2),
c AS (SELECT doc_id, id, count(*) AS n FROM i WHERE id <> 0 GROUP BY 1, 2),
q AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY 1),
s AS (SELECT c.doc_id, tv.d, sum(tv.v * c.n) / any_value(q.n) AS pooled FROM c JOIN tv USING (id) JOIN q USING (doc_id) GROUP BY 1, 2)
SELECT doc_id, round(sum(pooled), 5) AS pooled_sum, round(max(CASE WHEN d = 1 THEN pooled END), 5) AS pooled_first,
  round(max(CASE WHEN d = 64 THEN pooled END), 5) AS pooled_last FROM s GROUP BY 1""")
def e4(spark, sf):
    docs = table(spark, sf, "documents")
    encoded = E.encode_tokens(docs.select("doc_id", "text"), "text", E.build_vocabulary(docs, "text"))
    vectors = E.token_vectors(table(spark, sf, "embeddings"), F.col("vec_id") % len(VOCABULARY), "embedding", DIM)
    pooled = E.masked_mean_pool(encoded.select("doc_id", "ids"), vectors, DIM)
    return pooled.select(
        "doc_id", F.round(total(F.col("pooled")), 5).alias("pooled_sum"),
        F.round(F.get("pooled", F.lit(0)), 5).alias("pooled_first"),
        F.round(F.get("pooled", F.lit(DIM - 1)), 5).alias("pooled_last"))


@query("t1_split_train_val", """
WITH h AS (SELECT doc_id, ('0x' || substr(md5('split-7|' || doc_id), 1, 8))::BIGINT AS h FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) <= floor(0.9::DOUBLE * count(*) OVER ()) AS is_train FROM h""")
def t1(spark, sf):
    return T.split_train_val(table(spark, sf, "documents").select("doc_id"), "doc_id", "split-7")


@query("t2_label_index", """
SELECT c_custkey, coalesce(list_position(['AUTOMOBILE', 'BUILDING', 'MACHINERY'], c_mktsegment), 0)::BIGINT - 1 AS label_id FROM customer""")
def t2(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", T.label_index(F.col("c_mktsegment"), ["AUTOMOBILE", "BUILDING", "MACHINERY"]).alias("label_id"))


@query("t3_train_classifier")
def t3(spark, sf):
    rows = T.split_train_val(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id", "split-7")
    model = T.train_classifier(rows.filter("is_train"), "text", "lang")
    scored = model.transform(rows.filter("NOT is_train"))
    return T.confusion(scored, "label_id", "predicted_id")


# A run is an event type, an epoch a day, a batch an hour; every fifth day is evaluated.
STEPS_SQL = """WITH s AS (SELECT event_type AS run, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT + 1 AS epoch, hour(ts) AS batch,
  value AS loss, CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0 END AS acc FROM events),
b AS (SELECT run, epoch, batch, round(avg(loss) * 1000000000)::BIGINT AS loss, round(avg(acc) * 1000000000)::BIGINT AS acc FROM s GROUP BY 1, 2, 3),
e AS (SELECT run, epoch, ((sum(loss) * 20000 + count(*) * 1000000000)::BIGINT // (count(*) * 2000000000)::BIGINT) / 10000.0::DOUBLE AS loss,
  ((sum(acc) * 2000 + count(*) * 1000000000)::BIGINT // (count(*) * 2000000000)::BIGINT) / 10.0::DOUBLE AS acc FROM b GROUP BY 1, 2),
v AS (SELECT run, epoch, avg(acc) AS val FROM s GROUP BY 1, 2)"""


def training_steps(spark, sf):
    ts = F.col("ts").cast("date")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("run"), (F.date_diff(ts, F.lit("2024-01-01").cast("date")) + 1).cast("long").alias("epoch"),
        F.hour("ts").alias("batch"), F.col("value").alias("loss"), F.when(F.col("value") > 20, 1.0).otherwise(0.0).alias("acc"))


def evaluations(steps, every: int):
    """The validation figure exists for every n-th epoch only; that rhythm is the operator's own."""
    return steps.groupBy("run", "epoch").agg(F.avg("acc").alias("val")).filter(F.col("epoch") % every == 0)


@query("t6_epoch_metrics", STEPS_SQL + """,
f AS (SELECT e.*, last_value(v.val IGNORE NULLS) OVER (PARTITION BY e.run ORDER BY e.epoch ROWS UNBOUNDED PRECEDING) AS val
  FROM e LEFT JOIN (SELECT * FROM v WHERE epoch % 5 = 0) v ON v.run = e.run AND v.epoch = e.epoch)
SELECT run, epoch, loss, acc, round(coalesce(val, 0) * 100, 1) AS val FROM f""")
def t6(spark, sf):
    steps = training_steps(spark, sf)
    return T.epoch_metrics(steps, evaluations(steps, 5))


@query("t7_best_and_early_stop", STEPS_SQL + """,
u AS (SELECT *, val > greatest(coalesce(max(val) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS up FROM v),
n AS (SELECT *, count(*) FILTER (WHERE up) OVER (PARTITION BY run ORDER BY epoch) AS island, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM u),
p AS (SELECT *, i - coalesce(max(CASE WHEN up THEN i END) OVER (PARTITION BY run ORDER BY epoch), 0) AS patience FROM n),
z AS (SELECT run, min(epoch) AS stop_epoch FROM p WHERE patience >= 4 AND epoch > 30 * 0.3 GROUP BY 1)
SELECT p.run, p.epoch, round(max(val) OVER (PARTITION BY p.run ORDER BY p.epoch), 6) AS best, patience::BIGINT AS patience, z.stop_epoch FROM p LEFT JOIN z USING (run)""")
def t7(spark, sf):
    tracked = T.best_and_patience(evaluations(training_steps(spark, sf), 1))
    stops = T.early_stop(tracked, total_epochs=30, patience=4)
    return tracked.join(stops, "run", "left").select("run", "epoch", F.round("best", 6).alias("best"), "patience", "stop_epoch")


@query("t8_config_fingerprint", """
WITH s AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT c_name || ':' || c_nationkey FROM customer)
SELECT name, lower(lpad(to_hex(list_reduce(list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT),
  lambda h, c: xor((h * 33) & 4294967295, c), 5381::BIGINT)), 8, '0')) AS fingerprint FROM s""")
def t8(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(
        table(spark, sf, "region").select(F.col("r_name").alias("name"))).unionByName(
        table(spark, sf, "customer").select(F.concat("c_name", F.lit(":"), F.col("c_nationkey").cast("string")).alias("name")))
    return names.select("name", djb2_fingerprint(F.col("name")).alias("fingerprint"))
