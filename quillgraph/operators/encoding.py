"""Texts as fixed-length id sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.rows import settle
from quillgraph.functions.text import word_tokens
from quillgraph.functions.vocabulary import (
    PAD_ID, SEQUENCE_LENGTH, SILENT, SOURCE_PATTERN, TOKEN_ID, UNKNOWN_ID, VOCABULARY, encoding_table,
)


def token_counts(texts: DataFrame, text: str) -> DataFrame:
    """Counted inside each task before the shuffle, so a frequent token is one row per task."""
    return texts.select(F.explode(word_tokens(F.col(text))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))


def build_vocabulary(texts: DataFrame, text: str, size: int = len(VOCABULARY)) -> DataFrame:
    """The ``size - 2`` most frequent tokens (ties by token) behind the two special ids."""
    top = token_counts(texts, text).orderBy(F.desc("n"), "token").limit(size - 2)
    # ``size`` rows at most.
    return top.select("token", (F.row_number().over(W.orderBy(F.desc("n"), "token")) + 1).alias("id"), "n")


def vocabulary_map(vocabulary: DataFrame) -> Column:
    """The vocabulary as one value. Its length is the size parameter, not the data."""
    return vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("token", F.col("id").cast("int"))))).scalar()


def pad_sequence(ids: Column, length: int = SEQUENCE_LENGTH) -> Column:
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(PAD_ID), F.lit(length) - F.size(cut)))


def encode_tokens(texts: DataFrame, text: str, vocabulary: DataFrame, out: str = "ids") -> DataFrame:
    """Adds the padded id sequence; unknown tokens become 1, a missing text all padding."""
    tokens = F.coalesce(word_tokens(F.col(text)), F.array().cast("array<string>"))
    return (
        texts.withColumn("_vocab", vocabulary_map(vocabulary))
        .withColumn("_tokens", F.slice(tokens, 1, SEQUENCE_LENGTH))
        .withColumn(out, pad_sequence(F.transform(
            "_tokens", lambda t: F.coalesce(F.try_element_at(F.col("_vocab"), t), F.lit(UNKNOWN_ID)))))
        .drop("_vocab", "_tokens")
    )


def is_balanced(text: Column) -> Column:
    """Equal numbers of opening and closing brackets of each kind: the parse check of the encoder."""
    def same(a: str, b: str) -> Column:
        return F.length(F.replace(text, F.lit(a), F.lit(""))) == F.length(F.replace(text, F.lit(b), F.lit("")))

    return same("(", ")") & same("[", "]") & same("{", "}")


def source_tokens(text: Column, length: int = SEQUENCE_LENGTH) -> Column:
    """The first source tokens that stand for an id. Each of them gives at least one, so `length` of them fill a sequence."""
    tokens = F.regexp_extract_all(text, F.lit(SOURCE_PATTERN), F.lit(0))
    speaks = lambda t: ~t.isin(*SILENT) & ~F.startswith(t, F.lit("//")) & ~F.startswith(t, F.lit("/*"))
    return F.slice(F.filter(tokens, speaks), 1, length)


def source_ids(tokens: Column) -> Column:
    """Main id and optional sub-token id per source token, in order."""
    table = F.create_map(*[
        part for token, ids in encoding_table().items() if ids
        for part in (F.lit(token), F.array(*[F.lit(i) for i in ids]).cast("array<int>"))
    ])
    one = lambda node: F.array(F.lit(TOKEN_ID[node]))

    def ids_of(token: Column) -> Column:
        first = F.substring(token, 1, 1)
        return F.coalesce(
            F.try_element_at(table, token),
            F.when(first.isin('"', "'"), one("Literal"))
            .when(first == "`", one("TemplateLiteral"))
            .when(F.startswith(token, F.lit("Math.")), one("MemberExpression"))
            .when(token.rlike("^[0-9]"), one("Literal"))
            .when(token.rlike("^[A-Za-z_$]"), one("Identifier"))
            .otherwise(F.array(F.lit(UNKNOWN_ID))),
        )

    return F.flatten(F.transform(tokens, ids_of))


def encode_source(texts: DataFrame, text: str, out: str = "ids") -> DataFrame:
    """Padded sequence with interleaved sub-tokens; a text that does not balance is all padding."""
    empty = F.array().cast("array<int>")
    balanced = F.when(is_balanced(F.col(text)), source_tokens(F.col(text)))
    # Settled, so that the scan of the text and the look-ups behind it run once.
    rows = settle(texts.withColumn("_tokens", balanced), "_tokens")
    rows = settle(rows.withColumn("_ids", F.coalesce(source_ids(F.col("_tokens")), empty)), "_ids")
    return rows.withColumn(out, pad_sequence(F.col("_ids"))).drop("_ids", "_tokens")


def token_vectors(embeddings: DataFrame, token_id: Column, vector: str, dim: int) -> DataFrame:
    """Mean vector per token id."""
    means = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"d{i}") for i in range(dim)]
    return embeddings.groupBy(token_id.cast("int").alias("id")).agg(*means).select(
        "id", F.array(*[f"d{i}" for i in range(dim)]).alias("vector"))


def masked_mean_pool(encoded: DataFrame, vectors: DataFrame, dim: int, ids: str = "ids", out: str = "pooled") -> DataFrame:
    """Mean token vector over the real positions; the divisor stays within [1, sequence length].

    ``vectors`` has one row per vocabulary id, so it is bounded by the vocabulary size.
    """
    lookup = vectors.agg(F.map_from_entries(F.collect_list(F.struct("id", "vector")))).scalar()
    zero = F.array_repeat(F.lit(0.0), dim)
    real = settle(encoded.withColumn("_real", F.filter(ids, lambda i: i != PAD_ID)), "_real")
    # Equal ids are pooled once with their count, so a row costs its distinct tokens.
    counted = settle(real.withColumn("_counts", F.transform(
        F.array_distinct("_real"),
        lambda i: F.struct(i.alias("id"), F.size(F.filter(F.col("_real"), lambda j: j == i)).cast("double").alias("n")))), "_counts")
    vectored = settle(counted.withColumn("_lookup", lookup).withColumn("_counts", F.transform(
        "_counts", lambda c: F.struct(c["n"].alias("n"), F.try_element_at(F.col("_lookup"), c["id"]).alias("v")))), "_counts")
    summed = vectored.withColumn("_sum", F.aggregate(
        "_counts", zero,
        lambda acc, c: F.zip_with(acc, c["v"], lambda a, x: a + F.coalesce(x, F.lit(0.0)) * c["n"])))
    divisor = F.greatest(F.lit(1), F.least(F.size("_real"), F.lit(SEQUENCE_LENGTH)))
    pooled = settle(summed.withColumn("_n", divisor), "_sum", "_n").withColumn(
        out, F.transform("_sum", lambda x: x / F.col("_n")))
    return settle(pooled, out).drop("_lookup", "_real", "_counts", "_sum", "_n")
