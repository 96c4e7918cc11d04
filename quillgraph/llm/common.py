"""Words, normal forms and small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.session import cut_lineage, table

# White space is \x20 and \x09-\x0D, everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]+"

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The whole documents table, or the named columns of it."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(*columns) if columns else docs


def whole_text(text: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(text, F.lit(""))


def one_spaced(text: Column) -> Column:
    """Each run of white space becomes one space; a run that is one space already is not rewritten."""
    return F.regexp_replace(whole_text(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def word_count(text: Column) -> Column:
    """Number of words; null and empty have none."""
    return F.size(F.array_remove(F.split(whole_text(text), SPACE), "")).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8. bytes.split() takes exactly the white space of SPACE, str.split() takes more."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here and later reads have true sizes."""
    return cut_lineage(df)


def row_batches(batches: Iterator, columns: tuple[str, ...], most: int = 2000) -> Iterator[list[tuple]]:
    """Rows of Arrow batches in slices of at most `most`, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            yield list(zip(*(part.column(c).to_pylist() for c in columns)))


def carried(docs: DataFrame, text: str, carry: tuple[str, ...]) -> DataFrame:
    """The columns to carry as struct `row`, beside the text as _text where the struct does not hold it already."""
    row = F.struct(*carry).alias("row")
    return docs.select(row) if "*" in carry else docs.select(row, F.col(text).alias("_text"))


def texts_of(batch, text: str, most: int = 2000) -> Iterator[list[str | None]]:
    """Texts of an Arrow batch of `carried` rows, some at a time."""
    held = "_text" not in batch.schema.names
    for at in range(0, batch.num_rows, most):
        part = batch.slice(at, most)
        yield (pc.struct_field(part.column("row"), text) if held else part.column("_text")).to_pylist()


def range_bounds(ids: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 ascending ids that cut a long column into parts of about equal row counts."""
    if parts < 2:
        return []
    return sorted({int(b) for b in ids.approxQuantile(column, [i / parts for i in range(1, parts)], 1 / (4 * parts))})


def range_part(key: Column, bounds: list[int]) -> Column:
    """Number of the part that holds an id: that of the first bound not below it. Null ids are in part 0."""
    if not bounds:
        return F.lit(0)
    first = F.array_position(F.transform(F.array(*map(F.lit, bounds)), lambda bound: bound >= key), True)
    return F.when(key.isNull(), 0).when(first == 0, len(bounds)).otherwise(first - 1).cast("int")


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows, chosen by a hash of the key alike at every size, and never more than twice as many.

    Only a count reaches the driver; no task sends rows that are not in the sample.
    """
    share = most / max(rows.count(), 1)
    place = F.xxhash64(F.col(key)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return rows.filter(place < share).limit(2 * most)
