"""Source divergence audit: how far the sources of a language part from each other in their terms, and which terms part them.

Strings are materialised late. What is counted, shuffled, joined and ranked are 64-bit digests of terms: first the
documents of each (language, digest), then, for digests in enough documents, the occurrences in each source. In that second
pass each task also sends the strings of those digests once; the smallest and largest string of a digest differ exactly where
terms collide. Colliding digests are split: one more pass counts their terms by string, and each term gets a key of its own.
Strings meet the ranking at its end, for terms that may be in the output.

Pairs of sources are compared in tiles of TERMS terms by SOURCES x SOURCES sources. A term that neither source has
contributes the difference of their base shares, so tiles add only what their terms change. The sums over
tiles meet the pairs at the end; the result itself has a row for every ordered pair of sources in a language.

Defined results: null text, language and source count as ''. Every row is a document, repeated ids too. A group or
language without terms has its pair rows, with value 0 where no term is kept. Ties go to the item first in UTF-8 order. An
empty table gives an empty result. Columns other than the three named are not read. A text is one value of a row, so a row bounds memory.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.bitmaps import ROW_BITS, as_array, in_array, pages_of
from quillgraph.llm.common import documents, written

LEAST_DOCS = 30
TOP_TERMS = 50
SMOOTHING = 5
UNIT = 1_000_000_000
HELD_TERMS = 500_000  # distinct terms that a task counts before it sends them on
SLICE_ROWS = 1000
TERMS = 512
SOURCES = 256

# Letters and all bytes above ASCII make terms; A-Z become a-z, all else becomes a space.
Held = dict[tuple[str, str], tuple[Counter, Counter]]  # (lang, source): occurrences and texts of terms
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _digests(terms: list[bytes], mask: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) & mask for t in terms), np.uint64, len(terms)).view(np.int64)


class _Digests(dict):
    """Digests by term. Sources of a language share most terms, so a task remembers them, HELD_TERMS at most between two calls of `of`."""

    def __init__(self, mask: int) -> None:
        super().__init__()
        self.mask = mask

    def __missing__(self, term: bytes) -> int:
        digest = self[term] = xxhash.xxh64_intdigest(term) & self.mask
        return digest

    def of(self, terms: list[bytes]) -> np.ndarray:
        if len(self) > HELD_TERMS:
            self.clear()
        return np.fromiter(map(self.__getitem__, terms), np.uint64, len(terms)).view(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, str, str | None]]:
    for at in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(at, SLICE_ROWS)
        yield from zip(*(part.column(i).to_pylist() for i in range(3)))


def document_frequencies(rows: DataFrame, mask: int) -> DataFrame:
    """Rows (lang, digest, docs): in how many texts a digest's terms are, terms that share one added up."""
    def sent(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            digest = _digests(list(counts), mask)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(digest), pa.string()), pa.array(digest), pa.array(list(counts.values()), pa.int64())], ["lang", "digest", "docs"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, _, text in _texts(batch):
                held[lang].update(set(terms_of(text)))
                if sum(map(len, held.values())) > HELD_TERMS:
                    yield from sent(held)
                    held.clear()
        yield from sent(held)

    return (rows.mapInArrow(counted, "lang string, digest long, docs long")
            .groupBy("lang", "digest").agg(F.sum("docs").alias("docs")))


def _occurrences(rows: DataFrame, wanted: DataFrame, mask: int, by_string: bool) -> DataFrame:
    """Rows (lang, source, digest, n, docs, term) for terms whose digest may be wanted: a bitmap of a fixed size lets some more through.

    Terms that are not wanted are forgotten as they are sifted, so a task's counts grow with the wanted ones alone. Counts carry no
    string unless by_string; otherwise each task sends a term about once, in a row without counts.
    """
    bits = ROW_BITS
    bitmap = rows.sparkSession.sparkContext.broadcast(as_array(pages_of(wanted, F.col("digest"), bits), bits))
    names = ["lang", "source", "digest", "n", "docs", "term"]

    def sift(held: Held, kept: Held, digests: _Digests) -> int:
        """Moves the counts of wanted terms and forgets the others; how many terms are kept now."""
        for group, (n, docs) in held.items():
            terms, times = list(n), list(n.values())
            kept_n, kept_docs = kept[group]
            for i in np.flatnonzero(in_array(bitmap.value, digests.of(terms), bits)).tolist():
                term = terms[i]
                kept_n[term] = kept_n.get(term, 0) + times[i]
                if by_string:
                    kept_docs[term] += docs[term]
        held.clear()
        return sum(len(n) for n, _ in kept.values())

    def sent(kept: Held, spoken: dict[str, set[bytes]], digests: _Digests) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in kept.items():
            terms = list(n)
            new = [] if by_string else [t for t in terms if t not in spoken[lang]]
            spoken[lang].update(new)
            digest, none = digests.of(terms), [None] * len(new)
            strings = [t.decode("utf-8", "surrogatepass") for t in (terms if by_string else new)]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * (len(terms) + len(new)), pa.string()), pa.array([source] * len(terms) + none, pa.string()),
                pa.array(np.append(digest, digests.of(new))), pa.array(list(n.values()) + none, pa.int64()),
                pa.array((list(docs.values()) if by_string else [None] * len(terms)) + none, pa.int64()), pa.array(strings if by_string else [None] * len(terms) + strings, pa.string())], names)
        kept.clear()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Held = defaultdict(lambda: (Counter(), Counter()))
        kept: Held = defaultdict(lambda: (Counter(), Counter()))
        spoken: dict[str, set[bytes]] = defaultdict(set)
        digests = _Digests(mask)
        size = 0
        for batch in batches:
            for lang, source, text in _texts(batch):
                n, docs = held[lang, source]
                terms = terms_of(text)
                before = len(n)
                n.update(terms)
                if by_string:
                    docs.update(set(terms))
                size += len(n) - before
                if size > HELD_TERMS:
                    size = 0
                    if sift(held, kept, digests) > HELD_TERMS:
                        yield from sent(kept, spoken, digests)
                    if sum(map(len, spoken.values())) > HELD_TERMS:
                        spoken.clear()
        sift(held, kept, digests)
        yield from sent(kept, spoken, digests)

    return rows.mapInArrow(counted, "lang string, source string, digest long, n long, docs long, term string")


def kept_terms(rows: DataFrame, least_docs: int = LEAST_DOCS, mask: int = (1 << 64) - 1) -> tuple[DataFrame, DataFrame]:
    """(counts, names) of the terms in at least least_docs texts of their language.

    counts: lang, source, digest, variant, n; names: lang, digest, variant, term. The variant tells colliding terms apart.
    """
    wanted = written(document_frequencies(rows, mask).filter(F.col("docs") >= least_docs).select("lang", "digest"))
    found = written(_occurrences(rows, wanted, mask, by_string=False))
    names = written(found.filter("term IS NOT NULL").join(wanted, ["lang", "digest"], "left_semi")
                    .groupBy("lang", "digest").agg(F.min("term").alias("term"), F.max("term").alias("high")))
    zero = F.lit(0).alias("variant")
    # Summed first: the rows of all tasks are added up unsorted, and only what is left of them meets the wanted digests.
    counts = (found.filter("term IS NULL").groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"))
              .join(wanted, ["lang", "digest"], "left_semi"))
    collided = names.filter("term <> high").select("lang", "digest")
    if collided.isEmpty():
        return written(counts.select("lang", "source", "digest", zero, "n")), names.select("lang", "digest", zero, "term")
    split = written(_occurrences(rows, collided, mask, by_string=True).join(collided, ["lang", "digest"], "left_semi")
                    .groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    apart = (split.groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
             .withColumn("variant", F.row_number().over(Window.partitionBy("lang", "digest").orderBy("term"))))
    apart = written(apart.select("lang", "digest", "variant", "term"))
    counts = counts.join(collided, ["lang", "digest"], "left_anti").select("lang", "source", "digest", zero, "n").unionByName(
        split.join(apart, ["lang", "digest", "term"]).select("lang", "source", "digest", "variant", "n"))
    names = names.filter("term = high").select("lang", "digest", zero, "term").unionByName(apart)
    return written(counts), names


def share(n: str, total: str, terms: str) -> Column:
    """Smoothed share in units of 10^-9, plus one. In decimals, as products may pass 64 bits; `div` of decimals floors and is exact."""
    return F.expr(f"1L + (cast({n} + {SMOOTHING} AS decimal(20,0)) * {UNIT}) div greatest(cast({total} + {SMOOTHING} * {terms} AS decimal(20,0)), 1)")


def group_sizes(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (lang, source, place, total, terms, base): every group with its occurrences, its language's kept terms, and the share of a term it lacks."""
    groups = rows.select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = counts.select("lang", "digest", "variant").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sized = (groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "terms"])
             .withColumn("place", place))
    return written(sized.withColumn("base", share("0", "total", "terms")))


def _tile(lang: str, a: int, b: int, size: int, tile: pd.DataFrame) -> pd.DataFrame:
    """What the tile's terms add to the differences of each source of block a and each of block b (blocks of `size`) over those of their base shares."""
    place, at = np.unique(tile["place"].to_numpy(), return_inverse=True)
    keys, term = np.unique(tile[["digest", "variant"]].to_numpy(), axis=0, return_inverse=True)
    base = np.zeros(len(place), np.int64)
    base[at] = tile["base"].to_numpy()
    p = np.repeat(base[:, None], len(keys), axis=1)
    p[at, term.ravel()] = tile["p"].to_numpy()
    left, right = (np.flatnonzero(place // size == block) for block in (a, b))
    more = [np.abs(p[right] - p[i]).sum(axis=1) - len(keys) * np.abs(base[right] - base[i]) for i in left]
    return pd.DataFrame({"lang": lang, "a": np.repeat(place[left], len(right)), "b": np.tile(place[right], len(left)),
                         "more": np.concatenate(more) if more else np.zeros(0, np.int64)})


def pair_differences(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value) for all ordered pairs of sources of a language."""
    size = SOURCES
    block = F.floor(F.col("place") / size).cast("int")
    tiles = F.greatest(F.ceil(F.col("terms") / TERMS), F.lit(1))
    blocks = F.floor(F.max("place").over(Window.partitionBy("lang")) / size) + 1
    sized = groups.withColumn("blocks", blocks.cast("int"))
    named = ["lang", "source", "tile", "digest", "variant", "p"]
    of_terms = shares.withColumn("tile", F.pmod(F.xxhash64("digest", "variant"), tiles)).select(*named)
    # Every source is in every tile, by one term that has the base share everywhere and so adds nothing.
    everywhere = (groups.filter("terms > 0").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
                  .select("lang", "source", "tile", F.lit(0).cast("long").alias("digest"), F.lit(-1).alias("variant"), F.col("base").alias("p")))
    rows = (of_terms.unionByName(everywhere).join(sized, ["lang", "source"]).withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("lang", "tile", F.least("block", "other").alias("a_block"), F.greatest("block", "other").alias("b_block"),
                    "place", "digest", "variant", "p", "base"))

    def compared(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        return _tile(key[0], key[2], key[3], size, tile)

    more = rows.groupBy("lang", "tile", "a_block", "b_block").applyInPandas(compared, "lang string, a long, b long, more long")
    more = more.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    # Tiles of two blocks give one order of a pair only.
    both = written(more.unionByName(more.filter(F.floor(F.col("a") / size) < F.floor(F.col("b") / size)).select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "more")))
    one, two = groups.alias("x"), groups.alias("y")
    pairs = one.join(two, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.place") != F.col("y.place")))
    met = pairs.join(both.alias("m"), (F.col("m.lang") == F.col("x.lang")) & (F.col("m.a") == F.col("x.place")) & (F.col("m.b") == F.col("y.place")), "left")
    value = F.col("x.terms") * F.abs(F.col("x.base") - F.col("y.base")) + F.coalesce(F.col("more"), F.lit(0))
    return met.select("x.lang", "x.source", F.col("y.source").alias("item"), value.alias("value"))


def leading_terms(shares: DataFrame, counts: DataFrame, names: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, item, value): terms whose share is above their language's, those that may be among the first `most`."""
    key = ["lang", "digest", "variant"]
    of_lang = counts.groupBy(*key).agg(F.sum("n").alias("n"))
    totals = of_lang.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    q = of_lang.join(totals, "lang").select(*key, share("n", "total", "terms").alias("q"))
    above = shares.join(q, key).filter("p > q").withColumn("value", F.col("p") - F.col("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    first = above.select(*key, "source", "value").withColumn("_rank", F.rank().over(best)).filter(F.col("_rank") <= most)
    return written(first).join(names, key).select("lang", "source", F.col("term").alias("item"), "value")


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS,
                      most: int = TOP_TERMS, digest_bits: int = 64) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): all other sources by difference, and the first terms above the language's share."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(named(lang).alias("lang"), named(source).alias("source"), F.col(text).alias("text"))
    counts, names = kept_terms(rows, least_docs, (1 << digest_bits) - 1)
    groups = group_sizes(rows, counts)
    shares = written(counts.join(groups, ["lang", "source"]).select("*", share("n", "total", "terms").alias("p")))
    parts = (pair_differences(shares, groups).withColumn("part", F.lit("pair"))
             .unionByName(leading_terms(shares, counts, names, most).withColumn("part", F.lit("term"))))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return (parts.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= most))
            .select("lang", "source", "part", "item", "value", "rank"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source of every language, over all documents."""
    return source_divergence(documents(spark, sf_dir, "lang", "source", "text"))


OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k ON g.lang = k.lang GROUP BY g.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT g.lang, g.source, v, coalesce(sum(c.n), 0) AS total
      FROM g JOIN v USING (lang) LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source, v),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS n,
        1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {SMOOTHING}) // (total + {SMOOTHING} * v)::HUGEINT)::BIGINT AS p
      FROM n JOIN k ON n.lang = k.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (SELECT l.lang, l.term, 1 + ({UNIT}::HUGEINT * (l.n + {SMOOTHING}) // ((SELECT sum(n) FROM l m WHERE m.lang = l.lang) + {SMOOTHING} * v.v)::HUGEINT)::BIGINT AS q
      FROM l JOIN v ON l.lang = v.lang),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS i, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY x.lang, x.source, y.source) z
    ON z.lang = a.lang AND z.s = a.source AND z.i = b.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
