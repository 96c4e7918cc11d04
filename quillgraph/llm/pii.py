"""Personal data in texts: proposed spans, boosted trees, calibrated thresholds. All of it is DataFrame expressions.

Base detectors give spans by fixed formats (mail address, internet address, card, phone); these always stand.
Generators of high recall propose further spans, overlapping each other and the base: other spellings of addresses,
numbers with other separators, national phone formats, other address families. Trees score each proposal by
its format and what stands before it; a proposal stands if its score reaches its kind's threshold, it touches no base
span, and no better proposal overlaps it.

The trees are fitted when the query starts. Labelled rows are base spans of about SAMPLE_DOCS documents (twice as many at most), respelled as
the generators know them, against decoys: runs of digits that fail the checks, amounts, dates, versions and plain words.
The threshold of a kind is the lowest score at which PRECISION of the held-out labelled rows above it are true.

Everything is computed within a row, so nothing is shuffled. Patterns are possessive and start at the edge of a run of
their characters, so a text of any length is read in linear time; the leftmost matches are those of the plain patterns.

Defined results: null and empty texts have no spans. Offsets count code points. Repeated rows are equal; a null
doc_id is carried. An empty table gives an empty result and fits on fixed examples.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.rows import settle
from quillgraph.llm.boosting import BoostedTrees, fit
from quillgraph.llm.common import documents, hashed_sample, whole_text

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 2000
PRECISION = 0.98
SEED = 11
BEFORE = 24

# Base patterns. A run of local-part characters is entered at its edge or right after the last match.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What every match of a base pattern holds; texts without it are not searched.
_NEEDS = {"email": "@", "phone": "+"}

# Generators: (kind, pattern).
PROPOSALS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+[\x20]?+(?:\(at\)|\[at\]|\{at\}|<at>|\(AT\)|\[AT\])[\x20]?+[A-Za-z0-9-]{1,63}+(?:[\x20]?+(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\(DOT\)|\[DOT\]|\.)[\x20]?+[A-Za-z0-9-]{1,63}+){1,6}+"),
    ("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+@[\p{L}0-9-]{1,63}+(?:\.[\p{L}0-9-]{1,63}+){1,6}+"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:[\x20]?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[\x20]?[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9.])[0-9]{4}(?:[./_\xA0 –][0-9]{4}){2}[./_\xA0 –][0-9]{1,7}(?![0-9.])"),
    ("phone", r"(?<![0-9(.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9.+-])00[1-9][0-9]{0,2}(?:[\x20.-]?[0-9]{2,4}){3,5}(?![0-9])"),
)
_CUES = {"email": "mail|contact|write", "ip": "ip|host|server|address|addr", "card": "card|visa|master|amex|pay", "phone": "phone|tel|call|fax|mobile|cell|text"}
_DECOY = "v|version|order|invoice|no|ref|id|isbn|serial|part|section|total|usd|eur|page"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Luhn check of a string of digits."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _small_parts(value: Column) -> Column:
    """Whether all runs of digits are at most 255."""
    return F.forall(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda part: F.when(
        F.length(F.regexp_replace(part, "^0+", "")) <= 3, F.coalesce(F.regexp_replace(part, "^0+", "").try_cast("int"), F.lit(0)) <= 255).otherwise(False))


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    count = F.length(digits)
    return {"email": F.lit(True), "ip": _small_parts(value), "phone": count.between(9, 15),
            "card": F.when(count.between(12, 19), passes_luhn(digits)).otherwise(False)}[kind]


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, start, end, value, before) of the leftmost non-overlapping matches.

    What lies between the matches gives their places: one pass splits the text, one collects the matches.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(between, found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string>>")

    def step(state: Column, item: Column) -> Column:
        start = state["at"] + F.length(item["gap"])
        end = start + F.coalesce(F.length(item["value"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), item["value"].alias("value"),
                        F.right(item["gap"], F.lit(BEFORE)).alias("before"))
        return F.struct(end.alias("at"), F.when(item["value"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span))).alias("spans"))

    placed = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda state: state["spans"])
    return F.when(text.rlike(pattern), placed).otherwise(none)


def base_spans(text: Column) -> Column:
    """Array of the valid base spans, by start and then kind."""
    def of(kind: str) -> Column:
        every = matches(text, kind, BASE[kind])
        if kind in _NEEDS:
            every = F.when(F.contains(text, F.lit(_NEEDS[kind])), every)
        return F.filter(F.coalesce(every, F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string>>")), lambda s: _valid(kind, s["value"]))

    return by_place(F.concat(*map(of, KINDS)))


def by_place(spans: Column) -> Column:
    rank = F.array(*map(F.lit, KINDS))
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                        .otherwise(F.array_position(rank, a["kind"]) - F.array_position(rank, b["kind"])).cast("int"))


def proposals(text: Column) -> Column:
    """Array of all proposed spans; they may overlap."""
    return F.concat(*[matches(text, kind, pattern) for kind, pattern in PROPOSALS])


FEATURES = ([f"is_{k}" for k in KINDS] + ["length", "digits", "letters", "others", "groups", "first_group", "last_group", "at_mark", "at_word", "dots",
            "parens", "luhn", "small_parts", "zero_start", "own_cue", "decoy_cue", "after_letter", "after_symbol", "leading_zeros"])


def span_features(span: Column) -> Column:
    """Array of FEATURES, as doubles, of one span."""
    value, before, kind = span["value"], F.lower(span["before"]), span["kind"]
    digits = _digits(value)
    groups = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    n = F.size(groups)
    letters = F.length(F.regexp_replace(value, r"[^\p{L}]", ""))
    cue = F.coalesce(*[F.when(kind == k, before.rlike(rf"(?:^|[^a-z])(?:{words})[^a-z]*$")) for k, words in _CUES.items()], F.lit(False))
    parts = [kind == k for k in KINDS] + [
        F.length(value), F.length(digits), letters, F.length(value) - F.length(digits) - letters, n,
        F.when(n > 0, F.length(groups[0])).otherwise(0), F.when(n > 0, F.length(F.element_at(groups, -1))).otherwise(0),
        value.contains("@"), F.lower(value).rlike(r"[(\[{<]at[)\]}>]"), F.length(value) - F.length(F.replace(value, F.lit("."), F.lit(""))),
        value.contains("("), F.when(F.length(digits).between(12, 19), passes_luhn(digits)).otherwise(False), _small_parts(value),
        F.left(digits, F.lit(1)) == "0", cue, before.rlike(rf"(?:^|[^a-z])(?:{_DECOY})[^a-z0-9]*$"), before.rlike(r"\p{L}$"), before.rlike(r"[#$€£%=/_:-]$"),
        F.left(digits, F.lit(2)) == "00"]
    return F.array(*[F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts])


@dataclass
class SpanModel:
    """Trees and the least score of each kind."""

    trees: BoostedTrees
    thresholds: dict[str, float]


_EXAMPLES = ("ana.ruiz@mail.example.org", "203.0.113.77", "4539578763621486", "+1 (212) 555-0187", "j_doe@example.net", "198.51.100.4", "6011000990139424", "+44 20 7946 0958")


def _respelled(value: str, kind: str, dice: random.Random) -> str:
    """A true value as one of the generators knows it."""
    digits = "".join(c for c in value if c.isdigit())
    if kind == "email":
        name, _, host = value.partition("@")
        at, dot = dice.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), ("{at}", "."), ("@", ".")])
        return f"{name}é@{host}" if at == "@" else name + at + host.replace(".", dot)
    if kind == "ip":
        return dice.choice(["[.]", "(.)", "[dot]"]).join(value.split(".")) if dice.random() < 0.6 else ":".join(f"{dice.randrange(65536):x}" for _ in range(8))
    if kind == "card":
        return dice.choice("./_–").join(digits[i:i + 4] for i in range(0, len(digits), 4))
    tail = (digits[-10:]).rjust(10, "2")
    return dice.choice([f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}", f"00{digits[:11].rjust(11, '4')}", f"0049 {tail[:3]} {tail[3:6]} {tail[6:]}"])


def _decoys(dice: random.Random) -> tuple[str, str]:
    """A value of one kind that is none, and what stands before it."""
    n = lambda k: "".join(str(dice.randrange(10)) for _ in range(k))
    kind = dice.choice(KINDS)
    value = {
        "email": lambda: dice.choice([f"look{dice.choice('@')}é", f"a (at) {dice.choice(['noon', 'home'])}. Then", f"x@é.{n(1)}"]),
        "ip": lambda: dice.choice([f"{n(3)}[.]{dice.randrange(256, 999)}[.]{n(3)}[.]{n(2)}", f"{dice.randrange(300, 999)}(.){n(1)}(.){n(1)}(.){n(3)}"]),
        "card": lambda: dice.choice([f"{n(4)}/{n(4)}/{n(4)}/{n(4)}", f"{n(4)}.{n(4)}.{n(4)}.{n(2)}", f"{n(4)}_{n(4)}_{n(4)}_{n(4)}"]),
        "phone": lambda: dice.choice([f"{n(3)} {n(3)} {n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"00{dice.randrange(1, 9)}{n(8)}", f"0{n(2)}-{n(3)}-{n(4)}"]),
    }[kind]()
    return value, dice.choice(["order ", "invoice no ", "total $", "v", "ref: ", "serial ", "part ", "isbn ", "id=", "page "])


def fit_model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> SpanModel:
    """Trees and thresholds from the base spans of a sample of documents, chosen by a hash of doc_id."""
    spark, dice = docs.sparkSession, random.Random(SEED)
    chosen = hashed_sample(docs.select(F.col(doc_id).alias("id"), whole_text(F.col(text)).alias("text")).filter(F.col("text").rlike("[0-9@]")), "id", SAMPLE_DOCS)
    found = [(s["kind"], s["value"], s["before"]) for row in chosen.select(base_spans(F.col("text")).alias("spans")).collect() for s in row["spans"]]
    found = sorted(set(found))[:8 * SAMPLE_DOCS]
    true = found + [(k, v, "") for v in _EXAMPLES for k in KINDS if _kind_of(v) == k] * 5
    words = ["phone: ", "call ", "mail ", "card ", "host ", "tel. ", "", "", "the ", "on "]
    made = [(f"{(b or dice.choice(words))}{_respelled(v, k, dice)} ", 1.0) for k, v, b in true for _ in range(2)]
    made += [(before + value + " ", 0.0) for value, before in (_decoys(dice) for _ in range(max(len(made), 200)))]
    dice.shuffle(made)
    labelled = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(made)], "i long, text string, y double")
    rows = (labelled.select("i", "y", F.explode(proposals(F.col("text"))).alias("span"))
            .select("i", "y", "span.kind", span_features(F.col("span")).alias("f")).orderBy("i", "span.start").collect())
    x, y = np.array([r["f"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows])
    kinds = np.array([r["kind"] for r in rows])
    held = np.arange(len(y)) % 4 == 0
    trees = fit(x[~held], y[~held], trees=25, depth=3)
    margin = trees.margin(x[held])
    return SpanModel(trees, {k: _threshold(margin[kinds[held] == k], y[held][kinds[held] == k]) for k in KINDS})


def _kind_of(value: str) -> str:
    return "email" if "@" in value else "phone" if value[0] == "+" else "ip" if "." in value else "card"


def _threshold(margin: np.ndarray, y: np.ndarray) -> float:
    """The lowest score from which on PRECISION of the held-out rows are true; at least even odds. Infinite if there is none."""
    order = np.argsort(-margin, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= PRECISION)
    return max(float(margin[order][good[-1]]), 0.0) if len(good) else float("inf")


def likely_spans(text: Column, model: SpanModel) -> Column:
    """Array of the proposals whose score reaches their kind's threshold."""
    scored = F.transform(proposals(text), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), span_features(s).alias("f")))
    limit = lambda s: F.coalesce(*[F.when(s["kind"] == k, F.lit(t)) for k, t in model.thresholds.items() if np.isfinite(t)], F.lit(1e9))
    scored = F.transform(scored, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), limit(s).alias("limit"),
        model.trees.expression([s["f"][i] for i in range(len(FEATURES))]).alias("score")))
    return F.filter(scored, lambda s: s["score"] >= s["limit"])


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: SpanModel | None = None, carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """The carried columns as struct `row`, beside base and added: arrays of spans, in code points, ends exclusive."""
    model = model or fit_model(docs, doc_id, text)
    rows = docs.select(F.struct(*carry).alias("row"), whole_text(F.col(text)).alias("_text"))
    # Most texts have neither a digit nor a mark that any pattern needs.
    rows = rows.select("row", F.when(F.col("_text").rlike(r"[0-9@]|[(\[{<](?:at|AT)[)\]}>]"), F.col("_text")).otherwise("").alias("_text"))
    rows = rows.select("row", base_spans(F.col("_text")).alias("base"), likely_spans(F.col("_text"), model).alias("proposed"))
    rows = settle(rows, "base", "proposed")
    clear = F.filter("proposed", lambda s: ~F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    rows = settle(rows.withColumn("clear", clear), "clear")
    better = lambda o, s: (o["score"] > s["score"]) | ((o["score"] == s["score"]) & ((o["start"] < s["start"]) | ((o["start"] == s["start"]) & (o["end"] > s["end"]))))
    best = F.filter("clear", lambda s: ~F.exists("clear", lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & better(o, s)))
    narrow = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return rows.select("row", F.transform("base", narrow).alias("base"), F.array_distinct(F.transform(best, narrow)).alias("added"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (in order, not overlapping) replaced by its kind in brackets."""
    state = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] < s["at"], s["out"]).otherwise(
            F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]"))).alias("out")))
    return F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest and all spans of every document."""
    found = find_spans(documents(spark, sf_dir, "doc_id", "text"), carry=("doc_id",))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(by_place(F.concat("base", "added"))).alias("spans"))
