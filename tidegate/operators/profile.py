"""Column profiles: one plan for all columns of an all-string table.

The table is unpivoted to (ordinal, value) and counted by distinct value first,
with map-side combination. Every measure is then a weighted aggregate over
distinct values: each is parsed and masked once, however often it occurs, and a
value that fills most of a column is one row. What is joined at the end has one
row per column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.functions.ops import DATE_LABELS, date_shape, java_pattern
from tidegate.schema import SRC_ROW

# Tokens and shapes that profiles recognise.
NULL_TOKENS = ("", "-", "--", "n/a", "na", "null", "none", "nil", "#n/a", "?", "unknown")
BOOL_TOKENS = ("true", "false", "yes", "no", "y", "n", "t", "f", "0", "1")
EMAIL = r"(?i)^[^@\s]+@[^@\s]+\.[a-z]{2,}\z"
URL = r"(?i)^(https?://|www\.)\S+\z"
CURRENCY_VALUE = r"(?i)^(?:[$€£¥]\s?-?[\d.,]++|-?[\d.,]++\s?(?:USD|EUR|GBP|JPY|CAD))\z"
PERCENT_VALUE = r"^-?[\d.,]++\s?%\z"
INTEGER = r"^-?(?:\d{1,3}(?:,\d{3})*|\d+)\z"
EUROPEAN = r"^-?(?:\d{1,3}(?:\.\d{3})*|\d+),\d+\z"
FLOAT = r"(?i)^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+)?\z|^[+-]?(?:inf|infinity|nan)\z"

TOP_VALUES = 10
SAMPLES = 5
DATE_CANDIDATES = 4
PATTERNS = 10
MASK_CHARS = 60
#: Masks are taken of this many distinct values of a column, the most frequent; ``pattern_coverage`` says what share of rows that is.
MASKED_VALUES = 20_000
#: Parts of a column in which the most frequent values are sought side by side.
PARTS = 64
NUMERIC = ("integer", "decimal", "european_decimal")

#: A run of one class of characters, or one other character.
_RUNS = r"(\p{Lu}+|[\p{L}&&[^\p{Lu}]]+|\p{Nd}+|\s+|[\s\S])"


def null_value(v: Column) -> Column:
    return F.lower(F.trim(v)).isin(*NULL_TOKENS)


def is_integer(v: Column) -> Column:
    return v.rlike(INTEGER)


def _unmarked(v: Column) -> Column:
    """Without currency signs before and percent signs behind."""
    return F.rtrim(F.ltrim(v, F.lit("$€£¥")), F.lit("%"))


def _bare(v: Column) -> Column:
    return F.translate(_unmarked(v), ", ", "")


def is_decimal(v: Column) -> Column:
    return _bare(v).rlike(FLOAT)


def is_european(v: Column) -> Column:
    return v.contains(",") & F.ltrim(v, F.lit("$€£¥")).rlike(EUROPEAN)


def is_boolean(v: Column) -> Column:
    return (F.length(v) <= max(map(len, BOOL_TOKENS))) & F.lower(v).isin(*BOOL_TOKENS)


def parses_date(v: Column, fmt: str) -> Column:
    """Only values of the format's shape are parsed: Spark throws and catches an exception for each that it cannot read."""
    return F.when(v.rlike(date_shape(fmt)), F.try_to_timestamp(v, F.lit(java_pattern(fmt))).isNotNull()).otherwise(F.lit(False))


def mask(v: Column) -> Column:
    """The shape of a value as a pattern: ``ORD-000123`` is ``[A-Z]{3}-\\d{6}``; other signs are escaped."""
    runs = F.regexp_extract_all(F.substring(v, 1, MASK_CHARS), F.lit(_RUNS), F.lit(1))

    def shape(run: Column) -> Column:
        kind = (
            F.when(run.rlike(r"^\p{Lu}"), F.lit("[A-Z]"))
            .when(run.rlike(r"^\p{L}"), F.lit("[a-z]"))
            .when(run.rlike(r"^\p{Nd}"), F.lit(r"\d"))
            .when(run.rlike(r"^\s"), F.lit(r"\s"))
        )
        counted = F.when(F.length(run) > 1, F.concat(kind, F.lit("{"), F.length(run).cast("string"), F.lit("}"))).otherwise(kind)
        return F.coalesce(counted, F.regexp_replace(run, r"([.^$*+?()\[\]{}|\\/])", r"\\$1"))

    return F.concat(F.array_join(F.transform(runs, shape), ""), F.when(F.length(v) > MASK_CHARS, F.lit("...")).otherwise(F.lit("")))


def long_form(frame: DataFrame) -> DataFrame:
    """ordinal, value, row of every cell but the lineage."""
    names = [c for c in frame.columns if c != SRC_ROW]
    row = F.col(SRC_ROW) if SRC_ROW in frame.columns else F.lit(0).cast("long")
    cells = [F.struct(F.lit(i).alias("ordinal"), F.trim(F.col("`" + n.replace("`", "``") + "`").cast("string")).alias("value")) for i, n in enumerate(names)]
    return frame.select(row.alias("row"), F.inline(F.array(*cells)))


def _distinct(frame: DataFrame) -> DataFrame:
    counted = long_form(frame).groupBy("ordinal", "value").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    return counted.withColumn("missing", F.coalesce(null_value(F.col("value")), F.lit(True))).withColumn("blank", F.coalesce(F.col("value") == "", F.lit(False)))


def _named(counted: DataFrame, frame: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(c) for c in frame.columns if c != SRC_ROW])
    return counted.select("ordinal", F.get(names, F.col("ordinal")).alias("name"), "value", "n", "first", "missing", "blank")


def distinct_values(frame: DataFrame) -> DataFrame:
    """ordinal, name, value, n, first (smallest row), missing, blank of each distinct trimmed value."""
    return _named(_distinct(frame), frame)


@contextmanager
def counted(frame: DataFrame) -> Iterator[DataFrame]:
    """The distinct values of a frame, kept for several uses and released at the end."""
    values = _distinct(frame).persist()
    try:
        yield _named(values, frame)
    finally:
        values.unpersist()


#: Checks of single values, each counted over the rows of the values that pass.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "integer": is_integer, "decimal": is_decimal, "european_decimal": is_european, "boolean": is_boolean,
    "email": lambda v: v.contains("@") & v.rlike(EMAIL), "url": lambda v: v.rlike(URL), "currency": lambda v: v.rlike(CURRENCY_VALUE), "percentage": lambda v: v.endswith("%") & v.rlike(PERCENT_VALUE),
}
_STATS = ("min", "max", "mean", "stddev")


def _maybe_date(v: Column) -> Column:
    """Whether a value has a sign that some date format has (its first sign that is no letter); values without one are no dates."""
    signs = {m[0] if (m := re.search(r"[^%\w]", fmt)) else None for fmt in DATE_LABELS}
    return F.lit(True) if None in signs else F.translate(v, "".join(sorted(signs)), "") != v


def _numbers(v: Column) -> dict[str, Column]:
    """A value as a number in either way of writing one; null if it is none. Without dots and commas both are the same."""
    ways = {"plain": F.translate(_unmarked(v), ",", ""), "european": F.translate(_unmarked(v), ",.", ".")}
    read = {way: F.when(x.rlike(FLOAT), F.translate(x, "_", "").try_cast("double")) for way, written in ways.items() for x in [F.trim(written)]}
    return read | {"european": F.when(v.contains(",") | v.contains("."), read["european"])}


def tallied(values: DataFrame) -> DataFrame:
    """Per column, in one pass over its values: rows, nulls, blanks, lengths, the rows of each check and date format, and min, max, mean and deviation of its numbers in either way of writing.

    Values are summed up by column and number of rows first, so that moments are Spark's own of single values, which lose no digits;
    a column of r rows has less than sqrt(2 r) different numbers, and these groups are joined by weight.
    """
    v, n, given = F.col("value"), F.col("n"), ~F.col("missing")
    tests = {c: test(v) for c, test in CHECKS.items()} | {f"date_{i}": F.col("dated") & parses_date(v, fmt) for i, fmt in enumerate(DATE_LABELS)}
    marked = values.select("*", _maybe_date(v).alias("dated"), (v.contains(",") | v.contains(".")).alias("pointed"), *[F.when(given, x).alias(way) for way, x in _numbers(v).items()])
    european = F.when(F.col("pointed"), F.col("european")).otherwise(F.col("plain")).alias("european")
    shown = marked.select("ordinal", "name", "n", "missing", "blank", F.length("value").alias("length"), *[(given & test).alias(c) for c, test in tests.items()], "plain", european)
    moments = {f"{way}_{k}": f(way) for way in ("plain", "european") for k, f in {"k": F.count, "min": F.min, "max": F.max, "avg": F.avg, "var": F.var_pop}.items()}
    groups = shown.groupBy("ordinal", "name", "n").agg(
        F.count("*").alias("k"), F.count_if(given).alias("k_given"), F.count_if("blank").alias("k_blank"),
        F.min(F.when(given, F.col("length"))).alias("least"), F.max(F.when(given, F.col("length"))).alias("most"),
        *[F.count_if(c).alias(f"k_{c}") for c in tests], *[f.alias(c) for c, f in moments.items()],
    )
    whole = Window.partitionBy("ordinal")
    read = {way: n * F.col(f"{way}_k") for way in ("plain", "european")}
    means = [(F.sum(k * F.col(f"{way}_avg")).over(whole) / F.nullif(F.sum(k).over(whole), F.lit(0))).alias(f"{way}_mean") for way, k in read.items()]

    def rows(c: str) -> Column:
        return F.coalesce(F.sum(n * F.col(c)), F.lit(0))

    def moment(way: str) -> Column:
        apart = F.sum(read[way] * (F.col(f"{way}_var") + F.pow(F.col(f"{way}_avg") - F.col(f"{way}_mean"), 2)))
        found = F.min(f"{way}_min"), F.max(f"{way}_max"), F.first(f"{way}_mean"), F.sqrt(apart / F.nullif(F.sum(read[way]), F.lit(0)))
        return F.struct(*[F.round(x, 6).alias(c) for c, x in zip(_STATS, found)]).alias(way)

    return groups.select("*", *means).groupBy("ordinal", "name").agg(
        rows("k").alias("row_count"), (rows("k") - rows("k_given")).alias("null_count"), rows("k_blank").alias("blank_count"), F.sum("k_given").alias("distinct_count"),
        F.coalesce(F.min("least"), F.lit(0)).alias("min_length"), F.coalesce(F.max("most"), F.lit(0)).alias("max_length"),
        F.nullif(rows("k_given"), F.lit(0)).alias("total"), *[rows(f"k_{c}").alias(c) for c in tests], moment("plain"), moment("european"),
    )


def folded(values: DataFrame) -> DataFrame:
    """Per column: how many values are distinct when their case is folded. Values without case are equal to no others and are counted where they are."""
    v = F.col("value")
    key = F.when((F.lower(v) != v) | (F.upper(v) != v), F.lower(v)).alias("folded")
    found = values.filter(~F.col("missing")).groupBy("ordinal", key).agg(F.count("*").alias("k"))
    return found.groupBy("ordinal").agg(F.sum(F.when(F.col("folded").isNull(), F.col("k")).otherwise(F.lit(1))).alias("normalized_distinct_count"))


def _counted(tally: DataFrame, folds: DataFrame) -> DataFrame:
    total = F.col("row_count") - F.col("null_count")
    return tally.join(F.broadcast(folds), "ordinal", "left").withColumns({
        "null_rate": F.round(F.col("null_count") / F.col("row_count"), 4),
        "normalized_distinct_count": F.coalesce("normalized_distinct_count", F.lit(0)),
        "cardinality_ratio": F.coalesce(F.round(F.col("distinct_count") / F.when(total > 0, total), 4), F.lit(0.0)),
    })


def counts(values: DataFrame) -> DataFrame:
    """Per column: rows, nulls, blanks, distinct values, lengths (null tokens count as null)."""
    return _counted(tallied(values), folded(values)).select(
        "ordinal", "name", "row_count", "null_count", "null_rate", "blank_count", "distinct_count", "normalized_distinct_count", "cardinality_ratio", "min_length", "max_length"
    )


def _ranked_dates() -> Column:
    each = [F.struct((-F.col(f"date_{i}")).alias("order"), F.lit(fmt).alias("format"), F.lit(label).alias("label"), F.col(f"date_{i}").alias("parsed")) for i, (fmt, label) in enumerate(DATE_LABELS.items())]
    found = F.slice(F.sort_array(F.filter(F.array(*each), lambda d: d["parsed"] > 0)), 1, DATE_CANDIDATES)
    return F.transform(found, lambda d: F.struct(d["format"].alias("format"), d["label"].alias("label"), d["parsed"].alias("parsed"), F.round(d["parsed"] / F.col("total"), 4).alias("pct")))


def _typed(tally: DataFrame) -> DataFrame:
    """A tally with shares of checks, date formats by rank, and the inferred type."""
    tested = tally.withColumn("date_candidates", _ranked_dates())
    best = F.coalesce(F.get("date_candidates", F.lit(0))["pct"], F.lit(0.0))
    shared = tested.select("*", *[F.round(F.col(c) / F.col("total"), 4).alias(f"p_{c}") for c in CHECKS], best.alias("p_date"))
    order = ("integer", "decimal", "european_decimal", "boolean", "date")
    share = {c: F.col(f"p_{c}") for c in order}
    top = F.greatest(*share.values())
    inferred, confidence = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0.0))
    for c in ("boolean", "integer", "date", "european_decimal", "decimal"):
        inferred, confidence = inferred.when(share[c] >= 0.95, F.lit(c)), confidence.when(share[c] >= 0.95, share[c])
    for c in order:  # the first of equals
        good = (share[c] == top) & (top >= 0.6)
        inferred, confidence = inferred.when(good, F.lit(c)), confidence.when(good, share[c])
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), share[c].alias("value")) for c in order]), lambda e: e["value"] > 0)
    dates = F.col("date_candidates.parsed")
    return shared.withColumns({
        "type_candidates": F.map_from_entries(entries),
        "inferred_type": inferred.otherwise(F.lit("string")), "type_confidence": confidence.otherwise(F.lit(1.0)),
        "date_ambiguous": (F.size(dates) > 1) & (F.get(dates, F.lit(0)) == F.get(dates, F.lit(1))),
    })


_TYPED = ("total", *[f"p_{c}" for c in ("integer", "decimal", "european_decimal", "boolean", "date", "email", "url", "currency", "percentage")], "type_candidates", "inferred_type", "type_confidence", "date_candidates", "date_ambiguous")


def types(values: DataFrame) -> DataFrame:
    """Per column: the share of values that pass each check, the inferred type, its confidence, and date formats by rank."""
    return _typed(tallied(values)).filter("total > 0").select("ordinal", *_TYPED)


def _chosen() -> Column:
    """The numbers of a tally in the way of writing that the inferred type has; null where that is no number or none can be read."""
    found = F.when(F.col("inferred_type") == "european_decimal", F.col("european")).when(F.col("inferred_type").isin(*NUMERIC), F.col("plain"))
    return F.when(found["min"].isNotNull(), found)


def numeric(values: DataFrame, inferred: DataFrame) -> DataFrame:
    """Per numeric column: min, max, mean and population deviation of what can be read."""
    tally = tallied(values).select("ordinal", "plain", "european")
    chosen = tally.join(F.broadcast(inferred.select("ordinal", "inferred_type")), "ordinal").select("ordinal", _chosen().alias("numeric"))
    return chosen.filter("numeric is not null").select("ordinal", *[F.col(f"numeric.{c}") for c in _STATS])


def _foremost(values: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each column with their place; of equals, the first to appear.

    A column's values are dealt to parts, each part keeps its k foremost, and these alone meet in one task.
    """
    given, order = values.filter(~F.col("missing")), (F.desc("n"), "first", "value")
    part = F.pmod(F.xxhash64("value"), F.lit(PARTS))
    near = given.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("ordinal", "part").orderBy(*order))).filter(F.col("place") <= k)
    return near.withColumn("place", F.row_number().over(Window.partitionBy("ordinal").orderBy(*order))).filter(F.col("place") <= k)


def top_values(values: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """ordinal, rank, value, count of the most frequent values; of equals, the first to appear."""
    rank = F.row_number().over(Window.partitionBy("ordinal").orderBy(F.desc("n"), "first", "value"))
    return values.filter(~F.col("missing")).withColumn("rank", rank).filter(F.col("rank") <= k).select("ordinal", "rank", "value", F.col("n").alias("count"))


def _shapes(places: DataFrame) -> DataFrame:
    """ordinal, pattern, count, place, rank of each mask; covered: the rows of all; tops: the foremost values that have it."""
    foremost = F.when(F.col("place") <= TOP_VALUES, F.struct(F.col("place").alias("rank"), "value", F.col("n").alias("count")))
    tally = places.groupBy("ordinal", mask(F.col("value")).alias("pattern")).agg(F.sum("n").alias("count"), F.min("place").alias("place"), F.collect_list(foremost).alias("tops"))
    order = F.row_number().over(Window.partitionBy("ordinal").orderBy(F.desc("count"), "place"))
    return tally.select("*", order.alias("rank"), F.sum("count").over(Window.partitionBy("ordinal")).alias("covered"))


def patterns(values: DataFrame, k: int = PATTERNS, masked: int = MASKED_VALUES) -> DataFrame:
    """ordinal, rank, pattern, count, first of the commonest masks."""
    return _shapes(_foremost(values, masked)).filter(F.col("rank") <= k).select("ordinal", "rank", "pattern", "count", "covered")


def semantics(c: DataFrame) -> Column:
    """Tags in a fixed order, from counts joined with types."""
    folded, total = F.col("normalized_distinct_count"), F.col("total")
    tags = [
        ("email", F.col("p_email") > 0.8),
        ("url", F.col("p_url") > 0.8),
        ("currency", F.col("p_currency") > 0.6),
        ("percentage", F.col("p_percentage") > 0.6),
        ("european_decimal", F.col("p_european_decimal") > 0.5),
        ("date", F.col("p_date") > 0.7),
        ("boolean", (F.col("p_boolean") > 0.9) & (folded <= 3)),
        ("enum", (folded <= 20) & (folded / total < 0.6) & (total >= 3)),
        ("identifier", (F.col("cardinality_ratio") > 0.9) & (F.col("distinct_count") > 3) & (total >= 10)),
        ("inconsistent_case", folded < F.col("distinct_count")),
    ]
    return F.array_compact(F.array(*[F.when(holds, F.lit(tag)) for tag, holds in tags]))


class ProfileState:
    """Counted values of a source whose files come one by one, kept as a table: a new file is counted alone and added.

    Counts of a value add up and its first row is the first of all, so the profile of
    the state is that of all files together, and no file is read again. A file that is
    added a second time replaces its own part. ``compact`` brings parts together.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, frame: DataFrame, number: int) -> None:
        """Counts a file's values. number: its place among the source's files (rows of a file come after those of files of smaller numbers)."""
        counted = distinct_values(frame).withColumn("first", F.col("first") + F.lit(number << 40))
        counted.write.mode("overwrite").parquet(f"{self.folder}/part={number}")

    def values(self) -> DataFrame:
        """As distinct_values over all files."""
        parts = self.spark.read.parquet(self.folder)
        return parts.groupBy("ordinal", "name", "value", "missing", "blank").agg(F.sum("n").alias("n"), F.min("first").alias("first"))

    def compact(self, folder: str) -> ProfileState:
        """The same state as one part in another folder."""
        self.values().write.parquet(f"{folder.rstrip('/')}/part=0")
        return ProfileState(self.spark, folder)

    def profile(self) -> DataFrame:
        return profile(self.spark.createDataFrame([], f"{SRC_ROW} long"), self.values())


def profile(frame: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """One row per column with all measures, nested lists of structs included.

    values: the frame's distinct_values, where the caller has written them or keeps them
    (see ``counted`` and ``profiles``). Without it they are counted in this plan, for each of its parts.
    """
    if values is None:
        values = distinct_values(frame)
    base = _typed(_counted(tallied(values), folded(values))).withColumn("numeric", _chosen())
    given = F.coalesce("total", F.lit(0))
    common = F.when(F.col("rank") <= PATTERNS, F.struct("rank", "pattern", "count"))
    shaped = _shapes(_foremost(values, MASKED_VALUES)).groupBy("ordinal").agg(F.sort_array(F.flatten(F.collect_list("tops"))).alias("tops"), F.sort_array(F.collect_list(common)).alias("masks"), F.max("covered").alias("covered"))
    whole = base.join(shaped, "ordinal", "left")
    some = F.coalesce("tops", F.array().cast("array<struct<rank:int,value:string,count:bigint>>"))
    shapes = F.coalesce("masks", F.array().cast("array<struct<rank:int,pattern:string,count:bigint>>"))
    return whole.select(
        "name", "ordinal", "row_count", "null_count", "null_rate", "blank_count", "distinct_count", "normalized_distinct_count", "cardinality_ratio",
        F.coalesce("inferred_type", F.lit("string")).alias("inferred_type"),
        F.coalesce("type_confidence", F.lit(1.0)).alias("type_confidence"),
        F.coalesce("type_candidates", F.create_map().cast("map<string,double>")).alias("type_candidates"),
        "min_length", "max_length", "numeric",
        F.coalesce("date_candidates", F.array().cast("array<struct<format:string,label:string,parsed:bigint,pct:double>>")).alias("date_candidates"),
        F.coalesce("date_ambiguous", F.lit(False)).alias("date_ambiguous"),
        F.transform(some, lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"), F.round(t["count"] / given, 4).alias("pct"))).alias("top_values"),
        F.transform(shapes, lambda t: F.struct(t["pattern"].alias("pattern"), t["count"].alias("count"), F.round(t["count"] / F.col("covered"), 4).alias("pct"))).alias("patterns"),
        F.coalesce(F.round(F.col("covered") / given, 4), F.lit(0.0)).alias("pattern_coverage"),
        F.when(given > 0, semantics(whole)).otherwise(F.array().cast("array<string>")).alias("semantics"),
        F.slice(some["value"], 1, SAMPLES).alias("samples"),
    ).orderBy("ordinal")


def profiles(frame: DataFrame) -> list[dict]:
    """``profile`` as a dict per column, as the proposer takes them. The values are counted once and kept for all measures."""
    with counted(frame) as values:
        return [r.asDict(recursive=True) for r in profile(frame, values).collect()]
