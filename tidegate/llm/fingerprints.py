"""Document fingerprints by consistent weighted sampling (operator 10).

The terms of a text are its words, weighted by how often they occur. For each
sample k a term's hash gives r and c, both Gamma(2, 1), and b, uniform:

    t = floor(ln(weight) / r + b),   ln a = ln c - r (t - b) - r

and the sample of the text is the (term, t) with the smallest a. Two texts have
the same sample with a probability equal to their generalised Jaccard
similarity, the sum of smaller weights over the sum of larger ones. All of it is
DataFrame expressions.

Documents are range-partitioned into buckets of neighbouring ids. In descending
order of ids, a row's next document is then in the same bucket, but for the last
row of one, which a copied first row of the next bucket stands in for. Rows without
an id have buckets of their own, by a hash of their texts. Terms are counted and
sampled where the bucket lies, with no further shuffle of words.

Defined cases: a null text counts as empty; texts without words have the empty
fingerprint, equal to each other (likeness 1) and unlike all others (0); rows
with null ids come last, in the order of a hash of their texts; equal ids are ordered by text, and
repeated rows are each fingerprinted; a very long text is one row's words like any other; one document is its own next; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm._common import WORD_GAP, range_bounds, range_bucket, stored

SAMPLES = 32
#: Samples that are drawn together; SAMPLES is a multiple.
CHUNK = 4
#: Documents of neighbouring ids that are worked on together, and the most such buckets.
BUCKET_ROWS = 256
MOST_BUCKETS = 1 << 16
TASK_BYTES = 4 << 20


def _unit(bits: Column, width: int) -> Column:
    """A number inside (0, 1) from the lowest bits."""
    return (bits.bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) * F.lit(2.0**-width)


def drawn(k: int) -> list[Column]:
    """Columns r, c (its logarithm), b and x (64 other bits) of sample 4 chunk + k of the column ``term``."""
    one = F.xxhash64("term", "chunk", F.lit(k))
    two = F.xxhash64(one)
    r = -F.log(_unit(one, 21) * _unit(F.shiftrightunsigned(one, 21), 21))
    c = F.log(-F.log(_unit(two, 32) * _unit(F.shiftrightunsigned(two, 32), 32)))
    return [r.alias(f"r{k}"), c.alias(f"c{k}"), _unit(F.shiftrightunsigned(one, 42), 21).alias(f"b{k}"), two.alias(f"x{k}")]


def sample(k: int, side: str) -> Column:
    """ln a in the upper 32 bits (shifted and cut to 2**-20), bits of (term, t) in the lower: its minimum is the sample."""
    r, c, b, x = (F.col(f"{name}{k}") for name in "rcbx")
    t = F.floor(F.col(f"ln_{side}") / r + b)
    height = ((c - r * (t - b) - r + F.lit(1024.0)) * F.lit(2.0**20)).cast("long")
    mixed = (x + t * F.lit(0x632BE59B)).bitwiseXOR(F.shiftrightunsigned(x, 32))
    return F.when(F.col(side) > 0, F.shiftleft(height, 32).bitwiseOR(mixed.bitwiseAND(F.lit(0xFFFFFFFF))))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, place, doc_id, text, n_chars, next_text, next_bucket, next_place of each document, in descending order of ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    bounds = range_bounds(rows, "doc_id", min(MOST_BUCKETS, told.rows // BUCKET_ROWS + 1))
    # Rows without an id: buckets -1, -2 and so on, equal ranges of the upper half of a hash.
    spread = min(MOST_BUCKETS, told.nulls // BUCKET_ROWS + 1)
    null_bucket = F.lit(-1) - F.shiftright(F.shiftrightunsigned(F.xxhash64("text"), 32) * F.lit(spread), 32).cast("int")
    bucket = F.when(F.col("doc_id").isNull(), null_bucket).otherwise(range_bucket(F.col("doc_id"), bounds))
    place = F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(F.xxhash64("text"), 32))
    dealt = rows.withColumn("bucket", bucket).withColumn("null_place", place)
    # The first row of each bucket: ids (or hashes) first, then the texts of those few.
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("head_id"), F.min("null_place").alias("head_place"))
    # At most 2 x MOST_BUCKETS rows of three numbers, some megabytes: the texts are not moved for them.
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & F.col("null_place").eqNullSafe(F.col("head_place"))
    texts = dealt.withColumnRenamed("bucket", "head_bucket").join(F.broadcast(heads), (F.col("bucket") == F.col("head_bucket")) & same)
    first = texts.groupBy("bucket").agg(F.min("text").alias("text"))
    down = Window.orderBy(F.col("bucket").desc())  # over at most MOST_BUCKETS rows
    wrap = F.first("bucket").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    links = heads.select(F.col("bucket").alias("bucket"), F.coalesce(F.lead("bucket").over(down), wrap).alias("origin"))
    guests = links.join(first.withColumnRenamed("bucket", "origin"), "origin").select(F.lit(None).cast("long").alias("doc_id"), "text", "bucket", "origin", F.lit(True).alias("guest"))
    guests = guests.withColumn("null_place", F.lit(None).cast("long"))
    both = dealt.select("doc_id", "null_place", "text", "bucket", F.col("bucket").alias("origin"), F.lit(False).alias("guest")).unionByName(guests)
    # A task counts the terms of about TASK_BYTES of text, or of one bucket where that is more; more tasks than buckets would have nothing to do.
    tasks = min(told.bytes // TASK_BYTES + 1, len(bounds) + 1 + spread)
    both = both.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks), "bucket")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "null_place", "text")
    ordered = both.select(
        "bucket",
        "doc_id",
        "text",
        "guest",
        F.row_number().over(order).alias("place"),
        F.lead("text").over(order).alias("next_text"),
        F.lead("origin").over(order).alias("next_bucket"),
        F.lead("guest").over(order).alias("next_guest"),
    ).filter(~F.col("guest"))
    next_place = F.when(F.col("next_guest"), F.lit(1)).otherwise(F.col("place") + 1)
    return ordered.select("bucket", "place", "doc_id", "text", F.length("text").alias("n_chars"), "next_text", "next_bucket", next_place.alias("next_place"))


def edited(text: Column, n_chars: Column, next_text: Column) -> Column:
    half = F.expr("n_chars div 2").cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars - half), F.substring(next_text, F.lit(1), half))


def signatures(rows: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """bucket, place, ``told`` (a struct) and both samples of each row (arrays; null for a side without words).

    What is told of a row goes through the aggregations beside its words, as a
    term that weighs nothing, so that the texts are moved once.
    """
    keep = F.col("n_chars") - F.expr("n_chars div 2").cast("int")
    # Words before the cut belong to both texts and are sent once.
    shared = F.regexp_extract(F.substring("text", F.lit(1), keep), r"^[\s\S]*[\x20\x09-\x0D]", 0)
    cut = rows.select("bucket", "place", "text", "n_chars", "next_text", "told", keep.alias("keep"), shared.alias("shared"))
    start = F.length("shared") + 1
    nothing = F.when(F.lit(False), F.col("told"))
    parts = cut.select(
        "bucket",
        "place",
        F.inline(
            F.array(
                *[
                    F.struct(part.alias("words"), F.lit(own).alias("own"), F.lit(new).alias("new"), told.alias("told"))
                    for part, own, new, told in (
                        (F.lit("-"), 0, 0, F.col("told")),
                        (F.col("shared"), 1, 1, nothing),
                        (F.substring("text", start, F.col("n_chars")), 1, 0, nothing),
                        (F.concat(F.substring("text", start, F.col("keep") - start + 1), F.substring("next_text", F.lit(1), F.col("n_chars") - F.col("keep"))), 0, 1, nothing),
                    )
                ]
            )
        ),
    )
    words = parts.select("bucket", "place", "told", "own", "new", F.explode(F.split("words", WORD_GAP)).alias("word")).filter("word <> ''")
    terms = words.groupBy("bucket", "place", "told", F.xxhash64("word").alias("term")).agg(F.sum("own").alias("own"), F.sum("new").alias("new"))
    sides = ("own", "new")
    logs = [F.log(F.col(side).cast("double")).alias(f"ln_{side}") for side in sides]
    # Samples are drawn in chunks of CHUNK columns: generated code of all at once would be too large to be compiled well.
    chunks = F.array(*[F.lit(c) for c in range(samples // CHUNK)])
    chunked = terms.select("*", *logs, F.explode(F.when(F.col("told").isNull(), chunks).otherwise(F.array(F.lit(0)))).alias("chunk"))
    wide = chunked.select("bucket", "place", "told", "chunk", *sides, *[f"ln_{side}" for side in sides], *[column for k in range(CHUNK) for column in drawn(k)])
    least = wide.groupBy("bucket", "place", "told", "chunk").agg(*[F.min(sample(k, side)).alias(f"{side}{k}") for side in sides for k in range(CHUNK)])

    def four(side: str) -> Column:
        return F.array(*[F.col(f"{side}{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(CHUNK)])

    sampled = F.when(F.col("told").isNull(), F.struct("chunk", *[four(side).alias(side) for side in sides]))
    listed = least.groupBy("bucket", "place").agg(F.sort_array(F.collect_list(sampled)).alias("parts"), F.max("told").alias("told"))

    def joined(side: str) -> Column:
        whole = F.flatten(F.col(f"parts.{side}"))
        return F.when(F.get(whole, F.lit(0)).isNotNull(), whole).alias(side)

    return listed.select("bucket", "place", "told", *[joined(side) for side in sides])


def likeness(a: str, b: str, samples: int) -> Column:
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.col(a).isNull() & F.col(b).isNull(), F.lit(1.0)).otherwise(F.coalesce(equal / F.lit(float(samples)), F.lit(0.0)))


def written(samples: str) -> Column:
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def fingerprint(docs: DataFrame, samples: int = SAMPLES, **columns: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document."""
    rows = neighbours(docs, **columns)
    digest = F.sha2(edited(F.col("text"), F.col("n_chars"), F.col("next_text")), 256)
    told = F.struct("doc_id", "n_chars", digest.alias("edited_sha256"), "next_bucket", "next_place")
    made = stored(signatures(rows.withColumn("told", told), samples).select("bucket", "place", "told.*", "own", "new"))
    nexts = made.select(F.col("bucket").alias("next_bucket"), F.col("place").alias("next_place"), F.col("own").alias("next_own"))
    return made.join(nexts, ["next_bucket", "next_place"], "left").select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        written("own").alias("fingerprint"),
        written("new").alias("edited_fingerprint"),
        likeness("own", "new", samples).alias("near_edited"),
        likeness("own", "next_own", samples).alias("near_next"),
    )
