"""Mixing sources to target weights (operator 8).

Each source's documents, laid end to end, are cut into blocks of LENGTH words.
A source's target in words fixes how many block slots it gets. The slots are
spread over output shards by multinomial draws given these totals: a tree of
splits, seeded by node, from which each task finds the counts of its own shards
alone. So a source's words are what its target says, and the draws decide in which
shards a document's words lie. Slot i of a source takes the block that a pseudorandom permutation (a
Feistel network on the block numbers, one key per source and epoch) gives for i,
and blocks are joined to slots by number.

A source is passed over epoch by epoch, so the times a block is taken differ by
one at most; the last slot takes only the words that are still missing.

Defined cases: a null text has no words; null is a source of its own, the last
one; sources without words have target 0; repeated rows each have their own
place and their own words taken; a very long text spans many blocks; an empty table gives an empty result; other
columns of the input are ignored. Sources are metadata: more than MAX_SOURCES
raise an error instead of being collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm._common import WORD_GAP, stored

LENGTH = 512
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST_EPOCHS = 3
#: Slots of an output shard, and shards that a task fills together.
SHARD_SLOTS, TASK_SHARDS = 1 << 8, 1 << 6
SEED = 17
MAX_SOURCES = 100_000
#: Places of a source's documents are summed within hash buckets of about BUCKET_ROWS rows, of which there are BUCKETS at least, then over them.
BUCKETS, BUCKET_ROWS = 1024, 100_000
#: Slots from which numpy can draw.
LIBRARY_SLOTS = 1_000_000_000


def _round(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x ^ key) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(seed)).integers(0, 1 << 63, 6, np.uint64)


def permuted(index: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Places of ``index`` under a pseudorandom permutation of 0..n-1 (or under its inverse)."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    shift, low = np.uint64(half), np.uint64((1 << half) - 1)
    keys = _keys(seed)[::-1] if inverse else _keys(seed)
    x = np.array(index, np.uint64)
    todo = np.arange(len(x))
    while len(todo):  # numbers that fall outside go round again; under 4 rounds on average
        left, right = x[todo] >> shift, x[todo] & low
        for key in keys:
            if inverse:
                left, right = right ^ (_round(left, key) & low), left
            else:
                left, right = right, left ^ (_round(right, key) & low)
        x[todo] = left << shift | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """How a source is taken: blocks, slots, and words of its last slot."""

    sid: int
    blocks: int
    slots: int
    last_take: int

    def seed(self, epoch: int) -> int:
        return (SEED * 1_000_003 + self.sid) * 16 + epoch


def plan(sid: int, words: int, target: int, length: int = LENGTH) -> Plan:
    blocks = -(-words // length)
    if not blocks or not target:
        return Plan(sid, blocks, 0, 0)
    epochs, rest = divmod(target, words)
    short = words - (blocks - 1) * length
    if not rest:
        return Plan(sid, blocks, epochs * blocks, length)
    at = int(permuted(np.array([blocks - 1]), blocks, Plan(sid, 0, 0, 0).seed(epochs), inverse=True)[0])
    if rest <= at * length:
        slots = -(-rest // length)
        last = rest - (slots - 1) * length
    elif rest <= at * length + short:
        slots, last = at + 1, rest - at * length
    else:
        slots = -(-(rest - short) // length) + 1
        last = rest - short - (slots - 2) * length
    return Plan(sid, blocks, epochs * blocks + slots, last)


def drawn(held: np.ndarray, part: int, generator: np.random.Generator) -> np.ndarray:
    """How many of ``part`` slots each source gets if they are drawn without replacement from ``held`` slots of each.

    One source after another, each given what the ones before have left. The
    library's draw holds below LIBRARY_SLOTS; of more slots, few are as good as drawn
    independently, and the number of many is normal.
    """
    out, size = np.zeros_like(held), int(held.sum())
    for k, own in enumerate(held.tolist()):
        least, most = max(0, part - (size - own)), min(own, part)
        if size < LIBRARY_SLOTS:
            n = int(generator.hypergeometric(own, size - own, part)) if own and part else 0
        elif own < LIBRARY_SLOTS // 1000:
            n = int(generator.binomial(own, part / size))
        else:
            share = own / size
            n = round(part * share + generator.standard_normal() * (part * share * (1 - share) * ((size - part) / max(size - 1, 1))) ** 0.5)
        out[k] = n = min(max(n, least), most)
        size, part = size - own, part - n
    return out


def shard_counts(totals: np.ndarray, shards: int, first: int, last: int, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard from first up to last (not included): shard, each source's first slot and number of slots.

    Splits that the shards share are drawn once.
    """
    todo = [(1, 0, shards, np.zeros_like(totals), totals)]
    while todo:
        node, lo, hi, before, held = todo.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield lo, before, held
            continue
        mid = (lo + hi) // 2
        left = drawn(held, int(held.sum()) * (mid - lo) // (hi - lo), np.random.Generator(np.random.Philox(key=seed, counter=[node & (2**64 - 1), 0, 0, node >> 64])))
        todo.append((2 * node + 1, mid, hi, before + left, held - left))
        todo.append((2 * node, lo, mid, before, left))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.xxhash64(text).alias("text_hash"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, sid, source_size, target: shares by weight, with excess over the ceiling reshared.

    Sources are taken in order of ceiling / weight; each is at its ceiling if
    what the ones before leave, shared by weight, would reach it.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("sid") % len(weights) + 1).cast("double")
    wide = ranked.withColumn("weight", weight).withColumn("ceiling", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = wide.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("ceiling"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("ceiling") / F.col("weight"), "sid", "level"))).over(every)["level"]
    target = F.when(F.col("full"), F.col("ceiling")).otherwise(F.least(F.col("ceiling"), F.coalesce(rest, F.lit(0.0)) * F.col("weight")))
    return levelled.select("source", F.col("sid").cast("int").alias("sid"), "source_size", target.alias("target"))


def _placed(rows: DataFrame, sources: DataFrame, n_rows: int) -> DataFrame:
    """Adds each document's first word's place in its source; no task holds a whole source.

    Rows of one source, id and text are alike, so they are counted before they move and lined
    up as one, and told apart (``row``) afterwards: however many there are, no bucket holds more for it.
    """
    equal = rows.groupBy("source", "doc_id", "text_hash", "size").agg(F.count("*").alias("rows"))
    joined = equal.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    dealt = joined.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(max(BUCKETS, n_rows // BUCKET_ROWS))))
    whole = F.col("size") * F.col("rows")
    sums = dealt.groupBy("sid", "bucket").agg(F.sum(whole).alias("bucket_size"))
    over = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(over), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = dealt.withColumn("before", F.coalesce(F.sum(whole).over(inside), F.lit(0)))
    # Both sides are dealt by source and bucket already, and starts grow with the sources, so nothing is sent to all tasks.
    first = lined.join(starts.hint("merge"), ["sid", "bucket"]).withColumn("first", F.col("bucket_start") + F.col("before"))
    # Very many equal rows are told apart in two steps, each of which makes at most the root of their number from one row.
    step = F.ceil(F.sqrt(F.col("rows").cast("double"))).cast("long")
    coarse = first.withColumn("step", step).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.col("step"))))
    each = coarse.withColumn("row", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + F.col("step"), F.col("rows")) - 1)))
    return each.withColumn("start", F.col("first") + F.col("row") * F.col("size")).drop("before", "bucket_start", "first", "step", "from", "rows")


def slots(spark, plans: list[Plan], length: int = LENGTH) -> DataFrame:
    """One row per slot: shard, sid, slot, block, take (words of the block that are taken)."""
    totals = np.array([p.slots for p in plans], np.int64)
    shards = max(1, -(-int(totals.sum()) // SHARD_SLOTS))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("task").to_pylist():
                for shard, first, count in shard_counts(totals, shards, task * TASK_SHARDS, (task + 1) * TASK_SHARDS):
                    for p, lo, n in zip(plans, first.tolist(), count.tolist()):
                        if not n:
                            continue
                        slot = np.arange(lo, lo + n)
                        epoch = slot // p.blocks
                        block = np.empty(n, np.int64)
                        for e in np.unique(epoch):
                            block[epoch == e] = permuted(slot[epoch == e] % p.blocks, p.blocks, p.seed(int(e)))
                        take = np.full(n, length)
                        take[slot == p.slots - 1] = p.last_take
                        yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(n, shard), pa.int64()), "sid": pa.array(np.full(n, p.sid), pa.int32()), "slot": pa.array(slot), "block": pa.array(block), "take": pa.array(take, pa.int64())})

    n_tasks = -(-shards // TASK_SHARDS)
    tasks = spark.range(0, n_tasks, 1, min(n_tasks, 2000)).withColumnRenamed("id", "task")
    return tasks.mapInArrow(fill, "shard long, sid int, slot long, block long, take long")


def _pieces(placed: DataFrame, length: int) -> DataFrame:
    """Documents cut at block bounds: block, and the words [low, high) of the block that are theirs."""
    last = F.greatest(F.col("start") + F.col("size") - 1, F.col("start"))
    each = F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {length}"), (last / length).cast("long"))))
    cut = placed.withColumn("block", each)
    low = F.greatest(F.col("start") - F.col("block") * length, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * length, F.lit(length))
    return cut.withColumn("low", low).withColumn("high", high)


@dataclass(frozen=True)
class Mix:
    """plans: one per source; placed: documents; taken: pieces with the times they are taken."""

    plans: list[Plan]
    sources: DataFrame
    placed: DataFrame
    slots: DataFrame
    taken: DataFrame


def mix(docs: DataFrame, length: int = LENGTH, **columns: str) -> Mix:
    rows = stored(sized(docs, **columns))
    sources = stored(targets(rows))
    listed = sources.select("sid", "source_size", "target").limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plans = [plan(r.sid, r.source_size, min(round(r.target), MOST_EPOCHS * r.source_size), length) for r in sorted(listed, key=lambda r: r.sid)]
    placed = _placed(rows, sources, rows.count())
    chosen = slots(docs.sparkSession, plans, length)
    whole = F.count_if(F.col("take") == length)
    by_block = chosen.groupBy("sid", "block").agg(
        whole.alias("times"), F.coalesce(F.max(F.when(F.col("take") < length, F.col("take"))), F.lit(0)).alias("part"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard")
    )
    taken = _pieces(placed, length).join(by_block.hint("merge"), ["sid", "block"], "left")
    return Mix(plans, sources, placed, chosen, taken)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard and last_shard (of the output shards that got words of it) of each document."""
    pieces = mix(docs, **options).taken
    part = F.greatest(F.least(F.col("high"), F.col("part")) - F.col("low"), F.lit(0))
    words = F.coalesce(F.col("times") * (F.col("high") - F.col("low")) + part, F.lit(0))
    by_doc = pieces.groupBy("sid", "doc_id", "text_hash", "row").agg(*[F.first(c).alias(c) for c in ("size", "source_size", "target")], F.sum(words).alias("taken"), F.min(F.when(words > 0, F.col("first_shard"))).alias("first_shard"), F.max(F.when(words > 0, F.col("last_shard"))).alias("last_shard"))
    return by_doc.select("doc_id", "size", "source_size", "target", "taken", "first_shard", "last_shard")


def mixed_blocks(docs: DataFrame, length: int = LENGTH, **columns: str) -> DataFrame:
    """The mixture itself: shard, slot, sid, and the words of the slot's block in document order."""
    made = mix(docs, length, **columns)
    names = {"id_col": "doc_id", "text_col": "text"} | columns
    words = F.filter(F.split(F.coalesce(F.col(names["text_col"]), F.lit("")), WORD_GAP), lambda w: w != "")
    texts = docs.select(F.col(names["id_col"]).alias("doc_id"), F.xxhash64(F.coalesce(F.col(names["text_col"]), F.lit(""))).alias("text_hash"), words.alias("words")).dropDuplicates(["doc_id", "text_hash"])
    pieces = _pieces(made.placed, length).filter("size > 0").join(texts, ["doc_id", "text_hash"])
    cut = F.slice("words", (F.col("block") * length + F.col("low") - F.col("start") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    listed = pieces.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("low", cut.alias("words")))).alias("pieces"))
    blocks = listed.select("sid", "block", F.flatten(F.col("pieces.words")).alias("words"))
    return made.slots.join(blocks, ["sid", "block"]).select("shard", "slot", "sid", F.slice("words", F.lit(1), F.col("take").cast("int")).alias("words"))


def mixed_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The mixture as documents: a row per document and pass, with the words that pass takes.

    A document that is taken whole keeps its text as it is; of one that is taken
    in part, the words taken are joined by single spaces. Documents no word of
    which is taken have no row. The columns are those of ``docs``; n_chars, where
    present, is counted anew.
    """
    names = docs.columns
    if "text" not in names:
        raise ValueError("documents need a text")
    made = mix(docs, length)
    place = F.col("block") * length + F.col("low") - F.col("start")
    row = ["source", "doc_id", "text_hash", "row"]
    spans = made.taken.filter("times > 0 or part > low").select(
        *row, "size",
        F.inline(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.col("times") + F.when(F.col("part") > F.col("low"), 1).otherwise(0), F.lit(1))),
                lambda k: F.struct(k.alias("copy"), place.alias("first"), F.when(k <= F.col("times"), F.col("high") - F.col("low")).otherwise(F.least("high", "part") - F.col("low")).alias("n")),
            )
        ),
    )
    copies = spans.groupBy(*row, "copy").agg(F.first("size").alias("size"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("first", "n"))).alias("spans"))
    # Rows, their passes and what is made of them have names of their own, so that the documents' columns may have any.
    listed = copies.groupBy(*row).agg(F.collect_list(F.struct("size", "n", "spans")).alias("copies")).select(F.struct(*row).alias("of"), "copies")
    held = docs.select(F.struct(*[F.col(_quoted(c)) for c in names]).alias("doc"))
    hashed = held.withColumn("hash", F.xxhash64(F.coalesce(F.col("doc.text"), F.lit(""))))
    counted = hashed.withColumn("number", F.row_number().over(Window.partitionBy("doc.source", "doc.doc_id", "hash").orderBy(F.lit(0))) - 1)
    same = F.col("doc.source").eqNullSafe(F.col("of.source")) & F.col("doc.doc_id").eqNullSafe(F.col("of.doc_id")) & (F.col("hash") == F.col("of.text_hash")) & (F.col("number") == F.col("of.row"))
    each = counted.join(listed, same).select("doc", F.explode("copies").alias("copy"))

    def spanned(words: Column) -> Column:
        return F.array_join(F.flatten(F.transform(F.col("copy.spans"), lambda s: F.slice(words, (s["first"] + 1).cast("int"), s["n"].cast("int")))), " ")

    # The words are bound once, as the argument of the outer transform.
    cut = F.get(F.transform(F.array(F.filter(F.split("doc.text", WORD_GAP), lambda w: w != "")), spanned), F.lit(0))
    fresh = each.select("doc", F.when(F.col("copy.n") == F.col("copy.size"), F.col("doc.text")).otherwise(cut).alias("fresh"))
    made_anew = {"text": F.col("fresh"), "n_chars": F.length("fresh").cast("long")}
    return fresh.select(*[made_anew.get(c, F.col(f"doc.{_quoted(c)}")).alias(c) for c in names])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
