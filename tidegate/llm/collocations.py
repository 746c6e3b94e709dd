"""Phrases whose words stand together more often than chance (operator 13).

1. One pass counts words exactly and hashes phrases of two and of three words into two
   sketches, arrays of counters, one hash each. A counter is an upper bound of every
   phrase that falls on it, so a bit per counter tells which phrases can reach the
   least count (for three words, both of their pairs must be able to, too): the
   candidates. Only these bits, of bounded size, go to all tasks.
2. A second pass cuts each shard of text into runs of words that lie in candidates,
   compiles the shard's candidates, guarded by spaces, into Aho-Corasick automata, one for
   each language, scans the runs, and counts overlapping matches. Runs never share a
   word, so no occurrence counts twice. A shard has about SHARD places where a
   candidate begins, so its automata have a bounded size, and no text moves.
3. Counts are summed; thresholds, scores and ranks follow with joins.

Within a shard, words that are counted and phrases that are listed are told apart by
64-bit hashes; phrases are counted by their texts.

Defined cases: a null text is empty; a null language is ``und``, and so joins rows
that say so; very long texts are taken whole; repeated rows each count; ties of
score and count go by the phrase's bytes; without candidates, and for an empty
table, the result is empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm._common import settled, stored
from tidegate.llm._words import Chunk, chunks, mix

#: Fixed values of the contract: least count, percentage that a longer phrase must have to absorb one, size of a report.
LEAST, ABSORBED, TOP = 10, 50, 2000
#: Places of a shard of text where candidates begin, about (a longer run is one shard).
SHARD = 200_000
#: Counters of a sketch move together in blocks. There is one for BYTES_A_COUNTER bytes of text, in whole blocks, and MOST_BLOCKS of them (2 ** 26 counters) at most.
BLOCK, MOST_BLOCKS, BYTES_A_COUNTER = 1 << 16, 1 << 10, 20
#: Bytes of text that are worked on together, and whose words are counted together.
CHUNK, GATHERED = 1 << 20, 4 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x09, 0x20]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of a chunk of texts, lower-cased, a space after each: word k has text[start[k] : end[k]].

    joined: whether the next word is of the same piece. Hashes are of a language's own words and phrases.
    """

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    joined: np.ndarray
    one: np.ndarray
    two: np.ndarray
    three: np.ndarray

    def strings(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The words from first to last (included) of each pair of numbers."""
        lo, size = self.start[first], self.end[last] - self.start[first]
        offsets = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(lo - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.text[at])).cast(pa.string())


def split(chunk: Chunk, seeds: np.ndarray) -> Words:
    """seeds: a number of each text's language."""
    solid = ~_GAP[chunk.bytes]
    start, end, doc = chunk._runs(solid.view(np.uint8))
    pieces = np.searchsorted(np.flatnonzero(_BREAK[chunk.bytes]), start)
    joined = np.zeros(len(start), bool)
    joined[:-1] = (doc[1:] == doc[:-1]) & (pieces[1:] == pieces[:-1])
    hashed = chunk.hashes(start, end, fold=True) if len(start) else np.zeros(0, np.uint64)
    one = mix(hashed + seeds[doc])
    two, three = np.zeros_like(one), np.zeros_like(one)
    two[:-1] = mix(one[:-1] * _ODD + hashed[1:])
    three[:-2] = mix(two[:-2] * _ODD + hashed[2:])
    size = end - start
    fresh = np.cumsum(size + 1) - (size + 1)
    text = np.full(int((size + 1).sum()), 0x20, np.uint8)
    place = np.repeat(np.arange(len(size), dtype=np.int32), size)  # the words before, each with its space
    place += np.arange(len(place), dtype=np.int32)
    text[place] = _LOWER[chunk.bytes[solid]]
    return Words(text, fresh, fresh + size, doc, joined, one, two, three)


def _worded(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    """Words of a batch in chunks, the batch's languages, and each text's language by number."""
    coded = batch.column("lang").dictionary_encode()
    langs, own = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    seeds = np.array([int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in langs], np.uint64)
    for chunk in chunks(batch.column("text"), CHUNK):
        mine = own[chunk.lo : chunk.hi]
        yield split(chunk, seeds[mine]), langs, mine


class Counted:
    """Counted words of several chunks of text, summed by their hashes before they are told."""

    def __init__(self) -> None:
        self.bytes, self.parts = 0, []

    def add(self, size: int, hashes: np.ndarray, n: np.ndarray, lang: pa.Array, word: pa.Array) -> None:
        self.bytes += size
        self.parts.append((hashes, n, lang, word))

    def told(self) -> Iterator[tuple[dict[str, pa.Array], int]]:
        if self.parts:
            hashes, n, lang, word = zip(*self.parts)
            self.bytes, self.parts = 0, []
            _, first, own = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            total, at = np.bincount(own, np.concatenate(n)).astype(np.int64), pa.array(first)
            yield {"lang": pa.concat_arrays(lang).take(at), "word": pa.concat_arrays(word).take(at), "n": pa.array(total)}, len(total)


def _pairs(w: Words) -> np.ndarray:
    return np.flatnonzero(w.joined)


def _triples(w: Words) -> np.ndarray:
    return np.flatnonzero(w.joined[:-1] & w.joined[1:]) if len(w.joined) else np.zeros(0, np.int64)


def counter_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The counter of each hash among ``size`` (fewer than 2 ** 32)."""
    return ((hashes >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def _sketch(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Word counts by block of text; at the end of a task its sketches, of each block of counters those that are not zero."""

    def add(counters: np.ndarray, hashes: np.ndarray) -> None:
        at, n = np.unique(counter_of(hashes, size), return_counts=True)
        counters[at] = np.minimum(counters[at] + n, 255)

    names = ["lang", "word", "n", "order", "block", "places", "counts"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def rows(values: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([values.get(c, pa.nulls(n, kind)) for c, kind in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [np.zeros(size, np.uint8) for _ in range(2)]
        words = Counted()
        for batch in batches:
            for w, langs, own in _worded(batch):
                add(sketches[0], w.two[_pairs(w)])
                add(sketches[1], w.three[_triples(w)])
                hashes, first, n = np.unique(w.one, return_index=True, return_counts=True)
                words.add(len(w.text), hashes, n, pa.array(langs, pa.string()).take(pa.array(own[w.doc[first]])), w.strings(first, first))
                if words.bytes >= GATHERED:
                    yield from (rows(*x) for x in words.told())
        yield from (rows(*x) for x in words.told())
        for order, counters in enumerate(sketches, 2):
            for block, part in enumerate(counters.reshape(-1, BLOCK)):
                if len(at := np.flatnonzero(part)):
                    yield rows({"order": pa.array([order], pa.int32()), "block": pa.array([block], pa.int32()), "places": pa.array([at.astype(np.uint16).tobytes()]), "counts": pa.array([part[at].tobytes()])}, 1)

    return run


def _merged(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each block of counters, summed over tasks, a bit for each that reaches ``least``. Rows of a block follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(BLOCK, np.uint16)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(total >= least).tobytes()])], ["order", "block", "bits"])

        for batch in batches:
            for order, block, places, counts in zip(*(batch.column(c).to_pylist() for c in ("order", "block", "places", "counts"))):
                if (order, block) != at:
                    if at is not None:
                        yield told()
                    at, total[:] = (order, block), 0
                place = np.frombuffer(places, np.uint16)
                total[place] = np.minimum(total[place] + np.frombuffer(counts, np.uint8), 255)
        if at is not None:
            yield told()

    return run


@dataclass(frozen=True)
class Bounds:
    """A bit for each counter of the two sketches: whether its phrases can reach the least count."""

    size: int
    two: bytes
    three: bytes

    def passing(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word whether the pair, and the triple, that begin with it can."""

        def test(packed: bytes, hashes: np.ndarray) -> np.ndarray:
            at = counter_of(hashes, self.size)
            return (np.frombuffer(packed, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

        pair = w.joined & test(self.two, w.two)
        triple = np.zeros_like(pair)
        triple[:-1] = pair[:-1] & pair[1:]
        triple &= test(self.three, w.three)
        return pair, triple


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Finds phrases between spaces; a phrase's value is its place in the list."""
    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, phrase in enumerate(phrases):
        made.add_word(f" {phrase} ", k)
    made.make_automaton()
    return made


def matches(found: ahocorasick.Automaton, runs: pa.Array, size: int) -> np.ndarray:
    """How often each of an automaton's ``size`` phrases occurs, overlapping, in the runs."""
    text = " " + " \n ".join(runs.to_pylist()) + " "
    return np.bincount(np.fromiter(map(itemgetter(1), found.iter(text)), np.int64), minlength=size)


def _counts(bounds: Broadcast, shard: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """lang, phrase and n of the candidates of each shard of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, langs, own in _worded(batch):
                pair, triple = bounds.value.passing(w)
                at = np.flatnonzero(pair)
                last = at + 1 + triple[at]
                fresh = np.ones(len(at), bool)
                fresh[1:] = at[1:] > last[:-1]  # else the candidate shares a word with the one before, and goes on its run
                begin = np.flatnonzero(fresh)
                lo = 0
                while lo < len(begin):  # whole runs, of about ``shard`` places together
                    hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + shard)))
                    first, stop = begin[lo:hi], begin[hi] if hi < len(begin) else len(at)
                    ends = np.append(first[1:], stop) - 1
                    yield from _shard(w, langs, own, at[begin[lo] : stop], triple, at[first], last[ends])
                    lo = hi

    return run


def _shard(w: Words, langs: list[str], own: np.ndarray, pairs: np.ndarray, triple: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the candidates that begin at ``pairs`` in the runs of words from ``first`` to ``last``."""
    triples = pairs[triple[pairs]]
    starts = [at[np.unique(hashes[at], return_index=True)[1]] for at, hashes in ((pairs, w.two), (triples, w.three))]
    for k in np.unique(own[w.doc[first]]).tolist():
        mine = [at[own[w.doc[at]] == k] for at in starts]
        phrases = pa.concat_arrays([w.strings(at, at + more) for more, at in enumerate(mine, 1)])
        held = own[w.doc[first]] == k
        n = matches(automaton(phrases.to_pylist()), w.strings(first[held], last[held]), len(phrases))
        at = pa.array(np.flatnonzero(n))
        yield pa.RecordBatch.from_arrays([pa.array([langs[k]] * len(at), pa.string()), phrases.take(at), pa.array(n[n > 0])], ["lang", "phrase", "n"])


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, n), and phrases of two and three words that occur ``least`` times or more (lang, phrase, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = BLOCK * min(max(-(-told // (BYTES_A_COUNTER * BLOCK)), 1), MOST_BLOCKS)
    read = stored(rows.mapInArrow(_sketch(size), "lang string, word string, n long, order int, block int, places binary, counts binary"))
    words = stored(read.filter("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    blocks = read.filter("block is not null").select("order", "block", "places", "counts").repartition("order", "block").sortWithinPartitions("order", "block")
    packed = {order: np.zeros(size // 8, np.uint8) for order in (2, 3)}
    span = BLOCK // 8
    for r in blocks.mapInArrow(_merged(least), "order int, block int, bits binary").toLocalIterator():  # a bit for each counter
        packed[r.order][r.block * span : (r.block + 1) * span] = np.frombuffer(r.bits, np.uint8)
    bounds = spark.sparkContext.broadcast(Bounds(size, packed[2].tobytes(), packed[3].tobytes()))
    counts = rows.mapInArrow(_counts(bounds, shard), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return words, stored(counts.filter(F.col("n") >= least))


def _scored(a: Column, left: Column, right: Column) -> Column:
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide[0] * wide[0], wide[1] * wide[2])


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, absorbed: int = ABSORBED, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: of each language the ``top`` phrases by score.

    A phrase is scored at its weakest cut; one whose words are in a longer candidate of at least ``absorbed`` percent of its count goes.
    The tables of its steps go when the result is known.
    """
    return settled(docs.sparkSession, lambda: _collocations(docs, lang_col, text_col, least, absorbed, top, shard))


def _collocations(docs: DataFrame, lang_col: str, text_col: str, least: int, absorbed: int, top: int, shard: int) -> DataFrame:
    words, phrases = phrase_counts(docs, lang_col, text_col, least, shard)
    told = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = told.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    parted = cuts.select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w") - F.col("cut")), " ").alias("right")
    )
    counted = words.select("lang", F.col("word").alias("part"), "n").unionByName(told.filter(F.size("w") == 2).select("lang", F.col("phrase").alias("part"), F.col("a").alias("n")))
    lefts = counted.select("lang", F.col("part").alias("left"), F.col("n").alias("l"))
    rights = counted.select("lang", F.col("part").alias("right"), F.col("n").alias("r"))
    scored = parted.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).withColumn("score", _scored(F.col("a"), F.col("l"), F.col("r")))
    weakest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("at"))
    inner = F.explode(F.array(*[F.array_join(F.slice("w", k, 2), " ") for k in (1, 2)]))
    longer = told.filter(F.size("w") == 3).select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    stay = weakest.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("most") < absorbed * F.col("a"), F.lit(True)))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("at.score"), F.desc("a"), "phrase"))
    ranked = stay.withColumn("rank", rank).filter(F.col("rank") <= top)  # ranks are limited in each task before they move
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("at.l").alias("l"), F.col("at.r").alias("r"), "n", F.col("at.score").alias("score"))


ORACLE = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 4) t(k)) GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
scored AS (SELECT cuts.*, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, p, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p FROM c WHERE k = 3) GROUP BY ALL),
stay AS (SELECT w.* FROM weakest w LEFT JOIN longer g ON g.lang = w.lang AND g.p = w.phrase WHERE g.most IS NULL OR 100 * g.most < 50 * w.a),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM stay) JOIN totals USING (lang) WHERE rank <= 2000
"""
