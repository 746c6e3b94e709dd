"""Fuzzy line deduplication by SimHash (operator 5).

A line is normalised to the words (runs of letters, marks and digits) of its
lower-cased text. Lines with equal words are one class. A class also has a
SimHash of 64 bits over its words, in which words of up to three characters, that
most lines share, weigh a quarter of others, cut into four blocks of 16 bits. By the
pigeonhole principle two SimHashes that differ in at most two bits agree in two
blocks at least, so classes are joined on pairs of blocks: six keys of 32 bits
each, so that chance meetings stay few in large corpora.

Lines at a similarity of 0.8 mostly differ in more bits and seldom meet so. So each class
has LISTED further keys, its pairs of neighbouring words of most characters: what two
lines that are alike share most likely and others do not, in an order that needs no
counts of the corpus. Of classes that meet, those are compared whose lengths allow the
similarity and whose SimHashes differ in at most DISTANT bits. They are linked if their
edit similarity over words, 1 - distance / longer length, is at least 0.8. Of each connected
group the first occurrence (by document id, then line) stays and all others go. All of it is
DataFrame expressions. With ``complete``, all classes whose rarest pairs of neighbouring words
meet are compared as well, which no two lines that are alike can avoid.

Bits are counted four at a time, in lanes of 16 bits of one long sum; a lane
holds the weights of CHUNK_WORDS words, and the lanes of a longer line's chunks are summed
apart.

Defined cases: a null text has no lines and stays null; an empty text has one
empty line; lines of fewer than LEAST_WORDS words are too short to be linked to others;
they stay, too, unless least_chars is given, as by the queries, and their words have as many characters: then
the first of equal ones stays (characters, since scripts without spaces have few words); rows with null ids come last in the order of occurrences; rows with
equal id and text are one document, and each of them gets its result; an empty
table gives an empty result; other columns are carried along whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _graph
from tidegate.llm._common import settled, stored
from tidegate.llm._graph import bucket_components

LEAST_WORDS = 5
#: Least characters, all words together, of a line of fewer words whose equals go, for callers who want these gone.
LEAST_CHARS = 8
#: Least edit similarity over words, in percent.
PERCENT = 80
#: What separates the words of a normalised line, for Java regular expressions.
GAP = r"[^\p{L}\p{M}\p{N}]+"
SHORT_WORD, WEIGHT = 3, 4
CHUNK_WORDS = 4095
#: Pairs of neighbouring words by which a line meets others.
LISTED = 5
#: Bits in which the SimHashes of two lines differ at most that are compared.
DISTANT = 24

#: Longs of a line's marks, a bit of which stands for each of its words.
MARKS, AGAIN = 16, 7
#: Rounds of stars before all others are compared: later ones link hardly any more.
STAR_ROUNDS = 1

#: Bit of a pair's key from which its characters are told.
_LENGTH_AT = 55
_LANES = 0x0001_0001_0001_0001
#: The most that a lane's sum may be, and the bit that it carries into when the majority is added.
_MOST, _CARRY = (1 << 14) - 1, 14
assert CHUNK_WORDS * WEIGHT <= _MOST
#: Bits of a block, and shifts of a hash that bring each of its bits to the foot of a lane.
BITS = 16
BLOCKS = 4
PAIRS = tuple(combinations(range(BLOCKS), 2))
_LINE = ("doc_id", "row", "pos", "one", "two", "n_words", "pairs")


def normal_words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), GAP), "")


def word_weight(word: Column) -> Column:
    return F.when(F.length(word) <= SHORT_WORD, F.lit(1)).otherwise(F.lit(WEIGHT)).cast("long")


def _majority() -> Column:
    """The bits of more than half of the summed weight ``n``: a lane's carry, for all four lanes of a sum at once."""
    level = F.lit(_LANES) * (F.lit(_MOST) - F.expr("n div 2"))
    held = [F.shiftleft(F.shiftrightunsigned(F.col(f"s{j}") + level, _CARRY).bitwiseAND(F.lit(_LANES)), j) for j in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), held)


def simhashes(hashes: DataFrame) -> DataFrame:
    """The majority hash s of each line's rows (s, weight), which are summed by chunk first: their weights sum up to _MOST at the most.

    A line of one chunk has its bits at once. Lanes of a longer one are taken apart and
    summed as longs, so that its hash is of all its words, too.
    """
    sums = [F.sum(F.shiftright("s", j).bitwiseAND(F.lit(_LANES)) * F.col("weight")).alias(f"s{j}") for j in range(BITS)]
    long = F.col("n_words") > CHUNK_WORDS
    lanes = F.when(long, F.array(*[f"s{j}" for j in range(BITS)])).alias("lanes")
    chunks = stored(hashes.groupBy(*_LINE, "chunk").agg(F.sum("weight").alias("n"), *sums).select(*_LINE, _majority().alias("s"), "n", lanes))
    places = [(j, k) for j in range(BITS) for k in range(BLOCKS)]
    apart = [F.sum(F.shiftrightunsigned(F.get("lanes", F.lit(j)), BITS * k).bitwiseAND(F.lit((1 << BITS) - 1))).alias(f"b{BITS * k + j}") for j, k in places]
    wide = chunks.filter(long).groupBy(*_LINE).agg(F.sum("n").alias("n"), *apart)
    bits = [F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for b in range(BITS * BLOCKS)]
    whole = wide.select(*_LINE, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("s"))
    return chunks.filter(~long).select(*_LINE, "s").unionByName(whole)


def block(k: int) -> Column:
    return F.shiftright("s", BITS * k).bitwiseAND(F.lit((1 << BITS) - 1))


def block_keys() -> Column:
    """The pairs of blocks as longs: number of the pair, then both blocks."""
    return F.array(*[F.shiftleft(block(a), BITS).bitwiseOR(block(b)).bitwiseOR(F.lit(i << 32)) for i, (a, b) in enumerate(PAIRS)])


def pair_keys(words: Column) -> Column:
    """Keys of the LISTED pairs of neighbouring words of most characters together (all, if there are no more).

    A key has the pair's characters in its upper bits and a hash below, so that the
    largest keys are those of the longest pairs, in an order that all lines share.
    """
    low = F.lit((1 << _LENGTH_AT) - 1)

    def paired(p: Column) -> Column:
        def key(a: Column, b: Column) -> Column:
            both = F.shiftrightunsigned(a, _LENGTH_AT) + F.shiftrightunsigned(b, _LENGTH_AT)
            return F.shiftleft(both, _LENGTH_AT).bitwiseOR(F.xxhash64(a, b).bitwiseAND(low))

        return F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), key)

    each = F.transform(words, lambda w: F.shiftleft(F.least(F.length(w), F.lit(127)).cast("long"), _LENGTH_AT).bitwiseOR(F.xxhash64(w).bitwiseAND(low)))
    # The words' numbers are bound once, as the argument of the outer transform.
    keys = F.get(F.transform(F.array(each), paired), F.lit(0))
    return F.slice(F.sort_array(F.array_distinct(keys), asc=False), 1, LISTED)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a hash of id and text), text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def sketched(rows: DataFrame, least_words: int = LEAST_WORDS, least_chars: int | None = None) -> DataFrame:
    """Each line of least_words words or more, or of least_chars characters of words or more: doc_id, row, pos, one and two (hashes of its words), n_words, pairs (keys) and s (its SimHash)."""
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # Exploded, since the filter would otherwise be pushed below the words and split each line a second time.
    long = F.size("words") >= least_words
    if least_chars is not None:
        long = long | (F.length(F.array_join("words", "")) >= max(1, least_chars))
    words = lines.select("doc_id", "row", "pos", F.explode(F.array(normal_words(F.col("line")))).alias("words")).filter(long)
    size = F.size("words")
    hashed = words.select("doc_id", "row", "pos", F.xxhash64("words").alias("one"), F.xxhash64("words", F.lit(7)).alias("two"), size.alias("n_words"), F.when(size >= LEAST_WORDS, pair_keys(F.col("words"))).otherwise(F.array().cast("array<long>")).alias("pairs"), "words")
    each = hashed.select(*_LINE, F.posexplode("words").alias("at", "word"))
    bits = each.select(*_LINE, F.expr(f"at div {CHUNK_WORDS}").alias("chunk"), F.xxhash64("word").alias("s"), word_weight(F.col("word")).alias("weight"))
    return simhashes(bits)


def _code(word: Column) -> Column:
    return F.hex(F.pmod(F.xxhash64(word), F.lit(0xC000)) + F.lit(0x1000))


def coded(words: Column) -> Column:
    """Words as one character each, of 49,152, so that the edit distance of strings is that of words."""
    codes = F.transform(words, _code)
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")


def confirmed(most: str) -> Column:
    """Whether the distance over the words themselves is within ``most``, for lines (said_a, said_b) whose codes are.

    If no two words of the pair have one code, that is so; otherwise words are
    numbered by their place among the pair's words and compared by these.
    """

    def judged(words: Column) -> Column:
        alone = F.size(F.array_distinct(F.transform(words, _code))) == F.size(words)

        def numbered(said: str) -> Column:
            places = F.transform(F.split(said, " "), lambda w: F.lpad(F.hex(F.array_position(words, w) + F.lit(0x10000)), 8, "0"))
            return F.decode(F.unhex(F.array_join(places, "")), "UTF-32")

        return alone | (F.call_function("levenshtein", numbered("said_a"), numbered("said_b"), F.col(most)) >= 0)

    return F.get(F.transform(F.array(F.array_union(F.split("said_a", " "), F.split("said_b", " "))), judged), F.lit(0))


def tokens_of_two(held: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, slack, share, tokens and places of contents (node, code, size): the distinct pairs of neighbouring words, and where they stand.

    A changed or lacking word takes two pairs with it, an added one parts one. So a
    line of n words lacks at most 2n(1 - percent) pairs of any line that is alike,
    whichever of the two is longer, and keeps one at least (see _least_of_two).
    """
    coded = held.select("node", "size", F.transform(F.array_remove(F.split("code", ""), ""), lambda w: F.ascii(w).cast("long")).alias("words"))
    pairs = F.zip_with(F.slice("words", F.lit(1), F.col("size") - 1), F.slice("words", F.lit(2), F.col("size") - 1), lambda a, b: F.shiftleft(a, 16).bitwiseOR(b))
    slack = F.expr(f"size * {2 * (100 - percent)} div 100").cast("int")

    def once(found: Column) -> Column:
        """Of sorted (token, at), each token, with -1 for one that stands in several places."""

        def told(x: Column, k: Column) -> Column:
            before, after = F.get(found, k - 1)["token"] == x["token"], F.get(found, k + 1)["token"] == x["token"]
            return F.struct(x["token"].alias("token"), F.when(before, F.lit(-2)).when(after, F.lit(-1)).otherwise(x["at"]).alias("at"))

        return F.filter(F.transform(found, told), lambda x: x["at"] > -2)

    # The sorted pairs are bound once, as the argument of the outer transform.
    placed = F.sort_array(F.transform(pairs, lambda p, k: F.struct(p.alias("token"), k.alias("at"))))
    told = coded.select("node", slack.alias("slack"), F.get(F.transform(F.array(placed), once), F.lit(0)).alias("t"))
    return told.select("node", "slack", F.lit(0.0).alias("share"), F.col("t.token").alias("tokens"), F.col("t.at").alias("places"))


def marks_of_words(held: DataFrame) -> DataFrame:
    """node, marks (longs) and bits (in them) of contents (node, code): a bit for each word, and one more each time that it comes again, up to AGAIN times.

    Each edit takes one word at most, so a line that is alike has the bits of all but as many.
    """
    words = held.select("node", F.sort_array(F.array_remove(F.split("code", ""), "")).alias("words"))
    each = words.select("node", "words", F.posexplode("words").alias("k", "word"))
    again = reduce(lambda a, b: a + b, [F.when(F.get("words", F.col("k") - j) == F.col("word"), 1).otherwise(0) for j in range(1, AGAIN + 1)])
    each = each.select("node", F.xxhash64("word", again).bitwiseAND(F.lit(64 * MARKS - 1)).cast("int").alias("at"))
    bit = F.expr("shiftleft(1L, at & 63)")
    longs = [F.bit_or(F.when(F.shiftright("at", 6) == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{j}") for j in range(MARKS)]
    bits = reduce(lambda a, b: a + b, [F.bit_count(f"w{j}") for j in range(MARKS)])
    return each.groupBy("node").agg(*longs).select("node", F.array(*[f"w{j}" for j in range(MARKS)]).alias("marks"), bits.alias("bits"))


def _least_of_two(percent: int) -> int:
    """The fewest words of a line that keeps a pair of neighbours in every line that is alike."""
    return -(-200 // (2 * percent - 100)) if percent > 50 else 1 << 31


def line_groups(classes: DataFrame, rows: DataFrame, percent: int = PERCENT, complete: bool = False, least_words: int = LEAST_WORDS) -> DataFrame | None:
    """node, component of classes (one, n_words, s, first: its first occurrence) that are alike, by their hash ``one``.

    complete: of all classes; otherwise of those that share block keys.
    """
    blocked = classes.select(F.col("one").alias("node"), F.col("n_words").alias("n"), "s", F.explode(F.concat(block_keys(), F.col("pairs"))).alias("key"))

    def texts(wanted: DataFrame) -> DataFrame:
        at = classes.join(wanted, F.col("one") == F.col("node")).select("node", F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_row"), F.col("first.pos").alias("_pos"))
        each = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        found = each.join(at.hint("shuffle_hash"), (F.col("row") == F.col("_row")) & (F.col("pos") == F.col("_pos")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        words = found.select("node", normal_words(F.col("line")).alias("words"))
        return words.select("node", coded(F.col("words")).alias("code"), F.array_join("words", " ").alias("said"), F.size("words").alias("size"))

    def linked(faced: DataFrame) -> DataFrame:
        most = (F.greatest("size_a", "size_b") * (100 - percent) / 100).cast("int")
        # Most pairs are settled by what is cheap: words that the other line lacks, each of which takes an edit, or a small distance.
        apart = [F.size(F.array_except(F.split(x, ""), F.split(y, ""))) > F.col("most") for x, y in (("code_a", "code_b"), ("code_b", "code_a"))]
        near = (F.expr("levenshtein(code_a, code_b, most div 4)") >= 0) | (F.expr("levenshtein(code_a, code_b, most)") >= 0)
        alike = F.when(apart[0] | apart[1], False).otherwise(near & confirmed("most"))
        return faced.withColumn("most", most).select("hub", "member", alike.alias("linked"))

    def tokens(held: DataFrame) -> DataFrame:
        # A line that is alike lacks at most the share of words that may be edited; each lacks one distinct word at most.
        slack = F.floor(F.col("size") * (100 - percent) / 100).cast("int")
        words = F.array_distinct(F.array_remove(F.split("code", ""), ""))
        return held.select("node", slack.alias("slack"), F.lit(0.0).alias("share"), F.transform(words, lambda w: F.ascii(w).cast("long")).alias("tokens"))

    chosen = (lambda held: tokens_of_two(held, percent)) if least_words >= _least_of_two(percent) else tokens
    rounds = min(STAR_ROUNDS, _graph.STAR_ROUNDS)
    if not complete:
        possible = F.bit_count(F.col("s_hub").bitwiseXOR(F.col("s_member"))) <= DISTANT
        return bucket_components(blocked, texts, linked, chosen, percent, within=chosen is tokens, possible=possible, marks=marks_of_words, rounds=rounds)
    every = classes.groupBy(F.col("one").alias("node")).agg(F.first("n_words").alias("n"))
    return bucket_components(blocked, texts, linked, chosen, percent, everyone=every, marks=marks_of_words, rounds=rounds)


def removed_lines(docs: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, complete: bool = False, least_chars: int | None = None, **columns: str) -> DataFrame:
    """doc_id, row and removed (positions of the lines that go) of each document that loses lines; the tables of its steps go when they are known."""
    return settled(docs.sparkSession, lambda: _removed_lines(docs, least_words, percent, complete, least_chars, **columns))


def _removed_lines(docs: DataFrame, least_words: int, percent: int, complete: bool, least_chars: int | None, **columns: str) -> DataFrame:
    rows = keyed(docs, **columns)
    lines = sketched(rows, least_words, least_chars)
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "pos")
    same = [F.first(c).alias(c) for c in ("n_words", "s", "pairs")]
    classes = stored(lines.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("copies"), *same))
    found = line_groups(classes.filter(F.col("n_words") >= least_words), rows, percent, complete, least_words)
    repeated = classes.filter("copies > 1").select("one", "two", F.col("first").alias("lead"))
    if found is not None:
        linked = classes.join(found.withColumnRenamed("node", "one"), "one")
        leads = linked.groupBy("component").agg(F.min("first").alias("lead"))
        led = linked.join(leads, "component").select("one", "two", "first", "copies", "lead")
        alone = repeated.join(led.select("one", "two"), ["one", "two"], "left_anti")
        repeated = alone.union(led.filter((F.col("copies") > 1) | ~F.col("lead").eqNullSafe(F.col("first"))).select("one", "two", "lead"))
    gone = lines.withColumn("at", place).select("doc_id", "row", "pos", "one", "two", "at").join(repeated.hint("shuffle_hash"), ["one", "two"]).filter(~F.col("at").eqNullSafe(F.col("lead")))
    return gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("removed"))


def _with_removed(docs: DataFrame, removed: DataFrame, text: str, id_name: str) -> DataFrame:
    """docs with _removed: positions of the lines that go, null if all stay."""
    told = removed.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("removed").alias("_removed"))
    row = F.xxhash64(F.col(id_name).cast("long"), F.col(text))
    return docs.join(told.hint("shuffle_hash"), (row == F.col("_row")) & F.col(id_name).cast("long").eqNullSafe(F.col("_id")), "left")


def _left(text: str) -> Column:
    """The text without its removed lines. Its lines are bound once, as the argument of the outer transform."""

    def joined(lines: Column) -> Column:
        stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_removed"))
        return F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n")

    rebuilt = F.get(F.transform(F.array(F.split(text, "\n", -1)), joined), F.lit(0))
    return F.when(F.col("_removed").isNull(), F.col(text)).otherwise(rebuilt)


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and text_sha256 (of the text that is left) of each document."""
    plain = docs.select(F.col(id_col).cast("long").alias("c0"), F.col(text_col).alias("c1"))
    removed = removed_lines(docs, id_col=id_col, text_col=text_col, **options)
    n_lines = F.when(F.col("c1").isNull(), F.lit(0)).otherwise(F.size(F.split("c1", "\n", -1)))
    n_removed = F.coalesce(F.size("_removed"), F.lit(0))
    made = _with_removed(plain, removed, "c1", "c0").select("c0", n_lines.alias("n_lines"), n_removed.alias("n_removed"), F.coalesce(_left("c1"), F.lit("")).alias("left"))
    return made.select(
        F.col("c0").alias("doc_id"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(F.col("n_removed") > 0, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.length("left").cast("long").alias("n_chars"),
        F.sha2("left", 256).alias("text_sha256"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the lines that stay; documents that lose all their words go. n_chars, where present, is counted anew."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, id_name = f"c{names.index(text_col)}", f"c{names.index(id_col)}"
    removed = removed_lines(docs, id_col=id_col, text_col=text_col, **options)
    made = _with_removed(plain, removed, text, id_name).withColumn("_new", _left(text))
    alive = F.col("_removed").isNull() | F.col("_new").rlike(r"[^\x20\x09-\x0D]")

    def column(i: int, name: str) -> Column:
        if name == text_col:
            return F.col("_new")
        if name == "n_chars":
            return F.when(F.col("_removed").isNull(), F.col(f"c{i}")).otherwise(F.length("_new")).cast(docs.schema[i].dataType)
        return F.col(f"c{i}")

    return made.filter(alive).select(*[column(i, name).alias(f"d{i}") for i, name in enumerate(names)]).toDF(*names)
