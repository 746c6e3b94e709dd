"""Secret scan with corpus-wide ownership frequency (operator 2).

Base spans come from three patterns. The method adds spans of further
candidates, long mixed strings that no pattern names: each candidate's hash is
aggregated over the corpus by distinct repositories and owners. A value in several
texts of several owners, or of many repositories, is a copied example; one that
belongs to a single owner (or to copies of one text) and looks live (many different
characters, no placeholder words) is a credential and its spans are added. All of it is DataFrame expressions.

Matches are marked by one regular-expression replacement per kind with signs
from the private use area (any in the text are replaced first, one for one), and
positions are counted from the lengths of the pieces between marks.

Defined cases: a null text counts as empty; without matches the counts are 0 and
the hash is that of the empty string; a null owner or repository counts as one
value of its own; repeated rows are each reported and count once per owner; the
matches of a very long text are worked on in groups, all of them; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm._common import stored

# The kinds of base spans, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "live")
PATTERNS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 6),
    "access": (r"()(AKIA[A-Z0-9]{16,})", 20),  # 20 or more characters of AKIA[A-Z0-9]+
    "hex": (r"()([0-9a-f]{24,})", 24),
    "live": (r"()((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2})", 20),
}
#: Values that are made of nothing but such words, digits in order and signs are placeholders.
PLACEHOLDER = r"(?i)^(?:example|sample|dummy|change|me|placeholder|redacted|insert|your|here|my|the|test|secret|token|password|api|key|value|string|x{3,}+|0{3,}+|12345678?9?0?|abcdef|[+/_=-])++\z"
#: A live-looking value has at least so many different characters, digits and letters among them.
LEAST_CHARACTERS = 10
#: In texts of this many owners, or of this many repositories of one owner, a value is a copied example.
COPIED_OWNERS, COPIED_REPOS = 2, 3

#: Matches of one text are worked on in groups of so many.
GROUP = 256
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"
_OPEN, _MID, _CLOSE = "\ue000", "\ue001", "\ue002"


def _grouped(values: Column) -> Column:
    """An array cut into arrays of GROUP."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / GROUP) - 1, F.lit(0)).cast("int")), lambda g: F.slice(values, g * GROUP + 1, GROUP))


def spans(text: Column, kind: str) -> Column:
    """Array of (start, rank, kind, end, value) of the leftmost non-overlapping matches of a kind.

    Pieces are walked in groups, whose own starts are summed first: lists that grow
    one by one are copied each time, so none grows beyond a group or the number of groups.
    """
    pattern, least = PATTERNS[kind]
    marked = F.regexp_replace(text, pattern, f"{_OPEN}$1{_MID}$2{_CLOSE}")
    none = F.array().cast(_SPANS)

    def step(state: Column, piece: Column) -> Column:
        lead = F.instr(piece, _MID) - 1
        size = F.instr(piece, _CLOSE) - F.instr(piece, _MID) - 1
        start = state["at"]
        value = F.substring(piece, lead + 2, size)
        found = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (start + lead + size).alias("end"), value.alias("value"))
        return F.struct((start + F.length(piece) - 2).alias("at"), F.when(size >= least, F.concat(state["found"], F.array(found))).otherwise(state["found"]).alias("found"))

    def walked(pieces: Column) -> Column:
        groups = _grouped(F.slice(pieces, F.lit(2), F.size(pieces)))
        lengths = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda n, piece: n + F.length(piece) - 2))
        first = F.array(F.length(F.get(pieces, F.lit(0))))
        starts = F.aggregate(lengths, first, lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        each = F.zip_with(groups, F.slice(starts, F.lit(1), F.size(groups)), lambda g, at: F.aggregate(g, F.struct(at.alias("at"), none.alias("found")), step, lambda state: state["found"]))
        return F.when(F.size(pieces) > 1, F.flatten(each)).otherwise(none)

    # Pieces are bound once, as the argument of the outer transform.
    return F.get(F.transform(F.array(F.split(marked, _OPEN, -1)), walked), F.lit(0))


def told(found: Column) -> Column:
    """The spans as kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang") -> DataFrame:
    """doc_id, text_hash, owner, repo, base (array of spans) and further (array of candidate spans outside them)."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _OPEN + _MID + _CLOSE, "\ufffd" * 3)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.col(owner_col).alias("owner"),
        F.col(repo_col).alias("repo"),
        *[spans(text, kind).alias(kind) for kind in KINDS],
    )
    base = F.sort_array(F.concat(*KINDS[:3]))
    mixed = rows.withColumn("base", base)

    # Base spans by start in groups, each with its last end, so that a candidate looks into few groups.
    grouped = F.transform(_grouped(F.col("base")), lambda g: F.struct(g.alias("spans"), F.get(g, F.lit(0))["start"].alias("start"), F.array_max(F.transform(g, lambda b: b["end"])).alias("end")))
    mixed = mixed.withColumn("grouped", F.when(F.size("base") > 0, grouped).otherwise(F.array().cast(f"array<struct<spans:{_SPANS},start:int,end:int>>")))

    def meets(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def apart(s: Column) -> Column:
        return ~F.exists("grouped", lambda g: meets(g, s) & F.exists(g["spans"], lambda b: meets(b, s)))

    def looks_live(s: Column) -> Column:
        value = s["value"]
        various = F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARACTERS
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & various & ~value.rlike(PLACEHOLDER)

    return mixed.select("doc_id", "text_hash", "owner", "repo", "base", F.filter("live", lambda s: looks_live(s) & apart(s)).alias("further"))


def ownership(values: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repos, n_texts (distinct ones) and n_copies of (value_hash, owner, repo, text_hash) rows.

    Equal rows are counted before they move, so a value that most rows hold is many
    small groups first. A null owner or repository counts as one.
    """
    held = values.groupBy("value_hash", "owner", "repo", "text_hash").agg(F.count("*").alias("n"))
    several = [F.count_distinct(F.struct(c)).alias(n) for c, n in (("owner", "n_owners"), ("repo", "n_repos"), ("text_hash", "n_texts"))]
    return held.groupBy("value_hash").agg(*several, F.sum("n").alias("n_copies"))


def widely_copied() -> Column:
    """Whether a value is a copied example: in several texts (copies of one text tell nothing) of several owners or of many repositories."""
    return (F.col("n_texts") > 1) & ((F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS))


def scan(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, n_live, n_copied (base values that are copied examples), and the most
    owners and repositories that any of the document's values has."""
    rows = stored(candidates(docs, **columns))
    every = F.explode(F.concat("base", "further"))
    values = rows.select("doc_id", "text_hash", "owner", "repo", every.alias("span")).withColumn("value_hash", F.sha2("span.value", 256))
    known = ownership(values)
    judged = values.select("doc_id", "text_hash", "span", "value_hash").join(known, "value_hash")
    live = (F.col("span.kind") == "live") & ~widely_copied()
    copied = (F.col("span.kind") != "live") & widely_copied()
    by_doc = judged.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set(F.when(live, F.col("span"))).alias("added"),
        F.size(F.collect_set(F.when(copied, F.col("span")))).alias("n_copied"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("most_repos"),
    )
    joined = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    none = F.array().cast(dict(rows.dtypes)["base"])
    added = F.coalesce("added", none)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return joined.select(
        "doc_id",
        *[count(kind) for kind in KINDS[:3]],
        F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(F.sort_array(F.concat(F.col("base"), added))).alias("spans"),
        F.size(added).cast("long").alias("n_live"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_copied", "most_owners", "most_repos")],
    )
