"""Connected components of links, and of nodes that share buckets and are confirmed to be alike."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm._common import remove, settled, shared_dir, shuffles_dropped, stored

#: Rounds in which each node meets a centre of its buckets.
STAR_ROUNDS = 3
#: Members of a bucket that are compared without stars or a look at their tokens: each meets fewer than this many others.
FEW = 16
#: Times FEW: members of a bucket that are compared in the last step if sizes, sketches and marks tell most pairs apart.
MARKED = 256


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node it reaches) for every node of an edge.

    Each pass contracts the links: a node goes to the first of itself and its
    neighbours, in an order that differs from pass to pass, and from there one hop
    further; both ends of every link are replaced, and self-links and repeats are
    dropped. Passes end when no link is left. Links shrink by a part in each pass,
    so all passes together read a multiple of the first one's rows, and only whether
    links are left comes to the driver. The passes' tables go when the result is written.
    """
    return settled(edges.sparkSession, lambda: _components(edges, a, b))


def _components(edges: DataFrame, a: str, b: str) -> DataFrame:
    ends = edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    links, hops = stored(ends), []
    while True:
        # Orders of 64-bit numbers that can be turned back: exclusive or with one constant per pass.
        mask = F.lit(int.from_bytes(hashlib.blake2b(bytes([len(hops) & 255]), digest_size=8).digest(), "big", signed=True))
        both = links.select(F.col("x").alias("node"), F.col("y").alias("other")).union(links.select(F.col("y").alias("node"), F.col("x").alias("other")))
        first = F.least(F.min(F.col("other").bitwiseXOR(mask)), F.col("node").bitwiseXOR(mask)).bitwiseXOR(mask)
        near = stored(both.groupBy("node").agg(first.alias("near")))
        hop = stored(near.join(near.select(F.col("node").alias("near"), F.col("near").alias("far")), "near").select("node", "far"))
        hops.append(hop)
        turned = links.join(hop.select(F.col("node").alias("x"), F.col("far").alias("p")), "x").join(hop.select(F.col("node").alias("y"), F.col("far").alias("q")), "y")
        links = stored(turned.filter("p <> q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct())
        if links.isEmpty():
            break
    # Later hops are of ever fewer nodes, so they are followed from the last one back.
    label = hops.pop()
    while hops:
        onward = label.select(F.col("node").alias("far"), F.col("far").alias("last"))
        label = hops.pop().join(onward, "far", "left").select("node", F.coalesce("last", "far").alias("far"))
    label = stored(label)
    least = label.groupBy("far").agg(F.min("node").alias("component"))
    return label.join(least, "far").select("node", "component")


def _alike_in_size(n: str, m: str, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _table(df: DataFrame, key: str, name: str) -> str:
    """Writes the distinct rows as a table bucketed by ``key``, so that joins on it move the other side alone; its files' place in the shared folder."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}"
    with shuffles_dropped(df.sparkSession):
        df.repartition(buckets, key).dropDuplicates().write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return path


def _faced(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """hub, member, and the contents of both, with suffixes _a and _b.

    Contents of members, each needed about once, are joined where their bucket
    lies. Only then do they meet their hubs, whose contents are looked up once
    each; a hub with very many members is split by adaptive execution.
    """
    columns = [c for c in held.columns if c != "node"]
    side = {s: [F.col(c).alias(f"{c}_{s}") for c in columns] for s in "ab"}
    members = pairs.join(held.select(F.col("node").alias("member"), *side["b"]), "member")
    hubs = pairs.select("hub").distinct().join(held.select(F.col("node").alias("hub"), *side["a"]), "hub")
    return members.join(hubs, "hub")


def _met(rows: DataFrame) -> DataFrame:
    """hub, n, of_hub, s_hub, member, m, of_member, s_member: nodes of different components that share a bucket (key)."""
    left = rows.select("key", F.col("node").alias("hub"), "n", F.col("label").alias("of_hub"), F.col("s").alias("s_hub"))
    right = rows.select("key", F.col("node").alias("member"), F.col("n").alias("m"), F.col("label").alias("of_member"), F.col("s").alias("s_member"))
    return left.join(right, "key").filter("hub < member and of_hub <> of_member").drop("key")


def _lacking(percent: int) -> Column:
    """Whether hub and member (n, m, marks_a, bits_a, marks_b, bits_b) can be alike within 100 - percent edits by their marks.

    marks: longs with a bit for each part of a node, bits of them in all; each edit takes one part at most. So lines
    that share a long passage, and of what is beside it too little, do not meet.
    """
    shared = F.aggregate(F.zip_with("marks_a", "marks_b", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda a, b: a + b)
    return 100 * (F.greatest("bits_a", "bits_b") - shared) <= (100 - percent) * F.greatest("n", "m")


def _met_once(rows: DataFrame, marks: DataFrame, fits: Column, percent: int) -> DataFrame:
    """As _met, for larger buckets: of the pairs, those that can be alike by sizes, sketches and marks (see _lacking).

    Nodes that share several buckets meet in the first, and in a later one only if another lies before it.
    """
    before = F.lag("key").over(Window.partitionBy("node").orderBy("key"))
    known = stored(rows.select("key", "node", "n", "s", "label").join(marks, "node").withColumn("before", before))
    left = known.select("key", F.col("node").alias("hub"), "n", F.col("label").alias("of_hub"), F.col("s").alias("s_hub"), *[F.col(c).alias(f"{c}_a") for c in ("before", "marks", "bits")])
    right = known.select("key", F.col("node").alias("member"), F.col("n").alias("m"), F.col("label").alias("of_member"), F.col("s").alias("s_member"), *[F.col(c).alias(f"{c}_b") for c in ("before", "marks", "bits")])
    apart = (F.col("hub") < F.col("member")) & (F.col("of_hub") != F.col("of_member"))
    fresh = F.coalesce(F.col("before_a") != F.col("before_b"), F.lit(True))
    return left.join(right, "key").filter(apart & fits & fresh & _lacking(percent)).select("hub", "n", "of_hub", "s_hub", "member", "m", "of_member", "s_member")


def _prefix_pairs(opened: DataFrame, tokens: DataFrame, within: bool, percent: int, possible: Column | None = None, marks: DataFrame | None = None) -> DataFrame:
    """hub, n, of_hub, s_hub, member, m, of_member, s_member: the pairs of different components that can be alike at all.

    opened: key, node, n, s, label. tokens: node, slack, its distinct tokens, of which
    any node that is alike shares all but ``slack``, and one at least, and
    ``share``: two nodes that are alike share the sum of their shares at least. If
    the tokens of all nodes are put in one order, two nodes that are alike share
    one of their first slack + 1 tokens each, and from the first that they share,
    enough are left on both sides. The order is by rarity, so what most nodes of a
    group share comes last, and single changes of copies come first.

    places (optional, beside tokens): where in its sequence a token stands, -1 if more than once. Nodes that
    are alike within 100 - percent edits share a token that no edit touches, so what
    stands before it, and what stands behind it, differs in length by no more edits.

    marks (node, marks, bits): see _lacking.

    Two nodes that share several first tokens meet at one of them: not where the tokens before, on both
    sides, are one that brings them together already.

    Where a token's commonest component meets itself, nothing is compared: one side
    of each pair is of another. within: the two meet in a bucket, too (for tokens
    that alone tell little).
    """
    if "places" not in tokens.columns:
        tokens = tokens.withColumn("places", F.transform("tokens", lambda t: F.lit(-1)))
    each = tokens.select("node", "slack", "share", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select("node", "slack", "share", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"))
    counts = each.groupBy("token").agg(F.count("*").alias("df"))
    ranked = each.join(counts, "token").groupBy("node", "slack", "share").agg(F.sort_array(F.collect_list(F.struct("df", "token", "place"))).alias("tokens"))
    rest = F.size("tokens").alias("size")
    shown = F.transform(F.slice("tokens", F.lit(1), F.col("slack") + 1), lambda t, k: F.struct(t["token"].alias("token"), t["place"].alias("place"), F.get("tokens", k - 1).alias("before")))
    first = ranked.select("node", "share", rest, F.posexplode(shown).alias("at", "t"))
    on = ["key", "token"] if within else ["token"]
    left_over = first.select("node", "share", F.col("t.token").alias("token"), F.col("t.place").alias("place"), F.col("t.before.token").alias("before"), F.col("t.before.place").alias("before_place"), (F.col("size") - F.col("at")).alias("rest"))
    placed = stored(left_over.join(opened.select(*on[:-1], "node", "n", "s", "label").distinct(), "node"))
    tops = placed.groupBy(*on, "label").agg(F.count("*").alias("rows")).groupBy(*on).agg(F.max(F.struct("rows", "label"))["label"].alias("top"), F.count("*").alias("labels"))
    met = placed.join(tops.filter("labels > 1").select(*on, "top"), on)
    met = stored(met if marks is None else met.join(marks, "node"))
    carried = ["share", "rest", "place", "before", "before_place", *([] if marks is None else ["marks", "bits"])]
    side = {x: [F.col(c).alias(f"{c}_{x}") for c in carried] for x in "ab"}
    left = met.filter("label <> top").select(*on, F.col("node").alias("hub"), "n", F.col("label").alias("of_hub"), F.col("s").alias("s_hub"), *side["a"])
    right = met.select(*on, "top", F.col("node").alias("member"), F.col("n").alias("m"), F.col("label").alias("of_member"), F.col("s").alias("s_member"), *side["b"])
    apart = (F.col("of_hub") != F.col("of_member")) & ((F.col("of_member") == F.col("top")) | (F.col("hub") < F.col("member")))
    enough = F.least("rest_a", "rest_b") >= F.col("share_a") + F.col("share_b")
    most = (100 - percent) * F.greatest("n", "m")

    def near(place: str) -> Column:
        moved = F.col(f"{place}_a") - F.col(f"{place}_b")
        behind = F.col("n") - F.col("m") - moved
        return (F.least(f"{place}_a", f"{place}_b") < 0) | (100 * (F.abs(moved) + F.abs(behind)) <= most)

    fresh = ~F.coalesce((F.col("before_a") == F.col("before_b")) & near("before_place"), F.lit(False))
    faced = apart & enough & near("place") & fresh
    if possible is not None:
        faced &= possible
    if marks is not None:
        faced &= _lacking(percent)
    return left.join(right, on).filter(faced).select("hub", "n", "of_hub", "s_hub", "member", "m", "of_member", "s_member")


def bucket_components(
    blocked: DataFrame,
    contents: Callable[[DataFrame], DataFrame],
    linked: Callable[[DataFrame], DataFrame],
    tokens: Callable[[DataFrame], DataFrame],
    percent: int,
    within: bool = False,
    everyone: DataFrame | None = None,
    possible: Column | None = None,
    marks: Callable[[DataFrame], DataFrame] | None = None,
    rounds: int | None = None,
) -> DataFrame | None:
    """node, component (the smallest node of its connected group) of nodes that share buckets; None if there are none.

    blocked: key, node, n (its size) and optionally s (a sketch) of each node in each
    bucket. contents gives ``node`` and the columns that are compared for a table of
    nodes; linked turns (hub, member, contents of both) into (hub, member, linked);
    tokens turns contents into node, slack, share, tokens and optionally places, and marks into node and its bits (see _prefix_pairs).
    Only pairs whose sizes allow ``percent`` of similarity, and whose sketches s_hub
    and s_member are ``possible``, are asked for. within: the last step's pairs
    share a bucket, as all others do.

    In buckets of up to FEW members all pairs are compared. A larger one proposes a star, its centre with
    every other member of another component. Each member takes one of the centres of its
    buckets in a round, so a round has no more pairs than nodes; buckets that hold one
    component only are done with. A bucket's centre is its best-linked member. Of what ``rounds`` (STAR_ROUNDS)
    have left open, members of different components are compared: all in a bucket of FEW members (with marks, MARKED times as many, of which few pairs are left by their marks),
    and in a larger one those whose rarest tokens meet, which loses no link. No cap
    is set on either, and no pair is compared twice.

    everyone (node, n, s of all nodes): the last step takes all of these, whether or
    not they share a bucket, and compares those whose rarest tokens meet anywhere;
    buckets then only settle links sooner. No pair that is alike is missed.
    """
    spark = blocked.sparkSession
    rounds = STAR_ROUNDS if rounds is None else rounds
    if "s" not in blocked.columns:
        blocked = blocked.withColumn("s", F.lit(0).cast("long"))
    if everyone is not None and "s" not in everyone.columns:
        everyone = everyone.withColumn("s", F.lit(0).cast("long"))
    fits = _alike_in_size("n", "m", percent) if possible is None else _alike_in_size("n", "m", percent) & possible

    def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of buckets of two to FEW members, and of larger ones."""
        # Counts of rows: nodes that a bucket has twice count twice, and go to the larger ones at worst.
        sizes = rows.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
        shared = stored(rows.join(sizes, "key").select("key", "node", "n", "s", F.col("node").alias("label"), "held"))
        return shared.filter(F.col("held") <= FEW).drop("held"), shared.filter(F.col("held") > FEW).drop("held").distinct()

    small, opened = parted(blocked)
    near = stored(_met(small).filter(fits).select("hub", "member").distinct())
    opened = opened.withColumn("degree", F.lit(0).cast("long"))
    nodes = near.select(F.explode(F.array("hub", "member")).alias("node")).union(opened.select("node"))
    nodes = stored((nodes if everyone is None else everyone.select("node")).distinct())
    if nodes.isEmpty():
        return None
    name, place = f"held_{uuid.uuid4().hex}", None
    try:
        place = _table(contents(nodes), "node", name)
        held = spark.table(name)

        def confirmed(pairs: DataFrame) -> DataFrame:
            found = linked(_faced(pairs.select("hub", "member"), held)).filter("linked")
            return found.select(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b")).distinct()

        links = stored(confirmed(near))
        labels = nodes.select("node", F.col("node").alias("component"))
        if not links.isEmpty():
            joined = components(links)
            labels = stored(labels.join(joined.withColumnRenamed("component", "joined"), "node", "left").select("node", F.coalesce("joined", "node").alias("component")))
        tested = near.select(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b"))

        def relabelled(rows: DataFrame) -> DataFrame:
            """Rows with their labels of now, without buckets of one component."""
            # Rows of a node take its label in a window over the node: as many rows as come in, a node's keys at most in each.
            own = rows.select("key", "node", "n", "s", "degree", F.lit(None).cast("long").alias("fresh"))
            told = labels.select(*[F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) if c != "node" else F.col("node") for c in ("key", "node", "n", "s", "degree")], F.col("component").alias("fresh"))
            placed = own.unionByName(told).withColumn("label", F.max("fresh").over(Window.partitionBy("node"))).filter("key is not null").select("key", "node", "n", "s", "label", "degree")
            mixed = placed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
            return stored(placed.join(mixed.select("key"), "key"))

        opened = relabelled(opened)
        for turn in range(rounds + 1):
            if everyone is None and opened.isEmpty():
                break
            if turn < rounds:
                # Each member meets one of the centres of its buckets, the best-linked, and another one in each round.
                centres = opened.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("order"), "node", "n", "s", "label")).alias("hub"))
                starred = opened.join(centres, "key")
                hub = [F.col(f"hub.{c}").alias(as_name) for c, as_name in (("node", "hub"), ("n", "n"), ("label", "of_hub"), ("s", "s_hub"))]
                # The smallest, then the best-linked, then any: one that was met in vain is not met again in every round.
                rank = (F.col("hub.node"), -F.col("hub.degree"), F.xxhash64("hub.node"))[turn % 3]
                near_first = rank.cast("long").alias("order")
                met_hubs = starred.select(near_first, *hub, F.col("node").alias("member"), F.col("n").alias("m"), F.col("label").alias("of_member"), F.col("s").alias("s_member"))
                fit = met_hubs.filter((F.col("of_hub") != F.col("of_member")) & fits)
                lead = F.min(F.struct("order", "hub", "n", "of_hub", "s_hub", "m", "of_member", "s_member")).alias("lead")
                chosen = fit.groupBy("member").agg(lead).select("member", "lead.*").drop("order")
            elif everyone is not None:
                placed = stored(everyone.join(labels.withColumnRenamed("component", "label"), "node"))
                chosen = _prefix_pairs(placed, tokens(held), False, percent, possible, marks and marks(held))
            else:
                most = FEW if marks is None else MARKED * FEW
                sized = stored(opened.join(opened.groupBy("key").agg((F.count("*") <= most).alias("few")), "key"))
                chosen, many = sized.filter("few"), sized.filter("not few")
                chosen = _met(chosen) if marks is None else _met_once(chosen, marks(held.join(chosen.select("node").distinct(), "node", "left_semi")), fits, percent)
                if not many.isEmpty():
                    asked = held.join(many.select("node").distinct(), "node", "left_semi")
                    chosen = chosen.union(_prefix_pairs(many, tokens(asked), within, percent, possible, marks and marks(asked)))
            fitting = chosen.filter((F.col("of_hub") != F.col("of_member")) & fits)
            turned = F.col("hub") > F.col("member")
            ordered = fitting.select(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b"), turned.alias("turned"), F.least("of_hub", "of_member").alias("x"), F.greatest("of_hub", "of_member").alias("y"))
            pairs = stored(ordered.groupBy("a", "b", "x", "y").agg(F.min("turned").alias("turned")).join(tested, ["a", "b"], "left_anti"))
            ends = [F.when(F.col("turned"), F.col(p)).otherwise(F.col(q)).alias(end) for p, q, end in (("b", "a", "hub"), ("a", "b", "member"))]
            links = stored(pairs.select("a", "b", "x", "y").join(confirmed(pairs.select(*ends)), ["a", "b"], "left_semi"))
            tested = tested.union(pairs.select("a", "b"))
            if not links.isEmpty():
                joined = components(links, "x", "y").select(F.col("node").alias("label"), F.col("component").alias("joined"))
                labels = stored(labels.withColumnRenamed("component", "label").join(joined, "label", "left").select("node", F.coalesce("joined", "label").alias("component")))
            if turn < rounds:
                if not links.isEmpty():
                    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("more"))
                    opened = opened.join(degrees, "node", "left").withColumn("degree", F.col("degree") + F.coalesce("more", F.lit(0))).drop("more")
                opened = relabelled(opened)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        if place:
            remove(spark, place)
    return labels
