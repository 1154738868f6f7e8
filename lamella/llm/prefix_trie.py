"""Prefix trie of conversations that start with the first turns of another one, by composable fingerprints.

A rebuilt conversation is a head of another conversation (its base) followed by turns of its own. Its texts are never put
together. A sequence of turns has as fingerprint an element of a monoid: its length n and, for each of two bases B, the
sum of t(i) * B**i modulo 2**61 - 1 over its turns. A conversation's turns give the fingerprints of all its prefixes as
running products; the fingerprint of a rebuilt prefix follows from four of them: that of the base's head, followed by
that of the own turns up to a place, the turns left out divided off (a subtraction and a power of B). So every prefix is
a small row: the conversation, the depth, the fingerprint, that of the prefix before it, and the last turn's class.

- Equality is verified. A turn's class is a hash of role and text; distinct (role, text) of one class are looked for
  once, on the texts. Prefixes of one fingerprint form a node; all have to share depth, last turn's class and the
  fingerprint before it, which by induction makes the sequences equal. If either check fails, all is done again with
  another hash or base; after TRIES attempts that is an error.
- A node is named by its least member and its depth. The nodes of one name form a chain down from the place where it
  leaves its parent's chain; totals over subtrees come from doubling along the chains' parents (rounds: the logarithm of
  the deepest nesting) and from running sums within a chain.
- Running products and sums are taken in range partitions and carried over from one to the next by a table with a row a
  partition, so a conversation or chain of any length is many tasks. Joins that meet a hot node (one that very many
  conversations share) have cut inputs, so that adaptive execution can split them. The ids that end in one node are
  packed into strings in order, in parallel; only hashing them (SHA-256 has no other way) follows one stream a node, in
  constant memory.

Results: nodes of the conversations that have a row with a conv_id; rows whose conv_id is null belong to none. Turns stand in
order of turn, null first; of equal turns the class (a hash of role and text) decides, so that repeated rows are turns of
their own, next to each other. A null role or text is empty; a text without words counts no tokens. An empty table has no
node, not even a root. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.session import cut, settled

PRIME = (1 << 61) - 1
#: Pairs of bases; the next pair is taken if two different sequences share a fingerprint.
BASES = ((1_181_783_497_276_652_981, 2_076_590_714_853_062_431), (911_382_323_777_431_907, 1_450_689_103_311_640_713), (1_731_950_013_842_211_173, 655_360_001_912_118_733))
TRIES = len(BASES)
#: Turns of a base that a head takes at most.
HEAD = 3
#: Bytes of the ids that are packed into one row.
PACK = 1 << 16

WORDS = r"size(filter(split(text, '[\\x20\\x09-\\x0D]+', -1), w -> w != ''))"


def turn_hash(attempt: int) -> Column:
    return F.xxhash64(F.lit(attempt), "role", "text")


def _power(base: int) -> Callable[[Column], Column]:
    """base ** n modulo PRIME of a column."""

    @F.pandas_udf("long")
    def power(n: pd.Series) -> pd.Series:
        places, at = np.unique(n.to_numpy(np.int64), return_inverse=True)
        return pd.Series(np.array([pow(base, int(p), PRIME) for p in places], np.int64)[at.ravel()])

    return lambda n: power(n.cast("long"))


def _times(a: Column, b: Column) -> Column:
    """a * b modulo PRIME, for a and b from 0 to PRIME - 1."""
    return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)") % F.lit(PRIME).cast("decimal(19,0)")).cast("long")


def _plus(*parts: Column) -> Column:
    """The sum modulo PRIME of values from -PRIME to PRIME, up to three of them."""
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return F.pmod(total, F.lit(PRIME))


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in range partitions of the order, numbered by _part, written to the shared folder."""
    return cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _carried(totals: DataFrame, key: str, before: dict[str, Column]) -> DataFrame:
    """totals (of _part and key) with what stands before a part; only keys that go on from an earlier part: one a part at most."""
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    for name, value in before.items():
        totals = totals.withColumn(name, value.over(earlier))
    return totals.where(F.col(next(iter(before))).isNotNull())


def prefixes(conversations: DataFrame, attempt: int = 0, hashed: Callable[[int], Column] = turn_hash, bases=BASES) -> tuple[DataFrame, bool]:
    """(conv_id, pos, cls, words, s0, s1, p0, p1) of every turn: the fingerprints up to it (s) and before it (p).

    The flag says whether no two different turns share a class.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.where("conv_id is not null").withColumn("cls", hashed(attempt))
    shared = turns.groupBy("cls", "role", "text").agg(F.lit(1).alias("one")).groupBy("cls").count().where("count > 1")
    if shared.limit(1).count():
        return turns, False
    order = ["conv_id", "turn", "cls", "row"]
    rows = turns.select("conv_id", "turn", "cls", F.expr(WORDS).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    rows = _ranged(rows, order)
    powers = [_power(b) for b in bases[attempt]]
    own = Window.partitionBy("_part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "cls", "row")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("n", (F.row_number().over(own) - 1).cast("long"))
    for k, power in enumerate(powers):
        residue = F.pmod(F.col("cls") if k == 0 else F.xxhash64("cls"), F.lit(PRIME))
        rows = rows.withColumn(f"t{k}", _times(residue, power(F.col("n"))))
    totals = rows.groupBy("_part", "conv_id").agg(F.count(F.lit(1)).alias("size"), *(_mod_sum(f"t{k}").alias(f"l{k}") for k in (0, 1)))
    before = _carried(totals, "conv_id", {"before": F.sum("size")})
    # the product of the earlier parts' elements, from their sizes and sums
    totals = totals.join(before.select("_part", "conv_id", "before"), ["_part", "conv_id"], "left").withColumn("before", F.coalesce("before", F.lit(0).cast("long")))
    for k, power in enumerate(powers):
        totals = totals.withColumn(f"g{k}", power(F.col("before"))).withColumn(f"l{k}", _times(F.col(f"l{k}"), F.col(f"g{k}")))
    carry = _carried(totals, "conv_id", {"c0": F.sum(F.col("l0").cast("decimal(38,0)")), "c1": F.sum(F.col("l1").cast("decimal(38,0)"))})
    carry = carry.select("_part", "conv_id", "before", "g0", "g1", *((F.col(f"c{k}") % PRIME).cast("long").alias(f"c{k}") for k in (0, 1)))
    for k in (0, 1):
        rows = rows.withColumn(f"s{k}", (F.sum(F.col(f"t{k}").cast("decimal(38,0)")).over(upto) % PRIME).cast("long"))
    rows = rows.join(F.broadcast(carry), ["_part", "conv_id"], "left")  # a row a partition at most
    for k in (0, 1):
        moved = lambda c, k=k: F.when(F.col("before").isNull(), c).otherwise(_times(c, F.col(f"g{k}")))
        rows = rows.withColumn(f"t{k}", moved(F.col(f"t{k}")))
        rows = rows.withColumn(f"s{k}", _plus(moved(F.col(f"s{k}")), F.coalesce(f"c{k}", F.lit(0).cast("long"))))
        rows = rows.withColumn(f"p{k}", _plus(F.col(f"s{k}"), -F.col(f"t{k}")))
    return rows.select("conv_id", (F.col("n") + F.coalesce("before", F.lit(0).cast("long"))).alias("pos"), "cls", "words", "s0", "s1", "p0", "p1"), True


def _mod_sum(name: str) -> Column:
    return (F.sum(F.col(name).cast("decimal(38,0)")) % PRIME).cast("long")


def rebuilt(turns: DataFrame, base: Column, head: Column, bases: tuple[int, int], most: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, depth: turns when rebuilt) and their prefixes from depth 1 on.

    Prefixes: conv_id, depth, k0, k1 (fingerprint), p0, p1 (that before), cls and words of the last turn, last (whether
    the conversation ends here). base and head are columns over conv_id: the conversation that gives the head, and how
    many of its turns that are (at most `most`).
    """
    turn = F.struct("pos", "cls", "words", "s0", "s1", "p0", "p1")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") < most, turn))).alias("own"))
    convs = cut(convs.withColumn("base", base.cast("long")).withColumn("h", head.cast("int")))
    info = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("own").alias("theirs")), "base", "left")
    info = info.withColumn("m", F.least("h", F.coalesce(F.size("theirs"), F.lit(0)))).withColumn("m", F.greatest("m", F.lit(0)))
    info = info.withColumn("depth_all", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    for k in (0, 1):
        info = info.withColumn(f"b{k}", F.when(F.col("m") > 0, F.expr(f"get(theirs, m - 1).s{k}")).otherwise(F.lit(0).cast("long")))
        info = info.withColumn(f"o{k}", F.when(F.col("h") > 0, F.coalesce(F.expr(f"get(own, h - 1).s{k}"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))
    info = cut(info)
    heads = info.where("m > 0").select("conv_id", "depth_all", F.explode(F.expr("slice(theirs, 1, m)")).alias("t"))
    heads = heads.select("conv_id", (F.col("t.pos") + 1).alias("depth"), "depth_all", F.col("t.cls").alias("cls"), F.col("t.words").alias("words"), F.col("t.s0").alias("k0"), F.col("t.s1").alias("k1"), F.col("t.p0").alias("p0"), F.col("t.p1").alias("p1"))
    own = turns.join(info.select("conv_id", "h", "m", "depth_all", "b0", "b1", "o0", "o1"), "conv_id").where("pos >= h")
    for k, number in enumerate(bases):
        factors = F.array(*(F.lit(pow(number, -d % (PRIME - 1), PRIME)) for d in range(most + 1)))
        factor = F.get(factors, F.col("h") - F.col("m"))
        for name, of in ((f"k{k}", f"s{k}"), (f"p{k}", f"p{k}")):
            own = own.withColumn(name, _plus(F.col(f"b{k}"), _times(factor, _plus(F.col(of), -F.col(f"o{k}")))))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("depth"), "depth_all", "cls", "words", "k0", "k1", "p0", "p1")
    rows = heads.unionByName(own).withColumn("last", F.col("depth") == F.col("depth_all")).drop("depth_all")
    return info.select("conv_id", F.col("depth_all").alias("depth")), rows


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, k0, k1, ends_sha256) of ends (depth, k0, k1, conv_id): the ids in order, joined by commas."""
    keys = ["depth", "k0", "k1"]

    def pack(batches):
        held, ids, size = None, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*held, ids[0], ",".join(map(str, ids)))], names=[*keys, "first", "ids"])

        for batch in batches:
            done = []
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in [*keys, "conv_id"]), strict=True):
                if ids and (key != held or size > PACK):
                    done.append(row())
                    ids, size = [], 0
                held = key
                ids.append(conv)
                size += len(str(conv)) + 1
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if ids:
            yield row()

    def digest(batches):
        held, state = None, None

        def rows(done):
            return pa.RecordBatch.from_arrays([*(pa.array([d[0][i] for d in done], pa.int64()) for i in range(3)), pa.array([d[1] for d in done], pa.string())], names=[*keys, "ends_sha256"])

        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*keys, "ids"]), strict=True):
                if key != held:
                    if state is not None:
                        done.append((held, state.hexdigest()))
                    held, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield rows(done)
        if state is not None:
            yield rows([(held, state.hexdigest())])

    ends = ends.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    packed = ends.mapInArrow(pack, "depth long, k0 long, k1 long, first long, ids string")
    packed = packed.repartition(*keys).sortWithinPartitions(*keys, "first")
    return packed.mapInArrow(digest, "depth long, k0 long, k1 long, ends_sha256 string")


def _subtrees(chains: DataFrame) -> DataFrame:
    """chains (conv_id, up, leaves, saved) with leaves and saved summed over all chains below, by doubling along up."""
    now = cut(chains)
    while now.where("up is not null").limit(1).count():
        below = now.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("yet"))
        above = now.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        now = now.join(above, "up", "left").drop("up").join(below, "conv_id", "left")
        now = settled(now.select("conv_id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("yet", F.lit(0))).alias("saved")))
    return now


def trie(conversations: DataFrame, base: Column, head: Column, hashed: Callable[[int], Column] = turn_hash, bases=BASES, most: int = HEAD) -> DataFrame:
    """The nodes of the rebuilt conversations' trie.

    conv_id (least member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves (childless
    nodes in the subtree, itself included), saved_tokens (over the subtree, members beyond the first times the words of
    the node's last turn) and ends_sha256 (of the ids of members that end here, in order, joined by commas).
    """
    for attempt in range(len(bases)):
        turns, distinct = prefixes(conversations, attempt, hashed, bases)
        if not distinct:
            continue
        convs, rows = rebuilt(cut(turns), base, head, bases[attempt], most)
        rows = cut(rows)
        same = ("p0", "p1", "cls", "words")
        nodes = rows.groupBy("depth", "k0", "k1").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.min(c).alias(c) for c in same), *(F.max(c).alias(f"{c}_most") for c in same))
        nodes = cut(nodes)
        if not nodes.where(" or ".join(f"{c} != {c}_most" for c in same)).limit(1).count():
            break
    else:
        raise RuntimeError("different sequences of turns share fingerprints under all bases")

    first = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("conv_id is not null")
    zero = F.lit(0).cast("long")
    root = first.select("conv_id", zero.alias("depth"), "n_convs", zero.alias("words"), zero.alias("k0"), zero.alias("k1"), F.lit(None).cast("long").alias("parent_conv_id"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.where("depth > 1").join(above, ["depth", "p0", "p1"])
    top = nodes.where("depth = 1").crossJoin(F.broadcast(first.select(F.col("conv_id").alias("parent_conv_id"))))  # one row
    columns = ["conv_id", "depth", "n_convs", "words", "k0", "k1", "parent_conv_id"]
    nodes = cut(named.select(columns).unionByName(top.select(columns)).unionByName(root.select(columns)))

    kids = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = cut(nodes)
    tops = F.when(F.col("parent_conv_id") != F.col("conv_id"), F.col("parent_conv_id"))
    chains = cut(nodes.groupBy("conv_id").agg(F.max(tops).alias("up"), F.min("depth").alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    whole = _subtrees(chains.select("conv_id", "up", "leaves", "saved"))
    joints = chains.where("up is not null").select("conv_id", "up", "top").join(whole.select("conv_id", "leaves", "saved"), "conv_id")
    joints = joints.groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("yet"))
    nodes = nodes.join(joints, ["conv_id", "depth"], "left")
    nodes = nodes.withColumn("leaves", F.col("leaves") + F.coalesce("more", zero)).withColumn("saved", F.col("saved") + F.coalesce("yet", zero)).withColumn("back", -F.col("depth"))
    nodes = _ranged(nodes.drop("more", "yet"), ["conv_id", "back"])
    deeper = Window.partitionBy("_part", "conv_id").orderBy("back").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = nodes.groupBy("_part", "conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    carry = _carried(totals, "conv_id", {"more": F.sum("leaves"), "yet": F.sum("saved")}).select("_part", "conv_id", "more", "yet")
    nodes = nodes.withColumn("leaves", F.sum("leaves").over(deeper)).withColumn("saved", F.sum("saved").over(deeper))
    nodes = nodes.join(F.broadcast(carry), ["_part", "conv_id"], "left")  # a row a partition at most
    bare = convs.where("depth = 0").select(zero.alias("depth"), zero.alias("k0"), zero.alias("k1"), "conv_id")
    ends = _end_hashes(rows.where("last").select("depth", "k0", "k1", "conv_id").unionByName(bare))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends, ["depth", "k0", "k1"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.coalesce("more", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("yet", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
