"""Prefix trie of conversations by preorder intervals.

Conversations are sequences of turns; a node is a distinct sequence of first turns. The
distinct whole sequences are ranked lexicographically, across partitions. A node's
subtree is then an interval of ranks: from the first to the last member. Each sequence
adds, after what it shares with those before it, new nodes one below the other, so
running counts of new nodes over the ranks give every node its place in preorder and the
place where its subtree ends. What a subtree sums up (leaves, saved tokens) is the
difference of running sums at those two places.

Turns are known by two hashes of role and text (128 bits), sequences by the XOR of
their turns' hashes with depths mixed in, so prefixes of all depths come from running
aggregates; the rank key has eight bytes a turn, and no text is moved after the turns are
numbered.

Parents with many children are looked up from a broadcast side: more than
1/MANY of all nodes are children of fewer than MANY parents. Equal sequences are
counted before they are ranked. The ids that end at a node are written in chunks in
order, by partition, and hashed as a stream.

Defined results: turns come by turn, role, text, nulls first; null roles and texts are
empty; repeated rows are repeated turns; a null conv_id is a conversation of its own,
without donor, after all other ids, and the empty text among ends; donors that don't
exist give nothing; a conversation may be left without turns and then ends at the root;
no rows: no nodes; other columns stay unread. A conversation's key must fit one row;
long texts have no effect on it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import cut, stored
from quern.llm.ranks import counted, part, placed, running, small

#: Parents that are broadcast at most: those with more than 1/MANY of all nodes, or than FEW, as children.
MANY, FEW = 20_000, 64
#: Ids of a chunk that end at a node.
CHUNK = 4_096
SEEDS = (20_023, 20_029)


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, i (from 0), chars and two codes of every turn."""
    filled = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").isNotNull().alias("has_role"), F.col("text").isNotNull().alias("has_text"))
    codes = [F.xxhash64("role", "text", F.lit(s)).alias(f"c{k}") for k, s in enumerate(SEEDS)]
    nulls_first = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn")]
    rows = placed(filled, [*nulls_first, "has_role", "role", "has_text", "text"], "turns", "conv_id", F.length("text").cast("bigint").alias("chars"), *codes)
    return counted(rows, "conv_id").select("conv_id", F.col("at").alias("i"), "chars", "c0", "c1")


def rebuilt(own: DataFrame, donor: Column, first: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``first`` turns come from the conversation ``donor`` (columns of conv_id): their turns, and all their ids with the donor."""
    convs = cut(own.select("conv_id").distinct().select("conv_id", donor.alias("donor"), first.cast("bigint").alias("h")))
    most = convs.agg(F.max("h")).first()[0] or 0
    heads = own.where(F.col("i") < most).select(F.col("conv_id").alias("donor_id"), "i", "chars", "c0", "c1")
    lent = convs.join(heads, (F.col("donor") == F.col("donor_id")) & (F.col("i") < F.col("h"))).select("conv_id", "i", "chars", "c0", "c1")
    h = first.cast("bigint")
    kept = own.where(F.col("i") >= h)
    # Own turns follow what the donor had, which may be fewer than asked for.
    had = lent.groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("had"))
    kept = kept.join(small(cut(had)), F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", (F.col("i") - h + F.coalesce("had", F.lit(0))).alias("i"), "chars", "c0", "c1")
    return cut(lent.unionByName(kept)), convs.select("conv_id")


def nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie over turns (conv_id, i, chars, c0, c1) of conversations (conv_id)."""
    path = F.transform(F.array_sort(F.collect_list(F.struct("i", "c0"))), lambda x: x["c0"])
    mixed = [F.xxhash64(f"c{k}", "i") for k in range(2)]
    whole = rows.groupBy("conv_id").agg(path.alias("path"), *[F.bit_xor(m).alias(f"x{k}") for k, m in enumerate(mixed)], F.count("*").alias("depth"))
    empty = F.array().cast("array<bigint>")
    whole = convs.select(F.col("conv_id").alias("of")).join(whole, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    whole = stored(whole.select(F.col("of").alias("conv_id"), F.coalesce("path", empty).alias("path"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("x0", "x1", "depth")]), "sequences")
    one = ["depth", "x0", "x1"]
    # Equal sequences have one rank. c0 alone orders them; x0, x1 part what it would not.
    ranked = placed(whole.groupBy(*one).agg(F.first("path").alias("path")), ["path", "x0", "x1"], "ranked", *one)
    ends = whole.select("conv_id", *one).join(ranked, one).select("conv_id", *[F.col(c).alias(f"end_{c}") for c in one], "place")
    ends = stored(ends, "ends")

    # All prefixes of all conversations, the empty one included.
    below = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = rows.select("conv_id", (F.col("i") + 1).alias("depth"), "chars", *[F.bit_xor(m).over(below).alias(f"x{k}") for k, m in enumerate(mixed)], *[m.alias(f"m{k}") for k, m in enumerate(mixed)])
    roots = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(c) for c in ("chars", "x0", "x1", "m0", "m1")])
    prefixes = prefixes.unionByName(roots).join(ends.select(F.col("conv_id").alias("of"), "place"), F.col("conv_id").eqNullSafe(F.col("of")))
    up = [F.first(F.col(f"x{k}").bitwiseXOR(F.col(f"m{k}"))).alias(f"up{k}") for k in range(2)]
    found = prefixes.groupBy(*one).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.min("place").alias("first"), F.max("place").alias("last"), *up)
    found = stored(found, "nodes")

    total = found.count()
    limit = max(FEW, -(-total // MANY))
    children = cut(found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up0").alias("x0"), F.col("up1").alias("x1")).agg(F.count("*").alias("n_children")))
    found = stored(found.join(children, one, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "counted")
    parents = found.select(*[F.col(c).alias(f"up_{c}") for c in one], F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("brothers"))
    same = (F.col("depth") - 1 == F.col("up_depth")) & (F.col("up0") == F.col("up_x0")) & (F.col("up1") == F.col("up_x1"))
    # Fewer than MANY parents have more than total / MANY children each.
    large = F.broadcast(parents.where(F.col("brothers") > limit).drop("brothers"))
    named = found.join(large, same, "left")
    met, rest = named.where("up_depth is not null"), named.where("up_depth is null").drop(*[f"up_{c}" for c in one], "parent_conv_id")
    few = parents.where((F.col("brothers") <= limit) & (F.col("brothers") > 0)).drop("brothers")
    found = met.unionByName(rest.join(few, same, "left"))

    # New nodes of each rank, and running sums over the ranks.
    each = found.groupBy(F.col("first").alias("place")).agg(F.min("depth").alias("top"), F.count("*").alias("new"), F.sum(F.expr("int(n_children = 0)")).alias("leaves"), F.sum("saved").alias("saved"))
    each = running(stored(each, "intervals"), ["new", "leaves", "saved"])
    each = stored(each, "running")
    within = Window.partitionBy("first").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("saved_here", F.coalesce(F.sum("saved").over(within), F.lit(0)))
    start = each.select(F.col("place").alias("first"), "top", F.col("before_new").alias("s_new"), F.col("before_leaves").alias("s_leaves"), F.col("before_saved").alias("s_saved"))
    end = each.select(F.col("place").alias("last"), *[(F.col(f"before_{c}") + F.col(c)).alias(f"e_{c}") for c in ("new", "leaves", "saved")])
    found = found.join(start, "first").join(end, "last").join(_end_digests(ends), (F.col("depth") == F.col("end_depth")) & (F.col("x0") == F.col("end_x0")) & (F.col("x1") == F.col("end_x1")), "left")
    pre = F.col("s_new") + F.col("depth") - F.col("top")
    # A node before its sequence's last one is no leaf, so none lies between the rank's first node and it.
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("bigint").alias("n_children"), (F.col("e_leaves") - F.col("s_leaves")).alias("n_leaves"),
        (F.col("e_saved") - F.col("s_saved") - F.col("saved_here")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        pre.alias("preorder"), F.col("e_new").alias("subtree_end"),
    )


def _end_digests(ends: DataFrame) -> DataFrame:
    """end_depth, end_x0, end_x1, ends_sha256 of the nodes at which conversations end."""
    one = ["end_depth", "end_x0", "end_x1"]
    ids = placed(ends.select("conv_id", *one), [F.col("conv_id").asc_nulls_last()], "end-ids", "conv_id", *one)
    spot = F.struct("place", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("text"))
    # A sorted partition's ids of one node, a bounded lot to a row.
    lots = ids.groupBy(*one, part(F.col("place")).alias("part"), F.floor(F.col("place") / CHUNK).alias("lot")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(spot)), lambda x: x["text"]), ",").alias("text"))
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa

        now, h, out = None, None, []
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in range(3)))
            for key, text in zip(keys, b.column(3).to_pylist()):
                if key != now:
                    if now is not None:
                        out.append((*now, h.hexdigest()))
                    now, h = key, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
            if len(out) >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=[*one, "ends_sha256"])
                out = []
        if now is not None:
            out.append((*now, h.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=[*one, "ends_sha256"])

    dealt = lots.repartition(parts, *one).sortWithinPartitions(*one, "lot").select(*one, "text")
    return dealt.mapInArrow(run, "end_depth bigint, end_x0 bigint, end_x1 bigint, ends_sha256 string")
