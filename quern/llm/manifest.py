"""Merkle manifest of a dataset: event-driven combining of digests, proofs along reverse links.

Leaves are the digests of rows; those of a source ascend by id and make one tree, whose
nodes have ``arity`` children, fewer at the right edge. Subroots make a tree by source.
All digests are sha256 over hex texts.

A tree's size gives the arity of each of its nodes. So a partial parent knows when it is
complete: it accumulates child digests with their places, and the moment the last
one arrives it becomes a node and its digest the child of the next parent. Each
partition combines what it has, from sorted leaves nearly all of its tree; the
partial parents that are left, a few at each of its ends, are shuffled by an ancestor
that many of them share and combined again, until no parent is open. At most one open
parent a level is held for sorted leaves, and for the rest what one ancestor has.

Every node keeps its children, so links run from the root down: the siblings on a node's
path are those beside it and those of its parent's path. Leaves take theirs from
their parent, sixteen at a time.

Defined results: null columns are ``-``; null ids come first, rows of one id by
leaf; equal rows are leaves of their own; null sources are one source, the first; ids
under tampering are null as ''; texts of any length are hashed whole; a lone leaf is its
subroot and a lone subroot the root, neither has siblings; no rows: no rows; only
the five columns are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import cut, scratch
from quern.llm.ranks import counted, placed, small

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one shuffle of open parents brings together.
REACH = 4
#: Rows of a batch of results.
BATCH = 10_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: level 1 and above; kids: place within the parent, digest, and of leaves what comes with them.
_PARTIAL = "tree string, size bigint, level int, at bigint, kids array<struct<k:int,digest:binary,doc_id:{kind},tampered:binary>>, digest binary"


def leaf(*columns: Column) -> Column:
    """The digest of a row's columns, as bytes."""
    def part(c):
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.unhex(F.sha2(F.concat(*map(part, columns)), 256))


def parent(kids: list[bytes]) -> bytes:
    return hashlib.sha256("".join([k.hex() for k in kids]).encode()).digest()


def arity(size: int, level: int, at: int) -> int:
    """Children of the node of this level (leaves are level 0) and place, in a tree of so many leaves."""
    below = -(-size // ARITY ** (level - 1))
    return min(ARITY, below - at * ARITY)


def is_top(size: int, level: int) -> bool:
    return size <= ARITY**level


def _combine(kind: str):
    """Over rows of partial parents: parents as they become complete, their digests passed up; then what is still open."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("kids", pa.list_(pa.struct([("k", pa.int32()), ("digest", pa.binary()), ("doc_id", kind), ("tampered", pa.binary())]))), ("digest", pa.binary())])
        open_, out = {}, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        for b in batches:
            for tree, size, level, at, kids in zip(*(b.column(k).to_pylist() for k in range(5))):
                while True:
                    held = open_.setdefault((tree, size, level, at), [])
                    held += kids
                    if len(held) < arity(size, level, at):
                        break
                    del open_[tree, size, level, at]
                    held.sort(key=lambda x: x["k"])
                    # The parent of a lone leaf is that leaf.
                    digest = held[0]["digest"] if size == 1 else parent([x["digest"] for x in held])
                    out.append((tree, size, level, at, held, digest))
                    if is_top(size, level):
                        break
                    level, kids = level + 1, [{"k": at % ARITY, "digest": digest, "doc_id": None, "tampered": None}]
                    at //= ARITY
                if len(out) >= BATCH // ARITY:
                    yield batch()
                    out = []
        out += [(*key, kids, None) for key, kids in open_.items()]
        for k in range(0, len(out), BATCH // ARITY):
            some = out[k : k + BATCH // ARITY]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*some), schema.types)], schema=schema)

    return run


def nodes(leaves: DataFrame, kind: str = "bigint") -> DataFrame:
    """All nodes over leaves (tree, size, at, digest, doc_id, tampered): tree, size, level, at, kids, digest. The leaves are best sorted by tree and place."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(leaves.select("doc_id").schema).field(0).type if "doc_id" in leaves.columns else pa.int64()
    schema = _PARTIAL.format(kind=kind)
    kid = F.struct((F.col("at") % ARITY).cast("int").alias("k"), "digest", "doc_id", "tampered")
    todo = leaves.select("tree", "size", F.lit(1).alias("level"), F.floor(F.col("at") / ARITY).alias("at"), F.array(kid).alias("kids"))
    spark, level, found = leaves.sparkSession, 1, []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # What leaves belong to is kept apart: upper levels are read without it.
        path = scratch(spark, "merkle")
        todo.mapInArrow(_combine(arrow), schema).withColumn("low", F.col("level") == 1).write.partitionBy("low").parquet(path)
        made = spark.read.schema(f"{schema}, low boolean").parquet(path)
        found.append(made.where("digest is not null"))
        todo = made.where("digest is null").drop("digest", "low")
        if todo.isEmpty():
            break
        # Open parents below the level meet at their ancestor there; the others wait.
        level += REACH
        up = F.expr(f"CASE WHEN level < {level} THEN shiftright(at, 4 * ({level} - level)) ELSE at END")
        todo = todo.repartition(parts, "tree", F.greatest(F.col("level"), F.lit(level)), up).sortWithinPartitions("tree", "level", "at")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _tops(level: int | None = None) -> Column:
    """Whether a node is its tree's top; ``level`` where it is known."""
    return F.col("size") <= (F.pow(F.lit(float(ARITY)), F.col("level")) if level is None else F.lit(min(ARITY**level, (1 << 63) - 1)))


def _linked(every: DataFrame, tops: DataFrame) -> DataFrame:
    """Level-1 nodes with ``path``: the steps (k, children's digests) from each to the end of its top's path, nearest first, and what else tops have.

    ``tops``: tree, path, and more columns, a row a tree.
    """
    rows = every.withColumn("of", F.transform("kids", lambda x: x["digest"]))
    more = [c for c in tops.columns if c not in ("tree", "path")]
    tops, up = small(tops), None
    for level in range(every.agg(F.max("level")).first()[0], 0, -1):
        here = rows.where((F.col("level") == level) & (F.col("low") == (level == 1)))
        # The top of a tree goes on with the tree's own path.
        found = here.where(_tops(level)).join(tops, "tree")
        if up is not None:
            above = up.select(F.col("tree").alias("up_tree"), F.col("at").alias("up_at"), F.col("of").alias("up_of"), F.col("path").alias("up_path"), *more)
            step = F.struct((F.col("at") % ARITY).cast("int").alias("k"), F.col("up_of").alias("of"))
            below = here.where(~_tops(level)).join(above, (F.col("tree") == F.col("up_tree")) & (F.floor(F.col("at") / ARITY) == F.col("up_at")))
            found = found.unionByName(below.withColumn("path", F.concat(F.array(step), "up_path")).select(*found.columns))
        up = found
    return up


STEPS = "array<struct<k:int,of:array<binary>>>"


def manifest(docs: DataFrame, tampered: Column | None = None, proofs: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, in hex.

    ``tampered`` is a text or null that takes each text's place when the root is folded
    anew; with ``proofs`` the column ``proof`` holds the steps (place, and the digests of
    all children there) from the leaf to the root.
    """
    kind = dict(docs.dtypes)["doc_id"]
    text = F.col("text") if tampered is None else tampered
    # Null sources come first, all others sort by their bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree")
    columns = [F.col(c) for c in FIELDS]
    changed = F.when(~text.eqNullSafe(F.col("text")), leaf(*columns[:-1], text))
    leaves = docs.select("doc_id", tree, leaf(*columns).alias("digest"), changed.alias("tampered"))
    leaves = counted(placed(leaves, ["tree", F.col("doc_id").asc_nulls_first(), "digest"], "leaves", "tree", "doc_id", "digest", "tampered"), "tree")
    own = nodes(leaves, kind)
    tops = cut(own.where(_tops()).select("tree", F.col("digest").alias("subroot")))
    if tops.isEmpty():
        more = [F.array().cast(STEPS).alias("proof")] if proofs else []
        return docs.limit(0).select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"), *more)
    upper = tops.select(F.lit("top").alias("top"), "tree", F.col("subroot").alias("digest"))
    upper = counted(placed(upper, ["tree"], "subroots", "top", "tree", "digest"), "top")
    over = nodes(upper.select(F.col("top").alias("tree"), "size", "at", "digest", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("tampered")))
    root = over.where(_tops()).first().digest
    start = over.sparkSession.createDataFrame([("top", [])], f"tree string, path {STEPS}")
    top_parents = _linked(over, start).select(F.col("at").alias("up_at"), "of", "path")
    step = F.struct((F.col("at") % ARITY).cast("int").alias("k"), "of")
    way = upper.select("tree", "at").join(small(cut(top_parents)), F.floor(F.col("at") / ARITY) == F.col("up_at"))
    # A step with one child and nothing hashed stands for a lone subroot.
    alone = upper.select("size").first().size == 1
    way = way.select("tree", F.array().cast(STEPS).alias("path") if alone else F.concat(F.array(step), "path").alias("path"))
    parents = _linked(own, cut(way.join(tops, "tree")))
    out = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", proof {STEPS}" if proofs else "")
    return parents.select("size", "kids", "path", "subroot").mapInArrow(_proofs(root, proofs), out)


def siblings(k: int, of: list[bytes]) -> str:
    return "".join([d.hex() for j, d in enumerate(of) if j != k])


def fold(digest: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root over a digest and the siblings on its path."""
    for k, of in path:
        digest = parent([*of[:k], digest, *of[k + 1 :]])
    return digest


def _proofs(root: bytes, proofs: bool):
    def run(batches):
        import pyarrow as pa

        hexed, names = root.hex(), ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
        steps_type = pa.list_(pa.struct([("k", pa.int32()), ("of", pa.list_(pa.binary()))]))
        for b in batches:
            rows = []
            ids = b.column(1).flatten().field("doc_id")
            for size, kids, path, subroot in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                steps = [(s["k"], s["of"]) for s in path]
                upper = "".join([siblings(k, of) for k, of in steps])
                of, sub, same = [x["digest"] for x in kids], subroot.hex(), None
                for k, x in enumerate(kids):
                    beside = "" if size == 1 else siblings(k, of)
                    proof = hashlib.sha256((beside + upper).encode()).hexdigest()
                    whole = lambda d: fold(d if size == 1 else parent([*of[:k], d, *of[k + 1 :]]), steps)  # noqa: B023, E731
                    if x["tampered"] is not None:
                        folded = whole(x["tampered"])
                    else:
                        # Untouched leaves of one parent fold through the same digests.
                        folded = same = same or whole(x["digest"])
                    row = (x["digest"].hex(), sub, hexed, proof, folded.hex(), folded == root)
                    rows.append((*row, path if size == 1 else [{"k": k, "of": of}, *path]) if proofs else row)
            if rows:
                columns = [pa.array(list(c), steps_type if j == 6 else None) for j, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=names[: 1 + len(columns)])

    return run
