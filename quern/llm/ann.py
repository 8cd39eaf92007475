"""Nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

Smallest Euclidean distance is largest inner product of (x, -|x|^2 / 2) with (q, 1);
the last coordinate is kept as it is. The vector part is product-quantised to four
bits per subspace. Codes and codebooks minimise |r|^2 + (eta - 1) (r . x/|x|)^2 of
the residual r, so that error along the vector, which moves large inner products
most, weighs eta times. Queries meet the rows in blocks: a table of 16 products per
subspace and query scores every row of the block, and the best ``DEPTH`` and their
ties are scored exactly on the original vectors. A row is no nearer than its decoded
vector less the length of its residual: all rows that this does not exclude are then
scored by exact products, so that each block gives its true nearest. Each query's
best of all blocks stay.

Of equal vectors only the smallest ids can be among the k nearest, so k + 1 of each
enter the blocks (one may be the query itself): nothing that could be found is lost.

Defined results: vectors that are null, zero, not finite, hold nulls or have another
length than most take no part; rows that repeat an id count as one for the query and
never answer themselves; equal distances come by id; fewer candidates give fewer
ranks; no rows: no rows; only vec_id and embedding are read, whatever else is there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import cut

#: Vectors that the codebooks are fitted on, at most.
FIT_ROWS = 20_000
#: Dimensions of a subspace, and weight of the parallel error.
SUB = 2
ETA = 4.0
#: Rows and queries of a block at most, and rows of a block that are scored exactly for each query.
ROWS, QUERIES, DEPTH = 65_536, 4_096, 160
#: Rows of a block at least, where there are as many: small tables are dealt to all tasks.
LEAST_ROWS = 8_192
#: Products held at a time.
SLAB = 8_000_000


class Codebooks:
    def __init__(self, books: np.ndarray, eta: float):
        self.books, self.eta = books, eta  # subspaces x 16 x SUB

    def parts(self, x: np.ndarray) -> np.ndarray:
        m, _, sub = self.books.shape
        out = np.zeros((len(x), m * sub))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, sub)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss."""
        p = self.parts(x)
        u = p / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        codes = ((p[:, :, None, :] - self.books[None]) ** 2).sum(-1).argmin(-1)
        m = len(self.books)
        along = np.stack([((p[:, j] - self.books[j][codes[:, j]]) * u[:, j]).sum(1) for j in range(m)], 1)
        for _ in range(rounds):
            total = along.sum(1)
            for j in range(m):
                r = p[:, j, None, :] - self.books[j][None]
                a = (r * u[:, j, None, :]).sum(-1)
                others = total - along[:, j]
                best = ((r**2).sum(-1) + (self.eta - 1) * (others[:, None] + a) ** 2).argmin(1)
                codes[:, j], along[:, j] = best, a[np.arange(len(p)), best]
                total = others + along[:, j]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for, padded to whole subspaces."""
        m = len(self.books)
        return self.books[np.arange(m), codes].reshape(len(codes), -1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query with each centre: queries x subspaces x 16."""
        return np.einsum("qms,mcs->qmc", self.parts(q), self.books).astype(np.float32)


def fit(x: np.ndarray, sub: int = SUB, eta: float = ETA, rounds: int = 6, seed: int = 5) -> Codebooks:
    """Codebooks: k-means starts, then alternating codes and weighted least squares."""
    rng = np.random.default_rng(seed)
    m = -(-x.shape[1] // sub)
    c = Codebooks(np.zeros((m, 16, sub)), eta)
    p = c.parts(x)
    for j in range(m):
        books = p[rng.choice(len(p), 16, replace=len(p) < 16), j]
        for _ in range(8):
            at = ((p[:, j, None] - books[None]) ** 2).sum(-1).argmin(1)
            n = np.bincount(at, minlength=16)
            for s in range(sub):
                books[:, s] = np.where(n > 0, np.bincount(at, p[:, j, s], 16) / np.maximum(n, 1), books[:, s])
        c.books[j] = books
    u = p / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    for _ in range(rounds):
        codes = c.encode(x, 1)
        along = np.stack([((p[:, j] - c.books[j][codes[:, j]]) * u[:, j]).sum(1) for j in range(m)], 1)
        for j in range(m):
            t = along.sum(1) - along[:, j] + (p[:, j] * u[:, j]).sum(1)
            for k in range(16):
                i = codes[:, j] == k
                if i.any():
                    a = np.eye(sub) * i.sum() + (eta - 1) * u[i, j].T @ u[i, j]
                    c.books[j, k] = np.linalg.solve(a, p[i, j].sum(0) + (eta - 1) * (t[i, None] * u[i, j]).sum(0))
            along[:, j] = ((p[:, j] - c.books[j][codes[:, j]]) * u[:, j]).sum(1)
    return c


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    even = np.concatenate([codes, np.zeros((len(codes), codes.shape[1] % 2), np.uint8)], 1)
    return np.ascontiguousarray(even[:, ::2] | (even[:, 1::2] << 4))


def unpacked(raw: np.ndarray, subspaces: int) -> np.ndarray:
    return np.stack([raw & 15, raw >> 4], 2).reshape(len(raw), -1)[:, :subspaces]


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(fine & F.col("vec_id").isNotNull())
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (size[0] if size else 0))


def search(vectors: DataFrame, k: int = 10, every: int = 100, rows: int = ROWS, queries: int = QUERIES, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, vec_id and score (distance) of the k nearest to each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    fine = valid(vectors)
    asked = fine.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    alike = Window.partitionBy("v").orderBy("vec_id")
    held = fine.dropDuplicates(["vec_id", "v"]).withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).drop("n")
    asked, held = cut(asked), cut(held)
    n, m = held.count(), asked.count()
    schema = "query_id bigint, vec_id bigint, score double"
    if not n or not m:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = held.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toArrow()
    x = np.array(sample["v"].to_pylist(), dtype=np.float64)
    books = fit(x)

    def coded(batches):
        import pyarrow as pa

        for b in batches:
            codes = books.encode(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in packed(codes)], pa.binary())], names=["vec_id", "v", "code"])

    # Every row goes to each block of queries and every query to each block of rows, so blocks are as large as memory allows.
    rows = min(rows, max(LEAST_ROWS, -(-n // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    n_rows, n_queries = -(-n // rows), -(-m // queries)
    row_side = held.mapInArrow(coded, "vec_id bigint, v array<double>, code binary").withColumn("rb", F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)))
    row_side = row_side.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    query_side = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_queries)).cast("int"))
    query_side = query_side.withColumn("rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_rows - 1).cast("bigint"))))

    def scan(left, right):
        import pyarrow as pa

        out = [], [], []
        if left.num_rows and right.num_rows:
            ids = left["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], _matrix(left["v"].combine_chunks())[order]
            raw = np.frombuffer(b"".join(left["code"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[order]
            codes = unpacked(raw, len(books.books))
            v2 = (v**2).sum(1)
            base = (-0.5 * v2).astype(np.float32)
            decoded = books.decode(codes)
            n2, off = (decoded**2).sum(1), np.sqrt(((books.parts(v).reshape(len(v), -1) - decoded) ** 2).sum(1))
            q_ids, q = right["vec_id"].to_numpy(), _matrix(right["v"].combine_chunks())
            table = books.tables(q)

            def nearest(near, i):
                near = near[ids[near] != q_ids[i]]
                d = np.sqrt(((v[near] - q[i]) ** 2).sum(1))
                order = np.lexsort((ids[near], d))
                near, d = near[order], d[order]
                first = np.sort(np.unique(ids[near], return_index=True)[1])[:k]
                return near[first], d[first]

            lot = max(1, min(128, SLAB // len(ids)))
            for a in range(0, len(q), lot):
                t = table[a : a + lot]
                dot = np.zeros((len(t), len(ids)), dtype=np.float32)
                for j in range(codes.shape[1]):
                    dot += t[:, j, :][:, codes[:, j]]
                best = []
                for i, s in enumerate(dot + base):
                    near = np.arange(len(ids)) if len(ids) <= depth else np.flatnonzero(s >= np.partition(s, len(s) - depth)[len(s) - depth])
                    best.append(nearest(near, a + i))
                if len(ids) > depth:
                    limit = np.array([d[-1] if len(d) == k else np.inf for _, d in best])[:, None]
                    q2 = (q[a : a + lot] ** 2).sum(1)[:, None]
                    # Products of the tables are rounded to 32 bits; what is not a number excludes nothing.
                    low = np.sqrt(np.maximum(q2 - 2.0 * dot + n2 - 1e-5 * (q2 + n2), 0)) - off
                    left = np.flatnonzero(~(low > limit).all(0))
                    exact = q2 - 2.0 * (q[a : a + lot] @ v[left].T) + v2[left]
                    open_ = ~(exact > limit**2 + 1e-9 * (q2 + v2[left]))
                    best = [nearest(left[o], a + i) for i, o in enumerate(open_)]
                for i, (near, d) in enumerate(best):
                    out[0].append(np.full(len(near), q_ids[a + i]))
                    out[1].append(ids[near])
                    out[2].append(d)
        cat = [np.concatenate(o) if o else np.zeros(0, dt) for o, dt in zip(out, (np.int64, np.int64, np.float64))]
        return pa.Table.from_arrays([pa.array(c) for c in cat], names=["query_id", "vec_id", "score"])

    found = row_side.groupBy("rb", "qb").cogroup(query_side.groupBy("rb", "qb")).applyInArrow(scan, schema)
    # An id may stand for several vectors: the nearest of them counts.
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
