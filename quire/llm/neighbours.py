"""Nearest neighbours: exact by screened products, and by collision-counting hashing for long vectors.

Counting costs about as much as a product of 44 times the 64 components of the test table
(146 and 3.3 ns a pair there), so vectors of up to 4 m components are screened: one single-
precision matrix product of each block, and the original vectors for all pairs that reach
the sample's bound less the most that rounding could change.  Nothing is lost by that.

Longer ones: vectors are projected on random directions; each block of vectors keeps one sorted array
per direction, cut at quantiles, with the set of vectors below each cut as a bitmap.  A
query opens a window around its own projection in every array: two cuts, outward, hence
the difference of two bitmaps.  Collisions are counted in all arrays at once by adding
the windows' bitmaps bit by bit, and vectors that exceed the collision threshold are
verified against the original vectors.

Virtual rehashing: a window has the half-width of the radius that is looked at, and
radii grow step by step.  The threshold is what a vector at that radius reaches with a
chance of `1 - miss`, nearer ones with a higher one; a query ends at a radius within
which k vectors have been verified; once k are found, the next radius is that of the k-th.
None is larger than that of the k-th best in a fixed sample of `sample` vectors (those
with the least hash of their id), which no k-th best of all can lie beyond, so recall doesn't rest on how many vectors were looked at: no bound
is set on candidates.  With fewer than k others in the sample every vector is verified.

Nearness is the inner product, found as least distance: candidates are lifted by one
component onto a sphere, which doesn't change the order.  Blocks hold vectors of like
norm (within a factor of root 2), each with a sphere of its own; a block whose norms
cannot reach the k-th best is passed over.

The stated query set meets all rows in blocks of bounded size on both sides; each block
returns its best k a query, and these are merged.  Every row is indexed.  Scores are
summed in one fixed order, so equal vectors have equal scores.

Vectors that are null, all zero, of another length than most, or hold null or non-finite
components take no part.  A product that overflows to NaN counts as minus infinity.
Repeated ids are rows of their own, never their own neighbours.  An empty table or no
query gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import bound_batches, durable, lean, one_blas_thread, parallelism

#: Squared radii as shares of the last one, while fewer than k vectors are found.
RADII = (0.3, 0.6, 0.8, 0.9, 1.0)
FOUND = "query_id long, vec_id long, score double"


def directions(m: int, dim: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(m, dim))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows; the order of summation depends on their length alone, so equal rows have equal ones."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (a * b).sum(axis=1)
    return np.where(np.isnan(out), -np.inf, out)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the binary logarithms of the norms: sound whatever their size."""
    most = np.abs(x).max(axis=1, keepdims=True)
    x = x / most
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / norm[:, None], np.log2(most[:, 0]) + np.log2(norm)


def top(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each owner, best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores, owner))
    own = owner[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    return order[rank < k]


class Counters:
    """Sums of bitmaps, kept as one plane for each binary digit."""

    def __init__(self, shape: tuple[int, int], most: int):
        self.planes = [np.zeros(shape, np.uint64) for _ in range(most.bit_length())]
        self.waiting: list[np.ndarray | None] = [None] * (most.bit_length() + 1)

    def add(self, x: np.ndarray, digit: int = 0) -> None:
        """Two bitmaps of a digit are added at once, with one carry."""
        while (other := self.waiting[digit]) is not None:
            self.waiting[digit] = None
            plane = self.planes[digit]
            odd = other ^ x
            carry = (other & x) | (odd & plane)
            plane ^= odd
            x, digit = carry, digit + 1
            if digit == len(self.planes):
                return
        self.waiting[digit] = x

    def reached(self, least: int) -> np.ndarray:
        """Bitmap of the sums of at least `least`."""
        for digit, x in enumerate(self.waiting):
            while x is not None and digit < len(self.planes):
                carry = self.planes[digit] & x
                self.planes[digit] ^= x
                x, digit = (carry, digit + 1) if carry.any() else (None, digit)
        self.waiting = [None] * len(self.waiting)
        equal, more = ~np.zeros_like(self.planes[0]), np.zeros_like(self.planes[0])
        for digit in range(len(self.planes) - 1, -1, -1):
            if least >> digit & 1:
                equal &= self.planes[digit]
            else:
                more |= equal & self.planes[digit]
                equal &= ~self.planes[digit]
        return more | equal


class Block:
    """The index of a block: sorted projections, cut at quantiles, with a bitmap for each cut."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, m: int, cuts: int = 64):
        self.vectors, self.ids, self.m = vectors, ids, m
        whole, size = unit(vectors)
        self.largest = float(size.max())
        norm = np.exp2(size - self.largest)
        axes = directions(m, vectors.shape[1] + 1)
        self.axes = axes[:, :-1]
        values = (self.axes @ whole.T) * norm + axes[:, -1:] * np.sqrt(np.maximum(1 - norm**2, 0))
        n = len(vectors)
        at = np.unique(np.arange(1, cuts) * n // cuts)
        self.cuts = np.sort(values, axis=1)[:, at] if n > 1 else np.zeros((m, 0))
        words = -(-n // 64)
        self.below = np.zeros((m, self.cuts.shape[1] + 2, words * 8), np.uint8)
        for i in range(m):
            low = values[i] < self.cuts[i][:, None]
            self.below[i, 1:-1, : -(-n // 8)] = np.packbits(low, axis=1, bitorder="little")
        self.below[:, -1, : -(-n // 8)] = np.packbits(np.ones(n, bool), bitorder="little")
        self.below = self.below.view(np.uint64)

    def colliding(self, at: np.ndarray, width: np.ndarray, least: int) -> np.ndarray:
        """For each query the bitmap of vectors with at least `least` collisions; at: projections of the queries."""
        count = Counters((at.shape[1], self.below.shape[2]), self.m)
        for i in range(self.m):
            low = np.searchsorted(self.cuts[i], at[i] - width, side="right")
            high = np.searchsorted(self.cuts[i], at[i] + width, side="right") + 1
            count.add(self.below[i, high] ^ self.below[i, low])
        return count.reached(least)

    def search(self, queries: np.ndarray, ids: np.ndarray, reach: np.ndarray, k: int, miss: float = 0.15, batch: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, score) of the best k found; reach: a score that the k-th best of all has at least."""
        parts = [self._search(queries[i : i + batch], ids[i : i + batch], reach[i : i + batch], k, miss) for i in range(0, len(queries), batch)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _bounds(self, queries: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit queries; what a score is divided by to be one of vectors of norm 1 at most; reach so divided."""
        whole, size = unit(queries)
        with np.errstate(divide="ignore", over="ignore"):
            scale = np.exp2(np.clip(size + self.largest, -1070, 1023))
            return whole, scale, np.where(np.isfinite(reach), reach / scale, -np.inf)  # as the cosine on the sphere

    def _search(self, queries, ids, reach, k, miss):
        whole, scale, least = self._bounds(queries, reach)
        p = 2 * NormalDist().cdf(1.0) - 1
        enough = int(np.floor(self.m * p - NormalDist().inv_cdf(1 - miss) * np.sqrt(self.m * p * (1 - p))))
        at = self.axes @ whole.T
        none = np.zeros(0, np.int64)
        owner, vector, score = none, none, np.zeros(0)
        held = (none, none, np.zeros(0))
        open_ = np.flatnonzero(least <= 1 + 1e-9)  # others can't reach their k-th best here
        lost = open_[~np.isfinite(least[open_])]
        open_ = open_[np.isfinite(least[open_])]
        if len(lost):
            owner, vector = np.repeat(lost, len(self.ids)), np.tile(np.arange(len(self.ids)), len(lost))
            score = self._scores(queries, owner, vector)
        last = np.maximum(2 - 2 * least, 1e-9)
        seen = np.zeros((len(ids), self.below.shape[2]), np.uint64)
        wide = last * RADII[0]  # squared radii
        for step in range(len(RADII) + 1):
            if not len(open_):
                break
            hits = self.colliding(at[:, open_], np.sqrt(wide[open_]), enough)
            q, v = np.nonzero(np.unpackbits((hits & ~seen[open_]).view(np.uint8), axis=1, bitorder="little", count=len(self.ids)))
            seen[open_] |= hits
            q = open_[q]
            s = self._scores(queries, q, v)
            keep = self.ids[v] != ids[q]
            q, v, s = np.concatenate([held[0], q[keep]]), np.concatenate([held[1], v[keep]]), np.concatenate([held[2], s[keep]])
            best = top(q, self.ids[v], s, k)
            q, v, s = q[best], v[best], s[best]
            full = np.bincount(q, minlength=len(ids)) >= k
            kth = np.full(len(ids), -np.inf)
            kth[q] = s  # the last of each query is its k-th
            with np.errstate(invalid="ignore"):
                reached = np.where(full[open_], 2 - 2 * kth[open_] / scale[open_], np.inf)
            done = (reached <= wide[open_]) | (wide[open_] >= last[open_])
            # the k-th best lies no farther than the k-th found: that radius, if known, is the last
            following = last[open_] * RADII[min(step + 1, len(RADII) - 1)]
            wide[open_] = np.minimum(np.where(np.isfinite(reached), reached * (1 + 1e-9), following), last[open_])
            mine = done[np.searchsorted(open_, q)]
            owner, vector, score = np.concatenate([owner, q[mine]]), np.concatenate([vector, v[mine]]), np.concatenate([score, s[mine]])
            held = (q[~mine], v[~mine], s[~mine])
            open_ = open_[~done]
        keep = self.ids[vector] != ids[owner]
        owner, vector, score = owner[keep], vector[keep], score[keep]
        best = top(owner, self.ids[vector], score, k)
        return ids[owner[best]], self.ids[vector[best]], score[best]

    def _scores(self, queries: np.ndarray, q: np.ndarray, v: np.ndarray, chunk: int = 1024) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(products(self.vectors[v[i : i + chunk]], queries[q[i : i + chunk]]) for i in range(0, len(q), chunk))])


class Screened(Block):
    """A block without an index: all products in single precision, those that may reach the bound again in double."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        whole, size = unit(vectors)
        self.largest = float(size.max())
        self.scaled = (whole * np.exp2(size - self.largest)[:, None]).astype(np.float32)

    def _search(self, queries, ids, reach, k, miss):
        whole, _, least = self._bounds(queries, reach)
        slack = (whole.shape[1] + 8) * 2.0**-23  # twice what rounding of components, products and sums can change
        with np.errstate(over="ignore"):
            least = np.nextafter((least - slack).astype(np.float32), np.float32(-np.inf))
        q, v = np.nonzero(whole.astype(np.float32) @ self.scaled.T >= least[:, None])
        keep = self.ids[v] != ids[q]
        q, v = q[keep], v[keep]
        score = self._scores(queries, q, v)
        best = top(q, self.ids[v], score, k)
        return ids[q[best]], self.ids[v[best]], score[best]


SOUND = "vec_id long, v array<double>, shell int"


def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors that take part, each with its shell: norms within a factor of root 2."""
    for part in batches:
        lists = part.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        most = np.maximum.reduceat(np.abs(flat), start) if len(start) else np.zeros(0)
        keep = np.isfinite(most) & (most > 0)  # NaN and infinity pass into the maximum
        scaled = flat / np.repeat(np.where(keep, most, 1), size)
        with np.errstate(invalid="ignore"):
            norm = np.log2(np.where(keep, most, 1)) + 0.5 * np.log2(np.where(keep, np.add.reduceat(scaled * scaled, start), 1)) if len(start) else most
        chosen = pa.array(keep)
        shell = pa.array(np.floor(2 * norm[keep]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([part.column(0).filter(chosen), lists.filter(chosen), shell], names=["vec_id", "v", "shell"])


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(vectors: DataFrame, queries_where: str = "vec_id % 20 = 0", vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, m: int = 512, miss: float = 0.15, block: int = 16_384, sample: int = 2_048) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, ties to the smaller id.

    `block`: most vectors of a block (four times as many queries); `sample`: vectors that bound the k-th best.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    rows = given.mapInArrow(lean(sound), SOUND).withColumn("asked", F.expr(queries_where))
    # One row a shell and length: doubles have some 4,200 shells.
    about = rows.groupBy(F.size("v").alias("dim"), "shell").agg(F.count("*").alias("n"), F.count(F.when(F.col("asked"), 1)).alias("queries"))
    sizes = about.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("queries").alias("queries"), F.map_from_entries(F.collect_list(F.struct("shell", "n"))).alias("shells")).orderBy(F.desc("n"), "dim").first()
    dim, n, asked = (sizes["dim"], sizes["n"], sizes["queries"]) if sizes else (1, 0, 0)
    screened = dim <= 4 * m
    # Blocks of no more than `block` vectors (four times as many without an index); smaller ones while there are fewer than tasks.
    size = max(1, min(4 * block if screened else block, max(block // 2, -(-n // parallelism(spark)))))
    across = {s: -(-c // size) for s, c in (sizes["shells"] if sizes else {}).items()}
    base, total = {}, 0
    for s in sorted(across):
        base[s], total = total, total + across[s]
    down = max(1, -(-asked // (4 * block)))
    rows = rows.where(F.size("v") == dim)
    table = F.create_map(*[F.lit(x) for s in sorted(across) for x in (s, (base[s] << 32) + across[s])]) if across else F.create_map(F.lit(0), F.lit(1 << 0))
    spot = table[F.col("shell")]
    mine = F.shiftright(spot, 32) + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.expr("1L") * spot.bitwiseAND(F.lit(0xFFFFFFFF)))
    grid = lambda c: F.sequence(F.lit(0), F.lit(max(1, c) - 1))
    left = rows.select("vec_id", "v", mine.cast("int").alias("a"), F.explode(grid(down)).alias("b"))

    few = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toArrow()
    sampled = spark.sparkContext.broadcast((few.column("vec_id").to_numpy(), _matrix(few.column("v"), dim)))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        ids, known = sampled.value
        for part in batches:
            own, x = part.column(0).to_numpy(), _matrix(part.column(1), dim)
            reach = np.full(len(own), -np.inf)
            for i in range(0, len(own), 256):
                with np.errstate(over="ignore", invalid="ignore"):
                    s = x[i : i + 256] @ known.T
                s[np.isnan(s) | (own[i : i + 256, None] == ids)] = -np.inf
                if len(ids) > k:
                    # less the most that another order of summation could change
                    kth = np.partition(s, -k, axis=1)[:, -k]
                    reach[i : i + 256] = kth - 1e-9 * np.abs(kth)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(reach)], names=["vec_id", "v", "reach"])

    queries = rows.where("asked").select("vec_id", "v").mapInArrow(lean(reached), "vec_id long, v array<double>, reach double")
    right = queries.select("vec_id", "v", "reach", F.explode(grid(total)).alias("a"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(down)).cast("int").alias("b"))

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if own.num_rows and asked.num_rows:
            one_blas_thread()
            given = _matrix(own.column("v"), dim), own.column("vec_id").to_numpy()
            index = Screened(*given) if screened else Block(*given, m)
            found = index.search(_matrix(asked.column("v"), dim), asked.column("vec_id").to_numpy(), asked.column("reach").to_numpy(), k, miss)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    found = durable(left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet, FOUND))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
