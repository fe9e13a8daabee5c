"""Exact set-similarity self-join: Jaccard of at least num/den over sets of 64-bit tokens.

Used for documents (word shingles) and for lines.  Four steps:

1. `profile`: a set with a partner shares at least o = ceil(t * n) of its n tokens with
   it, so at most n - o of its tokens occur nowhere else.  Half of all tokens (by a bit
   of the hash) are counted over the whole corpus, and sets with too few repeated ones
   are settled there and then.  Counting moves packed arrays, 6 bytes a token, and each
   chunk of rows counts its own repetitions first, so a token that a third of all rows
   hold reaches its reducer once per chunk.
2. Equal sets form classes; one set of each class goes on, and is counted once more,
   without copies.
3. `ordered`: tokens of the remaining sets are ordered rare first; tokens of one set
   alone only count as positions.  `candidates` joins the prefixes, with the index
   prefix on the shorter side, length and positional filters; a token of many sets is
   split over salts.  Each pair counts once.
4. `verified`: pairs are grouped in blocks of bounded size around a shared token, so
   each set travels once a block rather than once a pair; the suffix filter compares
   histograms of tokens before the overlap is counted exactly.

For sets of common tokens, such as the words of lines, `signed`, `common_pairs` and
`common_links` do the same with packed prefixes instead of steps 1 and 3; `matched` finds
the sets that match an earlier one without all pairs of large groups.

Tokens are 64-bit hashes, which collide with a chance of 5e-20 a pair.  Sets are told
apart by two signatures and their size; between classes that may have partners, links
are kept by the first signature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bound_batches, discard, durable, lean, parallelism, release_shuffles, sized
from quire.llm.text import buffers, distinct_per_row, mix, ranges, row_order, slices

#: Items of a chunk; their numbers take 16 bits, the last one marks tokens repeated in the chunk.
ITEMS, REPEATED = 60_000, 65_535
CHUNK_BYTES = 4 << 20

#: (bytes, offsets, wanted items of each row or None) -> (token, item), (row, number in the row) of each item.
#: Items ascend; every row's items come together.
Extract = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def needed(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least number of tokens a set of n shares with any partner: ceil(n * num / den)."""
    return -(-n * num // den)


def sets_of(part: pa.RecordBatch, column: str, extract: Extract):
    """Distinct (token, item) by item, item rows and numbers, sizes, and two signatures of each item.

    An extract with the attribute `distinct` gives each token of an item once by itself."""
    tokens, items, row, number = extract(*buffers(part.column(column)))
    if "wanted" in part.schema.names:  # the item numbers that are wanted of each row
        lists = part.column("wanted")
        asked = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.repeat(np.arange(part.num_rows), asked) << 32 | lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        keep = np.isin(row.astype(np.int64) << 32 | number, pairs)
        of = keep[items]
        tokens, items = tokens[of], (np.cumsum(keep) - 1)[items[of]]
        row, number = row[keep], number[keep]
    if not getattr(extract, "distinct", False):
        tokens, items = distinct_per_row(tokens, items)
    size = np.bincount(items, minlength=len(row)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])

    def signature(salt: int) -> np.ndarray:
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ np.uint64(salt)))])
        return mix((total[first[1:]] - total[first[:-1]]) + size.astype(np.uint64))

    return tokens, items, row, number, size, signature(0x51ED270B9C1F7A35), signature(0x2545F4914F6CDD1D)


_COUNTED = "bucket int, chunk long, head boolean, ids binary, numbers binary, sizes binary, sampled binary, s1 binary, s2 binary, tokens binary, owners binary"
PROFILE = "id long, number int, n long, s1 long, s2 long, alive boolean"


def estimated_buckets(df: DataFrame, parts: int) -> int:
    """Buckets that the token count is split over: by the input's estimated size, one for 8 MB."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(parts, size // (8 << 20)), 1 << 22)) if size < 1 << 60 else parts


def profile(items: DataFrame, extract: Extract, num: int, den: int, buckets: int | None = None) -> DataFrame:
    """One row per item of `items` (id long, text string): its size, signatures and whether it may have a partner."""
    buckets = buckets or estimated_buckets(items, parallelism(items.sparkSession))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 24
        held: list[tuple] = []
        n_items = n_bytes = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held, n_items, n_bytes
            base = np.cumsum([0, *(len(h[2]) for h in held)])
            keep = [(h[0] >> np.uint64(63)) == 0 for h in held]
            tokens = np.concatenate([h[0][k] for h, k in zip(held, keep)])
            owner = np.concatenate([h[1][k] + b for h, k, b in zip(held, keep, base)])
            ids, numbers, sizes, s1, s2 = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4, 5, 6))
            held, n_items, n_bytes = [], 0, 0
            sampled = np.bincount(owner, minlength=len(ids))
            bucket = ((tokens >> np.uint64(32)) & np.uint64(0x7FFFFFFF)) % np.uint64(buckets)
            key = (bucket << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))
            order = np.argsort(key)
            key, owner = key[order], owner[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            run = np.cumsum(fresh) - 1
            times = np.bincount(run)
            many = times[run] > 1 if len(run) else np.zeros(0, bool)
            local = np.bincount(owner[many], minlength=len(ids))
            owner = np.where(many, REPEATED, owner)[fresh].astype(np.uint16)
            key = key[fresh]
            which = (key >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(which, prepend=-1))
            low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            ends = np.append(cut[1:], len(key))
            pieces = len(cut)
            none = [None] * pieces
            as_bytes = lambda x: x.tobytes()
            # sampled tokens that need a partner, less those repeated within the chunk
            need = sampled - (sizes - needed(sizes, num, den)) - local
            columns = [
                [-1 - (chunk % buckets), *which[cut].tolist()], [chunk] * (pieces + 1), [True] + [False] * pieces,
                [as_bytes(ids), *none], [as_bytes(numbers.astype(np.int32)), *none], [as_bytes(sizes), *none], [as_bytes(need.astype(np.int64)), *none],
                [as_bytes(s1), *none], [as_bytes(s2), *none],
                [None, *(as_bytes(low[a:b]) for a, b in zip(cut, ends))], [None, *(as_bytes(owner[a:b]) for a, b in zip(cut, ends))],
            ]
            kinds = [pa.int32(), pa.int64(), pa.bool_()] + [pa.binary()] * 8
            chunk += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _COUNTED.split(", ")])

        for part in slices(batches, "text", 1 << 18):
            tokens, owner, row, number, size, s1, s2 = sets_of(part, "text", extract)
            ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)[row]
            done = 0
            while done < len(ids):
                stop = min(len(ids), done + ITEMS - n_items)
                a, b = np.searchsorted(owner, [done, stop])
                held.append((tokens[a:b], owner[a:b] - done, ids[done:stop], number[done:stop], size[done:stop], s1[done:stop], s2[done:stop]))
                n_items += stop - done
                done = stop
                if n_items >= ITEMS:
                    yield from flush()
            n_bytes += part.get_total_buffer_size() if part.num_rows == 1 else int(buffers(part.column("text"))[1][-1])
            if held and n_bytes >= CHUNK_BYTES:
                yield from flush()
        if held:
            yield from flush()

    head_names = ["chunk", "head", "ids", "numbers", "sizes", "sampled", "s1", "s2", "owners"]
    met_schema = "chunk long, head boolean, ids binary, numbers binary, sizes binary, sampled binary, s1 binary, s2 binary, owners binary"

    def meet(group: pa.Table) -> pa.Table:
        if group.column("head")[0].as_py():
            return group.select(head_names)
        tokens = [np.frombuffer(t.as_buffer(), np.uint32) for t in group.column("tokens")]
        owners = [np.frombuffer(t.as_buffer(), np.uint16) for t in group.column("owners")]
        length = np.array([len(t) for t in tokens])
        tokens, owner = np.concatenate(tokens), np.concatenate(owners)
        source = np.repeat(np.arange(len(length)), length)
        order = np.argsort(tokens)
        run = np.cumsum(np.diff(tokens[order], prepend=tokens[order[0]] ^ np.uint32(1)) != 0) - 1
        times = np.bincount(run)
        marked = np.bincount(run, owner[order] == REPEATED)
        shared = np.zeros(len(tokens), bool)
        shared[order] = ((times > 1) | (marked > 0))[run]
        shared &= owner != REPEATED
        # which items of which chunk: one blob a chunk
        at, own = source[shared], owner[shared]
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(length)))])
        some = np.flatnonzero(np.diff(ends))
        chunk = group.column("chunk").to_numpy()
        n = len(some)
        blobs = [own[ends[i] : ends[i + 1]].tobytes() for i in some]
        return pa.table({"chunk": pa.array(chunk[some], pa.int64()), "head": pa.array([False] * n, pa.bool_()), **{c: pa.nulls(n, pa.binary()) for c in head_names[2:8]}, "owners": pa.array(blobs, pa.binary())})

    def settle(group: pa.Table) -> pa.Table:
        heads = group.filter(group.column("head")).to_pylist()[0]
        ids, numbers, sizes, need, s1, s2 = (np.frombuffer(heads[k], t) for k, t in (("ids", np.int64), ("numbers", np.int32), ("sizes", np.int64), ("sampled", np.int64), ("s1", np.int64), ("s2", np.int64)))
        shared = np.zeros(len(ids), np.int64)
        for blob in group.column("owners"):
            if blob.is_valid:
                shared += np.bincount(np.frombuffer(blob.as_buffer(), np.uint16), minlength=len(ids))
        return pa.table({"id": ids, "number": numbers, "n": sizes, "s1": s1, "s2": s2, "alive": (shared >= need) & (sizes > 0)})

    bound_batches(items.sparkSession)
    counted = items.mapInArrow(lean(count), _COUNTED)
    met = counted.groupBy("bucket").applyInArrow(meet, met_schema)
    return met.groupBy("chunk").applyInArrow(settle, PROFILE)


def classes_of(items: DataFrame) -> DataFrame:
    """One row per class of equal sets: e (its key), s2, n, first (id, tie if there is one, number), copies."""
    place = [c for c in ("id", "tie", "number") if c in items.columns]
    return items.groupBy("s1", "s2", "n").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("copies")).select(F.col("s1").alias("e"), "s2", "n", "first", "copies")


def first_items(items: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of `items` that hold the first item of a class, with the item numbers `wanted` of them."""
    keys = [c for c in ("id", "tie") if c in items.columns]
    wanted = classes.groupBy(*[F.col(f"first.{c}").alias(f"_{c}") for c in keys]).agg(F.collect_list(F.col("first.number")).alias("wanted"))
    wanted = durable(wanted)
    size = wanted.agg(F.count("*"), F.sum(F.size("wanted"))).first()
    on = [F.col(c) == F.col(f"_{c}") for c in keys]
    return items.join(sized(wanted, *size), on).select(*items.columns, "wanted")


def sets_again(items: DataFrame, classes: DataFrame, extract: Extract) -> DataFrame:
    """(e, n, tokens) of each class, read again from its first item alone (twice, if that row is repeated)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 18):
            tokens, _, _, _, size, s1, _ = sets_of(part, "text", extract)
            some = size > 0
            ends = np.concatenate([[0], np.cumsum(size[some])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(s1[some].view(np.int64)), pa.array(size[some]), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.view(np.int64)))], names=["e", "n", "tokens"])

    return first_items(items, classes).mapInArrow(lean(run), "e long, n long, tokens array<long>")


#: Rows of one key that a task should meet at most.
HOT = 50_000


def hot_keys(rows: DataFrame, key: str, by: str, part: int = 64) -> DataFrame:
    """(key, salts) of keys with about HOT rows or more, counted in a part of the rows.

    It only decides how rows are spread: results are the same whatever it finds.
    """
    seen = rows.where(F.pmod(F.xxhash64(by), F.lit(part)) == 0).groupBy(key).agg(F.count("*").alias("n")).where(f"n * {part} >= {HOT}")
    return durable(seen.select(key, F.ceil(F.col("n") * part / HOT).cast("int").alias("salts")))


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """rows joined with the one row a key of `table`; rows of a hot key are spread by the hash of `by`."""
    if hot.isEmpty():
        return rows.join(table, key)
    hot = sized(hot)
    salt = F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")).cast("int"), F.lit(0))
    left = rows.join(hot, key, "left").withColumn("salt", salt).drop("salts")
    right = table.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [key, "salt"]).drop("salt")


def ordered(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(e, n, lone, tokens): tokens of several sets, rare first, after `lone` tokens of this set alone.

    Sets whose prefix holds lone tokens only are left out: they have no partner.
    """
    rows = sets.select("e", "n", F.explode("tokens").alias("token"))
    often = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    joined = spread_join(rows, often, "token", "e", hot_keys(rows, "token", "e"))
    kept = joined.groupBy("e", "n").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("tokens"))
    return kept.withColumn("lone", F.col("n") - F.size("tokens")).where(f"lone < n - ceil(n * {num} / {den}) + 1")


def candidates(sets: DataFrame, num: int, den: int, split: int = 512) -> DataFrame:
    """(x, y, token, df): pairs that share a prefix token, each once, with the commonest such token."""
    prefix = f"CAST(n - ((n * {num} + {den} - 1) DIV {den}) + 1 AS INT)"
    index = f"CAST(n - ((2 * n * {num} + {num + den} - 1) DIV {num + den}) + 1 AS INT)"
    rows = sets.selectExpr("e", "n", "lone", f"{index} AS short", f"posexplode(slice(tokens, 1, CAST({prefix} - lone AS INT))) AS (at, t)").selectExpr("e", "n", "lone + at AS place", "short", "t.df AS df", "t.token AS token")
    return met(rows, num, den, split)


def met(rows: DataFrame, num: int, den: int, split: int = 512) -> DataFrame:
    """(x, y, token, df) of prefix rows (e, n, place, short, df, token)."""
    salts = F.ceil(F.col("df") / split).cast("int")
    x = rows.select(F.col("token"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("e").alias("x"), F.col("n").alias("xn"), F.col("place").alias("xp"))
    y = rows.where("place < short").select("token", F.pmod("e", salts).cast("int").alias("salt"), F.col("e").alias("y"), F.col("n").alias("yn"), F.col("place").alias("yp"), "df")
    fit = f"(yn < xn OR (yn = xn AND y < x)) AND yn * {den} >= xn * {num} AND least(xn - xp, yn - yp) * {num + den} >= (xn + yn) * {num}"
    return one_each(x.join(y, ["token", "salt"]).where(fit))


def one_each(pairs: DataFrame) -> DataFrame:
    """Each pair (x, y) once, with the commonest token that it met at."""
    return pairs.groupBy("x", "y").agg(F.max(F.struct("df", "token")).alias("g")).select("x", "y", "g.df", "g.token")


def _verify(members: list[tuple[int, int, np.ndarray]], pairs: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the (x, y) pairs reach the threshold; members: (e, n, tokens)."""
    place = {e: i for i, (e, _, _) in enumerate(members)}
    n = np.array([m[1] for m in members])
    size = np.array([len(m[2]) for m in members])
    i = np.fromiter((place[e] for e in pairs[:, 0]), np.int64, len(pairs))
    j = np.fromiter((place[e] for e in pairs[:, 1]), np.int64, len(pairs))
    need = -(-(n[i] + n[j]) * num // (num + den))
    tokens = np.concatenate([m[2] for m in members])
    owner = np.repeat(np.arange(len(members)), size)
    # suffix filter: tokens in corresponding intervals differ by no more than the allowed distance
    parts = np.zeros((len(members), 8), np.int64)
    np.add.at(parts, (owner, (tokens.view(np.uint64) >> np.uint64(61)).astype(np.int64)), 1)
    most = np.minimum(parts[i], parts[j]).sum(1)
    ok = most >= need
    both = np.zeros(len(pairs), np.int64)
    if ok.any():
        distinct, inverse = np.unique(tokens, return_inverse=True)
        if len(members) * len(distinct) <= 20_000_000:
            grid = np.zeros((len(members), len(distinct)), np.float32)
            grid[owner, inverse] = 1
            both = (grid @ grid.T)[i, j].astype(np.int64)
        else:
            own = [np.sort(m[2]) for m in members]
            for k in np.flatnonzero(ok).tolist():
                both[k] = len(np.intersect1d(own[i[k]], own[j[k]], assume_unique=True))
    return both >= need


Member = tuple[int, int, np.ndarray]


def _verify_together(blocks: list[tuple[list[Member], np.ndarray]], num: int, den: int) -> np.ndarray:
    """The pairs of several blocks that reach the threshold: tokens of one side are looked up among those of the other."""
    i, j, sets, pairs = [], [], [], []
    for members, p in blocks:
        place = {m[0]: len(sets) + k for k, m in enumerate(members)}
        i += [place[e] for e in p[:, 0].tolist()]
        j += [place[e] for e in p[:, 1].tolist()]
        sets += members
        pairs.append(p)
    i, j, p = np.array(i), np.array(j), np.concatenate(pairs)
    n, size = np.array([m[1] for m in sets]), np.array([len(m[2]) for m in sets])
    tokens = np.concatenate([m[2] for m in sets]).view(np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    need = -(-(n[i] + n[j]) * num // (num + den))
    # suffix filter: tokens in corresponding intervals differ by no more than the allowed distance
    parts = np.bincount(owner * 8 + (tokens >> np.uint64(61)).astype(np.int64), minlength=8 * len(sets)).reshape(-1, 8)
    ok = np.flatnonzero(np.minimum(parts[i], parts[j]).sum(axis=1) >= need)
    order = row_order(tokens, owner)
    tokens, first = tokens[order], np.cumsum(size) - size
    key = (owner.astype(np.uint64) << np.uint64(44)) | (tokens >> np.uint64(20))
    both = np.zeros(len(p), np.int64)
    step = max(1, (1 << 22) // max(1, int(size.max())))
    for a in range(0, len(ok), step):
        own = ok[a : a + step]
        k = np.repeat(first[i[own]], size[i[own]]) + ranges(size[i[own]])
        of = np.repeat(np.arange(len(own)), size[i[own]])
        sought = (np.repeat(j[own], size[i[own]]).astype(np.uint64) << np.uint64(44)) | (tokens[k] >> np.uint64(20))
        at = np.minimum(np.searchsorted(key, sought), len(key) - 1)
        both[own] = np.bincount(of[(key[at] == sought) & (tokens[at] == tokens[k])], minlength=len(own))
    return p[both >= need]


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, block: int = 128) -> DataFrame:
    """The (x, y) whose Jaccard reaches num/den; each pair is verified once, in one block."""
    placed = in_blocks(pairs, block)
    shipped = members_of(placed).join(sets.select("e", "n", F.transform("tokens", lambda t: t["token"]).alias("tokens")), "e")
    return verified_blocks(placed, shipped, num, den)


def in_blocks(pairs: DataFrame, block: int) -> DataFrame:
    """(x, y, block): pairs that met at one token share blocks; a token of many sets has several."""
    side = F.greatest(F.lit(1), F.ceil(F.col("df") / block)).cast("long")
    return durable(pairs.select("x", "y", F.xxhash64("token", F.pmod("x", side), F.pmod("y", side)).alias("block")))


def members_of(placed: DataFrame) -> DataFrame:
    return placed.select("block", F.col("x").alias("e")).union(placed.select("block", F.col("y").alias("e"))).distinct()


def verified_blocks(placed: DataFrame, shipped: DataFrame, num: int, den: int, extract: Extract | None = None, spread: int = 4) -> DataFrame:
    """The placed pairs that reach the threshold, verified where the members of their block come together.

    shipped: block, e, n and tokens, or line (binary) that `extract` gives the tokens of.
    """
    last = shipped.columns[-1]
    kind = shipped.schema[last].dataType.simpleString()
    both = shipped.select("block", F.lit(0).alias("kind"), "e", "n", last).union(placed.select("block", F.lit(1), "x", "y", F.lit(None).cast(kind)))
    stream = both.repartition(spread * parallelism(placed.sparkSession), "block").sortWithinPartitions("block", "kind", "e", "n")

    def sets_in(lists: pa.Array, e: np.ndarray, n: np.ndarray) -> list[Member]:
        if extract is None:
            flat, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
            return [(int(a), int(b), flat[offs[k] : offs[k + 1]].copy()) for k, (a, b) in enumerate(zip(e, n))]
        tokens, owner, *_ = sets_of(pa.RecordBatch.from_arrays([lists.cast(pa.large_string())], names=["line"]), "line", extract)
        ends = np.searchsorted(owner, np.arange(len(e) + 1))
        return [(int(a), int(b), tokens[ends[k] : ends[k + 1]].view(np.int64)) for k, (a, b) in enumerate(zip(e, n))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[Member] = []  # of the block that isn't complete yet
        asked: list[np.ndarray] = []
        now = None
        sparse: list[tuple[list[Member], np.ndarray]] = []  # blocks of few pairs wait for one another
        waiting = 0

        def found(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "y"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sparse, waiting
            held, sparse, waiting = sparse, [], 0
            if held:
                yield from found(_verify_together(held, num, den))

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal members, asked, waiting
            own, p = members, np.concatenate(asked) if asked else np.zeros((0, 2), np.int64)
            members, asked = [], []
            if len(p) > 2 * len(own):
                yield from found(p[_verify(own, p, num, den)])
            elif len(p):
                sparse.append((own, p))
                waiting += sum(len(m[2]) for m in own)
                if waiting > 1 << 19:
                    yield from flush()

        for batch in batches:
            blocks, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            e, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            given = np.flatnonzero(kind == 0)
            sets = sets_in(batch.column(4).filter(pa.array(kind == 0)), e[given], n[given])
            upto = np.concatenate([[0], np.cumsum(kind == 0)])
            cut = np.flatnonzero(np.diff(blocks)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(blocks)]):
                if a == b:
                    continue
                if now is not None and blocks[a] != now:
                    yield from close()
                now = blocks[a]
                members += sets[upto[a] : upto[b]]
                m = a + int(upto[b] - upto[a])
                asked.append(np.column_stack([e[m:b], n[m:b]]))
        yield from close()
        yield from flush()

    return stream.mapInArrow(lean(run), "x long, y long")


def links(items: DataFrame, classes: DataFrame, extract: Extract, num: int, den: int) -> DataFrame:
    """(x, y): the linked pairs of different classes, each once."""
    # Copies are gone now, so counting again, over first items alone, settles most classes.
    # (The size of a join is badly estimated, hence the number of buckets of the whole input.)
    buckets = estimated_buckets(items, parallelism(items.sparkSession))
    again = profile(first_items(items, classes), extract, num, den, buckets).where("alive").select(F.col("s1").alias("e")).distinct()
    left = durable(classes.join(again, "e", "left_semi"))
    release_shuffles(items.sparkSession)
    sets = durable(sets_again(items, left, extract))
    rare = durable(ordered(sets, num, den))
    discard(sets)
    release_shuffles(items.sparkSession)
    return durable(verified(candidates(rare, num, den), rare, num, den))


# ---- sets whose tokens are mostly common, such as the words of lines ----------------------

#: Hash buckets of the frequency table, and pieces that it is added up in.
FREQUENCIES, PIECES = 1 << 22, 64
SIGNED = "id long, tie long, number int, n long, s1 long, s2 long, piece int, counts binary"


def signed(items: DataFrame, extract: Extract) -> DataFrame:
    """Size and signatures of every item of `items` (id, tie, text) that isn't empty.

    Rows with `counts` hold pieces of the frequency table instead: how many sets have a
    token of each hash bucket.
    """
    names = [x.split()[0] for x in SIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n_held = np.zeros(FREQUENCIES, np.int64), [], 0
        for part in slices(batches, "text", 1 << 18):
            tokens, _, row, number, size, s1, s2 = sets_of(part, "text", extract)
            held.append((tokens & np.uint64(FREQUENCIES - 1)).astype(np.int64))
            n_held += len(tokens)
            if n_held >= 1 << 21:
                total += np.bincount(np.concatenate(held), minlength=FREQUENCIES)
                held, n_held = [], 0
            some = size > 0
            n = int(some.sum())
            own = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[row][some] for c in ("id", "tie")]
            columns = [*map(pa.array, own), pa.array(number[some].astype(np.int32)), pa.array(size[some]), pa.array(s1[some].view(np.int64)), pa.array(s2[some].view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if held:
            total += np.bincount(np.concatenate(held), minlength=FREQUENCIES)
        if total.any():
            blank = [pa.nulls(PIECES, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            counts = [packed_counts(x) for x in total.reshape(PIECES, -1)]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(range(PIECES), pa.int32()), pa.array(counts, pa.binary())], names=names)

    bound_batches(items.sparkSession)
    return items.mapInArrow(lean(run), SIGNED)


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte a count; those of 255 and more follow as (place, count)."""
    large = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.column_stack([large, counts[large]]).astype(np.int64).tobytes()


def unpacked_counts(data: pa.Buffer, width: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, width).astype(np.int64)
    large = np.frombuffer(data, np.uint8)[width:].tobytes()
    place, count = np.frombuffer(large, np.int64).reshape(-1, 2).T
    out[place] = count
    return out


def frequencies(seen: DataFrame) -> np.ndarray:
    """The frequency table of `signed`: a bucket's count is never less than that of one token."""
    width = FREQUENCIES // PIECES

    def add(group: pa.Table) -> pa.Table:
        total = sum(unpacked_counts(x.as_buffer(), width) for x in group.column("counts"))
        return pa.table({"piece": group.column("piece").slice(0, 1), "counts": pa.array([packed_counts(total)], pa.binary())})

    out = np.zeros((PIECES, width), np.int32)
    for r in seen.where("counts IS NOT NULL").select("piece", "counts").groupBy("piece").applyInArrow(add, "piece int, counts binary").collect():
        out[r["piece"]] = np.minimum(unpacked_counts(pa.py_buffer(r["counts"]), width), 2**31 - 1)
    return out.reshape(-1)


#: Prefixes are this much longer less one, and two sets must share as many of their prefix tokens.
SHARED = 3
#: Sizes from here on are sent as this.
LONG = 65_535


def prefix_tokens(part: pa.RecordBatch, extract: Extract, num: int, den: int, often: np.ndarray):
    """Of each set the tokens of its prefix, rare buckets first: (token, place), of which item; sizes, signatures, parity bits and rows."""
    tokens, owner, row, _, n, s1, _ = sets_of(part, "text", extract)
    df = often[(tokens & np.uint64(FREQUENCIES - 1)).astype(np.int64)]
    rank = np.minimum(63, 2 * np.log2(np.maximum(df, 1))).astype(np.uint64)  # in steps of root 2, then by hash
    order = row_order((rank << np.uint64(58)) | (tokens >> np.uint64(6)), owner)
    some = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[some]
    bits = np.zeros(len(n), np.uint64)
    if len(some):
        bits[some] = np.bitwise_xor.reduceat(np.uint64(1) << (tokens >> np.uint64(58)), starts)
    place = np.arange(len(tokens)) - np.repeat(starts, n[some])
    # a set so small that only its equals can match is left out
    other = (n * den // num > n) | (needed(n, num, den) < n) | (needed(2 * n, num, num + den) < n)
    keep = (place < (n - needed(n, num, den) + SHARED)[owner]) & other[owner] & (df[order] > 1)
    return tokens[order][keep], place[keep], owner[keep], n, s1, bits, row


_MET = "x long, y long, met long, shared int"
_ROW = np.dtype([("e", "<u8"), ("id", "<i8"), ("bits", "<u8"), ("size", "<u2"), ("place", "u1"), ("index", "?")])
_PIECE = "bucket int, keys binary, sizes binary, places binary, bits binary, e binary, ids binary"

#: Where sets meet, each is paired with so many earlier ones at a token; for those that then have no match the rest is looked at.
EARLIER = 8


@lru_cache(maxsize=4)
def odd_bits(num: int, den: int) -> np.ndarray:
    """By the sum of two sizes, in how many parity bits sets that match may differ; all may, from where long sets are paired on."""
    both = np.arange(2 * LONG + 1)
    out = np.minimum(both - 2 * -(-both * num // (num + den)), 64)
    out[LONG + LONG * num // den :] = 64
    return out.astype(np.int8)


def fitting(size: np.ndarray, place: np.ndarray, index: np.ndarray, bits: np.ndarray, e: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows (a, b) of one token, a no larger than b, those that pass the filters."""
    # most pairs fail by their parity bits, so these come first
    some = np.flatnonzero(np.bitwise_count(bits[a] ^ bits[b]) <= odd_bits(num, den)[size[a] + size[b]])
    a, b = a[some], b[some]
    both = size[a] + size[b]
    least = -(-both * num // (num + den))
    long = (size[b] == LONG) & (size[a] * den // num >= LONG)  # such sets are verified without these filters
    near = (size[b] * num <= size[a] * den) & (np.minimum(size[a] - place[a], size[b] - place[b]) + SHARED - 1 >= least)
    some = np.flatnonzero((near & (index[a] | (index[b] & (size[a] == size[b])))) | long)
    a, b = a[some], b[some]
    fit = ((np.bitwise_count(bits[a] ^ bits[b]) <= (both - 2 * least)[some]) | long[some]) & (e[a] != e[b])
    return a[fit], b[fit]


def weights(size: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """What a shared token counts: all that is needed, for pairs that needn't share as many."""
    return np.where((-(-(size[a] + size[b]) * num // (num + den)) < SHARED) | (size[b] == LONG), SHARED, 1)


def hot_tokens(items: DataFrame, extract: Extract, num: int, den: int, shared: Broadcast, split: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Prefix tokens of more than about `split` sets, and their salts; counted in a part of the rows, as it only decides how tokens are spread."""

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 18):
            token, count = np.unique(prefix_tokens(part, extract, num, den, shared.value)[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(count)], names=["token", "n"])

    bound_batches(items.sparkSession)
    some = items.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(64)) == 0).mapInArrow(lean(common), "token long, n long")
    hot = some.groupBy("token").agg((64 * F.sum("n")).alias("n")).where(f"n > {split}").orderBy(F.desc("n"), "token").limit(1_000_000).toPandas().sort_values("token")
    return hot["token"].to_numpy(np.int64).view(np.uint64), -(-hot["n"].to_numpy(np.int64) // split)


def common_pairs(items: DataFrame, extract: Extract, num: int, den: int, often: np.ndarray, buckets: int, split: int = 8192) -> DataFrame:
    """(x, y, token, df): pairs of different sets that share SHARED prefix tokens and pass the filters of `meetings`."""
    return counted(meetings(items, extract, num, den, often, buckets, split))


def counted(met: DataFrame) -> DataFrame:
    """Each pair (x, y) once that shares SHARED tokens, with the commonest that it met at."""
    pairs = met.groupBy("x", "y").agg(F.max("met").alias("met"), F.sum("shared").alias("shared")).where(F.col("shared") >= SHARED)
    return pairs.select("x", "y", F.shiftright("met", 32).alias("df"), F.col("met").alias("token"))


def meetings(items: DataFrame, extract: Extract, num: int, den: int, often: np.ndarray, buckets: int, split: int = 8192, most: int | None = None) -> DataFrame:
    """(x, y, met, shared, left): pairs of different sets that share prefix tokens and pass the length, positional
    and parity filters, found where the tokens' buckets meet; packed, 23 bytes a token and the id by byte planes.

    `most`: at each token a set is paired with no more than so many sets of least id that is
    not above its own.  What is left out is told by rows with `left`: where y isn't null it is
    such a set and x the token's key; else `left` packs all sets of these pairs (see `_ROW`).

    Sets that overlap by o share at least SHARED of the first n - o + SHARED tokens of each
    (all, where o is less), and before the last of these no more than SHARED - 1.

    Copies within a chunk are sent once.  Tokens of more than about `split` sets are spread
    over salts: one side of a pair goes to all of them, the other to one.
    """
    shared = items.sparkSession.sparkContext.broadcast(often)
    spread = items.sparkSession.sparkContext.broadcast(hot_tokens(items, extract, num, den, shared, split))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_bytes = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_bytes
            token, size, place, bits, e, ids = (np.concatenate([h[i] for h in held]) for i in range(6))
            held, n_bytes = [], 0
            short = size - needed(2 * size, num, num + den) + SHARED
            hot_tokens, hot_salts = spread.value
            index, key = place < short, mix(token)
            if len(hot_tokens):
                order = np.argsort(hot_tokens)
                at = order[np.minimum(np.searchsorted(hot_tokens, token, sorter=order), len(order) - 1)]
                salts = np.where(hot_tokens[at] == token, hot_salts[at], 1)
                salt = ranges(salts)
                index = np.repeat(index, salts) & (salt == np.repeat((e % salts.astype(np.uint64)).astype(np.int64), salts))
                token, size, place, bits, e, ids = (np.repeat(x, salts) for x in (token, size, place, bits, e, ids))
                key = mix(token + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            which = (key >> np.uint64(32)) % np.uint64(buckets)
            # by bucket; copies come together, all but surely
            order = np.argsort((which << np.uint64(42)) | ((key ^ e) >> np.uint64(22)))
            key, e, which = key[order], e[order], which[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (e[1:] != e[:-1])
            ids = np.minimum.reduceat(ids[order], np.flatnonzero(fresh)) if len(key) else ids
            order, key, e, which = order[fresh], key[fresh], e[fresh], which[fresh].astype(np.int64)
            size, bits = np.minimum(size[order], LONG).astype(np.uint16), bits[order]
            place = (np.minimum(place[order], 127) | np.where(index[order], 128, 0)).astype(np.uint8)
            cut = np.flatnonzero(np.diff(which, prepend=-1))
            ends = np.append(cut[1:], len(which))
            low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            columns = [pa.array(which[cut].astype(np.int32))] + [pa.array([x[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()) for x in (low, size, place, bits, e)]
            columns.append(pa.array([ids[a:b].view(np.uint8).reshape(-1, 8).T.tobytes() for a, b in zip(cut, ends)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PIECE.split(", ")])

        for part in slices(batches, "text", 1 << 18):
            token, place, owner, n, s1, bits, row = prefix_tokens(part, extract, num, den, shared.value)
            held.append((token, n[owner], place, bits[owner], s1[owner], part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)[row[owner]]))
            n_bytes += int(buffers(part.column("text"))[1][-1])
            if n_bytes >= CHUNK_BYTES:
                yield from flush()
        if held:
            yield from flush()

    def meet(group: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(name)])
        key, size, place, bits, e = read("keys", np.uint32), read("sizes", np.uint16).astype(np.int64), read("places", np.uint8), read("bits", np.uint64), read("e", np.uint64)
        ids = np.concatenate([np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T).view(np.int64)[:, 0] for x in group.column("ids")])
        # by token, size and set: one sort; copies that a collision keeps apart only weaken the count below
        order = np.argsort((key.astype(np.uint64) << np.uint64(32)) | (size.astype(np.uint64) << np.uint64(16)) | (e & np.uint64(0xFFFF)))
        k = key[order]
        again = np.zeros(len(k), bool)
        again[1:] = k[1:] == k[:-1]
        again[:-1] |= again[1:]
        order = order[again]  # tokens that are there once pair with nothing
        key, size, place, bits, e, ids = (x[order] for x in (key, size, place, bits, e, ids))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (e[1:] != e[:-1]) | (size[1:] != size[:-1])
        # an indexed row of a set stands for its copies, the least id for those of all
        first = np.flatnonzero(fresh)
        index = np.bitwise_or.reduceat(place >> 7, first).astype(bool) if len(key) else fresh
        ids = np.minimum.reduceat(ids, first) if len(key) else ids
        key, size, place, bits, e = (x[fresh] for x in (key, size, place & 127, bits, e))
        place = place.astype(np.int64)
        cut, spare = np.zeros(len(key), bool), np.zeros(len(key), bool)
        held: list[tuple[np.ndarray, np.ndarray]] = []  # (later, earlier) rows that fit
        n_held, room = 0, 1 << 18
        bound = np.full(len(key), np.iinfo(np.int64).max)  # of a set that has enough earlier ones, the latest of these

        def trim() -> None:
            nonlocal held, n_held, room
            late, early = (np.concatenate([h[c] for h in held]) if held else np.zeros(0, np.int64) for c in range(2))
            if most is not None:
                order = np.lexsort((e[early], ids[early], late))
                late, early = late[order], early[order]
                over = np.arange(len(late)) - np.searchsorted(late, late) >= most
                cut[late[over]] = spare[early[over]] = True
                late, early = late[~over], early[~over]
                last = np.flatnonzero(np.arange(len(late)) - np.searchsorted(late, late) == most - 1)
                bound[late[last]] = ids[early[last]]
            held, n_held = [(late, early)], len(late)
            room = max(1 << 18, 2 * n_held)

        # A set meets those from its own size on up to the largest that length, position and index allow.
        reach = np.minimum(size * den // num, (size - place + SHARED - 1) * (num + den) // num - size)
        reach = np.where(index, reach, np.minimum(reach, size))
        reach = np.where(size * den // num >= LONG, LONG, np.maximum(reach, 0)).astype(np.uint64)
        spot = (key.astype(np.uint64) << np.uint64(16)) | size.astype(np.uint64)
        stop = np.searchsorted(spot, (key.astype(np.uint64) << np.uint64(16)) | reach, side="right")
        for i, j in reached(stop):
            a, b = fitting(size, place, index, bits, e, i, j, num, den)
            for late, early in ((b, a), (a, b)):
                # of one id either may be the later
                right = ids[early] <= ids[late]
                late, early = late[right], early[right]
                over = ids[early] > bound[late]
                cut[late[over]] = spare[early[over]] = True
                if not over.all():
                    held.append((late[~over], early[~over]))
                    n_held += len(held[-1][0])
            if n_held > room:
                trim()
        trim()
        late, early = held[0]
        # once a pair, whichever was the later one
        pair = np.unique(np.maximum(late, early) << 32 | np.minimum(late, early))
        a, b = pair & 0xFFFFFFFF, pair >> 32
        run = np.searchsorted(key, key[a])
        df = np.searchsorted(key, key[a], side="right") - run
        x, y, token, shared = np.maximum(e[a], e[b]), np.minimum(e[a], e[b]), key[a], weights(size, a, b, num, den)
        # within a bucket once a pair
        order = np.lexsort((df, y, x))
        x, y, token, df, shared = (z[order] for z in (x, y, token, df, shared))
        last = np.ones(len(x), bool)
        last[:-1] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        total = np.diff(np.concatenate([[0], np.cumsum(shared.astype(np.int64))[last]]))
        x, y, token, df = (z[last] for z in (x, y, token, df))
        met = np.minimum(df.astype(np.int64), 2**31 - 1) << 32 | token.astype(np.int64)
        # what was left out: the later sets, then for each token all sets of these pairs
        late, rows = np.flatnonzero(cut), np.flatnonzero(cut | spare)
        packed = np.zeros(len(rows), _ROW)
        for name, values in (("e", e), ("id", ids), ("bits", bits), ("size", size), ("place", place), ("index", index)):
            packed[name] = values[rows]
        at = np.flatnonzero(np.diff(key[rows].astype(np.int64), prepend=-1))
        blobs = [packed[i:j].tobytes() for i, j in zip(at, np.append(at[1:], len(rows)))]
        n, k = len(late), len(blobs)
        return pa.table({
            "x": np.concatenate([x.view(np.int64), key[late].astype(np.int64), key[rows[at]].astype(np.int64)]),
            "y": pa.array(np.concatenate([y.view(np.int64), e[late].view(np.int64), np.zeros(k, np.int64)]), mask=np.repeat([False, True], [len(x) + n, k])),
            "met": np.concatenate([met, np.zeros(n + k, np.int64)]), "shared": np.concatenate([total, np.zeros(n + k, np.int64)]).astype(np.int32),
            "left": pa.array([None] * len(x) + [b""] * n + blobs, pa.binary()),
        })

    bound_batches(items.sparkSession)
    return items.mapInArrow(lean(send), _PIECE).groupBy("bucket").applyInArrow(meet, f"{_MET}, left binary")


def reached(stop: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i < j < stop[i], in arrays: of one distance while there are many such, the rest in pieces of bounded size."""
    i, d = np.arange(len(stop)), 1
    i = i[i + 1 < stop]
    while len(i) > most >> 4:
        yield i, i + d
        d += 1
        i = i[i + d < stop[i]]
    ends = np.cumsum(stop[i] - i - d)
    for at in range(0, int(ends[-1]) if len(ends) else 0, most):
        pair = np.arange(at, min(at + most, int(ends[-1])))
        of = np.searchsorted(ends, pair, side="right")
        yield i[of], stop[i[of]] - (ends[of] - pair)


def left_out(left: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that `meetings` left out of sets: (left, late): packed sets of a token, and which of them, as the later ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held
            if n_held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[i] for h in held])) for i in range(4)], names=["x", "y", "met", "shared"])
            held, n_held = [], 0

        for batch in batches:
            for key, blob, late in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                rows = np.frombuffer(blob.as_buffer(), _ROW)
                e, ids, bits, index = (rows[c].copy() for c in ("e", "id", "bits", "index"))
                size, place = rows["size"].astype(np.int64), rows["place"].astype(np.int64)
                asked = np.flatnonzero(np.isin(e.view(np.int64), late.values.to_numpy()))
                step = max(1, (1 << 17) // len(rows))
                for at in range(0, len(asked), step):
                    own = asked[at : at + step]
                    k, other = np.nonzero(ids[None, :] <= ids[own][:, None])
                    own = own[k]
                    first = size[other] < size[own]
                    # of equal size either may be the indexed one
                    a, b = fitting(size, place, index, bits, e, np.where(first, other, own), np.where(first, own, other), num, den)
                    x, y = np.maximum(e[a], e[b]).astype(np.int64), np.minimum(e[a], e[b]).astype(np.int64)
                    held.append((x, y, np.full(len(x), len(rows) << 32 | key), weights(size, a, b, num, den).astype(np.int32)))
                    n_held += len(x)
                    if n_held >= 1 << 14:
                        yield from flush()
        yield from flush()

    return left.select("key", "left", "late").mapInArrow(lean(run), _MET)


def matched(items: DataFrame, seen: DataFrame, classes: DataFrame, extract: Extract, num: int, den: int, most: int = EARLIER) -> DataFrame:
    """(e): the classes that match one whose first item is earlier.

    Of a large group of similar sets, whose pairs grow as its square, each is compared with
    few of the earliest.  Sets that had others left out, and have no match yet, are compared
    with these too: then each set has a match, or was compared with all its candidates.
    """
    buckets = estimated_buckets(items, parallelism(items.sparkSession))
    met = durable(meetings(items, extract, num, den, frequencies(seen), buckets, most=most))
    release_shuffles(items.sparkSession)

    def later(pairs: DataFrame) -> DataFrame:
        both = pairs.union(pairs.select("y", "x")).toDF("e", "other")
        rivals = classes.select(F.col("e").alias("other"), F.col("first").alias("rival")).join(sized(both), "other").groupBy("e").agg(F.min("rival").alias("rival"))
        return durable(classes.select("e", "first").join(sized(durable(rivals)), "e").where("rival < first").select("e").distinct())

    kept = met.where("left IS NULL").drop("left")
    found = later(common_links(items, counted(kept), classes, extract, num, den))
    open_ = durable(met.where("left IS NOT NULL AND y IS NOT NULL").select(F.col("x").alias("key"), F.col("y").alias("e")).join(sized(found), "e", "left_anti"))
    if open_.isEmpty():
        return found
    asked = durable(open_.groupBy("key").agg(F.collect_list("e").alias("late")))
    size = asked.agg(F.count("*"), F.sum(F.size("late"))).first()
    rest = left_out(met.where("y IS NULL").select(F.col("x").alias("key"), "left").join(sized(asked, *size), "key"), num, den)
    own = durable(open_.select("e").distinct())
    for side in ("x", "y"):  # tokens at which these pairs were kept count too
        rest = rest.union(kept.join(sized(own.withColumnRenamed("e", side)), side, "left_semi").select("x", "y", F.lit(-1).cast("long"), "shared"))
    return found.union(later(common_links(items, counted(rest).where("token >= 0"), classes, extract, num, den))).distinct()


def common_links(items: DataFrame, pairs: DataFrame, classes: DataFrame, extract: Extract, num: int, den: int, block: int = 128) -> DataFrame:
    """As `links`, for lines, whose tokens are mostly common: ordered by a table of hash buckets,
    so only prefixes move; parity bits reject most pairs where they meet.  Lines of pairs
    that are left go as texts straight to the blocks where they are verified."""
    placed = in_blocks(pairs, block)
    release_shuffles(items.sparkSession)
    named = classes.select("e", "n", "first").join(sized(durable(members_of(placed))), "e")
    wanted = named.groupBy(F.col("first.id").alias("_id"), F.col("first.tie").alias("_tie")).agg(F.collect_list(F.struct("first.number", "block", "e", "n")).alias("wanted"))
    wanted = durable(wanted)
    size = wanted.agg(F.count("*"), 2 * F.sum(F.size("wanted"))).first()
    rows = items.join(sized(wanted, *size), (F.col("id") == F.col("_id")) & (F.col("tie") == F.col("_tie"))).select("text", "wanted")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 18):
            body, offsets = buffers(part.column(0))
            feeds = np.flatnonzero(body == 10)
            starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
            count = np.bincount(np.searchsorted(offsets, feeds, side="right") - 1, minlength=part.num_rows) + 1
            first = np.cumsum(count) - count
            ends = np.append(starts[1:], len(body)) - 1
            ends[first + count - 1] = offsets[1:]
            asked = part.column(1).flatten()
            number, *rest = (asked.field(c) for c in range(4))
            line = np.repeat(first, part.column(1).value_lengths().to_numpy(zero_copy_only=False)) + number.to_numpy()
            raw = body.tobytes()
            texts = pa.array([raw[a:b] for a, b in zip(starts[line].tolist(), ends[line].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*rest, texts], names=["block", "e", "n", "line"])

    shipped = rows.mapInArrow(lean(send), "block long, e long, n long, line binary")
    return durable(verified_blocks(placed, shipped, num, den, extract, spread=1))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): least node reachable, for nodes with an edge, by alternating large and small stars.

    Rounds go on until nothing changes; their number grows with the logarithm of the longest path.
    """

    def state(e: DataFrame) -> tuple:
        got = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return got[0], got[1]

    e = durable(edges.toDF("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(e)
    while before[0]:
        near = e.union(e.select("b", "a"))
        least = durable(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")))
        hot = least.where(F.col("n") > HOT).select("a", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
        large = spread_join(near, least.drop("n"), "a", "b", hot).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select("a", F.col("m").alias("b")))
        old, e = e, durable(small.where("a != b").distinct())
        after = state(e)
        discard(least, old)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
