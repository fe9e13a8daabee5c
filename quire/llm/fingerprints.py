"""Improbable-feature digests of documents, and their likeness.

A feature is a window of 64 bytes.  Windows are ranked by how improbable their entropy
is among windows of text (a fixed model, so that equal texts have equal fingerprints
everywhere); of every 64 neighbouring windows the rarest, leftmost on ties, gets a
vote, and windows with at least 16 votes are the document's features; where none has
so many, those with the most votes are.  Features are hashed into Bloom filters of 2048 bits, 128 features each, chained in order of
position.  Two fingerprints are compared by the bit overlap of their filters,
normalised between the overlap expected by chance and the largest possible one.

Entropies are exact integers, computed for all windows of thousands of documents with
a few vectorised passes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bound_batches, durable, lean, one_blas_thread, parallelism
from quire.llm.text import buffers, mix, prefix_hashes, ranges, slices, span_hashes

WINDOW = 64
NEIGHBOURS = 64
VOTES = 16
SMALL = 8
BITS = 2048
PER_FILTER = 128
HASHES = 5
_SCALE = 1 << 16
#: c * log2(c), scaled to integers, for c = 0..64.
_CLOG = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], np.int64)
_GAIN = np.concatenate([[0], np.diff(_CLOG)]).astype(np.int32)
#: Entropy of a text window in bits: usual value and spread; windows below LEAST rank last.
USUAL, SPREAD, LEAST = 4.0, 0.25, 2.5
_STEP = 512


def _rank_table() -> np.ndarray:
    """Rank by entropy class (small: improbable), for sums of c*log2(c) in steps of 512."""
    sums = (np.arange(int(_CLOG[WINDOW]) // _STEP + 1) + 0.5) * _STEP / _SCALE
    entropy = np.log2(WINDOW) - sums / WINDOW
    likely = np.exp(-0.5 * ((entropy - USUAL) / SPREAD) ** 2)
    order = np.argsort(np.argsort(likely, kind="stable"), kind="stable")
    return np.where(entropy < LEAST, len(sums) + np.argsort(np.argsort(-entropy, kind="stable"), kind="stable"), order).astype(np.int64)


_RANK = _rank_table()


def window_sums(body: np.ndarray) -> np.ndarray:
    """Scaled sum of c*log2(c) over the byte counts of every window of 64 bytes."""
    n = len(body)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    order = np.argsort(body, kind="stable")
    key = order + body[order].astype(np.int64) * (n + WINDOW)
    low = np.searchsorted(key, key - (WINDOW - 1))
    index = np.arange(n)
    within = (index - low + 1).astype(np.int16)
    ahead = (np.cumsum(np.bincount(low, minlength=n)) - index).astype(np.int16)
    add, drop = np.empty(n, np.int32), np.empty(n, np.int32)
    add[order] = _GAIN[within]
    drop[order] = _GAIN[ahead]
    change = add.astype(np.int64)
    change[WINDOW:] -= drop[: n - WINDOW]
    return np.cumsum(change)[WINDOW - 1 :]


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row, hash) of the features of each row, in order of position.

    A row with fewer than 64 windows has all its windows of 8 bytes (or itself, if shorter).
    A longer row without a window of 16 votes has those with the most votes, equal ones once.
    """
    return _features(body, offsets)[:3]


def _features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`features`, and the rows that have windows of fewer than 16 votes."""
    lengths = np.diff(offsets)
    prefix = prefix_hashes(body)
    rows, at, bare = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(body) >= WINDOW + NEIGHBOURS - 1:
        rank = _RANK[window_sums(body) // _STEP]
        low = (rank << 40) + np.arange(len(rank))
        step = 1
        while step < NEIGHBOURS:  # sliding minimum by doubling
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        start = np.arange(len(low))
        row = np.repeat(np.arange(len(lengths)), lengths)[: len(low)]
        inside = start + WINDOW + NEIGHBOURS - 1 <= offsets[row + 1]
        votes = np.bincount(low[inside] & ((1 << 40) - 1), minlength=len(body))
        at = np.flatnonzero(votes >= VOTES)
        rows = np.searchsorted(offsets, at, side="right") - 1
        bare = np.flatnonzero((lengths >= WINDOW + NEIGHBOURS - 1) & (np.bincount(rows, minlength=len(lengths)) == 0))
        most = []
        for a, b in zip(offsets[bare].tolist(), offsets[bare + 1].tolist()):
            top = a + np.flatnonzero(votes[a:b] == votes[a:b].max())
            most.append(np.sort(top[np.unique(span_hashes(prefix, top, top + WINDOW), return_index=True)[1]]))
        if most:
            at, rows = np.concatenate([at, *most]), np.concatenate([rows, np.repeat(bare, [len(m) for m in most])])
    short = np.flatnonzero((lengths > 0) & (lengths < WINDOW + NEIGHBOURS - 1))
    size = np.minimum(lengths[short], SMALL)
    number = lengths[short] - size + 1
    extra = np.repeat(offsets[:-1][short], number) + ranges(number)
    begin = np.concatenate([at, extra])
    owner = np.concatenate([rows, np.repeat(short, number)])
    end = np.concatenate([at + WINDOW, extra + np.repeat(size, number)])
    order = np.argsort(begin, kind="stable")
    begin, owner, end = begin[order], owner[order], end[order]
    return owner, begin - offsets[owner], span_hashes(prefix, begin, end), bare


def filters(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(filters as 32 words of 64 bits each, first filter of each row): rows ascending."""
    count = np.bincount(rows, minlength=n)
    number = ranges(count) // PER_FILTER
    per_row = -(-count // PER_FILTER)
    first = np.concatenate([[0], np.cumsum(per_row)])
    bits = np.zeros((int(first[-1]), BITS), bool)
    slot = first[rows] + number
    h = hashes.copy()
    for _ in range(HASHES):
        bits[slot, (h >> np.uint64(53)).astype(np.int64)] = True
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), first


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best partner in the other."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    best = np.zeros(len(a))
    spread = lambda x: np.unpackbits(x.view(np.uint8), axis=1).astype(np.float32)
    step = 256  # filters of a block: common bits of two blocks are one matrix product
    for j in range(0, len(b), step):
        other, size = spread(b[j : j + step]).T, nb[None, j : j + step]
        for i in range(0, len(a), step):
            own = na[i : i + step, None]
            both = spread(a[i : i + step]) @ other
            most, chance = np.minimum(own, size), own * size / BITS
            score = np.where(own * size > 0, (both - chance) / np.maximum(most - chance, 1e-9), 0.0)
            # A filter much emptier than its partner isn't taken as contained in it.
            score *= np.sqrt(most / np.maximum(np.maximum(own, size), 1))
            best[i : i + step] = np.maximum(best[i : i + step], score.max(axis=1))
    return float(np.clip((best * na).sum() / na.sum(), 0, 1))


def encoded(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SEAM = 256


def compare_with_next(ids: pa.Array, body: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """Rows 0..n-2, each with the row after it as its next document."""
    n = len(offsets) - 2
    heads = np.flatnonzero((body & 0xC0) != 0x80)
    heads = np.append(heads, len(body))
    first_char = np.searchsorted(heads[:-1], offsets)
    n_chars = np.diff(first_char)
    quarter = n_chars // 4
    kept = heads[first_char[:-1] + n_chars - quarter] - offsets[:-1]
    borrowed = heads[first_char[1:-1] + np.minimum(quarter[:-1], n_chars[1:])] - offsets[1:-1]
    rows, at, hashes, bare = _features(body, offsets)
    chains, first = filters(rows, hashes, n + 1)
    # Only the seam and the new tail of the edited text are computed again: a feature
    # depends on no more than 63 windows either side.
    raw = body.tobytes()
    seam = np.maximum(kept[:-1] - _SEAM, 0)
    tails = [raw[offsets[i] + seam[i] : offsets[i] + kept[i]] + raw[offsets[i + 1] : offsets[i + 1] + borrowed[i]] for i in range(n)]
    tail_offsets = np.concatenate([[0], np.cumsum([len(t) for t in tails])]).astype(np.int64)
    trows, tat, thashes, tbare = _features(np.frombuffer(b"".join(tails), np.uint8), tail_offsets)
    switch = np.where(seam > 0, kept[:-1] - (WINDOW + NEIGHBOURS - 2), 0)
    keep = (rows < n) & ~np.isin(rows, bare)
    keep[keep] = at[keep] < switch[rows[keep]]
    tkeep = (tat + seam[trows] >= switch[trows]) & ~(np.isin(trows, tbare) & (seam[trows] > 0))
    erows, ehashes = np.concatenate([rows[keep], trows[tkeep]]), np.concatenate([hashes[keep], thashes[tkeep]])
    # an edited text without a feature left is looked at as a whole
    lone = np.flatnonzero((np.bincount(erows, minlength=n) == 0) & (kept[:-1] + borrowed > 0))
    if len(lone):
        texts = [raw[offsets[i] : offsets[i] + kept[i]] + raw[offsets[i + 1] : offsets[i + 1] + borrowed[i]] for i in lone.tolist()]
        lrows, _, lhashes = features(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        erows, ehashes = np.concatenate([erows, lone[lrows]]), np.concatenate([ehashes, lhashes])
    order = np.argsort(erows, kind="stable")
    edited, efirst = filters(erows[order], ehashes[order], n)
    out: dict[str, list] = {"sha": [], "fp": [], "efp": [], "near": [], "next": []}
    for i in range(n):
        own, new, follow = chains[first[i] : first[i + 1]], edited[efirst[i] : efirst[i + 1]], chains[first[i + 1] : first[i + 2]]
        digest = hashlib.sha256(raw[offsets[i] : offsets[i] + kept[i]])
        digest.update(raw[offsets[i + 1] : offsets[i + 1] + borrowed[i]])
        out["sha"].append(digest.hexdigest())
        out["fp"].append(encoded(own))
        out["efp"].append(encoded(new))
        out["near"].append(likeness(own, new))
        out["next"].append(likeness(own, follow))
    return pa.RecordBatch.from_arrays(
        [ids.slice(0, n).cast(pa.int64()), pa.array(n_chars[:n].astype(np.int64)), *(pa.array(out[k], pa.string()) for k in ("sha", "fp", "efp")), pa.array(out["near"], pa.float64()), pa.array(out["next"], pa.float64())],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def order_keys(*columns: np.ndarray) -> np.ndarray:
    """Signed integers as bytes that sort as the rows do."""
    out = np.empty((len(columns[0]), len(columns)), ">u8")
    for i, c in enumerate(columns):
        out[:, i] = c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(out).view(f"S{8 * len(columns)}").reshape(-1)


def range_bounds(keys: DataFrame, count: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Starts (ord, h, salt) of about `count` ranges, and (ord, h, salts) of keys of more rows than two ranges should have.

    keys: ord, h, n.  Both lists grow with the ranges alone; they only decide where rows are
    worked on.  No range is empty: starts are keys that exist, and a salt has 64 rows or more
    on average (of 64 rows by hash none falls to it with a chance of 1e-28).
    """
    total = keys.agg(F.sum("n")).first()[0] or 0
    most = max(1, 2 * -(-total // count))
    salted = F.least(F.ceil(F.col("n") / most), F.floor(F.col("n") / 64)).cast("int")
    hot = [tuple(r) for r in keys.where((F.col("n") > most) & (F.col("n") >= 128)).select("ord", "h", salted).orderBy("ord", "h").collect()]
    after = keys.agg(*[F.min(F.when((F.col("ord") > o) | ((F.col("ord") == o) & (F.col("h") > h)), F.struct("ord", "h"))).alias(f"k{i}") for i, (o, h, _) in enumerate(hot)]).first() if hot else []
    some = sorted((r["ord"], r["h"]) for r in keys.orderBy(F.xxhash64("ord", "h"), "ord", "h").limit(32 * count).select("ord", "h").collect())
    cuts = {(*some[i * len(some) // count], 0) for i in range(1, count) if some}
    for (o, h, salts), following in zip(hot, after):
        cuts |= {(o, h, s) for s in range(salts)}
        cuts |= {(following["ord"], following["h"], 0)} if following is not None else set()
    least = keys.agg(F.min(F.struct("ord", "h")).alias("k")).first()["k"]
    return sorted(c for c in cuts if least is not None and c > (least["ord"], least["h"], 0)), hot


def fingerprint(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ranges_: int | None = None) -> DataFrame:
    """One row per document: its fingerprint, that of the edited text, and two likenesses.

    Texts move once, to ranges of (doc_id, text hash); the first document of each range goes
    to the range before it too, so every document meets its next one without a global window.
    Rows with one doc_id and text that are too many for a range are spread over several:
    each one's next is its like, but for the last.

    Null texts are empty; empty texts have an empty fingerprint, like only to another
    empty one.  A null doc_id sorts first; equal doc_ids are ordered by the hash of their
    text.  An empty table gives no rows; a single document is its own next one.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = given.withColumns({"ord": F.coalesce("doc_id", F.lit(-(2**63))), "h": F.xxhash64("text")})
    parts = parallelism(spark)
    count = ranges_ or 4 * parts
    keys = durable(own.groupBy("ord", "h").agg(F.count("*").alias("n")))
    bounds, hot = range_bounds(keys, count)
    least = keys.agg(F.min(F.struct("ord", "h")).alias("k")).first()["k"]
    # Bounded lists (some values per range); places are found by binary search.
    edges = order_keys(*(np.array([b[i] for b in bounds], np.int64) for i in range(3)))
    crowds = order_keys(*(np.array([b[i] for b in hot], np.int64) for i in range(2)))
    salts = np.array([b[2] for b in hot], np.int64)
    last = len(bounds)
    # the first rows of ranges, but for those that begin within a crowd
    starts = order_keys(*(np.array([b[i] for b in bounds if b[2] == 0], np.int64) for i in range(2)))
    least_key = order_keys(np.array([least["ord"]]), np.array([least["h"]]))[0] if least is not None else b""

    @F.pandas_udf("range int, guest int, inner boolean")
    def place(o: pd.Series, h: pd.Series, row: pd.Series) -> pd.DataFrame:
        """The range of a row; the range that it also goes to as a guest, or -1; whether its range ends within a crowd."""
        a, b = o.to_numpy(np.int64), h.to_numpy(np.int64)
        key = order_keys(a, b)
        salt = np.zeros(len(a), np.int64)
        inner = np.zeros(len(a), bool)
        if len(crowds):
            i = np.minimum(np.searchsorted(crowds, key), len(crowds) - 1)
            crowd = crowds[i] == key
            salt = np.where(crowd, (row.to_numpy(np.int64) & 0x7FFFFFFF) % salts[i], 0)
            inner = crowd & (salt < salts[i] - 1)
        found = np.searchsorted(edges, order_keys(a, b, salt), side="right")
        first = np.zeros(len(a), bool)
        if len(starts):
            i = np.minimum(np.searchsorted(starts, key), len(starts) - 1)
            first = (starts[i] == key) & (salt == 0)
        guest = np.where(first, found - 1, -1)
        guest = np.where((key == least_key) & (salt == 0), last, guest)
        return pd.DataFrame({"range": found.astype(np.int32), "guest": guest.astype(np.int32), "inner": inner})

    at = lambda r, guest, inner: F.struct(r.alias("range"), F.lit(guest).alias("guest"), inner.alias("inner"))
    placed = own.withColumn("at", place("ord", "h", F.xxhash64(F.monotonically_increasing_id())))
    one, two = at(F.col("at.range"), False, F.col("at.inner")), at(F.col("at.guest"), True, F.lit(False))
    both = placed.select("doc_id", "text", "ord", "h", F.explode(F.when(F.col("at.guest") >= 0, F.array(one, two)).otherwise(F.array(one))).alias("at"))
    sorted_ = both.select("doc_id", "text", "ord", "h", "at.range", "at.guest", "at.inner").repartitionById(parts, "range").sortWithinPartitions("range", "guest", "ord", "h", "text").select("doc_id", "text", "range", "guest", "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        held: pa.RecordBatch | None = None

        def closed(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """The last row of a range that ends within a crowd: its next is its like."""
            if row.column(4)[0].as_py() and not row.column(3)[0].as_py():
                pair = pa.Table.from_batches([row, row]).combine_chunks().to_batches()[0]
                yield compare_with_next(pair.column(0), *buffers(pair.column(1)))

        for part in slices(batches, "text", 1 << 17):  # small slices stay in the CPU cache
            # one run per range; of a range's guests only the first counts
            where = part.column(2).to_numpy(zero_copy_only=False)
            visits = part.column(3).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(where)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(where)]):
                own_rows = int((~visits[a:b]).sum())
                take = part.slice(a, min(own_rows + 1, b - a))
                if held is not None and held.column(2)[0].as_py() == take.column(2)[0].as_py():
                    if held.column(3)[0].as_py():
                        continue
                    take = pa.Table.from_batches([held, take]).combine_chunks().to_batches()[0]
                elif held is not None:
                    yield from closed(held)
                held = take.slice(take.num_rows - 1)
                if take.num_rows > 1:
                    yield compare_with_next(take.column(0), *buffers(take.column(1)))
        if held is not None:
            yield from closed(held)

    bound_batches(spark)
    return sorted_.mapInArrow(lean(run), OUT)
