"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a hashed word vector and the mean of hashed vectors of its character
triples.  Two recurrences read every window of 32 words, one from either end; attention
pools their states into one logit per window.  Windows overlap by 8 words and cover the
whole text; a document's score is that of its most toxic window.

Training is multiple-instance: first every sampled window carries its document's label,
then each document's most toxic window does.  It uses at most `fit_rows` labelled
documents (least hash of the id) of at most `fit_chars` code points outside the held-out
fold, so what the driver holds is bounded.  Scoring is map-only and reads whole texts;
distinct words of a batch are embedded once.

Null and empty texts are scored as one window without words.  Repeated rows get equal
scores.  Where label rows of a document differ, it counts as toxic; of texts that share a
doc_id the least is learnt from.  With labels of one kind alone every score is that
label, without labels 0.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches, one_blas_thread
from quire.llm.text import ALNUM, LOWER, buffers, prefix_hashes, ranges, slices, span_hashes, words

WINDOW, STRIDE = 32, 24
WORD_SLOTS, CHAR_SLOTS = 1 << 17, 1 << 12
DIM, HIDDEN = 8, 8

Model = dict[str, np.ndarray]


def new_model(seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    m = {"word": small(WORD_SLOTS, DIM) * np.float32(0.1), "char": small(CHAR_SLOTS, DIM)}
    for d in "fb":
        m |= {f"{d}W": small(2 * DIM, 3 * HIDDEN), f"{d}U": small(HIDDEN, 3 * HIDDEN), f"{d}c": np.zeros(3 * HIDDEN, np.float32)}
    return m | {"attend": small(2 * HIDDEN), "out": small(2 * HIDDEN), "bias": np.full(1, -2.0, np.float32)}


class Batch:
    """Distinct words of some texts with their character triples, and the windows over them."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        body, n = LOWER[body], len(offsets) - 1
        starts, ends, rows = words(body, offsets, ALNUM)
        prefix = prefix_hashes(body)
        keys, first, self.word = np.unique(span_hashes(prefix, starts, ends), return_index=True, return_inverse=True)
        self.row = rows
        self.slot = (keys % np.uint64(WORD_SLOTS)).astype(np.int64)
        a, b = starts[first], ends[first]
        # triples of bytes within a word; a shorter word is one
        count = np.maximum(b - a - 2, 1)
        at = np.repeat(a, count) + ranges(count)
        self.chars = (span_hashes(prefix, at, np.minimum(at + 3, np.repeat(b, count))) % np.uint64(CHAR_SLOTS)).astype(np.int64)
        self.char_start = np.cumsum(count) - count
        self.char_count = count
        per = np.bincount(rows, minlength=n)
        many = np.where(per > WINDOW, -(-(per - WINDOW) // STRIDE) + 1, 1)
        self.window_row = np.repeat(np.arange(n), many)
        begin = (np.cumsum(per) - per)[self.window_row] + ranges(many) * STRIDE
        length = np.minimum(np.maximum(per[self.window_row] - ranges(many) * STRIDE, 0), WINDOW)
        grid = np.arange(WINDOW)
        self.mask = grid[None] < length[:, None]
        index = np.where(self.mask, begin[:, None] + grid, 0)
        unseen = len(keys)  # a slot of zeros for places without a word
        self.tokens = np.where(self.mask, self.word[index] if len(self.word) else 0, unseen)

    def inputs(self, m: Model, kept: np.ndarray | None = None) -> np.ndarray:
        """One row of 2*DIM per distinct word, and a last row of zeros; `kept` masks inputs in training."""
        x = np.zeros((len(self.slot) + 1, 2 * DIM), np.float32)
        if len(self.slot):
            x[:-1, :DIM] = m["word"][self.slot]
            x[:-1, DIM:] = np.add.reduceat(m["char"][self.chars], self.char_start, axis=0) / self.char_count[:, None]
        return x if kept is None else x * kept


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _recur(proj: np.ndarray, tokens: np.ndarray, mask: np.ndarray, u: np.ndarray, steps: range, keep: bool) -> tuple[np.ndarray, list]:
    n, h = len(tokens), HIDDEN
    state = np.zeros((n, h), np.float32)
    out = np.zeros((WINDOW, n, h), np.float32)
    trace = []
    for t in steps:
        x, g = proj[tokens[:, t]], state @ u
        zr = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        new = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
        before = state
        state = new + z * (state - new)
        live = mask[:, t]
        if not live.all():
            state = np.where(live[:, None], state, before)
        out[t] = state
        if keep:
            trace.append((t, before, z, r, new, g[:, 2 * h :]))
    return out, trace


def forward(m: Model, batch: Batch, windows: np.ndarray | None = None, keep: bool = False, kept: np.ndarray | None = None):
    """Logit of each window; with `keep`, what backward() needs."""
    tokens, mask = (batch.tokens, batch.mask) if windows is None else (batch.tokens[windows], batch.mask[windows])
    x = batch.inputs(m, kept)
    proj = {d: x @ m[d + "W"] + m[d + "c"] for d in "fb"}
    hf, tf = _recur(proj["f"], tokens, mask, m["fU"], range(WINDOW), keep)
    hb, tb = _recur(proj["b"], tokens, mask, m["bU"], range(WINDOW - 1, -1, -1), keep)
    states = np.concatenate([hf, hb], 2)
    energy = np.where(mask.T, states @ m["attend"], np.float32(-1e9))
    weight = np.exp(energy - energy.max(0))
    weight *= mask.T
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = (weight[:, :, None] * states).sum(0)
    logit = pooled @ m["out"] + m["bias"]
    return logit if not keep else (logit, (tokens, mask, x, states, weight, pooled, kept, {"f": tf, "b": tb}))


def backward(m: Model, batch: Batch, cache, dlogit: np.ndarray) -> Model:
    """Gradients of sum(dlogit * logit)."""
    tokens, mask, x, states, weight, pooled, kept, traces = cache
    h = HIDDEN
    g: Model = {"out": pooled.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
    dpool = dlogit[:, None] * m["out"]
    dweight = (states * dpool).sum(2)
    denergy = weight * (dweight - (weight * dweight).sum(0))
    g["attend"] = np.einsum("tn,tnk->k", denergy, states)
    dstates = weight[:, :, None] * dpool + denergy[:, :, None] * m["attend"]
    dx = np.zeros_like(x)
    for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
        u, du = m[d + "U"], np.zeros_like(m[d + "U"])
        dproj = np.zeros((len(x), 3 * h), np.float32)
        carry = np.zeros((len(tokens), h), np.float32)
        for t, before, z, r, new, gn in reversed(traces[d]):
            total = carry + dstates[t, :, part]
            live = mask[:, t][:, None]
            ds = total * live
            dn = ds * (1 - z) * (1 - new**2)
            dz = ds * (before - new) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], 1)
            du += before.T @ dg
            np.add.at(dproj, tokens[:, t], np.concatenate([dz, dr, dn], 1))
            carry = ds * z + dg @ u.T + total * ~live
        g[d + "U"], g[d + "W"], g[d + "c"] = du, x.T @ dproj, dproj.sum(0)
        dx += dproj @ m[d + "W"].T
    if kept is not None:
        dx *= kept
    g["word"], g["char"] = np.zeros_like(m["word"]), np.zeros_like(m["char"])
    np.add.at(g["word"], batch.slot, dx[:-1, :DIM])
    np.add.at(g["char"], batch.chars, np.repeat(dx[:-1, DIM:] / batch.char_count[:, None], batch.char_count, axis=0))
    return g


def train(texts: list[str], y: np.ndarray, least_steps: int = 320, seed: int = 5, group: int = 64, windows: int = 6, least_docs: int = 5) -> Model | float:
    """Adam on groups of documents, for at least 5 epochs; with one kind of label that label, without any 0."""
    if not len(y) or y.min() == y.max():
        return float(y.min()) if len(y) else 0.0
    one_blas_thread()
    rng = np.random.default_rng(seed)
    m = new_model()
    batches: dict[int, tuple[Batch, np.ndarray]] = {}
    order = rng.permutation(len(texts))
    for i in range(0, len(order), group):
        part = order[i : i + group]
        batches[i] = (Batch(*buffers(pa.array([texts[j] for j in part], pa.large_string()))), y[part].astype(np.float32))
    # Only slots of these texts' words are trained: a table of them alone.
    used = np.unique(np.concatenate([batch.slot for batch, _ in batches.values()]))
    for batch, _ in batches.values():
        batch.slot = np.searchsorted(used, batch.slot)
    slots = len(used)
    m["word"] = np.zeros((slots, DIM), np.float32)
    mean, square, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    # A word's vector starts from how far its share of toxic documents lies from that of all,
    # in standard errors; words of few documents have none, lest documents be learnt by heart.
    spread, toxic = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for batch, label in batches.values():
        if len(batch.word):
            pairs = np.unique(batch.slot[batch.word] * len(label) + batch.row)
            spread += np.bincount(pairs // len(label), minlength=slots)
            toxic += np.bincount(pairs // len(label), label[pairs % len(label)], slots).astype(np.int64)
    common = (spread >= least_docs)[:, None].astype(np.float32)
    share = float(np.mean(y))
    apart = (toxic - spread * share) / np.sqrt(np.maximum(spread * share * (1 - share), 1e-9))
    m["word"][:, 0] = np.where((spread >= least_docs) & (np.abs(apart) > 3), np.clip(apart / 4, -1.5, 1.5), 0)
    epochs = max(5, -(-least_steps // len(batches)))
    for epoch in range(epochs):
        for i in rng.permutation(list(batches)).tolist():
            batch, label = batches[i]
            if epoch < 1:  # some windows of each document, all with its label
                pick = rng.permutation(len(batch.window_row))
                order_ = np.argsort(batch.window_row[pick], kind="stable")
                rank = ranges(np.bincount(batch.window_row, minlength=len(label)))
                chosen = pick[order_][rank < windows]
            else:  # each document's most toxic window, and a second of the clean ones
                logit = forward(m, batch)
                by = np.lexsort((-logit, batch.window_row))
                rank = ranges(np.bincount(batch.window_row, minlength=len(label)))
                chosen = by[(rank == 0) | ((rank == 1) & (label[batch.window_row[by]] == 0))]
            # inputs are dropped at random: characters of a word often, its own vector seldom
            kept = np.ones((len(batch.slot) + 1, 2 * DIM), np.float32)
            kept[rng.random(len(kept)) < 0.05, :DIM] = 0
            kept[rng.random(len(kept)) < 0.3, DIM:] = 0
            logit, cache = forward(m, batch, chosen, keep=True, kept=kept)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            grads = backward(m, batch, cache, ((p - label[batch.window_row[chosen]]) / len(label)).astype(np.float32))
            grads["word"] *= common
            for k in ("char", "fW", "bW", "fU", "bU"):
                grads[k] += np.float32(2e-4) * m[k]
            step += 1
            rate = 0.01 if epoch < epochs - max(1, epochs // 6) else 0.003
            for k, g in grads.items():
                mean[k] += np.float32(0.1) * (g - mean[k])
                square[k] += np.float32(0.005) * (g * g - square[k])
                m[k] -= np.float32(rate / (1 - 0.9**step)) * mean[k] / (np.sqrt(square[k] / np.float32(1 - 0.995**step)) + np.float32(1e-6))
    compact, m["word"] = m["word"], np.zeros((WORD_SLOTS, DIM), np.float32)
    m["word"][used] = compact
    return m


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int, text: str = "text", doc_id: str = "doc_id", fit_chars: int = 20_000) -> Model | float:
    """A model of at most `fit_rows` labelled documents, of at most `fit_chars` code points, outside the held-out fold; a third toxic if there are so many."""
    y = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("double").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    y = y.where("crc32(CAST(_id AS STRING)) % 5 != 0").withColumn("_key", F.xxhash64("_id"))
    toxic = y.where("_y = 1").orderBy("_key", "_id").limit(fit_rows // 3)
    clean = y.where("_y = 0").orderBy("_key", "_id").limit(fit_rows - fit_rows // 3)
    chosen = F.broadcast(toxic.union(clean).drop("_key"))
    known = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).where(F.length("_t") <= fit_chars)
    rows = known.join(chosen, "_id").groupBy("_id").agg(F.min("_t").alias("_t"), F.min("_y").alias("_y")).orderBy("_id").toPandas()
    return train(rows["_t"].tolist(), rows["_y"].to_numpy())


OUT = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", fit_rows: int = 4_000, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score of its most toxic window, predicted."""
    model = fitted(docs, labels, fit_rows, text, doc_id)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        one_blas_thread()
        n = batch.num_rows
        if isinstance(shared.value, float):
            p = np.full(n, shared.value)
        else:
            best, b = np.full(n, -40.0), Batch(*buffers(batch.column(1)))
            np.maximum.at(best, b.window_row, forward(shared.value, b).astype(float))
            p = 1 / (1 + np.exp(-np.clip(best, -40, 40)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    key = F.col(doc_id).cast("long")
    return map_batches(docs.select(key.alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False)).alias("held_out")), run, OUT, budget=1 << 19)
