"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic classifier on features of the text gives each document evidence.  Grouped
aggregation turns the evidence into posteriors of hosts and of paths below them: a
path's mean is shrunk toward its host's, a host's toward the global one, by pseudo-counts
estimated from the spread between sites (method of moments).  A document's score adds
its site's log odds, relative to the global ones, to its own.

The classifier is fitted on at most `fit_rows` labelled documents (those with the least
hash of their id); all site statistics cover every document.  Only aggregates are
shuffled; texts never are, unless the site table outgrows its checked broadcast bound.

Null and empty texts have all-zero features.  Null hosts and paths are sites of their
own.  Where label rows of a document differ, the least quality counts.  Without labels,
or with one kind alone, every document scores 0.5 and is kept.  Repeated rows get equal
scores; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bound_batches, durable, lean, sized
from quire.llm.text import SPACED, buffers, distinct_per_row, gram_hashes, prefix_hashes, slices, span_hashes, words

FEATURES = (
    "log_words", "word_length", "letters", "capitals", "digits", "stops", "marks", "signs", "bars", "exclaims", "high_bytes",
    "distinct_words", "distinct_triples", "line_words", "distinct_lines", "signed_words", "capital_words",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_CAPITAL, _DIGIT, _HIGH = np.zeros(256, bool), _class("0123456789"), np.zeros(256, bool)
_CAPITAL[65:91] = _HIGH[128:] = True
_LETTER = _CAPITAL | _HIGH
_LETTER[97:123] = True
_STOP, _MARK, _SIGN, _BAR, _EXCLAIM, _LINE = _class("."), _class(",;:'\"()-?"), _class("*&%$#@^~=+<>{}[]\\_/"), _class("|"), _class("!"), ~_class("\n")


def features(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    n = len(offsets) - 1
    x = np.zeros((n, len(FEATURES)))
    if not len(body):
        return x
    size = np.diff(offsets).astype(float)

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.zeros(len(body) + 1, np.int32)
        np.cumsum(kind[body], out=total[1:])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)

    starts, ends, rows = words(body, offsets, SPACED)
    count = np.bincount(rows, minlength=n)
    some = np.maximum(count, 1)
    prefix = prefix_hashes(body)
    tokens = span_hashes(prefix, starts, ends)
    x[:, 0] = np.log1p(count) / 5
    x[:, 1] = np.bincount(rows, ends - starts, n) / some / 10
    for j, kind in enumerate((_LETTER, _CAPITAL, _DIGIT, _STOP, _MARK, _SIGN, _BAR, _EXCLAIM, _HIGH)):
        x[:, 2 + j] = share(kind)
    x[:, 11] = np.bincount(distinct_per_row(tokens, rows)[1], minlength=n) / some
    triples = gram_hashes(tokens, 3)
    whole = rows[: len(triples)] == rows[len(rows) - len(triples) :]
    x[:, 12] = np.where(count >= 3, np.bincount(distinct_per_row(triples[whole], rows[: len(triples)][whole])[1], minlength=n) / np.maximum(count - 2, 1), 1)
    ls, le, lr = words(body, offsets, _LINE)
    lines = np.maximum(np.bincount(lr, minlength=n), 1)
    x[:, 13] = np.log1p(count / lines) / 5
    x[:, 14] = np.bincount(distinct_per_row(span_hashes(prefix, ls, le), lr)[1], minlength=n) / lines
    if len(starts):
        x[:, 15] = np.bincount(rows, (_SIGN | _EXCLAIM | _BAR)[body[ends - 1]], n) / some
        x[:, 16] = np.bincount(rows, (_CAPITAL[body[starts]] & _CAPITAL[body[ends - 1]]) | (_CAPITAL[body[starts]] & (_EXCLAIM[body[ends - 1]])), n) / some
    return x


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps on standardised features; last entry is the bias."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1] + 1)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - y) / len(y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    out = np.append(w[:-1] / scale, 0.0)
    out[-1] = w[-1] - out[:-1] @ mean
    return out


def fit_on_labels(docs: DataFrame, labels: DataFrame, fit_rows: int, text: str = "text", doc_id: str = "doc_id") -> np.ndarray:
    """The classifier of labelled documents; fetches their features alone, of at most `fit_rows` rows: the least hashes of the id, then the least features."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_y")).dropna().groupBy("_id").agg(F.min("_y").alias("_y"))
    chosen = chosen.withColumn("_key", F.xxhash64("_id")).orderBy("_key", "_id").limit(fit_rows)
    joined = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id").select("text", "_y", "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 18):
            x = features(*buffers(part.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1), part.column(2)], names=["x", "y", "key"])

    rows = joined.mapInArrow(lean(run), "x array<double>, y double, key long").orderBy("key", "x", "y").limit(fit_rows).toPandas()
    if not len(rows):
        return np.zeros(len(FEATURES) + 1)
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy()
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def evidence(model: np.ndarray, text: str = "text") -> Column:
    """Log odds of quality by the text alone."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.string(), from_pandas=True)
        out = [np.zeros(0)]
        for part in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text", 1 << 18):
            out.append(np.clip(features(*buffers(part.column(0))) @ model[:-1] + model[-1], -12, 12))
        return pd.Series(np.concatenate(out))

    return score(F.col(text))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(q / (1 - q))


def site_posteriors(evidence_rows: DataFrame) -> DataFrame:
    """(host, path, shift): log odds of each path's posterior relative to the global mean.

    Input columns: host, path, p (probability by the text).  Sites with few documents
    are close to their host, hosts with few documents to the global mean.
    """
    paths = durable(evidence_rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    n, mean = total["n"] or 0, (total["s"] or 0.0) / (total["n"] or 1)

    def pseudo_count(sites: DataFrame, parent: Column) -> float:
        """Beta-binomial pseudo-count by moments: large where sites hardly differ."""
        got = sites.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - parent) ** 2).alias("between"), F.sum(parent * (1 - parent)).alias("noise"), F.sum("n").alias("n")).first()
        spread = max(((got["between"] or 0.0) - (got["noise"] or 0.0)) / max(got["n"] or 1, 1), 1e-6)
        return float(min(max(max(mean * (1 - mean), 1e-6) / spread - 1, 2.0), 1e4))

    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k_host = pseudo_count(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_mean"))
    joined = paths.join(sized(hosts), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    k_path = pseudo_count(joined, F.col("host_mean"))
    posterior = (F.col("s") + k_path * F.col("host_mean")) / (F.col("n") + k_path)
    return joined.select("host", "path", "n", "host_mean", posterior.alias("path_mean"), (_logit(posterior) - _logit(F.lit(mean))).alias("shift"))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, text: str = "text", doc_id: str = "doc_id", fit_rows: int = 20_000, weight: float = 0.5, threshold: float = 0.5, prefix: str = "_") -> DataFrame:
    """The documents with _evidence, _path_mean, _score (0 to 1) and _keep added.

    `prefix` begins the added names; columns that have them already are replaced.

    `host`, `path`: by default the source, and the language below it.  `weight`: share of
    the site's shift that a document gets.  Rejected are scores below `threshold`.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    bound_batches(docs.sparkSession)
    model = fit_on_labels(docs, labels, fit_rows, text, doc_id)
    logit = evidence(model, text)
    sites = site_posteriors(docs.select(host.alias("host"), path.alias("path"), (1 / (1 + F.exp(-logit))).alias("p")))
    sites = durable(sites.select(F.col("host").alias("__q_host"), F.col("path").alias("__q_path"), F.col("path_mean").alias("__q_mean"), F.col("shift").alias("__q_shift")))
    scored = docs.withColumns({"__q_logit": logit, "__q_h": host, "__q_p": path}).join(sized(sites), F.col("__q_h").eqNullSafe(F.col("__q_host")) & F.col("__q_p").eqNullSafe(F.col("__q_path")), "left")
    # (Without coalesce a filter on the score makes Spark ask first whether the evidence is null, and compute it twice.)
    score = 1 / (1 + F.exp(-(F.coalesce("__q_logit", F.lit(0.0)) + weight * F.coalesce(F.col("__q_shift"), F.lit(0.0)))))
    named = {"evidence": F.col("__q_logit"), "path_mean": F.col("__q_mean"), "score": score, "keep": score >= threshold}
    return scored.withColumns({prefix + k: v for k, v in named.items()}).drop("__q_logit", "__q_h", "__q_p", "__q_host", "__q_path", "__q_mean", "__q_shift")
