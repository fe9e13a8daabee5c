"""Line dedup by an exact set-similarity join.

A line's tokens are its words, lower-cased in A-Z and counted within the line (the second
"the" is a token of its own).  Lines whose token sets reach the Jaccard threshold match
(compared in integers); every line that matches an earlier one, in order of doc_id, text
hash and line number, is removed.  Tokens are ordered rare first, and prefix, length,
positional and parity filters and verification are those of `setjoin`; equal lines form
classes and are never expanded into pairs, and of many similar lines each is compared with
few of the earliest first, with all its candidates only if it matches none of these.

Lines end at line feeds.  Lines without a word and lines of documents with a null doc_id
stay.  A null text stays null, an empty one empty.  Rows that share a doc_id are told
apart by their texts; of rows that share both, one keeps its lines and the others lose
all that have a word.  Other columns pass through.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.llm import setjoin
from quire.llm.common import bound_batches, durable, lean, release_shuffles, sized
from quire.llm.text import LOWER, SPACED, buffers, mix, ranges, slices, word_hashes, words


def line_starts(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all lines, and how many lines each row has."""
    feeds = np.flatnonzero(body == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    row_of = np.searchsorted(offsets, feeds, side="right") - 1
    return starts, np.bincount(row_of, minlength=len(offsets) - 1) + 1


def word_sets(body: np.ndarray, offsets: np.ndarray):
    """Sets of words, counted within the line; of every line that has one."""
    edges, count = line_starts(body, offsets)
    lowered = LOWER[body]
    starts, ends, _ = words(lowered, offsets, SPACED)
    line = np.searchsorted(edges, starts, side="right") - 1
    tokens = word_hashes(lowered, starts, ends)
    order = setjoin.row_order(tokens, line)
    tokens, line = tokens[order], line[order]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (line[1:] != line[:-1])
    again = ranges(np.diff(np.append(np.flatnonzero(fresh), len(tokens)))).astype(np.uint64)
    some = np.bincount(line, minlength=len(edges)) > 0
    row = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(edges)) - np.repeat(np.cumsum(count) - count, count)
    return mix(tokens + again * np.uint64(0x9E3779B97F4A7C15)), (np.cumsum(some) - 1)[line], row[some], number[some]


word_sets.distinct = True


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.withColumns({"__q_id": F.col(doc_id).cast("long"), "__q_tie": F.xxhash64(F.col(text))})


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", num: int = 80, den: int = 100) -> DataFrame:
    """(id, tie, gone): per doc_id and text hash the numbers, from 0, of the lines that match an earlier line."""
    items = _keyed(docs, text, doc_id).where("__q_id IS NOT NULL").select(F.col("__q_id").alias("id"), F.col("__q_tie").alias("tie"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seen = durable(setjoin.signed(items, word_sets))
    lines = seen.where("counts IS NULL").drop("piece", "counts")
    classes = durable(setjoin.classes_of(lines))
    release_shuffles(docs.sparkSession)
    lost = setjoin.matched(items, seen, classes, word_sets, num, den).withColumn("lost", F.lit(True))
    doomed = classes.join(sized(lost), "e", "left").withColumn("lost", F.coalesce("lost", F.lit(False))).where("copies > 1 OR lost")
    doomed = durable(doomed.select("e", F.col("s2").alias("_s2"), F.col("n").alias("_n"), "first", "lost"))
    same = (F.col("s1") == F.col("e")) & (F.col("s2") == F.col("_s2")) & (F.col("n") == F.col("_n"))
    gone = lines.join(sized(doomed), same).where("lost OR NOT (id = first.id AND tie = first.tie AND number = first.number)")
    return gone.groupBy("id", "tie").agg(F.array_sort(F.collect_set("number")).alias("gone"))


def without_lines(part: pa.RecordBatch, text: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without the lines in `__q_gone` (all that have a word, where `__q_again`); lines and lines removed of each row."""
    column = part.column(text)
    body, offsets = buffers(column)
    starts, count = line_starts(body, offsets)
    first = np.cumsum(count) - count
    lists, again = part.column("__q_gone"), part.column("__q_again").to_numpy(zero_copy_only=False)
    number = np.where(np.asarray(column.is_valid()), count, 0)
    keep = np.ones(len(starts), bool)
    asked = np.asarray(pc.fill_null(lists.value_lengths(), 0)).astype(np.int64)
    keep[np.repeat(first, asked) + lists.flatten().to_numpy(zero_copy_only=False)] = False
    if again.any():
        worded = np.zeros(len(starts), bool)
        worded[np.searchsorted(starts, words(body, offsets, SPACED)[0], side="right") - 1] = True
        keep &= ~(np.repeat(again, count) & worded)
    removed = np.add.reduceat(~keep, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    if not removed.any():
        return column, number, removed
    # every line but the first of a row owns the line feed before it; a row's first kept line gives its own up
    row = np.repeat(np.arange(len(count)), count)
    kept = np.flatnonzero(keep)
    leads = kept[np.diff(row[kept], prepend=-1) != 0]
    leads = leads[leads > first[row[leads]]]
    inner = np.arange(len(starts)) > first[row]
    edge = starts - inner
    mask = np.repeat(keep, np.diff(np.append(edge, len(body))))
    mask[starts[leads] - 1] = False
    total = np.concatenate([[0], np.cumsum(mask)])[offsets]
    out = pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(total.astype(np.int64).tobytes()), pa.py_buffer(body[mask].tobytes()))
    return pc.if_else(column.is_valid(), out.cast(column.type), pa.scalar(None, column.type)), number, removed


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix: str = "_", **options) -> DataFrame:
    """The documents with their repeated lines removed, and _lines, _removed counts added.

    `prefix` begins the added names; columns that have them already are replaced.

    Texts stay where they are while the table of documents that lose lines is within the
    broadcast bound.
    """
    gone = durable(repeated_lines(docs, text, doc_id, **options))
    size = gone.agg(F.sum(F.size("gone")).alias("n")).first()["n"] or 0
    keyed = _keyed(docs, text, doc_id).withColumn("__q_again", F.lit(False))
    twice = durable(keyed.where("__q_id IS NOT NULL").groupBy("__q_id", "__q_tie").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if not twice.isEmpty():
        # Rows that share doc_id and text are written with a number of their own, so that one and the same of them stays.
        twins = durable(keyed.join(sized(twice), ["__q_id", "__q_tie"], "left_semi").withColumn("__q_row", F.monotonically_increasing_id()))
        least = durable(twins.groupBy("__q_id", "__q_tie").agg(F.min("__q_row").alias("__q_least")))
        twins = twins.join(sized(least), ["__q_id", "__q_tie"]).withColumn("__q_again", F.col("__q_row") != F.col("__q_least"))
        keyed = keyed.join(sized(twice), ["__q_id", "__q_tie"], "left_anti").select(*keyed.columns).union(twins.select(*keyed.columns))
    gone = gone.select(F.col("id").alias("__q_id"), F.col("tie").alias("__q_tie"), F.col("gone").alias("__q_gone"))
    joined = keyed.join(sized(gone, gone.count(), size), ["__q_id", "__q_tie"], "left").drop("__q_id", "__q_tie")
    added = [prefix + "lines", prefix + "removed"]
    names = [c for c in docs.columns if c not in added]
    schema = StructType([*(docs.schema[c] for c in names), *(StructField(c, LongType()) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, 1 << 19):
            cleaned, lines, removed = without_lines(part, part.schema.get_field_index(text))
            columns = [cleaned if c == text else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines.astype(np.int64)), pa.array(removed)], names=[*names, *added])

    bound_batches(docs.sparkSession)
    return joined.select(*[F.col(f"`{c}`") for c in names], "__q_gone", "__q_again").mapInArrow(lean(run), schema)


#: DuckDB SQL of op9 over `documents`.
LINES_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS number FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, number, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM t),
i AS (SELECT *, row_number() OVER (ORDER BY doc_id, number) AS id FROM w WHERE len(w) > 0),
u AS (SELECT id, len(w) AS n, unnest(w) AS word FROM i),
b AS (SELECT id, n, word || '|' || row_number() OVER (PARTITION BY id, word) AS g FROM u),
f AS (SELECT g, count(*) AS df FROM b GROUP BY g),
p AS (
  SELECT id, n, g FROM (SELECT id, n, b.g, row_number() OVER (PARTITION BY id ORDER BY df, b.g) AS r FROM b JOIN f ON f.g = b.g)
  WHERE r <= n - (n * 80 + 99) // 100 + 1),
o AS (
  SELECT DISTINCT x.id AS x, y.id AS y FROM p x JOIN p y ON x.g = y.g AND x.id < y.id
  WHERE 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n),
l AS (SELECT id, n, list(g) AS gs FROM b GROUP BY id, n),
m AS (SELECT y AS id, len(list_intersect(lx.gs, ly.gs)) AS shared, lx.n + ly.n AS n FROM o JOIN l lx ON lx.id = x JOIN l ly ON ly.id = y),
g AS (SELECT DISTINCT id FROM m WHERE 100 * shared >= 80 * (n - shared)),
k AS (
  SELECT t.doc_id, t.number, t.line, g.id IS NOT NULL AS gone
  FROM t LEFT JOIN i ON i.doc_id = t.doc_id AND i.number = t.number LEFT JOIN g ON g.id = i.id),
r AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (WHERE NOT gone), '') AS text
  FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n_lines, 0)::BIGINT AS n_lines, coalesce(r.n_removed, 0)::BIGINT AS n_removed, r.text
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""
