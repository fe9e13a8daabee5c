"""N-gram Jaccard join of documents: rare-first prefix filtering over word shingles.

Documents are sets of 5-word shingles, lower-cased in A-Z; a shorter text is one
shingle.  Two documents link when their Jaccard similarity reaches the threshold
(compared in integers).  Equal sets are one class, so copies are never expanded into
pairs; links between classes are found by `setjoin`.

Null and empty texts have the empty set: no links, a component of their own.  Rows with
a null doc_id link with nothing.  doc_id should be unique; rows that share one share
its component.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import setjoin
from quire.llm.common import durable, sized
from quire.llm.text import LOWER, SPACED, shingles


def document_sets(k: int) -> setjoin.Extract:
    def extract(body: np.ndarray, offsets: np.ndarray):
        tokens, rows, _ = shingles(LOWER[body], offsets, SPACED, k)
        n = len(offsets) - 1
        return tokens, rows, np.arange(n), np.zeros(n, np.int64)

    return extract


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_similar, component_id, class_id, n_copies.

    class_id is the least doc_id with the same set, n_copies the size of that class.
    """
    items = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = items.where("id IS NOT NULL")
    extract = document_sets(k)
    seen = durable(setjoin.profile(known, extract, num, den))
    classes = durable(setjoin.classes_of(seen.where("alive")))
    pairs = setjoin.links(known, classes, extract, num, den)
    name = classes.select("e", "s2", "n", F.col("first.id").alias("id"), "copies")
    both = pairs.union(pairs.select("y", "x")).toDF("e", "other")
    similar = both.join(classes.select(F.col("e").alias("other"), "copies"), "other").groupBy("e").agg(F.sum("copies").alias("others"))
    edges = pairs.join(name.select(F.col("e").alias("x"), F.col("id").alias("a")), "x").join(name.select(F.col("e").alias("y"), F.col("id").alias("b")), "y").select("a", "b")
    root = setjoin.components(edges)
    about = name.join(similar, "e", "left").join(root, F.col("id") == F.col("node"), "left")
    about = durable(about.select("e", F.col("s2").alias("_s2"), F.col("n").alias("_n"), F.col("id").alias("class_id"), "copies", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "id").alias("root")))
    same = (F.col("s1") == F.col("e")) & (F.col("s2") == F.col("_s2")) & (F.col("n") == F.col("_n"))
    found = seen.join(sized(about), same & F.col("alive"), "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce(F.col("copies") - 1 + F.col("others"), F.lit(0)).cast("long").alias("n_similar"),
        F.coalesce("root", "id").alias("component_id"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )
    lost = items.where("id IS NULL")
    blank = F.lit(None).cast("long")
    number = F.size(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - k)), lambda i: F.array_join(F.slice("w", i + 1, k), " "))))
    words = lost.withColumn("w", F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    return found.union(words.select(blank, F.when(F.size("w") == 0, 0).otherwise(number).cast("long"), F.lit(0).cast("long"), blank, blank, F.lit(1).cast("long")))


def distinct_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents without near duplicates: of each component the least doc_id stays.

    Of rows that share doc_id and set one stays, that of the least text.
    """
    found = near_duplicates(docs, text, doc_id, **options)
    gone = durable(found.where("component_id != doc_id").select(F.col("doc_id").alias("__q_gone")).distinct())
    twice = durable(found.where("component_id = doc_id").groupBy(F.col("doc_id").alias("__q_twice")).agg(F.count("*").alias("n")).where("n > 1").select("__q_twice"))
    kept = docs.join(sized(gone), F.col(doc_id) == F.col("__q_gone"), "left_anti")
    if twice.isEmpty():
        return kept
    k = options.get("k", 5)
    same = F.col(doc_id).cast("long") == F.col("__q_twice")
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    grams = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("__q_words") - k)), lambda i: F.array_join(F.slice("__q_words", i + 1, k), " "))))
    repeated = kept.join(sized(twice), same, "left_semi").select(F.col(doc_id).cast("long").alias("__q_id"), F.coalesce(F.col(text), F.lit("")).alias("__q_text"), words.alias("__q_words"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__q_row"))
    one = repeated.groupBy("__q_id", F.sha2(F.array_join(grams, "\n"), 256)).agg(F.min_by("__q_row", "__q_text").alias("__q_row")).select("__q_row.*")
    return kept.join(sized(twice), same, "left_anti").union(one)


#: DuckDB SQL of near_duplicates() over `documents`.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
q AS (SELECT list_sort(list(g)) AS gs, doc_id FROM s GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS class_id, count(*) OVER (PARTITION BY gs) AS n_copies FROM q)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT count(*) FROM l WHERE l.x = d.doc_id)::BIGINT AS n_similar,
       c.component_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(k.n_copies, 1)::BIGINT AS n_copies
FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
