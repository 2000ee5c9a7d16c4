"""Benchmark decontamination by winnowing.

A window of ``span`` words is shared by a document and an item only if both keep a common fingerprint: of every
``span - gram + 1`` neighbouring k-gram hashes the smallest is kept, together with its place. Kept hashes of documents
and items are joined; each meeting fixes how the item lies on the document, and the words are compared along it.
Only column expressions: no Python in tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .registry import query, table
from .wordcols import doubled, hash_each, lower_ascii, split_words, text_or_empty

#: What stands between words: ASCII characters other than digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, GRAM = 13, 6
#: Low bits of a kept value hold the place of the k-gram; candidates are compared word by word, so a shorter hash is no loss.
PLACE_BITS = 26


def words_of(name: str) -> Column:
    return split_words(lower_ascii(text_or_empty(name)), BETWEEN)


def placed(grams: Column) -> Column:
    """Hash in the high bits, place in the low bits: the order is that of the hash, then the place."""
    mask = (1 << PLACE_BITS) - 1
    return F.transform(grams, lambda g, i: g.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))


def fingerprints(words: DataFrame, gram: int, window: int, keep: list[str]) -> DataFrame:
    """Rows of ``keep`` with ``print`` and ``place`` for each kept k-gram of the column ``words``."""
    grams = words.select(*keep, hash_each(F.col("words")).alias("grams"))
    grams = doubled(grams, "grams", gram, lambda a, b: F.xxhash64(a, b))
    minima = doubled(grams.withColumn("grams", placed(F.col("grams"))), "grams", window, lambda a, b: F.least(a, b))
    kept = minima.select(*keep, F.explode(F.array_distinct("grams")).alias("value"))
    return kept.select(*keep, F.shiftright("value", PLACE_BITS).alias("print"),
                       F.col("value").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place"))


def shared_spans(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, id_column: str = "doc_id",
                 text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text",
                 ) -> tuple[DataFrame, DataFrame]:
    """All documents as word rows, and every place where a window of an item occurs in one.

    Returns ``(words, hits)``: ``words`` has one row per input row with ``id``, ``row_key``, ``words``; ``hits`` has
    ``id``, ``row_key``, ``item``, ``shift`` (document place of the item's first word, may be negative), ``span`` and
    ``starts`` (document places where a window of the item starts). An item of fewer than ``span`` words is one window
    and is looked for by a fingerprint of its own length with every k-gram kept.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    words = rows.select("id", F.xxhash64("id", "text").alias("row_key"), words_of("text").alias("words"))
    wanted = items.where(F.col(item_column).isNotNull()).select(
        F.col(item_column).alias("item"), words_of(item_text_column).alias("item_words")).where("size(item_words) > 0")
    wanted = cut_lineage(wanted.dropDuplicates(["item", "item_words"]).withColumn(
        "span", F.least(F.size("item_words"), F.lit(span))), "items")
    lengths = [r[0] for r in wanted.select("span").distinct().collect()]  # at most ``span`` different values
    meetings = None
    for length in sorted(lengths):
        own_gram = min(gram, length) if length == span else length
        left = fingerprints(words, own_gram, length - own_gram + 1, ["id", "row_key"])
        right = fingerprints(wanted.where(F.col("span") == length).withColumnRenamed("item_words", "words")
                             .select("item", "words", F.xxhash64("words").alias("item_key")),
                             own_gram, length - own_gram + 1, ["item", "item_key"]).withColumnRenamed("place", "item_place")
        met = left.join(right, "print").select("id", "row_key", "item", "item_key",
                                               (F.col("place") - F.col("item_place")).alias("shift"))
        meetings = met if meetings is None else meetings.union(met)
    if meetings is None:
        empty = words.limit(0).select("id", "row_key", F.lit(None).cast(dict(items.dtypes)[item_column]).alias("item"),
                                      F.lit(0).alias("shift"), F.lit(0).alias("span"),
                                      F.array().cast("array<int>").alias("starts"))
        return words, empty
    meetings = cut_lineage(meetings.distinct(), "meetings")
    laid = meetings.join(wanted.withColumn("item_key", F.xxhash64("item_words")), ["item", "item_key"])
    keys = meetings.select(F.col("id").alias("met_id"), F.col("row_key").alias("met_key")).distinct()
    touched = words.join(keys, (F.col("row_key") == F.col("met_key")) & F.col("id").eqNullSafe(F.col("met_id")), "left_semi")
    touched = touched.dropDuplicates(["id", "row_key"])
    both = laid.alias("l").join(touched.alias("r"), (F.col("l.row_key") == F.col("r.row_key")) & F.col("l.id").eqNullSafe(F.col("r.id")))
    starts = F.expr("""
        filter(sequence(greatest(0, -l.shift), greatest(size(item_words) - span, greatest(0, -l.shift))),
               j -> j <= size(item_words) - span
                    AND slice(r.words, l.shift + j + 1, span) = slice(item_words, j + 1, span))""")
    hits = both.select(F.col("l.id").alias("id"), F.col("l.row_key").alias("row_key"), "item", "shift", "span",
                       F.transform(starts, lambda j: j + F.col("shift")).alias("starts"))
    return words, hits.where(F.size("starts") > 0)


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  item_column: str = "item_id", item_text_column: str = "text", percent: int = 5, **method) -> DataFrame:
    """Per row of ``docs``: how much of it lies in windows of benchmark items.

    Columns: the id, ``n_words``, ``n_hit`` (words inside a shared window), ``n_items``, ``items_sha256``,
    ``contaminated`` (some word is hit, and at least ``percent`` in a hundred are).

    A null or empty text has no words. Items without id or words match nothing; repeated items count once. Rows that
    repeat id and text each get the same answer. Empty tables give no rows, or clean rows. Other columns stay aside.
    """
    words, hits = shared_spans(docs, items, id_column=id_column, text_column=text_column, item_column=item_column,
                               item_text_column=item_text_column, **method)
    hits = cut_lineage(hits, "hits")
    covered = hits.select("id", "row_key", F.explode(F.expr(
        "array_distinct(flatten(transform(starts, s -> sequence(s, s + span - 1))))")).alias("place"))
    n_hit = covered.distinct().groupBy("id", "row_key").agg(F.count(F.lit(1)).alias("n_hit"))
    found = hits.select("id", "row_key", F.col("item").cast("string").alias("item")).distinct()
    n_items = found.groupBy("id", "row_key").agg(
        F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    counts = words.select("id", "row_key", F.size("words").cast("long").alias("n_words"))
    n_hit = n_hit.withColumnsRenamed({"id": "hit_id", "row_key": "hit_key"})
    n_items = n_items.withColumnsRenamed({"id": "item_of", "row_key": "items_key"})
    joined = counts.join(n_hit, (F.col("row_key") == F.col("hit_key")) & F.col("id").eqNullSafe(F.col("hit_id")), "left").join(
        n_items, (F.col("row_key") == F.col("items_key")) & F.col("id").eqNullSafe(F.col("item_of")), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        F.col("id").alias(id_column), "n_words", hit.cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((hit > 0) & (100 * hit >= percent * F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      item_column: str = "item_id", item_text_column: str = "text", percent: int = 5, **method) -> DataFrame:
    """The rows and columns of ``docs`` that are not contaminated; cases as in ``decontaminate``."""
    words, hits = shared_spans(docs, items, id_column=id_column, text_column=text_column, item_column=item_column,
                               item_text_column=item_text_column, **method)
    covered = hits.select("id", "row_key", F.explode(F.expr(
        "array_distinct(flatten(transform(starts, s -> sequence(s, s + span - 1))))")).alias("place")).distinct()
    n_hit = covered.groupBy("id", "row_key").agg(F.count(F.lit(1)).alias("n_hit"))
    counts = words.select(F.col("row_key").alias("_key"), F.col("id").alias("_id"), F.size("words").alias("n_words")).distinct()
    bad = n_hit.join(counts, (F.col("row_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))).where(
        100 * F.col("n_hit") >= percent * F.col("n_words")).select("_key", "_id")
    key = F.xxhash64(F.col(id_column), text_or_empty(text_column))
    return docs.join(cut_lineage(bad, "contaminated"), (key == F.col("_key")) & F.col(id_column).eqNullSafe(F.col("_id")), "left_anti")


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: w[i:i + least(13, len(w)) - 1])) AS win
  FROM b WHERE len(w) > 0),
dw AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM (
    SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""


@query("op4_winnowing_decontamination", SQL)
def op4_winnowing_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
