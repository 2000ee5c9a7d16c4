"""Substring deduplication with difference-cover anchors.

Words at the places of a difference cover modulo a period are anchors: for any two places of two texts there is a
shift below the period that brings both onto anchors. A window of ``span`` words that occurs in two documents thus holds
an anchor window of ``span - period + 1`` words, at the same distance from its start, in both. Only anchor windows are
hashed and shuffled (6 of 31 places); around those that occur in two documents, whole windows are hashed and the
smallest document of each is found.

Whatever is decided inside one piece of an Arrow batch does not travel: of a hash that several documents of a piece
share, one row goes to the shuffle and the others are already known to be shared. A passage that a third of all
documents hold therefore sends one row a piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from . import textvec
from .registry import query, table

#: A perfect difference set: every number modulo 31 but 0 is a difference of two members in exactly one way.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
SPAN = 50

def is_cover(period: int, cover: tuple[int, ...]) -> bool:
    """Whether every difference modulo the period occurs."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, flat = textvec.words(texts)
    codes, distinct = textvec.coded(flat)
    return offsets, textvec.hashes(distinct)[codes]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row the number of words, the digest of its words joined by one space, and the digest of the text."""
    for piece in textvec.pieces(batches):
        offsets, flat = textvec.words(piece.column("text"))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat), " ")
        digest = [hashlib.sha256(t.as_buffer()).hexdigest() for t in joined]
        copy = [hashlib.sha256(t.as_buffer()).digest() for t in piece.column("text")]
        yield pa.RecordBatch.from_arrays(
            [piece.column("id"), piece.column("tag"), pa.array(np.diff(offsets)), pa.array(digest), pa.array(copy, pa.binary())],
            ["id", "tag", "n_words", "words_sha256", "copy"])


def _first_of_each(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by hash and id, whether a row starts a hash, whether the hash has rows of several ids)."""
    order = np.lexsort((ids, hashes))
    h, d = hashes[order], ids[order]
    starts = np.ones(len(h), bool)
    starts[1:] = h[1:] != h[:-1]
    group = np.cumsum(starts) - 1
    first = np.flatnonzero(starts)
    last = np.append(first[1:], len(h)) - 1
    return order, starts, (d[first] < d[last])[group] if len(h) else starts


def _anchors(span: int, period: int, cover: tuple[int, ...], known: bool):
    """``known``: (id, place) of anchors that two documents of the piece share; else one row for each hash of a piece,
    with an empty place if its places are known already."""
    width = span - period + 1
    member = np.zeros(period, bool)
    member[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textvec.pieces(batches):
            offsets, codes = _word_hashes(piece.column("text"))
            grams = textvec.window_hashes(codes, width)
            starts, rows = textvec.inside(offsets, width, len(codes))
            places = starts - offsets[:-1][rows]
            take = member[places % period] & (np.diff(offsets) >= span)[rows]
            ids = piece.column("id").to_numpy(zero_copy_only=False)[rows[take]]
            hashes, places = grams[starts[take]], places[take]
            order, heads, shared = _first_of_each(hashes, ids)
            if known:
                keep = order[shared]
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(places[keep].astype(np.int32))],
                                                 ["id", "place"])
            else:
                # a hash that one document repeats keeps all its places
                send = heads | ~shared
                keep = order[send]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[keep], pa.int64()), pa.array(hashes[keep].view(np.int64)),
                     pa.array(places[keep].astype(np.int32), mask=shared[send])], ["id", "hash", "place"])

    return run


def _windows(span: int, period: int):
    """Windows around shared anchors: they start at most ``period - 1`` words before one.

    ``known``: a smaller document of the same piece has the window. One row a hash and piece is left to compare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textvec.pieces(batches):
            offsets, codes = _word_hashes(piece.column("text"))
            grams = textvec.window_hashes(codes, span)
            n = np.diff(offsets)
            listed = piece.column("places")
            rows = np.repeat(np.arange(piece.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
            anchors = listed.flatten().to_numpy().astype(np.int64)
            low, high = np.maximum(anchors - (period - 1), 0), np.minimum(anchors, n[rows] - span)
            fits = high >= low
            near = np.zeros(len(codes) + 2, np.int64)
            np.add.at(near, (offsets[:-1][rows] + low)[fits], 1)
            np.add.at(near, (offsets[:-1][rows] + high + 1)[fits], -1)
            starts = np.flatnonzero(np.cumsum(near) > 0)
            rows = np.searchsorted(offsets, starts, side="right") - 1
            ids = piece.column("id").to_numpy(zero_copy_only=False)[rows]
            tags = piece.column("tag").to_numpy(zero_copy_only=False)[rows]
            hashes = grams[starts]
            order, heads, _ = _first_of_each(hashes, ids)
            least = ids[order][np.flatnonzero(heads)][np.cumsum(heads) - 1] if len(order) else ids
            known = ids[order] > least
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[order], pa.int64()), pa.array(tags[order], pa.int64()), pa.array(hashes[order].view(np.int64)),
                 pa.array((starts - offsets[:-1][rows])[order].astype(np.int32)), pa.array(known)],
                ["id", "tag", "hash", "place", "known"])

    return run


def _strip(span: int):
    """Texts without the words of the removed windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textvec.pieces(batches):
            offsets, flat = textvec.words(piece.column("text"))
            listed = piece.column("starts")
            rows = np.repeat(np.arange(piece.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
            starts = offsets[:-1][rows] + listed.flatten().to_numpy().astype(np.int64)
            cover = np.zeros(len(flat) + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + span, -1)
            keep = np.cumsum(cover)[:-1] == 0
            left = np.concatenate(([0], np.cumsum(keep)))[offsets]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), flat.filter(pa.array(keep))), " ")
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("tag"), pa.array(np.diff(offsets) - np.diff(left)), texts],
                ["id", "tag", "n_removed", "kept_text"])

    return run


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", span: int = SPAN, period: int = PERIOD,
          cover: tuple[int, ...] = COVER) -> tuple[DataFrame, DataFrame]:
    """(every row, rows that lose words).

    Every row: ``id``, ``tag`` (hash of the text), ``n_words``, ``words_sha256``, ``whole`` (an equal text of at least
    ``span`` words stands under a smaller id, so every word goes). Rows that lose words, but for whole ones: ``id``,
    ``tag``, ``n_removed``, ``kept_text``.
    """
    if not is_cover(period, cover) or period > span:
        raise ValueError("the cover must hold every difference modulo a period of at most the span")
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    summary = cut_lineage(rows.mapInArrow(
        _summaries, "id long, tag long, n_words long, words_sha256 string, copy binary"), "summary")
    firsts = summary.where("id is not null").groupBy("copy").agg(F.min("id").alias("first"))
    summary = cut_lineage(summary.join(firsts, "copy", "left").withColumn("whole", F.coalesce(
        (F.col("first") < F.col("id")) & (F.col("n_words") >= span), F.lit(False))).drop("copy", "first"), "rows")

    texts = rows.where("id is not null")
    sent = texts.select("id", "text").mapInArrow(_anchors(span, period, cover, False), "id long, hash long, place int")
    same = Window.partitionBy("hash")  # a row for each piece that has the hash, not for each document
    met = sent.withColumns({"low": F.min("id").over(same), "high": F.max("id").over(same), "n": F.count(F.lit(1)).over(same)})
    # where a piece has sent one row for many, that row's hash is shared already
    places = met.where("low < high and place is not null").select("id", "place").union(
        texts.select("id", "text").mapInArrow(_anchors(span, period, cover, True), "id long, place int"))
    listed = cut_lineage(places.groupBy("id").agg(F.collect_list("place").alias("places")), "places")
    whole = summary.where("whole").select("id", "tag")
    near = cut_lineage(texts.join(listed, "id").join(whole, ["id", "tag"], "left_anti"), "near")

    windows = cut_lineage(near.mapInArrow(_windows(span, period), "id long, tag long, hash long, place int, known boolean"),
                          "windows")
    later = windows.where("not known").withColumn("first", F.min("id").over(same)).where("first < id")
    gone = windows.where("known").select("id", "tag", "place").union(later.select("id", "tag", "place"))
    starts = gone.groupBy("id", "tag").agg(F.collect_set("place").alias("starts"))
    stripped = near.select("id", "tag", "text").join(starts, ["id", "tag"]).mapInArrow(
        _strip(span), "id long, tag long, n_removed long, kept_text string")
    return summary, stripped


def span_digests(docs: DataFrame, id_column: str = "doc_id", **method) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_removed``, ``kept_sha256`` (kept words joined by one space).

    Equal texts are judged once: all but the copy with the smallest id lose every word if they have ``span`` words or
    more. Null or empty texts have no words. Rows that share an id do not remove each other's words; rows that repeat id
    and text get the same answer. A row with a null id keeps all words and removes none. Empty tables give no rows; other
    columns stay aside.
    """
    summary, stripped = spans(docs, id_column, **method)
    found = stripped.select("id", "tag", "n_removed", F.sha2("kept_text", 256).alias("kept")).dropDuplicates(["id", "tag"])
    gone = F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return summary.join(found, ["id", "tag"], "left").select(
        F.col("id").alias(id_column), "n_words", gone.cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "words_sha256")).alias("kept_sha256"))


def deduplicate_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **method) -> DataFrame:
    """The input rows and columns with repeated spans cut out of the texts; a text that loses nothing stays as it is.

    A text that loses words becomes its kept words joined by one space, possibly empty. Cases as in ``span_digests``.
    """
    summary, stripped = spans(docs, id_column, text_column, **method)
    changed = stripped.dropDuplicates(["id", "tag"]).select("id", "tag", F.col("kept_text").alias("new")).union(
        summary.where("whole").select("id", "tag", F.lit("").alias("new")).distinct())
    changed = changed.withColumnsRenamed({"id": "_id", "tag": "_tag", "new": "_new"})
    found = docs.join(changed, (F.col(id_column).cast("long") == F.col("_id"))
                      & (F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))) == F.col("_tag")), "left")
    return found.withColumn(text_column, F.coalesce("_new", F.col(text_column))).select(*docs.columns)


SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS MATERIALIZED (SELECT h, min(doc_id) AS f FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS MATERIALIZED (SELECT doc_id, list(DISTINCT p) AS ps, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE f < doc_id) GROUP BY 1),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d SEMI JOIN gone USING (doc_id)) a
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(ps) AS p FROM gone) g WHERE g.doc_id = a.doc_id AND g.p = a.p)
  GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op9_cover_substring_dedup", SQL)
def op9_cover_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return span_digests(table(spark, folder, "documents"))
