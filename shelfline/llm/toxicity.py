"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled texts by the likelihood ratio of their document counts.
Every text is then described by some dozen numbers: how dense lexicon entries stand, how strong they are, how many are
near a second-person word, capitals, punctuation and obfuscated spellings. Boosted trees are fitted on a bounded sample
of labelled rows, a part of which is left out to calibrate their output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import textvec
from .registry import query, table

#: Bounds of what the fit uses: labelled rows (about; chosen by hash) and lexicon entries.
SAMPLE_ROWS, LEXICON_SIZE = 20_000, 4_000
#: Word beginnings that may become lexicon entries, and the evidence an entry needs: texts, likelihood ratio, rate ratio.
BEGINNINGS, LEAST_TEXTS, LEAST_EVIDENCE, LEAST_RATIO = (4, 5, 6), 3, 12.0, 3.0
#: Words that address the reader, in the languages of the corpus, and how near they count (words).
SECOND_PERSON = frozenset("""you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta
tes vous votre vos tú ti tus usted ustedes vosotros os""".split())
NEAR = 4
#: Look-alikes that stand for letters in obfuscated spellings.
LOOKALIKES = str.maketrans("0134578@$!|+", "oieastbasiit")
ROUNDS, DEPTH, STEP, SEED = 30, 3, 0.2, 7
#: Bytes of text that are described at once.
DESCRIBED = 2_000_000
FEATURES = ["hits", "density", "strongest", "total", "beginnings", "near_second", "second_density", "capitals",
            "marks", "symbols", "obfuscated", "obfuscated_hits", "length"]


def core(word: str) -> str:
    """The word in lower case without what is not a letter at its ends."""
    low = word.lower()
    a, b = 0, len(low)
    while a < b and not low[a].isalpha():
        a += 1
    while b > a and not low[b - 1].isalpha():
        b -= 1
    return low[a:b]


def unmasked(word: str) -> str:
    """Letters of an obfuscated spelling, "" for a plain word: digits or signs stand between its letters."""
    low = word.lower().strip(".,;:!?\"'()[]{}|")
    if low.isalpha() or not any(c.isalpha() for c in low) or "@" in low.strip("@") and "." in low:
        return ""
    bare = low.translate(LOOKALIKES)
    return "".join(c for c in bare if c.isalpha()) if any(not c.isalpha() and c not in "'-’" for c in low) else ""


def entries(word: str) -> list[str]:
    """Lexicon keys of a core word."""
    return ["=" + word, *[f"^{word[:k]}" for k in BEGINNINGS if len(word) >= k]] if word else []


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a piece that hold each lexicon key, by label."""
    for piece in textvec.pieces(batches):
        offsets, flat = textvec.words(piece.column("text"))
        codes, distinct = textvec.coded(flat)
        rows = np.repeat(np.arange(piece.num_rows), np.diff(offsets))
        label = piece.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        cores = [core(w) for w in textvec.strings(distinct)]
        for keys in ([("=" + c if c else "") for c in cores], *[[("^" + c[:k] if len(c) >= k else "") for c in cores] for k in BEGINNINGS]):
            key_codes, names = textvec.coded(pa.array(keys, pa.string()))
            if not len(names):
                continue
            pairs = np.unique(rows * len(names) + key_codes[codes])
            texts, key = pairs // len(names), pairs % len(names)
            n = np.bincount(key, minlength=len(names))
            toxic = np.bincount(key, weights=label[texts], minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([names, pa.array(toxic), pa.array(n - toxic)], ["entry", "toxic", "clean"])


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Log rate ratio of the lexicon keys with most evidence for the label; ``rows`` has ``text`` and ``toxic``."""
    totals = rows.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    t, c = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)
    if not t or not c:
        return {}
    counts = rows.select("text", "toxic").mapInArrow(_count_entries, "entry string, toxic long, clean long").where("entry != ''") \
        .groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    share = F.lit(t / (t + c))
    both = F.col("a") + F.col("b")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    evidence = 2 * (term(F.col("a"), both * share) + term(F.col("b"), both * (1 - share)))
    ratio = ((F.col("a") + 0.5) / (t + 1)) / ((F.col("b") + 0.5) / (c + 1))
    best = counts.select("entry", "a", evidence.alias("evidence"), ratio.alias("ratio")).where(
        (F.col("a") >= LEAST_TEXTS) & (F.col("evidence") >= LEAST_EVIDENCE) & (F.col("ratio") >= LEAST_RATIO)) \
        .orderBy(F.desc("evidence"), "entry").limit(size)
    return {r["entry"]: float(np.log(r["ratio"])) for r in best.collect()}


def _describe(lexicon: dict[str, float], carried: list[str]):
    def weigh(word: str) -> tuple[float, bool]:
        """Weight of a core word, and whether only a beginning of it is known."""
        if "=" + word in lexicon:
            return lexicon["=" + word], False
        return max((lexicon.get(k, 0.0) for k in entries(word)[1:]), default=0.0), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textvec.pieces(batches, most=DESCRIBED):
            offsets, flat = textvec.words(piece.column("text"))
            codes, distinct = textvec.coded(flat)
            table_ = np.zeros((len(distinct), 9))
            for i, word in enumerate(textvec.strings(distinct)):
                plain = core(word)
                weight, beginning = weigh(plain) if plain else (0.0, False)
                row = table_[i]
                row[0], row[1] = weight, weight > 0 and beginning
                row[2] = plain in SECOND_PERSON
                row[7] = len(word)
                if not (word.isalpha() and word.islower()):
                    row[3] = sum(map(str.isupper, word))
                    row[4] = sum(word.count(m) for m in "!?")
                    row[5] = sum(word.count(m) for m in "#*$%&|<>@_")
                    hidden = unmasked(word)
                    if hidden:
                        row[6] = 1
                        found = weigh(hidden)[0]
                        row[8] = found
                        row[0] = max(row[0], found)
            n = np.diff(offsets)
            safe = np.maximum(n, 1)
            rows = np.repeat(np.arange(piece.num_rows), n)
            column = lambda k: table_[codes, k]
            total = lambda values: np.bincount(rows, weights=values, minlength=piece.num_rows)
            weights = column(0)
            hit = weights > 0
            second = np.concatenate(([0], np.cumsum(column(2))))
            at = np.arange(len(flat))
            low, high = np.maximum(at - NEAR, offsets[:-1][rows]), np.minimum(at + NEAR + 1, offsets[1:][rows])
            strongest = np.zeros(piece.num_rows)
            np.maximum.at(strongest, rows[hit], weights[hit])
            hits, chars = total(hit), np.maximum(total(column(7)), 1)
            values = [hits, hits / safe, strongest, total(weights), total(column(1)), total(hit & (second[high] > second[low])),
                      total(column(2)) / safe, total(column(3)) / chars, total(column(4)) / safe, total(column(5)) / safe,
                      total(column(6)) / safe, total(column(8) > 0), np.log1p(n)]
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in carried], *[pa.array(np.asarray(v, np.float64)) for v in values]],
                                             [*carried, *FEATURES])

    return run


def describe(rows: DataFrame, lexicon: dict[str, float], carried: list[str]) -> DataFrame:
    """The carried columns and the features of ``text``."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in carried], *[f"{f} double" for f in FEATURES]])
    return rows.select(*dict.fromkeys([*carried, "text"])).mapInArrow(_describe(lexicon, carried), schema)


class ToxicityModel:
    """Lexicon, trees and calibration; without both labels in the sample every score is the share of label 1."""

    def __init__(self, lexicon: dict[str, float], trees, isotonic, share: float):
        self.lexicon, self.trees, self.isotonic, self.share = lexicon, trees, isotonic, share

    def score(self, rows: DataFrame, carried: list[str]) -> DataFrame:
        """The carried columns and ``score`` for ``rows`` with a column ``text``."""
        if self.trees is None:
            return rows.select(*carried, F.lit(float(self.share)).alias("score"))
        raw = _raw(self.trees, describe(rows, self.lexicon, carried))
        # a little of the raw output orders texts that calibration makes equal
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("calibrated") + 0.01 * F.col("raw")))
        return self.isotonic.transform(raw).select(*carried, score.alias("score"))


def _vectors(described: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described)


def _raw(trees, described: DataFrame) -> DataFrame:
    found = trees.transform(_vectors(described))
    return found.withColumn("raw", vector_to_array("probability")[1])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, depth: int = DEPTH) -> ToxicityModel:
    """Fit on rows with ``text`` and ``toxic`` (0 or 1); at most about ``sample_rows`` of them, chosen by hash of the text.

    Equal texts with equal labels count once. Rows without label are left out; a null text is empty.
    """
    rows = labelled.where(F.col("toxic").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("long").alias("toxic"))
    n = rows.count()
    key = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    chosen = rows.where(key < int((1 << 40) * min(1.0, sample_rows / max(n, 1)))).dropDuplicates(["text", "toxic"])
    chosen = cut_lineage(chosen, "toxicity-sample")
    totals = chosen.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    share = (totals["t"] or 0) / totals["n"] if totals["n"] else 0.0
    lexicon = learn_lexicon(chosen)
    if not 0 < share < 1:
        return ToxicityModel(lexicon, None, None, share)
    described = describe(chosen.withColumn("part", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(4)).cast("int")), lexicon, ["toxic", "part"])
    described = cut_lineage(described.coalesce(4), "toxicity-features")
    grown = described.where("part != 0")
    if grown.select("toxic").distinct().count() < 2:
        return ToxicityModel(lexicon, None, None, share)
    trees = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=rounds, maxDepth=depth, stepSize=STEP, seed=SEED).fit(
        _vectors(grown))
    held = _raw(trees, described.where("part = 0")).select("raw", F.col("toxic").cast("double").alias("toxic"))
    held = held if not held.isEmpty() else _raw(trees, grown).select("raw", F.col("toxic").cast("double").alias("toxic"))
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="calibrated").fit(held)
    return ToxicityModel(lexicon, trees, isotonic, share)


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """Labelled texts of the documents for which ``learn`` (over doc_id) holds; a repeated label counts once."""
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.where(learn).select("doc_id", "text").join(given, "doc_id").select("text", "toxic")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Labels of held-out rows are not read. A null or empty text has a score like any other. Repeated rows are scored
    alike; without labels of both kinds the score is the share of label 1 (0 without any); an empty table gives no rows;
    other columns stay aside.
    """
    model = fit(training_rows(docs, labels, ~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return model.score(rows, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows and columns of ``docs`` whose score stays below the threshold; learned as in ``toxicity``."""
    model = fit(training_rows(docs, labels, ~held_out()))
    # the text comes by once, beside the other columns
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "text") if others else docs.select(F.lit(0).alias("row"), "text")
    kept = model.score(rows, ["row", "text"]).where(F.col("score") < threshold)
    return kept.select(*["text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


@query("op8_boosted_toxicity")
def op8_boosted_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
