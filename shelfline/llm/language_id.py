"""Language identification by compression.

For each language a raw-content dictionary is made of plain training text. A text is compressed with each
dictionary, in chunks that are short against it, and the language with the fewest bytes wins. A longer dictionary is no
advantage: two languages are compared with as many bytes as the shorter dictionary has. Narrow margins between the best
two are reported as rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec
from .registry import query, table

#: Bounds of the training sample: texts and bytes of each language, and languages (by number of training texts).
SAMPLE_TEXTS, EXCERPT_CHARS, DICTIONARY_BYTES, LANGUAGES = 800, 400, 200_000, 200
CHUNK_BYTES, LEVEL = 500, 3
#: Bytes in a hundred between the best two below which a verdict counts as rejected.
MARGIN = 0.02
UNKNOWN = "und"
#: Stands before a dictionary that is shorter than the longest; no plain text holds it.
FILL = b"\0"
#: Shortened dictionaries that are kept for the next text.
KEPT = 64
MARKS, SPACES = re.compile(r"[^\w\s]+"), re.compile(r"\s+")


def plain(text: str) -> str:
    """Lower case, no punctuation, single spaces: what is left tells languages apart."""
    return SPACES.sub(" ", MARKS.sub("", text.lower()).replace("\0", ""))


def dictionaries(training: DataFrame, lang: str = "lang", text: str = "text", texts: int = SAMPLE_TEXTS,
                 excerpt: int = EXCERPT_CHARS, most: int = DICTIONARY_BYTES, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Raw-content dictionaries: per language the same texts each time, those with the lowest hashes.

    The sample is bounded by ``texts`` excerpts for each of at most ``languages`` languages; rows without language or
    text are left out. Equal texts count once in the sample. Hashes that are too high for the sample, going by the
    number of different texts of the language, are dropped where they are read: what is ranked does not grow with the
    corpus. Each dictionary holds what its own language has, up to ``most`` bytes, and is filled up in front with zero
    bytes to the length of the longest; a language whose texts leave nothing has none.
    """
    rows = training.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("order"), F.col(text).alias("text"))
    common = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("order").alias("different")).orderBy(
        F.desc("n"), "lang").limit(languages).select("lang", "different")
    share = F.col("order").cast("double") / 2.0**64 + 0.5
    # an excerpt from the middle, away from headings; short texts are taken whole
    start = F.greatest(F.lit(1), F.floor((F.length("text") - excerpt) / 2).cast("int"))
    rows = rows.join(common, "lang").where(share * F.col("different") <= 2.0 * texts).select(
        "lang", "order", F.substring(F.col("text"), start, F.lit(excerpt)).alias("text")).dropDuplicates()
    first = Window.partitionBy("lang").orderBy("order", "text")
    chosen = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= texts)
    found: dict[str, list[str]] = {}
    for row in chosen.select("lang", "order", "text").orderBy("lang", "order", "text").collect():
        found.setdefault(row["lang"], []).append(row["text"])
    joined = {k: "\n".join(map(plain, v)).encode()[-most:] for k, v in found.items()}
    size = max(map(len, joined.values()), default=0)
    return {k: v.rjust(size, FILL) for k, v in sorted(joined.items()) if v.strip()}


class Compressors:
    def __init__(self, contents: dict[str, bytes], margin: float = MARGIN, level: int = LEVEL):
        self.langs, self.margin, self.level = list(contents), margin, level
        self.each = [content.lstrip(FILL) for content in contents.values()]
        self.lengths = [len(content) for content in self.each]
        #: Longest dictionaries first, then by name.
        self.order = sorted(range(len(self.each)), key=lambda i: (-self.lengths[i], i))
        self.whole = [self._coder(content) for content in self.each]
        self.cut = lru_cache(KEPT)(lambda i, length: self._coder(self.each[i][-length:]))

    def _coder(self, content: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=self.level)
        return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_dict_id=False)

    def compare(self, text: str) -> tuple[int, np.ndarray]:
        """The best language and the compressed bytes of the text by language, no dictionary longer than that of the best.

        From the longest dictionary to the shortest, a language takes the lead if it needs fewer bytes than the leader
        with as many bytes of dictionary. Where it has much less than the leader, both say little at that length, and it
        has to lead by up to ``margin``.
        """
        data = plain(text).encode()
        chunks = [data[at: at + CHUNK_BYTES] for at in range(0, len(data), CHUNK_BYTES)]
        known: dict[tuple[int, int], int] = {}

        def size(i: int, length: int) -> int:
            if (i, length) not in known:
                coder = self.whole[i] if length == self.lengths[i] else self.cut(i, length)
                known[i, length] = sum(len(coder.compress(c)) for c in chunks)
            return known[i, length]

        best = self.order[0]
        for i in self.order[1:]:
            length = self.lengths[i]
            lead = self.margin * (1 - length / self.lengths[best])
            if size(i, length) < size(best, length) * (1 - lead):
                best = i
        return best, np.array([size(i, min(n, self.lengths[best])) for i, n in enumerate(self.lengths)], np.int64)


def _predict(contents: dict[str, bytes], margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Compressors(contents, margin)
        for piece in textvec.pieces(batches):
            texts = textvec.strings(pc.fill_null(piece.column("text"), ""))
            letters = pc.match_substring_regex(pc.fill_null(piece.column("text"), ""), r"\p{L}").to_numpy(zero_copy_only=False)
            langs, scores, rejected = [], [], []
            for text, some in zip(texts, letters, strict=True):
                if not some or not coder.langs:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                best, sizes = coder.compare(text)
                # bytes saved against each other language, as odds of two to the power of bits
                bits = np.minimum(8.0 * (sizes - sizes[best]), 500.0) / 4
                scores.append(float(1 / np.exp2(-bits).sum()))
                second = np.delete(sizes, best).min() if len(sizes) > 1 else math.inf
                rejected.append(bool(second - sizes[best] < margin * max(1, sizes[best])))
                langs.append(coder.langs[best])
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, contents: dict[str, bytes], id_column: str = "doc_id", text_column: str = "text",
             held_out=None, margin: float = MARGIN) -> DataFrame:
    """Per row the id, ``held_out`` (as given), ``lang_pred``, ``score`` (0 to 1) and ``rejected`` (narrow margin).

    A null text or one without letters is ``und`` with score 0, and so is every text if there are no dictionaries. Ties
    go to the longer dictionary, then to the language that sorts first. Repeated rows are judged alike; other columns stay aside.
    """
    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), (F.lit(False) if held_out is None else held_out).alias("held_out"),
                       F.col(text_column).alias("text"))
    return rows.mapInArrow(_predict(contents, margin), f"id {kind}, held_out boolean, lang_pred string, score double, rejected boolean") \
        .withColumnRenamed("id", id_column)


@query("op6_compression_language")
def op6_compression_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs, dictionaries(docs.where(~held_out)), held_out=held_out)
