"""Packing: vector bin packing of examples under limits on tokens, segments and loss-bearing tokens.

Examples are dealt into groups of a few thousand without regard to any key. In a group, a sequence is filled by taking
again and again the example whose demand has the largest dot product with what is left of the sequence, over all
limits; when nothing fits, the next sequence is opened. Documents are tokenized first and cut at full sequences; whole
sequences stand alone, the remainders are packed.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import textvec
from .registry import query, table

SEQUENCE_TOKENS, SEQUENCE_SEGMENTS = 4096, 512
TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Examples of a group that are packed together.
GROUP_ROWS = 4096
#: Words whose ids a task remembers; a full memory starts anew.
REMEMBERED = 600_000
#: Words of which each is one token group of its own: letters that no rule of the tokenizer splits or joins.
PLAIN = r"^[a-zß-öø-ÿ]+$"


def pack(demands: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in the bin) of each row of ``demands``; a row beyond a limit gets a bin alone.

    Ties go to the earlier row, so equal input gives equal bins.
    """
    n = len(demands)
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    share = demands / limits
    # a scarce resource counts more
    weight = share.sum(axis=0) / max(n, 1)
    left, number = np.arange(n), -1
    while len(left):
        number += 1
        room, taken = limits.astype(np.int64).copy(), []
        part = demands[left]
        score = share[left] * weight
        open_rows = np.ones(len(left), bool)
        while True:
            fits = np.flatnonzero(open_rows & (part <= room).all(axis=1))
            if not len(fits):
                break
            best = fits[np.argmax(score[fits] @ (room / limits))]
            taken.append(best)
            open_rows[best] = False
            room = room - part[best]
        if not taken:  # nothing fits an empty bin
            taken, open_rows[0] = [0], False
        bins[left[taken]] = number
        places[left[taken]] = np.arange(len(taken))
        left = left[open_rows]
    return bins, places


def pack_examples(examples: DataFrame, tokens: str = "tokens", loss_tokens: str = "loss_tokens",
                  sequence_tokens: int = SEQUENCE_TOKENS, sequence_segments: int = SEQUENCE_SEGMENTS,
                  sequence_loss: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``sequence_id``, ``segment`` (place in its sequence) and ``offset`` (tokens before it there) to examples.

    ``examples`` is read twice and must give the same rows each time (a written table). A null count is zero. An
    example beyond a limit stands alone in a sequence. Repeated rows are packed each on its own; an empty table gives
    no rows; other columns are carried along, except those that have the names added here.
    """
    limits = np.array([sequence_tokens, sequence_segments, sequence_loss or sequence_tokens])
    groups = max(1, -(-examples.count() // group_rows))
    # the row's position deals evenly, whatever the keys hold
    added = {"sequence_id", "segment", "offset"}
    kept = examples.drop(*added)
    dealt = kept.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        demands = np.stack([pdf[tokens].fillna(0).to_numpy(np.int64), np.ones(len(pdf), np.int64),
                            pdf[loss_tokens].fillna(0).to_numpy(np.int64)], axis=1)
        bins, places = pack(demands, limits)
        order = np.lexsort((places, bins))
        before = np.cumsum(demands[order, 0]) - demands[order, 0]
        first = np.concatenate(([True], np.diff(bins[order]) != 0))
        offset = np.empty(len(pdf), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        return pdf.drop(columns="_group").assign(
            sequence_id=(pdf["_group"].to_numpy(np.int64) << 32) + bins, segment=places, offset=offset)

    schema = ", ".join([*[f"`{n}` {t}" for n, t in kept.dtypes], "sequence_id long, segment long, offset long"])
    return dealt.groupBy("_group").applyInPandas(run, schema)


class WordTokens:
    """Ids of words, with a memory of words seen before.

    White space ends every token, so a text's ids are those of its words in a row. A word is looked up in lower case
    and without trailing ASCII punctuation, which is a token of its own after a letter.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], sizes: list[np.ndarray], ids: list[np.ndarray]) -> None:
        at = len(self.place)
        self.place.update(zip(words, range(at, at + len(words)), strict=True))
        self.sizes = np.concatenate((self.sizes, *sizes))
        self.ids = np.concatenate((self.ids, *ids))

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of different words is remembered, after encoding those that are not."""
        listed = textvec.strings(words)
        at = np.fromiter((self.place.get(w, -1) for w in listed), np.int64, len(listed))
        fresh = at < 0
        if fresh.any():
            plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
            new, sizes, ids = [], [], []
            ascii_only, simple, other = [], [], []
            for i in np.flatnonzero(fresh):
                word = listed[i]
                (other if not plain[i] else ascii_only if word.isascii() else simple).append(word)
            # the merges alone: such a word passes the tokenizer's other steps as it is
            merges = self.tokenizer.model.tokenize
            found = [[t.id for t in merges(word)] for word in ascii_only]
            new += ascii_only
            sizes.append(np.fromiter((len(x) for x in found), np.int64, len(found)))
            ids.append(np.array([i for x in found for i in x], np.uint32))
            for a in range(0, len(simple), 2000):
                some = simple[a: a + 2000]
                found = np.array(self._encode([" ".join(some)])[0], np.uint32)
                cuts = np.flatnonzero(self.ends[found]) + 1
                if len(cuts) == len(some):
                    new += some
                    sizes.append(np.diff(cuts, prepend=0))
                    ids.append(found)
                else:
                    other += some
            for word, found in zip(other, self._encode(other), strict=True):
                new.append(word)
                sizes.append(np.array([len(found)], np.int64))
                ids.append(np.array(found, np.uint32))
            self._learn(new, sizes, ids)
            at = np.fromiter((self.place[w] for w in listed), np.int64, len(listed))
        return at

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts in a row."""
        if len(self.place) > REMEMBERED:
            self._forget()
        offsets, flat = textvec.words(texts)
        codes, distinct = textvec.coded(flat)
        special = pc.match_substring(distinct, "<|")
        lowered = pc.if_else(special, distinct, pc.ascii_lower(distinct))
        base = pc.ascii_rtrim(lowered, string.punctuation)
        base = pc.if_else(pc.and_not(pc.match_substring_regex(base, "[a-zß-öø-ÿ]$"), special), base, lowered)
        cut = pc.subtract(pc.binary_length(lowered), pc.binary_length(base))
        tail = pc.if_else(pc.equal(cut, 0), "", pc.utf8_slice_codeunits(lowered, -1))
        long_tails = np.flatnonzero(pc.greater(cut, 1).to_numpy(zero_copy_only=False))
        if len(long_tails):
            tail, some = textvec.strings(tail), pa.array(long_tails)
            for i, word, n in zip(long_tails, textvec.strings(lowered.take(some)), cut.take(some).to_numpy(), strict=True):
                tail[i] = word[-n:]
            tail = pa.array(tail, pa.string())
        base_code, bases = textvec.coded(base)
        tail_code, tails = textvec.coded(tail)
        base_at, tail_at = self.places(bases), self.places(tails)
        parts = np.stack((base_at[base_code][codes], tail_at[tail_code][codes]), axis=1).ravel()
        starts = np.cumsum(self.sizes) - self.sizes
        lengths = self.sizes[parts]
        before = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        gathered = self.ids[np.repeat(starts[parts] - before, lengths) + np.arange(total)]
        return np.append(before, total)[2 * offsets], gathered


_LOADED: dict[str, WordTokens] = {}


def word_tokens(tokenizer: str) -> WordTokens:
    """The tokenizer of a task, loaded once; a bare name stands for a file of the public tokenizers."""
    if tokenizer not in _LOADED:
        path = tokenizer
        if "/" not in tokenizer:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        _LOADED[tokenizer] = WordTokens(path)
    return _LOADED[tokenizer]


def _cut(tokenizer: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokens(tokenizer)
        for piece in textvec.pieces(batches, most=2 * textvec.PIECE_CHARS):
            offsets, ids = coder.texts(piece.column("text"))
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for i in range(piece.num_rows):
                own = np.append(ids[offsets[i]: offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                for a in range(0, len(own), most):
                    part = own[a: a + most]
                    rows.append(i)
                    starts.append(a)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
                    totals.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [piece.column("id").take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]],
                ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def document_pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER,
                    end_id: int = END_ID, most: int = SEQUENCE_TOKENS) -> DataFrame:
    """Token pieces of at most ``most`` ids for every document: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``.

    The ids are the tokenizer's, then ``end_id``. A null text is empty and has one piece, the end alone.
    """
    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(_cut(tokenizer, end_id, most),
                           f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("id", id_column)


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER,
                   most: int = SEQUENCE_TOKENS, segments: int = SEQUENCE_SEGMENTS) -> DataFrame:
    """Every document's token pieces with their place in a sequence; all its tokens bear loss.

    Repeated rows are packed each on its own; null ids are kept; empty tables give no rows; other columns stay aside.
    """
    pieces = cut_lineage(document_pieces(docs, id_column, text_column, tokenizer, most=most), "pieces")
    return pack_examples(pieces, "length", "length", most, segments)


@query("op5_vector_packing")
def op5_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
