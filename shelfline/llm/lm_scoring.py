"""Language-model scores from a hierarchical Pitman-Yor model.

The root restaurant seats words; every context seen in training, the word before, has a restaurant of its own below the
root. Each table of a context restaurant is a customer of the root, so contexts share what they know. Gibbs sweeps draw
the seatings again and again given all others; the predictive probabilities of several sweeps are averaged.

How the work lies on the cluster: words are dealt by hash into parts; a part holds everything about its words, so that
sweeps need no shuffle, only the totals of the contexts its words follow. These are summed between passes: each part
sends its share of every context to the place the context is dealt to by hash, and gets the total back. Texts are read
in chunks. A chunk sends each part its different (word, context) items with their training counts once, as packed
arrays, and gets probabilities back.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, discard, release
from . import textvec
from .registry import query, table

#: Concentration of root and contexts; sweeps before the totals are taken, before the first sample, and samples.
STRENGTH, SETTLE, BURN_IN, SAMPLES, TOTAL_PASSES = 1.0, 2, 2, 3, 2
#: Tokens for each part of the vocabulary.
PART_TOKENS = 2_500_000
#: Characters of text that are numbered at once, and that make a chunk; items of a part that are scored at once.
PIECE_CHARS, CHUNK_CHARS, BLOCK_ITEMS = 2_000_000, 24_000_000, 500_000
#: Parts are built in so many turns, each with a share of the shuffle's disk.
BUILD_TURNS = 3
#: A section seats its first customers one by one, later ones in groups that grow with it.
ONE_BY_ONE = 32
#: Hash of the end of a text, no word holds a line feed; it is also the context of first words.
END_HASH = textvec.hashes(pa.array(["\n"]))[0]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: byte planes apart, then compressed."""
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(len(head).to_bytes(4, "little") + head + body)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    size = int.from_bytes(data[:4], "little")
    at, out = 4 + size, []
    for kind, n in json.loads(data[4:at]):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel() if n else np.zeros(0, kind))
        at += n * width
    return out


def _dealt(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of each word or context."""
    return (hashes >> np.uint64(16)).astype(np.int64) % parts


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece its tokens: of training rows, of all rows."""
    for piece in textvec.pieces(batches):
        n = np.diff(textvec.words(piece.column("text"))[0]) + 1
        learn = piece.column("learn").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([int(n[learn].sum())]), pa.array([int(n.sum())])], ["learned", "tokens"])


def _items(piece: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Hashes of a piece's words; its different (word, context) items by numbers of these, with training counts; and its texts:
    id, whether it is missing, training, number of different items, these items and how often each stands there."""
    offsets, flat = textvec.words(piece.column("text"))
    codes, distinct = textvec.coded(flat)
    words = np.append(textvec.hashes(distinct), END_HASH)
    n, docs, width = np.diff(offsets), piece.num_rows, len(words)
    tokens = np.insert(codes, offsets[1:], len(distinct))
    del codes, flat, distinct
    context = np.empty(len(tokens), np.int64)
    context[1:] = tokens[:-1]
    context[offsets[:-1] + np.arange(docs)] = width - 1
    items, inverse = np.unique(tokens * width + context, return_inverse=True)
    del tokens, context
    doc = np.repeat(np.arange(docs), n + 1)
    learn = piece.column("learn").to_numpy(zero_copy_only=False)
    learned = np.bincount(inverse, weights=learn[doc], minlength=len(items)).astype(np.uint32)
    lines, repeats = np.unique(doc * len(items) + inverse, return_counts=True)
    ids = piece.column("id")
    return (words, (items // width).astype(np.uint32), (items % width).astype(np.uint32), learned,
            ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
            learn.astype(np.uint8), np.bincount(lines // len(items), minlength=docs).astype(np.uint32),
            (lines % len(items)).astype(np.uint32), repeats.astype(np.uint32))


def _merged(chunk: int, found: list[tuple[np.ndarray, ...]], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk from its pieces: the items they share stand there once."""
    words, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    part_of = _dealt(words, parts)
    order = np.argsort(part_of, kind="stable")
    width, rank = len(words), np.empty(len(words), np.int64)
    rank[order] = np.arange(width)
    ranks = np.split(rank[at], np.cumsum([len(f[0]) for f in found])[:-1])
    keys = np.concatenate([r[f[1]] * width + r[f[2]] for r, f in zip(ranks, found, strict=True)])
    by_key = np.argsort(keys)
    keys = keys[by_key]
    new = np.append(True, keys[1:] != keys[:-1])
    inverse = np.empty(len(keys), np.int32)
    inverse[by_key] = np.cumsum(new, dtype=np.int32) - 1
    learned = np.add.reduceat(np.concatenate([f[3] for f in found])[by_key], np.flatnonzero(new))
    items = keys[new]
    del keys, by_key, new, ranks, at, rank
    rows, start = [], 0
    for at_piece, (_, item, _, _, ids, missing, learn, per_doc, held, repeats) in enumerate(found):
        line = np.repeat(np.arange(len(per_doc)), per_doc) * len(items) + inverse[start:start + len(item)][held]
        start += len(item)
        in_order = np.argsort(line)
        in_doc = line[in_order] % len(items)
        steps = np.diff(in_doc, prepend=0)
        first = np.cumsum(per_doc) - per_doc
        steps[first] = in_doc[first]
        rows.append((-1 - at_piece, pack(ids, missing, learn, per_doc, steps.astype(np.uint32), repeats[in_order])))
    del inverse
    word_rank, item_context = (items // width).astype(np.int32), (items % width).astype(np.int32)
    words, item_part = words[order], part_of[order].astype(np.int32)[word_rank]
    del items
    for part in np.unique(item_part):
        own = slice(*np.searchsorted(item_part, [part, part + 1]))
        ranks, held = np.unique(word_rank[own], return_counts=True)
        used, number = np.unique(item_context[own], return_inverse=True)
        rows.append((int(part), pack(words[ranks], held.astype(np.uint32), words[used], number.astype(np.uint32), learned[own])))
    for part, blob in rows:  # a batch each, since Spark holds a batch beside its heap
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([blob], pa.binary())],
                                         ["chunk", "part", "blob"])


def _chunks(parts: int):
    """Per chunk a row for each piece of its texts (part -1 and less) and one for each part with items: word, context, count.

    Items of a chunk are numbered by part, word and context; texts are sorted lists of item numbers with counts.
    A part gets the hashes of its words and contexts, and items refer to contexts by number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are written once and read from there, so the number of a chunk need not come out the same again
        chunk = TaskContext.get().partitionId() << 32
        found, held = [], 0
        for piece in textvec.pieces(batches, most=PIECE_CHARS):
            held += piece.column("text").nbytes
            found.append(_items(piece))
            if held >= CHUNK_CHARS:
                yield from _merged(chunk, found, parts)
                chunk, found, held = chunk + 1, [], 0
        if found:
            yield from _merged(chunk, found, parts)

    return run


def _build(parts: int):
    """One row a part: what chunks asked for, the counts of its words, and its share of each of their contexts.

    Contexts are numbered from 1, in the order of the parts they are dealt to; 0 is the root.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        got = [unpack(b) for b in pdf["blob"]]
        n_names, n_items = (np.array([len(g[i]) for g in got], np.int64) for i in (2, 3))
        fields = [list(x) for x in zip(*got, strict=True)]
        del got
        words, held, names, numbers, learned = (np.concatenate(fields.pop(0)) for _ in range(5))
        numbers += np.repeat((np.cumsum(n_names) - n_names).astype(np.uint32), n_items)
        names, at = np.unique(names, return_inverse=True)
        order = np.argsort(_dealt(names, parts), kind="stable")
        names, rank = names[order], np.empty(len(order), np.uint32)
        rank[order] = np.arange(1, len(order) + 1)
        contexts = rank[at][numbers]
        del at, numbers, order, rank
        width = len(names) + 1
        vocabulary, code = np.unique(words, return_inverse=True)
        del words
        seen = np.flatnonzero(learned)
        key = np.repeat(code.astype(np.int32), held)[seen].astype(np.int64) * width + contexts[seen]
        learned = learned[seen]
        del seen
        order = np.argsort(key)
        key, learned = key[order], learned[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        keys, counts = key[starts], np.add.reduceat(learned.astype(np.int64), starts) if len(key) else np.zeros(0, np.int64)
        del order, key, learned, starts
        known, per_word = np.unique(keys // width, return_counts=True)
        place = np.full(len(vocabulary), -1, np.int32)
        place[known] = np.arange(len(known))
        asked = pack(pdf["chunk"].to_numpy(np.int64), n_items, place[code], held, contexts)
        del code, held, contexts, place
        of_word = np.add.reduceat(counts, np.cumsum(per_word) - per_word) if len(known) else counts
        context = keys % width
        model = pack(vocabulary[known], per_word.astype(np.uint32), context.astype(np.uint32), counts)
        share = pack(np.bincount(context, weights=counts, minlength=width)[1:].astype(np.int64),
                     np.bincount(context, minlength=width)[1:].astype(np.int64))
        return pd.DataFrame({
            "part": pdf["part"].iloc[:1].to_numpy(), "asked": [asked], "model": [model], "names": [pack(names)], "share": [share],
            "tokens": [int(counts.sum())], "words": [len(known)], "pairs": [len(keys)],
            "word_1": [int((of_word == 1).sum())], "word_2": [int((of_word == 2).sum())],
            "pair_1": [int((counts == 1).sum())], "pair_2": [int((counts == 2).sum())]})

    return run


BUILT = ("part int, asked binary, model binary, names binary, share binary, tokens long, words long, pairs long, "
         "word_1 long, word_2 long, pair_1 long, pair_2 long")


def _send(parts: int):
    """Shares of contexts, to the place each context is dealt to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for part, names, share in zip(pdf["part"], pdf["names"], pdf["share"], strict=True):
                (names,), values = unpack(names), unpack(share)
                place = _dealt(names, parts)
                for to in np.unique(place):
                    own = slice(*np.searchsorted(place, [to, to + 1]))
                    out.append((int(to), int(part), pack(names[own], *[v[own] for v in values])))
            yield pd.DataFrame(out, columns=["place", "part", "blob"])

    return run


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of the contexts of one place, for each part that has a share in them."""
    pdf = pdf.sort_values("part")
    got = [unpack(b) for b in pdf["blob"]]
    names, *values = (np.concatenate(x) for x in zip(*got, strict=True))
    ends = np.cumsum([len(g[0]) for g in got])
    _, at = np.unique(names, return_inverse=True)
    totals = [np.bincount(at, weights=v)[at].astype(np.int64) for v in values]
    return pdf[["place", "part"]].assign(
        blob=[pack(*[t[a:b] for t in totals]) for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)])


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals from all places in the order of the part's own numbers."""
    blobs = [unpack(b) for b in pdf.sort_values("place")["blob"]]
    return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "totals": [pack(*[np.concatenate(x) for x in zip(*blobs, strict=True)])]})


def context_totals(shares: DataFrame, parts: int) -> DataFrame:
    """(part, totals): the sums over all parts of what ``shares`` (part, names, share) holds by context."""
    sent = shares.select("part", "names", "share").mapInPandas(_send(parts), "place int, part int, blob binary")
    summed = sent.groupBy("place").applyInPandas(_sum, "place int, part int, blob binary")
    return summed.groupBy("part").applyInPandas(_gather, "part int, totals binary")


def seat(customers: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each section after its customers sat down one after another.

    A customer opens a table with weight ``opening`` and joins one with weight (seated - discount * tables). From
    ``ONE_BY_ONE`` customers on, a sixteenth of those seated sit down at once with the chance of the first of them.
    """
    order = np.argsort(-customers, kind="stable")
    c, a = customers[order], opening[order]
    t = np.minimum(c, 1).astype(np.float64)
    seated, active = 1, int((c > 1).sum())
    while active:
        group = max(1, seated // 16) if seated >= ONE_BY_ONE else 1
        chance = a[:active] / (a[:active] + seated - discount * t[:active])
        if group == 1:
            t[:active] += rng.random(active) < chance
        else:
            t[:active] += rng.binomial(np.minimum(group, c[:active] - seated), chance)
        seated += group
        active = int(np.searchsorted(-c, -seated, side="left"))
    out = np.empty(len(c))
    out[order] = t
    return out


class Part:
    """Seatings of the words of one part; the totals of other parts are given."""

    def __init__(self, blob: bytes, state: dict, seed: int):
        self.words, per_word, context, counts = unpack(blob)
        self.per_word = per_word.astype(np.int64)
        self.numbers, self.counts = context.astype(np.int64), counts
        # contexts without a restaurant
        self.context = np.where(state["rare"][self.numbers], 0, self.numbers) if "rare" in state else self.numbers
        self.word = np.repeat(np.arange(len(self.words)), self.per_word)
        self.below = self.context > 0
        self.state, self.rng = state, np.random.default_rng(seed)
        self.tables = np.where(self.below, 1.0, 0.0)
        self.root_tables = np.ones(len(self.words))
        self._root()

    def _root(self) -> None:
        """Customers of the root: words after contexts without a restaurant, and a customer for each table below."""
        self.root = np.bincount(self.word, weights=np.where(self.below, self.tables, self.counts), minlength=len(self.words))

    def word_probability(self, root: np.ndarray, tables: np.ndarray) -> np.ndarray:
        s = self.state
        return (root - s["d0"] * tables + (s["strength"] + s["d0"] * s["root_tables"]) * s["base"]) / (s["strength"] + s["root"])

    def opening(self) -> np.ndarray:
        """Weight of a new table, by context, as a multiple of the word's probability in the root."""
        return self.state["strength"] + self.state["d1"] * np.array(self.state["tables"])

    def sweep(self) -> None:
        s = self.state
        p = self.word_probability(self.root, self.root_tables)
        some = self.below & (self.counts > 1)
        self.tables[some] = seat(self.counts[some], self.opening()[self.context[some]] * p[self.word[some]], s["d1"], self.rng)
        self._root()
        weight = np.full(len(self.words), (s["strength"] + s["d0"] * s["root_tables"]) * s["base"])
        self.root_tables = seat(self.root.astype(np.int64), weight, s["d0"], self.rng)


def _local(state: dict, totals: bytes) -> dict:
    """The state with the customers and tables of the part's own contexts; number 0 is the root."""
    customers, *tables = (np.append(0.0, v) for v in unpack(totals))
    rare = customers < state["least"]
    return {**state, "customers": customers, "tables": tables[0], "samples": tables, "rare": rare}


def _draw(state: dict, burn_in: int, samples: int):
    """Per part the sums of the root and its share of tables by context for each of the last sweeps, and these seatings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for part, blob, totals, names, share in zip(*[pdf[c] for c in ("part", "model", "totals", "names", "share")], strict=True):
                own = Part(blob, _local(state, totals), 1000 * state["pass"] + int(part))
                width = len(own.state["tables"])
                root, root_tables, by_context, seatings = [], [], [], []
                for turn in range(burn_in + samples):
                    own.sweep()
                    if turn < burn_in:
                        continue
                    root.append(float(own.root.sum()))
                    root_tables.append(float(own.root_tables.sum()))
                    by_context.append(np.bincount(own.context, weights=own.tables, minlength=width)[1:].astype(np.int64))
                    seatings += [own.tables.astype(np.uint32), own.root_tables.astype(np.uint32)]
                out.append((part, names, pack(unpack(share)[0], *by_context), root, root_tables, pack(*seatings) if samples > 1 else None))
            yield pd.DataFrame(out, columns=["part", "names", "share", "root", "root_tables", "seatings"])

    return run


DRAWN = "part int, names binary, share binary, root array<double>, root_tables array<double>, seatings binary"


def _answer(state: dict, roots: list[dict]):
    """Per part and chunk: log10 of the averaged probability and the training count of the word, item by item.

    Each sample is scored with its own totals, so that its probabilities sum to one in every context.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part, asked, blob, totals, seatings in zip(*[pdf[c] for c in ("part", "asked", "model", "totals", "seatings")], strict=True):
                s = _local(state, totals)
                width, customers = len(s["tables"]), s["customers"]
                own = Part(blob, s, 0)
                chunks, n_items, places, held, contexts = unpack(asked)
                total = np.bincount(own.word, weights=own.counts, minlength=len(own.words)).astype(np.int64)
                word = np.repeat(places, held)
                blocks = [slice(a, a + BLOCK_ITEMS) for a in range(0, len(word), BLOCK_ITEMS)]
                keys = own.word * width + own.numbers
                pair = np.empty(len(word), np.int32)
                for b in blocks:
                    key = word[b].astype(np.int64) * width + contexts[b]
                    spot = np.searchsorted(keys, key)
                    hit = (word[b] >= 0) & (spot < len(keys)) & ~s["rare"][contexts[b]]
                    hit[hit] = keys[spot[hit]] == key[hit]
                    pair[b] = np.where(hit, spot, -1)
                del keys
                drawn = unpack(seatings)
                average = np.zeros(len(word))
                for turn, root in enumerate(roots):
                    own.state = {**s, **root, "tables": s["samples"][turn]}
                    own.tables, own.root_tables = drawn[2 * turn].astype(np.float64), drawn[2 * turn + 1].astype(np.float64)
                    own._root()
                    share = own.opening() / (s["strength"] + customers)
                    seated = own.counts - s["d1"] * own.tables
                    by_word = np.append(own.word_probability(own.root, own.root_tables),
                                        own.word_probability(np.zeros(1), np.zeros(1)))
                    for b in blocks:
                        p, hit, context = by_word[word[b]], pair[b] >= 0, contexts[b]
                        seen = np.zeros(len(p))
                        seen[hit] = seated[pair[b][hit]] / (s["strength"] + customers[context[hit]])
                        average[b] += np.where(s["rare"][context], p, seen + share[context] * p)
                of_word, ends = np.append(total, 0), np.cumsum(n_items)
                yield pd.DataFrame({
                    "chunk": chunks, "part": np.full(len(chunks), part, np.int32),
                    "blob": [pack(np.log10(average[a:b] / len(roots)).astype(np.float32), of_word[word[a:b]])
                             for a, b in zip(ends - n_items, ends, strict=True)]})

    return run


def _score(state: dict):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, answers = pdf["blob"][pdf["part"] < 0], pdf[pdf["part"] >= 0].sort_values("part")["blob"]
        logs, counts = (np.concatenate(x) for x in zip(*[unpack(b) for b in answers], strict=True))
        return pd.concat([of_piece(b, logs, counts) for b in texts])

    def of_piece(blob: bytes, logs: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        ids, missing, learn, per_doc, steps, repeats = unpack(blob)
        first = np.cumsum(per_doc, dtype=np.int64) - per_doc
        run_up = np.cumsum(steps, dtype=np.int64)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        item = run_up - np.where(first > 0, run_up[np.maximum(first - 1, 0)], 0)[doc]
        base = np.log10((counts[item] + 0.5) / (state["tokens"] + 0.5 * (state["words"] + 1)))
        total = lambda v: np.add.reduceat(v * repeats, first)
        n = total(np.ones(len(item), np.int64))
        score = total(logs[item].astype(np.float64))
        return pd.DataFrame({
            "id": pd.arrays.IntegerArray(ids.copy(), missing > 0),
            "held_out": learn == 0, "n_tokens": n, "n_known": total((counts[item] > 0).astype(np.int64)),
            "train_tokens": np.full(len(n), state["tokens"]), "base_score": total(base), "score": score,
            "perplexity": np.power(10.0, np.minimum(-score / n, 300.0))})

    return run


def score_texts(docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text",
                context_share: float = 0.0, strength: float = STRENGTH) -> DataFrame:
    """Score every text with a model of the rows for which ``learn`` holds.

    Returns the id, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``, ``base_score``
    (add-a-half unigram), ``score`` (log10 probability of the text) and ``perplexity``. Tokens are words between ASCII
    white space with A-Z in lower case, then one end. A null text is empty: the end alone. A null ``learn`` is false.
    Contexts with less than ``context_share`` of the training tokens have no restaurant; by default all have one.
    Repeated rows count and are scored each; without training rows every word is unknown; an empty table gives no rows;
    ids are whole numbers or null; other columns stay aside.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"),
                       F.translate(F.coalesce(F.col(text_column), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("text"))
    totals = rows.select("learn", "text").mapInArrow(_sizes, "learned long, tokens long").agg(
        F.sum("learned").alias("learned"), F.sum("tokens").alias("tokens")).first()
    learned, tokens = totals["learned"] or 0, totals["tokens"] or 0
    parts = max(1, -(-tokens // PART_TOKENS))
    chunks = cut_lineage(rows.mapInArrow(_chunks(parts), "chunk long, part int, blob binary"), "chunks")
    built, turns = [], min(parts, BUILD_TURNS)
    for turn in range(turns):  # what one turn shuffles goes before the next
        own = chunks.where((F.col("part") >= 0) & (F.col("part") % turns == turn))
        built.append(cut_lineage(own.groupBy("part").applyInPandas(_build(parts), BUILT), "built"))
        release(docs.sparkSession)
    built = functools.reduce(DataFrame.union, built)
    texts = cut_lineage(chunks.where("part < 0"), "texts")
    discard(chunks)
    sums = built.agg(*[F.sum(c).alias(c) for c in ("tokens", "words", "pairs", "word_1", "word_2", "pair_1", "pair_2")]).first()

    def discount(once: int | None, twice: int | None) -> float:
        """Share of mass set aside, from the numbers of sections with one and with two customers."""
        return min(0.95, max(0.05, (once or 0) / max(1, (once or 0) + 2 * (twice or 0))))

    state = {"d0": discount(sums["word_1"], sums["word_2"]), "d1": discount(sums["pair_1"], sums["pair_2"]), "strength": strength,
             "tokens": sums["tokens"] or 0, "words": sums["words"] or 0, "base": 1.0 / ((sums["words"] or 0) + 1),
             "least": learned * context_share, "root_tables": float(sums["words"] or 0), "root": float(sums["pairs"] or 0)}
    drawn = built.select("part", "names", "share")
    for turn in range(TOTAL_PASSES + 1):
        last = turn == TOTAL_PASSES
        burn_in, samples = (BURN_IN, SAMPLES) if last else (SETTLE - 1, 1)
        known = built.select("part", "model", "names", "share").join(context_totals(drawn, parts), "part")
        before, drawn = drawn, cut_lineage(known.mapInPandas(_draw({**state, "pass": turn}, burn_in, samples), DRAWN), "totals")
        discard(before)
        release(docs.sparkSession)
        found = drawn.agg(*[F.sum(F.col(c)[i]).alias(f"{c}_{i}") for c in ("root", "root_tables") for i in range(samples)]).first()
        roots = [{c: found[f"{c}_{i}"] or 0.0 for c in ("root", "root_tables")} for i in range(samples)]
        state |= roots[-1]
    answers = built.select("part", "asked", "model").join(drawn.select("part", "seatings"), "part").join(
        context_totals(drawn, parts), "part").mapInPandas(_answer(state, roots), "chunk long, part int, blob binary")
    scored = texts.union(answers).groupBy("chunk").applyInPandas(
        _score(state), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return scored.withColumnRenamed("id", id_column)


@query("op2_pitman_yor_scores")
def op2_pitman_yor_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
