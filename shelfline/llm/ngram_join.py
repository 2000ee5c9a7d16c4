"""N-gram Jaccard join with parity sketches.

A text is the set of its word shingles. Each shingle flips one bit of a sketch, so the Hamming distance of two sketches
never exceeds the symmetric difference of the sets. Sets of similar size share a size band; the Jaccard bound limits
their symmetric difference to some ``d``, and a sketch of more than ``d`` parts must agree in at least one part
(pigeonhole). Parts are joined by their hash, candidates are filtered by sketch distance and verified on the sets.

Weak parts (fewer than two shingles) say little, and unrelated texts agree in them. A sketch has a quarter more parts
than needed; as long as a text has no more weak parts than those to spare, it can leave them out and still meets every
partner: what an untouched part holds is the same on both sides, so it is weak for both or for neither. Of its strong
parts as many meet the partner as it has left to spare, and one: a text of which fewer meet anything has no partner.
So a text also leaves out its fullest parts, as many as it has left to spare: in one order of all parts, the first that two
linked texts share is among those that both keep. Parts with the same texts in them are compared once.

Groups of near copies are not expanded into pairs: every part compares its members with a pivot, the text with most
company first, linked texts become one component, and only members of different components are compared in full, in
blocks. Only pairs with near sketches leave a task; the sets of their texts are made again from the texts, and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, discard, release
from . import textvec
from .registry import query, table

WIDTH, PERCENT = 4, 85
#: Bits of a part of a sketch, as a power of two; only the hash of a part travels.
PART_BITS = 20
#: Texts of a part that are compared with each other at once, rows of the parts that share a bin, turns with pivots.
BLOCK, BIN_ROWS = 512, 20_000
PIVOT_ROUNDS = 1
#: Low bits of a slot; a larger need is taken as the largest that they hold, which only keeps more.
NEED_BITS = 14


def band_ends(largest: int, percent: int) -> np.ndarray:
    """Largest set size of each band; sizes that can reach the bound lie in one band or in neighbouring ones."""
    ends = [1]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, ends[-1] * 100 // percent))
    return np.array(ends, np.int64)


def most_different(size: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of two linked sets of at most ``size`` members each."""
    return 2 * size * (100 - percent) // (100 + percent)


class Sets:
    """Distinct sorted shingle hashes of a piece of texts, one run a text."""

    def __init__(self, texts: pa.Array, width: int):
        offsets, flat = textvec.words(texts, lower=True)
        codes, distinct = textvec.coded(flat)
        codes = textvec.hashes(distinct)[codes]
        n = np.diff(offsets)
        starts, rows = textvec.inside(offsets, width, len(codes))
        grams = textvec.window_hashes(codes, width)[starts]
        for short in range(1, width):  # fewer words than a shingle: the whole sequence is one
            own = np.flatnonzero(n == short)
            if len(own):
                value = textvec.mix(textvec.window_hashes(codes, short)[offsets[own]] + np.uint64(short))
                grams, rows = np.concatenate((grams, value)), np.concatenate((rows, own))
        if len(rows) and (np.diff(rows) < 0).any():
            order = np.argsort(rows, kind="stable")
            grams, rows = grams[order], rows[order]
        ends = np.searchsorted(rows, np.arange(len(n) + 1))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            grams[a:b].sort()
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
        self.values, self.rows = grams[new], rows[new]
        self.sizes = np.bincount(self.rows, minlength=len(n)).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def keys(self) -> list[bytes | None]:
        """128-bit fingerprint of each set; none for an empty one."""
        out: list[bytes | None] = [None] * len(self.sizes)
        full = np.flatnonzero(self.sizes)
        if len(full):
            scrambled = textvec.mix(self.values + np.uint64(1))
            total = np.add.reduceat(scrambled, self.starts[full])
            parity = np.bitwise_xor.reduceat(textvec.mix(scrambled + np.uint64(2)), self.starts[full])
            for i, a, b in zip(full, total, parity, strict=True):
                out[i] = a.tobytes() + b.tobytes()
        return out

    def sketches(self, take: np.ndarray, shift: int, percent: int):
        """Sketches of the rows ``take`` in their own band (``shift`` 0) or the next (1).

        Returns (bucket, parts, first part of each, hash of each part, shingles in each part, 8 bits of each part).
        """
        ends = band_ends(int(self.sizes.max()) * 100 // percent + 2 if len(self.sizes) else 1, percent)
        bucket = np.searchsorted(ends, self.sizes[take]) + shift
        needed = most_different(ends[bucket], percent) + 1
        parts = needed + (needed + 3) // 4
        first = np.cumsum(parts) - parts
        index = np.full(len(self.sizes), -1)
        index[take] = np.arange(len(take))
        mine = index[self.rows]
        values, mine = self.values[mine >= 0], mine[mine >= 0]
        # the high bits choose the part, so the shingles of a part stand together
        slot = first[mine] + ((values >> np.uint64(32)) * parts[mine].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        bits = textvec.mix(values + np.uint64(3)) >> np.uint64(64 - PART_BITS)
        # flipping a bit twice leaves the part as it was, and so does its hash
        flips = textvec.mix(bits + np.uint64(0x5851F42D4C957F2D))
        total = int(parts.sum())
        held, counts, short = np.zeros(total, np.uint64), np.zeros(total, np.int64), np.zeros(total, np.uint8)
        if len(slot):
            runs = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            held[slot[runs]] = np.bitwise_xor.reduceat(flips, runs)
            counts[slot[runs]] = np.diff(np.append(runs, len(slot)))
            one = np.uint8(1) << (bits & np.uint64(7)).astype(np.uint8)
            short[slot[runs]] = np.bitwise_xor.reduceat(one, runs)
        return bucket, parts, first, held, counts, short


def _summaries(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textvec.pieces(batches):
            sets = Sets(piece.column("text"), width)
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(sets.sizes), pa.array(sets.keys(), pa.binary())],
                                             ["id", "n_shingles", "set_key"])

    return run


def _parts(width: int, percent: int):
    """(hash, slot, id): the strong parts of every different set of the piece.

    ``slot`` holds the bucket above ``NEED_BITS`` and how many of the text's parts have to meet a partner's there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textvec.pieces(batches):
            sets = Sets(piece.column("text"), width)
            ids = piece.column("id").to_numpy(zero_copy_only=False)
            firsts: dict[bytes, int] = {}
            for i, key in enumerate(sets.keys()):
                if key is not None and (key not in firsts or ids[i] < ids[firsts[key]]):
                    firsts[key] = i
            take = np.array(sorted(firsts.values()), np.int64)
            if not len(take):
                continue
            for shift in (0, 1):
                bucket, parts, first, held, counts, _ = sets.sketches(take, shift, percent)
                owner = np.repeat(np.arange(len(take)), parts)
                weak = counts < 2
                spare = parts - (most_different(band_ends(int(sets.sizes.max()) * 100 // percent + 2, percent)[bucket], percent) + 1)
                left = spare - np.add.reduceat(weak.astype(np.int64), first)
                send = ~weak | (left < 0)[owner]
                slot = (bucket << NEED_BITS) | np.clip(left + 1, 1, (1 << NEED_BITS) - 1)
                number = np.arange(len(owner)) - first[owner]
                key = textvec.mix(held + textvec.mix(textvec.mix(bucket.astype(np.uint64))[owner] + number.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[send].view(np.int64)), pa.array(slot[owner][send].astype(np.int32)),
                     pa.array(ids[take][owner[send]], pa.int64())], ["key", "slot", "id"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their way through a shuffle."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for piece in textvec.pieces(batches):
        packed = [None if t is None else pack(t.encode()) for t in piece.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(packed, pa.binary())], ["id", "text"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts again, some megabytes at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        ids, texts, size = [], [], 0
        for key, packed in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(key)
            texts.append(None if packed is None else unpack(packed).decode())
            size += len(texts[-1] or "")
            if size > textvec.PIECE_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
                ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["id", "text"])


def _sketched(width: int, percent: int):
    """Bit sketches (8 bits a part) of the texts that meet others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _unpacked(batches):
            sets = Sets(piece.column("text"), width)
            take = np.flatnonzero(sets.sizes)
            if not len(take):
                continue
            made = [sets.sketches(take, shift, percent) for shift in (0, 1)]
            keys = sets.keys()
            columns = [piece.column("id").take(pa.array(take)), pa.array(sets.sizes[take]), pa.array([keys[i] for i in take], pa.binary()),
                       pa.array(made[0][0].astype(np.int32))]
            for _, parts, first, _, _, short in made:
                columns.append(pa.array([short[a: a + n].tobytes() for a, n in zip(first, parts, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "size", "set_key", "band", "own", "next"])

    return run


def _members(width: int):
    """The sets of candidate texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _unpacked(batches):
            sets = Sets(piece.column("text"), width)
            take = np.flatnonzero(sets.sizes)
            if len(take):
                blob = [sets.values[sets.starts[i]: sets.starts[i] + sets.sizes[i]].tobytes() for i in take]
                yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(take)), pa.array(blob, pa.binary())], ["id", "members"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(linked, pa.bool_())), batch.column("b").filter(pa.array(linked, pa.bool_()))],
                ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the bound; ``texts`` has (id, packed text)."""
    paired = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut_lineage(texts.join(paired, "id", "left_semi").mapInArrow(_members(width), "id long, members binary"), "members")
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("members_a"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("members_b"))
    linked = pairs.join(left, "a").join(right, "b").mapInArrow(_verify(percent), "a long, b long").distinct()
    links = cut_lineage(linked, "links")
    discard(sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that links (a, b) reach, for every id in a link. Loops over written tables."""
    edges = cut_lineage(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "edges")
    labels = cut_lineage(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("comp").alias("near"))
        step = cut_lineage(labels.join(near, F.col("id") == F.col("a"), "left").select(
            "id", F.col("comp").alias("before"), F.least("comp", F.coalesce("near", "comp")).alias("comp")), "step")
        discard(labels)
        jump = step.select(F.col("id").alias("root"), F.col("comp").alias("further"))
        moved = cut_lineage(step.join(jump, F.col("comp") == F.col("root"), "left").select(
            "id", "before", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        discard(step)
        done = moved.where("before != comp").isEmpty()
        labels = cut_lineage(moved.select("id", "comp"), "labels")
        discard(moved)
        if done:
            discard(edges)
            return labels


def _compare(percent: int, star: bool):
    """Candidate pairs of the parts in a bin, by sketch distance.

    Rows with a sketch hold that of a text in a bucket, once for all parts of the bin.
    ``star``: a member is compared with one pivot after another until it is near one. Else all members of different
    components are compared.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sketched = pdf["sketch"].notna()
        texts = pdf.loc[sketched, ["id", "bucket", "size", "sketch"]]
        pdf = pdf.loc[~sketched, ["key", "id", "comp", "weight", "bucket", "i", "j"]].merge(texts, on=["id", "bucket"])
        pdf = pdf.sort_values(["key", "i", "j", "weight", "id"], ascending=[True, True, True, False, True])
        keys, ids, comps, sizes = (pdf[c].to_numpy() for c in ("key", "id", "comp", "size"))
        tiles = pdf[["i", "j"]].to_numpy()
        sketches = pdf["sketch"].to_numpy()
        new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (tiles[1:] != tiles[:-1]).any(axis=1))))
        out: list[tuple[int, int]] = []
        for a, b in zip(new, np.append(new[1:], len(pdf)), strict=True):
            rows = np.frombuffer(b"".join(sketches[a:b]), np.uint8).reshape(b - a, -1)
            size, comp, own = sizes[a:b], comps[a:b], ids[a:b]
            waiting = np.ones(b - a, bool)
            for i in range(b - a - 1):
                if star and not waiting[i]:
                    continue
                other = np.flatnonzero(comp[i + 1:] != comp[i]) + i + 1
                if star:
                    other = other[waiting[other]]
                if not len(other):
                    continue
                fits = 100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])
                near = other[fits]
                # two linked sets differ in no more members than this, and their sketches in no more bits
                most = (size[near] + size[i]) * (100 - percent) // (100 + percent)
                near = near[np.bitwise_count(rows[near] ^ rows[i]).sum(axis=1) <= most]
                waiting[near] = False
                out += [(min(x, own[i]), max(x, own[i])) for x in own[near]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64").drop_duplicates()

    return run


def _candidates(met: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, star: bool) -> DataFrame:
    """Candidate pairs between different components, from all parts that still hold several; written."""
    placed = met.join(comps, "id")
    bucket = F.shiftright("slot", NEED_BITS)
    # 128 bits of the texts in a part; sums, since an id may stand in a part twice
    own = [F.sum(half(F.xxhash64("id", F.lit(seed)))).alias(f"sum_{seed}{i}") for seed in (1, 2)
           for i, half in enumerate((lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32)))]
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members"),
                                          F.min(bucket).alias("bucket"), F.min("id").alias("first"), *own).where("low < high")
    # of the parts of a bucket with the same texts one is enough
    alike = ["bucket", "members", *(f"sum_{seed}{i}" for seed in (1, 2) for i in (0, 1))]
    open_keys = open_keys.groupBy(*alike).agg(F.min("key").alias("key"), F.min("first").alias("first"))
    # parts of the same group lie together, so its sketches travel once; the parts of a large group are dealt to several bins
    groups = open_keys.groupBy("first").agg(F.ceil(F.sum("members") / BIN_ROWS).cast("int").alias("pieces"))
    open_keys = cut_lineage(open_keys.join(groups, "first").select(
        "key", "first", "members", F.pmod(F.xxhash64("key"), F.col("pieces")).alias("piece"),
        F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "open")
    bins = max(1, (open_keys.agg(F.sum("members")).first()[0] or 0) // BIN_ROWS)
    rows = placed.join(open_keys, "key").select(
        "key", "id", "comp", "weight", bucket.alias("bucket"), "first", "piece", "blocks",
        F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    if star:  # each block has its own pivots
        tiles = rows.withColumns({"i": F.col("block"), "j": F.col("block")})
    else:
        other = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        tiles = other.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    # small parts share a bin, and blocks of a large part fall into different bins
    place = F.when(F.col("blocks") > 1, F.xxhash64("key", "i", "j")).otherwise(F.xxhash64("first", "piece"))
    dealt = cut_lineage(tiles.select("key", "id", "comp", "weight", "bucket", "i", "j", F.pmod(place, F.lit(bins)).alias("bin")), "dealt")
    sketch = F.when(F.col("band") == F.col("bucket"), F.col("own")).when(F.col("band") + 1 == F.col("bucket"), F.col("next"))
    sent = dealt.select("bin", "id", "bucket").distinct().join(sets.select("id", "size", "band", "own", "next"), "id").select(
        "bin", "id", "bucket", "size", sketch.alias("sketch")).where("sketch is not null")
    # numbers, not nulls, on both sides: pandas would take long keys with nulls for floats
    zero, small = F.lit(0).cast("long"), F.lit(0)
    met_in = dealt.withColumns({"size": zero, "sketch": F.lit(None).cast("binary")}).unionByName(
        sent.withColumns({"key": zero, "comp": zero, "weight": zero, "i": small, "j": small}))
    found = cut_lineage(met_in.groupBy("bin").applyInPandas(_compare(percent, star), "a long, b long").distinct(), "pairs")
    discard(dealt)
    discard(open_keys)
    return found


def _met_enough(met: DataFrame) -> DataFrame:
    """Rows (key, slot, id) of texts of which enough parts meet something, with the rows ``n`` of their key; ``n`` > 1."""
    by_text = Window.partitionBy("id", F.shiftright("slot", NEED_BITS))
    enough = met.withColumn("meet", F.count(F.lit(1)).over(by_text)).where(
        F.col("meet") >= F.col("slot").bitwiseAND(F.lit((1 << NEED_BITS) - 1)))
    return enough.select("key", "slot", "id", F.count(F.lit(1)).over(Window.partitionBy("key")).alias("n")).where("n > 1")


def _rarest(met: DataFrame) -> DataFrame:
    """Rows without the fullest parts of each text, one less than it shares with any partner."""
    fullest = Window.partitionBy("id", F.shiftright("slot", NEED_BITS)).orderBy(F.desc("n"), F.desc("key"))
    kept = met.withColumn("place", F.row_number().over(fullest)).where(
        F.col("place") >= F.col("slot").bitwiseAND(F.lit((1 << NEED_BITS) - 1)))
    return kept.select("key", "slot", "id", F.count(F.lit(1)).over(Window.partitionBy("key")).alias("n")).where("n > 1")


def similarity_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH,
                       percent: int = PERCENT) -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id``.

    Texts are linked when ``100 * common shingles >= percent * all shingles``; ``component_id`` is the smallest id that
    links reach. A text of fewer than ``width`` words is one shingle; a null text or one without words has no shingles
    and stays alone. Rows that share an id are one document with several texts. A row with a null id has no component.
    Equal sets are compared once. Empty tables give no rows; other columns stay aside.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    summary = cut_lineage(rows.mapInArrow(_summaries(width), "id long, n_shingles long, set_key binary"), "summary")
    known = rows.where("id is not null")
    classes = cut_lineage(summary.where("set_key is not null and id is not null").groupBy("set_key").agg(
        F.min("id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("id")).distinct()

    by_key = Window.partitionBy("key")
    parts = known.mapInArrow(_parts(width, percent), "key long, slot int, id long")
    met = parts.withColumns({"low": F.min("id").over(by_key), "high": F.max("id").over(by_key)}).where("low < high")
    met = met.select("key", "slot", "id").join(reps, "id", "left_semi").distinct()
    met = _met_enough(met)
    # what has lost its company leaves too, and so may others
    again = cut_lineage(met, "met")
    del parts, met
    release(spark)  # the parts themselves, by far the largest shuffle
    met = cut_lineage(_rarest(_met_enough(again.drop("n"))), "parts")
    discard(again)
    release(spark)
    wanted = met.select("id").distinct()
    texts = known.mapInArrow(_packed, "id long, text binary")
    sets = texts.join(wanted, "id", "left_semi").mapInArrow(
        _sketched(width, percent), "id long, size long, set_key binary, band int, own binary, next binary")
    if not known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        sets = sets.dropDuplicates(["id", "set_key"])
    sets = cut_lineage(sets, "sets")
    release(spark)

    weight = met.groupBy("id").agg(F.sum("n").alias("weight"))
    comps = cut_lineage(weight.withColumn("comp", F.col("id")), "components")
    for turn in range(PIVOT_ROUNDS + 1):
        # stars join what is alike at the cost of one comparison a member; the last turn leaves no pair out
        pairs = _candidates(met, comps, sets, percent, star=turn < PIVOT_ROUNDS)
        links = verified(pairs, texts, width, percent)
        comps = _merged(comps, links)
        discard(pairs, links)
        release(spark)
    discard(met, sets)

    # rows of one id, rows of one set, and linked sets: together
    bridges = summary.where("set_key is not null and id is not null").join(classes, "set_key").select(
        F.col("id").alias("a"), F.col("rep").alias("b")).where("a != b")
    tops = bridges.join(comps.select(F.col("id").alias("b"), "comp"), "b", "left").select(
        F.col("a").alias("id"), F.coalesce("comp", "b").alias("comp"))
    # an id whose texts belong to several classes joins those
    joined = comps.select("id", "comp").union(tops).distinct()
    several = joined.groupBy("id").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"))
    final = several.select("id", F.col("low").alias("comp"))
    clash = cut_lineage(joined.join(several.where("n > 1").select("id"), "id", "left_semi"), "clash")
    if not clash.isEmpty():
        merged = components(clash.select(F.col("id").alias("a"), F.col("comp").alias("b"))).withColumnsRenamed(
            {"id": "was", "comp": "now"})
        final = final.join(merged, F.col("comp") == F.col("was"), "left").select("id", F.coalesce("now", "comp").alias("comp"))
    return summary.join(final, "id", "left").select(
        F.col("id").alias(id_column), "n_shingles", F.coalesce("comp", "id").alias("component_id"))


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after new links."""
    left = comps.select(F.col("id").alias("a"), F.col("comp").alias("comp_a"))
    right = comps.select(F.col("id").alias("b"), F.col("comp").alias("comp_b"))
    bridges = cut_lineage(links.join(left, "a").join(right, "b").where("comp_a != comp_b").select(
        F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct(), "bridges")
    if bridges.isEmpty():
        discard(bridges)
        return comps
    joined = components(bridges)
    moved = joined.withColumnsRenamed({"id": "was", "comp": "now"})
    after = cut_lineage(comps.join(moved, F.col("comp") == F.col("was"), "left").select(
        "id", "weight", F.coalesce("now", "comp").alias("comp")), "components")
    discard(bridges, joined, comps)
    return after


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **method) -> DataFrame:
    """The input rows without all but one document of each class of linked texts: the one with the smallest id stays.

    Rows that share an id are one document and stay or go together; rows with a null id stay. Null and empty texts are
    linked with nothing and stay. All columns are kept; an empty table gives no rows.
    """
    found = similarity_classes(docs, id_column, text_column, **method)
    gone = found.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("gone")).distinct()
    return docs.alias("kept").join(gone.alias("left_out"), F.col(f"kept.{id_column}").cast("long") == F.col("left_out.gone"), "left_anti")


SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""


@query("op10_parity_ngram_join", SQL)
def op10_parity_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_classes(table(spark, folder, "documents"))
