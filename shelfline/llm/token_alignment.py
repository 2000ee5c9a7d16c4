"""Alignment of two tokenizers by inverted pair bitmaps.

Two tokenizations of one text are laid over its bytes. Tokens whose byte ranges overlap are linked; where both end,
groups are cut. For every pair of ids the documents that link it are kept as compressed bitmaps: documents are numbered
in slabs of some thousands, and in a slab a pair has one bitmap of the documents that link it and multiplicity planes,
the bits of how often beyond once (a sorted list of places where few are set, plain bits where many are). Slabs hold
different documents, so the OR of their bitmaps has the sum of their popcounts as its own: that gives a pair's document
count, and the planes, weighted by powers of two, its link count. Counts go back to the slabs along the pairs, and
there the postings hand them to their documents. No table of links is ever written.

Tokenizing cuts a text where both tokenizers must end a token: before a space or line feed that stands alone between
other characters. What lies between is encoded once and remembered by the task. Whether the tokenizers allow that is
looked up in their vocabularies; otherwise a text is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import textvec
from .registry import query, table

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: What may be white space to a tokenizer; a unit that holds some beside its first character is encoded alone.
WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}"
ODD = re.compile(f".[^▁]*[▁{re.sub(r'x\{([0-9A-F]+)\}', lambda m: 'u' + m[1].rjust(4, '0'), WHITE)}]", re.S)
#: Units and characters that a task remembers, units that are encoded as one text, documents of a slab.
REMEMBERED, REMEMBERED_CHARS, TOGETHER, SLAB_ROWS = 300_000, 20_000_000, 4000, 50_000
#: Units whose groups are written out at once.
WRITTEN = 400_000


def byte_alphabet() -> dict[str, int]:
    """Byte of each character in a byte-level vocabulary: printable ones stand for themselves, the others follow 255."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Units:
    """Both tokenizations of units of text, with a memory of those seen before."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_level)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet = byte_alphabet()
        self.bytes_a = [bytes(alphabet.get(c, 0) for c in self.first.id_to_token(i) or "") for i in range(self.first.get_vocab_size())]
        names = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.second.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        rules = str(self.first.pre_tokenizer)
        # a space inside a piece, or a line feed in one, could join what is cut here
        self.cuts = "ByteLevel" in rules and "use_regex=True" in rules and self.first.normalizer is None and not any(
            re.search("[^▁]▁", n) or "\n" in n for n in names)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.counts = np.zeros((5, 0), np.int64)  # tokens of each side, groups, links, whether the bytes agree
        self.starts, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(row of each unit, its code, the keys by code): what each non-empty text is made of.

        A key is the unit's text; the space before a unit without white space inside is left out.
        """
        if not self.cuts:
            whole = [" " + t for t in texts.to_pylist()]
            return np.arange(len(whole)), np.arange(len(whole)), whole
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        codes, distinct = textvec.coded(flat)
        rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
        keys = textvec.strings(distinct)

        def of(pattern: str) -> np.ndarray:
            return pc.match_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False)[codes]

        filled = (pc.binary_length(distinct).to_numpy(zero_copy_only=False) > 0)[codes]
        line, open_line, white = of("^\n"), of(f"^\n[^{WHITE}]"), of(f"^[{WHITE}]")
        after_text = np.concatenate(([False], filled[:-1]))
        after_white = np.concatenate(([False], of(f"[{WHITE}]\\z")[:-1]))
        start = np.where(line, open_line & after_text & ~after_white, filled & ~white & after_text)
        start[offsets[:-1]] = True
        if start.all():
            return rows, codes, keys
        begin = np.flatnonzero(start)
        length = np.diff(np.append(begin, len(codes)))
        own, glued = codes[begin], {}
        for i in np.flatnonzero(length > 1):
            parts = [keys[c] for c in codes[begin[i]: begin[i] + length[i]]]
            key = parts[0] + "".join(p if p.startswith("\n") else " " + p for p in parts[1:])
            key = key if key.startswith("\n") and line[begin[i]] else " " + key
            own[i] = glued.setdefault(key, len(keys) + len(glued))
        return rows[begin], own, keys + list(glued)

    def places(self, keys: list[str]) -> np.ndarray:
        """Where each key is remembered, after encoding those that are not."""
        fresh = [k for k in keys if k not in self.place]
        if fresh:
            self._learn(fresh)
        return np.fromiter((self.place[k] for k in keys), np.int64, len(keys))

    def _learn(self, keys: list[str]) -> None:
        self.chars += sum(map(len, keys))
        units = {k: k if k[:1] in (" ", "\n") else " " + k for k in keys}
        plain = [k for k, u in units.items() if self.cuts and not ODD.match(u)]
        plain.sort(key=lambda k: units[k][0] == "\n")  # a line feed never comes first but alone
        odd = sorted(units.keys() - plain) if len(plain) < len(keys) else []
        for a in range(0, len(plain), TOGETHER):
            some = plain[a: a + TOGETHER]
            text = "".join(units[k] for k in some)
            (ids_a,), (ids_b,) = self._encode([text])
            sizes = np.array([len(units[k].encode()) for k in some], np.int64)
            if self._agree(text, ids_a, ids_b) and self._ends(sizes, ids_a, ids_b):
                self._keep(some, sizes, np.array(ids_a, np.int64), np.array(ids_b, np.int64))
            else:
                odd += some
        for a in range(0, len(odd), TOGETHER):
            some = odd[a: a + TOGETHER]
            both = list(zip(some, *self._encode([units[k] for k in some]), strict=True))
            right = [x for x in both if self._agree(units[x[0]], x[1], x[2])]
            if right:
                flat = [np.array([i for x in right for i in x[side]], np.int64) for side in (1, 2)]
                self._keep([x[0] for x in right], np.array([len(units[x[0]].encode()) for x in right], np.int64), *flat)
            wrong = [x[0] for x in both if not self._agree(units[x[0]], x[1], x[2])]
            if wrong:
                self.place.update(zip(wrong, range(len(self.groups), len(self.groups) + len(wrong)), strict=True))
                self.groups += [""] * len(wrong)
                self.counts = np.concatenate((self.counts, np.zeros((5, len(wrong)), np.int64)), axis=1)
                self.starts = np.concatenate((self.starts, np.full(len(wrong), self.starts[-1])))

    def _encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units that begin with a space or line feed; the second tokenizer adds the space itself."""
        ids_a = [e.ids for e in self.first.encode_batch_fast(units, add_special_tokens=False)]
        ids_b = self.second.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return ids_a, [ids if u[0] == " " else ids[1:] for u, ids in zip(units, ids_b, strict=True)]

    def _agree(self, text: str, ids_a: list[int], ids_b: list[int]) -> bool:
        raw = text.encode()
        return b"".join([self.bytes_a[i] for i in ids_a]) == raw == b"".join([self.bytes_b[i] for i in ids_b])

    def _ends(self, sizes: np.ndarray, ids_a: list[int], ids_b: list[int]) -> bool:
        ends = np.cumsum(sizes)
        return all(np.isin(ends, np.cumsum(size[ids])).all() for size, ids in ((self.size_a, ids_a), (self.size_b, ids_b)))

    def _keep(self, keys: list[str], sizes: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> None:
        """Groups and links of units in a row whose tokens end where the units end."""
        units, ends_a, ends_b = np.cumsum(sizes), np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        cuts, stretches = np.intersect1d(ends_a, ends_b), np.union1d(ends_a, ends_b)
        # every stretch between two ends lies in one token of each side, and no two stretches in the same two
        links = ids_a[np.searchsorted(ends_a, stretches)] * len(self.bytes_b) + ids_b[np.searchsorted(ends_b, stretches)]
        counts = np.stack([*(np.bincount(np.searchsorted(units, x), minlength=len(units)) for x in (ends_a, ends_b, cuts, stretches)),
                           np.ones(len(units), np.int64)])
        group = np.concatenate((np.searchsorted(cuts, ends_a) * 2, np.searchsorted(cuts, ends_b) * 2 + 1))
        order = np.argsort(group, kind="stable")
        group, ends = group[order], np.concatenate((ends_a, ends_b))[order]
        last = np.append(group[1:] != group[:-1], True)
        closes = last & (group % 2 == 1)
        mark = np.where(~last, ",", np.where(~closes, "|", np.where(np.isin(ends, units), "", ";")))
        written = pc.binary_join_element_wise(pc.cast(pa.array(np.concatenate((ids_a, ids_b))[order]), pa.string()),
                                              pa.array(mark.tolist(), pa.string()), "")
        bounds = np.concatenate(([0], np.flatnonzero(closes & np.isin(ends, units)) + 1))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), written), "")
        self.place.update(zip(keys, range(len(self.groups), len(self.groups) + len(keys)), strict=True))
        self.groups += joined.to_pylist()
        self.counts = np.concatenate((self.counts, counts), axis=1)
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(counts[3])))
        self.links = np.concatenate((self.links, links))


def pack_plane(pair: np.ndarray, row: np.ndarray, pairs: int, rows: int) -> bytes:
    """Bitmaps of ``pairs`` pairs over ``rows`` places; the set places come sorted by pair.

    Counts of all pairs first; then a pair with over a sixteenth of the places as plain bits, another as a list.
    """
    count = np.bincount(pair, minlength=pairs).astype(np.uint32)
    dense = count > rows // 16
    in_dense = dense[pair]
    number = np.cumsum(dense) - 1
    bits = np.zeros((int(dense.sum()), rows), bool)
    bits[number[pair[in_dense]], row[in_dense]] = True
    return count.tobytes() + np.packbits(bits, axis=1).tobytes() + row[~in_dense].astype(np.uint16).tobytes()


def unpack_plane(plane: bytes, pairs: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, place) of every set bit."""
    count = np.frombuffer(plane, np.uint32, pairs)
    dense = np.flatnonzero(count > rows // 16)
    width, at = -(-rows // 8), 4 * pairs
    bits = np.unpackbits(np.frombuffer(plane, np.uint8, len(dense) * width, at).reshape(len(dense), width), axis=1, count=rows)
    own, place = np.nonzero(bits)
    few = np.where(count > rows // 16, 0, count)
    listed = np.frombuffer(plane, np.uint16, int(few.sum()), at + len(dense) * width)
    return np.concatenate((dense[own], np.repeat(np.arange(pairs), few))), np.concatenate((place, listed)).astype(np.int64)


def popcounts(plane: bytes, pairs: int, rows: int) -> np.ndarray:
    """Set bits of each pair's bitmap."""
    count = np.frombuffer(plane, np.uint32, pairs).astype(np.int64)
    dense = np.flatnonzero(count > rows // 16)
    width = -(-rows // 8)
    if len(dense):
        bits = np.frombuffer(plane, np.uint8, len(dense) * width, 4 * pairs).reshape(len(dense), width)
        count[dense] = np.bitwise_count(bits).sum(axis=1)
    return count


def postings(pair: np.ndarray, row: np.ndarray, times: np.ndarray, rows: int) -> tuple[np.ndarray, list[bytes]]:
    """(different pairs, planes) of links: documents first, then the bits of ``times - 1`` summed by pair and row."""
    order = np.argsort(pair * (1 << 16) + row)
    pair, row, times = pair[order], row[order], times[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    more = (np.add.reduceat(times, at) if len(at) else times) - 1
    pair, row = pair[at], row[at]
    distinct, number = np.unique(pair, return_inverse=True)
    planes = [pack_plane(number, row, len(distinct), rows)]
    while more.any():
        held = (more & 1) == 1
        planes.append(pack_plane(number[held], row[held], len(distinct), rows))
        more = more >> 1
    return distinct, planes


_LOADED: dict[tuple[str, str], Units] = {}


def _units(byte_level: str, pieces: str) -> Units:
    """The tokenizers of a task, loaded once; a bare name stands for a file of the public tokenizers."""
    if (byte_level, pieces) not in _LOADED:
        paths = []
        for name in (byte_level, pieces):
            if "/" not in name:
                import public_tokenizers

                name = public_tokenizers.path(name)
            paths.append(name)
        _LOADED[byte_level, pieces] = Units(*paths)
    return _LOADED[byte_level, pieces]


def _digests(units: Units, place: np.ndarray, ends: np.ndarray) -> list[str]:
    """Digest of the groups of each text; ``ends``: units up to and with each text."""
    out: list[str] = []
    starts = np.concatenate(([0], ends[:-1]))
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + WRITTEN, side="right")))
        used, code = np.unique(place[starts[i]: ends[j - 1]], return_inverse=True)
        names = pa.array([units.groups[p] for p in used], pa.string())
        if j > i + 1 or ends[i] - starts[i] <= WRITTEN:
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts[i:j], ends[j - 1]) - starts[i], pa.int32()), names.take(pa.array(code)))
            out += [hashlib.sha256(x.as_buffer()).hexdigest() if x.as_py() else "" for x in pc.binary_join(lists, ";")]
        else:  # one very long text: a part at a time
            digest = hashlib.sha256()
            for a in range(0, len(code), WRITTEN):
                digest.update((";" if a else "").encode() + ";".join(names.take(pa.array(code[a: a + WRITTEN])).to_pylist()).encode())
            out.append(digest.hexdigest())
        i = j
    return out


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _slabs(byte_level: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(byte_level, pieces)
        slab = TaskContext.get().partitionId() << 32
        for whole in textvec.pieces(batches):
            for at in range(0, whole.num_rows, SLAB_ROWS):
                piece = whole.slice(at, SLAB_ROWS)
                if len(units.groups) > REMEMBERED or units.chars > REMEMBERED_CHARS:
                    units.forget()
                rows, texts = piece.num_rows, piece.column("text")
                filled = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
                row, code, keys = units.split(texts.take(pa.array(filled)))
                place = units.places(keys)[code]
                good = np.bincount(row, weights=1 - units.counts[4, place], minlength=len(filled)) == 0
                digests = np.full(rows, "", object)
                digests[filled] = _digests(units, place, np.cumsum(np.bincount(row, minlength=len(filled))))
                digests[filled[~good]] = ""
                row, place = filled[row[good[row]]], place[good[row]]
                counts = [np.bincount(row, weights=units.counts[k, place], minlength=rows).astype(np.int64) for k in range(4)]
                # links of every different unit of a document, times the unit's places there
                size = len(units.groups)
                both, times = np.unique(row * size + place, return_counts=True)
                place, row = both % size, both // size
                n = units.counts[3, place]
                before = np.cumsum(n) - n
                link = units.links[np.repeat(units.starts[place] - before, n) + np.arange(int(n.sum()))]
                pairs, planes = postings(link, np.repeat(row, n), np.repeat(times, n), rows)
                n_docs = popcounts(planes[0], len(pairs), rows)
                n_links = n_docs.copy()
                for k, plane in enumerate(planes[1:]):
                    n_links += popcounts(plane, len(pairs), rows) << k
                columns = [pa.array([slab]), pa.array([piece.column("id").to_pylist()], pa.list_(piece.column("id").type)),
                           *[pa.array([c]) for c in counts], pa.array([digests.tolist()], pa.list_(pa.string())),
                           *[pa.array([c], pa.list_(pa.int64())) for c in (pairs, n_docs, n_links)], pa.array([planes], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["slab", "ids", *COUNTS, "digests", "pairs", "n_docs", "n_pair_links", "planes"])
                slab += 1

    return run


def _weighed(row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Sums of whole weights by row; two halves keep them exact as floating-point numbers."""
    low, high = weight & ((1 << 26) - 1), weight >> 26
    return sum((np.bincount(row, weights=part, minlength=rows).astype(np.int64) << shift for part, shift in ((low, 0), (high, 26))),
               np.zeros(rows, np.int64))


def _returned(kind: pa.DataType):
    """Documents of slabs, with what their pairs' postings return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, *counts, digests = (batch.column(n)[i].values for n in ("ids", *COUNTS, "digests"))
                rows = len(ids)
                sums = np.zeros((3, rows), np.int64)
                if batch.column("values")[i].is_valid:
                    values = batch.column("values")[i].values
                    weights = [values.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("best", "links", "alone")]
                    for k, plane in enumerate(batch.column("planes")[i].as_py()):
                        pair, row = unpack_plane(plane, len(values), rows)
                        for j, weight in enumerate(weights):
                            sums[j] += _weighed(row, weight[pair], rows) << max(0, k - 1)
                yield pa.RecordBatch.from_arrays([ids, *counts, *[pa.array(s) for s in sums], digests],
                                                 ["id", *COUNTS, "n_best", "count_sum", "n_alone", "groups_sha256"])

    return run


def aligned_slabs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", byte_level: str = BYTE_LEVEL,
                  pieces: str = PIECES) -> DataFrame:
    """Documents by slabs, with the slab's pairs and their bitmaps; written, since slabs are numbered as tasks come.

    A pair is the first tokenizer's id times the second's number of ids, plus the second's id.
    """
    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return cut_lineage(rows.mapInArrow(_slabs(byte_level, pieces), f"slab long, ids array<{kind}>, " + "".join(
        f"{n} array<long>, " for n in COUNTS) + "digests array<string>, pairs array<long>, n_docs array<long>, n_pair_links array<long>, "
        "planes array<binary>"), "slabs")


def pair_counts(slabs: DataFrame) -> DataFrame:
    """(pair, docs, links) over all slabs: the popcounts of the pair's merged bitmaps."""
    found = slabs.select(F.explode(F.arrays_zip("pairs", "n_docs", "n_pair_links")).alias("x"))
    return found.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n_docs").alias("docs"), F.sum("x.n_pair_links").alias("links"))


def align(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", byte_level: str = BYTE_LEVEL,
          pieces: str = PIECES, second_ids: int | None = None) -> DataFrame:
    """Per row of ``docs`` how two tokenizers cut its text, after a space.

    Columns: the id, tokens ``n_a`` and ``n_b``, ``n_groups`` between common ends, ``n_links`` (overlapping tokens),
    ``n_best`` (links whose pair is the most frequent of its second id in the corpus, ties included), ``count_sum`` (sum over links
    of the pair's links in the corpus), ``n_alone`` (links whose pair no other document has), ``groups_sha256`` (of the
    groups' ids). ``second_ids`` is the number of ids of the second tokenizer, looked up if not given.

    A text that is null, empty, or that one of the tokenizers does not give back byte for byte has no tokens: zeros and
    an empty digest. Repeated rows count each on its own; null ids are kept; an empty table gives no rows; other columns
    stay aside.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_column].dataType
    if second_ids is None:
        second_ids = len(_units(byte_level, pieces).bytes_b)
    slabs = aligned_slabs(docs, id_column, text_column, byte_level, pieces)
    counts = cut_lineage(pair_counts(slabs).withColumn("second", F.pmod("pair", F.lit(second_ids))), "pair-counts")
    highest = counts.groupBy("second").agg(F.max("links").alias("most"))
    values = counts.join(highest, "second").select(
        "pair", "links", (F.col("links") == F.col("most")).alias("best"), (F.col("docs") == 1).alias("alone"))
    asked = slabs.select("slab", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(values, "pair").groupBy("slab").agg(
        F.array_sort(F.collect_list(F.struct("place", "links", "best", "alone"))).alias("values"))
    back = slabs.select("slab", "ids", *COUNTS, "digests", "planes").join(answers, "slab", "left").drop("slab")
    schema = f"id {kind.simpleString()}, " + "".join(f"{n} long, " for n in (*COUNTS, "n_best", "count_sum", "n_alone")) + "groups_sha256 string"
    return back.mapInArrow(_returned(to_arrow_type(kind)), schema).withColumnRenamed("id", id_column)


@query("op13_pair_bitmap_alignment")
def op13_pair_bitmap_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align(table(spark, folder, "documents"))
