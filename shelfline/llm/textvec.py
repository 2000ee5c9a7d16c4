"""Arrow batches of texts as flat numpy arrays of words and word hashes, for operators that run Python in tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Characters of text that are handled at once; a longer single text is handled alone.
PIECE_CHARS = 6_000_000


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches between rows so that each piece has about ``most`` bytes of text at the most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(offsets of each text's words, all words): pieces between ASCII white space; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at the ends leaves empty words
    if not real.all():
        flat = flat.filter(pa.array(real))
        offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
    return offsets, flat


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, the distinct words)."""
    encoded = flat.dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def strings(array: pa.Array) -> list[str]:
    """Python strings of an array without nulls."""
    return array.to_numpy(zero_copy_only=False).tolist()


def hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in strings(distinct)), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` neighbouring values, by doubling; shorter than the input by ``width - 1``."""
    if len(codes) < width:
        return codes[:0]
    done, out = 1, mix(codes)
    while done < width:
        step = min(done, width - done)
        out = mix(out[:-step] * np.uint64(0x9E3779B97F4A7C15) + out[step:] + np.uint64(done))
        done += step
    return out


def inside(offsets: np.ndarray, width: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window that lies inside one text, row of its text); windows start at each word."""
    lengths = np.maximum(np.diff(offsets) - (width - 1), 0)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    starts = np.arange(len(rows)) - first[rows] + offsets[:-1][rows]
    return starts, rows
