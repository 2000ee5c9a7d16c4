"""Tokenizer alignment against whole-text encodings and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from shelfline.llm import token_alignment as align

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, id int, slab string, pairs string, values int, planes string"


def tokens(text):
    """((first, last, id) of each token) of both sides by the libraries alone, or none."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(tokens, "both"):
        first = Tokenizer.from_file(public_tokenizers.path(align.BYTE_LEVEL))
        first.encode_special_tokens = True
        tokens.both = first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.PIECES))
    first, second = tokens.both
    if not text:
        return None
    raw, alphabet, sides = (" " + text).encode(), align.byte_alphabet(), []
    a = [(i, bytes(alphabet[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode())
         for i in second.encode(text) for p in [second.id_to_piece(i)]]
    for side in (a, b):
        if b"".join(x for _, x in side) != raw:
            return None
        at, spans = 0, []
        for i, x in side:
            spans.append((at, at + len(x), i))
            at += len(x)
        sides.append(spans)
    return sides


def brute(texts):
    """Expected values (n_a, n_b, n_groups, n_links, n_best, count_sum, n_alone, digest) of each text."""
    all_links, out, docs, held = Counter(), [], defaultdict(set), []
    for number, text in enumerate(texts):
        sides = tokens(text)
        held.append(sides)
        links = Counter()
        if sides:
            i = j = 0
            a, b = sides
            while i < len(a) and j < len(b):
                links[a[i][2], b[j][2]] += 1
                end_a, end_b = a[i][1], b[j][1]
                i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        all_links += links
        for pair in links:
            docs[pair].add(number)
        out.append(links)
    most = defaultdict(int)
    for (_, b), n in all_links.items():
        most[b] = max(most[b], n)
    rows = []
    for sides, links in zip(held, out, strict=True):
        if not sides:
            rows.append((0,) * 7 + ("",))
            continue
        cuts = sorted({x[1] for x in sides[0]} & {x[1] for x in sides[1]})
        written, before = [], 0
        for cut in cuts:
            written.append("|".join(",".join(str(i) for s, e, i in side if before < e <= cut) for side in sides))
            before = cut
        rows.append((len(sides[0]), len(sides[1]), len(cuts), sum(links.values()), sum(n for p, n in links.items() if all_links[p] == most[p[1]]),
                     sum(n * all_links[p] for p, n in links.items()), sum(n for p, n in links.items() if len(docs[p]) == 1),
                     hashlib.sha256(";".join(written).encode()).hexdigest()))
    return rows


def awkward():
    rng = random.Random(3)
    alphabet = ["a", "the", "Éé", " ", "  ", "\n", "\n\n", "\r\n", "\t", " ", " ", "　", "​", "日本", "😀", "é", "'s", "12345", "...",
                "<|endoftext|>", "<s>", "<0x0A>", "word.", " x", "\x00", "\x1c", "\x85", "ﬁ", "﻿", "-", "_"]
    made = ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(300)]
    made += [" ".join(rng.choices(["one", "two", "three,", "vier", "Straße"], k=rng.randint(1, 80))) for _ in range(60)]
    made += [None, "", " ", "   ", "\n", "\na", " a", "a ", "a\n", "a▁b", "▁", "x" * 3000, "same text", "same text", "ab " * 5000]
    return made


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_alone", "groups_sha256")


@pytest.mark.parametrize("few", [False, True])
def test_against_whole_texts(spark, few, monkeypatch):
    texts = awkward()[300:] if few else awkward()
    rows = [(i, t, 1, "s", "p", 2, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame([*rows, (None, None, 0, "", "", 0, "")], SCHEMA).repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.align(frame).collect()}
    assert got.pop(None) == (0,) * 7 + ("",)
    expected = brute(texts)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == expected[i], repr(text)


def test_empty_table_and_text_ids(spark):
    assert align.align(spark.createDataFrame([], SCHEMA)).collect() == []
    got = align.align(spark.createDataFrame([("k", "one two"), ("k", "one two")], "doc_id string, text string")).collect()
    assert [r["doc_id"] for r in got] == ["k", "k"]
    assert got[0] == got[1]


def test_units_are_whole_texts_again():
    units = align._units(align.BYTE_LEVEL, align.PIECES)
    assert units.cuts
    texts = [t for t in awkward() if t]
    row, code, keys = units.split(pa.array(texts))
    again = [""] * len(texts)
    for r, c in zip(row, code, strict=True):
        again[r] += keys[c] if keys[c][:1] in (" ", "\n") else " " + keys[c]
    assert again == [" " + t for t in texts]


def test_texts_encoded_whole_give_the_same():
    units = align.Units(*(public_tokenizers.path(p) for p in (align.BYTE_LEVEL, align.PIECES)))
    texts = pa.array([t for t in awkward() if t])
    found = []
    for units.cuts in (True, False):
        units.forget()
        row, code, keys = units.split(texts)
        place = units.places(keys)[code]
        ends = np.cumsum(np.bincount(row, minlength=len(texts)))
        good = np.bincount(row, weights=1 - units.counts[4, place]) == 0
        found.append([d if ok else "" for d, ok in zip(align._digests(units, place, ends), good, strict=True)])
    assert found[0] == found[1]


def test_long_text_is_written_in_parts(monkeypatch):
    units = align._units(align.BYTE_LEVEL, align.PIECES)
    texts = pa.array(["one two three " * 40, "four", "five six " * 30])
    row, code, keys = units.split(texts)
    place, ends = units.places(keys)[code], np.cumsum(np.bincount(row))
    whole = align._digests(units, place, ends)
    for written in (1, 7, 100):
        monkeypatch.setattr(align, "WRITTEN", written)
        assert align._digests(units, place, ends) == whole


def test_planes():
    rng = np.random.default_rng(1)
    for rows in (1, 5, 1000):
        for _ in range(20):
            n = int(rng.integers(0, 3000))
            pair, row, times = rng.integers(0, 40, n) ** 2, rng.integers(0, rows, n), rng.integers(1, 300, n)
            expected = Counter()
            for p, r, t in zip(pair.tolist(), row.tolist(), times.tolist(), strict=True):
                expected[p, r] += t
            distinct, planes = align.postings(pair, row, times, rows)
            total, got = np.zeros(len(distinct), np.int64), Counter()
            for k, plane in enumerate(planes):
                total += align.popcounts(plane, len(distinct), rows) << max(0, k - 1)
                for p, r in zip(*align.unpack_plane(plane, len(distinct), rows), strict=True):
                    got[int(distinct[p]), int(r)] += 1 << max(0, k - 1)
            assert got == expected
            assert total.tolist() == [sum(t for (q, _), t in expected.items() if q == p) for p in distinct.tolist()]
