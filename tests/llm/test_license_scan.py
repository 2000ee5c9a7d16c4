"""Licence scan against plain loops over every place, and its base columns against SQL."""

from __future__ import annotations

import math
import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import check  # noqa: E402

from shelfline.llm import license_scan as scan  # noqa: E402
from shelfline.llm.registry import table  # noqa: E402

SCHEMA = "doc_id long, text string, id int, words string, present int, base string, index string, matches string, places int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, templates=scan.TEMPLATES, base=scan.BASE, rare=scan.RARE, agree=scan.AGREE):
    lists = [words_of(t) for t in texts]
    vocabulary = {w for t in templates for w in t.words} | {w for _, p in base for w in p.split()}
    weight = {w: math.log((len(texts) + 1) / (sum(w in words for words in map(set, lists)) + 1)) + 0.01 for w in vocabulary}
    out = []
    for words in lists:
        places, own, labels, score = [], set(), set(), 0.0
        for label, phrase in base:
            phrase = phrase.split()
            found = [i for i in range(len(words)) if words[i: i + len(phrase)] == phrase]
            places += found
            own |= {label} if found else set()
        for t in templates:
            chosen = set(sorted({w for w in t.words if w in words}, key=lambda w: (-weight[w], w))[:rare])
            need = min(agree, sum(w in chosen for w in t.words))
            for shift in range(-len(t.words), len(words)):
                at = lambda j: words[shift + j] if 0 <= shift + j < len(words) else None  # noqa: B023, E731
                agreed = sum(w in chosen and at(j) == w for j, w in enumerate(t.words))
                if agreed >= max(need, 1) and all(words[shift + p: shift + p + len(f)] == f and shift + p >= 0 for p, f in t.phrases):
                    labels.add(t.label)
                    score = max(score, sum(weight[w] for j, w in enumerate(t.words) if at(j) == w) / sum(weight[w] for w in t.words))
        out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)),
                    ",".join(sorted(own | labels)), 1.0 if places else score))
    return out


def awkward():
    rng = random.Random(9)
    notices = [t.notice.replace("[", "").replace("]", "") for t in scan.TEMPLATES]
    vocabulary = scan.licence_words(scan.TEMPLATES, scan.BASE)
    texts = [None, "", " \n ", "License", "cc by", "CC-BY-NC", "under the MIT License. Under THE mit license", "word " * 20_000 + "cc by nc"]
    texts += notices
    texts += [n.upper().replace(" ", " - ") for n in notices]
    for n in notices:  # cut, changed, in the middle of others
        w = n.split()
        texts += [" ".join(w[1:]), " ".join(w[:-1]), " ".join(w[len(w) // 2:])]
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), "before it " + " ".join(w) + " and " + rng.choice(notices) + " after"]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(60)]
    texts += [" ".join(rng.choices(["cc", "by", "nc", "sa", "4", "0", "licensed", "under"], k=200)) for _ in range(10)]
    return texts


def test_against_every_place(spark):
    texts = awkward()
    rows = [(i, t, 1, "w", 2, "b", "i", "m", 3) for i, t in enumerate(texts)] + [(None, texts[6], None, None, None, None, None, None, None)]
    got = {r["doc_id"]: tuple(r)[1:] for r in scan.scan(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    expected = brute([*texts, texts[6]])
    assert len(got) == len(rows)
    for i, row in enumerate(expected):
        mine = got[i if i < len(texts) else None]
        assert mine[:-1] == row[:-1], texts[i]
        assert mine[-1] == pytest.approx(row[-1], abs=1e-12)
    labels = {x for _, _, _, _, _, found, _ in expected for x in found.split(",") if x}
    assert labels == {t.label for t in scan.TEMPLATES}


def test_plain_templates():
    for t in scan.TEMPLATES:
        assert t.phrases
        assert all(t.words[p: p + len(f)] == f for p, f in t.phrases)


def test_empty_and_repeated(spark):
    assert scan.scan(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = scan.scan(spark.createDataFrame([("k", "CC BY-SA 4.0, licensed under CC BY-SA")] * 2, "doc_id string, text string")).collect()
    assert len(twice) == 2
    assert twice[0] == twice[1]
    assert twice[0]["labels"] == "cc-by-sa"


BASE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(label, words) AS (VALUES ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])),
hits AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(words)] = words)) AS place FROM d, p)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id GROUP BY ALL
"""


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="query tables not present")
def test_base_columns_equal_sql(spark):
    got = scan.scan(table(spark, FOLDER, "documents")).drop("labels", "score").collect()
    assert sorted(map(tuple, got)) == sorted(check.connect(FOLDER).execute(BASE_SQL).fetchall())
    assert sum(r["n_base"] for r in got) > 0
