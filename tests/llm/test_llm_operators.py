"""Operators on a small table of awkward rows, against plain Python."""

from __future__ import annotations

import hashlib
import html
import itertools
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import functions as F  # noqa: E402

from shelfline.llm import (decontamination, html_wrappers, language_id, lm_scoring, ngram_join, packing,  # noqa: E402
                           quality_rules, sharding, substring_dedup, toxicity)

SCHEMA = "doc_id long, text string, lang string, length int, place int, label string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(5, 160)) for _ in range(25)]
    out = {i: t for i, t in enumerate(base)}
    long = sentence(rng, 3000)
    out[30], out[31] = long, long + " tail"
    for i in range(40, 60):  # near copies of one text
        words = base[3].split()
        words[rng.randrange(len(words))] = "changed"
        out[i] = " ".join(words)
    for i in range(60, 66):  # exact copies
        out[i] = base[4]
    passage = sentence(rng, 70)
    for i in range(70, 78):
        out[i] = sentence(rng, 20) + "\n" + passage + "  " + sentence(rng, rng.randint(0, 15))
    out |= {80: None, 81: "", 82: " \t\n ", 83: "One", 84: "one two THREE", 85: "x " * 200, 86: "Ünï çødé 😀 straße"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, v, "xx", 1, 2, "l") for k, v in texts.items()] + [(83, "One", "xx", 1, 2, "l"), (None, texts[1], None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def words(text):
    return WORD.findall(text or "")


def test_sharding_is_minimax_and_whole(docs, nothing, texts):
    got = sharding.minimax_shards(docs, 5).collect()
    assert len(got) == docs.count()
    groups, sizes = {}, Counter()
    for r in got:
        text = texts.get(r["doc_id"], texts[1]) or ""
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        groups.setdefault(text, r["shard"])
        assert groups[text] == r["shard"]
        sizes[r["shard"]] += r["size"]
    for shard in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    each = Counter()
    for r in got:
        each[hashlib.sha256((texts.get(r["doc_id"], texts[1]) or "").encode()).hexdigest()] += r["size"]
    atoms = [each[k] for k in sorted(each)]

    def fits(capacity):
        used, left = 1, capacity
        for a in atoms:
            if a > capacity:
                return False
            if a > left:
                used, left = used + 1, capacity
            left -= a
        return used <= 5

    assert max(sizes.values()) == got[0]["capacity"] == next(c for c in range(1, sum(atoms) + 1) if fits(c))
    assert sharding.minimax_shards(nothing, 5).count() == 0


def test_quality_measures(docs, nothing, texts):
    for i, rows in by_id(quality_rules.quality(docs)).items():
        text = texts.get(i, texts[1]) or ""
        found = words(text)
        at = defaultdict(list)
        for k in range(len(found) - 7):
            at[tuple(found[k: k + 8])].append(k)
        repeated = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
        for r in rows:
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(found), sum(map(len, found)), len(repeated))
            assert r["base_failed"] == (len(found) < 20 or 100 * len(repeated) > 30 * len(found))
            assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality(nothing).count() == 0


def test_rules_learn_which_votes_to_trust():
    # rule 0 is right, rule 1 votes at random
    rng = random.Random(1)
    patterns = Counter()
    for _ in range(5000):
        good = rng.random() < 0.9
        patterns[("2" if good else "0") + rng.choice("02") + ("2" if good or rng.random() < 0.3 else "0")] += 1
    _, _, p = quality_rules.fit_rules(list(patterns.items()), 3)
    assert p["202"] > 0.5 > p["020"] and p["222"] > 0.5 > p["000"]


def test_correlated_rules_and_two_kinds_of_damage():
    # rules 0-2 see junk, all of them or none; rules 3-4 see shouting; rule 4 also alarms on one good text in a hundred
    rng = random.Random(4)
    patterns, truth = Counter(), defaultdict(list)
    for _ in range(20_000):
        kind = rng.choices(["good", "junk", "loud"], [0.9, 0.07, 0.03])[0]
        junk, loud = kind == "junk" and rng.random() < 0.95, kind == "loud" and rng.random() < 0.95
        found = ("000" if junk else rng.choice(["222", "222", "221"])) + ("0" if loud else "2") + (
            "0" if loud or (kind == "good" and rng.random() < 0.001) else "2")
        patterns[found] += 1
        truth[found].append(kind == "good")
    groups = [[0, 1, 2], [3, 4]]
    merged = Counter()
    for p, n in patterns.items():
        merged[quality_rules.together(p, groups)] += n
    share, rates, p_good = quality_rules.fit_rules(list(merged.items()), 2, kinds=[(0,), (1,)])
    assert 0.85 < share < 0.95
    assert all(on_bad > on_good for on_bad, on_good in rates)
    judged = [(p_good[quality_rules.together(p, groups)] >= 0.5, good) for p, all_ in truth.items() for good in all_]
    assert sum(k for k, good in judged if good) / sum(good for _, good in judged) > 0.98
    assert sum(not k for k, good in judged if not good) / sum(not good for _, good in judged) > 0.9


def test_alarms_are_never_a_sign_of_quality():
    # most texts that alarm on rule 1 are otherwise fine, and few of the damaged do
    share, rates, p = quality_rules.fit_rules([("22", 900), ("20", 60), ("02", 40)], 2)
    assert all(on_bad >= on_good for on_bad, on_good in rates)
    assert p["20"] <= p["22"] and p["02"] <= p["22"]


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="tables not present")
def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.1"
    judged = quality_rules.quality(spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed").join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in judged}
    assert kept[0] <= 0.1 and kept[1] >= 0.98, kept


def test_decontamination(spark, docs, nothing, texts):
    passage = texts[70].split("\n")[1].split("  ")[0].split()
    items = spark.createDataFrame([(1, " ".join(passage[10:30]).upper()), (2, "unseen words only here"), (3, "one TWO"), (3, "one TWO"),
                                   (4, None), (None, "x x x"), (5, " ".join(passage[30:43])), (6, "")], "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    listed = [(r["item_id"], split(r["text"])) for r in items.collect() if r["item_id"] is not None and r["text"]]
    for i, rows in by_id(decontamination.decontaminate(docs, items)).items():
        own = split(texts.get(i, texts[1]))
        hit, found = set(), set()
        for item, w in listed:
            n = min(13, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                for j in range(len(own) - n + 1):
                    if own[j: j + n] == w[k: k + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item))
        for r in rows:
            assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(own), len(hit), len(found)), i
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(own))
    assert decontamination.decontaminate(nothing, items).count() == 0
    assert not decontamination.decontaminate(docs, items.limit(0)).where("contaminated").count()
    bad = {r["doc_id"] for r in decontamination.decontaminate(docs, items).where("contaminated").collect()}
    left = decontamination.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == (set(texts) | {None}) - bad


def test_span_cover_and_digests(docs, nothing, texts):
    assert substring_dedup.is_cover(substring_dedup.PERIOD, substring_dedup.COVER)
    first = defaultdict(lambda: 10**9)
    for i, t in texts.items():
        w = words(t)
        for k in range(len(w) - 49):
            first[tuple(w[k: k + 50])] = min(first[tuple(w[k: k + 50])], i)
    for i, rows in by_id(substring_dedup.span_digests(docs)).items():
        w = words(texts.get(i, texts[1]))
        gone = {p for k in range(len(w) - 49) if i is not None and first[tuple(w[k: k + 50])] < i for p in range(k, k + 50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        for r in rows:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i
    cut = substring_dedup.deduplicate_spans(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert substring_dedup.span_digests(nothing).count() == 0


def test_similarity_classes(docs, nothing, texts):
    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w)} if 0 < len(w) < 4 else {tuple(w[k: k + 4]) for k in range(len(w) - 3)}

    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] > label[b]:
                    label[a], changed = label[b], True
    found = by_id(ngram_join.similarity_classes(docs))
    for i in texts:
        for r in found[i]:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), label[i]), i
    assert found[None][0]["component_id"] is None
    assert len(set(label.values())) < len(label) - 10  # the fixture holds exact and near copies
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(label.values()) | {None}
    assert ngram_join.similarity_classes(nothing).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5, 6, 7, 30, 400, 5000])
def test_sketches_never_exceed_the_difference(size):
    rng = np.random.default_rng(size)
    assert ngram_join.band_ends(size * 2, 85)[-1] >= size * 2
    sets = ngram_join.Sets(pa.array([" ".join(map(str, rng.integers(0, 10**6, size + 3))), ""]), 4)
    other = sets.values.copy()
    changed = max(1, size // 20)
    other[rng.choice(size, changed, replace=False)] = rng.integers(0, 2**63, changed).astype(np.uint64)
    other.sort()
    twin = ngram_join.Sets(pa.array([None], pa.string()), 4)
    twin.values, twin.rows = other, np.zeros(size, np.int64)
    twin.sizes, twin.starts = np.array([size]), np.array([0])
    a, b = (s.sketches(np.array([0]), 0, 85) for s in (sets, twin))
    assert np.bitwise_count(a[5] ^ b[5]).sum() <= 2 * changed
    assert (a[3] != b[3]).sum() <= 2 * changed


def test_texts_that_meet_often_are_compared_once(spark, monkeypatch):
    """Texts of many common parts: one part stands for all with the same texts, and each text leaves its fullest parts out."""
    need = lambda n: (7 << ngram_join.NEED_BITS) | n
    rows = [(key, need(3), i) for key in range(12) for i in (1, 2)] + [(20, need(3), i) for i in (1, 2, 3, 4)]
    met = spark.createDataFrame(rows, "key long, slot int, id long").withColumn("n", F.when(F.col("key") == 20, 4).otherwise(2))
    left = ngram_join._rarest(met)
    kept = {(r.key, r.id) for r in left.collect()}
    assert kept == {(key, i) for key in range(11) for i in (1, 2)}  # 20 and 11, the last of the others, go
    sets = spark.createDataFrame([(1, 9, 7, b"\0" * 9, None), (2, 9, 7, b"\0" * 9, None)], "id long, size long, band int, own binary, next binary")
    comps = spark.createDataFrame([(1, 1, 1), (2, 2, 1)], "id long, comp long, weight long")
    with monkeypatch.context() as patch:
        patch.setattr(ngram_join, "_compare", lambda *_: lambda pdf: pd.DataFrame({"a": [pdf["sketch"].isna().sum()], "b": [pdf["sketch"].count()]}))
        seen = [tuple(r) for r in ngram_join._candidates(left, comps, sets, 85, star=True).collect()]
    assert seen == [(2, 2)]
    assert [tuple(r) for r in ngram_join._candidates(left, comps, sets, 85, star=False).collect()] == [(1, 2)]


def test_token_pieces_equal_the_tokenizer(docs, nothing, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    got = packing.pack_documents(docs, most=256).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, rows in pieces.items():
        ids = np.array(plain.encode(texts.get(i, texts[1]) or "", add_special_tokens=False).ids + [2], "<u4")
        covered = Counter()
        for r in rows:
            part = ids[r["start"]: r["start"] + r["length"]]
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
            covered.update(range(r["start"], r["start"] + r["length"]))
        assert covered == Counter({k: 2 if i == 83 else 1 for k in range(len(ids))})
    for rows in sequences.values():
        rows.sort(key=lambda r: r["offset"])
        at = 0
        for r in rows:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert packing.pack_documents(nothing).count() == 0


def test_tokens_of_odd_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    plain, own = Tokenizer.from_file(path), packing.WordTokens(path)
    for text in ["a<|endoftext|>b <|ENDOFTEXT|> It's.,, U.S.A.", "", "  ", "don't' it's.' x'", "é. É.. ß, ÿ123. İx. ①. 12.5", "Ωσς. ﬁne 'tis", "q<|b|>! ..."]:
        offsets, ids = own.texts(pa.array([text, "x."]))
        assert ids[: offsets[1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_packing_respects_every_limit(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 120), rng.randint(0, 60)) for i in range(300)] + [(999, 500, 1), (998, None, None)]
    got = packing.pack_examples(spark.createDataFrame(rows, "id int, tokens int, loss_tokens int"), sequence_tokens=200, sequence_segments=4,
                                sequence_loss=70).toPandas()
    assert sorted(got["id"]) == sorted(r[0] for r in rows)
    for _, g in got.groupby("sequence_id"):
        assert len(g) == 1 or (g["tokens"].sum() <= 200 and len(g) <= 4 and g["loss_tokens"].sum() <= 70)
    assert got["sequence_id"].nunique() < 200


def test_language(spark, nothing):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ung", "ich"], "cc": ["eau", "ois", "ent"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n))

    rows = [(i, text(lang, rng.randint(8, 80)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    train = spark.createDataFrame(rows[:120] + [(900, "x", None), (901, None, "aa")], "doc_id long, text string, lang string")
    test = spark.createDataFrame(rows[120:] + [(800, None, "aa"), (801, "12 !? 3", "bb"), (802, "", None)], "doc_id long, text string, lang string")
    contents = language_id.dictionaries(train)
    assert sorted(contents) == ["aa", "bb", "cc"] and len({len(v) for v in contents.values()}) == 1
    got = {r["doc_id"]: r for r in language_id.identify(test, contents).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (800, 801, 802))
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows[120:]]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(nothing, contents).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(test, {}).collect()} == {"und"}


def test_language_beside_rare_ones(spark):
    """A language of one short text, one of punctuation only, and one with a tenth of the texts beside two large ones."""
    rng = random.Random(11)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ung", "ich"], "cc": ["eau", "ois", "ent"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n))

    train = [(i, text(lang, 60), lang) for i, lang in enumerate((["aa", "bb"] * 10 + ["cc"]) * 6)]
    train += [(900, text("aa", 2), "one"), (901, "?! ...", "none"), (902, "", "none")]
    contents = language_id.dictionaries(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    held = {k: len(v.lstrip(b"\0")) for k, v in contents.items()}
    assert sorted(held) == ["aa", "bb", "cc", "one"]
    assert min(held["aa"], held["bb"]) > 10_000 > held["cc"] > 1_000 > held["one"] > 0
    rows = [(i, text(lang, rng.randint(8, 80)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), contents).collect()}
    for wanted in syllables:
        assert np.mean([got[i]["lang_pred"] == wanted for i, _, lang in rows if lang == wanted]) > 0.9, wanted
    assert np.mean([r["rejected"] for r in got.values()]) < 0.2


PAGE = """<!DOCTYPE html><html><head><title>t {n}</title><script>var a="</p>";</script></head><body><header>Site {n}</header>
<div class="cookie-notice">We use cookies</div><nav><ul>{menu}</ul></nav><{box}><h2>Head &amp; {n}</h2>{body}<div class="ad">Buy {n}</div></{end}>
<aside>Other</aside><div id="comments"><p>I disagree {n}</p></div><form>Search</form><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("box", ["article", 'div class="story"'])
def test_article_text(spark, box):
    rng = random.Random(4)
    rows, wanted = [], {}
    for n in range(12):
        paragraphs = [sentence(rng, rng.randint(15, 40)) for _ in range(rng.randint(1, 5))]
        body = "".join(f"<p>{p[:9]}<b>{p[9:]}</b> &eacute;<br>x" + "</p>" * (n % 2) for p in paragraphs)
        page = PAGE.format(n=n, menu="<li><a href=/>m</a>" * (1 + n % 4), box=box, end=box.split()[0], body=body)
        rows.append((n, "https://host.example/" + str(n), page))
        wanted[n] = " ".join([f"Head & {n}", *[f"{p} é x" for p in paragraphs]])
    rows += [(50, "https://host.example/cut", rows[0][2][: rows[0][2].index("</p>") if "</p>" in rows[0][2] else 700]), (51, None, None), (52, "nonsense", "")]
    got = {r["page_id"]: r for r in html_wrappers.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    assert {n: got[n]["text"] for n in wanted} == wanted
    assert all(got[i]["text"] == "" and got[i]["n_chars"] == 0 for i in (51, 52))
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_wrapper_finds_groups_and_slots():
    pages = ["<ul><li>a</li><li>b</li></ul><p>same</p>", "<ul><li>c</li></ul><p>same</p><div>more</div>"]
    merged = html_wrappers.merge(*[html_wrappers.learn(html_wrappers.parse(p)) for p in pages])
    assert html_wrappers.expression(merged) == '<ul> ( <li> # </> )+ </> <p> "same" </> ( <div> "more" </> )?'
    assert html_wrappers.expression(html_wrappers.unpack(html_wrappers.pack(merged))) == html_wrappers.expression(merged)
    assert html.unescape("&amp;") == html_wrappers.clean("&amp;")


def test_toxicity(spark, nothing):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = sentence(rng, rng.randint(20, 60)).split()
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(["zzqua", "zzquo", "vvnasty"]) + rng.choice(["", "x", "ly"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (5, rows[5][1]), (None, "zzqua")]
    given = spark.createDataFrame(labels + [(902, None), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.toxicity(docs, given).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], r["doc_id"] % 4 == 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert np.mean([bool(p) == t for p, t in held]) > 0.95
    left = toxicity.drop_toxic(docs, given)
    assert left.columns == docs.columns and left.count() < len(rows)
    assert {r["score"] for r in toxicity.toxicity(docs, given.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(nothing, given).count() == 0
    assert toxicity.unmasked("id!ot") == "idiot" and toxicity.unmasked("plain.") == ""


def test_toxicity_describes_a_text_alone():
    rows = [("a fine day for you", 1), ("you id!ot !!", 2), ("", 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([k for _, k in rows])], ["text", "key"])
    run = toxicity._describe({"=idiot": 2.0, "^fine": 0.5}, ["key"])
    together = pa.Table.from_batches(run(iter([batch]))).to_pydict()
    alone = pa.Table.from_batches(run(iter([batch.slice(i, 1) for i in range(3)]))).to_pydict()
    assert alone == together and together["key"] == [1, 2, 3] and together["hits"] == [1.0, 1.0, 0.0]


def test_language_model(docs, nothing, texts):
    learn = F.col("doc_id") % 3 != 0
    got = lm_scoring.score_texts(docs, learn, context_share=1 / 64).collect()
    assert len(got) == docs.count()
    split = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    counts = Counter(w for i, t in [*texts.items(), (83, "One")] if i % 3 for w in split(t))
    n, v = sum(counts.values()), len(counts)
    for r in got:
        w = split(texts.get(r["doc_id"], texts[1]))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6
        assert r["score"] < 0 and r["held_out"] == (r["doc_id"] is None or r["doc_id"] % 3 == 0)
    assert lm_scoring.score_texts(nothing, learn).count() == 0
    assert lm_scoring.score_texts(docs, F.lit(False)).count() == docs.count()


def test_predictive_probabilities_sum_to_one():
    """Over all words and the unknown one, in the root and in a context."""
    vocabulary = np.arange(10, 15, dtype=np.uint64)
    per_word, context = np.array([2, 1, 1, 2, 1], np.uint16), np.array([0, 1, 0, 1, 0, 1, 1], np.uint16)
    counts = np.array([4, 7, 1, 2, 3, 1, 5], np.int64)
    blob = lm_scoring.pack(vocabulary, per_word, context, counts)
    state = {"d0": 0.5, "d1": 0.7, "strength": 1.0, "base": 1 / 6, "tables": [0, 0], "root_tables": 0, "root": 0}
    part = lm_scoring.Part(blob, state, 1)
    for _ in range(3):
        part.sweep()
        state |= {"tables": [0, float(part.tables.sum())], "root": float(part.root.sum()), "root_tables": float(part.root_tables.sum())}
        p = np.append(part.word_probability(part.root, part.root_tables), part.word_probability(np.zeros(1), np.zeros(1)))
        assert abs(p.sum() - 1) < 1e-9
        seen = (part.counts - 0.7 * part.tables)[part.below].sum() / (1 + part.counts[part.below].sum())
        assert abs(seen + part.opening()[1] / (1 + part.counts[part.below].sum()) - 1) < 1e-9
    assert (part.tables[part.below] <= part.counts[part.below]).all()


def test_every_context_has_a_restaurant(spark, monkeypatch):
    """3000 contexts of four training tokens each, with one follower: far below any share of the corpus."""
    monkeypatch.setattr(lm_scoring, "PART_TOKENS", 5000)  # several parts
    rng = random.Random(9)
    pairs = [f"a{i} b{i}" for i in range(3000)]
    rows = [(k, " ".join(rng.sample(pairs, 100))) for k in range(120)]
    asked = list(range(0, 3000, 60))
    rows += [(1000 + i, f"a{i} b{i}") for i in asked] + [(5000 + i, f"a{i} b{i + 1}") for i in asked]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(docs, F.col("doc_id") < 1000).collect()}
    gain = [got[1000 + i] - got[5000 + i] for i in asked if f"a{i} b{i}" in " ".join(rows[k][1] for k in range(120))]
    assert np.median(gain) > 1.5 and min(gain) > 0


def test_context_totals_are_exact(spark):
    rng = np.random.default_rng(3)
    rows, sums = [], Counter()
    for part in range(4):
        names = rng.choice(np.arange(1, 200, dtype=np.uint64) << np.uint64(16), 60, replace=False)
        names = names[np.lexsort((names, lm_scoring._dealt(names, 4)))]
        values = rng.integers(0, 50, 60)
        sums.update(dict(zip(names.tolist(), values.tolist(), strict=True)))
        rows.append((part, names, values))
    shares = spark.createDataFrame([(p, lm_scoring.pack(n), lm_scoring.pack(v)) for p, n, v in rows], "part int, names binary, share binary")
    got = {r["part"]: lm_scoring.unpack(bytes(r["totals"]))[0].tolist() for r in lm_scoring.context_totals(shares, 4).collect()}
    assert got == {p: [sums[n] for n in names.tolist()] for p, names, _ in rows}


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("tables not present")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    docs = docs.cache()
    assert 0 < docs.count() < before
    assert docs.join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "left_semi").count() == docs.count()
    packed = corpus_pipeline.run(spark, folder)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_near_duplicates(spark):
    """Planted copies on both sides of 80 % of 5-word shingles, against all pairs."""
    import corpus_pipeline

    rng = random.Random(8)
    texts = {}
    for n in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
        texts[100 * n] = " ".join(base)
        for k, size in enumerate([40, 75, 85, 95, 103, 115, 130]):  # one block of other words
            at = rng.randrange(10, 980 - size)
            texts[100 * n + 1 + k] = " ".join(base[:at] + [f"x{rng.randrange(10**6)}" for _ in range(size)] + base[at + size:])
        for k, changes in enumerate([10, 21, 22, 30]):  # words here and there
            own = list(base)
            for at in range(20, 20 + 40 * changes, 40) if changes < 25 else range(20, 980, 32):
                own[at] = f"y{rng.randrange(10**6)}"
            texts[100 * n + 20 + k] = " ".join(own)
    sets = {}
    for i, t in texts.items():
        w = words(t.lower())
        sets[i] = {tuple(w[k: k + 5]) for k in range(len(w) - 4)}
    label, changed = {i: i for i in sets}, True
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in texts.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == set(label.values())
    assert kept.columns == docs.columns
    assert {0, 6, 7} <= set(label.values()) and not {3, 4, 5, 21, 22} & set(label.values())


def test_wrapper_keeps_articles_whole(spark):
    """Layout words, headings named header, titles that equal menu labels, odd quotes, deep pages, repeated rows."""
    rng = random.Random(8)
    rows, wanted = [], {}

    def page(host, make, count=6):
        for _ in range(count):
            n = len(rows)
            text = sentence(rng, 30)
            rows.append((n, f"https://{host}.example/{n}", f"<html><body>{make(n, text)}</body></html>", "x"))
            wanted[n] = f"About {text}"

    menu = "<ul class=menu><li><a href=/>About</a></li><li><a href=/>Home</a></li></ul>"
    page("layout", lambda n, t: f'{menu}<div class="layout has-sidebar"><article><h1>About</h1><p>{t}</p></article><div class=sidebar>S {n}</div></div>')
    page("flag", lambda n, t: f'{menu}<div class="box sidebar"><main><h1>About</h1><p>{t}</p></main></div><div class=comments><article>{t} {t}</article></div>')
    page("title", lambda n, t: f'{menu}<article><div class="post-header"><h1 class="page-header">About</h1></div><p>{t}</p></article>')
    page("plain", lambda n, t: f'{menu}<div class="story">{"<h2>" if n % 2 else "<h3>"}{"About"}{"</h2>" if n % 2 else "</h3>"}<p>{t}</p></div>', 8)
    page("quote", lambda n, t: f'<article><h1 title="x>About</h1><p class="a">{t}</p></article>')
    page("deep", lambda n, t: "<div>" * 5000 + f"<article><h1>About</h1><p>{t}</p></article>" + "</div>" * 5000, 2)
    rows += [(900, rows[0][1], rows[0][2], None), (900, rows[0][1], rows[0][2], None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, path string").withColumn("drop", F.lit(1)).withColumn("host", F.lit("h"))
    got = html_wrappers.extract_articles(table.repartition(3)).collect()
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] < 900} == wanted
    assert [r["text"] for r in got if r["page_id"] == 900] == [wanted[0]] * 2
    empty = html_wrappers.extract_articles(table.limit(0))
    assert empty.collect() == [] and empty.columns == ["page_id", "url", "text", "n_chars"]


def test_common_stream_is_longest():
    rng = random.Random(3)
    for _ in range(300):
        x, y = ("".join(rng.choices("abc", k=rng.randrange(9))) for _ in range(2))
        pairs = html_wrappers.common(list(x), list(y))
        assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, j in itertools.product(range(len(x)), range(len(y))):
            best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]


def test_long_texts_of_a_wrapper_differ_by_their_ends():
    a, b = ("w" * 200 + end for end in "xy")
    assert html_wrappers.shown(a) != html_wrappers.shown(b) and html_wrappers.shown("short") == "short"


def test_span_sql_splits_at_every_white_space(spark, tmp_path):
    """Vertical tabs, form feeds and carriage returns part words, in the SQL as in the operator; other controls do not."""
    import duckdb
    import pandas as pd

    rng = random.Random(21)
    shared = [sentence(rng, 1) for _ in range(70)]
    gaps = [" ", "\t", "\n", "\v", "\f", "\r", "\r\n"]
    texts = ["".join(w + rng.choice(gaps) for w in shared) + sentence(rng, 9) for _ in range(4)] + ["a\x1fb\x0ec " + " ".join(shared[:49]), "", None]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "s", "n_chars": 1})
    docs.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    wanted = con.execute(substring_dedup.SQL).df()[columns].sort_values("doc_id").values.tolist()
    got = substring_dedup.op9_cover_substring_dedup(spark, str(tmp_path)).select(*columns).orderBy("doc_id").toPandas().values.tolist()
    assert got == wanted and [r[1] for r in wanted[-3:]] == [50, 0, 0] and [r[2] for r in wanted[:4]] == [0, 70, 70, 70]


def test_pieces_of_a_chunk_share_items(monkeypatch):
    """Batches of one task make one chunk, in which an item stands once; texts find their items again; rows go one a batch."""
    monkeypatch.setattr(lm_scoring.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 3})()))
    texts = ["b a b a", "", "a b c", "c c a b"]
    batches = [pa.RecordBatch.from_arrays([pa.array([i, None], pa.int64()), pa.array([True, False]), pa.array(texts[2 * i:2 * i + 2])],
                                          ["id", "learn", "text"]) for i in range(2)]
    out = list(lm_scoring._chunks(2)(iter(batches)))
    assert [b.num_rows for b in out] == [1] * len(out)
    rows = [r for b in out for r in b.to_pylist()]
    assert {r["chunk"] for r in rows} == {3 << 32}
    assert [r["part"] for r in rows if r["part"] < 0] == [-1, -2]
    name = {h: w for w, h in zip("abc", lm_scoring.textvec.hashes(pa.array(list("abc"))).tolist())} | {int(lm_scoring.END_HASH): "$"}
    items, learned = [], []
    for row in sorted((r for r in rows if r["part"] >= 0), key=lambda r: r["part"]):
        words, held, contexts, number, counts = lm_scoring.unpack(row["blob"])
        items += [(name[int(w)], name[int(contexts[c])]) for w, c in zip(np.repeat(words, held), number)]
        learned += counts.tolist()
    assert len(items) == len(set(items))
    trained = Counter(pair for t in texts[::2] for w in [[*t.split(), "$"]] for pair in zip(w, ["$", *w[:-1]]))
    assert {i: n for i, n in zip(items, learned) if n} == trained
    got = []
    for row in (r for r in rows if r["part"] < 0):
        ids, missing, learn, per_doc, steps, repeats = lm_scoring.unpack(row["blob"])
        start = 0
        for n in per_doc:
            held = np.cumsum(steps[start:start + n])
            got.append(sorted(items[i] for i, r in zip(held, repeats[start:start + n]) for _ in range(r)))
            start += n
    wanted = [[*t.split(), "$"] for t in texts]
    assert got == [sorted(zip(w, ["$", *w[:-1]])) for w in wanted]
