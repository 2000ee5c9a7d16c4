"""Licence scan with a positional index of rare words.

Licence notices are templates; every word of theirs has postings (template, place). A text's licence words are weighed
by how rare they are among all texts, and of each template the rarest ones that the text holds are looked up. Where a
word stands in the text and where it stands in the template gives a shift; only shifts that several words agree in stay.
There the template's key phrases must stand word by word. What a match is worth is the share of the template, weighed
by rarity, that stands at its shift. Only column expressions: no Python in tasks, and after the words' frequencies are
known no text leaves its row.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .decontamination import words_of
from .registry import query, table


class Template(NamedTuple):
    """A notice in lower-case words; parts in brackets are its key phrases."""

    label: str
    notice: str

    @property
    def words(self) -> list[str]:
        return self.notice.replace("[", " ").replace("]", " ").split()

    @property
    def phrases(self) -> list[tuple[int, list[str]]]:
        """(place, words) of each key phrase."""
        found, place = [], 0
        for number, part in enumerate(self.notice.replace("]", "[").split("[")):
            own = part.split()
            if number % 2:
                found.append((place, own))
            place += len(own)
        return found


#: Phrases that name a licence wherever they stand.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (
    Template("mit", "released [under the mit license]"),
    Template("mit", "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated "
                    "documentation files the software to deal in the software without restriction"),
    Template("apache-2", "licensed under the [apache license version 2] 0"),
    Template("apache-2", "licensed under the [apache license version 2] 0 the license you may not use this file except in compliance "
                         "with the license"),
    Template("gpl-3", "this work is licensed under the [gnu general public license version 3]"),
    Template("gpl-2", "this work is licensed under the [gnu general public license version 2]"),
    Template("gpl-3", "you can redistribute it and or modify it under the terms of the [gnu general public license as published by "
                      "the free software foundation either version 3] of the license or at your option any later version"),
    Template("gpl-2", "you can redistribute it and or modify it under the terms of the [gnu general public license as published by "
                      "the free software foundation either version 2] of the license or at your option any later version"),
    Template("lgpl-3", "under the terms of the [gnu lesser general public license version 3]"),
    Template("agpl-3", "under the terms of the [gnu affero general public license version 3]"),
    Template("mpl-2", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    Template("bsd", "[redistribution and use in source and binary forms with or without modification are permitted] provided that the "
                    "[following conditions are met]"),
    Template("isc", "[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted]"),
    Template("unlicense", "this is free and unencumbered software [released into the public domain]"),
    Template("cc0", "licensed under [cc0 1 0]"),
    Template("cc-by", "licensed under [cc by 4 0]"),
    Template("cc-by-sa", "licensed under [cc by sa]"),
    Template("cc-by-nc", "licensed under [cc by nc] 4 0"),
    Template("cc-by", "this work is licensed under a [creative commons attribution 4 0] international license"),
    Template("cc-by-sa", "this work is licensed under a [creative commons attribution sharealike] 4 0 international license"),
    Template("cc-by-nc", "this work is licensed under a [creative commons attribution noncommercial] 4 0 international license"),
)
#: Words of a template that are looked up, the rarest first, and places that have to agree in a shift.
RARE, AGREE = 5, 2


def _list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def licence_words(templates: tuple[Template, ...], base: tuple[tuple[str, str], ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words} | {w for _, p in base for w in p.split()})


def _candidates(templates: tuple[Template, ...]) -> Column:
    """Numbers of the templates whose key words are all ``present``."""
    needed = F.array(*[F.struct(F.lit(i).alias("number"), _list(sorted({w for _, p in t.phrases for w in p})).alias("words"))
                       for i, t in enumerate(templates)])
    return F.transform(F.filter(needed, lambda n: F.size(F.array_except(n["words"], F.col("present"))) == 0), lambda n: n["number"])


def word_rows(docs: DataFrame, id_column: str, templates: tuple[Template, ...], base: tuple[tuple[str, str], ...], text_column: str) -> DataFrame:
    """Per text its number of words and licence words, and all words where a licence could stand."""
    rows = docs.select(F.col(id_column).alias("id"), words_of(text_column).alias("words"))
    rows = rows.withColumn("present", F.array_intersect("words", _list(licence_words(templates, base))))
    rows = rows.withColumn("candidates", _candidates(templates))
    held = [F.size(F.array_except(_list(sorted(set(p.split()))), F.col("present"))) == 0 for _, p in base]
    wanted = F.size("candidates") > 0
    for one in held:
        wanted = wanted | one
    return rows.select("id", F.size("words").cast("long").alias("n_words"), "present", "candidates",
                       F.when(wanted, F.col("words")).alias("words"))


def rarity(rows: DataFrame, words: list[str]) -> dict[str, float]:
    """Weight of each licence word: log((texts + 1) / (texts with the word + 1)), and a little.

    The driver sees one number for each word of the templates.
    """
    total = rows.count()
    found = {r["w"]: r["n"] for r in rows.select(F.explode("present").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 0.01 for w in words}


def rarest(template: Template, weight: dict[str, float]) -> list[str]:
    """The template's different words, the rarest first; ties by the word."""
    return sorted(set(template.words), key=lambda w: (-weight[w], w))


def _index(templates: tuple[Template, ...], weight: dict[str, float]) -> Column:
    """The templates with their postings as one constant; its size is theirs, whatever the input."""
    entries = []
    for number, t in enumerate(templates):
        postings = [F.struct(F.lit(w).alias("word"), F.lit(i).alias("place"), F.lit(weight[w]).alias("weight")) for i, w in enumerate(t.words)]
        phrases = [F.struct(F.lit(i).alias("place"), _list(p).alias("words")) for i, p in t.phrases]
        entries.append(F.struct(F.lit(number).alias("number"), F.lit(t.label).alias("label"), _list(rarest(t, weight)).alias("ranked"),
                                F.array(*postings).alias("postings"), F.array(*phrases).alias("phrases"),
                                F.lit(sum(weight[w] for w in t.words)).alias("total")))
    return F.array(*entries)


def _matches(agree: int, rare: int) -> list[tuple[str, str]]:
    """Steps from candidates to verified matches, each a column over the last."""
    return [
        # the rarest words of each template that the text holds
        ("asked", f"""transform(filter(index, t -> array_contains(candidates, t.number)), t ->
            named_struct('t', t, 'chosen', slice(filter(t.ranked, w -> array_contains(present, w)), 1, {rare})))"""),
        # where any of them stands: read once for all templates
        ("looked", "array_distinct(flatten(transform(asked, a -> a.chosen)))"),
        ("places", "filter(transform(words, (w, i) -> named_struct('w', w, 'i', i)), x -> array_contains(looked, x.w))"),
        # text place less template place, sorted; a shift that enough places agree in meets itself that much further on
        ("shifts", """transform(asked, a -> named_struct('t', a.t, 'need', least({agree}, size(filter(a.t.postings, p -> array_contains(a.chosen, p.word)))),
            'found', array_sort(flatten(transform(filter(places, x -> array_contains(a.chosen, x.w)),
                x -> transform(filter(a.t.postings, p -> p.word = x.w), p -> x.i - p.place))))))""".replace("{agree}", str(agree))),
        ("agreed", """transform(shifts, s -> named_struct('t', s.t, 'at', array_distinct(filter(s.found, (v, i) -> get(s.found, i + s.need - 1) = v))))"""),
        ("verified", """transform(agreed, g -> named_struct('t', g.t, 'at', filter(g.at, v -> forall(g.t.phrases, p ->
            v + p.place >= 0 AND v + p.place + size(p.words) <= size(words) AND slice(words, greatest(v + p.place, 0) + 1, size(p.words)) = p.words))))"""),
        ("matches", """transform(filter(verified, g -> size(g.at) > 0), g -> named_struct('label', g.t.label, 'score', array_max(transform(g.at, v ->
            aggregate(g.t.postings, 0D, (sum, p) -> sum + IF(v + p.place >= 0 AND get(words, v + p.place) = p.word, p.weight, 0D)) / g.t.total))))"""),
    ]


def _base_places(base: tuple[tuple[str, str], ...]) -> Column:
    """(label, places) of each phrase that stands in the text."""
    found = []
    for label, phrase in base:
        words = phrase.split()
        stands = " AND ".join(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(words))
        places = F.expr(f"IF(words IS NOT NULL AND size(words) >= {len(words)}, filter(sequence(0, size(words) - {len(words)}), i -> {stands}), "
                        "CAST(array() AS array<int>))")
        found.append(F.struct(F.lit(label).alias("label"), places.alias("places")))
    return F.array(*found)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: tuple[Template, ...] = TEMPLATES,
         base: tuple[tuple[str, str], ...] = BASE, rare: int = RARE, agree: int = AGREE) -> DataFrame:
    """One row per input row: the id, ``n_words``, the base phrases' places (``n_base``, ``first_word``, ``last_word``),
    ``base_labels``, ``labels`` (also those of verified templates; different ones, sorted, with commas), ``score``.

    ``score`` is 1 where a base phrase stands, else the best match's share of its template, else 0. A null or empty
    text has no words and no labels. Repeated rows are answered each on its own and count as texts each; null ids are
    kept; an empty table gives no rows; other columns stay aside.
    """
    rows = cut_lineage(word_rows(docs, id_column, templates, base, text_column), "licence-words")
    weight = rarity(rows, licence_words(templates, base))
    rows = rows.withColumn("base", _base_places(base)).withColumn("index", F.when(F.size("candidates") > 0, _index(templates, weight)))
    for name, step in _matches(agree, rare):
        rows = rows.withColumn(name, F.expr(step))
    places = F.flatten(F.transform("base", lambda b: b["places"]))
    own = F.transform(F.filter("base", lambda b: F.size(b["places"]) > 0), lambda b: b["label"])
    rows = rows.select("id", "n_words", places.alias("places"), own.alias("own"),
                       F.coalesce("matches", F.expr("CAST(array() AS array<struct<label: string, score: double>>)")).alias("matches"))
    labels = F.concat(F.col("own"), F.transform("matches", lambda m: m["label"]))
    return rows.select(
        F.col("id").alias(id_column), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("own")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(
            F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))).alias("score"))


@query("op12_rare_word_licences")
def op12_rare_word_licences(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))
