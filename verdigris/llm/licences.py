"""Licence scans with a positional index of rare words.

Each template is the fixed wording by which a licence is named or granted. Over all documents, the number of those
that have each template word gives its rarity. The index lists, for each word, the templates that have it among the
rarest words of their key phrase, and its offset there. A file's words that the index has (its rarest licence words)
are looked up with their positions, once for all templates: a posting of a template at a position says where the
template would begin. Beginnings on which all indexed words of a template agree are candidates, and the mandatory key
phrase must then stand at its place word for word.

All of it is column expressions over a text's array of words. Templates and index are literals, and the plan is the same
for any number of templates.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import lower_ascii, whole_text

#: Everything that is not part of a word: ASCII but digits and lower-case letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rarest words of its key phrase by which a template is looked up.
INDEX_WORDS = 3


@dataclass(frozen=True)
class Template:
    """A wording; ``key`` is the phrase in it that must stand word for word. Of base ones it is all."""

    label: str
    words: tuple[str, ...]
    key_at: int
    key: tuple[str, ...]
    base: bool = False


def template(label: str, wording: str, key: str | None = None, base: bool = False) -> Template:
    words, own = tuple(wording.split()), tuple((key or wording).split())
    at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
    return Template(label, words, at, own, base)


#: Public wordings of licences. The base ones come first.
TEMPLATES = (
    template("mit", "under the mit license", base=True),
    template("apache-2", "apache license version 2", base=True),
    template("cc-by-nc", "cc by nc", base=True),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person obtaining a copy"),
    template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    template("gpl-3", "gnu general public license version 3"),
    template("gpl-2", "gnu general public license version 2"),
    template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "under the terms of the gnu general public license"),
    template("lgpl", "gnu lesser general public license"),
    template("agpl-3", "gnu affero general public license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "terms of the mozilla public license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee is hereby granted"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    template("cc-by-nc", "creative commons attribution noncommercial"),
    template("cc-by-sa", "cc by sa"),
    template("cc-by-sa", "creative commons attribution sharealike"),
    template("cc0", "cc0 1 0 universal"),
    template("lgpl-2.1", "gnu lesser general public license version 2 1"),
    template("lgpl-3", "gnu lesser general public license version 3"),
    template("lgpl", "gnu library general public license"),
    template("agpl-3", "gnu affero general public license version 3"),
    template("gpl-2", "either version 2 of the license or at your option any later version"),
    template("gpl-3", "either version 3 of the license or at your option any later version"),
    template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "contributors may be used to endorse or promote products derived from this software"),
    template("bsl", "boost software license version 1 0", "boost software license"),
    template("epl", "eclipse public license v 2 0", "eclipse public license"),
    template("epl", "the accompanying materials are provided under the terms of this eclipse public license", "this eclipse public license"),
    template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages arising from the use of this software"),
    template("artistic", "the artistic license 2 0", "artistic license"),
    template("wtfpl", "do what the fuck you want to public license"),
    template("ofl", "sil open font license version 1 1", "sil open font license"),
    template("cddl", "common development and distribution license"),
    template("mpl", "mozilla public license version 1 1", "mozilla public license version 1"),
    template("eupl", "european union public licence"),
    template("ms-pl", "microsoft public license ms pl", "microsoft public license"),
    template("psf", "python software foundation license"),
    template("ncsa", "university of illinois ncsa open source license", "illinois ncsa open source license"),
    template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    template("cc-by", "creative commons attribution 3 0 unported license", "creative commons attribution 3 0"),
    template("cc-by-nd", "creative commons attribution noderivatives"),
    template("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "dedicated all copyright and related and neighboring rights"),
)

#: Labels of identifiers from the public list of licences.
IDENTIFIERS = {
    "mit": ("MIT", "X11"),
    "mit-0": ("MIT-0",),
    "apache-2": ("Apache-2.0",),
    "apache-1": ("Apache-1.1",),
    "gpl-2": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "gpl-3": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "lgpl-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"),
    "lgpl-3": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl-3": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "bsd": ("BSD-2-Clause", "0BSD"),
    "bsd-3": ("BSD-3-Clause",),
    "mpl-2": ("MPL-2.0",),
    "isc": ("ISC",),
    "unlicense": ("Unlicense",),
    "cc0": ("CC0-1.0",),
    "cc-by": ("CC-BY-4.0", "CC-BY-3.0"),
    "cc-by-sa": ("CC-BY-SA-4.0", "CC-BY-SA-3.0"),
    "cc-by-nc": ("CC-BY-NC-4.0",),
    "cc-by-nd": ("CC-BY-ND-4.0",),
    "bsl": ("BSL-1.0",),
    "epl": ("EPL-1.0", "EPL-2.0"),
    "zlib": ("Zlib",),
    "artistic": ("Artistic-2.0",),
    "wtfpl": ("WTFPL",),
    "ofl": ("OFL-1.1",),
    "cddl": ("CDDL-1.0",),
    "eupl": ("EUPL-1.2",),
    "ms-pl": ("MS-PL",),
    "psf": ("Python-2.0",),
    "ncsa": ("NCSA",),
    "postgresql": ("PostgreSQL",),
}
#: How a file names an identifier.
IDENTIFIED_BY = "spdx license identifier"


def _identified() -> tuple[Template, ...]:
    """A template for each identifier, behind the words that announce it."""
    return tuple(
        template(label, f"{IDENTIFIED_BY} {' '.join(re.findall('[a-z0-9]+', name.lower()))}")
        for label, names in IDENTIFIERS.items()
        for name in names
    )


TEMPLATES += _identified()
VOCABULARY = tuple(sorted({word for t in TEMPLATES for word in t.words}))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), _BETWEEN), lambda word: word != "")


def rarities(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of every template word over all documents: a number for each word."""
    vocabulary = sorted({word for t in templates for word in t.words})
    own = F.array_intersect(words_of(whole_text()), F.array(*map(F.lit, vocabulary)))
    # The empty word stands for every document, so one aggregation counts them too.
    held = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word"))
    counts = {row.word: row["count"] for row in held.groupBy("word").count().collect()}
    total = counts.get("", 0)
    return {word: math.log((total + 1) / (counts.get(word, 0) + 1)) for word in vocabulary}


def index_of(template: Template, rarity: dict[str, float]) -> list[tuple[str, int]]:
    """The rarest words of the template's key phrase with their first offset there; ties by the word."""
    offsets = {word: template.key_at + template.key.index(word) for word in set(template.key)}
    return sorted(offsets.items(), key=lambda item: (-rarity[item[0]], item[0]))[:INDEX_WORDS]


def postings(templates: tuple[Template, ...], rarity: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """(number of the template, offset) by word, for the indexed words of every template."""
    index: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(templates):
        for word, offset in index_of(t, rarity):
            index.setdefault(word, []).append((number, offset))
    return index


#: A beginning is one number: the template's number above these bits, the place (which may lie before the text) in them.
_PLACE_BITS = 32
_FIRST_PLACE = 1 << 31


def _beginnings(words: Column, index: dict[str, list[tuple[int, int]]]) -> Column:
    """Where the postings of a file's indexed words say that templates begin, sorted."""
    listed = F.map_from_arrays(
        F.array(*map(F.lit, index)),
        F.array(*(F.array(*(F.lit((n << _PLACE_BITS) + _FIRST_PLACE - offset) for n, offset in own)) for own in index.values())),
    )
    placed = F.transform(words, lambda word, i: F.struct(word.alias("word"), i.cast("long").alias("at")))
    indexed = F.filter(placed, lambda hit: hit.word.isin(*index))
    found = F.transform(indexed, lambda hit: F.transform(F.element_at(listed, hit.word), lambda posting: posting + hit.at))
    return F.array_sort(F.flatten(found))


def _agreed(beginnings: Column, needed: list[int]) -> Column:
    """The sorted beginnings that occur as often as their template has indexed words, each once.

    Every indexed word of a template votes for a beginning at most once, so equal ones are agreeing words.
    """
    wanted = F.array(*map(F.lit, needed))

    def agree(begin: Column, i: Column) -> Column:
        votes = F.element_at(wanted, _number(begin) + 1)
        first = (i == 0) | (F.get(beginnings, i - 1) != begin)
        return first & F.coalesce(F.get(beginnings, i + votes - 1) == begin, F.lit(False))

    return F.filter(beginnings, agree)


def _number(begin: Column) -> Column:
    return F.shiftright(begin, _PLACE_BITS).cast("int")


def _match(words: Column, begin: Column, templates: tuple[Template, ...]) -> Column:
    """Label, start of the key phrase and share of the template's words in place; null where the phrase doesn't stand."""
    number = _number(begin) + 1
    place = (begin.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) - _FIRST_PLACE).cast("int")
    label, at, base = (
        F.element_at(F.array(*(F.lit(getattr(t, name)) for t in templates)), number) for name in ("label", "key_at", "base")
    )
    key, whole = (
        F.element_at(F.array(*(F.array(*map(F.lit, getattr(t, name))) for t in templates)), number) for name in ("key", "words")
    )
    start = place + at
    stands = (start >= 0) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, F.size(key)) == key)
    # Past the end of the text, and before its beginning, there are no words.
    inside = F.greatest(place, F.lit(0))
    there = F.slice(words, inside + 1, F.greatest(F.size(whole) - (inside - place), F.lit(0)))
    wanted = F.slice(whole, inside - place + 1, F.size(whole))
    same = F.size(F.filter(F.zip_with(there, wanted, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    share = same / F.size(whole)
    return F.when(stands, F.struct(label.alias("label"), start.alias("start"), share.alias("share"), base.alias("base")))


_MATCH = "array<struct<label:string,start:int,share:double>>"


def scan(
    docs: DataFrame, rarity: dict[str, float] | None = None, templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """doc_id, n_words, base and more: the places of base phrases and of other templates with label, start and share.

    Null text is empty; a null doc_id and repeated rows stay as they are; an empty table gives an empty result; other
    columns are not read. A file without the rarest word of any key phrase is not looked at further.
    """
    rarity = rarities(docs, templates) if rarity is None else rarity
    index = postings(templates, rarity)
    anchors = sorted({index_of(t, rarity)[0][0] for t in templates})
    texts = docs.select("doc_id", words_of(whole_text()).alias("words"))
    hinted = F.arrays_overlap("words", F.array(*map(F.lit, anchors)))
    none = F.array().cast("array<bigint>")
    looked_up = texts.withColumn("begins", F.when(hinted, _beginnings(F.col("words"), index)).otherwise(none))
    needed = [len(index_of(t, rarity)) for t in templates]
    agreed = looked_up.withColumn("begins", _agreed(F.col("begins"), needed))
    matches = F.array_compact(F.transform("begins", lambda begin: _match(F.col("words"), begin, templates)))
    found = agreed.withColumn("matches", F.when(F.size("begins") > 0, matches).otherwise(F.array()))

    def those(base: bool) -> Column:
        own = F.filter("matches", lambda m: m.base == base)
        return F.transform(own, lambda m: F.struct(m.label, m.start, m.share)).cast(_MATCH)

    return found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), those(True).alias("base"), those(False).alias("more")
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts, first and last place and labels of the base matches, labels of all, and the best match's share."""

    def labels(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    starts = F.transform("base", lambda m: m["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.concat("base", "more")).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "more"), lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
