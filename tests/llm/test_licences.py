import re

from verdigris.llm import licences

BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
ODD = [
    (1, None), (2, ""), (3, "Released under the MIT License."), (4, "UNDER-THE.MIT\nlicense under the mit license"), (5, "cc by nc " * 2000),
    (6, "Licensed under CC BY-NC 4.0. Apache License, Version 2.0"), (7, "éunder the mit license, under the mit licenseé"),
    (8, "the mit license"), (9, "mit under the license"), (9, "same"), (9, "same"), (None, "cc by nc"), (10, "w " * 50_000 + "apache license version 2"),
    (11, "Permission is hereby granted, free of charge, to any person obtaining a copy"), (12, "K CC by nc"), (13, "cc by"),
    (14, "GNU General Public License, version 3. This is the GNU Lesser General Public License"),
    (15, "free software you can redistribute it"), (16, "cc cc by nc by nc cc by nc"),
]


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = {
        label: [i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        for label, phrase in BASE.items()
    }
    every = sorted(i for own in places.values() for i in own)
    found = ",".join(sorted(label for label, own in places.items() if own))
    return len(words), len(every), every[0] if every else None, every[-1] if every else None, found


def check(docs, rows):
    got = licences.digest(licences.scan(docs)).collect()
    order = lambda row: tuple(map(str, row))
    expected = [(i, *brute(text)) for i, text in rows]
    assert sorted((tuple(row[:6]) for row in got), key=order) == sorted(expected, key=order)
    assert all(set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) for row in got)
    assert all((row.score > 0) == bool(row.labels) and 0 <= row.score <= 1 for row in got)
    return {row.doc_id: row for row in got}


def test_base_equals_brute_force(make, sample):
    check(*sample)
    got = check(make(ODD, clash=("words", "label", "n_words")), ODD)
    assert (got[11].labels, got[14].labels, got[15].labels, got[8].labels) == ("mit", "gpl-3,lgpl", "", "")
    assert got[11].base_labels == ""
    assert got[3].score == 1.0
    assert licences.digest(licences.scan(make([]))).count() == 0


def test_every_template_is_found(make):
    rows = [(i, "x y z " + " ".join(t.words).upper() + " x") for i, t in enumerate(licences.TEMPLATES)]
    got = {row.doc_id: row for row in licences.scan(make(rows)).collect()}
    for i, t in enumerate(licences.TEMPLATES):
        own = [m for m in (*got[i].base, *got[i].more) if m.label == t.label and m.start == 3 + t.key_at]
        assert max(m.share for m in own) == 1.0


def test_edited_wording_needs_the_key_phrase(make):
    whole = next(t for t in licences.TEMPLATES if t.label == "bsd")
    words = list(whole.words)
    words[20] = "other"
    broken = list(whole.words)
    broken[whole.key_at + 2] = "other"
    got = {row.doc_id: row.more for row in licences.scan(make([(1, " ".join(words)), (2, " ".join(broken))])).collect()}
    assert [m.label for m in got[1]] == ["bsd"] and got[1][0].share < 1
    assert got[2] == []


def test_rarity_counts_all_documents(make):
    rows = [(i, "cc the" if i % 4 else "the license") for i in range(40)]
    rarity = licences.rarities(make(rows))
    assert rarity["license"] > rarity["cc"] > rarity["the"]
    assert [w for w, _ in licences.index_of(licences.TEMPLATES[0], rarity)] == ["mit", "under", "license"]


def test_identifiers_and_further_licences(make):
    rows = [
        (1, "// SPDX-License-Identifier: Apache-2.0"), (2, "SPDX-License-Identifier: MIT\n"), (3, "Boost Software License - Version 1.0"),
        (4, "Eclipse Public License v2.0"), (5, "under the GNU Lesser General Public License, version 2.1 or"), (6, "SPDX License: MIT"),
        (7, "The Artistic License"), (8, "SPDX-License-Identifier: GPL-3.0-or-later AND CC-BY-NC-4.0"),
    ]
    got = {row.doc_id: row.labels for row in licences.digest(licences.scan(make(rows))).collect()}
    assert got == {1: "apache-2", 2: "mit", 3: "bsl", 4: "epl", 5: "lgpl,lgpl-2.1", 6: "", 7: "artistic", 8: "cc-by-nc,gpl-3"}
    assert len(licences.TEMPLATES) >= 60


def test_the_plan_does_not_grow_with_the_templates(make):
    def size(templates):
        plan = licences.scan(make([(1, "x")]), {w: 1.0 for w in licences.VOCABULARY}, templates)._jdf.queryExecution()
        text = plan.optimizedPlan().toString()
        assert "Python" not in plan.toString() and "Arrow" not in plan.toString()
        return text.count("lambdafunction")

    assert size(licences.TEMPLATES[:5]) == size(licences.TEMPLATES)


def test_index_lists_templates_by_their_rarest_words():
    rarity = {w: float(len(w)) for w in licences.VOCABULARY}
    index = licences.postings(licences.TEMPLATES, rarity)
    for number, t in enumerate(licences.TEMPLATES):
        own = [(word, offset) for word, held in index.items() for n, offset in held if n == number]
        assert sorted(own) == sorted(licences.index_of(t, rarity))
        assert all(t.words[offset] == word for word, offset in own)
