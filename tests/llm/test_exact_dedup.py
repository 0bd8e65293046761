import hashlib
import re
from collections import Counter

import pytest

from verdigris.llm import exact_dedup

ODD = [
    (1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "ü" * 50_000), (8, "ü " * 50_000),
    (9, "A b"), (9, "A b"), (None, "ab"), (None, "alone"), (10, "a b"), (11, "once"), (11, " once"),
]


def brute(rows):
    plain = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in rows]
    groups = {}
    for i, text, key in plain:
        groups.setdefault(key, []).append((-len(text), i is None, i or 0, i))
    out = []
    for i, text, key in plain:
        best = min(groups[key], key=lambda x: x[:3])[3]
        sha = hashlib.sha256(key.encode()).hexdigest()
        out.append((i, best, len(groups[key]), i == best, sha, len(text)))
    return Counter(out)


@pytest.mark.parametrize("support", [0.001, 0.3])
def test_equals_brute_force(make, sample, support):
    docs = make(ODD, clash=("keep_id", "digest", "winner"))
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs, support).collect())) == brute(ODD)
    docs, rows = sample
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs, support).collect())) == brute(rows)


def test_heavy_hitters_are_found_and_verified(make):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    docs = make(rows)
    heavy = exact_dedup.heavy_hitters(exact_dedup.digests(docs), 0.01).collect()
    assert [(row.winner.doc_id, row.group_size) for row in heavy] == [(0, 1000)]
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs, 0.01).collect())) == brute(rows)


def test_empty_table(make):
    assert exact_dedup.exact_dedup(make([])).count() == 0
    assert exact_dedup.drop_copies(make([])).count() == 0


def test_drop_copies_keeps_one_row_a_text(make):
    docs = make(ODD, clash=("rows", "keep_id"))
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((row.doc_id or 0, len(row.text or "")) for row in kept.collect()) == [
        (0, 5), (3, 4), (6, 4), (8, 100_000), (9, 3), (10, 3), (11, 5),
    ]
