import random
import re
from collections import Counter

import pytest

from verdigris.llm import ngram_join


def shingles(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [shingles(text) for _, text in rows]
    holders = {}
    for i, own in enumerate(sets):
        for x in own:
            holders.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    both = Counter((i, j) for own in holders.values() for i in own for j in own if i < j)
    for (i, j), n in both.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[find(i)] = min(doc_id, smallest.get(find(i), doc_id))
    return Counter((doc_id, len(sets[i]), smallest.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def planted(seed, groups=6, size=14):
    """Groups of edited copies around the threshold, a passage that many share, and short texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([7, 40, 90]))] + (passage if rnd.random() < 0.6 else [])
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 25)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            base = copy if rnd.random() < 0.3 else base
    rows += [" ".join(passage + [word() for _ in range(k)]) for k in range(0, 40, 4)]
    rnd.shuffle(rows)
    return [(i * 3 + 1, text) for i, text in enumerate(rows)]


ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "É é x a b c d"),
    (8, "é É x a b c d"), (9, "w " * 60_000), (10, "w w w w w"), (11, "same text of a few words"), (11, "same text of a few words"),
    (None, "same text of a few words"), (None, "no id at all in this one"), (12, "same  text of a\nfew words"),
]


def check(docs, rows):
    assert Counter(map(tuple, ngram_join.near_duplicates(docs).collect())) == brute(rows)


def test_odd_rows(make):
    check(make(ODD, clash=("set_key", "component_id", "n")), ODD)
    assert ngram_join.near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("seed,mostly", [(1, 0.5), (2, 0.0), (3, 2.0)])
def test_groups_around_the_threshold(make, monkeypatch, seed, mostly):
    monkeypatch.setattr(ngram_join, "MOSTLY", mostly)  # 0: turns with hubs until they find nothing; 2: one turn
    rows = planted(seed)
    check(make(rows), rows)


def test_small_tables(sample):
    check(*sample)


def test_fragments_and_flushes(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "PER_FRAGMENT", 500)
    monkeypatch.setattr(ngram_join, "PER_FLUSH", 700)
    rows = planted(5, groups=4)
    check(make(rows), rows)


def test_all_pairs(make):
    rows = planted(4, groups=3)
    docs = make(rows)
    sets = {shingles(text) for _, text in rows}
    linked = sum(
        100 * len(x & y) >= 75 * len(x | y) for x in sets for y in sets if x != y and x and y
    )
    assert ngram_join.similar_pairs(docs).count() * 2 == linked


def test_drop_near_copies(make):
    rows = [*planted(6, groups=3), (None, "no id at all in this one")]
    docs = make(rows, clash=("gone_id",))
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    wanted = sorted(str(i) for i, _, component in brute(rows) if i is None or i == component)
    assert sorted(str(row.doc_id) for row in kept.collect()) == wanted


def test_drop_near_copies_decides_by_text(make):
    base = [f"w{k}" for k in range(60)]
    copy, other = [*base[:-1], "end"], [f"v{k}" for k in range(30)]
    rows = [
        (1, " ".join(base)), (2, " ".join(copy)), (2, " ".join(other)),  # id 2: a near copy and a clean text
        (3, "a b c d e f g"), (3, "A b c d e f g"),  # the smallest id twice
        (None, "p q r s t u"), (None, "p q r s  t u"), (5, None), (5, " "), (6, "alone among the ones of its own id"),
    ]
    kept = ngram_join.drop_near_copies(make(rows, clash=("key", "rows")))
    assert kept.columns[-2:] == ["key", "rows"]
    got = sorted(((row.doc_id, row.text) for row in kept.collect()), key=str)
    wanted = [rows[0], rows[2], (3, "A b c d e f g"), (None, "p q r s  t u"), rows[7], rows[8], rows[9]]
    assert got == sorted(wanted, key=str)
