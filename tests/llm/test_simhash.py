import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from verdigris.llm import simhash
from verdigris.llm.shingles import mixed, word_hashes

ODD = [
    (5, None), (5, "b b"), (-7, "É é x"), (9, ""), (11, "one two three four " * 12_000), (12, "😀 naïve text of words"), (13, "solo"),
    (None, "no id"), (None, "also none"), (14, "same words here now"), (14, "same words here now"), (15, " \n "),
]


def brute_fingerprint(text):
    """Votes term by term."""
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split(b" ")]
    words = [w for part in words for w in __import__("re").split(rb"[\x20\x09-\x0D]+", part) if w]
    def word(w):
        data = np.frombuffer(w, np.uint8)
        return word_hashes(data, np.array([0, len(data)]))[0][0]

    hashes = [word(w) for w in words]
    size = simhash.TERM_WORDS
    terms = [range(i, i + size) for i in range(len(words) - size + 1)] or ([range(len(words))] if words else [])
    votes = np.zeros(simhash.BITS, int)
    for term in terms:
        h = np.zeros(1, np.uint64)
        for i in term:
            h = mixed(h ^ hashes[i])
        weight = min(sum(len(words[i]) for i in term) // simhash.BYTES_PER_WEIGHT + 1, simhash.LARGEST_WEIGHT)
        parts = [mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(simhash.BITS // 64)]
        bits = np.unpackbits(np.concatenate(parts).view(np.uint8)).astype(int)
        votes += weight * (2 * bits - 1)
    return np.packbits(votes > 0).tobytes()


def brute(rows):
    ordered = sorted(((i, text or "") for i, text in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, b, c = simhash.fingerprints_of([text]) + simhash.fingerprints_of([changed]) + simhash.fingerprints_of([following])
        sha = hashlib.sha256(changed.encode()).hexdigest()
        out.append((i, len(text), sha, a.hex(), b.hex(), simhash.likeness(a, b), simhash.likeness(a, c)))
    return Counter(out)


def test_fingerprints_equal_votes_term_by_term(sample):
    texts = [text for _, text in sample[1][:60]] + ["", " ", "a", "A b", "a b c", "a b c d"]
    assert simhash.fingerprints_of(texts) == [brute_fingerprint(text) for text in texts]


@pytest.mark.parametrize("ranges", [1, 5, 60])
def test_neighbours(make, sample, ranges):
    rows = ODD
    docs = make(rows, clash=("place", "home", "guest"))
    assert Counter(map(tuple, simhash.beside_next(docs, ranges).collect())) == brute(rows)
    docs, rows = sample
    assert Counter(map(tuple, simhash.beside_next(docs, ranges).collect())) == brute(rows)


def test_small_tables(make):
    assert simhash.beside_next(make([]), 4).count() == 0
    alone = simhash.beside_next(make([(1, "some words stand here")]), 4).collect()
    assert alone[0].near_next == 1.0


def test_edited_texts_are_nearer_than_next_ones(sample):
    got = simhash.beside_next(sample[0], 4).collect()
    long = [row for row in got if row.n_chars > 300]
    assert np.mean([row.near_edited > row.near_next for row in long]) > 0.9


def hexes(spark, values, named=False):
    digits = simhash.BITS // 4
    rows = [(f"{v:0{digits}x}", f"{v:0{digits}x}") for v in values]
    table = spark.createDataFrame(rows, "fingerprint string, name string")
    return table if named else table.select("fingerprint")


@pytest.mark.parametrize("bucket", [1, 40, 1 << 15])
def test_search_finds_all_within_the_radius(spark, monkeypatch, bucket):
    """Against all distances; small buckets make many leading bits and split ones."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "_AT_ONCE", 700)
    rnd = random.Random(2)
    centres = [rnd.getrandbits(simhash.BITS) for _ in range(6)]
    values = set(centres)
    for centre in centres:
        for distance in range(simhash.RADIUS + 3):  # every distance up to the radius and beyond, twice
            for _ in range(2):
                values.add(centre ^ sum(1 << f for f in rnd.sample(range(simhash.BITS), distance)))
    # The hardest pairs: as many bits in each block as the radius allows.
    values |= {centres[0] ^ sum(7 << (32 * k) for k in range(8)) ^ (1 << 40), centres[0] ^ sum((3 if k == 5 else 7) << (32 * k) for k in range(8))}
    got = simhash.search(hexes(spark, centres), hexes(spark, values, named=True)).collect()
    digits = simhash.BITS // 4
    expected = {
        (f"{a:0{digits}x}", f"{b:0{digits}x}", (a ^ b).bit_count())
        for a in centres
        for b in values
        if a != b and (a ^ b).bit_count() <= simhash.RADIUS
    }
    assert {d for _, _, d in expected} == set(range(1, simhash.RADIUS + 1))
    assert len(got) == len(expected) and set(map(tuple, got)) == expected


def test_near_counts_equal_all_distances(sample, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 5)
    docs, rows = sample
    prints = dict(zip([i for i, _ in rows], simhash.fingerprints_of([text for _, text in rows]), strict=True))
    name = {}
    for i, x in prints.items():
        name[int.from_bytes(x, "big")] = min(i, name.get(int.from_bytes(x, "big"), i))
    for radius in (15, simhash.RADIUS):
        got = simhash.with_near_counts(simhash.fingerprints(docs), every=5, radius=radius).collect()
        assert len(got) == len(rows)
        for row in got:
            own = int.from_bytes(prints[row.doc_id], "big")
            near = sorted(((own ^ other).bit_count(), i) for other, i in name.items() if 0 < (own ^ other).bit_count() <= radius)
            asked = row.doc_id % 5 == 0
            assert row.n_near == (len(near) if asked else None)
            assert (row.near_distance, row.near_id) == (near[0] if near and asked else (None, None))


def shingled(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_near_copies_lie_within_the_radius(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(row.doc_id, row.text, shingled(row.text)) for row in docs.collect()]
    holders = {}
    for k, (_, _, shingles) in enumerate(rows):
        for shingle in shingles:
            holders.setdefault(shingle, []).append(k)
    pairs = {(a, b) for at in holders.values() if len(at) < 60 for a in at for b in at if a < b}
    near = [(a, b) for a, b in pairs if 4 * len(rows[a][2] & rows[b][2]) >= 3 * len(rows[a][2] | rows[b][2])]
    near = [(a, b) for a, b in near if rows[a][2] != rows[b][2]]
    prints = dict(zip([i for i, _, _ in rows], simhash.fingerprints_of([text or "" for _, text, _ in rows]), strict=True))
    table = spark.createDataFrame([(i, found.hex()) for i, found in prints.items()], "name long, fingerprint string")
    classes = table.groupBy("fingerprint").agg({"name": "min"}).withColumnRenamed("min(name)", "name")
    listed = {(row.query, row.name) for row in simhash.search(classes.select("fingerprint"), classes).collect()}
    own = {row.fingerprint: row.name for row in classes.collect()}
    met = 0
    for a, b in near:
        one, two = prints[rows[a][0]].hex(), prints[rows[b][0]].hex()
        met += one == two or (one, own[two]) in listed
    assert len(near) >= 20 and met >= 0.9 * len(near)


def test_equal_fingerprints_null_and_repeated_ids(spark):
    values = {50: 0, 7: 0, None: 0, 100: (1 << 20) - 1, 8: (1 << 20) - 1, 9: 1 << 100, 11: (1 << 200) - 1}
    rows = [(i, f"{v:064x}") for i, v in values.items()] + [(100, f"{(1 << 20) - 1:064x}"), (None, f"{3:064x}")]
    got = simhash.with_near_counts(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()
    found = {row.doc_id: (row.class_id, row.n_same, row.n_near, row.near_id, row.near_distance) for row in got}
    assert found[50] == (7, 2, 3, 9, 1)
    assert found[100] == (8, 2, 3, None, 18)
    assert len(got) == 9 and found[7] == found[None] == found[11] == (None,) * 5
    empty = spark.createDataFrame([], "doc_id long, fingerprint string")
    assert simhash.with_near_counts(empty).collect() == []
