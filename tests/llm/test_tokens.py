import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from verdigris.llm import bpe, packing

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    (1, None), (2, ""), (3, "  two  spaces \n\n\t end "), (4, "naïve 😀 ​\u0000 <|endoftext|> don't"), (5, "word " * 9000),
    (6, "x" * 3000), (7, "once"), (7, "once"), (None, "no id"), (8, "ÀÉ١٢٣ ½ 中文字"), (9, "x <|endoftext|> y"), (10, "<|endoftext|><|endoftext|>"), (11, "<|endoftext|>"),
    (12, "<|endoftext |> <|endoftext|"), (13, "end  <|endoftext|>  \n<|endoftext|>'s"), (14, "<<|endoftext|>>" * 500),
]


def by_library():
    tokenizer = Tokenizer.from_file(JSON)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def check_pieces(docs, rows):
    encode = by_library()
    wanted = Counter()
    for i, text in rows:
        wanted[(i, tuple([*encode(text), packing.END_ID]))] += 1
    got = packing.pieces(docs, JSON).collect()
    filled = defaultdict(list)
    for row in got:
        filled[row.sequence_id].append((row.offset, row.length))
    for number, parts in filled.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == packing.WINDOW or number == max(filled)
    assert set(filled) == set(range(len(filled)))
    # Every document has its ids in pieces; documents of one id are told apart by their ids.
    whole = defaultdict(list)
    for row in got:
        whole[row.doc_id].append(row)
    for i, ids in wanted:
        own = [row for row in whole[i] if row.doc_tokens == len(ids)]
        assert sum(row.length for row in own) >= len(ids)
        for row in own:
            part = np.array(ids[row.start : row.start + row.length], "<u4").tobytes()
            assert zlib.crc32(part) == row.ids_crc32
    assert sum(row.length for row in got) == sum(len(ids) * n for (_, ids), n in wanted.items())


def test_pieces(make, sample):
    check_pieces(make(ODD, clash=("ids", "part", "offset")), ODD)
    check_pieces(*sample)
    assert packing.pieces(make([]), JSON).count() == 0


def test_sequences_hold_all_ids(sample):
    docs, rows = sample
    encode = by_library()
    got = sorted(packing.sequences(docs, JSON).collect())
    assert [row.sequence_id for row in got] == list(range(len(got)))
    assert all(len(row.ids) == packing.WINDOW for row in got[:-1])
    assert Counter(x for row in got for x in row.ids) == Counter(
        x for _, text in rows for x in [*encode(text), packing.END_ID]
    )


def test_round_trip_equals_the_library(make, sample):
    reference = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_vocabulary(RANKS).ranks, special_tokens={}
    )
    for docs, rows in ((make(ODD, clash=("ids", "data")), ODD), sample):
        expected = Counter()
        for i, text in rows:
            ids = reference.encode_ordinary(text or "")
            ids_sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            expected[(i, len(ids), ids_sha, hashlib.sha256((text or "").encode()).hexdigest())] += 1
        got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
        assert Counter(map(tuple, got.collect())) == expected
    assert bpe.round_trip(make([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_prefixes_under_appends_and_edits():
    vocabulary, rnd = bpe.load_vocabulary(RANKS), random.Random(3)
    assert not vocabulary.unreachable

    def draw(most):
        return "".join(rnd.choice("aaeinort hs é\n") for _ in range(rnd.randint(0, most))).encode()

    for _ in range(60):
        table = bpe.Prefixes(vocabulary, draw(300))
        for _ in range(8):
            if rnd.random() < 0.4:
                table.append(draw(20))
            else:
                start = rnd.randint(0, len(table.data))
                table.splice(start, rnd.randint(start, min(len(table.data), start + 9)), draw(9))
            anew = bpe.Prefixes(vocabulary, table.data)
            assert table.last == anew.last
            if table.data and table.data not in vocabulary.ranks:
                assert table.ids() == vocabulary.merged(table.data)
    long = bpe.Prefixes(vocabulary, b"the quick brown fox " * 400)
    long.splice(4000, 4005, b"zebra")
    assert long.redone < 400
