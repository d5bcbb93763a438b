import zlib

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import bpe, packing

ODD = [
    None, "", " \t\n", "a<|endoftext|>B <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext|",
    "aaaa aaa aaaaaaa hahahahaha ananananwh", "ΣΑΣ ÉİǅŸ é ẛ̣ Å ﷺ ½ Ⅷ 日本語 👩‍👩‍👧", "x\x1cy\x1d \x85z  w　v",
    "'S don'T i'll 12ab34 --- a.b,c", "q" * 3000, "it's " * 2000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(ODD)) + [(100 + d, t) for d, t in brute.corpus(11, 30)] + [(0, ODD[3]), (None, "null id")]


def test_round_trip(spark, tokenizer, rows):
    docs = brute.docs_frame(spark, rows)
    encoded = bpe.encode(docs)
    got = sorted(((r["doc_id"], list(r["ids"])) for r in encoded.collect()), key=str)
    want = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in rows]
    assert got == sorted(want, key=str)
    texts = sorted(((r["doc_id"], r["text"]) for r in bpe.decode(encoded).collect()), key=str)
    assert texts == sorted([(d, tokenizer.decode(ids, skip_special_tokens=False)) for d, ids in want], key=str)
    digests = {r["doc_id"]: r["n_tokens"] for r in bpe.digests(docs).collect()}
    assert digests == {d: len(ids) for d, ids in want}


def test_empty_table(spark):
    docs = brute.docs_frame(spark, [])
    assert bpe.encode(docs).count() == bpe.digests(docs).count() == packing.pack(docs).count() == 0


def best_cost(places, penalties, size):
    """All choices of cuts, each of them at most `size` after the one before."""
    n, best = len(places), {0: (0, ())}
    for j in range(1, n):
        found = []
        for i in range(j):
            if i in best and places[j] - places[i] <= size:
                pad = 0 if j == n - 1 else penalties[j] + size - (places[j] - places[i])
                found.append(best[i][0] + pad)
        best[j] = (min(found), ())
    return best[n - 1][0]


def test_cuts_are_best():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        places = np.append(0, np.cumsum(rnd.integers(1, 9, rnd.integers(1, 30)))).tolist()
        penalties = rnd.integers(0, 7, len(places)).tolist()
        cuts = packing.best_cuts(places, penalties, 10)
        assert cuts[-1] == len(places) - 1
        steps = list(zip([0, *cuts[:-1]], cuts, strict=True))
        assert all(places[j] - places[i] <= 10 for i, j in steps)
        cost = sum(penalties[j] + 10 - places[j] + places[i] for i, j in steps[:-1])
        assert cost == best_cost(places, penalties, 10)


@pytest.mark.parametrize("size", [64, 2048])
def test_packing(spark, tokenizer, rows, size):
    rows = [r for r in rows if r != (0, ODD[3])]
    found = packing.pack(brute.docs_frame(spark, rows).repartition(2), size=size).toPandas()
    pieces: dict = {}
    for r in found.itertuples():
        pieces.setdefault(None if r.doc_id != r.doc_id else r.doc_id, []).append(r)
    assert len(pieces) == len(rows)
    for doc, text in rows:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted(pieces[doc], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
        assert ids == want
        assert all(r.doc_tokens == len(want) for r in own)
        assert [r.start for r in own] == np.append(0, np.cumsum([r.length for r in own])[:-1]).tolist()
    for _, seq in found.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.length.sum() <= size
        assert seq.offset.tolist() == np.append(0, seq.length.cumsum()[:-1]).tolist()
    assert zlib.crc32(found.ids[0]) >= 0
