import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from rubrica.llm import packing
from rubrica.llm.queries import TOKENIZER
from tests.llm.conftest import rows

ODD = list("ab 1'st  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0é!?中²Ⅷ3") + ["<|endoftext|>", "'s", "word", "Word's", chr(0x2003), chr(0x3000), chr(0x180E), chr(0x200B)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()


def test_units_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(1)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:80]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    encode = packing.encoder(TOKENIZER)
    for t in texts:
        assert encode(t) == ids_of(tokenizer, t)[:-4], repr(t)


def whole(pieces, window):
    """Pieces by document and by sequence are gapless; the padding they leave."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for doc, start, n, total, number, at, ids in pieces:
        docs[doc].append((start, n, total, ids))
        sequences[number].append((at, n))
    for held in docs.values():
        held.sort()
        assert [h[0] for h in held] == np.cumsum([0] + [h[1] for h in held])[:-1].tolist()
        assert all(h[2] == held[-1][0] + held[-1][1] for h in held)
    padding = 0
    for held in sequences.values():
        held.sort()
        assert [h[0] for h in held] == np.cumsum([0] + [h[1] for h in held])[:-1].tolist()
        fill = sum(h[1] for h in held)
        assert 0 < fill <= window
        padding += 0 if fill & (fill - 1) == 0 else window - fill
    return docs, padding


@pytest.mark.parametrize("most", [3, 4096])
def test_packer(most):
    rng = random.Random(2)
    made = [np.arange(rng.choice([1, 3, 20, 33, 40, 63, 64, 100, 300]), dtype="<u4").tobytes() for _ in range(2000)]
    packer, pieces = packing.Packer(64, most), []
    for i, ids in enumerate(made):
        pieces += packer.put(i, ids)
        assert packer.n_open <= most
    pieces += packer.finish()
    docs, padding = whole(pieces, 64)
    assert padding == 0
    for i, ids in enumerate(made):
        assert b"".join(h[3] for h in docs[i]) == ids


def test_placement_minimises_the_sum_of_squares():
    rng = random.Random(3)
    packer = packing.Packer(16)
    for i in range(500):
        n = rng.randint(1, 15)
        before = packer.counts.copy()
        cost = {}
        for h in [0] + [x for x in range(1, 16) if before[x]]:
            if h + n <= 16:
                after = before.copy()
                after[h] -= h > 0
                after[h + n] += h + n < 16
                cost[h] = int((np.where(packer.free, 0, after) ** 2).sum())
        packer.put(i, np.zeros(n, dtype="<u4").tobytes())
        assert int((np.where(packer.free, 0, packer.counts) ** 2).sum()) == min(cost.values())


def test_documents(docs, tokenizer):
    texts = ["", None, "Hello world's end", "long text " * 4000, "x", "x"] + ["some words here"] * 40
    got = rows(packing.pack(docs(texts).repartition(3), TOKENIZER))
    held, padding = whole(got, 2048)
    assert padding == 0
    for i, t in enumerate(texts):
        assert b"".join(bytes(h[3]) for h in held[i]) == ids_of(tokenizer, t)
    crc = {(r[0], r[1]): r[3] for r in rows(packing.pack_digest(docs(texts), TOKENIZER))}
    assert crc[(0, 0)] == zlib.crc32(b"\x01\0\0\0")
    assert rows(packing.pack(docs(texts).limit(0), TOKENIZER)) == []
    assert len(rows(packing.pack(docs(["a b", "a b"], ids=[None, None]), TOKENIZER))) >= 2
