import random
import zlib

import numpy as np
import pytest

from quillon.llm import packing, queries
from tests.llm import cases


@pytest.fixture(scope="module")
def path():
    return queries.default_tokenizer()


def test_ids_of_both_libraries_agree(path):
    fast, slow = packing.Ids(path), packing.Ids(path)
    slow.fast = None
    rng = random.Random(1)
    letters = [*"abZ é字1½²Ⅷ_.,'sd\n\t  　 \x00\x1c\x85|<>", "  ", "'ll", "<|endoftext|>", "\r\n", "\U0001f600"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert fast.fast is not None and fast.encode(texts) == slow.encode(texts)


def test_added_tokens_in_texts_have_their_ids(spark, path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "no such token", "<|endoftext|><|endoftext|> é\n", "<|endoftext|"]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.Ids(path).encode(texts) == want and np.frombuffer(want[0], "<u4").tolist() == [64, 50256, 65]
    got = packing.packed(cases.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), path).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in got} == {i: zlib.crc32(w + packing.END) for i, w in enumerate(want)}


def brute_best_fit(lengths, size):
    """The number of sequences of best-fit decreasing, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return len(rooms)


def test_rounds_are_best_fit(path):
    rng = np.random.default_rng(3)
    for _ in range(30):
        size = int(rng.integers(3, 60))
        lengths = rng.integers(1, size + 1, int(rng.integers(1, 300)))
        moves = packing.best_fit(np.bincount(lengths, minlength=size + 1), size)
        assert sum(m[2] for m in moves) == len(lengths)
        used = {}
        for n, _, k, first, offset in moves:
            for s in range(first, first + k):
                used.setdefault(s, []).append((offset, n))
        for parts in used.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= size
        assert len(used) == brute_best_fit(lengths.tolist(), size)


def check(spark, path, data, length):
    got = packing.packed(cases.documents(spark, data), path, length).collect()
    ids = packing.Ids(path)
    want = sorted((r[0], e + packing.END) for r, e in zip(data, ids.encode([r[1] or "" for r in data])) if True) if all(r[0] is not None for r in data) else None
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    if want and len({w[0] for w in want}) == len(want):
        for doc, raw in want:
            mine = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["piece"])
            assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(raw) // 4
            assert all(r["length"] == length for r in mine[1:])
            assert all(zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for r in mine)
    return got, by


def test_pieces_cover_documents(spark, path):
    data = [r for r in cases.rows() if r[0] is not None and r[0] != 108]
    got, by = check(spark, path, data, 64)
    assert len(by) <= sum(r["length"] for r in got) / 64 * 1.02 + 1


def test_edge_cases(spark, path):
    data = cases.rows()
    got, _ = check(spark, path, data, 2048)
    assert len({(r["doc_id"], r["piece"]) for r in got}) < len(got)  # repeated rows are packed each
    check(spark, path, [(i, "same text", "en", "a") for i in range(500)], 32)
    assert packing.packed(cases.empty(spark), path).count() == 0
