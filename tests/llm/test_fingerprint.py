import hashlib
import random

import numpy as np

from quillon.llm import fingerprint as fp
from tests.llm import cases


def brute_chunks(data: bytes) -> list[bytes]:
    out, start, h = [], 0, []
    x = 0
    for b in data:
        x = ((x << 4) + int(fp.GEAR[b])) & 0xFFFFFFFF
        h.append(x)
    while start < len(data):
        end = start + fp.LEAST
        while end < min(len(data), start + fp.MOST) and h[end - 1] & int(fp.HARD if end - start < fp.NORMAL else fp.EASY):
            end += 1
        out.append(data[start : min(end, len(data))])
        start = min(end, len(data))
    return out


def test_chunks_are_those_of_a_byte_loop():
    rng = random.Random(4)
    texts = ["", "a", "ab" * 400, "été" * 90, *(cases.words(rng, rng.randrange(1, 300)) for _ in range(20))]
    got = fp.Fingerprints(texts)
    for i, t in enumerate(texts):
        assert got.bytes[i] == sum(map(len, set(brute_chunks(t.encode()))))
        assert len(got.strings()[i]) == 12 * len(set(brute_chunks(t.encode())))


def brute(rows):
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] is not None, r[1] or ""))
    out = []
    for k, (i, text, *_) in enumerate(order):
        a, b = text or "", order[(k + 1) % len(order)][1] or ""
        e = fp.edited(a, b)
        sets = [set(brute_chunks(x.encode())) for x in (a, e, b)]
        own = sum(map(len, sets[0]))
        near = [sum(map(len, sets[0] & s)) / own if own else float(not s) for s in sets[1:]]
        out.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), *near))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    for data in (cases.rows(), [(5, "alone in the table", "en", "a")], [(1, None, None, None), (2, "", None, None)]):
        got = fp.fingerprinted(cases.documents(spark, data), target=2000).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got), key=str) == brute(data)
        by_text = {}
        for r in got:
            assert by_text.setdefault(r["doc_id"], r["fingerprint"]) == r["fingerprint"] or r["doc_id"] is None
    assert fp.fingerprinted(cases.empty(spark)).count() == 0


def test_shifted_text_keeps_its_chunks():
    text = cases.words(random.Random(1), 2000, 10**6)
    f = fp.Fingerprints([text, "some words put before it " + text])
    assert f.likeness(1, f, 1)[0] > 0.99
    assert np.isclose(fp.Fingerprints([text]).likeness(1, fp.Fingerprints([text]))[0], 1)


def test_a_doc_id_that_most_rows_have(spark):
    rng = random.Random(4)
    for hot in (7, None):
        data = [(i if i % 4 == 0 else hot, cases.words(rng, rng.randrange(0, 30)), "en", "a") for i in range(200)]
        got = fp.fingerprinted(cases.documents(spark, data), target=500).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got), key=str) == brute(data)
