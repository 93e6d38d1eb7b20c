import random
from itertools import combinations

import corpus_pipeline
from quillon.llm import nearcopies, simhash
from tests.llm import cases, test_simhash


def brute_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_kept(data):
    """Smallest ids of components by fingerprints within 2 bits or five-word shingles of similarity 0.8."""
    sets, bits = [brute_set(r[1]) for r in data], [test_simhash.brute_bits(r[1]) for r in data]
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(data)), 2):
        both = len(sets[i] & sets[j])
        if (bits[i] ^ bits[j]).bit_count() <= 2 or both and both / len(sets[i] | sets[j]) >= 0.8:
            parent[root(i)] = root(j)
    roots = [root(i) for i in range(len(data))]
    return sorted(min(data[i][0] for i, o in enumerate(roots) if o == own) for own in set(roots))


def edited(rng, text, edits):
    w = text.split()
    for k in rng.sample(range(len(w)), edits):
        w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def near_cases():
    rng = random.Random(8)
    data = [r for r in cases.rows() if r[0] is not None and r[0] != 108]
    i = 1000
    for n in (5, 12, 60, 100, 300, 1000, 3000):
        for edits in (1, n // 50, n // 40, n // 20):
            base = cases.words(rng, n, 5000)
            data += [(i, base, "en", "a"), (i + 1, edited(rng, base, max(edits, 1)), "en", "a"), (i + 2, edited(rng, base, max(edits, 1)).upper(), "en", "a")]
            i += 3
    line, base = cases.words(rng, 12), cases.words(rng, 90, 5000)
    data += [(i + k, f"{cases.words(rng, 30, 5000)} {line}", "en", "a") for k in range(30)]
    data += [(i + 30 + k, edited(rng, base, 1), "en", "a") for k in range(40)]
    return data


def test_stage_leaves_no_near_copies(spark):
    data = near_cases()
    docs = cases.documents(spark, data)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = sorted(r["doc_id"] for r in stage(spark, docs, "").collect())
    assert got == brute_kept(data) and len(got) < simhash.deduplicated(docs).count()


def test_sets_are_those_of_words():
    import pyarrow as pa

    texts = [r[1] or "" for r in near_cases()] + ["", " A  b\tC d e F ", "a b c d e f"]
    sets = list(nearcopies.shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts] and sets[-1].tolist() == sets[-2].tolist()


def test_edge_cases(spark):
    assert nearcopies.deduplicated(cases.empty(spark)).count() == 0
    docs = cases.documents(spark)
    kept = nearcopies.deduplicated(docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0 and kept.where("doc_id = 107").count() == 1


def test_groups_larger_than_a_unit(spark, monkeypatch):
    """Components and shingles of many texts: chains whose ends are no near copies, copies, and texts that share a passage only."""
    monkeypatch.setattr(nearcopies, "CROWD", 8)
    rng = random.Random(12)
    data, i = [], 0
    for _ in range(3):
        text = cases.words(rng, 40, 5000)
        for _ in range(30):
            data.append((i, text, "en", "a"))
            text, i = edited(rng, text, 1), i + 1
    base, passage = cases.words(rng, 50, 5000), cases.words(rng, 30, 5000)
    data += [(i + k, edited(rng, base, 1 + k % 3), "en", "a") for k in range(60)]
    data += [(i + 60 + k, f"{passage} {cases.words(rng, 4 + k % 9, 5000)}", "en", "a") for k in range(60)]
    got = sorted(r["doc_id"] for r in nearcopies.deduplicated(cases.documents(spark, data)).collect())
    assert got == brute_kept(data)


def test_common_shingles_go_last(spark, monkeypatch):
    """Texts that share a twentieth of their shingles with nine others don't meet, however many rare shingles there are."""
    monkeypatch.setattr(nearcopies, "SAMPLE", 1, raising=False)
    rng, members, written = random.Random(3), [], nearcopies.shared.written
    passages = [cases.words(rng, 24, 10**6) for _ in range(300)]
    data = [(i, f"{cases.words(rng, 380, 10**6)} {passages[i % 300]}", "en", "a") for i in range(3000)]

    def spied(df, tag):
        out = written(df, tag)
        if tag == "near-members":
            members.append(out.count())
        return out

    monkeypatch.setattr(nearcopies.shared, "written", spied)
    assert nearcopies.links(cases.documents(spark, data)).count() == 0 and members == [0]
