import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from llm_helpers import rows
from weftplan.llm import simhash
from weftplan.llm.components import components, forest


def union_find(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


SHAPES = {
    "chain": [(i, i + 1) for i in range(40)],
    "star": [(1000, i) for i in range(60)],
    "two": [(1, 2), (5, 6), (6, 7), (2, 1)],
    "random": [(random.Random(i).randrange(300), random.Random(f"b{i}").randrange(300)) for i in range(1, 180)],
    "clique": [(i, j) for i in range(12) for j in range(12)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, shape):
    links = SHAPES[shape]
    got = components(spark.createDataFrame(links + [(None, 1), (3, 3)], "a long, b long"))
    want = union_find([(a, b) for a, b in links if a != b])
    assert dict(rows(got)) == want and got.count() == len(want)
    a, b = forest(*np.array([x for x in links if x[0] != x[1]]).T)
    assert union_find(zip(a.tolist(), b.tolist())) == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").split(b" ") if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", "one", "One two", "a b c", "É É é x y z", "A a A a A a A", "w " * 50 + "\n\tq"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def brute(fps, radius):
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i:] if (a ^ b).bit_count() <= radius]
    return union_find(links)


@pytest.mark.parametrize("tile", [3, 4096])
@pytest.mark.parametrize("radius", [0, 2, 3])
def test_links_against_brute_force(spark, tile, radius):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = set(base)
    for x in base:
        for _ in range(6):
            fps.add(x ^ sum(1 << b for b in set(r.choices(range(64), k=r.randrange(1, 5)))))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), radius, tile)
    got = union_find([(a % (1 << 64), b % (1 << 64)) for a, b in rows(links)])
    want = {k: v for k, v in brute(fps, radius).items()}
    group = lambda m: {frozenset(k for k in fps if m.get(k, k) == v) for v in {m.get(k, k) for k in fps}}
    assert group(got) == group(want)


def test_hard_rows(spark, hard_docs):
    got = simhash.near_duplicates(hard_docs)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    texts = {r.doc_id: r.text for r in hard_docs.collect()}
    assert got.count() == hard_docs.count() and all(f == f"{plain_fingerprint(texts[k]):016x}" for k, v in by.items() if k is not None for f, _ in v)
    assert {c for k in (1, 6, None) for f, c in by[k] if f != "0" * 16} == {1} and by[2] == by[3] == by[7] == [("0" * 16, 2)]
    assert by[5][0][1] == 4 and simhash.near_duplicates(hard_docs.limit(0)).count() == 0
    kept = simhash.deduplicate(hard_docs)
    assert kept.columns == hard_docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 4, 8, 9, 10, 11, None} - ({11} if by[11][0][1] == 10 else set())
