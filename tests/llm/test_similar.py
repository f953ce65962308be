import random

import numpy as np
import pytest

from test_components_simhash import union_find
from weftplan.llm import similar
from weftplan.llm.simhash import fingerprint


def shingle_set(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a, b, similarity=0.8):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) >= similarity * len(x | y) if x and y else x == y


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 6)))
    texts = []
    for _ in range(n):
        words = [word() for _ in range(r.randrange(60, 400))]
        texts.append(" ".join(words))
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            copy = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 3, 8])):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if r.random() < 0.2 else "  ".join(copy))
    r.shuffle(texts)
    return texts + ["", None, "a b", "a  B", "a b c d e f g"]


def test_spanning_forest_is_the_least():
    r = np.random.default_rng(1)
    for _ in range(60):
        n, m = int(r.integers(2, 30)), int(r.integers(1, 80))
        x, y, w = r.integers(0, n, m), r.integers(0, n, m), r.integers(0, 5, m)
        keep = x != y
        x, y, w = x[keep], y[keep], w[keep]
        got = similar.spanning(x, y, w, n)
        label, want = list(range(n)), []
        for at in sorted(range(len(x)), key=lambda i: (w[i], i)):
            a, b = label[x[at]], label[y[at]]
            if a != b:
                want.append(at)
                label = [a if v == b else v for v in label]
        assert sorted(got.tolist()) == sorted(want)


@pytest.mark.parametrize("tile", [7, 40, 1 << 16])
def test_links_join_all_within_the_radius(spark, tile, monkeypatch):
    r = random.Random(tile)
    fps = {r.getrandbits(64) for _ in range(120)}
    for f in list(fps)[:60]:
        for _ in range(3):
            for _ in range(r.randrange(1, 9)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    fps = list(fps)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = [(x.a, x.b) for x in similar.links(spark.createDataFrame(rows, "node long, fp long"), 6, tile).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 6 for a, b in got)
    want = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 6]
    assert union_find(got) == union_find(want)
    monkeypatch.setattr(similar, "BLOCK", 50)
    x = np.array(fps, dtype=np.uint64)
    for left, right, alone in ((x, x, True), (x[::2], x[1::2], False)):
        i, j, d = similar.tile_links(left, right, 6, alone)
        assert all(int(left[a] ^ right[b]).bit_count() == e <= 6 for a, b, e in zip(i, j, d))
        name = (lambda a, b: (int(a), int(b))) if alone else (lambda a, b: (2 * int(a), 2 * int(b) + 1))
        pairs = [(a, b) for a in range(len(left)) for b in range(len(right)) if (not alone or a < b) and int(left[a] ^ right[b]).bit_count() <= 6]
        assert union_find([name(a, b) for a, b in zip(i, j)]) == union_find([name(a, b) for a, b in pairs])


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), tile=50).collect()}
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if alike(texts[a], texts[b])]
    groups = union_find(pairs)
    want = {i: groups.get(i, i) for i in range(len(texts))}
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is linked that is not alike
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs) and len(pairs) > 50


def family(seed, n=70):
    """Copies of copies of a text, most of them alike to some others only."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = [[word() for _ in range(120)]]
    while len(texts) < n:
        copy = list(r.choice(texts))
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            copy[r.randrange(len(copy))] = word()
        texts.append(copy)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("tile", [20, 1 << 16])
def test_denied_links_of_a_forest_hide_no_others(spark, tile):
    """A link that SimHash finds and the texts bear out counts where nearer fingerprints of other texts lie between."""
    texts = [t for seed in range(4) for t in family(seed)]
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), tile=tile).collect()}
    fps = [fingerprint(t) for t in texts]
    close = [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 12]
    pairs = [(a, b) for a, b in close if alike(texts[a], texts[b])]
    groups = union_find(pairs)
    assert got == {i: groups.get(i, i) for i in range(len(texts))} and len(close) > 2 * len(pairs) > 200


@pytest.mark.parametrize("tile", [20, 1 << 16])
def test_open_links_are_all_that_can_be_similar(spark, tile, monkeypatch):
    monkeypatch.setattr(similar, "BITS", 128)
    texts = [t for seed in range(3) for t in family(seed, 40)] + ["", "a b", "a b c d e f"]
    fps, sets = [fingerprint(t) for t in texts], [similar.shingles(t) for t in texts]
    part = [i if i % 3 else i // 40 for i in range(len(texts))]
    sketches = [similar.sketch(s) for s in sets]
    differ = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(sketches[a], sketches[b]))
    rows = [(i, f - (1 << 64) if f >> 63 else f, part[i], len(sets[i]), sketches[i]) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node long, fp long, part long, n long, sketch binary")
    want = set()
    for b in range(len(texts)):
        for a in range(b):
            apart, total = len(np.setxor1d(sets[a], sets[b])), len(sets[a]) + len(sets[b])
            assert differ(a, b) <= apart
            if (fps[a] ^ fps[b]).bit_count() <= 12 and part[a] != part[b] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 9 * differ(a, b) <= total:
                want.add((a, b))
    assert want > {(a, b) for b in range(len(texts)) for a in range(b) if part[a] != part[b] and (fps[a] ^ fps[b]).bit_count() <= 12 and alike(texts[a], texts[b])}
    every = [(r.a, r.b) for r in similar.open_links(nodes, 0.8, 12, tile, True).collect()]
    assert len(every) == len(want) and set(every) == want
    some = {(r.a, r.b) for r in similar.open_links(nodes, 0.8, 12, tile, False).collect()}
    assert some < want and union_find(some) == union_find(want)


def test_near_duplicates_hard_rows(spark, hard_docs):
    got = similar.near_duplicates(hard_docs).collect()
    assert len(got) == hard_docs.count() and {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 1, 7: 2, 8: 8, 9: 9, 10: 10, 11: 10}
    assert sorted(r.component_id for r in got if r.doc_id is None) == [1, 2]
    kept = similar.deduplicate(hard_docs)
    assert kept.columns == hard_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "2", "4", "8", "9", "None", "None"]
    assert similar.near_duplicates(hard_docs.limit(0)).count() == 0 == similar.deduplicate(hard_docs.limit(0)).count()
