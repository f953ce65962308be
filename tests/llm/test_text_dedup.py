import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from weftplan.llm import line_dedup, suffix_dedup


def brute(texts, length):
    """For each text: a mask of the bytes that a repeated string covers."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        mask = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append((r, mask))
    return out


def digest(r, mask):
    gone = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])) == 1)
    return len(r), int(mask.sum()), len(gone), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~mask])).hexdigest()


def corpus(seed):
    r = random.Random(seed)
    letters = "abcdefgh é"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [word(k) for k in (30, 39, 40, 41, 60, 150, 400)]
    texts = []
    for _ in range(120):
        parts = [word(r.randrange(80))]
        for _ in range(r.randrange(4)):
            parts += [r.choice(shared)[r.randrange(6) :], word(r.randrange(50))]
        texts.append("".join(parts))
    texts += texts[:10] + [None, "", "a" * 500, "ab" * 300, "ab" * 10, "x" * 39, "x" * 40, "é" * 100, texts[3] + texts[4]]
    return texts


@pytest.mark.parametrize("group", [1, 4, 256])
@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_against_brute_force(spark, seed, group, monkeypatch):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, length, k, f=suffix_dedup.repeated_spans: f(d, length, k, group=group))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.remove_repeated(df, length=40, k=32)).collect()}
    assert got == {i: digest(*x) for i, x in enumerate(brute(texts, 40))}


@pytest.mark.parametrize("size", [150, 230])
def test_suffix_dedup_of_a_line_in_very_many_texts(spark, size, monkeypatch):
    r = random.Random(size)
    some = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    line = some(size)
    texts = [some(r.randrange(150, 220)) + line + some(r.randrange(150, 220)) for _ in range(3000)]
    seen = {}

    def refined(hot, length, group, f=suffix_dedup.refined):
        seen["hot"] = hot.count()
        out = f(hot, length, group)
        seen["small"], seen["alike"] = (sum(x.count() for x in part) for part in out[::-1])
        return out

    monkeypatch.setattr(suffix_dedup, "refined", refined)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digest(suffix_dedup.remove_repeated(df)).collect()}
    assert got == {i: digest(*x) for i, x in enumerate(brute(texts, 200))}
    # every phrase of the hot triggers goes to a few homes, however many meet it
    assert seen["hot"] >= 2000 and seen["small"] <= 2 * seen["hot"] and seen["alike"] <= 7 * seen["hot"]


def test_blocks_do_not_matter(monkeypatch):
    raw = "".join(corpus(3)[:60]).encode()
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.phrases(raw, 40, 32))]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.phrases(raw, 40, 32))]

    def places(x):
        return {(i, int(h), int(g)) for a, b, h, g in zip(*x) for i in range(a, b + 1)}

    assert places(whole) == places(parts) and {i for i, _, _ in places(whole)} == set(range(len(raw) - 39))


def test_suffix_dedup_hard_rows(spark, hard_docs):
    got = suffix_dedup.digest(suffix_dedup.remove_repeated(hard_docs))
    texts = [r.text for r in hard_docs.collect() if r.text is None or len(r.text) < 10_000]
    want = Counter(digest(*x) for x in brute(texts, 200))
    have = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect() if r.n_bytes < 10_000)
    assert have == want and got.count() == hard_docs.count()
    assert sorted((r.n_bytes, r.n_removed) for r in got.where("n_bytes >= 10000").collect())[0] == (100_000, 100_000)
    assert suffix_dedup.remove_repeated(hard_docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeated(hard_docs, length=20, k=32)


def lines_by_hand(docs, min_words, cut="\n"):
    """docs: (id, text) in order of rank."""
    seen, out = set(), []
    for _, text in docs:
        kept = []
        for u in (text or "").split(cut):
            norm = u.lower().split()
            if len(norm) >= min_words and tuple(norm) in seen:
                continue
            if len(norm) >= min_words:
                seen.add(tuple(norm))
            kept.append(u)
        out.append(None if text is None else cut.join(kept))
    return out


def passages_by_hand(docs, size=line_dedup.SIZE, step=line_dedup.STEP):
    """docs: (id, text) in order of rank. The words that stay of each text, and its number of removed stretches."""
    h = lambda w: hashlib.md5(w.encode()).digest()[:8]
    seen, out = set(), []
    for _, text in docs:
        words = (text or "").encode().lower().decode().split(" ") if text else []
        words = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in " ".join(words)).split(" ") if w]
        m, gone = len(words) - size + 1, set()
        begins = {0, m - 1} if m > 0 else set()
        for a in range(m - step + 1):
            begins.add(min(range(a, a + step), key=lambda i: (h(words[i]), h(words[i + 1]) if i + 1 < len(words) else b"", i)))
        for i in sorted(begins):
            unit = tuple(words[i : i + size])
            if unit in seen:
                gone |= set(range(i, i + size))
            seen.add(unit)
        out.append(([w for i, w in enumerate(words) if i not in gone], sum(i - 1 not in gone for i in gone)))
    return out


def passage_corpus(seed, n=80):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé ".strip()) for _ in range(r.randrange(1, 6))) for _ in range(60)]
    some = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [some(k) for k in (20, 35, 36, 48, 49, 50, 60, 200)]
    texts = ["\n".join(x for _ in range(r.randrange(1, 4)) for x in (some(r.randrange(30)) + " " + r.choice(shared).upper() + "  " + some(r.randrange(30)),)) for _ in range(n)]
    return texts + texts[:8] + [None, "", " \t\n", some(35), some(36), "a " * 120, "a b " * 80, some(100).replace(" ", "\n\n\t")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passage_dedup_against_brute_force(spark, seed):
    docs = list(enumerate(passage_corpus(seed)))
    got = {r.doc_id: r for r in line_dedup.remove_repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    for (i, text), (kept, n) in zip(docs, passages_by_hand(docs)):
        r = got[i]
        assert (r.text is None) == (text is None) and (r.text or "").encode().lower().split() == [w.encode() for w in kept] and len(r.removed or []) == n
        if r.removed:  # offsets are those of the original text, and what is left is the rest of it
            edges = [0, *(x for s in r.removed for x in s), len(text)]
            left = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            assert r.text == (left.rstrip() if r.removed[-1].end == len(text) else left)
        else:
            assert r.text == text


def test_passages_of_49_words_are_found_wherever_they_stand():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    for _ in range(50):
        passage = [word() for _ in range(line_dedup.SIZE + line_dedup.STEP - 1)]
        found = []
        for _ in range(2):
            words = [word() for _ in range(r.randrange(80))] + passage + [word() for _ in range(r.randrange(80))]
            found.append({d for _, d in line_dedup.text_units("\n".join(words), "passage", 0)})
        assert found[0] & found[1]


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_line_dedup(spark, unit):
    r = random.Random(7)
    cut = line_dedup.SEPARATOR[unit]
    units = [" ".join(r.choice("ab cd ef gh".split()) for _ in range(r.randrange(1, 7))) for _ in range(25)]
    docs = [(i, cut.join(r.choice([u, u.upper(), "  " + u.replace(" ", "  ")]) for u in r.choices(units, k=r.randrange(6)))) for i in range(60)] + [(60, None), (61, "")]
    got = line_dedup.remove_repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), unit, 3).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.doc_id)] == lines_by_hand(docs, 3, cut)
    for r in got:  # offsets are those of the original text
        text = dict(docs)[r.doc_id]
        for x in r.removed or []:
            assert len(text[x.start : x.end].split()) >= 3 and (x.start == 0 or text[: x.start].endswith(cut))


def test_line_dedup_hard_rows(spark, hard_docs):
    clash = hard_docs.selectExpr("*", "'a' removed", "'b' _k", "'c' k", "'d' row", "'e' at", "'f' i", "'g' x", "'h' d1", "cast(null as string) rank")
    for unit in ("passage", "line", "paragraph"):
        got = line_dedup.remove_repeated(clash, unit)
        assert sorted(got.columns) == sorted(clash.columns) and {(r._k, r.k, r.row, r.at, r.i, r.x, r.d1, r.rank) for r in got.collect()} == {("b", "c", "d", "e", "f", "g", "h", None)}
        by = {}
        for r in got.collect():
            by.setdefault(r.doc_id, []).append(r.text)
        assert sum(map(len, by.values())) == hard_docs.count()
        assert by[2] == [None] and by[3] == [""] and by[5] == [""] and len(by[4][0]) > 1000 and sorted(map(str, by[None])) == ["None", "a b c"]
        assert line_dedup.remove_repeated(hard_docs.limit(0), unit).count() == 0
    with pytest.raises(ValueError):
        line_dedup.remove_repeated(hard_docs, "page")
