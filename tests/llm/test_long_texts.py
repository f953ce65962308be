"""Texts of 20 MB, with and without white space, through what each operator does with one text."""

import random
from collections import Counter

import numpy as np
import pytest

from weftplan.llm import ctw, line_dedup, mixing, similar, simhash, suffix_dedup, token_counts

SIZE = 20_000_000


@pytest.fixture(scope="module")
def spaced():
    r = random.Random(1)
    part = " ".join("".join(r.choices("abcdefgh", k=r.randrange(1, 9))) for _ in range(100_000))
    return (part + "\n") * (SIZE // len(part) + 1), part


def test_lines(spaced):
    text, part = spaced
    n = len(part.split())
    units = list(line_dedup.text_units(text, "passage", 0))
    seen = Counter(d for _, d in units)
    again = np.array([i for i, d in units if i >= n + line_dedup.STEP])  # the first part stays
    assert sum(v > 10 for v in seen.values()) > 0.9 * n * 2 / (line_dedup.STEP + 1) * 0.9
    (span,) = line_dedup.spans(text, again)
    assert span[0] <= len(part) + 500 and span[1] == len(text)
    assert abs(len(line_dedup.cut_out(text, [span])) - len(part)) <= 500


def test_phrases(spaced):
    for text in (spaced[0], "ab" * (SIZE // 2), spaced[0].replace(" ", "").replace("\n", "")):
        raw = text.encode()
        n = end = 0
        for _, _, lo, hi, _, times, last in suffix_dedup.runs(raw, 200, 64):
            assert lo[0] == end and (lo[1:] == last[:-1] + 1).all() and (last - lo + 1 <= times * 137).all() and (hi <= last).all()
            n, end = n + len(lo), int(last[-1]) + 1
        assert end == len(raw) - 199 and n <= len(raw) / 30


def test_posteriors_and_fingerprints(spaced):
    text, part = spaced
    model = mixing.Classifier()
    model.weights[1] = np.random.default_rng(0).random(1 << model.bits)
    many, one = model.evidence(text)[1], model.evidence(part)[1]
    assert abs(many - one) < 1e-3 * one
    assert len(similar.shingles(text)) <= 100_010 and simhash.fingerprint(text) >= 0
    assert simhash.fingerprint("x" * SIZE) == simhash.fingerprint("X" * SIZE)
    assert len(similar.shingles("x" * SIZE)) == 1 and not list(line_dedup.text_units("x" * SIZE, "passage", 0))


def test_pretokens_without_a_break():
    import public_tokenizers as p

    trie = token_counts.PrefixTrie(token_counts.load_vocabulary(p.path("byte_bpe_50k.tiktoken")))
    n, score = trie.count("the" * 700_000)
    assert 1 <= n <= 2_100_000 and score < 0 and len(trie.score) == 1


def test_strings(spaced):
    strings, owner = ctw.coded([spaced[0][:5_000_000].encode().split()], 5)
    assert len(strings) == len(owner) and not owner.any()
