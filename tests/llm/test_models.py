import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weftplan.llm import ctw, embedding_dedup, mixing, quality_rules

WS = "\x20\t\n\v\f\r"


def split(text):
    out, word = [], ""
    for ch in text or "":
        if ch in WS:
            out, word = out + [word] * bool(word), ""
        else:
            word += ch
    return out + [word] * bool(word)


def features(text):
    w, lines = split(text), (text or "").split("\n")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for ln in lines:
        if split(ln):
            dup += ln in seen
            seen.add(ln)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


TEXTS = [None, "", "   ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a b c d a b c d e", "é|é <x> #\n\nq\n q\nq\nq", "l m n\x1co\n" * 4, " ".join(random.Random(0).choice("abc") for _ in range(300)), "one\rtwo\vthree\ffour"]


@pytest.mark.parametrize("place", [quality_rules.PLACE, 3])
def test_features(spark, place, monkeypatch):
    """With either kind of sort key."""
    monkeypatch.setattr(quality_rules, "PLACE", place)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.features(df).collect()}
    assert got == {i: features(t) for i, t in enumerate(TEXTS)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*words):
    """Of a word, or of the hashes of several."""
    if len(words) == 1:
        return signed(xxh64_intdigest(words[0].encode(), 42))
    h = 42
    for w in words:
        h = xxh64_intdigest(xxh64_intdigest(w.encode(), 42).to_bytes(8, "little"), h)
    return signed(h)


def test_model_and_verdict_by_hand(spark):
    r = random.Random(1)
    good = [" ".join(r.choice("alpha beta gamma delta".split()) + str(r.randrange(30)) for _ in range(80)) for _ in range(30)]
    bad = [" ".join(r.choice("alpha&& beta%% gamma##".split()) + str(r.randrange(30)) for _ in range(80)) for _ in range(8)]
    texts = good + bad + [None, "", "short one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(30 + i, 0, 0) for i in range(4)] + [(None, 1, 0), (999, 0, None), (25, None, None)], "doc_id long, quality int, toxic int")
    buckets = 512
    model = quality_rules.fit(docs, labels, buckets=buckets)
    grams = lambda t: [spark_hash(x) % buckets for x in split(t)] + [spark_hash(a, b) % buckets for a, b in zip(split(t), split(t)[1:])]
    raw, tgt = Counter(), Counter()
    for i, t in enumerate(texts):
        g = grams(t)
        raw.update(g)
        tgt.update(g if i < 20 and signed(xxh64_intdigest(i.to_bytes(8, "little"), 42)) % 2 == 0 else [])
    share = lambda b: (raw[b] + 1) / (raw.total() + buckets)
    weight = lambda b: round(math.log((tgt[b] + buckets * share(b)) / (tgt.total() + buckets) / share(b)) * 1e6) if raw[b] else round(math.log(buckets / (tgt.total() + buckets)) * 1e6)
    assert all(abs(model.weights[b] - weight(b)) <= 1 for b in range(buckets))
    got = {r.doc_id: r for r in quality_rules.judge(docs, model).collect()}
    for i, t in enumerate(texts):
        n, *_, repeat = features(t)
        failed = n < 50 or 100 * repeat > 50 * n
        total = sum(model.weights[b] for b in grams(t))
        assert got[i].base_failed == failed and got[i].kept == (not failed and total >= model.threshold * max(0, 2 * n - 1))
    assert sum(got[i].kept for i in range(30)) >= 25 and not any(got[i].kept for i in range(30, 41))


def test_quality_hard_rows(spark, hard_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_rules.fit(hard_docs, labels)
    out = quality_rules.judge(hard_docs, model)
    assert out.count() == hard_docs.count() and {r.doc_id for r in out.where("kept").collect()} == {4, 5, 10, 11}
    assert quality_rules.judge(hard_docs.limit(0), quality_rules.fit(hard_docs.limit(0), labels)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_names_of_its_own(spark, hard_docs):
    """Columns with names that the operator uses inside come through; those that it adds are replaced."""
    inner = ("_w", "_total", "_row", "bucket", "part", "raw", "x")
    clash = hard_docs.select("*", *(F.lit(f"my {c}").alias(c) for c in inner), F.lit("old").alias("kept"))
    model = quality_rules.Model((1,) * 16, 0)
    out = quality_rules.judge(clash, model)
    assert set(out.columns) == set(clash.columns) | set(quality_rules.JUDGED) and len(out.columns) == len(set(out.columns))
    assert {tuple(r[c] for c in inner) for r in out.collect()} == {tuple(f"my {c}" for c in inner)} and {r.kept for r in out.collect()} <= {True, False}
    assert quality_rules.judge(hard_docs.select("text"), model).count() == hard_docs.count()


def embeddings(seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(20, 8))
    rows = []
    for i in range(160):
        v = base[r.integers(20)] + r.normal(size=8) * r.choice([0, 0.02, 0.1, 0.2])
        rows.append((i, v.astype(np.float32).tolist(), int(r.integers(3))))
    rows += [(200, [0.0] * 8, 1), (201, None, 1), (202, [None] + [1.0] * 7, 1), (203, [float("nan")] * 8, 1), (204, [float("inf")] + [0.0] * 7, 1), (205, rows[0][1], None), (206, [], 1), (207, [1.0, 2.0], 1), (208, [2.0, 4.0], 1)]
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(30)]
    return rows


@pytest.mark.parametrize("tile", [7, 2048])
def test_embeddings_against_brute_force(spark, tile):
    rows = embeddings(tile)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<float>, label int, n_links string").repartition(5), tile=tile).collect()}
    ok = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = defaultdict(set)
    for i, a, y in ok:
        for j, b, z in ok:
            if i != j and y == z and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                links[i].add(j)
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), i == min(seen)), i


def test_embeddings_bounds_save_work_and_lose_nothing():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 64)) + 3 * np.eye(64)[r.integers(64, size=400)]
    x[200:] = x[:200] + r.normal(size=(200, 64)) * r.choice([0.05, 0.1, 0.15], size=(200, 1))
    stats = {}
    got = {(int(a), int(b)) for i, j in embedding_dedup.linked_pairs(x, x, 0.98, stats) for a, b in zip(i, j)}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == set(zip(*map(list, np.nonzero(u @ u.T >= 0.98)))) and stats["recomputed"] < 0.05 * stats["pairs"]


def test_embeddings_of_extreme_size(spark):
    """Lengths whose squares leave the range of doubles."""
    rows = [(1, [3e200, 4e200], 0), (2, [3.0, 4.0], 0), (3, [3e-200, 4e-200], 0), (4, [3e-320, 4e-320], 0), (5, [4.0, -3.0], 0), (6, [1.7e308, 1.7e308], 1), (7, [5e-324, 5e-324], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (1, 6), 7: (1, 6)}


def test_embeddings_repeated_ids_and_empty(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, -1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True), (2, 1, 1, False), (3, 0, 3, True)], key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def corpus(n=160):
    r = random.Random(4)
    syl = "ba ko ri tu ne mo shi la".split()
    words = ["".join(r.choices(syl, k=r.randrange(1, 4))) for _ in range(120)]
    return [(i, " ".join(r.choices(words, k=r.randrange(1, 60))) if i % 20 else (None if i % 40 else "")) for i in range(n)]


def test_ctw_base_and_held_out(spark):
    docs = corpus()
    got = {r.doc_id: r for r in ctw.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), depth=3, slots=1 << 14, frequent=40).collect()}
    train = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*(t or "").encode().lower().split(), b"\n"])
    n, v = train.total(), len(train)
    for i, t in docs:
        tokens = [*(t or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and r.score < 0 and r.n_bytes == len(b" ".join(tokens[:-1])) + 1
    held = [r for r in got.values() if r.held_out]
    bits = -sum(r.score for r in held) * math.log2(10) / sum(r.n_bytes for r in held)
    assert bits < 1.5  # nine letters, evenly: 3.2


def test_ctw_weights_against_the_recursion(spark):
    """Mixing weights and probabilities against CTW's own recursion on a small tree."""
    depth, docs = 2, [(0, "abab abba"), (3, "baab")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("r", F.monotonically_increasing_id())
    levels = ctw.tree(ctw.string_counts(rows, depth), depth)
    counts = defaultdict(lambda: [0, 0])
    data = []
    for i, t in docs:
        if ctw.in_training(i):
            data.append(b"\n" * depth + b" ".join(t.encode().split()) + b"\n")
    for s in data:
        for i in range(depth, len(s)):
            for k in range(8):
                z, bit = 1 << k | s[i] >> 8 - k, s[i] >> 7 - k & 1
                for d in range(depth + 1):
                    counts[s[i - d : i], d, z][bit] += 1
    lg = math.lgamma

    def pe(c):
        a, b = c
        return lg(a + 0.5) + lg(b + 0.5) - math.log(math.pi) - lg(a + b + 1)

    def pw(ctx, d, z):
        own = pe(counts[ctx, d, z])
        if d == depth:
            return own
        kids = sum(pw(c, e, y) for (c, e, y) in list(counts) if e == d + 1 and y == z and c[1:] == ctx)
        hi = max(own, kids)
        return hi + math.log(0.5 * math.exp(own - hi) + 0.5 * math.exp(kids - hi))

    for d, level in enumerate(levels):
        got = {r.key: r for r in level.collect()}
        mine = {(ctx, z): c for (ctx, e, z), c in counts.items() if e == d}
        assert len(got) == len(mine)
        for (ctx, z), (a, b) in mine.items():
            r = got[int.from_bytes(ctx, "big") << 8 | z]
            assert (r.a, r.b) == (a, b) and abs(r.w - pw(ctx, d, z)) < 1e-7
            if d < depth:
                assert abs(r.stop - 0.5 * math.exp(pe((a, b)) - pw(ctx, d, z))) < 1e-7


@pytest.mark.parametrize("slots", [8, 1 << 14])
def test_ctw_scores_use_every_counted_node(spark, slots):
    """However few strings are held in memory, scores are those of the whole tree."""
    depth, docs = 3, corpus(60)
    lines = {i: b"\n" * depth + b" ".join((t or "").encode().lower().split()) + b"\n" for i, t in docs}
    counts = defaultdict(lambda: [0, 0])
    for i, s in lines.items():
        for at in range(depth, len(s) if ctw.in_training(i) else 0):
            for k in range(8):
                for d in range(depth + 1):
                    counts[s[at - d : at], 1 << k | s[at] >> 8 - k][s[at] >> 7 - k & 1] += 1
    kids = defaultdict(list)
    for c, z in counts:
        if c:
            kids[c[1:], z].append((c, z))
    pe = {x: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for x, (a, b) in counts.items()}
    pw = {}
    for x in sorted(counts, key=lambda x: -len(x[0])):
        own, below = pe[x], sum(pw[y] for y in kids[x])
        pw[x] = own if len(x[0]) == depth else max(own, below) + math.log(0.5 * math.exp(own - max(own, below)) + 0.5 * math.exp(below - max(own, below)))

    def one(context, z):
        total, left, last = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            x = (context[depth - d :], z)
            if x not in counts:
                return total + left * last
            last = (counts[x][1] + 0.5) / (sum(counts[x]) + 1)
            stop = 1.0 if d == depth else 0.5 * math.exp(pe[x] - pw[x])
            total, left = total + left * stop * last, left * (1 - stop)
        return total

    got = {r.doc_id: r.score for r in ctw.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), depth=depth, slots=slots).collect()}
    for i, s in lines.items():
        want = 0.0
        for at in range(depth, len(s)):
            for k in range(8):
                p = one(s[at - depth : at], 1 << k | s[at] >> 8 - k)
                want += math.log10(p if s[at] >> 7 - k & 1 else 1 - p)
        assert abs(got[i] - want) < 1e-6 * max(1, -want), i


def test_ctw_probabilities_sum_to_one(spark):
    """Over all bytes that may follow a context, known or not; none is zero."""
    depth = 3
    rows = spark.createDataFrame(corpus(60), "doc_id long, text string").withColumn("r", F.monotonically_increasing_id())
    contexts = (0x0A0A0A, int.from_bytes(b"bak", "big"), 0)
    more = spark.createDataFrame([(c << 8 | x, 0, 1) for c in contexts for x in range(256)], "g long, n long, m long")
    strings = ctw.string_counts(rows, depth, every=True).union(more).groupBy("g").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    got = {r.g: r.v for r in ctw.string_values(strings, ctw.tree(strings, depth)).collect()}
    assert None not in got.values() and max(got.values()) < 0
    for c in contexts:
        assert abs(sum(10 ** got[c << 8 | x] for x in range(256)) - 1) < 1e-12


def test_held_strings_are_found_and_no_others():
    r = np.random.default_rng(3)
    for n in (0, 1, 5, 5000):
        x = np.unique(r.integers(0, 1 << 48, 2 * n + 3, dtype=np.uint64))
        r.shuffle(x)
        held = ctw.Held(x[:n], np.arange(n, dtype=float))
        got = held.log10(x)
        assert (got[:n] == np.arange(n)).all() and np.isnan(got[n:]).all()


def test_ctw_ends_are_held_whatever_the_words(spark):
    """All words, and the end, are equally frequent: none is held in memory but the end."""
    text = " ".join(f"w{i}" for i in range(60))
    r = ctw.score(spark.createDataFrame([(0, text)], "doc_id long, text string"), depth=2, frequent=10).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (61, 61, 61) and abs(r.base_score - 61 * math.log10(2 / (61 + 61 + 1))) < 1e-9


def test_coded_strings():
    texts = [[b"ab", b"c"], [], [b"q"]]
    for depth in (0, 1, 3, 6):
        strings, owner = ctw.coded(texts, depth)
        want = []
        for i, w in enumerate(texts):
            line = b"\n" * depth + b" ".join(w) + b"\n"
            want += [(int.from_bytes(line[k - depth : k + 1], "big"), i) for k in range(depth, len(line))]
        assert list(zip(strings.tolist(), owner.tolist())) == want


def test_ctw_hard_rows(spark, hard_docs):
    got = ctw.score(hard_docs, depth=3, slots=1 << 12)
    assert got.count() == hard_docs.count() and got.where("doc_id in (2, 3, 7) and n_tokens <> 1").count() == 0
    assert ctw.score(hard_docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(next(i for i in range(50) if not ctw.in_training(i)), "abc")], "doc_id long, text string")
    r = ctw.score(alone).first()
    assert (r.held_out, r.train_tokens, r.n_known) == (True, 0, 0) and abs(r.score - 4 * 8 * math.log10(0.5)) < 1e-9


def test_mixing_meets_targets(spark):
    r = random.Random(2)
    kinds = ["river stone cloud tree", "BUY!! NOW!! $$$ ###", "idiot moron scum trash"]
    docs = [(i, " ".join(r.choices(kinds[i % 3].split(), k=r.randrange(20, 60)))) for i in range(240)] + [(240, None), (241, "")]
    labels = [(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(0, 240, 2)]
    out = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string").withColumn("rate", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), targets=(1.5, 0.5, 0.0)).collect()
    for d, (name, goal) in enumerate(zip(mixing.DOMAINS, (1.5, 0.5, 0.0))):
        own = [x[f"p_{name}"] * x.tokens for x in out]
        assert abs(sum(p * x.rate for p, x in zip(own, out)) - goal * sum(own)) < 1e-3 * sum(x.tokens for x in out)
        mine = [x for x in out if x.doc_id < 240 and x.doc_id % 3 == d]
        assert sum(x[f"p_{name}"] > 0.5 for x in mine) > 0.9 * len(mine)
        assert abs(sum(x.copies for x in mine) / len(mine) - goal) < 0.2
    assert all(x.rate >= 0 and x.copies in (math.floor(x.rate), math.floor(x.rate) + 1) for x in out)


def test_mixing_learns_from_whole_texts(spark):
    """Strings that tell a domain stand after the first 4,000 characters only."""
    r = random.Random(5)
    kinds = ["river stone cloud tree", "BUY!! NOW!! $$$ ###", "idiot moron scum trash"]
    head = "river stone cloud tree " * 200
    docs = [(i, head + " ".join(r.choices(kinds[i % 3].split(), k=200))) for i in range(120)]
    labels = [(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(60)]
    out = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), targets=(1.0, 1.0, 1.0)).collect()
    assert len(out) == 120
    for d, name in enumerate(mixing.DOMAINS):
        assert all((x[f"p_{name}"] > 0.5) == (x.doc_id % 3 == d) for x in out), name


def test_mixing_hard_rows(spark, hard_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = mixing.mix(hard_docs, none, targets=(1.0, 1.0, 1.0))
    assert out.count() == hard_docs.count() and all(abs(r.rate - 1) < 1e-3 and abs(r.p_low - 1 / 3) < 1e-5 for r in out.collect())
    assert mixing.mix(hard_docs.limit(0), none).count() == 0
    two = spark.createDataFrame([(1, "a", 2), (2, "b", 0)], "doc_id long, text string, copies long")
    assert sorted(r.doc_id for r in mixing.apply_copies(two, ["doc_id", "text"]).collect()) == [1, 1]


def members_of(spark, shares, times=20):
    rows = [(i, 10, [int(s * (1 << 20)) for s in p]) for i, p in enumerate(shares * times)]
    return spark.createDataFrame(rows, "doc_id long, tokens long, p array<long>")


def test_projection_keeps_rates_nonnegative(spark):
    members = members_of(spark, [(0.9, 0.1, 0.0), (0.5, 0.5, 0.0), (0.1, 0.9, 0.0)])
    found = mixing.fit_rates(members, (1.6, 0.3, 1.0), tolerance=1e-6)
    rates = [r.x for r in members.select(mixing.rate(F.col("p"), found.steps).alias("x")).collect()]
    assert min(rates) == 0.0 and 1 < max(rates)
    share = np.array([(0.9, 0.1), (0.5, 0.5), (0.1, 0.9)] * 20)
    best = min(np.square((share * np.array([x, y, z] * 20)[:, None]).sum(0) * 10 - found.goals[:2]).sum() for x in np.linspace(0, 4, 41) for y in np.linspace(0, 2, 21) for z in (0, 0.05, 0.1))
    assert np.square(np.array(found.totals[:2]) - found.goals[:2]).sum() <= best * 1.05 + 1


@pytest.mark.parametrize(("kind", "targets", "goals"), [("shares", (6.0, 0.5, 1.0), (1560, 170, 0)), ("totals", (300, 200, 0), (300, 200, 0)), ("weights", (3, 1, 0), (450, 150, 0))])
def test_targets_of_each_kind_are_met(spark, kind, targets, goals):
    members = members_of(spark, [(0.8, 0.2, 0.0), (0.5, 0.5, 0.0), (0.0, 1.0, 0.0)])
    found = mixing.fit_rates(members, targets, kind, tolerance=1e-6)
    rows = members.select("tokens", "p", mixing.rate(F.col("p"), found.steps).alias("x")).collect()
    by_hand = [sum(r.tokens * r.x * r.p[d] / (1 << 20) for r in rows) for d in range(3)]
    assert min(r.x for r in rows) >= 0 and np.allclose(found.totals, by_hand)
    if kind == "shares":  # 6 x 260 clean tokens bring 390 low ones at least
        assert not found.met and found.totals[1] > 300
    else:
        assert found.met and np.allclose(found.goals, goals, atol=1e-2) and np.allclose(by_hand, goals, atol=1e-2)


def test_targets_that_make_no_sense(spark):
    members = members_of(spark, [(1.0, 0.0, 0.0)])
    for kind, targets in (("shares", (1.0, 1.0)), ("weights", (0, 0, 0)), ("totals", (-1, 0, 0)), ("parts", (1, 1, 1))):
        with pytest.raises(ValueError):
            mixing.fit_rates(members, targets, kind)
    with pytest.raises(RuntimeError):
        mixing.fit_rates(members_of(spark, [(0.9, 0.1, 0.0), (0.5, 0.5, 0.0), (0.1, 0.9, 0.0)]), (1.6, 0.3, 1.0), rounds=1)


def test_posteriors_against_brute_force(monkeypatch):
    """Counts, weights, centres and posteriors by dictionaries, over strings as they are instead of their buckets."""
    r = random.Random(9)
    texts = [" ".join(r.choices(["river stone", "BUY now!!", "scum trash é"][d], k=r.randrange(5, 30))) for d in (0, 1, 2) for _ in range(8)] + [None, ""]
    labels = np.array([0] * 8 + [1] * 8 + [2] * 8 + [0, 1])
    model = mixing.Classifier(bits=22)

    def strings(text):
        raw = b" " + (text or "").encode().lower() + b"    "
        return [raw[i : i + 5] for i in range(len(raw) - 4)]

    buckets = {}
    for t in texts:
        for s, b in zip(strings(t), np.concatenate(list(model.buckets(t))).tolist(), strict=True):
            assert buckets.setdefault(s, b) == b
    assert len(set(buckets.values())) == len(buckets)  # no two strings share one here
    counts = np.zeros((3, 1 << 22))
    for t, d in zip(texts, labels):
        for at in model.buckets(t):
            counts[d] += np.bincount(at, minlength=1 << 22)
    model.weigh(counts)
    said = [Counter(s for t, d in zip(texts, labels) if d == e for s in strings(t)) for e in range(3)]
    size = 1 << 22

    def weight(e, s):
        own = (said[e][s] + 0.5) / (sum(said[e].values()) + 0.5 * size)
        rest = (sum(c[s] for c in said) - said[e][s] + 1.0) / (sum(sum(c.values()) for c in said) - sum(said[e].values()) + size)
        return max(0.0, math.log(own) - math.log(rest) - model.floor)

    hand = np.array([[0.0, *(sum(weight(e, s) for s in strings(t)) / len(strings(t)) for e in (1, 2))] for t in texts])
    got = np.stack([model.evidence(t) for t in texts])
    assert np.allclose(got, hand)
    model.place(got, labels)
    logit = np.zeros_like(hand)
    for e in (1, 2):
        own, rest = np.median(hand[labels == e, e]), np.median(hand[labels != e, e])
        logit[:, e] = model.sharpness * (hand[:, e] - (own + rest) / 2) / ((own - rest) / 2)
    want = np.exp(np.clip(logit, -30, 30))
    whole = model.posterior(texts)
    assert np.allclose(whole, want / want.sum(axis=1, keepdims=True))
    monkeypatch.setattr(mixing, "BLOCK", 7)
    assert np.allclose(model.posterior(texts), whole)  # blocks do not matter, nor do neighbours
    assert np.array_equal(model.posterior(texts[3:4])[0], model.posterior(texts)[3])


def test_mixing_ties_and_names(spark):
    """Repeated ids in either table, and columns with names of the operator's own."""
    docs = spark.createDataFrame([(i % 20, f"{['river stone', 'BUY now', 'scum trash'][i % 3]} {i % 4}" * 20) for i in range(60)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(20)] + [(0, 0, 0), (0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    own = ("_p", "_tokens", "_text", "row", "p", "d", "n", "_k", "_n", "k")
    clash = docs.select("*", *(F.lit(f"my {c}").alias(c) for c in own))
    plain = sorted((str(r.doc_id), r.text, r.rate, r.copies) for r in mixing.mix(docs, labels, (1.0, 0.5, 0.5)).collect())
    out = mixing.mix(clash.repartition(5), labels.repartition(3), (1.0, 0.5, 0.5)).collect()
    assert sorted((str(r.doc_id), r.text, r.rate, r.copies) for r in out) == plain
    assert all(r[c] == f"my {c}" for r in out for c in own)
    many = mixing.apply_copies(clash.withColumn("copies", F.lit(2).cast("long")), clash.columns)
    assert many.columns == clash.columns and many.count() == 2 * clash.count()
