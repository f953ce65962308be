import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import rows

from weftplan.llm import packing, token_counts, token_files
from weftplan.llm.common import CachingEncoder, default_tokenizer

ODD = ["", "a", " a", "a ", "a  b", "a\n\nb", "a\n b", "a\tb c", "\na", "a\n", "x <|endoftext|> y<|endoftext|>", "a b c", "tab \t x", "don't we'll\nI'm", "é 　x", "a\x1cb c", "  a b", "a\r\nb", "1234 12,5 $%& ...", "word " * 3000 + "end"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_cache_equals_the_library(plain):
    enc = CachingEncoder(default_tokenizer())
    enc.LIMIT = 50
    enc.trim = lambda keep=20, f=enc.trim: f(keep)
    r = random.Random(0)
    texts = [*ODD, None, *("".join(r.choice("ab é\n\t 'X,.9") for _ in range(r.randrange(60))) for _ in range(600))]
    for part in (texts, texts[::-1]):
        for a in range(0, len(part), 40):
            assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(part[a : a + 40])] == [plain(t) for t in part[a : a + 40]]


def test_token_files(spark, hard_docs, tmp_path, plain):
    manifest = token_files.write_token_files(hard_docs, path=f"file://{tmp_path}/t")
    got = token_files.read_token_files(manifest).collect()
    assert sum(r.n_docs for r in manifest.collect()) == hard_docs.count()
    want = defaultdict(list)
    for r in hard_docs.collect():
        ids = np.array([*plain(r.text), 0], dtype="<u4").tobytes()
        want[r.doc_id].append((len(ids) // 4, zlib.crc32(ids)))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.concatenate([[0], np.cumsum([r.n_tokens for r in order])[:-1]]).tolist()
    assert [r.doc_id for r in order if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
    assert token_files.read_token_files(token_files.write_token_files(hard_docs.limit(0))).count() == 0


def test_shards_random_access_and_damage(tmp_path):
    sink = pa.BufferOutputStream()
    w = token_files.ShardWriter(sink)
    docs = [(i, np.arange(i * 700, dtype="<u4").tobytes()) for i in range(400)]
    for d in docs:
        w.add(*d)
    w.close()
    raw = sink.getvalue().to_pybytes()
    r = token_files.ShardReader(pa.BufferReader(raw))
    read = []
    frame = r.frame
    r.frame = lambda k: read.append(k) or frame(k)
    assert list(r.documents([399, 7, 8])) == [docs[7], docs[8], docs[399]] and len(read) <= 3
    assert list(r.documents()) == docs
    import zstandard

    assert zstandard.ZstdDecompressor().decompressobj().decompress(raw).startswith(docs[1][1][:8])
    bad = bytearray(raw)
    bad[len(raw) // 2] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        list(token_files.ShardReader(pa.BufferReader(bytes(bad))).documents())
    with pytest.raises(ValueError):
        token_files.ShardReader(pa.BufferReader(b"x" * 50))


def check_packing(got, texts, plain, tokens):
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for doc_id, text in texts.items():
        ids = np.array([*plain(text), 2], dtype="<u4")
        mine = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        at = 0
        for k, r in enumerate(mine):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and (k == 0 or r.length == tokens)
            at += r.length
        assert len(mine) == -(-len(ids) // tokens)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= tokens
    return len(seqs)


def best_fit(lengths, tokens):
    """Sequences that best fit, longest first, needs one piece at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(tokens - n)
    return len(room)


def test_pack(spark, plain):

    r = random.Random(3)
    texts = {i: " ".join(f"w{r.randrange(99)}" for _ in range(r.choice([0, 1, 5, 40, 40, 200, 700]))) for i in range(300)} | {300: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = packing.pack(df, tokens=128).collect()
    n = check_packing(got, texts, plain, 128)
    assert n <= best_fit([x.length for x in got], 128)
    assert packing.pack(df.limit(0)).count() == 0


def test_pack_repeated_rows(spark, hard_docs):
    got = packing.pack(hard_docs).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in hard_docs.collect())


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, None, None), (100, 3, None), (100, None, 2500)])
def test_plan_holds_every_constraint(caps, rule):
    r = random.Random(5)
    hist = Counter(r.choice([1, 2, 3, 7, 20, 33, 49, 50]) for _ in range(3000))
    tokens, docs, attention = caps
    bins, seen = defaultdict(list), defaultdict(set)
    for s in packing.plan(hist, tokens, docs, attention, rule=rule):
        for i in range(s.n):
            bins[s.bin + i].append((s.offset, s.length))
            seen[s.length].add(s.first + i)
    assert {k: len(v) for k, v in seen.items()} == dict(hist)
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= tokens and len(v) <= (docs or 10**9) and sum(n * n for _, n in v) <= (attention or 10**9)
    if caps == (100, None, None):
        assert len(bins) <= 1.01 * sum(k * n for k, n in hist.items()) / 100 + 1
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


def test_token_counts(spark, hard_docs):
    import public_tokenizers as p
    import regex

    vocabulary = token_counts.load_vocabulary(p.path("byte_bpe_50k.tiktoken"))

    def viterbi(token):
        raw = token.encode()
        best = [(0.0, 0)] + [(-1e18, 0)] * len(raw)
        for i in range(1, len(raw) + 1):
            best[i] = (best[i - 1][0] + token_counts.UNKNOWN, best[i - 1][1] + 1)
            for j in range(i):
                s = vocabulary.get(raw[j:i])
                if s is not None and (best[j][0] + s > best[i][0] or best[j][0] + s == best[i][0] and best[j][1] + 1 < best[i][1]):
                    best[i] = (best[j][0] + s, best[j][1] + 1)
        return best[-1]

    got = token_counts.token_counts(hard_docs.where("length(text) < 10000 or text is null"))
    texts = {r.doc_id: r.text for r in hard_docs.collect()}
    for r in got.collect():
        if r.doc_id is not None:
            tokens = regex.findall(p.PATTERN, texts[r.doc_id] or "")
            each = [viterbi(x) for x in tokens]
            assert (r.n_pretokens, r.n_tokens) == (len(tokens), sum(n for _, n in each)) and abs(r.score - sum(s for s, _ in each)) < 1e-6 * max(1, len(tokens))
    assert token_counts.token_counts(hard_docs).count() == hard_docs.count() and token_counts.token_counts(hard_docs.limit(0)).count() == 0
    trie = token_counts.PrefixTrie(vocabulary)
    a = [trie.count(x) for x in ("hello", "help", "hello")]
    trie.clear()
    assert [trie.count(x) for x in ("hello", "help", "hello")] == a and len(rows(got)) == got.count()


def test_trie_bounds_change_no_count(monkeypatch):
    import public_tokenizers as p

    vocabulary = token_counts.load_vocabulary(p.path("byte_bpe_50k.tiktoken"))
    r = random.Random(8)
    tokens = ["".join(r.choice("the and é x1") for _ in range(r.randrange(1, 90))) for _ in range(300)]
    plain = token_counts.PrefixTrie(vocabulary)
    want = [plain.count(x) for x in tokens]
    monkeypatch.setattr(token_counts.PrefixTrie, "LONGEST", 20)
    monkeypatch.setattr(token_counts.PrefixTrie, "MAX_NODES", 300)
    small = token_counts.PrefixTrie(vocabulary)
    got = [small.count(x) for x in tokens]
    assert [n for n, _ in got] == [n for n, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])
    assert len(small.score) < 400


def test_rows_of_one_id_have_one_order(spark, tmp_path):
    """Most rows share an id: they keep their order, and do not all go to one shard."""
    docs = spark.createDataFrame([(7 if i % 10 else i, f"text number {i} " * (1 + i % 5)) for i in range(2000)] + [(None, f"none {i}") for i in range(20)], "doc_id long, text string").repartition(4)
    path = f"file://{tmp_path}/docs"
    docs.write.parquet(path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is a small one
    runs = []
    for k in range(2):
        manifest = token_files.write_token_files(spark.read.parquet(path), path=f"file://{tmp_path}/t{k}")
        runs.append(sorted((r.start, r.doc_id, r.ids_crc32) for r in token_files.read_token_files(manifest).collect()))
        assert max(r.n_docs for r in manifest.collect()) < 1500
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert runs[0] == runs[1] and len(runs[0]) == 2020
    ids = [i for _, i, _ in runs[0] if i is not None]
    assert ids == sorted(ids)


def test_file_systems_by_scheme(tmp_path):
    from weftplan.llm.common import file_system

    assert file_system(f"file://{tmp_path}/x")[1] == f"{tmp_path}/x" and file_system(str(tmp_path))[1] == str(tmp_path)
    assert file_system("s3a://some-bucket/a/b?region=us-east-1")[1] == "some-bucket/a/b"


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from weftplan.llm.common import shared_dir

    def session(master, folder=None):
        sc = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": folder} if folder else {}, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=sc)

    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(spark)
