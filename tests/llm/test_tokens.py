"""Token counts, byte-level BPE, packing."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers

from quillspark.llm import bpe, counting, packing, queries, tokens

ODD_TEXT = st.lists(st.sampled_from([*" \n\tab'stedré語🎉\u2003\x1c\x85_!1٠ﬁ▁", "the", " the", "aaaa", "  "]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def unigram():
    t = Tokenizer(models.Unigram(counting.vocabulary(tokens.PIECES), unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(counting.MARK), normalizers.Replace(" ", counting.MARK)])
    return t


@settings(max_examples=300, deadline=None)
@given(ODD_TEXT)
def test_counts_are_the_librarys(unigram, text):
    assert counting.load(tokens.PIECES).count(text) == (len(unigram.encode(text).ids) if text else 0)


def test_ties_and_unknown_pieces():
    vocab = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -3.0)]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    c = counting.Counter(vocab)
    for text in ("ab", "abab", "aXXb", "XYZ", "cabX", "Xab"):
        assert c.viterbi(text) == len(t.encode(text).ids), text


def test_counts_of_documents(spark, table, odd, none, unigram, rows_of):
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op1_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: len(unigram.encode(t or "").ids) for i, t in rows_of(table("documents"))}
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in counting.token_counts(odd).collect())
    assert rows == sorted((i is None, i or 0, len(unigram.encode(t).ids) if t else 0) for i, t in rows_of(odd))
    assert counting.token_counts(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD_TEXT, max_size=6))
def test_pieces_are_the_librarys(texts):
    lib, r = tokens.rank_encoding(tokens.BPE_RANKS), bpe.load(tokens.BPE_RANKS)
    pieces = sorted({p for t in texts for p in bpe.pieces_of(t)})
    ids = dict(zip(pieces, bpe.learn(pieces, r)))
    for t in texts:
        got = [i for p in bpe.pieces_of(t) for i in ids[p]]
        assert got == lib.encode_ordinary(t) and bpe.decode_ids(np.array(got, np.int64), r) == t.encode()


def test_replay_agrees_with_the_plain_rule():
    r, rng = bpe.load(tokens.BPE_RANKS), random.Random(3)
    words = [bytes(rng.choice(b"aeinst rl") for _ in range(rng.randint(1, 25))) for _ in range(3000)] + [bytes([b]) * 9 for b in range(256)]
    assert bpe.replay(words, r) == [r.plain(w) for w in words]


def test_words_with_a_falling_rank_are_redone(monkeypatch):
    """A made-up rank file in which a merge creates a pair of lower rank than its own."""
    r = bpe.load(tokens.BPE_RANKS)
    fake = object.__new__(bpe.Ranks)
    fake.ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 260, b"cb": 299}
    fake.of_byte = np.arange(256)
    pairs = {}
    for t, rank in fake.ranks.items():
        for k in range(1, len(t)):
            if t[:k] in fake.ranks and t[k:] in fake.ranks:
                pairs[fake.ranks[t[:k]] << 32 | fake.ranks[t[k:]]] = rank
    fake.keys = np.array(sorted(pairs), np.int64)
    fake.merged = np.array([pairs[k] for k in fake.keys.tolist()], np.int64)
    words = [b"abcabc", b"abcb", b"aabcbcbc", b"xbc", b"cbcbabc"]
    assert bpe.replay(words, fake) == [fake.plain(w) for w in words] and r is not fake


def test_letters_and_spaces_are_the_patterns():
    match = bpe.load(tokens.BPE_RANKS).pattern.findall
    for c in map(chr, range(0x250)):
        if c.isalpha():
            assert match(f" a{c}b") == [f" a{c}b"] and match(f" {c}") == [f" {c}"]
        assert c.isspace() or len(match(f"a{c} b")) > 1 and match(f"x{c} b")[-1] == " b"
        assert bpe._plain(f"a{c} b") == (not bpe._PLAIN.search(f"a{c} b"))


def test_every_piece_of_the_corpus_is_replayed_once(spark, monkeypatch):
    """Small chunks and many buckets: the same pieces are asked for by many chunks."""
    lib = tokens.rank_encoding(tokens.BPE_RANKS)
    rows = [(i % 7 if i % 5 else None, f"some words{i % 3} said\nagain, number {i}!  end " * (i % 4)) for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]})
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 300)
    monkeypatch.setattr(bpe, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    made = [r for b in bpe._chunked(5)(iter([batch.slice(k, 4) for k in range(0, 60, 4)])) for r in b.to_pylist()]
    asked = sorted((r["bucket"], r["chunk"], bpe.unpack_pieces(r["body"], r["size"]), r["body"], r["size"]) for r in made if r["kind"] == 1)
    ask = pa.RecordBatch.from_arrays([pa.array([a[k] for a in asked]) for k in (0, 1, 3, 4)], ["bucket", "chunk", "body", "size"])
    learnt = []
    learn = bpe.learn
    monkeypatch.setattr(bpe, "learn", lambda pieces, r: learnt.extend(pieces) or learn(pieces, r))
    answers = [r for b in bpe._answers(tokens.BPE_RANKS)(iter([ask.slice(0, 7), ask.slice(7)])) for r in b.to_pylist()]
    assert len({r["chunk"] for r in made}) > 5 and len(learnt) == len(set(learnt)) == len({p for a in asked for p in a[2]})
    assert {(r["bucket"], r["chunk"]) for r in answers} == {a[:2] for a in asked}
    monkeypatch.undo()
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 300)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in bpe.encode(df).collect()))
    assert got == sorted((i is None, i or 0, lib.encode_ordinary(t)) for i, t in rows)


def test_bpe_of_documents(spark, table, odd, none, rows_of):
    lib = tokens.rank_encoding(tokens.BPE_RANKS)

    def want(i, t):
        ids = lib.encode_ordinary(t or "")
        return (i is None, i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())

    have = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect())
    assert have(queries.op7_bpe(spark, "/root/testdata/sf0.001")) == sorted(want(*r) for r in rows_of(table("documents")))
    assert have(bpe.round_trip(odd)) == sorted(want(*r) for r in rows_of(odd))
    assert bpe.round_trip(none).count() == 0
    back = {(r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(bpe.encode(odd)).collect()}
    assert back == {(i, (t or "").encode()) for i, t in rows_of(odd)}


def test_both_libraries_agree_below_the_bound():
    hf = tokens.json_tokenizer(tokens.BPE_JSON)
    lib = tokens.rank_encoding(tokens.BPE_RANKS)
    for c in range(0x250):
        for t in (chr(c), f"a{chr(c)}b", f" {chr(c)} {chr(c)}{chr(c)} 1", f"x{chr(c)}'s"):
            assert hf.encode(t, add_special_tokens=False).ids == lib.encode_ordinary(t), hex(c)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    free, want = [], []
    for i, s in enumerate(sizes):
        k = next((k for k, f in enumerate(free) if f >= s), len(free))
        if k == len(free):
            free.append(64)
            want.append([])
        free[k] -= s
        want[k].append(i)
    assert packing.first_fit_decreasing(sizes, 64) == want
    filled = packing.fill([[(i, 0, sizes[i]) for i in b] for b in want], 64)
    totals = [sum(x[2] for x in b) for b in filled]
    assert sum(totals) == sum(sizes) and sum(t < 64 for t in totals) <= 1 and all(t <= 64 for t in totals)
    spans = sorted((i, s, n) for b in filled for i, s, n in b)
    assert [(i, sum(n for j, _, n in spans if j == i)) for i in range(len(sizes))] == list(enumerate(sizes))


def check_packing(rows, ids_of):
    """Every id of every document in one piece, gapless sequences, little padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for got in sequences.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    wanted = defaultdict(list)
    for name, ids in ids_of:
        wanted[name, len(ids)].append(ids)
    assert pieces.keys() == wanted.keys()
    for key, copies in wanted.items():
        assert sum(n for _, n, _ in pieces[key]) == key[1] * len(copies)
        crcs = {zlib.crc32(ids[s : s + n].tobytes()) for ids in copies for s, n, _ in pieces[key]}
        assert {c for _, _, c in pieces[key]} <= crcs
        if len(copies) == 1:
            at = 0
            for s, n, crc in sorted(pieces[key]):
                assert s == at and crc == zlib.crc32(copies[0][s : s + n].tobytes())
                at += n
            assert at == key[1]
    return sequences


def ids_by_library(rows):
    hf = tokens.json_tokenizer(tokens.BPE_JSON)
    return [(i, np.array([*hf.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t in rows]


def test_packing_of_documents(spark, table, odd, none, rows_of):
    rows = queries.op4_packing(spark, "/root/testdata/sf0.001").collect()
    sequences = check_packing(rows, ids_by_library(rows_of(table("documents"))))
    total = sum(n for s in sequences.values() for _, n in s)
    assert len(sequences) == -(-total // 1024)
    check_packing(packing.pack(odd, group_docs=4).collect(), ids_by_library(rows_of(odd)))
    assert packing.pack(none).count() == 0
    with_ids = packing.pack(odd, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in with_ids)


def test_equal_rows_of_many_tasks_are_dealt_apart(spark):
    """The n-th copies of all tasks don't meet in one group either."""
    groups = Counter(packing.deal(packing.hash_row(1, np.arange(3, dtype="<u4"), 17), twin, task, 50) for task in range(200) for twin in range(5))
    assert len(groups) == 50 and max(groups.values()) < 60
    rows = spark.createDataFrame([(1, "same text")] * 400 + [(None, None)] * 40, "doc_id long, text string").repartition(40)
    got = packing.pack(rows, group_docs=40).collect()
    sizes = Counter(r["sequence_id"] >> 24 for r in got)
    assert len(sizes) > 8 and max(sizes.values()) < 120 and sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}[i] * n for i, n in ((1, 400), (None, 40)))


def test_equal_rows_are_dealt_apart(spark):
    rows = spark.createDataFrame([(1, "same text")] * 200, "doc_id long, text string")
    got = packing.pack(rows, group_docs=20).collect()
    assert len({r["sequence_id"] >> 24 for r in got}) > 3 and sum(r["length"] for r in got) == 200 * got[0]["doc_tokens"]
