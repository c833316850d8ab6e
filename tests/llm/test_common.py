import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import common
from quillspark.llm.graph import components


def hashes_of(texts, lower):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    out = []
    for _, data, offsets in common.slices([batch], "text", 40):
        h, d = common.word_hashes(data, offsets, lower)
        out += [h[d == i].tolist() for i in range(len(offsets) - 1)]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab AB\n\t\x0b\x1cé語 ", max_size=30)), max_size=8))
def test_words_are_told_apart(texts):
    got = hashes_of(texts, True)
    seen = {}
    for t, hs in zip(texts, got):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words]
        assert len(words) == len(hs)
        for w, h in zip(words, hs):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words_are_not_cut(monkeypatch):
    text = "x" * 5000 + " " + "y" * 3000 + " z"
    whole = hashes_of([text], False)
    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    assert hashes_of([text], False) == whole and len(whole[0]) == 3


def test_windows_stay_in_a_document():
    h = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    keys, start = common.windows(h, np.array([0, 0, 0, 1, 1, 1]), 3)
    assert start.tolist() == [0, 3] and keys[0] == keys[1]
    assert len(common.windows(h[:2], np.zeros(2, int), 3)[0]) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 200), (7, 3), (300, 299), (None, 5)] + [(500, 500 + i) for i in range(1, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and [got[i] for i in (100, 101, 102, 299, 300)] == [100, 100, 100, 299, 299]
    assert all(got[500 + i] == 500 for i in range(60)) and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
