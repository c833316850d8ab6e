"""Quality rules, toxicity, near duplicates, language-model scores."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import common, jaccard, quality, queries, scoring, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    """The measurements by the plain definitions."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {p for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again), "n_upper": len(re.findall("[A-Z]", text)), "n_ascii_letters": len(re.findall("[A-Za-z]", text)), "n_top_word": max(Counter(w).values(), default=0),
    }


def kept_by_hand(m):
    n = m["n_words"]
    bad = [
        n < 20, 100 * m["n_repeat_words"] > 30 * n, 100 * m["n_symbols"] > 10 * m["word_chars"], 100 * m["n_dup_lines"] > 50 * m["n_lines"],
        2 * m["n_ascii_letters"] >= m["word_chars"] and 100 * m["n_upper"] > 40 * m["n_ascii_letters"], n >= 20 and 100 * m["n_top_word"] > 30 * n, m["word_chars"] > 40 * n,
    ]
    return sum(1 << k for k, b in enumerate(bad) if b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab C#|\n\té ", max_size=120), min_size=1, max_size=5))
def test_measurements(texts):
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    m = quality.measure(np.frombuffer(data, np.uint8), offsets)
    for i, t in enumerate(texts):
        want = rules(t)
        assert {k: int(m[k][i]) for k in want} == want and int(m["failed"][i]) == kept_by_hand(want)


def test_one_acronym_is_no_shouting():
    for text, loud in (("Это слова по USB и ещё немного слов", False), ("THIS IS LOUD text", True), ("", False)):
        data = text.encode()
        failed = int(quality.measure(np.frombuffer(data, np.uint8), np.array([0, len(data)]))["failed"][0])
        assert bool(failed >> quality.RULES.index("shouting") & 1) == loud


def test_ledger(odd, none, rows_of):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r["doc_id"], r["n_words"], r["n_repeat_words"], r["failed"]) for r in quality.ledger(odd).collect()), key=key)
    want = sorted(((i, m["n_words"], m["n_repeat_words"], kept_by_hand(m)) for i, m in ((i, rules(t)) for i, t in rows_of(odd))), key=key)
    assert got == want
    assert quality.ledger(none).count() == 0 and quality.keep_good(none).columns == none.columns
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(not f for *_, f in want)


def test_policies_and_ablations(spark, table):
    entries = quality.ledger(table("documents")).cache()
    masks = [r["failed"] for r in entries.collect()]
    policy = quality.mask_of(quality.POLICIES["v1"])
    assert quality.apply_policy(entries).where("kept").count() == sum(not m & policy for m in masks)
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablations(entries).collect()}
    for k, rule in enumerate(quality.RULES):
        if any(masks):
            assert got[rule] == (sum(m >> k & 1 for m in masks), sum(m == 1 << k for m in masks))
    assert set(quality.POLICIES["base"]) <= set(quality.POLICIES["v1"])


# ── toxicity ──


def test_toxicity_on_held_out_labels(spark, table):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, sf).join(table("labels", sf), "doc_id").where("held_out").collect()
    hit = Counter((r["toxic"], r["predicted"]) for r in got)
    assert hit[1, 1] / (hit[1, 0] + hit[1, 1]) > 0.8 and hit[0, 1] / (hit[0, 0] + hit[0, 1]) < 0.01
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["held_out"] for r in got} == {zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got}


def test_labels_of_held_out_rows_are_not_read(spark, table):
    docs, labels = table("documents"), table("labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels).weights == toxicity.fit(docs, flipped).weights


def test_terms_are_swapped_in_the_text():
    text = "The Muslims, and «muslims» of town;\n muslims' café, muslimsx"
    assert toxicity.swap_term(text, "muslims", "people") == "The people, and «people» of town;\n people' café, muslimsx"
    terms, neutral = {"en": ["muslims", "jews", "gay"], "de": ["frauen", "juden"]}, {"en": ["people"], "de": ["leute"]}
    copies = toxicity.counterfactuals("Muslims and Frauen", terms, neutral, 1, 8)
    assert len(copies) == 4 and {"people and Frauen", "Muslims and leute", "Muslims and juden"} < set(copies)
    assert toxicity.counterfactuals("nobody here", terms, neutral, 1, 8) == [] and len(toxicity.counterfactuals("gay jews and muslims", terms, neutral, 2, 1)) == 3


def test_the_fit_minimises_the_penalised_loss_by_the_plain_definition():
    """Scores of real swapped texts, word by word; plain proximal steps reach no lower value."""
    rng = np.random.default_rng(4)
    texts, y = [], []
    for i in range(160):
        toxic = int(i % 3 == 0)
        who = rng.choice(["muslims", "people", "jews", "women"], p=[0.6, 0.2, 0.1, 0.1] if toxic else [0.1, 0.5, 0.2, 0.2])
        texts.append(f"the {who} are {rng.choice(['idiots', 'kind']) if toxic else 'kind'} in town{i % 9}")
        y.append(toxic)
    words = sorted({w for t in texts for w in toxicity.words_of(t)} | {"muslims", "jews", "women", "gays", "people"})
    index, y = {w: k for k, w in enumerate(words)}, np.array(y, float)
    copies = [toxicity.counterfactuals(t, {"en": ["muslims", "jews", "women", "gays"]}, {"en": ["people"]}, 2, 8) for t in texts]
    of = lambda t: sorted(index[w] for w in toxicity.words_of(t) if w in index)
    x, pairs, signs = toxicity.Rows([of(t) for t in texts], None, len(words)), [], []
    for t, cs in zip(texts, copies):
        for c in cs:
            a, b = set(of(c)), set(of(t))
            pairs.append([*sorted(a - b), *sorted(b - a)])
            signs.append([1.0] * len(a - b) + [-1.0] * len(b - a))
    d, l1, swap = toxicity.Rows(pairs, signs, len(words)), toxicity.penalties(x, y, 1e-3), 2.0

    def plain(w, b):
        logit = lambda t: b + sum(w[index[v]] for v in toxicity.words_of(t) if v in index)
        loss = sum(math.log1p(math.exp(-(2 * t - 1) * logit(s))) for s, t in zip(texts, y)) / len(y)
        moved = sum((logit(c) - logit(t)) ** 2 for t, cs in zip(texts, copies) for c in cs) / len(y)
        return loss + float(l1 @ np.abs(w)) + swap * moved

    w, b = toxicity.solve(x, y, d, l1, swap, 600)
    assert math.isclose(plain(w, b), toxicity.objective(x, y, d, l1, swap, w, b), rel_tol=1e-9)
    w2, b2, step = np.zeros(len(words)), 0.0, 0.02
    for _ in range(8000):
        r = (1 / (1 + np.exp(-(x.times(w2) + b2))) - y) / len(y)
        w2 = w2 - step * (x.back(r) + 2 * swap / len(y) * d.back(d.times(w2)))
        w2, b2 = np.sign(w2) * np.maximum(np.abs(w2) - step * l1, 0), b2 - step * r.sum()
    assert plain(w, b) <= plain(w2, b2) + 1e-4
    free = toxicity.solve(x, y, d, l1, 0.0, 600)[0]
    assert (d.times(w) ** 2).sum() < 0.2 * (d.times(free) ** 2).sum()


def test_identity_terms_are_evened_out(spark):
    """Labels that come with one group's name: the penalty takes the name's weight, the insult keeps it."""
    docs, labels = [], []
    for i in range(600):
        toxic = i % 2
        group = "muslims" if (toxic and i % 3) or (not toxic and i % 12 == 0) else "people"
        said = "idiots" if toxic and i % 5 < 3 else "kind"
        docs.append((i, f"the {group} from town {i % 17} were {said} and went away {i % 13}"))
        labels.append((i, toxic))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    free, even = toxicity.fit(d, y, swap=0.0), toxicity.fit(d, y, swap=50.0)
    whole = lambda m, w: m.score(f"the {w} were kind")
    assert whole(free, "muslims") - whole(free, "people") > 0.2
    assert abs(whole(even, "muslims") - whole(even, "people")) < 0.05
    assert even.score("the people were idiots") > 0.5 > whole(even, "muslims")


def test_toxicity_of_odd_rows(spark, odd, none, table):
    model = toxicity.Model({"word": 3.0, "with*": 1.0}, -2.0)
    rows = {(r["doc_id"], round(r["score"], 6)) for r in toxicity.score(odd, model).collect()}
    f = lambda z: round(1 / (1 + math.exp(-z)), 6)
    assert {(0, f(-2)), (1, f(-2)), (6, f(1)), (None, f(-1)), (4, f(-2))} <= rows
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    empty_texts = spark.createDataFrame([(i, None if i % 2 else "") for i in range(9)], "doc_id long, text string")
    assert 0.3 < toxicity.fit(empty_texts, spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")).score("x") < 0.8
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(odd, no_labels).score("x") < 1e-5
    one_class = spark.createDataFrame([(3, 1), (4, 1), (9, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    assert toxicity.fit(odd, one_class).score("x") > 0.99


# ── near duplicates ──


def sets_of(rows, width):
    out = []
    for _, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        out.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    return out


def by_hand(rows, width, num, den):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = sets_of(rows, width)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    return sorted((r[0] is None, r[0] or 0, len(s), least.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets)))


def have(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in df.collect())


def test_near_duplicates_of_odd_rows(odd, none, rows_of):
    assert have(jaccard.near_duplicates(odd, width=4, num=85, den=100)) == by_hand(rows_of(odd), 4, 85, 100)
    assert jaccard.near_duplicates(none).count() == 0
    one = jaccard.one_of_each(odd)
    assert one.columns == odd.columns
    ids = Counter(r["doc_id"] for r in one.collect())
    assert ids[9] == 1 and ids[10] == 0 and ids[3] == 1 and ids[None] == 1 and ids[4] == 2


def variants(name, n):
    """n texts that are near but not equal."""
    base = [f"{name}{k}" for k in range(60)]
    return [" ".join([*base, f"{name}end{k}"]) for k in range(n)]


def test_texts_without_an_id_link_and_one_id_may_have_many_texts(spark):
    rows = [(None, x) for x in variants("a", 3)] + [(7, x) for x in variants("b", 3) + variants("c", 2)]
    # the last variant of d has no id, and alone connects the other two
    d = [f"d{k}" for k in range(100)]
    rows += [(20, " ".join(d[:88])), (None, " ".join(d[:98])), (21, " ".join(d[:108] + [f"z{k}" for k in range(8)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, want = have(jaccard.near_duplicates(df, width=4, num=85, den=100)), by_hand(rows, 4, 85, 100)
    key = lambda r: (*r[:3], r[3] is None, r[3] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[3] for r in want if r[1] in (20, 21)} == {20}


def test_one_row_of_each_component_stays(spark):
    a, b, c, d, e = (variants(x, 2) for x in "abcde")
    rows = [(None, a[0]), (None, a[1]), (None, b[0]), (None, b[0]), (5, c[0]), (5, c[1]), (5, d[0]), (3, d[1]), (8, e[0]), (None, e[1]), (None, None), (None, " "), (2, ""), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as key", "map('k', 1) as row").repartition(3)
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    which = Counter((i, (t or " ").split()[0][0] if (t or "").split() else "") for i, t in left)
    assert which == {(None, "a"): 1, (None, "b"): 1, (5, "c"): 1, (3, "d"): 1, (8, "e"): 1, (None, ""): 2, (2, ""): 2}


@pytest.mark.parametrize("num,den", [(4, 5), (85, 100), (1, 2)])
def test_near_duplicates_near_the_threshold(spark, num, den, monkeypatch):
    """Variants of a few texts, so that many pairs lie close to the threshold, in tiles and blocks that overflow."""
    monkeypatch.setattr(jaccard, "TILE", 16)
    rng = np.random.default_rng(5)
    rows = []
    for family in range(4):
        base = [f"f{family}w{k}" for k in range(int(rng.integers(12, 90)))]
        for k in range(45):
            words = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 14)))):
                words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + k, " ".join(f"u{rng.integers(0, 40)}" for _ in range(30))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert have(jaccard.near_duplicates(df, width=3, num=num, den=den)) == by_hand(rows, 3, num, den)


@settings(max_examples=100, deadline=None)
@given(st.integers(6, 300), st.integers(0, 60), st.integers(0, 60), st.integers(0, 2**32), st.sampled_from([(4, 5), (85, 100), (9, 10)]))
def test_linked_sets_share_a_signature(n, gone, new, seed, threshold):
    t, rng = jaccard.Threshold(*threshold), np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    b = np.unique(np.concatenate([rng.permutation(a)[min(gone, len(a) - 1) :], rng.integers(0, 2**63, new).astype(np.uint64)]))
    both = len(np.intersect1d(a, b))
    if t.linked(both, len(a), len(b)) and jaccard.set_key(a) != jaccard.set_key(b):
        sig, of = jaccard.signatures([a, b], t)
        assert len(np.intersect1d(sig[of == 0], sig[of == 1]))
        dims = jaccard.dimensions(len(a)), jaccard.dimensions(len(b))
        assert jaccard.block_forest([jaccard.count_vector(a, dims[0])], [jaccard.count_vector(b, dims[1])], t) == [(0, 1)]
        assert jaccard.join_tiles([a], [b], t) == [(0, 1)]


def test_large_blocks_are_cut_into_tiles(spark, monkeypatch):
    """Blocks run in the executors' Python; here the cut itself is tested."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    sig, key = np.zeros(11, np.uint64), np.arange(11)
    tile = np.arange(11) // 4
    pairs = set()
    for other in range(3):
        for b in jaccard._member_rows(sig, key, np.minimum(tile, other), np.maximum(tile, other), tile):
            pairs |= set(zip(b.column("lo").to_pylist(), b.column("hi").to_pylist(), b.column("key").to_pylist()))
    met = defaultdict(set)
    for lo, hi, k in pairs:
        met[lo, hi].add(k)
    assert all(any({i, j} <= ks for ks in met.values()) for i in range(11) for j in range(i))


# ── language-model scores ──


def test_scores(spark, table, rows_of):
    rows = rows_of(table("documents"))
    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    train = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()), len(c)
    got = queries.op5_lm_scoring(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] not in train, len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] <= 0
    again = {r["doc_id"]: r["score"] for r in queries.op5_lm_scoring(spark, SF).collect()}
    assert all(math.isclose(again[r["doc_id"]], r["score"], rel_tol=1e-6) for r in got)


def test_scores_by_the_plain_definition(spark, monkeypatch):
    """Token by token from the trained weights: both softmaxes over every class and leaf, then the share in the leaf."""
    caught, train = [], scoring._train
    monkeypatch.setattr(scoring, "_train", lambda *a: caught.append(train(*a)) or caught[0])
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{k}{'.' if k % 4 == 0 else ''}" for k in rng.geometric(0.006, 12).tolist())) for i in range(70)] + [(None, "w1 never.seen W2"), (71, None), (71, "w3 w3")]
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), epochs=4).collect()}
    shape, w = scoring.Shape.of(700), caught[0]
    assert w.shape == (shape.features, shape.classes + shape.leaves)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = [[*(t or "").lower().encode().split(), b""] for _, t in rows]
    c = Counter(x for (i, _), ws in zip(rows, words) if not held(i) for x in ws)
    own = [t for t, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: shape.own]]
    assert len(c) > shape.own + 100
    codes = scoring.Codes(own, shape)
    code = lambda t: [int(x[0]) for x in codes.of([t])]
    inside_n, inside_v = Counter(), Counter()
    for t, n in c.items():
        inside_n[code(t)[0]] += n
        inside_v[code(t)[0]] += 1
    for (i, _), ws in zip(rows, words):
        total = 0.0
        for k, t in enumerate(ws):
            a, b = (code(ws[k - 1])[1] if k else 0), (code(ws[k - 2])[2] if k > 1 else 0)
            trigram = ((a * 2654435761 + b * 40503) >> 7) % shape.h12
            z = w[0] + w[1 + a] + w[1 + shape.h1 + b] + w[1 + shape.h1 + shape.h2 + trigram]
            leaf, per = code(t)[0], shape.leaves // shape.classes
            group = leaf // per
            mine = z[shape.classes + group * per : shape.classes + (group + 1) * per]
            total += z[group] - math.log(sum(map(math.exp, z[: shape.classes]))) + mine[leaf % per] - math.log(sum(map(math.exp, mine)))
            if leaf >= len(own):
                total += math.log((c[t] + 1) / (inside_n[leaf] + inside_v[leaf] + 1))
        assert math.isclose(got[i, len(ws)], total / math.log(10), rel_tol=1e-4), (i, got[i, len(ws)], total / math.log(10))


def test_statistics_are_added_up_as_they_come(monkeypatch):
    monkeypatch.setattr(scoring, "PENDING", 10)
    rng, want, batches = np.random.default_rng(1), defaultdict(Counter), []
    for part in (0, 0, 0, 0, 3, 3, 5):
        code = np.unique(rng.integers(0, 60, 25))
        n = rng.integers(1, 9, len(code))
        want[part].update(dict(zip(code.tolist(), n.tolist())))
        batches.append(pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([scoring._pack(code, n)], pa.binary())], ["part", "body"]))
    got = {b.column(0)[0].as_py(): dict(zip(*(x.tolist() for x in scoring._unpack(b.column(1)[0].as_py())))) for b in scoring._merge(iter(batches))}
    assert got == {k: dict(v) for k, v in want.items()}


def test_tokens_are_stored_once_and_sent_once(spark, monkeypatch, tmp_path):
    """Disk: of nearly distinct tokens, one copy in the chunks, one in the requests; the chunks themselves don't travel."""
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.bytes(8).hex() for _ in range(2000))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    docs.write.parquet(f"{tmp_path}/docs")
    before, docs = sent(), spark.read.parquet(f"{tmp_path}/docs")
    assert len(scoring.score(docs, epochs=1).collect()) == 200
    size = sum(len(t) for _, t in rows)
    stored = sum(f.stat().st_size for d in tmp_path.glob("lm_*") for f in d.rglob("*.parquet"))
    assert stored < 1.6 * size and sent() - before < 2 * size, (stored / size, (sent() - before) / size)


def test_the_model_beats_the_base_on_held_out_text(spark):
    got = [r for r in queries.op5_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_the_model_grows_with_the_vocabulary_and_hashes_whole_tokens(spark, monkeypatch):
    shapes = [scoring.Shape.of(n) for n in (0, 1 << 15, 1 << 18, 1 << 21, 1 << 27)]
    assert [s.scale for s in shapes] == [1, 1, 2, 4, 16]
    assert all(s.leaves == s.own + s.shared and s.leaves % s.classes == 0 for s in shapes)
    _, h1, h2 = scoring.Codes([]).of([f"w{k}ing".encode() for k in range(400)])
    assert len(set(h1.tolist())) > 25 and len(set(h2.tolist())) > 9
    monkeypatch.setattr(scoring, "STEP", 4)
    # which of two words follows is told by the whole word before, not by its ending
    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"{'ab'[x]}zing {'ab'[x]}end" for x in rng.integers(0, 2, 40).tolist())
    rows = [(i, text() + f" u{i}") for i in range(300)]
    got = scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert scoring.Shape.of(300).scale == 4 and all(r["score"] < 0 for r in got)
    assert np.mean([r["score"] / r["n_tokens"] for r in got if r["held_out"]]) > -0.3


def test_softmaxes_sum_to_one_and_the_gradient_is_one():
    rng = np.random.default_rng(1)
    w = rng.normal(0, 0.3, (scoring.FEATURES, scoring.CLASSES + scoring.LEAVES))
    context = np.array([0, 5, 77, 4000])
    lc, ll = scoring.log_softmaxes(w, context)
    assert np.allclose((np.exp(lc)[:, :, None] * np.exp(ll)).sum((1, 2)), 1)
    counts = rng.integers(0, 3, (4, scoring.LEAVES)).astype(float)
    g, like = scoring.gradient(w, context, counts)
    for i, j in ((0, 3), (1 + 5 // scoring.H2, 40), (1 + scoring.H1 + 5, 100)):
        w2 = w.copy()
        w2[i, j] += 1e-5
        assert math.isclose((scoring.gradient(w2, context, counts)[1] - like) / 1e-5, g[i, j], rel_tol=1e-3, abs_tol=1e-3)


def test_scores_of_odd_rows(odd, none):
    rows = scoring.score(odd, epochs=2).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert [r["n_tokens"] for r in by[0] + by[1] + by[2]] == [1, 1, 1] and by[3][0]["score"] == by[3][1]["score"] and by[None][0]["held_out"] is False
    assert by[9][0]["n_tokens"] == 120_001 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert scoring.score(none).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    only = scoring.score(odd.sparkSession.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in only)
