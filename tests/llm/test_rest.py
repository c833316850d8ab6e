"""Chat formatting, URL filter, top-k search, the pipeline."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import chat, oracles, quality, queries, topk, toxicity, urls

from .test_text import by_hand, kept_by_hand, rules
from .test_tokens import check_packing, ids_by_library

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = c.sql(oracles.ORACLES[name])
    at = [got.columns.index(x) for x in columns]
    assert sorted(got.columns) == columns
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in got.fetchall())


# ── chat ──

NASTY = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/s>", "[", "INST]", "\n", " ", "a", "é"]), max_size=8).map("".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "</s>", "a\nb", "<br>", "<\\br>\n", "\n"]), NASTY), min_size=1, max_size=4), min_size=5, max_size=20))
def test_chat_round_trip(spark, convs):
    rows = [(i, k, role, text) for i, turns in enumerate(convs) for k, (role, text) in enumerate(turns)]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for i, turns in enumerate(convs):
        r = got[i]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns and r["verified"]
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        masked = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert "".join(re.sub(r"([<\[])\\(\\*)(/?s>|/?INST\])", r"\1\2\3", x) for x in masked) == r["loss_text"]
        assert r["formatted"].count("</s>") == len(turns) and r["formatted"].count("<s>") == len(turns)


def test_chat_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, None, None), (1, 2, "assistant", "b"), (None, 0, "user\nx", "q"), (2, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as t", "'s' as source", "2 as formatted")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", ""), ("assistant", "b"), ("assistant", "b")] and got[1]["loss_text"] == "bb"
    assert got[None]["turns"][0]["role"] == "user\nx" and got[None]["formatted"] == "<s>[INST] user<br>x\nq</s>" and all(r["verified"] for r in got.values())
    assert chat.format_conversations(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 0, "assistant", "x </s> " * 50_000)], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(long).select(F.char_length("loss_text")).first()[0] == 350_000


def test_chat_has_no_python(spark):
    plan = queries.op2_chat_formatting(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn", plan)


def test_chat_conflict(spark):
    r = queries.op2_chat_formatting(spark, SF).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["loss_chars"], r["verified"]) == (2, len(text), True)
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# ── URLs ──


def url_by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, verdict in queries.URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def test_urls(spark, table):
    odd = ["HTTP://A.Example.COM/en/7x?q#f", "no scheme", "", None, "x://", "a://b://c/d", "http://example.net/de/8", "https://sub.example.net/de/81?x", "http://net/de/", "http://xnet/de/1", "http://é.ÉX.org/es/\n", "http://com/en", "https://casino-win.example.fr/a"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(odd)] + [(3, odd[0])], "page_id long, url string").selectExpr("*", "'h' as host", "1 as score", "'r' as rule")
    df = df.union(table("pages").select("page_id", "url", F.lit("h"), F.lit(1), F.lit("r")))
    model = urls.fit(spark.createDataFrame(urls.labelled_urls(), "url string, label int"))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in urls.judge(df, model, queries.URL_RULES).collect())
    want = []
    for r in df.collect():
        host, path, best = url_by_hand(r["url"])
        want.append((r["page_id"], host, path, best[0] if best else "", best[1] if best else ("block" if model.score(host, path) > 0 else "allow")))
    assert got == sorted(want)
    assert urls.judge(df.limit(0), model, queries.URL_RULES).count() == 0
    assert urls.fit(spark.createDataFrame([], "url string, label int")).score("a.com", "/") < 0


def test_url_classifier_on_held_out_urls(spark, table):
    known = urls.labelled_urls()
    assert len({u for u, _ in known}) == len(known) and 20 < sum(urls.held_out(u) for u, _ in known) < 50
    model = urls.fit(spark.createDataFrame([r for r in known if not urls.held_out(r[0])], "url string, label int"))
    right = [(model.score(*url_by_hand(u)[:2]) > 0) == y for u, y in known if urls.held_out(u)]
    assert sum(right) / len(right) > 0.7
    # no word of a labelled host stands in a host of the test tables
    words = lambda host: set(re.split(r"[.\-]", host)) - {"www", "blog", "m", "com", "net", "org"}
    theirs = set().union(*(words(url_by_hand(r["url"])[0]) for r in table("pages", "/root/testdata/sf0.01").collect()))
    assert not theirs & set().union(*(words(url_by_hand(u)[0]) for u, _ in known))


def test_long_urls(spark):
    rows = [(1, "http://a.com/" + "x" * 200_000), (2, "http://" + "h" * 50_000), (3, "x" * 100_000)]
    model = urls.fit(spark.createDataFrame(urls.labelled_urls(), "url string, label int"))
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), model, queries.URL_RULES).collect()}
    assert (len(got[1]["path"]), len(got[2]["host"]), got[3]["host"], got[3]["path"]) == (200_001, 50_000, "", "")


# ── top-k ──


@pytest.mark.parametrize("dim,n,spread", [(1, 30, 4), (3, 200, 30), (16, 300, 1000), (4, 150, 1)])
def test_topk(spark, dim, n, spread):
    rng = np.random.default_rng(dim)
    rows = [(i, rng.integers(-spread, spread + 1, dim).tolist()) for i in range(n)]
    rows += [(n + i, [spread] * dim) for i in range(40)] + [(1000, None), (None, [spread] * dim), (6, [0] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, x array<long>").selectExpr("*", "1 as dist", "2 as pivot", "'s' as score")
    got = topk.top_k(df, "vec_id", "x", F.col("vec_id") % 3 == 0, k=5, pivots=8, query_block=16)
    # a repeated query id asks with each of its rows and keeps each candidate's best score
    want = {}
    for q, x in rows:
        if q is not None and x is not None and q % 3 == 0:
            mine = want.setdefault(q, {})
            for v, y in rows:
                if y is not None and v != q:
                    mine[v] = max(int(np.dot(x, y)), mine.get(v, -(10**18)))
    flat = sorted(((q, i + 1, v, s) for q, best in want.items() for i, (v, s) in enumerate(sorted(best.items(), key=lambda e: (-e[1], e[0] is None, e[0] or 0))[:5])), key=str)
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()), key=str) == flat


def test_topk_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, []), (6, [0.5, -0.001]), (7, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>").select("vec_id", topk.quantise(F.col("e")).alias("x"))
    assert {r["vec_id"]: r["x"] for r in df.collect() if r["x"] is not None} == {0: [256, 512], 6: [128, -1], 7: [768]}
    got = topk.top_k(df, "vec_id", "x", F.col("vec_id") == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 7, 256 * 768), (0, 2, 6, 256 * 128 - 512)]
    assert topk.top_k(df.limit(0), "vec_id", "x", F.col("vec_id") == 0).count() == 0
    big = spark.createDataFrame([(i, [2**30 + i, 2**30 - i]) for i in range(30)], "vec_id long, x array<long>")
    got = topk.top_k(big, "vec_id", "x", F.col("vec_id") == 0).orderBy("rank").collect()
    want = sorted(((2**30) * (2**31), i) for i in range(1, 30))[:5]
    assert [(r["score"], r["vec_id"]) for r in got] == want


# ── the pipeline ──


def test_pipeline(spark, table, rows_of):
    docs = table("documents")
    stages, kept = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        stages.append(rows_of(kept))
        assert kept.columns == docs.columns
    good = [(i, t) for i, t in rows_of(docs) if not kept_by_hand(rules(t))]
    assert sorted(stages[0]) == sorted(good)
    model = toxicity.fit(spark.createDataFrame(good, "doc_id long, text string"), table("labels"))
    clean = [(i, t) for i, t in good if model.score(t) < 0.5]
    assert sorted(stages[1]) == sorted(clean)
    first = {name for _, name, _, least in by_hand(clean, 5, 4, 5) if name == least}
    assert sorted(i for i, _ in stages[2]) == sorted(first)
    check_packing(corpus_pipeline.run(spark, SF).collect(), ids_by_library([(i, t) for i, t in clean if i in first]))


def test_stages_name_rejected_rows_only(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, SF)
        assert out.count() == 0 and out.columns == none.columns, name
    assert quality.keep_good(odd).columns == odd.columns
