"""Queries over whole tables against brute force."""

import json

import pytest
import regex

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def items(spark):
    return {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}


def levenshtein(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_edit_similarity_compares_whole_texts(spark):
    b, got = items(spark), {(r.a, r.b): r.sim for r in rows(spark, "edit_similarity_all")}
    some = sorted(got)[:25]
    assert all(abs(got[x, y] - (1 - levenshtein(b[x], b[y]) / max(len(b[x]), len(b[y])))) < 1e-6 for x, y in some)


def test_windows_reach_the_end_of_long_texts(spark, texts):
    want = {}
    for i, t in texts.items():
        ids = [len(w) for w in t.split(" ")]
        n = len(ids) // 64 * 64 if len(ids) >= 64 else len(ids)
        for at in range(0, n, 32):
            end = min(at + 32, n)
            x = ids[max(at + 32 - 64, 0) : end]
            want[i, at] = (x + [0] * (64 - len(x)), [-100] * (len(x) - end + at) + ids[at:end] + [-100] * (64 - len(x)))
    assert max(len(t) for t in texts.values()) > 4000
    assert {(r.doc_id, r.i): (r.input_ids, r.labels) for r in rows(spark, "token_windows")} == want
    assert {r.doc_id: r.n for r in rows(spark, "window_token_counts")} == {i: sum(y != -100 for (d, _), (_, ys) in want.items() if d == i for y in ys) - 1 for i in texts}
    pad = lambda t, fill: ([len(w) for w in t.split(" ")] + [fill] * 64)[:64]
    assert {r.doc_id: (r.ids, r.labels) for r in rows(spark, "pad_mask")} == {i: (pad(t, 0), pad(t, -100)) for i, t in texts.items()}


def test_pairs_and_answers_over_all_ids(spark, texts):
    b = items(spark)
    pairs = {(x, y) for x in b for y in b if x < y}
    assert {(r.a, r.b) for r in rows(spark, "edit_similarity_all")} == pairs
    bags = {i: set(t.lower().split(" ")) for i, t in b.items()}
    assert {(r.a, r.b): r.jac for r in rows(spark, "jaccard_lexical")} == pytest.approx({(x, y): len(bags[x] & bags[y]) / len(bags[x] | bags[y]) for x, y in pairs if bags[x] & bags[y]}, abs=1e-6)
    tokens = {r.doc_id: r.tokens for r in rows(spark, "tokenize")}
    assert set(tokens) == set(texts)
    joined = {i: f" {' '.join(x)} " for i, x in tokens.items()}
    whole = {i: " ".join(regex.findall(r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]", t)).lower() for i, t in b.items()}
    want = sorted((i, j) for i, h in whole.items() for j, x in joined.items() if f" {h} " in x)
    assert sorted(map(tuple, rows(spark, "has_answer"))) == want == sorted(map(tuple, rows(spark, "has_answer_nfd")))


def test_answers_are_decomposed_before_they_are_compared(spark):
    from pyspark.sql import functions as F

    from tesserae.functions import text as T
    from tesserae.operators.answers import answer_hits
    from tesserae.sources.records import nfd

    docs = spark.createDataFrame([(1, "un caf\u00e9 noir et un th\u00e9"), (2, "un cafe\u0301 noir"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Cafe\u0301 NOIR"), (2, "caf\u00e9 noir et un"), (3, "")], "item_id long, text string")
    toks = lambda t: T.tokens(nfd(F.col("text"))) if t else T.tokens(F.col("text"))
    got = {t: sorted(map(tuple, answer_hits(items.select("item_id", toks(t).alias("answer")), docs.where("text is not null").select("doc_id", toks(t).alias("t"))).collect())) for t in (True, False)}
    every = [(3, i) for i in (1, 2, 4)]
    assert got[True] == [(1, 1), (1, 2), (2, 1), *every] and got[False] == [(1, 2), (2, 1), *every]


def test_whole_tables_of_events_and_vectors(spark):
    props = [(r.user_id, *x) for r in spark.read.parquet(f"{SF}/events.parquet").collect() for x in json.loads(r.props).items()]
    assert sorted((r.user_id, r.key, str(r.value)) for r in rows(spark, "json_edges")) == sorted((u, k, str(v)) for u, k, v in props)
    for name in ("pna_aggregate", "sage_max_layer", "gcn_norm_layer", "virtual_node", "gnnak_pool"):
        assert {r.pos for r in rows(spark, name)} == set(range(64))
    nodes = {r.idx: r.name for r in entry._catalogue.nodes(spark, SF).collect()}
    names = {i: f"C{i % 7}.m{i % 13}" for i in nodes}
    want = {n: min(k for k in names if n.endswith(names[k])) for n in nodes.values() if any(n.endswith(x) for x in names.values())}
    assert {r.node: r.idx for r in rows(spark, "fuzzy_suffix_first")} == want


def test_row_numbers(spark):
    from tesserae.operators.numbering import numbered
    from tesserae.operators.sampling import ordered_split

    d = spark.createDataFrame([(i % 3, i, None if i % 7 else "x") for i in range(500)], "k long, v long, s string")
    got = sorted((r.nr, r.k, r.v) for r in numbered(d, "k").collect())
    assert got == [(n, k, v) for n, (k, v) in enumerate(sorted((i % 3, i) for i in range(500)))]
    assert numbered(d.limit(0), "k").count() == 0
    tied = ordered_split(spark.createDataFrame([(i // 25,) for i in range(100)], "k long"), "k", 0.3)
    assert tied.where("is_train").count() == 30


def test_call_edges_against_loops(spark):
    names, graph, calls = (x.collect() for x in entry._catalogue._call_graph(spark, SF))
    names, graph = sorted(names), sorted(graph, key=lambda r: r.idx)
    called = {}
    for r in calls:
        called.setdefault(r.caller, []).append(r.node)
    ends = {x: next((n.idx for n in names if x.endswith(n.name)), None) for x in {r.node for r in calls}}
    edges, misses = set(), {}
    for n in names:
        file = n.name.endswith(".py")
        node = next((g.idx for g in graph if (g.name == n.name.split(".")[0] if file else n.name in g.name)), None)
        edges |= {(n.idx, ends[x], 2 if file else 1) for x in called.get(node, ()) if ends[x] is not None}
        if not file:
            m = misses.setdefault(n.file_id, [0, 0])
            m[node is None] += 1
    assert {e for _, _, e in edges} == {1, 2} and any(m for _, m in misses.values())
    assert sorted(map(tuple, rows(spark, "call_edges"))) == sorted(edges)
    assert {r.file_id: [r.captured, r.missed] for r in rows(spark, "call_edge_misses")} == misses
