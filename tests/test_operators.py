"""Small literal cases of the graph retrieval operators."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import expand as X
from tesserae.operators import resolve as J
from tesserae.operators import sampling as M
from tesserae.operators import search as V
from tesserae.operators import sketch as H
from tesserae.operators import subgraph as S
from tesserae.sources import code as P
from tesserae.sources import records as R


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, etype int")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_hops_end_on_a_disconnected_graph(spark):
    e = edges(spark, [(1, 2, 0), (2, 3, 1), (7, 8, 0)])
    assert rows(S.hop_labels(spark.createDataFrame([(1,)], "idx long"), e), "idx", "hop") == [(1, 0), (2, 1), (3, 2)]


def test_bfs_cap_keeps_near_nodes(spark):
    e = edges(spark, [(1, k, 0) for k in range(2, 6)] + [(2, 9, 0)])
    assert rows(X.bfs(spark.createDataFrame([(1,)], "idx long"), e, 2, 3), "idx", "hop") == [(1, 0), (2, 1), (3, 1)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=12))
def test_bfs_is_minimal(spark, pairs):
    near, got = {0: 0}, {}
    while got != near:
        got = dict(near)
        for a, b in pairs + [(b, a) for a, b in pairs]:
            if a in near and near.get(b, 99) > near[a] + 1:
                near[b] = near[a] + 1
    e = edges(spark, [(a, b, 0) for a, b in pairs])
    assert dict(rows(X.bfs(spark.createDataFrame([(0,)], "idx long"), e, 7), "idx", "hop")) == near


def test_patterns_in_both_modes(spark):
    nodes = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "idx long, node_type int")
    e, c = edges(spark, [(1, 2, 2), (2, 3, 1)]), spark.createDataFrame([(1,)], "idx long")
    assert rows(X.pattern_expand(c, nodes, e, 2, "intended"), "idx") == [(1,), (2,)]
    e = edges(spark, [(1, 2, 2), (2, 3, 3)])
    assert rows(X.pattern_expand(c, nodes, e, 2, "last_edge"), "idx") == [(1,), (2,), (3,)]


def test_two_pass_imports(spark):
    names = spark.createDataFrame([(0, "z.q"), (1, "a.q")], "idx long, name string")
    got = J.resolve_imports(spark.createDataFrame([("a.q",), ("k.q",), ("none.x",)], "imp string"), names)
    assert rows(got, "imp", "idx") == [("a.q", 1), ("k.q", 0)]


def test_suffix_is_by_character(spark):
    got = J.suffix_first(spark.createDataFrame([("pkg.mod.f",)], "node string"), spark.createDataFrame([(4, "od.f"), (2, "mod.f")], "idx long, name string"))
    assert rows(got, "node", "idx") == [("pkg.mod.f", 2)]


def test_padding_cycles(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, idx int, rank int")
    assert [r.idx for r in V.pad_by_cycling(ranked, 5).orderBy("place").collect()] == [10, 11, 10, 11, 10]


def test_induced_and_renumbered(spark):
    mem = spark.createDataFrame([(0, 5), (0, 9)], "sg long, idx long")
    e = edges(spark, [(5, 9, 1), (9, 7, 1)])
    assert rows(S.renumbered_edges(mem, e), "new_src", "new_dst", "etype") == [(0, 1, 1)]


def test_set_cover_and_farthest(spark):
    mem = spark.createDataFrame([(g, *r) for g in (0, 7) for r in [(0, 0), (0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]], "graph long, sg long, idx long")
    order = lambda df: [[r.sg for r in sorted(df.where(F.col("graph") == g).collect(), key=lambda r: r.place)] for g in (0, 7)]
    assert order(M.set_cover(mem)) == [[0, 1]] * 2 and order(M.set_cover(mem, 9)) == [[0, 1, 2]] * 2
    e = spark.createDataFrame([(g, i, i + 1) for g in (0, 7) for i in range(3)], "graph long, src long, dst long")
    assert [x[:2] for x in order(M.farthest_roots(mem, e, 2, 0))] == [[0, 3]] * 2
    assert M.set_cover(mem.limit(0)).count() == 0 and M.sampled("shortest_path", mem, e, stride=9).count() > 0
    with pytest.raises(ValueError):
        M.sampled("other", mem, e)


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(T.normalised_answer(F.lit("The  Cat, a dog!"))) == "cat dog"
    assert value(T.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    assert value(T.inversions(F.array(*map(F.lit, (3, 1, 2))))) == 2
    assert value(T.has_answer(F.array(F.array().cast("array<string>")), F.array(F.lit("x")))) is True
    assert value(T.has_answer(F.array().cast("array<array<string>>"), F.array(F.lit("x")))) is False
    w = value(T.windows(F.array(*map(F.lit, range(10))), 4, 2, 0))
    assert len(w) == 4 and w[0].labels == [0, 1, -100, -100] and w[1].labels == [-100, -100, 2, 3][0:0] + w[1].labels
    assert sorted(x for r in w for x in r.labels if x != -100) == list(range(8))


def test_parsing(spark):
    rows_ = P.entities_of("pkg/__init__.py", "from a.b import c, d as e\nfrom . import x\nimport os\n")
    assert [r[2] for r in rows_] == ["a.b.c", "a.b.d", "None.x"]
    assert P.entities_of("x.py", "def (") == []


def test_passages_skip_headers_and_short_rows(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("id\ttext\ttitle\n1\ta\tb\n2\tc\nid\tx\ty\n3\td\te\n")
    assert rows(R.load_passages(spark, str(tmp_path / "p.tsv")), "id", "text", "title") == [("1", "a", "b"), ("3", "d", "e")]


def test_sources_by_pattern(spark, tmp_path):
    for name, text in (("a.py", "x=1"), ("b.txt", "no"), ("c.go", "é")):
        (tmp_path / name).write_text(text)
    assert sorted(r.text for r in P.read_sources(spark, str(tmp_path), P.PATTERNS).collect()) == ["x=1", "é"]


def test_split_and_records_round_trip(spark, tmp_path):
    got = M.ordered_split(spark.range(10), "id", 0.8)
    assert got.where("is_train").count() == 8
    R.write_split(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/dev")).count() == 2


def test_sketches_of_64_bits_follow_their_formulas(spark):
    d = spark.createDataFrame([(k,) for k in range(40)], "idx long")
    got = d.select("idx", H.minhash_64(F.col("idx"), 5).alias("m"), H.register_64(F.col("idx"), 4).alias("r")).collect()
    a, b = H.permutations(5)
    for r in got:
        h = int(pd.util.hash_array(np.array([r.idx + 1]))[0])
        assert r.m == [(int(x) * h + int(y)) % 2**64 % (2**61 - 1) & (2**32 - 1) for x, y in zip(a, b, strict=True)]
        assert r.r.pos == h % 16 and r.r.v == 61 - int(np.ceil(np.log2(float((h >> 4) + 1))))


def test_bias_makes_counts_better(spark):
    gen, bias, errors = np.random.default_rng(5), H.simulated_bias(6), []
    for n in (60, 90):  # beyond the linear counts, where raw estimates are too high
        sets = [[0] * 64 for _ in range(200)]
        for regs in sets:
            for at, v in zip(gen.integers(0, 64, n), gen.geometric(0.5, n), strict=True):
                regs[at] = max(regs[at], int(v))
        d = spark.createDataFrame([(x,) for x in sets], "r array<int>")
        plain, refined = d.select(F.avg(H.hll_count(F.col("r"), 6)), F.avg(H.hll_count(F.col("r"), 6, bias))).first()
        errors.append((abs(plain - n), abs(refined - n)))
    assert sum(r for _, r in errors) < sum(p for p, _ in errors) and all(r < 3 for _, r in errors)
    empty = spark.createDataFrame([([0] * 64,)], "r array<int>")
    assert empty.select(H.hll_count(F.col("r"), 6)).first()[0] == 0


def test_three_hop_features_of_a_path(spark):
    n = spark.createDataFrame([(k,) for k in range(4)], "idx long")
    feeds = H.neighbourhoods(n, edges(spark, [(k, k + 1, 0) for k in range(3)] + [(k + 1, k, 0) for k in range(3)]))
    links = spark.createDataFrame([(0, 1)], "u long, v long")
    got = H.link_features(links, H.khop_sets(n, feeds, 3), 3).first()
    assert [got[f"f{k}"] for k in range(15)] == [2, 1, 0, 0, 0, 0, 1] + [0] * 8
    masked = H.link_features(links, H.khop_sets(n, feeds, 3), 3, zero_one=False).first()
    assert [masked[f"f{k}"] for k in (4, 5, 11, 12)] == [0] * 4


def test_knn_lm(spark):
    lm = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.5), (2, 7, 1.0)], "query long, token int, p double")
    near = spark.createDataFrame([(1, 7, 2.0), (1, 7, 2.0), (1, 9, 2.0)], "query long, token int, dist double")
    got = {(r.query, r.token): r.p for r in V.knn_lm(lm, near, 0.3).collect()}
    assert got == pytest.approx({(1, 7): 0.55, (1, 8): 0.35, (1, 9): 0.1, (2, 7): 1.0})


def test_carving_and_refusal(spark):
    d = spark.range(0, 1500).withColumnRenamed("id", "k").withColumn("text", F.lit("abc"))
    assert {r.split: r["count"] for r in M.carved(d, "k", True).groupBy("split").count().collect()} == {"train": 3, None: 1497}
    assert {r.split: r["count"] for r in M.carved(d, "k", False).groupBy("split").count().collect()} == {"validation": 150, "train": 1350}
    assert M.repo_split(d, "k", least_chars=4500).where("is_train").count() == pytest.approx(1200, abs=60)
    with pytest.raises(ValueError):
        M.repo_split(d, "k", least_chars=4501)
    with pytest.raises(ValueError):
        M.repo_split(d.limit(0), "k")


def test_text_options(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first().x
    ids = F.array(*map(F.lit, range(10)))
    assert value(T.mask(ids, 12)) == [1] * 10 + [0, 0] and value(T.mask(ids, 3)) == [1, 1, 1]
    assert value(T.truncated(ids, 8, "encoder")) == [0, 1, 2, 3] and value(T.truncated(ids, 8, "decoder")) == [5, 6, 7, 8, 9] and value(T.truncated(ids, 8, "encoder_decoder")) == [0, 1, 2]
    assert value(T.truncated(ids, 99, "decoder")) == list(range(10)) and value(T.block_size(F.lit(4096))) == 1024
    answers = F.array(F.lit("a"), F.lit("b"))
    assert value(T.target_text(F.lit("t"), answers, F.lit(1))) == "t </s>" and value(T.target_text(F.lit(None).cast("string"), answers, F.lit(3))) == "b </s>"
    assert value(T.target_text(F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(3))) is None
    assert value(T.perplexity(F.lit(1e4))) == float("inf")


def test_records_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y")], "repo string, idx long, name string")
    e = spark.createDataFrame([("a", 0, 0, 1)], "repo string, src long, dst long, etype int")
    R.write_graph(n, e, f"{tmp_path}/g")
    got_n, got_e = R.read_graph(spark, f"{tmp_path}/g", ["a"])
    assert rows(got_n, "idx", "name", "repo") == [(0, "x", "a")] and rows(got_e, "src", "dst", "etype") == [(0, 0, 1)]
    R.write_samples(n, f"{tmp_path}/s")
    assert R.read_samples(spark, f"{tmp_path}/s").count() == 2 and rows(R.read_samples(spark, f"{tmp_path}/s", 1, 1), "repo") == [("b",)]
    R.write_merged([n.where("idx = 1"), n.where("idx = 0")], "idx", f"{tmp_path}/t", "name")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t").collect()] == ["x", "y"]
    R.log_metrics(spark, f"{tmp_path}/m", 1, {"acc": 0.5})
    R.log_metrics(spark, f"{tmp_path}/m", 2, {"acc": 0.75})
    assert rows(spark.read.json(f"{tmp_path}/m"), "step", "value") == [(1, 0.5), (2, 0.75)]
    R.write_text_csv(spark.createDataFrame([("a,b",)], "text string"), f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first().text == "a,b"


def test_examples_of_json_and_json_lines(spark, tmp_path):
    one = ['{"question": "q%d", "ctxs": [{"text": "t"}%s]}' % (i, ', {"text": "u", "score": 2.0}' if i else "") for i in range(5)]
    (tmp_path / "a.jsonl").write_text("\n".join(one))
    (tmp_path / "a.json").write_text("[" + ",".join(one) + "]")
    for name in ("a.json", "a.jsonl"):
        got = {r.k: r for r in R.read_examples(spark, f"{tmp_path}/{name}").collect()}
        assert [got[k].question for k in range(5)] == [f"q{k}" for k in range(5)] and got[3].id == "3" and [c.score for c in got[3].ctxs] == [0.25, 2.0]
        assert sorted(r.k for r in R.read_examples(spark, f"{tmp_path}/{name}", 1, 2).collect()) == [1, 3]


def test_load_samples(spark, tmp_path):
    d = spark.createDataFrame([("retrieval", "java", "cross_file_first", "easy_1", 1), ("retrieval", "java", "cross_file_first", "easy_2", 2), ("retrieval", "python", "cross_file_random", "hard", 3)], "task string, language string, setting string, shard string, v int")
    d.write.partitionBy("task", "language", "setting", "shard").parquet(f"{tmp_path}/d")
    assert rows(R.load_samples(spark, f"{tmp_path}/d", "R", "java", "xf-f"), "v", "shard") == [(1, "easy_1"), (2, "easy_2")]
    assert rows(R.load_samples(spark, f"{tmp_path}/d", "retrieval", "py", ["xf-r", "xf-f"]), "v") == [(3,)]
    for bad in (("x", "py", "if"), ("r", "x", "xf-f"), ("r", "py", "if"), ("c", "py", "zz")):
        with pytest.raises(ValueError):
            R.load_samples(spark, f"{tmp_path}/d", *bad)


def test_biased_walks_against_loops(spark):
    pairs = {(a, b) for a in range(12) for b in range(12) if a != b and (a * 7 + b * 5) % 4 == 0}
    e = edges(spark, [(a, b, 0) for a, b in sorted(pairs)])
    roots = spark.createDataFrame([(i,) for i in range(12)], "idx long")
    for p, q in ((0.25, 4.0), (2.0, 0.5)):
        want = {(i, i) for i in range(12)}
        for r in range(2):
            for root in range(12):
                at, before = root, None
                for k in range(5):
                    ahead = sorted(b for a, b in pairs if a == at)
                    if not ahead:
                        break
                    w = [1 / p if b == before else 1.0 if before is None or (before, b) in pairs else 1 / q for b in ahead]
                    share = (root * 7919 + at * 104729 + (1 + 31 * r + 7 * k)) % 1000003 / 1000003.0 * sum(w)
                    upto = 0.0
                    for b, x in zip(ahead, w, strict=True):
                        upto += x
                        if upto > share:
                            break
                    at, before = b, at
                    want.add((root, at))
        assert {(r.sg, r.idx) for r in S.walks(roots, e, 5, 2, 1, p, q).collect()} == want


def test_cells_meet_every_node(spark, monkeypatch):

    monkeypatch.setattr(V, "BLOCK", 7)
    monkeypatch.setattr(V, "CHUNK", 3)
    x = np.random.default_rng(1).normal(size=(40, 5))
    x[7] = x[3]
    n = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "idx long, embedding array<double>")
    q = n.where("idx % 4 = 3").select(F.col("idx").alias("query"), F.col("embedding").alias("q"))
    dist = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6)
    every = {(r.query, r.idx): r.score for r in V.scores(q, n, "euclidean").collect()}
    assert len(every) == 10 * 39 and all(abs(s - dist[a, b]) < 2e-6 for (a, b), s in every.items())
    got = {}
    for r in V.near(q, n, "euclidean", 4).collect():
        got.setdefault(r.query, []).append((r["rank"], r.idx))
    assert all([i for _, i in sorted(v)] == sorted((i for i in range(40) if i != k), key=lambda i: (dist[k, i], i))[:4] for k, v in got.items()) and len(got) == 10
    gold = spark.createDataFrame([(k, (k + 1) % 40) for k in range(3, 40, 4)], "query long, gold long")
    hits = {r.query: (r.hit1, r.hit9) for r in V.hits_at(V.scores(q, n, "cosine"), gold, [1, 9]).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k, (h1, h9) in hits.items():
        order = sorted((i for i in range(40) if i != k), key=lambda i: (-round(float(unit[k] @ unit[i]), 6), i))
        assert (h1, h9) == (int((k + 1) % 40 in order[:1]), int((k + 1) % 40 in order[:9]))
