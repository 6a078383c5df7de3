"""The operators against brute force, exact round trips and held-out accuracy, and their odd inputs."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import chat, class_lm, exact_topk, language_id, licences, mixing, near_dedup, packing, permutation_index, url_filter
from tesserae.llm.common import words

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, rep long, node long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 1, 2) for i, t, lang, s in rows], DOC)


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "  \n ", "en", "a"), (None, "one two three", "en", "b"), (5, "x " * 30000, "en", "b"), (6, "one two three", None, None), (6, "one two three", None, None), (7, "Word", "de", "a")]


def shingles(text, k=2):
    w = words((text or "").encode())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            i, j = sorted((find(a), find(b)))
            root[j] = i
    return {i: find(i) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    rows = []
    for i in range(120):  # one group that is edited apart, so that links form several components
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 16), replace=False):
            w[at] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(w), None, None))
    rows += [(200 + i, " ".join(f"u{k}" for k in rng.integers(0, 300, 50)), None, None) for i in range(30)] + [(300, "Solo", None, None), (301, "sOLO", None, None), (302, None, None, None)]
    want = components({i: shingles(t) for i, t, _, _ in rows})
    got = near_dedup.near_duplicates(docs(spark, rows), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) > 35
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(rows[[x[0] for x in rows].index(r.doc_id)][1])) for r in got)


def test_stray_copies_do_not_meet_a_whole_group(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(440):  # every eleventh is edited so far that most, not all, of them are linked with none of the others
        w = [f"w{k}" for k in range(120)]
        for at in rng.choice(np.arange(1, 119, 2), 6 if i % 11 == 0 else rng.integers(3, 5), replace=False):
            w[at] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w), None, None))
    tried, verify = [], near_dedup._Links.verify

    def counted(self, pairs, tag):
        tried.append((tag, pairs.count()))
        return verify(self, pairs, tag)

    monkeypatch.setattr(near_dedup._Links, "verify", counted)
    want = components({i: shingles(t) for i, t, _, _ in rows})
    for drawn in (near_dedup.DRAWN, 1):  # the core decides about the work, not about the links
        monkeypatch.setattr(near_dedup, "DRAWN", drawn)
        tried.clear()
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows), 2).collect()} == want
        if drawn > 1:
            assert dict(tried)["settle_links"] < 10 * len(rows)


def test_one_id_with_several_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(5, a, None, None), (5, b, None, None), (7, a + " more", None, None), (9, b + " more", None, None), (3, b, None, None), (5, a, None, None), (11, "other", None, None), (11, " ", None, None)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows)).collect())
    assert got == sorted([(5, 5, True), (5, 3, False), (7, 5, False), (9, 3, False), (3, 3, True), (5, 5, True), (11, 11, True), (11, 11, True)])
    kept = near_dedup.without_near_duplicates(docs(spark, rows))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, a), (3, b), (11, "other"), (11, " ")])


def test_hub_component(spark):
    from tesserae.llm.common import Scratch
    from tesserae.llm.components import components as linked

    edges = spark.createDataFrame([(0, i) for i in range(1, 2000)] + [(i, i + 1) for i in range(5000, 5040)] + [(1, None)], "u long, v long")
    got = {r.node: r.component for r in linked(Scratch(spark), edges, "hub").collect()}
    assert got == {i: 0 for i in range(2000)} | {i: 5000 for i in range(5000, 5041)}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.concatenate([a[:360], np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))])
    s = near_dedup.sketches([a, np.sort(b), a[:1]])
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 360 / 440) < 0.15


def test_odd_documents(spark):
    d = docs(spark, ODD)
    got = {(r.doc_id, r.n_shingles): r for r in near_dedup.near_duplicates(d, 2).collect()}
    assert got[1, 0].kept and got[None, 2].component_id is None and not got[None, 2].kept and got[6, 2].component_id == 6
    assert near_dedup.without_near_duplicates(d).count() == 7  # of the repeated row one stays
    assert near_dedup.near_duplicates(d.limit(0)).count() == 0
    assert {r.doc_id: r.lang_pred for r in language_id.identify(d).collect()}[1] == "und"
    assert language_id.identify(d.limit(0)).count() == 0 and language_id.identified_only(d).columns == d.columns
    lm = class_lm.score_texts(d).collect()
    assert len(lm) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in lm)
    assert class_lm.score_texts(d.limit(0)).count() == 0
    assert packing.pack(d).agg(F.sum("n_tokens")).first()[0] == sum(len(words((t or "").encode())) + 1 for _, t, _, _ in ODD)
    assert packing.pack(d.limit(0)).count() == 0
    assert licences.scan_licences(d).count() == len(ODD) and mixing.mix(d).columns == d.columns
    assert mixing.mix(d.limit(0)).count() == 0


def test_packing_keeps_tokens_and_conflicts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(d, 512).toPandas()
    assert got.groupby("bin_id").n_tokens.sum().max() <= 512
    assert not got.duplicated(["bin_id", "source"]).any() and not got.duplicated(["bin_id", "cluster"]).any()
    want = {r.doc_id: len(words(r.text.encode())) + 1 for r in d.collect()}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == want


def plain_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for z, s, c in zip(sizes, sources, clusters, strict=True):
        fit = [(bins[b][0], b) for b in range(len(bins)) if bins[b][0] >= z and s not in bins[b][1] and c not in bins[b][2]]
        room, b = min(fit, default=(capacity, len(bins)))
        if b == len(bins):
            bins.append(None)
        out.append((b, capacity - room))
        bins[b] = (room - z, (bins[b][1] if bins[b] else set()) | {s}, (bins[b][2] if bins[b] else set()) | {c})
    return out


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(2)
    sizes = sorted((int(x) for x in rng.integers(1, 60, 300)), reverse=True)
    src, clu = ([int(x) for x in rng.integers(0, n, 300)] for n in (12, 200))
    assert packing.best_fit(sizes, src, clu, 100) == plain_best_fit(sizes, src, clu, 100)


def test_packing_against_a_plain_search(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in packing.pack(d, 512).select("doc_id", "piece", "token_start", "n_tokens", "bin_id", "bin_offset").collect())
    cluster = {r.doc_id: r.c for r in d.select("doc_id", F.xxhash64("text").alias("c")).collect()}
    pieces = []
    for r in d.collect():
        n = len(words(r.text.encode())) + 1
        pieces += [(-min(512, n - a), r.doc_id, r.source, k, a) for k, a in enumerate(range(0, n, 512))]
    pieces.sort(key=lambda p: (p[0], p[1], p[3]))
    placed = plain_best_fit([-p[0] for p in pieces], [p[2] for p in pieces], [cluster[p[1]] for p in pieces], 512)
    assert got == sorted((p[1], p[3], p[4], -p[0], b, o) for p, (b, o) in zip(pieces, placed, strict=True))


def test_packing_over_shards(spark):
    rows = [(1, "w " * 30, None, "a")] * 900 + [(i, "w " * (i % 300), None, f"s{i % 40}") for i in range(2000)]
    for shard_docs in (100, 10**6):
        got = packing.pack(docs(spark, rows), 512, shard_docs).toPandas()
        assert got.n_tokens.sum() == sum(len(t.split()) + 1 for _, t, _, _ in rows) and got.groupby("bin_id").n_tokens.sum().max() <= 512
        assert not got.duplicated(["bin_id", "source"]).any() and not got.duplicated(["bin_id", "cluster"]).any() and not got.duplicated(["bin_id", "bin_offset"]).any()


def test_language_accuracy_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) for i in got.doc_id) and (got.lang_pred == got.lang).mean() > 0.97
    assert language_id.identified_only(d).count() > 0.99 * d.count()


def test_viterbi_finds_spans():
    s = np.array([[3, 0]] * 5 + [[0, 1]] + [[3, 0]] * 3 + [[0, 3]] * 6, np.float32)
    assert language_id.viterbi(s, np.array([0]), np.array([len(s)]), 4.0).tolist() == [0] * 9 + [1] * 6
    found = language_id.spans_of(np.array([0, 0, 1, 1, 1, 0]), np.array([3, 0, 3]))
    assert list(zip(*(x.tolist() for x in found), strict=True)) == [(0, 0, 0, 2), (0, 1, 2, 1), (2, 1, 0, 2), (2, 0, 2, 1)]
    assert language_id.script("«Привет".encode()) == "Cyrillic" and language_id.script("été".encode()) == ""


def test_language_against_a_plain_viterbi(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs(spark, [(9001, "Le chat dort. Der Hund und die Katze schlafen heute nicht mehr", None, None), (9002, "123 !", None, None), (9003, "Привет мир the end", None, None)])
    model = language_id.fit(d.where(language_id.fold(F.col("doc_id")) != 0))
    langs = model.langs

    def scores_of(word):
        b = b" " + word + b" "
        total = np.zeros(len(langs))
        for order, table in zip(language_id.ORDERS, model.tables, strict=True):
            grams = language_id.buckets(np.frombuffer(b, np.uint8), np.array([c in b" \n\t\r\x0b\x0c" for c in b]))[language_id.ORDERS.index(order)]
            total += sum(table[g].astype(float) for g in grams[: len(b) - 1])
        out = np.clip(total * language_id.SCALE, -language_id.CUT, language_id.CUT)
        if not any(ch.isalpha() for ch in word.decode()):
            return np.zeros(len(langs))
        own = model.scripts.get(language_id.script(word))
        if own is not None and own.any() and any(ch.isalpha() and ord(ch) > 0x36F for ch in word.decode()):
            out = out - np.where(own, 0, language_id.FOREIGN)
        return out

    every = d.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    got = {r.doc_id: r for r in language_id.identify(every).collect()}
    assert got[9002].lang_pred == "und" and got[9002].spans == []
    agree, of = 0, 0
    for r in every.where("length(text) < 4000").collect():
        w = r.text.lower().encode().split()
        if got[r.doc_id].lang_pred == "und":
            continue
        best, back = scores_of(w[0]), []
        for x in w[1:]:
            top = int(best.argmax())
            stay = best >= best[top] - language_id.SWITCH
            back.append(np.where(stay, np.arange(len(langs)), top))
            best = np.where(stay, best, best[top] - language_id.SWITCH) + scores_of(x)
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        want = [(langs[k], len(list(g))) for k, g in itertools.groupby(path[::-1])]
        agree += [(s.lang, s.n_words) for s in got[r.doc_id].spans] == want
        of += 1
    assert of >= 100 and agree >= 0.98 * of  # sums of single and of double precision can differ at a tie


def test_class_lm_against_plain_sums(spark):
    """Scores, class counts and perplexity from the learned classes alone, in plain Python."""
    rng = np.random.default_rng(6)
    some = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, int(rng.integers(0, 60))) if k < 10**6) for _ in range(300)]
    rows = [(i, t, None, None) for i, t in enumerate(some)] + [(400, None, None, None), (None, "w1 w2 never-seen-twice", None, None), (7, some[7], None, None)]
    old, class_lm.HOT = class_lm.HOT, 60  # most words are without a number here
    try:
        m = class_lm.ClassModel(docs(spark, rows), 0.9)
        got = class_lm.scored(m).collect()
        cls = {w: (int(n), int(c)) for w, n, c in zip(m.names, m.times[1:], m.of[1:-1], strict=True)} | {bytes(r.word): (r.n, r.c) for r in m.rare.collect()}
    finally:
        class_lm.HOT = old
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [words((t or "").encode()) for i, t, _, _ in rows if not held(i)]
    count = Counter(x for w in train for x in w)
    assert {w: n for w, (n, _) in cls.items()} == count and len(m.names) <= 60 < len(count)
    end, unseen = m.classes, m.kinds - 1
    seq = lambda w: [end, *(cls[x][1] if x in cls else unseen for x in w), end]
    pairs = Counter(p for w in train for p in itertools.pairwise(seq(w)))
    n, types = sum(count.values()) + len(train), len(count) + 1
    in_class, of_class = Counter({end: len(train)}), Counter({end: 1, unseen: 1})
    for k, c in cls.values():
        in_class[c] += k
        of_class[c] += 1
    room = {c: in_class[c] + 0.5 * of_class[c] for c in range(m.kinds)}
    after = Counter(a for a, b in pairs.elements())

    def score(w):
        s = seq(w)
        total = 0.0
        for (a, b), k in zip(itertools.pairwise(s), [*(count[x] for x in w), len(train)], strict=True):
            p = (pairs[a, b] + class_lm.BACKOFF * room[b] / sum(room.values())) / (after[a] + class_lm.BACKOFF)
            total += math.log10(0.9 * p * (k + 0.5) / max(room[b], 0.5) + 0.1 * (k + 0.5) / (n + 0.5 * (types + 1)))
        return total

    want = sorted((str(i), round(score(words((t or "").encode())), 6)) for i, t, _, _ in rows)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)
    assert all(b >= a for a, b in itertools.pairwise(m.rounds[:-1]))


def test_class_lm_counts_and_beats_single_words(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = class_lm.score_texts(d).toPandas()
    count, n = Counter(), 0
    for r in d.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            w = words(r.text.encode())
            count.update(w)
            count[None] += 1
            n += len(w) + 1
    whole = n + 0.5 * (len(count) + 1)
    texts = {r.doc_id: [*words(r.text.encode()), None] for r in d.collect()}
    for r in got.itertuples():
        w = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert abs(r.base_score - sum(math.log10((count[x] + 0.5) / whole) for x in w)) < 1e-6 * len(w)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(3)
    v = 42
    of = np.arange(v) % 2
    p = np.array([[200.0 if of[a] != of[b] else 2.0 for b in range(v)] for a in range(v)]) * rng.uniform(0.8, 1.2, (v, v))
    found = class_lm.exchange(np.floor(p), 2)[1:-1]
    assert len(set(zip(found.tolist(), of[1:-1].tolist(), strict=True))) == 2


VEC = "vec_id long, embedding array<double>, label int, v int, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 0, 1, 2) for i, x in rows], VEC)


def test_exact_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12)) * rng.uniform(0.1, 3, (300, 1))
    x[10:20] = x[9]
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 12), (1003, []), (None, [1.0] * 12)]
    e = vectors(spark, rows)
    got = exact_topk.exact_top_k(e, e.where("vec_id % 10 = 0"), 5).collect()
    w = {i: np.floor(256 * np.array(r)) for i, r in rows[:300]} | {1003: np.zeros(12)}
    want = [(q, k + 1, i, s) for q in w if q % 10 == 0 for k, (s, i) in enumerate((-a, b) for a, b in sorted((-int(w[q] @ w[i]), i) for i in w if i != q)[:5])]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert exact_topk.exact_top_k(e.limit(0), e, 5).count() == 0
    twice = vectors(spark, [(1, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])])
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.exact_top_k(twice, twice.where("vec_id = 2"), 5).collect()] == [(2, 1, 3, 131072), (2, 2, 1, 65536)]
    with pytest.raises(ValueError):
        exact_topk.exact_top_k(vectors(spark, [(1, [1e6]), (2, [1e6])]), vectors(spark, [(1, [1e6])]), 5)


def test_exact_topk_of_unequal_lengths_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 50)
    monkeypatch.setattr(exact_topk, "CHUNK", 20)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(600, 6)) * np.exp(rng.normal(size=(600, 1)) * 2)
    e = vectors(spark, [(i, r.tolist()) for i, r in enumerate(x)])
    w = np.floor(256 * x)
    got = exact_topk.exact_top_k(e, e.where("vec_id % 7 = 0"), 3).collect()
    want = [(q, k + 1, i, s) for q in range(0, 600, 7) for k, (s, i) in enumerate((-a, b) for a, b in sorted((-int(w[q] @ w[i]), i) for i in range(600) if i != q)[:3])]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_permutation_index_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(9000, [0.0] * 16), (9020, None), (9040, [float("inf")] * 16)]
    e = vectors(spark, rows)
    got = permutation_index.nearest(e, e.where("vec_id % 20 = 0"), 20).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 20)) and (got.groupby("query_id").size() == 20).all()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
        assert np.allclose(g.score, x[g.vec_id] @ x[q], rtol=1e-12, atol=1e-12)
    assert hit >= 0.9 * len(got)
    few = vectors(spark, [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (20, [1.0, 1.0]), (3, [0.0, 2.0]), (None, [1.0, 1.0])])
    found = permutation_index.nearest(few, few.where("vec_id % 20 = 0"), 20).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.5)]
    assert permutation_index.nearest(few.limit(0), few, 20).count() == 0 == permutation_index.nearest(few, few.limit(0), 20).count()


def test_permutation_index_recall_beside_a_crowd_of_near_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x[:1000] = x[0] + 0.02 * rng.normal(size=(1000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[2000:2100] = x[2000]  # exact copies: the smaller ids come first
    e = vectors(spark, [(i, r.tolist()) for i, r in enumerate(x)])
    got = permutation_index.nearest(e, e.where("vec_id % 20 = 0"), 20, 0.15).toPandas().groupby("query_id").vec_id.apply(list)
    assert got[2040] == list(range(2000, 2020))
    lone = [q for q in range(1000, 3000, 20) if not 2000 <= q < 2100]
    best = {q: set(np.lexsort((np.arange(3000), -np.where(np.arange(3000) == q, -9, x @ x[q])))[:20]) for q in lone}
    assert sum(len(best[q] & set(got[q])) for q in lone) >= 0.9 * 20 * len(lone)


def test_spread_pivots_differ():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(50, 4))
    assert len(np.unique(permutation_index.spread(np.concatenate([a, a, a[:1].repeat(99, 0)]), 60), axis=0)) == 50


def test_url_rules_and_parts(spark):
    urls = ["http://a.Example.NET/en/1", "http://example.net/de/", "http://x.example.com/de/3?q", "https://w.org/fr/#x", "http://fakenet/", "http://a.net", None, "no scheme", "s://H?/a", "http://example.net/en/1"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, html string, template string")
    labels = spark.createDataFrame([(0, 1)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1][2:] == ("net/", "block")
    assert got[2] == ("x.example.com", "/de/3", "example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4][2] is None and got[5][1:3] == ("", None) and got[6][:2] == ("", "") and got[7][:2] == ("", "") and got[8][:2] == ("h", "")
    assert url_filter.judge(pages.limit(0), labels.limit(0)).count() == 0


def test_url_templates_split_bad_branches(spark):
    pages = [(i, f"http://h.test/{'bad' if i % 4 == 0 else 'good'}/{i}") for i in range(400)] + [(1000 + i, f"http://h.test/bad/new{i}") for i in range(5)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge(p, labels).collect()}
    assert got[1002].template == "/bad/*" and got[1002].verdict == "block" and got[1].verdict == "allow"


def plain_templates(pages, bad):
    """(host, path) -> (template, purity) by a walk over dicts; pages: page_id -> (host, path); bad: page_id -> 0 or 1."""
    U = url_filter
    rows = [(h, p.removeprefix("/").split("/") if p else [], [], bad.get(i), i) for i, (h, p) in pages.items()]
    depth = 0
    while True:
        nodes = {}
        for r in rows:
            if len(r[1]) > depth:
                nodes.setdefault((r[0], tuple(r[2])), []).append(r)
        if not any(len(v) >= U.RARE for v in nodes.values()):
            break
        for inside in nodes.values():
            kids = {}
            for r in inside:
                n, b, n_l = kids.get(r[1][depth], (0, 0, 0))
                kids[r[1][depth]] = (n + 1, b + (r[3] or 0), n_l + (r[3] is not None))
            token = {}
            if not (len(kids) > U.MANY and len(inside) < U.DENSE * len(kids)):
                rate = (sum(b for _, b, _ in kids.values()) + 1) / (sum(x for _, _, x in kids.values()) + 2)
                steps = {}
                for seg, (n, b, n_l) in kids.items():
                    if n >= U.RARE:
                        steps.setdefault(math.floor((b + U.PSEUDO * rate) / (n_l + U.PSEUDO) * U.STEPS), []).append((seg, b, n_l))
                branches, last = [], None
                for k in sorted(steps):
                    b, n_l = sum(x[1] for x in steps[k]), sum(x[2] for x in steps[k])
                    if last is not None and b * last[1] - last[0] * n_l:
                        p = (b + last[0] + 1) / (n_l + last[1] + 2)
                        new = abs(b * last[1] - last[0] * n_l) > U.Z * math.sqrt(p * (1 - p) * (n_l + last[1]) * n_l * last[1])
                    else:
                        new = last is None
                    if new:
                        branches.append([])
                    branches[-1] += [x[0] for x in steps[k]]
                    last = (b, n_l)
                for number, segs in enumerate(branches):
                    token |= {seg: f"~{number}" if len(segs) > 1 else seg for seg in segs}
            for r in inside:
                r[2].append(token.get(r[1][depth], "*"))
        depth += 1
    out = {i: (h, "".join("/" + x for x in t + ["*"] * (len(parts) - len(t)))) for h, parts, t, _, i in rows}
    per, hosts, all_ = {}, {}, [0, 0]
    for h, _, _, b, i in rows:
        for sums in (per.setdefault(out[i], [0, 0]), hosts.setdefault(h, [0, 0]), all_):
            sums[0] += b or 0
            sums[1] += b is not None
    smooth = lambda x, to: (x[0] + U.PSEUDO * to) / (x[1] + U.PSEUDO)
    prior = (all_[0] + 1) / (all_[1] + 2)
    return {i: (t, smooth(per[h, t], smooth(hosts[h], prior))) for i, (h, t) in out.items()}


@pytest.mark.parametrize("small", [True, False])
def test_url_templates_against_a_plain_walk(spark, monkeypatch, small):
    from tesserae.llm import queries

    if not small:
        monkeypatch.setattr(url_filter, "SMALL", 3)  # lookups by salted keys
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: int(r.quality == 0 or r.toxic == 1) for r in spark.read.parquet(f"{sf}/labels.parquet").where("doc_id is not null").collect()}
    got = {r.page_id: r for r in queries.op6_url_filter(spark, sf).collect()}
    number = lambda path: next((int(x.split(".")[0]) for x in reversed(path.split("/")) if x.split(".")[0].isdigit()), None)
    bad = {i: labels[number(r.path)] for i, r in got.items() if number(r.path) in labels}
    want = plain_templates({i: (r.host, r.path) for i, r in got.items()}, bad)
    assert len(bad) > 20
    assert {i: (r.template, round(r.purity, 9)) for i, r in got.items()} == {i: (t, round(p, 9)) for i, (t, p) in want.items()}
    assert all(r.verdict == ("block" if r.purity >= url_filter.REJECT else "allow") for r in got.values() if r.rule is None)


def test_url_branches_merge_with_each_other(spark):
    rng = np.random.default_rng(12)
    share = {"a": 0.9, "b": 0.9, "c": 0.05, "d": 0.05, "e": 0.5}
    pages = [(k * 1000 + i, f"http://h.test/{s}/x{i}") for k, s in enumerate(share) for i in range(200)]
    labels = [(k * 1000 + i, int(rng.random() < p)) for k, p in enumerate(share.values()) for i in range(200)]
    rows = spark.createDataFrame([*pages, *[(None, "http://h.test/a/q")] * 50, *[(1, "http://h.test/a/x1")] * 3], "page_id long, url string")
    got = url_filter.judge(rows, spark.createDataFrame([*labels, (1, 0), (1, 1)], "page_id long, bad int"))
    token = {r.path.split("/")[1]: r.template.split("/")[1] for r in got.collect()}
    assert token == {"a": "~2", "b": "~2", "c": "~0", "d": "~0", "e": "e"} and got.count() == rows.count()


def test_url_label_is_of_the_path(spark, tmp_path):
    from tesserae.llm import queries

    spark.createDataFrame([(1, "http://127.0.0.1/en/5"), (2, "http://a.test/9/x/7.html?id=3"), (3, "http://a.test/none")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(127, 0, 1), (5, 1, 0), (7, 0, 0), (9, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r.purity for r in queries.op6_url_filter(spark, str(tmp_path)).collect()}
    assert got[2] > got[3] > got[1]


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a </turn> ### b \\"), (1, 1, "assistant", "<turn>### User: hi\n"), (2, 0, "assistant", None), (2, 1, None, 'x": '), (2, 1, "to\"ol: ", "y"), (None, 0, "user", ""), (3, 0, "user", "z" * 100000)]
    c = chat.with_planted(spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, seq int"))
    f = chat.format_chats(c)
    t = chat.Template()
    got = sorted(((r.conv_id, *t.parsed(r.segment)) for r in f.collect()), key=repr)
    assert got == sorted([(a, role, text or "") for a, _, role, text in rows] + [(-7, "user", chat.PLANTED), (-7, "assistant", chat.PLANTED)], key=repr)
    d = {r.conv_id: r for r in chat.digests(f).collect()}
    assert d[1].valid and not d[2].valid and d[-7].loss_chars == len(chat.PLANTED)
    assert chat.digests(chat.format_chats(c.limit(0))).count() == 0


def test_mixing_meets_budgets_and_limit(spark):
    rows = [(i, "w " * (1 + i % 7), None, "big" if i % 10 else "small") for i in range(4000)]
    d = docs(spark, rows)
    got = mixing.mixed_epochs(d, repetition=2.0, block_docs=64).toPandas()
    n = Counter()
    for _, t, _, s in rows:
        n[s] += len(t.split()) + 1
    used = got.groupby("source")._tokens.sum()
    assert used["small"] <= 2 * n["small"] and used["small"] > 1.98 * n["small"]
    total = sum(n.values())
    low, high = 0.0, 1.0
    for _ in range(60):
        t = (low + high) / 2
        z = sum((v / total) ** t for v in n.values())
        low, high = (low, t) if max((v / total) ** (t - 1) for v in n.values()) / z <= 2 else (t, high)
    z = sum((v / total) ** high for v in n.values())
    for s, v in n.items():
        goal = total * (v / total) ** high / z
        assert goal - 20 <= used[s] <= goal + 20
    assert got.groupby("doc_id").size().max() <= 3
    entropy = mixing.exponent(spark.createDataFrame([(0.9,), (0.1,)], "share double"), 1.0, None, 0.5)
    p = np.array([0.9, 0.1]) ** entropy
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 0.5) < 1e-4


def test_licences_against_all_windows(spark):
    notice = licences.TEMPLATES["Apache-2.0"][1]
    texts = ["foo " + notice.replace("express or implied", "explicit or implied") + " bar", "Released under the MIT License.\nx", "licensed under cc by-nc 4.0", "nothing here", "This work is licensed under the GNU General Public License, version 3."]
    texts += [licences.TEMPLATES["AGPL-3.0"][1], "a " + licences.TEMPLATES["BSD-2-Clause"][1] + " THIS SOFTWARE IS PROVIDED " + "as is " * 20, licences.TEMPLATES["BSD-3-Clause"][1], licences.TEMPLATES["LGPL-2.1"][1] + " and " + licences.TEMPLATES["GPL-2.0"][0], "", None]
    got = {r.doc_id: r for r in licences.scan_licences(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        w, best = licences.normalised((t or "").encode()), {}
        for name, ts in licences.TEMPLATES.items():
            for x in ts:
                m = licences.normalised(x.encode())
                size = min(len(m), len(w))
                for at in range(len(w) - size + 1 if size > 1 else 0):
                    a, b = licences._bigrams(w[at : at + size]), licences._bigrams(m)
                    dice = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
                    best[name] = min(best.get(name, (0, 0, 0)), (-dice, at, size))
        want = []
        for name, (dice, at, size) in sorted(best.items(), key=lambda x: (x[1][0], -x[1][2], x[0])):
            if -dice >= 0.9 and all(at + size <= a or a + n <= at for _, _, a, n in want):
                want.append((name, -dice, at, size))
        assert [(m.licence, pytest.approx(m.dice), m.first_word, m.n_words) for m in got[i].matches] == want
    assert [got[i].licence for i in range(5, 11)] == ["AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "LGPL-2.1", None, None]
    assert got[10].dice == 0 and licences.scan_licences(docs(spark, [])).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    now = d
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != "packing":
            assert out.columns == d.columns
        if name == "near_dedup":
            want = components({r.doc_id: shingles(r.text, 5) for r in now.collect()})
            assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))
        if name == "source_mix":
            out = spark.createDataFrame(out.collect(), out.schema)
        now = out
    assert now.count() > 0 and not now.toPandas().duplicated(["bin_id", "source"]).any()


CLASHING = ["n", "rest", "blocks", "goal", "whole", "place", "end_block", "end_place", "end_inside", "row", "src", "tokens", "print", "at", "id", "kept", "node", "shard", "used", "seg", "_epoch", "_block", "_position", "_tokens"]


def test_pipeline_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    wide = d.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    now = wide
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != "packing":
            assert out.columns == wide.columns
            rows = out.collect()
            assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHING)
            now = spark.createDataFrame(rows, out.schema)
        else:
            assert out.count() > 0
    assert set(mixing.mixed_epochs(wide).columns) == {*wide.columns}


def test_pipeline_stages_take_odd_documents(spark):
    import corpus_pipeline

    for rows in (ODD, []):
        now = docs(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            assert name == "packing" or out.columns == now.columns
            now = spark.createDataFrame(out.collect(), out.schema)
