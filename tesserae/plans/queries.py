"""Named queries over the synthetic tables, each with DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import PRELUDE, edges, nodes, seeds, table
from ..functions import text as T
from ..operators import answers as A
from ..operators import expand as X
from ..operators import gnn as N
from ..operators import graph as G
from ..operators import resolve as J
from ..operators import sampling as M
from ..operators import search as V
from ..operators import sketch as H
from ..operators import subgraph as S
from ..operators.numbering import numbered
from ..scratch import materialised
from ..sources import code as P
from ..sources import records as R
from .build import repo_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True):
    """Registers a query under its function's name; ``sql`` follows the prelude's CTEs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (PRELUDE + sql) if prelude else sql
        return f

    return add


def _seed_queries(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).where("idx % 50 = 0").select(F.col("idx").alias("query"), F.col("embedding").alias("q"))


KNN_SQL = """, r as (select a.idx as query, b.idx as idx, round({value}, 6) as score from nodes a join nodes b on a.idx <> b.idx where a.idx % 50 = 0)
select query, idx, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query order by score {order}, idx) as rank from r) where rank <= 8"""


@query(KNN_SQL.format(value="list_distance(a.v, b.v)", order="asc"))
def knn_euclidean_topk(s, d):
    return V.near(_seed_queries(s, d), nodes(s, d), "euclidean", 8)


@query(KNN_SQL.format(value="list_cosine_similarity(a.v, b.v)", order="desc"))
def knn_cosine_topk(s, d):
    return V.near(_seed_queries(s, d), nodes(s, d), "cosine", 8)


@query(", r as (select a.idx as query, b.idx as idx, b.label from nodes a join nodes b on a.label = b.label and a.file_id = b.file_id where a.idx % 50 = 0) select query, idx from r")
def seeded_search(s, d):
    """Given seeds in place of a search: nodes of the query's file and label."""
    n = nodes(s, d).select("idx", "label", "file_id")
    return n.join(n.where("idx % 50 = 0").withColumnRenamed("idx", "query"), ["label", "file_id"]).select("query", "idx")


@query(KNN_SQL.format(value="list_distance(a.v, b.v)", order="asc").replace("select query, idx, score, cast(rank as integer) as rank from (", ", kn as (select query, idx, score from (") + """), nb as (select query, n.label as token, exp(min(score) over (partition by query) - score) as e from kn join nodes n using (idx)),
pk as (select query, token, sum(e) / any_value(t) as p from (select *, sum(e) over (partition by query) as t from nb) group by query, token), lm as (select q.idx as query, l.label as token, l.p from seeds q, (select label, count(*) / (select count(*) from nodes) as p from nodes group by label) l)
select lm.query, lm.token, round(0.25 * coalesce(pk.p, 0) + 0.75 * lm.p, 6) as p from lm left join pk on pk.query = lm.query and pk.token = lm.token""")
def knn_lm_interpolation(s, d):
    """Labels as tokens: their shares are the language model, the nearest nodes' labels the datastore."""
    n = nodes(s, d)
    near = V.near(_seed_queries(s, d), n, "euclidean", 8).join(n.select("idx", F.col("label").alias("token")), "idx").select("query", "token", F.col("score").alias("dist"))
    per = n.groupBy(F.col("label").alias("token")).agg(F.count("*").alias("n"))
    share = per.join(per.agg(F.sum("n").alias("total"))).select(F.collect_list(F.struct("token", (F.col("n") / F.col("total")).alias("p"))).over(Window.partitionBy(F.lit(0))).alias("share")).limit(1)
    lm = seeds(s, d).select(F.col("idx").alias("query")).join(F.broadcast(share)).select("query", F.inline("share"))
    return V.knn_lm(lm, near).withColumn("p", F.round("p", 6))


COS = ", sc as (select a.idx as query, b.idx as idx, a.label as ql, b.label as bl, round(list_cosine_similarity(a.v, b.v), 6) as score from nodes a join nodes b on a.idx <> b.idx where a.idx % 50 = 0)"


def _cos(s, d):
    return V.scores(_seed_queries(s, d), nodes(s, d), "cosine")


@query(COS + ", z as (select *, score / 0.01 - max(score / 0.01) over (partition by query) as z from sc) select query, idx, score, round(z - ln(sum(exp(z)) over (partition by query)), 4) as logp from z")
def cosine_scores_softmax(s, d):
    return V.log_softmax(_cos(s, d)).withColumn("logp", F.round("logp", 4))


GOLD = ", gold as (select a.idx as query, min(b.idx) as gold from nodes a join nodes b on a.label = b.label and a.idx <> b.idx where a.idx % 50 = 0 group by a.idx)"


def _gold(s, d):
    n = nodes(s, d).select("idx", "label")
    return n.join(n.where("idx % 50 = 0").select(F.col("idx").alias("query"), "label"), "label").where("idx <> query").groupBy("query").agg(F.min("idx").alias("gold"))


@query(COS + GOLD + ", z as (select *, score / 0.01 - max(score / 0.01) over (partition by query) as z from sc), p as (select query, idx, z - ln(sum(exp(z)) over (partition by query)) as logp from z) select query, round(-logp, 4) as nll from p join gold using (query) where idx = gold")
def nll_loss(s, d):
    return V.log_softmax(_cos(s, d)).join(_gold(s, d), "query").where("idx = gold").select("query", F.round(-F.col("logp"), 4).alias("nll"))


HITS = ", rk as (select *, row_number() over (partition by query order by score desc, idx) as r from sc{where}), h as (select query, " + ", ".join(f"max(cast(idx = gold and r <= {k} as int)) as hit{k}" for k in (1, 3, 10, 30, 50)) + " from rk join gold using (query) group by query)"
KS = [1, 3, 10, 30, 50]


@query(COS + GOLD + HITS.format(where="") + " select * from h")
def topk_accuracy(s, d):
    return V.hits_at(_cos(s, d), _gold(s, d), KS)


@query(COS + GOLD + HITS.format(where=" where ql = bl") + " select * from h")
def topk_accuracy_imports(s, d):
    lab = nodes(s, d).select("idx", "label")
    same = _cos(s, d).join(lab.withColumnRenamed("label", "bl"), "idx").join(lab.select(F.col("idx").alias("query"), F.col("label").alias("ql")), "query").where("ql = bl")
    return V.hits_at(same, _gold(s, d), KS)


@query(COS + GOLD + HITS.format(where="") + ", b as (select cast(floor(query / 50) as bigint) // 4 as batch, avg(hit50) as acc from h group by 1) select round(avg(acc), 6) as batch_mean, (select round(avg(hit50), 6) from h) as plain from b")
def accuracy_batch_mean(s, d):
    h = V.hits_at(_cos(s, d), _gold(s, d), [50]).withColumn("batch", F.floor(F.col("query") / 200))
    return h.groupBy("batch").agg(F.avg("hit50").alias("acc"), F.sum("hit50").alias("hits"), F.count("*").alias("n")).agg(F.round(F.avg("acc"), 6).alias("batch_mean"), F.round(F.sum("hits") / F.sum("n"), 6).alias("plain"))


@query(COS + ", rk as (select query, idx, row_number() over (partition by query order by score desc, idx) as r from sc where ql = bl), m as (select query, least(max(r), 10) as m from rk group by query), w as (select query, unnest(range(1, 11)) as place, m from m) select w.query, cast(place as int) as place, idx from w join rk on rk.query = w.query and rk.r = (place - 1) % m + 1")
def rerank_pad_contexts(s, d):
    lab = nodes(s, d).select("idx", "label")
    same = _cos(s, d).join(lab.withColumnRenamed("label", "bl"), "idx").join(lab.select(F.col("idx").alias("query"), F.col("label").alias("ql")), "query").where("ql = bl").select("query", "idx", "score")
    return V.pad_by_cycling(V.top_k(same, 10, False), 10)


@query("select source, list(doc_id order by n_chars desc, doc_id)[1:5] as top from documents group by source", False)
def passages_sorted_topn(s, d):
    """The five longest passages of every source, in order."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    best = table(s, d, "documents").select("source", "doc_id", "n_chars").withColumn("r", F.row_number().over(w)).where("r <= 5")
    return best.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"]).alias("top"))


BFS = ", bfs(center, idx, hop) as (select idx, idx, 0 from seeds union select b.center, u.b, b.hop + 1 from bfs b join und u on u.a = b.idx where b.hop < {r}), near as (select center, idx, min(hop) as hop from bfs group by center, idx)"


@query(BFS.format(r=4) + " select * from near")
def bfs_radius(s, d):
    return X.bfs(seeds(s, d), edges(s, d), 4)


@query(BFS.format(r=4) + " select center, idx, hop from (select *, row_number() over (partition by center order by hop, idx) as rn from near) where rn <= 250")
def bfs_radius_capped(s, d):
    return X.bfs(seeds(s, d), edges(s, d), 4, 250)


@query(BFS.format(r=2) + " select idx from near union select idx from nodes where idx % 97 = 0")
def bfs_union_external(s, d):
    return X.bfs(seeds(s, d), edges(s, d), 2).select("idx").union(nodes(s, d).where("idx % 97 = 0").select("idx")).distinct()


PATHS = ", st as (select src as a, dst as b, etype from edges union all select dst, src, etype from edges), paths(center, path, types, n) as (select idx, [idx], '', 0 from seeds union all select p.center, list_append(p.path, s.b), p.types || s.etype, p.n + 1 from paths p join st s on s.a = p.path[len(p.path)] where p.n < {n} and not list_contains(p.path, s.b))"
PATTERN_ROWS = ", pat(node_type, pattern) as (values " + ", ".join(f"({t}, '{p}')" for t, ps in X.PATTERNS.items() for p in sorted(set(ps))) + ")"


@query(PATHS.format(n=4) + " select center, path, types from paths")
def simple_paths(s, d):
    return X.simple_paths(seeds(s, d), edges(s, d), 4)


@query(PATHS.format(n=4) + PATTERN_ROWS + " select distinct center, unnest(path) as idx from paths join nodes on nodes.idx = center join pat on pat.node_type = nodes.node_type and pat.pattern = types where n > 0")
def pattern_expand_intended(s, d):
    return X.pattern_expand(seeds(s, d), nodes(s, d), edges(s, d), 4, "intended")


@query(PATHS.format(n=4) + PATTERN_ROWS + " select distinct center, unnest(path) as idx from paths join nodes on nodes.idx = center join pat on pat.node_type = nodes.node_type and pat.pattern = right(types, 1) where n > 0")
def pattern_expand_as_coded(s, d):
    return X.pattern_expand(seeds(s, d), nodes(s, d), edges(s, d), 4, "last_edge")


def _members(s, d, radius=1):
    return X.bfs(seeds(s, d), edges(s, d), radius).select(F.col("center").alias("sg"), "idx")


MEM = BFS.format(r=1) + ", mem as (select center as sg, idx from near), ren as (select sg, idx, row_number() over (partition by sg order by idx) - 1 as new from mem)"
RE = MEM + ", re as (select x.sg, x.new as new_src, y.new as new_dst, e.etype from edges e join ren x on x.idx = e.src join ren y on y.sg = x.sg and y.idx = e.dst)"


@query(MEM + " select x.sg, e.src, e.dst, e.etype from edges e join mem x on x.idx = e.src join mem y on y.sg = x.sg and y.idx = e.dst")
def induced_subgraph(s, d):
    return S.induced(_members(s, d), edges(s, d))


@query(RE + " select * from re")
def renumbered_subgraph(s, d):
    return S.renumbered_edges(_members(s, d), edges(s, d))


@query(RE + ", m as (select sg, count(*) as m from mem group by sg) select sg, new_src as src, new_dst as dst, etype from re union all select m.sg, new, m, 3 from m join ren on ren.sg = m.sg and ren.idx = m.sg union all select m.sg, m, new, 1 from m join ren on ren.sg = m.sg where idx % 3 = 0")
def append_query_node(s, d):
    mem = _members(s, d)
    ren = S.renumbered(mem).select("sg", F.col("new").alias("n"), "idx")
    inside = S.renumbered_edges(mem, edges(s, d)).select("sg", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "etype")
    return G.with_query_node(mem, inside, ren.where("idx = sg").select("sg", F.col("n").alias("idx")), ren.where("idx % 3 = 0").select("sg", F.col("n").alias("idx")))


COVER = BFS.format(r=2) + GOLD + ", per as (select g.query, g.query % 100 as repo, (select count(*) from near n where n.center = g.query) as reached, exists(select 1 from near n where n.center = g.query and n.idx = g.gold) as hit from gold g)"


def _cover(s, d):
    near = X.bfs(seeds(s, d), edges(s, d), 2)
    size = near.groupBy(F.col("center").alias("query")).agg(F.count("*").alias("reached"))
    hit = near.select(F.col("center").alias("query"), F.col("idx").alias("gold")).withColumn("hit", F.lit(True))
    return _gold(s, d).join(size, "query").join(hit, ["query", "gold"], "left").fillna({"hit": False})


@query(COVER + " select repo, count(*) as samples, count(*) filter (where hit) as hits, count(*) filter (where not hit) as misses, round(sum(reached / (select count(*) from nodes)) / count(*), 6) as cover from per group by rollup(repo)")
def cover_ratio_recall(s, d):
    n = nodes(s, d).count()
    per = _cover(s, d).withColumn("repo", F.col("query") % 100)
    return per.rollup("repo").agg(F.count("*").alias("samples"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.sum(F.col("reached") / n) / F.count("*"), 6).alias("cover"))


@query(COS + GOLD + ", top as (select query, idx from (select *, row_number() over (partition by query order by score desc, idx) as r from sc) where r <= 8), ex(query, idx, hop) as (select query, idx, 0 from top union select e.query, u.b, e.hop + 1 from ex e join und u on u.a = e.idx where e.hop < 1), mem as (select distinct query, idx from ex) select m.query, cast(count(*) as bigint) as members, (select count(*) from edges e join mem x on x.idx = e.src and x.query = m.query join mem y on y.idx = e.dst and y.query = m.query) as inside, max(cast(m.idx = g.gold as int)) as hit from mem m join gold g on g.query = m.query group by m.query")
def flagship_search_expand_label(s, d):
    """Search, expand, induce, label: for each seed the size of its retrieved subgraph and whether gold is inside."""
    e = edges(s, d)
    top = V.near(_seed_queries(s, d), nodes(s, d), "cosine", 8).select("query", "idx")
    mem = X.hops(top, X.undirected(e), 1, "query").select(F.col("query").alias("sg"), "idx").distinct()
    inside = S.induced(mem, e).groupBy("sg").agg(F.count("*").alias("inside"))
    lab = mem.join(_gold(s, d).withColumnRenamed("query", "sg"), "sg").groupBy("sg").agg(F.count("*").alias("members"), F.max((F.col("idx") == F.col("gold")).cast("int")).alias("hit"))
    return lab.join(inside, "sg", "left").select(F.col("sg").alias("query"), "members", F.coalesce("inside", F.lit(0)).cast("long").alias("inside"), "hit")


ANC = ", up(sg, idx, hop) as (select idx, idx, 0 from seeds union select u.sg, e.src, u.hop + 1 from up u join edges e on e.dst = u.idx where u.hop < 2), anc as (select sg, idx, min(hop) as hop from up group by sg, idx)"


def _anc(s, d):
    return S.ancestors(seeds(s, d), edges(s, d), 2)


@query(ANC + " select * from anc")
def khop_subgraphs(s, d):
    return _anc(s, d)


@query(ANC + " select sg, hop, count(*) as n from anc group by sg, hop")
def khop_hop_indicator(s, d):
    return _anc(s, d).groupBy("sg", "hop").agg(F.count("*").alias("n"))


@query(ANC + " select x.sg, e.src, e.dst, e.etype from edges e join anc x on x.idx = e.src join anc y on y.sg = x.sg and y.idx = e.dst")
def subgraph_edges(s, d):
    return S.induced(_anc(s, d).select("sg", "idx"), edges(s, d))


@query(ANC + " select sg, idx, row_number() over (order by sg, idx) - 1 as cid from anc")
def combined_subgraphs(s, d):
    return S.combined(_anc(s, d).select("sg", "idx"))


@query(ANC + ", k as (select distinct sg, dense_rank() over (order by sg) - 1 as new from anc where sg % 100 = 0) select k.new as sg, idx from anc join k using (sg)")
def select_relabel_subgraphs(s, d):
    keep = _anc(s, d).where("sg % 100 = 0").select("sg", "idx")
    new = numbered(keep.select("sg").distinct(), "sg", name="new")
    return keep.join(new, "sg").select(F.col("new").alias("sg"), "idx")


@query(", down(idx, hop) as (select idx, 0 from seeds where idx % 100 = 0 union select e.dst, h.hop + 1 from down h join edges e on e.src = h.idx where h.hop < 40) select idx, min(hop) as hop from down group by idx")
def hops_to_selected(s, d):
    return S.hop_labels(seeds(s, d).where("idx % 100 = 0"), edges(s, d))


def _walk_sql(length: int, repeats: int) -> str:
    out = ", e as (select distinct src as a, dst as b from edges), st as (select a, b, row_number() over (partition by a order by b) - 1 as nth, count(*) over (partition by a) as many from e)"
    names = []
    for r in range(repeats):
        out += f", w{r}_0 as (select idx as sg, idx from seeds)"
        for k in range(length):
            out += f", w{r}_{k + 1} as (select w.sg, st.b as idx from w{r}_{k} w join st on st.a = w.idx and (w.sg * 7919 + w.idx * 104729 + {1 + 31 * r + 7 * k}) % 1000003 % st.many = st.nth)"
        names += [f"w{r}_{k}" for k in range(length + 1)]
    return out + " " + " union ".join(f"select sg, idx from {n}" for n in names)


@query(_walk_sql(4, 2))
def hash_walk_subgraphs(s, d):
    return S.walks(seeds(s, d), edges(s, d), 4, 2)


def _ppr_sql(rounds: int) -> str:
    out = ", e as (select distinct src, dst from edges), g as (select src, dst, count(*) over (partition by src) as deg from e), p0 as (select idx as root, idx, 1.0::double as p from seeds)"
    for t in range(1, rounds + 1):
        out += f", p{t} as (select root, g.dst as idx, sum(p * 0.9 / deg) as p from p{t - 1} join g on g.src = p{t - 1}.idx group by root, g.dst)"
    parts = " union all ".join(f"select root, idx, p * {0.1 if t < rounds else 1.0} as p from p{t}" for t in range(rounds + 1))
    return out + f", a as (select root, idx, round(sum(p), 9) as score from ({parts}) group by root, idx) select root, idx, score, cast(rank as int) as rank from (select *, row_number() over (partition by root order by score desc, idx) as rank from a) where rank <= 10"


@query(_ppr_sql(5))
def ppr_topk(s, d):
    return S.ppr_topk(seeds(s, d), edges(s, d))


@query(" select idx from seeds order by (idx * 48271 + 16807) % 2147483647, idx limit (select cast(floor(count(*) * 0.5) as bigint) from seeds)")
def random_sampling(s, d):
    return M.random_roots(seeds(s, d), 0.5)


def _graph_members(s, d):
    """Neighbourhoods of the nodes of a stand-in repo (a hundred numbers), and its edges."""
    repo = lambda c: F.floor(F.col(c) / 100)
    e = edges(s, d).where(repo("src") == repo("dst")).withColumn("graph", repo("src"))
    own = nodes(s, d).select(repo("idx").alias("graph"), F.col("idx").alias("sg"), "idx")
    near = e.select("graph", F.col("src").alias("sg"), F.col("dst").alias("idx")).union(e.select("graph", "dst", "src"))
    return own.union(near).distinct(), e


@query()
def min_set_cover(s, d):
    return M.set_cover(_graph_members(s, d)[0])


@query()
def shortest_path_sampling(s, d):
    return M.farthest_roots(*_graph_members(s, d), 3, 0)


GM = ", ge as (select distinct src // 100 as graph, src, dst from edges where src // 100 = dst // 100), gm as (select idx // 100 as graph, idx as sg, idx from nodes union select graph, src, dst from ge union select graph, dst, src from ge)"


@query(GM + " select graph, sg from (select graph, sg, row_number() over (partition by graph order by (sg * 48271 + 16807) % 2147483647, sg) as r, count(*) over (partition by graph) as n from (select distinct graph, sg from gm)) where r <= floor(n * 0.5)")
def subsampled_random(s, d):
    """The dispatcher's random mode, graph by graph."""
    return M.sampled("random", *_graph_members(s, d))


@query(GM + ", ch as (select graph, sg from (select graph, sg, row_number() over (partition by graph order by (sg * 48271 + 16807) % 2147483647, sg) as r, count(*) over (partition by graph) as n from (select distinct graph, sg from gm)) where r <= floor(n * 0.5)) select graph, round(count(*) / count(distinct sg), 6) as scale from gm join ch using (graph, sg) group by graph")
def subgraphs_transform_scale(s, d):
    """Extract, sample and combine: the scale of each graph."""
    return M.transformed(*_graph_members(s, d), mode="random")[1].withColumn("scale", F.round("scale", 6))


@query("select item_id, split(text, ' ')[(item_id * 48271 + 16807) % 2147483647 % len(split(text, ' ')) + 1] as answer from benchmark", False)
def random_answer(s, d):
    b = table(s, d, "benchmark").select("item_id", F.split("text", " ").alias("answers"))
    return M.answer_choice(b, "item_id", "answers").select("item_id", "answer")


@query("select doc_id, (row_number() over (order by (doc_id * 48271 + 16807) % 2147483647, doc_id) - 1) // 64 as batch from documents", False)
def mini_batches(s, d):
    return M.mini_batches(table(s, d, "documents").select("doc_id"), "doc_id", 64)


@query(GOLD + ", pool as (select a.idx as query, b.idx from nodes a join nodes b on a.file_id = b.file_id left join gold g on g.query = a.idx where a.idx % 50 = 0 and (gold is null or b.idx <> gold)) select query, idx from (select *, row_number() over (partition by query order by ((idx + query) * 48271 + 16807) % 2147483647, idx) as rn from pool) where rn <= 5")
def negative_samples(s, d):
    n = nodes(s, d)
    return M.easy_negatives(n.where("idx % 50 = 0").select(F.col("idx").alias("query"), "file_id"), n.select("idx", "file_id"), _gold(s, d))


@query("select doc_id, row_number() over (order by doc_id) <= (select cast(floor(count(*) * 0.8) as bigint) from documents) as is_train from documents", False)
def ordered_split(s, d):
    return M.ordered_split(table(s, d, "documents").select("doc_id"), "doc_id", 0.8)


@query("select doc_id, case when row_number() over (order by doc_id) <= (select cast(floor(count(*) / 500) as bigint) from documents) then 'train' end as split from documents", False)
def carve_head(s, d):
    return M.carved(table(s, d, "documents").select("doc_id"), "doc_id", True)


@query("select doc_id, case when row_number() over (order by doc_id) <= (select cast(floor(count(*) * 0.1) as bigint) from documents) then 'validation' else 'train' end as split from documents", False)
def carve_validation(s, d):
    return M.carved(table(s, d, "documents").select("doc_id"), "doc_id", False)


@query("select doc_id, ((doc_id + 1) * 48271 + 16807) % 2147483647 % 1000 < 800 as is_train from documents", False)
def repo_text_split(s, d):
    return M.repo_split(table(s, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "is_train")


@query("select doc_id from documents where doc_id % 4 = 1", False)
def modulo_shard(s, d):
    return M.modulo_shard(table(s, d, "documents").select("doc_id"), "doc_id", 1, 4)


@query(" select idx, row_number() over (order by file_id, case node_type when 1 then 0 when 2 then 1 else 2 end, idx) - 1 as key from nodes")
def surrogate_keys(s, d):
    return G.surrogate_keys(nodes(s, d))


@query(" select etype, src, list(dst order by dst) as targets from edges group by etype, src")
def type_edge_lists(s, d):
    return G.edge_lists(edges(s, d))


@query(" select src, dst, etype from (select *, row_number() over (partition by src order by etype desc, dst desc) as r from edges) where r = 1")
def edge_overwrite(s, d):
    return G.last_edge_wins(edges(s, d))


@query(" select distinct src, dst from edges")
def adjacency_distinct(s, d):
    return G.adjacency(edges(s, d))


@query(" select distinct a, b from und")
def undirected_edges(s, d):
    return X.undirected(edges(s, d))


REL = ", rel(src_type, rel, dst_type, etype) as (values " + ", ".join(str(r) for r in G.RELATIONS) + "), nt as (select idx, case node_type when 0 then 'code' when 1 then 'functions' else 'classes' end as kind from nodes)"


@query(REL + " select rel.src_type, rel.rel, rel.dst_type, e.src, e.dst from edges e join nt a on a.idx = e.src join nt b on b.idx = e.dst join rel on rel.src_type = a.kind and rel.dst_type = b.kind and rel.etype = e.etype")
def hetero_relations(s, d):
    return G.typed_relations(nodes(s, d), edges(s, d))


@query(" select idx, node_type, row_number() over (partition by file_id, node_type order by idx) - 1 as pos from nodes")
def node_type_positions(s, d):
    return G.type_positions(nodes(s, d))


def _names(s, d):
    """Short names for theta joins: class segments."""
    return nodes(s, d).select(F.concat(F.lit("C"), (F.col("idx") % 7).cast("string")).alias("name"))


@query(", nm as (select distinct concat('C', idx % 7) as name from nodes) select nm.name, min(n.idx) as idx from nm join nodes n on contains(n.name, nm.name) group by nm.name")
def fuzzy_contains_first(s, d):
    return J.contains_first(_names(s, d), nodes(s, d))


@query(", nm as (select idx, concat('C', idx % 7, '.m', idx % 13) as name from nodes) select n.name as node, min(nm.idx) as idx from nodes n join nm on ends_with(n.name, nm.name) group by n.name")
def fuzzy_suffix_first(s, d):
    nm = nodes(s, d).select("idx", F.concat(F.lit("C"), (F.col("idx") % 7).cast("string"), F.lit(".m"), (F.col("idx") % 13).cast("string")).alias("name"))
    return J.suffix_first(nodes(s, d).select(F.col("name").alias("node")), nm)


def _call_graph(s, d):
    """(names, call graph nodes, calls): the graph knows two thirds of the names, files by their stems, and the edges of type 1 and 2."""
    n = nodes(s, d).select("idx", "file_id", "name")
    stem = F.regexp_replace("name", r"\.py$", "")
    graph = n.where("idx % 3 > 0").select("idx", stem.alias("name")).groupBy("name").agg(F.min("idx").alias("idx"))
    calls = edges(s, d).where("etype in (1, 2)").join(n.select(F.col("idx").alias("src"), stem.alias("name")), "src").join(graph, "name").select(F.col("idx").alias("caller"), "dst")
    return n, graph, calls.join(n.select(F.col("idx").alias("dst"), F.concat(F.lit("pkg."), "name").alias("node")), "dst").select("caller", "node").distinct()


@query()
def call_edges(s, d):
    names, graph, calls = _call_graph(s, d)
    return J.call_edges(J.callers(names, graph), names, calls)


@query()
def call_edge_misses(s, d):
    names, graph, _ = _call_graph(s, d)
    return J.call_misses(J.callers(names, graph))


IMP = ", imp as (select distinct concat('pkg', idx % 5, '.C', idx % 7, '.m', idx % 13) as imp from nodes), nm as (select idx, case when idx % 2 = 0 then name else concat('C', idx % 7, '.m', idx % 3) end as name from nodes)"
TWO = ", hit as (select imp, 0 as p, min(idx) as idx from imp join nm on contains(imp, name) group by imp union all select imp, 1, min(idx) from imp join nm on list_extract(string_split(imp, '.'), -1) = list_extract(string_split(name, '.'), -1) where name not like '%.py' group by imp), best as (select imp, idx from (select *, row_number() over (partition by imp order by p, idx) as r from hit) where r = 1)"


def _imports(s, d):
    i = F.col("idx")
    n = nodes(s, d)
    imp = n.select(F.concat(F.lit("pkg"), (i % 5).cast("string"), F.lit(".C"), (i % 7).cast("string"), F.lit(".m"), (i % 13).cast("string")).alias("imp")).distinct()
    nm = n.select("idx", F.when(i % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("C"), (i % 7).cast("string"), F.lit(".m"), (i % 3).cast("string"))).alias("name"))
    return imp, nm


@query(IMP + TWO + " select * from best")
def import_two_pass(s, d):
    return J.resolve_imports(*_imports(s, d))


@query(IMP + TWO + " select distinct s.idx as src, best.idx as dst, 0 as etype from seeds s join best on best.imp like concat('pkg', s.idx % 5, '.%')")
def import_edges(s, d):
    """Seeds as files, each importing what its package has."""
    imp, nm = _imports(s, d)
    own = imp.withColumn("pkg", F.substring_index("imp", ".", 1))
    files = seeds(s, d).select(F.col("idx").alias("src"), F.concat(F.lit("pkg"), (F.col("idx") % 5).cast("string")).alias("pkg"))
    return J.import_edges(files.join(own, "pkg").select("src", "imp"), nm)


@query(" select distinct concat('f', n.file_id) as file, n.idx from nodes n where n.node_type = 0")
def file_stem_join(s, d):
    n = nodes(s, d)
    return J.file_nodes(n.select(F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("file")), n)


@query(IMP + TWO + ", b as (select doc_id as src, concat(text, ' m', doc_id % 13) as body, doc_id % 20 as file from documents), fi as (select imp, cast(ascii(right(imp, 1)) % 20 as bigint) as file from imp), m as (select distinct b.src, best.idx as dst from b join fi using (file) join best using (imp) where contains(b.body, list_extract(string_split(imp, '.'), -1))) select * from m where not exists (select 1 from edges e where e.src = m.src and e.dst = m.dst)")
def fallback_edges(s, d):
    imp, nm = _imports(s, d)
    i = F.col("doc_id")
    body = table(s, d, "documents").select(i.alias("src"), F.concat("text", F.lit(" m"), (i % 13).cast("string")).alias("body"), (i % 20).alias("file"))
    fi = imp.withColumn("file", (F.ascii(F.expr("right(imp, 1)")) % 20).cast("long"))
    return J.fallback_edges(body, fi, nm, edges(s, d).select("src", "dst").distinct())


@query(" select distinct a.idx, b.idx as other from nodes a join nodes b on a.file_id = b.file_id where a.idx % 50 = 0 and (contains(a.name, list_extract(string_split(b.name, '.'), -1)) or a.idx = b.idx)")
def expand_cls(s, d):
    return J.expand_class(seeds(s, d), nodes(s, d))


@query(" select name, max(idx) as idx from nodes group by name")
def name_to_index(s, d):
    return J.last_wins(nodes(s, d))


GOLDS = ", g as (select distinct concat('C', conv_id % 9) as gold from conversations)"


def _golds(s, d):
    return table(s, d, "conversations").select(F.concat(F.lit("C"), (F.col("conv_id") % 9).cast("string")).alias("gold"))


@query(GOLDS + " select gold, min(idx) as idx from g join nodes on list_contains(string_split(name, '.'), gold) group by gold")
def gold_index(s, d):
    return J.gold_matches(_golds(s, d), nodes(s, d)).groupBy("gold").agg(F.min("idx").alias("idx"))


@query(GOLDS + " select gold, idx from g join nodes on list_contains(string_split(name, '.'), gold)")
def all_gold(s, d):
    return J.gold_matches(_golds(s, d), nodes(s, d))


@query(GOLDS + " select gold from g where exists (select 1 from nodes where list_contains(string_split(name, '.'), gold))")
def gold_exists(s, d):
    seg = nodes(s, d).select(F.explode(F.split("name", r"\.")).alias("gold"))
    return _golds(s, d).distinct().join(seg, "gold", "left_semi")


@query(", c as (select conv_id, turn, concat('C', turn % 9) as gold from conversations) select conv_id, turn, min(idx) as idx from c join nodes on list_contains(string_split(name, '.'), gold) group by conv_id, turn")
def import_indexes(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("C"), (F.col("turn") % 9).cast("string")).alias("gold"))
    first = J.gold_matches(c, nodes(s, d)).groupBy("gold").agg(F.min("idx").alias("idx"))
    return c.join(first, "gold").select("conv_id", "turn", "idx")


SEG = ", seg(idx, seg) as (values (1, 'the'), (2, 'an'), (3, 'ou'), (4, 'zzz'))"


@query(SEG + ", o as (select doc_id as sample, idx, (length(text) - length(replace(text, seg, ''))) / length(seg) as n from documents, seg) select sample, cast(idx as bigint) as idx, round(n / sum(n) over (partition by sample), 6) as weight from o where n > 0")
def called_import_weights(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("sample"), F.col("text").alias("code"))
    # every sample imports the same four names
    imported = F.array(*[F.struct(F.lit(i).cast("long").alias("idx"), F.lit(n).alias("name")) for i, n in ((1, "x.the"), (2, "y.an"), (3, "ou"), (4, "zzz"))])
    each = docs.select("sample", F.inline(imported))
    return J.call_weights(docs, each).withColumn("weight", F.round("weight", 6))


SOURCES = [("m.py", "def f(a):\n  return a\n\nclass A:\n  def g(self): pass\n"), ("pkg/__init__.py", "from a.b import c, d as e\nfrom . import x\nimport os\n"), ("bad.py", "def (")]


@query("select * from (values ('m.py', 'function', 'm.f', 'm.py'), ('m.py', 'class', 'm.A', 'm.py'), ('m.py', 'method', 'm.A.g', 'm.A'), ('pkg/__init__.py', 'import', 'a.b.c', 'pkg.__init__.py'), ('pkg/__init__.py', 'import', 'a.b.d', 'pkg.__init__.py'), ('pkg/__init__.py', 'import', 'None.x', 'pkg.__init__.py')) t(path, kind, name, owner)", False)
def parse_entities(s, d):
    return P.parse(s.createDataFrame(SOURCES, "path string, text string")).select("path", "kind", "name", "owner")


@query("select * from (values ('m.py', 'm.py', '', ['m.f', 'm.A'], [3, 3]), ('pkg/__init__.py', 'pkg.__init__.py', 'from a.b import c, d as e' || chr(10) || 'from . import x' || chr(10) || 'import os' || chr(10), [], []), ('bad.py', 'bad.py', 'def (', [], [])) t(path, name, body, names, types)", False)
def parse_files(s, d):
    """Files' own nodes: what is left of their text, and what they own."""
    return P.file_rows(s.createDataFrame(SOURCES, "path string, text string"))


REPO = [
    ("app/main.py", "from lib.tools import helper\nfrom lib import tools\n\ndef run(x):\n    return helper(x)\n\nclass App:\n    def start(self):\n        return run(1)\n\nrun(2)\n"),
    ("lib/tools.py", "def helper(x):\n    return x\n\ndef unused():\n    pass\n"),
    ("lib/__init__.py", ""),
]
CALLS = [(0, "main::run", ["tools::tools.helper"]), (1, "main.App.start", ["x.main.run"]), (2, "main", ["y.main.run", "nothing"]), (3, "tools.helper", [])]


def _built(s):
    return repo_graph(s.createDataFrame(REPO, "path string, text string"), s.createDataFrame(CALLS, "place int, node string, called array<string>"))


@query("select * from (values (0, 'app/main.py', 'function', 'main.run'), (1, 'app/main.py', 'class', 'main.App'), (2, 'app/main.py', 'method', 'main.App.start'), (3, 'app/main.py', 'file', 'main.py'), (4, 'lib/__init__.py', 'file', 'lib.__init__.py'), (5, 'lib/tools.py', 'function', 'tools.helper'), (6, 'lib/tools.py', 'function', 'tools.unused'), (7, 'lib/tools.py', 'file', 'tools.py')) t(idx, path, kind, name)", False)
def repo_nodes(s, d):
    return _built(s)[0].select("idx", "path", "kind", "name")


@query("select * from (values (3, 0, 3), (3, 1, 3), (1, 2, 4), (7, 5, 3), (7, 6, 3), (3, 5, 0), (2, 0, 1), (3, 0, 2), (1, 0, 1)) t(src, dst, etype)", False)
def repo_edges(s, d):
    return _built(s)[1]


@query("select * from (values ('app/main.py', 2, 1), ('lib/tools.py', 1, 1)) t(path, captured, missed)", False)
def repo_misses(s, d):
    return _built(s)[2]


@query("select * from (values ('m.py'), ('pkg/__init__.py')) t(path)", False)
def compile_filter(s, d):
    return P.compiles(s.createDataFrame(SOURCES, "path string, text string")).select("path")


@query("select * from (values (1, 'Foo'), (2, null), (3, 'bar')) t(k, name)", False)
def function_class_name(s, d):
    rows = s.createDataFrame([(1, "class Foo(Bar): ..."), (2, "x = 1"), (3, "def bar():")], "k int, code string")
    return rows.select("k", P.head_name(F.col("code")).alias("name"))


SAMP = "with t as (select conv_id, count(*) as n, min(case when turn = 1 and conv_id % 3 > 0 then conv_id % 50 end) as gold, list(case when turn % 2 = 0 then turn end order by turn) as imports from conversations group by conv_id)"


def _samples(s, d):
    c = table(s, d, "conversations")
    g = c.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(F.when((F.col("turn") == 1) & (F.col("conv_id") % 3 > 0), F.col("conv_id") % 50)).alias("gold"), F.sort_array(F.collect_list(F.struct("turn", F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("i")))).alias("x"))
    return g.select("conv_id", "n", "gold", F.transform("x", lambda r: r["i"]).alias("imports"))


@query(SAMP + " select conv_id, gold from t where gold is not null and len(list_filter(imports, lambda x: x is not null)) > 1 and n <= 1500", False)
def sample_filter(s, d):
    return _samples(s, d).where((F.col("gold").isNotNull()) & (F.size(F.filter("imports", lambda x: x.isNotNull())) > 1) & (F.col("n") <= 1500)).select("conv_id", "gold")


@query("select doc_id from documents where split_part(concat('org/', source), '/', 2) = 'src3'", False)
def repo_samples(s, d):
    return table(s, d, "documents").where(F.split(F.concat(F.lit("org/"), "source"), "/")[1] == "src3").select("doc_id")


@query("select distinct source from documents", False)
def distinct_repos(s, d):
    return table(s, d, "documents").select("source").distinct()


@query("select doc_id from documents where doc_id not in (select doc_id from labels)", False)
def todo_repos(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(" select idx from nodes where name like '%.py'")
def file_nodes(s, d):
    return nodes(s, d).where(F.col("name").endswith(".py")).select("idx")


@query(" select idx, list_extract(string_split(name, '.'), -1) as seg from nodes")
def last_segment(s, d):
    return nodes(s, d).select("idx", J.last_segment(F.col("name")).alias("seg"))


@query(" select idx from nodes where idx in (select distinct dst from edges where etype = 3)")
def in_set(s, d):
    return nodes(s, d).select("idx").join(edges(s, d).where("etype = 3").select(F.col("dst").alias("idx")), "idx", "left_semi")


@query("select source, min(doc_id) as doc_id, arg_min(text, doc_id) as text from documents group by source", False)
def file_lookup(s, d):
    """The first document of every source, with its text."""
    return table(s, d, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text"))


@query("select user_id, key, value from (select user_id, unnest(json_keys(props)) as key, props from events), lateral (select json_extract_string(props, concat('$.', key)) as value)", False)
def json_edges(s, d):
    e = table(s, d, "events")
    return e.select("user_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("select item_id as k, case when item_id % 3 = 0 then item_id * 10 else item_id end as id, case when item_id % 2 = 0 then 0.5 else 1.0 / (item_id + 1) end as score from benchmark where item_id % 4 = 1", False)
def fid_load_defaults(s, d):
    k = F.col("item_id")
    rows = table(s, d, "benchmark").select(k.alias("k"), F.when(k % 3 == 0, k * 10).alias("id"), F.array(F.struct(F.col("text"), F.when(k % 2 == 0, F.lit(0.5)).alias("score"))).alias("ctxs"))
    return R.load_examples(rows, 1, 4).select("k", "id", F.col("ctxs")[0]["score"].alias("score"))


TOK = r"list_transform(regexp_extract_all(text, '([\p{L}\p{N}\p{M}]+)|([^\p{Z}\p{C}])'), lambda x: lower(x))"


@query(f"select doc_id, {TOK} as tokens from documents", False)
def tokenize(s, d):
    return table(s, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


ANSWERS = f"with t as (select doc_id, ' ' || array_to_string({TOK}, ' ') || ' ' as t from documents), b as (select item_id, ' ' || array_to_string({TOK}, ' ') || ' ' as a from benchmark), hit as (select item_id, doc_id from b join t on contains(t.t, b.a))"


def _answers(s, d, normal=False):
    """(item_id, doc_id) of all items and all documents whose tokens hold the item's in one run."""
    text = R.nfd(F.col("text")) if normal else F.col("text")
    b, t = table(s, d, "benchmark").select("item_id", T.tokens(text).alias("answer")), table(s, d, "documents").select("doc_id", T.tokens(text).alias("t"))
    return A.answer_hits(b, t)


@query(ANSWERS + " select * from hit", False)
def has_answer(s, d):
    return _answers(s, d)


@query()
def has_answer_nfd(s, d):
    """As ``has_answer`` after canonical decomposition of both sides, which DuckDB lacks."""
    return _answers(s, d, True)


@query(ANSWERS + ", n as (select count(*) as n from documents), k as (select unnest(range(1, (select n + 1 from n))) as k), p as (select item_id, count(*) filter (where d.doc_id < h.first) + 1 as place from (select item_id, min(doc_id) as first from hit group by item_id) h, documents d group by item_id) select cast(k.k as bigint) as k, count(p.place) as hits from k left join p on p.place <= k.k where k.k in (1, 3, 5, 10, 20, 50, 100, 200, 500, 1000) group by k.k", False)
def topk_hits(s, d):
    """Of how many items an answer stands among the first k documents, by number."""
    docs = table(s, d, "documents").select("doc_id")
    first = _answers(s, d).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    return A.hits_by_k(first, numbered(docs, "doc_id"), [1, 3, 5, 10, 20, 50, 100, 200, 500, 1000])


@query(ANSWERS + ", p as (select doc_id, row_number() over (order by doc_id) - 1 as i from documents) select h.item_id, list(p.i order by p.i) as places from hit h join p using (doc_id) group by h.item_id", False)
def answer_hits(s, d):
    """The places of each item's answers in the order of the documents: what top-k hits are counted from."""
    places = numbered(table(s, d, "documents").select("doc_id"), "doc_id")
    return _answers(s, d).join(places, "doc_id").groupBy("item_id").agg(F.sort_array(F.collect_list("nr")).alias("places"))


_BARE = r"""' ' || translate(lower({x}), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', '') || ' '"""
_ONCE = r"""regexp_replace({y}, '([^\p{{L}}\p{{M}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{M}}\p{{N}}_])', '\1 \3', 'g')"""
NORM = r"trim(regexp_replace(" + _ONCE.replace("{y}", _ONCE.replace("{y}", _BARE)) + r", '\s+', ' ', 'g'))"


@query(f"select item_id, {NORM.format(x='text')} as answer from benchmark", False)
def normalize_answer(s, d):
    return table(s, d, "benchmark").select("item_id", T.normalised_answer(F.col("text")).alias("answer"))


@query(f"select item_id, {NORM.format(x='text')} = {NORM.format(x=chr(39) + 'The ' + chr(39) + ' || text || ' + chr(39) + '. ' + chr(39))} as em from benchmark", False)
def exact_match(s, d):
    return table(s, d, "benchmark").select("item_id", (T.normalised_answer(F.col("text")) == T.normalised_answer(F.concat(F.lit("The "), "text", F.lit(". ")))).alias("em"))


@query("with a as (select doc_id // 20 as g, doc_id % 20 as i, n_chars from documents) select x.g, count(*) filter (where x.i < y.i and x.n_chars > y.n_chars) as inv from a x join a y on x.g = y.g group by x.g", False)
def inversions(s, d):
    a = table(s, d, "documents").groupBy(F.floor(F.col("doc_id") / 20).alias("g")).agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "n_chars"))), lambda x: x["n_chars"]).alias("r"))
    return a.select("g", T.inversions(F.col("r")).cast("long").alias("inv"))


RETR = KNN_SQL.format(value="list_distance(a.v, b.v)", order="asc").replace("select query, idx, score, cast(rank as integer) as rank from (", ", kn as (select query, idx, score from (") + "), x as (select query, row_number() over (partition by query order by idx) - 1 as gold, row_number() over (partition by query order by score desc, idx) as place, count(*) over (partition by query) as n from kn), inv as (select a.query, count(*) filter (where a.place < b.place and a.gold > b.gold) as inversions from x a join x b using (query) group by a.query)"


@query(RETR + " select query, any_value(inversions) as inversions, " + ", ".join(f"round(avg(case when place <= {k} then cast(gold < {k} as int) end), 6) as avg_{k}, max(case when gold < {k} then place end) as need_{k}" for k in (1, 3, 5)) + " from x join inv using (query) group by query")
def retriever_scores(s, d):
    """Of each seed's eight nearest: predicted order by distance, farthest first, against gold order by number."""
    near = V.near(_seed_queries(s, d), nodes(s, d), "euclidean", 8)
    gold = F.row_number().over(Window.partitionBy("query").orderBy("idx")) - 1
    return V.retriever_scores(near.withColumn("gold", gold), [1, 3, 5])


@query(COS + GOLD + ", z as (select *, score - max(score) over (partition by query) as z from sc), p as (select query, idx, z - ln(sum(exp(z)) over (partition by query)) as logp from z) select query % 100 as repo, round(exp(avg(-logp)), 4) as perplexity from p join gold using (query) where idx = gold group by 1")
def repo_perplexity(s, d):
    """exp of the mean loss of each repo's samples."""
    loss = V.log_softmax(_cos(s, d), 1.0).join(_gold(s, d), "query").where("idx = gold").select((F.col("query") % 100).alias("repo"), (-F.col("logp")).alias("loss"))
    return loss.groupBy("repo").agg(F.round(T.perplexity(F.avg("loss")), 4).alias("perplexity"))


SETS = "with t as (select item_id, list_distinct(string_split(lower(text), ' ')) as w, text as s from benchmark)"


def _bags(s, d):
    return table(s, d, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"), F.col("text").alias("s"))


@query(SETS + " select x.item_id as a, y.item_id as b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) as jac from t x join t y on x.item_id < y.item_id where len(list_intersect(x.w, y.w)) > 0", False)
def jaccard_lexical(s, d):
    """Of all pairs of items that share a word; the others' is 0."""
    return A.shared_word_jaccard(_bags(s, d)).withColumn("jac", F.round("jac", 6))


@query(SETS + " select x.item_id as a, y.item_id as b, round(1 - levenshtein(x.s, y.s) / greatest(length(x.s), length(y.s)), 6) as sim from t x join t y on x.item_id < y.item_id where strlen(x.s) = length(x.s) and strlen(y.s) = length(y.s)", False)
def edit_similarity(s, d):
    """Of all pairs of items in ASCII, whose characters both engines count alike."""
    plain = _bags(s, d).where(F.octet_length("s") == F.length("s")).select("item_id", "s")
    return plain.select(F.col("item_id").alias("a"), F.col("s").alias("sa")).join(plain.select(F.col("item_id").alias("b"), F.col("s").alias("sb")), F.col("a") < F.col("b")).select("a", "b", F.round(T.edit_similarity(F.col("sa"), F.col("sb")), 6).alias("sim"))


@query()
def edit_similarity_all(s, d):
    """Of all pairs of items."""
    b = _bags(s, d).select("item_id", "s")
    return b.select(F.col("item_id").alias("a"), F.col("s").alias("sa")).join(b.select(F.col("item_id").alias("b"), F.col("s").alias("sb")), F.col("a") < F.col("b")).select("a", "b", F.round(T.edit_similarity(F.col("sa"), F.col("sb")), 6).alias("sim"))


@query("select item_id, 'code: ' || text as code, 'context: ' || reverse(text) || ' </s>' as context from benchmark", False)
def format_prompts(s, d):
    return table(s, d, "benchmark").select("item_id", T.prompt("code: ", F.col("text")).alias("code"), T.prompt("context: ", F.reverse("text"), " </s>").alias("context"))


IDS = "with t as (select doc_id, list_transform(string_split(text, ' '), lambda x: cast(length(x) as int)) as ids from documents)"


def _ids(s, d):
    """Word lengths in place of token numbers."""
    return table(s, d, "documents").select("doc_id", F.transform(F.split("text", " "), F.length).alias("ids"))


@query(IDS + " select doc_id, list_concat(ids[1:64], list_transform(range(0, greatest(64 - len(ids), 0)), lambda x: 0)) as ids, list_concat(ids[1:64], list_transform(range(0, greatest(64 - len(ids), 0)), lambda x: -100)) as labels from t", False)
def pad_mask(s, d):
    return _ids(s, d).select("doc_id", T.padded(F.col("ids"), 64, 0).alias("ids"), T.padded(F.col("ids"), 64, -100).alias("labels"))


WIN = IDS + ", l as (select doc_id, ids, case when len(ids) >= 64 then len(ids) // 64 * 64 else len(ids) end as n from t), i as (select *, unnest(range(0, n, 32)) as i from l), w as (select doc_id, i, ids[greatest(i + 32 - 64, 0) + 1 : least(i + 32, n)] as x, least(i + 32, n) - i as fresh from i)"


@query(WIN + " select doc_id, i, list_concat(x, list_transform(range(0, 64 - len(x)), lambda z: 0)) as input_ids, list_concat(list_transform(range(0, len(x) - fresh), lambda z: -100), x[len(x) - fresh + 1 : len(x)], list_transform(range(0, 64 - len(x)), lambda z: -100)) as labels from w", False)
def token_windows(s, d):
    return _ids(s, d).select("doc_id", F.posexplode(T.windows(F.col("ids"), 64, 32, 0)).alias("k", "w")).select("doc_id", (F.col("k") * 32).cast("long").alias("i"), "w.input_ids", "w.labels")


@query(WIN + " select doc_id, cast(sum(case when i = 0 then fresh - 1 else fresh end) as bigint) as n from w group by doc_id", False)
def window_token_counts(s, d):
    one = _ids(s, d).select("doc_id", F.explode(T.windows(F.col("ids"), 64, 32, 0)).alias("w"))
    return one.groupBy("doc_id").agg(F.sum(F.size(F.filter(F.slice("w.labels", 2, 64), lambda x: x != -100))).alias("n"))


@query(COS + ", z as (select *, score - max(score) over (partition by query) as z from sc), p as (select query, z - ln(sum(exp(z)) over (partition by query)) as logp, idx from z) select query, round(exp(avg(-logp)), 4) as ppl, round(avg(-logp), 4) as loss from p where idx % 3 = 0 group by query")
def perplexity(s, d):
    """Candidates divisible by three as a sample's labelled tokens: exp of their mean loss."""
    loss = V.log_softmax(_cos(s, d), 1.0).where("idx % 3 = 0")
    return loss.groupBy("query").agg(F.round(T.perplexity(F.avg(-F.col("logp"))), 4).alias("ppl"), F.round(F.avg(-F.col("logp")), 4).alias("loss"))


@query("select step, round(case when step < 20 then (1 - 0.1) * step / 20 + 0.1 else greatest(0.0, 1 + (0.1 - 1) * (step - 20) / (100 - 20)) end, 6) as factor from (select unnest(range(0, 120)) as step)", False)
def lr_schedule(s, d):
    return s.range(0, 120).select(F.col("id").alias("step"), F.round(T.warm_up(F.col("id"), 20, 100, 0.1), 6).alias("factor"))


MINH = ", mh as (select idx, k - 1 as pos, ((k * 48271 + 11) * (idx + 1) + k * 16807) % 2147483647 as v from nodes, (select unnest(range(1, 17)) as k)), feed as (select dst as idx, src as f from edges union select idx, idx from nodes)"
HLL = ", feed as (select dst as idx, src as f from edges union select idx, idx from nodes), h as (select idx, (idx + 1) * 1103515245 % 2147483647 as h from nodes), hl as (select idx, h % 16 as pos, cast(27 - case when h // 16 = 0 then 0 else length(bin(h // 16)) end + 1 as int) as v from h), h1 as (select feed.idx, hl.pos, max(hl.v) as v from feed join hl on hl.idx = feed.f group by feed.idx, hl.pos)"


def _feeds(s, d):
    return H.neighbourhoods(nodes(s, d), edges(s, d))


@query(MINH + " select idx, cast(pos as int) as pos, v from mh")
def minhash_signature(s, d):
    return H.minhash_rows(nodes(s, d), 16)


@query(MINH + " select feed.idx, cast(pos as int) as pos, min(v) as v from feed join mh on mh.idx = feed.f group by feed.idx, pos")
def minhash_propagate(s, d):
    return H.propagate(H.minhash_rows(nodes(s, d), 16), _feeds(s, d), "min")


@query(HLL + " select idx, pos, v from hl")
def hll_registers(s, d):
    return H.hll_rows(nodes(s, d), 4)


@query(HLL + " select idx, pos, v from h1")
def hll_propagate(s, d):
    return H.propagate(H.hll_rows(nodes(s, d), 4), _feeds(s, d), "max")


@query(HLL + ", p as (select idx, count(*) as used, sum(power(2.0, -v)) as s from h1 group by idx) select idx, round(case when used < 16 then 16 * ln(16.0::double / (16 - used)) else 0.7213 / (1 + 1.079 / 16) * 16 * 16 / s end, 6) as card from p")
def hll_cardinality(s, d):
    return H.linear_count(H.propagate(H.hll_rows(nodes(s, d), 4), _feeds(s, d), "max"), 4)


LINKS = ", links as (select distinct src as u, dst as v from edges union select idx, (idx * 7 + 1) % (select count(*) from nodes) from nodes)"


def _links(s, d):
    n = nodes(s, d)
    return edges(s, d).select(F.col("src").alias("u"), F.col("dst").alias("v")).union(n.select("idx", (F.col("idx") * 7 + 1) % n.count())).distinct()


@query(MINH + LINKS + ", m1 as (select feed.idx, pos, min(v) as v from feed join mh on mh.idx = feed.f group by feed.idx, pos) select u, l.v, round(count(*) filter (where a.v = b.v) / 16, 6) as jac from links l join m1 a on a.idx = u join m1 b on b.idx = l.v and b.pos = a.pos group by u, l.v")
def jaccard_estimate(s, d):
    return H.jaccard_estimate(_links(s, d), H.propagate(H.minhash_rows(nodes(s, d), 16), _feeds(s, d), "min"), 16)


KH = ", feed as (select dst as idx, src as f from edges union select idx, idx from nodes), k1 as (select idx, f as member from feed), k2 as (select distinct feed.idx, k1.member from feed join k1 on k1.idx = feed.f)"


@query(KH + " select idx, 1 as hop, count(*) as n from k1 group by idx union all select idx, 2, count(*) from k2 group by idx")
def exact_khop_cardinality(s, d):
    return H.khop_sets(nodes(s, d), _feeds(s, d), 2).groupBy("idx", "hop").agg(F.count("*").alias("n"))


INTER = KH + LINKS + "".join(f", i{i}{j} as (select u, v, count(*) as n from links join k{i} a on a.idx = u join k{j} b on b.idx = v and b.member = a.member group by u, v)" for i in (1, 2) for j in (1, 2)) + "".join(f", c{i} as (select idx, count(*) as n from k{i} group by idx)" for i in (1, 2)) + """
, j as (select l.u, l.v, coalesce(i11.n, 0) as i11, coalesce(i12.n, 0) as i12, coalesce(i21.n, 0) as i21, coalesce(i22.n, 0) as i22, a1.n as a1, a2.n as a2, b1.n as b1, b2.n as b2 from links l
left join i11 on i11.u = l.u and i11.v = l.v left join i12 on i12.u = l.u and i12.v = l.v left join i21 on i21.u = l.u and i21.v = l.v left join i22 on i22.u = l.u and i22.v = l.v
left join c1 a1 on a1.idx = l.u left join c2 a2 on a2.idx = l.u left join c1 b1 on b1.idx = l.v left join c2 b2 on b2.idx = l.v)
"""


@query(INTER + " select u, v, greatest(i11, 0) as f0, greatest(b1 - i11, 0) as f1, greatest(a1 - i11, 0) as f2 from j")
def subgraph_features_h1(s, d):
    return H.link_features(_links(s, d), H.khop_sets(nodes(s, d), _feeds(s, d), 1), 1)


@query(INTER + ", f as (select u, v, i11 as f0, i21 - i11 as f1, i12 - i11 as f2, i22 - i11 - (i21 - i11) - (i12 - i11) as f3, a1, a2, b1, b2 from j), g as (select *, b1 - (f0 + f1) as f4, a1 - f0 - f2 as f5 from f) select u, v, greatest(f0, 0) as f0, greatest(f1, 0) as f1, greatest(f2, 0) as f2, greatest(f3, 0) as f3, greatest(f4, 0) as f4, greatest(f5, 0) as f5, greatest(b2 - (f0 + f1 + f2 + f3 + f4), 0) as f6, greatest(a2 - f0 - (f0 + f1 + f2 + f3) - f5, 0) as f7 from g")
def subgraph_features_h2(s, d):
    return H.link_features(_links(s, d), H.khop_sets(nodes(s, d), _feeds(s, d), 2), 2)


INTER3 = KH + ", k3 as (select distinct feed.idx, k2.member from feed join k2 on k2.idx = feed.f)" + LINKS + "".join(f", i{i}{j} as (select u, v, count(*) as n from links join k{i} a on a.idx = u join k{j} b on b.idx = v and b.member = a.member group by u, v)" for i in (1, 2, 3) for j in (1, 2, 3)) + "".join(f", c{i} as (select idx, count(*) as n from k{i} group by idx)" for i in (1, 2, 3))
INTER3 += ", j as (select l.u, l.v, " + ", ".join(f"coalesce(i{i}{j}.n, 0) as i{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)) + ", " + ", ".join(f"{c}{i}.n as {c}{i}" for c in "ab" for i in (1, 2, 3)) + " from links l " + " ".join(f"left join i{i}{j} on i{i}{j}.u = l.u and i{i}{j}.v = l.v" for i in (1, 2, 3) for j in (1, 2, 3)) + " " + " ".join(f"left join c{i} {c}{i} on {c}{i}.idx = l.{e}" for c, e in (("a", "u"), ("b", "v")) for i in (1, 2, 3)) + ")"
#: One step a feature, each on what the steps before it found.
for _k, (_start, _less) in enumerate(H.FEATURES[3]):
    INTER3 += f", s{_k} as (select *, {' - '.join([_start, *(f'f{x}' for x in _less)])} as f{_k} from {f's{_k - 1}' if _k else 'j'})"


@query(INTER3 + " select u, v, " + ", ".join(f"greatest(f{k}, 0) as f{k}" for k in range(15)) + " from s14")
def subgraph_features_h3(s, d):
    return H.link_features(_links(s, d), materialised(H.khop_sets(nodes(s, d), _feeds(s, d), 3)), 3)


@query(INTER3 + " select u, v, " + ", ".join("0 as f%d" % k if k in H.ZERO_ONE[3] else f"f{k}" for k in range(15)) + " from s14")
def subgraph_features_h3_masked(s, d):
    return H.link_features(_links(s, d), materialised(H.khop_sets(nodes(s, d), _feeds(s, d), 3)), 3, zero_one=False, floor=False)


CARD = "case when {used} < 16 and 16 * ln(16.0::double / (16 - {used})) <= 10 then 16 * ln(16.0::double / (16 - {used})) else 0.673::double * 16 * 16 / {sum} end"


@query(HLL + ", p as (select idx, count(*) as used, sum(power(2.0, -v)) as s from h1 group by idx) select idx, round(" + CARD.format(used="used", sum="(s + 16 - used)") + ", 6) as card from p")
def hll_count_threshold(s, d):
    """Linear counts up to the threshold of 16 registers, raw estimates beyond."""
    r = H.dense(H.propagate(H.hll_rows(nodes(s, d), 4), _feeds(s, d), "max"), 16, "idx")
    return r.select("idx", F.round(H.hll_count(F.col("values"), 4), 6).alias("card"))


SKETCHED = MINH + HLL.replace(", feed as (select dst as idx, src as f from edges union select idx, idx from nodes)", "") + LINKS
SKETCHED += ", m1 as (select feed.idx, pos, min(v) as v from feed join mh on mh.idx = feed.f group by feed.idx, pos), jc as (select u, l.v, count(*) filter (where a.v = b.v) / 16 as jac from links l join m1 a on a.idx = u join m1 b on b.idx = l.v and b.pos = a.pos group by u, l.v)"
SKETCHED += ", one as (select idx, count(*) as used, sum(power(2.0, -v)) as s from h1 group by idx), cd as (select idx, " + CARD.format(used="used", sum="(s + 16 - used)") + " as card from one)"
SKETCHED += ", un as (select u, v, pos, max(r) as r from (select l.u, l.v, h1.pos, h1.v as r from links l join h1 on h1.idx = l.u union all select l.u, l.v, h1.pos, h1.v from links l join h1 on h1.idx = l.v) group by u, v, pos), us as (select u, v, count(*) as used, sum(power(2.0, -r)) as s from un group by u, v), uc as (select u, v, " + CARD.format(used="used", sum="(s + 16 - used)") + " as card from us)"


@query(SKETCHED + ", f as (select jc.u, jc.v, jac * uc.card as f0, a.card as a1, b.card as b1 from jc join uc on uc.u = jc.u and uc.v = jc.v join cd a on a.idx = jc.u join cd b on b.idx = jc.v) select u, v, round(greatest(f0, 0), 5) as f0, round(greatest(b1 - f0, 0), 5) as f1, round(greatest(a1 - f0, 0), 5) as f2 from f")
def sketched_features_h1(s, d):
    """Link features from sketches in place of sets."""
    n, feeds = nodes(s, d), _feeds(s, d)
    counts = H.sketched_counts(_links(s, d), H.hop_sketches(H.minhash_rows(n, 16), feeds, 1, "min"), H.hop_sketches(H.hll_rows(n, 4), feeds, 1, "max"), 1, 16, 4)
    return H.features(counts, 1).select("u", "v", *[F.round(f"f{k}", 5).alias(f"f{k}") for k in range(3)])


@query()
def sketched_features_h3(s, d):
    """64-bit sketches of three hops, with the simulated bias taken off."""
    n, feeds = nodes(s, d), materialised(_feeds(s, d))
    signs = n.select("idx", F.posexplode(H.minhash_64(F.col("idx"), 64)).alias("pos", "v"))
    regs = n.select("idx", H.register_64(F.col("idx"), 6).alias("r")).select("idx", "r.pos", "r.v")
    counts = H.sketched_counts(_links(s, d), H.hop_sketches(signs, feeds, 3, "min"), H.hop_sketches(regs, feeds, 3, "max"), 3, 64, 6, H.simulated_bias(6))
    return H.features(materialised(counts), 3)


FEAT = ", x as (select idx, k - 1 as pos, v[k] as x from nodes, (select unnest(range(1, 65)) as k)), e as (select distinct src, dst from edges), ag as (select e.dst as idx, pos, round(avg(x), 6) as mean, min(x) as mn, max(x) as mx, round(sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0.0) + 1e-5), 5) as std, count(*) as deg from e join x on x.idx = e.src group by e.dst, pos)"


@query(FEAT + " select idx, cast(pos as int) as pos, mean, mn, mx, std, deg from ag")
def pna_aggregate(s, d):
    return N.aggregate_neighbours(N.features(nodes(s, d), 64), edges(s, d))


@query(FEAT + " select x.idx, cast(x.pos as int) as pos, round(greatest(x.x + coalesce(ag.mx, 0.0), 0.0), 6) as h from x left join ag on ag.idx = x.idx and ag.pos = x.pos")
def sage_max_layer(s, d):
    return N.sage_max(N.features(nodes(s, d), 64), edges(s, d))


@query(FEAT + ", l as (select src, dst from e union select idx, idx from nodes), dg as (select dst as n, count(*) as d from l group by dst) select l.dst as idx, cast(pos as int) as pos, round(sum(x / sqrt(a.d * b.d)), 5) as h from l join dg a on a.n = l.src join dg b on b.n = l.dst join x on x.idx = l.src group by l.dst, pos")
def gcn_norm_layer(s, d):
    return N.gcn(N.features(nodes(s, d), 64), edges(s, d))


@query(FEAT + " select x.idx, cast(pos as int) as pos, round(x + sum(x) over (partition by file_id, pos), 5) as h from x join nodes using (idx)")
def virtual_node(s, d):
    return N.virtual_node(N.features(nodes(s, d), 64), nodes(s, d).select("idx", F.col("file_id").alias("graph")))


UP1 = ", mem as (select idx as sg, idx from nodes union select dst, src from edges)"


@query(FEAT + UP1 + ", su as (select sg as idx, pos, round(avg(x), 5) as subgraph from mem join x using (idx) group by sg, pos), cx as (select m.idx, pos, round(avg(x), 5) as context from mem m join x on x.idx = m.sg group by m.idx, pos) select x.idx, cast(x.pos as int) as pos, x.x as centroid, subgraph, context from x join su on su.idx = x.idx and su.pos = x.pos join cx on cx.idx = x.idx and cx.pos = x.pos")
def gnnak_pool(s, d):
    members = H.neighbourhoods(nodes(s, d), edges(s, d)).select(F.col("idx").alias("sg"), F.col("from").alias("idx"))
    return N.kernel_pool(N.features(nodes(s, d), 64), members)


@query(LINKS + " select u, l.v, round(list_cosine_similarity(a.v, b.v), 6) as score from links l join nodes a on a.idx = u join nodes b on b.idx = l.v")
def link_scores(s, d):
    return N.link_scores(_links(s, d), nodes(s, d))


@query("select event_type, round(sum(value * user_id) / sum(user_id), 4) as mean from events group by event_type", False)
def weighted_average(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("user_id")) / F.sum("user_id"), 4).alias("mean"))


@query(" select n.idx, count(e.src) as n from nodes n left join edges e on e.dst = n.idx group by n.idx")
def bincount(s, d):
    return nodes(s, d).select("idx").join(edges(s, d).groupBy(F.col("dst").alias("idx")).agg(F.count("*").alias("n")), "idx", "left").fillna({"n": 0})


@query(FEAT + " select n.file_id as text, cast(x.pos as int) as pos, round(sum(case when n.node_type > 0 then x.x end) / count(case when n.node_type > 0 then 1 end), 6) as pooled from x join nodes n using (idx) group by n.file_id, x.pos")
def mean_pool(s, d):
    """Nodes as the tokens of their file, of which files themselves are padding."""
    n = nodes(s, d)
    tokens = N.features(n, 64).join(n.select("idx", F.col("file_id").alias("text"), (F.col("node_type") > 0).alias("mask")), "idx")
    return N.masked_mean(tokens, "text")


@query(FEAT + ", t as (select idx as passage, pos % 16 as token, pos // 16 % 2 as layer, pos // 32 as head, x as score, (idx + pos % 16) % 3 > 0 as mask from x) select passage, round(sum(case when mask then score else 0 end) / (count(distinct case when mask then token end) * 4), 6) as score from t group by passage")
def crossattn_score(s, d):
    """Components of an embedding as the attention on 16 tokens in 2 layers of 2 heads."""
    pos = F.col("pos")
    t = N.features(nodes(s, d), 64).select(F.col("idx").alias("passage"), (pos % 16).alias("token"), F.floor(pos / 16 % 2).alias("layer"), F.floor(pos / 32).alias("head"), F.col("x").alias("score"), ((F.col("idx") + pos % 16) % 3 > 0).alias("mask"))
    return N.cross_attention(t, 2, 2)


#: Fixed weights of a matrix, the same in both engines.
WEIGHT = "(({p} * 31 + {o} * 17 + {seed}) % 13 - 6) / 20.0::double"


def _weights(s, places: int, outs: int, seed: int) -> DataFrame:
    w = (((F.col("pos") * 31 + F.col("out") * 17 + seed) % 13) - 6) / F.lit(20.0)
    return s.range(places).select(F.col("id").cast("int").alias("pos")).withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(outs - 1)))).withColumn("w", w)


def _matrix_sql(name: str, places: int, outs: int, seed: int) -> str:
    return f", {name} as (select p as pos, o as out, {WEIGHT.format(p='p', o='o', seed=seed)} as w from unnest(range({places})) a(p), unnest(range({outs})) b(o))"


def _sage_sql(k: int, x: str) -> str:
    return f", m{k} as (select e.dst as idx, {x}.pos, max({x}.x) as x from e join {x} on {x}.idx = e.src group by e.dst, {x}.pos), l{k} as (select idx, out as pos, sum(v) as x from (select idx, out, x * w as v from {x} join own{k} using (pos) union all select idx, out, x * w from m{k} join their{k} using (pos)) group by idx, out), r{k} as (select idx, pos, greatest(x, 0.0) as x from l{k})"


@query(FEAT.replace("{", "{{").replace("}", "}}").format() + _matrix_sql("own1", 64, 16, 1) + _matrix_sql("their1", 64, 16, 2) + _matrix_sql("own2", 16, 16, 3) + _matrix_sql("their2", 16, 16, 4) + _matrix_sql("fin", 16, 8, 5) + _sage_sql(1, "x") + _sage_sql(2, "r1") + " select idx, cast(out as int) as pos, round(sum(x * w), 4) as h from r2 join fin using (pos) group by idx, out")
def sage_encoder(s, d):
    """Two layers with maximum aggregation and given weights, relu after each, and a final linear one."""
    x, e = N.features(nodes(s, d), 64), edges(s, d)
    for k, (wide, out) in enumerate(((64, 16), (16, 16))):
        x = N.relu(N.sage(x, e, _weights(s, wide, out, 1 + 2 * k), _weights(s, wide, out, 2 + 2 * k)))
    return N.linear(x, _weights(s, 16, 8, 5)).select("idx", "pos", F.round("x", 4).alias("h"))


def _pair_features(s, d, target: DataFrame) -> DataFrame:
    """(idx, pos, x): each node's unit vector, then its target's; ``target`` is (idx, target)."""
    n = nodes(s, d).select("idx", F.col("embedding").cast("array<double>").alias("v"))
    unit = n.select("idx", F.transform("v", lambda x: x / V.norm(F.col("v"))).alias("u"))
    pair = target.join(unit, "idx").join(unit.select(F.col("idx").alias("target"), F.col("u").alias("t")), "target")
    return pair.select("idx", F.posexplode(F.concat("u", "t")).alias("pos", "x"))


UNIT = ", un as (select idx, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from nodes), pr as (select t.idx, list_concat(a.u, b.u) as z from tg t join un a on a.idx = t.idx join un b on b.idx = t.target), px as (select idx, k - 1 as pos, z[k] as x from pr, (select unnest(range(1, 129)) as k))" + _matrix_sql("w1", 128, 16, 7) + _matrix_sql("w2", 16, 1, 8) + ", hd as (select idx, w1.out as pos, greatest(sum(x * w), 0.0) as x from px join w1 using (pos) group by idx, w1.out)"
MLP = " select idx, round(sum(x * w), 5) as score from hd join w2 using (pos) group by idx"


def _mlp(s, pairs: DataFrame) -> DataFrame:
    return N.decoded(pairs, _weights(s, 128, 16, 7), _weights(s, 16, 1, 8).select("pos", "w")).withColumn("score", F.round("score", 5))


@query(", tg as (select n.idx, t.target from nodes n join (select file_id, max(idx) as target from nodes where node_type = 1 group by file_id) t using (file_id) where n.node_type in (1, 2) and n.idx <> t.target)" + UNIT + MLP)
def link_decoder(s, d):
    """Functions and classes of a file against its last function, by a network over their unit vectors."""
    n = nodes(s, d).select("idx", "file_id", "node_type")
    last = n.where("node_type = 1").groupBy("file_id").agg(F.max("idx").alias("target"))
    return _mlp(s, _pair_features(s, d, n.where("node_type in (1, 2)").join(last, "file_id").where("idx <> target").select("idx", "target")))


@query(", tg as (select idx, cast(floor(idx / 50) * 50 as bigint) as target from nodes where idx % 50 > 0)" + UNIT + MLP)
def rerank_decoder(s, d):
    """Candidates of each seed (the nodes up to the next one) by a network over candidate and query."""
    n = nodes(s, d).where("idx % 50 > 0").select("idx", (F.floor(F.col("idx") / 50) * 50).cast("long").alias("target"))
    return _mlp(s, _pair_features(s, d, n))


@query(", k as (select idx, node_type, row_number() over (partition by node_type order by idx) - 1 as pos from nodes) select node_type as kind, pos, row_number() over (order by node_type, pos) - 1 as idx from k")
def homogenised_nodes(s, d):
    n = nodes(s, d).select("idx", "node_type")
    parts = [numbered(n.where(F.col("node_type") == k), "idx", name="pos").select(F.col("node_type").alias("kind"), "pos") for k in (0, 1, 2)]
    return G.homogenised(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(COS + ", t as (select idx, node_type from nodes) select query, sc.idx, node_type, score from sc join t on t.idx = sc.idx")
def hetero_cosine(s, d):
    """Cosines type by type, put back in one table."""
    n = nodes(s, d)
    parts = [V.scores(_seed_queries(s, d), n.where(F.col("node_type") == k), "cosine").withColumn("node_type", F.lit(k)) for k in (0, 1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(FEAT + ", s as (select e.dst as idx, x.pos, sum(greatest(x.x, 0.0)) as s from e join x on x.idx = e.src group by e.dst, x.pos) select x.idx, cast(x.pos as int) as pos, round(1.5 * x.x + coalesce(s.s, 0.0), 5) as h from x left join s on s.idx = x.idx and s.pos = x.pos")
def gin_layer(s, d):
    return N.gin(N.features(nodes(s, d), 64), edges(s, d), 0.5)


@query(FEAT + ", s as (select e.dst as idx, x.pos, sum(x.x / (1 + exp(-(x.x + y.x)))) as s from e join x on x.idx = e.src join x y on y.idx = e.dst and y.pos = x.pos group by e.dst, x.pos) select x.idx, cast(x.pos as int) as pos, round(x.x + coalesce(s.s, 0.0), 5) as h from x left join s on s.idx = x.idx and s.pos = x.pos")
def gated_layer(s, d):
    return N.gated(N.features(nodes(s, d), 64), edges(s, d))


@query(FEAT + _matrix_sql("wa", 64, 2, 9) + ", dt as (select idx, sum(x * a.w) as s, sum(x * b.w) as t from x join wa a on a.pos = x.pos and a.out = 0 join wa b on b.pos = x.pos and b.out = 1 group by idx), l as (select src, dst from e union select idx, idx from nodes), sc as (select l.src, l.dst, case when u.s + v.t > 0 then u.s + v.t else 0.2 * (u.s + v.t) end as a from l join dt u on u.idx = l.src join dt v on v.idx = l.dst), ex as (select src, dst, exp(a - max(a) over (partition by dst)) as e from sc), atn as (select src, dst, e / sum(e) over (partition by dst) as p from ex) select atn.dst as idx, cast(x.pos as int) as pos, round(sum(x.x * p), 5) as h from atn join x on x.idx = atn.src group by atn.dst, x.pos")
def attention_layer(s, d):
    w = _weights(s, 64, 2, 9)
    side = lambda k: w.where(F.col("out") == k).select("pos", "w")
    return N.attended(N.features(nodes(s, d), 64), edges(s, d), side(0), side(1))


@query(INTER + ", f as (select u, v, i11 as f0, i21 - i11 as f1, i12 - i11 as f2, i22 - i11 - (i21 - i11) - (i12 - i11) as f3, a1, a2, b1, b2 from j), g as (select *, b1 - (f0 + f1) as f4, a1 - f0 - f2 as f5 from f), h as (select u, v, greatest(f0, 0) as f_1_1, greatest(f1, 0) as f_2_1, greatest(f2, 0) as f_1_2, greatest(f3, 0) as f_2_2, greatest(f4, 0) as f_0_1, greatest(f5, 0) as f_1_0, greatest(b2 - (f0 + f1 + f2 + f3 + f4), 0) as f_0_2, greatest(a2 - f0 - (f0 + f1 + f2 + f3) - f5, 0) as f_2_0 from g) select * from h")
def labelled_features_h2(s, d):
    """Link features under the names of their pairs of hops."""
    return H.labelled(H.link_features(_links(s, d), materialised(H.khop_sets(nodes(s, d), _feeds(s, d), 2)), 2), 2)


@query("with r as (select turn % 4 as category, case when conv_id % 2 = 0 then 'graph' else 'search' end as system, length(text) % 2 as hit from conversations) select category, round(avg(hit) filter (where system = 'graph'), 6) as graph, round(avg(hit) filter (where system = 'search'), 6) as search from r group by category", False)
def category_report(s, d):
    """Accuracy by category of context, a column a system."""
    r = table(s, d, "conversations").select((F.col("turn") % 4).alias("category"), F.when(F.col("conv_id") % 2 == 0, "graph").otherwise("search").alias("system"), (F.length("text") % 2).alias("hit"))
    return r.groupBy("category").pivot("system", ["graph", "search"]).agg(F.round(F.avg("hit"), 6))


@query("with r as (select (row_number() over (order by conv_id, turn) - 1) // 8 as batch, length(text) % 2 as hit from conversations), b as (select batch, sum(hit) as metric, count(*) as n from r group by batch) select round(sum(metric) / sum(n), 6) as mean, count(*) as batches from b", False)
def mean_batch_metric(s, d):
    """Sums of batches of eight over the number of samples."""
    r = numbered(table(s, d, "conversations").select("conv_id", "turn", (F.length("text") % 2).alias("hit")), "conv_id", "turn")
    b = r.groupBy(F.floor(F.col("nr") / 8).alias("batch")).agg(F.sum("hit").alias("metric"), F.count("*").alias("n"))
    return b.agg(F.round(F.sum("metric") / F.sum("n"), 6).alias("mean"), F.count("*").alias("batches"))


@query("with b as (select item_id, row_number() over (order by item_id) - 1 as nr from benchmark), c as (select doc_id, row_number() over (order by doc_id) - 1 as nr from documents) select nr // 8 as batch, item_id, doc_id from b join c using (nr)", False)
def zipped_contexts(s, d):
    """The k-th sample with the k-th context, in batches of eight; the longer side's rest is left out."""
    b, c = (numbered(table(s, d, t).select(k), k) for t, k in (("benchmark", "item_id"), ("documents", "doc_id")))
    return b.join(c, "nr").select(F.floor(F.col("nr") / 8).alias("batch"), "item_id", "doc_id")


@query(" select a.idx as query, list(n.name order by t.k) as texts from seeds a, (select unnest(range(1, 6)) as k) t join nodes n on n.idx = (a.idx + t.k * 7) % (select count(*) from nodes) group by a.idx")
def context_texts(s, d):
    """Lists of context ids to their texts, in the order of the lists."""
    n = nodes(s, d)
    lists = seeds(s, d).select(F.col("idx").alias("query"), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: (F.col("idx") + k * 7) % n.count()).alias("ids"))
    each = lists.select("query", F.posexplode("ids").alias("k", "idx")).join(n.select("idx", "name"), "idx")
    return each.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda r: r["name"]).alias("texts"))


@query("select source, sum(length(text))::bigint as chars from documents group by source", False)
def total_chars(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"))


@query("select event_type, median(value) as med from events group by event_type", False)
def median_value(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.median("value").alias("med"))


@query("select doc_id from documents where doc_id % 2 = 0 union all select doc_id from documents where doc_id % 2 = 1", False)
def union_all_shards(s, d):
    """Two shards that make the whole."""
    t = table(s, d, "documents").select("doc_id")
    return M.modulo_shard(t, "doc_id", 0, 2).unionByName(M.modulo_shard(t, "doc_id", 1, 2))


@query("select doc_id from documents except select doc_id from labels", False)
def except_done(s, d):
    return table(s, d, "documents").select("doc_id").subtract(table(s, d, "labels").select("doc_id"))


@query(" select src, list_filter(list(dst order by dst), lambda x: x <> src + 1) as rest from edges group by src")
def array_remove_gold(s, d):
    g = edges(s, d).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("x"))
    return g.select("src", F.array_remove("x", F.col("src") + 1).alias("rest"))


@query(", e as (select distinct src, dst from edges) select a.src as u, b.src as v, count(*) as n from e a join e b on a.dst = b.dst and a.src < b.src where a.src % 50 = 0 group by a.src, b.src")
def intersect_neighbours(s, d):
    e = edges(s, d).select("src", "dst").distinct()
    return e.where("src % 50 = 0").select(F.col("src").alias("u"), "dst").join(e.select(F.col("src").alias("v"), "dst"), "dst").where("u < v").groupBy("u", "v").agg(F.count("*").alias("n"))
