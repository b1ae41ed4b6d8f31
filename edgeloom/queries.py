"""The registered queries over graph views, and the SQL that says the same.

Three views serve: the directed user graph, the undirected part graph, and the undirected nation graph of 25 vertices.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import stats
from edgeloom.functions.rng import digest
from edgeloom.graph import Graph, based, canonical, keep, release, remove_folder, shared_folder
from edgeloom.operators import between, distances, flow, generators, linalg, metrics, neighbors, normalize, sparsify, traverse
from edgeloom.plans import profile, summary, sweep
from edgeloom.sources import files
from edgeloom.sources.views import nation_graph, part_graph, part_supplier_graph, supplier_graph, user_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

USER = """p as (select lag(user_id) over (order by ts, event_id) src, user_id dst from events),
e as materialized (select src, dst, cast(count(*) as double) w from p where src is not null and src <> dst group by src, dst),
v as (select distinct user_id id from events)"""
PART = """x as (select distinct l_orderkey, l_partkey from lineitem),
e as materialized (select a.l_partkey src, b.l_partkey dst, cast(count(*) as double) w from x a join x b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by 1, 2),
v as (select p_partkey id from part)"""
NATION = """raw as (select cast(c_nationkey as bigint) a, cast(s_nationkey as bigint) b from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey),
e as materialized (select least(a, b) src, greatest(a, b) dst, cast(count(*) as double) w from raw where a <> b group by 1, 2),
v as (select cast(n_nationkey as bigint) id from nation)"""
#: The user graph as an undirected one.
_SYM = USER.replace("e as materialized (", "a as materialized (").replace("v as (", "e as materialized (select least(src, dst) src, greatest(src, dst) dst, sum(w) w from a group by 1, 2), v as (")
BOTH = "n as materialized (select src, dst, w from e union all select dst, src, w from e), d as materialized (select v.id, count(n.src) deg from v left join n on n.src = v.id group by v.id)"
#: Common neighbours of the ends of each edge.
COMMON = f"""{BOTH}, c as (select e.src, e.dst, count(*) c from e join n a on a.src = e.src join n b on b.src = e.dst and b.dst = a.dst group by 1, 2),
s as materialized (select e.src, e.dst, e.w, cast(coalesce(c.c, 0) as bigint) common, du.deg du, dv.deg dv from e left join c using (src, dst) join d du on du.id = e.src join d dv on dv.id = e.dst)"""


def h(seed: int, *keys: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


def u(x: str, at: int = 1) -> str:
    return f"(cast(('0x' || substr({x}, {at}, 8)) as bigint) / 4294967296.0)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _edges(name: str, view: Callable[[SparkSession, str], Graph], make: Callable[[Graph], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(lambda spark, d: make(view(spark, d)))


def _symmetric_user(spark: SparkSession, d: str) -> Graph:
    g = user_graph(spark, d)
    return Graph(g.vertices, canonical(g.edges))


# -- conversions ----------------------------------------------------------------------------------------------------------

_edges("user_graph", user_graph, lambda g: g.edges, f"with {USER} select src, dst, w from e")
_edges("part_graph", part_graph, lambda g: g.edges, f"with {PART} select src, dst, w from e")
_edges("supplier_graph", supplier_graph, lambda g: g.edges, f"with {PART.replace('l_partkey', 'l_suppkey')} select src, dst, w from e")
_edges("nation_graph", nation_graph, lambda g: g.edges, f"with {NATION} select src, dst, w from e")
_edges("part_supplier_graph", part_supplier_graph, lambda g: g.edges, "select l_partkey src, l_suppkey + (select max(p_partkey) + 1 from part) dst, cast(count(*) as double) w from lineitem group by 1, 2")
_edges("duw_to_uduw", user_graph, lambda g: normalize.to_undirected(g.edges).select("src", "dst"), f"with {USER} select src, dst from e where src < dst")
_edges("dw_to_udw", user_graph, lambda g: normalize.to_undirected(g.edges), f"with {USER} select src, dst, w from e where src < dst")
_edges("uduw_to_duw", part_graph, lambda g: normalize.to_directed(g.edges).select("src", "dst"), f"with {PART}, {BOTH} select src, dst from n")
_edges("udw_to_dw", part_graph, lambda g: normalize.to_directed(g.edges), f"with {PART}, {BOTH} select src, dst, w from n")
_edges("symmetrize", user_graph, lambda g: normalize.symmetrize(g.edges).select("src", "dst"), f"with {USER} select src, dst from e union select dst, src from e")
_edges("symmetrize_weighted", user_graph, lambda g: normalize.symmetrize(g.edges, True), f"with {USER} select src, dst, w from e union select dst, src, w from e")
_edges("unweight", user_graph, lambda g: normalize.unweight(g.edges), f"with {USER} select src, dst, cast(1 as double) w from e")
_edges("squish", user_graph, lambda g: normalize.squish(g.edges.unionByName(g.edges.withColumn("w", F.col("w") + 1))), f"with {USER} select src, dst, w from e where src <> dst")
_edges("sort_edges", user_graph, lambda g: normalize.sort_edges(g.edges), f"with {USER} select src, dst, w from e order by src, dst")
_edges("zero_to_one_base", user_graph, lambda g: normalize.rebase(g.edges), f"with {USER} select src + 1 src, dst + 1 dst, w from e")
_edges("is_symmetric", user_graph, lambda g: normalize.is_symmetric(g.edges), f"with {USER} select count(*) = 0 as symmetric from e a where not exists (select 1 from e b where b.src = a.dst and b.dst = a.src)")
_edges("asymmetric_edges", user_graph, lambda g: normalize.asymmetric(g.edges), f"with {USER} select src, dst from e a where not exists (select 1 from e b where b.src = a.dst and b.dst = a.src)")
_RENUMBER = f"""with {USER}, f as (select src, dst, row_number() over (order by src, dst) rn from e),
a as (select src id, 0 part, min(rn) rn from f group by 1 union all select dst, 1, min(rn) from f group by 1),
m as (select id old_id, min(part * 1000000000 + rn) k from a group by 1), i as (select old_id, cast(row_number() over (order by k) - 1 as bigint) new_id from m)"""
_edges("renumber_map", user_graph, lambda g: normalize.renumber(g.edges)[1], f"{_RENUMBER} select old_id, new_id from i")
_edges("renumber_dense", user_graph, lambda g: normalize.renumber(g.edges)[0], f"{_RENUMBER} select a.new_id src, b.new_id dst, w from e join i a on a.old_id = e.src join i b on b.old_id = e.dst")
_edges("relabel_by_degree", _symmetric_user, lambda g: normalize.relabel_by_degree(g).edges, f"with {_SYM}, {BOTH}, i as materialized (select id, cast(row_number() over (order by deg desc, id desc) - 1 as bigint) r from d) select least(a.r, b.r) src, greatest(a.r, b.r) dst, w from e join i a on a.id = src join i b on b.id = dst")
_edges("match_reference", user_graph, lambda g: normalize.match_reference(g.edges, g.edges.where("w > 1")), f"with {USER} select src, dst, w from e where w > 1")
_edges("degrees", user_graph, normalize.degree_table, f"""with {USER}, o as (select src id, count(*) c, sum(w) s from e group by 1), i as (select dst id, count(*) c, sum(w) s from e group by 1)
select v.id, coalesce(o.c, 0) out_deg, coalesce(i.c, 0) in_deg, coalesce(i.s, 0) in_weight, coalesce(o.s, 0) out_weight from v left join o using (id) left join i using (id)""")
_edges("graph_overview", part_graph, lambda g: normalize.overview(g).withColumn("avg_degree", F.round("avg_degree", 6)).withColumn("density", F.round("density", 9)), f"""with {PART}, {BOTH}
select count(*) n, cast(count(*) filter (deg = 0) as bigint) isolated, min(deg) min_degree, max(deg) max_degree, round(avg(deg), 6) avg_degree, (select count(*) from e) m, cast(0 as bigint) loops, round((select count(*) from e) / (count(*) * (count(*) - 1) / 2.0), 9) density from d""")

# -- pruning --------------------------------------------------------------------------------------------------------------

RATES = [0.1, 0.3, 0.5, 0.7, 0.9]
_V = f"p(prune_rate, ratio) as (values {', '.join(f'(cast({r} as double), cast({1 - r!r} as double))' for r in RATES)})"


def _ranked(rank: str, algo: str, run: int = 0) -> str:
    return f"select src, dst, w, '{algo}' algo, prune_rate, {run} run from ({rank}) r, p where rank <= floor(ratio * (select count(*) from e) + 0.5)"


def _by_score(score: str) -> str:
    return f"select src, dst, w, row_number() over (order by {score} desc, src, dst) rank from s"


_RANDOM = f"with {PART}, {_V} " + _ranked(f"select *, row_number() over (order by {h(7, 'src', 'dst')}, src, dst) rank from e", "random", 7)
_edges("random_edge", part_graph, lambda g: sparsify.random_edges(g, RATES), _RANDOM)
_edges("jaccard_scores", part_graph, lambda g: neighbors.jaccard(g).select("src", "dst", "common", F.round("score", 9).alias("score")), f"with {PART}, {COMMON} select src, dst, common, round(common / (du + dv - common), 9) score from s")
_edges("gspar", part_graph, lambda g: sparsify.g_spar(g, RATES), f"with {PART}, {COMMON}, {_V} " + _ranked(_by_score("common / (du + dv - common)"), "gspar"))
_edges("scan", part_graph, lambda g: sparsify.scan(g, RATES), f"with {PART}, {COMMON}, {_V} " + _ranked(_by_score("(common + 2) / sqrt(cast((du + 1) * (dv + 1) as double))"), "scan"))
_LOCAL = "l as (select least(src, dst) src, greatest(src, dst) dst, max(w) w, max(case when deg = 1 then 1 else round(1 - ln(rk) / ln(deg), 9) end) sc from k group by 1, 2)"
_edges("local_degree", part_graph, lambda g: sparsify.local_degree(g, RATES), f"""with {PART}, {BOTH}, {_V}, k as (select n.src, n.dst, n.w, a.deg, row_number() over (partition by n.src order by b.deg desc, n.dst) rk from n join d a on a.id = n.src join d b on b.id = n.dst), {_LOCAL} """ + _ranked("select src, dst, w, row_number() over (order by sc desc, src, dst) rank from l", "local_degree"))
_SIMILAR = "j as (select src, dst, w, common / (du + dv - common) j, du deg from s union all select dst, src, w, common / (du + dv - common), dv from s), k as (select *, row_number() over (partition by src order by j desc, dst) rk from j)"
_edges("local_similarity", part_graph, lambda g: sparsify.local_similarity(g, RATES), f"with {PART}, {COMMON}, {_V}, {_SIMILAR}, {_LOCAL} " + _ranked("select src, dst, w, row_number() over (order by sc desc, src, dst) rank from l", "local_similarity"))
_UNION = "select least(src, dst) src, greatest(src, dst) dst, max(w) w from k where {} group by 1, 2"
_edges("lspar", part_graph, lambda g: sparsify.l_spar(g, 0.5), f"with {PART}, {COMMON}, {_SIMILAR} " + _UNION.format("rk <= floor(power(deg, 0.5) + 1e-9)"))
_edges("k_neighbor", part_graph, lambda g: sparsify.k_neighbor(g, 8), f"with {PART}, {BOTH}, k as (select *, row_number() over (partition by src order by {h(7, 'src', 'dst')}, dst) rk from n) " + _UNION.format("rk <= 8"))
for _side, _key in (("out", "src"), ("in", "dst")):
    _edges(f"{_side}_degree_cap", user_graph, lambda g, s=_side: sparsify.degree_cap(g, 20, s), f"with {USER}, k as (select *, row_number() over (partition by {_key} order by {h(6, 'src', 'dst')}, src, dst) rk from e) select src, dst, w from k where rk <= 20")
_edges("sym_degree_cap", part_graph, lambda g: sparsify.symmetric_degree_cap(g, 60), f"""with {PART}, a as (select src v, src, dst, w, {h(6, 'src', 'dst')} h from e union all select dst, src, dst, w, {h(6, 'src', 'dst')} from e),
k as (select *, row_number() over (partition by v order by h, src, dst) rk from a) select src, dst, max(w) w from k where rk <= 60 group by 1, 2 having count(*) = 2""")
_edges("bernoulli_edge", user_graph, lambda g: sparsify.bernoulli(g.edges, 0.4), f"with {USER} select src, dst, w from e where {u(h(1, 'src', 'dst'))} < 0.6")
_edges("bernoulli_symmetric", user_graph, lambda g: normalize.symmetrize(sparsify.bernoulli(g.edges, 0.4)).select("src", "dst"), f"with {USER}, k as (select src, dst from e where {u(h(1, 'src', 'dst'))} < 0.6) select src, dst from k union select dst, src from k")
_edges("cut_sparsify", part_graph, lambda g: sparsify.cut_sparsify(g, g.vertices.count()), f"with {PART} select src, dst, w from e where {u(h(7, 'src', 'dst'))} < least(1, 16 * 3 * ln((select count(*) from v)) / 100 / 10)")
_edges("pruned_edges", user_graph, lambda g: normalize.removed(g.edges, sparsify.bernoulli(g.edges, 0.4)), f"with {USER} select src, dst, w from e where not {u(h(1, 'src', 'dst'))} < 0.6")
_edges("over_degree", user_graph, lambda g: sparsify.over_degree(g.edges, 50), f"with {USER} select count(*) n from (select dst from e group by dst having count(*) > 50)")
#: An edge is in the minimum spanning forest if no other way joins its ends by smaller edges only: least largest edges by doubling.
_WAYS = ", ".join(f"m{i + 1} as materialized (select a, b, min(r) r from (select a, b, r from m{i} union all select x.a, y.b, greatest(x.r, y.r) from m{i} x join m{i} y on x.b = y.a where x.a <> y.b) group by 1, 2)" for i in range(8))
_edges("spanning_forest", _symmetric_user, traverse.spanning_forest, f"""with {_SYM}, o as materialized (select *, row_number() over (order by {h(7, 'src', 'dst')}, src, dst) r from e),
m0 as materialized (select src a, dst b, r from o union all select dst, src, r from o), {_WAYS} select src, dst, w from o join m8 on a = src and b = dst and m8.r = o.r""")
_edges("rank_degree", _symmetric_user, lambda g: traverse.rank_degree(g, 0.3))
_edges("forest_fire", _symmetric_user, lambda g: traverse.forest_fire(g, 0.3))
_edges("spanner", nation_graph, lambda g: flow.greedy_spanner(g, 3))

# -- effective resistance ---------------------------------------------------------------------------------------------------

_edges("laplacian", part_graph, linalg.laplacian, f"with {PART}, {BOTH} select src i, src j, sum(w) v from n group by 1 union all select src, dst, -w from n")
_edges("incidence", part_graph, lambda g: linalg.incidence(g).withColumn("v", F.round("v", 9)), f"with {PART} select src, dst, src node, round(sqrt(w), 9) v from e union all select src, dst, dst, round(-sqrt(w), 9) from e")
_edges("er_exact_small", nation_graph, lambda g: linalg.resistance_exact(g).withColumn("r", F.round("r", 9)))
_edges("er_probability", nation_graph, lambda g: linalg.probabilities(linalg.resistance_exact(g)).withColumn("p", F.round("p", 9)).withColumn("r", F.round("r", 9)))
_edges("er_approximate", _symmetric_user, lambda g: linalg.resistance(g).withColumn("r", F.round("r", 6)))
_edges("er_sample", nation_graph, lambda g: linalg.er_sample(linalg.probabilities(linalg.resistance_exact(g)), linalg.draws(25, 0.5)))
_edges("er_sample_min1", nation_graph, lambda g: linalg.er_sample_min1(linalg.resistance_exact(g), 25, 1.0))
_BIT = "((cast(('0x' || substr(md5(concat_ws(':', '7:0', {})), 1 + vector // 32 * 8, 8)) as bigint) >> (vector % 32)) & 1)"
_QF = f"select vector, sum(w * case when {_BIT.format('src')} <> {_BIT.format('dst')} then 4 else 0 end) q from e, (select unnest(range(100)) vector) group by 1"
_edges("quadratic_form", part_graph, lambda g: linalg.random_forms(g.edges, 100), f"with {PART} select cast(vector as integer) vector, q from ({_QF})")
_NORMAL = f"x as materialized (select vector, id, sqrt(-2 * ln(1 - {u(h(7, 'vector', 'id'))})) * cos(2 * pi() * {u(h(7, 'vector', 'id'), 9)}) x from v, (select unnest(range(100)) vector))"
_FORMS = f"""with {_SYM}, {_V.replace('p(', 'pr(')}, r as materialized ({_RANDOM.split(_V)[1].strip().replace(', p where', ', pr where')}), {_NORMAL}, g as (select a.vector, sum(w * power(a.x - b.x, 2)) q from e join x a on a.id = src join x b on b.id = dst and b.vector = a.vector group by 1),
k as (select algo, prune_rate, run, a.vector, sum(w * power(a.x - b.x, 2)) q from r join x a on a.id = src join x b on b.id = dst and b.vector = a.vector group by all)
select algo, cast(prune_rate as double) prune_rate, run, round(min(k.q / g.q), 6) ratio_min, round(max(k.q / g.q), 6) ratio_max, round(avg(k.q / g.q), 6) ratio_mean, round(stddev_pop(k.q / g.q), 6) ratio_std from k join g using (vector) group by all"""


@query("form_similarity", _FORMS)
def _form_similarity(spark: SparkSession, d: str) -> DataFrame:
    g = _symmetric_user(spark, d)
    t = linalg.form_similarity(sparsify.random_edges(g, RATES), g, metrics.KEYS)
    return t.select(*metrics.KEYS, *(F.round(c, 6).alias(c) for c in t.columns if c not in metrics.KEYS))


_edges("er_sweep", nation_graph, lambda g: linalg.er_sweep(linalg.probabilities(linalg.resistance_exact(g)), 25, [0.3, 0.5, 1.0], 2))
_edges("top_eigenvalues", nation_graph, lambda g: linalg.top_eigenvalues(g, rounds=15).withColumn("value", F.round("value", 3)))
_edges("electrical_closeness", nation_graph, lambda g: linalg.electrical_closeness(g).withColumn("score", F.round("score", 9)))

# -- properties -------------------------------------------------------------------------------------------------------------

_edges("global_clustering", part_graph, lambda g: traverse.global_clustering(g).withColumn("transitivity", F.round("transitivity", 9)), f"""with {PART}, {COMMON}, t as (select cast(sum(common) / 3 as bigint) t from s), w as (select cast(sum(deg * (deg - 1) // 2) as bigint) w from d)
select t triangles, w triples, round(3 * t / w, 9) transitivity from t, w""")
_edges("local_clustering", part_graph, lambda g: traverse.local_clustering(g).withColumn("score", F.round("score", 9)), f"""with {PART}, {COMMON}, t as (select id, sum(common) / 2 t from (select src id, common from s union all select dst, common from s) group by 1)
select d.id, round(case when deg > 1 then 2 * coalesce(t, 0) / (deg * (deg - 1)) else 0 end, 9) score from d left join t using (id)""")
_edges("directed_clustering", user_graph, lambda g: traverse.directed_clustering(g).withColumn("score", F.round("score", 9)), f"""with {USER}, d as (select src id, count(*) deg from e group by 1), t as (select x.src id, count(*) t from e x join e z on x.dst = z.src join e y on y.src = x.src and y.dst = z.dst group by 1)
select v.id, round(case when deg > 1 then coalesce(t, 0) / (deg * (deg - 1)) else 0 end, 9) score from v left join d using (id) left join t using (id)""")
_edges("degree_centrality", part_graph, metrics.degree_centrality, f"with {PART}, {BOTH} select id, cast(deg as double) score from d")
_edges("laplacian_centrality", part_graph, linalg.laplacian_centrality, f"with {PART}, {BOTH}, m as (select n.src id, sum(d.deg) s from n join d on d.id = n.dst group by 1) select d.id, cast(deg * deg + deg + 2 * coalesce(s, 0) as double) score from d left join m using (id)")


def _iterate(prelude: str, start: str, step: str, rounds: int, last: str) -> str:
    return f"with {prelude}, x0 as materialized ({start}), " + ", ".join(f"x{i + 1} as materialized ({step.replace('XX', f'x{i}')})" for i in range(rounds)) + " " + last.replace("XX", f"x{rounds}")


_PR = "o as materialized (select src, sum(w) s from e group by 1), t as materialized (select e.src, e.dst, w / s p from e join o using (src))"
_edges("pagerank", user_graph, lambda g: linalg.pagerank(g, 10).withColumn("score", F.round("score", 9)), _iterate(f"{USER}, {_PR}", "select id, 1.0 / (select count(*) from v) score from v", "select v.id, 0.85 * coalesce(y.g, 0) + 0.15 / (select count(*) from v) * (select sum(score) from XX) score from v left join (select dst, sum(p * score) g from t join XX on id = src group by 1) y on y.dst = v.id", 10, "select id, round(score, 9) score from XX"))


def _power_sql(alpha: float, beta: float, rounds: int) -> str:
    step = f"select id, z / sqrt(sum(z * z) over ()) score from (select v.id, {alpha} * coalesce(y.g, 0) + {beta} z from v left join (select dst, sum(w * score) g from e join XX on id = src group by 1) y on y.dst = v.id)"
    return _iterate(USER, "select id, 1.0 / sqrt((select count(*) from v)) score from v", step, rounds, "select id, round(score, 9) score from XX")


_edges("katz", user_graph, lambda g: linalg.katz(g, 6).withColumn("score", F.round("score", 9)), _power_sql(0.5, 1.0, 6))
_edges("eigenvector", user_graph, lambda g: linalg.eigenvector(g, 6).withColumn("score", F.round("score", 9)), _power_sql(1.0, 0.0, 6))
_HITS = "select id, z / sqrt(sum(z * z) over ()) score from (select v.id, coalesce(y.g, 0) z from v left join (select {to} k, sum(w * score) g from e join {x} on id = {frm} group by 1) y on y.k = v.id)"
_HIT_STEPS = ", ".join(f"a{i} as materialized ({_HITS.format(to='dst', frm='src', x=f'h{i - 1}')}), h{i} as materialized ({_HITS.format(to='src', frm='dst', x=f'a{i}')})" for i in range(1, 5))
_edges("hits", user_graph, lambda g: linalg.hits(g, 4).withColumn("score", F.round("score", 6)).withColumn("hub", F.round("hub", 6)), f"with {USER}, h0 as materialized (select id, 1.0 / sqrt((select count(*) from v)) score from v), {_HIT_STEPS} select id, round(h4.score, 6) hub, round(a4.score, 6) score from a4 join h4 using (id)")
_SRC = "(select id from v order by md5(concat_ws(':', '7', id)), id limit {})"
#: More rounds than any of these graphs needs: distances no longer change then.
_FAR = 12


def _rounds(sources: str, n: str = "n", x: str = "x") -> str:
    """Distances (source, id, dist) from the sources (id) by rounds of relaxation; the last are x followed by _FAR."""
    step = "select source, id, min(dist) dist from (select source, id, dist from XX union all select x.source, n.dst, x.dist + 1 from XX x join NN n on n.src = x.id where x.dist = RR) group by 1, 2".replace("NN", n)
    return f"{x}0 as materialized (select id source, id, 0 dist from {sources} q), " + ", ".join(f"{x}{i + 1} as materialized ({step.replace('XX', f'{x}{i}').replace('RR', str(i))})" for i in range(_FAR))


def _reach(prelude: str, sources: str, last: str) -> str:
    return f"with {prelude}, {BOTH}, {_rounds(sources)} " + last.replace("XX", f"x{_FAR}")


def _labels(rounds: int) -> str:
    step = "select l.id, least(l.comp, coalesce(min(o.comp), l.comp)) comp from XX l left join n on n.src = l.id left join XX o on o.id = n.dst group by l.id, l.comp"
    return ", ".join(f"c{i + 1} as materialized ({step.replace('XX', f'c{i}')})" for i in range(rounds))


_BFS = _reach(PART, _SRC.format(5), "select source, id, cast(dist as double) dist from XX")


def _sources(g: Graph, n: int) -> DataFrame:
    return traverse.sample_vertices(g, n).select(F.col("id").alias("source"))


def _five(g: Graph) -> DataFrame:
    return _sources(g, 5)


_edges("bfs_distances", part_graph, lambda g: traverse.distances(g, _five(g)), _BFS)
_edges("connected_components", part_graph, traverse.connected_components, f"with {PART}, {BOTH}, c0 as materialized (select id, id comp from v), {_labels(_FAR)} select id, comp from c{_FAR}")
_CORE = "select v.id, coalesce(max(least(z.c, z.upto)), 0) c from v left join (select y.id, c, sum(count(*)) over (partition by y.id order by c desc) upto from (select n.src id, XX.c from n join XX on XX.id = n.dst) y group by y.id, c) z using (id) group by v.id"


def _cores(prelude: str, rounds: int) -> str:
    steps = ", ".join(f"k{i + 1} as materialized ({_CORE.replace('XX', f'k{i}')})" for i in range(rounds))
    return f"with {prelude}, {BOTH}, k0 as materialized (select id, deg c from d), {steps} select id, cast(c as integer) core from k{rounds}"


_edges("kcore", part_graph, traverse.core_numbers, _cores(PART, 40))
_edges("kcore_nations", nation_graph, traverse.core_numbers, _cores(NATION, 25))
_edges("eccentricity", part_graph, lambda g: traverse.eccentricity(traverse.distances(g, _five(g))), _reach(PART, _SRC.format(5), "select source, case when max(dist) > 0 then cast(max(dist) as double) else 'Infinity'::double end ecc from XX group by 1"))
_HOPS = "select dist, sum(count(*)) over (order by dist) upto, sum(count(*)) over () total from XX where dist > 0 group by dist"
_edges("effective_diameter_sampled", part_graph, lambda g: traverse.effective_diameter(g, _five(g)), _reach(PART, _SRC.format(5), f"select cast(min(dist) as double) effective_diameter from ({_HOPS}) where upto >= 0.9 * total"))
_BIG = "XX where source in (select id from XX where source = (select source from XX group by 1 order by count(*) desc, 1 limit 1))"
_DIAMETER = _reach(_SYM, "v", f"select cast(min(dist) as double) effective_diameter from ({_HOPS.replace('XX where', _BIG + ' and')}) where upto >= 0.9 * total")
_edges("effective_diameter", _symmetric_user, distances.effective_diameter, _DIAMETER)
_edges("effective_diameter_sketched", _symmetric_user, lambda g: distances.effective_diameter(g, sketched=True), _DIAMETER)
_AGAIN = ", ".join(f"a{i + 1} as (select start, case when fd > best then fid else spot end spot, greatest(best, fd) best from a{i} join far on source = spot)" for i in range(8))
_edges("pseudo_diameter", _symmetric_user, lambda g: traverse.pseudo_diameter(g, _sources(g, 10)), _reach(_SYM, "v", f"""select start, cast(best as double) diameter from (with far as materialized (select source, id fid, dist fd from XX qualify row_number() over (partition by source order by dist desc, id desc) = 1),
a0 as (select id start, id spot, -1 best from {_SRC.format(10)} q), {_AGAIN} select start, best from a8)"""))
_edges("closeness_topk", _symmetric_user, lambda g: stats.top_n(distances.top_closeness(g, 100).withColumn("score", F.round("score", 9)), 100), _reach(_SYM, "v", "select id, score, cast(row_number() over (order by score desc, id) as integer) rank from (select source id, case when sum(dist) > 0 then round(cast(count(*) - 1 as double) / sum(dist) * (count(*) - 1) / ((select count(*) from v) - 1), 9) else 0.0 end score from XX group by 1) qualify rank <= 100"))


def _paths(sources: str) -> str:
    """Hops and numbers of shortest paths (source, id, dist, sigma) from the sources (id); the last are p followed by _FAR."""
    step = "select source, id, dist, sigma from XX union all select x.source, n.dst, x.dist + 1, sum(x.sigma) from XX x join n on n.src = x.id left join XX o on o.source = x.source and o.id = n.dst where x.dist = RR and o.id is null group by 1, 2, 3"
    return f"p0 as materialized (select id source, id, 0 dist, cast(1 as double) sigma from {sources} q), " + ", ".join(f"p{i + 1} as materialized ({step.replace('XX', f'p{i}').replace('RR', str(i))})" for i in range(_FAR))


_VIA = f"select a.id, sum(a.sigma * b.sigma / c.sigma) x from p{_FAR} a join p{_FAR} b on b.source = a.id join p{_FAR} c on c.source = a.source and c.id = b.id and c.dist = a.dist + b.dist where a.id <> a.source and b.id <> a.id and {{}} group by 1"
_edges("betweenness_pivot", _symmetric_user, lambda g: traverse.betweenness(g, _sources(g, 500)).withColumn("score", F.round("score", 6)), f"with {_SYM}, {BOTH}, {_paths('v')} select v.id, round(coalesce(x, 0), 6) score from v left join ({_VIA.format('a.source in ' + _SRC.format(500))}) using (id)")
_edges("betweenness_approx", _symmetric_user, lambda g: between.approximate_betweenness(g, 0.05).withColumn("score", F.round("score", 9)))
_STEPS = ", ".join(f"w{i + 1} as materialized (select walk, dst here from w{i} join nn on src = here where nth = cast(('0x' || substr({h(f'7:{i}', 'walk')}, 1, 8)) as bigint) % deg)" for i in range(5))
_edges("k_path", user_graph, traverse.k_path, f"""with {USER}, nn as materialized (select src, dst, row_number() over (partition by src order by dst) - 1 nth, count(*) over (partition by src) deg from e),
o as (select id, row_number() over (order by {h(7, 'id')}, id) - 1 r from v), w0 as materialized (select k walk, o.id here from range(1000) t(k) join o on o.r = k % (select count(*) from v)), {_STEPS}
select v.id, cast(count(here) as double) score from v left join ({' union all '.join(f'select here from w{i}' for i in range(6))}) x on here = id group by 1""")
_SOME = "(a.source, b.id) in (select s.id, t.id from (select id from v order by md5(concat_ws(':', '7s', id)), id limit 30) s, (select id from v order by md5(concat_ws(':', '7t', id)), id limit 30) t where s.id <> t.id)"
_edges("betweenness_sampled", _symmetric_user, lambda g: traverse.betweenness_sampled(g, metrics.sample_pairs(g, 30, 30).select(F.col("source").alias("s"), F.col("id").alias("t"))).withColumn("score", F.round("score", 9)), f"""with {_SYM}, {BOTH}, {_paths('v')}
select v.id, round(coalesce(x, 0) / (select count(*) from p0 a, p0 b where {_SOME}), 9) score from v left join ({_VIA.format(_SOME)}) using (id)""")
_edges("closeness_sampled", _symmetric_user, lambda g: traverse.closeness_sampled(g, _sources(g, 100)).withColumn("score", F.round("score", 9)), _reach(_SYM, _SRC.format(100), "select v.id, coalesce(round(count(*) filter (source <> v.id) / sum(dist) filter (source <> v.id), 9), 0) score from v left join XX x on x.id = v.id group by v.id"))
_edges("louvain", _symmetric_user, metrics.louvain)
_edges("largest_component", _symmetric_user, lambda g: traverse.largest_component(g.with_edges(sparsify.bernoulli(g.edges, 0.99))).vertices, f"""with {_SYM}, k as (select src, dst from e where {u(h(1, 'src', 'dst'))} < {1 - 0.99!r}),
n as materialized (select src, dst from k union all select dst, src from k), c0 as materialized (select id, id comp from v), {_labels(_FAR)} select id from c{_FAR} where comp = (select comp from c{_FAR} group by 1 order by count(*) desc, 1 limit 1)""")
_edges("label_communities", part_graph, lambda g: metrics.label_propagation(g, None))
_edges("modularity", user_graph, lambda g: metrics.modularity(g.with_edges(canonical(g.edges)), g.vertices.select("id", F.pmod("id", F.lit(7)).alias("comm"))).withColumn("modularity", F.round("modularity", 9)), f"""with {USER}, k as (select distinct least(src, dst) src, greatest(src, dst) dst from e), m as (select count(*) m from k),
s as (select c, sum(i) l, count(*) d from (select src % 7 c, case when src % 7 = dst % 7 then 1 else 0 end i from k union all select dst % 7, 0 from k) group by 1)
select count(*) communities, round(sum(l / m - power(d / (2.0 * m), 2)), 9) modularity from s, m""")
_F1 = "with {v}, a as (select id % 7 c, id from v), b as (select id % 5 c, id from v), x as (select a.c ca, b.c cb, count(*) x from a join b using (id) group by 1, 2), na as (select c, count(*) n from a group by 1), nb as (select c, count(*) n from b group by 1) select round(avg(f), 9) f1 from (select ca, max(2 * x / (na.n + nb.n)) f from x join na on na.c = ca join nb on nb.c = cb group by 1)"
_edges("cover_f1", user_graph, lambda g: metrics.cover_f1(*(g.vertices.select(F.pmod("id", F.lit(k)).alias("comm"), F.col("id").alias("node")) for k in (7, 5))).withColumn("f1", F.round("f1", 9)), _F1.format(v=USER))
_edges("overlapping_communities", user_graph, lambda g: metrics.cover(Graph(g.vertices, canonical(g.edges))))
_edges("seed_communities", user_graph, lambda g: metrics.local_communities(Graph(g.vertices, canonical(g.edges)), traverse.sample_vertices(g, 8)))
_edges("max_flow", nation_graph, lambda g: flow.max_flow(g, metrics.sample_pairs(g, 10, 10).select(F.col("source").alias("s"), F.col("id").alias("t"))))


@query("global_min_cut")
def _min_cut(spark: SparkSession, d: str) -> DataFrame:
    return flow.global_min_cut(sparsify.random_edges(nation_graph(spark, d), RATES), ["algo", "prune_rate", "run"])


_PAIRS = "pq as materialized (select a.id source, b.id from (select id from v order by md5(concat_ws(':', '7', id)), id limit 100) a join (select id from v order by md5(concat_ws(':', '8', id)), id limit 1000) b on a.id <> b.id)"
_STRETCH = f"""with {_SYM}, {BOTH}, k as materialized (select src, dst from e where {u(h(1, 'src', 'dst'))} < {1 - 0.8!r}), nk as materialized (select src, dst from k union all select dst, src from k), {_PAIRS},
{_rounds(_SRC.format(100))}, {_rounds(_SRC.format(100), "nk", "y")}, r as (select case when x.dist > 0 and y.dist is not null then y.dist / x.dist end ratio from pq left join x{_FAR} x using (source, id) left join y{_FAR} y using (source, id))
select round(min(ratio), 9) ratio_min, round(max(ratio), 9) ratio_max, round(avg(ratio), 9) ratio_mean, round(stddev_pop(ratio), 9) ratio_std, round(avg(case when ratio is null then 1.0 else 0.0 end), 9) unreachable from r"""


@query("spsp_stretch", _STRETCH)
def _stretch(spark: SparkSession, d: str) -> DataFrame:
    g = _symmetric_user(spark, d)
    s = _sources(g, 100)
    pruned = g.with_edges(sparsify.bernoulli(g.edges, 0.8))
    pairs = s.join(F.broadcast(traverse.sample_vertices(g, 1000, 8)), F.col("source") != F.col("id"))  # 100 000 rows at most
    r = metrics.spsp_stretch(traverse.distances(g, s), traverse.distances(pruned, s), pairs)
    t = r.agg(*stats.ratio_stats(F.col("ratio")))
    return t.select(*(F.round(c, 9).alias(c) for c in t.columns))


def _weighted(n: str, x: str) -> str:
    """Weighted distances from 100 sources, by 16 rounds of relaxation: more than any least way here has edges."""
    step = f"select source, id, min(dist) dist from (select source, id, dist from XX union all select x.source, n.dst, x.dist + n.w from XX x join {n} n on n.src = x.id) group by 1, 2"
    return f"{x}0 as materialized (select id source, id, cast(0 as double) dist from {_SRC.format(100)} q), " + ", ".join(f"{x}{i + 1} as materialized ({step.replace('XX', f'{x}{i}')})" for i in range(16))


_WEIGHTED = f"""with {_SYM}, {BOTH}, k as materialized (select src, dst, w from e where {u(h(1, 'src', 'dst'))} < {1 - 0.8!r}), nk as materialized (select src, dst, w from k union all select dst, src, w from k), {_PAIRS}, {_weighted('n', 'x')}, {_weighted('nk', 'y')}, r as ({{}})
select round(min(ratio), 9) ratio_min, round(max(ratio), 9) ratio_max, round(avg(ratio), 9) ratio_mean, round(stddev_pop(ratio), 9) ratio_std, round(avg(case when ratio is null then 1.0 else 0.0 end), 9) unreachable from r"""


@query("spsp_stretch_weighted", _WEIGHTED.format("select case when x.dist > 0 and y.dist is not null then y.dist / x.dist end ratio from pq left join x16 x using (source, id) left join y16 y using (source, id)"))
def _stretch_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _stretches(_symmetric_user(spark, d))[0]


_ECCS = "select source, max(dist) m from {} where id in (select id from v order by md5(concat_ws(':', '8', id)), id limit 1000) group by 1"


@query("eccentricity_stretch", _WEIGHTED.format(f"select case when a.m > 0 and b.m > 0 then b.m / a.m end ratio from ({_ECCS.format('x16')}) a join ({_ECCS.format('y16')}) b using (source)"))
def _stretch_eccentricity(spark: SparkSession, d: str) -> DataFrame:
    return _stretches(_symmetric_user(spark, d))[1]


def _stretches(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Ratios of weighted distances from 100 sources to 1000 targets, and of the farthest of these targets."""
    s, t = _sources(g, 100), traverse.sample_vertices(g, 1000, 8)
    a, b = (traverse.distances(x, s, weighted=True) for x in (g, g.with_edges(sparsify.bernoulli(g.edges, 0.8))))
    near = metrics.spsp_stretch(a, b, s.join(F.broadcast(t), F.col("source") != F.col("id")))  # 100 000 rows at most
    far = traverse.eccentricity(a, t).withColumnRenamed("ecc", "base").join(traverse.eccentricity(b, t), "source").select(stats.ratio(F.col("ecc"), F.col("base")).alias("ratio"))
    found = [x.agg(*stats.ratio_stats(F.col("ratio"))) for x in (near, far)]
    return tuple(t.select(*(F.round(c, 9).alias(c) for c in t.columns)) for t in found)


_KEYED = "select k, source, id, min(dist) dist from (select k, source, id, dist from XX union all select x.k, x.source, nk.dst, x.dist + 1 from XX x join nk on nk.k = x.k and nk.src = x.id where x.dist = RR) group by 1, 2, 3"
_VARIANTS = f"{_V.replace('p(', 'pr(')}, r as materialized ({_RANDOM.split(_V)[1].strip().replace(', p where', ', pr where')})"
_ECC_PARTS = "select k, ceil(({c} + 1) * 20.0::double / n) - 1 part, count(*) / first(all_) share from (select k, {c}, max({c}) over (partition by k) + 1 n, count(*) over (partition by k) all_ from t) group by 1, 2"
_ECC_DISTANCE = f"""with {_SYM}, {_VARIANTS}, nk as materialized (select cast(prune_rate as double) k, src, dst from r union all select prune_rate, dst, src from r union all select -1, src, dst from e union all select -1, dst, src from e),
x0 as materialized (select k, id source, id, 0 dist from (select distinct k from nk) q, {_SRC.format(100)} s), {", ".join(f"x{i + 1} as materialized ({_KEYED.replace('XX', f'x{i}').replace('RR', str(i))})" for i in range(_FAR))},
m as (select k, source, cast(max(dist) as double) ecc from x{_FAR} group by 1, 2), t as materialized (select a.k, a.source, a.ecc, b.ecc base from m a join m b on b.source = a.source and b.k = -1 where a.k <> -1),
pe as ({_ECC_PARTS.format(c='ecc')}), pb as ({_ECC_PARTS.format(c='base')}), d as (select k, sum(sqrt(coalesce(pe.share, 0) * coalesce(pb.share, 0))) s from pe full join pb using (k, part) group by 1),
z as (select k, min(ecc / base) a, max(ecc / base) b, avg(ecc / base) c, stddev_pop(ecc / base) e from t where base <> 0 group by 1)
select 'random' algo, k prune_rate, 7 run, round(case when s <= 0 then 'Infinity'::double else -ln(s) end, 9) + 0.0 distance, round(a, 9) ratio_min, round(b, 9) ratio_max, round(c, 9) ratio_mean, round(e, 9) ratio_std from d join z using (k)"""


@query("eccentricity_distance", _ECC_DISTANCE)
def _eccentricity_distance(spark: SparkSession, d: str) -> DataFrame:
    g = _symmetric_user(spark, d)
    t = metrics.eccentricity_distance(metrics.eccentricities(sparsify.random_edges(g, RATES), g, _sources(g, 100)))
    return t.select(*metrics.KEYS, *((F.round(c, 9) + 0.0).alias(c) for c in t.columns if c not in metrics.KEYS))


def _closed(e: str, x: str) -> str:
    """Directed clustering of every vertex by the edges e."""
    return f"""d{x} as (select src id, count(*) deg from {e} group by 1), t{x} as (select x.src id, count(*) t from {e} x join {e} z on x.dst = z.src join {e} y on y.src = x.src and y.dst = z.dst group by 1),
s{x} as (select v.id, case when deg > 1 then coalesce(t, 0) / (deg * (deg - 1)) else 0 end score from v left join d{x} using (id) left join t{x} using (id))"""


@query("clustering_ratios", f"""with {USER}, k as materialized (select src, dst from e where {u(h(1, 'src', 'dst'))} < 0.5), {_closed('e', 'a')}, {_closed('k', 'b')}, z as (select case when a.score <> 0 then b.score / a.score end r, b.score from sa a join sb b using (id))
select round(min(r), 9) ratio_min, round(max(r), 9) ratio_max, round(avg(r), 9) ratio_mean, round(stddev_pop(r), 9) ratio_std, round(avg(score), 9) mean from z""")
def _clustering_ratios(spark: SparkSession, d: str) -> DataFrame:
    g = user_graph(spark, d)
    t = metrics.score_ratios(traverse.directed_clustering(g), traverse.directed_clustering(g.with_edges(sparsify.bernoulli(g.edges, 0.5))))
    return t.select(*(F.round(c, 9).alias(c) for c in t.columns))


_HIST = f"""k as (select algo, prune_rate, run, id, count(*) deg from (select algo, prune_rate, run, src id from a union all select algo, prune_rate, run, dst from a) group by all),
g as (select q.*, v.id, coalesce(k.deg, 0) deg from (select distinct algo, prune_rate, run from a) q cross join v left join k using (algo, prune_rate, run, id)),
l as (select *, min(deg) over w lo, max(deg) over w hi, count(*) over w n from g window w as (partition by algo, prune_rate, run)),
b as (select algo, prune_rate, run, case when hi = lo then 50 else least(floor((deg - lo) * 100 / (hi - lo)), 99) end bin, count(*) / max(n) p from l group by all)"""
_DIST = f"with {PART}, {_V}, r as ({_RANDOM.split(_V)[1].strip()}), a as (select algo, prune_rate, run, src, dst from r union all select 'original', 0.0, 0, src, dst from e), {_HIST}, s as (select b.algo, b.prune_rate, b.run, sum(sqrt(b.p * coalesce(o.p, 0))) s from b left join b o on o.bin = b.bin and o.algo = 'original' group by all)"
_edges("degree_distribution_distance", lambda spark, d: based(part_graph(spark, d)), lambda g: metrics.degree_distance(sparsify.random_edges(g, RATES), g).withColumn("distance", F.round("distance", 9) + 0.0), f"{_DIST} select algo, cast(prune_rate as double) prune_rate, run, round(case when s <= 0 then 'Infinity'::double else -ln(s) end, 9) + 0.0 distance from s")


def _agreement(g: Graph) -> DataFrame:
    g = based(g)
    other = g.with_edges(sparsify.bernoulli(g.edges, 0.5))
    a = stats.top_n_agreement(metrics.degree_centrality(g), metrics.degree_centrality(other))
    return a.select("precision", F.round("correlation", 9).alias("correlation"))


_edges("topn_agreement", part_graph, _agreement, f"""with {PART}, k as (select src, dst from e where {u(h(1, 'src', 'dst'))} < 0.5),
a as (select v.id, count(x.id) deg from v left join (select src id from e union all select dst from e) x using (id) group by 1), b as (select v.id, count(x.id) deg from v left join (select src id from k union all select dst from k) x using (id) group by 1),
ta as (select id, row_number() over (order by deg desc, id) r from a qualify r <= 100), tb as (select id, row_number() over (order by deg desc, id) r from b qualify r <= 100),
z as (select row_number() over (order by ta.r) x, row_number() over (order by tb.r) y from ta join tb using (id)) select count(*) / 100 as precision, round(corr(x, y), 9) correlation from z""")
_edges("cosine", part_graph, lambda g: normalize.degree_table(g).agg(F.round(stats.cosine(F.col("out_weight"), F.col("in_weight")), 9).alias("cosine")), f"with {PART}, o as (select v.id, coalesce(sum(w), 0) s from v left join e on src = id group by 1), i as (select v.id, coalesce(sum(w), 0) s from v left join e on dst = id group by 1) select round(sum(o.s * i.s) / sqrt(sum(o.s * o.s) * sum(i.s * i.s)), 9) cosine from o join i using (id)")

# -- summaries --------------------------------------------------------------------------------------------------------------


@query("variant_sizes", f"with {PART}, {_V}, r as ({_RANDOM.split(_V)[1].strip()}), c as (select algo, cast(prune_rate as double) asked, run, count(*) edges from r group by all union all select 'original', 0, 0, count(*) from e) select algo, asked, run, edges, round_even(1 - edges / (select max(edges) from c where algo = 'original'), 2) prune_rate from c")
def _sizes(spark: SparkSession, d: str) -> DataFrame:
    g = part_graph(spark, d)
    return sweep.variant_sizes(sparsify.random_edges(g, RATES), g)


def _summary(spark: SparkSession, d: str) -> DataFrame:
    g = based(user_graph(spark, d))
    v = sweep.sweep(g, ["random"], runs=3)
    t = metrics.degree_distance(v, g).where("algo <> 'original'")
    s = summary.summarize(t, "Bhattacharyya_distance", "distance")
    return s.select("prune_algo", "prune_rate", "Bhattacharyya_distance_count", *(F.round(f"Bhattacharyya_distance_{c}", 6).alias(f"Bhattacharyya_distance_{c}") for c in ("mean", "std")))


_NINE = f"pr(prune_rate, ratio) as (values {', '.join(f'(cast({r} as double), cast({1 - r!r} as double))' for r in sweep.RATES)})"
_RUNS = " union all ".join(_ranked(f"select *, row_number() over (order by {h(k, 'src', 'dst')}, src, dst) rank from e", "random", k).replace(" r, p where", " r, pr where") for k in range(3))
_OUT = _HIST.replace("(select algo, prune_rate, run, src id from a union all select algo, prune_rate, run, dst from a)", "(select algo, prune_rate, run, src id from a where src <> dst)")
_SUMMARY = f"""with {USER}, {_NINE}, r as materialized ({_RUNS}), a as materialized (select algo, prune_rate, run, src, dst from r union all select 'original', 0.0, 0, src, dst from e), {_OUT},
s as (select b.algo, b.prune_rate, b.run, sum(sqrt(b.p * coalesce(o.p, 0))) s from b left join b o on o.bin = b.bin and o.algo = 'original' where b.algo <> 'original' group by all), z as (select algo, prune_rate, -ln(s) d from s)
select {{}} prune_algo, cast(prune_rate as double) prune_rate, count(*) Bhattacharyya_distance_count, round(avg(d), 6) Bhattacharyya_distance_mean, round(stddev_samp(d), 6) Bhattacharyya_distance_std from z group by algo, prune_rate"""
query("variant_summary", _SUMMARY.format("algo"))(_summary)


@query("figure_frame", _SUMMARY.format("'Random'") + " having prune_rate >= 0.05 and prune_rate < 0.93")
def _figure(spark: SparkSession, d: str) -> DataFrame:
    return summary.figure_frame(_summary(spark, d), ["original"], names={"random": "Random"})


_DONE = "select {} name, 'done' status, count(*) as rows from {}"
_PROFILED = f"with {PART}, {BOTH} " + " union all ".join(_DONE.format(f"'{a}'", b) for a, b in (("bernoulli", f"e where {u(h(1, 'src', 'dst'))} < 0.6"), ("both_ways", "n"), ("cap", f"(select *, row_number() over (partition by src order by {h(6, 'src', 'dst')}, src, dst) rk from e) where rk <= 20")))


@query("profiled_pruning", _PROFILED)
def _profiled(spark: SparkSession, d: str) -> DataFrame:
    """Prunings side by side: what each came to. How long they took is in the record, too, but no SQL can say it."""
    g = based(part_graph(spark, d))
    tasks = {"bernoulli": lambda: sparsify.bernoulli(g.edges, 0.4), "both_ways": lambda: normalize.to_directed(g.edges), "cap": lambda: sparsify.degree_cap(g, 20, "out")}
    return profile.profiled(spark, tasks, limit=3600).select("name", "status", "rows")


@query("rank_sweep", f"with {PART}, {_V}, m as (select count(*) m from e), c as (select algo, prune_rate asked, 0 run, cast(floor(ratio * m + 0.5) as bigint) edges from p, m, (values ('random'), ('gspar'), ('local_degree')) t(algo) union all select 'original', 0, 0, m from m) select algo, cast(asked as double) asked, run, edges, round_even(1 - edges / (select m from m), 2) prune_rate from c")
def _rank_sweep(spark: SparkSession, d: str) -> DataFrame:
    g = part_graph(spark, d)
    return sweep.variant_sizes(sweep.sweep(g, ["random", "gspar", "local_degree"], RATES), g)


@query("full_sweep")
def _full_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Prunings at three rates or over their grids, random ones in two runs, on a graph that grows. Left out are spanners (one task a
    component), and fires and resistances, whose rounds would take most of the time; these have queries of their own."""
    algos = [a for a in sweep.ALGORITHMS if a not in ("spanner", "er", "forest_fire")]
    g = _symmetric_user(spark, d)
    return sweep.variant_sizes(sweep.sweep(g, algos, [0.3, 0.5, 0.7], 2, {"k_neighbor": [2, 8], "lspar": [0.3, 0.6]}), g)


@query("mean_of_top", "select k, round(sum(greatest(p, 0)) / 10, 6) top_mean from (select o_custkey % 50 k, o_totalprice p from orders qualify row_number() over (partition by o_custkey % 50 order by o_totalprice desc) <= 10) group by k")
def _mean_of_top(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 50).alias("k"), F.col("o_totalprice").alias("p"))
    return summary.mean_of_top(rows, ["k"], "p").withColumn("top_mean", F.round("top_mean", 6))


@query("first_of_rate", "select o_orderpriority algo, (o_orderkey % 10) / 10.0::double prune_rate, o_custkey edges, o_orderkey from orders qualify row_number() over (partition by o_orderpriority, o_orderkey % 10 order by o_custkey desc, o_orderkey) = 1")
def _first_of_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("algo"), (F.col("o_orderkey") % 10 / F.lit(10.0)).alias("prune_rate"), F.col("o_custkey").alias("edges"), "o_orderkey")
    return summary.first_of_rate(rows, ["algo"])


_FLAGS = "s as (select case when l_returnflag = 'A' then 'original' else l_returnflag end prune_algo, l_discount * 10 prune_rate, round(avg(l_tax), 9) + case when l_linestatus = 'O' then 0.2 else 0 end Unreachable_mean from lineitem group by l_returnflag, l_discount, l_linestatus)"


def _flags(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag", "l_discount", "l_linestatus").agg(F.round(F.avg("l_tax"), 9).alias("x"))
    return s.select(F.when(F.col("l_returnflag") == "A", "original").otherwise(F.col("l_returnflag")).alias("prune_algo"), (F.col("l_discount") * 10).alias("prune_rate"), (F.col("x") + F.when(F.col("l_linestatus") == "O", 0.2).otherwise(0.0)).alias("Unreachable_mean"))


query("reachable_only", f"with {_FLAGS} select * from s where Unreachable_mean < (select max(Unreachable_mean) from s where prune_algo = 'original') + 0.01")(lambda spark, d: summary.reachable_only(_flags(spark, d), slack=0.01))
query("rate_buckets", f"with {_FLAGS} select prune_algo, round_even(prune_rate, 1) prune_rate, Unreachable_mean from s where round_even(prune_rate, 1) in (0.1, 0.5, 0.9)")(lambda spark, d: summary.rate_buckets(_flags(spark, d)))


@query("zip_lines", 'with t as (select event_type file, user_id, row_number() over (partition by event_type order by event_id) - 1 nth from events) select file, cast(nth // 2 as bigint) pair, max(user_id) filter (nth % 2 = 0) as "first", max(user_id) filter (nth % 2 = 1) as "second" from t group by 1, 2')
def _zip_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), F.array(F.col("user_id").cast("string")).alias("tokens"))
    return summary.zip_lines(lines).select("file", "pair", *(F.col(c)[0].cast("long").alias(c) for c in ("first", "second")))


@query("map_lines", "select o_orderkey line_no, coalesce(a.c_nationkey, 0) || ' ' || coalesce(b.c_nationkey, 0) ids from orders left join customer a on a.c_custkey = o_custkey left join customer b on b.c_custkey = o_orderkey")
def _map_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("line_no"), F.array("o_custkey", "o_orderkey").alias("tokens"))
    ids = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("old_id"), F.col("c_nationkey").cast("long").alias("new_id"))
    return normalize.map_lines(lines, ids).select("line_no", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("best_runs", "with r as (select user_id % 7 run, value train, event_id * 37 % 10007 + event_id / 1e6 valid, value * 2 test from events) select run, max(train) best_train, max(valid) best_valid, arg_max(train, valid) final_train, arg_max(test, valid) final_test from r group by 1")
def _best_runs(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return summary.best_runs(e.select((F.col("user_id") % 7).alias("run"), F.col("value").alias("train"), (F.col("event_id") * 37 % 10007 + F.col("event_id") / F.lit(1e6)).alias("valid"), (F.col("value") * 2).alias("test")))


@query("parse_log", "select n_name algo, cast(n_regionkey as double) / 4 prune_rate, cast(n_nationkey as bigint) line_no, case when n_nationkey % 5 = 0 then 'nan'::double else n_nationkey / 8.0 end distance from nation")
def _parse_log(spark: SparkSession, d: str) -> DataFrame:
    """A metric log written as text and read again: a line a nation, masked values as two dashes."""
    n = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").coalesce(1)
    value = F.when(F.col("n_nationkey") % 5 == 0, "--").otherwise((F.col("n_nationkey") / 8).cast("string"))
    path = f"{shared_folder(spark)}/edgeloom-log-{uuid.uuid4().hex}"
    n.select(F.concat_ws("\t", F.translate("n_name", " ", "~"), (F.col("n_regionkey") / 4).cast("string"), F.lit("distance:"), value)).write.text(path)
    t = keep(files.read_log(spark, path).select(F.translate(F.col("tokens")[0], "~", " ").alias("algo"), files.token(1).alias("prune_rate"), F.col("line_no").cast("long").alias("line_no"), files.token(3).alias("distance")), "log")
    release(spark.read.text(path))
    return t


# -- edge files -------------------------------------------------------------------------------------------------------------


@query("edge_csv", f"with {PART} select src, dst, w from e")
def _edge_csv(spark: SparkSession, d: str) -> DataFrame:
    """The part graph written as an edge file and a weight file of several parts, and read again."""
    path = f"{shared_folder(spark)}/edgeloom-csv-{uuid.uuid4().hex}"
    files.write_edge_csv(part_graph(spark, d).edges, f"{path}/edges", f"{path}/weights")
    t = keep(files.read_edge_csv(spark, f"{path}/edges", f"{path}/weights"), "csv")
    remove_folder(spark, path)
    return t


# -- generators: their sizes come from the tables ----------------------------------------------------------------------------

_W = "cast(1 as double) w"


def _rows(spark: SparkSession, d: str, table: str) -> int:
    return spark.read.parquet(f"{d}/{table}.parquet").count()


def _scale(spark: SparkSession, d: str) -> int:
    return max(1, _rows(spark, d, "customer").bit_length() - 1)


def _count(table: str) -> str:
    return f"(select count(*) from {table})"


def _upto(n: str) -> str:
    return f"(select unnest(range({n})) i)"


_SUP = _count("supplier")
query("gen_ring", f"select i src, (i + 1) % {_SUP} dst, {_W} from {_upto(_SUP)} union all select (i + 1) % {_SUP}, i, {_W} from {_upto(_SUP)}")(lambda spark, d: generators.ring(spark, _rows(spark, d, "supplier")))
query("gen_complete", f"select a.i src, b.i dst, {_W} from {_upto(_SUP)} a join {_upto(_SUP)} b on a.i < b.i")(lambda spark, d: generators.complete(spark, _rows(spark, d, "supplier")))
query("gen_dumbbell", f"select a.i src, b.i dst, {_W} from {_upto(_SUP + ' // 2 * 2')} a join {_upto(_SUP + ' // 2 * 2')} b on a.i < b.i and a.i // ({_SUP} // 2) = b.i // ({_SUP} // 2) union all select {_SUP} // 2 - 1, {_SUP} // 2, 1")(lambda spark, d: generators.dumbbell(spark, _rows(spark, d, "supplier")))
_CLIQUES = f"""with z as (select n_regionkey r, count(*) s from supplier join nation on n_nationkey = s_nationkey group by 1), q as materialized (select r, s, coalesce(sum(s) over (order by r rows between unbounded preceding and 1 preceding), 0)::bigint f from z),
m as (select f + a.i x, f, s from (select f, s, unnest(range(s)) i from q) a), n as (select f, s, lead(f) over (order by f) f2, lead(s) over (order by f) s2 from q)
select a.x src, b.x dst, {_W} from m a join m b on a.f = b.f and a.x < b.x
union all (select distinct f + cast(floor({u(h('7a', 'i', 'f'))} * s) as bigint), f2 + cast(floor({u(h('7b', 'i', 'f'))} * s2) as bigint), {_W} from range(5) t(i), n where f2 is not null)"""


@query("gen_communities", _CLIQUES)
def _gen_communities(spark: SparkSession, d: str) -> DataFrame:
    """A clique of each region's suppliers, and bridges."""
    s, n = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("supplier", "nation"))
    sizes = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").count().orderBy("n_regionkey").collect()  # a row a region
    return generators.communities(spark, [r["count"] for r in sizes], 5)


_BITS = f"(select greatest(1, floor(log2({_count('customer')})))::int)"
_SIZE = "(1::bigint << sc)"
_FROM = f"from (select sc, unnest(range({_SIZE} * 8)) i from {_BITS} t(sc))"
query("gen_uniform", f"select cast(floor({u(h('7a', 'i'))} * {_SIZE}) as bigint) src, cast(floor({u(h('7b', 'i'))} * {_SIZE}) as bigint) dst, {_W} {_FROM}")(lambda spark, d: generators.uniform_graph(spark, _scale(spark, d), 8))
_QUAD = [u(h(f"7:{bit}", "i")) for bit in range(14)]
_BIT_OF = "case when {k} < sc and ({cond}) then 1::bigint << (sc - 1 - {k}) else 0 end"
_MAT = {"src": " + ".join(_BIT_OF.format(k=k, cond=f"{x} >= {0.57 + 0.19!r}") for k, x in enumerate(_QUAD)), "dst": " + ".join(_BIT_OF.format(k=k, cond=f"{x} >= 0.57 and {x} < {0.57 + 0.19!r} or {x} >= {0.57 + 0.19 + 0.19!r}") for k, x in enumerate(_QUAD))}
query("gen_rmat", f"select {', '.join(f'cast((({x}) * 2654435761 + 12345) % {_SIZE} as bigint) {c}' for c, x in _MAT.items())}, {_W} {_FROM}")(lambda spark, d: generators.rmat(spark, _scale(spark, d), 8))
_WALK = f"select cast(floor({u(h(7, 'i'))} * {_SUP}) as bigint) a, cast(floor({u(h(7, 'i + 1'))} * {_SUP}) as bigint) b from {_upto(_count('customer'))}"
query("gen_random_walk", f"with s as ({_WALK}) select distinct src, dst, {_W} from (select a src, b dst from s where a <> b union all select b, a from s where a <> b)")(lambda spark, d: generators.random_walk(spark, _rows(spark, d, "supplier"), _rows(spark, d, "customer")))
query("gen_uniform_numbers", f"select i id, {u(h(7, 'i'))} x from {_upto(_count('customer'))}")(lambda spark, d: generators.random_numbers(spark, _rows(spark, d, "customer")))
query("gen_normal_numbers", f"select i id, round(sqrt(-2 * ln(1 - {u(h(7, 'i'))})) * cos(2 * pi() * {u(h(7, 'i'), 9)}), 9) x from {_upto(_count('customer'))}")(lambda spark, d: generators.random_numbers(spark, _rows(spark, d, "customer"), "normal").withColumn("x", F.round("x", 9)))
query("top_pairs", f"with {PART} select src, dst, w from e order by w desc, src, dst limit 20")(lambda spark, d: part_graph(spark, d).edges.orderBy(F.desc("w"), "src", "dst").limit(20))
query("pick_source", f"with {USER} select src id from e group by 1 order by md5(concat_ws(':', '3', src)), 1 limit 1")(lambda spark, d: user_graph(spark, d).edges.select(F.col("src").alias("id")).distinct().orderBy(digest(3, "id"), "id").limit(1))
query("empty_graph", f"with {USER} select id src, id dst, {_W} from v")(lambda spark, d: user_graph(spark, d).vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w")))
