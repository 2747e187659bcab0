"""Queries of near-duplicate filters, graphs, chunkers, classifiers, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curato.functions import text as t
from curato.operators import chunking as ch
from curato.operators import classify as cl
from curato.operators import communities as cm
from curato.operators import graph as g
from curato.operators import nearness as nr
from curato.operators import tables as o
from curato.operators import tasks as tk
from curato.operators import validation as va
from curato.plans.base import QA_SQL, Catalog, Tables
from curato.plans.scalars import SIM
from curato.sources import readers, writers
from curato.session import shared_folder
from curato.streaming import flows

catalog = Catalog()
query = catalog.query
#: Suppliers, nations and regions as a graph: ids in different hundreds of thousands.
EDGES = "edges AS (SELECT s_suppkey + 100000 AS src, 'based_in' AS rel, s_nationkey::BIGINT AS dst FROM supplier UNION SELECT n_nationkey::BIGINT, 'part_of', n_regionkey + 1000 FROM nation UNION SELECT n_nationkey::BIGINT, 'next_to', ((n_nationkey + 1) % 25)::BIGINT FROM nation)"


def edges(x: Tables) -> DataFrame:
    based = x.supplier.select((F.col("s_suppkey") + 100000).alias("src"), F.lit("based_in").alias("rel"), F.col("s_nationkey").cast("long").alias("dst"))
    part = x.nation.select(F.col("n_nationkey").cast("long").alias("src"), F.lit("part_of").alias("rel"), (F.col("n_regionkey") + 1000).cast("long").alias("dst"))
    beside = x.nation.select(F.col("n_nationkey").cast("long").alias("src"), F.lit("next_to").alias("rel"), ((F.col("n_nationkey") + 1) % 25).cast("long").alias("dst"))
    return based.union(part).union(beside).distinct()


def nodes(x: Tables) -> DataFrame:
    e = edges(x)
    kind = F.when(F.col("id") >= 100000, "supplier").when(F.col("id") >= 1000, "region").otherwise("nation")
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("type", kind)


@query("d04_pairs", f"WITH {QA_SQL}, {SIM}, z AS (SELECT doc_id AS id, h FROM sim WHERE h <> 0), f AS (SELECT h, min(id) AS id FROM z GROUP BY h) SELECT x.id AS a, y.id AS b FROM f x JOIN f y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 6 UNION ALL SELECT f.id, z.id FROM z JOIN f ON z.h = f.h AND z.id > f.id")
def _(x: Tables) -> DataFrame:
    """D-04, J-08."""
    h = nr.simhashes(x.qa().select("doc_id", t.simhash_tokens("q").alias("tokens")), "doc_id", "tokens").where("h != 0")
    return nr.hamming_pairs(nr.stored(h))


@query("d04_simhash")
def _(x: Tables) -> DataFrame:
    """D-04; tested against the plain loop."""
    h = nr.simhashes(x.qa().select("doc_id", t.simhash_tokens("q").alias("tokens")), "doc_id", "tokens").where("h != 0")
    return nr.dedup_simhash(nr.stored(h))


@query("d05_pairs", "SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS score FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.45")
def _(x: Tables) -> DataFrame:
    """D-05, J-08."""
    return nr.cosine_pairs(x.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.45).select("a", "b", F.round("score", 6).alias("score"))


@query("d13_similar", "WITH s AS (SELECT q.vec_id AS qid, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.label = 1) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank, id, round(score, 6) AS score FROM s QUALIFY rank <= 4")
def _(x: Tables) -> DataFrame:
    """D-13: the four vectors most like each one of a label."""
    rows = x.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nr.similar_items(rows, x.embeddings.where("label = 1").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), 4, 512).withColumn("score", F.round("score", 6))


#: Vectors of each label, one after another; kept are those that no kept one before them is alike to.
GREEDY = """WITH RECURSIVE e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
r AS (SELECT label, n, [vec_id] AS ids, [v] AS vs FROM e WHERE n = 1 UNION ALL SELECT label, n, CASE WHEN alike THEN ids ELSE list_append(ids, vec_id) END, CASE WHEN alike THEN vs ELSE list_append(vs, v) END
    FROM (SELECT r.label, e.n, r.ids, r.vs, e.vec_id, e.v, list_max(list_transform(r.vs, lambda k: list_cosine_similarity(k, e.v))) >= 0.45 AS alike FROM r JOIN e ON e.label = r.label AND e.n = r.n + 1))
SELECT unnest(ids) AS id, label FROM r QUALIFY n = max(n) OVER (PARTITION BY label)"""


@query("d05_embeddings", GREEDY)
def _(x: Tables) -> DataFrame:
    """D-05, D-06; tested against the plain loop."""
    return nr.dedup_embeddings(x.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"), 0.45, "label").select("id", "label")


@query("d09_diversity", f"""WITH {QA_SQL}, k AS (SELECT doc_id AS id, list_filter(list_distinct(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')), lambda w: regexp_full_match(w, '[a-z]{{3,}}')) AS w FROM qa), tk AS (SELECT id, len(w) AS n, unnest(w) AS w FROM k WHERE len(w) > 0)
SELECT x.id AS a, y.id AS b FROM tk x JOIN tk y ON x.w = y.w AND x.id < y.id GROUP BY x.id, y.id, x.n, y.n HAVING count(*) >= greatest(x.n, y.n) * 0.7""")
def _(x: Tables) -> DataFrame:
    """D-09, D-10, U-04."""
    k = x.qa().select(F.col("doc_id").alias("id"), t.core_keywords("q").alias("words"))
    return nr.keyword_pairs(k, 0.7)


@query("d10_similarity")
def _(x: Tables) -> DataFrame:
    """D-10, Q-05."""
    z = x.qa().select(F.col("doc_id").alias("id"), t.similarity_tokens("q").alias("x"), t.similarity_tokens("a").alias("y"))
    return z.mapInArrow(nr.rouge_overlap, "id long, similarity double")


@query("g01_statistics", f"WITH {EDGES}, n AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT 'node' AS kind, CASE WHEN id >= 100000 THEN 'supplier' WHEN id >= 1000 THEN 'region' ELSE 'nation' END AS name, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'relation', rel, count(*) FROM edges GROUP BY rel")
def _(x: Tables) -> DataFrame:
    """G-01, A-13, G-21."""
    return g.statistics(nodes(x), edges(x))


@query("g03_neighbours", f"WITH {EDGES} SELECT src, rel, dst FROM edges WHERE src IN (1, 2, 3)")
def _(x: Tables) -> DataFrame:
    """G-02, G-03, G-16."""
    return g.neighbours(edges(x), nodes(x).where("id in (1, 2, 3)"))


@query("g04_paths", f"""WITH RECURSIVE {EDGES}, p AS (SELECT [src, dst] AS nodes, [rel] AS rels FROM edges WHERE src IN (1, 100001) UNION ALL SELECT list_append(nodes, dst), list_append(rels, rel) FROM p JOIN edges ON src = nodes[len(nodes)] WHERE NOT list_contains(nodes, dst) AND len(rels) < 3)
SELECT array_to_string(nodes, '>') AS path, array_to_string(rels, ',') AS rels, len(rels)::INT AS hops FROM p""")
def _(x: Tables) -> DataFrame:
    """G-04, G-06, G-15, J-10."""
    p = g.paths(edges(x), nodes(x).where("id in (1, 100001)"), 3)
    return p.select(F.array_join(F.transform("nodes", lambda n: n.cast("string")), ">").alias("path"), F.array_join("rels", ",").alias("rels"), "hops")


@query("g07_explained", f"WITH {EDGES} SELECT concat(src, ' -[', rel, ']-> ', dst) AS said FROM edges WHERE src = 1")
def _(x: Tables) -> DataFrame:
    """G-06, G-07."""
    return g.paths(edges(x), nodes(x).where("id = 1"), 1).select(g.explained(F.col("nodes"), F.col("rels")).alias("said"))


@query("g07_best_paths", f"""WITH RECURSIVE {EDGES}, p AS (SELECT src AS start, dst AS node, [src, dst] AS nodes, [rel] AS rels FROM edges WHERE src >= 100000 UNION ALL SELECT start, dst, list_append(nodes, dst), list_append(rels, rel) FROM p JOIN edges ON src = p.node WHERE NOT list_contains(nodes, dst) AND len(rels) < 5),
s AS (SELECT start, node AS "end", nodes, rels, list_sum(list_transform(rels, lambda r: CASE r WHEN 'next_to' THEN 1.0::DOUBLE WHEN 'part_of' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END)) AS total, len(rels) AS n FROM p WHERE node >= 1000 AND node < 100000),
r AS (SELECT *, round(0.7::DOUBLE * total / n + 0.3::DOUBLE / (1 + n), 9) AS score, array_to_string(nodes, '>') AS path FROM s)
SELECT start, "end", row_number() OVER (PARTITION BY start, "end" ORDER BY score DESC, path, array_to_string(rels, '>'))::INT AS rank, score, path FROM r QUALIFY rank <= 2""")
def _(x: Tables) -> DataFrame:
    """G-07, Q-08: the two best paths from each supplier to each region."""
    n = nr.stored(nodes(x))
    asked = n.where("type = 'supplier'").select(F.col("id").alias("start")).join(n.where("type = 'region'").select(F.collect_list("id").alias("ends")), F.lit(True)).select("start", F.explode("ends").alias("end"))
    found = g.best_paths(edges(x), asked, {"next_to": 1.0, "part_of": 0.9}, 2)
    return found.select("start", "end", "rank", "score", F.array_join(F.transform("nodes", lambda v: v.cast("string")), ">").alias("path"))


@query("g05_distances", f"""WITH RECURSIVE {EDGES}, l AS (SELECT DISTINCT src, dst FROM edges), p AS (SELECT 1::BIGINT AS start, 1::BIGINT AS node, 0 AS d UNION SELECT p.start, l.dst, p.d + 1 FROM p JOIN l ON l.src = p.node WHERE p.d < 5) SELECT start, node, min(d)::INT AS d FROM p GROUP BY start, node""")
def _(x: Tables) -> DataFrame:
    """G-05, A-33."""
    return g.distances(edges(x), nodes(x).where("id = 1"), 5).withColumnRenamed("at", "node")


@query("g08_ego", f"WITH {EDGES}, n AS (SELECT 1002::BIGINT AS id UNION SELECT src FROM edges WHERE dst = 1002 UNION SELECT dst FROM edges WHERE src = 1002) SELECT src, rel, dst FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def _(x: Tables) -> DataFrame:
    """G-08, K-07."""
    return g.ego(edges(x), nodes(x).where("id = 1002"), 1)


@query("g09_degree", f"WITH {EDGES}, e AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) SELECT id, count(*) AS degree, count(*) / (count(*) OVER () - 1) AS centrality FROM e GROUP BY id")
def _(x: Tables) -> DataFrame:
    return g.degree_centrality(edges(x))


@query("g10_centralities")
def _(x: Tables) -> DataFrame:
    """G-10, G-12: all nodes are sources, and paths of any length count; tested against plain implementations."""
    e = nr.stored(edges(x))
    return g.hubs(g.degree_centrality(e), g.betweenness(e, nodes(x), None), 10)


@query("g10_closeness", f"""WITH RECURSIVE {EDGES}, l AS (SELECT DISTINCT src, dst FROM edges), i AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), p AS (SELECT id AS start, id AS node, 0 AS d FROM i WHERE id < 100000 UNION SELECT p.start, l.dst, p.d + 1 FROM p JOIN l ON l.src = p.node WHERE p.d < 26), b AS (SELECT start, node, min(d) AS d FROM p GROUP BY start, node), q AS (SELECT start, node, d FROM b UNION ALL SELECT e.src, b.node, b.d + 1 FROM edges e JOIN b ON b.start = e.dst WHERE e.src >= 100000)
SELECT node AS id, count(*) / sum(d) * count(*) / ((SELECT count(*) FROM i WHERE id IN (SELECT node FROM b) OR id >= 100000) - 1) AS closeness FROM q WHERE d > 0 GROUP BY node""")
def _(x: Tables) -> DataFrame:
    """G-10: suppliers are reached by nobody."""
    e = nr.stored(edges(x))
    return g.closeness(g.distances(e, nodes(x), None))


@query("g13_lengths", f"""WITH RECURSIVE {EDGES}, l AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), p AS (SELECT src AS start, src AS node, 0 AS d FROM l UNION SELECT p.start, l.dst, p.d + 1 FROM p JOIN l ON l.src = p.node WHERE p.d < 14), b AS (SELECT start, node, min(d) AS d FROM p GROUP BY start, node)
SELECT max(d)::INT AS diameter, avg(d) AS avg_path_length FROM b WHERE d > 0""")
def _(x: Tables) -> DataFrame:
    """G-13: over all pairs of nodes, either way."""
    return g.path_lengths(edges(x))


@query("g13_sketched")
def _(x: Tables) -> DataFrame:
    """G-13, A-33: lengths by sketches, either way; tested against all pairs."""
    e = edges(x)
    return g.sketched_lengths(g.neighbourhoods(e.select("src", "dst").union(e.select("dst", "src"))))


@query("g10_sketched")
def _(x: Tables) -> DataFrame:
    """G-10: closeness by sketches; tested against all pairs."""
    return g.sketched_closeness(g.neighbourhoods(edges(x)))


@query("g13_clustering", f"""WITH {EDGES}, l AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst), k AS (SELECT src AS id, count(*) AS k FROM l GROUP BY src), t AS (SELECT x.src AS id, count(*) / 2 AS t FROM l x JOIN l y ON x.src = y.src AND x.dst <> y.dst JOIN l z ON z.src = x.dst AND z.dst = y.dst GROUP BY x.src)
SELECT avg(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END) AS clustering_coefficient FROM k LEFT JOIN t USING (id)""")
def _(x: Tables) -> DataFrame:
    """G-13."""
    return g.clustering(edges(x))


#: Five rounds of label propagation, one table each.
VOTES = ", ".join(f"l{k + 1} AS (SELECT id, label FROM (SELECT l.src AS id, p.label, count(*) AS n FROM links l JOIN l{k} p ON p.id = l.dst GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1)" for k in range(5))


@query("g11_communities", f"WITH {EDGES}, links AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst), l0 AS (SELECT DISTINCT src AS id, src AS label FROM links), {VOTES} SELECT label, count(*) AS count FROM l5 GROUP BY label")
def _(x: Tables) -> DataFrame:
    """G-11."""
    return g.communities(edges(x), 5).groupBy("label").count()


@query("g11_louvain", """WITH e AS (SELECT c_custkey * 2 AS src, c_nationkey * 2 + 1 AS dst FROM customer UNION SELECT s_suppkey * -2 - 2, s_nationkey * 2 + 1 FROM supplier), m AS (SELECT src AS id, dst AS star FROM e UNION SELECT dst, dst FROM e),
s AS (SELECT star, min(id) AS community, count(*) AS nodes, count(*) - 1 AS links FROM m GROUP BY star) SELECT community, nodes, round((SELECT sum(links / t - (links / t) * (links / t)) FROM s, (SELECT sum(links) AS t FROM s)), 9) AS modularity FROM s""")
def _(x: Tables) -> DataFrame:
    """G-11: customers and suppliers of a nation are a star, and each star is a community."""
    star = lambda c: (F.col(c) * 2 + 1).cast("long").alias("dst")
    e = nr.stored(x.customer.select((F.col("c_custkey") * 2).cast("long").alias("src"), star("c_nationkey")).union(x.supplier.select((F.col("s_suppkey") * -2 - 2).cast("long").alias("src"), star("s_nationkey"))))
    found = nr.stored(cm.louvain(e, least=0.0))
    q = cm.modularity(cm.weighted_links(e), found).select(F.round("modularity", 9).alias("modularity"))
    return found.groupBy("community").agg(F.count(F.lit(1)).alias("nodes")).join(q, F.lit(True))


@query("g13_properties", f"""WITH {EDGES}, s AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst), t AS (SELECT count(*) AS triangles FROM s x JOIN s y ON x.b = y.a JOIN s z ON z.a = x.a AND z.b = y.b), n AS (SELECT count(*) AS nodes FROM (SELECT src FROM edges UNION SELECT dst FROM edges))
SELECT nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE src = dst) AS self_loops, triangles, (SELECT count(*) FROM edges) / (nodes * (nodes - 1)) AS density FROM n, t""")
def _(x: Tables) -> DataFrame:
    return g.properties(edges(x))


@query("g13_connected", f"WITH {EDGES} SELECT id, 0::BIGINT AS component FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)")
def _(x: Tables) -> DataFrame:
    """All nations are next to one another in a ring, so the graph is one component."""
    return g.connected(edges(x))


@query("g14_isolates", f"WITH {EDGES} SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def _(x: Tables) -> DataFrame:
    return g.isolates(x.customer.select(F.col("c_custkey").alias("id")), edges(x))


@query("g17_search", f"WITH {EDGES}, e AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) SELECT id, 'region' AS type, count(*) AS degree FROM e WHERE id >= 1000 AND id < 100000 GROUP BY id ORDER BY degree DESC, id LIMIT 3")
def _(x: Tables) -> DataFrame:
    return g.search(nodes(x), edges(x), "region", 3)


@query("g18_catalog", "SELECT lower(n_name) AS alias, n_nationkey AS id FROM nation UNION SELECT n_nationkey::VARCHAR, n_nationkey FROM nation")
def _(x: Tables) -> DataFrame:
    return g.catalog(x.nation.select(F.col("n_nationkey").alias("id"), F.array("n_name").alias("aliases")))


@query("g19_evidence", f"WITH {EDGES}, b AS (SELECT src AS id, rel, dst AS other, 'out' AS direction FROM edges UNION ALL SELECT dst, rel, src, 'in' FROM edges) SELECT id, rel, other, direction, concat('E', row_number() OVER (PARTITION BY id ORDER BY direction DESC, rel, other)) AS eid FROM b WHERE id < 10 QUALIFY row_number() OVER (PARTITION BY id ORDER BY direction DESC, rel, other) <= 30")
def _(x: Tables) -> DataFrame:
    """G-19, J-11, D-08, G-23."""
    return g.evidence(edges(x), nodes(x).where("id < 10")).select("id", "rel", "other", "direction", "eid")


#: Evidence of all nodes.
BANK = f"""{EDGES}, l AS (SELECT *, md5(concat('s|', src, '|', rel, '|', dst)) AS lot FROM edges), ways AS (SELECT src AS id, src AS head, rel AS relation, dst AS tail, 'out' AS direction FROM edges UNION ALL SELECT dst, src, rel, dst, 'in' FROM edges),
s0 AS (SELECT src AS id, src AS head, min(rel) AS relation, dst AS tail, 'out' AS direction, 0 AS step FROM edges GROUP BY src, dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY min(rel), dst) <= 30),
i AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), n0 AS (SELECT id, count(*) AS n FROM s0 GROUP BY id), h1 AS (SELECT id FROM i LEFT JOIN n0 USING (id) WHERE coalesce(n, 0) < 6),
s1 AS (SELECT *, 1 AS step FROM ways WHERE id IN (SELECT id FROM h1) QUALIFY row_number() OVER (PARTITION BY id, direction ORDER BY relation, head, tail) <= 30),
b1 AS (SELECT id, head, relation, tail, direction, min(step) AS step FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1) GROUP BY id, head, relation, tail, direction QUALIFY row_number() OVER (PARTITION BY id ORDER BY min(step), direction DESC, relation, head, tail) <= 30),
n1 AS (SELECT id, count(*) AS n FROM b1 GROUP BY id HAVING count(*) < 6), via AS (SELECT DISTINCT id, v FROM (SELECT id, unnest([head, tail]) AS v FROM b1 JOIN n1 USING (id)) WHERE v <> id),
s2 AS (SELECT id, src AS head, rel AS relation, dst AS tail, 'out' AS direction, 2 AS step FROM via JOIN l ON l.src = v JOIN n1 USING (id) WHERE NOT EXISTS (FROM b1 WHERE b1.id = via.id AND head = src AND relation = rel AND tail = dst) QUALIFY row_number() OVER (PARTITION BY id ORDER BY lot, src, rel, dst) <= 6 - n),
b2 AS (SELECT * FROM b1 UNION ALL SELECT * FROM s2), n2 AS (SELECT id FROM b2 GROUP BY id HAVING count(*) < 6),
f AS (SELECT * FROM l WHERE src <> dst ORDER BY lot LIMIT 16), t AS (SELECT f.lot, f.src, f.rel, f.dst, e.rel AS rel2, e.dst AS dst2 FROM f LEFT JOIN l e ON e.src = f.dst AND e.dst <> f.dst AND e.dst <> f.src QUALIFY row_number() OVER (PARTITION BY f.lot ORDER BY e.lot) = 1),
pool AS (SELECT *, row_number() OVER (ORDER BY lot) - 1 AS place FROM t), lent AS (SELECT id, p.* FROM n2 JOIN pool p ON p.place = ('0x' || substr(md5(concat('s|', id)), 1, 8))::BIGINT % (SELECT count(*) FROM pool)),
s3 AS (SELECT id, src AS head, rel AS relation, dst AS tail FROM lent UNION SELECT id, dst, rel2, dst2 FROM lent WHERE dst2 IS NOT NULL),
b3 AS (SELECT * FROM b2 UNION ALL SELECT *, 'out', 3 FROM s3 WHERE NOT EXISTS (FROM b2 WHERE b2.id = s3.id AND b2.head = s3.head AND b2.relation = s3.relation AND b2.tail = s3.tail)),
bank AS (SELECT *, concat('E', row_number() OVER (PARTITION BY id ORDER BY step, direction DESC, relation, head, tail)) AS eid FROM b3)"""


@query("g19_bank", f"WITH {BANK} SELECT id, eid, head, relation, tail, direction, step FROM bank")
def _(x: Tables) -> DataFrame:
    """G-19, D-08: of all nodes."""
    e = nr.stored(edges(x))
    return tk.evidence_bank(e, nodes(x), seed="s")


@query("g19_allowed", f"""WITH {BANK}, near AS (SELECT src AS id, dst AS entity, 1 AS a, row_number() OVER (PARTITION BY src ORDER BY min(rel), dst) AS b, 0 AS c FROM edges GROUP BY src, dst QUALIFY b <= 25),
said AS (SELECT id, head AS entity, 2 AS a, substr(eid, 2)::BIGINT AS b, 0 AS c FROM bank UNION ALL SELECT id, tail, 2, substr(eid, 2)::BIGINT, 1 FROM bank), u AS (SELECT DISTINCT id, id AS entity, 0 AS a, 0 AS b, 0 AS c FROM bank UNION ALL SELECT * FROM near UNION ALL SELECT * FROM said)
SELECT id, entity, row_number() OVER (PARTITION BY id ORDER BY min((a, b, c)))::INT AS place FROM u GROUP BY id, entity QUALIFY place <= 33""")
def _(x: Tables) -> DataFrame:
    """G-19: what answers may name."""
    e = nr.stored(edges(x))
    return tk.allowed_entities(nr.stored(tk.evidence_bank(e, nodes(x), seed="s")), e)


@query("g23_tasks", f"""WITH {BANK}, c AS (SELECT 'species' AS kind, id, md5(concat('s|species|', id)) AS lot FROM i WHERE id < 1000 UNION ALL SELECT 'phenotype', id, md5(concat('s|phenotype|', id)) FROM i UNION ALL SELECT 'keyword', id, md5(concat('s|keyword|', id)) FROM i WHERE contains(id::VARCHAR, '1')
UNION ALL SELECT 'degree', id, concat(lpad((1000000000000000 - count(*))::VARCHAR, 16, '0'), '|', id) FROM ways GROUP BY id),
k AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY lot, id)::INT AS rank FROM c WHERE id IN (SELECT src FROM edges) AND id IN (SELECT id FROM bank GROUP BY id HAVING count(*) >= 6) QUALIFY rank <= 7)
SELECT kind, rank, id, eid, head, relation, tail, direction, step FROM k JOIN bank USING (id)""")
def _(x: Tables) -> DataFrame:
    """G-23, L-10: centres by type, by the commonest types where none fits, by keyword and by degree."""
    e, n = nr.stored(edges(x)), nr.stored(nodes(x))
    chosen = tk.centres_by_type(n, "species", ["nation"], seed="s").unionByName(tk.centres_by_type(n, "phenotype", ["trait"], seed="s"))
    chosen = chosen.unionByName(tk.centres_by_keyword(n, "keyword", "1", "s")).unionByName(tk.centres_by_degree(e, "degree"))
    return tk.tasks(e, nr.stored(chosen), 7, seed="s")


@query("q07_claims", "SELECT o_orderkey AS aid, 1 AS cid, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS supported, 0.40 * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END + 0.22 + 0.16 * 0.5 + 0.08 * 0.7 + 0.14 * 0.5 AS confidence, CASE WHEN o_orderstatus = 'F' THEN 'medium' ELSE 'low' END AS level FROM orders")
def _(x: Tables) -> DataFrame:
    """Q-07, J-13."""
    c = x.orders.select(F.col("o_orderkey").alias("aid"), F.lit(1).alias("cid"), F.lit("a").alias("head"), F.lit("binds").alias("relation"), F.lit("b").alias("tail"), F.array(F.lit("E1"), F.lit("E2")).alias("evidence_ids"))
    bank = x.orders.select(F.col("o_orderkey").alias("aid"), F.lit("E2").alias("eid"), F.lit("a").alias("head"), F.when(F.col("o_orderstatus") == "F", "binds").otherwise("blocks").alias("relation"), F.lit("b").alias("tail"))
    told = g.support(c, bank)
    made = told.withColumn("confidence", g.confidence(F.col("supported").cast("double"), F.lit(1.0), F.lit(0.5), F.lit(0.7), F.lit(0.5)))
    return made.withColumn("level", g.confidence_level(F.col("confidence")))


#: Order lines as claims of an answer, the evidence it cites, and the entities it may name; customers and what they bought as the graph.
CLAIMS = """i AS (SELECT l_orderkey AS aid, l_partkey AS cid, min(l_suppkey) AS s, min(l_returnflag) AS flag, min(l_linestatus) AS stat FROM lineitem GROUP BY ALL),
answers AS (SELECT o_orderkey AS aid, o_custkey AS centre, 2 + (CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 1 ELSE 0 END) + (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS aspect_count FROM orders),
c AS (SELECT aid, cid, 'part ' || cid AS head, CASE WHEN flag = 'A' AND stat = 'F' THEN 'meta' ELSE 'sold_by' END AS relation, CASE WHEN s % 11 = 0 THEN '' ELSE 'supp ' || s END AS tail, s % 7 <> 0 AS cites FROM i),
bank AS (SELECT aid, cid, 'part ' || cid AS head, CASE WHEN cid % 3 = 0 THEN 'made_by' ELSE 'sold_by' END AS relation, CASE WHEN cid % 13 = 0 THEN '' ELSE 'supp ' || s END AS tail FROM i WHERE cid % 5 <> 0),
allowed AS (SELECT aid, 'part ' || cid AS e FROM i WHERE aid % 2 = 0 UNION SELECT aid, 'supp ' || s FROM i WHERE aid % 2 = 0 AND s % 4 <> 0),
links AS (SELECT DISTINCT o_custkey AS centre, 'part ' || l_partkey AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ends AS (SELECT c.aid, c.cid, count(*) AS ends, count(*) FILTER (allowed.e IS NULL) AS outside FROM (SELECT aid, cid, head AS e FROM c UNION ALL SELECT aid, cid, tail FROM c WHERE tail <> '') c LEFT JOIN allowed ON allowed.aid = c.aid AND allowed.e = c.e GROUP BY ALL),
judged AS (SELECT c.*, ends, outside, CASE WHEN c.relation = 'meta' THEN 'meta' WHEN c.aid IN (SELECT aid FROM allowed) AND outside > 0 THEN 'invalid_entity' WHEN c.tail = '' THEN 'bad_claim_format' WHEN NOT cites THEN 'missing_evidence'
    WHEN b.relation = c.relation AND b.tail = c.tail THEN 'supported' ELSE 'unsupported' END AS status, b.cid IS NULL OR b.tail = '' AS failing FROM c JOIN ends USING (aid, cid) LEFT JOIN bank b ON b.aid = c.aid AND b.cid = c.cid)"""


def claimed(x: Tables) -> tuple[DataFrame, ...]:
    """answers, claims, bank, allowed and edges of order lines."""
    aspects = "array('Gene_function', ' regulation ', CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'phenotype' ELSE 'odd' END, CASE WHEN o_orderstatus = 'F' THEN 'species' ELSE 'Regulation' END)"
    answers = x.orders.select(F.col("o_orderkey").alias("aid"), F.concat(F.lit(" cust "), "o_custkey").alias("centre"), F.expr(aspects).alias("aspects"))
    i = x.lineitem.groupBy(F.col("l_orderkey").alias("aid"), F.col("l_partkey").alias("cid")).agg(F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("stat"))
    # claims, bank and allowed are made of these
    i = nr.written(i, "lines")
    part, supp = F.concat(F.lit("part "), "cid"), F.concat(F.lit("supp "), "s")
    meta = F.when((F.col("flag") == "A") & (F.col("stat") == "F"), "Unknown_from_available_information").otherwise(" sold_by")
    ids = F.when(F.col("s") % 7 == 0, F.array(F.lit(" "))).otherwise(F.array(F.concat(F.lit("E"), "cid"), F.lit("")))
    claims = i.select("aid", "cid", F.concat(F.lit("part  "), "cid").alias("head"), meta.alias("relation"), F.when(F.col("s") % 11 != 0, supp).alias("tail"), ids.alias("evidence_ids"))
    bank = i.where("cid % 5 <> 0").select("aid", F.concat(F.lit("E"), "cid").alias("eid"), part.alias("head"), F.when(F.col("cid") % 3 == 0, "made_by").otherwise("sold_by").alias("relation"), F.when(F.col("cid") % 13 == 0, "").otherwise(supp).alias("tail"))
    even = i.where("aid % 2 = 0")
    allowed = even.select("aid", part.alias("entity")).union(even.where("s % 4 <> 0").select("aid", supp))
    edges_ = x.lineitem.join(x.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("cust "), "o_custkey").alias("src"), F.concat(F.lit("part "), "l_partkey").alias("dst"))
    return answers, claims, bank, allowed, edges_


@query("q07_statuses", f"WITH {CLAIMS} SELECT aid, cid, status, ends, outside FROM judged")
def _(x: Tables) -> DataFrame:
    """Q-07: each claim by its entities and its evidence."""
    _, claims, bank, allowed, _ = claimed(x)
    return va.judged_claims(claims, bank, allowed).select("aid", "cid", "status", "ends", "outside")


@query("q07_validation", f"""WITH {CLAIMS}, per AS (SELECT aid, count(*) AS claims, avg(CASE status WHEN 'meta' THEN 0.5 WHEN 'supported' THEN 1 ELSE 0 END) AS support, count(*) FILTER (status = 'meta') AS metas, sum(ends) AS ends, sum(outside) AS outside,
    count(*) FILTER (status <> 'meta' AND NOT cites) AS uncited, count(*) FILTER (status <> 'meta' AND cites) AS cited, count(*) FILTER (status <> 'meta' AND cites AND failing) AS failing FROM judged GROUP BY aid),
held AS (SELECT aid, count(*) AS evidence, count(DISTINCT relation) AS relations FROM bank GROUP BY aid), sizes AS (SELECT centre, count(*) AS neighbours FROM links GROUP BY centre),
met AS (SELECT a.aid, count(*) AS met FROM (SELECT DISTINCT aid, head AS e FROM c) n JOIN answers a USING (aid) JOIN links USING (centre, e) GROUP BY a.aid),
parts AS (SELECT a.aid, aspect_count, coalesce(evidence, 0) AS n, coalesce(relations, 0) AS r, CASE WHEN a.aid NOT IN (SELECT aid FROM allowed) THEN 0.8::DOUBLE WHEN coalesce(ends, 0) = 0 THEN 0.5 ELSE 1 - outside / ends END AS entity,
    greatest(0.0::DOUBLE, 1 - (coalesce(failing, 0) + coalesce(uncited, 0)) / greatest(1, coalesce(cited, 0) + coalesce(uncited, 0))) AS referenced, CASE WHEN neighbours IS NULL THEN 0.7::DOUBLE ELSE least(1.0::DOUBLE, 2 * coalesce(met, 0) / neighbours) END AS overlap,
    coalesce(support, 0.5::DOUBLE) AS support, coalesce(metas, 0) / greatest(1, coalesce(claims, 0)) AS meta FROM answers a LEFT JOIN per USING (aid) LEFT JOIN held USING (aid) LEFT JOIN met USING (aid) LEFT JOIN sizes USING (centre)),
info AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (0.30::DOUBLE * least(1.0::DOUBLE, n / 6) + 0.15::DOUBLE * least(1.0::DOUBLE, r / greatest(1, n) * 1.5::DOUBLE) + 0.25::DOUBLE * support + 0.15::DOUBLE * overlap + 0.15::DOUBLE * referenced) * (1 - 0.35::DOUBLE * least(1.0::DOUBLE, meta)))) AS information FROM parts),
conf AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.40::DOUBLE * support + 0.22::DOUBLE * referenced + 0.16::DOUBLE * entity + 0.08::DOUBLE * overlap + 0.14::DOUBLE * information)) AS c FROM info)
SELECT aid, aspect_count::INT AS aspect_count, entity, referenced, overlap, support, information, c AS confidence, CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS level, aspect_count >= 3 AND c >= 0.6 AS passed FROM conf""")
def _(x: Tables) -> DataFrame:
    """Q-07: all five parts from tables."""
    return va.validate(*claimed(x))


@query("g18_links", """WITH w AS (SELECT doc_id AS aid, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_()-]+') AS words FROM documents)
SELECT aid, entity, place - 1 AS place FROM (SELECT aid, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w) JOIN (VALUES ('the', 1), ('der', 2), ('les', 3), ('de', 4)) a(word, entity) USING (word)""")
def _(x: Tables) -> DataFrame:
    """G-18, Q-07: aliases of one word; longer ones and overlaps are tested on made texts."""
    alias = x.spark.createDataFrame([("the", 1), ("der", 2), ("les", 3), ("de", 4)], "alias string, id int")
    return va.link_entities(x.documents.select(F.col("doc_id").alias("aid"), "text"), alias, 2).select("aid", "entity", "place")


#: Documents as Markdown with a heading for each line.
MARKED = "concat('# ', source, '\\n', 'intro text\\n## Introduction\\n', text, '\\n## 2. Results\\n', text, '\\n### 2.1 Detail\\n', text, '\\n## References\\n', text)"


def marked(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", F.expr(MARKED).alias("text"))


for _name, _split in {"t01_paper": ch.paper_sections, "t02_patent": ch.patent_sections, "t04_thesis": ch.thesis_sections, "t05_book": ch.book_chapters}.items():
    # rows are tested against made texts
    query(_name)(lambda x, f=_split: ch.sections(marked(x), "doc_id", "text", f).select("doc_id", "pos", "title", "level", "method", "length"))


@query("t03_patent_metadata")
def _(x: Tables) -> DataFrame:
    found = ch.sections(x.documents.select("doc_id", F.concat(F.lit("# Abstract\n"), "text", F.lit("\n# Claims\n"), "text").alias("text")), "doc_id", "text", ch.patent_sections)
    return ch.patent_metadata(found, "doc_id").select("doc_id", F.length("abstract").alias("abstract"), F.length("claims").alias("claims"))


@query("f25_chinese_patent")
def _(x: Tables) -> DataFrame:
    """F-25; W-08 over the same texts."""
    made = x.documents.select("doc_id", F.concat(F.lit("# 摘要\n"), "text", F.lit("\n# 实施例 1\n"), "text", F.lit("\n# 实施例 2\n"), "text", F.lit("\n# 其他\n"), "text").alias("text"))
    parts = ch.chinese_patent(ch.sections(made, "doc_id", "text", ch.patent_sections), "doc_id")
    return parts.select("doc_id", "pos", "title", F.size(F.filter(ch.near_lines("body", lambda s: s.contains("the"), 2), lambda b: b)).alias("near"))


@query("g20_analysis", f"WITH {EDGES} SELECT rel, count(*) AS n FROM edges GROUP BY rel ORDER BY n DESC, rel LIMIT 20")
def _(x: Tables) -> DataFrame:
    """G-20, G-22."""
    return g.full_analysis(nodes(x), edges(x))["relations"]


@query("t08_key_paragraphs", "SELECT doc_id, substr(text, 1, 512) AS head, array_to_string(list_filter(string_split(text, chr(10)), lambda p: regexp_matches(lower(p), 'the|der|les'))[1:3], '|') AS paragraphs FROM documents")
def _(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", ch.key_paragraphs("text", ["the", "der", "les"]).alias("k")).select("doc_id", "k.head", F.array_join("k.paragraphs", "|").alias("paragraphs"))


@query("t09_sentences", "SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?;]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10))::INT AS n FROM documents")
def _(x: Tables) -> DataFrame:
    """T-09, T-11."""
    return x.documents.select("doc_id", F.size(ch.sentences("text")).alias("n"))


@query("l16_key_sentences")
def _(x: Tables) -> DataFrame:
    """L-16, W-09."""
    return x.documents.select("doc_id", F.length(ch.key_sentences("text", ["the", "der"])).alias("n"))


TOPIC = ["the", "thing", "heat", "stand"]


@query("c01_bm25", """WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?;]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10)) AS s FROM documents WHERE NOT contains(lower(text), 'license')),
w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(s), '[\\p{L}\\p{N}\\p{M}_]+'), lambda w: regexp_full_match(w, '[a-z]{2,}')) AS w FROM s),
f AS (SELECT doc_id, unnest(['the', 'thing', 'heat', 'stand']) AS k, w FROM w WHERE len(w) > 0), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda v: v = k)) AS tf FROM f)
SELECT doc_id, max(tf / (tf + 1.2 * (1 - 0.75 + 0.75 * n / 100)) * (ln(5) + 1)) AS score FROM c WHERE tf > 0 GROUP BY doc_id""")
def _(x: Tables) -> DataFrame:
    return cl.bm25(x.documents, "doc_id", "text", TOPIC, ["license"]).where("score > 0")


@query("c02_keyword_rules", "SELECT doc_id, (len(list_filter(['er', 'in', 'zz'], lambda w: contains(lower(text), w))) < 3) AND (contains(lower(text), 'the') OR len(list_filter(['and', 'ing'], lambda w: contains(lower(text), w))) >= 2) AS broad, regexp_matches(lower(text), 'agriculture|farming|crops|farm|farmers|livestock|wheat|corn|rice|soybean|vegetables|fruits') AND contains(lower(text), 'the') AS strict, contains(lower(text), 'the') AND regexp_matches(lower(text), 'and|ing') AND len(list_filter(['license', 'apache'], lambda w: contains(lower(text), w))) <= 1 AS production, NOT contains(lower(text), 'license') AND contains(lower(text), 'the') AND contains(lower(text), 'and') AND regexp_matches(lower(text), 'agriculture|cultivation|harvesting|crop|livestock|fishery|forestry|gene|breeding|fertilizer|irrigation|pesticide|soil') AS keyword FROM documents")
def _(x: Tables) -> DataFrame:
    """C-02 to C-06."""
    return x.documents.select("doc_id", cl.broad("text", ["and", "ing"], ["the"], ["er", "in", "zz"]).alias("broad"), cl.strict("text", ["the"], ["license"]).alias("strict"), cl.production("text", ["the"], [], ["and", "ing"], ["license", "apache"]).alias("production"), cl.keyword("text", ["the", "and"], ["license"]).alias("keyword"))


@query("c07_cascade")
def _(x: Tables) -> DataFrame:
    """C-07: a keyword gate, then a model trained on labels."""
    labelled = x.documents.join(x.labels, "doc_id")
    return cl.cascade(x.documents.where(F.col("text").contains("the")), labelled, "doc_id", "text", "quality").select("doc_id")


@query("c08_any", "SELECT source, bool_or(contains(text, 'idiot')) AS keep FROM documents GROUP BY source")
def _(x: Tables) -> DataFrame:
    return cl.any_positive(x.documents, "source", F.col("text").contains("idiot"))


@query("c09_species", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'rice') THEN '水稻' WHEN regexp_matches(lower(p_name), 'corn|maize') THEN '玉米' ELSE '未知' END AS species, '核心知识问答' AS category FROM part")
def _(x: Tables) -> DataFrame:
    """C-09, C-10."""
    return x.part.select("p_partkey", cl.species("p_name").alias("species"), cl.category("p_name")["category"].alias("category"))


@query("c11_weighted", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'money' WHEN 'signup' THEN 'people' WHEN 'error' THEN 'fault' END AS kind FROM events")
def _(x: Tables) -> DataFrame:
    """C-11, C-12, C-14."""
    return x.events.select("event_id", cl.weighted("event_type", {"money": [("purch", 2.0)], "people": [("sign", 1.5), ("up$", 0.5)], "fault": [("err", 1.0)]}, 0.5).alias("kind"))


@query("l14_strategies", "WITH z AS (SELECT doc_id, unnest(['a', 'b', 'c']) AS strategy, quality, toxic FROM labels), s AS (SELECT doc_id, strategy, CASE strategy WHEN 'a' THEN quality * 2 WHEN 'b' THEN toxic * 3 ELSE 1 END AS score FROM z) SELECT doc_id, strategy FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, strategy) <= 2")
def _(x: Tables) -> DataFrame:
    """L-11, L-13 to L-15: strategies scored for each seed, the two best."""
    z = o.spread(x.labels, ["a", "b", "c"]).withColumn("score", F.when(F.col("model") == "a", F.col("quality") * 2).when(F.col("model") == "b", F.col("toxic") * 3).otherwise(1))
    return o.newest(z, "doc_id", [F.desc("score"), F.col("model")], 2).select("doc_id", F.col("model").alias("strategy"))


@query("k05_graph_exports", f"WITH {EDGES}, n AS (SELECT count(*) AS n FROM (SELECT src FROM edges UNION SELECT dst FROM edges)), e AS (SELECT count(*) AS n FROM edges) SELECT kind, n.n + e.n AS n FROM n, e, (VALUES ('json'), ('cypher'), ('cytoscape'), ('gml')) k(kind)")
def _(x: Tables) -> DataFrame:
    """K-05 to K-08."""
    n, e = nodes(x), edges(x)
    made = {"json": writers.graph_json, "cypher": writers.cypher, "cytoscape": writers.cytoscape, "gml": writers.gml}
    out = [f(n, e).agg(F.lit(k).alias("kind"), F.count("value").alias("n")) for k, f in made.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("k16_records", f"WITH {QA_SQL} SELECT doc_id, length(q)::INT AS cot_length, lang AS topic FROM qa")
def _(x: Tables) -> DataFrame:
    """K-13, K-16."""
    return x.qa().select("doc_id", F.struct(F.length("q").alias("cot_length"), F.col("lang").alias("topic")).alias("meta")).select("doc_id", "meta.*")


@query("s01_json_lines", "SELECT event_id, event_type FROM events")
def _(x: Tables) -> DataFrame:
    """S-01, S-03, K-01: written as JSON lines and read back."""
    path = f"{_scratch(x)}/json"
    writers.json_out(x.events.select("event_id", "event_type"), path)
    return readers.good_and_bad(readers.json_lines(x.spark, path, "event_id long, event_type string"))[0].drop("file_name")


@query("s11_triples", f"WITH {EDGES} SELECT src::VARCHAR AS head, rel AS relation, dst::VARCHAR AS tail FROM edges")
def _(x: Tables) -> DataFrame:
    """S-11, S-13: tables are read in splits."""
    path = f"{_scratch(x)}/triples"
    writers.csv_out(edges(x).select(F.col("src").alias("source"), F.col("rel").alias("relationship"), F.col("dst").alias("target")), path)
    return readers.triples(x.spark, path).select("head", "relation", "tail")


@query("s24_seed_questions", "SELECT o_orderkey, o_orderdate::DATE AS on_date, o_orderkey % 3 = 0 AS verified, '' AS errors FROM orders")
def _(x: Tables) -> DataFrame:
    raw = x.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"), F.when(F.col("o_orderkey") % 3 == 0, "是").otherwise("No").alias("f"), F.lit("q").alias("question"))
    return readers.seed_questions(raw, ["question"], "d", "f").select("o_orderkey", "on_date", "verified", F.array_join("errors", ",").alias("errors"))


@query("r05_cache_keys", "SELECT event_id, md5(concat_ws(':', event_type, '5', 'a,b')) AS k FROM events")
def _(x: Tables) -> DataFrame:
    return x.events.select("event_id", flows.cache_key(F.col("event_type"), F.lit(5), F.array(F.lit("b"), F.lit("a"))).alias("k"))


@query("r10_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL")
def _(x: Tables) -> DataFrame:
    """R-09, R-10: the same expression over a bounded table as over a stream."""
    w = x.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")


@query("r10_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(x: Tables) -> DataFrame:
    """R-01, R-10, K-02: a stream of files, run to its end."""
    path = f"{_scratch(x)}/events"
    x.events.select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts")).repartition(3).write.parquet(path)
    rows = flows.read_files(x.spark, path, "event_id long, event_type string, value double, ts timestamp", files=1)
    flows.run(flows.first_only(rows, "ts", "3650 days", "event_id"), f"{path}-out", f"{path}-state").awaitTermination()
    return x.spark.read.parquet(f"{path}-out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("r07_state", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(x: Tables) -> DataFrame:
    """R-07, W-05, W-06: state of each group, updated batch by batch; the last state of each counts."""
    path = f"{_scratch(x)}/usage"
    x.events.select("event_type", "value").repartition(2).write.parquet(path)
    rows = flows.read_files(x.spark, path, "event_type string, value double", files=1).withColumn("ok", (F.col("value") > 0).cast("int"))
    flows.each_batch(flows.usage(rows, "event_type", "ok"), lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{path}-out"), f"{path}-state").awaitTermination()
    return x.spark.read.parquet(f"{path}-out").groupBy("event_type").agg(F.max("n").alias("n"))


@query("r07_stream_dedup", GREEDY)
def _(x: Tables) -> DataFrame:
    """R-07, D-06: three files of vectors one after another, each a micro-batch; what is kept is what a batch in that order keeps."""
    path = f"{_scratch(x)}/vectors"
    rows = x.embeddings.select(F.col("label").alias("scope"), F.col("vec_id").alias("id"), F.timestamp_seconds(F.col("vec_id") + 10**9).alias("at"), F.lit(None).cast("string").alias("text"), F.col("embedding").cast("array<double>").alias("v"))
    low, high = x.embeddings.agg(F.min("vec_id"), F.max("vec_id")).first()
    for n in range(3) if low is not None else []:
        third = F.floor((F.col("id") - low) * 3 / (high - low + 1)) == n
        rows.where(third).coalesce(1).write.mode("append").parquet(path)
    schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    flows.run(flows.keep_first(flows.read_files(x.spark, path, schema, files=1), "1 second", 0.45, 10**9), f"{path}-out", f"{path}-state").awaitTermination()
    return x.spark.read.parquet(f"{path}-out").where("how = 'kept'").select("id", F.col("scope").alias("label"))


@query("x02_service", "SELECT event_id, concat('echo: ', event_type) AS reply FROM events")
def _(x: Tables) -> DataFrame:
    """X-01, X-02, G-24."""
    return flows.Services().ask(x.events.select("event_id", "event_type"), "echo", "event_type").select("event_id", "reply")


def _scratch(x: Tables) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(x.spark)}/query-{uuid.uuid4().hex}"
