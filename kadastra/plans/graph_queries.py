"""Graph and geography of the inventory on triples that the given tables state."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from kadastra.functions import scales as N
from kadastra.operators import geography as Y
from kadastra.operators import graph as G
from kadastra.operators import ontology as O
from kadastra.operators import text as X
from kadastra.operators import walks as K
from kadastra.operators.storage import merged
from kadastra.plans.registry import query
from kadastra.plans.stand_ins import table

TRIPLES = """triples as (
select 'part:' || p_partkey as s, 'subClassOf' as p, 'brand:' || p_brand as o, 'fr' as lang from part union all
select distinct 'brand:' || p_brand, 'subClassOf', 'group:' || (length(p_brand) % 3), 'fr' from part union all
select distinct 'group:' || (length(p_brand) % 3), 'subClassOf', 'root', 'fr' from part union all
select 'part:' || p_partkey, 'label', p_name, 'fr' from part union all select 'part:' || p_partkey, 'label', upper(p_name), 'en' from part union all
select 'part:' || p_partkey, 'measures', 'type:' || p_type, 'fr' from part)"""


def triples(spark, d):
    p = table(spark, d, "part")
    part, brand, group = F.concat(F.lit("part:"), F.col("p_partkey").cast("string")), F.concat(F.lit("brand:"), F.col("p_brand")), F.concat(F.lit("group:"), (F.char_length("p_brand") % 3).cast("string"))
    row = lambda s, q, o, lang="fr": p.select(s.alias("s"), F.lit(q).alias("p"), o.alias("o"), F.lit(lang).alias("lang"))
    out = row(part, "subClassOf", brand)
    for one in (row(brand, "subClassOf", group).distinct(), row(group, "subClassOf", F.lit("root")).distinct(), row(part, "label", F.col("p_name")), row(part, "label", F.upper("p_name"), "en"), row(part, "measures", F.concat(F.lit("type:"), F.col("p_type")))):
        out = out.unionByName(one)
    return out


def nodes(spark, d):
    t = triples(spark, d)
    kind = F.split_part(F.col("uri"), F.lit(":"), F.lit(1))
    ends = t.where("p <> 'label'").select(F.explode(F.array("s", "o")).alias("uri")).distinct()
    return ends.join(G.labels(t, "label").withColumnRenamed("s", "uri"), "uri", "left").withColumn("labels", F.array(kind))


def edges(spark, d):
    return triples(spark, d).where("p <> 'label'").select(F.col("s").alias("src"), F.col("p").alias("rel"), F.col("o").alias("dst"))


EDGES = "edges as (select s as src, p as rel, o as dst from triples where p <> 'label'), ends as (select distinct unnest([src, dst]) as uri from edges)"


@query("gra1_labels", f"with {TRIPLES} select s, o as label from triples where p = 'label' qualify row_number() over (partition by s order by case lang when 'fr' then 0 else 1 end, o) = 1")
def gra1(spark, d):
    return G.labels(triples(spark, d), "label")


@query("gra2_closure", f"with recursive {TRIPLES}, up(child, parent) as (select s, o from triples where p = 'subClassOf' union select up.child, t.o from up join triples t on t.s = up.parent and t.p = 'subClassOf') select * from up")
def gra2(spark, d):
    return G.closure(triples(spark, d).where("p = 'subClassOf'").select(F.col("s").alias("child"), F.col("o").alias("parent")))


UP = "up(child, parent) as (select s, o from triples where p = 'subClassOf' union select up.child, t.o from up join triples t on t.s = up.parent and t.p = 'subClassOf')"
INDICATORS = f"""with recursive {TRIPLES}, {UP}, l as (select s, o as label from triples where p = 'label' and lang = 'fr'), m as (select s, min(o) as dimension from triples where p = 'measures' group by 1),
ind as (select child as uri, case when bool_or(parent = 'group:1') then 'objective' when bool_or(parent = 'group:2') then 'subjective' else 'unknown' end as type from up group by 1 having bool_or(parent = 'root')),
found as (select uri, label, type, dimension from ind left join l on l.s = uri left join m on m.s = uri)"""


def found_indicators(spark, d):
    return O.indicators(triples(spark, d), indicator="root", objective="group:1", subjective="group:2", measures="measures")


@query("gra2_indicators", INDICATORS + " select * from found")
def gra2_indicators(spark, d):
    return found_indicators(spark, d)


@query("gra2_dimension_labels", INDICATORS + " select distinct dimension, label from found where dimension is not null and label is not null")
def gra2_dimension_labels(spark, d):
    return O.related_labels(found_indicators(spark, d))


@query("gra2_nearest_brand", f"with recursive {TRIPLES}, walk(node, above, steps) as (select s, o, 1 from triples where p = 'subClassOf' union select node, t.o, steps + 1 from walk join triples t on t.s = walk.above and t.p = 'subClassOf') select node, above as mark, steps from walk where starts_with(above, 'brand:') or above = 'root' qualify row_number() over (partition by node order by steps, above) = 1")
def gra2_nearest(spark, d):
    e = triples(spark, d).where("p = 'subClassOf'").select(F.col("s").alias("child"), F.col("o").alias("parent"))
    marks = e.where("parent like 'brand:%' or parent = 'root'").select(F.col("parent").alias("mark"))
    return O.nearest_marked(e, marks)


@query("gra3_relation_rows", f"with {TRIPLES}, l as (select s, o as label from triples where p = 'label' and lang = 'fr') select t.s, t.p, t.o, coalesce(a.label, t.s) as s_label, coalesce(b.label, t.o) as o_label from triples t left join l a on a.s = t.s left join l b on b.s = t.o where t.p = 'measures'")
def gra3(spark, d):
    t = triples(spark, d)
    return G.relation_rows(t, ["measures"], G.labels(t, "label"))


@query("gra4_loaded_edges", f"with {TRIPLES} select distinct s as src, 'SUB_CLASS_OF' as rel, o as dst from triples where p = 'subClassOf' and not starts_with(o, 'root')")
def gra4(spark, d):
    t = triples(spark, d).where("p = 'subClassOf'")
    n = t.select(F.col("s").alias("uri"), F.lit("x").alias("kind"))
    e = t.select(F.col("s").alias("src"), F.concat(F.lit("http://onto.example/#"), "p").alias("predicate"), F.col("o").alias("dst"))
    return G.load_graph(n, e)[1]


@query("gra5_long_values", "select s_suppkey, 'acctbal' as indicator, s_acctbal as value from supplier where s_acctbal is not null union select s_suppkey, 'nation', s_nationkey from supplier")
def gra5(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"))
    return G.long_values(s, "s_suppkey", ["acctbal", "nation"])


@query("gra6_keyword_nodes", f"with {TRIPLES}, l as (select s as uri, o as label from triples where p = 'label' and lang = 'fr') select uri from l where contains(lower(label), 'red') or contains(lower(label), 'bolt') order by uri limit 20")
def gra6(spark, d):
    return G.keyword_nodes(nodes(spark, d), ["red", "bolt"], ["label"], 20).select("uri")


@query("gra7_town_context", "select s_nationkey as town, count(*) as n, md5(string_agg(s_suppkey || '=' || s_name, ',' order by s_suppkey)) as h from supplier group by 1")
def gra7(spark, d):
    s = table(spark, d, "supplier")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.concat(x["s_suppkey"].cast("string"), F.lit("="), x["s_name"])), ",")
    return s.groupBy(F.col("s_nationkey").alias("town")).agg(F.count("*").alias("n"), F.md5(listed.cast("binary")).alias("h"))


@query("gra8_node_search", f"with {TRIPLES}, {EDGES}, l as (select s as uri, o as label from triples where p = 'label' and lang = 'fr'), hit as (select uri, row_number() over (order by uri) - 1 as place from l where contains(lower(label), 'red') order by uri limit 10), r as (select src as uri, rel || ':' || dst as r from edges union select dst, rel || ':' || src from edges) select uri, count(r)::int as n_relations, round(least(1.0, 1 - 0.1 * place + least(0.05 * count(r), 0.2)), 6)::double as score from hit left join r using (uri) group by uri, place")
def gra8(spark, d):
    return G.node_search(nodes(spark, d), edges(spark, d), ["red"], 10).select("uri", F.size("relations").alias("n_relations"), F.round("score", 6).alias("score"))


@query("gra9_dropped_edges", f"with {TRIPLES}, {EDGES} select count(*) filter (where starts_with(src, 'group') or starts_with(dst, 'group') or dst = 'root') as dropped from edges")
def gra9(spark, d):
    typed = G.node_types(nodes(spark, d), ["part", "brand", "type"])
    return G.edges_of(typed, edges(spark, d))[1]


@query("gra10_counts", f"with {TRIPLES}, {EDGES}, t as (select uri, split_part(uri, ':', 1) as type from ends), u as (select 'node' as kind, type as name from t union all select 'edge', rel from edges union all select 'pattern', a.type || '-' || rel || '-' || b.type from edges join t a on a.uri = src join t b on b.uri = dst) select kind, name, count(*) as n from u group by 1, 2")
def gra10(spark, d):
    typed = G.node_types(nodes(spark, d), ["part", "brand", "group", "type", "root"])
    return G.counts(typed, edges(spark, d))


@query("gra11_neighbours", f"with {TRIPLES}, {EDGES}, b as (select src as uri, rel, dst as other, 'out' as direction from edges union all select dst, rel, src, 'in' from edges) select * from b qualify row_number() over (partition by uri order by rel, other, direction) <= 3")
def gra11(spark, d):
    return G.neighbours(nodes(spark, d), edges(spark, d))


@query("gra12_similar_nodes", "with q as (select vec_id as query_id, embedding::double[] as qe from embeddings where vec_id % 50 = 0), e as (select vec_id as doc_id, embedding::double[] as de from embeddings where label in (0, 1, 2)) select query_id, doc_id, row_number() over (partition by query_id order by 1 - list_cosine_similarity(qe, de), doc_id) as rank from q, e qualify rank <= 3")
def gra12(spark, d):
    from kadastra.plans.retrieval_queries import hits

    return hits(spark, d, 3, F.col("label").isin(0, 1, 2)).select("query_id", "doc_id", "rank")


@query("gra12_nodes_with_neighbours", """with q as (select vec_id as query_id, embedding::double[] as qe from embeddings where vec_id % 50 = 0), n as (select doc_id, lang, source, embedding::double[] as de from documents join embeddings on vec_id = doc_id where lang in ('en', 'fr')),
t as (select query_id, 'doc:' || doc_id as uri, lang as type, source, 1 - list_cosine_similarity(qe, de) as distance, row_number() over (partition by query_id order by 1 - list_cosine_similarity(qe, de), 'doc:' || doc_id) as rank from q, n qualify rank <= 3)
select query_id, uri, type, rank, round(1 - distance, 6) as score, 'lang>lang:' || type || '>LANG:' || upper(type) || case when source is null then '' else ' source>source:' || source || '>SOURCE:' || upper(source) end as around from t""")
def gra12_neighbours(spark, d):
    from kadastra.plans.retrieval_queries import EVERY, document_graph

    docs, e = document_graph(spark, d)
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = docs.join(vectors, F.col("vec_id") == F.col("doc_id")).select(F.col("node").alias("uri"), F.col("lang").alias("type"), "embedding")
    names = e.select(F.col("dst").alias("uri")).distinct().select("uri", F.upper("uri").alias("label"))
    asked = vectors.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id")
    found = K.similar_nodes(asked, near, e, 3, types=("en", "fr"), names=names)
    around = F.array_join(F.transform("neighbours", lambda x: F.concat_ws(">", x["rel"], x["other"], x["label"])), " ")
    return found.select("query_id", "uri", "type", "rank", F.round("score", 6).alias("score"), around.alias("around"))


@query("gra13_negative_pairs")
def gra13(spark, d):
    return G.negative_pairs(edges(spark, d))


@query("gra14_table_triples", "select 'customer:' || c_custkey as s, 'label' as p, c_name as o from customer union all select 'customer:' || c_custkey, 'partOf', 'nation:' || c_nationkey from customer")
def gra14(spark, d):
    n = table(spark, d, "customer")
    return G.to_triples(n, F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), [("label", F.col("c_name")), ("partOf", F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string"))), ("none", F.lit(None))])


@query("gra15_source_ids", "select 'customer' as kind, c_name as key, 'customer:' || c_custkey as id from customer union all select 'supplier', s_name, 'supplier:' || s_suppkey from supplier")
def gra15(spark, d):
    n, r = table(spark, d, "customer"), table(spark, d, "supplier")
    one = n.select(F.lit("customer").alias("kind"), F.col("c_name").alias("key"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return one.unionByName(r.select(F.lit("supplier").alias("kind"), F.col("s_name").alias("key"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id")))


@query("gra16_node_texts", "select p_partkey, p_type || '. ' || p_name || '. ' || p_brand as text from part")
def gra16(spark, d):
    return G.node_texts(table(spark, d, "part"), ["p_type", "p_name", "p_brand"]).select("p_partkey", "text")


@query("join7_point_in_area", "select c_custkey as name, case when floor(c_custkey / 10.0)::int <= (select max(c_custkey) // 20 from customer) then 'sq' || (c_custkey % 10) || ':' || floor(c_custkey / 10.0)::int end as area from customer")
def join7(spark, d):
    k = F.col("c_custkey")
    pts = table(spark, d, "customer").select(k.alias("name"), (k % 10 + 0.5).alias("x"), (F.floor(k / 10) + 0.25).alias("y"))
    return Y.point_in_area(pts, squares(spark, d)).select("name", "area")


def squares(spark, d):
    """Unit squares in rows of ten, for the lower half of the customers' numbers."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    n = c.crossJoin(F.broadcast(c.agg(F.max("c_custkey").alias("top")))).where(F.floor(k / 10) <= F.expr("top div 20")).select((k % 10).alias("i"), F.floor(k / 10).cast("int").alias("j"))
    pt = lambda a, b: F.struct((F.col("i") + a).cast("double").alias("x"), (F.col("j") + b).cast("double").alias("y"))
    return n.select(F.concat(F.lit("sq"), F.col("i").cast("string"), F.lit(":"), F.col("j").cast("string")).alias("area"), F.array(F.array(pt(0, 0), pt(1, 0), pt(1, 1), pt(0, 1), pt(0, 0))).alias("rings"))


@query("join8_adjacent_areas", "with s as (select c_custkey % 10 as i, c_custkey // 10 as j from customer where c_custkey // 10 <= (select max(c_custkey) // 20 from customer)), m(di, dj) as (values (0, 1), (0, -1), (1, 0), (-1, 0)) select 'sq' || a.i || ':' || a.j as a, 'sq' || b.i || ':' || b.j as b from s a, m, s b where b.i = a.i + di and b.j = a.j + dj")
def join8(spark, d):
    return Y.adjacent(squares(spark, d))


#: Triangles of very different sizes, by customers' balances and nations, and small ones by suppliers.
TRIANGLES = """big as (select c_custkey as k, floor(c_acctbal)::bigint as x, (c_custkey * 7 % 1500)::bigint as y, (3 + c_nationkey * c_nationkey)::bigint as s from customer where c_acctbal is not null),
small as (select s_suppkey as k, floor(s_acctbal)::bigint as x, (s_suppkey * 7 % 1500)::bigint as y, (3 + 3 * s_nationkey)::bigint as s from supplier where s_acctbal is not null),
mid as (select c_custkey as k, floor(c_acctbal)::bigint as x, (c_custkey * 7 % 1500)::bigint as y, (3 + 2 * c_nationkey)::bigint as s from customer where c_acctbal is not null)"""
#: Whether a point lies in a triangle, by the even-odd rule; its legs lie along the axes.
IN = "({y} >= b.y and {y} < b.y + b.s and {x} >= b.x and {x} < b.x + b.s - ({y} - b.y))"


def triangles(spark, d, name, prefix, side=lambda n: n * n):
    c = table(spark, d, name).where(F.col(f"{prefix}_acctbal").isNotNull())
    k, n = F.col(f"{prefix}_custkey" if prefix == "c" else f"{prefix}_suppkey"), F.col(f"{prefix}_nationkey")
    rows = c.select(k.cast("string").alias("area"), F.floor(f"{prefix}_acctbal").alias("x"), (k * 7 % 1500).alias("y"), (3 + side(n)).alias("s"))
    pt = lambda a, b: F.struct((F.col("x") + a).cast("double").alias("x"), (F.col("y") + b).cast("double").alias("y"))
    zero = F.lit(0)
    return rows.select("area", F.array(F.array(pt(zero, zero), pt(F.col("s"), zero), pt(zero, F.col("s")), pt(zero, zero))).alias("rings"))


@query("join7_centroid_areas", f"with {TRIANGLES}, p as (select k, x + s / 3.0::double as x, y + s / 3.0::double as y from small) select p.k::varchar as name, min(b.k::varchar) as area, count(b.k) as n_areas from p left join big b on {IN.format(x='p.x', y='p.y')} group by 1")
def join7_centroids(spark, d):
    small, big = triangles(spark, d, "supplier", "s", lambda n: 3 * n), triangles(spark, d, "customer", "c")
    points = small.select(F.col("area").alias("name"), Y.centroid(F.col("rings")).alias("c")).select("name", "c.x", "c.y")
    hits = Y.areas_at(points, big).groupBy("name").agg(F.count("*").alias("n_areas"), F.min("area").alias("area"))
    return points.select("name").join(merged(hits), "name", "left").select("name", "area", F.coalesce("n_areas", F.lit(0)).cast("long").alias("n_areas"))


@query("join8_touching_areas", f"""with {TRIANGLES}, near as (select a.k as ak, b.k as bk, a.x as ax, a.y as ay, a.s as sa, b.* from mid a join mid b on a.k <> b.k and a.x <= b.x + b.s and b.x <= a.x + a.s and a.y <= b.y + b.s and b.y <= a.y + a.s),
ea as (select *, unnest([[ax, ay, ax + sa, ay], [ax + sa, ay, ax, ay + sa], [ax, ay + sa, ax, ay]]) as p from near), eb as (select *, unnest([[x, y, x + s, y], [x + s, y, x, y + s], [x, y + s, x, y]]) as q from ea),
t as (select ak, bk, p, q, sign((p[3]-p[1])*(q[2]-p[2])-(p[4]-p[2])*(q[1]-p[1])) as t1, sign((p[3]-p[1])*(q[4]-p[2])-(p[4]-p[2])*(q[3]-p[1])) as t2, sign((q[3]-q[1])*(p[2]-q[2])-(q[4]-q[2])*(p[1]-q[1])) as t3, sign((q[3]-q[1])*(p[4]-q[2])-(q[4]-q[2])*(p[3]-q[1])) as t4 from eb),
cross_ as (select distinct ak, bk from t where t1 * t2 <= 0 and t3 * t4 <= 0 and least(p[1], p[3]) <= greatest(q[1], q[3]) and least(q[1], q[3]) <= greatest(p[1], p[3]) and least(p[2], p[4]) <= greatest(q[2], q[4]) and least(q[2], q[4]) <= greatest(p[2], p[4]))
select ak::varchar as a, bk::varchar as b from cross_ union select a.k::varchar, b.k::varchar from mid a join mid b on a.k <> b.k and {IN.format(x='a.x', y='a.y')}""")
def join8_touching(spark, d):
    return Y.touching(triangles(spark, d, "customer", "c", lambda n: 2 * n))


#: Runs of letters of the benchmark's texts stand for the words that name a dimension.
NAMING = (("the", "type:PROMO"), ("ion", "type:SMALL"), ("éa", "type:LARGE"), ("the", "type:SMALL"))
NAMED = f"""txt as (select item_id, text, strip_accents(lower(text)) as t from benchmark),
named as (select distinct item_id, d from txt, (values {", ".join(f"(strip_accents('{k}'), '{v}')" for k, v in NAMING)}) as k(k, d) where contains(t, k)),
brings as (select distinct dimension, label from found where label is not null qualify dense_rank() over (partition by dimension order by label) <= 5 union select distinct o, substr(o, 6) from triples where p = 'measures'),
signs as (select unnest(from_json('{{json}}', '[{{"k": "VARCHAR", "p": "VARCHAR", "l": "VARCHAR", "w": ["VARCHAR"]}}]'), recursive := true)),
terms as (select item_id, label as term from named join brings on dimension = d union select item_id, unnest(list_prepend(l, w)) from txt join signs on contains(t, k) or contains(t, p)),
five as (select item_id, term from terms qualify row_number() over (partition by item_id order by term) <= 5),
dims as (select item_id, count(*)::int as n_dimensions from named group by 1)"""
SIGNS = [{"k": k, "p": p, "l": name, "w": list(w[:2])} for k, _, inner in N.INDICATOR_PARTS for p, name, w in inner]


@query("txt25_by_ontology", INDICATORS + ", " + NAMED.replace("{json}", json.dumps(SIGNS, ensure_ascii=False)) + " select item_id, coalesce(n_dimensions, 0) as n_dimensions, text || coalesce(' ' || (select string_agg(term, ' ' order by term) from five f where f.item_id = txt.item_id), '') as enriched from txt left join dims using (item_id)")
def txt25_ontology(spark, d):
    measured = triples(spark, d).where("p = 'measures'").select(F.col("o").alias("dimension"), F.substring("o", 6, 1000).alias("label")).distinct()
    found = X.enrich_by_ontology(table(spark, d, "benchmark"), "text", NAMING, measured, O.related_labels(found_indicators(spark, d)))
    return found.select("item_id", F.size("dimensions").alias("n_dimensions"), "enriched")
