"""Queries over the test tables, and their SQL where it can be said in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebody.llm import grouping, leakage, mixing, neardup, neighbours, proportions, repetition, variety
from orebody.llm._util import table


def p1_found(spark, d):
    return proportions.unmet_targets(table(spark, d, "points"), table(spark, d, "sample_targets"))


def p1_sample(spark, d):
    return proportions.proportional_sample(table(spark, d, "points"), table(spark, d, "sample_targets"))


def p1_report(spark, d):
    """What each target needs and can get; ``p1_gaps`` has what the sample gave it."""
    found = proportions.target_report(table(spark, d, "points"), table(spark, d, "sample_targets"))
    return found.select("target_id", "available", F.round("needed", 4).alias("needed"), F.round("unmet", 4).alias("unmet"), "met")


def p1_gaps(spark, d):
    found = proportions.target_report(table(spark, d, "points"), table(spark, d, "sample_targets"))
    return found.select("target_id", "plan_name", "drawn", F.round("actual_share", 6).alias("actual_share"), F.round("gap", 6).alias("gap"))


def p5_found(spark, d):
    found = neardup.NearDuplicates(neardup.fragments(table(spark, d, "points")), shingle=3, similarity=0.5, min_words=15)
    return found.text_pairs().select("id_a", "id_b")


def p5_groups(spark, d):
    """Groups at five words and 0.8, as near-duplicate stages are by default."""
    return neardup.NearDuplicates(neardup.fragments(table(spark, d, "points"))).groups()


def p7_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark, d):
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark, d):
    return mixing.short_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_mixture(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).select("doc_id", "source", "pass", "tokens", F.round("finish", 3).alias("finish"))


def p8_report(spark, d):
    return mixing.mixture_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


QUERIES = {f.__name__: f for f in (p1_found, p1_sample, p1_report, p1_gaps, p5_found, p5_groups, p7_found, p7_report, p8_found, p8_mixture, p8_report)}

_WORDS = r"regexp_extract_all(lower(replace(replace({0}, chr(173), ''), chr(8203), '')), '[\p{{L}}\p{{N}}]+')"
_CATEGORY = "case when {0} is null or trim({0}) = '' then '{1}' else lower(trim({0})) end"
_CURRENT = "select * from (select *, row_number() over (partition by id order by seq desc) as r from points where id is not null) where r = 1"

_TARGETS = f"""with cur as (select {_CATEGORY.format('source', 'unknown')} as s, {_CATEGORY.format('layer', 'surface')} as l from ({_CURRENT})),
t as (select *, case when source is not null then {_CATEGORY.format('source', 'unknown')} end as ts, case when layer is not null then {_CATEGORY.format('layer', 'surface')} end as tl from sample_targets),
r as (select target_id, (select count(*) from cur where (ts is null or s = ts) and (tl is null or l = tl)) as available, greatest(min_rows::double, target_share * sample_share * (select count(*) from cur)) as needed from t)"""
# the shingle set of each text as a sorted list, classes of equal sets, pairs of classes, and their chains
_SHINGLED = """w as (select id, {words} as w from ({current}) where fragment is not null),
s as (select distinct id, list_aggregate(w[i : i + {n} - 1], 'string_agg', ' ') as g from (select id, w, unnest(range(1, len(w) - {n} + 2)) as i from w where len(w) >= {least})),
e as (select id, list(g order by g) as k from s group by id),
c as (select id, min(id) over (partition by k) as class_id, len(k) as n from e),
p as (select a.id as x, b.id as y, count(*) as common from s a join s b on a.g = b.g and a.id < b.id where a.id in (select class_id from c) and b.id in (select class_id from c) group by all),
l as (select x, y from p join c cx on cx.id = x join c cy on cy.id = y where common >= {share} * (cx.n + cy.n - common))"""
# a plain tokenizer: words and single other characters
_TOKENS = r"coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')), 0)"

ORACLES = {
    "p1_found": f"{_TARGETS} select target_id from r where available < needed",
    "p1_report": f"{_TARGETS} select target_id, available, round(needed, 4) as needed, round(greatest(0, needed - available), 4) as unmet, available >= needed as met from r",
    "p5_found": f"""
with cur as ({_CURRENT}),
w as (select id, {_WORDS.format('fragment')} as w from cur where fragment is not null),
s as (select distinct id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 15)),
n as (select id, count(*) as n from s group by id),
c as (select a.id as id_a, b.id as id_b, count(*) as c from s a join s b on a.g = b.g and a.id < b.id group by all)
select id_a, id_b from c join n na on na.id = id_a join n nb on nb.id = id_b where c >= 0.5 * (na.n + nb.n - c)
""",
    "p5_groups": f"""
with recursive {_SHINGLED.format(words=_WORDS.format('fragment'), current=_CURRENT, n=5, least=5, share=0.8)},
d as (select class_id, count(*) as links from (select x as class_id from l union all select y from l) group by class_id),
b as (select x, y from l union all select y, x from l),
walk(id, other) as (select distinct class_id, class_id from c union select w.id, b.y from walk w join b on w.other = b.x),
g as (select id as class_id, min(other) as group_id from walk group by id)
select c.id, c.class_id, g.group_id, coalesce(d.links, 0) as links from c join g using (class_id) left join d using (class_id) where d.links is not null or (select count(*) from c o where o.class_id = c.class_id) > 1
""",
    "p7_found": f"""
with {{leaked}} select doc_id, item_id from leaked
""",
    "p7_report": f"""
with {{leaked}} select i.item_id, i.benchmark, count(*) as documents from eval_items i join leaked using (item_id) group by i.item_id, i.benchmark
""",
    "p8_found": f"""
with d as (select {_CATEGORY.format('source', 'unknown')} as s, sum({_TOKENS}) as t from documents group by s)
select {_CATEGORY.format('source', 'unknown')} as source from mix_targets left join d on d.s = {_CATEGORY.format('source', 'unknown')} group by 1 having max(coalesce(max_repeats, 1)) * max(coalesce(t, 0)) < sum(target_share) * 0.4 * (select sum(t) from d)
""",
}
_LEAKED = f"""d as (select doc_id, {_WORDS.format('text')} as w from documents where text is not null),
i as (select item_id, {_WORDS.format('text')} as w from eval_items where text is not null),
q as (select distinct item_id, least(12, len(w)) as n, list_aggregate(w[p : p + least(12, len(w)) - 1], 'string_agg', ' ') as g from (select item_id, w, unnest(range(1, greatest(1, len(w) - 11) + 1)) as p from i where len(w) > 0)),
sizes as (select distinct n from q),
r as (select distinct doc_id, n, list_aggregate(w[p : p + n - 1], 'string_agg', ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
leaked as (select distinct doc_id, item_id from r join q using (n, g))"""
for _name in ("p7_found", "p7_report"):
    ORACLES[_name] = ORACLES[_name].replace("{leaked}", _LEAKED)


def p6_found(spark, d):
    return neighbours.similar_pairs(table(spark, d, "points")).select("chunk_a_id", "chunk_b_id")


def p6_links(spark, d):
    """The 5 most similar of every 50th id, over all rows."""
    points = table(spark, d, "points")
    asked = points.where("id % 50 = 0").select("id").distinct()
    found = neighbours.VectorIndex(points, copies=4, copy_ratio=1.2).neighbours(5, asked, open_lists=64, ratio=1.18)
    return found.select("id", F.col("neighbour").alias("linked_id"), F.round("similarity", 6).alias("similarity"), "rank")


QUERIES |= {f.__name__: f for f in (p6_found, p6_links)}
_DOT = "list_inner_product({0}::double[], {1}::double[])"
_VECTORS = f"select id, embedding::double[] as e, sqrt({_DOT.format('embedding', 'embedding')}) as m from ({_CURRENT}) where len(embedding) = 96 and {_DOT.format('embedding', 'embedding')} > 0"
_NEAREST = f"""
with v as ({_VECTORS}),
s as (select a.id as id, b.id as linked_id, {_DOT.format('a.e', 'b.e')} / (a.m * b.m) as s from v a, v b where a.id % 50 = 0 and a.id <> b.id)
select id, linked_id, round(s, 6) as similarity, r::int as rank from (select *, row_number() over (partition by id order by s desc, linked_id) as r from s) where r <= 5
"""
ORACLES |= {
    "p6_links": _NEAREST,
    "p6_found": f"""
with v as ({_VECTORS}),
s as (select a.id as x, b.id as y, {_DOT.format('a.e', 'b.e')} / (a.m * b.m) as s from v a, v b where a.id <> b.id and {_DOT.format('a.e', 'b.e')} / (a.m * b.m) >= 0.95),
r as (select x, y, row_number() over (partition by x order by s desc, y) as r from s)
select distinct least(x, y) as chunk_a_id, greatest(x, y) as chunk_b_id from r where r <= 5
""",
}


def p3_found(spark, d):
    return grouping.grouped_points(table(spark, d, "points"))


def p3_clusters(spark, d):
    """Size and coherence of each group, and its centroid as one text of rounded numbers."""
    found = grouping.Clusters(table(spark, d, "points")).describe()
    return found.select("group_id", "size", F.round("coherence", 4).alias("coherence"), F.array_join(F.transform("centroid", lambda x: F.format_string("%.3f", F.round(x, 3) + 0.0)), " ").alias("centroid"))


def p3_typical(spark, d):
    found = grouping.Clusters(table(spark, d, "points")).typical()
    return found.select("group_id", "rank", "id")


def p3_components(spark, d):
    found = grouping.Clusters(table(spark, d, "points")).components()
    return found.select("component", "size", F.round("mean_log_density", 3).alias("mean_log_density"), "typical_ids")


def p3_members(spark, d):
    found = grouping.Clusters(table(spark, d, "points")).member_lists()
    return found.select("group_id", "part", F.array_join(F.col("vector_ids").cast("array<string>"), " ").alias("vector_ids"))


QUERIES |= {f.__name__: f for f in (p3_found, p3_clusters, p3_typical, p3_components, p3_members)}
_GROUPED = f"""with recursive v as ({_VECTORS}),
s as (select a.id as x, b.id as y from v a, v b where a.id <> b.id and {_DOT.format('a.e', 'b.e')} / (a.m * b.m) >= 0.80),
walk(id, other) as (select id, id from v union select w.id, s.y from walk w join s on w.other = s.x),
g as (select group_id, id from (select id, min(other) as group_id, count(*) as n from walk group by id) where n >= 5)"""
ORACLES |= {
    "p3_found": f"{_GROUPED} select group_id, id from g",
    "p3_clusters": f"""{_GROUPED},
c as (select group_id, pos, avg(x) as c from (select g.group_id, unnest(range(0, 96)) as pos, unnest(list_transform(v.e, lambda t: t / v.m)) as x from g join v using (id)) group by group_id, pos)
select group_id, (select count(*) from g where g.group_id = c.group_id) as size, round(sqrt(sum(c * c)), 4) as coherence, string_agg(printf('%.3f', round(c, 3) + 0.0), ' ' order by pos) as centroid from c group by group_id
""",
    "p3_members": f"{_GROUPED} select group_id, part::int as part, string_agg(id::varchar, ' ' order by id) as vector_ids from (select group_id, id, ('0x' || substr(md5(id::varchar), 1, 8))::bigint % ceil(count(*) over (partition by group_id) / 4096.0)::bigint as part from g) group by group_id, part",
}


def p2_subset(spark, d):
    return variety.varied_subset(table(spark, d, "points"))


def p9_found(spark, d):
    return repetition.repetitive(table(spark, d, "documents"))


def p9_perplexity(spark, d):
    found = repetition.judged(table(spark, d, "documents"))
    return found.select("doc_id", "lang", "n_words", F.round("perplexity", 3).alias("perplexity"), F.round("repeated_share", 6).alias("repeated_share"), "verdict")


QUERIES |= {f.__name__: f for f in (p2_subset, p9_found, p9_perplexity)}
ORACLES |= {
    "p9_found": f"""
with d as (select doc_id, {_WORDS.format('text')} as w from documents where text is not null),
r as (select doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 30)),
c as (select doc_id, g, count(*) as n from r group by doc_id, g)
select doc_id from c group by doc_id having sum(case when n > 1 then n else 0 end) >= 0.3 * sum(n)
""",
}
