"""Entities, relations, names and density clusters on the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import claims, density, layout
from tessera.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _mentions(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("s"), F.col("event_type").alias("p"), (F.col("event_id") % 15).alias("o"), F.col("event_id").alias("article"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query("select user_id % 20 as s, event_type as p, event_id % 15 as o, count(*) as weight, least(count(*), 50) as entries, max(epoch_us(ts)) as latest from events group by 1, 2, 3")
def relation_upsert(spark, d):
    r = claims.relations(_mentions(spark, d))
    return r.select("s", "p", "o", "weight", F.size("evidence").cast("long").alias("entries"), F.col("evidence")[0]["at"].alias("latest"))


@query("select s, p, o, count(*) - count(case when article % 3 = 0 then 1 end) as weight from (select user_id % 20 as s, event_type as p, event_id % 15 as o, event_id as article from events) group by 1, 2, 3 having count(*) > count(case when article % 3 = 0 then 1 end)")
def remove_contribution(spark, d):
    m = _mentions(spark, d)
    out = claims.without_articles(claims.relations(m, 1 << 20), m.where("article % 3 = 0").select("article"))
    return out.select("s", "p", "o", "weight")


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus in ('F', 'O') and not (o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')) and not (o_orderstatus = 'O' and o_orderpriority = '5-LOW')")
def domain_range_violations(spark, d):
    rules = spark.createDataFrame([("F", "1-URGENT"), ("F", "2-HIGH"), ("O", "5-LOW")], "o_orderstatus string, o_orderpriority string")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return claims.violations(o, rules, ["o_orderpriority", "o_orderstatus"]).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("select rule, count(*) as n from (select case when value > 90 then 'extreme' when event_type = 'error' then 'error' when user_id % 7 = 0 then 'seventh' end as rule from events) group by 1")
def common_sense_rules(spark, d):
    r = claims.first_rule([("extreme", F.col("value") > 90), ("error", F.col("event_type") == "error"), ("seventh", F.col("user_id") % 7 == 0)])
    return table(spark, d, "events").groupBy(r.alias("rule")).agg(F.count("*").alias("n"))


@query("""
with g as (select user_id, event_type as v, count(*) as w from events group by 1, 2), r as (select *, case v when 'view' then 1 when 'click' then 2 when 'purchase' then 3 when 'error' then 4 else 5 end as k from g)
select user_id, arg_min(v, (-w, k)) as majority, cast(sum(w) as bigint) as total, count(case when w >= 0.25 * t then 1 end) >= 2 as conflict from (select *, sum(w) over (partition by user_id) as t from r) group by 1""")
def weighted_stance(spark, d):
    e = table(spark, d, "events").withColumn("w", F.lit(1).cast("long"))
    return claims.stance(e, ["user_id"], "event_type", "w", ["view", "click", "purchase", "error", "signup"])


@query("select o_custkey, case when count(case when o_orderstatus = 'F' then 1 end) > 0 and count(case when o_orderstatus = 'O' then 1 end) > 0 then 'contested' else 'active' end as status from orders group by 1")
def claim_status(spark, d):
    stance = F.when(F.col("o_orderstatus") == "F", "supports").when(F.col("o_orderstatus") == "O", "refutes")
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(stance).alias("s"))
    return g.select("o_custkey", claims.claim_status(F.lit("active"), F.col("s")).alias("status"))


_ENT = "select c_custkey as id, c_nationkey, c_custkey % 50 = 0 as seeded, coalesce(n, 0) as mention_count from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey"


@query(f"with e as ({_ENT}) select id, first_value(id) over (partition by c_nationkey order by seeded desc, mention_count desc, id) as target from e")
def merge_targets(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    e = table(spark, d, "customer").join(n, "c_custkey", "left").select(F.col("c_custkey").alias("id"), "c_nationkey", (F.col("c_custkey") % 50 == 0).alias("seeded"), F.coalesce("n", F.lit(0)).alias("mention_count"))
    return claims.merge_targets(e, "c_nationkey")


@query("""
with r as (select case when s % 2 = 1 then s - 1 else s end as s, p, case when o % 2 = 1 then o - 1 else o end as o, a from (select user_id % 20 as s, event_type as p, event_id % 15 as o, event_id as a from events))
select s, p, o, count(*) as weight, min(a) as first, max(a) as last from r where s <> o group by 1, 2, 3""")
def merge_entities(spark, d):
    m = _mentions(spark, d).groupBy("s", "p", "o").agg(F.count("*").alias("weight"), F.min("article").alias("first"), F.max("article").alias("last"))
    mapping = spark.range(20).select("id", (F.col("id") - F.col("id") % 2).alias("target"))
    return claims.repointed(m, mapping)


@query("select n_nationkey, cast(strpos(lower(p.t), lower(n_name)) - 1 as int) as at from nation, (select string_agg(n_name, ' and ' order by n_nationkey) as t from nation) p")
def verbatim_offsets(spark, d):
    n = table(spark, d, "nation")
    t = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]), " and ").alias("t"))
    return n.join(F.broadcast(t)).select("n_nationkey", claims.verbatim_offset(F.lower("n_name"), F.col("t"))["start"].alias("at"))


@query("""
with a as (select doc_id, split_part(text, chr(10), 1) as l from documents), e as (select * from (values (1, 'de'), (2, 'the'), (3, 'der')) e(id, name))
select doc_id as id, 0 as from_char, length(trim(l)) as to_char, string_agg(cast(e.id as varchar), ' ' order by e.id) as entities, sha1(lower(trim(regexp_replace(l, '\\s+', ' ', 'g')))) as evidence
from a join e on contains(lower(l), name) group by doc_id, l""")
def grounded_claims(spark, d):
    """First lines quoted with wider spaces: where they stand in the whole text, and whom they name."""
    docs = table(spark, d, "documents")
    quoted = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("article"), F.replace(F.substring_index("text", "\n", 1), F.lit(" "), F.lit("  ")).alias("span"), F.array(*[F.lit(i) for i in (3, 1, 2, 4)]).alias("mentioned"))
    entities = spark.createDataFrame([(1, "DE", None), (2, "The", []), (3, "none of them", ["der"])], "id int, name string, aliases array<string>")
    got = claims.grounded(quoted, docs.select(F.col("doc_id").alias("article"), "text"), entities)
    return got.select("id", F.col("start").alias("from_char"), F.col("end").alias("to_char"), F.array_join("entities", " ").alias("entities"), "evidence")


@query("select p_partkey, cast(case when p_partkey % 4 in (0, 1) then p_partkey % 25 else -1 end as bigint) as entity_id from part")
def canonical_entities(spark, d):
    """A quarter of the names is written as the entity's name, a quarter as an alias, the rest is unknown."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("The "), "n_name")).alias("aliases"), F.lit(1).cast("long").alias("mention_count"))
    p = table(spark, d, "part").join(F.broadcast(n), F.col("p_partkey") % 25 == F.col("id"))
    kind = F.col("p_partkey") % 4
    written = p.select("p_partkey", F.when(kind == 0, F.lower("name")).when(kind == 1, F.concat(F.lit("the "), F.upper("name"))).otherwise(F.concat(F.lit("?"), "name")).alias("written"))
    return claims.canonicalise(written, "written", n).select("p_partkey", F.coalesce("entity_id", F.lit(-1)).alias("entity_id"))


@query("select y as year, strftime(d, '%Y-%m-%d') as general from (select y, make_date(y, 11, 1) + ((8 - isodow(make_date(y, 11, 1))) % 7)::int + 1 as d from (select cast(2000 + n_nationkey as int) as y from nation))")
def election_dates(spark, d):
    y = (F.col("n_nationkey") + 2000).cast("int")
    return table(spark, d, "nation").select(y.alias("year"), F.date_format(names.general_election(y), "yyyy-MM-dd").alias("general"))


@query(r"""
with x as (select doc_id, regexp_replace(lower(text), '([^a-z0-9])', '\1\1', 'g') as t, regexp_replace(lower(split_part(text, chr(10), 1)), '([^a-z0-9])', '\1\1', 'g') as h from documents),
k(word, base, more) as (values ('license', 30, 5), ('version', 12, 0), ('the  end', 35, 5), ('commons', 30, 5)),
n as (select doc_id, word, base, more, len(regexp_extract_all(t, '(^|[^a-z0-9])' || word || '($|[^a-z0-9])')) as n, len(regexp_extract_all(h, '(^|[^a-z0-9])' || word || '($|[^a-z0-9])')) as m from x, k),
s as (select doc_id, sum(case when n > 0 then base + case when m > 0 then 10 else 0 end + case when n > 1 then more else 0 end else 0 end) as total, count(case when n > 0 and word <> 'version' then 1 end) as strong, sum(case when word = 'version' then n else 0 end) as weak from n group by 1),
b as (select doc_id, total + case when len(regexp_extract_all(t, '(^|[^a-z0-9])apache($|[^a-z0-9])')) > 0 then 10 else 0 end as total, strong, weak from s join x using (doc_id))
select doc_id, cast(least(100, total) as int) as strength from b where (strong > 0 or weak >= 2) and total >= 30""")
def issue_matches(spark, d):
    s = names.issue_strength(F.col("text"), ["license", "version", "the end", "commons"], {"version"}, ("apache",))
    return table(spark, d, "documents").select("doc_id", s.cast("int").alias("strength")).where("strength > 0")


@query()
def density_clusters(spark, d):
    return density.clustered(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query()
def landscape(spark, d):
    out = layout.plane(table(spark, d, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query()
def plane_clusters(spark, d):
    """Density clusters of all rows together on the plane of the principal components; noise has none.  The sequential tree is in the tests."""
    return density.leaves(density.plane(table(spark, d, "embeddings"), "vec_id", "embedding"), "vec_id", min_size=2)
