"""Reports and lookups: paging, edges and bridges of a star schema, parents, constructed keys, consistency, recall."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import Tables, query


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 10 offset 20")
def offset_page(t: Tables):
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(20).limit(10)


@query("""select a.n_name as source, b.n_name as target, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
join nation a on s_nationkey = a.n_nationkey join nation b on c_nationkey = b.n_nationkey group by 1, 2""")
def edge_ends(t: Tables):
    """Edges from suppliers' to customers' nations: counted by key first, so that both lookups see a row for each edge."""
    sold = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = sold.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = ends.groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nation = lambda key, name: t.nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    return edges.join(nation("s_nationkey", "source"), "s_nationkey").join(nation("c_nationkey", "target"), "c_nationkey").select("source", "target", "n")


@query("select s_suppkey, count(distinct p_brand) as n_brands, array_to_string(list_sort(list(distinct p_brand)), ',') as brands from supplier join lineitem on s_suppkey = l_suppkey join part on l_partkey = p_partkey group by 1")
def bridge_lists(t: Tables):
    """What each supplier is joined with over a bridge table; the list has one entry for each distinct value."""
    pairs = t.lineitem.select("l_suppkey", "l_partkey").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()
    brands = pairs.groupBy("l_suppkey").agg(F.array_sort(F.collect_list("p_brand")).alias("b"))
    return t.supplier.select("s_suppkey").join(brands, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", F.size("b").cast("long").alias("n_brands"), F.array_join("b", ",").alias("brands"))


@query("select a.conv_id, a.turn, a.role, b.role as parent_role from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1")
def parent_lookup(t: Tables):
    child = t.conversations.select("conv_id", "turn", "role")
    parent = child.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"))
    return child.join(parent, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "parent_role")


@query("select doc_id, printf('user_%04d', doc_id) as user_key, count(turn) as messages from labels left join conversations on printf('user_%04d', conv_id) = printf('user_%04d', doc_id) group by 1, 2")
def constructed_key(t: Tables):
    sessions = t.conversations.groupBy(F.format_string("user_%04d", "conv_id").alias("user_key")).agg(F.count("turn").alias("n"))
    asked = t.labels.select("doc_id", F.format_string("user_%04d", "doc_id").alias("user_key"))
    return asked.join(sessions, "user_key", "left").select("doc_id", "user_key", F.coalesce("n", F.lit(0)).alias("messages"))


@query("select count(*) > 0 as has_vectors, (select count(*) from conversations) > 0 as has_messages, count(*) >= (select count(*) from conversations) as vectors_cover_messages from embeddings")
def store_consistency(t: Tables):
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both = counted(t.embeddings, "v").withColumn("one", F.lit(1)).join(counted(t.conversations, "m").withColumn("one", F.lit(1)), "one")
    return both.select((F.col("v") > 0).alias("has_vectors"), (F.col("m") > 0).alias("has_messages"), (F.col("v") >= F.col("m")).alias("vectors_cover_messages"))


@query("select lang, doc_id, cast(r as int) as rank from (select lang, doc_id, row_number() over (partition by lang order by n_chars desc, doc_id) as r from documents) where r <= 3")
def first_per_class(t: Tables):
    ranks = t.documents.select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return ranks.where("rank <= 3")


@query("""with r as (select *, row_number() over (partition by user_id order by value desc, event_id) as r from events)
select user_id, round(count(*) filter (r <= 5 and event_type = 'purchase') / 5.0, 6) as precision_at_5, round(case when count(*) filter (event_type = 'purchase') = 0 then 0 else count(*) filter (r <= 5 and event_type = 'purchase') / cast(count(*) filter (event_type = 'purchase') as double) end, 6) as recall_at_5 from r group by 1""")
def recall_at_k(t: Tables):
    """Hits of a ranked list against what is wanted, counted rather than listed."""
    wanted = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("gold"))
    ranks = t.events.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).where("r <= 5")
    hits = ranks.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("hits"))
    recall = F.when(F.col("gold") == 0, 0.0).otherwise(F.col("hits") / F.col("gold"))
    return wanted.join(hits, "user_id").select("user_id", F.round(F.col("hits") / 5, 6).alias("precision_at_5"), F.round(recall, 6).alias("recall_at_5"))


@query("select source, count(*) as n, count(*) filter (quality = 1) as good, count(*) filter (toxic = 1) as toxic, count(distinct lang) as langs, round(100.0 * count(*) filter (quality = 1) / count(*), 6) as good_percent from documents join labels using (doc_id) group by 1")
def label_summary(t: Tables):
    both = t.documents.select("doc_id", "source", "lang").join(t.labels.select("doc_id", "quality", "toxic"), "doc_id")
    good = F.count_if(F.col("quality") == 1)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), good.alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_distinct("lang").alias("langs"), F.round(100.0 * good / F.count(F.lit(1)), 6).alias("good_percent"))


@query("select lang, cast(floor(avg(try_cast(regexp_extract(text, '([0-9]{4})', 1) as int))) as bigint) as mean_number from documents group by 1")
def mean_of_castable(t: Tables):
    number = F.expr("try_cast(regexp_extract(text, '([0-9]{4})', 1) as int)")
    return t.documents.select("lang", number.alias("x")).groupBy("lang").agg(F.floor(F.avg("x")).alias("mean_number"))
