"""Queries on choosing and comparing policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions.numeric import ratio
from attestor.operators import metrics, policy, sampling
from attestor.plans.registry import query


@query("oracle_vs_static", """
WITH s AS (SELECT n_regionkey AS region, n_nationkey AS nation, c_mktsegment AS action, avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.0 END) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
o AS (SELECT region, nation, max(score) AS best FROM s GROUP BY 1, 2), om AS (SELECT region, avg(best) AS oracle FROM o GROUP BY 1),
st AS (SELECT region, action, sum(score) AS total, avg(score) AS mean FROM s GROUP BY 1, 2),
sb AS (SELECT region, action AS static_action, mean AS static FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(total, 9) DESC, action DESC) AS rn FROM st) WHERE rn = 1)
SELECT om.region AS region, static_action, round(oracle, 6) AS oracle, round(static, 6) AS static, round(oracle - static, 6) AS gap FROM om JOIN sb ON om.region = sb.region""")
def oracle_vs_static(t):
    """What the best action for each nation gains over the best one action for its region."""
    s = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = s.groupBy(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("c_mktsegment").alias("action")).agg(F.avg((F.col("c_acctbal") > 5000).cast("double")).alias("score"))
    oracle = s.groupBy("region", "nation").agg(F.max("score").alias("best")).groupBy("region").agg(F.avg("best").alias("oracle"))
    per = s.groupBy("region", "action").agg(F.sum("score").alias("total"), F.avg("score").alias("mean"))
    best = per.groupBy("region").agg(policy.largest_id_wins(F.struct("action", "mean"), F.round("total", 9), "action").alias("b"))
    d = oracle.join(best, "region")
    return d.select("region", F.col("b.action").alias("static_action"), F.round("oracle", 6).alias("oracle"), F.round("b.mean", 6).alias("static"), F.round(F.col("oracle") - F.col("b.mean"), 6).alias("gap"))


@query("argmax_tiebreak", """
SELECT c_nationkey AS nation, c_custkey AS choice FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000) DESC, c_custkey DESC) AS rn FROM customer) WHERE rn = 1""")
def argmax_tiebreak(t):
    return t("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(policy.largest_id_wins("c_custkey", F.floor(F.col("c_acctbal") / 1000)).alias("choice"))


@query("argmin_cost_tiebreak", """
SELECT p_brand AS brand, p_partkey AS choice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, floor(p_retailprice / 100), p_partkey) AS rn FROM part) WHERE rn = 1""")
def argmin_cost_tiebreak(t):
    return t("part").groupBy(F.col("p_brand").alias("brand")).agg(policy.smallest_id_wins("p_partkey", -F.col("p_size"), F.floor(F.col("p_retailprice") / 100)).alias("choice"))


@query("first_in_file_order", """
SELECT l_orderkey AS orderkey, l_linenumber AS choice, l_quantity AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def first_in_file_order(t):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    d = t("lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(policy.first_wins(F.struct("l_linenumber", "l_quantity"), "l_quantity", order).alias("r"))
    return d.select("orderkey", F.col("r.l_linenumber").alias("choice"), F.col("r.l_quantity").alias("quantity"))


@query("random_expected_ratio", """
WITH o AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
m AS (SELECT o_orderpriority AS priority, avg(n) AS mn, avg(r) AS mr FROM o JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT priority, round(mn, 6) AS expected_new, round(mr, 6) AS expected_bad, round(CASE WHEN mn + mr = 0 THEN NULL ELSE mr / (mn + mr) END, 6) AS bad_rate FROM m""")
def random_expected_ratio(t):
    o = t("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    m = o.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.avg("n").alias("mn"), F.avg("r").alias("mr"))
    return m.select("priority", F.round("mn", 6).alias("expected_new"), F.round("mr", 6).alias("expected_bad"), F.round(ratio("mr", F.col("mn") + F.col("mr")), 6).alias("bad_rate"))


@query("family_oracles", """
WITH f AS (SELECT DISTINCT p_type AS family FROM part), b AS (SELECT DISTINCT p_brand AS brand FROM part),
m AS (SELECT p_brand AS brand, p_type AS family, max(p_size) AS best FROM part WHERE p_size < 20 GROUP BY 1, 2)
SELECT f.family AS family, count(*) AS groups_n, sum(coalesce(best, 0)) AS total FROM f CROSS JOIN b LEFT JOIN m ON m.brand = b.brand AND m.family = f.family GROUP BY 1""")
def family_oracles(t):
    part = t("part")
    d = policy.family_best(part.where("p_size < 20"), part, part, "p_brand", "p_type", "p_size")
    return d.groupBy(F.col("p_type").alias("family")).agg(F.count("*").alias("groups_n"), F.sum("p_size").cast("long").alias("total"))


@query("method_metric_long", """
WITH o AS (SELECT o_custkey AS g, o_orderkey AS id, o_totalprice AS price, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent FROM orders),
a AS (SELECT g, id, price, urgent, row_number() OVER (PARTITION BY g ORDER BY price DESC, id DESC) AS r1, row_number() OVER (PARTITION BY g ORDER BY urgent DESC, id DESC) AS r2, row_number() OVER (PARTITION BY g ORDER BY abs(price - 150000), id) AS r3 FROM o),
c AS (SELECT 'dearest' AS method, g, price, urgent FROM a WHERE r1 = 1 UNION ALL SELECT 'urgent', g, price, urgent FROM a WHERE r2 = 1 UNION ALL SELECT 'central', g, price, urgent FROM a WHERE r3 = 1)
SELECT method, metric, round(avg(v), 4) AS value, count(*) AS n FROM (SELECT method, 'price' AS metric, price AS v FROM c UNION ALL SELECT method, 'urgent', CAST(urgent AS DOUBLE) FROM c) GROUP BY 1, 2""")
def method_metric_long(t):
    o = t("orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"))
    row = F.struct("id", "price", "urgent")
    d = o.groupBy("g").agg(policy.largest_id_wins(row, "price", "id").alias("dearest"), policy.largest_id_wins(row, "urgent", "id").alias("urgent_first"), policy.smallest_id_wins(row, F.abs(F.col("price") - 150000), "id").alias("central"))
    d = d.select("g", F.inline(F.array(*[F.struct(F.lit(n).alias("method"), F.col(c + ".price").alias("price"), F.col(c + ".urgent").alias("urgent")) for n, c in (("dearest", "dearest"), ("urgent", "urgent_first"), ("central", "central"))])))
    long = d.unpivot(["g", "method"], ["price", "urgent"], "metric", "v")
    return long.groupBy("method", "metric").agg(F.round(F.avg("v"), 4).alias("value"), F.count("*").alias("n"))


@query("paired_difference", """
WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), lo AS (SELECT min(y) AS a FROM y)
SELECT count(*) AS pairs, round(avg(b.v - a.v), 4) AS mean_difference, round(min(b.v - a.v), 4) AS least FROM y a JOIN y b ON a.k = b.k JOIN lo ON a.y = lo.a AND b.y = lo.a + 1""")
def paired_difference(t):
    y = t("orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    first = y.agg(F.min("y").alias("a"))
    a, b = (y.join(F.broadcast(first), F.col("y") == F.col("a") + n).select("k", "v") for n in (0, 1))
    d = metrics.paired_difference(b, a, ["k"], "v")
    return d.agg(F.count("*").alias("pairs"), F.round(F.avg("difference"), 4).alias("mean_difference"), F.round(F.min("difference"), 4).alias("least"))


@query("epsilon_top_set", """
SELECT c_nationkey AS nation, count(*) AS tied, min(c_custkey) AS first_id FROM (SELECT *, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS m FROM customer) WHERE m - c_acctbal <= 250 GROUP BY 1""")
def epsilon_top_set(t):
    return metrics.epsilon_top(t("customer"), ["c_nationkey"], "c_acctbal", 250).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("tied"), F.min("c_custkey").alias("first_id"))


SCORES = "SELECT n_regionkey AS region, n_nationkey AS nation, c_mktsegment AS action, round(avg(c_acctbal) / 9973, 6) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3"


def scores(t):
    d = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("c_mktsegment").alias("action")).agg(F.round(F.avg("c_acctbal") / 9973, 6).alias("score"))


@query("caption_necessity", f"""
WITH s AS ({SCORES}), b AS (SELECT region, avg(m) AS adaptive FROM (SELECT region, nation, max(score) AS m FROM s GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT region, max(a) AS fixed FROM (SELECT region, action, avg(score) AS a FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT b.region AS region, round(adaptive, 7) AS adaptive, round(fixed, 7) AS static, round(adaptive - fixed, 7) AS gap FROM b JOIN f ON b.region = f.region""")
def caption_necessity(t):
    d = metrics.necessity(scores(t), "region", "nation", "action", "score")
    return d.select("region", F.round("adaptive", 7).alias("adaptive"), F.round("static", 7).alias("static"), F.round("gap", 7).alias("gap"))


@query("pair_regret_switch", f"""
WITH s AS ({SCORES}), p AS (SELECT a.region, a.nation AS l, b.nation AS r, a.action, a.score AS x, b.score AS y FROM s a JOIN s b ON a.region = b.region AND a.action = b.action AND a.nation < b.nation),
w AS (SELECT *, max(x) OVER (PARTITION BY l, r) AS mx, max(y) OVER (PARTITION BY l, r) AS my FROM p)
SELECT l AS left_nation, r AS right_nation, round(max(my) - min(CASE WHEN mx - x <= 0.01 THEN y END), 6) AS pair_regret, NOT bool_or(mx - x <= 0.01 AND my - y <= 0.01) AS apart,
(NOT bool_or(mx - x <= 0.01 AND my - y <= 0.01)) AND greatest(max(my) - max(CASE WHEN mx - x <= 0.01 THEN y END), max(mx) - max(CASE WHEN my - y <= 0.01 THEN x END)) >= 0.05 AS material FROM w GROUP BY 1, 2""")
def pair_regret_switch(t):
    from attestor.operators.joins import pairs_within

    p = pairs_within(scores(t), ["region", "action"], "nation", ["score"])
    d = metrics.switches(p, "action", "score_l", "score_r", ["nation_l", "nation_r"])
    return d.select(F.col("nation_l").alias("left_nation"), F.col("nation_r").alias("right_nation"), F.round("pair_regret", 6).alias("pair_regret"), "apart", "material")


@query("cluster_macro_mean", """
WITH a AS (SELECT n_regionkey, n_nationkey, c_mktsegment, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
b AS (SELECT n_regionkey, n_nationkey, avg(v) AS v FROM a GROUP BY 1, 2), c AS (SELECT n_regionkey, avg(v) AS v FROM b GROUP BY 1) SELECT round(avg(v), 4) AS value, count(*) AS groups_n FROM c""")
def cluster_macro_mean(t):
    d = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return metrics.macro_mean(d, ["n_regionkey", "n_nationkey", "c_mktsegment"], "c_acctbal").select(F.round("value", 4).alias("value"), F.col("groups").alias("groups_n"))


@query("one_per_group_hash", """
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('17:' || source || ':' || CAST(doc_id AS VARCHAR))) AS rn FROM documents) WHERE rn = 1 ORDER BY sha256('17:' || source) LIMIT 12""")
def one_per_group_hash(t):
    return sampling.one_per_group(t("documents").select("source", "doc_id"), "source", ["source", "doc_id"], 17, 12)


@query("first_n_per_group", """
SELECT k AS custkey, o_orderkey AS orderkey, rn FROM (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n >= 2 AND rn <= 2""")
def first_n_per_group(t):
    o = t("orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    many = o.groupBy("custkey").agg(F.count("*").alias("n")).where("n >= 2")
    d = sampling.first_n(o.join(many.select("custkey"), "custkey", "left_semi"), "custkey", ["orderkey"], 2)
    return sampling.ranked(d, ["custkey"], [F.col("orderkey")]).withColumn("rn", F.col("rn").cast("long"))


@query("topk_priority_dedupe", """
WITH p AS (SELECT l_suppkey AS s, l_partkey AS p, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS pr FROM lineitem GROUP BY 1, 2)
SELECT s AS suppkey, p AS partkey, pr AS priority, rn FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY pr, p) AS rn FROM p) WHERE rn <= 3""")
def topk_priority_dedupe(t):
    pr = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    d = sampling.top_k_by_priority(t("lineitem").withColumn("pr", pr), "l_suppkey", ["l_partkey"], ["pr"], 3)
    return d.select(F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("partkey"), F.col("priority.pr").alias("priority"), F.col("rn").cast("long").alias("rn"))


@query("last_wins_upsert", """
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def last_wins_upsert(t):
    return sampling.last_wins(t("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("round_robin_sample", """
SELECT lang, doc_id, rn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('5:' || CAST(doc_id AS VARCHAR))) AS rn FROM documents) ORDER BY rn, lang LIMIT 50""")
def round_robin_sample(t):
    from attestor.functions.hashing import hash_order

    return sampling.round_robin(t("documents").select("lang", "doc_id"), "lang", [hash_order(5, "doc_id")], 50).withColumn("rn", F.col("rn").cast("long"))


@query("stratified_fixed_n", """
WITH s AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'both' WHEN quality = 1 THEN 'quality_only' WHEN toxic = 1 THEN 'toxic_only' ELSE 'neither' END AS stratum FROM labels)
SELECT stratum, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('9:' || CAST(doc_id AS VARCHAR))) AS rn FROM s) WHERE (stratum = 'quality_only' AND rn <= 3) OR (stratum = 'neither' AND rn <= 2) OR (stratum = 'both' AND rn <= 1)""")
def stratified_fixed_n(t):
    from attestor.functions.hashing import hash_order

    q, x = F.col("quality") == 1, F.col("toxic") == 1
    stratum = F.when(q & x, "both").when(q, "quality_only").when(x, "toxic_only").otherwise("neither")
    d = sampling.fixed_per_stratum(t("labels").select("doc_id", "quality", "toxic"), stratum, {"quality_only": 3, "neither": 2, "both": 1}, [hash_order(9, "doc_id")])
    return d.select("stratum", "doc_id")


@query("prefix_offsets", """
WITH o AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey AS orderkey, CAST(max(a + q) AS BIGINT) AS size_total, min(n) AS lines, CAST(sum(a) AS BIGINT) AS start_total FROM o GROUP BY 1""")
def prefix_offsets(t):
    d = t("lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    d = sampling.offsets(d, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "q")
    return d.groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.max("stop").alias("size_total"), F.count("*").alias("lines"), F.sum("start").alias("start_total"))


@query("ordered_limits", """
SELECT orderkey, pos FROM (SELECT o_orderkey AS orderkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey) AS pos FROM orders) WHERE pos <= 40""")
def ordered_limits(t):
    first = F.when(F.col("o_orderpriority") == "5-LOW", 1).when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(3)
    d = t("orders").select("o_orderkey", "o_totalprice", first.alias("f")).orderBy("f", F.desc("o_totalprice"), "o_orderkey").limit(40)
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(1)).orderBy("f", F.desc("o_totalprice"), "o_orderkey")  # over the 40 rows
    return d.select(F.col("o_orderkey").alias("orderkey"), F.row_number().over(w).cast("long").alias("pos"))
