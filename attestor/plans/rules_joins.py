"""Queries on rules, scans and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import hashing as h
from attestor.functions import vectors as v
from attestor.operators import joins, policy, rules, similarity
from attestor.plans.registry import query


@query("violations_unique_fk", """
WITH u AS (SELECT 'unique' AS rule, 'orders' AS tbl, CAST(o_custkey AS VARCHAR) AS k FROM orders GROUP BY o_custkey HAVING count(*) > 1),
r AS (SELECT 'reference' AS rule, 'customer' AS tbl, CAST(c_custkey AS VARCHAR) AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)),
l AS (SELECT 'reference' AS rule, 'lineitem' AS tbl, CAST(l_orderkey AS VARCHAR) AS k FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey))
SELECT rule, tbl, count(*) AS violations, min(k) AS first_key FROM (SELECT * FROM u UNION ALL SELECT * FROM r UNION ALL SELECT * FROM l) GROUP BY rule, tbl""")
def violations_unique_fk(t):
    customer, orders, lineitem = t("customer"), t("orders"), t("lineitem")
    d = rules.every(rules.unique(orders, "orders", ["o_custkey"]), rules.references(customer, "customer", "c_custkey", orders, "o_custkey"), rules.references(lineitem, "lineitem", "l_orderkey", orders, "o_orderkey"))
    return d.groupBy(F.split("rule", ":")[0].alias("rule"), F.col("table").alias("tbl")).agg(F.count("*").alias("violations"), F.min("key").alias("first_key"))


@query("violations_enum_range", """
SELECT rule, tbl, count(*) AS n FROM (
SELECT 'status' AS rule, 'orders' AS tbl FROM orders WHERE coalesce(o_orderstatus, '') NOT IN ('O', 'F')
UNION ALL SELECT 'price', 'orders' FROM orders WHERE NOT coalesce(o_totalprice > 50000, false)
UNION ALL SELECT 'urgent_is_open', 'orders' FROM orders WHERE NOT coalesce(o_orderpriority <> '1-URGENT' OR o_orderstatus = 'O', false)
UNION ALL SELECT 'quality', 'labels' FROM labels WHERE NOT coalesce(quality IN (0, 1), false)
UNION ALL SELECT 'toxic_is_bad', 'labels' FROM labels WHERE NOT coalesce(toxic = 0 OR quality = 0, false)
UNION ALL SELECT 'type', 'events' FROM events WHERE NOT coalesce(event_type IN ('click', 'view', 'purchase'), false)
UNION ALL SELECT 'value', 'events' FROM events WHERE NOT coalesce(value BETWEEN 1 AND 50, false)) GROUP BY rule, tbl""")
def violations_enum_range(t):
    c = F.col
    o = rules.rows(t("orders"), "orders", ["o_orderkey"], status=c("o_orderstatus").isin("O", "F"), price=c("o_totalprice") > 50000, urgent_is_open=(c("o_orderpriority") != "1-URGENT") | (c("o_orderstatus") == "O"))
    lab = rules.rows(t("labels"), "labels", ["doc_id"], quality=c("quality").isin(0, 1), toxic_is_bad=(c("toxic") == 0) | (c("quality") == 0))
    e = rules.rows(t("events"), "events", ["event_id"], type=c("event_type").isin("click", "view", "purchase"), value=c("value").between(1, 50))
    return rules.every(o, lab, e).groupBy("rule", c("table").alias("tbl")).agg(F.count("*").alias("n"))


@query("coverage_set_equality", """
SELECT side, count(*) AS n, min(doc_id) AS first_id FROM (
SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'unexpected', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
UNION ALL SELECT 'both', doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) GROUP BY side""")
def coverage_set_equality(t):
    d, lab = t("documents").select("doc_id"), t("labels").select("doc_id")
    odd = rules.same_keys(lab, d, "documents", ["doc_id"]).select(F.col("detail").alias("side"), F.col("key").cast("long").alias("doc_id"))
    both = d.intersect(lab).select(F.lit("both").alias("side"), "doc_id")
    return odd.unionByName(both).groupBy("side").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("coverage_cartesian", """
WITH s AS (SELECT DISTINCT c_mktsegment FROM customer), e AS (SELECT n_nationkey, c_mktsegment FROM nation CROSS JOIN s),
a AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 8000)
SELECT e.n_nationkey AS nation, e.c_mktsegment AS segment FROM e LEFT JOIN a ON e.n_nationkey = a.c_nationkey AND e.c_mktsegment = a.c_mktsegment WHERE a.c_nationkey IS NULL""")
def coverage_cartesian(t):
    c = t("customer")
    nations = t("nation").select(F.lit(1).alias("one"), F.col("n_nationkey").alias("nation"))
    segments = c.select(F.lit(1).alias("one"), F.col("c_mktsegment").alias("segment")).distinct()
    actual = c.where("c_acctbal > 8000").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    d = rules.cartesian(nations, segments, actual, "customer", "one", "nation", "segment").where("detail = 'missing'")
    return d.select(F.split("key", ":")[0].cast("int").alias("nation"), F.split("key", ":")[1].alias("segment"))


@query("computed_column_check", """
SELECT count(*) AS n, count(*) FILTER (WHERE n_chars <> length(text)) AS wrong,
count(*) FILTER (WHERE n_chars <> length(replace(text, chr(10), ''))) AS wrong_without_breaks FROM documents""")
def computed_column_check(t):
    d = t("documents")
    bad = rules.rows(d, "documents", ["doc_id"], wrong=F.col("n_chars") == F.length("text"), wrong_without_breaks=F.col("n_chars") == F.length(F.replace("text", F.lit("\n"), F.lit(""))))
    n = bad.agg(F.count_if(F.col("rule") == "wrong").alias("wrong"), F.count_if(F.col("rule") == "wrong_without_breaks").alias("wrong_without_breaks"))
    return d.agg(F.count("*").alias("n")).crossJoin(n)


MOD10 = "((list_sum(list_transform(range(1, 64), lambda i: CAST(instr('0123456789abcdef', substr(sha256({0}), i, 1)) - 1 AS BIGINT))) * 6 + instr('0123456789abcdef', substr(sha256({0}), 64, 1)) - 1) % 10)"


@query("split_leakage", f"""
WITH d AS (SELECT md5(text) AS k, CASE WHEN m < 6 THEN 'train' WHEN m < 8 THEN 'dev' ELSE 'test' END AS split
FROM (SELECT text, {MOD10.format("('leak:' || CAST(doc_id AS VARCHAR))")} AS m FROM documents))
SELECT k AS text_hash, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM d GROUP BY k HAVING count(DISTINCT split) > 1""")
def split_leakage(t):
    d = t("documents").select(F.md5(F.col("text").cast("binary")).alias("text_hash"), h.split_60_20_20("doc_id", "leak").alias("split"))
    return rules.leaks(d, "documents", "text_hash").select(F.col("key").alias("text_hash"), F.col("detail").alias("splits"))


@query("events_json_projection", """
SELECT event_type, count(*) AS n, sum(CAST(props->>'$.k' AS BIGINT)) AS total_k, max(CAST(props->>'$.k' AS BIGINT)) AS max_k FROM events WHERE event_type = 'click' OR event_type = 'view' GROUP BY event_type""")
def events_json_projection(t):
    d = t("events").where(F.col("event_type").isin("click", "view")).withColumn("p", F.from_json("props", "k long"))
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total_k"), F.max("p.k").alias("max_k"))


@query("pages_regex_extract", r"""
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, count(*) AS n,
sum(len(regexp_extract_all(html, '<li>'))) AS items, max(CAST(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS INTEGER)) AS last_page,
min(regexp_extract(url, '([^/?]+)(?:\?.*)?$', 1)) AS first_stem FROM pages GROUP BY 1, 2""")
def pages_regex_extract(t):
    d = t("pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).alias("items"),
        F.nullif(F.regexp_extract("url", "page=([0-9]+)", 1), F.lit("")).cast("int").alias("page"),
        F.regexp_extract("url", r"([^/?]+)(?:\?.*)?$", 1).alias("stem"),
    )
    return d.groupBy("host", "lang").agg(F.count("*").alias("n"), F.sum("items").alias("items"), F.max("page").alias("last_page"), F.min("stem").alias("first_stem"))


@query("group_cross_join_counts", """
SELECT n_name AS nation, count(*) AS pairs, round(max(c_acctbal + s_acctbal), 6) AS best FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def group_cross_join_counts(t):
    """Counts are multiplied and maxima added per nation, so the pairs are never made."""
    c = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("a"), F.max("c_acctbal").alias("x"))
    s = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b"), F.max("s_acctbal").alias("y"))
    d = c.join(s, "k").join(t("nation"), F.col("k") == F.col("n_nationkey"))
    return d.select(F.col("n_name").alias("nation"), (F.col("a") * F.col("b")).alias("pairs"), F.round(F.col("x") + F.col("y"), 6).alias("best"))


@query("pending_anti_join", """
SELECT source, count(*) AS pending FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source""")
def pending_anti_join(t):
    return joins.pending(t("documents").select("doc_id", "source"), t("labels"), ["doc_id"]).groupBy("source").agg(F.count("*").alias("pending"))


@query("semi_join_history", """
SELECT c_mktsegment AS segment, count(*) AS customers FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY 1""")
def semi_join_history(t):
    big = t("orders").where("o_totalprice > 200000")
    return t("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"))


@query("default_lookup_join", """
SELECT lang, sum(coalesce(quality, 0)) AS good, sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS defaulted FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def default_lookup_join(t):
    lab = t("labels").select("doc_id", "quality", F.lit(0).alias("unknown"))
    d = joins.with_default(t("documents").select("doc_id", "lang"), lab, ["doc_id"], quality=0, unknown=1)
    return d.groupBy("lang").agg(F.sum("quality").cast("long").alias("good"), F.sum("unknown").cast("long").alias("defaulted"))


@query("pairs_within_group", """
WITH p AS (SELECT a.label, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, count(*) AS pairs, round(avg(d), 5) AS mean_dot, max(d) AS best FROM p GROUP BY label""")
def pairs_within_group(t):
    """Count, mean and greatest dot product of all pairs of a label, without writing pairs."""
    e = t("embeddings")
    d = similarity.pair_figures(e, "label", "vec_id", "embedding").join(similarity.best_dot(e, "label", "vec_id", "embedding"), "label")
    return d.select("label", "pairs", F.round("mean_dot", 5).alias("mean_dot"), F.round("best", 6).alias("best"))


@query("pairs_of_a_conversation", """
SELECT a.conv_id AS conv_id, a.turn AS turn_l, b.turn AS turn_r, a.role = b.role AS same_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn""")
def pairs_of_a_conversation(t):
    """Pairs themselves, where groups are small by their nature."""
    p = joins.pairs_within(t("conversations"), ["conv_id"], "turn", ["role"])
    return p.select("conv_id", "turn_l", "turn_r", (F.col("role_l") == F.col("role_r")).alias("same_role"))


@query("hamming_near_duplicates", """
WITH d AS (SELECT doc_id, xor(CAST(('0x' || substr(md5(CAST(doc_id // 3 AS VARCHAR)), 1, 15)) AS BIGINT), CAST(1 AS BIGINT) << CAST(doc_id % 3 AS INTEGER)) AS h FROM documents)
SELECT a.doc_id AS id_l, b.doc_id AS id_r, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM d a JOIN d b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.h, b.h)) <= 4""")
def hamming_near_duplicates(t):
    base = F.conv(F.substring(F.md5(F.floor(F.col("doc_id") / 3).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    d = t("documents").select("doc_id", base.bitwiseXOR(F.expr("shiftleft(1L, cast(doc_id % 3 as int))")).alias("h"))
    return joins.hamming_pairs(d, d, "doc_id", "h", most=4, width=60).withColumn("distance", F.col("distance").cast("int"))


@query("budgeted_choice", """
WITH b AS (SELECT p_brand, avg(p_retailprice) AS budget FROM part GROUP BY p_brand),
s AS (SELECT l_partkey, count(*) AS sold FROM lineitem GROUP BY l_partkey),
c AS (SELECT p.p_brand, p_partkey, p_retailprice, coalesce(sold, 0) AS sold FROM part p JOIN b ON p.p_brand = b.p_brand LEFT JOIN s ON l_partkey = p_partkey WHERE p_retailprice <= budget)
SELECT p_brand AS brand, p_partkey AS choice, sold FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sold DESC, p_retailprice, p_partkey) AS rn FROM c) WHERE rn = 1""")
def budgeted_choice(t):
    part = t("part")
    b = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("budget"))
    sold = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("sold"))
    c = joins.with_default(joins.budgeted(part, b, ["p_brand"], "p_retailprice", "budget"), sold, ["p_partkey"], sold=0)
    d = c.groupBy(F.col("p_brand").alias("brand")).agg(policy.smallest_id_wins(F.struct("p_partkey", "sold"), -F.col("sold"), "p_retailprice", "p_partkey").alias("r"))
    return d.select("brand", F.col("r.p_partkey").alias("choice"), F.col("r.sold").alias("sold"))


@query("self_reference_join", """
SELECT a.role AS role, b.role AS previous_role, count(*) AS n, sum(CASE WHEN length(a.text) > length(b.text) THEN 1 ELSE 0 END) AS longer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 GROUP BY 1, 2""")
def self_reference_join(t):
    c = t("conversations")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("previous_role"), F.length("text").alias("p"))
    return c.join(p, ["conv_id", "turn"]).groupBy("role", "previous_role").agg(F.count("*").alias("n"), F.sum((F.length("text") > F.col("p")).cast("long")).alias("longer"))


@query("multiway_composite_join", """
SELECT p_brand AS brand, s_nationkey AS nation, o_orderpriority AS priority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3""")
def multiway_composite_join(t):
    d = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    d = d.join(t("orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return d.groupBy(F.col("p_brand").alias("brand"), F.col("s_nationkey").alias("nation"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query("sibling_lateral_first", """
SELECT a.conv_id AS conv_id, a.turn AS turn, min(b.turn) AS sibling FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <> a.turn AND b.role = a.role AND length(b.text) < length(a.text) GROUP BY 1, 2""")
def sibling_lateral_first(t):
    c = t("conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    good = (F.col("s_turn") != F.col("turn")) & (F.col("s_role") == F.col("role")) & (F.col("s_n") < F.col("n"))
    return joins.first_sibling(c, c, "conv_id", "turn", good, ["conv_id", "turn"]).select("conv_id", "turn", F.col("s_turn").alias("sibling"))


@query("keyed_not_positional_join", """
SELECT c_mktsegment AS segment, count(*) AS matched, round(sum(c_acctbal - x), 2) AS difference FROM customer JOIN (SELECT o_custkey, max(o_totalprice) AS x FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""")
def keyed_not_positional_join(t):
    from attestor.operators.metrics import paired_difference

    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    o = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    d = paired_difference(c, o, ["k"], "v").join(t("customer"), F.col("k") == F.col("c_custkey"))
    return d.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("matched"), F.round(F.sum("difference"), 2).alias("difference"))


@query("intersect_across_sets", """
WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), c AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000),
m AS (SELECT c_custkey AS k, 'late' AS v FROM customer WHERE c_acctbal > 9000), x AS (SELECT c_custkey AS k, 'early' AS v FROM customer WHERE c_acctbal > 8000)
SELECT 'common' AS what, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b INTERSECT SELECT k FROM c)
UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM c)
UNION ALL SELECT v, count(*) FROM (SELECT * FROM m UNION ALL SELECT * FROM x WHERE k NOT IN (SELECT k FROM m)) GROUP BY v""")
def intersect_across_sets(t):
    from attestor.operators.sampling import overriding

    c, o = t("customer"), t("orders")
    sets = [c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), o.where("o_totalprice > 100000").select(F.col("o_custkey").alias("k"))]
    common = sets[0].intersect(sets[1]).intersect(sets[2])
    each = sets[0].union(sets[1]).union(sets[2]).distinct()
    merged = overriding(c.where("c_acctbal > 8000").select(F.col("c_custkey").alias("k"), F.lit("early").alias("v")), c.where("c_acctbal > 9000").select(F.col("c_custkey").alias("k"), F.lit("late").alias("v")), ["k"])
    out = [common.agg(F.lit("common").alias("what"), F.count("*").alias("n")), each.agg(F.lit("any").alias("what"), F.count("*").alias("n")), merged.groupBy(F.col("v").alias("what")).agg(F.count("*").alias("n"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("arms_union_tagged", """
SELECT arm, count(*) AS n, round(sum(price), 2) AS total FROM (SELECT 'returned' AS arm, l_extendedprice AS price FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'open', l_extendedprice FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT 'discounted', l_extendedprice FROM lineitem WHERE l_discount > 0.05) GROUP BY arm""")
def arms_union_tagged(t):
    arms = {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O", "discounted": F.col("l_discount") > 0.05}
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in arms.items()]))  # one scan for all arms
    d = t("lineitem").select(F.explode(tags).alias("arm"), "l_extendedprice")
    return d.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
