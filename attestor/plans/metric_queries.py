"""Queries on metrics and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import numeric as n
from attestor.functions.hashing import table_fingerprint
from attestor.operators import joins, metrics, resample
from attestor.plans.registry import query


@query("kappa_agreement", """
WITH t AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS po FROM labels),
l AS (SELECT quality AS k, count(*) AS a FROM labels GROUP BY 1), r AS (SELECT toxic AS k, count(*) AS b FROM labels GROUP BY 1),
c AS (SELECT coalesce(sum(a * b), 0) AS s FROM l JOIN r USING (k))
SELECT n AS rows_n, round(po, 6) AS raw_agreement, round((po - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM t, c""")
def kappa_agreement(t):
    d = metrics.agreement(t("labels"), "quality", "toxic")
    return d.select(F.col("rows").alias("rows_n"), F.round("raw_agreement", 6).alias("raw_agreement"), F.round("kappa", 6).alias("kappa"))


GROUPED = """
SELECT {0} AS lang, {1} AS source, count(*) AS rows_n, count(DISTINCT doc_id) AS images, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS raw_agreement,
round(CASE WHEN (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic))) < 1 THEN (avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) / (1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) END, 6) AS kappa,
round(avg(CASE WHEN n_chars > 500 THEN 1.0 ELSE 0.0 END), 6) AS adjudication_rate FROM labels JOIN documents USING (doc_id) {2}"""


@query("agreement_grouping_sets", " UNION ALL ".join([GROUPED.format("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", ""), GROUPED.format("lang", "CAST(NULL AS VARCHAR)", "GROUP BY lang"), GROUPED.format("CAST(NULL AS VARCHAR)", "source", "GROUP BY source")]))
def agreement_grouping_sets(t):
    d = t("labels").join(t("documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").withColumn("adj", F.col("n_chars") > 500)
    d = metrics.agreement(d, "quality", "toxic", "doc_id", "adj", [[], ["lang"], ["source"]])
    return d.select("lang", "source", F.col("rows").alias("rows_n"), "images", *[F.round(c, 6).alias(c) for c in ("raw_agreement", "kappa", "adjudication_rate")])


@query("confusion_dense", """
WITH g AS (SELECT a.x AS truth, b.x AS predicted FROM (VALUES (0), (1), (2)) a(x), (VALUES (0), (1), (2)) b(x)), k AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2)
SELECT CAST(truth AS BIGINT) AS truth, CAST(predicted AS BIGINT) AS predicted, coalesce(n, 0) AS n FROM g LEFT JOIN k ON truth = quality AND predicted = toxic""")
def confusion_dense(t):
    d = t("labels").select(F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    return metrics.confusion(d, "quality", "toxic", [0, 1, 2])


@query("precision_recall_f1", """
WITH d AS (SELECT quality AS y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) AS n, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS acc, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn FROM d),
b AS (SELECT avg(r) AS bal FROM (SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS r FROM d GROUP BY y)),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0.0) AS re FROM c, b)
SELECT n, round(acc, 6) AS accuracy, round(bal, 6) AS balanced_accuracy, round(pr, 6) AS "precision", round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 6) AS f1 FROM m""")
def precision_recall_f1(t):
    d = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"))
    d = metrics.classification(d, "y", "p", 1)
    return d.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")])


@query("pair_accuracy", """
WITH s AS (SELECT conv_id // 2 AS pair, conv_id, max(length(text)) - 400 AS score FROM conversations GROUP BY 1, 2),
p AS (SELECT pair, max(CASE WHEN conv_id % 2 = 0 THEN score END) AS p, max(CASE WHEN conv_id % 2 = 1 THEN score END) AS q FROM s GROUP BY 1 HAVING p IS NOT NULL AND q IS NOT NULL)
SELECT count(*) AS pairs, round(avg(CASE WHEN p >= 0 AND q < 0 THEN 1.0 ELSE 0.0 END), 6) AS pair_accuracy, round(avg(CASE WHEN p > q THEN 1.0 WHEN p = q THEN 0.5 ELSE 0.0 END), 6) AS pair_ranking_accuracy FROM p""")
def pair_accuracy(t):
    s = t("conversations").groupBy(F.floor(F.col("conv_id") / 2).alias("pair"), "conv_id").agg((F.max(F.length("text")) - 400).alias("score"))
    d = metrics.pair_accuracy(s, "pair", F.col("conv_id") % 2 == 0, "score")
    return d.select("pairs", F.round("pair_accuracy", 6).alias("pair_accuracy"), F.round("pair_ranking_accuracy", 6).alias("pair_ranking_accuracy"))


@query("set_jaccard_pairs", """
WITH s AS (SELECT label, list_sort(list(DISTINCT d)) AS members FROM (SELECT label, unnest(range(1, 65)) AS d, unnest(embedding) AS x FROM embeddings) WHERE x > 0.27 GROUP BY label),
p AS (SELECT a.members AS l, b.members AS r FROM s a JOIN s b ON a.label < b.label)
SELECT round(avg(CASE WHEN len(list_distinct(list_concat(l, r))) = 0 THEN 1.0 ELSE len(list_intersect(l, r)) / len(list_distinct(list_concat(l, r))) END), 6) AS jaccard, round(avg(CASE WHEN l <> r THEN 1.0 ELSE 0.0 END), 6) AS change_rate, count(*) AS pairs FROM p""")
def set_jaccard_pairs(t):
    d = t("embeddings").select(F.lit(0).alias("all"), "label", F.posexplode("embedding").alias("d", "x"))
    s = metrics.success_sets(d, ["all", "label"], "d", F.col("x") > 0.27)
    m = metrics.set_change(joins.pairs_within(s, ["all"], "label", ["members"]), "members_l", "members_r")
    return m.select(F.round("jaccard", 6).alias("jaccard"), F.round("change_rate", 6).alias("change_rate"), "pairs")


@query("expected_tie_rank", """
WITH o AS (SELECT l_orderkey, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
w AS (SELECT l_orderkey, count(*) FILTER (WHERE q > t + 1e-8) AS hi, count(*) FILTER (WHERE abs(q - t) <= 1e-8) AS eq FROM (SELECT *, max(CASE WHEN k = 1 THEN q END) OVER (PARTITION BY l_orderkey) AS t FROM o) GROUP BY 1)
SELECT count(*) AS lists, round(avg(CASE WHEN hi = 0 THEN 1.0 / eq ELSE 0.0 END), 6) AS acc1, round(avg(list_sum(list_transform(range(1, eq + 1), lambda j: 1.0 / (hi + j))) / eq), 6) AS mrr FROM w""")
def expected_tie_rank(t):
    d = metrics.intervention(positions(t), ["l_orderkey"], "k", "l_quantity")
    return d.agg(F.count("*").alias("lists"), F.round(F.avg("acc1"), 6).alias("acc1"), F.round(F.avg("mrr"), 6).alias("mrr"))


def positions(t):
    from attestor.operators.sampling import ranked

    d = ranked(t("lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    return d.withColumn("k", F.col("rn") - 1)


@query("normalised_delta", """
WITH o AS (SELECT l_orderkey, l_quantity - 25 AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
w AS (SELECT l_orderkey, max(CASE WHEN k = 1 THEN q END) AS t, avg(CASE WHEN k > 1 THEN abs(q) END) AS drift, max(CASE WHEN k = 1 THEN q END) - avg(CASE WHEN k > 1 THEN q END) AS contrast, avg(abs(q)) AS scale FROM o GROUP BY 1)
SELECT count(*) AS lists, round(avg(t), 6) AS target, round(avg(drift), 6) AS drift, round(avg(contrast), 6) AS contrast, round(avg(CASE WHEN scale > 1e-8 THEN t / scale ELSE 0 END), 6) AS scaled_target, round(avg(CASE WHEN t > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM w""")
def normalised_delta(t):
    d = metrics.intervention(positions(t), ["l_orderkey"], "k", F.col("l_quantity") - 25)
    return d.agg(F.count("*").alias("lists"), *[F.round(F.avg(c), 6).alias(c) for c in ("target", "drift", "contrast")], F.round(F.avg(n.scaled("target", "scale")), 6).alias("scaled_target"), F.round(F.avg("positive"), 6).alias("positive"))


@query("ensemble_vs_metric_mean", """
WITH s AS (SELECT c_nationkey AS g, c_custkey AS id, CAST(substr(c_name, -1) AS INTEGER) % 3 AS seed, c_acctbal AS v FROM customer),
e AS (SELECT g, seed, avg(v) AS m, max(v) AS top FROM s GROUP BY 1, 2), a AS (SELECT seed, avg(top) AS metric FROM e GROUP BY 1)
SELECT round((SELECT avg(x) FROM (SELECT g, max(m) AS x FROM e GROUP BY 1)), 4) AS metric_of_means, round(avg(metric), 4) AS mean_of_metrics, round(stddev_samp(metric), 4) AS seed_sd FROM a""")
def ensemble_vs_metric_mean(t):
    s = t("customer").select(F.col("c_nationkey").alias("g"), (F.substring("c_name", -1, 1).cast("int") % 3).alias("seed"), F.col("c_acctbal").alias("v"))
    e = s.groupBy("g", "seed").agg(F.avg("v").alias("m"), F.max("v").alias("top"))
    first = e.groupBy("g").agg(F.max("m").alias("x")).agg(F.round(F.avg("x"), 4).alias("metric_of_means"))
    a = e.groupBy("seed").agg(F.avg("top").alias("metric")).agg(F.round(F.avg("metric"), 4).alias("mean_of_metrics"), F.round(F.stddev_samp("metric"), 4).alias("seed_sd"))
    return first.crossJoin(a)


@query("judge_agreement", """
SELECT lang, round(avg(CASE WHEN (quality = 1) = (n_chars > 800) AND (toxic = 1) = (source = 'src0') THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def judge_agreement(t):
    d = t("labels").join(t("documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    same = ((F.col("quality") == 1) == (F.col("n_chars") > 800)) & ((F.col("toxic") == 1) == (F.col("source") == "src0"))
    return d.groupBy("lang").agg(F.round(F.avg(same.cast("int")), 6).alias("agreement"), F.count("*").alias("n"))


@query("vote_resolution", """
WITH v AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'Yes ' ELSE 'no' END AS a, CASE WHEN toxic = 1 THEN 'no' ELSE ' yes' END AS b, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'Uncertain' ELSE 'no' END AS c FROM labels),
r AS (SELECT doc_id, lower(trim(a)) AS a, lower(trim(b)) AS b, CASE WHEN lower(trim(a)) = lower(trim(b)) THEN lower(trim(a)) WHEN lower(trim(c)) IN ('yes', 'no', 'uncertain') THEN lower(trim(c)) END AS v FROM v),
x AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN v = 'no' OR a = 'no' OR b = 'no' THEN 'negative' WHEN v = 'yes' AND a = 'yes' AND b = 'yes' THEN 'positive' ELSE 'unknown' END AS target FROM r)
SELECT v AS vote, target, count(*) AS n FROM x GROUP BY 1, 2""")
def vote_resolution(t):
    a, b = F.when(F.col("quality") == 1, "Yes ").otherwise("no"), F.when(F.col("toxic") == 1, "no").otherwise(" yes")
    c = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 2 == 0, "Uncertain").otherwise("no")
    d = t("labels").select(a.alias("a"), b.alias("b"), c.alias("c")).withColumn("vote", metrics.resolved_vote("a", "b", "c"))
    d = d.withColumn("target", metrics.action_target(F.array("vote", F.lower(F.trim("a")), F.lower(F.trim("b")))))
    return d.groupBy("vote", "target").agg(F.count("*").alias("n"))


@query("field_agreement", """
WITH f AS (SELECT 'quality' AS field, CASE WHEN doc_id % 7 = 0 THEN '' ELSE CAST(quality AS VARCHAR) END AS a, CAST(toxic AS VARCHAR) AS b FROM labels UNION ALL SELECT 'parity', CAST(doc_id % 2 AS VARCHAR), CAST(quality AS VARCHAR) FROM labels)
SELECT field, count(*) AS compared, count(*) FILTER (WHERE a = b) AS agreed, count(*) FILTER (WHERE a <> b) AS disagreed, round(count(*) FILTER (WHERE a = b) / count(*), 6) AS rate FROM f WHERE a <> '' AND b <> '' GROUP BY field""")
def field_agreement(t):
    s = t("labels").select(
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("quality").cast("string")).alias("a_quality"), F.col("toxic").cast("string").alias("b_quality"), (F.col("doc_id") % 2).cast("string").alias("a_parity"), F.col("quality").cast("string").alias("b_parity")
    )
    return metrics.field_agreement(s, ["quality", "parity"]).withColumn("rate", F.round("rate", 6))


LANE = "sum(CAST(('0x' || substr(h, {0}, 8)) AS BIGINT))"


@query("content_fingerprint", f"""
WITH r AS (SELECT sha256('{{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}}') AS h FROM nation)
SELECT sha256(CAST(count(*) AS VARCHAR) || {" || ".join(f"',' || CAST({LANE.format(8 * k + 1)} AS VARCHAR)" for k in range(8))}) AS fingerprint FROM r""")
def content_fingerprint(t):
    return table_fingerprint(t("nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("gpu_hours_ledger", """
WITH e AS (SELECT event_type AS partition_name, CAST(props->>'$.k' AS BIGINT) AS k, user_id % 4 AS g FROM events)
SELECT partition_name, count(*) AS jobs, sum(CASE WHEN g = 0 THEN 3 ELSE g END) AS gpus, round(sum((CASE WHEN g = 0 THEN 3 ELSE g END) * k / 3600), 6) AS gpu_hours, round(avg(k), 6) AS mean_k, max(k) AS max_k, round(avg(CASE WHEN k > 50 THEN 1.0 ELSE 0.0 END), 6) AS busy FROM e GROUP BY 1""")
def gpu_hours_ledger(t):
    from attestor.sources.io import ledger

    k = F.from_json("props", "k long")["k"]
    g = F.col("user_id") % 4
    tres = F.when(g == 0, "cpu=8,gres/gpu:l4=1,gres/gpu:a100=2").otherwise(F.concat(F.lit("cpu=8,gres/gpu="), g.cast("string")))
    d = ledger(t("events").select(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", k.cast("string"), F.lit("DONE"), tres).alias("value")))
    k = F.col("elapsed_seconds")
    return d.groupBy(F.col("partition").alias("partition_name")).agg(F.count("*").alias("jobs"), F.sum("allocated_gpus").alias("gpus"), F.round(F.sum("gpu_hours"), 6).alias("gpu_hours"), F.round(F.avg(k), 6).alias("mean_k"), F.max(k).alias("max_k"), F.round(F.avg((k > 50).cast("int")), 6).alias("busy"))


@query("count_family", """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 10) AS large, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most,
len(list(DISTINCT user_id % 10)) AS set_size, bool_or(value > 95) AS any_huge, bool_and(value > 0) AS all_positive FROM events GROUP BY event_type""")
def count_family(t):
    v = F.col("value")
    return t("events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(v > 10).alias("large"), F.round(F.sum(v), 2).alias("total"), F.round(n.finite_mean(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.size(F.collect_set(F.col("user_id") % 10)).cast("long").alias("set_size"), F.bool_or(v > 95).alias("any_huge"), F.bool_and(v > 0).alias("all_positive"),
    )


@query("most_common_values", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5")
def most_common_values(t):
    return metrics.most_common(t("events"), "user_id", 5)


@query("joint_distribution", "SELECT lang, source, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY 1, 2")
def joint_distribution(t):
    return t("documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


@query("ranking_taxonomy", """
WITH o AS (SELECT l_orderkey, l_quantity AS q, l_extendedprice AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
w AS (SELECT l_orderkey, max(CASE WHEN k = 1 THEN p END) AS cost, 1 + count(*) FILTER (WHERE q > t) AS place FROM (SELECT *, max(CASE WHEN k = 1 THEN q END) OVER (PARTITION BY l_orderkey) AS t FROM o) GROUP BY 1)
SELECT CASE WHEN place = 1 THEN 'first' WHEN place <= 3 THEN 'near' ELSE 'far' END AS kind, count(*) AS n, round(sum(cost), 2) AS total_cost, round(avg(cost), 4) AS mean_cost, max(cost) AS max_cost FROM w GROUP BY 1""")
def ranking_taxonomy(t):
    from pyspark.sql import Window

    d = positions(t).withColumn("_t", F.max(F.when(F.col("k") == 0, F.col("l_quantity"))).over(Window.partitionBy("l_orderkey")))
    w = d.groupBy("l_orderkey").agg(F.max(F.when(F.col("k") == 0, F.col("l_extendedprice"))).alias("cost"), (1 + F.count_if(F.col("l_quantity") > F.col("_t"))).alias("place"))
    kind = F.when(F.col("place") == 1, "first").when(F.col("place") <= 3, "near").otherwise("far")
    return w.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("cost"), 2).alias("total_cost"), F.round(F.avg("cost"), 4).alias("mean_cost"), F.max("cost").alias("max_cost"))


DRAWS = """d AS (SELECT b, CAST(('0x' || substr(sha256('2271:' || CAST(b AS VARCHAR) || ':' || CAST(x AS VARCHAR)), 1, 8)) AS BIGINT) % g AS k FROM (SELECT unnest(range(0, 10000)) AS b), (SELECT g, unnest(range(0, g)) AS x FROM (SELECT count(*) AS g FROM {0}))),
k AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS k FROM {0})"""


@query("bootstrap_cluster_ci", f"""
WITH m AS (SELECT c_nationkey AS c, avg(c_acctbal) AS v FROM customer GROUP BY 1), {DRAWS.format("m")}, e AS (SELECT b, avg(v) AS v FROM d JOIN k USING (k) GROUP BY b)
SELECT round((SELECT avg(v) FROM m), 4) AS mean, round(quantile_cont(v, 0.025), 4) AS lo, round(quantile_cont(v, 0.975), 4) AS hi, (SELECT count(*) FROM m) AS clusters FROM e""")
def bootstrap_cluster_ci(t):
    d = resample.ci(t("customer"), "c_nationkey", "c_acctbal")
    return d.select(*[F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")], "clusters")


@query("bootstrap_paired_ci", f"""
WITH y AS (SELECT o_custkey AS u, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), lo AS (SELECT min(y) AS a FROM y),
p AS (SELECT a.u % 20 AS c, b.v - a.v AS x FROM y a JOIN y b ON a.u = b.u JOIN lo ON a.y = lo.a AND b.y = lo.a + 1), m AS (SELECT c, avg(x) AS v FROM p GROUP BY c), {DRAWS.format("m")},
e AS (SELECT b, avg(v) AS v FROM d JOIN k USING (k) GROUP BY b) SELECT round((SELECT avg(v) FROM m), 4) AS mean, round(quantile_cont(v, 0.025), 4) AS lo, round(quantile_cont(v, 0.975), 4) AS hi, (SELECT count(*) FROM m) AS clusters FROM e""")
def bootstrap_paired_ci(t):
    y = t("orders").groupBy(F.col("o_custkey").alias("u"), F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    first = F.broadcast(y.agg(F.min("y").alias("a")))
    a, b = (y.join(first, F.col("y") == F.col("a") + k).select("u", "v") for k in (0, 1))
    d = metrics.paired_difference(b, a, ["u"], "v").withColumn("c", F.col("u") % 20)
    return resample.ci(d, "c", "difference").select(*[F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")], "clusters")


@query("bootstrap_index_quantile", f"""
WITH m AS (SELECT doc_id AS c, CAST(quality AS DOUBLE) AS v FROM labels), {DRAWS.format("m")}, e AS (SELECT b, avg(v) AS v FROM d JOIN k USING (k) GROUP BY b), l AS (SELECT list_sort(list(v)) AS v FROM e)
SELECT round((SELECT avg(v) FROM m), 6) AS mean, round(v[CAST(floor(len(v) * 0.025) AS INTEGER) + 1], 6) AS lo, round(v[CAST(floor(len(v) * 0.975) AS INTEGER) + 1], 6) AS hi, (SELECT count(*) FROM m) AS clusters FROM l""")
def bootstrap_index_quantile(t):
    d = t("labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return resample.ci(d, "doc_id", "quality", interpolate=False).select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], "clusters")


@query("bootstrap_statistic_f1", f"""
WITH x AS (SELECT source AS c, quality AS y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
m AS (SELECT c, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn FROM x GROUP BY c), {DRAWS.format("m")},
e AS (SELECT b, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM d JOIN k USING (k) GROUP BY b), f AS (SELECT list_sort(list(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0))) AS v FROM e)
SELECT round(v[251], 6) AS lo, round(v[9751], 6) AS hi FROM f""")
def bootstrap_statistic_f1(t):
    d = t("labels").join(t("documents").select("doc_id", "source", "n_chars"), "doc_id").select(F.col("source").alias("c"), (F.col("quality") == 1).alias("y"), (F.col("n_chars") > 1000).alias("p"))
    y, p = F.col("y"), F.col("p")
    counts = {"tp": (y & p).cast("int"), "fp": (~y & p).cast("int"), "fn": (y & ~p).cast("int")}
    out = resample.statistic_ci(d, "c", counts, lambda k: metrics.f1_columns(k["tp"], k["fp"], k["fn"])["f1"])
    return out.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("bootstrap_joint_methods", f"""
WITH m AS (SELECT o_custkey % 25 AS c, avg(o_totalprice) AS v1, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END) AS v2 FROM orders GROUP BY 1), {DRAWS.format("m")},
e AS (SELECT b, avg(v1) AS v1, avg(v2) AS v2 FROM d JOIN k USING (k) GROUP BY b), l AS (SELECT 'all' AS method, v1 AS v FROM e UNION ALL SELECT 'urgent', v2 FROM e UNION ALL SELECT 'all_minus_urgent', v1 - v2 FROM e)
SELECT method, round(quantile_cont(v, 0.025), 4) AS lo, round(quantile_cont(v, 0.975), 4) AS hi FROM l GROUP BY method""")
def bootstrap_joint_methods(t):
    d = t("orders").select((F.col("o_custkey") % 25).alias("c"), F.col("o_totalprice").alias("all"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).otherwise(0.0).alias("urgent"))
    e = resample.estimates(d, "c", ["all", "urgent"]).withColumn("all_minus_urgent", F.col("all") - F.col("urgent"))
    long = e.unpivot("b", ["all", "urgent", "all_minus_urgent"], "method", "v")
    return long.groupBy("method").agg(F.round(F.percentile("v", F.lit(0.025)), 4).alias("lo"), F.round(F.percentile("v", F.lit(0.975)), 4).alias("hi"))
