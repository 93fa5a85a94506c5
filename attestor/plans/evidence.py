"""Evidence tables made of the driver's tables, and queries on what is derived from them; interventions, hashes, masks and controls."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from attestor.functions import hashing as h
from attestor.operators import attribution, bundle, derive, models, views
from attestor.plans.registry import query
from attestor.session import stored
from attestor.sources import images

#: Customers are images, their early orders contexts, the others candidates that were observed once; line numbers are an image's facts.
EVIDENCE_SQL = """
o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS image_id, o_orderpriority < '3' AS early, CAST(o_totalprice AS INTEGER) AS cost, o_orderstatus AS kind FROM orders),
l AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, l_linenumber AS n, min(l_returnflag) AS flag, max(l_linestatus) AS status, min(l_discount) AS discount, count(*) AS rows FROM lineitem GROUP BY 1, 2),
ol AS (SELECT o.*, l.* EXCLUDE (k), image_id || '-' || n AS fact_id FROM o JOIN l USING (k)),
facts AS (SELECT fact_id, image_id, CASE WHEN n % 5 = 4 THEN 'no' ELSE 'yes' END AS visual_support, 'type' || n % 3 AS fact_type FROM ol GROUP BY fact_id, image_id, n),
known AS (SELECT k AS context_id, fact_id, CASE WHEN flag = 'A' THEN 'entailed' ELSE 'not_entailed' END AS status, flag AS a, status AS b, rows > 1 AS adjudicated FROM ol WHERE early),
labels AS (SELECT k AS candidate_id, fact_id, CASE WHEN discount < 0.05 THEN 'yes' ELSE 'no' END AS sufficient, flag AS a, status AS b, rows > 1 AS adjudicated FROM ol WHERE NOT early),
claims AS (SELECT k AS candidate_id, k || '/' || n AS claim_id, CASE WHEN n = 7 THEN NULL ELSE fact_id END AS fact_id, CASE flag WHEN 'R' THEN 'contradicted' ELSE 'correct' END AS claim_status, flag AS a, status AS b, rows > 1 AS adjudicated FROM ol WHERE NOT early)"""


def evidence(t) -> dict:
    """The tables that derivation reads; lines meet orders once, in a table on the way."""
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").cast("string").alias("image_id"), (F.col("o_orderpriority") < "3").alias("early"), F.round("o_totalprice").cast("int").alias("cost"), F.col("o_orderstatus").alias("kind"))
    lines = t("lineitem").select(F.col("l_orderkey").cast("string").alias("k"), F.col("l_linenumber").alias("n"), "l_returnflag", "l_linestatus", "l_discount").repartition("k").groupBy("k", "n").agg(F.min("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.min("l_discount").alias("discount"), F.count("*").alias("rows"))
    ol = stored(o.select("k", "image_id", "early").join(lines, "k"), "order_lines").withColumn("fact_id", F.concat_ws("-", "image_id", "n"))
    votes = F.array("flag", "status")
    final = F.when(F.col("rows") > 1, "settled")
    late, early = ol.where(~F.col("early")), ol.where("early")
    return {
        "images": t("customer").select(F.col("c_custkey").cast("string").alias("image_id"), F.lit(100).alias("width"), F.lit(80).alias("height"), F.concat(F.lit("g"), F.col("c_nationkey").cast("string")).alias("duplicate_group_id")),
        "contexts": o.where("early").select(F.col("k").alias("context_id"), "image_id"),
        "candidates": o.where(~F.col("early")).select(F.col("k").alias("candidate_id"), "image_id", F.col("cost").alias("pixel_cost"), "kind", F.array(F.array(F.lit(0), F.lit(0), F.lit(10), F.lit(8))).alias("boxes"), F.col("cost").cast("double").alias("proposal_score")),
        "observations": o.where(~F.col("early")).select(F.concat(F.lit("o"), "k").alias("observation_id"), F.col("k").alias("candidate_id"), "image_id"),
        "facts": ol.groupBy("fact_id", "image_id", "n").agg(F.lit(1)).select("fact_id", "image_id", F.when(F.col("n") % 5 == 4, "no").otherwise("yes").alias("visual_support"), F.concat(F.lit("type"), (F.col("n") % 3).cast("string")).alias("fact_type")),
        "context_fact_labels": early.select(F.col("k").alias("context_id"), "fact_id", F.when(F.col("flag") == "A", "entailed").otherwise("not_entailed").alias("status"), votes.alias("annotator_votes"), final.alias("adjudication")),
        "candidate_fact_labels": late.select(F.col("k").alias("candidate_id"), "fact_id", F.when(F.col("discount") < 0.05, "yes").otherwise("no").alias("sufficient_to_verify"), votes.alias("annotator_votes"), final.alias("adjudication"), votes.alias("visibility_annotator_votes"), final.alias("visibility_adjudication")),
        "observation_claim_labels": late.select(F.concat(F.lit("o"), "k").alias("observation_id"), F.concat_ws("/", "k", "n").alias("claim_id"), F.when(F.col("n") != 7, F.col("fact_id")).alias("mapped_fact_id"), F.when(F.col("flag") == "R", "contradicted").otherwise("correct").alias("status"), votes.alias("annotator_votes"), final.alias("adjudication")),
    }


ACTIONS_SQL = EVIDENCE_SQL + """,
pairs AS (SELECT c.k AS context_id, d.k AS candidate_id, c.image_id, d.cost, d.kind FROM o c JOIN o d ON c.image_id = d.image_id AND c.early AND NOT d.early),
judged AS (
  SELECT p.*, c.claim_id, c.fact_id, claim_status = 'correct' AND c.fact_id IS NOT NULL AS correct, claim_status = 'contradicted' AS bad, coalesce(k.status, 'unknown') AS known, f.visual_support = 'yes' AND s.sufficient = 'yes' AS shown
  FROM pairs p LEFT JOIN claims c ON c.candidate_id = p.candidate_id LEFT JOIN facts f ON f.fact_id = c.fact_id LEFT JOIN labels s ON s.candidate_id = c.candidate_id AND s.fact_id = c.fact_id LEFT JOIN known k ON k.context_id = p.context_id AND k.fact_id = c.fact_id),
acts AS (
  SELECT context_id, candidate_id, image_id, cost, kind, list_sort(list(DISTINCT fact_id) FILTER (correct AND known = 'not_entailed' AND coalesce(shown, false))) AS new, list_sort(list(DISTINCT fact_id) FILTER (correct AND known = 'entailed')) AS again,
    list_sort(list(DISTINCT claim_id) FILTER (bad)) AS bad, list_sort(list(DISTINCT claim_id) FILTER (claim_id IS NOT NULL AND NOT (bad OR (correct AND known = 'not_entailed' AND coalesce(shown, false)) OR (correct AND known = 'entailed')))) AS unknown
  FROM judged GROUP BY 1, 2, 3, 4, 5),
missing AS (SELECT context_id, count(DISTINCT k.fact_id) AS n FROM known k JOIN facts f ON f.fact_id = k.fact_id WHERE k.status = 'not_entailed' AND visual_support = 'yes' GROUP BY 1),
counts AS (SELECT a.context_id, candidate_id, image_id, cost, kind, coalesce(len(new), 0) AS new, coalesce(len(again), 0) AS again, coalesce(len(bad), 0) AS bad, coalesce(len(unknown), 0) AS unknown, coalesce(m.n, 0) AS missing, array_to_string(new, ',') AS new_ids FROM acts a LEFT JOIN missing m USING (context_id))"""


@query("bundle_actions", f"WITH {ACTIONS_SQL} SELECT context_id, candidate_id, new, again, bad, unknown, missing, coalesce(new_ids, '') AS new_ids FROM counts")
def bundle_actions(t):
    """What each candidate would add to each context, derived from claims, statuses, sufficiency and support."""
    d = derive.action_labels(evidence(t))
    size = lambda c: F.size(c).cast("long")
    return d.select("context_id", "candidate_id", size("new_supported_fact_ids").alias("new"), size("repeated_fact_ids").alias("again"), size("contradicted_claim_ids").alias("bad"), size("unknown_claim_ids").alias("unknown"), size("eligible_missing_fact_ids").alias("missing"), F.array_join("new_supported_fact_ids", ",").alias("new_ids"))


@query("bundle_report", f"""
WITH {ACTIONS_SQL}, n AS (SELECT image_id, count(*) AS facts FROM facts WHERE visual_support = 'yes' GROUP BY 1),
s AS (SELECT c.*, 'g' || c_nationkey AS g, CASE WHEN coalesce(n.facts, 0) > 0 THEN new * 1.0 / n.facts END AS gain FROM counts c JOIN customer ON CAST(c_custkey AS VARCHAR) = image_id LEFT JOIN n USING (image_id)),
r AS (SELECT 'random_expected' AS method, g, image_id, context_id, avg(gain) AS gain, avg(bad) AS bad FROM s GROUP BY 2, 3, 4
  UNION ALL SELECT 'proposal_score', g, image_id, context_id, gain, bad FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY cost DESC, candidate_id DESC) AS rn FROM s) WHERE rn = 1),
i AS (SELECT method, g, image_id, avg(gain) AS gain, avg(bad) AS bad FROM r GROUP BY 1, 2, 3), c AS (SELECT method, g, avg(gain) AS gain, avg(bad) AS bad FROM i GROUP BY 1, 2)
SELECT method, round(avg(gain), 6) AS delta_coverage, round(avg(bad), 6) AS invalid_claim_count, count(*) AS clusters FROM c GROUP BY 1""")
def bundle_report(t):
    """Two methods' figures from end to end: actions, choices, contexts within images within groups."""
    e = evidence(t)
    rows = derive.context_rows(e, derive.scored_actions(e, derive.action_labels(e))).where(F.col("method").isin("random_expected", "proposal_score"))
    d = derive.method_summary(rows).where(F.col("metric").isin("delta_coverage", "invalid_claim_count"))
    value = lambda m: F.round(F.max(F.when(F.col("metric") == m, F.col("value"))), 6).alias(m)
    return d.groupBy("method").agg(value("delta_coverage"), value("invalid_claim_count"), F.max("clusters").alias("clusters"))


@query("vote_families", f"""
WITH {EVIDENCE_SQL},
v AS (SELECT 'context_status' AS family, image_id, a, b, adjudicated, fact_id FROM known JOIN o ON k = context_id UNION ALL SELECT 'candidate_visibility', image_id, a, b, adjudicated, fact_id FROM labels JOIN o ON k = candidate_id
  UNION ALL SELECT 'candidate_sufficiency', image_id, a, b, adjudicated, fact_id FROM labels JOIN o ON k = candidate_id UNION ALL SELECT 'observation_claim_status', image_id, a, b, adjudicated, fact_id FROM claims JOIN o ON k = candidate_id)
SELECT family, coalesce(fact_type, 'unmapped') AS fact_type, count(*) AS votes, count(*) FILTER (a = b) AS agreed, count(*) FILTER (adjudicated) AS settled, count(DISTINCT v.image_id) AS images FROM v LEFT JOIN facts f ON f.fact_id = v.fact_id GROUP BY 1, 2""")
def vote_families(t):
    """Double-annotated labels as rows of one or two votes for each family."""
    d = bundle.vote_rows(evidence(t))
    return d.groupBy("family", "fact_type").agg(F.count("*").alias("votes"), F.count_if(F.col("a") == F.col("b")).alias("agreed"), F.count_if("adjudicated").alias("settled"), F.count_distinct("image_id").alias("images"))


@query("report_gates", """
WITH m AS (SELECT c_mktsegment AS g, avg(c_acctbal) AS m, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1), x AS (SELECT min(m) / 10000 AS gap, max(hi) / 1000000 AS bad_hi, avg(m) / 100000 AS nec, max(m) / 10000 AS sw, min(m) / 1000000 AS par, max(hi) / 10000 AS stop FROM m)
SELECT gap >= 0.1 AND gap / 2 > 0 AND bad_hi <= 0.02 AS first, nec >= 0.03 AND nec / 2 > 0 AND sw >= 0.2 AND par < 0.02 AND stop >= 0.8 AS second FROM x""")
def report_gates(t):
    """Thresholds and interval bounds of a report whose figures come from the customers' balances."""
    m = t("customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"), F.max("c_acctbal").alias("hi"))
    x = m.agg((F.min("m") / 10000).alias("gap"), (F.max("hi") / 1000000).alias("bad_hi"), (F.avg("m") / 100000).alias("nec"), (F.max("m") / 10000).alias("sw"), (F.min("m") / 1000000).alias("par"), (F.max("hi") / 10000).alias("stop"))
    row = lambda section, metric, mean, lo, hi: F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"), mean.alias("mean"), lo.alias("lo"), hi.alias("hi"))
    c = F.col
    rows = [
        row("oracle_minus_baseline", "delta_coverage", c("gap"), c("gap") / 2, c("gap") * 2), row("oracle_minus_baseline", "invalid_claim_count", c("bad_hi") / 2, c("bad_hi") / 4, c("bad_hi")), row("necessity", "gap", c("nec"), c("nec") / 2, c("nec") * 2),
        row("switches", "material", c("sw"), c("sw"), c("sw")), row("paraphrase", "regret", c("par"), c("par"), c("par")), row("saturated", "stop_accuracy", c("stop"), c("stop"), c("stop")),
    ]
    return derive.gates(x.select(F.inline(F.array(*rows))), True)


@query("run_fingerprint", """
SELECT sha256('{"first":' || min(o_orderkey) || ',"model":"m-1","prompt":"Say \\"what\\".","rows":' || count(*) || ',"settings":{"batch":8,"names":["' || min(o_orderstatus) || '","' || max(o_orderstatus) || '"]}}') AS fingerprint FROM orders""")
def run_fingerprint(t):
    """The fingerprint of a run over the orders: what it reads, its model, prompt and settings."""
    d = t("orders")
    r = d.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.min("o_orderstatus").alias("low"), F.max("o_orderstatus").alias("high")).first()
    value = h.run_fingerprint(rows=r.n, first=r["first"], model="m-1", prompt='Say "what".', settings={"names": [r.low, r.high], "batch": 8})
    return d.sparkSession.createDataFrame([(value,)], "fingerprint string")


@query("intervention_pairs", """
WITH p AS (SELECT p_partkey AS image_id, p_name AS n, p_brand AS b, p_size % 3 = 0 AS near FROM part),
a AS (SELECT image_id, n AS target_phrase, 'a  holds the ' || b || ' thing by it .' AS raw, 'a holds the ' || b || ' thing by it .' AS tminus, 'a unspecified person holds the ' || b || ' thing by it .' AS tmatched, 'The ' || b || ' thing is here .' AS tnatural, 'a ' || n || ' holds by it .' AS tcontrol, n, b FROM p WHERE NOT near
  UNION ALL SELECT image_id, 'the ' || b || ' thing', '', 'a ' || n || ' holds by it .', 'a ' || n || ' holds the unspecified thing by it .', 'Nothing happens .', 'a holds the ' || b || ' thing by it .', n, b FROM p WHERE NOT near)
SELECT image_id, target_phrase, tminus, tmatched, tnatural, 'a ' || n || ' holds the ' || b || ' thing by it .' AS tplus, tcontrol, 2 AS regions FROM a""")
def intervention_pairs(t):
    """Deletion, generalisation, natural and control captions of parts; where the boxes overlap there is no control and no pair."""
    p, k = t("part"), F.col("p_partkey").alias("image_id")
    lines = F.array(
        F.concat(F.lit("a [/EN#1/people "), "p_name", F.lit("] holds [/EN#2/other the "), "p_brand", F.lit(" thing] by it .")),
        F.concat(F.lit("[/EN#2/other The "), "p_brand", F.lit(" thing] is here .")), F.lit("Nothing happens ."),
    )
    captions = p.select(k, F.posexplode(lines).alias("caption_index", "line"))
    corner = F.when(F.col("p_size") % 3 == 0, 5).otherwise(20)
    box = lambda *x: F.array(F.array(*[F.lit(v) if isinstance(v, int) else v for v in x]))
    boxes = p.select(k, F.inline(F.array(F.struct(F.lit("1").alias("name"), box(0, 0, 10, 10).alias("boxes")), F.struct(F.lit("2").alias("name"), box(corner, corner, 40, 40).alias("boxes")))))
    d = views.interventions(captions, boxes)
    return d.select("image_id", "target_phrase", "tminus", "tmatched", "tnatural", "tplus", "tcontrol", F.size("regions").alias("regions"))


@query("difference_hashes", """
WITH v AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS e FROM embeddings),
b AS (SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN e[(i // 8) * 9 + i % 8 + 1] > e[(i // 8) * 9 + i % 8 + 2] THEN 1 ELSE 0 END) AS b FROM v)
SELECT vec_id, array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', (1 + 8 * b[4 * k + 1] + 4 * b[4 * k + 2] + 2 * b[4 * k + 3] + b[4 * k + 4])::INT, 1)), '') AS dhash FROM b""")
def difference_hashes(t):
    """Packed comparisons of neighbours in a grid of 9 x 8 values."""
    return t("embeddings").select("vec_id", images.difference_hash(F.concat("embedding", F.slice("embedding", 1, 8))).alias("dhash"))


@query("masking_maps", """
WITH x AS (SELECT vec_id, label, list_transform(range(8), lambda p: list_sum(list_transform(embedding[(8 * p + 1):(8 * p + 8)], lambda y: y::DOUBLE))) AS s FROM embeddings),
m AS (SELECT vec_id, s, list_distinct([vec_id % 8, (vec_id + 3) % 8]) AS places FROM x UNION SELECT vec_id, s, [label % 8] FROM x),
d AS (SELECT vec_id, unnest(places) AS place, list_sum(list_transform(places, lambda q: s[q + 1])) AS d FROM m)
SELECT vec_id, CAST(place AS INTEGER) AS place, round(avg(d), 6) AS importance FROM d GROUP BY 1, 2""")
def masking_maps(t):
    """Importance of eight parts of each vector by what two masks take from a linear score."""
    e = t("embeddings")
    parts = F.array(*[F.slice("embedding", 8 * p + 1, 8).cast("array<double>") for p in range(8)])
    first = F.array((F.col("vec_id") % 8).cast("int"), ((F.col("vec_id") + 3) % 8).cast("int"))
    masks = e.select("vec_id", F.explode(F.array(first, F.array((F.col("label") % 8).cast("int")))).alias("mask"))

    def scorer(batches):
        for b in batches:
            score = [float(sum(sum(p) for p in x)) for x in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["vec_id", "mask", "score"])

    found = attribution.maps(attribution.drops(e.select("vec_id", parts.alias("parts")), masks, "vec_id", scorer), "vec_id")
    return found.select("vec_id", "place", F.round("importance", 6).alias("importance"))


@query("shuffled_control", """
WITH f AS (SELECT o_custkey AS u, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1),
n AS (SELECT u, coalesce(lead(v) OVER w, first_value(v) OVER w) AS v FROM f WINDOW w AS (ORDER BY sha256('3:' || u), u))
SELECT o_orderkey AS k, o_custkey AS u, v AS shuffled FROM orders JOIN n ON u = o_custkey""")
def shuffled_control(t):
    """Each order with the first price of the customer that follows its own in hash order."""
    d = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("u"), F.col("o_totalprice").alias("v"))
    return models.shuffled_features(d, "k", "u", "v", 3, bucket_rows=1 << 20).select("k", "u", "shuffled")


@query("direction_groups", None)
def direction_groups(t):
    """Clusters of directions of forty neighbouring vectors each; tests compare the clusters with a loop."""
    e = t("embeddings").withColumn("bundle", F.floor(F.col("vec_id") / 40))
    return models.direction_clusters(e, "bundle", "vec_id", "embedding", 3).select("bundle", "vec_id", "cluster")
