"""Queries on readers, sinks, checks and small operators of the evidence tables, stated over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestor.functions import geometry as g
from attestor.functions import hashing as h
from attestor.functions import strings as s
from attestor.functions.vectors import bound
from attestor.operators import joins, metrics, models, rules, sampling, views
from attestor.plans.registry import query
from attestor.session import scratch
from attestor.sources import io
from attestor.streaming import incremental as inc


def _at(df, name: str) -> str:
    return scratch(df.sparkSession, name)


@query("strict_lines", """
WITH c AS (SELECT c_nationkey AS f, c_custkey AS k, c_custkey % 11 AS m, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, coalesce(sum(CASE WHEN c_custkey % 11 = 6 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blanks FROM customer)
SELECT f AS file, CASE m WHEN 0 THEN 'missing=["name"], extra=["surname"]' WHEN 1 THEN 'missing=["name"], extra=[]' WHEN 2 THEN 'record must be an object' WHEN 3 THEN 'invalid JSON' WHEN 4 THEN 'value of the wrong type' WHEN 5 THEN 'record must be an object' ELSE 'sound' END AS problem,
count(*) AS n, CAST(sum(i + blanks) AS BIGINT) AS lines, CAST(max(i + blanks) AS BIGINT) AS last_line FROM c GROUP BY 1, 2""")
def strict_lines(t):
    """Customers as JSON lines, a file for each nation, some of them broken in several ways, read strictly; blank lines count in line numbers and are passed over."""
    c = t("customer")
    whole = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    m = F.col("c_custkey") % 11
    line = F.when(m == 0, F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("surname")))).when(m == 1, F.to_json(F.struct(F.col("c_custkey").alias("id"))))
    line = line.when(m == 2, "[1, 2]").when(m == 3, "no json").when(m == 4, F.to_json(F.struct(F.lit("x").alias("id"), F.col("c_name").alias("name")))).when(m == 5, "17").otherwise(whole)
    path = _at(c, "lines")
    rows = c.select("c_nationkey", "c_custkey", F.concat(line, F.when(m == 6, F.lit("\n   ")).otherwise("")).alias("value"))
    rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    _, problems = io.strict_jsonl(c.sparkSession, f"{path}/*", "id long, name string")
    bad = problems.select("file", "problem", "line")
    good = io.raw_lines(c.sparkSession, f"{path}/*").join(bad, ["file", "line"], "left_anti").select("file", F.lit("sound").alias("problem"), "line")
    every = bad.unionByName(good).withColumn("file", F.regexp_extract("file", r"c_nationkey=(\d+)", 1).cast("int"))
    return every.groupBy("file", "problem").agg(F.count("*").alias("n"), F.sum("line").alias("lines"), F.max("line").alias("last_line"))


@query("jsonl_lines", """
SELECT s_suppkey AS k, '{"acctbal":' || s_acctbal || ',"k":' || s_suppkey || ',"name":"' || s_name || '","nation":' || coalesce(CASE WHEN s_nationkey <> 3 THEN CAST(s_nationkey AS VARCHAR) END, 'null') || '}' AS raw, true AS follows FROM supplier""")
def jsonl_lines(t):
    """The lines that the sink writes: keys in order, nulls written, rows in the order of their key within and between files."""
    d = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") != 3, F.col("s_nationkey")).alias("nation"), F.col("s_acctbal").alias("acctbal"))
    path = _at(d, "sorted")
    io.write_jsonl(d, path, ["k"])
    lines = io.raw_lines(d.sparkSession, path).withColumn("k", F.get_json_object("raw", "$.k").cast("long"))
    ends = lines.groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high"))  # one row for each file
    before = F.lag("high").over(Window.orderBy("file"))
    lines = lines.join(ends.select("file", F.coalesce(before < F.col("low"), F.lit(True)).alias("apart")), "file")
    here = F.coalesce(F.lag("k").over(Window.partitionBy("file").orderBy("line")) < F.col("k"), F.lit(True))
    return lines.select("k", "raw", (here & F.col("apart")).alias("follows"))


@query("jsonl_round_trip", """
SELECT s_nationkey AS nation, count(*) AS n, round(sum(s_acctbal), 2) AS total, min(s_name) AS first_name, 0 AS from_nowhere FROM supplier GROUP BY 1""")
def jsonl_round_trip(t):
    """Suppliers written as sorted JSON lines and read back; a file that is not there reads as no rows."""
    d = t("supplier")
    spark, path, schema = d.sparkSession, _at(d, "suppliers"), "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"
    io.write_jsonl(d, path, ["s_suppkey"])
    back = io.jsonl(spark, path, schema).withColumn("none", F.lit(0)).unionByName(io.lenient_jsonl(spark, path + "-not-there", schema).withColumn("none", F.lit(1)))
    return back.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"), F.min("s_name").alias("first_name"), F.sum("none").cast("int").alias("from_nowhere"))


@query("json_document_scan", "SELECT r_regionkey AS id, upper(r_name) AS name, length(r_name) AS size FROM region")
def json_document_scan(t):
    d = t("region")
    path = _at(d, "document")
    io.write_report(d.select(F.col("r_regionkey").alias("id"), F.upper("r_name").alias("name"), F.length("r_name").alias("size")), path)
    return io.json_document(d.sparkSession, path, "id int, name string, size int")


@query("csv_round_trip", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || ', \"so called\"' AS n_name, CASE WHEN n_regionkey = 1 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS region FROM nation")
def csv_round_trip(t):
    d = t("nation").select("n_nationkey", F.concat("n_name", F.lit(', "so called"')).alias("n_name"), F.when(F.col("n_regionkey") != 1, F.col("n_regionkey")).alias("region"))
    path = _at(d, "csv")
    io.write_csv(d, path, ["n_nationkey", "n_name", "region"])
    return io.csv(d.sparkSession, path)


@query("id_list_scan", "SELECT id, count(*) AS n FROM (SELECT unnest([p_brand, CAST(p_size AS VARCHAR)]) AS id FROM part) GROUP BY id")
def id_list_scan(t):
    d = t("part")
    path = _at(d, "ids")
    d.select(F.concat(F.lit("  "), "p_brand", F.lit(" \t"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " ").otherwise("")).alias("value")).write.text(path)
    return io.id_list(d.sparkSession, path).groupBy("id").agg(F.count("*").alias("n"))


@query("array_store", "SELECT count(*) AS n, round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 3) AS total FROM embeddings WHERE label % 2 = 0")
def array_store(t):
    d = t("embeddings")
    path = _at(d, "arrays")
    io.write_arrays(d.select(F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("name"), F.col("embedding").alias("value")), path)
    total = F.aggregate("value", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return io.read_array(d.sparkSession, path, "even").agg(F.count("*").alias("n"), F.round(F.sum(total), 3).alias("total"))


@query("annotation_boxes", """
WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name AS name FROM nation),
b AS (SELECT k, name, greatest(0, k - 1 - 3) AS x1, greatest(0, 0) AS y1, least(40, 20 + k) AS x2, least(30, 12 + r) AS y2 FROM n UNION ALL SELECT k, 'other', 4, 4, 10, 5 + r FROM n)
SELECT k, name, x1, y1, x2, y2 FROM b WHERE x2 - x1 >= 2 AND y2 - y1 >= 2""")
def annotation_boxes(t):
    """One XML file for each nation; 1-based inclusive corners become half-open boxes within the image."""
    d, k, r = t("nation"), F.col("n_nationkey"), F.col("n_regionkey")

    def thing(name, *corners):
        tags = [F.concat(F.lit(f"<{tag}>"), x.cast("string"), F.lit(f"</{tag}>")) for tag, x in zip(("xmin", "ymin", "xmax", "ymax"), corners)]
        return F.concat(F.lit("<object><name>"), name, F.lit("</name><bndbox>"), *tags, F.lit("</bndbox></object>"))

    xml = F.concat(F.lit("<annotation><size><width>40</width><height>30</height></size>"), thing(F.col("n_name"), k - 3, F.lit(0), 20 + k, 12 + r), thing(F.lit("other"), F.lit(5), F.lit(5), F.lit(10), 5 + r), F.lit("</annotation>"))
    path = _at(d, "xml")
    d.repartition("n_nationkey").select(k.alias("k"), xml.alias("value")).write.partitionBy("k").text(path)
    boxes = io.boxes_by_name(io.annotations(d.sparkSession, f"{path}/*/*"), least=2).select(F.regexp_extract("file", r"/k=(\d+)/", 1).cast("int").alias("k"), "name", F.explode("boxes").alias("b"))
    return boxes.select("k", "name", *[F.col("b")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


@query("annotated_captions", """
SELECT p_partkey AS id, 'a ' || p_name || ' by ' || p_brand || ' .' AS text, 2 AS phrases, 'id' || p_partkey || ':other/things:' || p_name || ':1:' || (1 + len(string_split(p_name, ' '))) AS first_phrase FROM part""")
def annotated_captions(t):
    k = F.col("p_partkey").cast("string")
    line = F.concat(F.lit("a [/EN#id"), k, F.lit("/other/things "), "p_name", F.lit("] by [/EN#b/people "), "p_brand", F.lit("] ."))
    d = t("part").select(F.col("p_partkey").alias("id"), s.parse_inline(line).alias("p"))
    x = F.col("p.phrases")[0]
    shown = F.concat_ws(":", x["id"], F.array_join(x["types"], "/"), x["phrase"], x["start"].cast("string"), x["stop"].cast("string"))
    return d.select("id", F.col("p.text").alias("text"), F.size("p.phrases").alias("phrases"), shown.alias("first_phrase"))


@query("file_digests", "SELECT n_nationkey AS k, sha256(n_name || chr(10)) AS sha256 FROM nation")
def file_digests(t):
    d = t("nation")
    path = _at(d, "files")
    d.repartition("n_nationkey").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value")).write.partitionBy("k").text(path)
    return io.file_hashes(d.sparkSession, f"{path}/*/*").select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("int").alias("k"), "sha256")


@query("markdown_report", """
SELECT '# Nations' || chr(10) || chr(10) || '| region | nations | names |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_regionkey || ' | ' || n || ' | ' || names || ' |', chr(10) ORDER BY n_regionkey) || chr(10) AS value
FROM (SELECT n_regionkey, count(*) AS n, min(n_name) || '\\|' || max(n_name) AS names FROM nation GROUP BY 1)""")
def markdown_report(t):
    d = t("nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations"), F.concat(F.min("n_name"), F.lit("|"), F.max("n_name")).alias("names"))
    return io.markdown(d, "Nations", ["region"])


@query("job_ledger", """
SELECT part AS partition, count(*) AS jobs, CAST(sum(g) AS BIGINT) AS gpus, round(sum(g * secs / 3600.0), 6) AS gpu_hours FROM (
SELECT 'p' || c_nationkey % 3 AS part, c_nationkey % 5 AS g, c_custkey % 997 AS secs FROM customer WHERE c_custkey % 4 <> 0) GROUP BY 1""")
def job_ledger(t):
    """Jobs as a scheduler lists them; steps, whose id has a dot, are passed over; typed resources are added up."""
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 5
    step = F.when(k % 4 == 0, ".batch").otherwise("")
    typed = F.concat(F.lit("cpu=4,gres/gpu:a="), F.floor(n / 2).cast("string"), F.lit(",gres/gpu:b="), (n - F.floor(n / 2)).cast("string"))
    res = F.when(k % 2 == 0, F.concat(F.lit("cpu=4,mem=8G,gres/gpu="), n.cast("string"))).otherwise(typed)
    line = F.concat_ws("|", F.concat(k.cast("string"), step), F.concat(F.lit("p"), (F.col("c_nationkey") % 3).cast("string")), (k % 997).cast("string"), F.lit("COMPLETED"), res)
    d = io.ledger(t("customer").select(line.alias("value")))
    return d.groupBy("partition").agg(F.count("*").alias("jobs"), F.sum("allocated_gpus").cast("long").alias("gpus"), F.round(F.sum("gpu_hours"), 6).alias("gpu_hours"))


@query("box_validity", """
WITH b AS (SELECT p_partkey AS k, CAST(p_size - 3 AS INTEGER) AS x1, CAST(p_partkey % 9 - 1 AS INTEGER) AS y1, CAST(p_size % 17 + 8 AS INTEGER) AS x2, CAST(p_partkey % 31 AS INTEGER) AS y2 FROM part)
SELECT CAST(k AS VARCHAR) AS key FROM b WHERE NOT (x1 >= 0 AND x1 < x2 AND x2 <= 24 AND y1 >= 0 AND y1 < y2 AND y2 <= 28)""")
def box_validity(t):
    k, z = F.col("p_partkey"), F.col("p_size")
    box = F.array(*[x.cast("int") for x in (z - 3, k % 9 - 1, z % 17 + 8, k % 31)])
    return rules.rows(t("part").withColumn("box", box), "part", ["p_partkey"], box=g.valid("box", F.lit(24), F.lit(28))).select("key")


@query("forbidden_keys", """
WITH e AS (SELECT *, 'k' || user_id % 3 AS outer_key FROM events)
SELECT DISTINCT 'record.props.' || k AS key FROM (SELECT unnest(json_keys(props)) AS k FROM events) WHERE contains(lower(k), 'k')
UNION SELECT 'record.who.user_key' UNION SELECT 'record.Ranked' UNION SELECT 'record.Ranked[].kind'
UNION SELECT 'record.who.types.' || event_type FROM e WHERE contains(event_type, 'k') UNION SELECT 'record.lists[][].' || event_type FROM e WHERE contains(event_type, 'k')
UNION SELECT 'record.deep.' || outer_key FROM e UNION SELECT 'record.deep.' || outer_key || '.' || event_type FROM e WHERE contains(event_type, 'k')""")
def forbidden_keys(t):
    """Names in columns, structs, and in maps within lists, structs and other maps."""
    types = F.create_map("event_type", F.lit(1))
    deep = F.create_map(F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string")), types)
    e = t("events").select("event_id", F.from_json("props", "map<string,string>").alias("props"), F.struct(F.col("user_id").alias("user_key"), "ts", types.alias("types")).alias("who"), F.array(F.struct(F.col("event_type").alias("kind"))).alias("Ranked"), F.array(F.array(types)).alias("lists"), deep.alias("deep"))
    return rules.forbidden_keys(e, "events", ["k"]).select("key")


@query("forbidden_json_keys", """
WITH j AS (SELECT '{"a": [1, ' || props || ', [{"' || event_type || '": {"b": ' || props || '}}]], "t": "\\"k\\": {"}' AS j FROM events)
SELECT DISTINCT 'record' || regexp_replace(substr(x.fullkey, 2), '\\[\\d+\\]', '[]', 'g') AS key FROM j, json_tree(j.j) AS x WHERE contains(lower(CAST(x.key AS VARCHAR)), 'k')""")
def forbidden_json_keys(t):
    """Names within JSON texts of any shape, with their paths."""
    j = F.concat(F.lit('{"a": [1, '), "props", F.lit(', [{"'), "event_type", F.lit('": {"b": '), "props", F.lit('}}]], "t": "\\"k\\": {"}'))
    return rules.forbidden_json_keys(t("events").select(j.alias("j")), "events", "j", ["k"]).select("key")


@query("exactly_once", """
SELECT CAST(coalesce(c_custkey, o_custkey) AS VARCHAR) AS key, CAST(coalesce(n, 0) AS VARCHAR) AS detail FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n IS NULL OR n <> 1 OR c_custkey IS NULL""")
def exactly_once(t):
    d = t("orders").select(F.col("o_custkey").alias("c_custkey"))
    return rules.exactly_once(d, t("customer"), "orders", "c_custkey").select("key", "detail")


@query("same_parent", """
SELECT CAST(l_orderkey AS VARCHAR) || ':' || l_linenumber AS key, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey % 5 <> c_nationkey % 5 GROUP BY 1""")
def same_parent(t):
    d = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    d = d.select("l_orderkey", "l_linenumber", (F.col("s_nationkey") % 5).alias("a"), (F.col("c_nationkey") % 5).alias("b"))
    return rules.same_parent(d, "lineitem", ["l_orderkey", "l_linenumber"], "a", "b").groupBy("key").agg(F.count("*").alias("n"))


@query("derived_equality", """
WITH d AS (SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1),
p AS (SELECT k, n + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS n, top FROM d WHERE k % 17 <> 0 UNION ALL SELECT -1, 0, 0.5)
SELECT CAST(coalesce(d.k, p.k) AS VARCHAR) AS key, CASE WHEN p.k IS NULL THEN 'missing' WHEN d.k IS NULL THEN 'unexpected' ELSE 'differs' END AS detail FROM d FULL JOIN p ON d.k = p.k WHERE d.n IS DISTINCT FROM p.n OR d.top IS DISTINCT FROM p.top""")
def derived_equality(t):
    d = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    p = d.where("k % 17 <> 0").withColumn("n", F.col("n") + (F.col("k") % 13 == 0).cast("long"))
    p = p.unionByName(p.sparkSession.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit(0).cast("long").alias("n"), F.lit(0.5).alias("top")))
    return rules.same_rows(p, d, "totals", ["k"]).select("key", "detail")


@query("vote_pairs", """
WITH v AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ['yes'] WHEN 1 THEN ['yes', 'maybe'] WHEN 2 THEN ['no', NULL] ELSE ['yes', 'no'] END AS votes, CASE doc_id % 3 WHEN 0 THEN ['a', 'a'] WHEN 1 THEN ['a', ''] ELSE ['a', 'b'] END AS ids FROM labels)
SELECT rule, count(*) AS n, min(doc_id) AS first_id FROM (SELECT 'votes' AS rule, doc_id FROM v WHERE doc_id % 5 < 3 UNION ALL SELECT 'annotators', doc_id FROM v WHERE doc_id % 3 < 2) GROUP BY 1""")
def vote_pairs(t):
    k = F.col("doc_id")
    votes = F.when(k % 5 == 0, F.array(F.lit("yes"))).when(k % 5 == 1, F.array(F.lit("yes"), F.lit("maybe"))).when(k % 5 == 2, F.array(F.lit("no"), F.lit(None).cast("string"))).otherwise(F.array(F.lit("yes"), F.lit("no")))
    ids = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("a"))).when(k % 3 == 1, F.array(F.lit("a"), F.lit(""))).otherwise(F.array(F.lit("a"), F.lit("b")))
    d = t("labels").select("doc_id", votes.alias("votes"), ids.alias("ids"))
    v = rules.rows(d, "labels", ["doc_id"], votes=rules.vote_pair("votes", ["yes", "no"]), annotators=rules.vote_pair("ids", distinct=True))
    return v.groupBy("rule").agg(F.count("*").alias("n"), F.min(F.col("key").cast("long")).alias("first_id"))


@query("error_sample", """
WITH v AS (SELECT 'price' AS rule, CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_retailprice >= 1000 UNION ALL SELECT 'size', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size >= 40)
SELECT rule, key, n FROM (SELECT *, count(*) OVER (PARTITION BY rule) AS n, row_number() OVER (PARTITION BY rule ORDER BY key) AS k FROM v) WHERE k <= 5""")
def error_sample(t):
    v = rules.rows(t("part"), "part", ["p_partkey"], price=F.col("p_retailprice") < 1000, size=F.col("p_size") < 40)
    return rules.sample(v).select("rule", "key", "n")


@query("human_reviewers", """
SELECT human, count(*) AS n FROM (SELECT c_custkey % 6 NOT IN (1, 3, 4) AS human FROM customer) GROUP BY 1""")
def human_reviewers(t):
    marks = F.lit(["", " (AI review)", " codec", " NonHuman ", "\tcodex-2", " model"])
    name = F.concat("c_name", marks[(F.col("c_custkey") % 6).cast("int")])
    return t("customer").groupBy(rules.is_human(name).alias("human")).agg(F.count("*").alias("n"))


@query("action_figures", """
WITH o AS (SELECT o_custkey AS k, list(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS f, list(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS o, list(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS u, count(*) AS n, sum(o_orderkey) AS cost FROM orders GROUP BY 1),
c AS (SELECT k, coalesce(len(f), 0) AS f, coalesce(len(o), 0) AS o, coalesce(len(u), 0) AS u, n, cost FROM o)
SELECT k, round(f * 1.0 / n, 9) AS delta_coverage, round(CASE WHEN f + o > 0 THEN o * 1.0 / (f + o) END, 9) AS invalid_claim_rate, round(CASE WHEN f + u > 0 THEN u * 1.0 / (f + u) END, 9) AS repeat_rate, CAST(n - f AS DOUBLE) AS unknown_claim_count, CAST(cost AS DOUBLE) AS pixel_cost FROM c""")
def action_figures(t):
    """The struct of an action's figures, with orders in the place of facts: filled, open, urgent and other ones."""
    from attestor.operators.policy import action_metrics

    def ids(c):
        return F.collect_list(F.when(c, F.col("o_orderkey").cast("string")))

    d = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(
        ids(F.col("o_orderstatus") == "F").alias("new_supported_fact_ids"), ids(F.col("o_orderstatus") == "O").alias("contradicted_claim_ids"), ids(F.col("o_orderpriority") == "1-URGENT").alias("repeated_fact_ids"),
        ids(F.col("o_orderstatus") != "F").alias("unknown_claim_ids"), ids(F.lit(True)).alias("eligible_missing_fact_ids"), F.count("*").alias("fact_count"), F.sum("o_orderkey").alias("pixel_cost"),
    )
    m = d.select("k", F.struct(*[c.alias(n) for n, c in action_metrics().items()]).alias("metrics"))
    return m.select("k", *[F.round(f"metrics.{c}", 9).alias(c) for c in ("delta_coverage", "invalid_claim_rate", "repeat_rate")], "metrics.unknown_claim_count", "metrics.pixel_cost")


@query("feature_audit", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda a: a * a))) AS n, vec_id % 4 AS m FROM e)
SELECT rule, count(*) AS n FROM (SELECT 'unit_norm' AS rule FROM x WHERE abs(n - 1) > 0.001 OR m = 0 UNION ALL SELECT 'finite' FROM x WHERE m = 0 UNION ALL SELECT 'one_hot' FROM x WHERE m = 1 UNION ALL SELECT 'share' FROM x WHERE m = 2) GROUP BY 1""")
def feature_audit(t):
    m, v = F.col("vec_id") % 4, F.col("embedding").cast("array<double>")
    d = t("embeddings").select("vec_id", F.when(m == 0, F.concat(v, F.array(F.lit(float("nan"))))).otherwise(v).alias("v"), F.when(m == 1, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("hot"), F.when(m == 2, F.array(F.lit(1.5))).otherwise(F.array(F.lit(0.5))).alias("share"))
    # a length that is no number is not within the tolerance either
    return rules.feature_problems(d, "vec_id", "v", "hot", "v", "share").groupBy("rule").agg(F.count("*").alias("n"))


@query("id_forms", """
WITH i AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'img_' || substr(md5(c_name), 1, 20) WHEN 1 THEN 'img_' || c_name WHEN 2 THEN 'img_' || upper(substr(md5(c_name), 1, 15)) || 'F' ELSE 'img_' || substr(md5(c_name), 1, 15) END AS id FROM customer)
SELECT regexp_full_match(id, 'img_[0-9a-f]{16,64}') AS good, count(*) AS n FROM i GROUP BY 1""")
def id_forms(t):
    from attestor.operators.bundle import _id

    digest, k = F.md5(F.col("c_name").cast("binary")), F.col("c_custkey") % 4
    body = F.when(k == 0, F.substring(digest, 1, 20)).when(k == 1, F.col("c_name")).when(k == 2, F.concat(F.upper(F.substring(digest, 1, 15)), F.lit("F"))).otherwise(F.substring(digest, 1, 15))
    return t("customer").select(F.concat(F.lit("img_"), body).alias("id")).groupBy(_id("id", "img").alias("good")).agg(F.count("*").alias("n"))


@query("hamming_new_old", """
WITH d AS (SELECT doc_id, xor(CAST(('0x' || substr(md5(CAST(doc_id // 4 AS VARCHAR)), 1, 15)) AS BIGINT), CAST(1 AS BIGINT) << CAST(doc_id % 5 AS INTEGER)) AS h FROM documents)
SELECT a.doc_id AS id_l, b.doc_id AS id_r, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM d a JOIN d b ON a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 AND bit_count(xor(a.h, b.h)) <= 4""")
def hamming_new_old(t):
    base = F.conv(F.substring(F.md5(F.floor(F.col("doc_id") / 4).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    d = t("documents").select("doc_id", base.bitwiseXOR(F.expr("shiftleft(1L, cast(doc_id % 5 as int))")).alias("h"))
    out = joins.hamming_pairs(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "doc_id", "h", width=60, upper=False)
    return out.withColumn("distance", F.col("distance").cast("int"))


@query("index_gather", """
SELECT o_orderkey AS item, o_custkey AS at, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey""")
def index_gather(t):
    index = t("orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("at"))
    return joins.gathered(t("customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey", index, "at").select("item", "at", "segment")


@query("stacked_ranges", """
WITH p AS (SELECT 0 AS i, 'returned' AS part, l_orderkey AS o, l_linenumber AS l, l_partkey AS k, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 1, 'late', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_discount > 0.08),
r AS (SELECT *, row_number() OVER (ORDER BY i, o, l, k, s) - 1 AS row FROM p), g AS (SELECT part, min(row) AS start, max(row) + 1 AS stop FROM r GROUP BY 1)
SELECT r.part AS part, start, stop, count(*) AS n, count(DISTINCT row) AS numbers, CAST(sum(row % 1009 * q) AS BIGINT) AS weighed, min(q) FILTER (WHERE row = start) AS first_quantity, max(q) FILTER (WHERE row = stop - 1) AS last_quantity FROM r JOIN g ON r.part = g.part GROUP BY 1, 2, 3""")
def stacked_ranges(t):
    """Two selections of lines one after another, with a column that is no key; every number once."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    d = t("lineitem").select(*order, "l_returnflag", "l_discount", F.col("l_quantity").cast("long").alias("q"))
    rows, ranges = joins.stacked({"returned": d.where("l_returnflag = 'R'"), "late": d.where("l_discount > 0.08")}, order)
    ends = [F.min(F.when(F.col("row") == at, F.col("q"))).alias(name) for name, at in (("first_quantity", F.col("start")), ("last_quantity", F.col("stop") - 1))]
    return rows.join(ranges, "part").groupBy("part", "start", "stop").agg(F.count("*").alias("n"), F.count_distinct("row").alias("numbers"), F.sum(F.col("row") % 1009 * F.col("q")).alias("weighed"), *ends)


@query("completion_rate", """
WITH d AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END AS a, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'x' END AS b, n_chars > 500 AS need_b, doc_id % 2 = 0 AS need_c FROM documents)
SELECT source, count(*) AS rows, CAST(sum(CASE WHEN trim(coalesce(a, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN need_b AND b IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS filled,
CAST(sum(1 + CASE WHEN need_b THEN 1 ELSE 0 END + CASE WHEN need_c THEN 1 ELSE 0 END) AS BIGINT) AS required,
round(sum(CASE WHEN trim(coalesce(a, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN need_b AND b IS NOT NULL THEN 1 ELSE 0 END) * 1.0 / sum(1 + CASE WHEN need_b THEN 1 ELSE 0 END + CASE WHEN need_c THEN 1 ELSE 0 END), 9) AS rate FROM d GROUP BY 1""")
def completion_rate(t):
    k = F.col("doc_id")
    d = t("documents").select("doc_id", "source", "n_chars", F.when(k % 3 == 0, " ").otherwise(F.col("lang")).alias("a"), F.when(k % 4 != 0, "x").alias("b"), F.lit("").alias("c"))
    out = metrics.completion(d, {"a": F.lit(True), "b": F.col("n_chars") > 500, "c": k % 2 == 0}, ["source"])
    return out.withColumn("rate", F.round("rate", 9))


@query("unique_label", "SELECT DISTINCT p_type AS value FROM part WHERE contains(lower(p_type), 'econ')")
def unique_label(t):
    return metrics.unique_match(t("part"), "p_type", "ECON")


@query("suppressed_boxes", """
WITH RECURSIVE d AS (SELECT p_size AS img, CAST(p_partkey AS INTEGER) AS ord, CAST(p_partkey % 37 AS INTEGER) AS x, CAST(p_partkey % 11 AS INTEGER) AS y, CAST(10 + p_partkey % 5 AS INTEGER) AS w, round(p_retailprice / 3000, 6) AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, ord) AS k FROM d),
s AS (SELECT img, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(ord INTEGER, x INTEGER, y INTEGER, w INTEGER)[]) AS kept FROM (SELECT DISTINCT img FROM d)
UNION ALL SELECT s.img, r.k, CASE WHEN len(s.kept) < 6 AND len(list_filter(s.kept, lambda b: greatest(0, least(b.x + b.w, r.x + r.w) - greatest(b.x, r.x)) * greatest(0, least(b.y + 20, r.y + 20) - greatest(b.y, r.y)) > 0.7 * (20 * (b.w + r.w) - greatest(0, least(b.x + b.w, r.x + r.w) - greatest(b.x, r.x)) * greatest(0, least(b.y + 20, r.y + 20) - greatest(b.y, r.y))))) = 0
THEN list_append(s.kept, {'ord': r.ord, 'x': r.x, 'y': r.y, 'w': r.w}) ELSE s.kept END FROM s JOIN r ON r.img = s.img AND r.k = s.k + 1)
SELECT img, unnest(list_transform(kept, lambda b: b.ord)) AS ord FROM (SELECT img, kept, row_number() OVER (PARTITION BY img ORDER BY k DESC) AS last FROM s) WHERE last = 1""")
def suppressed_boxes(t):
    k = F.col("p_partkey")
    x, y, w = (k % 37).cast("int"), (k % 11).cast("int"), (10 + k % 5).cast("int")
    d = t("part").select(F.col("p_size").alias("img"), k.cast("int").alias("ord"), F.array(x, y, x + w, y + 20).alias("box"), F.round(F.col("p_retailprice") / 3000, 6).alias("score"))
    return views.suppress(d, "img").select("img", "ord")


@query("closest_unions", """
WITH d AS (SELECT p_partkey // 9 AS img, CAST(p_partkey % 9 AS INTEGER) AS ord, CAST(p_partkey % 60 AS INTEGER) AS x, CAST(p_partkey % 43 AS INTEGER) AS y, round(p_retailprice / 3000, 6) AS score FROM part),
e AS (SELECT * FROM d), p AS (SELECT a.img AS img, a.ord AS i, b.ord AS j, least(a.x, b.x) AS x1, least(a.y, b.y) AS y1, greatest(a.x, b.x) + 12 AS x2, greatest(a.y, b.y) + 9 AS y2, least(a.score, b.score) AS score,
sqrt(pow((2 * a.x - 2 * b.x) / 2.0 / 80, 2) + pow((2 * a.y - 2 * b.y) / 2.0 / 60, 2)) AS dist FROM e a JOIN e b ON a.img = b.img AND a.ord < b.ord),
q AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY dist, -score, i, j) AS rn FROM p WHERE (x2 - x1) * (y2 - y1) < 0.85 * 80 * 60)
SELECT img, i, j, x1, y1, x2, y2, score FROM q WHERE rn <= 2""")
def closest_unions(t):
    """The two closest pairs of detections of each image, nine parts each, after those whose union is nearly the whole image are left out."""
    k = F.col("p_partkey")
    x, y = (k % 60).cast("int"), (k % 43).cast("int")
    d = t("part").select(F.floor(k / 9).alias("img"), (k % 9).cast("int").alias("ord"), F.array(x, y, x + 12, y + 9).alias("box"), F.round(F.col("p_retailprice") / 3000, 6).alias("score"))
    images = d.select("img").distinct().select("img", F.lit(80).alias("width"), F.lit(60).alias("height"))
    v = views.evidence_views(images, d, "img").where("view_family = 'relation_union'")
    b, n = F.get("boxes", F.lit(0)), F.col("grounding_indices")
    return v.select("img", F.get(n, F.lit(0)).alias("i"), F.get(n, F.lit(1)).alias("j"), *[F.get(b, F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], F.col("proposal_score").alias("score"))


@query("offset_breaks", """
WITH o AS (SELECT p_brand AS grp, p_partkey AS k, coalesce(sum(p_size) OVER w, 0) AS before, p_size FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT grp, k, before + CASE WHEN k % 50 = 7 THEN 1 ELSE 0 END AS start, before + p_size AS stop FROM o), l AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY grp ORDER BY k), 0) AS p FROM s)
SELECT k, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM l WHERE start <> p OR stop < start""")
def offset_breaks(t):
    d = sampling.offsets(t("part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("k"), "p_size"), "grp", ["k"], "p_size")
    d = d.withColumn("start", F.col("start") + (F.col("k") % 50 == 7).cast("int"))
    return sampling.broken_offsets(d, "grp", ["k"], "start", "stop").select("k", "start", "stop")


def _picks_sql(names: list[str], each: int) -> str:
    """Each category's picks as a table that leaves out the owners of all tables before it."""
    tables, before = [], []
    for k, name in enumerate(names):
        free = "".join(f" AND w NOT IN (SELECT w FROM a{j})" for j in before)
        tables.append(f"a{k} AS (SELECT w, min(k) AS k FROM o WHERE c = '{name}'{free} GROUP BY w ORDER BY 2 LIMIT {each})")
        before.append(k)
    shown = " UNION ALL ".join(f"SELECT '{name}' AS c, w, k FROM a{k}" for k, name in enumerate(names))
    return f"WITH o AS (SELECT o_orderpriority AS c, o_custkey % 60 AS w, o_orderkey AS k FROM orders), {', '.join(tables)} {shown}"


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("unique_picks", _picks_sql(PRIORITIES, 11))
def unique_picks(t):
    """Eleven owners for each of five priorities from sixty owners, so that later ones find most of them taken."""
    d = t("orders").select(F.col("o_orderpriority").alias("c"), (F.col("o_custkey") % 60).alias("w"), F.col("o_orderkey").alias("k"))
    return sampling.unique_picks(d, "c", "w", [F.col("k")], 11, PRIORITIES)


@query("seeded_shuffle", """
SELECT doc_id, CAST(row_number() OVER (ORDER BY sha256('11:' || CAST(doc_id AS VARCHAR)), doc_id) AS BIGINT) AS place FROM documents QUALIFY place <= 40""")
def seeded_shuffle(t):
    """The first forty of a seeded shuffle, with their places."""
    d = sampling.shuffled(t("documents").select("doc_id"), 11, ["doc_id"]).limit(40)
    return sampling.ranked(d, [], [h.hash_order(11, "doc_id"), F.col("doc_id")], "place").withColumn("place", F.col("place").cast("long"))


@query("early_exit", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000 ORDER BY o_orderkey LIMIT 25")
def early_exit(t):
    """The first orders, in the order of the table, for which a test holds."""
    return sampling.early_exit(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 100000), 25).select("o_orderkey")


@query("phrase_edits", """
WITH w AS (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, array_to_string(list_concat(w[1:2], w[5:]), ' ') AS deleted, CASE item_id % 3 WHEN 0 THEN 'a unspecified person' WHEN 1 THEN 'unspecified unspecified unspecified thing' ELSE 'animal' END AS general FROM w""")
def phrase_edits(t):
    k = F.col("item_id") % 3
    phrase = F.when(k == 0, "a tall rower").when(k == 1, "quite some red balloon").otherwise("dog")
    types = F.when(k == 0, F.array(F.lit("people"))).when(k == 1, F.array(F.lit("unheard"))).otherwise(F.array(F.lit("unheard"), F.lit("animals")))
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return t("benchmark").select("item_id", s.delete_words(words, F.lit(2), F.lit(4)).alias("deleted"), s.generalise(phrase, types).alias("general"))


@query("parsed_answers", """
WITH x AS (SELECT role, trim(lower(text), ' .,:;!*-_' || chr(9) || chr(10) || chr(13)) AS x FROM conversations), f AS (SELECT role, x, list_distinct(regexp_extract_all(x, '\\b(that|this|ce|der)\\b', 1)) AS f FROM x)
SELECT role, CASE WHEN x = 't' THEN 'that' WHEN x IN ('that', 'this', 'ce', 'der') THEN x WHEN len(f) = 1 THEN f[1] END AS kind, count(*) AS n FROM f GROUP BY 1, 2""")
def parsed_answers(t):
    """The one label that a turn's text is or names, for whole texts in four languages."""
    d = t("conversations").select("role", s.binary_label("text", ["that", "this", "ce", "der"], {"t": "that"}).alias("kind"))
    return d.groupBy("role", "kind").agg(F.count("*").alias("n"))


@query("same_texts", """
SELECT same, count(*) AS n FROM (SELECT c_custkey % 4 < 3 AS same FROM customer) GROUP BY 1""")
def same_texts(t):
    k = F.col("c_custkey") % 4
    other = F.when(k == 0, F.upper("c_name")).when(k == 1, F.concat(F.lit("\t"), F.lower("c_name"), F.lit(" \n"))).when(k == 2, F.col("c_name")).otherwise(F.concat("c_name", F.lit(".")))
    return t("customer").groupBy(s.same_text("c_name", other).alias("same")).agg(F.count("*").alias("n"))


@query("fenced_objects", """
SELECT verdict, count(*) AS n, count(DISTINCT why) AS reasons FROM (SELECT CASE WHEN c_custkey % 5 < 2 THEN 'v' || c_nationkey END AS verdict, CASE WHEN c_custkey % 5 < 2 THEN c_mktsegment END AS why FROM customer) GROUP BY 1""")
def fenced_objects(t):
    body = F.to_json(F.struct(F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("verdict"), F.col("c_mktsegment").alias("why")))
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, body).when(k == 2, F.concat(F.lit("So: "), body)).when(k == 3, '{"verdict": "x"}').otherwise('{"verdict": "x", "why": " "}')
    m = s.fenced_json(text, ["verdict", "why"])
    d = t("customer").select(F.try_element_at(m, F.lit("verdict")).alias("verdict"), F.try_element_at(m, F.lit("why")).alias("why"))
    return d.groupBy("verdict").agg(F.count("*").alias("n"), F.count_distinct("why").alias("reasons"))


@query("cropped_boxes", """
WITH b AS (SELECT p_partkey AS k, 300 + p_partkey % 200 AS w, 400 - p_partkey % 90 AS h, p_partkey % 120 AS x, p_size AS y FROM part),
s AS (SELECT *, 224.0 / least(w, h) AS f FROM b), c AS (SELECT k, w, h, x, y, x * f - (w * f - 224) / 2 AS x1, y * f - (h * f - 224) / 2 AS y1, (x + 90) * f - (w * f - 224) / 2 AS x2, (y + 60) * f - (h * f - 224) / 2 AS y2 FROM s),
v AS (SELECT *, greatest(0, least(224, x2) - greatest(0, x1)) * greatest(0, least(224, y2) - greatest(0, y1)) / ((x2 - x1) * (y2 - y1)) AS seen FROM c)
SELECT k, round(x1, 6) AS x1, round(y2, 6) AS y2, round(seen, 6) AS visible, CASE WHEN seen = 0 THEN 'invisible' WHEN seen < 1 - 1e-8 THEN 'partial' ELSE 'full' END AS kind,
(SELECT count(*) FROM range(0, 196) t(p) WHERE (p % 14 + 0.5) * 16 >= x1 AND (p % 14 + 0.5) * 16 < x2 AND (p // 14 + 0.5) * 16 >= y1 AND (p // 14 + 0.5) * 16 < y2) AS patches,
round(90.0 * 60 / (w * h), 9) AS share FROM v""")
def cropped_boxes(t):
    """Boxes after a centre crop, what is seen of them, their patches, and the area's share of the image."""
    k = F.col("p_partkey")
    d = t("part").select(k.alias("k"), (300 + k % 200).cast("int").alias("w"), (400 - k % 90).cast("int").alias("h"), F.array(*[x.cast("int") for x in (k % 120, F.col("p_size"), k % 120 + 90, F.col("p_size") + 60)]).alias("b"))
    d = d.withColumn("c", g.center_crop("b", "w", "h"))
    kept = bound(F.col("c.box"), lambda b: F.size(F.filter(g.patches(b), lambda p: ((p % 14 + 0.5) * 16 >= b[0]) & ((p % 14 + 0.5) * 16 < b[2]) & ((F.floor(p / 14) + 0.5) * 16 >= b[1]) & ((F.floor(p / 14) + 0.5) * 16 < b[3]))))
    features = g.feature_vector(F.array("b"), "w", "h")
    return d.select("k", F.round(F.col("c.box")[0], 6).alias("x1"), F.round(F.col("c.box")[3], 6).alias("y2"), F.round("c.visible", 6).alias("visible"), g.visibility_group("c.visible").alias("kind"), kept.cast("long").alias("patches"), F.round(features[4], 9).alias("share"))


@query("json_ids", """
SELECT c_custkey AS k, 'cand_' || substr(sha256('["' || c_name || '","' || c_custkey || '"]'), 1, 16) AS candidate, substr(sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}'), 1, 24) AS row_id FROM customer""")
def json_ids(t):
    return t("customer").select(F.col("c_custkey").alias("k"), h.opaque_json("cand", "c_name", "c_custkey").alias("candidate"), h.row_id(["c_custkey", "c_name"]).alias("row_id"))


@query("listwise_losses", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT vec_id, unnest(v) AS a, unnest(list_reverse(v)) AS b, generate_subscripts(v, 1) - 1 AS i FROM e),
y AS (SELECT *, i % 3 <> 2 AS ok FROM x), z AS (SELECT vec_id, ln(sum(exp(a)) FILTER (WHERE ok)) AS la, ln(sum(exp(b)) FILTER (WHERE ok)) AS lb FROM y GROUP BY 1)
SELECT y.vec_id AS vec_id, round(-avg(a - la) FILTER (WHERE ok AND i % 4 = 0), 6) AS loss, round(sum((exp(a - la) - exp(b - lb)) * ((a - la) - (b - lb))) FILTER (WHERE ok) / 2, 6) AS divergence FROM y JOIN z ON y.vec_id = z.vec_id GROUP BY 1""")
def listwise_losses(t):
    n = F.sequence(F.lit(0), F.size("embedding") - 1)
    d = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), F.reverse(F.col("embedding").cast("array<double>")).alias("b"), F.transform(n, lambda i: i % 3 != 2).alias("ok"), F.transform(n, lambda i: i % 4 == 0).alias("y"))
    return d.select("vec_id", F.round(models.listwise_loss("a", "y", "ok"), 6).alias("loss"), F.round(models.symmetric_kl("a", "b", "ok"), 6).alias("divergence"))


@query("built_contexts", """
WITH k AS (SELECT item_id, unnest(['sparse', 'enriched', 'paraphrase', 'saturated']) AS kind, unnest([NULL, 'sparse', 'enriched', 'enriched']) AS ref, unnest([lower(text), text || ' And more.', reverse(text), text]) AS caption FROM benchmark)
SELECT 'ctx_' || substr(sha256(item_id || chr(31) || kind), 1, 16) AS context_id, kind AS context_kind, caption AS initial_caption, CASE WHEN ref IS NOT NULL THEN 'ctx_' || substr(sha256(item_id || chr(31) || ref), 1, 16) END AS reference_context_id FROM k""")
def built_contexts(t):
    d = t("benchmark").select("item_id", F.lower("text").alias("a"), F.concat("text", F.lit(" And more.")).alias("b"), F.reverse("text").alias("c"), F.col("text").alias("d"))
    return views.constructed_contexts(d, "item_id", "a", "b", "c", "d").drop("item_id")


@query("review_packet", """
SELECT 'item_' || substr(sha256('5' || chr(31) || p_partkey || chr(31) || p_brand), 1, 20) AS item_id, p_name AS shown, '' AS verdict, '' AS comment, '' AS notes FROM part""")
def review_packet(t):
    d = t("part").withColumn("shown", F.col("p_name"))
    return views.review_packet(d, 5, ["p_partkey", "p_brand"], ["verdict", "comment"], ["shown"])


@query("resumed_run", """
SELECT c_mktsegment AS segment, count(*) AS done, CAST(sum(length(c_name)) AS BIGINT) AS total, 0 AS pending FROM customer GROUP BY 1""")
def resumed_run(t):
    """Work in three steps, each of what is pending; a run with other settings is refused."""
    work = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    spark, path, schema = work.sparkSession, _at(work, "run"), "c_custkey long, c_mktsegment string, size int"
    mark, limit, left = h.run_fingerprint(model="m", prompt="p"), 400, 1
    while left:
        left = inc.Run(spark, path, mark, schema).step(work, ["c_custkey"], lambda d: d.withColumn("size", F.length("c_name")), limit)
        limit = None if limit is None or limit > 400 else 10**6
    try:
        inc.Run(spark, path, h.run_fingerprint(model="other", prompt="p"), schema)
        raise RuntimeError("another run was let in")
    except ValueError:
        pass
    run = inc.Run(spark, path, mark, schema)
    rest = run.pending(work, ["c_custkey"]).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("pending"))
    d = run.done().groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("done"), F.sum("size").alias("total"))
    return d.join(rest, "segment", "left").select("segment", "done", "total", F.coalesce("pending", F.lit(0)).cast("int").alias("pending"))


@query("cache_reuse", """
SELECT which, n FROM (SELECT 'exact' AS which, count(*) AS n FROM customer UNION ALL SELECT 'short', 0 UNION ALL SELECT 'failed', 0 UNION ALL SELECT 'reparsed', count(*) FILTER (WHERE c_custkey % 3 = 0) FROM customer)""")
def cache_reuse(t):
    """A cache counts only if it has exactly the work's keys and all are ok; stored answers are parsed again without asking."""
    work = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, " supported. ").otherwise("who knows").alias("raw"))
    cache = work.withColumn("status", F.lit("ok"))
    broken = cache.withColumn("status", F.when(F.col("c_custkey") == 5, "failed").otherwise("ok"))
    counts = {"exact": inc.reusable(cache, work, ["c_custkey"]), "short": inc.reusable(cache.where("c_custkey <> 5"), work, ["c_custkey"]), "failed": inc.reusable(broken, work, ["c_custkey"]), "reparsed": inc.reparsed(cache, "raw", lambda c: s.label(c, ["SUPPORTED"])).where("status = 'ok'")}
    parts = [d.agg(F.lit(k).alias("which"), F.count("*").alias("n")) for k, d in counts.items()]
    return rules.every(*parts)


@query("polled_samples", """
SELECT event_type AS run_id, count(*) AS samples, round(sum(value), 4) AS elapsed FROM events GROUP BY 1""")
def polled_samples(t):
    """Samples appended by a stream from a folder that is polled, then their running totals."""
    e = t("events").select(F.col("event_type").alias("run_id"), "value")
    spark, at = e.sparkSession, _at(e, "poll")
    io.write_jsonl(e, f"{at}/in")
    schema = "run_id string, value double"
    inc.append_samples(inc.stream_json(spark, f"{at}/in", schema), f"{at}/out", f"{at}/log").awaitTermination()
    d = inc.running_totals(spark.read.schema(schema).json(f"{at}/out"), ["run_id"], "value")
    return d.select("run_id", "samples", F.round("elapsed", 4).alias("elapsed"))


@query("streamed_upserts", """
SELECT o_custkey AS k, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1""")
def streamed_upserts(t):
    """The last order of each customer, kept by a stream that rewrites the buckets it touches."""
    o = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("last_order"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    spark, at, schema = o.sparkSession, _at(o, "upserts"), "k long, last_order long, at long"
    for n in (0, 1):
        o.where(F.col("last_order") % 2 == n).write.mode("append").json(f"{at}/in")
        inc.upsert_stream(inc.stream_json(spark, f"{at}/in", schema), ["k"], ["at", "last_order"], f"{at}/state", f"{at}/log", buckets=4).awaitTermination()
    return inc.current(spark, f"{at}/state", inc.stream_json(spark, f"{at}/in", schema).schema).select("k", "last_order")
