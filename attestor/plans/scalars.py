"""Queries on scalar functions: text, geometry, vectors, generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import geometry as g
from attestor.functions import numeric as n
from attestor.functions import strings as s
from attestor.functions import vectors as v
from attestor.operators import joins, models, sampling, similarity, views
from attestor.plans.registry import query

#: Words of a text in SQL: lower case, anything but a-z, 0-9 and spaces parts words.
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("phrase_containment", f"""
WITH b AS (SELECT item_id, {NORM.format("text")} AS phrase FROM benchmark), d AS (SELECT doc_id, ' ' || {NORM.format("text")} || ' ' AS t FROM documents)
SELECT item_id, count(*) AS hits, min(doc_id) AS first_doc FROM b JOIN d ON contains(t, ' ' || phrase || ' ') GROUP BY item_id""")
def phrase_containment(t):
    d = joins.phrase_hits(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text")
    return d.groupBy("item_id").agg(F.count("*").alias("hits"), F.min("doc_id").alias("first_doc"))


JAC = "CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) END"


@query("lexical_jaccard_flags", f"""
WITH p AS (SELECT x.conv_id, x.turn, regexp_extract_all(lower(x.text), '[a-z0-9]+') AS a, regexp_extract_all(lower(y.text), '[a-z0-9]+') AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)
SELECT conv_id, turn, round({JAC}, 6) AS jaccard, {JAC} < 0.05 AS low, {JAC} > 0.3 AS high FROM p""")
def lexical_jaccard_flags(t):
    c = t("conversations")
    y = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    d = c.join(y, ["conv_id", "turn"]).withColumn("j", s.lexical_jaccard("text", "other"))
    return d.select("conv_id", "turn", F.round("j", 6).alias("jaccard"), (F.col("j") < 0.05).alias("low"), (F.col("j") > 0.3).alias("high"))


@query("ngram_spans", f"""
WITH w AS (SELECT item_id, string_split({NORM.format("text")}, ' ') AS w FROM benchmark),
n AS (SELECT item_id, w, unnest(range(1, 5)) AS n FROM w), i AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM n),
g AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS span FROM i WHERE len(list_filter(list_slice(w, i, i + n - 1), lambda x: x NOT IN ('the', 'of', 'and', 'a'))) > 0)
SELECT item_id, count(*) AS spans, min(span) AS first_span, max(length(span)) AS longest FROM g GROUP BY item_id""")
def ngram_spans(t):
    d = t("benchmark").select("item_id", s.norm_words("text").alias("w"))
    d = d.select("item_id", F.explode(s.ngrams("w", 4, ("the", "of", "and", "a"))).alias("span"))
    return d.groupBy("item_id").agg(F.count("*").alias("spans"), F.min("span").alias("first_span"), F.max(F.length("span")).alias("longest"))


@query("label_normaliser", r"""
SELECT o_orderpriority AS raw, CASE WHEN replace(trim(upper(trim(o_orderpriority)), '.:-'), ' ', '_') IN ('1-URGENT', '5-LOW', '4-NOT_SPECIFIED') THEN replace(trim(upper(trim(o_orderpriority)), '.:-'), ' ', '_') END AS label,
CASE WHEN len(list_distinct(regexp_extract_all(upper(o_orderpriority), '\b(HIGH|LOW|MEDIUM)\b', 1))) = 1 THEN regexp_extract(upper(o_orderpriority), '\b(HIGH|LOW|MEDIUM)\b', 1) END AS only_label,
CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'B' END AS code, CASE WHEN length(o_orderstatus) = 1 AND CAST(substr(o_orderpriority, 1, 1) AS INTEGER) < 4 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) ELSE -1 END AS choice, count(*) AS n
FROM orders GROUP BY ALL""")
def label_normaliser(t):
    p = F.col("o_orderpriority")
    d = t("orders").select(
        p.alias("raw"), s.label(p, ["1-URGENT", "5-LOW", "4-NOT_SPECIFIED"]).alias("label"), s.only_label(p, ["HIGH", "LOW", "MEDIUM"]).alias("only_label"),
        s.coded_label(p, {"1": "A", "2": "B"}).alias("code"), s.choice(F.concat(F.lit(" choice= "), F.substring(p, 1, 1)), F.lit(4), F.lit(3)).alias("choice"),
    )
    return d.groupBy("raw", "label", "only_label", "code", "choice").agg(F.count("*").alias("n"))


CELL = "(round_even((c + 1) * w / cs, 0) - round_even(c * w / cs, 0)) * (round_even((r + 1) * h / rs, 0) - round_even(r * h / rs, 0))"


@query("grid_generator", f"""
WITH p AS (SELECT p_partkey AS image_id, p_size * 7 AS w, p_size * 5 + 3 AS h FROM part), k AS (SELECT * FROM (VALUES (3, 3), (1, 2), (2, 1)) v(rs, cs)),
c AS (SELECT image_id, w, h, rs, cs, unnest(range(0, rs)) AS r, cs AS cc FROM p, k), x AS (SELECT image_id, w, h, rs, cs, r, unnest(range(0, cs)) AS c FROM c),
a AS (SELECT image_id, CAST({CELL} AS BIGINT) AS area FROM x UNION ALL SELECT image_id, w * h FROM p UNION ALL SELECT image_id, 0 FROM p)
SELECT image_id, count(*) AS candidates, CAST(sum(area) AS BIGINT) AS total_cost, CAST(max(area) AS BIGINT) AS largest FROM a GROUP BY image_id""")
def grid_generator(t):
    images = t("part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 7).alias("width"), (F.col("p_size") * 5 + 3).alias("height"))
    d = views.grid_candidates(images)
    return d.groupBy("image_id").agg(F.count("*").alias("candidates"), F.sum("pixel_cost").alias("total_cost"), F.max("pixel_cost").alias("largest"))


@query("box_geometry", """
WITH p AS (SELECT p_partkey AS k, p_size AS x1, p_size % 7 AS y1, p_size + 10 AS x2, p_size % 7 + 8 AS y2, s_suppkey AS j, s_suppkey % 11 AS u1, s_suppkey % 5 AS v1, s_suppkey % 11 + 30 AS u2, s_suppkey % 5 + 9 AS v2 FROM part JOIN supplier ON p_partkey % 100 + 1 = s_suppkey),
g AS (SELECT *, greatest(least(x2, u2) - greatest(x1, u1), 0) * greatest(least(y2, v2) - greatest(y1, v1), 0) AS i, (x2 - x1) * (y2 - y1) AS a, (u2 - u1) * (v2 - v1) AS b FROM p)
SELECT k AS partkey, j AS suppkey, CAST(a AS BIGINT) AS area, i > 0 AS overlap, round(i / (a + b - i), 6) AS iou, CAST((greatest(x2, u2) - least(x1, u1)) * (greatest(y2, v2) - least(y1, v1)) AS BIGINT) AS union_area,
round(sqrt(pow(((x1 + x2) - (u1 + u2)) / 2 / 100, 2) + pow(((y1 + y2) - (v1 + v2)) / 2 / 50, 2)), 6) AS distance, round(-(pow((x1 + x2) * 0.5 - 50, 2) + pow((y1 + y2) * 0.5 - 25, 2)), 6) AS center_score,
CAST(greatest(floor(x1 - 10 * 0.15), 0) AS INTEGER) AS padded_left FROM g""")
def box_geometry(t):
    c = F.col
    p = t("part").select(c("p_partkey").alias("partkey"), F.array(c("p_size"), c("p_size") % 7, c("p_size") + 10, c("p_size") % 7 + 8).alias("a"))
    b = t("supplier").select(c("s_suppkey").alias("suppkey"), F.array(*[x.cast("int") for x in (c("s_suppkey") % 11, c("s_suppkey") % 5, c("s_suppkey") % 11 + 30, c("s_suppkey") % 5 + 9)]).alias("b"))
    d = p.join(b, c("partkey") % 100 + 1 == c("suppkey"))
    w, h = F.lit(100), F.lit(50)
    return d.select(
        "partkey", "suppkey", g.area("a").cast("long").alias("area"), g.overlaps("a", "b").alias("overlap"), F.round(g.iou("a", "b"), 6).alias("iou"), g.area(g.union("a", "b")).cast("long").alias("union_area"),
        F.round(g.center_distance("a", "b", w, h), 6).alias("distance"), F.round(g.center_score(F.array("a"), w, h), 6).alias("center_score"), g.padded("a", w, h)[0].alias("padded_left"),
    )


@query("inverse_cosine_scores", """
WITH q AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label)
SELECT vec_id, round(0.5 * (1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))), 6) AS score FROM embeddings JOIN q USING (label)""")
def inverse_cosine_scores(t):
    e = t("embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return e.join(q, "label").select("vec_id", F.round(v.inverse_cosine("embedding", "q"), 6).alias("score"))


@query("mean_feature_renormalise", """
WITH x AS (SELECT label, unnest(range(1, 65)) AS d, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, d, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
SELECT label, d, round(m / n, 6) AS value FROM m JOIN n USING (label)""")
def mean_feature_renormalise(t):
    """One aggregate with a mean for each place: vectors are never taken apart into rows before the shuffle."""
    m = t("embeddings").groupBy("label").agg(F.array(*v.mean_components("embedding", 64)).alias("m"))
    d = m.select("label", F.posexplode(v.unit("m")).alias("d", "value"))
    return d.select("label", (F.col("d") + 1).cast("long").alias("d"), F.round("value", 6).alias("value"))


@query("probability_argmax", """
SELECT 'c' || lpad(CAST(list_position(embedding, list_max(embedding)) - 1 AS VARCHAR), 2, '0') AS label, count(*) AS n, max(vec_id) AS last_id FROM embeddings GROUP BY 1""")
def probability_argmax(t):
    names = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.concat(F.lit("c"), F.lpad(i.cast("string"), 2, "0")))
    m = F.map_from_arrays(names, F.col("embedding"))
    return t("embeddings").groupBy(v.top_label(m).alias("label")).agg(F.count("*").alias("n"), F.max("vec_id").alias("last_id"))


@query("ridge_closed_form", """
WITH x AS (SELECT p_partkey AS k, p_size * 1.0::DOUBLE AS a, p_retailprice AS b, (p_partkey % 97) * 1.0::DOUBLE AS y FROM part),
m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, greatest(stddev_samp(a), 1e-6) AS sa, greatest(stddev_samp(b), 1e-6) AS sb, sum(y) AS sy FROM x),
z AS (SELECT k, y, (a - ma) / sa AS a, (b - mb) / sb AS b, n, sy FROM x, m),
c AS (SELECT sum(a * a) + 10 AS aa, sum(a * b) AS ab, sum(b * b) + 10 AS bb, sum(a * y) AS ay, sum(b * y) AS by_, max(sy / (n + 10)) AS bias FROM z)
SELECT k, round(bias + a * (ay * bb - by_ * ab) / (aa * bb - ab * ab) + b * (by_ * aa - ay * ab) / (aa * bb - ab * ab), 6) AS score FROM z, c""")
def ridge_closed_form(t):
    """Ridge on two features, whose normal equations have a closed form."""
    d = t("part").select(F.col("p_partkey").alias("k"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"))
    model = models.ridge(d, "x", "y", 2, 10.0)
    return d.select("k", F.round(models.ridge_score("x", model), 6).alias("score"))


@query("ridge_scores")
def ridge_scores(t):
    """Ridge of label on the embedding, fitted on the train split, for every row; tests compare it with numpy."""
    from attestor.functions.hashing import split_60_20_20

    e = t("embeddings").withColumn("split", split_60_20_20("vec_id", "ridge"))
    model = models.ridge(e.where("split = 'train'"), "embedding", "label", 64, 10.0)
    return e.select("vec_id", "split", F.round(models.ridge_score("embedding", model), 6).alias("score"))


@query("explode_positions", "SELECT d, count(*) AS n, round(sum(x), 4) AS total FROM (SELECT unnest(range(0, 64)) AS d, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY d")
def explode_positions(t):
    d = t("embeddings").select(F.posexplode("embedding").alias("d", "x"))
    return d.groupBy(F.col("d").cast("long").alias("d")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("x").cast("double")), 4).alias("total"))


@query("wide_to_long", """
SELECT kind, value, count(*) AS n FROM (SELECT 'status' AS kind, o_orderstatus AS value FROM orders UNION ALL SELECT 'priority', o_orderpriority FROM orders UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders) GROUP BY 1, 2""")
def wide_to_long(t):
    d = t("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("string").alias("year"))
    return d.unpivot([], ["status", "priority", "year"], "kind", "value").groupBy("kind", "value").agg(F.count("*").alias("n"))


@query("eligibility_default_fill", """
SELECT lang, CASE WHEN quality = 1 AND length(trim(text)) > 0 AND n_chars > 300 THEN CASE WHEN toxic = 1 THEN 'CONTRADICTED' ELSE 'SUPPORTED' END ELSE 'NOT_NEW' END AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def eligibility_default_fill(t):
    d = joins.asserted(t("labels"), t("documents").select("doc_id", "lang", "text", "n_chars"), ["doc_id"], "documents")
    ok = (F.col("quality") == 1) & (F.length(s.strip("text")) > 0) & (F.col("n_chars") > 300)
    label = F.when(~ok, "NOT_NEW").otherwise(F.when(F.col("toxic") == 1, "CONTRADICTED").otherwise("SUPPORTED"))
    return d.groupBy("lang", label.alias("label")).agg(F.count("*").alias("n"))


@query("format_flags", r"""
WITH w AS (SELECT lang, text, n_chars, len(list_filter(string_split_regex(text, '[ \t\n\r\v\f]+'), lambda x: x <> '')) AS n FROM documents)
SELECT lang, count(*) FILTER (WHERE n > 300) AS over_limit, count(*) FILTER (WHERE n = 0) AS empty_n, count(*) FILTER (WHERE n_chars >= 5000) AS capped, CAST(max(n) AS BIGINT) AS most_words,
count(*) FILTER (WHERE lower(text) = text) AS lower_n FROM w GROUP BY lang""")
def format_flags(t):
    d = t("documents").select("lang", "text", "n_chars", s.word_count("text").alias("n"))
    return d.groupBy("lang").agg(F.count_if(F.col("n") > 300).alias("over_limit"), F.count_if(F.col("n") == 0).alias("empty_n"), F.count_if(F.col("n_chars") >= 5000).alias("capped"), F.max("n").cast("long").alias("most_words"), F.count_if(F.lower("text") == F.col("text")).alias("lower_n"))


@query("query_concat", r"""
SELECT conv_id, length(string_agg(rtrim(regexp_replace(trim(text, E' \t\n\r'), '[.\s]+$', '')), ' . ' ORDER BY text) || ' .') AS query_length, 'c:' || conv_id || ':' || count(*) AS key, bool_and(length(text) >= 5) AS span_ok,
'Turns: ' || count(*) || '; roles: ' || count(DISTINCT role) AS prompt FROM conversations GROUP BY conv_id""")
def query_concat(t):
    d = t("conversations").groupBy("conv_id").agg(F.collect_list("text").alias("texts"), F.count("*").alias("n"), F.count_distinct("role").alias("roles"), F.bool_and(s.span_valid(F.lit(0), F.lit(5), "text")).alias("span_ok"))
    return d.select("conv_id", F.length(s.joined_query("texts")).cast("long").alias("query_length"), F.concat_ws(":", F.lit("c"), F.col("conv_id").cast("string"), F.col("n").cast("string")).alias("key"), "span_ok", F.format_string("Turns: %d; roles: %d", "n", "roles").alias("prompt"))


@query("sentinel_defaults", """
WITH x AS (SELECT doc_id, lang, CASE WHEN doc_id % 9 = 0 THEN ' no_new_fact ' WHEN doc_id % 9 = 1 THEN 'NO_VISIBLE_FACT' ELSE text END AS t FROM documents),
c AS (SELECT conv_id, min(text) AS prior FROM conversations WHERE turn = 0 GROUP BY 1)
SELECT lang, count(*) FILTER (WHERE upper(trim(t)) IN ('NO_NEW_FACT', 'NO_VISIBLE_FACT')) AS trimmed, count(*) FILTER (WHERE t IN ('NO_NEW_FACT', 'NO_VISIBLE_FACT')) AS exact_n,
CAST(sum(length(t || coalesce(' First: ' || prior, ''))) AS BIGINT) AS premise_chars FROM x LEFT JOIN c ON conv_id = doc_id GROUP BY lang""")
def sentinel_defaults(t):
    words = ["NO_NEW_FACT", "NO_VISIBLE_FACT"]
    k = F.col("doc_id") % 9
    x = t("documents").select("doc_id", "lang", F.when(k == 0, " no_new_fact ").when(k == 1, "NO_VISIBLE_FACT").otherwise(F.col("text")).alias("t"))
    c = t("conversations").where("turn = 0").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("text").alias("prior"))
    d = x.join(c, "doc_id", "left")
    return d.groupBy("lang").agg(F.count_if(s.is_sentinel("t", words)).alias("trimmed"), F.count_if(s.is_sentinel("t", words, exact=True)).alias("exact_n"), F.sum(F.length(s.with_prior("t", "prior", " First: "))).alias("premise_chars"))


@query("area_fraction_support", """
WITH s AS (SELECT p_brand AS brand, p_size AS size, max(p_size) OVER (PARTITION BY p_brand) AS whole, l_returnflag = 'R' AS hit, l_linestatus = 'F' AS truth FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT brand, count(*) FILTER (WHERE size < whole) AS smaller, count(*) FILTER (WHERE size * 4 <= whole) AS quarter, round(avg(CASE WHEN truth AND size * 4 <= whole THEN CAST(hit AS INTEGER) END), 6) AS recall, round(avg(CASE WHEN NOT truth AND size * 4 <= whole THEN CAST(hit AS INTEGER) END), 6) AS false_support FROM s GROUP BY brand""")
def area_fraction_support(t):
    part = t("part")
    whole = t("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    most = whole.groupBy("p_brand").agg(F.max("p_size").alias("whole"))
    d = whole.join(most, "p_brand")
    small, truth, hit = F.col("p_size") * 4 <= F.col("whole"), F.col("l_linestatus") == "F", (F.col("l_returnflag") == "R").cast("int")
    return d.groupBy(F.col("p_brand").alias("brand")).agg(F.count_if(F.col("p_size") < F.col("whole")).alias("smaller"), F.count_if(small).alias("quarter"), F.round(F.avg(F.when(truth & small, hit)), 6).alias("recall"), F.round(F.avg(F.when(~truth & small, hit)), 6).alias("false_support"))


@query("span_max_similarity", """
WITH q AS (SELECT vec_id, label, embedding AS q FROM embeddings WHERE vec_id % 20 = 0)
SELECT q.vec_id AS query_id, round(max(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS best FROM q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id GROUP BY 1""")
def span_max_similarity(t):
    """The stated queries against all rows of their label."""
    e = t("embeddings")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return similarity.best_cosine(q, e, "label", "query_id", "vec_id", "embedding").select("query_id", F.round("best", 6).alias("best"))


@query("interaction_features", """
WITH q AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label)
SELECT vec_id, 64 + 10 AS width, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), lambda z: z[1] * z[2])), 6) AS total, label AS hot FROM embeddings JOIN q USING (label)""")
def interaction_features(t):
    e = t("embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    x = F.concat(v.product("embedding", "q"), g.one_hot("label", list(range(10))))
    d = e.join(q, "label").select("vec_id", "label", x.alias("x"))
    total = F.aggregate(F.slice("x", 1, 64), F.lit(0.0), lambda a, y: a + y)
    return d.select("vec_id", F.size("x").alias("width"), F.round(total, 6).alias("total"), (F.array_position(F.slice("x", 65, 10), F.lit(1.0)) - 1).cast("int").alias("hot"))


@query("symmetric_margin", """
WITH x AS (SELECT vec_id, (list_sum(list_transform(embedding[1:32], lambda y: y::DOUBLE)) - list_sum(list_transform(embedding[33:64], lambda y: y::DOUBLE))) / 2 AS m FROM embeddings)
SELECT vec_id, round(m, 6) AS margin, CASE WHEN m >= 0 THEN 'ambiguous' ELSE 'unambiguous' END AS label FROM x""")
def symmetric_margin(t):
    """Margins of both halves of each vector as those of two code orders."""
    half = lambda k: F.aggregate(F.slice("embedding", k, 32), F.lit(0.0), lambda a, x: a + x.cast("double"))
    m = v.symmetric_margin(half(1), half(33))
    return t("embeddings").select("vec_id", F.round(m, 6).alias("margin"), F.when(m >= 0, "ambiguous").otherwise("unambiguous").alias("label"))


@query("masked_similarity_drop", """
WITH q AS (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS q FROM embeddings GROUP BY label),
x AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS whole, list_cosine_similarity(list_concat(list_transform(range(0, 16), lambda i: 0.0::DOUBLE), CAST(embedding[17:64] AS DOUBLE[])), q) AS masked FROM embeddings JOIN q USING (label))
SELECT vec_id, round(whole - masked, 6) AS drop_value FROM x""")
def masked_similarity_drop(t):
    e = t("embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    masked = F.transform("embedding", lambda x, i: F.when(i < 16, 0.0).otherwise(x.cast("double")))
    return e.join(q, "label").select("vec_id", F.round(v.cosine("embedding", "q") - v.cosine(masked, "q"), 6).alias("drop_value"))


@query("hash_split_counts", """
SELECT split, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, CASE WHEN m < 6 THEN 'train' WHEN m < 8 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, ((list_sum(list_transform(range(1, 64), lambda i: CAST(instr('0123456789abcdef', substr(sha256('s:' || CAST(doc_id AS VARCHAR)), i, 1)) - 1 AS BIGINT))) * 6 + instr('0123456789abcdef', substr(sha256('s:' || CAST(doc_id AS VARCHAR)), 64, 1)) - 1) % 10) AS m FROM documents)) GROUP BY split""")
def hash_split_counts(t):
    from attestor.functions.hashing import split_60_20_20

    return t("documents").groupBy(split_60_20_20("doc_id", "s").alias("split")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("opaque_ids", """
SELECT c_nationkey AS nation, min('cust_' || substr(sha256(CAST(c_nationkey AS VARCHAR) || chr(31) || CAST(c_custkey AS VARCHAR)), 1, 16)) AS first_id, max(sha256('{"key":' || c_custkey || ',"segment":"' || c_mktsegment || '"}')) AS last_key FROM customer GROUP BY 1""")
def opaque_ids(t):
    from attestor.functions import hashing as h

    d = t("customer").select("c_nationkey", h.opaque("cust", "c_nationkey", "c_custkey").alias("o"), h.cache_key(key="c_custkey", segment="c_mktsegment").alias("k"))
    return d.groupBy(F.col("c_nationkey").alias("nation")).agg(F.min("o").alias("first_id"), F.max("k").alias("last_key"))


@query("finite_mean_policy", """
WITH x AS (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN 'nan'::DOUBLE WHEN event_id % 11 = 2 THEN 'inf'::DOUBLE ELSE value END AS v, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS d FROM events)
SELECT event_type, round(avg(CASE WHEN isfinite(v) THEN v END), 6) AS mean, CASE WHEN sum(d) = 0 THEN NULL ELSE round(sum(CASE WHEN isfinite(v) THEN 1 ELSE 0 END) / sum(d), 6) END AS rate_or_null, CASE WHEN sum(d) = 0 THEN 0.0 ELSE round(sum(CASE WHEN isfinite(v) THEN 1 ELSE 0 END) / sum(d), 6) END AS rate_or_zero FROM x GROUP BY event_type""")
def finite_mean_policy(t):
    k = F.col("event_id") % 11
    x = t("events").select("event_type", F.when(k == 0, None).when(k == 1, float("nan")).when(k == 2, float("inf")).otherwise(F.col("value")).alias("v"), F.when(F.col("event_type") == "click", 0).otherwise(1).alias("d"))
    good = F.count(n.finite("v"))
    return x.groupBy("event_type").agg(F.round(n.finite_mean("v"), 6).alias("mean"), F.round(n.ratio(good, F.sum("d")), 6).alias("rate_or_null"), F.round(n.ratio_or_zero(good, F.sum("d")), 6).alias("rate_or_zero"))


@query("ordered_distinct", "SELECT role, min(conv_id * 1000 + turn) AS first_place, count(*) AS n FROM conversations GROUP BY role")
def ordered_distinct(t):
    c = t("conversations").withColumn("o", F.col("conv_id") * 1000 + F.col("turn"))
    return sampling.ordered_distinct(c, "role", "o").withColumnRenamed("first", "first_place").join(c.groupBy("role").agg(F.count("*").alias("n")), "role")
