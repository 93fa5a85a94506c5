"""A bundle of public and gold tables: reading, checking, and the public view."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.geometry import total_area, valid
from attestor.functions.hashing import cache_key, table_fingerprint
from attestor.functions.strings import span_valid, strip
from attestor.operators import derive, metrics, rules
from attestor.session import scratch
from attestor.sources import io, schemas


def read(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables with line numbers, and the violations met in reading them.

    Tables are parsed once and kept as Parquet in the shared folder, as the
    rules read each of them many times.
    """
    tables, bad = {}, []
    for folder, names in (("public", schemas.PUBLIC), ("gold", schemas.GOLD)):
        for name in names:
            rows, problems = io.strict_jsonl(spark, f"{root}/{folder}/{name}.jsonl", schemas.SCHEMAS[name], tuple(schemas.OPTIONAL.get(name, ())))
            path = scratch(spark, name)
            rows.write.parquet(path)
            tables[name] = spark.read.schema(rows.schema).parquet(path)
            bad.append(problems.select(F.lit("form").alias("rule"), F.lit(name).alias("table"), F.col("line").cast("string").alias("key"), F.col("problem").alias("detail")))
    return tables, rules.every(*bad)


def provenance(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{root}/provenance.json", wholetext=True).first()[0])


def _word(c: str):
    return F.length(strip(c)) > 0


def _id(c: str, prefix: str):
    return F.col(c).rlike(rf"^{prefix}_[0-9a-f]{{16,64}}$")


def violations(t: dict[str, DataFrame], source: dict, images_on_disk: DataFrame | None = None) -> DataFrame:
    """Every broken rule of a bundle, each with its table and key.

    ``images_on_disk`` (image_path, sha256) is compared with the images' hashes
    if it is given.
    """
    S = schemas
    images, contexts, candidates, observations = (t[n] for n in S.PUBLIC)
    facts, entities = t["facts"], t["entities"]
    out = [rules.unique(t[n], n, S.KEYS[n]) for n in S.SCHEMAS]
    for n in S.PUBLIC:
        out.append(rules.forbidden_keys(io.clean(t[n]), n, S.FORBIDDEN_KEY_PARTS))
    size = images.select("image_id", "width", "height", "image_sha256")
    out.append(rules.rows(images, "images", ["image_id"], id=_id("image_id", "img"), split=F.col("split").isin(*S.SPLITS), sha256=F.col("image_sha256").rlike("^[0-9a-f]{64}$"), size=(F.col("width") > 0) & (F.col("height") > 0)))
    if images_on_disk is not None:
        d = images.join(images_on_disk, "image_path", "left")
        out.append(rules.rows(d, "images", ["image_id"], file=F.col("sha256").isNotNull(), file_hash=F.col("sha256").isNull() | (F.col("sha256") == F.col("image_sha256"))))
    out += [rules.leaks(images.withColumn("source_image", F.concat_ws("/", "source", "source_image_id")), "images", k) for k in ("duplicate_group_id", "image_sha256", "source_image")]
    out.append(rules.rows(contexts, "contexts", ["context_id"], id=_id("context_id", "ctx"), caption=_word("initial_caption")))
    out.append(rules.references(contexts, "contexts", "image_id", images, "image_id"))
    meta = t["context_metadata"]
    out.append(rules.rows(meta, "context_metadata", ["context_id"], kind=F.col("context_kind").isin(*S.CONTEXT_KINDS), self_reference=~F.col("reference_context_id").eqNullSafe(F.col("context_id"))))
    out.append(rules.same_keys(contexts, meta, "context_metadata", ["context_id"]))
    where = contexts.select("context_id", "image_id")
    ref = meta.where("reference_context_id IS NOT NULL").join(where, "context_id").join(where.select(F.col("context_id").alias("reference_context_id"), F.col("image_id").alias("ref_image")), "reference_context_id", "left")
    out.append(rules.same_parent(ref, "context_metadata", ["context_id"], "image_id", "ref_image"))
    c = candidates.join(size, "image_id", "left")
    stop, none = F.col("kind") == "stop", F.size("boxes") == 0
    out.append(rules.rows(c, "candidates", ["candidate_id"], id=_id("candidate_id", "cand"), image=F.col("width").isNotNull(), kind=F.col("kind").isin(*S.CANDIDATE_KINDS), cost=F.col("pixel_cost") >= 0, stop_is_empty=~stop | (none & (F.col("pixel_cost") == 0)), boxes_given=stop | ~none, boxes=F.forall("boxes", lambda b: valid(b, "width", "height")), cost_is_area=total_area("boxes") == F.col("pixel_cost")))
    o = observations.join(candidates.select("candidate_id", F.col("image_id").alias("c_image"), "kind", "boxes"), "candidate_id", "left").join(size.select("image_id", "image_sha256"), "image_id", "left")
    key = cache_key(image_sha256="image_sha256", kind="kind", boxes="boxes", observer_revision="observer_revision", prompt_hash="prompt_hash")
    quiet = (F.col("status") == "stop") & (F.col("observed_text") == "") & (F.col("output_tokens") == 0)
    out.append(rules.rows(o, "observations", ["observation_id"], id=_id("observation_id", "obs"), same_image=F.col("c_image") == F.col("image_id"), status=F.col("status").isin(*S.OBSERVATION_STATUSES), text=F.col("observed_text").isNotNull(), tokens=F.col("output_tokens") >= 0, latency=F.col("latency_ms") >= 0, prompt=F.col("prompt_hash").rlike("^[0-9a-f]{64}$"), stop=F.when(F.col("kind") == "stop", quiet).otherwise(F.col("status") != "stop"), cache_key=F.col("cache_key") == key))
    out.append(rules.exactly_once(observations, candidates, "observations", "candidate_id"))
    e = entities.join(size, "image_id", "left")
    out.append(rules.rows(e, "entities", ["entity_id"], image=F.col("width").isNotNull(), annotation=F.col("annotation_status").isin("confirmed", "unknown"), category=_word("category"), boxes=F.forall("evidence_regions", lambda b: valid(b, "width", "height"))))
    home = entities.select("entity_id", F.col("image_id").alias("e_image"))
    f = facts.join(home.select(F.col("entity_id").alias("subject_entity_id"), F.col("e_image").alias("s_image")), "subject_entity_id", "left").join(home.select(F.col("entity_id").alias("_o"), F.col("e_image").alias("o_image")), F.col("object.entity_id") == F.col("_o"), "left")
    literal, entity = F.col("object.literal").isNotNull(), F.col("object.entity_id").isNotNull()
    out.append(rules.rows(f, "facts", ["fact_id"], type=F.col("fact_type").isin(*S.FACT_TYPES), support=F.col("visual_support").isin(*S.TRINARY), polarity=F.col("polarity").isin("positive", "negative", "unknown"), predicate=_word("predicate"), subject=F.col("s_image") == F.col("image_id"), one_object=literal != entity, object=~entity | (F.col("o_image") == F.col("image_id")), literal=~literal | _word("object.literal"), relation=(F.col("fact_type") != "relation") | entity))
    active = images.where("split <> 'excluded'").join(facts.select("image_id").distinct(), "image_id", "left_anti")
    out.append(rules.rows(active, "images", ["image_id"], has_facts=F.lit(False)))
    fact_home = facts.select("fact_id", F.col("image_id").alias("f_image"))
    cf = t["context_fact_labels"].join(contexts.select("context_id", F.col("image_id").alias("c_image"), "initial_caption"), "context_id", "left").join(fact_home, "fact_id", "left")
    links = F.col("mention_links")
    out.append(rules.rows(cf, "context_fact_labels", ["context_id", "fact_id"], same_image=F.col("c_image") == F.col("f_image"), status=F.col("status").isin(*S.CONTEXT_STATUSES), votes=rules.vote_pair("annotator_votes", S.CONTEXT_STATUSES), annotators=rules.vote_pair("annotator_ids", distinct=True), canonical=F.col("status") == F.col("adjudication"), resolution=F.forall(links, lambda x: x["resolution"].isin("resolved", "ambiguous", "unknown")), resolved=F.forall(links, lambda x: (x["resolution"] != "resolved") | x["entity_id"].isNotNull()), spans=F.forall(links, lambda x: (F.size(x["span"]) == 2) & span_valid(F.get(x["span"], F.lit(0)), F.get(x["span"], F.lit(1)), F.col("initial_caption")))))
    mentions = cf.select("context_id", "fact_id", "c_image", F.explode("mention_links.entity_id").alias("entity_id")).where("entity_id IS NOT NULL").join(home, "entity_id", "left")
    out.append(rules.same_parent(mentions, "context_fact_labels", ["context_id", "fact_id"], "c_image", "e_image"))
    out.append(rules.cartesian(contexts, facts, t["context_fact_labels"], "context_fact_labels", "image_id", "context_id", "fact_id"))
    kf = t["candidate_fact_labels"].join(candidates.select("candidate_id", F.col("image_id").alias("c_image"), "kind"), "candidate_id", "left").join(fact_home, "fact_id", "left")
    hidden, useless = F.col("visibility") == "none", F.col("sufficient_to_verify") == "no"
    out.append(rules.rows(kf, "candidate_fact_labels", ["candidate_id", "fact_id"], same_image=F.col("c_image") == F.col("f_image"), visibility=F.col("visibility").isin(*S.VISIBILITY), sufficient=F.col("sufficient_to_verify").isin(*S.TRINARY), visibility_votes=rules.vote_pair("visibility_annotator_votes", S.VISIBILITY), canonical_visibility=F.col("visibility") == F.col("visibility_adjudication"), votes=rules.vote_pair("annotator_votes", S.TRINARY), annotators=rules.vote_pair("annotator_ids", distinct=True), canonical=F.col("sufficient_to_verify") == F.col("adjudication"), invisible=~hidden | useless, stop=(F.col("kind") != "stop") | (hidden & useless)))
    out.append(rules.cartesian(candidates, facts, t["candidate_fact_labels"], "candidate_fact_labels", "image_id", "candidate_id", "fact_id"))
    cl = t["observation_claim_labels"].join(observations.select("observation_id", F.col("image_id").alias("o_image"), F.col("status").alias("o_status")), "observation_id", "left").join(fact_home.withColumnRenamed("fact_id", "mapped_fact_id"), "mapped_fact_id", "left")
    out.append(rules.rows(cl, "observation_claim_labels", ["claim_id"], observation=F.col("o_status") == "ok", fact=F.col("mapped_fact_id").isNull() | (F.col("f_image") == F.col("o_image")), status=F.col("status").isin(*S.CLAIM_STATUSES), votes=rules.vote_pair("annotator_votes", S.CLAIM_STATUSES), annotators=rules.vote_pair("annotator_ids", distinct=True), canonical=F.col("status") == F.col("adjudication")))
    out.append(rules.same_rows(io.clean(t["action_labels"]), derive.action_labels(t), "action_labels", ["context_id", "candidate_id"]))
    spark, revision = images.sparkSession, source.get("automatic_candidate_generator_revision")
    broken = [("schema_version", source.get("schema_version") == S.SCHEMA_VERSION), ("generator_revision", bool(revision)), ("near_duplicates", not source.get("unresolved_cross_split_near_duplicates"))]
    out.append(spark.createDataFrame([(r, "provenance", r, None) for r, ok in broken if not ok], rules.SCHEMA))
    out.append(rules.rows(candidates, "candidates", ["candidate_id"], revision=F.col("proposal_generator_revision") == F.lit(revision)))
    out.append(rules.rows(facts.agg(F.count("*").alias("n")), "facts", ["n"], inventory=F.col("n") > 0))
    return rules.every(*out)


def validate(spark: SparkSession, root: str, images_on_disk: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables and all violations; a file that cannot be read raises."""
    t, form = read(spark, root)
    return t, form.unionByName(violations(t, provenance(spark, root), images_on_disk))


def counts(t: dict[str, DataFrame]) -> dict[str, int]:
    return {n: d.count() for n, d in t.items()}


def fingerprint(t: dict[str, DataFrame], names) -> dict[str, str]:
    return {n: table_fingerprint(io.clean(t[n])).first()[0] for n in names}


def selector_state(t: dict[str, DataFrame], context_id: str, history: tuple[str, ...] = ()) -> DataFrame:
    """What a selector may see of one context: image, caption, candidates, and what executed candidates showed.

    Only public tables are joined; a history that repeats a candidate, or names
    one of another image, fails.
    """
    if len(set(history)) != len(history):
        raise ValueError("history repeats an executed candidate")
    c = t["contexts"].where(F.col("context_id") == context_id).select("context_id", "image_id", "initial_caption")
    d = c.join(t["images"].select("image_id", "image_path", "width", "height"), "image_id").join(io.clean(t["candidates"]), "image_id")
    seen = t["observations"].where(F.col("candidate_id").isin(*history)).select("candidate_id", "observed_text", "status") if history else t["observations"].where("false").select("candidate_id", "observed_text", "status")
    d = d.join(seen, "candidate_id", "left")
    known = F.count_if(F.col("candidate_id").isin(*history)) if history else F.lit(0)
    bad = d.agg(known.alias("n")).select(F.when(F.col("n") == len(history), F.lit(True)).otherwise(F.raise_error(F.lit("history contains a candidate of another image")).cast("boolean")).alias("_ok"))
    return d.crossJoin(F.broadcast(bad)).where("_ok").drop("_ok").orderBy("candidate_id")


def vote_rows(t: dict[str, DataFrame]) -> DataFrame:
    """family, image_id, a, b, adjudicated, fact_type: one or two rows for each double-annotated label."""
    kind = t["facts"].select("fact_id", "fact_type")
    where = {"context_fact_labels": (t["contexts"], "context_id"), "candidate_fact_labels": (t["candidates"], "candidate_id"), "observation_claim_labels": (t["observations"], "observation_id")}
    families = [("context_fact_labels", "context_status", "annotator_votes", "adjudication"), ("candidate_fact_labels", "candidate_visibility", "visibility_annotator_votes", "visibility_adjudication"), ("candidate_fact_labels", "candidate_sufficiency", "annotator_votes", "adjudication"), ("observation_claim_labels", "observation_claim_status", "annotator_votes", "adjudication")]
    out = []
    for name, family, votes, final in families:
        parent, key = where[name]
        fact = "mapped_fact_id" if name == "observation_claim_labels" else "fact_id"
        d = t[name].where(F.size(votes) >= 2).select(key, F.col(fact).alias("fact_id"), F.get(votes, F.lit(0)).alias("a"), F.get(votes, F.lit(1)).alias("b"), F.col(final).isNotNull().alias("adjudicated"))
        d = d.join(parent.select(key, "image_id"), key).join(kind, "fact_id", "left")
        out.append(d.select(F.lit(family).alias("family"), "image_id", "a", "b", "adjudicated", F.coalesce("fact_type", F.lit("unmapped")).alias("fact_type")))
    return rules.every(*out)


def agreement(t: dict[str, DataFrame]) -> DataFrame:
    return metrics.agreement(vote_rows(t), "a", "b", "image_id", "adjudicated", [[], ["family"], ["fact_type"]])


def eligible(t: dict[str, DataFrame], images: int = 100, raw: float = 0.90) -> bool:
    """Whether every label family is double-annotated widely and consistently enough, on real images."""
    if t["images"].where("lower(source) LIKE '%synthetic%' OR lower(source) LIKE '%fixture%'").limit(1).count():
        return False
    d = metrics.agreement(vote_rows(t), "a", "b", "image_id", "adjudicated", [["family"]]).collect()
    return len(d) == 4 and all(r.images >= images and r.raw_agreement >= raw and r.adjudication_rate == 1.0 for r in d)
