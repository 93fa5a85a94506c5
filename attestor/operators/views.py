"""Candidate views from detections, and intervention pairs from annotated captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import geometry as g
from attestor.functions import strings as s
from attestor.functions.hashing import opaque, opaque_json


def grid_candidates(images: DataFrame, key: str = "image_id") -> DataFrame:
    """The fixed grids, the whole image and a stop candidate for each image."""
    boxes = F.transform(g.grid("width", "height"), lambda b, i: F.struct(i.cast("string").alias("name"), F.lit("bbox").alias("kind"), F.array(b).alias("boxes")))
    stop = F.array(F.struct(F.lit("stop").alias("name"), F.lit("stop").alias("kind"), F.array().cast("array<array<int>>").alias("boxes")))
    d = images.select(key, F.inline(F.concat(boxes, stop)))
    return d.select(opaque("cand", key, "name").alias("candidate_id"), key, "kind", "boxes", g.total_area("boxes").alias("pixel_cost"))


def suppress(detections: DataFrame, key: str, iou: float = 0.70, most: int = 6) -> DataFrame:
    """Non-maximum suppression within each image: greedy by score, one fold over an image's detections, which are few."""
    names = [c for c in detections.columns if c != key]
    row = F.struct((-F.col("score")).alias("_rank"), F.col("ord").alias("_ord"), F.struct(*names).alias("r"))
    d = detections.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("all"))
    kind = f"array<{detections.select(F.struct(*names).alias('r')).schema['r'].dataType.simpleString()}>"

    def step(kept, x):
        free = F.forall(kept, lambda k: F.coalesce(g.iou(x["box"], k["box"]), F.lit(0.0)) <= iou)
        return F.when((F.size(kept) < most) & free, F.concat(kept, F.array(x))).otherwise(kept)

    d = d.select(key, F.inline(F.aggregate("all", F.array().cast(kind), step)))
    return d.select(*detections.columns)


def evidence_views(images: DataFrame, detections: DataFrame, key: str = "image_id", unions: int = 2, largest: float = 0.85) -> DataFrame:
    """Views of each image: each detection, plain and padded; the unions of its closest pairs; the whole image; stop.

    Columns: candidate_id, key, kind, boxes, view_family, grounding_indices, proposal_score, pixel_cost.
    """
    size = images.select(key, "width", "height")
    d = detections.select(key, "ord", "box", "score").join(size, key)
    families = F.array(F.struct(F.lit("grounded_entity").alias("view_family"), F.col("box").alias("b")), F.struct(F.lit("grounded_entity_padded").alias("view_family"), g.padded("box", "width", "height").alias("b")))
    single = d.select(key, "ord", "score", F.inline(families))
    single = single.select(key, F.lit("bbox").alias("kind"), F.array("b").alias("boxes"), "view_family", F.array("ord").alias("grounding_indices"), F.col("score").alias("proposal_score"))
    each = detections.groupBy(key).agg(F.collect_list(F.struct("ord", "box", "score")).alias("all")).join(size.hint("merge"), key)  # an image's detections, which are few
    few = lambda pairs: F.slice(F.array_sort(pairs), 1, unions)

    def paired(x, y):
        low = F.least(x["score"], y["score"])
        return F.struct(g.center_distance(x["box"], y["box"], F.col("width"), F.col("height")).alias("d"), (-low).alias("s"), x["ord"].alias("i"), y["ord"].alias("j"), g.union(x["box"], y["box"]).alias("b"), low.alias("score"))

    fits = lambda x, y: (x["ord"] < y["ord"]) & (g.area(g.union(x["box"], y["box"])) < largest * F.col("width") * F.col("height"))
    closest = few(F.flatten(F.transform("all", lambda x: few(F.transform(F.filter("all", lambda y: fits(x, y)), lambda y: paired(x, y))))))
    p = each.select(key, F.inline(closest))
    pair = p.select(key, F.lit("bbox").alias("kind"), F.array("b").alias("boxes"), F.lit("relation_union").alias("view_family"), F.array("i", "j").alias("grounding_indices"), F.col("score").alias("proposal_score"))
    none = F.array().cast("array<int>")
    whole = F.struct(F.lit("bbox").alias("kind"), F.array(F.array(F.lit(0), F.lit(0), F.col("width"), F.col("height"))).alias("boxes"), F.lit("full_image").alias("view_family"))
    stop = F.struct(F.lit("stop").alias("kind"), F.array().cast("array<array<int>>").alias("boxes"), F.lit("stop").alias("view_family"))
    fixed = size.select(key, F.inline(F.array(whole, stop))).select(key, "kind", "boxes", "view_family", none.alias("grounding_indices"), F.lit(None).cast("double").alias("proposal_score"))
    out = single.unionByName(pair).unionByName(fixed)
    return out.select(opaque_json("cand", key, "view_family", F.to_json("boxes"), F.to_json("grounding_indices")).alias("candidate_id"), "*", g.total_area("boxes").alias("pixel_cost"))


def constructed_contexts(captions: DataFrame, key: str, sparse: str, enriched: str, paraphrase: str, saturated: str) -> DataFrame:
    """Four contexts for each image, one of each kind, with ids and references."""
    kinds = [("sparse", sparse, None), ("enriched", enriched, "sparse"), ("paraphrase", paraphrase, "enriched"), ("saturated", saturated, "enriched")]
    rows = [F.struct(F.lit(k).alias("context_kind"), F.col(c).alias("initial_caption"), F.lit(r).cast("string").alias("refers")) for k, c, r in kinds]
    d = captions.select(key, F.inline(F.array(*rows)))
    return d.select(opaque("ctx", key, "context_kind").alias("context_id"), key, "context_kind", "initial_caption", F.when(F.col("refers").isNotNull(), opaque("ctx", key, "refers")).alias("reference_context_id"))


def interventions(captions: DataFrame, boxes: DataFrame, most: int = 4) -> DataFrame:
    """Deletion pairs: captions (image_id, caption_index, line) and boxes (image_id, name, boxes).

    A target is a phrase of two or more words, named once in its caption, with
    exactly one box, and with a control phrase whose box does not overlap its
    own.  Each row has the caption with the target deleted, generalised, and in
    full, with the first control deleted, and the first other caption that
    does not mention the target.  Lines and boxes are dealt by image once and
    merged, whatever the planner takes their size to be: a row holds its image's
    captions and boxes.
    """
    tasks = int(captions.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # lines are short and parsing is slow: parts are not put together
    lines = captions.select("image_id", "caption_index", "line").repartition(tasks, "image_id").select("image_id", "caption_index", s.parse_inline("line").alias("p"))
    every = lines.groupBy("image_id").agg(F.collect_list(F.struct("caption_index", "p.text", "p.phrases")).alias("every"))  # an image's captions and boxes, which are few
    single = boxes.where(F.size("boxes") == 1).select("image_id", "name", F.col("boxes")[0].alias("box")).repartition(tasks, "image_id")
    single = single.groupBy("image_id").agg(F.collect_set(F.struct("name", "box")).alias("single"))
    d = every.join(single.hint("merge"), "image_id").select("image_id", "every", "single", F.inline("every"))
    once = lambda ph: F.size(F.filter("phrases", lambda x: x["id"] == ph["id"])) == 1
    placed = lambda ph, k: F.transform(F.filter("single", lambda b: b["name"] == ph["id"]), lambda b: F.struct(k.alias("k"), *[ph[c].alias(c) for c in ("id", "types", "phrase", "start", "stop")], b["box"].alias("box")))
    fit = lambda ph: once(ph) & ~F.array_contains(ph["types"], "notvisual") & (s.word_count(ph["phrase"]) >= 2)
    d = d.select("image_id", "every", "caption_index", "text", F.flatten(F.transform("phrases", lambda ph, k: F.when(fit(ph), placed(ph, k)).otherwise(F.slice(placed(ph, k), 1, 0)))).alias("v"))
    d = d.select("image_id", "every", "caption_index", "text", "v", F.inline("v"))
    apart = lambda q: (q["id"] != F.col("id")) & ~g.overlaps(F.col("box"), q["box"])
    region = lambda q: F.struct(*[q[c].alias(c) for c in ("k", "id", "box", "phrase", "start", "stop")])
    d = d.withColumn("controls", F.array_sort(F.transform(F.filter("v", apart), region))).where(F.size("controls") > 0).drop("v")
    w, c = F.split("text", " "), F.col("controls")[0]
    d = d.withColumns({"tminus": s.delete_words(w, "start", "stop"), "tcontrol": s.delete_words(w, c["start"], c["stop"])})
    d = d.where((s.word_count("tminus") >= 3) & ~s.contains_phrase("tminus", "phrase"))
    put = F.concat_ws(" ", F.nullif(F.array_join(F.slice(w, F.lit(1), F.col("start")), " "), F.lit("")), s.generalise("phrase", "types"), F.nullif(F.array_join(F.slice(w, F.col("stop") + 1, F.greatest(F.size(w) - F.col("stop"), F.lit(0))), " "), F.lit("")))
    d = d.withColumn("tmatched", put)
    other = lambda o: (o["caption_index"] != F.col("caption_index")) & ~F.array_contains(o["phrases"]["id"], F.col("id")) & ~s.contains_phrase(o["text"], F.col("phrase"))
    first = F.array_min(F.transform(F.filter("every", other), lambda o: F.struct(o["caption_index"].alias("i"), o["text"].alias("text"))))
    d = d.withColumn("tnatural", first["text"]).drop("every")
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("image_id").orderBy("caption_index", "k"))).where(F.col("rn") <= most)
    regions = F.concat(F.array(F.struct("id", "box", "phrase")), F.transform("controls", lambda x: F.struct(x["id"].alias("id"), x["box"].alias("box"), x["phrase"].alias("phrase"))))
    return d.select("image_id", "caption_index", "tminus", "tmatched", "tnatural", F.col("text").alias("tplus"), "tcontrol", F.col("phrase").alias("target_phrase"), regions.alias("regions"))


def review_packet(df: DataFrame, seed: int, id_parts: list[str], fields: list[str], shown: list[str]) -> DataFrame:
    """Blinded review rows: an opaque id, what is shown, empty fields to fill in, in hash order."""
    d = df.withColumn("item_id", opaque("item", F.lit(str(seed)), *id_parts, digits=20))
    return d.select("item_id", *shown, *[F.lit("").alias(f) for f in fields], F.lit("").alias("notes")).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "item_id"), 256))
