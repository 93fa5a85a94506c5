"""Agreement, confusion, rank, set and macro-average metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.numeric import col, finite_mean, jaccard, kappa, ratio, ratio_or_zero


def macro_mean(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Mean of means: over rows within the last level, then level by level; one row (value, groups).

    Null and non-finite values count nowhere, as does a group without a value.
    """
    d = df.groupBy(*levels).agg(finite_mean(value).alias("v")).where("v IS NOT NULL")
    for k in range(len(levels) - 1, 0, -1):
        d = d.groupBy(*levels[:k]).agg(F.avg("v").alias("v"))
    return d.agg(F.avg("v").alias("value"), F.count("*").alias("groups"))


def paired_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and difference of two methods' finite values, joined by key, never by position."""
    a, b = left.select(*keys, F.col(value).alias("_l")), right.select(*keys, F.col(value).alias("_r"))
    d = a.join(b, keys).withColumn("difference", F.col("_l") - F.col("_r"))
    return d.where("difference IS NOT NULL AND NOT isnan(difference) AND abs(difference) < double('infinity')").drop("_l", "_r")


def agreement(votes: DataFrame, a: str, b: str, image: str | None = None, adjudicated: str | None = None, sets: list[list[str]] | None = None) -> DataFrame:
    """Rows, images, raw agreement, Cohen's kappa and adjudication rate; one row for each grouping in ``sets``.

    Votes are counted by label pair first, so the marginals come from a table
    of at most labels squared rows in each group.
    """
    sets = sets or [[]]
    columns = sorted({c for s in sets for c in s})
    # two aggregates over the votes; every grouping starts from these, whose shuffles are reused
    counts = votes.groupBy(*columns, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("n"), *([F.sum(F.col(adjudicated).cast("int")).alias("adj")] if adjudicated else []))
    seen = votes.groupBy(*columns, F.col(image).alias("_image")).agg(F.count("*").alias("_n")) if image else None
    out = None
    for s in sets:
        d = counts.groupBy(*s, "_a", "_b").agg(F.sum("n").alias("n"), *([F.sum("adj").alias("adj")] if adjudicated else []))
        total = d.groupBy(*s).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("n")).otherwise(0)).alias("same"), *([F.sum("adj").alias("adj")] if adjudicated else []))
        left = d.groupBy(*s, F.col("_a").alias("label")).agg(F.sum("n").alias("l"))
        right = d.groupBy(*s, F.col("_b").alias("label")).agg(F.sum("n").alias("r"))
        chance = left.join(right, [*s, "label"]).groupBy(*s).agg(F.sum(F.col("l") * F.col("r")).alias("c"))
        t = total.join(chance, s, "left") if s else total.crossJoin(chance)
        if image:
            im = seen.groupBy(*s).agg(F.count_distinct("_image").alias("images"))
            t = t.join(im, s) if s else t.crossJoin(im)
        raw, by_chance = F.col("same") / F.col("rows"), F.coalesce("c", F.lit(0)) / (F.col("rows") * F.col("rows"))
        t = t.select(
            *[F.col(c).alias(c) if c in s else F.lit(None).cast("string").alias(c) for c in columns],
            F.col("rows"),
            *([F.col("images")] if image else []),
            raw.alias("raw_agreement"),
            kappa(raw, by_chance).alias("kappa"),
            *([ratio("adj", "rows").alias("adjudication_rate")] if adjudicated else []),
        )
        out = t if out is None else out.unionByName(t)
    return out


def confusion(df: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    """truth, predicted, n for every pair of labels, 0 where there is none."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[truth]
    one = spark.createDataFrame([(x,) for x in labels], f"truth {kind}")
    grid = one.crossJoin(F.broadcast(one.withColumnRenamed("truth", "predicted")))
    n = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(n, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def f1_columns(tp, fp, fn) -> dict[str, Column]:
    """Precision, recall and F1; 0 where a denominator is 0."""
    p, r = ratio_or_zero(tp, col(tp) + col(fp)), ratio_or_zero(tp, col(tp) + col(fn))
    return {"precision": p, "recall": r, "f1": ratio_or_zero(2 * p * r, p + r)}


def classification(df: DataFrame, truth: str, predicted: str, positive) -> DataFrame:
    """n, accuracy, balanced accuracy over the labels that occur, precision, recall and F1 of one label."""
    t, p = F.col(truth), F.col(predicted)
    total = df.agg(
        F.count("*").alias("n"),
        F.avg((t == p).cast("int")).alias("accuracy"),
        F.count_if((t == positive) & (p == positive)).alias("tp"),
        F.count_if((t != positive) & (p == positive)).alias("fp"),
        F.count_if((t == positive) & (p != positive)).alias("fn"),
    )
    balanced = df.groupBy(truth).agg(F.avg((t == p).cast("int")).alias("recall")).agg(F.avg("recall").alias("balanced_accuracy"))
    return total.withColumns(f1_columns("tp", "fp", "fn")).drop("tp", "fp", "fn").crossJoin(balanced)


def pair_accuracy(df: DataFrame, pair: str, positive: Column, score: str) -> DataFrame:
    """Pairs of one positive and one negative: both signs right, and the positive ranked above (a tie counts half)."""
    d = df.groupBy(pair).agg(F.max(F.when(positive, F.col(score))).alias("p"), F.max(F.when(~positive, F.col(score))).alias("q")).where("p IS NOT NULL AND q IS NOT NULL")
    return d.agg(
        F.count("*").alias("pairs"),
        F.avg(((F.col("p") >= 0) & (F.col("q") < 0)).cast("int")).alias("pair_accuracy"),
        F.avg(F.when(F.col("p") > F.col("q"), 1.0).when(F.col("p") == F.col("q"), 0.5).otherwise(0.0)).alias("pair_ranking_accuracy"),
    )


def epsilon_top(df: DataFrame, group: list[str], score: str, epsilon: float = 0.01) -> DataFrame:
    """Rows within epsilon of their group's best score."""
    return df.withColumn("_top", F.max(score).over(Window.partitionBy(*group))).where(F.col("_top") - F.col(score) <= epsilon).drop("_top")


def necessity(df: DataFrame, parent: str, group: str, id_: str, score: str) -> DataFrame:
    """For each parent the mean of its groups' best scores, the best mean of one candidate, and the gap.

    Every group of a parent must have the same candidates; ``complete`` says so.
    """
    best = df.groupBy(parent, group).agg(F.max(score).alias("m"), F.count_distinct(id_).alias("k")).groupBy(parent).agg(F.avg("m").alias("adaptive"), F.count("*").alias("groups"), F.min("k").alias("k0"), F.max("k").alias("k1"))
    static = df.groupBy(parent, id_).agg(F.avg(score).alias("a"), F.count("*").alias("n")).groupBy(parent).agg(F.max("a").alias("static"), F.min("n").alias("n0"))
    d = best.join(static, parent)
    return d.select(parent, "adaptive", "static", (F.col("adaptive") - F.col("static")).alias("gap"), ((F.col("k0") == F.col("k1")) & (F.col("n0") == F.col("groups"))).alias("complete"))


def switches(pairs: DataFrame, id_: str, left: str, right: str, keys: list[str], epsilon: float = 0.01, loss: float = 0.05) -> DataFrame:
    """For each pair of contexts, from rows of one candidate with both scores: regret of the left's choice on the right, whether the tops are apart, and whether the switch is material.

    pair_regret takes the worst of the left's tied best; a switch takes the best.
    """
    w = Window.partitionBy(*keys)
    d = pairs.withColumns({"_ml": F.max(left).over(w), "_mr": F.max(right).over(w)})
    tl, tr = F.col("_ml") - F.col(left) <= epsilon, F.col("_mr") - F.col(right) <= epsilon
    d = d.groupBy(*keys).agg(
        (F.max("_mr") - F.min(F.when(tl, F.col(right)))).alias("pair_regret"),
        (~F.bool_or(tl & tr)).alias("apart"),
        F.greatest(F.max("_mr") - F.max(F.when(tl, F.col(right))), F.max("_ml") - F.max(F.when(tr, F.col(left)))).alias("_loss"),
    )
    return d.withColumn("material", F.col("apart") & (F.col("_loss") >= loss)).drop("_loss")


def success_sets(df: DataFrame, group: list[str], id_: str, success: Column) -> DataFrame:
    return df.groupBy(*group).agg(F.array_sort(F.collect_set(F.when(success, F.col(id_)))).alias("members"))


def set_change(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean Jaccard of two set columns and the share of pairs that differ."""
    return pairs.agg(F.avg(jaccard(a, b)).alias("jaccard"), F.avg((F.col(a) != F.col(b)).cast("int")).alias("change_rate"), F.count("*").alias("pairs"))


def intervention(df: DataFrame, keys: list[str], position: str, score: Column | str, tolerance: float = 1e-8) -> DataFrame:
    """For each list whose target is at position 0: rank with expected ties, target value, drift and contrast of the others."""
    from attestor.functions.numeric import expected_reciprocal_rank, expected_top1

    w = Window.partitionBy(*keys)
    d = df.withColumn("_s", col(score)).withColumn("_t", F.max(F.when(F.col(position) == 0, F.col("_s"))).over(w))
    others = F.when(F.col(position) > 0, F.col("_s"))
    d = d.groupBy(*keys).agg(
        F.max("_t").alias("target"),
        F.count_if(F.col("_s") > F.col("_t") + tolerance).alias("higher"),
        F.count_if(F.abs(F.col("_s") - F.col("_t")) <= tolerance).alias("tied"),
        F.avg(F.abs(others)).alias("drift"),
        (F.max("_t") - F.avg(others)).alias("contrast"),
        F.avg(F.abs("_s")).alias("scale"),
    )
    return d.withColumns({"acc1": expected_top1("higher", "tied"), "mrr": expected_reciprocal_rank("higher", "tied"), "positive": (F.col("target") > 0).cast("int")})


def resolved_vote(left, right, adjudication) -> Column:
    """The vote both gave, else the adjudication; null if a vote is not one of yes, no, uncertain, or a needed adjudication is missing."""
    words = ("yes", "no", "uncertain")
    a, b, c = (F.lower(F.btrim(col(x), F.lit(" \t\n\r"))) for x in (left, right, adjudication))
    return F.when(~a.isin(*words) | ~b.isin(*words), None).when(a == b, a).when(c.isin(*words), c)


def action_target(votes) -> Column:
    """negative if a component is no, positive if all three are yes, else unknown; null unless there are three valid ones."""
    v = col(votes)
    ok = (F.size(v) == 3) & F.forall(v, lambda x: F.coalesce(x.isin("yes", "no", "uncertain"), F.lit(False)))
    return F.when(~ok, None).when(F.array_contains(v, "no"), "negative").when(F.forall(v, lambda x: x == "yes"), "positive").otherwise("unknown")


def field_agreement(sheets: DataFrame, fields: list[str]) -> DataFrame:
    """field, compared, agreed, disagreed, rate from two review sheets joined on item (columns a_ and b_); blanks are not compared."""
    one = [F.struct(F.lit(f).alias("field"), F.lower(F.btrim("a_" + f)).alias("a"), F.lower(F.btrim("b_" + f)).alias("b")) for f in fields]
    d = sheets.select(F.inline(F.array(*one))).where("a <> '' AND b <> ''")
    d = d.groupBy("field").agg(F.count("*").alias("compared"), F.count_if(F.col("a") == F.col("b")).alias("agreed"))
    return d.select("field", "compared", "agreed", (F.col("compared") - F.col("agreed")).alias("disagreed"), ratio("agreed", "compared").alias("rate"))


def most_common(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def unique_match(df: DataFrame, column: str, part: str) -> DataFrame:
    """The one distinct value that contains a part; the query fails if there is none or several."""
    d = df.where(F.contains(F.lower(column), F.lit(part.lower()))).agg(F.collect_set(column).alias("s"))
    bad = F.raise_error(F.concat(F.lit(f"not exactly one value contains {part}: "), F.to_json("s")))
    return d.select(F.when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise(bad.cast("string")).alias("value"))


def completion(sheet: DataFrame, required: dict[str, Column], by: list[str] = []) -> DataFrame:  # noqa: B006
    """rows, filled, required and rate of the fields that each row must fill: ``required`` tells for each field in which rows.

    A field is filled if it is more than white space; the rate is null where nothing is required.
    """
    full = {f: F.coalesce(F.length(F.btrim(f, F.lit(" \t\r\n"))) > 0, F.lit(False)) for f in required}
    want = {f: F.coalesce(c, F.lit(False)) for f, c in required.items()}
    need = sum((c.cast("long") for c in want.values()), F.lit(0))
    done = sum(((full[f] & c).cast("long") for f, c in want.items()), F.lit(0))
    d = sheet.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(done).alias("filled"), F.sum(need).alias("required"))
    return d.withColumn("rate", ratio("filled", "required"))
