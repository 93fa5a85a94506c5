"""Declarative checks.  Each returns violations: rule, table, key, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions.numeric import col

SCHEMA = "rule string, table string, key string, detail string"


def _violations(df: DataFrame, rule: str, table: str, key, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), col(key).cast("string").alias("key"), col(detail).cast("string").alias("detail"))


def key_text(keys: list[str]) -> Column:
    return F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])


def unique(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    d = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return _violations(d, "unique", table, key_text(keys), F.col("n"))


def references(df: DataFrame, table: str, column: str, parent: DataFrame, parent_key: str, nullable: bool = False) -> DataFrame:
    """Values of ``column`` without a row in the parent."""
    d = df.where(F.col(column).isNotNull()) if nullable else df
    d = d.join(parent.select(F.col(parent_key).alias("_p")), F.col(column) == F.col("_p"), "left_anti")
    return _violations(d, f"reference:{column}", table, F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit("no such row"))


def same_parent(df: DataFrame, table: str, keys: list[str], left: str, right: str) -> DataFrame:
    d = df.where(F.col(left).isNull() | F.col(right).isNull() | (F.col(left) != F.col(right)))
    return _violations(d, f"same_parent:{left}={right}", table, key_text(keys), F.concat_ws(" <> ", left, right))


def rows(df: DataFrame, table: str, keys: list[str], **checks: Column) -> DataFrame:
    """One violation for each named check that does not hold in a row; null counts as not holding."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    d = df.select(key_text(keys).alias("key"), F.explode(failed).alias("rule"))
    return d.select("rule", F.lit(table).alias("table"), "key", F.lit(None).cast("string").alias("detail"))


def same_keys(left: DataFrame, right: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Keys that stand on one side only."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    d = a.join(b, keys, "full_outer").where("_l IS NULL OR _r IS NULL")
    return _violations(d, "same_keys", table, key_text(keys), F.when(F.col("_l").isNull(), "missing").otherwise("unexpected"))


def exactly_once(df: DataFrame, parent: DataFrame, table: str, key: str) -> DataFrame:
    n = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"))
    d = parent.select(F.col(key).alias("_p")).join(n, F.col("_p") == F.col("_k"), "full_outer")
    d = d.where("n IS NULL OR n <> 1 OR _p IS NULL")
    return _violations(d, "exactly_once", table, F.coalesce("_p", "_k"), F.coalesce("n", F.lit(0)))


def cartesian(left: DataFrame, right: DataFrame, actual: DataFrame, table: str, parent: str, left_key: str, right_key: str) -> DataFrame:
    """Pairs of rows of one parent that ``actual`` lacks or has though they are not of one parent.

    Counts are compared first; only parents whose counts differ, and pairs of
    unlike parents, are expanded.
    """
    lefts, rights = left.select(parent, left_key), right.select(parent, right_key)
    want = lefts.groupBy(parent).agg(F.count("*").alias("l")).join(rights.groupBy(parent).agg(F.count("*").alias("r")), parent)
    placed = actual.select(left_key, right_key).distinct().join(lefts.withColumnRenamed(parent, "_pl"), left_key, "left").join(rights.withColumnRenamed(parent, "_pr"), right_key, "left")
    stray = placed.where("_pl IS NULL OR _pr IS NULL OR _pl <> _pr")
    have = placed.where("_pl = _pr").groupBy(F.col("_pl").alias(parent)).agg(F.count("*").alias("n"))
    short = want.join(have, parent, "left").where(F.coalesce("n", F.lit(0)) != F.col("l") * F.col("r")).select(parent)
    missing = lefts.join(short, parent, "left_semi").join(rights, parent).join(actual.select(left_key, right_key), [left_key, right_key], "left_anti")
    return _violations(stray, "cartesian", table, key_text([left_key, right_key]), F.lit("unexpected")).unionByName(_violations(missing, "cartesian", table, key_text([left_key, right_key]), F.lit("missing")))


def same_rows(supplied: DataFrame, derived: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Rows of a supplied table that differ from those derived."""
    names = derived.columns
    a = supplied.select(*keys, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("_a"))
    b = derived.select(*keys, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("_b"))
    d = a.join(b, keys, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return _violations(d, "derived", table, key_text(keys), F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "unexpected").otherwise("differs"))


def leaks(df: DataFrame, table: str, key: str, split: str = "split", inactive: tuple[str, ...] = ("excluded",)) -> DataFrame:
    """Keys that stand in more than one active split."""
    d = df.where(~F.col(split).isin(*inactive)).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where("size(s) > 1")
    return _violations(d, f"leak:{key}", table, key, F.array_join("s", ","))


def _bad(name: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(p)) for p in parts])


def holds_names(t: T.DataType) -> bool:
    """Whether values of a type may bring names of their own: maps and variants, at any depth."""
    if isinstance(t, T.StructType):
        return any(holds_names(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return holds_names(t.elementType)
    return isinstance(t, (T.MapType, T.VariantType))


def _text_keys(t: T.DataType) -> T.DataType:
    """The type with texts as the keys of its maps, as variants have them."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _text_keys(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_text_keys(t.elementType))
    return T.MapType(T.StringType(), _text_keys(t.valueType)) if isinstance(t, T.MapType) else t


NODES = "array<struct<path:string,key:string,value:variant>>"


def variant_names(value: Column, root: Column, depth: Column) -> Column:
    """path and key of every name in a variant, at any depth up to ``depth``: a fold that goes down one level at a time.

    Names are joined to paths by dots; steps into lists read [].
    """

    def children(x: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(x["value"], "$", "map<string,variant>"))
        named = F.transform(fields, lambda f: F.struct(F.concat(x["path"], F.lit("."), f["key"]).alias("path"), f["key"].alias("key"), f["value"].alias("value")))
        items = F.transform(F.try_variant_get(x["value"], "$", "array<variant>"), lambda v: F.struct(F.concat(x["path"], F.lit("[]")).alias("path"), F.lit(None).cast("string").alias("key"), v.alias("value")))
        return F.coalesce(named, items, F.array().cast(NODES))

    def down(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(state["level"], children))
        return F.transform(F.array(below), lambda n: F.struct(F.concat(state["found"], F.transform(F.filter(n, lambda y: y["key"].isNotNull()), lambda y: F.struct(y["path"].alias("path"), y["key"].alias("key")))).alias("found"), n.alias("level")))[0]

    none = F.array().cast("array<struct<path:string,key:string>>")
    top = F.array(F.struct(root.alias("path"), F.lit(None).cast("string").alias("key"), value.alias("value"))).cast(NODES)
    return F.aggregate(F.sequence(F.lit(1), depth), F.struct(none.alias("found"), top.alias("level")), down, lambda s: s["found"])


def nesting(json: Column) -> Column:
    """How deep a JSON text is nested, one more than its brackets open at once."""
    bare = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    signs = F.transform(F.split(bare, ""), lambda c: F.when(c.isin("{", "["), 1).when(c == "", 0).otherwise(-1))
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))
    return F.aggregate(signs, state, lambda s, x: F.struct((s["at"] + x).alias("at"), F.greatest(s["most"], s["at"] + x).alias("most")), lambda s: s["most"] + 1)


def forbidden_keys(df: DataFrame, table: str, parts: list[str]) -> DataFrame:
    """Names, at any depth, that contain a forbidden part: columns, fields, and keys of maps and of variants, with their paths.

    Names of columns and fields come from the schema alone.  Columns that hold
    maps or variants anywhere are read, once; their rows become variants, so that
    any nesting of maps, lists and structs is one case.
    """
    spark, found = df.sparkSession, set()

    def walk(t, path: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                if any(p in f.name.lower() for p in parts):
                    found.add(f"{path}.{f.name}")
                walk(f.dataType, f"{path}.{f.name}")
        elif isinstance(t, T.ArrayType):
            walk(t.elementType, path + "[]")

    walk(df.schema, "record")
    out = spark.createDataFrame([("forbidden_key", table, p, None) for p in sorted(found)], SCHEMA)
    for f in df.schema.fields:
        if holds_names(f.dataType):
            x = F.col(f"`{f.name}`")
            x = x if isinstance(f.dataType, T.VariantType) else F.to_variant_object(x.cast(_text_keys(f.dataType)))
            out = out.unionByName(_named(df.select(x.alias("v")), F.lit(f"record.{f.name}"), table, parts))
    return out.distinct()


def forbidden_json_keys(df: DataFrame, table: str, column: str, parts: list[str]) -> DataFrame:
    """Names at any depth of a column of JSON texts; a text that is no JSON has none."""
    return _named(df.select(F.try_parse_json(column).alias("v")), F.lit("record"), table, parts)


def _named(values: DataFrame, root: Column, table: str, parts: list[str]) -> DataFrame:
    json = F.to_json("v")
    d = values.where(F.col("v").isNotNull()).select(F.explode(F.filter(variant_names(F.col("v"), root, nesting(json)), lambda y: _bad(y["key"], parts))).alias("x"))
    return _violations(d.select("x.path").distinct(), "forbidden_key", table, "path", F.lit(None))


def every(*violations: DataFrame) -> DataFrame:
    """All violations; a broken rule stops no other."""
    return reduce(DataFrame.unionByName, violations)


def sample(violations: DataFrame, n: int = 5) -> DataFrame:
    """The first violations of each rule and table, with how many there are."""
    w = Window.partitionBy("rule", "table")
    d = violations.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("key", "detail")))
    return d.where(F.col("k") <= n).drop("k")


def vote_pair(votes, allowed: list[str] | None = None, distinct: bool = False) -> Column:
    """Exactly two votes, each allowed; or exactly two different, non-empty ids."""
    v = col(votes)
    ok = F.coalesce(F.size(v) == 2, F.lit(False))
    if allowed is not None:
        ok = ok & F.forall(v, lambda x: F.coalesce(x.isin(*allowed), F.lit(False)))
    if distinct:
        ok = ok & (F.size(F.array_distinct(v)) == 2) & F.forall(v, lambda x: F.coalesce(x != "", F.lit(False)))
    return ok


def is_human(name) -> Column:
    """Whether a reviewer's name has no mark of a machine."""
    return ~F.lower(F.btrim(col(name), F.lit(" \t\n"))).rlike("codex|nonhuman|non-human|model review|ai review")


def feature_problems(df: DataFrame, key: str, vector: str, one_hot: str | None = None, unit: str | None = None, shares: str | None = None, tolerance: float = 1e-3) -> DataFrame:
    """Rows of a feature store with non-finite values, a vector not of unit length, a one-hot row not of one 1, or a share outside 0 to 1."""
    checks = {"finite": F.forall(vector, lambda x: ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))}
    if unit:
        total = F.aggregate(unit, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        checks["unit_norm"] = F.abs(F.sqrt(total) - 1) <= tolerance
    if one_hot:
        checks["one_hot"] = F.forall(one_hot, lambda x: x.isin(0, 1)) & (F.aggregate(one_hot, F.lit(0.0), lambda a, x: a + x) == 1)
    if shares:
        checks["share"] = F.forall(shares, lambda x: x.between(0, 1))
    return rows(df, "features", [key], **checks)
