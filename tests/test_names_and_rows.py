"""Names at any depth, numbers of stacked tables, near hashes."""

import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import joins, rules


def keys(df):
    return sorted(r.key for r in df.select("key").collect())


def test_names_in_any_nesting(spark):
    df = spark.sql("""
SELECT array(map('secret_label', 'a')) AS lists, map('a', map('my_label', 1)) AS maps, struct(map('x', 1, 'LABEL_y', 2) AS m, 5 AS z) AS fields,
map(1, map('labels', 2)) AS numbered, named_struct('b', array(named_struct('x_label', 1))) AS typed, map('q', array(map('r', array(map('deep_label', 1))))) AS mixed, CAST(NULL AS map<string,int>) AS none""")
    found = keys(rules.forbidden_keys(df, "t", ["label"]))
    assert found == sorted(["record.lists[].secret_label", "record.maps.a.my_label", "record.fields.m.LABEL_y", "record.numbered.1.labels", "record.typed.b[].x_label", "record.mixed.q[].r[].deep_label"])
    assert keys(rules.forbidden_keys(df, "t", ["gold"])) == []


def test_names_in_json_texts(spark):
    def paths(value, at="record"):
        if isinstance(value, dict):
            return {f"{at}.{k}" for k in value} | {p for k, x in value.items() for p in paths(x, f"{at}.{k}")}
        return {p for x in value for p in paths(x, at + "[]")} if isinstance(value, list) else set()

    draw = random.Random(4)

    def value(depth):
        kind = draw.random()
        if depth and kind < 0.5:
            return {draw.choice(["a", "b", "gold_x", "Gold", 'q"{[', "é gold"]): value(depth - 1) for _ in range(draw.randrange(4))}
        if depth and kind < 0.8:
            return [value(depth - 1) for _ in range(draw.randrange(3))]
        return draw.choice([1, "gold", '{"gold": [', None, True])

    import json

    values = [value(6) for _ in range(200)]
    texts = [json.dumps(v, ensure_ascii=k % 2 == 0) for k, v in enumerate(values)] + ["no json", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "j string")
    expected = sorted({p for v in values for p in paths(v) if "gold" in p.rsplit(".", 1)[1].lower()})
    assert keys(rules.forbidden_json_keys(df, "t", "j", ["gold"])) == expected


def test_stacked_numbers_with_further_columns(spark):
    """Two million rows with a column that is no key: every number once, in order, within its part's range."""
    a = spark.range(1_500_000).select((F.col("id") * 7919 % 1_500_007).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    b = spark.range(500_000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    rows, ranges = joins.stacked({"a": a, "b": b}, ["k"])
    assert [tuple(r) for r in ranges.orderBy("start").collect()] == [("a", 0, 1_500_000), ("b", 1_500_000, 2_000_000)]
    r = rows.agg(F.count("*"), F.count_distinct("row"), F.min("row"), F.max("row")).first()
    assert tuple(r) == (2_000_000, 2_000_000, 0, 1_999_999)
    assert rows.where("part = 'b' AND row <> k + 1500000").count() == 0


@pytest.mark.parametrize("n", [300, 3_000])
def test_near_hashes(spark, n):
    """Few hashes meet on single bands, many on pairs of bands."""
    draw = random.Random(n)
    h = [draw.getrandbits(20) for _ in range(n // 3)]
    h += [x ^ sum(1 << draw.randrange(20) for _ in range(draw.randrange(5))) for x in h] + h[: n // 3]
    df = spark.createDataFrame(list(enumerate(h)), "id long, h long")
    found = sorted(map(tuple, joins.hamming_pairs(df, df, "id", "h", most=2, width=20).collect()))
    assert found == sorted((i, j, (x ^ y).bit_count()) for i, x in enumerate(h) for j, y in enumerate(h) if i < j and (x ^ y).bit_count() <= 2)
