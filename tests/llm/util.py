"""Odd rows that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, w string, words int, pos int, bucket int"


def odd_rows():
    texts = [
        None, "", "   \n\t ", "a", "one two three", "one two three", "The same line here.\nThe same line here.\nOther words follow now.",
        "x" * 30_000, " ".join(f"word{i % 977}" for i in range(20_000)), "été à la maison ß İ ﬁ 漢字  nbsp  em \U0001f600 é",
        "lone \x00 nul \x85 nel \x1c fs <|endoftext|> it's 12,345.67 $%&", "dup " * 300, None,
    ]
    rows = [(i, t, None if i % 3 else "en", None, None if t is None else len(t), "h", None, 1, 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[4], (None, "no id here at all", None, None, None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def save(spark, tmp_path, rows=None, name="in"):
    """A folder with a documents table, for queries that take sf_dir."""
    frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/{name}/documents.parquet")
    return f"{tmp_path}/{name}"
