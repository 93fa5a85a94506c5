"""Sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from attestor.sources import io


def put(path, text, mode="w", encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode, encoding=encoding) as f:
        f.write(text)
    return str(path)


def test_strict_jsonl(spark, tmp_path):
    lines = ['{"a": 1, "b": "x"}', "", '{"a": true, "b": "x"}', '{"a": 1.5, "b": "x"}', '{"a": 1}', '{"a": 1, "b": "x", "c": 2}', "[1]", '[{"a": 1, "b": "x"}]', "nope", '"s"', '{"a": 7, "b": null}']
    rows, bad = io.strict_jsonl(spark, put(tmp_path / "t.jsonl", "\n".join(lines) + "\n"), "a int, b string")
    got = {r.line: r.problem for r in bad.collect()}
    assert got == {3: "value of the wrong type", 4: "value of the wrong type", 5: 'missing=["b"], extra=[]', 6: 'missing=[], extra=["c"]', 7: "record must be an object", 8: "record must be an object", 9: "invalid JSON", 10: "record must be an object"}
    assert {r._source_line: (r.a, r.b) for r in rows.where("a IS NOT NULL AND _source_line NOT IN (3, 4)").collect()} == {1: (1, "x"), 11: (7, None)}
    assert io.clean(rows).columns == ["a", "b"]
    _, bad = io.strict_jsonl(spark, put(tmp_path / "o.jsonl", '{"a": 1}\n'), "a int, b string", ("b",))
    assert bad.count() == 0


def test_lenient_and_plain_jsonl(spark, tmp_path):
    at = put(tmp_path / "x.jsonl", '{"a": 1}\n{"a": 2}\n')
    assert io.lenient_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    assert io.lenient_jsonl(spark, at, "a int").count() == 2 and io.jsonl(spark, at, "a int").count() == 2
    with pytest.raises(Exception) as e:
        io.jsonl(spark, str(tmp_path / "none.jsonl"), "a int")
    assert io.is_missing(e.value)
    with pytest.raises(Exception):
        io.jsonl(spark, put(tmp_path / "bad.jsonl", "{\n"), "a int").collect()
    assert io.json_document(spark, put(tmp_path / "d.json", json.dumps([{"a": 1}, {"a": 2}], indent=1)), "a int").count() == 2


def test_csv(spark, tmp_path):
    d = io.csv(spark, put(tmp_path / "s.csv", 'id,note\n1,"two\nlines, ""quoted"""\n2,\n', encoding="utf-8-sig"))
    assert [tuple(r) for r in d.orderBy("id").collect()] == [("1", 'two\nlines, "quoted"'), ("2", "")]
    io.write_csv(d, str(tmp_path / "out"), ["note", "id"])
    back = io.csv(spark, str(tmp_path / "out"))
    assert back.columns == ["note", "id"] and sorted(map(tuple, back.select("id", "note").collect())) == sorted(map(tuple, d.collect()))


def test_jsonl_sink(spark, tmp_path):
    d = spark.createDataFrame([(2, "b", 9), (1, None, 8)], "z int, a string, _source_line int")
    io.write_jsonl(d, str(tmp_path / "o"), ["z"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert text == '{"a":null,"z":1}\n{"a":"b","z":2}\n'
    io.write_jsonl(d.where("z = 1"), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 1


def test_lists_arrays_files(spark, tmp_path):
    assert sorted(r.id for r in io.id_list(spark, put(tmp_path / "ids.txt", " 7 8\n\n9\t10\n")).collect()) == ["10", "7", "8", "9"]
    io.write_arrays(spark.createDataFrame([("x", [1.0, 2.0]), ("y", [3.0])], "name string, value array<double>"), str(tmp_path / "arr"))
    assert io.read_array(spark, str(tmp_path / "arr"), "y").first().value == [3.0]
    import hashlib

    assert io.file_hashes(spark, put(tmp_path / "f.bin", "abc")).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    assert io.exists(spark, str(tmp_path / "f.bin")) and not io.exists(spark, str(tmp_path / "no"))


def test_annotations(spark, tmp_path):
    box = "<object><name>{0}</name>{1}<bndbox><xmin>1</xmin><ymin>1</ymin><xmax>{2}</xmax><ymax>30</ymax></bndbox></object>"
    xml = "<annotation><size><width>40</width><height>20</height></size>" + box.format("7", "<name>8</name>", 99) + box.format("7", "", 5) + "<object><name>9</name></object></annotation>"
    d = io.annotations(spark, put(tmp_path / "a" / "1.xml", xml))
    assert d.count() == 3
    assert {r.name: r.boxes for r in io.boxes_by_name(d).collect()} == {"7": [[0, 0, 5, 20], [0, 0, 40, 20]], "8": [[0, 0, 40, 20]]}
    assert {r.name: r.boxes for r in io.boxes_by_name(d, 16).collect()} == {"7": [[0, 0, 40, 20]], "8": [[0, 0, 40, 20]]}


def test_ledger_and_utilisation(spark):
    rows = ["12|gpu|3600|COMPLETED|cpu=4,gres/gpu=2,gres/gpu:l4=2", "13|gpu||FAILED|cpu=4,gres/gpu:l4=1,gres/gpu:a100=2", "12.batch|gpu|5|X|", " "]
    got = {r.job_id: (r.allocated_gpus, r.gpu_hours) for r in io.ledger(spark.createDataFrame([(x,) for x in rows], "value string")).collect()}
    assert got == {"12": (2, 2.0), "13": (3, 0.0)}
    r = io.utilisation(spark.createDataFrame([("t, 10 %, 3 MiB",), ("t, 0 %, 3",), ("none",)], "value string")).first()
    assert (r.samples, r["mean"], r["max"], r.nonzero) == (2, 5.0, 10, 0.5)
    none = io.utilisation(spark.createDataFrame([("none",)], "value string")).first()
    assert (none.samples, none["mean"]) == (0, None)


def test_lines_are_numbered_by_file(spark, tmp_path):
    """Each file's lines count from 1, whatever the number and order of files and of the blocks they are read in."""
    at = tmp_path / "many"
    at.mkdir()
    want = {}
    for name, n in (("a", 3), ("b", 5_000), ("c", 1)):
        lines = [f'{{"id": {k}}}' if k % 7 else "  " for k in range(1, n + 1)]
        (at / f"{name}.jsonl").write_text("\n".join(lines) + ("\n" if name != "c" else ""))
        want |= {(name, k): x for k, x in enumerate(lines, 1) if x.strip()}
    for size in ("1g", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = io.raw_lines(spark, str(at)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert {(r.file.rsplit("/", 1)[1][0], r.line): r.raw for r in rows} == want and len(rows) == len(want)


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([("b|c", 2, None), ("a", 1, 0.5)], "name string, n int, x double")
    assert io.markdown(d, "Title", ["n"]).first().value == "# Title\n\n| name | n | x |\n| --- | --- | --- |\n| a | 1 | 0.5 |\n| b\\|c | 2 |  |\n"
    io.write_markdown(d, str(tmp_path / "md"), "Title", ["n"])
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).count() == 1
    io.write_report(d, str(tmp_path / "json"))
    assert sorted(map(str, io.json_document(spark, str(tmp_path / "json"), "name string, n int, x double").collect())) == sorted(map(str, d.collect()))
