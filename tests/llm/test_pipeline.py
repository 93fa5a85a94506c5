import re

import corpus_pipeline
from attestor.llm import packing, pii, quality
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_quality import brute as base_brute
from tests.llm.test_suffixes import brute as suffix_brute
from tests.llm.util import frame, odd_rows, save


def brute(rows):
    """The first four stages on (doc_id, text) by other means, but for the verdict of the line rules."""
    near = {i: c for (i, c, _, _) in near_brute(rows)}
    rows = [(i, t) for i, t in rows if near[i] == i]
    encoded = [(t or "").encode() for _, t in rows]
    removed = {i: x for (i, _), x in zip(rows, suffix_brute(encoded, 200))}
    return rows, removed


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "suffix_dedup", "pii_pseudonyms", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    d, outs = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf).cache()
        assert d.columns == docs.columns and [t for _, t in d.dtypes] == [t for _, t in docs.dtypes], name
        outs.append({r.doc_id: r for r in d.collect()})
        assert all(r.n_chars == len(r.text) for r in outs[-1].values())
    clean, single, cut, private = ({k: r.text for k, r in o.items()} for o in outs)
    assert set(clean) <= {k for k, t in before.items() if not base_brute(t)[-1]}
    assert all(set(t.split("\n")) <= set(before[k].split("\n")) for k, t in clean.items())
    rows, removed = brute(sorted(clean.items()))
    assert dict(rows) == single and set(cut) == set(single)
    assert all(len(cut[k].encode()) <= removed[k][0] - removed[k][1] <= len(cut[k].encode()) + 6 for k in cut)
    p = pii.Permuter(pii.session_key(spark))
    assert private == {k: pii.replaced(t, pii.find(t, p)) for k, t in cut.items()}
    final = corpus_pipeline.run(spark, sf).collect()
    text = {k: "".join(r.text for r in sorted((r for r in final if r.doc_id == k), key=lambda r: r.piece)) for k in private}
    assert text == private  # the packed pieces are the whole texts
    tokens = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in private.items()}
    assert {k: sum(r.n_tokens for r in final if r.doc_id == k) for k in tokens} == tokens
    assert {r.doc_id for r in final} == set(tokens) and max(r.n_tokens for r in final) <= packing.MAX_LEN


def test_odd_rows_and_empty(spark, tmp_path):
    for k, rows in enumerate((odd_rows(), [])):
        d = save(spark, tmp_path, rows, f"t{k}")
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, d).columns == docs.columns
        out = corpus_pipeline.run(spark, d)
        assert out.count() == quality.assess(docs).where("kept").count()
