import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestor.llm import wavelet
from tests.llm.util import frame, odd_rows, save

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000) | st.integers(0, 3), max_size=1500))
def test_structure(values):
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(np.array(values, np.int64)).to_bytes())
    assert w.decode().tolist() == values
    some = list(range(0, len(values), max(1, len(values) // 9)))
    assert w.access(some).tolist() == [values[i] for i in some]
    assert w.count([values[i] for i in some], 0, some).tolist() == [values[:i].count(values[i]) for i in some]
    for v in [*values[:3], 99_999]:
        at = [i for i, x in enumerate(values) if x == v]
        assert w.occurrences(v).tolist() == at and w.count(v).tolist() == [len(at)]
        if at:
            assert w.select(v, len(at) - 1).tolist() == at[-1:]
        with pytest.raises(IndexError):
            w.select(v, len(at))
    with pytest.raises(IndexError):
        w.access(len(values))


class Counted(np.ndarray):
    """Bits that count the bytes that are read of them."""

    read = 0

    def __getitem__(self, at):
        out = np.asarray(super().__getitem__(at))
        Counted.read += out.nbytes
        return out


def test_answers_read_blocks():
    """Select, access and count read at most a block of each plane for each answer, not the planes."""
    values = np.random.default_rng(1).integers(0, 40, 200_000)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(values).to_bytes())
    w.planes = [(z, r, p.view(Counted)) for z, r, p in w.planes]
    for v in (0, 17, 39):
        at = np.flatnonzero(values == v)
        assert w.select(v, np.arange(len(at))).tolist() == at.tolist()
        Counted.read = 0
        assert w.select([v], [5]).tolist() == [at[5]] and w.access(at[5]).tolist() == [v] and w.count(v, 0, at[5]).tolist() == [5]
        assert 0 < Counted.read <= len(w.planes) * wavelet.BLOCK // 8 * 8


def test_equals_the_library(spark, sf, tmp_path):
    library = Tokenizer.from_file(PATH)
    for d in (sf, save(spark, tmp_path, [r for i, r in enumerate(odd_rows()) if r[0] is not None and i < 13])):
        texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect())
        start, want = 0, []
        for k, t in texts:
            ids = [*library.encode(t, add_special_tokens=False).ids, 1]
            again = [i for i, x in enumerate(ids) if x == ids[0] and len(ids) > 1]
            n = ids[:-1].count(ids[0]) if len(ids) > 1 else 1
            want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids[0], n, again[1] if n > 1 else None))
            start += len(ids)
        assert sorted(map(tuple, wavelet.op8_wavelet_shards(spark, d).collect())) == want


def test_shards_repeats_and_empty(spark):
    shards = wavelet.write_shards(frame(spark), PATH, shard_ids=500)
    assert shards.count() > 1
    assert shards.columns == ["part", "seq", "n_ids", "blob"]
    assert sorted(r.doc_id or -1 for r in wavelet.read_shards(shards, PATH).collect()) == sorted(r[0] or -1 for r in odd_rows())
    assert wavelet.write_shards(frame(spark, []), PATH).count() == 0
