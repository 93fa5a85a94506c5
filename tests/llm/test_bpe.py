import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestor.llm import bpe
from tests.llm.util import frame, odd_rows, save

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_the_library(spark, sf, tmp_path, library):
    odd = odd_rows() + [(20, "ΣΑΣ Σας don'T I'LL's 漢字 é é <|startoftext|>x<|endoftext|> <|end|>", None, None, None, None, None, None, None, None)]
    for d in (sf, save(spark, tmp_path, [r for r in odd if r[0] is not None])):
        texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        got = bpe.op6_bpe_trie(spark, d).collect()
        assert len(got) >= len(texts)
        for r in got:
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            shown = library.decode(ids, skip_special_tokens=False)
            want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want, r.doc_id


def test_shared_prefixes_and_borders(library):
    b = bpe.TrieBPE(PATH)
    words = ["in", "ing", "inga", "ingatt", "thththth", "aaaaaaaaaaaaa", "the", "then", "thenthe", "a", "zzzzzzzzz", "lllll", "x" * 3000]
    got = b.encode_parts(words)
    assert {w: library.encode(w).ids for w in words} == got


def test_empty_table(spark):
    assert bpe.encode(frame(spark, []), PATH).count() == 0
