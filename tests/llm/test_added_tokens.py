"""Ids of added tokens within texts, as the tokenizers library gives them by default."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from outvote.llm.queries import QUERIES
from outvote.llm.tokens import Encoder, default_tokenizer, vocabulary

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "no token <|endoftext", "  <|endoftext|>\n\n it's", None, ""]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file(default_tokenizer())
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_added_tokens_have_the_librarys_ids(spark, reference):
    encoder = Encoder(vocabulary(spark, tokenizer=default_tokenizer()))
    draw = np.random.default_rng(7)
    alphabet = list("ab  \n\t.1'sé\x1c🙂<|>") + ["<|endoftext|>", " the", "\r\n"]
    for text in TEXTS + ["".join(draw.choice(alphabet, draw.integers(0, 30))) for _ in range(300)]:
        assert encoder.ids(text).tolist() == reference(text)


def test_queries_and_pipeline_use_them(spark, make, reference, tmp_path):
    documents = make(list(enumerate(TEXTS)))
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    lengths = {i: len(reference(t)) for i, t in enumerate(TEXTS)}
    assert {r[0]: r[1] for r in QUERIES["op5_token_counts"](spark, str(tmp_path)).collect()} == lengths
    wanted = Counter()
    for i, text in enumerate(TEXTS):
        ids = np.array([*reference(text), 0], "<u4")
        wanted[i, 0, len(ids), zlib.crc32(ids.tobytes()), len(ids)] += 1
    last = dict(corpus_pipeline.STAGES)["packing"]
    for packed in (QUERIES["op6_packing"](spark, str(tmp_path)), last(spark, documents, str(tmp_path))):
        assert Counter(tuple(r) for r in packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()) == wanted
