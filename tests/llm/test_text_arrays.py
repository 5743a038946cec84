import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from outvote.llm.quality_ratio import base_rules
from outvote.llm.text_arrays import chunked, span_hashes, texts_of, window_hashes, words_of
from outvote.llm.tokens import Encoder, default_pattern, default_vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b🙂#|\x1c ", max_size=80)), max_size=8)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_and_hashes_agree_with_a_pattern(column):
    texts = texts_of(pa.array(column, pa.string()))
    found = words_of(texts)
    spelt = [texts.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends)]
    wanted = [WORD.findall(t or "") for t in column]
    assert spelt == [w for ws in wanted for w in ws]
    assert found.counts.tolist() == [len(w) for w in wanted]
    hashes = span_hashes(texts.data, found.starts, found.ends)
    assert len(set(hashes.tolist())) == len(set(spelt))
    runs, of = window_hashes(hashes, found.first, 3)
    exact = [tuple(w[i : i + 3]) for w in wanted for i in range(max(len(w) - 2, min(len(w), 1)))]
    assert len(runs) == len(exact) and len(set(runs.tolist())) == len(set(exact))


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_base_rules_agree_with_brute_force(column):
    found = base_rules(texts_of(pa.array(column, pa.string())))
    for i, text in enumerate(column):
        text = text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {k for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        wanted = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(found[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == wanted
        assert bool(found["base_failed"][i]) == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_repeated_windows_of_long_runs():
    text = "a b c d e f g h i j " * 3 + "z"
    assert base_rules(texts_of(pa.array([text])))["n_repeat_words"][0] == 30


def test_chunks_keep_every_row():
    column = ["a" * n for n in (0, 10, 500, 3, 0, 700, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(column, pa.string())], ["text"])
    slices = list(chunked(iter([batch, batch.slice(0, 0)]), limit=100))
    assert [t for s in slices for t in s.column("text").to_pylist()] == column and len(slices) > 2
    assert len(texts_of(batch.slice(3, 2).column("text"))) == 2


def test_ids_equal_the_tokenizers_library():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    class Shipped:
        value = (open(default_vocabulary(), "rb").read(), default_pattern())

    encoder = Encoder(Shipped)
    reference = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    draw = np.random.default_rng(5)
    alphabet = list("ab  \n\t.1'sé　 \x1c\x85🙂<|>Ω!$") + ["<|endoftext|>", " the", "\r\n", "'ll"]
    for _ in range(500):
        text = "".join(draw.choice(alphabet, draw.integers(0, 30)))
        assert encoder.ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids
    assert encoder.ids(None).tolist() == [] and len(encoder.ids("x" * 200_000))


def test_shipped_functions_take_no_tables_along():
    from pyspark import cloudpickle

    from outvote.llm import text_arrays

    def hashes(data):
        return text_arrays.span_hashes(data, np.array([0]), np.array([len(data)]))

    span_hashes(np.zeros(10, np.uint8), np.array([0]), np.array([10]))
    assert len(cloudpickle.dumps(hashes)) < 100_000
    assert len(cloudpickle.dumps(span_hashes)) < 100_000
