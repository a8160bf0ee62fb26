import random

import duckdb
import pytest
from tokenizers.models import Unigram

from loomtext.llm.queries import tokenizer_path
from loomtext.llm.unigram_count import UnigramCounter, count_tokens, piece_vocabulary

VOCABULARY = piece_vocabulary(tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return Unigram(list(VOCABULARY), unk_id=0, byte_fallback=True)


def pieces(model, text):
    return [t.id for t in model.tokenize(text)]


def test_counts_are_the_librarys(library):
    own = UnigramCounter(VOCABULARY)
    assert own.by_word
    draw = random.Random(3)
    texts = ["", " ", "a  b ", "▁ a", "\n\n", "😀😀 x", "<s>", "<unk>a"]
    texts += ["".join(draw.choice("ab the▁ \n😀éñ.,x") for _ in range(draw.randint(1, 90))) for _ in range(500)]
    texts += [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for text in texts:
        want = pieces(library, own.normalise(text)) if text else []
        score, count = own.count(text)
        assert count == len(want), text
        if text:
            assert (score, count) == own._best(own.normalise(text))


@pytest.mark.parametrize("fallback", [False, True])
def test_small_vocabularies_with_ties(fallback):
    vocabulary = (("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0))
    model = Unigram(list(vocabulary), unk_id=0, byte_fallback=fallback)
    own = UnigramCounter(vocabulary, fallback)
    draw = random.Random(5)
    for _ in range(400):
        text = "".join(draw.choice("ab zé") for _ in range(draw.randint(1, 14)))
        assert own.count(text)[1] == len(pieces(model, own.normalise(text))), text


def test_rows(spark):
    rows = [(1, "Hello world", 5), (1, "Hello world", 6), (None, "", 7), (3, None, 8), (4, "xy" * 30000 + " y", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = count_tokens(df, VOCABULARY).collect()
    own = UnigramCounter(VOCABULARY)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((r[0] or 0, own.count(r[1])[1]) for r in rows)
    assert count_tokens(df.limit(0), VOCABULARY).count() == 0
