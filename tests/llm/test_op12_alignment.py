import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomtext.llm.queries import op12_token_alignment, tokenizer_path
from loomtext.llm.token_alignment import TokenAligner, alignment_report, groups_of, label_string

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def sides():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def plain(sides, texts):
    """The report's columns of a list of texts, token by token and without cutting texts."""
    a, b = sides
    back, docs, counts = letters(), [], Counter()
    for text in texts:
        links, groups = [], []
        n_a = n_b = 0
        if text:
            want = (" " + text).encode()
            a_side = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            b_side = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
            if b"".join(x for _, x in a_side) == want == b"".join(x for _, x in b_side):
                n_a, n_b = len(a_side), len(b_side)
                ends, at = {}, 0
                for i, x in a_side:
                    at += len(x)
                    ends[at] = i
                own_a, own_b, at, a_at, rest = [], [], 0, 0, list(a_side)
                for i, x in b_side:
                    at += len(x)
                    own_b.append(i)
                    while rest and a_at + len(rest[0][1]) <= at:
                        k, y = rest.pop(0)
                        a_at += len(y)
                        own_a.append(k)
                    if at in ends:
                        groups.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
                        links.append((own_a[-1], i))
                        own_a, own_b = [], []
        counts.update(links)
        docs.append((n_a, n_b, groups, links))
    top = Counter()
    for (_, b_id), n in counts.items():
        top[b_id] = max(top[b_id], n)
    return [
        (n_a, n_b, len(g), len(own), sum(counts[x] == top[x[1]] for x in own), sum(counts[x] for x in own), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "")
        for n_a, n_b, g, own in docs
    ]


def test_query_is_brute_force(spark, sides):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((d.doc_id for d in docs), plain(sides, [d.text for d in docs]), strict=True))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op12_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and sum(w[0] > 0 for w in want.values()) > 100


TEXTS = [
    None, "", " ", "\n", "a", "  two  spaces ", "line\n next", "tab\t x", "a▁b c", "tail \n", "x <|endoftext|> </s> <s> <0x41>", "naïve ﬁne Ⅳ", "日本語 の 文",
    "é 👩‍👧 z", " nbsp wide x", "\u001c sep\u001d x", "don't we'll it's", "12345 6789,000.50", "w" * 3000, "ab cd " * 4000, "a▁b " + "ab cd " * 50,
    "ab cd " * 4000, "​zero width", "\r\n\r\n x  \r\n", "x" + " " * 300 + "y",
]


@pytest.mark.parametrize("most_sent", [2_000_000, 0])
def test_rows(spark, sides, most_sent):
    """Also null and repeated ids, repeated rows and columns with clashing names."""
    ids = [None, 5, 5, *range(len(TEXTS) - 3)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, TEXTS, strict=True)], "doc_id long, text string, links string, n string")
    got = sorted((str(r.doc_id), *[r[c] for c in COLUMNS]) for r in alignment_report(df, A, B, most_sent=most_sent).collect())
    assert got == sorted((str(i), *w) for i, w in zip(ids, plain(sides, TEXTS), strict=True))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    for most in (2_000_000, 0):
        out = alignment_report(df, A, B, most_sent=most)
        assert out.columns == ["doc_id", *COLUMNS] and out.count() == 0


def test_parts_are_forgotten_without_harm(monkeypatch, sides):
    monkeypatch.setattr("loomtext.llm.token_alignment.REMEMBERED", 3)
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        aligner = TokenAligner(a.read(), b.read())
    texts = [f"word{k % 7} and {k} other" for k in range(60)] + [t for t in TEXTS if t]
    got = [x for k in range(0, len(texts), 5) for x in aligner.summaries(texts[k : k + 5])]
    assert [g[:4] for g in got] == [(w[0], w[1], w[2], w[6]) for w in plain(sides, texts)]
    whole = aligner.align(texts)
    assert [(len(w.a_ids), hashlib.sha256(w.text().encode()).hexdigest()) if w else (0, "") for w in whole] == [(g[0], g[3]) for g in got]
    assert [sorted(a << 32 | b for a, b in w.links()) if w else [] for w in whole] == [[k for k, n in zip(g[4].tolist(), g[5].tolist(), strict=True) for _ in range(n)] for g in got]


def test_labels():
    import numpy as np

    labels = label_string(6, np.array([2, 3, 6]), np.array([1, 3, 5, 6]))
    assert labels == b"ba+-b+" and groups_of(labels) == [(3, 2, 2), (6, 1, 2)]
