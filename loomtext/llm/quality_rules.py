"""Quality rules: fixed counts, and a linear-chain conditional random field that labels lines.

The field marks each line with a word as content or boilerplate; Viterbi decoding gives the best sequence, and
the share of words in content lines decides whether a document stays. It is trained on a bounded sample of labelled
documents by the gradient of the exact likelihood. Labels are known for documents alone, so those of their lines are
found in turns with the field: the best ones by the field, changed as little as makes the document's share agree with
its label.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import chunks, id_type, map_texts, space_words

BOILERPLATE, CONTENT = 0, 1
#: Fixed values of the contract.
SYMBOLS, FEWEST_WORDS, MOST_REPEATED, REPEAT_WINDOW = "#*$%&|<>", 50, 50, 3
#: Labelled documents that the field is trained on, at most; they are used whole.
TRAINING_DOCUMENTS = 600
#: Content's least share of a document's words in labelled lines.
LEAST_CONTENT = 0.5
#: Lines of a training sequence (a longer document is several), and turns of finding line labels, at most.
SEQUENCE, TURNS = 64, 8

_LINE_SYMBOLS = re.compile(r"[#*$%&|<>~^=_{}\[\]\\]")
_NOTICE = re.compile(r"copyright|all rights reserved|licen[cs]ed|cookie|subscribe|privacy policy|terms of|https?://|@", re.I)
FEATURES = (
    "always", "one to three words", "four to nine words", "many words", "symbols in places", "symbols everywhere", "table bars",
    "shouting", "exclamation runs", "digits everywhere", "sentence end", "no sentence end", "repeated line", "repeats a word at once",
    "few different words", "notice", "long words",
)


def line_features(words: list[str], line: str, seen: bool) -> list[int]:
    """Numbers of the FEATURES that a line with words has."""
    n, size = len(words), len(line)
    symbols = len(_LINE_SYMBOLS.findall(line))
    out = [0, 1 if n <= 3 else 2 if n <= 9 else 3]
    if symbols > n:
        out.append(5)
    elif symbols * 5 > n:
        out.append(4)
    if line.count("|") * 4 >= n:
        out.append(6)
    if line.isupper() and size > 3:
        out.append(7)
    if line.count("!!") * 4 >= n:
        out.append(8)
    if sum(map(line.count, "0123456789")) * 4 > size:
        out.append(9)
    out.append(10 if line.rstrip().endswith((".", "?", "!", "。")) else 11)
    if seen:
        out.append(12)
    if n > 3:
        if sum(map(str.__eq__, words, words[1:])) * 4 > n:
            out.append(13)
        if n > 7 and len(set(words)) * 2 < n:
            out.append(14)
    if _NOTICE.search(line):
        out.append(15)
    if size > 14 * n:
        out.append(16)
    return out


class LineField:
    """Weights of a two-label chain: (label, feature) and (label before, label)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        self._emit, self._move = emit.tolist(), move.tolist()

    def decode(self, lines: list[list[int]]) -> list[int]:
        """The best labels of a document's lines; among equals boilerplate comes last."""
        if not lines:
            return []
        bad, good = self._emit
        (bb, bg), (gb, gg) = self._move
        back, b, g = [], 0.0, 0.0
        for k, features in enumerate(lines):
            eb, eg = sum([bad[f] for f in features]), sum([good[f] for f in features])
            if k:
                from_b = b + bb > g + gb, b + bg > g + gg
                b, g = (b + bb if from_b[0] else g + gb) + eb, (b + bg if from_b[1] else g + gg) + eg
                back.append(from_b)
            else:
                b, g = eb, eg
        label = CONTENT if g >= b else BOILERPLATE
        out = [label]
        for from_b in reversed(back):
            label = BOILERPLATE if from_b[label] else CONTENT
            out.append(label)
        return out[::-1]


def train_field(
    documents: list[tuple[list[list[int]], int | list[int]]], *, start: LineField | None = None, rounds: int = 150, rate: float = 0.5, ridge: float = 1e-3
) -> LineField:
    """Gradient ascent on the mean log-likelihood of the line labels, by forward-backward over all documents at once.

    A document is its lines' features and their labels (one number: the same for all). Documents weigh the same, and
    so do those with more and with less content. Long documents are cut into sequences. Without documents of both kinds
    nothing can be learnt; then every line is content.
    """
    emit, move = (np.zeros((2, len(FEATURES))), np.zeros((2, 2))) if start is None else (start.emit.copy(), start.move.copy())
    known = [(lines, [y] * len(lines) if isinstance(y, int) else y) for lines, y in documents if lines]
    kind = [CONTENT if 2 * sum(labels) >= len(labels) else BOILERPLATE for _, labels in known]
    if len(set(kind)) < 2:
        emit, move = np.zeros((2, len(FEATURES))), np.zeros((2, 2))
        emit[CONTENT, 0] = 1.0
        return LineField(emit, move)
    cut = [(k, at) for k, (lines, _) in enumerate(known) for at in range(0, len(lines), SEQUENCE)]
    n, longest = len(cut), min(SEQUENCE, max(len(lines) for lines, _ in known))
    x, mask, y = np.zeros((n, longest, len(FEATURES))), np.zeros((n, longest)), np.zeros((n, longest, 2))
    weight = np.zeros(n)
    for row, (k, at) in enumerate(cut):
        lines, labels = known[k]
        for j, (features, label) in enumerate(zip(lines[at : at + SEQUENCE], labels[at : at + SEQUENCE], strict=True)):
            mask[row, j] = x[row, j, features] = y[row, j, label] = 1
        weight[row] = 0.5 / (kind.count(kind[k]) * len(lines))
    steps = np.concatenate([np.zeros((n, 1)), mask[:, 1:]], 1)
    true_emit = np.einsum("n,nlk,nlf->kf", weight, y, x)
    true_move = np.einsum("n,nli,nlj->ij", weight, y[:, :-1], y[:, 1:])
    for _ in range(rounds):
        score = np.einsum("nlf,kf->nlk", x, emit)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0]
        for k in range(1, longest):
            new = np.logaddexp(ahead[:, k - 1, :1] + move[0], ahead[:, k - 1, 1:] + move[1]) + score[:, k]
            ahead[:, k] = np.where(steps[:, k, None] > 0, new, ahead[:, k - 1])
        for k in range(longest - 2, -1, -1):
            after = score[:, k + 1] + behind[:, k + 1]
            new = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
            behind[:, k] = np.where(steps[:, k + 1, None] > 0, new, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        at = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        pair = ahead[:, :-1, :, None] + move + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = np.exp(np.minimum(pair, 0)) * steps[:, 1:, None, None]
        emit += rate * len(FEATURES) * (true_emit - np.einsum("n,nlk,nlf->kf", weight, at, x) - ridge * emit)
        move += rate * (true_move - np.einsum("n,nlij->ij", weight, pair) - ridge * move)
    return LineField(emit, move)


def text_lines(text: str | None) -> Iterator[tuple[list[str], str, bool]]:
    """(words, line, equal to an earlier line) of the lines with a word."""
    seen: set[str] = set()
    for line in (text or "").split("\n"):
        words = [w.decode() for w in space_words(line)]
        if words:
            yield words, line, line in seen
            seen.add(line)


class Quality:
    """The fixed counts of a text, its labelled lines and the verdict."""

    def __init__(self, text: str | None, field: LineField):
        words = space_words(text)
        text = text or ""
        self.n_words = len(words)
        self.word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        self.n_symbols = sum(map(text.count, SYMBOLS))
        self.n_repeat_words = repeated_words(words)
        lines = list(text_lines(text))
        self.n_dup_lines = sum(seen for _, _, seen in lines)
        self.labels = field.decode([line_features(*line) for line in lines])
        inside = sum(len(line[0]) for line, label in zip(lines, self.labels, strict=True) if label == CONTENT)
        self.content_share = inside / self.n_words if self.n_words else 0.0
        self.base_failed = self.n_words < FEWEST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words
        self.kept = not self.base_failed and self.content_share >= LEAST_CONTENT

    def row(self) -> tuple:
        return (
            self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words, self.base_failed, self.kept, self.content_share,
        )


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three that the text has twice or more, the first time included."""
    n = len(words)
    if n <= REPEAT_WINDOW:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    kinds = len(number)
    if kinds < 1 << 20:
        grams = (codes[:-2] * kinds + codes[1:-1]) * kinds + codes[2:]
    else:
        _, two = np.unique(codes[:-1] * kinds + codes[1:], return_inverse=True)
        grams = two[:-1] * kinds + codes[2:]
    _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    hit = np.zeros(n, bool)
    for k in range(REPEAT_WINDOW):
        hit[k : n - REPEAT_WINDOW + 1 + k] |= again
    return int(hit.sum())


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
)


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_DOCUMENTS) -> list[tuple[str | None, int]]:
    """(text, label) of the ``limit`` labelled documents whose ids come first by hash: half of each label."""
    rows = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    order = F.xxhash64("doc_id")
    chosen = [rows.filter(F.col("y") == y).orderBy(order, "doc_id").limit(limit // 2) for y in (0, 1)]
    ids = {r.doc_id: r.y for part in chosen for r in part.collect()}
    # of rows that share an id one stands for all, so that what is collected keeps its bound
    found = docs.filter(F.col("doc_id").isin(list(ids))).groupBy("doc_id").agg(F.min("text").alias("text")).collect() if ids else []
    return [(r.text, ids[r.doc_id]) for r in sorted(found, key=lambda r: (r.doc_id, r.text or ""))]


def labels_that_agree(field: LineField, lines: list[list[int]], words: list[int], y: int, *, alone: bool = False) -> list[int]:
    """The field's labels of a document's lines (``alone``: each line by itself), or as near as agrees with ``y``.

    A good document whose content is too little counts as content wholly. In a bad one with too much of it, the lines
    least like content become boilerplate until it is too little.
    """
    margin = [sum(field.emit[CONTENT, f] - field.emit[BOILERPLATE, f] for f in features) for features in lines]
    labels = [CONTENT if m >= 0 else BOILERPLATE for m in margin] if alone else field.decode(lines)
    enough = LEAST_CONTENT * sum(words)
    inside = sum(n for n, label in zip(words, labels, strict=True) if label == CONTENT)
    if y == CONTENT:
        return labels if inside >= enough else [CONTENT] * len(lines)
    for k in sorted(range(len(lines)), key=lambda k: (margin[k], k)):
        if inside < enough:
            break
        if labels[k] == CONTENT:
            labels[k] = BOILERPLATE
            inside -= words[k]
    return labels


def fit_field(sample: list[tuple[str | None, int]]) -> LineField:
    """The field of labelled documents. Those with too few words are left out: that rule, not their lines, decides them."""
    documents = []
    for text, y in sample:
        lines = list(text_lines(text))
        words = [len(line[0]) for line in lines]
        if sum(words) >= FEWEST_WORDS:
            documents.append(([line_features(*line) for line in lines], words, CONTENT if y else BOILERPLATE))
    field = train_field([(lines, y) for lines, _, y in documents])
    if len({y for *_, y in documents}) < 2:
        return field
    before = None
    for turn in range(TURNS):
        found = [(lines, labels_that_agree(field, lines, words, y, alone=turn == 0)) for lines, words, y in documents]
        if found == before:
            break
        field, before = train_field(found, start=field if turn else None, rounds=60 if turn else 150), found
    return field


def judge_documents(df: DataFrame, field: LineField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, the counts, base_failed, kept and content_share.

    Null and empty texts have no words and fail; ids may be null or repeated; other columns are not looked at; an
    empty table gives an empty one. Whole texts are read.
    """

    def prepare() -> Callable[[list, list], list]:
        return lambda ids, texts: [ids, *map(list, zip(*[Quality(t, field).row() for t in texts], strict=True))]

    return map_texts(df, f"`{id_col}` {id_type(df, id_col)}, {COLUMNS}", prepare, id_col, text_col)


def label_lines(df: DataFrame, field: LineField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the labels (1: content) of its lines with words, in order."""

    def prepare() -> Callable[[list, list], list]:
        return lambda ids, texts: [ids, [Quality(t, field).labels for t in texts]]

    return map_texts(df, f"`{id_col}` {id_type(df, id_col)}, labels array<int>", prepare, id_col, text_col)


def keep_good(df: DataFrame, field: LineField, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with its own columns, whose text is kept."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, at):
            yield part.filter(pa.array([Quality(t, field).kept for t in part.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
