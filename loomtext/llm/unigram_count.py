"""Token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates every vocabulary match; dynamic programming over the end positions
carries only the best score and its number of pieces. Ties go, as in the tokenizers library, to the
piece that starts first; a character without a piece of its own costs ten less than the lowest score.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from loomtext.llm.common import id_type, map_texts

SPACE = "▁"
#: Taken from the lowest score for a character that no piece covers; a fixed value of the library.
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers, and the longest that it remembers.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 48

Vocabulary = tuple[tuple[str, float], ...]


class UnigramCounter:
    """Best score and number of pieces of whole texts under a unigram vocabulary."""

    def __init__(self, vocabulary: Vocabulary, byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        names = dict(vocabulary)
        self.fallback = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min(names.values()) - UNKNOWN_PENALTY
        # A boundary before a space is certain if no piece has a space after another character; sums of
        # whole numbers don't depend on their order, so words can then be counted one by one.
        whole = all(float(s).is_integer() for s in names.values())
        self.by_word = whole and self.fallback and not any(SPACE in p.lstrip(SPACE) for p in names)
        self.remembered: dict[str, tuple[float, int]] = {}

    def normalise(self, text: str) -> str:
        """A space before the text, and every space visible."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _best(self, text: str) -> tuple[float, int]:
        size, unknown, fallback = len(text), self.unknown, self.fallback
        scores: list[float | None] = [0.0] + [None] * size
        pieces, open_run = [0] * (size + 1), [False] * (size + 1)

        def leave_to_unknown(end: int) -> None:
            candidate = scores[end - 1] + unknown
            if scores[end] is None or candidate > scores[end]:
                scores[end] = candidate
                # unknown neighbours are one piece, but each of their bytes is one where bytes have pieces
                cost = len(text[end - 1].encode()) if fallback else not open_run[end - 1]
                pieces[end], open_run[end] = pieces[end - 1] + cost, True

        done = 0
        single = False
        for last, (length, score) in self.automaton.iter(text):
            end = last + 1
            if end != done:
                if done and not single:
                    leave_to_unknown(done)
                for gap in range(done + 1, end):
                    leave_to_unknown(gap)
                done, single = end, False
            start = end - length
            candidate = scores[start] + score
            if scores[end] is None or candidate > scores[end]:
                scores[end], pieces[end], open_run[end] = candidate, pieces[start] + 1, False
            single = single or length == 1
        if done and not single:
            leave_to_unknown(done)
        for gap in range(done + 1, size + 1):
            leave_to_unknown(gap)
        return scores[size], pieces[size]

    def count(self, text: str | None) -> tuple[float, int]:
        """(score of the best segmentation, number of its pieces) of a whole text; null or empty: (0.0, 0)."""
        if not text:
            return 0.0, 0
        if not self.by_word or SPACE in text:
            return self._best(self.normalise(text))
        words = text.split(" ")
        if "" in words:  # runs of spaces stay together and before the word that follows
            joined, spaces = [], 0
            for word in words[:-1]:
                if word:
                    joined.append(" " * spaces + word)
                    spaces = 0
                else:
                    spaces += 1
            words = [*joined, " " * spaces + words[-1]]
        known = self.remembered
        found = list(map(known.get, words))
        if None in found:
            for k, (word, pair) in enumerate(zip(words, found, strict=True)):
                if pair is None:
                    found[k] = pair = known.get(word) or self._best(SPACE + word.replace(" ", SPACE))
                    if len(word) <= LONGEST_REMEMBERED and len(known) < REMEMBERED:
                        known[word] = pair
        scores, counts = zip(*found, strict=True)
        return sum(scores), sum(counts)


@lru_cache(maxsize=2)
def counter(vocabulary: Vocabulary, byte_fallback: bool) -> UnigramCounter:
    return UnigramCounter(vocabulary, byte_fallback)


def count_tokens(
    df: DataFrame, vocabulary: Vocabulary, *, byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (id, n_tokens long, best_score double) for each row of ``df``, over whole texts.

    The vocabulary ((piece, score) in order of ids; a fixed size, whatever the corpus) is sent along.
    Null and empty texts have no tokens and score 0; ids may be null or repeated; other columns are not
    looked at; an empty table gives an empty one. Of equal segmentations the tokenizer's own is counted.
    """
    shared = df.sparkSession.sparkContext.broadcast(tuple(vocabulary))

    def prepare() -> Callable[[list, list], list]:
        own = counter(shared.value, byte_fallback)

        def work(ids: list, texts: list) -> list:
            found = [own.count(t) for t in texts]
            return [ids, [n for _, n in found], [s for s, _ in found]]

        return work

    schema = f"`{id_col}` {id_type(df, id_col)}, n_tokens long, best_score double"
    return map_texts(df, schema, prepare, id_col, text_col)


def piece_vocabulary(model_path: str) -> Vocabulary:
    """The pieces and scores of a sentencepiece file, read as a unigram vocabulary."""
    from loomtext.llm.sentencepiece_codec import PieceCodec

    with open(model_path, "rb") as file:
        model = PieceCodec(file.read())
    return tuple(zip(model.pieces, model.scores, strict=True))
