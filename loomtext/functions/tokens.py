"""Tokens and character n-grams as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import WS, present

#: English words left out where no other list is given.
STOP_WORDS = ("the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been", "being")


def ngram_range(value: object) -> tuple[int, int]:
    """(least, most) from a pair, a list or a text such as "2,4"."""
    parts = value.split(",") if isinstance(value, str) else list(value) if isinstance(value, Iterable) else [value]
    numbers = [int(str(p).strip(" ()[]")) for p in parts]
    if len(numbers) != 2 or not 1 <= numbers[0] <= numbers[1]:
        raise ValueError(f"not an n-gram range: {value!r}")
    return numbers[0], numbers[1]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it looks at it: through an array of one."""
    return F.element_at(F.transform(F.array(value), use), 1)


def char_ngrams(text: Column, least: int = 2, most: int = 4) -> Column:
    """Every run of ``least`` to ``most`` code points, repeats included."""

    def longer(chars: Column, runs: Column, n: int, out: list[Column]) -> Column:
        out = [*out, runs] if n >= least else out
        if n == most:
            return F.concat(*out)
        kept = F.slice(runs, 1, F.greatest(F.size(chars) - n, F.lit(0)))
        following = F.zip_with(kept, F.slice(chars, n + 1, F.size(chars)), lambda a, b: F.concat(a, b))
        return once(following, lambda r: longer(chars, r, n + 1, out))

    chars = F.filter(F.split(present(text), ""), lambda c: c != "")
    return once(chars, lambda c: longer(c, c, 1, []))


def word_ngrams(words: Column, least: int = 1, most: int = 1) -> Column:
    """Every run of ``least`` to ``most`` words, joined by a space, repeats included."""

    def runs(own: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(own) - (n - 1), F.lit(1)))
        return F.when(F.size(own) >= n, F.transform(starts, lambda i: F.array_join(F.slice(own, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return once(words, lambda own: F.concat(*[runs(own, n) for n in range(least, most + 1)]))


def padded_ngrams(text: Column, least: int, most: int) -> Column:
    """Runs of characters within words, each word with a space on either side; a run as long as the word or longer is the
    word, once."""

    def of_word(word: Column) -> Column:
        size = F.length(word)

        def runs(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))
            own = F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))
            # shorter words have had their one run at a smaller n
            return own if n == least else F.when(size >= n, own).otherwise(F.array().cast("array<string>"))

        return F.concat(*[runs(n) for n in range(least, most + 1)])

    words = F.transform(tokens(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(words, of_word))


def analysed(text: Column, analyzer: str = "char", least: int = 2, most: int = 4, *, lowercase: bool = False, stop_words: Iterable[str] | None = None) -> Column:
    """What a vectoriser counts: runs of characters (``char``), of those within words (``char_wb``), or of words of two
    letters or digits at least (``word``), without stop words; in lower case if told."""
    text = F.lower(present(text)) if lowercase else present(text)
    if analyzer == "char":
        return char_ngrams(text, least, most)
    if analyzer == "char_wb":
        return padded_ngrams(text, least, most)
    if analyzer != "word":
        raise ValueError(f"unknown analyzer: {analyzer}")
    words = F.regexp_extract_all(text, F.lit(r"(?U)\b\w\w+\b"), 0)
    if stop_words is not None:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    return word_ngrams(words, least, most)


def tokens(
    text: Column,
    how: str | Callable[[Column], Column] = "whitespace",
    *,
    lowercase: bool = False,
    stop_words: Iterable[str] | None = None,
) -> Column:
    """Words between white space, single characters (``char``), or what an own Column function gives."""
    text = present(text)
    text = F.lower(text) if lowercase else text
    if callable(how):
        out = how(text)
    elif how == "whitespace":
        out = F.split(text, f"(?U){WS}+")
    elif how == "char":
        out = F.split(F.regexp_replace(text, f"(?U){WS}+", ""), "")
    else:
        raise ValueError(f"unknown tokenizer: {how}")
    out = F.filter(out, lambda w: w != "")
    if stop_words is not None:
        out = F.filter(out, lambda w: ~w.isin(*stop_words))
    return out
