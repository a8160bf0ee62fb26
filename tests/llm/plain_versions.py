"""The operators' results by plain loops, for the tests."""

import hashlib
from collections import defaultdict

from loomtext.llm.common import alnum_words, space_words
from loomtext.llm.decontamination import ONE_IN
from loomtext.llm.decontamination import WINDOW as GRAM
from loomtext.llm.simhash import DISTANCE
from loomtext.llm.substring_dedup import WINDOW


def repeats(texts, window=WINDOW):
    """op1's columns."""
    seen: set[tuple] = set()
    out = {}
    for doc in sorted(texts):
        words = space_words(texts[doc])
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            gram = tuple(words[k : k + window])
            if gram in seen:
                gone[k : k + window] = [True] * window
            seen.add(gram)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = len(words), sum(gone), hashlib.sha256(kept).hexdigest()
    return out


def hits(texts, items, window=GRAM):
    """op5's columns."""
    out = {}
    grams: dict[tuple, set] = defaultdict(set)
    for item, text in items.items():
        words = alnum_words(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            grams[tuple(words[k : k + size])].add(str(item))
    sizes = {len(g) for g in grams}
    for doc, text in texts.items():
        words, hit, found = alnum_words(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if own := grams.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = len(words), len(hit), len(found), digest, bool(hit) and ONE_IN * len(hit) >= len(words)
    return out


def components(prints):
    """op6's id -> component by comparing all pairs."""
    rows = sorted(prints)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, x) in enumerate(rows):
        for b, y in rows[k + 1 :]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= DISTANCE:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i, _ in rows}
