"""Benchmark decontamination: documents are scanned for the normalised n-grams of test items.

The n-grams of a block of items go to every worker as sorted arrays of hashes, whose size is checked before; token
windows that are among them by their hash are verified byte by byte. More items than one block holds are scanned block
after block, and the hits of all blocks are put together before anything is decided.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import ALNUM_TABLE, alnum_words, chunks, id_type, map_texts

WINDOW = 13
#: A document is contaminated if a word in this many is hit.
ONE_IN = 20
#: Most bytes of test text in a block. Its index takes some five times as much (30 bytes for a word of six), which is
#: what every worker holds, once.
BLOCK_BYTES = 32 << 20
#: Bytes that a piece counts besides its text, and words of a piece: a longer item is cut into pieces that overlap.
PIECE_BYTES, PIECE_WORDS = 64, 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` word hashes, put together from windows of powers of two."""
    n = len(words) - size + 1
    out, done, part, width, power = None, 0, words, 1, _BASE
    while True:
        if size & width:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * power + piece
            done += width
        if done == size:
            return (out ^ (out >> np.uint64(31))) * _MIX
        part = part[:-width] * power + part[width:]
        power = np.uint64(int(power) ** 2 % (1 << 64))
        width *= 2


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Grams:
    """All windows of one length: their hashes, sorted, where one of each stands, and the items that have it."""

    def __init__(self, h: np.ndarray, at: np.ndarray, item: np.ndarray, said: Callable[[int], bytes]):
        order = np.lexsort((item, h))
        h, at, item = h[order], at[order], item[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        # windows with one hash are compared; should two of them differ, each becomes a gram of its own
        for k in np.flatnonzero(~new).tolist():
            if said(int(at[k])) != said(int(at[k - 1])):
                b, e = k, k + 1
                while b and not new[b]:
                    b -= 1
                while e < len(h) and h[e] == h[k]:
                    e += 1
                by = sorted(range(b, e), key=lambda j: (said(int(at[j])), int(item[j])))
                at[b:e], item[b:e] = at[by], item[by]
                new[b + 1 : e] = [said(int(at[j])) != said(int(at[j - 1])) for j in range(b + 1, e)]
        first = np.flatnonzero(new)
        self.hashes, self.at = h[first], at[first]
        fresh = new | np.concatenate([[True], item[1:] != item[:-1]])
        self.items = item[fresh]
        self.edges = np.searchsorted(np.flatnonzero(fresh), np.append(first, len(h))).astype(np.int64)
        self.bits = max(10, min(24, int(len(self.hashes)).bit_length() + 3))
        table = np.zeros(1 << self.bits, bool)
        table[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.table = table

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.at, self.items, self.edges, self.table))

    def likely(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``h``, number of the first gram with that hash) for the hashes that are known."""
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        found = np.searchsorted(self.hashes, h[at])
        found[found == len(self.hashes)] = 0
        known = self.hashes[found] == h[at] if len(self.hashes) else np.zeros(len(at), bool)
        return at[known], found[known]


class WindowIndex:
    """Windows of test items, as arrays: the items' words one after another, and the grams by length.

    ``items`` are (id, text) pairs; an id may come several times, null counts as one id.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.ids = sorted({i for i, _ in items}, key=lambda i: (i is None, i or ""))
        number = {i: k for k, i in enumerate(self.ids)}
        lists = [(number[i], words) for i, t in items if (words := alnum_words(t))]
        counts = np.array([len(w) for _, w in lists], np.int64)
        flat = [w for _, words in lists for w in words]
        self.data = b" ".join(flat)
        self.ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
        self.begins = np.concatenate([[0], self.ends[:-1] + 1]) if flat else np.zeros(0, np.int64)
        hashes, starts = _word_hashes(flat), np.cumsum(counts) - counts
        self.grams: dict[int, Grams] = {}
        for size in sorted({min(window, n) for n in counts.tolist()}):
            own = np.flatnonzero(counts >= window if size == window else counts == size)
            per = counts[own] - size + 1
            at = np.repeat(starts[own] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
            item = np.repeat(np.array([lists[k][0] for k in own.tolist()], np.int32), per)
            self.grams[size] = Grams(rolled(hashes, size)[at], at, item, lambda k, size=size: self.said(k, size))

    def said(self, at: int, size: int) -> bytes:
        """The window's words, joined by a space."""
        return self.data[self.begins[at] : self.ends[at + size - 1]]

    @property
    def nbytes(self) -> int:
        return len(self.data) + self.begins.nbytes + self.ends.nbytes + sum(g.nbytes for g in self.grams.values())

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[str | None]]]:
        """For each text: number of words, hit stretches [from, to) of words, items of which a window occurs (null last)."""
        lists = [alnum_words(t) for t in texts]
        counts = np.array([len(w) for w in lists], np.int64)
        starts = np.cumsum(counts) - counts
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        found: list[set[int]] = [set() for _ in texts]
        hashes = _word_hashes([w for words in lists for w in words])
        for size, grams in self.grams.items():
            if len(hashes) < size:
                continue
            places, which = grams.likely(rolled(hashes, size))
            rows = np.searchsorted(starts, places, "right") - 1
            inside = places + size <= starts[rows] + counts[rows]
            for row, place, gram in zip(rows[inside].tolist(), places[inside].tolist(), which[inside].tolist(), strict=True):
                first = place - int(starts[row])
                text = b" ".join(lists[row][first : first + size])
                h = grams.hashes[gram]
                while gram < len(grams.hashes) and grams.hashes[gram] == h:
                    if self.said(int(grams.at[gram]), size) == text:
                        spans[row].append((first, first + size))
                        found[row].update(grams.items[grams.edges[gram] : grams.edges[gram + 1]].tolist())
                        break
                    gram += 1
        for count, span, own in zip(counts.tolist(), spans, found, strict=True):
            yield count, merged(span), [self.ids[k] for k in sorted(own)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching stretches put together, in order."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def pieces_of(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(item, text): the items' normalised words, an item of many words as pieces that share ``window`` - 1 words.

    A piece has at least one window that no other piece of the item has; items without words give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1):
            items, texts = [], []
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = alnum_words(text)
                for k in range(0, max(len(words) - window + 1, min(len(words), 1)), PIECE_WORDS):
                    items.append(item)
                    texts.append(b" ".join(words[k : k + PIECE_WORDS + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    return benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).mapInArrow(run, "item string, text string")


def blocks_of(benchmark: DataFrame, block_bytes: int, item_col: str, text_col: str, window: int = WINDOW) -> list[DataFrame]:
    """The benchmark's pieces in blocks, one of which at a time is on the driver and the workers.

    Every block's size is checked; there are more blocks until each one is within ``block_bytes`` or a single piece.
    """
    pieces = pieces_of(benchmark, window, item_col, text_col)
    size = F.octet_length("text") + F.lit(PIECE_BYTES)
    total = pieces.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    if total <= block_bytes:
        return [pieces]
    count = 2 * -(-total // block_bytes)
    while True:
        key = F.pmod(F.xxhash64("item", "text"), F.lit(count))
        most = pieces.groupBy(key.alias("k")).agg(F.sum(size).alias("n"), F.count_distinct("item", "text").alias("pieces")).filter(F.col("pieces") > 1).agg(F.max("n")).first()[0]
        if (most or 0) <= block_bytes:
            return [pieces.filter(key == k) for k in range(count)]
        count *= 2


def _index_of(block: DataFrame, window: int):
    """The block's index, broadcast: equal pieces once."""
    return block.sparkSession.sparkContext.broadcast(WindowIndex([tuple(r) for r in block.distinct().collect()], window))


_HIT = "spans array<struct<begin:int,end:int>>, items array<string>"


def _scan(df: DataFrame, block: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, spans, items) of each row by one block."""
    shared = _index_of(block, window)

    def prepare() -> Callable[[list, list], list]:
        index = shared.value

        def work(ids: list, texts: list) -> list:
            counts, spans, items = zip(*index.scan(texts), strict=True)
            return [ids, list(counts), [[{"begin": b, "end": e} for b, e in s] for s in spans], list(items)]

        return work

    return map_texts(df, f"`{id_col}` {id_type(df, id_col)}, n_words long, {_HIT}", prepare, id_col, text_col)


def _address(text_col: str) -> Column:
    """Hits depend on the text alone, so rows meet the hits of several blocks by their content's address."""
    return F.sha2(F.col(text_col), 256)


def _hits_together(df: DataFrame, blocks: list[DataFrame], window: int, text_col: str) -> DataFrame:
    """(k, n_words, spans, items) for each content with hits: those of all blocks. Texts aren't moved."""
    texts = df.select(_address(text_col).alias("k"), F.col(text_col).alias("t"))
    found = [_scan(texts, b, window, "k", "t").filter(F.size("spans") > 0) for b in blocks]
    # copies of a content have the same spans and items in a block; a set keeps one of them
    return reduce(DataFrame.unionByName, found).groupBy("k").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def find_hits(
    df: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each row of ``df``: id, n_words, n_hit, items (sorted as strings, null last), spans of hit words.

    An item with fewer words than a window, but not none, is one window. Null and empty texts have no
    words; ids may be null or repeated (each row has its own result); items with equal ids count once;
    items without an id are scanned like any other and count as one, null, in ``items``; other columns are not looked
    at; empty tables give no rows or no hits. Texts and items of any length are scanned whole.
    A benchmark beyond ``block_bytes`` is scanned in several blocks and the hits put together by row.
    """
    blocks = blocks_of(benchmark, block_bytes, item_col, item_text_col, window)
    if len(blocks) == 1:
        return _with_counts(_scan(df, blocks[0], window, id_col, text_col), id_col)
    hits = _hits_together(df, blocks, window, text_col).drop("n_words")
    counted = F.regexp_count(F.col(text_col), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    rows = df.select(F.col(id_col), F.coalesce(counted, F.lit(0)).alias("n_words"), _address(text_col).alias("own"))
    out = rows.join(hits, F.col("own") == F.col("k"), "left")
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    return _with_counts(out.select(id_col, "n_words", none("spans", "array<struct<begin:int,end:int>>"), none("items", "array<string>")), id_col)


def _with_counts(found: DataFrame, id_col: str) -> DataFrame:
    """n_hit counts the words that the stretches cover, each once."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate(
        F.array_sort("spans"),
        start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], a["to"]))).alias("n"),
            F.greatest(a["to"], s["end"]).alias("to"),
        ),
        lambda a: a["n"].cast("long"),
    )
    return found.select(id_col, "n_words", covered.alias("n_hit"), "items", "spans")


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (F.lit(ONE_IN) * n_hit >= n_words)


def report(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The hits in digest form: n_words, n_hit, n_items, items_sha256, contaminated.

    Items without an id count as one in n_items; the digest is of the ids alone.
    """
    id_col = options.get("id_col", "doc_id")
    return find_hits(df, benchmark, **options).select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def clean(
    df: DataFrame,
    benchmark: DataFrame,
    *,
    remove: str = "documents",
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``df`` with its own columns, without contaminated documents or (``remove="spans"``) without hit words.

    Columns of any name and repeated rows pass as they are. With ``spans``, what stands between the first and the
    last character of a hit stretch is taken out. A benchmark beyond ``block_bytes`` is scanned in several blocks;
    the hits of all of them are put together for each content before the rule or the cut, so results are the same.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    blocks = blocks_of(benchmark, block_bytes, item_col, item_text_col, window)
    if len(blocks) == 1:
        return _clean_by(df, blocks[0], remove, window, text_col)
    hits = _hits_together(df, blocks, window, text_col)
    rows = df.select(F.struct("*").alias("row"), _address(text_col).alias("k"))
    if remove == "documents":
        dirty = _with_counts(hits, "k").filter(is_contaminated(F.col("n_hit"), F.col("n_words")))
        return rows.join(dirty.select("k"), "k", "left_anti").select("row.*")
    spans = "spans"
    while spans.lower() in map(str.lower, df.columns):
        spans += "_"
    return _cut(rows.join(hits.select("k", F.col("spans").alias(spans)), "k", "left").select("row.*", spans), df, text_col)


def _cut(found: DataFrame, df: DataFrame, text_col: str) -> DataFrame:
    """The rows of ``found`` (those of ``df`` and, last, their hit stretches or null) without the words of the stretches."""
    at, last = df.columns.index(text_col), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, at):
            rows = zip(part.column(at).to_pylist(), part.column(last).to_pylist(), strict=True)
            cut = [without(t, merged([(x["begin"], x["end"]) for x in s])) if s else t for t, s in rows]
            own = pa.RecordBatch.from_arrays(part.columns[:last], schema=pa.schema([part.schema.field(k) for k in range(last)]))
            yield own.set_column(at, own.schema.field(at), pa.array(cut, own.schema.field(at).type))

    return found.mapInArrow(run, df.schema)


def _clean_by(df: DataFrame, block: DataFrame, remove: str, window: int, text_col: str) -> DataFrame:
    shared, at = _index_of(block, window), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in chunks(batches, at):
            texts = part.column(at).to_pylist()
            found = list(index.scan(texts))
            if remove == "spans":
                cut = [without(t, s) if s else t for t, (_, s, _) in zip(texts, found, strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(cut, part.schema.field(at).type))
            else:
                hit = [sum(e - b for b, e in s) for _, s, _ in found]
                yield part.filter(pa.array([not (h and ONE_IN * h >= n) for h, (n, _, _) in zip(hit, found, strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the stretches and what stands between those."""
    data = text.encode()
    letters = np.frombuffer(data.translate(ALNUM_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], letters.view(np.int8), [0]])))
    begins, ends = edges[::2], edges[1::2]
    out, last = bytearray(), 0
    for begin, end in spans:
        out += data[last : begins[begin]]
        last = int(ends[end - 1])
    return bytes(out + data[last:]).decode()
