"""Alignment of two tokenizers over the same bytes, and how often their tokens stand for each other in the corpus.

A text gets one label a byte: no token ends there, one of A's, one of B's, or both. A regular expression takes the spans up
to each label of both kinds; the labels in a span count its tokens of either side, which are a group. Groups of the whole
corpus give links (the tokens that end a group together), whose counts are put together before each document's links are
looked up in them.

Neither tokenizer has a token across a single space between non-spaces, so texts are cut there, and a worker
aligns every different part once, as far as its memory of parts goes. Parts are aligned, never sampled or cut short.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import chunks, id_type
from loomtext.session import durable, spread

#: Labels of a byte. The expression takes a span that ends where both tokenizers end a token.
NONE, A_END, B_END, BOTH = b"-ab+"
SPAN = re.compile(rb"[^+]*\+")
#: A boundary that no token of either side crosses; what follows keeps its space.
PART = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"
#: Parts that a worker remembers, and the longest that it does.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64
#: Link counts that are sent to all workers; more are joined instead.
MOST_SENT = 2_000_000

COLUMNS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass(frozen=True)
class Alignment:
    """Token ids and the byte places where they end; for each group its end and its numbers of tokens of A and B."""

    a_ids: list[int]
    b_ids: list[int]
    a_ends: np.ndarray
    b_ends: np.ndarray
    groups: list[tuple[int, int, int]]

    def text(self) -> str:
        """``a1,a2|b1;a3|b2,b3``."""
        out, i, k = [], 0, 0
        for _, a, b in self.groups:
            out.append(f"{','.join(map(str, self.a_ids[i : i + a]))}|{','.join(map(str, self.b_ids[k : k + b]))}")
            i, k = i + a, k + b
        return ";".join(out)

    def links(self) -> list[tuple[int, int]]:
        """The pairs of tokens that end together: no token is empty, so there is one a group."""
        out, i, k = [], 0, 0
        for _, a, b in self.groups:
            i, k = i + a, k + b
            out.append((self.a_ids[i - 1], self.b_ids[k - 1]))
        return out


def label_string(length: int, a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
    """A label for each byte of a text of ``length`` bytes; an end is the place after a token's last byte."""
    a, b = np.zeros(length, dtype=np.uint8), np.zeros(length, dtype=np.uint8)
    a[a_ends - 1] = 1
    b[b_ends - 1] = 2
    return np.frombuffer(bytes((NONE, A_END, B_END, BOTH)), dtype=np.uint8)[a + b].tobytes()


def groups_of(labels: bytes) -> list[tuple[int, int, int]]:
    """(end, tokens of A, tokens of B) of each span up to a label of both kinds."""
    return [(m.end(), m[0].count(b"a") + 1, m[0].count(b"b") + 1) for m in SPAN.finditer(labels)]


class TokenAligner:
    """A: a byte-level BPE of the ``tokenizers`` library (its JSON). B: a sentencepiece model that adds a space in front.

    Special tokens are neither added nor recognised.
    """

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        back = {c: b for b, c in _byte_letters().items()}
        names = {i: piece for piece, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(back[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_length = np.array([len(p) for p in self.a_bytes])
        self.b_length = np.array([len(p) for p in self.b_bytes])
        #: Whether texts may be cut: no piece has a space after something else, and none is changed by normalisation.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces) and self.b.normalize("a  b ﬁ ") == f"{SPACE}a{SPACE}{SPACE}b ﬁ{SPACE}"
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        self.spans = _SpanCounts()
        self.a_names = np.array([[f"{i}{end}" for i in range(len(self.a_length))] for end in ",|"], dtype=object)
        self.b_names = np.array([[f"{i}{end}" for i in range(len(pieces))] for end in ",;"], dtype=object)

    def align(self, texts: list[str | None]) -> list[Alignment | None]:
        """Of whole texts; None for a text that is null or empty, or whose tokens don't spell a space and the text."""
        full = [t for t in texts if t]
        a_side = self.a.encode_batch([" " + t for t in full], add_special_tokens=False)
        b_side = self.b.encode(full, num_threads=1) if full else []
        found = iter([self._one(t, a.ids, b) for t, a, b in zip(full, a_side, b_side, strict=True)])
        return [next(found) if t else None for t in texts]

    def _one(self, text: str, a_ids: list[int], b_ids: list[int]) -> Alignment | None:
        want = (" " + text).encode()
        a_parts, b_parts = [self.a_bytes[i] for i in a_ids], [self.b_bytes[i] for i in b_ids]
        if b"".join(a_parts) != want or b"".join(b_parts) != want:
            return None
        a_ends, b_ends = np.cumsum([len(p) for p in a_parts]), np.cumsum([len(p) for p in b_parts])
        return Alignment(a_ids, b_ids, a_ends, b_ends, groups_of(label_string(len(want), a_ends, b_ends)))

    def summaries(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, groups_sha256, links, times) of each text; a link is A's id * 2^32 + B's id."""
        parts = [([t] if not self.cuts else PART.split(t)) if t else [] for t in texts]
        known = self._know(set().union(*parts))
        return [self._summary([known[p] for p in own]) for own in parts]

    def _know(self, wanted: set[str]) -> dict[str, tuple | None]:
        """Values of these parts, and of others. Parts of the last REMEMBERED new ones, or used since, stay in memory."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        here = self.known
        older = self.older
        for part in wanted - here.keys():
            if part in older:
                here[part] = older[part]
        fresh = sorted(wanted - here.keys())
        if not fresh:
            return here
        solid = [p for p in fresh if _solid(p)] if self.cuts else []
        apart = [p for p in fresh if not _solid(p)] if self.cuts else fresh
        values = dict(zip(solid, self._values(solid, True), strict=True)) if solid else {}
        if apart:
            values |= zip(apart, self._values(apart, False), strict=True)
        here.update((p, v) for p, v in values.items() if len(p) <= LONGEST_REMEMBERED)
        return here if len(values.keys() & here.keys()) == len(values) else {p: values[p] if p in values else here[p] for p in wanted}

    def _values(self, parts: list[str], solid: bool) -> list[tuple | None]:
        """(n_a, n_b, n_groups, text of the groups, links as bytes) of each part: one label string and one scan for all.

        Solid parts go through A as one text; white space at an end could be read together with a neighbour's.
        """
        want = (" " + " ".join(parts)).encode()
        given = [" " + " ".join(parts)] if solid else [" " + p for p in parts]
        a_ids = [i for e in self.a.encode_batch_fast(given, add_special_tokens=False) for i in e.ids]
        b_ids = [i for own in self.b.encode(parts, num_threads=1) for i in own]
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        if b"".join([a_bytes[i] for i in a_ids]) != want or b"".join([b_bytes[i] for i in b_ids]) != want:
            if len(parts) == 1:
                return [None]
            half = len(parts) // 2
            return self._values(parts[:half], solid) + self._values(parts[half:], solid)
        a_all, b_all = np.array(a_ids), np.array(b_ids)
        a_ends, b_ends = np.cumsum(self.a_length[a_all]), np.cumsum(self.b_length[b_all])
        spans = SPAN.findall(label_string(len(want), a_ends, b_ends))
        packed = np.fromiter(map(self.spans.__getitem__, spans), dtype=np.int64, count=len(spans))
        counts = np.stack([packed >> 32, packed & 0xFFFFFFFF], axis=1)
        a_at, b_at = np.cumsum(counts, axis=0).T
        links = (a_all[a_at - 1] << 32 | b_all[b_at - 1]).astype(np.int64)
        names = self._names(a_all, b_all, a_at, b_at, counts)
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        cut = np.searchsorted(a_ends[a_at - 1], ends) + 1
        a_cut, b_cut, cut = a_at[cut - 1].tolist(), b_at[cut - 1].tolist(), cut.tolist()
        out, a0, b0, g0, blob = [], 0, 0, 0, links.tobytes()
        for a1, b1, g1 in zip(a_cut, b_cut, cut, strict=True):
            out.append((a1 - a0, b1 - b0, g1 - g0, "".join(names[a0 + b0 : a1 + b1]), blob[8 * g0 : 8 * g1]))
            a0, b0, g0 = a1, b1, g1
        return out

    def _names(self, a_all: np.ndarray, b_all: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, counts: np.ndarray) -> list[str]:
        """The ids as text with what follows each, in the order of the groups: ``a1,`` ``a2|`` ``b1;``."""
        a_last, b_last = np.zeros(len(a_all), dtype=np.int64), np.zeros(len(b_all), dtype=np.int64)
        a_last[a_at - 1] = b_last[b_at - 1] = 1
        a_place = np.arange(len(a_all)) + np.repeat(b_at - counts[:, 1], counts[:, 0])
        b_place = np.arange(len(b_all)) + np.repeat(a_at, counts[:, 1])
        out = np.empty(len(a_all) + len(b_all), dtype=object)
        out[a_place] = self.a_names[a_last, a_all]
        out[b_place] = self.b_names[b_last, b_all]
        return out.tolist()

    def _summary(self, values: list[tuple | None]) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        if not values or None in values:  # a part without tokens: the whole text has none
            return 0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        a, b, groups, texts, links = zip(*values, strict=True)
        keys, times = np.unique(np.frombuffer(b"".join(links), dtype=np.int64), return_counts=True)
        return sum(a), sum(b), sum(groups), hashlib.sha256("".join(texts)[:-1].encode()).hexdigest(), keys, times


class _SpanCounts(dict):
    """Tokens of A * 2^32 + tokens of B in a span of labels; spans are few, so each is counted once."""

    def __missing__(self, span: bytes) -> int:
        found = span.count(b"a") + 1 << 32 | span.count(b"b") + 1
        if len(span) <= LONGEST_REMEMBERED and len(self) < REMEMBERED:
            self[span] = found
        return found


def _solid(part: str) -> bool:
    return not (part[0].isspace() or part[-1].isspace())


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def _aligner(a_json: str, b_model: bytes) -> TokenAligner:
    return TokenAligner(a_json, b_model)


def align_documents(docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, links array<long>, times array<long>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_json, b_model)
        for part in chunks(batches, 1, 1 << 20):
            found = aligner.summaries(part.column(1).to_pylist())
            n_a, n_b, n_groups, digests, links, times = zip(*found, strict=True)
            counts = [pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups)]
            yield pa.record_batch([part.column(0), *counts, pa.array(digests), _ragged(links), _ragged(times)], names=names)

    names = ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times"]
    schema = f"id {id_type(docs, id_col)}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>, times array<long>"
    return spread(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, schema)


def _ragged(rows: Iterable[np.ndarray]) -> pa.Array:
    rows = list(rows)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(rows).astype(np.int64)))


def link_counts(aligned: DataFrame) -> DataFrame:
    """(link, n, best): each link's corpus-wide count, and whether its B id has no link with a higher one.

    A task adds up what its documents hold before anything is shuffled.
    """
    each = aligned.select(F.explode(F.arrays_zip("links", "times")).alias("x")).select(F.col("x.links").alias("link"), F.col("x.times").alias("times"))
    counts = each.groupBy("link").agg(F.sum("times").alias("n"))
    highest = counts.groupBy(F.col("link").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("top"))
    keyed = counts.withColumn("b", F.col("link").bitwiseAND(0xFFFFFFFF))
    return keyed.join(highest, "b").select("link", "n", (F.col("n") == F.col("top")).alias("best"))


def _by_lookup(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Every document's links looked up in all counts, sent to the workers as sorted arrays (17 bytes a link)."""
    table = counts.orderBy("link").toArrow().combine_chunks()
    sent = aligned.sparkSession.sparkContext.broadcast(
        (table.column("link").to_numpy(), table.column("n").to_numpy(), table.column("best").to_numpy(zero_copy_only=False))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, n, best = sent.value
        for batch in batches:
            column = batch.column(5)
            own, times = column.flatten().to_numpy(), batch.column(6).flatten().to_numpy()
            lengths = np.diff(column.offsets.to_numpy())
            at = np.searchsorted(links, own)
            row = np.repeat(np.arange(len(lengths)), lengths)
            sums = [np.zeros(len(lengths), dtype=np.int64) for _ in range(3)]
            for total, value in zip(sums, (times, times * best[at], times * n[at]), strict=True):
                np.add.at(total, row, value)
            yield pa.record_batch([*(batch.column(c) for c in range(4)), *map(pa.array, sums), batch.column(4)], names=names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return aligned.mapInArrow(run, f"id {dict(aligned.dtypes)['id']}, {COLUMNS}")


def _by_join(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join on links: a frequent link's documents are dealt to several tasks, its one count goes to each."""
    salts = 32
    numbered = aligned.withColumn("row", F.monotonically_increasing_id())
    numbered = durable(numbered)
    each = numbered.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select(
        "row", F.col("x.links").alias("link"), F.col("x.times").alias("times"), F.pmod("row", F.lit(salts)).cast("int").alias("salt")
    )
    dealt = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sums = each.join(dealt, ["link", "salt"]).groupBy("row").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return numbered.join(sums, "row", "left").select("id", "n_a", "n_b", "n_groups", *zero, "groups_sha256")


def alignment_report(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_sent: int = MOST_SENT
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    Texts are encoded once; what is read twice (links and how often a document has each) is written to the checkpoint
    folder. Null and empty texts, and texts that a tokenizer doesn't spell as given (U+2581 in it), have zeros and ''. Rows
    of null or repeated ids get a row each; other columns are left behind. Up to ``most_sent`` different links are sent
    to all workers, more are joined.
    """
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        aligned = durable(align_documents(docs, a.read(), b.read(), id_col, text_col))
    counts = durable(link_counts(aligned))
    summed = _by_lookup(aligned, counts) if counts.count() <= most_sent else _by_join(aligned, counts)
    return summed.withColumnRenamed("id", id_col)
