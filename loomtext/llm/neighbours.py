"""Nearest neighbours by inner product over an index of several hash tables of one binary code.

Codes are signs after learned rotations (iterative quantisation on a bounded sample). A code is split into substrings of
16 bits, each with a table of its own. By the pigeonhole principle a code within Hamming distance r = m * a + b of a query
(m substrings) is within a in one of the first b + 1 substrings, or within a - 1 in one of the others; so looking up
those values alone retrieves every code within r. What is retrieved is checked by its whole code, and ranked by
the inner product of the given vectors.

Equal vectors are one entry with the smallest of their ids, as many as a query can ask for, which is exact: they tie, and
ties go to smaller ids. The entries are dealt to blocks of bounded size; a task builds the tables of a block and the
queries stream past them. So the index is shuffled once, and what a task holds doesn't depend on the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.vectors import lists, matrix, sound_vectors
from loomtext.session import durable

#: Bits of a code (whole substrings of 16), and vectors from which rotations and radii are learned.
BITS, SAMPLE = 256, 8192
#: A query's radius holds as many entries, by the sample's distances; the wider, the higher the recall.
WITHIN = 1500
#: Entries of a block at most on average, and bytes of its vectors.
BLOCK_ROWS, BLOCK_BYTES = 16_384, 32 << 20
#: What looking up a value costs, in entries whose value is looked at one after another.
LOOKUP = 16
#: Stands for an id that is null: after all others.
NO_ID = (1 << 63) - 1

RESULT = "query_id long, rank int, vec_id long, score double"
_FOUND = "query_id long, mark long, times long, vec_id long, score double"
_MOVED = "block int, kind int, id long, mark long, times long, radius int, code binary, v array<double>, ids array<long>"


@lru_cache(maxsize=1)
def _masks() -> tuple[np.ndarray, np.ndarray]:
    """(all values of 16 bits by the number of bits that are set, how many have at most 0, 1, ... of them)."""
    ones = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
    return np.argsort(ones, kind="stable").astype(np.uint16), np.cumsum(np.bincount(ones, minlength=17))


def _rotation(sample: np.ndarray, seed: int, turns: int = 40) -> np.ndarray:
    """Iterative quantisation: signs of the turned sample and the turn that fits them best, in alternation."""
    width = sample.shape[1]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))[0]
    for _ in range(turns):
        u, _, v = np.linalg.svd(np.where(sample @ turn > 0, 1.0, -1.0).T @ sample)
        turn = (u @ v).T
    return turn


@dataclass(frozen=True)
class BinaryCodes:
    """Learned codes: a projection to BITS signs, the longest norm, and the sample's codes for choosing radii.

    Vectors of different norms get one more coordinate that brings all of them to the longest norm, by which the angle to a
    query orders them as the inner product does; a query's is zero.
    """

    projection: np.ndarray
    longest: float
    lifted: bool
    sample: np.ndarray

    @classmethod
    def learn(cls, sample: np.ndarray, longest: float, shortest: float, seed: int = 11) -> BinaryCodes:
        lifted = shortest < longest * (1 - 1e-6)
        given = _lift(sample / longest, lifted)
        narrow = np.eye(given.shape[1])
        if given.shape[1] > BITS:
            narrow = np.linalg.eigh(given.T @ given)[1][:, ::-1][:, :BITS]
        turns = [narrow @ _rotation(given @ narrow, seed + k) for k in range(math.ceil(BITS / narrow.shape[1]))]
        codes = cls(np.hstack(turns)[:, :BITS], longest, lifted, np.zeros((0, BITS // 64), dtype=np.uint64))
        return cls(codes.projection, longest, lifted, codes.of_entries(sample))

    def of_entries(self, vectors: np.ndarray) -> np.ndarray:
        return self._signs(_lift(vectors / self.longest, self.lifted))

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        return self._signs(np.hstack([unit, np.zeros((len(unit), 1))]) if self.lifted else unit)

    def _signs(self, given: np.ndarray) -> np.ndarray:
        return np.packbits(given @ self.projection > 0, axis=1).view(np.uint64)

    def radius(self, code: np.ndarray, entries: int, within: int = WITHIN) -> int:
        """The least radius that holds ``within`` of ``entries`` entries, as far as the sample says; never a cap."""
        place = math.ceil(within * len(self.sample) / max(entries, 1)) + 1
        if place >= len(self.sample):
            return BITS
        apart = np.bitwise_count(self.sample ^ code).sum(axis=1, dtype=np.int64)
        return int(np.partition(apart, place)[place])


def _lift(vectors: np.ndarray, lifted: bool) -> np.ndarray:
    if not lifted:
        return vectors
    return np.hstack([vectors, np.sqrt(np.maximum(0.0, 1.0 - (vectors**2).sum(axis=1, keepdims=True)))])


class Block:
    """The entries of a block, with a table for each substring of their codes."""

    def __init__(self, codes: np.ndarray, vectors: np.ndarray, ids: list[list[int]]):
        self.codes, self.vectors = codes, vectors
        self.ids = np.array([i for own in ids for i in own], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(own) for own in ids])]).astype(np.int64)
        self.words = np.ascontiguousarray(codes.T)
        self.tables = []
        for column in np.ascontiguousarray(codes.view(np.uint16).reshape(len(codes), -1).T):
            order = np.argsort(column, kind="stable")
            first = np.searchsorted(column[order], np.arange((1 << 16) + 1))
            self.tables.append((column, order, first))

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Entries whose code is within ``radius``: all of them, found through the tables and checked by the whole code."""
        masks, upto = _masks()
        near, rest = divmod(radius, len(self.tables))
        hit = np.zeros(len(self.codes), dtype=bool)
        for k, (own, (column, order, first)) in enumerate(zip(code.view(np.uint16), self.tables, strict=True)):
            bits = min(near if k <= rest else near - 1, 16)
            if bits < 0:
                continue
            if LOOKUP * upto[bits] < len(column):
                looked = (masks[: upto[bits]] ^ own).astype(np.int64)
                begins, ends = first[looked], first[looked + 1]
                full = ends > begins
                for begin, end in zip(begins[full].tolist(), ends[full].tolist(), strict=True):
                    hit[order[begin:end]] = True
            else:  # so many values are near that looking at each entry's own costs less than looking them up
                hit |= np.bitwise_count(column ^ own) <= bits
        found = np.flatnonzero(hit)
        words = self.words if 4 * len(found) > len(hit) else self.words[:, found]
        apart = self._apart(words, code)
        return np.flatnonzero(hit & (apart <= radius)) if words is self.words else found[apart <= radius]

    @staticmethod
    def _apart(words: np.ndarray, code: np.ndarray) -> np.ndarray:
        total = np.zeros(words.shape[1], dtype=np.uint16)
        for word, own in zip(words, code, strict=True):
            total += np.bitwise_count(word ^ own)
        return total

    def nearest(self, code: np.ndarray, radius: int, vector: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best entries within the radius, without the query's own row.

        Where fewer than k other rows are within it, the radius grows until enough are.
        """
        found = self.probe(code, radius)
        sizes = np.diff(self.starts)
        if sizes[found].sum() <= k and len(found) < len(sizes):
            apart = self._apart(self.words, code)
            order = np.argsort(apart, kind="stable")
            enough = min(int(np.searchsorted(np.cumsum(sizes[order]), k + 1)), len(order) - 1)
            found = self.probe(code, int(apart[order[enough]]))
        scores = (self.vectors[found] * vector).sum(axis=1)
        if len(found) > k + 1:
            best = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            found, scores = found[best], scores[best]
        each = sizes[found]
        at = np.repeat(self.starts[found] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
        ids, scores, entry = self.ids[at], np.repeat(scores, each), np.repeat(found, each)
        own = np.flatnonzero((ids == query_id) & (self.vectors[entry] == vector).all(axis=1))[:1]
        ids, scores = np.delete(ids, own), np.delete(scores, own)
        order = np.lexsort([ids, -scores])[:k]
        return ids[order], scores[order]


def _index_entries(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): every different vector once, with the k + 1 smallest ids of its rows.

    The ranks are cut before the shuffle too, so a vector with very many copies moves few rows.
    """
    ids = rows.select("v", F.coalesce("id", F.lit(NO_ID)).alias("id"))
    ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _search_blocks(k: int, dim: int, codes: BinaryCodes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, held = None, None, []
        for batch in batches:
            places, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(kinds) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(places)], strict=True):
                if begin == end:
                    continue
                if places[begin] != at:
                    at, block, held = places[begin], None, []
                part = batch.slice(begin, end - begin)
                if kinds[begin] == 0:
                    held.append((matrix(part.column(7), dim), part.column(8).to_pylist()))
                    continue
                if block is None and held:
                    vectors = np.concatenate([v for v, _ in held])
                    block = Block(codes.of_entries(vectors), vectors, [i for _, own in held for i in own])
                    held = []
                if block is not None:
                    yield from _answer(block, part, k, dim)

    return run


def _answer(block: Block, part: pa.RecordBatch, k: int, dim: int) -> Iterator[pa.RecordBatch]:
    rows: list[list[np.ndarray]] = [[], [], [], [], []]
    vectors = matrix(part.column(7), dim)
    for n, (query_id, mark, times, radius, code) in enumerate(zip(*(part.column(c).to_pylist() for c in range(2, 7)), strict=True)):
        ids, scores = block.nearest(np.frombuffer(code, dtype=np.uint64), radius, vectors[n], query_id, k)
        for out, value in zip(rows, (query_id, mark, times), strict=False):
            out.append(np.full(len(ids), value, dtype=np.int64))
        rows[3].append(ids)
        rows[4].append(scores)
    yield pa.record_batch([pa.array(np.concatenate(c)) for c in rows], names=[f.split()[0] for f in _FOUND.split(", ")])


def nearest_neighbours(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20, block_rows: int = BLOCK_ROWS, within: int = WITHIN
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``every``.

    All rows with a sound vector other than zero take part (see ``sound_vectors``), whatever their id: rows of a null id
    are candidates with a null vec_id, ranked after equal scores. A query's own row is no candidate, others with its id or
    vector are. Of repeated query rows each gets its own result. With k candidates or fewer all are returned.
    """
    spark = df.sparkSession
    rows, dim = sound_vectors(df, id_col, vec_col)
    rows = rows.filter(F.exists("v", lambda c: c != 0))
    entries = durable(_index_entries(rows, k))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    facts = entries.agg(F.count("*").alias("n"), F.max(norm).alias("longest"), F.min(norm).alias("shortest")).first()
    n = facts["n"]
    if not n:
        return spark.createDataFrame([], RESULT)
    taught = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow().column("v").combine_chunks()
    codes = BinaryCodes.learn(matrix(taught, dim), facts["longest"], facts["shortest"])

    full = min(block_rows, max(1, BLOCK_BYTES // (8 * dim)))
    blocks = max(math.ceil(n / full), min(spark.sparkContext.defaultParallelism, math.ceil(n / (full / 8))))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column(3), dim)
                own = codes.of_queries(vectors)
                radii = pa.array([codes.radius(c, n, within) for c in own], pa.int32())
                columns = [*(batch.column(c) for c in range(3)), radii, pa.array([c.tobytes() for c in own], pa.binary()), lists(vectors)]
                yield pa.record_batch(columns, names=["id", "mark", "times", "radius", "code", "v"])

    asked = rows.filter(F.col("id") % every == 0).groupBy("id", "v").agg(F.count("*").alias("times"))
    asked = asked.select("id", F.xxhash64("v").alias("mark"), "times", "v").mapInArrow(
        coded, "id long, mark long, times long, radius int, code binary, v array<double>"
    )
    asked = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "mark", "times", "radius", "code", "v",
        F.lit(None).cast("array<long>").alias("ids"),
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("mark", "long"), ("times", "long"), ("radius", "int"), ("code", "binary"))]
    stored = entries.select(F.pmod(F.xxhash64(F.lit(7), "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), *none, "v", "ids")
    moved = stored.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    found = moved.mapInArrow(_search_blocks(k, dim, codes), _FOUND)
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    each = ranked.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return each.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
