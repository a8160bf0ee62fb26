"""Substring dedup: words that stand in a window of words seen earlier in the corpus are removed.

1. Every task makes count-min sketches of its windows: the cells of two hash rows, those hit once and those hit
   again. Fragments are merged by ranges of cells; a merged cell only ever overestimates. What is kept is a bit for
   each cell that was hit twice or more.
2. A second pass looks at the windows whose cells all say "repeated". Those that are repeated within a block of
   documents are settled there; of each window a block sends on only its first place. These are dealt out by the window's hash and
   grouped exactly by 96 bits; every place in a document after the first one is sent back to its document.
3. The documents, their texts packed, meet their repeated windows and lose the covered words.

A sketch has a bounded size. Beyond it more windows are estimated repeated, which costs traffic but loses none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import chunks, id_type, space_words

WINDOW = 20
#: Cells of a sketch row: for each expected window so many, in whole ranges, but no more than so many ranges (32 MB as bits).
CELLS_A_WINDOW, MOST_RANGES = 1.9, 64
#: Bytes of text for each expected window.
BYTES_A_WINDOW = 6
#: 2 to this power: cells of a range that is merged by one task at a time.
RANGE = 22
#: Windows in a fragment, candidates in a block, windows for each bucket of the exact pass.
FRAGMENT, BLOCK, BUCKET = 4 << 20, 3 << 20, 2 << 20

_LAST = np.iinfo(np.int64).max
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes (modulo 2 to the 64) of all windows, put together from windows of powers of two."""
    n = len(words) - size + 1
    out, done, part, width, power = None, 0, words, 1, base
    while True:
        if size & width:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * power + piece
            done += width
        if done == size:
            return _mixed(out)
        part = part[:-width] * power + part[width:]
        power = np.uint64(int(power) ** 2 % (1 << 64))
        width *= 2


class Windows:
    """Window hashes of a chunk of texts: 64 bits, 32 more, and where each stands."""

    def __init__(self, texts: list[str | None], size: int):
        words = [space_words(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for own in words for w in own), np.uint64, int(counts.sum()))
        per_row = np.maximum(counts - size + 1, 0)
        ends = np.cumsum(counts)
        self.row = np.repeat(np.arange(len(texts)), per_row)
        first = np.repeat(np.cumsum(per_row) - per_row, per_row)
        self.at = np.arange(len(self.row)) - first
        place = np.repeat(ends - counts, per_row) + self.at
        if len(self.row):
            self.h = _rolled(flat, size, _ODD[0])[place]
            self.g = (_rolled(flat ^ (flat >> np.uint64(29)), size, _ODD[1])[place] >> np.uint64(32)).astype(np.uint32)
        else:
            self.h, self.g = np.zeros(0, np.uint64), np.zeros(0, np.uint32)



def cells_of(h: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each window in both hash rows: halves of the hash, scaled to the number of cells."""
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return [((half * np.uint64(cells)) >> np.uint64(32)).astype(np.uint32) for half in (low, high)]


def packed(numbers: np.ndarray) -> bytes:
    """Rising numbers as differences of one or two bytes; larger ones stand apart."""
    gaps = np.diff(numbers.astype(np.int64), prepend=0)
    kind = np.uint8 if len(gaps) and gaps.mean() < 90 else np.uint16
    top = np.iinfo(kind).max
    large = gaps >= top
    head = np.array([len(gaps), kind == np.uint8], np.uint32)
    return head.tobytes() + np.where(large, top, gaps).astype(kind).tobytes() + gaps[large].astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n, one = np.frombuffer(data, np.uint32, 2).tolist()
    kind = np.uint8 if one else np.uint16
    gaps = np.frombuffer(data, kind, n, 8).astype(np.int64)
    large = gaps == np.iinfo(kind).max
    gaps[large] = np.frombuffer(data, "<u4", int(large.sum()), 8 + n * (1 if one else 2))
    return np.cumsum(gaps)


def sketch_fragments(docs: DataFrame, ranges: int, size: int) -> DataFrame:
    """(row, range, once, again): cells that a fragment's windows hit, and those that they hit more than once."""
    schema = pa.schema([("r", pa.int32()), ("s", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])

    def emit(kept: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        h = np.concatenate(kept)
        for r, cells in enumerate(cells_of(h, ranges << RANGE)):
            cells.sort()
            new = np.concatenate([[True], cells[1:] != cells[:-1]])
            once = cells[new]
            again = np.unique(cells[~new])
            edges = np.arange(ranges + 1, dtype=np.int64) << RANGE
            cut_once, cut_again = np.searchsorted(once, edges), np.searchsorted(again, edges)
            for s in range(len(edges) - 1):
                if cut_once[s] < cut_once[s + 1]:
                    base = np.uint32(edges[s])
                    rows.append((r, s, packed(once[cut_once[s] : cut_once[s + 1]] - base), packed(again[cut_again[s] : cut_again[s + 1]] - base)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for part in chunks(batches, 0):
            h = Windows(part.column(0).to_pylist(), size).h
            kept.append(h)
            held += len(h)
            if held >= FRAGMENT:
                yield from emit(kept)
                kept, held = [], 0
        if held:
            yield from emit(kept)

    return docs.select("text").mapInArrow(run, "r int, s int, once binary, again binary")


def merge_sketches(fragments: DataFrame, ranges: int) -> list[np.ndarray]:
    """For each hash row the bits of the cells hit twice or more; at most MOST_RANGES ranges of them."""
    width = 1 << RANGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, np.zeros(width, np.uint8)

        def out() -> pa.RecordBatch:
            bitmap = np.packbits(counts > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([bitmap])], names=["r", "s", "bitmap"])

        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if own != key:
                    if key is not None:
                        yield out()
                    key = own
                    counts[:] = 0
                once, again = unpacked(batch.column(2)[k].as_py()), unpacked(batch.column(3)[k].as_py())
                counts[once] = np.minimum(counts[once] + 1, 2)
                counts[again] = 2
        if key is not None:
            yield out()

    merged = fragments.repartition("r", "s").sortWithinPartitions("r", "s").mapInArrow(run, "r int, s int, bitmap binary")
    rows = [np.zeros((ranges << RANGE) // 8, np.uint8) for _ in range(2)]
    for r, s, bitmap in merged.collect():
        rows[r][s * width // 8 : (s + 1) * width // 8] = np.frombuffer(bitmap, np.uint8)
    return rows


def _by_document(o: np.ndarray, th: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(o, th, packed starts) for each document among repeated places."""
    order = np.lexsort((at, th, o))
    o, th, at = o[order], th[order], at[order]
    edges = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (th[1:] != th[:-1]), [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(o[a]), int(th[a]), packed(np.unique(at[a:b]))


_REPEATS = pa.schema([("o", pa.int64()), ("th", pa.int64()), ("data", pa.binary())])


def _planes(numbers: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on, which small numbers leave zero."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str, n: int, start: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, start).reshape(width, n).T).view(kind).ravel()


def pack_places(o: np.ndarray, th: np.ndarray, row: np.ndarray, at: np.ndarray) -> bytes:
    """Places in documents, sorted by row and place: the documents and their counts, and all numbers as gaps.

    A document is named in every bucket that one of its windows falls in, so its name has to be short.
    """
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(row))).astype("<u4")
    names = [np.diff(x[first].astype("<i8"), prepend=np.int64(0)) for x in (o, th)]
    light = zlib.compress(b"".join(map(_planes, (*names, counts, np.diff(at, prepend=0).astype("<i4")))), 1)
    return np.array([len(row), len(first), len(light)], "<u4").tobytes() + light


def unpack_places(data: bytes, start: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """((o, th, at), where it ends) of what ``pack_places`` made."""
    n, docs, light = np.frombuffer(data, "<u4", 3, start).tolist()
    start += 12
    plain = zlib.decompress(data[start : start + light])
    o, th = (np.cumsum(_from_planes(plain, "<i8", docs, k)) for k in (0, 8 * docs))
    counts = _from_planes(plain, "<u4", docs, 16 * docs)
    return (np.repeat(o, counts), np.repeat(th, counts), np.cumsum(_from_planes(plain, "<i4", n, 20 * docs))), start + light


def candidate_places(docs: DataFrame, bitmaps, ranges: int, buckets: int, size: int) -> DataFrame:
    """(bucket, data): of the windows of a block that are estimated repeated and fall in a bucket, the places settled
    as repeated within the block, then the first places with their hashes. Both travel together, so that a
    task that is run again can't leave one half from each attempt."""
    width = buckets.bit_length() - 1
    schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])

    def settle(parts: list[tuple[np.ndarray, ...]], keys: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, g, row, at = (np.concatenate(c) for c in zip(*parts, strict=True))
        o, th = (np.concatenate(c) for c in zip(*keys, strict=True))
        order = np.lexsort((at, row, o[row], g, h))
        h, g, row, at = (c[order] for c in (h, g, row, at))
        o, th = o[row], th[row]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        same_row = np.concatenate([[False], (row[1:] == row[:-1]) & ~new[1:]])
        again = (o > o[new][np.cumsum(new) - 1]) | same_row
        to = (h >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(h), np.int64)
        order = np.lexsort((at, row, again, to))
        h, g, o, th, row, at, to, again = (c[order] for c in (h, g, o, th, row, at, to, again))
        del order, new, same_row
        edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
        rows = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            m = a + int(np.searchsorted(again[a:b], True))
            settled = pack_places(o[m:b], th[m:b], row[m:b], at[m:b])
            first = pack_places(o[a:m], th[a:m], row[a:m], at[a:m])
            rows.append((int(to[a]), settled + first + h[a:m].astype("<u8").tobytes() + g[a:m].astype("<u4").tobytes()))
        for k in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 256], strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said, parts, keys, held, seen = bitmaps.value, [], [], 0, 0
        for part in chunks(batches, 0):
            own = Windows(part.column(0).to_pylist(), size)
            o, th = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            keep = np.ones(len(own.h), bool)
            for bitmap, cells in zip(said, cells_of(own.h, ranges << RANGE), strict=True):
                keep &= (bitmap[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
            if keep.any():
                parts.append((own.h[keep], own.g[keep], (own.row[keep] + seen).astype(np.int32), own.at[keep].astype(np.int32)))
                held += len(parts[-1][0])
            keys.append((o, th))
            seen += part.num_rows
            if held >= BLOCK:
                yield from settle(parts, keys)
                parts, keys, held, seen = [], [], 0, 0
        if held:
            yield from settle(parts, keys)

    return docs.select("text", "o", "th").mapInArrow(run, "bucket int, data binary")


def _by_bucket(batches: Iterator[pa.RecordBatch], settle: Callable[[list[bytes]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``settle`` gets all data of a bucket; batches come sorted by bucket."""
    key, parts = None, []
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != key and parts:
                yield from settle(parts)
                parts = []
            key = bucket
            parts.append(data)
    if parts:
        yield from settle(parts)


def exact_repeats(places: DataFrame, buckets: int) -> DataFrame:
    """(o, th, data), a row for each document with repeats: the settled places, and those whose window, by 96 bits,
    starts in a document before theirs. They travel back packed, by buckets of documents."""
    packs = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])

    def settle(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        settled: list[tuple] = []
        columns: list[tuple] = []
        for data in parts:
            own, start = unpack_places(data, 0)
            settled.append(own)
            own, start = unpack_places(data, start)
            n = len(own[0])
            columns.append((np.frombuffer(data, "<u8", n, start), np.frombuffer(data, "<u4", n, start + 8 * n), *own))
        h, g, o, th, at = (np.concatenate(c) for c in zip(*columns, strict=True))
        order = np.lexsort((o, g, h))
        h, g, o, th, at = (c[order] for c in (h, g, o, th, at))
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])[: len(h)]
        again = o > o[new][np.cumsum(new) - 1] if len(h) else np.zeros(0, bool)
        o, th, at = (np.concatenate([c[again], *more]) for c, more in zip((o, th, at), zip(*settled, strict=True), strict=True))
        to = (_mixed(o.view(np.uint64) ^ _mixed(th.view(np.uint64))) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((at, th, o, to))
        o, th, at, to = (c[order] for c in (o, th, at, to))
        row = np.cumsum(np.concatenate([[0], (o[1:] != o[:-1]) | (th[1:] != th[:-1])])) if len(o) else o
        edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(o) else np.zeros(1, np.int64)
        rows = [(int(to[a]), pack_places(o[a:b], th[a:b], row[a:b], at[a:b])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        for k in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 1000], strict=True), packs, strict=True)], schema=packs)

    def merge(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        o, th, at = (np.concatenate(c) for c in zip(*[unpack_places(data, 0)[0] for data in parts], strict=True))
        rows = list(_by_document(o, th, at))
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 10_000], strict=True), _REPEATS, strict=True)], schema=_REPEATS)

    found = places.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _by_bucket(b, settle), "bucket int, data binary")
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _by_bucket(b, merge), "o long, th long, data binary")


class Removal:
    """A text's words and which of them are removed."""

    def __init__(self, text: str | None, starts: np.ndarray, size: int):
        self.words = space_words(text)
        change = np.zeros(len(self.words) + 1, np.int32)
        if len(starts):
            np.add.at(change, starts, 1)
            np.add.at(change, starts + size, -1)
        self.removed = np.cumsum(change)[:-1] > 0

    @property
    def kept(self) -> bytes:
        return b" ".join(compress(self.words, (~self.removed).tolist()))

    def digest(self) -> tuple[int, int, str]:
        return len(self.words), int(self.removed.sum()), hashlib.sha256(self.kept).hexdigest()


def with_packed_texts(docs: DataFrame, id_kind: str) -> DataFrame:
    """``docs`` (text, o, th, id) with each text packed by itself, which the shuffle of whole texts is spared."""
    schema = f"packed binary, o long, th long, id {id_kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for part in chunks(batches, 0):
            packed = [None if t is None else pack(t.encode()) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *part.columns[1:]], names=["packed", "o", "th", "id"])

    return docs.mapInArrow(run, schema)


def remove_repeats(
    df: DataFrame,
    *,
    window: int = WINDOW,
    most_ranges: int = MOST_RANGES,
    id_col: str = "doc_id",
    text_col: str = "text",
    schema: str = "kept string, n_words long, n_removed long",
    project: Callable[[Removal], tuple] = lambda r: (r.kept.decode(), len(r.words), int(r.removed.sum())),
) -> DataFrame:
    """One row for each row of ``df``: the integer id and what ``project`` takes from its ``Removal``.

    A word goes if a window over it also starts in a document with a smaller id or earlier in the same document;
    windows are judged on the input. Rows with the same id are one document to this rule: none of them is earlier.
    Repeated rows have the same result; null ids come after all others. Null, empty and short texts have no window.
    Other columns are not looked at; an empty table gives an empty one; texts are read whole.
    """
    spark = df.sparkSession
    # Identity of a document: order by id, and its text's hash where ids are repeated, so that rows with one id don't mix.
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("o")
    repeated = not df.select(order).groupBy("o").count().filter("count > 1").isEmpty()
    docs = df.select(
        F.col(text_col).alias("text"), order, (F.xxhash64(F.col(text_col)) if repeated else F.lit(0).cast("long")).alias("th"), F.col(id_col).alias("id")
    )
    expected = max(1, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_A_WINDOW)
    ranges = min(most_ranges, max(1, -(-int(CELLS_A_WINDOW * expected) >> RANGE)))
    bitmaps = spark.sparkContext.broadcast(merge_sketches(sketch_fragments(docs, ranges, window), ranges))
    buckets = 1 << max(0, (expected // BUCKET).bit_length())
    repeats = exact_repeats(candidate_places(docs, bitmaps, ranges, buckets, window), buckets)
    carried = with_packed_texts(docs, id_type(df, id_col))
    met = carried.join(repeats, ["o", "th"], "left").select("id", "packed", F.col("data").alias("starts"))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    full = f"`{id_col}` {id_type(df, id_col)}, {schema}"
    target = to_arrow_schema(_parse_datatype_string(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for part in chunks(batches, 1):
            rows = []
            for data, starts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                found = unpacked(starts) if starts else np.zeros(0, np.int64)
                text = None if data is None else unpack(data).decode()
                rows.append(project(Removal(text, found, window)))
            columns = [part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(target)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return met.mapInArrow(run, full)
