"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, Hamming distance, components.

Two fingerprints of 64 bits that differ in two or fewer agree on two of four blocks of 16 bits at least, so six tables
keyed by 32 bits bring every close pair together. Equal fingerprints are one node. Rows of a small bucket are
joined and verified; a crowded bucket (many near copies) would make all pairs, so there each fingerprint goes to
itself and its one-bit neighbours outside the key: two of them meet exactly if they differ in two bits or fewer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import id_type, map_texts
from loomtext.llm.components import connected_components
from loomtext.session import durable

SHINGLE = 3
#: Fixed values of the contract: seed of the hash, most differing bits.
SEED, DISTANCE = 42, 2
#: Blocks of 16 bits, and the pairs of blocks that make a key.
BLOCKS = (0, 16, 32, 48)
PAIRS = [(a, b) for k, a in enumerate(BLOCKS) for b in BLOCKS[k + 1 :]]
#: Fingerprints in a bucket beyond which it is crowded.
CROWDED = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; a text without words has 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :][:n] - 1
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.fromiter((digest(view[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for each row: the fingerprint's bits as a signed number."""

    def prepare() -> Callable[[list, list], list]:
        def work(ids: list, texts: list) -> list:
            values = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            return [ids, values.view(np.int64).tolist()]

        return work

    return map_texts(df, f"`{id_col}` {id_type(df, id_col)}, fp long", prepare, id_col, text_col)


def close_links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that connect all that differ in DISTANCE bits or fewer.

    Small buckets give all their close pairs, crowded ones a star for each meeting place; every link is verified.
    """
    block = lambda at: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit(0xFFFF))
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), (block(a) * F.lit(1 << 16) + block(b)).alias("key")) for t, (a, b) in enumerate(PAIRS)]))
    rows = prints.select("fp", keys.alias("x")).select("fp", "x.t", "x.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = durable(rows.join(sizes, ["t", "key"]))
    few = met.filter(F.col("n") <= crowded)
    left, right = few.select("t", "key", F.col("fp").alias("u")), few.select("t", "key", F.col("fp").alias("v"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE
    pairs = left.join(right, ["t", "key"]).filter((F.col("u") < F.col("v")) & close).select("u", "v")
    flips = [[1 << (at + k) for at in BLOCKS if at not in pair for k in range(16)] for pair in PAIRS]
    signed = [[0] + [f - (1 << 64) if f >> 63 else f for f in one] for one in flips]
    masks = F.element_at(F.array(*[F.array(*[F.lit(f).cast("long") for f in one]) for one in signed]), F.col("t") + 1)
    near = met.filter(F.col("n") > crowded).select("t", "fp", F.explode(masks).alias("mask"))
    near = near.select("t", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("place"))
    # at most one fingerprint itself and its 32 neighbours meet at a place
    meetings = near.groupBy("t", "place").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = meetings.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter((F.col("u") < F.col("v")) & close)
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    df: DataFrame, *, shingle: int = SHINGLE, crowded: int = CROWDED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``df``: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null texts and texts without words have fingerprint zero and link like any other. Repeated rows have the same
    result; null ids keep their row and count as no id, so a component of them alone has a null component_id.
    Other columns are not looked at; an empty table gives an empty one. Whole texts are read.
    """
    docs, named = _components(df, shingle, crowded, id_col, text_col)
    return docs.join(named, F.col("fp") == F.col("own")).select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _components(df: DataFrame, shingle: int, crowded: int, id_col: str, text_col: str, least_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of each row; (own fingerprint, root, component_id) of each fingerprint: the smallest ``least_of`` (the id)."""
    docs = durable(fingerprints(df, shingle=shingle, id_col=id_col, text_col=text_col))
    least = durable(docs.groupBy("fp").agg(F.min(F.expr(least_of) if least_of else F.col(id_col)).alias("least")))
    components = connected_components(close_links(least.select("fp"), crowded))
    rooted = least.join(components, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_root = by_root.select((F.col("root") + F.lit(0)).alias("at"), "component_id")
    named = rooted.select(F.col("fp").alias("own"), "root").join(by_root, F.col("root") == F.col("at"))
    return docs, named.select("own", "component_id")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df``, with its own columns, with one row of each component: one with the smallest id.

    Ids may be null or repeated: rows are told apart by id and content. A row without an id stays only where its
    component has no row with one; of several contents with the smallest id, or without any, the one with the smallest
    address stays, of equal ids and contents one row.
    """

    def key(id_: Column, h: Column) -> Column:
        """One text, which no null and no difference in types keeps from being dealt out once for the join and the drop."""
        return F.concat_ws("|", h, F.coalesce(id_.cast("string"), F.lit("")))

    content = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    # rows without an id come after all others
    named_rows = df.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), content.alias("h")).alias("k"), F.col(text_col).alias("t"))
    docs, named = _components(named_rows, SHINGLE, CROWDED, "k", "t", "k")
    first = docs.join(named, F.col("fp") == F.col("own")).select(key(F.col("component_id.id"), F.col("component_id.h")).alias("k")).distinct()
    rows = df.select(F.struct("*").alias("row"), key(F.col(id_col), content).alias("k"))
    return rows.join(first, "k", "left_semi").dropDuplicates(["k"]).select("row.*")
