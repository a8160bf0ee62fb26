"""SentencePiece BPE encoding and decoding with offsets into the original bytes.

The text is normalised by the longest prefix that the model's compiled character map knows, and every
normalised byte keeps the place of its source; a piece is then projected to the original bytes that it
stands for. The map's trie is walked only where a byte stands that some key of it begins with; what lies
between, all of a text if the map is empty, is copied as a whole. Where white space is kept, no piece can cross from a
non-space into a space, so normalised words are encoded once and remembered in a bounded table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from loomtext.llm.common import id_type, map_texts

SPACE = "▁"
# Fixed values of the model file: piece types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a worker remembers, and the longest that it remembers.
REMEMBERED, LONGEST_REMEMBERED = 300_000, 48


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message as (number, value)."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map: a double-array trie of byte sequences, and their replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.targets = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.targets = blob[4 + size :]
        first = bytes(b for b in range(256) if self._begins(b))
        #: Finds the bytes that a key begins with; none if there is no key.
        self.starts = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in first) + b"]") if first else None

    def _begins(self, byte: int) -> bool:
        if not self.units:
            return False
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6) ^ byte
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """``data`` with each longest key replaced, and for each byte of the result the place of its source."""
        if self.starts is None:
            return data, np.arange(len(data))
        out, places, at = [], [], 0
        for found in self.starts.finditer(data):
            start = found.start()
            if start >= at and (key := self.longest(data, start)):
                length, target = key
                out += [data[at:start], target]
                places += [np.arange(at, start), np.full(len(target), start)]
                at = start + length
        out.append(data[at:])
        places.append(np.arange(at, len(data)))
        return b"".join(out), np.concatenate(places)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:] and what stands for it."""
        if not self.units:
            return None
        found = None
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.targets[start : self.targets.index(b"\0", start)]


@dataclass
class Encoded:
    """ids, and for every piece the original bytes [begin, end) that it stands for."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    id_text: str
    decoded: str


class PieceCodec:
    """A BPE model of the sentencepiece library, read from its file's bytes."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        normalizer: dict[int, int | bytes] = {}
        for number, value in wire_fields(model):
            if number == 1:
                piece = dict(wire_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(wire_fields(value))
            elif number == 3:
                normalizer = dict(wire_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are encoded here")
        if trainer.get(24, 0) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("user-defined and unused pieces, and spaces as suffixes, are not supported")
        self.scores = scores
        self.score = {p: s for p, s, k in zip(self.pieces, scores, self.kinds, strict=True) if k == NORMAL}
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.fallback = bool(trainer.get(35, 0)) and len(self.bytes) == 256
        self.unknown_surface = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.map = CharacterMap(normalizer.get(2, b""))
        self.prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))
        crosses = any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.by_word = not self.squeeze and self.prefix and self.escape and self.fallback and not crosses
        #: By id: its name, its size in normalised bytes.
        self.names = list(map(str, range(len(self.pieces))))
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)])
        self.remembered: dict[str, tuple] = {}

    # -- normalisation ---------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """The normalised bytes, and for each (and the end) the place of its source in the text's bytes."""
        data, place = self.aligned(text)
        return data, place.tolist()

    def aligned(self, text: str) -> tuple[bytes, np.ndarray]:
        """The same with the places as an array."""
        data = text.encode()
        out, place = self.map.apply(data)
        end = len(data)
        if self.squeeze:
            codes = np.frombuffer(out, np.uint8)
            space = codes == 32
            keep = ~(space & np.concatenate([[True], space[:-1]]))  # of a run of spaces the first, none at the start
            out, place = codes[keep].tobytes(), place[keep]
        if not out:
            return b"", np.array([len(data)])
        if self.prefix:
            out, place = b" " + out, np.concatenate([place[:1], place])
        if self.escape:
            wide = np.where(np.frombuffer(out, np.uint8) == 32, len(SPACE.encode()), 1)
            out, place = out.replace(b" ", SPACE.encode()), np.repeat(place, wide)
        if self.squeeze:  # nor at the end, and the sign that stands for a space doesn't either
            sign, kept = SPACE.encode() if self.escape else b" ", len(out)
            while out.endswith(sign, 0, kept):
                kept -= len(sign)
                end = int(place[kept])
            out, place = out[:kept], place[:kept]
        return out, np.append(place, end)

    # -- merging ---------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """The pieces of a normalised text: best score first, leftmost first among equals."""
        return self._merge_long(text) if len(text) > LONGEST_REMEMBERED else self._merge_short(text)

    def _merge_short(self, text: str) -> list[str]:
        parts, get, never = list(text), self.score.get, float("-inf")
        scores = [get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == never:
                break
            k = scores.index(best)
            merged = parts[k] + parts.pop(k + 1)
            parts[k] = merged
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + merged, never)
            if k < len(scores):
                scores[k] = get(merged + parts[k + 1], never)
        return parts

    def _merge_long(self, text: str) -> list[str]:
        size = len(text)
        parts: list[str] = list(text)
        left, right = list(range(-1, size - 1)), [*range(1, size), -1]
        queue: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (score := self.score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(queue, (-score, a, b, len(parts[a]) + len(parts[b])))

        for k in range(size - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, length = heapq.heappop(queue)
            if not parts[a] or not parts[b] or right[a] != b or len(parts[a]) + len(parts[b]) != length:
                continue
            parts[a] += parts[b]
            parts[b] = ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p]

    def _ids(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """ids, and how many normalised bytes each stands for."""
        ids, sizes, get = [], [], self.id.get
        for piece in pieces:
            number = get(piece)
            if number is not None:
                ids.append(number)
                sizes.append(len(piece.encode()))
            elif self.fallback:
                data = piece.encode()
                ids += [self.bytes[b] for b in data]
                sizes += [1] * len(data)
            else:
                ids.append(self.unknown)
                sizes.append(len(piece.encode()))
        return ids, sizes

    # -- encoding --------------------------------------------------------------------------------

    def _word(self, word: str) -> tuple[str, bytes, str | None]:
        """What a new normalised word after a space gives: ids as text, ids, and the decoded text if it isn't the word."""
        get, surface = self.id.get, None
        pieces = self.merge(SPACE + word)
        ids = [get(p) for p in pieces]
        if None in ids or SPACE in word:
            ids = [i for i, p in zip(ids, pieces, strict=True) for i in ([i] if i is not None else [self.bytes[b] for b in p.encode()])]
            said = self._surface(ids)
            surface = None if said[1:] == word else said
        names = self.names
        found = ",".join([names[i] for i in ids]), array("i", ids).tobytes(), surface
        if len(word) <= LONGEST_REMEMBERED and len(self.remembered) < REMEMBERED:
            self.remembered[word] = found
        return found

    _SPACED = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")

    def encode(self, text: str | None) -> Encoded:
        """Pieces of the whole text without begin or end ids; a null text is an empty one."""
        if not text:
            none = np.zeros(0, np.int32)
            return Encoded(none, none, none, "", "")
        if not self.by_word:
            return self._encode_whole(text)
        data, places = self.aligned(text)
        said = data.decode()
        if SPACE + SPACE in said or said[-1] == SPACE:
            words = [w[1:] for w in self._SPACED.findall(said)]
        else:
            words = said[1:].split(SPACE)
        get, made = self.remembered.get, self._word
        found = [get(w) or made(w) for w in words]
        names, ids, surfaces = zip(*found, strict=True)
        ids = np.frombuffer(b"".join(ids), np.int32)
        edges = places[np.concatenate([[0], np.cumsum(self.sizes[ids])])]
        if any(surfaces):
            decoded = "".join(s or " " + w for s, w in zip(surfaces, words, strict=True))[1:]
        else:
            decoded = " ".join(words)
        return Encoded(ids, edges[:-1], edges[1:], ",".join(names), decoded)

    def _encode_whole(self, text: str) -> Encoded:
        data, places = self.aligned(text)
        ids, sizes = self._ids(self.merge(data.decode()))
        edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return Encoded(
            np.array(ids, np.int32), places[edges[:-1]], places[edges[1:]], ",".join(map(str, ids)), self.decode(ids)
        )

    # -- decoding --------------------------------------------------------------------------------

    def _surface(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):  # a byte that starts no character becomes U+FFFD by itself
                first = run[at]
                length = 1 if first < 128 else 2 if 194 <= first < 224 else 3 if 224 <= first < 240 else 4
                try:
                    out.append(run[at : at + length].decode())
                    at += length
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
            run.clear()

        for number in ids:
            kind = self.kinds[number]
            if kind == BYTE:
                run.append(self.byte_of[number])
                continue
            flush()
            if kind == UNKNOWN:
                out.append(self.unknown_surface)
            elif kind != CONTROL:
                out.append(self.pieces[number].replace(SPACE, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the prefix that encoding adds is taken off again."""
        ids = list(map(int, ids))
        first = next((k for k, i in enumerate(ids) if self.kinds[i] != CONTROL), None)
        text = self._surface(ids)
        starts = first is not None and self.kinds[ids[first]] == NORMAL and self.pieces[ids[first]].startswith(SPACE)
        if not starts or not (self.prefix or self.squeeze):
            return text
        return text.lstrip(" ") if self.squeeze else text[1:]


@lru_cache(maxsize=2)
def codec(model: bytes) -> PieceCodec:
    """One codec for each model in a worker, with what it remembers."""
    return PieceCodec(model)


def encode_documents(
    df: DataFrame,
    model_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    schema: str = "ids array<int>, begins array<int>, ends array<int>, decoded string",
    project: Callable[[Encoded], tuple] = lambda e: (e.ids, e.begins, e.ends, e.decoded),
) -> DataFrame:
    """Encode every whole text and decode it again; one row for each row of ``df``.

    Returns the id and what ``project`` takes from each ``Encoded`` (by default ids, begin and end of
    each piece in the original UTF-8 bytes, and the decoded text). The model's file (0.5 MB, a fixed
    size) is read on the driver and sent along. Null and empty texts give no ids and an empty text;
    ids may be null or repeated; other columns, whatever their names, are not looked at; an empty
    table gives an empty one. Texts of any length are encoded whole.
    """
    with open(model_path, "rb") as file:
        model = df.sparkSession.sparkContext.broadcast(file.read())

    def prepare() -> Callable[[list, list], list]:
        own = codec(model.value)

        def work(ids: list, texts: list) -> list:
            return [ids, *map(list, zip(*[project(own.encode(t)) for t in texts], strict=True))]

        return work

    return map_texts(df, f"`{id_col}` {id_type(df, id_col)}, {schema}", prepare, id_col, text_col)


def digests(encoded: Encoded) -> tuple[int, str, str, str]:
    """Number of ids, and SHA-256 of the ids, of the decoded text and of the pieces' original ends."""
    return (
        len(encoded.ids),
        hashlib.sha256(encoded.id_text.encode()).hexdigest(),
        hashlib.sha256(encoded.decoded.encode()).hexdigest(),
        hashlib.sha256(encoded.ends.astype("<i8").tobytes()).hexdigest(),
    )
