"""SentencePiece encoding and decoding with byte offsets.

Encoding runs in three steps. Normalisation walks the model's compiled character map (a double-array trie) and
replaces the longest prefix it knows, noting for every output byte the source byte it came from. The normalised text
is cut before each run of the space symbol, which no piece of the vocabulary crosses, and each part is merged by
piece score. Every piece is then projected through the alignment to the span of source bytes it covers.

Results are those of the sentencepiece library for BPE models without user-defined pieces; other models are refused.
Null text counts as empty: no ids, empty decoded text. Every row is encoded alone, so repeated rows and ties give
repeated results, null ids stay null, an empty table gives an empty one, and other columns are ignored whatever their
names. Of scores that are equal the leftmost pair is merged first, as in the library. Long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import only, short

SPACE = "▁"
#: A run of spaces with what follows it.
PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol-buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """The compiled map: a double-array trie of source prefixes, and the replacements they point at."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size])
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest known prefix of data[at:], if there is one."""
        found = None
        if not self.units:
            return found
        node, unit = 0, self.units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if (unit & (1 << 31 | 255)) != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (self.units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(0, found[0])], found[1]


class Model:
    """A BPE model read from its file: pieces, normaliser flags and merge order."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.map, self.dummy, self.squeeze, self.escape = CharacterMap(b""), True, True, True
        model_type, self.suffix = 1, False
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    model_type = v if n == 3 else model_type
                    self.suffix = bool(v) if n == 24 else self.suffix
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        self.map = CharacterMap(v)
                    elif n == 3:
                        self.dummy = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        kinds = {k for _, _, k in self.pieces}
        crossing = [p for p, _, k in self.pieces if k == NORMAL and SPACE in p.lstrip(SPACE)]
        if model_type != 2 or kinds & {USER_DEFINED, UNUSED} or crossing or self.suffix or not self.escape:
            raise ValueError("only BPE models whose pieces start at spaces are supported")
        self.score = {p: (-s, i) for i, (p, s, k) in enumerate(self.pieces) if k == NORMAL}
        self.rank, self.none = {p: s for p, (s, _) in self.score.items()}, float("inf")
        self.id = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.unknown = next(i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN)
        self.bytes = [i for i, (_, _, k) in enumerate(self.pieces) if k == BYTE]
        self.first_byte = self.bytes[0] if len(self.bytes) == 256 else None
        self.out = [b"" if k == CONTROL else p.encode() for p, _, k in self.pieces]
        self.out[self.unknown] = " ⁇ ".encode()
        for b, i in enumerate(self.bytes):
            self.out[i] = bytes([b])
        self.spaced = [x.replace(SPACE.encode(), b" ") for x in self.out]
        self.plain = not self.map.units and not self.squeeze

    def normalise(self, text: bytes) -> tuple[bytes, list[int]]:
        """The normalised text and, for each of its bytes and its end, the source byte it stands for."""
        out, source, at, n = bytearray(), [], 0, len(text)

        def take(at: int) -> tuple[bytes, int]:
            found = self.map.longest(text, at)
            if found:
                return found
            width = 1 if text[at] < 0x80 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
            return text[at : at + width], width

        space = SPACE.encode()
        if self.squeeze:
            while at < n:
                new, width = take(at)
                if new != b" ":
                    break
                at += width
        if at >= n:
            return b"", [at]
        if self.dummy:
            out += space
            source += [at] * 3
        after_space = self.squeeze
        while at < n:
            new, width = take(at)
            if self.squeeze and after_space:
                new = new.lstrip(b" ")
            if new:
                for i in range(len(new)):
                    # a replaced prefix stands for its whole source; a copied character byte for byte
                    where = at + i if new == text[at : at + width] else at
                    if new[i] == 32:
                        out += space
                        source += [where] * 3
                    else:
                        out.append(new[i])
                        source.append(where)
                after_space = self.squeeze and new.endswith(b" ")
            at += width
        if self.squeeze:
            while out.endswith(space):
                at = source[-3]
                del out[-3:], source[-3:]
        return bytes(out), [*source, at]

    def merge(self, part: str) -> list[str]:
        """Symbols of one part after all merges, best score first, leftmost first among equals."""
        symbols: list[str | None] = list(part)
        n, score = len(symbols), self.score
        if n <= 64:
            # the scores of neighbours, kept beside the symbols; only those at a merge change
            get, none = self.rank.get, self.none
            ranks = [get(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
            while ranks and (best := min(ranks)) != none:
                i = ranks.index(best)
                symbols[i] += symbols.pop(i + 1)
                del ranks[i]
                if i:
                    ranks[i - 1] = get(symbols[i - 1] + symbols[i], none)
                if i < len(ranks):
                    ranks[i] = get(symbols[i] + symbols[i + 1], none)
            return symbols
        before, after, agenda = list(range(-1, n - 1)), [*range(1, n), -1], []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := score.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(agenda, (s[0], i, j, len(symbols[i]) + len(symbols[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or after[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s is not None]

    def ids_of(self, part: str) -> tuple[list[int], list[int]]:
        """Ids of one part and the normalised bytes that each covers."""
        ids, sizes = [], []
        for s in self.merge(part):
            i = self.id.get(s)
            if i is not None:
                ids.append(i)
                sizes.append(len(s) if s.isascii() else len(s.encode()))
            elif self.first_byte is not None:
                raw = s.encode()
                ids += [self.first_byte + b for b in raw]
                sizes += [1] * len(raw)
            else:
                ids.append(self.unknown)
                sizes.append(len(s.encode()))
        return ids, sizes

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids in UTF-8; one leading space of the dummy prefix goes, broken bytes become U+FFFD."""
        raw = b"".join(map(self.spaced.__getitem__, ids))
        if self.dummy and ids and self.out[ids[0]].startswith(SPACE.encode()):
            raw = raw[1:]
        if self.first_byte is None:
            return raw
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return self._repair(ids)

    def _repair(self, ids: list[int]) -> bytes:
        """Decode runs of byte pieces apart from other pieces, each broken byte as one U+FFFD."""
        out, run, low, first = [], bytearray(), self.first_byte, True

        def flush() -> None:
            at = 0
            while at < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + width]).decode().encode())
                        at += width
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�".encode())
                    at += 1
            run.clear()

        for i in ids:
            if low <= i < low + 256:
                run.append(i - low)
            else:
                flush()
                piece = self.spaced[i]
                if first and self.dummy and self.out[i].startswith(SPACE.encode()):
                    piece = piece[1:]
                out.append(piece)
            first = False
        flush()
        return b"".join(out)


class Words(dict):
    """What a word after a space becomes, computed when first met. Two generations bound the memory."""

    MOST = 350_000

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, word: str) -> tuple[bytes, bytes, bytes]:
        value = self.old.get(word)
        if value is None:
            ids, sizes = self.model.ids_of(SPACE + word)
            sizes[0] -= 2  # a space is one byte of the source and three of the normalised text
            value = (
                struct.pack(f"<{len(ids)}i", *ids),
                (",".join(map(str, ids)) + ",").encode(),
                struct.pack(f"<{len(sizes)}i", *sizes),
            )
        if len(word) <= 48:
            if len(self) >= self.MOST:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


class Encoder:
    def __init__(self, data: bytes):
        self.model = Model(data)
        self.words = Words(self.model)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Ids, the first and end source byte of each piece, and the ids as decimals with commas."""
        if not text:
            return np.zeros(0, "<i4"), np.zeros(0, np.int64), np.zeros(0, np.int64), b""
        if self.model.plain and self.model.dummy and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            got = list(map(self.words.__getitem__, text.split(" ")))
            ids, decimals, sizes = (b"".join(x) for x in zip(*got, strict=True))
            ids, ends = np.frombuffer(ids, "<i4"), np.cumsum(np.frombuffer(sizes, "<i4"), dtype=np.int64)
            ends -= 1  # the first space is the dummy prefix, which no source byte stands for
            return ids, np.maximum(np.concatenate([[-1], ends[:-1]]), 0), ends, decimals[:-1]
        flat, source = self.model.normalise(text.encode())
        ids, sizes = [], []
        for part in PARTS.findall(flat.decode()):
            for out, more in zip((ids, sizes), self.model.ids_of(part), strict=True):
                out += more
        cuts, source = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.array(source, np.int64)
        return np.array(ids, "<i4"), source[cuts[:-1]], source[cuts[1:]], ",".join(map(str, ids)).encode()


@lru_cache(maxsize=2)
def encoder_from(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


def encode(docs: DataFrame, model_path: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ids, begins and ends (source byte spans of the pieces), decoded text.

    Needs the model file at the same path on every executor. A narrow transformation, without shuffle.
    """
    def run(batches):
        coder = encoder_from(model_path)
        for b in short(batches):
            ids, begins, ends, decoded = [], [], [], []
            for text in b.column(1).to_pylist():
                i, s, e, _ = coder.encode(text or "")
                ids.append(i)
                begins.append(s)
                ends.append(e)
                decoded.append(coder.model.decode(i.tolist()).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(decoded, pa.string())],
                names=[id_column, "ids", "begins", "ends", "decoded"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return only(docs, id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, begins array<bigint>, ends array<bigint>, decoded string")


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """The digests of `encode` per document, without moving ids and spans through the JVM.

    spans_crc32 covers the little-endian begins and ends of all pieces.
    """
    def run(batches):
        coder = encoder_from(model_path)
        for b in short(batches):
            rows = []
            for text in b.column(1).to_pylist():
                ids, begins, ends, decimals = coder.encode(text or "")
                decoded = coder.model.decode(ids.tolist())
                spans = zlib.crc32(ends.tobytes(), zlib.crc32(begins.tobytes()))
                rows.append((len(ids), hashlib.sha256(decimals).hexdigest(), hashlib.sha256(decoded).hexdigest(), spans))
            n, a, d, s = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(s, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint")
