"""Binary formats: sorted tables, wire messages, prefix-coded id lists, and PCM audio. Bytes in, Python values out."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np


class FormatError(ValueError):
    """Bytes that break their format."""


class InvalidInput(ValueError):
    """An argument outside its range."""


# Fixed values of the table format.
MAGIC = 0xDB4775248B80FB57
FOOTER = 48
MASK_DELTA = 0xA282EAD8
CASTAGNOLI = 0x82F63B78


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ CASTAGNOLI * (n & 1)
        table.append(n)
    return table


_CRC = _crc_table()


@cache
def _advance(n: int) -> tuple[tuple[int, ...], ...]:
    """What ``n`` zero bytes make of each byte of a running checksum, four tables of 256."""
    one = [[v << 8 * i >> 8 ^ (0 if i else _CRC[v]) for v in range(256)] for i in range(4)]
    if n == 1:
        return tuple(map(tuple, one))
    half = _advance(n // 2)
    twice = [[_through(half, _through(half, v << 8 * i)) for v in range(256)] for i in range(4)]
    return tuple(map(tuple, twice)) if n % 2 == 0 else tuple(tuple(_through(_advance(1), x) for x in t) for t in twice)


def _through(tables, crc: int) -> int:
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


_TABLE = np.array(_CRC, np.uint32)
STRIPES = 256


def crc32c(data: bytes, crc: int = 0) -> int:
    """Castagnoli's checksum. Long data are cut into stripes whose checksums advance side by side, and then joined."""
    crc ^= 0xFFFFFFFF
    width = len(data) // STRIPES
    if width >= 16:
        stripes = np.frombuffer(data, np.uint8, width * STRIPES).reshape(STRIPES, width)
        state = np.zeros(STRIPES, np.uint32)
        for column in stripes.T:
            state = state >> np.uint32(8) ^ _TABLE[(state ^ column) & np.uint32(0xFF)]
        tables = _advance(width)
        for part in state.tolist():
            crc = _through(tables, crc) ^ part
        data = data[width * STRIPES :]
    for b in data:
        crc = crc >> 8 ^ _CRC[(crc ^ b) & 0xFF]
    return crc ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


class Cursor:
    """Reads forward through a slice; everything beyond its end is a FormatError."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise FormatError(f"{n} bytes at {self.at} extend beyond {self.end}")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        value = 0
        for shift in range(0, 64, 7):
            byte = self.take(1)[0]
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                if value >> 64:
                    break
                return value
        raise FormatError(f"varint before {self.at} is wider than 64 bits")


def _block(data: bytes, offset: int, size: int) -> bytes:
    whole = Cursor(data, offset).take(size + 5) if offset <= len(data) else Cursor(data, len(data)).take(1)
    body, kind, crc = whole[:size], whole[size], struct.unpack("<I", whole[size + 1 :])[0]
    if kind:
        raise FormatError(f"block at {offset} is compressed ({kind})")
    if masked(crc32c(whole[: size + 1])) != crc:
        raise FormatError(f"block at {offset} fails its checksum")
    return body


def block_entries(body: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Entries of a block: each key repeats the start of the one before."""
    if len(body) < 4:
        raise FormatError("block without a restart count")
    end = len(body) - 4 * (struct.unpack("<I", body[-4:])[0] + 1)
    if end < 0:
        raise FormatError("restart array extends before the block")
    c, key = Cursor(body, 0, end), b""
    while c.at < end:
        shared, fresh, size = c.varint(), c.varint(), c.varint()
        if shared > len(key):
            raise FormatError("entry shares more than the key before it")
        key = key[:shared] + c.take(fresh)
        yield key, c.take(size)


def _handle(c: Cursor) -> tuple[int, int]:
    return c.varint(), c.varint()


class Table:
    """A sorted table of keys in checksummed blocks."""

    def __init__(self, data: bytes):
        if len(data) < FOOTER or struct.unpack("<Q", data[-8:])[0] != MAGIC:
            raise FormatError("not a table: too short, or the magic number is wrong")
        self.data = data
        footer = Cursor(data, len(data) - FOOTER, len(data) - 8)
        _handle(footer)
        self.blocks = []
        for separator, raw in block_entries(_block(data, *_handle(footer))):
            c = Cursor(raw)
            handle = _handle(c)
            if c.at != len(raw):
                raise FormatError("bytes after an index handle")
            self.blocks.append((separator, *handle))

    def entries(self, first: int = 0, last: int | None = None) -> Iterator[tuple[bytes, bytes]]:
        for _, offset, size in self.blocks[first:last]:
            yield from block_entries(_block(self.data, offset, size))

    def _find(self, key: bytes) -> int:
        lo, hi = 0, len(self.blocks)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.blocks[mid][0] < key else (lo, mid)
        return lo

    def get(self, key: bytes) -> bytes | None:
        at = self._find(key)
        return next((v for k, v in self.entries(at, at + 1) if k == key), None)

    def get_many(self, keys: Iterable[bytes]) -> dict[bytes, bytes]:
        """Values of the keys that are there; each block is read once."""
        by: dict[int, set[bytes]] = {}
        for key in keys:
            by.setdefault(self._find(key), set()).add(key)
        return {k: v for at, own in sorted(by.items()) for k, v in self.entries(at, at + 1) if k in own}

    def approximate_offset(self, key: bytes) -> int:
        """Where the first block begins whose separator is not below the key; the end of the last block if there is none."""
        at = self._find(key)
        if at < len(self.blocks):
            return self.blocks[at][1]
        return self.blocks[-1][1] + self.blocks[-1][2] + 5 if self.blocks else 0

    def validate(self) -> int:
        return sum(1 for _ in self.entries())


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def write_table(pairs: Iterable[tuple[bytes, bytes]], block_size: int = 4096, restart: int = 16) -> bytes:
    """A table of pairs in ascending order of keys."""
    out, index = bytearray(), []

    def emit(entries: list[tuple[bytes, bytes]]) -> tuple[int, int]:
        body, starts, before = bytearray(), [], b""
        for n, (key, value) in enumerate(entries):
            shared = 0
            if n % restart:
                while shared < min(len(key), len(before)) and key[shared] == before[shared]:
                    shared += 1
            else:
                starts.append(len(body))
            body += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
            before = key
        starts = starts or [0]
        body += struct.pack(f"<{len(starts) + 1}I", *starts, len(starts))
        at = len(out)
        out.extend(body + b"\0" + struct.pack("<I", masked(crc32c(bytes(body) + b"\0"))))
        return at, len(body)

    held: list[tuple[bytes, bytes]] = []
    size, last = 0, None
    for key, value in pairs:
        if last is not None and key <= last:
            raise InvalidInput("keys must ascend")
        last = key
        held.append((key, value))
        size += len(key) + len(value)
        if size >= block_size:
            index.append((key, emit(held)))
            held, size = [], 0
    if held:
        index.append((held[-1][0], emit(held)))
    meta = emit([])
    where = emit([(k, _varint(a) + _varint(n)) for k, (a, n) in index])
    footer = b"".join(map(_varint, (*meta, *where)))
    return bytes(out) + footer.ljust(FOOTER - 8, b"\0") + struct.pack("<Q", MAGIC)


def record_key(family: str, id: int) -> bytes:
    if not 0 <= id <= 0xFFFFFF:
        raise InvalidInput("ids have 24 bits")
    return family.encode() + id.to_bytes(3, "little")


WIRE = {0: "varint", 1: "fixed64", 2: "bytes", 5: "fixed32"}


def message(data: bytes) -> list[tuple[int, str, object]]:
    """Fields of a wire message in order: number, kind, value."""
    c, out = Cursor(data), []
    while c.at < c.end:
        tag = c.varint()
        number, kind = tag >> 3, WIRE.get(tag & 7)
        if not 0 < number < 1 << 32 or kind is None:
            raise FormatError(f"bad field {number} of wire type {tag & 7}")
        value = c.varint() if kind == "varint" else c.take(8) if kind == "fixed64" else c.take(4) if kind == "fixed32" else c.take(c.varint())
        out.append((number, kind, value))
    return out


def first(fields: list, number: int, kind: str):
    return next((v for n, k, v in fields if n == number and k == kind), None)


def only(fields: list, number: int, kind: str):
    found = [v for n, k, v in fields if n == number and k == kind]
    if len(found) != 1:
        raise FormatError(f"field {number} occurs {len(found)} times")
    return found[0]


def repeated(fields: list, number: int, kind: str) -> list:
    return [v for n, k, v in fields if n == number and k == kind]


def packed_floats(raw: bytes) -> list[float]:
    if len(raw) % 4:
        raise FormatError("packed floats take four bytes each")
    return list(struct.unpack(f"<{len(raw) // 4}f", raw))


def text(raw: bytes | None) -> str:
    try:
        return (raw or b"").decode()
    except UnicodeDecodeError as e:
        raise FormatError("text is no UTF-8") from e


def track(data: bytes) -> dict:
    f = message(data)
    duration, year = first(f, 6, "fixed64"), first(f, 14, "varint")
    names = {1: "track_id", 2: "catalog_id", 3: "title", 4: "artist", 8: "knowledge_graph_id", 13: "album"}
    return {name: text(first(f, n, "bytes")) for n, name in names.items()} | {"duration_seconds": struct.unpack("<d", duration)[0] if duration is not None else None, "release_year": year & 0xFFFFFFFF if year is not None else None}


class PrefixCode:
    """Delta lists of ids under a prefix code: symbol -> (code, width), least significant bit first.

    Symbol 255 announces an extended number; an extended zero ends the list.
    """

    ESCAPE = 255

    def __init__(self, codes: dict[int, tuple[int, int]]):
        self.codes = codes
        self.by = {(width, code): symbol for symbol, (code, width) in codes.items()}
        self.widths = sorted({w for _, w in codes.values()})

    @classmethod
    def from_weights(cls, weights: dict[int, int]) -> PrefixCode:
        """A Huffman code of the weights."""
        import heapq

        heap = [(w, s, (s,)) for s, w in sorted(weights.items())]
        heapq.heapify(heap)
        path = {s: "" for s in weights}
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for bit, part in (("0", a), ("1", b)):
                for s in part[2]:
                    path[s] = bit + path[s]
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        return cls({s: (int(p[::-1] or "0", 2), max(1, len(p))) for s, p in path.items()})

    def decode(self, data: bytes) -> list[int]:
        bits, n, at = int.from_bytes(data, "little"), len(data) * 8, 0
        total, out = 0, []
        while True:
            for w in self.widths:
                symbol = self.by.get((w, bits >> at & (1 << w) - 1)) if at + w <= n else None
                if symbol is not None:
                    break
            else:
                raise FormatError("id list without an end, or an unknown code")
            at += w
            delta = symbol
            if symbol == self.ESCAPE:
                groups = 1
                while at < n and bits >> at & 1:
                    groups, at = groups + 1, at + 1
                at += 1
                if groups > 8 or at + 4 * groups > n:
                    raise FormatError("an extended id is too wide or cut off")
                delta = (bits >> at & (1 << 4 * groups) - 1) + sum(1 << 4 * g for g in range(1, groups))
                at += 4 * groups
                if not delta:
                    return out
            total += delta
            if total >> 32:
                raise FormatError("an id passes 32 bits")
            out.append(total)

    def encode(self, ids: Iterable[int]) -> bytes:
        bits, n = 0, 0

        def put(value: int, width: int) -> None:
            nonlocal bits, n
            bits |= value << n
            n += width

        def extended(value: int) -> None:
            put(*self.codes[self.ESCAPE])
            groups, base = 1, 0
            while value >= base + (1 << 4 * groups):
                base += 1 << 4 * groups
                groups += 1
            put((1 << groups - 1) - 1, groups)
            put(value - base, 4 * groups)

        last = 0
        for i in ids:
            delta, last = i - last, i
            put(*self.codes[delta]) if delta in self.codes and delta != self.ESCAPE else extended(delta)
        extended(0)
        return bits.to_bytes(-(-n // 8), "little")


def leaf(data: bytes, code: PrefixCode, width: int = 12) -> tuple[list[int], list[bytes]]:
    """Track ids and codes of an inverted list; as many codes as ids."""
    f = message(data)
    codes, ids = only(f, 1, "bytes"), code.decode(only(f, 3, "bytes"))
    if len(codes) != width * len(ids):
        raise FormatError(f"{len(codes)} bytes of codes for {len(ids)} ids")
    return ids, [codes[i : i + width] for i in range(0, len(codes), width)]


def partitions(data: bytes, limit: int = 1000) -> list[int]:
    """Partition numbers, four in five bytes: the low bytes first, then their upper bits together; 1023 pads the end."""
    if len(data) % 5:
        raise FormatError("partition lists take five bytes for four numbers")
    out = [low | (data[g + 4] >> 2 * i & 3) << 8 for g in range(0, len(data), 5) for i, low in enumerate(data[g : g + 4])]
    while out and out[-1] == 1023:
        out.pop()
    if any(p >= limit for p in out):
        raise FormatError("a partition is out of range")
    return out


def pack_partitions(numbers: list[int]) -> bytes:
    padded = [*numbers, *[1023] * (-len(numbers) % 4)]
    return b"".join(bytes([*(p & 255 for p in q), sum(p >> 8 << 2 * i for i, p in enumerate(q))]) for q in (padded[i : i + 4] for i in range(0, len(padded), 4)))


SQUARED_L2 = 0  #: fixed value: the measure of both parts of a matcher's configuration
#: Fields of the scorer, in order, and the names that they have here.
SCORER = {8: "mass_scale", 9: "distance_scale", 10: "similarity_bias", 11: "distinct_scale", 12: "distinct_bias", 13: "exponent", 14: "similarity_scale", 15: "shape", 16: "offset"}


def matcher(data: bytes, subspaces: int = 12, words: int = 256, width: int = 8) -> dict:
    """A matcher's configuration: partitions, probes, scorer, threshold, codebook (subspaces, words, width), centroids (partitions, subspaces * width).

    The stored number of probes is twice that searched. Another measure, odd probes, wrong shapes, no neighbours or a threshold
    that isn't finite break the format.
    """
    outer = message(data)
    own = message(only(outer, 13, "bytes"))
    partitions_, probes = only(own, 1, "varint"), only(own, 2, "varint")
    if probes % 2:
        raise FormatError("the stored number of probes is odd")
    if not 0 < probes // 2 <= partitions_:
        raise FormatError("the numbers of partitions and probes don't fit")
    fields = message(only(own, 6, "bytes"))
    number = lambda raw: struct.unpack("<f", raw)[0]
    scorer = {name: number(only(fields, n, "fixed32")) for n, name in SCORER.items()} | {"neighbours": only(fields, 7, "varint")}
    threshold = first(outer, 19, "fixed32")
    threshold = 0.0 if threshold is None else number(threshold)
    if not scorer["neighbours"] or not math.isfinite(threshold):
        raise FormatError("the scorer has no neighbours, or the threshold isn't finite")

    def vectors(entries: list, size: int) -> list[list[float]]:
        found = [packed_floats(only(message(e), 1, "bytes")) for e in entries]
        if any(len(x) != size for x in found):
            raise FormatError(f"a vector has not {size} numbers")
        return found

    hashing, partitioner = message(only(own, 3, "bytes")), message(only(own, 4, "bytes"))
    if only(hashing, 2, "varint") != SQUARED_L2 or only(partitioner, 3, "varint") != SQUARED_L2:
        raise FormatError("only the squared distance is known")
    codebook = [vectors(repeated(message(s), 1, "bytes"), width) for s in repeated(hashing, 1, "bytes")]
    centroids = vectors(repeated(partitioner, 1, "bytes"), subspaces * width)
    if len(codebook) != subspaces or any(len(s) != words for s in codebook) or len(centroids) != partitions_:
        raise FormatError("the codebook or the centroids have another shape")
    return {"partitions": partitions_, "probes": probes // 2, "scorer": scorer, "threshold": threshold, "codebook": codebook, "centroids": centroids}


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else _varint(number << 3) + _varint(value)


def write_matcher(partitions_: int, probes: int, scorer: dict, codebook, centroids, threshold: float | None = None) -> bytes:
    """The bytes that :func:`matcher` reads."""
    vector = lambda v: _field(1, _field(1, struct.pack(f"<{len(v)}f", *v)))
    hashing = b"".join(_field(1, b"".join(map(vector, s))) for s in codebook) + _field(2, SQUARED_L2)
    partitioner = b"".join(map(vector, centroids)) + _field(3, SQUARED_L2)
    score = _field(7, int(scorer["neighbours"])) + b"".join(_field(n, float(scorer[name])) for n, name in SCORER.items())
    own = _field(1, partitions_) + _field(2, probes * 2) + _field(3, hashing) + _field(4, partitioner) + _field(6, score)
    return _field(13, own) + (b"" if threshold is None else _field(19, float(threshold)))


def read_wav(data: bytes, rate: int | None = None) -> tuple[int, list[int]]:
    """Rate and 16-bit samples of a RIFF file; two channels become their mean, towards zero."""
    c = Cursor(data)
    if c.take(4) != b"RIFF" or (c.take(4) and c.take(4) != b"WAVE"):
        raise FormatError("no RIFF WAVE file")
    shape, samples = None, None
    while c.at + 8 <= c.end:
        name, size = c.take(4), struct.unpack("<I", c.take(4))[0]
        body = c.take(size)
        if size % 2 and c.at < c.end:
            c.take(1)
        if name == b"fmt " and size >= 16:
            shape = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data":
            samples = body
    if shape is None or samples is None:
        raise FormatError("a chunk is missing")
    kind, channels, found, _, _, bits = shape
    if kind != 1 or bits != 16 or channels not in (1, 2) or len(samples) % (2 * channels):
        raise FormatError("only 16-bit PCM of one or two channels is read")
    if rate is not None and found != rate:
        raise FormatError(f"the rate is {found}, not {rate}")
    pcm = list(struct.unpack(f"<{len(samples) // 2}h", samples))
    return found, pcm if channels == 1 else [int((a + b) / 2) for a, b in zip(pcm[::2], pcm[1::2], strict=True)]


def write_wav(rate: int, samples: Iterable[int]) -> bytes:
    pcm = list(samples)
    body = struct.pack(f"<{len(pcm)}h", *pcm)
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body))
    return b"RIFF" + struct.pack("<I", len(head) + len(body)) + head + body


def deterministic_pcm(n: int = 22_050, state: int = 0x12345678) -> list[int]:
    """Samples of a linear congruential generator: the upper 16 bits, signed."""
    out = []
    for _ in range(n):
        state = (state * 1_664_525 + 1_013_904_223) & 0xFFFFFFFF
        out.append(((state >> 16) ^ 0x8000) - 0x8000)
    return out
