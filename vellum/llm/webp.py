"""Lossless WebP: a decoder for the whole public bitstream and an encoder.

The decoder reads prefix codes (simple and normal), back-references, the colour cache and meta prefix images, and
inverts the predictor, cross-colour, subtract-green and palette transforms. Pixel arrays are uint32 ARGB. Symbols are
read by tables, one look-up for each; what back-references and cache entries stand for is resolved for the whole image
at once: each such pixel points at an earlier one, and pointers are followed in doubling steps. Images of several code
groups are decoded pixel by pixel.

``store`` writes bytes as the channels of an image, 16 pixels a row, one file for each 2^20 bytes. Images of few
colours get a palette, packed where it is small; others the predictor (from above or none, whichever gives the lower
entropy in a tile), cross-colour factors by least squares, or subtract-green where these are large. Then repeated pixels become
back-references, recent colours cache entries, and each alphabet gets its own prefix code. ``load`` reads it back.

Most texts are small, so arrays of many files are worked on together; each file is what it would be alone.

Null and empty texts: 64 zeros. Long texts are stored whole. Repeated rows: equal values. Empty table: no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the format: order of code length codes; (dx, dy) of short distance codes; prediction modes below.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
MAX_SIDE = 16384


@lru_cache(16)
def turned(n: int) -> np.ndarray:
    """All numbers of n bits, each with its bits turned round."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


class Bits:
    """Reads least significant bits first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.word = data, 0, 0, 0

    def peek(self, n: int) -> int:
        """The next n bits, zeros after the end."""
        while self.have < n and self.at < len(self.data):
            part = self.data[self.at : self.at + max(8, (n - self.have + 7) >> 3)]
            self.word |= int.from_bytes(part, "little") << self.have
            self.have += 8 * len(part)
            self.at += len(part)
        return self.word & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        if n > self.have:
            raise ValueError("the bitstream ends too early")
        self.word >>= n
        self.have -= n

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.skip(n)
        return out

    @property
    def place(self) -> int:
        """Bits read so far."""
        return 8 * self.at - self.have

    def skip_to(self, place: int) -> None:
        self.at, self.have, self.word = place >> 3, 0, 0
        if place & 7:
            self.read(place & 7)


class Prefix:
    """A canonical prefix code out of its code lengths: for the next ``bits`` bits the symbol and how many it takes, as
    one number. A code of one symbol takes none."""

    def __init__(self, lengths: Sequence[int]):
        n = np.frombuffer(bytes(lengths), np.uint8).astype(np.intp)
        used = n.nonzero()[0]
        self.bits, self.only = 0, None
        self.runs: dict[int, tuple[int, bytes, int, int]] = {}
        if len(used) < 2:
            self.only = int(used[0]) if len(used) else 0
            self._tables(np.array([self.only << 4]))
            return
        self.bits = int(n.max())
        order = used[n[used].argsort(kind="stable")]
        size = n[order]
        span = 1 << (self.bits - size)
        if span.sum() != 1 << self.bits:
            raise ValueError("a prefix code isn't complete")
        self._tables((order << 4 | size).astype(np.uint16).repeat(span)[turned(self.bits)])

    def _tables(self, array: np.ndarray) -> None:
        self.array, self.mask = array.astype(np.uint16, copy=False), (1 << self.bits) - 1
        self.table = memoryview(self.array)

    def lengths_ahead(self, window: int) -> tuple[int, bytes, int, int]:
        """As a code of code lengths, what the next 15 bits hold: how many bits are taken, the lengths that they stand
        for, the last one but zero of these (0: none), and how often the length before comes again (then nothing else)."""
        word, used, last, out = window, 0, 0, b""
        while True:
            e = self.table[word & self.mask]
            n, s = e & 15, e >> 4
            low = word >> n
            extra = {16: 2, 17: 3, 18: 7}.get(s, 0)
            if used + n + extra > 15 or s == 16 and not last and used:
                break
            used += n + extra
            word = low >> extra
            low &= (1 << extra) - 1
            if s < 16:
                out += bytes((s,))
                last = s or last
            elif s > 16:
                out += bytes((3 if s == 17 else 11) + low)
            elif last:
                out += bytes((last,)) * (3 + low)
            else:
                return used, b"", 0, 3 + low
        return used, out, last, 0

    def read(self, bits: Bits) -> int:
        e = self.table[bits.peek(self.bits)]
        bits.skip(e & 15)
        return e >> 4


#: Codes of code lengths are few; those of images are hardly ever the same, and their tables are large.
prefix = lru_cache(256)(Prefix)


@lru_cache(4096)
def simple(first: int, second: int) -> Prefix:
    """The code of one symbol or two."""
    return Prefix(tuple(int(i in (first, second)) for i in range(256)))


def read_prefix(bits: Bits, size: int) -> Prefix:
    if bits.read(1):
        head = bits.peek(18)
        two, wide = head & 1, 8 if head & 2 else 1
        first, second = head >> 2 & (1 << wide) - 1, head >> (2 + wide) & 255
        bits.skip(2 + wide + 8 * two)
        return simple(first, second if two else first)
    coded = [0] * 19
    for i in range(4 + bits.read(4)):
        coded[LENGTH_ORDER[i]] = bits.read(3)
    of = prefix(tuple(coded))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, last = bytearray(), 8
    if of.only is not None and of.only < 16:  # one symbol takes no bits
        lengths, left = bytearray([of.only]) * min(left, size), 0
    # all symbols of fifteen bits at once, as long as they fit
    if of.only is None and left == size:
        runs, k = of.runs, 0
        while len(lengths) < size:
            if not k:
                word, used, k = bits.peek(15 * 24), 0, 24
            k -= 1
            if (known := runs.get(word & 0x7FFF)) is None:
                known = runs[word & 0x7FFF] = of.lengths_ahead(word & 0x7FFF)
            n, these, new, again = known
            if again:
                these = bytes((last,)) * again
            if len(lengths) + len(these) > size:
                break
            lengths += these
            last = new or last
            word >>= n
            used += n
            if not k:
                bits.skip(used)
                used = 0
        bits.skip(used)
    # symbols and their extra bits by one number, at most 7 + 7 bits for each, 32 symbols at a time
    used, table, mask, k = 0, of.table, of.mask, 0
    while left and len(lengths) < size:
        if not k:
            bits.skip(used)
            word, used, k = bits.peek(14 * 32), 0, 32
        k -= 1
        left -= 1
        e = table[word & mask]
        n, s = e & 15, e >> 4
        word >>= n
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += bytes((last,)) * (3 + (word & 3))
            word >>= 2
            n += 2
        else:
            extra, least = (3, 3) if s == 17 else (7, 11)
            lengths += bytes(least + (word & (1 << extra) - 1))
            word >>= extra
            n += extra
        used += n
    bits.skip(used)
    if len(lengths) > size:
        raise ValueError("too many code lengths")
    return Prefix(lengths + bytes(size - len(lengths)))


def read_codes(bits: Bits, sizes: tuple[int, ...]) -> list[Prefix]:
    """The codes of a group. Where the same bits come again for an alphabet of the same size it's the same code, as a
    code's text tells its own end."""
    out: list[Prefix] = []
    text, n, before = 0, 0, 0
    for size, after in zip(sizes, (*sizes[1:], 0), strict=True):
        if size == before and bits.peek(n) == text and bits.have >= n:
            bits.skip(n)
            out.append(out[-1])
            continue
        place, ahead = bits.place, bits.peek(14 * size + 80) if size == after else 0
        out.append(read_prefix(bits, size))
        n, before = bits.place - place, size if size == after else 0
        text = ahead & ((1 << n) - 1)
    return out


def extended(bits: Bits, code: int) -> int:
    """A length or distance from its prefix symbol."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


#: An image of one colour: no cache, then five codes of one symbol, which stands in the eight bits that are left open.
ONE_COLOUR_BITS, ONE_COLOUR = (1 | sum(k << 1 + 11 * i for i in range(5)) for k in (7, 5))
ONE_COLOUR -= 1


class Walk(NamedTuple):
    """Where the symbols of an image of one code group stand, before it is known which colours they mean."""

    codes: list[Prefix]
    data: bytes  # from the byte on in which the first symbol begins
    starts: list[int]  # bits where literals begin
    marks: list[int]  # of each other symbol: place, length, distance (0: cache), cache key
    total: int
    cache_bits: int


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: flat ARGB pixels."""
    return read_images([(bits, width, height)], main)[0]


def read_images(images: list[tuple[Bits, int, int]], main: bool) -> list[np.ndarray]:
    """Images of (bits, width, height), of a file each. Symbols are read one by one, colours are then found for all at once."""
    out: list[np.ndarray | None] = []
    walks: dict[int, Walk] = {}
    again = {}
    for i, (bits, width, height) in enumerate(images):
        total = width * height
        if not main and (head := bits.peek(56)) & ONE_COLOUR_BITS == ONE_COLOUR and bits.have >= 56:
            bits.skip(56)
            g, r, b, a = (head >> k & 255 for k in (4, 15, 26, 37))
            out.append(np.full(total, a << 24 | r << 16 | g << 8 | b, np.uint32))
            continue
        cache_bits = bits.read(4) if bits.read(1) else 0
        meta, shift, groups = None, 0, 1
        if main and bits.read(1):
            shift = bits.read(3) + 2
            meta = (read_image(bits, -(-width >> shift), -(-height >> shift), False) >> np.uint32(8)) & np.uint32(0xFFFF)
            groups = int(meta.max()) + 1
        size = 256 + 24 + ((1 << cache_bits) if cache_bits else 0)
        codes = [read_codes(bits, (size, 256, 256, 256, 40)) for _ in range(groups)]
        if meta is not None:
            out.append(_read_slowly(bits, codes, width, total, cache_bits, meta, shift))
        elif total and codes[0][0].only is not None and codes[0][0].only < 256 and all(c.only is not None for c in codes[0][1:4]):
            g, r, b, a = (c.only for c in codes[0][:4])
            out.append(np.full(total, a << 24 | r << 16 | g << 8 | b, np.uint32))
        else:
            again[i] = bits.place
            walks[i] = _walked(bits, codes[0], width, total, cache_bits)
            out.append(None)
    for (i, walk), p in zip(walks.items(), _coloured(list(walks.values())) if walks else (), strict=True):
        if p is None:  # an entry of the cache is used that no pixel has set
            bits, width, _ = images[i]
            bits.skip_to(again[i])
            p = _read_slowly(bits, [walk.codes], width, walk.total, walk.cache_bits)
        out[i] = p
    return out


def _read_slowly(bits: Bits, codes: list[list[Prefix]], width: int, total: int, cache_bits: int, meta: np.ndarray | None = None, shift: int = 0) -> np.ndarray:
    """An image pixel by pixel, of any code groups."""
    meta_width = -(-width >> shift)
    out = np.zeros(total, np.uint32)
    cache = [0] * (1 << cache_bits)
    at = cached = 0
    while at < total:
        group = codes[int(meta[(at // width >> shift) * meta_width + (at % width >> shift)])] if meta is not None else codes[0]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (g.read(bits) for g in group[1:4])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length, code = extended(bits, s - 256), extended(bits, group[4].read(bits))
            if code > 120:
                back = code - 120
            else:
                dx, dy = NEAR[code - 1]
                back = max(1, dx + dy * width)
            if back > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + length):
                out[i] = out[i - back]
            at += length
        else:
            while cached < at:  # the cache holds all pixels before this one
                p = int(out[cached])
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
                cached += 1
            out[at] = cache[s - 280]
            at += 1
    return out


def _followed(source: np.ndarray) -> np.ndarray:
    """Where each pointer ends; those to themselves are ends."""
    while True:
        further = source[source]
        if (further == source).all():
            return source
        source = further


def _walked(bits: Bits, codes: list[Prefix], width: int, total: int, cache_bits: int) -> Walk:
    first = bits.place
    data = bits.data[first >> 3 :]
    size = len(data)
    most = 8 * size
    # 25 bits or more from each bit on
    words = np.ndarray(size + 8, "<u4", bits.data[first >> 3 :] + bytes(12), strides=(1,))
    by_shift = words >> np.arange(8, dtype=np.uint32)[:, None]
    ahead = memoryview(by_shift)
    green, red, blue, alpha, far = codes
    # for every bit at once: how many bits a symbol takes that would stand there; 255 where it's no literal

    def taken(sizes: np.ndarray, mask: int) -> np.ndarray:
        return sizes.astype(np.uint8).take(by_shift & np.uint32(mask), mode="clip").T.reshape(-1)

    size_of = taken(np.where(green.array < 256 << 4, green.array & 15, 255), green.mask)
    size_of[most + 1 :] = 255
    green_takes = size_of.tobytes()
    takes = {id(c): taken(c.array & 15, c.mask).tobytes() for c in {id(c): c for c in (red, blue, alpha)}.values()}
    red_takes, blue_takes, alpha_takes = (takes[id(c)] for c in (red, blue, alpha))
    table, mask = green.table, green.mask
    starts: list[int] = []
    marks: list[int] = []  # place, length, distance, cache key of each
    literal, p, at, copied = starts.append, first & 7, 0, 0
    while at < total:
        n = green_takes[p]
        while n < 16:
            literal(p)
            p += n
            p += red_takes[p]
            p += blue_takes[p]
            p += alpha_takes[p]
            n = green_takes[p]
        at = len(starts) + copied
        if at >= total:  # what was read after the last pixel isn't the image's
            if at > total:
                p = starts[total - copied]
                del starts[total - copied :]
            break
        if p > most:
            raise ValueError("the bitstream ends too early")
        e = table[ahead[p & 7, p >> 3] & mask]
        p += e & 15
        s = e >> 4
        if s >= 280:
            marks += (at, 1, 0, s - 280)
            copied += 1
            at += 1
        else:
            found = []
            code = s - 256
            for k in range(2):
                n = (code - 2) >> 1 if code > 3 else 0
                low = ahead[p & 7, p >> 3] & ((1 << n) - 1)
                p += n
                found.append(((2 + (code & 1)) << n) + low + 1 if n else code + 1)
                if not k:
                    e = far.table[ahead[p & 7, p >> 3] & far.mask]
                    p += e & 15
                    code = e >> 4
            length, code = found
            back = code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
            if back > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            marks += (at, length, back, 0)
            copied += length
            at += length
    if p > most:
        raise ValueError("the bitstream ends too early")
    bits.skip_to(8 * (first >> 3) + p)
    return Walk(codes, data, starts, marks, total, cache_bits)


def _coloured(walks: list[Walk]) -> list[np.ndarray | None]:
    """Pixels of images; None for one that uses a cache entry before a pixel has set it. Copies and cache entries point at
    earlier pixels of their image; ``of`` is the number of an image."""
    many = np.arange(len(walks))
    at = np.array([p for w in walks for p in w.starts], np.int64)
    of = many.repeat([len(w.starts) for w in walks])
    begin = np.cumsum([0, *(len(w.data) for w in walks)])
    words = np.ndarray(int(begin[-1]), "<u4", b"".join([*(w.data for w in walks), bytes(16)]), strides=(1,))
    begin *= 8
    at += begin[of]
    different = {id(c): c for w in walks for c in w.codes[:4]}
    tables = np.concatenate([c.array for c in different.values()])
    table_at = dict(zip(different, np.cumsum([0, *(len(c.array) for c in different.values())])[:-1].tolist(), strict=True))
    pixels = np.zeros(len(at), np.uint32)
    for k, shift in enumerate((8, 16, 0, 24)):
        mask = np.array([w.codes[k].mask for w in walks], np.uint32)[of]
        symbol = tables[np.array([table_at[id(w.codes[k])] for w in walks])[of] + (words[at >> 3] >> (at & 7).astype(np.uint32) & mask)]
        at += symbol & 15
        pixels |= (symbol >> 4).astype(np.uint32) << np.uint32(shift)
    totals = np.array([w.total for w in walks])
    ends = totals.cumsum()
    marks = np.array([x for w in walks for x in w.marks], np.int64)
    if not len(marks):
        return np.split(pixels, ends[:-1])
    place, length, back, key = marks.reshape(-1, 4).T
    whose = many.repeat([len(w.marks) // 4 for w in walks])
    place = place + (ends - totals)[whose]
    total = int(ends[-1])
    source, literals = np.arange(total), np.ones(total, bool)
    until = length.cumsum()
    copied = (place - (until - length)).repeat(length) + np.arange(until[-1])
    literals[copied] = False
    source[copied] -= back.repeat(length)
    out = np.zeros(total, np.uint32)
    out[literals] = pixels
    source = _followed(source)
    cached = (back == 0).nonzero()[0]
    bad = np.zeros(len(walks), bool)
    if len(cached):
        # the key of every pixel is known before its colour is: an entry's colour has that entry's key
        of = many.astype(np.min_scalar_type(len(walks))).repeat(totals)
        shift = np.array([32 - max(1, w.cache_bits) for w in walks], np.uint32)[of]
        keys = (out * np.uint32(CACHE_FACTOR) >> shift).astype(np.uint16)
        keys[place[cached]] = key[cached]
        keys = keys[source]
        order = keys.argsort(kind="stable")
        order = order[of[order].argsort(kind="stable")]
        before = np.full(total, -1)
        same = (keys[order[1:]] == keys[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        before[order[1:][same]] = order[:-1][same]
        before = before[place[cached]]
        bad[whose[cached[before < 0]]] = True
        source[place[cached]] = np.where(before < 0, place[cached], before)
        source = _followed(source)
    return [None if no else p for p, no in zip(np.split(out[source], ends[:-1]), bad.tolist(), strict=True)]


def cache_key(p: np.ndarray, cache_bits: int) -> np.ndarray:
    return ((p * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int64)


def _channels(p: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha bytes of pixels."""
    return np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(*p.shape, 4)


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _each(a: int, b: int, c: int, f) -> int:
    out = 0
    for s in (0, 8, 16, 24):
        out |= max(0, min(255, f(a >> s & 255, b >> s & 255, c >> s & 255))) << s
    return out


def _select(left: int, top: int, top_left: int) -> int:
    d = sum(abs((top >> s & 255) - (top_left >> s & 255)) - abs((left >> s & 255) - (top_left >> s & 255)) for s in (0, 8, 16, 24))
    return left if d < 0 else top


def predict(mode: int, left: int, top: int, top_right: int, top_left: int) -> int:
    """The format's fourteen predictors."""
    if mode in (0, 14, 15):  # the last two aren't defined and count as none
        return 0xFF000000
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode <= 10:
        return _average(*{6: (left, top_left), 7: (left, top), 8: (top_left, top), 9: (top, top_right), 10: (_average(left, top_left), _average(top, top_right))}[mode])
    if mode == 11:
        return _select(left, top, top_left)
    if mode == 12:
        return _each(left, top, top_left, lambda a, b, c: a + b - c)
    half = _average(left, top)
    return _each(half, top_left, 0, lambda a, b, _: a + int((a - b) / 2))


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def invert_predictor(p: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    modes = ((modes >> np.uint32(8)) & np.uint32(15)).reshape(-(-height >> bits), -1)
    if height == 1 or modes.shape[1] == 1 and ((modes == 0) | (modes == 2)).all():  # from above or none, by rows: sums down the columns
        x = _channels(p.reshape(height, width)).copy()
        x[0, :1, 3] += np.uint8(255)
        x[0] = np.cumsum(x[0], 0, np.uint8)
        if height > 1 and not modes.any():
            x[1:, 1:, 3] += np.uint8(255)
            x[:, 0] = np.cumsum(x[:, 0], 0, np.uint8)
            return x.view("<u4").reshape(-1)
        new = np.repeat(modes[:, 0] == 0, 1 << bits)[:height] if height > 1 else np.ones(1, bool)
        new[0] = False
        if not new.any():
            return np.cumsum(x, 0, np.uint8).view("<u4").reshape(-1)
        x[new, 1:, 3] += np.uint8(255)
        new[0] = True
        sums = np.cumsum(x, 0, np.uint8)
        start = np.maximum.accumulate(np.where(new, np.arange(height), 0))  # the row where each row's sums begin
        later = start > 0
        first_column = sums[:, 0].copy()
        sums[later] -= sums[start[later] - 1]
        sums[:, 0] = first_column  # always from above
        return sums.view("<u4").reshape(-1)
    out = p.tolist()
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not y:
                guess = out[i - 1] if x else 0xFF000000
            elif not x:
                guess = out[i - width]
            else:
                guess = predict(int(modes[y >> bits, x >> bits]), out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
            out[i] = _add(out[i], guess)
    return np.array(out, np.uint32)


def _delta(element: np.ndarray, channel: np.ndarray) -> np.ndarray:
    return (element.astype(np.int8).astype(np.int16) * channel.astype(np.int8).astype(np.int16)) >> 5


def cross_colour(p: np.ndarray, width: int, height: int, bits: int, elements: np.ndarray, back: bool) -> np.ndarray:
    """The cross-colour transform of an image (``back``: its inverse)."""
    if not (elements & np.uint32(0xFFFFFF)).any():
        return p
    x = _channels(p.reshape(height, width)).copy()
    if (elements == elements[0]).all():  # one element for all: factors of 0 need no work
        to_red, to_blue, red_to_blue = _channels(elements[:1]).view(np.int8)[0, :3].astype(np.int16)
        part = x.view(np.int8)
        green, red = part[..., 1].astype(np.int16), part[..., 2].astype(np.int16) if red_to_blue and not back else None
        change = np.add if back else np.subtract
        if to_red:
            change(x[..., 2], (green * to_red >> 5).astype(np.uint8), out=x[..., 2])
        if to_blue:
            change(x[..., 0], (green * to_blue >> 5).astype(np.uint8), out=x[..., 0])
        if red_to_blue:
            red = part[..., 2].astype(np.int16) if back else red
            change(x[..., 0], (red * red_to_blue >> 5).astype(np.uint8), out=x[..., 0])
        return x.view("<u4").reshape(-1)
    e = _channels(elements.reshape(-(-height >> bits), -1))
    e = e.repeat(1 << bits, 0)[:height].repeat(1 << bits, 1)[:, :width]
    sign = 1 if back else -1
    red = x[..., 2].copy()
    x[..., 2] = (red + sign * _delta(e[..., 0], x[..., 1])).astype(np.uint8)
    x[..., 0] = (x[..., 0] + sign * (_delta(e[..., 1], x[..., 1]) + _delta(e[..., 2], x[..., 2] if back else red))).astype(np.uint8)
    return x.view("<u4").reshape(-1)


def subtract_green(p: np.ndarray, back: bool) -> np.ndarray:
    x = _channels(p).copy()
    g = x[..., 1:2] if back else np.uint8(0) - x[..., 1:2]
    x[..., [0, 2]] += g
    return x.view("<u4").reshape(-1)


def pack_bits(colours: int) -> int:
    """Bits by which a palette image's width shrinks."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


class Opened(NamedTuple):
    """A file up to its main image: the transforms, each with the width and the tiles' bits that it has, and its own image."""

    bits: Bits
    width: int
    height: int
    opaque: bool
    steps: list[tuple[int, int, int, np.ndarray | None]]
    coded_width: int


def opened(data: bytes) -> Opened:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L":
        raise ValueError("not a lossless WebP file")
    body = data[20 : 20 + struct.unpack("<I", data[16:20])[0]]
    if body[:1] != b"\x2f":
        raise ValueError("no lossless signature")
    bits = Bits(body)
    bits.read(8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    opaque = not bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            b = bits.read(3) + 2
            steps.append((kind, w, b, read_image(bits, -(-w >> b), -(-height >> b), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = np.cumsum(_channels(read_image(bits, n, 1, False)), 0, np.uint8).view("<u4").reshape(-1)
            b = pack_bits(n)
            steps.append((kind, w, b, colours))
            w = -(-w >> b)
        else:
            steps.append((kind, w, 0, None))
    return Opened(bits, width, height, opaque, steps, w)


def decode(data: bytes) -> np.ndarray:
    """Pixels (height x width, uint32 ARGB) of one lossless WebP file."""
    return decode_all([data])[0]


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """Pixels of each file; what is done to all pixels alike is done for many files at once, as most are small."""
    heads = [opened(x) for x in files]
    images = read_images([(h.bits, h.coded_width, h.height) for h in heads], True)
    plain: dict[int, list[int]] = {}
    for i, h in enumerate(heads):
        if _by_rows(h):
            plain.setdefault(h.width, []).append(i)
    for some in plain.values():
        for i, p in zip(some, _inverted([heads[i] for i in some], [images[i] for i in some]), strict=True):
            images[i] = p
    done = {i for some in plain.values() for i in some}
    out = []
    for i, (h, p) in enumerate(zip(heads, images, strict=True)):
        p = p if i in done else _undone(h, p)
        out.append((p | np.uint32(0xFF000000) if h.opaque else p).reshape(h.height, h.width))
    return out


def _by_rows(h: Opened) -> bool:
    """Whether a file has a predictor that is the same along each row, from above or none, one cross-colour element, and at
    most subtract-green besides."""
    if [s[0] for s in h.steps] not in ([PREDICTOR, CROSS_COLOUR], [PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN]):
        return False
    (_, w, b, modes), (_, _, _, elements) = h.steps[:2]
    return w <= 1 << b and bool((modes & np.uint32(0xD00) == 0).all() and (len(elements) == 1 or (elements == elements[0]).all()))


def _inverted(heads: list[Opened], images: list[np.ndarray]) -> list[np.ndarray]:
    """Pixels of files of one width, each as ``_by_rows`` has it: what stands above adds up down the columns."""
    width, heights = heads[0].width, np.array([h.height for h in heads])
    x = _channels(np.concatenate(images).reshape(-1, width)).copy()
    ends = heights.cumsum()
    start = ends - heights
    more = np.where(np.array([len(h.steps) > 2 for h in heads]).repeat(heights)[:, None], x[..., 1], np.uint8(0))
    x[..., 2] += more
    x[..., 0] += more
    slopes = _channels(np.array([h.steps[1][3][0] for h in heads], np.uint32)).view(np.int8)[:, :3].astype(np.int16)
    to_red, to_blue, red_to_blue = slopes.repeat(heights, 0).T[:, :, None]
    part = x.view(np.int8)
    green = part[..., 1].astype(np.int16)
    x[..., 2] += (green * to_red >> 5).astype(np.uint8)
    x[..., 0] += ((green * to_blue >> 5) + (part[..., 2].astype(np.int16) * red_to_blue >> 5)).astype(np.uint8)
    new = np.concatenate([(h.steps[0][3] & np.uint32(0x200) == 0).repeat(1 << h.steps[0][2])[: h.height] for h in heads])
    new[start] = False
    x[new, 1:, 3] += np.uint8(255)
    x[start, 0, 3] += np.uint8(255)
    x[start] = np.cumsum(x[start], 1, np.uint8)
    new[start] = True
    before = np.zeros((len(x) + 1, width, 4), np.uint8)
    np.cumsum(x, 0, np.uint8, out=before[1:])
    out = before[1:] - before[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]  # from the row where a row's sums begin
    out[:, 0] = before[1:, 0] - before[start.repeat(heights), 0]  # the first column is always from above
    return np.split(out.view("<u4").reshape(-1), (ends * width)[:-1])


def _undone(h: Opened, p: np.ndarray) -> np.ndarray:
    """Pixels of a file, its transforms undone one by one."""
    for kind, w, b, extra in reversed(h.steps):
        if kind == PREDICTOR:
            p = invert_predictor(p, w, h.height, b, extra)
        elif kind == CROSS_COLOUR:
            p = cross_colour(p, w, h.height, b, extra, True)
        elif kind == SUBTRACT_GREEN:
            p = subtract_green(p, True)
        else:
            i = ((p >> np.uint32(8)) & np.uint32(255)).reshape(h.height, -1)
            if b:
                each = 8 >> b
                i = ((i[:, :, None] >> (np.arange(1 << b, dtype=np.uint32) * each)) & np.uint32((1 << each) - 1)).reshape(h.height, -1)[:, :w]
            full = np.zeros(256, np.uint32)
            full[: len(extra)] = extra
            p = full[i].reshape(-1)
    return p


class Writer:
    """Writes least significant bits first."""

    def __init__(self):
        self.word = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.word |= value << self.n
        self.n += n

    def single(self, symbol: int) -> None:
        """A simple prefix code of one symbol: its uses take no bits."""
        self.put(1, 1)
        self.put(0, 1)
        self.put(1, 1)
        self.put(symbol, 8)

    def code(self, lengths: np.ndarray) -> int:
        """A prefix code by its code lengths: simple for one or two symbols, else normal, with runs. How many symbols it has."""
        used = lengths.nonzero()[0]
        if len(used) <= 2 and not (used > 255).any():
            self.put(1, 1)
            self.put(int(len(used) == 2), 1)
            self.put(1, 1)
            for symbol in used.tolist() or [0]:
                self.put(symbol, 8)
            return len(used)
        # fixed lengths of the code of code lengths, and no bound on how many follow
        word, n = CODE_HEAD, 5 + 57 + 1
        edge = np.empty(len(lengths) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(lengths[1:], lengths[:-1], out=edge[1:-1])
        edge = edge.nonzero()[0]
        for v, k in zip(lengths[edge[:-1]].tolist(), (edge[1:] - edge[:-1]).tolist(), strict=True):
            c, m = run_code(v, k)
            word |= c << n
            n += m
        self.put(word, n)
        return len(used)


@lru_cache(1 << 14)
def run_code(v: int, k: int) -> tuple[int, int]:
    """How k equal code lengths v are written, and in how many bits."""
    word = n = 0
    if v:
        word, n = LENGTH_CODES[v]
        k -= 1
    while k:
        if not v and k > 10:
            t, s, low, extra = min(k, 138), 18, 11, 7
        elif not v and k > 2:
            t, s, low, extra = k, 17, 3, 3
        elif v and k > 2:
            t, s, low, extra = min(k, 6), 16, 3, 2
        else:
            t, s, low, extra = 1, v, 1, 0
        c, m = LENGTH_CODES[s]
        word |= (c | (t - low) << m) << n
        n += m + extra
        k -= t
    return word, n


#: Rare symbols of the code of code lengths, and the codes of all.
RARE = (1, 2, 13, 14, 15, 16)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of a complete set of lengths, to be written with their first bit first."""
    used = lengths.nonzero()[0]
    out = np.zeros(len(lengths), np.uint64)
    if len(used) > 1:
        order = used[lengths[used].argsort(kind="stable")]
        span = 1 << (15 - lengths[order])
        out[order] = turned(15)[span.cumsum() - span]
    return out


_meta = np.array([5 if s in RARE else 4 for s in range(19)])
LENGTH_CODES = list(zip(canonical(_meta).astype(int).tolist(), _meta.tolist(), strict=True))
#: What stands before code lengths: 13 symbols of four bits and six rare ones of five fill the code of code lengths.
CODE_HEAD = 15 << 1 | sum(int(_meta[s]) << 3 * i for i, s in enumerate(LENGTH_ORDER)) << 5


def code_lengths(counts: np.ndarray, most: int = 12) -> np.ndarray:
    """Lengths of a complete prefix code for symbols used that often: the information of each, rounded up; what room
    that leaves goes to the shorter codes first, in each length to the more frequent symbols."""
    used = counts.nonzero()[0]
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    c = counts[used]
    order = (-c).argsort(kind="stable")
    share = c[order] + c.sum() / (1 << (most - 1))  # no code is too long then, however rare its symbol
    n = np.ceil(np.log2(share.sum() / share)).astype(np.int64)
    many = np.bincount(np.minimum(np.maximum(n, 1), most), minlength=most + 1).tolist()  # symbols of each length; the order stays
    room = (1 << most) - sum(k << (most - i) for i, k in enumerate(many))
    while room:
        for i in range(2, most + 1):
            k = min(many[i], room >> (most - i))
            many[i] -= k
            many[i - 1] += k
            room -= k << (most - i)
    out[used[order]] = np.arange(most + 1).repeat(many)
    return out


def container(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def repeats(p: np.ndarray, of: np.ndarray, least: int = 4) -> list[tuple[int, int, int]]:
    """(place, length, distance) of disjoint runs of ``least`` or more pixels that stand as well at the last place where
    their beginning was. ``of`` is the number of each pixel's image; runs and distances stay in one."""
    n = len(p) - least + 1
    if n < 2:
        return []
    places = (of[least - 1 :] == of[:n]).nonzero()[0]
    wide = p.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(least):
        key ^= wide[k : n + k]
        key *= np.uint64(0x9E3779B97F4A7C15)
    key = key[places]
    order = key.argsort(kind="stable")
    order = order[of[places[order]].argsort(kind="stable")]
    sorted_keys, sorted_of = key[order], of[places[order]]
    same = ((sorted_keys[1:] == sorted_keys[:-1]) & (sorted_of[1:] == sorted_of[:-1])).nonzero()[0]
    if not len(same):
        return []
    back = np.zeros(n, np.int64)
    later, earlier = places[order[same + 1]], places[order[same]]
    each = np.arange(least)[:, None]
    real = (p[later + each] == p[earlier + each]).all(0)
    back[later[real]] = (later - earlier)[real]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(back[1:], back[:-1], out=edge[1:-1])
    edge = edge.nonzero()[0]
    distance, starts, ends = back[edge[:-1]], edge[:-1], edge[1:]
    some = distance > 0
    out, at = [], 0
    for i, j, d in zip(starts[some].tolist(), ends[some].tolist(), distance[some].tolist(), strict=True):
        end = j - 1 + least
        i = max(i, at)
        if end - i >= least:
            out += [(k, min(4096, end - k), d) for k in range(i, end, 4096)]
            at = end
    return out


def prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols of lengths or distances, with their extra bits and how many these are."""
    d = v - 1
    top = np.maximum(np.frexp(d.astype(float))[1] - 1, 1)
    n = np.where(d < 4, 0, top - 1)
    return np.where(d < 4, d, 2 * top + (d >> (top - 1) & 1)), d & ((1 << n) - 1), n


def put_image(out: Writer, p: np.ndarray, main: bool) -> None:
    """An entropy-coded image: back-references, cache entries and literals under five prefix codes."""
    if not main and (len(p) == 1 or (p == p[0]).all()):  # five codes of one symbol, no data
        colour = int(p[0])
        out.put(ONE_COLOUR | sum((colour >> k & 255) << at for k, at in ((8, 4), (16, 15), (0, 26), (24, 37))), 56)
        return
    put_images([out], [p], main)


#: Symbols of the first code: green, lengths, and entries of a cache of eight bits.
GREENS = 256 + 24 + 256


def put_images(outs: list[Writer], images: list[np.ndarray], main: bool) -> None:
    """Images (at most IMAGES), each as the next of its writer. What isn't a code of its own is worked out for all at once."""
    many = len(images)
    p, of = np.concatenate(images), np.arange(many, dtype=np.uint8).repeat([len(x) for x in images])
    marks = repeats(p, of) if main else []
    alone = np.ones(len(p), bool)
    place, length, back = np.array(marks, np.int64).reshape(-1, 3).T
    if marks:
        ends = length.cumsum()
        alone[(place - (ends - length)).repeat(length) + np.arange(ends[-1])] = False
    cached, hit, keys = np.zeros(many, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if main:
        keys = cache_key(p, 8)
        entry = of.astype(np.uint16) << np.uint16(8) | keys.astype(np.uint16)
        order = entry.argsort(kind="stable")
        colour, entry = p[order], entry[order]
        recent = order[1:][(colour[1:] == colour[:-1]) & (entry[1:] == entry[:-1])]
        hits = np.zeros(len(p), bool)
        hits[recent] = alone[recent]
        cached = np.bincount(of[hits], minlength=many) >= 16
        hits &= cached[of]
        alone &= ~hits
        hit = hits.nonzero()[0]
    literal = alone.nonzero()[0]
    c = _channels(p[literal])
    (ls, lx, ln), (ds, dx, dn) = (prefixed(length), prefixed(back + 120)) if marks else ((length,) * 3,) * 2
    whose = of[literal].astype(np.int64)
    green, rest = [whose * GREENS + c[:, 1], of[place] * np.int64(GREENS) + 256 + ls, of[hit] * np.int64(GREENS) + 280 + keys[hit]], whose * 256
    # red, blue and alpha have one code's lengths in common
    others = [rest + c[:, k] for k in (2, 0, 3)]
    far = of[place] * np.int64(40) + ds
    counts = [np.bincount(np.concatenate(x), minlength=many * k).reshape(many, k) for x, k in ((green, GREENS), (others, 256), ([far], 40))]
    lengths, codes = [np.zeros(x.shape, np.int64) for x in counts], [np.zeros(x.shape, np.uint64) for x in counts]
    for i, (out, has) in enumerate(zip(outs, cached.tolist(), strict=True)):
        out.put(1 | 8 << 1 if has else 0, 5 if has else 1)
        if main:
            out.put(0, 1)  # one group of codes
        for k, times in enumerate((1, 3, 1)):
            x = code_lengths(counts[k][i] if k or has else counts[k][i, : GREENS - 256])
            head = Writer()
            if head.code(x) > 1:  # a code of one symbol takes no bits
                lengths[k][i, : len(x)], codes[k][i, : len(x)] = x, canonical(x)
            out.put(sum(head.word << j * head.n for j in range(times)), times * head.n)
    lengths, codes = [x.reshape(-1) for x in lengths], [x.reshape(-1) for x in codes]
    value, size = np.zeros(len(p), np.uint64), np.zeros(len(p), np.int64)

    def joined(at: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Values with their sizes, each after the one before it."""
        v, k = parts[0]
        for more, its in parts[1:]:
            v = v | more.astype(np.uint64) << k.astype(np.uint64)
            k = k + its
        value[at], size[at] = v, k

    coded = lambda k, at: (codes[k][at], lengths[k][at])
    joined(literal, [coded(0, green[0]), *(coded(1, x) for x in others)])
    joined(hit, [coded(0, green[2])])
    if marks:
        joined(place, [coded(0, green[1]), (lx, ln), coded(2, far), (dx, dn)])
    for out, (word, n) in zip(outs, packed(value, size, [len(x) for x in images]), strict=True):
        out.put(word, n)


def packed(values: np.ndarray, sizes: np.ndarray, many: list[int]) -> Iterator[tuple[int, int]]:
    """Values of up to 64 bits one after another, as one number and its bits for each group of so many."""
    ends = sizes.cumsum()
    before = np.concatenate([[0], ends[np.cumsum(many) - 1]])
    total = before[1:] - before[:-1]
    words = (total >> 6) + 2
    begin = words.cumsum() - words
    start = ends - sizes + (64 * begin - before[:-1]).repeat(many)
    word, low = start >> 6, (start & 63).astype(np.uint64)
    first = np.empty(len(word), bool)  # the first value that begins in a word of 64 bits
    first[:1] = True
    np.not_equal(word[1:], word[:-1], out=first[1:])
    first = first.nonzero()[0]
    out = np.zeros(int(words.sum()), "<u8")
    out[word[first]] = np.bitwise_or.reduceat(values << low, first)
    last = np.append(first[1:], len(word)) - 1  # only the last can reach into the next word
    last = last[low[last] > 0]
    out[word[last] + 1] |= values[last] >> (np.uint64(64) - low[last])
    for i, k, n in zip(begin.tolist(), words.tolist(), total.tolist(), strict=True):
        yield int.from_bytes(out[i : i + k].tobytes(), "little"), n


#: x log2 x, for the entropies of tiles.
_xlog = np.array([0.0, *(x * np.log2(x) for x in range(1, 1025))])


def factors(p: np.ndarray) -> tuple[int, int, int]:
    """Least-squares slopes green to red, green to blue and red to what is left of blue, in 32nds, for signed bytes; 0
    where one explains little."""
    m = _channels(p).view(np.int8).T[:3].astype(np.float32)
    m -= m.sum(1, keepdims=True) / m.shape[1]
    (bb, gb, rb), (_, gg, rg), (_, _, rr) = (m @ m.T).tolist()

    def slope(both: float, a: float, b: float) -> int:
        return max(-128, min(127, round(32 * both / a))) if both * both > 0.1 * a * b > 0 else 0

    to_red, to_blue = slope(rg, gg, rr), slope(gb, gg, bb)
    f = to_blue / 32
    return to_red, to_blue, slope(rb - f * rg, rr, bb - 2 * f * gb + f * f * gg)


#: Images that are encoded together, and their bytes in all (one may have more).
IMAGES, TOGETHER = 256, 1 << 18


def encode(pixels: np.ndarray) -> bytes:
    """A lossless file of pixels (height x width, uint32 ARGB); see the module's text for what it chooses."""
    return encode_all([pixels])[0]


def encode_all(images: list[np.ndarray]) -> list[bytes]:
    """Files of at most IMAGES images of one width. Each is what ``encode`` makes of it alone; the steps are taken for all
    images at once, as most images are small."""
    width, heights = images[0].shape[1], np.array([len(x) for x in images])
    outs = [Writer() for _ in images]
    for out, height in zip(outs, heights.tolist(), strict=True):
        out.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    of = np.arange(len(images), dtype=np.uint64).repeat(heights * width)
    colours = np.sort(of << np.uint64(32) | np.concatenate([x.reshape(-1) for x in images]))
    first = np.ones(len(colours), bool)
    np.not_equal(colours[1:], colours[:-1], out=first[1:])
    colours = colours[first]
    many = np.bincount((colours >> np.uint64(32)).astype(np.int64), minlength=len(images))
    few = (many <= np.minimum(256, np.maximum(2, heights * width // 8))).tolist()
    ends = many.cumsum().tolist()
    main = {i: _put_palette(outs[i], images[i], colours[ends[i] - many[i] : ends[i]].astype(np.uint32)) for i, x in enumerate(few) if x}
    rest = [i for i, x in enumerate(few) if not x]
    if rest:
        main |= zip(rest, _put_transforms([outs[i] for i in rest], [images[i] for i in rest]), strict=True)
    put_images(outs, [main[i] for i in range(len(images))], True)
    return [container(out.word.to_bytes(-(-out.n // 8), "little")) for out in outs]


def _put_palette(out: Writer, pixels: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """Writes the palette transform; the pixels of the image under it."""
    height, width = pixels.shape
    index = np.searchsorted(colours, pixels)
    b = pack_bits(len(colours))
    out.put(1, 1)
    out.put(PALETTE, 2)
    out.put(len(colours) - 1, 8)
    steps = _channels(colours)
    put_image(out, np.concatenate([steps[:1], steps[1:] - steps[:-1]]).view("<u4").reshape(-1), False)
    grid = np.zeros((height, -(-width >> b) << b), np.uint32)
    grid[:, :width] = index
    packed = (grid.reshape(height, -1, 1 << b) << (np.arange(1 << b, dtype=np.uint32) * np.uint32(8 >> b))).sum(2, dtype=np.uint32)
    out.put(0, 1)
    return (packed << np.uint32(8) | np.uint32(0xFF000000)).reshape(-1)


def _put_transforms(outs: list[Writer], images: list[np.ndarray]) -> list[np.ndarray]:
    """Writes predictors and colour transforms of images of one width; the pixels of the images under them."""
    width, heights = images[0].shape[1], np.array([len(x) for x in images])
    x = _channels(np.concatenate(images))
    ends = heights.cumsum()
    start = ends - heights
    above = x.copy()
    above[1:] -= x[:-1]
    above[start] = x[start]
    residual = x.copy()
    bits = 4 if width <= 16 else 9
    tiles = -(-heights >> bits)
    until = tiles.cumsum()
    tile = (until - tiles).repeat(heights) + (np.arange(len(x)) - start.repeat(heights) >> bits)
    if width <= 16:
        cost = [-_xlog[np.bincount(((tile * 256)[:, None] + v.reshape(len(v), -1)).reshape(-1), minlength=256 * int(until[-1]))].reshape(-1, 256).sum(1) for v in (x, above)]
        up = cost[1] < cost[0]
    else:
        up = np.ones(until[-1], bool)
    residual[..., 3] -= np.uint8(255)
    residual[up[tile]] = above[up[tile]]
    residual[:, 0] = above[:, 0]
    residual[start, 1:] = x[start, 1:] - x[start, :-1]
    residual[start, 0] = x[start, 0] - np.array([0, 0, 0, 255], np.uint8)
    modes = np.where(up, 2, 0).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    slopes = np.array([factors(residual[i:j].view("<u4").reshape(-1)) for i, j in zip(start.tolist(), ends.tolist(), strict=True)], np.int16)
    minus_green = slopes[:, :2].min(1) > 16
    slopes[minus_green] = 0
    to_red, to_blue, red_to_blue = slopes.repeat(heights, 0).T[:, :, None]
    part = residual.view(np.int8)
    green, red = part[..., 1].astype(np.int16), part[..., 2].astype(np.int16)
    residual[..., 2] -= (green * to_red >> 5).astype(np.uint8)
    residual[..., 0] -= ((green * to_blue >> 5) + (red * red_to_blue >> 5)).astype(np.uint8)
    less = np.where(minus_green.repeat(heights)[:, None], residual[..., 1], np.uint8(0))
    residual[..., 2] -= less
    residual[..., 0] -= less
    elements = np.uint32(0xFF000000) | (slopes[:, ::-1].astype(np.uint8).astype(np.uint32) << np.array([16, 8, 0], np.uint32)).sum(1, dtype=np.uint32)
    main = []
    for k, out in enumerate(outs):
        image = modes[until[k] - tiles[k] : until[k]].repeat(-(-width >> bits))
        for kind, b, its in ((PREDICTOR, bits, image), (CROSS_COLOUR, 9, elements[k : k + 1].repeat(-(-int(heights[k]) >> 9) * -(-width >> 9)))):
            out.put(1 | kind << 1 | (b - 2) << 3, 6)
            put_image(out, its, False)
        if minus_green[k]:
            out.put(1 | SUBTRACT_GREEN << 1, 3)
        out.put(0, 1)
        main.append(residual[start[k] : ends[k]].view("<u4").reshape(-1))
    return main


#: Bytes of one stored image: 16 pixels a row, at most MAX_SIDE rows.
IMAGE_BYTES = 16 * 4 * MAX_SIDE


def store(payload: bytes) -> bytes:
    """Bytes (a positive multiple of 64) as one or more files, one after another."""
    return next(store_all([payload]))


def store_all(payloads: Iterable[bytes]) -> Iterator[bytes]:
    """What ``store`` makes of each; small ones are encoded together."""
    group: list[np.ndarray] = []
    size = 0
    for payload in payloads:
        if not payload or len(payload) % 64:
            raise ValueError("a positive multiple of 64 bytes is needed")
        parts = [np.frombuffer(payload[i : i + IMAGE_BYTES], "<u4").reshape(-1, 16) for i in range(0, len(payload), IMAGE_BYTES)]
        if group and (len(group) == IMAGES or size + len(payload) > TOGETHER):
            yield from encode_all(group)
            group, size = [], 0
        if len(parts) > 1:
            yield b"".join(map(encode, parts))  # over TOGETHER, so the group before is done
            continue
        group.append(parts[0])
        size += len(payload)
    if group:
        yield from encode_all(group)


def files(media: bytes) -> Iterator[bytes]:
    """The files that stand one after another."""
    at = 0
    while at < len(media):
        end = at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        yield media[at:end]
        at = end


def images(media: bytes) -> Iterator[np.ndarray]:
    """Pixel arrays of the files that stand one after another."""
    return map(decode, files(media))


def load(media: bytes) -> bytes:
    """The bytes that ``store`` was given."""
    return b"".join(np.ascontiguousarray(p, "<u4").tobytes() for p in images(media))


def load_all(media: Iterable[bytes]) -> Iterator[bytes]:
    """What ``load`` gives of each; small ones are decoded together."""
    group: list[bytes] = []
    size = 0
    for m in media:
        if group and (len(group) == IMAGES or size + len(m) > TOGETHER):
            yield from (np.ascontiguousarray(p, "<u4").tobytes() for p in decode_all(group))
            group, size = [], 0
        if len(m) > TOGETHER or len(m) != 8 + struct.unpack("<I", m[4:8])[0]:  # large, or several files
            yield from (np.ascontiguousarray(p, "<u4").tobytes() for p in (decode_all(group) if group else ()))
            group, size = [], 0
            yield load(m)
            continue
        group.append(m)
        size += len(m)
    yield from (np.ascontiguousarray(p, "<u4").tobytes() for p in (decode_all(group) if group else ()))


def media_column(text: F.Column) -> F.Column:
    """Column (binary): the UTF-8 of each text, zeros up to a positive multiple of 64, as lossless WebP."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        data, ends = common.raw(texts)
        whole = (data[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        return pa.array(list(store_all(x + bytes(-len(x) % 64 if x else 64) for x in whole)), pa.binary())

    return run(text)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: F.Column) -> F.Column:
    """Column (struct READ): checksums of the stored form and of the bytes read back from it, and simple statistics:
    rows, distinct bytes, mean byte, share of bytes over 127, mean step between rows."""

    @F.arrow_udf(READ)
    def run(stored: pa.Array) -> pa.Array:
        rows = []
        media = stored.to_pylist()
        for m, x in zip(media, load_all(media), strict=True):
            a = np.frombuffer(x, np.uint8)
            grid, counts = a.reshape(-1, 64).astype(np.int16), np.bincount(a, minlength=256)
            step = int(np.abs(grid[1:] - grid[:-1]).sum()) / (len(a) - 64) if len(grid) > 1 else 0.0
            feature = f"rows={len(grid)};distinct={np.count_nonzero(counts)};mean={int(counts @ np.arange(256)) / len(a):.6f};high={int(counts[128:].sum()) / len(a):.6f};step={step:.6f}"
            rows.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        names = [f.split()[0] for f in READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run(media)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the stored form (``media``) of its whole text; null texts count as empty."""
    return docs.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), media_column(F.col(text_col)).alias("media"))


def op5_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored and read back. Null text is 64 zero bytes; texts over 2^20 bytes are several files; equal
    texts give equal files; repeated rows are stored each; an empty table gives no row; only doc_id and text are read."""
    rows = stored(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", media_features(F.col("media")).alias("m"))
    return rows.select("doc_id", "n_bytes", "m.*")
