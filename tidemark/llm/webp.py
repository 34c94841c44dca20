"""Lossless WebP (VP8L, RFC 9649): encoder and decoder on numpy.

``decode`` reads any VP8L stream or a WebP file of one: prefix codes, back-references, the colour
cache, groups of prefix codes, and the predictor, cross-colour, subtract-green and palette
transforms.  ``decode_many`` decodes many streams in lockstep, one numpy step for a pixel of each:
a stream with groups of codes goes the plain way.

``encode_many`` writes pixel arrays with prefix codes fixed per kind of content (so that no table is
built per image), back-references to equal pixel pairs, colour-cache hits, and, where they make the
image smaller, a palette or a predictor.  All steps work on whole batches.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

CACHE_BITS, HASH = 6, 0x1E35A7BD
#: Fixed values of the format: the order of code-length codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (x, y) of the distance codes 1 to 120.
# fmt: off
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
# fmt: on


class Bits:
    """Reads bits, the lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + b"\0" * 8, at

    def peek(self) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 6], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        return value


def _reverse(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros_like(codes)
    for k in range(15):
        bit = (codes >> k) & 1
        out |= np.where(k < n, bit << np.maximum(n - 1 - k, 0), 0)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol as it is written, its first bit lowest."""
    lengths = np.asarray(lengths, dtype=np.int64)
    count = np.bincount(lengths, minlength=17)
    count[0] = 0
    start = np.zeros(17, dtype=np.int64)
    for k in range(1, 17):
        start[k] = (start[k - 1] + count[k - 1]) << 1
    codes = np.zeros(len(lengths), dtype=np.int64)
    for k in range(1, 16):
        at = np.flatnonzero(lengths == k)
        codes[at] = start[k] + np.arange(len(at))
    return _reverse(codes, lengths)


class Prefix:
    """A prefix code as one table: entry = symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:  # one symbol takes no bits
            self.bits, self.table = 0, np.array([(int(used[0]) if len(used) else 0) << 4], dtype=np.uint32)
            return
        if sum(1 << (15 - int(n)) for n in lengths[used]) != 1 << 15:
            raise ValueError("a prefix code isn't complete")
        self.bits = int(lengths.max())
        self.table = np.zeros(1 << self.bits, dtype=np.uint32)
        codes = canonical(lengths)
        for s in used:
            n = int(lengths[s])
            self.table[int(codes[s]) :: 1 << n] = int(s) << 4 | n

    def read(self, bits: Bits) -> int:
        entry = int(self.table[bits.peek() & (len(self.table) - 1)])
        bits.at += entry & 15
        return entry >> 4


def _read_prefix(bits: Bits, size: int) -> Prefix:
    lengths = np.zeros(size, dtype=np.int64)
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    codes = np.zeros(19, dtype=np.int64)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        codes[k] = bits.read(3)
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    reader, at, last = Prefix(codes), 0, 8
    while at < size and left:
        left -= 1
        s = reader.read(bits)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
        else:
            n, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
            if at + n > size:
                raise ValueError("code lengths run over")
            lengths[at : at + n] = value
            at += n
    return Prefix(lengths)


@dataclass
class Head:
    """What comes before a stream's pixels."""

    width: int
    height: int
    transforms: list = field(default_factory=list)  # (kind, size bits, image or None, width before)
    cache_bits: int = 0
    groups: list = field(default_factory=list)
    group_bits: int = 0
    group_image: np.ndarray | None = None
    coded_width: int = 0


def _value(code: int, bits: Bits) -> int:
    if code < 4:
        return code + 1
    n = (code - 2) >> 1
    return ((2 + (code & 1)) << n) + bits.read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _copy(out: np.ndarray, at: int, n: int, distance: int) -> None:
    if distance > at or at + n > len(out):
        raise ValueError("a back-reference leaves the image")
    while n > 0:  # overlapping copies double what they repeat
        k = min(n, distance)
        out[at : at + k] = out[at - distance : at - distance + k]
        at, n = at + k, n - k
        distance += k if k == distance else 0


def _pixels(bits: Bits, head: Head, width: int, height: int) -> np.ndarray:
    """One stream's pixels, one after the other."""
    out, at, end = np.zeros(width * height, dtype=np.uint32), 0, width * height
    cache = np.zeros(1 << head.cache_bits, dtype=np.uint32) if head.cache_bits else None
    shift, filled = 32 - head.cache_bits, 0
    while at < end:
        if head.group_image is None:
            group = head.groups[0]
        else:
            group = head.groups[int(head.group_image[(at // width) >> head.group_bits, (at % width) >> head.group_bits])]
        s = group[0].read(bits)
        if s < 256:
            r, b, a = (group[k].read(bits) for k in (1, 2, 3))
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = _value(s - 256, bits)
            _copy(out, at, n, _distance(_value(group[4].read(bits), bits), width))
            at += n
        else:
            for p in out[filled:at].tolist():
                cache[((p * HASH) & 0xFFFFFFFF) >> shift] = p
            filled = at
            out[at] = cache[s - 280]
            at += 1
        if bits.at > 8 * (len(bits.data) - 8):
            raise ValueError("the stream ends early")
    return out


def _codes(bits: Bits, head: Head, groups: int) -> None:
    if bits.read(1):
        head.cache_bits = bits.read(4)
        if not 1 <= head.cache_bits <= 11:
            raise ValueError("a colour cache of this size isn't allowed")
    if groups:
        return
    extra = 280 + (1 << head.cache_bits if head.cache_bits else 0)
    head.groups = [[_read_prefix(bits, n) for n in (extra, 256, 256, 256, 40)]]


def _sub_image(bits: Bits, width: int, height: int) -> np.ndarray:
    head = Head(width, height)
    _codes(bits, head, 0)
    return _pixels(bits, head, width, height).reshape(height, width)


def _tiles(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _head(bits: Bits) -> Head:
    if bits.read(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    head = Head(bits.read(14) + 1, bits.read(14) + 1)
    if bits.read(4) >> 1:
        raise ValueError("unknown version")
    width, seen = head.width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind < 2:
            size = bits.read(3) + 2
            head.transforms.append((kind, size, _sub_image(bits, _tiles(width, size), _tiles(head.height, size)), width))
        elif kind == 2:
            head.transforms.append((kind, 0, None, width))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_sub_image(bits, n, 1).view(np.uint8).reshape(n, 4), axis=0, dtype=np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            head.transforms.append((kind, pack, table.view(np.uint32).reshape(-1), width))
            width = _tiles(width, pack)
    head.coded_width = width
    if bits.read(1):
        head.cache_bits = bits.read(4)
        if not 1 <= head.cache_bits <= 11:
            raise ValueError("a colour cache of this size isn't allowed")
    n = 1
    if bits.read(1):
        head.group_bits = bits.read(3) + 2
        image = _sub_image(bits, _tiles(width, head.group_bits), _tiles(head.height, head.group_bits))
        head.group_image = (image >> 8) & 0xFFFF
        n = int(head.group_image.max()) + 1
    extra = 280 + (1 << head.cache_bits if head.cache_bits else 0)
    head.groups = [[_read_prefix(bits, k) for k in (extra, 256, 256, 256, 40)] for _ in range(n)]
    return head


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int16) + b) >> 1).astype(np.int16)


def predict(mode: int, left, top, corner, right):
    """The predictor's value for pixels (..., 4) as int16; right is the pixel above to the right."""
    if mode == 0:
        return np.broadcast_to(np.array([0, 0, 0, 255], dtype=np.int16), left.shape)
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7, 8, 9):
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        to_left, to_top = np.abs(top - corner).sum(axis=-1), np.abs(left - corner).sum(axis=-1)
        return np.where((to_left < to_top)[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = _average(left, top)
    half = mean - corner
    return np.clip(mean + np.where(half < 0, -((-half) // 2), half // 2), 0, 255)


def _predictor(image: np.ndarray, size: int, modes: np.ndarray, inverse: bool) -> np.ndarray:
    """image (h, w, 4) as B, G, R, A bytes; ``inverse``: from residuals to pixels."""
    h, w, _ = image.shape
    out = image.astype(np.int16)
    src = out if inverse else image.astype(np.int16)
    done = np.zeros_like(out)
    sign = 1 if inverse else -1
    black = np.array([0, 0, 0, 255], dtype=np.int16)
    for y in range(h):
        x = 0
        while x < w:
            mode = int(modes[y >> size, x >> size] >> 8) & 15
            stop = min(w, ((x >> size) + 1) << size)
            if y == 0 and x == 0:
                guess, stop = black[None], 1
            elif y == 0:
                mode = 1
            elif x == 0:
                guess, stop = src[y - 1, :1], 1
            if (y or x) and not (y and x == 0):
                if mode in (0, 2, 3, 4, 8, 9):  # no pixel to the left is needed: a run at once
                    row = src[y - 1]
                    right = np.concatenate([row[x + 1 : stop + 1], src[y, :1]])[: stop - x] if stop == w else row[x + 1 : stop + 1]
                    guess = predict(mode, row[x:stop], row[x:stop], row[x - 1 : stop - 1], right)
                elif not inverse:
                    row = src[y - 1] if y else src[y]
                    right = np.concatenate([row[x + 1 : stop + 1], src[y, :1]])[: stop - x] if stop == w else row[x + 1 : stop + 1]
                    guess = predict(mode, src[y, x - 1 : stop - 1], row[x:stop], row[x - 1 : stop - 1], right)
                else:
                    stop = x + 1
                    row = src[y - 1] if y else src[y]
                    right = row[x + 1] if x + 1 < w else src[y, 0]
                    guess = predict(mode, src[y, x - 1][None], row[x][None], row[x - 1][None], right[None])
            value = (image[y, x:stop].astype(np.int16) + sign * guess) & 255
            if inverse:
                src[y, x:stop] = value
            done[y, x:stop] = value
            x = stop
    return done.astype(np.uint8)


def _cross(image: np.ndarray, size: int, elements: np.ndarray, inverse: bool) -> np.ndarray:
    h, w, _ = image.shape
    e = np.repeat(np.repeat(elements, 1 << size, axis=0), 1 << size, axis=1)[:h, :w].astype(np.uint32)
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int32)
    to_red, to_blue, red_to_blue = (signed((e >> k) & 255) for k in (0, 8, 16))
    blue, green, red = (image[..., k].astype(np.int32) for k in (0, 1, 2))
    g = signed(green)
    sign = 1 if inverse else -1
    new_red = (red + sign * ((to_red * g) >> 5)) & 255
    base = signed(new_red if inverse else red)
    new_blue = (blue + sign * (((to_blue * g) >> 5) + ((red_to_blue * base) >> 5))) & 255
    return np.stack([new_blue, green, new_red, image[..., 3]], axis=-1).astype(np.uint8)


def _inverted(pixels: np.ndarray, head: Head) -> np.ndarray:
    """argb (h, w) after the transforms are undone."""
    image = pixels.reshape(head.height, head.coded_width)
    for kind, size, data, width in reversed(head.transforms):
        if kind == 3:
            index = ((image >> 8) & 255).astype(np.int64)
            if size:
                step = 8 >> size
                index = ((index[:, :, None] >> (np.arange(1 << size) * step)) & ((1 << step) - 1)).reshape(head.height, -1)[:, :width]
            image = np.append(data, np.zeros(256, np.uint32))[index].astype(np.uint32)
            continue
        rgb = np.ascontiguousarray(image).view(np.uint8).reshape(head.height, width, 4)
        if kind == 0:
            rgb = _predictor(rgb, size, data, True)
        elif kind == 1:
            rgb = _cross(rgb, size, data, True)
        else:
            rgb = np.stack([rgb[..., 0] + rgb[..., 1], rgb[..., 1], rgb[..., 2] + rgb[..., 1], rgb[..., 3]], axis=-1)
        image = np.ascontiguousarray(rgb).view(np.uint32).reshape(head.height, width)
    return image


def decode(stream: bytes) -> np.ndarray:
    """argb (h, w) uint32 of one VP8L stream."""
    bits = Bits(stream)
    head = _head(bits)
    return _inverted(_pixels(bits, head, head.coded_width, head.height), head)


# --- many streams in lockstep


class _Heads:
    """Parsed heads; a stream without transforms whose head has the very bits of an earlier one isn't parsed again."""

    def __init__(self):
        self.known: list[tuple[bytes, int, int, Head]] = []

    def of(self, stream: bytes) -> tuple[Head, int]:
        for lead, last, end, head in self.known:
            if stream.startswith(lead, 5) and (stream[5 + len(lead)] ^ last) & ((1 << (end & 7)) - 1) == 0:
                size = int.from_bytes(stream[1:5], "little")
                width = (size & 0x3FFF) + 1
                return Head(width, (size >> 14 & 0x3FFF) + 1, [], head.cache_bits, head.groups, 0, None, width), end
        bits = Bits(stream)
        head = _head(bits)
        if not head.transforms and head.group_image is None and len(self.known) < 16 and bits.at >> 3 < len(stream):
            self.known.append((stream[5 : bits.at >> 3], stream[bits.at >> 3], bits.at, head))
        return head, bits.at


def decode_many(streams: list[bytes], lanes: int = 2048) -> list[np.ndarray]:
    heads, out = _Heads(), [None] * len(streams)
    todo = []
    for i, s in enumerate(streams):
        head, at = heads.of(s)
        if head.group_image is not None or sum(p.bits for p in head.groups[0][:4]) > 56:
            out[i] = _inverted(_pixels(Bits(s, at), head, head.coded_width, head.height), head)
        else:
            todo.append((head.coded_width * head.height, i, head, at))
    todo.sort(key=lambda x: -x[0])
    for lo in range(0, len(todo), lanes):
        part = todo[lo : lo + lanes]
        for (_, i, head, _), pixels in zip(part, _lockstep([streams[i] for _, i, _, _ in part], [h for _, _, h, _ in part], [a for *_, a in part])):
            out[i] = _inverted(pixels, head)
    return out


def _lockstep(streams: list[bytes], heads: list[Head], ats: list[int]) -> list[np.ndarray]:
    """The pixels of streams with one group of codes each, longest first."""
    buffer = b"".join(streams) + b"\0" * 8
    words = np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    ends = np.cumsum([len(s) for s in streams])
    bit = 8 * (ends - [len(s) for s in streams]) + np.array(ats)
    tables, base = [], {}
    for h in heads:
        if id(h.groups[0]) not in base:
            row = []
            for p in h.groups[0][:4]:
                row += [sum(map(len, tables)), len(p.table) - 1]
                tables.append(p.table)
            base[id(h.groups[0])] = row
    table = np.concatenate(tables).astype(np.int64)
    spec = np.array([base[id(h.groups[0])] for h in heads], dtype=np.int64)
    sizes = np.array([h.coded_width * h.height for h in heads])
    at = np.cumsum(sizes) - sizes
    stop = at + sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint32)
    cache_bits = np.array([h.cache_bits for h in heads])
    cache = np.zeros((len(heads), 1 << int(cache_bits.max(initial=0))), dtype=np.uint32)
    lane = np.arange(len(heads))
    shift = (32 - cache_bits).astype(np.uint32)
    cached, mult = bool(cache_bits.max(initial=0)), np.uint32(HASH)
    same = len(base) == 1
    begin = at.copy()
    while len(lane):
        w = words[bit >> 3] >> (bit & 7).astype(np.uint64)
        used = np.zeros(len(lane), dtype=np.int64)
        values = []
        for k in range(4):
            start, mask = (int(spec[0, 2 * k]), int(spec[0, 2 * k + 1])) if same else (spec[lane, 2 * k], spec[lane, 2 * k + 1])
            entry = table[start + ((w >> used.astype(np.uint64)).astype(np.int64) & mask)]
            values.append(entry >> 4)
            used += entry & 15
            if k == 0:
                first = used.copy()
        g, r, b, a = values
        argb = (a << 24 | r << 16 | g << 8 | b).astype(np.uint32)
        odd = np.flatnonzero(g >= 256)
        step = np.ones(len(lane), dtype=np.int64)
        if len(odd):
            used[odd] = first[odd]
            hit = odd[g[odd] >= 280]
            argb[hit] = cache[lane[hit], g[hit] - 280]
            for j in odd[g[odd] < 280].tolist():
                head = heads[lane[j]]
                bits = _At(words, int(bit[j] + first[j]))
                n = _value(int(g[j]) - 256, bits)
                d = _distance(_value(head.groups[0][4].read(bits), bits), head.coded_width)
                if d > at[j] - begin[lane[j]] or at[j] + n > stop[j]:
                    raise ValueError("a back-reference leaves the image")
                _copy(out, int(at[j]), n, d)
                used[j], step[j] = bits.at - bit[j], n
                argb[j] = out[at[j]]
                if head.cache_bits:
                    p = out[at[j] : at[j] + n]
                    cache[lane[j], (p * mult) >> shift[j]] = p
        out[at] = argb
        if cached:
            copied = step > 1
            if copied.any():
                k = ~copied
                cache[lane[k], np.where(shift[k] < 32, (argb[k] * mult) >> np.minimum(shift[k], 31), 0)] = argb[k]
            else:
                cache[lane, np.where(shift < 32, (argb * mult) >> np.minimum(shift, 31), 0)] = argb
        at = at + step
        bit = bit + used
        live = at < stop
        if not live.all():
            over = bit[~live] > 8 * ends[lane[~live]]
            if over.any():
                raise ValueError("a stream ends early")
            lane, at, stop, bit, shift = lane[live], at[live], stop[live], bit[live], shift[live]
            if len(lane) and (bit > 8 * ends[lane]).any():
                raise ValueError("a stream ends early")
    return np.split(out, np.cumsum(sizes)[:-1])


class _At:
    """Bits over the shared words."""

    def __init__(self, words: np.ndarray, at: int):
        self.words, self.at = words, at

    def peek(self) -> int:
        return int(self.words[self.at >> 3]) >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        return value


# --- encoding


def _huffman(weights: np.ndarray, limit: int = 12) -> np.ndarray:
    """Code lengths of at most ``limit`` bits; weights of zero get no code."""
    used = np.flatnonzero(weights)
    floor = weights[used].sum() / (1 << (limit - 1))
    while True:
        heap = [(max(float(weights[s]), floor), int(s), (int(s),)) for s in used]
        heapq.heapify(heap)
        lengths = np.zeros(len(weights), dtype=np.int64)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            lengths[list(a[2] + b[2])] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if lengths.max() <= limit:
            return lengths
        floor *= 1.5


def _weights(kind: str) -> np.ndarray:
    """Frequencies of bytes: of texts in Latin script ("ascii", "latin"), or all alike ("flat")."""
    if kind == "flat":
        return np.ones(256)
    w = np.zeros(256)
    w[32:127] = 1
    w[[0, 9, 10, 13]] = 1, 0.3, 8, 0.3
    w[32] = 180
    for c, n in zip("etaonirshdlucmgfpwybvkxjqz", (120, 88, 78, 72, 74, 72, 62, 58, 48, 34, 36, 30, 26, 22, 18, 18, 18, 16, 14, 12, 9, 7, 3, 3, 3, 2)):
        w[ord(c)], w[ord(c.upper())] = n, max(1.0, n / 14)
    w[[ord(c) for c in ",."]] = 9, 12
    if kind == "latin":
        w[128:] = 0.5
        w[0xC3] = 30
        w[[0xA0, 0xA1, 0xA4, 0xA7, 0xA8, 0xA9, 0xAA, 0xAD, 0xB1, 0xB3, 0xB6, 0xBC]] = 3
    return w


class _Writer:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def _write_prefix(out: _Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 1:
        out.put(1, 1)
        out.put(0, 1)
        s = int(used[0]) if len(used) else 0
        out.put(s > 1, 1)
        out.put(s, 8 if s > 1 else 1)
        return
    items, at, last = [], 0, 8  # (symbol, extra, bits of extra)
    stop = int(used[-1]) + 1
    while at < stop:
        v, run = int(lengths[at]), 1
        while at + run < stop and lengths[at + run] == v:
            run += 1
        if v == 0 and run >= 3:
            run = min(run, 138)
            items.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
        elif v and v == last and run >= 3:
            run = min(run, 6)
            items.append((16, run - 3, 2))
        else:
            run = 1
            items.append((v, 0, 0))
        last = v or last
        at += run
    count = np.bincount([s for s, _, _ in items], minlength=19).astype(float)
    if (count > 0).sum() == 1:
        count[0 if count[0] == 0 else 1] = 0.5
    codes = _huffman(count, 7)
    order = [int(codes[k]) for k in LENGTH_ORDER]
    n = max(4, max(i + 1 for i, v in enumerate(order) if v))
    out.put(0, 1)
    out.put(n - 4, 4)
    for v in order[:n]:
        out.put(v, 3)
    if stop < len(lengths):  # tell how many items there are
        need = max(1, -(-max(1, (len(items) - 2).bit_length()) // 2))
        out.put(1, 1)
        out.put(need - 1, 3)
        out.put(len(items) - 2, 2 * need)
    else:
        out.put(0, 1)
    words = canonical(codes)
    for s, extra, bits in items:
        out.put(int(words[s]), int(codes[s]))
        out.put(extra, bits)


@lru_cache(maxsize=8)
def _set(kind: str) -> tuple[list[np.ndarray], list[np.ndarray], _Writer]:
    """Lengths and codes of the five prefix codes of a kind of content, and their bits with the colour cache's."""
    grey = kind == "grey"  # one sample a pixel, in green
    w = _weights("flat" if grey else kind)
    green = np.concatenate([w, np.full(24, w.sum() / 2000), np.full(1 << CACHE_BITS, w.sum() / 800)])
    one = np.zeros(256, dtype=np.int64)
    one[0] = 1
    rest = one if grey else _huffman(w)
    alpha = np.roll(one, 255) if grey else rest
    lengths = [_huffman(green), rest, rest, alpha, _huffman(np.ones(40))]
    out = _Writer()
    out.put(1, 1)
    out.put(CACHE_BITS, 4)
    out.put(0, 1)
    for x in lengths:
        _write_prefix(out, x)
    return [np.where((x > 0).sum() > 1, x, 0) for x in lengths], [canonical(x) for x in lengths], out


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix code, extra bits' value, their number) of lengths or distances."""
    v = np.maximum(value - 1, 0)
    n = np.maximum(np.floor(np.log2(np.maximum(v, 1))).astype(np.int64) - 1, 0)
    small = v < 4
    code = np.where(small, v, 2 * n + 2 + ((v >> n) & 1))
    return code, np.where(small, 0, v & ((1 << n) - 1)), np.where(small, 0, n)


def _body(pixels: np.ndarray, owner: np.ndarray, width: np.ndarray, kind: str, head_bits: np.ndarray) -> list[bytes]:
    """Coded pixels of many images in a row (owner: each pixel's image), each after room for its head."""
    lengths, codes, _ = _set(kind)
    n = len(pixels)
    first = np.append(True, owner[1:] != owner[:-1])
    start = np.flatnonzero(first)
    index = np.arange(n)
    # back-references: the last earlier place of the same two pixels, runs with one distance
    pair = (pixels[:-1].astype(np.uint64) << np.uint64(32)) | pixels[1:]
    order = np.lexsort((index[:-1], pair, owner[:-1]))
    before = np.full(n, -1)
    equal = (pair[order[1:]] == pair[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    before[order[1:][equal]] = order[:-1][equal]
    before[np.flatnonzero(first[1:])] = -1  # a pair doesn't cross images
    distance = np.where(before >= 0, index - before, 0)
    begin = np.append(True, distance[1:] != distance[:-1]) | first
    run = np.flatnonzero(begin)
    size = np.diff(np.append(run, n)) + 1
    good = (distance[run] > 0) & (size >= 4)
    run, size = run[good], np.minimum(size[good], 4096)
    free = np.append(True, run[1:] >= run[:-1] + size[:-1]) if len(run) else np.zeros(0, bool)
    size = np.where(free, size, size - 1)  # runs that touch share one pixel
    run = np.where(free, run, run + 1)
    role = np.zeros(n, dtype=np.int8)  # 0 literal, 1 cache, 2 match, 3 inside one
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, run, 1)
    np.add.at(edge, np.minimum(run + size, n), -1)
    role[np.cumsum(edge[:-1]) > 0] = 3
    role[run] = 2
    # colour cache: the last pixel with the same slot is this one
    slot = ((pixels * np.uint32(HASH)) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
    order = np.lexsort((index, slot, owner))
    hit = np.zeros(n, dtype=bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    role[(role == 0) & hit] = 1
    values, bits = np.zeros((n, 4), dtype=np.int64), np.zeros((n, 4), dtype=np.int64)
    for k, channel in enumerate((8, 16, 0, 24)):
        sample = ((pixels >> np.uint32(channel)) & np.uint32(255)).astype(np.int64)
        values[:, k], bits[:, k] = codes[k][sample], lengths[k][sample]
        if k and (role == 0).any() and (lengths[k] > 0).any() and (bits[role == 0, k] == 0).any():
            raise ValueError("a sample has no code")
    if (bits[role == 0, 0] == 0).any():
        raise ValueError("a sample has no code")
    at = np.flatnonzero(role == 1)
    values[at], bits[at] = 0, 0
    values[at, 0], bits[at, 0] = codes[0][280 + slot[at]], lengths[0][280 + slot[at]]
    at = np.flatnonzero(role == 2)
    code, extra, count = _prefixed(size)
    values[at, 0], bits[at, 0], values[at, 1], bits[at, 1] = codes[0][256 + code], lengths[0][256 + code], extra, count
    d = distance[run]
    code, extra, count = _prefixed(np.where(d == width[owner[run]], 1, np.where(d == 1, 2, d + 120)))
    values[at, 2], bits[at, 2], values[at, 3], bits[at, 3] = codes[4][code], lengths[4][code], extra, count
    bits[role == 3] = 0
    each = bits.sum(axis=1)
    total = np.add.reduceat(each, start) + head_bits
    room = (total + 31) // 32
    word0 = np.cumsum(room) - room
    flat = bits.reshape(-1)
    offset = np.cumsum(flat) - flat
    own = np.repeat(owner - owner[0], 4)
    offset = offset - offset[4 * start][own] + (32 * word0 + head_bits)[own]
    use = flat > 0
    offset, value = offset[use], values.reshape(-1)[use].astype(np.uint64) << (offset[use] & 31).astype(np.uint64)
    size = int(room.sum()) + 1
    low = np.bincount(offset >> 5, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)
    high = np.bincount((offset >> 5) + 1, weights=(value >> np.uint64(32)).astype(np.float64), minlength=size + 1)[:size]
    raw = (low + high).astype(np.uint64).astype("<u4").tobytes()
    return [raw[4 * a : 4 * a + (int(t) + 7) // 8] for a, t in zip(word0.tolist(), total.tolist())]


def _start(width: int, height: int) -> _Writer:
    out = _Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 4)  # alpha is used, version 0
    return out


def _write_image(out: _Writer, pixels: np.ndarray) -> None:
    """A small image inside a head: no cache, 8-bit literals."""
    out.put(0, 1)
    for k, channel in enumerate((8, 16, 0, 24)):
        used = np.unique((pixels.reshape(-1) >> np.uint32(channel)) & np.uint32(255))
        lengths = np.zeros(280 if k == 0 else 256, dtype=np.int64)
        lengths[:256] = 8
        if len(used) == 1:
            lengths[:] = 0
            lengths[used[0]] = 1
        _write_prefix(out, lengths)
    one = np.zeros(40, dtype=np.int64)
    one[0] = 1
    _write_prefix(out, one)
    flat = canonical(np.full(256, 8))
    many = [len(np.unique((pixels.reshape(-1) >> np.uint32(c)) & np.uint32(255))) > 1 for c in (8, 16, 0, 24)]
    for p in pixels.reshape(-1).tolist():
        for c, wide in zip((8, 16, 0, 24), many):
            if wide:
                out.put(int(flat[p >> c & 255]), 8)


def content(data: np.ndarray) -> str:
    """The kind of prefix codes that can write all of these bytes."""
    seen = np.bincount(data, minlength=256) > 0
    for kind in ("ascii", "latin"):
        if not (seen & (_weights(kind) == 0)).any():
            return kind
    return "flat"


def encode(image: np.ndarray, kind: str = "flat", transforms: tuple = ()) -> bytes:
    """One VP8L stream of argb (h, w).  transforms, in coding order: ("palette",), ("green",), ("predictor", size bits, modes)
    or ("cross", size bits, elements)."""
    height, width = image.shape
    out, pixels, coded = _start(width, height), image.astype(np.uint32), width
    for t in transforms:
        out.put(1, 1)
        rgb = np.ascontiguousarray(pixels).view(np.uint8).reshape(height, coded, 4)
        if t[0] == "palette":
            colours, index = np.unique(pixels, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            out.put(3, 2)
            out.put(len(colours) - 1, 8)
            delta = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
            _write_image(out, np.ascontiguousarray(delta).view(np.uint32).reshape(1, -1))
            n = len(colours)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            index = index.reshape(height, width)
            coded = _tiles(width, pack)
            padded = np.zeros((height, coded << pack), dtype=np.int64)
            padded[:, :width] = index
            packed = (padded.reshape(height, coded, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))).sum(axis=2)
            pixels, kind = (np.uint32(0xFF000000) | (packed.astype(np.uint32) << np.uint32(8))), "grey"
        elif t[0] == "green":
            out.put(2, 2)
            rgb = np.stack([rgb[..., 0] - rgb[..., 1], rgb[..., 1], rgb[..., 2] - rgb[..., 1], rgb[..., 3]], axis=-1)
            pixels, kind = np.ascontiguousarray(rgb).view(np.uint32).reshape(height, coded), "flat"
        else:
            out.put(0 if t[0] == "predictor" else 1, 2)
            out.put(t[1] - 2, 3)
            _write_image(out, t[2].astype(np.uint32))
            rgb = (_predictor if t[0] == "predictor" else _cross)(rgb, t[1], t[2].astype(np.uint32), False)
            pixels, kind = np.ascontiguousarray(rgb).view(np.uint32).reshape(height, coded), "flat"
    out.put(0, 1)
    _, _, codes = _set(kind)
    out.put(codes.value, codes.n)
    flat = pixels.reshape(-1).astype(np.uint32)
    body = _body(flat, np.zeros(len(flat), np.int64), np.array([coded]), kind, np.array([out.n]))[0]
    return (int.from_bytes(body, "little") | out.value).to_bytes(len(body), "little")


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """Streams of argb images (h, w), coded together by kind of content."""
    out: list = [None] * len(images)
    groups: dict[str, list[int]] = {}
    for i, image in enumerate(images):
        colours = np.unique(image[:64]) if image.size >= 128 else None
        if colours is not None and len(colours) <= 16 and len(colours := np.unique(image)) <= 16:
            out[i] = encode(image, transforms=(("palette",),))
        elif image.shape[0] >= 16 and (image[1:] == image[:-1]).mean() > 0.8:  # rows repeat: predict from above
            modes = np.full((_tiles(image.shape[0], 9), _tiles(image.shape[1], 9)), 2 << 8 | 0xFF000000, dtype=np.uint32)
            out[i] = encode(image, transforms=(("predictor", 9, modes),))
        else:
            groups.setdefault(content(np.ascontiguousarray(image).view(np.uint8).reshape(-1)), []).append(i)
    for kind, members in groups.items():
        _, _, codes = _set(kind)
        n = 40 + 1 + codes.n  # the start, no transform, the codes
        pixels = np.concatenate([images[i].reshape(-1) for i in members]).astype(np.uint32)
        owner = np.repeat(np.arange(len(members)), [images[i].size for i in members])
        widths = np.array([images[i].shape[1] for i in members])
        lead = (codes.value << 41).to_bytes((n + 7) // 8, "little")
        last = len(lead) - 1
        for i, body in zip(members, _body(pixels, owner, widths, kind, np.full(len(members), n))):
            h, w = images[i].shape
            out[i] = _start(w, h).value.to_bytes(5, "little") + lead[5:last] + bytes([lead[last] | body[last]]) + body[last + 1 :]
    return out


# --- files


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def _u24(*values: int) -> bytes:
    return b"".join(v.to_bytes(3, "little") for v in values)


def wrap(streams: list[bytes], width: int, heights: list[int]) -> bytes:
    """A WebP file: of one stream, or of one frame for each strip of an image from the top."""
    if len(streams) == 1:
        body = _chunk(b"VP8L", streams[0])
    else:
        body = _chunk(b"VP8X", bytes([0x12, 0, 0, 0]) + _u24(width - 1, sum(heights) - 1)) + _chunk(b"ANIM", b"\0" * 6)
        y = 0
        for s, h in zip(streams, heights):
            body += _chunk(b"ANMF", _u24(0, y // 2, width - 1, h - 1, 0) + b"\0" + _chunk(b"VP8L", s))
            y += h
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def unwrap(file: bytes) -> list[bytes]:
    """The VP8L streams of a WebP file in order."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, at = [], 12
    while at + 8 <= len(file):
        name, n = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        data = file[at + 8 : at + 8 + n]
        if name == b"VP8L":
            out.append(data)
        elif name == b"ANMF":
            size = struct.unpack_from("<I", data, 20)[0]
            out.append(data[24 : 24 + size])
        at += 8 + n + n % 2
    return out
