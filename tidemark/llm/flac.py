"""FLAC for media columns: a vectorised encoder and decoder of whole batches, and PCM blocks with sample offsets.

Decoder (the operator): stream info and frame headers are parsed, header CRC-8 and frame CRC-16 are verified, Rice
residuals of all frames of a batch are decoded in step (sample by sample over thousands of frames at once), and
constant, verbatim, fixed and linear-prediction subframes are restored; each frame gives a PCM block with its first
sample's offset, so that any sample is found by its block's offset without decoding what stands before it.

Encoder (to store bytes losslessly): mono, 8 bits a sample (byte - 128), frames of ``FRAME`` samples, fixed
predictors of order 0 to 2 by least absolute residual (or a given linear predictor), one Rice partition with the
parameter that the mean asks for; frames of one value are constant, and frames that Rice does not shorten verbatim.

CRC-16 of all frames at once: leading zeros change nothing, so frames are filled up in front to pieces of ``PIECE``
bytes; all pieces go through a table of two bytes in step, and as the code is linear, a frame's pieces are joined by a
table that carries a checksum over ``PIECE`` zeros.

Supported streams: one to eight channels, stereo as left and right, left and side, side and right, or mid and side; 4
to 24 bits a sample, fixed or variable block size up to 65,535 samples, Rice parameters of 4 and 5 bits with escapes,
all partition orders, wasted bits. Broken streams and bad checksums (of headers, frames and the whole stream) raise
``ValueError``.

Memory: frames are coded and decoded in groups of about ``TOGETHER`` bytes, however long a stream is, so a very long
text costs its own size a few times over. (A stream with samples that look like a frame is walked instead, which
needs all its bits at once.)

Defined cases: a null text counts as empty and gives one padded block; an empty table gives no rows; repeated rows
are coded alike; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, by_bytes, prepare

FRAME, RATE, PAD = 1024, 8000, 64
#: Payload bytes that are coded together: bounds a worker's memory.
TOGETHER = 1_500_000
#: Samples that are worked on at once: what is made of them stays in a core's cache.
CACHED = 100_000
#: Bytes of a frame that one step of its checksum's joining covers.
PIECE = 64
#: Rounds in which the query stores and decodes its table: scratch holds the media of one round at a time.
ROUNDS = 3
#: Fixed predictors by order: coefficients of the samples before.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc8_table() -> np.ndarray:
    t = np.arange(256, dtype=np.int64)
    for _ in range(8):
        t = np.where(t & 0x80, (t << 1) ^ 0x07, t << 1) & 0xFF
    return t


def _crc16_table() -> np.ndarray:
    t = np.arange(256, dtype=np.int64) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t


CRC8, CRC16 = _crc8_table(), _crc16_table()


def _crc16_words() -> tuple[np.ndarray, np.ndarray]:
    """Checksums of all words of two bytes, and of all checksums after PIECE zero bytes more."""
    w = np.arange(1 << 16)
    c = CRC16[w >> 8]
    two = (((c << 8) & 0xFFFF) ^ CRC16[(c >> 8) ^ (w & 0xFF)]).astype(np.uint16)
    far, covered = two, 2
    while covered < PIECE:
        far, covered = far[far], 2 * covered
    return two, far


CRC16_TWO, CRC16_FAR = _crc16_words()


def _groups(sizes) -> Iterator[tuple[int, int]]:
    """Ranges of about TOGETHER bytes each, one item at least."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held + n > TOGETHER and i > at:
            yield at, i
            at, held = i, 0
        held += int(n)
    if at < len(sizes):
        yield at, len(sizes)


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of each slice of the bytes in data."""
    if not len(starts):
        return np.zeros(0, np.int64)
    groups = list(_groups(sizes))
    if len(groups) > 1:
        return np.concatenate([crc16(data, starts[a:z], sizes[a:z]) for a, z in groups])
    sizes = np.asarray(sizes, np.int64)
    pieces = np.maximum(1, -(-sizes // PIECE))
    first = np.cumsum(pieces) - pieces
    fill = pieces * PIECE - sizes
    step = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    at = np.repeat(starts - fill, pieces) + step * PIECE
    rows = np.empty((len(at), PIECE), np.uint8)
    inner = step > 0
    if inner.any():
        rows[inner] = np.lib.stride_tricks.sliding_window_view(data, PIECE)[at[inner]]
    # a frame's first piece begins before the frame
    col = np.arange(PIECE)
    rows[first] = np.where(col >= fill[:, None], data[np.maximum(at[first][:, None] + col, 0)], 0)
    each = np.zeros(len(rows), np.uint16)
    for w in np.ascontiguousarray(rows.view(">u2").T).astype(np.uint16):
        each = CRC16_TWO[each ^ w]
    out = each[first]
    for j in range(1, int(pieces.max())):
        w = np.flatnonzero(pieces > j)
        out[w] = CRC16_FAR[out[w]] ^ each[first[w] + j]
    return out.astype(np.int64)


def crc8(rows: np.ndarray) -> np.ndarray:
    """CRC-8 of each row of a byte matrix."""
    out = np.zeros(len(rows), np.int64)
    for j in range(rows.shape[1]):
        out = CRC8[out ^ rows[:, j]]
    return out


def utf8_number(n: int) -> bytes:
    """A frame or sample number in the format's variable-length code."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(2 * lead + 1) & 0xFF) | n, *reversed(tail)])


def predicted(x: np.ndarray, order: int) -> np.ndarray:
    """Residuals of the fixed predictor; rows are frames, the first ``order`` columns are left out."""
    for _ in range(order):
        x = x[:, 1:] - x[:, :-1]
    return x


def encode(payloads: list[bytes], frame: int = FRAME, linear: tuple[tuple[int, ...], int] | None = None) -> list[bytes]:
    """A FLAC stream for each payload (bytes as 8-bit samples). linear: quantised coefficients and shift to use."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    per = -(-sizes // frame)
    owner = np.repeat(np.arange(len(payloads)), per)
    first = np.cumsum(per) - per
    number = np.arange(per.sum()) - first[owner]
    length = np.minimum(frame, sizes[owner] - number * frame)
    start = (np.cumsum(sizes) - sizes)[owner] + number * frame
    bodies: list[bytes] = [b""] * len(owner)
    for n in np.unique(length).tolist():
        alike = np.flatnonzero(length == n)
        for which in np.array_split(alike, -(-len(alike) * n // CACHED)):
            x = np.lib.stride_tricks.sliding_window_view(data, n)[start[which]].astype(np.int16 if linear is None else np.int64) - 128
            for k, b in zip(which.tolist(), _subframes(x, linear), strict=True):
                bodies[k] = b
    # headers: sync, fixed block size, size code, 8 kHz, mono, 8 bits
    heads = []
    for k, (no, n) in enumerate(zip(number.tolist(), length.tolist(), strict=True)):
        code, more = (10, b"") if n == 1024 else (7, (n - 1).to_bytes(2, "big"))
        heads.append(bytes([0xFF, 0xF8, code << 4 | 4, 0 << 4 | 1 << 1]) + utf8_number(no) + more)
    by_size: dict[int, list[int]] = {}
    for k, h in enumerate(heads):
        by_size.setdefault(len(h), []).append(k)
    for ks in by_size.values():
        for k, c in zip(ks, crc8(np.frombuffer(b"".join(heads[k] for k in ks), np.uint8).reshape(len(ks), -1)).tolist(), strict=True):
            heads[k] += bytes([c])
    frames = [h + b for h, b in zip(heads, bodies, strict=True)]
    flat = np.frombuffer(b"".join(frames), np.uint8)
    each = np.array([len(f) for f in frames], np.int64)
    sums = crc16(flat, np.cumsum(each) - each, each).astype(">u2").tobytes()
    out = []
    for i, p in enumerate(payloads):
        a, b = int(first[i]), int(first[i] + per[i])
        own = [frames[k] + sums[2 * k : 2 * k + 2] for k in range(a, b)]
        small, large = min(map(len, own), default=0), max(map(len, own), default=0)
        # signed samples are what the checksum of the stream is over
        md5 = hashlib.md5(bytes(p).translate(_SIGNED)).digest()
        rate = (RATE << 44) | (0 << 41) | (7 << 36) | len(p)
        info = frame.to_bytes(2, "big") * 2 + small.to_bytes(3, "big") + large.to_bytes(3, "big") + rate.to_bytes(8, "big") + md5
        out.append(b"fLaC" + bytes([0x80, 0, 0, 34]) + info + b"".join(own))
    return out


_SIGNED = bytes((b - 128) & 0xFF for b in range(256))


def _subframes(x: np.ndarray, linear) -> list[bytes]:
    """Subframes of frames of one length, padded to whole bytes."""
    rows, n = x.shape
    constant = (x == x[:, :1]).all(1)
    orders = range(min(3, n)) if linear is None else [len(linear[0])]
    cost, residual = [], []
    for o in orders:
        if linear is None:
            r = predicted(x, o)
        elif n > o:
            guess = sum(c * x[:, o - 1 - j : n - 1 - j] for j, c in enumerate(linear[0])) >> linear[1]
            r = x[:, o:] - guess
        else:
            r = x[:, :0]
        residual.append(r)
        cost.append(np.abs(r).sum(1, dtype=np.int64) if r.shape[1] else np.full(rows, 1 << 40))
    best = np.argmin(np.stack(cost), 0)
    out: list[bytes] = [b""] * rows
    for k in np.flatnonzero(constant).tolist():
        out[k] = bytes([0x00, int(x[k, 0]) & 0xFF])
    for pos, o in enumerate(orders):
        which = np.flatnonzero((best == pos) & ~constant)
        if not len(which):
            continue
        r = residual[pos][which]
        u = (r << 1) ^ (r >> (8 * r.itemsize - 1))
        mean = u.mean(1)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1))), 0, 14).astype(u.dtype)
        q = u >> k[:, None]
        lead = 8 + 8 * o + (0 if linear is None else 4 + 5 + linear_bits(linear) * o) + 2 + 4 + 4
        total = lead + q.sum(1, dtype=np.int64) + (1 + k.astype(np.int64)) * u.shape[1]
        verbatim = total >= 8 + 8 * n
        for j in np.flatnonzero(verbatim).tolist():
            out[which[j]] = b"\x02" + (x[which[j]] & 0xFF).astype(np.uint8).tobytes()
        use = np.flatnonzero(~verbatim)
        if not len(use):
            continue
        w, k, u, q, total = which[use], k[use].astype(np.int32)[:, None], u[use].astype(np.int32), q[use].astype(np.int32), total[use]
        kind = (8 + o) if linear is None else (32 + o - 1)
        head = [(kind << 1, 8)] + [(x[w, j].astype(np.int64) & 0xFF, 8) for j in range(o)]
        if linear is not None:
            bits = linear_bits(linear)
            head += [(bits - 1, 4), (linear[1] & 31, 5)] + [(c & ((1 << bits) - 1), bits) for c in linear[0]]
        head += [(0, 2), (0, 4), (k[:, 0], 4)]
        size = total + (-total) % 8
        ends = np.cumsum(size)
        base = ends - size
        # every code is q zeros, a one, k bits: the one and the k bits are a number of k + 1 bits with its first bit set
        q += k + 1
        code_end = np.cumsum(q, 1, dtype=np.int32)
        code_end += (base + lead).astype(np.int32)[:, None]
        units = _placed(code_end - (k + 1), k + 1, (u & ((1 << k) - 1)) | (1 << k), int(ends[-1]))
        at = base
        for v, wd in head:
            units += _placed(at, wd, np.broadcast_to(v, at.shape), int(ends[-1]))
            at = at + wd
        units = units.astype(np.int64)
        units[1:] += (units[:-1] & 0xFFFF) << 16
        raw = (units >> 16).astype(">u2").tobytes()
        for a, b, row in zip((base // 8).tolist(), (ends // 8).tolist(), w.tolist(), strict=True):
            out[row] = raw[a:b]
    return out


def _placed(at: np.ndarray, widths, values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of up to 16 bits, none over another, at bit positions: for each 16 bits, these and what reaches behind them."""
    values = values << (32 - (at & 15) - widths).astype(np.int64)
    return np.bincount((at >> 4).ravel(), values.ravel(), minlength=bits // 16 + 2)


def linear_bits(linear) -> int:
    return max(2, max(int(c if c >= 0 else -c - 1).bit_length() for c in linear[0]) + 1)


class _Streams:
    """Bits of concatenated streams, read at many places at once."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw  # with 16 bytes of nothing behind
        self.one = self.zero = self.word = None

    def number(self, at: np.ndarray, bits) -> np.ndarray:
        """Unsigned numbers of up to 32 bits at the given bit positions."""
        byte = at >> 3
        v = np.zeros(len(at), np.uint64)
        for j in range(6):
            v = (v << np.uint64(8)) | self.raw[byte + j].astype(np.uint64)
        return ((v >> (48 - (at & 7) - bits).astype(np.uint64)) & ((np.uint64(1) << np.asarray(bits, np.uint64)) - np.uint64(1))).astype(np.int64)

    def signed(self, at: np.ndarray, bits) -> np.ndarray:
        v = self.number(at, bits)
        return np.where(v >> (bits - 1) & 1, v - (np.int64(1) << bits), v)

    def ones(self) -> np.ndarray:
        """For each bit position, the position of the next set bit from there on."""
        if self.one is None:
            b = np.unpackbits(self.raw)
            n = len(b)
            at = np.where(b == 1, np.arange(n, dtype=np.int32), np.int32(n - 1))
            self.one = np.minimum.accumulate(at[::-1])[::-1]
        return self.one

    def zeros(self) -> np.ndarray:
        """For each bit position, how many zeros stand from there to the next set bit; FAR or more: at least FAR."""
        if self.zero is None:
            own = self.raw.astype(np.intp)
            ahead = ZEROS[:, 0].astype(np.uint64)[own]  # from the start of each byte, beyond it for bytes without a set bit
            none = np.flatnonzero(self.raw[:-1] == 0)
            some = np.append(np.flatnonzero(self.raw[:-1]), len(own) - 1)  # runs end with the last byte
            next_ = some[np.searchsorted(some, none)]
            ahead[none] = np.minimum((next_ - none) * 8 + ZEROS[own[next_], 0], FAR)
            ahead *= np.uint64(0x0101010101010101)
            lanes = BEYOND.view(np.uint64).ravel()[own]
            lanes[:-1] &= ahead[1:]
            lanes[-1] = 0
            lanes += ZEROS.view(np.uint64).ravel()[own]
            self.zero = lanes.view(np.uint8)
        return self.zero

    def words(self) -> np.ndarray:
        """For each byte but the last three, the number of 32 bits that begins there."""
        if self.word is None:
            b = self.raw.astype(np.uint32)
            self.word = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        return self.word


#: Zeros before the first set bit of each byte from each bit on (all that are left, if none is set), and where none is.
FAR = 240
_byte_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
BEYOND = np.stack([np.where(_byte_bits[:, s:].any(1), 0, 255) for s in range(8)], 1).astype(np.uint8)
ZEROS = np.stack([np.where(BEYOND[:, s] == 0, _byte_bits[:, s:].argmax(1), 8 - s) for s in range(8)], 1).astype(np.uint8)


def _frames_of(media: bytes, base: int) -> tuple[dict, list[tuple[int, int, int, int]]]:
    """Stream info, and where frames may start: all are found by walking, so only the first is known here."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info = 4, None
    while True:
        last, kind, size = media[at] >> 7, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        if kind == 0:
            b = media[at + 4 : at + 4 + size]
            packed = int.from_bytes(b[10:18], "big")
            info = {"channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": b[18:34], "block": int.from_bytes(b[:2], "big"), "variable": b[:2] != b[2:4]}
        at += 4 + size
        if last:
            break
    if info is None:
        raise ValueError("no stream info")
    return info, base + at


_SIZES = {1: 192, **{c: 576 << (c - 2) for c in (2, 3, 4, 5)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_DEPTH = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


def decode(media: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """For each stream, its PCM blocks: (offset of the first sample, samples; a column a channel if there are several).

    Frames are found by their sync codes: a place whose header checksum is right starts a frame if the frame checksum
    of what stands between it and the next such place is right too. The frames of all streams are then decoded in
    groups. A stream where that fails (samples that look like a header) is walked from frame to frame.
    """
    base = np.cumsum([0] + [len(m) for m in media])
    infos, first = [], np.zeros(len(media), np.int64)
    for i, m in enumerate(media):
        info, first[i] = _frames_of(m, int(base[i]))
        infos.append(info)
    raw = np.frombuffer(b"".join(media) + b"\0" * 16, np.uint8)
    depth = np.array([x["bits"] for x in infos], np.int64)
    want = np.array([x["samples"] for x in infos], np.int64)
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in media]
    starts, ends, owner = _found(raw, first, base, depth)
    done = np.zeros(len(media), np.int64)
    for a, z in _groups(ends - starts):
        low = int(starts[a])
        bits = _Streams(np.concatenate([raw[low : int(ends[z - 1])], np.zeros(18, np.uint8)]))
        body, length, own, code, _ = _parsed(bits.raw, starts[a:z] - low, depth[owner[a:z]])
        stop, samples = _channels(bits, body * 8, length, own, code)
        if ((stop + 7) // 8 + low != ends[a:z]).any():
            raise ValueError("a frame does not end where the next one starts")
        for k, i in enumerate(owner[a:z].tolist()):
            out[i].append((int(done[i]), samples[k]))
            done[i] += len(samples[k])
    whole = np.zeros(len(media), bool)
    whole[owner] = True
    rest = np.flatnonzero(~whole & (first < base[1:]))
    if len(rest):
        _walk(_Streams(raw), out, rest, first, base, depth)
    done = np.array([sum(len(x) for _, x in blocks) for blocks in out], np.int64)
    if ((want > 0) & (want != done)).any():
        raise ValueError("samples are missing")
    for info, blocks in zip(infos, out, strict=True):
        if any(info["md5"]) and _md5(blocks, info["bits"]) != info["md5"]:
            raise ValueError("the stream's checksum is wrong")
    return out


def _md5(blocks: list[tuple[int, np.ndarray]], bits: int) -> bytes:
    """MD5 of signed little-endian samples, channels interleaved, in whole bytes: what a stream's header names."""
    width, sum_ = (bits + 7) // 8, hashlib.md5()
    for _, x in blocks:
        sum_.update(x.astype(np.int8).tobytes() if width == 1 else x.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :width].tobytes())
    return sum_.digest()


def _found(raw: np.ndarray, first: np.ndarray, base: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (of what the checksum covers) and streams of frames, for streams all of whose frames are sure."""
    at = np.flatnonzero((raw[:-16] == 0xFF) & (raw[1:-15] & 0xFC == 0xF8))
    owner = np.searchsorted(base, at, side="right") - 1
    fine = at >= first[owner]
    at, owner = at[fine], owner[fine]
    fine = _parsed(raw, at, depth[owner])[4]
    at, owner = at[fine], owner[fine]
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    last = np.append(owner[1:] != owner[:-1], True)
    ends = np.where(last, base[owner + 1], np.append(at[1:], 0)) - 2
    good = ends > at
    given = raw[ends].astype(np.int64) << 8 | raw[ends + 1]
    good[good] = crc16(raw, at[good], (ends - at)[good]) == given[good]
    bad = np.zeros(len(first), bool)
    bad[owner[~good]] = True
    head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    bad[owner[head][at[head] != first[owner[head]]]] = True
    sure = ~bad[owner]
    return at[sure], ends[sure], owner[sure]


def _walk(bits: _Streams, out: list, live: np.ndarray, first: np.ndarray, base: np.ndarray, depth: np.ndarray) -> None:
    """Decodes streams frame by frame, all of them in step, each frame's end giving the next one's start."""
    at, done = first.copy(), np.zeros(len(first), np.int64)
    while len(live):
        start = at[live]
        body, length, own, code, fine = _parsed(bits.raw, start, depth[live])
        if not fine.all():
            raise ValueError("frame sync is lost or a header's checksum is wrong")
        ends, samples = _channels(bits, body * 8, length, own, code)
        ends = (ends + 7) // 8
        given = bits.raw[ends].astype(np.int64) << 8 | bits.raw[ends + 1]
        if (crc16(bits.raw, start, ends - start) != given).any():
            raise ValueError("a frame's checksum is wrong")
        for k, i in enumerate(live.tolist()):
            out[i].append((int(done[i]), samples[k]))
        done[live] += length
        at[live] = ends + 2
        live = live[at[live] < base[1:][live]]


#: Channel assignments of stereo differences, and the channel that is the side and has one bit more.
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10
_SIDE = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}


def _channels(bits: _Streams, at: np.ndarray, length: np.ndarray, depth: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ends (bits) and samples of frames whose subframes start at these bits; channel c of all frames together."""
    count = np.where(code < 8, code + 1, 2)
    at = at.copy()
    parts: list[list[np.ndarray]] = [[] for _ in at]
    for c in range(int(count.max())):
        w = np.flatnonzero(count > c)
        side = np.array([_SIDE.get(int(x)) == c for x in code[w]], np.int64)
        at[w], got = _decode_subframes(bits, at[w], length[w], depth[w] + side)
        for k, s in zip(w.tolist(), got, strict=True):
            parts[k].append(s)
    out = []
    for x, own in zip(code.tolist(), parts, strict=True):
        if len(own) == 1:
            out.append(own[0])
            continue
        if x == LEFT_SIDE:
            own = [own[0], own[0] - own[1]]
        elif x == SIDE_RIGHT:
            own = [own[0] + own[1], own[1]]
        elif x == MID_SIDE:
            mid = own[0] * 2 + (own[1] & 1)
            own = [(mid + own[1]) >> 1, (mid - own[1]) >> 1]
        out.append(np.stack(own, 1))
    return at, out


def _parsed(raw: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the first subframe starts (byte), block size, bits a sample, channel code, and whether a header is right."""
    size_code, rate_code, code = raw[at + 2] >> 4, raw[at + 2] & 15, (raw[at + 3] >> 4).astype(np.int64)
    fine = (raw[at] == 0xFF) & (raw[at + 1] & 0xFC == 0xF8) & (size_code > 0) & (rate_code < 15) & (code <= MID_SIDE) & (raw[at + 3] & 1 == 0)
    depth_code = (raw[at + 3] >> 1) & 7
    own = depth.copy()
    for c, b in _DEPTH.items():
        own[depth_code == c] = b
    lead = raw[at + 4].astype(np.int64)
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    p = at + 5 + extra
    length = np.zeros(len(at), np.int64)
    for c, n in _SIZES.items():
        length[size_code == c] = n
    length = np.where(size_code == 6, raw[p].astype(np.int64) + 1, length)
    length = np.where(size_code == 7, (raw[p].astype(np.int64) << 8 | raw[p + 1]) + 1, length)
    p = p + np.select([size_code == 6, size_code == 7], [1, 2], 0) + np.select([rate_code == 12, rate_code == 13, rate_code == 14], [1, 2, 2], 0)
    size = p - at
    for n in np.unique(size).tolist():
        w = np.flatnonzero(size == n)
        fine[w] &= crc8(raw[at[w][:, None] + np.arange(n)[None, :]]) == raw[p[w]]
    return p + 1, length, own, code, fine


def _decode_subframes(bits: _Streams, at: np.ndarray, length: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ends (bits) and samples of the subframes at these bits."""
    head = bits.number(at, 8 + 0 * at)
    at = at + 8
    kind, wasted = head >> 1 & 63, np.zeros(len(at), np.int64)
    for k in np.flatnonzero(head & 1).tolist():
        wasted[k] = int(bits.ones()[at[k]]) - at[k] + 1
        at[k] += wasted[k]
    depth = depth - wasted
    samples: list[np.ndarray] = [np.zeros(0, np.int64)] * len(at)
    w = np.flatnonzero(kind == 0)
    for k, v in zip(w.tolist(), bits.signed(at[w], depth[w]).tolist(), strict=True):
        samples[k] = np.full(length[k], v, np.int64)
    at[w] += depth[w]
    w = np.flatnonzero(kind == 1)
    for k in w.tolist():
        n, d = int(length[k]), int(depth[k])
        if d == 8 and at[k] % 8 == 0:
            samples[k] = bits.raw[at[k] // 8 : at[k] // 8 + n].view(np.int8).astype(np.int64)
            at[k] += n * d
            continue
        samples[k] = bits.signed(at[k] + d * np.arange(n), np.full(n, d))
        at[k] += n * d
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | lpc | (kind <= 1)).all():
        raise ValueError("a reserved subframe type")
    w = np.flatnonzero(fixed | lpc)
    if len(w):
        order = np.where(fixed, kind - 8, kind - 31)[w]
        ends, got = _predicted_subframes(bits, at[w], length[w], depth[w], order, lpc[w])
        at[w] = ends
        for k, s in zip(w.tolist(), got, strict=True):
            samples[k] = s
    for k in np.flatnonzero(wasted).tolist():
        samples[k] = samples[k] << wasted[k]
    return at, samples


def _predicted_subframes(bits, at, length, depth, order, lpc):
    rows, widest = len(at), int(length.max())
    narrow = not lpc.any() and int(depth.max()) <= 16
    x = np.zeros((rows, widest), np.int32 if narrow else np.int64)
    at = at.copy()
    for j in range(int(order.max(initial=0))):
        w = np.flatnonzero(order > j)
        x[w, j] = bits.signed(at[w], depth[w])
        at[w] += depth[w]
    coef, shift = np.zeros((rows, 32), np.int64), np.zeros(rows, np.int64)
    w = np.flatnonzero(lpc)
    if len(w):
        precision = bits.number(at[w], 4 + 0 * w) + 1
        shift[w] = bits.signed(at[w] + 4, 5 + 0 * w)
        at[w] += 9
        for j in range(int(order[w].max())):
            v = np.flatnonzero(order[w] > j)
            coef[w[v], j] = bits.signed(at[w[v]], precision[v])
            at[w[v]] += precision[v]
    for o in range(1, 5):
        coef[~lpc & (order == o), :o] = FIXED[o]
    # residuals: partitions one after another, all frames in step
    method, parts_log = bits.number(at, 2 + 0 * at), bits.number(at + 2, 4 + 0 * at)
    if (method > 1).any():
        raise ValueError("a reserved residual coding")
    at += 6
    field = 4 + method
    parts = 1 << parts_log
    for part in range(int(parts.max())):
        w = np.flatnonzero(parts > part)
        k = bits.number(at[w], field[w])
        at[w] += field[w]
        each = length[w] >> parts_log[w]
        first = np.where(part == 0, order[w], part * each)
        count = (part + 1) * each - first
        escape = k == (1 << field[w]) - 1
        for j in np.flatnonzero(escape).tolist():
            i, n = w[j], int(count[j])
            width = int(bits.number(at[i : i + 1], np.array([5]))[0])
            at[i] += 5
            if width:
                x[i, first[j] : first[j] + n] = bits.signed(at[i] + width * np.arange(n), np.full(n, width))
            at[i] += n * width
        j = np.flatnonzero(~escape & (count > 0))
        if len(j):
            at[w[j]] = _rice(bits, x, w[j], at[w[j]], k[j], first[j], count[j])
    # restore
    plain = int(order.max(initial=0)) == 0
    if not plain:
        for o in np.unique(order[~lpc]).tolist():
            w = np.flatnonzero(~lpc & (order == o))
            if o == 0 or not len(w):
                continue
            for some in np.array_split(w, -(-len(w) * widest // CACHED)):
                y = x[some]
                warm = y[:, :o].copy()
                # undo the differences one order at a time, each from its own first value
                r = y[:, o:]
                for level in range(o if r.shape[1] else 0, 0, -1):
                    seed = warm[:, o - level :]  # the last warm-up samples give the difference just before
                    for _ in range(level - 1):
                        seed = seed[:, 1:] - seed[:, :-1]
                    r[:, 0] += seed[:, -1]
                    np.cumsum(r, 1, dtype=r.dtype, out=r)
                x[some] = y
        w = np.flatnonzero(lpc)
        if len(w):
            most = int(order[w].max())
            for t in range(1, int(length[w].max())):
                v = w[(order[w] <= t) & (length[w] > t)]
                if len(v):
                    back = np.arange(min(most, t))
                    guess = (coef[v][:, back] * x[v][:, t - 1 - back]).sum(1)
                    x[v, t] += guess >> shift[v]
    return at, [x[i, : length[i]] for i in range(rows)]


def _rice(bits, x, rows, at, k, first, count) -> np.ndarray:
    """Reads ``count`` codes for each row into x; returns where they end."""
    order = np.lexsort((first, -count))
    rows, at, k, first, count = rows[order], at[order].astype(np.int64), k[order], first[order], count[order]
    most = int(count[0])
    near = bits.zeros()
    # runs of FAR zeros and more are rare: where there are any, positions of the next set bit tell their lengths
    exact = bits.ones() if int(near.max()) >= FAR else None
    q = np.zeros((most, len(rows)), np.uint8 if exact is None else np.int32)
    k1 = k + 1
    pos = at.copy()
    live = np.searchsorted(-count, -np.arange(most), side="left")  # rows that still have a code at each step
    for step in range(most):
        n = live[step]
        p = pos[:n]
        z = near[p] if exact is None else exact[p] - p
        q[step, :n] = z
        p += z
        p += k1[:n]
    # numbers of rows with as many codes, some rows at a time
    edges = np.flatnonzero(np.append(True, (count[1:] != count[:-1]) | (first[1:] != first[:-1])))
    large = int(k.max()) > 16
    for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(rows)], strict=True):
        c, f = int(count[a]), int(first[a])
        for b in range(a, z, max(1, CACHED // c)):
            own = slice(b, min(z, b + max(1, CACHED // c)))
            low_bits = k[own, None]
            runs = np.ascontiguousarray(q[:c, own].T).astype(np.int32 if exact is None and not large else np.int64)
            ends = np.cumsum(runs + k1[own, None], 1)
            ends += at[own, None] - low_bits  # where the low bits begin
            if large:
                low = bits.number(ends.ravel(), np.broadcast_to(low_bits, ends.shape).ravel()).reshape(ends.shape)
            else:
                low = bits.words()[ends >> 3] << (ends & 7).astype(np.uint32) >> np.uint32(1) >> (31 - low_bits).astype(np.uint32)
            u = runs << low_bits.astype(runs.dtype) | low.astype(runs.dtype)
            x[rows[own], f : f + c] = (u >> 1) ^ -(u & 1)
    out = np.empty_like(pos)
    out[order] = pos
    return out


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved PCM: up to 8 bits as unsigned bytes, more as signed little-endian in as many bytes as they need."""
    if bits <= 8:
        return (samples + (1 << (bits - 1))).astype(np.uint8).tobytes()
    width = (bits + 7) // 8
    return samples.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()


def blocks_of(media: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks of streams, with the offsets of their first samples."""
    depths = [_frames_of(m, 0)[0]["bits"] for m in media]
    return [[(o, pcm(s, d)) for o, s in blocks] for d, blocks in zip(depths, decode(media), strict=True)]


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (PAD - len(raw) % PAD if len(raw) % PAD or not raw else 0)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a FLAC stream of 8-bit samples."""
    prepare(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for b in by_bytes(whole):
                if not b.num_rows:
                    continue
                texts = b.column("text").to_pylist()
                payloads = [payload_of(t) for t in texts]
                media: list[bytes] = []
                for a, z in _groups(list(map(len, payloads))):
                    media += encode(payloads[a:z])
                sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256 (of the stream as it was read), blocks: array of (sample_offset, pcm).

    Each frame is verified by its checksums, and each stream by its own.
    """
    prepare(media.sparkSession)

    def run(batches):
        for whole in batches:
            for b in by_bytes(whole):
                if not b.num_rows:
                    continue
                streams = b.column("media").to_pylist()
                blocks: list[list[tuple[int, bytes]]] = []
                for a, z in _groups(list(map(len, streams))):
                    blocks += blocks_of(streams[a:z])
                cuts = np.cumsum([0] + [len(x) for x in blocks]).astype(np.int32)
                flat = [p for x in blocks for p in x]
                structs = pa.StructArray.from_arrays([pa.array([o for o, _ in flat], pa.int64()), pa.array([p for _, p in flat], pa.binary())], names=["sample_offset", "pcm"])
                about = [pa.array(list(map(len, streams)), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in streams], pa.string())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *about, pa.ListArray.from_arrays(pa.array(cuts), structs)], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    schema = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset: bigint, pcm: binary>>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def write_pcm(blocks: DataFrame, path: str) -> DataFrame:
    """Writes one row a block: doc_id, sample_offset, n_samples, pcm, sorted by both within files, so that a reader
    that asks for a sample range skips row groups by their minima and maxima and decodes nothing."""
    rows = blocks.select("doc_id", F.inline("blocks")).withColumn("n_samples", F.length("pcm"))
    rows = rows.select("doc_id", "sample_offset", "n_samples", "pcm").sortWithinPartitions("doc_id", "sample_offset")
    rows.write.mode("overwrite").parquet(path)
    return blocks.sparkSession.read.schema(rows.schema).parquet(path)


def samples_between(written: DataFrame, doc_id: int, first: int, last: int) -> DataFrame:
    """Blocks of a document that hold samples first to last (inclusive)."""
    return written.where((F.col("doc_id") == doc_id) & (F.col("sample_offset") <= last) & (F.col("sample_offset") + F.col("n_samples") > first))


def feature_of(payload: bytes) -> str:
    """Level, crossings, lag-1 correlation and peak of the samples, as fixed-point text; summed piece by piece."""
    raw = np.frombuffer(payload, np.uint8)
    level = crossings = lag = peak = 0
    for at in range(0, len(raw), TOGETHER):
        x = raw[at : at + TOGETHER + 1].astype(np.int64) - 128  # one more sample: pairs over the cut count once
        own = x[:TOGETHER]
        level += int((own * own).sum())
        crossings += int(((x[1:] < 0) != (x[:-1] < 0)).sum())
        lag += int((x[1:] * x[:-1]).sum())
        peak = max(peak, int(np.abs(own).max()))
    return f"level={level // len(raw)};crossings={crossings};lag1={lag // max(1, len(raw) - 1)};peak={peak}"


def described(blocks: DataFrame) -> DataFrame:
    """Digests and features of PCM blocks that were read; nothing of a payload leaves the stage."""

    def run(batches):
        for whole in batches:
            for b in by_bytes(whole):
                if not b.num_rows:
                    continue
                rows = []
                for parts in b.column("blocks").to_pylist():
                    payload = b"".join(p["pcm"] for p in parts)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), f"{feature_of(payload)};blocks={len(parts)}"))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("n_bytes"), b.column("media_bytes"), b.column("media_sha256"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"],
                )

    out = blocks.mapInArrow(run, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Stores every text as FLAC, reads the streams, writes their PCM blocks, and describes the blocks that it reads.

    The table goes through in rounds by a hash of the rows, and a round's media are deleted when its blocks stand.
    """
    scratch = Scratch(docs.sparkSession, "flac")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    turn = F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(rounds))
    out = None
    for k in range(rounds):
        media = scratch.write(stored(docs.where(turn == k)), f"media{k}")
        blocks = scratch.write(pcm_blocks(media), f"pcm{k}")
        scratch.drop(media)
        out = blocks if out is None else out.unionByName(blocks)
    done = scratch.write(described(out), "described")
    return done


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return media_features(docs)
