import hashlib
import time
import tracemalloc
import zlib

import numpy as np
import pytest

from tidemark.llm import flac


def cases():
    r = np.random.default_rng(0)
    noise = [r.integers(0, 256, 64 * n).astype(np.uint8).tobytes() for n in (1, 2, 15, 16, 17, 40, 200)]
    walks = [(np.cumsum(r.integers(-2, 3, 64 * n)) % 256).astype(np.uint8).tobytes() for n in (1, 3, 17, 50)]
    curves = [(128 + 100 * np.sin(np.arange(64 * n) / 40)).astype(np.uint8).tobytes() for n in (17, 33, 65)]
    return [bytes(64), bytes([255]) * 128, *noise, *walks, *curves]


@pytest.mark.parametrize("linear", [None, ((2, -1), 0), ((15, -9, 3), 3), ((1,), 0), ((31, -17, 5, -2, 1), 4)])
def test_round_trip(linear):
    payloads = cases()
    media = flac.encode(payloads, linear=linear)
    for blocks, p, m in zip(flac.blocks_of(media), payloads, media, strict=True):
        assert b"".join(x for _, x in blocks) == p
        assert [o for o, _ in blocks] == list(range(0, len(p), flac.FRAME))
        assert flac.encode([p], linear=linear)[0] == m


class Bits:
    """A plain bit writer, to make streams the encoder does not make."""

    def __init__(self):
        self.s = ""

    def put(self, v, n):
        self.s += format(v & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, v, k):
        u = 2 * v if v >= 0 else -2 * v - 1
        self.s += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        s = self.s + "0" * (-len(self.s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8))


def plain_crc(data, poly, width):
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (width - 1) else c << 1) & ((1 << width) - 1)
    return c


def stream(x, depth, write, number=0, code=0):
    head = bytes([0xFF, 0xF8, 7 << 4, code << 4 | {8: 1, 16: 4, 24: 6}[depth] << 1]) + flac.utf8_number(number) + (len(x) - 1).to_bytes(2, "big")
    head += bytes([plain_crc(head, 0x07, 8)])
    b = Bits()
    write(b)
    frame = head + b.bytes()
    frame += plain_crc(frame, 0x8005, 16).to_bytes(2, "big")
    packed = (8000 << 44) | ((code if code < 8 else 1) << 41) | ((depth - 1) << 36) | len(x)
    info = len(x).to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + bytes(16)
    return b"fLaC" + bytes([0, 0, 0, 34]) + info + bytes([0x84, 0, 0, 4]) + b"abcd" + frame


def test_streams_of_other_encoders():
    r = np.random.default_rng(5)
    x16 = np.cumsum(r.integers(-300, 300, 256)).clip(-32768, 32767)

    def partitions(b):  # fixed order 3, 8 partitions with their own parameters, one of them escaped
        d = np.diff(x16, 3)
        b.put(11 << 1, 8)
        for v in x16[:3]:
            b.put(int(v), 16)
        b.put(0, 2)
        b.put(3, 4)
        res = np.concatenate([[0, 0, 0], d])
        for p in range(8):
            part = res[max(3, 32 * p) : 32 * p + 32]
            if p == 4:
                b.put(15, 4)
                b.put(14, 5)
                for v in part:
                    b.put(int(v), 14)
            else:
                b.put(5 + p, 4)
                for v in part:
                    b.rice(int(v), 5 + p)

    def five_bits(b):  # fixed order 4, 5-bit parameters
        b.put(12 << 1, 8)
        for v in x16[:4]:
            b.put(int(v), 16)
        b.put(1, 2)
        b.put(0, 4)
        b.put(9, 5)
        for v in np.diff(x16, 4):
            b.rice(int(v), 9)

    even = x16 // 4 * 4

    def wasted(b):  # two wasted bits, verbatim
        b.put(1 << 1 | 1, 8)
        b.put(1, 2)
        for v in even:
            b.put(int(v) >> 2, 14)

    coef, shift = [1700, -800, 90], 10

    def linear(b):
        b.put((32 + 2) << 1, 8)
        for v in x16[:3]:
            b.put(int(v), 16)
        b.put(11, 4)
        b.put(shift, 5)
        for c in coef:
            b.put(c, 12)
        b.put(0, 2)
        b.put(0, 4)
        b.put(9, 4)
        for t in range(3, 256):
            guess = sum(c * int(x16[t - 1 - j]) for j, c in enumerate(coef)) >> shift
            b.rice(int(x16[t]) - guess, 9)

    media = [stream(x16, 16, partitions), stream(x16, 16, five_bits, 200), stream(even, 16, wasted), stream(x16, 16, linear, 70_000)]
    for got, want in zip(flac.decode(media), [x16, x16, even, x16], strict=True):
        assert len(got) == 1 and got[0][0] == 0 and (got[0][1] == want).all()


def test_long_runs_and_wide_numbers():
    """Runs of zeros longer than a byte holds, and numbers of 18 and 25 low bits, beside plain frames."""
    r = np.random.default_rng(11)
    steep = np.zeros(700, np.int64)
    steep[[3, 90, 91, 650]] = 120, -127, 127, 60
    quiet = np.zeros(300, np.int64)
    quiet[299] = 32_000
    deep = r.integers(-(1 << 23), 1 << 23, 200)

    def rice(x, depth, k, wide):
        def write(b):
            b.put(9 << 1, 8)
            b.put(int(x[0]), depth)
            b.put(1 if wide else 0, 2)
            b.put(0, 4)
            b.put(k, 5 if wide else 4)
            for v in np.diff(x):
                b.rice(int(v), k)

        return write

    data = [steep, quiet, deep, deep, deep % 128]
    media = [stream(x, d, rice(x, d, k, w)) for x, d, k, w in zip(data, (8, 16, 24, 24, 8), (0, 1, 18, 25, 3), (False, False, True, True, False), strict=True)]
    for own in (media, media[:1], media[1:2], media[2:4], media[4:]):
        want = [x for x, m in zip(data, media, strict=True) if m in own]
        assert all((got[0][1] == x).all() for got, x in zip(flac.decode(own), want, strict=True))


def test_streams_stay_as_they_were():
    """Digests of the streams that the first encoder made, and checksums by the plain way at sizes around a piece's."""
    for linear, digest in ((None, "decc86130db885d842351d35819db1cde002cddb0e83303eda03220064f1e969"), (((15, -9, 3), 3), "21ec98650943425704474deb8128ea90575d25caf2d4855b34947a92a0acbced")):
        assert hashlib.sha256(b"".join(flac.encode(cases(), linear=linear))).hexdigest() == digest
    data = np.random.default_rng(4).integers(0, 256, 1000).astype(np.uint8)
    starts, sizes = np.array([0, 0, 0, 5, 70, 3, 1, 999]), np.array([1, 63, 64, 65, 128, 129, 700, 1])
    assert flac.crc16(data, starts, sizes).tolist() == [plain_crc(data[a : a + n].tobytes(), 0x8005, 16) for a, n in zip(starts, sizes, strict=True)]


def test_coding_is_cheap():
    """CPU time against running sums over the same bytes (before: 13 times as much), and memory for each byte (before: 84 and 144)."""
    r = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, n)) for n in r.integers(2, 10, 500)]
    payloads = [flac.payload_of(" ".join(words[i] for i in r.integers(0, 500, n))) for n in r.integers(20, 900, 450)]
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    media = flac.encode(payloads)

    def sums():
        x = flat.astype(np.int64)
        for _ in range(10):
            np.cumsum(x)

    def least(fn):
        took = []
        for _ in range(4):
            began = time.process_time()
            fn()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: flac.encode(payloads)) + least(lambda: flac.blocks_of(media)) < 8 * least(sums)
    for fn, most in ((lambda: flac.encode(payloads), 20), (lambda: flac.blocks_of(media), 80)):
        tracemalloc.start()
        fn()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * len(flat), peak / len(flat)


def test_channels():
    """Three channels by themselves, and stereo by its three differences; fixed order 1 with their own parameters."""
    r = np.random.default_rng(9)
    left, right, third = (np.cumsum(r.integers(-90, 90, 100)) for _ in range(3))

    def writer(*parts):
        def write(b):
            for x, depth in parts:
                b.put(9 << 1, 8)
                b.put(int(x[0]), depth)
                b.put(0, 2)
                b.put(0, 4)
                b.put(6, 4)
                for v in np.diff(x):
                    b.rice(int(v), 6)

        return write

    side, mid = left - right, (left + right) >> 1
    media = [
        stream(left, 16, writer((left, 16), (right, 16), (third, 16)), code=2), stream(left, 16, writer((left, 16), (side, 17)), code=8),
        stream(left, 16, writer((side, 17), (right, 16)), code=9), stream(left, 16, writer((mid, 16), (side, 17)), code=10), stream(left, 16, writer((left, 16))),
    ]
    got = flac.decode(media)
    assert (got[0][0][1] == np.stack([left, right, third], 1)).all() and (got[4][0][1] == left).all()
    for blocks in got[1:4]:
        assert (blocks[0][1] == np.stack([left, right], 1)).all()
    assert flac.blocks_of(media)[1] == [(0, np.stack([left, right], 1).astype("<i2").tobytes())]
    assert flac.pcm(np.array([-3, 70_000]), 24) == b"\xfd\xff\xff" + (70_000).to_bytes(3, "little")


def test_checksums():
    good = flac.encode(cases())[8]
    for at in (44, 60, 900, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            flac.decode([bytes(bad)])
    data = np.frombuffer(good, np.uint8)
    assert flac.crc16(data, np.array([0, 10]), np.array([100, 333])).tolist() == [plain_crc(good[:100], 0x8005, 16), plain_crc(good[10:343], 0x8005, 16)]


def test_samples_that_look_like_a_frame():
    """A verbatim frame that holds a right header: the scan gives up, walking does not."""
    head = bytes([0xFF, 0xF8, 7 << 4, 1 << 1, 0, 0, 63])
    head += bytes([plain_crc(head, 0x07, 8)])
    data = head * 8
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128

    def write(b):
        b.put(1 << 1, 8)
        for v in x:
            b.put(int(v), 8)

    plain = bytes((v + 128) & 0xFF for v in x)
    shifted = np.frombuffer(bytes((v - 128) & 0xFF for v in data), np.uint8).astype(np.int64) - 128

    def raw(b):  # the bytes in the stream are the header's
        b.put(1 << 1, 8)
        for v in data:
            b.put(v, 8)

    media = [stream(x, 8, write), stream(shifted, 8, raw), flac.encode([plain])[0]]
    got = flac.decode(media)
    assert (got[0][0][1] == x).all() and len(got[1]) == 1 and [int(v) & 0xFF for v in got[1][0][1]] == list(data)


@pytest.fixture
def features_of_table(spark):
    """The operator on a small table, in one round and in several."""

    def run(df, **kw):
        return {x.doc_id: x for x in flac.media_features(df, **kw).collect()}

    return run


def test_query_columns(spark, features_of_table):
    texts = [None, "", "x" * 64, "é" * 3000, "the same", "the same"]
    df = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = features_of_table(df)
    assert got == features_of_table(df, rounds=1) and len(got) == 6
    for i, t in enumerate(texts):
        p = flac.payload_of(t)
        assert len(p) % 64 == 0 and len(p) > 0
        assert (got[i].n_bytes, got[i].payload_bytes) == (len((t or "").encode()), len(p))
        assert got[i].payload_sha256 == hashlib.sha256(p).hexdigest() and got[i].tail_crc32 == zlib.crc32(p[-64:])
        m = flac.encode([p])[0]
        assert (got[i].media_bytes, got[i].media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    assert got[4].feature == got[5].feature
    assert features_of_table(df.limit(0)) == {}


def test_a_very_long_text_needs_bounded_memory():
    """Coding and decoding go by groups of frames: a stream of 6 MB stays under what one group needs, plus itself."""
    text = " ".join(f"word {i}" for i in range(500_000))
    payload = flac.payload_of(text)
    tracemalloc.start()
    media = flac.encode([payload])[0]
    got = b"".join(p for _, p in flac.blocks_of([media])[0])
    feature = flac.feature_of(payload)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == payload and len(payload) > 5_000_000 and peak < 450e6, peak
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    assert feature.startswith(f"level={(x * x).sum() // len(x)};crossings={((x[1:] < 0) != (x[:-1] < 0)).sum()};lag1={(x[1:] * x[:-1]).sum() // (len(x) - 1)};")


def test_the_streams_own_checksum():
    good = bytearray(flac.encode([b"some bytes " * 40])[0])
    good[8 + 18] ^= 1
    with pytest.raises(ValueError, match="stream's checksum"):
        flac.decode([bytes(good)])


def test_written_blocks_are_seekable(spark, tmp_path):
    text = "".join(chr(97 + i % 26) for i in range(5000))
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    written = flac.write_pcm(flac.pcm_blocks(flac.stored(df)), str(tmp_path / "pcm"))
    got = flac.samples_between(written, 1, 1500, 2100).orderBy("sample_offset").collect()
    assert [x.sample_offset for x in got] == [1024, 2048]
    assert (b"".join(x.pcm for x in got))[1500 - 1024 : 2101 - 1024].decode() == text[1500:2101]
