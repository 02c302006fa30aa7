"""The coefficient decoder against an encoder written here, and the comb of a second quantisation."""

import random

import numpy as np
import pytest

from attestry.sources import coefficients as K


def segment(kind, data):
    return bytes([0xFF, kind]) + (len(data) + 2).to_bytes(2, "big") + data


def encode(width, height, sampling, blocks, restart=0, kind=0xC0, precision=8):
    """A JPEG of blocks[component][row, column] (zigzag order); all symbols have codes of 9 bits."""
    symbols = [r << 4 | s for r in range(16) for s in range(12)]
    dht = b"".join(bytes([c << 4]) + bytes([0] * 8 + [len(symbols)] + [0] * 7) + bytes(symbols) for c in (0, 1))
    code = {s: format(i, "09b") for i, s in enumerate(symbols)}
    number = lambda v: "" if not v else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
    most = [max(s[i] for s in sampling) for i in (0, 1)]
    wide, high = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
    runs, text, last, unit = [], "", [0] * len(blocks), 0
    for y in range(high):
        for x in range(wide):
            if restart and unit and unit % restart == 0:
                runs, text, last = [*runs, text], "", [0] * len(blocks)
            unit += 1
            for n, (h, v) in enumerate(sampling):
                for j in range(v):
                    for i in range(h):
                        own = [int(z) for z in blocks[n][y * v + j, x * h + i]]
                        d, last[n] = own[0] - last[n], own[0]
                        text += code[abs(d).bit_length()] + number(d)
                        zeros = 0
                        for z in own[1 : 1 + max([k for k in range(1, 64) if own[k]], default=0)]:
                            if not z:
                                zeros += 1
                                continue
                            text += code[0xF0] * (zeros // 16) + code[(zeros % 16) << 4 | abs(z).bit_length()] + number(z)
                            zeros = 0
                        if not own[63]:
                            text += code[0]
    pack = lambda t: int(t.ljust(-(-len(t) // 8) * 8, "1") or "0", 2).to_bytes(max(1, -(-len(t) // 8)), "big").replace(b"\xff", b"\xff\0")
    data = b"".join(pack(t) + bytes([0xFF, 0xD0 + i % 8]) for i, t in enumerate(runs)) + pack(text)
    frame = bytes([precision]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(blocks)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    scan = bytes([len(blocks)]) + b"".join(bytes([i + 1, 0]) for i in range(len(blocks))) + b"\0\x3f\0"
    return b"\xff\xd8" + segment(0xDB, b"\0" + bytes([1] * 64)) + segment(kind, frame) + segment(0xC4, dht) + (segment(0xDD, restart.to_bytes(2, "big")) if restart else b"") + segment(0xDA, scan) + data + b"\xff\xd9"


@pytest.mark.parametrize("sampling,restart", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1)], 2)])
def test_round_trip(sampling, restart):
    r = np.random.default_rng(1)
    width, height = 45, 37
    most = [max(s[i] for s in sampling) for i in (0, 1)]
    wide, high = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
    blocks = [np.where(r.random((high * v, wide * h, 64)) < 0.2, r.integers(-900, 900, (high * v, wide * h, 64)), 0) for h, v in sampling]
    got = K.decode(encode(width, height, sampling, blocks, restart))
    for (h, v), own, want in zip(sampling, got, blocks):
        across, down = -(-(-(-width * h // most[0])) // 8), -(-(-(-height * v // most[1])) // 8)
        assert (own == want[:down, :across].reshape(-1, 64)).all()


def test_broken_files():
    whole = encode(40, 40, [(1, 1)], [np.ones((5, 5, 64), int)])
    for bad in (b"", whole[:10], encode(8, 8, [(1, 1)], [np.zeros((1, 1, 64), int)], kind=0xC2), encode(8, 8, [(1, 1)], [np.zeros((1, 1, 64), int)], precision=12)):
        with pytest.raises(ValueError):
            K.decode(bad)
    cut = K.decode(whole[:-60])[0]
    assert (cut[0] == 1).all() and not (cut[-1] == 1).all()
    r = random.Random(2)
    for _ in range(200):
        b = bytearray(whole[: r.randrange(len(whole) + 1)])
        for _ in range(r.randint(0, 4)):
            if b:
                b[r.randrange(len(b))] = r.randrange(256)
        try:
            K.decode(bytes(b))
        except ValueError:
            pass


def test_comb_of_a_second_quantisation():
    r = np.random.default_rng(3)
    raw = np.round(r.laplace(0, 60, (20_000, 64)))
    once = np.round(raw / 5).astype(int)
    twice = np.round(np.round(raw / 12) * 12 / 5).astype(int)
    assert K.comb(once)[0] < K.THRESHOLD <= K.comb(twice)[0] and K.comb(once[:10])[0] == 0.0
