import random

import pytest

from gleanery.functions import varint

SIZES = [(0, 1), (1, 1), (127, 1), (128, 2), (16383, 2), (16384, 3), (2097151, 3), (2097152, 4), (268435455, 4), (268435456, 5), (4294967295, 5)]


@pytest.mark.parametrize("value,size", SIZES)
def test_each(value, size):
    assert len(varint.encode([value])) == size and varint.decode(varint.encode([value])) == [value]


def test_stream():
    rnd = random.Random(1)
    values = [v for v, _ in SIZES] + [rnd.randrange(1 << rnd.randrange(1, 33)) for _ in range(5000)]
    assert varint.decode(varint.encode(values)) == values
    assert varint.encode([]) == b"" and varint.decode(b"") == []


def test_low_bits_first():
    assert varint.encode([300]) == bytes([0b10101100, 0b00000010])


@pytest.mark.parametrize("raw", [b"\x80", b"\x01\xff", b"\x80" * 6 + b"\x01"])
def test_broken(raw):
    with pytest.raises(ValueError):
        varint.decode(raw)
    with pytest.raises(ValueError):
        varint.encode([1 << 32])


def test_postings():
    assert varint.unpack_postings(varint.pack_postings([9, 3, 500], [2, 1, 7])) == [(3, 1), (9, 2), (500, 7)]
