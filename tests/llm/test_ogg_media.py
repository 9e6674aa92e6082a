"""Ogg files: round trips, checksums against a bit-by-bit computation, damage."""

import random

import pytest

pytest.importorskip("plainspoke.llm")
from plainspoke.llm import ogg_media as O  # noqa: E402


def slow_crc(page: bytes) -> int:
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(1)
    for n in (1, 26, 27, 300):
        page = rng.randbytes(n)
        assert O.checksum(page) == slow_crc(page)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 3071, 3072, 3073, 6144, 9216, 100_000])
def test_round_trip(n):
    text = "".join(random.Random(n).choice("abé \n字") for _ in range(n))
    payload = O.payload_of(text)
    assert len(payload) % 192 == 0 and payload and payload.rstrip(b" ") == text.encode().rstrip(b" ")
    got = O.read(O.store(payload))
    assert got.payload == payload
    assert len(got.streams) == 2 and sum(s[2] for s in got.streams) == len(payload)
    assert got.times[-1] > 0 and O.store(payload) == O.store(payload)


def test_damage_is_found():
    media = O.store(O.payload_of("some words " * 3000))
    rng = random.Random(3)
    for _ in range(200):
        at = rng.randrange(len(media))
        hurt = media[:at] + bytes([media[at] ^ (1 << rng.randrange(8))]) + media[at + 1 :]
        with pytest.raises(O.BadMedia):
            O.read(hurt)
    for cut in (0, 10, 100, len(media) // 2, len(media) - 1):
        with pytest.raises(O.BadMedia):
            O.read(media[:cut])
    first = media.index(b"OggS", 4)
    second = media.index(b"OggS", first + 4)
    third = media.index(b"OggS", second + 4)
    with pytest.raises(O.BadMedia):  # a whole page is missing
        O.read(media[:second] + media[third:])
