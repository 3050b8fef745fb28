"""A small writer of FIT files, for fixtures: little-endian, scalar fields, one definition a set of fields."""

from __future__ import annotations

import struct

from .fit import BASE, FIT_EPOCH

ENUM, U8, S16, U16, U32, F32, U32Z, BYTE = 0x00, 0x02, 0x83, 0x84, 0x86, 0x88, 0x8C, 0x0D
U64, U64Z = 0x8F, 0x90
WIDER = {U16: U32, U32: U64, U32Z: U64Z}


def _table() -> list[int]:
    out = list(range(256))
    for _ in range(8):
        out = [crc >> 1 ^ (0xA001 if crc & 1 else 0) for crc in out]
    return out


CRC = _table()


def checksum(data: bytes) -> int:
    """The protocol's CRC-16 (polynomial 0xA001, reflected)."""
    crc = 0
    for byte in data:
        crc = crc >> 8 ^ CRC[(crc ^ byte) & 0xFF]
    return crc


def stamp(seconds: int) -> int:
    """Seconds since 1970 as the protocol counts them."""
    return seconds - FIT_EPOCH


def wide(base: int, value: int) -> tuple[int, int]:
    """A field's type and value; the type is the next wider one as long as the value does not fit, or would read as none."""
    while base in WIDER and value >= 256 ** BASE[base][0] - 1:
        base = WIDER[base]
    return base, value


def write(messages: list[tuple[int, dict[int, tuple[int, float]]]], tail: bytes = b"") -> bytes:
    """A file of messages (number, field -> (base type, value)); tail: bytes put behind the last message, inside the declared size."""
    out, kinds, used = bytearray(), {}, 0
    for number, fields in messages:
        bases, values = zip(*fields.values(), strict=True) if fields else ((), ())
        shape = (number, tuple(fields), bases)
        known = kinds.get(shape)
        if known is None:
            known = (used % 16, struct.Struct("<B" + "".join(BASE[base][1] for base in bases)))
            kinds = {s: k for s, k in kinds.items() if k[0] != known[0]} | {shape: known}  # the oldest of 16 makes room
            used += 1
            out += bytes([0x40 | known[0], 0, 0]) + struct.pack("<HB", number, len(fields))
            for f, base in zip(fields, bases, strict=True):
                out += bytes([f, BASE[base][0], base])
        out += known[1].pack(known[0], *values)
    out += tail
    head = struct.pack("<BBHI4s", 14, 0x20, 2140, len(out), b".FIT")
    head += struct.pack("<H", checksum(head))
    return head + bytes(out) + struct.pack("<H", checksum(head + bytes(out)))
