"""Ed25519 (RFC 8032) over canonical JSON, for tasks that sign and verify many rows.

Points are in extended coordinates; the arithmetic is on Python's integers, without effort to hide timing: sign where nobody can measure it.
"""

from __future__ import annotations

import functools
import hashlib
import json
from typing import Any

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)

Point = tuple[int, int, int, int]
ZERO: Point = (0, 1, 1, 0)


def _add(a: Point, b: Point) -> Point:
    e, f = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    c, d = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    w, x, y, z = f - e, d - c, d + c, f + e
    return w * x % P, y * z % P, x * y % P, w * z % P


def _times(n: int, point: Point) -> Point:
    total = ZERO
    while n:
        if n & 1:
            total = _add(total, point)
        point = _add(point, point)
        n >>= 1
    return total


def _unpacked(data: bytes) -> Point | None:
    """The point of 32 bytes; None if they are of none."""
    if len(data) != 32:
        return None
    y = int.from_bytes(data, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or not x and sign:
        return None
    x = P - x if x & 1 != sign else x
    return x, y, 1, x * y % P


def _packed(point: Point) -> bytes:
    z = pow(point[2], -1, P)
    x, y = point[0] * z % P, point[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


BASE = _unpacked((4 * pow(5, -1, P) % P).to_bytes(32, "little"))
#: For each digit of a number, a point's multiples by the digit's values, as y - x, y + x, 2 z, 2 d t.
Table = list[list[tuple[int, int, int, int]]]


def _table(point: Point, bits: int) -> Table:
    rows = []
    for _ in range(0, 256, bits):
        row, now = [], ZERO
        for _ in range(1 << bits):
            x, y, z, t = now
            row.append(((y - x) % P, (y + x) % P, 2 * z % P, 2 * D * t % P))
            now = _add(now, point)
        rows.append(row)
        point = now
    return rows


def _times_table(n: int, table: Table, bits: int) -> Point:
    """``_times`` of the table's point: one addition a digit."""
    x, y, z, t = ZERO
    last = (1 << bits) - 1
    for row in table:
        minus, plus, z2, dt = row[n & last]
        n >>= bits
        a, b, c, d = (y - x) * minus % P, (y + x) * plus % P, t * dt % P, z * z2 % P
        e, f, g, h = b - a, d - c, d + c, b + a
        x, y, z, t = e * f % P, g * h % P, f * g % P, e * h % P
    return x, y, z, t


@functools.cache
def _base_table() -> Table:
    return _table(BASE, 8)


def _times_base(n: int) -> Point:
    """``_times`` of the base."""
    return _times_table(n, _base_table(), 8)


_unpacked_key = functools.lru_cache(256)(_unpacked)
_KEYS: dict[bytes, Table | None] = {}


def _times_key(n: int, key: bytes, point: Point) -> Point:
    """``_times`` of a key's point; a key that comes again gets a table, 256 keys at most."""
    if key not in _KEYS:
        if len(_KEYS) >= 256:
            _KEYS.clear()
        _KEYS[key] = None
        return _times(n, point)
    table = _KEYS[key]
    if table is None:
        table = _KEYS[key] = _table(point, 4)
    return _times_table(n, table, 4)


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _expanded(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


@functools.lru_cache(256)
def public_key(seed: bytes) -> bytes:
    """The public key of a private one (32 bytes)."""
    return _packed(_times_base(_expanded(seed)[0]))


def sign(seed: bytes, message: bytes) -> bytes:
    scalar, prefix = _expanded(seed)
    nonce = _digest(prefix, message) % ORDER
    r = _packed(_times_base(nonce))
    s = (nonce + _digest(r, public_key(seed), message) * scalar) % ORDER
    return r + s.to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    a, s = _unpacked_key(key), int.from_bytes(signature[32:], "little")
    if a is None or len(signature) != 64 or s >= ORDER:
        return False
    x, y, z, t = _times_key(_digest(signature[:32], key, message) % ORDER, key, a)
    # What is no point's encoding is not that of this one either.
    return _packed(_add(_times_base(s), (P - x, y, z, P - t))) == signature[:32]


def canonical_bytes(value: Any) -> bytes:
    """JSON with sorted keys and no blanks; an error for what JSON cannot hold."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode("utf-8")
