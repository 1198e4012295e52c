"""Protocol-buffer wire format in small NumPy helpers, for the binary map formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


#: Values, or bytes, up to which a field is short.
SHORT = 48


def varint(n: int) -> bytes:
    if 0 <= n < _LISTED:
        return _BYTES[n]
    return _varint(n)


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


#: Varints of small numbers, which are most keys, lengths and tags.
_LISTED = 1 << 14
_BYTES = [_varint(i) for i in range(_LISTED)]


def varints(values) -> bytes:
    """Many varints at once."""
    return varints_with_ends(values)[0]


def varints_with_ends(values) -> tuple[bytes, np.ndarray]:
    """Many varints at once, and where each ends."""
    v = np.asarray(values, np.int64).view(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        n += v >= np.uint64(1 << 7 * k)
    out = np.zeros(int(n.sum()), np.uint8)
    ends = np.cumsum(n)
    at = ends - n
    for k in range(int(n.max(initial=0))):
        has = n > k
        out[at[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(n[has] - 1 > k, 128, 0).astype(np.uint8)
    return out.tobytes(), ends


def zigzag(values) -> np.ndarray:
    v = np.asarray(values, np.int64)
    return (v << 1) ^ (v >> 63)


def unzigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def unpacked(data: bytes) -> list[int]:
    """The varints of a packed field; a ValueError if the last one is cut off."""
    if len(data) >= SHORT:
        return unpack(data).tolist()
    out, value, shift = [], 0, 0  # plain loops are faster on the short fields of one element
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(value)
            value = shift = 0
        elif shift > 63:
            raise ValueError("a number of over ten bytes")
    if shift:
        raise ValueError("a packed field ends inside a number")
    return out


def unpack(data: bytes) -> np.ndarray:
    """The varints of a packed field as uint64; a ValueError if the last one is cut off."""
    if len(data) < SHORT:  # plain loops are faster on the short fields of one element
        out, at = [], 0
        while at < len(data):
            value, end = read_varint(data, at)
            if end - at > 10:
                raise ValueError("a number of over ten bytes")
            out.append(value)
            at = end
        return np.array(out, np.uint64)
    b = np.frombuffer(data, np.uint8)
    if b[-1] > 127:
        raise ValueError("a packed field ends inside a number")
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = ends - starts + 1
    if n.max() > 10:
        raise ValueError("a number of over ten bytes")
    out = np.zeros(len(n), np.uint64)
    for k in range(int(n.max())):
        has = n > k
        out[has] |= (b[starts[has] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def block(no: int, payload: bytes) -> bytes:
    return varint(no << 3 | 2) + varint(len(payload)) + payload


def number(no: int, value: int) -> bytes:
    return varint(no << 3) + varint(value)


def packed(no: int, values) -> bytes:
    if len(values) < SHORT:
        return block(no, b"".join([varint(int(v) & (1 << 64) - 1) for v in values])) if len(values) else b""
    return block(no, varints(values))


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number is cut off")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & (1 << 64) - 1, at


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: ints for varints, bytes for the others."""
    at, end = 0, len(data)
    while at < end:
        key = data[at]
        at += 1
        if key > 127:
            key, at = read_varint(data, at - 1)
        kind = key & 7
        if kind in (0, 2):
            if at < end and data[at] < 128:
                size = data[at]
                at += 1
            else:
                size, at = read_varint(data, at)
            if kind == 0:
                yield key >> 3, size
                continue
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise ValueError(f"unknown wire type {kind}")
        if at + size > end:
            raise ValueError("a field is cut off")
        yield key >> 3, data[at : at + size]
        at += size
