"""MATLAB files of levels 4 and 5 (compressed ones too) as plain Python values: parameters and small arrays, read on the driver.

Numbers come as NumPy arrays, texts as str, structures as dicts (of lists where they are arrays), cells as lists; logical values as bool arrays. Files of
level 7.3 are HDF5, for which there is no library here, and are refused by name.
"""

from __future__ import annotations

import struct
import zlib
from pathlib import Path
from typing import Any

import numpy as np

#: Sample types of level 5 by number, of level 4 by digit.
TYPES5 = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
TYPES4 = {0: "f8", 1: "f4", 2: "i4", 3: "i2", 4: "u2", 5: "u1"}
MATRIX, COMPRESSED, UTF8 = 14, 15, 16
CELL, STRUCT, OBJECT, CHAR, SPARSE = 1, 2, 3, 4, 5


class _Level5:
    def __init__(self, data: bytes, order: str):
        self.data, self.order = data, order

    def elements(self, data: bytes):
        """(type, payload) of each element."""
        at = 0
        while at + 8 <= len(data):
            kind, size = struct.unpack_from(self.order + "II", data, at)
            if kind >> 16:  # a short element holds its payload in its own head
                yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
                at += 8
                continue
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == COMPRESSED else -size % 8)

    def numbers(self, kind: int, payload: bytes) -> np.ndarray:
        dtype = np.dtype(self.order + TYPES5[kind])
        return np.frombuffer(payload[: len(payload) // dtype.itemsize * dtype.itemsize], dtype)

    def top(self) -> dict[str, Any]:
        out = {}
        for kind, payload in self.elements(self.data):
            if kind == COMPRESSED:
                kind, payload = next(self.elements(zlib.decompress(payload)))
            if kind == MATRIX and payload:
                name, value = self.matrix(payload)
                out[name] = value
        return out

    def matrix(self, payload: bytes) -> tuple[str, Any]:
        parts = list(self.elements(payload))
        flags, shape = self.numbers(*parts[0]), tuple(int(n) for n in self.numbers(*parts[1]))
        name, rest = parts[2][1].decode("utf-8", "replace").rstrip("\0"), parts[3:]
        kind, complex_, logical = int(flags[0]) & 0xFF, bool(flags[0] & 0x800), bool(flags[0] & 0x200)
        count = int(np.prod(shape))
        if kind == CELL:
            return name, [self.matrix(p)[1] if p else None for _, p in rest[:count]]
        if kind in (STRUCT, OBJECT):
            rest = rest[1:] if kind == OBJECT else rest
            width, text = int(self.numbers(*rest[0])[0]), rest[1][1]
            fields = [text[k : k + width].split(b"\0")[0].decode() for k in range(0, len(text), width)]
            values = [self.matrix(p)[1] if p else None for _, p in rest[2:]]
            if count == 1:
                return name, dict(zip(fields, values))
            return name, [dict(zip(fields, values[k * len(fields) : (k + 1) * len(fields)])) for k in range(count)]
        if kind == CHAR:
            sort, raw = rest[0] if rest else (UTF8, b"")
            text = raw.decode("utf-8", "replace") if sort in (1, 2, UTF8) else "".join(map(chr, self.numbers(sort, raw)))
            if len(shape) == 2 and shape[0] > 1:
                return name, ["".join(r).rstrip() for r in np.array(list(text.ljust(count))).reshape(shape, order="F")]
            return name, text
        if kind == SPARSE:
            row, start = (self.numbers(*rest[k]).astype(int) for k in (0, 1))
            value = np.zeros(shape)
            column = np.repeat(np.arange(shape[1]), np.diff(start))
            value[row[: len(column)], column] = self.numbers(*rest[2])[: len(column)]
            return name, value
        value = self.numbers(*rest[0]) if rest else np.empty(0)
        if complex_:
            value = value + 1j * self.numbers(*rest[1])
        value = value.reshape(shape, order="F")
        return name, value.astype(bool) if logical else value


def _level4(data: bytes) -> dict[str, Any]:
    out, at = {}, 0
    while at + 20 <= len(data):
        order = "<" if 0 <= struct.unpack_from("<i", data, at)[0] < 5000 else ">"
        kind, rows, columns, imaginary, size = struct.unpack_from(order + "5i", data, at)
        name = data[at + 20 : at + 20 + size].rstrip(b"\0").decode("latin-1")
        at += 20 + size
        dtype = np.dtype((">" if kind // 1000 == 1 else "<") + TYPES4[kind // 10 % 10])
        n = rows * columns
        parts = [np.frombuffer(data, dtype, n, at + k * n * dtype.itemsize) for k in range(1 + bool(imaginary))]
        at += len(parts) * n * dtype.itemsize
        value = (parts[0] + 1j * parts[1] if imaginary else parts[0]).reshape((rows, columns), order="F")
        out[name] = ("".join(chr(int(c)) for c in value.ravel()) if rows == 1 else ["".join(chr(int(c)) for c in r) for r in value]) if kind % 10 == 1 else value
    return out


def read_mat(path: str | Path) -> dict[str, Any]:
    """Variables of a file by name."""
    data = Path(path).read_bytes()
    if data[:8] == b"\x89HDF\r\n\x1a\n" or b"MATLAB 7.3" in data[:128]:
        raise ValueError(f"{path}: level 7.3 (HDF5) is not read; save it as level 7 or give JSON")
    if data[126:128] in (b"IM", b"MI") and data[:4].strip(b"\0"):
        return _Level5(data[128:], "<" if data[126:128] == b"IM" else ">").top()
    return _level4(data)


def parameters(path: str | Path) -> dict[str, Any]:
    """A parameter file: scalars as numbers, vectors as lists, texts as they are; a single structure stands for its fields."""
    found = read_mat(path)
    if len(found) == 1 and isinstance(next(iter(found.values())), dict):
        found = next(iter(found.values()))

    def plain(v: Any) -> Any:
        if isinstance(v, np.ndarray):
            return v.ravel()[0].item() if v.size == 1 else v.ravel().tolist()
        return v

    return {k: plain(v) for k, v in found.items() if not k.startswith("__")}
