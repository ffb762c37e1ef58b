"""Pixel types: ranges without the sentinel, and the promotion of operand types."""

from __future__ import annotations

#: Representable values; one end of each integer range is kept for "no data" in files.
RANGES = {f"u{n}": (0, 2**n - 2) for n in (8, 16, 32, 64)} | {f"i{n}": (1 - 2 ** (n - 1), 2 ** (n - 1) - 1) for n in (8, 16, 32, 64)}
SENTINELS = {f"u{n}": 2**n - 1 for n in (8, 16, 32, 64)} | {f"i{n}": -(2 ** (n - 1)) for n in (8, 16, 32, 64)}
NUMPY = {"i8": "<i1", "u8": "<u1", "i16": "<i2", "u16": "<u2", "i32": "<i4", "u32": "<u4", "i64": "<i8", "u64": "<u8", "f32": "<f4", "f64": "<f8"}


def result_dtype(a: str, b: str) -> str:
    """Type of a (op) b; the left operand decides between 32 and 64 bits of mixed signed types."""
    if a == b:
        return a
    wide = ("i64", "u64", "f64")
    if a[0] == "f" or b[0] == "f":
        return "f64" if a in wide or b in wide else "f32"
    if a[0] == "i":
        return "i64" if a == "i64" else "i32"
    if b[0] == "i":
        return "i64" if a == "u64" else "i32"
    return "u64" if "u64" in (a, b) else "u32"


def division_dtype(a: str, b: str) -> str:
    return "f32" if "f32" in (a, b) else "f64"
