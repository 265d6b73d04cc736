"""Frames of any element type: packed arrays as a column that frame jobs read and write.

`data` is a struct of dtype, shape and payload (row order, little-endian).  All
of framelake.operators.raster's jobs on single frames take it in place of
width, height and pixels, which stay the form of 8-bit frames: those have a
kind of None here, packed ones that of their element type.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Element types of packed arrays.
DTYPES = ("uint8", "int8", "uint16", "int16", "int32", "int64", "float32", "float64")
DATA = "struct<dtype:string,shape:array<int>,payload:binary>"


def little(dtype: str) -> np.dtype:
    if dtype not in DTYPES:
        raise ValueError(f"unknown element type {dtype!r}")
    return np.dtype(dtype).newbyteorder("<")


def encoded(a: np.ndarray, dtype: str) -> dict[str, object]:
    """The packed form of a 2-D array."""
    return {"dtype": dtype, "shape": list(a.shape), "payload": np.ascontiguousarray(a).astype(little(dtype)).tobytes()}


def decoded(data: dict[str, object]) -> np.ndarray:
    """The array of a packed one; a payload of another length than its shape is an error."""
    a = np.frombuffer(data["payload"], little(data["dtype"])).reshape(data["shape"])
    return a.astype(a.dtype.newbyteorder("="))


def inverted(a: np.ndarray, kind: np.dtype | None = None) -> np.ndarray:
    """Values taken from 255, the element type's largest, or a float frame's own largest."""
    if kind is None:
        return 255 - a
    if np.issubdtype(kind, np.integer):
        return (np.iinfo(kind).max - a.astype(kind)).astype(kind)
    return (np.nanmax(a) - a).astype(kind) if a.size else a


def limited(corrected: np.ndarray, kind: np.dtype | None = None) -> np.ndarray:
    """Corrected values in the frame's type: whole and within its range, or as they are in a float frame."""
    if kind is None:
        return np.trunc(np.clip(corrected, 0, 255)).astype(np.int64)
    if np.issubdtype(kind, np.integer):
        return np.clip(np.trunc(corrected), float(np.iinfo(kind).min), float(np.iinfo(kind).max)).astype(kind)
    return corrected.astype(kind)


def as_bytes(a: np.ndarray) -> np.ndarray:
    """Byte values of a frame: its own, or its range stretched to 0..255, rounded for whole numbers and cut for floats; 0 where all are equal.

    Whole numbers of 32 or 64 bits are byte values where all of them lie in 0..255.
    """
    if a.dtype == np.uint8 or not a.size or (a.dtype in (np.int32, np.int64) and a.min() >= 0 and a.max() <= 255):
        return a
    x = a.astype(np.float64)
    low, high = x.min(), x.max()
    if not high > low:
        return np.zeros(a.shape, np.uint8)
    stretched = (x - low) * 255.0 / (high - low)
    return (np.rint(stretched) if np.issubdtype(a.dtype, np.integer) else stretched).astype(np.uint8)


def with_data(frames: DataFrame, dtype: str, values: str = "pixels") -> DataFrame:
    """frames with `data` in place of width, height and the values, an array of numbers."""
    from .raster import frame_rows

    little(dtype)
    kept = [c for c in frames.columns if c not in ("width", "height", values)]
    kinds = dict(frames.dtypes)
    fields = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"data {DATA}"])
    rows = lambda r: [(*[r[c] for c in kept], encoded(r["values"].reshape(r["height"], r["width"]), dtype))]
    return frame_rows(frames.withColumnRenamed(values, "values"), rows, fields)


def values(frames: DataFrame, element: str = "double") -> DataFrame:
    """frames with width, height and pixels, an array of the element type, in place of `data`; a type that cannot hold every value is an error."""
    from .raster import frame_rows

    kept = [c for c in frames.columns if c != "data"]
    kinds = dict(frames.dtypes)
    target = {"int": np.int32, "long": np.int64, "bigint": np.int64, "float": np.float32, "double": np.float64}[element]

    def rows(r: dict) -> list[tuple]:
        a = r["pixels"]
        out = a.astype(target)
        if not np.array_equal(out.astype(a.dtype), a, equal_nan=np.issubdtype(a.dtype, np.floating)):
            raise ValueError(f"{element} cannot hold all values of a frame of {r['data']['dtype']}")
        return [(*[r[c] for c in kept], a.shape[1], a.shape[0], out.reshape(-1))]

    return frame_rows(frames, rows, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"width int, height int, pixels array<{element}>"]))
