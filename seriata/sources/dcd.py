"""DCD trajectories as a Spark data source: ranges of frames are partitions, and frames that aren't asked for are never read.

``spark.read.format("dcd").load(path)`` after ``register(spark)`` gives ``(path, frame, points array<array<double>>, cell array<double>)``. Files lie where
every executor can open them (a mounted folder); ``coordinates.read_dcd`` takes files in any store, whole. A record whose
markers disagree, or a last frame that is cut short, fails the read.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, frame long, points array<array<double>>, cell array<double>"
#: Bytes of frames in a partition, unless the option ``rangeBytes`` says otherwise.
RANGE_BYTES = 128 << 20
#: Frames that a reader holds at once.
BATCH_FRAMES = 16


@dataclass(frozen=True)
class Layout:
    """What the head records of a file tell about its frames."""

    order: str
    atoms: int
    first: int
    cell_bytes: int
    fourth: bool
    frames: int

    @property
    def frame_bytes(self) -> int:
        axes = 4 if self.fourth else 3
        return (self.cell_bytes + 8 if self.cell_bytes else 0) + axes * (4 * self.atoms + 8)


def _record(f: BinaryIO, order: str) -> bytes:
    """The next record's payload, its two length markers checked."""
    head = f.read(4)
    size = struct.unpack(order + "i", head)[0] if len(head) == 4 else -1
    payload = f.read(size) if size >= 0 else b""
    if len(payload) != size or f.read(4) != head:
        raise ValueError("a record is cut short or its markers disagree")
    return payload


def read_layout(f: BinaryIO, size: int) -> Layout:
    """Only files whose last control word is not zero have the extensions that words 11 and 12 tell: a cell and a fourth dimension."""
    mark = f.read(4)
    f.seek(0)
    order = next((o for o in "<>" if mark == struct.pack(o + "i", 84)), None)
    if order is None:
        raise ValueError("not a DCD file")
    head = _record(f, order)
    if head[:4] != b"CORD":
        raise ValueError("not a DCD file")
    control = struct.unpack(order + "20i", head[4:])
    if control[8]:
        raise ValueError("fixed atoms are not supported")
    extended = control[19] != 0
    _record(f, order)
    atoms = struct.unpack(order + "i", _record(f, order))[0]
    first, cell = f.tell(), 0
    if extended and control[10] and size > first:
        cell = struct.unpack(order + "i", f.read(4))[0]
        if cell not in (24, 48):
            raise ValueError(f"a cell record of {cell} bytes")
    layout = Layout(order, atoms, first, cell, bool(extended and control[11]), 0)
    frames, rest = divmod(size - first, layout.frame_bytes)
    if rest:
        raise ValueError("the last frame is cut short")
    return Layout(order, atoms, first, cell, layout.fourth, frames)


def read_frame(f: BinaryIO, layout: Layout, k: int) -> tuple[np.ndarray, list[float] | None]:
    """Points and cell (lengths, then angles) of frame ``k``; the bytes of other frames are passed over."""
    f.seek(layout.first + k * layout.frame_bytes)
    cell = None
    if layout.cell_bytes:
        values = struct.unpack(layout.order + ("6d" if layout.cell_bytes == 48 else "6f"), _record(f, layout.order))
        cell = [values[i] for i in (0, 2, 5, 4, 3, 1)]
    axes = [np.frombuffer(_record(f, layout.order), layout.order + "f4") for _ in range(4 if layout.fourth else 3)]
    if any(len(x) != layout.atoms for x in axes):
        raise ValueError("a frame has the wrong number of atoms")
    return np.stack(axes[:3], 1).astype(float), cell


@dataclass
class FrameRange(InputPartition):
    path: str
    start: int
    end: int


class DcdReader(DataSourceReader):
    def __init__(self, options: dict):
        self.where = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.lo, self.hi = int(options.get("start", 0)), int(options["end"]) if "end" in options else None
        self.only = frozenset(map(int, options["frames"].split(","))) if options.get("frames") else None

    def _files(self) -> list[str]:
        at = urlparse(self.where).path if self.where.startswith("file:") else self.where
        found = sorted(glob.glob(f"{at}/*.dcd")) if os.path.isdir(at) else sorted(glob.glob(at))
        if not found:
            raise FileNotFoundError(self.where)
        return found

    def partitions(self) -> list[FrameRange]:
        out = []
        for path in self._files():
            with open(path, "rb") as f:
                layout = read_layout(f, os.path.getsize(path))
            lo, hi = self.lo, layout.frames if self.hi is None else min(self.hi, layout.frames)
            if self.only is not None:
                inside = [k for k in self.only if lo <= k < hi]
                lo, hi = (min(inside), max(inside) + 1) if inside else (0, 0)
            each = max(1, self.range_bytes // max(1, layout.frame_bytes))
            out += [FrameRange(path, a, min(hi, a + each)) for a in range(lo, hi, each)]
        return out or [FrameRange("", 0, 0)]

    def read(self, partition: FrameRange) -> Iterator:
        import pyarrow as pa

        if partition.start >= partition.end:
            return
        with open(partition.path, "rb") as f:
            layout = read_layout(f, os.path.getsize(partition.path))
            wanted = [k for k in range(partition.start, partition.end) if self.only is None or k in self.only]
            for lo in range(0, len(wanted), BATCH_FRAMES):
                frames = [(k, *read_frame(f, layout, k)) for k in wanted[lo : lo + BATCH_FRAMES]]
                flat = np.concatenate([p.reshape(-1) for _, p, _ in frames])
                points = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 3, dtype=np.int32), pa.array(flat))
                rows = pa.ListArray.from_arrays(np.arange(0, len(frames) * layout.atoms + 1, max(1, layout.atoms), dtype=np.int32), points)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(frames)), pa.array([k for k, _, _ in frames], pa.int64()), rows, pa.array([c for _, _, c in frames], pa.list_(pa.float64()))], ["path", "frame", "points", "cell"])


class DcdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DcdReader:
        return DcdReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(DcdSource)


def read_dcd(spark: SparkSession, path: str, start: int = 0, end: int | None = None, frames: list[int] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames from ``start`` to before ``end``, or just ``frames``, of the files under ``path``.

    They are chosen by options and not by pushed filters: this Spark keeps a Python source's pushed filters with the relation, so that a second query
    on the same DataFrame would still see those of the first.
    """
    register(spark)
    chosen = spark.read.format("dcd").option("rangeBytes", range_bytes).option("start", start)
    chosen = chosen if end is None else chosen.option("end", end)
    return (chosen if frames is None else chosen.option("frames", ",".join(map(str, frames)) or "-1")).load(path)
