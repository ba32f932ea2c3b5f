"""Coordinate and topology files, through Spark's own file reader, so that they may lie in any store. A file is read by one task
(``dcd`` reads mounted trajectories by ranges of frames).

Frames come as ``(path, frame, points array<array<double>>, cell array<double>)``, lengths in angstrom.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hybrid36
from . import dcd

SCHEMA = "path string, frame long, points array<array<double>>, cell array<double>"


def pdb_frames(text: str) -> Iterator[tuple[list, list | None]]:
    """Points of each complete model, or of the whole file where no model is marked. A model without its end is an error."""
    cell, points, inside, marked = None, [], False, False
    for line in text.splitlines():
        kind = line[:6].strip()
        if kind == "CRYST1":
            cell = [float(line[a:b]) for a, b in ((6, 15), (15, 24), (24, 33), (33, 40), (40, 47), (47, 54))]
        elif kind == "MODEL":
            if inside:
                raise ValueError("a model begins inside another")
            inside, marked, points = True, True, []
        elif kind == "ENDMDL":
            yield points, cell
            inside, points = False, []
        elif kind in ("ATOM", "HETATM"):
            points.append([float(line[30:38]), float(line[38:46]), float(line[46:54])])
    if inside:
        raise ValueError("the last model has no end")
    if points and not marked:
        yield points, cell


def gro_frames(text: str) -> Iterator[tuple[list, list | None]]:
    """One or more frames in nm, given in angstrom; the cell from the box line."""
    lines = text.splitlines()
    at = 0
    while at + 2 < len(lines):
        n = int(lines[at + 1])
        rows = lines[at + 2 : at + 2 + n]
        if len(rows) < n or at + 2 + n >= len(lines):
            raise ValueError("the frame is cut short")
        yield [[10 * float(r[a : a + 8]) for a in (20, 28, 36)] for r in rows], [10 * float(v) for v in lines[at + 2 + n].split()]
        at += n + 3


def xyz_frames(text: str, scale: float = 1.0) -> Iterator[tuple[list, list | None]]:
    lines = io.StringIO(text)
    while head := lines.readline():
        if not head.strip():
            continue
        n = int(head)
        lines.readline()
        rows = [lines.readline().split() for _ in range(n)]
        if any(len(r) < 4 for r in rows):
            raise ValueError("the frame is cut short")
        yield [[scale * float(v) for v in r[1:4]] for r in rows], None


FORMATS = {"pdb": pdb_frames, "gro": gro_frames, "xyz": xyz_frames}


def read_frames(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Frames of all ``kind`` files under ``path``; an unfinished frame fails the read."""
    if kind == "dcd":
        return read_dcd(spark, path)
    parse = FORMATS[kind]

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, (points, cell) in enumerate(parse(content.as_py().decode())):
                    yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([k], pa.int64()), pa.array([points], pa.list_(pa.list_(pa.float64()))), pa.array([cell], pa.list_(pa.float64()))], ["path", "frame", "points", "cell"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, SCHEMA)


def read_dcd(spark: SparkSession, path: str, frames: list[int] | None = None) -> DataFrame:
    """Frames of DCD files in any store that Spark reads, each file whole (2 GB at most); ``dcd.read_dcd`` reads mounted files by ranges. With ``frames``,
    only those are decoded."""
    wanted = None if frames is None else frozenset(frames)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                with pa.BufferReader(data) as f:
                    layout = dcd.read_layout(f, data.size)
                    for k in range(layout.frames):
                        if wanted is None or k in wanted:
                            points, cell = dcd.read_frame(f, layout, k)
                            yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([k], pa.int64()), pa.array([list(points)], pa.list_(pa.list_(pa.float64()))), pa.array([cell], pa.list_(pa.float64()))], ["path", "frame", "points", "cell"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, SCHEMA)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a file or folder by the suffix of its path (or, for a folder, of the files in it that a reader knows)."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else None
    if kind is not None:
        if kind not in (*FORMATS, "dcd"):
            raise ValueError(f"no reader for .{kind}")
        return read_frames(spark, path, kind)
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("k")).distinct()
    kinds = sorted(r.k for r in names.collect() if r.k in (*FORMATS, "dcd"))
    if not kinds:
        raise ValueError("no file with a known suffix")
    parts = [_filtered(spark, path, k) for k in kinds]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _filtered(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return read_frames(spark, f"{path.rstrip('/')}/*.{kind}", kind)


def _record(payload: bytes) -> bytes:
    mark = struct.pack("<i", len(payload))
    return mark + payload + mark


def dcd_head(frames: int, atoms: int, cells: bool = False) -> bytes:
    """What stands before the frames of a little-endian DCD file; the number of frames is the word at ``DCD_COUNT``."""
    control = [frames, 0, 1, *[0] * 7, int(cells), *[0] * 8, 24]
    return _record(b"CORD" + struct.pack("<20i", *control)) + _record(struct.pack("<i", 1) + b" " * 80) + _record(struct.pack("<i", atoms))


#: Where the head of a DCD file tells its number of frames.
DCD_COUNT = 8


def dcd_frames(frames: np.ndarray) -> bytes:
    """The records of frames x atoms x 3, one for each axis of a frame."""
    n, atoms = frames.shape[:2]
    out = np.empty((n, 3), np.dtype([("head", "<i4"), ("x", "<f4", (atoms,)), ("tail", "<i4")]))
    out["head"] = out["tail"] = 4 * atoms
    out["x"] = frames.transpose(0, 2, 1)
    return out.tobytes()


def write_dcd(frames: np.ndarray, cells: list | None = None) -> bytes:
    """A little-endian DCD file of frames x atoms x 3."""
    out = [dcd_head(len(frames), frames.shape[1], bool(cells))]
    for k in range(len(frames)):
        if cells:
            a, b, c, alpha, beta, gamma = cells[k]
            out.append(_record(struct.pack("<6d", a, gamma, b, beta, alpha, c)))
        out.append(dcd_frames(frames[k : k + 1]))
    return b"".join(out)


def append_dcd(path: str, batches: Iterator[np.ndarray], atoms: int) -> int:
    """Writes ``batches`` of frames x ``atoms`` x 3 as one DCD file, of which one batch is held at a time, and tells the number of frames.

    The file takes its name when it is whole, so that a second attempt beside the first leaves one of both.
    """
    part, count = f"{path}.{uuid.uuid4().hex}", 0
    with open(part, "wb") as f:
        f.write(dcd_head(0, atoms))
        for frames in batches:
            f.write(dcd_frames(frames))
            count += len(frames)
        f.seek(DCD_COUNT)
        f.write(struct.pack("<i", count))
    os.replace(part, path)
    return count


def read_pdb_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atom rows of PDB files by fixed columns, in the JVM; numbers may be hybrid-36. Order within a file is the serial number's."""
    line = F.col("value")
    cut = lambda a, n: F.btrim(F.substring(line, a, n))
    rows = spark.read.text(path).where(F.substring(line, 1, 6).isin("ATOM  ", "HETATM"))
    element = F.coalesce(F.nullif(cut(77, 2), F.lit("")), F.upper(F.substring(F.regexp_replace(cut(13, 4), r"\d", ""), 1, 1)))
    return rows.select(
        hybrid36(F.substring(line, 7, 5), 5).alias("serial"), cut(13, 4).alias("atom_name"), cut(17, 1).alias("altloc"), cut(18, 3).alias("residue_name"), cut(22, 1).alias("chain_id"),
        hybrid36(F.substring(line, 23, 4), 4).alias("residue_number"), cut(27, 1).alias("insertion_code"), element.alias("element"),
        *[F.substring(line, a, 8).try_cast("double").alias(c) for c, a in (("x", 31), ("y", 39), ("z", 47))],
    )


def read_gro_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atom rows of the first frame of GRO files by fixed columns, in angstrom. Serial numbers wrap at 100,000, so ``serial`` is the place in the file."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                lines = content.as_py().decode().splitlines()
                atoms = lines[2 : 2 + int(lines[1])]
                if len(atoms) < int(lines[1]):
                    raise ValueError("the frame is cut short")
                cut = lambda a, b, atoms=atoms: [r[a:b].strip() for r in atoms]
                cols = [list(range(1, len(atoms) + 1)), cut(10, 15), cut(5, 10), [int(v) for v in cut(0, 5)], *[[10 * float(v) for v in cut(a, a + 8)] for a in (20, 28, 36)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["serial", "atom_name", "residue_name", "residue_number", "x", "y", "z"])

    made = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "serial long, atom_name string, residue_name string, residue_number long, x double, y double, z double")
    return made.withColumn("element", F.upper(F.substring(F.regexp_replace("atom_name", r"\d", ""), 1, 1)))


def json_bonds(text: str) -> list[tuple[int, int]]:
    """Zero-based bonds of a JSON document: a list of pairs, or one under ``bonds``."""
    document = json.loads(text)
    return [(int(a), int(b)) for a, b in (document["bonds"] if isinstance(document, dict) else document)]


def read_bonds(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(path, a, b)`` with a < b of json, psf or prmtop files. An atom bonded to itself, a negative number or a bond told twice fails the read."""
    parse = {"json": json_bonds, "psf": psf_bonds, "prmtop": prmtop_bonds}[kind]

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pairs = sorted((min(p), max(p)) for p in parse(content.as_py().decode()))
                if any(a == b or a < 0 for a, b in pairs) or len(set(pairs)) < len(pairs):
                    raise ValueError("a bond is not between two atoms, or is told twice")
                yield pa.RecordBatch.from_arrays([pa.array([where] * len(pairs)), pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["path", "a", "b"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, a long, b long")


def psf_bonds(text: str) -> list[tuple[int, int]]:
    """Zero-based bonds of a PSF file."""
    lines = text.splitlines()
    at = next(k for k, x in enumerate(lines) if "!NBOND" in x)
    count = int(lines[at].split()[0])
    ids: list[int] = []
    while len(ids) < 2 * count:
        at += 1
        ids += [int(v) for v in lines[at].split()]
    return [(ids[2 * k] - 1, ids[2 * k + 1] - 1) for k in range(count)]


def prmtop_bonds(text: str) -> list[tuple[int, int]]:
    """Zero-based bonds of a PRMTOP file: offsets into the coordinate array, three for each atom."""
    out = []
    for flag in ("BONDS_INC_HYDROGEN", "BONDS_WITHOUT_HYDROGEN"):
        body = text.split(f"%FLAG {flag}", 1)[1].split("%FLAG", 1)[0].split("\n", 2)[2]
        ids = [int(v) for v in body.split()]
        out += [(ids[k] // 3, ids[k + 1] // 3) for k in range(0, len(ids) - 2, 3)]
    return sorted(out)
