"""Text sinks: PDB and XYZ frames per state, profiles as B-factors, grids and matrices as CSV. Spark's writers commit whole outputs only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_hybrid36


def pdb_line(serial: Column, name: Column, residue: Column, chain: Column, number: Column, xyz: list[Column], factor: Column, element: Column) -> Column:
    """One ATOM line in fixed columns; numbers that are too long for theirs are hybrid-36."""
    return F.format_string("ATOM  %s %-4s %3s %1s%s    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", to_hybrid36(serial, 5), name, residue, chain, to_hybrid36(number, 4), *xyz, F.lit(1.0), factor, element)


def write_factor_pdb(atoms: DataFrame, profile: DataFrame, key: str, value: str, path: str, cap: float = 999.99) -> None:
    """Atoms with a profile value in the B-factor column (0 where there is none), in serial order."""
    rows = atoms.join(profile.select(key, F.col(value).cast("double").alias("_b")), key, "left")
    line = pdb_line(F.col("serial"), F.col("atom_name"), F.col("residue_name"), F.col("chain_id"), F.col("residue_number"), [F.col(c) for c in "xyz"], F.least(F.lit(cap), F.coalesce("_b", F.lit(0.0))), F.col("element"))
    rows.select("serial", line.alias("value")).sort("serial").select("value").write.text(path)


def write_state_frames(frames: DataFrame, states: DataFrame, path: str) -> None:
    """XYZ text of ``frames(frame, elements array<string>, points)``, one folder per state of ``states(frame, state)``; frames without a state are left out."""
    atom = F.zip_with("elements", "points", lambda e, p: F.format_string("%s %.6f %.6f %.6f", e, p[0], p[1], p[2]))
    text = F.concat_ws("\n", F.size("points").cast("string"), F.format_string("frame %d", F.col("frame")), F.array_join(atom, "\n"))
    frames.join(states.where("state is not null").select("frame", "state"), "frame").select("state", text.alias("value")).write.partitionBy("state").text(path)


def write_grid(cells: DataFrame, path: str) -> None:
    """A table as CSV with a header; undefined values are empty."""
    cells.write.option("header", True).option("nullValue", "").csv(path)
