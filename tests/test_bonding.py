"""Bond chemistry, gates, sites and text sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriata.operators import bonding
from seriata.sources import coordinates, exports

ATOMS = [(0, "O", "HOH", 1), (1, "H", "HOH", 1), (2, "H", "HOH", 1), (3, "O", "SER", 2), (4, "N", "ALA", 3), (5, "H", "ALA", 3), (6, "C", "ALA", 3)]
POINTS = {0: (0, 0, 0), 1: (1, 0, 0), 2: (0, 1, 0), 3: (2.8, 0, 0), 4: (0, 0, 2.9), 5: (0, 0, 1.9), 6: (5, 5, 5)}


@pytest.fixture()
def system(spark):
    atoms = spark.createDataFrame(ATOMS, "id long, element string, residue_name string, residue long")
    bonds = spark.createDataFrame([(0, 1), (0, 2), (4, 5), (4, 6)], "a long, b long")
    rows = [(f, k, *map(float, p)) for f in (0, 1) for k, p in POINTS.items() if not (f == 1 and k == 3)]
    return atoms, bonds, spark.createDataFrame(rows, "frame long, id long, x double, y double, z double")


def test_bonds(system):
    atoms, bonds, points = system
    donors, acceptors = bonding.chemical_roles(atoms, bonds)
    assert {(r.donor, r.hydrogen) for r in donors.collect()} == {(0, 1), (0, 2), (4, 5)}
    assert {r.acceptor for r in acceptors.collect()} == {0, 3}
    assert bonding.endpoint_pair_count(donors, acceptors).first().candidates == 3 * 2 - 2
    got = bonding.bonds_in_frames(donors, acceptors, points, 3.0, 150.0)
    assert {(r.frame, r.donor, r.hydrogen, r.acceptor) for r in got.collect()} == {(0, 0, 1, 3), (0, 4, 5, 0), (1, 4, 5, 0)}
    assert bonding.bonds_in_frames(donors, acceptors, points, 3.0, 150.0, "solute").count() == 0
    assert bonding.bonds_in_frames(donors, acceptors, points, 3.0, 150.0, box=(20.0, 20.0, 20.0)).count() == 3


def test_water_bridges(spark):
    rows = [(0, 9, 1, 1, "donor", 2.8, 170.0, 5), (0, 9, 1, 1, "donor", 2.7, 160.0, 6), (0, 9, 2, 2, "acceptor", 2.9, 170.0, 7), (0, 9, 3, 1, "acceptor", 2.9, 170.0, 8)]
    e = spark.createDataFrame(rows, "frame long, water long, endpoint long, residue long, role string, distance double, angle double, hydrogen long")
    assert {(r.a, r.b, r.waters, r.relation) for r in bonding.water_bridges(e).collect()} == {(1, 2, 1, "acceptor-donor"), (2, 3, 1, "acceptor-acceptor")}
    assert bonding.water_bridges(e, same_residue=True).count() == 3
    assert bonding.best_edges(e, ["water", "endpoint", "role"]).where("endpoint = 1").first().hydrogen == 6


def test_selection(spark, system):
    atoms = system[0].withColumn("atom_name", F.col("element"))
    assert bonding.select_atoms(atoms, "heavy").count() == 4
    assert bonding.select_atoms(atoms, "water", names=["O"]).count() == 1
    with pytest.raises(ValueError, match="empty"):
        bonding.select_atoms(atoms, "nucleic")


def test_gates(spark):
    rows = [(0, 1, 0.0, 0.0, 0.0), (0, 2, 0.0, 0.0, 0.1), (1, 1, 9.0, 0.0, 0.0), (1, 2, 0.0, 0.0, float("nan")), (1, 3, 60.0, 0.0, 0.0)]
    got = bonding.structural_issues(spark.createDataFrame(rows, "frame long, id long, x double, y double, z double"), 50.0, 5.0, 0.5)
    assert {(r.code, r.frame) for r in got.collect()} == {("not_finite", 1), ("near_coincident", 0), ("displacement", 1), ("extent", 1)}


def test_sites(spark):
    rng = np.random.default_rng(1)
    rows = [(f, *map(float, np.array(c) + rng.normal(0, 0.05, 3))) for f in range(40) for c in ((1.5, 1.5, 1.5), (7.5, 1.5, 1.5))] + [(f, *map(float, rng.uniform(0, 30, 3))) for f in range(40)]
    df = spark.createDataFrame(rows, "frame long, x double, y double, z double")
    got = bonding.stable_sites(df, 1.0, 0.9).where("verdict = 'stable'").orderBy("x").collect()
    assert [round(r.x, 1) for r in got] == [1.5, 7.5] and all(r.rmsd < 0.3 and r.frames >= 36 for r in got)
    assert {r.verdict for r in bonding.stable_sites(df, 1.0, least_frames=41).collect()} == {"not_estimable"}


def test_gates_never_compare_replicas(spark):
    rows = [("a", 0, 1, 0.0, 0.0, 0.0), ("b", 1, 1, 90.0, 0.0, 0.0), ("b", 2, 1, 99.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "replica string, frame long, id long, x double, y double, z double")
    assert [(r.replica, r.frame, r.code) for r in bonding.structural_issues(df, 50.0, 5.0, 0.5, ("replica",)).collect()] == [("b", 2, "displacement")]


def test_names_of_residues(spark):
    names = ["TIP3P", "SPCE", "HID", "CYX", "ACE", "HSD", "DT5", "NA+", "ZN2", "LIG", " wat "]
    got = [r.e for r in spark.createDataFrame([(n,) for n in names], "residue_name string").select(bonding.entity_class().alias("e")).collect()]
    assert got == ["water", "water", *["protein"] * 4, "nucleic", "ion", "ion", "other", "water"]


def test_text_sinks(spark, tmp_path):
    atoms = spark.createDataFrame([(1, "CA", "ALA", "A", 1, 1.0, 2.0, 3.0, "C"), (2, "ZN", "ZN", "B", 2, 4.0, 5.0, 6.0, "ZN")], "serial int, atom_name string, residue_name string, chain_id string, residue_number int, x double, y double, z double, element string")
    exports.write_factor_pdb(atoms, spark.createDataFrame([(1, 12.5)], "serial int, rmsf double"), "serial", "rmsf", f"file://{tmp_path}/b")
    back = coordinates.read_pdb_atoms(spark, f"file://{tmp_path}/b").orderBy("serial").collect()
    assert [(r.serial, r.residue_name, r.x, r.element) for r in back] == [(1, "ALA", 1.0, "C"), (2, "ZN", 4.0, "ZN")]
    frames = spark.createDataFrame([(k, ["C"], [[float(k), 0.0, 0.0]]) for k in range(3)], "frame long, elements array<string>, points array<array<double>>")
    exports.write_state_frames(frames, spark.createDataFrame([(0, 1), (1, 2), (2, None)], "frame long, state int"), f"file://{tmp_path}/x")
    assert coordinates.read_frames(spark, f"file://{tmp_path}/x/state=1", "xyz").first().points == [[0.0, 0.0, 0.0]]
    exports.write_grid(spark.createDataFrame([(1, None), (2, 0.5)], "i int, v double"), f"file://{tmp_path}/g")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/g").count() == 2


def test_long_numbers_keep_their_columns(spark, tmp_path):
    """Serial numbers from 100,000 and residue numbers from 10,000 on are written as hybrid-36."""
    serials = [-9, 99_999, 100_000, 100_035, 43_770_015, 43_770_016, 87_440_031]
    numbers = [9_999, 10_000, 10_035, 1_223_055, 1_223_056, 2_436_111, -999]
    rows = [(s, "CA", "ALA", "A", n, 1.5, -2.0, 3.0, "C") for s, n in zip(serials, numbers, strict=True)]
    atoms = spark.createDataFrame(rows, "serial int, atom_name string, residue_name string, chain_id string, residue_number int, x double, y double, z double, element string")
    none = spark.createDataFrame([], "serial int, rmsf double")
    exports.write_factor_pdb(atoms, none, "serial", "rmsf", f"file://{tmp_path}/b")
    assert {len(r.value) for r in spark.read.text(f"file://{tmp_path}/b").collect()} == {78}
    back = coordinates.read_pdb_atoms(spark, f"file://{tmp_path}/b").orderBy("serial").collect()
    assert [(r.serial, r.residue_number, r.atom_name, r.chain_id, r.x, r.y) for r in back] == [(s, n, "CA", "A", 1.5, -2.0) for s, n in zip(serials, numbers, strict=True)]
    with pytest.raises(Exception, match="hybrid-36"):
        exports.write_factor_pdb(atoms.withColumn("serial", F.lit(87_440_032)), none, "serial", "rmsf", f"file://{tmp_path}/c")
