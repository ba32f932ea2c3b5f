"""Readers, manifests and tables round trip."""

import json

import numpy as np
import pytest

from seriata.sources import coordinates, manifests

PDB = """CRYST1   10.000   20.000   30.000  90.00  90.00  90.00 P 1           1
MODEL        1
ATOM      1  CA  ALA A   1       1.000   2.000   3.000  1.00  0.00           C
HETATMA0000 ZN    ZN B   2A      4.000   5.000   6.000  1.00  0.00          ZN
ENDMDL
MODEL        2
ATOM      1  CA  ALA A   1       1.500   2.000   3.000  1.00  0.00           C
HETATMA0000 ZN    ZN B   2A      4.000   5.500   6.000  1.00  0.00          ZN
ENDMDL
"""


def write(path, data):
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{path}"


def test_pdb(spark, tmp_path):
    path = write(tmp_path / "a.pdb", PDB)
    rows = coordinates.read_frames(spark, path, "pdb").orderBy("frame").collect()
    assert [r.frame for r in rows] == [0, 1] and rows[1].points[1] == [4.0, 5.5, 6.0] and rows[0].cell[:3] == [10, 20, 30]
    atoms = coordinates.read_pdb_atoms(spark, path).orderBy("serial").collect()
    assert {(r.serial, r.atom_name, r.insertion_code, r.element) for r in atoms} == {(1, "CA", "", "C"), (100000, "ZN", "A", "ZN")}
    broken = write(tmp_path / "b.pdb", PDB[: PDB.rindex("ENDMDL")])
    with pytest.raises(Exception, match="has no end"):
        coordinates.read_frames(spark, broken, "pdb").collect()


def test_xyz_and_gro(spark, tmp_path):
    xyz = "2\nfirst\nC 1 2 3\nN 4 5 6\n2\nsecond\nC 1 2 4\nN 4 5 7\n"
    assert coordinates.read_frames(spark, write(tmp_path / "a.xyz", xyz), "xyz").count() == 2
    gro = "title\n 1\n" + "    1SOL     OW    1   0.100   0.200   0.300\n" + "   1.00000   2.00000   3.00000\n"
    row = coordinates.read_frames(spark, write(tmp_path / "a.gro", gro), "gro").first()
    assert np.allclose(row.points, [[1, 2, 3]]) and row.cell == [10, 20, 30]


@pytest.mark.parametrize("cells", [None, [[10.0, 11.0, 12.0, 90.0, 90.0, 90.0]] * 5])
def test_dcd(spark, tmp_path, cells):
    frames = np.arange(5 * 4 * 3, dtype=float).reshape(5, 4, 3)
    path = write(tmp_path / "a.dcd", coordinates.write_dcd(frames, cells))
    rows = coordinates.read_dcd(spark, path).orderBy("frame").collect()
    assert np.allclose([r.points for r in rows], frames) and (rows[0].cell == (cells[0] if cells else None))
    assert [r.frame for r in coordinates.read_dcd(spark, path, [1, 4]).orderBy("frame").collect()] == [1, 4]


def test_bonds():
    assert coordinates.psf_bonds("PSF\n\n       2 !NBOND: bonds\n       1       2       2       3\n") == [(0, 1), (1, 2)]
    text = "%FLAG BONDS_INC_HYDROGEN\n%FORMAT(10I8)\n       0       3       1\n%FLAG BONDS_WITHOUT_HYDROGEN\n%FORMAT(10I8)\n       3       6       2\n"
    assert coordinates.prmtop_bonds(text) == [(0, 1), (1, 2)]


def test_manifest(spark, tmp_path):
    axis = {"first": 0.0, "interval": 2.0, "unit": "ns"}
    good = {"segment_id": "a", "path": "a.xyz", "timing": axis}
    bad = {"segment_id": "b", "path": "b.xyz", "timing": {**axis, "unit": "hours"}}
    path = write(tmp_path / "m.json", json.dumps({"systems": [{"system_id": "s", "replicas": [{"replica_id": "r", "segments": [good, bad, good]}]}]}))
    rows = manifests.segments(spark, path)
    assert rows.orderBy("segment_ord").first().interval == 2000.0
    assert sorted(r.code for r in manifests.segment_issues(rows).collect()) == ["duplicate_segment", "interval"]
    with pytest.raises(ValueError, match="repeated keys"):
        manifests.load_json('{"a": 1, "a": 2}')
    assert manifests.inventory(spark, path).first().bytes > 0


def test_table_contract(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    manifests.write_table(spark.range(5), path, {"unit": "ps"})
    assert manifests.read_table(spark, path).where("unit = 'ps'").count() == 5
    spark.range(1).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="rows"):
        manifests.read_table(spark, path)


def test_assertions(spark):
    expected = spark.createDataFrame([("a", "equal", "1", None), ("b", "close", "2", 0.1), ("c", "contains", "x", None), ("d", "is_null", None, None), ("e", "equal", "1", None)], "name string, operator string, expected string, tolerance double")
    observed = spark.createDataFrame([("a", "1"), ("b", "2.05"), ("c", "axb"), ("d", None), ("e", "2")], "name string, value string")
    assert {r.name: r.passed for r in manifests.compare_values(expected, observed).collect()} == {"a": True, "b": True, "c": True, "d": True, "e": False}


def test_bonds_and_topology(spark, tmp_path):
    made = {"json": '{"bonds": [[1, 0], [1, 2]]}', "psf": "PSF\n\n       2 !NBOND: bonds\n       1       2       3       2\n", "prmtop": "%FLAG BONDS_INC_HYDROGEN\n%FORMAT(10I8)\n       0       3       1\n%FLAG BONDS_WITHOUT_HYDROGEN\n%FORMAT(10I8)\n       3       6       1\n"}
    for kind, text in made.items():
        rows = coordinates.read_bonds(spark, write(tmp_path / f"b.{kind}", text), kind)
        assert sorted((r.a, r.b) for r in rows.collect()) == [(0, 1), (1, 2)]
    with pytest.raises(Exception, match="told twice"):
        coordinates.read_bonds(spark, write(tmp_path / "c.json", "[[0, 1], [1, 0]]"), "json").count()
    gro = "title\n2\n    1SOL     OW    1   0.100   0.200   0.300\n    1SOL    HW1    2   0.150   0.200   0.300\n   1.0 1.0 1.0\n"
    atoms = coordinates.read_gro_atoms(spark, write(tmp_path / "a.gro", gro)).orderBy("serial").collect()
    assert [(r.atom_name, r.residue_name, r.element, round(r.x, 3)) for r in atoms] == [("OW", "SOL", "O", 1.0), ("HW1", "SOL", "H", 1.5)]


def test_readers_by_suffix(spark, tmp_path):
    write(tmp_path / "d" / "a.pdb", PDB)
    write(tmp_path / "d" / "b.xyz", "1\n\nC 0 0 1\n")
    write(tmp_path / "d" / "c.dcd", coordinates.write_dcd(np.zeros((3, 2, 3)), None))
    write(tmp_path / "d" / "notes.txt", "x")
    assert coordinates.read_any(spark, f"file://{tmp_path}/d").count() == 6 and coordinates.read_any(spark, f"file://{tmp_path}/d/b.xyz").count() == 1
    with pytest.raises(ValueError, match="no reader"):
        coordinates.read_any(spark, f"file://{tmp_path}/d/notes.txt")
