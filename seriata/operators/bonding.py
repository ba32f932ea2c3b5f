"""Donor and acceptor chemistry: selections, roles, candidate pairs, their geometry per frame, and bridges through shared partners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import dot3, norm3
from .joins import near_rows, neighbor_pairs

# Residue names by class, as force fields and structure files write them, and names of backbone atoms.
WATER = ("HOH", "WAT", "H2O", "DOD", "SOL", "SPC", "SPCE", "TIP", "TIP2", "TIP3", "TIP3P", "TP3", "TIP4", "TIP4P", "T4P", "TIP5", "OPC")
AMINO = (
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL",
    "ASH", "CYM", "CYX", "GLH", "HID", "HIE", "HIP", "HSD", "HSE", "HSP", "LYN", "MSE", "SEC", "PYL", "ACE", "NME", "NMA", "NH2",
)
NUCLEIC = ("A", "C", "G", "I", "T", "U", "DA", "DC", "DG", "DI", "DT", "DU", "RA", "RC", "RG", "RU", "A3", "A5", "C3", "C5", "G3", "G5", "U3", "U5", "DA3", "DA5", "DC3", "DC5", "DG3", "DG5", "DT3", "DT5", "ADE", "CYT", "GUA", "THY", "URA")
ION = ("NA", "NA+", "SOD", "K", "K+", "POT", "CL", "CL-", "CLA", "LI", "RB", "CS", "CES", "MG", "MG2", "CA", "CA2", "CAL", "ZN", "ZN2", "MN", "FE", "CU", "NI", "CO", "BR", "F", "I-")
BACKBONE = ("N", "CA", "C", "O")
#: Elements that donate or accept.
POLAR = ("N", "O", "S", "F")


def select_atoms(atoms: DataFrame, preset: str | None = None, names: list[str] | None = None, residues: list[tuple[str, int]] | None = None, heavy_only: bool = False) -> DataFrame:
    """Rows of ``atoms`` by preset (all, heavy, backbone, alpha_carbons, protein, nucleic, water), names, or (chain, number) of residues. An empty selection is an error."""
    presets: dict[str, Column] = {
        "all": F.lit(True), "heavy": F.col("element") != "H", "backbone": F.col("residue_name").isin(*AMINO) & F.col("atom_name").isin(*BACKBONE), "alpha_carbons": F.col("residue_name").isin(*AMINO) & (F.col("atom_name") == "CA"),
        "protein": F.col("residue_name").isin(*AMINO), "nucleic": F.col("residue_name").isin(*NUCLEIC), "water": F.col("residue_name").isin(*WATER),
    }
    keep = presets[preset or "all"]
    if names is not None:
        keep = keep & F.col("atom_name").isin(*names)
    if residues is not None:
        keep = keep & reduce(lambda a, b: a | b, [(F.col("chain_id") == c) & (F.col("residue_number") == n) for c, n in residues], F.lit(False))
    if heavy_only:
        keep = keep & (F.col("element") != "H")
    out = atoms.where(keep)
    if not out.limit(1).count():
        raise ValueError("the selection is empty")
    return out


def entity_class(residue_name: str = "residue_name") -> Column:
    """protein, nucleic, water, ion or other."""
    r = F.upper(F.btrim(F.col(residue_name)))
    return F.when(r.isin(*AMINO), "protein").when(r.isin(*NUCLEIC), "nucleic").when(r.isin(*WATER), "water").when(r.isin(*ION), "ion").otherwise("other")


def chemical_roles(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(donors, acceptors)`` of ``atoms(id, element, residue, residue_name)`` and ``bonds(a, b)``: a polar atom with a bonded hydrogen
    donates through each of them (``donor, hydrogen``); oxygens, fluorines, sulfurs, and nitrogens without a hydrogen accept."""
    both = bonds.select("a", "b").unionByName(bonds.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    hydrogens = atoms.where("element = 'H'").select(F.col("id").alias("b"))
    polar = atoms.where(F.col("element").isin(*POLAR)).withColumn("entity", entity_class())
    donors = polar.join(both, F.col("id") == F.col("a")).join(hydrogens, "b").select(F.col("id").alias("donor"), F.col("b").alias("hydrogen"), "residue", "entity")
    acceptors = polar.join(donors.where("entity is not null").select(F.col("donor").alias("id")).distinct().withColumn("_h", F.lit(True)), "id", "left")
    return donors, acceptors.where((F.col("element") != "N") | F.col("_h").isNull()).select(F.col("id").alias("acceptor"), "residue", "entity")


def scope_allows(scope: str, left: Column, right: Column) -> Column:
    """Whether a pair of entity classes is inside a scope: all, solute, intra_class, inter_class, or two classes joined by a dash."""
    if scope == "all":
        return F.lit(True)
    if scope == "solute":
        return (left != "water") & (right != "water")
    if scope == "intra_class":
        return left == right
    if scope == "inter_class":
        return left != right
    a, b = scope.split("-")
    return ((left == a) & (right == b)) | ((left == b) & (right == a))


def bonds_in_frames(donors: DataFrame, acceptors: DataFrame, points: DataFrame, distance: float, angle: float, scope: str = "all", box: tuple[float, float, float] | None = None) -> DataFrame:
    """``(frame, donor, hydrogen, acceptor, distance, angle)`` of all donor-acceptor pairs that hold in a frame of ``points(frame, id, x, y, z)``.

    Candidates are never listed: pairs come from the cell grid of each frame, and the scope, the exclusion of one residue and the angle at the hydrogen are
    tested where they meet. A donor brings its hydrogen's place along, so no pair is joined again.
    """
    xyz = ("x", "y", "z")
    image = lambda x, k: x - box[k] * F.floor(x / box[k] + 0.5) if box else x
    at_hydrogen = points.select("frame", F.col("id").alias("hydrogen"), *[F.col(c).alias(f"_h{c}") for c in xyz])
    d = points.join(donors.withColumnsRenamed({"donor": "id", "residue": "_dr", "entity": "_de"}), "id").join(at_hydrogen, ["frame", "hydrogen"])
    d = d.withColumns({f"_u{c}": image(F.col(c) - F.col(f"_h{c}"), k) for k, c in enumerate(xyz)}).withColumn("_u", norm3([F.col(f"_u{c}") for c in xyz]))
    a = points.join(acceptors.withColumnsRenamed({"acceptor": "id", "residue": "_ar", "entity": "_ae"}), "id")
    near = near_rows(d, a, distance, "frame", box, carry=("hydrogen", "_dr", "_de", *[f"_{n}{c}" for n in "hu" for c in xyz], "_u"), carry_right=("_ar", "_ae")).where("left_id <> right_id")
    kind = near.where((F.col("_dr") != F.col("_ar")) & scope_allows(scope, F.col("_de"), F.col("_ae")))
    # the angle is part of the join's condition, and written short: a longer one makes a method that the JVM doesn't compile
    v = [image(F.col(f"r{c}") - F.col(f"_h{c}"), k) for k, c in enumerate(xyz)]
    arms = F.col("_u") * norm3(v)
    turn = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(dot3([F.col(f"_u{c}") for c in xyz], v), arms)))))
    held = kind.where(arms > 0).withColumn("angle", turn).where(F.col("angle") >= angle)
    return held.select("frame", F.col("left_id").alias("donor"), "hydrogen", F.col("right_id").alias("acceptor"), "distance", "angle")


def best_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The best of several edges with the same keys: shortest, then widest angle, then lowest hydrogen."""
    order = W.partitionBy(*keys).orderBy("distance", F.col("angle").desc(), "hydrogen")
    return edges.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def water_bridges(edges: DataFrame, same_residue: bool = False) -> DataFrame:
    """``(frame, a, b, waters, relation)`` of endpoints tied through a water: ``edges(frame, water, endpoint, residue, role, distance, angle, hydrogen)``.

    Of the edges of a water to an endpoint in one role the best counts. The relation names both roles in order; pairs of one endpoint, and
    of one residue unless allowed, are left out. Pairs form inside one water of one frame, whose few contacts bound them.
    """
    e = best_edges(edges, ["frame", "water", "endpoint", "role"])
    left = e.select("frame", "water", F.col("endpoint").alias("a"), F.col("residue").alias("_ra"), F.col("role").alias("_xa"))
    right = e.select("frame", "water", F.col("endpoint").alias("b"), F.col("residue").alias("_rb"), F.col("role").alias("_xb"))
    pairs = left.join(right, ["frame", "water"]).where("a < b")
    pairs = pairs if same_residue else pairs.where("_ra <> _rb")
    relation = F.concat_ws("-", F.least("_xa", "_xb"), F.greatest("_xa", "_xb"))
    return pairs.groupBy("frame", "a", "b", relation.alias("relation")).agg(F.count_distinct("water").alias("waters"))


def endpoint_pair_count(donors: DataFrame, acceptors: DataFrame) -> DataFrame:
    """How many donor-acceptor candidates exist outside single residues, from counts alone."""
    d, a = donors.groupBy("residue").agg(F.count("*").alias("d")), acceptors.groupBy("residue").agg(F.count("*").alias("a"))
    both = d.join(a, "residue", "full").select(F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("a", F.lit(0)).alias("a"))
    return both.agg((F.coalesce(F.sum("d"), F.lit(0)) * F.coalesce(F.sum("a"), F.lit(0)) - F.coalesce(F.sum(F.col("d") * F.col("a")), F.lit(0))).alias("candidates"))


# --- integrity gates and stable sites ---------------------------------------------------------------------------


def structural_issues(points: DataFrame, reach: float, step: float, contact: float, identity: tuple[str, ...] = ()) -> DataFrame:
    """Broken gates of ``points(*identity, frame, id, x, y, z)``: not finite, extent beyond ``reach``, a move over ``step`` since the last frame, or two
    atoms within ``contact``. ``identity`` names the columns of system, replica and segment: frames of different ones are never compared."""
    xyz, keys = ("x", "y", "z"), list(identity)
    finite = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e12) for c in xyz])
    told = lambda code, df, where: df.select(*keys, F.lit("error").alias("severity"), F.lit(code).alias("code"), F.col("frame"), where.cast("string").alias("location"))
    good = points.where(finite)
    before = W.partitionBy(*keys, "id").orderBy("frame")
    moved = F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - F.lag(c).over(before)) * (F.col(c) - F.lag(c).over(before)) for c in xyz]))
    wide = good.groupBy(*keys, "frame").agg(F.greatest(*[F.max(c) - F.min(c) for c in xyz]).alias("extent")).where(F.col("extent") > reach)
    at = F.struct(*keys, "frame")
    close = neighbor_pairs(good.withColumn("_at", at), good.withColumn("_at", at), contact, "_at").where("left_id < right_id").select(*[F.col(f"_at.{k}").alias(k) for k in [*keys, "frame"]], "left_id", "right_id")
    parts = [told("not_finite", points.where(~finite), F.col("id")), told("extent", wide, F.col("extent")), told("displacement", good.withColumn("_m", moved).where(F.col("_m") > step), F.col("id")), told("near_coincident", close, F.concat_ws("-", "left_id", "right_id"))]
    return reduce(lambda a, b: a.unionByName(b), parts)


def stable_sites(points: DataFrame, radius: float, least_share: float = 0.5, least_frames: int = 1, most_rmsd: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sites of each state of ``points(*keys, frame, x, y, z)``: ``(*keys, site, x, y, z, points, frames, occupancy, rmsd, verdict)``.

    Centres are grid cells of one radius that no neighbour surpasses in frames (ties to the lower cell). Points go to their nearest centre within
    the radius, one pass moves each centre to the mean of its points, and points are assigned anew. Occupancy is distinct frames over the state's; ``verdict``
    is stable, transient, or not_estimable for a state below ``least_frames``. Counts are partial aggregates; a point meets
    the few centres of its neighbouring cells, so dense sites never meet in one task.
    """
    state, xyz = list(keys), ("x", "y", "z")
    cell = [F.floor(F.col(c) / radius).cast("bigint").alias(f"c{c}") for c in xyz]
    sizes = points.groupBy(*state).agg(F.count_distinct("frame").alias("_frames")) if state else points.agg(F.count_distinct("frame").alias("_frames"))
    counts = points.select(*state, "frame", *cell).distinct().groupBy(*state, "cx", "cy", "cz").agg(F.count("*").alias("n"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])).alias("s")
    rivals = counts.select(*state, "n", *[F.col(f"c{c}").alias(f"o{c}") for c in xyz], steps).select(*state, *[(F.col(f"o{c}") + F.col(f"s.{c}")).alias(f"c{c}") for c in xyz], F.struct((-F.col("n")).alias("n"), "ox", "oy", "oz").alias("r"))
    best = rivals.groupBy(*state, "cx", "cy", "cz").agg(F.min("r").alias("r")).where("cx = r.ox and cy = r.oy and cz = r.oz")
    centers = best.select(*state, F.concat_ws("/", "cx", "cy", "cz").alias("site"), *[((F.col(f"c{c}") + 0.5) * radius).alias(c) for c in xyz])

    def members(now: DataFrame) -> DataFrame:
        """Each point with its nearest centre: points keep their own columns, nothing is joined back by a made-up id."""
        near = now.select(*state, F.col("site"), *[F.col(c).alias(f"s{c}") for c in xyz], *[F.floor(F.col(c) / radius).cast("bigint").alias(f"o{c}") for c in xyz], steps)
        near = near.select(*state, F.struct("site", "sx", "sy", "sz").alias("at"), *[(F.col(f"o{c}") + F.col(f"s.{c}")).alias(f"c{c}") for c in xyz])
        held = near.groupBy(*state, "cx", "cy", "cz").agg(F.collect_list("at").alias("near"))
        gap = lambda a: F.sqrt(reduce(lambda u, v: u + v, [(F.col(c) - a[f"s{c}"]) * (F.col(c) - a[f"s{c}"]) for c in xyz]))
        told = points.select(*state, "frame", *xyz, *cell).join(held, [*state, "cx", "cy", "cz"])
        told = told.withColumn("_b", F.array_min(F.transform("near", lambda a: F.struct(gap(a).alias("d"), a["site"].alias("site")))))
        return told.where(F.col("_b.d") <= radius).select(*state, F.col("_b.site").alias("site"), "frame", *xyz)

    moved = members(centers).groupBy(*state, "site").agg(*[F.avg(c).alias(c) for c in xyz])
    told = members(moved).groupBy(*state, "site").agg(*[F.avg(c).alias(c) for c in xyz], F.count("*").alias("points"), F.count_distinct("frame").alias("frames"), F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsd"))
    told = told.join(F.broadcast(sizes), state) if state else told.crossJoin(F.broadcast(sizes))
    share = F.col("frames") / F.col("_frames")
    good = (share >= least_share) & (F.lit(True) if most_rmsd is None else F.col("rmsd") <= most_rmsd)
    verdict = F.when(F.col("_frames") < least_frames, "not_estimable").when(good, "stable").otherwise("transient")
    return told.select(*state, "site", *xyz, "points", "frames", share.alias("occupancy"), "rmsd", verdict.alias("verdict"))
