"""Label algebra: dense relabelling, small-instance removal, ids across classes, connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.plans.graph import connected_components
from lamella.plans.rank import numbered, numbered_within
from lamella.session import cut

#: Side of the blocks in which components are found locally, by dimensions (a block holds 65,536 or 32,768 places).
BLOCK = {2: 256, 3: 32}


def label_table(rows: DataFrame, label: str = "label", by: list[str] | None = None, start: int = 1) -> DataFrame:
    """(by, label, new) for the positive labels: new counts from start in ascending order."""
    distinct = rows.where(F.col(label) > 0).select(*(by or []), label).distinct()
    return numbered_within(distinct, by or [], [label], "new").withColumn("new", (F.col("new") + start).cast("long"))


def relabel_sequential(rows: DataFrame, label: str = "label", start: int = 1, by: list[str] | None = None) -> DataFrame:
    """Positive labels become start, start + 1, ... by ascending label, others 0. The rank is taken on the distinct labels."""
    keys = [*(by or []), label]
    mapped = rows.join(label_table(rows, label, by, start), keys, "left")
    return mapped.withColumn(label, F.coalesce("new", F.lit(0)).cast("long")).drop("new").select(*rows.columns)


def drop_small(rows: DataFrame, least: int, label: str = "label", by: list[str] | None = None, compact: bool = False) -> DataFrame:
    """Labels with fewer than `least` voxels become 0; compact relabels the rest."""
    keys = [*(by or []), label]
    small = rows.groupBy(*keys).count().where(F.col("count") < least).select(*keys, F.lit(True).alias("_small"))
    out = rows.join(small, keys, "left").withColumn(label, F.when(F.col("_small"), 0).otherwise(F.col(label)).cast("long")).select(*rows.columns)
    return relabel_sequential(out, label, by=by) if compact else out


def final_ids(rows: DataFrame, cls: str, local: str, name: str = "final_id") -> DataFrame:
    """Ids over classes: 1.. by class, then local id; class or local id 0 gives 0."""
    pairs = rows.where((F.col(cls) > 0) & (F.col(local) > 0)).select(cls, local).distinct()
    table = numbered(pairs, [cls, local], name).withColumn(name, (F.col(name) + 1).cast("long"))
    return rows.join(table, [cls, local], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


#: Half of the neighbour offsets (z, y, x) by dimension and connectivity: the other half are their negatives.
def half_offsets(dims: int, connectivity: int) -> list[tuple[int, int, int]]:
    limit = {(2, 4): 1, (2, 8): 2, (3, 6): 1, (3, 18): 2, (3, 26): 3}[(dims, connectivity)]
    span = (-1, 0, 1)
    every = [(z, y, x) for z in (span if dims == 3 else (0,)) for y in span for x in span]
    return [o for o in every if 0 < sum(map(abs, o)) <= limit and o > (0, 0, 0)]


def local_roots(places: np.ndarray, labels: np.ndarray, ids: np.ndarray, offsets: list[tuple[int, int, int]]) -> np.ndarray:
    """For each voxel of a block the least id in its component of equal labels."""
    order = np.argsort(ids, kind="stable")
    low = places.min(0) - 1
    size = places.max(0) - low + 2
    step = np.array([size[1] * size[2], size[2], 1])
    name = np.unique(labels, return_inverse=True)[1].ravel()
    key = (name * int(size.prod()) + (places - low) @ step)[order]
    # Distinct places in the order of their keys; each stands for its voxel with the least id.
    spots, first, spot = np.unique(key, return_index=True, return_inverse=True)
    a, b = [], []
    for offset in offsets:
        to = spots + int(np.dot(offset, step))
        at = np.minimum(np.searchsorted(spots, to), len(spots) - 1)
        hit = np.flatnonzero(spots[at] == to)
        a.append(hit)
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = first.copy()  # places in id order: the least one is the least id
    owner = np.empty(len(ids), np.int64)
    owner[first] = np.arange(len(first))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, owner[root[end]], least)
            np.minimum.at(new, end, least)
        while (new[owner[new]] != new).any():
            new = new[owner[new]]
        if (new == root).all():
            break
        root = new
    out = np.empty_like(ids)
    out[order] = ids[order][root[spot.ravel()]]
    return out


def component_labels(rows: DataFrame, by: list[str], dims: int = 3, connectivity: int | None = None, label: str = "label", lin: str = "lin") -> DataFrame:
    """Connected components of equal positive labels; rows get `component` (0 for background).

    Components count from 1 within each of `by`, by label and then by their first voxel. lin numbers the voxels
    uniquely over all samples. In two dimensions sections are separate. Blocks of at most BLOCK voxels a side find
    their components each for itself; components over blocks are those of the graph of the blocks' components, so
    that its edges grow with the blocks' faces and not with the voxels. Voxels are read twice and each time dealt to their
    blocks; only voxels at faces and one for each local component are written and joined.
    """
    if dims not in (2, 3):
        raise ValueError("spatial_dims must be 2 or 3")
    offsets = half_offsets(dims, connectivity or (4 if dims == 2 else 6))
    axes, side = ("yx" if dims == 2 else "zyx"), BLOCK[dims]
    blocks = {f"_b{a}": F.floor(F.col(a) / side).cast("long") for a in axes} | ({"_bz": F.col("z").cast("long")} if dims == 2 else {})
    of_block = list(dict.fromkeys([*by, *blocks]))
    kept = list(dict.fromkeys([*by, "z", "y", "x", label, lin]))
    placed = rows.select(*kept).withColumns(blocks).withColumns({"_root": F.col(lin), "_edge": F.lit(False)})

    def roots_of(places: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return local_roots(places, labels, ids, offsets) if len(ids) else ids

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        """The voxels that leave a block: those at its faces, and each local component's first one."""
        places = pdf[["z", "y", "x"]].to_numpy(np.int64)
        root = roots_of(places, pdf[label].to_numpy(), pdf[lin].to_numpy())
        at = places[:, -len(axes) :] % side
        edge = ((at == 0) | (at == side - 1)).any(1)
        return pdf.assign(_root=root, _edge=edge)[edge | (root == pdf[lin].to_numpy())]

    border = cut(placed.where(F.col(label) > 0).groupBy(*of_block).applyInPandas(within, placed.schema))
    # Only voxels whose neighbour lies in another block meet, and only their blocks' roots become edges.
    shifts = F.array(*[F.struct(F.lit(z).alias("dz"), F.lit(y).alias("dy"), F.lit(x).alias("dx")) for z, y, x in offsets])

    def leaves(o):
        out = F.lit(False)
        for a in axes:
            out = out | (F.floor((F.col(a) + o[f"d{a}"]) / side) != F.col(f"_b{a}"))
        return out

    keys = list(dict.fromkeys([*by, "z", "y", "x", label]))
    moved = border.where("_edge").withColumn("o", F.explode(F.filter(shifts, leaves))).select(
        *[(F.col(k) + F.col(f"o.d{k}")).cast(placed.schema[k].dataType).alias(k) if k in axes else F.col(k) for k in keys], F.col("_root").alias("src")
    )
    met = border.where("_edge").select(*keys, F.col("_root").alias("dst"))
    parts = connected_components(moved.join(met, keys).select("src", "dst").distinct())
    first = border.where(F.col("_root") == F.col(lin)).select(*dict.fromkeys([*of_block, label]), "_root")
    joined = first.join(parts, first["_root"] == parts["node"], "left").withColumn("root", F.coalesce("component", "_root")).drop("node", "component")
    # One order over all of by, less each one's first place: a sample with very many components is not one task's.
    names = numbered_within(joined.select(*dict.fromkeys([*by, label]), "root").distinct(), by, [label, "root"], "component")
    names = joined.join(names.select(*by, "root", (F.col("component") + 1).alias("component")), [*by, "root"]).select(*of_block, "_root", "component")
    # The voxels go to their blocks once more, where the local components are found again and named.
    whole = rows.withColumns({f"_in{n}": (F.col(n) if n in by else blocks[n]) for n in of_block})
    whole = whole.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(rows.columns)], *[f"_in{n}" for n in of_block])
    at = {c: f"_c{k}" for k, c in enumerate(rows.columns)}
    schema = T.StructType([T.StructField(at[f.name], f.dataType) for f in rows.schema.fields] + [T.StructField("component", T.LongType())])

    def named(left: pa.Table, right: pa.Table) -> pa.Table:
        labels = np.nan_to_num(left[at[label]].to_numpy().astype(float)) > 0
        out = np.zeros(len(labels), np.int64)
        if labels.any():
            own = left.filter(pa.array(labels))
            columns = {c: own[at[c]].to_numpy() for c in ("z", "y", "x", label, lin)}
            root = roots_of(np.stack([columns[c] for c in "zyx"], 1).astype(np.int64), columns[label], columns[lin])
            known = right["_root"].to_numpy()
            order = np.argsort(known, kind="stable")
            out[labels] = right["component"].to_numpy()[order][np.searchsorted(known[order], root)]
        return left.select(list(at.values())).append_column("component", pa.array(out))

    got = whole.groupBy(*[f"_in{n}" for n in of_block]).cogroup(names.groupBy(*of_block)).applyInArrow(named, schema)
    return got.select(*[F.col(n).alias(c) for c, n in at.items()], "component")


def relabel_after_crop(rows: DataFrame, by: list[str], spatial_dims: int = 3, connectivity: int | None = None, label: str = "label") -> DataFrame:
    """label replaced by its connected component."""
    out = component_labels(rows, by, spatial_dims, connectivity, label)
    return out.withColumn(label, F.col("component")).drop("component").select(*rows.columns)
