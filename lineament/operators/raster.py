"""Raster algebra over cells (r, c, z); a null z is nodata.

Neighbourhoods are stencils: a cell is sent to the targets that see it, and what
arrives is aggregated by target, combined before the shuffle.  From TILED offsets
on, cells travel once, by tiles with a halo, and numpy works on the shifted tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILED, TILE = 50, 256


def disc(radius: float, cell_x: float = 1.0, cell_y: float = 1.0) -> list[tuple[int, int, float]]:
    """(dr, dc, distance) of the offsets of an ellipse of int(radius / cell) cells."""
    ny, nx = int(radius / cell_y), int(radius / cell_x)
    return [(i, j, float(np.hypot(i * cell_y, j * cell_x))) for i in range(-ny, ny + 1) for j in range(-nx, nx + 1) if (i / ny if ny else i) ** 2 + (j / nx if nx else j) ** 2 <= 1]


def square() -> list[tuple[int, int, float]]:
    return [(i, j, float(np.hypot(i, j))) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _offsets(offsets: list[tuple[int, int, float]]) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(d)).alias("d")) for i, j, d in offsets))


def spread(cells: DataFrame, offsets: list[tuple[int, int, float]]) -> DataFrame:
    """(r, c, i, j, d, v): what each target sees at offset (i, j); targets without a cell of their own included."""
    seen = cells.select("r", "c", "z", F.explode(_offsets(offsets)).alias("o"))
    return seen.select((F.col("r") - F.col("o.i")).alias("r"), (F.col("c") - F.col("o.j")).alias("c"), F.col("o.i").alias("i"), F.col("o.j").alias("j"), F.col("o.d").alias("d"), F.col("z").alias("v"))


def focal(cells: DataFrame, offsets: list[tuple[int, int, float]]) -> DataFrame:
    """cells with focal_n, focal_sum, focal_mean and focal_std (population) of what the offsets see; nodata isn't counted."""
    if len(offsets) > TILED:
        return focal_tiled(cells, offsets)
    own = spread(cells, offsets).withColumn("self", (F.col("i") == 0) & (F.col("j") == 0))
    stats = own.groupBy("r", "c").agg(
        F.max("self").alias("here"), F.max(F.when(F.col("self"), F.col("v"))).alias("z"), F.count("v").alias("focal_n"), F.sum("v").alias("focal_sum"), F.avg("v").alias("focal_mean"), F.stddev_pop("v").alias("focal_std")
    )
    return stats.filter("here").drop("here")


def shifted(a: np.ndarray, i: int, j: int, fill: float) -> np.ndarray:
    """a, each cell showing what lies at offset (i, j) from it."""
    out = np.full(a.shape, fill, a.dtype)
    rows, cols = a.shape
    if abs(i) < rows and abs(j) < cols:
        out[max(-i, 0) : rows - max(i, 0), max(-j, 0) : cols - max(j, 0)] = a[max(i, 0) : rows + min(i, 0), max(j, 0) : cols + min(j, 0)]
    return out


def flag_distance(flags: np.ndarray, reach: float) -> np.ndarray:
    """Distance to the nearest flagged cell, in cells; more than reach, or infinite, where none is within reach: along rows first, then across them."""
    at = np.where(flags, np.arange(flags.shape[1], dtype=float), np.nan)
    left = np.arange(flags.shape[1]) - np.fmax.accumulate(np.where(np.isnan(at), -np.inf, at), axis=1)
    right = np.fmin.accumulate(np.where(np.isnan(at), np.inf, at)[:, ::-1], axis=1)[:, ::-1] - np.arange(flags.shape[1])
    row = np.minimum(left, right) ** 2
    best = row
    for i in range(1, int(reach) + 1):
        best = np.minimum(best, np.minimum(shifted(row, i, 0, np.inf), shifted(row, -i, 0, np.inf)) + i * i)
    return np.sqrt(best)


def by_tiles(cells: DataFrame, reach: int, kernel, shape: str, tile: int = TILE) -> DataFrame:
    """kernel(there, columns, r0, c0, core) over tiles with a halo of reach cells: each cell travels to the tiles that see it, most to one.

    there and columns, by name, are grids whose first cell is (r0, c0), nan where
    there is nothing; core is the slice of the tile itself in both directions.
    The kernel gives rows of shape; a task holds one tile.
    """
    span = lambda k: F.sequence(F.floor((F.col(k) - reach) / tile), F.floor((F.col(k) + reach) / tile))
    dealt = cells.withColumn("tr", F.explode(span("r"))).withColumn("tc", F.explode(span("c")))
    names = [c for c in cells.columns if c not in ("r", "c")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf.tr.iloc[0]) * tile - reach, int(pdf.tc.iloc[0]) * tile - reach
        size = tile + 2 * reach
        i, j = (pdf.r - r0).to_numpy(), (pdf.c - c0).to_numpy()
        there = np.zeros((size, size), bool)
        there[i, j] = True
        columns = {}
        for n in names:
            columns[n] = np.full((size, size), np.nan)
            columns[n][i, j] = pdf[n].to_numpy(float, na_value=np.nan)
        return kernel(there, columns, r0, c0, slice(reach, reach + tile))

    return dealt.groupBy("tr", "tc").applyInPandas(run, shape)


def focal_tiled(cells: DataFrame, offsets: list[tuple[int, int, float]], tile: int = TILE) -> DataFrame:
    """focal() by tiles with a halo."""
    reach = max(max(abs(i), abs(j)) for i, j, _ in offsets)
    spots = [(i, j) for i, j, _ in offsets]

    def kernel(there, columns, r0, c0, core) -> pd.DataFrame:
        z = columns["z"]
        full = ~np.isnan(z)
        zero = np.where(full, z, 0.0)
        at = lambda a, di, dj: a[reach + di : reach + di + tile, reach + dj : reach + dj + tile]
        n = sum(at(full, *o).astype(np.int64) for o in spots)
        total = sum(at(zero, *o) for o in spots)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = total / n
            var = sum(np.where(at(full, *o), (at(zero, *o) - mean) ** 2, 0.0) for o in spots) / n
        rr, cc = np.nonzero(there[core, core])
        out = pd.DataFrame({"r": rr + r0 + reach, "c": cc + c0 + reach, "z": z[core, core][rr, cc], "focal_n": n[rr, cc], "focal_sum": np.where(n > 0, total, np.nan)[rr, cc], "focal_mean": mean[rr, cc], "focal_std": np.sqrt(var)[rr, cc]})
        return out.astype(object).where(out.notna(), None)

    return by_tiles(cells.select("r", "c", "z"), reach, kernel, "r long, c long, z double, focal_n long, focal_sum double, focal_mean double, focal_std double", tile)


def canopy(z: Column, threshold: float, strict: bool = True) -> Column:
    """1 where there is canopy, 0 where not, null on nodata."""
    return F.when(z.isNull(), None).otherwise(((z > threshold) if strict else (z >= threshold)).cast("int"))


def smooth_term(cells: DataFrame, reach: float, flag: str = "canopy") -> DataFrame:
    """(r, c, smooth): max(0, reach - distance to the nearest flagged cell) / reach; only cells within reach can count."""
    offsets = [o for o in disc(reach) if o[2] <= reach]
    flagged = cells.filter(F.col(flag) == 1).select("r", "c", F.lit(1.0).alias("z"))
    if len(offsets) > TILED:
        far = int(reach)

        def kernel(there, columns, r0, c0, core) -> pd.DataFrame:
            d = flag_distance(there, reach)[core, core]
            rr, cc = np.nonzero(d <= reach)
            return pd.DataFrame({"r": rr + r0 + far, "c": cc + c0 + far, "smooth": np.maximum(0.0, reach - d[rr, cc]) / reach})

        return by_tiles(flagged, far, kernel, "r long, c long, smooth double")
    near = spread(flagged, offsets)
    return near.groupBy("r", "c").agg((F.greatest(F.lit(0.0), reach - F.min("d")) / reach).alias("smooth"))


def cost(cells: DataFrame, threshold: float = 1.0, radius: float = 3.0, reach: float = 10.0, avoidance: float = 0.3, exponent: float = 1.5, strict: bool = True) -> DataFrame:
    """(r, c, canopy, cost) of cells with data: the canopy cost surface.

    a = (mean - std) / (mean + std) of the canopy about a cell, 0 where they sum to
    nothing; b = (1 + a) / 2, 0 there too; c mixes b and the smooth term by
    avoidance; the cost is exp(1 on canopy, else c) to the exponent.
    """
    mask = cells.select("r", "c", canopy(F.col("z"), threshold, strict).alias("canopy"))
    stats = focal(mask.select("r", "c", F.col("canopy").cast("double").alias("z")), disc(radius)).filter("z is not null")
    m, s = F.col("focal_mean"), F.col("focal_std")
    b = F.when(m + s > 0, (1 + (m - s) / (m + s)) / 2).otherwise(0.0)
    rows = stats.join(smooth_term(mask, reach), ["r", "c"], "left")
    c = b * (1 - avoidance) + F.coalesce("smooth", F.lit(0.0)) * avoidance
    return rows.select("r", "c", F.col("z").cast("int").alias("canopy"), F.pow(F.exp(F.when(F.col("z") == 1, 1.0).otherwise(c)), exponent).alias("cost"))


def morph(cells: DataFrame, reach: int, widen: bool) -> DataFrame:
    """(r, c, z): grey dilation or erosion over a square of 2 * reach + 1 cells; nodata isn't seen and stays."""
    offsets = [(i, j, 0.0) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    if len(offsets) > TILED:
        pick = np.fmax if widen else np.fmin

        def kernel(there, columns, r0, c0, core) -> pd.DataFrame:
            z = columns["z"]
            for way in ((1, 0), (0, 1)):  # rows, then columns
                z = pick.reduce([shifted(z, way[0] * k, way[1] * k, np.nan) for k in range(-reach, reach + 1)])
            rr, cc = np.nonzero(~np.isnan(columns["z"][core, core]))
            return pd.DataFrame({"r": rr + r0 + reach, "c": cc + c0 + reach, "z": z[core, core][rr, cc]})

        return by_tiles(cells.select("r", "c", "z"), reach, kernel, "r long, c long, z double")
    own = spread(cells, offsets)
    best = F.max("v") if widen else F.min("v")
    seen = own.groupBy("r", "c").agg(best.alias("best"), F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("v"))).alias("z"))
    return seen.filter("z is not null").select("r", "c", F.col("best").alias("z"))


def closed(cells: DataFrame, reach: int) -> DataFrame:
    """Dilation, then erosion; cells as they are for reach 0."""
    return morph(morph(cells, reach, True), reach, False) if reach > 0 else cells.filter("z is not null")


def windows(cells: DataFrame) -> DataFrame:
    """(r, c, z, n): cells with their eight neighbours by position, n['i,j'] as columns v_i_j; missing ones are null."""
    own = spread(cells, square())
    names = {(i, j): f"v{'mzp'[i + 1]}{'mzp'[j + 1]}" for i in (-1, 0, 1) for j in (-1, 0, 1)}
    picks = [F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v"))).alias(n) for (i, j), n in names.items()]
    here = F.max((F.col("i") == 0) & (F.col("j") == 0)).alias("here")
    return own.groupBy("r", "c").agg(here, *picks).filter("here").drop("here").withColumnRenamed("vzz", "z")


def surface_area(cells: DataFrame, cell: float = 1.0) -> DataFrame:
    """(r, c, z, surface, sar): areas of the eight triangles about a cell to its neighbours, and over half a cell.

    A triangle that touches a missing neighbour has no area; flat ground gives
    surface 4 and sar 8 for unit cells inside the raster.
    """
    ring = ["vmm", "vmz", "vmp", "vzp", "vpp", "vpz", "vpm", "vzm"]
    flat = [2**0.5, 1, 2**0.5, 1, 2**0.5, 1, 2**0.5, 1]
    w, z, total = windows(cells).filter("z is not null"), F.col("z"), F.lit(0.0)
    for k in range(8):
        p, q = ring[k], ring[(k + 1) % 8]
        a = F.sqrt((z - F.col(p)) ** 2 + (flat[k] * cell) ** 2)
        b = F.sqrt((z - F.col(q)) ** 2 + (flat[(k + 1) % 8] * cell) ** 2)
        c = F.sqrt((F.col(p) - F.col(q)) ** 2 + cell**2)
        s = (a + b + c) / 2
        total = total + F.coalesce(F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0))), F.lit(0.0))
    return w.select("r", "c", "z", total.alias("surface"), (total / (cell * cell / 2)).alias("sar"))


def ruggedness(cells: DataFrame) -> DataFrame:
    """(r, c, tri): square root of the summed squared differences to the neighbours there are."""
    diff = [F.coalesce((F.col(n) - F.col("z")) ** 2, F.lit(0.0)) for n in ("vmm", "vmz", "vmp", "vzp", "vpp", "vpz", "vpm", "vzm")]
    return windows(cells).filter("z is not null").select("r", "c", F.sqrt(sum(diff[1:], diff[0])).alias("tri"))


def terrain(cells: DataFrame) -> DataFrame:
    """(r, c, slope, roughness, edge) of cells with all eight neighbours: Horn slope in degrees, range, Sobel magnitude."""
    names = ["vmm", "vmz", "vmp", "vzp", "vpp", "vpz", "vpm", "vzm"]
    w = windows(cells).dropna(subset=[*names, "z"])
    v = {n: F.col(n) for n in names}
    gx = (v["vmp"] + 2 * v["vzp"] + v["vpp"]) - (v["vmm"] + 2 * v["vzm"] + v["vpm"])
    gy = (v["vpm"] + 2 * v["vpz"] + v["vpp"]) - (v["vmm"] + 2 * v["vmz"] + v["vmp"])
    every = [*v.values(), F.col("z")]
    return w.select("r", "c", "z", F.degrees(F.atan(F.sqrt((gx / 8) ** 2 + (gy / 8) ** 2))).alias("slope"), (F.greatest(*every) - F.least(*every)).alias("roughness"), F.sqrt(gx * gx + gy * gy).alias("edge"))
