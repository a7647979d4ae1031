"""Points near other points, and the regions that contain points, by adaptive coverage with cells.

Each distinct place gets a cover of its surroundings (a ring for `pairs_within`), each region one of its polygon
(`containing`): large cells are tried first, cells that lie whole inside are kept as interior, cells outside are dropped,
and only cells on the boundary are cut into smaller ones. Points meet covers in an equi-join on (group, cell). Interior
matches are accepted as they are; boundary matches alone get the exact test.

Cells are squares of about equal size: bands of latitude, each cut into as many cells of longitude as its widest parallel
holds, so covers stay small near the poles. Work is per distinct place; rows of one place and group fold into one node
first, so a place that holds a third of all rows is one node and is expanded only in the result.

Defined results: rows with null, NaN or infinite coordinates, a latitude outside -90..90 or a null group have no
neighbours; longitudes may follow either convention; repeated rows are rows of their own; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrain.functions.exprs import EARTH_RADIUS_KM, finite, haversine_km, lon180
from skygrain.sources.scratch import written

KM_PER_DEGREE = np.pi * EARTH_RADIUS_KM / 180


def _distance(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(a, 1)))


class Grid:
    """Bands of `size` degrees of latitude; a cell of the coarse level has four children, each again four.

    A cell is (level, band, column), counted at its own level; its id packs the three into a long.
    """

    def __init__(self, size: float, levels: int):
        self.size, self.levels, self.bands = size, levels, int(np.ceil(180 / size))
        south, north = -90 + size * np.arange(self.bands), np.minimum(90, -90 + size * (np.arange(self.bands) + 1))
        widest = np.cos(np.radians(np.where(south * north < 0, 0, np.minimum(np.abs(south), np.abs(north)))))
        self.columns = np.maximum(1, np.floor(360 * widest / size)).astype(np.int64)

    def cell(self, lat, lon, level: int):
        """(band, column) at a level."""
        k = 1 << level
        band = np.clip(np.floor((lat + 90) / self.size * k).astype(np.int64), 0, self.bands * k - 1)
        n = self.columns[band >> level] * k
        return band, np.clip(np.floor((lon + 180) / 360 * n).astype(np.int64), 0, n - 1)

    @staticmethod
    def pack(level, band, column):
        return (np.asarray(band, np.int64) * (1 << 32) + np.asarray(column, np.int64)) * 8 + level

    def bounds(self, level: int, band, column):
        """South, north, west, east."""
        k = 1 << level
        n = self.columns[band >> level] * k
        return -90 + self.size / k * band, np.minimum(90, -90 + self.size / k * (band + 1)), column * 360 / n - 180, (column + 1) * 360 / n - 180

    def reach(self, level: int, band, column):
        """Centre, and a radius that covers the cell."""
        south, north, west, east = self.bounds(level, band, column)
        lat, lon = (south + north) / 2, (west + east) / 2
        return lat, lon, np.maximum(_distance(lat, lon, south, west), _distance(lat, lon, north, west)) * (1 + 1e-9) + 1e-6

    def around(self, lat: float, lon: float, km: float):
        """Coarse cells that may touch the disc, as (band, column) arrays."""
        reach = km / KM_PER_DEGREE + 1e-9
        low, high = self.cell(np.array([max(-90.0, lat - reach)]), np.array([0.0]), 0)[0][0], self.cell(np.array([min(90.0, lat + reach)]), np.array([0.0]), 0)[0][0]
        bands, columns = [], []
        for b in range(low, high + 1):
            n = int(self.columns[b])
            edge = min(90.0, max(abs(lat - reach), abs(lat + reach)))
            # Greatest difference of longitude on the disc's rim; at a pole it takes every column.
            x = np.sin(np.radians(reach)) / max(np.cos(np.radians(lat)), 1e-12)
            turn = 180.0 if edge >= 90 or x >= 1 else np.degrees(np.arcsin(x)) + 1e-9
            if 2 * turn >= 360 - 360 / n:
                c = np.arange(n)
            else:
                c = np.arange(int(np.floor((lon - turn + 180) / 360 * n)), int(np.floor((lon + turn + 180) / 360 * n)) + 1)
                c = np.unique(c % n)
            bands.append(np.full(len(c), b))
            columns.append(c)
        return np.concatenate(bands), np.concatenate(columns)

    def ring(self, lat: float, lon: float, least: float, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, interior flags, coarse parent ids) of the cover of all points at `least` to `most` km from a place."""
        band, column = self.around(lat, lon, most)
        parent = self.pack(0, band, column)
        ids, inside, parents = [], [], []
        for level in range(self.levels):
            y, x, r = self.reach(level, band, column)
            d = _distance(lat, lon, y, x)
            touch = (d - r <= most) & (d + r >= least)
            full = touch & (d + r <= most) & (d - r >= least)
            part = touch & ~full
            last = level == self.levels - 1
            for keep, flag in ((full, True), *(((part, False),) if last else ())):
                ids.append(self.pack(level, band[keep], column[keep]))
                inside.append(np.full(keep.sum(), flag))
                parents.append(parent[keep])
            if last:
                break
            band = (2 * band[part][:, None] + np.array([0, 0, 1, 1])).ravel()
            column = (2 * column[part][:, None] + np.array([0, 1, 0, 1])).ravel()
            parent = np.repeat(parent[part], 4)
        return np.concatenate(ids), np.concatenate(inside), np.concatenate(parents)


def _covers(size: float, levels: int, least: float, most: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = Grid(size, levels)
        for pdf in batches:
            lat, lon = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
            own = [grid.pack(k, *grid.cell(lat, lon, k)) for k in range(levels)]
            accept, test = [], []
            for y, x, mine in zip(lat, lon, own[0]):
                ids, inside, parents = grid.ring(y, x, least, most)
                half = parents >= mine  # the other half is the neighbour's own cover
                accept.append(ids[half & inside])
                test.append(ids[half & ~inside])
            yield pd.DataFrame({"lat": lat, "lon": lon, "cells": list(np.column_stack(own)) if len(lat) else [], "accept": accept, "test": test})

    return run


def pairs_within(points: DataFrame, key: str, group: str, lat: str, lon: str, least_km: float, most_km: float, levels: int = 2) -> DataFrame:
    """Pairs of rows of one group whose great-circle distance is `least_km` to `most_km` (left_<key> is the smaller).

    `least_km` must be above 0: rows of one place are no pairs. Columns left_<key>, right_<key>.
    """
    if not 0 < least_km <= most_km:
        raise ValueError("0 < least_km <= most_km")
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    rows = points.filter(finite(y) & finite(x) & y.between(-90, 90) & F.col(group).isNotNull()).select(F.col(key).alias("k"), F.col(group).alias("g"), y.alias("lat"), lon180(x).alias("lon"))
    nodes = written(rows.groupBy("g", "lat", "lon").agg(F.min("k").alias("k"), F.count("*").alias("n")), "nodes")
    # Covers are the numpy work, so places go to all cores, whatever their bytes.
    places = nodes.select("lat", "lon").distinct().repartition(2 * points.sparkSession.sparkContext.defaultParallelism, "lat", "lon")
    covers = places.mapInPandas(_covers(most_km / KM_PER_DEGREE, levels, least_km, most_km), "lat double, lon double, cells array<long>, accept array<long>, test array<long>")
    covers = written(covers, "covers")
    located = nodes.join(covers, ["lat", "lon"])
    left = located.select("g", F.col("k").alias("lk"), F.col("n").alias("ln"), F.col("lat").alias("llat"), F.col("lon").alias("llon"), F.col("cells")[0].alias("lc"), F.explode(F.expr("concat(transform(accept, c -> struct(c as cell, true as inside)), transform(test, c -> struct(c as cell, false as inside)))")).alias("c"))
    left = left.select("g", "lk", "ln", "llat", "llon", "lc", "c.cell", "c.inside")
    right = located.select("g", F.col("k").alias("rk"), F.col("n").alias("rn"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), F.col("cells")[0].alias("rc"), F.explode("cells").alias("cell"))
    near = left.join(right, ["g", "cell"])
    exact = haversine_km(F.col("llat"), F.col("llon"), F.col("rlat"), F.col("rlon"))
    near = near.filter(F.col("inside") | exact.between(least_km, most_km))
    near = near.filter((F.col("lc") != F.col("rc")) | (F.col("lk") < F.col("rk"))).select("lk", "ln", "rk", "rn")
    near = written(near, "near")
    # Only nodes of several rows need their other rows.
    several = rows.join(nodes.filter("n > 1").select("g", "lat", "lon", F.col("k").alias("node")), ["g", "lat", "lon"]).select("node", "k")
    several = written(several, "several")
    for side in ("l", "r"):
        more = several.select(F.col("node").alias(f"{side}k"), F.col("k").alias(f"{side}row"))
        one = near.filter(F.col(f"{side}n") == 1).withColumn(f"{side}row", F.col(f"{side}k"))
        near = one.unionByName(near.filter(F.col(f"{side}n") > 1).join(more, f"{side}k"))
    return near.select(F.least("lrow", "rrow").alias(f"left_{key}"), F.greatest("lrow", "rrow").alias(f"right_{key}"))


def _crossing(south, north, west, east, edges: np.ndarray) -> np.ndarray:
    """Which rectangles an edge (y1, x1, y2, x2) may meet: their boxes overlap and the corners are on both sides of its line."""
    hit = np.zeros(len(south), bool)
    for y1, x1, y2, x2 in edges:
        near = (south <= max(y1, y2)) & (north >= min(y1, y2)) & (west <= max(x1, x2)) & (east >= min(x1, x2)) & ~hit
        if near.any():
            side = [(x2 - x1) * (y[near] - y1) - (y2 - y1) * (x[near] - x1) for y in (south, north) for x in (west, east)]
            hit[near] = (np.min(side, axis=0) <= 0) & (np.max(side, axis=0) >= 0)
    return hit


def _inside(lat: np.ndarray, lon: np.ndarray, edges: np.ndarray) -> np.ndarray:
    odd = np.zeros(len(lat), bool)
    for y1, x1, y2, x2 in edges:
        over = (y1 > lat) != (y2 > lat)
        odd[over] ^= lon[over] < (x2 - x1) * (lat[over] - y1) / (y2 - y1) + x1
    return odd


def polygon_cover(grid: Grid, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell ids, interior flags) of a polygon whose edges may run beyond longitude 180 but span less than a turn."""
    south, north, west, east = edges[:, [0, 2]].min(), edges[:, [0, 2]].max(), edges[:, [1, 3]].min(), edges[:, [1, 3]].max()
    low, high = (int(grid.cell(np.array([v]), np.array([0.0]), 0)[0][0]) for v in (south, north))
    bands, columns = [], []
    for b in range(low, high + 1):
        width = 360 / grid.columns[b]
        c = np.arange(int(np.floor((west + 180) / width)), int(np.floor((east + 180) / width)) + 1)
        bands.append(np.full(len(c), b))
        columns.append(c)
    band, column = np.concatenate(bands), np.concatenate(columns)  # columns count on past 180 degrees
    ids, inside = [], []
    for level in range(grid.levels):
        s, n, w, e = grid.bounds(level, band, column)
        part = _crossing(s, n, w, e, edges)
        full = ~part & _inside((s + n) / 2, (w + e) / 2, edges)
        last = level == grid.levels - 1
        for keep, flag in ((full, True), *(((part, False),) if last else ())):
            turn = grid.columns[band[keep] >> level] << level
            ids.append(grid.pack(level, band[keep], column[keep] % turn))
            inside.append(np.full(keep.sum(), flag))
        band = (2 * band[part][:, None] + np.array([0, 0, 1, 1])).ravel()
        column = (2 * column[part][:, None] + np.array([0, 1, 0, 1])).ravel()
    ids, inside = np.concatenate(ids), np.concatenate(inside)
    one, at = np.unique(ids, return_index=True)
    return one, inside[at]


def containing(points: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region: str, ring: str, size: float = 2.0, levels: int = 5) -> DataFrame:
    """(key, region): the regions that contain each point.

    `ring` is an array of structs (lat, lon): the corners in order, closed by itself; longitudes of one ring may run beyond
    180 so that it can cross the date line, but its corners span less than a turn. Edges are straight in degrees; a point on an edge
    belongs to one side, the same for all. Rings of fewer than three corners contain nothing; null regions and rings are left
    out. A region's cover has cells of `size` degrees, halved up to `levels` - 1 times along its edges.
    """
    grid = Grid(size, levels)
    name, key_name = regions.schema[region].dataType.simpleString(), key
    ends = f"zip_with({ring}, concat(slice({ring}, 2, size({ring}) - 1), slice({ring}, 1, 1)), (a, b) -> struct(double(a.lat) as y1, double(a.lon) as x1, double(b.lat) as y2, double(b.lon) as x2))"
    known = regions.filter(F.col(region).isNotNull() & (F.size(ring) >= 3)).select(F.col(region).alias("region"), F.expr(ends).alias("edges"))
    known = written(known, "regions")

    def covers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, inside = polygon_cover(grid, np.array([[e["y1"], e["x1"], e["y2"], e["x2"]] for e in r.edges], float))
                yield pd.DataFrame({"region": r.region, "cell": ids, "inside": inside})

    cover = written(known.mapInPandas(covers, f"region {name}, cell long, inside boolean"), "region-covers")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y, x = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
            own = np.column_stack([grid.pack(k, *grid.cell(y, x, k)) for k in range(levels)]) if len(pdf) else []
            yield pd.DataFrame({"lat": y, "lon": x, "cells": list(own)})

    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    rows = points.filter(finite(y) & finite(x) & y.between(-90, 90)).select(F.col(key).alias("_key"), y.alias("lat"), lon180(x).alias("lon"))
    # Rows of one place are tested once.
    places = rows.select("lat", "lon").distinct().mapInPandas(cells, "lat double, lon double, cells array<long>")
    met = places.select("lat", "lon", F.explode("cells").alias("cell")).join(cover, "cell")
    at = "aggregate(edges, 0, (n, e) -> n + if((e.y1 > lat) != (e.y2 > lat) and {x} < (e.x2 - e.x1) * (lat - e.y1) / (e.y2 - e.y1) + e.x1, 1, 0)) % 2 = 1"
    tested = met.filter("not inside").select("lat", "lon", "region").distinct().join(known, "region").filter(F.expr(at.format(x="lon")) | F.expr(at.format(x="lon + 360")))
    held = met.filter("inside").select("lat", "lon", "region").distinct().unionByName(tested.select("lat", "lon", "region"))
    return rows.join(held, ["lat", "lon"]).select(F.col("_key").alias(key_name), F.col("region").alias(region))
