"""Point clouds as rows (cloud_id, x, y, z and attributes)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import stats

ID = "cloud_id"
XYZ = ("x", "y", "z")
EDGE = 1e-12


def finite_points(points: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for c in XYZ:
        ok = ok & stats.finite(F.col(c)).isNotNull()
    return points.where(ok)


def finite_fraction(points: DataFrame) -> DataFrame:
    ok = F.lit(1)
    for c in XYZ:
        ok = ok * F.when(stats.finite(F.col(c)).isNotNull(), 1).otherwise(0)
    return points.groupBy(ID).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(ok).alias("finite_fraction"))


def extent(points: DataFrame) -> DataFrame:
    """Counts, extremes, means, deviations, spans, box volume and density, in one aggregation."""
    p = finite_points(points).groupBy(ID).agg(
        F.count(F.lit(1)).alias("n_points"), *[f(c).alias(f"{c}_{n}") for c in XYZ for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    )
    for c in XYZ:
        p = p.withColumn(f"span_{c}", F.col(f"{c}_max") - F.col(f"{c}_min"))
    side = lambda c: F.greatest(F.col(f"span_{c}"), F.lit(EDGE))
    p = p.withColumn("bbox_volume", side("x") * side("y") * side("z"))
    return p.withColumn("density", F.col("n_points") / F.col("bbox_volume"))


def heights(points: DataFrame, at: tuple[int, ...] = (0, 5, 25, 50, 75, 95, 100)) -> DataFrame:
    g = finite_points(points).groupBy(ID).agg(F.avg("z").alias("height_mean"), F.stddev_pop("z").alias("height_std"), F.percentile("z", F.array(*[F.lit(a / 100) for a in at])).alias("q"))
    return g.select(ID, "height_mean", "height_std", *[F.col("q")[i].alias(f"z_p{a}") for i, a in enumerate(at)])


def radial(points: DataFrame) -> DataFrame:
    """(cloud_id, radial_distance_mean, radial_distance_std, outlier_fraction): distances from the centroid; outliers are beyond three deviations."""
    p = finite_points(points)
    c = p.groupBy(ID).agg(*[F.avg(a).alias(f"c{a}") for a in XYZ])
    square = sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in XYZ), F.lit(0.0))
    d = p.join(F.broadcast(c), ID).select(ID, F.sqrt(square).alias("d"))  # one row for each cloud: points stay where they are, as a cloud may hold most of them
    m = d.groupBy(ID).agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("s"))
    return d.join(F.broadcast(m), ID).groupBy(ID).agg(F.first("m").alias("radial_distance_mean"), F.first("s").alias("radial_distance_std"), F.avg(F.when((F.col("s") > 0) & (F.col("d") > F.col("m") + 3 * F.col("s")), 1.0).otherwise(0.0)).alias("outlier_fraction"))


def duplicate_fraction(points: DataFrame, decimals: int = 5) -> DataFrame:
    """(cloud_id, duplicate_fraction): points that equal another one after rounding half to even.  Two steps of hashing, no distinct in one place."""
    p = finite_points(points).groupBy(ID, *[(F.bround(c, decimals) + F.lit(0.0)).alias(c) for c in XYZ]).agg(F.count(F.lit(1)).alias("n"))
    return p.groupBy(ID).agg((1.0 - F.count(F.lit(1)) / F.sum("n")).alias("duplicate_fraction"))


def attributes(points: DataFrame) -> DataFrame:
    """Intensity, and colour in 0-1 where the cloud has r, g and b (divided by 255 or their maximum if above 1, and clipped)."""
    p = finite_points(points)
    i = stats.finite(F.col("intensity"))
    out = p.groupBy(ID).agg(F.avg(i).alias("intensity_mean"), F.stddev_pop(i).alias("intensity_std"))
    if not {"r", "g", "b"} <= set(points.columns):
        return out
    top = p.groupBy(ID).agg(F.max(F.greatest("r", "g", "b")).alias("top"))
    scale = F.when(F.col("top") > 1, F.greatest(F.lit(255.0), F.col("top"))).otherwise(1.0)
    unit = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / scale)))
    rgb = p.join(F.broadcast(top), ID).groupBy(ID).agg(*[f(unit(c)).alias(f"{c}_{n}") for c in "rgb" for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return out.join(rgb, ID)


def covariance(points: DataFrame) -> DataFrame:
    """Sample covariances of x, y and z."""
    return finite_points(points).groupBy(ID).agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])


def shape(points: DataFrame) -> DataFrame:
    """(cloud_id, linearity, planarity, scattering, curvature, normal_entropy) of the covariance's eigenvalues; zeros below three points."""
    kind = dict(points.dtypes)[ID]

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in f.itertuples():
            if r.n < 3:
                out.append((r.cloud_id, 0.0, 0.0, 0.0, 0.0, 0.0))
                continue
            e = np.clip(np.linalg.eigvalsh(np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]]))[::-1], 0, None)
            a, b, c = e + EDGE
            p = e[e > 0] / e.sum() if e.sum() > 0 else np.array([1.0])
            out.append((r.cloud_id, (a - b) / a, (b - c) / a, c / a, c / (a + b + c), float(-(p * np.log(p)).sum())))
        return pd.DataFrame(out, columns=["cloud_id", "linearity", "planarity", "scattering", "curvature", "normal_entropy"])

    schema = f"cloud_id {kind}, linearity double, planarity double, scattering double, curvature double, normal_entropy double"
    return covariance(points).mapInPandas(lambda it: (solve(f) for f in it), schema)


class _Boxes:
    """A balanced tree of boxes over points, each of which holds two of the next level; the last holds up to ``leaf`` points."""

    def __init__(self, q: np.ndarray, leaf: int = 8):
        n = len(q)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        order = np.arange(n)
        for level in range(self.depth):
            starts = (np.arange(1 << level) * n) >> level
            ends = np.append(starts[1:], n)
            at = np.repeat(np.arange(1 << level), ends - starts)
            wide = (np.maximum.reduceat(q[order], starts) - np.minimum.reduceat(q[order], starts)).argmax(axis=1)
            order = order[np.lexsort((q[order, wide[at]], at))]
        self.order, self.q = order, q[order]
        self.starts = (np.arange(1 << self.depth) * n) >> self.depth
        self.sizes = np.append(self.starts[1:], n) - self.starts
        lo, hi = np.minimum.reduceat(self.q, self.starts), np.maximum.reduceat(self.q, self.starts)
        self.levels = [(lo, hi)]
        while len(lo) > 1:
            lo, hi = np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])
            self.levels.insert(0, (lo, hi))

    def _held(self, p: np.ndarray, s: np.ndarray, i: np.ndarray, node: np.ndarray, own: np.ndarray | None) -> None:
        """Lowers s to the squared distances of the points i to those of their leaves."""
        for k in range(int(self.sizes.max())):
            at = self.starts[node] + np.minimum(k, self.sizes[node] - 1)
            d = p[i] - self.q[at]
            d = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
            if own is not None:
                d[at == own[i]] = np.inf
            np.minimum.at(s, i, d)

    def lowered(self, p: np.ndarray, s: np.ndarray, own: np.ndarray | None = None, chunk: int = 1 << 13) -> np.ndarray:
        """Of each of p the least of s and its squared distance to the points (but the one at ``own``)."""
        out = s.astype(np.float64)
        if own is not None:
            place = np.empty(len(self.order), np.int64)
            place[self.order] = np.arange(len(self.order))
            own = place[own]
        for a in range(0, len(p), chunk):
            x, t = p[a : a + chunk], out[a : a + chunk]
            mine = None if own is None else own[a : a + chunk]
            i = np.arange(len(x))
            home = None if mine is None else np.searchsorted(self.starts, mine, "right") - 1
            if mine is not None:
                self._held(x, t, i, home, mine)
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth + 1):
                if level:
                    i, node = np.repeat(i, 2), np.repeat(node * 2, 2)
                    node[1::2] += 1
                lo, hi = self.levels[level]
                gap = np.maximum(0, np.maximum(lo[node] - x[i], x[i] - hi[node]))
                near = (gap * gap).sum(axis=1) < t[i]
                i, node = i[near], node[near]
            if home is not None:
                i, node = i[home[i] != node], node[home[i] != node]
            if len(i):
                self._held(x, t, i, node, mine)
        return out


def _cuts(p: np.ndarray, weight: float, size: int, first: int) -> list[list[float]]:
    """Rows (axis, cut, left, right), or (-1, tile, 0, 0), of a tree whose tiles hold about ``size`` points where each of p stands for ``weight``."""
    tree: list[list[float]] = []

    def grow(q: np.ndarray) -> int:
        nonlocal first
        me = len(tree)
        tree.append([-1.0, float(first), 0.0, 0.0])
        spread = np.ptp(q, axis=0)
        if len(q) * weight > size and len(q) > 1 and spread.max() > 0:
            axis = int(spread.argmax())
            v = np.sort(q[:, axis])
            cut = v[len(v) // 2]
            if cut == v[0]:
                cut = v[np.searchsorted(v, cut, "right")]
            left = grow(q[q[:, axis] < cut])
            tree[me] = [float(axis), float(cut), float(left), float(grow(q[q[:, axis] >= cut]))]
        else:
            first += 1
        return me

    grow(p)
    return tree


def _tree_of_each(points: DataFrame, size: int, sample: int = 100_000) -> tuple[dict, int]:
    """Cuts of the clouds with more than ``size`` places, and the number of tiles.  They are fitted on about ``sample`` places, chosen by hash; all points are then put into their tiles."""
    n = points.count()
    if n <= size:
        return {}, 1
    share = max(1, n // sample)
    some = points.where(F.pmod(F.xxhash64(*XYZ), F.lit(share)) == 0).select(ID, *XYZ).distinct().collect()
    of: dict[object, list] = {}
    for r in some:
        of.setdefault(r[0], []).append(r[1:])
    size, trees, tiles = max(size, len(some) * share // 5000), {}, 1
    for cloud_id, rows in of.items():
        if len(rows) * share > size:
            trees[cloud_id] = np.array(_cuts(np.array(rows, np.float64), share, size, tiles))
            tiles += int((trees[cloud_id][:, 0] < 0).sum())
    return trees, tiles


def _tiled(points: DataFrame, trees: dict) -> DataFrame:
    """(cloud_id, x, y, z, n, tile); tiles of clouds with a tree have numbers of their own, others are tile 0."""

    def put(batches):
        for b in batches:
            xyz = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in XYZ])
            ids = b.column(ID).dictionary_encode(null_encoding="encode")
            which, tile = ids.indices.to_numpy(zero_copy_only=False), np.zeros(b.num_rows, np.int64)
            for k, cloud_id in enumerate(ids.dictionary.to_pylist()):
                tree = trees.get(cloud_id)
                if tree is None:
                    continue
                at = np.flatnonzero(which == k)
                node = np.zeros(len(at), np.int64)
                while True:
                    axis = tree[node, 0].astype(np.int64)
                    go = np.flatnonzero(axis >= 0)
                    if not len(go):
                        break
                    t = tree[node[go]]
                    node[go] = np.where(xyz[at[go], axis[go]] < t[:, 1], t[:, 2], t[:, 3]).astype(np.int64)
                tile[at] = tree[node, 1].astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tile)], names=[*b.schema.names, "tile"])

    if not trees:
        return points.withColumn("tile", F.lit(0).cast("long"))
    return points.mapInArrow(put, f"{points._jdf.schema().toDDL()}, tile long")


def nearest_distances(points: DataFrame, size: int = 1 << 15) -> DataFrame:
    """(cloud_id, zeros, s): in parts, the squared distances (as bytes) of points to the nearest other one of their cloud, exactly; infinite where there is none; ``zeros`` more have a copy.

    Copies are counted and stand for one place.  Places are put into tiles; a single point is first held against its own tile, and
    then against those whose box is nearer than what was found: it is sent there, as one of few near a border.
    """
    p = points.select(ID, *[F.col(c).cast("double").alias(c) for c in XYZ])
    trees, n_tiles = _tree_of_each(p, size)
    kind = dict(points.dtypes)[ID]

    def own(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        q, n = np.ascontiguousarray(f[list(XYZ)].to_numpy(np.float64)), f.n.to_numpy()
        one = np.flatnonzero(n == 1)
        s = _Boxes(q).lowered(q[one], np.full(len(one), np.inf), one) if len(one) else np.zeros(0)
        row = {"cloud_id": key[0], "tile": key[1], "lo": q.min(axis=0).tolist(), "hi": q.max(axis=0).tolist(), "zeros": int(n[n > 1].sum()), "xyz": q.tobytes(), "one": one.astype(np.int32).tobytes(), "s": s.tobytes()}
        return pd.DataFrame({k: pd.Series([v], dtype=object) for k, v in row.items()})

    places = p.groupBy(ID, *XYZ).agg(F.count(F.lit(1)).alias("n"))
    made = _tiled(places, trees).groupBy(ID, "tile").applyInPandas(own, f"cloud_id {kind}, tile long, lo array<double>, hi array<double>, zeros long, xyz binary, one binary, s binary")
    if not trees:
        return made.select(ID, "zeros", "s")
    tiles = made.persist(StorageLevel.DISK_ONLY)
    boxes = tiles.where("tile > 0").select("tile", "lo", "hi").collect()  # of 5,000 tiles at most, and some more for small clouds beside large ones
    lo, hi, there = np.full((n_tiles, 3), np.inf), np.full((n_tiles, 3), -np.inf), np.zeros(n_tiles, bool)
    for r in boxes:
        lo[r.tile], hi[r.tile], there[r.tile] = r.lo, r.hi, True
    same = np.zeros(n_tiles, np.int64)  # the cloud of each tile
    for k, t in enumerate(trees.values()):
        same[t[t[:, 0] < 0, 1].astype(np.int64)] = k + 1

    def sent(frames):
        for f in frames:
            for tile, xyz, one, s in zip(f.tile, f.xyz, f.one, f.s):
                q, s = np.frombuffer(xyz).reshape(-1, 3)[np.frombuffer(one, np.int32)], np.frombuffer(s)
                if not len(q):
                    continue
                a, b = q.min(axis=0), q.max(axis=0)
                gap = np.maximum(0, np.maximum(lo - b, a - hi))
                for other in np.flatnonzero(there & (same == same[tile]) & ((gap * gap).sum(axis=1) < s.max())):
                    if other == tile:
                        continue
                    g = np.maximum(0, np.maximum(lo[other] - q, q - hi[other]))
                    at = np.flatnonzero((g * g).sum(axis=1) < s)
                    if len(at):
                        yield pd.DataFrame({"tile": [other], "home": [tile], "at": [at.astype(np.int32).tobytes()], "p": [q[at].tobytes()], "t": [s[at].tobytes()]})

    def held(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            tree = _Boxes(np.frombuffer(a.xyz.iloc[0]).reshape(-1, 3))
            for home, at, p, t in zip(b.home, b["at"], b.p, b.t):
                t = np.frombuffer(t)
                new = tree.lowered(np.frombuffer(p).reshape(-1, 3), t)
                less = new < t
                if less.any():
                    out.append((home, np.frombuffer(at, np.int32)[less].tobytes(), new[less].tobytes()))
        return pd.DataFrame(out, columns=["tile", "at", "t"])

    def lowered(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        s = np.frombuffer(a.s.iloc[0]).copy()
        for at, t in zip(b["at"], b.t):
            np.minimum.at(s, np.frombuffer(at, np.int32), np.frombuffer(t))
        return pd.DataFrame({"cloud_id": a.cloud_id, "zeros": a.zeros, "s": [s.tobytes()]})

    cut = tiles.where("tile > 0")
    visits = cut.select("tile", "xyz", "one", "s").mapInPandas(sent, "tile long, home long, at binary, p binary, t binary")
    better = cut.select("tile", "xyz").groupBy("tile").cogroup(visits.groupBy("tile")).applyInPandas(held, "tile long, at binary, t binary")
    out = cut.select(ID, "tile", "zeros", "s").groupBy("tile").cogroup(better.groupBy("tile")).applyInPandas(lowered, f"cloud_id {kind}, zeros long, s binary")
    return out.unionByName(tiles.where("tile = 0").select(ID, "zeros", "s"))


def nearest_neighbours(points: DataFrame, sample: int | None = None, order: str = "point_idx", size: int = 1 << 15) -> DataFrame:
    """(cloud_id, nearest_neighbor_mean, _median, _std) among all points of each cloud, or ``sample`` of them; 0 below two points.

    The median is exact: distances are counted by their leading bits, and only those of the middle ones are sorted.
    """
    some = finite_points(points)
    if sample is not None:
        some = stats.sample_per_group(some, ID, order, sample)
    kind = dict(points.dtypes)[ID]
    parts = nearest_distances(some, size).persist(StorageLevel.DISK_ONLY)

    def distances(f: pd.DataFrame):
        for k, (zeros, s) in enumerate(zip(f.zeros, f.s)):
            d = np.sqrt(np.frombuffer(s))
            yield f.iloc[k : k + 1], int(zeros), np.where(np.isinf(d), 0.0, d)

    def measured(frames):
        for f in frames:
            for row, zeros, d in distances(f):
                n = len(d) + zeros
                mean = d.sum() / n
                keys, counts = np.unique(np.append(d.view(np.int64) >> 40, np.zeros(min(1, zeros), np.int64)), return_counts=True)
                counts[0] += max(0, zeros - 1)
                yield pd.DataFrame({"cloud_id": row.cloud_id, "n": [n], "mean": [mean], "m2": [((d - mean) ** 2).sum() + zeros * mean * mean], "keys": [keys.tolist()], "counts": [counts.tolist()]})

    def middle(frames):
        for f in frames:
            for row, zeros, d in distances(f):
                d = np.sort(np.append(d, np.zeros(min(1, zeros))))
                key = d.view(np.int64) >> 40
                v, n = np.unique(d[(key == row.a.iloc[0]) | (key == row.b.iloc[0])], return_counts=True)
                n[v == 0] += max(0, zeros - 1)
                yield pd.DataFrame({"cloud_id": row.cloud_id.repeat(len(v)).array, "d": v, "n": n})

    each = parts.mapInPandas(measured, f"cloud_id {kind}, n long, mean double, m2 double, keys array<long>, counts array<long>").persist(StorageLevel.DISK_ONLY)
    whole = Window.partitionBy(ID)
    moments = each.select(ID, "n", "mean", "m2", (F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)).alias("m"))
    moments = moments.groupBy(ID).agg(F.first("m").alias("nearest_neighbor_mean"), F.sqrt(F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("m")) * (F.col("mean") - F.col("m"))) / F.sum("n")).alias("nearest_neighbor_std"), F.sum("n").alias("all"))

    def at(place: str, below: str, n: str):
        r = F.floor((F.col("all") - 1) / 2) if place == "a" else F.floor(F.col("all") / 2)
        return (F.col(below) <= r) & (r < F.col(below) + F.col(n))

    counts = each.select(ID, F.explode(F.arrays_zip("keys", "counts")).alias("e")).groupBy(ID, F.col("e.keys").alias("key")).agg(F.sum("e.counts").alias("n"))
    counts = counts.select(ID, "key", "n", F.sum("n").over(whole).alias("all"), (F.sum("n").over(whole.orderBy("key")) - F.col("n")).alias("below"))
    ends = counts.groupBy(ID).agg(*[F.max(F.when(at(p, "below", "n"), F.col("key"))).alias(p) for p in "ab"], F.max(F.when(at("a", "below", "n"), F.col("below"))).alias("before"), F.first("all").alias("all")).withColumnRenamed(ID, "__cloud__")
    joined = parts.join(F.broadcast(ends), F.col(ID).eqNullSafe(F.col("__cloud__"))).select(ID, "zeros", "s", "a", "b")
    values = joined.mapInPandas(middle, f"cloud_id {kind}, d double, n long").groupBy(ID, "d").agg(F.sum("n").alias("n")).join(F.broadcast(ends), F.col(ID).eqNullSafe(F.col("__cloud__")))
    values = values.withColumn("low", F.col("before") + F.sum("n").over(whole.orderBy("d")) - F.col("n"))
    median = values.groupBy(F.col(ID).alias("__cloud__")).agg(((F.max(F.when(at("a", "low", "n"), F.col("d"))) + F.max(F.when(at("b", "low", "n"), F.col("d")))) / 2).alias("nearest_neighbor_median"))
    return moments.join(median, F.col(ID).eqNullSafe(F.col("__cloud__"))).select(ID, "nearest_neighbor_mean", "nearest_neighbor_median", "nearest_neighbor_std")


def records(points: DataFrame, order: str = "point_idx", neighbours: bool = True) -> DataFrame:
    """All metrics of each cloud."""
    out = extent(points).join(heights(points), ID).join(radial(points), ID).join(duplicate_fraction(points), ID).join(shape(points), ID).join(finite_fraction(points), ID)
    if "intensity" in points.columns:
        out = out.join(attributes(points), ID)
    return out.join(nearest_neighbours(points, order=order), ID) if neighbours else out


DISTANCE_METRICS = ["n_points", "span_x", "span_y", "span_z", "bbox_volume", "density", "height_mean", "height_std", "nearest_neighbor_mean", "duplicate_fraction", "outlier_fraction", "linearity", "planarity", "scattering", "curvature"]


def xy_density(points: DataFrame, bins: int = 80) -> DataFrame:
    """(cloud_id, bx, by, count) on a square grid over each cloud's box."""
    p = finite_points(points)
    e = p.groupBy(ID).agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("a", F.min), ("b", F.max))])

    def at(c: str):
        width = (F.col(f"{c}_b") - F.col(f"{c}_a")) / bins
        return F.when(width == 0, F.lit(bins // 2)).otherwise(F.least(F.floor(F.try_divide(F.col(c) - F.col(f"{c}_a"), width)), F.lit(bins - 1))).cast("int").alias(f"b{c}")

    return p.join(F.broadcast(e), ID).groupBy(ID, at("x"), at("y")).agg(F.count(F.lit(1)).alias("count"))


def height_histogram(points: DataFrame, bins: int = 40) -> DataFrame:
    """(cloud_id, bin, lo, hi, count, density)."""
    h = stats.histogram(finite_points(points), "z", bins, [ID])
    n = h.groupBy(ID).agg(F.sum("count").alias("n"))
    return h.join(n, ID).select(ID, "bin", "lo", "hi", "count", (F.col("count") / F.col("n") / (F.col("hi") - F.col("lo"))).alias("density"))


def dimensions(points: DataFrame) -> DataFrame:
    """(cloud_id, n_dims, has_intensity, has_color): what a point holds beside x, y and z; a fourth number is the intensity, six or more hold colours."""
    extra = F.lit(0)
    for c in ("intensity", "r", "g", "b"):
        if c in points.columns:
            extra = extra + F.when(F.count(c) > 0, 1).otherwise(0)
    g = points.groupBy(ID).agg((extra + 3).cast("int").alias("n_dims"))
    return g.select(ID, "n_dims", (F.col("n_dims") >= 4).alias("has_intensity"), (F.col("n_dims") >= 6).alias("has_color"))
