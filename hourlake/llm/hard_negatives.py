"""Hard-negative mining over anchor clusters that share sorted lists, with certified ends.

Vectors are whole numbers (floor of 256 times each component), so scores are exact inner
products. Anchors are clustered by direction: centroids are fitted on a bounded sample of
them (`SAMPLE` rows, chosen by a hash of the id; at most `CLUSTERS` centroids), every anchor
belongs to the nearest one, and a cluster's radius is the largest angle of its anchors.

All rows are kept in tiles of about `TILE` rows, dealt by their own nearest centroid. For a
row i and a cluster c, norm(i) * cos(max(0, angle(i, c) - radius(c))) times the anchor's norm
is an upper bound of every score with an anchor of c. A tile's rows are sorted by it once per
cluster, and all anchors of the cluster walk that list, in steps, until the bound falls below
what the anchor still asks for. The largest bound of each tile and cluster is stored, so
that lists are ended before whole tiles too: such tiles are never sent to that anchor.

An anchor first walks the tiles of its own cluster, which gives it a score that its results
reach at least; that certifies the end of its walk through all other tiles. This is done
once for the positives (the best rows of its label) and once for the negatives, whose window
of scores the positives fix. Only results travel: a few rows an anchor, window and tile.
Anchors are dealt to tiles by a shuffle, never broadcast; a task holds one tile, and anchors
stream past it.

Defined results: rows with a null label, a null vector, or a null or non-finite component
take no part; missing components of a shorter vector count as 0; a row with a null vec_id is
no anchor and no label is shifted for it, it comes last among equal scores; repeated rows
stand for themselves (an anchor's own row is no positive of it, a repetition is); a positive
below 0 has no negatives; an empty table or one without anchors gives an empty result. Other
columns of the caller are not read. Scores must fit 64 bits.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourlake.llm.common import drop_folder, folder, stored

#: Positives and negatives returned, rows a tile, anchors a cluster, most clusters, and anchors that centroids are fitted on.
POSITIVES, NEGATIVES, TILE, MEMBERS, CLUSTERS, SAMPLE = 5, 5, 2048, 32, 1024, 10_000
STEP, TURNS, SLACK = 512, 6, 1e-6
LOW, HIGH = -(1 << 62), 1 << 62


def take_part(rows: DataFrame) -> DataFrame:
    """place, vec_id, label, embedding (double) of the rows that take part."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return (
        rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), x.alias("x"))
        .where(F.col("label").isNotNull() & F.col("x").isNotNull())
        .where(sound)
        .withColumn("x", F.transform("x", lambda v: F.floor(v * 256).cast("double")))
    )


def _packed(rows: DataFrame, dim: int, kind: str) -> DataFrame:
    """vec_id, label and v (the whole numbers as bytes, short vectors filled with 0)."""

    def run(batches):
        for batch in batches:
            x = batch.column("x")
            n = x.value_lengths().to_numpy()
            values = x.flatten().to_numpy()
            full = np.zeros((batch.num_rows, dim), kind)
            full[np.repeat(np.arange(batch.num_rows), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), binary(full)], ["vec_id", "label", "v"])

    return rows.mapInArrow(run, "vec_id long, label int, v binary")


def binary(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms); a zero vector stays zero."""
    norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """k unit vectors by spherical k-means; equal input gives equal centroids."""
    unit, _ = directions(sample)
    centre = unit[np.random.default_rng(11).permutation(len(unit))[:k]].copy()
    for _ in range(TURNS):
        near = (unit @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, unit)
        held = np.flatnonzero(np.abs(total).sum(axis=1) > 0)
        centre[held] = directions(total[held])[0]
    return centre


def angles(unit: np.ndarray, norm: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The angle of every row with every centroid; a zero vector has 0 with all."""
    return np.where(norm[:, None] > 0, np.arccos(np.clip(unit @ centre.T, -1, 1)), 0.0)


def bounds(angle: np.ndarray, norm: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """At least the score of a row with any unit vector within the radius of a centroid."""
    return norm[:, None] * (np.cos(np.maximum(0, angle - radius - SLACK)) + SLACK)


def _homes(rows: DataFrame, centre: np.ndarray, dim: int, kind: str) -> DataFrame:
    """The rows with their nearest centroid and the angle to it."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                unit, norm = directions(matrix(batch.column("v"), dim, kind))
                angle = angles(unit, norm, centre)
                home = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(home.astype(np.int32)), pa.array(angle[np.arange(len(home)), home])], [*batch.schema.names, "home", "angle"]
                )

    return rows.mapInArrow(run, "place long, vec_id long, label int, v binary, home int, angle double")


def _reach(rows: DataFrame, centre: np.ndarray, radius: np.ndarray, dim: int, kind: str) -> DataFrame:
    """tile, cluster and the largest bound of the tile's rows."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                unit, norm = directions(matrix(batch.column("v"), dim, kind))
                bound = bounds(angles(unit, norm, centre), norm, radius)
                tile = batch.column("tile").to_numpy()
                for t in np.unique(tile):
                    top = bound[tile == t].max(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), t)), pa.array(np.arange(len(top), dtype=np.int32)), pa.array(top)], ["tile", "cluster", "bound"])

    return rows.select("tile", "v").mapInArrow(run, "tile long, cluster int, bound double").groupBy("tile", "cluster").agg(F.max("bound").alias("bound"))


class Tile:
    """Rows of one tile; their order by bound is found once for each cluster."""

    def __init__(self, x: np.ndarray, ids, missing, labels, places, centre: np.ndarray, radius: np.ndarray, exact: bool):
        self.x = x.astype(np.float64) if exact else x.astype(np.int64)
        self.ids, self.missing, self.labels, self.places, self.radius = ids, missing, labels, places, radius
        unit, self.norm = directions(x)
        self.angle, self.lists = angles(unit, self.norm, centre), {}

    def sorted_for(self, cluster: int) -> tuple[np.ndarray, np.ndarray]:
        if cluster not in self.lists:
            bound = bounds(self.angle[:, [cluster]], self.norm, self.radius[[cluster]])[:, 0]
            order = np.argsort(-bound, kind="stable")
            self.lists = {cluster: (order, bound[order])}  # anchors come cluster by cluster
        return self.lists[cluster]

    def walk(self, cluster: int, v: np.ndarray, places: np.ndarray, labels: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int):
        """(anchor, window, row, score) of the k best rows of each anchor's windows low <= score <= high (one column a window)."""
        order, bound = self.sorted_for(cluster)
        v = v.astype(self.x.dtype)
        norm = np.sqrt((v.astype(float) ** 2).sum(axis=1))
        low, windows = low.copy(), low.shape[1]
        slot, row, points = (np.empty(0, np.int64) for _ in range(3))  # slot: anchor * windows + window
        for start in range(0, len(order), STEP):
            live = np.flatnonzero(norm * bound[start] >= low.min(axis=1))
            if not len(live):
                break
            rows = order[start : start + STEP]
            score = v[live] @ self.x[rows].T
            fits = (labels[live][:, None] == self.labels[rows][None, :]) == same
            fits &= (score >= low[live].min(axis=1)[:, None]) & (score <= high[live].max(axis=1)[:, None])
            fits &= places[live][:, None] != self.places[rows][None, :]
            a, r = np.nonzero(fits)
            s = score[a, r].astype(np.int64)
            a, r = live[a], rows[r]
            on = (s[:, None] >= low[a]) & (s[:, None] <= high[a])
            hit, w = np.nonzero(on)
            slot, row, points = (np.concatenate(x) for x in ((slot, a[hit] * windows + w), (row, r[hit]), (points, s[hit])))
            sort = np.lexsort((self.ids[row], self.missing[row], -points, slot))
            slot, row, points = slot[sort], row[sort], points[sort]
            nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
            last = nth == k - 1
            keep = nth < k
            flat = low.reshape(-1)
            flat[slot[last]] = np.maximum(flat[slot[last]], points[last])
            slot, row, points = slot[keep], row[keep], points[keep]
        return slot // windows, slot % windows, row, points


def _walked(tiles: DataFrame, anchors: DataFrame, same: bool, k: int, centre: np.ndarray, radius: np.ndarray, dim: int, kind: str, exact: bool) -> DataFrame:
    """anchor (place), window, place, vec_id, score: each tile's k best rows for the windows of the anchors sent to it.

    tiles: tile, place, vec_id, label, v. anchors: tile, place, label, v, home, low and high (arrays).
    """
    columns = ["tile", "cluster", "place", "vec_id", "label", "v", "low", "high"]
    nothing = F.lit(None).cast("array<bigint>")
    rows = tiles.withColumns({"cluster": F.lit(-1), "low": nothing, "high": nothing}).select(columns)
    walkers = anchors.withColumns({"cluster": F.col("home"), "vec_id": F.lit(None).cast("long")}).select(columns)

    def run(batches):
        tile, parts, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, clusters = batch.column("tile").to_numpy(), batch.column("cluster").to_numpy()
            cuts = np.flatnonzero(np.diff(numbers) | np.diff(clusters)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if numbers[a] != tile:
                    tile, parts, held = numbers[a], [], None
                if clusters[a] < 0:
                    parts.append(part)
                    continue
                if held is None:
                    rows = pa.Table.from_batches(parts).combine_chunks()
                    held = Tile(
                        np.concatenate([matrix(p.column("v"), dim, kind) for p in parts]), rows.column("vec_id").fill_null(0).to_numpy(),
                        rows.column("vec_id").is_null().to_numpy(), rows.column("label").to_numpy(), rows.column("place").to_numpy(), centre, radius, exact,
                    )
                    parts = []
                for c in range(0, part.num_rows, 256):
                    some = part.slice(c, 256)
                    place = some.column("place").to_numpy()
                    low, high = (ragged(some.column(x), fill) for x, fill in (("low", HIGH), ("high", LOW)))
                    anchor, window, row, score = held.walk(int(clusters[a]), matrix(some.column("v"), dim, kind), place, some.column("label").to_numpy(), same, low, high, k)
                    if len(row):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(place[anchor]), pa.array(window.astype(np.int32)), pa.array(held.places[row]), pa.array(held.ids[row], mask=held.missing[row]), pa.array(score)],
                            ["anchor", "slot", "place", "vec_id", "score"],
                        )

    # a tile's rows come before its anchors, which come cluster by cluster; only tiles with anchors are sent
    asked = rows.join(walkers.select("tile").distinct(), "tile", "left_semi")
    dealt = asked.unionByName(walkers).repartition("tile").sortWithinPartitions("tile", "cluster")
    return dealt.mapInArrow(run, "anchor long, slot int, place long, vec_id long, score long")


def ragged(lists: pa.Array, fill: int) -> np.ndarray:
    """Lists as rows of equal length; an unused window is one that no score fits."""
    n = lists.value_lengths().to_numpy()
    out = np.full((len(n), max(1, int(n.max()))), fill, np.int64)
    values = lists.flatten().to_numpy()
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor's window, ranked."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, tile: int = TILE, members: int = MEMBERS, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, embedding. `is_anchor` is a Column over vec_id. A negative's score is
    at most the positive's and at least `least` (numerator, denominator) of it.
    """
    spark = rows.sparkSession
    at = folder(spark, "negatives")
    sound = take_part(rows)
    dim, most = sound.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    dim, most = dim or 1, most or 0.0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    exact = most * most * dim < 1 << 53  # sums of products are whole numbers that doubles hold
    packed = stored(_packed(sound, dim, kind).withColumn("place", F.monotonically_increasing_id()).select("place", "vec_id", "label", "v"), f"{at}/packed")
    chosen = packed.where(F.coalesce(is_anchor, F.lit(False)))
    n_anchors = chosen.count()
    sample = chosen.orderBy(F.xxhash64("vec_id"), "place").limit(SAMPLE).select("v").toArrow().combine_chunks()
    sampled = matrix(sample.column("v").combine_chunks(), dim, kind) if n_anchors else np.zeros((1, dim), kind)
    centre = centroids(sampled, max(1, min(CLUSTERS, math.ceil(n_anchors / members), len(sampled))))
    homed = stored(_homes(packed, centre, dim, kind), f"{at}/homed")
    chosen = homed.where(F.coalesce(is_anchor, F.lit(False))).drop("vec_id")
    radius = np.zeros(len(centre))
    # one row a centroid, of which there are CLUSTERS at most
    for r in chosen.groupBy("home").agg(F.max("angle").alias("angle")).collect():
        radius[r.home] = r.angle
    counts = homed.groupBy("home").count().select("home", F.ceil(F.col("count") / tile).alias("parts"))
    dealt = homed.join(F.broadcast(counts), "home").withColumn("tile", F.col("home").cast("long") * (1 << 40) + F.pmod(F.xxhash64("place"), "parts"))
    tiles = stored(dealt.select("tile", "home", "place", "vec_id", "label", "v"), f"{at}/tiles")
    reach = stored(_reach(tiles, centre, radius, dim, kind), f"{at}/reach")
    own = (F.shiftright("tile", 40).cast("int") == F.col("cluster")).alias("own")
    reach = reach.select("tile", "cluster", "bound", own)
    norm = stored(_norms(chosen.select("place", "v"), dim, kind), f"{at}/norms")
    chosen = stored(chosen.join(norm, "place"), f"{at}/anchors")

    def both(windows: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """Walk the own tiles, then all others that can hold something better."""
        walk = lambda a: _walked(tiles.drop("home"), a, same, k, centre, radius, dim, kind, exact)
        near = reach.where("own").select("tile", "cluster")
        first = stored(walk(windows.join(near, F.col("home") == F.col("cluster")).drop("cluster")), f"{at}/{name}-own")
        reached = _best(first, k).where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("reached"))
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("reached", i), x)))
        certified = windows.join(reached, windows.place == reached.anchor, "left").drop("anchor")
        certified = certified.withColumn("low", F.when(F.col("reached").isNull(), F.col("low")).otherwise(raised)).drop("reached")
        far = reach.where("NOT own").select("tile", "cluster", "bound")
        open_ = certified.join(far, (F.col("home") == F.col("cluster")) & (F.col("norm") * F.col("bound") >= F.array_min("low"))).drop("cluster", "bound")
        rest = stored(walk(open_), f"{at}/{name}-rest")
        return _best(first.unionByName(rest), k)

    everything = lambda x: F.array(F.lit(x).cast("long"))
    good = stored(both(chosen.withColumns({"low": everything(LOW), "high": everything(HIGH)}), True, positives, "positives"), f"{at}/positives")
    num, den = least
    least_score = f"{num} * (score div {den}) + ({num} * (score % {den}) + {den - 1}) div {den}"
    windows = good.where("score >= 0").withColumn("least", F.expr(least_score)).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "least", "score"))).alias("w"))
    asked = chosen.join(windows, chosen.place == windows.anchor).withColumns({"low": F.col("w.least"), "high": F.col("w.score")}).drop("w", "anchor")
    bad = both(asked, False, negatives, "negatives").select("anchor", (F.col("slot") + 1).alias("nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = homed.where(F.coalesce(is_anchor, F.lit(False))).select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = good.select("anchor", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, "anchor")
    out = stored(pairs.join(bad, ["anchor", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), f"{at}/out")
    for step in ("packed", "homed", "tiles", "reach", "norms", "anchors", "positives", *[f"{n}-{p}" for n in ("positives", "negatives") for p in ("own", "rest")]):
        drop_folder(spark, f"{at}/{step}")
    return out


def _norms(rows: DataFrame, dim: int, kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(directions(matrix(batch.column("v"), dim, kind))[1])], ["place", "norm"])

    return rows.mapInArrow(run, "place long, norm double")


#: The contract in SQL, over `embeddings`.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) for x in embedding] AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5
"""
