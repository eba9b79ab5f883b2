"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut in halves, and each half has a codebook of its own; a cell of the product grid is a pair of
centroids. A vector visits cells in the order of the multi-sequence traversal, nearest first: a half's distance to the
members of a centroid is at least its distance to the plane half way between that centroid and its own, and the squares
of both halves add up. A target recall of 1 goes on until no further cell can hold a link. A lower target ends the traversal
at the distance within which that share of some query vectors, compared with all rows and weighing the same whatever the
number of their links, has all its links. Vectors of visited cells are verified in tiles by exact cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byline.llm.components import components
from byline.llm.staging import staged

TILE, TILES, LARGEST = 1024, 12, 65_536  # rows of a tile's side: a TILES-th of the vectors, within these bounds
STEP = 1 << 22  # products of a tile that are looked at together
ROUND = 1e-9  # room for rounding in bounds


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, which rows are usable) of a list column; usable ones have ``width`` components."""
    usable = np.zeros(len(column), bool)
    rows = column.to_pylist()
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        if x is None or len(x) != width or width == 0 or None in x:
            continue
        v = np.array(x, np.float64)
        if np.isfinite(v).all() and (peak := np.abs(v).max()) > 0:
            v = v / peak  # no square overflows
            out[i], usable[i] = v / np.sqrt(v @ v), True
    return out, usable


def _unit(width: int):
    """Usable vectors at unit length, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, usable = unit_rows(batch.column("embedding"), width)
            at = np.flatnonzero(usable)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array([x[i].tobytes() for i in at], pa.binary())], ["id", "unit"])
    return run


def _matrix(column) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1) if parts else np.zeros((0, 0))


def codebook(x: np.ndarray, size: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a sample by k-means from distant starts."""
    draw = np.random.default_rng(seed)
    centres = x[[int(draw.integers(len(x)))]]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(size, len(x)) and far.max() > 1e-12:
        new = x[int(draw.choice(len(x), p=far / far.sum()))]
        centres = np.vstack([centres, new])
        far = np.minimum(far, ((x - new) ** 2).sum(1))
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(1), 0))


def visited(near1: np.ndarray, near2: np.ndarray, room: float) -> list[tuple[int, int]]:
    """The cells that one vector visits, nearest first, by multi-sequence traversal of both halves' sorted distances.

    ``near1``, ``near2``: least squared distances of its halves to the members of each centroid; the walk ends beyond ``room``.
    """
    first, second = np.argsort(near1, kind="stable").tolist(), np.argsort(near2, kind="stable").tolist()
    a, b = near1.tolist(), near2.tolist()
    out, queue = [], [(a[first[0]] + b[second[0]], 0, 0)]
    while queue:
        far, i, j = heappop(queue)
        if far > room:
            break
        out.append((first[i], second[j]))
        if j + 1 < len(second):
            heappush(queue, (a[first[i]] + b[second[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heappush(queue, (a[first[i + 1]] + b[second[0]], i + 1, 0))
    return out


class Index:
    """Codebooks of both halves, and how far the traversal goes."""

    def __init__(self, books: list[np.ndarray], room: float = 0.0):
        self.books, self.room = books, room
        self.apart = [np.maximum(_distances(b, b), 1e-12) for b in books]

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        cut = self.books[0].shape[1]
        return [_distances(part, book) for part, book in zip((x[:, :cut], x[:, cut:]), self.books, strict=True)]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(x)
        return a.argmin(1), b.argmin(1)

    def nearest(self, x: np.ndarray) -> list[np.ndarray]:
        """Least squared distances of each half to the members of each centroid."""
        out = []
        for d, apart in zip(self.halves(x), self.apart, strict=True):
            own = d.argmin(1)
            plane = (d ** 2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * apart[own])
            out.append(np.maximum(plane - ROUND, 0) ** 2)
        return out


def _assign(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j = it.cells(_matrix(batch.column("unit")))
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("id", "unit", "n")), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))],
                                             ["id", "unit", "n", "i", "j"])
    return run


def _needs(index, queries, cosine: float):
    """How far the traversal of each query must go for all of its links among some rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, q = index.value, queries.value
        near = it.nearest(q)
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column("unit"))
                r, c = np.nonzero(q @ y.T >= cosine)
                i, j = (batch.column(k).to_numpy() for k in ("i", "j"))
                other = ~(q[r] == y[c]).all(1)
                r, c = r[other], c[other]
                need = np.full(len(q), -1.0)
                np.maximum.at(need, r, near[0][r, i[c]] + near[1][r, j[c]])
                at = np.flatnonzero(need >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(need[at])], ["query", "need"])
    return run


def _visits(index):
    """A row for each cell that a vector visits. Of two cells the greater one is asked for links between them once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = index.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                near = it.nearest(_matrix(part.column("unit")))
                own = list(zip(part.column("i").to_pylist(), part.column("j").to_pylist(), strict=True))
                rows, i, j = [], [], []
                for k in range(part.num_rows):
                    for cell in visited(near[0][k], near[1][k], it.room):
                        if cell >= own[k]:
                            rows.append(k)
                            i.append(cell[0])
                            j.append(cell[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(rows, pa.int64())), pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["id", "i", "j"])
    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Which links join components that were apart: n - 1 at most."""
    up, kept = list(range(n)), []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x] = y
            kept.append(k)
    return kept


def _linked(cosine: float):
    """Per tile of asking vectors and members of a cell: link counts of both, and links enough to keep their components."""
    def run(key: tuple[pa.Scalar, ...], asking: pa.Table, members: pa.Table) -> pa.Table:
        ids, others = (np.array(t["id"].to_pylist(), np.int64) for t in (asking, members))
        out_id, out_n, out_to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(ids) and len(others):
            x, y = _matrix(asking["unit"]), _matrix(members["unit"])
            n, m = asking["n"].to_numpy(), members["n"].to_numpy()
            # a vector of the cell itself meets each other one twice, from both sides: the lesser id asks
            own = np.asarray(asking["home"].to_pylist(), bool)
            nodes, at = np.unique(np.concatenate([ids, others]), return_inverse=True)
            got, back = np.zeros(len(ids), np.int64), np.zeros(len(others), np.int64)
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)  # links that keep the components so far
            step = max(1, STEP // len(others))
            for first in range(0, len(ids), step):
                rows = slice(first, first + step)
                hit = x[rows] @ y.T >= cosine
                hit &= ~own[rows, None] | (ids[rows, None] < others[None, :])
                r, c = np.nonzero(hit)
                r += first
                np.add.at(got, r, m[c])
                np.add.at(back, c, n[r])
                a, b = np.concatenate([a, at[r]]), np.concatenate([b, at[len(ids) + c]])
                if len(a) > len(nodes):
                    keep = _forest(a, b, len(nodes))
                    a, b = a[keep], b[keep]
            keep = _forest(a, b, len(nodes))
            for who, count, to in ((ids[got > 0], got[got > 0], None), (others[back > 0], back[back > 0], None), (nodes[a[keep]], np.zeros(len(keep)), nodes[b[keep]])):
                out_id.append(who)
                out_n.append(count.astype(np.int64))
                out_to.append(who if to is None else to)
        return pa.table({"id": np.concatenate(out_id), "n": np.concatenate(out_n), "to": np.concatenate(out_to)})
    return run


def enough(needs: list[float], target: float) -> float | None:
    """The distance within which a share ``target`` of the queries has all its links; None if too few queries have any to tell."""
    return None if len(needs) * (1 - target) < 1 else sorted(needs)[math.ceil(target * len(needs)) - 1]


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, target_recall: float = 0.998, sample: int = 20_000, queries: int = 512,
                    cell_rows: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``.

    Two vectors link when their cosine is at least ``cosine``. Null and zero vectors, vectors with null or non-finite components,
    and vectors of another length than most of the table (ties: the longer) link with nothing. ``component_id`` is the least id that links
    reach; the row with that id is kept. Ids are integers and name vectors: of rows that share an id and differ, one
    speaks for all, and repeated rows count as linked vectors of their own. Rows without an id link with nothing.
    Codebooks have as many centroids as give cells of ``cell_rows`` vectors on average (50, or a tile's side for a target of 1, where
    most cells are visited) and are fitted on at most ``sample`` vectors (those with the least hash of their id); all vectors
    are indexed. ``queries`` of the sample are compared with all vectors to find how far the traversal must go for a share
    ``target_recall`` of the vectors that link to have all their links; 1 finds every link, and so does a target that too few
    queries with links can tell. Equal vectors are one point with a
    count, so a vector that a third of the rows repeat is compared once; cells of any size are verified in tiles whose sides grow
    with the vectors (up to LARGEST), so that a vector is sent to about as many tiles whatever their number. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    lengths = rows.where("id is not null and embedding is not null").groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    width = (lengths.agg(F.max(F.struct("n", "length")).alias("most")).first()["most"] or {"length": 0})["length"]
    units = staged(rows.where("id is not null").mapInArrow(_unit(width), "id bigint, unit binary"))
    points = staged(units.groupBy("unit").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    chosen = points.select("id", "unit").orderBy(F.xxhash64("id"), "id").limit(sample).select("unit").toArrow()
    ids = units.select("id", "unit")
    if not chosen.num_rows:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    x = _matrix(chosen["unit"])
    cut = max(1, x.shape[1] // 2)
    total = points.count()
    tile = min(max(TILE, total // TILES), LARGEST)
    cell_rows = cell_rows or (50 if target_recall < 1 else tile)
    centroids = min(max(1, len(x) // 4), max(8 if target_recall < 1 else 2, int(np.sqrt(total / cell_rows))))
    books = [codebook(part, centroids, seed) for seed, part in enumerate((x[:, :cut], x[:, cut:]))]
    index = spark.sparkContext.broadcast(Index(books))
    placed = staged(points.mapInArrow(_assign(index), "id bigint, unit binary, n bigint, i int, j int"))
    room = 2 - 2 * cosine + ROUND
    if target_recall < 1:
        needs = placed.mapInArrow(_needs(index, spark.sparkContext.broadcast(x[:queries]), cosine), "query int, need double")
        reach = enough([r["need"] for r in needs.groupBy("query").agg(F.max("need").alias("need")).collect()], target_recall)  # a row a query at most
        room = room if reach is None else min(room, reach + ROUND)
    index = spark.sparkContext.broadcast(Index(books, room))
    visits = staged(placed.mapInArrow(_visits(index), "id bigint, i int, j int"))
    sizes = placed.groupBy("i", "j").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    asked = visits.groupBy("i", "j").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("asks"))
    tiles = staged(sizes.join(asked, ["i", "j"]))  # a row per cell
    part, ask = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id"), F.col("asks")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    copied = [c.name for c in placed.schema]
    members = (placed.toDF(*copied).join(tiles, ["i", "j"]).withColumn("part", part).withColumn("ask", each("asks"))
               .select("i", "j", "part", "ask", "id", "unit", "n"))
    asking = (visits.join(placed.select("id", F.col("unit").alias("u"), F.col("n").alias("m"), F.col("i").alias("hi"), F.col("j").alias("hj")), "id")
              .withColumnsRenamed({"u": "unit", "m": "n"}).join(tiles.toDF("i", "j", "parts", "asks"), ["i", "j"])
              .withColumn("ask", ask).withColumn("part", each("parts"))
              .select("i", "j", "part", "ask", "id", "unit", "n", ((F.col("hi") == F.col("i")) & (F.col("hj") == F.col("j"))).alias("home")))
    by = ["i", "j", "part", "ask"]
    found = staged(asking.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(_linked(cosine), "id bigint, n bigint, to bigint"))
    counts = staged(found.where("n > 0").groupBy("id").agg(F.sum("n").alias("links")))
    label = components(found.where("n = 0").select(F.col("id").alias("a"), F.col("to").alias("b")))
    # every vector has the links of its point and those to the point's other vectors
    point = staged(points.select("unit", F.col("id").alias("point"), "n"))
    named = staged(ids.join(point, "unit").groupBy("id").agg(F.min(F.struct("point", "n")).alias("p")).select("id", "p.point", "p.n"))
    linked = (named.join(counts.withColumnRenamed("id", "point"), "point", "left").join(label.withColumnRenamed("node", "point"), "point", "left")
              .select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "point").alias("component")))
    usable = rows.select("id").join(staged(linked), "id", "left")
    component = F.coalesce("component", "id")
    return usable.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
