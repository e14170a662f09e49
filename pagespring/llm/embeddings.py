"""Embedding near-dedup: spherical k-means cells, blocked cosine products.

Vectors that are equal (same label) are one class with a weight, told apart by their
content alone.  Spherical k-means, fitted for each vector length on a bounded sample
(about SAMPLE vectors, or 8 a cell, and SAMPLE_BYTES at most), assigns every class to the cell of the centroid with the
largest dot product; the number of cells follows the largest label (one for CELL classes,
two at least), and above FLAT cells they are two levels deep, so that a vector meets the
square root of their number.  A pair at cosine >= t is at most ``r = sqrt(2 - 2t)`` apart
on the unit sphere, so a vector can only have partners in another cell j if its distance
to the bisecting plane, ``x.(c_i - c_j) / |c_i - c_j|``, is at most r; to such cells it
goes as a guest (only to j above its own, so that a pair meets once).  No pair is lost for
any centroids.

A cell's own rows are blocks of about BLOCK rows.  A task holds one block, compares it
with itself and with the guests that stream past it: those of other cells, and the rows of
half of the cell's other blocks.  So a row is copied once for each cell it visits and every
second block of its own, never for each pair; a block with more than STREAM guests has
several tasks.  The products are in double precision; they give each vector's number of
links and a spanning set of links, never all pairs.

The centroids' broadcast holds CENTROID_BYTES at most: with more cells than that they grow,
and where there are too many vector lengths those of the fewest rows have one cell.  Both
cost time, not links.

Defined results: null, empty or zero vectors, vectors with null or non-finite
components and rows with a null label link with nothing; vectors of different lengths
never link; a null vec_id links with nothing and is kept; rows that share a vec_id
and vector count as other vectors to each other, and rows that share a vec_id only are
vectors of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .graph import components

THRESHOLD = 0.98
SAMPLE = 20_000
CELL = 2048
FLAT = 64
BLOCK = 4096
BLOCK_NUMBERS = 1 << 19  # of a block's vectors, where they are long
GUESTS = 1024
STREAM = 1 << 17
CENTROID_BYTES = 64 << 20
SAMPLE_BYTES = 128 << 20


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centroid of the largest dot product, and that product; GUESTS rows at a time."""
    cell, best = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), GUESTS):
        dots = x[at : at + GUESTS] @ c.T
        cell[at : at + GUESTS], best[at : at + GUESTS] = dots.argmax(1), dots.max(1)
    return cell, best


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k unit centroids for unit rows; a cell left empty takes the row served worst."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        cell, best = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        norms = np.linalg.norm(sums, axis=1)
        worst = np.argsort(best)
        for n, j in enumerate(np.flatnonzero(norms < 1e-12)):
            sums[j], norms[j] = x[worst[n]], 1.0
        c = sums / norms[:, None]
    return c


def with_validity(rows: DataFrame) -> DataFrame:
    """vec_id, label, e (double components) and ok: can the row link?"""
    e = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    r = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", e.alias("e"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("e", lambda x: x != 0)
    return r.withColumn("ok", F.coalesce(ok, F.lit(False)))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def two_level(x: np.ndarray, k: int) -> list[np.ndarray]:
    """About k centroids for unit rows, as an array for each top cell; one top cell if k is small."""
    k = max(1, min(k, len(x)))
    if k <= FLAT:
        return [spherical_kmeans(x, k)]
    top = spherical_kmeans(x, int(np.ceil(np.sqrt(k))))
    home = nearest(x, top)[0]
    out = []
    for j in range(len(top)):
        own = x[home == j]
        n = max(1, min(len(own), round(k * len(own) / len(x))))
        out.append(spherical_kmeans(own, n) if len(own) else top[j : j + 1])
    return [top, *out]


def fitted(distinct: DataFrame) -> dict[int, list[np.ndarray]]:
    """The centroids for each vector length, as many lengths as the broadcast may hold."""
    sizes = distinct.groupBy(F.size("e").alias("dims"), "label").count().groupBy("dims").agg(F.max("count").alias("largest"), F.sum("count").alias("rows"))
    cells = F.greatest(F.lit(2), F.least(F.ceil(F.col("largest") / CELL), F.floor(F.lit(CENTROID_BYTES) / (F.col("dims") * 8))))
    wanted = F.least(F.greatest(F.lit(SAMPLE), F.col("cells") * 8), F.greatest(F.lit(2), F.floor(F.lit(SAMPLE_BYTES) / (F.col("dims") * 8))))
    sizes = sizes.withColumn("cells", cells).withColumn("sample", wanted)
    spread = 1 << 30
    chosen = distinct.select("e", F.size("e").alias("dims"), F.pmod(F.xxhash64("e"), F.lit(spread)).alias("at"))
    chosen = chosen.join(sizes, "dims").where(F.col("at") < F.ceil(F.col("sample") / F.col("rows") * spread))

    def fit(key, rows):
        import pyarrow as pa

        dims, cells = key[0].as_py(), rows["cells"][0].as_py()
        order = np.argsort(rows["at"].to_numpy(), kind="stable")
        e = np.concatenate([c.flatten().to_numpy() for c in rows["e"].chunks]).reshape(-1, dims)
        levels = two_level(units(e[order]), cells)
        flat = [(dims, level, k, c) for level, cs in enumerate(levels) for k, c in enumerate(cs)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
        return pa.Table.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*flat, strict=True), kinds, strict=True)], ["dims", "level", "k", "c"])

    # a sample of a bounded size for each length
    chosen = chosen.select("dims", "e", "at", "cells")
    made = saved(chosen.groupBy("dims").applyInArrow(fit, "dims int, level int, k int, c array<double>"))
    most = made.groupBy("dims").agg((F.count("*") * F.first("dims") * 8).alias("bytes")).join(sizes.select("dims", "rows"), "dims")
    held, left = [], CENTROID_BYTES
    for r in most.orderBy(F.desc("rows"), "dims").limit(CENTROID_BYTES // 16).toLocalIterator():
        if r["bytes"] > left:
            break
        held, left = [*held, r["dims"]], left - r["bytes"]
    out: dict[int, dict[int, list]] = {}
    for r in made.where(F.col("dims").isin(held)).orderBy("dims", "level", "k").toLocalIterator():
        out.setdefault(r["dims"], {}).setdefault(r["level"], []).append(r["c"])
    return {d: [np.array(levels[k]) for k in sorted(levels)] for d, levels in out.items()}


def reached(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and whether a row within ``reach`` of it can have each
    centroid as its nearest."""
    dots = x @ c.T
    home = dots.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * np.clip(c @ c.T, -1, 1), 0)) + 1e-9
    return home, dots[np.arange(len(x)), home][:, None] - dots <= reach * apart[home]


def cells_of(x: np.ndarray, levels: list[np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each unit row, and (row, cell) of all cells where it can have partners."""
    if len(levels) == 1:
        home, near = reached(x, levels[0], reach)
        return home, *np.nonzero(near)
    top, under = levels[0], levels[1:]
    first = np.cumsum([0, *(len(u) for u in under)])
    above, near = reached(x, top, reach)
    home, rows, cells = np.zeros(len(x), np.int64), [], []
    for j, c in enumerate(under):
        at = np.flatnonzero(near[:, j])
        if len(at):
            inner, hit = reached(x[at], c, reach)
            mine = above[at] == j
            home[at[mine]] = first[j] + inner[mine]
            r, k = np.nonzero(hit)
            rows.append(at[r])
            cells.append(first[j] + k)
    return home, np.concatenate(rows), np.concatenate(cells)


def placed(distinct: DataFrame, threshold: float) -> DataFrame:
    """The classes with cell (their own or one they visit) and guest."""
    held = distinct.sparkSession.sparkContext.broadcast(fitted(distinct))  # at most CENTROID_BYTES
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, GUESTS):
                part = batch.slice(start, GUESTS)
                e = part.column(3)
                lengths = np.diff(e.offsets.to_numpy())
                flat = e.flatten().to_numpy()
                starts = np.cumsum(lengths) - lengths
                row, cell, guest = [], [], []
                for dims in np.unique(lengths):
                    at = np.flatnonzero(lengths == dims)
                    home = np.zeros(len(at), np.int64)
                    if levels := held.value.get(int(dims)):
                        x = units(flat[starts[at][:, None] + np.arange(dims)])
                        home, r, j = cells_of(x, levels, reach)
                        above = j > home[r]
                        row.append(at[r[above]])
                        cell.append(j[above])
                        guest.append(np.ones(int(above.sum()), bool))
                    row.append(at)
                    cell.append(home)
                    guest.append(np.zeros(len(at), bool))
                row = pa.array(np.concatenate(row))
                out = [part.column(k).take(row) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.concatenate(cell)), pa.array(np.concatenate(guest))], ["label", "id", "weight", "e", "cell", "guest"])

    label = dict(distinct.dtypes)["label"]
    return distinct.select("label", "id", "weight", "e").mapInArrow(run, f"label {label}, id long, weight long, e array<double>, cell long, guest boolean")


class Block:
    """A block's rows (ids, weights, vectors), their links so far and who hangs together."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray, threshold: float, inner: bool) -> None:
        self.ids, self.weights, self.threshold = ids, weights, threshold
        self.x, self.norm = self._scaled(x)
        self.links, self.root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(ids) if inner else 0, GUESTS):
            part = slice(at, at + GUESTS)
            hit = self._near(self.x[part], self.norm[part])
            hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
            self.links[part] += hit @ weights
            for k in np.flatnonzero(hit.any(1)):
                self._join(np.append(np.flatnonzero(hit[k]), at + k))

    @staticmethod
    def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x / np.abs(x).max(1)[:, None]
        return x, np.sqrt((x * x).sum(1))

    def _near(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (x @ self.x.T) / (norm[:, None] * self.norm[None, :]) >= self.threshold

    def _join(self, rows: np.ndarray) -> int:
        """Puts rows under one root; pointers are flat between calls."""
        tops = self.root[rows]
        if (tops != tops[0]).any():
            tops = np.unique(tops)
            self.root[np.isin(self.root, tops[1:])] = tops[0]
        return int(tops[0])

    def meet(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray) -> list[tuple[int, int, int]]:
        """(id, links, an id linked to) of guests that have links here; the block keeps its own."""
        hit = self._near(*self._scaled(x))
        self.links += weights @ hit
        out = []
        for k in np.flatnonzero(hit.any(1)):
            top = self._join(np.flatnonzero(hit[k]))
            out.append((int(ids[k]), int(hit[k] @ self.weights), int(self.ids[top])))
        return out

    def rows(self) -> list[tuple[int, int, int]]:
        """(id, links, root's id) of the block's rows that have links."""
        some = np.flatnonzero(self.links)
        return list(zip(self.ids[some].tolist(), self.links[some].tolist(), self.ids[self.root[some]].tolist(), strict=True))


def block_tasks(rows: DataFrame) -> DataFrame:
    """(task, kind, id, weight, e) for placed rows.  kind: 0 the block's own rows, to be compared
    with each other, 1 the same in a further task of the block, 2 its guests."""
    keys = ["label", "dims", "cell"]
    rows = rows.withColumn("dims", F.size("e"))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dims"))))
    own = F.sum(F.when(~F.col("guest"), 1).otherwise(0))
    sizes = rows.groupBy(*keys).agg(own.alias("own"), F.count("*").alias("all")).where("own > 0")
    sizes = saved(sizes.select(*keys, F.ceil(F.col("own") / most).alias("blocks"), F.ceil(F.col("all") / F.lit(STREAM)).alias("parts")))
    rows = rows.join(sizes, keys)  # a cell without rows of its own has no task
    mine, part, every = F.pmod(F.xxhash64("id"), "blocks"), F.pmod(F.xxhash64("id", F.lit(1)), "parts"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    rows = rows.withColumn("mine", mine).withColumn("part", part)

    def at(block, p, kind):
        return F.struct(block.alias("block"), p.alias("part"), kind.alias("kind"))

    def hosts(t):  # of two blocks the one below where their sum is even, else the one above
        even = (t + F.col("mine")) % 2 == 0
        return ((t < F.col("mine")) & even) | ((t > F.col("mine")) & ~even)

    home = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: at(F.col("mine"), p, F.when(p == 0, 0).otherwise(1)))
    away = F.transform(F.filter(every, lambda t: F.col("guest") | hosts(t)), lambda t: at(t, F.col("part"), F.lit(2)))
    rows = rows.withColumn("to", F.explode(F.when(F.col("guest"), away).otherwise(F.concat(home, away))))
    return rows.select(F.concat_ws("/", *keys, "to.block", "to.part").alias("task"), "to.kind", "id", "weight", "e")


def block_links(tasks: DataFrame, threshold: float) -> DataFrame:
    """(id, links, root) from each task; root is an id linked to, or id itself."""

    def run(batches):
        import pyarrow as pa

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["id", "links", "root"])

        current, block, own, inner = None, None, [], False

        def opened():
            return block or (Block(*map(np.concatenate, zip(*own, strict=True)), threshold, inner) if own else None)

        for batch in batches:
            for start in range(0, batch.num_rows, GUESTS):
                rows, found = batch.slice(start, GUESTS), []
                names, kinds = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                ids, weights = rows.column(2).to_numpy(), rows.column(3).to_numpy()
                e = rows.column(4)
                flat, off = e.flatten().to_numpy(), e.offsets.to_numpy() - e.offsets[0].as_py()
                cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1] or kinds[k] != kinds[k - 1]), len(names)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    piece = (ids[a:b], weights[a:b], flat[off[a] : off[b]].reshape(b - a, -1))
                    if names[a] != current:
                        found += block.rows() if (block := opened()) else []
                        current, block, own, inner = names[a], None, [], kinds[a] == 0
                    if kinds[a] < 2:
                        own.append(piece)
                    elif block := opened():  # none where the hash left the block empty
                        found += block.meet(*piece)
                if found:
                    yield batch_of(found)
        if (block := opened()) and (found := block.rows()):
            yield batch_of(found)

    rows = tasks.repartition("task").sortWithinPartitions("task", "kind")
    return rows.select("task", "kind", "id", "weight", "e").mapInArrow(run, "id long, links long, root long")


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = with_validity(vectors)
    good = rows.where("ok")
    # a class's id is its row's number, fixed by being written: vec_ids may be shared
    distinct = good.groupBy("label", "e").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    distinct = saved(distinct.withColumn("id", F.monotonically_increasing_id()))
    found = saved(block_links(block_tasks(saved(placed(distinct, threshold))), threshold))
    comps = components(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per = distinct.join(links, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    per = saved(per.select("label", "e", "least_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), "component"))
    least = saved(per.groupBy("component").agg(F.min("least_id").alias("of")))
    per = saved(per.join(least, "component").select("label", "e", "n", "of"))
    members = good.join(per, ["label", "e"]).select("vec_id", "n", "of")
    bad = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("of"))
    out = members.union(bad)
    return out.select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("of").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("of"), F.lit(True)).alias("kept"))


def op4_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"))


OP4_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), g AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), r(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
