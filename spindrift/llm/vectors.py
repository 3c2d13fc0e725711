"""Embedding near-dedup: an exact metric range join over pivot cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, scope
from .components import components

SLACK = 1e-6  # on distances, far above rounding; pairs are decided by their cosine alone


def unit_rows(raw: list[bytes], width: int, kind: str) -> np.ndarray:
    """Vectors of ``width`` numbers (numpy's ``kind``) in double precision, scaled to length 1."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), width).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither vanish nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def raw_vectors(column: pa.Array, kind: str) -> list[bytes | None]:
    """The bytes of each vector that can be compared, None for the others."""
    out = []
    for v in column.to_pylist():
        x = None if not v or None in v else np.array(v, kind)
        out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def spanning(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least id reachable from each place by links between places."""
    label = ids.copy()
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        if (new == label).all():
            return label
        label = new


class MetricJoin:
    """Links between vectors of cosine ``least`` or more, counted and joined exactly.

    On the unit sphere that cosine is a distance ``r``. Pivots are vectors of the corpus, chosen by
    hash; a vector's home is the cell of its nearest pivot. Two vectors within ``r`` of different
    homes meet in one of the two cells, which of them the pair of cells says: there goes the other
    cell's vector as a copy, if by the triangle inequality a vector of that cell can be within r:
    its distance to the pivot is at most its home distance plus 2r and the cell's radius plus r, and
    it lies within r of the plane between the two pivots. Cells join independently. Equal vectors
    are joined as one with a weight.

    A cell is cut into blocks of about ``block_bytes``, and pairs of blocks are work items; no task
    holds more than two blocks. A width of vectors with one block or less is one cell. Pivots are
    bounded by ``most_pivots`` for each width.
    """

    def __init__(self, least: float = 0.95, block_bytes: int = 8 << 20, least_pivots: int = 4, most_pivots: int = 4096, id_col: str = "vec_id", vector: str = "embedding"):
        self.least, self.r = least, math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
        self.block_bytes, self.least_pivots, self.most_pivots = block_bytes, least_pivots, most_pivots
        self.id, self.vector = id_col, vector

    def per_block(self, width: int) -> int:
        return max(16, self.block_bytes // (8 * max(1, width)))

    def units(self, vectors: DataFrame, kind: str) -> DataFrame:
        """vec, key (a 128-bit hash of the unit vector and its width, null if it can't be compared), width and raw (bytes)."""
        name = self.vector

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = np.dtype(kind).itemsize
            for batch in batches:
                raw = raw_vectors(batch.column(name), kind)
                keys = [None if x is None else xxhash.xxh3_128_digest(unit_rows([x], len(x) // size, kind).tobytes()) for x in raw]
                yield pa.RecordBatch.from_arrays([batch.column("vec"), pa.array(keys, pa.binary()), pa.array([len(x) // size if x else 0 for x in raw], pa.int32()), pa.array(raw, pa.binary())], names=["vec", "key", "width", "raw"])

        return vectors.select(F.col(self.id).cast("long").alias("vec"), name).mapInArrow(run, "vec long, key binary, width int, raw binary")

    def pivots(self, groups: DataFrame, reps: DataFrame, kind: str) -> dict[int, np.ndarray]:
        """Pivots for each width of more than one block: the first vectors by hash of their key.

        Of about four times as many as wanted, read in one job, the first are taken.
        """
        block = F.greatest(F.lit(16), F.floor(F.lit(self.block_bytes) / (8 * F.col("width"))))
        large = groups.groupBy("width").agg(F.count("*").alias("n")).where(F.col("n") > block).collect()  # a row for a block or more
        if not large:
            return {}
        wanted = {r["width"]: min(self.most_pivots, max(self.least_pivots, -(-r["n"] // self.per_block(r["width"])))) for r in large}
        shares = reps.sparkSession.createDataFrame([(r["width"], 4 * wanted[r["width"]] / r["n"]) for r in large], "width int, share double")
        place = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40)
        found: dict[int, list] = {}
        for row in reps.join(F.broadcast(shares), "width").select("width", "raw", place.alias("place"), "share").where("place < share").collect():
            found.setdefault(row["width"], []).append((row["place"], row["raw"]))
        return {w: unit_rows([bytes(x) for _, x in sorted(rows)[: wanted[w]]], w, kind) for w, rows in found.items()}

    def homes(self, reps: DataFrame, pivots: dict[int, np.ndarray], kind: str) -> DataFrame:
        """width, cell and dist (to the cell's pivot) of every vector of a width that has pivots."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                widths = batch.column("width").to_numpy()
                for w in np.unique(widths).tolist():
                    if w in pivots:
                        raw = batch.column("raw").take(pa.array(np.flatnonzero(widths == w))).to_pylist()
                        for s in range(0, len(raw), 1024):
                            dot = unit_rows(raw[s : s + 1024], w, kind) @ pivots[w].T
                            dist = np.sqrt(np.maximum(0, 2 - 2 * dot.max(axis=1)))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(dot), w, np.int32)), pa.array(dot.argmax(axis=1).astype(np.int32)), pa.array(dist)], names=["width", "cell", "dist"])

        return reps.select("width", "raw").mapInArrow(run, "width int, cell int, dist double")

    def placed(self, reps: DataFrame, pivots: dict[int, np.ndarray], radius: dict[tuple[int, int], float], kind: str) -> DataFrame:
        """``reps`` with cell, the home, and copies, the cells where it meets vectors of those."""
        r = self.r

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                widths = batch.column("width").to_numpy()
                cells, copies = np.zeros(batch.num_rows, np.int32), [[] for _ in range(batch.num_rows)]
                for w in np.unique(widths).tolist():
                    if w not in pivots:
                        continue
                    p, at = pivots[w], np.flatnonzero(widths == w)
                    number = np.arange(len(p))
                    reach = np.array([radius.get((w, c), -1.0) for c in range(len(p))])
                    between = np.sqrt(np.maximum(1e-12, 2 - 2 * p @ p.T))
                    for s in range(0, len(at), 1024):
                        some = at[s : s + 1024]
                        dot = unit_rows(batch.column("raw").take(pa.array(some)).to_pylist(), w, kind) @ p.T
                        own = dot.argmax(axis=1)
                        d2 = np.maximum(0, 2 - 2 * dot)
                        d = np.sqrt(d2)
                        first = d[np.arange(len(some)), own][:, None]
                        go = (d <= first + 2 * r) & (d <= reach + r) & (d2 - first**2 <= 2 * r * between[own] + SLACK) & (reach >= 0)
                        low = number[None, :] < own[:, None]  # of two cells of one parity the lower one, else the upper
                        go &= (number[None, :] != own[:, None]) & (((number[None, :] + own[:, None]) % 2 == 0) == low)
                        cells[some] = own
                        for i, x in zip(some.tolist(), go, strict=True):
                            copies[i] = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(copies, pa.list_(pa.int32()))], names=[*batch.schema.names, "cell", "copies"])

        return reps.mapInArrow(run, "key binary, vec long, weight long, width int, raw binary, cell int, copies array<int>")

    def items(self, placed: DataFrame, kind: str) -> DataFrame:
        """key, vec, links (weighted, found in one work item) and root (a vector linked through the item).

        Home vectors of a cell are dealt into ``h`` blocks, its copies into ``c`` more. Every pair of
        home blocks and every home block with every block of copies is an item.
        """
        least, block_bytes = self.least, self.block_bytes
        place = F.explode(F.concat(F.array(F.struct("cell", F.lit(True).alias("home"))), F.transform("copies", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home")))))
        sizes = placed.select("width", place.alias("x")).groupBy("width", "x.cell").agg(F.count_if("x.home").alias("h"), F.count_if(~F.col("x.home")).alias("c"))
        block = F.greatest(F.lit(16), F.floor(F.lit(block_bytes) / (8 * F.col("width"))))
        sizes = cut(sizes.select("width", "cell", *[F.ceil(F.col(n) / block).cast("int").alias(n) for n in ("h", "c")]).where("h > 0"), "cell-sizes")  # a row per cell
        rows = placed.select("key", "vec", "weight", "width", "raw", place.alias("x")).select("key", "vec", "weight", "width", "raw", "x.cell", "x.home").join(F.broadcast(sizes), ["width", "cell"])
        number = F.pmod(F.xxhash64("key"), F.when(F.col("home"), F.col("h")).otherwise(F.col("c"))).cast("int")
        rows = rows.withColumn("own", F.when(F.col("home"), number).otherwise(F.col("h") + number))
        upto = lambda c: F.sequence(F.lit(0), F.when(c > 0, c - 1).otherwise(F.lit(0)))
        meets = F.when(F.col("home"), upto(F.col("h") + F.col("c"))).otherwise(upto(F.col("h")))
        rows = rows.withColumn("other", F.explode(meets))
        dealt = rows.select("width", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "vec", "weight", "raw")

        def join(table: pa.Table) -> pa.Table:
            vec, weight, own = (table.column(n).to_numpy() for n in ("vec", "weight", "own"))
            i, j, w = (table.column(n)[0].as_py() for n in ("i", "j", "width"))
            u = unit_rows(table.column("raw").to_pylist(), w, kind)
            q, a = np.flatnonzero(own == i), np.flatnonzero(own == j)
            links, left, right = np.zeros(len(vec), np.int64), [], []
            for s in range(0, len(q), 256):
                some = q[s : s + 256]
                hit = u[some] @ u[a].T >= least
                if i == j:
                    hit[np.arange(len(some)), np.arange(s, s + len(some))] = False
                x, y = np.nonzero(hit)
                if not len(x):
                    continue
                links += np.bincount(some[x], weight[a[y]], len(vec)).astype(np.int64)
                if i != j:
                    links += np.bincount(a[y], weight[some[x]], len(vec)).astype(np.int64)
                joined = spanning(np.arange(len(vec)), some[x], a[y])  # a tree for each component of these links
                moved = np.flatnonzero(joined != np.arange(len(vec)))
                left.append(moved)
                right.append(joined[moved])
            root = spanning(vec, np.concatenate(left), np.concatenate(right)) if left else vec
            out = np.flatnonzero(links)
            return pa.table({"key": table.column("key").take(pa.array(out)), "vec": vec[out], "links": links[out], "root": root[out]})

        return dealt.groupBy("width", "cell", "i", "j").applyInArrow(join, "key binary, vec long, links long, root long")

    def classes(self, vectors: DataFrame) -> DataFrame:
        """vec, n_links, component and kept, one row for each row of ``vectors``.

        Rows of one id with equal vectors are one vector. ``n_links`` counts the other vectors linked
        directly, with equal vectors of other ids among them; ``component`` is the smallest id
        reachable and ``kept`` says whether it is the row's own. Null, empty and zero vectors and such
        with null or non-finite components link with nothing; vectors of different widths don't link
        with each other. Different vectors of one id are vectors of their own with one component:
        each row reports its own links. Rows with a null id link with nothing, have no component and
        are kept. Very long vectors make small blocks. Other columns, whatever their names, are left
        out, and without rows the result has none.
        """
        kind = "<f4" if isinstance(vectors.schema[self.vector].dataType.elementType, T.FloatType) else "<f8"
        with scope():
            units = cut(self.units(vectors, kind), "units", outer=1)
            full = units.where("key is not null and vec is not null")
            groups = cut(full.select("key", "width", "vec").distinct().groupBy("key", "width").agg(F.min("vec").alias("vec"), F.count("*").alias("weight")), "groups")
            reps = cut(full.dropDuplicates(["key", "vec"]).join(groups.select("key", "vec", "weight"), ["key", "vec"]).select("key", "vec", "weight", "width", "raw"), "distinct-vectors")
            pivots = self.pivots(groups, reps, kind)
            radius = {(r["width"], r["cell"]): r["d"] for r in self.homes(reps, pivots, kind).groupBy("width", "cell").agg(F.max("dist").alias("d")).collect()} if pivots else {}  # one row per pivot
            placed = cut(self.placed(reps, pivots, radius, kind), "placed")
            discard(reps)
            found = cut(self.items(placed, kind), "cell-links")
            discard(placed)
            direct = found.groupBy("key").agg(F.sum("links").alias("links"))
            totals = cut(groups.join(direct, "key", "left").select("key", F.col("vec").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "totals", outer=1)
            same = full.select("vec", "key").join(totals, "key").where("vec <> rep").select(F.col("vec").alias("a"), F.col("rep").alias("b"))
            links = found.where("vec <> root").select(F.col("vec").alias("a"), F.col("root").alias("b")).unionByName(same)
            comp = components(links, outer=1).select(F.col("node").alias("vec"), "component")
        # rows without a key or an id don't enter a join on it, where they would all meet in one task
        out = full.select("vec", "key").join(totals.select("key", "n_links"), "key").select("vec", "n_links")
        rest = units.where("key is null and vec is not null").select("vec", F.lit(0).cast("long").alias("n_links"))
        out = out.unionByName(rest).join(comp, "vec", "left").select("vec", "n_links", F.coalesce("component", "vec").alias("component"))
        lost = units.where("vec is null").select("vec", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
        return out.unionByName(lost).withColumn("kept", F.coalesce(F.col("component") == F.col("vec"), F.lit(True)))
