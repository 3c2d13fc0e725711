"""MinHash near-dedup with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, blocks, cut, discard, scope
from .components import components

#: Mixing constants of the MurmurHash3 finalizer.
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S1, S2, S3 = np.uint64(33), np.uint64(29), np.uint64(31)
WIDTH = 4096  # shingles hashed at a time


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S1)) * M1
    x = (x ^ (x >> S1)) * M2
    return x ^ (x >> S1)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; one for the whole of a shorter text."""
    words = text.encode().lower().split() if text else []  # of bytes: A-Z, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < k:
        out = np.full(1, len(h), np.uint64)
        for x in h:
            out = mix(out * M2 + x)
        return out
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * M2 + h[i : len(h) - k + 1 + i])
    return np.unique(out)


class Hashing:
    """``n`` permutations of 32-bit numbers; a signature holds the least value of each over a set."""

    def __init__(self, n: int):
        seeds = np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        values = (mix(seeds) >> np.uint64(32)).astype(np.uint32)
        self.flip, self.times = values[:n, None], values[n:, None] | np.uint32(1)

    def signature(self, shingles: np.ndarray) -> bytes:
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.flip), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(short), WIDTH):
            np.minimum(least, ((short[None, i : i + WIDTH] ^ self.flip) * self.times).min(axis=1), out=least)
        return least.tobytes()


def least_matches(batches: list[int], similarity: float, miss: float) -> list[int]:
    """For each number of compared values, the fewest equal ones with which a pair goes on.

    With m of n values equal and a uniform prior, similarity is Beta(m + 1, n - m + 1). A pair is
    pruned when the chance of ``similarity`` or more is below ``miss``. That chance is a binomial
    sum: P(Beta(m + 1, n - m + 1) >= s) = P(Binomial(n + 1, s) <= m).
    """
    out = []
    for n in batches:
        total, m = 0.0, -1
        while m < n:
            total += math.comb(n + 1, m + 1) * similarity ** (m + 1) * (1 - similarity) ** (n - m)
            if total >= miss:
                break
            m += 1
        out.append(m + 1)
    return out


def surviving(a: np.ndarray, b: np.ndarray, steps: list[int], least: list[int]) -> np.ndarray:
    """Places of the pairs of signature rows that no step prunes."""
    left, equal, start = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in zip(steps, least, strict=True):
        equal = equal + (a[left, start:n] == b[left, start:n]).sum(axis=1)
        keep = equal >= m
        left, equal, start = left[keep], equal[keep], n
    return left


def in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """``rows`` (key, doc, ...) dealt into ``blocks`` per key by hash; each row once for every block
    that its own meets: columns own, i and j with i <= j name the item."""
    n = blocks.cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("doc"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def by_item(rows: DataFrame, work: Callable[[pa.Table], dict | None], schema: str) -> DataFrame:
    """What ``work`` makes of the rows of each item (key, i, j), several rows at least.

    Rows are sorted by item within partitions and read as a stream, so that many small items share
    a batch and memory holds one item and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def finish(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for s, e in zip([0, *edges], [*edges, len(key)], strict=True):
                if e - s > 1 and (made := work(table.slice(s, e - s))):
                    yield pa.RecordBatch.from_pydict(made)

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
            first = [kept[0].column(c)[0].as_py() for c in ("key", "i", "j")]
            if (key[-1], i[-1], j[-1]) == tuple(first):
                continue  # one item so far
            table = pa.Table.from_batches(kept)
            last = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            at = len(table) - len(key) + (last[-1] + 1 if len(last) else 0)
            yield from finish(table.slice(0, at))
            kept = table.slice(at).to_batches()
        if kept:
            yield from finish(pa.Table.from_batches(kept))

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


class NearDuplicates:
    """Near-duplicate links between documents by Jaccard similarity of word shingles.

    Sums over a key are written before they are joined back to the key's rows: a join straight above
    an aggregation on its key can't be split, and one bucket or set may hold a third of all rows.

    ``bands`` bands of ``rows`` values find candidates: a pair of similarity ``s`` is missed with
    chance ``(1 - s**rows)**bands``, 1.3e-7 at 0.8 as set here. ``miss`` is the chance at which a
    comparison of signatures may prune a pair of ``similarity``; survivors are verified on sets.
    """

    def __init__(self, shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, miss: float = 1e-6, id_col: str = "doc_id", text: str = "text", block: int = 4096, block_shingles: int = 4_000_000, most_ids: int = 4_000_000):
        self.shingle, self.percent, self.bands, self.rows = shingle, percent, bands, rows
        self.miss = miss
        self.id, self.text, self.block, self.block_shingles, self.most_ids = id_col, text, block, block_shingles, most_ids
        self.hashing = Hashing(bands * rows)
        self.steps = sorted({min(n, bands * rows) for n in (32, 64, 96, bands * rows)})
        self.least = least_matches(self.steps, percent / 100, miss)

    def signed(self, docs: DataFrame) -> DataFrame:
        """doc, n_shingles, set_key (a 128-bit hash of the set, null if empty) and sig of each row."""
        k, hashing, text = self.shingle, self.hashing, self.text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in blocks(batches, text, 4_000_000):
                sizes, keys, sigs = [], [], []
                for t in part.column(text).to_pylist():
                    s = shingle_set(t, k)
                    sizes.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(hashing.signature(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc", "n_shingles", "set_key", "sig"])

        return arrow_rows(docs).select(F.col(self.id).cast("long").alias("doc"), text).mapInArrow(run, "doc long, n_shingles long, set_key binary, sig binary")

    def sets(self, docs: DataFrame, ids: DataFrame) -> DataFrame:
        """doc, shingles (sorted array of long) and their number, size, of the documents whose ids are in ``ids``."""
        k, text = self.shingle, self.text
        wanted = F.broadcast(ids) if ids.count() <= self.most_ids else ids
        some = arrow_rows(docs).select(F.col(self.id).cast("long").alias("doc"), text).join(wanted, "doc", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in blocks(batches, text, 4_000_000):
                found = [shingle_set(t, k).view(np.int64) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(found, pa.list_(pa.int64())), pa.array(list(map(len, found)), pa.int64())], names=["doc", "shingles", "size"])

        return some.mapInArrow(run, "doc long, shingles array<long>, size long")

    def pruned(self, pairs: DataFrame, sigs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sequential comparison of their signatures leaves."""
        steps, least = self.steps, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for n in ("sa", "sb"))
                    yield batch.select(["a", "b"]).take(pa.array(surviving(a, b, steps, least)))

        one, two = (sigs.select(F.col("doc").alias(n), F.col("sig").alias(f"s{n}")) for n in "ab")
        return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")

    def verified(self, pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
        """The pairs whose full sets reach the similarity."""
        pairs = cut(pairs.distinct(), f"{name}-survivors")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        sets = cut(self.sets(docs, ids), f"{name}-sets")
        one, two = (sets.select(F.col("doc").alias(n), F.col("shingles").alias(f"s{n}")) for n in "ab")
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        joined = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("n"))
        links = cut(joined.where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * self.percent).select("a", "b"), f"{name}-links", outer=1)
        discard(pairs, sets)
        return links

    def banded(self, reps: DataFrame) -> DataFrame:
        """doc and key of every band whose values two documents or more share, with their number n."""
        width = 4 * self.rows
        keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(self.bands)])
        rows = reps.select("doc", F.explode(keys).alias("key"))
        shared = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
        banded = cut(rows.join(shared, "key").select("key", "doc", "n"), "bands")
        discard(shared)
        return banded

    def star_pairs(self, banded: DataFrame) -> DataFrame:
        """Each document with the leader of each of its buckets.

        The leader is the member that shares most buckets with most documents: among copies with
        different changes, the one that all resemble.
        """
        degree = banded.groupBy("doc").agg(F.sum(F.log2("n")).alias("degree"))
        rated = banded.join(degree, "doc").select("key", "doc", "degree")
        leaders = cut(rated.groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc")).alias("doc"))).alias("l")).select("key", (-F.col("l.doc")).alias("leader")), "leaders")
        pairs = rated.join(leaders, "key").where("doc <> leader")
        return pairs.select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct()

    def distinct_keys(self, rows: DataFrame, *more: Column, where: str = "n > 1") -> DataFrame:
        """One key (and its ``more`` aggregates) of each set of documents of rows (key, doc).

        Near copies share many buckets with the same members, which then are compared once. Sets are
        told apart by their size and two sums of hashes.
        """
        h = lambda i: F.xxhash64("doc", F.lit(i))
        members = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(h(1)).alias("x"), F.sum(h(2).cast("decimal(20,0)")).alias("s"), *more)
        return members.where(where).groupBy("n", "x", "s").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in members.columns if c not in ("key", "n", "x", "s")])

    def residual_links(self, banded: DataFrame, comp: DataFrame, sigs: DataFrame, docs: DataFrame) -> DataFrame:
        """Links between the components that stars have left apart in one bucket.

        Buckets of the same members count once. Work items are pairs of blocks of a bucket, so a
        bucket of n documents makes n * n / ``block`` rows, or up to 16 n where that is less. The first pass compares signatures in place and
        returns the documents with a surviving candidate, the second brings the sets of those
        together in blocks of bounded size and counts intersections in place. Neither returns the
        pairs it tests: of the links found, an item returns a spanning forest of its components.
        """
        rows = banded.join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("comp"))
        mixed = self.distinct_keys(rows, F.min("comp").alias("lo"), F.max("comp").alias("hi"), where="lo < hi")
        mixed = cut(mixed.select("key"), "mixed-keys")
        rows = rows.join(mixed, "key").join(sigs.select("doc", "sig"), "doc")
        steps, least, percent = self.steps, self.least, self.percent

        def compare(t: pa.Table) -> dict | None:
            own, doc, comp = (t.column(c).to_numpy() for c in ("own", "doc", "comp"))
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(doc), -1)
            second, near = np.flatnonzero(own == j), np.zeros(len(doc), bool)
            for x in np.flatnonzero(own == i):
                others = second[comp[second] != comp[x]]
                left = others[surviving(np.broadcast_to(sig[x], (len(others), sig.shape[1])), sig[others], steps, least)]
                if len(left):
                    near[x] = near[left] = True
            key = t.column("key").to_numpy()
            return {"key": key[near], "doc": doc[near], "comp": comp[near]} if near.any() else None

        def verify(t: pa.Table) -> dict | None:
            doc, label = t.column("doc").to_numpy(), t.column("comp").to_numpy().copy()
            column = t.column("shingles").combine_chunks()
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            codes = np.unique(flat, return_inverse=True)[1]
            starts = np.cumsum(sizes) - sizes
            member, out = np.zeros(codes.max() + 1, bool), []
            names, counts = np.unique(label, return_counts=True)
            largest = names[counts.argmax()]
            for x in range(len(doc)):
                if label[x] == largest:
                    continue  # its pairs with other components are met from their side
                mine = codes[starts[x] : starts[x] + sizes[x]]
                member[mine] = True
                both = np.add.reduceat(member[codes], starts, dtype=np.int64)
                member[mine] = False
                hit = np.flatnonzero((both * 100 >= (sizes + sizes[x] - both) * percent) & (label != label[x]))
                found, first = np.unique(label[hit], return_index=True)
                for name, at in zip(found, hit[first], strict=True):
                    out.append((doc[x], doc[at]))
                    label[label == label[x]] = name
                if (label == label[0]).all():
                    break
            return {"a": np.array([x for x, _ in out]), "b": np.array([y for _, y in out])} if out else None

        # up to 16 small blocks let several tasks share a large bucket, at 16 rows a document at most
        n_blocks = F.greatest(F.ceil(F.col("n") / self.block), F.least(F.lit(16), F.ceil(F.col("n") * 8 / self.block)))
        near = by_item(in_blocks(rows, n_blocks), compare, "key long, doc long, comp long")
        near = cut(near.distinct(), "near")
        sets = cut(self.sets(docs, near.select("doc").distinct()), "residual-sets")
        sized = near.join(sets.select("doc", "size"), "doc")
        total = cut(self.distinct_keys(sized, F.sum("size").alias("total")).select("key", "total"), "totals")
        # by a merge whatever its size, so that the plan is the same for small and large inputs
        whole = near.join(total.hint("merge"), "key").join(sets.select("doc", "shingles"), "doc")
        links = cut(by_item(in_blocks(whole, F.ceil(F.col("total") / self.block_shingles)), verify, "a long, b long").distinct(), "residual-links", outer=1)
        discard(near, sets, total, mixed)
        return links

    def linked(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The signed rows of ``docs``, and links (a, b) between representatives of equal sets.

        Links join every pair of similar documents through a chain of links.
        """
        signed = cut(self.signed(docs), "signed")
        full = signed.where("set_key is not null and doc is not null")
        least = cut(full.groupBy("set_key").agg(F.min("doc").alias("doc")), "least")
        reps = full.join(least, ["set_key", "doc"], "left_semi").select("doc", "set_key", "sig")
        reps = cut(reps.dropDuplicates(["set_key", "doc"]), "representatives")
        with scope():
            banded = self.banded(reps)
            stars = self.pruned(self.star_pairs(banded), reps)
            links = self.verified(stars, docs, "star")
            comp = components(links)
            links = links.unionByName(self.residual_links(banded, comp, reps, docs))
        discard(reps)
        same = full.join(least.withColumnRenamed("doc", "rep"), "set_key").where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
        return signed, links.unionByName(same)

    def classes(self, docs: DataFrame, outer: int = 0) -> DataFrame:
        """doc, n_shingles, component and kept, one row for each row of ``docs``.

        ``component`` is the smallest id reachable by links; ``kept`` says whether it is the row's
        own. A text without words or a null one links with nothing. Very long texts are read whole.
        Rows with one id are one document with several texts: links of any of them join them all, and
        all are kept or none. A row with a null id links with nothing, has no component and is kept.
        Other columns, whatever their names, are left out, and without rows the result has none.
        """
        with scope():
            signed, links = self.linked(docs)
            comp = components(links).withColumnRenamed("node", "doc")
            # rows without an id don't enter the join on it, where they would all meet in one task
            out = signed.where("doc is not null").select("doc", "n_shingles").join(comp, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
            lost = signed.where("doc is null").select("doc", "n_shingles", F.lit(None).cast("long").alias("component"))
            found = out.unionByName(lost).withColumn("kept", F.coalesce(F.col("component") == F.col("doc"), F.lit(True)))
            return cut(found, "classes", outer=1 + outer)

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """``docs`` with one row of each class: that of the smallest id.

        Rows with a null id all stay. Where an id is repeated, its rows are told apart by their
        texts: equal ones are one, others go only if their own text has a copy. They are numbered by
        a hash below all ids that aren't negative, so of a class with such a row that row stays.

        Texts aren't shuffled: the ids to drop go to the rows, by broadcast up to ``most_ids`` of
        them and by a join beyond.
        """
        small = lambda ids: F.broadcast(ids) if ids.count() <= self.most_ids else ids
        with scope():
            counted = docs.where(F.col(self.id).isNotNull()).groupBy(F.col(self.id).cast("long").alias("__id")).agg(F.count("*").alias("n"))
            repeated = cut(counted.where("n > 1").select("__id", F.lit(True).alias("__again")), "repeated-ids", outer=1)
            row = F.col(self.id).cast("long")
            if not repeated.isEmpty():
                marked = docs.join(small(repeated), row == F.col("__id"), "left")
                again = F.when(F.col("__again"), -1 - F.pmod(F.xxhash64("__id", F.col(self.text), F.col(self.text).isNull()), F.lit(1 << 62)))
                docs = marked.withColumn("__row", F.coalesce(again, row)).select(*docs.columns, "__row")
                # equal rows first: each of them would be told to stay
                once = docs.where("__row < 0").join(small(repeated), row == F.col("__id"), "left_semi").dropDuplicates(["__row"])
                docs = docs.join(small(repeated), row == F.col("__id"), "left_anti").unionByName(once)
            else:
                docs = docs.withColumn("__row", row)
            near = NearDuplicates(self.shingle, self.percent, self.bands, self.rows, self.miss, "__row", self.text, self.block, self.block_shingles, self.most_ids)
            dropped = cut(near.classes(docs).where(~F.col("kept")).select(F.col("doc").alias("__row")).distinct(), "dropped", outer=1)
        return docs.join(small(dropped), "__row", "left_anti").drop("__row")
