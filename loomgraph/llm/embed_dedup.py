"""Embedding near-dedup by sorted projection passes.

Each pass gives every vector a key of random hyperplane signs (KEY_BITS bits, another seed a pass) and orders all
vectors by it. Vectors that are close mostly share a long prefix, so each is compared with the WINDOW that follow it. The
order is made of thin (pass, key, id) rows, whose places are numbered across partitions; stretches of SPAN places then get their
vectors, and the first WINDOW of the next stretch with them, so that no window ends at a border. Pairs are verified in double
precision; those of a stretch are handed on as links that span its classes, GROUP passes at a time, and give the components.

Windows bound what a pass compares, so they don't count the links of groups denser than a window. Therefore each component
is compared whole afterwards, block against block, which gives counts a vector and no pairs: n_links is exact within components.
A component of n vectors takes n * n / 2 products.

Equal vectors are one vector with a count, so a group of copies costs as much as a single one. A task holds one stretch
or two blocks. Vectors shuffle in the element type they have, once for each pass.

Defined cases: vectors that are null, empty, zero, of another length than the partner, or that hold null or
non-finite components link with nothing and are kept; of rows that repeat an id that of the least digest counts for all of
them; null ids link with nothing and are kept; ties in a key go by id; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions
from .components import components

PASSES, KEY_BITS, WINDOW = 24, 48, 128
#: Places of one task, and passes of one job.
SPAN, GROUP = 2048, 8
#: Components up to SMALL vectors are one block; larger ones up to SPREAD blocks, and more where a block would exceed BLOCK.
SMALL, SPREAD, BLOCK = 256, 8, 8192


def _keyed(reps: DataFrame, passes: range) -> DataFrame:
    """reps(id, v) -> (pass, key, id): a sign-hash key for each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(zero_copy_only=False), np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _matrix(batch.column(1).take(pa.array(at)), dim)
                if dim not in planes:
                    planes[dim] = np.stack([np.random.default_rng((dim, p)).standard_normal((dim, KEY_BITS)) for p in passes], axis=1).reshape(dim, -1)
                signs = (x @ planes[dim] > 0).reshape(len(at), len(passes), KEY_BITS)
                keys = signs @ (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))
                tags = np.tile(np.array(passes, dtype=np.int32), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(tags), pa.array(keys.reshape(-1)), pa.array(np.repeat(ids[at], len(passes)))], ["pass", "key", "id"])

    return reps.mapInArrow(run, "pass int, key long, id long")


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors of one length as rows of doubles, the largest component of each 1, so that lengths of huge ones stay finite."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _unit(vectors: pa.ListArray, dim: int) -> np.ndarray:
    x = _matrix(vectors, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stretches(keyed: DataFrame, span: int, window: int) -> DataFrame:
    """keyed(pass, key, id) -> (stretch, at, pass, id): places in the one order, and whose they are; a stretch begins with the end of its lookahead."""
    spark = keyed.sparkSession
    in_order = keyed.repartitionByRange(partitions(spark), "pass", "key", "id").sortWithinPartitions("pass", "key", "id")
    in_order = cut(in_order.select("pass", "id", F.monotonically_increasing_id().alias("row")), "embed-order")
    part = F.shiftright("row", 33)
    sums = in_order.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    starts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    placed = in_order.withColumn("part", part).join(F.broadcast(starts), "part").select("pass", "id", (F.col("start") + F.col("row").bitwiseAND((1 << 33) - 1)).alias("at"))
    own = F.expr(f"at div {span}")
    both = F.when((F.col("at") % span < window) & (F.col("at") >= span), F.array(own, own - 1)).otherwise(F.array(own))
    return placed.select(F.explode(both).alias("stretch"), "at", "pass", "id")


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the first row that the pairs (i, j) connect it with."""
    label = np.arange(n)
    while True:
        least, new = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _close(stretches: DataFrame, least: float, span: int, window: int) -> DataFrame:
    """stretches(stretch, at, pass, id, v) -> (a, b): links that join what close vectors at most `window` places apart in a pass join.

    A stretch gives a link a vector at most, to the first one of its class there, however many pairs it holds.
    """

    def pairs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        at, tag, ids = (rows.column(k).to_numpy() for k in ("at", "pass", "id"))
        v, stretch = rows.column("v").chunk(0), rows.column("stretch")[0].as_py()
        dims, found = np.diff(v.offsets.to_numpy()), []
        for dim in np.unique(dims).tolist():
            which = np.flatnonzero(dims == dim)  # ascending places
            x, places, tags = _unit(v.take(pa.array(which)), dim), at[which], tag[which]
            inside = int(np.searchsorted(places, (stretch + 1) * span))
            for lo in range(0, inside, 256):
                hi = min(lo + 256, inside)
                end = int(np.searchsorted(places, places[hi - 1] + window, "right"))
                gap = places[None, lo:end] - places[lo:hi, None]
                ok = (x[lo:hi] @ x[lo:end].T >= least) & (gap > 0) & (gap <= window) & (tags[None, lo:end] == tags[lo:hi, None])
                i, j = np.nonzero(ok)
                found.append(np.stack([which[lo + i], which[lo + j]]))
        label = _labels(len(ids), *np.concatenate(found, axis=1)) if found else np.arange(len(ids))
        own = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[label[own]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _groups(batches, 1):
            yield pairs(parts)

    rows = stretches.select("stretch", "at", "pass", "id", "v").repartition(partitions(stretches.sparkSession), "stretch").sortWithinPartitions("stretch", "at")
    return rows.mapInArrow(run, "a long, b long").where("a <> b")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Sorted rows in pieces of equal values of the first so many columns, which are longs or ints."""
    parts: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        values = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1)
        starts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        for lo, hi in zip(starts, starts[1:], strict=False):
            if lo == hi:
                continue
            if parts and tuple(values[lo]) != key:
                yield parts
                parts = []
            key = tuple(values[lo])
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield parts


def _blocks(members: DataFrame) -> DataFrame:
    """members(id, v, copies, c) -> a row for each two blocks of a component that a vector's block is one of."""
    sizes = members.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > SMALL)
    blocks = F.greatest(F.least(F.ceil(F.col("n") / SMALL), F.lit(SPREAD)), F.ceil(F.col("n") / BLOCK)).cast("int")
    large = sizes.select(F.col("c").alias("_c"), blocks.alias("_blocks"))
    rows = members.join(F.broadcast(large), F.col("c") == F.col("_c"), "left").withColumn("_n", F.coalesce("_blocks", F.lit(1)))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select("c", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).cast("int").alias("side"), "id", "copies", "v")


def _links(members: DataFrame, least: float) -> DataFrame:
    """(rep, near): how many vectors of its component each is close to, copies counted."""

    def count(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        unit = pa.Table.from_batches(parts).combine_chunks()
        side, ids, copies = (unit.column(k).to_numpy() for k in ("side", "id", "copies"))
        x = _unit(unit.column("v").chunk(0), len(unit.column("v")[0]))
        one = parts[0].column("i")[0] == parts[0].column("j")[0]
        rows = np.arange(len(ids)) if one else np.flatnonzero(side == 0)
        cols = rows if one else np.flatnonzero(side == 1)
        near, right = np.zeros(len(ids), dtype=np.int64), x[cols].T
        for lo in range(0, len(rows), 1024):
            own = rows[lo : lo + 1024]
            ok = x[own] @ right >= least
            if one:
                ok[np.arange(len(own)), np.arange(lo, lo + len(own))] = False
            for k in range(0, len(cols), 1024):
                some = ok[:, k : k + 1024].astype(np.float64)  # counts below 2^53 are exact
                near[own] += (some @ copies[cols[k : k + 1024]]).astype(np.int64)
                if not one:
                    near[cols[k : k + 1024]] += (copies[own] @ some).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near)], ["rep", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _groups(batches, 3):
            yield count(parts)

    rows = _blocks(members).repartition(partitions(members.sparkSession), "c", "i", "j").sortWithinPartitions("c", "i", "j")
    return rows.mapInArrow(run, "rep long, near long").groupBy("rep").agg(F.sum("near").alias("near"))


def embed_dedup(vectors: DataFrame, least: float = 0.9, passes: int = PASSES, window: int = WINDOW, span: int = SPAN, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept."""
    if window > span:
        raise ValueError("a window must fit in a span")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = rows.schema["v"].dataType.elementType.simpleString()
    rows = rows.withColumn("v", F.col("v").cast(f"array<{kind if kind == 'float' else 'double'}>"))
    usable = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one number; the digest stands for the vector
    key = F.unhex(F.sha2(F.array_join(F.transform("v", lambda x: F.hex((x + 0.0).cast("string"))), ","), 256))
    thin = rows.where(usable & F.col("id").isNotNull()).withColumn("k", key).groupBy("id").agg(F.min("k").alias("k"), F.min_by("v", "k").alias("v"))
    thin = cut(thin, "embed-keys")
    classes = cut(thin.groupBy("k").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "embed-classes")
    reps = cut(thin.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "v"), "embed-reps")
    pairs = None
    for lo in range(0, passes, GROUP):
        stretches = _stretches(_keyed(reps, range(lo, min(lo + GROUP, passes))), span, window)
        found = cut(_close(stretches.join(reps, "id"), least, span, window).distinct(), "embed-pairs")
        pairs = found if pairs is None else pairs.unionByName(found)
    joined = components(pairs)
    members = reps.join(classes.select(F.col("rep").alias("id"), "copies"), "id").join(joined.select(F.col("node").alias("id"), F.col("component").alias("c")), "id")
    near = _links(cut(members, "embed-members"), least)
    found = thin.select("id", "k").join(classes, "k").join(near, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    found = found.select(F.col("id").alias("own"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).cast("long").alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.select("id").join(found, F.col("id") == F.col("own"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"), F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept"))
