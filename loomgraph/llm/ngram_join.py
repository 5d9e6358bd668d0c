"""N-gram Jaccard self-join by prefix trees, and the classes its links form.

Sets are the distinct n-word shingles of whole texts (64-bit hashes) in one global order: by hash, but with shingles that
many prefixes hold last. Two sets that are similar enough share a shingle in their prefixes, so only shingles that stand
in two prefixes bring sets together. Pairs whose prefixes share too little for the threshold are dropped; sets that the
others join, directly or by a chain, form a candidate group (a shingle in very many prefixes joins all its sets). A group's
sets are stored in one trie, in which each probe shares the overlap of a common path and cuts a subtree when its sizes, or
the lengths that remain, can't reach the threshold any more, or when it is linked to the probe already.

Skew: equal sets are one set. A group is bounded in a task by BLOCK shingles; a larger one is dealt into blocks that share
a few anchor sets, and whatever is still outside the group's largest class afterwards is compared with every block. Links
are found as spanning links: the classes are exact, pairs within a class aren't listed.

Defined cases: A-Z is lower-cased; fewer words than n make one shingle of the whole sequence; null, empty and blank
texts have no set, are linked with nothing and are classes of their own; repeated rows of an id share a class; rows of null
ids have no class of their own (component_id is that of an equal or linked text, else null) and stay in one_of_each; an empty
table gives an empty result; other columns aren't read, and keep their values in one_of_each, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import cut, packed, partitions, remove, shared_dir
from .components import components
from .shingles import WordHashes, lists, shingles, sliced

#: A shingle in more prefixes than HOT goes to the end of the order; MOST_HOT of them are told apart. Only speed depends on it.
HOT, MOST_HOT = 64, 100_000
#: Prefixes in which shingles are counted, as a multiple of those that are joined, which reach further without the hot ones.
AHEAD = 2
#: Shingles of the sets in one task, and anchor sets that all blocks of a large group share.
BLOCK, ANCHORS = 3_000_000, 64
#: Partners of one set in a task, where pairs are looked at one by one.
FAN = 256


#: A side of a join is broadcast only if it has at most so many rows, of four longs at most.
FEW = 1_000_000


def _task(probing: int, *cols) -> Column:
    """A name of a task. Two tasks of one kind that get the same are compared with each other, which loses no link."""
    return F.shiftleft(F.xxhash64(*cols), 1).bitwiseOR(F.lit(probing)).alias("task")


def few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if a count shows that they are few."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def in_order(own: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Ascending hashes in the global order: those in hot (ascending) come last."""
    if not len(hot) or not len(own):
        return own
    last = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
    return np.concatenate([own[~last], own[last]])


def prefix_length(size: int, percent: int) -> int:
    """So many first elements of a set must meet those of any partner."""
    return size - -(-percent * size // 100) + 1 if size else 0


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap of sets of these sizes with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class Node:
    __slots__ = ("children", "depth", "hi", "largest", "last", "least", "lo", "one", "seg", "table")

    def __init__(self, seg, depth, lo, hi, sizes):
        self.seg, self.depth, self.lo, self.hi = seg, depth + len(seg), lo, hi  # depth: elements up to and with seg
        self.last = int(seg[-1]) if len(seg) else -1
        self.least, self.largest = int(sizes[lo:hi].min()), int(sizes[lo:hi].max())
        self.children, self.one, self.table = [], hi - lo == 1, None


def trie(sets: list[np.ndarray], sizes: np.ndarray) -> Node:
    """The path-compressed tree of sets that are in lexicographic order and all different."""
    root = Node(sets[0][:0], 0, 0, len(sets), sizes)
    todo = [root]
    while todo:
        node = todo.pop()
        lo, depth = node.lo, node.depth
        while lo < node.hi and len(sets[lo]) == depth:
            lo += 1  # a set that ends here; it is met as a child of its own
            node.children.append(Node(sets[lo - 1][:0], depth, lo - 1, lo, sizes))
        firsts = np.fromiter((s[depth] for s in sets[lo : node.hi]), dtype=np.int64, count=node.hi - lo)
        edges = np.flatnonzero(np.diff(firsts)) + 1 + lo
        for a, b in zip([lo, *edges.tolist()], [*edges.tolist(), node.hi], strict=True) if lo < node.hi else ():
            first, last = sets[a], sets[b - 1]
            if b - a == 1:
                node.children.append(Node(first[depth:], depth, a, b, sizes))
                continue
            m = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:m] != last[depth:m])
            child = Node(first[depth : depth + int(differ[0]) if len(differ) else m], depth, a, b, sizes)
            node.children.append(child)
            todo.append(child)
        node.table = np.array([(c.lo, c.least, c.largest) for c in node.children], dtype=np.int64).T
    return root


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], percent: int, hot: np.ndarray, label: np.ndarray | None = None, probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (index pairs) between the sets (each in the global order, all different) that join classes.

    label: sets that are linked already have the same; probes (flags): only pairs with a probe count.
    """
    flat = np.concatenate(sets)
    known = np.unique(flat)
    known = in_order(known, hot)
    order = np.argsort(known, kind="stable")
    ranked = order[np.searchsorted(known[order], flat)]
    ends = np.cumsum([len(s) for s in sets])
    own = [ranked[e - len(s) : e] for e, s in zip(ends.tolist(), sets, strict=True)]
    place = np.array(sorted(range(len(own)), key=lambda i: own[i].astype(">u4").tobytes()), dtype=np.int64)
    own = [own[i] for i in place.tolist()]
    sizes = np.array([len(s) for s in own], dtype=np.int64)
    same = np.arange(len(own)) if label is None else np.unique(label[place], return_inverse=True)[1]
    asked = None if probes is None else probes[place]
    root, held, out = trie(own, sizes), np.zeros(len(known), dtype=bool), []
    for i in range(len(own)):
        if asked is not None and not asked[i]:
            continue
        x, size = own[i], int(sizes[i])
        held[x] = True
        todo = [(root, 0)]
        while todo:
            node, overlap = todo.pop()
            if node.one and not node.children:
                j = node.lo
                if 100 * overlap >= percent * (size + int(sizes[j]) - overlap) and same[j] != same[i]:
                    same[same == same[j]] = same[i]
                    out.append((int(place[i]), int(place[j])))
                continue
            los, least, largest = node.table
            ok = (100 * largest >= percent * size) & (100 * size >= percent * least)
            if asked is None:
                ok &= los < i  # each pair once
            for c in np.flatnonzero(ok).tolist():
                child = node.children[c]
                if child.one:
                    if same[child.lo] == same[i]:
                        continue
                elif (same[child.lo : child.hi] == same[i]).all():
                    continue
                shared = overlap + int(np.count_nonzero(held[child.seg]))
                rest = size - int(np.searchsorted(x, child.last, "right")) if child.last >= 0 else size
                if shared + min(rest, child.largest - child.depth) >= needed(size, child.least, percent):
                    todo.append((child, shared))
        held[x] = False
    return out


def _prefixes(docs: DataFrame, n: int, percent: int, hot: np.ndarray, times: int = 1) -> DataFrame:
    """docs(id, text) -> id, n_shingles, a 128-bit digest of the set, and its first elements: `times` its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in sliced(batches):
            sets = [shingles(t.as_py(), n, known) for t in batch.column(1)]
            sums = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
            halves = np.frombuffer(sums, dtype=np.int64).reshape(-1, 2)
            shown = [in_order(s, hot)[: times * prefix_length(len(s), percent)] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), lists(shown, pa.int64())], ["id", "n_shingles", "d1", "d2", "elements"])

    return docs.select("id", F.col("text").cast("binary")).mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, elements array<long>")


def _reordered(first: DataFrame, percent: int, hot: np.ndarray) -> DataFrame:
    """(id, n_shingles, elements): prefixes in the order with hot elements last, of _prefixes' longer ones; null where they run out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            shown, runs_out = [], []
            for n, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                p, x = prefix_length(n, percent), x.values.to_numpy(zero_copy_only=False).view(np.uint64)
                ordered = in_order(x, hot)
                short = len(x) < n and len(x) and p and len(hot) and hot[min(np.searchsorted(hot, ordered[p - 1]), len(hot) - 1)] == ordered[p - 1]
                runs_out.append(bool(short))
                shown.append(ordered[:0] if short else ordered[:p])
            found = lists(shown, pa.int64())
            found = pa.ListArray.from_arrays(found.offsets, found.values, mask=pa.array(runs_out))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["id", "n_shingles", "elements"])

    return first.select("id", "n_shingles", "elements").mapInArrow(run, "id long, n_shingles long, elements array<long>")


def _joined(rows: DataFrame, n: int, percent: int, hot: np.ndarray) -> DataFrame:
    """rows(task, id, text, label, probe) -> links (a, b) within each task, read as a sorted stream.

    Texts are what is shuffled: they take less room than their sets of hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        task, ids, sets, label, probe = None, [], [], [], []

        def flush():
            if len(ids) < 2:
                return [], []
            flags = np.array(probe)
            found = spanning_links(np.array(ids), sets, percent, hot, np.array(label), flags if flags.any() else None)
            return [ids[a] for a, _ in found], [ids[b] for _, b in found]

        for batch in batches:
            out_a, out_b = [], []
            for t, i, text, c, p in zip(*(batch.column(k) for k in range(5)), strict=True):
                if t.as_py() != task:
                    a, b = flush()
                    out_a += a
                    out_b += b
                    task, ids, sets, label, probe = t.as_py(), [], [], [], []
                if ids and ids[-1] == i.as_py():  # a repeated row; one that probes comes last
                    probe[-1] |= p.as_py()
                    continue
                ids.append(i.as_py())
                sets.append(in_order(shingles(text.as_py(), n, known), hot))
                label.append(c.as_py())
                probe.append(p.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
        a, b = flush()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = rows.select("task", "id", F.col("text").cast("binary"), "label", "probe").repartition(partitions(rows.sparkSession), "task")
    return rows.sortWithinPartitions("task", "id").mapInArrow(run, "a long, b long")


def _promising(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets whose prefixes still allow the threshold, from entries(e, id, n, i) with HOT rows of an e at most.

    i is the place of e in the set. Behind the last shared element, at most what remains of either set is shared.
    """
    one = entries.select("e", F.col("id").alias("a"), F.col("n").alias("an"), F.col("i").alias("ai"))
    two = entries.select("e", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("i").alias("bi"))
    both = one.join(two, "e").where(f"a < b and least(an, bn) * 100L >= greatest(an, bn) * {percent}L")
    both = both.groupBy("a", "b", "an", "bn").agg(F.count("*").alias("shared"), F.max("ai").alias("ai"), F.max("bi").alias("bi"))
    return both.where(f"(shared + least(an - ai, bn - bi) - 1) * {100 + percent}L >= {percent}L * (an + bn)").select("a", "b")


def _sized(meet: DataFrame, sizes: DataFrame) -> tuple[DataFrame, bool]:
    """Sets that meet(a, b) joins: id, n, grp, members and number of blocks of the group; whether any has several blocks."""
    groups = components(meet.select("a", "b")).withColumnRenamed("node", "id").withColumnRenamed("component", "grp")
    groups = cut(groups.join(sizes, "id"), "join-groups")
    sums = cut(groups.groupBy("grp").agg(F.expr(f"(sum(n) + {BLOCK - 1}) div {BLOCK}").alias("blocks"), F.count("*").alias("members")), "join-sums")
    return groups.join(sums, "grp").select("id", "n", "grp", "blocks", "members"), sums.where("blocks > 1").limit(1).count() > 0


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    none = np.empty(0, dtype=np.uint64)
    folder = shared_dir(spark, "join-sets")
    _prefixes(docs, n, percent, none, AHEAD).write.parquet(folder)
    first = spark.read.parquet(folder)
    own = cut(first.select("id", "n_shingles", "d1", "d2"), "join-digests")
    equal = own.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    common = first.select(F.explode("elements").alias("e")).groupBy("e").agg(F.count("*").alias("c")).where(F.col("c") > HOT)
    hot = np.sort(np.array([r["e"] for r in common.orderBy(F.desc("c"), "e").limit(MOST_HOT).collect()], dtype=np.int64).view(np.uint64))
    prefixes = shared_dir(spark, "join-prefixes")
    _reordered(first, percent, hot).write.parquet(prefixes)
    short = cut(spark.read.parquet(prefixes).where("elements is null").select("id").distinct(), "join-short")
    again = shared_dir(spark, "join-again")
    _prefixes(docs.join(few(short), "id", "left_semi"), n, percent, hot).select("id", "n_shingles", "elements").write.parquet(again)
    remove(spark, folder)
    known = spark.read.parquet(prefixes, again)
    # what brings sets together: elements in the prefixes of two sets
    reps = few(equal.select(F.col("rep").alias("id")))
    packed = F.shiftleft(F.col("n_shingles"), 32)
    entries = known.where("elements is not null").join(reps, "id", "left_semi").select("id", packed.alias("n"), F.posexplode("elements").alias("i", "e")).select("e", "id", (F.col("n") + F.col("i")).alias("at"))
    last = F.broadcast(spark.createDataFrame([(int(e),) for e in hot.view(np.int64)], "e long"))  # MOST_HOT rows at most
    often = entries.join(last, "e", "left_semi").select("id", "e")
    stars = often.join(F.broadcast(often.groupBy("e").agg(F.min("id").alias("least"))), "e").select(F.col("least").alias("a"), F.col("id").alias("b"))
    whole = Window.partitionBy("e")
    rest = entries.join(last, "e", "left_anti").repartition(partitions(spark), "e").withColumn("c", F.count("*").over(whole)).withColumn("least", F.min("id").over(whole))
    rest = cut(rest.where("c > 1").select("e", "id", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("i"), "c", "least"), "join-entries")
    stars = stars.unionByName(rest.where(F.col("c") > HOT).select(F.col("least").alias("a"), F.col("id").alias("b"))).where("a <> b")
    pairs = _promising(rest.where(F.col("c") <= HOT).select("e", "id", "n", "i"), percent)
    meet = cut(stars.distinct().withColumn("star", F.lit(True)).unionByName(pairs.withColumn("star", F.lit(False))), "join-meet")
    remove(spark, prefixes)
    remove(spark, again)
    sizes = own.groupBy("id").agg(F.max("n_shingles").alias("n"))
    asked, large = _sized(meet, sizes)
    whole_groups = asked.where("blocks = 1").select("id", _task(0, F.lit("g"), "grp"), F.col("id").alias("label"), F.lit(False).alias("probe"))
    if large:
        # of groups too large for a task, the sets that hot shingles join are grouped again; other pairs are looked at one by one
        part = cut(meet.join(asked.where("blocks > 1").select(F.col("id").alias("a")), "a", "left_semi"), "join-part")
        asked, large = _sized(part.where("star"), sizes)
        first_of = part.where("not star").select("a", F.col("b").alias("id"), _task(1, F.lit("p"), "a", F.pmod(F.xxhash64("b"), F.expr(f"count(*) over (partition by a) div {FAN} + 1"))))
        probing = first_of.select("task", F.col("a").alias("id")).distinct().withColumn("probe", F.lit(True))
        whole_groups = whole_groups.unionByName(first_of.select("task", "id").withColumn("probe", F.lit(False)).unionByName(probing).withColumn("label", F.col("id")))
    else:
        asked = asked.where("blocks > 1")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    anchor = F.pmod(F.xxhash64("id", F.lit(1)), F.expr(f"members div {ANCHORS} + 1")) == 0
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    tasks = asked.select("id", F.explode(F.when(anchor, everywhere).otherwise(F.array(block))).alias("block"), "grp")
    tasks = tasks.select("id", _task(0, F.lit("b"), "grp", "block"), F.col("id").alias("label"), F.lit(False).alias("probe"))
    tasks = cut(tasks.unionByName(whole_groups), "join-tasks")
    links = cut(_joined(docs.join(few(tasks), "id"), n, percent, hot), "join-links")
    classes = components(links)
    if large:
        # what is still outside the largest class of a large group meets every block of the group
        placed = cut(asked.where("blocks > 1").join(classes.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "grp", "blocks", F.coalesce("component", "id").alias("label")), "join-large")
        main = placed.groupBy("grp", "label").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max_by("label", "c").alias("main"))
        placed = placed.join(main, "grp")
        outside = placed.where("label <> main")
        chunks = outside.groupBy("grp").agg(F.expr(f"(sum(n) + {BLOCK - 1}) div {BLOCK}").alias("chunks"))
        placed, outside = placed.join(chunks, "grp"), outside.join(chunks, "grp")
        chunk = F.pmod(F.xxhash64("id", F.lit(2)), F.col("chunks"))
        several = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
        row = lambda df, b, c, probe: df.select(_task(1, F.lit("c"), "grp", b, c), "id", "label", F.lit(probe).alias("probe"))
        stored = row(placed.withColumn("c", F.explode(several)), block, F.col("c"), False)
        probing = row(outside.withColumn("b", F.explode(everywhere)), F.col("b"), chunk, True)
        tasks = stored.unionByName(probing).groupBy("task", "id").agg(F.first("label").alias("label"), F.max("probe").alias("probe"))
        classes = components(links.unionByName(cut(_joined(docs.join(few(cut(tasks, "join-probes")), "id"), n, percent, hot), "join-more-links")))
    found = own.join(equal, ["d1", "d2"], "left").join(classes, F.col("rep") == F.col("node"), "left")
    return found.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, that of the smallest id; only rows that may have to go are shuffled."""
    gone = ngram_join(docs, n, percent, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).cast("long").alias("key")).distinct()
    gone = cut(gone, "join-gone")
    apart, near = bloom.split(docs.select(packed(docs), F.col(id_col).cast("long").alias("key")), gone)
    return apart.unionByName(near.join(gone.hint("merge"), "key", "left_anti")).select("own.*")
