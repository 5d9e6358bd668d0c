"""Similar items by eight signals, admitted only through an anchor.

An anchor is a shared error signature, a common neighbour, files of which half of the smaller set are shared, or files that change
together. The number of admitted pairs grows with the square of a group, so pairs are never shuffled or stored: items are dealt
over blocks, asked items are sent to every block, and a task (similar_blocks.py) finds and scores the pairs of its block. Words
travel as numbers. All signals are symmetric.
"""

from __future__ import annotations

import math
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..storage import cut
from .similar_blocks import Block, cells

#: Weights of the signals, which of them anchor, the share of a hub, its weight, least shares and supports, basket sizes, days.
WEIGHTS = {"lexical": 1.0, "title": 2.0, "signature": 4.0, "files_direct": 4.0, "files_analog": 1.0, "cochange": 3.0, "structural": 2.0, "context": 1.0}
ANCHORS = ("signature", "files_direct", "structural", "cochange")
HUB_SHARE, HUB_FLOOR, LEAST_SHARE, HUB_SUPPORT, BASKET, NEAR_DAYS = 0.5, 0.25, 0.5, 2, (2, 50), 30
#: Words and items of a block (with signatures or not), parts of the asked items for blocks with signatures, partitions a task, words
#: joined by broadcast. Only speed, memory and disk depend on them.
BLOCK_WORDS, BLOCK_ITEMS, SPLIT, SPREAD, HOT = {True: 3_000_000, False: 10_000_000}, 200_000, 6, 4, 150_000
#: Keys (numbers of items, paths) of a semi-join by broadcast, at most, and reached items (16 bytes or so each); beyond, they are
#: shuffled. Only speed and memory depend on them.
FEW, NEAR = 500_000, 4_000_000


def coupled(merged_files: DataFrame, hubs: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(fa, fb, support, na, nb, anchors): co-changed files of merged pull requests with 2 to 50 files, both ways; with of(path) only these as fa."""
    baskets = merged_files.groupBy("number").agg(F.collect_set("path").alias("files")).where(F.size("files").between(*BASKET)).select("files")
    population = baskets.agg(F.count("*").alias("population"))
    support = baskets.select(F.explode("files").alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    pairs = baskets.select("files", F.explode("files").alias("fa"))
    if of is not None:
        pairs = pairs.join(small(of.select(F.col("path").alias("fa")).distinct()), "fa", "left_semi")
    pairs = pairs.select("fa", F.explode("files").alias("fb")).where("fa <> fb").groupBy("fa", "fb").agg(F.count("*").alias("support"))
    pairs = pairs.join(support.select(F.col("path").alias("fa"), F.col("n").alias("na")), "fa").join(support.select(F.col("path").alias("fb"), F.col("n").alias("nb")), "fb")
    hub = hubs.select("path", F.lit(True).alias("hub"))
    pairs = pairs.join(hub.withColumnsRenamed({"path": "fa", "hub": "hub_a"}), "fa", "left").join(hub.withColumnsRenamed({"path": "fb", "hub": "hub_b"}), "fb", "left").join(F.broadcast(population))
    lifted = F.col("population") * F.col("support") > F.col("na") * F.col("nb")
    some = F.coalesce("hub_a", "hub_b", F.lit(False))
    return pairs.select("fa", "fb", "support", "na", "nb", (lifted & (~some | (F.col("support") >= HUB_SUPPORT))).alias("anchors"))


def small(keys: DataFrame) -> DataFrame:
    """Keys to be joined by broadcast if they are FEW. Counts them, so it's for what is quickly read."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def reached(asked: DataFrame, paths: DataFrame, signatures: DataFrame, neighbours: DataFrame, pairs: DataFrame) -> DataFrame:
    """(number) of asked(number) and of all items that an anchor can pair with one: no other item has an admitted pair. pairs is coupled's table of the files of asked."""
    few = small(asked.distinct())
    held = lambda rows, c: rows.join(few, "number", "left_semi").select(c)
    files = cut(held(paths, "path").unionByName(pairs.where("anchors").select(F.col("fb").alias("path"))).distinct(), "reached-files")
    met = [asked, paths.join(small(files), "path", "left_semi")]
    met += [rows.join(held(rows, c).distinct(), c, "left_semi") for rows, c in ((signatures, "signature"), (neighbours, "other"))]
    return reduce(DataFrame.unionByName, [m.select("number") for m in met]).distinct()


def hub_files(merged_files: DataFrame, items: DataFrame, share: float = HUB_SHARE) -> DataFrame:
    """(path): files that at least such a share of merged pull requests touch; 1 / share of them at most per file of a request."""
    total = items.where("kind = 'pr' and merged is not null").agg(F.count("*").alias("total"))
    rows = merged_files.select("number", "path")
    often = rows.groupBy("path").agg(F.count("*").alias("n")).join(F.broadcast(total)).where(F.col("n") >= share * F.col("total")).select("path", "total")  # the same number twice counts too
    return rows.join(F.broadcast(often), "path").groupBy("path", "total").agg(F.countDistinct("number").alias("n")).where(F.col("n") >= share * F.col("total")).select("path")


def item_words(items: DataFrame) -> DataFrame:
    """items with words and title_words: cheaper to find again than to keep or shuffle."""
    return items.withColumns({"words": terms(F.concat_ws(" ", "title", "body")), "title_words": terms(F.col("title"))})


def profiles(items: DataFrame, labels: DataFrame, paths: DataFrame, signatures: DataFrame, neighbours: DataFrame, hubs: DataFrame) -> DataFrame:
    """One row an item: its number of words and title words, labels, files (with folders, names, hubs, weight), signatures, neighbours. paths(number, path), signatures(number, signature), neighbours(number, other)."""
    grouped = lambda rows, value, name: rows.groupBy("number").agg(F.array_sort(F.collect_set(value)).alias(name))
    weighed = paths.distinct().join(hubs.select("path", F.lit(True).alias("hub")), "path", "left").select("number", F.struct("path", F.coalesce("hub", F.lit(False)).alias("hub")).alias("file"))
    files = grouped(weighed, "file", "files").select("number", F.col("files.path").alias("paths"), F.col("files.hub").alias("hubs"))
    parts = [grouped(labels, "name", "labels"), files, grouped(signatures, "signature", "signatures"), grouped(neighbours, "other", "neighbours")]
    own = item_words(items).select("number", F.size("words").alias("n_words"), F.size("title_words").alias("n_title"), "author", "created", "due")
    rows = reduce(lambda df, p: df.join(p, "number", "left"), parts, own)
    rows = rows.withColumns({c: F.coalesce(c, F.array()) for c in ("labels", "paths", "hubs", "signatures", "neighbours")})
    part = lambda pattern: F.transform("paths", lambda p: F.regexp_extract(p, pattern, 1))
    weight = F.aggregate("hubs", F.lit(0.0), lambda sum_, hub: sum_ + F.when(hub, HUB_FLOOR).otherwise(1.0))
    return rows.withColumns({"folders": part(r"^(.*)/[^/]*$"), "names": part(r"([^/]*)$"), "weight": weight})


def vocabulary(items: DataFrame) -> DataFrame:
    """(word, df, id, idf) of the words that two items hold at least: id counts from 0, idf is ln(1 + N / df) over all items. Written once."""
    total = items.agg(F.count("*").alias("total"))
    often = item_words(items).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")).where("df > 1").join(F.broadcast(total))
    rows = cut(often.select("word", "df", F.log(1 + F.col("total") / F.col("df")).alias("idf"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "similar-words")
    parts = rows.groupBy("part").agg(F.min("at").alias("least"), (F.max("at") - F.min("at") + 1).alias("n"))  # a row a task that wrote
    before = parts.select("part", "least", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("word", "df", "part", (F.col("before") + F.col("at") - F.col("least")).cast("int").alias("id"), "idf")


def numbered(profiles_: DataFrame, own: DataFrame, words: DataFrame, items: DataFrame) -> DataFrame:
    """profiles with their own items' words as an array of id * 2, plus 1 in the title, and idf, the sum over all words. The HOT commonest words are joined by broadcast."""
    counts = words.agg(*[F.count_if(F.col("df") >= 2**k).alias(f"n{k}") for k in range(1, 40)]).first()
    least = next(2**k for k in range(1, 40) if counts[f"n{k}"] <= HOT)
    each = item_words(own).select("number", F.explode("words").alias("word"), F.array_contains("title_words", F.col("word")).alias("titled"))
    common, rare = (words.where(x).select("word", "id", "idf") for x in (F.col("df") >= least, F.col("df") < least))
    found = each.join(F.broadcast(common), "word").unionByName(each.join(F.broadcast(common.select("word")), "word", "left_anti").join(rare, "word"))
    coded = found.groupBy("number").agg(F.collect_list((F.col("id") * 2 + F.col("titled").cast("int")).cast("int")).alias("codes"), F.sum("idf").alias("idf"))
    total = items.agg(F.log(1 + F.count("*")).alias("alone"))
    rows = profiles_.join(coded, "number", "left").join(F.broadcast(total)).withColumn("codes", F.array_sort(F.coalesce("codes", F.array().cast("array<int>"))))
    alone = (F.col("n_words") - F.size("codes")) * F.col("alone")  # a word that no other item holds
    return rows.select(*profiles_.columns, F.col("codes").alias("words"), (F.coalesce("idf", F.lit(0.0)) + alone).alias("idf"))


def scored(asked: DataFrame, all_: DataFrame, items: DataFrame, pairs: DataFrame, best: int | None = None, every: bool = False, own: DataFrame | None = None) -> DataFrame:
    """(a, b, signals, share, lifted) of the admitted pairs of asked(number) with all_, profiles of items; pairs is coupled's table.

    Where all_ is a part of items, own holds at least the items of that part; words weigh by all items. best leaves out pairs that can't be among so many best of their a by total; every gives all pairs, admitted or not.
    """
    with_signature = F.size("signatures") > 0
    sized = all_.groupBy(with_signature.alias("s")).agg(F.sum("n_words").alias("words"), F.count("*").alias("n")).collect()
    blocks = lambda s: max([1, *[math.ceil(max(r["words"] / BLOCK_WORDS[s], r["n"] / BLOCK_ITEMS)) for r in sized if r["s"] == s]])
    n_signed, n_rest = blocks(True), blocks(False)
    tasks = n_signed * SPLIT + n_rest
    words = vocabulary(items)
    to = all_.select("number", "paths").join(asked.select("number").distinct(), "number", "left_semi").select("number", F.explode("paths").alias("fa")).join(pairs, "fa")
    to = to.groupBy("number", "fb").agg(F.max(F.col("support") / F.greatest("na", "nb")).alias("by"), F.max("anchors").alias("up")).groupBy("number").agg(F.collect_list(F.struct("fb", "by", "up")).alias("moved"))
    rows = numbered(all_, own or items, words, items).join(asked.select("number", F.lit(True).alias("asks")).distinct(), "number", "left").join(to, "number", "left")
    own_tasks = F.when(with_signature, F.transform(F.sequence(F.lit(0), F.lit(SPLIT - 1)), lambda c: F.pmod(F.hash("number"), F.lit(n_signed)) * SPLIT + c)).otherwise(F.array(n_signed * SPLIT + F.pmod(F.hash("number"), F.lit(n_rest))))
    share = F.pmod(F.xxhash64("number"), F.lit(SPLIT)).cast("int")
    asks = F.concat(F.transform(F.sequence(F.lit(0), F.lit(n_signed - 1)), lambda b: b * SPLIT + share), F.sequence(F.lit(n_signed * SPLIT), F.lit(tasks - 1)))
    moved = lambda c: F.coalesce(F.when(F.col("kind") == 2, F.col(f"moved.{c}")), F.array())
    of = lambda kind: lambda t: F.struct(t.cast("int").alias("task"), F.lit(kind).alias("kind"))
    dealt = F.concat(F.transform(own_tasks, of(1)), F.transform(F.when(F.col("asks"), asks).otherwise(F.array().cast("array<int>")), of(2)))
    rows = rows.select("*", F.explode(dealt).alias("to")).select("*", "to.*").withColumns({"moved_to": moved("fb"), "moved_by": moved("by"), "moved_up": moved("up")}).drop("asks", "moved", "to")
    weights = words.groupBy("part").agg(F.collect_list(F.struct("id", "idf")).alias("w")).select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(0).alias("kind"), F.col("w.id").alias("words"), F.col("w.idf").alias("moved_by"))
    rows = rows.unionByName(weights, allowMissingColumns=True).repartition(SPREAD * tasks, "task").sortWithinPartitions("task", "kind")
    make = partial(Block, weights=WEIGHTS, hub_weight=HUB_FLOOR, least_share=LEAST_SHARE, near_days=NEAR_DAYS, best=best, every=every)
    names = [("a", "long"), ("b", "long"), *[(n, "double") for n in WEIGHTS], ("share", "boolean"), ("lifted", "boolean")]
    arrow = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return rows.mapInArrow(cells(make, pa.schema([(n, arrow[t]) for n, t in names])), ", ".join(f"{n} {t}" for n, t in names))


def anchored(scored: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Admitted pairs with total and anchors, the strongest first; the others go."""
    fires = {"signature": F.col("signature") > 0, "files_direct": F.col("share"), "structural": F.col("structural") > 0, "cochange": F.col("lifted")}
    fired = F.filter(F.array(*[F.when(fires[n], F.struct((-F.lit(weights[n]) * F.col(n)).alias("w"), F.lit(n).alias("name"))) for n in ANCHORS]), lambda x: x.isNotNull())
    total = sum((F.lit(w) * F.col(n) for n, w in weights.items()), F.lit(0.0))
    return scored.withColumn("anchors", F.transform(F.array_sort(fired), lambda x: x["name"])).where("size(anchors) > 0").withColumn("total", total)


def ranked(admitted: DataFrame, limit: int) -> DataFrame:
    """The best partners of every a: total (9 digits) descending, number."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("total", 9)), "b"))
    return admitted.withColumn("rank", rank).where(F.col("rank") <= limit)


def explain(scored: DataFrame, a: int, b: int, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(signal, score, weight, part, anchor) of one pair."""
    one = scored.where((F.col("a") == a) & (F.col("b") == b))
    cells = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("score"), F.lit(w).alias("weight"), (F.col(n) * w).alias("part"), F.lit(n in ANCHORS).alias("can_anchor")) for n, w in weights.items()])
    return one.select(F.explode(cells).alias("c")).select("c.*")
