"""Byte-level BPE: Spark's higher-order functions fold ranked merges over the bytes of distinct words.

encode: the distinct words of the whole corpus are counted (partial aggregation first). Those that occur most, HOT_WORDS
at most, are folded once and written as a word table to the shared folder. Each text is then split and looked up in
one Arrow pass per document, which leaves gaps for words that the table lacks; those are folded where they stand, by
the same expression, but for words of more than LONG characters (blobs, rules of dashes), which the Arrow pass folds with a heap
in n log n. So no text and no position is ever shuffled, what a worker holds is bounded, and the result
doesn't depend on which words are in the table.

The rank map is a literal: the rank of each mergeable pair of pieces, as a perfect-hash table in one array of longs
(displacements in another), read by position; pairs of single bytes have a table of their own. A word starts as its bytes'
pieces, each with its rank; the fold merges the leftmost pair of least rank until no pair has a rank, and looks up only
the new pairs after each merge.

decode concatenates the binary pieces of the ids.

Defined cases: null and empty texts have no tokens (ids is the empty string); the pattern's classes are Unicode's;
special tokens don't exist; repeated rows are encoded one by one; an empty table gives an empty result; other columns keep their
values whatever their names, one named like the output is replaced.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column as ClassicColumn

from .common import cut, opened, packed, shared_dir
from .shingles import sliced

#: Bounds of the word table: words, and bytes of a word. Only speed depends on them.
HOT_WORDS, HOT_BYTES = 800_000, 24
#: A worker and its task hold a batch of texts each, four batches a core: the session's batches are made no larger than this.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
#: Words that hold this character stay out of the table, where it parts the others.
MARK = "\0"
#: Words of more characters are folded with a heap, in time n log n; the fold over arrays takes time that grows with the square.
LONG = 64


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file (base64 token, space, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: Multipliers of the hash functions; a key below 2^32 times one of these stays below 2^63.
MULTIPLIERS = (1_640_531_527, 2_147_483_629, 1_812_433_253)
#: The rank of a pair that doesn't merge; ranks are below it.
NONE = 1 << 16


def perfect(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The displacement of each group and the slot of each key below 2^32; no two keys share a slot."""
    slots = 1 << max(4, int(len(keys) * 1.6).bit_length())
    g, s, d = ((keys * m) >> 24 for m in MULTIPLIERS)
    g, s, d = g & (slots // 8 - 1), s & (slots - 1), d & (slots - 1) | 1
    order = np.argsort(g, kind="stable")
    bounds = np.searchsorted(g[order], np.arange(slots // 8 + 1))
    used, shift, place = bytearray(slots), np.zeros(slots // 8, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    for group in np.argsort(bounds[:-1] - bounds[1:], kind="stable"):  # the fullest first
        members = order[bounds[group] : bounds[group + 1]]
        own = list(zip(s[members].tolist(), d[members].tolist(), strict=True))
        for x in range(slots):
            at = [(i + x * step) & (slots - 1) for i, step in own]
            if len(set(at)) == len(at) and not any(used[i] for i in at):
                break
        else:
            raise ValueError("keys can't be told apart")
        for i in at:
            used[i] = 1
        shift[group], place[members] = x, at
    return shift, place


def _literals(one_row: DataFrame) -> list[Column]:
    """The arrays of a table of one row, each as one literal in the row format, which tasks read by position as it is."""
    row = one_row._jdf.queryExecution().executedPlan().executeCollect()[0]
    jvm = one_row.sparkSession._jvm
    types = [f.dataType.simpleString() for f in one_row.schema.fields]
    exprs = [jvm.org.apache.spark.sql.catalyst.expressions.Literal(row.getArray(i), jvm.org.apache.spark.sql.types.DataType.fromDDL(t)) for i, t in enumerate(types)]
    return [ClassicColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(e)) for e in exprs]


def _get(array: Column, index: Column) -> Column:
    return F.get(array, index.cast("int"))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


class RankMap:
    """The literal tables of one vocabulary, and the expressions that read them."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ranks must be below 65,536")
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = rank
        keys = np.array(list(pairs), dtype=np.int64)
        shifts, place = perfect(keys)
        self.groups, self.slots = len(shifts), 8 * len(shifts)
        table = np.full(self.slots, 1 << 62, dtype=np.int64)  # key << 16 | rank in each slot, or what no key gives
        table[place] = keys << 16 | np.array(list(pairs.values()), dtype=np.int64)
        # what a word's state starts from: by the next byte (256: none) and the byte, its rank with it and its piece
        single = [ranks[bytes([i])] for i in range(256)]
        first = [(pairs.get(single[x] << 16 | single[y], NONE) if y < 256 else NONE) << 43 | single[x] for y in range(257) for x in range(256)]
        one_row = spark.createDataFrame([(shifts.tolist(), table.tolist(), first)], "a array<bigint>, b array<bigint>, c array<bigint>")
        self.shifts, self.table, self.pairs = _literals(one_row)

    def rank(self, a: Column, b: Column) -> Column:
        """The rank of the pair of pieces a, b; NONE if they don't merge."""
        part = lambda k, i, n: F.shiftright(k * MULTIPLIERS[i], 24).bitwiseAND(n - 1)
        slot = lambda k: (part(k, 1, self.slots) + _get(self.shifts, part(k, 0, self.groups)) * part(k, 2, self.slots).bitwiseOR(1)).bitwiseAND(self.slots - 1)
        return _let(F.shiftleft(a, 16) + b, lambda k: F.least(_get(self.table, slot(k)).bitwiseXOR(F.shiftleft(k, 16)), F.lit(NONE).cast("long")))

    def fold(self, word: Column) -> Column:
        """The ids (array of ints) of a string's bytes.

        The state is one array of longs, each a piece with where it starts and the rank it merges by with the next one:
        rank << 43 | start << 16 | piece. So the least long is the leftmost pair of least rank.
        """
        piece = lambda x: x.bitwiseAND(65535)
        with_rank = lambda x, rank: x.bitwiseAND((1 << 43) - 1) + F.shiftleft(rank, 43)

        def merge(q: Column, low: Column, at: Column) -> Column:
            """q with the pair of low, at place `at` from 1, and what follows made one; its id is the pair's rank. Starts tell all longs apart."""
            made, after = F.shiftright(low, 43), _get(q, at + 1)
            own = low.bitwiseAND(((1 << 27) - 1) << 16) + made + F.shiftleft(F.when(after.isNull(), F.lit(NONE).cast("long")).otherwise(self.rank(made, piece(after))), 43)
            changed = lambda x, i: F.when(x == low, own).when(i + 2 == at, with_rank(x, self.rank(piece(x), made))).otherwise(x)
            return F.transform(F.array_remove(q, _get(q, at)), changed)

        def step(q: Column, _: Column) -> Column:
            merged = lambda low: _let(F.array_position(q, low).cast("int"), lambda at: merge(q, low, at))
            return _let(F.array_min(q), lambda low: F.when(low >= NONE << 43, q).otherwise(merged(low)))

        def whole(b: Column) -> Column:
            q = F.transform(b, lambda x, i: _get(self.pairs, F.shiftleft(F.coalesce(_get(b, i + 1), F.lit(256)), 8) + x) + F.shiftleft(i.cast("long"), 16))
            return F.when(F.size(b) < 2, q).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(b)), q, step))

        chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        folded = _let(F.transform(F.filter(chars, lambda c: c != ""), F.ascii), whole)
        return F.transform(folded, lambda x: piece(x).cast("int"))


def latin(pattern: str) -> str | None:
    """A pattern of the plain `re` module that matches in texts of Latin-1 characters alone what `pattern` does; None if it isn't known to.

    Unicode classes become the Latin-1 characters they hold. Only literals, groups, classes, alternatives and repeats are known.
    """
    held = lambda kind: "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i)).startswith(kind))
    space = r"\t-\r \x85\xa0"
    out, i, inside = "", 0, False
    while i < len(pattern):
        if m := re.compile(r"\\p\{([A-Z][a-z]?)\}").match(pattern, i):
            out += held(m.group(1)) if inside else f"[{held(m.group(1))}]"
        elif m := re.compile(r"\\s").match(pattern, i):
            out += space if inside else f"[{space}]"
        elif not inside and (m := re.compile(r"\\S").match(pattern, i)):
            out += f"[^{space}]"
        elif m := re.compile(r"\(\?(?:!|=|:)|[^\\]").match(pattern, i):
            if m.group() == "(" and pattern[i + 1 : i + 2] == "?":
                return None
            inside = m.group() == "[" or (inside and m.group() != "]")
            out += m.group()
        else:
            return None
        i = m.end()
    return out


def splitter(pattern: str):
    """The pre-tokeniser: the matches of a text, one after the other."""
    any_text, plain = regex.compile(pattern).findall, latin(pattern)
    if plain is None:
        return any_text
    latin_text = re.compile(plain).findall

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return any_text(text)
        return latin_text(text)

    return find


def words(text: Column, pattern: str) -> Column:
    """The pre-tokeniser's matches; (?U) gives white space its Unicode meaning."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def distinct_words(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts."""
    return docs.select(F.explode(words(F.col(text_col), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def hot_part(counted: DataFrame, most: int) -> DataFrame:
    """The rows of counted(word, n) whose n is so high that at most `most` words have it."""
    room, least = most, None
    for row in counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        room -= row["words"]
        if room < 0:
            break
        least = row["n"]
    return counted.where(F.lit(False) if least is None else F.col("n") >= least)


def _table(uri: str) -> dict[str, str]:
    """word -> ids joined by spaces, from the shared folder; a task holds it no longer than it runs."""
    import pyarrow.parquet as pq

    fs, path = opened(uri)
    table: dict[str, str] = {}
    for info in fs.get_file_info(pa.fs.FileSelector(path)):
        if info.path.endswith(".parquet"):
            for batch in pq.ParquetFile(fs.open_input_file(info.path)).iter_batches(columns=["word", "ids"], use_threads=False):
                table.update(zip(_strings(batch.column(0)), _strings(batch.column(1)), strict=True))
    return table


def _strings(array: pa.Array) -> list[str]:
    """An array of strings without MARK, a few times faster than one by one."""
    if not len(array):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array.cast(pa.string()))
    return pa.compute.binary_join(whole, MARK)[0].as_py().split(MARK)


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word of any length in n log n: a heap of mergeable pairs over a linked list of pieces.

    A heap entry is (rank, start of the left piece); it is stale unless the pair that starts there still has this rank.
    """
    size = len(word)
    end, before = list(range(1, size + 1)), list(range(-1, size - 1))  # of the piece that starts here; end 0: merged away
    heap = [(rank, i) for i in range(size - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = end[i]
        if not j or j == size or ranks.get(word[i : end[j]]) != rank:
            continue
        k = end[i] = end[j]
        end[j] = 0
        if k < size:
            before[k] = i
            if (after := ranks.get(word[i : end[k]])) is not None:
                heapq.heappush(heap, (after, i))
        h = before[i]
        if h >= 0 and (ahead := ranks.get(word[h:k])) is not None:
            heapq.heappush(heap, (ahead, h))
    out, i = [], 0
    while i < size:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _gapped(docs: DataFrame, uri: str, ranks: dict[bytes, int], pattern: str, text_col: str, keep_text: bool) -> DataFrame:
    """(own, g): docs' columns as a struct, and the ids of each text as strings, cut at the words that the table lacks, and those words.

    The text goes to Python once, and comes back only if it is to be kept.
    """
    rest = docs if keep_text else docs.drop(text_col)
    if not rest.columns:
        raise ValueError("no column is left")
    rows, known = docs.select(packed(rest), F.col(text_col).cast("string").alias("text")), docs.sparkSession.sparkContext.broadcast(ranks)
    own = docs.select(packed(rest)).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, find = None, splitter(pattern)

        def ids_of(word: str) -> str | None:
            found = table.get(word)
            if found is None and len(word) > LONG:
                found = " ".join(map(str, fold_long(word.encode(), known.value)))
            return found

        for batch in sliced(batches):
            table = _table(uri) if table is None else table
            segs, rest = [], []
            for text in batch.column(1):
                found = find(text.as_py() or "")
                ids = list(map(table.get, found))
                if None in ids:
                    ids = [ids_of(w) if x is None else x for w, x in zip(found, ids, strict=True)]
                gaps = [i for i, x in enumerate(ids) if x is None]
                segs.append([" ".join(ids[i:j]) for i, j in zip([0, *(i + 1 for i in gaps)], [*gaps, len(ids)], strict=True)])
                rest.append([found[i] for i in gaps])
            g = pa.StructArray.from_arrays([pa.array(segs, pa.list_(pa.string())), pa.array(rest, pa.list_(pa.string()))], ["segs", "rest"])
            yield pa.RecordBatch.from_arrays([batch.column(0), g], ["own", "g"])

    if keep_text:  # one copy of it is enough
        at, rows = docs.columns.index(text_col), docs.select(packed(docs))
        whole = run
        run = lambda batches: whole(pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(at)], ["own", "text"]) for b in batches)
    return rows.mapInArrow(run, T.StructType([*own, *T._parse_datatype_string("g struct<segs:array<string>,rest:array<string>>").fields]))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", out: str = "ids", hot_words: int = HOT_WORDS, keep_text: bool = True) -> DataFrame:
    """docs with the ids of each whole text, decimal and joined by one space, in column `out`; without the text if it isn't to be kept."""
    spark = docs.sparkSession
    if int(spark.conf.get(BATCH, "10000")) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    ranked = RankMap(spark, ranks)
    joined = lambda word: F.array_join(ranked.fold(word).cast("array<string>"), " ")
    apt = (F.octet_length("word") <= HOT_BYTES) & ~F.contains("word", F.lit(MARK)) & (F.col("n") > 1)
    counted = cut(distinct_words(docs, pattern, text_col).where(apt), "bpe-words")
    hot = hot_part(counted, hot_words).select("word").repartition(max(2, spark.sparkContext.defaultParallelism))
    uri = shared_dir(spark, "bpe-table")
    hot.select("word", joined(F.col("word")).alias("ids")).write.parquet(uri)
    filled = F.zip_with("g.segs", F.transform("g.rest", joined), lambda seg, ids: F.array(seg, ids))
    gapped = _gapped(docs.drop(out), uri, ranks, pattern, text_col, keep_text)
    return gapped.select("own", F.array_join(F.filter(F.flatten(filled), lambda x: x != ""), " ").alias("made")).select("own.*", F.col("made").alias(out))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the bytes of the pieces of `ids`, one after the other, in column `out`; null ids give null."""
    pieces = {str(rank): token for token, rank in ranks.items()}
    kept = encoded.drop(out)
    rows, at = kept.select(packed(kept)), kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [b"".join(map(pieces.__getitem__, x.as_py().split())) if x.is_valid else None for x in batch.column(0).field(at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["own", "bytes"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("bytes", T.BinaryType())])).select("own.*", F.col("bytes").alias(out))


def n_ids(ids: Column) -> Column:
    return F.when(ids == "", 0).otherwise(F.char_length(ids) - F.char_length(F.replace(ids, F.lit(" "), F.lit(""))) + 1).cast("long")
