"""Substring dedup by sliding sentence spans.

A text is cut into sentences at line ends and after . ! or ?. From every start the shortest run of RUN consecutive sentences or
more that holds LEAST_WORDS words is hashed, and likewise the shortest that reaches back from every end, so that a repeated
stretch of that size is covered from its first sentence to its last, however short they are; the hashes of all texts are grouped
(partial aggregation first) for the first place of each that repeats, and every sentence that stands in a span which is not the
first of its kind is removed. The first place is the least (id, position), so one copy of everything stays.

Sentences are cut and hashed in an Arrow pass (prefix sums of words find the runs, one of hashes times powers theirs), and so are
those of a text removed. Only (hash, id, position) rows shuffle, and the texts that lose something: a Bloom filter of their ids
(bloom.py) lets all others pass straight through, at every size. The first places of the commonest spans are broadcast (meet).

Defined cases: case (A-Z) and the amount of white space (ASCII) within a sentence don't count; null and empty texts have no
sentences and stay as they are; texts without a repeated span keep every byte; others lose their sentences with the
white space that follows; rows that repeat an id are cut alike, at the places that repeat in any of them; rows of null ids
stay as they are; an empty table gives an empty result; other columns, of whatever name, keep their values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import cut, meet, packed
from .shingles import sliced, stir

#: Passages of over 50 words are looked for; of those, what lies in whole sentences must hold LEAST_WORDS.
RUN, LEAST_WORDS = 2, 30
#: A sentence and the white space that follows it.
SENTENCE = re.compile(rb"\s*\S.*?(?:[.!?]+(?=\s|\Z)|(?=\n)|\Z)\s*", re.DOTALL)
#: An odd number, and what it is multiplied with to give 1 (mod 2^64).
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def sentences(text: bytes | None) -> list[bytes]:
    """The sentences of a text, which put together give the text (but for a text of white space alone)."""
    return SENTENCE.findall(text) if text else []


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(n, base, dtype=np.uint64))])


def runs_of(text: bytes | None, run: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (start from 0 << 32 | sentences) of the shortest runs from every start and to every end, and their hashes."""
    words = [s.lower().split() for s in sentences(text)]
    n = len(words)
    if n < run:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    upto = np.zeros(n + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=upto[1:])  # ascends, as a sentence has a word at least
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(w)) for w in words), dtype=np.uint64, count=n)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * _powers(BASE, n)[:n])])
    starts = np.arange(n + 1)
    ends = np.maximum(starts + run, np.searchsorted(upto, upto + least_words))
    begins = np.minimum(starts - run, np.searchsorted(upto, upto - least_words, "right") - 1)
    ahead, back = ends <= n, begins >= 0
    lo, hi = np.concatenate([starts[ahead], begins[back]]), np.concatenate([ends[ahead], starts[back]])
    places, first = np.unique(lo << 32 | (hi - lo), return_index=True)
    lo, hi = lo[first], hi[first]
    found = (sums[hi] - sums[lo]) * _powers(BACK, n)[lo] + (hi - lo).astype(np.uint64)
    return places, stir(found).view(np.int64)


def spans(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs(id, text) -> (id, at, hash) of the runs that count; at is a place."""

    def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [runs_of(t.as_py(), run, least_words) for t in batch.column(1)]
            ids = np.repeat(batch.column(0).to_numpy(), [len(p) for p, _ in found])
            both = [np.concatenate([x[k] for x in found]) if found else np.empty(0, dtype=np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(both[0]), pa.array(both[1])], ["id", "at", "hash"])

    return docs.where("id is not null").select("id", F.col("text").cast("binary")).mapInArrow(hash_runs, "id long, at long, hash long")


def repeated(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs(id, text) -> (id, places): those of spans that aren't the first of their kind."""
    all_of_them = cut(spans(docs, run, least_words), "span-hashes")
    first = all_of_them.groupBy("hash").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = meet(all_of_them, cut(first, "span-first"), "hash", "n").where(F.struct("id", "at") != F.col("first"))
    return later.groupBy("id").agg(F.collect_set("at").alias("places"))


def without(text: bytes | None, places: np.ndarray) -> tuple[bytes | None, int, int, int]:
    """The text without the sentences of these places (None: as it is), all its sentences, and those and the words removed."""
    parts = sentences(text)
    gone = np.zeros(len(parts) + 1, dtype=np.int64)
    starts = places >> 32
    ends = np.minimum(starts + (places & 0xFFFFFFFF), len(parts))  # a repeated id may have a shorter text
    np.add.at(gone, starts[starts < len(parts)], 1)
    np.add.at(gone, ends[starts < len(parts)], -1)
    gone = np.cumsum(gone)[:-1] > 0
    if not gone.any():
        return None, len(parts), 0, 0
    kept = b"".join(s for s, g in zip(parts, gone.tolist(), strict=True) if not g)
    return kept, len(parts), int(gone.sum()), sum(len(s.split()) for s, g in zip(parts, gone.tolist(), strict=True) if g)


def _cut_out(texts: pa.Array, places: pa.Array) -> pa.Array:
    none = np.empty(0, dtype=np.int64)
    found = [without(t.as_py(), p.values.to_numpy(zero_copy_only=False) if p.is_valid else none) for t, p in zip(texts, places, strict=True)]
    kinds = {"text": pa.binary(), "n_sentences": pa.int64(), "n_removed": pa.int64(), "words_removed": pa.int64()}
    return pa.StructArray.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds.values())], list(kinds))


def sentence_dedup(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut, and n_sentences, n_removed, words_removed (which replace columns of these names)."""
    marks = cut(repeated(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, least_words), "span-repeats")
    apart, near = bloom.split(docs.select(packed(docs), F.col(id_col).cast("long").alias("key")), marks.select(F.col("id").alias("key")))
    near = near.join(marks.hint("merge"), F.col("key") == F.col("id"), "left").select("own", "places")
    rows = apart.select("own", F.lit(None).cast("array<bigint>").alias("places")).unionByName(near)
    text = F.col("own")[text_col]
    cutter = F.arrow_udf(_cut_out, "struct<text:binary,n_sentences:bigint,n_removed:bigint,words_removed:bigint>")
    rows, counts = rows.select("own", cutter(text.cast("binary"), F.col("places")).alias("made")), ("n_sentences", "n_removed", "words_removed")
    text = F.when(F.col("made")["n_removed"] == 0, text).otherwise(F.col("made")["text"].cast("string"))
    return rows.select(*[(text if c == text_col else F.col("own")[c]).alias(c) for c in docs.columns if c.lower() not in counts], *[F.col("made")[c].alias(c) for c in counts])
