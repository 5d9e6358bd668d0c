"""Scores of asked items against a block of items, in numpy: what similarity.scored runs in its tasks.

A task gets the weights of words (kind 0), the items of its block (kind 1) and then asked items (kind 2). Features of the block are
kept both by item and by value. An asked item marks its partners through what can anchor a pair; each signal is then summed by the
shorter of both ways: over the partners' own features, or over the items that hold the asked item's.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of an Arrow batch that a task sends back; only speed depends on it.
OUT = 50_000
#: What totals may differ by and still be equal after rounding to nine digits.
NEAR = 2e-9


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, .. of sizes[i] each, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Lists:
    """A list column: item i holds values[at[i]:at[i + 1]], as numbers into its distinct values."""

    def __init__(self, column: pa.ListArray, known: pa.Array | None = None):
        flat = column.flatten()
        self.at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        if known is None:
            coded = flat.dictionary_encode()
            self.known, self.values = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        else:
            self.known, self.values = known, pc.fill_null(pc.index_in(flat, known), -1).to_numpy(zero_copy_only=False)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.at[i] : self.at[i + 1]]


class Index(Lists):
    """A block's list column, also by value."""

    def __init__(self, column: pa.ListArray):
        super().__init__(column)
        self.n, self.sizes, self.owners = len(column), np.diff(self.at), None
        self.df = np.bincount(self.values, minlength=len(self.known))
        self.start = np.cumsum(self.df) - self.df
        self.table = np.zeros(len(self.known))

    def holders(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items that hold one of these values, how many each value has)."""
        if self.owners is None:  # of the words few blocks need it
            self.owners = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes)[np.argsort(self.values, kind="stable")]
        sizes = self.df[own]
        return self.owners[_spread(self.start[own], sizes)], sizes

    def shared(self, own: np.ndarray, weights: np.ndarray, partners: np.ndarray) -> np.ndarray:
        """For each partner the sum of the weights of these values that it holds."""
        sizes = self.sizes[partners]
        if self.df[own].sum() <= sizes.sum():
            who, times = self.holders(own)
            return np.bincount(who, np.repeat(weights, times), self.n)[partners]
        self.table[own] = weights
        held = self.table[self.values[_spread(self.at[partners], sizes)]]
        self.table[own] = 0
        return np.bincount(np.repeat(np.arange(len(partners)), sizes), held, len(partners))


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _split(column: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """Word numbers, and those of the title (odd codes)."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    odd = np.flatnonzero(flat & 1)
    return pa.ListArray.from_arrays(at, pa.array(flat >> 1)), pa.ListArray.from_arrays(np.searchsorted(odd, at).astype(np.int32), pa.array(flat[odd] >> 1))


class Block:
    LISTS = ("labels", "paths", "folders", "names", "signatures", "neighbours")

    def __init__(self, idf: np.ndarray, rows: pa.RecordBatch, weights: dict[str, float], hub_weight: float, least_share: float, near_days: int, best: int | None, every: bool = False):
        col = rows.column
        self.idf, self.weights, self.hub_weight, self.least_share, self.near_s, self.best, self.every = idf, weights, hub_weight, least_share, near_days * 86_400, best, every
        self.number = col("number").to_numpy()
        words, title = _split(col("words"))
        self.lists = {c: Index(col(c)) for c in self.LISTS} | {"words": Index(words), "title": Index(title)}
        self.word_ids = self.lists["words"].known.to_numpy(zero_copy_only=False)
        self.total, self.n_title = col("idf").to_numpy(), col("n_title").to_numpy()
        self.weight = col("weight").to_numpy()
        authors = col("author").dictionary_encode()
        self.authors, self.author = authors.dictionary, pc.fill_null(authors.indices, -1).to_numpy(zero_copy_only=False)
        (self.created, self.dated), (self.due, self.is_due) = _numbers(col("created")), _numbers(col("due"))
        self.mark = np.zeros(len(self.number), bool)
        self.moved, self.lifted = np.zeros(len(self.number)), np.zeros(len(self.number), bool)

    def score(self, rows: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        """Columns a, b, signals, share, lifted of the admitted pairs of each asked item, or of every pair."""
        col, L = rows.column, self.lists
        words, title = _split(col("words"))
        own = {c: Lists(col(c), L[c].known) for c in self.LISTS} | {"words": Lists(words, L["words"].known), "title": Lists(title, L["title"].known)}
        moved = Lists(col("moved_to"), L["paths"].known)
        ratios, lifts = col("moved_by").flatten().to_numpy(zero_copy_only=False), col("moved_up").flatten().to_numpy(zero_copy_only=False)
        hubs = col("hubs").flatten().to_numpy(zero_copy_only=False)
        numbers, totals, n_titles, weights = (col(c).to_numpy() for c in ("number", "idf", "n_title", "weight"))
        authors = pc.fill_null(pc.index_in(col("author"), self.authors, skip_nulls=True), -2).to_numpy(zero_copy_only=False)
        (created, dated), (due, is_due) = _numbers(col("created")), _numbers(col("due"))
        folder_of, name_of = own["folders"], own["names"]
        for i in range(len(rows)):
            had = lambda c, i=i: (v := own[c].of(i))[v >= 0]
            at = slice(own["paths"].at[i], own["paths"].at[i + 1])
            paths = own["paths"].values[at]
            held = paths >= 0
            file_weights = np.where(hubs[at], self.hub_weight, 1.0)[held]
            paths = paths[held]
            there = slice(moved.at[i], moved.at[i + 1])
            to = moved.values[there]
            some = to >= 0
            by_move, times = L["paths"].holders(to[some])
            sets = [L["signatures"].holders(had("signatures"))[0], L["neighbours"].holders(had("neighbours"))[0], L["paths"].holders(paths)[0], by_move]
            for s in sets:
                self.mark[s] = True
            met = np.arange(len(self.mark)) if self.every else np.flatnonzero(self.mark)
            self.mark[met] = False
            met = met[self.number[met] != numbers[i]]
            if not len(met):
                continue
            up = np.repeat(lifts[there][some], times)
            np.maximum.at(self.moved, by_move, np.repeat(ratios[there][some], times))
            self.lifted[by_move[up]] = True
            count = lambda c, met: L[c].shared(v := had(c), np.ones(len(v)), met)
            n_paths, n_signatures = at.stop - at.start, len(own["signatures"].of(i))
            small = np.minimum(n_paths, L["paths"].sizes[met])
            files = L["paths"].shared(paths, np.ones(len(paths)), met)
            share = (small > 0) & (files / np.maximum(small, 1) >= self.least_share)
            signature, structural = count("signatures", met), count("neighbours", met)
            keep = share | self.lifted[met] | (signature > 0) | (structural > 0) | self.every
            met, small, share, signature, structural = (x[keep] for x in (met, small, share, signature, structural))
            cochange, lifted = self.moved[met], self.lifted[met]
            self.moved[by_move], self.lifted[by_move] = 0, False
            if not len(met):
                continue
            w = had("words")
            shared = L["words"].shared(w, self.idf[self.word_ids[w]], met)
            union = totals[i] + self.total[met] - shared
            titles = np.minimum(n_titles[i], self.n_title[met])
            both = L["paths"].shared(paths, file_weights, met)
            all_weight = weights[i] + self.weight[met] - both
            analog = self._analog(folder_of.of(i), name_of.of(i), paths, met)
            facets = (count("labels", met) > 0).astype(float) + (self.author[met] == authors[i]) + (self.is_due[met] & is_due[i] & (self.due[met] == due[i])) + (self.dated[met] & dated[i] & (np.abs(self.created[met] - created[i]) <= self.near_s))
            neighbours = len(own["neighbours"].of(i)) + L["neighbours"].sizes[met] - structural
            part = lambda x, of: np.where(of > 0, x / np.where(of > 0, of, 1), 0.0)
            scores = {
                "lexical": part(shared, union),
                "title": part(count("title", met), titles),
                "signature": part(signature, np.minimum(n_signatures, L["signatures"].sizes[met])),
                "files_direct": part(both, all_weight),
                "files_analog": np.minimum(1.0, analog / np.maximum(1, small)),
                "cochange": cochange,
                "structural": part(structural, neighbours),
                "context": facets / 4,
            }
            found = [self.number[met], *[scores[n] for n in self.weights], share, lifted]
            if self.best:
                kept = first(sum(k * scores[n] for n, k in self.weights.items()), self.number[met], self.best)
                found = [c[kept] for c in found]
            yield [np.full(len(found[0]), numbers[i]), *found]

    def _analog(self, folders: np.ndarray, names: np.ndarray, paths: np.ndarray, met: np.ndarray) -> np.ndarray:
        """For each partner the files that stand for each other: alone in a folder, or under a name, on either side without a shared one there."""
        n = np.zeros(len(met))
        files = self.lists["paths"]
        sizes = files.sizes[met]
        if not len(folders) or not sizes.sum():
            return n
        at, who = _spread(files.at[met], sizes), np.repeat(np.arange(len(met)), sizes)
        path = files.values[at]
        files.table[paths] = 1
        shared = files.table[path] > 0
        files.table[paths] = 0
        apart: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        for groups, keys in ((folders, self.lists["folders"].values[at]), (names, self.lists["names"].values[at])):
            apart.append([])
            for g in np.unique(groups[groups >= 0]):
                of = keys == g
                alone = np.bincount(who[of], minlength=len(met)) > 0
                alone[who[of & shared]] = False
                n += alone
                apart[-1].append((int(np.flatnonzero(groups == g)[0]), alone, of))
        for first_a, alone_a, of_a in apart[0]:  # the same two files under both count once
            for first_b, alone_b, of_b in apart[1]:
                if first_a == first_b and (twice := alone_a & alone_b).any():
                    first_of = lambda of: (u := np.unique(who[of], return_index=True), np.flatnonzero(of)[u[1]])
                    (ua, ia), (ub, ib) = first_of(of_a), first_of(of_b)
                    pa_, pb_ = np.full(len(met), -1), np.full(len(met), -2)
                    pa_[ua[0]], pb_[ub[0]] = path[ia], path[ib]
                    n -= twice & (pa_ == pb_)
        return n


def first(totals: np.ndarray, numbers: np.ndarray, best: int) -> np.ndarray:
    """Places of the best: total to nine digits as Spark rounds it, descending, then number."""
    if len(totals) <= best:
        return np.arange(len(totals))
    near = np.flatnonzero(totals >= np.partition(totals, len(totals) - best)[len(totals) - best] - NEAR)
    if len(near) == best:
        return near
    values, which = np.unique(totals[near], return_inverse=True)
    values = np.array([float(Decimal(repr(float(v))).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for v in values])
    return near[np.lexsort((numbers[near], -values[which]))[:best]]


def cells(make, schema: pa.Schema):
    """The function for mapInArrow over rows sorted by task and kind; make(idf, rows) gives a Block."""

    def run(batches):
        out, n, block, task = [], 0, None, None
        ids, idfs, items = [], [], []
        for batch in batches:
            t, k = batch.column("task").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(t)]):
                if hi == lo:
                    continue
                rows = batch.slice(lo, hi - lo)
                if t[lo] != task:
                    task, block, ids, idfs, items = t[lo], None, [], [], []
                if k[lo] == 0:
                    ids.append(rows.column("words").flatten().to_numpy(zero_copy_only=False)), idfs.append(rows.column("moved_by").flatten().to_numpy(zero_copy_only=False))
                elif k[lo] == 1:
                    items.append(rows)
                elif items or block:
                    if block is None:
                        idf = np.zeros(max([0, *[int(x.max()) + 1 for x in ids if len(x)]]))
                        for x, y in zip(ids, idfs):
                            idf[x] = y
                        block, ids, idfs, items = make(idf, pa.Table.from_batches(items).combine_chunks().to_batches()[0]), [], [], []
                    for found in block.score(rows):
                        out.append(found)
                        n += len(found[0])
                        if n >= OUT:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)
                            out, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return run
