"""Inverted index with block maxima, held by one task, and exact top-k search with dynamic pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Relative slack of upper bounds, so that rounding in another order never drops a true hit.
_SLACK = 1e-9
#: Share of the pairs of a group's queries and a block's rows that hold a term, from which the term's products are dense.
DENSE_SHARE = 0.003
#: Dense terms and single products that are worked on at once; bound memory, not results.
DENSE_TERMS, PRODUCTS = 2048, 1 << 14


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``start[0] .. start[0] + length[0] - 1, start[1] ..`` in one array."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


class BlockMaxIndex:
    """Postings ``(term, row, impact)`` of ``rows`` numbered rows; terms are any integers.

    Rows are cut into blocks of consecutive numbers. For every term and block that has postings the greatest impact is
    kept: the sum of these maxima over a query's terms bounds every score in the block.
    """

    def __init__(self, term: np.ndarray, row: np.ndarray, impact: np.ndarray, rows: int, block: int = 64):
        """Postings have to be sorted by term, then row."""
        self.rows, self.block = rows, block
        self.row, self.impact = row, impact
        self.blocks = -(-rows // block)
        block_of = row // block
        new_term = np.ones(len(term), bool)
        new_term[1:] = term[1:] != term[:-1]
        new_entry = new_term.copy()
        new_entry[1:] |= block_of[1:] != block_of[:-1]
        self.entry_start = np.flatnonzero(new_entry)
        self.entry_length = np.diff(np.append(self.entry_start, len(term)))
        self.entry_block = block_of[self.entry_start]
        self.entry_max = np.maximum.reduceat(impact, self.entry_start) if len(term) else np.zeros(0)
        self.terms = term[new_term]
        self.term_start = np.append(np.searchsorted(self.entry_start, np.flatnonzero(new_term)), len(self.entry_start))

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known terms, and which of ``terms`` they are."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == terms)
        return at[known], known

    def search(
        self, terms: np.ndarray, weights: np.ndarray, k: int, floor: float = 0.0, skip: int = -1, rank: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best rows with a positive score of at least ``floor``, by score and then ``rank`` (else the row); exact.

        Blocks are scored in order of their bounds until no bound reaches the ``k``-th best score. ``skip`` leaves out one row.
        """
        at, known = self.lookup(terms)
        weight = weights[known]
        first, count = self.term_start[at], self.term_start[at + 1] - self.term_start[at]
        entry = ranges(first, count)
        entry_weight = np.repeat(weight, count)
        entry_block = self.entry_block[entry]
        bound = np.bincount(entry_block, weights=entry_weight * self.entry_max[entry], minlength=self.blocks) * (1 + _SLACK)
        order = np.argsort(-bound, kind="stable")
        found_row, found_score = np.zeros(0, np.int64), np.zeros(0)
        chosen = np.zeros(self.blocks, bool)
        done, step, least = 0, max(2, -(-2 * k // self.block)), floor
        while done < self.blocks:
            take = order[done : done + step]
            take = take[(bound[take] > 0) & (bound[take] >= least)]
            if not len(take):
                break
            done, step = done + step, step * 2
            chosen[:] = False
            chosen[take] = True
            use = np.flatnonzero(chosen[entry_block])
            length = self.entry_length[entry[use]]
            posting = ranges(self.entry_start[entry[use]], length)
            part = np.repeat(entry_weight[use], length) * self.impact[posting]
            rows = self.row[posting]
            score = np.bincount(rows, weights=part, minlength=self.rows)
            hit = np.flatnonzero((score > 0) & (score >= least))
            if skip >= 0:
                hit = hit[hit != skip]
            found_row, found_score = np.concatenate([found_row, hit]), np.concatenate([found_score, score[hit]])
            if len(found_row) >= k:
                best = np.lexsort((found_row if rank is None else rank[found_row], -found_score))[:k]
                found_row, found_score = found_row[best], found_score[best]
                least = max(least, float(found_score[-1]))
        best = np.lexsort((found_row if rank is None else rank[found_row], -found_score))[:k]
        return found_row[best], found_score[best]

    def block_views(self, terms: int) -> Iterator[Block]:
        """Every block that has postings; terms are whole numbers under ``terms``."""
        place = np.full(terms, -1, np.int32)
        order = np.argsort(self.entry_block, kind="stable")
        edge = np.searchsorted(self.entry_block[order], np.arange(self.blocks + 1))
        term = np.repeat(self.terms, np.diff(self.term_start))
        for number in range(self.blocks):
            entry = order[edge[number] : edge[number + 1]]
            if len(entry):
                place[term[entry]] = np.arange(len(entry))
                yield Block(self, number, entry, place)
                place[term[entry]] = -1


class Group:
    """Queries that are searched together. For every query in turn its terms, how often it holds them, and how many queries do."""

    def __init__(self, query: np.ndarray, term: np.ndarray, count: np.ndarray, n: int):
        """Sorted by query; every term once in a query, as a whole number that the index knows it by."""
        self.n = n
        self.term, self.count = term.astype(np.int32), count.astype(np.min_scalar_type(int(count.max(initial=0))))
        self.start = np.searchsorted(query, np.arange(n + 1))
        _, at, held = np.unique(self.term, return_inverse=True, return_counts=True)
        self.held = held[at].astype(np.int32)


class Block:
    """One block of an index, for many queries at once."""

    def __init__(self, index: BlockMaxIndex, number: int, entry: np.ndarray, place: np.ndarray):
        self.first = number * index.block
        self.n = min(index.block, index.rows - self.first)
        self.length, self.most, self.place = index.entry_length[entry], index.entry_max[entry], place
        posting = ranges(index.entry_start[entry], self.length)  # side by side, since they are read often
        self.start = np.cumsum(self.length) - self.length
        self.row, self.impact = index.row[posting] - self.first, index.impact[posting]
        self.bits = self.n.bit_length()
        self.packed = self.impact.astype(np.int64) << self.bits | self.row
        self.column = np.zeros(len(entry), np.int32)

    def _single(self, query: np.ndarray, at: np.ndarray, count: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray | None]]:
        """Some queries after the other: first, last + 1, sums of products by query and row (none if there are no products).

        No matrix is built; ``at`` are places of terms, sorted by query.
        """
        size, count = self.length[at], count.astype(np.float64)
        made = np.append(0, np.cumsum(size))
        away = self.start[at] - made[:-1]
        edge = np.searchsorted(query, np.arange(n + 1))
        first = made[edge]
        low = 0
        while low < n:  # whole queries, PRODUCTS or one query's
            high = min(n, low + 64, max(low + 1, int(np.searchsorted(first, first[low] + PRODUCTS, side="right")) - 1))
            sums = None
            if first[high] > first[low]:
                one = slice(edge[low], edge[high])
                posting = np.repeat(away[one], size[one])
                posting += np.arange(first[low], first[high])
                posting = self.packed.take(posting)
                key = np.repeat((query[one] - low) * self.n, size[one])
                key += posting & ((1 << self.bits) - 1)
                posting >>= self.bits
                part = np.repeat(count[one], size[one])
                part *= posting
                sums = np.bincount(key, weights=part, minlength=(high - low) * self.n)
            yield low, high, sums
            low = high

    def _right(self, terms: np.ndarray) -> np.ndarray:
        """Impacts by term and row."""
        size = self.length[terms]
        posting = ranges(self.start[terms], size)
        right = np.zeros((len(terms), self.n), np.float32)
        right[np.repeat(np.arange(len(terms)), size), self.row[posting]] = self.impact[posting]
        return right

    def _sums(self, terms: np.ndarray, query: np.ndarray, at: np.ndarray, count: np.ndarray, asked: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Exact sums over ``terms`` for some pairs of a query and a row."""
        queries, asked = np.unique(asked, return_inverse=True)
        rows, row = np.unique(row, return_inverse=True)
        new = np.full(int(query.max(initial=0)) + 1 + int(queries[-1]), -1)
        new[queries] = np.arange(len(queries))
        some = np.flatnonzero(new[query] >= 0)
        left = np.zeros((len(queries), len(terms)))
        left[new[query[some]], self.column[at[some]]] = count[some]
        size = self.length[terms]
        posting = ranges(self.start[terms], size)
        new = np.full(self.n, -1)
        new[rows] = np.arange(len(rows))
        spot = new[self.row[posting]]
        some = np.flatnonzero(spot >= 0)
        right = np.zeros((len(rows), len(terms)))
        right[spot[some], np.repeat(np.arange(len(terms)), size)[some]] = self.impact[posting[some]]
        sums = np.zeros(len(row))
        for low in range(0, len(row), 512):
            one = slice(low, low + 512)
            sums[one] = np.einsum("ij,ij->i", left[asked[one]], right[row[one]])
        return sums

    def search(self, group: Group, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of all rows that can be among the ``k`` best and have a positive score of ``least[query]`` at least.

        Impacts and counts are whole numbers, so that sums are exact. Queries whose bound stays below are left out. Terms that many
        pairs hold are multiplied as matrices, first in 32 bits with a bound for the error; what can reach is then summed up exactly.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = self.place[group.term]
        known = np.flatnonzero(at >= 0)
        if not len(known):
            return none
        at, count, held = at[known], group.count[known], group.held[known]
        query = np.repeat(np.arange(group.n), np.diff(np.searchsorted(known, group.start)))
        bound = np.bincount(query, weights=self.most[at] * count, minlength=group.n) * (1 + _SLACK)
        number = np.flatnonzero(bound >= np.maximum(least, 1))
        if not len(number):
            return none
        n = len(number)
        if n < group.n:
            new = np.full(group.n, -1)
            new[number] = np.arange(n)
            query = new[query]
            alive = np.flatnonzero(query >= 0)
            query, at, count, held = query[alive], at[alive], count[alive], held[alive]
        many = self.length[at] * held > DENSE_SHARE * group.n * self.n
        few, many = np.flatnonzero(~many), np.flatnonzero(many)
        singles = self._single(query[few], at[few], count[few], n)
        query, at, count = query[many], at[many], count[many]
        mark = np.zeros(len(self.length), bool)
        mark[at] = True
        dense = np.flatnonzero(mark)
        about = np.zeros((n, self.n), np.float32)
        parts = []
        for low in range(0, len(dense), DENSE_TERMS):
            terms = dense[low : low + DENSE_TERMS]
            self.column[terms] = np.arange(len(terms))
            own = slice(None) if len(terms) == len(dense) else np.flatnonzero((at >= terms[0]) & (at <= terms[-1]))
            parts.append((terms, query[own], at[own], count[own]))
            left = np.zeros((n, len(terms)), np.float32)
            left[query[own], self.column[at[own]]] = count[own]
            if low:
                about += left @ self._right(terms)
            else:
                np.matmul(left, self._right(terms), out=about)
        slack = (len(dense) + 16) * 2.0**-22  # of sums of this many values that are not negative
        floor = (np.maximum(least[number], 1) * (1 - slack)).astype(np.float32)[:, None]
        hits, scores = [], []
        for low, high, sums in singles:
            some = about[low:high]
            if sums is not None:
                some += sums.reshape(some.shape)
            hit = np.flatnonzero(some >= floor[low:high])
            if len(hit) > 4 * k * (high - low) and self.n > k:
                best = np.partition(some, self.n - k, axis=1)[:, self.n - k, None]
                hit = np.flatnonzero(some >= np.maximum(floor[low:high], best * np.float32(1 - 2 * slack)))
            if len(hit):
                hits.append(hit + low * self.n)
                scores.append(np.zeros(len(hit)) if sums is None else sums[hit])
        if not hits:
            return none
        asked, row = np.divmod(np.concatenate(hits), self.n)
        score = np.concatenate(scores)
        for part in parts:
            self.column[part[0]] = np.arange(len(part[0]))
            score += self._sums(*part, asked, row)
        good = np.flatnonzero((score > 0) & (score >= least[number[asked]]))
        return number[asked[good]], row[good] + self.first, score[good]
