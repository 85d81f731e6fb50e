"""Runs of repeated words: maximal stretches of one smallest period, found through longest common extensions.

Documents are read in slices; the words of a slice form one sequence with a separator of its own after each document.
How far two places agree (LCE) is answered by a difference cover: only suffixes at places whose residue modulo ``CYCLE``
lies in ``COVER`` are sorted, two places are compared word by word until both reach such a place (fewer than ``CYCLE``
words), and the rest is a range minimum over the sorted suffixes' common prefixes, from a sparse table.  The same on the
reversed sequence gives extensions to the left.  A run of period p holds at least ``exponent`` periods, so words p apart
agree over ``exponent - 1`` periods, and one of the places 0, (exponent - 1) p, 2 (exponent - 1) p, ... lies among them:
the grids of all periods have about n log(n) / (exponent - 1) places in all.  Stretches found under several periods keep
the smallest.

* A null text, like one without words, has no runs and an empty collapsed text.
* Texts of any length are searched whole, one text in one task; grids are walked in blocks of ``BLOCK`` places.
* Equal rows give equal results; runs are ordered by start, then period, so there are no ties.
* An empty table gives no rows.  Other columns of the input stay as they are; the result takes the name asked for, which
  must not be one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_column, ragged, text_buffer, words_of

CYCLE = 31
COVER = (0, 1, 3, 8, 12, 18)    # fixed values: a perfect difference set, every difference modulo 31 occurs once
BLOCK = 1 << 20                 # places of the grids at a time
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType(), False),
                       T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("text", T.StringType(), False)])

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[list(SEPARATORS)] = 0x20


def _waits() -> np.ndarray:
    """[i, d]: words from a place of residue i until it and the place d further on are both in the cover."""
    inside = np.zeros(CYCLE, bool)
    inside[list(COVER)] = True
    r = np.arange(CYCLE)
    both = inside[(r[:, None, None] + r) % CYCLE] & inside[(r[:, None, None] + r[:, None] + r) % CYCLE]
    return both.argmax(2)


class Extensions:
    """Longest common extensions to the right in ``codes`` (integers >= 0; every separator occurs once, one is last).

    ``spans``: first and last place (its separator) of every document.  Suffixes are sorted once a comparison needs them,
    and only those of documents that do.
    """

    def __init__(self, codes: np.ndarray, spans: np.ndarray):
        self.codes, self.spans = codes, spans
        self.waits = _waits()
        self.rank = None
        self.sorted_docs = np.zeros(len(spans), bool)

    def lengths(self, i: np.ndarray, j: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """How many words agree from i and from j > i on, all in documents ``doc``."""
        wait = self.waits[i % CYCLE, (j - i) % CYCLE]
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        synced = []
        for k in range(CYCLE):
            there = wait[live] == k
            synced.append(live[there])
            live = live[~there]
            same = self.codes[i[live] + k] == self.codes[j[live] + k]
            out[live[~same]] = k
            live = live[same]
            if not len(live):
                break
        at = np.concatenate(synced)
        if len(at):
            if not self.sorted_docs[doc[at]].all():
                self.sorted_docs[:] = False                  # documents come in order, earlier ones are done
                self.sorted_docs[doc[at]] = True
                self._sort()
            a, b = self.rank[i[at] + wait[at]], self.rank[j[at] + wait[at]]
            out[at] = wait[at] + self._least(np.minimum(a, b) + 1, np.maximum(a, b))
        return out

    def _sort(self):
        spans = self.spans[self.sorted_docs]
        places = ragged(spans[:, 0], spans[:, 1] - spans[:, 0] + 1)
        places = places[np.isin(places % CYCLE, COVER)]
        m = len(places)
        number = np.full(len(self.codes), -1, np.int64)
        number[places] = np.arange(m)
        padded = np.concatenate([self.codes, self.codes.max() + 1 + np.arange(CYCLE + 1)])
        # ranks by CYCLE words, two to a sort key, then by twice as many until all differ
        keys = [padded[places + k] * (int(padded.max()) + 1) + padded[places + k + 1] for k in range(0, CYCLE, 2)]
        order = np.lexsort(keys[::-1])
        differs = np.zeros(m, bool)
        for key in keys:
            differs[1:] |= key[order][1:] != key[order][:-1]
        levels, span = [self._ranked(order, differs)], CYCLE
        while levels[-1].max(initial=0) < m - 1:
            # where ranks are tied no separator lies within ``span`` words, so the place after them is in the document
            rank = levels[-1]
            tied = np.bincount(rank, minlength=m)[rank] > 1
            after = np.zeros(m, np.int64)
            after[tied] = rank[number[places[tied] + span]]
            order = np.lexsort((after, rank))
            differs = np.zeros(m, bool)
            differs[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
            levels.append(self._ranked(order, differs))
            span *= 2
        self.rank = np.full(len(self.codes), -1, np.int64)
        self.rank[places] = levels[-1]
        # common prefixes of neighbours: by halving spans, the rest word by word
        order = np.argsort(levels[-1])
        a, b = places[order[:-1]].copy(), places[order[1:]].copy()
        common = np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            same = np.flatnonzero(levels[k][number[a]] == levels[k][number[b]])
            for move in (a, b, common):
                move[same] += CYCLE << k
        live = np.arange(len(common))
        while len(live):
            live = live[padded[a[live]] == padded[b[live]]]
            for move in (a, b, common):
                move[live] += 1
        self.least = [np.concatenate([[0], common])]
        while (1 << len(self.least)) <= m:
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _ranked(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(differs)
        return rank

    def _least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Range minima over places lo to hi, both included."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            of = level == k
            row = self.least[k]
            out[of] = np.minimum(row[lo[of]], row[hi[of] - (1 << int(k)) + 1])
        return out


def find_runs(codes: np.ndarray, first: np.ndarray, min_words: int = 6, exponent: int = 4):
    """Runs of documents: ``codes`` are word numbers >= 0, document d has those from first[d] to first[d + 1].

    Returns (doc, start, length, period), ordered by these but for the length; starts count from the document's first
    word.  A run has at least ``min_words`` words and ``exponent`` (two or more) periods.
    """
    sizes = np.diff(first)
    docs = len(sizes)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not docs or sizes.max() < min_words:
        return none
    base = first[:-1] + np.arange(docs) + 1                  # place of each document's first word
    line = np.empty(len(codes) + docs + 1, np.int64)
    marks = np.concatenate([[0], base + sizes])              # a separator in front and one after each document
    words = np.ones(len(line), bool)
    words[marks] = False
    line[words] = codes
    line[marks] = int(codes.max(initial=0)) + 1 + np.arange(docs + 1)
    right = Extensions(line, np.stack([base, base + sizes], 1))
    end = len(line) - 1
    left = Extensions(np.ascontiguousarray(line[::-1]), np.stack([end - base - sizes + 1, end - base + 1], 1))

    most = np.where(sizes >= min_words, sizes // exponent, 0)
    doc = np.repeat(np.arange(docs), most)                   # one entry for each document and period
    period = ragged(np.ones(docs, np.int64), most)
    step = (exponent - 1) * period
    count = (sizes[doc] - 1 - period) // step + 1
    upto = np.concatenate([[0], np.cumsum(count)])
    found = []
    lo = 0
    while lo < len(doc):
        hi = max(int(np.searchsorted(upto, upto[lo] + BLOCK, side="right")) - 1, lo + 1)
        n = count[lo:hi]
        d, p = np.repeat(doc[lo:hi], n), np.repeat(period[lo:hi], n)
        i = base[d] + ragged(np.zeros(hi - lo, np.int64), n) * np.repeat(step[lo:hi], n)
        same = line[i] == line[i + p]
        d, p, i = d[same], p[same], i[same]
        ahead = right.lengths(i, i + p, d)
        back = left.lengths(end - (i + p - 1), end - (i - 1), d)
        length = back + p + ahead
        long = length >= np.maximum(min_words, exponent * p)
        found.append(np.stack([d, i - back - base[d], length, p])[:, long])
        lo = hi
    if not found:
        return none
    d, start, length, p = np.concatenate(found, 1)
    order = np.lexsort((p, length, start, d))
    d, start, length, p = (x[order] for x in (d, start, length, p))
    fresh = np.ones(len(d), bool)                            # a stretch counts with its smallest period
    fresh[1:] = (d[1:] != d[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    d, start, length, p = (x[fresh] for x in (d, start, length, p))
    order = np.lexsort((p, start, d))
    return tuple(x[order] for x in (d, start, length, p))


def _search(texts: pa.Array, min_words: int, exponent: int) -> pa.Array:
    flat, starts, ends, first = words_of(*text_buffer(texts), _TABLE)
    n, docs = len(starts), len(first) - 1
    places = np.concatenate([starts, [len(flat)]]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(places), pa.py_buffer(flat)])
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc, start, length, period = find_runs(codes, first, min_words, exponent)
    # words after the first period of a run go
    edge = np.zeros(n + 1, np.int64)
    at = first[doc] + start
    np.add.at(edge, at + period, 1)
    np.add.at(edge, at + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    size = (ends - starts + 1)[kept]
    data = flat[ragged(starts[kept], size)]
    held = np.concatenate([[0], np.cumsum(kept)])[first]
    upto = np.concatenate([[0], np.cumsum(size)])[held]
    inner = np.ones(len(data), bool)
    inner[upto[1:][np.diff(held) > 0] - 1] = False           # no space after a document's last word
    sizes = np.diff(upto) - (np.diff(held) > 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    text = pa.StringArray.from_buffers(docs, pa.py_buffer(offsets), pa.py_buffer(data[inner]))
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=[
        pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])
    per_doc = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(per_doc), runs)
    return pa.StructArray.from_arrays([pa.array(np.diff(first), pa.int64()), lists, text], names=["n_words", "runs", "text"])


def annotate(docs: DataFrame, name: str = "periodic", text_col: str = "text", min_words: int = 6,
             exponent: int = 4) -> DataFrame:
    """``docs`` with a column ``name``: struct of ``n_words``, ``runs`` (start, length, period; numbers of words) and
    ``text``, the words that stay when every run keeps its first period only, joined by one space.

    Words are separated by white space (``SEPARATORS``).  No shuffle.
    """
    return append_column(docs, name, RESULT, text_col, lambda col: _search(col, min_words, exponent))
