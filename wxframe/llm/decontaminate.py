"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``window`` consecutive item words (a shorter item is one
window).  For each pattern length L a SHIFT table over hashed two-word blocks
says how far the window end may jump; where the shift is 0 the suffix hash
selects a bucket of patterns, whose words are then compared directly, bytes
included.  Many cursors (runs of ``RUN`` window ends) move in step with numpy.

The documents are only scanned (no shuffle).  The benchmark is cut into blocks
of at most ``block_bytes`` of text; each block is one broadcast and one pass, so
what is broadcast at once has a fixed bound whatever the benchmark's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, checkpoint, fresh, held, list_array, mix, ragged, text_buffer, word_hashes, words_of

RUN = 512
BLOCK_BYTES = 4 << 20

# bytes: A-Z to lower case, 0-9, a-z and everything from 0x80 stay, others separate
WORD_BYTES = np.full(256, 32, np.uint8)
for _a, _b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    WORD_BYTES[_a:_b + 1] = np.arange(_a, _b + 1)
WORD_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("starts", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType())),
])


def _blocks_of(h: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Hash of the last ``size`` (1 or 2) words up to ``end``."""
    return mix(h[end] * np.uint64(0x9E3779B97F4A7C15) + (h[end - 1] if size == 2 else np.uint64(0)))


class Patterns:
    """Search tables for one length: SHIFT by hashed block, buckets by suffix hash."""

    def __init__(self, length: int, ends: np.ndarray, items: np.ndarray, text):
        self.length, self.block = length, min(2, length)
        self.flat, self.starts, self.ends, self.h = text
        slots = 1 << max(12, int(4 * len(ends) * length).bit_length())
        self.low = np.uint64(64 - slots.bit_length() + 1)
        self.shift = np.full(slots, length - self.block + 1, np.int64)
        for back in range(length - self.block, -1, -1):
            slot = _blocks_of(self.h, ends - back, self.block) >> self.low
            self.shift[slot] = np.minimum(self.shift[slot], back)
        suffix = _blocks_of(self.h, ends, self.block)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.end, self.item = suffix[order], ends[order], items[order]

    def search(self, h, first, flat, starts, ends):
        """(window end, item) of every occurrence in the texts whose words start at ``first``."""
        lo, hi = first[:-1] + self.length - 1, first[1:]
        runs = np.maximum(0, -(-(hi - lo) // RUN))
        at = np.repeat(lo, runs) + RUN * ragged(np.zeros(len(runs), np.int64), runs)
        stop = np.minimum(at + RUN, np.repeat(hi, runs))
        found = []
        while len(at):
            step = self.shift[_blocks_of(h, at, self.block) >> self.low]
            if (hit := step == 0).any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        none = np.zeros(0, np.int64)
        if not found:
            return none, none
        at = np.concatenate(found)
        suffix = _blocks_of(h, at, self.block)
        left = np.searchsorted(self.suffix, suffix, "left")
        size = np.searchsorted(self.suffix, suffix, "right") - left
        at, pat = np.repeat(at, size), ragged(left, size)
        for back in range(self.length):
            same = h[at - back] == self.h[self.end[pat] - back]
            at, pat = at[same], pat[same]
        a0, a1 = starts[at - self.length + 1], ends[at]
        p0, p1 = self.starts[self.end[pat] - self.length + 1], self.ends[self.end[pat]]
        same = a1 - a0 == p1 - p0
        at, pat, a0, a1, p0 = at[same], pat[same], a0[same], a1[same], p0[same]
        equal = np.ones(len(at), bool)
        for k in range(0, len(at), 4096):       # the bytes themselves, compared in bounded pieces
            size = (a1 - a0)[k:k + 4096]
            if len(size):
                same = flat[ragged(a0[k:k + 4096], size)] == self.flat[ragged(p0[k:k + 4096], size)]
                equal[k:k + 4096] = np.logical_and.reduceat(same, np.concatenate([[0], np.cumsum(size)[:-1]]))
        return at[equal], self.item[pat[equal]]


def build(texts: list[str], window: int) -> list[Patterns]:
    data, offs = text_buffer(pa.array(texts, pa.string()))
    flat, starts, ends, first = words_of(data, offs, WORD_BYTES)
    h = word_hashes(flat, starts, ends)
    n = np.diff(first)
    length = np.minimum(n, window)
    out = []
    for size in sorted(set(length[n > 0].tolist())):
        own = np.flatnonzero(length == size)
        count = n[own] - size + 1
        out.append(Patterns(int(size), ragged(first[own] + size - 1, count), np.repeat(own, count), (flat, starts, ends, h)))
    return out


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Half-open ranges merged where they touch or overlap."""
    if not len(starts):
        return [], []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.concatenate([new[1:], [True]])
    return s[new].tolist(), e[last].tolist()


def _tables(block, window: int):
    """Search tables of the block at hand; a Python worker keeps those of one block only."""
    ids, patterns, _ = held("items", (id(block), window), lambda: (block.value[0], build(block.value[1], window), block))
    return ids, patterns


def _scan(column: pa.Array, ids: list[str | None], patterns: list[Patterns]) -> pa.Array:
    data, offs = text_buffer(column)
    flat, starts, ends, first = words_of(data, offs, WORD_BYTES)
    h = word_hashes(flat, starts, ends)
    got = [(p.length, *p.search(h, first, flat, starts, ends)) for p in patterns]
    at = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
    item = np.concatenate([g[2] for g in got]) if got else np.zeros(0, np.int64)
    begin = np.concatenate([g[1] - g[0] + 1 for g in got]) if got else at
    doc = np.searchsorted(first, at, "right") - 1
    n = len(offs) - 1
    names, lows, highs = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
    order = np.argsort(doc, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
        d = doc[part[0]]
        names[d] = sorted({ids[i] for i in set(item[part].tolist()) if ids[i] is not None})
        lows[d], highs[d] = _joined(begin[part] - first[d], at[part] + 1 - first[d])
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(first), pa.int64()), pa.array(names, pa.list_(pa.string())),
         pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64()))],
        names=["n_words", "items", "starts", "ends"])


def _item_blocks(items: DataFrame, block_bytes: int):
    """(ids, texts) blocks of at most ``block_bytes`` of text (a longer item stays whole), read row by row."""
    ids, texts, size = [], [], 0
    for name, text in items.toLocalIterator():
        if texts and size + len(text) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(name)
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def hit_words(found: Column) -> Column:
    """Number of words inside the found ranges."""
    return F.aggregate(F.zip_with(found["starts"], found["ends"], lambda a, b: b - a),
                       F.lit(0).cast("long"), lambda x, y: x + y)


def _merge(a: Column, b: Column) -> Column:
    """Results of two blocks of items on one text."""
    pair = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    both = F.array_sort(F.zip_with(F.concat(a["starts"], b["starts"]), F.concat(a["ends"], b["ends"]), pair))
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    joined = F.aggregate(both, empty, lambda acc, x: F.when(
        x["s"] <= last(acc)["e"],
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1),
                 F.array(pair(last(acc)["s"], F.greatest(last(acc)["e"], x["e"])))))
        .otherwise(F.concat(acc, F.array(pair(x["s"], x["e"])))))
    return F.struct(a["n_words"].alias("n_words"),
                    F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
                    F.transform(joined, lambda x: x["s"]).alias("starts"),
                    F.transform(joined, lambda x: x["e"]).alias("ends"))


def annotate(docs: DataFrame, items: DataFrame, out: str, text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one more column ``out``: n_words, the ids (as strings) of the items that have a
    window in the text, and the merged word ranges [start, end) covered by such windows.

    A null or empty text has no words and no hits.  Items without words never occur; an item with a null id
    marks words but is not listed; repeated items count once; repeated documents are each annotated; an empty
    benchmark finds nothing.  Other columns pass through unchanged, whatever their names (``out`` must be new).
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_col).cast("string"), F.col(item_text_col)).where(F.col(item_text_col).isNotNull())
    done, blocks = docs, 0
    for block in _item_blocks(rows, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        make = lambda col, s=shared: _scan(col, *_tables(s, window))
        if blocks == 0:
            done = append_column(done, out, RESULT, text_col, make, owner="items")
        else:                                   # further blocks: cut the chain of passes, then merge
            extra = fresh(done, "block_hits")
            done = append_column(checkpoint(done), extra, RESULT, text_col, make, owner="items")
            done = done.withColumn(out, _merge(F.col(out), F.col(extra))).drop(extra)
        blocks += 1
    if not blocks:
        done = append_column(done, out, RESULT, text_col, lambda col: _scan(col, [], []))
    return done


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_words, n_hit (words inside an occurrence), n_items, item_ids, starts, ends, contaminated."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = annotate(plain, items, "found", "text", **options)
    f = F.col("found")
    return found.select(
        F.col("id").alias(id_col), f["n_words"].alias("n_words"), hit_words(f).alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"), f["items"].alias("item_ids"),
        f["starts"].alias("starts"), f["ends"].alias("ends"), (F.size(f["starts"]) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those in which a benchmark window occurs; columns unchanged."""
    out = fresh(docs, "benchmark_hits")
    marked = annotate(docs, items, out, text_col, **options)
    return marked.where(F.size(F.col(out)["starts"]) == 0).drop(out)
