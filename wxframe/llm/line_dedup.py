"""Line de-duplication by pairwise alignment.

A passage is a run of at least ``min_words`` consecutive words, wherever its lines begin or end; only blank lines
between its words must be there on both sides.  As texts may be a single line, the lines that are hashed are stretches
of ``GRAM`` words: of each window of ``min_words`` words the stretch with the smallest hash, about one in sixteen words.
Two equal windows have the same one, so documents that hold one passage share a line hash.

* The smallest document that holds a line hash is its source, and every other holder is aligned with it: pairs grow with
  the holders, never with their square.
* A pair is aligned by patience diff: lines that occur once on both sides, their longest increasing chain, extended word
  by word to blocks, repeated on the lines left over, so moved blocks count too.  Windows whose line is repeated on a
  side have no such anchor and are looked up in the source.  Common blocks of ``min_words`` words or more are deleted
  from the later document.
* A source may hold a line but not the window around it that two later documents share.  All holders of such a window
  find it missing in that source; these windows alone are grouped by their own hashes, and their holders aligned with the
  smallest of them.  So no passage that an earlier document holds is missed.

Lines of which no word is left go, others keep their remaining words.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import append_column, fresh, list_array, mix, release, slices, text_buffer, word_hashes, words_of

MIN_WORDS = 50
PER_TASK = 64                      # later documents aligned with one copy of a source's text
GRAM = 20                          # words of a hashed line
HASH_BYTES = 1 << 18               # of text hashed at once: the arrays stay in the processor's cache
ROUNDS = 16                        # of chains; later, every anchor left over is a chain of its own
BITS = 1 << 26                     # of the broadcast filter of documents that take part; a full filter only costs time
SPACE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"    # besides ASCII
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[[*range(9, 14), *range(28, 32)]] = 32
BREAK = 0xD1B54A32D192ED03
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def lines_of(text: str | None) -> tuple[list[str], list[int]]:
    """Lines (outer white space trimmed) and their word counts."""
    lines = [x.strip() for x in (text or "").split("\n")]
    return lines, [len(x.split()) for x in lines]


def _word_hashes(col: pa.Array):
    """(hashes, first, parted, flat, starts, ends): hashes of the words of all texts, as ``str.split`` finds them, each
    text's first word (one entry more), ``BREAK`` for the words that blank lines part from the word before, else 0, and
    the bytes of the words, parted by one space, with the words' ranges in them."""
    data, offs = text_buffer(pc.replace_substring_regex(col, SPACE, " "))
    flat, starts, ends, first = words_of(data, offs, _TABLE)
    word = _TABLE[data] != 32
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = offs[:-1][offs[:-1] < len(data)]
    begin[edge] = word[edge]
    before = np.searchsorted(np.flatnonzero(begin), np.flatnonzero(data == 10))     # words before each line end
    parted = np.zeros(len(starts) + 1, np.uint64)
    parted[before[1:][before[1:] == before[:-1]]] = BREAK
    parted[first] = 0
    parted = parted[:-1]
    return word_hashes(flat, starts, ends), first, parted, flat, starts, ends


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _windows(hashes: np.ndarray, parted: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words, and the blank lines between them, from each word on, as far as they reach."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    both = np.cumsum((hashes + parted) * _geometric(_STEP, len(hashes)), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), both])
    return mix((sums[size:] - sums[:-size]) * _geometric(_BACK, n) - parted[:n])


def _sliding(pick, values: np.ndarray, size: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of the ``size`` values from each on."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values, have = pick(values[:-step], values[step:]), have + step
    return values


def _lines(hashes: np.ndarray, parted: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the line from each word on, never 0, and the smallest of those in the window from each word on."""
    gram = min(GRAM, min_words)
    lines = np.maximum(_windows(hashes, parted, gram), np.uint64(1))
    few = len(hashes) < min_words
    return lines, np.zeros(0, np.uint64) if few else _sliding(np.minimum, lines, min_words - gram + 1)


def line_hashes(col: pa.Array, min_words: int) -> pa.Array:
    """Per text the distinct line hashes of its windows."""
    hashes, first, parted, *_ = _word_hashes(col)
    _, least = _lines(hashes, parted, min_words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:len(least)]
    use = np.arange(len(least)) + min_words <= first[1:][text]
    use[1:] &= (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    text, least = text[use], least[use]
    order = np.lexsort((least, text))
    text, least = text[order], least[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
    return list_array(least[new].view(np.int64), np.bincount(text[new], minlength=len(col)), pa.int64())


def _chain(places: list[int]) -> list[int]:
    """Indices of a longest increasing chain of ``places``."""
    tops: list[int] = []
    heads: list[int] = []
    back = []
    for k, j in enumerate(places):
        at = bisect_left(tops, j)
        back.append(heads[at - 1] if at else -1)
        tops[at:at + 1], heads[at:at + 1] = [j], [k]
    out, k = [], heads[-1] if heads else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


class Words:
    """The words of one text: hashes, blank lines between them, bytes, and its lines: those with the smallest hash of a
    window, at ``places``, with their hashes ``lines``."""

    def __init__(self, hashes, parted, onward, backward, least, places, lines, flat, starts, ends, min_words: int):
        self.hashes, self.parted, self.onward, self.backward, self.least = hashes, parted, onward, backward, least
        self.flat, self.starts, self.ends = flat, starts, ends
        self.size, self.gram = min_words, min(GRAM, min_words)
        order = np.argsort(lines, kind="stable")
        self.places, self.lines = places[order], lines[order]

    @functools.cached_property
    def windows(self) -> np.ndarray:
        return _windows(self.hashes, self.parted, self.size)

    @functools.cached_property
    def windows_sorted(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.windows, kind="stable")
        return order, self.windows[order]

    def held(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each line occurs, and an index into ``places`` of the first."""
        at = np.searchsorted(self.lines, lines, "left")
        return np.searchsorted(self.lines, lines, "right") - at, at

    def equal(self, a: int, other: Words, j: int, n: int) -> bool:
        """Whether n words from a on are, byte for byte, those of ``other`` from j on."""
        mine = self.flat[self.starts[a]:self.ends[a + n - 1]]
        return np.array_equal(mine, other.flat[other.starts[j]:other.ends[j + n - 1]]) \
            and np.array_equal(self.parted[a + 1:a + n], other.parted[j + 1:j + n])


def words_in(texts: list[str | None], min_words: int) -> list[Words]:
    """The :class:`Words` of each text, hashed together."""
    hashes, first, parted, flat, starts, ends = _word_hashes(pa.array([t or "" for t in texts], pa.large_string()))
    onward, backward = hashes + parted, parted.copy()
    backward[1:] += hashes[:-1]
    lines, least = _lines(hashes, parted, min_words)
    inside = np.arange(len(least)) + min_words <= np.repeat(first[1:], np.diff(first))[:len(least)]
    reach = max(min_words - min(GRAM, min_words), 0)
    wide = np.zeros(len(lines) + reach, np.uint64)             # a line is the smallest of some window that holds it
    wide[reach:reach + len(least)] = np.where(inside, least, 0)
    places = np.flatnonzero(_sliding(np.maximum, wide, reach + 1) == lines) if len(least) else np.zeros(0, np.int64)
    cut = np.searchsorted(places, first)
    out = []
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        mine = places[cut[k]:cut[k + 1]]
        out.append(Words(hashes[a:b], parted[a:b], onward[a:b], backward[a:b], least[a:max(b - min_words + 1, a)],
                         mine - a, lines[mine], flat, starts[a:b], ends[a:b], min_words))
    return out


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        upto = min(at + step, n)
        differ = np.flatnonzero(x[at:upto] != y[at:upto])
        if len(differ):
            return at + int(differ[0])
        at, step = upto, step * 4
    return n


def _block(old: Words, new: Words, i: int, j: int) -> tuple[int, int, int]:
    """(start, end, place in old) of the longest equal run of words around word i of ``new`` and word j of ``old``."""
    left = _same(new.backward[i:0:-1], old.backward[j:0:-1])
    right = 1 + _same(new.onward[i + 1:], old.onward[j + 1:])
    return i - left, i + right, j - left


def patience(old: Words, new: Words, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int, int]]:
    """Blocks (start, end, place in old) of at least ``min_words`` equal words around lines that are at place i of
    ``new`` and j of ``old`` only; i ascends.

    The longest chain ascending on both sides is extended to blocks, then the lines outside of it are aligned in the same
    way: what has moved comes in a later round."""
    out, rounds = [], 0
    while len(i):
        rounds += 1
        ordered = rounds > ROUNDS or bool((np.diff(j) > 0).all())
        chain = range(len(i)) if ordered else _chain(j.tolist())
        left, upto = np.ones(len(i), bool), 0
        for k in chain:
            left[k] = False
            if i[k] + new.gram <= upto:
                continue                                       # inside the block before
            a, b, at = _block(old, new, int(i[k]), int(j[k]))
            upto = b
            first, last = np.searchsorted(i, [a, b - new.gram + 1])
            left[first:last] = False
            if b - a >= new.size and new.equal(a, old, at, b - a):
                out.append((a, b, at))
        i, j = i[left], j[left]
    return out


def _looked_up(old: Words, new: Words, at: np.ndarray) -> list[tuple[int, int, int]]:
    """Blocks of the windows ``at`` of ``new`` that ``old`` holds."""
    order, known = old.windows_sorted
    if not len(known) or not len(at):
        return []
    found = np.minimum(np.searchsorted(known, new.windows[at]), len(known) - 1)
    met = known[found] == new.windows[at]
    at, place = at[met], order[found[met]]
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(place) != 1)) + 1
    runs = [(int(r[0]), int(r[-1]) + new.size, int(p[0])) for r, p in zip(np.split(at, cut), np.split(place, cut), strict=True) if len(r)]
    return [(a, b, j) for a, b, j in runs if new.equal(a, old, j, b - a)]


def common_words(old: Words, new: Words) -> list[tuple[int, int]]:
    """Word ranges [start, end) of ``new`` of at least ``min_words`` words that align with ``old``, sorted."""
    if not len(old.least) or not len(new.least):
        return []
    if len(old.hashes) == len(new.hashes) and new.equal(0, old, 0, len(new.hashes)):
        return [(0, len(new.hashes))]
    lines = np.unique(new.lines)
    (n_old, at_old), (n_new, at_new) = old.held(lines), new.held(lines)
    once = (n_old == 1) & (n_new == 1)
    i, j = new.places[at_new[once]], old.places[at_old[once]]
    by_place = np.argsort(i)
    out = patience(old, new, i[by_place], j[by_place])
    several = lines[(n_old > 0) & ~once]
    if len(several):
        out += _looked_up(old, new, _uncovered(out, new, several))
    return sorted((a, b) for a, b, _ in out)


def _uncovered(blocks, new: Words, lines: np.ndarray) -> np.ndarray:
    """The windows of ``new`` outside the blocks whose smallest line is one of ``lines``."""
    out = np.ones(len(new.least), bool)
    for a, b, *_ in blocks:
        out[a:b - new.size + 1] = False
    at = np.flatnonzero(out)
    return at[np.isin(new.least[at], lines)] if len(at) else at


def missing_windows(new: Words, lines: np.ndarray, blocks) -> np.ndarray:
    """Distinct hashes of the windows whose line is one of ``lines`` and that no block holds."""
    at = _uncovered(blocks, new, lines)
    return np.unique(new.windows[at]) if len(at) else np.zeros(0, np.uint64)


def common_blocks(old_text: str | None, new_text: str | None, min_words: int) -> list[tuple[int, int]]:
    """Ranges [start, end) of whole lines of ``new_text`` inside the blocks that align with ``old_text``."""
    old, new = words_in([old_text, new_text], min_words)
    upto = np.cumsum([0, *lines_of(new_text)[1]])
    ranges = [(int(np.searchsorted(upto, a)), int(np.searchsorted(upto, b, "right")) - 1) for a, b in common_words(old, new)]
    return [(a, b) for a, b in ranges if a < b]


def united(ranges) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one, sorted."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spans(line: str, edges: list[int]) -> dict[int, tuple[int, int]]:
    """Where the words at ``edges``, and the ones before them, begin and end in ``line``."""
    if len(edges) > 6:
        return dict(enumerate(m.span() for m in re.finditer(r"\S+", line)))
    out = {}
    for k in {k for e in edges for k in (e - 1, e)}:
        rest = line.split(None, k)[k:] if k >= 0 else []                  # from word k on, if there is one
        if rest:
            start = len(line) - len(rest[0]) if k else len(line) - len(line.lstrip())
            out[k] = (start, start + len(rest[0].split(None, 1)[0]))
    return out


def without(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int]:
    """``text`` without the words of united ``ranges``, and how many lines went: those that lose their last word, and
    blank ones inside a range."""
    gone = np.zeros(max((b for _, b in ranges), default=0) + 1, bool)
    inner = gone.copy()
    for a, b in ranges:
        gone[a:b] = True
        inner[a + 1:b] = True
    out, at, lines = [], 0, text.split("\n")
    for line in lines:
        n = len(line.split())
        mask = gone[at:at + n]
        if not n:
            if at >= len(inner) or not inner[at]:
                out.append(line)
        elif not mask.any():
            out.append(line)
        elif len(mask) < n or not mask.all():
            kept = np.zeros(n + 2, bool)
            kept[1:n + 1] = True
            kept[1:len(mask) + 1] = ~mask
            edges = np.flatnonzero(kept[1:] != kept[:-1]).tolist()            # of the runs of words that stay
            spans = _spans(line, edges)
            out.append(" ".join(line[spans[a][0] if a else 0:spans[b - 1][1] if b < n else len(line)]
                                for a, b in zip(edges[::2], edges[1::2], strict=True)))
        at += n
    return "\n".join(out), len(lines) - len(out)


def _key(id_col: str, text_col: str):
    """The id, then a short digest of the text, so rows of one id with different texts are told apart."""
    return F.struct(F.col(id_col).alias("id"), F.hash(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _marks(keys: DataFrame) -> DataFrame:
    """(part, bits): a filter of ``BITS`` bits over the column ``key``, at most 2,048 rows of 4 KB."""
    bit = keys.select(F.xxhash64("key").bitwiseAND(F.lit(BITS - 1)).alias("bit"))
    return bit.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits"))


def _marked(df: DataFrame, key, marks: DataFrame, out: str) -> DataFrame:
    """``df`` with a boolean ``out``: false where ``key`` is certainly not among the marked ones.  The filter has 8 MB at
    most and is broadcast, so rows that need not meet anything aren't shuffled."""
    part, bits = fresh(df, "mark_part"), fresh(df, "mark_bits")
    bit = F.xxhash64(key).bitwiseAND(F.lit(BITS - 1))
    met = df.withColumn(part, F.shiftright(bit, 15)).join(F.broadcast(marks.select(F.col("part").alias(part), F.col("bits").alias(bits))), part, "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(bit.bitwiseAND(F.lit(32767)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    one = F.floor(byte / F.pow(F.lit(2), bit.bitwiseAND(F.lit(7)))) % 2 == 1
    return met.withColumn(out, F.coalesce(one, F.lit(False))).drop(part, bits)


def _with_source(held: DataFrame, by: str) -> DataFrame:
    """The rows (key, ``by``) whose ``by`` a smaller key holds as well, with the smallest such key as ``source``."""
    least = held.groupBy(by).agg(F.min("key").alias("source"), F.count(F.lit(1)).alias("n")).where("n > 1").select(by, "source")
    return held.join(least, by).where(~F.col("key").eqNullSafe(F.col("source")))


def overlaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Pairs (key, source, lines): ``source`` is the smallest document that holds the line hashes ``lines`` of ``key``."""
    keyed = _keyed(docs, id_col, text_col)
    hashed = append_column(keyed, "lines", T.ArrayType(T.LongType()), "text", lambda col: line_hashes(col, min_words),
                           limit=HASH_BYTES)
    # rows equal in id and text are one document
    held = stored(hashed.select("key", "lines").where(F.size("lines") > 0)).select("key", F.explode("lines").alias("line"))
    return _with_source(held, "line").groupBy("key", "source").agg(F.collect_set("line").alias("lines"))


def _aligned(pairs: DataFrame, later: DataFrame, sources: DataFrame, min_words: int) -> DataFrame:
    """(key, source, ranges, missing) of pairs (key, source, lines): the blocks of ``key`` that align with ``source``, and
    the hashes of its windows around ``lines`` that the source does not hold.  A source's text is copied once for every
    ``PER_TASK`` later documents."""
    tasks = pairs.groupBy("source").agg(F.ceil(F.count("*") / PER_TASK).cast("long").alias("n"))
    dealt = pairs.join(tasks, "source").withColumn("salt", F.pmod(F.xxhash64("key"), "n"))
    later = dealt.select("key", "source", "salt", "lines").join(later, "key")
    spread = tasks.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("salt"))
    earlier = spread.join(sources.select(F.col("key").alias("source"), F.col("text").alias("old")), "source")
    both = later.join(earlier, ["source", "salt"]).select("key", "source", "lines", "old", "text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def align(batches):
        release()
        for batch in batches:
            for part in slices(batch, "text", HASH_BYTES):
                texts, which = part.column(4).to_pylist(), []
                for text in part.column(3).to_pylist():                      # equal sources follow each other
                    if not which or text != texts[-1]:
                        texts.append(text)
                    which.append(len(texts) - 1)
                words = words_in(texts, min_words)
                ranges, missing = [], []
                for k, (new, at) in enumerate(zip(words, which)):            # noqa: B905 (sources come after the texts)
                    found = common_words(words[at], new)
                    ranges.append([{"start": a, "end": b} for a, b in found])
                    lines = part.column(2)[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    missing.append(missing_windows(new, lines, found).view(np.int64) if len(lines) else [])
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(ranges, kind), pa.array(missing, pa.list_(pa.int64()))],
                                                 names=["key", "source", "ranges", "missing"])

    return both.mapInArrow(align, T.StructType([both.schema["key"], both.schema["source"], T.StructField("ranges", RANGES),
                                                T.StructField("missing", T.ArrayType(T.LongType()))]))


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per document that loses words: key (id, h), ranges of word numbers, sources (ids of earlier documents)."""
    pairs = stored(overlaps(docs, id_col, text_col, min_words))
    # texts that take part, read once from the documents; those of the second round are among them
    marks = stored(_marks(pairs.select(F.explode(F.array("key", "source")).alias("key"))))
    texts = stored(_marked(_keyed(docs, id_col, text_col), "key", marks, "_met").where("_met").drop("_met"))

    def of(pairs):
        """The later documents of ``pairs``, rows that are repeated too, and one row for each source."""
        met = lambda c: _marked(texts, "key", stored(_marks(pairs.select(F.col(c).alias("key")))), "_met").where("_met").drop("_met")
        return met("key"), met("source").dropDuplicates(["key"])

    first = stored(_aligned(pairs, *of(pairs), min_words))
    missing = first.select("key", F.explode("missing").alias("window")).distinct()
    more = _with_source(missing, "window").select("key", "source").distinct().join(pairs, ["key", "source"], "left_anti")
    more = stored(more.withColumn("lines", F.array().cast(T.ArrayType(T.LongType()))))
    found = first.union(_aligned(more, *of(more), min_words))
    return found.where(F.size("ranges") > 0).groupBy("key").agg(
        F.flatten(F.collect_set("ranges")).alias("ranges"), F.sort_array(F.collect_set(F.col("source")["id"])).alias("sources"))


def _cut(both: DataFrame, text_col: str, ranges: str, out: str) -> DataFrame:
    """``both`` with a column ``out``: (text, n_removed) of the rows that have ``ranges``, else null."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())])
    schema = T.StructType([*both.schema.fields, T.StructField(out, kind)])
    at, to = both.columns.index(text_col), both.columns.index(ranges)

    def run(batches):
        for batch in batches:
            text, gone, rows = batch.column(at), batch.column(to), [None] * batch.num_rows
            for k in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist():
                left, n = without(text[k].as_py() or "", united((r["start"], r["end"]) for r in gone[k].as_py()["ranges"]))
                rows[k] = {"text": left, "n_removed": n}
            new = pa.array(rows, pa.struct([("text", pa.string()), ("n_removed", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=schema.names)

    return both.mapInArrow(run, schema)


def annotate(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text",
             min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with a column ``out``: (text, n_lines, n_removed, sources, changed) - the text without the passages that
    an earlier document (smaller id; for one id, smaller text digest) holds as well.  ``n_removed`` counts whole lines;
    a text may be changed inside its lines only.

    A null text stays null, an empty one empty; neither holds a passage.  Rows equal in id and text are one
    document and are changed alike.  A null id is the earliest.  Other columns pass through (``out`` must be new).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, ranges, left = fresh(docs, "line_key"), fresh(docs, "line_ranges"), fresh(docs, "line_left")
    gone = stored(deletions(docs, id_col, text_col, min_words))
    kind = T.StructType([gone.schema["ranges"], gone.schema["sources"]])
    marked = _marked(docs.withColumn(key, _key(id_col, text_col)), key, stored(_marks(gone)), left)
    gone = gone.select(F.col("key").alias(key + "_r"), F.struct("ranges", "sources").alias(ranges))
    met = marked.where(F.col(left)).join(gone, F.col(key).eqNullSafe(F.col(key + "_r")), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    cut = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())])
    both = _cut(met.select(*columns, ranges), text_col, ranges, left).unionByName(
        marked.where(~F.col(left)).select(*columns, F.lit(None).cast(kind).alias(ranges), F.lit(None).cast(cut).alias(left)))
    cut = F.col(ranges).isNotNull()
    value = F.struct(F.when(cut, F.col(left)["text"]).otherwise(F.col(text_col)).alias("text"),
                     F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
                     F.coalesce(F.col(left)["n_removed"], F.lit(0)).cast("long").alias("n_removed"),
                     F.coalesce(F.col(ranges)["sources"], F.array().cast(T.ArrayType(docs.schema[id_col].dataType)))
                     .alias("sources"), cut.alias("changed"))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], value.alias(out))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
          min_words: int = MIN_WORDS, min_rest: float = 0.0) -> DataFrame:
    """``docs`` with the repeated passages deleted; documents of which only white space is left go, and those that keep
    less than ``min_rest`` of their words: what is left of a near copy of earlier documents is scraps.

    The columns stay as they are; ``chars_col``, if there, is the new length of changed texts."""
    out = fresh(docs, "line_result")
    done = annotate(docs, out, id_col, text_col, min_words)
    changed = F.col(out)["changed"]
    words = lambda text: F.regexp_count(text, F.lit(r"\S+"))
    enough = words(F.col(out)["text"]) >= F.greatest(F.lit(1.0), F.lit(min_rest) * words(F.col(text_col)))
    done = done.where(~changed | enough)
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col(out)["text"].alias(c))
        elif c == chars_col:
            kind = docs.schema[c].dataType
            cols.append(F.when(changed, F.char_length(F.col(out)["text"]).cast(kind)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return done.select(*cols)
