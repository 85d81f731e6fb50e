"""Spelling variants: words one edit apart, found by reduced alphabets.

Letters are hashed to a few symbols.  Every word generates the one-edit neighbourhood of its reduced form (itself, every
replaced, deleted and inserted symbol) as 64-bit keys, which are joined with the reduced forms of the vocabulary: words
one edit apart have reduced forms at most one edit apart.  Neighbourhoods are whole, but an edge between two reduced words
is generated at one of its ends only (one word's insertion is the other's deletion), as it is found from either.  The
original strings decide about the pairs that meet.  Each word follows its most frequent near word
that is at least ``ratio`` times as frequent as itself; as counts grow along such a chain, its last word is found by
pointer jumping in a number of rounds that is the logarithm of the chain's length.

* A null text has no words; an empty table or one without words gives no rows.
* Texts of any length are read whole, in slices of documents; a word of any length is compared whole (its neighbourhood
  has up to ``SYMBOLS`` keys per letter and travels without the word).
* Ties between near words of equal count: the smallest in code-point order.  Repeated rows count as often as they occur.
* A null id is written as an empty string where ``typo_every`` hashes it.  Other columns are never looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, mix, powers, ragged, slices, text_buffer, words_of

SYMBOLS = 8                     # letters are reduced to this many symbols
SHORT = 64                      # bytes; longer words are hashed one by one
BLOCK = 1 << 20                 # keys generated at a time

_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def letter_runs(data: np.ndarray, offs: np.ndarray):
    """``words_of`` for maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased (in UTF-8 the latter are two
    bytes, the first of them always 0xC3)."""
    lead = data == 0xC3
    letter = _ASCII[data] | lead
    letter[1:] |= lead[:-1]
    return words_of(np.where(letter, data, np.uint8(32)), offs, _LOWER)


def run_crcs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each word of ``flat``, continued from ``state`` (the crc32 of what precedes it), all words in step."""
    table = _crc_table()
    order = np.argsort(-sizes, kind="stable")
    order = order[np.searchsorted(-sizes[order], -SHORT, side="left"):]
    c, at, size = state[order] ^ np.uint32(0xFFFFFFFF), starts[order], sizes[order]
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for k, m in enumerate(live):
        c[:m] = table[(c[:m] ^ flat[at[:m] + k]) & np.uint32(0xFF)] ^ (c[:m] >> np.uint32(8))
    out = np.zeros(len(sizes), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > SHORT):
        out[i] = zlib.crc32(flat[starts[i]:starts[i] + sizes[i]].tobytes(), int(state[i]))
    return out


def _word_counts(ids: pa.Array, texts: pa.Array, min_letters: int, typo_every: int) -> pa.RecordBatch:
    """(word, n) of one slice of documents."""
    flat, starts, ends, first = letter_runs(*text_buffer(texts))
    sizes = ends - starts
    before = np.concatenate([[0], np.cumsum((flat & 0xC0) == 0x80)])
    letters = sizes - (before[ends] - before[starts])
    plain, odd = letters >= min_letters, []
    if typo_every:
        head = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
        h = run_crcs(flat, starts, sizes, np.repeat(head, np.diff(first)))
        for i in np.flatnonzero(h % np.uint32(typo_every) == 0):
            word = flat[starts[i]:ends[i]].tobytes().decode("utf-8", "replace")
            gone = int(h[i]) % len(word)
            if len(word) > min_letters:
                odd.append(word[:gone] + word[gone + 1:])
        plain &= h % np.uint32(typo_every) != 0
    size = sizes[plain]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = flat[ragged(starts[plain], size)]
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())
    counted = pa.concat_arrays([words, pa.array(odd, pa.string())]).value_counts()
    return pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts").cast(pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 5,
               min_count: int = 3, typo_every: int = 0) -> DataFrame:
    """(word, n): lower-cased words of at least ``min_letters`` letters that occur ``min_count`` times or more.

    With ``typo_every``, words whose crc32 of ``<id>:<word>`` it divides lose one letter first (the crc modulo the
    word's length): misspellings that are the same in every run, to measure the grouping on.  Slices of documents are
    counted where they are read; only (word, count) rows are shuffled.
    """
    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield _word_counts(part.column(0), part.column(1), min_letters, typo_every)

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= min_count)


# ---------------------------------------------------------------------------
# neighbourhoods
# ---------------------------------------------------------------------------

_M = powers(2)[1]
_M_INVERSE = np.uint64(pow(int(_M), -1, 1 << 64))


def _key(total, length: int):
    return mix(total + np.uint64(length * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)


def reduced_keys(reduced: np.ndarray, symbols: int, around: bool):
    """Blocks (rows of ``reduced``, keys) for words of one length; ``reduced`` holds symbols from 1 on, a word a row.

    ``around``: keys of the one-edit neighbourhood, each string once, in which an edge between two reduced words is
    listed at one of its ends: a symbol is replaced by larger ones only, and a symbol that the one has more is deleted
    there.  Else only the keys of the words themselves.
    """
    _, length = reduced.shape
    power = powers(length + 1)
    step = max(1, BLOCK // max(length * symbols, 1))
    for lo in range(0, len(reduced), step):
        s = reduced[lo:lo + step].astype(np.uint64)
        rows = np.arange(lo, lo + len(s))
        upto = np.concatenate([np.zeros((len(s), 1), np.uint64), np.cumsum(s * power[:length], axis=1, dtype=np.uint64)], 1)
        total = upto[:, -1:]
        yield rows, _key(total[:, 0], length)
        if not around:
            continue
        for d in range(2, symbols + 1):
            d = np.uint64(d)
            smaller = s < d
            r, _ = np.nonzero(smaller)
            yield rows[r], _key((total + (d - s) * power[:length])[smaller], length)
        if length:
            first = np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], 1)
            r, _ = np.nonzero(first)                         # of equal neighbours, deleting the first is enough
            yield rows[r], _key((upto[:, :-1] + (total - upto[:, 1:]) * _M_INVERSE)[first], length - 1)


def _keys(vocab: DataFrame, symbols: int, around: bool) -> DataFrame:
    """(key, wid) of the reduced forms of words or of their neighbourhoods."""
    def run(batches):
        for batch in batches:
            words = batch.column(1).to_pylist()
            wid = batch.column(0).to_numpy()
            sizes = np.array([len(w) for w in words], np.int64)
            points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            starts = np.cumsum(sizes) - sizes
            for length in np.unique(sizes):
                of = np.flatnonzero(sizes == length)
                reduced = points[starts[of][:, None] + np.arange(length)] % np.uint64(symbols) + np.uint64(1)
                for rows, keys in reduced_keys(reduced, symbols, around):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(wid[of[rows]])], names=["key", "wid"])

    return vocab.select("wid", "word").mapInArrow(run, "key long, wid long")


def near_words(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): every pair of words that differ by exactly one inserted, deleted or replaced code point,
    from both sides.  ``vocab``: distinct (word, n)."""
    named = vocab.select(F.xxhash64("word").alias("wid"), "word", "n")
    a = _keys(named, symbols, True).toDF("key", "a")
    b = _keys(named, symbols, False).toDF("key", "b")
    # reduced words that are equal meet from both sides, others once
    pairs = a.join(b, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = named.select(F.col("wid").alias("a"), F.struct("word", "n").alias("x"))
    right = named.select(F.col("wid").alias("b"), F.struct("word", "n").alias("y"))
    met = pairs.join(left, "a").join(right, "b").where(F.levenshtein("x.word", "y.word", 1) == 1)
    both = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    return met.select(F.inline(both)).select("x.word", "x.n", F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): ``root`` is the last word of the chain of forms.  Chains must end."""
    at = checkpoint(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = checkpoint(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                            F.col("further").isNotNull().alias("moved")))
        at = met.select("word", "root")
        if met.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 5, min_count: int = 3,
             ratio: int = 2, symbols: int = SYMBOLS, typo_every: int = 0) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary; ``form`` and ``form_n`` are null for a
    word that follows no other."""
    vocab = checkpoint(vocabulary(docs, id_col, text_col, min_letters, min_count, typo_every))
    best = near_words(vocab, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    follows = -F.col("top.less") >= ratio * F.col("n")
    known = checkpoint(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(follows, F.col("top.near")).alias("form"), F.when(follows, -F.col("top.less")).alias("form_n")))
    return known.join(roots(known), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
