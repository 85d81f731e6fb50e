"""Jaccard self-join on word n-grams with prefix filters under several global token orders.

A token is a 64-bit hash of ``size`` consecutive words.  Two sets of similarity t share a
token among the first n - ceil(t n) + 1 of each under *any* common order of all tokens.

* The first order goes by hash, but puts tokens that many prefixes hold last, by frequency.  Its prefixes
  are the index: shared prefix tokens are counted per pair, and the count bounds the overlap.
* Every set has a sketch of 128 bytes (:func:`sketch`): one bitmap for its prefix under each of two further
  hash orders, and one with the parity of its tokens in 512 cells.  A pair must share a bit under both orders,
  and the bits in which the parities differ must not be more than the tokens in which linked sets may differ
  (:func:`_screen`).  Neither can lose a link.  The filters of all orders are intersected where a pair is met,
  before its whole sets are fetched; what is left is verified on them, so every link is exact.

Documents with equal sets are one class.  A first round compares each class with one centre
only (the smallest class among those it shares tokens with, by most shared tokens); classes
linked so far are never paired again, so large groups of near copies cost a star, not a
square.  The second round meets every remaining pair of different components, so no link
between components is lost; a pair whose sets have one of their few smallest tokens in common
is met at the smallest of these only, not at every token it shares.  What the filters admit is
verified as a star first as well, and then whatever is still apart.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, checkpoint, forget, fresh, list_array, mix, text_buffer, word_hashes, words_of
from .components import components

SIZE = 5
THRESHOLD = (4, 5)
COMMON = 32                      # a token in more prefixes than this goes to the end of the first order
ORDER_BYTES = 8 << 20            # broadcast for that: at most this many bytes of the most common tokens
PER_TASK = 128                   # sets compared with one copy of a centre's set
FIRST = 4                        # smallest shared tokens of a set that are kept with its sketch
FEW = 8                          # members of a component that share a token: up to so many are paired one by one
SMALL_IDS = 1 << 20              # ids (8 bytes each) that are broadcast rather than joined by a shuffle
SLICE = 1 << 19                  # bytes of text hashed at once

# bytes: A-Z to lower case; white space (09-0D, 20) separates; the rest stay
SPACE_WORDS = np.arange(256, dtype=np.uint8)
SPACE_WORDS[0x41:0x5B] = np.arange(0x61, 0x7B)
SPACE_WORDS[0x09:0x0E] = 32

_P = np.cumprod(np.full(64, np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)


def token_sets(col: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct tokens of each text: hashes of ``size`` words, of all words if there are fewer."""
    data, offs = text_buffer(col)
    flat, starts, ends, first = words_of(data, offs, SPACE_WORDS)
    h = word_hashes(flat, starts, ends)
    n = max(len(h) - size + 1, 0)
    run = np.zeros(n, np.uint64)
    for k in range(size):
        run += h[k:k + n] * _P[k]
    run = mix(run)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(run[a:b - size + 1])
            again = s[1:] == s[:-1]
            out.append(s[np.append(True, ~again)] if again.any() else s)
        elif b > a:
            out.append(mix((h[a:b] * _P[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n, threshold):
    num, den = threshold
    return n - (num * n + den - 1) // den + 1


def _rest(n, threshold):
    """Tokens of a set of n behind its prefix."""
    num, den = threshold
    return (num * n + den - 1) // den - 1


def head_length(n, threshold):
    """Tokens kept of a set of n: its prefix by hash and some more, as common ones among them go to the end."""
    p = prefix_length(n, threshold)
    return min(n, p + p // 8 + 8) if n else 0


def _prefix(tokens: np.ndarray, n: int, common: tuple[np.ndarray, np.ndarray], threshold) -> np.ndarray | None:
    """The first tokens in the first order: by hash, the common ones last and the most common at the very end.

    ``tokens``: the smallest hashes of a set of ``n``, all of them or a head; None if a head holds too few that are not
    common.  ``common``: the common tokens sorted, and the place of each among them by frequency."""
    p, (late, place) = int(prefix_length(n, threshold)) if n else 0, common
    if not p or not len(late):
        return tokens[:p]
    at = np.minimum(np.searchsorted(late, tokens), len(late) - 1)
    is_late = late[at] == tokens
    soon = tokens[~is_late][:p]
    if len(soon) == p:
        return soon
    if len(tokens) < n:
        return None
    return np.concatenate([soon, tokens[is_late][np.argsort(place[at[is_late]], kind="stable")]])[:p]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


SEEDS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))       # the further orders
CELLS, HEAD = 8, 4               # words of 64 bits of the parity and of a prefix bitmap


def sketches(sets: list[np.ndarray], threshold) -> np.ndarray:
    """A row for each set: CELLS words with the parity of the tokens that fall into each of 512 cells, then HEAD words for
    each further order: a bitmap of the prefix under that order."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), sizes)
    cells, wide = 64 * CELLS, 64 * HEAD
    bits = [np.bincount(row * cells + (tokens >> np.uint64(55)).astype(np.int64), minlength=n * cells).reshape(n, cells) & 1]
    ends = np.cumsum(sizes).tolist()
    lengths = [int(prefix_length(k, threshold)) if k else 0 for k in sizes.tolist()]
    for seed in SEEDS:
        h = mix(tokens ^ seed)
        heads = [h[e - k:e] if p >= k else np.partition(h[e - k:e], p - 1)[:p]
                 for e, k, p in zip(ends, sizes.tolist(), lengths, strict=True)]
        head = np.zeros(n * wide, np.uint8)
        if n:
            head[np.repeat(np.arange(n), lengths) * wide
                 + (np.concatenate(heads) & np.uint64(wide - 1)).astype(np.int64)] = 1
        bits.append(head.reshape(n, wide))
    return np.packbits(np.concatenate(bits, axis=1).astype(np.uint8), axis=1).view(np.int64)


def sketch(tokens: np.ndarray, threshold) -> np.ndarray:
    """The sketch of one set."""
    return sketches([tokens], threshold)[0]


WORDS = [f"q{k}" for k in range(CELLS + HEAD * len(SEEDS))]
FIRSTS = [f"f{k}" for k in range(FIRST)]
SUMMARY = T.StructType([*[T.StructField(c, T.LongType(), False) for c in ("n", "s1", "s2", *WORDS)],
                        T.StructField("head", T.ArrayType(T.LongType(), False), False)])
PREFIX = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.LongType()))])


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    """A list array of signed tokens; None stays null."""
    flat = [x for x in parts if x is not None]
    made = list_array(_signed(np.concatenate(flat)) if flat else [], [0 if x is None else len(x) for x in parts], pa.int64())
    gone = pa.array([x is None for x in parts], pa.bool_())
    return pa.ListArray.from_arrays(made.offsets, made.values, mask=gone) if len(flat) < len(parts) else made


def _summary(col: pa.Array, size: int, threshold) -> pa.Array:
    sets = token_sets(col, size)
    digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    q = sketches(sets, threshold)
    numbers = [np.array([len(s) for s in sets], np.int64), both[:, 0], both[:, 1], *q.T]
    heads = _lists([s[:head_length(len(s), threshold)] for s in sets])
    return pa.StructArray.from_arrays([*[pa.array(np.ascontiguousarray(x), pa.int64()) for x in numbers], heads],
                                      names=SUMMARY.names)


def _words(x: str) -> list[Column]:
    """The words of the sketch of row ``x`` of a join."""
    return [F.col(f"{x}.{c}") for c in WORDS]


def _screen(x: str, y: str, a: Column, b: Column, threshold) -> Column:
    """:func:`_screen_words` for sketches in the array columns ``x`` and ``y``."""
    return _screen_words(*([F.col(c)[k] for k in range(len(WORDS))] for c in (x, y)), a, b, threshold)


def _screen_words(x: list[Column], y: list[Column], a: Column, b: Column, threshold) -> Column:
    """Whether the sketches ``x`` and ``y`` of sets of a and b tokens allow a link: a common prefix token under every further
    order, and no more differing cells than linked sets have differing tokens."""
    num, den = threshold
    ok = _differing(x, y) * (num + den) <= (a + b) * (den - num)
    for k in range(len(SEEDS)):
        at = range(CELLS + k * HEAD, CELLS + (k + 1) * HEAD)
        meet = functools.reduce(lambda u, v: u.bitwiseOR(v), [x[i].bitwiseAND(y[i]) for i in at])
        ok = ok & (meet != 0)
    return ok


def _differing(x: list[Column], y: list[Column]) -> Column:
    """In how many cells the parities of two sketches differ."""
    return functools.reduce(lambda u, v: u + v, [F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(CELLS)])


def _least_shared(a: Column, b: Column, threshold) -> Column:
    """Fewest prefix tokens that sets of a and b tokens share if they link."""
    num, den = threshold
    overlap = F.ceil(num * (a + b) / F.lit(float(num + den)) - 1e-9)
    rest = lambda n: F.ceil(num * n / F.lit(float(den)) - 1e-9) - 1
    return F.greatest(F.lit(1), overlap - F.greatest(rest(a), rest(b)))


def _near_size(a: Column, b: Column, threshold) -> Column:
    return F.least(a, b) * threshold[1] >= F.greatest(a, b) * threshold[0]


def linked(a: np.ndarray, b: np.ndarray, threshold) -> bool:
    """Whether two sorted token sets link."""
    num, den = threshold
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * den >= num * (len(a) + len(b) - shared)


def _best(pairs: DataFrame, by: str = "shared") -> DataFrame:
    """The pair of each b with the a of the largest ``by``: the a that shares most prefix tokens with it."""
    return pairs.groupBy("b").agg(F.max_by("a", F.struct(by, -F.col("a"))).alias("a")).select("a", "b")


def _still_apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components of ``links``."""
    roots = checkpoint(components(links))
    for side in ("a", "b"):
        root = roots.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
        pairs = pairs.join(root, side, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


class Join:
    """One self-join: ``classes`` (id, n, rep) and ``links`` (a, b) between class representatives."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, threshold, common: int):
        self.size, self.threshold = size, threshold
        self.docs = docs.where(F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        found = append_column(self.docs, "set", SUMMARY, "text", lambda col: _summary(col, size, threshold), limit=SLICE)
        found = checkpoint(found.select("id", "set.*"))
        self.sketches = found.select("id", *WORDS).dropDuplicates(["id"])
        least = found.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"))
        self.classes = checkpoint(found.select("id", "n", "s1", "s2").join(least, ["s1", "s2"], "left")
                                  .select("id", "n", F.coalesce("rep", "id").alias("rep")))
        copies = self.classes.groupBy("id").agg(F.min(F.col("id") != F.col("rep")).alias("copy")).where("copy").select("id")
        heads = found.where("n > 0").select("id", "n", "head").join(self._small(checkpoint(copies)), "id", "left_anti")
        self.sets = self._shared_sets(self._entries(heads, self._common(heads, common)))

    @staticmethod
    def _small(ids: DataFrame) -> DataFrame:
        """``ids``, broadcast if they are few."""
        return F.broadcast(ids) if ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS else ids

    def _common(self, heads: DataFrame, common: int):
        """Broadcast of the tokens that most prefixes hold under the plain hash order: at most ORDER_BYTES."""
        num, den = self.threshold
        length = (F.col("n") - F.ceil(F.col("n") * num / F.lit(float(den)) - 1e-9) + 1).cast("int")
        often = heads.select(F.explode(F.slice("head", 1, length)).alias("token")) \
            .groupBy("token").count().where(F.col("count") > common) \
            .orderBy(F.desc("count"), "token").limit(ORDER_BYTES // 12).select("token")
        tokens = np.array(often.toArrow().column(0).to_pylist(), np.int64).view(np.uint64)[::-1]   # least common first
        order = np.argsort(tokens, kind="stable")
        return heads.sparkSession.sparkContext.broadcast((tokens[order], order.astype(np.int32)))

    def _entries(self, heads: DataFrame, common) -> DataFrame:
        """(token, id, n) for the prefix of every set of ``heads``; texts are read again where a head is too short."""
        size, threshold = self.size, self.threshold

        def from_heads(batches):
            for batch in batches:
                ids, n, head = batch.columns
                offs, flat = head.offsets.to_numpy(), head.values.to_numpy().view(np.uint64)
                found = [_prefix(flat[a:b], k, common.value, threshold)
                         for a, b, k in zip(offs[:-1].tolist(), offs[1:].tolist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, n.cast(pa.int32()), _lists(found)], names=["id", "n", "tokens"])

        def from_texts(col):
            sets = token_sets(col, size)
            return pa.StructArray.from_arrays([pa.array([len(s) for s in sets], pa.int32()),
                                               _lists([_prefix(s, len(s), common.value, threshold) for s in sets])], names=PREFIX.names)

        prefixes = heads.select("id", "n", "head").mapInArrow(
            from_heads, T.StructType([T.StructField("id", T.LongType()), *PREFIX.fields]))
        short = checkpoint(prefixes.where("tokens is null").select("id").distinct())
        texts = self.docs.join(self._small(short), "id", "left_semi")
        again = append_column(texts, "set", PREFIX, "text", from_texts, limit=SLICE).select("id", "set.*")
        return prefixes.union(again).select("id", "n", F.explode("tokens").alias("token"))

    def _shared_sets(self, entries: DataFrame) -> DataFrame:
        """(id, n, r, m, f0.., tokens) of the sets that share prefix tokens with another: those tokens, and how many they
        are (m), so that two sets share at most the smaller m; r: tokens of the set behind its prefix."""
        num, den = self.threshold
        dealt = entries.repartition("token")
        held = dealt.groupBy("token").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("token")
        own = dealt.join(held.hint("shuffle_hash"), "token").groupBy("id", "n") \
            .agg(F.array_sort(F.collect_set("token")).alias("tokens"))
        rest = F.ceil(F.col("n") * num / F.lit(float(den)) - 1e-9).cast("int") - 1
        firsts = [F.coalesce(F.get("tokens", F.lit(k)), F.col("tokens")[0]).alias(c) for k, c in enumerate(FIRSTS)]
        return checkpoint(own.select("id", "n", rest.alias("r"), F.size("tokens").alias("m"), *firsts, "tokens"))

    @property
    def entries(self) -> DataFrame:
        """(token, id, n, r, m) of the shared sets."""
        return self.sets.select("id", "n", "r", "m", F.explode("tokens").alias("token"))

    def _sets(self, ids: DataFrame) -> DataFrame:
        """(id, set) of the documents whose id is in ``ids``, with the tokens as 8-byte binaries."""
        chosen = self.docs.join(self._small(ids), "id", "left_semi")
        size = self.size
        return append_column(chosen, "set", T.BinaryType(), "text", lambda col: pa.array(
            [s.tobytes() for s in token_sets(col, size)], pa.binary()), limit=SLICE).select("id", "set").dropDuplicates(["id"])

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link. A centre ``a`` of many is copied once for every PER_TASK others."""
        threshold = self.threshold
        sets = self._sets(checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_TASK).cast("long").alias("parts"))
        dealt = pairs.join(tasks, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "parts")).select("a", "b", "salt")
        other = dealt.join(sets.select(F.col("id").alias("b"), F.col("set").alias("right")), "b")
        centre = tasks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt")) \
            .join(sets.select(F.col("id").alias("a"), F.col("set").alias("left")), "a")

        def check(batches):
            for batch in batches:
                at = {c: k for k, c in enumerate(batch.schema.names)}
                left, right = batch.column(at["left"]), batch.column(at["right"])
                keep = [linked(np.frombuffer(left[k].as_py(), np.uint64), np.frombuffer(right[k].as_py(), np.uint64), threshold)
                        for k in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(at["a"]), batch.column(at["b"])], names=["a", "b"]) \
                    .filter(pa.array(keep, pa.bool_()))

        return other.join(centre, ["a", "salt"]).select("a", "b", "left", "right").mapInArrow(check, "a long, b long")

    def _fits(self, x: str, y: str) -> Column:
        """Whether sets of sizes x.n and y.n can link, with at most the smaller m prefix tokens in common."""
        (num, den), n, k = self.threshold, F.col(f"{x}.n"), F.col(f"{y}.n")
        most = F.least(f"{x}.m", f"{y}.m") + F.greatest(f"{x}.r", f"{y}.r")
        return _near_size(n, k, self.threshold) & (most * F.lit(num + den).cast("long") >= (n + k) * F.lit(num).cast("long"))

    def _counted(self, met: DataFrame) -> DataFrame:
        """Pairs (a, b, shared) that share enough prefix tokens; ``met`` has a row (a, b, n, k) for each shared token."""
        return met.groupBy("a", "b", "n", "k").agg(F.count("*").alias("shared")) \
            .where(F.col("shared") >= _least_shared(F.col("n"), F.col("k"), self.threshold))

    def _chosen(self, met: DataFrame) -> DataFrame:
        """Per set b the centre a that shares most prefix tokens with it, of those that all filters admit."""
        pairs = self._counted(met)
        for side in ("a", "b"):
            pairs = pairs.join(self.sketches.select(F.col("id").alias(side), F.struct(*WORDS).alias(f"q{side}")), side)
        return checkpoint(_best(pairs.where(
            _screen_words(_words("qa"), _words("qb"), F.col("n"), F.col("k"), self.threshold))))

    def first_round(self) -> DataFrame:
        """Links of every class with one centre."""
        e = self.entries
        centre = e.groupBy("token").agg(F.min(F.struct("id", "n", "r", "m")).alias("c")).select("token", "c.*")
        met = e.alias("x").join(centre.alias("c"), (F.col("x.token") == F.col("c.token")) & (F.col("x.id") != F.col("c.id"))
                                & self._fits("x", "c")) \
            .select(F.col("c.id").alias("a"), F.col("x.id").alias("b"), F.col("x.n").alias("n"), F.col("c.n").alias("k"))
        return self.verify(self._chosen(met))

    def _apart(self, roots: DataFrame) -> DataFrame:
        """Entries (token, root, id, n, r, m, c, f0.., q0..) whose token several components of ``roots`` hold, dealt by
        token; c: holders of that root."""
        own = self.sets.drop(*FIRSTS).join(roots, "id", "left").withColumn("root", F.coalesce("component", "id"))
        e = own.select("id", "n", "r", "m", "root", F.explode("tokens").alias("token"))
        of_token = Window.partitionBy("token")
        e = e.withColumn("c", F.count("*").over(Window.partitionBy("token", "root")).cast("int")) \
            .withColumn("lo", F.min("root").over(of_token)).withColumn("hi", F.max("root").over(of_token)) \
            .where("lo <> hi").drop("lo", "hi")
        firsts = self.sets.groupBy("id").agg(*[F.min(c).alias(c) for c in FIRSTS])
        return e.join(firsts.join(self.sketches, "id"), "id").repartition("token")

    def _admits(self, x: str, y: str) -> Column:
        """The filters of all orders for two sketched entries of one token, and whether it is the one to meet at: the
        smallest that both sets have among their FIRST, any where these have nothing in common."""
        fx, fy = ([F.col(f"{s}.{c}") for c in FIRSTS] for s in (x, y))
        meet = F.coalesce(*[F.when(f.isin(*fy), f) for f in fx], F.col(f"{x}.token"))
        return self._fits(x, y) & _screen_words(_words(x), _words(y), F.col(f"{x}.n"), F.col(f"{y}.n"), self.threshold) \
            & (meet == F.col(f"{x}.token"))

    def second_round(self, apart: DataFrame) -> DataFrame:
        """Pairs (a, b, like) of different components that all filters admit; like: the larger, the fewer cells of their
        parities differ for their sizes.

        Among a token's holders, those of components with FEW of them are joined with each other; larger components are
        joined as one row with the holders outside, and only what fits is spread to its members.  A pair becomes a row
        only if the filters of all orders admit it.
        """
        e, few = apart, F.col("c") <= FEW
        one = e.where(few)
        x, y = one.alias("x"), one.alias("y")
        pair = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"),
                (-_differing(_words("x"), _words("y")) / (F.col("x.n") + F.col("y.n"))).alias("like")]
        single = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id"))
                        & (F.col("x.root") != F.col("y.root")) & self._admits("x", "y")).select(*pair)
        num, den = self.threshold
        group = e.where(~few).groupBy("token", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).alias("g")
        outside = e.alias("y").join(group, (F.col("y.token") == F.col("g.token")) & (F.col("y.root") != F.col("g.root"))
                                    & ((F.col("y.c") <= FEW) | (F.col("y.root") < F.col("g.root")))
                                    & (F.col("y.n") * den >= F.col("g.lo") * num) & (F.col("y.n") * num <= F.col("g.hi") * den)) \
            .select("y.*", F.col("g.root").alias("other"))
        spread = e.where(~few).alias("x").join(
            outside.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.root") == F.col("y.other"))
            & self._admits("x", "y")).select(*pair)
        return checkpoint(single.union(spread).groupBy("a", "b").agg(F.max("like").alias("like")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold=THRESHOLD,
            common: int = COMMON) -> DataFrame:
    """Per document: id, n_shingles (its distinct tokens) and component_id, the smallest id reachable by links.

    Texts of no words (null, empty, white space) are linked with nothing.  Rows with equal sets are linked without
    comparison.  Ids are expected to be unique; a repeated row is repeated in the result, rows of one id with different
    texts are one node, and a row with a null id takes no part in links: its component_id is null.  A very long text is
    one row in each task that handles it, with 8 bytes for each of its tokens.  An empty table gives no rows.  Other
    columns of ``docs`` are not read, whatever their names.
    """
    join = Join(docs, id_col, text_col, size, threshold, common)
    forget(docs.sparkSession)
    links = checkpoint(join.first_round())
    forget(docs.sparkSession)
    pairs = join.second_round(join._apart(checkpoint(components(links))))
    forget(docs.sparkSession)
    links = checkpoint(links.union(join.verify(checkpoint(_best(pairs, "like")))))
    rest = checkpoint(_still_apart(pairs, links))
    both = checkpoint(components(links.union(join.verify(rest))))
    rows = join.classes.join(both.withColumnRenamed("id", "rep"), "rep", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    nameless = append_column(docs.where(F.col(id_col).isNull()).select(F.col(text_col).alias("text")), "set", SUMMARY, "text",
                             lambda col: _summary(col, size, threshold), limit=SLICE)
    return rows.union(nameless.select(F.lit(None).cast("long"), F.col("set.n"), F.lit(None).cast("long")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold=THRESHOLD,
             common: int = COMMON) -> DataFrame:
    """``docs`` with only the smallest id of each component; columns unchanged. Rows with a null id stay."""
    gone_id = fresh(docs, "gone_id")
    gone = classes(docs, id_col, text_col, size, threshold, common).where(F.col("component_id") != F.col(id_col)) \
        .select(F.col(id_col).alias(gone_id)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")
