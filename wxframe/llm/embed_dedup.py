"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A table hashes a vector with ``functions`` pseudo-random rotations (three rounds of random
signs and a Hadamard transform): the hash is the signed coordinate that is largest after
each.  Buckets are probed at the most likely neighbours too.  Two vectors are a candidate
pair if one's own bucket is among the other's probed ones in some table, and a pair counts
in the first such bucket only, so nothing is counted twice and no pair list is kept: tasks
compute tiles of a bucket as matrix products, and send back a sum of links and a local
root per vector.  Equal vectors of a label are one weighted vector throughout.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, ragged
from .components import components

TABLES = 10
FUNCTIONS = 3
PROBES = 4                      # buckets per vector and table, its own included
TILE = 512                      # vectors of a bucket compared in one tile with as many others
COSINE = 0.93


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long)."""
    n, d = x.shape
    x = x.copy()
    step = 1
    while step < d:
        v = x.reshape(n, d // (2 * step), 2, step)
        a, b = v[:, :, 0].copy(), v[:, :, 1].copy()
        v[:, :, 0], v[:, :, 1] = a + b, a - b
        step *= 2
    return x


def _signs(dim: int, seed: int, tables: int, functions: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (tables, functions, 3, dim))


def hashes(x: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """Bucket numbers, own first, then by likelihood: (vector, table, probe).

    A probe replaces one function's coordinate by its runner-up; the smallest loss in coordinate comes first."""
    n, d = x.shape
    dim = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, dim - d)))
    out = np.zeros((n, tables, probes), np.int64)
    sign = _signs(dim, seed, tables, functions)
    for t in range(tables):
        own = np.zeros(n, np.int64)
        loss, change = np.zeros((n, functions, 2)), np.zeros((n, functions, 2), np.int64)
        for f in range(functions):
            y = x
            for r in range(3):
                y = hadamard(y * sign[t, f, r]) / np.sqrt(dim)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :3]
            val = np.take_along_axis(y, top, 1)
            code = 2 * top + (val < 0)
            place = (2 * dim) ** f
            own += code[:, 0] * place
            for k in range(2):
                later = min(k + 1, code.shape[1] - 1)
                loss[:, f, k] = np.abs(val[:, 0]) - np.abs(val[:, later])
                change[:, f, k] = (code[:, later] - code[:, 0]) * place
        loss, change = loss.reshape(n, -1), change.reshape(n, -1)
        order = np.argsort(loss, axis=1, kind="stable")[:, :probes - 1]
        out[:, t, 0] = own
        out[:, t, 1:1 + order.shape[1]] = own[:, None] + np.take_along_axis(change, order, 1)
        out[:, t, 1 + order.shape[1]:] = own[:, None]
    return out


def _vectors(col: pa.Array, dims: np.ndarray) -> np.ndarray:
    """Unit rows of list values that all have ``dims`` components."""
    x = np.array(col.to_pylist(), np.float64).reshape(len(col), dims)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def owner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of probe tables: table and bucket in which the pair counts, -1 if none: (pair, 2)."""
    big = np.iinfo(np.int64).max
    out = np.full((len(a), 2), -1, np.int64)
    for t in range(a.shape[1] - 1, -1, -1):
        mine = np.where((b[:, t] == a[:, t, :1]).any(1), a[:, t, 0], big)
        theirs = np.where((a[:, t] == b[:, t, :1]).any(1), b[:, t, 0], big)
        least = np.minimum(mine, theirs)
        hit = least < big
        out[hit, 0], out[hit, 1] = t, least[hit]
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id reachable by the pairs (i, j), for each of n rows."""
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        if (new == root).all():
            return root
        root = new


def prepare(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Every row as (id, label, vector, key): key identifies equal comparable vectors and is null where none can link."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    plain = F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) \
        & F.exists("vector", lambda v: v != 0)
    norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    able = plain & F.col("label").isNotNull() & (norm > 0) & (norm < float("inf"))
    key = F.when(F.coalesce(able, F.lit(False)), F.sha2(F.concat_ws("|", F.lit("v"), F.array_join(
        F.transform("vector", lambda v: (v + 0.0).cast("string")), ",")), 256))
    return rows.withColumn("key", key)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES,
                    tile: int = TILE) -> DataFrame:
    """Per row: id, n_links (other rows found with a cosine of at least ``cosine``), component_id (smallest id
    reachable by such links), kept (the row's id is that).

    Only rows of one non-null label and equal length are compared; vectors that are null, empty, zero or hold a null,
    NaN or infinity link with nothing.  Repeated rows are vectors of their own; a row with a null id is linked and
    counted, but is never a component's smallest id unless all ids are null.  Index: every vector is hashed, no bucket
    is cut; large buckets are split into tiles of ``tile`` vectors.
    """
    rows = prepare(vectors, id_col, vector_col, label_col)
    reps = checkpoint(rows.where("key is not null").groupBy("label", "key").agg(
        F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
        .withColumn("rep", F.xxhash64("label", "key")))

    def codes(batches):
        for batch in batches:
            rep, col = batch.column(0), batch.column(1)
            dims = np.diff(np.asarray(col.offsets)) if batch.num_rows else np.zeros(0, int)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                code = hashes(_vectors(col.take(pa.array(at)), int(d)), tables, functions, probes)
                n, width = len(at), code.shape[1] * code.shape[2]
                yield pa.RecordBatch.from_arrays(
                    [rep.take(pa.array(at)), pa.array(np.full(n, d), pa.int32()),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(code.ravel(), pa.int64()))],
                    names=["rep", "dims", "code"])

    hashed = reps.select("rep", "vector").mapInArrow(codes, "rep long, dims int, code array<long>")
    reps = checkpoint(reps.join(hashed, "rep"))
    # one entry per vector and probed bucket; buckets that hold one vector, or nobody's own, are done
    entry = reps.select("rep", "label", "dims", F.posexplode("code").alias("p", "bucket")) \
        .select("rep", "label", "dims", F.floor(F.col("p") / probes).cast("int").alias("t"), "bucket",
                (F.col("p") % probes == 0).alias("own"))
    entry = entry.groupBy("label", "dims", "t", "bucket", "rep").agg(F.max("own").alias("own"))
    full = entry.groupBy("label", "dims", "t", "bucket").agg(F.count("*").alias("n"), F.max("own").alias("any")) \
        .where("n > 1 and any").select("label", "dims", "t", "bucket", F.ceil(F.col("n") / tile).cast("int").alias("blocks"))
    place = ["label", "dims", "t", "bucket"]
    entry = entry.join(full, place).withColumn("block", F.pmod(F.col("rep"), F.col("blocks").cast("long")).cast("int"))
    # block k of m meets blocks k..m-1, so it is sent to tiles (i, k) and (k, j)
    to = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least("block", k).alias("x"), F.greatest("block", k).alias("y"))))
    dealt = entry.select("rep", "t", "bucket", "block", to.alias("to"), F.xxhash64(*place).alias("place"))
    data = reps.select("rep", F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "weight", "vector", "code")
    joined = dealt.join(data, "rep").withColumn("tile", F.xxhash64("place", "to")) \
        .select("tile", "t", "bucket", F.col("to.x").alias("x"), F.col("to.y").alias("y"), "block", "rep", "weight", "vector", "code")
    sorted_rows = joined.repartition("tile", "t", "bucket").sortWithinPartitions("tile", "t", "bucket", "x", "y", "block", "rep")

    def tiles(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            keys = np.stack([table.column(k).to_numpy() for k in (0, 1, 2)], 1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if len(cut):
                yield from _groups(table.slice(0, cut[-1]), np.append(0, cut[:-1]), cosine, tables)
            rest = table.slice(cut[-1]) if len(cut) else table
        if rest is not None and rest.num_rows:
            yield from _groups(rest, np.array([0]), cosine, tables)

    found = sorted_rows.mapInArrow(tiles, T.StructType([
        T.StructField("rep", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType())]))
    found = checkpoint(found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select("rep", "root"))
    named = reps.select("rep", "id").join(comp.withColumnRenamed("id", "rep"), "rep")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    result = reps.select("label", "key", "rep", "id", "weight").join(links, "rep", "left") \
        .join(named.join(least, "component").select("rep", "component_id"), "rep", "left") \
        .select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("component_id", "id").alias("component_id"))
    out = rows.select("id", "label", "key").join(result, ["label", "key"], "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


SMALL = 24                      # tiles of so few rows are compared together, pair by pair


def _pairs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, block, bx, by, cosine: float):
    """Row numbers (i, j) of all pairs within a tile whose cosine reaches ``cosine``."""
    size = ends - starts
    few = (size <= SMALL) & (bx[starts] == by[starts])
    first = ragged(starts[few], size[few])
    last = np.repeat(ends[few], size[few])
    i = np.repeat(first, last - first - 1)
    j = ragged(first + 1, last - first - 1)
    out = []
    for k in range(0, len(i), 1 << 16):
        a, b = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
        near = np.einsum("nd,nd->n", x[a], x[b]) >= cosine
        out.append((a[near], b[near]))
    for a, b in zip(starts[~few].tolist(), ends[~few].tolist(), strict=True):
        same = bx[a] == by[a]
        left = a + np.arange(b - a) if same else a + np.flatnonzero(block[a:b] == bx[a])
        right = left if same else a + np.flatnonzero(block[a:b] == by[a])
        p, q = np.nonzero(x[left] @ x[right].T >= cosine)
        if same:
            p, q = p[p < q], q[p < q]
        out.append((left[p], right[q]))
    none = np.zeros(0, np.int64)
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (none, none)


def _groups(table: pa.Table, starts: np.ndarray, cosine: float, tables: int):
    """Links and local roots of whole tiles of one vector length each; ``starts`` are their first rows."""
    table = table.combine_chunks()
    ends = np.append(starts[1:], table.num_rows)
    get = lambda name: table.column(name).to_numpy()
    vec, code = table.column("vector").chunk(0), table.column("code").chunk(0)
    at = np.asarray(vec.offsets)
    dims = np.diff(at)
    flat, code = np.asarray(vec.values), np.asarray(code.flatten()).reshape(table.num_rows, tables, -1)
    for d in np.unique(dims):
        own = dims[starts] == d
        rows = ragged(starts[own], (ends - starts)[own])
        size = (ends - starts)[own]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        x = flat[ragged(at[rows], dims[rows])].reshape(len(rows), d)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        t, bucket, block, bx, by, rep, weight = (get(c)[rows] for c in ("t", "bucket", "block", "x", "y", "rep", "weight"))
        i, j = _pairs(x, begin, begin + size, block, bx, by, cosine)
        mine = owner(code[rows[i]], code[rows[j]])       # a pair counts in one bucket only
        keep = (mine[:, 0] == t[i]) & (mine[:, 1] == bucket[i])
        i, j = i[keep], j[keep]
        links = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
        root = _roots(len(rows), i, j, rep)
        hit = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])],
                                         names=["rep", "links", "root"])
