"""Byte-level BPE by speculate and verify.

Greedy longest match over the vocabulary proposes tokens for a word; a vectorised
check tests every adjacent pair of proposed tokens; only words with a failing pair
are merged exactly.  A token sequence is the BPE result if and only if every token
encodes to itself and every adjacent pair is what BPE makes of the pair's bytes.
Whether BPE keeps a pair apart is decided on the two spines along the seam: both
tokens are undone merge by merge, latest first, and no merge across the seam may
come earlier than the merge that hid one of its sides (:func:`compatible`).

Documents are only mapped (no shuffle); the model is a broadcast of a vocabulary
file, whose size does not depend on the data.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import BATCH_BYTES, append_column, held, ragged, text_buffer

NEVER = 1 << 40
CACHE_WORDS = 1 << 18          # distinct words kept by a Python worker; then it starts afresh


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(path: str) -> dict:
    """Plain tables of a tokenizers JSON file with a byte-level BPE model and no normaliser.

    ``path`` is read by the driver.  Returns vocab (bytes by id), merges (left, right, result ids, by rank),
    specials (text to id)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") \
            or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges") \
            or model.get("byte_fallback") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        raise ValueError(f"{path}: not a plain byte-level BPE model")
    chars, special = byte_chars(), {}
    for t in spec.get("added_tokens", []):
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
            raise ValueError(f"{path}: added token {t['content']!r} takes its surroundings")
        special[t["content"]] = t["id"]
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    size = max([*model["vocab"].values(), *special.values()]) + 1
    raw = [b""] * size
    for t, i in vocab.items():
        raw[i] = bytes(chars[c] for c in t)
    for t, i in special.items():
        raw[i] = t.encode()
    return {"bytes": raw, "special": special,
            "merges": np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)}


class Model:
    """Merge tables, the greedy matcher and the exact merger."""

    # letters, numbers, other signs and white space, as byte-level pre-tokenisers split
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

    def __init__(self, tables: dict):
        self.bytes, self.special, merges = tables["bytes"], tables["special"], tables["merges"]
        n = self.size = len(self.bytes)
        ranks = np.arange(len(merges))
        left, right, made = merges.T if len(merges) else (ranks, ranks, ranks)
        key = left * n + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], ranks[order]
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank = np.full(n, -1, np.int64)             # of the merge that makes a token; -1: a single byte
        self.left[made], self.right[made], self.rank[made] = left, right, ranks
        self.by_pair = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in enumerate(merges)}
        single = {b[0]: i for i, b in enumerate(self.bytes) if len(b) == 1}
        self.byte_id = [single[b] for b in range(256)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.all_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        # greedy may only propose tokens that BPE makes of their own bytes
        kept = np.ones(n, bool)
        kept[made] = self.compatible(left, right, ranks)
        for a, b, c in merges.tolist():
            kept[c] &= kept[a] and kept[b]
        banned = set(self.special.values())
        self.tokens = {b: i for i, b in enumerate(self.bytes) if b and kept[i] and i not in banned}
        self.longest: dict[bytes, int] = {}              # first two bytes -> longest token that begins so
        for b in self.tokens:
            if len(b) > 1:
                self.longest[b[:2]] = max(self.longest.get(b[:2], 0), len(b))
        self.words: dict[str, int] = {}
        self._reset()

    def _reset(self):
        self.words.clear()
        self.ids, self.at, self.counts = array("I"), array("q"), array("q")
        self.tables = None

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        k = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[k] == key, self.ranks[k], NEVER) if len(self.keys) else np.full(len(key), NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until=None) -> np.ndarray:
        """Whether BPE leaves each pair (a, b) apart, or (``until``) apart before that rank."""
        ok = np.ones(len(a), bool)
        who = np.arange(len(a))
        hide_a = np.full(len(a), NEVER) if until is None else until.copy()
        hide_b = np.full(len(a), NEVER - 1) if until is None else until - 1
        while len(who):
            rank = self.merge_rank(a, b)
            # a merge across the seam wins before its left side is hidden, or as that of its right side comes up
            broken = (rank < hide_a) & (rank <= hide_b)
            ok[who[broken]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~broken & ((ra >= 0) | (rb >= 0))
            who, a, b, ra, rb, hide_a, hide_b = (x[go] for x in (who, a, b, ra, rb, hide_a, hide_b))
            first = ra > rb                               # the later of the two merges is undone
            a, hide_a = np.where(first, self.right[a], a), np.where(first, ra, hide_a)
            b, hide_b = np.where(first, b, self.left[b]), np.where(first, hide_b, rb)
        return ok

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, tokens = [], 0, len(word), self.tokens
        while at < n:
            size = min(self.longest.get(word[at:at + 2], 1), n - at)
            while size > 1 and word[at:at + size] not in tokens:
                size -= 1
            out.append(tokens[word[at:at + size]] if size > 1 else self.byte_id[word[at]])
            at += size
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank, leftmost first, with a heap over linked symbols (n log n, whatever the word's length)."""
        import heapq
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.by_pair[p][0], k, p) for k in range(n - 1) if (p := (ids[k], ids[k + 1])) in self.by_pair]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if j < 0 or (ids[k], ids[j]) != pair:
                continue
            ids[k], ids[j] = self.by_pair[pair][1], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            after[j] = -1
            for x in (before[k], k):
                if x >= 0 and after[x] >= 0 and (p := (ids[x], ids[after[x]])) in self.by_pair:
                    heapq.heappush(heap, (self.by_pair[p][0], x, p))
        return [i for i in ids if i >= 0]

    def learn(self, new: list[str]) -> None:
        """Token ids of words not seen yet: greedy proposals, one check of all adjacent pairs, exact merges of the rest."""
        raw = [w.encode("utf-8", "replace") for w in new]
        made = [self.greedy(w) for w in raw]
        size = np.array([len(m) for m in made], np.int64)
        flat = np.fromiter((i for m in made for i in m), np.int64, int(size.sum()))
        word = np.repeat(np.arange(len(made)), size)
        seam = np.flatnonzero(word[1:] == word[:-1])
        if len(seam):
            pairs, which = np.unique(flat[seam] * self.size + flat[seam + 1], return_inverse=True)
            good = self.compatible(pairs // self.size, pairs % self.size)[which]
            for k in np.unique(word[seam[~good]]).tolist():
                made[k] = self.exact(raw[k])
        for w, m in zip(new, made, strict=True):
            self.words[w] = len(self.at)
            self.at.append(len(self.ids))
            self.counts.append(len(m))
            self.ids.extend(m)
        self.tables = None

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, their counts)."""
        if len(self.words) > CACHE_WORDS:
            self._reset()
        words = self.words
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special and any(s in t for t in texts if t for s in self.special) else None
        pieces: list[str] = []
        upto, markers = [0], []
        for text in texts:
            for k, part in enumerate(cut.split(text) if cut and text else [text or ""]):
                if k % 2:
                    markers.append((len(pieces), self.special[part]))
                    pieces.append("")
                else:
                    pieces += self.SPLIT.findall(part)
            upto.append(len(pieces))
        if new := [w for w in dict.fromkeys(pieces) if w not in words]:
            self.learn(new)
        if self.tables is None:
            self.tables = (np.array(self.ids, np.uint32), np.array(self.at, np.int64), np.array(self.counts, np.int64))
        ids, at, counts = self.tables
        which = np.fromiter(map(words.__getitem__, pieces), np.int64, len(pieces))
        size = counts[which] if len(pieces) else np.zeros(0, np.int64)
        start = at[which] if len(pieces) else size
        if markers:                                      # special tokens: one id each, behind the learned ones
            ids = np.concatenate([ids, np.array([i for _, i in markers], np.uint32)])
            where = np.array([k for k, _ in markers])
            size[where], start[where] = 1, len(ids) - len(markers) + np.arange(len(markers))
        total = np.concatenate([[0], np.cumsum(size)])
        return ids[ragged(start, size)], np.diff(total[np.array(upto)])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.all_bytes[ragged(self.offsets[ids], self.lengths[ids])].tobytes()


def _model(shared) -> Model:
    """The worker's model of a broadcast vocabulary."""
    return held("bpe", id(shared), lambda: (Model(shared.value), shared))[0]


def vocabulary(spark: SparkSession, path: str):
    """Broadcast tables of a vocabulary file; pass it to :func:`encode` and :func:`decode`."""
    return spark.sparkContext.broadcast(load(path))


def encode(docs: DataFrame, shared, out: str = "ids", text_col: str = "text", limit: int = BATCH_BYTES) -> DataFrame:
    """``docs`` with the ids of each whole text as little-endian unsigned 32-bit integers in one binary column.

    The text of a special token becomes that token, as tokenizers do by default.  A null or empty text has no
    ids (an empty binary).  Repeated rows are each encoded; other columns pass through (``out`` must be new).
    ``limit``: bytes of text encoded at once; fewer take less memory and a little more time.
    """
    def make(col):
        ids, counts = _model(shared).encode(col.to_pylist())
        raw = ids.astype("<u4").tobytes()
        at = 4 * np.concatenate([[0], np.cumsum(counts)])
        return pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())

    return append_column(docs, out, T.BinaryType(), text_col, make, owner="bpe", limit=limit)


def decode(coded: DataFrame, shared, out: str = "decoded", ids_col: str = "ids") -> DataFrame:
    """``coded`` with the text of each ids binary; bytes that are not UTF-8 become U+FFFD; null or empty ids give ''."""
    def make(col):
        model, (data, offs) = _model(shared), text_buffer(col)
        raw = data.tobytes()
        return pa.array([model.decode(np.frombuffer(raw[a:b], "<u4").astype(np.int64)).decode("utf-8", "replace")
                         for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.string())

    return append_column(coded, out, T.StringType(), ids_col, make, owner="bpe")
