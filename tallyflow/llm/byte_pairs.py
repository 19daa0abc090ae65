"""Byte-level BPE by ranks, with a segment tree over byte positions.

A piece of text starts as one token per byte. The leaves of a segment tree hold
the rank of each token with its right neighbour, at the byte where the token
starts; every inner node holds the smaller of its two halves, the left one at a
tie. So the root is the leftmost pair of lowest rank. A merge changes three
leaves, those of the merged token, of the token it swallowed and of its left
neighbour, and each change is carried up in logarithmic time.

Pieces that a batch has not met before are encoded together: the trees of all
pieces of one size class lie side by side in numpy and merge in step. Longer
pieces use the same tree one by one. A pair is ranked by its joined bytes, and a
piece that is itself in the vocabulary is one token, as in tiktoken.

Defined results: null is the empty text, which has no ids. Every row is encoded
alone, so null and repeated keys and other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyflow.llm.common import slices

NEVER = 1 << 62
CLASSES = (8, 16, 32, 64)
# Pieces that a worker remembers; at the limit it starts anew. Results do not depend on it.
REMEMBERED = 400_000


class BytePairs:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.remembered: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)

    # one piece

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, ranks = len(piece), self.ranks
        size = 1 << max(n - 1, 1).bit_length()
        after, before = list(range(1, n + 1)), list(range(-1, n))
        rank_at = lambda a, b: ranks.get(piece[a:b], NEVER) if b <= n else NEVER
        tree = [NEVER * size] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = rank_at(i, i + 2) * size + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, key: int) -> None:
            node = size + leaf
            tree[node] = key
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b

        while tree[1] < NEVER * size:
            i = tree[1] % size
            swallowed = after[i]
            end = after[swallowed]
            after[i], before[end] = end, i
            put(swallowed, NEVER * size)
            put(i, rank_at(i, after[end]) * size + i if end < n else NEVER * size)
            if before[i] >= 0:
                put(before[i], rank_at(before[i], end) * size + before[i])
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    # many pieces

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {c: [] for c in CLASSES}
        for at, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[at] = whole.to_bytes(4, "little")
            elif len(piece) > CLASSES[-1]:
                out[at] = np.array(self.encode_piece(piece), "<u4").tobytes()
            else:
                classes[next(c for c in CLASSES if len(piece) <= c)].append(at)
        for size, members in classes.items():
            for start in range(0, len(members), 8192):
                part = members[start : start + 8192]
                for at, ids in zip(part, self.in_step([pieces[at] for at in part], size)):
                    out[at] = ids
        return out

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, or -1."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], -1)

    def in_step(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The segment trees of all pieces, each of at most ``size`` bytes, side by side."""
        count, levels = len(pieces), size.bit_length() - 1
        length = np.array([len(p) for p in pieces])
        grid = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size)
        place = np.arange(size + 1)
        ids = np.where(place < length[:, None], np.pad(self.of_byte[grid], ((0, 0), (0, 1))), -1)
        after, before = np.tile(place + 1, (count, 1)).ravel(), np.tile(place - 1, (count, 1)).ravel()
        tree = np.full((count, 2 * size), NEVER)
        found = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, size)
        tree[:, size:] = np.where((found >= 0) & (place[1:] < length[:, None]), found * size + place[:-1], NEVER)
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        tree, ids = tree.ravel(), ids.ravel()
        live = np.arange(count)
        while True:
            live = live[tree[live * (2 * size) + 1] < NEVER]
            if not len(live):
                break
            row, root = live * (size + 1), live * (2 * size)
            merged, i = np.divmod(tree[root + 1], size)
            swallowed = after[row + i]
            end = after[row + swallowed]
            p = before[row + i]
            ids[row + i], ids[row + swallowed] = merged, -1
            after[row + i], before[row + end] = end, i
            right = np.where(end < length[live], self.rank_of(merged, ids[row + np.minimum(end, size)]), -1)
            left = np.where(p >= 0, self.rank_of(ids[row + np.maximum(p, 0)], merged), -1)
            leaf = root + size
            tree[leaf + swallowed] = NEVER
            tree[leaf + np.where(p >= 0, p, i)] = np.where(left >= 0, left * size + p, NEVER)
            tree[leaf + i] = np.where(right >= 0, right * size + i, NEVER)
            nodes = np.stack([size + i, size + swallowed, size + np.where(p >= 0, p, i)])
            for _ in range(levels):
                nodes >>= 1
                child = root + 2 * nodes
                tree[root + nodes] = np.minimum(tree[child], tree[child + 1])
        alive = ids.reshape(count, size + 1) >= 0
        ends = np.cumsum(alive.sum(1)) * 4
        packed = ids.reshape(count, size + 1)[alive].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    # texts

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        pieces = [self.pattern.findall(t) for t in texts]
        known = self.remembered
        new = [p for p in set().union(*pieces) if p not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set().union(*pieces))
        known.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        return [b"".join(map(known.__getitem__, p)) for p in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> BytePairs:
    """Loaded once in each worker."""
    return BytePairs.load(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (array of integers) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in slices(batches):
            packed = words.encode_texts([t or "" for t in batch["text"].to_pylist()])
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.ListArray.from_arrays(pa.array(ends), ids)], ["doc_id", "ids"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key_type(docs)}, ids array<int>")


def key_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in slices(batches):
            packed = words.encode_texts([t or "" for t in batch["text"].to_pylist()])
            decoded = [words.decode(np.frombuffer(p, "<u4")) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {key_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
