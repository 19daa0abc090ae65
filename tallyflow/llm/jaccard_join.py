"""Near copies by the Jaccard similarity of their word shingles, cut into vertical fragments.

The order of all shingles is that of their hashes, and it is cut into ranges,
the fragments. Every document is cut along with it: each fragment gets the piece
of each document's set that falls into it, however long the document is.

1. A fragment counts, for each document, the shingles that any other document
   has too. A document with fewer than 75 % of such shingles, summed over the
   fragments, has no partner, whatever it is; most documents end here, and only
   the shared shingles of the others come back.
2. Candidates share one of their rarest shared shingles (prefix filter: of n
   shingles, one of the n - ceil(0.75 n) + 1 first in a common order must be
   shared). Equal sets are brought down to one document before.
3. A pair's overlap is counted apart in every fragment and summed per pair.

Links are needed only to connect documents, so not every pair becomes a row. All
documents of a group that shares a shingle are first compared with one of them.
Where a group is then still in several components, its documents are compared
tile by tile: two chunks of them in one task, overlaps counted in fragments and
summed in a matrix, of which only a spanning set of links leaves the task.
Nothing is capped.

A shingle is a 64-bit hash. One that many documents of a batch share reaches its
fragment once from that batch, marked as frequent, while the documents get their
answer directly, so no fragment gathers all documents with a common shingle.

Defined results: a text without words, or null, has no shingles and no links.
Rows with the same or no key are documents of their own; the class id is the
smallest key that is not null among those connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import Words, lower_ascii, mixed, numbered, release, rolled, slices, text_bytes
from tallyflow.llm.components import components
from tallyflow.session import staged

WORDS = 5
PERCENT = 75
# Shingles in this many documents or more rank alike in the prefix order.
FREQUENT = 32
PIECES = 4
# Documents in a chunk of a large block, and frequent shingles counted at a time.
CHUNK = 768
TOKENS = 1 << 21
FRAGMENT = 1024
PAIRS_AT_ONCE = 1 << 19


def shingle_sets(column: pa.Array, length: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: hashes sorted by hash, and their text."""
    data, ends = text_bytes(column)
    words = Words(lower_ascii(data), ends)
    h = words.hashes()
    tokens, at = words.windows(length, words=h)
    owner = words.owner[at]
    few = np.flatnonzero((words.count > 0) & (words.count < length))
    if len(few):
        short = np.empty(len(few), np.uint64)
        for i, d in enumerate(few):
            run = h[words.first[d] : words.first[d + 1]]
            short[i] = mixed(rolled(run, len(run)) + np.uint64(len(run)))[0]
        tokens, owner = np.concatenate([tokens, short]), np.concatenate([owner, few])
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[new], owner[new]


# Blobs. To fragments: first row, flags, row steps, the 56 low bits of the hashes.
# To documents: rows, hashes, frequencies.


def to_fragment(base: int, rows: np.ndarray, tokens: np.ndarray, weights: np.ndarray) -> bytes:
    low = np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :7]
    return b"".join([np.array([base, len(rows)], np.int64).tobytes(), np.diff(rows, prepend=0).astype(np.uint16).tobytes(), weights.tobytes(), low.tobytes()])


def from_fragment(blob: memoryview, number: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base, n = np.frombuffer(blob, np.int64, 2)
    rows = np.cumsum(np.frombuffer(blob, np.uint16, n, 16), dtype=np.int64) + base
    weights = np.frombuffer(blob, np.uint8, n, 16 + 2 * n)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :7] = np.frombuffer(blob, np.uint8, 7 * n, 16 + 3 * n).reshape(-1, 7)
    tokens = wide.view(np.uint64).ravel()
    keep = np.uint64(64 - bits) if bits else None
    if keep is not None:
        tokens = (tokens & np.uint64((1 << (64 - bits)) - 1)) | (np.uint64(number) << keep)
    return rows, tokens, weights


def to_documents(rows: np.ndarray, tokens: np.ndarray, often: np.ndarray) -> bytes:
    return b"".join([np.array([len(rows)], np.int64).tobytes(), rows.tobytes(), tokens.tobytes(), often.tobytes()])


def from_documents(blob: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n,) = np.frombuffer(blob, np.int64, 1)
    return np.frombuffer(blob, np.int64, n, 8), np.frombuffer(blob, np.uint64, n, 8 + 8 * n), np.frombuffer(blob, np.uint8, n, 8 + 16 * n)


def bucket_of(rows: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(rows.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def batch_of(key: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (part, doc_id, row, n, blob)."""
    parts, ids, numbers, sizes, blobs = zip(*rows) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int64()), pa.array(ids, key), pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())],
        ["part", "doc_id", "row", "n", "blob"],
    )


def bucketed(rows: np.ndarray, tokens: np.ndarray, often: np.ndarray, buckets: int, shift: int) -> list[tuple]:
    """Answers to documents, one blob for each bucket of documents."""
    bucket = bucket_of(rows, buckets)
    order = np.lexsort((rows, bucket))
    rows, tokens, often, bucket = rows[order], tokens[order], often[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(rows) else []
    return [
        (int(bucket[a]) + shift, None, None, None, to_documents(rows[a:b], tokens[a:b], often[a:b]))
        for a, b in zip(cuts[:-1], cuts[1:])
    ]


def close_rows(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the numbers of its rows are from the first one's on, by less than ``limit``."""
    numbers, start = batch["row"].to_numpy(), 0
    while start < len(numbers):
        ahead = numbers[start:] - numbers[start]
        far = np.flatnonzero((ahead < 0) | (ahead >= limit))
        stop = start + int(far[0]) if len(far) else len(numbers)
        yield batch.slice(start, stop - start)
        start = stop


def deal(batches: Iterator[pa.RecordBatch], bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Cuts documents along the fragments. Parts from 2 ** bits on are buckets of documents."""
    fragments = 1 << bits
    for whole in slices(batches, 3 << 20):
        for batch in close_rows(whole, 1 << 16):
            key = batch["doc_id"].type
            tokens, owner = shingle_sets(batch["text"])
            count = np.bincount(owner, minlength=batch.num_rows)
            numbers = batch["row"].to_numpy()
            base, steps = int(numbers[0]), numbers - numbers[0]
            homes = bucket_of(numbers, buckets) + fragments
            yield batch_of(key, list(zip(homes.tolist(), batch["doc_id"].to_pylist(), numbers.tolist(), count.tolist(), [None] * batch.num_rows)))
            new = np.ones(len(tokens), bool)
            new[1:] = tokens[1:] != tokens[:-1]
            starts = np.flatnonzero(new)
            spans = np.diff(np.append(starts, len(tokens)))
            often = np.repeat(spans >= FREQUENT, spans)
            if often.any():
                rows, found = numbers[owner[often]], tokens[often]
                yield batch_of(key, bucketed(rows, found, np.full(len(rows), FREQUENT, np.uint8), buckets, fragments))
            sent = ~often | new
            weights = np.where(often, FREQUENT, 1).astype(np.uint8)[sent]
            tokens, owner = tokens[sent], owner[sent]
            number = (tokens >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.searchsorted(number, np.arange(fragments + 1))
            rows = []
            for f in range(fragments):
                a, b = cuts[f], cuts[f + 1]
                if a < b:
                    order = np.argsort(owner[a:b], kind="stable") + a
                    rows.append((f, None, None, None, to_fragment(base, steps[owner[order]], tokens[order], weights[order])))
            yield batch_of(key, rows)


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows of each part of a partition that is sorted by part."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("part", "doc_id", "row", "n")]
            yield from zip(*columns, batch["blob"])

    return groupby(rows(), key=itemgetter(0))


def count_shared(batches: Iterator[pa.RecordBatch], bits: int, buckets: int, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Tells documents which of their shingles in a fragment others have too."""
    fragments = 1 << bits
    for part, rows in parts_of(batches):
        if part >= fragments:
            passed = []
            for _, doc_id, row, n, blob in rows:
                passed.append((part - fragments, doc_id, row, n, blob.as_py()))
                if len(passed) == 1000:
                    yield batch_of(key, passed)
                    passed = []
            yield batch_of(key, passed)
            continue
        pieces = [from_fragment(r[4].as_buffer(), part, bits) for r in rows]
        docs, tokens, weights = (np.concatenate(c) for c in zip(*pieces))
        order = np.argsort(tokens, kind="stable")
        docs, tokens, weights = docs[order], tokens[order], weights[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        total = np.add.reduceat(weights.astype(np.int64), starts)
        spans = np.diff(np.append(starts, len(tokens)))
        total = np.repeat(np.minimum(total, FREQUENT), spans).astype(np.uint8)
        answered = (total > 1) & (weights == 1)  # frequent ones have been answered
        yield batch_of(key, bucketed(docs[answered], tokens[answered], total[answered], buckets, 0))


def gather(batches: Iterator[pa.RecordBatch], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One row per document; with its shared shingles if they are enough for a partner."""
    for _, rows in parts_of(batches):
        known, answers = [], []
        for _, doc_id, row, n, blob in rows:
            if row is None:
                answers.append(from_documents(blob.as_buffer()))
            else:
                known.append((doc_id, row, n))
        ids = pa.array([k[0] for k in known], key)
        numbers, sizes = np.array([k[1] for k in known], np.int64), np.array([k[2] for k in known], np.int64)
        order = np.argsort(numbers)
        numbers, sizes, ids = numbers[order], sizes[order], ids.take(pa.array(order))
        if answers:
            docs, tokens, often = (np.concatenate(c) for c in zip(*answers))
        else:
            docs, tokens, often = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        order = np.lexsort((tokens, often, docs))
        docs, tokens, often = docs[order], tokens[order], often[order]
        first, last = np.searchsorted(docs, numbers), np.searchsorted(docs, numbers, side="right")
        enough = (last > first) & (100 * (last - first) >= PERCENT * sizes)
        sets = [tokens[a:b].tobytes() if e else None for a, b, e in zip(first, last, enough)]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(numbers), pa.array(sizes), pa.array(sets, pa.binary())], ["doc_id", "row", "n", "tokens"]
        )


def shared_shingles(docs: DataFrame) -> DataFrame:
    """doc_id, row, n (shingles) and, where a partner is possible, the shared ones in prefix order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chars = docs.select(F.sum(F.length("text").cast("long"))).first()[0] or 0
    bits = min(20, max(8, (chars // (12 << 20)).bit_length()))
    buckets = max(64, chars // (12 << 20))
    key = pa_type(docs)
    schema = f"part long, doc_id {kind}, row long, n long, blob binary"
    return staged(
        numbered(docs, "doc_id", "text")
        .mapInArrow(lambda b: deal(b, bits, buckets), schema)
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(lambda b: count_shared(b, bits, buckets, key), schema)
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(lambda b: gather(b, key), f"doc_id {kind}, row long, n long, tokens binary"),
        "shared-shingles",
    )


def pa_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, row and n for each shared shingle in a document's prefix."""
    for batch in batches:
        keys, rows, sizes = [], [], []
        for row, n, blob in zip(batch["row"].to_pylist(), batch["n"].to_pylist(), batch["tokens"]):
            tokens = np.frombuffer(blob.as_buffer(), np.int64)
            alone = n - len(tokens)
            prefix = tokens[: max(0, n - -(-PERCENT * n // 100) + 1 - alone)]
            keys.append(prefix)
            rows.append(np.full(len(prefix), row))
            sizes.append(np.full(len(prefix), n))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, rows, sizes)], ["key", "row", "n"])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sets along the hash order into fragments for counting overlaps."""
    for batch in batches:
        rows, numbers, blobs = [], [], []
        for row, blob in zip(batch["row"].to_pylist(), batch["tokens"]):
            tokens = np.sort(np.frombuffer(blob.as_buffer(), np.uint64))
            cuts = np.searchsorted(tokens, np.arange(1, PIECES).astype(np.uint64) * np.uint64((1 << 64) // PIECES))
            for f, piece in enumerate(np.split(tokens, cuts)):
                if len(piece):
                    rows.append(row)
                    numbers.append(f)
                    blobs.append(piece.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["row", "fragment", "piece"])


def partial_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [
            len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
            for x, y in zip(batch["piece_a"], batch["piece_b"])
        ]
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["both_n"], pa.array(counts, pa.int64())], ["a", "b", "both_n", "overlap"])


def linked(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """The pairs (a, b, both_n) that are similar enough: overlaps by fragment, summed per pair."""
    left = pairs.join(cut.select(F.col("row").alias("a"), "fragment", F.col("piece").alias("piece_a")), "a")
    both = left.join(cut.select(F.col("row").alias("b"), "fragment", F.col("piece").alias("piece_b")), ["b", "fragment"])
    partial = both.select("a", "b", "both_n", "piece_a", "piece_b").mapInArrow(partial_overlaps, "a long, b long, both_n long, overlap long")
    total = F.sum("overlap")
    return (
        partial.groupBy("a", "b", "both_n")
        .agg(total.alias("overlap"))
        .filter(100 * F.col("overlap") >= PERCENT * (F.col("both_n") - F.col("overlap")))
        .select("a", "b")
    )


def similar_size(n: str, m: str) -> F.Column:
    return (100 * F.col(n) >= PERCENT * F.col(m)) & (100 * F.col(m) >= PERCENT * F.col(n))


def star_links(keys: DataFrame, cut: DataFrame) -> DataFrame:
    """Links of documents with the centre of a group that they share most keys with.

    One comparison for each document at most, however large its groups are.
    """
    centres = staged(keys.groupBy("key").agg(F.min(F.struct("row", "n")).alias("centre")), "centres")
    pairs = (
        keys.join(centres, "key")
        .filter("row != centre.row")
        .select(F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("centre.row").alias("b"), F.col("centre.n").alias("n_b"))
        .filter(similar_size("n_a", "n_b"))
        .groupBy("a", "b", "n_a", "n_b")
        .agg(F.count("*").alias("shared"))
        .groupBy("a", "n_a")
        .agg(F.max(F.struct("shared", "b", "n_b")).alias("best"))
        .select("a", F.col("best.b").alias("b"), (F.col("n_a") + F.col("best.n_b")).alias("both_n"))
    )
    return staged(linked(staged(pairs, "pairs"), cut), "links")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))


def open_blocks(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """row, label and block of documents that a shared key could still connect to another label.

    Documents of one block reach each other through keys that they share, within
    a range of sizes that allows a link; pairs from two blocks need no comparison.
    """
    band = F.floor(F.log("n") / F.log(F.lit(1.0001 * 100 / PERCENT))).cast("int")
    banded = with_labels(keys, labels).withColumn("band", F.explode(F.array(band, band + 1)))
    groups = banded.groupBy("key", "band").agg(
        F.min("row").alias("first"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    split = banded.join(staged(groups.filter("low < high"), "open-groups"), ["key", "band"])
    edges = staged(split.filter("row != first").select(F.col("first").alias("a"), F.col("row").alias("b")).distinct(), "block-edges")
    blocks = components(edges).withColumnRenamed("label", "block")
    return staged(with_labels(blocks, labels), "blocks")


def tiles(blocks: DataFrame) -> DataFrame:
    """row and tile: which documents are compared with which.

    ``blocks`` has row, n (shingles), label and block. The largest label of a block
    needs no comparison with itself. All others are cut into chunks, and every pair
    of chunks is a tile, like every pair of one of them and a chunk of the largest
    label. Small blocks are one tile. A chunk has about ``CHUNK`` documents, or fewer
    long ones with about ``TOKENS`` shingles.
    """
    counts = blocks.groupBy("block", "label").agg(F.count("*").alias("n_label"), F.sum("n").alias("tokens"))
    sizes = staged(
        counts.groupBy("block").agg(
            F.max(F.struct("n_label", "label", "tokens")).alias("top"), F.sum("n_label").alias("n_block"), F.sum("tokens").alias("all_tokens")
        ),
        "block-sizes",
    )
    parts = lambda rows, tokens: F.ceil(F.greatest(rows / CHUNK, tokens / TOKENS))
    sized = (
        blocks.join(sizes, "block")
        .withColumn("main", F.col("label") == F.col("top.label"))
        .withColumn("mains", parts(F.col("top.n_label"), F.col("top.tokens")))
        .withColumn("others", parts(F.col("n_block") - F.col("top.n_label"), F.col("all_tokens") - F.col("top.tokens")))
        .withColumn("whole", (F.col("n_block") <= 2 * CHUNK) & (F.col("all_tokens") <= 2 * TOKENS))
        .filter("n_block > top.n_label")
    )
    chunk = F.pmod(F.xxhash64("row"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    name = lambda kind, i, j: F.xxhash64("block", F.lit(kind), i, j)
    mine = F.col("chunk")
    found = (
        F.when(F.col("whole"), F.array(F.xxhash64("block")))
        .when(F.col("main"), F.transform(upto("others"), lambda i: name("main", i, mine)))
        .otherwise(
            F.concat(
                F.transform(upto("others"), lambda j: name("other", F.least(mine, j), F.greatest(mine, j))),
                F.transform(upto("mains"), lambda k: name("main", mine, k)),
            )
        )
    )
    return sized.withColumn("chunk", chunk).select("row", F.explode(found).alias("tile"))


def overlaps(tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many tokens any two of ``n`` sets share: counted in fragments of the order, and summed."""
    total = np.zeros((n, n), np.float32)
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
    spans = np.diff(np.append(starts, len(tokens)))
    for f in np.unique(spans[(spans > 1) & (spans < FREQUENT)]).tolist():
        places = starts[spans == f]
        i, j = np.triu_indices(f, 1)
        step = max(1, PAIRS_AT_ONCE // len(i))
        for at in range(0, len(places), step):
            group = owner[places[at : at + step, None] + np.arange(f)]
            found, count = np.unique(group[:, i].ravel() * n + group[:, j].ravel(), return_counts=True)
            total.ravel()[found] += count
    often = np.flatnonzero(spans >= FREQUENT)
    for at in range(0, len(often), FRAGMENT):
        part = often[at : at + FRAGMENT]
        held = np.zeros((n, len(part)), np.float32)
        for column, k in enumerate(part):
            held[owner[starts[k] : starts[k] + spans[k]], column] = 1
        total += np.triu(held @ held.T, 1)
    return total + total.T


def tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the documents of a tile that are connected by links: the first of them and each other."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in ("tile", "row", "n")), batch["tokens"])

    for _, members in groupby(rows(), key=itemgetter(0)):
        _, numbers, sizes, blobs = zip(*members)
        numbers, sizes = np.array(numbers), np.array(sizes)
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in blobs]
        order = np.argsort(numbers)
        owner = np.repeat(np.argsort(order), [len(x) for x in sets])
        numbers, sizes, n = numbers[order], sizes[order], len(order)
        shared = overlaps(np.concatenate(sets), owner, n).astype(np.int64)
        near = 100 * shared >= PERCENT * (sizes[:, None] + sizes - shared)
        np.fill_diagonal(near, False)
        first, second = [], []
        unseen = near.any(1)
        for start in np.flatnonzero(unseen):
            if not unseen[start]:
                continue
            unseen[start] = False
            front = np.array([start])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & unseen)
                unseen[front] = False
                first += [numbers[start]] * len(front)
                second += numbers[front].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["a", "b"])


def candidate_links(sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """row and label for each document that is linked to another.

    ``sets`` (row, n, tokens) are looked at if their row is in ``firsts``.
    """
    cut = sets.select("row", "tokens").mapInArrow(pieces, "row long, fragment int, piece binary")
    keys = sets.select("row", "n", "tokens").mapInArrow(prefixes, "key long, row long, n long")
    keys = staged(keys.join(firsts, "row", "left_semi"), "prefix-keys")
    links = star_links(keys, cut)
    release(sets.sparkSession)
    blocks = open_blocks(keys, components(links))
    release(sets.sparkSession)
    blocks = staged(blocks.join(sets.select("row", "n"), "row"), "sized-blocks")
    spread = sets.select("row", "n", "tokens").join(tiles(blocks), "row").select("tile", "row", "n", "tokens")
    more = spread.repartition("tile").sortWithinPartitions("tile").mapInArrow(tile_links, "a long, b long")
    return components(staged(links.unionByName(more), "all-links"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Of each class the row with the smallest key is kept.
    """
    rows = shared_shingles(docs)
    release(docs.sparkSession)
    open_sets = rows.filter(F.col("tokens").isNotNull())
    # A set whose shingles are all shared may equal another one.
    digest = F.when(F.col("n") * 8 == F.length("tokens"), F.sha2("tokens", 256)).otherwise(F.concat(F.lit("row "), "row"))
    named = staged(open_sets.select("row", digest.alias("digest")), "set-digests")
    first = staged(named.groupBy("digest").agg(F.min("row").alias("first")), "first-of-sets")
    firsts = staged(named.join(first, "digest").select("row", "first"), "set-classes")
    labels = candidate_links(open_sets, firsts.filter("row = first").select("row"))
    member = firsts.join(labels.withColumnRenamed("row", "first"), "first", "left").select("row", F.coalesce("label", "first").alias("first"))
    labelled = rows.select("doc_id", "row", "n").join(member, "row", "left").withColumn("label", F.coalesce("first", "row"))
    labelled = staged(labelled, "labelled")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    # Written, like other aggregates here that rows of a large group are joined with:
    # Spark splits a hot key only where both sides are shuffled for the join.
    smallest = staged(labelled.groupBy("label").agg(F.min(order).alias("first_of")), "first-of-classes")
    return labelled.join(smallest, "label").select(
        "doc_id",
        "row",
        F.col("n").alias("n_shingles"),
        F.col("first_of.doc_id").alias("component_id"),
        (F.col("row") == F.col("first_of.row")).alias("kept"),
    )
