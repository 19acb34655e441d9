"""Near-duplicate detection by SimHash fingerprints and a vantage-point tree.

A fingerprint has bit i set if more than half of the document's shingle hashes
have it. Fingerprints link if they differ in at most `radius` bits. A tree of
vantage points over a bounded sample splits the fingerprint space: a
fingerprint within a vantage point's median distance m has its home on the
near side, any other on the far side. By the triangle inequality a far one can
only link to a near one if its distance is at most m + radius; such boundary
cases also visit the near side as queries. Each leaf is then a shard whose
homes are compared with its homes and visitors, so every link is found in
exactly the home shard of one of its ends, and none is lost.

A wide radius makes almost every fingerprint a visitor of both sides, so the
shards of a tree hold most of the table each. Such a search deals fingerprints
by equal blocks of bits instead (link_by_blocks), which is exact too.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import bounded_sample, checkpointed, free_name, join_unique, without
from casewright.llm.components import connected_components

BITS = 64
#: Shingles hashed at a time, so that a very long text needs little memory.
_CHUNK = 1 << 16
#: Bits are counted through counts of byte values, one table of 256 for each of the 8 places.
_BYTE_AT = np.arange(8) * 256
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Fingerprints with one value of equal bits, on average, from which on more bits must be equal; and the length from which on a run is walked breadth first.
_KEY_ROWS, _LONG_RUN = 1 << 16, 256
#: Sets of bits, and partitions that shards are dealt to, at most.
_MOST_MASKS, _MOST_TASKS = 256, 4096


def shingle_hashes(text: bytes | None, words_per_shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of the shingles of one text, in chunks; none for null or no words."""
    words = (text or b"").lower().split()
    width = min(words_per_shingle, len(words))
    for start in range(0, len(words) - width + 1 if words else 0, _CHUNK):
        part = words[start : start + _CHUNK + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        yield np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], np.uint64)


def shingle_fingerprint(text: bytes | None, words_per_shingle: int, seed: int = 42) -> int:
    """The fingerprint of one text (UTF-8); 0 for null or no words.

    A-Z are lower-cased, words are split at ASCII white space, repeated
    shingles count each time, and a text shorter than a shingle is one shingle.
    """
    return fingerprint_of(shingle_hashes(text, words_per_shingle, seed))


def fingerprint_of(chunks: Iterable[np.ndarray]) -> int:
    """The fingerprint of the shingle hashes of one text; 0 for none."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in chunks:
        counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=8 * 256).reshape(8, 256)
        ones += (counts @ _BITS_OF_BYTE).ravel()
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """Returns id_col and fp (the 64 bits as a signed long) for each row."""
    name = docs.schema[id_col].name
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = np.array([shingle_fingerprint(t.as_py(), words_per_shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=[name, "fp"])

    return docs.select(F.col(id_col).alias(name), F.col(text_col).cast("string").alias(free_name("text", [name]))).mapInArrow(run, f"`{name}` {id_type}, fp long")


@dataclass
class VantageTree:
    """Inner nodes have a vantage point and a median distance; -1 marks a leaf. Children of i: 2i+1, 2i+2."""

    points: np.ndarray
    medians: np.ndarray
    radius: int

    def route(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, index into prints and whether it is the home, for each leaf that a fingerprint belongs to or visits."""
        leaves, rows, homes = [], [], []
        todo = [(0, np.arange(len(prints)), np.ones(len(prints), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if self.medians[node] < 0:
                leaves.append(np.full(len(at), node))
                rows.append(at)
                homes.append(home)
                continue
            (near, near_home), (far, far_home) = split(prints[at], home, self.points[node], self.medians[node], self.radius)
            todo += [(2 * node + 1, at[near], near_home), (2 * node + 2, at[far], far_home)]
        if not rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return np.concatenate(leaves), np.concatenate(rows), np.concatenate(homes)


def split(prints: np.ndarray, home: np.ndarray, point: np.uint64, median: int, radius: int) -> tuple:
    """Indices and home flags for the near and the far side of a vantage point."""
    distance = np.bitwise_count(prints ^ point).astype(np.int16)
    inside = distance <= median
    near = np.flatnonzero(distance <= median + radius)
    far = np.flatnonzero(np.where(home, ~inside, distance >= median + 1 - radius))
    return (near, home[near] & inside[near]), (far, home[far])


def choose_vantage(prints: np.ndarray) -> tuple[np.uint64, int] | None:
    """The candidate whose distances spread most, with their median; None if the points cannot be halved."""
    candidates = prints[:: max(1, len(prints) // 8)][:8]
    tables = np.bitwise_count(prints[None, :] ^ candidates[:, None]).astype(np.int16)
    best = int(np.argmax(tables.var(axis=1)))
    median = int(np.median(tables[best]))
    inside = int((tables[best] <= median).sum())
    if not 0.05 * len(prints) < inside < 0.95 * len(prints):
        return None
    return candidates[best], median


def build_tree(sample: np.ndarray, radius: int, depth: int) -> VantageTree:
    """A tree over a bounded sample; the sample only places the cuts, it is never all that is indexed."""
    size = (1 << (depth + 1)) - 1
    points, medians = np.zeros(size, np.uint64), np.full(size, -1, np.int16)
    todo = [(0, np.unique(sample), 0)]
    while todo:
        node, prints, level = todo.pop()
        if level == depth or len(prints) < 8 or (chosen := choose_vantage(prints)) is None:
            continue
        points[node], medians[node] = chosen
        inside = np.bitwise_count(prints ^ chosen[0]) <= chosen[1]
        todo += [(2 * node + 1, prints[inside], level + 1), (2 * node + 2, prints[~inside], level + 1)]
    return VantageTree(points, medians, radius)


def leaf_links(homes: np.ndarray, visitors: np.ndarray, radius: int, small: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within `radius` of homes with homes and with visitors; large shards are split again by vantage points."""
    prints = np.concatenate([homes, visitors])
    todo = [(prints, np.arange(len(prints)) < len(homes))]
    while todo:
        prints, home = todo.pop()
        own = prints[home]
        if len(own) > small and (chosen := choose_vantage(own[:: max(1, len(own) // 4096)])) is not None:
            for at, flags in split(prints, home, *chosen, radius):
                todo.append((prints[at], flags))
            continue
        others = prints[~home]
        step = max(1, (1 << 20) // max(1, len(prints)))
        for start in range(0, len(own), step):
            block = own[start : start + step]
            i, j = np.nonzero(np.triu(np.bitwise_count(block[:, None] ^ own[None, start:]) <= radius, 1))
            yield block[i], own[start + j]
            if len(others):
                i, j = np.nonzero(np.bitwise_count(block[:, None] ^ others[None, :]) <= radius)
                yield block[i], others[j]


def _stars(prints: np.ndarray, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The linked fingerprints but the roots, and their roots: spanning stars instead of all pairs.

    Links within a set that is already one are passed over at once, so a
    dense cluster costs no walk over its pairs.
    """
    values = np.unique(prints)
    root = np.arange(len(values))
    for left, right in links:
        a, b = root[np.searchsorted(values, left)], root[np.searchsorted(values, right)]
        apart = a != b
        parent = np.arange(len(values)) if apart.any() else root
        for x, y in np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0).tolist():
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            parent[max(x, y)] = min(x, y)
        while (parent[root] != root).any():
            root = parent[root]
    far = np.flatnonzero(root != np.arange(len(values)))
    return values[far], values[root[far]]


def link_fingerprints(prints: DataFrame, radius: int = 2, shard_rows: int = 1024, sample_rows: int = 1 << 18, max_depth: int = 15) -> DataFrame:
    """Links between distinct fingerprints (column fp) as star edges fp, root within each shard.

    prints is read three times and should be materialised. A wide radius wants large
    shards: each level of the tree sends more copies of a fingerprint to other
    shards, while large shards are split again inside their task. The driver sees at
    most sample_rows fingerprints and the count; the tree, which goes to the
    tasks, has at most 2**(max_depth + 1) nodes.
    """
    count = prints.count()
    depth = min(max_depth, max(0, int(np.ceil(np.log2(max(1, count) / shard_rows)))))
    sample = bounded_sample(prints, "fp", min(sample_rows, 16 << depth)).collect() if depth else []
    tree = build_tree(np.array([r.fp for r in sample], np.int64).view(np.uint64), radius, depth)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64)
            leaf, row, home = tree.route(values.view(np.uint64))
            yield pd.DataFrame({"shard": leaf.astype(np.int64), "fp": values[row], "home": home})

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        values, home = shard["fp"].to_numpy(np.int64).view(np.uint64), shard["home"].to_numpy(bool)
        far, root = _stars(values, leaf_links(values[home], values[~home], radius))
        return pd.DataFrame({"fp": far.view(np.int64), "root": root.view(np.int64)})

    dealt = prints.mapInPandas(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(search, "fp long, root long")


def equal_bits(count: int, radius: int) -> list[np.uint64]:
    """Masks of bits, of which two fingerprints within `radius` agree in one at least.

    The bits are cut into radius + 1 blocks, so one of them is equal. With more
    blocks two and more of them are; so many are taken that about _KEY_ROWS
    of `count` fingerprints at most have the same bits.
    """
    more = 0
    while count > _KEY_ROWS << (more + 1) * (BITS // (radius + 1 + more)) and math.comb(radius + 2 + more, radius) <= _MOST_MASKS:
        more += 1
    blocks = np.array_split(np.arange(BITS, dtype=np.uint64), radius + 1 + more)
    return [_mask(np.concatenate(chosen)) for chosen in itertools.combinations(blocks, more + 1)]


def _mask(bits: np.ndarray) -> np.uint64:
    return np.bitwise_or.reduce(np.uint64(1) << bits, initial=np.uint64(0))


def deal_by_bits(prints: np.ndarray, masks: list[np.uint64], shards: int) -> Iterator[np.ndarray]:
    """For each mask the shard of each fingerprint; those that agree in the mask's bits share it."""
    for i, mask in enumerate(masks):
        mixed = (prints & mask) * np.uint64(0x9E3779B97F4A7C15)
        yield i * shards + ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def bit_links(prints: np.ndarray, mask: np.uint64, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that agree in the mask's bits and are within `radius`; of runs of more than _LONG_RUN candidates only pairs that join them alike.

    The bits beside the mask are cut into radius + 1 blocks again; only
    fingerprints that agree in the mask and in one of these are compared.
    """
    beside = np.array([i for i in range(BITS) if not int(mask) >> i & 1], np.uint64)
    for part in np.array_split(beside, radius + 1):
        agreed = prints & (mask | _mask(part))
        order = np.argsort(agreed)
        values, agreed = prints[order], agreed[order]
        starts = np.flatnonzero(np.append(True, agreed[1:] != agreed[:-1])) if len(values) else np.zeros(0, int)
        lengths = np.diff(np.append(starts, len(values)))
        after = np.repeat(starts + lengths, lengths) - np.arange(len(values)) - 1  # members of the run behind each place
        at = np.flatnonzero(np.repeat(lengths <= _LONG_RUN, lengths) & (after > 0))
        step = 1
        while len(at):
            near = at[np.bitwise_count(values[at] ^ values[at + step]) <= radius]
            if len(near):
                yield values[near], values[near + step]
            step += 1
            at = at[after[at] >= step]
        for start, length in zip(starts[lengths > _LONG_RUN], lengths[lengths > _LONG_RUN], strict=True):
            yield run_links(values[start : start + length], radius)


def run_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints as all pairs within `radius` would.

    Breadth first: each is compared only with those that nothing has reached
    yet, so a dense cluster takes few comparisons.
    """
    left, right, queue = [], [], []
    while len(prints):
        if not queue:
            queue, prints = [prints[0]], prints[1:]
        at = queue.pop()
        near = np.bitwise_count(prints ^ at) <= radius
        if near.any():
            right.append(prints[near])
            left.append(np.full(len(right[-1]), at))
            queue += list(right[-1])
            prints = prints[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def link_by_blocks(prints: DataFrame, radius: int, shard_rows: int = 1 << 15) -> DataFrame:
    """Links between distinct fingerprints (column fp) as star edges fp, root within each shard, for a wide radius.

    Fingerprints within the radius agree in at least one of a few sets of bits
    (equal_bits); each goes to one shard for each set, so the rows that
    move are a fixed number for each fingerprint (radius + 1 up to 30 million of them). prints is
    read twice and should be materialised; the driver sees its count.
    """
    count = prints.count()
    masks = equal_bits(count, radius)
    shards = max(1, -(-count // shard_rows))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64)
            for shard in deal_by_bits(values.view(np.uint64), masks, shards):
                yield pd.DataFrame({"shard": shard, "fp": values})

    def search(key: tuple[int], shard: pd.DataFrame) -> pd.DataFrame:
        values = shard["fp"].to_numpy(np.int64).view(np.uint64)
        far, root = _stars(values, bit_links(values, masks[key[0] // shards], radius))
        return pd.DataFrame({"fp": far.view(np.int64), "root": root.view(np.int64)})

    # A number of partitions is named, as the rows are few bytes for the work that they mean.
    dealt = prints.mapInPandas(deal, "shard long, fp long").repartition(min(len(masks) * shards, _MOST_TASKS), "shard")
    return dealt.groupBy("shard").applyInPandas(search, "fp long, root long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 2, shard_rows: int = 1024) -> DataFrame:
    """One row per input row: id, fp, component (the smallest id of its group).

    Null, empty and word-less texts have fingerprint 0 and link like any
    other. Equal fingerprints are collapsed before the search, so copies never
    become pairs. A row with a null id keeps its fingerprint; it takes the
    group's smallest non-null id, or null if there is none. Repeated ids give
    repeated rows. Extra columns are ignored; an empty table gives no rows.
    """
    name = docs.schema[id_col].name
    made = checkpointed(with_fingerprints(docs, id_col, text_col, words_per_shingle).select(F.col(name).alias("id"), "fp"))
    distinct = checkpointed(made.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("rows")))
    edges = link_fingerprints(distinct.select("fp"), radius, shard_rows)
    roots = connected_components(edges, "fp", "root").withColumnRenamed("node", "fp")
    labels = group_labels(distinct, roots, "fp")
    return join_unique(made, labels, "fp", "rows").select("id", "fp", "component")


def group_labels(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """node, rows and component (the smallest first_id of the node's group) from nodes (node, first_id, rows) and roots (node, root)."""
    grouped = checkpointed(nodes.join(roots, node, "left").withColumn("root", F.coalesce("root", node)))
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component"), F.count("*").alias("members"))
    return checkpointed(join_unique(grouped, smallest, "root", "members").select(node, "rows", "component"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, radius: int = 2, shard_rows: int = 1024) -> DataFrame:
    """Keeps one row of each group, the first of those with its smallest id; all columns are kept.

    Rows are told apart by themselves, not by their ids: of rows that share an
    id each belongs to the group of its own text. Rows without an id stay.
    """
    return first_rows(docs, id_col, text_col, lambda d: near_duplicates(d, "key", "text", words_per_shingle, radius, shard_rows))


def first_rows(docs: DataFrame, id_col: str, text_col: str, groups: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows that are not the first (smallest id, then row number) of their group.

    groups maps rows key, text to id (the key) and component (the smallest key of the group).
    """
    row = free_name("_row", docs.columns)
    numbered = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
    key = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.col(row).alias("row")))
    found = groups(numbered.select(key.alias("key"), F.col(text_col).alias("text")))
    dropped = checkpointed(found.where("id is not null and id <> component").select(F.col("id.row").alias(row)))
    return without(numbered, dropped, row).select(docs.columns)
