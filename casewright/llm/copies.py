"""Near-duplicate groups whose links are verified by the exact similarity of shingle sets.

Candidates come from two searches: fingerprints within a radius (equal blocks
of bits, simhash.link_by_blocks), and MinHash bands, which reach the pairs whose
fingerprints differ in more bits. Both give stars, never all pairs. Each
connected component of candidates is then searched for its true links: small
ones inside one task, larger ones as a distributed join of rare shingles.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm import simhash
from casewright.llm.common import BROADCAST_ROWS, checkpointed, join_unique, remove_folder, written
from casewright.llm.components import connected_components

#: Bands and their MinHash values: a pair of similarity s shares a band with chance 1 - (1 - s**5)**20, 0.9996 at 0.8.
BANDS, BAND_ROWS = 20, 5
#: A component of candidates goes to one task first if it holds at most so many sets and shingles. The task gives up after
#: it has looked at so many shingles (some ten seconds' work), and the component is verified by joins like a larger one.
TASK_SETS, TASK_SHINGLES, TASK_WORK = 1 << 14, 1 << 21, 1 << 30
#: Most sets of a group that all others are compared with in one round; it starts with one and has sixteen times as many in each further round.
LEADERS = 1024
#: Sets of a group that is large, and shingles of a cell: of its leaders, and of the sets that meet them.
LARGE_GROUP, LEADER_SHINGLES, CELL_SHINGLES = 1024, 1 << 21, 1 << 19
#: Partitions that cells are dealt to at most.
MOST_TASKS = 4096
_MIX = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64) | np.uint64(1)
_CHUNK = 512


def shingle_set(text: bytes | None, words_per_shingle: int) -> np.ndarray:
    """The distinct shingle hashes of one text in order; empty for null or no words."""
    return distinct_hashes(simhash.shingle_hashes(text, words_per_shingle))


def distinct_hashes(chunks: Iterable[np.ndarray]) -> np.ndarray:
    """The distinct ones of the shingle hashes of one text, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *chunks]))


def band_keys(shingles: np.ndarray) -> list[int]:
    """One key (a signed long) for each band; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), _CHUNK):
        least = np.minimum(least, (shingles[None, i : i + _CHUNK] * _MIX[0] + _MIX[1]).min(axis=1))
    keys = [xxhash.xxh64_intdigest(rows.tobytes(), band) for band, rows in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similar_groups(sets: list[np.ndarray], least: float, most_work: int = 1 << 62) -> np.ndarray | None:
    """For each set the first one that it reaches over pairs of Jaccard similarity `least` and more.

    Breadth first: a set is compared only with those that no group has yet, so
    a group of mutual copies takes one pass. None if that means to look at more
    than most_work shingles.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    group, mark = np.full(n, -1), np.zeros(len(values), bool)
    open_values, owner = number, np.repeat(np.arange(n), sizes)
    for first in range(n):
        if group[first] >= 0:
            continue
        group[first], queue = first, [first]
        while queue and (group < 0).any():
            at = queue.pop()
            most_work -= len(open_values) + n
            if most_work < 0:
                return None
            own = number[ends[at] - sizes[at] : ends[at]]
            mark[own] = True
            shared = np.bincount(owner[mark[open_values]], minlength=n)
            mark[own] = False
            near = np.flatnonzero((group < 0) & (shared > 0) & (shared >= least * (sizes + sizes[at] - shared) - 1e-9))
            if len(near):
                group[near] = first
                queue += near.tolist()
                left = group[owner] < 0
                open_values, owner = open_values[left], owner[left]
    return group


def _described(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """id, text, fp, node (a hash of the shingle set), size (of the set) and bands for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, nodes, sizes, bands = [], [], [], []
            for cell in batch.column(1).cast(pa.binary()):
                hashes = list(simhash.shingle_hashes(cell.as_py(), words_per_shingle))  # once for the fingerprint and the set
                shingles = distinct_hashes(hashes)
                prints.append(simhash.fingerprint_of(hashes))
                nodes.append(xxhash.xxh64_intdigest(shingles.tobytes()))
                sizes.append(len(shingles))
                bands.append(band_keys(shingles))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, nodes, sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *longs, pa.array(bands, pa.list_(pa.int64()))], names=["id", "text", "fp", "node", "size", "bands"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, text string, fp long, node long, size long, bands array<long>")


def _candidates(nodes: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """Stars (a, b) of nodes (one row for each: node, fp, bands) that share a band or whose fingerprints link."""
    prints = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("lead"), F.count("*").alias("n")))
    links = simhash.link_by_blocks(prints.select("fp"), radius, shard_rows)
    heads = prints.select(F.col("fp").alias("root"), F.col("lead").alias("b"))
    near = links.join(prints, "fp").join(heads, "root").select(F.col("lead").alias("a"), "b")
    same = join_unique(nodes.select("fp", "node"), prints, "fp", "n").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    keyed = checkpointed(nodes.select(F.explode("bands").alias("key"), "node"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    banded = join_unique(keyed, shared, "key", "n").where("node <> b").select(F.col("node").alias("a"), "b")
    return near.union(same).union(banded)


def _rare_groups(sets: DataFrame, least: float) -> DataFrame:
    """candidate, token, node, size, held: the shingles of which two sets share one if their similarity is `least` or more.

    In one order of all shingles of a component, here by rarity, such sets share
    one of their first n - ceil(least * n) + 1. Shingles that only one set holds
    come first and meet nobody, so sets of one template with parts of their own meet nobody either.
    held is the number of a set's shingles that others of its component hold too.
    Large groups of one component hold mostly the same sets; they become one
    group, so that near copies do not meet once for each of their shingles.
    """
    tokens = sets.select("candidate", "node", "size", F.explode("shingles").alias("shingle"))
    token = F.xxhash64("candidate", "shingle").alias("token")  # the same shingle in two components makes two groups
    tokens = checkpointed(tokens.select("candidate", "node", "size", token))
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    held = join_unique(tokens, checkpointed(often.withColumn("often", F.col("n"))), "token", "n")
    first = F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9) + 1
    per = held.groupBy("candidate", "node", "size").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("t"))  # of one text
    alone = F.col("size") - F.size("t")
    shared = F.size("t").cast("long").alias("held")
    cut = F.slice("t", F.lit(1), (first - alone).cast("int"))
    kept = checkpointed(per.where(first > alone).select("candidate", "node", "size", shared, F.explode(cut).alias("s")).select("candidate", "s.token", "node", "size", "held"))
    all_sets = kept.groupBy("candidate").agg(F.countDistinct("node").alias("sets"))
    groups = kept.groupBy("candidate", "token").agg(F.count("*").alias("n")).where(F.col("n") >= LARGE_GROUP)
    large = checkpointed(groups.join(all_sets, "candidate").where(F.col("n") * 16 >= F.col("sets")).select("token", F.xxhash64("candidate").alias("one")))  # one for LARGE_GROUP rows at most
    return checkpointed(kept.join(F.broadcast(large), "token", "left").withColumn("token", F.coalesce("one", "token")).drop("one").distinct())


def _close(both: Column, a_size: Column, b_size: Column, least: float) -> Column:
    """Whether sets of these sizes are similar if they share `both`."""
    return both >= least * (a_size + b_size - both) - 1e-9


def _met(members: DataFrame, most: int, turn: int) -> DataFrame:
    """members (token, node, comp) of groups that hold sets of several components, with n (of the group) and leads.

    The sets beside the group's largest component lead, or about `most` of them
    by a hash, so that groups with the same sets name the same leaders; the first set leads always.
    """
    parts = members.groupBy("token", "comp").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    main = F.max(F.struct("n", "comp"))
    groups = parts.groupBy("token").agg(F.sum("n").alias("n"), F.min("first").alias("first"), main.alias("main"), F.count("*").alias("comps")).where("comps > 1")
    groups = checkpointed(groups.select("token", "n", "first", F.col("main.comp").alias("main"), (F.col("n") - F.col("main.n")).alias("beside"), F.col("n").alias("rows")))
    drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 40)) / float(1 << 40) * F.col("beside") < most
    leads = (F.col("node") == F.col("first")) | (F.col("comp") != F.col("main")) & drawn
    return join_unique(members, groups, "token", "rows").withColumn("leads", leads).drop("first", "main", "beside")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs a, b (of pairs candidate, a, b; b: leaders) whose sets are similar.

    The leaders of a component and the sets that meet them are dealt into cells
    of bounded size; a task counts what a set shares with the leaders of its cell in one pass.
    """
    nodes = sets.select("candidate", "node", "size")
    sums = [nodes.join(pairs.select(F.col(x).alias("node")).distinct(), "node").groupBy("candidate").agg(F.ceil(F.sum("size") / most).alias(y)) for x, y, most in (("b", "l_cells", LEADER_SHINGLES), ("a", "o_cells", CELL_SHINGLES))]
    cells = checkpointed(sums[0].join(sums[1], "candidate"))  # one row for each large component
    tasks = 2 * int(cells.agg(F.sum(F.col("l_cells") * F.col("o_cells"))).first()[0] or 0)
    cells = F.broadcast(cells)
    of_leader, of_other = (F.pmod(F.xxhash64(F.col(x)), F.col(y)) for x, y in (("b", "l_cells"), ("a", "o_cells")))
    dealt = pairs.join(cells, "candidate").select("candidate", of_leader.alias("l"), of_other.alias("o"), "a", "b")
    asks = dealt.groupBy("candidate", "l", "o", F.col("a").alias("node")).agg(F.collect_list("b").alias("bs")).join(sets.drop("candidate"), "node")
    heads = pairs.select("candidate", "b").distinct().join(cells, "candidate").select("candidate", of_leader.alias("l"), F.explode(F.sequence(F.lit(0), F.col("o_cells") - 1)).alias("o"), F.col("b").alias("node")).join(sets.drop("candidate"), "node")

    def meet(heads: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        heads, found = heads.sort_values("node"), []
        names, sizes = heads["node"].to_numpy(np.int64), heads["size"].to_numpy(np.int64)
        of_head = list(heads["shingles"])
        values = np.concatenate([np.zeros(0, np.int64), *of_head])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(heads)), sizes)[order]
        for a, size, shingles, bs in zip(asks["node"], asks["size"], asks["shingles"], asks["bs"], strict=True):
            asked = np.searchsorted(names, bs)
            if 16 * len(asked) < len(heads):  # few of the cell's leaders: each is looked up in the set
                own, theirs = np.sort(shingles), np.concatenate([of_head[i] for i in asked])
                shared = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                both = np.add.reduceat(shared, np.cumsum(sizes[asked]) - sizes[asked], dtype=np.int64)
            else:  # many: the set's shingles are looked up among those of all
                low, high = np.searchsorted(values, shingles), np.searchsorted(values, shingles, "right")
                many = high - low
                at = np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
                both = np.bincount(owner[at], minlength=len(heads))[asked]
            near = names[asked[both >= least * (size + sizes[asked] - both) - 1e-9]]
            found.append((np.full(len(near), a), near))
        none = np.zeros(0, np.int64)
        return pd.DataFrame({x: np.concatenate([none, *(f[i] for f in found)]) for i, x in enumerate("ab")})

    key = ["candidate", "l", "o"]
    # Columns of their own, as both come from sets, and a number of partitions, as near copies are few bytes for their work.
    heads, asks = (t.toDF(*t.columns).repartition(min(max(1, tasks), MOST_TASKS), *key) for t in (heads, asks))
    return heads.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(meet, "a long, b long")


def _linked_sets(sets: DataFrame, least: float) -> tuple[DataFrame, str]:
    """a, b (and the folder of that table): stars that join the sets (candidate, node, size, shingles) as all links of similarity `least` and more would.

    In each round every group of sets that share a rare shingle names some
    leaders; all others that are not known to belong with a leader are compared
    with it, unless the shingles that each shares with anyone are too few. Leaders have then met the whole group and
    leave it. Groups whose sets all belong together are done. Once a group's largest
    component is found, the sets beside it are its leaders: near copies take a few
    rounds however many they are, and a group of g sets that all differ some
    g / LEADERS. Pairs are ids; sets are joined to them afterwards.
    """
    spark = sets.sparkSession
    # Tables are written each round, as sizes that are carried through so many joins would outgrow any number.
    members, path = written(_rare_groups(sets, least).withColumn("comp", F.col("node")), "copies-members")
    links, links_path = written(sets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), "copies-links")
    for turn in itertools.count():
        met, met_path = written(_met(members, min(LEADERS, 16**turn) if turn else 0, turn), "copies-members")
        remove_folder(spark, path)
        if met.isEmpty():
            remove_folder(spark, met_path)
            return links, links_path
        head = F.struct(F.col("node").alias("b"), F.col("comp").alias("c"), F.col("size").alias("s"), F.col("held").alias("h"))
        leaders = checkpointed(met.where("leads").groupBy("token").agg(F.collect_list(head).alias("to"), F.first("n").alias("n")))
        meetings = join_unique(met.drop("n"), leaders, "token", "n").select(F.col("node").alias("a"), "candidate", "comp", "size", "held", "leads", F.explode("to").alias("to"))
        apart = F.expr("to.b <> a AND to.c <> comp AND NOT (leads AND to.b > a)")  # of two leaders one meets the other
        likely = _close(F.least("held", "to.h"), F.col("size"), F.col("to.s"), least)
        pairs, pairs_path = written(meetings.where(apart & likely).select("candidate", "a", "to.b").distinct(), "copies-pairs")
        more, more_path = written(links.union(_verified(pairs, sets, least)), "copies-links")
        stars, stars_path = written(connected_components(more, "a", "b").select(F.col("node").alias("a"), F.col("root").alias("b")), "copies-links")
        rest = met.where("NOT leads").drop("n", "leads", "comp").join(stars.withColumnRenamed("a", "node"), "node", "left")
        members, path = written(rest.withColumn("comp", F.coalesce("b", "node")).drop("b"), "copies-members")
        for done in (met_path, pairs_path, links_path, more_path):
            remove_folder(spark, done)
        links, links_path = stars, stars_path


def near_duplicates(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, radius: int = 6, shard_rows: int = 1024) -> DataFrame:
    """One row per input row: id, component (the smallest id of its group).

    Rows link if the Jaccard similarity of their sets of shingles is `least` or
    more; rows without words link to each other. Equal sets are one node, so
    copies never become pairs. Null and repeated ids are as in simhash. A
    component of candidates with few sets is verified by one task, any other by
    joins; both are exact.
    """
    spark = docs.sparkSession
    made = checkpointed(_described(docs, id_col, text_col, words_per_shingle))
    nodes = checkpointed(made.groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("rows"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    candidates = checkpointed(connected_components(_candidates(nodes, radius, shard_rows), "a", "b").withColumnRenamed("root", "candidate"))
    few = candidates.count() <= BROADCAST_ROWS  # then only texts of candidates move
    large = checkpointed(candidates.join(nodes.select("node", "size"), "node").groupBy("candidate").agg(F.count("*").alias("sets"), F.sum("size").alias("size")).where((F.col("sets") > TASK_SETS) | (F.col("size") > TASK_SHINGLES)).select("candidate"))
    texts = made.select("node", "text", "size").join(F.broadcast(candidates) if few else candidates, "node").dropDuplicates(["node"])
    if not large.isEmpty():
        texts = checkpointed(texts)

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        names = rows["node"].to_numpy()
        groups = similar_groups([shingle_set(None if t is None else t.encode(), words_per_shingle) for t in rows["text"]], least, TASK_WORK)
        roots = pd.Series(names[groups], dtype="Int64") if groups is not None else pd.Series([pd.NA] * len(rows), dtype="Int64")
        return pd.DataFrame({"candidate": rows["candidate"].to_numpy(), "node": names, "root": roots})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), words_per_shingle).view(np.int64) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("candidate"), batch.column("node"), batch.column("size"), pa.array(found, pa.list_(pa.int64()))], names=["candidate", "node", "size", "shingles"])

    small = texts.join(large, "candidate", "left_anti").select("candidate", "node", "text")  # each component's texts, or a part of them, lie in one task here
    tried = checkpointed(small.groupBy("candidate").applyInPandas(verify, "candidate long, node long, root long"))
    roots = tried.where("root is not null").select("node", "root")
    open_ones = checkpointed(large.union(tried.where("root is null").select("candidate").distinct()))
    if not open_ones.isEmpty():
        sets, sets_path = written(texts.join(open_ones, "candidate", "left_semi").mapInArrow(cut, "candidate long, node long, size long, shingles array<long>"), "copies-sets")
        links, links_path = _linked_sets(sets, least)
        roots = roots.union(connected_components(links, "a", "b"))
        remove_folder(spark, sets_path)
        remove_folder(spark, links_path)
    labels = simhash.group_labels(nodes.select("node", "first_id", "rows"), roots, "node")
    return join_unique(made.select("id", "node"), labels, "node", "rows").select("id", "component")


def keep_one_per_group(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, radius: int = 6, shard_rows: int = 1024) -> DataFrame:
    """Keeps one row of each group, the first of those with its smallest id; all columns are kept.

    Rows are told apart by themselves, not by their ids: of rows that share an
    id each belongs to the group of its own text. Rows without an id stay.
    """
    return simhash.first_rows(docs, id_col, text_col, lambda d: near_duplicates(d, least, "key", "text", words_per_shingle, radius, shard_rows))
