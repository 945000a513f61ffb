"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Each text's shingle set has a row of DEPTH hashes for each tree; a tree is the trie of these rows, and a node of it the
texts that share a prefix. Prefixes are as long as they are while their nodes are crowded: a node of CROWD texts or fewer
is looked at with the shortest prefix at once, and a text asks for its other prefixes to be shortened hash by hash, those of
the least crowded nodes first, until pairs of the threshold's similarity meet in one of its nodes with the target recall.
What it asks for depends on how crowded its nodes are and hardly on any one partner, so the recall holds for each pair.

Nodes give star edges only, never pairs; texts that stars connect are dealt to the same groups, and there every pair that
shares a node is verified exactly by counting common shingles, and leaves as counts of links and a local root.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import arrow_map, broadcast_if_small, forget, lookup, saved

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Trees; hashes of a row, and those of the shortest prefix; texts of a node that is looked at with its shortest prefix.
TREES, DEPTH, SHORTEST, CROWD = 32, 8, 5, 64
#: Texts and shingles of a block; a larger group of connected texts is compared block by block.
BLOCK, BLOCK_SHINGLES = 1000, 1_000_000
_RNG = np.random.Generator(np.random.PCG64(11))
_MUL = _RNG.integers(1 << 20, 1 << 31, (TREES * DEPTH, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, (TREES * DEPTH, 1), np.uint32)
_STEP = _RNG.integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def log_miss(depth: int, threshold: float = THRESHOLD) -> float:
    """ln of the probability that a pair of similarity `threshold` does not share a tree's prefix of `depth` hashes."""
    return math.log1p(-(threshold**depth))


def check_recall(threshold: float, recall: float) -> None:
    """All trees at the shortest prefix must reach the recall; the forest has no shorter ones."""
    if TREES * log_miss(SHORTEST, threshold) > math.log1p(-recall):
        raise ValueError(f"{TREES} trees don't reach a recall of {recall} at similarity {threshold}")


def shortened(crowded: Column, rank: Column, threshold: float, recall: float) -> Column:
    """The prefix length of a text's crowded node: `rank` counts its `crowded` such nodes from the least crowded one, from 1.

    With all trees at length d the text misses a partner of similarity `threshold` with probability
    exp(sum of log_miss(d)). From DEPTH on, the nodes are taken in turn to one hash less until that is 1 - recall at most.
    """
    target = F.lit(math.log1p(-recall))
    free = (F.lit(TREES) - crowded) * log_miss(SHORTEST, threshold)
    length = F.lit(SHORTEST)
    for d in range(SHORTEST, DEPTH):  # the last case wins: the longest length that suffices
        long, short = log_miss(d + 1, threshold), log_miss(d, threshold)
        nodes = F.greatest(F.lit(0), F.ceil((free + crowded * long - target) / (long - short)))  # to be shortened from d + 1 to d
        length = F.when(nodes <= crowded, F.when(rank <= nodes, F.lit(d)).otherwise(F.lit(d + 1))).otherwise(length)
    return length


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x81DADEF4BC2DD44D) ^ (x >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of runs of WORDS words; a text of fewer words, but one at least, is one shingle."""
    words = text.encode().split()  # at spaces and U+0009 to U+000D
    h = _mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    n = max(1, len(h) - WORDS + 1) if len(h) else 0
    x = np.full(n, np.uint64(min(len(h), WORDS)))
    for k in range(min(WORDS, len(h))):
        x += h[k : k + n] * _STEP[k]
    x = np.sort(_mixed(x))
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def row_hashes(own: np.ndarray) -> np.ndarray:
    """The smallest hashes of a shingle set, TREES * DEPTH of them."""
    short, low = (own >> np.uint64(32)).astype(np.uint32), np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), 1024):
        hashed = short[at : at + 1024] * _MUL
        hashed += _ADD
        np.minimum(low, hashed.min(1), out=low)
    return low


def node_keys(low: np.ndarray) -> np.ndarray:
    """The nodes of rows of hashes, (texts, prefix lengths from SHORTEST to DEPTH, trees)."""
    rows = low.astype(np.uint64).reshape(len(low), TREES, DEPTH)
    key = np.tile(np.arange(TREES, dtype=np.uint64), (len(low), 1))
    out = []
    for level in range(DEPTH):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, level])
        out.append(key)
    return np.stack(out[SHORTEST - 1 :], 1).view(np.int64)


def _smallest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the edges (u, v) from both ends, saved (u, m, n): each node's smallest neighbour or itself, and its degree)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = saved(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "near-low")
    return both, low


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the edges (u, v): the smallest node that it is connected to.

    Alternating large and small stars: every step relates each node's neighbours to the smallest of them, and the number
    of steps grows with the logarithm of the number of nodes. Edges stay as many or get fewer. The centre of a star may
    have most of the edges, so joins on it are lookups.
    """
    ordered = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    count = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = saved(ordered(edges), "near-edges")
    state = count(edges)
    while True:
        both, low = _smallest(edges)
        large = saved(lookup(both, low, "u", "n", max(1, 2 * state[0])).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "near-large")
        # Every edge leads to a smaller node now, so a node's neighbours here are those below it: few, whatever the star.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = saved(ordered(small), "near-edges")
        forget(edges, low, large)
        edges = new
        now = count(edges)
        if now == state:
            roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        state = now


def _links(sets: list[np.ndarray], block: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set its later partners: all pairs of one block, or the pairs across if there are two blocks."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    run = np.diff(np.append(first, len(values)))
    shared = run > 1
    # Postings of the shingles that two sets or more have, and each set's list of those.
    starts, runs = first[shared], run[shared]
    number = np.repeat(np.arange(len(starts)), runs)
    at = np.repeat(starts - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
    holders = owner[at]
    by_set = np.argsort(holders, kind="stable")
    ends = np.searchsorted(holders[by_set], np.arange(len(sets) + 1))
    two = len(np.unique(block)) > 1
    for i in range(len(sets)):
        mine = number[by_set[ends[i] : ends[i + 1]]]
        if not len(mine):
            continue
        n = runs[mine]
        spots = np.repeat(starts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[spots], minlength=len(sets))
        common[: i + 1] = 0
        near = common >= threshold * (sizes[i] + sizes - common) - 1e-9
        near &= common > 0
        if two:
            near &= block != block[i]
        found = np.flatnonzero(near)
        if len(found):
            yield i, found


def _verified(threshold: float):
    """The group function: (cid, links, texts, root) of the sets of a pair of blocks, or of a pack of small groups.

    A pair counts if its texts share a node that is looked at; in a group made for one node, if that is their first one.
    """

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        ids = table.column("cid").to_numpy()
        table = table.filter(pa.array(np.append(True, ids[1:] != ids[:-1])))  # rows equal in id and text
        cid, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        nodes = [set(x) for x in table.column("nodes").to_pylist()]
        only = table.column("only").to_pylist()
        root = list(range(len(sets)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        def meet(i: int, j: int) -> bool:
            common = nodes[i] & nodes[j]
            return bool(common) and (only[i] is None or min(common) == only[i])

        links, texts = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        for i, near in _links(sets, table.column("block").to_numpy(), threshold):
            found = np.array([j for j in near.tolist() if meet(i, j)], np.int64)
            texts[i] += len(found)
            links[i] += copies[found].sum()
            texts[found] += 1
            links[found] += copies[i]
            for j in found.tolist():
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        own = np.flatnonzero(texts)
        return pa.table({"cid": cid[own], "links": links[own], "texts": texts[own], "root": cid[[top(i) for i in own.tolist()]] if len(own) else cid[own]})

    return verify


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of `docs` its near-duplicate class and its links.

    Returns id, digest (SHA-256 of the text), copy_id (smallest id of the equal texts), class_id (smallest id of all
    texts connected by links), n_text_links (other texts of similarity `threshold` or more) and n_links (other rows of
    such a text, or of this one). Similarity is the Jaccard index of the sets of WORDS-word shingles of the whole text;
    a text of fewer words is one shingle. Each linked pair is verified; a pair of exactly `threshold` is missed with
    probability 1 - `recall` at most, more similar ones less often. Texts without words have no links but their copies.
    Null texts count as empty, null ids give rows like any other and are no smallest id, repeated rows are copies, other
    columns are not read, and an empty table gives no rows.
    """
    check_recall(threshold, recall)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    kind = base.schema["id"].dataType.simpleString()

    def signatures():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            keys = node_keys(np.stack([row_hashes(own) for own in sets]))
            per = DEPTH - SHORTEST + 1
            lists = [keys[i].tolist() if len(own) else [[]] * per for i, own in enumerate(sets)]
            return {"row": batch.column(0), "id": batch.column(1), "digest": batch.column(3), "size": [len(own) for own in sets], "nodes": [x[0] for x in lists], "longer": [x[1:] for x in lists]}

        return step

    numbered = base.select(F.monotonically_increasing_id().alias("row"), "id", "text", "digest")
    rows = saved(arrow_map(numbered, signatures, f"row bigint, id {kind}, digest binary, size bigint, nodes array<bigint>, longer array<array<bigint>>"), "near-rows")
    texts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("copy_id"), F.min("row").alias("cid"), F.max_by("size", "row").alias("size"))
    texts = saved(texts, "near-texts")
    nodes = saved(looked_at(rows, texts, threshold, recall), "near-nodes")
    # A longer prefix may be one text's alone, so nodes are counted anew.
    stars = saved(nodes.groupBy("node").agg(F.min("cid").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-stars")
    edges = lookup(nodes, stars, "node", "n", max(1, nodes.count())).where("v IS NOT NULL").select(F.col("cid").alias("u"), "v")
    groups = saved(connected(edges), "near-groups")
    found = saved(_compared(base, texts, rows, nodes, groups, threshold), "near-links")
    roots = connected(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    classes = texts.select("digest", "copies", "copy_id", "cid").join(links, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    classes = saved(classes.select("digest", "copies", "copy_id", "root", "links", "texts"), "near-rooted")
    least = saved(classes.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "near-least")
    classes = lookup(classes, least, "root", "n", max(1, classes.count()))
    classes = saved(classes.select("digest", "copies", "copy_id", "class_id", F.coalesce("texts", F.lit(0)).alias("n_text_links"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-classes")
    out = lookup(rows.select("id", "digest"), classes, "digest", "copies", max(1, rows.count()))
    return out.select(F.col("id").alias(id_col), F.hex("digest").alias("digest"), "copy_id", "class_id", "n_text_links", "n_links")


def looked_at(rows: DataFrame, texts: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(cid, node) of the nodes of two texts or more that are looked at, each with all of its texts.

    One row of a text stands for its copies. A crowded node's prefix is shortened as far as any of its texts asks for, and
    for all of them: one row for each text and tree.
    """
    own = rows.join(broadcast_if_small(texts.select(F.col("cid").alias("row"))), "row", "left_semi").withColumnRenamed("row", "cid")
    short = own.select("cid", F.posexplode("nodes").alias("tree", "node"))
    shared = saved(short.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-shared")
    placed = saved(lookup(short, shared, "node", "n", max(1, short.count())).where("n IS NOT NULL"), "near-placed")
    crowded = placed.where(F.col("n") > CROWD)
    plain = placed.where(F.col("n") <= CROWD).select("cid", "node")
    # At most TREES trees a text: those of its crowded nodes in order. Few texts have any, so all texts' hashes stay where they are.
    turns = crowded.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "tree"))).alias("turns"))
    turns = broadcast_if_small(saved(turns.select("cid", F.col("turns.tree").alias("trees")), "near-turns"))
    lists = own.select("cid", "nodes", "longer").join(turns, "cid")
    lists = lists.select("cid", "nodes", "longer", F.size("trees").alias("crowded"), F.posexplode("trees").alias("at", "tree"))
    # The length that the text's prefix comes to in each.
    lists = lists.withColumn("length", shortened(F.col("crowded"), F.col("at") + 1, threshold, recall))
    prefixes = F.transform(F.concat(F.array("nodes"), F.col("longer")), lambda x: F.get(x, F.col("tree")))
    lists = saved(lists.select("cid", F.get("nodes", F.col("tree")).alias("node"), "length", prefixes.alias("prefixes")), "near-prefixes")
    lengths = saved(lists.groupBy("node").agg(F.min("length").alias("to"), F.count(F.lit(1)).alias("n")), "near-lengths")
    dense = lookup(lists, lengths, "node", "n", max(1, lists.count())).select("cid", F.get("prefixes", F.col("to") - SHORTEST).alias("node"))
    return plain.unionByName(dense)


def _compared(base: DataFrame, texts: DataFrame, rows: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(cid, links, texts, root) for each text with links, one row from each comparison that it took part in.

    Small groups of connected texts are packed. A group of more than a block is compared either block by block, where a
    text goes as often as the group has blocks, or node by node, and again in blocks within a node, whichever sends fewer
    texts: groups that chance has chained are taken apart, and real ones aren't sent for each tree. Both count the same
    pairs, those that share a node. Only texts with candidates are read again for their shingles.
    """
    lists = nodes.groupBy("cid").agg(F.collect_set("node").alias("nodes"))
    grouped = broadcast_if_small(groups.withColumnRenamed("node", "cid"))
    members = texts.select("cid", "digest", "copies", "size").join(grouped, "cid").join(lists, "cid")
    members = saved(members.select("cid", "digest", "copies", "size", "root", "nodes"), "near-members")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    whole = saved(members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), blocks.alias("blocks")), "near-whole")
    packs = max(1, -(-(whole.agg(F.sum("weight")).first()[0] or 0) // BLOCK_SHINGLES))
    # Larger groups: what their nodes would send.
    large = members.join(whole.where("blocks > 1").select("root", "n", F.col("blocks").alias("whole_blocks")), "root").select("root", "n", "whole_blocks", "size", F.explode("nodes").alias("node"))
    apart = large.groupBy("root", "n", "whole_blocks", "node").agg(F.count(F.lit(1)).alias("in_node"), blocks.alias("node_blocks"))
    apart = saved(apart, "near-apart")
    split = apart.groupBy("root", "n", "whole_blocks").agg(F.sum(F.col("in_node") * F.col("node_blocks")).alias("sent")).where("sent < n * whole_blocks").select("root")
    apart = apart.join(split, "root", "left_semi").groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("node", "node_blocks"))).alias("node_blocks"))
    members = lookup(members, whole.select("root", "n", "blocks"), "root", "n", max(1, members.count()))
    members = members.join(apart, "root", "left").select("cid", "digest", "copies", "root", "nodes", F.when(F.col("node_blocks").isNull(), F.col("blocks")).alias("blocks"), F.expr("transform(nodes, x -> struct(x AS node, node_blocks[x] AS blocks))").alias("by_node"))
    members = saved(members.select("cid", "digest", "copies", "root", "nodes", "blocks", F.when(F.col("blocks").isNull(), F.col("by_node")).alias("by_node")), "near-dealt")
    wanted = rows.select(F.col("row").alias("cid"), "id").join(broadcast_if_small(members.select("cid", "digest")), "cid").select(F.col("id").alias("want_id"), F.col("digest").alias("want_digest"), "cid")
    wanted = broadcast_if_small(saved(wanted, "near-wanted"))
    read = base.join(wanted, F.col("id").eqNullSafe(F.col("want_id")) & (F.col("digest") == F.col("want_digest"))).select("cid", "text")

    def sets():
        return lambda batch: {"cid": batch.column(0), "shingles": [shingles(t).tobytes() for t in batch.column(1).to_pylist()]}

    have = arrow_map(read, sets, "cid bigint, shingles binary")  # a row for each row that is equal in id and text
    units = F.when(F.col("blocks").isNotNull(), F.array(F.struct(F.lit(None).cast("bigint").alias("node"), F.col("blocks")))).otherwise(F.col("by_node"))
    dealt = have.join(broadcast_if_small(members.drop("digest")), "cid").select("cid", "copies", "root", "nodes", "shingles", F.explode(units).alias("unit"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("unit.blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("unit.blocks") - 1)))
    pair = F.xxhash64("root", "unit.node", F.least("block", "other"), F.greatest("block", "other"))
    packed = F.when(F.col("unit.node").isNull() & (F.col("unit.blocks") == 1), F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(pair)
    dealt = dealt.select("cid", "copies", "nodes", F.col("unit.node").alias("only"), "block", "shingles", packed.alias("pack"))
    return dealt.groupBy("pack").applyInArrow(_verified(threshold), "cid bigint, links bigint, texts bigint, root bigint")


def near_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs`, all columns kept, of which one of each class stays: that of the smallest id.

    Rows that share the smallest id and its text stay together. Of a class in which all ids are null all rows stay.
    """
    joined = jaccard_join(docs, id_col=id_col, text_col=text_col, **how)
    gone = joined.where(~F.coalesce(F.col(id_col) == F.col("class_id"), F.col("class_id").isNull())).select(F.col(id_col).alias("gone_id"), F.unhex("digest").alias("gone_digest")).distinct()
    gone = broadcast_if_small(saved(gone, "near-gone"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("gone_id")) & (digest == F.col("gone_digest")), "left_anti")
