"""N-gram Jaccard join over count vectors in R-trees.

A text's set is that of its distinct shingles. Each shingle falls into one of a number of groups, and a set's point is its number
of shingles in each group; two sets have at most the sum of the smaller coordinates in common. For that bound to tell unrelated
sets apart, a group must hold few shingles, so there are 64 groups for small sets and one for about GROUP_MEAN shingles in large
ones, by powers of two. Sets that can be linked are of one such level or of two in a row, where the finer is folded. A tree over points keeps, for each
node, the largest coordinates and the smallest size below it, so a node whose bound is under what the link needs is left out with
all its points; pairs that survive are verified on the sets themselves.

Points of unrelated texts lie close together when texts are long, so a single tree over everything would prune little. Therefore
trees are built over blocks: two linked sets must share k of their rarest shingles (as many as may differ, and k), so each set
goes into the blocks of those, and linked sets meet in k blocks. A set with fewer than k blocks that others are in too has no link
and leaves; k is 1 and a 16th of the set, which costs little and removes what shares but a phrase. Blocks with the same members are
one block. Survivors of the trees
are joined to groups, and each group is verified once, with sets that are already connected not being compared again; only
spanning links leave a task, never all pairs. Equal sets are one point from the start.

Blocks and groups over a limit are first held against PIVOTS of their own sets, drawn by hash: what links to pivots that are
connected with each other is connected, and needs no comparison among itself. Only what is left is compared with everything, in
tiles of bounded size. So a large family of near copies costs about its own size, and nothing is left out where it does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ohmtide.llm.common import NON_SPACE, drop_written, join_dealt, join_small, mix, most_frequent, pieces, quoted, sequence_hashes, shuffle_parts, utf8, word_hashes, word_spans, written
from ohmtide.llm.components import components

WORDS, PERCENT, GROUPS, GROUP_MEAN, SHARED = 5, 75, 64, 4, 16
#: Points in a leaf, and nodes below a node.
FAN = 16
#: Sets of a block, and shingles of a group, that one tile holds about half of.
BLOCK_SETS, GROUP_SHINGLES = 1024, 250_000
#: Shingles counted as frequent: those found in HEAVY_IN or more texts of a lot; of these the most frequent. This only orders them.
HEAVY, HEAVY_IN, LOT = 100_000, 8, 2_000_000
#: Sets that a large block or group is held against first.
PIVOTS = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending, one row after another; where each row's begin."""
    starts, ends, first = word_spans(data, offsets, NON_SPACE)
    w = word_hashes(data, starts, ends)
    whole = sequence_hashes(w, words)
    parts, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(sizes)):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            own = whole[a : b - words + 1]
            own.sort()
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif b > a:
            own = sequence_hashes(w[a:b], b - a)
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def level_of(n: np.ndarray) -> np.ndarray:
    """The binary logarithm of the number of groups for sets of n shingles."""
    return np.ceil(np.log2(np.maximum(n / GROUP_MEAN, GROUPS))).astype(np.int32)


def profile(shingles: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Two 64-bit signatures of each set, and its count vector (16 bits are enough: shingles are spread by hash, a few to a group)."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles + np.uint64(salt)), dtype=np.uint64)]) for salt in (0x1234567, 0x89ABCDE)]
        signatures = [(s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums]
    levels = level_of(np.diff(begin))
    vectors = [np.bincount((shingles[a:b] >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k).astype("<u2").tobytes() for a, b, k in zip(begin, begin[1:], levels)]
    return signatures[0], signatures[1], vectors


def folded(vector: bytes, level: int) -> np.ndarray:
    """A count vector at a coarser level."""
    v = np.frombuffer(vector, "<u2").astype(np.int32)
    return v.reshape(1 << level, -1).sum(axis=1)


def prefix_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of its rarest shingles hold 1 + n // SHARED that a linked set has too, among as many of its own."""
    return n - (percent * n + 99) // 100 + 1 + n // SHARED


def needed(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap of linked sets of sizes a and b: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """An R-tree over count vectors, packed by halving at the coordinate that spreads most."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        order: list[int] = []

        def deal(rows: np.ndarray) -> None:
            if len(rows) <= FAN:
                order.extend(rows)
                return
            axis = int(np.argmax(vectors[rows].var(axis=0)))
            half = FAN * max(1, round(len(rows) / 2 / FAN))
            rows = rows[np.argsort(vectors[rows, axis], kind="stable")]
            deal(rows[:half])
            deal(rows[half:])

        deal(np.arange(len(vectors)))
        self.order = np.array(order, np.int64)
        self.levels = [(vectors[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > FAN:
            points, least = self.levels[-1]
            at = np.arange(0, len(least), FAN)
            self.levels.append((np.maximum.reduceat(points, at), np.minimum.reduceat(least, at)))

    def search(self, vector: np.ndarray, size: int) -> np.ndarray:
        """The points whose overlap with a set can be enough for a link."""
        nodes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            points, least = self.levels[depth]
            bound = np.minimum(points[nodes], vector).sum(axis=1)
            nodes = nodes[bound >= needed(least[nodes], size)]
            if depth:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][1])]
        return self.order[nodes]


def spread(n: int, near) -> Iterator[np.ndarray]:
    """The connected groups of two or more among n things; near(i, rest) gives those of `rest` that i is linked with."""
    rest = np.arange(n)
    while len(rest):
        group, queue = [rest[0]], [rest[0]]
        rest = rest[1:]
        while queue and len(rest):
            found = near(queue.pop(), rest)
            if len(found):
                rest = np.setdiff1d(rest, found, assume_unique=True)
                group.extend(found)
                queue.extend(found)
        if len(group) > 1:
            yield np.array(group)


def tree_groups(vectors: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of points that pairs which survive the bound connect."""
    trees: list = [None, 0]

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        # A tree over what is left, built anew when half of it has gone.
        if trees[0] is None or 2 * len(rest) < trees[1]:
            trees[:] = [CountTree(vectors[rest], sizes[rest]), len(rest), rest]
        found = trees[2][trees[0].search(vectors[i], sizes[i])]
        return found[np.isin(found, rest, assume_unique=True)]

    return spread(len(sizes), near)


def set_groups(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Groups of sets that links connect, by exact overlaps."""
    sizes = np.array([len(s) for s in sets])
    index: list = [None, 0]

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        # An inverted index over what is left, built anew when half of it has gone.
        if index[0] is None or 2 * len(rest) < index[1]:
            values = np.concatenate([sets[j] for j in rest])
            owners = np.repeat(rest, sizes[rest])
            order = np.argsort(values, kind="stable")
            index[:] = [values[order], len(rest), owners[order]]
        low, high = np.searchsorted(index[0], sets[i], "left"), np.searchsorted(index[0], sets[i], "right")
        n = high - low
        at = np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())
        common = np.bincount(index[2][at], minlength=len(sizes))[rest]
        return rest[common >= needed(sizes[rest], sizes[i])]

    return spread(len(sets), near)


def by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first `keys` columns of sorted batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield pa.concat_tables(held)


def star_links(groups: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(ids, members) of connected groups as links from the smallest id."""
    a, b = [], []
    for ids, members in groups:
        own = np.sort(ids[members])
        a.append(np.full(len(own) - 1, own[0]))
        b.append(own[1:])
        if sum(map(len, a)) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def largest_group(masks: list[int], counts: list[int]) -> int:
    """Of pivots (bits) that sets with several bits connect, those of the group that most sets link to."""
    parent = list(range(PIVOTS))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    bits = [[i for i in range(PIVOTS) if m >> i & 1] for m in masks]
    for own in bits:
        for i in own[1:]:
            parent[root(i)] = root(own[0])
    size = [0] * PIVOTS
    for own, n in zip(bits, counts):
        if own:
            size[root(own[0])] += n
    best = max(range(PIVOTS), key=lambda i: (size[i], -i))
    return sum(1 << i for i in range(PIVOTS) if root(i) == best) if size[best] else 0


def tiles(rows: DataFrame, keys: list[str], linked, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a column `tile` for each tile that they go to, links a, b found on the way) for rows of keys, parts (in how many
    parts their key's rows are cut, two or more), rid and what linked() looks at.

    linked(sets, pivot) tells which of a table's sets link to one pivot (a row of the same columns). Rows that link to the largest
    connected group of pivots are settled; the others meet each other, and all settled ones, in tiles of two parts.
    """
    spark, types = rows.sparkSession, dict(rows.dtypes)
    part = F.pmod(F.xxhash64("rid"), F.col("parts"))
    rows = written(rows.withColumn("part", part), f"{name}-rows")
    # One pivot for each of PIVOTS residues of a hash: found by partial minima.
    lot = F.pmod(F.xxhash64("rid", F.lit("pivot")), F.lit(PIVOTS))
    chosen = rows.groupBy(*keys, lot.alias("bit")).agg(F.min_by("rid", F.xxhash64("rid", F.lit("draw"))).alias("rid"))
    chosen = written(chosen, f"{name}-chosen")
    pivots = rows.drop("part").dropDuplicates([*keys, "rid"]).join(chosen, [*keys, "rid"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    pivots = written(pivots, f"{name}-pivots")

    def hold(sets: pa.Table, pivots: pa.Table) -> pa.Table:
        mask = np.zeros(sets.num_rows, np.int64)
        for k in range(pivots.num_rows):
            pivot = pivots.slice(k, 1).to_pylist()[0]
            mask |= linked(sets, pivot).astype(np.int64) << int(pivot["bit"])
        return sets.select([*keys, "rid"]).append_column("mask", pa.array(mask))

    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "rid"]) + ", mask bigint"
    masks = written(rows.groupBy(*keys, "part").cogroup(pivots.groupBy(*keys, "part")).applyInArrow(hold, schema).groupBy(*keys, "rid").agg(F.bit_or("mask").alias("mask")), f"{name}-masks")
    patterns = masks.groupBy(*keys, "mask").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.collect_list("mask").alias("masks"), F.collect_list("n").alias("ns"))
    group = F.udf(largest_group, "bigint")  # a call for each large key, over at most as many patterns as pivots have subsets
    giant = written(patterns.select(*keys, group("masks", "ns").alias("giant")), f"{name}-giant")
    settled = masks.join(giant, keys).select(*keys, "rid", F.col("mask").bitwiseAND(F.col("giant")).alias("own"), "mask")
    settled = written(settled, f"{name}-settled")
    # A set's links to pivots: each is one that linked() has found.
    named = chosen.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bit", "rid"))).alias("of_bit"))
    hits = F.filter(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda i: F.getbit(F.col("mask"), i) == 1)
    links = settled.where("mask <> 0").join(named, keys).select("rid", F.explode(F.transform(hits, lambda i: F.element_at("of_bit", i.cast("bigint")))).alias("b")).select(F.least("rid", "b").alias("a"), F.greatest("rid", "b").alias("b")).where("a <> b").distinct()
    # What is left is cut in parts as large as all others, too.
    total = settled.groupBy(*keys).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("own") == 0).alias("open")).where("open > 0")
    per = rows.select(*keys, "parts").distinct().join(total, keys).withColumns({"size": F.greatest(F.ceil(F.col("all") / F.col("parts")), F.lit(1))})
    per = per.select(*keys, F.ceil((F.col("all") - F.col("open")) / F.col("size")).cast("bigint").alias("s_parts"), F.ceil(F.col("open") / F.col("size")).cast("bigint").alias("r_parts"))
    each = rows.drop("part", "parts").join(settled.select(*keys, "rid", (F.col("own") == 0).alias("is_open")), [*keys, "rid"]).join(per, keys)
    s, r = F.pmod(F.xxhash64("rid"), F.greatest("s_parts", F.lit(1))), F.pmod(F.xxhash64("rid"), "r_parts")
    up_to = lambda n: F.filter(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    cross = lambda p, q: -(p * F.col("r_parts") + q) - 1
    among = F.transform(up_to(F.col("r_parts")), lambda i: F.least(r, i) * F.col("r_parts") + F.greatest(r, i))
    with_settled = F.transform(up_to(F.col("s_parts")), lambda p: cross(p, r))
    tile = F.when(F.col("is_open"), F.concat(among, with_settled)).otherwise(F.transform(up_to(F.col("r_parts")), lambda q: cross(s, q)))
    return each.withColumn("tile", F.explode(tile)).drop("s_parts", "r_parts", "is_open"), links


def bound_linked(sets: pa.Table, pivot: dict) -> np.ndarray:
    """Which points can be linked with a pivot, by the bound of their count vectors."""
    own, n = int(pivot["high"]), sets.column("n").to_numpy()
    out = np.zeros(sets.num_rows, bool)
    for i, (vector, high) in enumerate(zip(sets.column("vector").to_pylist(), sets.column("high").to_numpy())):
        level = min(own, int(high))
        out[i] = np.minimum(folded(vector, level), folded(pivot["vector"], level)).sum() >= needed(n[i], pivot["n"])
    return out


def exactly_linked(sets: pa.Table, pivot: dict) -> np.ndarray:
    """Which sets are linked with a pivot."""
    own = np.frombuffer(pivot["shingles"], np.uint64)
    out = np.zeros(sets.num_rows, bool)
    for i, shingles in enumerate(sets.column("shingles").to_pylist()):
        v = np.frombuffer(shingles, np.uint64)
        at = np.minimum(np.searchsorted(own, v), len(own) - 1)
        out[i] = (own[at] == v).sum() >= needed(len(v), len(own))
    return out


def similar(documents: DataFrame, block_sets: int = BLOCK_SETS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for each row of `documents`.

    class_id is the smallest doc_id with an equal set, component_id the smallest that links reach: sets with 100 |a and b| >= 75
    |a or b|. Texts with no words (or null) have an empty set and are linked with nothing: both ids are their own. Rows that share
    a doc_id are one node with the links of all; a null doc_id gets null ids and gives no links. Repeated rows each come out, an
    empty table gives none, and other columns are not read. Shingles are compared by 64-bit hashes, within a text and between two.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint"), "text")

    # What is frequent goes last in the order of rarity. The order is free to be any, if it is the same everywhere.
    def heavy_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def lot() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= HEAVY_IN
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], ["h", "n"])

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in pieces(offsets):
                held.append(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0])
                size += len(held[-1])
                if size >= LOT:
                    yield lot()
                    held, size = [], 0
        if held:
            yield lot()

    counted = written(docs.select("text").mapInArrow(heavy_of, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "shingle-counts")
    top = most_frequent(counted, "n", HEAVY).toPandas()
    order = np.argsort(top["h"].to_numpy(np.int64).view(np.uint64))
    frequent = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64).view(np.uint64)[order], top["n"].to_numpy(np.int64)[order]))

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets):
                shingles, begin = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                s1, s2, vectors = profile(shingles, begin)
                n = np.diff(begin)
                # The smallest set that can be linked with one of n shingles may be of the level below.
                levels = [pa.array(level_of(k)) for k in (-(-PERCENT * n // 100), n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(s1), pa.array(s2), *levels, pa.array(vectors, pa.binary())], ["doc_id", "n", "s1", "s2", "low", "high", "vector"])

    every = written(docs.mapInArrow(profiles, "doc_id bigint, n bigint, s1 bigint, s2 bigint, low int, high int, vector binary"), "profiles")
    same_set = ["s1", "s2", "n"]
    classes = written(every.where("n > 0").groupBy(*same_set).agg(F.min("doc_id").alias("rid"), F.count(F.lit(1)).alias("ohmtide_n")), "classes")
    of_class = join_dealt(every.where("n > 0").select("doc_id", *same_set), classes.select(*same_set, "rid"), classes.select(*same_set, "ohmtide_n"), same_set)
    members = written(of_class.select("doc_id", "n", "rid").unionByName(every.where("n = 0").select("doc_id", "n", F.lit(None).cast("bigint").alias("rid"))), "members")
    copies = members.where("n > 0 AND doc_id <> rid").select("doc_id").distinct()
    single = members.where("doc_id = rid").select("doc_id").distinct()
    # Rows of texts that stand for themselves; a doc_id with several texts may do both.
    aside = copies.join(single, "doc_id", "left_anti")
    kept = join_small(docs.where("doc_id IS NOT NULL"), aside, aside.count(), ["doc_id"], "left_anti")

    # Shingles that more sets have than a quarter of a task's fair share are few; their rows are spread over all tasks.
    known, count = frequent.value
    n_posted = every.agg(F.sum(F.expr(f"n - (({PERCENT} * n + 99) DIV 100) + 1 + n DIV {SHARED}"))).first()[0] or 0
    hot = spark.sparkContext.broadcast(known[count * 4 * shuffle_parts(spark) > n_posted])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = frequent.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets):
                shingles, begin = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(begin)
                take = np.where(n > 0, prefix_size(n), 0)
                common = np.zeros(len(shingles), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
                    common = np.where(known[at] == shingles, count[at], 0)
                    for d in np.unique(np.searchsorted(begin, np.flatnonzero(common), "right") - 1):
                        a, b = begin[d], begin[d + 1]
                        shingles[a:b] = shingles[a:b][np.argsort(common[a:b], kind="stable")]
                first = np.arange(len(shingles)) - np.repeat(begin[:-1], n) < np.repeat(take, n)
                yield pa.RecordBatch.from_arrays([pa.array(shingles[first].view(np.int64)), pa.array(np.repeat(ids[i:j], n)[first]), pa.array(np.isin(shingles[first], hot.value))], ["h", "rid", "hot"])

    # A shingle that one set alone has is dropped; a hot one is no such, or does no harm.
    spread_out = F.when(F.col("hot"), F.xxhash64("rid")).otherwise(F.lit(0).cast("bigint"))
    posted = kept.mapInArrow(postings, "h bigint, rid bigint, hot boolean").withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("h", spread_out)))
    posted = written(posted.where("hot OR members > 1").select("h", "rid", "hot"), "postings")
    sizes = every.where("n > 0").groupBy(F.col("doc_id").alias("rid")).agg(F.min("n").alias("n"))
    several = posted.groupBy("rid").agg(F.count(F.lit(1)).alias("blocks")).join(sizes, "rid").where(f"blocks >= 1 + n DIV {SHARED}").select("rid")
    several = written(several, "several-blocks")
    posted = join_small(posted, several, several.count(), ["rid"], "left_semi")
    same, cold, whole = Window.partitionBy("h"), posted.where("NOT hot"), [F.count(F.lit(1)), F.bit_xor(F.xxhash64("rid"))]
    posted_all = cold.select("rid", whole[0].over(same).alias("members"), whole[1].over(same).alias("block"))
    if len(hot.value):
        of_hot = posted.where("hot").groupBy("h").agg(whole[0].alias("members"), whole[1].alias("block"))
        posted_all = posted_all.unionByName(posted.where("hot").join(F.broadcast(of_hot), "h").select("rid", "members", "block"))
    blocks = posted_all.where("members > 1").groupBy("block", "members", "rid").agg(F.lit(1).alias("one")).drop("one")
    points = every.where("n > 0").join(single, "doc_id").dropDuplicates(["doc_id", "s1"]).select(F.col("doc_id").alias("rid"), "n", "low", "high", "vector")
    keys = ["block", "members", "tile", "level"]
    blocks = written(blocks, "blocks")
    dealt = blocks.where(F.col("members") <= block_sets).withColumn("tile", F.lit(0).cast("bigint")).join(points, "rid")
    near_pivots = None
    large = blocks.where(F.col("members") > block_sets)
    if not large.isEmpty():
        large = large.withColumn("parts", F.ceil(F.col("members") / F.lit(block_sets)).cast("bigint")).join(points, "rid")
        in_tiles, near_pivots = tiles(large, ["block", "members"], bound_linked, "large-blocks")
        dealt = dealt.unionByName(in_tiles.select(*dealt.columns))
    dealt = dealt.withColumn("level", F.explode(F.sequence("low", "high")))
    dealt = dealt.repartition(shuffle_parts(spark), *keys).sortWithinPartitions(*keys).select(*keys, "rid", "n", "vector")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            for block in by_key(batches, 4):
                if block.num_rows > 1:
                    ids, n, level = block.column(4).to_numpy(), block.column(5).to_numpy(), block.column(3)[0].as_py()
                    for members in tree_groups(np.stack([folded(v, level) for v in block.column(6).to_pylist()]), n):
                        yield ids, members

        yield from star_links(groups())

    survivors = dealt.mapInArrow(prune, "a bigint, b bigint")
    survivors = written((survivors if near_pivots is None else survivors.unionByName(near_pivots)).distinct(), "survivors")
    grouped = written(components(survivors).select(F.col("node").alias("rid"), F.col("component").alias("family")), "families")
    weights = written(grouped.join(points.select("rid", "n"), "rid").groupBy("family").agg(F.ceil(F.sum("n") / F.lit(group_shingles)).cast("bigint").alias("parts")), "weights")
    to_verify = grouped.join(weights, "family").select(F.col("rid").alias("doc_id"), "family", "parts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            for i, j in pieces(offsets):
                shingles, begin = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = [shingles[a:b].tobytes() for a, b in zip(begin, begin[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), pa.array(own, pa.binary())], ["family", "parts", "rid", "shingles"])

    texts = join_small(kept, to_verify, grouped.count(), ["doc_id"], "inner").select("family", "parts", "doc_id", "text")
    # Sets of one rid (rows that share a doc_id) stay apart by their own bytes.
    all_sets = texts.mapInArrow(sets, "family bigint, parts bigint, rid bigint, shingles binary")
    own_sets = all_sets.where("parts <= 1").select("family", F.lit(0).cast("bigint").alias("tile"), "rid", "shingles")
    exact_pivots = None
    if not weights.where("parts > 1").isEmpty():
        in_tiles, exact_pivots = tiles(all_sets.where("parts > 1"), ["family"], exactly_linked, "large-families")
        own_sets = own_sets.unionByName(in_tiles.select(*own_sets.columns))
    own_sets = own_sets.repartition(shuffle_parts(spark), "family", "tile").sortWithinPartitions("family", "tile")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            for family in by_key(batches, 2):
                ids = family.column(2).to_numpy()
                for found in set_groups([np.frombuffer(s, np.uint64) for s in family.column(3).to_pylist()]):
                    yield ids, found

        yield from star_links(groups())

    links = own_sets.mapInArrow(verify, "a bigint, b bigint")
    links = written(links if exact_pivots is None else links.unionByName(exact_pivots), "links")
    # Rows of one doc_id that stand in several classes connect these.
    bridges = members.where("n > 0 AND doc_id <> rid").join(single, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rid").alias("b"))
    labels = components(links.unionByName(bridges)).withColumnRenamed("node", "rid")
    for old in (every, several, survivors, grouped, classes, blocks, counted):
        drop_written(spark, old)
    return members.join(labels, "rid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rid", "doc_id").alias("class_id"), F.coalesce("component", "rid", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The rows of `documents`, with all their columns, that stand for their component: those of its smallest doc_id.

    `texts` (doc_id, text), where given, are compared in place of the documents' own. Of several rows of one doc_id, the one of the
    smallest text stays (nulls last). Rows without a doc_id stay, as do null and empty texts; an empty table gives no rows; other
    columns may have any names. Very long texts are compared whole.
    """
    found = written(similar(documents if texts is None else texts).select("doc_id", "component_id"), "near")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    own = [quoted(c) for c in documents.columns]
    kept = join_small(documents, gone, gone.count(), ["doc_id"], "left_anti").select(*own)
    several = written(documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "several")
    n = several.count()
    if not n:
        return kept
    row = F.struct(*own)
    first = join_small(kept, several, n, ["doc_id"], "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text").isNull().alias("n"), F.col("text").alias("t"))).alias("ohmtide_row"))
    return join_small(kept, several, n, ["doc_id"], "left_anti").select(*own).unionByName(first.select("ohmtide_row.*"))
