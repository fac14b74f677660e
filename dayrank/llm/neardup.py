"""Near-duplicate documents by bottom-k sketches.

A document's set holds the distinct runs of SHINGLE words. One hash function orders all shingles;
a document's sketch is its K smallest. The steps:

1. Documents with equal sets are one class; from here on the class's smallest id stands for it.
2. Inverted lists of the retained values. Two sets with the Jaccard similarity asked for share at
   least a certain number of retained values (exactly for sets within their sketch, else but for a
   probability below 1e-6 for a pair right at the threshold, by Chernoff's bound). So of each sketch
   only a prefix is needed, and the order is free: rarest values first. A value that no other sketch
   holds takes up room in the prefix and makes no list, so ordinary documents, and those that merely
   share a common passage, mostly have no list left at all.
3. Lists longer than CELL, or with more than CELL x WEIGHT shingles, come first. Each of their classes is
   compared, by full sets, with a few members of its largest list, the hubs. Near copies of one
   text meet the same hubs, so they are connected in one pass over them and need not meet again.
4. Each list is a cell. Within it the overlaps of all sketches follow from a matrix product; the
   estimate over the union of two sketches (all values up to the smaller of both ends are known)
   drops members without a possible partner. A pair counts only in its first common list, and not
   if hubs have connected it; of a large list only members that may have such a pair meet.
5. The members left meet again with their full sets. Overlaps are counted exactly over the cell's
   own inverted index (by a matrix product for common values), one member against all others, and links are confirmed as fractions of
   integers. A member is skipped where all others are already in its component or too far off by
   the triangle inequality of Jaccard distances to members compared before, so a group of near
   copies costs a few passes, not all its pairs. Only links that join two components leave the cell.
6. Components of all links.

Of a large list two classes need not meet that hubs have connected, nor two that are both in an earlier
list. By the largest such sets, its classes fall into groups; each group meets those that share none with it,
and both sides are cut into blocks, a cell for each two. So no task holds more than
about 2 x CELL members however hot a passage is, no pair is lost, and a list of near copies is
linear in its members. Only a list of many texts that are not alike still costs the square of its size.

Defined results: a null or empty text, or one of white space, has an empty set and is linked with
nothing; a text with fewer words than SHINGLE has the whole sequence as its one shingle; rows that
repeat an id are one document with all their texts; a null id is linked with nothing, has no
component, and is kept; an empty table gives an empty table; columns beyond those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayrank.llm.cells import by_cell, overlaps
from dayrank.llm.common import LOWER, column, lookup, map_arrow, slices, utf8
from dayrank.llm.components import components
from dayrank.session import materialize

K = 64
SHINGLE = 5
#: Similarity as a fraction: linked if denominator * intersection >= numerator * union.
SIMILARITY = (80, 100)
CELL = 1000
#: Documents whose full sets are wanted, up to so many, are broadcast to the texts; beyond, both
#: sides are shuffled.
BROADCAST_IDS = 1_000_000
#: Hashes of words a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Natural logarithm of the chance to miss a pair right at the threshold.
MISS = math.log(1e6)
#: Standard deviations that an estimate may fall short.
SHORT = 5.0
#: Shingles that a cell holds for each of its members, on average, at most.
WEIGHT = 1000
#: Members of a large list that all others are compared with first.
HUBS = 8
#: Sets of members of a large list, each connected already or meeting in another list, that divide it.
CLIQUES = 5
#: Entries of a cell's inverted index that are counted at once.
POSTINGS = 1 << 20
#: A value is common in a cell if more than one in so many members hold it.
COMMON = 5
#: Members of a cell whose distances to all others are kept for the triangle inequality.
PIVOTS = 8


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted hashes, 63 bits each, of a text's distinct shingles."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.int64)
    if len(words) < width:
        whole = xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)
        return np.array([whole >> 1], dtype=np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - width + 1
    mixed = h[:n].copy()
    for k in range(1, width):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed += h[k : n + k]
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xC4CEB9FE1A85EC53)
    mixed ^= mixed >> np.uint64(33)
    return np.unique((mixed >> np.uint64(1)).astype(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate([np.empty(0, dtype=np.int64), *arrays])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """(id, n_shingles, set_id, sketch) of each row; set_id is a digest of the set, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, text_col):
            sets = [shingle_set(t, width, hashes) for t in utf8(column(batch, text_col))]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, id_col).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    _lists([s[:k] for s in sets]),
                ],
                ["id", "n_shingles", "set_id", "sketch"],
            )

    schema = "id bigint, n_shingles bigint, set_id binary, sketch array<bigint>"
    return map_arrow(docs.select(id_col, text_col), run, schema)


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(set_id, full) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, text_col):
            sets = [shingle_set(t, width, hashes) for t in utf8(column(batch, text_col))]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), _lists(sets)], ["set_id", "full"])

    return map_arrow(docs.select(text_col), run, "set_id binary, full array<bigint>")


def least_shared(k: int, similarity: float) -> list[int]:
    """By a sketch's size 0 to k, how many of its values a similar document's sketch holds at least.
    The last entry is for sets beyond their sketch."""

    def far(shared: int) -> float:
        p = shared / k
        parts = [(p, similarity), (1 - p, 1 - similarity)]
        return k * sum(x * math.log(x / y) for x, y in parts if x > 0 and y > 0)

    beyond = next((s for s in range(int(k * similarity), 0, -1) if far(s) >= MISS), 1)
    out = [0]
    for size in range(1, k + 1):
        least = math.ceil(size * similarity - 1e-9)
        if size / similarity > k:  # the other set may be beyond its sketch
            least = min(least, math.ceil(k - (1 - similarity) * size / similarity - 1e-9))
        out.append(max(1, least))
    return [*out, max(1, min(beyond, out[-1]))]


def prefixes(classes: DataFrame, k: int, similarity: float) -> DataFrame:
    """(rep, set_id, n_shingles, sketch, prefix): the values whose lists a class is to be found in,
    rarest first. Classes without any are left out."""
    values = classes.select(
        "set_id", "n_shingles", F.size("sketch").alias("held"), F.explode("sketch").alias("value")
    )
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    least = F.array(*map(F.lit, least_shared(k, similarity)))
    entry = F.when(F.col("n_shingles") > k, k + 2).otherwise(F.col("held") + 1)
    need = F.col("held") - F.element_at(least, entry.cast("int")) + 1
    room = F.greatest(need - (F.col("held") - F.size("common")), F.lit(0))
    first = (
        values.join(shared, "value")
        .groupBy("set_id", "n_shingles", "held")  # at most k values each
        .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"))
        .select("set_id", F.slice(F.transform("common", lambda c: c["value"]), F.lit(1), room).alias("prefix"))
        .filter(F.size("prefix") > 0)
    )
    return classes.join(first, "set_id").select("rep", "set_id", "n_shingles", "sketch", "prefix")


def in_lists(found: DataFrame) -> DataFrame:
    """(set_id, rep, n_shingles, at, value): each class once for each list it is in."""
    return found.select("set_id", "rep", "n_shingles", F.posexplode("prefix").alias("at", "value"))


def lists(members: DataFrame, cell: int) -> DataFrame:
    """(value, n, weight, large): lists of two members and more, and whether one is too long or too heavy
    for one cell."""
    sized = members.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    large = (F.col("n") > cell) | (F.col("weight") > cell * WEIGHT)
    return sized.filter("n > 1").withColumn("large", large)


def _blocks(n: Column, weight: Column, cell: int) -> Column:
    """So many blocks that each has about ``cell`` members at most, and not too many shingles."""
    return F.greatest(F.ceil(n / cell), F.ceil(weight / (cell * WEIGHT))).cast("int")


def _hub_links(sets: list[np.ndarray], hubs: list[int], similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Confirmed links of members with hubs, and of hubs with each other."""
    above, below = similarity
    root = {h: h for h in hubs}
    out = []

    def near(a: int, b: int) -> bool:
        small, large = sorted((sets[a], sets[b]), key=len)
        if below * len(small) < above * len(large):
            return False
        at = np.searchsorted(large, small)
        both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
        return below * both >= above * (len(small) + len(large) - both)

    def join(a: int, b: int) -> None:
        if root[a] != root[b]:
            out.append((a, b))
            old, new = root[b], root[a]
            root.update({h: new for h, r in root.items() if r == old})

    for at, a in enumerate(hubs):
        for b in hubs[at + 1 :]:
            if root[a] != root[b] and near(a, b):
                join(a, b)
    own = set(hubs)
    for i in range(len(sets)):
        met: int | None = None
        for h in hubs if i not in own else []:
            if (met is None or root[h] != root[met]) and near(i, h):
                if met is None:
                    met = h
                    out.append((i, h))
                else:
                    join(met, h)
    return out


def hub_links(
    members: DataFrame, large: DataFrame, sets: DataFrame, similarity: tuple[int, int], cell: int
) -> DataFrame:
    """(a, b): links of the classes in large lists with a few of their list, the hubs. Each class takes
    part once, in its largest list, so near copies of one text meet the same hubs; the list is
    cut, and its hubs copied to each part. So this is linear in the members."""
    favourite = (
        members.join(lookup(large.drop("large"), BROADCAST_IDS), "value")
        .groupBy("set_id")
        .agg(F.max(F.struct("n", "value", "weight", "rep")).alias("list"))
        .select("set_id", "list.*")
    )
    favourite = materialize(favourite.withColumn("parts", _blocks(F.col("n"), F.col("weight"), cell)), "favourites")
    order = Window.partitionBy("value").orderBy(F.xxhash64("set_id"), "set_id")
    hubs = favourite.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= HUBS)
    hubs = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part = F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("parts")).cast("int")
    rows = favourite.withColumn("part", part).select("set_id", "rep", "value", "part", F.lit(False).alias("hub"))
    rows = rows.unionByName(hubs.select("set_id", "rep", "value", "part", F.lit(True).alias("hub")))
    met = (
        rows.join(sets, "set_id")
        .select(F.concat_ws(":", "value", "part").alias("cell"), "rep", "hub", "full")
        .repartition("cell")
        .sortWithinPartitions("cell")
    )

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in by_cell(batches, ("full",)):
            hubs = [i for i, hub in enumerate(found["hub"]) if hub]
            made = _hub_links(found["full"], hubs, similarity)
            if made:
                ends = [pa.array([found["rep"][pair[end]] for pair in made], pa.int64()) for end in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return map_arrow(met, confirm, "a bigint, b bigint")


def cells(found: DataFrame, known: DataFrame, cell: int) -> DataFrame:
    """(cell, set_id, rep, label, n_shingles, sketch, earlier, asked): a class once for each cell it is in.
    ``earlier`` are its lists before the cell's; classes of one ``label`` are connected already. Only
    those pairs need to meet in a cell of which one at least is ``asked``.

    A list is a cell, and all are asked. In a large one two classes of one label need not meet, nor two
    that are both in an earlier list, as they meet there. Its largest such cliques divide it into groups
    by the cliques they are in, and groups without a common one meet: each group, cut into blocks, is
    asked for those that are larger, cut into blocks too. So a pair of near copies, which are in many
    large lists together, meets in few of them.
    """
    members = in_lists(found)
    simple = members.join(known.filter("NOT large").select("value"), "value")
    simple = simple.select(F.col("value").cast("string").alias("cell"), "set_id", "at", F.lit(True).alias("asked"))

    large = lookup(known.filter("large").select("value"), BROADCAST_IDS)
    within = (
        members.join(large, "value")
        .groupBy("set_id")  # at most a prefix's values each
        .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("all"))
        .join(found.select("set_id", "label", "n_shingles"), "set_id")
        .select("set_id", "label", "n_shingles", "all", F.posexplode("all").alias("nth", "one"))
        .select(
            "set_id",
            "label",
            "n_shingles",
            "one.*",
            F.transform(F.slice("all", F.lit(1), F.col("nth")), lambda one: one["value"]).alias("before"),
        )
    )
    within = materialize(within, "within-large-lists")
    clique = F.explode(
        F.concat(
            F.array(F.struct(F.lit(True).alias("is_label"), F.col("label").alias("name"))),
            F.transform("before", lambda value: F.struct(F.lit(False).alias("is_label"), value.alias("name"))),
        )
    )
    largest = Window.partitionBy("value").orderBy(F.desc("n"), "clique")
    cliques = (
        within.select("value", clique.alias("clique"))
        .groupBy("value", "clique")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .withColumn("nth", F.row_number().over(largest))
        .filter(F.col("nth") <= CLIQUES)
        .groupBy("value")
        .agg(F.array_sort(F.collect_list("clique")).alias("cliques"))
    )
    cliques = materialize(cliques, "cliques")
    is_in = F.transform(
        "cliques",
        lambda c, bit: F.when(
            F.when(c["is_label"], c["name"] == F.col("label")).otherwise(F.array_contains("before", c["name"])),
            F.pow(F.lit(2), bit).cast("int"),
        ).otherwise(0),
    )
    within = (
        within.join(lookup(cliques, BROADCAST_IDS), "value", "left")
        .withColumn("group", F.coalesce(F.aggregate(is_in, F.lit(0), lambda a, b: a + b), F.lit(0)))
        .select("set_id", "value", "at", "n_shingles", "group")
    )
    groups = (
        within.groupBy("value", "group")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
        .groupBy("value")  # at most a power of two of cliques each
        .agg(F.array_sort(F.collect_list(F.struct("n", "group", "weight"))).alias("groups"))
    )

    def apart(a: Column, b: Column) -> Column:
        return a["group"].bitwiseAND(b["group"]) == 0

    def total(of: Column, field: str) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda sum_, g: sum_ + g[field])

    def meeting(g: Column, nth: Column) -> Column:
        """A group, its blocks, and the blocks of those it meets: from itself on in the order of sizes."""
        others = F.filter("groups", lambda other, at: (at >= nth) & apart(g, other))
        return F.struct(
            g["group"].alias("group"),
            _blocks(g["n"], g["weight"], cell).alias("own_blocks"),
            _blocks(total(others, "n"), total(others, "weight"), cell).alias("blocks"),
        )

    groups = materialize(groups.select("value", F.transform("groups", meeting).alias("groups")), "groups")
    own = F.array_position(F.transform("groups", lambda g: g["group"]), F.col("group")).cast("int") - 1

    def name(g: Column, own_block: Column, block: Column) -> Column:
        return F.concat_ws(":", "value", g["group"], own_block, block)

    def numbers(blocks: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), blocks), lambda block: block < blocks)

    asked = F.transform(
        numbers(F.col("me.blocks")),
        lambda block: name(F.col("me"), F.pmod(F.xxhash64("set_id", F.lit(2)), F.col("me.own_blocks")), block),
    )
    asking = F.filter("groups", lambda g, at: (at <= F.col("own")) & apart(g, F.col("me")))
    met = F.flatten(
        F.transform(
            asking,
            lambda g: F.transform(
                numbers(g["own_blocks"]),
                lambda own_block: name(g, own_block, F.pmod(F.xxhash64("set_id"), g["blocks"])),
            ),
        )
    )
    cut = (
        within.join(lookup(groups, BROADCAST_IDS), "value")
        .withColumn("own", own)
        .withColumn("me", F.get("groups", F.col("own")))
        .select("set_id", "at", asked.alias("asked"), met.alias("met"))
        .withColumn(
            "place",
            F.explode(
                F.concat(
                    F.transform("asked", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("asked"))),
                    F.transform(
                        F.array_except("met", "asked"), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("asked"))
                    ),
                )
            ),
        )
        .select("place.cell", "set_id", "at", "place.asked")
    )
    return (
        simple.unionByName(cut)
        .join(found, "set_id")
        .select(
            "cell",
            "set_id",
            "rep",
            "label",
            "n_shingles",
            "sketch",
            F.slice("prefix", F.lit(1), F.col("at")).alias("earlier"),
            "asked",
        )
    )


#: Rows of a cell's matrices that are looked at together.
TILE = 256


def possible(
    sketches: list[np.ndarray],
    sizes: np.ndarray,
    earlier: list[np.ndarray],
    k: int,
    similarity: float,
    labels: np.ndarray | None = None,
    asked: np.ndarray | None = None,
) -> np.ndarray:
    """Whether each member has a partner in the cell, not of its own label, that the estimate does not
    rule out; one of the two is ``asked``. Counts are small numbers, kept in small types, and estimates
    are made by tiles of rows."""
    count = len(sketches)
    labels = np.arange(count) if labels is None else labels
    asked = np.ones(count, dtype=bool) if asked is None else asked
    of = np.flatnonzero(asked)
    both = overlaps(sketches, of)
    met = overlaps(earlier, of)
    whole = sizes <= k
    ends = np.array([np.iinfo(np.int64).max if w else s[-1] for s, w in zip(sketches, whole, strict=True)])
    known = np.empty((count, len(of)), dtype=np.int16)
    for i, (s, end) in enumerate(zip(sketches, ends, strict=True)):
        known[i] = np.searchsorted(s, np.minimum(ends[of], end), side="right")
    out = np.zeros(count, dtype=bool)
    for begin in range(0, len(of), TILE):
        t = slice(begin, begin + TILE)
        rows = of[t]
        union = known[:, t].T - both[t]
        for at, i in enumerate(rows):
            union[at] += np.searchsorted(sketches[i], np.minimum(ends, ends[i]), side="right")
        slack = SHORT * np.sqrt(similarity * (1 - similarity) / np.maximum(union, 1))
        slack[whole[rows, None] & whole[None, :]] = 1e-9
        fits = both[t] >= (similarity - slack) * union
        fits &= np.minimum.outer(sizes[rows], sizes) >= (similarity - 1e-9) * np.maximum.outer(sizes[rows], sizes)
        fits &= met[t] == 0
        fits &= labels[rows, None] != labels[None, :]
        out[rows] |= fits.any(axis=1)
        out |= fits.any(axis=0)
    return out


def links_within(
    sets: list[np.ndarray],
    similarity: tuple[int, int],
    labels: np.ndarray | None = None,
    asked: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Confirmed links that connect the members exactly as all their links would, or all those of members
    that are ``asked``; members of one label are connected already."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(count, dtype=np.int32), sizes)
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = owner[np.argsort(place, kind="stable")]
    begins = np.cumsum(often) - often
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    # Values that many members hold are counted by a matrix product, for a tile of members at once.
    many = often * COMMON > count if count > TILE else np.zeros(len(often), dtype=bool)
    held = many[place]
    holds = np.zeros((count, int(many.sum())), dtype=np.float32)
    holds[owner[held], (np.cumsum(many) - 1)[place[held]]] = 1
    root = np.arange(count)
    if labels is not None:
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        root = first[of]
    open_ = np.ones(count, dtype=bool)  # not yet compared with all others
    pivots: list[np.ndarray] = []
    above, below = similarity
    reach = 1 - above / below + 1e-9
    out: list[tuple[int, int]] = []
    of = np.arange(count) if asked is None else np.flatnonzero(asked)
    tile, shared = -1, np.empty((0, count), dtype=np.float32)
    for nth, i in enumerate(of.tolist()):
        others = open_ & (root != root[i])
        for distance in pivots:
            others &= np.abs(distance - distance[i]) <= reach
        open_[i] = False
        if not others.any():
            continue
        if nth // TILE != tile:
            tile = nth // TILE
            shared = holds[of[tile * TILE : (tile + 1) * TILE]] @ holds.T
        both = shared[nth % TILE].astype(np.int64)
        mine = place[bounds[i] : bounds[i + 1]]
        mine = mine[~many[mine]]
        steps = np.cumsum(often[mine]) // POSTINGS
        for part in np.split(mine, np.flatnonzero(np.diff(steps)) + 1) if len(mine) else []:
            length = often[part]
            stops = np.cumsum(length)
            at = np.arange(stops[-1]) + np.repeat(begins[part] - (stops - length), length)
            both += np.bincount(owners[at], minlength=count)
        union = sizes[i] + sizes - both
        if len(pivots) < PIVOTS:
            pivots.append(1 - both / union)
        for j in np.flatnonzero((below * both >= above * union) & (root != root[i])).tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def links(
    docs: DataFrame,
    classes: DataFrame,
    id_col: str,
    text_col: str,
    width: int,
    similarity: tuple[int, int],
    k: int,
    cell: int,
) -> DataFrame:
    """(a, b): links between the representatives of classes, enough to connect all that any
    links connect."""
    share = similarity[0] / similarity[1]
    found = materialize(prefixes(classes, k, share), "prefixes")
    members = in_lists(found)
    known = materialize(lists(members, cell), "lists")
    large = known.filter("large")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(set_id, full) of the representatives named."""
        wanted = lookup(wanted.select(F.col("rep").alias(id_col)).distinct(), BROADCAST_IDS)
        texts = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).join(wanted, id_col, "left_semi")
        return materialize(full_sets(texts, id_col, text_col, width), "sets").dropDuplicates(["set_id"])

    if large.isEmpty():
        found, made = found.withColumn("label", F.col("rep")), None
    else:
        within = materialize(
            members.join(lookup(large.select("value"), BROADCAST_IDS), "value").select("set_id", "rep").distinct(),
            "in-large-lists",
        )
        made = materialize(hub_links(members, large, sets_of(within), similarity, cell), "hub-links")
        labels = components(made).select(F.col("node").alias("rep"), F.col("component").alias("label"))
        found = materialize(
            found.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled"
        )

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in by_cell(batches, ("sketch", "earlier")):
            if len(rows["rep"]) < 2:
                continue
            labels, asked = np.array(rows["label"]), np.array(rows["asked"])
            sizes = np.array(rows["n_shingles"])
            keep = np.flatnonzero(possible(rows["sketch"], sizes, rows["earlier"], k, share, labels, asked))
            if len(keep):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(keep)),
                        pa.array([rows["rep"][i] for i in keep], pa.int64()),
                        pa.array([rows["label"][i] for i in keep], pa.int64()),
                        pa.array([rows["set_id"][i] for i in keep], pa.binary()),
                        pa.array(asked[keep]),
                    ],
                    ["cell", "rep", "label", "set_id", "asked"],
                )

    ordered = cells(found, known, cell).repartition("cell").sortWithinPartitions("cell")
    schema = "cell string, rep bigint, label bigint, set_id binary, asked boolean"
    left = materialize(map_arrow(ordered, screen, schema), "members")
    sets = sets_of(left)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_cell(batches, ("full",)):
            if len(rows["rep"]) < 2:
                continue
            pairs = links_within(rows["full"], similarity, np.array(rows["label"]), np.array(rows["asked"]))
            if pairs:
                ends = [pa.array([rows["rep"][pair[end]] for pair in pairs], pa.int64()) for end in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    met = left.join(sets, "set_id").select("cell", "rep", "label", "asked", "full")
    rest = map_arrow(met.repartition("cell").sortWithinPartitions("cell"), confirm, "a bigint, b bigint")
    return rest if made is None else made.unionByName(rest)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    similarity: tuple[int, int] = SIMILARITY,
    k: int = K,
    cell: int = CELL,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row."""
    rows = materialize(sketches(docs, id_col, text_col, width, k), "sketches")
    usable = rows.filter("set_id IS NOT NULL AND id IS NOT NULL")
    classes = materialize(
        usable.groupBy("set_id").agg(
            F.min("id").alias("rep"),
            F.count(F.lit(1)).alias("n"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    # A document of several texts links the classes of these.
    several = usable.groupBy("id").agg(F.count_distinct("set_id").alias("n")).filter("n > 1").select("id")
    joined = (
        usable.select("id", "set_id")
        .join(several, "id")
        .join(classes.select("set_id", "rep"), "set_id")
        .select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    made = links(docs, classes, id_col, text_col, width, similarity, k, cell)
    labels = components(made.unionByName(joined))
    linked = materialize(
        classes.select("set_id", "rep", "n")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .filter("n > 1 OR component IS NOT NULL")
        .select("set_id", F.coalesce("component", "rep").alias("component")),
        "linked",
    )
    component = F.coalesce("component", "id")
    return (
        rows.select("id", "n_shingles", "set_id")
        .join(linked, "set_id", "left")
        .select(
            F.col("id").alias(id_col),
            "n_shingles",
            component.alias("component_id"),
            component.eqNullSafe(F.col("id")).alias("kept"),
        )
    )
