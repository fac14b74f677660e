"""Spelling variants: words of the corpus that are one inserted, deleted or replaced letter apart.

Words are runs of letters, counted over all documents; an artificial slip (a letter left out of a
run, chosen by a hash of document and run) can be asked for. The words that occur often enough are
sorted, and so are their reversals; each task numbers the trie nodes of its part of the order as it
meets them, and the few nodes that a part shares with the one before get the earlier part's
numbers. A word then is two lists of integers: the nodes of its prefixes and of its suffixes.

The pair dictionary holds, for each word, the pair (prefix node, suffix node) around each skipped
letter, and the pair at each place between two letters. Two words with one pair in common, each with
a letter skipped, differ by that letter; a pair around a skipped letter of one word that is a place
in another is a letter inserted. No other words are near, and each near pair of words has exactly
one such pair of nodes (of a run of equal letters only the first is skipped for an insertion). A
pair of nodes with a skipped letter belongs to at most as many words as there are letters, so no group is
large, however frequent a word or a prefix is, and no pairs of words are ever listed: a group gives each
member how many others there are and the most frequent of them.

A word's form is its most frequent near word, by ties the first in code-point order, if that occurs at
least RATIO times as often. Frequencies grow along forms, so they end at a root within as many steps
as a frequency has binary digits; roots are handed down step by step.

A null or empty text has no words; a null id is written as nothing in the hash. Repeated rows count
as often as they occur. Long texts and words are taken whole: a word of L letters makes 2 L + 1 pairs. An
empty table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrank.llm.common import column, let, map_arrow
from dayrank.session import materialize

#: Runs of letters, as a pattern; capital letters of ASCII are lowered, others are not.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
#: One run in so many of a document loses a letter.
SLIP = 97
#: Nodes of a task are numbered from its partition's number times this.
PART = 1 << 40


def word_counts(docs: DataFrame, slip: int | None = SLIP) -> DataFrame:
    """``word`` and ``n`` of the words that are long and frequent enough."""
    runs = (
        docs.select(
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
            F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"),
        )
        .filter(F.length("run") >= LEAST_LETTERS)
        .select("id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(
            F.translate("run", UPPER, LOWER)).alias("run"))
    )
    if slip is not None:
        hashed = runs.withColumn("h", F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8")))
        at = (F.col("h") % F.length("run")).cast("int")
        short = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
        runs = hashed.select(F.when(F.col("h") % slip == 0, short).otherwise(F.col("run")).alias("run"))
        runs = runs.filter(F.length("run") >= LEAST_LETTERS)
    counted = runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition with the trie nodes of their keys and their place in the order.
    The first key's nodes have the first numbers, by depth."""
    base = TaskContext.get().partitionId() * PART
    place, fresh, last, stack = base, base + 1, "", [base]
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, starts = [], [0]
        for key in column(batch, "key").to_pylist():
            shared = common_prefix(last, key)
            del stack[shared + 1 :]
            new = len(key) - shared
            stack.extend(range(fresh, fresh + new))
            fresh += new
            last = key
            flat += stack
            starts.append(len(flat))
        nodes = pa.ListArray.from_arrays(
            pa.array(np.array(starts, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int64))
        )
        order = pa.array(np.arange(place, place + batch.num_rows, dtype=np.int64))
        place += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, order, nodes], [*batch.schema.names, "place", "nodes"])


def common_prefix(a: str, b: str) -> int:
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    return next(i for i in range(size) if a[i] != b[i])


def _earlier(parts: list[tuple[str, str, list[int]]]) -> list[list[int]]:
    """For each part of the order the numbers that earlier parts gave to the first nodes of its first key.
    A part is given by its first key, its last key, and that key's nodes."""
    found: list[list[int]] = []
    last_key, last_nodes = "", []
    for first, last, nodes in parts:
        shared = last_nodes[: common_prefix(last_key, first) + 1]
        found.append(shared)
        base = nodes[0] // PART * PART
        last_key = last
        last_nodes = [shared[x - base] if x - base < len(shared) else x for x in nodes]
    return found


def numbered(frame: DataFrame, key: str, name: str) -> DataFrame:
    """The frame, unique on ``key``, with ``place``, which rises in the order of the keys, and ``nodes``,
    the trie nodes of all prefixes of the key from the empty one on. What the driver sees is the first
    and last key of each partition."""
    ordered = frame.withColumn("key", F.col(key)).repartitionByRange("key").sortWithinPartitions("key")
    kinds = "".join(f"{c} {kind}, " for c, kind in ordered.dtypes)
    table = materialize(map_arrow(ordered, _number, f"{kinds}place long, nodes array<long>"), name)
    part = F.floor(F.col("place") / PART).cast("long")
    ends = (
        table.groupBy(part.alias("part"))
        .agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("nodes", "key").alias("nodes"))
        .orderBy("part")
        .collect()
    )
    earlier = _earlier([(r["first"], r["last"], list(r["nodes"])) for r in ends])
    rows = [(r["part"], shared) for r, shared in zip(ends, earlier, strict=True)]
    shared = frame.sparkSession.createDataFrame(rows, "part long, earlier array<long>")
    base = F.col("part") * PART
    return table.withColumn("part", part).join(F.broadcast(shared), "part").select(
        *frame.columns,
        "place",
        F.transform(
            "nodes",
            lambda x: F.when(x - base < F.size("earlier"), F.get("earlier", (x - base).cast("int"))).otherwise(x),
        ).alias("nodes"),
    )


#: What a row of the pair dictionary is: a skipped letter, one that is the first of its run, a place.
SKIP, FIRST_SKIP, WHOLE = 0, 1, 2


def dictionary(words: DataFrame) -> DataFrame:
    """One row for each skipped letter and each place of each word: the nodes before and after it."""

    def pairs(letters: Column) -> Column:
        size = F.size(letters)

        def skipped(_: Column, at: Column) -> Column:
            new = (at == 0) | (F.get(letters, at) != F.get(letters, at - 1))
            return entry(at, size - 1 - at, F.when(new, FIRST_SKIP).otherwise(SKIP))

        def entry(before: Column, after: Column, kind: Column) -> Column:
            return F.struct(
                F.get("before", before).alias("before"), F.get("after", after).alias("after"), kind.alias("kind")
            )

        places = F.transform(F.sequence(F.lit(0), size), lambda at: entry(at, size - at, F.lit(WHOLE)))
        return F.concat(F.transform(letters, skipped), places)

    each = F.explode(let(F.split("word", ""), pairs)).alias("pair")
    return words.select("place", "n", each).select("place", "n", "pair.*")


def near(words: DataFrame) -> DataFrame:
    """For each word with near words (by its ``place``): how many there are, and the best of them as the
    struct ``best`` of its negative frequency and place."""
    member = F.struct("kind", (-F.col("n")).alias("less"), "place")
    groups = (
        dictionary(words)
        .groupBy("before", "after")
        .agg(F.collect_list(member).alias("members"))
        .filter(F.size("members") > 1)
    )

    def best_of(found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["less"].alias("less"), x["place"].alias("place")))

    def told(x: Column, number: Column, best: Column) -> Column:
        return F.struct(x["place"].alias("place"), number.cast("long").alias("n_near"), best.alias("best"))

    # A word is at most once in a group; a place belongs to one word.
    skips = F.sort_array(best_of(F.filter("members", lambda x: x["kind"] != WHOLE)))
    firsts = F.sort_array(best_of(F.filter("members", lambda x: x["kind"] == FIRST_SKIP)))
    whole = best_of(F.filter("members", lambda x: x["kind"] == WHOLE))
    lists = groups.select("members", skips.alias("skips"), firsts.alias("firsts"), whole.alias("whole"))

    def of_member(x: Column) -> Column:
        other = F.when(
            F.get("skips", F.lit(0))["place"] != x["place"], F.get("skips", F.lit(0))
        ).otherwise(F.get("skips", F.lit(1)))
        met = F.when(x["kind"] == FIRST_SKIP, F.get("whole", F.lit(0)))
        skip = told(x, F.size("skips") - 1 + met.isNotNull().cast("int"), F.least(other, met))
        return F.when(x["kind"] == WHOLE, told(x, F.size("firsts"), F.get("firsts", F.lit(0)))).otherwise(skip)

    return (
        lists.select(F.explode(F.transform("members", of_member)).alias("x"))
        .select("x.*")
        .filter(F.col("n_near") > 0)
        .groupBy("place")
        .agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """``place`` and ``root`` of all words with a form. A form has a bounded number of near words, so
    handing a root down meets no large key."""
    spark = forms.sparkSession
    rest = forms.filter(F.col("form_place").isNotNull()).select("place", "form_place")
    known = forms.filter(F.col("form_place").isNull()).select(
        F.col("place").alias("form_place"), F.col("word").alias("root")
    )
    found: DataFrame | None = None
    while not rest.isEmpty():
        step = materialize(rest.join(known, "form_place", "left"), "roots")
        new = step.filter(F.col("root").isNotNull()).select("place", "root")
        found = new if found is None else found.unionByName(new)
        rest = step.filter(F.col("root").isNull()).select("place", "form_place")
        known = new.withColumnRenamed("place", "form_place")
    return found if found is not None else _no_roots(spark)


def _no_roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "place long, root string")


def variants(docs: DataFrame, slip: int | None = SLIP) -> DataFrame:
    """One row per word: its form and root, its frequency, the number of its near words, and its form's
    frequency."""
    counted = materialize(word_counts(docs, slip), "words")
    forward = numbered(counted, "word", "prefixes").withColumnRenamed("nodes", "before")
    forward = materialize(forward, "words-by-order")
    backward = numbered(
        forward.select(F.col("place").alias("word_place"), F.reverse("word").alias("reversed")), "reversed", "suffixes"
    ).select(F.col("word_place").alias("place"), F.col("nodes").alias("after"))
    found = near(forward.join(backward, "place"))
    words = forward.select("place", "word", "n").join(found, "place", "left")
    enough = -F.col("best.less") >= RATIO * F.col("n")
    chosen = materialize(
        words.select(
            "place",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.place")).alias("form_place"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    names = chosen.select(F.col("place").alias("form_place"), F.col("word").alias("form"))
    with_form = chosen.filter(F.col("form_place").isNotNull()).select("place", "form_place")
    known = with_form.join(names, "form_place").join(roots(chosen), "place").select("place", "form", "root")
    return chosen.join(known, "place", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
