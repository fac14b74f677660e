"""Quality rules: base counts of a text, and how far it is from what its language looks like.

A language's reference is counted over all documents of that language: the shares of six classes of
characters in words, and the shares of its COMMON most frequent words and of all others together. A document's
histograms are compared with them by the Jensen-Shannon distance (the root of the divergence in bits,
0 for equal and 1 for disjoint histograms). A short text's histogram says little, so characters are
compared from MIN_CHARS characters in words on, words from MIN_WORDS words on. A document is kept when
its base counts pass and no distance that may be compared exceeds its limit.

All of it is built-in functions on the row a text is in: windows of three words are sorted within
their text, common words are sorted and counted as runs. What is shuffled is word counts for the
references, combined before. References are broadcast while their languages are counted to be few;
beyond that they are joined, copied to SPREAD salts, so a language with a third of all rows is not a task.

A null or empty text has no words and fails the base rule. A null language is one of its own. Rows that
repeat are judged one by one. Words equally frequent are taken in code-point order. Long texts are read
whole. An empty table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayrank.llm.common import let, small_enough
from dayrank.session import materialize

#: A word, and the characters between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Classes of characters in the order they are taken out of a text; what is left is the last class.
CLASSES = {
    "lower": "[a-z]+",
    "upper": "[A-Z]+",
    "other_script": r"[^\x00-\x7F]+",
    "digit": "[0-9]+",
    "punctuation": "[.,;:!?'\"()-]+",
}
WINDOW = 3
#: Bits of a sorted number that tell a window's place.
PLACE_BITS = 24
#: Base rule: fewer words, or a larger share (in hundredths) of words in repeated windows, fails.
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Frequent words of a language that have a bin of their own.
COMMON = 50
#: Shorter texts are not compared.
MIN_CHARS = 200
MIN_WORDS = 100
#: Largest distances that pass.
MOST_CLASS = 0.25
MOST_WORD = 0.35
#: Languages up to which references are broadcast (each has 6 + COMMON numbers), and salts beyond.
BROADCAST_LANGUAGES = 10_000
SPREAD = 64


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def class_counts(docs: DataFrame, text: str) -> DataFrame:
    """The frame with ``__classes``, the number of characters of each class, ``__word_chars``, those in
    words, and ``__symbols``. Each class is taken out of what the ones before left."""
    left = docs.withColumn("__left0", F.coalesce(text, F.lit("")))
    for at, pattern in enumerate([*CLASSES.values(), SPACE], 1):
        left = left.withColumn(f"__left{at}", F.regexp_replace(f"__left{at - 1}", pattern, ""))
    last = len(CLASSES) + 1
    length = [F.length(f"__left{at}").cast("long") for at in range(last + 1)]
    sizes = [a - b for a, b in zip(length, length[1:], strict=False)]
    spaces = sizes.pop()
    return left.select(
        *docs.columns,
        F.array(*sizes, length[-1]).alias("__classes"),
        (length[0] - spaces).alias("__word_chars"),
        (length[-1] - F.length(F.translate(f"__left{last}", SYMBOLS, "")).cast("long")).alias("__symbols"),
    )


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more.

    Windows are hashed and sorted by hash and place in one number, which is cheap; those whose hash
    meets another are then sorted by their words, so the count is exact. A text with more words than
    the places a number has room for is sorted by its words right away.
    """

    def reach(starts: Column) -> Column:
        each = F.transform(
            starts, lambda x, at: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, at + 1) - x, F.lit(WINDOW)))
        )
        return F.aggregate(each, F.lit(0).cast("long"), lambda n, x: n + x)

    def twice(windows: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.coalesce((a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"]), F.lit(False))

        found = F.filter(
            windows, lambda x, at: same(x, F.get(windows, at - 1)) | same(x, F.get(windows, at + 1))
        )
        return let(F.sort_array(F.transform(found, lambda x: x["at"])), reach)

    def from_words(found: Column) -> Column:
        n = F.size(found) - (WINDOW - 1)
        hashed = F.transform(
            F.slice(found, F.lit(1), F.greatest(n, F.lit(0))),
            lambda word, at: F.xxhash64(word, F.get(found, at + 1), F.get(found, at + 2))
            .bitwiseAND(F.lit(-(1 << PLACE_BITS)))
            .bitwiseOR(at.cast("long")),
        )

        def meeting(sorted_hashes: Column) -> Column:
            def equal(at: Column) -> Column:
                differ = F.get(sorted_hashes, at).bitwiseXOR(F.get(sorted_hashes, at + 1))
                return F.shiftright(differ, PLACE_BITS) == 0

            first = F.filter(F.sequence(F.lit(0), F.size(sorted_hashes) - 2), equal)
            both = F.array_distinct(F.flatten(F.transform(first, lambda at: F.array(at, at + 1))))
            return F.transform(
                both, lambda at: F.get(sorted_hashes, at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
            )

        none = F.array().cast("array<int>")
        places = (
            F.when(n < 2, none)
            .when(n > (1 << PLACE_BITS), F.sequence(F.lit(0), n - 1))
            .otherwise(let(F.sort_array(hashed), meeting))
        )
        windows = F.transform(
            places,
            lambda at: F.struct(
                F.get(found, at).alias("a"),
                F.get(found, at + 1).alias("b"),
                F.get(found, at + 2).alias("c"),
                at.alias("at"),
            ),
        )
        return let(F.sort_array(windows), twice)

    return let(words, from_words)


def _term(p: Column, q: Column) -> Column:
    """What a bin adds to the divergence."""
    def half(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (p + q)) / 2).otherwise(F.lit(0.0))

    return half(p) + half(q)


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda n, x: n + x)


def _root(divergence: Column) -> Column:
    """Rounded first: near zero the root would enlarge what sums in another order differ by."""
    return F.sqrt(F.greatest(F.round(divergence, 12), F.lit(0.0)))


def class_distance(counts: Column, reference: Column) -> Column:
    """Distance of a histogram of counts from one of shares with the same bins."""

    def from_total(total: Column) -> Column:
        return _total(F.zip_with(counts, reference, lambda c, q: _term(c / total, q)))

    return _root(let(_total(F.transform(counts, lambda c: c.cast("double"))), from_total))


def word_distance(words: Column, common: Column) -> Column:
    """Distance of a text's words from a language's, given as a map from common words to shares.
    A common word that the text lacks adds half its share, so only those it has are counted."""

    def from_runs(hits: Column, total: Column, shares: Column) -> Column:
        def terms(starts: Column) -> Column:
            def shared(run: Column) -> Column:
                return F.coalesce(F.element_at(shares, run["word"]), F.lit(0.0))

            def add(runs: Column) -> Column:
                known = _total(F.map_values(shares))
                present = _total(F.transform(runs, shared))
                shares_of = F.transform(runs, lambda run: F.struct((run["n"] / total).alias("p"), shared(run).alias("q")))
                each = _total(F.transform(shares_of, lambda bin: _term(bin["p"], bin["q"])))
                rest = (total - F.size(hits)) / total
                missing = F.greatest(known - present, F.lit(0.0)) / 2
                return each + missing + _term(rest, F.greatest(1 - known, F.lit(0.0)))

            runs = F.transform(
                starts,
                lambda at, k: F.struct(
                    F.get(hits, at).alias("word"),
                    (F.coalesce(F.get(starts, k + 1), F.size(hits)) - at).cast("double").alias("n"),
                ),
            )
            return let(runs, add)

        first = F.transform(hits, lambda w, at: F.when((at == 0) | (w != F.get(hits, at - 1)), at))
        return let(F.filter(first, lambda at: at.isNotNull()), terms)

    def from_words(found: Column) -> Column:
        total = F.size(found).cast("double")

        def from_names(names: Column) -> Column:
            size = F.octet_length
            longest = F.array_max(F.transform(names, size))
            by_size = F.transform(F.sequence(F.lit(0), longest), lambda n: F.filter(names, lambda w: size(w) == n))

            def from_sizes(sized: Column) -> Column:
                hits = F.filter(found, lambda w: F.array_contains(F.get(sized, size(w)), w))
                return let(F.sort_array(hits), lambda h: from_runs(h, total, common))

            return let(by_size, from_sizes)

        # A copy of the names: looking into the map anew for each word costs more than comparing.
        return let(F.transform(F.map_keys(common), lambda w: w), from_names)

    return _root(let(words, from_words))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each language: ``__lang``, the shares of the character classes and of the common
    words. Counted over all words of all documents; characters are counted once a different word."""
    counted = materialize(
        docs.select(F.coalesce(lang, F.lit("")).alias("__lang"), F.explode(words_of(F.col(text))).alias("word"))
        .groupBy("__lang", "word")
        .agg(F.count(F.lit(1)).alias("n")),
        "word-counts",
    )
    n_classes = len(CLASSES) + 1
    totals = (
        class_counts(counted, "word")
        .groupBy("__lang")
        .agg(
            F.sum("n").alias("total"),
            *(F.sum(F.col("n") * F.col("__classes")[at]).alias(f"c{at}") for at in range(n_classes)),
        )
    )
    chars = sum((F.col(f"c{at}") for at in range(n_classes)), F.lit(0))
    shares = F.array(*(F.col(f"c{at}") / chars for at in range(n_classes)))
    # The limit on the rank is applied before the shuffle as well, so a language's words never
    # meet in one task.
    best = Window.partitionBy("__lang").orderBy(F.desc("n"), "word")
    common = counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= COMMON)
    entry = F.struct("word", (F.col("n") / F.col("total")).alias("share"))
    return materialize(
        common.join(totals, "__lang")
        .groupBy("__lang", shares.alias("__class_shares"))
        .agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("__word_shares")),
        "references",
    )


def _with_references(docs: DataFrame, found: DataFrame) -> DataFrame:
    if small_enough(found, BROADCAST_LANGUAGES):
        return docs.join(F.broadcast(found), "__lang", "left")
    salted = docs.withColumn("__salt", F.pmod(F.xxhash64("__text"), F.lit(SPREAD)).cast("int"))
    copies = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return salted.join(copies, ["__lang", "__salt"], "left").drop("__salt")


def judge(docs: DataFrame, found: DataFrame, *carry: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``carry`` columns of each document with its base counts, distances and verdict."""
    rows = docs.select(
        *(F.col(c).alias(f"__carry{at}") for at, c in enumerate(carry)),
        F.coalesce(text, F.lit("")).alias("__text"),
        F.coalesce(lang, F.lit("")).alias("__lang"),
    )
    kept = [f"__carry{at}" for at in range(len(carry))]
    counted = class_counts(_with_references(rows, found), "__text").withColumn("__words", words_of(F.col("__text")))
    measured = counted.select(
        *(F.col(k).alias(c) for k, c in zip(kept, carry, strict=True)),
        F.size("__words").cast("long").alias("n_words"),
        F.col("__word_chars").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        duplicate_lines(F.col("__text")).alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.when(
            F.col("__word_chars") >= MIN_CHARS, class_distance(F.col("__classes"), F.col("__class_shares"))
        ).alias("class_distance"),
        F.when(F.size("__words") >= MIN_WORDS, word_distance(F.col("__words"), F.col("__word_shares"))).alias(
            "word_distance"
        ),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASS) & (
        F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD
    )
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & near)


def rules(docs: DataFrame) -> DataFrame:
    """All documents judged against the references of their own corpus."""
    return judge(docs, references(docs), "doc_id")
