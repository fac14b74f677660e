"""Secret scan with corpus-wide ownership frequency, in built-in Spark expressions only.

Candidates are found by pattern, with their places in code points. What a candidate is worth is
not seen in its document: a value copied into many repositories of many owners is an example from
a manual, one that stays with a single owner and looks random may be a live credential. So the
hashes of all candidate values are aggregated over the corpus by distinct repositories and owners,
and the verdict goes back to every place where the value stands.

Texts are read once. The narrow table of candidates is written to the shared folder; only it is
shuffled. A value that holds a third of all candidates is reduced to one row for each task and pair of
repository and owner before it is counted, and its places are spread over tasks when its verdict
goes back to them.

Defined results: a null text is empty; a document without candidates has zeros, empty lists and
no spans; repeated rows each get their own row; a null repository or owner counts as none, and a
value without any owner is not called live; overlapping candidates of different kinds all count;
an empty table gives an empty table. Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrank.operators.skew import spread_join
from dayrank.session import materialize

#: Fixed patterns and least lengths. For access and hex a run of the least length or more is the
#: same as a whole run of which short ones are dropped; an assignment's whole match counts first.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")

#: A value that so many owners or repositories hold is a copied example.
#: Repositories count where there is more than one owner.
WIDE_OWNERS = 3
WIDE_REPOSITORIES = 5
#: A value with more places than this is spread over tasks; such values are at most the places by it.
HOT_PLACES = 100_000
#: A value looks random if it has at least so many different characters.
VARIED = 8


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost matches that do not overlap."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), 0)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(state["found"], one).alias("found"))

    pairs = F.zip_with(
        F.slice(between, 1, F.size(values)),
        values,
        lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")),
    )
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    found = F.aggregate(pairs, start, step, lambda state: state["found"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def _credential(kind: str, value: Column) -> Column:
    """What is compared over the corpus: of an assignment the value assigned."""
    return F.regexp_extract(value, ASSIGN, 2) if kind == "assign" else value


def _of_kind(text: Column, order: int, kind: str, pattern: str) -> Column:
    spans = F.transform(
        _matches(text, pattern),
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(order).alias("kind_order"),
            m["end"].alias("end"),
            F.lit(kind).alias("kind"),
            _credential(kind, m["value"]).alias("value"),
        ),
    )
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= ASSIGN_VALUE)
    return spans


def candidates(
    docs: DataFrame, text_col: str, id_col: str, repository_col: str, owner_col: str
) -> DataFrame:
    """A row for each document row, with its candidates by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = zip(KINDS, (ASSIGN, ACCESS, HEX), strict=True)
    found = [_of_kind(text, order, *what) for order, what in enumerate(patterns)]
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.col(repository_col).cast("string").alias("repository"),
        F.col(owner_col).cast("string").alias("owner"),
        F.array_sort(F.concat(*found)).alias("spans"),
    ).select(
        "row_id",
        "doc_id",
        "repository",
        "owner",
        # The value itself goes no further than this.
        F.transform(
            "spans",
            lambda s: F.struct(
                s["kind"].alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.sha2(s["value"], 256).alias("value_sha256"),
                (F.size(F.array_distinct(F.split(s["value"], ""))) >= VARIED).alias("varied"),
            ),
        ).alias("spans"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value_sha256, n_repositories, n_owners, n_places) over all candidates."""
    places = found.filter(F.size("spans") > 0).select("repository", "owner", F.explode("spans.value_sha256").alias("value_sha256"))
    per_owner = places.groupBy("value_sha256", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("value_sha256").agg(
        F.count_distinct("repository").alias("n_repositories"),
        F.count_distinct("owner").alias("n_owners"),
        F.sum("n").alias("n_places"),
    )


def scan(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    repository_col: str = "source",
    owner_col: str = "source",
    wide_owners: int = WIDE_OWNERS,
    wide_repositories: int = WIDE_REPOSITORIES,
) -> DataFrame:
    """(row_id, doc_id, spans) of each document row; a span is a struct of kind, start, end,
    value_sha256 and verdict: ``example`` (widely copied), ``live`` (one owner, random) or
    ``unclear``."""
    found = materialize(candidates(docs, text_col, id_col, repository_col, owner_col), "candidates")
    places = found.filter(F.size("spans") > 0).select("row_id", F.explode("spans").alias("s"))
    # A value that one owner holds in many repositories is still that owner's.
    copied = (F.col("n_repositories") >= wide_repositories) & (F.col("n_owners") > 1)
    wide = (F.col("n_owners") >= wide_owners) | copied
    verdict = (
        F.when(wide, "example")
        .when((F.col("n_owners") == 1) & F.col("s.varied"), "live")
        .otherwise("unclear")
    )
    owned = materialize(ownership(found), "ownership")
    hot = owned.filter(F.col("n_places") > HOT_PLACES).select(
        "value_sha256", F.ceil(F.col("n_places") / HOT_PLACES).alias("copies")
    )
    valued = places.withColumn("value_sha256", F.col("s.value_sha256"))
    judged = (
        spread_join(valued, owned, ["value_sha256"], hot, ("row_id",), "inner")
        .select(
            "row_id",
            F.struct(
                F.col("s.start").alias("start"),
                F.array_position(F.array(*map(F.lit, KINDS)), F.col("s.kind")).cast("int").alias("kind_order"),
                F.col("s.end").alias("end"),
                F.col("s.kind").alias("kind"),
                F.col("value_sha256"),
                verdict.alias("verdict"),
            ).alias("s"),
        )
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list("s")).alias("spans"))
    )
    none = F.array().cast(judged.schema["spans"].dataType)
    return found.select("row_id", "doc_id").join(judged, "row_id", "left").select(
        "row_id", "doc_id", F.coalesce("spans", none).alias("spans")
    )


def listed(spans: Column, name) -> Column:
    """name:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
