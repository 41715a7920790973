"""Secret scan judged by corpus-wide ownership frequency.

Candidates of every whole text are found by patterns.  Over the whole corpus,
the hash of each candidate is counted by distinct repositories and distinct
owners: what several owners hold is a widely copied example, what a single one
holds looks live.  Generic tokens, which are no secret by their form alone,
become spans only if they look live; spans of the fixed patterns always stay
and carry the verdict.  DataFrame functions only.

Counts go from (hash, owner, repository) over (hash, owner) to hash with partial
sums at each step, so a secret in a third of all rows is a row per task; the
join of verdicts back to the places has one row per hash on one side, and
adaptive execution splits a hot hash on the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Fixed patterns: kind, regular expression, least characters of the secret, group that holds it.
KINDS = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    # a run that is too short holds no longer one, so the least length is part of the pattern
    ("access", r"AKIA[A-Z0-9]{14,}", 18, 0),
    ("hex", r"[0-9a-f]{16,}", 16, 0),
    ("generic", r"[A-Za-z0-9+/_=-]{24,}", 24, 0),
)
BASE = ("assign", "access", "hex")
#: From so many owners on, a candidate counts as a copied example.
SHARED_OWNERS = 2


def _places(text: Column, number: int, pattern: str, group: int) -> Column:
    """The matches in order: kind, number, characters since the last match, match, secret."""
    regex = F.lit(pattern)
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, regex, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, regex, F.lit(group)).alias("secret"),
        F.split(text, pattern, -1).alias("gap"),
    )

    def place(z: Column, i: Column) -> Column:
        return F.struct(
            F.lit(number).alias("kind"),
            i.alias("at"),
            F.length(z["gap"]).alias("gap"),
            F.length(z["match"]).alias("width"),
            F.length(z["secret"]).alias("chars"),
            # the last gap has no match after it
            F.when(z["match"].isNotNull(), F.sha2(z["secret"], 256)).alias("hash"),
            (z["secret"].rlike("[0-9]") & z["secret"].rlike("[a-z]") & z["secret"].rlike("[A-Z]")).alias("mixed"),
        )

    kind = "array<struct<kind:int,at:int,gap:int,width:int,chars:int,hash:string,mixed:boolean>>"
    return F.when(text.rlike(pattern), F.transform(zipped, place)).otherwise(F.array()).cast(kind)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str | None = None,
) -> DataFrame:
    """One row per document: its id and ``spans``.

    ``spans`` is an array, by start and then kind, of kind, start and end (code
    points, end exclusive), hash of the secret, owners, repositories and live.
    The repository is the document itself unless a column is named.  A null
    text counts as empty, null owners and repositories as one each.  Repeated
    rows are scanned each but count as one repository.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*(_places(text, i, pattern, group) for i, (_, pattern, _, group) in enumerate(KINDS)))
    read = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
            F.coalesce(F.col(repository_col or id_col).cast("string"), F.lit("")).alias("repository"),
            found.alias("found"),
        )
    )
    in_text = Window.partitionBy("row", "kind").orderBy("at")
    least = F.element_at(F.array(*(F.lit(n) for _, _, n, _ in KINDS)), F.col("kind") + 1)
    generic = len(BASE)
    places = (
        read.where(F.size("found") > 0)
        .select("row", "owner", "repository", F.explode("found").alias("f"))
        .select("row", "owner", "repository", "f.*")
        .withColumn("end", F.sum(F.col("gap") + F.coalesce("width", F.lit(0))).over(in_text))
        .where(F.col("hash").isNotNull() & (F.col("chars") >= least) & ((F.col("kind") < generic) | F.col("mixed")))
        .select("row", "owner", "repository", "kind", (F.col("end") - F.col("width")).alias("start"), "end", "hash")
    )
    places = staged(places)
    verdicts = (
        places.groupBy("hash", "owner", "repository")
        .agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner")
        .agg(F.sum("one").alias("repositories"))
        .groupBy("hash")
        .agg(F.count("owner").alias("owners"), F.sum("repositories").alias("repositories"))
    )
    span = F.struct("start", "kind", "end", "hash", "owners", "repositories", (F.col("owners") < SHARED_OWNERS).alias("live"))
    by_row = places.join(verdicts, "hash").groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("all"))
    fixed = F.filter("all", lambda s: s["kind"] < generic)

    def stays(s: Column) -> Column:
        free = ~F.exists("fixed", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return (s["kind"] < generic) | (s["live"] & free)

    def named(s: Column) -> Column:
        names = F.array(*(F.lit(kind) for kind, *_ in KINDS))
        return F.struct(
            F.element_at(names, s["kind"] + 1).alias("kind"),
            *(s[name].alias(name) for name in ("start", "end", "hash", "owners", "repositories", "live")),
        )

    shown = by_row.withColumn("fixed", fixed).select(
        "row", F.transform(F.filter("all", stays), named).alias("spans")
    )
    none = F.array().cast(shown.schema["spans"].dataType)
    joined = read.select("row", "id").join(shown, "row", "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))
