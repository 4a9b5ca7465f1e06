"""Secret scans with corpus-wide ownership frequency.

Candidates of every text are hashed and counted by the distinct repositories and
owners that hold them. A value that many owners hold is a copied example; one
that a single owner holds and that looks live is that owner's credential. Base
findings always stay in the result, whatever their class; the method adds the
live-looking values that the base patterns don't name and that aren't widely copied.

Only DataFrame functions run. A regular expression's matches give texts, not
places, so places come from the lengths of matches and of the pieces between.

Defined results: a null text is empty and has no findings; a null owner or
repository counts as one owner or repository of its own; repeated rows get equal
results; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.scratch import written

#: The base kinds in their order, with pattern, value group and least length of the value.
BASE_KINDS = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds that the ownership method may add: issuers' prefixes, and long mixed runs.
ADDED_KINDS = (
    ("issued", r"(?:gh[opsu]_|glpat-|[sr]k_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    ("opaque", r"[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32),
)
KINDS = [k[0] for k in (*BASE_KINDS, *ADDED_KINDS)]
#: Marks of example values.
EXAMPLE = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|0{6}|123456|abcdef"
#: Owners from which on a value counts as widely copied; least distinct characters of a live-looking value.
WIDE_OWNERS, LIVE_CHARACTERS = 3, 10
#: Parts that the rows of one value are dealt to.
SALTS = 16

PART = "struct<kind:int,at:int,gap:int,size:int,value:string>"


def _parts(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind in their order, as array<PART>: the length of what lies before each, its own, and its value, null if
    that has fewer than `least` characters."""
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    value = F.regexp_extract_all(text, regex, F.lit(group)) if group else whole
    pieces = F.arrays_zip(whole.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("gap"))
    parts = F.transform(
        F.slice(pieces, 1, F.size(whole)),  # one piece more than matches
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("size"),
            F.when(F.length(x["v"]) >= least, x["v"]).alias("value"),
        ),
    )
    return F.when(text.rlike(pattern), parts).otherwise(F.array().cast(f"array<{PART}>"))


def _spans(parts: DataFrame) -> DataFrame:
    """Rows of one match each to spans (kind, start, end, value) that are long enough, and of the added ones only those that look
    live and overlap no base span.

    Sums of lengths and the greatest end so far run over the sorted matches of a text, so a text's cost
    grows with its matches, not with their pairs; a window over a text spills.
    """
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(Window.partitionBy("row_id", "kind").orderBy("at"))
    base = F.col("kind") < len(BASE_KINDS)
    spans = (
        parts.repartition("row_id")  # both windows find the rows there
        .withColumn("end", end)
        .withColumn("start", F.col("end") - F.col("size"))
        .where(F.col("value").isNotNull() & (base | _live(F.col("value"))))
    )
    # a base span that overlaps begins before the added one ends, and ends after that one starts
    before = Window.partitionBy("row_id").orderBy(F.when(base, F.col("start")).otherwise(F.col("end")), base)
    reach = F.max(F.when(base, F.col("end"))).over(before)
    return spans.withColumn("reach", reach).where(base | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("reach")


def _live(value: Column) -> Column:
    mixed = value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")
    return mixed & ~value.rlike(EXAMPLE) & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def candidate_frequency(candidates: DataFrame) -> DataFrame:
    """Rows (hash, owner, repository) to distinct counts for each hash.

    Rows are first made distinct, so a value copied a million times within one
    repository is one row before it moves again.
    """
    owned = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("copies"))
    by_owner = owned.groupBy("hash", "owner").agg(
        F.count(F.lit(1)).alias("repositories"), F.sum("copies").alias("copies")
    )
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"),
        F.sum("repositories").alias("repositories"),
        F.sum("copies").alias("copies"),
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repository_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row for each row of `docs`: id, spans, and the ownership of each span.

    spans is an array of (start, kind, end, value, owners, repositories, class)
    in the order of start and kind, where class is widely_copied, owner_specific
    or shared, and base says whether a base pattern found it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("id"),
        F.col(owner_col).alias("owner"),
        F.to_json(F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(repository_cols)])).alias("repository"),
        F.concat(*[_parts(text, i, p, g, n) for i, (_, p, g, n) in enumerate((*BASE_KINDS, *ADDED_KINDS))]).alias("parts"),
    )
    scanned = written(scanned, "secret-scan")
    rows = _spans(scanned.select("row_id", "owner", "repository", F.explode("parts").alias("part")).select("row_id", "owner", "repository", "part.*"))
    rows = written(
        rows.select("row_id", "owner", "repository", F.struct("start", "kind", "end", "value").alias("span"), F.sha2("value", 256).alias("hash")),
        "secret-spans",
    )
    frequency = candidate_frequency(rows)
    salted = frequency.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row_id", "span.start"), F.lit(SALTS)).cast("int"))
    kind = (
        F.when(F.col("owners") >= WIDE_OWNERS, "widely_copied").when(F.col("owners") == 1, "owner_specific").otherwise("shared")
    )
    judged = (
        rows.join(salted, ["hash", "salt"])
        .withColumn("class", kind)
        .where((F.col("span.kind") < len(BASE_KINDS)) | (F.col("class") != "widely_copied"))
        .groupBy("row_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "span.start", "span.kind", "span.end", "span.value", "owners", "repositories", "class",
                        (F.col("span.kind") < len(BASE_KINDS)).alias("base"),
                    )
                )
            ).alias("spans")
        )
    )
    empty = F.array().cast(judged.schema["spans"].dataType)
    return scanned.select("row_id", "id").join(judged, "row_id", "left").select(
        F.col("id").alias(id_col), F.coalesce("spans", empty).alias("spans")
    )


def op2_secret_scans(docs: DataFrame) -> DataFrame:
    """Digest of the scan: one row for each document."""
    found = scan_secrets(docs)
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    of_class = lambda c: F.size(F.filter("spans", lambda s: s["class"] == c)).cast("long")
    return found.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        of_class("widely_copied").alias("n_widely_copied"),
        of_class("owner_specific").alias("n_owner_specific"),
    )
