"""Secret scans by corpus-wide ownership frequency (operator 7), in DataFrame operations only.

Each text is scanned where it is read; what leaves the scan are the lengths of matches and of the gaps between them, and
the candidate values. Places follow from a running sum over a text's matches. Candidates are known by their hash; a hash's
frequency is the number of repositories and owners that hold it, counted in two aggregations that both combine before they shuffle. A
candidate held by many owners is an example that was copied; one that few owners hold and that looks alive is theirs. The
frequency classifies all base candidates and decides which mixed strings without a keyword (kind `mixed`) are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, id_and_text, materialise, table

#: The kinds in their order; pattern, which group is the value, and how long it must be.
KINDS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so the shorter ones need not be matched first
    ("mixed", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
)
BASE = 3
#: A candidate of at most so many owners is theirs; one of more is a copied example.
MAX_OWNERS = 2
#: What no live credential holds.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|(.)\1{7}|01234567|abcdefgh"


def _matches(text: Column, kind: int) -> Column:
    """Gaps, lengths and values of a kind's leftmost matches that do not overlap; null if there is none."""
    _, pattern, group, _ = KINDS[kind]
    p = F.lit(pattern)
    found = F.struct(
        F.lit(kind).alias("kind"),
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length).alias("sizes"),
        F.regexp_extract_all(text, p, F.lit(group)).alias("values"),
    )
    return F.when(text.rlike(pattern), found)


def _places(scanned: DataFrame) -> DataFrame:
    """A row for each match that is long enough: row, kind, start, end, value, repo."""
    one = scanned.select("row", "repo", F.explode(F.filter("found", lambda x: x.isNotNull())).alias("m"))
    each = one.select("row", "repo", "m.kind", F.posexplode(F.expr("transform(m.sizes, (s, i) -> struct(m.gaps[i] as gap, s as size, m.values[i] as value))")).alias("pos", "x"))
    so_far = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.select("row", "repo", "kind", "x.value", F.col("x.size").cast("long").alias("size"), F.sum(F.col("x.gap") + F.col("x.size")).over(so_far).alias("end"))
    least = F.element_at(F.array(*(F.lit(k[3]) for k in KINDS)), F.col("kind") + 1)
    return placed.where(F.length("value") >= least).select("row", "repo", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates: hash, repo. (hash, n, repos, owners): the rows, repositories and owners of each hash. An owner is a repository's name up to the first slash."""
    held = candidates.groupBy("hash", "repo").agg(F.count("*").alias("n"))
    owned = held.withColumn("owner", F.substring_index("repo", "/", 1))
    return owned.groupBy("hash").agg(F.sum("n").alias("n"), F.count("*").alias("repos"), F.count_distinct("owner").alias("owners"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row for each row of docs: doc_id and `spans`, an array of (start, end, kind, base, repos, owners, owned, live), by start and kind.

    Places are code points, ends exclusive. owned: at most max_owners owners hold the value; live: owned, and not a
    placeholder. Base kinds are all there; `mixed` strings (upper and lower case and digits) only where they are live
    and in no base span. A null text is an empty text; a null repository is a repository of its own.
    """
    text = F.col("text")
    rows = id_and_text(docs, id_col, text_col, F.col(repo_col).cast("string").alias("repo"))
    row = F.monotonically_increasing_id()
    repo = F.coalesce("repo", F.concat(F.lit("\0"), row.cast("string")))
    scanned = rows.select(row.alias("row"), "doc_id", repo.alias("repo"), F.array(*(_matches(text, k) for k in range(len(KINDS)))).alias("found"))
    scanned = materialise(scanned, "secret-scan")
    some = scanned.where(F.exists("found", lambda x: x.isNotNull()))
    v = F.col("value")
    placed = _places(some).where((F.col("kind") < BASE) | (v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")))
    placed = materialise(placed.select("*", F.sha2(v, 256).alias("hash"), (~v.rlike(PLACEHOLDER)).alias("looks_live")).drop("value"), "candidates")
    known = materialise(ownership(placed), "ownership")
    judged = attach(placed, known, "hash", "n")
    # an added span lies in no base span: of those that begin no later, the furthest end is before its own
    so_far = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("kind") < BASE, F.col("end"))).over(so_far)
    owned = F.col("owners") <= max_owners
    judged = judged.select("*", owned.alias("owned"), (owned & F.col("looks_live")).alias("live"), reach.alias("reach"))
    judged = judged.where((F.col("kind") < BASE) | (F.col("live") & (F.col("reach").isNull() | (F.col("reach") < F.col("end")))))
    per_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "repos", "owners", "owned", "live"))).alias("spans"))
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    told = F.transform(F.coalesce("spans", F.array().cast(per_row.schema["spans"].dataType)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("kind"), (s["kind"] < BASE).alias("base"), s["repos"].alias("repos"), s["owners"].alias("owners"), s["owned"].alias("owned"), s["live"].alias("live")))
    return scanned.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", told.alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_live and n_copied of every document."""
    found = secrets(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    many = lambda keep: F.size(F.filter("spans", keep)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    return found.select(
        "doc_id",
        *(many(of_kind(k)).alias(f"n_{k}") for k, *_ in KINDS[:BASE]),
        F.sha2(told(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        many(lambda s: ~s["base"]).alias("n_added"),
        many(lambda s: s["live"]).alias("n_live"),
        many(lambda s: ~s["owned"]).alias("n_copied"),
    )
