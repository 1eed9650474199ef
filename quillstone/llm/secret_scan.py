"""Secret scan: candidate spans, separated by how many repositories and owners hold the value.

Base kinds are `assign`, `access` and `hex`; the ownership method adds kind `bare`: long mixed
strings that few repositories hold. Widely copied strings (sample keys, fixtures) are labelled
`shared`, values that stay with one owner are labelled `live`. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import materialize

#: Fixed values of the contract, in the order in which ties are listed.
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "bare": r"[A-Za-z0-9_+/-]{24,}",
}
ORDER = {k: i for i, k in enumerate(PATTERNS)}
OPEN, CLOSE = "\ue000", "\ue001"


def _hits(text: Column) -> Column:
    """One pass that tells whether any kind can match."""
    return text.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9_+/-]{24}""")


def candidate_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, kind, start, end, value) of every candidate; offsets in code points.

    Matches are marked with private-use characters and the text is cut there, so that a running
    sum of piece lengths gives the offsets; only texts that can match take part.
    """
    safe = F.translate(F.col(text), OPEN + CLOSE, "??")
    found = docs.filter(_hits(F.col(text))).select(key, safe.alias("_t"))
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.split(F.regexp_replace("_t", p, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]").alias("parts"))
        for k, p in PATTERNS.items()
    ])
    parts = (
        found.select(key, F.explode(kinds).alias("k"))
        .filter(F.size("k.parts") > 1)
        .select(key, "k.kind", F.posexplode("k.parts").alias("at", "piece"))
        .select(key, "kind", "at", F.length("piece").alias("n"), F.when(F.col("at") % 2 == 1, F.col("piece")).alias("match"))
    )
    run = W.partitionBy(key, "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    spans = parts.withColumn("end", F.sum("n").over(run)).filter("match IS NOT NULL")
    secret = F.when(F.col("kind") == "assign", F.regexp_extract("match", PATTERNS["assign"], 2)).otherwise(F.col("match"))
    spans = spans.select(key, "kind", (F.col("end") - F.col("n")).alias("start"), "end", secret.alias("value"))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]")
    return spans.filter(F.when(F.col("kind") == "assign", F.length("value") >= 6).when(F.col("kind") == "bare", mixed).otherwise(True))


def ownership(spans: DataFrame, owners: DataFrame, key: str, max_repos: int, max_owners: int) -> DataFrame:
    """Rows (hash, n_repos, n_owners, live) for every distinct candidate value.

    Distinct (value, repository, owner) triples are counted before values are grouped, so a value
    that a third of all documents hold sends one partial count per task.
    """
    held = spans.select(key, F.sha2("value", 256).alias("hash")).join(owners, key)
    pairs = held.select("hash", "repo", "owner").distinct()
    repos = pairs.select("hash", "repo").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"))
    people = pairs.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    both = repos.join(people, "hash")
    return both.withColumn("live", (F.col("n_repos") <= max_repos) & (F.col("n_owners") <= max_owners))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", repo: str = "source", owner: str | None = None, max_repos: int = 2, max_owners: int = 3) -> DataFrame:
    """One row per input row, with its spans and their labels.

    docs: any table holding the named columns; other columns are ignored. owner: who holds the
    text; without one, the repository is the owner, so a value is shared only if several
    repositories hold it, however many of their texts do.
    A value is `live` if at most max_repos repositories and max_owners owners hold it.
    Null text: as empty, no spans. Null repository or owner: one value of its own.
    Repeated rows and doc_ids: each row has its own result. Empty table: no rows.
    Columns: doc_id, n_assign, n_access, n_hex (base counts), base_sha256, spans (all kinds),
    n_live, n_shared (long), live_spans.
    """
    who = F.col(owner or repo).cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("_rid"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(who, F.lit("")).alias("owner"), F.when(_hits(F.col(text)), F.col(text)).alias("_text"),
    )
    rows = materialize(rows, "secret-rows")
    spans = materialize(candidate_spans(rows, "_rid", "_text"), "secret-spans")
    owners = rows.filter("_text IS NOT NULL").select("_rid", "repo", "owner")
    known = ownership(spans, owners, "_rid", max_repos, max_owners).select("hash", "live")
    labelled = spans.withColumn("hash", F.sha2("value", 256)).join(known, "hash", "left")

    of = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])[F.col("kind")]
    one = F.struct("start", of.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("span"), "kind", "end", "live")
    perdoc = labelled.groupBy("_rid").agg(F.array_sort(F.collect_list(one)).alias("s"))
    base = F.filter("s", lambda x: x["kind"] != "bare")
    extra = F.filter("s", lambda x: (x["kind"] != "bare") | x["live"])
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["span"]), ",")
    n = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    perdoc = perdoc.select(
        "_rid", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        joined(base).alias("_base"), joined(extra).alias("spans"),
        F.size(F.filter(extra, lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter(extra, lambda x: ~x["live"])).cast("long").alias("n_shared"),
        joined(F.filter("s", lambda x: x["live"])).alias("live_spans"),
    )
    zero, none = F.lit(0).cast("long"), F.lit("")
    return rows.select("_rid", "doc_id").join(perdoc, "_rid", "left").select(
        "doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_assign", "n_access", "n_hex")],
        F.sha2(F.coalesce("_base", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_shared")], F.coalesce("live_spans", none).alias("live_spans"),
    )
