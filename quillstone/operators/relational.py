"""Relational building blocks that the serving and publishing steps share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def visible(df: DataFrame) -> DataFrame:
    """Rows that aren't retired; tables without retired_at hold visible rows only."""
    return df.filter("retired_at IS NULL") if "retired_at" in df.columns else df


def searchable(df: DataFrame) -> DataFrame:
    rows = visible(df)
    return rows.filter("searchable") if "searchable" in df.columns else rows


def point_lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def keep_floor(rows: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """Rows of at least `floor`, or the single best of a key where none reaches it."""
    w = W.partitionBy(*keys)
    best = F.row_number().over(w.orderBy(F.desc("score"), "item"))
    return rows.withColumn("_any", F.max(F.col("score") >= floor).over(w)).withColumn("_rn", best).filter((F.col("score") >= floor) | (~F.col("_any") & (F.col("_rn") == 1))).drop("_any", "_rn")


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None, n: int) -> DataFrame:
    """The next n rows in descending order behind the cursor, with has_more on each."""
    if after is not None:
        rows = rows.filter(F.struct(*order) < F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after, strict=True)]))
    page = rows.orderBy(*[F.desc(c) for c in order]).limit(n + 1)  # n + 1 rows at most from here on
    count = page.agg(F.count(F.lit(1)).alias("_n"))
    return page.orderBy(*[F.desc(c) for c in order]).limit(n).join(F.broadcast(count)).withColumn("has_more", F.col("_n") > n).drop("_n")


def changed_columns(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, changed): the names of the columns that differ, for keys on both sides with some change."""
    j = old.select(key, *[F.col(c).alias(f"o_{c}") for c in columns]).join(new.select(key, *[F.col(c).alias(f"n_{c}") for c in columns]), key)
    names = F.array_compact(F.array(*[F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.lit(c)) for c in columns]))
    return j.select(key, F.array_join(names, ",").alias("changed")).filter("changed <> ''")


def reconcile(rows: DataFrame, vectors: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, status, differs): unvectorised, orphan, drifted or in_sync. A blank never counts as a change."""
    j = rows.select(key, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(1).alias("_r")).join(vectors.select(key, *[F.col(c).alias(f"v_{c}") for c in columns], F.lit(1).alias("_v")), key, "full_outer")
    differ = lambda c: (F.trim(F.coalesce(F.col(f"r_{c}").cast("string"), F.lit(""))) != "") & ~F.col(f"r_{c}").eqNullSafe(F.col(f"v_{c}"))
    names = F.array_join(F.array_compact(F.array(*[F.when(differ(c), F.lit(c)) for c in columns])), ",")
    both = F.col("_r").isNotNull() & F.col("_v").isNotNull()
    status = F.when(F.col("_v").isNull(), "unvectorised").when(F.col("_r").isNull(), "orphan").when(names != "", "drifted").otherwise("in_sync")
    return j.select(key, status.alias("status"), F.when(both, names).otherwise("").alias("differs"))


def follow_redirects(saved: DataFrame, redirects: DataFrame, current: DataFrame, hops: int = 3) -> DataFrame:
    """saved(id) plus target and kind: up to `hops` redirects, stopping at a current row; the first hop names the kind."""
    r = redirects.select(F.col("old_id").alias("_o"), F.col("new_id").alias("_n"), F.col("kind").alias("_k"))
    live = current.select(F.col("id").alias("_c")).distinct()
    at = saved.withColumn("target", F.col("id")).withColumn("kind", F.lit(None).cast("string"))
    for hop in range(hops + 1):
        at = at.join(live, F.col("target") == F.col("_c"), "left").withColumn("is_current", F.col("_c").isNotNull()).drop("_c")
        if hop < hops:
            at = at.join(r, (F.col("target") == F.col("_o")) & ~F.col("is_current"), "left")
            at = at.withColumn("target", F.coalesce("_n", "target")).withColumn("kind", F.coalesce("kind", "_k")).drop("_o", "_n", "_k", "is_current")
    return at


def resolve(saved: DataFrame, redirects: DataFrame, current: DataFrame, tombstones: DataFrame) -> DataFrame:
    """saved(id) plus status: current, moved, removed or unknown, by that precedence."""
    at = follow_redirects(saved, redirects, current).join(tombstones.select(F.col("id").alias("_t")).distinct(), F.col("id") == F.col("_t"), "left")
    status = F.when(F.col("is_current") & (F.col("id") == F.col("target")), "current").when(F.col("is_current"), "moved").when(F.col("_t").isNotNull(), "removed").otherwise("unknown")
    return at.select("id", F.when(F.col("is_current"), F.col("target")).alias("target"), "kind", status.alias("status"))


def runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows plus run: 0.. for each stretch of equal neighbouring values within a key."""
    w = W.partitionBy(*keys).orderBy(order)
    new = (F.row_number().over(w) > 1) & ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return rows.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """For each key the values at index floor(p * n) (the last at most) of the sorted values.

    Ranks come from a window, so no key's values are gathered into an array.
    """
    w = W.partitionBy(*keys)
    r = rows.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return r.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n"))), F.col(value))).alias(a) for a, p in points.items()])


def vote(rows: DataFrame, key: str, choice: str, order: str) -> DataFrame:
    """(key, choice, votes, members, share): the commonest choice; ties go to the earliest."""
    counts = rows.groupBy(key, choice).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_first"))
    w = W.partitionBy(key)
    ranked = counts.withColumn("members", F.sum("votes").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc("votes"), "_first")))
    return ranked.filter("_rn = 1").select(key, choice, "votes", "members", F.round(F.col("votes") / F.col("members"), 4).alias("share"))


def upsert(live: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """live with incoming's rows put in place of those with the same key."""
    return live.join(incoming.select(*key), key, "left_anti").unionByName(incoming.select(*live.columns))


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, digest) that doesn't depend on row order: per-row hashes combined by exclusive or and sum."""
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", F.hex(F.bit_xor(h)), F.hex(F.sum(F.pmod(h, F.lit(1 << 31))))).alias("digest"))


def even_sample(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """At most n evenly spaced rows of each key."""
    w = W.partitionBy(*keys)
    r = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return r.filter((F.col("_n") <= n) | (F.floor(F.col("_i") * n / F.col("_n")) != F.floor((F.col("_i") - 1) * n / F.col("_n")))).drop("_i", "_n")


def hashed_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows chosen by a seeded hash: the same rows each time, whatever the partitioning."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def containing(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item: str) -> DataFrame:
    """(item_key, key) of items(item_key, item) whose text stands in a text of docs(key, text).

    The first and last word of an item may be glued to what stands around it in the document;
    what lies between are whole words. Items with four whole words inside meet documents by the
    hash of these, shorter ones by their longest inner word; those without one (a word or two)
    are compared with every text. Whole texts decide in each case.
    """
    ws = F.split(item, r"\s+")
    inner = F.slice(ws, 2, F.greatest(F.size(ws) - 2, F.lit(0)))
    asked = items.select(item_key, item, inner.alias("_in")).select(item_key, item, F.size("_in").alias("_n"), F.when(F.size("_in") >= 4, F.xxhash64(F.array_join(F.slice("_in", 1, 4), " ")))
        .otherwise(F.xxhash64(F.array_max(F.transform("_in", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])).alias("_h"))
    w = docs.select(key, F.split(text, r"\s+").alias("_w"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 3, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, 4), " ")))
    one = lambda hs, kind: w.select(key, F.explode_outer(F.array_distinct(hs)).alias("_h")).join(asked.filter(kind).select(item_key, "_h"), "_h").select(key, item_key)
    near = one(runs, "_n >= 4").union(one(F.transform("_w", lambda x: F.xxhash64(x)), "_n BETWEEN 1 AND 3")).distinct()
    full = near.join(docs.select(key, text), key).join(items.select(item_key, item), item_key)
    bare = asked.filter("_n = 0").select(item_key, item)
    found = full.filter(F.contains(text, F.col(item))).select(item_key, key)
    if bare.isEmpty():
        return found
    return found.union(docs.select(key, text).join(bare, F.contains(text, F.col(item))).select(item_key, key))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
