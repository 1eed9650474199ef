"""What a saved passage or location shows today: current, moved, removed, or as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialize

HOPS = 3


def walk(starts: DataFrame, moves: DataFrame, stops: DataFrame, keys: list[str], hops: int = HOPS) -> DataFrame:
    """starts (id, keys...) plus the place reached after up to `hops` moves, `moved` and `reached`.

    moves: (old_<key>..., new_<key>..., kind), one for each old place at most; stops: (keys...),
    places that show something. A walk ends at the first stop behind its start, or where no move
    goes on. kind is the first move's. A cycle ends after the hops.
    """
    seen = stops.select(*keys).distinct().withColumn("_stop", F.lit(True))
    first = moves.groupBy(*[f"old_{k}" for k in keys]).agg(F.min(F.struct(*[f"new_{k}" for k in keys], "kind")).alias("_to"))
    now = starts.withColumn("moved", F.lit(0)).withColumn("reached", F.lit(False)).withColumn("kind", F.lit(None).cast("string"))
    for _ in range(hops):
        goes = first.select(*[F.col(f"old_{k}").alias(k) for k in keys], "_to")
        now = now.join(goes, keys, "left").withColumn("_on", ~F.col("reached") & F.col("_to").isNotNull())
        now = now.select(*[c for c in now.columns if c not in (*keys, "moved", "kind", "_to", "_on")], *[F.when(F.col("_on"), F.col(f"_to.new_{k}")).otherwise(F.col(k)).alias(k) for k in keys],
            (F.col("moved") + F.col("_on").cast("int")).alias("moved"), F.coalesce("kind", F.when(F.col("_on"), F.col("_to.kind"))).alias("kind"), "_on")
        now = now.join(seen, keys, "left").withColumn("reached", F.col("reached") | (F.col("_on") & F.coalesce("_stop", F.lit(False)))).drop("_stop", "_on")
    return now


def passage_status(asked: DataFrame, passages: DataFrame, documents: DataFrame, moves: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(id, status, target, target_document, kind, reason) of every asked (id) that has a row.

    passages: (id, document, retired); documents: (document, retired); moves: (entity, old_id,
    new_id, kind); tombstones: (entity, id, reason), entity `passage` or `document`. In this order:
    current, where neither is retired; moved, where moves lead to a current passage; removed, by
    the tombstone of the passage, of its document, or of the passage at which the moves end;
    moved with its retired document, or removed with the document at which that walk ends;
    else `kept`: shown as it was, for want of a record. Repeated ids are asked once.
    """
    rows = passages.join(documents.select("document", F.col("retired").alias("_gone")), "document", "left").select("id", "document", (F.col("retired") | F.coalesce("_gone", F.lit(False))).alias("old"), F.coalesce("_gone", F.lit(False)).alias("gone"))
    state = materialize(rows.join(asked.select("id").distinct(), "id", "left_semi"), "status-asked")
    of = lambda d, entity: d.filter(F.col("entity") == entity)
    named = lambda entity: of(moves, entity).select(F.col("old_id").alias("old_at"), F.col("new_id").alias("new_at"), "kind")
    pending = state.filter("old")
    way = walk(pending.select("id", F.col("id").alias("at")), named("passage"), rows.filter("NOT old").select(F.col("id").alias("at")), ["at"])
    stone = lambda entity, c: of(tombstones, entity).groupBy(F.col("id").alias(c)).agg(F.min("reason").alias(f"_{c}_reason"))
    out = state.join(way.select("id", "at", "moved", "reached", "kind"), "id", "left")
    out = out.join(stone("passage", "id"), "id", "left").join(stone("document", "document"), "document", "left").join(stone("passage", "at"), "at", "left")
    docs = pending.filter("gone").select("document").distinct().select(F.col("document").alias("id"), F.col("document").alias("doc_at"))
    named_docs = of(moves, "document").select(F.col("old_id").alias("old_doc_at"), F.col("new_id").alias("new_doc_at"), "kind")
    ways = walk(docs, named_docs, documents.filter("NOT retired").select(F.col("document").alias("doc_at")), ["doc_at"])
    ways = ways.join(stone("document", "doc_at"), "doc_at", "left").select(F.col("id").alias("document"), F.when(F.col("moved") > 0, F.col("doc_at")).alias("doc_at"), F.col("reached").alias("doc_reached"), F.col("kind").alias("doc_kind"), F.when(F.col("moved") > 0, F.col("_doc_at_reason")).alias("doc_reason"))
    out = out.join(ways, "document", "left")
    moved, reached = F.coalesce("moved", F.lit(0)) > 0, F.coalesce("reached", F.lit(False))
    reason = F.coalesce("_id_reason", "_document_reason", F.when(moved, F.col("_at_reason")))
    by_document = F.coalesce("doc_reached", F.lit(False))
    status = F.when(~F.col("old"), "current").when(reached, "moved").when(reason.isNotNull(), "removed").when(by_document, "moved").when(F.col("doc_reason").isNotNull(), "removed").otherwise("kept")
    here = F.col("old") & ~reached & reason.isNull() & by_document
    return out.select("id", status.alias("status"), F.when(F.col("old") & reached, F.col("at")).alias("target"), F.when(here, F.col("doc_at")).alias("target_document"),
        F.when(F.col("old") & reached, F.col("kind")).when(here, F.col("doc_kind")).alias("kind"), F.when(status == "removed", F.coalesce(reason, "doc_reason")).alias("reason"))


def location_status(asked: DataFrame, passages: DataFrame, documents: DataFrame, location_moves: DataFrame, moves: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(request, status, document, key, target, reason) of links into documents by anchor or chapter.

    asked: (request, entity, document, key), entity `anchor` or `chapter`; passages: (id, document,
    anchor, chapter, retired); location_moves: (entity, old_document, old_key, new_document,
    new_key, kind). A location that a visible passage carries is current. Else its moves are
    followed, across documents, to one that does; where they end elsewhere, or there are none, the
    retired passage there tells (passage_status): moved, removed or kept. A walk that ends at
    nothing known is `moved` to its end; without a walk it is `unknown`.
    """
    live = passages.join(documents.filter("retired").select("document"), "document", "left_anti").filter("NOT retired")
    places = lambda d: d.select("id", "document", F.explode(F.array(F.struct(F.lit("anchor").alias("entity"), F.col("anchor").cast("string").alias("key")), F.struct(F.lit("chapter").alias("entity"), F.col("chapter").cast("string").alias("key")))).alias("p")).select("id", "p.entity", "document", "p.key").filter("key IS NOT NULL")
    at = ["entity", "document", "key"]
    shown = places(live).select(*at).distinct()
    start = asked.select("request", "entity", "document", F.col("key").cast("string").alias("key"))
    current = start.join(shown, at, "left_semi")
    steps = location_moves.select(F.col("entity").alias("old_entity"), "old_document", F.col("old_key").cast("string").alias("old_key"), F.col("entity").alias("new_entity"), "new_document", F.col("new_key").cast("string").alias("new_key"), "kind")
    way = materialize(walk(start.join(shown, at, "left_anti"), steps, shown, at), "status-locations")
    # the last passage that was there, of those that are no longer shown
    gone = places(passages.join(live.select("id"), "id", "left_anti")).groupBy(*at).agg(F.max("id").alias("id"))
    ends = way.filter("NOT reached").join(gone, at, "left")
    told = passage_status(ends.filter("id IS NOT NULL").select("id"), passages, documents, moves, tombstones).select("id", "status", "target", "reason")
    ends = ends.join(told, "id", "left")
    status = F.coalesce("status", F.when(F.col("moved") > 0, "moved").otherwise("unknown"))
    none = F.lit(None)
    out = current.select("request", F.lit("current").alias("status"), "document", "key", none.cast("long").alias("target"), none.cast("string").alias("reason"))
    out = out.unionByName(way.filter("reached").select("request", F.lit("moved").alias("status"), "document", "key", none.cast("long").alias("target"), none.cast("string").alias("reason")))
    return out.unionByName(ends.select("request", status.alias("status"), "document", "key", "target", "reason"))


def restored(saved: DataFrame, status: DataFrame) -> DataFrame:
    """saved (search, rank, passage) with status, shown (the passage to show today) and reason; passages without a row fall out.

    Several saved rows may show one passage; the first of them stays, as a list shows it once.
    Removed ones stay, each by itself, so that a reader sees what is gone.
    """
    j = saved.join(status.select(F.col("id").alias("passage"), "status", F.coalesce("target", "id").alias("shown"), "target_document", "reason"), "passage")
    kept = j.filter("status <> 'removed'").groupBy("search", "shown").agg(F.min(F.struct("rank", "passage", "status", "target_document")).alias("r"))
    kept = kept.select("search", F.col("r.rank").alias("rank"), F.col("r.passage").alias("passage"), F.col("r.status").alias("status"), "shown", F.col("r.target_document").alias("target_document"), F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(j.filter("status = 'removed'").select("search", "rank", "passage", "status", F.lit(None).cast("long").alias("shown"), "target_document", "reason"))
