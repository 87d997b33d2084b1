"""Typed relations: validation, candidates, projections to work-to-work edges, listings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evgraph import schemas
from evgraph import taxonomy as tx
from evgraph.functions import text as tf
from evgraph.functions.geometry import box_of
from evgraph.operators.tables import paged, top_k

MIN_CONFIDENCE = 0.5
CITED, CITED_BY, SAME_PROJECT, RECENT = 0.55, 0.50, 0.2, 0.12


def member_work() -> Column:
    """Work a member stands for: its anchor, else the member itself when it is a work."""
    return F.coalesce("anchor_work_id", F.when(F.col("entity_kind") == "work", F.col("entity_id")))


def endpoints(members: DataFrame) -> DataFrame:
    """(relation_id, source_work_id, target_work_id) of relations whose ends stand for works."""
    end = lambda role: members.where(F.col("role") == role).select(
        "relation_id", member_work().alias(f"{role}_work_id")
    ).where(F.col(f"{role}_work_id").isNotNull())
    return end("source").join(end("target"), "relation_id")


# --- validation ---------------------------------------------------------------------------


def validate_relations(
    relations: DataFrame, members: DataFrame, owners: dict[str, DataFrame]
) -> DataFrame:
    """(relation_id, reasons): what is wrong with a relation, an empty array when nothing is.

    `owners`: entity kind -> (entity_id, work_id); works own themselves, datasets and persons have
    no owner.
    """
    entities = None
    for kind, df in owners.items():
        rows = df.select(F.lit(kind).alias("entity_kind"), "entity_id", F.col("work_id").alias("_owner"), F.lit(True).alias("_found"))
        entities = rows if entities is None else entities.unionByName(rows)
    works = owners["work"].select(F.col("entity_id").alias("anchor_work_id"), F.lit(True).alias("_anchor_found"))
    ownerless = F.col("entity_kind").isin("dataset", "person")
    checked = members.join(entities, ["entity_kind", "entity_id"], "left").join(works, "anchor_work_id", "left")
    unknown = F.col("_found").isNull() | (~ownerless & F.col("_owner").isNull())
    lost_anchor = F.col("anchor_work_id").isNotNull() & F.col("_anchor_found").isNull()
    foreign = F.col("anchor_work_id").isNotNull() & (F.col("anchor_work_id") != F.col("_owner"))
    side = lambda role: F.struct(
        F.min(F.when(F.col("role") == role, F.struct("entity_kind", "entity_id"))).alias("e")
    )
    shape = checked.groupBy("relation_id").agg(
        F.count_if(F.col("role") == "source").alias("_sources"),
        F.count_if(F.col("role") == "target").alias("_targets"),
        side("source").alias("_source"),
        side("target").alias("_target"),
        F.bool_or(unknown).alias("_unknown"),
        F.bool_or(lost_anchor).alias("_lost"),
        F.bool_or(F.coalesce(foreign, F.lit(False))).alias("_foreign"),
    )
    conf = F.col("confidence")
    bad_shape = (F.coalesce("_sources", F.lit(0)) != 1) | (F.coalesce("_targets", F.lit(0)) != 1)
    reason = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    return relations.join(shape, "relation_id", "left").select(
        "relation_id",
        F.array_compact(
            F.array(
                reason(bad_shape, "needs one source and one target"),
                reason(~bad_shape & (F.col("_source.e") == F.col("_target.e")), "source equals target"),
                reason(F.isnan(conf) | (conf < 0) | (conf > 1), "confidence outside 0..1"),
                reason(F.col("_unknown"), "unknown member"),
                reason(F.col("_lost"), "unknown anchor"),
                reason(F.col("_foreign"), "anchor does not own member"),
            )
        ).alias("reasons"),
    )


def validate_evidence(evidence: DataFrame, versions: DataFrame, lowest_page: int = 1) -> DataFrame:
    """(evidence_id, reasons). Pair proposals quote abstracts and pass lowest_page=0."""
    known = versions.select("version_id", F.lit(True).alias("_known"))
    bound = F.coalesce(F.col("relation_id").cast("string"), F.col("claim_id").cast("string"), "extraction_field")
    reason = lambda cond, name: F.when(F.coalesce(cond, F.lit(True)), F.lit(name))
    return evidence.join(known, "version_id", "left").select(
        "evidence_id",
        F.array_compact(
            F.array(
                reason(bound.isNull(), "not bound"),
                reason(F.col("page") < lowest_page, "page too low"),
                reason(tf.strip(F.col("text")) == "", "blank text"),
                reason(F.col("_known").isNull(), "unknown version"),
            )
        ).alias("reasons"),
    )


# --- candidates from model output -----------------------------------------------------------


def not_yet_related(candidates: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """Candidates (type, source_work_id, target_work_id, …) without a non-rejected relation between these ends."""
    end = lambda role: members.where(F.col("role") == role).select(
        "relation_id", F.col("entity_id").alias(f"{role}_work_id"))
    existing = (
        relations.where("review_status <> 'rejected'").select("relation_id", "type")
        .join(end("source"), "relation_id").join(end("target"), "relation_id")
    )
    key = ["type", "source_work_id", "target_work_id"]
    return candidates.join(existing.select(*key), key, "left_anti")


def first_per_relation(candidates: DataFrame, order: list[str]) -> DataFrame:
    """One candidate per (type, source, target): the first one makes the relation, later ones find it."""
    key = ["type", "source_work_id", "target_work_id"]
    rest = [c for c in candidates.columns if c not in key]
    winner = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return candidates.groupBy(*key).agg(winner).select(*key, "_row.*").select(*candidates.columns)


def context_candidates(
    outputs: DataFrame, contexts: DataFrame, resolved: DataFrame, relations: DataFrame, members: DataFrame
) -> DataFrame:
    """Relations proposed from citation contexts.

    `outputs`: work_id, version_id, batch, raw (JSON with `classifications`). `contexts`: work_id, batch, context_id,
    target, text, page, bbox. `resolved`: work_id, target, resolved_work_id. A reply may only name contexts of its
    own batch; of several items for one relation the first of the first batch counts.
    """
    parsed = F.from_json(tf.lenient_json(F.col("raw")), schemas.CONTEXT_JSON)
    item = F.col("item")
    proposed = outputs.select("work_id", "version_id", "batch", F.posexplode(parsed["classifications"]).alias("item_no", "item"))
    typed = proposed.select(
        "work_id", "version_id", "batch", "item_no", item["context_id"].alias("context_id"),
        tx.proposable_type(item["type"]).alias("type"),
        F.coalesce(item["confidence"], F.lit(0.0)).alias("confidence"),
        tf.blank_to_null(item["aspect"]).alias("aspect"),
        F.coalesce(item["explanation"], F.lit("")).alias("explanation"),
        tf.blank_to_null(item["evidence_text"]).alias("quote"),
    ).where(F.col("type").isNotNull() & (F.col("confidence") >= MIN_CONFIDENCE))
    targets = resolved.where("resolved_work_id IS NOT NULL").select("work_id", "target", "resolved_work_id")
    found = (
        typed.join(contexts, ["work_id", "batch", "context_id"])
        .join(targets, ["work_id", "target"])
        .withColumn("evidence_text", F.coalesce("quote", "text"))
        .where((F.col("resolved_work_id") != F.col("work_id")) & (tf.strip(F.col("evidence_text")) != ""))
        .select(
            "type", F.col("work_id").alias("source_work_id"), F.col("resolved_work_id").alias("target_work_id"),
            "confidence", "aspect", "explanation", "version_id", "evidence_text",
            F.when(F.col("page") > 0, F.col("page")).otherwise(1).alias("page"), "bbox", "batch", "item_no")
    )
    return first_per_relation(not_yet_related(found, relations, members), ["batch", "item_no"])


def pair_candidates(outputs: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """Relations proposed by comparing paper A with paper B.

    `outputs`: a_work_id, a_version_id, b_work_id, b_version_id, raw (JSON with `relations`). The quote
    comes from an abstract, so its page is 0.
    """
    parsed = F.from_json(tf.lenient_json(F.col("raw")), schemas.PAIR_JSON)
    item = F.col("item")
    ends = ["a_work_id", "a_version_id", "b_work_id", "b_version_id"]
    src = F.coalesce(item["source_paper"], F.lit("A"))
    tgt = F.coalesce(item["target_paper"], F.lit("B"))
    forward = (src == "A") & (tgt == "B")
    backward = (src == "B") & (tgt == "A")
    from_side = F.coalesce(item["evidence_from"], src)
    found = outputs.select(*ends, F.posexplode(parsed["relations"]).alias("item_no", "item")).select(
        tx.proposable_type(item["type"]).alias("type"),
        F.when(forward, F.col("a_work_id")).when(backward, F.col("b_work_id")).alias("source_work_id"),
        F.when(forward, F.col("b_work_id")).when(backward, F.col("a_work_id")).alias("target_work_id"),
        F.coalesce(item["confidence"], F.lit(0.0)).alias("confidence"),
        tf.blank_to_null(item["aspect"]).alias("aspect"),
        F.coalesce(item["explanation"], F.lit("")).alias("explanation"),
        F.when(from_side == "A", F.col("a_version_id")).otherwise(F.col("b_version_id")).alias("version_id"),
        item["evidence_quote"].alias("evidence_text"),
        F.lit(0).alias("page"),
        "item_no", "a_work_id", "b_work_id",
    )
    usable = found.where(
        F.col("type").isNotNull()
        & (F.col("confidence") >= MIN_CONFIDENCE)
        & (F.col("source_work_id") != F.col("target_work_id"))
        & (tf.strip(F.coalesce("evidence_text", F.lit(""))) != "")
    )
    fresh = not_yet_related(usable, relations, members)
    return first_per_relation(fresh, ["a_work_id", "b_work_id", "item_no"]).drop("a_work_id", "b_work_id")


def recall_candidates(
    works: DataFrame, neighbors: DataFrame, citations: DataFrame, work_projects: DataFrame,
    relations: DataFrame, members: DataFrame, k: int = 10, near: int = 32, recent: int = 48,
    order: str = "created_at",
) -> DataFrame:
    """Works worth comparing with each work: (work_id, neighbor_work_id, score), best k per work.

    The highest of: neighbour score (top 32), cites 0.55, cited by 0.50, same project 0.2 (32 smallest
    ids), one of the 48 latest works 0.12. Works already related are left out.
    """
    pair = ["work_id", "neighbor_work_id"]
    near_best = neighbors.where(F.col("dimension").isin(tx.GRAPH_DIMENSIONS)).groupBy(*pair).agg(F.max("score").alias("score"))
    by_neighbor = top_k(near_best, ["work_id"], [F.desc("score"), F.asc("neighbor_work_id")], near)
    cites = citations.where("cited_work_id IS NOT NULL AND citing_work_id <> cited_work_id")
    by_cites = cites.select(
        F.inline(F.array(
            F.struct(F.col("citing_work_id").alias("work_id"), F.col("cited_work_id").alias("neighbor_work_id"),
                     F.lit(CITED).alias("score")),
            F.struct(F.col("cited_work_id").alias("work_id"), F.col("citing_work_id").alias("neighbor_work_id"),
                     F.lit(CITED_BY).alias("score")))))
    # one extra member per project: a work is not its own partner
    head = top_k(work_projects, ["project_id"], [F.asc("work_id")], near + 1).withColumnRenamed("work_id", "neighbor_work_id")
    partners = work_projects.join(head, "project_id").where("work_id <> neighbor_work_id").select(*pair).distinct()
    by_project = top_k(partners, ["work_id"], [F.asc("neighbor_work_id")], near).withColumn("score", F.lit(SAME_PROJECT))
    related = _related_works(relations, members)
    scored = (
        by_neighbor.unionByName(by_cites).unionByName(by_project)
        .groupBy(*pair).agg(F.max("score").alias("score"))
        .join(related, pair, "left_anti")
    )
    best = top_k(scored, ["work_id"], [F.desc("score"), F.asc("neighbor_work_id")], k)

    # The latest works are one short list shared by all; what must be left out of it is at most as long.
    latest = works.orderBy(F.desc(order), F.desc("work_id")).limit(recent + 1).select("work_id", order)
    newest_first = F.reverse(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("work_id").alias("w")))))
    shared = latest.agg(newest_first.alias("l")).select(F.transform("l", lambda s: s["w"])).scalar()
    skip = (
        related.join(latest.select(F.col("work_id").alias("neighbor_work_id")), "neighbor_work_id", "left_semi")
        .groupBy("work_id").agg(F.collect_set("neighbor_work_id").alias("_skip"))
    )
    own = best.groupBy("work_id").agg(F.collect_list(F.struct("score", "neighbor_work_id")).alias("_own"))
    none = lambda like: F.array().cast(like)
    id_type = works.schema["work_id"].dataType.simpleString()
    wid = F.col("work_id")
    joined = (
        works.select("work_id", shared.alias("_latest")).join(own, "work_id", "left").join(skip, "work_id", "left")
    )
    window = F.slice(F.filter("_latest", lambda w: w != wid), 1, recent)
    offered = F.filter(window, lambda w: ~F.array_contains(F.coalesce("_skip", none(f"array<{id_type}>")), w))
    listed = F.coalesce("_own", none(f"array<struct<score:double,neighbor_work_id:{id_type}>>"))
    strong = F.filter(listed, lambda s: ~(F.array_contains(offered, s["neighbor_work_id"]) & (s["score"] < RECENT)))
    strong_ids = F.transform(strong, lambda s: s["neighbor_work_id"])
    filler = F.transform(
        F.array_except(offered, strong_ids), lambda w: F.struct(F.lit(RECENT).alias("score"), w.alias("neighbor_work_id"))
    )
    everyone = F.concat(strong, filler)
    ranked = F.transform(
        F.array_sort(F.transform(everyone, lambda s: F.struct((-s["score"]).alias("n"), s["neighbor_work_id"].alias("neighbor_work_id")))),
        lambda s: F.struct(s["neighbor_work_id"].alias("neighbor_work_id"), (-s["n"]).alias("score")),
    )
    return joined.select("work_id", F.inline(F.slice(ranked, 1, k)))


def _related_works(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Ordered pairs of works that are members of one non-rejected semantic relation."""
    live = relations.where(
        (F.col("review_status") != "rejected") & ~F.col("type").isin(tx.NOT_PROPOSABLE)
    ).select("relation_id")
    m = members.where("entity_kind = 'work'").join(live, "relation_id", "left_semi")
    a = m.select("relation_id", F.col("entity_id").alias("work_id"))
    b = m.select("relation_id", F.col("entity_id").alias("neighbor_work_id"))
    return a.join(b, "relation_id").where("work_id <> neighbor_work_id").select("work_id", "neighbor_work_id").distinct()


# --- projections ----------------------------------------------------------------------------


def review_counts(reviews: DataFrame) -> DataFrame:
    return (
        reviews.where("subject_kind = 'relation'")
        .groupBy(F.col("subject_id").alias("relation_id"))
        .agg(F.count("*").alias("review_count"))
    )


def in_graph(df: DataFrame, graph_works: DataFrame, *columns: str) -> DataFrame:
    """Rows whose work columns all belong to the graph."""
    ids = graph_works.select("work_id")
    for c in columns:
        df = df.join(ids.select(F.col("work_id").alias(c)), c, "left_semi")
    return df


def assertion_edges(
    relations: DataFrame, members: DataFrame, reviews: DataFrame, graph_works: DataFrame | None = None
) -> DataFrame:
    """Drawable work-to-work edges with their number of votes, optionally inside one graph."""
    edges = (
        relations.where(tx.is_drawable(F.col("type"), F.col("review_status")))
        .join(endpoints(members), "relation_id")
        .where("source_work_id <> target_work_id")
    )
    if graph_works is not None:
        edges = in_graph(edges, graph_works, "source_work_id", "target_work_id")
    return edges.join(review_counts(reviews), "relation_id", "left").select(
        "relation_id", "source_work_id", "target_work_id", F.col("type").alias("relation_type"), "review_status",
        F.col("source").alias("source_layer"), "confidence", "explanation",
        F.coalesce("review_count", F.lit(0).cast("long")).alias("review_count"))


def graph_edges(edges: DataFrame, graph_works: DataFrame) -> DataFrame:
    """(graph_id, edge …) for every graph that holds both ends."""
    at = lambda c: graph_works.select("graph_id", F.col("work_id").alias(c))
    return edges.join(at("source_work_id"), "source_work_id").join(at("target_work_id"), ["graph_id", "target_work_id"])


def reader_counts(reading: DataFrame) -> DataFrame:
    return reading.where("status <> 'unread'").groupBy("work_id").agg(F.count("*").alias("readers"))


def map_nodes(
    works: DataFrame, versions: DataFrame, reading: DataFrame, relations: DataFrame, members: DataFrame,
    graph_works: DataFrame | None = None, order: str = "created_at",
) -> DataFrame:
    """Works with title, year, readers and whether a relation anchored on them is disputed."""
    scope = works if graph_works is None else works.join(graph_works.select("work_id"), "work_id", "left_semi")
    primary = versions.select(F.col("version_id").alias("primary_version_id"), "title", "year")
    disputed = (
        members.where("anchor_work_id IS NOT NULL")
        .join(relations.where("review_status = 'disputed'").select("relation_id"), "relation_id", "left_semi")
        .select(F.col("anchor_work_id").alias("work_id"), F.lit(True).alias("_disputed"))
        .distinct()
    )
    return (
        scope.join(primary, "primary_version_id", "left")
        .join(reader_counts(reading), "work_id", "left")
        .join(disputed, "work_id", "left")
        .select(
            "work_id", tf.display_title(F.col("title"), F.col("title_norm")).alias("title"), "year",
            F.coalesce("readers", F.lit(0).cast("long")).alias("readers"),
            F.coalesce("_disputed", F.lit(False)).alias("has_dispute"), F.col(order).alias(order),
        )
    )


def neighbor_lists(neighbors: DataFrame, graph_works: DataFrame | None = None) -> DataFrame:
    """(dimension, work_id, entries): neighbours of a work, best first. Lists are trimmed, hence short.

    With `graph_works` there is a list for each graph that holds the work, of those neighbours that it holds too.
    """
    rows, key = neighbors, ["dimension", "work_id"]
    if graph_works is not None:
        held = graph_works.select("graph_id", "work_id").distinct()
        rows = rows.join(held, "work_id").join(held.withColumnRenamed("work_id", "neighbor_work_id"), ["graph_id", "neighbor_work_id"])
        key = ["graph_id", *key]
    entry = F.struct((-F.col("score")).alias("n"), "neighbor_work_id")
    return rows.groupBy(*key).agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda s: F.struct(s["neighbor_work_id"].alias("neighbor_work_id"), (-s["n"]).alias("score")),
        ).alias("entries")
    )


def visible_edges(edges: DataFrame, show_unreviewed: bool = False) -> DataFrame:
    shown = edges.where(tx.is_drawable(F.col("relation_type"), F.col("review_status")))
    return shown if show_unreviewed else shown.where("review_status <> 'unreviewed'")


def bundle_keys(edges: DataFrame) -> DataFrame:
    """Edges with the bundle they belong to: ordered pair and semantic group, unordered for alternatives."""
    both_ways = F.col("relation_type") == "alternative_to"
    a, b = F.col("source_work_id"), F.col("target_work_id")
    return edges.select(
        "*",
        both_ways.alias("symmetric"),
        F.when(both_ways, F.least(a, b)).otherwise(a).alias("bundle_source"),
        F.when(both_ways, F.greatest(a, b)).otherwise(b).alias("bundle_target"),
        tx.semantic_group(F.col("relation_type")).alias("semantic_group"),
    )


BUNDLE = ["symmetric", "bundle_source", "bundle_target", "semantic_group"]


def bundle_edges(edges: DataFrame, per_pair: int = 3) -> DataFrame:
    """Bundles of a pair with size, worst status and highest vote count, at most three per pair.

    Which relations form a bundle is a join of `bundle_keys` on BUNDLE, so a pair with very many
    relations needs no long list.
    """
    rank = tx.status_rank(F.col("review_status"))
    bundles = bundle_keys(edges).groupBy(*BUNDLE).agg(
        F.count("*").alias("count"),
        F.max("review_count").alias("review_count"),
        F.max_by("review_status", F.struct(rank, "review_status")).alias("status"),
        F.min("relation_type").alias("_type"),
    )
    label = F.when(F.col("count") == 1, F.replace("_type", F.lit("_"), F.lit(" "))).otherwise(
        F.concat("semantic_group", F.lit(" ×"), F.col("count"))
    )
    order = [F.desc("count"), F.desc(tx.status_rank(F.col("status"))), F.asc("semantic_group")]
    return top_k(bundles.withColumn("label", label).drop("_type"), BUNDLE[:3], order, per_pair)


def patch_relations(relations: DataFrame, members: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`patches`: relation_id, new_type, new_aspect, new_explanation, swap (ends change roles)."""
    fields = {"type": "new_type", "aspect": "new_aspect", "explanation": "new_explanation"}
    joined = relations.join(patches.drop("swap"), "relation_id", "left")
    patched = joined.select(
        *[F.coalesce(fields[c], c).alias(c) if c in fields else F.col(c) for c in relations.columns]
    )
    swapped = F.when(F.col("role") == "source", "target").when(F.col("role") == "target", "source")
    turned = members.join(patches.where("swap").select("relation_id", F.lit(True).alias("_swap")), "relation_id", "left")
    role = F.when(F.col("_swap"), swapped.otherwise(F.col("role"))).otherwise(F.col("role"))
    return patched, turned.withColumn("role", role).select(*members.columns)


# --- listings -------------------------------------------------------------------------------


def review_queue(
    relations: DataFrame, members: DataFrame | None = None, work_id=None, only_unreviewed: bool = True,
    limit: int | None = 50, offset: int = 0, worth: bool = True,
) -> DataFrame:
    """AI candidates waiting for a vote: for one work or for all, unreviewed only or any status.

    The page size is 50 by default and 200 at most; limit=None gives the whole queue, unsorted. The queue of all
    works holds only what is `worth` a vote (confident or high-risk, no citations); that of one work holds everything.
    """
    queue = relations.where("source = 'ai_candidate'")
    if only_unreviewed:
        queue = queue.where("review_status = 'unreviewed'")
    if work_id is not None:
        anchored = members.where(F.col("anchor_work_id") == F.lit(work_id)).select("relation_id")
        queue = queue.join(anchored, "relation_id", "left_semi")
        order = [F.asc("relation_id")]
    elif not worth:
        order = [F.asc("relation_id")]
    elif only_unreviewed:
        worth_it = (F.coalesce("confidence", F.lit(0.0)) >= 0.75) | tx.is_high_risk(F.col("type"))
        queue = queue.where(~F.col("type").isin(tx.NOT_PROPOSABLE) & worth_it)
        order = [F.desc_nulls_last("confidence"), F.asc("created_at"), F.asc("relation_id")]
    else:
        queue = queue.where("type <> 'cites'")
        order = [F.desc("created_at"), F.desc("relation_id")]
    return queue if limit is None else paged(queue, order, min(limit, 200) if limit > 0 else 50, offset)


def review_queues(relations: DataFrame, members: DataFrame, only_unreviewed: bool = True) -> DataFrame:
    """(work_id, relation …): the AI candidates anchored on each work, as review_queue lists them for one."""
    anchored = members.where("anchor_work_id IS NOT NULL").select("relation_id", F.col("anchor_work_id").alias("work_id")).distinct()
    return anchored.join(review_queue(relations, only_unreviewed=only_unreviewed, limit=None, worth=False), "relation_id")


def relations_of_works(relations: DataFrame, members: DataFrame) -> DataFrame:
    """(work_id, relation …) for every work a relation is anchored on or names, citations left out.

    Sort by `listing_order()` to read them as on a card.
    """
    touched = members.select(
        "relation_id",
        F.explode(
            F.array_distinct(
                F.array_compact(F.array("anchor_work_id", F.when(F.col("entity_kind") == "work", F.col("entity_id"))))
            )
        ).alias("work_id"),
    ).distinct()
    return touched.join(relations.where("type <> 'cites'"), "relation_id")


def listing_order() -> list[Column]:
    return [
        F.asc(tx.listing_rank(F.col("review_status"))),
        F.asc("type"),
        F.desc("created_at"),
        F.asc("relation_id"),
    ]


def card_groups(listed: DataFrame, members: DataFrame) -> DataFrame:
    """Adds the role of the work and the display group to rows of `relations_of_works`."""
    named = members.select(
        "relation_id", "role", "position",
        F.explode(F.array_distinct(F.array_compact(F.array("entity_id", "anchor_work_id")))).alias("work_id"))
    first = named.groupBy("relation_id", "work_id").agg(F.min_by("role", F.struct("position", "role")).alias("role"))
    t, role = F.col("type"), F.col("role")
    group = (
        F.when(t == "prerequisite_for", "prerequisite")
        .when((t == "improves_on") & (role == "target"), "improves_in")
        .when(t == "improves_on", "improves_out")
        .when(t.isin("reproduces", "fails_to_reproduce"), "reproduce")
        .when(t == "contradicts_claim", "conflict")
        .when(t.isin("uses_method_from", "alternative_to"), "method")
        .otherwise("other")
    )
    return listed.join(first, ["relation_id", "work_id"], "left").withColumn("card_group", group)


def graph_page(
    nodes: DataFrame, edges: DataFrame, neighbors: DataFrame, comments: DataFrame, limit: int = 500,
    offset: int = 0, order: str = "created_at",
) -> dict[str, DataFrame]:
    """A page of nodes of one graph, what connects them, and where the next page starts.

    `nodes`, `edges`, `neighbors` and `comments` are already limited to the graph and viewer.
    """
    limit = max(1, min(limit, 2000))
    page = paged(nodes, [F.asc(order), F.asc("work_id")], limit, offset)
    ids = page.select("work_id")
    total = nodes.agg(F.count("*").alias("total_nodes"))
    start = F.least(F.lit(offset).cast("long"), F.col("total_nodes"))
    end = F.least(start + limit, F.col("total_nodes"))
    meta = total.select(
        "total_nodes", start.alias("offset"), F.when(end < F.col("total_nodes"), end).alias("next_offset"),
        (end < F.col("total_nodes")).alias("truncated"))
    return {
        "meta": meta,
        "nodes": page,
        "edges": in_graph(edges, ids, "source_work_id", "target_work_id"),
        "neighbors": in_graph(neighbors, ids, "work_id", "neighbor_work_id"),
        "comment_counts": in_graph(comments, ids, "work_id").groupBy("work_id").agg(F.count("*").alias("comments")),
    }


def node_relations(
    relations: DataFrame, members: DataFrame, citations: DataFrame, neighbors: DataFrame, graph_works: DataFrame,
    direction: str = "both", types: list[str] | None = None,
) -> DataFrame:
    """Everything connected with every node of every graph, as rows of one table.

    (graph_id, work_id, kind, detail, direction, neighbor_work_id, ref, score): kind assertion (detail = type, ref =
    relation; neighbor_work_id null for the relation itself, plus one row per other work), citation, neighbor.
    """
    if direction not in ("both", "incoming", "outgoing"):
        raise ValueError("direction must be both, incoming or outgoing")
    at = graph_works.select("graph_id", "work_id")
    at_other = graph_works.select("graph_id", F.col("work_id").alias("neighbor_work_id"))

    def keep(df):
        return df if direction == "both" else df.where(F.col("direction") == direction)

    listed = relations_of_works(relations, members).select("relation_id", "work_id", F.col("type").alias("detail"))
    if types is not None:
        listed = listed.where(F.col("detail").isin([t.lower() for t in types]))
    stands = members.select("relation_id", "role", "position", member_work().alias("stand")).where("stand IS NOT NULL")
    by_role = members.select("relation_id", "role", "position", member_work().alias("stand")).groupBy("relation_id").agg(
        F.min_by("stand", F.when(F.col("role") == "source", F.col("position"))).alias("source_work_id"),
        F.min_by("stand", F.when(F.col("role") == "target", F.col("position"))).alias("target_work_id"),
    )
    way = F.when(F.col("source_work_id") == F.col("work_id"), "outgoing").when(
        F.col("target_work_id") == F.col("work_id"), "incoming"
    )
    directed = keep(listed.join(by_role, "relation_id").withColumn("direction", way.otherwise("involving")))
    # a relation is shown in a graph that holds every work it stands for
    n_works = stands.select("relation_id", "stand").distinct()
    inside = (
        n_works.join(graph_works.select("graph_id", F.col("work_id").alias("stand")), "stand")
        .groupBy("graph_id", "relation_id").agg(F.count("*").alias("_in"))
        .join(n_works.groupBy("relation_id").agg(F.count("*").alias("_all")), "relation_id")
        .where("_in = _all").select("graph_id", "relation_id")
    )
    shown = directed.join(inside, "relation_id").join(at, ["graph_id", "work_id"], "left_semi")
    others = shown.join(n_works, "relation_id").where("stand <> work_id")
    row = lambda df, kind, other, ref, score: df.select(
        "graph_id", "work_id", F.lit(kind).alias("kind"), "detail", "direction", other.alias("neighbor_work_id"),
        ref.cast("string").alias("ref"), score.cast("double").alias("score"))
    id_type = graph_works.schema["work_id"].dataType.simpleString()
    nil = F.lit(None)
    assertions = row(shown, "assertion", nil.cast(id_type), F.col("relation_id"), nil).unionByName(
        row(others, "related", F.col("stand"), F.col("relation_id"), nil)
    )

    cites = citations.where("cited_work_id IS NOT NULL").select(
        F.col("citation_id").alias("ref"),
        F.inline(F.array(
            F.struct(F.col("citing_work_id").alias("work_id"), F.col("cited_work_id").alias("neighbor_work_id"),
                     F.lit("outgoing").alias("direction")),
            F.struct(F.col("cited_work_id").alias("work_id"), F.col("citing_work_id").alias("neighbor_work_id"),
                     F.lit("incoming").alias("direction")))))
    cited = keep(cites).withColumn("detail", F.lit("cites")).join(at, "work_id").join(at_other, ["graph_id", "neighbor_work_id"])

    near = neighbors.select(
        F.col("dimension").alias("detail"),
        F.inline(F.array(
            F.struct("work_id", "neighbor_work_id", "score"),
            F.struct(F.col("neighbor_work_id").alias("work_id"), F.col("work_id").alias("neighbor_work_id"), "score"))),
    ).groupBy("detail", "work_id", "neighbor_work_id").agg(F.max("score").alias("score"))
    near = near.withColumn("direction", F.lit("both")).join(at, "work_id").join(at_other, ["graph_id", "neighbor_work_id"])
    return (
        assertions
        .unionByName(row(cited, "citation", F.col("neighbor_work_id"), F.col("ref"), nil))
        .unionByName(row(near, "neighbor", F.col("neighbor_work_id"), nil, F.col("score")))
    )


def related_titles(rows: DataFrame, works: DataFrame, versions: DataFrame) -> DataFrame:
    """(graph_id, work_id, neighbor_work_id, title, year): every other work that `node_relations` names at a node, once."""
    named = rows.where("neighbor_work_id IS NOT NULL").select("graph_id", "work_id", "neighbor_work_id").distinct()
    primary = versions.select(F.col("version_id").alias("primary_version_id"), F.col("title").alias("_title"), "year")
    titled = works.join(primary, "primary_version_id", "left").select(
        F.col("work_id").alias("neighbor_work_id"), tf.display_title(F.col("_title"), F.col("title_norm")).alias("title"), "year")
    return named.join(titled, "neighbor_work_id").select("graph_id", "work_id", "neighbor_work_id", "title", "year")


# --- prompts and grounding ------------------------------------------------------------------

# Wording of the prompts, characters of an abstract and contexts in one of them.
PAIR_LEAD = "Compare paper A and paper B. Propose whitelist relations if any.\n\n"
PAIR_SIDE, PAIR_PARTS = "### Paper {}\n", ("title: ", "\nabstract: ", "\nmethods:\n", "\nclaims:\n", "\n")
NO_BULLETS = "(none extracted)"
CONTEXT_LEAD = ("Citing paper title: ", "\n\nClassify each citation context below.\n\n")
CONTEXT_PARTS = ("### context_id=", "\npage=", "\ncited_title=", "\ncontext:\n", "\n\n")
NO_TITLE = "(unknown)"
ABSTRACT_CHARS, CONTEXTS_AT_ONCE = 1500, 12


def pair_briefs(pairs: DataFrame, papers: DataFrame, abstract_chars: int | None = ABSTRACT_CHARS) -> DataFrame:
    """Comparison prompt of (a_work_id, b_work_id).

    `papers`: work_id, title, abstract, methods array<struct<name,description>>, claims array<string>. Of an abstract
    the first `abstract_chars` characters are shown, or all.
    """
    abstract = F.col("abstract") if abstract_chars is None else F.substring("abstract", 1, abstract_chars)
    bullets = lambda items: F.when(F.size(items) == 0, F.lit(NO_BULLETS)).otherwise(
        F.array_join(F.transform(items, lambda s: F.concat(F.lit("- "), s)), "\n")
    )
    body = F.concat(
        F.lit(PAIR_PARTS[0]), "title", F.lit(PAIR_PARTS[1]), abstract,
        F.lit(PAIR_PARTS[2]), bullets(F.transform("methods", tf.method_line)),
        F.lit(PAIR_PARTS[3]), bullets(F.col("claims")), F.lit(PAIR_PARTS[4]))
    side = lambda s: papers.select(
        F.col("work_id").alias(f"{s}_work_id"),
        F.concat(F.lit(PAIR_SIDE.format(s.upper())), body).alias(f"_{s}"),
    )
    lead = F.lit(PAIR_LEAD)
    return (
        pairs.join(side("a"), "a_work_id").join(side("b"), "b_work_id")
        .select("a_work_id", "b_work_id", F.concat(lead, "_a", "_b").alias("prompt"))
    )


def positions_within(df: DataFrame, key: list[str], order: str, name: str, stride: int = 4096) -> DataFrame:
    """Dense 0-based position by an integer column. Long groups are numbered in strides, not in one task."""
    stretch = df.withColumn("_stretch", F.floor(F.col(order) / stride))
    counts = stretch.groupBy(*key, "_stretch").agg(F.count("*").alias("_n"))
    before = counts.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(W.partitionBy(*key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_n")
    local = F.row_number().over(W.partitionBy(*key, "_stretch").orderBy(order)) - 1
    return (
        stretch.withColumn("_local", local).join(before, [*key, "_stretch"])
        .withColumn(name, F.col("_before") + F.col("_local")).drop("_stretch", "_local", "_before")
    )


def context_prompts(contexts: DataFrame, titles: DataFrame, batch: int = CONTEXTS_AT_ONCE) -> DataFrame:
    """Classification prompts: `batch` contexts of one document each.

    `contexts`: work_id, position, context_id, text, page, cited_title (known targets only); `titles`:
    work_id, title.
    """
    numbered = positions_within(contexts, ["work_id"], "position", "_at")
    entry = F.concat(
        F.lit(CONTEXT_PARTS[0]), "context_id", F.lit(CONTEXT_PARTS[1]), F.col("page").cast("string"),
        F.lit(CONTEXT_PARTS[2]), F.coalesce("cited_title", F.lit(NO_TITLE)), F.lit(CONTEXT_PARTS[3]), "text",
        F.lit(CONTEXT_PARTS[4]))
    chunk = numbered.groupBy("work_id", F.floor(F.col("_at") / batch).alias("batch_no")).agg(
        F.count("*").alias("contexts"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_at", entry.alias("e")))), lambda s: s["e"]), ""
        ).alias("_body"),
    )
    lead = F.concat(
        F.lit(CONTEXT_LEAD[0]), "title", F.lit(CONTEXT_LEAD[1]))
    return chunk.join(titles, "work_id").select("work_id", "batch_no", "contexts", F.concat(lead, "_body").alias("prompt"))


GROUNDING_HEAD = 12  # characters of a quote that are looked up
STRETCH = 512
MARKS, MARKED_AT_MOST = 4096, 1024  # values of a piece's mark, and how many of them a page may want to be worth looking at


def segment_pieces(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pieces of the segments (version_id, page, segment_no, _piece) that may be among those `wanted` on their page (version_id, page, _piece)."""
    page = ["version_id", "page"]
    mark = lambda piece: F.pmod(F.xxhash64(piece), F.lit(MARKS)).cast("short")
    lengths = wanted.groupBy(*page).agg(
        F.collect_set(F.length("_piece")).alias("_lengths"), F.collect_set(mark(F.col("_piece"))).alias("_marks"))
    # a long segment is cut into stretches that overlap by a piece, so that finding a place in it stays short
    last = F.floor((F.length("_hay") - F.col("_length")) / STRETCH)
    stretch = F.substring(F.col("_hay"), (F.col("_at") * STRETCH + 1).cast("int"), F.col("_length") + (STRETCH - 1))
    places = F.sequence(F.lit(1), F.length("_stretch") - F.col("_length") + 1)
    pieces = F.transform(places, lambda i: F.substring(F.col("_stretch"), i, F.col("_length")))
    maybe = F.filter(pieces, lambda p: (F.size("_marks") > MARKED_AT_MOST) | F.array_contains("_marks", mark(p)))
    return (
        segments.select(*page, "segment_no", F.lower("text").alias("_hay"))
        .join(lengths, page)
        .select(*page, "segment_no", "_hay", "_marks", F.explode("_lengths").alias("_length"))
        .where(F.length("_hay") >= F.col("_length"))
        .select(*page, "segment_no", "_hay", "_marks", "_length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_at"))
        .select(*page, "segment_no", "_marks", "_length", stretch.alias("_stretch"))
        .select(*page, "segment_no", F.explode(F.array_distinct(maybe)).alias("_piece"))
    )


def ground_evidence(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """Where a quote is on its page: its box, else the first text segment holding its first 12 characters.

    `evidence`: evidence_id, version_id, page, text, bbox (struct or JSON); `segments`: version_id, page,
    segment_no, text. Adds how (box, segment, none), box and segment_no.

    Beginnings of quotes meet an index of the pieces of the same length of every segment by equality, so the
    quotes of a page are never held against its segments one by one. A page names the few lengths its quotes
    need (12, and those of shorter quotes); segments of pages without open quotes are not cut at all. It names the
    marks (hashes of few values) of the wanted pieces too: others never leave the task that cut them.
    """
    boxed = evidence.withColumn("box", box_of(evidence, "bbox"))
    page = ["version_id", "page"]
    head = F.lower(F.substring("text", 1, GROUNDING_HEAD))
    seek = boxed.where("box IS NULL AND text <> ''").select("evidence_id", *page, head.alias("_piece"))
    wanted = seek.select(*page, "_piece").distinct()
    index = segment_pieces(segments, wanted)
    first = (
        index.join(wanted, [*page, "_piece"])
        .groupBy(*page, "_piece").agg(F.min("segment_no").alias("segment_no"))
    )
    hit = seek.join(first, [*page, "_piece"]).select("evidence_id", "segment_no")
    how = F.when(F.col("box").isNotNull(), "box").when(F.col("segment_no").isNotNull(), "segment").otherwise("none")
    return boxed.join(hit, "evidence_id", "left").withColumn("how", how)
