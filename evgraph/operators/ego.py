"""Neighbourhood views: the most relevant works around every centre, the rest summed up in groups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evgraph import taxonomy as tx
from evgraph.functions import text as tf
from evgraph.functions.scores import synthetic_id
from evgraph.operators.relations import reader_counts
from evgraph.operators.tables import crowded, dealt_out, in_every_part, in_parts, in_rounds, top_k

KEPT_OTHERS = 29
EXPANDED = 12
DEFAULT_CONFIDENCE = 0.6
REVIEW_BONUS, READER_BONUS = 0.2, 0.15
HUB_PART = 4096  # edges of one work that a task unfolds at a time
ENDS_A_ROUND, MOST_ROUNDS = 20_000_000, 4  # scored ends whose two-hop candidates are looked at together


def _best() -> list[Column]:
    return [F.desc("score"), F.asc("neighbor_work_id")]


def _both_ends(edges: DataFrame) -> DataFrame:
    """Every edge seen from either end: center_id, neighbor_work_id, direction."""
    view = lambda me, other, way: F.struct(
        F.col(me).alias("center_id"), F.col(other).alias("neighbor_work_id"), F.lit(way).alias("direction"))
    rest = [c for c in edges.columns if c not in ("source_work_id", "target_work_id")]
    return edges.select(
        *rest, "source_work_id", "target_work_id",
        F.inline(F.array(view("source_work_id", "target_work_id", "out"), view("target_work_id", "source_work_id", "in"))),
    )


def scored_ends(edges: DataFrame, members: DataFrame, reading: DataFrame, mode: str = "explore") -> DataFrame:
    """Each drawable edge from both ends, with its score and which of the two ends it is anchored on.

    score = status weight * mode weight * (1 + confidence) + 0.2 * votes + 0.15 * readers of the other.
    """
    anchors = members.where("anchor_work_id IS NOT NULL").select("relation_id", "anchor_work_id").distinct()
    at = lambda c, flag: anchors.select("relation_id", F.col("anchor_work_id").alias(c), F.lit(True).alias(flag))
    readers = reader_counts(reading).withColumnRenamed("work_id", "neighbor_work_id")
    rel_type = F.col("relation_type")
    base = (
        tx.status_weight(F.col("review_status"))
        * tx.mode_weight(mode, rel_type)
        * (F.lit(1.0) + F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)))
        + F.col("review_count") * REVIEW_BONUS
    )
    return (
        _both_ends(edges)
        .join(at("center_id", "from_anchor"), ["relation_id", "center_id"], "left")
        .join(at("neighbor_work_id", "to_anchor"), ["relation_id", "neighbor_work_id"], "left")
        .join(readers, "neighbor_work_id", "left")
        .withColumn("score", base + F.coalesce("readers", F.lit(0)) * READER_BONUS)
        .drop("readers")
    )


def ego_candidates(edges: DataFrame, members: DataFrame, reading: DataFrame, mode: str = "explore") -> DataFrame:
    """Hop 1: the edges around every work they are anchored on."""
    return scored_ends(edges, members, reading, mode).where("from_anchor").drop("from_anchor", "to_anchor")


def best_others(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("center_id", "neighbor_work_id").agg(F.max("score").alias("score"))


def rounds_of(scored: DataFrame) -> int:
    """In how many rounds the two-hop candidates of a staged table of scored ends are looked at."""
    return min(MOST_ROUNDS, 1 + scored.count() // ENDS_A_ROUND)


def _by_centre(rows: DataFrame, rounds: int, label: str, step) -> DataFrame:
    """`step` on the rows of some centres after the other, as a table: only those are unfolded, and their shuffles leave the disks.
    Without rounds nothing is staged."""
    return step(rows) if rounds == 0 else in_rounds(rows, "center_id", rounds, label, lambda some, _: step(some))


def kept_others(candidates: DataFrame, k: int = KEPT_OTHERS, rounds: int = 0) -> DataFrame:
    """(center_id, neighbor_work_id, score): the works drawn around each centre."""
    return _by_centre(candidates, rounds, "kept", lambda some: top_k(best_others(some), ["center_id"], _best(), k))


def two_hop_others(scored: DataFrame, k: int = KEPT_OTHERS, expanded: int = EXPANDED) -> DataFrame:
    """Works drawn around each centre when its 12 best others are expanded as well.

    `scored` comes from scored_ends. A second-hop score depends on the edge alone, so of every expanded
    work only its best k + expanded + 1 others can reach the first k around a centre (the centre and the
    other expanded works may be among them): no hub is unfolded for each of its neighbours. An edge
    between two expanded works counts once, seen from the better ranked one that anchors it.
    """
    hop1 = best_others(scored.where("from_anchor"))
    via = top_k(hop1, ["center_id"], _best(), expanded, rank="place").select(
        "center_id", F.col("neighbor_work_id").alias("via"), "place")
    earlier = via.select("center_id", F.col("via").alias("far"), F.col("place").alias("far_place"))
    reach = top_k(hop1, ["center_id"], _best(), k + expanded + 1)
    onward = reach.select(F.col("center_id").alias("via"), F.col("neighbor_work_id").alias("far"), "score")
    later_view = F.coalesce(F.col("far_place") < F.col("place"), F.lit(False))
    hop2 = (
        via.join(onward, "via").where("far <> center_id").join(earlier, ["center_id", "far"], "left").where(~later_view)
        .select("center_id", F.col("far").alias("neighbor_work_id"), "score")
    )
    # between two expanded works: edges the better ranked one does not anchor are seen from the other
    one_sided = best_others(scored.where("from_anchor AND to_anchor IS NULL")).select(
        F.col("center_id").alias("via"), F.col("neighbor_work_id").alias("far"), "score")
    between = (
        via.join(earlier, "center_id").where("far_place < place").join(one_sided, ["via", "far"])
        .select("center_id", F.col("far").alias("neighbor_work_id"), "score")
    )
    # edges to the centre that only the expanded work anchors
    back = scored.where("from_anchor IS NULL AND to_anchor").select("center_id", "neighbor_work_id", "score")
    back = back.join(via.select("center_id", F.col("via").alias("neighbor_work_id")), ["center_id", "neighbor_work_id"], "left_semi")
    found = hop1.unionByName(hop2).unionByName(between).unionByName(back)
    return top_k(best_others(found), ["center_id"], _best(), k)


def two_hop_candidates(scored: DataFrame, expanded: int = EXPANDED, hub_part: int = HUB_PART) -> DataFrame:
    """Hops 1 and 2: the edges around every work, and those around its best `expanded` others, as in ego_candidates.

    `scored` comes from scored_ends. Each relation counts once per centre, where it is met first: from the centre, then
    from the expanded works by rank. Its other end and direction are relative to the centre if it touches that, else
    to the expanded work. The edges of a hub are unfolded in parts of about `hub_part`, each with a copy of the
    list of centres that expand it, so that no task has a whole hub; what follows works per centre and work.
    """
    anchored = scored.where("from_anchor")
    via = top_k(best_others(anchored), ["center_id"], _best(), expanded, rank="place").select(
        "center_id", F.col("neighbor_work_id").alias("via"), "place")
    # every expanded work brings the short list of all of its centre: nothing that the join multiplies meets another table
    of_center = F.collect_list(F.struct("place", "via")).over(W.partitionBy("center_id"))
    via = via.withColumn("_vias", F.transform(F.array_sort(of_center), lambda v: v["via"]))
    around = anchored.withColumnRenamed("center_id", "via")
    hubs = crowded(around, "via", hub_part)
    spread, asked = in_parts(around, "via", hubs, "relation_id", "neighbor_work_id"), in_every_part(via, "via", hubs)
    # an edge between two expanded works that both anchor it was met at the better ranked one
    other_place = F.array_position("_vias", F.col("neighbor_work_id"))
    met = F.coalesce(F.col("to_anchor") & (other_place > 0) & (other_place < F.col("place")), F.lit(False))
    beyond = dealt_out(spread, "via", "part").join(asked.hint("merge"), ["via", "part"]).where("neighbor_work_id <> center_id").where(~met)
    # edges to the centre that only the expanded work anchors
    earlier = via.select("center_id", F.col("via").alias("neighbor_work_id"))
    back = scored.where("from_anchor IS NULL AND to_anchor").join(earlier, ["center_id", "neighbor_work_id"], "left_semi")
    columns = [c for c in scored.columns if c not in ("from_anchor", "to_anchor")]
    return anchored.select(columns).unionByName(beyond.select(columns)).unionByName(back.select(columns))


def overflow_members(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """(center_id, group_key, relation_type, direction, neighbor_work_id): works that were not kept."""
    pair = ["center_id", "neighbor_work_id"]
    # dealt by what is joined: the rows are shuffled once, then dropped and made distinct where they are
    rows = dealt_out(candidates.select(*pair, "relation_type", "direction"), *pair)
    left_over = rows.join(kept.select(*pair).hint("merge"), pair, "left_anti").distinct()
    key = F.concat_ws(":", "relation_type", "direction").alias("group_key")
    return left_over.select("center_id", key, "relation_type", "direction", "neighbor_work_id")


def overflow_groups(overflow: DataFrame, rounds: int = 0) -> DataFrame:
    """One row per centre, relation type and direction, with the number of works behind it."""
    def counted(some: DataFrame) -> DataFrame:
        return some.groupBy("center_id", "group_key", "relation_type", "direction").agg(F.count("*").alias("members"))

    found = _by_centre(overflow, rounds, "overflow_groups", counted)
    return found.withColumn("group_id", synthetic_id(F.col("center_id"), F.col("group_key")))


def _label(direction: Column, rel_type: Column, n: Column) -> Column:
    way = F.when(direction == "in", "towards it:").otherwise("from it:")
    return F.concat(way, F.lit(" "), F.replace(rel_type, F.lit("_"), F.lit(" ")), F.lit(" +"), n.cast("string"))


def ego_nodes(works: DataFrame, versions: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Centre, kept works and group nodes of every centre."""
    primary = versions.select(F.col("version_id").alias("primary_version_id"), "title")
    titled = works.join(primary, "primary_version_id", "left").select(
        F.col("work_id").alias("_work"), tf.display_title(F.col("title"), F.col("title_norm")).alias("label"))
    centers = kept.select("center_id").distinct()
    nil = lambda t: F.lit(None).cast(t)
    me = centers.join(titled, F.col("center_id") == F.col("_work")).select(
        "center_id", F.col("center_id").cast("string").alias("node_id"), F.lit("work").alias("kind"), "label",
        nil("long").alias("members"), nil("double").alias("score"))
    others = kept.join(titled, F.col("neighbor_work_id") == F.col("_work")).select(
        "center_id", F.col("neighbor_work_id").cast("string").alias("node_id"), F.lit("work").alias("kind"), "label",
        nil("long").alias("members"), "score")
    bundles = groups.select(
        "center_id", F.col("group_id").alias("node_id"), F.lit("group").alias("kind"),
        _label(F.col("direction"), F.col("relation_type"), F.col("members")).alias("label"), "members",
        nil("double").alias("score"))
    return me.unionByName(others).unionByName(bundles)


def ego_edges(candidates: DataFrame, kept: DataFrame, groups: DataFrame, rounds: int = 0) -> DataFrame:
    """Edges whose ends are the centre or kept works, and one edge per overflow group."""
    shown = kept.select("center_id", F.col("neighbor_work_id").alias("_end"))
    shown = shown.unionByName(kept.select("center_id", F.col("center_id").alias("_end"))).distinct()

    def drawn_of(some: DataFrame) -> DataFrame:
        for end in ("source_work_id", "target_work_id"):
            some = some.join(shown.withColumnRenamed("_end", end), ["center_id", end], "left_semi")
        return some.select(
            "center_id",
            F.col("relation_id").cast("string").alias("edge_id"),
            F.col("source_work_id").cast("string").alias("source_id"),
            F.col("target_work_id").cast("string").alias("target_id"),
            "relation_type", "review_status", "review_count",
            F.concat_ws("|", "source_work_id", "target_work_id", tx.semantic_group(F.col("relation_type"))).alias("bundle_key"),
        ).dropDuplicates(["center_id", "edge_id"])

    drawn = _by_centre(candidates, rounds, "drawn_edges", drawn_of)
    me, it = F.col("center_id").cast("string"), F.col("group_id")
    outward = F.col("direction") == "out"
    summed = groups.select(
        "center_id", it.alias("edge_id"), F.when(outward, me).otherwise(it).alias("source_id"),
        F.when(outward, it).otherwise(me).alias("target_id"), "relation_type",
        F.lit("unreviewed").alias("review_status"), F.lit(0).cast("long").alias("review_count"),
        F.lit(None).cast("string").alias("bundle_key"))
    return drawn.unionByName(summed)


def expand_groups(
    nodes: DataFrame, edges: DataFrame, overflow: DataFrame, opened: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the `opened` groups (center_id, group_key) were replaced by their works."""
    target = opened.select(
        "center_id", "group_key", synthetic_id(F.col("center_id"), F.col("group_key")).alias("_gid"))
    gone_node = target.select("center_id", F.col("_gid").alias("node_id"))
    gone_edge = target.select("center_id", F.col("_gid").alias("edge_id"))
    stay = nodes.join(gone_node, ["center_id", "node_id"], "left_anti")
    inside = overflow.join(target, ["center_id", "group_key"]).select(
        "center_id", "group_key", "relation_type", F.col("neighbor_work_id").cast("string").alias("node_id"))
    # a work in two opened groups appears once, under the first group
    first = inside.groupBy("center_id", "node_id").agg(F.min_by("relation_type", "group_key").alias("relation_type"), F.min("group_key").alias("group_key"))
    fresh = first.join(stay.select("center_id", "node_id"), ["center_id", "node_id"], "left_anti")
    nil = lambda t: F.lit(None).cast(t)
    new_nodes = fresh.select(
        "center_id", "node_id", F.lit("work").alias("kind"), F.col("node_id").alias("label"),
        nil("long").alias("members"), F.lit(0.0).alias("score"))
    new_edges = fresh.select(
        "center_id", F.concat_ws("-", F.lit("expand"), "group_key", "node_id").alias("edge_id"),
        F.col("center_id").cast("string").alias("source_id"), F.col("node_id").alias("target_id"), "relation_type",
        F.lit("unreviewed").alias("review_status"), F.lit(0).cast("long").alias("review_count"),
        nil("string").alias("bundle_key"))
    return (
        stay.unionByName(new_nodes),
        edges.join(gone_edge, ["center_id", "edge_id"], "left_anti").unionByName(new_edges),
    )
