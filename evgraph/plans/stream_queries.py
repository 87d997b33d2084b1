"""I: change streams run to their end over whole tables; the result must equal the batch one."""

from pyspark.sql import functions as F

from evgraph import schemas
from evgraph.operators import reads
from evgraph.operators import similarity as sim
from evgraph.plans.registry import query
from evgraph.plans.similarity_queries import rounded
from evgraph.session import fresh_path, materialize
from evgraph.sources.bindings import Library
from evgraph.streaming import change_feeds as feeds


class StreamedLibrary(Library):
    """The same bindings with one driver table read as a stream."""

    def __init__(self, spark, directory, streamed):
        super().__init__(spark, directory)
        self.streamed = streamed

    def raw(self, name):
        if name != self.streamed:
            return super().raw(name)
        stream = self.spark.readStream.schema(schemas.RAW[name])
        if any(file.endswith(f"/{name}.parquet") for file in super().raw(name).inputFiles()):  # one file beside other tables
            return stream.option("pathGlobFilter", f"{name}.parquet").parquet(self.directory)
        return stream.parquet(f"{self.directory}/{name}.parquet")

    def size(self, name):
        return Library(self.spark, self.directory).size(name) if name == self.streamed else super().size(name)


def _finish(started):
    started.awaitTermination()


@query("i1_live_status", "SELECT subject_id, review_status FROM vote_status")
def _(t):
    folder = fresh_path(t.spark, "reviews")
    # votes carry a subject computed from a row count: bound in batch, replayed from the shared folder
    votes = materialize(t.reviews_raw.repartition(3), "votes")  # three batches, in which late votes come last
    source = t.spark.readStream.schema(votes.schema).option("maxFilesPerTrigger", 1).parquet(_dir(votes))
    _finish(feeds.follow_reviews(source, folder))
    return feeds.live_status(t.spark, folder)


def _dir(df):
    return df.inputFiles()[0].rsplit("/", 1)[0]


@query("i2_refreshed_neighbors", """
    SELECT work_id, neighbor_work_id, round(score, 6) AS score FROM lineage_neighbors""")
def _(t):
    """Every voted relation touches its works; stored lists of the others stay as they were."""
    folder = fresh_path(t.spark, "works")
    relations, members = materialize(t.relations, "relations"), materialize(t.relation_members, "members")
    old = t.relations_raw.withColumn("review_status", F.lit("unreviewed"))
    stored = sim.lineage_neighbors(sim.lineage_edges(old, members))
    touched = materialize(
        members.where("anchor_work_id IS NOT NULL").select(F.col("anchor_work_id").alias("work_id")).distinct(), "touched")
    changes = t.spark.readStream.schema(touched.schema).parquet(_dir(touched))
    _finish(feeds.follow_works(changes, feeds.refresh_lineage(lambda: relations, lambda: members), folder))
    return rounded(feeds.current_neighbors(t.spark, stored, folder), "work_id", "neighbor_work_id")


@query("i2_refreshed_after_few_changes", """
    SELECT work_id, neighbor_work_id, round(score, 6) AS score FROM lineage_neighbors""")
def _(t):
    """One relation in two hundred gets its votes; lists that this cannot reach stay as they were stored."""
    folder = fresh_path(t.spark, "works")
    after, members = materialize(t.relations, "relations"), materialize(t.relation_members, "members")
    changed = F.col("relation_id") % 200 == 0
    before = materialize(after.withColumn("review_status", F.when(~changed, F.col("review_status")).otherwise("unreviewed")), "relations")
    stored = materialize(sim.lineage_neighbors(sim.lineage_edges(before, members)), "stored")
    ends = members.where(changed & F.col("anchor_work_id").isNotNull()).select(F.col("anchor_work_id").alias("work_id"))
    touched = materialize(ends.distinct().repartition(2), "touched")
    changes = t.spark.readStream.schema(touched.schema).option("maxFilesPerTrigger", 1).parquet(_dir(touched))
    _finish(feeds.follow_works(
        changes, feeds.refresh_lineage(lambda: after, lambda: members), folder,
        affected=feeds.affected_by_lineage(lambda: before, lambda: after, lambda: members)))
    return rounded(feeds.current_neighbors(t.spark, stored, folder), "work_id", "neighbor_work_id")


@query("i3_applied_results", """
    SELECT user_id AS batch_id, event_type AS custom_id, count(*) > 0 AS applied FROM events GROUP BY 1, 2""")
def _(t):
    """Results of one batch and item arrive many times, in one file or in a later one; each pair is applied once."""
    done = _applied(t, t.raw("events").repartition(4))
    return done.select("batch_id", "custom_id", F.lit(True).alias("applied"))


@query("i3_results_by_delivery", """
    WITH sent AS (SELECT *, event_id // (SELECT (max(event_id) + 4) // 4 FROM events) AS delivery FROM events)
    SELECT user_id AS batch_id, event_type AS custom_id, max(event_id) AS seq, max_by(props, event_id) AS body FROM sent
    WHERE delivery = (SELECT min(s.delivery) FROM sent s WHERE s.user_id = sent.user_id AND s.event_type = sent.event_type)
    GROUP BY 1, 2""")
def _(t):
    """Four deliveries, one after the other: the last result of a pair's first delivery is the one applied."""
    events = t.raw("events")
    quarter = events.agg(F.max("event_id")).first()[0] // 4 + 1 if not events.isEmpty() else 1
    folder, feed = fresh_path(t.spark, "results"), fresh_path(t.spark, "deliveries")
    for n in range(4):
        part = events.where(F.floor(F.col("event_id") / quarter) == n)
        _results(part).write.mode("append").parquet(feed)
        source = t.spark.readStream.schema(_results(events).schema).parquet(feed)
        _finish(feeds.follow_results(source, folder))
    done = feeds.applied_results(t.spark, folder, _results(events).schema)
    return done.select("batch_id", "custom_id", "seq", "body")


def _results(events):
    return events.select(
        F.col("user_id").alias("batch_id"), F.col("event_type").alias("custom_id"), F.col("event_id").alias("seq"),
        F.col("props").alias("body"))


def _applied(t, events):
    sent = materialize(_results(events), "deliveries")
    source = t.spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(_dir(sent))
    folder = fresh_path(t.spark, "results")
    _finish(feeds.follow_results(source, folder))
    return feeds.applied_results(t.spark, folder, sent.schema)


@query("i4_comment_feed", """
    SELECT m.user_id AS viewer_id, c.comment_id FROM node_comments c JOIN (
        SELECT graph_id, user_id, user_id % 50 * 1000 AS since FROM group_members JOIN graphs USING (group_id)) m ON m.graph_id = c.graph_id
    WHERE c.created_at > m.since AND (c.visibility = 'team' OR c.user_id = m.user_id) AND c.kind IN ('question', 'idea')
    QUALIFY row_number() OVER (PARTITION BY m.user_id ORDER BY c.created_at DESC, c.comment_id DESC) <= 200""")
def _(t):
    folder = fresh_path(t.spark, "feed")
    comments = StreamedLibrary(t.spark, t.directory, "conversations").node_comments
    viewers = reads.graphs_visible_to_users(t.group_members, t.graphs).select(
        "graph_id", F.col("user_id").alias("viewer_id"), (F.col("user_id") % 50 * 1000).alias("since"))
    stream = comments.select(
        "comment_id", "graph_id", "work_id", "user_id", "kind", "visibility", F.col("created_at").alias("updated_at"))
    _finish(feeds.follow_comments(stream, viewers, folder, ["Question", "idea"]))
    schema = "comment_id long, graph_id long, work_id long, user_id long, kind string, visibility string, updated_at long, viewer_id long"
    return feeds.comment_feed(t.spark, folder, schema, 200).select("viewer_id", "comment_id")
