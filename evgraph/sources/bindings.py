"""Evidence-graph tables derived from the driver's star-schema tables.

Every view is plain arithmetic over whole tables. `plans/oracle_views.py` states the
same derivations in SQL.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph import taxonomy as tx
from evgraph.functions import text as tf
from evgraph.operators import consensus
from evgraph.operators.tables import upsert_latest
from evgraph.sources.tables import load_raw, spread


def pick(words: list[str], index):
    """Word number `index` of a fixed list."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))


class Library:
    """Lazy views; nothing is cached, so one query reads only what it needs."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def raw(self, name: str) -> DataFrame:
        return load_raw(self.spark, self.directory, name)

    def spread(self, name: str) -> DataFrame:
        """A driver table for work that costs far more than reading it."""
        return spread(self.raw(name))

    def size(self, name: str):
        """Row count of a driver table, as a scalar subquery."""
        return self.raw(name).select(F.count("*")).scalar()

    @cached_property
    def works(self):
        return self.raw("part").select(
            F.col("p_partkey").alias("work_id"),
            tf.normalize_title(F.col("p_name")).alias("title_norm"),
            (F.col("p_partkey") * 2).alias("primary_version_id"),
            F.col("p_partkey").alias("created_at"),
        )

    @cached_property
    def versions(self):
        """A preprint per work; works of a size divisible by 3 also have a journal version."""
        part = self.raw("part")
        key = F.col("p_partkey")
        arxiv = F.concat(
            F.lpad((F.lit(1000) + F.floor(key / 100000)).cast("string"), 4, "0"),
            F.lit("."),
            F.lpad((key % 100000).cast("string"), 5, "0"),
        )
        is_second = F.col("nth") == 1
        return (
            part.withColumn(
                "nth",
                F.explode(F.when(F.col("p_size") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
            )
            .select(
                (key * 2 + F.col("nth")).alias("version_id"),
                key.alias("work_id"),
                F.when(is_second, "journal").otherwise("arxiv").alias("kind"),
                F.when(~is_second, arxiv).alias("arxiv_id"),
                F.when(is_second, F.concat(F.lit("10.1000/"), key.cast("string"))).alias("doi"),
                F.when(is_second, F.concat("p_name", F.lit(" Extended"))).otherwise(F.col("p_name")).alias("title"),
                F.concat_ws(" ", "p_brand", "p_type").alias("abstract"),
                (F.lit(1990) + F.col("p_size") + F.col("nth")).alias("year"),
                F.col("p_brand").alias("venue_name"),
                (key * 2 + F.col("nth")).alias("created_at"),
            )
        )

    @cached_property
    def authors(self):
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("full_name")
        )

    @cached_property
    def version_authors(self):
        return (
            self.raw("lineitem")
            .groupBy((F.col("l_partkey") * 2).alias("version_id"), F.col("l_suppkey").alias("author_id"))
            .agg(F.min("l_linenumber").alias("position"))
        )

    @cached_property
    def projects(self):
        return self.raw("part").select(
            F.substring_index("p_brand", "#", -1).cast("long").alias("project_id"), F.col("p_brand").alias("name")
        ).distinct()

    @cached_property
    def work_projects(self):
        return self.raw("part").select(
            F.col("p_partkey").alias("work_id"),
            F.substring_index("p_brand", "#", -1).cast("long").alias("project_id"),
        )

    @cached_property
    def citations(self):
        cited = (F.col("l_orderkey") * 31 + F.col("l_suppkey")) % self.size("part")
        return (
            self.raw("lineitem")
            .select(
                F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("citation_id"),
                F.col("l_partkey").alias("citing_work_id"),
                cited.alias("cited_work_id"),
            )
            .where("citing_work_id <> cited_work_id")
        )

    @cached_property
    def relations_raw(self):
        """Relations before any vote was counted."""
        priority = F.substring("o_orderpriority", 1, 1)
        return self.raw("orders").select(
            F.col("o_orderkey").alias("relation_id"),
            pick(tx.RELATION_TYPES, F.col("o_orderkey") % 12).alias("type"),
            F.col("o_orderstatus").alias("aspect"),
            F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("explanation"),
            F.round((F.col("o_totalprice") % 100) / 100, 4).alias("confidence"),
            F.when(priority == "1", "public_fact").when(priority == "2", "team_record")
            .otherwise("ai_candidate").alias("source"),
            F.col("o_orderkey").alias("created_at"),
            F.unix_date(F.col("o_orderdate").cast("date")).alias("created_day"),
        )

    @cached_property
    def relations(self):
        status = consensus.relation_status(self.reviews)
        return (
            self.relations_raw.join(status.withColumnRenamed("subject_id", "relation_id"), "relation_id", "left")
            .withColumn("review_status", F.coalesce("review_status", F.lit("unreviewed")))
        )

    @cached_property
    def relation_members(self):
        """Most members are anchored works; some sources are claims, some targets have no anchor."""
        key = F.col("o_orderkey")
        target = (key * 17) % self.size("customer")
        is_claim = key % 7 == 5
        member = lambda kind, entity, role, anchor, pos: F.struct(
            kind.alias("entity_kind"), entity.alias("entity_id"), F.lit(role).alias("role"),
            anchor.alias("anchor_work_id"), F.lit(pos).alias("position"))
        source = F.col("o_custkey")
        return self.raw("orders").select(
            key.alias("relation_id"),
            F.inline(
                F.array(
                    member(
                        F.when(is_claim, "claim").otherwise("work"),
                        F.when(is_claim, key + 1_000_000_000).otherwise(source),
                        "source", source, 0),
                    member(F.lit("work"), target, "target", F.when(key % 7 != 3, target), 1),
                )
            ),
        )

    @cached_property
    def reviews_raw(self):
        """Every vote ever cast, repeats included."""
        subject = (F.col("event_id") * 7 + F.col("user_id")) % F.floor(self.size("orders") / 5)
        return self.raw("events").select(
            F.col("event_id").alias("review_id"),
            F.lit("relation").alias("subject_kind"),
            subject.alias("subject_id"),
            "user_id",
            F.when(F.col("event_type") == "error", "disagree").otherwise("agree").alias("verdict"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def reviews(self):
        return consensus.latest_reviews(self.reviews_raw)

    @cached_property
    def reading_raw(self):
        level = F.create_map(
            *[F.lit(x) for x in ("view", "unread", "click", "skimmed", "signup", "read",
                                 "purchase", "reproduced", "error", "needs_review")])
        return self.raw("events").select(
            "user_id",
            (F.col("event_id") % self.size("customer")).alias("work_id"),
            level[F.col("event_type")].alias("status"),
            (F.col("value") > 50).alias("starred"),
            F.col("ts").alias("updated_at"),
            "event_id",
        )

    @cached_property
    def reading_status(self):
        return upsert_latest(self.reading_raw, ["user_id", "work_id"], ["updated_at", "event_id"])

    @cached_property
    def users(self):
        return self.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))

    @cached_property
    def groups(self):
        return self.raw("region").select(
            F.col("r_regionkey").cast("long").alias("group_id"), F.col("r_name").alias("name"))

    @cached_property
    def graphs(self):
        return self.raw("nation").select(
            F.col("n_nationkey").cast("long").alias("graph_id"),
            F.col("n_regionkey").cast("long").alias("group_id"),
            F.col("n_name").alias("name"),
        )

    @cached_property
    def group_members(self):
        nation = self.graphs.select(F.col("graph_id").alias("c_nationkey"), "group_id")
        return self.raw("customer").join(nation, "c_nationkey").select(
            "group_id", F.col("c_custkey").alias("user_id"),
            F.when(F.col("c_acctbal") > 5000, "admin").otherwise("member").alias("role"))

    @cached_property
    def graph_works(self):
        return self.raw("customer").select(
            F.col("c_nationkey").cast("long").alias("graph_id"),
            F.col("c_custkey").alias("work_id"),
            (F.col("c_custkey") % 7).alias("added_by"),
        )

    @cached_property
    def claims(self):
        """First line of every document is a claim about a work."""
        return self.raw("documents").select(
            F.col("doc_id").alias("claim_id"),
            (F.col("doc_id") % self.size("customer")).alias("work_id"),
            F.substring_index("text", "\n", 1).alias("text"),
            F.when(F.col("lang") == "en", "ai_candidate").otherwise("team_record").alias("source"),
            F.when(F.col("lang") == "en", "unreviewed").otherwise("confirmed").alias("review_status"),
        )

    @cached_property
    def methods(self):
        """Every order is a method of a work."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("method_id"),
            ((F.col("o_orderkey") * 7) % self.size("part")).alias("work_id"),
            F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("name"),
        )

    @cached_property
    def paper_aspects(self):
        """First line of every document sums up an aspect of a work."""
        return self.raw("documents").select(
            (F.col("doc_id") % self.size("part")).alias("work_id"),
            pick(tx.ASPECTS, F.col("doc_id") % 8).alias("aspect"),
            F.substring_index("text", "\n", 1).alias("summary"),
        )

    @cached_property
    def annotations(self):
        """Events are annotations; up to forty in a row answer one another."""
        key = F.col("event_id")
        return self.raw("events").select(
            key.alias("annotation_id"),
            (key % self.size("part")).alias("work_id"),
            (key % 7).alias("user_id"),
            F.when(key % 5 == 0, "private").otherwise("team").alias("visibility"),
            F.when(key % 40 > 0, key - 1).alias("parent_id"),
            F.col("event_type").alias("body"),
        )

    @cached_property
    def claim_judgments(self):
        return self.raw("events").select(
            F.col("event_id").alias("judgment_id"),
            (F.col("event_id") % self.size("documents")).alias("claim_id"),
            "user_id",
            pick(tx.CLAIM_VERDICTS, F.col("event_id") % 6).alias("verdict"),
        )

    @cached_property
    def judgment_reviews(self):
        return self.raw("events").select(
            F.col("event_id").alias("review_id"),
            F.lit("claim_judgment").alias("subject_kind"),
            ((F.col("event_id") * 3 + F.col("user_id")) % F.floor(self.size("events") / 4)).alias("subject_id"),
            "user_id",
            F.when(F.col("value") > 50, "disagree").otherwise("agree").alias("verdict"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def evidence(self):
        """One quote per relation, one per claim, one per extracted field (documents)."""
        of_relation = self.raw("orders").select(
            F.col("o_orderkey").alias("evidence_id"),
            F.col("o_orderkey").alias("relation_id"),
            F.lit(None).cast("long").alias("claim_id"),
            F.lit(None).cast("string").alias("extraction_field"),
            (F.col("o_custkey") * 2).alias("version_id"),
            (F.col("o_orderkey") % 12 + 1).cast("int").alias("page"),
            F.col("o_orderpriority").alias("text"),
        )
        of_claim = self.claims.select(
            (-F.col("claim_id") - 1).alias("evidence_id"),
            F.lit(None).cast("long").alias("relation_id"),
            "claim_id",
            F.lit("claim").alias("extraction_field"),
            (F.col("work_id") * 2).alias("version_id"),
            (F.col("claim_id") % 20 + 1).cast("int").alias("page"),
            "text",
        )
        return of_relation.unionByName(of_claim)

    @cached_property
    def node_comments(self):
        speaker = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
        kind = F.when(F.col("role") == "user", "question").when(F.col("role") == "assistant", "idea")
        comment_id = F.col("conv_id") * 1000 + F.col("turn")
        return self.raw("conversations").select(
            comment_id.alias("comment_id"),
            (F.col("conv_id") % 10).alias("graph_id"),
            F.col("conv_id").alias("work_id"),
            (F.col("conv_id") % 7 + speaker).alias("user_id"),
            kind.otherwise("review").alias("kind"),
            F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "private").otherwise("team").alias("visibility"),
            F.col("text").alias("body"),
            F.when(F.col("turn") > 0, comment_id - 1).alias("parent_id"),
            comment_id.alias("created_at"),
        )

    @cached_property
    def embeddings(self):
        return self.raw("embeddings").select(
            F.col("vec_id").alias("entity_id"),
            F.concat(F.lit("aspect:"), pick(tx.ASPECTS, F.col("label") % 8)).alias("field"),
            F.col("embedding").alias("vec"),
        )

    @cached_property
    def jobs(self):
        """Events are jobs; their `k` names a work for views and clicks, a version otherwise."""
        for_work = F.col("event_type").isin("view", "click")
        payload = F.when(for_work, F.replace("props", F.lit('"k"'), F.lit('"work_id"'))).otherwise(
            F.replace("props", F.lit('"k"'), F.lit('"version_id"'))
        )
        return self.raw("events").select(
            F.col("event_id").alias("job_id"), F.col("event_type").alias("kind"), payload.alias("payload")
        )

    @cached_property
    def document_dna(self):
        """Per document the lines of each aspect: line i belongs to aspect i mod 8."""
        lines = F.split("text", "\n")
        of_aspect = lambda i: F.filter(lines, lambda _, n: n % 8 == i)
        fields = [
            F.struct(
                F.coalesce(F.get(of_aspect(i), F.lit(0)), F.lit("")).alias("summary"),
                F.filter(of_aspect(i), lambda _, n: n > 0).alias("bullets"),
                F.when((F.col("doc_id") + i) % 5 == 0, "").otherwise(F.col("source")).alias("source_text"),
                ((F.col("doc_id") + i) % 13 - 1).alias("page"),
            ).alias(key)
            for i, key in enumerate(tx.ASPECTS)
        ]
        n = self.size("part")
        ref_key = (F.col("doc_id") * 7 + 3) % n
        arxiv = F.concat(
            F.lpad((F.lit(1000) + F.floor(ref_key / 100000)).cast("string"), 4, "0"), F.lit("."),
            F.lpad((ref_key % 100000).cast("string"), 5, "0"))
        ref = lambda title, arxiv_id, doi, year: F.struct(
            title.alias("title"), arxiv_id.alias("arxiv_id"), doi.alias("doi"), year.alias("year"))
        none = F.lit(None).cast("string")
        doi = F.concat(F.lit("10.1000/"), ((F.col("doc_id") * 5) % n).cast("string"))
        references = F.array(
            ref(F.lit(" "), F.concat(F.lit(" arXiv:"), arxiv), doi, F.lit(2001)),
            ref(F.col("lang"), none, doi, F.lit(2002)),
            ref(F.col("source"), F.lit(""), none, F.lit(None).cast("int")),
            ref(F.lit("  "), F.lit(""), F.lit(" "), F.lit(2003)),
        )
        return self.spread("documents").select(
            F.col("doc_id").alias("work_id"),
            (F.col("doc_id") * 2).alias("version_id"),
            F.to_json(F.struct(*fields, references.alias("references"))).alias("raw"),
        )
