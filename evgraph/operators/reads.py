"""Listings and access scope.

A listing of something that belongs to something else is a flat table keyed by its parent, with the
columns to sort by. Nothing is packed into one row per parent: a parent may own a third of the rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph import schemas, taxonomy as tx
from evgraph.functions import text as tf
from evgraph.operators import relations as rel
from evgraph.operators.consensus import judgment_disputes
from evgraph.operators.tables import left_known, paged, top_k
from evgraph.session import materialize

MAX_BODY = 20_000
MOST_DOUBLINGS = 40  # ends a thread that replies to itself


# --- works ----------------------------------------------------------------------------------


def titled_works(works: DataFrame, versions: DataFrame) -> DataFrame:
    """Works with the fields of their primary version shown in lists."""
    primary = versions.select(
        F.col("version_id").alias("primary_version_id"), F.col("title").alias("_title"), "year", "arxiv_id", "venue_name")
    return works.join(primary, "primary_version_id", "left").withColumn(
        "title", tf.display_title(F.col("_title"), F.col("title_norm"))
    ).drop("_title")


def search_works(
    works: DataFrame, versions: DataFrame, query: str | None = None, work_projects: DataFrame | None = None,
    project_id=None, limit: int | None = 50, offset: int = 0, order: str = "created_at",
) -> DataFrame:
    """Works whose normalised title, title or arXiv id contains the query, newest first, at most 200 a page.

    limit=None gives every hit, unsorted.
    """
    hits = works
    if project_id is not None:
        inside = work_projects.where(F.col("project_id") == F.lit(project_id)).select("work_id")
        hits = hits.join(inside, "work_id", "left_semi")
    primary = versions.select(
        F.col("version_id").alias("primary_version_id"), F.col("title").alias("_title"), "year", "arxiv_id", "venue_name")
    hits = hits.join(primary, "primary_version_id", "left")
    if query:
        like = lambda c: F.ilike(F.col(c), F.lit(f"%{query}%"))
        hits = hits.where(like("title_norm") | like("_title") | like("arxiv_id"))
    hits = hits.withColumn("title", tf.display_title(F.col("_title"), F.col("title_norm"))).drop("_title")
    if limit is None:
        return hits
    return paged(hits, [F.desc(order), F.desc("work_id")], min(limit, 200) if limit > 0 else 50, offset)


def with_author_names(page: DataFrame, version_authors: DataFrame, authors: DataFrame) -> DataFrame:
    """The works of a page with the names of their primary version's authors, in order; no author gives an empty list.

    The lists are as long as a work has authors: for listings of pages, `work_authors` is the flat form for all.
    """
    asked = page.select(F.col("primary_version_id").alias("version_id")).where("version_id IS NOT NULL").distinct()
    placed = F.struct("position", "author_id", "full_name")
    named = version_authors.join(asked, "version_id", "left_semi").join(authors, "author_id").groupBy("version_id").agg(
        F.transform(F.array_sort(F.collect_list(placed)), lambda a: a["full_name"]).alias("authors"))
    out = page.join(named.withColumnRenamed("version_id", "primary_version_id"), "primary_version_id", "left")
    return out.withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))


def with_shown_version(works: DataFrame, versions: DataFrame, order: str = "created_at") -> DataFrame:
    """Works whose card has a version: the primary one, or else the first that was made."""
    first = versions.groupBy("work_id").agg(F.min_by("version_id", F.struct(order, "version_id")).alias("_first"))
    shown = works.join(first, "work_id", "left")
    return shown.withColumn("primary_version_id", F.coalesce("primary_version_id", "_first")).drop("_first")


def work_authors(works: DataFrame, version_authors: DataFrame, authors: DataFrame) -> DataFrame:
    """(work_id, position, author_id, full_name) of the primary versions."""
    primary = works.where("primary_version_id IS NOT NULL").select("work_id", F.col("primary_version_id").alias("version_id"))
    return primary.join(version_authors, "version_id").join(authors, "author_id").select(
        "work_id", "position", "author_id", "full_name"
    )


def version_authors_listed(versions: DataFrame, version_authors: DataFrame, authors: DataFrame) -> DataFrame:
    """Versions of every work in order of creation, with their authors in order (none is kept too)."""
    named = version_authors.join(authors, "author_id").select("version_id", "position", "author_id", "full_name")
    return versions.join(named, "version_id", "left")


def titles_of(ids: DataFrame, works: DataFrame, versions: DataFrame) -> DataFrame:
    return titled_works(works.join(ids.select("work_id"), "work_id", "left_semi"), versions).select(
        "work_id", "title", "year"
    )


def work_cards(t) -> DataFrame:
    """Header of the card of every work: shown fields and the size of each section.

    The sections themselves are `card_sections`. `t` has the tables as attributes.
    """
    count = lambda df, name, key="work_id": df.groupBy(F.col(key).alias("work_id")).agg(F.count("*").alias(name))
    works = with_shown_version(t.works, t.versions)
    sections = [
        count(t.versions, "versions"),
        count(work_authors(works, t.version_authors, t.authors), "authors"),
        count(t.work_projects, "projects"),
        count(t.claims, "claims"),
        count(t.methods, "methods"),
        count(t.paper_aspects, "aspects"),
        count(t.reading_status, "reading"),
        annotation_counts(t.annotations),
        count(evidence_of_works(t.evidence, t.versions, t.claims, t.relation_members), "evidence"),
        count(rel.relations_of_works(t.relations, t.relation_members), "relations"),
        count(jobs_of_works(t.jobs, t.works, t.versions), "jobs"),
    ]
    out = titled_works(works, t.versions)
    for s in sections:
        name = s.columns[-1]
        out = out.join(s, "work_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def card_sections(t) -> DataFrame:
    """All sections of all cards as (work_id, section, sort_key, item_id, label)."""
    row = lambda df, section, sort, item, label: df.select(
        "work_id", F.lit(section).alias("section"), sort.cast("string").alias("sort_key"),
        item.cast("string").alias("item_id"), label.cast("string").alias("label"))
    c = F.col
    projects = t.work_projects.join(t.projects, "project_id")
    listed = rel.relations_of_works(t.relations, t.relation_members)
    parts = [
        row(t.versions, "version", c("created_at"), c("version_id"), c("title")),
        row(work_authors(with_shown_version(t.works, t.versions), t.version_authors, t.authors), "author", c("position"),
            c("author_id"), c("full_name")),
        row(projects, "project", c("name"), c("project_id"), c("name")),
        row(t.claims, "claim", c("claim_id"), c("claim_id"), c("text")),
        row(t.methods, "method", c("method_id"), c("method_id"), c("name")),
        row(t.paper_aspects, "aspect", c("aspect"), c("aspect"), c("summary")),
        row(t.reading_status, "reading", c("updated_at"), c("user_id"), c("status")),
        row(evidence_of_works(t.evidence, t.versions, t.claims, t.relation_members), "evidence", c("page"),
            c("evidence_id"), c("text")),
        row(listed, "relation", tx.listing_rank(c("review_status")), c("relation_id"), c("type")),
        row(jobs_of_works(t.jobs, t.works, t.versions), "job", c("job_id"), c("job_id"), c("kind")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def node_context(
    t, graph_works: DataFrame, comments: DataFrame, related: DataFrame, latest: int | None = 50
) -> DataFrame:
    """Sections of a node read by an assistant: card subset, latest comments (50, or all), relations around it.

    Only works that a graph holds are its nodes. `comments` are the visible ones; `related` is
    `relations.node_relations`.
    """
    wanted = ["version", "author", "claim", "method", "aspect", "evidence"]
    cards = card_sections(t).where(F.col("section").isin(wanted))
    node = ["graph_id", "work_id"]
    held = graph_works.select(*node).distinct()
    comments, related = comments.join(held, node, "left_semi"), related.join(held, node, "left_semi")
    nodes = related.select(*node).union(comments.select(*node)).distinct()
    recent = comments
    if latest is not None:
        recent = top_k(comments, node, [F.desc("created_at"), F.desc("comment_id")], latest)
    return (
        nodes.join(cards, "work_id")
        .unionByName(
            recent.select(
                "graph_id", "work_id", F.lit("comment").alias("section"), F.col("created_at").cast("string").alias("sort_key"),
                F.col("comment_id").cast("string").alias("item_id"), F.col("body").alias("label"))
        )
        .unionByName(
            related.select(
                "graph_id", "work_id", F.col("kind").alias("section"), "direction",
                F.coalesce("ref", F.col("neighbor_work_id").cast("string")).alias("item_id"), F.col("detail").alias("label"),
            ).withColumnRenamed("direction", "sort_key")
        )
    )


# --- claims and evidence --------------------------------------------------------------------


def claims_listed(claims: DataFrame, evidence: DataFrame, judgments: DataFrame, reviews: DataFrame) -> DataFrame:
    """(claim …, part, part_id, detail): one row per claim and one per evidence and judgment of it."""
    base = claims.select("work_id", "claim_id", "text", "review_status")
    quotes = evidence.where("claim_id IS NOT NULL").select(
        "claim_id", F.lit("evidence").alias("part"), F.col("evidence_id").alias("part_id"), F.col("text").alias("detail"))
    said = judgment_disputes(judgments, reviews).select(
        "claim_id", F.lit("judgment").alias("part"), F.col("judgment_id").alias("part_id"),
        F.concat_ws(" ", "verdict", F.when(F.col("disputed"), "disputed")).alias("detail"))
    parts = quotes.unionByName(said)
    return base.join(parts, "claim_id", "left")


def evidence_of_works(evidence: DataFrame, versions: DataFrame, claims: DataFrame, members: DataFrame) -> DataFrame:
    """(work_id, evidence …): quoted from its versions, for its claims, or for relations anchored on it."""
    own = evidence.join(versions.select("version_id", "work_id"), "version_id").select("evidence_id", "work_id")
    for_claims = evidence.join(claims.select("claim_id", "work_id"), "claim_id").select("evidence_id", "work_id")
    anchored = members.where("anchor_work_id IS NOT NULL").select("relation_id", F.col("anchor_work_id").alias("work_id"))
    for_relations = evidence.join(anchored, "relation_id").select("evidence_id", "work_id")
    return own.union(for_claims).union(for_relations).distinct().join(evidence, "evidence_id")


def evidence_by(evidence: DataFrame, key: str, value=None) -> DataFrame:
    """Evidence of claims, versions, relations or extracted fields; of one of them when `value` is given."""
    bound = evidence.where(F.col(key).isNotNull())
    return bound if value is None else bound.where(F.col(key) == F.lit(value))


def relation_details(relations: DataFrame, members: DataFrame, evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """(relation_id, type, review_status, part, sort_key, part_id, detail): members, evidence and votes."""
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    part = lambda df, name, sort, item, detail: df.select(
        "relation_id", F.lit(name).alias("part"), s(sort).alias("sort_key"), s(item).alias("part_id"),
        s(detail).alias("detail"))
    votes = reviews.where("subject_kind = 'relation'").withColumnRenamed("subject_id", "relation_id")
    parts = (
        part(members, "member", "position", "entity_id", F.concat_ws(" ", "role", "entity_kind"))
        .unionByName(part(evidence.where("relation_id IS NOT NULL"), "evidence", "page", "evidence_id", "text"))
        .unionByName(part(votes, "review", F.unix_micros(F.col("created_at").cast("timestamp")), "review_id", "verdict"))
    )
    return relations.select("relation_id", "type", "review_status").join(parts, "relation_id", "left")


# --- projects, groups, access -----------------------------------------------------------------


def project_coverage(
    projects: DataFrame, work_projects: DataFrame, works: DataFrame, versions: DataFrame, reading: DataFrame,
    users: DataFrame,
) -> DataFrame:
    """Every work of every project with the people who opened it; works nobody opened stay."""
    readers = (
        reading.where("status <> 'unread'").join(users, "user_id")
        .select("work_id", "user_id", F.col("name").alias("reader"), "status", "starred")
    )
    titled = titled_works(works, versions).select("work_id", "title")
    return (
        work_projects.join(projects.select("project_id"), "project_id")
        .join(titled, "work_id")
        .join(readers, "work_id", "left")
    )


def projects_of_works(projects: DataFrame, work_projects: DataFrame) -> DataFrame:
    return work_projects.join(projects, "project_id")


def groups_of_users(groups: DataFrame, members: DataFrame, graphs: DataFrame) -> DataFrame:
    """(user_id, group …, role, members, graphs) of every membership."""
    sizes = members.groupBy("group_id").agg(F.count("*").alias("members"))
    n_graphs = graphs.groupBy("group_id").agg(F.count("*").alias("graphs"))
    return (
        members.join(groups, "group_id").join(sizes, "group_id").join(n_graphs, "group_id", "left")
        .withColumn("graphs", F.coalesce("graphs", F.lit(0).cast("long")))
    )


def graphs_of_groups(groups: DataFrame, graphs: DataFrame, graph_works: DataFrame) -> DataFrame:
    """Every group with its graphs and their sizes; groups without graphs stay."""
    sizes = graph_works.groupBy("graph_id").agg(F.count("*").alias("works"))
    sized = (
        graphs.withColumnRenamed("name", "graph_name").join(sizes, "graph_id", "left")
        .withColumn("works", F.coalesce("works", F.lit(0).cast("long")))
    )
    return groups.withColumnRenamed("name", "group_name").join(sized, "group_id", "left")


def members_listed(members: DataFrame, users: DataFrame) -> DataFrame:
    return members.join(users, "user_id")


def graphs_visible_to_users(members: DataFrame, graphs: DataFrame) -> DataFrame:
    """(user_id, graph_id) pairs allowed through group membership."""
    return members.select("user_id", "group_id").join(graphs.select("graph_id", "group_id"), "group_id").select(
        "user_id", "graph_id"
    )


def accessible_works(graph_works: DataFrame, graphs: DataFrame, members: DataFrame, user_id) -> DataFrame:
    """Graph memberships one user may read."""
    mine = members.where(F.col("user_id") == F.lit(user_id)).select("group_id")
    allowed = graphs.join(mine, "group_id", "left_semi").select("graph_id")
    return graph_works.join(allowed, "graph_id", "left_semi")


def reading_listed(reading: DataFrame, work_id=None, user_id=None) -> DataFrame:
    """Reading states of a work or a user, newest first."""
    rows = reading
    if work_id is not None:
        rows = rows.where(F.col("work_id") == F.lit(work_id))
    if user_id is not None:
        rows = rows.where(F.col("user_id") == F.lit(user_id))
    return rows.orderBy(F.desc("updated_at"), "user_id", "work_id")


# --- comments and annotations -------------------------------------------------------------------


def visible_to(rows: DataFrame, viewer_id) -> DataFrame:
    """Team rows and the viewer's own."""
    return rows.where((F.col("visibility") == "team") | (F.col("user_id") == F.lit(viewer_id)))


def annotation_counts(annotations: DataFrame) -> DataFrame:
    """(work_id, annotations): all of a work's, whoever may read them."""
    return annotations.groupBy("work_id").agg(F.count("*").alias("annotations"))


def comments_with_authors(comments: DataFrame, users: DataFrame, viewer_id) -> DataFrame:
    named = users.select("user_id", F.col("name").alias("author_name"))
    return visible_to(comments, viewer_id).join(named, "user_id")


def filter_comments(
    comments: DataFrame, viewer_id, graph_id=None, work_id=None, since=None, kinds: list[str] | None = None,
    limit: int | None = 200, order: str = "updated_at",
) -> DataFrame:
    """What a viewer may read of the comments on a work in a graph, changed after a moment, of given kinds.

    Newest first, 1 to 1 000 of them; `limit` None gives all. Without `graph_id` or `work_id` all of them count.
    """
    rows = visible_to(comments, viewer_id)
    for column, value in (("graph_id", graph_id), ("work_id", work_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if since is not None:
        rows = rows.where(F.col(order) > (since if not isinstance(since, (int, str)) else F.lit(since)))
    if kinds is not None:
        rows = rows.where(F.col("kind").isin([k.lower() for k in kinds]))
    if limit is None:
        return rows
    return rows.orderBy(F.desc(order), F.desc("comment_id")).limit(max(1, min(limit, 1000)))


def comment_counts(comments: DataFrame, viewer_id) -> DataFrame:
    return visible_to(comments, viewer_id).groupBy("graph_id", "work_id").agg(F.count("*").alias("comments"))


def validate_comments(new: DataFrame, stored: DataFrame, graph_works: DataFrame) -> DataFrame:
    """New comments with the trimmed body and the reasons to refuse them (empty array: accepted)."""
    parent = stored.select(
        F.col("comment_id").alias("parent_id"), F.col("graph_id").alias("_graph"), F.col("work_id").alias("_work"),
        F.col("user_id").alias("_user"), (F.col("visibility") == "private").alias("_private"))
    member = graph_works.select("graph_id", "work_id", F.lit(True).alias("_member")).distinct()
    body = tf.strip(F.col("body"))
    is_reply = F.col("parent_id").isNotNull()
    found = F.col("_graph").isNotNull()
    hidden = found & F.col("_private") & (F.col("_user") != F.col("user_id"))
    reason = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    joined = new.join(parent, "parent_id", "left").join(member, ["graph_id", "work_id"], "left")
    return joined.select(
        *[body.alias("body") if c == "body" else F.col(c) for c in new.columns],
        F.array_compact(
            F.array(
                reason(body == "", "body required"),
                reason(F.char_length(body) > MAX_BODY, "body too long"),
                reason(F.col("_member").isNull(), "work not in graph"),
                reason(is_reply & (~found | hidden), "unknown parent"),
                reason(found & ((F.col("_graph") != F.col("graph_id")) | (F.col("_work") != F.col("work_id"))),
                       "parent elsewhere"),
                reason(found & F.col("_private") & ~hidden & (F.col("visibility") != "private"), "reply must be private"),
            )
        ).alias("reasons"),
    )


def comment_threads(comments: DataFrame) -> DataFrame:
    """Roots with their direct replies (root row kept without replies). `comments` are the visible ones."""
    roots = comments.where("parent_id IS NULL").select(
        "graph_id", "work_id", F.col("comment_id").alias("root_id"), F.col("body").alias("root_body"))
    replies = comments.where("parent_id IS NOT NULL").select(
        F.col("parent_id").alias("root_id"), F.col("comment_id").alias("reply_id"), F.col("body").alias("reply_body"),
        F.col("created_at").alias("reply_ord"))
    return roots.join(replies, "root_id", "left")


def patch_comments(comments: DataFrame, patches: DataFrame) -> DataFrame:
    """Author-only edits: comment_id, user_id, new_body, new_kind, new_visibility, moment.

    An empty patch and a blank or too long body are refused as a whole.
    """
    body = tf.strip(F.col("new_body"))
    sane = F.col("new_body").isNull() | ((body != "") & (F.char_length(body) <= MAX_BODY))
    given = F.coalesce("new_body", "new_kind", "new_visibility").isNotNull()
    usable = patches.where(sane & given).withColumn("new_body", body)
    joined = comments.join(usable, ["comment_id", "user_id"], "left")
    new = {"body": "new_body", "kind": "new_kind", "visibility": "new_visibility", "updated_at": "moment"}
    return joined.select(*[F.coalesce(new[c], c).alias(c) if c in new else F.col(c) for c in comments.columns])


def delete_own_comments(comments: DataFrame, requests: DataFrame) -> DataFrame:
    """Author-only delete (comment_id, user_id); replies of a deleted comment become roots."""
    key = ["comment_id", "user_id"]
    gone = comments.join(requests.select(*key), key, "left_semi").select(
        F.col("comment_id").alias("parent_id"), F.lit(True).alias("_orphan"))
    left = comments.join(requests.select(*key), key, "left_anti").join(gone, "parent_id", "left")
    parent = F.when(F.col("_orphan").isNull(), F.col("parent_id"))
    return left.withColumn("parent_id", parent).select(*comments.columns)


def delete_own_annotations(annotations: DataFrame, requests: DataFrame) -> DataFrame:
    """Author-only delete (annotation_id, user_id); all replies below go with it.

    Every annotation looks at ancestors at doubling distance: after r rounds it knows whether one of its nearest
    2 ** r is deleted, so the rounds follow the logarithm of the deepest thread. Replies to a missing annotation
    stay; so do threads that reply to themselves, unless one of them is deleted.
    """
    key = ["annotation_id", "user_id"]
    asked = requests.select(*key).distinct().withColumn("gone", F.lit(True))
    gone = F.coalesce("gone", F.lit(False))
    seen = annotations.join(asked, key, "left").select(
        "annotation_id", F.when(~gone, F.col("parent_id")).alias("above"), gone.alias("gone"))
    for _ in range(MOST_DOUBLINGS):
        seen = materialize(seen, "ancestors")
        if seen.where("above IS NOT NULL").isEmpty():
            break
        up = seen.select(F.col("annotation_id").alias("above"), F.col("above").alias("_above"), F.col("gone").alias("_gone"))
        lost = F.col("gone") | F.coalesce("_gone", F.lit(False))
        seen = left_known(seen, up, "above").select("annotation_id", F.when(~lost, F.col("_above")).alias("above"), lost.alias("gone"))
    return annotations.join(seen.where("gone").select("annotation_id"), "annotation_id", "left_anti").select(*annotations.columns)


# --- jobs and views -----------------------------------------------------------------------------


def jobs_of_works(jobs: DataFrame, works: DataFrame, versions: DataFrame) -> DataFrame:
    """(work_id, job …): jobs whose payload names the work or one of its versions."""
    named = jobs.select(
        "*", F.get_json_object("payload", "$.work_id").alias("_work"),
        F.get_json_object("payload", "$.version_id").alias("_version"))
    by_work = named.join(works.select("work_id", F.col("work_id").cast("string").alias("_work")), "_work")
    by_version = named.join(
        versions.select("work_id", F.col("version_id").cast("string").alias("_version")), "_version")
    columns = ["work_id", *jobs.columns]
    return by_work.select(*columns).union(by_version.select(*columns)).distinct()


def saved_views(views: DataFrame) -> DataFrame:
    """Views with parsed weights, newest first; a missing weight is 0."""
    w = F.from_json("weights", schemas.WEIGHTS_JSON)
    weight = lambda name: F.coalesce(w[name], F.lit(0.0)).alias(name)
    parsed = F.struct(weight("citation_coupling"), weight("method_lineage"), weight("topic"))
    return views.withColumn("weights", parsed).orderBy(F.desc("view_id"))
