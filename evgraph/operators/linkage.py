"""Record linkage: which known work is meant, and what becomes of records nobody knows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.functions import text as tf
from evgraph.functions.scores import synthetic_id
from evgraph.operators.tables import left_known
from evgraph.session import materialize


def _directory(df: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """key -> smallest value: one row per key, so a lookup never multiplies records."""
    present = df
    for c in key:
        present = present.where(F.col(c).isNotNull())
    return present.groupBy(*key).agg(F.min(value).alias(name))


def _title_year_directory(works: DataFrame, versions: DataFrame, name: str) -> DataFrame:
    primary = versions.select(F.col("version_id").alias("primary_version_id"), "year")
    return _directory(works.join(primary, "primary_version_id"), ["title_norm", "year"], "work_id", name)


def resolve_works(records: DataFrame, works: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds matched_work_id and match_kind: arxiv, else doi, else title+year (year known), else new.

    `records`: arxiv_id, doi, title, year and anything else.
    """
    by_arxiv = _directory(versions, ["arxiv_id"], "work_id", "_by_arxiv")
    by_doi = _directory(versions, ["doi"], "work_id", "_by_doi")
    by_title = _title_year_directory(works, versions, "_by_title")
    keyed = records.withColumn("title_norm", tf.normalize_title(F.col("title")))
    found = left_known(left_known(keyed, by_arxiv, "arxiv_id"), by_doi, "doi")
    found = left_known(found, by_title, "title_norm", "year")
    return found.withColumn("matched_work_id", F.coalesce("_by_arxiv", "_by_doi", "_by_title")).withColumn(
        "match_kind",
        F.when(F.col("_by_arxiv").isNotNull(), "arxiv")
        .when(F.col("_by_doi").isNotNull(), "doi")
        .when(F.col("_by_title").isNotNull(), "title_year")
        .otherwise("new"),
    ).drop("_by_arxiv", "_by_doi", "_by_title")


def assign_new_works(unmatched: DataFrame) -> DataFrame:
    """Groups records no library work matches, as if they were added one after the other.

    `unmatched`: seq (unique order), arxiv_id, doi, title_norm, year. A record founds a work unless an
    earlier founder has its arXiv id, DOI, or title and year; otherwise it joins that founder, trying
    the keys in this order. Adds founder_seq and link_kind (new, arxiv, doi, title_year). Identifiers
    of a record that joined are not added to the work, so chains are settled in rounds: the records
    first under all their open keys become founders, and records with a founder's key leave.
    """
    keys = ["arxiv", "doi", "title_year"]
    keyed = unmatched.select(
        "seq", F.col("arxiv_id").alias("arxiv"), "doi",
        F.when(F.col("year").isNotNull(), F.concat_ws("|", "title_norm", "year")).alias("title_year"))
    rounds, open_rows = [], keyed
    while True:
        open_rows = materialize(open_rows, "open-records")
        if open_rows.isEmpty():
            break
        ranked, is_first = open_rows, F.lit(True)
        for k in keys:
            head = open_rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("seq").alias(f"first_{k}"))
            ranked = left_known(ranked, head, k)
            is_first = is_first & (F.col(k).isNull() | (F.col(f"first_{k}") == F.col("seq")))
        founders = materialize(ranked.where(is_first).select("seq", *keys), "founders")
        rounds.append(founders)
        open_rows = open_rows.join(founders.select("seq"), "seq", "left_anti")
        for k in keys:
            open_rows = open_rows.join(founders.where(F.col(k).isNotNull()).select(k), k, "left_anti")
    linked = keyed
    for k in keys:
        owners = None
        for founders in rounds:
            own = founders.where(F.col(k).isNotNull()).select(k, F.col("seq").alias(f"by_{k}"))
            owners = own if owners is None else owners.unionByName(own)
        linked = left_known(linked, owners, k) if rounds else linked.withColumn(f"by_{k}", F.col("seq"))
    earlier = [F.when(F.col(f"by_{k}") < F.col("seq"), F.col(f"by_{k}")) for k in keys]
    kind = F.when(earlier[0].isNotNull(), keys[0])
    for k, by in zip(keys[1:], earlier[1:]):
        kind = kind.when(by.isNotNull(), k)
    settled = linked.select(
        "seq", F.coalesce(*earlier, F.col("seq")).alias("founder_seq"), kind.otherwise("new").alias("link_kind"))
    return unmatched.join(settled, "seq")


def new_works(founders: DataFrame, created_by=None) -> tuple[DataFrame, DataFrame]:
    """Work and primary version rows of records that found a work (seq, kind, ids, url, title, year)."""
    keyed = founders.withColumn("work_id", synthetic_id(F.lit("work"), F.col("seq"))).withColumn(
        "version_id", synthetic_id(F.lit("version"), F.col("seq"))
    )
    works = keyed.select(
        "work_id", tf.normalize_title(F.col("title")).alias("title_norm"),
        F.col("version_id").alias("primary_version_id"), F.lit(created_by).alias("created_by"))
    versions = keyed.select("version_id", "work_id", "kind", "arxiv_id", "doi", "url", "title", "year")
    return works, versions


def link_authors(authors: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new authors, version links): `names` has version_id and names array<string> in order.

    A name matches an author exactly; a name repeated on one version keeps its first position.
    """
    listed = names.select("version_id", F.posexplode("names").alias("position", "full_name"))
    first = listed.groupBy("version_id", "full_name").agg(F.min("position").alias("position"))
    known = authors.groupBy("full_name").agg(F.min("author_id").cast("string").alias("author_id"))
    unknown = first.select("full_name").distinct().join(known, "full_name", "left_anti")
    invented = synthetic_id(F.lit("author"), F.col("full_name"))
    added = unknown.select(invented.alias("author_id"), "full_name")
    # an unknown name gives its id itself: links need not meet the new authors
    held = first.where("full_name IS NOT NULL").join(known.withColumn("_known", F.lit(True)), "full_name", "left")
    author_id = F.when(F.col("_known"), F.col("author_id")).otherwise(invented)
    return added, held.select("version_id", author_id.alias("author_id"), "position")


def clean_references(references: DataFrame) -> DataFrame:
    """Explodes `references` (work_id, references array<struct>) and keeps entries with an identity."""
    r = F.col("ref")
    trimmed = references.select("work_id", F.posexplode("references").alias("position", "ref")).select(
        "work_id", "position",
        tf.blank_to_null(tf.strip(r["title"])).alias("title"),
        tf.blank_to_null(F.regexp_replace(tf.strip(r["arxiv_id"]), "^(?:arXiv:)+", "")).alias("arxiv_id"),
        tf.blank_to_null(tf.strip(r["doi"])).alias("doi"),
        r["year"].alias("year"),
    )
    return trimmed.where("title IS NOT NULL OR arxiv_id IS NOT NULL OR doi IS NOT NULL")


def resolve_citations(references: DataFrame, versions: DataFrame) -> DataFrame:
    """Cited work by arXiv id when there is one, else by DOI; unresolved references keep their text."""
    by_arxiv = _directory(versions, ["arxiv_id"], "work_id", "_by_arxiv")
    by_doi = _directory(versions, ["doi"], "work_id", "_by_doi")
    found = left_known(left_known(references, by_arxiv, "arxiv_id"), by_doi, "doi")
    cited = F.when(F.col("arxiv_id").isNotNull(), F.col("_by_arxiv")).otherwise(F.col("_by_doi"))
    external = F.struct("title", "arxiv_id", "doi", "year")
    return found.select(
        F.col("work_id").alias("citing_work_id"), "position", cited.alias("cited_work_id"),
        F.when(cited.isNull(), external).alias("cited_external"))


def replace_citations(citations: DataFrame, processed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Citations after the `processed` works (work_id) were read again; `fresh` are their new rows."""
    done = processed.select(F.col("work_id").alias("citing_work_id")).distinct()
    return citations.join(done, "citing_work_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def resolve_bibliography(entries: DataFrame, works: DataFrame, versions: DataFrame) -> DataFrame:
    """Work meant by a bibliography entry: arXiv id, else DOI, else normalised title."""
    by_arxiv = _directory(versions, ["arxiv_id"], "work_id", "_by_arxiv")
    by_doi = _directory(versions, ["doi"], "work_id", "_by_doi")
    by_title = _directory(works, ["title_norm"], "work_id", "_by_title")
    found = entries.withColumn("title_norm", tf.normalize_title(F.col("title")))
    for directory, key in ((by_arxiv, "arxiv_id"), (by_doi, "doi"), (by_title, "title_norm")):
        found = left_known(found, directory, key)
    return (
        found.withColumn("resolved_work_id", F.coalesce("_by_arxiv", "_by_doi", "_by_title"))
        .drop("_by_arxiv", "_by_doi", "_by_title", "title_norm")
    )


def repair_primary(works: DataFrame, versions: DataFrame, order: str = "created_at") -> DataFrame:
    """Works whose primary version is missing or belongs to another work get their earliest version."""
    owned = versions.select("work_id", F.col("version_id").alias("primary_version_id"), F.lit(True).alias("_owned"))
    earliest = versions.groupBy("work_id").agg(F.min_by("version_id", F.struct(order, "version_id")).alias("_first"))
    return (
        works.join(owned, ["work_id", "primary_version_id"], "left")
        .join(earliest, "work_id", "left")
        .withColumn("primary_version_id", F.when(F.col("_owned"), F.col("primary_version_id")).otherwise(F.col("_first")))
        .drop("_owned", "_first")
    )


def patch_versions(versions: DataFrame, works: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Non-null patch values win; a new title renames the work.

    `patches`: version_id, title, abstract, full_text, year, venue_name, doi, metadata_source. Without
    an abstract the first 1 500 characters of the text stand in.
    """
    fields = ["title", "abstract", "year", "venue_name", "doi", "metadata_source"]
    has = [c for c in fields if c in versions.columns]
    new = patches.select(
        "version_id",
        *[
            (F.coalesce("abstract", F.substring("full_text", 1, 1500)) if c == "abstract" else F.col(c)).alias(f"_{c}")
            for c in has
        ],
    )
    joined = versions.join(new, "version_id", "left")
    patched = joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in has else F.col(c) for c in versions.columns])
    renamed = (
        joined.where("_title IS NOT NULL")
        .groupBy("work_id")
        .agg(F.max_by("_title", "version_id").alias("_title"))
        .select("work_id", tf.normalize_title(F.col("_title")).alias("_norm"))
    )
    named = (
        works.join(renamed, "work_id", "left").withColumn("title_norm", F.coalesce("_norm", "title_norm")).drop("_norm")
    )
    return patched, named


# --- bibliography and citation contexts in TEI documents ----------------------------------

# Entry and reference markup.
ENTRY = r'(?is)<biblStruct\b[^>]*xml:id=["\']([^"\']+)["\'][^>]*>.*?</biblStruct>'
ENTRY_ANY = r"(?s)<biblStruct.*?</biblStruct>"


def _tag_text(block: Column, tag: str) -> Column:
    return tf.blank_to_null(tf.strip_markup_joined(F.regexp_extract(block, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)))


def _idno(block: Column, kind: str) -> Column:
    raw = F.regexp_extract(block, rf"(?is)<idno[^>]*type=[\"']{kind}[\"'][^>]*>(.*?)</idno>", 1)
    return tf.blank_to_null(F.regexp_replace(tf.strip_tags(raw), r"[\s\x85\p{Z}]+", ""))


def tei_bibliography(documents: DataFrame, text: str = "tei") -> DataFrame:
    """Bibliography entries of whole documents: doc key columns, position, target, title, ids, year."""
    keep = [c for c in documents.columns if c != text]
    blocks = F.regexp_extract_all(F.col(text), F.lit(ENTRY_ANY), F.lit(0))
    block = F.col("block")
    arxiv = F.regexp_replace(_idno(block, "arXiv"), "^(?:arXiv:)+", "")
    entries = documents.select(*keep, F.posexplode(blocks).alias("position", "block")).select(
        *keep, "position",
        F.concat(F.lit("#"), tf.blank_to_null(F.regexp_extract(block, ENTRY, 1))).alias("target"),
        _tag_text(block, "title").alias("title"),
        tf.blank_to_null(arxiv).alias("arxiv_id"),
        _idno(block, "DOI").alias("doi"),
        tf.publication_year(block).alias("year"),
    )
    return entries.where("title IS NOT NULL OR arxiv_id IS NOT NULL OR doi IS NOT NULL")
