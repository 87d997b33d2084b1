"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame functions only.

Every version of every file is named by the SHA-256 of its bytes. A blob is scanned once for each version of each
rule: the ledger keeps which (blob, rule, version) pairs were scanned and what was found, and a later scan reads only
the texts of blobs with unseen pairs. Findings are joined back to all paths that hold the blob.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.session import fresh_path, materialize

SCANNED = "blob string, rule string, version int"
FINDINGS = "blob string, rule string, start long, end long"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`; those whose `group` has under `least` characters are dropped.

    `hint` is a pattern that every text with a match must hold: it spares the others the search.
    """

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None
    version: int = 1


# The shapes of secrets.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
    Rule("block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("login", r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
BASE = ("assign", "access", "hex")


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> in code points, end exclusive: the gaps between matches give their places."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = matches if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    step = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match"), sized.alias("sized")),
        lambda m: F.struct(
            F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("match"), (F.length(m["sized"]) >= rule.least).alias("kept")
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("found"))
    walked = F.aggregate(
        step,
        start,
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["match"]).alias("at"),
            F.when(
                m["kept"],
                F.concat(
                    acc["found"],
                    F.array(F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["match"]).alias("end"))),
                ),
            ).otherwise(acc["found"]).alias("found"),
        ),
    )
    return walked["found"]


class Ledger:
    """Tables `scanned` (SCANNED) and `findings` (FINDINGS) under a shared folder, appended to by each scan."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("scanned", SCANNED), ("findings", FINDINGS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    @property
    def scanned(self) -> DataFrame:
        return self.spark.read.schema(SCANNED).parquet(f"{self.path}/scanned").distinct()

    @property
    def findings(self) -> DataFrame:
        """A scan that was broken off and repeated may have written rows twice: they count once."""
        return self.spark.read.schema(FINDINGS).parquet(f"{self.path}/findings").distinct()


def address(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """`files` with the column blob: SHA-256 of the text's bytes; a null text is the empty blob."""
    return files.withColumn("blob", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def scan(files: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans the unseen (blob, rule version) pairs of `files` (path, text) and records them; returns path and blob.

    Each unseen blob is read at one of its paths only. Findings are written before the pairs that name them, so that
    a scan that is broken off is repeated, not lost. Null paths can hold a blob, but a blob is scanned only where
    some path is not null; with null paths alone the text stands for itself.
    """
    own = files.select(F.col("path").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paths = materialize(address(own).select("path", "blob"), "paths")
    blobs = paths.groupBy("blob").agg(F.min("path").alias("reader"))
    known = ledger.scanned
    versions = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    asked = blobs.withColumn("pair", F.explode(versions)).select("blob", "reader", "pair.*")
    unseen = materialize(
        asked.join(known, ["blob", "rule", "version"], "left_anti")
        .groupBy("blob", "reader")
        .agg(F.collect_set("rule").alias("rules")),  # at most the number of rules
        "unseen",
    )
    here = address(own)  # a path may hold many versions: only the named one is read
    same = (here.blob == F.col("named")) & here.path.eqNullSafe(F.col("reader"))
    texts = here.join(unseen.withColumnRenamed("blob", "named").hint("shuffle_hash"), same)
    searched = texts.select(
        F.col("named").alias("blob"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(r.name).alias("rule"),
                        F.when(F.array_contains("rules", r.name) & F.col("text").rlike(r.hint or r.pattern), spans(F.col("text"), r)).alias("spans"),
                    )
                    for r in rules
                ]
            )
        ).alias("f"),
    ).filter(F.size("f.spans") > 0)
    found = searched.select("blob", "f.rule", F.explode("f.spans").alias("s")).select("blob", "rule", "s.start", "s.end")
    found.write.mode("append").parquet(f"{ledger.path}/findings")
    done = asked.join(known, ["blob", "rule", "version"], "left_anti").select("blob", "rule", "version")
    done.write.mode("append").parquet(f"{ledger.path}/scanned")
    return paths


def secrets(files: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob and spans of every row of `files` (path, text): array of (start, kind, rule, end) ordered by place.

    `kind` is the place of the rule in `rules`. Texts without a finding, null and empty ones get an empty array;
    repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    paths = scan(files, ledger, rules)
    none = F.array().cast("array<struct<start:bigint,kind:int,rule:string,end:bigint>>")
    found = paths.join(blob_spans(ledger, rules), "blob", "left")
    return found.select("path", "blob", F.coalesce("spans", none).alias("spans"))


def blob_spans(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and spans of each blob in which the ledger knows a finding of `rules`."""
    kinds = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    return (
        ledger.findings.withColumn("kind", kinds[F.col("rule")])
        .filter(F.col("kind").isNotNull())
        .groupBy("blob")  # the findings of one text
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "rule", "end"))).alias("spans"))
    )


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined, in the order of `found`."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")


def fresh_ledger(spark) -> Ledger:
    return Ledger(spark, fresh_path(spark, "ledger"))


def redacted(text: Column, found: Column) -> Column:
    """`text` with each span replaced by its kind in angle brackets; of overlapping spans the first one counts."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
    walked = F.aggregate(
        found,
        start,
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                    F.lit("<"), s["rule"], F.lit(">"),
                ).alias("done"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["done"].alias("done"))),
    )
    return F.concat(walked["done"], F.substring(text, (walked["at"] + 1).cast("int"), F.length(text)))
