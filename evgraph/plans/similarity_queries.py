"""G: neighbour lists and the views derived from them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.operators import reads
from evgraph.operators import similarity as sim
from evgraph.plans.registry import query
from evgraph.session import materialize


def rounded(df, *keep):
    return df.select(*keep, F.round("score", 6).alias("score"))


@query("g1_bibliographic_coupling", "SELECT work_id, neighbor_work_id, round(score, 6) AS score FROM coupling_top")
def _(t):
    return rounded(sim.bibliographic_coupling(t.citations), "work_id", "neighbor_work_id")


@query("g2_co_citation", "SELECT work_id, neighbor_work_id, round(score, 6) AS score FROM cocite_top")
def _(t):
    return rounded(sim.co_citation(t.citations), "work_id", "neighbor_work_id")


@query("g3_citation_neighbors", "SELECT work_id, neighbor_work_id, round(score, 6) AS score FROM cite_neighbors")
def _(t):
    return rounded(sim.citation_neighbors(t.citations), "work_id", "neighbor_work_id")


@query("g4_lineage_edges", "SELECT work_id, neighbor_work_id, length FROM lineage_both")
def _(t):
    return sim.lineage_edges(t.relations, t.relation_members)


@query("g5_lineage_neighbors", "SELECT work_id, neighbor_work_id, round(score, 6) AS score FROM lineage_neighbors")
def _(t):
    edges = sim.lineage_edges(t.relations, t.relation_members)
    return rounded(sim.lineage_neighbors(edges), "work_id", "neighbor_work_id")


@query("g6_aspect_neighbors", "SELECT dimension, work_id, neighbor_work_id, round(score, 6) AS score FROM aspect_neighbors")
def _(t):
    return rounded(sim.aspect_neighbors(t.embeddings), "dimension", "work_id", "neighbor_work_id")


@query("g6_cosine_directed", "SELECT field, work_id, neighbor_work_id, round(score, 6) AS score FROM cosine_top")
def _(t):
    return rounded(sim.cosine_neighbors(t.embeddings), "field", "work_id", "neighbor_work_id")


_BUILDERS = {
    "citation_coupling": lambda t: sim.citation_neighbors(t.citations),
    "method_lineage": lambda t: sim.lineage_neighbors(sim.lineage_edges(t.relations, t.relation_members)),
}
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored_neighbors(t, dimension):
    """The neighbour lists of one dimension: a table that is built once per application and input folder."""
    key = (t.spark.sparkContext.applicationId, t.directory, dimension)
    if key not in _STORED:
        built = _BUILDERS[dimension](t).select(F.lit(dimension).alias("dimension"), "work_id", "neighbor_work_id", "score")
        _STORED[key] = materialize(built, "neighbors")
    return _STORED[key]


def graph_neighbors(t):
    return stored_neighbors(t, "citation_coupling").unionByName(stored_neighbors(t, "method_lineage"))


_BLEND = """SELECT work_id, neighbor_work_id, sum(score * CASE dimension WHEN 'citation_coupling' THEN 0.7 ELSE 0.5 END / 1.2) AS score
    FROM graph_neighbors GROUP BY 1, 2"""


def blended(t):
    return sim.blend(graph_neighbors(t), {"citation_coupling": 0.7, "method_lineage": 0.5})


@query("g7_blended_scores", f"SELECT work_id, neighbor_work_id, round(score, 6) AS score FROM ({_BLEND})")
def _(t):
    return rounded(blended(t), "work_id", "neighbor_work_id")


@query("g8_drawn_neighbors", """
    SELECT work_id, neighbor_work_id, round(score, 6) AS score FROM aspect_neighbors WHERE dimension = 'aspect_problem' AND score >= 0.28
    QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY score DESC, neighbor_work_id) <= 12""")
def _(t):
    return rounded(sim.single_dimension(sim.aspect_neighbors(t.embeddings), "aspect_problem"), "work_id", "neighbor_work_id")


@query("g8_layout_neighbors", """
    SELECT work_id, neighbor_work_id, round(score, 6) AS score FROM lineage_neighbors WHERE score >= 0.4
    QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY score DESC, neighbor_work_id) <= 6""")
def _(t):
    near = sim.single_dimension(stored_neighbors(t, "method_lineage"), "method_lineage", 6, 0.4)
    return rounded(near, "work_id", "neighbor_work_id")


_TOP_BLEND = f"""SELECT work_id, neighbor_work_id, score FROM ({_BLEND}) WHERE score >= 0.05
    QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY round(score, 12) DESC, neighbor_work_id) <= 6"""


@query("g9_strongest_blended", f"SELECT work_id, neighbor_work_id, round(score, 6) AS score FROM ({_TOP_BLEND})")
def _(t):
    return rounded(sim.strongest_blended(blended(t)), "work_id", "neighbor_work_id")


_PAIRS = "SELECT least(work_id, neighbor_work_id) AS source_id, greatest(work_id, neighbor_work_id) AS target_id, max(score) AS score FROM {0} GROUP BY 1, 2"


@query("g10_layout_springs", f"""
    SELECT source_id, target_id, round(score, 6) AS score,
           round(90 + 430 * pow(1 - greatest(0, least(1, score)), 1.6), 4) AS ideal_length,
           round(0.08 + 5.5 * pow(greatest(0, least(1, (score - 0.35) / 0.55)), 4), 4) AS elasticity
    FROM ({_PAIRS.format('aspect_neighbors')})""")
def _(t):
    springs = sim.layout_springs(sim.aspect_neighbors(t.embeddings))
    return springs.select(
        "source_id", "target_id", F.round("score", 6).alias("score"), F.round("ideal_length", 4).alias("ideal_length"),
        F.round("elasticity", 4).alias("elasticity"))


@query("g11_unconnected_works", "SELECT work_id FROM works WHERE work_id NOT IN (SELECT work_id FROM lineage_neighbors)")
def _(t):
    lines = sim.lineage_neighbors(sim.lineage_edges(t.relations, t.relation_members))
    return sim.unconnected(t.works.select("work_id"), lines)


@query("g12_visible_similarity", f"""
    SELECT source_id, target_id, round(score, 6) AS score FROM ({_PAIRS.format('cite_neighbors')}) WHERE score >= 0.04""")
def _(t):
    return rounded(sim.visible_similarity(sim.citation_neighbors(t.citations), 0.04), "source_id", "target_id")


@query("d23_saved_views", """
    WITH v AS (SELECT c_custkey AS view_id, (c_custkey % 4) / 4.0::DOUBLE AS a, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 3) / 4.0::DOUBLE ELSE 0 END AS b,
               CASE WHEN c_custkey % 2 = 0 THEN 0.25::DOUBLE ELSE 0 END AS c FROM customer)
    SELECT view_id, a AS citation_coupling, b AS method_lineage, c AS topic FROM v""")
def _(t):
    views = reads.saved_views(_views(t))
    return views.select("view_id", "weights.*")


def _views(t):
    key = F.col("c_custkey")
    parts = F.concat_ws(
        ",", F.format_string('"citation_coupling":%s', ((key % 4) / 4.0).cast("string")),
        F.when(key % 3 > 0, F.format_string('"method_lineage":%s', ((key % 3) / 4.0).cast("string"))),
        F.when(key % 2 == 0, F.lit('"topic":0.25')))
    return t.raw("customer").select(key.alias("view_id"), F.col("c_name").alias("name"), F.concat(F.lit("{"), parts, F.lit("}")).alias("weights"))


@query("g7_blended_by_view", """
    WITH v AS (SELECT r_regionkey::BIGINT AS view_id, r_regionkey / 4.0::DOUBLE AS a, (r_regionkey % 3) / 4.0::DOUBLE AS b FROM region)
    SELECT view_id, work_id, neighbor_work_id, round(sum(score * CASE dimension WHEN 'citation_coupling' THEN a ELSE b END
           / CASE WHEN a + b = 0 THEN 1 ELSE a + b END), 6) AS score
    FROM graph_neighbors, v GROUP BY 1, 2, 3""")
def _(t):
    key = F.col("r_regionkey")
    raw = F.format_string('{"citation_coupling":%s,"method_lineage":%s}', (key / 4.0).cast("string"), ((key % 3) / 4.0).cast("string"))
    views = t.raw("region").select(key.cast("long").alias("view_id"), F.col("r_name").alias("name"), raw.alias("weights"))
    return rounded(sim.blend_views(graph_neighbors(t), reads.saved_views(views)), "view_id", "work_id", "neighbor_work_id")
