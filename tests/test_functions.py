import math

import pytest
from pyspark.sql import functions as F

from evgraph import taxonomy as tx
from evgraph.functions import geometry, scores
from evgraph.functions import text as tf
from tests.helpers import value


def on(spark, fn, text):
    return value(spark, fn(F.col("c")), c=text)


@pytest.mark.parametrize(
    "text,want",
    [("  Attention Is All You Need!  ", "attention is all you need"), ("Élan_中²  x", "élan中² x"), ("--", "")],
)
def test_normalize_title(spark, text, want):
    assert on(spark, tf.normalize_title, text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("https://arxiv.org/abs/1706.03762", "1706.03762"),
        ("https://arxiv.org/pdf/1706.03762v7.pdf", "1706.03762"),
        ("arxiv:1706.03762v1", "1706.03762"),
        ("10.48550/arXiv.1412.6980", "1412.6980"),
        ("none", None),
    ],
)
def test_arxiv(spark, text, want):
    assert on(spark, tf.parse_arxiv_id, text) == want


def test_doi(spark):
    assert on(spark, tf.parse_doi, "https://doi.org/10.1038/nature14539") == "10.1038/nature14539"
    assert on(spark, tf.parse_doi, "10.1000/182") == "10.1000/182"
    assert on(spark, tf.parse_doi, "x") is None


def test_html_to_text(spark):
    page = "<p>Hello <b>world</b></p><p>Next</p>\r\n\n\n\n<script>var a='<p>';</script><!-- x -->a&amp;lt;b"
    assert on(spark, tf.html_to_text, page) == "Hello world \nNext\n\na<b"
    assert on(spark, tf.html_to_text, '<img alt="A cat" src="x/y.png">') == "[IMAGE: A cat]"
    assert on(spark, tf.html_to_text, "<img alt='' src='x/y.png'/>") == "[IMAGE: y.png]"
    assert on(spark, tf.html_to_text, 'a<img alt="" src="p/q.jpg">b<IMG>c') == "a\n[IMAGE: q.jpg]\nb\n[IMAGE: figure]\nc"


def test_markup(spark):
    assert on(spark, tf.strip_markup_spaced, "<p>Hello <b>world</b></p>") == "Hello world"
    assert on(spark, tf.strip_markup_joined, "a<b>c</b> > d <open") == "ac d"
    assert on(spark, tf.strip_markup_spaced, "a<b>c</b>d>e <open") == "a c d e"


def test_html_fields(spark):
    page = (
        '<title>Deep Nets | arXiv</title><div class="ltx_page_content"><span class="a ltx_personname">Ann  <i>Lee</i></span>'
        '<span class="ltx_personname">Ann Lee</span><span class="ltx_personname">B</span>'
        '<div class="ltx_abstract">Abstract. ' + "word " * 12 + "</div>tail<footer>no</footer>"
    )
    assert on(spark, tf.html_title, page) == "Deep Nets"
    body = on(spark, tf.main_content, page)
    assert body.endswith("tail") and body.startswith('class="ltx_page_content"')
    assert on(spark, tf.html_abstract, body) == ("word " * 12).strip()
    assert on(spark, tf.html_abstract, '<div class="ltx_abstract">short</div>') is None
    assert on(spark, tf.html_authors, body) == ["Ann Lee"]
    assert on(spark, tf.main_content, "x<article>y") == "<article>y"


def test_json_replies(spark):
    assert on(spark, tf.lenient_json, '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert on(spark, tf.lenient_json, ' ```{"a": 1}``` ') == '{"a": 1}'
    for bad in ('{"a": 1}}', "{", "", "1,2", "1],[2", '```json\n{"a"\n```'):
        assert on(spark, tf.lenient_json, bad) is None, bad


def test_years_and_cursors(spark):
    assert on(spark, tf.publication_year, '<date when="2017"/> 1999') == 2017
    assert on(spark, tf.publication_year, "<date when='2016-01'/>") == 2016
    assert on(spark, tf.publication_year, "<b>p. 12345, 3000 1987</b> 2001") == 1987
    assert on(spark, tf.publication_year, '<p n="1999">x</p>') is None
    epoch = lambda c: F.unix_timestamp(tf.parse_cursor(c))
    assert on(spark, epoch, "1970-01-02T00:00:00+01:00") == 82800
    assert on(spark, epoch, "1970-01-02t00:00:00.5z") == 86400
    assert on(spark, epoch, "1970-01-02") is None


def test_boxes(spark):
    box = lambda c: F.to_json(geometry.parse_box(c))
    assert on(spark, box, '{"x":72,"y":520,"w":450,"h":36}') == '{"x":72.0,"y":520.0,"w":450.0,"h":36.0}'
    assert on(spark, box, '{"x0":1,"y0":2,"x1":11,"y1":7}') == '{"x":1.0,"y":2.0,"w":10.0,"h":5.0}'
    assert on(spark, box, "[10, 20, 110, 60]") == '{"x":10.0,"y":20.0,"w":100.0,"h":40.0}'
    assert on(spark, box, "[1, 2, 30, 40]") == '{"x":1.0,"y":2.0,"w":30.0,"h":40.0}'
    assert on(spark, box, "[1, 2]") is None and on(spark, box, "oops") is None
    place = lambda c: F.to_json(geometry.parse_coords(c))
    assert on(spark, place, "3 10.0 20.0 100.0 40.0;4 1 1 1 1") == '{"page":3,"box":{"x":10.0,"y":20.0,"w":90.0,"h":20.0}}'
    assert on(spark, place, "7") == '{"page":7}'
    assert on(spark, place, "7 8") == '{"page":0}'


def test_springs(spark):
    def at(fn, s):
        return spark.range(1).select(fn(F.lit(s)).alias("v")).first()["v"]

    assert (at(scores.map_spring_length, 1.0), at(scores.map_spring_length, 0.0)) == (160, 720)
    assert math.isclose(at(scores.map_spring_length, 0.5), 300)
    assert at(scores.spring_elasticity, 0.9) > 2 * at(scores.spring_elasticity, 0.8) > 4
    assert math.isclose(at(scores.spring_length, 0.5), 90 + 430 * 0.5**1.6)


def test_taxonomy(spark):
    kinds = ["none", "cites", "version_of", "bogus", " Improves_On "]
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    assert [r[0] for r in df.select(tx.proposable_type(F.col("k"))).collect()] == [None] * 4 + ["improves_on"]
    weights = spark.createDataFrame([(t,) for t in tx.RELATION_TYPES], "t string").select(
        "t", *[tx.mode_weight(m, F.col("t")).alias(m) for m in ("explore", "evolution", "dispute", "prerequisite")]
    )
    got = {r["t"]: tuple(r)[1:] for r in weights.collect()}
    assert got["improves_on"] == (1.0, 1.8, 0.7, 1.2)
    assert got["alternative_to"] == (1.0, 1.3, 0.7, 1.2)
    assert got["prerequisite_for"] == (1.0, 0.8, 0.7, 2.0)
    assert got["contradicts_claim"] == (1.0, 0.8, 2.0, 0.8)


def test_aspect_text(spark):
    df = spark.createDataFrame([(" s ", [" a ", "", "b"]), ("", ["x"]), ("only", None), (" ", [])], "s string, b array<string>")
    got = [r[0] for r in df.select(tf.aspect_text(F.col("s"), F.col("b"))).collect()]
    assert got == ["s\na; b", "x", "only", ""]


def test_cost(spark):
    df = spark.createDataFrame(
        [("GPT-4o-mini", 1000, 100, None, None), ("gpt-4o", 1000, 100, 10, 10), ("x", 1, 1, None, None)],
        "m string, i long, o long, r long, w long",
    )
    got = [r[0] for r in df.select(scores.token_cost_usd(*[F.col(c) for c in "miorw"])).collect()]
    want = [(1000 * 0.15 + 100 * 0.6) / 1e6, ((1000 + 1 + 12.5) * 2.5 + 1000) / 1e6, 4 / 1e6]
    assert all(math.isclose(a, b) for a, b in zip(got, want))
