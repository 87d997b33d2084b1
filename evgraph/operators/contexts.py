"""Sentences around citations in TEI documents."""

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.functions.geometry import parse_coords

# Window before and after the mark in bytes, shortest context in bytes, longest in characters.
BEFORE, AFTER, SHORTEST, LONGEST = 280, 200, 20, 600

_OPEN_REF = re.compile(r"<ref\b([^>]*)>", re.I)
_BIBR = re.compile(r"""type=["']bibr["']""", re.I)
_TARGET = re.compile(r"""target=["'](#[^"']+)["']""", re.I)
_COORDS = re.compile(r'coords="([^"]*)"')
_TAGS = re.compile(r"<[^>]*(?:>|\Z)|>")


def _aligned(raw: bytes, at: int) -> int:
    """Start of the character that the byte at `at` belongs to."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def contexts_of(tei: str) -> list[tuple]:
    """(context number, target, text, coords) of every bibliographic reference in one document."""
    raw = tei.encode("utf-8")
    found, at_char, at_byte = [], 0, 0
    for mark in _OPEN_REF.finditer(tei):
        target = _TARGET.search(mark[1])
        if not (target and _BIBR.search(mark[1])):
            continue
        begin = at_byte + len(tei[at_char : mark.start()].encode("utf-8"))
        end = begin + len(mark[0].encode("utf-8"))
        at_char, at_byte = mark.end(), end
        lo, hi = _aligned(raw, max(begin - BEFORE, 0)), _aligned(raw, min(end + AFTER, len(raw)))
        words = " ".join(_TAGS.sub("", raw[lo:hi].decode("utf-8")).split())
        if len(words.encode("utf-8")) < SHORTEST:
            continue
        coords = _COORDS.search(mark[1])
        found.append((len(found), target[1], words[:LONGEST], coords[1] if coords else None))
    return found


def citation_contexts(documents: DataFrame, key: str = "doc_id", text: str = "tei") -> DataFrame:
    """(key, position, context_id, target, text, page, bbox) for whole documents, Arrow batch by batch."""
    key_type = documents.schema[key].dataType.simpleString()

    def scan(batches):
        for pdf in batches:
            rows = [(k, *c) for k, doc in zip(pdf[key], pdf[text]) if doc for c in contexts_of(doc)]
            yield pd.DataFrame(rows, columns=[key, "position", "target", "text", "coords"])

    found = documents.select(key, text).mapInPandas(
        scan, f"{key} {key_type}, position int, target string, text string, coords string"
    )
    place = parse_coords(F.col("coords"))
    return found.select(
        key, "position", F.concat(F.lit("c"), F.col("position")).alias("context_id"), "target", "text",
        F.coalesce(place["page"], F.lit(0)).alias("page"), place["box"].alias("bbox"))
