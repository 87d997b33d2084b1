"""Numeric expressions: layout springs, model cost, stable ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars per million tokens (input, output), first match wins.
TOKEN_PRICES = [
    (["mini"], 0.15, 0.60),
    (["gpt-4o", "gpt-4.1"], 2.50, 10.0),
    (["haiku"], 1.0, 5.0),
    (["sonnet"], 3.0, 15.0),
    (["opus"], 5.0, 25.0),
]
DEFAULT_PRICE = (1.0, 3.0)
CACHE_READ_FACTOR, CACHE_WRITE_FACTOR, BATCH_FACTOR = 0.1, 1.25, 0.5


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def spring_length(score: Column) -> Column:
    return F.lit(90.0) + F.lit(430.0) * F.pow(F.lit(1.0) - clamp01(score), F.lit(1.6))


def spring_weight(score: Column) -> Column:
    return clamp01((score - 0.35) / 0.55)


def spring_elasticity(score: Column) -> Column:
    return F.lit(0.08) + F.lit(5.5) * F.pow(spring_weight(score), F.lit(4.0))


def map_spring_length(score: Column, shortest: float = 160.0, longest: float = 720.0) -> Column:
    gap = F.lit(1.0) - clamp01(score)
    return F.lit(shortest) + F.lit(longest - shortest) * gap * gap


def token_cost_usd(
    model: Column, tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column,
    batch: bool = False,
) -> Column:
    name = F.lower(model)

    def price(slot: int) -> Column:
        out = None
        for words, *rates in TOKEN_PRICES:
            hit = F.contains(name, F.lit(words[0]))
            for word in words[1:]:
                hit = hit | F.contains(name, F.lit(word))
            out = F.when(hit, F.lit(rates[slot])) if out is None else out.when(hit, F.lit(rates[slot]))
        return out.otherwise(F.lit(DEFAULT_PRICE[slot]))

    billed_in = (
        tokens_in
        + F.coalesce(cache_read, F.lit(0)) * CACHE_READ_FACTOR
        + F.coalesce(cache_write, F.lit(0)) * CACHE_WRITE_FACTOR
    )
    cost = (billed_in * price(0) + tokens_out * price(1)) / 1_000_000.0
    return cost * BATCH_FACTOR if batch else cost


def synthetic_id(*parts: Column) -> Column:
    """Stable id of something that has no row of its own (group node, promoted claim)."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 32)


def set_fingerprint(ids: Column) -> Column:
    """Fingerprint of a set of ids, independent of order and repeats."""
    as_text = F.transform(F.array_sort(F.array_distinct(ids)), lambda i: i.cast("string"))
    return F.sha2(F.array_join(as_text, ","), 256)
