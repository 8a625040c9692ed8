"""Features of order-book snapshots ``symbol, <time>, bids, asks`` with the best level first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many levels a side the depth tiers sum.
TIERS = (5, 10, 25)
BPS = 10_000


def depth(side: str, levels: int) -> Column:
    return F.aggregate(F.slice(side, 1, levels), F.lit(0.0), lambda a, x: a + F.coalesce(x["size"], F.lit(0.0)))


def book_features(books: DataFrame, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Quotes, spread, microprice, and depth and imbalance by tier; a side without levels has null quotes, a tier
    without any size imbalance 0. A narrow projection: it runs on streams as on tables."""
    keep = [c for c in books.columns if c not in ("bids", "asks")]
    bid, ask = F.try_element_at("bids", F.lit(1)), F.try_element_at("asks", F.lit(1))
    bp, bs, ap, as_ = bid["price"], bid["size"], ask["price"], ask["size"]
    mid = (bp + ap) / 2
    micro = F.try_divide(bp * as_ + ap * bs, bs + as_)
    out = {
        "best_bid": bp, "best_ask": ap, "mid_price": mid, "spread": ap - bp, "spread_bps": F.try_divide(ap - bp, mid) * BPS,
        "microprice": micro, "microprice_minus_mid_bps": F.try_divide(micro - mid, mid) * BPS,
    }
    for n in tiers:
        b, a = depth("bids", n), depth("asks", n)
        out |= {f"bid_depth_top{n}": b, f"ask_depth_top{n}": a, f"imbalance_top{n}": F.when(b + a > 0, F.try_divide(b - a, b + a)).otherwise(0.0)}
    return books.select(*keep, *(c.alias(name) for name, c in out.items()))
