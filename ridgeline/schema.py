"""Column contracts and defaults shared by the panel operators."""

from pyspark.sql import types as T

#: Row counts of the rolling windows, the label's look-ahead in rows, and cost and bucket defaults.
WINDOWS = (5, 10, 20)
HORIZON = 5
TRADING_DAYS = 252
COST_BPS = 5.0
BUCKETS = 10
MIN_NAMES = 20

PANEL_COLS = ["date", "ticker", "open", "high", "low", "close", "volume"]
LABEL_COLS = ["fwd_ret", "fwd_ret_neutral"]
FEATURE_COLS = (
    ["vwap", "ret_1d"]
    + [f"{name}_{w}" for w in WINDOWS for name in ("mean_close", "std_close", "sum_volume", "delta_close", "ewma_close")]
    + ["mom_60", "corr_close_volume_10"]
)

UNIVERSE = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("sector", T.StringType())])
PANEL = T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in PANEL_COLS[2:])])
LEVEL = T.StructType([T.StructField("price", T.DoubleType()), T.StructField("size", T.DoubleType())])
BOOK = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("timestamp", T.TimestampType()), T.StructField("bids", T.ArrayType(LEVEL)), T.StructField("asks", T.ArrayType(LEVEL))])
PREDICTIONS = T.StructType(
    [T.StructField("predict_date", T.DateType()), T.StructField("ticker", T.StringType()), T.StructField("alpha", T.DoubleType()), T.StructField("realized_fwd_ret", T.DoubleType()), T.StructField("resolved", T.BooleanType())]
)


def feature_columns(columns: list[str]) -> list[str]:
    """All columns that are neither panel columns, sector nor labels, in their order."""
    other = {*PANEL_COLS, *LABEL_COLS, "sector"}
    return [c for c in columns if c not in other]


def resolve_subset(spec: str | None, columns: list[str], recommended: list[str] | None = None) -> list[str]:
    """``None``: all; ``"preflight"``: the recommended list, which must be there; else a comma-separated list of known names."""
    if spec is None:
        return columns
    if spec == "preflight":
        if not recommended:
            raise ValueError("no recommended feature list; run the preflight with a top-n first")
        return recommended
    wanted = [c.strip() for c in spec.split(",")]
    if unknown := sorted(set(wanted) - set(columns)):
        raise ValueError(f"unknown features: {unknown}")
    return wanted
