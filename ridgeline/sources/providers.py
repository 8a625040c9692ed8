"""Named providers of universes, bars and order books, and readers for recorded payloads.

A provider hands back DataFrames in the shapes of ``ridgeline.schema``. The built-in ones read recorded files, so that
they run without a network; others are added with ``register``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.schema import PANEL, PANEL_COLS, UNIVERSE


class MarketProvider(ABC):
    @abstractmethod
    def universe(self, spark: SparkSession) -> DataFrame: ...

    @abstractmethod
    def bars(self, spark: SparkSession, tickers: list[str] | None = None) -> DataFrame: ...


class BookProvider(ABC):
    @abstractmethod
    def snapshots(self, spark: SparkSession, depth: int = 50, stream: bool = False) -> DataFrame: ...


_MARKET: dict[str, type] = {}
_BOOKS: dict[str, type] = {}


def register(name: str, kind: type) -> None:
    (_BOOKS if issubclass(kind, BookProvider) else _MARKET)[name] = kind


def _get(found: dict, name: str, *args):
    if name not in found:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(found)}")
    return found[name](*args)


def market(name: str, *args) -> MarketProvider:
    return _get(_MARKET, name, *args)


def order_books(name: str, *args) -> BookProvider:
    return _get(_BOOKS, name, *args)


class _FirstTable(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.cell, self.state = [], None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "table" and self.state == 0:
            self.state = 1
        elif self.state == 1 and tag == "tr":
            self.rows.append([])
        elif self.state == 1 and tag in ("td", "th"):
            self.cell = ""

    def handle_endtag(self, tag):
        if tag == "table" and self.state == 1:
            self.state = 2
        elif self.state == 1 and tag in ("td", "th") and self.cell is not None and self.rows:
            self.rows[-1].append(self.cell.strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell += data


def universe_from_html(spark: SparkSession, html: str, symbol: str = "Symbol", sector: str = "GICS Sector") -> DataFrame:
    """The first table of a page; dots in symbols become dashes."""
    reader = _FirstTable()
    reader.feed(html)
    head, *rows = [r for r in reader.rows if r]
    a, b = head.index(symbol), head.index(sector)
    return spark.createDataFrame([(r[a], r[b]) for r in rows], UNIVERSE).withColumn("ticker", F.replace("ticker", F.lit("."), F.lit("-")))


def tickers(universe: DataFrame) -> DataFrame:
    return universe.select("ticker")


def long_bars(wide: DataFrame, ticker: str | None = None) -> DataFrame:
    """Panel rows from a wide table ``date, <field>|<ticker>, ...`` (or plain fields for the one ``ticker``, or a table that
    is long already): names in lower case, rows without any value dropped."""
    if ticker is not None:
        rows = wide.select(*(F.col(c).alias(c.lower()) for c in wide.columns), F.lit(ticker).alias("ticker"))
    elif "ticker" in wide.columns:
        rows = wide
    else:
        pairs = [c for c in wide.columns if "|" in c]
        made = [F.struct(F.lit(t).alias("ticker"), *(F.col(f"`{c}`").cast("double").alias(c.split("|")[0].lower()) for c in sorted(pairs) if c.endswith(f"|{t}"))) for t in sorted({c.split("|")[1] for c in pairs})]
        rows = wide.select("date", F.explode(F.array(*made)).alias("r")).select("date", "r.*")
    return rows.select(*PANEL_COLS).dropna("all", subset=PANEL_COLS[2:])


class RecordedMarket(MarketProvider):
    """``universe.csv`` and ``bars.parquet`` in a folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def universe(self, spark):
        return spark.read.schema(UNIVERSE).option("header", True).csv(f"{self.folder}/universe.csv")

    def bars(self, spark, tickers=None):
        rows = spark.read.schema(PANEL).parquet(f"{self.folder}/bars.parquet")
        return rows if tickers is None else rows.where(F.col("ticker").isin(tickers))


def _levels(side, depth: int):
    return F.transform(F.slice(side, 1, depth), lambda x: F.struct(x[0].cast("double").alias("price"), x[1].cast("double").alias("size")))


def read_level2(payloads: DataFrame, depth: int = 50) -> DataFrame:
    """Books from ``symbol, timestamp, payload`` where the payload holds ``bids`` and ``asks`` as lists of strings."""
    book = F.from_json("payload", "bids array<array<string>>, asks array<array<string>>")
    return payloads.withColumn("_b", book).select("symbol", "timestamp", _levels(F.col("_b.bids"), depth).alias("bids"), _levels(F.col("_b.asks"), depth).alias("asks"))


def read_keyed(payloads: DataFrame, depth: int = 50) -> DataFrame:
    """Books from payloads ``{"error": [...], "result": {<pair>: {"bids": ..., "asks": ...}}}``; the first pair counts,
    whatever its name, and a reported error stops the query."""
    side = "array<array<string>>"
    rows = payloads.withColumn("_p", F.from_json("payload", f"error array<string>, result map<string, struct<asks:{side}, bids:{side}>>"))
    failed = F.size(F.coalesce("_p.error", F.array())) > 0
    first = F.map_values("_p.result")[0]
    checked = F.when(failed, F.raise_error(F.concat(F.lit("order book error: "), F.concat_ws(", ", "_p.error"))).cast(f"struct<asks:{side}, bids:{side}>")).otherwise(first)
    return rows.withColumn("_b", checked).select("symbol", "timestamp", _levels(F.col("_b.bids"), depth).alias("bids"), _levels(F.col("_b.asks"), depth).alias("asks"))


class _RecordedBooks(BookProvider):
    """JSON lines ``symbol, timestamp, payload`` in a folder, as a table or a stream."""

    def __init__(self, folder: str):
        self.folder = folder

    def _payloads(self, spark, stream):
        return (spark.readStream if stream else spark.read).schema("symbol string, timestamp timestamp, payload string").json(self.folder)


class Level2Books(_RecordedBooks):
    def snapshots(self, spark, depth=50, stream=False):
        return read_level2(self._payloads(spark, stream), depth)


class KeyedBooks(_RecordedBooks):
    def snapshots(self, spark, depth=50, stream=False):
        return read_keyed(self._payloads(spark, stream), depth)


register("recorded", RecordedMarket)
register("level2", Level2Books)
register("keyed", KeyedBooks)
