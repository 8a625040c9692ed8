"""Payloads behind addresses as a data source: one row per key, fetched on the executors in batches of keys.

``spark.read.format("addresses")`` and ``spark.readStream`` of the same take the options ``addresses`` (a JSON object
of keys and addresses), ``batch`` (keys a partition, 50), ``timeout`` (seconds, 30), ``agent`` (the user agent) and
``missing`` (``fail``, or ``skip`` keys that can't be fetched).

A stream has a turn every ``every`` seconds (60), in which each key is fetched once; turns that pass while it stands still
are left out. It needs ``log``, a folder that all executors share (a path, or an address that pyarrow can open). What
a task fetches for a turn is written there before its rows go on, and a task that finds its part there reads it instead of
fetching: a batch that is replayed has the rows it had. A log belongs to one query; the last ``keep`` turns (10) stay in it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.schema import UNIVERSE
from ridgeline.sources.providers import BookProvider, MarketProvider, long_bars, read_keyed, read_level2, register, universe_from_html


def register_addresses(spark: SparkSession) -> None:
    """Make the format ``addresses`` known to the session. The classes are local, so that workers need no import."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

    def fetch(options, pairs):
        from datetime import datetime, timezone
        from urllib.request import Request, urlopen

        for key, address in pairs:
            try:
                with urlopen(Request(address, headers={"User-Agent": options.get("agent", "Mozilla/5.0")}), timeout=float(options.get("timeout", 30))) as got:
                    yield (key, datetime.now(timezone.utc), got.read().decode())
            except OSError:
                if options.get("missing", "fail") != "skip":
                    raise

    def chunks(options):
        pairs, size = list(json.loads(options["addresses"]).items()), int(options.get("batch", 50))
        return [pairs[k : k + size] for k in range(0, len(pairs), size)]

    def opened(options):
        import os

        from pyarrow import fs

        where = options["log"]
        return fs.FileSystem.from_uri(where) if ":" in where else (fs.LocalFileSystem(), os.path.abspath(where))

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = dict(options)

        def partitions(self):
            return [InputPartition(c) for c in chunks(self.options)] or [InputPartition([])]

        def read(self, partition):
            return fetch(self.options, partition.value)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options):
            self.options = dict(options)
            if "log" not in self.options:
                raise ValueError("a stream of addresses needs the option log, a shared folder")

        def initialOffset(self):
            return {"turn": -1}

        def latestOffset(self):
            import time

            return {"turn": int(time.time() / float(self.options.get("every", 60)))}

        def partitions(self, start, end):
            turn = end["turn"]
            return [InputPartition((turn, k, c)) for k, c in enumerate(chunks(self.options))] if turn > start["turn"] else []

        def read(self, partition):
            import os
            import uuid
            from datetime import datetime

            from pyarrow import fs

            turn, part, pairs = partition.value
            store, root = opened(self.options)
            folder = f"{root}/turn={turn:012d}"
            final = f"{folder}/{part:06d}.json"
            if store.get_file_info(final).type == fs.FileType.NotFound:
                store.create_dir(folder, recursive=True)
                draft = f"{final}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(json.dumps([(k, at.isoformat(), text) for k, at, text in fetch(self.options, pairs)]).encode())
                if isinstance(store, fs.LocalFileSystem):
                    try:
                        os.link(draft, final)  # the first of two attempts counts
                    except FileExistsError:
                        pass
                    store.delete_file(draft)
                elif store.get_file_info(final).type == fs.FileType.NotFound:
                    store.move(draft, final)
            with store.open_input_stream(final) as got:
                rows = json.loads(got.read())
            return iter([(k, datetime.fromisoformat(at), text) for k, at, text in rows])

        def commit(self, end):
            from pyarrow import fs

            store, root = opened(self.options)
            turns = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("turn="))
            done = [t for t in turns if int(t.rsplit("=", 1)[1]) <= end["turn"]]
            for path in done[: -max(1, int(self.options.get("keep", 10)))]:
                store.delete_dir(path)

    class Addresses(DataSource):
        @classmethod
        def name(cls):
            return "addresses"

        def schema(self):
            return "symbol string, timestamp timestamp, payload string"

        def reader(self, schema):
            return Reader(self.options)

        def streamReader(self, schema):
            return StreamReader(self.options)

    spark.dataSource.register(Addresses)


def payloads(spark: SparkSession, addresses: dict[str, str], stream: bool = False, **options) -> DataFrame:
    register_addresses(spark)
    reader = (spark.readStream if stream else spark.read).format("addresses").option("addresses", json.dumps(addresses))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def cached_universe(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The universe at ``path`` (CSV with a header), fetched and written first if it isn't there or with ``refresh``."""
    reader = spark.read.schema(UNIVERSE).option("header", True)
    if not refresh:
        try:
            return reader.csv(path)
        except AnalysisException:
            pass
    fetch().write.mode("overwrite").option("header", True).csv(path)
    return reader.csv(path)


class WebMarket(MarketProvider):
    """A universe page, and a table ``Date,Open,...`` as CSV per ticker. ``pattern`` is an address with ``{ticker}``."""

    def __init__(self, page: str, pattern: str, cache: str):
        self.page, self.pattern, self.cache = page, pattern, cache

    def universe(self, spark, refresh: bool = False):
        return cached_universe(spark, self.cache, lambda: universe_from_html(spark, payloads(spark, {"page": self.page}).first().payload), refresh)

    def bars(self, spark, tickers=None):
        """Daily bars of ``tickers`` (of the universe by default), fifty a task; tickers without data are left out."""
        names = tickers if tickers is not None else [r.ticker for r in self.universe(spark).select("ticker").collect()]
        raw = payloads(spark, {t: self.pattern.format(ticker=t) for t in names}, missing="skip")
        lines = raw.select("symbol", F.posexplode(F.split(F.trim("payload"), "\r?\n")).alias("at", "line")).where("at > 0")
        fields = F.from_csv("line", "date date, open double, high double, low double, close double, volume double")
        return long_bars(lines.select("symbol", fields.alias("x")).select("x.*", F.col("symbol").alias("ticker")))


class WebBooks(BookProvider):
    """Order books behind one address per symbol, in either payload format (``level2`` or ``keyed``); ``options`` as for
    the data source (a stream needs ``log``)."""

    def __init__(self, addresses: dict[str, str], kind: str = "level2", **options):
        self.addresses, self.parse, self.options = addresses, {"level2": read_level2, "keyed": read_keyed}[kind], options

    def snapshots(self, spark, depth=50, stream=False):
        return self.parse(payloads(spark, self.addresses, stream, **self.options), depth)


register("web", WebMarket)
register("web_books", WebBooks)
