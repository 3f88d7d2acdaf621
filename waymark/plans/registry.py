"""Query registry: a Spark callable and, where SQL can say the same, a DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import customer_kind, in_window, truncate_at_terminal
from ..operators.ordered import arrange
from ..operators.sequence import packets
from ..operators.survival import episodes
from ..session import configure, materialize, partitions_by_size
from ..sources.adapters import STREAM_SPEC, order_lifecycles, stream_events, stream_lifecycles

_ENTRIES: dict[str, tuple[Callable[["Tables"], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in _ENTRIES:
            raise ValueError(f"query registered twice: {name}")
        _ENTRIES[name] = (fn, sql)
        return fn
    return keep


def entries():
    return dict(_ENTRIES)


class Tables:
    """Given tables of one directory and the views derived from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        partitions_by_size(configure(spark))
        self._seen: dict = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def once(self, name: str, build: Callable):
        """What `build` gives, built on first use."""
        if name not in self._seen:
            self._seen[name] = build()
        return self._seen[name]

    # --- derived views ---------------------------------------------------------------------------
    def stream(self, campaign: bool = False) -> DataFrame:
        if campaign not in self._seen:
            self._seen[campaign] = stream_events(self.table("events"), STREAM_SPEC, campaign)
        return self._seen[campaign]

    def lifecycles(self, campaign: bool = False) -> DataFrame:
        return stream_lifecycles(self.stream(campaign))

    def orders(self) -> DataFrame:
        return order_lifecycles(self.table("orders"))

    def windowed(self) -> DataFrame:
        """Application events inside the half-open window, cut after the first terminal."""
        rows = self.stream().filter(F.col("application_id").isNotNull()).filter(in_window())
        return truncate_at_terminal(rows, STREAM_SPEC)

    def with_copies(self) -> DataFrame:
        """Events with every error row delivered a second time at the end of the source."""
        ev = self.stream()
        again = ev.filter(F.col("journey_substage") == "error").withColumn("source_row", F.col("source_row") + 1000000000)
        return ev.unionByName(again)

    def packets(self) -> DataFrame:
        return packets(self.windowed(), STREAM_SPEC)

    def kinded_packets(self) -> DataFrame:
        """Packets with the customer kind of their application, written once for all that read them."""
        if "kinded" in self._seen:
            return self._seen["kinded"]
        kind = customer_kind(self.lifecycles().withColumn("source_row", F.lit(0)), STREAM_SPEC)
        rows = self.packets().join(kind.select("application_id", "customer_kind"), "application_id")
        self._seen["kinded"] = arrange(materialize(rows), ["application_id"])
        return self._seen["kinded"]

    def episodes(self, start: str = "2024-01-01 00:00:00", end: str = "2024-01-31 00:00:00") -> DataFrame:
        return episodes(self.kinded_packets(), STREAM_SPEC, start, end)
