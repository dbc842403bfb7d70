"""From events to all interval tables: tag, align, rebuild."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scans import is_long
from ..functions.tables import settle
from ..operators import align, integrity, rebuild
from ..operators.alerts import Thresholds, all_alerts
from ..sources.trace_view import trace_events


@dataclass
class TraceTables:
    """The tables of one or more traces, all keyed by dataset_id and built when first asked for."""

    raw: DataFrame
    #: Interval tables are written once too, for queries that read some of them more than once.
    keep: bool = False
    #: Whether a trace is too long for one task; looked up if null.
    long: bool | None = None
    _alerts: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def _kept(self, df: DataFrame) -> DataFrame:
        return settle(df) if self.keep else df

    @cached_property
    def is_long(self) -> bool:
        return is_long(self.raw, ["dataset_id"]) if self.long is None else self.long

    @cached_property
    def tagged(self) -> DataFrame:
        return integrity.tag_events(self.raw, self.is_long)

    @cached_property
    def events(self) -> DataFrame:
        """Tagged and aligned events, written once as all else reads them."""
        return settle(align.align(self.tagged))

    @cached_property
    def states(self) -> DataFrame:
        return self._kept(rebuild.task_states(self.events, self.is_long))

    @cached_property
    def slices(self) -> DataFrame:
        return self._kept(rebuild.exec_slices(self.events, self.is_long))

    @cached_property
    def holds(self) -> DataFrame:
        return self._kept(rebuild.hold_edges(self.events, self.is_long))

    @cached_property
    def waits(self) -> DataFrame:
        return self._kept(rebuild.wait_edges(self.events, self.is_long))

    @cached_property
    def irqs(self) -> DataFrame:
        return self._kept(rebuild.irq_spans(self.events, self.is_long))

    @cached_property
    def windows(self) -> DataFrame:
        """All untrusted windows."""
        parts = [integrity.loss_overflow_windows(self.raw, self.is_long), align.degraded_windows(self.events), rebuild.relation_windows(self.holds, self.waits, self.irqs)]
        out = integrity.seq_gap_windows(self.raw, self.is_long)
        for p in parts:
            out = out.unionByName(p)
        return self._kept(out)

    @cached_property
    def scope(self) -> DataFrame:
        """The analysis window of each dataset: its middle four fifths."""
        span = self.events.groupBy("dataset_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        return self._kept(span.select("dataset_id", F.expr("lo + (hi - lo) div 10").alias("w_begin"), F.expr("hi - (hi - lo) div 10").alias("w_end")))


    def alerts(self, thresholds: Thresholds) -> DataFrame:
        """All alerts of the scope, written once for each set of thresholds."""
        key = repr(thresholds)
        if key not in self._alerts:
            self._alerts[key] = settle(all_alerts(self, self.scope, thresholds))
        return self._alerts[key]


def tables(spark: SparkSession, sf_dir: str, keep: bool = False) -> TraceTables:
    raw = trace_events(spark, sf_dir)
    return TraceTables(settle(raw) if keep else raw, keep)


def over_trace(f: Callable[[TraceTables], DataFrame], keep: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """A registered query from a function of the trace tables."""
    return lambda spark, sf_dir: f(tables(spark, sf_dir, keep))
