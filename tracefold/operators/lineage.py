"""Lineage of derived objects: sources, untrusted windows that touch them, status."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import settle
from .intervals import overlap_join

#: Records times windows of a trace up to which one task compares them all.
SHORT_TRACE = 10_000_000


def records(t) -> DataFrame:
    """dataset_id, object_id, object_type, rule_id, open_event, close_event, sources, t_begin, t_end, reason_code."""
    none = F.lit(None).cast("string")

    def rows(df, ident, kind, opened, closed, *sources, reason=none):
        return df.select(
            "dataset_id", ident.alias("object_id"), F.lit(kind).alias("object_type"), F.lit(f"rebuild.{kind}").alias("rule_id"), opened.alias("open_event"), closed.alias("close_event"),
            F.array_distinct(F.array_compact(F.array(*sources))).alias("sources"), "t_begin", "t_end", reason.alias("reason_code"),
        )

    edge = lambda df, kind: rows(df, F.concat_ws(":", F.lit(kind), "dataset_id", "evidence_ref", F.coalesce(F.col("obj_id").cast("string"), F.lit("-"))), kind, F.when(F.col("close_kind") != "UNMATCHED", F.col("evidence_ref")), F.when(F.col("close_kind") == "UNMATCHED", F.col("evidence_ref")).otherwise(F.col("end_event")), F.col("evidence_ref"), F.col("end_event"), reason=F.col("reason_code"))
    irq_reason = F.when(F.col("close_kind") == "UNMATCHED", "IRQ_EXIT_WITHOUT_MATCHING_ENTER").when(F.col("close_kind") == "OPEN", "IRQ_ENTER_WITHOUT_EXIT")
    return reduce(
        DataFrame.unionByName,
        [
            rows(t.slices, F.col("slice_id"), "exec_slice", F.col("start_event"), F.col("end_event"), F.col("dispatch_event"), F.col("start_event"), F.col("end_event")),
            rows(t.states, F.col("seg_id"), "task_state", F.col("cause_event"), F.col("cause_event"), F.col("cause_event")),
            edge(t.holds, "hold"),
            edge(t.waits, "wait"),
            rows(t.irqs, F.col("irq_span_id"), "irq_span", F.col("enter_event"), F.col("exit_event"), F.col("enter_event"), F.col("exit_event"), reason=irq_reason),
        ],
    )


def _touched(counted: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The records of one short trace with its windows; lists are cut from one array of all pairs."""

    def run(rec: pa.Table, windows: pa.Table) -> pa.Table:
        windows = windows.take(pc.sort_indices(windows, [(c, "ascending") for c in ("t_begin", "t_end", "window_id")], null_placement="at_start"))
        ids = rec["object_id"].combine_chunks().dictionary_encode("encode")
        begin, end, w_begin, w_end = (t[c].to_numpy() for t in (rec, windows) for c in ("t_begin", "t_end"))
        at, met = np.nonzero((w_begin <= end[:, None]) & (w_end >= begin[:, None]))
        at = ids.indices.to_numpy()[at]
        if len(ids.dictionary) < len(rec):  # records of one id are one object, whose pairs come together
            order = np.lexsort((met, at))
            at, met = at[order], met[order]
        here, counts = np.unique(at, return_counts=True)
        codes = windows["reason_code"].combine_chunks()
        names = pc.unique(codes.drop_null()).sort()
        code = pc.fill_null(pc.index_in(codes, names), -1).to_numpy()[met]
        told = np.unique(at[code >= 0].astype("int64") * max(len(names), 1) + code[code >= 0])
        ends = np.searchsorted(told, (here.astype("int64") + 1) * max(len(names), 1))
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], "int32"), values)
        found = pa.array(counts, "int32") if counted else lists(np.cumsum(counts), windows["window_id"].combine_chunks().take(met))
        columns = {"dataset_id": rec["dataset_id"].combine_chunks().take(pa.array(np.zeros(len(here), "int64"))), "object_id": ids.dictionary.take(here)}
        return pa.table(columns | {"n" if counted else "window_ids": found, "reasons": lists(ends, names.take(told % max(len(names), 1)))})

    return run


def touching_windows(rec: DataFrame, windows: DataFrame, counted: bool = False) -> DataFrame:
    """Each record with the untrusted windows that overlap its range, ends included, in order of time; if ``counted`` their number n, not their ids.

    A short trace is compared in one task, so that its pairs never become rows;
    the others go by time cells. Both sides are read twice.
    """
    r = rec.select("dataset_id", "object_id", "t_begin", "t_end").where("dataset_id is not null and t_begin is not null and t_end is not null")
    w = windows.select("dataset_id", "t_begin", "t_end", "window_id", "reason_code").where("dataset_id is not null and t_begin is not null and t_end is not null")
    size = lambda df, name: df.groupBy("dataset_id").agg(F.count("*").alias(name))
    long = settle(size(r, "records").join(size(w, "windows"), "dataset_id").where(F.col("records") * F.col("windows") > SHORT_TRACE).select("dataset_id"))
    found = "n int" if counted else "window_ids array<string>"
    cut = lambda df, how: df.join(F.broadcast(long), "dataset_id", how)
    some = not long.isEmpty()
    sides = [(cut(df, "left_anti") if some else df).groupBy("dataset_id") for df in (r, w)]
    out = sides[0].cogroup(sides[1]).applyInArrow(_touched(counted), f"dataset_id string, object_id string, {found}, reasons array<string>")
    if not some:
        return out
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r_begin", "r_end", "window_id"))), lambda x: x["window_id"]).alias("window_ids")
    pairs = overlap_join(cut(r, "left_semi"), cut(w, "left_semi"), ["dataset_id"], closed=True)
    return out.unionByName(pairs.groupBy("dataset_id", "object_id").agg(F.count("*").cast("int").alias("n") if counted else listed, F.array_sort(F.collect_set("reason_code")).alias("reasons")))


def reused_ids(events: DataFrame) -> DataFrame:
    """Event ids seen at more than one timestamp."""
    return events.groupBy("dataset_id", "event_uid").agg(F.count_distinct("ts").alias("n")).where("n > 1")


def status(rec: DataFrame, windows: DataFrame, reused: DataFrame, unsupported: DataFrame | None = None) -> DataFrame:
    """The worst that holds: mapping, capability, open end, close end, alignment, loss; else complete.

    unsupported: dataset_id, object_type that a trace lacks the events for.
    """
    bad = rec.select("dataset_id", "object_id", F.explode("sources").alias("event_uid")).join(reused, ["dataset_id", "event_uid"], "left_semi").select("dataset_id", "object_id").distinct().withColumn("reused", F.lit(True))
    j = rec.join(touching_windows(rec, windows, counted=True), ["dataset_id", "object_id"], "left").join(bad, ["dataset_id", "object_id"], "left")
    if unsupported is not None:
        j = j.join(unsupported.select("dataset_id", "object_type").distinct().withColumn("lacking", F.lit(True)), ["dataset_id", "object_type"], "left")
    lacking = F.col("lacking") if unsupported is not None else F.lit(False)
    has = lambda *codes: F.coalesce(F.arrays_overlap("reasons", F.array(*[F.lit(c) for c in codes])), F.lit(False))
    verdict = (
        F.when(F.col("reused"), "MAPPING_INVALID")
        .when(lacking, "CAPABILITY_UNSUPPORTED")
        .when(F.col("open_event").isNull(), "INCOMPLETE_OPEN")
        .when(F.col("close_event").isNull() | F.col("reason_code").isNotNull(), "INCOMPLETE_CLOSE")
        .when(has("ALIGN_DEGRADED"), "ALIGNMENT_DEGRADED")
        .when(has("SEQ_GAP", "BUFFER_OVERFLOW", "IO_BACKPRESSURE"), "LOSS_AFFECTED")
        .otherwise("COMPLETE")
    )
    return j.select("dataset_id", "object_id", "object_type", verdict.alias("status"), F.coalesce("n", F.lit(0)).alias("n_windows"))


def backtrace(rec: DataFrame, events: DataFrame) -> DataFrame:
    """Derived objects with the raw events they come from."""
    return rec.select("dataset_id", "object_id", F.explode("sources").alias("event_uid")).join(events.select("dataset_id", "event_uid", "event_name", "ts_raw"), ["dataset_id", "event_uid"])


def subset(rec: DataFrame, objects: DataFrame) -> DataFrame:
    return rec.join(objects.select("dataset_id", "object_id"), ["dataset_id", "object_id"], "left_semi")


def violations(rec: DataFrame, events: DataFrame, windows: DataFrame, listed: DataFrame, objects: DataFrame, touching: DataFrame | None = None) -> DataFrame:
    """What is wrong with lineage records: dataset_id, object_id, violation, detail.

    listed: dataset_id, object_id, window_ids (the windows that a record names);
    objects: dataset_id, object_id, t_begin, t_end (what was rebuilt); touching:
    ``touching_windows`` of the records, if it is known. Sources and
    named windows must exist; a record's ends must be among its sources; it must
    name all windows that overlap it, ends included, and no others; and records
    and objects must agree in existence and range.
    """
    by = ["dataset_id", "object_id"]
    bad = lambda df, what, detail: df.select(*by, F.lit(what).alias("violation"), (F.col(detail) if detail else F.lit(None)).cast("string").alias("detail"))
    sources = rec.select(*by, F.explode("sources").alias("event_uid"))
    ends = rec.select(*by, "sources", F.explode(F.array_compact(F.array("open_event", "close_event"))).alias("event_uid")).where(~F.array_contains("sources", F.col("event_uid")))
    known = windows.select("dataset_id", "window_id").distinct()
    ranges = rec.select(*by, "t_begin", "t_end")
    touching = touching_windows(rec, windows.withColumn("reason_code", F.lit(None).cast("string"))) if touching is None else touching
    # lists are compared as lists; only what one side lacks becomes rows
    lists = touching.select(*by, F.col("window_ids").alias("met")).join(listed.select(*by, F.col("window_ids").alias("named")), by, "full")
    none = F.array().cast("array<string>")
    met, named = F.coalesce("met", none), F.coalesce("named", none)
    sided = settle(lists.select(*by, F.array_except(met, named).alias("unlisted"), F.array_except(named, met).alias("unmet")).where("size(unlisted) + size(unmet) > 0"))
    unmet = sided.select(*by, F.explode("unmet").alias("window_id"))
    both = ranges.join(objects.select(*by, F.col("t_begin").alias("o_begin"), F.col("t_end").alias("o_end"), F.lit(True).alias("there")), by, "full")
    return reduce(
        DataFrame.unionByName,
        [
            bad(sources.join(events, ["dataset_id", "event_uid"], "left_anti"), "UNKNOWN_SOURCE", "event_uid"),
            bad(rec.where("t_end < t_begin"), "NEGATIVE_RANGE", None),
            bad(ends.distinct(), "END_NOT_A_SOURCE", "event_uid"),
            bad(unmet.join(known, ["dataset_id", "window_id"], "left_anti"), "UNKNOWN_WINDOW", "window_id"),
            bad(sided.select(*by, F.explode("unlisted").alias("window_id")), "UNLISTED_WINDOW", "window_id"),
            bad(unmet.join(known, ["dataset_id", "window_id"], "left_semi"), "LISTED_WITHOUT_OVERLAP", "window_id"),
            bad(both.where("there is null"), "RECORD_WITHOUT_OBJECT", None),
            bad(both.where("there and t_begin is null"), "OBJECT_WITHOUT_RECORD", None),
            bad(both.where("t_begin <> o_begin or t_end <> o_end"), "OBJECT_DIFFERS", None),
        ],
    )
