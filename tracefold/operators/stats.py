"""Run statistics, detector evaluation, clock drift, counters and ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import round6, wilson
from ..functions.quantiles import exact_quantiles
from ..functions.scans import scan
from ..functions.tables import settle


def run_statistics(runs: DataFrame, scenario: str, metrics: list[str]) -> DataFrame:
    """Per scenario and metric: count, median, nearest-rank p95, least and most."""
    long = runs.select(scenario, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(scenario, "x.*")
    long = settle(long)
    counts = long.groupBy(scenario, "metric").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    q = exact_quantiles(long, [scenario, "metric"], "value", {"median": 0.5}, {"p95": 0.95}).select(F.col(scenario).alias("of"), F.col("metric").alias("by"), "median", "p95")
    j = counts.join(q, F.col(scenario).eqNullSafe(F.col("of")) & (F.col("metric") == F.col("by")), "left")
    return j.select(scenario, "metric", "n", round6(F.col("median")).alias("median"), "p95", "least", "most")


def status_counts(rows: DataFrame, scenario: str, status: str, values: list[str]) -> DataFrame:
    counts = rows.groupBy(scenario).agg(*[F.count_if(F.col(status) == v).alias(v.lower()) for v in values], F.count("*").alias("total"))
    return counts


def telemetry_risk(rows: DataFrame, key: str, at: str, runtime: str, rss: str, last: int = 20, limit: float = 2048.0) -> DataFrame:
    """Of each key's last rows: longest runtime, largest rss, rows at or over the limit, and rows that reused an index (boolean ``reused``)."""
    w = W.partitionBy(key).orderBy(F.desc(at), F.desc(runtime))
    r = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= last)
    return r.groupBy(key).agg(F.max(runtime).alias("max_runtime"), F.max(rss).alias("max_rss"), F.count_if(F.col(rss) >= limit).alias("heavy"), F.count_if("reused").alias("reused"), F.count("*").alias("rows"))


def prior_table(rows: DataFrame, flags: list[str], value: str, actions: str) -> DataFrame:
    """Per bucket of flags and action: support, rows of the bucket and their mean value."""
    bucket = F.concat(*[F.when(F.col(f), "1").otherwise("0") for f in flags])
    r = rows.withColumn("bucket", bucket)
    sizes = r.groupBy("bucket").agg(F.count("*").alias("rows"), round6(F.avg(value)).alias("mean"))
    support = r.select("bucket", F.explode(actions).alias("action")).groupBy("bucket", "action").agg(F.count("*").alias("support"))
    return support.join(sizes, "bucket").withColumn("share", round6(F.col("support") / F.col("rows")))


def replay_summary(rows: DataFrame, key: str) -> DataFrame:
    """rows: key, status (pass, fail, reference, not_evaluated), kept and all evidence refs."""
    g = rows.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "reference", "not_evaluated")], F.sum(F.size(F.array_intersect("kept", "refs"))).alias("retained"), F.sum(F.size("refs")).alias("wanted"))
    return g.withColumn("retention", F.when(F.col("wanted") > 0, round6(F.col("retained") / F.col("wanted"))))


def retention(rows: DataFrame) -> DataFrame:
    """rows: id, refs, kept. How many references stayed, and those only on one side."""
    return rows.select("id", F.size(F.array_intersect("refs", "kept")).alias("shared"), F.array_join(F.array_sort(F.array_union(F.array_except("refs", "kept"), F.array_except("kept", "refs"))), ",").alias("changed"))


def feedback_summary(rows: DataFrame, variant: str, rater: str, ratings: list[str]) -> DataFrame:
    """Per variant and rating: count, mean, least and most over raters' first rows; repeats are counted apart."""
    w = W.partitionBy(variant, rater).orderBy(*ratings)
    r = rows.withColumn("_n", F.row_number().over(w))
    long = r.select(variant, "_n", F.explode(F.array(*[F.struct(F.lit(x).alias("rating"), F.col(x).cast("double").alias("v")) for x in ratings])).alias("x")).select(variant, "_n", "x.*")
    first = F.when(F.col("_n") == 1, F.col("v"))
    return long.groupBy(variant, "rating").agg(F.count(first).alias("n"), round6(F.avg(first)).alias("mean"), F.min(first).alias("least"), F.max(first).alias("most"), F.count_if(F.col("_n") > 1).alias("repeats"))


def detector_eval(captures: DataFrame, group: str, families: dict[str, list[int]]) -> DataFrame:
    """captures: group, case_id, kinds (array of those seen), truth; with Wilson intervals.

    A capture detects a family if it has all its kinds. A case is detected if
    most of its captures detect any, and true if all its captures are.
    """
    detected = F.lit(False)
    for need in families.values():
        detected = detected | (F.size(F.array_except(F.array(*[F.lit(k) for k in need]), "kinds")) == 0)
    cases = captures.groupBy(group, "case_id").agg((2 * F.count_if(detected) > F.count("*")).alias("hit"), F.min("truth").alias("truth"))
    m = cases.groupBy(group).agg(
        F.count("*").alias("n_case"), F.count_if(F.col("hit") & F.col("truth")).alias("tp"), F.count_if(~F.col("hit") & ~F.col("truth")).alias("tn"),
        F.count_if(F.col("hit") & ~F.col("truth")).alias("fp"), F.count_if(~F.col("hit") & F.col("truth")).alias("fn"),
    )
    rate = lambda k, n, name: [round6(F.when(n > 0, k / n)).alias(name), round6(wilson(k, n, -1)).alias(f"{name}_low"), round6(wilson(k, n, 1)).alias(f"{name}_high")]
    c = F.col
    return m.select(group, "n_case", "tp", "tn", "fp", "fn", *rate(c("tp"), c("tp") + c("fn"), "sensitivity"), *rate(c("tn"), c("tn") + c("fp"), "specificity"), *rate(c("tp") + c("tn"), c("n_case"), "accuracy"))


def clock_drift(edges: DataFrame, key: str, at: str, tick: float) -> DataFrame:
    """Intervals between edges: mean, median, deviation, nearest-rank p95, and drift against the nominal tick in ppm."""
    # edges at one time are alike, so they are put in order by any of their columns
    d = scan(edges.select(key, at, F.monotonically_increasing_id().alias("tie")), [key], [at, "tie"], lag={"before": F.col(at)})
    d = settle(d.select(key, (F.col(at) - F.col("before")).alias("gap")).where("gap is not null"))
    g = d.groupBy(key).agg(F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("sd"))
    g = g.join(exact_quantiles(d, [key], "gap", {"median": 0.5}, {"p95": 0.95}), key)
    return g.select(key, "n", F.round("mean", 3).alias("mean"), F.round("median", 3).alias("median"), F.round("sd", 3).alias("sd"), "p95", F.round((F.col("mean") / tick - 1) * 1e6, 3).alias("drift_ppm"))


def epoch_join(observer: DataFrame, uart: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(observer epochs with the UART's tick, observer epochs that the UART doesn't have). observer: keys, epoch, at; uart: keys, epoch, tick."""
    by = [*keys, "epoch"]
    return observer.join(uart.select(*by, "tick"), by), observer.join(uart.select(*by), by, "left_anti")


def clock_residual(joined: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """Per key, over consecutive joined epochs: intervals, mean and largest absolute difference of the observer's interval and ``scale`` times the UART's."""
    w = W.partitionBy(*keys).orderBy("epoch")
    r = joined.withColumns({"dt": F.col("at") - F.lag("at").over(w), "du": F.col("tick") - F.lag("tick").over(w)}).where("dt is not null").withColumn("residual", F.col("dt") - F.lit(scale) * F.col("du"))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("residual"), 3).alias("mean_residual"), F.round(F.max(F.abs("residual")), 3).alias("max_residual"))


def perturbation(rows: DataFrame, key: str, variant: str, base: str, metrics: list[str]) -> DataFrame:
    """(value - base) / base of each variant and metric, with a status."""
    long = rows.select(key, variant, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(key, variant, "x.*")
    b = long.where(F.col(variant) == base).select(key, "metric", F.col("value").alias("base"))
    j = long.where(F.col(variant) != base).join(b, [key, "metric"], "left")
    status = F.when(F.col("base").isNull(), "NO_BASE").when(F.col("value").isNull(), "NO_VALUE").when(F.col("base") == 0, "ZERO_BASE").otherwise("OK")
    return j.select(key, variant, "metric", status.alias("status"), F.when(status == "OK", round6((F.col("value") - F.col("base")) / F.col("base"))).alias("relative"))


def reconcile(counters: DataFrame, key: str, equations: dict[str, str]) -> DataFrame:
    """Names of the equations (SQL conditions) that don't hold, per row."""
    wrong = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), n) for n, c in equations.items()])), ",")
    return counters.select(key, wrong.alias("failing"), (wrong == "").alias("consistent"))


#: A collector's counters, and the equations between them by name.
COUNTERS = (
    "attempted_records", "accepted_records", "dropped_records", "buffer_overflow_dropped_records", "rejected_payload_records", "integrity_markers", "loss_delta_total", "overflow_delta_total",
    "flushed_records", "decoded_records", "wire_frames", "wire_bytes", "crc_failures", "truncations", "backpressure_total", "buffer_high_watermark", "buffer_capacity_records",
)
EQUATIONS = {
    "attempted_equals_accepted_plus_dropped": "attempted_records = accepted_records + dropped_records",
    "dropped_classification_closed": "dropped_records = buffer_overflow_dropped_records + rejected_payload_records",
    "drained_flush_closed": "flushed_records = accepted_records + integrity_markers",
    "decoded_equals_flushed": "decoded_records = flushed_records",
    "loss_delta_equals_overflow_drops": "loss_delta_total = buffer_overflow_dropped_records",
    "overflow_delta_equals_overflow_drops": "overflow_delta_total = buffer_overflow_dropped_records",
    "hwm_within_capacity_records": "buffer_high_watermark <= buffer_capacity_records",
    "wire_inventory_observed": "inventory_frames = wire_frames and inventory_bytes = wire_bytes",
}


def reconcile_collector(facts: DataFrame, keys: list[str]) -> DataFrame:
    """facts: keys, observed, COUNTERS, inventory_frames, inventory_bytes, capacity_unit, watermark_unit. State, whether all equations hold, and the names of those that don't.

    Nothing is judged where counters weren't observed; missing or negative
    counters, and units other than records, are errors of their own.
    """
    missing = " or ".join(f"{c} is null or {c} < 0" for c in COUNTERS)
    failing = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), n.upper()) for n, c in EQUATIONS.items()])), ",")
    reasons = (
        F.when(~F.coalesce("observed", F.lit(False)), "COUNTERS_NOT_OBSERVED")
        .when(F.expr(missing), "COUNTERS_INCOMPLETE")
        .when(F.expr("coalesce(capacity_unit, watermark_unit) is not null and not (capacity_unit <=> 'records' and watermark_unit <=> 'records')"), "UNITS")
        .otherwise(failing)
    )
    return facts.select(*keys, F.when(F.col("observed"), "observed").otherwise("not_observed").alias("observation_state"), (reasons == "").alias("passed"), reasons.alias("reasons"))


def raw_facts(events: DataFrame) -> DataFrame:
    """Missing sequence numbers and loss totals per dataset."""
    w = W.partitionBy("dataset_id", "core_id").orderBy("seq")
    e = events.withColumn("step", F.col("seq") - F.lag("seq").over(w) - 1)
    return e.groupBy("dataset_id").agg(F.coalesce(F.sum(F.greatest("step", F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum("lost_count"), F.lit(0)).alias("lost"), F.coalesce(F.sum("overflow_count"), F.lit(0)).alias("overflowed"))


def ledger_violations(ledger: DataFrame, key: str) -> DataFrame:
    """ledger: key, append_sequence, digest, previous_digest, record_id, session. Rows where the numbering or the chain breaks, an id repeats, or the ledger has several sessions."""
    w = W.partitionBy(key).orderBy("append_sequence")
    whole = W.partitionBy(key)
    x = ledger.withColumns({"n": F.row_number().over(w), "before": F.lag("digest").over(w), "same": F.count("*").over(W.partitionBy(key, "record_id")), "s0": F.min("session").over(whole), "s1": F.max("session").over(whole)})
    bad = F.array_join(F.array_compact(F.array(F.when(F.col("append_sequence") != F.col("n"), "SEQUENCE"), F.when(~F.col("previous_digest").eqNullSafe(F.col("before")), "CHAIN"), F.when(F.col("same") > 1, "DUPLICATE_ID"), F.when(F.col("s0") != F.col("s1"), "SESSION"))), ",")
    return x.select(key, "append_sequence", bad.alias("violation")).where("violation <> ''")


def _followed_back(rows: DataFrame, key: str) -> DataFrame:
    """Every version's walk to its first ancestor, by pointer doubling: back (null once it has ended), steps and the least version on the way.

    After as many doublings as the largest key has versions in binary digits, a walk that hasn't ended runs in a cycle, and ``back`` is on it.
    """
    most = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    known = rows.select(key, "version").distinct()
    # priors that are nowhere end a walk, like none
    walks = rows.groupBy(key, "version").agg(F.min("prior").alias("prior")).join(known.withColumnRenamed("version", "prior").withColumn("there", F.lit(True)), [key, "prior"], "left")
    walks = settle(walks.select(key, "version", F.when(F.col("there"), F.col("prior")).alias("back"), F.lit(1).alias("steps"), F.col("version").alias("least")))
    for _ in range(int(most).bit_length()):
        if walks.where("back is not null").isEmpty():
            break
        on = walks.select(key, F.col("version").alias("back"), F.col("back").alias("further"), F.col("steps").alias("more"), F.col("least").alias("low"))
        j = walks.join(on, [key, "back"], "left")
        steps = F.when(F.col("back").isNull(), F.col("steps")).otherwise(F.col("steps") + F.col("more"))
        walks = settle(j.select(key, "version", F.col("further").alias("back"), steps.alias("steps"), F.least("least", "low").alias("least")))
    return walks


def version_cycles(rows: DataFrame, key: str) -> DataFrame:
    """rows: key, version, prior. Each cycle of priors: key, cycle (its least version), length."""
    return _cycles(_followed_back(rows, key), key)


def _cycles(walks: DataFrame, key: str) -> DataFrame:
    on = walks.where("back is not null").select(key, F.col("back").alias("version")).distinct()
    return walks.join(on, [key, "version"]).groupBy(key, F.col("least").alias("cycle")).agg(F.count("*").alias("length"))


def current_version(rows: DataFrame, key: str) -> DataFrame:
    """rows: key, version, prior. Per key: versions, repeated ones, leaves, forks, dangling priors, roots, cycles and records on them; and the current version.

    That is the only leaf, if the walk back from it ends at the only root and meets every version.
    """
    prior = rows.where("prior is not null").groupBy(key, F.col("prior").alias("version")).agg(F.count("*").alias("followers"))
    j = rows.select(key, "version").distinct().withColumn("own", F.lit(1)).join(prior, [key, "version"], "full")
    g = j.groupBy(key).agg(
        F.count_if(F.col("followers").isNull()).alias("leaves"), F.count_if(F.col("followers") > 1).alias("forks"), F.count_if(F.col("own").isNull()).alias("dangling"),
        F.max(F.when(F.col("followers").isNull(), F.col("version"))).alias("leaf"),
    )
    known = rows.groupBy(key).agg(F.count_distinct("version").alias("versions"), F.count("*").alias("n"), F.count_if(F.col("prior").isNull()).alias("roots"))
    walks = _followed_back(rows, key)
    cycles = _cycles(walks, key).groupBy(key).agg(F.count("*").alias("cycles"), F.sum("length").alias("cycle_records"))
    walks = walks.where("back is null").select(key, F.col("version").alias("leaf"), F.col("steps").alias("chain"))
    g = g.join(known, key).join(cycles, key, "left").join(walks, [key, "leaf"], "left").na.fill(0, ["cycles", "cycle_records"])
    ok = (F.col("leaves") == 1) & (F.col("forks") == 0) & (F.col("dangling") == 0) & (F.col("roots") == 1) & (F.col("n") == F.col("versions")) & (F.col("chain") == F.col("versions"))
    return g.select(key, "versions", (F.col("n") - F.col("versions")).alias("repeated"), "leaves", "forks", "dangling", "roots", "cycles", "cycle_records", F.when(ok, F.col("leaf")).alias("current"))


def epoch_pairing(begins: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """begins, ends: key, epoch. Unpaired epochs, and whether the paired ones are contiguous."""
    b = begins.select(key, "epoch").distinct().withColumn("b", F.lit(True))
    e = ends.select(key, "epoch").distinct().withColumn("e", F.lit(True))
    j = b.join(e, [key, "epoch"], "full")
    paired = F.when(F.col("b") & F.col("e"), F.col("epoch"))
    g = j.groupBy(key).agg(F.count_if(F.col("e").isNull()).alias("unended"), F.count_if(F.col("b").isNull()).alias("unbegun"), F.count(paired).alias("pairs"), F.min(paired).alias("lo"), F.max(paired).alias("hi"))
    return g.select(key, "unended", "unbegun", "pairs", (F.col("hi") - F.col("lo") + 1 == F.col("pairs")).alias("contiguous"))


#: The six records of a capture, and which of their fields must be equal.
KINDS = ("ledger", "ccm", "cir", "oar", "inventory", "cvr")
BINDINGS = {
    "SESSION": ("ledger.session", "ccm.session", "cir.session", "oar.session", "inventory.session", "cvr.session"),
    "CASE": ("ledger.case_id", "oar.case_id", "cvr.case_id"),
    "CONFIG": ("ledger.config", "ccm.config"),
    "MANIFEST": ("cir.ccm_digest", "ccm.digest"),
    "RAW_ID": ("inventory.raw_id", "cir.raw_id", "cvr.raw_id"),
    "RAW_HASH": ("inventory.raw_hash", "cir.raw_hash", "cvr.raw_hash"),
    "OBSERVER": ("ledger.oar_digest", "oar.digest"),
    "VALIDITY": ("ledger.cvr_digest", "cvr.digest"),
    "EVIDENCE_CCM": ("cvr.ccm_digest", "ccm.digest"),
    "EVIDENCE_CIR": ("cvr.cir_digest", "cir.digest"),
    "EVIDENCE_OAR": ("cvr.oar_digest", "oar.digest"),
    "EVIDENCE_INVENTORY": ("cvr.inventory_digest", "inventory.digest"),
}


def capture_bundles(records: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per capture with the record of each kind as a struct (null where it is missing); the kinds are stacked and meet in one shuffle."""
    whole = {k: F.struct(*[c for c in records[k].columns if c != key]).alias(k) for k in KINDS}
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [records[k].select(key, whole[k]) for k in KINDS])
    return stacked.groupBy(key).agg(*[F.first(k, ignorenulls=True).alias(k) for k in KINDS])


def bundle_violations(records: dict[str, DataFrame], key: str) -> DataFrame:
    """records: a table for each of KINDS. Per capture the missing records and broken bindings, and whether it may be scored:
    nothing is broken, the capture is valid, its raw trace there, its integrity and observer records complete."""
    j = capture_bundles(records, key)
    broken = [F.when(F.col(k).isNull(), f"NO_{k.upper()}") for k in KINDS]
    for name, (head, *rest) in BINDINGS.items():
        differs = reduce(lambda a, b: a | b, [F.coalesce(F.col(head) != F.col(r), F.lit(False)) for r in rest])
        broken.append(F.when(differs, name))
    bad = F.array_join(F.array_compact(F.array(*broken)), ",")
    fit = F.coalesce((F.col("cvr.status") == "valid") & F.col("inventory.available") & F.col("cir.complete") & F.col("oar.complete"), F.lit(False))
    return j.select(key, bad.alias("violation"), ((bad == "") & fit).alias("eligible"))
