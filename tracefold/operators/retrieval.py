"""Text chunks, TF-IDF search, snippets and case similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.tables import settle

#: What a word is, and a run of Chinese characters.
TOKEN = r"[a-z0-9_][a-z0-9_.:-]+"
CJK = r"[\x{4e00}-\x{9fff}]+"
LINES, OVERLAP = 32, 4


def doc_chunks(docs: DataFrame, lines: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, first_line (from 1), text: runs of lines that overlap."""
    step = lines - overlap
    d = docs.where("text is not null").select("doc_id", F.split("text", "\n").alias("ls"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ls") - 1 - overlap), F.lit(step))
    return d.select("doc_id", "ls", F.explode(starts).alias("at")).select("doc_id", (F.col("at") + 1).alias("first_line"), F.array_join(F.slice("ls", F.col("at") + 1, lines), "\n").alias("text"))


def _terms(text: Column) -> Column:
    """Lower-cased words, and of each Chinese run the characters and pairs of neighbours."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
    grams = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r)), lambda i: F.substr(r, i, F.lit(1))))
    pairs = F.transform(F.filter(runs, lambda r: F.char_length(r) > 1), lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))
    return F.concat(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), F.flatten(grams), F.flatten(pairs))


def tokens(chunks: DataFrame) -> DataFrame:
    """One row per chunk and term with its count."""
    return chunks.select("doc_id", "first_line", F.explode(_terms(F.col("text"))).alias("term")).groupBy("doc_id", "first_line", "term").agg(F.count("*").alias("tf"))


def term_totals(docs: DataFrame) -> DataFrame:
    """Chunks (df) and occurrences (tf) of each term over all chunks of the documents.

    A chunk is one row, so its terms are told apart within it and only totals are
    shuffled; documents that share an id, whose chunks count as one, go through ``tokens``.
    """
    shared = settle(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    some = not shared.isEmpty()
    own = docs.join(F.broadcast(shared), F.equal_null(docs.doc_id, shared.doc_id), "left_anti") if some else docs
    terms = doc_chunks(own).select(_terms(F.col("text")).alias("terms"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    row = lambda tf, df: lambda x: F.struct(x.alias("term"), tf.alias("tf"), df.alias("df"))
    rows = terms.select(F.explode(F.concat(F.transform("terms", row(one, none)), F.transform(F.array_distinct("terms"), row(none, one)))).alias("t")).select("t.*")
    if some:
        again = docs.join(F.broadcast(shared), F.equal_null(docs.doc_id, shared.doc_id), "left_semi")
        rows = rows.unionByName(tokens(doc_chunks(again)).select("term", "tf", one.alias("df")))
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def tfidf_search(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """queries: query_id, term, qtf, phrase. Score: sum of qtf * tf * (1 + ln(N / df)), plus 5 for the whole phrase."""
    terms = tokens(chunks).join(queries.select("term").distinct(), "term", "left_semi")  # the terms of the stated queries
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    total = chunks.agg(F.count("*").alias("total"))
    idf = df.join(F.broadcast(total)).withColumn("idf", 1 + F.log(F.col("total") / F.col("df")))  # total is one row
    scored = terms.join(idf.select("term", "idf"), "term").join(queries, "term")
    s = scored.groupBy("query_id", "doc_id", "first_line", "phrase").agg(F.sum(F.col("qtf") * F.col("tf") * F.col("idf")).alias("s"))
    s = s.join(chunks, ["doc_id", "first_line"]).withColumn("score", F.round(F.col("s") + F.when(F.contains(F.lower("text"), F.col("phrase")), 5.0).otherwise(0.0), 6))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "first_line")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "first_line", "score")


def snippet(chunks: DataFrame, term: str, around: int = 80) -> DataFrame:
    """Text around the first place of a term."""
    at = F.locate(term, F.lower("text"))
    return chunks.withColumn("at", at).where("at > 0").select("doc_id", "first_line", F.substring("text", F.greatest(F.lit(1), F.col("at") - around), F.lit(2 * around + len(term))).alias("snippet"))


def similar_cases(runs: DataFrame, cases: DataFrame, weights: dict[str, int], action: int = 6, missing: int = 2, k: int = 3) -> DataFrame:
    """The k cases most like each run: run_id, case_id, score, rank.

    runs: run_id, the features, actions (array), missing (array). cases:
    case_id, the features, action, missing. A feature with equal values (or
    null on both sides) gives its weight, a case whose action is among the
    run's gives ``action``, and each field that both lack ``missing``.

    Features are buckets, so the score depends on few distinct tuples: of the
    cases of one tuple only the k first can be among a run's best, and runs of
    one tuple have the same best cases. Only tuples meet each other, each of a
    bounded number of values, and rows are joined back by tuple.
    """
    feats = list(weights)
    kind = [*feats, "actions", "missing"]
    mine = runs.select(*kind).distinct().select(F.struct(*kind).alias("run"))
    tuples = [*feats, "action", "missing"]
    theirs = cases.withColumn("n", F.row_number().over(W.partitionBy(*tuples).orderBy("case_id"))).where(F.col("n") <= k)
    theirs = theirs.groupBy(*tuples).agg(F.array_sort(F.collect_list("case_id")).alias("ids")).select(F.struct(*tuples).alias("case"), "ids")
    score = sum((F.when(F.col(f"run.{f}").eqNullSafe(F.col(f"case.{f}")), w).otherwise(0) for f, w in weights.items()), F.lit(0))
    score = score + F.when(F.array_contains("run.actions", F.col("case.action")), action).otherwise(0) + missing * F.size(F.array_intersect("run.missing", "case.missing"))
    met = mine.join(theirs, F.lit(True)).select("run", score.alias("score"), F.explode("ids").alias("case_id"))
    best = met.withColumn("rank", F.row_number().over(W.partitionBy("run").orderBy(F.desc("score"), "case_id"))).where(F.col("rank") <= k)
    return runs.select("run_id", F.struct(*kind).alias("run")).join(best, "run").select("run_id", "case_id", "score", "rank")


def case_summary(similar: DataFrame, runs: DataFrame, cases: DataFrame, threshold: int) -> DataFrame:
    """Per run: matched and similar cases (from ``threshold``), best score, labels, actions with conflicting labels, whether an unsafe high-risk case matches, share of rejects with a reason.

    cases: also label, risk, reject_reason. An action conflicts if similar
    cases accept it and others don't, or call it unsafe and others less.
    """
    near = F.col("score") >= threshold
    told = similar.join(cases.select("case_id", "action", "label", "risk", "reject_reason"), "case_id").join(runs.select("run_id", "actions"), "run_id")
    proposed = F.array_contains("actions", F.col("action"))
    by_action = told.where(near & proposed).groupBy("run_id", "action").agg(F.collect_set("label").alias("ls"))
    any_of = lambda *labels: F.arrays_overlap("ls", F.array(*[F.lit(x) for x in labels]))
    clash = F.array_contains("ls", "accept") & any_of("reject", "unsafe", "abstain", "needs_more_data") | F.array_contains("ls", "unsafe") & any_of("reject", "abstain", "needs_more_data")
    conflicts = by_action.where(clash).groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("action")), ",").alias("conflicts"))
    rejected = F.col("label").isin("reject", "unsafe")
    g = told.groupBy("run_id").agg(
        F.count("*").alias("matched"),
        F.count_if(near).alias("similar"),
        F.max("score").alias("top_score"),
        F.array_join(F.array_sort(F.collect_set(F.when(near, F.col("label")))), ",").alias("labels"),
        F.max(near & (F.col("label") == "unsafe") & (F.col("risk") == "high") & proposed).alias("unsafe_match"),
        F.count_if(rejected).alias("rejects"),
        F.count_if(rejected & (F.col("reject_reason") != "")).alias("told"),
    )
    j = runs.select("run_id").join(g, "run_id", "left").join(conflicts, "run_id", "left")
    none = {"matched": 0, "similar": 0, "top_score": 0, "labels": "", "conflicts": "", "unsafe_match": False, "rejects": 0}
    return j.na.fill(none).select("run_id", "matched", "similar", "top_score", "labels", "conflicts", "unsafe_match", F.when(F.col("rejects") == 0, 1.0).otherwise(F.round(F.col("told") / F.col("rejects"), 6)).alias("reject_coverage"))
