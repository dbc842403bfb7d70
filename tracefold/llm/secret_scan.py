"""Secret scan with corpus-wide ownership frequency.

Base patterns (assignments, access keys, long hex runs) and generic
key-shaped tokens give candidates. Each candidate's hash is counted over the
whole corpus by distinct repository and distinct owner. A value that several
owners or many repositories have is a widely copied example; one that stays
with few of both and looks live (mixed characters, many different ones) is owner-specific. Generic
tokens found owner-specific are added as spans of kind ``owned``; base spans
always stay and are counted as live or example.

Offsets come from the texts between the matches, summed by a window over the
matches of a text, so a text of many secrets costs no more per secret.
Everything is a built-in function; counting combines on the map side, and
only candidates are shuffled. The counts are written before they are joined
back, so that adaptive execution can split a value that very many rows have.

Defined results: null text is empty text; a null owner or repository counts
as one of its own; every row of the input gives one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import settle

#: Fixed values of the base patterns.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
KINDS = ("assign", "access", "hex", "owned")
MIN_ASSIGN = 6


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(either_case(w) for w in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"


def matches(found: str, pattern: str, kind: int, value: Column | None = None) -> Column:
    """array<struct<kind, i, gap, len, value>> of all matches of a pattern in ``text``: column ``found`` has them; gap counts the code points since the match before."""
    gaps = F.transform(F.split(F.col("text"), pattern), F.char_length)
    rows = F.slice(F.arrays_zip(gaps.alias("gap"), F.col(found).alias("match"), (F.col(found) if value is None else value).alias("value")), 1, F.size(found))
    made = F.transform(rows, lambda r, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), r["gap"].alias("gap"), F.char_length(r["match"]).alias("len"), r["value"].alias("value")))
    return F.when(F.size(found) > 0, made).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,value:string>>"))


def live_looking(value: Column) -> Column:
    """Letters and digits, and at least ten different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def listed(array: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = 2, max_repositories: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, base and all (arrays of spans; those of all with n_repositories), n_live, n_example (base spans by ownership)."""
    texts = docs.select("doc_id", F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.withColumns({name: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for name, p in (("m0", ASSIGN), ("m1", ACCESS), ("m2", HEX), ("m3", TOKEN))})
    values = F.when(F.size("m0") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)))
    every = F.concat(matches("m0", ASSIGN, 0, values), matches("m1", ACCESS, 1), matches("m2", HEX, 2), matches("m3", TOKEN, 3))
    found = settle(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", every.alias("matches")))

    places = found.select("row", "repository", "owner", F.explode("matches").alias("m")).select("row", "repository", "owner", "m.*").repartition("row")
    end = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    places = places.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    base = F.col("kind") < 3
    places = places.where(F.when(F.col("kind") == 0, F.char_length("value") >= MIN_ASSIGN).when(F.col("kind") == 3, live_looking(F.col("value"))).otherwise(True))
    # a generic token goes if a base span that starts before it ends in it, or one starts in it
    reached = F.max(F.when(base, F.col("end"))).over(W.partitionBy("row").orderBy("start").rangeBetween(W.unboundedPreceding, 0))
    ahead = F.min(F.when(base, F.col("start"))).over(W.partitionBy("row").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, 0))
    places = places.withColumns({"reached": reached, "ahead": ahead})
    apart = base | ((F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end")))
    places = settle(places.where(apart).select("row", "repository", "owner", F.struct("start", "kind", "end", "value").alias("span"), F.sha2("value", 256).alias("hash")))

    named = [F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(c))) for c in ("repository", "owner")]
    spread = settle(places.groupBy("hash").agg(F.count_distinct(named[0]).alias("n_repositories"), F.count_distinct(named[1]).alias("n_owners")))
    judged = places.join(spread, "hash").withColumn("own", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    base, span = F.col("span.kind") < 3, F.struct("span.*", "n_repositories")
    verdicts = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(base, F.col("span")))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("own") | base, span))).alias("all"),
        F.count_if(F.col("own") & base & live_looking(F.col("span.value"))).alias("n_live"),
        F.count_if(~F.col("own") & base).alias("n_example"),
    )
    out = found.select("row", "doc_id").join(verdicts, "row", "left")
    empty = "array<struct<start:int,kind:int,end:int,value:string>>"
    return out.select(
        "doc_id",
        F.coalesce("base", F.array().cast(empty)).alias("base"),
        F.coalesce("all", F.array().cast(empty.replace(">>", ",n_repositories:bigint>>"))).alias("all"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
