"""URL filtering by host and path rules, and by a character language-model ratio where no rule fits.

All of it is DataFrame expressions. Two character models, of URLs that rules accept and of
those that rules reject, back off from two characters of context to one and none (Witten-Bell).
Their log ratios for every character triple of a fixed alphabet are one dense array, so that a
URL is scored by array lookups in one pass, without a join. A URL's ratio is divided by its
length and compared with the threshold that best parts the accepted from the rejected, among a
fifth of the URLs that rules decide, which the models don't learn from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talusgrid.llm import runtime as R

#: Characters told apart; any other is code 0, and code EDGE stands before and after a URL.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./:?=&%-_#~+@"
EDGE = len(ALPHABET) + 1
SYMBOLS = EDGE + 1
#: Scores are put in bins of this width, and within this range, to set the threshold.
BIN, RANGE = 0.01, 20.0
#: One in so many of the URLs that rules decide, by a hash, sets the threshold.
APART = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does. A rule is (verdict, host/path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, p = rule.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def _codes(url: Column) -> Column:
    low = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    inner = F.when(low == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(low, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET))))
    edge = F.lit(EDGE)
    return F.concat(F.array(edge, edge), inner, F.array(edge))


def _key(codes: Column, i: Column) -> Column:
    """The number of the character triple that ends at position i (from 0)."""
    return (F.get(codes, i - 2) * SYMBOLS + F.get(codes, i - 1)) * SYMBOLS + F.get(codes, i)


def _positions(codes: Column) -> Column:
    return F.sequence(F.lit(2), F.size(codes) - 1)


def log_ratios(urls: DataFrame) -> DataFrame:
    """One row ``ratios``: ln P_allow - ln P_block of every character triple, from rows (url, verdict).

    The SYMBOLS ** 3 numbers, whatever the input, are joined with commas in the triples' order.
    """
    spark = urls.sparkSession
    a = SYMBOLS
    coded = urls.select("verdict", _codes(F.col("url")).alias("codes"))
    seen = coded.select("verdict", F.explode(F.transform(_positions(F.col("codes")), lambda i: _key(F.col("codes"), i))).alias("key")).groupBy("verdict", "key").agg(F.count("*").cast("double").alias("n"))
    triples = R.stored(seen, "triples")
    pairs = triples.groupBy("verdict", (F.col("key") % (a * a)).alias("key2")).agg(F.sum("n").alias("n2"))
    singles = pairs.groupBy("verdict", (F.col("key2") % a).alias("key1")).agg(F.sum("n2").alias("n1"))
    by_two = triples.groupBy("verdict", F.floor(F.col("key") / a).alias("two")).agg(F.sum("n").alias("s2"), F.count("*").alias("t2"))
    by_one = pairs.groupBy("verdict", F.floor(F.col("key2") / a).alias("one")).agg(F.sum("n2").alias("s1"), F.count("*").alias("t1"))
    by_none = singles.groupBy("verdict").agg(F.sum("n1").alias("s0"), F.count("*").alias("t0"))
    grid = spark.range(a**3).select(F.col("id").cast("int").alias("key"), F.explode(F.array(F.lit("allow"), F.lit("block"))).alias("verdict"))
    grid = grid.withColumns({"key2": F.col("key") % (a * a), "key1": F.col("key") % a, "two": F.floor(F.col("key") / a), "one": F.floor(F.col("key") / a) % a})
    for counts, on in ((triples, ["verdict", "key"]), (pairs, ["verdict", "key2"]), (singles, ["verdict", "key1"]), (by_two, ["verdict", "two"]), (by_one, ["verdict", "one"]), (by_none, ["verdict"])):
        grid = grid.join(F.broadcast(counts), on, "left")  # each has at most SYMBOLS ** 3 rows for a verdict
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("n", "n2", "n1", "s2", "t2", "s1", "t1", "s0", "t0")}
    p0 = (zero["n1"] + zero["t0"] / a + 1.0 / a) / (zero["s0"] + zero["t0"] + 1.0)
    p1 = F.when(zero["s1"] > 0, (zero["n2"] + zero["t1"] * p0) / (zero["s1"] + zero["t1"])).otherwise(p0)
    p2 = F.when(zero["s2"] > 0, (zero["n"] + zero["t2"] * p1) / (zero["s2"] + zero["t2"])).otherwise(p1)
    logs = grid.select("key", F.when(F.col("verdict") == "allow", F.ln(p2)).otherwise(-F.ln(p2)).alias("l"))
    ratio = logs.groupBy("key").agg(F.sum("l").alias("l"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("key", "l"))), lambda x: F.round(x["l"], 5).cast("string"))
    return ratio.agg(F.array_join(listed, ",").alias("ratios"))


def with_score(urls: DataFrame, ratios: Column) -> DataFrame:
    """The rows with ``score``, the ratio of their url by its length."""
    # the codes are a column of their own, lest each position computes them anew
    coded = urls.withColumn("_codes", _codes(F.col("url")))
    codes = F.col("_codes")
    total = F.aggregate(_positions(codes), F.lit(0.0), lambda s, i: s + F.get(ratios, _key(codes, i)))
    return coded.withColumn("score", total / (F.size(codes) - 2)).drop("_codes")


def threshold(scored: DataFrame) -> DataFrame:
    """One row ``threshold``: the score from which URLs are allowed, from rows (score, verdict).

    It maximises the share of accepted URLs at or above it plus that of rejected ones below;
    the one nearest zero among equals. Without URLs of both kinds there is no row.
    """
    bins = scored.select(F.floor(F.least(F.greatest("score", F.lit(-RANGE)), F.lit(RANGE)) / BIN).alias("bin"), "verdict").groupBy("bin").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over at most 2 * RANGE / BIN + 1 rows
    every = Window.partitionBy()
    sums = bins.select("bin", F.coalesce(F.sum("a").over(below), F.lit(0)).alias("lost"), F.coalesce(F.sum("b").over(below), F.lit(0)).alias("caught"), F.sum("a").over(every).alias("na"), F.sum("b").over(every).alias("nb"))
    gain = (F.col("caught") / F.col("nb") - F.col("lost") / F.col("na")).alias("gain")
    return sums.where("na > 0 and nb > 0").select("bin", gain).orderBy(F.desc(F.round("gain", 9)), F.abs("bin"), "bin").limit(1).select((F.col("bin") * BIN).alias("threshold"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of pages (key, url).

    Null URLs and those without ``://`` have an empty host and path, so that no rule fits them,
    and are scored as they are (null: empty). Where the rules accept or reject no URL at all
    there is nothing to compare and the rest is allowed. Where one kind is missing among the
    URLs set apart, or among the rest, all of them serve for both. Repeated rows are judged
    alike; URLs of any length are read whole; an empty table gives no rows.
    """
    pages = R.columns(pages, key, "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(key, "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    known = R.stored(rows.where("ruled is not null").select("url", F.col("ruled").alias("verdict"), (F.pmod(F.xxhash64("url"), F.lit(APART)) == 0).alias("apart")), "ruled")
    kinds = {(r.verdict, r.apart) for r in known.select("verdict", "apart").distinct().collect()}
    if len({v for v, _ in kinds}) < 2:
        return rows.select(key, "host", "path", "rule", F.coalesce(F.col("ruled"), F.lit("allow")).alias("verdict"))
    whole = len(kinds) < 4
    # a constant of the plan, which the optimiser turns into one array
    ratios = F.split(F.lit(log_ratios(known if whole else known.where("not apart")).first().ratios), ",").cast("array<double>")
    at = threshold(with_score(known if whole else known.where("apart"), ratios)).first().threshold
    by_method = F.when(F.col("score") < at, F.lit("block")).otherwise(F.lit("allow"))
    # rules decide first: the others alone are scored
    scored = with_score(rows.withColumn("url", F.when(F.col("ruled").isNull(), F.col("url"))), ratios)
    return scored.select(key, "host", "path", "rule", F.coalesce(F.col("ruled"), by_method).alias("verdict"))
