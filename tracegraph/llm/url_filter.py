"""URL filter: host and path rules, and for other URLs a ratio of two character language models.

The models are variable-order Markov models (contexts of 0 to 3 characters, Witten-Bell interpolation) of the
host and path of the URLs that rules accept and of those that they reject. Characters fall in 32 classes, so a model
has 32^4 entries however many URLs there are: one array of 2^20 log ratios, looked up where the characters are. The
score is the mean log ratio per character; its threshold is the one with the best balanced accuracy on a
fifth of the ruled URLs that the counts leave out. DataFrame functions only.

Defined results: a null URL or one without `://` has empty host and path, no rule and score 0; the threshold
is 0 where either class has no URL to calibrate on; repeated rows are judged and counted each; an empty table gives no rows;
other columns (no maps) pass untouched, and where one has the name of a column to be added, that one gets underscores after its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._common import Sealed, cut

#: (host, path, verdict). A rule fits its host and all subdomains where the path starts with its own.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
ORDER = 3  # characters of context
CLASSES = 32  # 0 start, 1-26 letters, 27 digits, 28 '/', 29 '.', 30 '-' and '_', 31 all others
SIZE = CLASSES ** (ORDER + 1)
HELD_OUT = 5  # each so many, by hash, calibrates the threshold
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict: of the longest rule that fits, or null."""
    ruled = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = verdict = None
    for host, path, said in ruled:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    null = F.lit(None).cast("string")
    return df.withColumn("rule", null if rule is None else rule).withColumn("rule_verdict", null if verdict is None else verdict)


def grams(text: Column) -> Column:
    """For each character its class and those of the three before, as one number below 2^20."""
    s = F.translate(F.lower(text), "123456789_", "000000000-")
    code = lambda c: F.coalesce(F.nullif(F.instr(F.lit("abcdefghijklmnopqrstuvwxyz0/.-"), c), F.lit(0)), F.lit(31))
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), code)
    at = lambda k: F.concat(F.array_repeat(F.lit(0), F.lit(k)), codes)
    add_null = lambda x, y: F.coalesce(x, F.lit(0)) + y
    shifted = lambda k: F.transform(at(k), lambda c: c * CLASSES**k)
    summed = F.zip_with(F.zip_with(F.zip_with(codes, shifted(1), add_null), shifted(2), add_null), shifted(3), add_null)
    return F.slice(summed, F.lit(1), F.size(codes))


def counts(labelled: DataFrame) -> DataFrame:
    """(gram, accepted, rejected) of all rows of text, accept."""
    each = labelled.select("accept", F.explode(grams(F.col("text"))).alias("gram"))
    return each.groupBy("gram").agg(F.sum(F.col("accept").cast("long")).alias("accepted"), F.sum((~F.col("accept")).cast("long")).alias("rejected"))


def log_ratios(counted: DataFrame) -> DataFrame:
    """One row, `ratios`: for each of the 2^20 grams, log p(character | context) if accepted less if rejected."""
    spark = counted.sparkSession
    prob = spark.range(CLASSES).select(F.col("id").cast("int").alias("g"), F.lit(1.0 / CLASSES).alias("pa"), F.lit(1.0 / CLASSES).alias("pr"))
    for k in range(ORDER + 1):  # from the shortest context on; the table of order k has 32^(k+1) rows
        size = CLASSES ** (k + 1)
        c = counted.groupBy(F.col("gram").bitwiseAND(size - 1).alias("g")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
        context = F.shiftright("g", 5).alias("x")
        t = c.groupBy(context).agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"), F.sum((F.col("a") > 0).cast("int")).alias("ta"), F.sum((F.col("r") > 0).cast("int")).alias("tr")
        )
        every = spark.range(size).select(F.col("id").cast("int").alias("g")).withColumn("x", F.shiftright("g", 5))
        low = prob.withColumnRenamed("g", "l")
        every = every.withColumn("l", F.col("g").bitwiseAND(size // CLASSES - 1) if k else F.col("g"))
        row = every.join(low, "l").join(c, "g", "left").join(t, "x", "left").na.fill(0)
        mixed = lambda n, total, types, p: F.when(total + types > 0, (n + types * p) / (total + types)).otherwise(p)
        prob = row.select(
            "g", mixed(F.col("a"), F.col("na"), F.col("ta"), F.col("pa")).alias("pa"), mixed(F.col("r"), F.col("nr"), F.col("tr"), F.col("pr")).alias("pr")
        )
    ratio = F.log(F.col("pa") / F.col("pr")).cast("float")
    # a row for each of 1,024 runs, then one: no task holds more than the table's fixed size
    runs = prob.groupBy(F.shiftright("g", 10).alias("run")).agg(F.sort_array(F.collect_list(F.struct("g", ratio.alias("v")))).alias("part"))
    one = runs.agg(F.sort_array(F.collect_list(F.struct("run", F.col("part.v").alias("v")))).alias("all"))
    return one.select(F.flatten("all.v").alias("ratios"))


def score(df: DataFrame, ratios: Column) -> DataFrame:
    """df with score, the mean log ratio of the characters of text (0 if null or empty). df keeps its other columns.

    The table of ratios is a scalar subquery, which no function of arrays may hold, so characters are rows for a while: they are
    added up in the task that makes them, and what is shuffled is one row each. The other columns are those of a group, so none may be a map.
    """
    columns = [c for c in df.columns if c != "text"]
    each = df.select(*columns, F.posexplode_outer(grams(F.col("text"))).alias("_at", "_gram"))
    mean = F.coalesce(F.avg(F.get(ratios, F.col("_gram")).cast("double")), F.lit(0.0))
    repeats = F.sum(F.when(F.coalesce("_at", F.lit(0)) == 0, 1).otherwise(0))
    once = each.groupBy(*columns).agg(mean.alias("score"), repeats.alias("_n"))
    return once.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).drop("_n")


def threshold(scored: DataFrame) -> float:
    """The score, to hundredths, from which accepting has the best balanced accuracy on rows of score, accept."""
    bins = scored.groupBy(F.round(F.greatest(F.least("score", F.lit(10.0)), F.lit(-10.0)) * 100).cast("int").alias("bin")).agg(
        F.sum(F.col("accept").cast("long")).alias("a"), F.sum((~F.col("accept")).cast("long")).alias("r")
    )
    rows = sorted((x["bin"], x["a"], x["r"]) for x in bins.collect())  # 2,001 bins at most
    good, bad = sum(x[1] for x in rows), sum(x[2] for x in rows)
    if not good or not bad:
        return 0.0
    best, at, left, over = -1.0, 0, good, bad
    for b, a, r in [*rows, (rows[-1][0] + 1, 0, 0)]:
        value = left / good + 1 - over / bad  # accepting all from bin b on
        if value > best + 1e-12:
            best, at = value, b
        left, over = left - a, over - r
    return at / 100 - 0.005


def judge(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls (url and any others) with host, path, rule, verdict (`allow` or `block`) and score (null where a rule decides)."""
    seal = Sealed(urls)
    url = F.col(seal["url"])
    df = with_rule(seal.df.withColumn("host", host_of(url)).withColumn("path", path_of(url)), rules).withColumn("text", F.concat("host", "path"))
    held = F.pmod(F.crc32(url.cast("binary")), F.lit(HELD_OUT)) == 0
    labelled = df.where(F.col("rule").isNotNull()).select("text", (F.col("rule_verdict") == "allow").alias("accept"), held.alias("held"))
    model = cut(log_ratios(cut(counts(labelled.where(~F.col("held"))))))
    ratios = model.select("ratios").scalar()
    limit = threshold(score(labelled.where("held").select("accept", "text", F.col("text").alias("of")), ratios))
    judged = score(df.withColumn("text", F.when(F.col("rule").isNull(), F.col("text"))), ratios)
    judged = judged.withColumn("score", F.when(F.col("rule").isNull(), F.col("score")))
    judged = judged.withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("score") >= limit, "allow").otherwise("block")))
    return seal.opened(judged, host="host", path="path", rule="rule", verdict="verdict", score="score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged; score is null where a rule decides."""
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(urls).select("page_id", "host", "path", "rule", "verdict", "score")
