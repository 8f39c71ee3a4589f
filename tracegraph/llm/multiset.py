"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (a line) is hashed to a wide vector; a text's fingerprint is the sum of its paragraphs' vectors,
each lane modulo a power of two. So it does not depend on their order, and adding or subtracting a
paragraph's vector inserts or deletes it (`inserted`, `deleted`); an edited text's vector is made so from that of the text before.
The vector has two parts:

- 16 lanes modulo 2^32, from eight 64-bit hashes of the whole paragraph: equality;
- 128 lanes modulo 2^16: how many of the paragraph's runs of up to three words, one from each word on, have a 1 at
  each of 128 bits of two hashes; with their number (modulo 2^16) these are sums of signs, whose cosine estimates
  the share of runs that two texts have in common: likeness. A word changed, put in or left out changes three runs at most.

DataFrame functions only. Defined results: a null text is empty; the empty text is one empty paragraph; rows
that share a doc_id and a text count as one document when the next is sought and have equal results; those that share a
doc_id only are in the order of a hash of their text; null doc_ids come first (held as the least long); an empty table gives no rows;
texts are read whole, however long; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ._common import cut, documents, fresh_path

SEEDS = 8
#: The run of up to three words at each word, as group 1; it does not go past the end of a line.
RUNS = r"(?=([^ \t-\r]++(?:[ \t\x0B\f\r]++[^ \t-\r]++){0,2}+))[^ \t-\r]++"
PAIR = 0x0000000100000001  # two lanes of 32 bits in one sum, so that no lane runs over into the next
LOW = 0xFFFFFFFF
NULL_ID = -(1 << 63)


def _dense() -> list[Column]:
    """Sums, over rows of kind `p`, of the halves of eight hashes of s."""
    out = []
    for seed in range(SEEDS):
        h = F.when(F.col("kind") == 0, F.xxhash64(F.lit(seed), F.col("s")))
        for k, half in enumerate((h.bitwiseAND(LOW), F.shiftrightunsigned(h, 32))):
            out.append(F.coalesce(F.sum(half), F.lit(0)).alias(f"d{2 * seed + k}"))
    return out


def _signs() -> list[Column]:
    """Sums, over rows of kind `r`, of the bits of two hashes of s, two bits a sum."""
    out = []
    for k in range(64):
        h = F.col("h1" if k < 32 else "h2")
        out.append(F.coalesce(F.sum(F.shiftrightunsigned(h, k % 32).bitwiseAND(PAIR)), F.lit(0)).alias(f"l{k}"))
    return out


def _hex(lanes: Column, digits: int) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")


def vectors(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key and vector (lanes of both parts, in as many bits as they have), for each key of rows; rows with one key add up."""
    whole = F.coalesce(F.col(text), F.lit(""))
    element = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("s"))
    paragraphs = F.transform(F.split(whole, "\n", -1), element(0))
    runs = F.transform(F.regexp_extract_all(whole, F.lit(RUNS), F.lit(1)), element(1))
    each = rows.select(*key, F.explode(F.concat(paragraphs, runs)).alias("e")).select(*key, "e.kind", "e.s")
    run = F.col("kind") == 1
    each = each.withColumn("h1", F.when(run, F.xxhash64("s"))).withColumn("h2", F.when(run, F.xxhash64(F.lit(1), F.col("s"))))
    sums = each.groupBy(*key).agg(*_dense(), *_signs(), F.sum("kind").cast("long").alias("_runs"))
    half = lambda x: F.when(x >= 32768, x - 65536).otherwise(x).cast("short")  # noqa: E731  16 bits as they are
    whole32 = lambda x: F.when(x > 0x7FFFFFFF, x - 0x100000000).otherwise(x).cast("int")
    dense = F.transform(F.array(*[F.col(f"d{i}") for i in range(2 * SEEDS)]), lambda x: whole32(x.bitwiseAND(LOW)))
    pairs = F.array(*[F.col(f"l{k}") for k in range(64)])
    lanes = F.concat(F.transform(pairs, lambda x: x.bitwiseAND(LOW)), F.transform(pairs, lambda x: F.shiftrightunsigned(x, 32)))
    counts = F.transform(lanes, lambda x: half(x.bitwiseAND(0xFFFF)))
    return sums.select(*key, F.struct(dense.alias("dense"), half(F.col("_runs").bitwiseAND(0xFFFF)).alias("runs"), counts.alias("counts")).alias("vector"))


def _lanes(v: Column, w: Column, sign: int) -> Column:
    """v + sign * w, lane by lane."""
    wrapped = lambda x, bits: (x + (1 << bits - 1)).bitwiseAND((1 << bits) - 1) - (1 << bits - 1)
    total = lambda bits, kind: lambda x, y: wrapped(x.cast("long") + sign * y.cast("long"), bits).cast(kind)
    return F.struct(
        F.zip_with(v["dense"], w["dense"], total(32, "int")).alias("dense"), total(16, "short")(v["runs"], w["runs"]).alias("runs"),
        F.zip_with(v["counts"], w["counts"], total(16, "short")).alias("counts"),
    )


def inserted(v: Column, w: Column) -> Column:
    """The vector of a text with the paragraphs of v and those of w."""
    return _lanes(v, w, 1)


def deleted(v: Column, w: Column) -> Column:
    """The vector of a text with the paragraphs of v without those of w, which must be among them."""
    return _lanes(v, w, -1)


def fingerprint(vector: Column) -> Column:
    """The vector as hex digits: 16 lanes of 8, the number of runs, 128 lanes of 4."""
    low = lambda x: x.cast("int").bitwiseAND(0xFFFF)
    dense = F.transform(vector["dense"], lambda x: x.cast("long").bitwiseAND(LOW))
    return F.concat(_hex(dense, 8), F.lit(":"), F.lpad(F.lower(F.hex(low(vector["runs"]))), 4, "0"), _hex(F.transform(vector["counts"], low), 4))


def signs(vector: Column) -> Column:
    """Ones less zeros at each bit, modulo 2^16, as the remainder nearest to 0."""
    return F.transform(vector["counts"], lambda c: (F.pmod(2 * c.cast("int") - vector["runs"] + 32768, F.lit(65536)) - 32768).cast("double"))


def likeness(v: Column, w: Column) -> Column:
    """Of two vectors: 1 if they are equal; else the cosine of their sums of signs, 0 at least, below 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    a, b = signs(v), signs(w)
    size = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(0.999999), dot(a, b) / size))).otherwise(F.lit(0.0))
    return F.when(v == w, 1.0).otherwise(cosine)


def successors(keys: DataFrame) -> DataFrame:
    """keys (_id, _th, n; distinct) with next_id, next_th, the key after it; after the last the first.

    The keys, without texts, are laid out by range; each part finds its own, the last of a part takes the first of the next part."""
    laid = cut(keys.repartitionByRange("_id", "_th").withColumn("part", F.spark_partition_id()))
    k = F.struct("_id", "_th")
    ends = laid.groupBy("part").agg(F.min(k).alias("low"))  # a row a part
    order = W.orderBy("part")
    first = F.first("low").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ends = ends.select("part", F.coalesce(F.lead("low").over(order), first).alias("beyond"))
    near = laid.withColumn("near", F.lead(k).over(W.partitionBy("part").orderBy("_id", "_th")))
    to = F.coalesce("near", "beyond")
    return near.join(ends, "part").select("_id", "_th", "n", to["_id"].alias("next_id"), to["_th"].alias("next_th"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document's."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("_id", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("_th", F.xxhash64("text"))
    # both uses of rows read the same columns, so that one exchange of texts serves both
    rows = docs.groupBy("_id", "_th").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    order = cut(successors(docs.select("_id", "_th", F.length("text").cast("long").alias("n")).distinct()))
    need = F.expr("n div 4").cast("int")
    asked = order.select(F.col("_id").alias("of_id"), F.col("_th").alias("of_th"), F.col("next_id").alias("_id"), F.col("next_th").alias("_th"), "n")
    heads = rows.where("copies > 0").join(asked, ["_id", "_th"]).select(
        F.col("of_id"), F.col("of_th"), F.col("_id").alias("next_id"), F.col("_th").alias("next_th"), "n", F.substring("text", F.lit(1), need).alias("head")
    )
    both = rows.join(heads, (F.col("_id") == F.col("of_id")) & (F.col("_th") == F.col("of_th")))
    kept = F.substring("text", F.lit(1), F.col("n").cast("int") - need)
    key = ["_id", "_th", "next_id", "next_th", "copies", "n"]
    # paragraphs that end before the edit stay as they are; the others are taken out and those of the new end put in
    same = F.regexp_extract(kept, r"^(?s:.*\n)", 0)
    texts = both.select(*key, "text", kept.alias("kept"), "head", same.alias("same")).withColumn("edited_sha256", F.sha2(F.concat("kept", "head").cast("binary"), 256))
    key.append("edited_sha256")
    rest = lambda c: F.substring(c, F.length("same") + 1, F.length(c))
    part = lambda v, text: F.struct(F.lit(v).alias("v"), text.alias("text"))
    before = F.when(F.length("same") > 0, F.substring("same", F.lit(1), F.length("same") - 1))  # its last line feed parts it from the rest
    parts = F.filter(F.array(part(0, before), part(1, rest("text")), part(2, F.concat(rest("kept"), F.col("head")))), lambda t: t["text"].isNotNull())
    made = vectors(texts.select(*key, F.explode(parts).alias("t")).select(*key, "t.v", "t.text"), [*key, "v"])
    of = lambda v: F.max(F.when(F.col("v") == v, F.col("vector")))
    path = fresh_path(spark, "fingerprints")
    sums = made.groupBy(*key).agg(of(0).alias("same"), of(1).alias("old"), of(2).alias("new"))
    whole = F.when(F.col("same").isNull(), F.col("old")).otherwise(inserted(F.col("same"), F.col("old")))
    sums = sums.select(*key, whole.alias("own"), "old", "new")
    sums = sums.select(*key, "own", inserted(deleted(F.col("own"), F.col("old")), F.col("new")).alias("changed"))
    sums.write.option("compression", "zstd").parquet(path)
    pairs = spark.read.parquet(path)
    after = pairs.select(F.col("_id").alias("next_id"), F.col("_th").alias("next_th"), F.col("own").alias("next"))
    out = pairs.join(after, ["next_id", "next_th"])
    out = out.select(
        F.nullif("_id", F.lit(NULL_ID)).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    )
    return out.drop("_copy")
