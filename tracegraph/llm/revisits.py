"""WARC revisit resolution: which full response a not-modified capture stands for.

An as-of join by canonical URL: a revisit takes the latest full response captured before it (by time, then
record id). Validators are checked (entity tags by weak comparison, else modification dates) and the
headers that a 304 may update are merged into the stored ones.

Time is cut at a fixed number of quantiles. The last response of each (URL, slice) is found by a hash
aggregate; a window over a URL's slices (SLICES at most) carries it on; a window within (URL, slice) does the
rest. So a URL that holds a third of all captures is spread over all slices. Built-in functions only.

Defined results: a null or empty URL resolves to nothing (`no_response`); a null time comes first; a null
record id comes before others of its time; repeated rows give repeated results; columns not named here are
dropped from the result and never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

SLICES = 256
#: Query parameters that do not name a resource.
TRACKING = "utm_[a-z]*|gclid|fbclid|ref|sessionid|phpsessid"
#: Fields that a 304 must not change in a stored response (RFC 9111, 3.2, and hop-by-hop fields).
KEPT_FIELDS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te",
    "trailer", "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """Scheme, user, `www.`, default port, fragment, tracking parameters and a last slash go; the host is in
    lower case, parameters are sorted. Null for a null or empty URL."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "^[^?]*[?](.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(x).rlike(f"^({TRACKING})(=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(F.length(url) > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored map with the fields of the update that a 304 may change."""
    allowed = F.map_filter(update, lambda k, _: ~k.isin(KEPT_FIELDS))
    old = F.map_filter(stored, lambda k, _: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False)))
    return F.when(update.isNull(), stored).when(stored.isNull(), update).otherwise(F.map_concat(old, allowed))


def resolve_revisits(captures: DataFrame, slices: int = SLICES) -> DataFrame:
    """captures: record_id, url, ts, kind (`response` or `revisit`; others are ignored), etag, last_modified,
    headers (map, names in lower case), digest. One row per revisit: record_id, canonical_url, ts, outcome
    (`resolved`, `unvalidated`: nothing to compare, `changed`: validators differ, `no_response`), refers_to,
    digest and headers of the response where resolved or unvalidated."""
    c = captures.where(F.col("kind").isin("response", "revisit")).withColumn("canonical_url", canonical_url(F.col("url")))
    (bounds,) = c.agg(F.percentile_approx("ts", [i / slices for i in range(1, slices)], 10_000)).first()
    bounds = sorted(set(bounds or []))
    cut_at = F.array(*[F.lit(x) for x in bounds]) if bounds else F.expr("cast(array() as array<bigint>)")
    c = c.withColumn("slice", F.size(F.filter(cut_at, lambda b: b <= F.col("ts"))))
    found = F.struct(F.col("record_id").alias("refers_to"), "etag", "last_modified", F.col("headers").alias("old"), "digest")
    response = F.when(F.col("kind") == "response", found)
    place = F.struct("ts", "record_id")
    key = ["canonical_url", "slice"]
    known = c.where(F.col("canonical_url").isNotNull())
    last = known.groupBy(*key).agg(F.max_by(F.when(F.col("kind") == "response", found), F.when(F.col("kind") == "response", place)).alias("last"))
    before = W.partitionBy("canonical_url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(before)).drop("last")
    within = W.partitionBy(*key).orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    seen = known.withColumn("near", F.last(response, ignorenulls=True).over(within)).where(F.col("kind") == "revisit")
    both = seen.join(carried, key, "left").withColumn("r", F.coalesce("near", "carried"))
    weak = lambda x: F.regexp_replace(x, "^W/", "")
    same = F.coalesce(weak(F.col("etag")) == weak(F.col("r.etag")), F.col("last_modified") == F.col("r.last_modified"))
    outcome = F.when(F.col("r").isNull(), "no_response").when(same, "resolved").when(same.isNull(), "unvalidated").otherwise("changed")
    out = both.withColumn("outcome", outcome)
    taken = F.col("outcome").isin("resolved", "unvalidated")
    resolved = out.select(
        "record_id", "canonical_url", "ts", "outcome", F.when(taken, F.col("r.refers_to")).alias("refers_to"),
        F.when(taken, F.col("r.digest")).alias("digest"), F.when(taken, merged_headers(F.col("r.old"), F.col("headers"))).alias("headers"),
    )
    lost = c.where((F.col("kind") == "revisit") & F.col("canonical_url").isNull())
    null = lambda c: F.lit(None).cast(resolved.schema[c].dataType).alias(c)
    return resolved.unionByName(lost.select("record_id", "canonical_url", "ts", F.lit("no_response").alias("outcome"), null("refers_to"), null("digest"), null("headers")))


def page_captures(pages: DataFrame) -> DataFrame:
    """Two captures of every page: the response, and a revisit after it; each eleventh revisit comes before
    its response, each seventh has another entity tag, each fifth none."""
    digest = F.md5(F.coalesce("html", F.lit("")))
    p = pages.select("page_id", "url", digest.alias("digest"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("length"))
    nth = lambda n: F.coalesce(F.pmod("page_id", F.lit(n)) == 0, F.lit(False))
    tag = F.concat(F.lit('"'), "digest", F.lit('"'))
    date = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    text = lambda x: F.lit(x)
    response = p.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"),
        date.alias("last_modified"), F.create_map(text("content-type"), text("text/html"), text("content-length"), F.col("length"), text("etag"), tag, text("date"), date).alias("headers"), "digest",
    )
    late = F.when(nth(11), F.col("page_id") * 10 - 5).otherwise(F.col("page_id") * 10 + 5)
    own = F.when(nth(7), F.lit('"other"')).when(nth(5), F.lit(None).cast("string")).otherwise(F.concat(F.lit("W/"), tag))
    again = F.concat(F.lit("again "), F.col("page_id").cast("string"))
    revisit = p.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", late.alias("ts"), F.lit("revisit").alias("kind"), own.alias("etag"), date.alias("last_modified"),
        F.create_map(text("content-length"), text("0"), text("cache-control"), text("max-age=60"), text("date"), again).alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return response.unionByName(revisit)


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits of all pages' captures, resolved; headers as `name: value` lines in order of name."""
    r = resolve_revisits(page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return r.withColumn("headers", lines)


OP4_SQL = r"""
with p as (select page_id, url, md5(coalesce(html, '')) digest, length(coalesce(html, '')) len,
  regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') rest from pages),
q as (select *, lower(regexp_extract(rest, '^([^/?]*)', 1)) h, regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*[?](.*)$', 1), '&'),
    lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[a-z]*|gclid|fbclid|ref|sessionid|phpsessid)(=|$)'))), '&') qs from p),
u as (select *, case when length(url) > 0 then regexp_replace(regexp_replace(regexp_replace(h, '^.*@', ''), '^www[0-9]*[.]', ''), ':(80|443)$', '')
  || path || case when qs <> '' then '?' || qs else '' end end canonical_url from q),
c as (select page_id*2 record_id, canonical_url, page_id*10 ts, 1 full_, digest, '"' || digest || '"' etag, page_id, len from u
  union all select page_id*2+1, canonical_url, case when page_id % 11 = 0 then page_id*10-5 else page_id*10+5 end, 0, null,
  case when page_id % 7 = 0 then '"other"' when page_id % 5 = 0 then null else '"' || digest || '"' end, page_id, null from u),
w as (select *, last_value(case when full_ = 1 then {'id': record_id, 'tag': etag, 'page': page_id, 'len': len, 'digest': digest} end ignore nulls)
  over (partition by canonical_url order by ts, record_id rows between unbounded preceding and 1 preceding) r from c),
o as (select *, case when canonical_url is null or r is null then 'no_response' when coalesce(etag = r.tag, page_id = r.page) then 'resolved' else 'changed' end outcome
  from w where full_ = 0)
select record_id, canonical_url, ts, outcome, case when outcome = 'resolved' then r.id end refers_to, case when outcome = 'resolved' then r.digest end digest,
  case when outcome = 'resolved' then 'cache-control: max-age=60' || chr(10) || 'content-length: ' || r.len || chr(10) || 'content-type: text/html' || chr(10)
  || 'date: again ' || page_id || chr(10) || 'etag: ' || r.tag end headers from o
"""
