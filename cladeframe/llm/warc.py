"""Resolution of not-modified WARC revisits.

A revisit record (304) has no body: it stands for the latest earlier full response of the same canonical URL. The
as-of join runs over (canonical URL, time bucket): a window inside each bucket, and for what came before it the
bucket's carried-in response, from a window over one row per bucket. A URL with a third of all records is thus dealt
to as many tasks as there are buckets. The validators of both records are compared, and the stored headers are
updated with those of the revisit that a not-modified answer may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

# Headers that a not-modified answer never changes (hop-by-hop ones and those that describe the body).
KEPT_HEADERS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
# Query parameters that do not change what is served.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
BUCKET_ROWS = 20_000


def canonical_url(url: str) -> Column:
    """Canonical form of a URL column: no scheme, www or m label, default port, fragment, tracking parameter or
    trailing slash; lower-case host; parameters in order. Null if the text has no scheme and host."""
    u = F.col(url)
    host = F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^(www[0-9]*|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    args = F.array_sort(F.filter(F.split(query, "&"), lambda a: (a != "") & ~a.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(args, "&"))).otherwise("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame, bucket_rows: int = BUCKET_ROWS, kept: list[str] | None = None) -> DataFrame:
    """One row per revisit: record_id, canonical, ts, status, basis, original_id, original_ts, headers.

    records: record_id long, url string, ts long, is_full boolean, headers map<string, string> (lower-case names);
    other columns are ignored. status is `resolved`, `validator_mismatch` or `no_original`; basis names the validator
    that decided (`etag`, `last_modified`, or `none` where the two share no kind of validator). Strong and weak tags
    are compared by their opaque part. headers: those of the original, updated with the permitted ones of the
    revisit; null unless resolved. Of responses with one URL and time the largest record_id counts; a response at the
    revisit's own time is not earlier. A null or unusable URL, or a null time, gives `no_original`; null headers are
    no headers. Repeated records are kept. An empty table gives an empty result.
    """
    kept = KEPT_HEADERS if kept is None else kept
    r = records.select("record_id", canonical_url("url").alias("canonical"), F.col("ts").cast("long").alias("ts"), F.coalesce("is_full", F.lit(False)).alias("is_full"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    span = r.agg(F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    n = max(1, -(-span["n"] // bucket_rows))
    width = max(1, -(-((span["high"] or 0) - (span["low"] or 0) + 1) // n))
    r = r.withColumn("bucket", F.floor((F.col("ts") - F.lit(span["low"] or 0)) / F.lit(width)).cast("long"))
    usable = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    live = r.where(usable)
    own = F.struct(F.col("record_id").alias("id"), F.col("ts").alias("at"), "headers")
    when = F.struct("ts", "record_id")
    newest = lambda: F.max_by(F.when(F.col("is_full"), own), F.when(F.col("is_full"), when))
    inside = Window.partitionBy("canonical", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    met = live.withColumn("inside", newest().over(inside)).where(~F.col("is_full"))
    per_bucket = live.groupBy("canonical", "bucket").agg(newest().alias("latest"))
    before = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select("canonical", "bucket", F.last("latest", ignorenulls=True).over(before).alias("carried"))
    found = met.join(carried, ["canonical", "bucket"]).withColumn("o", F.coalesce("inside", "carried"))
    lost = r.where(~usable & ~F.col("is_full")).withColumn("o", F.lit(None).cast(found.schema["o"].dataType))
    both = found.select("record_id", "canonical", "ts", "headers", "o").unionByName(lost.select("record_id", "canonical", "ts", "headers", "o"))
    tag, old_tag = F.col("headers")["etag"], F.col("o.headers")["etag"]
    date, old_date = F.col("headers")["last-modified"], F.col("o.headers")["last-modified"]
    by_tag, by_date = tag.isNotNull() & old_tag.isNotNull(), date.isNotNull() & old_date.isNotNull()
    basis = F.when(F.col("o").isNull(), None).when(by_tag, "etag").when(by_date, "last_modified").otherwise("none")
    fits = F.when(by_tag, _weak(tag) == _weak(old_tag)).when(by_date, date == old_date).otherwise(True)
    status = F.when(F.col("o").isNull(), "no_original").when(fits, "resolved").otherwise("validator_mismatch")
    updates = F.map_filter("headers", lambda k, v: ~k.isin(kept))
    merged = F.map_concat(F.map_filter("o.headers", lambda k, v: ~F.map_contains_key(updates, k)), updates)
    both = both.withColumn("status", status)
    return both.select("record_id", "canonical", "ts", "status", basis.alias("basis"), F.col("o.id").alias("original_id"), F.col("o.at").alias("original_ts"), F.when(F.col("status") == "resolved", merged).alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """WARC records of a table of pages (page_id, url, html): a full response and a later revisit of every page.

    The response is captured at 10 * page_id, the revisit at a later time that the URL's MD5 gives. Two thirds of the
    revisits carry an entity tag (half of them weak), the others a date only or nothing; all are of the page's own
    body, so that a revisit that another version of the URL preceded does not validate.
    """
    pick = F.conv(F.substring(F.md5(F.col("url")), 1, 4), 16, 10).cast("long")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    ts = F.col("page_id").cast("long") * 10
    pairs = lambda **kv: F.map_filter(F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in kv]), F.array(*kv.values())), lambda k, v: v.isNotNull())
    full = pairs(date=ts.cast("string"), etag=tag, last_modified=day, content_type=F.lit("text/html"), content_length=F.length("html").cast("string"))
    later = ts + 1 + pick
    again = pairs(
        date=later.cast("string"), etag=F.when(pick % 3 == 0, tag).when(pick % 3 == 1, F.concat(F.lit("W/"), tag)), last_modified=F.when(pick % 2 == 0, day),
        cache_control=F.concat(F.lit("max-age="), (pick % 1000).cast("string")), content_length=F.lit("0"), connection=F.lit("close"),
    )
    one = F.struct((F.col("page_id") * 2).alias("record_id"), ts.alias("ts"), F.lit(True).alias("is_full"), full.alias("headers"))
    two = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), later.alias("ts"), F.lit(False).alias("is_full"), again.alias("headers"))
    return pages.select("url", F.explode(F.array(one, two)).alias("x")).select("url", "x.*")


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(page_records(table(spark, sf_dir, "pages")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return found.select(F.floor(F.col("record_id") / 2).cast("long").alias("page_id"), "record_id", "canonical", "ts", "status", "basis", "original_id", "original_ts", text.alias("headers"))


OP1_SQL = r"""
WITH base AS (
  SELECT page_id, url, page_id * 10 AS t, ('0x' || substr(md5(url), 1, 4))::BIGINT AS pick,
         '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || page_id AS d, length(html) AS n,
         regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^(www[0-9]*|m)\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
                   lambda a: a <> '' AND NOT regexp_matches(a, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS args
  FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canonical FROM base),
full_ AS (SELECT canonical, t AS at, arg_max(page_id, page_id) AS pid FROM c WHERE canonical IS NOT NULL GROUP BY canonical, t),
orig AS (SELECT f.canonical, f.at, c.page_id, c.tag, c.d, c.n FROM full_ f JOIN c ON c.page_id = f.pid),
rev AS (SELECT page_id, canonical, t + 1 + pick AS ts, pick, tag AS own_tag, d AS own_d,
               CASE WHEN pick % 3 < 2 THEN tag END AS tag, CASE WHEN pick % 3 = 1 THEN 'W/' ELSE '' END AS weak,
               CASE WHEN pick % 2 = 0 THEN d END AS d FROM c),
m AS (SELECT r.*, o.page_id AS opid, o.at AS oat, o.tag AS otag, o.d AS od, o.n AS n
      FROM rev r ASOF LEFT JOIN orig o ON r.canonical = o.canonical AND r.ts > o.at),
s AS (SELECT *, CASE WHEN opid IS NULL THEN NULL WHEN tag IS NOT NULL THEN 'etag' WHEN d IS NOT NULL THEN 'last_modified' ELSE 'none' END AS basis,
             CASE WHEN opid IS NULL THEN 'no_original' WHEN tag IS NOT NULL THEN CASE WHEN tag = otag THEN 'resolved' ELSE 'validator_mismatch' END
                  WHEN d IS NOT NULL THEN CASE WHEN d = od THEN 'resolved' ELSE 'validator_mismatch' END ELSE 'resolved' END AS status FROM m)
SELECT page_id, page_id * 2 + 1 AS record_id, canonical, ts, status, basis, opid * 2 AS original_id, oat AS original_ts,
       CASE WHEN status = 'resolved' THEN 'cache-control: max-age=' || (pick % 1000) || CASE WHEN n IS NOT NULL THEN '; content-length: ' || n ELSE '' END
            || '; content-type: text/html; date: ' || ts || '; etag: ' || coalesce(weak || tag, otag) || '; last-modified: ' || coalesce(d, od) END AS headers
FROM s
"""
