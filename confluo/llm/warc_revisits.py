"""Resolution of not-modified revisit records: an as-of join to the latest earlier full response of the same URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, write

RECORD = "record_id long, warc_type string, target_uri string, captured long, status int, headers map<string,string>, payload string"
# Header fields that a not-modified answer may replace in the stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name no resource.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, www., port 80 or 443, fragment and final slash; host in lower case; query
    parameters sorted, those for tracking left out. Null for null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.sort_array(pairs), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the greatest value stays. Null values
    and null headers are none."""
    named = F.filter(F.map_entries(headers), lambda e: e["value"].isNotNull())
    pairs = F.sort_array(F.transform(named, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    last = lambda n: F.element_at(F.filter(pairs, lambda e: e["key"] == n), -1)["value"]
    return F.coalesce(F.map_from_arrays(names, F.transform(names, last)), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def _tag(headers: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(headers["etag"]), "^W/", "")


def resolve_revisits(records: DataFrame, bucket: int = 3_600) -> DataFrame:
    """Every revisit record with the response it stands for: record_id, url, captured, outcome, base_id, headers, payload.

    records has the columns of RECORD; captured counts seconds. A full response is of type response, with status 200
    and a payload. A revisit of type revisit is resolved by the latest full response of its canonical URL captured
    strictly before it (of equal times the greatest record_id). outcome is resolved; no_earlier_response; or
    validator_mismatch, if the entity tags (compared weakly) differ or, where one is missing, the Last-Modified values
    differ, or no validator stands on both sides. A resolved revisit has the base's headers with the permitted ones
    replaced by its own, and the base's payload; others have their own headers and no payload.

    Nulls: a record without URL, time or id takes no part as a base; such a revisit finds no earlier response. Null
    headers are none. Repeated revisits are each resolved, repeated responses count once. Other columns are ignored; an
    empty table gives an empty result. Payloads of any length are moved whole.

    A URL's records are parted by time buckets (an hour), and the latest response of the buckets before is carried in: a URL
    that holds a third of all records is many groups, as far as its captures spread over time; those of one bucket are one
    group, of times and ids only. Revisits without a URL are answered without a group. Payloads travel once, to the revisits
    that need them.
    """
    old = Scratch(records.sparkSession)
    slim = records.select(
        "record_id",
        (F.col("warc_type") == "revisit").alias("asks"),
        canonical_url(F.col("target_uri")).alias("url"),
        F.col("captured").cast("long").alias("captured"),
        F.floor(F.col("captured") / bucket).alias("bucket"),
        _lower_names(F.col("headers")).alias("headers"),
        F.when(
            (F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("payload").isNotNull() & F.col("record_id").isNotNull() & F.col("captured").isNotNull(),
            F.struct(F.col("captured").cast("long").alias("at"), F.col("record_id").cast("long").alias("id")),
        ).alias("base"),
    )
    slim = old.write(slim.where(F.col("asks") | F.col("base").isNotNull()), "warc-slim")
    keyed = slim().select("record_id", "asks", "url", "captured", "bucket", F.when(F.col("asks"), F.col("headers")).alias("own"), "base")
    inside = Window.partitionBy("url", "bucket").orderBy("captured").rangeBetween(Window.unboundedPreceding, -1)
    here = keyed.where("url is not null").withColumn("here", F.max("base").over(inside)).where("asks").drop("asks", "base")
    lost = keyed.where("url is null and asks").select("record_id", "url", "captured", "own", F.lit(None).cast("long").alias("base_id"))
    latest = slim().where("base is not null and url is not null").groupBy(F.col("url").alias("u"), F.col("bucket").alias("b"))
    latest = old.write(latest.agg(F.max("base").alias("last")), "warc-latest")
    # A row for each bucket with a response or a revisit: what was latest before it.
    asked = slim().where("asks and url is not null").select(F.col("url").alias("u"), F.col("bucket").alias("b")).distinct()
    spots = latest().unionByName(asked.withColumn("last", F.lit(None).cast("struct<at: bigint, id: bigint>")))
    before = Window.partitionBy("u").orderBy("b").rangeBetween(Window.unboundedPreceding, -1)
    spots = spots.groupBy("u", "b").agg(F.max("last").alias("last")).withColumn("carried", F.max("last").over(before))
    carried = old.write(spots.where("carried is not null").select("u", "b", "carried"), "warc-carried")
    found = here.join(carried(), (F.col("url") == F.col("u")) & (F.col("bucket") == F.col("b")), "left")
    found = found.select("record_id", "url", "captured", "own", F.coalesce("here", "carried")["id"].alias("base_id")).unionByName(lost)
    found = write(found, "warc-found")

    wanted = found().select(F.col("base_id").alias("id")).distinct()
    bases = slim().where("base is not null").select(F.col("record_id").alias("id"), F.col("headers").alias("theirs")).dropDuplicates(["id"])
    bodies = records.where(F.col("warc_type") == "response").select(F.col("record_id").alias("id"), "payload").where("payload is not null").join(wanted, "id", "left_semi").dropDuplicates(["id"])
    bases = write(bases.join(bodies, "id"), "warc-bases")
    old.clear()
    r = found().join(bases(), F.col("base_id") == F.col("id"), "left")
    tags = _tag(F.col("own")), _tag(F.col("theirs"))
    dates = F.trim(F.col("own")["last-modified"]), F.trim(F.col("theirs")["last-modified"])
    same = F.coalesce(tags[0] == tags[1], dates[0] == dates[1], F.lit(False))
    outcome = F.when(F.col("base_id").isNull(), "no_earlier_response").when(same, "resolved").otherwise("validator_mismatch")
    fresh = F.map_filter("own", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("theirs", lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    r = r.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return r.select("record_id", "url", "captured", "outcome", "base_id", F.when(good, merged).otherwise(F.col("own")).alias("headers"), F.when(good, F.col("payload")).alias("payload"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records made from a table of pages: for each page a full response and a later or earlier revisit, by
    another spelling of its URL; some revisits have a stale tag, some no tag, and some come before their response."""
    p, url = F.col("page_id"), F.col("url")
    tag, date = F.md5("html"), F.concat(F.lit("day "), F.floor(p / 100).cast("string"))
    response = pages.select(
        (2 * p).alias("record_id"),
        F.lit("response").alias("warc_type"),
        url.alias("target_uri"),
        (60 * p).alias("captured"),
        F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        F.col("html").alias("payload"),
    )
    stale = F.when(p % 5 == 0, F.lit("stale")).when(p % 4 != 0, F.concat(F.lit("W/"), tag))
    revisit = pages.select(
        (2 * p + 1).alias("record_id"),
        F.lit("revisit").alias("warc_type"),
        F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("#again")).alias("target_uri"),
        (60 * p + 3600 * (p % 7 - 1)).alias("captured"),
        F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), stale, F.lit("last-modified"), date, F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-type"), F.lit("none")).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    r = resolve_revisits(captures_of_pages(read(spark, sf_dir, "pages")))
    header = lambda name: F.col("headers")[name]
    return r.select(
        "record_id", "url", "captured", "outcome", "base_id",
        header("etag").alias("etag"), header("cache-control").alias("cache_control"), header("content-type").alias("content_type"),
        F.md5("payload").alias("payload_md5"), F.length("payload").cast("long").alias("payload_chars"),
    )


SQL = r"""
WITH canon AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)'))), '&') AS query FROM canon
), named AS (
  SELECT page_id, html, md5(html) AS tag, 'day ' || CAST(page_id // 100 AS VARCHAR) AS day,
    host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url FROM parts
), asked AS (
  SELECT 2 * page_id + 1 AS record_id, url, 60 * page_id + 3600 * (page_id % 7 - 1) AS captured, day,
    CASE WHEN page_id % 5 = 0 THEN 'stale' WHEN page_id % 4 <> 0 THEN 'W/' || tag END AS etag FROM named
), found AS (
  SELECT a.*, b.page_id AS base, b.tag AS base_tag, b.day AS base_day, b.html,
    row_number() OVER (PARTITION BY a.record_id ORDER BY b.page_id DESC NULLS LAST) AS place
  FROM asked a LEFT JOIN named b ON a.url = b.url AND 60 * b.page_id < a.captured AND b.html IS NOT NULL
), judged AS (
  SELECT *, CASE WHEN base IS NULL THEN 'no_earlier_response'
    WHEN coalesce(regexp_replace(etag, '^W/', '') = base_tag, day = base_day, FALSE) THEN 'resolved'
    ELSE 'validator_mismatch' END AS outcome FROM found WHERE place = 1
)
SELECT record_id, url, captured, outcome, 2 * base AS base_id,
  CASE WHEN outcome = 'resolved' THEN coalesce(etag, base_tag) ELSE etag END AS etag,
  'max-age=600' AS cache_control, CASE WHEN outcome = 'resolved' THEN 'text/html' ELSE 'none' END AS content_type,
  CASE WHEN outcome = 'resolved' THEN base_tag END AS payload_md5, CASE WHEN outcome = 'resolved' THEN length(html) END AS payload_chars
FROM judged
"""
