"""Not-modified revisits of a WARC crawl: each is resolved to the latest earlier full response of its canonical URL.

An as-of join by canonical URL finds that response. The revisit must agree with it in its validator (ETag, compared
weakly, or else Last-Modified); the headers it may update (RFC 9111, 3.2) then replace the stored ones.

The as-of join range-partitions light rows by (url, time, id), so a URL with a third of all rows spreads over many
partitions. A window carries the last full response within a partition; the last one of each URL and partition is then
carried over the URL's later partitions. Bodies never move: rows carry their digest and length, and ``with_bodies``
fetches the body once by record id.

Defined cases: records without a URL share the empty one; a null time is earliest; of records with equal time the one
with the larger id is later; a full response resolves to itself. Status of a record: full, resolved, mismatch (the
latest earlier response has other validators), unvalidated (the revisit has none), orphan (no earlier response). Equal
records get equal results; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import written

#: Headers that a not-modified response must not change: those of the message body and of the connection. Fixed values.
FORBIDDEN = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
#: Query parameters that don't choose the content. Fixed values.
TRACKING = ("fbclid", "gclid", "phpsessid", "ref", "sessionid", "sid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FACTS = "struct<id:bigint,etag:string,modified:string,headers:map<string,string>,sha:string,len:bigint>"


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a final slash, sorted query without tracking parameters."""
    url = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", "")
    rest = F.regexp_replace(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_extract(rest, r"^[^/?]*", 0), _UPPER, _LOWER)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\d*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1), "&")
    wanted = F.array_sort(F.filter(query, lambda q: (q != "") & ~F.translate(F.split_part(q, F.lit("="), F.lit(1)), _UPPER, _LOWER).isin(*TRACKING)))
    tail = F.array_join(wanted, "&")
    return F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers, replaced and extended by those of ``update`` that a not-modified response may carry."""
    permitted = F.map_filter(update, lambda k, v: ~k.isin(*FORBIDDEN))
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k))
    return F.map_concat(kept, permitted)


def header_lines(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def resolve(records: DataFrame) -> DataFrame:
    """Resolve ``records`` (record_id, url, time, full, headers, body_sha256, body_length); header names in lower case.

    Returns record_id, url_key, time, status, refers_to, headers, body_sha256, body_length: for full and resolved
    records what the reader gets, for the others null.
    """
    spark = records.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.create_map().cast("map<string,string>")
    light = records.select(
        F.col("record_id").cast("long").alias("id"), canonical(F.col("url")).alias("url"), F.col("time").cast("long").alias("time"),
        F.coalesce("full", F.lit(False)).alias("full"), F.coalesce("headers", none).alias("headers"), "body_sha256", F.col("body_length").cast("long").alias("body_length"))
    light = light.withColumns({"etag": F.col("headers")["etag"], "modified": F.col("headers")["last-modified"]})
    spread = written(light.repartitionByRange(n, "url", "time", "id").withColumn("part", F.spark_partition_id()), "captures")
    facts = F.when(F.col("full"), F.struct("id", "etag", "modified", "headers", F.col("body_sha256").alias("sha"), F.col("body_length").alias("len")).cast(_FACTS))
    before = Window.partitionBy("url", "part").orderBy("time", "id").rowsBetween(Window.unboundedPreceding, -1)
    within = spread.withColumn("prior", F.last(facts, ignorenulls=True).over(before))
    # of each url in each partition the last full response, and of those the last before a partition
    order = F.struct(F.col("time").isNotNull(), "time", "id")
    lasts = spread.groupBy("url", "part").agg(F.max_by(facts, F.when(F.col("full"), order)).alias("last"))
    earlier = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).where("carried is not null")
    joined = within.join(carried.select("url", "part", "carried"), ["url", "part"], "left")
    base = joined.withColumn("base", F.coalesce("prior", "carried"))
    status = (F.when(F.col("full"), "full").when(F.col("base").isNull(), "orphan")
              .when(F.col("etag").isNotNull(), F.when(_weak(F.col("etag")) == _weak(F.col("base.etag")), "resolved").otherwise("mismatch"))
              .when(F.col("modified").isNotNull(), F.when(F.col("modified") == F.col("base.modified"), "resolved").otherwise("mismatch"))
              .otherwise("unvalidated"))
    judged = base.withColumn("status", status)

    def shown(own: Column, stored: Column) -> Column:
        return F.when(F.col("status") == "full", own).when(F.col("status") == "resolved", stored)

    return judged.select(
        F.col("id").alias("record_id"), F.col("url").alias("url_key"), "time", "status",
        shown(F.col("id"), F.col("base.id")).alias("refers_to"),
        shown(F.col("headers"), merged_headers(F.col("base.headers"), F.col("headers"))).alias("headers"),
        shown(F.col("body_sha256"), F.col("base.sha")).alias("body_sha256"),
        shown(F.col("body_length"), F.col("base.len")).alias("body_length"))


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Adds ``body`` from ``bodies`` (record_id, body) of full responses; a record without a response keeps a null body."""
    source = bodies.select(F.col("record_id").alias("_llm_record"), "body")
    return resolved.join(source, resolved["refers_to"] == source["_llm_record"], "left").drop("_llm_record")


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made of ``pages`` (page_id, url, html): each is a full response at minute page_id, revisited page_id % 3 times.

    The revisits of a page carry in turn its ETag (weak), its Last-Modified, an ETag of another version, or no
    validator, and new cache headers together with body headers that must not be merged; each eleventh page has a
    revisit before its response. Records are numbered 8 * page_id + turn. A null html is an empty body.
    """
    sha = F.sha2(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary"), 256)
    day = F.date_format(F.timestamp_seconds(F.col("page_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", sha.alias("sha"),
                     F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))).cast("long").alias("len"), day.alias("modified"))
    p = p.withColumn("etag", F.concat(F.lit('"'), F.substring("sha", 1, 16), F.lit('"')))
    turns = F.concat(F.array(F.lit(0)), F.when(F.col("page_id") % 3 == 1, F.array(F.lit(1))).when(F.col("page_id") % 3 == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>")),
                     F.when(F.col("page_id") % 11 == 0, F.array(F.lit(3))).otherwise(F.array().cast("array<int>")))
    r = p.withColumn("turn", F.explode(F.coalesce(turns, F.array(F.lit(0))))).withColumn("kind", F.pmod(F.col("page_id") + F.col("turn"), F.lit(4)))
    text = F.col("page_id").cast("string")
    full = F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.col("len").cast("string"), F.lit("content-type"), F.lit("text/html"),
                        F.lit("etag"), F.col("etag"), F.lit("last-modified"), F.col("modified"))
    new = F.create_map(F.lit("cache-control"), F.concat(F.lit("max-age="), F.coalesce(text, F.lit(""))), F.lit("content-length"), F.lit("0"), F.lit("x-turn"), F.col("turn").cast("string"))
    validator = (F.when(F.col("kind") == 0, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), F.col("etag"))))
                 .when(F.col("kind") == 1, F.create_map(F.lit("last-modified"), F.col("modified")))
                 .when(F.col("kind") == 2, F.create_map(F.lit("etag"), F.concat(F.lit('"'), text, F.lit('"'))))
                 .otherwise(F.create_map().cast("map<string,string>")))
    late = F.when(F.col("turn") == 3, -30).otherwise(F.col("turn") * (F.col("page_id") * 7 % 5000 + 1) * 60)
    return r.select((F.col("page_id") * 8 + F.col("turn")).alias("record_id"), "url", (F.col("page_id") * 60 + late).alias("time"), (F.col("turn") == 0).alias("full"),
                    F.when(F.col("turn") == 0, full).otherwise(F.map_concat(new, validator)).alias("headers"),
                    F.when(F.col("turn") == 0, F.col("sha")).alias("body_sha256"), F.when(F.col("turn") == 0, F.col("len")).alias("body_length"))


def query(spark, sf_dir):
    found = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.withColumn("headers", header_lines(F.col("headers")))


SQL = f"""
WITH u AS (SELECT page_id, html, regexp_replace(regexp_replace(coalesce(url, ''), '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
k AS (SELECT page_id, coalesce(html, '') AS html,
        regexp_replace(regexp_replace(translate(regexp_extract(rest, '^[^/?]*'), '{_UPPER}', '{_LOWER}'), '^www[0-9]*\\.', ''), ':(80|443)$', '')
        || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS stem,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&'),
          lambda q: q <> '' AND translate(split_part(q, '=', 1), '{_UPPER}', '{_LOWER}') NOT IN {TRACKING})), '&') AS tail FROM u),
p AS (SELECT page_id, stem || CASE WHEN tail <> '' THEN '?' || tail ELSE '' END AS url_key, sha256(html) AS sha, CAST(strlen(html) AS BIGINT) AS len,
        strftime(make_timestamp(page_id * 3600000000), '%Y-%m-%dT%H:%M:%SZ') AS modified FROM k),
r AS (SELECT *, '"' || substr(sha, 1, 16) || '"' AS etag, unnest([0] || CASE page_id % 3 WHEN 1 THEN [1] WHEN 2 THEN [1, 2] ELSE [] END || CASE WHEN page_id % 11 = 0 THEN [3] ELSE [] END) AS turn FROM p),
c AS (SELECT page_id * 8 + turn AS record_id, url_key, turn = 0 AS isfull, sha, len, modified, etag, turn, page_id,
        page_id * 60 + CASE turn WHEN 3 THEN -30 ELSE turn * (page_id * 7 % 5000 + 1) * 60 END AS time,
        CASE WHEN turn > 0 AND (page_id + turn) % 4 = 0 THEN 'W/' || etag WHEN turn > 0 AND (page_id + turn) % 4 = 2 THEN '"' || page_id || '"' END AS new_etag,
        CASE WHEN turn > 0 AND (page_id + turn) % 4 = 1 THEN modified END AS new_modified FROM r),
a AS (SELECT *, last_value(CASE WHEN isfull THEN {{'id': record_id, 'etag': etag, 'modified': modified, 'sha': sha, 'len': len}} END IGNORE NULLS)
        OVER (PARTITION BY url_key ORDER BY time, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM c),
s AS (SELECT *, CASE WHEN isfull THEN 'full' WHEN base IS NULL THEN 'orphan'
        WHEN new_etag IS NOT NULL THEN CASE WHEN regexp_replace(new_etag, '^W/', '') = base.etag THEN 'resolved' ELSE 'mismatch' END
        WHEN new_modified IS NOT NULL THEN CASE WHEN new_modified = base.modified THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS status FROM a)
SELECT record_id, url_key, time, status, CASE status WHEN 'full' THEN record_id WHEN 'resolved' THEN base.id END AS refers_to,
  CASE status WHEN 'full' THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || len, 'content-type: text/html', 'etag: ' || etag, 'last-modified: ' || modified)
    WHEN 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=' || page_id, 'content-length: ' || base.len, 'content-type: text/html',
      'etag: ' || coalesce(new_etag, base.etag), 'last-modified: ' || coalesce(new_modified, base.modified), 'x-turn: ' || turn) END AS headers,
  CASE status WHEN 'full' THEN sha WHEN 'resolved' THEN base.sha END AS body_sha256,
  CASE status WHEN 'full' THEN len WHEN 'resolved' THEN base.len END AS body_length
FROM s
"""
