"""Dated block and allow lists, applied to captures as they stood at fetch time.

List events (an entry is added, an entry is removed) become validity intervals; a
capture meets the entries of its URL, its host and every parent domain that were
active when it was fetched. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import free_name, query, table
from corpusforge.operators.ordered import ROWS_PER_SLICE, running_totals, sliced

ENTRY = ("list", "kind", "pattern", "category")
VERDICT = ("n_active", "categories", "decided_by", "rejected")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*?)\.?(?:[:/?#]|$)"
PLACE = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^?#]*)"
ENTRIES = ["kind", "pattern", "category"]


def host_of(url: Column) -> Column:
    """The host in lower case, without a closing dot; IPv6 addresses keep their brackets."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def place_of(url: Column) -> Column:
    """The URL without scheme, query, fragment and closing slashes."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, PLACE, 1)), "/+$", "")


def validity_intervals(events: DataFrame) -> DataFrame:
    """Events (list, kind, pattern, category, action, dated) as intervals [since, until).

    ``action`` is "add" or "remove". Of several events of an entry with the same date an
    "add" wins; repeated events change nothing. Events without pattern or date are left
    out. ``until`` is null for an entry that is still listed. The window holds the
    distinct dates of one entry.
    """
    listed = (
        events.where("pattern IS NOT NULL AND dated IS NOT NULL")
        .groupBy(*ENTRY, "dated").agg(F.max(F.col("action") == "add").alias("listed"))
    )
    later = Window.partitionBy(*ENTRY).orderBy("dated")
    return (
        listed.withColumn("until", F.lead("dated").over(later)).where("listed")
        .select(*ENTRY, F.col("dated").alias("since"), "until")
    )


def url_keys(url: Column) -> Column:
    """What a URL can match: its host, each parent domain, and its place."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"),
                           F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    place = F.struct(F.lit("url").alias("kind"), place_of(url).alias("pattern"))
    return F.concat(F.array(place), domains)


def changes(intervals: DataFrame, when: str) -> DataFrame:
    """+1 where an interval begins and -1 where it ends, with the date in ``when``."""
    step = lambda date, change: F.struct(F.col(date).alias(when), F.lit(change).cast("long").alias("change"))
    return intervals.select(
        *ENTRIES, F.coalesce(F.col("list") == "allow", F.lit(False)).alias("allow"),
        F.inline(F.array(step("since", 1), step("until", -1))),
    ).where(F.col(when).isNotNull())


def judge_captures(captures: DataFrame, events: DataFrame, url: str = "url",
                   fetched: str = "fetched", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add n_active, categories, decided_by and rejected to every capture.

    Of the entries active at ``fetched`` the most specific decides: a place before a
    domain, a longer pattern before a shorter one, "allow" before any other list. A capture
    with no active entry, no URL or no date is not rejected. All rows and columns stay,
    repeated rows too; columns that already have one of the new names are replaced. Empty
    tables are allowed on either side; URLs may have any length, a text that is no URL
    matches nothing.

    The as-of join is one running sum: beginnings and ends of the intervals and the captures
    of a pattern stand in one order of dates, and what has begun and not ended before a
    capture is active. No capture meets the past of its pattern row by row, however often
    that was listed and delisted. Patterns with over ``rows_per_slice`` rows are cut into
    slices of dates, so a host with a third of the captures takes several tasks. A verdict
    depends on URL and date only, so each such pair is judged once.
    """
    captures = captures.drop(*VERDICT)
    at, when, strongest = (free_name(captures, n) for n in ("url_key", "fetched_key", "strongest"))
    seen = (
        captures.where(F.col(url).isNotNull() & F.col(fetched).isNotNull())
        .select(F.col(url).alias(at), F.col(fetched).alias(when)).distinct()
    )
    keys = seen.select(at, when, F.explode(F.array_distinct(url_keys(F.col(at)))).alias("key"))
    intervals = validity_intervals(events)
    spots = keys.select(at, when, "key.*").join(intervals.select(*ENTRIES).distinct(), ["kind", "pattern"])
    line = spots.unionByName(changes(intervals, when), allowMissingColumns=True).withColumns({
        "capture": F.col(at).isNotNull(), "change": F.coalesce("change", F.lit(0).cast("long"))})
    order = [when, "capture"]
    active = running_totals(
        sliced(line, ENTRIES, order, rows_per_slice), ENTRIES, order,
        {"n": F.col("change"), "n_allow": F.when(F.col("allow"), F.col("change")).otherwise(0)},
    ).where("capture AND n > 0")
    strength = F.struct(
        (F.col("kind") == "url").alias("place"), F.length("pattern").alias("length"),
        (F.col("n_allow") > 0).alias("allowed"), F.col("pattern").alias("pattern"))
    verdicts = active.groupBy(at, when).agg(
        F.sum("n").alias("n_active"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.max(strength).alias(strongest),
    )
    judged = captures.join(
        verdicts, (F.col(url) == F.col(at)) & (F.col(fetched) == F.col(when)), "left")
    return judged.select(
        *captures.columns,
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.coalesce("categories", F.lit("")).alias("categories"),
        F.col(f"{strongest}.pattern").alias("decided_by"),
        F.coalesce(~F.col(f"{strongest}.allowed"), F.lit(False)).alias("rejected"),
    )


def byte_of(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, 2 * at + 1, 2), 16, 10).cast("long")


def event(action: str, dated: Column) -> Column:
    return F.struct(F.lit(action).alias("action"), dated.alias("dated"))


def derived_events(pages: DataFrame) -> DataFrame:
    """List events for hosts and places of ``pages``; dates are day numbers from their MD5.

    Half of the hosts are listed, half of those are removed later and some come back;
    a sixteenth of the places are allowed from some day on.
    """
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern <> ''").distinct()
    digest = F.md5(F.col("pattern").cast("binary"))
    start = 2 * byte_of(digest, 1)
    end = start + byte_of(digest, 2) + 1
    domain = hosts.where(byte_of(digest, 0) < 128).select(
        F.lit("block").alias("list"), F.lit("domain").alias("kind"), "pattern",
        F.element_at(F.array(F.lit("spam"), F.lit("adult"), F.lit("malware")),
                     (byte_of(digest, 3) % 3 + 1).cast("int")).alias("category"),
        F.explode(F.array_compact(F.array(
            event("add", start),
            F.when(byte_of(digest, 2) < 128, event("remove", end)),
            F.when(byte_of(digest, 2) < 32, event("add", end + 60)),
        ))).alias("event"),
    ).select("list", "kind", "pattern", "category", "event.*")
    places = pages.select(place_of(F.col("url")).alias("pattern")).where("pattern <> ''").distinct()
    allowed = places.where(byte_of(digest, 0) < 16).select(
        F.lit("allow").alias("list"), F.lit("url").alias("kind"), "pattern",
        F.lit("reviewed").alias("category"), F.lit("add").alias("action"),
        (2 * byte_of(digest, 1)).alias("dated"))
    return domain.unionByName(allowed)


URL_SQL = rf"""
WITH captures AS (
    SELECT page_id, url, (page_id * 37) % 730 AS fetched,
           lower(regexp_extract(url, '{HOST}', 1)) AS host,
           regexp_replace(lower(regexp_extract(url, '{PLACE}', 1)), '/+$', '') AS place
    FROM pages
), host_bytes AS (
    SELECT host, md5(host) AS m FROM (SELECT DISTINCT host FROM captures WHERE host <> '')
), hosts AS (
    SELECT host, ('0x' || m[1:2])::INT AS b0, ('0x' || m[3:4])::INT AS b1,
           ('0x' || m[5:6])::INT AS b2, ('0x' || m[7:8])::INT AS b3 FROM host_bytes
), places AS (
    SELECT place, ('0x' || md5(place)[1:2])::INT AS b0, ('0x' || md5(place)[3:4])::INT AS b1
    FROM (SELECT DISTINCT place FROM captures WHERE place <> '')
), intervals AS (
    SELECT 'domain' AS kind, host AS pattern, (['spam', 'adult', 'malware'])[b3 % 3 + 1] AS category,
           FALSE AS allowed, 2 * b1 AS since,
           CASE WHEN b2 < 128 THEN 2 * b1 + b2 + 1 END AS until FROM hosts WHERE b0 < 128
    UNION ALL
    SELECT 'domain', host, (['spam', 'adult', 'malware'])[b3 % 3 + 1], FALSE, 2 * b1 + b2 + 61, NULL
    FROM hosts WHERE b0 < 128 AND b2 < 32
    UNION ALL
    SELECT 'url', place, 'reviewed', TRUE, 2 * b1, NULL FROM places WHERE b0 < 16
), keys AS (
    SELECT page_id, fetched, 'url' AS kind, place AS pattern FROM captures WHERE url IS NOT NULL
    UNION ALL
    SELECT page_id, fetched, 'domain',
           unnest(list_transform(range(1, len(string_split(host, '.')) + 1),
                                 lambda i: array_to_string(string_split(host, '.')[i:], '.')))
    FROM captures WHERE url IS NOT NULL
), active AS (
    SELECT page_id, category, {{'place': kind = 'url', 'length': length(pattern),
                                'allowed': allowed, 'pattern': pattern}} AS strength
    FROM keys JOIN intervals USING (kind, pattern)
    WHERE since <= fetched AND (until IS NULL OR fetched < until)
), verdicts AS (
    SELECT page_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT category)), ',') AS c,
           max(strength) AS s FROM active GROUP BY page_id
)
SELECT page_id, host, fetched, coalesce(n, 0) AS n_active, coalesce(c, '') AS categories,
       s.pattern AS decided_by, coalesce(NOT s.allowed, FALSE) AS rejected
FROM captures LEFT JOIN verdicts USING (page_id)
"""


@query("op10_url_lists", URL_SQL)
def url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.col("page_id") * 37 % 730)
    judged = judge_captures(captures, derived_events(pages))
    return judged.select("page_id", host_of(F.col("url")).alias("host"), "fetched", *VERDICT)
