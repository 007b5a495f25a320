"""Fixity audit of archive replicas with Merkle trees over offset ranges.

Every record is hashed; hashes of the records in one range of offsets make a leaf,
ordered hashes of neighbouring ranges make the node above, up to one root per archive.
Ranges are aligned to offsets, not to record numbers, so a missing record changes one
branch only. Two replicas are compared from the roots down, following only branches
whose hashes differ; records are compared inside differing leaves alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import query, saved, table

SPAN = 1 << 16
FANOUT = 16
RANGE = "range"


def digest(parts: Column) -> Column:
    """SHA-256 over an ordered list of texts."""
    return F.sha2(F.array_join(parts, ",").cast("binary"), 256)


def record_hashes(records: DataFrame, payload: str | Column = "payload") -> DataFrame:
    """(archive, offset, length, hash) of the records; one row per archive and offset.

    ``records`` has the columns archive, offset, length and the payload (text or binary).
    Records that share an offset, repeated rows too, count as one place with one hash over
    them all. A null payload differs from an empty one; rows without offset are left out;
    the null archive is an archive of its own.
    """
    body = F.col(payload) if isinstance(payload, str) else payload
    hashed = records.where(F.col("offset").isNotNull()).select(
        "archive", "offset", "length",
        F.concat_ws(":", F.coalesce(F.col("length").cast("string"), F.lit("-")),
                    F.coalesce(F.sha2(body.cast("binary"), 256), F.lit("null"))).alias("hash"))
    # Repeats are counted before they meet, so a record copied many times stays one row.
    counted = hashed.groupBy("archive", "offset", "length", "hash").agg(F.count("*").alias("n"))
    return counted.groupBy("archive", "offset").agg(
        F.sum(F.col("length") * F.col("n")).alias("length"),
        digest(F.array_sort(F.collect_list(F.concat_ws("*", "n", "hash")))).alias("hash"))


def level_up(nodes: DataFrame, position: Column) -> DataFrame:
    """Nodes of the next level: a hash over (range, hash) of the children, in order."""
    child = F.struct(F.col(RANGE).alias("at"), "hash")
    return nodes.groupBy("archive", position.alias(RANGE)).agg(digest(F.transform(
        F.array_sort(F.collect_list(child)),
        lambda c: F.concat_ws(":", c["at"], c["hash"]))).alias("hash"))


def merkle_levels(hashes: DataFrame, height: int, span: int = SPAN,
                  fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the trees from leaves (0) to roots (``height``), as written tables."""
    position = F.floor(F.col("offset") / span).cast("long")
    levels = [saved(level_up(hashes.withColumnRenamed("offset", RANGE).withColumn("offset", F.col(RANGE)),
                             position))]
    for _ in range(height):
        levels.append(saved(level_up(levels[-1], F.floor(F.col(RANGE) / fanout).cast("long"))))
    return levels


def differing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a full join by ``keys`` (null keys meet) whose hashes are not the same."""
    a, b = left.alias("a"), right.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return a.join(b, condition, "full").where(~F.col("a.hash").eqNullSafe(F.col("b.hash")))


def below(nodes: DataFrame, parents: DataFrame, position: Column) -> DataFrame:
    """Children of ``parents`` among ``nodes``."""
    up = parents.select(F.col("archive").alias("_up"), F.col(RANGE).alias("_up_range"))
    return nodes.join(up, F.col("archive").eqNullSafe(F.col("_up")) & (position == F.col("_up_range")),
                      "left_semi")


def audit(left: DataFrame, right: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """Places where two replicas differ: archive, offset, status, left_length, right_length.

    ``left`` and ``right`` come from `record_hashes`. Status is "changed", "missing" (not in
    the right replica) or "extra" (only there). Equal or empty replicas give no rows. The
    height of the trees follows the largest offset, so a node never has more than
    ``fanout`` children and a leaf covers ``span`` bytes.
    """
    left, right = saved(left), saved(right)
    largest = max((df.agg(F.max("offset")).first()[0] or 0) for df in (left, right))
    height, reach = 0, span
    while reach <= largest:
        height, reach = height + 1, reach * fanout
    trees = [merkle_levels(df, height, span, fanout) for df in (left, right)]

    def apart(a: DataFrame, b: DataFrame) -> DataFrame:
        found = differing(a, b, ("archive", RANGE))
        return found.select(
            F.when(F.col("a.hash").isNotNull(), F.col("a.archive")).otherwise(F.col("b.archive"))
            .alias("archive"), F.coalesce(f"a.{RANGE}", f"b.{RANGE}").alias(RANGE))

    branch = saved(apart(trees[0][height], trees[1][height]))
    for level in reversed(range(height)):
        up = F.floor(F.col(RANGE) / fanout).cast("long")
        branch = saved(apart(*(below(tree[level], branch, up) for tree in trees)))
    leaf = F.floor(F.col("offset") / span).cast("long")
    found = differing(below(left, branch, leaf), below(right, branch, leaf), ("archive", "offset"))
    return found.select(
        F.when(F.col("a.hash").isNotNull(), F.col("a.archive")).otherwise(F.col("b.archive")).alias("archive"),
        F.coalesce("a.offset", "b.offset").alias("offset"),
        F.when(F.col("b.hash").isNull(), "missing").when(F.col("a.hash").isNull(), "extra")
        .otherwise("changed").alias("status"),
        F.col("a.length").alias("left_length"), F.col("b.length").alias("right_length"),
    )


# Archives of the query: runs of 1,000 pages, records one after the other.
PER_ARCHIVE = 1000
FIXITY_SQL = f"""
WITH records AS (
    SELECT 'pages-' || (page_id // {PER_ARCHIVE}) AS archive, page_id, html, strlen(html) AS length,
           coalesce(sum(strlen(html) + 4) OVER (PARTITION BY page_id // {PER_ARCHIVE} ORDER BY page_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
    FROM pages
), replica AS (
    SELECT archive, "offset", length,
           CASE WHEN page_id % 211 = 7 THEN html || '!' ELSE html END AS html
    FROM records WHERE page_id % 307 <> 11
    UNION ALL
    SELECT archive, "offset" + 1, length, html FROM records WHERE page_id % 401 = 13
)
SELECT coalesce(a.archive, b.archive) AS archive, coalesce(a."offset", b."offset") AS "offset",
       CASE WHEN b.archive IS NULL THEN 'missing' WHEN a.archive IS NULL THEN 'extra'
            ELSE 'changed' END AS status,
       a.length AS left_length, b.length AS right_length
FROM records a FULL JOIN replica b ON a.archive = b.archive AND a."offset" = b."offset"
WHERE a.html IS DISTINCT FROM b.html
"""


@query("op2_fixity_audit", FIXITY_SQL)
def fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as archive records against a replica with changed, lost and added records."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    group = F.floor(F.col("page_id") / PER_ARCHIVE).cast("long")
    before = Window.partitionBy("group").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        pages.select("page_id", group.alias("group"), F.octet_length("html").cast("long").alias("length"),
                     F.sha2(F.col("html").cast("binary"), 256).alias("payload"),
                     F.sha2(F.concat("html", F.lit("!")).cast("binary"), 256).alias("altered"))
        .withColumn("offset", F.coalesce(F.sum(F.col("length") + 4).over(before), F.lit(0)).cast("long"))
        .withColumn("archive", F.concat(F.lit("pages-"), F.col("group").cast("string")))
    )
    records = saved(places)
    changed = records.where("page_id % 307 <> 11").withColumn(
        "payload", F.when(F.col("page_id") % 211 == 7, F.col("altered")).otherwise(F.col("payload")))
    added = records.where("page_id % 401 = 13").withColumn("offset", F.col("offset") + 1)
    return audit(record_hashes(records), record_hashes(changed.unionByName(added)))
