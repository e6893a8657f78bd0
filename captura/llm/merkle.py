"""Merkle fixity audit of record archives with DataFrame functions.

Records of an archive lie at ascending offsets. Their hashes are the leaves of a tree whose inner nodes each hash
``FANOUT`` children in order, so a node stands for a range of offsets. Two replicas agree where
roots agree; elsewhere the audit descends only into children of nodes that differ.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captura.llm.common import materialize

FANOUT = 16
ARCHIVE_PAGES = 512


def warc_record(url: Column, html: Column, page_id: Column) -> Column:
    """A resource record as text: header lines, empty line, payload, two line ends. Nulls are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """Hash records (``archive, record_id, data`` text) and lay them out in order of their ids.

    Returns ``archive, record_id, place, offset, n_bytes, sha256``. Hashing happens where the data is read; only
    hashes and sizes are shuffled. Repeated ids are ordered by their hashes, null ids come first.
    """
    hashed = records.select(
        "archive", "record_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2(F.col("data").cast("binary"), 256).alias("sha256")
    )
    order = Window.partitionBy("archive").orderBy("record_id", "sha256")
    before = F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return hashed.select(
        "archive", "record_id", (F.row_number().over(order) - 1).cast("long").alias("place"),
        F.coalesce(before, F.lit(0)).alias("offset"), "n_bytes", "sha256",
    )


def tree(placed: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of all archives' trees from the leaves up: ``archive, place, hash, first, last`` (offsets).

    A node hashes at most ``fanout`` children in order. Levels are added until every archive has one node.
    """
    leaf = F.sha2(F.concat_ws("|", "sha256", "n_bytes", "offset").cast("binary"), 256)
    end = (F.col("offset") + F.col("n_bytes")).alias("last")
    levels = [materialize(placed.select("archive", "place", leaf.alias("hash"), F.col("offset").alias("first"), end), "leaves")]
    while not levels[-1].filter("place > 0").isEmpty():
        children = F.array_sort(F.collect_list(F.struct("place", "hash")))
        up = levels[-1].groupBy("archive", F.floor(F.col("place") / fanout).alias("place")).agg(
            F.sha2(F.array_join(children["hash"], "").cast("binary"), 256).alias("hash"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
        levels.append(materialize(up, "nodes"))
    return levels


def audit(one: DataFrame, other: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records on which two replicas differ, found by descent from their roots.

    ``one`` and ``other`` are laid-out leaves. Returns ``archive, place, status``: ``corrupt``, ``missing`` (not in the
    second) or ``extra``. A record that shifts later offsets is found with all records that it moves. Of two
    equal replicas only the roots are compared; empty replicas have no rows.
    """
    a, b = tree(one, fanout), tree(other, fanout)
    height = max(len(a), len(b))
    for levels in (a, b):
        while len(levels) < height:
            levels.append(levels[-1])
    open_ = None
    for level in range(height - 1, -1, -1):
        sides = []
        for name, levels in (("one", a), ("other", b)):
            nodes = levels[level].select("archive", "place", F.col("hash").alias(name))
            if open_ is not None:
                # a level that stands for a lower tree's root has the same single node
                up = F.when(F.col("place") == 0, F.lit(0)).otherwise(F.floor(F.col("place") / fanout))
                nodes = nodes.withColumn("above", up.cast("long"))
                same = nodes["archive"].eqNullSafe(open_["archive"]) & (nodes["above"] == open_["place"])
                nodes = nodes.join(open_, same, "left_semi").drop("above")
            sides.append(nodes)
        left, right = sides
        right = right.select(F.col("archive").alias("r_archive"), F.col("place").alias("r_place"), "other")
        met = left.join(right, left["archive"].eqNullSafe(right["r_archive"]) & (left["place"] == right["r_place"]), "full")
        status = F.when(F.col("one").isNull(), "extra").when(F.col("other").isNull(), "missing").otherwise("corrupt")
        found = met.filter(~F.col("one").eqNullSafe(F.col("other"))).select(
            F.when(F.col("one").isNull(), F.col("r_archive")).otherwise(F.col("archive")).alias("archive"),
            F.coalesce("place", "r_place").alias("place"),
            status.alias("status"),
        )
        open_ = materialize(found, "differences")
    return open_


def page_archives(pages: DataFrame, html: Column) -> DataFrame:
    """Records of pages, ``ARCHIVE_PAGES`` consecutive ids an archive."""
    return pages.select(
        F.floor(F.coalesce(F.col("page_id"), F.lit(-1)) / ARCHIVE_PAGES).alias("archive"),
        F.col("page_id").alias("record_id"),
        warc_record(F.col("url"), html, F.col("page_id")).alias("data"),
    )


def fixity_report(pages: DataFrame) -> DataFrame:
    """Archive all pages twice, let bytes of the second replica rot, and report every record with what the audit says.

    The rot is part of the drill: of pages with id % 97 = 5 the first letter a of the second copy becomes e, of
    which the audit knows nothing. Returns ``page_id, archive, first_byte, n_bytes, record_sha256, status`` (``ok`` where
    the audit found no difference).
    """
    rotten = F.when(F.col("page_id") % 97 == 5, F.regexp_replace("html", "^([^a]*)a", "$1e")).otherwise(F.col("html"))
    one = materialize(leaves(page_archives(pages, F.col("html"))), "replica")
    other = leaves(page_archives(pages, rotten))
    found = audit(one, other).select(F.col("archive").alias("f_archive"), F.col("place").alias("f_place"), "status")
    same = (one["archive"] == found["f_archive"]) & (one["place"] == found["f_place"])
    return one.join(found, same, "left").select(
        F.col("record_id").alias("page_id"), "archive", F.col("offset").alias("first_byte"), "n_bytes",
        F.col("sha256").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status"),
    )


ORACLE = r"""
WITH r AS (SELECT page_id, CAST(floor(coalesce(page_id, -1) / 512) AS BIGINT) AS archive,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS data,
    CASE WHEN page_id % 97 = 5 AND contains(html, 'a') THEN 'corrupt' ELSE 'ok' END AS status FROM pages),
h AS (SELECT page_id, archive, CAST(strlen(data) AS BIGINT) AS n_bytes, sha256(data) AS record_sha256, status FROM r)
SELECT page_id, archive, CAST(coalesce(sum(n_bytes) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, record_sha256
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_byte, n_bytes, record_sha256, status FROM h
"""
