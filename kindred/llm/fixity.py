"""Fixity audit of archive replicas by hash trees.

Records of a replica are hashed; the records that begin in one range of offsets of an archive are
hashed together in offset order, then ranges of ranges up to the archive, and archives up to the
root. Two replicas are compared at their roots, and only below nodes that differ, down to the records.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import materialize

RANGE_BYTES = 1 << 16  # bytes of an archive in which the records of one range begin
BITS = 4  # of 16 nodes below a node
ARCHIVE = 1024  # ids in an archive file
NULL_IDS = 1 << 50  # where records without id are put, spread by their hash
SPLIT = 3  # leading digits of the digest by which the records of one id are added up


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a response record; nulls are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame) -> DataFrame:
    """One row per different record: archive, offset and length there, digest, copies, id, slot.

    Records of an archive are laid out by id, then digest; equal records (repeated rows) lie side by
    side and are one row with ``copies``. Null ids are put in archives of their own by digest. Bytes
    are added up by id and leading digits of the digest first, so an id with a third of all rows is
    no window by itself.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.sha2(record, 256).alias("sha256"),
        F.octet_length(record).cast("long").alias("length"),
    )
    spread = F.lit(NULL_IDS) + F.pmod(F.xxhash64("sha256"), F.lit(ARCHIVE * ARCHIVE))
    equal = materialize(
        rows.groupBy("page_id", "sha256", "length")
        .agg(F.count("*").alias("copies"))
        .withColumn("slot", F.coalesce("page_id", spread))
        .withColumn("_digits", F.substring("sha256", 1, SPLIT)),
        "fixity-layout",
    )
    size = F.col("length") * F.col("copies")
    parts = equal.groupBy("slot", "_digits").agg(F.sum(size).alias("_size"))
    slots = parts.groupBy("slot").agg(F.sum("_size").alias("_size"))
    archive = F.floor(F.col("slot") / ARCHIVE)
    slots = slots.select("slot", _before(F.col("_size"), [archive], ["slot"]).alias("_slot_start"))
    parts = parts.select(
        "slot", "_digits", _before(F.col("_size"), ["slot"], ["_digits"]).alias("_part_start")
    )
    starts = parts.join(slots, "slot").select(
        "slot", "_digits", (F.col("_slot_start") + F.col("_part_start")).alias("_start")
    )
    within = _before(size, ["slot", "_digits"], ["sha256"])
    return equal.join(starts, ["slot", "_digits"]).select(
        archive.cast("long").alias("archive"),
        (F.col("_start") + within).alias("offset"),
        "length",
        "sha256",
        "copies",
        "page_id",
        "slot",
    )


def _before(size: Column, group: list, order: list) -> Column:
    """Sum of ``size`` over the rows before."""
    rows = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(rows), F.lit(0)).cast("long")


SIDES = ("a", "b")


def _hashed(groups: list[Column], rows: DataFrame, order: list[str], texts: dict[str, Column]) -> DataFrame:
    """For each group and side the hash of the side's texts in order, null where it has none."""

    def of(side: str) -> Column:
        said = F.when(texts[side].isNotNull(), F.struct(*order, texts[side].alias("_said")))
        listed = F.array_sort(F.collect_list(said))
        whole = F.array_join(F.transform(listed, lambda r: r["_said"]), ",")
        return F.when(F.size(listed) > 0, F.sha2(whole, 256)).alias(side)

    return rows.groupBy(*groups).agg(*[of(side) for side in SIDES])


def _range() -> Column:
    return F.expr(f"offset div {RANGE_BYTES}")


def _ranges(records: DataFrame) -> DataFrame:
    """``archive, node, a, b``: hashes of the records that begin in each range of offsets.

    A record has bytes of its own, so a range holds a bounded number of them, whatever their ids.
    """
    own = F.concat_ws(":", "offset", "length", "copies", "sha256")
    return _hashed(
        [F.col("archive"), _range().alias("node")],
        records,
        ["offset", "length", "copies", "sha256"],
        {side: F.when(F.col("side") == side, own) for side in SIDES},
    )


def _parent(archives: bool) -> list[Column]:
    """Archive and node one level up: ranges of one archive, then, above these, whole archives."""
    if archives:
        return [F.shiftright("archive", BITS).alias("archive"), F.col("node")]
    return [F.col("archive"), F.shiftright("node", BITS).alias("node")]


def tree(records: DataFrame) -> list[tuple[DataFrame, bool | None]]:
    """The levels of both replicas' trees, ranges first, the root last (empty without records).

    Each comes with the kind of its parents (see :func:`_parent`), the root with None.
    """
    level = materialize(_ranges(records), "fixity-ranges")
    least, low, high = level.agg(F.max("node"), F.min("archive"), F.max("archive")).first()
    levels: list[tuple[DataFrame, bool | None]] = []
    while low is not None and (least or low != high and (low, high) != (-1, 0)):
        archives = not least
        pairs = {
            side: F.when(F.col(side).isNotNull(), F.concat_ws(":", "archive", "node", side)) for side in SIDES
        }
        levels.append((level, archives))
        above = _hashed(_parent(archives), level, ["archive", "node"], pairs)
        level = materialize(above, f"fixity-level-{len(levels)}")
        if archives:
            low, high = low >> BITS, high >> BITS
        else:
            least >>= BITS
    return [*levels, (level, None)]


FOUND = ["archive", "page_id", "side", "status", "offset", "length", "sha256", "copies", "shift", "records"]


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Where two manifests differ: ``archive, page_id, side, status, offset, length, sha256, copies,
    shift, records``.

    Side ``a`` rows are the primary's records that the replica lacks, side ``b`` rows the replica's
    that the primary lacks; the status is ``corrupt`` where both sides have such records for one id,
    else ``missing`` or ``extra``. Records that are whole but begin elsewhere, as all behind a lost
    one do, are not damaged: those of an archive that moved by the same ``shift`` bytes into the same
    archive are one row of status ``moved``, at the side ``a`` archive, with the number of
    ``records``, their least id and offset, and their length and copies together. Equal replicas,
    empty ones too, give no rows. A manifest may come from another layout than :func:`manifest`'s:
    ``archive, offset, length, sha256, copies, page_id, slot``, a record once in each, ``slot`` being
    the id or a stand-in for a null one.
    """
    columns = ["archive", "offset", "length", "sha256", "copies", "page_id", "slot"]
    both = primary.select(*columns, F.lit("a").alias("side")).unionByName(
        replica.select(*columns, F.lit("b").alias("side"))
    )
    records = materialize(both, "fixity-records")
    levels = tree(records)
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    odd = levels[-1][0].filter(differs).select("archive", "node")
    for level, archives in reversed(levels[:-1]):  # only children of nodes that differ are looked at
        up = level.withColumns(dict(zip(["_archive", "_node"], _parent(archives), strict=True)))
        above = odd.select(F.col("archive").alias("_archive"), F.col("node").alias("_node"))
        odd = up.join(above, ["_archive", "_node"], "left_semi").filter(differs).select("archive", "node")
    near = records.withColumn("node", _range()).join(odd, ["archive", "node"], "left_semi")

    def of(side: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    places = [of(side, name).alias(f"{name}_{side}") for side in SIDES for name in ("archive", "offset")]
    seen = near.groupBy("slot", "page_id", "sha256", "length", "copies").agg(*places)
    stays = (F.col("archive_a") == F.col("archive_b")) & (F.col("offset_a") == F.col("offset_b"))
    seen = materialize(seen.filter(~F.coalesce(stays, F.lit(False))), "fixity-found")
    here, there = F.col("offset_a").isNotNull(), F.col("offset_b").isNotNull()
    alone = seen.filter(~(here & there)).withColumn("side", F.when(here, "a").otherwise("b"))
    slots = alone.groupBy("slot").agg((F.min("side") != F.max("side")).alias("_both"))
    status = F.when(F.col("_both"), "corrupt").when(here, "missing").otherwise("extra")
    nothing = F.lit(None)
    damaged = alone.join(slots, "slot").select(
        F.coalesce("archive_a", "archive_b").alias("archive"),
        "page_id",
        "side",
        status.alias("status"),
        F.coalesce("offset_a", "offset_b").alias("offset"),
        "length",
        "sha256",
        "copies",
        nothing.cast("long").alias("shift"),
        F.lit(1).cast("long").alias("records"),
    )
    shift = F.col("offset_b") - F.col("offset_a")
    moved = (
        seen.filter(here & there)
        .groupBy(F.col("archive_a").alias("archive"), "archive_b", shift.alias("shift"))
        .agg(
            F.min("page_id").alias("page_id"),
            F.min("offset_a").alias("offset"),
            F.sum(F.col("length") * F.col("copies")).alias("length"),
            F.sum("copies").alias("copies"),
            F.count("*").alias("records"),
        )
        .withColumns(
            {"side": F.lit("a"), "status": F.lit("moved"), "sha256": nothing.cast("string")}
        )
    )
    return damaged.select(*FOUND).unionByName(moved.select(*FOUND))
