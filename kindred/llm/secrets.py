"""Secret scan with multipart credential linking, in SQL functions only.

Plain patterns find secrets that show by themselves. Weaker parts of a credential, such as a random
looking string, a user name or an address, are common in harmless text; they are joined by the
intervals they cover, and one is reported only where its complements stand nearby in its scope.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.columns import fresh

# Fixed patterns of the base kinds.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run that is too short holds no longer one
HEX = r"[0-9a-f]{32,}"
# Parts that are no secrets by themselves.
RANDOM = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])"
    r"[A-Za-z0-9+/_-]{20,}={0,2}"
)
IDENTITY = (
    r"""(?i:access_key_id|key_id|client_id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?"""
    r"[A-Za-z0-9._@-]{3,}"
)
ENDPOINT = r"(?:https?|s3|ftp|sftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]{3,}"
BREAK = r"\n[\x20\t]*\n"  # scopes are parted by blank lines

BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
PARTS = {"random": RANDOM, "identity": IDENTITY, "endpoint": ENDPOINT}
KINDS = [*BASE, *PARTS, "break"]
REACH = 300  # code points between parts of one credential

SPAN = "struct<start: bigint, kind: int, end: bigint>"


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Of each match: kind, number, length of the text since the last match, own length, whether
    it counts."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counts = F.transform(whole, lambda m: F.lit(True))
    if kind == "assign":
        counts = F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.char_length(v) >= 8
        )
    gaps = F.split(text, pattern)

    def one(m: Column, i: Column) -> Column:
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("number"),
            F.char_length(F.get(gaps, i)).cast("bigint").alias("gap"),
            F.char_length(m).cast("bigint").alias("length"),
            F.get(counts, i).alias("counts"),
        )

    empty = F.array().cast(
        "array<struct<kind: int, number: int, gap: bigint, length: bigint, counts: boolean>>"
    )
    return F.when(text.rlike(pattern), F.transform(whole, one)).otherwise(empty)


def spans_of(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``key``, ``hash`` of the text and ``spans`` (start, kind, end) of every row, sorted.

    Matches are numbered and placed by running sums and joined by the intervals they cover with
    running bounds, so the work is that of sorting the matches of a text. Rows are told apart by their place in the input, which a table
    scan repeats when a task is run again.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(f"`{key}`").alias("_key"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
    )
    weak = [_found(F.col("_text"), kind, p) for kind, p in BASE.items()]
    weak.append(_found(F.col("_text"), "random", RANDOM))
    first = rows.withColumn("_first", F.concat(*weak)).withColumn(
        "_parts",
        # names, addresses and blank lines matter only where there is something to link
        F.when(
            F.size("_first") > 0,
            F.concat(
                F.col("_first"),
                _found(F.col("_text"), "identity", IDENTITY),
                _found(F.col("_text"), "endpoint", ENDPOINT),
                _found(F.col("_text"), "break", BREAK),
            ),
        ),
    )
    parts = first.select(
        "_row", "_key", F.xxhash64("_text").alias("_hash"), F.explode_outer("_parts").alias("_p")
    ).select("_row", "_key", "_hash", "_p.*")
    # by one key for all that follows: a single shuffle, of matches and not of texts
    dealt = parts.repartition("_row")
    before = Window.partitionBy("_row", "kind").orderBy("number")
    placed = dealt.withColumn(
        "start",
        F.sum(F.col("gap") + F.col("length")).over(before) - F.col("length"),
    ).withColumn("end", F.col("start") + F.col("length"))
    placed = placed.withColumn("kind", F.when(F.col("counts"), F.col("kind")))  # the row stays
    linked = _linked(placed)
    base = len(BASE)
    shown = F.when(
        (F.col("kind") < base) | F.col("_reported"), F.struct("start", "kind", "end")
    ).cast(SPAN)
    return linked.groupBy("_row", "_key", "_hash").agg(
        F.array_sort(F.collect_list(shown)).alias("spans")
    )


def _linked(placed: DataFrame) -> DataFrame:
    """Adds whether a weak part has its complements within reach, in its scope."""
    kind = F.col("kind")
    number = {k: i for i, k in enumerate(KINDS)}
    by_row = Window.partitionBy("_row")
    up = by_row.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    down = by_row.orderBy(F.col("start").desc(), kind.desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = kind < len(BASE)
    groups = {
        "secret": kind.isin(number["assign"], number["hex"], number["random"]),
        "name": kind.isin(number["access"], number["identity"]),
        "place": kind == number["endpoint"],
    }
    scoped = placed.withColumn(
        "_scope", F.coalesce(F.sum((kind == number["break"]).cast("int")).over(up), F.lit(0))
    )
    # Parts within reach of [start, end): some part of the scope that starts no later ends late
    # enough, or some part that starts no earlier starts early enough. Nested parts hide nothing, as
    # the greatest end and the least start are over all parts and not those of a neighbour.
    scope = Window.partitionBy("_row", "_scope")
    before = scope.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = scope.orderBy(F.col("start").desc(), kind.desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    near = {}
    columns = {
        "_covered": F.max(F.when(base, F.col("end"))).over(up),
        "_next": F.min(F.when(base, F.col("start"))).over(down),
    }
    linked = {}
    for name, member in groups.items():
        linked[f"_{name}_end"] = F.max(F.when(member, F.col("end"))).over(before)
        linked[f"_{name}_start"] = F.min(F.when(member, F.col("start"))).over(after)
        near[name] = F.coalesce(
            F.col("start") - F.col(f"_{name}_end") <= REACH, F.lit(False)
        ) | F.coalesce(F.col(f"_{name}_start") - F.col("end") <= REACH, F.lit(False))
    found = scoped.withColumns(columns).withColumns(linked)
    inside = F.coalesce(F.col("_covered") > F.col("start"), F.lit(False)) | F.coalesce(
        F.col("_next") < F.col("end"), F.lit(False)
    )
    reported = (
        F.when(kind == number["random"], near["name"])
        .when(kind == number["identity"], near["secret"] & near["place"])
        .when(kind == number["endpoint"], near["secret"] & near["name"])
        .otherwise(F.lit(False))
    )
    return found.withColumn("_reported", reported & ~inside)


def span_list(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
        ),
        ",",
    )


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``base`` and ``spans`` (``kind:start:end``, code
    points), and the count of each base kind.

    A null text is empty and has no spans. Repeated rows return each, null keys stay, an empty table
    gives no rows and other columns are left out. Parts of a credential are linked within ``REACH``
    code points and between blank lines: a random looking string needs a name or access key, a name
    a secret and an address, an address a secret and a name. Parts inside base spans aren't told
    again.
    """
    found = spans_of(docs, text, key)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def count(n: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")

    return found.select(
        F.col("_key").alias(key),
        span_list(base).alias("base"),
        span_list(F.col("spans")).alias("spans"),
        *[
            count(n).alias(f"n_{kind}")
            for n, kind in enumerate(BASE)
        ],
    )


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``[SECRET]``; overlapping ones by one.

    All columns and rows are kept; texts without spans, null ones too, stay as they are.
    """
    of, digest, spans, own = (fresh(n, docs) for n in ("_key", "_hash", "_spans", "_own_hash"))
    found = spans_of(docs, text, key).filter(F.size("spans") > 0)
    found = found.groupBy(F.col("_key").alias(of), F.col("_hash").alias(digest)).agg(F.max("spans").alias(spans))
    value = F.col(f"`{text}`")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(value, acc["done"].cast("int") + 1, (s["start"] - acc["done"]).cast("int"))
        return F.when(
            s["start"] >= acc["done"],
            F.struct(F.concat(acc["out"], between, F.lit("[SECRET]")).alias("out"), s["end"].alias("done")),
        ).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["done"], s["end"]).alias("done"))
        )

    rest = lambda acc: F.concat(acc["out"], F.substr(value, acc["done"].cast("int") + 1))
    blank = F.when(F.col(spans).isNull(), value).otherwise(F.aggregate(spans, start, step, rest))
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(value, F.lit(""))))
    joined = marked.join(
        found, F.col(f"`{key}`").eqNullSafe(F.col(of)) & (F.col(own) == F.col(digest)), "left"
    )
    return joined.select(*[blank.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
