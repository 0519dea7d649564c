"""Chat formatting of records in different layouts.

A record's nested field names, without their types, are hashed to its fingerprint. Each fingerprint
of the input selects one declared mapping, which turns the record into canonical turns; these are
put into a template whose control strings can't be imitated by the texts.
"""

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import broadcast_if_small

TURNS = "array<struct<turn: bigint, role: string, text: string>>"
OPEN, SAYS, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
# what models take for control: anything in <| |>, sentence marks, and instruction marks
CONTROL = r"([<\[])(\||/?s>|/?INST\]|</?SYS>>)"
TYPE = r": (?:VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|STRING|BINARY|DATE|UUID|VARIANT|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+,\d+\))(?=[,>])"
MARK = r"(`(?:[^`]|``)*`:|\w+:|OBJECT<|ARRAY<|>)"  # names, and brackets as they open and close


@dataclass(frozen=True)
class Listed:
    """One field holds a list of turns."""

    name: str
    field: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()  # other names of canonical roles

    def fits(self, paths: Column) -> Column:
        inside = f"$.{self.field}[]"
        return F.array_contains(paths, f"{inside}.{self.role}") & F.array_contains(
            paths, f"{inside}.{self.text}"
        )

    def turns(self, record: Column) -> Column:
        kind = f"array<struct<`{self.role}`: string, `{self.text}`: variant>>"
        said = F.try_variant_get(record, f"$.{self.field}", kind)

        def role(m: Column) -> Column:
            out = m[self.role]
            for other, canonical in self.roles:
                out = F.when(m[self.role] == other, canonical).otherwise(out)
            return out

        def text(m: Column) -> Column:
            # a list of parts says the texts of its parts; those without text, as pictures, are left out
            pieces = F.try_variant_get(m[self.text], "$", "array<struct<text: string>>")
            listed = F.schema_of_variant(m[self.text]).startswith("ARRAY<OBJECT<")
            joined = F.array_join(F.transform(pieces, lambda e: e["text"]), "\n\n")
            return F.when(listed, joined).otherwise(F.try_variant_get(m[self.text], "$", "string"))

        return F.transform(
            said, lambda m, i: _turn(i.cast("bigint"), role(m), text(m))
        )


@dataclass(frozen=True)
class Fields:
    """One field for each turn; further fields of a turn follow after a blank line if not empty."""

    name: str
    parts: tuple[tuple[str, tuple[str, ...]], ...]  # role, fields; the first must be there

    def fits(self, paths: Column) -> Column:
        return reduce(and_, [_plain(paths, fields[0]) for _, fields in self.parts])

    def turns(self, record: Column) -> Column:
        said = []
        for n, (role, fields) in enumerate(self.parts):
            values = [F.try_variant_get(record, f"$.{f}", "string") for f in fields]
            more = [F.when(v != "", v) for v in values[1:]]
            said.append(_turn(F.lit(n).cast("bigint"), F.lit(role), F.concat_ws("\n\n", values[0], *more)))
        return F.array(*said)


@dataclass(frozen=True)
class OneTurn:
    """The record is a single turn and says which."""

    name: str
    turn: str
    role: str
    text: str

    def fits(self, paths: Column) -> Column:
        return reduce(and_, [_plain(paths, f) for f in (self.turn, self.role, self.text)])

    def turns(self, record: Column) -> Column:
        number = F.try_variant_get(record, f"$.{self.turn}", "bigint")
        values = [F.try_variant_get(record, f"$.{f}", "string") for f in (self.role, self.text)]
        return F.array(_turn(number, *values))


def _plain(paths: Column, field: str) -> Column:
    """The record itself has the field, and it holds neither an object nor a list."""
    return F.array_contains(paths, f"$.{field}") & ~F.array_contains(paths, f"$.{field}<")


def _turn(number: Column, role: Column, text: Column) -> Column:
    return F.struct(
        number.alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )


# the first layout that fits is taken
LAYOUTS = (
    Listed("messages", "messages", "role", "content"),
    Listed(
        "conversations",
        "conversations",
        "from",
        "value",
        (("human", "user"), ("gpt", "assistant"), ("model", "assistant")),
    ),
    OneTurn("turn_rows", "turn", "role", "text"),
    Fields("instruction", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Fields("completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Fields("response", (("user", ("prompt",)), ("assistant", ("response",)))),
    Fields("question", (("user", ("question", "context")), ("assistant", ("answer",)))),
)


def field_paths(record: Column) -> Column:
    """The nested field names of a variant in one text, in order of name and without types."""
    return F.regexp_replace(F.schema_of_variant(record), TYPE, ":")


def path_list(names: Column) -> Column:
    """Every field's whole path, ``$.messages[].role``; that of an object or list again with ``<``.

    ``names`` is what :func:`field_paths` gives. Its brackets are followed one by one, so a path tells
    where a field stands and not just its name; the work is linear in the opened brackets.
    """
    marks = F.regexp_extract_all(names, F.lit(MARK), F.lit(1))
    empty = F.array().cast("array<string>")
    # open brackets with their path, the path of what comes next, and all paths met
    start = F.struct(empty.alias("open"), F.lit("$").alias("at"), empty.alias("met"))

    def step(acc: Column, mark: Column) -> Column:
        named = F.concat(
            F.element_at(acc["open"], -1), F.lit("."), F.regexp_replace(mark, "^`|`?:$", "")
        )
        opened = F.concat(acc["open"], F.array(acc["at"]))
        known = F.concat(acc["met"], F.array(F.concat(acc["at"], F.lit("<"))))

        def state(open_: Column, at: Column, met: Column) -> Column:
            return F.struct(open_.alias("open"), at.alias("at"), met.alias("met"))

        return (
            F.when(mark == "OBJECT<", state(opened, acc["at"], known))
            .when(mark == "ARRAY<", state(opened, F.concat(acc["at"], F.lit("[]")), known))
            .when(mark == ">", state(F.slice(acc["open"], 1, F.size(acc["open"]) - 1), acc["at"], acc["met"]))
            .otherwise(state(acc["open"], named, F.concat(acc["met"], F.array(named))))
        )

    return F.aggregate(marks, start, step, lambda acc: acc["met"])


def choose_layout(paths: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for layout in reversed(LAYOUTS):
        chosen = F.when(layout.fits(paths), layout.name).otherwise(chosen)
    return chosen


def with_layout(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with ``_fingerprint`` and ``_layout`` (null where no mapping is declared)."""
    names = field_paths(F.col(record))
    marked = records.withColumn("_fingerprint", F.xxhash64(names))
    known = (
        records.select(names.alias("_names"))
        .distinct()
        .select("_names", path_list(F.col("_names")).alias("_paths"))
        .select(F.xxhash64("_names").alias("_fingerprint"), choose_layout(F.col("_paths")).alias("_layout"))
        .dropDuplicates(["_fingerprint"])
    )
    return marked.join(broadcast_if_small(known), "_fingerprint", "left")


def unmatched(records: DataFrame, record: str = "record") -> DataFrame:
    """``fingerprint``, ``names`` and ``records`` of every layout that has no mapping, null records too.

    These are what :func:`canonical_turns` leaves out, so a new layout shows itself.
    """
    counted = records.groupBy(field_paths(F.col(f"`{record}`")).alias("names")).agg(
        F.count(F.lit(1)).alias("records")
    )
    layout = choose_layout(path_list(F.col("names")))
    return counted.where(layout.isNull()).select(F.xxhash64("names").alias("fingerprint"), "names", "records")


def canonical_turns(records: DataFrame, key: str, record: str = "record") -> DataFrame:
    """``key`` and ``turns``, sorted by number (null first), then role, then text.

    Records of one key, a null key too, are one conversation. Records of undeclared layout, null
    records and lists without turns add none (:func:`unmatched` counts them); a key with no turns at
    all isn't returned.
    """
    laid = with_layout(
        records.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{record}`").alias("_record")), "_record"
    )
    turns = F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        turns = F.when(F.col("_layout") == layout.name, layout.turns(F.col("_record"))).otherwise(turns)
    return (
        laid.select("_key", F.explode(turns).alias("_turn"))
        .groupBy("_key")
        .agg(F.array_sort(F.collect_list("_turn")).alias("turns"))
        .select(F.col("_key").alias(key), "turns")
    )


def escaped(text: Column) -> Column:
    """A backslash after the first character of every control string; those of the text doubled."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(conversations: DataFrame, turns: str = "turns") -> DataFrame:
    """``conversations`` with ``segments``, an array of (text, loss).

    Their texts, put together, are the formatted conversation; those with ``loss`` are what a model
    is trained to say: the texts of turns whose role is exactly ``assistant``.
    """

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(SAYS))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")),
            F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
        )

    return conversations.withColumn("segments", F.flatten(F.transform(turns, parts)))


def whole_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    trained = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(trained, lambda s: unescaped(s["text"])), "")


def read_back(text: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    closed = F.split(text, CLOSE.replace("|", r"\|"))
    said = F.slice(closed, 1, F.size(closed) - 1)  # nothing is left behind the last mark

    def turn(s: Column) -> Column:
        halves = F.split(F.substr(s, F.lit(len(OPEN) + 1)), SAYS.replace("|", r"\|"), 2)
        return F.struct(unescaped(halves[0]).alias("role"), unescaped(halves[1]).alias("text"))

    return F.transform(said, turn)
