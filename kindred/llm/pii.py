"""Personal data, and terms of the corpus that give it away.

Patterns find the protected entities. The words around every mention are then counted over the whole
corpus: a term that is hardly ever met without one entity nearby carries almost all information
about it, and is removed or generalised wherever it stands, also where the entity itself doesn't.
"""

import hashlib
import json
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.columns import arrow_schema, per_text, slices, span_text
from kindred.session import materialize

# Fixed patterns. The look-behinds only skip starts at which the longer match has begun already.
KINDS = ["email", "ip", "card", "phone"]
ORDER = [*KINDS, "remove", "generalise"]
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAME_REACH = 320  # looked at first to the left of an @; farther only if all of it belongs

REACH = 6  # words on either side of a mention
MIN_CONTEXTS = 4  # different surroundings in which term and entity must meet
MIN_SHARE = 0.8  # of the distinct texts with the term that have the entity near it
MIN_BITS = 3.0  # pointwise mutual information of term and entity
LIMIT = 200_000  # terms that a task holds; more are joined


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for host in EMAIL_HOST.finditer(text):
        at = host.start()
        low = max(end, at - NAME_REACH)
        name = EMAIL_NAME.search(text, low, at)
        while name and name.start() == low > end:
            low = max(end, at - 4 * (at - low))
            name = EMAIL_NAME.search(text, low, at)
        if name:
            end = host.end()
            yield name.start(), end


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points) of all personal data, by start, then kind as listed."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def term_of(word: str) -> str:
    return word.strip(".,;:!?()[]{}\"'«»„“”|").lower()


def entity_key(text: str, span: tuple[str, int, int]) -> str:
    value = text[span[1] : span[2]]
    return f"{span[0]}:{value.lower() if span[0] == 'email' else _digits(value)}"


def surroundings(
    text: str, spans: list[tuple[str, int, int]]
) -> Iterator[tuple[str, list[str], int]]:
    """Each mention's entity, the terms within ``REACH`` words of it, and a hash of all these words.

    These are ``REACH`` whole words on either side, whatever their lengths, and what is glued to the
    mention itself, up to the next mention.
    """
    if not spans:
        return
    starts, ends = array("q"), array("q")
    for m in WORD.finditer(text):
        starts.append(m.start())
        ends.append(m.end())

    @cache
    def word(i: int) -> tuple[str, int]:
        term = term_of(text[starts[i] : ends[i]])
        return term, _long(term.encode())

    def glued(a: int, b: int) -> list[tuple[str, int]]:
        term = term_of(text[a:b])
        return [(term, _long(term.encode()))] if a < b else []

    over = sorted(e for _, _, e in spans)
    begun = sorted(s for _, s, _ in spans)
    for span in spans:
        _, a, b = span
        i, j = bisect_left(starts, a), bisect_left(starts, b)
        left, right = [], []
        if i and ends[i - 1] > a:  # begins before the mention and runs into it
            i -= 1
            before = bisect_right(over, a)
            left = glued(max(starts[i], over[before - 1] if before else 0), a)
        if j and ends[j - 1] > b:
            after = bisect_left(begun, b)
            right = glued(b, min(ends[j - 1], begun[after] if after < len(begun) else len(text)))
        near = [word(n) for n in range(max(0, i - REACH), i)] + left + right
        near += [word(n) for n in range(j, min(len(starts), j + REACH))]
        # words that hold digits or @ are personal data or parts of it
        kept = [t for t, _ in near if len(t) > 2 and not any(c.isdigit() or c in "@+" for c in t)]
        yield entity_key(text, span), kept, _long(repr([h for _, h in near]).encode())


def _long(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def copies_of(docs: DataFrame, text: str, limit: int) -> tuple[DataFrame, dict[bytes, int]]:
    """``text, n, copies`` and a dictionary: how many rows of the corpus have a row's text.

    A row stands for ``n`` rows, so that it is ``n / copies`` of a distinct text. Up to ``limit``
    texts with copies travel to the tasks by their digests, which then give ``copies`` where it is
    null; with more of them equal texts are collapsed to a row.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    counted = docs.groupBy(F.unhex(F.sha2(value, 256)).alias("digest")).agg(F.count("*").alias("n"))
    repeated = materialize(counted.filter("n > 1"), "copies")
    rows = bounded(repeated, ["digest", "n"], limit)
    if rows is not None:
        each = docs.select(
            value.alias("text"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("copies")
        )
        return each, {bytes(r.digest): r.n for r in rows}
    once = docs.groupBy(value.alias("text")).agg(F.count("*").alias("n"))
    return materialize(once.withColumn("copies", F.col("n")), "distinct-texts"), {}


def counted_texts(batch: pa.RecordBatch, known: dict[bytes, int]) -> Iterator[tuple[str, int, int]]:
    """Text, rows and copies of each row of :func:`copies_of`."""
    for piece in slices(batch, 0):
        for value, n, copies in zip(*[c.to_pylist() for c in piece.columns], strict=True):
            if copies is None:
                copies = known.get(hashlib.sha256(value.encode()).digest(), 1) if known else 1
            yield value, n, copies


def mentions(texts: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """``entity, term, context, n_rows, n_texts``: a term near a mention, and a hash of the mention's
    surroundings, with the rows and distinct texts in which the two meet.

    A text that has them in several surroundings counts for the first of these. Rows without term
    count all rows and texts with the entity.
    """
    schema = "entity string, term string, context long, copies long, n long"
    target = arrow_schema(texts, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: Counter = Counter()
            for value, n, copies in counted_texts(batch, known):
                met = set()
                for entity, terms, context in surroundings(value, base_spans(value)):
                    for term in (None, *terms):
                        place = (entity, term, 0 if term is None else context, copies)
                        rows[place] += 0 if (entity, term) in met else n
                        met.add((entity, term))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(target.names, (*r, n), strict=True)) for r, n in rows.items()], schema=target
            )

    found = texts.mapInArrow(run, schema).groupBy("entity", "term", "context", "copies")
    return (
        found.agg(F.sum("n").alias("n_rows"))
        .withColumn("n_texts", F.expr("n_rows div copies"))
        .groupBy("entity", "term", "context")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_texts").alias("n_texts"))
    )


def bounded(terms: DataFrame, columns: list[str], limit: int) -> list | None:
    """The rows if there are at most ``limit`` of them; None otherwise."""
    rows = terms.select(*columns).limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def term_counts(texts: DataFrame, known: dict[bytes, int], terms: DataFrame, limit: int) -> DataFrame:
    """``term, term_rows, term_texts``: rows and distinct texts of the corpus with each given term.

    Up to ``limit`` terms travel to the tasks; more are joined to the words of the corpus.
    """
    rows = bounded(terms, ["term"], limit)
    wanted = None if rows is None else {r.term for r in rows}
    schema = "term string, copies long, n long"
    target = arrow_schema(texts, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], Counter] = {}  # of texts, by copies and rows of each

        def out() -> pa.RecordBatch:
            found = [(t, c, k * n) for (c, n), own in counts.items() for t, k in own.items()]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            arrays = [pa.array(v, f.type) for v, f in zip(columns, target, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=target)

        for batch in batches:
            for value, n, copies in counted_texts(batch, known):
                found = document_terms(value)
                own = counts.setdefault((copies, n), Counter())
                own.update(found if wanted is None else found & wanted)
                if sum(map(len, counts.values())) > 400_000:
                    yield out()
                    counts.clear()
        yield out()

    words = texts.mapInArrow(run, schema)
    if wanted is None:
        words = words.join(terms, "term", "left_semi")
    return (
        words.groupBy("term", "copies")
        .agg(F.sum("n").alias("n"))
        .groupBy("term")
        .agg(F.sum("n").alias("term_rows"), F.sum(F.expr("n div copies")).alias("term_texts"))
    )


def document_terms(text: str) -> set[str]:
    return {term_of(w) for w in set(WORD.findall(text))}


def revealing_terms(docs: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Terms beyond the disclosure thresholds: ``term, entity, share, bits, action``.

    ``share`` is how much of the term's distinct texts have the entity near it, so copies of a text,
    whatever their number, count once on either side. Equal surroundings count once as evidence.
    ``bits`` is the pointwise mutual information of term and entity, counted in distinct texts or in
    rows, whichever says more: copies of revealing texts make it small in rows, and copies of other
    texts in distinct texts. A term of one entity is removed, one that points to several generalised.
    """
    texts, known = copies_of(docs, text, limit)
    near = materialize(mentions(texts, known), "mentions")
    both = [F.sum("n_rows").alias("both_rows"), F.sum("n_texts").alias("both_texts")]
    joint = near.filter("term is not null").groupBy("entity", "term").agg(F.count("*").alias("met"), *both)
    joint = materialize(joint.filter(F.col("met") >= MIN_CONTEXTS), "joint")
    n_entity = near.filter("term is null").select(
        "entity", F.col("n_rows").alias("entity_rows"), F.col("n_texts").alias("entity_texts")
    )
    n_term = term_counts(texts, known, joint.select("term").distinct(), limit)
    n_rows = docs.count()
    if known:
        n_texts = n_rows - sum(known.values()) + len(known)
    else:
        n_texts = texts.count()  # without copies a row each, else collapsed
    share = F.col("both_texts") / F.col("term_texts")

    def bits(unit: str, n_all: int) -> Column:
        alone = F.col(f"term_{unit}") * F.col(f"entity_{unit}")
        return F.log2(F.col(f"both_{unit}") * F.lit(float(n_all)) / alone)

    return (
        joint.join(n_entity, "entity")
        .join(n_term, "term")
        .withColumn("share", F.least(share, F.lit(1.0)))
        .withColumn("bits", F.greatest(bits("texts", n_texts), bits("rows", n_rows)))
        .filter((F.col("share") >= MIN_SHARE) & (F.col("bits") >= MIN_BITS))
        .groupBy("term")
        .agg(
            F.max_by("entity", F.struct("share", "entity")).alias("entity"),
            F.max("share").alias("share"),
            F.max("bits").alias("bits"),
            F.when(F.count("*") > 1, "generalise").otherwise("remove").alias("action"),
        )
    )


def all_spans(text: str, actions: dict[str, str]) -> list[tuple[str, int, int]]:
    """Base spans and, apart from them, the terms in ``actions`` (kind ``remove`` or ``generalise``)."""
    spans = base_spans(text)
    if actions and not actions.keys().isdisjoint(document_terms(text)):
        base = spans
        for m in WORD.finditer(text):
            term = term_of(m[0])
            if action := actions.get(term):
                start = m.start() + max(0, m[0].lower().find(term))
                end = min(m.end(), start + len(term))
                if all(b <= start or end <= a for _, a, b in base):
                    spans = [*spans, (action, start, end)]
        spans.sort(key=lambda s: (s[1], ORDER.index(s[0])))
    return spans


def blanked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span put in general words or, for kind ``remove``, left out."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], "" if kind == "remove" else f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


FOUND = "base string, spans string, n_email long, n_ip long, n_card long, n_phone long"


def find(
    docs: DataFrame, text: str = "text", key: str = "doc_id", clean: bool = False, limit: int = LIMIT
) -> DataFrame:
    """``key``, base spans and all spans (``kind:start:end``) and counts of every row; with
    ``clean`` also ``clean_text``, in which no span is left.

    A null text is empty and has no spans; repeated rows are searched each, null keys stay; an empty
    table gives no rows; other columns are left out. Spans may overlap between kinds.
    """
    terms = materialize(revealing_terms(docs, text, limit), "revealing")
    rows = bounded(terms, ["term", "action"], limit)
    kind = docs.select(f"`{key}`").schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, {FOUND}" + ", clean_text string" * clean
    if rows is not None:
        actions = {r.term: r.action for r in rows}

        def search(data: bytes) -> tuple:
            value = data.decode("utf-8", "replace")
            return found_in(value, all_spans(value, actions), clean)

        return per_text(docs, text, [key], schema, search)
    # more terms than a task should hold: each text gets its own list of them by a join
    spoken = docs.select(
        F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")
    ).withColumn("_hash", F.sha2("_text", 256))
    split = arrow_schema(docs, "_hash string, term string")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                rows = zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)
                pairs = {(h, t) for h, value in rows for t in document_terms(value)}
                yield pa.RecordBatch.from_pylist(
                    [{"_hash": h, "term": t} for h, t in pairs], schema=split
                )

    said = spoken.select("_hash", "_text").mapInArrow(explode, "_hash string, term string")
    lists = (
        said.distinct()
        .join(terms.select("term", "action"), "term")
        .groupBy("_hash")
        .agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("term", "action")))).alias("_t"))
    )
    joined = spoken.join(lists, "_hash", "left").withColumn(
        "_said", F.concat(F.coalesce("_t", F.lit("{}")), F.lit("\n"), F.col("_text"))
    )

    def search_own(data: bytes) -> tuple:
        own, _, value = data.decode("utf-8", "replace").partition("\n")
        return found_in(value, all_spans(value, json.loads(own)), clean)

    return per_text(joined, "_said", [key], schema, search_own)


def found_in(text: str, spans: list[tuple[str, int, int]], clean: bool) -> tuple:
    base = [s for s in spans if s[0] in KINDS]
    counts = [sum(s[0] == k for s in base) for k in KINDS]
    extra = (blanked(text, spans),) if clean else ()
    return (span_text(base), span_text(spans), *counts, *extra)
