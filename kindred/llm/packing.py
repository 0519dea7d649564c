"""Harmonic packing of documents into token sequences.

The classes are the reciprocal shares of a sequence: lengths over ``capacity / (j + 1)`` and up to
``capacity / j``, ``j`` pieces to a bin. A document is cut into full sequences, and what is left stays
whole or is cut further, where that saves more padding than a piece costs. Each worker fills the
bins of each class with its own pieces, ``j`` to a bin. What is left of a worker's last bins is
numbered through by class and fills bins in the same way; only the counts of the workers are added up
for that, and only each class's last, partly filled bin is packed again.
"""

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as packed

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm.bpe import CACHED_LENGTH, LETTER, Cache
from kindred.llm.columns import arrow_schema, slices
from kindred.session import broadcast_if_small, materialize

# fixed pattern: how byte-level files of this kind split words
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
NEIGHBOURS = (b"  ", b" \n", b"\n ", b"\n\n")
OTHER_SPACE = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\0"  # and the mark used for cutting
WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80")
# printable ASCII and line ends, and letters of Latin-1: characters on which all word splitters agree
ASCII = bytes([*range(0x20, 0x7F), 0x0A])
LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
# Latin letters and one mark
PLAIN = re.compile(rb"( ?" + LETTER + rb"+)([.,;:!?|]?)")


def needs_care(text: bytes) -> bool:
    """Whether white space stands beside white space, at an end, or is not a space or line end."""
    return (
        any(pair in text for pair in NEIGHBOURS)
        or text[:1] in (b" ", b"\n")
        or text[-1:] in (b" ", b"\n")
        or len(text.translate(None, OTHER_SPACE)) != len(text)
        or any(space in text for space in WIDE_SPACE)
    )


def rank_encoder(path: str) -> tiktoken.Encoding | None:
    """The file's vocabulary as ranks, which encode single words faster; None if it has other rules.

    Ranks serve where tokens are numbered in the order of the merges that make them.
    """
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    model, splitter = config["model"], config["pre_tokenizer"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    numbers = [model["vocab"].get(a + b) for a, b in merges]
    plain = splitter == {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
    }
    if config["normalizer"] or not plain or numbers != sorted(numbers) or model["end_of_word_suffix"]:
        return None
    # byte-level files name a byte by itself if it is printable, else by the next free code point
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    names = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    ranks = {bytes(names[c] for c in token): i for token, i in model["vocab"].items()}
    return tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class SpacedTokenizer:
    """Ids as by the tokenizers library, for byte-level files.

    A text of ASCII and Latin letters is encoded whole by the file's ranks. Of other texts each word with
    the space before it is encoded once: a space or line end between two other characters is a word's
    border.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ranks = rank_encoder(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.known = Cache()

    def plain(self, text: bytes) -> bool:
        """Whether ranks give the library's ids for the whole text."""
        return (
            self.ranks is not None
            and LATIN.fullmatch(text.translate(None, ASCII)) is not None
            and not any(token in text for token in self.special)
        )

    def _encoded(self, word: bytes) -> bytes:
        """Ids of Latin letters, maybe after a space, or of a mark."""
        if self.ranks:
            ids = self.ranks.encode_ordinary(word.decode())
        else:
            ids = self.library.encode(word.decode(), add_special_tokens=False).ids
        return packed(f"<{len(ids)}I", *ids)

    def _learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks; those of letters and a mark are put together from both."""
        known, found, rest = self.known, {}, []
        known.make_room(2 * len(chunks))
        for c in chunks:
            ids = known.old.get(c)
            if ids is None:
                plain = PLAIN.fullmatch(c)
                if not plain:
                    rest.append(c)
                    continue
                word, mark = plain.groups()
                ids = known.get(word) or known.old.get(word) or self._encoded(word)
                if mark:
                    if len(word) <= CACHED_LENGTH:
                        known[word] = ids
                    ids += known.get(mark) or self._encoded(mark)
            found[c] = ids
            if len(c) <= CACHED_LENGTH:
                known[c] = ids
        texts = [c.decode("utf-8", "replace") for c in rest]
        for c, e in zip(rest, self.library.encode_batch(texts, add_special_tokens=False), strict=True):
            found[c] = ids = packed(f"<{len(e)}I", *e.ids)
            if len(c) <= CACHED_LENGTH:
                known[c] = ids
        return found

    def encode(self, text: bytes) -> bytes:
        """Ids of a text in UTF-8, as little-endian unsigned 32-bit integers."""
        if self.plain(text):
            return np.array(self.ranks.encode_ordinary(text.decode()), "<u4").tobytes()
        if needs_care(text):
            first, *more = LONE_SPACE.split(text.decode("utf-8", "replace"))
            chunks = [first.encode(), *[f" {m}".encode() for m in more]]
        else:
            chunks = text.replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0").split(b"\0")
        found = list(map(self.known.get, chunks))
        if None in found:
            new = self._learn({c for c, ids in zip(chunks, found, strict=True) if ids is None})
            found = [new[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        return b"".join(found)


@lru_cache(maxsize=2)
def load(path: str) -> SpacedTokenizer:
    return SpacedTokenizer(path)


PIECE_COST = 1 / 32  # padding, as a share of a sequence, that one more piece must save; over 0


def class_lengths(capacity: int) -> list[int]:
    """The greatest lengths of the classes: ``capacity // j``, longest first."""
    return sorted({capacity // j for j in range(1, capacity + 1)}, reverse=True)


@lru_cache(maxsize=8)
def splits(capacity: int, piece_cost: float) -> list[int]:
    """For each length below ``capacity`` the length of the piece to cut off, 0 to leave it whole.

    Pieces cut off have the greatest length of a class, so that they waste nothing to speak of; what
    a piece wastes is its share of a bin less its length. The sum of waste and cost is the least.
    """
    sizes = np.array(class_lengths(capacity)[::-1])
    wasted = capacity / (capacity // sizes) - sizes + piece_cost * capacity
    least, first = np.zeros(capacity), [0] * capacity
    for length in range(1, capacity):
        least[length] = capacity / (capacity // length) - length
        shorter = np.searchsorted(sizes, length)
        if shorter:
            costs = wasted[:shorter] + least[length - sizes[:shorter]]
            best = int(costs.argmin())
            if costs[best] < least[length]:
                least[length], first[length] = costs[best], int(sizes[best])
    return first


def cut(length: int, capacity: int, piece_cost: float = PIECE_COST) -> list[int]:
    """The lengths of a document's pieces."""
    pieces, left = [capacity] * (length // capacity), length % capacity
    first = splits(capacity, piece_cost)
    while left:
        pieces.append(first[left] or left)
        left -= pieces[-1]
    return pieces


PIECES = (
    "start long, length long, ids_crc32 long, doc_tokens long, part long, to_bin long, position long, "
    "offset long"
)


def pieces(
    docs: DataFrame, path: str, text: str, key: str, capacity: int, end_id: int, piece_cost: float
) -> DataFrame:
    """Every document's pieces, numbered by ``position`` within their ``part`` and class (``to_bin``
    pieces a bin), with their ``offset`` in the part's bin."""
    kind = docs.select(f"`{key}`").schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, {PIECES}"
    target = arrow_schema(docs, schema)
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        used: Counter = Counter()  # pieces by class
        filled: Counter = Counter()  # length of the last bin by class
        for batch in batches:
            for piece in slices(batch, 1):
                rows, of = [], []
                for n, data in enumerate(piece.column(1).cast(pa.binary()).to_pylist()):
                    ids = load(path).encode(data or b"") + last
                    total, start = len(ids) // 4, 0
                    for size in cut(total, capacity, piece_cost):
                        crc = zlib.crc32(ids[4 * start : 4 * (start + size)])
                        to_bin = capacity // size
                        if used[to_bin] % to_bin == 0:
                            filled[to_bin] = 0
                        rows.append((start, size, crc, total, part, to_bin, used[to_bin], filled[to_bin]))
                        of.append(n)
                        used[to_bin] += 1
                        filled[to_bin] += size
                        start += size
                columns = np.array(rows, np.int64).reshape(len(rows), 8)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(of, pa.int64()))]
                    + [pa.array(columns[:, i]) for i in range(8)],
                    schema=target,
                )

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, schema)


def repack(rest: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each (length, number): longest first, into the first bin with room."""
    room: list[int] = []
    places = [(0, 0)] * len(rest)
    for i in sorted(range(len(rest)), key=lambda i: (-rest[i][0], rest[i][1])):
        length = rest[i][0]
        at = next((n for n, r in enumerate(room) if r >= length), len(room))
        if at == len(room):
            room.append(capacity)
        places[i] = at, capacity - room[at]
        room[at] -= length
    return places


def pack(
    docs: DataFrame,
    path: str,
    text: str = "text",
    key: str = "doc_id",
    capacity: int = 2048,
    end_id: int = 1,
    piece_cost: float = PIECE_COST,
) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its text's ids by the tokenizer file at ``path`` and then ``end_id``; a null or
    empty text is ``end_id`` alone. Repeated rows are packed each, null keys stay null, an empty
    table gives no rows and other columns are left out. Sequences are unique by ``sequence_id`` and
    filled without gaps from offset 0. The greater ``piece_cost``, the fewer documents are cut and
    the more padding there is. What is packed by a single task is less than one bin of each class, so
    at most a few thousand pieces whatever the input.
    """
    kind = docs.select(f"`{key}`").schema[0].dataType.simpleString()
    made = materialize(pieces(docs, path, text, key, capacity, end_id, piece_cost), "pieces")
    counts = made.groupBy("part", "to_bin").agg((F.max("position") + 1).alias("_n"))
    counts = counts.withColumns({"_bins": F.expr("_n div to_bin"), "_open": F.expr("_n % to_bin")})
    classes = Window.partitionBy("to_bin")
    earlier = classes.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def before(name: str) -> Column:
        return F.coalesce(F.sum(name).over(earlier), F.lit(0))

    places = counts.select(
        "part",
        "to_bin",
        "_bins",
        before("_bins").alias("_bins_before"),
        F.sum("_bins").over(classes).alias("_bins_all"),
        before("_open").alias("_open_before"),
        F.sum("_open").over(classes).alias("_open_all"),
    )
    placed = made.join(broadcast_if_small(places), ["part", "to_bin"]).withColumn(
        "_in_open", F.col("position") - F.col("_bins") * F.col("to_bin")
    )
    kept = [F.col(f"`{key}`"), *map(F.col, ("start", "length", "ids_crc32", "doc_tokens"))]
    # the class in the low part, so that ids of different classes differ; class 0 is the rest's
    wide = capacity + 1

    def sequence(bin_number: Column) -> Column:
        return (bin_number * wide + F.col("to_bin")).alias("sequence_id")

    own = placed.filter("_in_open < 0").select(
        *kept, sequence(F.col("_bins_before") + F.expr("position div to_bin")), "offset"
    )
    left = placed.filter("_in_open >= 0").withColumn("_index", F.col("_open_before") + F.col("_in_open"))
    left = left.withColumn("_bin", F.expr("_index div to_bin"))
    in_bin = Window.partitionBy("to_bin", "_bin").orderBy("_index")  # at most ``to_bin`` rows
    so_far = F.sum("length").over(in_bin.rowsBetween(Window.unboundedPreceding, -1))
    shared = left.filter("_bin < _open_all div to_bin").select(
        *kept, sequence(F.col("_bins_all") + F.col("_bin")), F.coalesce(so_far, F.lit(0)).alias("offset")
    )
    whole = own.unionByName(shared)
    schema = (
        f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long"
    )

    def again(rest: pa.Table) -> pa.Table:
        numbers = zip(rest["length"].to_pylist(), rest["_index"].to_pylist(), strict=True)
        places = repack(list(numbers), capacity)
        return (
            rest.drop_columns(["_index", "_one"])
            .append_column("sequence_id", pa.array([b * wide for b, _ in places], pa.int64()))
            .append_column("offset", pa.array([o for _, o in places], pa.int64()))
        )

    rest = left.filter("_bin >= _open_all div to_bin").select(*kept, "_index", F.lit(1).alias("_one"))
    return whole.unionByName(rest.groupBy("_one").applyInArrow(again, schema))
