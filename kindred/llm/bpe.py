"""Byte-pair encoding by forced boundaries.

Two neighbouring symbols that are neighbours in no vocabulary token can never end up in one token,
whatever is merged first. Every word is cut there; the fragments are encoded by themselves, with a
cache, and their ids joined.
"""

import json
import re
from functools import lru_cache
from struct import pack

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from kindred.llm.columns import per_text

CACHE_ENTRIES = 400_000
CACHED_LENGTH = 64  # bytes; longer words and fragments are encoded each time
# letters of ASCII and Latin-1, and one mark after them that always is a word by itself
LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
PLAIN = re.compile(rb"(" + LETTER + rb"+)([.,;:!?|]?)")


class Cache(dict):
    """A dictionary of bounded size: when it is full, its entries become the ``old`` ones."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.entries, self.old = entries, {}

    def make_room(self, entries: int) -> None:
        if len(self) + entries > self.entries and self:
            self.old = dict(self)
            self.clear()

    def again(self, key):
        """What the old entries have for a key that isn't here; it stays from now on."""
        value = self.old.get(key)
        return None if value is None else self.keep(key, value)

    def keep(self, key, value):
        if len(key) <= CACHED_LENGTH:
            if len(self) >= self.entries:
                self.make_room(1)
            self[key] = value
        return value


class ForcedBoundaryBpe:
    """Encodes as the tokenizers library does with the file's normalizer and word split.

    For files whose word split drops white space and whose words end in a suffix.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        tokens = {**self.vocab, **self.special}
        self.names = {i: t.encode() for t, i in tokens.items()}
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.inside = {p for token in self.vocab for p in self._neighbours(self._symbols(token))}
        self.fragments, self.words = Cache(CACHE_ENTRIES // 4), Cache(CACHE_ENTRIES // 2)
        self.chunks = Cache()
        marks = (self.splitter.pre_tokenize_str(chr(c))[0][0] for c in range(33, 127))
        self.byte_names = {c: name for c, name in zip(range(33, 127), marks, strict=True)}
        for c in range(0xC0, 0x100):  # the two bytes of letters of Latin-1
            if c not in (0xD7, 0xF7):
                name = self.splitter.pre_tokenize_str(chr(c))[0][0]
                self.byte_names |= dict(zip(chr(c).encode(), name, strict=True))

    def _symbols(self, token: str) -> list[str]:
        if len(token) > len(self.suffix) and token.endswith(self.suffix):
            symbols = list(token[: -len(self.suffix)])
            symbols[-1] += self.suffix
            return symbols
        return list(token)

    @staticmethod
    def _neighbours(symbols: list[str]):
        return zip(symbols, symbols[1:], strict=False)

    def fragments_of(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """The symbols of a word, cut wherever no token can reach across."""
        cuts = [
            i for i, p in enumerate(self._neighbours(symbols), 1) if p not in self.inside
        ]
        if not cuts:
            return [tuple(symbols)]
        return [
            tuple(symbols[a:b]) for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True)
        ]

    def merged(self, fragment: tuple[str, ...]) -> list[int]:
        """Ids of one fragment: the earliest learned merge first, leftmost among equals."""
        known = self.fragments.get(fragment) or self.fragments.again(fragment)
        if known is not None:
            return known
        parts = list(fragment)
        never = len(self.ranks)
        ranks = [self.ranks.get(p, never) for p in self._neighbours(parts)]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            for j in (i - 1, i):
                if 0 <= j < len(ranks):
                    ranks[j] = self.ranks.get((parts[j], parts[j + 1]), never)
        return self.fragments.keep(fragment, [self.vocab[p] for p in parts if p in self.vocab])

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word, given as the names of its bytes."""
        symbols = list(word)
        symbols[-1] += self.suffix
        ids: list[int] = []
        for fragment in self.fragments_of(symbols):
            ids += self.merged(fragment)
        return ids

    def chunk_ids(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for piece in self.at_special.split(chunk) if self.special else [chunk]:
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(piece)):
                    ids += self.word_ids(word)
        return ids

    def _plain(self, word: bytes) -> bytes:
        """Ids of Latin letters or one mark, which the normalizer only puts in lower case."""
        word = word.decode().lower().encode()
        got = self.words.get(word) or self.words.again(word)
        if got is None:
            ids = self.word_ids("".join([self.byte_names[b] for b in word]))
            got = self.words.keep(word, pack(f"<{len(ids)}I", *ids))
        return got

    def _chunk(self, chunk: bytes) -> bytes:
        if plain := PLAIN.fullmatch(chunk):
            word, mark = plain.groups()
            return self._plain(word) + (self._plain(mark) if mark else b"")
        ids = self.chunk_ids(chunk.decode("utf-8", "replace"))
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: bytes) -> bytes:
        """Ids of a text in UTF-8, as little-endian unsigned 32-bit integers.

        Words never reach across white space, so what lies between spaces is encoded once.
        """
        chunks = text.split()
        found = list(map(self.chunks.get, chunks))
        if None in found:
            again, keep = self.chunks.again, self.chunks.keep
            found = [
                again(c) or keep(c, self._chunk(c)) if ids is None else ids
                for c, ids in zip(chunks, found, strict=True)
            ]
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        """The tokens of ids with a space between, as files without a decoder are read."""
        names = self.names
        return b" ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def encode_decode(
    docs: DataFrame, path: str, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` of every row's text.

    ``path`` names the vocabulary file where executors find it. A null or empty text has no ids;
    repeated rows are encoded each; null keys stay; other columns are left out.
    """
    kind = docs.select(f"`{key}`").schema[0].dataType.simpleString()

    def both(data: bytes) -> tuple[bytes, str]:
        ids = load(path).encode(data)
        return ids, load(path).decode(ids).decode()

    return per_text(docs, text, [key], f"`{key}` {kind}, ids binary, decoded string", both)
