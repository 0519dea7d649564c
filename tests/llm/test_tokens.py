import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kindred.llm import bpe, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "",
    " ",
    "Hello, World's  finest\n\n tea  ",
    "don't 'S a<|endoftext|>b <|startoftext|>\tx",
    "É́ é ΣΑΣ İstanbul ßtraße ﬁ 漢字 🙂🙂  x y \x1c\x85z",
    "x" * 700,
    " \n a \n\n b\r\n  c\n ",
    "1234567 a1b2 ___ ---!!! ???",
]
LIBRARY = Tokenizer.from_file(WORDS)
ANY = st.lists(
    st.sampled_from([*"abeS'té漢1 \n\t,.", "\0", "\xd7", "É", "\x1c", "\u2003", " x", "Ab,", "  ", "the ", "<|endoftext|>", "́", "!!", " ", "ing"])
).map("".join)


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(BYTES)


def check_words(library, text):
    ids = bpe.load(WORDS).encode(text.encode())
    decoded = bpe.load(WORDS).decode(ids)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded.decode() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_forced_boundaries_equal_the_library(words, text):
    check_words(words, text)


@settings(max_examples=400, deadline=None)
@given(ANY)
def test_forced_boundaries_any(text):
    check_words(LIBRARY, text)


def test_words_are_cut():
    coder = bpe.load(WORDS)
    symbols = [*"zqxjvk", "w</w>"]
    parts = coder.fragments_of(symbols)
    assert len(parts) > 1 and [s for p in parts for s in p] == symbols
    assert len(coder.fragments_of([*"th", "e</w>"])) == 1


@pytest.mark.parametrize("text", TEXTS)
def test_spaced_tokenizer(byte_level, text):
    ids = np.frombuffer(packing.load(BYTES).encode(text.encode()), "<u4").tolist()
    assert ids == byte_level.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(ANY)
def test_spaced_tokenizer_any(text):
    coder = packing.load(BYTES)
    want = coder.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(text.encode()), "<u4").tolist() == want


def test_encode_decode(make_docs, words):
    docs = make_docs([(1, TEXTS[2]), (2, None), (None, TEXTS[3]), (1, TEXTS[2]), (3, "ab " * 40000)])
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode_decode(docs, WORDS).collect())
    want = Counter()
    for r in docs.collect():
        ids = words.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, np.array(ids, "<u4").tobytes(), words.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.encode_decode(make_docs([]), WORDS).count() == 0


def test_cut():
    lengths = packing.class_lengths(2048)
    waste = lambda n: 2048 / (2048 // n) - n
    for n in [*range(1, 5000, 7), 2048, 4096]:
        pieces = packing.cut(n, 2048)
        assert sum(pieces) == n and set(pieces[:-1]) <= set(lengths)
        if n < 2048:  # no way with one cut or none is cheaper
            cost = sum(map(waste, pieces)) + 64 * (len(pieces) - 1)
            ways = [waste(n), *[waste(c) + waste(n - c) + 64 for c in lengths if c < n]]
            assert cost <= min(ways) + 1e-9


def check_packing(docs, rows, tokenizer, capacity=2048):
    """Every id in exactly one piece, sequences gapless, hardly any padding."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
    made = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    left = Counter(made)
    total = 0
    for d in docs.collect():
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        data, start = np.array(ids, "<u4").tobytes(), 0
        for n in packing.cut(len(ids), capacity):
            left[d.doc_id, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), len(ids)] -= 1
            start += n
    assert not any(left.values())
    return padding / total


def test_pack(make_docs, byte_level):
    texts = [(i, " ".join(["word", "other", f"x{i}"] * (i * 17 % 900))) for i in range(90)]
    docs = make_docs([*texts, (7, None), (None, "tail"), (2**60 + 1, ""), (7, None)]).repartition(5)
    docs = docs.cache()
    rows = packing.pack(docs, BYTES).collect()
    assert check_packing(docs, rows, byte_level) < 0.02
    assert {2**60 + 1, None} <= {r.doc_id for r in rows}
    assert packing.pack(make_docs([]), BYTES).count() == 0


def test_bins_hold_pieces_of_one_class(make_docs, byte_level):
    docs = make_docs([(i, "a word " * (i % 97)) for i in range(3000)]).repartition(6).cache()
    rows = packing.pack(docs, BYTES, capacity=64).collect()
    assert check_packing(docs, rows, byte_level, 64) < 0.03
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(64 // r.length)
    mixed = [i for i, classes in bins.items() if i % 65 == 0]  # what the single task has packed
    assert len(mixed) < 64
    assert all(c == [i % 65] * (i % 65) for i, c in bins.items() if i % 65)
    whole = packing.pack(docs, BYTES, capacity=64, piece_cost=1.0).collect()
    assert len(whole) == sum(-(-d // 64) for d in {r.doc_id: r.doc_tokens for r in rows}.values())


def test_digest_of_nothing(make_docs):
    row = bpe.encode_decode(make_docs([(1, None)]), WORDS).first()
    assert hashlib.sha256(row.ids).hexdigest() == hashlib.sha256(b"").hexdigest()
