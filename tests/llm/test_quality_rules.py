import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm.quality_rules import fit_rules, judge, keep_good, repeated_words, text_features

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)) + "."


def counts(text):
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
    )


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "#x", "\n", "\t", "\x0b", "\x1c", "a b", "𝄞"])).map(" ".join))
def test_counts(text):
    assert text_features(text.encode())[:5] == counts(text)


def test_repeats_overlap():
    words = [b"x"] * 9
    assert repeated_words(words) == 9
    assert repeated_words([b"a", b"b"] * 8) == 16
    assert repeated_words([]) == 0


def test_fit_trusts_the_rules_that_agree():
    # rule 0 and 1 agree with each other; rule 2 speaks at random
    patterns = {"ggg": 400, "ggb": 400, "bbg": 50, "bbb": 50}
    share, table, posterior = fit_rules(patterns)
    assert posterior["ggb"] > 0.9 > 0.1 > posterior["bbg"]
    assert abs(share - 8 / 9) < 0.02
    assert table[0, 0, 0] > 0.95 > 0.6 > table[2, 0, 0]
    assert fit_rules({})[2] == {}


def test_judge(make_docs):
    bad = " ".join(f"w{i}#%&" for i in range(80))
    docs = make_docs(
        [(i, PROSE.replace("worda", f"x{i}")) for i in range(30)]
        + [(100 + i, bad.replace("w1", f"v{i}")) for i in range(8)]
        + [(200, None), (201, ""), (None, PROSE), (202, "a b c " * 5000), (0, PROSE)]
    )
    rows = judge(docs).collect()
    assert len(rows) == docs.count()
    kept = Counter(r.doc_id for r in rows if r.kept)
    assert kept == Counter([*range(30), None, 0])
    by = {r.doc_id: r for r in rows}
    assert by[200].n_words == 0 and by[200].base_failed and by[202].n_repeat_words == 15000
    assert keep_good(docs.filter("doc_id is not null")).columns == docs.columns
    assert {r.doc_id for r in keep_good(docs).collect()} == set(range(30))


def test_rows_of_one_key(make_docs):
    good = [PROSE.replace("worda", f"x{i}") for i in range(30)]
    docs = make_docs([*enumerate(good), (3, "short"), (None, PROSE), (None, "short")])
    kept = [(r.doc_id, r.text) for r in keep_good(docs, null_keys=True).collect()]
    assert Counter(kept) == Counter([*enumerate(good), (None, PROSE)])


def test_empty(make_docs):
    assert judge(make_docs([])).count() == 0
