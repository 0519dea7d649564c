import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The patterns as they are stated."""
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if max(map(int, m[0].split("."))) < 256]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        sums = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])]
        if 14 <= len(d) <= 19 and sum(sums) % 10 == 0:
            spans.append(("card", *m.span()))
    spans += [
        ("phone", *m.span())
        for m in PHONE.finditer(text)
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15
    ]
    return sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))


PARTS = ["a", "@", ".", "1", "99", "256", "4111 1111-1111 1111", "+1 (487) 555-7209", "-", " ", "é",
         "x.y@h-1.com", "1.2.3.4", "+", "(", "0004", "a@b", ".c@d.e@f.g.", "\n", "x" * 400]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def corpus():
    filler = [f"plain{i}" for i in range(60)]
    rows = []
    for i in range(12):  # the nickname stands beside the address in different surroundings
        words = [filler[(7 * i + k) % 60] for k in range(8)]
        words[4:4] = ["Zorblax,", "zed@corp.example"]
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(filler[i % 50 : i % 50 + 10])) for i in range(400)]
    rows += [(900, "the Zorblax stands alone"), (901, None), (902, ""), (None, "1.2.3.4 " * 3000)]
    return [*rows, rows[0]]


def test_terms_that_reveal(make_docs):
    docs = make_docs(corpus())
    for limit in (pii.LIMIT, 0):  # held by the tasks, or joined
        terms = {r.term: r for r in pii.revealing_terms(docs, limit=limit).collect()}
        assert set(terms) == {"zorblax"} and terms["zorblax"].entity == "email:zed@corp.example"
        rows = pii.find(docs, clean=True, limit=limit).collect()
        assert len(rows) == docs.count()
        by = {r.doc_id: r for r in rows}
        assert by[900].spans == "remove:4:11" and by[900].clean_text == "the  stands alone"
        assert by[0].base == "email:37:53" and by[0].spans.startswith("remove:28:35,email")
        assert "zed@" not in by[0].clean_text and "[EMAIL]" in by[0].clean_text
        assert by[100].spans == by[901].spans == by[902].spans == ""
        assert by[None].n_ip == 3000


def test_words_near_are_whole():
    blob = "x" * 5000
    text = f"far Quibble, {blob} b c d e (zed@corp.example); f {blob} g h Nearby i end"
    ((entity, terms, _),) = pii.surroundings(text, pii.base_spans(text))
    assert entity == "email:zed@corp.example" and terms == ["quibble", blob, blob, "nearby"]
    text = "Quibble: " + "a@b.example," * 20_000 + blob
    assert len(list(pii.surroundings(text, pii.base_spans(text)))) == 20_000


def test_copies_are_no_evidence(make_docs):
    text = "one two three Quibble q@q.example four five six"
    assert pii.revealing_terms(make_docs([(i, text) for i in range(30)])).count() == 0


def test_copies_hide_no_term(make_docs):
    rows = corpus()
    rows += [(2000 + i, f"other{i} words{i} stand{i} here{i}") for i in range(150)]
    want = None
    for copies in (0, 1000):
        docs = make_docs(rows + [(5000 + i, rows[0][1]) for i in range(copies)])
        for limit in (pii.LIMIT, 0):  # digests of copies held by the tasks, or texts collapsed
            terms = [tuple(r) for r in pii.revealing_terms(docs, limit=limit).drop("bits").collect()]
            want = want or terms
            assert terms == want == [("zorblax", "email:zed@corp.example", 12 / 13, "remove")]


def test_empty(make_docs):
    assert pii.find(make_docs([])).count() == 0
