import random
import re

from kindred.llm import secrets

ASSIGN = re.compile(
    r"""(?a)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")


def plain(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


PARTS = ["token", "PassWord", "secret", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "abc", "AKIA", "AKIA0123456789AB",
         "0123456789abcdef" * 2, "a", "é", "𝄞", "\n", "=" * 8, "X.Y-Z/+", "12345678", "AKIAAKIA", "ſecret=abcdefgh"]
KEY = "aB3dE5fG7hI9jK1lM3nO5pQ7"


def test_base_spans(make_docs):
    rng = random.Random(4)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(600)]
    texts += ["token=abcdefgh1 " * 4000, "", None]
    docs = make_docs([*enumerate(texts), (None, texts[0]), (0, texts[0]), (0, texts[0])])
    rows = secrets.scan(docs).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        want = plain((texts[r.doc_id] if r.doc_id is not None else texts[0]) or "")
        assert r.base == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            sum(s.startswith(k) for s in want.split(",")) for k in ("assign", "access", "hex")
        )


def test_links(make_docs):
    texts = [
        f"nothing but {KEY} here",
        f"user: bob\nthen {KEY} end",
        f"user: bob\n\n{KEY} in another scope",
        f"user: bob {'x ' * 200}{KEY} out of reach",
        f"see https://host.example/a and user=bob with {KEY}.",
        "see https://host.example/a and user=bob",
        f"AKIA0123456789ABCD {KEY}",
        f"token={KEY} user=bob",
    ]
    got = {r.doc_id: r.spans for r in secrets.scan(make_docs(enumerate(texts))).collect()}
    at = lambda n, part, kind: f"{kind}:{texts[n].index(part)}:{texts[n].index(part) + len(part)}"
    assert got[0] == got[2] == got[3] == got[5] == ""
    assert got[1] == at(1, KEY, "random")
    assert got[4].split(",") == [
        at(4, "https://host.example/a", "endpoint"),
        at(4, "user=bob", "identity"),
        at(4, KEY, "random"),
    ]
    assert got[6] == ",".join([at(6, "AKIA0123456789ABCD", "access"), at(6, KEY, "random")])
    assert got[7] == at(7, f"token={KEY}", "assign")


def pairwise(text):
    """Base spans, and weak parts by looking at every pair of parts of the text."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    for kind, pattern in enumerate(secrets.PARTS.values(), 3):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.ASCII)]
    cuts = [m.start() for m in re.finditer(secrets.BREAK, text)]
    scope = lambda p: sum(c < p[0] for c in cuts)
    distance = lambda p, q: max(q[0] - p[2], p[0] - q[2])

    def near(p, kinds):
        return any(
            q is not p and q[1] in kinds and scope(p) == scope(q) and distance(p, q) <= secrets.REACH
            for q in found
        )

    secret, name, place = (0, 2, 3), (1, 4), (5,)
    needs = {3: (name,), 4: (secret, place), 5: (secret, name)}
    told = []
    for p in found:
        inside = any(q is not p and q[1] < 3 and q[0] < p[2] and p[0] < q[2] for q in found)
        if p[1] < 3 or not inside and all(near(p, kinds) for kinds in needs[p[1]]):
            told.append(p)
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(told))


def test_links_of_nested_parts_equal_those_of_all_pairs(make_docs):
    rng = random.Random(7)
    inner = "0123456789abcdef" * 2
    long = f"password={inner}." + "z" * 400
    texts = [long + " " * 100 + "user=alice https://h.example/x"]
    texts += ["https://h.example/x user=alice " + " " * 250 + long]
    pieces = [long, f"token={inner}", KEY, "user=bob", "https://h.example/" + "p" * 320, "https://a.example/b",
              f"https://u.example/user=carl&key={inner}", "AKIA0123456789ABCD", "\n\n", "\n \n", inner, "y " * 60, "y " * 140]
    texts += [" ".join(rng.choices(pieces, k=rng.randint(2, 9))) for _ in range(400)]
    got = {r.doc_id: r.spans for r in secrets.scan(make_docs(enumerate(texts))).collect()}
    assert got == {i: pairwise(t) for i, t in enumerate(texts)}
    assert "identity" in got[0] and "endpoint" in got[0] and "identity" in got[1] and "endpoint" in got[1]


def test_redact(make_docs):
    docs = make_docs([(1, "é token=abcdefgh12 x"), (1, "plain"), (2, None), (None, "secret: 12345678"), (1, "plain")])
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted(
        [(1, "é [SECRET] x"), (1, "plain"), (1, "plain"), (2, ""), (0, "[SECRET]")]
    )


def test_empty(make_docs):
    assert secrets.scan(make_docs([])).count() == 0
    assert secrets.redact(make_docs([])).count() == 0
