import random

import pytest

from kindred.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def expected(pairs, least_chars=40, least_docs=5):
    split = [(i, (t or "").split("\n")) for i, t in pairs]
    held = {}
    for i, lines in split:
        for line in lines:
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= least_chars:
                held.setdefault(key, set()).add(i)
    least_first = lambda i: (i is not None, i or 0)
    keeper = {k: max(ids, key=least_first) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for i, lines in split:
        kept = [x for x in lines if keeper.get(x.strip(BLANKS).translate(LOWER), i) == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def found(docs, **options):
    out = line_dedup.drop_lines(docs, **options)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def corpus(n, seed=2):
    rng = random.Random(seed)
    shared = [f"  Shared Line {i} é𝄞 of the Corpus, Long Enough to count\t" for i in range(12)]
    other = [s.upper().strip() if "é" not in s else s.replace("Shared", "SHARED").strip() for s in shared]
    short = ["short", "", "x" * 39, "y" * 40]
    pairs = []
    for i in range(n):
        lines = rng.choices(shared + other + short + [f"own line {i} " * 5], k=rng.randint(0, 9))
        pairs.append((rng.choice([i, i, i, None]), "\n".join(lines)))
    return pairs


@pytest.mark.parametrize("batches, fan_out", [(1, 2), (5, 2)])
def test_equals_plain_count(spark, make_docs, batches, fan_out):
    pairs = corpus(60)
    assert found(make_docs(pairs).repartition(3), batches=batches, fan_out=fan_out) == expected(pairs)


def test_odd_rows(spark, make_docs):
    line = "a line that stands in many documents, again and again"
    pairs = [(7, line)] * 40  # one document, however often it is repeated
    pairs += [(i, f"{line}\r\n\n{line.upper()}") for i in range(1, 4)]
    assert found(make_docs(pairs)) == expected(pairs)
    pairs += [(None, line), (None, None), (90, ""), (91, "\n"), (92, "w " * 50_000 + "\n" + line)]
    assert found(make_docs(pairs)) == expected(pairs)
    assert found(make_docs([])) == []


def test_runs(spark):
    """Hashes stand in one run each; levels are merged when they are full."""
    runs = line_dedup.LineRuns(spark, fan_out=2)
    sizes = []
    for batch in range(5):
        rows = [(h, -h, 100 - batch) for h in range(batch * 3, batch * 3 + 5)]
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, doc long"))
        sizes.append([len(level) for level in runs.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    rows = [r for level in runs.levels for name in level for r in spark.table(name).collect()]
    assert sorted(r.h1 for r in rows) == list(range(17))
    assert {r.h1: (r.keeper, r.n) for r in runs.frequent(2).collect()} == {
        3 * b + d: (100 - b + 1, 2) for b in range(1, 5) for d in (0, 1)
    }
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_native_plan(spark, make_docs):
    plan = line_dedup.drop_lines(make_docs(corpus(5)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
