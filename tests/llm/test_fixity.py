import hashlib

from pyspark.sql import functions as F

from kindred.llm import fixity


def pages(spark, rows):
    rows = [(i, u, h, "x", 3) for i, u, h in rows]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string, slot long")


def found(a, b):
    return found_in(fixity.manifest(a), fixity.manifest(b))


def found_in(a, b):
    rows = fixity.audit(a, b).collect()
    return sorted(((r.page_id, r.side, r.status, r.offset, r.length) for r in rows), key=str)


def moved(rows, after, shift):
    """What a change of ``shift`` bytes before the records ``after`` moves."""
    first = after[0]
    start = sum(len(record(*r)) for r in rows if r[0] // 1024 == first[0] // 1024 and r[0] < first[0])
    return (first[0], "a", "moved", start, sum(len(record(*r)) for r in after))


def record(i, u, h):
    body = h.encode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {u}\r\n"
    return head.encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_damage_is_located(spark):
    rows = [(i, f"http://h/{i}", f"é{i}" * (i % 7)) for i in range(-40, 3000)]
    damaged = [(i, u, h + "!" if i == 70 else h) for i, u, h in rows if i != 1500] + [(9000, "u", "h")]
    a, b = pages(spark, rows), pages(spark, damaged)
    assert found(a, a.repartition(3)) == []
    offset = lambda data, i: sum(len(record(*r)) for r in data if r[0] // 1024 == i // 1024 and r[0] < i)
    size = lambda data, i: next(len(record(*r)) for r in data if r[0] == i)
    assert found(a, b) == sorted(
        [(70, "a", "corrupt", offset(rows, 70), size(rows, 70)),
        (70, "b", "corrupt", offset(damaged, 70), size(damaged, 70)),
        (1500, "a", "missing", offset(rows, 1500), size(rows, 1500)),
        (9000, "b", "extra", 0, size(damaged, 9000)),
        moved(rows, [r for r in rows if 70 < r[0] < 1024], 1),
        moved(rows, [r for r in rows if 1500 < r[0] < 2048], -size(rows, 1500))],
        key=str,
    )
    digest = fixity.manifest(a).filter("page_id = 70").first().sha256
    assert digest == hashlib.sha256(record(*rows[110])).hexdigest()


def test_tree(spark, monkeypatch):
    monkeypatch.setattr(fixity, "RANGE_BYTES", 1 << 10)
    rows = [(i, "u" * (i % 11), "h" * (i % 90)) for i in range(5000)]
    whole = fixity.manifest(pages(spark, rows)).withColumn("side", F.lit("a"))
    levels = [level for level, _ in fixity.tree(whole)]
    place, ranges = {}, {}
    for r in sorted(rows):
        data, archive = record(*r), r[0] // 1024
        start = place.get(archive, 0)
        place[archive] = start + len(data)
        said = f"{start}:{len(data)}:1:{hashlib.sha256(data).hexdigest()}"
        ranges.setdefault((archive, start >> 10), []).append(said)
    digest = lambda parts: hashlib.sha256(",".join(parts).encode()).hexdigest()
    nodes = {key: digest(said) for key, said in ranges.items()}
    for step, level in enumerate(levels):
        assert {(r.archive, r.node): r.a for r in level.collect()} == nodes, step
        deep, up = max(n for _, n in nodes), {}
        for (archive, node), own in sorted(nodes.items()):
            parent = (archive, node >> 4) if deep else (archive >> 4, node)
            up.setdefault(parent, []).append(f"{archive}:{node}:{own}")
        nodes = {key: digest(said) for key, said in up.items()}
    assert len(levels) == 4 and levels[-1].count() == 1


def test_another_layout(spark):
    a = fixity.manifest(pages(spark, [(i, "u", "h") for i in range(30)]))
    size = a.first().length
    turned = a.withColumn("offset", F.lit(29 * size) - F.col("offset"))
    seen = {(r.status, r.records, r["shift"]) for r in fixity.audit(a, turned).collect()}
    sizes = {r.page_id: r.length for r in a.collect()}
    assert sum(n for _, n, _ in seen) == sum(1 for i in sizes) - sum(1 for r in a.collect() if 2 * r.offset == 29 * size)
    assert {s for s, _, _ in seen} == {"moved"}
    # records of equal lengths that change places leave the ranges' starts as they are
    swapped = a.withColumn("offset", F.when(F.col("offset") == 0, 4 * size).when(
        F.col("offset") == 4 * size, 0).otherwise(F.col("offset")).cast("long"))
    assert found_in(a, swapped) == [
        (i, "a", "moved", o, size) for i, o in ((0, 0), (4, 4 * size))
    ]


def test_many_records_of_one_id(spark):
    rows = [(7, f"u{i}", "h") for i in range(3000)] + [(8, "v", "w")]
    whole = fixity.manifest(pages(spark, rows)).orderBy("offset").collect()
    assert [r.sha256 for r in whole[:-1]] == sorted(r.sha256 for r in whole if r.page_id == 7)
    assert all(x.offset + x.length == y.offset for x, y in zip(whole, whole[1:], strict=False))
    assert whole[0].offset == 0 and whole[-1].page_id == 8
    lost = {r.status: r.records for r in fixity.audit(
        fixity.manifest(pages(spark, rows)), fixity.manifest(pages(spark, rows[1:]))).collect()}
    assert lost["missing"] == 1 and set(lost) == {"missing", "moved"}


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "u", "x"), (1, None, ""), (1, "u", None), (1, "u", None)]
    a = pages(spark, rows)
    assert found(a, a) == []
    damage = lambda b: [r[:3] for r in found(a, b) if r[2] != "moved"]
    assert damage(pages(spark, rows[1:])) == [(None, "a", "missing")]
    assert damage(pages(spark, rows[:4])) == [(1, "a", "corrupt"), (1, "b", "corrupt")]
    nothing = pages(spark, [])
    assert found(nothing, nothing) == []
    assert len(found(a, nothing)) == 4
    assert found(pages(spark, [(5, "u", "v")] * 400), pages(spark, [(5, "u", "v")] * 400)) == []
