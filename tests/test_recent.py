"""The job over recent days: what it reads, what it keeps and what it reports."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.functions.vectors import mean_of
from kindred.operators import similar as S
from kindred.operators.tables import scan_recent_days
from kindred.plans import jobs

DAYS = [f"2024-01-{d:02d}" for d in range(1, 13)]
ROWS = "row_id long, spu_sn string, area_id int, lv int, dt string, vec array<double>"
NAMES = dict(area="area_id", item="spu_sn", category="lv", row_id="row_id", vec="vec")


def rows_of(days, seed=4, each=14):
    rng = np.random.default_rng(seed)
    out = []
    for d in days:
        for _ in range(each):
            vec = [float(x) for x in rng.integers(-3, 4, 3)]  # few values, so that many scores are equal
            n = len(out)
            out.append((n, f"s{rng.integers(40)}", int(rng.integers(2)), int(rng.integers(2)), d, vec))
    return out


def brute(rows, day, share, cap, least):
    unit = [np.array(r[5]) / (np.linalg.norm(r[5]) or 1) for r in rows]
    key = np.rint(np.array(unit) @ np.array(unit).T * 1e9)
    out = set()
    for area in (0, 1):
        own = [i for i, r in enumerate(rows) if r[2] == area]
        latest = {}
        for i in own:
            latest[rows[i][1]] = max(latest.get(rows[i][1], i), i, key=lambda n: (rows[n][4], rows[n][0]))
        for q in latest.values():
            order = sorted((c for c in own if c != q), key=lambda c: (-key[q, c], rows[c][0]))
            listed = []
            for c in order[: max(1, len(own) // share) - 1]:
                fits = rows[c][4] == day and rows[c][3] == rows[q][3] and rows[c][1] != rows[q][1]
                if fits and key[q, c] > least * 1e9 and rows[c][1] not in listed and len(listed) < cap:
                    listed.append(rows[c][1])
                    out.add((rows[q][0], rows[c][0]))
    return out


def found(spark, rows, day, state=None, block_rows=9):
    df = spark.createDataFrame(rows, ROWS)
    got = S.similar_recent(
        df, target_day=day, share=3, min_score=-0.6, cap=8, state=state, block_rows=block_rows, **NAMES
    )
    return {(r.q_row, r.c_row) for r in got.collect()}


def test_share_of_equal_scores(spark):
    rows = rows_of(DAYS[:5])
    assert found(spark, rows, DAYS[4]) == brute(rows, DAYS[4], 3, 8, -0.6)


def test_state_keeps_scored_days(spark, tmp_path):
    """A second day counts its own rows for all vectors, and earlier days for new vectors only."""
    state = str(tmp_path / "state")
    rows = rows_of(DAYS[:6])
    first = [r for r in rows if r[4] <= DAYS[4]]
    assert found(spark, first, DAYS[4], state) == brute(first, DAYS[4], 3, 8, -0.6)
    pairs = ["area_id", "_f1", "_f2", "dt"]
    before = spark.read.parquet(state).select(*pairs)
    files = set(before.inputFiles())
    n_before = before.count()
    assert found(spark, rows, DAYS[5], state) == brute(rows, DAYS[5], 3, 8, -0.6)
    after = spark.read.parquet(state)
    assert files < set(after.inputFiles())
    fresh = spark.read.option("basePath", state).parquet(*(set(after.inputFiles()) - files)).select(*pairs)
    assert fresh.join(before, pairs, "left_semi").count() == 0  # no tile is scored again
    known = before.select(*pairs[:3]).distinct()
    old = fresh.where(F.col("dt") < DAYS[5])
    assert old.join(known, pairs[:3], "left_semi").count() == 0
    assert n_before + fresh.count() == after.count()


def test_changed_day_is_counted_again(spark, tmp_path):
    state = str(tmp_path / "state")
    rows = rows_of(DAYS[:4])
    found(spark, rows, DAYS[3], state)
    changed = [(*r[:5], [1.0, 0.0, 0.0]) if r[4] == DAYS[1] else r for r in rows]
    assert found(spark, changed, DAYS[3], state) == brute(changed, DAYS[3], 3, 8, -0.6)


def test_only_wanted_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "days")
    df = spark.createDataFrame(rows_of(DAYS), ROWS)
    df.repartition("dt").write.partitionBy("dt").parquet(path)
    recent = scan_recent_days(spark.read.schema(df.schema).parquet(path), DAYS[9], 3)
    for old in DAYS[:6]:  # files that would stop any job that reads them
        for file in (tmp_path / "days" / f"dt={old}").glob("*.parquet"):
            file.write_bytes(b"no parquet file")
    read = recent.select("dt", "vec").collect()
    assert {r.dt for r in read} == set(DAYS[6:])  # there is no upper bound
    with pytest.raises(Exception):
        scan_recent_days(spark.read.schema(df.schema).parquet(path), DAYS[8], 3).select("vec").collect()


def test_job_reports_what_it_cannot_search(spark, tmp_path):
    product = (
        "row_id long, spu_sn string, sku string, area_id int, first_level_category_name string, "
        "second_level_category_name string, product_name string, product_title string, "
        "first_level_category_id string, second_level_category_id string, dt string"
    )
    day = DAYS[8]
    rows = [(i, f"s{i}", f"{i}", 1, "a", "b", "name", f"w{i % 3}", "c1", "c2", day) for i in range(30)]
    rows += [
        (100, "s100", "100", None, "a", "b", "name", "w1", "c1", "c2", day),
        (101, "s101", "101", 1, "a", "b", "name", "w1", None, None, day),
        (102, "s102", "102", 1, None, None, None, None, "c1", "c2", day),
        (103, "s103", "103", 1, "a", "b", "name", "w1", "c1", "c2", DAYS[0]),
        (104, "s104", "", 1, "a", "b", "name", "w1", "c1", "c2", day),
    ]
    images = [(r[1], 0, 0, [1.0, float(r[0] % 5)]) for r in rows if r[0] != 5]
    images += [("s6", 1, 1, [1.0]), ("s7", 1, 1, [None, 2.0])]
    words = [(w, [float(n), 1.0]) for n, w in enumerate(["a", "b", "name", "w", "w1"])]
    lists, errors = jobs.similar_items_of_days(
        spark.createDataFrame(rows, product),
        spark.createDataFrame(images, "spu_sn string, n int, image_id int, vec array<double>"),
        spark.createDataFrame(words, "word string, vec array<double>"),
        day,
        share=3,
        dims=2,
        state=str(tmp_path / "state"),
    )
    assert {(r.row_id, r.error) for r in errors.collect()} == {
        (5, "no image"),
        (6, "no image"),  # images of unequal length
        (7, "no image"),  # an image with a gap
        (100, "no area_id"),
        (101, "no first_level_category_id, no second_level_category_id"),
        (102, "no known word in the title"),
    }
    listed = {r.spu_sn: r.neighbours for r in lists.collect()}
    assert listed and not {"s100", "s103", "s104"} & set(listed)
    assert all(len(n) == len(set(n)) and k not in n for k, n in listed.items())


@pytest.mark.parametrize(
    "vectors, want",
    [([[1.0, 2.0], [3.0, 4.0]], [2.0, 3.0]), ([[1.0], [3.0, 4.0]], None), ([[1.0, None]], None), ([], None)],
)
def test_mean_of_ragged_vectors(spark, vectors, want):
    df = spark.createDataFrame([(vectors,)], "v array<array<double>>")
    assert df.select(mean_of(F.col("v"))).first()[0] == want


@pytest.mark.parametrize("most", [1, 3, 400])
def test_histograms_put_each_score_in_its_bin(most):
    """Scores on the edges of bins, of vectors without direction and of rows that count several times."""
    rng = np.random.default_rng(6)

    def table(n):
        vec = [list(v) for v in rng.integers(-1, 2, (n, 4)) * 1.0]
        vec[0] = [float("nan")] * 4
        weight = rng.integers(1, most + 1, n)
        return pa.table({"k": np.arange(n), "vec": pa.array(vec, pa.list_(pa.float64())), "weight": weight})

    queries, rows = table(60), table(5000)
    got = np.array(S._histogram_task(["k"])(queries, rows).column("histogram").to_pylist())
    q, _ = S._unit_rows(queries.column("vec"))
    r, finite = S._unit_rows(rows.column("vec"))
    place = np.clip((S._rounded(q @ r.T) + S.SCORE_SCALE) // S.BIN_WIDTH, 0, S.BINS - 1).astype(int)
    weight = rows.column("weight").to_numpy() * finite
    for n in range(len(q)):
        assert (got[n] == np.bincount(place[n], weight, S.BINS)).all()


@pytest.mark.parametrize("most", [3, 300, 70_000, 2**40])
def test_packed_counts_are_the_counts(most):
    """Histograms of several widths in one column, also where it is cut."""
    rng = np.random.default_rng(7)
    parts = [rng.integers(0, n + 1, (5, S.BINS)) for n in (3, most, 255)]
    column = pa.chunked_array([S._packed(p) for p in parts])
    assert (S._unpacked(column) == np.concatenate(parts)).all()
    assert (S._unpacked(column.slice(4, 7)) == np.concatenate(parts)[4:11]).all()
    assert len(S._packed(parts[0])[0].as_py()) == S.BINS  # a byte a bin


def test_candidates_stay_lists_of_vectors(spark, tmp_path, monkeypatch):
    """What is written before the share is known has a row a vector, however many rows have it."""
    rows = rows_of(DAYS[:3])
    rows += [(10_000 + n, f"copy{n}", *rows[0][2:]) for n in range(20)]
    written = {}

    def noted(df, name, write=S.materialize):
        out = write(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(S, "materialize", noted)
    state = str(tmp_path / "state")
    got = found(spark, rows, DAYS[2], state, block_rows=8192)
    assert got == brute(rows, DAYS[2], 3, 8, -0.6)
    vectors = {(*r[2:4], tuple(r[5])) for r in rows if r[5] is not None}
    assert 0 < written["passing"] <= len(vectors) and 0 < written["share-held"] <= len(vectors)
    assert dict(spark.read.parquet(state).dtypes)["histogram"] == "binary"
