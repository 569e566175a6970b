"""The layered store: what it writes, reads and counts, against the same rows in plain Python."""

import random

import numpy as np
import pytest

from notewright.config import Config
from notewright.operators import stats
from notewright.operators.pivots import Cell, cells_of, choose_pivots, least_distance, search_cells, with_cell
from notewright.operators.search import nearest
from notewright.plans.ingest import Indexer
from notewright.sources import store as S
from notewright.sources.store import bucket_of


def frame(spark, files):
    return spark.createDataFrame(sorted(files.items()), "source string, content string")


def size(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


@pytest.fixture
def indexer(spark, tmp_path):
    return Indexer(spark, Config(store_path=str(tmp_path / "store"), max_backups=1))


def truth(indexer):
    """Totals as the chunks themselves have them."""
    row = stats.totals(indexer.store.texts()).first()
    top = [(r.source, r.chunks) for r in stats.top_files(indexer.store.texts()).collect()]
    return {"total_chunks": row.total_chunks, "unique_files": row.unique_files}, top


def test_a_small_run_writes_its_own_chunks_alone(spark, indexer, tmp_path):
    files = {f"/v/{i}.md": f"note {i} " * 40 for i in range(4000)}
    indexer.index_frame(frame(spark, files))
    first = size(tmp_path / "store" / indexer.store.current())
    run = indexer.index_frame(frame(spark, {f"/v/{i}.md": f"other {i} " * 40 for i in range(0, 4000, 80)}))
    assert run.chunks == 50 and size(tmp_path / "store" / run.version) < first / 20
    assert len(indexer.store.manifest()["layers"]) == 2
    assert indexer.store.texts().count() == 4000 == indexer.store.vectors().count() == indexer.store.hashes().count()
    assert indexer.store.texts().where("text like 'other%'").count() == 50


def test_runs_against_plain_rows(spark, indexer, monkeypatch):
    """Upserts, deletes, failures, compactions and restores, with totals and top files equal to a scan after each."""
    monkeypatch.setattr(S, "LAYERS", 4)
    monkeypatch.setattr(S, "LISTED", 18)
    r, now = random.Random(2), {}
    for turn in range(9):
        batch = {f"/v/{r.randrange(60)}.md": "\n## ".join(f"part {r.random()}" for _ in range(r.randint(1, 9))) for _ in range(45 if turn == 0 else 12)}
        now |= batch
        if turn % 3 == 2:
            for s in r.sample(sorted(now), 6):
                del now[s]
            indexer._apply(indexer_files(indexer, spark, now), whole=True)
        else:
            indexer.index_frame(frame(spark, batch))
        got = {}
        for row in indexer.store.chunks().collect():
            got.setdefault(row.source, {})[row.section] = row.text
        want = {s: {i: (p if i == 0 else "## " + p) for i, p in enumerate(c.split("\n## "))} for s, c in now.items()}
        assert got == want
        assert {x.source for x in indexer.store.hashes().collect()} == set(now)
        plain, top = truth(indexer)
        assert indexer.stats() == plain and indexer.store.top() == top
        assert len(indexer.store.manifest()["layers"]) <= S.LAYERS
        some = r.choice(sorted(now))
        assert {x.section for x in indexer.store.chunks_of(some).collect()} == set(want[some])
        hits = indexer.search_frame("part 0.5", 7).collect()
        assert len(hits) == 7 and all(now[h.source] for h in hits)
    before = indexer.store.versions()[0]
    indexer.store.restore(before)
    assert indexer.stats() == truth(indexer)[0]
    indexer.store.compact()
    assert len(indexer.store.manifest()["layers"]) == 1 and indexer.stats() == truth(indexer)[0]


def indexer_files(indexer, spark, now):
    from notewright.operators.changes import with_hash

    return with_hash(frame(spark, now))


def test_failed_files_keep_chunks_and_go_when_they_are_deleted(spark, indexer):
    indexer.index_frame(frame(spark, {"/v/a.md": "one", "/v/b.md": "two"}))
    embed = indexer.embedder.embed
    indexer.embedder.embed = lambda texts: [[] if "bad" in t else v for t, v in zip(texts, embed(texts))]
    run = indexer.index_frame(frame(spark, {"/v/a.md": "bad", "/v/b.md": "two more"}))
    assert (run.chunks, run.failed) == (1, 1)
    assert sorted(r.text for r in indexer.store.texts().collect()) == ["one", "two more"]
    assert [r.source for r in indexer.store.hashes().collect()] == ["/v/b.md"] and indexer.stats() == truth(indexer)[0]
    indexer._apply(indexer_files(indexer, spark, {"/v/b.md": "two more"}), whole=True)
    assert [r.text for r in indexer.store.texts().collect()] == ["two more"] and indexer.stats() == truth(indexer)[0]


def test_chunks_of_a_source_are_one_file(spark, indexer, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 40)
    indexer.index_frame(frame(spark, {f"/v/{i}.md": f"text {i}" for i in range(600)}))
    found = indexer.store.chunks_of("/v/7.md")
    assert len(found.inputFiles()) == 1 and [r.text for r in found.collect()] == ["text 7"]
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,/v/7.md)" in found._jdf.queryExecution().executedPlan().toString()
    assert len(indexer.store.texts().inputFiles()) > 10
    assert indexer.store.chunks_of("nobody").collect() == []


def test_totals_read_no_chunks(spark, indexer, tmp_path):
    indexer.index_frame(frame(spark, {"/v/a.md": "one", "/v/b.md": "two\n## three"}))
    for p in (tmp_path / "store").rglob("*.parquet"):
        p.unlink()
    assert indexer.stats() == {"total_chunks": 3, "unique_files": 2} and indexer.store.top() == [("/v/b.md", 2), ("/v/a.md", 1)]


def test_the_pointer_is_never_missing(spark, indexer, monkeypatch):
    """A run that dies before the pointer moves leaves the version that was restored."""
    indexer.index_frame(frame(spark, {"/v/a.md": "one"}))
    old = indexer.store.current()
    indexer.index_frame(frame(spark, {"/v/a.md": "two"}))
    indexer.store.restore(old)

    def dies(*_):
        raise OSError

    monkeypatch.setattr(indexer.store, "_move", dies)
    with pytest.raises(OSError):
        indexer.index_frame(frame(spark, {"/v/a.md": "three"}))
    assert indexer.store.current() == old and [r.text for r in indexer.store.texts().collect()] == ["one"]


def test_buckets_without_a_job(spark):
    from pyspark.sql import functions as F

    names = ["", "/v/é.md", "/v/a b.md", "x" * 300]
    rows = spark.createDataFrame([(n,) for n in names], "source string").select("source", S._bucket(F.col("source"), 37).alias("b")).collect()
    assert all(r.b == bucket_of(r.source, 37) for r in rows)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_search_leaves_cells_unread_and_loses_nothing(spark, metric):
    r = np.random.RandomState(5)
    centres = r.randn(12, 8) * 4
    x = (centres[r.randint(0, 12, 1500)] + r.randn(1500, 8) * 0.3).astype(np.float32)
    x[700:710] = x[:10]
    x[5] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(3)
    pivots = choose_pivots(rows)
    placed = with_cell(rows, pivots).cache()
    cells = cells_of(placed, pivots)
    assert sum(c.rows for c in cells) == 1500 and [Cell.of(c.as_list()) for c in cells] == cells
    seen = []
    for q in [x[3], x[5], centres[0], r.randn(8) * 9, r.randn(8) * 0.01]:
        hits, n = search_cells(cells, lambda some: placed.where(placed.cell.isin([int(c.name) for c in some])), pivots, list(map(float, q)), 6, metric, ["id"])
        want = nearest(rows, [(0, list(map(float, q)))], 6, metric, ["id"]).orderBy("rank").collect()
        assert [h.id for h in hits] == [w.id for w in want]
        assert np.allclose([h.distance for h in hits], [w.distance for w in want])
        seen.append(n)
    assert metric == "dot" or min(seen) <= len(cells) // 3
    for c in cells:
        own = np.array([v.vector for v in placed.where(f"cell = {c.name}").collect()], float)
        for q in x[[1, 50, 900]].astype(float):
            d = {"l2": ((own - q) ** 2).sum(1), "dot": 1 - own @ q, "cosine": 1 - own @ q / np.maximum(np.linalg.norm(own, axis=1) * np.linalg.norm(q), 1e-300)}[metric]
            assert least_distance(c, np.array(pivots), q, metric) <= d.min()
    placed.unpersist()
