"""Listing, reading and watching a vault."""

import random
import time

import pytest

from notewright.config import Config
from notewright.plans.ingest import Indexer
from notewright.sources import files, vault
from notewright.sources.files import Tree, can_list
from notewright.sources.vault import list_vault, read_paths, read_vault
from notewright.streaming.watch import Changes, debounce_stream, watch_events


@pytest.fixture
def tree(tmp_path):
    r, root = random.Random(1), tmp_path / "vault"
    folders = [root]
    for i in range(60):
        folders.append(r.choice(folders) / r.choice([f"f{i}", f".h{i}", f"_u{i}", f"é {i}"]))
        folders[-1].mkdir(parents=True)
    for i in range(300):
        (r.choice(folders) / f"{r.choice(['', '.', '_'])}n{i}.{r.choice(['md', 'md', 'MD', 'txt'])}").write_text(f"text {i}\r\nend")
    (root / "folder.md").mkdir()
    (root / "link.md").symlink_to(next(root.rglob("*.md")))
    (root / "loop").symlink_to(root)
    return root


def names(root):
    return sorted(str(p) for p in root.rglob("*.md") if p.is_file())


def test_tasks_list_all_folders(spark, tree, monkeypatch):
    for entries in (20_000, 7):  # in one round, and in many
        monkeypatch.setattr(vault, "ENTRIES", entries)
        rows = list_vault(spark, str(tree), hidden=True).collect()
        assert sorted(r.source for r in rows) == names(tree) and all(r.size == len(b"text 1\r\nend") + len(r.source) * 0 or r.size > 0 for r in rows)
        shown = [n for n in names(tree) if not any(p[0] in "._" for p in n.removeprefix(str(tree)).split("/")[1:])]
        assert sorted(r.source for r in list_vault(spark, str(tree)).collect()) == shown
    empty = tree.parent / "empty"
    empty.mkdir()
    assert list_vault(spark, str(empty), True).collect() == [] and list_vault(spark, str(tree.parent / "none"), True).collect() == []


def test_files_are_read_in_small_batches(spark, tree, monkeypatch):
    plain = {r.source: r.content for r in read_vault(spark, str(tree), hidden=True).collect()}
    assert sorted(plain) == names(tree) and set(x[-4:] for x in plain.values()) == {"\nend"}
    monkeypatch.setattr(vault, "TASK_BYTES", 50)
    assert {r.source: r.content for r in read_vault(spark, str(tree), hidden=True).collect()} == plain
    some = names(tree)[:3]
    assert sorted(r.source for r in read_paths(spark, str(tree), [*some, str(tree / "lost.md")]).collect()) == some


def test_a_vault_by_uri(spark, tree, tmp_path, monkeypatch):
    """As with a remote root: everything goes through Arrow's file systems. Files and hidden names are the same."""
    monkeypatch.setattr(files, "is_local", lambda root: False)
    uri = f"file://{tree}"
    found = Tree(uri)
    (tree / "loop").unlink()
    assert sorted(s for s, *_ in found.markdown([found.root], True)) == [f"file://{n}" for n in names(tree)]
    some = next(s for s, *_ in found.markdown([found.root], True))
    assert found.read(some).endswith(b"end")
    assert not can_list("nosuchscheme://a/b")
    reader = Changes({"path": uri, "hidden": "true", "gap": "0", "exclude": "[]", "state": f"file://{tmp_path}/listings"})
    start = reader.initialOffset()
    end = reader.latestOffset()
    assert sorted(s for p in reader.partitions(start, end) for s, *_ in reader.read(p)) == [f"file://{n}" for n in names(tree)]
    assert reader.latestOffset() == end


def events(reader, start, end):
    return sorted((s.rsplit("/", 1)[1], kind) for p in reader.partitions(start, end) for s, kind, _ in reader.read(p))


def test_offsets_are_stored_listings(tmp_path):
    root = tmp_path / "vault"
    (root / ".git").mkdir(parents=True)
    (root / ".git" / "b.md").write_text("excluded")
    (root / "a.md").write_text("1")
    given = {"path": str(root), "hidden": "true", "gap": "300000", "exclude": '[".git"]', "state": str(tmp_path / "listings")}
    reader = Changes(given)
    zero, one = reader.initialOffset(), reader.latestOffset()
    assert events(reader, zero, one) == [("a.md", "created")] and reader.latestOffset() == one
    (root / "a.md").write_text("22")
    assert reader.latestOffset() == one  # within the gap: held
    time.sleep(0.35)
    two = reader.latestOffset()
    assert events(reader, one, two) == [("a.md", "modified")]
    (root / "c.md").write_text("3")
    again = Changes(given)  # after a restart: what has changed since alone, and the same batch as before
    three = again.latestOffset()
    assert events(again, two, three) == [("c.md", "created")] and events(again, one, two) == [("a.md", "modified")]
    again.commit(two)
    assert events(again, two, three) == [("c.md", "created")] and len(again._names()) == 2
    (root / "a.md").unlink()
    four = again.latestOffset()
    assert four != three and events(again, three, four) == []
    (root / "a.md").write_text("back")
    assert events(again, four, again.latestOffset()) == [("a.md", "created")]


def test_a_restarted_watch_tells_of_changes_only(spark, tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    for i in range(5):
        (root / f"{i}.md").write_text(f"{i}")
    config, told = Config(debounce_seconds=0), []

    def run(n):
        batches = watch_events(spark, str(root), str(tmp_path / "listings"), config).writeStream.foreachBatch(lambda b, _: told.extend(sorted(r.source.rsplit("/", 1)[1] for r in b.collect())))
        query, end = batches.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="300 milliseconds").start(), time.time() + 40
        try:
            while len(told) < n and time.time() < end:
                assert query.exception() is None
                time.sleep(0.3)
            time.sleep(1)
        finally:
            query.stop()

    run(5)
    assert told == [f"{i}.md" for i in range(5)]
    (root / "3.md").write_text("edited")
    (root / "new.md").write_text("new")
    run(7)
    assert told[5:] == ["3.md", "new.md"]


def test_states_expire(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def put(n, rows):
        spark.createDataFrame(rows, "source string, kind string, micros long").coalesce(1).write.mode("append").parquet(str(source))

    put(0, [(f"s{i}", "modified", 1_000_000) for i in range(50)])
    rows = spark.readStream.schema("source string, kind string, micros long").parquet(str(source))
    query = debounce_stream(rows, 1, late_seconds=1).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()

    def until(wanted):
        end, n = time.time() + 50, -1
        while time.time() < end and not wanted(n):
            assert query.exception() is None
            time.sleep(0.5)
            n = sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) if query.lastProgress else -1
        assert wanted(n)

    try:
        until(lambda n: n >= 50)
        put(1, [("other", "modified", int(time.time() * 1e6))])
        until(lambda n: 0 <= n < 20)
    finally:
        query.stop()


def test_a_run_reads_changed_files_alone_again(spark, tree, tmp_path):
    indexer = Indexer(spark, Config(vault_root=str(tree), store_path=str(tmp_path / "store"), hidden=True))
    n = indexer.index_vault()
    assert n == len(names(tree))
    some = next(p for p in tree.rglob("*.md") if p.is_file() and not p.is_symlink() and p.resolve() != (tree / "link.md").resolve())
    some.write_text("only this")
    assert indexer.index_vault() == 1 and indexer.store.texts().where("text = 'only this'").count() == 1
