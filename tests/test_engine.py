"""Files, store, indexing, search, service and stream, end to end."""

import contextlib
import io
import json

import numpy as np
import pytest

from notewright.config import Config
from notewright.operators import folds
from notewright.operators.embedding import Breaker, HashedWords, embed_all
from notewright.operators.search import clamp, nearest
from notewright.plans.ingest import Indexer
from notewright.plans.service import Service
from notewright.sources.store import Store
from notewright.sources.vault import inside, read_vault


@pytest.fixture
def vault(tmp_path):
    root = tmp_path / "vault"
    (root / "a b").mkdir(parents=True)
    (root / ".github").mkdir()
    (root / "one.md").write_text("---\nt: 1\n---\nalpha beta\n## Two\ngamma", encoding="utf-8")
    (root / "a b" / "z é.md").write_bytes("gamma\r\ndelta".encode())
    (root / "n.MD").write_text("never")
    (root / "bad.md").write_bytes(b"\xff\xfe")
    (root / "_u.md").write_text("hidden")
    (root / ".github" / "x.md").write_text("excluded by a part of its path")
    (root / "blank.md").write_text(" \n")
    return root


@pytest.fixture
def indexer(spark, vault, tmp_path):
    return Indexer(spark, Config(vault_root=str(vault), store_path=str(tmp_path / "store")))


def test_scan(spark, vault):
    rows = {r.source: r for r in read_vault(spark, str(vault)).collect()}
    assert set(rows) == {str(vault / p) for p in ("one.md", "a b/z é.md", "bad.md", "blank.md")}
    assert rows[str(vault / "bad.md")].content is None
    assert rows[str(vault / "a b/z é.md")].content == "gamma\ndelta"
    assert {r.source for r in read_vault(spark, str(vault), hidden=True).collect()} > {str(vault / "_u.md"), str(vault / ".github/x.md")}


def test_inside(vault):
    assert inside(str(vault), "one.md") == str(vault / "one.md")
    assert inside("s3a://b/v/", "a/one.md") == "s3a://b/v/a/one.md" == inside("s3a://b/v", "s3a://b/v/a/one.md")
    for odd in ("../x", "s3a://b/vault/x", "s3a://other/v/x", "file:///etc/passwd"):
        with pytest.raises(PermissionError):
            inside("s3a://b/v", odd)
    with pytest.raises(PermissionError):
        inside(str(vault), "../x")


def test_index_is_incremental(spark, indexer, vault):
    assert indexer.index_vault() == 3
    version = indexer.store.current()
    assert indexer.index_vault() == 0 and indexer.store.current() == version
    (vault / "one.md").write_text("changed text")
    assert indexer.index_vault() == 1
    assert sorted(r.text for r in indexer.store.chunks().collect()) == ["changed text", "gamma\ndelta"]
    (vault / "a b" / "z é.md").unlink()
    indexer.index_vault()
    assert [r.text for r in indexer.store.chunks().collect()] == ["changed text"]
    assert indexer.store.hashes().count() == 1
    assert len(indexer.store.versions()) <= 1 + indexer.config.max_backups
    assert indexer.rebuild() == 1


def test_hidden_files_are_indexed_and_counted(spark, vault, tmp_path):
    (vault / "_drafts").mkdir()
    (vault / ".hid").mkdir()
    (vault / "_drafts" / "x.md").write_text("draft")
    (vault / ".hid" / "y.md").write_text("dot")
    environ = {"VAULT_ROOT": str(vault), "STORE_PATH": str(tmp_path / "store")}
    indexer = Indexer(spark, Config.from_environment(environ))
    assert indexer.index_vault() == 6
    assert {r.text for r in indexer.store.chunks().collect()} > {"hidden", "draft", "dot"}
    assert Service(indexer).index_stats()["total_md_files"] == len(list(vault.rglob("*.md")))
    (vault / "_u.md").write_text("edited")
    assert Service(indexer).reindex_file("_u.md")["indexed"] == 1
    assert not Config.from_environment(environ | {"HIDDEN": "0"}).hidden


def test_failed_files_are_tried_again(spark, vault, tmp_path):
    class Failing(HashedWords):
        def embed(self, texts):
            return [[] if "beta" in t else v for t, v in zip(texts, super().embed(texts))]

    config = Config(vault_root=str(vault), store_path=str(tmp_path / "store"))
    assert Indexer(spark, config, Failing()).index_vault() == 1
    assert Indexer(spark, config).index_vault() == 2


def test_store_survives_a_lost_pointer(spark, tmp_path, indexer):
    indexer.index_vault()
    (tmp_path / "store" / "CURRENT").unlink()
    assert Store(spark, str(tmp_path / "store")).chunks().count() == 3


def test_search(indexer):
    indexer.index_vault()
    hits = indexer.search("gamma delta", 2)
    assert hits[0]["text"] == "gamma\ndelta" or len(hits) == 2
    assert hits[0]["score"] <= hits[1]["score"]
    assert (clamp(0), clamp(99), clamp(3)) == (1, 20, 3)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_nearest_is_exact(spark, metric):
    r = np.random.RandomState(1)
    v = r.randn(300, 8).astype(np.float32)
    v[200:] = v[:100]  # ties
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>").repartition(5)
    q = v[7].astype(float)
    d = {"l2": ((v - q) ** 2).sum(1), "cosine": 1 - v @ q / np.linalg.norm(v.astype(float), axis=1) / np.linalg.norm(q), "dot": 1 - v.astype(float) @ q}[metric]
    expected = sorted(range(300), key=lambda i: (round(float(d[i]), 5), i))[:6]
    for queries in ([(0, q.tolist())], [(0, q.tolist()), (1, (-q).tolist())]):
        got = nearest(frame, queries, 6, metric, ["id"]).where("query_id = 0").orderBy("rank").collect()
        assert [x.id for x in got] == expected
        assert [x.distance for x in got] == sorted(x.distance for x in got)


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_breaker():
    clock = Clock()
    b = Breaker(2, 60, clock)
    b.record(False)
    b.record(True)
    b.record(False)
    assert not b.is_open()
    b.record(False)
    assert b.is_open()
    clock.now = 60
    assert not b.is_open() and b.failures == 0


def test_batches_split_on_timeout_and_stop_when_open():
    class Slow:
        calls = 0

        def embed(self, texts):
            self.calls += 1
            if len(texts) > 2 or "bad" in texts:
                raise TimeoutError
            return [[1.0]] * len(texts)

    service = Slow()
    assert embed_all(["a", "b", "c", "bad", "e"], service, 50, Breaker(50)) == [[1.0], [1.0], [1.0], [], [1.0]]

    class Dead:
        def embed(self, texts):
            raise OSError

    waits = []
    assert embed_all(["a"] * 10, Dead(), 1, Breaker(5), sleep=waits.append) == [[]] * 10
    assert waits[:2] == [3, 6] and len(waits) <= 4


def test_folds_do_not_depend_on_partitions(spark):
    rows = [(i, i % 3, i * 1_000_000, i % 2 == 0) for i in range(60)]
    frame = spark.createDataFrame(rows, "event_id long, k long, micros long, failed boolean").repartition(7)
    kept = folds.debounced(frame, "k", "micros", 5, "event_id").collect()
    assert sorted(r.event_id for r in kept if r.k == 0) == list(range(0, 60, 6))
    states = folds.breaker_log(frame, "k", "micros", "failed", 1, 10, "event_id").where("k = 0").orderBy("event_id").collect()
    assert [r.state for r in states[:5]] == ["opened", "rejected", "rejected", "rejected", "opened"]


def test_service(indexer, vault):
    indexer.index_vault()
    service = Service(indexer)

    def call(name, **arguments):
        answer = service.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})
        return json.loads(answer["result"]["content"][0]["text"])

    found = call("search_vault", query="alpha beta", top_k=1)
    assert found["count"] == 1 and found["total_chunks"] == 3 and found["results"][0]["text"].startswith("alpha")
    assert call("search_vault") == {"error": "query is required"}
    assert "error" in call("search_vault", query="x", top_k="many")
    assert call("get_chunk", source=str(vault / "one.md"))["count"] == 2
    assert "error" in call("get_chunk", source="' OR 1=1")
    assert call("read_vault_file", filepath="one.md")["size"] == len((vault / "one.md").read_text())
    assert "error" in call("read_vault_file", filepath="../../etc/passwd")
    assert call("vault_stats")["unique_files"] == 2
    assert call("reindex_file", filepath="one.md")["indexed"] == 0
    assert call("index_stats")["indexed_files"] == 2
    odd = vault / "a b" / "[x] {y}*.md"
    odd.write_text("odd name")
    assert call("reindex_file", filepath=str(odd))["indexed"] == 1 and call("reindex_file", filepath="lost.md")["indexed"] == 0
    out = io.StringIO()
    service.serve(['{"id": 1, "method": "tools/list"}\n', "not json\n", '{"method": "note"}\n', '{"id": 2, "method": "x"}\n', '{"id": 3, "method": "initialize"}\n'], out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(answers[0]["result"]["tools"]) == 6
    assert [a.get("error", {}).get("code") for a in answers[1:]] == [-32700, -32601, None]


def test_watch_indexes_new_files(spark, indexer, vault, tmp_path):
    from notewright.streaming.watch import index_stream, watch_files

    index_stream(watch_files(spark, str(vault)), indexer.index_batch, str(tmp_path / "watch")).awaitTermination()
    assert sorted(r.source for r in indexer.store.hashes().collect()) == [str(vault / "a b/z \u00e9.md"), str(vault / "one.md")]
    (vault / "two.md").write_text("later")
    index_stream(watch_files(spark, str(vault)), indexer.index_batch, str(tmp_path / "watch")).awaitTermination()
    assert indexer.store.chunks().count() == 4


def test_watch_indexes_edited_files(spark, vault, tmp_path):
    import time

    from notewright.plans.service import watch

    indexer = Indexer(spark, Config(vault_root=str(vault), store_path=str(tmp_path / "store"), watch_interval=1, debounce_seconds=2))
    indexer.index_vault()

    def until(*texts):
        end = time.time() + 60
        while (found := {r.text for r in indexer.store.chunks().collect()}) != set(texts) and time.time() < end:
            assert stream.exception() is None
            time.sleep(0.5)
        assert found == set(texts)

    for text in ("first", "later"):
        stream = watch(indexer)
        try:
            (vault / "one.md").write_text(f"{text} edit")
            until(f"{text} edit", "gamma\ndelta")
            (vault / "one.md").write_text(f"{text} edit again")
            until(f"{text} edit again", "gamma\ndelta")
        finally:
            stream.stop()


def test_watch_of_a_vault_that_only_spark_lists(spark, vault, indexer, monkeypatch):
    import time

    from notewright.plans import service

    monkeypatch.setattr(service, "can_list", lambda root: False)
    indexer.index_vault()
    (vault / "one.md").write_text("edited")
    (vault / "a b" / "z é.md").unlink()
    stream, end = service.watch(indexer), time.time() + 60
    try:
        while [r.text for r in indexer.store.chunks().collect()] != ["edited"]:
            assert time.time() < end and stream.exception() is None
            time.sleep(0.5)
    finally:
        stream.stop()


def test_stream_keeps_state_between_batches(spark, tmp_path):
    from notewright.streaming.watch import debounce_stream

    for n, events in enumerate([[("a", 0), ("a", 3), ("b", 1)], [("a", 4), ("a", 6), ("b", 7)]]):
        spark.createDataFrame([(s, "modified", t * 1_000_000) for s, t in events], "source string, kind string, micros long").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
    import shutil

    (tmp_path / "in").mkdir()
    for n in (0, 1):
        for f in (tmp_path / f"in{n}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in")
        rows = spark.readStream.schema("source string, kind string, micros long").parquet(str(tmp_path / "in"))
        query = debounce_stream(rows, 5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.source, r.micros // 1_000_000) for r in got) == [("a", 0), ("a", 6), ("b", 1), ("b", 7)]


def test_a_file_edited_while_it_is_embedded_is_indexed_by_the_next_run(spark, vault, tmp_path):
    """The recorded hash is that of the text that was embedded, whenever the file changes."""
    one = vault / "one.md"

    class Editing(HashedWords):
        def embed(self, texts):
            one.write_text("edited meanwhile")
            return super().embed(texts)

    config = Config(vault_root=str(vault), store_path=str(tmp_path / "store"))
    Indexer(spark, config, Editing()).index_vault()
    indexer = Indexer(spark, config)
    first = {r.text for r in indexer.store.chunks().where(f"source = '{one}'").collect()}
    indexer.index_vault()
    assert {r.text for r in indexer.store.chunks().where(f"source = '{one}'").collect()} == {"edited meanwhile"}
    assert first == {"alpha beta", "## Two\ngamma"} or first == {"edited meanwhile"}
    assert indexer.index_vault() == 0


def test_a_run_writes_the_buckets_it_touches(spark, tmp_path):
    root = tmp_path / "many"
    root.mkdir()
    for i in range(120):
        (root / f"n{i}.md").write_text(f"note {i} " * 50)
    indexer = Indexer(spark, Config(vault_root=str(root), store_path=str(tmp_path / "store"), buckets=40, max_backups=1))
    assert indexer.index_vault() == 120

    def size(version):
        return sum(p.stat().st_size for p in (tmp_path / "store" / version).rglob("*.parquet"))

    first = indexer.store.current()
    (root / "n7.md").write_text("only this one")
    assert indexer.index_file(str(root / "n7.md")) == 1
    second = indexer.store.current()
    assert size(second) < size(first) / 8
    assert indexer.store.chunks().count() == 120 and indexer.store.hashes().count() == 120
    for i in range(3):  # old versions go, but not the buckets that the current one reads
        (root / "n8.md").write_text(f"edit {i}")
        indexer.index_file(str(root / "n8.md"))
    assert len(indexer.store.versions()) == 2 and first not in indexer.store.versions()
    assert indexer.store.chunks().count() == 120
    for p in root.glob("*.md"):
        if p.name != "n8.md":
            p.unlink()
    indexer.index_vault()
    assert [r.text for r in indexer.store.chunks().collect()] == ["edit 2"]


def test_restore(spark, indexer, vault):
    indexer.index_vault()
    before = indexer.store.current()
    (vault / "one.md").write_text("changed")
    indexer.index_vault()
    indexer.store.restore(before)
    assert indexer.store.current() == before and {r.text for r in indexer.store.chunks().collect()} == {"alpha beta", "## Two\ngamma", "gamma\ndelta"}
    assert indexer.index_vault() == 1
    with pytest.raises(KeyError):
        indexer.store.restore("v0")


def test_locks(spark, tmp_path):
    from notewright.sources.store import Locked

    a, b = Store(spark, str(tmp_path / "s")), Store(spark, f"file://{tmp_path}/s")
    with a.lock():
        with pytest.raises(Locked):
            with b.lock(wait=0.3):
                pass
        with b.lock("OTHER", wait=0):
            pass
    with b.lock(wait=0):
        pass


def test_two_runs_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    config = Config(store_path=str(tmp_path / "store"))
    frames = [spark.createDataFrame([(f"/v/{k}{i}.md", f"text {k} {i}") for i in range(5)], "source string, content string") for k in "abc"]
    with ThreadPoolExecutor(3) as pool:
        runs = list(pool.map(lambda f: Indexer(spark, config).index_frame(f), frames))
    assert [r.chunks for r in runs] == [5] * 3 and Indexer(spark, config).store.chunks().count() == 15


def test_the_server_survives_any_line(indexer, monkeypatch):
    service = Service(indexer)
    monkeypatch.setattr(Service, "vault_stats", lambda self: 1 / 0)
    call = lambda i, **params: json.dumps({"id": i, "method": "tools/call", "params": params}) + "\n"
    lines = ['{"id": 1, "method": "tools/call", "params": [1]}\n', call(2, name=["search_vault"]), call(3, name="get_chunk", arguments=[1]), call(4, name="get_chunk", arguments={"source": {"a": 1}}), call(5, name="get_chunk", arguments={"other": 1}), call(6, name="vault_stats"), "[1, 2]\n", "null\n", "[" * 100_000 + "\n", '{"id": 7, "method": ["x"]}\n', call(8, name="handle"), call(9, name="read_vault_file", arguments={"filepath": "a\0b"}), '{"id": 10, "method": "tools/list", "params": 3}\n']
    out = io.StringIO()
    service.serve(lines, out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(answers) == len(lines)
    assert [a.get("error", {}).get("code") for a in answers] == [-32602, -32601, -32602, -32602, -32602, None, -32600, -32600, -32700, -32601, -32601, None, None]
    assert answers[5]["result"]["isError"] and "ZeroDivisionError" in answers[5]["result"]["content"][0]["text"]
    assert "error" in json.loads(answers[11]["result"]["content"][0]["text"])


@pytest.fixture
def embedding_service():
    """A service that embeds by hashed words; the first request of each run of "slow" times out, "broken" is an error."""
    import http.server
    import threading
    import time

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, value, status=200):
            body = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            with contextlib.suppress(BrokenPipeError):  # who asked has given up
                self.wfile.write(body)

        def do_GET(self):
            self.answer({"models": [{"name": "words:latest"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, asked["model"], len(asked["input"])))
            if "slow" in asked["input"] and len(asked["input"]) > 1:
                time.sleep(1.2)
            if "broken" in asked["input"]:
                return self.answer({}, 500)
            self.answer({"embeddings": HashedWords(8).embed(asked["input"])})

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}", seen
    server.shutdown()


def test_remote_embedder(spark, embedding_service, vault, tmp_path):
    from notewright.operators.embedding import RemoteEmbedder

    url, seen = embedding_service
    service = RemoteEmbedder(url + "/", "words", 8, timeout=0.6)
    assert service.has_model() and not RemoteEmbedder(url, "other", 8).has_model()
    assert embed_all(["a", "slow", "b"], service, 3, Breaker()) == HashedWords(8).embed(["a", "slow", "b"])
    assert seen[0] == ("/api/embed", "words", 3) and {n for _, _, n in seen} > {1}
    assert embed_all(["broken"], service, 3, Breaker(), sleep=lambda s: None) == [[]]
    indexer = Indexer(spark, Config(vault_root=str(vault), store_path=str(tmp_path / "store"), embed_url=url, embed_model="words", dimension=8))
    assert indexer.check_embedder() is None and indexer.index_vault() == 3
    assert indexer.search("gamma\ndelta", 1)[0]["text"] == "gamma\ndelta"
    lost = Indexer(spark, Config(store_path=str(tmp_path / "s2"), embed_url=url, embed_model="gone"))
    dead = Indexer(spark, Config(store_path=str(tmp_path / "s3"), embed_url="http://127.0.0.1:9", embed_model="words"))
    assert "no model gone" in lost.check_embedder() and "can't be asked" in dead.check_embedder()


def test_index_command(spark, vault, tmp_path, monkeypatch, capsys):
    from notewright.plans import service

    monkeypatch.setenv("VAULT_ROOT", str(vault))
    monkeypatch.setenv("STORE_PATH", str(tmp_path / "store"))
    assert service.index_main([], spark) == 0 and "4 chunks" in capsys.readouterr().out
    assert service.index_main(["--once"], spark) == 0 and "0 chunks" in capsys.readouterr().out
    assert service.index_main(["--reindex"], spark) == 0 and "4 chunks" in capsys.readouterr().out
    with Store(spark, str(tmp_path / "store")).lock("INSTANCE"):
        assert service.index_main([], spark) == 0 and "another vault-index" in capsys.readouterr().err
    watched = []
    monkeypatch.setattr(service, "watch", lambda indexer: type("Query", (), {"awaitTermination": lambda self: watched.append(indexer)})())
    assert service.index_main(["--watch"], spark) == 0 and len(watched) == 1
    monkeypatch.setenv("EMBED_URL", "http://127.0.0.1:9")
    monkeypatch.setattr(service.Indexer, "index_vault", lambda self: 0)
    service.index_main([], spark)
    assert "warning" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        service.index_main(["--other"], spark)
