"""The engine as tools over JSON-RPC lines, and as command lines."""

from __future__ import annotations

import argparse
import inspect
import json
import sys

from pyspark.sql import SparkSession

from notewright.config import Config
from notewright.operators.search import chunks_of, clamp
from notewright.operators.stats import index_statistics
from notewright.plans.ingest import Indexer
from notewright.sources.store import Locked
from notewright.sources.files import can_list
from notewright.sources.vault import inside

PROTOCOL = "2024-11-05"
NO_METHOD, BAD_JSON, BAD_REQUEST, BAD_PARAMETERS = -32601, -32700, -32600, -32602


def _tool(name: str, says: str, required: str | None = None, **more) -> dict:
    properties = ({required: {"type": "string"}} if required else {}) | more
    return {"name": name, "description": says, "inputSchema": {"type": "object", "properties": properties, "required": [required] if required else []}}


TOOLS = [
    _tool("search_vault", "Chunks nearest to a query.", "query", top_k={"type": "integer", "default": 5, "minimum": 1, "maximum": 20}),
    _tool("read_vault_file", "The whole text of a file of the vault.", "filepath"),
    _tool("vault_stats", "Chunks, files, and the files with the most chunks."),
    _tool("get_chunk", "The chunks of a file.", "source"),
    _tool("reindex_file", "Index a file if it has changed.", "filepath"),
    _tool("index_stats", "Indexed files and Markdown files."),
]


class Service:
    def __init__(self, indexer: Indexer):
        self.indexer, self.config = indexer, indexer.config

    def search_vault(self, query: str = "", top_k: int = 5) -> dict:
        if not query:
            return {"error": "query is required"}
        try:
            k = clamp(top_k)
        except (TypeError, ValueError):
            return {"error": "top_k is a number"}
        rows = sorted(self.indexer.search_frame(query, k).collect(), key=lambda r: r.rank)  # 20 at most
        hits = [{"source": r.source, "text": r.text, "score": r.distance, "similarity": r.similarity, "chunk_id": r.chunk_id} for r in rows]
        return {"results": hits, "count": len(hits), "total_chunks": self.indexer.stats()["total_chunks"], "query": query}

    def get_chunk(self, source: str = "") -> dict:
        if not source:
            return {"error": "source is required"}
        rows = chunks_of(self.indexer.store.chunks_of(source), source).select("text", "chunk_id").collect()  # 50 at most
        if not rows:
            return {"error": f"No chunks found for {source}"}
        return {"source": source, "chunks": [r.asDict() for r in rows], "count": len(rows)}

    def read_vault_file(self, filepath: str = "", file_path: str = "") -> dict:
        path = filepath or file_path
        if not path:
            return {"error": "filepath is required"}
        try:
            found = inside(self.config.vault_root, path)
            content = self.indexer.store.bytes_of(found).decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
        except FileNotFoundError:
            return {"error": f"File not found: {path}"}
        except (OSError, UnicodeDecodeError) as e:
            return {"error": str(e)}
        return {"filepath": found, "content": content, "size": len(content)}

    def vault_stats(self) -> dict:
        store = self.indexer.store
        listed = [{"file": s, "chunks": n} for s, n in store.top()]
        return self.indexer.stats() | {"top_files": listed, "db_path": self.config.store_path, "embed_model": self.config.embed_model, "embed_url": self.config.embed_url}

    def reindex_file(self, filepath: str = "") -> dict:
        if not filepath:
            return {"error": "filepath is required"}
        try:
            found = inside(self.config.vault_root, filepath)
        except PermissionError as e:
            return {"error": str(e)}
        return {"indexed": self.indexer.index_file(found), "filepath": found}

    def index_stats(self) -> dict:
        row = index_statistics(self.indexer.store.hashes(), self.indexer.files()).first()
        return row.asDict() | {"db_path": self.config.store_path, "status": "ok"}

    def handle(self, request: dict) -> dict | None:
        """The answer to a request; none to a notification."""
        if not isinstance(request, dict):
            return _error(None, BAD_REQUEST, "a request is an object")
        method, of, params = request.get("method", ""), request.get("id"), request.get("params") or {}
        if "id" not in request:
            return None
        if method == "initialize":
            return _result(of, {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "notewright", "version": "0.1.0"}})
        if method == "tools/list":
            return _result(of, {"tools": TOOLS})
        if method != "tools/call":
            return _error(of, NO_METHOD, f"Method not found: {method}")
        if not isinstance(params, dict):
            return _error(of, BAD_PARAMETERS, "params is an object")
        name, arguments = params.get("name", ""), params.get("arguments") or {}
        if not isinstance(name, str) or name not in {t["name"] for t in TOOLS}:
            return _error(of, NO_METHOD, f"Unknown tool: {name}")
        if not isinstance(arguments, dict) or any(not isinstance(arguments.get(k, ""), str) for k in ("query", "filepath", "file_path", "source")):
            return _error(of, BAD_PARAMETERS, "arguments is an object; query, filepath and source are strings")
        tool = getattr(self, name)
        try:
            inspect.signature(tool).bind(**arguments)
        except TypeError as e:
            return _error(of, BAD_PARAMETERS, str(e))
        try:
            found, failed = tool(**arguments), {}
        except Exception as e:  # whatever a tool does, the server goes on and says so
            found, failed = {"error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"}, {"isError": True}
        return _result(of, {"content": [{"type": "text", "text": json.dumps(found, indent=2, default=str)}]} | failed)

    def serve(self, lines, out) -> None:
        """A request a line, an answer a line; a malformed line gets an error and ends nothing."""
        for line in lines:
            if not line.strip():
                continue
            try:
                answer = self.handle(json.loads(line))
            except (ValueError, RecursionError) as e:
                answer = _error(None, BAD_JSON, str(e))
            if answer is not None:
                out.write(json.dumps(answer) + "\n")
                out.flush()


def _result(of, value) -> dict:
    return {"jsonrpc": "2.0", "id": of, "result": value}


def _error(of, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": of, "error": {"code": code, "message": message}}


def index_main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Index once (the default), rebuild, or watch after a first full run."""
    parser = argparse.ArgumentParser(prog="vault-index")
    for flag in ("--once", "--watch", "--reindex", "--daemon"):
        parser.add_argument(flag, action="store_true")
    given = parser.parse_args(arguments)
    config = Config.from_environment()
    indexer = Indexer(spark or SparkSession.builder.appName("notewright").getOrCreate(), config)
    if wrong := indexer.check_embedder():
        print(f"warning: {wrong}", file=sys.stderr)
    try:
        with indexer.store.lock("INSTANCE", wait=0):
            print(f"{indexer.rebuild() if given.reindex else indexer.index_vault()} chunks indexed")
            if given.watch or given.daemon:
                watch(indexer).awaitTermination()
    except Locked:
        print("another vault-index is running on this store", file=sys.stderr)
    return 0


def watch(indexer: Indexer):
    """Starts the stream that indexes files as they are created and modified.

    A vault that Python can't list is indexed anew by hash at each trigger."""
    from notewright.streaming.watch import debounce_stream, index_stream, ticks, watch_events

    config, spark = indexer.config, indexer.spark
    if not can_list(config.vault_root):
        return index_stream(ticks(spark), lambda _: indexer.index_vault(), f"{config.store_path}/watch-ticks", False, config.watch_interval)
    events = debounce_stream(watch_events(spark, config.vault_root, f"{config.store_path}/watch-listings", config), config.debounce_seconds, 3600.0)
    return index_stream(events, indexer.index_events, f"{config.store_path}/watch-changes", False, config.watch_interval)


def serve_main() -> int:
    indexer = Indexer(SparkSession.builder.appName("notewright").getOrCreate(), Config.from_environment())
    Service(indexer).serve(sys.stdin, sys.stdout)
    return 0
