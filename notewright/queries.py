"""A query for each operator of the engine over the driver's tables: (spark, sf_dir) to a DataFrame.

`documents` stands for files: /vault/<source>/<doc_id>.md with the text as content. Two derived corpora hold what the
texts lack: one with front matter and headings, one of notes with front matter, tags and links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.config import Config
from notewright.functions import chunking
from notewright.functions.text import decoded, is_blank, split_words, strip, without_front_matter
from notewright.operators import changes, embedding, folds, notes, pivots, search, stats
from notewright.sources.vault import spread
from notewright.sources.work import new_path, work_dir

CONFIG = Config()
QUERY_IDS, HITS = (0, 7, 42), 5


def _table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _files(spark, sf) -> DataFrame:
    docs = spread(_table(spark, sf, "documents").select("doc_id", "source", "text"))
    return docs.select(F.concat(F.lit("/vault/"), "source", F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("source"), F.col("text").alias("content"), "doc_id")


def _headed(spark, sf) -> DataFrame:
    """Front matter in front, a heading for each line."""
    content = F.concat(F.lit("---\nt: x\n---\n"), F.replace(F.col("content"), F.lit("\n"), F.lit("\n## ")))
    return _files(spark, sf).withColumn("content", content)


def _hashes(spark, sf) -> DataFrame:
    """A store of hashes that lacks some files, differs for some, and knows some that are gone."""
    files = changes.with_hash(_files(spark, sf))
    there = files.where("doc_id % 10 <> 0").select("source", F.when(F.col("doc_id") % 10 == 1, F.md5(F.lit("old"))).otherwise(F.col("content_hash")).alias("hash"))
    gone = files.where("doc_id % 10 = 2").select(F.concat(F.lit("/vault/gone/"), "doc_id", F.lit(".md")).alias("source"), F.col("content_hash").alias("hash"))
    return there.unionByName(gone)


def _notes(spark, sf) -> DataFrame:
    """Notes with front matter; every seventh has none, some lack a status, name an unknown type or link to no note."""
    docs = _table(spark, sf, "documents").where("doc_id is not null")
    i = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("error", "decision", "research", "project", "moc", "idea")))
    kind = F.element_at(kinds, (i % 6 + 1).cast("int"))
    status = F.when(i % 5 == 0, F.lit("")).otherwise("status: active\n")
    front = F.concat(F.lit("---\ntype: "), kind, F.lit("\n"), status, F.lit("date: 2024-"), F.lpad((i % 14 + 1).cast("string"), 2, "0"), F.lit("-03\ntags: ["), F.col("lang"), F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(", status/active, topic-"), (i % 4).cast("string"))), F.lit("]\n---\n"))
    related = F.when(i % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("\n## Related\n[[note-"), (i + 1).cast("string"), F.lit("]] [[note-"), (i * 3 % 500).cast("string"), F.lit("|see also]]\n")))
    content = F.concat(F.when(i % 7 == 0, F.lit("# No front\n")).otherwise(front), F.lit("Body "), i.cast("string"), F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" [[missing-"), (i % 9).cast("string"), F.lit("]]"), related)
    name = F.when(i % 11 == 0, F.concat(F.lit("Note "), i.cast("string"))).otherwise(F.concat(F.lit("note-"), i.cast("string")))
    return docs.select(F.concat(F.lit("/vault/"), "source", F.lit("/"), name, F.lit(".md")).alias("source"), content.alias("content"))


def _chunks(spark, sf) -> DataFrame:
    return chunking.chunks(_files(spark, sf), CONFIG)


def _event_times(spark, sf) -> DataFrame:
    return _table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), (F.col("event_type") == "error").alias("failed"))


# Scans, filters and hashes


def scan_filter(spark, sf):
    """Files that are Markdown, readable and not excluded: here src1 as part of the path takes src10 and its like along."""
    files = _files(spark, sf).withColumn("source", F.when(F.col("doc_id") % 6 == 0, F.replace("source", F.lit(".md"), F.lit(".MD"))).otherwise(F.col("source")))
    return changes.scannable(files, ("/src1", ".git")).select("source", F.length("content").alias("size"))


def scan_by_component(spark, sf):
    return changes.scannable(_files(spark, sf), ("src1", ".git"), components=True).select("source")


def file_hash(spark, sf):
    return changes.with_hash(_files(spark, sf)).select("source", "content_hash")


def decode_text(spark, sf):
    """Bytes to text: here every third file has other line ends and every fifth a byte that is no UTF-8."""
    content = F.when(F.col("doc_id") % 3 == 0, F.replace("content", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("content")).cast("binary")
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(content, F.unhex(F.lit("FF")))).otherwise(content)
    return _files(spark, sf).select("source", decoded(raw).alias("content")).select("source", F.md5(F.col("content").cast("binary")).alias("content_hash"))


def blank_filter(spark, sf):
    files = _files(spark, sf).withColumn("content", F.when(F.col("doc_id") % 8 == 0, F.lit(" \u3000\n\t ")).otherwise(F.col("content")))
    return files.where(~is_blank(F.col("content"))).select("source", F.length(strip(F.col("content"))).alias("size"))


def read_file(spark, sf):
    return _files(spark, sf).where(F.col("source").endswith("/42.md")).select("source", "content", F.length("content").alias("size"))


# Changes


def changed_files(spark, sf):
    return changes.changed_files(changes.with_hash(_files(spark, sf)), _hashes(spark, sf)).select("source", "content_hash", "change")


def deleted_files(spark, sf):
    return changes.deleted_sources(_files(spark, sf), _hashes(spark, sf))


def delete_by_source(spark, sf):
    """What the chunk table keeps when the sources of every tenth document go."""
    gone = _files(spark, sf).where("doc_id % 10 = 3")
    return changes.without_sources(_chunks(spark, sf), gone).groupBy("source").agg(F.count("*").alias("chunks"))


def upsert_replace(spark, sf):
    """The section table after a run: changed files have the sections of their new texts, the others keep theirs."""
    files = changes.with_hash(_files(spark, sf))
    old = chunking.sections(_headed(spark, sf)).select("source", "section", F.md5("text").alias("chunk_id"))
    changed = changes.changed_files(files, _hashes(spark, sf))
    new = chunking.sections(changed).select("source", "section", F.md5("text").alias("chunk_id"))
    return changes.replace_sources(old, new, changed)


def hashes_after_run(spark, sf):
    files = changes.changed_files(changes.with_hash(_files(spark, sf)), _hashes(spark, sf))
    failed = files.where("doc_id % 20 = 1").select("source")
    return changes.indexed_hashes(_hashes(spark, sf), files, failed)


# Chunks


def front_matter_strip(spark, sf):
    return _headed(spark, sf).select("source", F.md5(without_front_matter(F.col("content"))).alias("body_md5"))


def section_split(spark, sf):
    return chunking.sections(_headed(spark, sf)).select("source", "section", F.md5("text").alias("text_md5"), F.length("text").alias("size"))


def chunk_windows(spark, sf):
    return _chunks(spark, sf).select("source", "section", "window", "chunk_id", F.length("text").alias("size"))


def chunk_truncate(spark, sf):
    """Stored texts are cut, their chunk_ids are of the whole: here with windows of 1500 characters."""
    wide = chunking.chunks(_files(spark, sf), Config(chunk_size=1500))
    return wide.select("source", "window", "chunk_id", F.md5(chunking.stored_text()).alias("stored_md5"), F.length(chunking.stored_text()).alias("size"))


def duplicate_chunk_ids(spark, sf):
    counts = _chunks(spark, sf).groupBy("chunk_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    return counts.where("n > 1")


def overlap_lengths(spark, sf):
    """Characters of the last 16 words, with a space for each."""
    words = split_words(F.col("content"))
    last = F.slice(words, F.greatest(F.size(words) - 15, F.lit(1)), 16)
    return _files(spark, sf).select("source", F.aggregate(last, F.lit(0), lambda n, w: n + F.length(w) + 1).alias("overlap"))


def embed_batches(spark, sf):
    return embedding.batches_of(_chunks(spark, sf), CONFIG.batch_size).groupBy("source", "batch").agg(F.count("*").alias("chunks"))


def hash_embedder(spark, sf):
    """Vectors of the conversations' texts, by the offline embedder; the first eight values, rounded."""
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "text")
    embedded = embedding.embed_chunks(turns, embedding.HashedWords(16))
    return embedded.select("conv_id", "turn", *(F.round(F.element_at("vector", i + 1).cast("double"), 5).alias(f"v{i}") for i in range(8)))


# Search


def _vectors(spark, sf) -> DataFrame:
    return _table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))


def _queries(spark, sf, ids) -> list:
    rows = _table(spark, sf, "embeddings").where(F.col("vec_id").isin(*ids)).select("vec_id", "embedding").collect()  # len(ids) at most
    return sorted((int(r.vec_id), list(r.embedding)) for r in rows)


def _hits(spark, sf, ids, metric) -> DataFrame:
    found = search.nearest(_vectors(spark, sf), _queries(spark, sf, ids), HITS, metric, ["vec_id"])
    return found.select("query_id", "rank", "vec_id", "label", (F.round("distance", 6) + 0.0).alias("distance"))


def search_topk_l2(spark, sf):
    return _hits(spark, sf, QUERY_IDS[:1], "l2")


def search_topk_cosine(spark, sf):
    return _hits(spark, sf, QUERY_IDS[:1], "cosine")


def search_topk_dot(spark, sf):
    return _hits(spark, sf, QUERY_IDS[:1], "dot")


def search_multi_query(spark, sf):
    return _hits(spark, sf, QUERY_IDS, "l2")


def search_threshold(spark, sf):
    found = search.nearest(_vectors(spark, sf), _queries(spark, sf, QUERY_IDS), search.MOST, "cosine", ["vec_id"])
    return search.relevant(found, 0.5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


def search_snippet(spark, sf):
    """Hits among documents that the vectors stand for, with the first 300 characters of their texts."""
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    found = search.nearest(_vectors(spark, sf), _queries(spark, sf, QUERY_IDS[1:2]), HITS, "l2", ["vec_id"])
    return search.snippets(docs.join(F.broadcast(found.select("vec_id", "rank")), "vec_id")).select("rank", "vec_id", "text")


def search_whole_files(spark, sf):
    """Hits joined with their whole files."""
    found = search.nearest(_vectors(spark, sf), _queries(spark, sf, QUERY_IDS[:1]), HITS, "l2", ["vec_id"])
    files = _files(spark, sf).select("source", "content", "doc_id")
    hits = found.join(files.select(F.col("doc_id").alias("vec_id"), "source"), "vec_id")
    return search.whole_files(hits.select("rank", "source"), files).select("rank", "source", F.length("content").alias("size"))


def search_query_table(spark, sf):
    """Every fiftieth vector as a query against all vectors."""
    queries = _table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = search.nearest_to_table(_vectors(spark, sf), queries, HITS, "l2", ["vec_id"])
    return found.select("query_id", "rank", "vec_id", "label", (F.round("distance", 6) + 0.0).alias("distance"))


def search_cells(spark, sf):
    """The search of search_topk_l2 over vectors written in cells around pivots, which leaves cells unread."""
    rows, key = _vectors(spark, sf), ["vec_id"]
    chosen = pivots.choose_pivots(rows)
    path = new_path(spark, "cells")
    pivots.with_cell(rows, chosen).hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    placed = spark.read.parquet(path)
    cells = pivots.cells_of(placed, chosen)
    query = _queries(spark, sf, QUERY_IDS[:1])[0][1]
    hits, _ = pivots.search_cells(cells, lambda some: placed.where(F.col("cell").isin([int(c.name) for c in some])), chosen, query, HITS, "l2", key)
    few = [(QUERY_IDS[0], i + 1, h.vec_id, h.label, round(h.distance, 6) + 0.0) for i, h in enumerate(hits)]  # HITS rows
    return spark.createDataFrame(few, "query_id long, rank int, vec_id long, label int, distance double")


def chunk_table_function(spark, sf):
    """chunk_windows in SQL, by a table function."""
    chunking.register_chunker(spark, CONFIG)
    _files(spark, sf).createOrReplaceTempView("files_to_chunk")
    return spark.sql("SELECT source, section, window, chunk_id, length(text) AS size FROM files_to_chunk, LATERAL chunks_of(content)")


def store_after_runs(spark, sf):
    """Chunks of each file in a store after a first run, a run over changed files and one without the lost ones."""
    from notewright.plans.ingest import Indexer

    indexer = Indexer(spark, Config(store_path=new_path(spark, "store")))
    files = changes.with_hash(_files(spark, sf).select("source", "content", "doc_id"))
    indexer.index_frame(files.select("source", "content"))
    edited = F.when(F.col("doc_id") % 25 == 3, F.concat("content", F.lit("\n## Added\nlater"))).otherwise(F.col("content"))
    after = files.withColumn("content", edited).where("doc_id % 40 <> 7")
    indexer.index_all(after.select("source", "content"))
    return indexer.store.texts().groupBy("source").agg(F.count("*").alias("chunks"), F.max("section").alias("last_section"))


def get_chunks(spark, sf):
    source = "/vault/src2/42.md"
    return search.chunks_of(_chunks(spark, sf), source).select("source", "section", "window", "chunk_id")


# Statistics


def vault_stats(spark, sf):
    return stats.totals(_chunks(spark, sf))


def top_files(spark, sf):
    return stats.top_files(_chunks(spark, sf))


def stats_envelope(spark, sf):
    row = stats.statistics(_chunks(spark, sf), "store", "hashed-words", "")
    return row.select("total_chunks", "unique_files", "db_path", "embed_model", F.array_join(F.transform("top_files", lambda x: F.concat(x["file"], F.lit(":"), x["chunks"])), ",").alias("top_files"))


def index_stats(spark, sf):
    return stats.index_statistics(_hashes(spark, sf), _files(spark, sf))


def backup_retention(spark, sf):
    """The newest two of each kind, by name; orders stand for backups."""
    names = _table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), F.concat(F.lit("backup_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("name"))
    return stats.kept_backups(names, 2).where("keep").select("kind", "name")


# Events


def debounce(spark, sf):
    """Events of a user that come six hours or more after the last one that counted."""
    return folds.debounced(_event_times(spark, sf), "user_id", "micros", 6 * 3600, "event_id").select("event_id", "user_id", "micros")


def circuit_breaker(spark, sf):
    """Errors as failures: two in a row open the breaker of a user for two days."""
    return folds.breaker_log(_event_times(spark, sf), "user_id", "micros", "failed", 2, 2 * 86400, "event_id").select("event_id", "state", "failures")


def watch_stream(spark, sf):
    """The debounce as a stream with state, over all events that are there."""
    import uuid

    from notewright.streaming.watch import debounce_stream

    table = f"watched_{uuid.uuid4().hex}"
    events = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, sf))
    rows = events.select(F.col("user_id").cast("string").alias("source"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    query = debounce_stream(rows, 6 * 3600).writeStream.format("parquet").option("path", f"{work_dir(spark)}/{table}").option("checkpointLocation", f"{work_dir(spark)}/{table}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema("source string, kind string, micros long").parquet(f"{work_dir(spark)}/{table}")
    return found.select(F.col("kind").cast("long").alias("event_id"), F.col("source").cast("long").alias("user_id"), "micros")


def _stream_folder(spark, sf) -> str:
    """A folder of event files: a stream reads folders, and the table may be one file."""
    import uuid

    path = f"{work_dir(spark)}/events-{uuid.uuid4().hex}"
    _table(spark, sf, "events").write.parquet(path)
    return path


# Conventions of notes


def front_matter_fields(spark, sf):
    return notes.with_fields(_notes(spark, sf)).select("source", "type", "status", "date", F.array_join("tags", ",").alias("tags"))


def tags_explode(spark, sf):
    return notes.tag_counts(_notes(spark, sf))


def wikilinks(spark, sf):
    return notes.links(_notes(spark, sf))


def backlinks(spark, sf):
    return notes.backlinks(_notes(spark, sf))


def broken_links(spark, sf):
    return notes.broken_links(_notes(spark, sf))


def note_lint(spark, sf):
    return notes.lint(_notes(spark, sf))


def moc_candidates(spark, sf):
    return notes.map_candidates(_notes(spark, sf), files=50, folders=3)


def moc_lint(spark, sf):
    """Maps made of documents: entries with and without links, descriptions, related maps, updates and empty sections."""
    i = F.col("doc_id")
    docs = _table(spark, sf, "documents").where("doc_id is not null")
    entry = F.concat(F.lit("\n- "), F.when(i % 3 == 0, F.lit("plain")).otherwise(F.concat(F.lit("[["), F.when(i % 5 == 0, F.lit("06-SYSTEM/rules/")).otherwise(""), F.lit("note-"), i.cast("string"), F.lit("]]"))), F.when(i % 4 == 0, F.lit("")).otherwise(" about it"))
    related = F.when(i % 7 == 0, F.lit("\n## Related MOCs\n")).otherwise("\n## Related MOCs\n- [[MOC-other]] more\n")
    updates = F.when(i % 2 == 0, F.lit("")).otherwise("\n## Recent Updates\n2024-05-06 made\n")
    content = F.concat(F.when(i % 9 == 0, F.lit("---\ntype: log\n---\n")).otherwise("---\ntype: moc\n---\n"), F.lit("## Entries"), entry, F.lit("\n"), F.coalesce("text", F.lit("")), related, updates)
    name = F.when(i % 18 == 0, F.lit("/vault/07-INDEX/MOC-")).otherwise("/vault/07-INDEX/map-")
    return notes.map_lint(docs.select(F.concat(name, i.cast("string"), F.lit(".md")).alias("source"), content.alias("content")))


def route_notes(spark, sf):
    return notes.routed(_notes(spark, sf))


def session_scan(spark, sf):
    """Documents as turns of the conversations of their source; the sample texts hold few cue words, so two are put in."""
    docs = spread(_table(spark, sf, "documents").select("doc_id", "source", "text"))
    found = F.when(F.col("doc_id") % 3 == 0, F.lit("a bug and a decision. ")).otherwise("")
    text = F.concat(found, F.when(F.col("doc_id") % 6 == 0, F.lit("grep x: exit code 1\n")).otherwise(""), F.col("text"))
    return notes.session_scan(docs.select(F.col("source").alias("conv_id"), text.alias("text")))


def session_reports(spark, sf):
    turns = _table(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 1, F.lit("A lesson: the project is stuck")).otherwise(F.col("text")))
    return notes.session_reports(turns)


def chronological_notes(spark, sf):
    """Entries of a user's log that stand behind a later one; their order in the log is by number modulo 50, then by number."""
    from pyspark.sql import Window

    events = _event_times(spark, sf)
    before = F.lag("micros").over(Window.partitionBy("user_id").orderBy(F.col("event_id") % 50, "event_id"))
    return events.withColumn("before", before).where("micros < before").select("event_id", "user_id")


QUERIES = {f.__name__: f for f in (
    scan_filter, scan_by_component, file_hash, decode_text, blank_filter, read_file, changed_files, deleted_files, delete_by_source, upsert_replace, hashes_after_run,
    front_matter_strip, section_split, chunk_windows, chunk_truncate, duplicate_chunk_ids, overlap_lengths, embed_batches, hash_embedder,
    search_topk_l2, search_topk_cosine, search_topk_dot, search_multi_query, search_threshold, search_snippet, search_whole_files, search_query_table, search_cells, chunk_table_function, store_after_runs, get_chunks,
    vault_stats, top_files, stats_envelope, index_stats, backup_retention, debounce, circuit_breaker, watch_stream,
    front_matter_fields, tags_explode, wikilinks, backlinks, broken_links, note_lint, moc_candidates, moc_lint, route_notes, session_scan, session_reports, chronological_notes,
)}
