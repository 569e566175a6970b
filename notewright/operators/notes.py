"""Conventions of a note collection: front matter, tags, links, routing, maps of content, session scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.text import slug_name, strip

#: Fixed values of the conventions.
FIELDS = ("type", "status", "date", "tags")
TYPES = ("log", "research", "knowledge", "memory", "project", "review", "error", "decision", "moc")
STATUSES = ("active", "complete", "archived", "draft")
ROUTES = [
    ("daily log", "daily-note/"), ("error", "error-log/"), ("decision", "decisions/"), ("research", "research/analyses/"), ("comparison", "research/comparisons/"), ("concept", "concepts/"), ("fact", "facts/"), ("entity", "entities/"), ("tool", "tools/"), ("resource", "resources/"), ("prompt", "prompts/"), ("pattern", "patterns/"), ("lesson", "lessons-learned/"), ("skill usage", "skill-usage/"), ("project", "projects/"), ("progress", "progress/"), ("moc", "index/"),
]
UNROUTED = "00-NOTES/"
CATEGORIES = [
    ("error-log", "01-AGENT-MEMORY/error-log/", ("error", "bug", "mistake", "traceback")), ("corrections", "01-AGENT-MEMORY/corrections/", ("correction", "actually", "wrong")), ("blockers", "01-AGENT-MEMORY/blockers/", ("blocker", "blocked", "stuck")), ("decisions", "01-AGENT-MEMORY/decisions/", ("decision", "decide", "decided")), ("lessons-learned", "01-AGENT-MEMORY/lessons-learned/", ("lesson", "learned")), ("patterns", "01-AGENT-MEMORY/patterns/", ("pattern", "insight", "recurring")), ("knowledge-gaps", "01-AGENT-MEMORY/knowledge-gaps/", ("unknown", "unclear")), ("skill-usage", "01-AGENT-MEMORY/skill-usage/", ("skill",)), ("entities", "02-KNOWLEDGE/entities/", ("protocol", "company", "organization")), ("people", "02-KNOWLEDGE/people/", ("person", "founder", "author")), ("topics", "02-KNOWLEDGE/topics/", ("topic", "domain")), ("projects", "05-PROJECT/active/", ("project", "milestone")),
]
#: Fixed value: a command that looks around and finds nothing is no error (a line of a turn, lower-cased).
LOOKS_AROUND = r"(?:^|[^a-z])(?:cat|ls|grep|find) [^\n]*(?:exit|status|code|returned|nonzero)"
NEEDS_ROUTING = "needs-routing"
COMPLEX_TURNS = 10  #: more turns than this make a session complex


def front_matter(content: Column) -> Column:
    """The lines between the first two lines of three dashes; null without them at the start. Searched for, not matched: any number of lines will do."""
    body = F.concat(F.lit("\n"), F.substr(content, F.lit(5)), F.lit("\n"))
    end = F.locate("\n---\n", body)
    return F.when(content.startswith("---\n") & (end > 0), F.substr(body, F.lit(2), end - 1))


def field(block: Column, key: str) -> Column:
    """A value of the front matter; null if there is none."""
    value = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*([^\n]*)$", 1)
    return F.nullif(strip(value), F.lit(""))


def listed(value: Column) -> Column:
    """The entries of [a, b]."""
    return F.array_remove(F.split(F.regexp_replace(value, r"^\[|\]$|\s", ""), ","), "")


def with_fields(notes: DataFrame) -> DataFrame:
    """notes (source, content) with type, status, date, and tags as an array."""
    block = front_matter(F.col("content"))
    rows = notes.withColumn("block", block)
    return rows.withColumns({k: field(F.col("block"), k) for k in FIELDS[:3]} | {"tags": F.coalesce(listed(field(F.col("block"), "tags")), F.array().cast("array<string>"))}).drop("block")


def tag_counts(notes: DataFrame) -> DataFrame:
    """(prefix, tag, notes): how many notes have each tag; a prefix stands before a slash."""
    tags = with_fields(notes).select("source", F.explode(F.array_distinct("tags")).alias("tag"))
    prefix = F.when(F.col("tag").contains("/"), F.substring_index("tag", "/", 1)).otherwise("")
    return tags.groupBy(prefix.alias("prefix"), "tag").agg(F.count("*").alias("notes"))


def links(notes: DataFrame) -> DataFrame:
    """(source, target, display) of each [[target]] or [[target|display]], as often as it stands there."""
    found = notes.select("source", F.explode(F.regexp_extract_all(F.col("content"), F.lit(r"\[\[([^\[\]\n]+)\]\]"), F.lit(1))).alias("link"))
    target = strip(F.substring_index("link", "|", 1))
    display = F.when(F.col("link").contains("|"), strip(F.expr("substring(link, locate('|', link) + 1)"))).otherwise(target)
    return found.select("source", target.alias("target"), display.alias("display"))


def resolved(notes: DataFrame) -> DataFrame:
    """links with the source that each target names, by file name; null where there is none."""
    names = notes.select(slug_name(F.col("source")).alias("target"), F.col("source").alias("resolved")).groupBy("target").agg(F.min("resolved").alias("resolved"))
    return links(notes).join(names, "target", "left")


def backlinks(notes: DataFrame) -> DataFrame:
    """(resolved, n_links, n_sources): how often each note is linked, and from how many notes."""
    found = resolved(notes).where("resolved is not null").groupBy("resolved", "source").agg(F.count("*").alias("n"))
    return found.groupBy("resolved").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_sources"))


def broken_links(notes: DataFrame) -> DataFrame:
    """(source, target) of links to no note."""
    return resolved(notes).where("resolved is null").select("source", "target").distinct()


def lint(notes: DataFrame) -> DataFrame:
    """(source, problems): what a note lacks of the conventions, comma-joined in the order of the checks; notes without any go."""
    name = slug_name(F.col("source"))
    rows = with_fields(notes)
    tags = F.col("tags")
    checks = [
        ("no-front-matter", front_matter(F.col("content")).isNull()),
        ("no-type", F.col("type").isNull()),
        ("unknown-type", ~F.col("type").isin(*TYPES)),
        ("unknown-status", ~F.coalesce(F.col("status"), F.lit("")).isin(*STATUSES)),
        ("bad-date", F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd")).isNull()),
        ("tag-count", ~F.size(tags).between(2, 5)),
        ("tag-form", F.exists(tags, lambda t: ~t.rlike(r"\A[a-z0-9/-]+\z"))),
        ("file-name", ~name.rlike(r"\A(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:-[a-z0-9-]+)?|MOC-[a-z0-9-]+|[a-z0-9]+(?:-[a-z0-9]+)*)\z")),
        ("no-related", ~F.col("content").rlike(r"(?:\A|\n)## Related\n[^#]*\[\[")),
    ]
    found = F.concat_ws(",", *(F.when(failed, F.lit(k)) for k, failed in checks))
    return rows.select("source", found.alias("problems")).where("problems <> ''")


def map_candidates(notes: DataFrame, files: int = 5, folders: int = 2) -> DataFrame:
    """(kind, name, n): folders with enough files, and topic tags (without prefix) in enough folders."""
    folder = F.regexp_replace("source", r"/[^/]*\z", "")
    by_folder = notes.groupBy(folder.alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= files)
    tagged = with_fields(notes).select(folder.alias("folder"), F.explode("tags").alias("name")).where(~F.col("name").contains("/")).distinct()
    by_topic = tagged.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= folders)
    return by_folder.select(F.lit("folder").alias("kind"), "name", "n").unionByName(by_topic.select(F.lit("topic").alias("kind"), "name", "n"))


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "type string, folder string")


def routed(notes: DataFrame) -> DataFrame:
    """(source, type, destination, tag): the folder of the type (or the one for the unrouted, with a tag that says so) and the name, with -v2, -v3... where it is taken.

    Names in a folder are counted by (folder, name), which one source or type alone cannot make hot."""
    from pyspark.sql import Window

    rows = with_fields(notes).select("source", "type", slug_name(F.col("source")).alias("name"))
    placed = rows.join(F.broadcast(routes(notes.sparkSession)), "type", "left").withColumn("folder", F.coalesce("folder", F.lit(UNROUTED)))
    number = F.row_number().over(Window.partitionBy("folder", "name").orderBy("source"))
    placed = placed.withColumn("n", number)
    end = F.when(F.col("n") > 1, F.concat(F.lit("-v"), F.col("n"))).otherwise("")
    tag = F.when(F.col("folder") == UNROUTED, F.lit(NEEDS_ROUTING)).otherwise("")
    return placed.select("source", "type", F.concat("folder", "name", end, F.lit(".md")).alias("destination"), tag.alias("tag"))


def map_lint(notes: DataFrame) -> DataFrame:
    """(source, problems) of maps of content (MOC-... or of type moc): what breaks their rules, comma-joined; maps without any go.

    Entries are lines that begin with "- ": each has a link and a description behind it. No section is empty, none links
    templates or rules; a section of related maps links one, and recent updates have a date."""
    rows = with_fields(notes).where((F.col("type") == "moc") | slug_name(F.col("source")).startswith("MOC-"))
    entries = F.filter(F.split("content", "\n"), lambda x: x.startswith("- "))
    checks = [
        ("bare-entry", F.exists(entries, lambda x: ~x.rlike(r"\[\[[^\[\]]+\]\]"))),
        ("no-description", F.exists(entries, lambda x: x.rlike(r"\[\[[^\[\]]+\]\]\s*$"))),
        ("empty-section", F.col("content").rlike(r"(?:^|\n)## [^\n]*\n\s*(?:\n## |$)")),
        ("links-rules", F.col("content").rlike(r"\[\[(?:[^\[\]]*/)?(?:templates|rules)/")),
        ("no-related-maps", ~F.col("content").rlike(r"(?:^|\n)## Related MOCs\n[^#]*\[\[MOC-")),
        ("no-recent-updates", ~F.col("content").rlike(r"(?:^|\n)## Recent Updates\n[^#]*[0-9]{4}-[0-9]{2}-[0-9]{2}")),
    ]
    found = F.concat_ws(",", *(F.when(failed, F.lit(k)) for k, failed in checks))
    return rows.select("source", found.alias("problems")).where("problems <> ''")


def session_scan(turns: DataFrame) -> DataFrame:
    """(conv_id, category, folder, n_turns) for each category of which a word stands in a turn of a conversation.

    A turn in which a command only looked around (LOOKS_AROUND) is in no category of errors."""
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    looks = F.lower("text").rlike(LOOKS_AROUND)
    tests = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, cues))) & (~looks if c == CATEGORIES[0][0] else F.lit(True)), F.struct(F.lit(c).alias("category"), F.lit(f).alias("folder"))) for c, f, cues in CATEGORIES]
    found = turns.where("text is not null").select("conv_id", F.explode(F.array_compact(F.array(*tests))).alias("hit"))
    return found.groupBy("conv_id", "hit.category", "hit.folder").agg(F.count("*").alias("n_turns"))


def session_reports(turns: DataFrame) -> DataFrame:
    """(conv_id, items, complex): "category:n" of each conversation, sorted, and whether it needs a log of its own."""
    items = session_scan(turns).groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("category", F.lit(":"), F.col("n_turns")))), ", ").alias("items"))  # CATEGORIES at most
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    return sizes.join(items, "conv_id", "left").select("conv_id", F.coalesce("items", F.lit("")).alias("items"), (F.col("n") > COMPLEX_TURNS).alias("complex"))
