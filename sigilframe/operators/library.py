"""The library: papers, folders, memberships, searches, and batch changes as table-to-table steps.

Tables do not change in place: a command validates its whole batch, and returns the new version of a
table for the caller to publish.  Keys join by equality, so each command is one or two shuffles of the
smaller tables; the planner broadcasts what it knows to be small.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import columns as X
from ..sources.documents import validated

#: Fixed value: ids per batch command.
MAX_BATCH = 512


class Rejected(ValueError):
    """A batch that breaks a rule changes nothing."""


def _require(bad: DataFrame, why: str) -> None:
    rows = bad.take(1)
    if rows:
        raise Rejected(f"{why}: {rows[0]}")


def _checked_batch(ids: DataFrame, known: DataFrame, key: str) -> None:
    n = ids.limit(MAX_BATCH + 1).count()
    if n > MAX_BATCH:
        raise Rejected(f"more than {MAX_BATCH} ids")
    _require(ids.groupBy(key).count().filter("count > 1"), "an id repeats")
    _require(ids.join(known, key, "left_anti"), "an id is not known")


# Queries -------------------------------------------------------------------------------------


def search(papers: DataFrame, query: str, membership: DataFrame | None = None, folder_id: str | None = None) -> DataFrame:
    """Papers of a folder whose title, authors and venue contain the query, in any case; an empty query matches all."""
    if folder_id is not None:
        papers = papers.join(membership.filter(F.col("folder_id") == folder_id).select("paper_id").distinct(), "paper_id", "left_semi")
    text = F.lower(F.concat_ws(" ", "title", "authors", "venue"))
    return papers.filter(F.contains(text, F.lit(query.strip().lower()))) if query.strip() else papers


def badge_counts(folders: DataFrame, membership: DataFrame, papers: DataFrame) -> DataFrame:
    """(folder_id, papers): members that still exist."""
    alive = membership.join(papers.select("paper_id"), "paper_id", "left_semi").groupBy("folder_id").agg(F.countDistinct("paper_id").alias("papers"))
    return folders.select("folder_id").join(alive, "folder_id", "left").na.fill(0, ["papers"])


def library_totals(papers: DataFrame, symbols: Column) -> DataFrame:
    """papers, symbols, and pending (progress below 100) padded to two digits."""
    pending = F.count_if(F.coalesce("progress", F.lit(0)) < 100)
    return papers.agg(F.count("*").alias("papers"), F.coalesce(F.sum(symbols), F.lit(0)).alias("symbols"), F.lpad(pending.cast("string"), F.greatest(F.lit(2), F.length(pending.cast("string"))), F.lit("0")).alias("pending"))


def selectable(papers: DataFrame) -> DataFrame:
    return papers.filter(F.coalesce("parseStatus", F.lit("")) != "parsing")


def all_selected(visible: DataFrame, selection: DataFrame) -> DataFrame:
    """One row: whether every visible paper that can be selected is."""
    chosen = selection.select("paper_id", F.lit(True).alias("chosen")).distinct()
    return selectable(visible).join(chosen, "paper_id", "left").agg(F.coalesce(F.bool_and(F.coalesce("chosen", F.lit(False))) & (F.count("*") > 0), F.lit(False)).alias("all_selected"))


def toggled(selection: DataFrame, ids: DataFrame) -> DataFrame:
    """Selected ids leave, others enter."""
    return selection.join(ids, "paper_id", "left_anti").union(ids.join(selection, "paper_id", "left_anti"))


def occurrences_on_page(occurrences: DataFrame, page: int) -> DataFrame:
    """Occurrences of a page with identity and style, whichever name the identity is stored under."""
    return occurrences.filter(F.col("page") == page)


def identity(row: str = "") -> Column:
    c = lambda x: F.col(f"{row}.{x}" if row else x)
    return F.coalesce(c("identityKey"), c("identity_key"), c("surface"))


def first_symbol_at(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each occurrence the first symbol of its paper with the same identity."""
    hit = occurrences.select("paper_id", "identity_key", "token_id").join(symbols.select("paper_id", "identity_key", "ordinal", F.col("id").alias("symbol_id")), ["paper_id", "identity_key"])
    return hit.groupBy("paper_id", "token_id").agg(F.min_by("symbol_id", "ordinal").alias("symbol_id"))


def visible_occurrences(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Occurrences of a page that belong to some symbol of the paper, by whichever name the identity is stored under."""
    named = symbols.select("paper_id", identity().alias("key")).distinct()
    return occurrences.withColumn("key", identity()).join(named, ["paper_id", "key"], "left_semi").drop("key")


def others_with_counts(symbols: DataFrame, symbol_id: str | Column) -> DataFrame:
    """All symbols but the one shown; a Column tells it for each paper."""
    return symbols.filter(F.col("id") != symbol_id).select("id", "surface", "occurrences")


# Folders -------------------------------------------------------------------------------------


def create_folders(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """folders plus ``wanted`` (folder_id, name); every trimmed name must be valid and in no case taken, or nothing changes."""
    new = wanted.withColumn("name", X.trim_all("name")).withColumn("key", F.lower("name"))
    _require(new.filter(~F.coalesce(X.valid_folder_name("name"), F.lit(False))), "not a folder's name")
    _require(new.groupBy("key").count().filter("count > 1"), "a name repeats")
    _require(new.join(folders.select(F.lower("name").alias("key")).distinct(), "key", "left_semi"), "a name is taken")
    return folders.select("folder_id", "name").unionByName(new.select("folder_id", "name"))


def free_names(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` that create_folders() takes: the first of each valid name that no folder has."""
    new = wanted.withColumn("name", X.trim_all("name")).filter(X.valid_folder_name("name")).withColumn("key", F.lower("name"))
    new = new.join(folders.select(F.lower("name").alias("key")).distinct(), "key", "left_anti")
    return new.groupBy("key").agg(F.min_by("name", "folder_id").alias("name"), F.min("folder_id").alias("folder_id")).select("folder_id", "name")


def delete_folder(folders: DataFrame, membership: DataFrame, folder_id: str) -> tuple[DataFrame, DataFrame]:
    """The folder goes with its memberships; its papers stay."""
    return folders.filter(F.col("folder_id") != folder_id), membership.filter(F.col("folder_id") != folder_id)


def remove_from_folder(membership: DataFrame, folder_id: str, ids: DataFrame) -> DataFrame:
    """All ids must be members, none twice; else nothing changes."""
    members = membership.filter(F.col("folder_id") == folder_id).select("paper_id")
    _checked_batch(ids, members, "paper_id")
    gone = ids.select("paper_id", F.lit(folder_id).alias("folder_id"))
    return membership.join(gone, ["folder_id", "paper_id"], "left_anti")


def membership_diff(current: DataFrame, desired: DataFrame) -> DataFrame:
    """(folder_id, paper_id, change): what to insert and what to delete to get from one to the other."""
    keys = ["folder_id", "paper_id"]
    both = current.select(*keys, F.lit(True).alias("has")).join(desired.select(*keys, F.lit(True).alias("wants")).distinct(), keys, "full_outer")
    return both.filter("has is null or wants is null").select(*keys, F.when(F.col("has").isNull(), "insert").otherwise("delete").alias("change"))


def set_paper_folders(membership: DataFrame, folders: DataFrame, paper_id: str, desired: DataFrame) -> DataFrame:
    """Replace one paper's memberships; every wanted folder must exist."""
    _require(desired.join(folders, "folder_id", "left_anti"), "no such folder")
    own = desired.select("folder_id", F.lit(paper_id).alias("paper_id")).distinct()
    return membership.filter(F.col("paper_id") != paper_id).select("folder_id", "paper_id").unionByName(own)


def add_references(membership: DataFrame, folders: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent; a membership of a folder that is gone is passed over."""
    keys = ["folder_id", "paper_id"]
    new = new.select(*keys).distinct().join(folders, "folder_id", "left_semi").join(membership, keys, "left_anti")
    return membership.select(*keys).unionByName(new)


def replace_id(membership: DataFrame, old: str, new: str) -> DataFrame:
    """A placeholder's id becomes the real one."""
    return membership.withColumn("paper_id", F.when(F.col("paper_id") == old, new).otherwise(F.col("paper_id"))).distinct()


def as_arrays(membership: DataFrame) -> DataFrame:
    return membership.groupBy("folder_id").agg(F.array_sort(F.collect_set("paper_id")).alias("paper_ids"))


# Papers --------------------------------------------------------------------------------------


def rename_papers(papers: DataFrame, titles: DataFrame) -> DataFrame:
    _require(titles.filter(~X.valid_title("title")), "not a title")
    new = titles.select("paper_id", X.trim_all("title").alias("new_title"))
    return papers.join(new, "paper_id", "left").withColumn("title", F.coalesce("new_title", "title")).drop("new_title")


def delete_papers(papers: DataFrame, membership: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the papers, in both tables."""
    return papers.join(ids, "paper_id", "left_anti"), membership.join(ids, "paper_id", "left_anti")


def delete_outcome(requests: DataFrame, papers: DataFrame) -> DataFrame:
    """requests: (ordinal, paper_id).  Per distinct id, by first request: deleted, or why not."""
    first = requests.groupBy("paper_id").agg(F.min("ordinal").alias("ordinal"))
    known = papers.select("paper_id", F.lit(True).alias("known"))
    result = F.when(~X.safe_paper_id("paper_id"), "unsafe").when(F.col("known"), "deleted").otherwise("missing")
    return first.join(known, "paper_id", "left").select("ordinal", "paper_id", result.alias("outcome"))


def upsert_positions(positions: DataFrame, new: DataFrame) -> DataFrame:
    """The reading page of each paper; new rows win."""
    return positions.join(new, "paper_id", "left_anti").unionByName(new.select(positions.columns))


# Meanings ------------------------------------------------------------------------------------


def last_updates(updates: DataFrame) -> DataFrame:
    """updates: (ordinal, id, meaning): the last of each id."""
    return updates.groupBy("id").agg(F.max_by("meaning", "ordinal").alias("meaning"))


def update_meanings(symbols: DataFrame, updates: DataFrame, provider: str = "remote") -> DataFrame:
    """All updates must be valid; unknown ids are passed over; the last of an id wins."""
    if updates.limit(MAX_BATCH + 1).count() > MAX_BATCH:
        raise Rejected(f"more than {MAX_BATCH} updates")
    _require(updates.filter(~F.coalesce(X.valid_meaning("id", X.trim_all("meaning")), F.lit(False))), "not a valid update")
    source = provider if provider in ("qwen", "deepseek") else "remote"
    return apply_meanings(symbols, last_updates(updates), source)


def update_paper_meanings(papers: DataFrame, symbols: DataFrame, paper_id: str, updates: DataFrame, provider: str = "remote") -> tuple[DataFrame, DataFrame]:
    """(papers, symbols): the paper is marked as one whose meanings a model gave, even where no id is known."""
    new = update_meanings(symbols.filter(F.col("paper_id") == paper_id), updates, provider)
    used = F.col("llm_used") if "llm_used" in papers.columns else F.lit(False)
    marked = papers.withColumn("llm_used", F.coalesce(used, F.lit(False)) | (F.col("paper_id") == paper_id))
    return marked, symbols.filter(F.col("paper_id") != paper_id).unionByName(new.select(symbols.columns))


def apply_meanings(symbols: DataFrame, last: DataFrame, source: str) -> DataFrame:
    new = last.select("id", X.trim_all("meaning").alias("new_meaning"))
    hit = F.col("new_meaning").isNotNull()
    out = symbols.join(new, "id", "left")
    return out.withColumn("meaning", F.coalesce("new_meaning", "meaning")).withColumn("meaning_source", F.when(hit, source).otherwise(F.col("meaning_source"))).drop("new_meaning")


def page_navigation(history: DataFrame) -> DataFrame:
    """history: (paper_id, ordinal, page): each visit with the page to go back to, the one just before it."""
    return history.withColumn("back", F.lag("page").over(Window.partitionBy("paper_id").orderBy("ordinal")))


# Stored tables -------------------------------------------------------------------------------

_VERSION = "version="


def _files(spark, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _versions(spark, path: str) -> list[int]:
    """Whole versions of a stored table: those whose writer has put its mark."""
    files, target = _files(spark, path)
    names = [(s.getPath().getName(), s.getPath()) for s in files.listStatus(target)] if files.exists(target) else []
    mark = lambda at: files.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))
    return sorted(int(name.removeprefix(_VERSION)) for name, at in names if name.startswith(_VERSION) and mark(at))


def publish(table: DataFrame, path: str, keep: int = 2) -> int:
    """Write a new version beside the old ones and return its number; readers see it once its mark is there.

    The table may be read from the version before, which stays; versions older than the last ``keep`` go.
    """
    spark = table.sparkSession
    number = max(_versions(spark, path), default=0) + 1
    table.write.mode("overwrite").parquet(f"{path}/{_VERSION}{number}")
    for old in _versions(spark, path)[:-keep]:
        files, target = _files(spark, f"{path}/{_VERSION}{old}")
        files.delete(target, True)
    return number


def read_store(spark, path: str, schema: str) -> DataFrame:
    """The last whole version of a stored table; empty where nothing was stored yet, an error where it is not readable."""
    versions = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{_VERSION}{versions[-1]}") if versions else spark.createDataFrame([], schema)


def import_papers(files: DataFrame, parse, root: str) -> tuple[DataFrame, DataFrame]:
    """Stage, validate and publish a batch of papers; (imported ids, files turned away with their ``error``).

    files: (paper_id, content, pages, pages_check); ``parse`` makes documents (paper_id, ...) of the good ones.
    The batch is staged below ``root`` and becomes a new version of the store at once, older papers
    included; whatever fails before that leaves the store as it was and no staged file behind.
    """
    spark = files.sparkSession
    checked = validated(files).withColumn("error", F.when(~X.safe_paper_id("paper_id"), "unsafe").otherwise(F.col("error")))
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    try:
        parse(checked.filter("error is null").drop("error")).write.parquet(staged)
        new = spark.read.parquet(staged)
        _require(new.filter(~X.safe_paper_id("paper_id")), "a parsed paper has no safe id")
        _require(new.groupBy("paper_id").count().filter("count > 1"), "a paper is parsed twice")
        old = read_store(spark, f"{root}/papers", new.schema)
        publish(old.join(new.select("paper_id"), "paper_id", "left_anti").unionByName(new), f"{root}/papers")
        ids = spark.createDataFrame(new.select("paper_id").toArrow()) if new.limit(MAX_BATCH + 1).count() <= MAX_BATCH else read_store(spark, f"{root}/papers", new.schema).join(files.select("paper_id"), "paper_id", "left_semi").select("paper_id")
    finally:
        fs, target = _files(spark, staged)
        fs.delete(target, True)
    return ids, checked.filter("error is not null").select("paper_id", "error")


def settle_imports(pending: DataFrame, outcomes: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending, membership) after outcomes (paper_id, real_id, error) of placeholders.

    Imported placeholders leave and their memberships take the real id; failed ones stay with the error;
    rows whose placeholder was deleted while it was parsed are purged, real id included.
    """
    done = outcomes.filter("error is null").select("paper_id", "real_id")
    known = pending.select("paper_id")
    failed = outcomes.filter("error is not null").select("paper_id", F.col("error").alias("why"))
    left = pending.join(done.select("paper_id"), "paper_id", "left_anti").join(failed, "paper_id", "left")
    left = left.withColumn("error", F.coalesce("why", "error")).withColumn("state", F.when(F.col("why").isNotNull(), "failed").otherwise(F.col("state"))).drop("why")
    own = done.join(known, "paper_id", "left_semi")
    gone = done.join(known, "paper_id", "left_anti").select(F.explode(F.array("paper_id", "real_id")).alias("paper_id"))
    members = membership.join(gone, "paper_id", "left_anti").join(own, "paper_id", "left").withColumn("paper_id", F.coalesce("real_id", "paper_id"))
    return left, members.select(membership.columns).distinct()
