"""Repositories, commits, dependencies and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import extension
from tarn.session import checkpointed

# Commits of a history by default and at most.
HISTORY, MOST_HISTORY = 100, 1000


def extension_statistics(files: DataFrame, path: str = "file_path", size: str = "size") -> DataFrame:
    """(ext, n, size), most frequent first."""
    return files.groupBy(F.coalesce(F.lower(extension(F.col(path))), F.lit("no_extension")).alias("ext")).agg(F.count("*").alias("n"), F.sum(size).alias("size")).orderBy(F.desc("n"), "ext")


def repository_rollup(repos: DataFrame) -> DataFrame:
    """One row of counts over repositories (present, needs_sync, dirty, n_files, size)."""
    return repos.agg(F.count("*").alias("n"), F.count_if("present").alias("n_present"), F.count_if("needs_sync").alias("n_needs_sync"), F.count_if("dirty").alias("n_dirty"), F.sum("n_files").alias("n_files"), F.sum("size").alias("size"))


def orphans(configured: DataFrame, found: DataFrame, key: str = "name") -> DataFrame:
    """(name, status): folders that no configuration names (orphan) and repositories without a folder (missing)."""
    left = found.join(configured, key, "left_anti").select(key, F.lit("orphan").alias("status"))
    return left.union(configured.join(found, key, "left_anti").select(key, F.lit("missing").alias("status")))


def dependency_edges(edges: DataFrame, repos: DataFrame, key: str = "name") -> DataFrame:
    """``edges`` (source, target) whose two ends are repositories and differ."""
    known = repos.select(key).distinct()
    return edges.where("source <> target").join(known.withColumnRenamed(key, "source"), "source").join(known.withColumnRenamed(key, "target"), "target").select("source", "target").distinct()


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(name, depth): breadth-first from ``start`` (name) along ``edges``, ``depth`` steps at most, fewer if nothing is new.

    Each step's rows are settled before the next, so a plan reads them and not all that led to them.
    """
    seen = front = checkpointed(start.select("name", F.lit(0).alias("depth")).distinct())
    for step in range(1, depth + 1):
        met = edges.join(front.select(F.col("name").alias("source")), "source").select(F.col("target").alias("name")).distinct()
        front = checkpointed(met.join(seen.select("name"), "name", "left_anti").withColumn("depth", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def history(commits: DataFrame, since: Column | None = None, until: Column | None = None, author: str | None = None, path: str | None = None, commit_files: DataFrame | None = None, most: int = HISTORY) -> DataFrame:
    """Commits, newest first: within times (inclusive), by a part of an author's name or address, touching a path."""
    if since is not None:
        commits = commits.where(F.col("ts") >= since)
    if until is not None:
        commits = commits.where(F.col("ts") <= until)
    if author is not None:
        commits = commits.where(F.col("author").contains(author) | F.col("email").contains(author))
    if path is not None and commit_files is not None:
        commits = commits.join(commit_files.where(F.col("path") == path).select("id").distinct(), "id", "left_semi")
    return commits.orderBy(F.desc("ts"), "id").limit(min(most, MOST_HISTORY))


def task_filter(tasks: DataFrame, **wanted) -> DataFrame:
    """Tasks that meet all that is asked for: status, task_type, priority, workspace_id (equal), tags (any), text (in title
    or description), due_before, due_after, created_before, created_after (tasks without the date do not)."""
    for name in ("status", "task_type", "priority", "workspace_id"):
        if wanted.get(name) is not None:
            tasks = tasks.where(F.col(name) == wanted[name])
    if wanted.get("tags"):
        tasks = tasks.where(F.arrays_overlap("tags", F.array(*map(F.lit, wanted["tags"]))))
    if wanted.get("text"):
        q = wanted["text"].lower()
        tasks = tasks.where(F.lower("title").contains(q) | F.lower("description").contains(q))
    for name, column in (("due", "due_date"), ("created", "created_at")):
        if wanted.get(f"{name}_before") is not None:
            tasks = tasks.where(F.col(column) < wanted[f"{name}_before"])
        if wanted.get(f"{name}_after") is not None:
            tasks = tasks.where(F.col(column) > wanted[f"{name}_after"])
    return tasks


def overdue(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.where((F.col("due_date") < now) & ~F.col("status").isin("Completed", "Cancelled"))


def ready(tasks: DataFrame) -> DataFrame:
    """Pending tasks all of whose dependencies are complete."""
    needs = tasks.where("status = 'Pending'").select("task_id", F.explode("dependencies").alias("need"))
    done = tasks.where("status = 'Completed'").select(F.col("task_id").alias("need"))
    blocked = needs.join(done, "need", "left_anti").select("task_id").distinct()
    return tasks.where("status = 'Pending'").join(blocked, "task_id", "left_anti")


def task_search(tasks: DataFrame, query: str, now: Column, limit: int = 10) -> DataFrame:
    """(task_id, score) of the best tasks for a query; those that it does not touch are not among them."""
    q = query.lower()
    title, text, tags = F.lower("title").contains(q), F.lower("description").contains(q), F.exists("tags", lambda t: F.lower(t).contains(q))
    part = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    late = (F.col("due_date") < now) & ~F.col("status").isin("Completed", "Cancelled")
    score = 1 + part(title, 0.5) + part(text, 0.3) + part(tags, 0.2) + F.when(F.col("priority") == "Critical", 0.4).when(F.col("priority") == "High", 0.2).otherwise(0.0) + part(late, 0.3)
    found = tasks.where(F.coalesce(title, F.lit(False)) | F.coalesce(text, F.lit(False)) | F.coalesce(tags, F.lit(False)))
    return found.select("task_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "task_id").limit(limit)


# Minutes of the units of a schedule (a month is 30 days).
UNIT_MINUTES = {"minutes": 1, "hours": 60, "days": 1440, "weeks": 10_080, "monthly": 43_200}


def next_run(last: Column, every: Column, unit: str) -> Column:
    return last + F.make_dt_interval(F.lit(0), F.lit(0), (every * UNIT_MINUTES[unit]).cast("int"))


def occurrences(schedules: DataFrame, most: int) -> DataFrame:
    """(id, n, at): runs of schedules (id, start, end, minutes) from start to end, ``most`` at most."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes").cast("int"))
    runs = F.slice(F.sequence("start", "end", step), 1, most)
    return schedules.select("id", F.posexplode(runs).alias("n", "at"))
