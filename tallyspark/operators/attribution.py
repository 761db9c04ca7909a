"""Attribution of checkpoints to projects by prioritised evidence over the thread lineage.

Evidence is tables: activity (thread, turn, repository), own remotes of threads, manual and local mappings, and
hints that come from other threads of the lineage. The cascade itself is one CASE expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..work import Scratch
from .tour import descendant_agreement, euler_tour, nearest_label


def activity_evidence(activity: DataFrame) -> DataFrame:
    """activity(checkpoint, repository, mapped array<string>, canonical, ambiguous boolean) -> one row per
    checkpoint: n_repositories, activity_kind, activity_identity, activity_candidates.

    A repository's ids are its mapped ones, else its canonical remote. Unresolved is a checkpoint with a repository
    of not just one id or with an ambiguous remote.
    """
    repo = activity.groupBy("checkpoint", "repository").agg(
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("mapped", F.array().cast("array<string>"))))).alias("mapped"),
        F.collect_set("canonical").alias("remotes"),
        F.bool_or(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"),
    )
    ids = F.when(F.size("mapped") > 0, F.col("mapped")).otherwise(F.col("remotes"))
    repo = repo.select("checkpoint", "repository", ids.alias("ids"), ((F.size(ids) != 1) | F.col("ambiguous")).alias("open"), (F.size("mapped") == 0).alias("by_remote"))
    turn = repo.groupBy("checkpoint").agg(F.count("*").alias("n_repositories"), F.bool_or("open").alias("open"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"), F.bool_or("by_remote").alias("by_remote"))
    n, found = F.col("n_repositories"), F.size("ids")
    kind = (
        F.when(F.col("open") & (n == 1) & (found == 0), F.lit(None).cast("string"))
        .when(F.col("open") & (n == 1), F.lit("ambiguous_remote"))
        .when(F.col("open") | (found > 1), F.lit("ambiguous_multi_repo"))
        .when(F.col("by_remote"), F.lit("activity_git"))
        .otherwise(F.lit("local_mapping"))
    )
    identity = F.when(kind.isin("activity_git", "local_mapping"), F.get("ids", F.lit(0)))
    return turn.select("checkpoint", "n_repositories", kind.alias("activity_kind"), identity.alias("activity_identity"), F.col("ids").alias("activity_candidates"))


def cascade(rows: DataFrame) -> DataFrame:
    """Adds project_identity and project_resolution; the first rule that applies decides.

    rows: manual_project, activity_kind, activity_identity, self_kind, self_canonical, ancestor_project, root_project,
    descendant_projects (array), local_project. A null activity_kind is no decision; an ambiguous own remote stops.
    """
    one = F.array_distinct(F.array_compact(F.coalesce("descendant_projects", F.array().cast("array<string>"))))
    steps = [
        (F.col("manual_project").isNotNull(), "manual", F.col("manual_project")),
        (F.col("activity_kind").isNotNull(), None, F.col("activity_identity")),
        (F.col("self_canonical").isNotNull() & (F.col("self_kind") == "self_origin"), "self_origin", F.col("self_canonical")),
        (F.col("self_canonical").isNotNull(), "unique_remote", F.col("self_canonical")),
        (F.col("self_kind") == "ambiguous_remote", "ambiguous_remote", F.lit(None).cast("string")),
        (F.col("ancestor_project").isNotNull(), "ancestor", F.col("ancestor_project")),
        (F.col("root_project").isNotNull(), "root", F.col("root_project")),
        (F.size(one) == 1, "descendant_consensus", F.get(one, F.lit(0))),
        (F.col("local_project").isNotNull(), "local_mapping", F.col("local_project")),
    ]
    identity, reason = F.lit(None).cast("string"), F.lit("unclassified")
    for test, name, value in reversed(steps):
        identity = F.when(test, value).otherwise(identity)
        reason = F.when(test, F.col("activity_kind") if name is None else F.lit(name)).otherwise(reason)
    return rows.withColumns({"project_identity": identity, "project_resolution": reason})


def own_hints(direct: DataFrame) -> DataFrame:
    """direct(thread_id, identity) of checkpoints or threads -> thread_id, hint: the single identity, null for several."""
    low, high = F.min("identity"), F.max("identity")
    return direct.where("identity is not null").groupBy("thread_id").agg(F.when(low == high, low).alias("hint"))


def thread_hints(direct: DataFrame, tour: DataFrame, work: Scratch) -> DataFrame:
    """direct: see own_hints; tour: see euler_tour -> (thread_id, hint).

    A thread hints at its single distinct identity. One that has none takes the single hint among its
    descendants; one that has several gives none.
    """
    own = work.save(own_hints(direct), "own-hints")
    sure = own.where("hint is not null")
    return sure.unionByName(_borrowed(own, _agreed_below(sure, tour, work)))


def _agreed_below(sure: DataFrame, tour: DataFrame, work: Scratch) -> DataFrame:
    """(thread_id, hint) where all descendants that have a hint of their own have the same. What silent ones borrow is
    below them as well, so it changes nothing here."""
    found = descendant_agreement(tour, sure.select(F.col("thread_id").alias("node"), F.col("hint").alias("label")), work)
    return work.save(found.where("label is not null").select(F.col("node").alias("thread_id"), F.col("label").alias("hint")), "agreed")


def _borrowed(own: DataFrame, agreed: DataFrame) -> DataFrame:
    return agreed.join(own.select("thread_id"), "thread_id", "left_anti")


def lineage_hints(threads: DataFrame, parents: DataFrame, roots: DataFrame, direct: DataFrame, work: Scratch) -> DataFrame:
    """threads(thread_id) with ancestor_project (nearest hint), root_project (if the root is another thread) and
    descendant_projects (the one that all hints below agree on, or none). No step writes a thread's ancestors out."""
    edges = work.save(parents.select(F.col("child").alias("src"), F.col("parent").alias("dst")), "lineage-edges")
    own = work.save(own_hints(direct), "own-hints")
    sure = own.where("hint is not null")
    agreed = _agreed_below(sure, euler_tour(edges, work), work)
    hints = work.save(sure.unionByName(_borrowed(own, agreed)), "hints")
    up = nearest_label(edges, hints.select(F.col("thread_id").alias("node"), F.col("hint").alias("label")), work).select(F.col("node").alias("thread_id"), F.col("label").alias("ancestor_project"))
    down = agreed.select("thread_id", F.array("hint").alias("descendant_projects"))
    root = roots.where("root <> thread_id").join(hints.select(F.col("thread_id").alias("root"), F.col("hint").alias("root_project")), "root").select("thread_id", "root_project")
    return threads.select("thread_id").distinct().join(up, "thread_id", "left").join(root, "thread_id", "left").join(down, "thread_id", "left")


def attribute(checkpoints: DataFrame, *, activity: DataFrame, self_remotes: DataFrame, parents: DataFrame, roots: DataFrame, manual: DataFrame, local: DataFrame, work: Scratch, manual_turns: DataFrame | None = None) -> DataFrame:
    """checkpoints(checkpoint, thread_id, ...) with project_identity, project_resolution and
    activity_repository_count.

    self_remotes(thread_id, self_kind, self_canonical); manual(thread_id, manual_project); local(thread_id,
    local_project); activity: see activity_evidence. manual_turns(turn_id, manual_turn): goes before the thread's.
    """
    rows = checkpoints.join(activity_evidence(activity), "checkpoint", "left").join(self_remotes, "thread_id", "left").join(manual, "thread_id", "left").join(local, "thread_id", "left")
    if manual_turns is not None:
        rows = rows.join(manual_turns, "turn_id", "left").withColumn("manual_project", F.coalesce("manual_turn", "manual_project")).drop("manual_turn")
    rows = work.save(rows, "evidence")
    none = {"ancestor_project": F.lit(None).cast("string"), "root_project": F.lit(None).cast("string"), "descendant_projects": F.array().cast("array<string>")}
    direct = cascade(rows.withColumns(none)).where("project_identity is not null").select("thread_id", F.col("project_identity").alias("identity"))
    silent = self_remotes.join(manual, "thread_id", "full").join(local, "thread_id", "full").join(checkpoints.select("thread_id"), "thread_id", "left_anti")
    extra = silent.select("thread_id", F.coalesce("manual_project", "self_canonical", "local_project").alias("identity")).where("identity is not null")
    threads = checkpoints.select("thread_id").unionByName(parents.select(F.col("child").alias("thread_id"))).unionByName(parents.select(F.col("parent").alias("thread_id")))
    hints = lineage_hints(threads, parents, roots, direct.unionByName(extra), work)
    done = cascade(rows.join(hints, "thread_id", "left"))
    return done.select(*checkpoints.columns, "project_identity", "project_resolution", F.coalesce("n_repositories", F.lit(0)).alias("activity_repository_count"))
