"""Keyed writes as new tables: upserts, reconciliation, deletes and the vector store's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import edge_allowed, with_ends
from ..shared import dealt


def reconcile(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Each key's state: inserted, updated (digest differs), unchanged or obsolete; rows are the new ones, else the old."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    missing_a, missing_b = F.col(f"a.{key}").isNull(), F.col(f"b.{key}").isNull()
    state = F.when(missing_a, "inserted").when(missing_b, "obsolete").when(F.col(f"a.{digest}") != F.col(f"b.{digest}"), "updated").otherwise("unchanged")
    # An unchanged digest keeps the old row whole, its line numbers too.
    keep_old = ~missing_a & (missing_b | (F.col(f"a.{digest}") == F.col(f"b.{digest}")))
    # When a row was made does not change as it is written over.
    kept = lambda c: ~missing_a if c == "created_at" else keep_old
    columns = [F.when(kept(c), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in old.columns]
    return both.select(state.alias("state"), *columns)


def upsert(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """The table after writing ``new`` over ``old``; obsolete rows stay until they are deleted."""
    return reconcile(old, new, key, digest).drop("state")


def judged_edges(edges: DataFrame, nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """(src_id, kind, dst_id, cause), distinct: why an edge is not written, a missing end, then an unlawful pair of kinds; null for those that are."""
    met = with_ends(dealt(edges.select("src_id", "kind", "dst_id"), parts, "src_id").distinct(), nodes.select("node_id", "kind"), parts)
    cause = F.when(F.col("src_kind").isNull() | F.col("dst_kind").isNull(), "missing").when(~edge_allowed(F.col("src_kind"), F.col("kind"), F.col("dst_kind")), "rule")
    return met.select("src_id", "kind", "dst_id", cause.alias("cause"))


def write_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges that are written, (src_id, kind, dst_id, cause) of those that are not)."""
    judged = judged_edges(edges, nodes)
    return judged.filter("cause is null").drop("cause"), judged.filter("cause is not null")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new units with ``changed``: new or of another digest, or in a file that lost a unit, whose rows are all written anew."""
    lost = old.select("unit_id", "repo_id", "file_path").join(new.select("unit_id"), "unit_id", "left_anti").select("repo_id", "file_path").distinct().withColumn("lost", F.lit(True))
    before = old.select("unit_id", F.col("source_sha").alias("before"))
    held = new.join(before, "unit_id", "left").join(lost, ["repo_id", "file_path"], "left")
    return held.withColumn("changed", F.coalesce("lost", F.lit(False)) | F.col("before").isNull() | (F.col("before") != F.col("source_sha"))).drop("lost", "before")


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, the last by ``order``."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*key, "row.*")


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, the first by ``order``."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*key, "row.*")


def with_placeholders(points: DataFrame, dim: int) -> DataFrame:
    """Points without a vector get zeros and has_vector = false."""
    if dim <= 0:
        raise ValueError("a collection needs a dimension above 0")
    return points.withColumn("has_vector", F.col("vector").isNotNull()).withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0).cast("float"), dim)))


def ensure_collections(there: DataFrame, wanted: DataFrame) -> DataFrame:
    """(collection, dim, state, n_left) of ``wanted`` (collection, dim), given what is ``there`` (and n_points): one of another length is made anew and has no points then."""
    held = there.select("collection", F.col("dim").alias("_dim"), "n_points")
    state = F.when(F.col("_dim").isNull(), "created").when(F.col("_dim") == F.col("dim"), "kept").otherwise("recreated")
    met = wanted.select("collection", "dim").join(held, "collection", "left").withColumn("state", state)
    return met.select("collection", "dim", "state", F.when(F.col("state") == "kept", F.col("n_points")).otherwise(0).cast("long").alias("n_left"))


def delete_files(table: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose (repo_id, file_path) is not among ``files``."""
    return table.join(files.select("repo_id", "file_path"), ["repo_id", "file_path"], "left_anti")


def registry_state(writes: DataFrame) -> DataFrame:
    """The registry after all ``writes`` (at, repo_id, op, path, url, branch, sha, message) in order of ``at``, a row a repository.

    ``local`` and ``managed`` make a repository or change it; ``synced``, ``change`` and ``error`` count only from then on.
    What turned managed stays so; each column keeps its last write, and an error goes with the next sync.
    """
    born = writes.filter(F.col("op").isin("local", "managed")).groupBy("repo_id").agg(F.min("at").alias("created_at"))
    live = writes.join(born, "repo_id").filter(F.col("at") >= F.col("created_at"))
    op = F.col("op")
    last = lambda value, *ops: F.max_by(F.when(op.isin(*ops), F.struct(F.col(value).alias("x"))), F.when(op.isin(*ops), F.col("at")))["x"]
    kept = ("local", "managed", "synced")
    failed = F.max(F.when(op == "error", F.col("at"))) > F.coalesce(F.max(F.when(op.isin(*kept), F.col("at"))), F.lit(-(2**62)))
    return live.groupBy("repo_id").agg(
        F.when(F.bool_or(op == "managed"), "managed").otherwise("local").alias("source_type"), last("path", "local", "managed").alias("repo_path"), last("url", "managed").alias("remote_url"), last("branch", "managed").alias("branch"),
        last("sha", *kept).alias("last_commit_sha"), F.max(F.when(op.isin(*kept), F.col("at"))).alias("last_synced_at"), F.max(F.when(op == "change", F.col("at"))).alias("last_change_at"),
        F.when(failed, last("message", "error")).alias("last_error"), F.min("created_at").alias("created_at"), F.max("at").alias("updated_at"),
    )
