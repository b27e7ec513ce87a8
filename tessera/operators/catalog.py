"""Dataset / artifact catalog and pipeline tracking.

The catalog is a set of parquet tables (datasets, artifacts, samples, logs, ...); these
operators are filters, aggregates and joins over them.  Updates rewrite rows through a
left join with the change set (no row-level store)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import core
from tessera.operators.relational import latest_per_group, page

STAGES = ["upload", "preprocess", "augment", "eda", "model"]


def stage_path(user: Column, dataset: Column, stage: Column, ts: Column, ext: Column | str = "") -> Column:
    """user_{u}/dataset_{d}/stage_{s}/run_{epoch seconds}{ext}."""
    e = ext if isinstance(ext, Column) else F.lit(ext)
    return F.concat(F.lit("user_"), user.cast("string"), F.lit("/dataset_"), dataset.cast("string"), F.lit("/stage_"),
                    stage.cast("string"), F.lit("/run_"), F.unix_timestamp(ts.cast("timestamp")).cast("string"), e)


def dataset_from_key(key: Column) -> Column:
    """S09 inverse: dataset id parsed out of a storage key."""
    return F.regexp_extract(key, r"dataset_([^/]+)", 1)


def resolve_input(catalog: DataFrame, key_col: str, stage_col: str, priority: Sequence[str]) -> DataFrame:
    """For each key the first stage in ``priority`` order that holds it (an aggregate:
    min_by over the priority rank, so a key held by many rows is combined map-side)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in priority]), F.col(stage_col))
    return catalog.where(rank > 0).groupBy(key_col).agg(F.min_by(F.col(stage_col), rank).alias("resolved_stage"))


def list_datasets(datasets: DataFrame, user_col: str, user) -> DataFrame:
    """All datasets of a user with the total count."""
    mine = datasets.where(F.col(user_col) == F.lit(user))
    return mine.crossJoin(F.broadcast(mine.agg(F.count(F.lit(1)).alias("total_count"))))


def record(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows (by column name)."""
    return table.unionByName(rows, allowMissingColumns=True)


def list_artifacts(artifacts: DataFrame, dataset=None, stage=None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Newest first (created_at desc, id desc), one page with total_count / has_more."""
    a = artifacts
    if dataset is not None:
        a = a.where(F.col("dataset_id") == F.lit(dataset))
    if stage is not None:
        a = a.where(F.col("stage") == F.lit(stage))
    return page(a, [F.desc("created_at"), F.desc("id")], offset, limit)


def latest_artifact(artifacts: DataFrame, group: Sequence[str] = ("dataset_id", "stage")) -> DataFrame:
    """Latest artifact per group."""
    return latest_per_group(artifacts, list(group), ["created_at", "id"])


def pipeline_status(artifacts: DataFrame, mode: str = "distinct") -> DataFrame:
    """Per dataset the completed stages (sorted) and progress = completed / 5 * 100, 0 where
    nothing is completed;
    ``mode='reference'`` counts completed rows (duplicates can exceed 100)."""
    stage = F.when(F.col("status") == "completed", F.col("stage"))
    n = F.count_distinct(stage) if mode == "distinct" else F.count_if(F.col("status") == "completed")
    return artifacts.groupBy("dataset_id").agg(
        F.array_sort(F.collect_set(stage)).alias("completed_stages"),
        (n * F.lit(100.0) / F.lit(len(STAGES))).alias("progress"),
    )


def pipeline_overview(artifacts: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Per dataset total, completed and failed artifacts and the last operation.  With
    ``datasets`` (``id``) each of them has a row, with zeros and no operation where it has no artifact."""
    per = artifacts.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.max_by("operation", F.struct("created_at", "id")).alias("last_operation"),
    )
    if datasets is None:
        return per
    joined = datasets.select(F.col("id").alias("dataset_id")).distinct().join(per, "dataset_id", "left")
    return joined.fillna(0, ["total", "completed", "failed"])


def update_status(artifacts: DataFrame, changes: DataFrame, updated_at: Column) -> DataFrame:
    """Apply (id, status, metadata) changes: status and metadata replaced, updated_at set
    for changed rows; a left join with the change set, so the result is a rewrite."""
    ch = changes.select(F.col("id").alias("__id"), F.col("status").alias("__status"),
                        F.col("metadata").alias("__meta"), F.lit(True).alias("__hit"))
    j = artifacts.join(ch, artifacts["id"] == ch["__id"], "left")
    return j.select(
        *[F.coalesce(F.col("__status"), F.col("status")).alias("status") if c == "status"
          else F.when(F.col("__hit"), F.col("__meta")).otherwise(F.col("metadata")).alias("metadata") if c == "metadata"
          else F.when(F.col("__hit"), updated_at).otherwise(F.col("updated_at")).alias("updated_at") if c == "updated_at"
          else F.col(c) for c in artifacts.columns]
    )


def owned_by(artifacts: DataFrame, datasets: DataFrame, user) -> DataFrame:
    """Artifacts whose dataset belongs to the user (left semi join)."""
    mine = datasets.where(F.col("user_id") == F.lit(user)).select(F.col("id").alias("dataset_id"))
    return artifacts.join(mine, "dataset_id", "left_semi")


def find_by_filename(artifacts: DataFrame, filename: str) -> DataFrame:
    """Artifacts whose key has the same extension and contains the file stem, or any
    '_'-separated part of the stem longer than 3 characters."""
    stem = filename.rsplit(".", 1)[0] if "." in filename else filename
    ext = ("." + filename.rsplit(".", 1)[1].lower()) if "." in filename else ""
    parts = [p for p in stem.split("_") if len(p) > 3]
    key = F.col("bucket_key")
    same_ext = F.lower(F.regexp_extract(key, r"(\.[^./]+)$", 1)) == F.lit(ext)
    hit = key.contains(stem)
    for p in parts:
        hit = hit | key.contains(p)
    return artifacts.where(same_ext & hit)


def lineage(nodes: DataFrame, id_col: str = "id", parent_col: str = "input_artifact_id") -> DataFrame:
    """(id, root_id, depth) by pointer jumping: each round joins every unfinished node
    with the node it points at and doubles the jump, so chains of length d finish in
    log2(d) rounds.  Rounds are checkpointed to keep the plan small.  A parent that is not among
    the nodes is the root of its children; a cycle raises ValueError."""
    from tessera.session import cut_lineage

    cur = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("jump"),
                       F.when(F.col(parent_col).isNull(), F.lit(0)).otherwise(F.lit(1)).alias("depth"))
    cur = cur.withColumn("root", F.when(F.col("jump").isNull(), F.col("id")))
    unfinished = None
    while True:
        b = cur.select(F.col("id").alias("b_id"), F.col("jump").alias("b_jump"), F.col("depth").alias("b_depth"),
                       F.col("root").alias("b_root"))
        j = cur.join(b, cur["jump"] == b["b_id"], "left")
        nxt = j.select(
            "id",
            F.when(F.col("root").isNotNull(), F.lit(None)).otherwise(F.col("b_jump")).alias("jump"),
            F.when(F.col("root").isNotNull(), F.col("depth")).otherwise(F.col("depth") + F.coalesce("b_depth", F.lit(0))).alias("depth"),
            F.coalesce(F.col("root"), F.col("b_root"), F.when(F.col("b_id").isNull(), F.col("jump"))).alias("root"),
        )
        nxt = cut_lineage(nxt)
        cur, left = nxt, nxt.where(F.col("root").isNull()).count()
        if not left:
            break
        if left == unfinished:  # without a cycle, every round finishes the nodes nearest to a root
            raise ValueError(f"{left} nodes lead into a cycle of {parent_col}")
        unfinished = left
    return cur.select(F.col("id"), F.col("root").alias("root_id"), "depth")


def run_pipeline(df: DataFrame, steps: Sequence[tuple[str, Callable[..., DataFrame], dict]]):
    """Apply (name, operator, params) steps in order; returns (result, log) where the log
    lists each step with its parameters.  Steps compose lazily into one plan."""
    log = []
    out = functools.reduce(lambda acc, st: st[1](acc, **st[2]), steps, df)
    for i, (name, _, params) in enumerate(steps):
        log.append((i + 1, name, str(sorted(params.items())), "ok"))
    log_df = core.lit_table(df.sparkSession, log, "step int, operation string, parameters string, status string")
    return out, log_df


def detect_modality(df: DataFrame) -> str:
    """Numeric / text / mixed from the column roles."""
    from tessera.operators.profile import identify_column_types

    roles = {r["role"] for r in identify_column_types(df).collect()}  # one row per column
    if "text" in roles and "numeric" in roles:
        return "mixed"
    if "text" in roles:
        return "text"
    return "numeric"


def separate_modalities(df: DataFrame, key: str) -> dict[str, DataFrame]:
    """Per-role projections keyed by the row id."""
    from tessera.operators.profile import identify_column_types

    roles = {r["column"]: r["role"] for r in identify_column_types(df, exclude=[key]).collect()}
    out: dict[str, DataFrame] = {}
    for role in sorted(set(roles.values())):
        cols = [c for c, r in roles.items() if r == role]
        out[role] = df.select(key, *cols)
    return out


def cross_modal_missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present in one modality but missing in the other (left anti both ways)."""
    left = a.select(key).join(b.select(key), key, "left_anti").withColumn("missing_in", F.lit("right"))
    right = b.select(key).join(a.select(key), key, "left_anti").withColumn("missing_in", F.lit("left"))
    return left.unionByName(right)
