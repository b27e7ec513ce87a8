"""Plans for the catalog, sets, windows and joins over events used as an artifact log
(FIXTURES B: user_id = dataset, event_type = stage, ts = created_at, status from event_id),
plus version comparison and as-of alignment (K01-K13, S09, S10, T03, T04, W02, W03, J01,
J06-J09, U01-U04, C14, F09-F11, F13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import catalog as K
from tessera.operators import clean
from tessera.operators import neighbours as N
from tessera.operators import relational as R
from tessera.plans.common import round_doubles, sql_unit_hash
from tessera.plans.registry import plan, table

STAGE_CASE_SQL = ("CASE event_type WHEN 'click' THEN 'upload' WHEN 'signup' THEN 'preprocess' WHEN 'view' THEN 'augment' "
                  "WHEN 'purchase' THEN 'eda' ELSE 'model' END")
STATUS_SQL = "CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'processing' END"

ARTIFACTS_SQL = (
    f"SELECT event_id AS id, 'user_' || (user_id % 10)::VARCHAR AS user_id, user_id AS dataset_id, {STAGE_CASE_SQL} AS stage, "
    f"({STAGE_CASE_SQL}) || '_op' AS operation, {STATUS_SQL} AS status, props AS parameters, ts AS created_at, "
    f"'user_' || (user_id % 10)::VARCHAR || '/dataset_' || user_id::VARCHAR || '/stage_' || ({STAGE_CASE_SQL}) || '/run_' || "
    f"floor(epoch(ts))::BIGINT::VARCHAR || '.csv' AS bucket_key FROM events"
)


def artifacts(spark, sf):
    """events as a pipeline artifact log (deterministic derivation, repeated in ARTIFACTS_SQL)."""
    e = table(spark, sf, "events")
    stage = (F.when(F.col("event_type") == "click", "upload").when(F.col("event_type") == "signup", "preprocess")
             .when(F.col("event_type") == "view", "augment").when(F.col("event_type") == "purchase", "eda").otherwise("model"))
    status = F.when(F.col("event_id") % 3 == 0, "completed").when(F.col("event_id") % 3 == 1, "failed").otherwise("processing")
    user = F.concat(F.lit("user_"), (F.col("user_id") % 10).cast("string"))
    return e.select(
        F.col("event_id").alias("id"), user.alias("user_id"), F.col("user_id").alias("dataset_id"), stage.alias("stage"),
        F.concat(stage, F.lit("_op")).alias("operation"), status.alias("status"), F.col("props").alias("parameters"),
        F.col("ts").alias("created_at"),
        K.stage_path(F.col("user_id") % 10, F.col("user_id"), stage, F.col("ts"), ".csv").alias("bucket_key"),
    )


@plan("stage_paths", (
    f"SELECT id, bucket_key, regexp_extract(bucket_key, 'dataset_([^/]+)', 1) AS parsed_dataset FROM ({ARTIFACTS_SQL})"),
    ("S09", "F10"))
def q_stage_paths(spark, sf):
    a = artifacts(spark, sf)
    return a.select("id", "bucket_key", K.dataset_from_key(F.col("bucket_key")).alias("parsed_dataset"))


@plan("resolve_input", (
    f"SELECT dataset_id, arg_min(stage, list_position(['augment', 'preprocess', 'upload'], stage)) AS resolved_stage "
    f"FROM ({ARTIFACTS_SQL}) WHERE list_position(['augment', 'preprocess', 'upload'], stage) > 0 GROUP BY dataset_id"), ("S10",))
def q_resolve(spark, sf):
    return K.resolve_input(artifacts(spark, sf), "dataset_id", "stage", ["augment", "preprocess", "upload"])


@plan("list_datasets", (
    "SELECT user_id, dataset_id, n, count(*) OVER ()::BIGINT AS total_count FROM (SELECT user_id, dataset_id, count(*)::BIGINT AS n "
    f"FROM ({ARTIFACTS_SQL}) GROUP BY ALL) WHERE user_id = 'user_3'"), ("K01",))
def q_list_datasets(spark, sf):
    ds = artifacts(spark, sf).groupBy("user_id", "dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return K.list_datasets(ds, "user_id", "user_3")


@plan("list_artifacts_page", (
    f"SELECT id, stage, created_at, (SELECT count(*) FROM ({ARTIFACTS_SQL}) WHERE dataset_id = 7)::BIGINT AS total_count, "
    f"(SELECT count(*) FROM ({ARTIFACTS_SQL}) WHERE dataset_id = 7) > 15 AS has_more FROM ({ARTIFACTS_SQL}) WHERE dataset_id = 7 "
    "ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 5"), ("K03", "T03"))
def q_list_artifacts(spark, sf):
    out = K.list_artifacts(artifacts(spark, sf), dataset=7, offset=5, limit=10)
    return out.select("id", "stage", "created_at", "total_count", "has_more")


@plan("latest_artifact", (
    f"SELECT dataset_id, stage, arg_max(id, (created_at, id)) AS id, max(created_at) AS created_at FROM ({ARTIFACTS_SQL}) GROUP BY ALL"),
    ("K04", "W03"))
def q_latest(spark, sf):
    return K.latest_artifact(artifacts(spark, sf)).select("dataset_id", "stage", "id", "created_at")


@plan("pipeline_status", (
    f"SELECT dataset_id, coalesce(array_to_string(list_sort(list_distinct(list(stage) FILTER (status = 'completed'))), ','), '') AS completed_stages, "
    f"round(count(DISTINCT stage) FILTER (status = 'completed') * 100.0 / 5, 6) AS progress FROM ({ARTIFACTS_SQL}) GROUP BY dataset_id"),
    ("K05",))
def q_status(spark, sf):
    s = K.pipeline_status(artifacts(spark, sf))
    return round_doubles(s.select("dataset_id", F.array_join("completed_stages", ",").alias("completed_stages"), "progress"))


@plan("pipeline_overview", (
    f"SELECT dataset_id, count(*)::BIGINT AS total, count_if(status = 'completed')::BIGINT AS completed, "
    f"count_if(status = 'failed')::BIGINT AS failed, arg_max(operation, (created_at, id)) AS last_operation FROM ({ARTIFACTS_SQL}) GROUP BY dataset_id"),
    ("K06", "J07"))
def q_overview(spark, sf):
    return K.pipeline_overview(artifacts(spark, sf))


@plan("pipeline_overview_all", (
    "SELECT c_custkey AS dataset_id, count(id)::BIGINT AS total, count(*) FILTER (WHERE status = 'completed')::BIGINT AS completed, "
    f"count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed, arg_max(operation, (created_at, id)) FILTER (WHERE id IS NOT NULL) AS last_operation "
    f"FROM customer LEFT JOIN ({ARTIFACTS_SQL}) a ON a.dataset_id = c_custkey GROUP BY c_custkey"), ("K06", "J07"))
def q_overview_all(spark, sf):
    """Datasets without artifacts have a row too."""
    return K.pipeline_overview(artifacts(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


@plan("update_status", (
    f"SELECT id, CASE WHEN id % 4 = 0 THEN 'archived' ELSE status END AS status FROM ({ARTIFACTS_SQL})"), ("K07",))
def q_update(spark, sf):
    a = artifacts(spark, sf).withColumn("metadata", F.lit(None).cast("string")).withColumn("updated_at", F.col("created_at"))
    changes = a.where(F.col("id") % 4 == 0).select("id", F.lit("archived").alias("status"), F.lit('{"archived": true}').alias("metadata"))
    return K.update_status(a, changes, F.col("created_at")).select("id", "status")


@plan("find_artifact_by_filename", (
    f"SELECT id, bucket_key FROM ({ARTIFACTS_SQL}) WHERE lower(regexp_extract(bucket_key, '(\\.[^./]+)$', 1)) = '.csv' "
    "AND (contains(bucket_key, 'stage_augment') OR contains(bucket_key, 'stage') OR contains(bucket_key, 'augment'))"), ("K09",))
def q_find(spark, sf):
    return K.find_by_filename(artifacts(spark, sf), "stage_augment.csv").select("id", "bucket_key")


def _parents(spark, sf):
    """Parent = previous artifact of the same dataset (fixture for lineage)."""
    from pyspark.sql import Window

    a = artifacts(spark, sf)
    w = Window.partitionBy("dataset_id").orderBy("created_at", "id")
    return a.select("id", F.lag("id").over(w).alias("input_artifact_id"))


@plan("lineage", (
    f"WITH RECURSIVE p AS (SELECT id, lag(id) OVER (PARTITION BY dataset_id ORDER BY created_at, id) AS parent FROM ({ARTIFACTS_SQL})), "
    "walk(id, cur, depth) AS (SELECT id, id, 0 FROM p UNION ALL SELECT w.id, p.parent, w.depth + 1 FROM walk w JOIN p ON p.id = w.cur "
    "WHERE p.parent IS NOT NULL) SELECT id, arg_max(cur, depth) AS root_id, max(depth)::INTEGER AS depth FROM walk GROUP BY id"),
    ("K10",))
def q_lineage(spark, sf):
    return K.lineage(_parents(spark, sf))


@plan("owned_artifacts", (
    f"SELECT id, dataset_id FROM ({ARTIFACTS_SQL}) a WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id, dataset_id FROM ({ARTIFACTS_SQL})) d "
    "WHERE d.dataset_id = a.dataset_id AND d.user_id = 'user_2')"), ("J08",))
def q_owned(spark, sf):
    a = artifacts(spark, sf)
    ds = a.select("user_id", F.col("dataset_id").alias("id")).distinct()
    return K.owned_by(a, ds, "user_2").select("id", "dataset_id")


@plan("files_by_stage", (
    f"SELECT id, user_id, stage, created_at FROM ({ARTIFACTS_SQL}) WHERE user_id = 'user_5' AND stage = 'augment' "
    "ORDER BY created_at DESC, id DESC"), ("K11",))
def q_files_stage(spark, sf):
    a = artifacts(spark, sf)
    return a.where((F.col("user_id") == "user_5") & (F.col("stage") == "augment")).orderBy(
        F.desc("created_at"), F.desc("id")).select("id", "user_id", "stage", "created_at")


@plan("event_props_json", (
    "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, to_json(struct_pack(event_type := event_type, k := json_extract(props, '$.k')::BIGINT))::VARCHAR AS meta "
    "FROM events"), ("F11", "S02"))
def q_props(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type"), k.alias("k"))).alias("meta"))


@plan("event_dates", (
    "SELECT event_id, floor(epoch(ts))::BIGINT AS epoch_seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events"), ("F10",))
def q_dates(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch_seconds"),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@plan("file_names", (
    "SELECT page_id, lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '(\\.[^./]+)$', 1)) AS ext, "
    "CASE WHEN regexp_matches(p, '\\.[^./]+$') THEN regexp_extract(p, '^(.*)(\\.[^./]+)$', 1) || '_aug1' || "
    "regexp_extract(p, '^(.*)(\\.[^./]+)$', 2) ELSE p || '_aug1' END AS augmented_name "
    "FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS p FROM pages)"), ("F13",))
def q_files(spark, sf):
    p = table(spark, sf, "pages")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    return p.select("page_id", T.file_extension(path).alias("ext"), T.add_suffix(path, "_aug1").alias("augmented_name"))


# ---------------------------------------------------------------------------
# windows and sets
# ---------------------------------------------------------------------------


@plan("movement_label", (
    "SELECT event_id, user_id, target FROM (SELECT event_id, user_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx, "
    "(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) > value)::INTEGER AS target FROM events) WHERE nx IS NOT NULL"),
    ("W02", "P10", "D18"))
def q_movement(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return R.movement_label(e, "value", ["ts", "event_id"], ["user_id"], bucket=86400).select("event_id", "user_id", "target")


@plan("movement_label_hot", (
    "SELECT event_id, entity, target FROM (SELECT event_id, entity, lead(value) OVER w AS nx, (lead(value) OVER w > value)::INTEGER AS target "
    "FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS entity FROM events) WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)) WHERE nx IS NOT NULL"),
    ("W02", "D18"))
def q_movement_hot(spark, sf):
    """A third of the rows in one entity, and no bucket: ranges come from the data."""
    e = table(spark, sf, "events").withColumn("entity", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    return R.movement_label(e.select("event_id", "entity", "ts", "value"), "value", ["ts", "event_id"], ["entity"]).select("event_id", "entity", "target")


@plan("per_class_cap", (
    "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY "
    + sql_unit_hash("vec_id::VARCHAR", "'cap'") + ") AS rn FROM embeddings) WHERE rn <= 30"), ("T05", "W06"))
def q_cap(spark, sf):
    from tessera import core

    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return R.per_group_cap(e, "label", core.hash_uniform(F.col("vec_id").cast("string"), "cap"), 30)


@plan("union_versions", (
    "SELECT o_orderkey, o_totalprice, 'original' AS version FROM orders UNION ALL "
    "SELECT o_orderkey, round(o_totalprice * 1.1, 6), 'scaled' FROM orders"), ("U01",))
def q_union(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    a = o.withColumn("version", F.lit("original"))
    b = o.select("o_orderkey", F.round(F.col("o_totalprice") * 1.1, 6).alias("o_totalprice")).withColumn("version", F.lit("scaled"))
    return R.union_all(a, b)


@plan("duplicate_rows", (
    "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, count(*)::BIGINT AS copies FROM ("
    "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem UNION ALL "
    "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_orderkey % 50 = 0) GROUP BY ALL HAVING count(*) > 1"),
    ("U03",))
def q_dups(spark, sf):
    from tessera.plans.q_numeric import dup_base

    return R.duplicate_rows(dup_base(spark, sf))


_REMOVED_SQL = (
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem EXCEPT ALL "
    "SELECT * FROM ({q})")


def _outlier_sql():
    from tessera.plans.q_numeric import IDS, _OUTLIER_SRC, _sql_remove_outliers_joint
    from tessera.plans.common import NUM

    return _sql_remove_outliers_joint(_OUTLIER_SRC, NUM, IDS)


@plan("rows_removed_by_outliers", (
    "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END "
    "AS l_extendedprice, l_discount, l_tax FROM lineitem) EXCEPT ALL SELECT * FROM (" + _outlier_sql() + ")"), ("U04",))
def q_removed(spark, sf):
    from tessera.plans.common import NUM
    from tessera.plans.q_numeric import outlier_base

    base = outlier_base(spark, sf)
    removed, _ = R.row_diff(base, clean.remove_outliers_iqr(base, NUM))
    return removed


@plan("compare_versions", (
    "WITH a AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders), "
    "b AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders) "
    "SELECT 'rows' AS metric, '' AS column, (SELECT count(*) FROM a)::DOUBLE AS \"left\", (SELECT count(*) FROM b)::DOUBLE AS \"right\" "
    "UNION ALL SELECT 'columns', '', 3.0, 3.0 UNION ALL SELECT 'nulls', '', 0.0, 0.0 "
    "UNION ALL SELECT 'changed_rows', 'o_totalprice', x, x FROM (SELECT count_if(a.o_totalprice IS DISTINCT FROM b.o_totalprice)::DOUBLE AS x "
    "FROM a JOIN b ON a.o_orderkey = b.o_orderkey) UNION ALL SELECT 'only_left', 'o_orderstatus', NULL, NULL "
    "UNION ALL SELECT 'only_right', 'o_orderpriority', NULL, NULL"), ("C14", "J01", "U02"))
def q_compare(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select("o_orderkey", "o_totalprice", "o_orderstatus")
    b = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))
                 .alias("o_totalprice"), "o_orderpriority")
    return R.compare_datasets(a, b, "o_orderkey")


@plan("most_similar_pair", (
    "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), "
    "s AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id) "
    "SELECT label, arg_max(a, sim) AS a, arg_max(b, sim) AS b, round(max(sim), 6) AS similarity, round(avg(sim), 6) AS mean_similarity FROM s GROUP BY label"),
    ("J06", "T04", "F09", "I16"))
def q_similar(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    best = N.most_similar_pair(e, "vec_id", "v", "label").join(N.mean_similarity(e, "vec_id", "v", "label").drop("rows"), "label")
    return round_doubles(best.select("label", "a", "b", "similarity", "mean_similarity"))


@plan("most_similar_pair_all", (
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), "
    "s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.vec_id < b.vec_id) "
    "SELECT (SELECT count(*) FROM e)::BIGINT AS rows, arg_max(a, sim) AS a, arg_max(b, sim) AS b, round(max(sim), 6) AS similarity, round(avg(sim), 6) AS mean_similarity FROM s"),
    ("J06", "T04", "I16"))
def q_similar_all(spark, sf):
    """Over all rows, across labels; no pair table is formed."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    best = N.most_similar_pair(e, "vec_id", "v").crossJoin(F.broadcast(N.mean_similarity(e, "vec_id", "v")))
    return round_doubles(best.select("rows", "a", "b", "similarity", "mean_similarity"))


@plan("asof_alignment", (
    "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), "
    "r AS (SELECT user_id, ts AS rts, value FROM events WHERE event_type = 'view') "
    "SELECT l.event_id, l.user_id, l.ts, CASE WHEN epoch(l.ts)::BIGINT - epoch(r.rts)::BIGINT <= 86400 THEN r.value END AS right_value, "
    "CASE WHEN epoch(l.ts)::BIGINT - epoch(r.rts)::BIGINT <= 86400 THEN r.rts END AS right_ts "
    "FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.rts"), ("J09",))
def q_asof(spark, sf):
    e = table(spark, sf, "events")
    left = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    right = e.where(F.col("event_type") == "view").select("user_id", "ts", "value")
    out = R.asof_join(left, right, "user_id", "ts", "ts", tolerance=86400, right_cols=["value"])
    return out.select("event_id", "user_id", "ts", "right_value", "right_ts")


@plan("vector_blend", (
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) "
    "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: 0.3 * p[1] + 0.7 * p[2])), 6) AS blend_sum, "
    "round(list_dot_product(a.v, b.v), 6) AS dot FROM e a JOIN e b ON b.vec_id = (a.vec_id + 1)"), ("F09", "G14"))
def q_blend(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    j = e.join(b, "vec_id")
    bl = R.blend_expr("v", "w", 0.3)
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return round_doubles(j.select("vec_id", F.aggregate(bl, F.lit(0.0), lambda acc, x: acc + x).alias("blend_sum"), dot.alias("dot")))


@plan("cross_modal_missing", (
    "SELECT doc_id, 'right' AS missing_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"), ("K13",))
def q_cross_modal(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return K.cross_modal_missing(d, lab, "doc_id")



@plan("record_artifacts", (
    f"SELECT stage, count(*)::BIGINT AS artifacts FROM (SELECT stage FROM ({ARTIFACTS_SQL}) UNION ALL "
    f"SELECT 'report' FROM (SELECT DISTINCT dataset_id FROM ({ARTIFACTS_SQL}))) GROUP BY stage"), ("K02", "K11"))
def q_record(spark, sf):
    a = artifacts(spark, sf)
    new = a.groupBy("dataset_id").agg(F.max("created_at").alias("created_at")).select(
        F.lit(None).cast("long").alias("id"), "dataset_id", F.lit("report").alias("stage"), F.lit("report_op").alias("operation"),
        F.lit("completed").alias("status"), "created_at")
    return K.record(a, new).groupBy("stage").agg(F.count(F.lit(1)).alias("artifacts"))


@plan("artifact_logs", (
    f"WITH a AS (SELECT * FROM ({ARTIFACTS_SQL}) WHERE dataset_id = 11 ORDER BY created_at DESC, id DESC LIMIT 5), "
    "l AS (SELECT event_id AS artifact_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS log_level, "
    "event_type || ':' || props AS message, ts AS logged_at FROM events) "
    "SELECT a.id, a.stage, l.log_level, l.message FROM a JOIN l ON l.artifact_id = a.id"), ("K08",))
def q_logs(spark, sf):
    a = K.list_artifacts(artifacts(spark, sf), dataset=11, offset=0, limit=5).select("id", "stage")
    e = table(spark, sf, "events")
    logs = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("log_level"),
                    F.concat_ws(":", "event_type", "props").alias("message"))
    return a.join(logs, "id").select("id", "stage", "log_level", "message")


@plan("cumulative_share", (
    "SELECT o_orderpriority AS value, count(*)::BIGINT AS count, round(sum(count(*)) OVER (ORDER BY count(*) DESC, o_orderpriority "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(count(*)) OVER (), 6) AS cumulative_share FROM orders GROUP BY 1"),
    ("W05",))
def q_cum_share(spark, sf):
    """Running share over a small ordered table (value counts of a 5-value column)."""
    from pyspark.sql import Window

    from tessera.operators.profile import value_counts

    vc = value_counts(table(spark, sf, "orders"), "o_orderpriority", None)
    w = Window.orderBy(F.desc("count"), "value")
    run = F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tot = F.sum("count").over(Window.partitionBy())
    return round_doubles(vc.select("value", "count", (run / tot).alias("cumulative_share")))


def _cmp_versions(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select("o_orderkey", "o_totalprice", "o_orderstatus")
    b = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))
                 .alias("o_totalprice"), F.when(F.col("o_orderstatus") == "P", F.lit("O")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return a, b


_CMP_B = ("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, "
          "CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders")


@plan("compare_numeric_profiles", " UNION ALL ".join(
    f"SELECT 'o_totalprice' AS \"column\", '{side}' AS side, count(o_totalprice)::BIGINT AS count, "
    + ", ".join(f"round({e}, 2) AS {n}" for n, e in (("mean", "avg(o_totalprice)"), ("std", "stddev_samp(o_totalprice)"),
                                                     ("min", "min(o_totalprice)"), ("q25", "quantile_cont(o_totalprice, 0.25)"),
                                                     ("q50", "quantile_cont(o_totalprice, 0.5)"), ("q75", "quantile_cont(o_totalprice, 0.75)"),
                                                     ("max", "max(o_totalprice)")))
    + f" FROM ({src})" for side, src in (("left", "SELECT * FROM orders"), ("right", _CMP_B))), ("C14",))
def q_cmp_numeric(spark, sf):
    a, b = _cmp_versions(spark, sf)
    return R.compare_profiles(a, b, "o_orderkey")[0]


@plan("compare_other_profiles", (
    "SELECT 'o_orderstatus' AS \"column\", (SELECT count(DISTINCT o_orderstatus) FROM orders)::BIGINT AS left_distinct, "
    f"(SELECT count(DISTINCT o_orderstatus) FROM ({_CMP_B}))::BIGINT AS right_distinct"), ("C14",))
def q_cmp_other(spark, sf):
    a, b = _cmp_versions(spark, sf)
    return R.compare_profiles(a, b, "o_orderkey")[1]
