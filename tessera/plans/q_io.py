"""Plans for sources and sinks: write derived tables to the shared scratch folder and
read them back (S01-S03, S06, S07, S11, E03, G14, G15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ml
from tessera.operators.mixup import text_mixup, text_mixup_batch
from tessera.plans.common import round_doubles
from tessera.plans.registry import plan, table
from tessera.sources import io


@plan("csv_roundtrip", (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"), ("S01", "S06"))
def q_csv(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = io.scratch_path(spark, "csv")
    io.write_table(o, path, "csv")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in o.schema.fields)
    return io.read_csv(spark, path, schema=ddl)


@plan("tsv_roundtrip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer", ("S03",))
def q_tsv(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = io.scratch_path(spark, "tsv")
    io.write_table(c, path, "tsv")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema.fields)
    return io.read_csv(spark, path, schema=ddl, sep="\t")


@plan("json_records", "SELECT event_id, event_type, round(value, 6) AS value FROM events", ("S02", "S07"))
def q_json(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    path = io.scratch_path(spark, "json")
    io.write_json_summary(e, path)
    return round_doubles(io.read_json_records(spark, path).select("event_id", "event_type", "value"))


@plan("model_save_load", None, ("S11", "E03", "M11"))
def q_model_io(spark, sf):
    """LR pipeline saved to the shared folder, loaded back, used to predict (R)."""
    from tessera.plans.q_ml import _separable

    d = _separable(spark, sf)
    model = ml.train_classifier(d, "label", [f"x{i}" for i in range(64)], model="logistic", folds=0)
    path = io.scratch_path(spark, "model")
    io.save_model(model, path)
    loaded = io.load_model(path)
    return loaded.transform(d).select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"))


def _sql_text_mixup():
    from tessera.plans.common import sql_unit_hash

    return (
        "WITH e AS (SELECT vec_id, 'text ' || vec_id::VARCHAR AS text, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), "
        "n AS (SELECT *, row_number() OVER (ORDER BY " + sql_unit_hash("vec_id::VARCHAR", "'partner'") + ") - 1 AS i, count(*) OVER () AS n, "
        "('0x' || substr(md5(concat_ws(':', vec_id::VARCHAR, 'partner:pick')), 1, 12))::UBIGINT::BIGINT AS r FROM e), "
        "p AS (SELECT *, CASE WHEN n > 1 THEN (i + 1 + r % (n - 1)) % n END AS pi FROM n), "
        "j AS (SELECT a.vec_id, a.text, a.v, b.vec_id AS partner_key, b.text AS pt, b.v AS pv, 0.3 + 0.4 * "
        + sql_unit_hash("a.vec_id::VARCHAR", "'mixup:alpha'") + " AS alpha FROM p a LEFT JOIN p b ON a.pi = b.i), "
        "m AS (SELECT *, list_transform(list_zip(v, pv), lambda x: alpha * x[1] + (1 - alpha) * x[2]) AS mix FROM j) "
        "SELECT vec_id, partner_key, round(alpha, 6) AS alpha, CASE WHEN length(text) = 0 OR pv IS NULL THEN text "
        "WHEN list_cosine_similarity(mix, v) >= list_cosine_similarity(mix, pv) THEN text ELSE pt END AS augmented FROM m"
    )


@plan("text_mixup", _sql_text_mixup(), ("G14", "J05", "F09"))
def q_text_mixup(spark, sf):
    """Embedding mixup with a random partner; nearest of the two texts (R)."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"),
                                                F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"))
    return round_doubles(text_mixup(e, "vec_id", "text", "v"))


@plan("text_mixup_batch", None, ("G15",))
def q_text_mixup_batch(spark, sf):
    """Batch mixup over conversation turns with hashed-bag embeddings (R: alpha in [0.1, 0.9])."""
    c = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return round_doubles(text_mixup_batch(c, "id", "text", 0.2))


@plan("custom_transformers", None, ("E03", "P12", "S11"))
def q_custom_tx(spark, sf):
    """TextSelector + NumericSelector in a saved and reloaded Pipeline over conversations (R)."""
    from pyspark.ml import Pipeline, PipelineModel

    c = table(spark, sf, "conversations")
    pipe = Pipeline(stages=[ml.TextSelector(inputCols=["role", "text"], outputCol="combined"),
                            ml.NumericSelector(inputCols=["conv_id", "turn"], outputCol="nums")])
    model = pipe.fit(c)
    path = io.scratch_path(spark, "pipeline")
    model.write().overwrite().save(path)
    out = PipelineModel.load(path).transform(c)
    return out.select("conv_id", "turn", F.length("combined").alias("combined_length"), F.size("nums").alias("n_nums"))
