"""Plans for image operators over image structs built from the embeddings table
(FIXTURES 'Images': 8 x 8 grey images, class folder = label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import images as I
from tessera.plans.common import round_doubles
from tessera.plans.registry import plan, table


def image_set(spark, sf):
    e = table(spark, sf, "embeddings")
    e = e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return I.images_from_vectors(e, "vec_id", "vec", "label", 8)


_PIX_SQL = ("WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), "
            "p AS (SELECT vec_id, label, unnest(list_transform(v, lambda x: round((x - list_min(v)) / greatest(list_max(v) - list_min(v), 1e-12) * 255)::INTEGER)) AS px FROM e) ")


@plan("image_statistics", (
    "SELECT label::VARCHAR AS label, 'png' AS format, 1 AS channels, count(*)::BIGINT AS images, 8 AS min_width, 8 AS max_width, "
    "8.0::DOUBLE AS mean_width, 8 AS min_height, 8 AS max_height, 8.0::DOUBLE AS mean_height FROM embeddings GROUP BY label"), ("I02",))
def q_img_stats(spark, sf):
    return I.image_statistics(image_set(spark, sf))


@plan("color_histograms", _PIX_SQL + "SELECT 'gray' AS channel, px AS bin, count(*)::BIGINT AS count FROM p GROUP BY px", ("I13",))
def q_color_hist(spark, sf):
    return I.color_histograms(image_set(spark, sf))


@plan("color_summary", _PIX_SQL + "SELECT 'gray' AS channel, round(avg(px), 6) AS mean_value, count(*)::BIGINT AS pixels FROM p",
      ("I13",))
def q_color_summary(spark, sf):
    return round_doubles(I.color_summary(image_set(spark, sf)))


@plan("image_quality", None, ("I14",))
def q_quality(spark, sf):
    """Laplacian sharpness and brightness per image (R: one row per image)."""
    return round_doubles(I.quality_assessment(image_set(spark, sf)))


@plan("edge_density", None, ("I17",))
def q_edges(spark, sf):
    """Sobel edge share per image (R: values in [0, 1])."""
    return round_doubles(I.edge_density(image_set(spark, sf)))


@plan("image_mixup", None, ("I11", "J05"))
def q_img_mix(spark, sf):
    """Same-class mixup (R: one output per image, lambda in [0, 1])."""
    out = I.mixup(image_set(spark, sf), 0.2)
    return round_doubles(out.select(F.col("image.origin").alias("origin"), "label", "partner", "lam"))


@plan("image_embedding_pca", None, ("I15",))
def q_img_pca(spark, sf):
    """Centred thumbnail PCA to 2 components (R)."""
    out, _ = I.feature_embedding(image_set(spark, sf), 8, 2)
    return round_doubles(out)


@plan("image_classify", None, ("I18",))
def q_img_cls(spark, sf):
    """MLP on thumbnails; evaluation summary (R: 7 metrics)."""
    return round_doubles(I.image_classify(image_set(spark, sf), 8))


def _written_images(spark, sf):
    """Writes the embedding images as PNG files (plus ~2 % corrupt siblings) under the shared
    scratch folder and returns the folder."""
    from tessera.sources.io import scratch_path

    folder = scratch_path(spark, "png")
    I.write_png_files(image_set(spark, sf), folder, corrupt_share=0.02).write.format("noop").mode("overwrite").save()
    return folder


_CORRUPT_U = ("(('0x' || substr(md5('class_' || label::VARCHAR || '/' || vec_id::VARCHAR || '.png:corrupt'), 1, 13))::UBIGINT::DOUBLE "
              "/ 4503599627370496.0)")


@plan("image_validation", (
    f"SELECT (count(*) + count_if({_CORRUPT_U} < 0.02))::BIGINT AS input_files, count(*)::BIGINT AS valid, "
    f"count_if({_CORRUPT_U} < 0.02)::BIGINT AS corrupt FROM embeddings"), ("I01", "S04", "S05"))
def q_img_validation(spark, sf):
    folder = _written_images(spark, sf)
    files = I.scan_files(spark, folder).select(F.regexp_extract("path", r"(class_[^/]+/[^/]+)$", 1).alias("path"))
    imgs = I.scan_images(spark, folder).select(
        F.struct(F.regexp_extract("image.origin", r"(class_[^/]+/[^/]+)$", 1).alias("origin")).alias("image"))
    return I.image_validation(files, imgs)


@plan("scanned_image_classes", (
    "SELECT label::VARCHAR AS label, count(*)::BIGINT AS images, 8 AS height, 8 AS width FROM embeddings GROUP BY label"),
    ("S04", "S08"))
def q_scanned(spark, sf):
    folder = _written_images(spark, sf)
    imgs = I.scan_images(spark, folder).withColumn("label", F.regexp_replace("label", "^class_", ""))
    return imgs.groupBy("label").agg(F.count(F.lit(1)).alias("images"), F.max("image.height").alias("height"),
                                     F.max("image.width").alias("width"))
