"""Image dataset operators (S04, S05, S08, I01-I18, E02) over Spark's image struct
(origin, height, width, nChannels, mode, data; BGR byte order, D20).

Pixels are decoded and transformed inside ``mapInPandas`` with numpy kernels (one image
at a time, per partition); only small results (histograms, statistics, thumbnail vectors)
are shuffled, never the pixel bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import core

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "gif", "webp", "tiff", "tif")
IMAGE_STRUCT = T.StructType([
    T.StructField("origin", T.StringType()), T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()), T.StructField("nChannels", T.IntegerType()),
    T.StructField("mode", T.IntegerType()), T.StructField("data", T.BinaryType()),
])
CV_MODE = {1: 0, 3: 16, 4: 24}  # OpenCV type codes used by Spark's image source


# ---------------------------------------------------------------------------
# sources (S04, S05, S08)
# ---------------------------------------------------------------------------


def scan_images(spark, path: str) -> DataFrame:
    """Decodable images under ``path`` (recursive), dot files and other extensions
    skipped, corrupt files dropped; label = parent folder name."""
    df = (spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path))
    ext = F.lower(F.regexp_extract("image.origin", r"\.([^./]+)$", 1))
    name = F.element_at(F.split("image.origin", "/"), -1)
    df = df.where(ext.isin(*IMAGE_EXTENSIONS) & ~name.startswith("."))
    return df.select("image", F.element_at(F.split("image.origin", "/"), -2).alias("label"))


def scan_files(spark, path: str) -> DataFrame:
    """File registration rows: path, filename, extension, size, modification time."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"),
                     F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"),
                     F.col("length").alias("file_size"), "modificationTime")


def write_images(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Keep the image structs as parquet partitioned by class label."""
    df.write.mode(mode).partitionBy("label").parquet(path)


# ---------------------------------------------------------------------------
# fixtures and numpy helpers
# ---------------------------------------------------------------------------


def images_from_vectors(df: DataFrame, key: str, vec: str, label: str, side: int = 8) -> DataFrame:
    """Grey side x side image structs from numeric vectors, min-max scaled to 0..255 per
    vector (FIXTURES 'Images'); origin = class_{label}/{key}.png."""
    mn = F.array_min(vec)
    mx = F.array_max(vec)
    px = F.transform(vec, lambda x: F.round((x - mn) / F.greatest(mx - mn, F.lit(1e-12)) * 255).cast("int"))
    data = F.unhex(F.concat_ws("", F.transform(px, lambda p: F.lpad(F.hex(p), 2, "0"))))
    origin = F.concat(F.lit("class_"), F.col(label).cast("string"), F.lit("/"), F.col(key).cast("string"), F.lit(".png"))
    img = F.struct(origin.alias("origin"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(1).alias("nChannels"),
                   F.lit(0).alias("mode"), data.alias("data"))
    return df.select(img.alias("image"), F.col(label).cast("string").alias("label"))


def to_array(img: dict) -> np.ndarray:
    h, w, c = int(img["height"]), int(img["width"]), int(img["nChannels"])
    return np.frombuffer(bytes(img["data"]), dtype=np.uint8).reshape(h, w, c)


def to_struct(arr: np.ndarray, origin: str) -> dict:
    arr = np.clip(np.rint(arr), 0, 255).astype(np.uint8)
    if arr.ndim == 2:
        arr = arr[:, :, None]
    h, w, c = arr.shape
    return {"origin": origin, "height": h, "width": w, "nChannels": c, "mode": CV_MODE.get(c, 16), "data": arr.tobytes()}


def grey(arr: np.ndarray) -> np.ndarray:
    a = arr.astype(np.float64)
    if a.shape[2] == 1:
        return a[:, :, 0]
    b, g, r = a[:, :, 0], a[:, :, 1], a[:, :, 2]  # BGR
    return 0.299 * r + 0.587 * g + 0.114 * b


def resize_bilinear(a: np.ndarray, h: int, w: int) -> np.ndarray:
    ih, iw = a.shape[:2]
    ys = (np.arange(h) + 0.5) * ih / h - 0.5
    xs = (np.arange(w) + 0.5) * iw / w - 0.5
    y0 = np.clip(np.floor(ys).astype(int), 0, ih - 1)
    x0 = np.clip(np.floor(xs).astype(int), 0, iw - 1)
    y1, x1 = np.clip(y0 + 1, 0, ih - 1), np.clip(x0 + 1, 0, iw - 1)
    wy = np.clip(ys - y0, 0, 1)[:, None, None]
    wx = np.clip(xs - x0, 0, 1)[None, :, None]
    a = a.astype(np.float64)
    top = a[y0][:, x0] * (1 - wx) + a[y0][:, x1] * wx
    bot = a[y1][:, x0] * (1 - wx) + a[y1][:, x1] * wx
    return top * (1 - wy) + bot * wy


def _seed(origin: str, salt: str) -> int:
    import hashlib

    return int(hashlib.md5(f"{origin}:{salt}".encode()).hexdigest()[:8], 16)


def _gauss_kernel(sigma: float) -> np.ndarray:
    r = max(1, int(math.ceil(3 * sigma)))
    x = np.arange(-r, r + 1)
    k = np.exp(-(x ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def _blur(a: np.ndarray, sigma: float) -> np.ndarray:
    k = _gauss_kernel(sigma)
    r = len(k) // 2
    out = a.astype(np.float64)
    pad = np.pad(out, ((r, r), (0, 0), (0, 0)), mode="reflect")
    out = sum(k[i] * pad[i:i + a.shape[0]] for i in range(len(k)))
    pad = np.pad(out, ((0, 0), (r, r), (0, 0)), mode="reflect")
    return sum(k[i] * pad[:, i:i + a.shape[1]] for i in range(len(k)))


# ---------------------------------------------------------------------------
# Per-image map
# ---------------------------------------------------------------------------


def image_map(df: DataFrame, fn: Callable[[np.ndarray, str, int], np.ndarray], copies: int = 1,
              keep_original: bool = False, suffix: str = "_aug") -> DataFrame:
    """Apply ``fn(array, origin, copy) -> array`` to every image (``copies`` times) in
    ``mapInPandas``; copies get ``{name}{suffix}{n}`` origins; failures are counted in a
    ``status`` column instead of failing the job."""
    schema = T.StructType([T.StructField("image", IMAGE_STRUCT), T.StructField("label", T.StringType()),
                           T.StructField("copy", T.IntegerType()), T.StructField("status", T.StringType())])

    def run(it):
        for pdf in it:
            rows = []
            for img, lab in zip(pdf["image"], pdf["label"]):
                origin = img["origin"]
                if keep_original:
                    rows.append((img, lab, 0, "original"))
                for c in range(1, copies + 1):
                    stem, dot, ext = origin.rpartition(".")
                    name = f"{stem}{suffix}{c}.{ext}" if dot and copies > 1 else origin
                    try:
                        out = fn(to_array(img), origin, c)
                        rows.append((to_struct(out, name), lab, c, "ok"))
                    except Exception:  # noqa: BLE001 - counted, not raised
                        rows.append((None, lab, c, "error"))
            yield pd.DataFrame(rows, columns=["image", "label", "copy", "status"])

    return df.select("image", "label").mapInPandas(run, schema)


def resize(df: DataFrame, height: int = 224, width: int = 224, grayscale: bool = False) -> DataFrame:
    """Bilinear resize (optional grey)."""
    def fn(a, origin, c):
        out = resize_bilinear(a, height, width)
        return grey(out)[:, :, None] if grayscale else out
    return image_map(df, fn)


def color_correction(df: DataFrame, brightness: float = 1.0, contrast: float = 1.0, saturation: float = 1.0) -> DataFrame:
    """Multipliers (1.0 = unchanged); saturation only for colour images."""
    def fn(a, origin, c):
        x = a.astype(np.float64) * brightness
        m = grey(np.clip(x, 0, 255)[..., :a.shape[2]].astype(np.uint8)).mean()
        x = (x - m) * contrast + m
        if a.shape[2] >= 3 and saturation != 1.0:
            g = grey(np.clip(x, 0, 255).astype(np.uint8))[:, :, None]
            x[:, :, :3] = (x[:, :, :3] - g) * saturation + g
        return x
    return image_map(df, fn)


def denoise(df: DataFrame, method: str = "gaussian", strength: float = 0.5) -> DataFrame:
    """Gaussian radius 0.5 + 3.5 s, or median of size max(3, 2 * round(4 s) + 1)."""
    def fn(a, origin, c):
        if method == "gaussian":
            return _blur(a, 0.5 + 3.5 * strength)
        size = max(3, 2 * round(4 * strength) + 1)
        r = size // 2
        pad = np.pad(a, ((r, r), (r, r), (0, 0)), mode="edge")
        stack = [pad[i:i + a.shape[0], j:j + a.shape[1]] for i in range(size) for j in range(size)]
        return np.median(np.stack(stack), axis=0)
    return image_map(df, fn)


def convert_mode(df: DataFrame, mode: str = "RGB") -> DataFrame:
    """RGB / L / RGBA (unknown -> RGB)."""
    def fn(a, origin, c):
        if mode == "L":
            return grey(a)[:, :, None]
        base = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]
        if mode == "RGBA":
            return np.concatenate([base, np.full(base.shape[:2] + (1,), 255, dtype=base.dtype)], axis=2)
        return base
    return image_map(df, fn)


def rotate(df: DataFrame, max_angle: float = 30.0, copies: int = 1) -> DataFrame:
    """Rotation by U(-a, a) degrees (seeded by origin and copy), bilinear, same size."""
    def fn(a, origin, c):
        rng = np.random.default_rng(_seed(origin, f"rot{c}"))
        t = math.radians(rng.uniform(-max_angle, max_angle))
        h, w = a.shape[:2]
        yy, xx = np.mgrid[0:h, 0:w].astype(np.float64)
        cy, cx = (h - 1) / 2, (w - 1) / 2
        sy = (yy - cy) * math.cos(t) - (xx - cx) * math.sin(t) + cy
        sx = (yy - cy) * math.sin(t) + (xx - cx) * math.cos(t) + cx
        return _sample(a, sy, sx)
    return image_map(df, fn, copies)


def _sample(a: np.ndarray, sy: np.ndarray, sx: np.ndarray) -> np.ndarray:
    h, w = a.shape[:2]
    sy, sx = np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    wy, wx = (sy - y0)[..., None], (sx - x0)[..., None]
    a = a.astype(np.float64)
    return (a[y0, x0] * (1 - wx) + a[y0, x1] * wx) * (1 - wy) + (a[y1, x0] * (1 - wx) + a[y1, x1] * wx) * wy


def color_jitter(df: DataFrame, brightness: float = 0.2, contrast: float = 0.2, saturation: float = 0.2, copies: int = 1) -> DataFrame:
    """Factors 1 + U(-r, r) per copy."""
    def fn(a, origin, c):
        rng = np.random.default_rng(_seed(origin, f"jit{c}"))
        b, k, s = (1 + rng.uniform(-brightness, brightness), 1 + rng.uniform(-contrast, contrast),
                   1 + rng.uniform(-saturation, saturation))
        x = a.astype(np.float64) * b
        m = x.mean()
        x = (x - m) * k + m
        if a.shape[2] >= 3:
            g = x[:, :, :3].mean(axis=2, keepdims=True)
            x[:, :, :3] = (x[:, :, :3] - g) * s + g
        return x
    return image_map(df, fn, copies)


def elastic(df: DataFrame, alpha: float = 1.0, sigma: float = 0.5, copies: int = 1) -> DataFrame:
    """Displacement fields U(-1, 1) smoothed with sigma * 8, scaled by alpha * 4 px."""
    def fn(a, origin, c):
        rng = np.random.default_rng(_seed(origin, f"el{c}"))
        h, w = a.shape[:2]
        dy = _blur(rng.uniform(-1, 1, (h, w, 1)), sigma * 8)[:, :, 0] * alpha * 4
        dx = _blur(rng.uniform(-1, 1, (h, w, 1)), sigma * 8)[:, :, 0] * alpha * 4
        yy, xx = np.mgrid[0:h, 0:w].astype(np.float64)
        return _sample(a, yy + dy, xx + dx)
    return image_map(df, fn, copies)


def cutout(df: DataFrame, hole: int = 16, n: int = 1, copies: int = 1) -> DataFrame:
    """Zero n squares of side ``hole`` centred at seeded points, clipped at the border."""
    def fn(a, origin, c):
        rng = np.random.default_rng(_seed(origin, f"cut{c}"))
        out = a.copy()
        h, w = a.shape[:2]
        for _ in range(n):
            y, x = rng.integers(0, h), rng.integers(0, w)
            out[max(0, y - hole // 2):min(h, y + hole // 2), max(0, x - hole // 2):min(w, x + hole // 2)] = 0
        return out
    return image_map(df, fn, copies)


def mixup(df: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Blend each image with a same-class partner (J05), partner resized to its size;
    lambda ~ Beta(alpha, alpha) seeded by origin.  Classes with one image get no partner."""
    from tessera.operators.augment import partner_rows

    keyed = df.withColumn("__k", F.col("image.origin"))
    p = partner_rows(keyed, "__k", "label")
    other = keyed.select(F.col("__k").alias("partner_key"), F.col("image").alias("__pimg"))
    pairs = p.join(other, "partner_key")
    schema = T.StructType([T.StructField("image", IMAGE_STRUCT), T.StructField("label", T.StringType()),
                           T.StructField("partner", T.StringType()), T.StructField("lam", T.DoubleType())])

    def run(it):
        for pdf in it:
            rows = []
            for img, pimg, lab in zip(pdf["image"], pdf["__pimg"], pdf["label"]):
                a, b = to_array(img), to_array(pimg)
                if b.shape != a.shape:
                    b = resize_bilinear(b, a.shape[0], a.shape[1])[:, :, :a.shape[2]]
                lam = float(np.random.default_rng(_seed(img["origin"], "mix")).beta(alpha, alpha))
                stem, _, ext = img["origin"].rpartition(".")
                rows.append((to_struct(lam * a + (1 - lam) * b, f"{stem}_mix.{ext}"), lab, pimg["origin"], lam))
            yield pd.DataFrame(rows, columns=["image", "label", "partner", "lam"])

    return pairs.select("image", "__pimg", "label").mapInPandas(run, schema)


# ---------------------------------------------------------------------------
# analysis (I01, I02, I13-I18)
# ---------------------------------------------------------------------------


def image_statistics(df: DataFrame) -> DataFrame:
    """Per class and format: images, channels, width / height min, max, mean (struct
    fields only, no pixel decoding)."""
    ext = F.lower(F.regexp_extract("image.origin", r"\.([^./]+)$", 1))
    return df.groupBy("label", ext.alias("format"), F.col("image.nChannels").alias("channels")).agg(
        F.count(F.lit(1)).alias("images"), F.min("image.width").alias("min_width"), F.max("image.width").alias("max_width"),
        F.avg("image.width").alias("mean_width"), F.min("image.height").alias("min_height"),
        F.max("image.height").alias("max_height"), F.avg("image.height").alias("mean_height"))


def image_validation(files: DataFrame, images: DataFrame) -> DataFrame:
    """Input / valid / corrupt counts: every scanned file left-joined with the decodable
    images (a file that did not decode is corrupt)."""
    ok = images.select(F.col("image.origin").alias("path"), F.lit(True).alias("__ok"))
    j = files.join(ok, "path", "left")
    return j.agg(F.count(F.lit(1)).alias("input_files"), F.count_if(F.col("__ok")).alias("valid"),
                 F.count_if(F.col("__ok").isNull()).alias("corrupt"))


def color_histograms(df: DataFrame) -> DataFrame:
    """256-bin histograms per channel (gray / blue / green / red): per-partition
    ``bincount`` in mapInPandas, then a grouped sum of the small partial histograms."""
    schema = "channel string, bin int, count long"

    def run(it):
        acc: dict[str, np.ndarray] = {}
        for pdf in it:
            for img in pdf["image"]:
                a = to_array(img)
                names = ["gray"] if a.shape[2] == 1 else ["blue", "green", "red", "alpha"][:a.shape[2]]
                for i, nm in enumerate(names):
                    acc[nm] = acc.get(nm, np.zeros(256, dtype=np.int64)) + np.bincount(a[:, :, i].ravel(), minlength=256)
        for nm, h in acc.items():
            nz = np.nonzero(h)[0]
            yield pd.DataFrame({"channel": nm, "bin": nz.astype(np.int32), "count": h[nz]})

    parts = df.select("image").mapInPandas(run, schema)
    return parts.groupBy("channel", "bin").agg(F.sum("count").alias("count"))


def color_summary(df: DataFrame) -> DataFrame:
    """Per channel mean value (average colour) and overall mean brightness."""
    h = color_histograms(df)
    return h.groupBy("channel").agg((F.sum(F.col("bin") * F.col("count")) / F.sum("count")).alias("mean_value"),
                                    F.sum("count").alias("pixels"))


def quality_assessment(df: DataFrame, blur_threshold: float = 100.0) -> DataFrame:
    """Per image variance of the Laplacian (sharpness) and mean grey; flags blurry,
    dark (< 50) and bright (> 205)."""
    schema = "origin string, label string, sharpness double, brightness double"

    def run(it):
        for pdf in it:
            out = []
            for img, lab in zip(pdf["image"], pdf["label"]):
                g = grey(to_array(img))
                p = np.pad(g, 1, mode="edge")
                lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
                out.append((img["origin"], lab, float(lap.var()), float(g.mean())))
            yield pd.DataFrame(out, columns=["origin", "label", "sharpness", "brightness"])

    q = df.mapInPandas(run, schema)
    return q.withColumns({"blurry": F.col("sharpness") < blur_threshold, "dark": F.col("brightness") < 50,
                          "bright": F.col("brightness") > 205})


def edge_density(df: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Share of pixels whose Sobel magnitude / max exceeds the threshold."""
    schema = "origin string, label string, edge_density double"

    def run(it):
        for pdf in it:
            out = []
            for img, lab in zip(pdf["image"], pdf["label"]):
                g = np.pad(grey(to_array(img)), 1, mode="edge")
                gx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
                gy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
                m = np.hypot(gx, gy)
                mx = m.max()
                out.append((img["origin"], lab, float((m / mx > threshold).mean()) if mx > 0 else 0.0))
            yield pd.DataFrame(out, columns=["origin", "label", "edge_density"])

    return df.mapInPandas(run, schema)


def thumbnails(df: DataFrame, size: int = 32) -> DataFrame:
    """Grey thumbnails / 255 as array<double> (I15, I16, I18 input)."""
    schema = "origin string, label string, vec array<double>"

    def run(it):
        for pdf in it:
            out = []
            for img, lab in zip(pdf["image"], pdf["label"]):
                g = grey(to_array(img))[:, :, None]
                out.append((img["origin"], lab, (resize_bilinear(g, size, size)[:, :, 0] / 255.0).ravel().tolist()))
            yield pd.DataFrame(out, columns=["origin", "label", "vec"])

    return df.mapInPandas(run, schema)


def feature_embedding(df: DataFrame, size: int = 32, k: int = 2):
    """Thumbnails, centred, PCA to k: (scores frame with PC1..PCk, explained ratios)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    th = thumbnails(df, size)
    mean = th.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    mvec = mean.agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("mv")).select(F.transform("mv", lambda s: s["m"]).alias("mv"))
    centred = th.crossJoin(F.broadcast(mvec)).withColumn("cv", F.zip_with("vec", "mv", lambda x, m: x - m))
    vec = centred.withColumn("__f", array_to_vector("cv"))
    model = PCA(k=k, inputCol="__f", outputCol="__p").fit(vec)
    out = model.transform(vec).withColumn("__a", vector_to_array("__p"))
    out = out.select("origin", "label", *[F.col("__a")[i].alias(f"PC{i + 1}") for i in range(k)])
    return out, [float(x) for x in model.explainedVariance.toArray()]


def image_classify(df: DataFrame, size: int = 8, per_class: int = 300, seed: int = 42):
    """Thumbnails -> multilayer perceptron; per-class cap, 80/20 stratified split;
    returns the evaluation summary (accuracy, macro / weighted precision, recall, F1)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    from tessera.operators import ml
    from tessera.operators.relational import per_group_cap

    th = thumbnails(df, size)
    th = per_group_cap(th, "label", core.hash_uniform(F.col("origin"), "cap"), per_class)
    idx = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(th)
    data = idx.transform(th).withColumn("features", array_to_vector("vec"))
    n_cls = len(idx.labels)
    if n_cls < 2:
        raise ValueError("need at least 2 classes")
    sp = ml.stratified_split(data, "y", "origin", (0.8, 0.2), ("train", "test"), seed)
    mlp = MultilayerPerceptronClassifier(layers=[size * size, 32, n_cls], labelCol="y", featuresCol="features", seed=seed,
                                         maxIter=100)
    model = mlp.fit(sp.where("split = 'train'"))
    pred = model.transform(sp.where("split = 'test'")).select(F.col("y").cast("int").alias("label"),
                                                             F.col("prediction").cast("int").alias("prediction"))
    return ml.evaluate(pred)[1]



# ---------------------------------------------------------------------------
# PNG files from image structs (fixture writer for S04 / S05 / I01)
# ---------------------------------------------------------------------------


def _png_bytes(arr: np.ndarray) -> bytes:
    """Minimal PNG encoder (8-bit grey or BGR->RGB), filter type 0 per row."""
    import struct
    import zlib

    h, w, c = arr.shape
    if c == 3:
        arr = arr[:, :, ::-1]  # BGR -> RGB
    color = {1: 0, 3: 2, 4: 6}[c]
    raw = b"".join(b"\x00" + arr[y].tobytes() for y in range(h))

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b""))


def write_png_files(df: DataFrame, folder: str, corrupt_share: float = 0.0) -> DataFrame:
    """Each task writes its images as ``{folder}/{origin}`` PNG files (class folders kept);
    with ``corrupt_share`` > 0 a hash-chosen share of images also gets a broken sibling
    ``corrupt_{name}``.  Returns (path, bytes, corrupt) per written file.  ``folder`` must
    be a shared path (the session's checkpoint folder on a cluster)."""
    import hashlib
    import posixpath

    def run(it):
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)  # local, HDFS or object store alike
        made = set()
        for pdf in it:
            out = []
            for img in pdf["image"]:
                rel = img["origin"]
                path = posixpath.join(root, rel)
                d = posixpath.dirname(path)
                if d not in made:
                    fs.create_dir(d, recursive=True)
                    made.add(d)
                data = _png_bytes(to_array(img))
                with fs.open_output_stream(path) as fh:
                    fh.write(data)
                out.append((path, len(data), False))
                u = int(hashlib.md5(f"{rel}:corrupt".encode()).hexdigest()[:13], 16) / 16 ** 13
                if u < corrupt_share:
                    bad = posixpath.join(d, f"corrupt_{posixpath.basename(path)}")
                    with fs.open_output_stream(bad) as fh:
                        fh.write(b"\x89PNG\r\n\x1a\nthis is not an image")
                    out.append((bad, 28, True))
            yield pd.DataFrame(out, columns=["path", "bytes", "corrupt"])

    return df.select("image").mapInPandas(run, "path string, bytes long, corrupt boolean")
