"""The registered queries over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import label_of, picture_key
from ..operators import features as feat
from ..operators import kmeans, knn, metrics, selection, softmax, svm
from ..operators.estimators import EstimatorFamily
from ..operators.splits import kfold, nested_folds, stratified_holdout
from ..sources.images import cropped, described, fit_names, prediction_line
from ..sources.pnm import read_pnm, write_pnm
from ..sources.shared import shared_path, written
from ..sources.vectors import read_embeddings, trainable
from .store import refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def six(c: str, out: str | None = None):
    return F.round(F.col(c), 6).alias(out or c)


# Shared parts of the SQL.
V = "v as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as f, label from embeddings)"
SPLIT = f"""{V},
    r as (select *, row_number() over (partition by label order by md5('42:' || id), id) as rn from v),
    c as (select label, count(*) as n from v group by label),
    q as (select label, n // 5 + case when row_number() over (order by n % 5 desc, label) <= ceil((sum(n) over ()) / 5) - sum(n // 5) over () then 1 else 0 end as quota from c),
    s as (select r.id, r.f, r.label, rn <= quota as is_test from r join q on r.label = q.label),
    tr as (select * from s where not is_test), te as (select * from s where is_test)"""
DIST = {p: f"list_sum(list_transform(list_zip(a.f, b.f), lambda z: {e}))" for p, e in {1: "abs(z[1] - z[2])", 2: "(z[1] - z[2]) * (z[1] - z[2])", 3: "abs(z[1] - z[2]) ** 3"}.items()}


def predicted(p: int, k: int) -> str:
    return f"""{SPLIT},
    d as (select a.id, b.label, b.id as train_id, {DIST[p]} as dist from te a cross join tr b),
    nn as (select *, row_number() over (partition by id order by dist, train_id) as rank from d),
    vt as (select id, label, count(*) as n from nn where rank <= {k} group by id, label),
    pr as (select id, label as prediction from (select *, row_number() over (partition by id order by n desc, label) as o from vt) where o = 1),
    pl as (select pr.id, te.label, pr.prediction from pr join te on pr.id = te.id)"""


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    split = written(stratified_holdout(trainable(read_embeddings(spark, sf_dir))), "holdout")
    return split.where("not is_test").drop("is_test"), split.where("is_test").drop("is_test")


def knn_labelled(spark: SparkSession, sf_dir: str, k: int = 5, p: int = 2) -> DataFrame:
    train, test = parts(spark, sf_dir)
    return knn.knn_predict(train, test, k, p).join(test.select("id", "label"), "id").select("id", "label", "prediction")


# --- splits and folds ---


@query(f"with {SPLIT} select id, label, is_test from s")
def stratified_split(spark, sf_dir):
    return stratified_holdout(read_embeddings(spark, sf_dir)).select("id", "label", "is_test")


@query("""with r as (select doc_id as id, quality as label, row_number() over (partition by quality order by md5('42:' || doc_id), doc_id) as rn from labels),
    c as (select label, count(*) as n from r group by label),
    q as (select label, n // 5 + case when row_number() over (order by n % 5 desc, label) <= ceil((sum(n) over ()) / 5) - sum(n // 5) over () then 1 else 0 end as quota from c)
    select r.id, r.label, rn <= quota as is_test from r join q on r.label = q.label""")
def stratified_split_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return stratified_holdout(labels)


@query(f"with {V} select id, cast(ntile(5) over (order by md5('42:' || id), id) as int) as fold from v")
def kfold_assign(spark, sf_dir):
    return kfold(read_embeddings(spark, sf_dir), 5).select("id", "fold")


NESTED = f"""{V}, o as (select id, f, label, ntile(5) over (order by md5('42:' || id), id) as own from v),
    x as (select o.id, o.f, o.label, g.outer_ as outer_ from o join (select unnest(range(1, 6)) as outer_) g on g.outer_ <> o.own),
    nf as (select *, ntile(3) over (partition by outer_ order by md5('42:' || id), id) as inner_ from x)"""


@query(f'with {NESTED} select id, cast(outer_ as int) as "outer", cast(inner_ as int) as "inner" from nf')
def nested_fold_assign(spark, sf_dir):
    return nested_folds(read_embeddings(spark, sf_dir), 5, 3).select("id", "outer", "inner")


# --- features ---


@query(f"with {V}, u as (select unnest(f) as x, generate_subscripts(f, 1) - 1 as pos from v) select cast(pos as int) as pos, round(avg(x), 6) as mean, round(case when stddev_pop(x) < 1e-6 then 1 else stddev_pop(x) end, 6) as std from u group by pos")
def scaler_fit(spark, sf_dir):
    return feat.scaler_table(read_embeddings(spark, sf_dir)).select("pos", six("mean"), six("std"))


@query(f"""with {V}, u as (select id, unnest(f) as x, generate_subscripts(f, 1) - 1 as pos from v),
    m as (select pos, avg(x) as mean, case when stddev_pop(x) < 1e-6 then 1 else stddev_pop(x) end as std from u group by pos)
    select id, cast(u.pos as int) as pos, round((x - mean) / std, 6) as z from u join m on u.pos = m.pos""")
def standard_scale(spark, sf_dir):
    df = read_embeddings(spark, sf_dir)
    return feat.standardise(df, feat.fit_scaler(df)).select("id", F.posexplode("features").alias("pos", "z")).select("id", "pos", six("z"))


@query()
def pca_variance(spark, sf_dir):
    df = read_embeddings(spark, sf_dir)
    ratio = feat.fit_pca(feat.standardise(df, feat.fit_scaler(df)), 32).ratio
    return spark.createDataFrame([(i, float(r)) for i, r in enumerate(ratio)], "component int, ratio double")


@query()
def pca_scores(spark, sf_dir):
    df = read_embeddings(spark, sf_dir)
    return feat.project(df, feat.fit_pca(df, 8))


@query("select count(*) as n_rows, cast(max(len(embedding)) as int) as n_features, count(distinct label) as n_labels from embeddings")
def dataset_profile(spark, sf_dir):
    return feat.profile(read_embeddings(spark, sf_dir))


@query("select label, count(*) as n, round(sum(count(*)) over () / (count(*) over () * count(*)), 6) as weight from embeddings group by label")
def class_weights(spark, sf_dir):
    return feat.class_weights(read_embeddings(spark, sf_dir)).select("label", "n", six("weight"))


@query(f"with {V}, u as (select len(f) as d, unnest(f) as x from v) select round(1.0 / (max(d) * var_pop(x)), 6) as scale, round(1.0 / max(d), 6) as auto from u")
def gamma_scale(spark, sf_dir):
    return feat.kernel_widths(read_embeddings(spark, sf_dir)).select(six("scale"), six("auto"))


@query("""with i as (select label, cast(row_number() over (order by label) - 1 as int) as idx from (select distinct label from embeddings)),
    k as (select count(*) as k from i)
    select vec_id as id, e.label, idx, array_to_string(list_transform(range(k), lambda j: case when j = idx then '1' else '0' end), '') as one_hot from embeddings e join i on e.label = i.label cross join k""")
def one_hot_labels(spark, sf_dir):
    df = read_embeddings(spark, sf_dir)
    return feat.one_hot(df, feat.label_index(df)).select("id", "label", "idx", F.array_join(F.col("one_hot").cast("array<string>"), "").alias("one_hot"))


# --- names and images, made from the embeddings' rows ---

NAME = "case when vec_id % 50 = 0 then 'x' || vec_id || '.pgm' else 'p' || label || '_i' || vec_id || '.pgm' end"
H, W = 16, 24


@query(f"""with n as (select vec_id as id, {NAME} as name, label as l from embeddings),
    k as (select *, case when id % 50 = 0 then -1 else l end as label, case when id % 50 = 0 then id else l end as picture from n),
    o as (select *, row_number() over (order by case when id % 50 = 0 then 1 else 0 end, picture, id) as place from k)
    select id, name, cast(label as int) as label, cast(picture as bigint) as picture, place <= 100 as in_fit from o""")
def natural_sort_labels(spark, sf_dir):
    named = read_embeddings(spark, sf_dir).select("id", F.expr(NAME.replace("vec_id", "id")).alias("name"))
    first = fit_names(named, 100).select("name", F.lit(True).alias("hit"))
    keyed = named.select("id", "name", label_of(F.col("name")).alias("label"), picture_key(F.col("name")).alias("picture"))
    return keyed.join(first, "name", "left").select("id", "name", "label", "picture", F.coalesce("hit", F.lit(False)).alias("in_fit"))


def pixels() -> Column:
    """The gray values of an embedding's image: made from its numbers, bars of 127 at the sides."""
    pixel = lambda i: F.when((i % W < F.col("id") % 4) | (i % W >= W - F.floor(F.col("id") / 4) % 3), F.lit(127)).otherwise(F.floor(F.abs(F.element_at("features", (i % 64 + 1).cast("int"))) * 1000) % 256)
    return F.transform(F.sequence(F.lit(0), F.lit(H * W - 1)), lambda i: pixel(i).cast("long"))


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of a gray image file per embedding."""
    digits = F.transform(pixels(), lambda v: F.lpad(F.hex(v), 2, "0"))
    content = F.concat(F.lit(f"P5 {W} {H} 255\n").cast("binary"), F.unhex(F.array_join(digits, "")))
    return read_embeddings(spark, sf_dir).select(F.col("id").cast("string").alias("name"), "label", content.alias("content"))


def image_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of image files, one per embedding, named by NAME."""
    folder = shared_path(spark, "images")
    dealt = read_embeddings(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)  # the table's files may be few
    rows = dealt.select(F.expr(NAME.replace("vec_id", "id")).alias("name"), F.lit(H).alias("h"), F.lit(W).alias("w"), pixels().cast("array<float>").alias("pix"))
    write_pnm(rows, folder)
    return folder


PIXELS = f"""px as (
        select vec_id as img, r, c, case when c < vec_id % 4 or c >= {W} - (vec_id // 4) % 3 then 127 else cast(floor(abs(cast(embedding[((r * {W} + c) % 64) + 1] as double)) * 1000) as bigint) % 256 end as v
        from embeddings, (select unnest(range({H})) as r), (select unnest(range({W})) as c)
    ),
    gc as (select img, c, abs(avg(v) - 127) <= 2 and stddev_pop(v) <= 0.75 as gray from px group by img, c),
    b0 as (select img, coalesce(min(case when not gray then c end), {W}) as l, coalesce({W} - 1 - max(case when not gray then c end), 0) as r from gc group by img),
    bars as (select img, case when l > {W // 4} then 0 else l end as l, case when r > {W // 4} then 0 else r end as r from b0),
    cp as (select px.img, px.r, px.c - bars.l as c, cast(px.v as double) / 255 as v, {W} - bars.l - bars.r as w from px join bars on px.img = bars.img where px.c >= bars.l and px.c < {W} - bars.r)"""


@query(f"""with {PIXELS}, n as (select vec_id, {NAME} as name, cast(case when vec_id % 50 = 0 then -1 else label end as int) as label from embeddings)
    select n.name, n.label, cast({H} as int) as h, cast({W} as int) as w, cast(sum(px.v) as bigint) as total, cast(sum(px.v * (px.r * {W} + px.c + 1)) as bigint) as weighted
    from px join n on px.img = n.vec_id group by n.name, n.label""")
def image_source(spark, sf_dir):
    """Images written as files and read by the data source: their names, labels, sizes and sums of gray values."""
    images = read_pnm(spark, image_folder(spark, sf_dir), "name string, label int, h int, w int, pix array<float>")
    summed = lambda f: F.aggregate(F.transform("pix", f), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return images.select("name", "label", "h", "w", summed(lambda v: v.cast("bigint")).alias("total"), summed(lambda v, i: v.cast("bigint") * (i + 1)).alias("weighted"))


@query()
def image_feature_job(spark, sf_dir):
    """The whole feature job over a folder of files: fitted on the first 800, described, kept in a store."""
    found = refresh(spark, image_folder(spark, sf_dir), shared_path(spark, "store"))
    return found.features.select("name", "label", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query(f'with {PIXELS} select cast(img as bigint) as id, cast({H} as int) as h, cast({W} - l - r as int) as w, cast(l as int) as left_bar, cast(r as int) as right_bar from bars')
def gray_bar_crop(spark, sf_dir):
    return cropped(image_files(spark, sf_dir)).select(F.col("name").cast("bigint").alias("id"), "h", "w", F.col("left").alias("left_bar"), F.col("right").alias("right_bar"))


@query(f"""with {PIXELS}, sh as (select {W} - l - r as w, count(*) as n, min(img) as f from bars group by 1),
    top as (select w, n from sh order by n desc, f limit 1)
    select cast({H} as int) as h, cast(top.w as int) as w, top.n as n_kept, (select count(*) from bars) - top.n as n_rejected from top""")
def common_shape(spark, sf_dir):
    images = cropped(image_files(spark, sf_dir)).withColumn("ord", F.col("name").cast("bigint"))
    shape = feat.common_shape(images)
    kept, rejected = feat.split_by_shape(images, shape)
    count = lambda df, out: df.agg(F.count("*").alias(out))
    return shape.select("h", "w").crossJoin(count(kept, "n_kept")).crossJoin(count(rejected, "n_rejected"))  # three single rows


@query(f"with {PIXELS} select cast({H} as int) as h, cast({W} - l - r as int) as w, count(*) as n, cast(min(img) as bigint) as first_seen from bars group by 1, 2")
def shape_counts(spark, sf_dir):
    return feat.shape_counts(cropped(image_files(spark, sf_dir)).withColumn("ord", F.col("name").cast("bigint")))


@query(f"""with {PIXELS},
    gr as (select img, r, c, w, case when r = 0 or r = {H - 1} then 0 else lead(v) over (partition by img, c order by r) - lag(v) over (partition by img, c order by r) end as gy,
                  case when c = 0 or c = w - 1 then 0 else lead(v) over (partition by img, r order by c) - lag(v) over (partition by img, r order by c) end as gx from cp),
    an as (select *, sqrt(gy * gy + gx * gx) as mag, degrees(atan2(gy, gx)) as a0 from gr),
    ab as (select *, case when a0 < 0 then a0 + 180 else a0 end as a1 from an),
    ce as (select img, w, r // 8 as cy, c // 8 as cx, least(8, cast(floor(case when a1 >= 180 then a1 - 180 else a1 end / 20) as int)) as bin, sum(mag) / 64 as s from ab where r < {H // 8 * 8} and c < w // 8 * 8 group by 1, 2, 3, 4, 5),
    dn as (select i.img, i.w, y.cy, x.cx, k.bin from (select distinct img, w from cp) i, (select unnest(range({H // 8})) as cy) y, (select unnest(range({W // 8})) as cx) x, (select unnest(range(9)) as bin) k where x.cx < i.w // 8),
    fc as (select dn.*, coalesce(ce.s, 0) as s from dn left join ce on dn.img = ce.img and dn.cy = ce.cy and dn.cx = ce.cx and dn.bin = ce.bin),
    bl as (select img, w, cy - oy as by_, cx - ox as bx, oy, ox, bin, s from fc, (select unnest(range(2)) as oy), (select unnest(range(2)) as ox) where cy - oy between 0 and {H // 8 - 2} and cx - ox between 0 and w // 8 - 2),
    n1 as (select *, least(0.2, s / sqrt(sum(s * s) over (partition by img, by_, bx) + 1e-10)) as t from bl),
    n2 as (select *, t / sqrt(sum(t * t) over (partition by img, by_, bx) + 1e-10) as u from n1)
    select cast(img as bigint) as id, cast((by_ * (w // 8 - 1) + bx) * 36 + (oy * 2 + ox) * 9 + bin as int) as pos, round(u, 5) as value from n2""")
def hog_features(spark, sf_dir):
    found = described(cropped(image_files(spark, sf_dir)), equalise=False)
    return found.select(F.col("name").cast("bigint").alias("id"), F.posexplode("features").alias("pos", "x")).select("id", "pos", F.round("x", 5).alias("value"))


@query()
def clahe_features(spark, sf_dir):
    return described(cropped(image_files(spark, sf_dir)), equalise=True)


# --- nearest neighbours and reports ---

for _p in (1, 2, 3):

    def _knn(spark, sf_dir, p=_p):
        return knn_labelled(spark, sf_dir, 5, p)

    QUERIES[f"knn_predict_p{_p}"] = _knn
    ORACLE_SQL[f"knn_predict_p{_p}"] = f"with {predicted(_p, 5)} select id, label, prediction from pl"

SWEEP = f"""{SPLIT},
    d as (select 1 as p, a.id, b.label, b.id as train_id, {DIST[1]} as dist from te a cross join tr b
          union all select 2, a.id, b.label, b.id, {DIST[2]} from te a cross join tr b
          union all select 3, a.id, b.label, b.id, {DIST[3]} from te a cross join tr b),
    nn as (select *, row_number() over (partition by p, id order by dist, train_id) as rank from d),
    vt as (select p, k, id, label, count(*) as n from nn, (select unnest([1, 3, 5, 11]) as k) where rank <= k group by p, k, id, label),
    pr as (select p, k, id, label as prediction from (select *, row_number() over (partition by p, k, id order by n desc, label) as o from vt) where o = 1),
    ac as (select p, k, avg(case when te.label = prediction then 1.0 else 0.0 end) as accuracy from pr join te on pr.id = te.id group by p, k)"""


@query(f"with {SWEEP} select p, k, round(accuracy, 6) as accuracy, cast(row_number() over (order by accuracy desc, p, k) as int) as rank, row_number() over (order by accuracy desc, p, k) = 1 as is_best from ac")
def knn_sweep(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    scores = metrics.accuracy(knn.knn_sweep(train, test).join(test.select("id", "label"), "id"), ["p", "k"])
    return metrics.leaderboard(scores, order=("p", "k")).select("p", "k", six("accuracy"), "rank", "is_best")


@query(f"with {predicted(2, 5)} select round(avg(case when label = prediction then 1.0 else 0.0 end), 6) as accuracy from pl")
def accuracy(spark, sf_dir):
    return metrics.accuracy(knn_labelled(spark, sf_dir)).select(six("accuracy"))


REPORT = """
    t as (select label, count(*) as support, sum(case when label = prediction then 1 else 0 end) as hits from pl group by label),
    g as (select prediction as label, count(*) as said from pl group by prediction),
    m as (select coalesce(t.label, g.label) as label, coalesce(support, 0) as support, coalesce(hits, 0) as hits, coalesce(said, 0) as said from t {how} join g on t.label = g.label),
    e as (select *, coalesce(hits / nullif(said, 0), 0) as pr_, coalesce(hits / nullif(support, 0), 0) as re_ from m),
    h as (select *, coalesce(2 * pr_ * re_ / nullif(pr_ + re_, 0), 0) as f_ from e)
    select cast(label as varchar) as class, round(pr_, 6) as "precision", round(re_, 6) as recall, round(f_, 6) as f1, cast(support as bigint) as support from h
    union all select 'macro', round(avg(pr_), 6), round(avg(re_), 6), round(avg(f_), 6), cast(sum(support) as bigint) from h"""


def rounded_report(report: DataFrame) -> DataFrame:
    return report.select("class", six("precision"), six("recall"), six("f1"), "support")


@query(f"with {predicted(2, 5)}, {REPORT.format(how='left')}")
def class_report(spark, sf_dir):
    return rounded_report(metrics.class_report(knn_labelled(spark, sf_dir)))


@query(f"""with {predicted(2, 5)}, {REPORT.format(how='full')}
    union all select 'weighted', round(sum(pr_ * support) / sum(support), 6), round(sum(re_ * support) / sum(support), 6), round(sum(f_ * support) / sum(support), 6), cast(sum(support) as bigint) from h
    union all select 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), cast(sum(support) as bigint) from h""")
def class_report_union(spark, sf_dir):
    return rounded_report(metrics.class_report(knn_labelled(spark, sf_dir), union=True))


@query(f"with {predicted(2, 5)} select string_agg(prediction, ',' order by id) || ',' as value from pl")
def submission_line(spark, sf_dir):
    return prediction_line(knn_labelled(spark, sf_dir).select(F.concat(F.lit("img"), F.col("id").cast("string"), F.lit(".pgm")).alias("name"), "prediction"))


# --- clustering ---

K = 10
INIT = f"{V}, o as (select *, row_number() over (order by md5('42:' || id), id) as rn from v), c0 as (select cast(rn - 1 as int) as cluster, f from o where rn <= {K})"


def lloyd(i: int) -> str:
    """One round: centroids c<i> from c<i-1>; an empty cluster takes the next row of the order (none occurs in these data)."""
    return f""",
    a{i} as (select id, cluster, label, d from (select a.id, a.label, b.cluster, {DIST[2]} as d, row_number() over (partition by a.id order by {DIST[2]}, b.cluster) as o from v a cross join c{i - 1} b) where o = 1),
    e{i} as (select cluster, pos, avg(x) as x from (select a{i}.cluster, unnest(v.f) as x, generate_subscripts(v.f, 1) as pos from a{i} join v on a{i}.id = v.id) group by cluster, pos),
    c{i} as (select cluster, list(x order by pos) as f from e{i} group by cluster)"""


def centroid_rows(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    rows = [(c, p, round(float(x), 6)) for c, row in enumerate(centroids) for p, x in enumerate(row)]
    return spark.createDataFrame(rows, "cluster int, pos int, value double")


CENTROIDS = "select cluster, cast(pos - 1 as int) as pos, round(x, 6) as value from e{}"
THREE = INIT + "".join(map(lloyd, (1, 2, 3)))


@query(f"with {INIT} select cluster, cast(pos - 1 as int) as pos, round(x, 6) as value from (select cluster, unnest(f) as x, generate_subscripts(f, 1) as pos from c0)")
def kmeans_init(spark, sf_dir):
    return centroid_rows(spark, kmeans.seeded_rows(read_embeddings(spark, sf_dir), K))


@query(f"with {INIT}{lloyd(1)} {CENTROIDS.format(1)}")
def kmeans_step(spark, sf_dir):
    df = read_embeddings(spark, sf_dir)
    first = kmeans.seeded_rows(df, K)
    return kmeans.cluster_sums(df, first).select("cluster", "pos", F.round(F.col("total") / F.col("n"), 6).alias("value"))


@query(f"with {THREE} {CENTROIDS.format(3)}")
def kmeans_fit(spark, sf_dir):
    return centroid_rows(spark, kmeans.fit_kmeans(read_embeddings(spark, sf_dir), K, max_iter=3).centroids)


@query(f"with {THREE} {CENTROIDS.format(3)}")
def kmeans_held_fit(spark, sf_dir):
    """The same rounds in one barrier stage, with bounds instead of all distances."""
    return centroid_rows(spark, kmeans.fit_kmeans_held(read_embeddings(spark, sf_dir), K, max_iter=3)[0].centroids)


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_embeddings(spark, sf_dir)
    return kmeans.assign(df, kmeans.fit_kmeans(df, K, max_iter=3).centroids)


CLUSTERED = THREE + lloyd(4).split("e4 as")[0].rstrip(" ,\n")


@query(f"with {CLUSTERED} select id, label, cluster, round(d, 6) as dist from a4")
def kmeans_assign(spark, sf_dir):
    return clustered(spark, sf_dir).select("id", "label", "cluster", six("dist"))


@query(f"with {CLUSTERED} select round(sum(d), 6) as inertia from a4")
def kmeans_inertia(spark, sf_dir):
    df = read_embeddings(spark, sf_dir)
    return kmeans.inertia(df, kmeans.fit_kmeans(df, K, max_iter=3).centroids).select(six("inertia"))


@query(f"with {CLUSTERED} select label, cluster, count(*) as n from a4 group by label, cluster")
def cluster_contingency(spark, sf_dir):
    return metrics.contingency(clustered(spark, sf_dir))


@query(f"""with {CLUSTERED}, t as (select label, cluster, count(*) as n from a4 group by label, cluster),
    s as (select sum(n * (n - 1) / 2) as s, sum(n) as total from t),
    a as (select sum(m * (m - 1) / 2) as a from (select sum(n) as m from t group by label)), b as (select sum(m * (m - 1) / 2) as b from (select sum(n) as m from t group by cluster))
    select round((s - a * b / (total * (total - 1) / 2)) / ((a + b) / 2 - a * b / (total * (total - 1) / 2)), 6) as ari from s, a, b""")
def adjusted_rand(spark, sf_dir):
    return metrics.adjusted_rand_index(metrics.contingency(clustered(spark, sf_dir))).select(six("ari"))


@query(f"""with {CLUSTERED}, t as (select label, cluster, count(*) / (sum(count(*)) over ()) as p from a4 group by label, cluster),
    m as (select *, sum(p) over (partition by label) as pa, sum(p) over (partition by cluster) as pb from t)
    select round(sum(p * ln(p / (pa * pb))) / ((-sum(p * ln(pa)) - sum(p * ln(pb))) / 2), 6) as nmi from m""")
def mutual_information(spark, sf_dir):
    return metrics.normalised_mutual_information(metrics.contingency(clustered(spark, sf_dir))).select(six("nmi"))


@query("""with recursive n as (select label, vec_id % 7 as cluster, count(*) as n from embeddings group by all),
    l as (select label, row_number() over (order by label) - 1 as bit from (select distinct label from embeddings)),
    d as (select 0 as cluster, 0 as used, cast(0 as bigint) as total
        union all
        select cluster, used, max(total) as total from (
            select d.cluster + 1 as cluster, d.used + coalesce(cast(1 << l.bit as int), 0) as used, d.total + coalesce(n.n, 0) as total
            from d join (select bit, label from l union all select null, null) l on l.bit is null or (d.used >> l.bit) % 2 = 0
            left join n on n.cluster = d.cluster and n.label = l.label where d.cluster < 7) group by all)
    select max(total) as matched from d where cluster = 7""")
def label_map_matched(spark, sf_dir):
    """Rows whose cluster is mapped to their label by the best one-to-one map."""
    df = read_embeddings(spark, sf_dir).select("label", (F.col("id") % 7).cast("int").alias("cluster"))
    mapped = kmeans.apply_label_map(df, kmeans.label_map(df))
    return mapped.agg(F.sum((F.col("label") == F.col("prediction")).cast("long")).alias("matched"))


@query()
def label_map_accuracy(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    centroids = kmeans.fit_kmeans(train, K, max_iter=5).centroids
    return kmeans.mapped_accuracy(kmeans.assign(train, centroids), kmeans.assign(test, centroids))


@query()
def kmeans_converged(spark, sf_dir):
    """Clusters as they stand when no centroid moves any more, with the number of rounds and the inertia."""
    df = read_embeddings(spark, sf_dir)
    model = kmeans.fit_kmeans_held(df, 28, max_iter=300)[0]  # one job, not one a round
    return kmeans.inertia(df, model.centroids).select(F.lit(model.n_iter).alias("n_iter"), six("inertia"))


# --- softmax regression ---

REG, LR = 1e-4, 0.5
FIXED = f"""{V}, k as (select distinct label as c from v),
    z as (select id, label, c, list_sum(list_transform(range(64), lambda j: f[j + 1] * ((j * 7 + c * 3) % 11 - 5) / 10.0)) + c / 100.0 as z from v, k),
    e as (select *, exp(z - max(z) over (partition by id)) as e from z),
    p as (select id, label, c, e / sum(e) over (partition by id) as p from e)"""


def fixed_model(df: DataFrame) -> softmax.Softmax:
    """A model whose weights follow a rule, so that SQL can have the same."""
    classes = [r.label for r in df.select("label").distinct().orderBy("label").collect()]
    j, c = np.arange(64)[:, None], np.array(classes)[None, :]
    return softmax.Softmax(((j * 7 + c * 3) % 11 - 5) / 10.0, np.array(classes) / 100.0, classes)


@query(f"with {FIXED} select id, cast(c as int) as class, round(p, 6) as probability from p")
def softmax_proba(spark, sf_dir):
    df = read_embeddings(spark, sf_dir)
    model = fixed_model(df)
    classes = F.array(*[F.lit(c) for c in model.classes])
    return softmax.probabilities(df, model).select("id", F.explode(F.arrays_zip(classes.alias("class"), F.col("probability"))).alias("x")).select("id", "x.class", F.round("x.probability", 6).alias("probability"))


@query(f"with {FIXED} select id, cast(arg_min(c, (-p, c)) as int) as prediction from p group by id")
def softmax_predict(spark, sf_dir):
    df = read_embeddings(spark, sf_dir)
    return softmax.predict(df, fixed_model(df)).select("id", "prediction")


@query(f"""with {FIXED}, w as (select sum((((j * 7 + c * 3) % 11 - 5) / 10.0) ** 2) as w2 from k, (select unnest(range(64)) as j))
    select round(avg(-ln(greatest(p, 1e-15))) + {REG} / 2 * max(w2), 6) as loss from p, w where c = label""")
def softmax_loss(spark, sf_dir):
    df = read_embeddings(spark, sf_dir)
    return softmax.loss(df, fixed_model(df), REG).select(six("loss"))


@query(f"""with {FIXED}, n as (select count(*) as n from v),
    g as (select c, j, sum(v.f[j + 1] * (p - case when c = p.label then 1 else 0 end)) as g from p join v on p.id = v.id, (select unnest(range(64)) as j) group by c, j)
    select cast(c as int) as class, cast(j as int) as pos, round((((j * 7 + c * 3) % 11 - 5) / 10.0) - {LR} * (g / n + {REG} * (((j * 7 + c * 3) % 11 - 5) / 10.0)), 6) as weight from g, n""")
def softmax_gd_step(spark, sf_dir):
    df = read_embeddings(spark, sf_dir)
    model = softmax.gradient_step(df, fixed_model(df), LR, REG)
    return spark.createDataFrame([(int(c), j, round(float(model.weights[j, i]), 6)) for i, c in enumerate(model.classes) for j in range(len(model.weights))], "class int, pos int, weight double")


@query()
def softmax_fit(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return softmax.predict(test, softmax.fit_optimum(train)).select("id", "label", "prediction")


@query()
def softmax_sweep(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    grid = [(0.1, 1e-4, 64), (0.1, 1e-3, 64), (0.1, 1e-2, 64), (0.05, 1e-4, 64), (0.05, 1e-3, 64), (0.01, 1e-4, 64), (0.01, 1e-3, 64), (0.1, 1e-4, 128), (0.1, 1e-4, None)]
    family = selection.SoftmaxFamily([{"lr": lr, "reg": reg, "epochs": 1000, "batch": b} for lr, reg, b in grid])
    scores = selection.scored(family.predict(train, test, ()), test, ())
    return metrics.leaderboard(scores.withColumn("config", F.col("config").cast("int")))


@query()
def softmax_history(spark, sf_dir):
    """Loss and validation accuracy by epoch of mini-batch descent, every step made by all tasks together."""
    train, test = parts(spark, sf_dir)
    configs = spark.createDataFrame([("0", 0.1, 1e-4, 6, 128), ("1", 0.05, 1e-3, 8, 0)], "config string, lr double, reg double, epochs int, batch int")
    models = softmax.fit_barrier(train, configs, validation=test, every=2)
    return models.select("config", F.explode("history").alias("h")).select("config", "h.epoch", six("h.loss", "loss"), six("h.accuracy", "accuracy"))


# --- support vector machines ---


@query("with c as (select label, count(*) as n from embeddings group by label) select a.label as a, b.label as b, a.n + b.n as n_rows from c a join c b on a.label < b.label")
def svm_pairs(spark, sf_dir):
    return svm.class_pairs(read_embeddings(spark, sf_dir)).groupBy("a", "b").agg(F.count("*").alias("n_rows"))


@query(f"""with {V}, k as (select distinct label as c from v), pr as (select a.c as a, b.c as b from k a join k b on a.c < b.c),
    d as (select id, a, b, list_sum(list_transform(range(64), lambda j: f[j + 1] * ((j * 5 + a * 3 + b * 2) % 13 - 6) / 10.0)) + (a - b) / 50.0 as s from v, pr),
    vt as (select id, case when s > 0 then a else b end as label, count(*) as n from d group by 1, 2)
    select id, cast(label as int) as prediction from (select *, row_number() over (partition by id order by n desc, label) as o from vt) where o = 1""")
def svm_votes(spark, sf_dir):
    """Votes of linear models whose weights follow a rule, so that SQL can have the same."""
    df = read_embeddings(spark, sf_dir)
    classes = [r.label for r in df.select("label").distinct().orderBy("label").collect()]
    weights = lambda a, b: [((j * 5 + a * 3 + b * 2) % 13 - 6) / 10.0 for j in range(64)]
    rows = [("0", a, b, "linear", 0.0, (a - b) / 50.0, [1.0], [weights(a, b)]) for a in classes for b in classes if a < b]
    models = spark.createDataFrame(rows, "config string, a int, b int, kernel string, gamma double, bias double, coef array<double>, support array<array<double>>")
    return svm.predict_pairs(models, df).select("id", "prediction")


@query()
def svm_predict(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return selection.SVMFamily([{"kernel": "rbf", "c": 5.0}]).predict(train, test, ()).select("id", "prediction")


@query()
def svm_sweep(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    grid = [{"kernel": "linear", "c": c} for c in (0.1, 1.0, 10.0)] + [{"kernel": "rbf", "c": c} for c in (0.1, 1.0, 5.0, 10.0, 50.0)]
    grid += [{"kernel": "rbf", "c": c, "gamma": "auto"} for c in (1.0, 5.0)] + [{"kernel": "poly", "c": c} for c in (1.0, 5.0, 10.0)]
    scores = selection.scored(selection.SVMFamily(grid).predict(train, test, ()), test, ())
    return metrics.leaderboard(scores.withColumn("config", F.col("config").cast("int")))


# --- model selection ---

KS = (3, 5, 11)
CV = f"""{NESTED},
    di as (select outer_, a.inner_ as fold, a.id, a.label as truth, b.label, b.id as train_id, {DIST[2]} as dist from nf a join nf b using (outer_) where a.inner_ <> b.inner_),
    ni as (select *, row_number() over (partition by outer_, fold, id order by dist, train_id) as rank from di),
    vi as (select outer_, fold, k, id, truth, label, count(*) as n from ni, (select unnest([3, 5, 11]) as k) where rank <= k group by all),
    pi as (select *, row_number() over (partition by outer_, fold, k, id order by n desc, label) as o from vi),
    si as (select outer_, fold, k, avg(case when truth = label then 1.0 else 0.0 end) as acc from pi where o = 1 group by all),
    mi as (select outer_, k, avg(acc) as score from si group by all),
    bi as (select outer_, k from (select *, row_number() over (partition by outer_ order by round(score, 9) desc, k) as o from mi) where o = 1),
    dx as (select a.own as outer_, a.id, a.label as truth, b.label, b.id as train_id, {DIST[2]} as dist from o a join o b on a.own <> b.own),
    nx as (select *, row_number() over (partition by outer_, id order by dist, train_id) as rank from dx),
    vx as (select nx.outer_, bi.k, id, truth, label, count(*) as n from nx join bi on nx.outer_ = bi.outer_ where rank <= bi.k group by all),
    ox as (select *, row_number() over (partition by outer_, id order by n desc, label) as o from vx),
    sx as (select outer_, k, avg(case when truth = label then 1.0 else 0.0 end) as acc from ox where o = 1 group by all)"""


def knn_family() -> selection.KNNFamily:
    return selection.KNNFamily([{"k": k, "p": 2} for k in KS])


def config_to_k(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.element_at(F.array(*[F.lit(k) for k in KS]), F.col("config").cast("int") + 1)).drop("config")


@query(f'with {CV} select cast(outer_ as int) as "outer", k, round(score, 6) as score from mi')
def knn_inner_search(spark, sf_dir):
    return config_to_k(selection.inner_search(read_embeddings(spark, sf_dir), knn_family())).select("outer", "k", six("score"))


@query(f'with {CV} select cast(outer_ as int) as "outer", k, round(acc, 6) as accuracy from sx')
def knn_nested_cv(spark, sf_dir):
    return config_to_k(selection.nested_scores(read_embeddings(spark, sf_dir), [knn_family()])).select("outer", "k", six("accuracy"))


@query(f"""with {CV}, w as (select arg_min(k, (-t, f)) as k from (select k, count(*) as t, min(outer_) as f from sx group by k))
    select 'knn' as model, round(avg(acc), 6) as mean, round(var_pop(acc), 6) as variance, max(w.k) as k, true as is_best from sx, w""")
def model_table(spark, sf_dir):
    table = selection.model_table(selection.nested_scores(read_embeddings(spark, sf_dir), [knn_family()]))
    return config_to_k(table).select("model", six("mean"), six("variance"), "k", "is_best")


class FixedFamily:
    """Linear scores whose weights follow a rule of the setting: nothing is learned, so SQL can have the same."""

    name = "fixed"

    def __init__(self, settings=({"shift": 0}, {"shift": 3}, {"shift": 7})):
        self.settings = settings

    def predict(self, train: DataFrame, test: DataFrame, by=()) -> DataFrame:
        classes = [r.label for r in train.select("label").distinct().orderBy("label").collect()]
        j, c = np.arange(64)[:, None], np.array(classes)[None, :]
        out = None
        for i, s in enumerate(self.settings):
            model = softmax.Softmax(((j * 7 + c * 3 + s["shift"]) % 11 - 5) / 10.0, np.array(classes) / 100.0, classes)
            found = softmax.predict(test, model).select(*by, F.lit(str(i)).alias("config"), "id", "prediction")
            out = found if out is None else out.unionByName(found)
        return out


@query(f"""with {CV}, kk as (select distinct label as c from v),
    fz as (select id, label, s as config, c, list_sum(list_transform(range(64), lambda j: f[j + 1] * ((j * 7 + c * 3 + [0, 3, 7][s + 1]) % 11 - 5) / 10.0)) + c / 100.0 as z from v, kk, (select unnest([0, 1, 2]) as s)),
    fp as (select id, config, case when any_value(label) = arg_min(c, (-z, c)) then 1.0 else 0.0 end as hit from fz group by id, config),
    fi as (select outer_, config, avg(acc) as score from (select outer_, inner_, config, avg(hit) as acc from nf join fp using (id) group by all) group by all),
    fb as (select outer_, config from (select *, row_number() over (partition by outer_ order by round(score, 9) desc, config) as o from fi) where o = 1),
    fx as (select o.own as outer_, fp.config, avg(hit) as acc from o join fp using (id) join fb on fb.outer_ = o.own and fb.config = fp.config group by all),
    every as (select 'knn' as model, 0 as model_idx, outer_, k // 4 as config, acc from sx union all select 'fixed', 1, outer_, config, acc from fx),
    w as (select model, arg_min(config, (-t, f)) as config from (select model, config, count(*) as t, min(outer_) as f from every group by all) group by model),
    m as (select model, model_idx, avg(acc) as mean, var_pop(acc) as variance from every group by all)
    select model, round(mean, 6) as mean, round(variance, 6) as variance, cast(config as varchar) as config, row_number() over (order by round(mean, 9) desc, model_idx) = 1 as is_best from m join w using (model)""")
def best_of_families(spark, sf_dir):
    """Nested cross-validation of two families, the commonest setting of each, and the best family."""
    scores = selection.nested_scores(read_embeddings(spark, sf_dir), [knn_family(), FixedFamily()])
    return selection.model_table(scores).select("model", six("mean"), six("variance"), "config", "is_best")


@query(f"""with {V}, o as (select *, ntile(5) over (order by md5('42:' || id), id) as own from v),
    d as (select a.own as fold, a.id, a.label as truth, b.label, b.id as train_id, {DIST[2]} as dist from o a join o b on a.own <> b.own),
    nn as (select *, row_number() over (partition by fold, id order by dist, train_id) as rank from d),
    vt as (select fold, k, id, truth, label, count(*) as n from nn, (select unnest([3, 5, 11]) as k) where rank <= k group by all),
    pr as (select *, row_number() over (partition by fold, k, id order by n desc, label) as o from vt)
    select cast(fold as int) as fold, k, round(avg(case when truth = label then 1.0 else 0.0 end), 6) as accuracy from pr where o = 1 group by fold, k""")
def knn_cross_validation(spark, sf_dir):
    return config_to_k(selection.cross_validate(read_embeddings(spark, sf_dir), knn_family())).select("fold", "k", six("accuracy"))


@query(f"""with {V}, o as (select *, ntile(5) over (order by md5('42:' || id), id) as own from v),
    tr as (select g.fold, o.* from o join (select unnest(range(1, 6)) as fold) g on g.fold <> o.own),
    e as (select fold, label, unnest(f) as x, unnest(range(1, len(f) + 1)) as pos from tr),
    whole as (select fold, 1e-9 * max(s) as eps from (select fold, pos, var_samp(x) as s from e group by fold, pos) group by fold),
    fit as (select e.fold, e.label, pos, avg(x) as m, var_pop(x) + any_value(eps) as s from e join whole on whole.fold = e.fold group by e.fold, e.label, pos),
    prior as (select fold, label, ln(count(*)) as p from tr group by fold, label),
    x as (select own as fold, id, label as truth, unnest(f) as x, unnest(range(1, len(f) + 1)) as pos from o),
    sc as (select x.fold, x.id, x.truth, fit.label, sum(-ln(s) / 2 - (x - m) * (x - m) / (2 * s)) as score from x join fit on fit.fold = x.fold and fit.pos = x.pos group by all),
    pr as (select sc.*, row_number() over (partition by sc.fold, id order by score + p desc, sc.label) as o from sc join prior on prior.fold = sc.fold and prior.label = sc.label)
    select cast(fold as int) as fold, round(avg(case when truth = label then 1.0 else 0.0 end), 6) as accuracy from pr where o = 1 group by fold""")
def estimator_cross_validation(spark, sf_dir):
    """Cross-validation of an estimator of MLlib, normal densities of each feature within each class."""
    family = EstimatorFamily(NaiveBayes(modelType="gaussian"))
    return selection.cross_validate(read_embeddings(spark, sf_dir), family).select("fold", six("accuracy"))


@query()
def model_comparison(spark, sf_dir):
    """Nested cross-validation of all three families with all their settings, and the best of them."""
    families = [
        selection.KNNFamily([{"k": k, "p": 2} for k in (1, 3, 5, 7, 9, 11)]),
        selection.SVMFamily([{"kernel": k, "c": c} for k, cs in (("linear", (0.1, 1.0, 10.0)), ("rbf", (1.0, 5.0, 10.0))) for c in cs]),
        selection.SoftmaxFamily([{"lr": lr, "reg": reg, "epochs": 500, "batch": b} for lr, reg, b in ((0.01, 1e-4, 64), (0.01, 1e-3, 64), (0.001, 1e-4, 64), (0.005, 1e-4, 128))]),
    ]
    return selection.model_table(written(selection.nested_scores(parts(spark, sf_dir)[0], families), "scores"))
