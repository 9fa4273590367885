"""Image files, kernels and the feature job."""

import numpy as np
import pytest

from facetmill.functions.images import clahe, crop_bars, decode_pnm, gray_bars, hog
from facetmill.functions.names import label_of, natural_key, picture_key
from facetmill.jobs.predict import predict_folder
from facetmill.jobs.prepare import apply_pipeline, fit_pipeline
from facetmill.sources.images import first_files, list_images, prediction_line, write_line


def p5(image, top=255):
    kind = ">u2" if top > 255 else "u1"
    return f"P5\n# note\n{image.shape[1]} {image.shape[0]}\n{top}\n".encode() + image.astype(kind).tobytes()


def test_decode():
    image = np.arange(12).reshape(3, 4) * 20
    assert (decode_pnm(p5(image)) == image).all()
    assert (decode_pnm(p5(image * 100, 65535)) == image * 100).all()
    assert (decode_pnm(b"P2 2 2 255\n1 2\n3 # x\n4\n") == [[1, 2], [3, 4]]).all()
    assert (decode_pnm(p5(np.array([[0, 1]]))) == [[0, 255]]).all()
    assert (decode_pnm(b"P6 1 1 255\n" + bytes([10, 20, 60])) == [[30]]).all()
    for bad in (b"", None, b"P5 2 2 255\n\x01", b"P5 0 0 255\n", b"PNG", b"P2 2 2 255\n1 a 2 3"):
        assert decode_pnm(bad) is None


@pytest.mark.parametrize(("left", "right", "want"), [(0, 0, (0, 0)), (2, 1, (2, 1)), (4, 4, (4, 4)), (5, 0, (0, 0)), (0, 6, (0, 0)), (16, 0, (0, 0))])
def test_gray_bars(left, right, want):
    image = np.random.default_rng(0).integers(0, 100, (9, 16)).astype(float)
    image[:, :left] = 127
    image[:, 16 - right :] = 129 if right else image[:, 16 - right :]
    assert gray_bars(image) == want
    assert crop_bars(image)[0].shape == (9, 16 - sum(want))


def test_clahe_properties():
    image = np.random.default_rng(1).integers(50, 90, (21, 30)).astype(float)
    out = clahe(image)
    assert out.shape == image.shape and 0 <= out.min() and out.max() <= 255 and out.std() > image.std()
    assert len(np.unique(clahe(np.full((16, 16), 77.0)))) == 1


def test_hog_properties():
    assert len(hog(np.zeros((40, 33)))) == 4 * 3 * 36
    assert not hog(np.full((16, 16), 9.0)).any()
    edge = np.zeros((16, 16))
    edge[:, 8:] = 255
    found = hog(edge).reshape(-1, 9)
    assert found[:, 0].sum() > 0 and not found[:, 1:].any()
    assert (np.linalg.norm(hog(np.random.default_rng(2).random((32, 32)) * 255).reshape(-1, 36), axis=1) <= 1 + 1e-9).all()


def test_names(spark):
    names = ["p1_i10.pgm", "p1_i2.pgm", "p12_i3.pgm", "x7.pgm", "none", "", "p3i4"]
    data = spark.createDataFrame([(n,) for n in names], "name string")
    from pyspark.sql import functions as F

    got = {r.name: (r.label, r.pic) for r in data.select("name", label_of(F.col("name")).alias("label"), picture_key(F.col("name")).alias("pic")).collect()}
    assert got == {"p1_i10.pgm": (1, 1), "p1_i2.pgm": (1, 1), "p12_i3.pgm": (12, 12), "x7.pgm": (-1, 7), "none": (-1, 0), "": (-1, 0), "p3i4": (-1, 3)}
    ordered = [r.name for r in data.orderBy(natural_key(F.col("name")), "name").collect()]
    assert ordered.index("p1_i2.pgm") < ordered.index("p1_i10.pgm") < ordered.index("p12_i3.pgm")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top, rng = tmp_path_factory.mktemp("images"), np.random.default_rng(3)
    for part in ("known", "new"):
        (top / part).mkdir()
    stripes = np.tile(np.arange(32) // 4 % 2 * 200, (32, 1))
    shapes = [np.kron(np.indices((8, 8)).sum(axis=0) % 2, np.ones((4, 4))) * 200, stripes, stripes.T]
    for i in range(30):
        image = np.clip(shapes[i % 3] + rng.integers(0, 15, (32, 32)), 0, 255)
        (top / "known" / f"p{i % 3}_i{i}.pgm").write_bytes(p5(image))
        if i < 9:
            (top / "new" / f"pic{i}.pgm").write_bytes(p5(np.clip(shapes[i % 3] + rng.integers(0, 15, (32, 32)), 0, 255)))
    (top / "new" / "pic20.pgm").write_bytes(p5(np.zeros((8, 8)) + 50))
    (top / "new" / "pic21.pgm").write_bytes(b"P5 broken")
    return top


def test_feature_job(spark, folder):
    files = list_images(spark, str(folder / "known"))
    pipeline = fit_pipeline(files, fit_limit=20, n_components=5)
    assert (pipeline.h, pipeline.w) == (32, 32) and pipeline.pca.components.shape == (5, 9 * 36)
    features, rejected = apply_pipeline(list_images(spark, str(folder / "new")), pipeline)
    assert {r.name for r in rejected.collect()} == {"pic20.pgm", "pic21.pgm"}
    assert all(len(r.features) == 5 for r in features.collect())
    with pytest.raises(FileNotFoundError):
        list_images(spark, str(folder / "known"), "*.none")


def test_predict_folder(spark, folder, tmp_path):
    for _ in range(2):  # the second time features come from the first
        predictions = predict_folder(spark, str(folder / "known"), str(folder / "new"), f"file://{tmp_path}/work", f"file://{tmp_path}/out")
        got = {r.name: r.prediction for r in predictions.collect()}
        assert got == {f"pic{i}.pgm": i % 3 for i in range(9)}
    assert line_in(tmp_path / "out/line") == "0,1,2,0,1,2,0,1,2," == prediction_line(predictions).first().value
    assert prediction_line(predictions.limit(0)).first().value == ""


def line_in(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_the_line_is_written_in_parts(spark, tmp_path):
    rows = [(f"img{i}.pgm", i * 7 % 11) for i in range(1, 2000)] + [("none.pgm", 3), ("a5.pgm", 4)]
    predictions = spark.createDataFrame(rows, "name string, prediction int").repartition(5)
    key = lambda r: (int("".join(c for c in r[0] if c.isdigit()) or 0), r[0])
    want = "".join(f"{p}," for _, p in sorted(rows, key=key))
    write_line(predictions, f"file://{tmp_path}/line")
    assert line_in(tmp_path / "line") == want == prediction_line(predictions).first().value
    assert len(list((tmp_path / "line").glob("part-*"))) > 1


def test_the_fit_opens_only_its_files(spark, tmp_path):
    for i in (1, 2, 10, 30):
        (tmp_path / f"p1_i{i}.pgm").write_bytes(p5(np.full((16, 16), i)))
    (tmp_path / "p1_i[3]{4}.pgm").write_bytes(p5(np.full((16, 16), 7)))
    files = list_images(spark, str(tmp_path))
    assert {r.name for r in first_files(files, 3).collect()} == {"p1_i1.pgm", "p1_i2.pgm", "p1_i10.pgm"}
    assert first_files(files, 0).count() == 5 and first_files(files, 9).count() == 5


def test_source_reads_what_is_asked_for(spark, folder):
    from facetmill.sources.pnm import read_pnm

    new = str(folder / "new")
    names = read_pnm(spark, new, "path string, name string, label int, length bigint, modified timestamp")
    want = {(r.path, r.length, r.modificationTime) for r in spark.read.format("binaryFile").load(new).select("path", "length", "modificationTime").collect()}
    assert {(r.path, r.length, r.modified.replace(microsecond=r.modified.microsecond // 1000 * 1000)) for r in names.collect()} == want
    assert {r.label for r in names.collect()} == {-1} and names.count() == 11
    images = {r.name: r for r in read_pnm(spark, f"file://{new}").collect()}
    assert images["pic21.pgm"].pix is None and (images["pic20.pgm"].h, images["pic20.pgm"].w) == (8, 8)
    assert images["pic3.pgm"].pix == decode_pnm((folder / "new/pic3.pgm").read_bytes()).ravel().tolist()
    assert {r.label for r in read_pnm(spark, str(folder / "known"), "label int").collect()} == {0, 1, 2}
    with pytest.raises(Exception, match="no \\*.none"):
        read_pnm(spark, new, pattern="*.none").collect()
    with pytest.raises(Exception, match="no such columns"):
        read_pnm(spark, new, "nothing int").collect()


def test_names_are_read_without_opening_files(spark, tmp_path):
    from facetmill.sources.pnm import PnmReader, StructType

    (tmp_path / "p7_i1.pgm").symlink_to(tmp_path / "target")
    (tmp_path / "target").write_bytes(p5(np.zeros((16, 16))))
    for i in range(9):
        (tmp_path / f"p{i}_i2.pgm").write_bytes(b"x" * 1000)
    reader = PnmReader({"path": str(tmp_path), "partitionbytes": "12000"}, StructType.fromDDL("name string, label int"))
    parts = reader.partitions()
    assert [len(p.rows) for p in parts] == [2, 2, 2, 2, 2]
    (tmp_path / "target").unlink()  # whoever opened it would fail
    got = [(n, lab) for p in parts for b in reader.read(p) for n, lab in zip(*[b.column(i).to_pylist() for i in (0, 1)], strict=True)]
    assert sorted(got) == sorted([("p7_i1.pgm", 7), *[(f"p{i}_i2.pgm", i) for i in range(9)]])


def test_written_images_are_read_again(spark, tmp_path):
    from facetmill.sources.pnm import read_pnm, write_pnm

    rng = np.random.default_rng(5)
    rows = [(f"p{i}_i{i}.pgm", 4, 5, [float(v) for v in rng.integers(2, 256, 20)]) for i in range(40)]
    schema = "name string, h int, w int, pix array<float>"
    for _ in range(2):  # again: the same files
        write_pnm(spark.createDataFrame(rows, schema).repartition(3), f"file://{tmp_path}/a b%20c")
    got = read_pnm(spark, f"{tmp_path}/a b%20c").select("name", "h", "w", "pix").collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    assert len(list((tmp_path / "a b%20c").iterdir())) == 40
    for bad in [("../x.pgm", 1, 1, [1.0]), ("x.pgm", 2, 2, [1.0]), (None, 1, 1, [1.0])]:
        with pytest.raises(Exception, match="not a file name|are not"):
            write_pnm(spark.createDataFrame([bad], schema), str(tmp_path / "bad"))


@pytest.fixture
def growing(tmp_path):
    """A folder of 40 images, and a function that adds others."""
    rng, top = np.random.default_rng(11), tmp_path / "grow"
    top.mkdir()

    def add(*numbers):
        for i in numbers:
            (top / f"p{i % 3}_i{i}.pgm").write_bytes(p5(rng.integers(0, 256, (24, 32))))

    add(*range(40))
    return top, add


def stored(snapshot):
    return {r.path.rsplit("/", 1)[-1]: (r.label, np.array(r.features)) for r in snapshot.features.collect()}


def same_rows(a, b):
    return a.keys() == b.keys() and all(a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1], atol=1e-9) for k in a)


def test_store_describes_only_what_is_new(spark, tmp_path, growing):
    from facetmill.jobs.store import refresh

    top, add = growing
    run = lambda store, **kw: refresh(spark, str(top), f"file://{tmp_path}/{store}", 20, 6, **kw)
    first = run("s")
    assert (first.version, first.described, first.kept, first.refitted) == (1, 40, 0, True)
    again = run("s")
    assert (again.version, again.described, again.kept) == (1, 0, 40) and same_rows(stored(first), stored(again))
    add(3000, 3001, 2001)  # labels 0, 1, 0: not among the first 20 in natural order
    (top / "p2_i38.pgm").write_bytes(p5(np.random.default_rng(12).integers(0, 256, (24, 32)).repeat(1, 0))[:-1] + b"\x07")
    (top / "p2_i35.pgm").unlink()
    (top / "p2_i5000.pgm").write_bytes(b"P5 broken")
    grown = run("s", keep_fit=True)
    assert grown.refitted is False and grown.kept == 38 and grown.described == 5
    got = stored(grown)
    assert "p2_i5000.pgm" not in got and "p2_i35.pgm" not in got and len(got) == 42
    before = stored(first)
    assert all((got[k][1] == before[k][1]).all() for k in before if k not in ("p2_i38.pgm", "p2_i35.pgm")) and not np.allclose(got["p2_i38.pgm"][1], before["p2_i38.pgm"][1])
    fresh = run("other")
    assert same_rows(stored(run("s")), stored(fresh))  # without keep_fit it is always what a fresh run gives


def test_store_survives_a_refresh_that_dies(spark, tmp_path, growing, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from facetmill.jobs import store as st

    top, add = growing
    where = f"file://{tmp_path}/s"
    run = lambda: st.refresh(spark, str(top), where, 10, 4, keep_fit=True)
    before = stored(run())
    real = DataFrameWriter.parquet
    for stage in ("/parts/", "/manifests/", "/versions"):
        add(9000 + len(stage))

        def dies(self, path, *a, stage=stage, **kw):
            if where in path and stage in path:
                raise RuntimeError("lost")
            return real(self, path, *a, **kw)

        monkeypatch.setattr(DataFrameWriter, "parquet", dies)
        with pytest.raises(RuntimeError, match="lost"):
            run()
        assert same_rows(before, {r.path.rsplit("/", 1)[-1]: (r.label, np.array(r.features)) for r in st.rows_of(spark, where, st.newest(spark, where)).collect()})
        monkeypatch.setattr(DataFrameWriter, "parquet", real)
    after = run()
    assert after.described == 3 and after.version == 2 and len(stored(after)) == 43


def test_store_joins_its_parts(spark, tmp_path, growing, monkeypatch):
    from facetmill.jobs import store as st

    top, add = growing
    monkeypatch.setattr(st, "MOST_PARTS", 2)
    where = f"file://{tmp_path}/s"
    for step in range(4):
        snapshot = st.refresh(spark, str(top), where, 10, 4, keep_fit=True)
        assert len(stored(snapshot)) == 40 + step and snapshot.described == (1 if step else 40)
        assert len(st.newest(spark, where).parts) == (1, 2, 1, 2)[step]
        add(7000 + step)


def test_equal_names_in_two_folders(spark, tmp_path):
    for i, part in enumerate(("a", "b")):
        (tmp_path / "in" / part).mkdir(parents=True)
        for n in range(6):
            (tmp_path / "in" / part / f"p{n % 2}_i{n}.pgm").write_bytes(p5(np.random.default_rng(i * 10 + n).integers(0, 256, (24, 24))))
    files = list_images(spark, f"{tmp_path}/in/*")
    features, _ = apply_pipeline(files, fit_pipeline(files, fit_limit=9, n_components=3))
    rows = features.collect()
    assert len(rows) == len({r.path for r in rows}) == len({tuple(r.features) for r in rows}) == 12


def test_feature_job_over_a_folder(spark):
    """The query's rows against the same steps in NumPy: scores on the components of the fitted images, up to their signs, have the same inner products."""
    from facetmill.jobs.queries import QUERIES, image_files
    from facetmill.sources.vectors import read_embeddings

    sf = "/root/testdata/sf0.001"
    got = {int(r.name.rsplit("_i", 1)[-1].lstrip("x").removesuffix(".pgm")): r for r in QUERIES["image_feature_job"](spark, sf).collect()}
    images = {int(r.name): crop_bars(decode_pnm(bytes(r.content)))[0] for r in image_files(spark, sf).collect()}
    shapes = [i.shape for i in images.values()]
    most = max(set(shapes), key=shapes.count)
    assert shapes.count(most) == len(got) and len(images) == read_embeddings(spark, sf).count()
    ids = sorted(got)
    x = np.array([hog(clahe(images[i])) for i in ids])
    std = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(std < 1e-6, 1.0, std)
    f = np.array([got[i].features for i in ids])
    n = f.shape[1]
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (u[:, :n] * s[:n]) @ (u[:, :n] * s[:n]).T
    assert n == min(225, *x.shape) and np.allclose(f @ f.T, want, atol=1e-3)


def test_many_small_files_take_few_tasks_to_list_and_several_to_open(spark, tmp_path):
    """A task listed 32 files, and one task opened 64 MB of them however many they were."""
    from facetmill.jobs.prepare import listed
    from facetmill.sources.pnm import opened

    for i in range(600):
        (tmp_path / f"p{i % 3}_i{i}.pgm").write_bytes(p5(np.full((2, 2), i % 256)))
    files = listed(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism and files.count() == 600
    found = opened(files, 1 << 20)
    assert found.rdd.getNumPartitions() >= 8 and found.where("content is not null").select("path").distinct().count() == 600
