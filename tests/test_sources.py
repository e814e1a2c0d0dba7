import json
import os
import tempfile

import numpy as np
import pytest

from pointloom.operators import learn as L
from pointloom.sources import clouds, stores, tables


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def sample(spark):
    return spark.range(300).selectExpr(
        "id % 3 AS scene_id", "id div 3 AS point_id", "CAST(id AS DOUBLE) / 8 AS x", "0.5D AS y", "-1.25D AS z", "CAST(id % 4 AS INT) AS label")


def test_ply_round_trip(spark, folder):
    clouds.write_points(sample(spark), folder, format="ply")
    assert sorted(os.listdir(folder)) == ["00000.ply", "00001.ply", "00002.ply"]
    back = clouds.read_points(spark, folder, "labelled").select("scene_id", "point_id", "x", "y", "z", "label")
    assert back.exceptAll(sample(spark)).count() == 0 and back.count() == 300


def test_ranges_of_records_and_the_path_through_spark_agree(spark, folder, monkeypatch):
    from pointloom.sources import ply

    clouds.write_points(sample(spark), folder, format="ply")
    monkeypatch.setattr(ply, "RANGE", 7 * 16)  # seven records a partition
    reader = ply.PlyReader({"path": folder, "layout": "header"})
    parts = reader.partitions()
    assert len(parts) == 45 and sum(p.count for p in parts) == 300
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["scene_id"], r["point_id"], r["x"], r["label"]) for r in rows) == sorted(map(tuple, sample(spark).select("scene_id", "point_id", "x", "label").collect()))
    own = clouds.read_points(spark, folder, "header").drop("path")
    whole = clouds._read_through_spark(spark, folder, "header").select(*own.columns)
    assert own.exceptAll(whole).count() == 0 and whole.count() == 300


def test_failed_and_repeated_tasks_leave_no_file(spark, folder):
    from pointloom.sources import ply

    batch = [b for b in sample(spark).where("scene_id = 1").selectExpr("*", "0 AS red", "0 AS green", "0 AS blue", "100L AS n").toArrow().to_batches()]
    writer = ply.PlyWriter({"path": f"{folder}/out"}, True)
    writer.write(iter(batch))  # an attempt whose message is lost
    writer.commit([writer.write(iter(batch)), None])
    assert os.listdir(f"{folder}/out") == ["00001.ply"]
    other = ply.PlyWriter({"path": f"{folder}/none"}, True)
    other.write(iter(batch))
    other.abort([])
    assert os.listdir(f"{folder}/none") == []


def test_no_files_give_no_rows(spark, folder):
    assert clouds.read_points(spark, folder).count() == 0


def test_truncated_and_ascii_files(spark, folder):
    rec = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")])
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 5\n" + "".join(f"property float {a}\n" for a in "xyz")
    head += "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header\n"
    with open(f"{folder}/a.ply", "wb") as f:
        f.write(head.encode() + np.ones(5, rec).tobytes()[: 15 * 3 + 7])
    got = clouds.read_points(spark, folder, "xyzrgb").collect()
    assert len(got) == 3 and got[0]["n_header"] - got[0]["n_readable"] == 2
    other = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    text = "ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\nbad\n7 8 9\n"
    with open(f"{other}/b.ply", "w") as f:
        f.write(text)
    assert [r["x"] for r in clouds.read_points(spark, other, "ascii").orderBy("point_id").collect()] == [1.0, 4.0]


def test_metadata_file_with_mixed_objects(spark, folder):
    doc = [{"id": 4, "objects": ["floor", {"cargo1": {"type": "box", "w": 1.0, "h": 2.0, "d": 0.5}}], "n_points": 9, "label_counts": {"0": 9}}]
    with open(f"{folder}/metadata.json", "w") as f:
        json.dump(doc, f)
    from pointloom.operators.volumes import gt_cargo_volume

    meta = tables.read_metadata(spark, f"{folder}/metadata.json")
    assert gt_cargo_volume(meta).first()["gt_cargo_m3"] == 1.0


def test_reference_volumes_from_files(spark, folder):
    os.makedirs(f"{folder}/Escenario_03")
    for i, v in ((1, "1.50"), (2, "0.25")):
        with open(f"{folder}/Escenario_03/Captura_01_C{i}_get_bounding_box.txt", "w") as f:
            f.write(f"x\n[GetVolume] Best estimation with ConvexHull: {v} m3\n")
    row = tables.read_reference_volumes(spark, folder).first()
    assert (row["scenario"], row["capture"], row["vol_ref"], row["n_files"]) == ("Escenario_03", "Captura_01", 1.75, 2)


def test_csv_sink_and_coercion(spark, folder):
    df = spark.createDataFrame([("1", "2.5", "3.0"), ("2", "", "1.0"), ("3", "1.0", "crash")], "run string, vol_ref string, vol_hf string")
    tables.write_table(df, f"{folder}/cmp", "csv")
    assert [r["run"] for r in tables.read_comparison(spark, f"{folder}/cmp").collect()] == ["1"]
    with pytest.raises(ValueError):
        tables.write_table(df.selectExpr("array(run) AS a"), f"{folder}/bad", "csv")


def test_feature_store_recomputes_on_other_columns(spark, folder):
    calls = []

    def compute():
        calls.append(1)
        return sample(spark).selectExpr("*", "x * 2 AS f")

    for names in (["x", "y"], ["x", "y"], ["x", "f"]):
        out = stores.cached_features(spark, f"{folder}/store", names, compute)
        assert out.columns[-2:] == names
    assert len(calls) == 2


def test_model_store_checks(spark, folder):
    df = sample(spark)
    model = L.fit(df, L.random_forest(["x", "y"], trees=2, depth=2))
    stores.save_model(model, f"{folder}/m", ["x", "y"], {"cargo": 1}, spark)
    loaded, card = stores.load_model(f"{folder}/m", spark, ["x", "y"])
    assert card["label_map"] == {"cargo": 1} and L.predict_rows(df, loaded).count() == 300
    with pytest.raises(ValueError):
        stores.load_model(f"{folder}/m", spark, ["x"])
    with pytest.raises(FileNotFoundError):
        stores.load_model(f"{folder}/none", spark)
