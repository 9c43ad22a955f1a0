"""The versioned gallery: refusals, torn writes, changed parts, concurrent writers, compaction."""

import glob
import json
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.sources.versions import Conflict, Gallery, passport

PASS = passport({"encoder": "a", "size": 4}, 3, mask_key="m1")


def batch(spark, ids, label=1, z=(1.0, 0.0, 0.0)):
    return spark.createDataFrame([(i, label, list(z)) for i in ids], "ref_id long, label_id int, z array<float>").withColumn("extra", F.lit("x"))


def rows(g):
    return [(r.ref_id, r.insert_no) for r in g.rows().orderBy("insert_no").collect()]


def test_life(spark, tmp_path):
    path = f"{tmp_path}/g"
    g = Gallery.create(spark, path, PASS)
    assert rows(g) == [] and g.next_no == 0
    g.verify()
    with pytest.raises(Conflict):
        Gallery.create(spark, path, PASS)
    g = g.append(batch(spark, [30, 10, 20])).append(batch(spark, [5, 50]))
    assert rows(g) == [(10, 0), (20, 1), (30, 2), (5, 3), (50, 4)] and g.append(batch(spark, [])) is g
    g.verify()
    g = g.delete(batch(spark, [20, 50]))
    assert rows(g) == [(10, 0), (30, 2), (5, 3)] and g.all_rows().filter("deleted").count() == 2
    g.verify()
    g = g.compact()
    g.verify()
    assert rows(g) == [(10, 0), (30, 2), (5, 3)] and g.all_rows().count() == 3 and g.next_no == 5
    g = g.append(batch(spark, [50]))  # a compacted row's id is free again, its number is not
    assert rows(g)[-1] == (50, 5)
    g.verify()
    g = g.delete(batch(spark, [10])).compact()
    g.verify()
    assert rows(g) == [(30, 2), (5, 3), (50, 5)]
    assert rows(Gallery.open(spark, path, version=2)) == [(10, 0), (20, 1), (30, 2), (5, 3), (50, 4)]
    assert Gallery.versions(spark, path) == list(range(8)) and rows(Gallery.open(spark, path, PASS)) == rows(g)
    assert g.vacuum() > 0 and Gallery.versions(spark, path) == [7] and rows(Gallery.open(spark, path)) == rows(g)
    Gallery.open(spark, path).verify()


def test_refusals(spark, tmp_path):
    path = f"{tmp_path}/g"
    g = Gallery.create(spark, path, PASS).append(batch(spark, [1, 2]))
    for bad in (batch(spark, [None]), batch(spark, [9], None), batch(spark, [9], z=(1.0, 0.0)), batch(spark, [9], z=(float("nan"), 0.0, 1.0)), batch(spark, [9], z=(1.0, 1.0, 0.0)), batch(spark, [9, 9]), batch(spark, [2])):
        with pytest.raises(ValueError):
            g.append(bad)
    with pytest.raises(ValueError, match="not held"):
        g.delete(batch(spark, [7]))
    assert Gallery.versions(spark, path) == [0, 1]
    for other in (passport({"encoder": "b", "size": 4}, 3, mask_key="m1"), passport({"encoder": "a", "size": 4}, 4, mask_key="m1"), PASS | {"mask_key": "m2"}):
        with pytest.raises(ValueError, match="built with other"):
            Gallery.open(spark, path, other)
    with pytest.raises(FileNotFoundError):
        Gallery.open(spark, path, version=9)
    with pytest.raises(FileNotFoundError):
        Gallery.open(spark, f"{tmp_path}/none")


def test_one_of_two_writers_wins(spark, tmp_path):
    path = f"{tmp_path}/g"
    base = Gallery.create(spark, path, PASS).append(batch(spark, [1]))
    first = base.append(batch(spark, [2]))
    with pytest.raises(Conflict):
        base.append(batch(spark, [3]))
    with pytest.raises(Conflict):
        base.delete(batch(spark, [1]))
    now = Gallery.open(spark, path)
    assert rows(now) == rows(first) == [(1, 0), (2, 1)]
    now.verify()  # what the losers wrote is in no version
    assert now.vacuum() >= 2
    Gallery.open(spark, path).append(batch(spark, [3])).verify()


def test_damage_is_found(spark, tmp_path):
    path = f"{tmp_path}/g"
    g = Gallery.create(spark, path, PASS).append(batch(spark, [1, 2])).append(batch(spark, range(3, 9))).delete(batch(spark, [4]))
    copy = lambda name: shutil.copytree(path, f"{tmp_path}/{name}") and f"{tmp_path}/{name}"
    part = g.manifest["parts"][1]["name"]
    torn = copy("torn")
    os.remove(f"{torn}/parts/{part}/_SUCCESS")
    with pytest.raises(ValueError, match="missing or torn"):
        Gallery.open(spark, torn).verify()
    changed = copy("changed")
    shutil.rmtree(f"{changed}/parts/{part}")
    spark.read.parquet(f"{path}/parts/{part}").withColumn("label_id", F.lit(2)).select("ref_id", "label_id", "insert_no", "z").write.parquet(f"{changed}/parts/{part}")
    with pytest.raises(ValueError, match="not what was committed"):
        Gallery.open(spark, changed).verify()
    short = copy("short")
    shutil.rmtree(f"{short}/deletes/{g.manifest['deletes'][0]['name']}")
    with pytest.raises(ValueError, match="deletes/"):
        Gallery.open(spark, short).verify()
    gap = copy("gap")
    last = max(glob.glob(f"{gap}/manifest/*.json"))
    m = json.load(open(last))
    m["parts"] = m["parts"][1:]
    os.remove(f"{gap}/manifest/.{os.path.basename(last)}.crc")
    json.dump(m, open(last, "w"))
    with pytest.raises(ValueError, match="not in sequence"):
        Gallery.open(spark, gap).verify()
    g.verify()


def test_many_rows_are_numbered_in_order(spark, tmp_path):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(500, 3)).astype(np.float32)
    z /= np.linalg.norm(z, axis=1)[:, None]
    ids = rng.permutation(500) * 7
    df = spark.createDataFrame([(int(i), 1, v.tolist()) for i, v in zip(ids, z)], "ref_id long, label_id int, z array<float>").repartition(6)
    g = Gallery.create(spark, f"{tmp_path}/g", PASS).append(df)
    assert rows(g) == [(i * 7, i) for i in range(500)]
    g.verify()


def reference_rows(rng, n, first=0):
    out = []
    for i in range(first, first + n):
        h, w, c = 20 + i % 5, 24, 1 if i % 7 == 0 else 3
        out.append((i * 2 + 1, i % 4, f"image{i // 3}", [2.0, 3.0, 14.0, 15.0 - i % 3], h, w, c, bytearray(rng.integers(0, 255, h * w * c).astype(np.uint8).tobytes())))
    return out


def test_stream_of_references_survives_ends(spark, tmp_path, monkeypatch):
    """Three batches; the application ends before the commit of the second and after that of the third: the gallery is that of one run."""
    from matchloom.operators import seam
    from matchloom.sources import versions
    from matchloom.streaming import references as R

    rng = np.random.default_rng(3)
    for i in range(3):
        spark.createDataFrame(reference_rows(rng, 6, 6 * i), R.ROW).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        os.makedirs(f"{tmp_path}/images", exist_ok=True)
        src = glob.glob(f"{tmp_path}/in{i}/part-*.parquet")[0]
        shutil.copy(src, f"{tmp_path}/images/{i}.parquet")
        os.utime(f"{tmp_path}/images/{i}.parquet", (1000 + i, 1000 + i))
    stub = seam.StubEncoder(8, 4)
    expect = passport({"encoder": "stub"}, 8)
    stream = lambda: spark.readStream.schema(R.ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/images")
    go = lambda name: R.build(stream(), f"{tmp_path}/{name}", expect, stub, "s", f"{tmp_path}/{name}-checkpoint", filler="mean", factor=1.5, size=12, batch=4)
    Gallery.create(spark, f"{tmp_path}/whole", expect)
    whole = go("whole")
    assert whole.rows().count() == 18 and whole.manifest["streams"] == {"s": 2}
    Gallery.create(spark, f"{tmp_path}/broken", expect)
    plain = versions.Gallery._next

    def end(at, after):
        def next_(self, **changes):
            if changes.get("streams", {}).get("s") == at and not after:
                raise RuntimeError("the application ends")
            made = plain(self, **changes)
            if changes.get("streams", {}).get("s") == at:
                raise RuntimeError("the application ends")
            return made

        return next_

    for at, after, rows_then in ((1, False, 6), (2, True, 18)):
        monkeypatch.setattr(versions.Gallery, "_next", end(at, after))
        with pytest.raises(Exception, match="the application ends"):
            go("broken")
        monkeypatch.setattr(versions.Gallery, "_next", plain)
        assert Gallery.open(spark, f"{tmp_path}/broken").rows().count() == rows_then
    again = go("broken")
    key = lambda g: [(r.ref_id, r.label_id, r.insert_no, tuple(r.z)) for r in g.rows().orderBy("insert_no").collect()]
    assert key(again) == key(whole)
    again.verify()
    want = R.encoded(spark.createDataFrame(reference_rows(np.random.default_rng(3), 6), R.ROW), stub, filler="mean", factor=1.5, size=12)
    assert sorted((r.ref_id, tuple(r.z)) for r in want.collect()) == sorted((a, z) for a, _, n, z in key(whole) if n < 6)
    with pytest.raises(Exception, match="without id"):
        R.crops(spark.createDataFrame([(1, None, "x", [0.0, 0.0, 1.0, 1.0], 1, 1, 3, bytearray(3))], R.ROW)).collect()
