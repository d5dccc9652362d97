"""Sinks that commit, sinks in order, folds of long groups, and tables of a step."""

import os
import random
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from pixelmill.operators import lists
from pixelmill.plans import storage
from pixelmill.sources import files


def put(spark, rows, folder, parts=3):
    spark.dataSource.register(files.Files)
    df = spark.createDataFrame(rows, "file_name string, text string").repartition(parts)
    df.select("file_name", F.col("text").cast("binary").alias("content")).write.format("files").mode("append").option("path", f"file://{folder}").save()


def manifest(spark, folder):
    return {(r["name"], r["size"], r["checksum"]) for r in files.read_manifest(spark, f"file://{folder}").collect()}


def on_disk(folder):
    return {(n, len(d), zlib.crc32(d)) for n in os.listdir(folder) if n[0] != "_" for d in [(folder / n).read_bytes()]}


def test_manifest_is_the_folder(spark, tmp_path):
    folder = tmp_path / "out"
    put(spark, [(f"f{i}.txt", "x" * i) for i in range(50)], folder)
    assert manifest(spark, folder) == on_disk(folder) and len(on_disk(folder)) == 50 and not [n for n in os.listdir(folder) if n.startswith("_staging")]
    put(spark, [("f3.txt", "new"), ("g.txt", "")], folder, 1)
    assert manifest(spark, folder) == on_disk(folder) and len(on_disk(folder)) == 51 and (folder / "f3.txt").read_text() == "new"
    put(spark, [], folder)
    assert manifest(spark, folder) == on_disk(folder)


def failing(spark, folder, names):
    bad = F.udf(lambda n: b"y" if n != "f29.txt" else 1 / 0, "binary")
    spark.dataSource.register(files.Files)
    df = spark.createDataFrame([(n,) for n in names], "file_name string").repartition(3)
    with pytest.raises(Exception, match="ZeroDivision"):
        df.select("file_name", bad("file_name").alias("content")).write.format("files").mode("append").option("path", f"file://{folder}").save()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    folder, names = tmp_path / "out", [f"f{i}.txt" for i in range(30)]
    failing(spark, folder, names)
    assert not folder.exists()
    put(spark, [("f1.txt", "old")], folder)
    before = on_disk(folder)
    failing(spark, folder, names)
    assert on_disk(folder) == before == manifest(spark, folder) and sorted(os.listdir(folder)) == ["_manifest", "f1.txt"]


def test_twice_staged_files_of_a_lost_attempt_do_not_count(tmp_path):
    writer = files.FileWriter(f"file://{tmp_path}/out")
    rows = [{"file_name": "a.txt", "content": b"1"}, {"file_name": "b.txt", "content": b"22"}]
    writer.write(iter([{"file_name": "a.txt", "content": b"lost"}, {"file_name": "c.txt", "content": b"lost"}]))
    writer.commit([writer.write(iter(rows)), None])
    assert on_disk(tmp_path / "out") == {("a.txt", 1, zlib.crc32(b"1")), ("b.txt", 2, zlib.crc32(b"22"))} and sorted(os.listdir(tmp_path / "out")) == ["_manifest", "a.txt", "b.txt"]


def test_steps_run_in_order_and_resume(spark, tmp_path):
    did, broken = [], {1}

    def step(i):
        def run():
            did.append(i)
            if i in broken:
                raise RuntimeError("no")

        return run

    steps, folder = [step(i) for i in range(3)], f"file://{tmp_path}"
    with pytest.raises(RuntimeError):
        lists.run_in_order(spark, steps, folder)
    assert did == [0, 1]
    broken.clear()
    assert lists.run_in_order(spark, steps, folder) == [1, 2] and did == [0, 1, 1, 2]
    assert lists.run_in_order(spark, steps, folder) == []
    with pytest.raises(ValueError):
        lists.run_in_order(spark, [], folder)


def test_branches_are_written_in_sequence(spark, tmp_path):
    folder = f"file://{tmp_path}/branches"
    good = spark.range(5).withColumn("v", F.lit("a"))
    bad = spark.range(3).withColumn("v", F.raise_error(F.lit("branch fails")).cast("string"))
    last = spark.range(2).withColumn("v", F.lit("c"))
    with pytest.raises(Exception, match="branch fails"):
        lists.write_in_sequence([good, bad, last], folder)
    first = {f: os.stat(tmp_path / "branches/branch=0" / f).st_mtime_ns for f in os.listdir(tmp_path / "branches/branch=0")}
    assert not (tmp_path / "branches/branch=2").exists()
    out = lists.write_in_sequence([good, spark.range(3).withColumn("v", F.lit("b")), last], folder)
    assert sorted((r["branch"], r["id"], r["v"]) for r in out.collect()) == [(0, i, "a") for i in range(5)] + [(1, i, "b") for i in range(3)] + [(2, i, "c") for i in range(2)]
    assert first == {f: os.stat(tmp_path / "branches/branch=0" / f).st_mtime_ns for f in os.listdir(tmp_path / "branches/branch=0")}


@pytest.mark.parametrize("chunk", [2, 3, 4096])
def test_fold_of_long_groups(spark, chunk):
    rng = random.Random(chunk)
    rows = [(g, i, rng.choice("abc")) for g in range(4) for i in range([1, 2, 40, 333][g])]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1, "z"), (None, 0, None)], "g int, i int, v string").repartition(5)
    out = lists.fold_associative(df, ["g"], ["i"], F.coalesce("v", F.lit("-")), lambda a, b: F.concat(a, b), chunk)
    want = {g: "".join(v for k, _, v in sorted(rows) if k == g) for g in range(4)} | {None: "-z"}
    assert {r["g"]: r["state"] for r in out.collect()} == want
    assert lists.fold_associative(df.where("false"), ["g"], ["i"], F.col("v"), lambda a, b: F.concat(a, b)).count() == 0
    whole = lists.fold_associative(df.where("g is not null"), ["g"], ["i"], F.col("v"), lambda a, b: F.concat(a, b), chunk)
    same = lists.fold(df.where("g is not null"), ["g"], ["i"], "v", F.lit(""), lambda s, v: F.concat(s, v))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, same.collect()))


def test_fold_as_a_stream(spark):
    rng = random.Random(9)
    rows = [(g, h, i, rng.choice([None, 1.5, 2.0])) for g, h, n in ((1, "x", 1), (1, "y", 3), (None, "x", 4), (2, None, 30_000)) for i in range(n)]
    rng.shuffle(rows)
    merge = lambda s, v: round(s / 2 + (v or 9), 6)
    out = lists.fold_streamed(spark.createDataFrame(rows, "g int, h string, i int, v double").repartition(6), ["g", "h"], ["i"], "v", 0.0, merge, "double")
    want = {}
    for g, h, _, v in sorted(rows, key=lambda r: r[2]):
        want[g, h] = merge(want.get((g, h), 0.0), v)
    assert {(r["g"], r["h"]): r["state"] for r in out.collect()} == want and out.columns == ["g", "h", "state"]
    assert lists.fold_streamed(out.where("false"), ["g"], ["h"], "state", 0.0, merge, "double").count() == 0


def test_scratch_leaves_tables_of_other_threads(spark):
    made, go, done = {}, threading.Event(), threading.Event()

    def other():
        with storage.scratch() as keep:
            made["inner"] = storage.materialize(spark.range(3))
            made["kept"] = keep(made["inner"])
            go.set()
            done.wait(60)
            made["sum"] = made["inner"].count()

    thread = threading.Thread(target=other)
    thread.start()
    go.wait(60)
    with storage.scratch() as keep:
        mine = storage.materialize(spark.range(7))
        kept = keep(mine)
        with storage.scratch() as inner:
            again = inner(kept)
    done.set()
    thread.join()
    assert made["sum"] == 3 and made["kept"].count() == 3 and kept.count() == 7
    with pytest.raises(Exception):
        again.count()
    with pytest.raises(Exception):
        mine.count()


def given_in_turn(rows, existing):
    """file names by seq, one file after the other."""
    used, out = set(existing), {}
    for directory, name, seq in sorted(rows, key=lambda r: r[2]):
        dot = name.rfind(".")
        stem, suffix = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        n, new = 1, name
        while (directory, new) in used and n < files.MOST_NAMES:
            n += 1
            new = f"{stem} ({n}){suffix}"
        out[seq] = None if (directory, new) in used else new
        used.add((directory, new))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_free_names(spark, seed, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(files, "MOST_NAMES", 5)
    rng = random.Random(seed)
    stems = ["a", "a (2)", "a (3)", "a (2) (2)", "a (02)", "a (1)", "b", "b (10)", "b (3)", "(2)", "c.d"]
    rows = [(rng.choice(["x", "y"]), rng.choice(stems[: rng.randint(2, 11)]) + rng.choice([".png", ".png", ""]), seq) for seq in rng.sample(range(1000), 150)]
    existing = [("x", "a.png"), ("x", "a (4).png"), ("y", "b (2).png"), ("y", "a (2) (2).png"), ("x", "other.png")] if seed else []
    df = spark.createDataFrame([(seq, d, n, seq) for d, n, seq in rows], "image_id long, directory string, file_name string, seq long")
    kept, failed = files.dedupe_names(df, spark.createDataFrame(existing, "directory string, file_name string") if existing else None, overwrite=False)
    want = given_in_turn(rows, existing)
    assert {r["seq"]: r["file_name"] for r in kept.collect()} == {s: n for s, n in want.items() if n}
    assert {r["image_id"] for r in failed.collect()} == {s for s, n in want.items() if not n}


def test_free_names_of_one_stem(spark):
    df = spark.range(30_000).selectExpr("id AS image_id", "'d' AS directory", "if(id = 25000, 'a (7).png', if(id = 3, 'a (5).png', 'a.png')) AS file_name", "id AS seq")
    kept, failed = files.dedupe_names(df, overwrite=False)
    rows = [("d", r["file_name"], r["seq"]) for r in df.where("seq < 11000 or seq = 25000").collect()]
    want = given_in_turn(rows, [])
    assert {r["seq"]: r["file_name"] for r in kept.collect()} == {s: n for s, n in want.items() if n} and failed.count() == 30_000 - 10_001
