"""File queries and names at sizes where a limit or a field of a header once cut them off."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pixelmill.plans import queries
from pixelmill.plans.ranks import rank_in_groups
from pixelmill.sources import files, headers, listing
from tests.test_sinks import given_in_turn


def same_as_sql(spark, name, folder, *tables):
    """Whether a query gives the rows of its SQL, over tables of a folder."""
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        want = db.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, f"file://{folder}").collect()]
    return len(want) > 0 and sorted(got) == sorted(want)


def test_more_files_of_a_name_than_the_reference_numbers(spark, tmp_path):
    """Names of over 10,000 parts lost the others."""
    assert files.MOST_NAMES < 10_500
    spark.range(11_000).selectExpr("id AS p_partkey", "if(id < 10500, 'red bolt', 'new anvil') AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    assert same_as_sql(spark, "s_dedupe_names", tmp_path, "part")


@pytest.mark.parametrize("seed", range(3))
def test_free_names_without_end(spark, seed, monkeypatch):
    rng = random.Random(seed)
    stems = ["a"] * 6 + ["a (2)", "a (3)", "a (2) (2)", "a (02)", "a (10)", "a (40)", "b", "b (100000)", "(2)"]
    rows = [(rng.choice(["x", "y"]), rng.choice(stems) + rng.choice([".png", ".png", ""]), seq) for seq in rng.sample(range(1000), 200)]
    existing = [("x", "a.png"), ("x", "a (4).png"), ("y", "b (2).png"), ("y", "a (2) (2).png"), ("y", "a (7).png")]
    df = spark.createDataFrame([(seq, d, n, seq) for d, n, seq in rows], "image_id long, directory string, file_name string, seq long")
    monkeypatch.setattr(files, "MOST_NAMES", 5)
    kept, failed = files.dedupe_names(df, spark.createDataFrame(existing, "directory string, file_name string"), overwrite=False, endless=True)
    monkeypatch.setattr(files, "MOST_NAMES", 10**9)
    assert {r["seq"]: r["file_name"] for r in kept.collect()} == given_in_turn(rows, existing) and failed.count() == 0


def test_rank_in_groups(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, null, if(id % 5 = 0, 'b', 'a')) AS g", "id * 7919 % 5003 AS v", "id % 2 AS h")
    out = rank_in_groups(df, ["g", "h"], [F.col("v")], "k").collect()
    by = {}
    for r in sorted(out, key=lambda r: r["v"]):
        by.setdefault((r["g"], r["h"]), []).append(r["k"])
    assert len(out) == 5000 and len(by) == 6 and all(ks == list(range(1, len(ks) + 1)) for ks in by.values())


def test_widths_beyond_16_bits(spark, tmp_path):
    """GIF and TGA headers hold 65,535 at most: wider pages came back as less, or as no image."""
    ids = "id < 9 or id between 65530 and 65550 or id between 131060 and 131080"
    spark.range(140_000).where(ids).coalesce(2).selectExpr("id AS page_id", "'<p>' || repeat('x', cast(id % 50 as int)) AS html").write.parquet(f"{tmp_path}/pages.parquet")
    assert same_as_sql(spark, "s_headers", tmp_path, "pages")


def test_scans_keep_no_paths_on_the_driver(spark):
    """Each listing of s_scan held every path there."""
    out = __spark_entry__.queries()["s_scan"](spark, "/root/testdata/sf0.001")
    assert out.inputFiles() and all(f.endswith(".parquet") for f in out.inputFiles())


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_scan_of_a_folder_however_it_is_written(spark, tmp_path, form, monkeypatch):
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(queries, "new_folder", lambda *_: form.format(f"{tmp_path}/out"))
    assert same_as_sql(spark, "s_scan", tmp_path, "embeddings")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    top = tmp_path_factory.mktemp("odd names")
    for name in ("a b (2).png", "c%20d.png", "e#f.txt", "g+h?.txt", "_hidden.txt", ".dot.png", "_metadata.txt", "_k=1.txt", "x.png._COPYING_", "zip.gz", "\u00fc.md", "in/sub.txt", "in/_no/deep.txt", ".git/x.txt"):
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_bytes(name.encode() * 9)
    (top / "empty.txt").touch()
    return top


@pytest.mark.parametrize("recursive", [False, True])
def test_listings_by_tasks_are_as_by_spark(spark, odd, recursive, monkeypatch):
    def every(path):
        rows = [sorted(map(tuple, files._listing(spark, path, recursive, read=read).select("path", "length", read).collect())) for read in ("content", "checksum")]
        return rows, sorted(map(tuple, files._listing(spark, path, recursive).select("path", "length").collect()))

    for path in (f"file://{odd}", f"{odd}/", f"file:{odd}/c%20d.png", [f"{odd}/in", f"{odd}/zip.gz"]):
        with monkeypatch.context() as m:
            ours = every(path)
            m.setattr(files, "by_tasks", lambda *_: None)
            assert ours == every(path) and ours[1]


def test_paths_that_tasks_do_not_list(spark, odd):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.odd.link./in", odd.as_uri())
    assert listing.by_tasks(spark, f"{odd}/*.txt") is None and listing.by_tasks(spark, "viewfs://odd/in") is None
    assert [r["byte_len"] for r in files.scan_images(spark, "viewfs://odd/in")[0].orderBy("seq").collect()] == [99, 81]
    assert {r["text"][:3] for r in files.read_text(spark, f"{odd}/*.txt")[0].collect()} >= {"e#f", "g+h"}
    for path in (f"{odd}/none", [str(odd), f"file://{odd}/none"]):
        with pytest.raises(FileNotFoundError):
            files.scan_images(spark, path)


def test_large_files_fill_batches_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "MOST_HELD", 1000)
    want = {}
    for i in range(40):
        want[f"f{i}.md"] = os.urandom(i * 60 + 1)
        (tmp_path / f"f{i}.md").write_bytes(want[f"f{i}.md"])
    got = files._listing(spark, str(tmp_path), False, read="content").collect()
    assert {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in got} == want


def test_headers_of_odd_names(spark, tmp_path):
    (tmp_path / "a b%20 (2).png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR\0\0\0\x09\0\0\0\x04\x08\x06")
    for path in (str(tmp_path), f"file://{tmp_path}/"):
        r = headers.image_headers(spark, path)[0].first()
        assert (r["name_stem"], r["width"], r["height"]) == ("a b%20 (2)", 9, 4)
