from pyspark.sql import functions as F
from stacksift.sources import images


def test_only_the_first_bytes_are_read(spark, tmp_path):
    whole = b"GIF89a" + (640).to_bytes(2, "little") + (360).to_bytes(2, "little") + b"\0" * 5_000_000
    (tmp_path / "a.gif").write_bytes(whole)
    (tmp_path / "b.png").write_bytes(b"\x89PNG")
    (tmp_path / "c.gif").write_bytes(b"")
    heads = {r["path"].rsplit("/", 1)[1]: r for r in images.file_heads(spark, str(tmp_path)).collect()}
    assert heads["a.gif"]["head"] == whole[:32] and heads["a.gif"]["bytes"] == len(whole)
    got = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in images.read_headers(spark, str(tmp_path)).collect()}
    assert got == {"a.gif": (640, 360, len(whole)), "b.png": (0, 0, 4)}  # Spark leaves out empty files


def test_written_files_come_back(spark, tmp_path):
    rows = spark.range(20).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/"), "id").alias("name"), F.unhex(F.lpad(F.hex("id"), 4, "0")).alias("content"))
    images.write_files(rows, str(tmp_path / "out"))
    found = images.file_heads(spark, f"{tmp_path}/out/*").collect()
    assert sorted(bytes(r["head"]) for r in found) == sorted(i.to_bytes(2, "big") for i in range(20))


def test_tasks_list_the_files_that_spark_finds(spark, tmp_path):
    """The driver holds no file names; hidden, empty and nested files are treated as Spark's reader does."""
    names = ["a/1.gif", "a/2.png", "a/_3.gif", "a/.4.gif", "a/_k=5.gif", "a/empty.gif", "a/deep/6.gif", "b/7.gif", "b/8 9.gif", "c.gif", "_d.gif"]
    for name in names:
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_bytes(b"" if "empty" in name else b"GIF89a" + name.encode())
    for name in ("p/k=1/l=2/1.gif", "p/k=2/l=3/2.gif"):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_bytes(b"GIF87a")
    for path in ("f", "f/*", "f/a", "f/a/", "f/*/*", "f/*/*.gif", "f/{a,b}", "f/{a/1,b/7}.gif", "f/[!a]", "f/?/[0-2]*", "f/c.gif", "p/k=1", "p"):
        path = f"{tmp_path}/{path}"
        want = spark.read.format("binaryFile").load(path).select("path", "length")
        assert sorted(map(tuple, images.listed_files(spark, path).collect())) == sorted(map(tuple, want.collect())), path
    assert not images.file_heads(spark, f"{tmp_path}/f/*").inputFiles()
