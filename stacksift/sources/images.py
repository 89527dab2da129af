"""Image headers: signature and dimensions out of the first bytes of binary files."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
SIGNATURES = ["474946383761", "474946383961"]  # GIF87a, GIF89a
HEAD = 32
# -----------------------------------------------------------------------------

GLOB = re.compile(r"[{}\[\]*?\\]")
#: Files that a task lists before it hands them on.
LIST_ROWS = 4096


def _little_endian(content: Column, start: int) -> Column:
    low, high = (F.hex(F.substring(content, start + i, 1)) for i in (0, 1))
    return F.conv(F.concat(high, low), 16, 10).cast("int")


def header(content: Column) -> Column:
    """``struct<width, height>``; zero when the header is not that of an animation."""
    known = F.hex(F.substring(content, 1, 6)).isin(SIGNATURES) & (F.octet_length(content) >= 10)
    width, height = _little_endian(content, 7), _little_endian(content, 9)
    usable = known & (width > 0) & (height > 0)
    return F.struct(
        F.when(usable, width).otherwise(0).alias("width"), F.when(usable, height).otherwise(0).alias("height")
    )


def file_system(uri: str):
    """The file system of a path as Spark writes it, and the path inside of it."""
    from pyarrow import fs

    if uri.startswith("file:"):  # names as they are, not as an URI encodes them
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def _entries(system, folder: str):
    """``path, is a folder, bytes`` of all that a folder holds; of a local one while it is read."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                try:
                    yield x.path, x.is_dir(), x.stat().st_size
                except FileNotFoundError:  # gone meanwhile
                    pass
    else:
        for x in system.get_file_info(fs.FileSelector(folder)):
            yield x.path, x.type == fs.FileType.Directory, x.size


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    out = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return out and not name.startswith(("_metadata", "_common_metadata"))


LISTED = "path string, folder boolean, bytes long"


def _children(rows: DataFrame, pattern: str | None) -> DataFrame:
    """``LISTED`` for what the folders of ``rows`` hold: names that fit ``pattern``, or files, with those in folders named ``key=value``.

    Without a pattern, files of ``rows`` stay.
    """

    def run(batches):
        for batch in batches:
            for root, folder, size in zip(*(c.to_pylist() for c in batch.columns)):
                system, inside = file_system(root)
                lead, held = root[: len(root) - len(inside)], []
                open_ = [inside] if folder else []
                if not folder and pattern is None and not _hidden(root.rsplit("/", 1)[1]):
                    held.append((root, False, size))
                while open_:
                    for path, is_folder, size in _entries(system, open_.pop()):
                        name = path.rsplit("/", 1)[1]
                        if pattern is not None:
                            if not re.fullmatch(pattern, name):
                                continue
                        elif is_folder:
                            if "=" in name and not _hidden(name):
                                open_.append(path)
                            continue
                        elif _hidden(name):
                            continue
                        held.append((lead + path, is_folder, size))
                        if len(held) == LIST_ROWS:
                            yield out(held)
                            held = []
                if held:
                    yield out(held)

    def out(held: list[tuple]):
        import pyarrow as pa

        kinds = [pa.string(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=["path", "folder", "bytes"])

    return rows.mapInArrow(run, LISTED)


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes`` of the files that Spark's readers find below ``path``, which may be a pattern.

    Tasks list the folders, one folder each; the driver sees none of the names. A pattern that
    nothing fits gives no rows.
    """
    jvm, hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    tasks = 2 * spark.sparkContext.defaultParallelism
    found = None
    for one in dict.fromkeys(jvm.GlobExpander.expand(path) if GLOB.search(path) else [path]):
        parts = one.split("/")
        fixed = next((i for i, x in enumerate(parts) if GLOB.search(x)), len(parts))
        top = jvm.Path("/".join(parts[:fixed]) or ("/" if one.startswith("/") else "."))
        system = top.getFileSystem(hadoop)
        status = system.getFileStatus(system.makeQualified(top))
        rows = spark.createDataFrame([(status.getPath().toString(), status.isDirectory(), status.getLen())], LISTED)
        for part in filter(None, parts[fixed:]):
            pattern = jvm.GlobPattern(part).compiled().pattern() if GLOB.search(part) else re.escape(part)
            rows = _children(rows, pattern).repartition(tasks, "path")
        files = _children(rows, None)
        found = files if found is None else found.unionByName(files)
    # Spark leaves out empty files.
    return found.filter("bytes > 0").select("path", "bytes").repartition("path")


def file_heads(spark: SparkSession, path: str, size: int = HEAD) -> DataFrame:
    """``path, bytes, head``: the first ``size`` bytes of files, by one ranged read each.

    Tasks list the files and their lengths and open them; nothing reads more of their content.
    A file that goes meanwhile, or can't be opened, has a null head; empty files are left out.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            heads = []
            for name in batch.column(0).to_pylist():
                try:
                    system, inside = file_system(name)
                    with system.open_input_file(inside) as file:
                        heads.append(file.read(size))
                except OSError:
                    heads.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=["path", "bytes", "head"])

    return listed_files(spark, path).mapInArrow(run, "path string, bytes long, head binary")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Dimensions and size of image files: ``path, width, height, bytes``."""
    heads = file_heads(spark, path)
    found = header(F.coalesce("head", F.lit(b"")))
    return heads.select("path", found.alias("h"), "bytes").select("path", "h.width", "h.height", "bytes")


def write_files(rows: DataFrame, path: str) -> None:
    """Binary files out of ``name, content``, below ``path``."""

    def run(batches):
        system, inside = file_system(path if "://" in path or path.startswith("file:") else f"file://{path}")
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                above = f"{inside}/{name}".rsplit("/", 1)[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(f"{inside}/{name}") as file:
                    file.write(content)
            yield batch

    rows.select("name", "content").mapInArrow(run, "name string, content binary").write.format("noop").mode("overwrite").save()
