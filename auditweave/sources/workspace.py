"""Source files: listing, limits, decoding, language by extension."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave import catalog
from auditweave.functions import columns as C
from auditweave.sources import datasource
from auditweave.storage import stored


def listed(spark: SparkSession, roots: dict[str, str], extensions: dict[str, tuple[str, ...]] = catalog.EXTENSIONS) -> DataFrame:
    """absolute_path and relative_path of all source files, listed by the tasks; several roots prefix their names."""
    datasource.register(spark)
    return spark.read.format("workspace").option("roots", json.dumps(roots)).option("extensions", ",".join(e for exts in extensions.values() for e in exts)).load()


def saves(spark: SparkSession, roots: dict[str, str], *, largest: int = catalog.MAX_FILE_BYTES) -> DataFrame:
    """A stream of files as they are saved, for a live index: at first all, then what is newer; deletions don't show in it."""
    datasource.register(spark)
    stream = spark.readStream.format("workspace-saves").option("roots", json.dumps(roots)).option("largest", largest).load()
    return stream.withColumn("language", C.language_of("relative_path"))


def scan(spark: SparkSession, roots: dict[str, str], *, most: int = catalog.MAX_FILES, largest: int = catalog.MAX_FILE_BYTES, extensions: dict[str, tuple[str, ...]] = catalog.EXTENSIONS) -> tuple[DataFrame, dict]:
    """files (absolute_path, relative_path, language, text, size_bytes, error) and counts: discovered, truncated.

    The first `most` files by path are read. Names are listed, sizes checked and texts read by the tasks. Files that are too
    large or can't be read have an error and no text.
    """
    found = stored(listed(spark, roots, extensions), "workspace-files")
    discovered = found.count()
    paths = found if discovered <= most else found.orderBy("relative_path").limit(most)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], []]
            for path in batch.column(0).to_pylist():
                text = error = size = None
                try:
                    size = os.stat(path).st_size
                    if size > largest:
                        error = "too large"
                    else:
                        with open(path, encoding="utf-8", errors="replace", newline="") as f:
                            text = f.read()
                except OSError as e:
                    error = str(e)
                for c, v in zip(out, (text, size, error)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["absolute_path", "relative_path", "text", "size_bytes", "error"])

    files = paths.mapInArrow(read, "absolute_path string, relative_path string, text string, size_bytes long, error string")
    return files.withColumn("language", C.language_of("relative_path", extensions)), {"discovered": discovered, "truncated": discovered > most}


def one(spark: SparkSession, roots: dict[str, str], absolute_path: str, *, largest: int = catalog.MAX_FILE_BYTES) -> DataFrame:
    """One file from disk as files; no row if it is outside the roots, of no known language, too large or unreadable, so that an index that replaces its rows by these drops it."""
    path = os.path.normpath(absolute_path)
    for name, root in roots.items():
        relative = os.path.relpath(path, root).replace(os.sep, "/")
        if not relative.startswith(".."):
            try:
                if os.stat(path).st_size <= largest:
                    with open(path, encoding="utf-8", errors="replace", newline="") as f:
                        return buffer(spark, path, f"{name}/{relative}" if len(roots) > 1 else relative, f.read(), largest=largest)
            except OSError:
                pass
    return buffer(spark, path, path, "").limit(0)


def sized(files: DataFrame, largest: int = catalog.MAX_FILE_BYTES) -> DataFrame:
    """The files whose text has at most `largest` bytes."""
    return files.where(F.octet_length("text") <= largest)


def limited(files: DataFrame, most: int = catalog.MAX_FILES) -> tuple[DataFrame, bool]:
    """The first `most` files by path, and whether there are more."""
    some = files.orderBy("relative_path").limit(most + 1)
    return some.orderBy("relative_path").limit(most), some.count() > most


def buffer(spark: SparkSession, absolute_path: str, relative_path: str, text: str, *, largest: int = catalog.MAX_FILE_BYTES) -> DataFrame:
    """One text in memory as files; no row if it is too large or of no known language."""
    one = spark.createDataFrame([(absolute_path, relative_path, text)], "absolute_path string, relative_path string, text string")
    return sized(one.withColumn("language", C.language_of("relative_path")).where("language is not null"), largest)


def resolve(roots: dict[str, str], relative_path: str) -> str | None:
    """The absolute place of a workspace path, or None if it leaves its root or names none of several."""
    import posixpath

    path = relative_path.replace("\\", "/")
    if len(roots) > 1:
        name, _, path = path.partition("/")
        if name not in roots:
            return None
        root = roots[name]
    else:
        root = next(iter(roots.values()))
    full = posixpath.normpath(posixpath.join(root, path))
    return full if path and not path.startswith("/") and full.startswith(posixpath.normpath(root) + "/") else None
