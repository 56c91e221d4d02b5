"""Files that tasks open themselves, in whatever file system a path names."""

from __future__ import annotations

import re
import tempfile

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or a plain path."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def listed(uri: str, ending: str) -> list[str]:
    """``uri`` itself, or the files below it with ``ending``, in order of their names."""
    fs, path = place(uri)
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return [uri]
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted(uri.rstrip("/") + f.path[len(path.rstrip("/")) :] for f in found if f.is_file and f.path.lower().endswith(ending))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; a local session without one gets a folder of its machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loadlark-shared-")
        sc.setCheckpointDir(found)
    return found
