"""Opening files of the shared storage from within tasks."""

from __future__ import annotations


def open_filesystem(uri: str):
    """(file system, path in it) of a local path or a file:, s3a:, hdfs: or gs: URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
