"""What a session needs before the engine's Python functions can run on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from pagequery.errors import ConfigError

_shipped: set[str] = set()
#: Folders of sessions on one machine that name none, by application.
_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pagequery-")) / "pagequery.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a folder of this machine if the session has no other, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ConfigError("a folder that the cluster shares is needed", key="spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = "file://" + tempfile.mkdtemp(prefix="pagequery-shared-")
    return _folders[app]
