"""Makes this package importable for Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


#: Bytes of an Arrow batch for Python workers, in a session that doesn't set its own: Spark's default of 64 MB is held several times over by each task.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package to executors once for each Spark context, and bounds the session's Arrow batches."""
    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH_SETTING) and spark.conf.get(BATCH_SETTING, "67108864b") == "67108864b":
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    if sc in _done:
        return
    top = Path(__file__).resolve().parent
    made = tempfile.mkdtemp(prefix="code-")  # the driver serves it to executors while it lives
    atexit.register(shutil.rmtree, made, True)
    path = Path(made, "quillspark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    _done[sc] = True
