"""Makes this package importable on executors."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import zipfile
from pathlib import Path

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark) -> None:
    """Send the package to the executors of this application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = Path(tempfile.mkdtemp(prefix="matrelate-zip-")).resolve()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = folder / "matrelate.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"matrelate/{p.relative_to(PACKAGE)}")
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shipped(query):
    """``query`` with the package shipped before it runs."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
