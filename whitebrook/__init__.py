"""Corpus, embedding and whitening operators on Spark DataFrames."""

from __future__ import annotations


def ship(spark) -> None:
    """Send this package to the executors of a session whose workers cannot import it themselves."""
    import shutil
    import tempfile
    from pathlib import Path

    here = Path(__file__).resolve().parent
    # a copy that the driver serves to the executors, not data of a query
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/whitebrook", "zip", here.parent, here.name))
