"""Every archive of a wide folder is told: the query has no bound on a folder's entries, as its SQL has none."""

from curalis import registry
from curalis.sources import trees

SF = "/root/testdata/sf0.001"


def test_archives_of_folders_over_the_sources_bound(spark, monkeypatch):
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    monkeypatch.setattr(trees, "MAX_ENTRIES", 3)
    assert parts // 16 > 3
    assert registry.queries()["s013_archive_directories"](spark, SF).select("archive").distinct().count() == parts
