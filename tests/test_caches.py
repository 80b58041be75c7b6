"""Caches know the files they were built from, and publish whole results."""

import pytest

from tidemark.sources import tables as st


def test_changed_input_is_computed_anew(spark, tmp_path):
    source, folder, built = str(tmp_path / "in"), str(tmp_path / "cache"), []

    def get():
        def build():
            built.append(1)
            return spark.read.parquet(source).groupBy().count()
        return st.cached(spark, folder, "rows", {"a": 1}, build, [source]).first()[0]
    spark.range(5).write.parquet(source)
    assert [get(), get(), len(built)] == [5, 5, 1]
    spark.range(3).write.mode("append").parquet(source)
    assert [get(), get(), len(built)] == [8, 8, 2]
    before = st.fingerprint(spark, source)
    spark.range(8).write.mode("overwrite").parquet(source)
    assert st.fingerprint(spark, source) != before


def test_two_builders_never_mix(spark, tmp_path):
    """A builder that is overtaken takes the other one's result and leaves nothing behind."""
    folder = str(tmp_path / "cache")

    def slow():
        st.cached(spark, folder, "x", {"p": 1}, lambda: spark.range(4))
        return spark.range(9)
    got = st.cached(spark, folder, "x", {"p": 1}, slow)
    assert got.count() == 4 and len([p for p in (tmp_path / "cache").iterdir() if not p.name.startswith(".")]) == 1


def test_a_lost_build_is_replaced(spark, tmp_path):
    folder = str(tmp_path / "cache")
    path = st.cache_path(spark, folder, "x", {"p": 1})
    spark.range(2).write.parquet(path)
    (tmp_path / "cache" / path.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    assert st.cached(spark, folder, "x", {"p": 1}, lambda: spark.range(6)).count() == 6

    def fails():
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        st.cached(spark, folder, "y", {"p": 1}, fails)
    assert st.cached(spark, folder, "y", {"p": 1}, lambda: spark.range(7)).count() == 7
