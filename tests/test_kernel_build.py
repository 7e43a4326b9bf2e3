"""The kernel is built from what the running JVM knows, wherever PySpark's own files lie."""


import pyspark
import pytest

from furrow import kernel


@pytest.fixture()
def unbuilt(monkeypatch):
    monkeypatch.setattr(kernel, "_JARS", {})
    monkeypatch.delenv("SPARK_HOME", raising=False)
    monkeypatch.setattr(pyspark, "__file__", "/nowhere/pyspark/__init__.py")
    monkeypatch.setenv("PATH", "/nowhere")


def test_builds_from_the_jvms_class_path(spark, unbuilt):
    built = kernel.jar(spark)
    assert built.exists() and built == kernel.jar(spark)
    assert built.parent.stat().st_mode & 0o077 == 0, "only this user may put a jar there"


def test_says_where_it_searched(spark, unbuilt, monkeypatch):
    monkeypatch.setattr(kernel, "class_path", lambda _: ["/no/such/place.jar"])
    with pytest.raises(kernel.KernelError, match="/no/such/place.jar"):
        kernel.jar(spark)


def test_a_session_of_its_own_gets_the_functions(spark):
    other = spark.newSession()
    kernel.load(other)
    assert other.sql("select furrow_ToWkt(furrow_FromWkt('POINT (1 2)')) as p").first().p == "POINT (1 2)"


def test_class_path_holds_all_that_is_needed(spark):
    path = kernel.class_path(spark)
    assert len(path) == len(set(path)) and any("jts-core" in p or p.endswith("*") for p in path)
