"""Memory that the driver has freed goes back to the system between steps."""

from claimloom.llm import common


def test_freed_memory_goes_back(spark, monkeypatch):
    assert common.trimmed(spark)  # the JVM knows the command and takes it
    asked = []
    monkeypatch.setattr(common, "trimmed", asked.append)
    common.release(spark)
    assert asked == [spark]
