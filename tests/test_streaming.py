import pytest
from pyspark.sql import functions as F

from claimloom.operators import backup, folds, journal
from claimloom.operators.journal import Refused
from claimloom.plans.catalog import steps
from claimloom.streaming import journal as stream


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.lit("w").alias("workspace_id"), F.lit(1).alias("kind"), F.concat(F.lit("e"), F.col("id") % 3).alias("entity"), F.col("id").cast("string").alias("idempotency_key"), F.lit("{}").alias("payload"), F.col("id").alias("o"))


def test_tail_and_follow(spark, tmp_path):
    source, replica, ledger = (str(tmp_path / x) for x in ("source", "replica", "ledger"))
    journal.append(spark, source, rows(spark, 10), ["o"])
    stream.follow(spark, source, replica, ledger, str(tmp_path / "cp")).awaitTermination()
    journal.append(spark, source, rows(spark, 12, 5), ["o"])  # five of them again
    stream.follow(spark, source, replica, ledger, str(tmp_path / "cp")).awaitTermination()
    stream.follow(spark, source, replica, ledger, str(tmp_path / "cp2")).awaitTermination()  # all over again: nothing new
    a, b = spark.read.schema(journal.SCHEMA).parquet(source), spark.read.schema(journal.SCHEMA).parquet(replica)
    assert a.count() == b.count() == 17 and stream.same(a, b)
    assert sorted(r.seq for r in a.select("seq").collect()) == list(range(1, 18))
    with pytest.raises(Refused):
        stream.follow(spark, source, replica, ledger, str(tmp_path / "cp3"), anchor=(1, "not-there"))
    q = stream.tail(spark, source, cursor=15).writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.seq for r in spark.sql("select seq from tailed order by seq").collect()] == [16, 17]
    stream.fork(spark, source, str(tmp_path / "fork"), 9)
    assert spark.read.schema(journal.SCHEMA).parquet(str(tmp_path / "fork")).count() == 9
    with pytest.raises(Refused):
        stream.fork(spark, source, str(tmp_path / "fork"), 9)


def test_stateful_fold_equals_batch(spark, sf_dir, tmp_path):
    events = steps(spark, sf_dir).select(F.col("entity").cast("string").alias("entity"), "seq", "kind", F.col("seq").cast("string").alias("value"))
    folder = str(tmp_path / "in")
    top = events.agg(F.max("seq")).first()[0]
    for k in range(3):
        events.where((F.col("seq") > k * top // 3 - (k == 0)) & (F.col("seq") <= (k + 1) * top // 3)).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    cards: dict = {}

    def keep(batch, _):
        cards.update({r.entity: r for r in batch.collect()})

    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream.fold_stream(live).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    base = events.withColumns({"workspace_id": F.lit("w"), "event_id": F.lit("x")})
    want = folds.claim_cards(base.where("kind = 2").selectExpr("workspace_id", "entity", "seq", "event_id", "entity AS claim_id", "value AS text"), base.where("kind = 3").selectExpr("workspace_id", "entity", "seq", "entity AS old_claim_id", "value AS new_claim_id", "'r' AS reason", "'d' AS decided_by")).collect()
    odd = {r.entity: r.n for r in folds.claim_anomalies(events.select("entity", "seq", "kind")).groupBy("entity").agg(F.count("*").alias("n")).collect()}
    assert {r.claim_id: (r.phase, r.text, r.superseded_by, odd.get(r.claim_id, 0)) for r in want} == {k: (r.phase, r.text, r.superseded_by, r.anomalies) for k, r in cards.items()}


def test_backup_findings(spark, tmp_path):
    folder = tmp_path / "store"
    folder.mkdir()
    for name, body in (("a", "1"), ("b", "22"), ("c", "333")):
        (folder / name).write_text(body)
    expected = backup.manifest(spark, str(folder)).collect()
    expected = spark.createDataFrame(expected, "name string, bytes long, hash_hex string")
    assert not backup.findings(expected, backup.manifest(spark, str(folder))).count()
    (folder / "a").write_text("2")
    (folder / "b").unlink()
    (folder / "c").write_text("4444")
    (folder / "d").write_text("x")
    got = {(r.kind, r.name) for r in backup.findings(expected, backup.manifest(spark, str(folder))).collect()}
    assert got == {("hash_mismatch", "a"), ("missing_file", "b"), ("length_mismatch", "c"), ("unexpected_file", "d")}
