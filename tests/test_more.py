"""Configuration, backups, proposals, judging and drift."""

import pytest
from pyspark.sql import functions as F

from claimloom.operators import backup, config, drift, proposals, vectors
from claimloom.operators.journal import Refused
from claimloom.plans.engine import Engine


def test_config(tmp_path, monkeypatch):
    path = str(tmp_path / "store.toml")
    config.save(path, {"prefilter": 0.5, "name": 'a "b"', "on": True, "model": {"url": "x"}})
    got = config.load(path)
    assert got == {"prefilter": 0.5, "name": 'a "b"', "on": True, "model": {"url": "x"}}
    assert config.resolve("prefilter", configured=got) == 0.5 and config.resolve("cluster", configured=got) == 0.65
    monkeypatch.setenv("CLAIMLOOM_PREFILTER", "0.4")
    assert config.resolve("prefilter", configured=got) == 0.4 and config.resolve("prefilter", {"prefilter": 0.3}, got) == 0.3
    assert config.load(str(tmp_path / "none.toml")) == {}
    with pytest.raises(Refused):
        config.store_paths("/r", ["../x"])


def test_topology():
    good = [{"name": "a", "role": "primary", "path": "1"}, {"name": "b", "role": "replica", "path": "2", "mode": "follow", "source": "a"}]
    config.check_topology(good)
    loop = [good[0], {**good[1], "source": "c"}, {"name": "c", "role": "replica", "path": "3", "mode": "fork", "source": "b"}]
    for bad in (good[1:], [good[0], {**good[1], "path": "1"}], [good[0], {**good[1], "source": "x"}], loop, [good[0], {**good[1], "mode": "odd"}]):
        with pytest.raises(Refused):
            config.check_topology(bad)


def test_backup_round_trip(spark, tmp_path):
    store, target, root = (str(tmp_path / x) for x in ("store", "backup", "restored"))
    spark.range(50).write.parquet(f"{store}/journal")
    assert backup.create(spark, store, target).count() >= 2
    assert not backup.verify(spark, target).count()
    backup.restore(spark, target, root)
    assert spark.read.parquet(f"{root}/journal").count() == 50
    with pytest.raises(Refused):
        backup.restore(spark, target, root)
    victim = next((tmp_path / "backup" / "data" / "journal").glob("*.parquet"))
    (victim.parent / f".{victim.name}.crc").unlink()  # the file system's own check would notice first
    victim.write_bytes(b"other")
    assert {r.kind for r in backup.verify(spark, target).collect()} == {"length_mismatch"}
    with pytest.raises(Refused):
        backup.restore(spark, target, str(tmp_path / "again"))


def test_drift_through_the_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path), clock=lambda: 1)
    rows = drift.items(spark, 10)
    e.invoke("ingest.run", sources=drift.sources(rows))
    view = e.invoke("claims.list").select(F.col("source.path").alias("path"), "status")
    got = {r.kind: r for r in drift.score(rows, view).collect()}
    # one workspace: the slug of the first six words keeps services apart
    assert got["explicit_supersede"].passed == got["explicit_supersede"].total == 2
    assert sum(r.phantom + r.leaked for r in got.values()) == 0 and got["unrelated"].passed == 3


ASKED: list = []


def proposer(text, path):
    return [{"text": text.split(".")[0], "subject_hint": "/".join(path)}, {"text": "something invented entirely"}]


def test_proposals(spark):
    spans = spark.createDataFrame([("Deploys run on Friday. Yes.", ["Top", "Sub"], 1), ("Deploys run on Friday. Yes.", ["Top", "Sub"], 2), ("Other words here.", [], 3)], "text string, heading_path array<string>, n int")
    rows = proposals.propose(spans, proposer).collect()
    assert sum(r.faithful for r in rows) == 3 and sum(not r.faithful for r in rows) == 3
    assert {r.subject_hint for r in rows if r.n == 2 and r.faithful} == {"Top/Sub"}
    first = proposals.propose(spans, proposer)
    cached = proposals.propose(spans, refuse, cache=first.select("cache_key", "text", "subject_hint", "predicate_hint", "object_hint", "confidence_ppm").distinct())
    assert cached.count() == len(rows)


def refuse(*_):
    raise AssertionError("a cached answer was asked for again")


def judge(a, b):
    return ("conflict", 1)


def test_judging_uses_the_cache(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("c", "d", 3)], "older_text string, newer_text string, n int")
    first = vectors.judge(pairs, judge)
    first.write.parquet(str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache")).dropDuplicates(["cache_key"])
    assert cache.count() == 2
    again = vectors.judge(pairs, refuse, cache=cache)
    assert again.count() == 3 and {r.relation for r in again.collect()} == {"conflict"}


def test_ndjson(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, 1, "t", "s", "is", "o", 5)], "source_path string, line_start int, line_end int, text string, subject_hint string, predicate_hint string, object_hint string, confidence_ppm int")
    proposals.write_ndjson(rows, str(tmp_path / "n"))
    (tmp_path / "n" / "bad.json").write_text("{not json\n")
    got = proposals.read_ndjson(spark, str(tmp_path / "n")).collect()
    assert sum(r._corrupt is None for r in got) == 1 and len(got) == 2


def test_lexical_index_of_repeated_paths(spark, tmp_path):
    """Rows of one path are one file, as in the SQL, null paths too; positions count repeats."""
    import duckdb

    from claimloom.plans import catalog

    rows = [("u", "alpha alpha beta"), ("u", "other BETA gamma"), ("u", None), ("v", "one two One"), (None, "first second"), (None, "other third"), ("w", " ".join(f"n{i}x" for i in range(300))), ("w", " ".join(f"x{i}n" for i in range(300)))]
    spark.createDataFrame(rows, "url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["lexical_index"](spark, str(tmp_path))
    want = duckdb.sql(catalog.ORACLE_SQL["lexical_index"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    found = [tuple(r) for r in got.collect()]
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "int", "boolean"]
    assert len(found) == len(want) == len({r[:2] for r in found}) and {(r[0], r[2], r[3]) for r in found} == {(r[0], r[2], r[3]) for r in want}
    assert {r[:3] for r in found if r[0] == "u"} == {("u", "alpha", 1), ("u", "other", 2), ("u", "beta", 3), ("u", "gamma", 4)}
    assert {r[1] for r in found if r[0] is None} == {r[1] for r in want if r[0] is None}


def test_lexical_index_keeps_every_name(spark, tmp_path):
    """Files of over 512 names, of one row and of several, are indexed whole; the operator's bound is asked for."""
    import duckdb

    from claimloom.operators import code
    from claimloom.plans import catalog

    rows = [("one", " ".join(f"n{i}x" for i in range(700))), *[("two", " ".join(f"{a}{i}z" for i in range(400))) for a in ("p", "q")]]
    spark.createDataFrame(rows, "url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["lexical_index"](spark, str(tmp_path)).collect()
    want = duckdb.sql(catalog.ORACLE_SQL["lexical_index"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert {(r[0], r[1]) for r in got} == {(r[0], r[1]) for r in want}
    assert {(r[0], r[2], r[3]) for r in got} == {(r[0], r[2], r[3]) for r in want} and len(got) == len(want) == 1500
    some = code.lexical_index(spark.createDataFrame(rows, "path string, text string"), most=512).collect()
    assert len(some) == 1024 and all(r.truncated for r in some)


def vector_rows():
    """(id, label, vector): groups, a chain, copies, lone ones, zero, null and other sizes, repeated ids, null labels, and pairs at the floor itself."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for centre in rng.normal(size=(12, 16)):
        rows += [centre + rng.normal(size=16) * rng.choice([0.2, 0.6, 1.0]) for _ in range(40)]
    rows += [np.eye(16)[0] * np.cos(0.9 * k) + np.eye(16)[1] * np.sin(0.9 * k) for k in range(5)]
    rows += [rows[3]] * 30 + [np.zeros(16), *np.eye(16), np.array([0.6, 0.8] + [0] * 14), rng.normal(size=8), rng.normal(size=8)]
    order = rng.permutation(len(rows))
    out = [(int(i), int(rng.integers(4)) if i % 11 else None, [float(x) for x in rows[k]]) for i, k in enumerate(order)]
    return [*out, (len(out), 1, None), (5, 2, out[9][2]), (None, 1, out[4][2])]


def test_vector_links_against_all_pairs(spark):
    """Components and successors over all pairs, with chunks and first chunks much smaller than the table."""
    import math

    from claimloom.operators import similar

    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").repartition(3)

    def cosine(a, b):
        if not a or not b or len(a) != len(b):
            return -1
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else -1

    for floor, values, first in ((0.6, 16 * 256, 16 * 256), (0.95, 16 * 300, 16)):
        root = {i: i for i, _, _ in rows if i is not None}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        best = {}
        for i, _, a in rows:
            for j, seq, b in rows:
                if i is not None and j is not None and i < j and cosine(a, b) >= floor:
                    low, high = sorted((find(i), find(j)))
                    root[high] = low
                    best[i] = max(best.get(i, ()), (seq is not None, seq or 0, j))
        got = {r.vec_id: r.component for r in similar.linked_components(df, floor, values=values, first_values=first).collect()}
        assert got == {None: None} | {i: find(i) for i in root} and len(set(got.values())) > 5
        found = similar.newest_successors(df, floor, values=values).collect()
        assert {r.older: r.newer for r in found} == {i: b[2] for i, b in best.items()} and len(found) == len(best) > 100


def test_vector_links_make_no_table_of_pairs(spark, tmp_path, monkeypatch):
    """The queries compare by products of blocks: pages of pairs are not asked for, whatever the size."""
    from claimloom.plans import catalog

    monkeypatch.setattr(catalog.vectors, "cosine_page", None)
    rng = __import__("random").Random(2)
    rows = [(i, i % 10, [rng.gauss(0, 1) for _ in range(64)]) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.QUERIES["similarity_components"](spark, str(tmp_path)).count() == 300
    assert catalog.QUERIES["newest_successor"](spark, str(tmp_path)).count() > 150
