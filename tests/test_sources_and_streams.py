"""File readers and writers, streams, and the registry."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clauseflow.sources import readers as RD, writers as WR
from clauseflow.streaming import documents as ST
from clauseflow.streaming.windows import sliding_rate


def test_tolerant_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1}\n\n{"id": \n{"id": 2}\n')
    got = RD.read_jsonl(spark, str(p), "id long").where("id is not null")
    assert sorted(r.id for r in got.collect()) == [1, 2]
    assert RD.read_jsonl(spark, str(tmp_path / "none"), "id long").count() == 0
    states = {r.state: r.n for r in RD.jsonl_damage(spark, str(p), "id long").collect()}
    assert states == {"kept": 2, "blank": 1, "malformed": 1}


def test_decision_layouts(spark, tmp_path):
    long_ = "т" * 600
    for name, doc in {
        "a": {"decision_id": "1", "full_text": "", "decision_text": long_, "purchase_id": "9"},
        "b": {"fas_case_id": "2", "decision_text": "х" * 120, "notice_id": ""},
        "c": {"decision_id": "", "full_text": long_},
    }.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, ensure_ascii=False))
    texts = {r.decision_id or r.fas_case_id: r.text for r in RD.read_decisions(spark, str(tmp_path)).collect()}
    assert texts["1"] == long_ and len(texts["2"]) == 120
    m = {r.canonical_decision_id: r for r in RD.decision_manifest(spark, str(tmp_path)).collect()}
    assert m["1"].schema_family == "decision_id|full_text|purchase_id" and not m["1"].has_text
    assert m["2"].is_too_short and m["2"].schema_family == "fas_case_id|decision_text|notice_id"
    assert m["c"].text_length == 600
    s = RD.manifest_summary(RD.decision_manifest(spark, str(tmp_path)))
    assert sum(r.n for r in s.collect()) == 3


def test_specification_folders(spark, tmp_path):
    d = tmp_path / "0001"
    d.mkdir()
    (d / "tz.md").write_bytes("описание\n".encode() + b"\xff")
    r = RD.read_specifications(spark, str(tmp_path / "*" / "tz.md")).first()
    assert r.notice_id == "0001" and r.text.endswith("�")


def test_csv_ids_and_nested_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("007", ["a", 'b"c'])], "id string, xs array<string>")
    WR.write_nested_csv(df, str(tmp_path / "o"))
    r = RD.read_csv(spark, str(tmp_path / "o"), "id string, xs string").first()
    assert r.id == "007" and json.loads(r.xs) == ["a", 'b"c']
    WR.append_jsonl(df, str(tmp_path / "l"))
    WR.append_jsonl(df, str(tmp_path / "l"))
    assert RD.read_jsonl(spark, str(tmp_path / "l"), "id string").count() == 2


def test_restart_processes_only_new_files(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    work = lambda s: s.select("id", (F.col("id") * 2).alias("d"))
    for lo in (0, 10):
        spark.range(lo, lo + 10).coalesce(1).write.mode("append").parquet(src)
        ST.drain(ST.check_incrementally(ST.arrivals(spark, src, "id long"), work, out, cp))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(20))


def test_upsert_keeps_latest_with_late_rows(spark, tmp_path):
    src, tbl, cp = (str(tmp_path / x) for x in ("src", "tbl", "cp"))
    schema, key, order = "k string, t int, v string", ["k"], ["t"]
    assert ST.read_latest(spark, tbl, key, order) is None

    def latest():
        return {r.k: r.v for r in ST.read_latest(spark, tbl, key, order).collect()}

    batches = [
        [("a", 5, "new"), ("b", 1, "b1")], [("a", 3, "late"), ("b", 2, "b2"), ("c", 1, "c1")], [("c", 2, "c2")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ST.drain(ST.upsert_latest(ST.arrivals(spark, src, schema), key, order, tbl, cp))
        if i == 1:
            first = (tmp_path / "tbl" / "batch-0").stat().st_mtime_ns
            ST.compact_latest(spark, tbl, key, order)
            assert (tmp_path / "tbl" / "base-1").exists()
            assert latest() == {"a": "new", "b": "b2", "c": "c1"}
    assert latest() == {"a": "new", "b": "b2", "c": "c2"}
    assert (tmp_path / "tbl" / "batch-0").stat().st_mtime_ns == first  # nothing was rewritten
    # a batch whose write was cut off is not read
    shutil.copytree(tmp_path / "tbl" / "batch-2", tmp_path / "tbl" / "batch-3")
    (tmp_path / "tbl" / "batch-3" / "_SUCCESS").unlink()
    spark.createDataFrame([("c", 9, "lost")], schema).write.mode("append").option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(str(tmp_path / "tbl" / "batch-3"))
    assert latest() == {"a": "new", "b": "b2", "c": "c2"}
    # a replayed batch takes its own place
    spark.createDataFrame(batches[2], schema).write.mode("overwrite").parquet(str(tmp_path / "tbl" / "batch-2"))
    assert latest() == {"a": "new", "b": "b2", "c": "c2"}


def test_duplicates_are_remembered_over_restarts_on_disk(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for rows in (["a", "b", "a"], ["b", "c"], ["c", "a", "d"]):
        spark.createDataFrame([(r,) for r in rows], "k string").coalesce(1).write.mode("append").parquet(src)
        kept = ST.suppress_duplicates(ST.arrivals(spark, src, "k string"), ["k"])
        ST.drain(kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)
                 .trigger(availableNow=True).start())
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]
    assert "RocksDB" in spark.conf.get(ST.PROVIDER)
    # the keys are in the store's files, not in the heap's snapshot format
    assert list((tmp_path / "cp" / "state").rglob("*.zip")) or list((tmp_path / "cp" / "state").rglob("*.changelog"))


def test_gate_stops_on_one_class(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(200).select(F.lit("n").alias("v")).repartition(8).write.parquet(src)
    stream = ST.arrivals(spark, src, "v string", 1)
    log = ST.gated(stream, "v", "p", str(tmp_path / "cp"))
    assert log[-1]["stop"] and log[-1]["n_seen"] < 200
    assert ST.gated(stream, "v", "p", str(tmp_path / "cp")) == log  # a restart stays stopped


def test_gate_goes_on_after_a_restart(spark, tmp_path):
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    seen = []
    for values in (["n"] * 20, ["n"] * 5 + ["p"], ["n"] * 20):
        spark.createDataFrame([(v,) for v in values], "v string").coalesce(1).write.mode("append").parquet(src)
        seen.append(ST.gated(ST.arrivals(spark, src, "v string", 1), "v", "p", cp))
    assert [len(x) for x in seen] == [1, 2, 3]
    assert seen[2][-1] == {"batch": 2, "n_seen": 46, "n_positive": 1, "stop": False}
    # a replayed batch counts once
    spark.createDataFrame([(1, 6, 1)], "batch long, n long, p long").write.mode("overwrite").parquet(f"{cp}-gate/batch-1")
    assert ST.gate_log(spark, f"{cp}-gate").orderBy("batch").collect()[-1].n_seen == 46


def test_sliding_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    e = spark.range(300).select(
        (F.col("id") % 4).alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("ts"))
    e.coalesce(2).write.parquet(src)
    want = sliding_rate(spark.read.parquet(src), "60 seconds", "10 seconds", 2)
    s = sliding_rate(ST.arrivals(spark, src, e.schema), "60 seconds", "10 seconds", 2)
    q = s.writeStream.format("memory").queryName("rate").outputMode("complete").trigger(availableNow=True).start()
    ST.drain(q)
    key = lambda df: sorted((r.user_id, r.window.start, r.n, r.over_limit) for r in df.collect())
    assert key(spark.table("rate")) == key(want)


def test_registry_shape():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 170 and set(o) <= set(q)
    ids = {name[:3] for name in q}
    want = {f"{letter}{i:02d}" for letter, n in dict(
        s=13, p=24, t=19, j=10, m=13, g=28, r=5, w=14, x=5, u=17, v=12, k=11, z=6).items() for i in range(1, n + 1)}
    assert want <= ids


@pytest.mark.parametrize("name", ["g01_fact_pr", "g10_error_typology", "m01_greedy_match", "r01_cluster_bootstrap", "u16_risk_report", "v06_density_clusters", "x05_partition_exhaustive"])
def test_queries_agree_with_sql_on_small_tables(spark, name):
    from scripts.verify import ROOT, compare, duck

    sdf = entry.queries()[name](spark, f"{ROOT}0.001").toPandas()
    odf = duck("0.001").execute(entry.oracle_sql()[name]).df()
    assert compare(sdf, odf).startswith("ok"), compare(sdf, odf)


def test_pooled_row_is_sum_of_strata(spark):
    rows = entry.entry(spark).collect()
    pooled = [r for r in rows if r.stratum == "pooled"][0]
    for c in ("episodes", "matched", "gold", "pred"):
        assert pooled[c] == sum(r[c] for r in rows if r.stratum != "pooled")


def test_files_of_single_rows_lie_in_one_folder(spark, tmp_path):
    import os

    from clauseflow.sources import readers, writers

    df = spark.createDataFrame([(i, f"text {i}\nmore") for i in range(40)], "notice long, value string")
    flat, deep = str(tmp_path / "flat"), str(tmp_path / "deep")
    writers.write_files(df.select("value"), flat)
    assert sum(f.endswith(".txt") for f in os.listdir(flat)) == 40
    writers.write_files(df, deep, "notice")
    back = readers.read_specifications(spark, deep, r"notice=([^/]+)/").collect()
    assert {(int(r.notice_id), r.text.rstrip("\n")) for r in back} == {(r.notice, r.value) for r in df.collect()}


def test_arrivals_of_a_larger_table_are_more_files(spark, monkeypatch):
    from clauseflow.plans import files_and_streams as FS

    seen = []
    monkeypatch.setattr(FS.ST, "arrivals", lambda s, path, schema, n: seen.append((len(s.read.parquet(path).inputFiles()), n)))
    FS._arrivals(spark, spark.range(0, 900, 1, 9), 3, "many")
    FS._arrivals(spark, spark.range(0, 900, 1, 1), 3, "few")
    assert seen == [(9, 3), (3, 1)]


def test_single_files_are_whole_and_listed_in_shards(spark, tmp_path):
    """A folder of several rows keeps them all; folders lie in shards, without files of an unfinished attempt."""
    rows = [(f"no/{i % 90}", f"text {i // 2}") for i in range(180)] + [("empty", "")]
    df = spark.createDataFrame(rows, "notice string, value string").repartition(5)
    deep = tmp_path / "deep"
    WR.write_files(df, f"file://{deep}", "notice")
    shards = [d for d in deep.iterdir() if d.is_dir()]
    assert len(shards) > 32 and sum(len(list(d.glob("notice=*"))) for d in shards) == 91
    back = RD.read_specifications(spark, str(deep), r"notice=([^/]+)/").collect()
    want = sorted((n.replace("/", "%2F"), t) for n, t in rows)
    assert sorted((r.notice_id.replace("%252F", "%2F"), r.text.removesuffix("\n")) for r in back) == want
    again = WR._place  # the same rows in another attempt take the same places
    before = sorted(p.relative_to(deep) for p in deep.rglob("*") if p.is_file())
    root = str(deep)
    folded = df.select(F.col("notice").alias("name"), "value").sortWithinPartitions("name")
    folded.mapInArrow(lambda b: again(b, root, "notice"), "n long").collect()
    assert sorted(p.relative_to(deep) for p in deep.rglob("*") if p.is_file()) == before
