"""Files, stores, the pipeline and the command line."""

import hashlib
import json

import pytest

from tablewright.__main__ import main
from tablewright.plans.pipeline import Context, Status, run_pipeline
from tablewright.sources import errors, files, fingerprint, objects, params, stores
from tablewright.streaming.drift_stream import StreamingDrift

MESSY = """id,age,salary,city,score,signup,target
1,34,"$50,000",Delhi ,0.5,2021-01-05,yes
2,?,"$60,000",Mumbai,-,2022/03/14,no
3,29,NA,Delhi,0.7,N/A,yes
3,29,NA,Delhi,0.7,N/A,yes
4,41,"$72,500",Pune,0.9,2021-07-01,
"""


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return f"file://{path}"


def test_messy_file(spark, tmp_path):
    df, meta = files.load(spark, write(tmp_path, "m.csv", MESSY))
    assert dict(df.dtypes) == {"id": "bigint", "age": "bigint", "salary": "bigint", "city": "string", "score": "double", "signup": "timestamp", "target": "string"}
    assert meta.rows == 5 and len(meta.sha256) == 64 and {r.city for r in df.collect()} == {"Delhi", "Mumbai", "Pune"}


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    df, _ = files.load(spark, write(tmp_path, "d.csv", sep.join("ab") + "\n" + "\n".join(sep.join([str(i), f"x{i}"]) for i in range(3)) + "\n"))
    assert df.columns == ["a", "b"] and df.count() == 3


def test_encodings(spark, tmp_path):
    df, _ = files.load(spark, write(tmp_path, "e.csv", "name,n\nJosé,1\nZoë,2\n", "cp1252"))
    assert {r.name for r in df.collect()} == {"José", "Zoë"}


def test_errors(spark, tmp_path):
    for name, text, error in [("a.txt", "x", errors.UnsupportedFormat), ("b.csv", "", errors.EmptyTable), ("c.csv", "a,b\n", errors.EmptyTable), ("d.csv", "a,b\n1,2,3\n", errors.CorruptedFile), ("e.json", "3", errors.InvalidJson), ("f.json", "[]", errors.EmptyTable), ("g.parquet", "no", errors.CorruptedFile)]:
        with pytest.raises(error):
            files.load(spark, write(tmp_path, name, text))


def test_json_forms(spark, tmp_path):
    for name, text in [("a.json", '[{"x": 1}, {"x": 2}]'), ("b.json", '{"data": [{"x": 1}, {"x": 2}]}'), ("c.json", '{"x": 1}\n{"x": 2}\n')]:
        df, _ = files.load(spark, write(tmp_path, name, text))
        assert sorted(r.x for r in df.collect()) == [1, 2]


def test_whole_files_decide(spark, tmp_path):
    long = "".join(json.dumps({"x": i, "t": "a" * 70_000 if i == 0 else "b"}) + "\n" for i in range(5))
    assert sorted(r.x for r in files.load_raw(spark, write(tmp_path, "long.json", long)).collect()) == [0, 1, 2, 3, 4]
    assert files.load_raw(spark, write(tmp_path, "spread.json", '{\n "data": [\n{"x": 1},\n{"x": 2}\n]}\n')).count() == 2
    for text in ('{\n"x": 1\n}\n{\n"x": 2\n}\n', '{"x": 1}{"x": 2}\n'):
        with pytest.raises(errors.InvalidJson):
            files.load_raw(spark, write(tmp_path, "several.json", text))
    rows = "".join(f"plain{i},{i}\n" for i in range(10_000))
    for encoding, name in (("cp1252", "Zoë €"), ("latin1", "Zoë \x81"), ("utf-8", "Zoë \ufffd"), ("utf-8-sig", "Zoë €")):
        df = files.load_raw(spark, write(tmp_path, "late.csv", f"name,n\n{rows}{name},-1\n", encoding))
        assert df.columns == ["name", "n"] and [r.name for r in df.where("n = -1").collect()] == [name] and df.count() == 10_001
    names = [c * 30_000 for c in "abc"]
    assert files.load_raw(spark, write(tmp_path, "wide.csv", ",".join(names) + "\n1,2,3\n")).columns == names


def test_large_files_are_split_and_streamed(spark, tmp_path):
    plain = write(tmp_path, "plain.csv", "a,b\n" + "".join(f'"x, ""{i}""",{i}\n' for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = files.load_raw(spark, plain)
        assert df.rdd.getNumPartitions() > 1 and df.count() == 1000 and df.where("b = 7").first().a == 'x, "7"'
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    df = files.load_raw(spark, write(tmp_path, "spans.csv", 'a,b\n"one\ntwo",1\nx,2\n'))
    assert {r.a for r in df.collect()} == {"one\ntwo", "x"}
    raw = (tmp_path / "plain.csv").read_bytes()
    for algorithm in ("sha256", "sha512", "sha1", "md5"):
        assert files.checksum(spark, plain, algorithm, most=10) == files.checksum(spark, plain, algorithm) == hashlib.new(algorithm, raw).hexdigest()
    assert files.checksum(spark, f"{tmp_path}", most=10) == files.checksum(spark, f"{tmp_path}")


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, t string")
    for kind in ("csv", "json", "parquet", "feather"):
        files.save(df, f"{tmp_path}/o.{kind}")
        assert files.load(spark, f"{tmp_path}/o.{kind}", cleaned=False)[0].count() == 2
    files.export_csv(df, f"{tmp_path}/one.csv", {"steps": []})
    raw = open(f"{tmp_path}/one.csv", "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf") and json.load(open(f"{tmp_path}/one.csv.manifest.json")) == {"steps": []}


def test_feather(spark, tmp_path):
    path = f"{tmp_path}/t.feather"
    df = spark.range(1000).selectExpr("id", "cast(id AS string) AS t", "array(id) AS a", "timestamp_seconds(id) AS ts").repartition(3)
    files.save(df, path)
    files.save(files.load_raw(spark, path).where("id < 500"), path)  # over what it reads
    assert files.load_raw(spark, path).exceptAll(df.where("id < 500")).isEmpty() and files.load_raw(spark, path).count() == 500
    files.save(df, path, mode="append")
    assert files.load_raw(spark, path).count() == 1500
    files.save(df.where("id < 0"), path)
    assert files.load_raw(spark, path).schema == df.schema and files.load_raw(spark, path).isEmpty()
    with pytest.raises(errors.EmptyTable):
        files.load(spark, path)
    (tmp_path / "bad.feather").write_bytes(b"no arrow")
    with pytest.raises(errors.CorruptedFile):
        files.load(spark, f"{tmp_path}/bad.feather")


def test_required_columns(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1,2\n")
    assert files.load(spark, f"{tmp_path}/r.csv", required=["b"])[0].count() == 1
    with pytest.raises(errors.MissingColumns, match="c, d"):
        files.load(spark, f"{tmp_path}/r.csv", required=["a", "c", "d"])


@pytest.mark.parametrize("name,group", [("in/sales_v2.csv", "sales"), ("sales-1.4.csv", "sales"), ("sales_V3.csv", "sales"), ("sales_2023_11.csv", "sales"), ("sales_20231130.csv", "sales"), ("wine3.csv", "wine3"), ("Sales.csv", "Sales")])
def test_version_groups(name, group):
    assert stores.version_group(name) == group


def test_run_log(spark, tmp_path):
    log = stores.RunLog(spark, f"{tmp_path}/runs")
    assert log.best("f1") is None
    low, high = log.log("forest", {"trees": 5}, {"f1": 0.5, "matrix": [[1]]}), log.log("boosting", {}, {"f1": 0.9}, {"curve": "c.json"})
    assert log.best("f1").run_id == high and log.best("f1", largest=False).run_id == low
    assert log.best("f1").artifacts == {"curve": "c.json"} and log.best("f1", largest=False).metrics == {"f1": 0.5}


def test_fingerprints(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS b")
    same = fingerprint.fingerprint(df.repartition(7))
    assert fingerprint.fingerprint(df) == same != fingerprint.fingerprint(df.where("id > 0"))


def test_objects_and_params(spark, tmp_path):
    path = f"file://{tmp_path}/o.json"
    objects.save_json(spark, path, {"a": [1, 2]})
    copy = objects.backup(spark, path)
    assert objects.load_json(spark, copy) == {"a": [1, 2]} and objects.size(spark, path) > 0
    assert objects.delete(spark, path) and not objects.exists(spark, path)
    (tmp_path / "p.yaml").write_text("data:\n  drift:\n    psi_warning: 0.2\n  quality:\n    health_score_weights:\n      timeliness: 0.3\n")
    rules = params.drift_rules(f"{tmp_path}/p.yaml", min_samples=5)
    assert rules["psi_warning"] == 0.2 and rules["min_samples"] == 5 and rules["psi_critical"] == 0.25
    assert params.health_weights(f"{tmp_path}/p.yaml")["reliability"] == 0.3


def test_registry_and_lineage(spark, tmp_path):
    r = stores.Registry(spark, f"{tmp_path}/registry")
    first, second = r.register("sales_v1.csv", "p", 3, 2, "x"), r.register("sales_v2.csv", "p", 4, 2, "y")
    assert r.get(second).version == 2 and r.get(second).parent_id == first and r.latest("sales").dataset_id == second
    r.delete(second)
    assert r.count() == 1 and r.latest("sales").dataset_id == first
    events = stores.Lineage(spark, f"{tmp_path}/lineage", dataset_id=first, dataset_name="sales")
    events.record("ingest", "read")
    events.record("repair", "filled", column="age")
    assert [e.stage for e in events.trace().collect()] == ["ingest", "repair"] and events.list_runs().first().events == 2
    assert events.trace_for_dataset(first).count() == 2
    again = stores.Lineage(spark, f"{tmp_path}/lineage", run_id=events.run_id)
    again.record("export", "written")
    assert [e.sequence for e in again.trace().collect()] == [1, 2, 3]


def test_pipeline_and_commands(spark, tmp_path, capsys):
    text = "id,age,amount,city,label,blank\n" + "".join(f"{i},{'' if i % 8 == 0 else 20 + i % 40},\"${1000 + i}\",{'N/A' if i % 12 == 0 else 'Delhi'},{'yes' if i % 2 else 'no'},\n" for i in range(60))
    path = write(tmp_path, "p.csv", text)
    context = Context(spark, path, output=f"{tmp_path}/out")
    status, stages = run_pipeline(context)
    assert status is Status.COMPLETED, stages
    kinds = {s.name: s.status for s in stages}
    assert kinds["training"] is Status.SKIPPED and kinds["drift"] is Status.SKIPPED and "blank" not in context.df.columns
    assert json.load(open(f"{tmp_path}/out/report.json"))["metadata"]["rows"] == 60
    assert main(["drift", path, path], spark) == 0 and main(["nonsense"], spark) == 3 and main(["run", f"{path}x"], spark) == 2
    capsys.readouterr()


def test_streaming_drift(spark, tmp_path):
    spark.range(1000).selectExpr("id AS v", "timestamp_seconds(id) AS t").write.parquet(f"{tmp_path}/in")
    reference = spark.range(1000).selectExpr("id AS v")
    watch = StreamingDrift(reference, "v")
    stream = spark.readStream.schema("v long, t timestamp").parquet(f"{tmp_path}/in")
    q = watch.counts(stream, "t", "1 hour").writeStream.outputMode("complete").format("memory").queryName("drift_counts").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    assert abs(watch.psi(spark.table("drift_counts"))) < 1e-9
