"""CSV captures: repeated headers, latin1 labels, bad cells, report, row positions."""

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowlens.operators.clean import prepare_flows
from flowlens.sources.flow_csv import list_csv, read_directory, scan_directory


def _write(d: Path):
    a = [" Destination Port, Flow Duration, Fwd Header Length, Label, Fwd Header Length, Src IP"]
    for i in range(40):
        lab = "BENIGN" if i % 2 else "Web Attack \x96 XSS"
        dur = "Infinity" if i == 3 else ("" if i == 5 else str(i * 10))
        a.append(f"{80 + i},{dur},{i},{lab},{i + 1},10.0.0.{i}")
    (d / "a_Monday.csv").write_bytes(("\n".join(a) + "\n").encode("latin1"))
    b = ["Dst Port,Flow Duration,Fwd Header Len,Label,Src IP"]
    for i in range(20):
        b.append(f"{443},{i},{i},{'DDoS' if i % 3 else 'Bot'},x")
    (d / "b_Friday.csv").write_bytes(("\n".join(b) + "\n").encode("latin1"))


def test_read_and_prepare(spark):
    d = Path(tempfile.mkdtemp(prefix="flowlens-csv-"))
    _write(d)
    caps = read_directory(spark, str(d))
    assert [c.name for c in caps] == ["a_Monday.csv", "b_Friday.csv"]
    assert caps[0].duplicates == ["fwd_header_len"]
    assert caps[0].columns == ["dst_port", "flow_duration", "fwd_header_len", "label", "src_ip"]
    rows = caps[0].data.orderBy("source_row").select("source_row", "dst_port", "label").collect()
    assert [r["source_row"] for r in rows] == list(range(40))
    assert rows[0]["dst_port"] == "80" and rows[0]["label"] == "Web Attack \x96 XSS"
    scan = scan_directory(spark, str(d))
    prep = prepare_flows(scan.data, "demo", scan.candidates, duplicate_columns=scan.duplicates)
    rep = {r["file"]: r for r in prep.report.collect()}
    assert rep["a_Monday.csv"]["rows_before"] == 40
    assert rep["a_Monday.csv"]["rows_after_label_filter"] == 40
    assert rep["a_Monday.csv"]["rows_after_cleaning"] == 38
    assert rep["a_Monday.csv"]["dropped_duplicate_columns"] == "fwd_header_len"
    assert rep["a_Monday.csv"]["dropped_non_numeric_columns"] == "src_ip"
    assert rep["b_Friday.csv"]["rows_after_label_filter"] == 13
    assert prep.features == ["dst_port", "flow_duration", "fwd_header_len"]
    fam = {r["attack_family"]: r["count"] for r in prep.data.groupBy("attack_family").count().collect()}
    assert fam == {"Benign": 18, "WebAttack": 20, "DDoS": 13}  # rows 3 and 5 are benign
    assert prep.data.where(F.col("source_file") == "a_Monday.csv").agg(F.max("source_row")).first()[0] == 39


def test_quoted_header_and_file_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('"Dst, Port",Flow Duration,Label\n1,2,BENIGN\n3,4,DDoS\n'.encode("latin1"))
    (tmp_path / "b.csv").write_bytes("Dst Port,Flow Duration,Label\n".encode("latin1"))
    caps = read_directory(spark, str(tmp_path))
    assert [c.columns for c in caps] == [["dst_port", "flow_duration", "label"]] * 2
    scan = scan_directory(spark, str(tmp_path))
    prep = prepare_flows(scan.data, "demo", scan.candidates, absent=scan.absent, files=scan.names)
    rep = {r["file"]: (r["rows_before"], r["rows_after_cleaning"]) for r in prep.report.collect()}
    assert rep == {"a.csv": (2, 2), "b.csv": (0, 0)}


def test_files_in_three_forms_plan_one_scan(spark, tmp_path):
    heads = ("Dst Port,Flow Duration,Label", "Label, Destination Port ,Flow Duration", "Flow Duration,Label,Extra,Label")
    for i in range(60):
        cells = {"port": str(i), "time": "7", "label": "BENIGN"}
        row = ("{port},{time},{label}", "{label},{port},{time}", "{time},{label},x{port},other")[i % 3].format(**cells)
        (tmp_path / f"f{i:03d}.csv").write_text(f"{heads[i % 3]}\n" + f"{row}\n" * (i % 4))
    scan = scan_directory(spark, str(tmp_path))
    assert len(scan.forms) == 3 and len(scan.names) == 60
    plan = scan.data._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [file") == 2  # the lines, and the lines again for block counts; no branch per file or form
    rows = scan.data.where("flow_duration = '7' AND label = 'BENIGN'").count()
    assert rows == scan.data.count() == sum(i % 4 for i in range(60))
    assert scan.absent["dst_port"] == [f"f{i:03d}.csv" for i in range(2, 60, 3)] and scan.duplicates["f002.csv"] == ["label"]


def test_positions_in_files_of_many_blocks(spark, tmp_path):
    lines = ["Dst Port,Label", ""] + [f"{i},{'BENIGN' if i % 3 else 'DDoS'}" + ("\n" if i % 50 == 0 else "") for i in range(4000)]
    (tmp_path / "big.csv").write_bytes("\r\n".join(lines).encode("latin1"))
    (tmp_path / "small.csv").write_text("Dst Port,Label\n0,Bot\n1,Bot\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        scan = scan_directory(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert scan.data.where("CAST(source_row AS STRING) <> dst_port").count() == 0
    assert {r["file"]: r["rows"] for r in scan.files.collect()} == {"big.csv": 4000, "small.csv": 2}


def test_failing_files_are_reported_and_skipped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Dst Port,Label\n1,BENIGN\n2,DDoS\n")
    (tmp_path / "damaged.csv").write_text("Dst Port,Label\n3,BENIGN\n")
    (tmp_path / ".damaged.csv.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x12\x34\x56\x78")  # does not fit the file
    (tmp_path / "empty.csv").write_text("\n\n")
    (tmp_path / "other.csv").write_text("Dst Port,Class\n4,BENIGN\n")
    scan = scan_directory(spark, str(tmp_path), strict=False)
    report = {r["file"]: (r["status"], r["rows"]) for r in scan.files.collect()}
    assert report == {"a.csv": ("ok", 2), "damaged.csv": ("unreadable", 0), "empty.csv": ("empty", 0), "other.csv": ("no label", 0)}
    assert "damaged.csv" in scan.files.where("file = 'damaged.csv'").first()["message"]
    assert sorted(r["dst_port"] for r in scan.data.collect()) == ["1", "2"]
    with pytest.raises((OSError, ValueError, KeyError)):
        scan_directory(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in list_csv(spark, str(tmp_path), "MPT")] == ["empty.csv"]
    with pytest.raises(FileNotFoundError):
        list_csv(spark, str(tmp_path), "nothing")
