"""Landed files of many kinds, and the choice among a filing's documents."""

import gzip
import json

from pyspark.sql import functions as F

from tradelens.plans import registry
from tradelens.plans import views as V
from tradelens.sources import landing

XML = "<ownershipDocument><issuer><issuerCik>1</issuerCik></issuer></ownershipDocument>"


def land(root, files):
    for path, content in files.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_files_are_read_whole_or_set_aside(spark, tmp_path):
    latin = '<?xml version="1.0" encoding="ISO-8859-1"?><ownershipDocument>é</ownershipDocument>'
    land(tmp_path, {
        "000120000001/a.xml": XML + "\n\nsecond part", "000120000002/b.xml": latin.encode("latin-1"), "000120000003/c.xml": b"\xff\xfe\x3c\x00", "000120000004/d.xml": " \n\t ",
        "000120000005/e.xml": b"", "000120000006/f.xml": XML + " " * 2000, "accession_number=000120000007/document=g.xml/part-0-x.txt": b"\xef\xbb\xbf" + XML.encode(),
    })
    files = landing.scan_files(spark, str(tmp_path), most_bytes=1000)
    got = {r.accession_number[-1]: (r.document, r.status, r.text) for r in files.collect()}
    assert got == {
        "1": ("a.xml", "ok", XML + "\n\nsecond part"), "2": ("b.xml", "ok", latin), "3": ("c.xml", "not_text", None), "4": ("d.xml", "empty", " \n\t "),
        "6": ("f.xml", "too_large", None), "7": ("g.xml", "ok", XML),
    }
    aside = landing.set_aside(files)
    assert {r.document for r in aside.collect()} == {"c.xml", "d.xml", "f.xml"} and "text" not in aside.columns
    large = landing.scan_files(spark, str(tmp_path), most_bytes=1000).where("status = 'too_large'").select("document", "n_bytes")
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,1000)" in plan and [r.n_bytes for r in large.collect()] == [len(XML) + 2000]


def test_many_small_files_share_tasks(spark, tmp_path):
    land(tmp_path, {f"{i:012}/x.xml": XML for i in range(200)})
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        files = landing.scan_files(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() < 60 and files.count() == 200
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_parts_of_small_files_share_tasks_and_few_tasks_list_them(spark, tmp_path):
    land(tmp_path, {f"{i:012}/x.xml": XML for i in range(300)})
    keys = {"spark.sql.files.openCostInBytes": str(1 << 30), "spark.sql.sources.parallelPartitionDiscovery.parallelism": "10000"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        spark.sparkContext.setJobGroup("listing", "")
        files = landing.scan_files(spark, str(tmp_path))  # a part for each file
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(k) for j in tracker.getJobIdsForGroup("listing") for k in tracker.getJobInfo(j).stageIds]
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert stages and max(x.numTasks for x in stages if x) <= 4 * spark.sparkContext.defaultParallelism
        assert files.rdd.getNumPartitions() < 60 and files.where("status = 'ok'").count() == 300
        assert {k: spark.conf.get(k) for k in keys} == keys
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_files_are_written_alike_by_tasks_and_by_sparks_writer(spark, tmp_path, monkeypatch):
    rows = [("a" * 3000 + " é", "31", "x.xml"), ("", "31", "y.xml"), (None, "32", "x.xml"), ("one", "33", "x.xml"), ("two", "33", "x.xml"), ("none", None, "x.xml"), (" ", "", "x.xml"), ("\n", "34", "x.xml"), ("z" * 20_000, "35", "x.xml")]
    rows += [(XML + str(i), f"{i}", "x.xml") for i in range(1000, 1200)]  # more than are held at once
    files = spark.createDataFrame(rows, "text string, accession_number string, document string").repartition(3, "accession_number").sortWithinPartitions("accession_number", "document", "text")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, got = spark.conf.get(key), []
    for at in ("tasks", "writer"):
        root = tmp_path / at
        landing.write_files(files, root.as_uri())
        found = [p for p in root.rglob("*") if p.is_file()]
        assert any(p.suffix == ".crc" for p in found) == (at == "writer") and not any(p.name.startswith(".") and p.suffix != ".crc" for p in found)
        got.append(sorted(((r.accession_number, r.document, r.status, r.text) for r in landing.scan_files(spark, root.as_uri(), most_bytes=10_000).collect()), key=str))
        monkeypatch.setattr(landing, "_local", lambda *_: None)  # a store that is not in the file system of the machine
    assert got[0] == got[1] and len({r[0] for r in got[0]}) == 206 and ("33", "x.xml", "ok", "one\ntwo\n") in got[0]
    assert spark.conf.get(key) == before


def test_document_of_a_filing(spark, tmp_path):
    page = "<html>rendered</html>"
    land(tmp_path / "files", {
        "11/form.xml": XML, "12/form.xml": page, "12/b.xml": " " + XML, "12/a.txt": XML, "12/c.XML": XML, "13/form.htm": "x" * 600 + XML, "14/other.xml": XML,
        "15/form.txt": "some words <ownershipDocument>", "16/form.xml": b"\xff", "17/form.xml": "\n<?xml version='1.0'?><x/>",
    })
    (tmp_path / "listings").mkdir()
    listing = {"cik": "1", "accessionNumber": ["1-1", "1-2", "1-3", "1-4", "1-5", "1-6", "1-7"], "primaryDocument": ["xslF345X03/form.xml", "form.xml", "form.htm", "", "form.txt", "form.xml", "form.xml"]}
    (tmp_path / "listings" / "x.json").write_text(json.dumps(listing))
    named = landing.read_document_map(spark, str(tmp_path / "listings"))
    assert {r.accession_number for r in named.collect()} == {"11", "12", "13", "15", "16", "17"}
    got = {r.accession_number: (r.document, r.via, r.xml is not None) for r in landing.filing_documents(landing.scan_files(spark, str(tmp_path / "files")), named).collect()}
    assert got == {
        "11": ("form.xml", "primary", True), "12": ("b.xml", "index", True), "13": (None, None, False), "14": ("other.xml", "index", True),
        "15": ("form.txt", "primary", True), "16": (None, None, False), "17": ("form.xml", "primary", True),
    }


def test_files_in_gzip_are_unpacked_within_bounds(spark, tmp_path):
    packed = gzip.compress(XML.encode())
    land(tmp_path, {
        "21/a.xml.gz": packed, "22/b.xml.gz": packed[:-12], "23/c.xml.gz": gzip.compress(b"<x>" + b" " * 5_000_000), "accession_number=24/document=d.xml/part-0.txt.gz": packed + gzip.compress(b"\n"),
        "25/e.xml.gz": b"no gzip", "26/f.xml.gz": gzip.compress(b"\xff\xfe"), "27/g.xml.gz": gzip.compress(b" \n"), "28/h.xml": XML,
    })
    got = {r.accession_number: (r.document, r.status, r.text) for r in landing.scan_files(spark, str(tmp_path), most_bytes=10_000).collect()}
    assert got == {
        "21": ("a.xml", "ok", XML), "22": ("b.xml", "not_text", None), "23": ("c.xml", "too_large", None), "24": ("d.xml", "ok", XML + "\n"),
        "25": ("e.xml", "not_text", None), "26": ("f.xml", "not_text", None), "27": ("g.xml", "empty", " \n"), "28": ("h.xml", "ok", XML),
    }


def test_xml_is_made_after_the_shuffle(spark, small):
    made = registry.documents_of(V.transactions(spark, small).withColumn("filed_year", F.year("transaction_date")), ["cik", "filed_year"])
    lines = made._jdf.queryExecution().executedPlan().toString().splitlines()
    below = next(i for i, x in enumerate(lines) if "Exchange" in x)
    assert not any("<nonDerivativeTransaction>" in x for x in lines[below:])
