from datetime import date

from pyspark.sql import functions as F

from tradelens.sources import documents, readers

DOC = """<ownershipDocument><issuer><issuerCik>0000123</issuerCik><issuerName>Acme</issuerName><issuerTradingSymbol>NASDAQ:ABC</issuerTradingSymbol></issuer>
<reportingOwner><reportingOwnerId><rptOwnerName>Ann</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>true</isDirector><officerTitle></officerTitle></reportingOwnerRelationship></reportingOwner>
<reportingOwner><reportingOwnerId><rptOwnerName>Bob</rptOwnerName></reportingOwnerId></reportingOwner>
<nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2020-01-05-05:00</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding>
<transactionAmounts><transactionShares><value>10</value></transactionShares><transactionPricePerShare><value>{price}</value></transactionPricePerShare></transactionAmounts>
<postTransactionAmounts><sharesOwnedFollowingTransaction><value>30</value></sharesOwnedFollowingTransaction></postTransactionAmounts></nonDerivativeTransaction></nonDerivativeTable>{note}</ownershipDocument>"""


def test_documents(spark):
    rows = [("ok", DOC.format(price="2.5", note="")), ("plan", DOC.format(price="n/a", note="<footnotes>under a Rule 10b5-1 plan</footnotes>")), ("bad", "<ownershipDocument><issuer>"), ("empty", ""), ("null", None), ("deriv", "<ownershipDocument><issuer><issuerCik>1</issuerCik></issuer><derivativeTable></derivativeTable></ownershipDocument>")]
    found = documents.parsed(spark.createDataFrame(rows, "accession_number string, xml string")).cache()
    assert {r.accession_number: r.outcome for r in found.collect()} == {"ok": "ok", "plan": "ok", "bad": "parse_error", "empty": "xml_missing", "null": "xml_missing", "deriv": "deriv_only"}
    tx = {r.accession_number: r for r in documents.transactions(found).collect()}
    ok, plan = tx["ok"], tx["plan"]
    assert (ok.cik, ok.ticker, ok.insider_name, ok.insider_role, ok.role_category, ok.transaction_date) == ("123", "ABC", "Ann", "Director", "director", date(2020, 1, 5))
    assert float(ok.total_value) == 25.0 and ok.is_direct and not ok.is_10b51
    assert plan.price_per_share is None and plan.total_value is None and plan.is_10b51
    assert ok.acquired_disposed == "A"
    coding = lambda x: DOC.format(price="1", note="").replace("<transactionCode>P", x + "<transactionCode>P")
    flagged = [("form", "<transactionFormType>1</transactionFormType>"), ("late", "<transactionTimeliness><value>true</value></transactionTimeliness>"), ("plain", "<transactionTimeliness>1</transactionTimeliness>"), ("four", "<transactionFormType>4</transactionFormType><transactionTimeliness></transactionTimeliness>")]
    found = documents.parsed(spark.createDataFrame([(n, coding(x).replace("</transactionPricePerShare>", "</transactionPricePerShare><transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode>")) for n, x in flagged], "accession_number string, xml string"))
    assert {r.accession_number: (r.is_10b51, r.acquired_disposed) for r in documents.transactions(found).collect()} == {"form": (True, "D"), "late": (True, "D"), "plain": (True, "D"), "four": (False, "D")}
    plan = documents.transactions(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1
    assert {r.outcome: r.n for r in documents.outcomes(found).collect()} == {"ok": 4}


def test_attributes_are_no_fields_and_plans_are_found_in_any_case(spark):
    rows = [("attr", DOC.format(price="1", note="").replace("<ownershipDocument>", '<ownershipDocument corrupt="x">')), ("upper", DOC.format(price="1", note="<remarks>10B5-1</remarks>")), ("rule", DOC.format(price="1", note="<remarks>RULE 10B5</remarks>")), ("bare", DOC.format(price="1", note="<remarks>10b5</remarks>"))]
    found = documents.parsed(spark.createDataFrame(rows, "accession_number string, xml string"))
    assert {r.accession_number: r.outcome for r in found.collect()} == dict.fromkeys(["attr", "upper", "rule", "bare"], "ok")
    assert {r.accession_number: r.is_10b51 for r in documents.transactions(found).collect()} == {"attr": False, "upper": True, "rule": True, "bare": False}


def test_readers(spark, tmp_path):
    (tmp_path / "index.json").write_text('{"hits": {"hits": [{"_id": "0001-20-1:doc.xml", "_source": {"ciks": ["0000000007", "0000000009"], "display_names": ["Ann (CIK 7)", "Acme Corp  (CIK 0000000009)"], "file_date": "2020-01-02", "period_ending": "2020-01-01", "form": "4"}}]}}')
    r = readers.read_filing_index(spark, str(tmp_path / "index.json")).first()
    assert (r.accession_number, r.cik, r.filer_cik, r.entity_name, r.filed_date) == ("0001-20-1", "9", "7", "Acme Corp", date(2020, 1, 2))
    (tmp_path / "u.txt").write_text(" abc\n\nABC\nx\n")
    assert sorted(x.ticker for x in readers.read_universe(spark, str(tmp_path / "u.txt")).collect()) == ["ABC", "X"]
    bars = readers.price_bars(spark.createDataFrame([("A", [0, 86400], [1.0, None])], "ticker string, timestamp array<long>, close array<double>")).collect()
    assert [(b.date, b.close) for b in bars] == [(date(1970, 1, 1), 1.0)]
    docs = readers.primary_documents(spark.createDataFrame([(["1-2"], ["xslF345/x.xml"])], "accessionNumber array<string>, primaryDocument array<string>")).first()
    assert tuple(docs) == ("12", "x.xml")
    ct = readers.cik_tickers(spark.createDataFrame([("7", "a", 1), ("7", "b", 2), ("8", "none", 3)], "cik_str string, ticker string, ord int")).collect()
    assert [(x.cik, x.ticker) for x in ct] == [("0000000007", "B")]
    runs = spark.createDataFrame([(date(2020, 1, 1), 60, 30, '{"detail": [{"ticker": "A", "excess_return": 1.5}]}')], "run_date date, threshold int, horizon_days int, metrics string")
    assert readers.metric_rows(runs, "detail", "ticker:string,excess_return:double").first().excess_return == 1.5
    lst = readers.listing(spark.createDataFrame([("brk.b",), ("ABC",), ("A1",)], "Symbol string")).select("symbol").collect()
    assert sorted(x.symbol for x in lst) == ["ABC", "BRK-B"]
    screen = spark.createDataFrame([("ABC", "United States", "$1,000"), ("BRK.B", "United States", "5"), ("DEF", "Canada", "5"), ("GHI", "United States", "n/a"), ("abcdef", "United States", "5")], "Symbol string, Country string, marketCap string")
    assert [(x.symbol, x.market_cap) for x in readers.listing(screen, country="United States").collect()] == [("ABC", 1000.0)]
    readers.write_universe(spark.createDataFrame([("b",), ("A",), ("b ",), ("",)], "symbol string"), str(tmp_path / "out"))
    assert [x.value for x in spark.read.text(str(tmp_path / "out")).collect()] == ["A", "B"]
    assert F is not None
