"""Named queries of landing and upkeep: ingest, listings, table maintenance, evidence; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelens.operators import clusters, dedup, evidence, feeds, history, prices, scoring, tables
from tradelens.plans import registry
from tradelens.plans import views as V
from tradelens.plans.oracle import LATEST, SIGNALS, WITH, _MONTHS, _ROUTINE
from tradelens.plans.shared import scratch, stored
from tradelens.plans.views import SQL_COMPANIES
from tradelens.sources import readers
from tradelens.sources.ingest import ingest


def _index(spark, d):
    """The filings of an index, in the nested shape of its pages: one page of records for each order."""
    tx = V.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    orders = V.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("filed"))
    text = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    source = F.struct(
        F.array(text("000", F.col("l_orderkey") % 20), F.lpad(F.col("l_suppkey").cast("string"), 10, "0")).alias("ciks"),
        F.array(F.lit("Owner"), text("Company ", F.col("l_suppkey"), "  (CIK ", F.col("l_suppkey"), ")")).alias("display_names"),
        F.col("filed").alias("file_date"), F.lit("none").alias("period_ending"), F.when(F.col("l_orderkey") % 10 == 0, "4/A").otherwise("4").alias("form"),
    )
    hit = F.struct(text(F.col("l_orderkey"), "-", F.col("l_suppkey"), ":doc.xml").alias("_id"), source.alias("_source"))
    rows = tx.join(orders, tx.l_orderkey == orders.o_orderkey).select("l_orderkey", hit.alias("hit"))
    return rows.groupBy("l_orderkey").agg(F.struct(F.collect_list("hit").alias("hits")).alias("hits"))


def _ingested(spark, d):
    """Filings from 1995 on of two companies in three; some documents are missing, cut off or without lines."""
    index = readers.filing_index(_index(spark, d))
    pages = [index.where(F.col("form") == form) for form in ("4", "4/A")]
    listed = V.read(spark, d, "supplier")
    ciks = readers.cik_tickers(listed.select(F.col("s_suppkey").cast("string").alias("cik_str"), F.concat(F.lit(" t"), F.col("s_suppkey").cast("string")).alias("ticker"), F.lit(1).alias("ord")))
    universe = readers.universe(listed.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("value")))
    k = F.col("l_orderkey")
    bare = F.concat(F.lit("<ownershipDocument><issuer><issuerCik>"), F.col("cik"), F.lit("</issuerCik></issuer><derivativeTable></derivativeTable></ownershipDocument>"))
    tx = registry.filed_lines(spark, d).repartition("accession_number")  # the key that ingest joins by: lines are shuffled, not documents
    docs = registry.documents_of(tx, registry.FILING).select("accession_number", F.when(k % 11 == 0, "").when(k % 13 == 0, F.substring("xml", 1, 60)).when(k % 17 == 0, bare).otherwise(F.col("xml")).alias("xml"))
    known = index.where("filed_date < DATE '1995-01-01'").select("accession_number")
    return ingest(pages, ciks, docs, universe, known)


def ingest_outcomes(spark, d):
    return _ingested(spark, d).outcomes


def ingest_filings(spark, d):
    return _ingested(spark, d).filings.select("accession_number", "cik", "filed_date", "form")


def ingest_companies(spark, d):
    return _ingested(spark, d).companies


def ingest_transactions(spark, d):
    return _ingested(spark, d).transactions.groupBy("accession_number", "transaction_code", "is_10b51").agg(F.count("*").alias("n"), F.sum("shares").cast("long").alias("shares"))


def _screen(spark, d):
    symbol = F.translate(F.col("c_custkey").cast("string"), "0123456789", "ABCDEFGHIJ")
    country = F.when(F.col("c_nationkey") % 3 == 0, "Elsewhere").otherwise(" United States ")
    cap = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.round(F.col("c_acctbal") * 100).cast("long").cast("string")))
    return V.read(spark, d, "customer").select(symbol.alias("Symbol"), country.alias("Country"), cap.alias("marketCap"))


def universe_listing(spark, d):
    """A screener's rows: valid symbols of one country with a value above 0."""
    return readers.listing(_screen(spark, d), country="United States").select("symbol", "market_cap")


def universe_file(spark, d):
    """The universe as it is written: in order, a symbol to a line."""
    path = scratch(spark, "universe")
    readers.write_universe(readers.listing(_screen(spark, d), country="United States"), path)
    return spark.read.text(path).select(F.col("value").alias("symbol"))


def upsert_companies(spark, d):
    """Companies anew: names overwrite, market values fill."""
    own = V.companies(spark, d).select("cik", "name", F.when(F.col("cik").cast("long") % 4 == 0, F.lit(None)).otherwise(F.col("market_cap")).alias("market_cap"))
    key = F.col("cik").cast("long")
    new = V.companies(spark, d).where(key % 2 == 0).select("cik", F.concat("name", F.lit(" Inc")).alias("name"), F.when(key % 8 == 0, F.lit(None)).otherwise(F.lit(5)).cast("long").alias("market_cap"))
    return tables.upsert(own.where(key % 5 != 0), new, ["cik"], ["name"], ["market_cap"])


def mark_alerted(spark, d):
    every = registry.all_signals(spark, d).select("ticker", "signal_date", F.when(F.dayofmonth("signal_date") % 3 == 0, True).alias("alerted"))
    sent = every.where(F.dayofmonth("signal_date") % 5 == 0)
    return tables.mark(every, sent, ["ticker", "signal_date"], "alerted")


def replace_run(spark, d):
    """Two runs stored, the second of them again with other values: it stands alone."""
    path = scratch(spark, "runs")
    o = V.read(spark, d, "orders").select((F.col("o_custkey") % 3).alias("run"), F.lit(60).alias("threshold"), F.col("o_orderkey").alias("k"))
    tables.replace_partitions(o, path, ["run", "threshold"])
    tables.replace_partitions(o.where("run = 1 AND k % 2 = 0").withColumn("k", -F.col("k")), path, ["run", "threshold"])
    return spark.read.parquet(path).select(F.col("run").cast("long").alias("run"), "k")


def backfill_routine(spark, d):
    """Stored flags stay, missing ones are filled where history tells."""
    rows = V.transactions(spark, d).where("transaction_code = 'P' AND NOT is_10b51").withColumn("is_routine", F.when(F.col("l_linenumber") == 1, F.lit(True)))
    return history.fill_routine(rows, registry.ACTOR).select("l_orderkey", "l_linenumber", "ticker", "insider_name", "transaction_date", F.coalesce(F.col("is_routine").cast("string"), F.lit("unknown")).alias("flag"))


def alert_outbox(spark, d):
    """Cluster alerts that are neither flagged nor in the table of sent ones."""
    every = registry.all_signals(spark, d).withColumn("alerted", F.dayofmonth("signal_date") % 2 == 0)
    sent = every.where(F.dayofmonth("signal_date") % 3 == 0).select("ticker", "signal_date")
    return feeds.outbox(every, sent).select("ticker", "signal_date", "score")


def signal_evidence(spark, d):
    """The people of each cluster signal: those of the scoring window, then earlier members of the cluster."""
    tx = registry.all_purchases(spark, d)
    rows = registry.all_signals(spark, d, tx).where("signal_type = 'CLUSTER_BUY'")
    near = clusters.join_in_days(rows.select("ticker", "as_of"), registry.counted_of(tx), "ticker", "as_of", "transaction_date", scoring.RULES.scoring_days).where("filed_date <= as_of")
    members = clusters.members(rows.select("ticker", "as_of"), tx, V.tie())
    cited = spark.createDataFrame([("role_cfo", "a"), ("cap_small", "b"), ("prior_purchase_31_365d", "c")], "factor string, citation string")
    full = evidence.evidence(rows, evidence.insider_rollup(near, ["ticker", "as_of"]), members, cited)
    people = full.select("ticker", "signal_date", F.coalesce(F.array_join("research_basis", ""), F.lit("")).alias("basis"), F.explode_outer("insiders").alias("i"))
    return people.select("ticker", "signal_date", "basis", F.col("i.name").alias("name"), F.col("i.role").alias("role"), F.col("i.in_scoring_window").alias("scored"), F.col("i.purchase_count").alias("purchases"), F.col("i.total_value").cast("double").alias("value"))


def purchase_points(spark, d):
    """Chart points from text: a price that is no number goes, missing shares are 0."""
    tx = V.transactions(spark, d).where("transaction_code = 'P'")
    raw = tx.select("ticker", "transaction_date", "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("price_cents").cast("string")).alias("price_per_share"), F.when(F.col("l_linenumber") == 2, F.lit(None)).otherwise(F.col("shares").cast("string")).alias("shares"))
    return feeds.purchase_points(raw).select("ticker", "transaction_date", "l_orderkey", "l_linenumber", "price", "size")


def high_water_mark(spark, d):
    return dedup.high_water_mark(V.transactions(spark, d), "filed_date")


def prior_signals(spark, d):
    """The latest signal of each ticker before mid-1997, with its company."""
    before = registry.all_signals(spark, d).where("signal_date < DATE '1997-07-01'")
    last = dedup.latest_by_key(before, ["ticker"], [F.desc("signal_date")])
    twice = V.companies(spark, d).withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    older = twice.withColumn("name", F.lit("old")).withColumn("updated_at", F.lit(None).cast("timestamp"))
    return last.join(feeds.one_per_ticker(twice.unionByName(older)), "ticker", "left").select("ticker", "signal_date", "score", "name")


def share_series(spark, d):
    """Latest value of the admitted forms per company, from a concept's series."""
    p = V.read(spark, d, "part")
    form = F.element_at(F.array(*[F.lit(x) for x in ("10-K", "8-K", "10-Q/A")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    series = p.select((F.col("p_partkey") % 50).cast("string").alias("cik"), form.alias("form"), F.date_add(F.lit("2019-01-01").cast("date"), F.col("p_size")).alias("end"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") * 10).alias("val"))
    return prices.latest_shares(series)


def share_frames(spark, d):
    """Bulk frames, nested, to rows."""
    p = V.read(spark, d, "part")
    row = F.struct((F.col("p_partkey") % 50).alias("cik"), F.date_add(F.lit("2019-01-01").cast("date"), F.col("p_size")).cast("string").alias("end"), F.col("p_partkey").alias("val"))
    frames = p.groupBy(F.concat(F.lit("F"), (F.col("p_size") % 4).cast("string")).alias("period")).agg(F.collect_list(row).alias("data")).withColumn("taxonomy", F.lit("dei"))
    return readers.share_frames(frames).select("cik", "taxonomy", "period", "end", "val")


def price_arrays(spark, d):
    """Bars landed as parallel arrays of seconds and closes."""
    bars = V.price_bars(spark, d)
    close = F.when(F.dayofmonth("date") != 13, F.col("close"))
    pair = F.array_sort(F.collect_list(F.struct((F.unix_date("date").cast("long") * 86400).alias("t"), close.alias("c"))))
    raw = bars.groupBy("ticker").agg(pair.alias("p")).select("ticker", F.transform("p", lambda x: x.t).alias("timestamp"), F.transform("p", lambda x: x.c).alias("close"))
    return readers.price_bars(raw)


def run_metrics(spark, d):
    """Rows of a list in the JSON metrics of stored runs."""
    rows = V.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("run_date"), F.struct(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("ticker"), F.col("o_custkey").alias("excess_return")).alias("r"))
    runs = rows.groupBy("run_date").agg(F.to_json(F.struct(F.collect_list("r").alias("detail"))).alias("metrics")).select("run_date", F.lit(60).alias("threshold"), F.lit(30).alias("horizon_days"), "metrics")
    return readers.metric_rows(runs, "detail", "ticker:string,excess_return:bigint").select("run_date", "ticker", "excess_return")


def filter_contains(spark, d):
    """Rows whose column holds a text, whatever its case; nulls never match."""
    c = V.read(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    return feeds.contains(c, "c_mktsegment", "BuIlD").select("c_custkey", "c_mktsegment")


def column_filters(spark, d):
    """Which columns a filter lists, and which it searches."""
    return feeds.facets(V.read(spark, d, "customer").select("c_name", "c_mktsegment", "c_nationkey")).select("column", "filter")


NAMES = [
    ingest_outcomes, ingest_filings, ingest_companies, ingest_transactions, universe_listing, universe_file, upsert_companies, mark_alerted, replace_run, backfill_routine, alert_outbox,
    signal_evidence, purchase_points, high_water_mark, prior_signals, share_series, share_frames, price_arrays, run_metrics, filter_contains, column_filters,
]

_FRESH = f"""{WITH}, fresh AS (
  SELECT *, CASE WHEN l_orderkey % 11 = 0 THEN 'xml_missing' WHEN l_orderkey % 13 = 0 THEN 'parse_error' WHEN l_orderkey % 17 = 0 THEN 'deriv_only' ELSE 'ok' END AS outcome
  FROM (SELECT tx.*, CAST(o.o_orderdate AS DATE) AS order_date, tx.l_orderkey || '-' || tx.cik AS accession_number FROM tx JOIN orders o ON o.o_orderkey = tx.l_orderkey)
  WHERE CAST(cik AS BIGINT) % 3 <> 0 AND order_date >= DATE '1995-01-01'
)"""
_SCREEN = """WITH s AS (
  SELECT translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS symbol, CASE WHEN c_custkey % 7 <> 0 THEN CAST(round(c_acctbal * 100) AS DOUBLE) ELSE 0 END AS market_cap FROM customer WHERE c_nationkey % 3 <> 0
), listed AS (SELECT * FROM s WHERE market_cap > 0 AND length(symbol) <= 5)"""
ORACLE = {
    "ingest_outcomes": f"{_FRESH} SELECT outcome, count(DISTINCT accession_number) AS n FROM fresh GROUP BY outcome",
    "ingest_filings": f"{_FRESH} SELECT DISTINCT accession_number, cik, order_date AS filed_date, CASE WHEN l_orderkey % 10 = 0 THEN '4/A' ELSE '4' END AS form FROM fresh WHERE outcome = 'ok'",
    "ingest_companies": f"{_FRESH} SELECT DISTINCT cik, 'T' || cik AS ticker, 'n' AS name FROM fresh WHERE outcome = 'ok'",
    "ingest_transactions": f"{_FRESH} SELECT accession_number, transaction_code, is_10b51, count(*) AS n, CAST(sum(shares) AS BIGINT) AS shares FROM fresh WHERE outcome = 'ok' GROUP BY ALL",
    "universe_listing": f"{_SCREEN} SELECT symbol, market_cap FROM listed",
    "universe_file": f"{_SCREEN} SELECT DISTINCT symbol FROM listed",
    "upsert_companies": f"""WITH {SQL_COMPANIES}, k AS (SELECT *, CAST(cik AS BIGINT) AS key FROM companies),
o AS (SELECT cik, name, CASE WHEN key % 4 = 0 THEN NULL ELSE market_cap END AS market_cap FROM k WHERE key % 5 <> 0), n AS (SELECT cik, name || ' Inc' AS name, CASE WHEN key % 8 = 0 THEN NULL ELSE 5 END AS market_cap FROM k WHERE key % 2 = 0)
SELECT coalesce(o.cik, n.cik) AS cik, coalesce(n.name, o.name) AS name, CAST(coalesce(n.market_cap, o.market_cap) AS BIGINT) AS market_cap FROM o FULL JOIN n ON o.cik = n.cik""",
    "mark_alerted": f"{SIGNALS} SELECT ticker, signal_date, day(signal_date) % 3 = 0 OR day(signal_date) % 5 = 0 AS alerted FROM signals",
    "replace_run": "SELECT o_custkey % 3 AS run, CASE WHEN o_custkey % 3 = 1 THEN -o_orderkey ELSE o_orderkey END AS k FROM orders WHERE o_custkey % 3 <> 1 OR o_orderkey % 2 = 0",
    "backfill_routine": f"""{WITH}, {_MONTHS.replace("FROM tx WHERE transaction_code = 'P'", "FROM tx WHERE transaction_code = 'P' AND NOT is_10b51")},
r AS (SELECT t.*, {_ROUTINE} AS routine FROM tx t JOIN firsts f ON f.cik = t.cik AND f.insider_name = t.insider_name WHERE t.transaction_code = 'P' AND NOT t.is_10b51)
SELECT l_orderkey, l_linenumber, ticker, insider_name, transaction_date, CASE WHEN l_linenumber = 1 OR routine THEN 'true' WHEN NOT routine THEN 'false' ELSE 'unknown' END AS flag FROM r""",
    "alert_outbox": f"{SIGNALS} SELECT ticker, signal_date, score FROM signals WHERE signal_type = 'CLUSTER_BUY' AND day(signal_date) % 2 <> 0 AND day(signal_date) % 3 <> 0",
    "signal_evidence": f"""{SIGNALS}, own AS (SELECT * FROM signals WHERE signal_type = 'CLUSTER_BUY'),
people AS (
  SELECT w.ticker, w.as_of, insider_name AS name, arg_min(role_category, CASE role_category WHEN 'cfo' THEN 1 WHEN 'ceo' THEN 2 WHEN 'chairman' THEN 3 WHEN 'director' THEN 4 WHEN 'coo' THEN 5 WHEN 'officer' THEN 6 ELSE 7 END) AS role, TRUE AS scored, count(*) AS purchases, CAST(sum(total_value) AS DOUBLE) AS value
  FROM win w WHERE disqualifier IS NULL GROUP BY ALL
),
every AS (
  SELECT * FROM people UNION ALL
  SELECT m.ticker, m.as_of, m.insider_name, m.role_category, FALSE, 1, CAST(m.total_value AS DOUBLE) FROM members m WHERE NOT EXISTS (SELECT 1 FROM people p WHERE p.ticker = m.ticker AND p.as_of = m.as_of AND p.name = m.insider_name)
)
SELECT s.ticker, s.signal_date, CASE WHEN s.b_role = 'cfo' THEN 'a' ELSE '' END || CASE WHEN s.best_order IS NOT NULL AND s.cap_tier = 'small' THEN 'b' ELSE '' END || CASE WHEN s.b_timing = 'prior_purchase_31_365d' THEN 'c' ELSE '' END AS basis, name, role, scored, purchases, value
FROM own s LEFT JOIN every e ON e.ticker = s.ticker AND e.as_of = s.as_of""",
    "purchase_points": f"{WITH} SELECT ticker, transaction_date, l_orderkey, l_linenumber, CAST(price_cents AS DOUBLE) AS price, CASE WHEN l_linenumber = 2 THEN 0.0 ELSE CAST(shares AS DOUBLE) END AS size FROM tx WHERE transaction_code = 'P' AND l_linenumber <> 3",
    "high_water_mark": f"{WITH} SELECT max(filed_date) AS filed_date FROM tx",
    "prior_signals": f"{SIGNALS}, b AS (SELECT ticker, max(signal_date) AS signal_date, arg_max(score, signal_date) AS score FROM signals WHERE signal_date < DATE '1997-07-01' GROUP BY ticker) SELECT b.ticker, signal_date, score, name FROM b LEFT JOIN companies c ON c.ticker = b.ticker",
    "share_series": "WITH s AS (SELECT CAST(p_partkey % 50 AS VARCHAR) AS cik, DATE '2019-01-01' + p_size AS e, p_partkey * 10 AS val FROM part WHERE p_partkey % 3 <> 1 AND p_partkey % 7 <> 0) SELECT cik, val AS shares FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY e DESC, val DESC) AS k FROM s) WHERE k = 1",
    "share_frames": "SELECT lpad(CAST(p_partkey % 50 AS VARCHAR), 10, '0') AS cik, 'dei' AS taxonomy, 'F' || CAST(p_size % 4 AS VARCHAR) AS period, DATE '2019-01-01' + p_size AS \"end\", p_partkey AS val FROM part",
    "price_arrays": f"WITH {V.SQL_BARS} SELECT ticker, date, close FROM bars WHERE day(date) <> 13",
    "run_metrics": "SELECT CAST(o_orderdate AS DATE) AS run_date, 'O' || CAST(o_orderkey AS VARCHAR) AS ticker, o_custkey AS excess_return FROM orders",
    "filter_contains": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0 AND lower(c_mktsegment) LIKE '%build%'",
    "column_filters": "SELECT 'c_name' AS \"column\", 'contains' AS filter UNION ALL SELECT 'c_mktsegment', CASE WHEN (SELECT count(DISTINCT c_mktsegment) FROM customer) <= 12 THEN 'members' ELSE 'contains' END UNION ALL SELECT 'c_nationkey', CASE WHEN (SELECT count(DISTINCT c_nationkey) FROM customer) <= 12 THEN 'members' ELSE 'contains' END",
}
