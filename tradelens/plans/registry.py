"""Named queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.functions import columns as C
from tradelens.operators import clusters, cooldown, dedup, event_study, evidence, factors, feeds, history, prices, scoring, tables
from tradelens.plans import views as V
from tradelens.plans.oracle import ORACLE
from tradelens.plans.shared import scratch, stored

AS_OF = "1998-12-31"
ACTOR = ["cik", "insider_name"]
WEIGHTS = {**{f"role_{k}": v for k, v in scoring.RULES.role_points.items()}, **{f"cap_{k}": v for k, v in scoring.RULES.cap_points.items()}, **scoring.RULES.factor_points}


# -- building blocks


def latest(spark: SparkSession, d: str, until: str | None = None) -> DataFrame:
    """Latest amendment of each purchase; the plan filter follows, so an amendment can remove a row.

    ``until``: what was filed later is not known yet.
    """
    return latest_of(V.transactions(spark, d), until)


def latest_of(tx: DataFrame, until: str | None = None) -> DataFrame:
    one = dedup.latest_by_key(tx if until is None else tx.where(F.col("filed_date") <= F.lit(until).cast("date")), [*ACTOR, "transaction_date", "transaction_code"], [F.desc("filed_date"), *V.tie()])
    return one.where("transaction_code = 'P' AND NOT is_10b51")


def scored(spark: SparkSession, d: str, until: str | None = None) -> DataFrame:
    return scored_of(spark, d, V.transactions(spark, d), until)


def scored_of(spark: SparkSession, d: str, tx: DataFrame, until: str | None = None, lows: DataFrame | None = None) -> DataFrame:
    """Latest amendments, earlier purchases, routine months, tiers and lows all keep to one shuffle by company.

    ``lows``: the stored ``prices.year_lows`` of all companies, if there are any.
    """
    rows = history.prior_purchases(latest_of(tx.repartition("cik"), until), ACTOR)
    rows = history.routine_flags(rows, ACTOR)
    rows = rows.join(V.companies(spark, d).select("cik", "cap_tier"), "cik", "left")
    lows = prices.year_lows(V.yearly_bars(spark, d), "cik") if lows is None else lows
    rows = prices.low_from(rows, lows, key="cik").withColumn("low_52wk", F.col("low_52wk") / 100)
    return scoring.score_purchases(rows)


def counted_of(tx: DataFrame, until: str | None = None) -> DataFrame:
    """The rows of ``scored_of`` that are not disqualified, without their scores: no price bar or company is read for them."""
    return history.routine_flags(latest_of(tx.repartition("cik"), until), ACTOR).where(scoring.disqualifier().isNull())


def cluster_table(spark: SparkSession, d: str) -> DataFrame:
    tx = V.transactions(spark, d)
    return clusters.cluster_windows(clusters.members(clusters.work_items(tx), tx, V.tie()))


def all_purchases(spark: SparkSession, d: str) -> DataFrame:
    return stored(purchases(V.transactions(spark, d)), "purchases")


def all_signals(spark: SparkSession, d: str, tx: DataFrame | None = None) -> DataFrame:
    """The signals of all filing days, written once as a table: reports read it several times. ``tx``: the stored purchases."""
    tx = all_purchases(spark, d) if tx is None else tx
    return stored(scoring.one_per_date(signals_of(spark, d, tx, clusters.work_items(tx))), "signals")


def purchases(tx: DataFrame) -> DataFrame:
    """All that signals need of the transactions: items, clusters and scores read it, and the codes of amendments are equal."""
    held = [*ACTOR, "ticker", "role_category", "transaction_date", "filed_date", "transaction_code", "shares", "price_per_share", "total_value", "shares_after", "is_10b51", "is_direct", *V.TIE]
    return tx.where("transaction_code = 'P'").select(*held)


def signals_of(spark: SparkSession, d: str, tx: DataFrame, items: DataFrame, until: str | None = None, lows: DataFrame | None = None) -> DataFrame:
    """One signal for each work item, from the transactions in ``tx``."""
    found = clusters.cluster_windows(clusters.members(items, tx, V.tie()))
    return scoring.signals(items, scored_of(spark, d, tx, until, lows), found, V.tie())


def live(spark: SparkSession, d: str, as_of: str, days: int = 7) -> DataFrame:
    """Signals as of one day: tickers with a purchase filed in the ``days`` before, and only what was filed by then."""
    day = F.lit(as_of).cast("date")
    tx = V.transactions(spark, d).where(F.col("filed_date") <= day)
    items = clusters.work_items(tx.where(F.col("filed_date") >= F.date_sub(day, days))).select("ticker", day.alias("as_of")).distinct()
    return scoring.one_per_date(signals_of(spark, d, tx, items, as_of))


def study(spark: SparkSession, d: str, every: DataFrame | None = None) -> DataFrame:
    """Excess returns of all selected signals at all horizons, written once: summaries read them several times."""
    chosen = event_study.selected(all_signals(spark, d) if every is None else every).withColumn("filed_date", F.col("as_of"))
    entered = event_study.trades(chosen, F.lit(AS_OF).cast("date"))
    return stored(event_study.excess_returns(entered, V.price_bars(spark, d), V.benchmark_bars(spark, d)), "study")


# -- queries


def latest_amendment(spark, d):
    return latest(spark, d).select("ticker", "insider_name", "transaction_date", "filed_date", "value_cents", "shares", "l_orderkey", "l_linenumber")


def routine_flag(spark, d):
    rows = V.transactions(spark, d).where("transaction_code = 'P'")
    return history.routine_flags(rows, ACTOR).select("l_orderkey", "l_linenumber", "ticker", "insider_name", "transaction_date", C.routine_label(F.col("routine")).alias("label"))


def purchase_timing(spark, d):
    return history.prior_purchases(latest(spark, d), ACTOR).select("ticker", "insider_name", "transaction_date", "prior_date", "timing")


def buying_episodes(spark, d):
    return history.buying_episodes(latest(spark, d), ACTOR, value="value_cents")


def cluster_windows(spark, d):
    return cluster_table(spark, d).where("is_cluster")


def event_clusters(spark, d):
    tx = V.event_purchases(V.read(spark, d, "events"))
    found = clusters.members(clusters.work_items(tx), tx, [F.desc("event_id")])
    return clusters.cluster_windows(found).where("is_cluster")


def scored_purchases(spark, d):
    return scored(spark, d).select("ticker", "insider_name", "transaction_date", "disqualifier", "score", F.size("breakdown").alias("n_factors"), "cap_tier", "timing")


def signals_raw(spark, d):
    return all_signals(spark, d).select("ticker", "signal_date", "as_of", "score", "signal_type", "cluster_flag", "tight_cluster", "executive_cluster", "insider_count", "n_purchases", "min_lag")


def signals_cooled(spark, d):
    return cooldown.greedy(all_signals(spark, d)).select("ticker", "signal_date", "score", "signal_type")


def signals_deduped(spark, d):
    return cooldown.two_pass(all_signals(spark, d)).select("ticker", "signal_date", "score", "signal_type")


def late_signals(spark, d):
    """Signals filed after mid-1997 against those stored before, in both directions of time."""
    every = all_signals(spark, d)
    new, old = every.where("as_of >= DATE '1997-07-01'"), every.where("as_of < DATE '1997-07-01'")
    return cooldown.against_stored(new, old).select("ticker", "signal_date", "score", "signal_type")


def insider_rollup(spark, d):
    out = evidence.insider_rollup(latest(spark, d), ["ticker"])
    return out.select("ticker", "insider_name", "shares_bought", F.col("total_value").cast("double").alias("total_value"), F.round("avg_price", 4).alias("avg_price"), "role", "shares_after", "purchase_count", "first_date", "last_date", F.round("pct_increase", 4).alias("pct_increase"))


def asof_returns(spark, d):
    spans = latest(spark, d).select("ticker", F.col("transaction_date").alias("start_date"), F.date_add("transaction_date", 30).alias("end_date")).distinct()
    return prices.as_of_returns(spans, V.price_bars(spark, d)).select("ticker", "start_date", "end_date", "start_close", "end_close", F.round("ret", 4).alias("ret"))


def price_lows(spark, d):
    return prices.trailing_low(V.price_bars(spark, d)).select("ticker", "date", "close", "low", C.near_low(F.col("close"), F.col("low")).alias("near_low"))


def event_study_detail(spark, d):
    return study(spark, d).select("ticker", "signal_date", "horizon", "start_date", "end_date", F.round("ret", 4).alias("ret"), F.round("bench_ret", 4).alias("bench_ret"), "excess")


def event_study_summary(spark, d):
    return event_study.summary(study(spark, d))


def event_study_strata(spark, d):
    return feeds.strata_labels(event_study.strata(study(spark, d)))


def strata_pivot(spark, d):
    return event_study.strata_pivot(event_study.strata(study(spark, d)))


def event_study_report(spark, d):
    rows = study(spark, d)
    return event_study.report_rows(event_study.summary(rows), event_study.risk(rows))


def live_signals(spark, d):
    return live(spark, d, "1997-06-30").select("ticker", "signal_date", "as_of", "score", "signal_type", "cluster_flag", "insider_count", "n_purchases")


def event_study_rolling(spark, d):
    return event_study.rolling_hit_rate(study(spark, d))


def event_study_streak(spark, d):
    return event_study.longest_losing_streak(study(spark, d))


def event_study_risk(spark, d):
    return event_study.risk(study(spark, d))


def event_study_weak_clusters(spark, d):
    weak = event_study.weak_clusters(all_signals(spark, d)).withColumn("filed_date", F.col("as_of"))
    entered = event_study.trades(weak, F.lit(AS_OF).cast("date"))
    rows = stored(event_study.excess_returns(entered, V.price_bars(spark, d), V.benchmark_bars(spark, d), missing=None), "study")
    return event_study.metrics(rows.where("excess IS NOT NULL"), ["horizon"])


def event_study_small_caps(spark, d):
    chosen = event_study.selected(all_signals(spark, d)).where("cap_tier = 'small'").withColumn("filed_date", F.col("as_of"))
    entered = event_study.trades(chosen, F.lit(AS_OF).cast("date"))
    rows = event_study.excess_returns(entered, V.price_bars(spark, d), V.benchmark_bars(spark, d, ("small",)), digits=None)
    v = F.col("excess")
    return rows.where("excess IS NOT NULL").groupBy("horizon").agg(F.count("*").alias("n"), F.round(F.avg(v), 2).alias("avg_return"), F.round(F.avg((v > 0).cast("int") * 100.0), 1).alias("hit_rate"))


def signal_coverage(spark, d):
    return event_study.coverage(event_study.selected(all_signals(spark, d)), F.lit(AS_OF).cast("date"))


def matched(spark, d):
    every = all_signals(spark, d)
    rows = study(spark, d, every).where("excess IS NOT NULL").select("ticker", "start_date", "horizon", "excess", F.concat_ws("|", "ticker", "signal_date", "horizon").alias("row_id"))
    return factors.nearest_signals(rows, every.where("signal_type IN ('BUY', 'CLUSTER_BUY')"))


def factor_lift(spark, d):
    return factors.factor_lift(matched(spark, d), sorted(WEIGHTS))


def score_bands(spark, d):
    return factors.score_bands(matched(spark, d))


def lift_ranking(spark, d):
    return factors.lift_ranking(factor_lift(spark, d), 90).select("place", "factor", "lift")


def weight_advice(spark, d):
    return factors.weight_advice(factor_lift(spark, d), WEIGHTS)


def monthly_excess(spark, d):
    return feeds.monthly_excess(study(spark, d))


def signal_feed(spark, d):
    ranked = feeds.feed(feeds.filtered(all_signals(spark, d), types=["CLUSTER_BUY", "BUY", "WATCH"], tiers=["small", "mid", "unknown"]))
    return ranked.select("ticker", "signal_date", "signal_type", "score", "conviction", "type_rank", "quality")


def signal_headline(spark, d):
    return feeds.headline(all_signals(spark, d))


def top_picks(spark, d):
    return feeds.top_picks(feeds.feed(all_signals(spark, d))).select("ticker", "signal_date", "signal_type", "score", "conviction")


def positions(spark, d):
    own = event_study.selected(all_signals(spark, d))
    near = clusters.join_in_days(own.select("ticker", "as_of"), scored(spark, d).where("disqualifier IS NULL"), "ticker", "as_of", "transaction_date", scoring.RULES.scoring_days).where("filed_date <= as_of")
    rollup = evidence.insider_rollup(near, ["ticker", "as_of"])
    last = prices.quotes(V.price_bars(spark, d)).withColumn("current_price", F.col("current_price") / 100)
    return feeds.positions(own, rollup, last, F.lit(AS_OF).cast("date"))


def entity_history(spark, d):
    rows = history.routine_flags(V.transactions(spark, d).where("transaction_code = 'P'"), ACTOR)
    return feeds.entity_history(rows, V.tie()).select("ticker", "transaction_date", "insider_name", "l_orderkey", "l_linenumber", "value_cents", "routine_label")


def alert_queue(spark, d):
    return feeds.alert_queue(all_signals(spark, d).withColumn("alerted", F.dayofmonth("signal_date") % 2 == 0)).select("ticker", "signal_date", "score", "signal_type")


def daily_summary(spark, d):
    return feeds.daily_summary(all_signals(spark, d).withColumn("alerted", F.dayofmonth("signal_date") % 2 == 0))


def market_caps(spark, d):
    held = V.read(spark, d, "part").select((F.col("p_partkey") % F.lit(1000) + 1).cast("string").alias("cik"), F.when(F.col("p_partkey") % 3 == 0, "dei").when(F.col("p_partkey") % 3 == 1, "us-gaap").otherwise("concept").alias("taxonomy"), F.date_add(F.lit("1998-01-01").cast("date"), F.col("p_size")).alias("end"), (F.col("p_partkey") * 1000).alias("val"))
    last = prices.quotes(V.price_bars(spark, d))
    out = prices.market_caps(V.companies(spark, d).select("cik", "ticker", "name", "market_cap", "cap_tier"), prices.first_known_shares(held), last)
    return out.select("cik", "ticker", "market_cap", "cap_tier")


def cap_tiers(spark, d):
    return V.companies(spark, d).groupBy("cap_tier").agg(F.count("*").alias("n"), F.min("market_cap").alias("least"), F.max("market_cap").alias("most"))


def universe_slice(spark, d):
    listed = V.read(spark, d, "customer").select(F.col("c_name").alias("symbol"), F.round(F.col("c_acctbal") * 100).cast("long").alias("market_cap"))
    small = feeds.cap_rank_slice(listed, 101, 300).select("symbol")
    large = V.read(spark, d, "supplier").select(F.col("s_name").alias("symbol"))
    return small.union(large).distinct()


def upsert_filings(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("accession_number"), F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("filed_date"))
    old, new = o.where("filed_date < DATE '1997-01-01'"), o.where("filed_date >= DATE '1996-06-01'")
    new = new.withColumn("cik", F.col("cik") + 1_000_000)  # told apart from what is stored: stored rows stay as they are
    return tables.insert_new(old, new, ["accession_number"])


def upsert_signals(spark, d):
    every = all_signals(spark, d).select("ticker", "signal_date", "score", "signal_type", (F.dayofmonth("signal_date") % 2 == 0).alias("alerted"))
    old = every.where("signal_date < DATE '1997-01-01'")
    new = every.where("signal_date >= DATE '1996-06-01'").withColumn("score", F.col("score") + 1).withColumn("alerted", F.lit(False))
    return tables.upsert(old, new, ["ticker", "signal_date"], ["score", "signal_type"])


def retention(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("accession_number"), F.to_date("o_orderdate").alias("filed_date"))
    tx = V.transactions(spark, d).select(F.col("l_orderkey").alias("accession_number"), "transaction_date", "value_cents")
    _, kept = tables.retention(o, tx, ["accession_number"], "filed_date", "transaction_date", F.lit("1998-12-01").cast("date"))
    return kept.groupBy("accession_number").agg(F.count("*").alias("n_lines"), F.sum("value_cents").alias("value_cents"))


def fetch_windows(spark, d):
    """Orders per eight-day window, with the capped ones marked."""
    o = V.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("filed_date"))
    return tables.capped_windows(o, "filed_date", F.lit("1992-01-01").cast("date"), cap=50)


def role_class(spark, d):
    title = F.concat_ws(" ", F.when(F.col("p_size") % 5 == 0, "Chief Financial Officer").when(F.col("p_size") % 5 == 1, "CEO").when(F.col("p_size") % 5 == 2, "Board Member").when(F.col("p_size") % 5 == 3, "SVP Sales"), "p_type")
    return V.read(spark, d, "part").select("p_partkey", title.alias("title")).withColumn("role", C.role_category(F.col("title")))


def clean_ticker(spark, d):
    raw = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit(" nasdaq:"), F.lower(F.replace("s_name", F.lit("#"), F.lit(""))))).when(F.col("s_suppkey") % 4 == 1, F.lit(" none ")).when(F.col("s_suppkey") % 4 == 2, F.lit("")).otherwise(F.col("s_name"))
    return V.read(spark, d, "supplier").select("s_suppkey", C.clean_ticker(raw).alias("ticker"), C.padded_cik(F.col("s_suppkey").cast("string")).alias("cik"))


FILING = ["accession_number", "l_orderkey", "cik"]


def filed_lines(spark, d):
    """The lines with the number of their filing: there is one for each order and company."""
    return V.transactions(spark, d).withColumn("accession_number", F.concat_ws("-", "l_orderkey", "cik"))


def documents_of(tx: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` (the company among them) and xml: a filing for each group of lines, under its least owner."""
    return gathered(tx, keys).select(*keys, filing_xml().alias("xml"))


def gathered(tx: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, owner and lines of each filing. Columns are shuffled and sorted; the XML made of them later is ten times as long."""
    held = ["transaction_date", "transaction_code", "is_10b51", "shares", "price_cents", "shares_after", "is_direct"]
    return tx.groupBy(*keys).agg(F.min("insider_name").alias("owner"), F.collect_list(F.struct(*held)).alias("lines"))


def filing_xml() -> Column:
    """The filing in XML of a row with cik, owner and lines."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}><value>"), value.cast("string"), F.lit(f"</value></{name}>"))
    line = lambda t: F.concat(
        F.lit("<nonDerivativeTransaction>"), tag("transactionDate", F.concat(t.transaction_date.cast("string"), F.lit("-05:00"))),
        F.lit("<transactionCoding><transactionFormType>4</transactionFormType><transactionCode>"), t.transaction_code, F.lit("</transactionCode><transactionTimeliness>"), F.when(t.is_10b51, "1").otherwise(""), F.lit("</transactionTimeliness></transactionCoding><transactionAmounts>"),
        tag("transactionShares", t.shares), tag("transactionPricePerShare", t.price_cents), F.when(t.transaction_code == "S", F.lit("<transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode>")).otherwise(""),
        F.lit("</transactionAmounts><postTransactionAmounts>"), tag("sharesOwnedFollowingTransaction", t.shares_after),
        F.lit("</postTransactionAmounts><ownershipNature>"), tag("directOrIndirectOwnership", F.when(t.is_direct, "D").otherwise("I")), F.lit("</ownershipNature></nonDerivativeTransaction>"),
    )
    return F.concat(F.lit("<ownershipDocument><issuer><issuerCik>000"), F.col("cik"), F.lit("</issuerCik><issuerName>n</issuerName><issuerTradingSymbol>NYSE:t"), F.col("cik"), F.lit("</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>"), F.col("owner"), F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>"), F.concat_ws("", F.transform("lines", line)), F.lit("</nonDerivativeTable></ownershipDocument>"))


def parse_xml(spark, d):
    """Documents built from the lines, parsed back."""
    from tradelens.sources import documents

    rows = documents.transactions(documents.parsed(documents_of(filed_lines(spark, d), FILING).select("accession_number", "xml")))
    return rows.groupBy("ticker", "transaction_code", "role_category", "is_direct", "is_10b51", "acquired_disposed").agg(F.count("*").alias("n"), F.sum("shares").cast("long").alias("shares"), F.sum("total_value").cast("long").alias("value_cents"), F.min("transaction_date").alias("first_date"))


def _drained(spark, d, transform, label):
    """Run a stream over the events to its end into a table of the shared folder, and read that."""
    root = scratch(spark, label)
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    out = transform(stream)
    query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def stream_dedup(spark, d):
    """Event ids once within the watermark."""
    from tradelens.streaming import incremental

    return _drained(spark, d, lambda s: incremental.once_per_key(s.withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], "ts").select("event_id", "user_id", "event_type"), "stream-dedup")


def stream_enriched(spark, d):
    """Events of the stream with the company of their ticker, a static table, while they pass."""
    from tradelens.streaming import incremental

    companies = V.companies(spark, d).select(F.concat(F.lit("E"), F.col("cik").cast("long") - 1).alias("ticker"), "name", "cap_tier")
    return _drained(spark, d, lambda s: incremental.enriched(V.event_purchases(s), companies).select("event_id", "ticker", "name", "cap_tier"), "stream-enriched")


def sliding_buyers(spark, d):
    """Distinct buyers in windows of 15 days that slide by one: the batch twin of the stream."""
    from tradelens.streaming import incremental

    return incremental.sliding_buyers(V.event_purchases(V.read(spark, d, "events")))


NAMES = [
    latest_amendment, routine_flag, purchase_timing, buying_episodes, cluster_windows, event_clusters, scored_purchases, signals_raw, signals_cooled, signals_deduped, late_signals,
    insider_rollup, asof_returns, price_lows, event_study_detail, event_study_summary, event_study_strata, event_study_rolling, event_study_streak, event_study_risk, event_study_weak_clusters,
    event_study_small_caps, signal_coverage, factor_lift, score_bands, weight_advice, monthly_excess, signal_feed, signal_headline, top_picks, positions, entity_history, alert_queue, daily_summary,
    market_caps, cap_tiers, universe_slice, upsert_filings, upsert_signals, retention, fetch_windows, role_class, clean_ticker, parse_xml, stream_dedup, sliding_buyers, strata_pivot, event_study_report, live_signals, lift_ranking, stream_enriched,
]


def queries() -> dict:
    from tradelens.plans import landed, runs, streams, upkeep

    return {f.__name__: f for f in [*NAMES, *upkeep.NAMES, *streams.NAMES, *runs.NAMES, *landed.NAMES]}


def oracle_sql() -> dict[str, str]:
    from tradelens.plans import landed, runs, streams, upkeep

    return ORACLE | upkeep.ORACLE | streams.ORACLE_STREAMS | runs.ORACLE_RUNS | landed.ORACLE_LANDED
