"""Driver queries of the engine's operators and the SQL that says what they must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CARD_SLIP_WORDS, LinkSettings
from ..functions import dates, money, text
from ..operators import classify, consensus, layout, linkage, raster, records, review, rows
from ..operators.components import connected_components
from ..operators.lineage import shared_folder, spread, tasks_for
from ..streaming import groups, links
from .synthetic import DRAWN_SQL, EVENT_RECORDS_SQL, ORDER_RECORDS_SQL, PIECED_SQL, RECEIPTS_SQL, dated_records, drawn_lines, drawn_pages, event_records, order_amounts, order_records, pieced_lines, receipt_rows, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


# --- linkage -----------------------------------------------------------------

_PAIRS = f"""
r AS ({EVENT_RECORDS_SQL}),
p AS (SELECT a.ord AS a, b.ord AS b, a.cents AS ca, b.cents AS cb, a.kind <> b.kind AS cross_kind, a.kind AS ka, abs(date_diff('day', a.d, b.d)) AS gap
      FROM r a JOIN r b ON a.batch_id = b.batch_id AND a.ord < b.ord),
q AS (SELECT *, CASE WHEN ka = 'invoice' THEN ca ELSE cb END AS inv, CASE WHEN ka = 'invoice' THEN cb ELSE ca END AS slip FROM p),
v AS (SELECT a, b, coalesce(gap, -1) AS gap,
        CASE WHEN abs(ca - cb) <= 1 THEN CASE WHEN gap <= 0 THEN 'dup' WHEN gap IS NULL THEN CASE WHEN cross_kind THEN 'dup' ELSE 'suspect' END WHEN cross_kind AND gap <= 3 THEN 'suspect_gap' END
             WHEN cross_kind AND inv < slip AND slip * 100 <= inv * 135 THEN CASE WHEN gap <= 0 THEN 'dup' WHEN gap <= 3 THEN 'suspect_gap' END END AS verdict FROM q)
"""
_EDGES = "e AS (SELECT a, b FROM v WHERE verdict = 'dup' UNION ALL SELECT b, a FROM v WHERE verdict = 'dup')"
_REACH = "w AS (SELECT ord AS node, ord AS here FROM r UNION SELECT w.node, e.b FROM w JOIN e ON w.here = e.a), c AS (SELECT node, min(here) AS component FROM w GROUP BY node)"


@query(f"WITH {_PAIRS} SELECT a, b, verdict, CAST(gap AS INTEGER) AS gap FROM v WHERE verdict IS NOT NULL")
def link_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link_pairs(event_records(spark, sf_dir), 0, "ord", ["batch_id"])


@query(
    """SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id
    AND abs(CAST(round(a.value * 100) AS BIGINT) - CAST(round(b.value * 100) AS BIGINT)) <= 1 AND abs(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE))) <= 3"""
)
def link_pairs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What is one transaction at a tolerance of three days.
    return linkage.link_pairs(dated_records(spark, sf_dir), 3, "ord", ["batch_id"]).where("verdict = 'dup'").select("a", "b")


@query(
    """WITH RECURSIVE p AS (SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id
    AND abs(CAST(round(a.value * 100) AS BIGINT) - CAST(round(b.value * 100) AS BIGINT)) <= 1 AND abs(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE))) <= 3),
    w AS (SELECT event_id AS node, event_id AS here FROM events UNION SELECT w.node, p.b FROM w JOIN p ON w.here = p.a),
    c AS (SELECT node, min(here) AS component FROM w GROUP BY node)
    SELECT component, count(*) AS members, round(max(value), 2) AS best_value, min(event_id) AS survivor FROM c JOIN events ON node = event_id GROUP BY component"""
)
def link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("d"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    groups = connected_components(linkage.near_equal(amounts, 3, "event_id", "cents", "d", ["user_id"]))
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return (
        e.join(groups, e.event_id == groups.node, "left")
        .groupBy(F.coalesce("component", "event_id").alias("component"))
        .agg(F.count(F.lit(1)).alias("members"), F.round(F.max("value"), 2).alias("best_value"), F.min("event_id").alias("survivor"))
    )


@query(
    """WITH RECURSIVE o AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate AS d, CASE WHEN o_custkey % 2 = 0 THEN 'invoice' ELSE 'card_slip' END AS kind FROM orders),
    p AS (SELECT a.k AS a, b.k AS b FROM o a JOIN o b ON a.d = b.d AND a.k <> b.k
      WHERE abs(a.cents - b.cents) <= 1 OR (a.kind <> b.kind AND greatest(a.cents, b.cents) * 100 <= least(a.cents, b.cents) * 135 AND (a.cents < b.cents) = (a.kind = 'invoice'))),
    w AS (SELECT k AS node, k AS here FROM o UNION SELECT w.node, p.b FROM w JOIN p ON w.here = p.a)
    SELECT node AS ord, min(here) AS component FROM w GROUP BY node"""
)
def transactions_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of odd customers as slips of the others' bills, without a scope: all that fall on one day may be joined by tips."""
    kind = F.when(F.col("batch_id") % 2 == 0, "invoice").otherwise("card_slip")
    found = linkage.transactions(order_amounts(spark, sf_dir).withColumn("doc_kind", kind))
    return found.select(F.col("id").alias("ord"), "component")


_SURVIVORS = f"""
WITH RECURSIVE {_PAIRS}, {_EDGES}, {_REACH},
s AS (SELECT DISTINCT x.node FROM (SELECT a AS node, b AS peer FROM v WHERE verdict LIKE 'suspect%' UNION ALL SELECT b, a FROM v WHERE verdict LIKE 'suspect%') x
      JOIN c c1 ON c1.node = x.node JOIN c c2 ON c2.node = x.peer WHERE c1.component <> c2.component),
m AS (SELECT r.*, c.component, CASE WHEN s.node IS NOT NULL AND confidence <> 'low' THEN 'medium' ELSE confidence END AS conf
      FROM r JOIN c ON c.node = r.ord LEFT JOIN s ON s.node = r.ord),
k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY CASE kind WHEN 'invoice' THEN 0 ELSE 1 END, type_rank, CASE conf WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE WHEN d IS NULL THEN 0 ELSE -1 END, ord) AS place FROM m),
g AS (SELECT component, count(*) AS members, max(cents) AS best, max(cents) - min(cents) AS spread, bool_or(kind = 'invoice') AND bool_or(kind = 'card_slip') AS verified,
      arg_min(d, place) FILTER (kind = 'card_slip' AND d IS NOT NULL) AS slip_date FROM k GROUP BY component)
"""


@query(
    _SURVIVORS
    + """SELECT ord, component, CAST(best AS DOUBLE) / 100 AS total, members > 1 AND verified AS slip_verified,
    CASE WHEN members > 1 AND verified AND spread <= 1 THEN 'high' ELSE conf END AS confidence,
    CAST(CASE WHEN members > 1 AND kind <> 'card_slip' AND slip_date IS NOT NULL THEN slip_date ELSE d END AS VARCHAR) AS invoice_date
    FROM k JOIN g USING (component) WHERE place = 1"""
)
def dedup_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linkage.deduplicate(event_records(spark, sf_dir), LinkSettings(), ["batch_id"])
    return done.select("ord", "component", F.col("total_incl_tax").cast("double").alias("total"), "slip_verified", "confidence", "invoice_date")


@query(
    _SURVIVORS
    + """SELECT ord, component, place = 1 AS is_primary,
    CASE WHEN members > 1 AND place > 1 THEN 'low' WHEN members > 1 AND verified AND spread <= 1 THEN 'high' ELSE conf END AS confidence FROM k JOIN g USING (component)"""
)
def dedup_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linkage.deduplicate(event_records(spark, sf_dir), LinkSettings(mode="mark"), ["batch_id"])
    return done.select("ord", "component", "is_primary", "confidence")


@query(
    f"""WITH {_PAIRS}, x AS (SELECT a AS ord, verdict FROM v WHERE verdict LIKE 'suspect%' UNION ALL SELECT b, verdict FROM v WHERE verdict LIKE 'suspect%')
    SELECT ord, count(*) AS suspects, string_agg(verdict, ',' ORDER BY verdict) AS verdicts FROM x GROUP BY ord"""
)
def notes_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = linkage.link_pairs(event_records(spark, sf_dir), 0, "ord", ["batch_id"]).where("verdict like 'suspect%'")
    both = pairs.select(F.col("a").alias("ord"), "verdict").unionByName(pairs.select(F.col("b").alias("ord"), "verdict"))
    return both.groupBy("ord").agg(F.count(F.lit(1)).alias("suspects"), F.array_join(F.array_sort(F.collect_list("verdict")), ",").alias("verdicts"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
    SELECT a.k AS a, b.k AS b FROM o a JOIN o b ON a.k < b.k AND b.cents BETWEEN a.cents - 1 AND a.cents + 1"""
)
def amount_near_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Without dates an equal amount is all there is to suspect.
    return linkage.link_pairs(order_amounts(spark, sf_dir, dated=False), 0, "ord").where("verdict = 'suspect'").select("a", "b")


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
    SELECT a.k AS invoice, b.k AS slip, abs(date_diff('day', a.d, b.d)) AS gap FROM o a JOIN o b ON a.c = b.c AND a.k <> b.k AND abs(date_diff('day', a.d, b.d)) <= 3 AND a.cents < b.cents AND b.cents * 100 <= a.cents * 135"""
)
def link_pairs_orders_tip(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every order is an invoice (even number) and a slip (odd number).
    invoices = order_amounts(spark, sf_dir).withColumn("ord", F.col("ord") * 2)
    slips = order_amounts(spark, sf_dir, "card_slip").withColumn("ord", F.col("ord") * 2 + 1)
    pairs = linkage.link_pairs(invoices.unionByName(slips), 0, "ord", ["batch_id"]).where("a % 2 <> b % 2")
    invoice, slip = F.when(F.col("a") % 2 == 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("a") % 2 == 0, F.col("b")).otherwise(F.col("a"))
    told = pairs.select(F.floor(invoice / 2).alias("invoice"), F.floor(slip / 2).alias("slip"), F.col("gap").cast("long").alias("gap")).where("invoice <> slip")
    cents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    both = told.join(cents.toDF("invoice", "ci"), "invoice").join(cents.toDF("slip", "cs"), "slip")
    return both.where("ci < cs").select("invoice", "slip", "gap")


@query(
    f"""WITH {_PAIRS} SELECT verdict, gap, count(*) AS n, CAST(sum(slip - inv) AS DOUBLE) / 100 AS tips FROM
    (SELECT a, b, coalesce(gap, -1) AS gap, inv, slip, CASE WHEN gap <= 0 THEN 'dup' WHEN gap <= 3 THEN 'suspect_gap' END AS verdict FROM q WHERE abs(ca - cb) > 1 AND cross_kind AND inv < slip AND slip * 100 <= inv * 135)
    WHERE verdict IS NOT NULL GROUP BY ALL"""
)
def link_pairs_tip_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card payments with a tip: unequal amounts of different kinds, by verdict and days apart."""
    r = event_records(spark, sf_dir)
    of = r.select("ord", "doc_kind", F.round(F.col("total_incl_tax") * 100).cast("long").alias("cents"))
    pairs = linkage.link_pairs(r, 0, "ord", ["batch_id"]).join(of.toDF("a", "ka", "ca"), "a").join(of.toDF("b", "kb", "cb"), "b").where("abs(ca - cb) > 1")
    tip = F.when(F.col("ka") == "invoice", F.col("cb") - F.col("ca")).otherwise(F.col("ca") - F.col("cb"))
    return pairs.groupBy("verdict", F.col("gap").cast("long").alias("gap")).agg(F.count(F.lit(1)).alias("n"), (F.sum(tip).cast("double") / 100).alias("tips"))


@query(_SURVIVORS + "SELECT ord, s.node IS NOT NULL AS suspected, CASE WHEN s.node IS NOT NULL AND confidence <> 'low' THEN 'medium' ELSE confidence END AS confidence FROM r LEFT JOIN s ON s.node = r.ord JOIN c ON c.node = r.ord JOIN (SELECT component FROM c GROUP BY 1 HAVING count(*) = 1) USING (component)")
def suspect_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which records are alone in their group but suspected, and what that does to their confidence."""
    done = linkage.deduplicate(event_records(spark, sf_dir), LinkSettings(mode="mark"), ["batch_id"])
    alone = done.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return done.join(alone, "component").select("ord", F.exists("notes", lambda n: n.startswith("suspect")).alias("suspected"), "confidence")


@query(
    """SELECT o_custkey, o_orderkey AS survivor FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey % 3, o_orderkey) AS place FROM orders) WHERE place = 1"""
)
def survivor_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    fields = {c: F.lit(None).cast("string") for c in ("subtotal", "tax", "tip", "invoice_date")}
    shown = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.col("o_orderkey").alias("ord"),
        F.lit("invoice").alias("doc_kind"),
        F.when(status == "F", "vat").when(status == "O", "western").otherwise("unknown").alias("invoice_type"),
        F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("confidence"),
    )
    return shown.withColumns(fields).groupBy("o_custkey").agg(F.min_by("ord", linkage.priority()).alias("survivor"))


# --- consensus ---------------------------------------------------------------


@query(
    f"""WITH r AS ({ORDER_RECORDS_SQL}), n AS (SELECT batch_id, left(invoice_date, 4) AS y, count(*) AS n FROM r WHERE invoice_date IS NOT NULL GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, y) AS place, sum(n) OVER (PARTITION BY batch_id) AS all_n FROM n)
    SELECT batch_id, y AS modal_year, n AS votes, CAST(all_n AS BIGINT) AS dated FROM m WHERE place = 1"""
)
def mode_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = order_records(spark, sf_dir).withColumn("year", F.substring("invoice_date", 1, 4))
    return consensus.modal(r, ["batch_id"], "year", "modal_year").select("batch_id", "modal_year", F.col("modal_year_count").alias("votes"), F.col("modal_year_of").alias("dated"))


@query(
    f"""WITH r AS ({ORDER_RECORDS_SQL}), n AS (SELECT batch_id, left(invoice_date, 4) AS y, count(*) AS n FROM r WHERE invoice_date IS NOT NULL GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, y) AS place, sum(n) OVER (PARTITION BY batch_id) AS all_n FROM n),
    f AS (SELECT batch_id, y AS modal FROM m WHERE place = 1 AND all_n >= 3 AND n * 10 >= all_n * 6),
    q AS (SELECT batch_id, try_cast(invoice_date AS DATE) AS d, row_number() OVER (PARTITION BY batch_id ORDER BY invoice_date) AS i, count(*) OVER (PARTITION BY batch_id) AS c
          FROM r JOIN f USING (batch_id) WHERE left(invoice_date, 4) = modal AND try_cast(invoice_date AS DATE) IS NOT NULL),
    h AS (SELECT batch_id, d AS middle FROM q WHERE i = c // 2 + 1),
    x AS (SELECT r.*, modal, middle, modal || substr(invoice_date, 5) AS fixed, coalesce(left(invoice_date, 4) <> modal, false) AS outlier FROM r LEFT JOIN f USING (batch_id) LEFT JOIN h USING (batch_id))
    SELECT ord, CASE WHEN outlier AND coalesce(abs(date_diff('day', try_cast(fixed AS DATE), middle)) < abs(date_diff('day', try_cast(invoice_date AS DATE), middle)), false) THEN fixed ELSE invoice_date END AS invoice_date,
      CASE WHEN outlier THEN 'low' ELSE confidence END AS confidence FROM x"""
)
def year_outlier_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.repair_years(order_records(spark, sf_dir), ["batch_id"]).select("ord", "invoice_date", "confidence")


_REVIEW = f"""
WITH r AS ({ORDER_RECORDS_SQL}),
pn AS (SELECT file_id, page_no, invoice_date AS d, count(*) AS n FROM r WHERE invoice_date IS NOT NULL GROUP BY ALL),
p AS (SELECT file_id, page_no, d AS page_date FROM (SELECT *, row_number() OVER (PARTITION BY file_id, page_no ORDER BY n DESC, d) AS i FROM pn) WHERE i = 1),
bn AS (SELECT batch_id, invoice_date AS d, count(*) AS n FROM r WHERE invoice_date IS NOT NULL GROUP BY ALL),
b AS (SELECT batch_id, d AS batch_date FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, d) AS i FROM bn) WHERE i = 1),
x AS (SELECT r.*, page_date, batch_date, invoice_date IS NULL AS missing, invoice_date IS NOT NULL AND total IS NOT NULL AS complete FROM r LEFT JOIN p USING (file_id, page_no) LEFT JOIN b USING (batch_id))
"""


@query(
    _REVIEW
    + """SELECT ord, coalesce(invoice_date, candidate, page_date, batch_date, '') AS date_default, CASE WHEN missing THEN CASE WHEN candidate IS NOT NULL THEN 'candidate' WHEN page_date IS NOT NULL THEN 'page' WHEN batch_date IS NOT NULL THEN 'batch' END END AS date_guess_src,
    missing AND coalesce(candidate, page_date, batch_date) IS NOT NULL AS date_guessed FROM x"""
)
def date_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.enrich_review(order_records(spark, sf_dir), ["batch_id"]).select("ord", "date_default", "date_guess_src", "date_guessed")


@query(_REVIEW + """SELECT CASE WHEN complete AND confidence = 'high' THEN 'ok' WHEN complete AND confidence = 'medium' THEN 'review' ELSE 'missing' END AS status, count(*) AS n, CAST(sum(total) AS DOUBLE) AS total FROM x GROUP BY 1""")
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = consensus.enrich_review(order_records(spark, sf_dir), ["batch_id"])
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("total_incl_tax").cast("double").alias("total"))


@query(
    f"""WITH r AS ({ORDER_RECORDS_SQL}), b AS (SELECT invoice_date AS d FROM r WHERE invoice_date IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    n AS (SELECT file_id, page_no, invoice_date AS d, count(*) AS n FROM r WHERE invoice_date IS NOT NULL GROUP BY ALL),
    c AS (SELECT ord, coalesce(candidate, invoice_date) AS d, 0 AS part, 0 AS less FROM r WHERE coalesce(candidate, invoice_date) IS NOT NULL
      UNION ALL SELECT r.ord, n.d, 1, -(n.n - CASE WHEN n.d = r.invoice_date THEN 1 ELSE 0 END) FROM r JOIN n USING (file_id, page_no) WHERE n.n - CASE WHEN n.d = r.invoice_date THEN 1 ELSE 0 END > 0
      UNION ALL SELECT ord, b.d, 2, 0 FROM r, b),
    u AS (SELECT ord, d, min(struct_pack(part := part, less := less, d := d)) AS k FROM c GROUP BY ord, d),
    z AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY k) AS i FROM u)
    SELECT ord, string_agg(d, ',' ORDER BY i) AS suggestions FROM z WHERE i <= 3 GROUP BY ord"""
)
def date_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.date_suggestions(order_records(spark, sf_dir)).select("ord", F.array_join("suggestions", ",").alias("suggestions"))


# --- dates, money and text ---------------------------------------------------


@query(
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS primary_date, CASE WHEN day(d) <= 12 AND day(d) <> month(d) THEN strftime(d, '%Y-%d-%m') END AS other_date FROM d"""
)
def date_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("Date "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" till 3"))
    found = spread(table(spark, sf_dir, "orders")).select("o_orderkey", F.get(dates.extract(shown), F.lit(0)).alias("d"))
    return found.select("o_orderkey", F.col("d.primary").alias("primary_date"), F.get("d.candidates", F.lit(1)).alias("other_date"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS found FROM orders")
def date_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = "o_orderdate"
    shown = (
        F.when(F.col("o_orderkey") % 6 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 6 == 1, F.date_format(d, "d MMM yyyy"))
        .when(F.col("o_orderkey") % 6 == 2, F.date_format(d, "MMMM d, yyyy"))
        .when(F.col("o_orderkey") % 6 == 3, F.concat(F.date_format(d, "yyyy"), F.lit("年"), F.date_format(d, "M"), F.lit("月"), F.date_format(d, "d"), F.lit("日")))
        .when(F.col("o_orderkey") % 6 == 4, F.regexp_replace(F.date_format(d, "d MMM. yyyy"), "o", "0"))
        .otherwise(F.date_format(d, "yyyy/M/d"))
    )
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", F.array_join(dates.primaries(F.concat(F.lit("x "), shown, F.lit(" 11:24"))), ",").alias("found"))


@query(
    """WITH t AS (SELECT o_orderkey, lower(strftime(o_orderdate, '%B')) AS m, month(o_orderdate) AS n FROM orders),
    c AS (SELECT o_orderkey, n, CASE WHEN o_orderkey % 2 = 0 THEN 'h' || substr(m, 2) ELSE m END AS t FROM t)
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN n WHEN length(t) >= 5 THEN
      (SELECT min(i) FROM (VALUES (1, 'january'), (2, 'february'), (3, 'march'), (4, 'april'), (5, 'may'), (6, 'june'), (7, 'july'), (8, 'august'), (9, 'september'), (10, 'october'), (11, 'november'), (12, 'december')) f(i, name) WHERE levenshtein(t, name) <= 2) END AS month_no FROM c"""
)
def month_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.date_format("o_orderdate", "MMMM"))
    token = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("h"), F.substring(name, 2, 20))).otherwise(name)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.month_number(token).alias("month_no"))


@query(
    """SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)) AS DOUBLE) AS amount, 'ZAR' AS currency, 1 AS n FROM lineitem"""
)
def money_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("Item R"), F.format_number(F.round("l_extendedprice", 2).cast("decimal(18,2)"), 2), F.lit(" on 2026-03-07 at 12:54"))
    found = spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", money.amounts(shown).alias("a"))
    return found.select("l_orderkey", "l_linenumber", money.last(F.col("a")).cast("double").alias("amount"), F.get("a", F.lit(0))["currency"].alias("currency"), F.size("a").alias("n"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 4 THEN CAST(o_orderkey % 1000 + 0.5 AS DOUBLE) WHEN 5 THEN 15.0 WHEN 7 THEN CAST(o_orderkey % 1000 AS DOUBLE) END AS amount FROM orders"""
)
def money_reject_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 1000
    shown = (
        F.when(F.col("o_orderkey") % 8 == 0, F.concat(F.lit("Invoice No "), n))
        .when(F.col("o_orderkey") % 8 == 1, F.concat(F.lit("479012******"), n))
        .when(F.col("o_orderkey") % 8 == 2, F.concat(F.lit("Code "), n + 123456))
        .when(F.col("o_orderkey") % 8 == 3, F.concat(F.lit("Year "), F.lit(2000) + n % 100))
        .when(F.col("o_orderkey") % 8 == 4, F.concat(F.lit("Coffee "), n, F.lit(".50")))
        .when(F.col("o_orderkey") % 8 == 5, F.concat(F.lit("SAVE 15% -"), n, F.lit(".50")))
        .when(F.col("o_orderkey") % 8 == 6, F.concat(F.lit("Number "), n + 10000))
        .otherwise(F.concat(F.lit("Seats "), n))
    )
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", money.last(money.amounts(shown)).cast("double").alias("amount"))


@query("SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'ZAR' WHEN 1 THEN '$' WHEN 2 THEN '€' ELSE '¥' END AS currency FROM customer")
def currency_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey") % 4
    shown = F.when(k == 0, "R12.50\nR7.00\n$3.00").when(k == 1, "$5 $6 €7").when(k == 2, "paid in EUR").otherwise("12元 8元 $4")
    return table(spark, sf_dir, "customer").select("c_custkey", money.voted_currency(shown).alias("currency"))


@query(
    """WITH t AS (SELECT o_orderkey, CAST(o_orderkey % 900 + 100 AS VARCHAR) AS n FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Bill Total ' || n || '.00' WHEN 1 THEN 'R1,' || n || '.00' WHEN 2 THEN 'R' || n || '.75' WHEN 3 THEN n || '.40' ELSE '1,' || n || '.20' END AS fixed FROM t"""
)
def ocr_text_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 900 + 100).cast("string")
    k = F.col("o_orderkey") % 5
    shown = (
        F.when(k == 0, F.concat(F.lit("Bi11 Tota1 "), n, F.lit(".00")))
        .when(k == 1, F.concat(F.lit("RI,"), n, F.lit(".00")))
        .when(k == 2, F.concat(F.lit("R"), n, F.lit(". 75")))
        .when(k == 3, F.concat(n, F.lit(":40")))
        .otherwise(F.concat(F.lit("1."), n, F.lit(".20")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.repair(shown).alias("fixed"))


@query(
    """WITH t AS (SELECT conv_id, turn, translate(lower(text), '1i0', 'llo') AS t FROM conversations)
    SELECT conv_id, turn, contains(t, 'date') OR contains(t, 'tlme') AS has_date_word, contains(t, 'total') OR contains(t, 'amount') AS has_total_word FROM t"""
)
def kw_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.has_keyword(t, ["date", "time"]).alias("has_date_word"), text.has_keyword(t, ["total", "amount"]).alias("has_total_word"))


# --- receipts ----------------------------------------------------------------

_PRICED = f"WITH r AS ({RECEIPTS_SQL})"


@query(
    _PRICED
    + """SELECT CAST(k AS VARCHAR) AS file_id, CASE kind WHEN 4 THEN sub WHEN 0 THEN sub + tax ELSE sub + tax + tip END / 100.0::DOUBLE AS total,
    CASE kind WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'low' END AS confidence,
    CASE WHEN kind = 2 THEN (sub + tax) / 100.0::DOUBLE END AS printed, CASE kind WHEN 3 THEN 'tendered' WHEN 4 THEN 'fallback' ELSE 'kw' END AS total_src FROM r"""
)
def total_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = records.parse_rows(receipt_rows(spark, sf_dir))
    return done.select("file_id", F.col("total_incl_tax").cast("double").alias("total"), "confidence", F.col("printed_total").cast("double").alias("printed"), "total_src")


@query(
    _PRICED
    + """SELECT class, count(*) AS n, CAST(sum(v) AS DOUBLE) / 100 AS amount FROM (
      SELECT 'subtotal' AS class, sub AS v FROM r WHERE kind <> 4 UNION ALL SELECT 'tax', tax FROM r WHERE kind <> 4 UNION ALL SELECT 'tip', tip FROM r WHERE kind = 1
      UNION ALL SELECT 'total', CASE WHEN kind = 1 THEN sub + tax + tip ELSE sub + tax END FROM r WHERE kind <> 4 UNION ALL SELECT 'total', sub + tax + tip FROM r WHERE kind = 2
      UNION ALL SELECT 'tendered', sub + tax + tip FROM r WHERE kind = 3) GROUP BY class"""
)
def row_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = classify.classified_rows(receipt_rows(spark, sf_dir)).where(F.col("class").isNotNull())
    return done.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("last_amount").cast("double").alias("amount"))


# Fixed values, in the SQL of doc_kind and id_row_filter: what marks a card, the kinds of invoices and rows of identifiers.
_SLIP_WORDS = ", ".join(f"'{w}'" for w in CARD_SLIP_WORDS)


@query(
    f"""WITH t AS (SELECT doc_id, lower(text) AS low, text FROM documents),
    h AS (SELECT doc_id, text, low, list_sum(list_transform([{_SLIP_WORDS}], lambda w: CASE WHEN contains(low, w) THEN 1 ELSE 0 END)) AS hits FROM t)
    SELECT doc_id, CASE WHEN hits >= 2 OR (hits = 1 AND regexp_matches(text, '\\*{{2,}}\\s*[0-9]{{4}}')) THEN 'card_slip' ELSE 'invoice' END AS kind,
      CASE WHEN contains(text, '发票') THEN 'vat' WHEN regexp_matches(low, 'subtotal|total|tax|amount due|balance due') THEN 'western' ELSE 'unknown' END AS type FROM h"""
)
def doc_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", classify.doc_kind(t).alias("kind"), classify.doc_type(t).alias("type"))


@query(
    """SELECT doc_id, regexp_matches(lower(text), 'terminal|merchant\\s*(id|no)|auth|approval|batch|ref(erence)?\\s*(no|#)|card\\s*(no|#)|account|tel|phone|inv(oice)?\\s*no|tax\\s*inv\\s*no') AS is_id_row FROM documents"""
)
def id_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", money.is_id_row(F.col("text")).alias("is_id_row"))


# --- geometry and aggregates -------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as OCR lines: an order is a region, two lines to a row."""
    i = F.col("l_linenumber")
    top = F.floor((i - 1) / 2) * 30.0 + (F.col("l_partkey") % 5)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).select(
        F.col("l_orderkey").cast("string").alias("file_id"),
        F.lit(1).alias("page_no"),
        F.lit(1).alias("region_no"),
        i.cast("int").alias("line_no"),
        F.concat(F.lit("w"), i.cast("string")).alias("text"),
        ((i % 2) * 100.0).alias("x0"),
        top.alias("y0"),
        ((i % 2) * 100.0 + 80).alias("x1"),
        (top + 10.0).alias("y1"),
    )


@query(
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
    g AS (SELECT k, (i - 1) // 2 AS band, string_agg('w' || i, ' ' ORDER BY i % 2, i) AS t, min((i - 1) // 2 * 30.0 + p % 5) AS top FROM l GROUP BY ALL)
    SELECT CAST(k AS VARCHAR) AS file_id, row_number() OVER (PARTITION BY k ORDER BY top) - 1 AS row_no, t AS text, CAST(top AS DOUBLE) AS y0 FROM g"""
)
def row_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.cluster_rows(_lines(spark, sf_dir)).select("file_id", F.col("row_no").cast("long").alias("row_no"), "text", "y0")


@query(
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
    g AS (SELECT k, min((i - 1) // 2 * 30.0 + p % 5) AS y0, max((i - 1) // 2 * 30.0 + p % 5) + 10 AS y1, min(i % 2 * 100.0) AS x0, max(i % 2 * 100.0) + 80 AS x1 FROM l GROUP BY k, (i - 1) // 2)
    SELECT CAST(k AS VARCHAR) AS file_id, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM g"""
)
def bbox_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.cluster_rows(_lines(spark, sf_dir)).select("file_id", "x0", "y0", "x1", "y1")


@query(
    """WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem)
    SELECT CAST(k AS VARCHAR) AS file_id, CAST(i AS INTEGER) AS line_no, row_number() OVER (PARTITION BY k ORDER BY i % 3, i) AS place FROM l"""
)
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in three columns, in reading order."""
    i = F.col("l_linenumber")
    left, top = (i % 3) * 100.0 + (i % 2) * 5.0, i * 30.0
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file_id"), i.cast("int").alias("line_no"), left.alias("x0"), top.alias("y0"), (left + 80.0).alias("x1"), (top + 20.0).alias("y1")).distinct()
    return layout.column_major(boxes, ["file_id"]).select("file_id", "line_no", F.col("place").cast("long").alias("place"))


@query(f"WITH d AS ({DRAWN_SQL}) SELECT file_id, line_no, CASE WHEN n >= 8 THEN CAST(dense_rank() OVER (PARTITION BY file_id ORDER BY slot) AS INTEGER) END AS region_no FROM d")
def receipt_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts side by side on a page are told apart; a page of fewer than eight lines is not."""
    lines = drawn_lines(spark, sf_dir)
    return layout.cluster_receipts(lines, tasks=tasks_for(lines)).select("file_id", "line_no", "region_no")


@query(f"WITH d AS ({PIECED_SQL}) SELECT file_id, line_no, CASE WHEN i <> 12 THEN CAST(dense_rank() OVER (PARTITION BY file_id ORDER BY slot) AS INTEGER) END AS region_no FROM d")
def receipt_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips are joined along x, the foot to what is above it, scraps to the receipt above; strays belong to none."""
    lines = pieced_lines(spark, sf_dir)
    return layout.cluster_receipts(lines, tasks=tasks_for(lines)).select("file_id", "line_no", "region_no")


@query(f"WITH d AS ({DRAWN_SQL}) SELECT file_id, line_no, CAST(dense_rank() OVER (PARTITION BY file_id ORDER BY slot, k % 2 = 1 AND i >= 4) AS INTEGER) AS region_no FROM d")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a text-layer page, and blocks within those that are set apart after the fourth line."""
    k = F.col("file_id").cast("long") * 3 + F.floor(F.col("line_no") / 100)
    down = F.when((k % 2 == 1) & (F.col("line_no") % 100 >= 4), 500.0).otherwise(0.0)
    lines = drawn_lines(spark, sf_dir).withColumn("y0", F.col("y0") + down).withColumn("y1", F.col("y1") + down)
    return layout.segment_text_lines(lines, tasks=tasks_for(lines, 200_000)).select("file_id", "line_no", "region_no")


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS file_id, r AS region_no, CASE r WHEN 1 THEN 40 ELSE 420 END AS x0, CASE r WHEN 1 THEN 20 ELSE 30 END AS y0,
    CASE r WHEN 1 THEN 314 ELSE 694 END AS x1, CASE WHEN r = 1 THEN 296 WHEN s_suppkey % 2 = 1 THEN 456 ELSE 282 END AS y1 FROM supplier, (VALUES (1), (2)) t(r)"""
)
def ink_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts found by the ink of page images: folds are no ink, a foot that is set off goes to the receipt above."""
    return raster.segment_images(drawn_pages(spark, sf_dir)).drop("page_no")


@query(f"WITH d AS ({DRAWN_SQL}) SELECT file_id, CAST(slot AS INTEGER) AS region_no, CAST(CASE WHEN k % 2 = 0 THEN 8 ELSE 9 END AS BIGINT) AS n FROM d GROUP BY ALL")
def edge_bleed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of nine lines the one that stands outside the frame goes; where it is inside, it stays."""
    lines = drawn_lines(spark, sf_dir).withColumn("region_no", F.floor(F.col("line_no") / 100).cast("int"))
    k = F.col("file_id").cast("long") * 3 + F.col("region_no")
    first = lines.where("line_no % 100 = 0")
    more = first.withColumn("line_no", F.col("line_no") + 50).withColumn("y0", F.col("y0") + 300.0).withColumn("y1", F.col("y1") + 300.0)
    left = F.when(k % 2 == 0, F.col("x1") + 50.0).otherwise(F.col("x0") + 50.0)
    stray = first.withColumn("line_no", F.col("line_no") + 60).withColumn("text", F.lit("x")).withColumn("x0", left).withColumn("x1", F.col("x0") + 30.0)
    keys = ["file_id", "page_no", "region_no"]
    kept = layout.strip_edge_bleed(spread(lines.unionByName(more).unionByName(stray), *keys, rows=200_000), keys)
    return kept.groupBy("file_id", "region_no").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_orderkey AS k, i AS row_no, CASE WHEN o_orderkey % 4 = 0 AND i >= 4 THEN 1 ELSE 0 END AS part FROM orders, range(8) t(i)"""
)
def stack_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two receipts in one region: split where both have a header, four rows and a total."""
    k = F.col("o_orderkey")
    head = F.when(k % 4 == 1, F.lit("Corner Shop")).otherwise(F.lit("Tax Invoice"))
    end = F.when(k % 4 == 2, F.lit("Thank you")).otherwise(F.lit("Total 5.00"))
    texts = F.array(F.lit("VAT invoice"), F.lit("Tea 2.00"), F.lit("Milk 3.00"), F.lit("Total 5.00"), head, F.lit("Tea 2.00"), F.when(k % 4 == 3, F.lit("Tax Invoice")).otherwise(F.lit("Milk 3.00")), end)
    shown = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(texts).alias("row_no", "text"))
    done = rows.split_stacked(spread(shown, "o_orderkey", rows=200_000), ["total"], ["o_orderkey"])
    return done.select(k.alias("k"), F.col("row_no").cast("long").alias("row_no"), "part")


def _receipt(spark: SparkSession, sf_dir: str, texts: list) -> DataFrame:
    """Orders as receipts of the given rows (null: none), from their amount ``sub`` in cents."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long") % 500000 + 10000
    shown = table(spark, sf_dir, "orders").withColumn("sub", cents)
    return records.parse_rows(shown.select(F.col("o_orderkey").cast("string").alias("file_id"), F.lit(1).alias("page_no"), F.lit(1).alias("region_no"), F.posexplode(F.array_compact(F.array(*texts))).alias("row_no", "text")))


def _money(cents) -> object:
    return F.format_string("%d.%02d", F.floor(cents / 100).cast("long"), (cents % 100).cast("long"))


@query(
    """SELECT CAST(k AS VARCHAR) AS file_id, CASE k % 3 WHEN 0 THEN sub WHEN 1 THEN sub + 100 ELSE sub + sub // 10 END / 100.0::DOUBLE AS total, CASE k % 3 WHEN 2 THEN 'high' ELSE 'medium' END AS confidence,
    CASE k % 3 WHEN 0 THEN 'by_word grand total' WHEN 1 THEN 'by_word total' ELSE 'tip_adds_up' END AS note
    FROM (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) % 500000 + 10000 AS sub FROM orders)"""
)
def total_pick_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a subtotal: the better word, of equal words the larger amount, or the two that a tip makes one another."""
    k, sub = F.col("o_orderkey") % 3, F.col("sub")
    tip = F.floor(sub / 10)
    texts = [
        F.when(k == 0, F.concat(F.lit("Grand total "), _money(sub))),
        F.when(k == 0, F.concat(F.lit("Amount "), _money(sub + 500))),
        F.when(k != 0, F.concat(F.lit("Total "), _money(sub))),
        F.when(k == 1, F.concat(F.lit("Total "), _money(sub + 100))),
        F.when(k == 2, F.concat(F.lit("Tip "), _money(tip))),
        F.when(k == 2, F.concat(F.lit("To pay "), _money(sub + tip))),
    ]
    done = _receipt(spark, sf_dir, texts)
    return done.select("file_id", F.col("total_incl_tax").cast("double").alias("total"), "confidence", F.element_at("notes", -1).alias("note"))


@query(
    """SELECT CAST(k AS VARCHAR) AS file_id, CASE k % 3 WHEN 0 THEN sub + sub // 5 WHEN 1 THEN sub * 2 ELSE sub END / 100.0::DOUBLE AS total, CASE k % 3 WHEN 2 THEN 'kw' ELSE 'tendered' END AS total_src, k % 3 = 0 AS with_tip
    FROM (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) % 500000 + 10000 AS sub FROM orders)"""
)
def tendered_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment above the total has the last word: as a tip up to 35 %, else as it stands; a smaller one changes nothing."""
    k, sub = F.col("o_orderkey") % 3, F.col("sub")
    paid = F.when(k == 0, sub + F.floor(sub / 5)).when(k == 1, sub * 2).otherwise(sub - 100)
    done = _receipt(spark, sf_dir, [F.concat(F.lit("Total "), _money(sub)), F.concat(F.lit("C/Card "), _money(paid))])
    return done.select("file_id", F.col("total_incl_tax").cast("double").alias("total"), "total_src", F.exists("notes", lambda n: n.startswith("paid_with_tip")).alias("with_tip"))


# --- streams -----------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream's query says of all input that is there: totals, few enough for a table in memory."""
    import uuid

    name = f"stream_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM events GROUP BY 1")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream, summed by day: one row a day is kept in memory."""
    done = _drained(links.amounts_by_window(_event_stream(spark, sf_dir)))
    return done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.col("amount").cast("double").alias("amount"))


def _amount_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return links.links_by_day(events, ["user_id"], "event_id", days=3)


def _stream_folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(
    """WITH e AS (SELECT event_id AS id, user_id AS u, ts, CAST(ts AS DATE) AS d, CAST(round(value * 100) AS BIGINT) AS c FROM events),
    f AS (SELECT u, c, d, arg_min(id, (ts, CAST(id AS VARCHAR))) AS first, min(ts) AS ts FROM e GROUP BY u, c, d)
    SELECT e.id AS record_id, f.first AS of, abs(date_diff('day', e.d, f.d)) AS gap FROM e JOIN f ON e.u = f.u AND abs(e.c - f.c) <= 1 AND abs(date_diff('day', e.d, f.d)) <= 3
    WHERE (f.ts, CAST(f.first AS VARCHAR)) < (e.ts, CAST(e.id AS VARCHAR))"""
)
def stream_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream, each linked on arrival; links go to a table in the shared folder."""
    folder = _stream_folder(spark)
    sink = _amount_links(spark, sf_dir).writeStream.format("parquet").option("path", f"{folder}/links").option("checkpointLocation", f"{folder}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/links").select(F.col("record_id").cast("long").alias("record_id"), F.col("of").cast("long").alias("of"), F.col("gap").cast("long").alias("gap"))


@query(
    """WITH RECURSIVE p AS (SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id
    AND abs(CAST(round(a.value * 100) AS BIGINT) - CAST(round(b.value * 100) AS BIGINT)) <= 1 AND abs(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE))) <= 3),
    w AS (SELECT DISTINCT a AS node, a AS here FROM p UNION SELECT w.node, p.b FROM w JOIN p ON w.here = p.a)
    SELECT node, min(here) AS component FROM w GROUP BY node"""
)
def stream_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links on arrival, joined to components batch by batch: those of the whole table."""
    folder = _stream_folder(spark)
    stored = groups.StoredComponents(spark, f"{folder}/components")
    sink = _amount_links(spark, sf_dir).writeStream.foreachBatch(lambda df, n: stored.add(df, n, "record_id", "of"))
    sink.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stored.current(spark)


@query(
    """WITH v AS (SELECT l_suppkey, l_discount AS a, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY ALL),
    s AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY a) AS so_far, sum(w) OVER (PARTITION BY l_suppkey) AS t FROM v)
    SELECT l_suppkey, min(a) AS weighted_median FROM s WHERE so_far >= t / 2 GROUP BY l_suppkey"""
)
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_quantity").cast("long"))
    return consensus.weighted_median(items, ["l_suppkey"], "l_discount", "w")


@query(
    """WITH s AS (SELECT l_suppkey, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY 1)
    SELECT l_suppkey, q[CAST(floor(len(q) * 0.8) AS INTEGER) + 1] AS p80, q[len(q) // 2 + 1] AS upper_median FROM s"""
)
def index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return consensus.at_rank(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", {"p80": F.floor(n * 0.8), "upper_median": F.floor(n / 2)})


@query(
    """WITH c AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events GROUP BY ALL),
    g AS (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS island FROM c)
    SELECT user_id, min(d) AS first, max(d) AS last, count(*) AS length FROM g GROUP BY user_id, island HAVING count(*) >= 2"""
)
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("d")).distinct()
    return rows.gap_islands(days, ["user_id"], "d", F.lit(True), 2)


@query(
    f"""WITH r AS ({ORDER_RECORDS_SQL}) SELECT CAST(ord AS VARCHAR) AS record_id, coalesce(invoice_date, candidate) AS invoice_date, CAST(total AS DOUBLE) AS total_incl_tax FROM r
    WHERE ord % 5 <> 0 AND (coalesce(invoice_date, candidate) IS NOT NULL OR total IS NOT NULL)"""
)
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = order_records(spark, sf_dir)
    first = r.select("record_id", F.lit(0).cast("long").alias("seq"), F.coalesce("invoice_date", F.get("date_candidates", F.lit(0))).alias("date"), F.col("total_incl_tax").alias("amount"), F.lit(False).alias("confirmed"), F.lit(False).alias("deleted"))
    events = first.unionByName(review.transition(r.where("ord % 5 = 0"), "delete", 1))
    out = review.export_rows(review.latest_state(events))
    return out.select("record_id", "invoice_date", F.col("total_incl_tax").cast("double").alias("total_incl_tax"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
