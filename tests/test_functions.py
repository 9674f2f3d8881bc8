"""Golden cases of text repair, money and dates."""

from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text


def column(spark, values, expression, schema="t string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + schema)
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_repair(spark):
    cases = {
        "15March2026": "15 March 2026",
        "R208. 00": "R208.00",
        "1. 25 Main Road": "1. 25 Main Road",
        "D:11 03 26": "D:11-03-26",
        "2026/03/:1": "2026/03/11",
        "Bi11 Total": "Bill Total",
        "RI,164.00": "R1,164.00",
        "1,I64.00": "1,164.00",
        "1.164.00": "1,164.00",
        "1,164,00": "1,164.00",
        "R4, 322.00": "R4,322.00",
        "Qty 2, 300ml": "Qty 2, 300ml",
        "2Q8.00": "208.00",
        "PLU 3Q5": "PLU 3Q5",
        "Total 3Q5": "Total 305",
        "233:00": "233.00",
        "11:22": "11:22",
    }
    assert column(spark, list(cases), text.repair(F.col("t"))) == list(cases.values())
    assert column(spark, ["11:22", "20:31:05", "233.00", "11:22 x"], text.is_bare_time(F.col("t"))) == [True, True, False, False]


def test_amounts(spark):
    cases = {
        "R560.00": [560.00],
        "R1,655.00": [1655.00],
        "SAVE 15% -101.94": [15],
        "479012******0821": [],
        "Tax Inv No: 1362": [],
        "54 TOTAL 98": [54, 98],
        "15o5.00": [1505.00],
        "Year 2026": [],
        "12345": [],
        "2026-03-07 Total 12.50": [12.50],
        "12:54 Coffee 35.00": [35.00],
        "": [],
    }
    got = column(spark, list(cases), F.transform(money.amounts(F.col("t")), lambda a: a["value"].cast("double")))
    assert got == list(cases.values())
    assert column(spark, ["R560.00 and $5", "5元", "pay 7 EUR", "none"], money.voted_currency(F.col("t"))) == ["ZAR", "¥", "€", None]


def test_dates(spark):
    cases = {
        "07/03/2026": ("2026-03-07", ["2026-03-07", "2026-07-03"]),
        "25-03-26": ("2026-03-25", ["2026-03-25"]),
        "2026年7月9日": ("2026-07-09", ["2026-07-09"]),
        "Ju1 5. 2026": ("2026-07-05", ["2026-07-05"]),
        "15 March 202611:24": ("2026-03-15", ["2026-03-15"]),
        "30 Mar'2608:47": ("2026-03-30", ["2026-03-30"]),
        "29 Harch 2026": ("2026-03-29", ["2026-03-29"]),
        "31/02/2026": ("2026-02-31", ["2026-02-31"]),
        "日期2026-07-09": None,
        "99/99/2026": None,
        "2026-03-07": ("2026-03-07", ["2026-03-07"]),
    }
    got = column(spark, list(cases), dates.extract(F.col("t")))
    assert [(r[0].primary, r[0].candidates) if r else None for r in got] == list(cases.values())
    assert column(spark, ["07/03/2026"], dates.extract(F.col("t"), "mdy")["primary"]) == [["2026-07-03"]]
    assert column(spark, ["2026-02-31", "2026-02-28"], dates.legal(F.col("t")).cast("string")) == [None, "2026-02-28"]


def test_keywords(spark):
    got = column(spark, ["Bi11 Tota1", "GRAND T0TAL", "nothing"], text.keyword_rank(F.col("t"), ["grand total", "bill total", "total"]))
    assert got == [1, 0, None]


def test_digits_to_a_fixpoint(spark):
    chained = "1" + ".oO" * 9 + "5"
    expected = "1" + ".00" * 9 + "5"
    assert column(spark, [chained, "1l5.o0", "Total lol", None], text.repair_digits(F.col("t"))) == [expected, "115.00", "Total lol", None]


def test_money_of_odd_rows(spark):
    """Signs, codes, white space and digits of any kind, against the pattern's own groups in Python."""
    import random
    import re
    from decimal import Decimal

    rng = random.Random(6)
    parts = ["R", "RMB", "usd", "ZAR", "$", "¥", "元", "-", "*", " ", "\t", "\u3000", ".", ",", "0", "12", "1,234", "12.50", "9999", "x", "Card", "\u0663"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(3000)]

    def by_hand(row):
        out = []
        for m in re.finditer(money.AMOUNT, row, re.IGNORECASE):
            code = money.CURRENCIES.get((m[1] or "").upper(), (m[1] or "").upper()) or ("¥" if m[3] else None)
            out.append((Decimal(m[2].replace(",", "")).quantize(Decimal("0.01")), m[0].strip(" "), code, not re.search("[.,]", m[0])))
        return out

    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = {r.t: [tuple(x) for x in r.a] for r in df.select("t", money.tokens(F.col("t")).alias("a")).collect()}
    assert all(got[r] == by_hand(r) for r in rows)


def test_digit_repair_counts_rounds_by_stretches(spark):
    """Ordinary words ask for no rounds, however long the text; a chain of repairs for as many as it has."""
    import re
    import time

    long = "hello cool Illinois loo, oOl. " * 20_000 + "R1o.oO.oO.o5 and 3,l2"

    def by_hand(t):
        while True:
            before = t
            for pattern, digit in text.LETTERS_IN_NUMBERS:
                t = re.sub(pattern, digit, t)
            if t == before:
                return t

    rows = [long, "1.oO.oO.o", "5.oIo5", "1o1l1", "oo1", None, "12.oo", "o.o.o.1l.o"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    began = time.time()
    assert [r[0] for r in df.select(text.repair_digits(F.col("t"))).collect()] == [None if r is None else by_hand(r) for r in rows]
    assert time.time() - began < 30
