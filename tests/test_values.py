"""Cell values against a small model of the rules in plain Python."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from gridwise.functions import addresses as A
from gridwise.functions import values as V


def model_number(x: float) -> str:
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    return repr(x)


def model_key(x):
    t = (x or "").strip()
    if t == "":
        return "blank:"
    if t.lower() in ("true", "false"):
        return f"boolean:{t.lower()}"
    if re.fullmatch(r"-?\d+(\.\d+)?", t):
        return f"number:{model_number(float(t))}"
    if m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4})", t):
        return f"date:{m[3]}-{m[1]:0>2}-{m[2]:0>2}"
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", t):
        return f"date:{m[1]}-{m[2]:0>2}-{m[3]:0>2}"
    return f"string:{t}"


def column(spark, values, kind="string"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")


def values(df, expr):
    return [r["v"] for r in df.select("k", expr.alias("v")).orderBy("k").collect()]


def test_keys_of_texts(spark):
    r = random.Random(7)
    some = [None, "", " ", "\t", " x ", "TRUE ", "false", "007", "1.50", "-0", "0.0", "1e5", "+5", ".5", "13/45/2024", "2024-13-45", "1/2/2024", "9007199254740993", "0.1", "1234.5678"]
    some += ["".join(r.choice("0123456789.-/ aT") for _ in range(r.randint(0, 8))) for _ in range(400)]
    assert values(column(spark, some), V.key(F.col("x"))) == [model_key(x.replace(" ", " ") if x else x) for x in some]


def test_keys_of_other_types(spark):
    x = F.col("x")
    assert values(column(spark, [True, False, None], "boolean"), V.key(x, "boolean")) == ["boolean:true", "blank:", "blank:"]
    numbers = [5.0, 1.5, 1e7, 1e21, 123456.789, -0.0, 0.1, 2.5e-5, 1e-7, float("nan"), None]
    assert values(column(spark, numbers, "double"), V.key(x, "number")) == ["number:5", "number:1.5", "number:10000000", "number:1e+21", "number:123456.789", "number:0", "number:0.1", "number:0.000025", "number:1e-7", "string:NaN", "blank:"]
    assert values(column(spark, [dt.date(2024, 3, 4), None], "date"), V.key(x, "date")) == ["date:2024-03-04", "blank:"]


def test_three_blanks_differ(spark):
    df = column(spark, [None, "", " ", "x"])
    x = F.col("x")
    assert values(df, V.target_blank(x)) == [True, True, False, False]
    assert values(df, V.source_blank(x)) == [True, True, False, False]
    assert values(df, V.audit_blank(x)) == [True, True, True, False]
    flags = column(spark, [True, False, None], "boolean")
    assert values(flags, V.target_blank(x, "boolean")) == [False, True, True]
    assert values(flags, V.source_blank(x, "boolean")) == [False, False, True]


def test_identity_dates_numbers_and_names(spark):
    x = F.col("x")
    df = column(spark, [None, " a ", "null", "undefined", "Null"])
    assert values(df, V.identity(x)) == ["", "a", "", "", "Null"]
    dates = column(spark, ["1", "60001", "3/4/2024", "2024-02-31", "13/1/2024", "no", "45000.7"])
    assert values(dates, V.to_date(x)) == [dt.date(1899, 12, 31), None, dt.date(2024, 3, 4), dt.date(2024, 3, 2), dt.date(2025, 1, 1), None, dt.date(2023, 3, 15)]
    assert values(column(spark, ["1.5", "", "5d", "1e3", " 7 "]), V.to_number(x)) == [1.5, None, None, 1000.0, 7.0]
    assert values(column(spark, ["a/b:c*d", None]), V.safe_name(x)) == ["a b c d", ""]
    assert values(column(spark, ["Hello, World!", "--a--"]), V.slug(x)) == ["hello-world", "a"]


def test_addresses(spark):
    row = "named_struct('h', '12', 's', 'Main', 'sh', '', 'ss', '9', 'a', ' 1  Elm  St ')"
    got = spark.sql(f"select inline(array({row}))").select(A.situs(*[F.col(c) for c in ("h", "s", "sh", "ss", "a")]).alias("v")).first()["v"]
    assert (got["key"], got["source"]) == ("12 main", "house_street")
    df = column(spark, ["12 oak  st.", "st", "N Main Pkwy", "way"])
    assert values(df, A.street(F.col("x"))) == ["12 OAK STREET", "ST", "N MAIN PARKWAY", "WAY"]
    assert values(column(spark, ["7-Feb", "Feb 7", "1/2", "12", "2024-01-02"]), A.warnings(F.col("x"))) == [["day and month"], ["month and day"], ["slash date"], [], ["date"]]
