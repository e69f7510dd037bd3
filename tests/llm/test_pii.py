import datetime
import re

import pytest
from pyspark.sql import functions as F

from sitewright.llm import pii

KEY = "test key"


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(re.sub(r"\D", "", number))):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_ok(x: str) -> bool:
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def changed(spark, texts, key=KEY):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: (r.text, r.pii) for r in pii.pseudonymise(df, key).collect()}


def test_formats_and_validity(spark):
    texts = [
        "card 4111 1111 1111 1111, end", "4111111111111112 no card", "ssn 123-45-6789.", "ssn 666-45-6789", "call +1 (974) 555-3436 now",
        "at 175.102.247.55, yes", "at 999.1.1.1", "IBAN DE89 3704 0044 0532 0130 00.", "IBAN DE88 3704 0044 0532 0130 00.", "born 1985-02-28, ok",
        "born 1985-02-30", "am 3.7.1985 und 03.07.1985", "on 12/25/1999 or 25/12/1999", "mail Ann.Lee+x@mail7.example.com!", "(212) 555-0187", "v 1.2.3",
    ]
    got = changed(spark, texts)
    same = {1, 3, 6, 8, 10, 15}
    for i, t in enumerate(texts):
        assert (got[i][0] == t) == (i in same), (t, got[i])
        if i != 13:
            assert re.sub(r"\d", "9", got[i][0]) == re.sub(r"\d", "9", t) or i in (5, 11, 12), got[i]
    assert luhn(got[0][0].split("card ")[1].split(",")[0])
    assert iban_ok(got[7][0][5:-1])
    assert "Ann" not in got[13][0] and got[13][0].endswith("@mail7.example.com!")
    datetime.date.fromisoformat(got[9][0][5:15])
    assert got[12][1] == {"date": 2} and got[0][1] == {"card": 1}


def test_equal_values_stay_linked_and_keys_differ(spark):
    card = "5500005555555559"
    got = changed(spark, [f"a {card} b", f"{card}", "x"])
    assert got[0][0][2:18] == got[1][0] != card
    assert changed(spark, [card], "other")[0][0] != got[1][0]


@pytest.mark.parametrize(("a", "b"), [(92, 397), (7, 3), (1, 5)])
def test_feistel_is_a_permutation_and_goes_back(spark, a, b):
    df = spark.range(a * b).select((F.col("id") / b).cast("long").alias("l"), (F.col("id") % b).alias("r"))
    out = df.withColumn("s", pii.feistel(F.col("l"), F.col("r"), F.lit(a), F.lit(b), KEY, "t"))
    out = out.withColumn("t", pii.feistel(F.col("s.l"), F.col("s.r"), F.lit(a), F.lit(b), KEY, "t", back=True))
    assert out.select("s").distinct().count() == a * b
    assert out.filter("t.l <> l or t.r <> r or s.l >= %d or s.r >= %d" % (a, b)).count() == 0


def test_days_of_a_century_are_permuted(spark):
    days = spark.range(36525).select(F.date_format(F.expr("date_add(date'2000-01-01', cast(id as int))"), "yyyy-MM-dd").alias("text"), F.col("id").alias("doc_id"))
    out = pii.pseudonymise(days, KEY).select("text")
    assert out.distinct().count() == 36525
    assert out.filter("text >= '2000-01-01' and text <= '2099-12-31'").count() == 36525


def test_edges(spark):
    got = changed(spark, [None, "", "12 12 12", "a" * 50_000 + " 4111111111111111 " + "1" * 5000])
    assert got[0] == (None, {}) and got[1] == ("", {}) and got[2][0] == "12 12 12"
    assert got[3][1] == {"card": 1} and "4111111111111111" not in got[3][0] and len(got[3][0]) == 55_018
    df = spark.createDataFrame([(1, "4111111111111111", "keep", "mine")], "doc_id long, text string, l string, pii string")
    assert pii.pseudonymise(df, KEY).columns == ["doc_id", "text", "l", "pii"]
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0
