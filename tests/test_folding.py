import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notegrove.functions import dates
from notegrove.functions.distance import osa, within, within_column
from notegrove.functions.fold import alias_fold, fold, fold_column, fold_field, fold_field_column, grams, grams_column, variants, words


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_fold_keeps_length(text):
    assert len(fold(text)) == len(text)


def test_fold_values():
    assert fold("KÜCHE Straße\tÉ\x00") == "kuche strase e "
    assert alias_fold("Öl ßÆ") == "oel ssae"
    assert fold_field("Ku\u0308che") == "kuche"
    assert fold("ŁØÞ\u200b") == "lot "


def test_fold_in_spark_equals_python(spark):
    texts = ["".join(map(chr, range(a, a + 64))) for a in [*range(1, 0x800, 64), *range(0x1E00, 0x1F00, 64), 0x2000, 0xFB00]]
    texts += ["é", unicodedata.normalize("NFD", "Äpfel é")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold_column(F.col("t")).alias("f"), fold_field_column(F.col("t")).alias("g"), grams_column(F.col("t")).alias("n"))
    for r in rows.collect():
        assert r.f == fold(r.t)
        assert r.n == grams(r.t)
    assert rows.filter(F.col("t") == texts[-1]).first().g == fold_field(texts[-1])


@pytest.mark.parametrize("raw,expected", [("Küche", ["kuche", "kueche"]), ("Kueche", ["kueche", "kuche"]), ("Strasse", ["strasse", "strase"]), ("oel", ["oel"]), ("öl", ["ol", "oel"]), ("aeoeue", ["aeoeue", "aou", "aoeue", "aeoue", "aoue", "aeoeu", "aoeu", "aeou"])])
def test_variants(raw, expected):
    assert variants(raw, 8) == expected


def test_many_sites_contract_at_once_only():
    assert variants("aeaeaeaeaeaeae", 8) == ["aeaeaeaeaeaeae", "aaaaaaa"]


def test_words():
    assert words("ab c1-ab x") == ["ab", "c1", "x"]


@pytest.mark.parametrize("a,b,d", [("form", "from", 1), ("ca", "abc", 3), ("", "ab", 2), ("abc", "abc", 0), ("kitten", "sitting", 3)])
def test_osa(a, b, d):
    assert osa(a, b) == osa(b, a) == d


def test_within_in_spark(spark):
    term = "kueche"
    made = {term[:i] + x + term[j:] for i in range(7) for j in range(i, min(7, i + 3)) for x in ("", "x", "xy")}
    made |= {"keuche", "ukeche", "kueceh", "ekuchex", "zzz"}
    rows = spark.createDataFrame([(w,) for w in made if w], "w string")
    found = {r.w for r in rows.filter(within_column(F.col("w"), term, 2)).collect()}
    assert found == {w for w in made if within(w, term, 2)}


@pytest.mark.parametrize(
    "value,millis",
    [("1970-01-02", 86_400_000), ("2.1.1970", 86_400_000), ("31.2.2024", None), ("1970-01-01T01:00+01:00", 0), ("1970-01-01 00:00:01.5Z", 1500), ("1714521600", 1714521600000), ("nope", None), ('"1970-01-02"', 86_400_000), ("1970-01-01T24:00", None)],
)
def test_dates(spark, value, millis):
    assert dates.parse_date(value) == millis
    row = spark.createDataFrame([(value,)], "v string").select(dates.parse_date_column(F.col("v")).alias("m")).first()
    assert row.m == millis


def test_calendar():
    assert dates.add_months(dates.parse_date("2024-01-31"), 1) == dates.parse_date("2024-02-29")
    assert dates.days_in_month(2023, 2) == 28 and dates.days_in_month(2023, 12) == 31
    low, high = dates.quick_range("week", dates.parse_date("2024-03-10T12:00"))
    assert (low, high) == (dates.parse_date("2024-03-03"), dates.parse_date("2024-03-11") - 1)
    assert dates.quick_range("any", 0) == (None, None)
    spring = dates.parse_date("2024-03-31", "Europe/Berlin")
    assert dates.add_days(spring, 1, "Europe/Berlin") - spring == 23 * 3_600_000
    assert dates.normalize_range(5, 3) == (3, 5) and dates.iso_weekday(0) == 4


def test_dates_as_columns_and_values_agree(spark):
    import random

    from pyspark.sql import functions as F

    from notegrove.functions.dates import parse_date, parse_date_column

    forms = ["2024-03-31T02:30:00+01:00", "2024-02-29", "2023-02-29", "2024-10-27 12:30", "2024-01-01T10:00Z", "2024-01-01 10:00:05.1234567 +0530", "1.2.2024", "31.12.1999", "1700000000", "1700000000123", "2024-01-01T24:00", "[2024-01-01]", "'2024-01-01'", "2024-W01-1", "99.1.2024", "2024-01-01Z"]
    rng, texts = random.Random(3), list(forms)
    for _ in range(600):
        s = list(rng.choice(forms))
        i = rng.randrange(len(s))
        s[i : i + 1] = rng.choice([[], [rng.choice("0123456789-:. TZz+")], [s[i], rng.choice("0123456789-:. ")]])
        texts.append("".join(s))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t: r.d for r in df.select("t", parse_date_column(F.col("t")).alias("d")).collect()}
    wrong = {t: (found[t], parse_date(t)) for t in texts if found[t] != parse_date(t)}
    assert not wrong
    assert found["2024-01-01 10:00:05.1234567 +0530"] == 1704083405123 and found["2024-02-29"] == 1709164800000
    assert found["2023-02-29"] is None and found["2024-01-01Z"] is None


def test_grams_of_a_long_text_take_linear_time(spark):
    """Characters beyond U+FFFF count as one, and a long text is no matter of minutes."""
    texts = ["a\U0001f600b\nc", "\U0001f600\U0001f601", None, "ab", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", grams_column(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()] == [grams(t or "") for t in texts]
    long = " ".join(f"w{i}ö" for i in range(60_000))
    began = time.monotonic()
    assert spark.createDataFrame([(long,)], "t string").select(grams_column(F.col("t")).alias("n")).first().n == grams(long)
    assert time.monotonic() - began < 20
