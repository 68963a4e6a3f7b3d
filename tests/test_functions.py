import html
import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerlift.functions import buckets as bk
from ledgerlift.functions import dates as dt
from ledgerlift.functions import numbers as nm
from ledgerlift.functions import text as tx


def values(df, column="out"):
    return [r[column] for r in df.collect()]


def one(spark, rows, schema, expr):
    return values(spark.createDataFrame([(r,) for r in rows], schema).select(expr.alias("out")))


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("FI12345678", "1234567-8"), ("fi12345678", "1234567-8"), ("12345678", "1234567-8"), ("1234567-8", "1234567-8"), ("1234567", "0123456-7"),
        (" ", None), (None, None), ("abc", None), ("123456789", "12345678-9"), ("123456", None),
    ],
)
def test_business_id(spark, raw, expected):
    assert one(spark, [raw], "v string", tx.business_id(F.col("v"))) == [expected]


def test_business_id_variants(spark):
    assert one(spark, ["abc", None, "nan", "FIx"], "v string", tx.business_id(F.col("v"), on_fail="keep")) == ["abc", "", "", "x"]
    assert one(spark, ["FI1234567FI", None], "v string", tx.business_id(F.col("v"), on_fail="blank", country_prefix="all")) == ["0123456-7", ""]
    assert one(spark, [1234567.0, 12345678.0], "v double", tx.business_id(tx.id_text(F.col("v"), "double"))) == ["0123456-7", "1234567-8"]


def test_names(spark):
    names = ["Foo Oy (closed)", "Ärzte GmbH & Co", "HR lahjat Oy", None, "Suljettu AB"]
    assert one(spark, names, "v string", tx.name_for_matching(F.col("v"))) == ["foo", "arzte co", None, None, None]
    assert one(spark, names, "v string", tx.name_of_account(F.col("v")))[:2] == ["foo", "ärzte co"]
    assert one(spark, ["Crème—Brûlée  ÄÖ"], "v string", tx.fold(F.col("v"))) == ["creme brulee ao"]
    odd = ["ﬁne ½ ⑩ ㎏", "e\u0301te\u0308", "𝐀𝐛𝟙", "łódź Ǆ", "ǭ ｆｕｌｌ", None]
    want = []
    for t in odd:
        plain = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c)).lower()
        want.append(" ".join(re.findall("[a-z0-9]+", plain)))
    assert one(spark, odd, "v string", tx.fold(F.col("v"))) == want


def test_word_edges_know_finnish_letters(spark):
    found = one(spark, ["kynä punainen", "täkynä", "kynät"], "v string", tx.has_any(F.col("v"), ["kynä"], whole_words=True))
    assert found == [True, False, False]


def test_variant_text(spark):
    assert one(spark, ["Pyyhe-70 x 140 cm"], "v string", tx.variant_text(F.col("v"), join_cm=True)) == ["pyyhe 70x140cm"]


def test_urls(spark):
    urls = ["example.com/a/?q=1#x", "http://Ex.com/", " ", "nan", None]
    assert one(spark, urls, "v string", tx.url_clean(F.col("v"))) == ["https://example.com/a", "http://Ex.com", None, None, None]


def test_page_links_stay_on_the_domain(spark):
    html = '<a href="/a?x=1#f">1</a><a href="https://other.org/b">2</a><a class="c" href="https://ex.com/c/">3</a><a href="mailto:x@y">4</a><a href="/a?x=1">5</a>'
    got = spark.createDataFrame([(html,)], "h string").select(tx.page_links(F.col("h"), F.lit("https://ex.com/start")).alias("out"))
    assert values(got) == [["https://ex.com/a?x=1", "https://ex.com/c"]]


@pytest.mark.parametrize("raw,expected", [("12,5", 12.5), ("12.5", 12.5), ("", None), ("x", None), ("-3", -3.0), ("0", 0.0), ("NaN", None), ("1e3", 1000.0), (None, None)])
def test_to_number(spark, raw, expected):
    assert one(spark, [raw], "v string", nm.to_number(F.col("v"))) == [expected]


def test_units(spark):
    assert one(spark, ["500 g", "2 kg", "3", "-1 kg", "x"], "v string", nm.weight_kg(F.col("v"))) == [0.5, 2.0, 3.0, None, None]
    assert one(spark, ["30 mm", "1,5 m", "7 cm", "8"], "v string", nm.length_cm(F.col("v"))) == [3.0, 150.0, 7.0, 8.0]


def test_rounding_and_clipping(spark):
    assert one(spark, [0.5, 1.5, 2.5, -0.5], "v double", nm.round_even(F.col("v"))) == [0.0, 2.0, 2.0, -0.0]
    assert one(spark, [None, -500.0, 900.0, 5.0], "v double", nm.clip(F.col("v"), -100, 200)) == [None, -100.0, 200.0, 5.0]


def test_baseline_without_figures(spark):
    got = spark.range(1).select(nm.continuous_baseline(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("out"))
    assert values(got)[0] == pytest.approx(math.log1p(25.0) * 6500.0)


def test_dates(spark):
    months = one(spark, ["2024-02", "2024-13", None], "v string", dt.month_start(F.col("v")))
    assert [str(m) for m in months] == ["2024-02-01", "None", "None"]
    stamps = one(spark, ["31.12.2024", "2024-02-29T10:00:00Z", "no"], "v string", dt.month_text(dt.parse_timestamp(F.col("v"))))
    assert stamps == ["2024-12", "2024-02", None]


def test_snapshot_fallback(spark):
    sales = spark.createDataFrame([("2024-01-05",), ("2024-12-20",)], "d string").select(F.col("d").cast("date"))
    days = [str(r[0]) for r in dt.snapshot_dates(sales, "d", lookback_days=365).orderBy("snapshot_date").collect()]
    assert days == ["2024-06-21", "2024-12-20"]


def test_bins(spark):
    growth = one(spark, [-5.0, 5.0, 20.0, -500.0, 900.0, None], "v double", bk.growth_bucket(F.col("v")))
    assert growth == ["decline", "stable", "growth", "decline", "high_growth", None]
    assert one(spark, [365, 366, 730, 731], "v int", bk.sales_year_bucket(F.col("v"))) == ["recent_12m", "middle_12m", "middle_12m", "oldest_12m"]
    assert one(spark, [3999.0, 4000.0, 10000.0, 50000.0, 100000.0], "v double", bk.potential_segment(F.col("v"))) == ["Partner", "Below C", "C", "B", "A"]
    assert one(spark, [39.9, 40.0, 69.9, 70.0, None], "v double", bk.sales_priority(F.col("v"))) == ["Low", "Medium", "Medium", "High", None]


def test_segment_prefers_number_for_revenue_and_label_for_staff(spark):
    rows = [(600.0, 5.0, None, "2-10 milj.", "250-499"), (None, None, 1.0, "2-10 milj.", None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "revenue_k_eur double, headcount double, growth_pct double, revenue_class string, headcount_class string")
    assert values(bk.add_segment_features(df), "company_segment") == ["0-1M_250-1000", "1-5M_unknown", "unknown_unknown"]


def test_match_confidence_orders(spark):
    methods = ["sku", "SKU", "source_zip_productcode_code", "x_manual_y", "manual_z", "", None, "other", "same_name_reference"]
    last = one(spark, methods, "v string", bk.match_confidence(F.col("v")))
    first = one(spark, methods, "v string", bk.match_confidence(F.col("v"), rule_order="first"))
    assert last == [1.0, 0.6, 0.8, 0.75, 0.75, 0.0, 0.0, 0.6, 0.8]
    assert first == [1.0, 1.0, 0.95, 0.6, 0.75, 0.0, 0.0, 0.6, 0.85]


def test_character_references(spark):
    texts = ["a &auml; &ouml;&amp;&lt;b&gt; &copy;&nbsp;x", "&#228;&#xE4;&#x1F600; &#0; &unknown; & &; x&y", "no reference", "&hearts;&euro;&frac12;", "", None]
    got = one(spark, texts, "v string", tx.decode_references(F.col("v")))
    assert got[0] == html.unescape(texts[0]) and got[2:] == [html.unescape(t) if t is not None else None for t in texts[2:]]
    assert got[1] == "ää\U0001F600 &#0; &unknown; & &; x&y"
