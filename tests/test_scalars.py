"""Scalar rules on hand-picked inputs."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.functions import labels as L
from shelfmark.functions import objects as O
from shelfmark.functions import text as X


def apply(spark, rule, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()]


def test_format_price(spark):
    from decimal import Decimal as D

    values = [D("450.00"), D("450.50"), D("0.00"), D("-3.25"), None]
    assert apply(spark, L.format_price, values, "decimal(10,2)") == ["450 ETB", "450.50 ETB", "0 ETB", "-3.25 ETB", "0 ETB"]
    assert apply(spark, lambda v: L.format_price(v, F.lit("USD")), values[:1], "decimal(10,2)") == ["450 USD"]
    assert apply(spark, lambda v: L.format_price(v, F.lit("")), values[:1], "decimal(10,2)") == ["450 ETB"]
    assert apply(spark, L.format_price, [float("nan"), float("inf"), 7.5], "double") == ["", "", "7.50 ETB"]
    assert apply(spark, L.format_price_raw, values[:4], "decimal(10,2)") == ["450 ETB", "450.5 ETB", "0 ETB", "-3.25 ETB"]


def test_decimal_cast_rounds_half_away_from_zero(spark):
    assert [str(x) for x in apply(spark, lambda v: v.cast("decimal(10,2)"), [2.345, -2.345], "double")] == ["2.35", "-2.35"]


@pytest.mark.parametrize("available, badge, label, pills", [
    (True, None, "", []), (None, "new", "NEW", ["NEW"]), (True, "hot", "HOT", ["HOT"]),
    (False, "new", "SOLD OUT", ["NEW", "SOLD OUT"]), (False, None, "SOLD OUT", ["SOLD OUT"])])
def test_badges(spark, available, badge, label, pills):
    row = spark.createDataFrame([(available, badge)], "a boolean, b string") \
        .select(L.display_badge("a", "b").alias("l"), L.status_pills("a", "b").alias("p")).first()
    assert (row.l, row.p) == (label, pills)


def test_icons(spark):
    rows = spark.createDataFrame([("u", "e", "c"), ("", "e", "c"), (None, "", "c"), (None, None, "")], "u string, e string, c string")
    found = rows.select(L.display_icon("u", "e", "c").alias("a"), L.display_icon("u", "e").alias("b")).collect()
    assert [tuple(r) for r in found] == [("u", "u"), ("e", "e"), ("c", "🍽"), ("🍽", "🍽")]
    backs = spark.createDataFrame([("#1", "pizza"), ("", "pizza"), (None, "unknown")], "b string, s string")
    assert [r[0] for r in backs.select(L.icon_background("b", "s")).collect()] == ["#1", "#fff3e0", None]


def test_description_and_name(spark):
    rows = spark.createDataFrame([("a", "ሀ"), ("", "ሀ"), ("a", None), (None, "")], "e string, m string")
    lines = [[tuple(x) for x in r[0]] for r in rows.select(L.description_lines("e", "m")).collect()]
    assert lines == [[("a", ""), ("ሀ", "am")], [("ሀ", "am")], [("a", "")], []]
    assert [r[0] for r in rows.select(L.display_name(F.lit("N"), "m")).collect()] == ["N ሀ", "N ሀ", "N", "N"]


def test_header(spark):
    columns = "name string, name_am string, tagline string, address string, phone string, phone_label string, header_emoji string, footer_text string"
    rows = spark.createDataFrame([("Test", "ሀ", "Good", "Here", "+1 55\t5", "", "🍽", "end"), (None, "", None, "", None, None, None, None)], columns)
    full, empty = [r.h for r in rows.select(L.header_fields("Fallback").alias("h")).collect()]
    assert tuple(full) == ("🍽 Test", "ሀ • Good", "📍 Here", "tel:+1555", "📞 +1 55\t5", "end", "Test Menu | ሀ ሜኑ")
    assert tuple(empty) == ("Fallback", "", "", None, None, "", None)


def test_slugs(spark):
    assert apply(spark, X.slugify, ["Sweets & Cakes", "Desserts", " --A  b-- ", "ሀ", ""]) == ["sweets-cakes", "desserts", "a-b", "", ""]
    assert apply(spark, X.slug_valid, ["abc-1", " ABC ", "a b", "", None, "a\n"]) == [True, True, False, False, False, True]


def test_trim_and_blank(spark):
    pads = ["\t x y  ", "﻿x　", "\u0085x", " \n", "", None]
    assert apply(spark, X.blank_to_null, pads) == ["x y", "x", "\u0085x", None, None, None]
    assert apply(spark, lambda v: X.blank_to_null(v, "d"), [" ", "z"]) == ["d", "z"]


def test_numbers(spark):
    typed = ["12abc", "abc", "", None, " 1.5e2x", "-.5", "1e", "+7.", "0x10", "1.2.3"]
    assert apply(spark, X.parse_float, typed) == [12.0, 0.0, 0.0, 0.0, 150.0, -0.5, 1.0, 7.0, 0.0, 1.2]
    assert apply(spark, X.parse_int, typed) == [12, 0, 0, 0, 1, 0, 1, 7, 0, 1]


def test_escape_and_phone(spark):
    assert apply(spark, X.html_escape, ["<a href=\"x\">&'", "&amp;", None]) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;", "&amp;amp;", ""]
    assert apply(spark, X.phone_uri, ["+251 911 00\t00 00"]) == ["tel:+25191100" + "0000"]


def test_messages(spark):
    typed = ["Invalid login credentials", "EMAIL NOT CONFIRMED", "permission denied for x", "duplicate key (slug)",
             "duplicate key (id)", "NetworkError when", "else"]
    assert apply(spark, X.classify_message, typed) == [
        "bad_credentials", "unconfirmed", "denied", "duplicate_slug", "duplicate key (id)", "network", "else"]
    probe = ["relation x does not exist", "invalid JWT", "other"]
    assert apply(spark, lambda v: X.classify_message(v, V.PROBE_MESSAGE_RULES), probe) == ["tables_missing", "key_rejected", "other"]


def test_secret_scan_ignores_comments(spark):
    token = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9"
    code = ["/* service_role */ ok", "a // service_role\nb", "service_role = 1", "x // " + token, "SERVICE_ROLE_KEY: y", "clean"]
    assert apply(spark, lambda v: X.secret_hits(v, X.strip_comments(v)), code) == [
        [], [], ["service_key_word", "service_key_assigned", "service_key_assigned_raw"], ["signed_token_header"],
        ["service_key_word", "service_key_assigned", "service_key_assigned_raw"], []]
    hidden = ["go to http://x/ service_role = 1", "// service_role: a"]
    assert apply(spark, lambda v: X.secret_hits(v, X.strip_comments(v)), hidden) == [["service_key_assigned_raw"]] * 2


def test_strip_tags_and_near(spark):
    page = "<link href=\"https://fonts.x\"><script src=\"a\"></script><p>A</p><script>b</script>"
    assert apply(spark, X.strip_tags, [page]) == ["<link href=\"https://fonts.x\"><p>A</p>"]
    assert apply(spark, lambda v: X.strip_tags(v, (V.EXTERNAL_SCRIPTS, V.FONT_LINKS)), [page]) == ["<p>A</p><script>b</script>"]
    texts = ["A" + "x" * 300 + "B", "A" + "x" * 301 + "B", "B A", "A\n\nB"]
    assert apply(spark, lambda v: X.near_match(v, "A", "B"), texts) == [True, False, False, True]


def test_count_label(spark):
    assert apply(spark, lambda v: X.count_label(v, "category", "categories"), [0, 1, 2], "int") == ["0 categories", "1 category", "2 categories"]


def test_objects(spark):
    assert apply(spark, O.object_ext, ["a.PNG", "README", "x.", "a.b.j-p g", ""]) == ["png", "readme", "jpg", "jpg", "jpg"]
    keys = apply(spark, lambda v: O.object_key(v, F.lit(5), F.lit(1)), ["a.PNG", "a.PNG"])
    assert keys[0] == keys[1] and keys[0].startswith("items/5-") and keys[0].endswith(".png")
    urls = ["https://h/x/menu-images/items/1.png?v=2", "https://h/other/1.png", None]
    assert apply(spark, O.object_key_from_url, urls) == ["items/1.png", None, None]
    uploads = spark.createDataFrame([(2 * 1024 * 1024, "image/png"), (2 * 1024 * 1024 + 1, "text/x"), (1, "text/image/"), (1, None)], "s long, m string")
    assert [r[0] for r in uploads.select(O.upload_valid("s", "m")).collect()] == ["ok", "too_large", "not_image", "not_image"]
    assert apply(spark, O.media_type, ["a/b.HTML", "x.jpeg", "b.tar.gz", "noext", ".js", "a.b/c"]) == [
        "text/html; charset=utf-8", "image/jpeg"] + [V.DEFAULT_MEDIA_TYPE] * 4


def test_addresses(spark):
    assert apply(spark, O.url_base, ["https://a.b//", "x"]) == ["https://a.b", "x"]
    rule = lambda v: O.url_matches(v, r"https://[a-z0-9-]+\.host\.(co|in)")
    assert apply(spark, rule, ["https://ABC.host.co/", "http://abc.host.co", "not-a-url", None]) == [True, False, False, False]


def test_tokens(spark):
    def token(body, pad=False):
        text = base64.urlsafe_b64encode(body.encode()).decode()
        return f"e30.{text if pad else text.rstrip('=')}.sig"

    tokens = [token(json.dumps({"role": "anon"})), token(json.dumps({"role": "service_role", "x": "??>>"}), True),
              token("{}"), "e30.!!!.sig", "nodots", None, token("not json")]
    assert apply(spark, O.token_role, tokens) == ["anon", "service_role", None, None, None, None, None]
    assert apply(spark, O.token_class, tokens) == ["ok", "forbidden"] + ["unknown"] * 5
