import datetime

import pytest
from pyspark.sql import functions as F

from plenum.functions import dates, geo, search, text
from plenum.functions.stem import stem, stems, without_stop_words


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "c string")
    return list(df.select(*columns).first())


@pytest.mark.parametrize(
    "function, given, expected",
    [
        (text.squish, "  a \n\t b  ", "a b"),
        (text.squish, None, None),
        (text.normalize_street, "Weiße-Birken-Straße", "weiße birken straße"),
        (text.normalize_street, "  Am  Ring 3 ", "am ring 3"),
        (text.normalize_location, " Altona ", "altona"),
        (text.area_key, "Tannhof/Seeau Süd", "tannhofseeau sd"),
        (text.strip_tags, "<p>a</p><p>b</p><!-- x -->", "ab"),
        (text.parameterize, "Große Anfrage: Übel & Co.", "grosse-anfrage-uebel-co"),
        (text.parameterize, "Sitzung - Ausschuss", "sitzung-ausschuss"),
        (text.parameterize, "-x--y_z é 日 ", "x-y_z-e"),
        (text.number_root, "21-6100.1.1", "21-6100"),
        (text.clean_styles, '<p style="font-family:Arial;margin-left:2cm;">x</p>', "<p>x</p>"),
        (text.clean_linebreaks, "a<br>b\r<br/> c", "a b c"),
        (text.clean_entity, "Straße (Nord)!", "Straße Nord"),
        (text.scrub_whitespace, "a<p class='x'> </p>b", "a b"),
        (lambda c: text.capture_id(c, "SILFDNR"), "to010.asp?SILFDNR=100&x=1", "100"),
        (lambda c: text.capture_id(c, "SILFDNR"), "nothing", None),
        (lambda c: text.truncate(c, 8), "abcdefghij", "abcde..."),
        (lambda c: text.truncate(c, 8), "abcdefgh", "abcdefgh"),
        (text.autolink, "see https://x.test/a.", 'see <a href="https://x.test/a" target="_blank">https://x.test/a</a>.'),
        (text.document_numbers, "21-7301.1 and 21-7301, 20-0001.1.2", ["21-7301.1", "20-0001.1.2"]),
        (text.natural_key, "Ö 6.10.1", [6, 10, 1]),
        (text.tokens, "Die Straße, 3-mal!", ["die", "straße", "3", "mal"]),
        (text.tokens, None, []),
        (lambda c: text.ngrams(text.tokens(c), 2), "a b c", ["a", "a b", "b", "b c", "c"]),
        (lambda c: text.ngrams(text.tokens(c), 2), "", []),
        (lambda c: text.word_count(c), "<p>Es wurde lange diskutiert</p>", 4),
        (lambda c: text.word_count(c), None, 0),
        (lambda c: search.excerpt(c, "lange", 5), "Es wurde sehr lange diskutiert", "...sehr lange disk..."),
        (lambda c: search.excerpt(c, "zzz", 5), "Es wurde", None),
        (lambda c: search.highlight(c, ["es"]), "Es ist es", "<mark>Es</mark> ist <mark>es</mark>"),
        (dates.parse_german_date, "Montag, 01.02.2021", datetime.date(2021, 2, 1)),
        (dates.parse_german_date, "bald", None),
        (dates.seconds, "18:05", 65100),
        (geo.district_number, "Altona", 2),
        (geo.district_number, "Elsewhere", None),
    ],
)
def test_text(spark, function, given, expected):
    assert one(spark, given, function("c")) == [expected]


def test_addresses_and_numbers(spark):
    df = spark.createDataFrame([("Testallee", "22305", "Barmbek-Nord"), ("Testallee", None, "")], "n string, p string, q string")
    assert [r[0] for r in df.select(text.address("n", "p", "q")).collect()] == ["Testallee, 22305 Barmbek-Nord", "Testallee"]
    df = spark.createDataFrame([(1234, 4500, 3 * 1024**3)], "a long, b long, c long")
    assert list(df.select(text.german_number("a"), text.hours("b"), text.human_size("c"), text.band("a")).first()) == ["1.234", "1,25 h", "3.0 GB", "danger"]


def test_times(spark):
    df = spark.createDataFrame([("18:00 - 19:15",), ("18:00",), ("bald",)], "t string")
    assert [tuple(r) for r in df.select(*dates.split_times("t")).collect()] == [(64800, 69300), (64800, 64800), (None, None)]
    rows = spark.createDataFrame([("2021-02-01", 64800, 69300, 60), ("2021-02-01", 64800, None, 3600), ("2021-02-01", 64800, None, None)], "date string, start_sec int, end_sec int, average_duration int").withColumn("date", F.to_date("date"))
    assert [str(r[0]) for r in rows.select(dates.ends_at()).collect()] == ["2021-02-01 19:15:00", "2021-02-01 19:00:00", "2021-02-01 22:00:00"]


def test_points(spark):
    df = spark.createDataFrame([("10.03 53.58",), ("53.58 10.03",), (None,)], "p string")
    assert [tuple(r) for r in df.select(*geo.ordered_point("p")).collect()] == [(53.58, 10.03), (53.58, 10.03), (None, None)]
    keys = spark.createDataFrame([(["02;4;06", "02;3;05", "02;4;01", "bad"],)], "k array<string>")
    assert keys.select(geo.key_districts("k")).first()[0] == [3, 4]


def test_links(spark):
    df = spark.createDataFrame([("siehe 21-0001.1 und 21-0001.1.2, 99-9999.9",)], "c string")
    known = F.create_map(F.lit("21-0001.1"), F.lit(5), F.lit("21-0001.1.2"), F.lit(6))
    out = df.select(text.link_numbers("c", known)).first()[0]
    assert out == 'siehe <a href="/documents/5">21-0001.1</a> und <a href="/documents/6">21-0001.1.2</a>, 99-9999.9'


def test_query_terms():
    assert search.terms("  Straßen-Bau, 21-4776!  bau Bau ") == ["straßenbau", "214776", "bau"]
    assert search.terms("?!") == []


@pytest.mark.parametrize("word, expected", [("aufeinander", "aufeinand"), ("kategorischen", "kategor"), ("häuser", "haus"), ("straßen", "strass"), ("jugendlichen", "jugend"), ("freundlichkeit", "freundlich"), ("ergebnisse", "ergebnis"), ("a", "a"), ("", "")])
def test_stems(word, expected):
    assert stem(word) == expected


def test_stems_in_frames(spark):
    df = spark.createDataFrame([(["die", "häuser"],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(stems("w")).collect()] == [["die", "haus"], None]
    assert df.select(without_stop_words(F.col("w"))).first()[0] == ["häuser"]
