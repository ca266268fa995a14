import datetime
import json
import zipfile

from pyspark.sql import functions as F
from support import column

from plenum.functions import markup
from plenum.plans.analogue import council
from plenum.sources import files, records, sinks, streets, tables

PAPER = """<html><h1>Drucksache - 21-7301.1 </h1><table class="risdeco"><tr><td class="text1">Neue <br>Stege</td><td class="text4">Kleine Anfrage öffentlich<td class="text4">A. Muster</tr>
<tr><td bgcolor="white"><div><p style="font-family:Arial;">Frei</p></div></td></tr><div><span>Sachverhalt:</span><p>Es fehlt <b>viel</b></p><script>x()</script></div>
<div><span>Petitum/Beschluss:</span><p>Mehr</p></div><table class="tk1"><tr><td><a title="(Öffnet Dokument in neuem Fenster)" href="a/plan.pdf">Plan</a></td></tr></table></table></html>"""
AGENDA = """<h1>Tagesordnung - Sitzung des Bauausschusses</h1><table class="risdeco"><tr><td class="text1"><a href="au010.asp?AULFDNR=55">Bauausschuss</a></td></tr>
<tr><td class="text2">Mo, 01.02.2021</td><td class="text2">18:00 - 19:15</td><td class="text2">Saal</td><td class="text2">Platz 1</td><td class="text2">offen</td></tr>
<tr class="zl11"><td><input name="TOLFDNR" value="9"></td><td class="text4">Ö 1</td><td nowrap="nowrap"><a href="x">x</a><a href="vo020.asp?VOLFDNR=77">d</a></td><td>Begrüßung</td></tr>
<tr class="zl12"><td></td><td class="text4"> </td><td></td><td>leer</td></tr><tr class="zl12"><td></td><td class="text4">Ö 2</td><td></td><td>Ende</td></tr></table>
<form action="do027.asp"><input type="hidden" name="DOLFDNR" value="5"><input name="options" value="64"><input type="submit" value="Niederschrift" title="öffentl. Teil"></form>"""
ROSTER = """<table class="tl1"><tr class="zl11"><td class="text1">Vorsitz</td><td><a href="kp020.asp?KPLFDNR=3"> Ada  Muster </a></td></tr><tr class="zl12"><td class="text1">x</td><td>ohne</td></tr><tr class="zl12"><td><a href="kp020.asp?KPLFDNR=4"> </a></td></tr></table>"""
MONTH = """<table class="tl1"><tr><td></td><td>3</td><td>18:00 - 20:00</td><td></td><td></td><td>Bauausschuss</td><td class="text4">Saal</td><input name="SILFDNR" value="8"></tr>
<tr><td></td><td> </td><td>17:00</td><td></td><td></td><td><a href="to010.asp?SILFDNR=9">Rat</a></td></tr></table>"""


def test_paper():
    (row,) = records.paper(PAPER)
    assert row[:4] == ("21-7301.1", "Neue Stege", "Kleine Anfrage öffentlich", "A. Muster")
    assert "Es fehlt <b>viel</b>" in row[4] and "script" not in row[4] and "Mehr" in row[5] and row[7] is False
    assert records.paper("x noauth.asp")[0][7] is True and records.paper(None) == [] and records.paper("") == []
    assert records.files(PAPER) == [("Plan", "a/plan.pdf")]


def test_agenda():
    assert records.meeting(AGENDA) == [("Sitzung des Bauausschusses", 55, "au", "Bauausschuss", "Mo, 01.02.2021", "18:00 - 19:15", "Saal", "Platz 1", "offen")]
    assert records.agenda(AGENDA) == [("Ö 1", 9, "Begrüßung", 77), ("Ö 2", None, "Ende", None)]
    assert records.protocol_form(AGENDA) == [("DOLFDNR=5&options=64",)]
    assert records.meeting("Object moved") == [] and records.agenda(None) == []


def test_item_and_indexes():
    page = '<table class="risdeco"><tr><td class="text3"> (offen) </td></tr><a name="allrisWP"></a><div>Debatte</div><a name="allrisBS"></a><div>Beschluss</div><a name="allrisAE"></a><div>Ergebnis</div></table>'
    ((decision, minutes, result),) = records.item(page)
    assert decision is None and minutes == "Debatte" and result == "Ergebnis"
    assert records.roster(ROSTER) == [(3, "Ada Muster", "Vorsitz")]
    assert records.month(MONTH) == [(8, 3, "18:00", "Bauausschuss", "Saal", False), (9, 3, None, None, None, True)]
    assert records.party("<h1> Liste  A</h1><h3 class='mark3'>Endedatum: heute</h3>") == [("Liste A", True)]
    assert records.newest_paper('<tr class="zl12"><td><a href="vo020.asp?VOLFDNR=12">x</a></td></tr>') == [(12,)]


def test_parsed_frames(spark):
    pages = spark.createDataFrame([(1, AGENDA), (2, None), (3, "Object moved")], "id long, source string")
    rows = records.parsed(pages, "agenda").orderBy("row").collect()
    assert [(r["id"], r["row"], r["number"], r["ext_id"]) for r in rows] == [(1, 0, "Ö 1", 9), (1, 1, "Ö 2", None)]


def test_markup(spark):
    df = spark.createDataFrame([("<head><title> T </title></head><body><p>a<p>b <nav>n</nav><a href='x'>l</a><img src=' i.png '></body>",), (None,)], "h string")
    row = df.select(markup.page_text("h"), markup.page_title("h"), markup.hrefs("h"), markup.image_sources("h"), markup.stripped("h")).first()
    assert row[0] == "a b l" and row[1] == "T" and row[2] == ["x"] and row[3] == ["i.png"]
    assert markup.inner_html(markup.parse('<p class="x" id="y">a<div>b</div><form>c</form></p>')) == '<p id="y">a</p>b' or "form" not in markup.inner_html(markup.parse("<form>c</form>"))


GML = """<?xml version="1.0"?><wfs:C xmlns:wfs="w" xmlns:dog="d" xmlns:gml="g" xmlns:iso="i"><wfs:member><dog:Strassen><iso:position><gml:Point><gml:pos>9.75 53.25</gml:pos></gml:Point></iso:position>
<dog:strassenschluessel>02;3;05</dog:strassenschluessel><dog:strassenschluessel>02;4;06</dog:strassenschluessel><dog:strassenname>Weiße-Birken-Straße</dog:strassenname><dog:ortsteilname>Tannhof,OT 0901</dog:ortsteilname><dog:ortsteilname>Seeau</dog:ortsteilname><dog:postleitzahl>10007</dog:postleitzahl></dog:Strassen></wfs:member>
<wfs:member><dog:Strassen><dog:postleitzahl>1</dog:postleitzahl></dog:Strassen></wfs:member></wfs:C>"""


def test_streets(spark, tmp_path):
    (tmp_path / "p0.xml").write_text(GML, encoding="utf-8")
    (row,) = streets.read(spark, str(tmp_path)).collect()
    assert tuple(row) == ("Weiße-Birken-Straße", "weiße birken straße", 53.25, 9.75, "Tannhof", "10007", "02;3;05", [3, 4])
    assert column(streets.page_urls(spark, "https://x.test", 4001), "start") == [0, 2000, 4000]


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<h1>Größe</h1>".encode("latin-1"))
    assert column(files.pages(spark, str(tmp_path)), "source") == ["<h1>Größe</h1>"]
    word = tmp_path / "w.docx"
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", "<d><t>Hallo</t><t>Welt</t></d>")
    assert files.extract_text("w.docx", word.read_bytes()) == "Hallo Welt"
    assert files.extract_text("p.pdf", b"%PDF-1.4\n<< /Length 1 >>\nstream\nBT (Ein \\(Satz\\)) Tj ET\nendstream") == "Ein (Satz)"
    assert files.extract_text("p.pdf", b"%PDF-1.4\n<< >>\nstream\n(\\304rger \\(a\\)) Tj\nendstream") == "Ärger (a)"
    damaged = {"cut.docx": word.read_bytes()[:30], "bad.docx": None, "deep.html": ("<div>" * 5000 + "tief").encode()}
    with zipfile.ZipFile(tmp_path / "bad.docx", "w") as z:
        z.writestr("word/document.xml", "<d><t>")
    damaged["bad.docx"] = (tmp_path / "bad.docx").read_bytes()
    found = {k: files.text_or_reason(k, v) for k, v in damaged.items()}
    assert found["cut.docx"][0] is None and found["cut.docx"][1].startswith("BadZipFile")
    assert found["bad.docx"][0] is None and found["bad.docx"][1].startswith("ParseError") and found["deep.html"] == ("tief", None)
    (tmp_path / "more").mkdir()
    for k, v in damaged.items():
        (tmp_path / "more" / k).write_bytes(v)
    rows = {r["name"]: r for r in files.attachments(spark, str(tmp_path / "more")).collect()}
    assert rows["deep.html"]["content"] == "tief" and rows["cut.docx"]["error"] and rows["bad.docx"]["content"] is None
    assert files.extract_text("x.bin", b"\0\1") is None and files.extract_text(None, None) is None and files.extract_text("t.txt", b"abc") == "abc"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], "id int, title string")
    assert column(sinks.as_json(rows), "json") == ['{"id":1,"title":null}']
    sinks.write_sitemap(spark.createDataFrame([("https://x.test/", 0.5, "daily")], "loc string, priority double, changefreq string"), str(tmp_path / "map"))
    assert "<loc>https://x.test/</loc>" in "".join(p.read_text() for p in (tmp_path / "map").glob("part-*"))
    docs = spark.createDataFrame([(1, 1, "Ein  Titel", "<p>x</p>", "voll", datetime.datetime(2021, 1, 1), datetime.datetime(2021, 1, 2))], "id long, district_id long, title string, content string, full_text string, created_at timestamp_ntz, updated_at timestamp_ntz")
    out = json.loads(sinks.article(docs, spark.createDataFrame([(1, "Altona")], "id long, name string"), "https://x.test").first()["json"])
    assert out["headline"] == "Ein Titel" and out["description"] == "x" and out["datePublished"] == "2021-01-01T00:00:00Z" and out["@type"] == "Article"


def test_tables(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.createDataFrame([(1, 2)], "document_id long, location_id long")
    tables.append(rows, base, "document_locations")
    tables.append(rows, base, "document_locations")
    assert tables.read(spark, base, "document_locations").count() == 2
    tables.refresh(rows, base, "document_locations")
    assert tables.read(spark, base, "document_locations").count() == 1
    assert tables.seeds(spark).count() == 7
    docs = spark.createDataFrame([(1, False), (2, True), (3, None)], "id long, non_public boolean")
    assert column(tables.console(spark, "select id from documents", {"documents": docs}), "id") == [1]


def test_requests(spark):
    from support import DATA

    c, today = council(spark, str(DATA)), F.lit("1998-06-15").cast("date")
    found = c.search("small economy")
    assert found["documents"].count() <= 25 and found["more_documents"].count() == 1
    assert c.search_tool("widget")["documents"].count() <= 5
    assert c.document_list(None).count() == 25 and c.meeting_list(today).count() == 25
    first = c.documents.where("title is not null").select("id", "number").first()
    assert c.document(f"a-title-{first['id']}").first()["id"] == first["id"]
    assert json.loads(c.document_json(first["number"]).first()["json"])["number"] == first["number"]
    assert c.suggest_documents("widget").count() <= 5 and c.suggest_items("beratung").count() == 5
    assert c.committee(7, today)["averages"].count() == 1
    meeting = c.meeting("x-1")
    assert meeting["items"].count() == meeting["sheet"].count() > 0
    assert c.map_markers(today).count() >= 0 and c.years().count() > 0 and c.home().first()[0] > 0
    assert c.party_list(None).count() > 0 and c.committee_list(None, today).count() > 0 and c.related(first["number"]).count() >= 0
    try:
        c.district("nowhere")
        raise AssertionError
    except LookupError:
        pass


def test_deep_and_odd_pages(spark):
    deep = "<div>" * 20_000 + "tief" + "</div>" * 20_000
    assert markup.visible_text(deep) == "tief" and markup.parse(deep).text() == "tief"
    assert markup.inner_html(markup.parse("<b>" * 3000 + "x")) == "<b>" * 3000 + "x" + "</b>" * 3000
    assert markup.visible_text("a<![foo[x]]>b<!x>c") is not None and markup.visible_text("<![ ") is not None
    rows = spark.createDataFrame([(deep,), (None,), ("<title> A </title><nav>n</nav><p>b</p>c",)], "html string")
    assert [r["p"]["text"] for r in rows.select(markup.page_parts("html").alias("p")).collect()] == [r["t"] for r in rows.select(markup.page_text("html").alias("t")).collect()]
    assert [r["p"]["title"] for r in rows.select(markup.page_parts("html").alias("p")).collect()] == [r["t"] for r in rows.select(markup.page_title("html").alias("t")).collect()] == [None, None, "A"]


def test_images_and_refresh(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"png")
    (tmp_path / "b.txt").write_bytes(b"no")
    assert [tuple(r) for r in files.images(spark, str(tmp_path)).collect()] == [("a.png", bytearray(b"png"))]
    for n in (3, 2):
        tables.refresh(spark.range(n).withColumnRenamed("id", "k"), str(tmp_path / "t"), "keys")
    assert spark.read.parquet(str(tmp_path / "t" / "keys")).count() == 2
