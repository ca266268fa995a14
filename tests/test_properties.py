from hypothesis import given, settings
from hypothesis import strategies as st

from plenum.functions import markup, search
from plenum.functions.stem import stem
from plenum.sources import files, records

PIECES = st.lists(st.sampled_from(["<table class='risdeco'>", "<tr class='zl11'>", "<td class='text4'>", "<td>", "</td>", "</table>", "<a href='kp020.asp?KPLFDNR=3'>", "</a>", "<div>", "</div>", "<p>", "text ", "<!-- c -->", "<br/>", "&amp;", "<span>Sachverhalt:</span>", "<table class='tl1'>", "<h1>", "<", ">", "\x00"]), max_size=40).map("".join)


@given(PIECES)
@settings(max_examples=150, deadline=None)
def test_parsers_take_any_page(source):
    for parser, schema in records.PARSERS.values():
        width = len(schema.split(", "))
        assert all(len(row) == width for row in parser(source))


@given(st.text())
@settings(max_examples=100, deadline=None)
def test_markup_keeps_text(text):
    escaped = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    assert " ".join(markup.parse(f"<p>{escaped}</p>").text().split()) == " ".join(text.replace("\r", "\n").split()) or "\x00" in text or any(ord(c) < 32 for c in text)
    assert markup.visible_text(f"<script>{escaped}</script>") == ""


@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyzäöüß", max_size=20))
def test_stems_are_short(word):
    assert len(stem(word)) <= len(word.replace("ß", "ss")) and not set(stem(word)) & set("äöüß")


@given(st.text())
def test_terms_are_plain(query):
    found = search.terms(query)
    assert all(t and t == t.lower() and all(c.isalnum() for c in t) for t in found) and len(set(found)) == len(found)


@given(st.binary(max_size=300))
def test_any_file(content):
    text = files.extract_text("f.bin", content) if content[:4] != b"PK\x03\x04" else None
    assert text is None or isinstance(text, str)
