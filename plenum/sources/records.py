"""Pages of the council's information system as rows: papers, agendas, agenda items, rosters and indexes.

Each parser takes a page's source and returns plain tuples; `parsed` runs one over a DataFrame of pages in
Arrow batches, one page to many rows. A page that is not there gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from plenum.functions.markup import Node, inner_html, labelled_div, parse, squished
from plenum.sources.files import MOVED, NO_INFORMATION, SIGN_IN

#: Labels in front of the parts of a paper, in the order in which they are tried.
CONTENT_LABELS = ["Sachverhalt:", "Sachverhalt", "Hintergrund:"]
RESOLUTION_LABELS = ["Petitum/Beschluss:", "Petitum/Beschlussvorschlag:", "Petitum/Beschlussempfehlung:", "Petitum/", "Petitum:", "Petitum"]
#: Names of anchors around minutes and result, of pages that links lead to, and of a form.
MINUTES_ANCHOR, DECISION_ANCHOR, END_ANCHOR = "allrisWP", "allrisBS", "allrisAE"
PERSON_PAGE, PARTY_PAGE, DOWNLOAD_FORM = "kp020", "fr020", "do027.asp"
ATTACHED_LABEL, OPENS_FILE, UNDECIDED, END_DATE = "Anlage/n:", "(Öffnet Dokument in neuem Fenster)", "(offen)", "Endedatum"


def _gone(source: str | None, *markers: str) -> bool:
    return source is None or any(m in source for m in markers)


def _number(href: str | None, name: str) -> int | None:
    found = re.search(rf"{name}=(\d+)", href or "")
    return int(found[1]) if found else None


def _first(values) -> str | None:
    return next((v for v in values if v), None)


def _frame(root: Node) -> Node | None:
    return root.find("table", "risdeco")


def _cells(node: Node, cls: str) -> list[Node]:
    return node.find_all("td", cls)


PAPER = "number string, title string, kind string, author string, content string, resolution string, attached string, non_public boolean"


def paper(source: str | None) -> list[tuple]:
    """A paper's page. One that is not for the public gives a row that says so."""
    if source is None:
        return []
    if _gone(source, NO_INFORMATION, SIGN_IN):
        return [(None,) * 7 + (True,)]
    root = parse(source)
    head = root.find("h1")
    number = squished(head.text().replace("Drucksache -", "").replace("Vorlage -", "")) if head else None
    html = _frame(root)
    if html is None:
        return []
    title = inner_html(html.find("td", "text1"))
    title = None if title is None else squished(re.sub(r"<br\s*/?>", "\n", title))
    kinds = [inner_html(n) for n in _cells(html, "text4")]
    kind = kinds[0] if kinds else None
    author = kinds[1] if len(kinds) > 1 and kind and ("Kleine Anfrage" in kind or "Große Anfrage" in kind) else None
    white = html.find("td", where=lambda n: n.attrs.get("bgcolor") == "white")
    plain = next((c for c in white.children if isinstance(c, Node) and c.tag == "div"), None) if white else None
    content = _first(labelled_div(html, x) for x in CONTENT_LABELS) or inner_html(plain)
    resolution = _first(labelled_div(html, x) for x in RESOLUTION_LABELS)
    return [(number, title, kind, author, content, resolution, labelled_div(html, ATTACHED_LABEL), False)]


MEETING = "title string, committee_id int, committee_type string, committee string, day string, time string, room string, location string, note string"


def meeting(source: str | None) -> list[tuple]:
    """An agenda's head: title, committee, "weekday, dd.mm.yyyy", "18:00 - 19:15", room, location, note."""
    if _gone(source, MOVED, SIGN_IN):
        return []
    root = parse(source)
    head, html = root.find("h1"), _frame(root)
    if html is None:
        return []
    link = next((a for td in _cells(html, "text1") for a in td.find_all("a")), None)
    href = link.attrs.get("href") if link else None
    by_committee, by_plenary = _number(href, "AULFDNR"), _number(href, "PALFDNR")
    kind = None if link is None else "au" if by_committee is not None else "pa"
    facts = _cells(html, "text2")
    at = lambda k: inner_html(facts[k]) if len(facts) > k else None
    return [(squished(head.text().replace("Tagesordnung -", "")) if head else None, by_committee if by_committee is not None else by_plenary, kind, inner_html(link), squished(at(0)), squished(facts[1].text()) if len(facts) > 1 else None, facts[2].text() if len(facts) > 2 else None, at(3), at(4))]


AGENDA = "number string, ext_id int, title string, document_ext_id int"


def agenda(source: str | None) -> list[tuple]:
    """An agenda's items, those with a number."""
    if _gone(source, MOVED, SIGN_IN):
        return []
    html, rows = _frame(parse(source)), []
    for line in html.find_all("tr", ("zl11", "zl12")) if html else ():
        number = "".join(n.text() for n in _cells(line, "text4"))
        if not number.strip():
            continue
        form = line.find("input", where=lambda n: n.attrs.get("name") == "TOLFDNR")
        cells = line.find_all("td")
        links = [a for td in line.find_all("td", where=lambda n: n.attrs.get("nowrap") == "nowrap") for a in td.find_all("a")]
        value = form.attrs.get("value", "") if form else ""
        rows.append((number, int(value) if value.isdigit() else None, cells[3].text() if len(cells) > 3 else None, _number(links[1].attrs.get("href"), "VOLFDNR") if len(links) > 1 else None))
    return rows


ITEM = "decision string, minutes string, result string"


def item(source: str | None) -> list[tuple]:
    """An agenda item's page: decision, and minutes and result between the page's named anchors."""
    if source is None:
        return []
    html = _frame(parse(source))
    if html is None:
        return []
    cell = html.find("td", "text3")
    decision = squished(cell.text()) if cell else None
    names = lambda nodes: {n.attrs.get("name") for n in nodes if n.tag == "a"}
    around = [(d, *map(names, d.before_after())) for d in html.find_all("div") if d.parent]
    between = lambda first, last=None: _first([inner for d, a, b in around if first in a and (last is None or last in b) and (inner := (inner_html(d) or "").strip())])
    return [(None if decision == UNDECIDED else decision, between(MINUTES_ANCHOR, DECISION_ANCHOR), between(END_ANCHOR) or between(DECISION_ANCHOR))]


ROSTER = "ext_id int, name string, kind string"


def roster(source: str | None) -> list[tuple]:
    """Members in the first table of links to persons; rows without link, id or name are none."""
    if _gone(source, MOVED, SIGN_IN):
        return []
    person = lambda n: PERSON_PAGE in n.attrs.get("href", "")
    table = next((t for t in parse(source).find_all("table", "tl1") if t.find("a", where=person)), None)
    rows = []
    for line in table.find_all("tr", ("zl11", "zl12")) if table else ():
        link = line.find("a", where=person)
        ident = _number(link.attrs["href"], "KPLFDNR") if link else None
        name = squished(link.text()) if link else None
        if ident is not None and name:
            rows.append((ident, name, squished("".join(n.text() for n in _cells(line, "text1")))))
    return rows


PARTY = "name string, expired boolean"


def party(source: str | None) -> list[tuple]:
    """A party's name, and whether its page shows an end date."""
    if _gone(source, MOVED, SIGN_IN):
        return []
    root = parse(source)
    head, mark = root.find("h1"), root.find("h3", "mark3")
    return [((squished(head.text()) or None) if head else None, bool(mark and END_DATE in mark.text()))]


def parties(source: str | None) -> list[tuple]:
    """(ext_id, name, kind): parties that an index links."""
    if source is None:
        return []
    links = [a for t in parse(source).find_all("table", "tl1") for a in t.find_all("a", where=lambda n: PARTY_PAGE in n.attrs.get("href", ""))]
    return [(n, squished(a.text()), None) for a in links if (n := _number(a.attrs["href"], "FRLFDNR")) is not None]


NEWEST = "ext_id int"


def newest_paper(source: str | None) -> list[tuple]:
    """The id of the first paper in an index."""
    links = [a for tr in parse(source).find_all("tr", "zl12") for a in tr.find_all("a")]
    found = _number(links[0].attrs.get("href"), "VOLFDNR") if links else None
    return [] if found is None else [(found,)]


MONTH = "ext_id int, day int, time string, title string, room string, with_agenda boolean"


def month(source: str | None) -> list[tuple]:
    """The meetings of a month's calendar: a day stands once for the rows that follow it."""
    rows, day = [], None
    for line in (tr for t in parse(source).find_all("table", "tl1") for tr in t.find_all("tr")):
        cells = line.find_all("td")
        if len(cells) < 2:
            continue
        shown = re.match(r"\d+", squished(cells[1].text()) or "")
        day = int(shown[0]) if shown else day
        link, form = line.find("a"), line.find("input", where=lambda n: n.attrs.get("name") == "SILFDNR")
        if link is not None and (found := _number(link.attrs.get("href"), "SILFDNR")) is not None:
            rows.append((found, day, None, None, None, True))
        elif link is None and form is not None and form.attrs.get("value", "").isdigit():
            room = line.find("td", "text4")
            rows.append((int(form.attrs["value"]), day, squished(cells[2].text().split("-")[0]) if len(cells) > 2 else None, squished(cells[5].text()) if len(cells) > 5 else None, room.text() if room else None, False))
    return rows


FILES = "name string, href string"


def files(source: str | None) -> list[tuple]:
    """Attachments that a page links: name and target."""
    html = _frame(parse(source))
    table = html.find("table", "tk1") if html else None
    return [(a.text(), a.attrs.get("href")) for a in table.find_all("a", where=lambda n: OPENS_FILE in n.attrs.get("title", ""))] if table else []


PROTOCOL_FORM = "query string"


def protocol_form(source: str | None) -> list[tuple]:
    """The parameters of the form that downloads the public protocol, encoded; none where there is no form."""
    if _gone(source, SIGN_IN):
        return []
    from urllib.parse import urlencode

    for form in parse(source).find_all("form", where=lambda n: n.attrs.get("action") == DOWNLOAD_FORM):
        inputs = {n.attrs.get("name"): n.attrs.get("value") for n in form.find_all("input")}
        button = form.find("input", where=lambda n: n.attrs.get("type") == "submit")
        label = f"{button.attrs.get('value')} {button.attrs.get('title')}" if button else ""
        if "Niederschrift" in label and re.search("öffent", label, re.IGNORECASE) and inputs.get("DOLFDNR"):
            return [(urlencode({k: inputs[k] for k in ("DOLFDNR", "options") if inputs.get(k)}),)]
    return []


PARSERS: dict[str, tuple[Callable, str]] = {
    "paper": (paper, PAPER), "meeting": (meeting, MEETING), "agenda": (agenda, AGENDA), "item": (item, ITEM), "roster": (roster, ROSTER), "party": (party, PARTY),
    "parties": (parties, ROSTER), "newest_paper": (newest_paper, NEWEST), "month": (month, MONTH), "files": (files, FILES), "protocol_form": (protocol_form, PROTOCOL_FORM),
}


def parsed(pages: DataFrame, kind: str, key: str = "id", source: str = "source") -> DataFrame:
    """(key, row, columns of the kind): every page's rows in order."""
    parser, schema = PARSERS[kind]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, *r) for k, s in zip(batch[key], batch[source]) for n, r in enumerate(parser(s))]
            yield pd.DataFrame(rows, columns=[key, "row", *names], dtype=object)

    return pages.select(key, source).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, row int, {schema}")
