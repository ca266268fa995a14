"""Column functions on text. All are built-in expressions that stay in generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
DOCUMENT_NUMBER = r"\d{2}-\d{4}(?:\.\d{1,2})+"
WORD = r"[\p{IsAlphabetic}\p{M}\p{Nd}]+"
#: Style rules that cleaning removes, in the order in which they are applied.
STYLE_DELETIONS = [
    r"font-family:([^;]*);", r"font-size:([^;]*);", r"line-height:([^;]*);", r"color:#0000ff;", r"margin-*([^:]*):([^;]*);", r"padding-*([^:]*):([^;]*);",
    r"text-indent([^:]*):([^;]*);", r'<span style="">(\s*)</span>', r"<p([^>]*)></p>", r"<span [^>]*></span>",
]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squish(c) -> Column:
    """Trimmed, with each run of white space as one blank."""
    return F.trim(F.regexp_replace(col(c), r"[\s ]+", " "))


def blank_to_null(c) -> Column:
    """Null where nothing but white space is left."""
    return F.when(F.length(F.trim(col(c))) > 0, col(c))


def presence(*columns) -> Column:
    """The first column that is not blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def normalize_location(c) -> Column:
    """Lower case without outer blanks."""
    return F.trim(F.lower(col(c)))


def normalize_street(c) -> Column:
    """Lower case, with each run of anything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^\p{IsAlphabetic}\p{M}\p{Nd}]+", " "))


def area_key(c) -> Column:
    """Lower case of ASCII word characters and blanks only; letters beyond ASCII vanish."""
    return F.lower(F.regexp_replace(col(c), r"[^\w ]", ""))


def clean_entity(c) -> Column:
    """Letters of the German alphabet, digits, hyphens and blanks only."""
    return F.regexp_replace(col(c), r"(?iu)[^0-9a-zöäüß\- ]", "")


def tokens(c) -> Column:
    """Runs of letters and digits of the lower-cased text; null gives none."""
    return F.regexp_extract_all(F.coalesce(F.lower(col(c)), F.lit("")), F.lit(WORD), F.lit(0))


def ngrams(words: Column, most: int) -> Column:
    """All runs of 1 to `most` consecutive words, joined by a blank, in order of their first word."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    lengths = lambda i: F.sequence(F.lit(1), F.least(F.lit(most), F.size(words) - i + 1))
    return F.flatten(F.transform(starts, lambda i: F.transform(lengths(i), lambda n: F.array_join(F.slice(words, i, n), " "))))


def strip_tags(c) -> Column:
    """The text between tags and comments; tags vanish without a blank."""
    return F.regexp_replace(col(c), r"(?s)<!--.*?-->|</?[a-zA-Z!?][^>]*>", "")


def word_count(*columns) -> Column:
    """Words of the given markup columns together, tags apart; null counts 0."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.regexp_count(strip_tags(c), F.lit(r"\S+")), F.lit(0))
    return total


def full_text(content, resolution) -> Column:
    """Stripped content, and after a blank the stripped resolution where there is one."""
    tail = F.when(F.length(F.trim(F.coalesce(col(resolution), F.lit("")))) > 0, F.concat(F.lit(" "), strip_tags(resolution))).otherwise(F.lit(""))
    return F.concat(F.coalesce(strip_tags(content), F.lit("")), tail)


def clean_styles(c) -> Column:
    """Markup without the layout that editors leave in it."""
    out = col(c)
    for pattern in STYLE_DELETIONS:
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(out, ' style="">', ">")


def clean_linebreaks(c) -> Column:
    """Line-break tags as white space, then squished."""
    return squish(F.regexp_replace(F.regexp_replace(col(c), r"<br\s*/?>", "\n"), "\r", ""))


def scrub_whitespace(c) -> Column:
    """Spans and paragraphs that hold blanks only become a blank."""
    return F.regexp_replace(F.regexp_replace(col(c), r"<span[^>]*>[  ]*</span>", " "), r"<p[^>]*>[  ]*</p>", " ")


def autolink(c) -> Column:
    """Bare http(s) urls as links that open elsewhere."""
    return F.regexp_replace(col(c), r"""(?<!["'>=])(https?://[^\s<>"']*[^\s<>"'.,;:!?)])""", '<a href="$1" target="_blank">$1</a>')


def link_images(c, base: str = "/images/") -> Column:
    """Image sources by file name below base."""
    return F.regexp_replace(col(c), r'img src="(?:[^"]*/)?([^"/]*)"', f'img src="{base}$1" class="img-fluid"')


def capture_id(c, name: str) -> Column:
    """The number after name= in a link, or null."""
    return F.nullif(F.regexp_extract(col(c), name + r"=(\d+)", 1), F.lit(""))


def document_numbers(c) -> Column:
    """All document numbers that a text cites, in order."""
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(f"({DOCUMENT_NUMBER})"), F.lit(1))


def number_root(c) -> Column:
    """A document number up to its first dot."""
    return F.split(col(c), r"\.")[0]


def natural_key(c) -> Column:
    """The numbers in an agenda number, so that 10 sorts after 9; null and none give no numbers, one beyond a bigint is null."""
    digits = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(\d+)"), F.lit(1))
    return F.transform(digits, lambda d: d.try_cast("bigint"))


#: Lower-case letters as the German rule and the general one spell them in addresses.
SPELLED = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij", "ŋ": "ng", "ð": "d", "đ": "d", "ø": "o", "ħ": "h", "ı": "i", "ĸ": "k", "ł": "l", "ŧ": "t"}
#: Accented Latin letters with the letter that they are built on.
BUILT_ON = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xE0, 0x180)) if c.islower() and c not in SPELLED and unicodedata.normalize("NFD", c)[0].isascii()}


def parameterize(c) -> Column:
    """A text as a part of an address: lower-case ASCII letters, digits, _ and single hyphens, which stand for runs of all else."""
    out = F.lower(col(c))
    for letter, spelled in SPELLED.items():
        if len(spelled) > 1:
            out = F.replace(out, F.lit(letter), F.lit(spelled))
    single = BUILT_ON | {k: v for k, v in SPELLED.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    out = F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9_\-]+", "-"), "-{2,}", "-")
    return F.regexp_replace(out, "^-|-$", "")


def slug(c, key) -> Column:
    """Address part with the row's id at its end."""
    return F.concat_ws("-", parameterize(c), col(key).cast("string"))


def slug_id(c) -> Column:
    """The id at the end of a slug."""
    return F.element_at(F.split(col(c), "-"), -1).try_cast("bigint")


def address(name, postal_code, quarter) -> Column:
    """"Street, 12345 Quarter", leaving out what is blank."""
    locality = F.concat_ws(" ", blank_to_null(postal_code), blank_to_null(quarter))
    return F.concat_ws(", ", blank_to_null(name), blank_to_null(locality))


def truncate(c, most: int) -> Column:
    """At most `most` characters, the last three dots where something is cut."""
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most - 3), F.lit("..."))).otherwise(col(c))


def german_number(c, digits: int = 0) -> Column:
    """1234.5 as 1.234,5."""
    return F.translate(F.format_number(col(c), digits), ",.", ".,")


def hours(seconds) -> Column:
    """Seconds as hours with two digits: 1,25 h."""
    return F.concat(german_number(col(seconds) / 3600.0, 2), F.lit(" h"))


def human_size(c, largest: str = "TB") -> Column:
    """Bytes in the largest unit that leaves at least one, with one digit; no unit is over `largest`."""
    units = ["KB", "MB", "GB", "TB"]
    out = F.concat(col(c).cast("string"), F.lit(" Bytes"))
    for power, unit in enumerate(units[: units.index(largest) + 1], 1):
        out = F.when(col(c) >= 1024**power, F.concat(F.replace(F.format_number(col(c) / float(1024**power), 1), F.lit(",")), F.lit(f" {unit}"))).otherwise(out)
    return out


def band(percent, medium: float = 50, high: float = 80) -> Column:
    """One of three levels of a percentage."""
    return F.when(col(percent) >= high, "danger").when(col(percent) >= medium, "warning").otherwise("success")


def has_marker(c, *markers: str) -> Column:
    """Whether a page holds any of the markers, as pages for the signed-in or moved ones do."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(col(c), F.lit(m))
    return out


def query_string(pairs: dict) -> Column:
    """name=value pairs joined by &, values percent-encoded."""
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(col(v) if isinstance(v, Column) else F.lit(str(v)))) for k, v in pairs.items()])


def link_numbers(content, known: Column, prefix: str = "/documents/") -> Column:
    """Cited document numbers as links, those in the map `known` (number -> id) only."""
    cited = F.array_sort(F.array_distinct(document_numbers(content)), lambda a, b: F.length(b) - F.length(a))
    link = lambda n: F.concat(F.lit(f'<a href="{prefix}'), known[n].cast("string"), F.lit('">'), n, F.lit("</a>"))
    swap = lambda text, n: F.when(known[n].isNotNull(), F.regexp_replace(text, F.concat(F.lit(r"(?<![\d.>-])"), F.regexp_replace(n, r"\.", r"\\."), F.lit(r"(?![\d]|\.\d|</a>)")), link(n))).otherwise(text)
    return F.aggregate(cited, col(content), swap)
