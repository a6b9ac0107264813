"""Recognisers of German clinical texts, put together from word lists.

(?U) gives \\w, \\s, \\d and \\b their Unicode meaning; rules that ignore case use (?iuU). Each rule has an anchor: something
short that any match has in it and most texts lack. Only texts with the anchor are searched.
"""

from __future__ import annotations

from dataclasses import dataclass

from .grammar import chain, either, enclosed, numbers, optional, spelled, unless, whole


@dataclass(frozen=True)
class Rule:
    """``group`` 1 is only for patterns that end where their group ends. ``anchor`` is a pattern, or a literal in a tuple."""

    rule_id: str
    pattern: str
    entity_type: str
    confidence: float
    group: int = 0
    subtype: str | None = None
    anchor: str | tuple[str] = ""


# Months.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
# Labels before a birth date, a telephone number and an identifier. What may be missing: see ``spelled``.
BIRTH_LABELS = ("Geburtsdatum", "Geb.. - Datum", "Geb.. - Dat.", "geboren  am", "geboren", "geb..")
PHONE_LABELS = ("Telefon", "Telefax", "Tel.", "Fax", "Mobil", "Handy")
ID_LABELS = ("Pat.. - Nr.", "Patientennummer", "Patienten-ID", "Fallnummer", "Fall-Nr.", "Aufnahmenummer", "Aufnahme-Nr.", "Versichertennummer", "Versicherten-Nr.", "KV-Nummer", "Befundnummer", "Befund-Nr.", "Proben-ID", "Auftragsnummer", "Auftrags-Nr.", "Aktenzeichen")
# How names of streets end.
STREETS = "straße strasse str. weg platz allee gasse ring damm ufer".split()
# Units of a hospital; the first only with what it is for or like.
CLINIC, UNITS = "Klinik", "Poliklinik Tagesklinik Abteilung Institut Zentrum Sektion Ambulanz".split()
# Capitalised words that are neither a unit's adjective nor its specialty.
STOPS = (
    "Prof Dr Herr Frau Sehr Tel Fax Chefarzt Chefärztin Oberarzt Oberärztin Der Die Das Dem Den Ein Eine Es Wir Am Im In Bei Nach Von Vom Zur Zum "
    "Unsere Unserer Diese Dieser Seine Ihre Jede Alle Keine Ende Anfang Mitte Uhr Datum"
).split() + MONTHS
# Labels of fields whose value shouldn't be readable in an output.
FIELDS = ("Patientin", "Patient", "Name", "Anschrift", "Adresse", "Wohnhaft")

#: White space within a line; where a set is needed, its usual members.
SPACE, SPACES = r"[^\S\r\n]", r" \t\xA0"
GAP = r"[ \t]+"
UPPER, LOWER = "A-ZÄÖÜ", "a-zäöüß"

day, month = numbers(1, 31), numbers(1, 12)
year = either(f"{century}\\d{{2}}" for century in (19, 20))
dotted_date = rf"{day}\.\s?{month}\.{either((year, r'\d{2}'))}"
iso_date = f"{year}-{numbers(1, 12, padded=True)}-{numbers(1, 31, padded=True)}"
named_date = rf"{day}\.\s?{either(MONTHS)}\s{year}"


def labelled(labels: tuple[str, ...], between: str, value: str) -> str:
    """A label, white space with a sign in it, and the value as group 1."""
    return rf"{either(map(spelled, labels))}\s*{between}\s*({value})"


def digits_of(sign: str, low: int, high: int) -> str:
    """Digits with what stands between them, which end in a digit."""
    return rf"{sign}[\d{SPACES}()/\-]{{{low},{high}}}\d"


adjective = f"{unless(STOPS)}[{UPPER}][{LOWER}]+e"
specialty = f"{unless(STOPS)}[{UPPER}][{UPPER}{LOWER}]*-?"
listed = either((rf"(?<=-),[ \t]*", rf"{GAP}und{GAP}", GAP))
clinic = CLINIC + optional(f"{GAP}und{GAP}{UNITS[0]}")
unit = either([clinic, *UNITS])
capitalised = f"[{UPPER}][{LOWER}]+"
street = either(f"[{w[0].upper()}{w[0]}]{w[1:].replace('.', chr(92) + '.')}" for w in STREETS)
house = rf"\d{{1,4}}{optional(SPACE + '?[a-hA-H]')}"
number_of_unit = optional(rf"{GAP}{either(('[IVX]{1,4}', r'\d{1,2}'))}\b")

#: In the order of detection.
RULES = (
    Rule("de.email.v1", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "EMAIL", 0.99, anchor=("@",)),
    Rule("de.url.v1", rf"(?iuU)\b{either(('https?://', r'www\.'))}[^\s<>\"']+", "URL", 0.95, anchor=r"://|(?i)www\."),
    Rule("de.iban.v1", "(?U)" + whole(rf"[A-Z]{{2}}\d{{2}}(?:{SPACE}?[A-Z0-9]{{4}}){{3,7}}(?:{SPACE}?[A-Z0-9]{{1,3}})?"), "ID_NUMBER", 0.95, subtype="iban", anchor=r"[A-Z]{2}(?U)\d{2}"),
    Rule("de.phone.labelled.v1", rf"(?iuU)\b{labelled(PHONE_LABELS, '[:.]?', digits_of(r'\+?[\d(]', 4, 20))}", "PHONE", 0.95, 1, anchor="(?i)tel|fax|mobil|handy"),
    Rule("de.phone.intl.v1", rf"(?U){digits_of(r'\+49', 5, 16)}", "PHONE", 0.90, anchor=("+49",)),
    Rule("de.dob.labelled.v1", rf"(?iuU){labelled(BIRTH_LABELS, ':?', either((dotted_date, iso_date, named_date)))}", "DATE_OF_BIRTH", 0.97, 1, anchor="(?i)geb"),
    Rule("de.date.numeric.v1", "(?U)" + whole(dotted_date), "OTHER_DATE", 0.90, anchor=r"(?U)\d\.\s?\d"),
    Rule("de.date.iso.v1", "(?U)" + whole(iso_date), "OTHER_DATE", 0.90, anchor=r"(?U)\d-\d"),
    Rule("de.date.written.v1", "(?U)" + whole(named_date), "OTHER_DATE", 0.90, anchor=r"(?U)\d\.\s?\p{Lu}"),
    Rule("de.id.labelled.v1", f"(?iuU){labelled(ID_LABELS, ':?', enclosed('A-Za-z0-9', r'\-/.', 25))}", "ID_NUMBER", 0.95, 1, anchor=r"(?i)p(?:at\.|atienten|roben)|a(?:ufnahme|uftrag|ktenz)|fall-?n|versicherten|kv-?n|befund"),
    Rule("de.id.pattern.v1", "(?U)" + whole(r"[A-Z]{2,5}-\d{4,10}"), "ID_NUMBER", 0.80, anchor=r"[A-Z]-(?U)\d"),
    Rule("de.address.street.v1", "(?U)" + whole(rf"(?:[{UPPER}][\wäöüß\-]*{SPACE}+){{0,2}}[\wäöüß\-]*{street}{SPACE}+{house}"), "ADDRESS", 0.90, subtype="street", anchor=rf"(?U)[eg.mrz]{SPACE}+\d"),
    Rule("de.address.plz_city.v1", rf"(?U)\b\d{{5}}{SPACE}+{capitalised}(?:{either((SPACE, '-'))}{capitalised})*", "ADDRESS", 0.85, subtype="plz_city", anchor=rf"(?U)\d{SPACE}+\p{{Lu}}"),
    Rule("de.org.department.v1", rf"(?U)\b{optional(adjective + GAP)}{unit}{GAP}für{GAP}{chain(specialty, listed, 1, 6)}", "ORGANIZATION", 0.85, subtype="department", anchor=r"[ \t]für[ \t]"),
    Rule("de.org.unit.v1", rf"(?U)\b{either((f'{adjective}{GAP}{unit}{number_of_unit}', f'{either(UNITS)}{GAP}{chain(specialty, listed, 1, 2)}'))}", "ORGANIZATION", 0.75, subtype="department", anchor=either([CLINIC, *UNITS])),
    Rule("de.org.ward.v1", rf"(?U)\b{either(('Station', 'Haus'))}{GAP}[A-Z0-9][A-Za-z0-9ÄÖÜäöüß\-/]{{0,15}}\b", "ORGANIZATION", 0.75, subtype="ward", anchor=r"(?:Station|Haus)[ \t]"),
)

#: A label, a colon, then what looks like a value that isn't a placeholder; group 1 is the value.
LABELLED_FIELD = rf"(?U){either(FIELDS)}\s*:\s*([{UPPER}][^\n]{{2,40}})"
#: How labels of fields end.
FIELD_ANCHOR = r"(?U)[nte]\s*:"
YEAR_ANYWHERE = either(f"{century}\\d\\d" for century in (19, 20))
