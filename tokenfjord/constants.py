"""Fixed values of the Icelandic text conventions, and patterns built from them."""

from __future__ import annotations

import functools
import importlib.resources
import re
import unicodedata

# --- Fixed values: characters -------------------------------------------------

ACUTE, DIAERESIS = "́", "̈"
#: Vowels that are composed with the combining accents.
COMPOSED = {v + ACUTE: c for v, c in zip("aeiouyAEIOUY", "áéíóúýÁÉÍÓÚÝ", strict=True)} | {v + DIAERESIS: c for v, c in zip("aeouAEOU", "äëöüÄËÖÜ", strict=True)}
#: Soft hyphen, zero-width space, zero-width no-break space.
ZERO_WIDTH = "­​﻿"
HYPHEN, EN_DASH, EM_DASH = "-", "–", "—"
HYPHENS = HYPHEN + EN_DASH + EM_DASH
JOINING_HYPHENS = HYPHEN + EN_DASH
LEFT_PUNCTUATION = "([„‚«#$€£¥₽<"
RIGHT_PUNCTUATION = ".,:;)]!%‰?“»”’‛‘…>°"
CENTER_PUNCTUATION = '"*•&+=@©|—'
NONE_PUNCTUATION = "^/±'´~\\-–"
PUNCTUATION = LEFT_PUNCTUATION + CENTER_PUNCTUATION + RIGHT_PUNCTUATION + NONE_PUNCTUATION
SINGLE_QUOTES = "'‚‛‘´"
DOUBLE_QUOTES = '"“„”«»'
SENTENCE_ENDS = (".", "?", "!", "…")
AFTER_SENTENCE_END = (")", "]", "“", "»", "”", "’", '"', "[…]")
INSIDE_WORD = ".'‘´’-–"
ENDING_WORD = "'²³"

#: Spacing classes of tokens.
TP_LEFT, TP_CENTER, TP_RIGHT, TP_NONE, TP_WORD = 1, 2, 3, 4, 5
#: By a token's class, the classes of a next token that a space stands before.
SPACE_BEFORE = {
    TP_LEFT: {TP_CENTER},
    TP_CENTER: {TP_LEFT, TP_CENTER, TP_RIGHT, TP_NONE, TP_WORD},
    TP_RIGHT: {TP_LEFT, TP_CENTER, TP_WORD},
    TP_NONE: {TP_CENTER},
    TP_WORD: {TP_LEFT, TP_CENTER, TP_WORD},
}

# --- Fixed values: words and units --------------------------------------------

CLOCK_WORDS = {"kl", "kl.", "klukkan"}
HOURS = ("eitt", "tvö", "þrjú", "fjögur", "fimm", "sex", "sjö", "átta", "níu", "tíu", "ellefu", "tólf")
CLOCK_TIMES = {w: (k, 0, 0) for k, w in enumerate(HOURS, 1)} | {f"hálf{w}": ((k - 2) % 12 + 1, 30, 0) for k, w in enumerate(HOURS, 1)}
YEAR_WORDS = {"árið", "ársins", "árinu"}
COUNTRY_CODES = {"354", "+354", "00354"}
PHONE_STARTS = "45678"
_MONTHS = "janúar febrúar mars apríl maí júní júlí ágúst september október nóvember desember".split()
_SHORT_MONTHS = "jan feb mar apr jún júl ág ágú sep sept okt nóv des".split()
_SHORT_NUMBERS = (1, 2, 3, 4, 6, 7, 8, 8, 9, 9, 10, 11, 12)
MONTHS = {
    **{w: k for k, w in enumerate(_MONTHS, 1)},
    **{f"{w}s": k for k, w in enumerate(_MONTHS, 1) if w != "mars"},
    **dict(zip(_SHORT_MONTHS, _SHORT_NUMBERS, strict=True)),
    **{f"{w}.": k for w, k in zip(_SHORT_MONTHS, _SHORT_NUMBERS, strict=True)},
}
NAME_LIKE_MONTH = "Ágúst"
UNCERTAIN_MONTHS = {"jan", "Jan", "mar", "Mar", "júl", "Júl", "des", "Des", "Ágúst"}
MONTH_DAYS = (0, 31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
YEARS = range(1776, 2101)
AFTER_CHRIST = {"e.Kr", "e.Kr."}
BEFORE_CHRIST = {"f.Kr", "f.Kr."}
CURRENCIES = frozenset("ISK DKK NOK SEK GBP USD EUR CAD AUD CHF JPY PLN RUB CZK INR IDR CNY RMB HKD NZD SGD MXN ZAR".split())
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₽": "RUB"}
KRONA_WORDS = {"kr.", "kr", "krónur"}
_KRONA_MULTIPLES = {"þ": 1e3, "þús": 1e3, "m": 1e6, "millj": 1e6, "mljó": 1e6, "ma": 1e9, "mö": 1e9, "mlja": 1e9}
AMOUNTS = {"kr.": 1, "kr": 1, "krónur": 1, "mkr.": 1e6, "mkr": 1e6} | {f"{w}.kr{dot}": n for w, n in _KRONA_MULTIPLES.items() for dot in (".", "")}
NUMBER_WORDS = {"þús.", "millj.", "mljó.", "ma.", "mrð.", "billj.", "bljó.", "trillj."}
PERCENT_WORDS = set("prósent prósenta prósenti prósents prósentur prósentum hundraðshluti hundraðshluta hundraðshlutar hundraðshlutum prósentustig prósentustigi prósentustigs prósentustigum prósentustiga".split())
FRACTIONS = {c: unicodedata.numeric(c) for c in "↉⅒⅑⅛⅐⅙⅕¼⅓½⅖⅔⅜⅗¾⅘⅝⅚⅞"}
ODD_ORDINALS = "1sti 1sta 1stu 2svar 3svar 2ja 3ja 3ji 3ju 4ði 4ða 4ðu 4ra 5ti 5ta 5tu".split()

#: By base unit: each unit and its factor.
_UNITS = {
    "m": {"m": 1.0, "mm": 1.0e-3, "μm": 1.0e-6, "cm": 1.0e-2, "sm": 1.0e-2, "km": 1.0e3, "ft": 0.3048, "mi": 1609.34},
    "m²": {"m²": 1.0, "fm": 1.0, "km²": 1.0e6, "cm²": 1.0e-2, "ha": 1.0e4},
    "m³": {"m³": 1.0, "cm³": 1.0e-6, "km³": 1.0e9, "l": 1.0e-3, "ltr": 1.0e-3, "dl": 1.0e-4, "cl": 1.0e-5, "ml": 1.0e-6, "gal": 3.78541e-3, "bbl": 158.987294928e-3},
    "K": {"K": 1.0, "°K": 1.0, "°C": 1.0, "°F": 1.0},
    "kg": {"g": 1.0e-3, "gr": 1.0e-3, "kg": 1.0, "t": 1.0e3, "mg": 1.0e-6, "μg": 1.0e-9, "tn": 1.0e3, "lb": 0.453592},
    "s": {"s": 1.0, "ms": 1.0e-3, "μs": 1.0e-6, "klst": 3600.0, "mín": 60.0},
    "N": {"N": 1.0, "kN": 1.0e3},
    "J": {"Nm": 1.0, "J": 1.0, "kJ": 1.0e3, "MJ": 1.0e6, "GJ": 1.0e9, "TJ": 1.0e12, "kWh": 3.6e6, "MWh": 3.6e9, "kWst": 3.6e6, "MWst": 3.6e9, "kcal": 4184.0, "cal": 4.184},
    "W": {"W": 1.0, "mW": 1.0e-3, "kW": 1.0e3, "MW": 1.0e6, "GW": 1.0e9, "TW": 1.0e12},
    "V": {"V": 1.0, "mV": 1.0e-3, "kV": 1.0e3},
    "A": {"A": 1.0, "mA": 1.0e-3},
    "Hz": {"Hz": 1.0, "kHz": 1.0e3, "MHz": 1.0e6, "GHz": 1.0e9},
    "Pa": {"Pa": 1.0, "hPa": 1.0e2},
    "°": {"°": 1.0},
    "%": {"%": 1.0},
    "‰": {"‰": 0.1},
    "m/s": {"m/s": 1.0, "km/klst": 1000.0 / (60 * 60)},
}
UNITS = {unit: (base, factor) for base, units in _UNITS.items() for unit, factor in units.items()}


def in_base_unit(value: float, unit: str) -> tuple[str, float]:
    """(base unit, value in it)."""
    if unit == "°C":
        return "K", value + 273.15
    if unit == "°F":
        return "K", (value + 459.67) * 5 / 9
    base, factor = UNITS[unit]
    return base, value * factor


URI_STARTS = tuple(f"{s}://" for s in "http https file ftp ssh sftp smb git git+ssh svn svn+ssh imap rtmp rtsp telnet udp vnc irc nntp wss ws xmpp mtqp afp nfs mms tftp ldap".split())
GENERIC_DOMAINS = "com org net edu gov mil int arpa biz info xyz online site tech top space news pro club loan win vip icu app blog shop work ltd mobi live store gdn art events".split()
#: Country endings beside those of the ISO 3166 list, and ISO codes that are no ending here: territories that
#: never took up theirs (or take up another's, as gb does), and kr, which as "kr." is the currency in this language.
OTHER_DOMAINS = ("ac", "eu", "uk")
NO_DOMAINS = ("bl", "bq", "bv", "eh", "gb", "kr", "mf", "sj", "um")
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am "
    "Bk Cf Cm Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
SSN_WEIGHTS = (3, 2, 7, 6, 5, 4, 0, 3, 2)
ROMAN_DIGITS = {"M": 1000, "CM": 900, "D": 500, "CD": 400, "C": 100, "XC": 90, "L": 50, "XL": 40, "X": 10, "IX": 9, "V": 5, "IV": 4, "I": 1}
HTML_NAMES = {
    "aacute": "á", "eth": "ð", "eacute": "é", "iacute": "í", "oacute": "ó", "uacute": "ú", "yacute": "ý", "thorn": "þ", "aelig": "æ", "ouml": "ö", "Aacute": "Á", "ETH": "Ð", "Eacute": "É", "Iacute": "Í", "Oacute": "Ó", "Uacute": "Ú", "Yacute": "Ý", "THORN": "Þ", "AElig": "Æ", "Ouml": "Ö", "amp": "&", "lt": "<",
    "gt": ">", "quot": '"', "apos": "'", "bdquo": "„", "ldquo": "“", "rdquo": "”", "lsquo": "‘", "acute": "´", "lcub": "{", "rcub": "}", "darr": "↓", "uarr": "↑", "ring": "˚", "deg": "°", "diam": "⋄", "ordm": "º", "ogon": "˛", "hellip": "…", "copy": "©", "reg": "®", "trade": "™", "nbsp": " ", "ensp": " ", "emsp": " ",
    "thinsp": " ", "ndash": "–", "mdash": "—", "shy": "", "uuml": "ü", "Uuml": "Ü", "zcaron": "ž", "Zcaron": "Ž", "lstrok": "ł", "Lstrok": "Ł", "ntilde": "ñ", "inodot": "ı", "filig": "fi", "fllig": "fl",
}

# --- Patterns built from them -------------------------------------------------


@functools.cache
def domain_endings() -> frozenset[str]:
    """Top-level domains: generic ones, and the ISO 3166 country codes of the time-zone data."""
    table = importlib.resources.files("tzdata").joinpath("zoneinfo", "iso3166.tab").read_text(encoding="utf-8")
    countries = {line[:2].lower() for line in table.splitlines() if line[:2].isalpha()}
    return frozenset({*GENERIC_DOMAINS, *OTHER_DOMAINS, *countries} - set(NO_DOMAINS))


def longest_first(words) -> list[str]:  # noqa: ANN001
    return sorted(words, key=lambda w: (-len(w), w))


#: A unit that ends in a letter isn't followed by a word character.
UNIT_PATTERN = "|".join(re.escape(u) + (r"(?!\w)" if u[-1].isalpha() else "") for u in longest_first(UNITS))
SIGN_PATTERN = "|".join(map(re.escape, CURRENCY_SIGNS))
ROMAN_PATTERN = r"M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})"
MOLECULE_PATTERN = rf"((?:{'|'.join(longest_first(ELEMENTS))})+\d*)+"
HTML_PATTERN = rf"&(?:#x([0-9a-fA-F]{{1,8}})|#(\d{{1,10}})|({'|'.join(HTML_NAMES)}));"
#: White space of Python's str patterns, in Java's notation.
JAVA_SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
