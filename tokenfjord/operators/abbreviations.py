"""The abbreviation dictionary and the forms derived from it.

A dictionary is text of the form ::

    [abbreviations]
    abbr. = "meaning" gender class      # a comment
    [not_abbreviations]
    "word"

``*`` after an abbreviation lets it end a sentence, ``!`` makes it a plain word
at the end of a sentence, and ``^`` marks titles that names may follow. The
built-in dictionary below is small; ``load`` reads a full one from a path.
"""

from __future__ import annotations

import functools
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Meaning(NamedTuple):
    """One meaning of a form: its base form, a number, gender or kind, class, the form, and inflection."""

    stofn: str
    utg: int
    ordfl: str
    fl: str
    ordmynd: str
    beyging: str


class ConfigError(Exception):
    """A dictionary is not well formed."""


# Common Icelandic abbreviations with their meanings, in order.
BUILT_IN = """
[abbreviations]
BSRB = "Bandalag starfsmanna ríkis og bæja" hk
COVID = "Coronavirus Disease" kvk
COVID-19 = "Coronavirus Disease - 2019" kvk
DR = "Danmarks Radio" hk
DV = "Dagblaðið - Vísir" hk
EES = "Evrópska efnahagssvæðið" hk
EM = "Evrópumeistaramót" hk
ESB = "Evrópusambandið" hk
GMT = "Greenwich Mean Time" hk
IBM = "International Business Machines" hk
ISK = "íslenskar krónur" kvk
Mbl = "Morgunblaðið" hk
ME = "Menntaskólinn á Egilsstöðum" kk
MIT = "Massachusetts Institute of Technology" hk
OR = "Orkuveita Reykjavíkur" kvk
PC = "Personal Computer" kvk
UEFA = "Union of European Football Associations" hk
MW = "megawött" hk
MWst = "megawattstund" kvk
A3 = "A3 stærð" hk
A4 = "A4 stærð" hk
a.m.k.* = "að minnsta kosti" ao frasi
alg.* = "algengur" lo
alm.* = "almennur" lo
ath. = "athuga" so
d. = "dáinn" lo
dags.! = "dagsetja" so
dags.! = "dagsettur" lo
dr. = "doktor" kk
e.h.* = "eftir hádegi" ao frasi
e.Kr.* = "eftir Krist" ao frasi
e.kr.* = "eftir Krist" ao frasi
erl.* = "erlendur" lo
erl.* = "erlendis" ao
f.h.* = "fyrir hádegi" ao frasi
f.h.* = "fyrir hönd" fs frasi
f.h.* = "frá hægri" ao frasi
f.Kr.* = "fyrir Krist" ao frasi
f.kr.* = "fyrir Krist" ao frasi
frák.* = "fráköst" hk
fyrrn. = "fyrrnefndur" lo
gr.* = "grein" kvk
gr.* = "greinir" kk
gr.* = "greiðsla" kvk
gr.* = "grískur" lo
gr.* = "gramm" hk
helv. = "helvítis" ao
helv. = "helvíti" hk
helv. = "helvískur" lo
hr. = "herra" kk
hæstv. = "hæstvirtur" lo
kl. = "klukkan" ao
kt. = "kennitala" kvk
kt. = "karat" hk
kvk.* = "kvenkyn" hk
kvk.* = "kvenkyns" ao
lögg.! = "löggiltur" lo
m.* = "með" fs
m.a. = "meðal annars" ao frasi
m.a. = "meðal annarra" ao frasi
msk.* = "matskeið" kvk
m.v. = "miðað við" fs frasi
mín.! = "mínúta" kvk
nk.* = "næstkomandi" lo
nr.! = "númer" hk
núv. = "núverandi" lo
o.s.frv.* = "og svo framvegis" ao frasi
ps. = "eftirskrift" kvk
próf.^ = "prófessor" kk
próf.^ = "prófastur" kk
rknr. = "reikningsnúmer" hk
samt.! = "samtals" ao
sk.* = "svokallaður" lo
sk.* = "skyldur" lo
skst.* = "skammstöfun" kvk
skst.* = "skammstafaður" lo
skv. = "samkvæmt" fs
sl.* = "síðastliðinn" lo
sn.* = "svonefndur" lo
st.* = "samtenging" kvk
st.* = "stig" hk
stk.* = "stykki" hk
sérfr.* = "sérfræðingur" kk
s.* = "símanúmer" hk
t.a.m.* = "til að mynda" ao frasi
t.d. = "til dæmis" ao frasi
t.h.* = "til hægri" ao frasi
t.v.* = "til vinstri" ao frasi
vs. = "gegn" fs
örn.! = "örnefni" hk
þ.* = "þýska" kvk
þ.* = "þing" hk
þ.a. = "þannig að" st frasi
þ.e. = "það er" ao frasi
þ.e.a.s. = "það er að segja" ao frasi
þ.á.m.* = "þar á meðal" ao frasi
barnal.* = "barnalögin" hk
fmrh.* = "fjármálaráðherra" kk
form.! = "formaður" kk
frv.* = "frumvarp" hk
hv. = "hæstvirtur" lo
hv. = "háttvirtur" lo
mgr.* = "málsgrein" kvk
þm. = "þingmaður" kk
nf.* = "nefnifall" hk
þf.* = "þolfall" hk
þgf.* = "þágufall" hk
ef.! = "eignarfall" hk
jún.* = "júní" kk
sep.* = "september" kk
nóv.* = "nóvember" kk
þri.* = "þriðjudagur" kk
M.Sc. = "Master of Science" hk erl
Ph.D.* = "Doctor of Philosophy" hk erl
hsf.* = "húsnæðissamvinnufélag" hk
ehf.* = "einkahlutafélag" hk
AS = "Aktieselskab" hk erl
Rvk.* = "Reykjavík" kvk
kr.* = "krónur" kvk
þús.* = "þúsund" hk
millj.* = "milljónir" kvk
millj.* = "milljarðar" kk
mrð.* = "milljarðar" kk
þús.kr.* = "þúsundir króna" kvk
m.kr.* = "milljónir króna" kvk
ma.kr.* = "milljarðar króna" kk
mö.kr.* = "milljörðum króna" kk
C.* = "C"
K. = "K"
S. = "S"
Th = "Th"
St = "St"
Th. = "Th"
St. = "St"
C = "kolefni" hk
F = "flúor" hk
I = "joð" hk
K = "kalíum" hk
N = "nitrogenium - köfnunarefni" hk
O = "oxygenium - súrefni" hk
P = "phosphorus - fosfór" kk
S = "sulphur - brennisteinn" kk
Th = "þóríum" hk
U = "úran" hk
V = "vanadíum" hk
W = "volfram" hk
Y = "yttríum" hk
km.* = "kílómetri" kk
cm.* = "sentímetri" kk
kcal.* = "kílókaloría" kvk

[not_abbreviations]
"aka"
"ál"
"belg"
"beyg"
"dags"
"dós"
"ef"
"ek"
"fá"
"fær"
"form"
"ha"
"höf"
"lit"
"lögg"
"mas"
"mín"
"ná"
"óp"
"örn"
"pól"
"sá"
"sæ"
"samt"
"sek"
"teikn"
"ys"
"þá"
"þul"
"þý"
"þýð"
"""


class Abbreviations:
    """Meanings by abbreviation, and the sets that the sentence rules ask for."""

    def __init__(self, text: str = BUILT_IN) -> None:
        self.right: dict[str, list[Meaning]] = {}
        #: Forms with dots missing.
        self.wrong: dict[str, list[Meaning]] = {}
        self.corrections: dict[str, list[str]] = {}
        self.all_meanings: set[str] = set()
        #: Abbreviations with one dot, at their end, without it.
        self.single: set[str] = set()
        self.dotless: set[str] = set()
        self.finishers: set[str] = set()
        self.not_finishers: set[str] = set()
        self.name_finishers: set[str] = set()
        section, never = "", set()
        for number, raw in enumerate(text.split("\n"), 1):
            line = raw.partition("#")[0].strip()
            if not line:
                continue
            if line.startswith("["):
                if line not in ("[abbreviations]", "[not_abbreviations]"):
                    raise ConfigError(f"line {number}: no such section")
                section = line
            elif section == "[abbreviations]":
                self._read(line, number)
            elif section:
                if len(line) < 3 or line[0] != '"' or line[-1] != '"':
                    raise ConfigError(f"line {number}: a word in double quotes is expected")
                never.add(line[1:-1])
            else:
                raise ConfigError(f"line {number}: content outside a section")
        for word in never:
            self.wrong.pop(word, None)

    def _read(self, line: str, number: int) -> None:
        name, equals, rest = (x.strip() for x in line.partition("="))
        quoted = rest.split('"')
        if not equals or not name or len(quoted) < 3:
            raise ConfigError(f'line {number}: expected abbreviation = "meaning"')
        gender, word_class = [*quoted[-1].split()[:2], None, None][:2]
        self.add(name, quoted[1], gender or "hk", word_class)

    def add(self, name: str, meaning: str, gender: str, word_class: str | None = None) -> None:
        """Enter an abbreviation and the forms it takes when dots are forgotten."""
        flag = name[-1] if name[-1] in "*!^" else ""
        name = name.removesuffix(flag) if flag else name
        if flag and not name.endswith("."):
            raise ConfigError(f"{name}: only abbreviations that end with a dot take {flag}")

        def enter(table: dict[str, list[Meaning]], form: str) -> None:
            entry = Meaning(meaning, 0, gender, word_class or "skst", form, "-")
            if entry not in table.setdefault(form, []):
                table[form].append(entry)

        enter(self.right, name)
        self.all_meanings.add(meaning)
        dots = [i for i, c in enumerate(name) if c == "."]
        if dots == [len(name) - 1]:
            bare = name[:-1]
            self.single.add(bare)
            self.corrections.setdefault(bare, []).append(name)
            if flag == "*":
                self.finishers.add(bare)
            if len(bare) > 1:  # single letters are initials of names
                enter(self.wrong, bare)
        elif dots:
            missing = [(i,) for i in dots]
            if len(dots) > 2:
                missing += combinations(dots[:3], 2)
            missing.append(tuple(dots))
            for gone in missing:
                form = "".join(c for i, c in enumerate(name) if i not in gone)
                self.corrections.setdefault(form, []).append(name)
                enter(self.wrong, form)
            self.dotless.add(name.replace(".", ""))
        if flag:
            {"*": self.finishers, "!": self.not_finishers, "^": self.name_finishers}[flag].add(name)

    def has_meaning(self, form: str) -> bool:
        return form in self.right or form in self.wrong

    def has_abbreviation(self, meaning: str) -> bool:
        return meaning in self.all_meanings

    def meanings(self, form: str) -> list[Meaning] | None:
        """Of a right form, or else of one with dots missing."""
        return self.right.get(form) or self.wrong.get(form)

    def right_meanings(self, form: str) -> list[Meaning] | None:
        """Of a right form, as it stands or in lower case."""
        return self.right.get(form) or self.right.get(form.lower())

    def takes_dot(self, word: str) -> bool:
        """Whether a word is an abbreviation when a dot follows."""
        if "." in word or word in self.single:
            return True
        return word.lower() in self.single and word not in self.right


@functools.lru_cache(maxsize=8)
def load(path: str | None = None) -> Abbreviations:
    """The dictionary at a path that this process can open, or the built-in one."""
    if path is None:
        return Abbreviations()
    with open(path, encoding="utf-8") as file:
        return Abbreviations(file.read())


def read(spark: SparkSession, path: str) -> Abbreviations:
    """The dictionary at a path that Spark can read."""
    return Abbreviations("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one file


FORMS = "form string, meaning string, gender string, class string, wrong boolean, finisher boolean, not_finisher boolean, name_finisher boolean"


def table(spark: SparkSession, abbreviations: Abbreviations | None = None) -> DataFrame:
    """One row per form and meaning, for joins."""
    a = abbreviations or load()
    rows = [(form, m[0], m[2], m[3], wrong, form in a.finishers, form in a.not_finishers, form in a.name_finishers) for wrong, forms in ((False, a.right), (True, a.wrong)) for form, entries in forms.items() for m in entries]
    return spark.createDataFrame(rows, FORMS)
