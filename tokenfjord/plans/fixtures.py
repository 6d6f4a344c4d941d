"""Inputs and the results they must have; used by queries and tests alike."""

#: (case, text, tokens as KIND:text joined by " + ")
TOKENS = [
    (1, "16:20", "TIME:16:20"),
    (2, "16:205", "NUMBER:16 + PUNCTUATION:: + NUMBER:205"),
    (3, "kl. 9:05", "TIME:kl. 9:05"),
    (4, "hálfníu", "TIME:hálfníu"),
    (5, "kl. hálf fimm", "TIME:kl. hálf fimm"),
    (6, "klukkan tvö", "TIME:klukkan tvö"),
    (7, "24/12", "DATEREL:24/12"),
    (8, "8.3.", "NUMBER:8.3 + PUNCTUATION:."),
    (9, "24/120", "NUMBER:24 + PUNCTUATION:/ + NUMBER:120"),
    (10, "9. júlí", "DATEREL:9. júlí"),
    (11, "Ágúst", "WORD:Ágúst"),
    (12, "21. ágúst", "DATEREL:21. ágúst"),
    (13, "mars 1975", "DATEREL:mars 1975"),
    (14, "mars 19750", "DATEREL:mars + NUMBER:19750"),
    (15, "Fimmta apríl árið 1902", "WORD:Fimmta + DATEREL:apríl árið 1902"),
    (16, "24/12/1999", "DATEABS:24/12/1999"),
    (17, "1999-12-24", "DATEABS:1999-12-24"),
    (18, "24/12/19990", "DATEREL:24/12 + PUNCTUATION:/ + NUMBER:19990"),
    (19, "930 e.Kr.", "YEAR:930 e.Kr."),
    (20, "3.0156,78", "NUMBER:3.0156 + PUNCTUATION:, + NUMBER:78"),
    (21, "3,0156.78", "NUMBER:3 + PUNCTUATION:, + NUMBER:0156.78"),
    (22, "12⅖", "NUMBER:12⅖"),
    (23, "2/45", "NUMBER:2 + PUNCTUATION:/ + NUMBER:45"),
    (24, "3ja", "WORD:3ja"),
    (25, "25 millj.kr.", "AMOUNT:25 millj.kr."),
    (26, "o.s.frv.", "WORD:o.s.frv."),
    (27, "dags. 4/11", "WORD:dags. + DATEREL:4/11"),
    (28, "heimilis-, hita- og rafmagnsvörur", "WORD:heimilis-, hita- og rafmagnsvörur"),
    (29, "bóka- safn", "WORD:bóka + PUNCTUATION:- + WORD:safn"),
    (30, "140261-2039", "SSN:140261-2039"),
    (31, "140261-2139", "NUMBER:140261 + PUNCTUATION:- + NUMBER:2139"),
    (32, "+354 555 1234", "TELNO:+354 555 1234"),
    (33, "4,75 %", "PERCENT:4,75 %"),
    (34, "https://data.example.org/a/b/", "URL:https://data.example.org/a/b/"),
    (35, "3litir.com", "DOMAIN:3litir.com"),
    (36, "#7dagar7", "HASHTAG:#7dagar7"),
    (37, "#", "PUNCTUATION:#"),
    (38, "3/9/1988 kl. 07:08:09", "TIMESTAMPABS:3/9/1988 kl. 07:08:09"),
    (39, "$2.650", "AMOUNT:$2.650"),
    (40, "GBP 75", "AMOUNT:GBP 75"),
    (41, "amma@gamla-husid.example", "EMAIL:amma@gamla-husid.example"),
    (42, "5b", "NUMWLETTER:5b"),
    (43, "12V", "MEASUREMENT:12V"),
    (44, "12Watt", "NUMBER:12 + WORD:Watt"),
    (45, "18,2° C", "MEASUREMENT:18,2° C"),
    (46, "250 MWst", "MEASUREMENT:250 MWst"),
    (47, "C6H12O6", "MOLECULE:C6H12O6"),
    (48, "312-7765", "SERIALNUMBER:312-7765"),
    (49, "2-300-4567", "SERIALNUMBER:2-300-4567"),
    (50, "1874", "YEAR:1874"),
    (51, "1939 -1945", "YEAR:1939 + PUNCTUATION:- + YEAR:1945"),
    (52, "@anna.jons", "USERNAME:@anna.jons"),
    (53, "EUR. 12", "CURRENCY:EUR. + NUMBER:12"),
]

#: (case, text, kinds in the order of tokens)
KINDS = [
    (1, "Amma bjó þar veturinn 1931-32.", "B W W W W Y P N P E"),
    (2, "Vatnið var 4°C í morgun, kaffið 80° C og ofninn 225 °C.", "B W W ME W W P W ME W W ME P E"),
    (3, "Skipið sigldi 30° í austur, svo 65°S og loks 120 ° vestur.", "B W W ME W W P W ME W W W ME W P E"),
    (4, "Við Ágúst hittumst 5. ágúst og aftur í ágúst, ekki fyrr. ÞAÐ VAR 6. ÁGÚST!", "B W W W DR W W W DR P W W P E B W W DR P E"),
    (5, "Ja.is svarar fyrr en www.bokasafn.is, og Rúv.is... En safnid.is, það er betra.Leitaðu þar, ekki á 7fiskar.com!", "B DM W W W DM P W DM P E B W DM P W W W P E B W W P W W DM P E"),
    (6, "Orðið stóð í þgf. en hitt í nf. Við lásum ef. og síðan þf. Hvar var ef.", "B W W W W W W W W E B W W W W W W E B W W W P E"),
    (7, "Bókin er [...] týnd. [...] Enginn fann hana.", "B W W P W P P E B W W W P E"),
    (8, "Hún kom 24.11. frá Akureyri en fór 27.9. Þá var komið haust.", "B W W DR W W W W N P E B W W W W P E"),
    (9, "Guðrún, kt. 140261-2039, fékk 140261-20391 kr. CO2 lak út.", "B W P W K P W N P A E B MO W W P E"),
    (10, "Bóka-og blaðasalan, gamla, stóð við Hafnar-eða Strandgötu.", "B W P W P W W W P E"),
    (11, "#Sumar-myndirnar koma eftir leik #2 og #3. #7dagar á Akureyri en #ekkiídagtakk! #rvk101.", "B HT P W W W W O W O P E B HT W W W HT P E B HT P E"),
]

#: (case, text, normal forms apart by spaces)
NORMAL = [
    (1, "Svo fór hann...", "Svo fór hann …"),
    (2, "Nú er nóg..", "Nú er nóg ."),
    (3, "Ræðan hélt áfram [...] fram á nótt.", "Ræðan hélt áfram […] fram á nótt ."),
    (4, "Palli,, komdu inn.", "Palli , komdu inn ."),
    (5, "Palli ,,komdu inn.", "Palli „ komdu inn ."),
    (6, "Hekla — gamalt eldfjall — gaus aftur í vor.", "Hekla - gamalt eldfjall - gaus aftur í vor ."),
    (7, "Hver braut eiginlega rúðuna???!!!!!", "Hver braut eiginlega rúðuna ?"),
    (8, 'Hann spurði: "Ertu alveg viss"!', "Hann spurði : „ Ertu alveg viss “ !"),
]

#: (case, text, text with spaces put right)
SPACES = [
    (1, "Nýtt \n  blað:Anna\t ,Einar og Pála ! 20,4  /  4  =   5.1", "Nýtt blað: Anna, Einar og Pála! 20,4/4 = 5.1"),
    (2, "Anna- sem var gjaldkeri—sagði af sér.", "Anna-sem var gjaldkeri — sagði af sér."),
    (3, "Tónleikarnir byrja kl . 20 : 30 - 22 : 00.", "Tónleikarnir byrja kl. 20:30-22:00."),
    (4, "Bílasölur, -leigur og -verkstæði eru opin.", "Bílasölur, -leigur og -verkstæði eru opin."),
    (5, "Mér leiðist snjór  - hann er svo kaldur!", "Mér leiðist snjór - hann er svo kaldur!"),
    (6, "1939—1945", "1939 — 1945"),
]

#: (case, text, sentences joined by " | ")
SENTENCES = [
    (1, "5.maí sl. seldi   hún 40kWst bíl. Verðið var € 12.500.  \n300.000 gestir komu.\nNý lína byrjar hér", "5. maí sl. seldi hún 40kWst bíl . | Verðið var €12.500 . | 300.000 gestir komu . | Ný lína byrjar hér"),
    (2, "Spurt er [hvort [bókin sé enn til]].", "Spurt er [ hvort [ bókin sé enn til ] ] ."),
    (3, "„Kemur þú í kvöld?“ spurði amma.", "„ Kemur þú í kvöld ? “ spurði amma ."),
    (4, "„Kemur þú í kvöld?“ Afi svaraði engu.", "„ Kemur þú í kvöld ? “ | Afi svaraði engu ."),
    (5, "Efri lína\n \nNeðri lína", "Efri lína | Neðri lína"),
    (6, "Húsavík er fámenn m.v. Selfoss.", "Húsavík er fámenn m.v. Selfoss ."),
    (7, "Komið var kvöld. Börnin sváfu.", "Komið var kvöld . | Börnin sváfu ."),
]

#: Letters of kinds in KINDS.
LETTERS = {"B": "S_BEGIN", "E": "S_END", "W": "WORD", "P": "PUNCTUATION", "T": "TIME", "DR": "DATEREL", "DA": "DATEABS", "Y": "YEAR", "N": "NUMBER", "NL": "NUMWLETTER", "TEL": "TELNO", "PC": "PERCENT", "U": "URL", "O": "ORDINAL", "C": "CURRENCY", "A": "AMOUNT", "M": "EMAIL", "ME": "MEASUREMENT", "DM": "DOMAIN", "HT": "HASHTAG", "K": "SSN", "MO": "MOLECULE", "SE": "SERIALNUMBER", "X": "UNKNOWN"}
