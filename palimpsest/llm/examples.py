"""Labelled texts for the trees: items built from the rules of their formats, and look-alikes, set into lines of the corpus.

Numbers follow numbering plans (country code, trunk, groups, separators) and the formats of
public documents, with digits at random; addresses follow postal order in several languages;
names are drawn from the corpus, from the capitalised words of a public vocabulary and from
random syllables, in several scripts. Sentences around them are put together from parts.
"""

import random
import re

from palimpsest.llm.names import GIVEN, NICKNAMES, NameModel, cyrillic

# Formats of numbers that public bodies issue to persons (9 digit, A capital), words that announce
# them, and whether the format alone tells.
DOCUMENTS = [
    ("999-99-9999", "SSN|social security number|ssn", True), ("999 99 9999", "SSN|social security number", True), ("999-999-999", "SIN|social insurance number", False), ("999 999 999", "SIN|TFN|tax file number|BSN", False),
    ("AA999999A", "NI number|NINO|national insurance", True), ("AA 99 99 99 A", "NI number|NINO|national insurance", True), ("999 999 9999", "NHS|NHS number", False), ("999.999.999-99", "CPF", True), ("99999999-A", "DNI", True), ("99999999A", "DNI|NIF", True),
    ("A9999999A", "NIE|license", True), ("9 99 99 99 999 999 99", "NIR|INSEE|numéro de sécurité sociale", True), ("AAAAAA99A99A999A", "codice fiscale", True), ("99 999 999 999", "Steuer-ID|Steuer-Identifikationsnummer", False), ("99999999999", "PESEL|Steuer-ID|SSN", False),
    ("999999999", "BSN|SSN|tax id|tax ID|NIF|passport no.", False), ("999999-9999", "personnummer|CPR|personal ID", True), ("999999 99999", "fødselsnummer", False), ("999999-999A", "henkilötunnus|HETU", True), ("999999/9999", "rodné číslo|personal ID", True), ("999-999-999 99", "СНИЛС", True),
    ("999999999999", "ИНН|My Number|Aadhaar", False), ("999999-9999999", "RRN|resident registration number|주민등록번호", True), ("9999 9999 9999", "マイナンバー|My Number|Aadhaar", False), ("99999999999999999A", "身份证|identity card", True), ("AAAAA9999A", "PAN", True),
    ("AAAA999999AAAAAA99", "CURP", True), ("999.9999.9999.99", "AHV|AHV-Nr.", True), ("9999 99999 9", "Medicare", False), ("A99999999", "passport|passport no.|паспорт", False), ("AA9999999", "passport|passport no.|Reisepass|pasaporte", False), ("A99999999A", "Reisepass|Personalausweis", False),
    ("99AA99999", "passeport|passport", False), ("AA999999", "driving licence|driver's license no.|identity card|Führerschein", False), ("AA999999A", "driving licence no.|permis", True), ("A9999999", "driver's license|licence no.|national id", False), ("99 99 999999", "паспорт", False),
]
TELLING = {p for p, _, tells in DOCUMENTS if tells}
# Country codes of numbering plans.
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 355 358 359 370 371 372 380 381 385 386 420 421 852 886 971 972".split()
WAYS = "Street St St. Road Rd Avenue Ave Lane Ln Boulevard Blvd Drive Dr Court Ct Crescent Terrace Place Square Close Way Row Highway Parkway Grove Gardens Hill Mews Trail Circle Walk Wharf Quay".split()
SUFFIXES = "straße strasse str. weg platz allee gasse ring damm ufer gatan vägen gränd gata vej gade vei laan straat plein kade katu tie".split()
BEFORE = ["rue", "rue de la", "rue du", "avenue de", "boulevard", "place", "chemin des", "quai", "impasse", "allée"]
SOUTH = ["calle", "Calle de", "avenida", "Avenida da", "plaza", "paseo de", "rua", "Rua das", "travessa", "via", "Via", "viale", "piazza", "corso", "largo"]
EAST = ["ul.", "ulica", "al.", "os.", "pl.", "ул.", "улица", "пр.", "просп.", "пер.", "вул.", "ulice", "utca"]
# Sentence parts: what may stand before an item of a kind, and after it.
LEADS = {
    0: ["mail", "Mail", "contact:", "Contact", "Kontakt", "write to", "bounce from", "Cc:", "reply to", "sent by", "correo", "почта", "from", "ping"],
    1: ["call", "phone", "tel.", "Tel.", "fax", "mobile", "ring", "cell", "desk:", "their desk is", "bei Fragen", "téléphone", "teléfono", "тел.", "telefon", "電話", "reach me at", "on-call:"],
    2: ["", "his", "her", "redact", "strip", "the dump leaked", "fixture contained", "old value was", "sample used", "test row had", "number"],
    3: ["wohnt", "lives at", "office moved to", "address:", "Adresse:", "parcel goes to", "ship to", "Ship it to", "deliver to", "invoice address", "meet at", "dirección:", "адрес:", "adres:", "visit"],
    4: ["thanks to", "Thanks to", "Cc:", "by", "from", "with", "to", "for", "per", "ping", "ask", "reviewed by", "suggested by", "reported by", "As", "via", "und", "mit", "merci à", "Merci à", "gracias a", "спасибо", "obrigado a", "dzięki", "credit:", "author:", "Reviewed with", "talked to", "paired with", "assigned to", "owner =", "r=", "TODO", "contact:", "Kontakt"],
}
TRAILERS = ["Signed-off-by:", "Acked-by:", "Reviewed-by:", "Reported-by:", "Tested-by:", "Suggested-by:", "Co-developed-by:", "Helped-by:", "Cc:"]
TAILS = ["", "", "", ".", ",", " later", " twice", " again", " today", " yesterday", " before landing", " with questions", " please", " still works", ", now blank", " anrufen", " besprochen", " pointed it out", " asked for it", " for the trace", " for the report", " said so", "?", "?", "'s patch", "’s idea", " from the sample", " was in the fixture", " in the log"]
WRAPS = ["{}", "{}", "{}", "{}", "{}", "({})", "[{}]", "<{}>", '"{}"', "“{}”", "* {} *", "# {}", "> {}", "; {};", "- {} -", "- tree, {}, row", "{} / key", "; {}; page", "TODO({})", 'field: "{}",', "r={}", "= {}"]
# Nouns after or before which a number is a count, a size, a place or a moment.
NOUNS = "line lines row rows page pages offset build bug issue ticket revision rev version port pid size length timing epoch crc checksum seed block chunk index id column bytes chapter section step timeout retry limit count code status part test case slot order total width height time".split()
UNITS = "ms s kB MB bytes rows lines times pages per step|items|entries|blocks|%|seconds".replace("|", " ").split()
SYLLABLES = ("b d f g h j k l m n p r s t v w z br dr gr kr st tr ch sh th".split(), "a e i o u ai ou ia".split(), ["", "", "", "n", "r", "l", "m", "s", "t", "k"])
_HAN_FAMILY, _HAN_GIVEN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗田中佐藤鈴木高橋渡辺伊", "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀英华慧建国文平志健一大翔子美"
_HANGUL = ("김이박최정강조윤장임", "민서준지우현수영진하은예도윤")
_GREEK, _HEBREW, _ARABIC = "αβγδεζηθικλμνοπρστυφχ", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"


class Examples:
    """``texts`` yields (text, field, kind or -1, start, end, closed): the item's place, and whether nothing else in the text is an item."""

    def __init__(self, names: NameModel, lines: list[str], proper: list[str], seed: int):
        self.r = random.Random(seed)
        self.lines = lines or ["Check the page"]
        self.families = names.families or ["smith", "jones", "novakova"]
        self.givens = names.givens or list(GIVEN)
        self.proper = proper or ["Michael", "Smith"]

    def digits(self, pattern: str) -> str:
        r = self.r
        return "".join(str(r.randrange(10)) if c == "9" else r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") if c == "A" else c for c in pattern)

    def word(self, least: int = 1) -> str:
        a, b, c = SYLLABLES
        return "".join(self.r.choice(a) + self.r.choice(b) + self.r.choice(c) for _ in range(self.r.randrange(least, 4)))

    def town(self) -> str:
        return (self.word() + self.r.choice(["", "", "ton", "ford", "ville", "burg", "by", "stad", "dorf", "ham", "ia", "ino", "ów"])).title()

    # ---- items ----

    def foreign(self) -> str:
        r = self.r
        pick = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randrange(a, b)))
        return r.choice([
            lambda: r.choice(_HAN_FAMILY) + pick(_HAN_GIVEN, 1, 3), lambda: r.choice(_HANGUL[0]) + pick(_HANGUL[1], 2, 3), lambda: pick(_GREEK, 4, 8).title() + " " + pick(_GREEK, 5, 10).title(),
            lambda: pick(_HEBREW, 3, 6) + " " + pick(_HEBREW, 3, 7), lambda: pick(_ARABIC, 3, 6) + " " + pick(_ARABIC, 4, 8), lambda: cyrillic(self.latin()), lambda: cyrillic(self.latin()),
        ])()

    def pair(self) -> tuple[str, str]:
        """Given and family name: from the corpus, from a vocabulary's capitalised words, or made up."""
        r, u = self.r, self.r.random()
        if u < 0.55:
            g = r.choice(self.givens) if r.random() < 0.75 else r.choice([*GIVEN, *NICKNAMES])
            f = r.choice(self.families)
        elif u < 0.8:
            g, f = (r.choice(self.proper) if r.random() < 0.7 else self.word() for _ in range(2))
        else:
            g, f = self.word(), self.word(2)
        if r.random() < 0.1:
            f = r.choice(["van ", "de la ", "von ", "O’", "O'", "Mc", "al-", "da "]) + f.title()
        return g.title(), f[:1].upper() + f[1:]

    def latin(self) -> str:
        r = self.r
        g, f = self.pair()
        return r.choices(
            [f"{g} {f}", f"{g[0]}. {f}", f"{g} {r.choice('ABCDEJKLMRST')}. {f}", f"{f}, {g}", f"{r.choice(['Mr', 'Ms', 'Mrs', 'Dr.', 'Dr', 'Prof.', 'Frau', 'Herr', 'Señora', 'Sra.', 'M.', 'Mme', 'Pan'])} {f}", g, f"{g} {f}".lower(), f"{g} {f}".upper(), f"{f}, {g[0]}.", f"{f.upper()} {g}", f"{g}{f}".replace(" ", ""), f],
            [40, 8, 7, 8, 12, 9, 7, 4, 2, 2, 4, 3],
        )[0]

    def name(self) -> str:
        r = self.r
        u = r.random()
        if u < 0.12:
            return self.foreign()
        s = self.latin()
        if u < 0.24 and len(s) > 3:
            i = r.randrange(1, len(s))
            s = r.choice([s[:i] + s[i + 1 :], s[:i] + s[i - 1] + s[i:], s[: i - 1] + s[i - 1 : i + 1][::-1] + s[i + 1 :], s[:i] + r.choice("aeiorstn") + s[i + 1 :]]).strip() or s
        elif u < 0.27 and not s.isupper() and len(s) > 4:
            s = s[:2] + "�" + s[3:]
        return s

    def email(self) -> str:
        r = self.r
        g, f = (x.lower().replace(" ", "").replace("’", "").replace("'", "") for x in self.pair())
        local = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{f}{r.randrange(99)}", f"{g}_{f}", f"{g}+{self.word()}", f"{f}.{g}", f"{g}-{f}", f, g, r.choice(["build", "info", "landing", "no-reply", "core-team", "x", "support", "dev"])])
        host = [*([self.word()] if r.random() < 0.3 else []), self.word(2) + r.choice(["", "", self.word()])]
        tld = r.choice(["example", "test", "invalid", "com", "org", "net", "de", "io", "co.uk", "edu", "fr", "com.br", "info"])
        parts = [*host, *tld.split(".")]
        at, dot = r.choices([("@", "."), (" at ", " dot "), (" [at] ", "."), ("(at)", "(dot)"), (" @ ", "."), (" at ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) ")], [60, 8, 6, 8, 6, 4, 3, 3])[0]
        s = local + at + dot.join(parts) if r.random() < 0.9 else f"{local}@{self.word()}" + (str(r.randrange(1, 10)) if r.random() < 0.5 else "")
        u = r.random()
        return f"<{s}>" if u < 0.25 else f"mailto:{s}" if u < 0.32 else s.upper() if u < 0.38 else s

    def groups(self, n: int) -> list[str]:
        """n digits in groups of two to four, the last ones most often even."""
        r, out = self.r, []
        size = r.choice([2, 3, 4])
        while n > 0:
            k = min(n, size if r.random() < 0.6 else r.choice([2, 3, 4]))
            k = n if n - k == 1 else k
            out.append(k)
            n -= k
        return [self.digits("9" * k) for k in out]

    def phone(self) -> str:
        r = self.r
        sep = r.choice([" ", " ", " ", "-", "-", ".", ""])
        u = r.random()
        if u < 0.35:  # ten digits after an area code
            a, b, c = self.digits("999"), self.digits("999"), self.digits("9999")
            s = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{b}-{c}", f"{b} {c}", f"({a}) {b} {c}"])
            s = r.choice(["", "", "", "1-", "+1 ", "+1-", "+1.", "1 "]) + s if len(s) > 9 else s
            s = "+1." + s.replace("-", ".") if s.startswith("+1.") and "(" not in s else s
        elif u < 0.7:  # international
            cc, n = r.choice(COUNTRY_CODES), r.randrange(7, 11)
            trunk = r.choice(["", "", "", "(0)"])
            area = self.digits("9" * r.choice([1, 2, 3]))
            area = f"({area})" if r.random() < 0.15 and not trunk and sep == " " else area
            glue = r.choice([sep, sep, sep, ""])  # some write the country and area in one
            s = r.choice(["+", "+", "+", "00"]) + cc + glue + trunk + area + r.choice([sep, glue]) + sep.join(self.groups(n - 2))
        elif u < 0.93:  # national with a trunk zero
            n = r.randrange(8, 11)
            area = "0" + self.digits("9" * r.choice([1, 2, 3, 4]))
            s = (f"({area}) " if r.random() < 0.2 else area + sep) + sep.join(self.groups(n - len(area) + 1))
        else:  # ten digits in two or more groups
            s = r.choice([" ", " ", "-"]).join(self.groups(10))
        if re.sub(r"\d", "9", s) in TELLING:
            return self.phone()
        if r.random() < 0.08:
            return "".join(chr(ord(c) + 0xFEE0) if c.isdigit() or c == "-" else c for c in s)
        return s + (r.choice([" ext. ", " x", " ext "]) + self.digits(r.choice(["99", "999", "9999"])) if r.random() < 0.08 else "")

    def document(self) -> tuple[str, str]:
        """What announces a number, and the number."""
        r = self.r
        pattern, words, tells = r.choice(DOCUMENTS)
        s = self.digits(pattern)
        if r.random() < 0.25 and pattern[0] == "9":  # ranges that are never issued begin with zeros or sixes
            s = r.choice(["000", "666", "900"]) + s[3:] if pattern[:3] == "999" else s
        if tells and r.random() < 0.25:
            return "", s
        key = r.choice(words.split("|"))
        return key + r.choice([" ", " ", ": ", " ", "=", " is ", " no. "]), s

    def address(self) -> str:
        r = self.r
        n = str(r.randrange(1, 3000 if r.random() < 0.3 else 250)) + r.choice(["", "", "", "", "a", "B"])
        w = " ".join(self.town() if r.random() < 0.8 else r.choice(self.proper) for _ in range(r.choice([1, 1, 1, 2])))
        t, code = self.town(), self.digits(r.choice(["99999", "9999", "99-999"]))
        s = r.choice([
            lambda: f"{n} {r.choice(['', '', 'N. ', 'W ', 'old ', 'upper ', 'great '])}{w} {r.choice(WAYS)}" + r.choice(["", "", f", {t}", f", Apt {r.randrange(1, 40)}{r.choice('ABC')}, {t} {code}", f", Suite {self.digits('999')}", f", {t}, {r.choice(['CA', 'NY', 'TX', 'WA'])} {self.digits('99999')}"]),
            lambda: f"Flat {r.randrange(1, 20)}, {t} House, {n} {w} {r.choice(WAYS)}",
            lambda: f"{n}{r.choice(['', ',', ' bis,'])} {r.choice(BEFORE)} {w}" + r.choice(["", f", {self.digits('99999')} {t}"]),
            lambda: f"{r.choice(SOUTH)} {w}{r.choice([' ', ', ', ' nº ', ', n. '])}{n}" + r.choice(["", f", {r.randrange(1, 9)}º {r.choice('ABCD')}, {t}", f", {self.digits('99999')} {t}"]),
            lambda: f"{r.choice(EAST[:5])} {w} {n}" + r.choice(["", f"/{r.randrange(1, 60)}", f"/{r.randrange(1, 60)}, {t}", f", {self.digits('99-999')} {t}"]),
            lambda: f"{r.choice(EAST[5:])} {cyrillic(w)}, {r.choice(['д. ', ''])}{n}" + r.choice(["", f", кв. {r.randrange(1, 99)}"]),
            lambda: f"{t}{r.choice(SUFFIXES)} {n}" + r.choice(["", f", {t}", f", {code} {t}"]),
            lambda: f"{t}{r.choice(SUFFIXES)} {n}",
        ])()
        u = r.random()
        return s.upper() if u < 0.04 else s.lower() if u < 0.07 else s

    # ---- look-alikes ----

    def org(self) -> str:
        r = self.r
        base = (r.choice(self.families).title() if r.random() < 0.6 else self.town()) + r.choice(["ix", "tec", "", ""])
        what = r.choice(["Laboratories", "Systems", "Software", "Consulting", "Industries", "Engineering", "Labs", "Softw.", "Eng.", "Syst.", "Lab.", "Consult.", "Group", "Technologies", "Foundation", "Partners"])
        end = r.choice(["Ltd", "Inc", "GmbH", "SA", "Limited", "Incorporated", "s.a.", "LLC", "Oy", ""])
        s = r.choice([f"{base} {what} {end}", f"{base} {what}, {end}", f"{what} {base} {end}", f"The {base} {what} Team", f"{base} {what}", f"{base} {end}" if end else f"{base} {what}"]).strip(" ,")
        return s.upper() if r.random() < 0.08 else s.lower() if r.random() < 0.05 else s

    def number(self) -> str:
        """A number of no person: the forms of phones and documents too, behind or before a noun that says what it counts."""
        r = self.r
        u = r.random()
        if u < 0.5:
            n = self.document()[1] if r.random() < 0.4 else self.phone() if r.random() < 0.5 else self.digits("9" * r.randrange(5, 13))
            noun = r.choice(NOUNS)
            return r.choice([f"{noun} {n}", f"{noun.title()} {n}", f"{noun}: {n}", f"{noun.title()}: {n}", f"{noun} {n} {r.choice(UNITS)}", f"{noun} {n} is not {self.digits('9' * r.randrange(5, 12))}", f"{noun.title()} {n} were skipped", f"{noun}={n}"])
        return r.choice([
            lambda: self.digits("9.99.9"), lambda: "build " + self.digits("9.99.999.9999"), lambda: f"Bump {self.word(2)}@{self.digits('9.9.99')}", lambda: f"{self.word(2)}@" + "".join(r.choice("0123456789abcdef") for _ in range(r.choice([7, 8, 12, 40]))), lambda: f"{self.word(2)}@" + "".join(r.choice("abcdef") for _ in range(7)),
            lambda: "sha1:" + "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"20{self.digits('99')}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}" + r.choice(["", f" {r.randrange(24):02}:{self.digits('99')}:{self.digits('99')}"]), lambda: self.digits("10.99.99.99"),
            lambda: self.digits(r.choice(["9999999 ", "99999999 ", "999 999 999 "])) + r.choice(UNITS), lambda: f"rows {self.digits('9999999')}-{self.digits('9999999')}", lambda: "address 0x" + "".join(r.choice("0123456789abcdef") for _ in range(9)), lambda: f"{r.choice(['Fixes', 'Closes', 'see'])} {r.choice(['bug ', '#', 'issue '])}{self.digits('9' * r.randrange(3, 8))}",
            lambda: f"{self.digits('99')} {r.choice(WAYS).lower()}s and {r.choice(['one', 'two'])} {r.choice(WAYS).lower()} block", lambda: f"{r.randrange(2, 9999)} {r.choice(self.common)} {r.choice(self.common)}s {r.choice(WAYS).lower()} the {r.choice(self.common)}", lambda: f"{r.randrange(2, 9999)} from the {r.choice(self.common)} {r.choice(WAYS)} {r.choice(self.common)}",
            lambda: f"{r.randrange(2, 90)} {r.choice(self.common)} {r.choice(['row', 'place', 'way', 'drive', 'close', 'circle', 'trail'])}" + r.choice([" again", " of pages", "", "s"]),
            lambda: f"RFC {self.digits('9999')}, ISO {self.digits('9999-9')}", lambda: f"{self.digits('1699999999')}", lambda: f"from {self.digits('99999')} to {self.digits('999999')}", lambda: f"port {self.digits('99999')}, size {self.digits('9999999')}",
        ])()

    def made(self) -> str:
        """A product's name."""
        r = self.r
        return r.choice([self.word(2).title(), self.word().title() + r.choice(["QL", "DB", "OS", "Script", "Kit", "Lib", "Hub"]), r.choice(self.common).title() + self.word().title(), self.word().upper()])

    def words(self) -> str:
        """Words that look like names: verbs that are given names, products, places, types, months."""
        r = self.r
        noun = lambda: r.choice(self.common)
        verb = r.choice(["Will", "Mark", "Bill", "Grant", "Max", "May", "Rose", "Drew", "Chase", "Hope", "Frank", "Dean", "Art", "Jack", "Rich", "Pat", "Sue", "Rob"])
        return r.choice([
            lambda: f"{verb} the {noun()} {r.choice(['later', 'as stale', 'once', 'again', 'of the page'])}", lambda: f"{verb} {noun()} {noun()}", lambda: f"{verb} of {noun()}s for the {noun()}", lambda: f"{noun().title()} {noun()} the {noun()}", lambda: f"{noun().title()}{noun().title()}.{noun()}()",
            lambda: f"in {self.town()}", lambda: f"near {r.choice(self.proper)}", lambda: f"at {self.town()} {r.choice(['airport', 'station', 'office'])}", lambda: f"em São {self.town()}", lambda: f"{self.word(2)}-{noun()}", lambda: f"{self.word(2).title()} {noun()}", lambda: f"on {r.choice(['Monday', 'Tuesday', 'Friday', 'March', 'April', 'August'])}",
            lambda: f"use the @{noun()}_{noun()} decorator", lambda: f"{r.choice(['Landing', 'Mirror', 'Nightly', 'Build', 'Release', 'Import', 'Merge'])} {r.choice(['Robot', 'Daemon', 'Bot', 'Service', 'Importer'])}", lambda: f"{r.choice(self.families)}.{noun()}()", lambda: f"{noun().upper()} {noun().upper()}", lambda: f"with {noun()} {r.choice(['today', 'yesterday', 'again'])}",
            lambda: f"{noun().title()} {r.choice(self.proper)} {noun()}s", lambda: f"the {r.choice(self.proper)} {noun()}", lambda: f"{r.choice(self.proper)} {r.randrange(1, 30)} {r.choice(['is', 'was', 'and'])} {noun()}", lambda: f"{noun().title()} the {r.choice(self.proper)}{r.choice(['QL', 'DB', 'OS', 'SQL', 'API'])} {noun()}",
            lambda: f"{noun()} {noun()} on {self.made()} {noun()}", lambda: f"{noun().title()} {self.made()} {noun()}", lambda: f"{self.made()} {self.digits('9.9')} {noun()}", lambda: f"{noun()} {r.choice(self.proper)} and {r.choice(self.proper)} {noun()}s", lambda: f"{noun()} {r.choice(self.proper)}",
            lambda: " ".join(noun() for _ in range(r.randrange(2, 7))), lambda: f"{r.choice(['The', 'A', 'This', 'Each'])} {noun()} {noun()}s {noun()}",
        ])()

    common = ["page", "reader", "overlay"]

    def texts(self, count: int):
        r = self.r
        for _ in range(count):
            if r.random() < 0.2:
                yield self.committer()
                continue
            k = r.choices([-1, 0, 1, 2, 3, 4], [4, 1, 2, 1.5, 1.1, 3])[0]
            if k < 0:
                item = r.choices([self.org, self.number, self.words], [2, 4, 4])[0]()
                lead = r.choice(["", "", "", r.choice(LEADS[4]) + " "]) if item[:1].isupper() and r.random() < 0.3 else ""
                pre, post = lead, ""
            else:
                key, item = self.document() if k == 2 else ("", [self.email, self.phone, None, self.address, self.name][k]())
                if k == 4 and r.random() < 0.2:
                    pre, post = r.choice(TRAILERS) + " ", r.choice(["", f" <{self.email().strip('<>').replace('mailto:', '')}>"])
                elif r.random() < 0.5:
                    lead = r.choice(LEADS[k])
                    pre, post = lead + ("" if lead.endswith("=") or not lead else " ") + key, r.choice(TAILS)
                else:
                    a, b = r.choice(WRAPS).split("{}")
                    pre, post = a + key, b
            if k in (1, 2) and r.random() < 0.12:  # other numbers run on
                other = f"{r.randrange(1, 999)} {r.choice(self.common)}"
                pre, post = (f"{r.choice(NOUNS)} {self.digits('9.99.9')} " + pre, post) if r.random() < 0.3 else (pre, f"{post or ' '}{other}" if post.endswith(" ") or not post else f"{post} {other}")
            base, tail = r.choice(self.lines), r.choice(self.lines)
            sep = r.choice(["\n", "\n", " ", ". ", " "])
            head, foot = ("" if r.random() < 0.2 else base + sep), ("" if r.random() < 0.45 else r.choice(["\n", "\n", " "]) + tail)
            start = len(head) + len(pre)
            yield head + pre + item + post + foot, 0, k, start, start + len(item)

    def committer(self):
        r = self.r
        u = r.random()
        mail = self.email().strip("<>").replace("mailto:", "")
        if u < 0.78:
            item = self.name()
            text = item + r.choices([f" <{mail}>", "", f" ({self.phone()})", f", {self.town()} <{mail}>", f" ({r.choice(['away', 'on leave', 'at work'])}) <{mail}>"], [60, 22, 6, 6, 6])[0]
            return text, 1, 4, 0, len(item)
        who = self.org() if r.random() < 0.75 else r.choice(["Landing Robot", "Mirror Daemon", "nightly-import", "Build Bot", "release service", "ci", "Import Daemon"])
        return who + (f" <{r.choice(['build', 'info', 'release', 'ci'])}@{self.word(2)}.example>" if r.random() < 0.6 else ""), 1, -1, 0, len(who)
