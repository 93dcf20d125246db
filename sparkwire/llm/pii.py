"""Surrogates for personal data.

Entities are replaced by keyed permutations of their own format, so that one entity has one surrogate
everywhere (coreference) and two entities never share one (distinctness) without any table of the
corpus: letters, digits and hex digits are permuted as numbers by a Feistel network tweaked with the
entity's kind and shape, of which a step along its single cycle is taken, so that nothing is its own
surrogate; separators, case and length stay. Constraints that a kind has (a card's check digit, an
address's octets and range) are met by walking the cycle until they hold, which keeps it one-to-one.
Names are permuted token by token, wherever they stand. Known given names change places within the names
of their script and gender. No list of names could give distinct surrogates to all names of a corpus, so
other names keep the places of their vowels and consonants, and the ending that tells a gender (two letters in
Cyrillic, else the last): Heike stays a woman's name, Иванова stays apart from Иванов. Particles (van, de la), prefixes
(O', Mac) and words in capitals keep their form. As a check of the whole, collisions() counts surrogates
that two entities share; replace() takes the next tweak if there are any.

Kinds: email, phone, ip, card (Luhn-valid only), ssn, iban, key (of a known prefix), secret (after its
label), person. A person is a name after a form of address, a known given name before a surname, or a run of two or
three capitalised words with evidence of weight EVIDENCE: a verb of saying beside it (2), words that introduce a person
(2), the name in an address of email in the same text (2), a person before or after it in a list (2), an age (1), its surname again
alone (1). The names of a person that stand alone elsewhere in the same text are the same person's, and get
the same surrogates. A given name alone, without any of these, is no entity.
The key is the caller's: whoever has it can tell which surrogate stands for what.
Defined cases: null text stays null; empty text stays empty; a card number that fails its check is
left alone, as are version numbers and octets above 255; repeated rows are each replaced alike.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "key", "secret", "person")
#: Given names by script and gender; a surrogate comes from the same line.
NAMES = {
    ("latin", "f"): "Anna Maria Laura Julia Emma Sophie Claire Elena Lucia Carmen Helen Mary Sarah Alice Ingrid Greta Paula Marta Nora Irene Heike Sabine Ursula Monika Petra Claudia Susanne Birgit Linda Susan Karen Lisa Jennifer Patricia Elizabeth Margaret Catherine Isabelle Nathalie Camille Giulia Francesca Chiara Pilar Isabel".split(),
    ("latin", "m"): "John James Peter Paul Thomas Martin Hans Karl Pierre Louis Juan Pedro Carlos David Michael Robert Simon Oscar Hugo Felix Walter Klaus Wolfgang Stefan Andreas Jürgen Dieter Heinrich William Richard Charles George Edward Kevin Brian Daniel Jean François Philippe Antoine José Miguel Antonio Giovanni Marco".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Светлана Татьяна Юлия Екатерина Людмила Галина Марина Дарья".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Алексей Дмитрий Михаил Николай Павел Олег Владимир Александр Виктор Юрий".split(),
}
_GENDER = {n: k for k, names in NAMES.items() for n in names}
#: Forms of address that announce a person, with the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Signor": "m", "Signora": "f", "Dr": "", "Prof": "", "господин": "m", "госпожа": "f", "Господин": "m", "Госпожа": "f"}
#: Particles of surnames, and words that no person's name has.
PARTICLES = "van von der den de del della di da dos du la le el bin ibn ter ten zu zur af av".split()
NO_NAMES = frozenset(
    "The This That These Those A An In On At By For From And But Or If When While After Before Since "
    "January February March April June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "New Old North South East West Great United Saint San Los Street Road Avenue Square Station Bridge River Lake City County State Park House Hall "
    "University College School Institute Museum Library Hospital Church Bank Company Group Foundation Association License Agency Department Ministry "
    "Council Committee Court Senate Party Union Times Post News Journal Inc Ltd Corp Der Die Das Ein Eine Le La Les El Los Las".split()
)
#: Evidence that makes a run of capitalised words a person.
EVIDENCE = 2

_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁĄĆĘŁŃŚŹŻČŘŠŽŐŰĞŞ", "a-zß-öø-ÿа-яёąćęłńśźżčřšžőűğş"
_WORD = rf"(?:[{_UP}]['’])?[{_UP}][{_LOW}]+(?:[{_UP}][{_LOW}]+)*"
_CAP = rf"{_WORD}(?:-{_WORD})*"
_CAPS = rf"[{_UP}](?:['’])?[{_UP}]+(?:-[{_UP}]+)*"
_GAP = "[ \u00a0]"
_LAST = rf"(?:(?:{'|'.join(PARTICLES)}){_GAP}){{0,3}}(?:al-|d['’])?(?:{_CAP}|{_CAPS})(?![\w-])"
_INITIAL = rf"[{_UP}]\.{_GAP}?"
_GIVEN = rf"(?:{'|'.join(_GENDER)})"
_TITLE = rf"(?:{'|'.join(TITLES)})\.?{_GAP}"
PATTERNS = {
    "email": re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![\w@])", re.A),
    "key": re.compile(r"(?<![\w-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,200}|xox[baprs]-[A-Za-z0-9-]{10,200}|eyJ[\w-]{8,2000}\.[\w-]{8,4000}\.[\w-]{8,2000})(?![\w-])", re.A),
    "secret": re.compile(r"(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_-]{8,512}={0,2})", re.A),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A),
    "card": re.compile(r"(?<![\w.-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?![\w-])", re.A),
    "ip": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}(?![\w:])|(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)", re.A),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A),
    "phone": re.compile(r"(?<![\w+(.-])(?:\+\d{1,3}[ .-]?)?\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,5}(?![\w-])|(?<![\w+.-])\+\d{1,3}(?:[ .-]?\d{2,5}){2,5}(?![\w-])|(?<![\w+.-])\d{3}([ .-])\d{3}\1\d{4}(?![\w-])|(?<![\w+.-])0\d(?:([ .-])\d{2}){4}(?![\w-])", re.A),
    "person": re.compile(
        rf"(?<!\w)(?P<title>(?:{_TITLE})+)(?P<after>(?:{_INITIAL}){{0,3}}(?:{_CAP}{_GAP}(?:{_INITIAL}){{0,2}})??{_LAST}(?:{_GAP}{_LAST})?)"
        rf"|(?<![\w-])(?P<named>{_GIVEN}(?:-{_GIVEN})?{_GAP}(?:{_GIVEN}{_GAP}|{_INITIAL}){{0,2}}(?P<last>{_LAST}))"
    ),
}
_BARE = re.compile(rf"(?<![\w-])(?:{_CAP}|{_CAPS})(?![\w-])")
_RUN = re.compile(rf"(?<![\w-]){_CAP}(?:{_GAP}{_LAST}){{1,2}}(?!{_GAP}[{_UP}])")
_SAYS = "said|says|told|tells|wrote|writes|asked|asks|replied|added|explained|sagte|sagt|schrieb|erklärte|fragte|dit|déclare|écrit|dijo|dice|escribió|disse|сказал|сказала|пишет"
_SAYS_AFTER = re.compile(rf",? (?:{_SAYS})(?!\w)")
_INTRODUCED = re.compile(rf"(?<!\w)(?:{_SAYS}|[Nn]ame:|[Nn]ame is|[Nn]amed|[Cc]alled|[Dd]ear|[Cc]ontact:?|[Ss]igned,?|[Aa]uthor:?|[Bb]y|heißt|[Ll]iebe|[Ll]ieber|m['’]appelle|llamo|[Cc]her|[Cc]hère|зовут) $")
_AGED = re.compile(r",? \(?(?:aged |born |geboren )?\d{2}(?:\d\d)?[,)]")
_LISTED = frozenset((", ", " and ", ", and ", " & ", " und ", " et ", " y ", " e ", " и ", "; "))
#: Words that a text has if the pattern of persons can match.
_ANNOUNCE = frozenset(TITLES) | frozenset(_GENDER)
_CAPITALISED = re.compile(rf"(?<!\w)[{_UP}][{_LOW}]+")
_TOKEN = re.compile(rf"[{_UP}{_LOW}]+(?:['’][{_UP}{_LOW}]+)*")
_PREFIX = re.compile(rf"[ODLdl]['’]|Ma?c(?=[{_UP}])")
#: What a text must have for a pattern to be tried; keeps clean texts cheap.
_NEEDS: dict[str, Callable[[str, str], bool]] = {
    "email": lambda t, low: "@" in t,
    "key": lambda t, low: any(w in t for w in ("AKIA", "_", "sk-", "xox", "eyJ")),
    "ip": lambda t, low: _ADDRESS.search(t) is not None,
    "secret": lambda t, low: any(w in low for w in ("token", "secret", "passw", "key")),
    "person": lambda t, low: "госпо" in low or not _ANNOUNCE.isdisjoint(_CAPITALISED.findall(t)),
}
_ADDRESS = re.compile(r"\d\.\d{1,3}\.\d|:[0-9A-Fa-f]{0,4}:", re.A)
_DIGITS = re.compile(r"\d[\d .()-]{5,}\d|\d{2}(?: ?[A-Z0-9]{4}){2}", re.A)


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, what tells its gender) of the entities, in order; an earlier kind wins an overlap."""
    low = text.lower()
    numbers = _DIGITS.search(text) is not None
    taken: list[tuple[int, int, str, str]] = []
    covered = bytearray(len(text))

    def take(s: int, e: int, kind: str, gender: str) -> None:
        if covered.find(1, s, e) < 0:
            covered[s:e] = b"\1" * (e - s)
            taken.append((s, e, kind, gender))

    for kind, pattern in PATTERNS.items():
        if not _NEEDS.get(kind, lambda t, low: numbers)(text, low):
            continue
        for m in pattern.finditer(text):
            group = 1 if kind == "secret" else 0
            if kind == "person":
                if m["named"] and m["last"].rpartition(" ")[2] in NO_NAMES:
                    continue
                group = "named" if m["named"] else "after"
            s, e = m.span(group)
            if kind == "person" and m["title"]:  # the words after a name that no name has
                while (cut := text.rfind(" ", s, e)) > 0 and text[cut + 1 : e] in NO_NAMES:
                    e = cut
                if text[s:e] in NO_NAMES:
                    continue
            if kind == "card" and not luhn(re.sub(r"\D", "", m[0])):
                continue
            if kind == "iban" and not _iban_ok(m[0]):
                continue
            take(s, e, kind, _gender_of(m["title"]) if kind == "person" and m["title"] else "")
    for s, e in _by_evidence(text, taken):
        take(s, e, "person", "")
    # the names of a text's persons where they stand alone
    alone = {name: gender for s, e, kind, gender in taken if kind == "person" for name in _BARE.findall(text[s:e])}
    if alone:
        alone |= {name.capitalize(): gender for name, gender in alone.items() if name.isupper()}
        for m in _BARE.finditer(text):
            name = m[0] if m[0] in alone else m[0].capitalize()
            if name in alone:
                take(*m.span(), "person", alone[name])
    return sorted(taken)


def _gender_of(titles: str) -> str:
    """What a row of forms of address tells of the gender."""
    return next((g for t in re.findall(r"\w+", titles) if (g := TITLES[t])), "")


def _by_evidence(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int]]:
    """Runs of two or three capitalised words that are persons by what stands around them."""
    runs = [m.span() for m in _RUN.finditer(text) if NO_NAMES.isdisjoint(m[0].split())]
    if not runs:
        return []
    mailed = {w for s, e, kind, _ in taken if kind == "email" for w in re.split(r"[^a-z]+", text[s:e].partition("@")[0].lower()) if len(w) > 3}
    persons = {(s, e) for s, e, kind, _ in taken if kind == "person"}
    starts, ends = {s for s, _ in persons}, {e for _, e in persons}
    found, known = [], {text[s:e] for s, e in persons}

    def listed(s: int, e: int) -> bool:
        return any(text[s - len(x) : s] == x and s - len(x) in ends or text[e : e + len(x)] == x and e + len(x) in starts for x in _LISTED)

    for around in (runs, runs[::-1]):  # a list is followed from its known person both ways
        for s, e in around:
            if (s, e) in found or (s, e) in persons:
                continue
            first, last = text[s:e].split()[0], text[s:e].split()[-1]
            weight = 2 * bool(_SAYS_AFTER.match(text, e)) + 2 * bool(_INTRODUCED.search(text, max(0, s - 24), s)) + bool(_AGED.match(text, e))
            weight += 2 * bool(mailed & {last.lower(), (first[0] + last).lower()}) + 2 * listed(s, e)
            if weight == 1:
                weight += len(re.findall(rf"(?<![\w-]){re.escape(last)}(?![\w-])", text)) > 1
            if weight >= EVIDENCE or text[s:e] in known:
                found.append((s, e))
                known.add(text[s:e])
                starts.add(s)
                ends.add(e)
    return found


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


#: Vowels and consonants, plain and with marks, of names.
_LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüąęőű", "çñćłńśźżčřšžğş", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ")
_LETTERS += tuple(c.upper() for c in _LETTERS)


class Surrogates:
    """The surrogate of an entity under a key. tweak tells attempts apart."""

    def __init__(self, key: bytes, tweak: int = 0):
        self.key = hashlib.blake2b(key + struct.pack("<I", tweak), digest_size=32).digest()
        self.of = lru_cache(100_000)(self._of)

    def _round(self, tweak: str, i: int, value: int, size: int) -> int:
        data = f"{tweak}|{i}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=24).digest(), "big") % size

    def number(self, value: int, low: int, high: int, tweak: str) -> int:
        """The next of the low * high numbers on a keyed cycle through all of them: a Feistel network's inverse, one more, the network."""
        a, b = divmod(value, high)
        for i in range(8, -2, -2):
            b = (b - self._round(tweak, i + 1, a, high)) % high
            a = (a - self._round(tweak, i, b, low)) % low
        a, b = divmod((a * high + b + 1) % (low * high), high)
        for i in range(0, 10, 2):
            a = (a + self._round(tweak, i, b, low)) % low
            b = (b + self._round(tweak, i + 1, a, high)) % high
        return a * high + b

    def symbols(self, text: str, alphabet: str, tweak: str) -> str:
        """A permutation of the words of text's length over the alphabet."""
        n, r = len(text), len(alphabet)
        if not n:
            return ""
        value = 0
        for c in text:
            value = value * r + alphabet.index(c)
        if n == 1:
            order = sorted(range(r), key=lambda k: self._round(tweak, 99, k, 1 << 64))
            return alphabet[order[(order.index(value) + 1) % r]]
        value = self.number(value, r ** (n // 2), r ** (n - n // 2), f"{tweak}|{n}|{r}")
        out = []
        for _ in range(n):
            value, k = divmod(value, r)
            out.append(alphabet[k])
        return "".join(reversed(out))

    def shaped(self, text: str, tweak: str, classes: tuple[str, ...] = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) -> str:
        """Each class of characters permuted among its own places; all others stay."""
        kind = {c: k for k, cl in enumerate(classes) for c in cl}
        shape = "".join(str(kind[c]) if c in kind else c for c in text)
        out = list(text)
        for k, cl in enumerate(classes):
            at = [i for i, c in enumerate(text) if kind.get(c) == k]
            for i, c in zip(at, self.symbols("".join(text[i] for i in at), cl, f"{tweak}|{shape}"), strict=True):
                out[i] = c
        return "".join(out)

    def walked(self, start, step: Callable, good: Callable):
        """The first of step's iterates that is good; start is good, so that this permutes the good ones."""
        out = step(start)
        while not good(out):
            out = step(out)
        return out

    def _of(self, kind: str, text: str, gender: str) -> str:
        return getattr(self, f"_{kind}")(text, gender) if hasattr(self, f"_{kind}") else self.shaped(text, kind)

    def _email(self, text: str, _) -> str:
        name, _, host = text.rpartition("@")
        host, dot, top = host.rpartition(".")
        return self.shaped(f"{name}@{host}", "email") + dot + top

    def _phone(self, text: str, _) -> str:
        m = re.match(r"\+\d{1,3}(?=[ .(-])", text)
        head = m[0] if m else ""
        return head + self.shaped(text[len(head) :], f"phone{head}")

    def _key(self, text: str, _) -> str:
        head = re.match("AKIA|gh[pousr]_|sk-|xox[baprs]-|eyJ", text)[0]
        return head + self.shaped(text[len(head) :], f"key{head}")

    def _ip(self, text: str, _) -> str:
        if ":" in text:
            return self.shaped(text, "ipv6", ("0123456789abcdef",)) if text == text.lower() else self.shaped(text, "ipv6", ("0123456789ABCDEF", "abcdef"))

        octets = [int(o) for o in text.split(".")]
        # bits of a private range's start; they stay
        fixed = next((n for n, is_in in ((8, octets[0] in (10, 127)), (16, octets[:2] == [192, 168]), (12, octets[0] == 172 and octets[1] >> 4 == 1)) if is_in), 0)

        def step(x: int) -> int:
            free = 32 - fixed
            return x >> free << free | self.number(x & (1 << free) - 1, 1 << free // 2, 1 << free - free // 2, f"ip|{fixed}|{x >> free}")

        def public(x: int) -> bool:
            return not (x >> 24 in (10, 127) or x >> 16 == 0xC0A8 or x >> 20 == 0xAC1)

        out = self.walked(int.from_bytes(bytes(octets), "big"), step, (lambda x: True) if fixed else public)
        return ".".join(str(out >> s & 255) for s in (24, 16, 8, 0))

    def _card(self, text: str, _) -> str:
        digits = re.sub(r"\D", "", text)
        body = digits[0] + self.symbols(digits[1:-1], "0123456789", f"card|{digits[0]}")
        body = next(body + c for c in "0123456789" if luhn(body + c))
        it = iter(body)
        return "".join(next(it) if c.isdigit() else c for c in text)

    def _iban(self, text: str, _) -> str:
        plain = text.replace(" ", "")
        body = self.shaped(plain[4:], f"iban{plain[:2]}")
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        it = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(next(it) if c != " " else c for c in text)

    def _secret(self, text: str, _) -> str:
        low, up = "0123456789abcdef", "0123456789ABCDEF"
        for hexes in (low, up):
            if set(text) <= set(hexes):
                return self.shaped(text, f"secret{hexes}", (hexes,))
        return self.walked(text, lambda x: self.shaped(x, "secret"), lambda x: not (set(x) <= set(low) or set(x) <= set(up)))

    def _person(self, text: str, _) -> str:
        return _TOKEN.sub(lambda m: m[0] if m[0].islower() else self._name(m[0]), text)

    def _name(self, name: str) -> str:
        """The surrogate of one token, the same wherever it stands in a name."""
        if m := _PREFIX.match(name):
            return m[0] + self._name(name[m.end() :])
        if (group := _GENDER.get(name)) is not None:
            names = NAMES[group]
            order = sorted(names, key=lambda n: self._round(f"name{group}", 0, names.index(n), 1 << 64))
            return order[(order.index(name) + 1) % len(order)]
        if len(name) > 1 and name.isupper() and (plain := name.capitalize()).upper() == name:
            return self._name(plain).upper()
        kept = 2 if len(name) > 4 and "а" <= name[-1] <= "ё" else int(len(name) > 2)
        body, end = name[: len(name) - kept], name[len(name) - kept :]
        return self.walked(body, lambda x: self.shaped(x, f"name|{end}", _LETTERS), lambda x: x + end not in _GENDER) + end


def _scan(texts: list[str | None], own: Surrogates) -> Iterator[tuple[str | None, list[tuple[str, str, str]]]]:
    """Each text with its surrogates, and (kind, original, surrogate) of its entities."""
    for text in texts:
        if not text:
            yield text, []
            continue
        out, at, found = [], 0, []
        for s, e, kind, gender in find(text):
            new = own.of(kind, text[s:e], gender)
            out += [text[at:s], new]
            at = e
            found.append((kind, text[s:e], new))
        yield ("".join([*out, text[at:]]) if found else text), found


def entities(docs: DataFrame, key: bytes, tweak: int = 0) -> DataFrame:
    """(kind, original, surrogate), hashes of distinct entities; the texts of entities leave no task."""

    def run(it):
        own = Surrogates(key, tweak)
        digest = lambda s: int.from_bytes(hashlib.blake2b(s.encode(), key=own.key, digest_size=8).digest(), "big", signed=True)
        for batch in it:
            found = {x for _, xs in _scan(batch.column(0).to_pylist(), own) for x in xs}
            if found:
                kind, old, new = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(map(digest, old), pa.int64()), pa.array(map(digest, new), pa.int64())], ["kind", "original", "surrogate"])

    return docs.select("text").mapInArrow(run, "kind string, original long, surrogate long").distinct()


def collisions(docs: DataFrame, key: bytes, tweak: int = 0) -> int:
    """Surrogates that two different entities of one kind share."""
    same = entities(docs, key, tweak).groupBy("kind", "surrogate").agg(F.count("*").alias("n"))
    return same.where("n > 1").count()


def replace(docs: DataFrame, key: bytes, attempts: int = 8) -> DataFrame:
    """The documents with surrogates in text, and the number of entities of each kind beside, or instead of, the other columns."""
    tweak = next((t for t in range(attempts) if not collisions(docs, key, t)), None)
    if tweak is None:
        raise ValueError(f"collisions under {attempts} tweaks of the key")
    docs = docs.drop(*[f"n_{k}" for k in KINDS])
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(it):
        own = Surrogates(key, tweak)
        for batch in it:
            texts, counts = [], {k: [] for k in KINDS}
            for text, found in _scan(batch.column("text").to_pylist(), own):
                texts.append(text)
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in found) if found else 0)
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(counts[k], pa.int64()) for k in KINDS]], [*names, *[f"n_{k}" for k in KINDS]])

    return docs.mapInArrow(run, schema + "".join(f", n_{k} long" for k in KINDS))


#: The setting that names the key, in hex; without it each run has a key of its own.
KEY_SETTING = "spark.sparkwire.surrogate.key"


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the text with surrogates, n_<kind>."""
    named = docs.sparkSession.conf.get(KEY_SETTING, None)
    return replace(docs.select("doc_id", "text"), bytes.fromhex(named) if named else secrets.token_bytes(32))
