"""Personal data and secrets replaced by keyed surrogates of the same type, script, gender and format.

Each kind of entity has a finite space of values of the same format, and its surrogate is the next value on one
keyed cycle through that space: p^-1(p(x) + 1), where p is a permutation made from a keyed hash (a Feistel
network, walked back into the space). So equal entities get equal surrogates in every document (coreference), unequal
ones of a space get unequal ones (distinctness), and none is its own surrogate. Where a format has a check
(Luhn digits, IBAN remainders, address classes), the cycle is followed until the surrogate passes or fails it as the original
does, which keeps the mapping one to one. Names of the lists go to names of the same list, hence of the same gender and script;
other name parts keep their script, capitals, accents, and pattern of vowels and consonants, ending included, and never become a
listed name; letters without such a class go to letters of their own script, case and block of code points. Since accents stay
where they are, names that differ in accents alone have surrogates that do, too.

People are found in one pass over the words: by a title, by a given name of a list (`names` adds to it) before a capitalised word, by an
e-mail address of the same text that is made of their names, or by a word that introduces people before two capitalised words that the
text never writes in lower case. Parts of three letters or more are then replaced at every mention, shorter ones where they are told and
wherever they stand capitalised within a sentence. Numbers of 13 to 19 digits are cards if they pass the Luhn check.
Mentions keep their own separators and capitals. The table of surrogates of each document is checked for two entities
under one surrogate and for entities that stay, and `collisions` checks a whole corpus's mentions; a search for a surrogate that does not end is an error.

Null text stays null and empty text empty, with no entities. Input columns of the names that are added are replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askbook.llm._util import map_rows, replaced, slices, with_fields

# Given names by script and gender, titles, particles of surnames, words that introduce people.
NAMES = {
    ("latin", "f"): "Agnes Aisha Alice Amelia Anna Astrid Beatrice Birgit Camille Carmen Caroline Charlotte Chiara Chloe Claire Clara Diana Elena Elisabeth Elizabeth Emily Emma Fatima Giulia Greta Hannah Helena Ingrid Isabel Jane Jennifer Jessica Julia Karen Laura Layla Lena Linda Lucia Margaret Maria Marie Martha Mary Mei Michelle Monica Nancy Nina Olivia Patricia Paula Priya Rosa Ruth Sarah Sofia Sophie Susan Teresa Ursula Victoria Yuki Zeynep".split(),
    ("latin", "m"): "Adam Ahmed Albert Alexander Ali Andrew Anthony Antonio Bjorn Carlos Charles Christopher Daniel David Diego Edward Erik Fernando Francis Frank George Hans Henry Hiroshi Hugo Ivan James Javier Jean John Jose Joseph Juan Karl Kevin Kofi Louis Luca Lukas Marco Mark Martin Matthew Michael Miguel Mohammed Oliver Omar Oscar Pablo Paul Pedro Peter Philip Pierre Raj Richard Robert Sergio Stefan Steven Thomas Tobias Vikram Wei William".split(),
    ("cyrillic", "f"): "Анна Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
TITLES = frozenset("Mr Mrs Ms Miss Mx Dr Prof Professor Sir Herr Frau Mme Mlle Monsieur Madame Señor Señora Sr Sra Srta г-н г-жа Господин Госпожа".split())
PARTICLES = frozenset("von van der den de del della di da la le du dos das bin ibn al el ter zu".split())
INTRODUCED = "contact call ask meet name named author signed dear hello regards sincerely contacter nom kontakt name grüße nombre contacto llamar".split()
LISTED = {n.lower(): group for group, names in NAMES.items() for n in names}
# Classes of letters, without accents, by script.
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоуыэюя", "greek": "αεηιουω"}
CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxyz", "cyrillic": "бвгджзклмнпрстфхцчшщ", "greek": "βγδζθκλμνξπρστφχψ"}
CLASS = {c: letters for kinds in (VOWELS, CONSONANTS) for letters in kinds.values() for c in letters}
ALL_VOWELS = frozenset("".join(VOWELS.values()))
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ADDRESS = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
MAC = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
CARD = re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])")
PHONE = re.compile(r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d-])")
KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?P<known>AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza)(?P<rest>[A-Za-z0-9_-]{12,}))")
NAMED = re.compile(r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s*(?:=|:)\s*[\"']?(?P<value>[^\s\"',;]{6,})")
BLOCK = re.compile(r"-----BEGIN (?P<label>[A-Z ]*PRIVATE KEY)-----(?P<value>[^-]+)-----END (?P=label)-----")
PART = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
LETTERS = re.compile(r"[^\W\d_]+")
INNER = re.compile(r"[-'’]")
CUED = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(INTRODUCED)})[:,]?\s+(?={PART.pattern}[  ]{PART.pattern})")
#: Country calling codes of one digit, and of two; others have three.
CALLING_1, CALLING_2 = frozenset("17"), frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
MOST_STEPS = 1_000_000
SECRET_WORDS = ("passw", "pwd", "token", "secret", "key")


class Cycle:
    """For a key and a space of n values: the next value on a cycle through all of them."""

    ROUNDS = 8

    def __init__(self, key: bytes, space: str, n: int):
        self.key, self.n = hashlib.blake2b(space.encode(), key=key, digest_size=32).digest(), n
        self.half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.mask, self.bytes = (1 << self.half) - 1, -(-self.half // 8)

    def _round(self, i: int, half: int) -> int:
        size = min(64, self.bytes)
        out, block = b"", 0
        while len(out) < self.bytes:
            out += hashlib.blake2b(bytes([i, block]) + half.to_bytes(self.bytes, "big"), key=self.key, digest_size=size).digest()
            block += 1
        return int.from_bytes(out[: self.bytes], "big") & self.mask

    def _there(self, x: int) -> int:
        a, b = x >> self.half, x & self.mask
        for i in range(self.ROUNDS):
            a, b = b, a ^ self._round(i, b)
        return a << self.half | b

    def _back(self, x: int) -> int:
        a, b = x >> self.half, x & self.mask
        for i in range(self.ROUNDS - 1, -1, -1):
            a, b = b ^ self._round(i, a), a
        return a << self.half | b

    def next(self, x: int) -> int:
        x = self._there(x)
        while x >= self.n:
            x = self._there(x)
        x = self._back((x + 1) % self.n)
        while x >= self.n:
            x = self._back(x)
        return x


@lru_cache(4096)
def _cycle(key: bytes, space: str, n: int) -> Cycle:
    return Cycle(key, space, n)


def spelled(key: bytes, space: str, text: str, alphabet: Callable[[int, str], str | None], same: Callable[[str], object] = lambda s: None, steps: int = 1) -> str:
    """The value so many steps on, among texts that differ only in letters that have an alphabet; `same` must not change."""
    letters = [alphabet(i, c) for i, c in enumerate(text)]
    n, rank = 1, 0
    for a, c in zip(letters, text):
        if a:
            n, rank = n * len(a), rank * len(a) + a.index(c)
    if n == 1:
        return text
    # What every value of the space shares names the space.
    cycle, kept = _cycle(key, f"{space}|{'|'.join(a or '=' + c for a, c in zip(letters, text))}", n), same(text)
    value = text
    for _ in range(steps):
        for _ in range(MOST_STEPS):
            rank = cycle.next(rank)
            out, r = [], rank
            for a, c in zip(reversed(letters), reversed(text)):
                out.append(a[r % len(a)] if a else c)
                r = r // len(a) if a else r
            value = "".join(reversed(out))
            if same(value) == kept:
                break
        else:
            raise RuntimeError(f"no surrogate of a value of {space} found in {MOST_STEPS} steps")
    return value


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _refill(mention: str, value: str, is_part: Callable[[str], bool]) -> str:
    """The mention with its significant letters replaced by the value's, in order; capitals as before."""
    out, own = [], iter(value)
    for c in mention:
        if is_part(c):
            v = next(own)
            out.append(v.upper() if c.isupper() else v)
        else:
            out.append(c)
    return "".join(out)


def _by_class(i: int, c: str) -> str | None:
    return DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else None


@lru_cache(100_000)
def folded(word: str) -> str:
    """In lower case and without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


@lru_cache(4096)
def kin(c: str) -> str | None:
    """The letters that may stand for c: its class, else those of its script and case within its block of 64 code points."""
    if c in CLASS:
        return CLASS[c]
    script, kind, first = unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), ord(c) & ~63
    if kind[0] != "L":
        return None
    stable = lambda d: unicodedata.normalize("NFD", d) == d and (kind != "Ll" or (d.upper() != d and d.upper().lower() == d))
    found = [d for d in map(chr, range(first, first + 64)) if d not in CLASS and unicodedata.category(d) == kind and unicodedata.name(d, "").split(" ")[0] == script and stable(d)]
    return "".join(found) if len(found) > 1 and c in found else None


class Surrogates:
    """Surrogates of entities under one key, each a function of kind, canonical value and steps along its cycle."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def email(self, mention: str, steps: int = 1) -> str:
        local, _, domain = mention.rpartition("@")
        host, _, top = domain.rpartition(".")
        low = spelled(self.key, "local", local.lower(), lambda i, c: DIGITS if c in DIGITS else LOWER if c in LOWER else None, steps=steps)
        host_low = spelled(self.key, "host", host.lower(), lambda i, c: DIGITS if c in DIGITS else LOWER if c in LOWER else None)
        every = lambda c: True
        return f"{_refill(local, low, every)}@{_refill(host, host_low, every)}.{top}"

    def card(self, mention: str, steps: int = 1) -> str:
        digits = re.sub(r"\D", "", mention)
        return _refill(mention, spelled(self.key, "card", digits, lambda i, c: DIGITS if i else None, luhn, steps), str.isdigit)

    def ssn(self, mention: str, steps: int = 1) -> str:
        real = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        return _refill(mention, spelled(self.key, "ssn", mention.replace("-", ""), lambda i, c: DIGITS, real, steps), str.isdigit)

    def phone(self, mention: str, steps: int = 1) -> str:
        digits = re.sub(r"\D", "", mention)
        country = 0 if mention[:1] != "+" else 1 if digits[:1] in CALLING_1 else 2 if digits[:2] in CALLING_2 else 3
        kept = country + (digits[country : country + 1] == "0")
        same = lambda s: s[kept] in "01" if len(s) > kept else None
        return _refill(mention, spelled(self.key, "phone" + mention[:1] * (mention[:1] == "+"), digits, lambda i, c: DIGITS if i >= kept else None, same, steps), str.isdigit)

    def address(self, mention: str, steps: int = 1) -> str:
        a, b, c, d = map(int, mention.split("."))
        value = a << 24 | b << 16 | c << 8 | d
        # Networks of a use of their own, by first address and prefix length.
        special = [(0x00000000, 8), (0x0A000000, 8), (0x7F000000, 8), (0xA9FE0000, 16), (0xAC100000, 12), (0xC0A80000, 16), (0xE0000000, 4), (0xF0000000, 4)]
        of = lambda v: next(((first, size) for first, size in special if v >> (32 - size) == first >> (32 - size)), None)
        net = of(value)
        base, n = (net[0], 1 << (32 - net[1])) if net else (0, 1 << 32)
        cycle = _cycle(self.key, f"address{base}", n)
        for _ in range(steps):
            value = cycle.next(value - base) + base
            while of(value) != net:
                value = cycle.next(value - base) + base
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))

    def mac(self, mention: str, steps: int = 1) -> str:
        digits = mention.replace(":", "").lower()
        return _refill(mention, spelled(self.key, "mac", digits, lambda i, c: HEX, lambda s: int(s[1], 16) & 3, steps), lambda c: c != ":")

    def iban(self, mention: str, steps: int = 1) -> str:
        text = mention.replace(" ", "")
        if iban_rest(text) != 1:
            value = spelled(self.key, "iban", text, lambda i, c: None if i < 2 else DIGITS if c in DIGITS else UPPER, lambda s: iban_rest(s) == 1, steps)
        else:
            rest = spelled(self.key, "iban|" + text[:2], text[4:], lambda i, c: DIGITS if c in DIGITS else UPPER, steps=steps)
            value = text[:2] + f"{98 - iban_rest(text[:2] + '00' + rest):02d}" + rest
        return _refill(mention, value, lambda c: c != " ")

    def secret(self, mention: str, steps: int = 1) -> str:
        m = KEY.fullmatch(mention)
        head = m["known"] if m else ""
        rest = mention[len(head) :]
        if len(rest) >= 8 and all(c in HEX for c in rest.lower()) and rest != rest.swapcase() and (rest.isupper() or rest.islower()):
            # With a letter before and after, so that the case is told.
            low = spelled(self.key, "hex" + head, rest.lower(), lambda i, c: HEX, lambda s: any(c > "9" for c in s), steps)
            return head + (low.upper() if rest.isupper() else low)
        return head + spelled(self.key, "secret" + head, rest, _by_class, steps=steps)

    def name(self, part: str, steps: int = 1) -> str:
        """A part of a person's name; "-" and "'" divide parts."""
        apart = unicodedata.normalize("NFD", part)
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in apart)
        group = LISTED.get(unicodedata.normalize("NFC", low))
        if group:
            names = NAMES[group]
            at, cycle = [n.lower() for n in names].index(low), _cycle(self.key, f"name{group}", len(names))
            for _ in range(steps):
                at = cycle.next(at)
            value = names[at]
            return value.upper() if part.isupper() else value if part[:1].isupper() else value.lower()
        letters = [i for i, c in enumerate(low) if c.isalpha()]
        last = letters[-1] if len(letters) > 3 and low[letters[-1]] in ALL_VOWELS else -1
        alphabet = lambda i, c: None if i == last else kin(c)
        if not any(alphabet(i, c) for i, c in enumerate(low)):
            alphabet = lambda i, c: CONSONANTS["latin"] + c if c.isalpha() else None
        value = spelled(self.key, "part", low, alphabet, lambda s: s in LISTED, steps)
        return unicodedata.normalize("NFC", "".join(v.upper() if c.isupper() and len(v.upper()) == 1 else v for c, v in zip(apart, value)))


_INTRODUCED = frozenset(x for w in INTRODUCED for x in (w, w.title(), w.upper()))
_TRIGGERS = TITLES | {t.upper() for t in TITLES} | frozenset(x for n in LISTED for x in (n.title(), n.upper()))


def people(text: str, emails: list[str] = [], names: frozenset[str] = frozenset()) -> list[tuple[int, int]]:  # noqa: B006
    """Where parts of people's names are, in one pass over the words and one over the capitalised ones; names: more given names, in lower case."""
    words = set(LETTERS.findall(text))
    cued = {m.end() for m in CUED.finditer(text)} if words & _INTRODUCED else set()
    accents = not text.isascii() and any(not w.isascii() and w[0].isupper() and folded(w) in LISTED for w in words)
    if not (words & _TRIGGERS or "г-" in text or cued or emails or accents or (names and any(w.lower() in names for w in words))):
        return []
    own = lambda w: w[:-2] if w[-2:] in ("'s", "’s") and len(w) > 2 else w
    told = [(own(m[0]), m.start(), m.start() + len(own(m[0]))) for m in PART.finditer(text)]
    made_of = {frozenset(x for x in re.split(r"[^a-z]+", e.partition("@")[0].lower()) if len(x) > 1) for e in emails}
    written = {re.sub(r"[^a-z]", "", e.partition("@")[0].lower()) for e in emails}
    lower = {w for w, _, _ in told if w.islower()} if cued else set()
    capital = lambda w: w[0].isupper()
    able = lambda w: w[0].isupper() or not w[0].islower()
    gap = lambda i: text[told[i][2] : told[i + 1][1]] if i + 1 < len(told) else None
    near = lambda i: gap(i) in (" ", "\u00a0") or (len(told[i][0]) == 1 and gap(i) in (". ", ".", ".\u00a0"))
    title = lambda w: w in TITLES or (len(w) > 1 and w.isupper() and w.title() in TITLES)
    listed = lambda w: capital(w) and (w.lower() in LISTED or w.lower() in names or (not w.isascii() and folded(w) in LISTED))

    def run(i: int, ok: Callable[[str], bool], most: int) -> list[int]:
        """The words from i on that make a name, particles between them left out."""
        out: list[int] = []
        while i < len(told) and len(out) < most:
            j = i
            while j < len(told) and told[j][0] in PARTICLES and near(j):
                j += 1
            if j >= len(told) or not ok(told[j][0]) or title(told[j][0]):
                break
            out.append(j)
            if not near(j):
                break
            i = j + 1
        return out

    found: set[int] = set()
    for i, (w, at, _) in enumerate(told):
        if title(w) and gap(i) in (" ", ". ", "  ", ".  ", "\u00a0", ".\u00a0", "."):
            found.update(run(i + 1, able, 3))
        elif not capital(w):
            continue
        elif listed(w):
            some = run(i, capital, 3)
            if len(some) > 2 and not (len(told[some[1]][0]) == 1 or listed(told[some[1]][0])):
                some = some[:2]
            found.update(some if len(some) > 1 else [])
        if (made_of or at in cued) and near(i) and capital(told[i + 1][0]) and capital(w):
            v = told[i + 1][0]
            a, b = folded(w), folded(v)
            if a != b and (any({a, b} <= x for x in made_of) or a + b in written or a[0] + b in written or b + a in written):
                found.update((i, i + 1))
            elif at in cued and a != b and len(w) > 1 and len(v) > 1 and not w.isupper() and not v.isupper() and w.lower() not in lower and v.lower() not in lower:
                found.update((i, i + 1))
    if not found:
        return []
    long = {told[i][0].lower() for i in found if len(told[i][0]) > 2}
    short = {told[i][0] for i in found if len(told[i][0]) <= 2}
    out = []
    for i, (w, a, b) in enumerate(told):
        if i in found or (able(w) and w.lower() in long):
            out.append((a, b))
        elif w in short:
            before = text[:a].rstrip()[-1:] if a < 64 else text[a - 64 : a].rstrip()[-1:]
            if before and before not in ".!?…:;" and "\n" not in text[max(0, a - 2) : a]:
                out.append((a, b))
        elif able(w) and ("-" in w or "'" in w or "’" in w):
            at = a
            for part in INNER.split(w):
                if part[:1].isupper() and part.lower() in long:
                    out.append((at, at + len(part)))
                at += len(part) + 1
    return out


def find(text: str, names: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """Where entities are (start, end, kind), in order and without overlap; names: given names, in lower case, besides the listed ones."""
    out: list[tuple[int, int, str]] = []
    rest = text  # with what is found blotted out, so that nothing reaches into it

    def add(kind: str, pattern: re.Pattern, group: str | int = 0, check: Callable[[str], bool] = lambda s: True) -> None:
        nonlocal rest
        found = [m.span(group) for m in pattern.finditer(rest) if check(m[group]) and "\0" not in m[group]]
        if found:
            out.extend((a, b, kind) for a, b in found)
            parts, at = [], 0
            for a, b in found:
                parts += [rest[at:a], "\0" * (b - a)]
                at = b
            rest = "".join([*parts, rest[at:]])

    low = text.lower()
    if "-----begin" in low:
        add("secret", BLOCK, "value")
    if "@" in text:
        add("email", EMAIL)
    if any(w in low for w in SECRET_WORDS):
        add("secret", NAMED, "value")
    if re.search(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza", text):
        add("secret", KEY)
    if re.search(r"\d\D{0,2}\d", text):
        add("mac", MAC)
        add("iban", IBAN, 0, lambda s: 15 <= len(s.replace(" ", "")) <= 34 and (iban_rest(s.replace(" ", "")) == 1 or len(s.replace(" ", "")) >= 18))
        add("address", ADDRESS)
        add("ssn", SSN)
        add("phone", PHONE)
        add("card", CARD, 0, lambda s: luhn(re.sub(r"\D", "", s)))
    out.extend((a, b, "name") for a, b in people(rest, [text[a:b] for a, b, k in out if k == "email"], names))
    return sorted(out)


def canonical(kind: str, mention: str) -> str:
    """What two mentions of one entity share."""
    if kind == "email" or kind == "mac" or kind == "name":
        return unicodedata.normalize("NFC", mention.lower())
    if kind == "phone":
        return mention[:1] * (mention[:1] == "+") + re.sub(r"\D", "", mention)
    return re.sub(r"\D", "", mention) if kind in ("card", "ssn") else mention.replace(" ", "") if kind == "iban" else mention


def replace(text: str, surrogates: Surrogates, names: frozenset[str] = frozenset()) -> tuple[str, list[dict]]:
    """The text with surrogates in place of its entities, and where they are in it."""
    spans = find(text, names)
    if not spans:
        return text, []
    taken: dict[tuple[str, str], str] = {}
    chosen: dict[tuple[str, str], int] = {}

    def apart(kind: str, mention: str) -> str:
        make, who = getattr(surrogates, kind), canonical(kind, mention)
        steps = chosen.get((kind, who), 1)
        made = first = make(mention, steps)
        while canonical(kind, made) == who or taken.get((kind, canonical(kind, made)), who) != who:  # another entity's surrogate: go on along the cycle
            steps += 1
            made = make(mention, steps)
            if made == first:
                raise RuntimeError(f"all surrogates of a space of {kind} are taken")
        chosen[kind, who] = steps
        taken.setdefault((kind, canonical(kind, made)), who)
        return made

    out, told, at, size = [], [], 0, 0
    for a, b, kind in spans:
        mention = text[a:b]
        who = canonical(kind, mention)
        made = "".join(apart(kind, p) if p and p not in "-'’" else p for p in re.split("([-'’])", mention)) if kind == "name" else apart(kind, mention)
        out += [text[at:a], made]
        size += a - at
        told.append({"kind": kind, "start": size, "length": len(made), "surrogate": made, "tag": hashlib.blake2b(f"{kind}|{who}".encode(), key=surrogates.key, digest_size=16).hexdigest()})
        size += len(made)
        at = b
    return "".join([*out, text[at:]]), told


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", names: frozenset[str] = frozenset()) -> DataFrame:
    """The rows with text replaced, n_entities, and entities (kind, start, length, surrogate, keyed tag of the original)."""
    schema = with_fields(docs.schema, ("n_entities", "int"), ("entities", "array<struct<kind:string,start:int,length:int,surrogate:string,tag:string>>"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("surrogate", pa.string()), ("tag", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for b in slices(batches):
            texts, told = [], []
            for t in b.column(b.schema.names.index(text)).to_pylist():
                new, found = replace(t, surrogates, names) if t else (t, [])
                texts.append(new)
                told.append(found)
            yield replaced(b, schema, {text: pa.array(texts, pa.string()), "n_entities": pa.array([len(x) for x in told], pa.int32()), "entities": pa.array(told, kind)})

    return map_rows(docs, run, schema)


def collisions(done: DataFrame) -> DataFrame:
    """kind and surrogate of each surrogate that stands for two entities anywhere in the corpus; no rows, unless a space is used up."""
    e = done.select(F.explode("entities").alias("e")).select("e.kind", F.lower("e.surrogate").alias("surrogate"), "e.tag").distinct()
    return e.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
