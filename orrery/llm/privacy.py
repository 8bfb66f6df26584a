"""PII surrogates: keyed, type-consistent replacements that keep gender, script, format, distinctness and coreference.

Every entity is reduced to a canonical number within its class (all phones of nine free digits, all card numbers of a network
and length, all words of a vowel-consonant shape ...), and a keyed permutation of the class gives the surrogate. A permutation
maps different entities to different surrogates and the same entity to the same one, in every document and on every
executor, without a shared table; a collision check per document and one over the corpus (``collisions``) hold it to that.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from hashlib import blake2b
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, with_columns

ROUNDS = 8
#: Characters that are permuted as one number.
PIECE = 48
#: Times that a surrogate that stands for another entity of the text already is permuted anew.
RETRIES = 16

# Given names by gender, titles by gender, alphabets (vowels, consonants) by script.
GIVEN = {
    "latin": {
        "f": "Anna Maria Emma Sophie Laura Julia Sarah Clara Elena Lucia Carmen Isabel Camille Chloe Louise Alice Emily Olivia Hannah Grace Katharina Johanna Helena Martina Fatima Aisha Mei Priya Giulia Francesca Beatriz Ingrid Agnieszka Zofia Yuki Leila Elizabeth Jennifer Patricia Margaret".split(),
        "m": "John James Robert Michael David Thomas Daniel Peter Paul Martin Lukas Felix Johannes Stefan Pierre Antoine Julien Nicolas Carlos Miguel Javier Pablo Andrew George Wei Mohammed Ahmed Omar Raj Arjun Giovanni Marco Pedro Lars Sven Piotr Hiroshi Kenji William Richard".split(),
    },
    "cyrillic": {
        "f": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
        "m": "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел".split(),
    },
    "greek": {"f": "Μαρία Ελένη Κατερίνα Σοφία Ιωάννα Δήμητρα".split(), "m": "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος".split()},
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Госпожа Κυρία".split(), "m": "Mr Herr Monsieur Señor Don Господин Κύριος".split(), "": "Dr Prof Doctor Professor".split()}
ALPHABETS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "áàâäãåāăąæéèêëēėęíìîïīįóòôöõøōőœúùûüūůűųýÿ", "çćčďđğłľñńňŕřśşšťþźżž",
    "аеиоуыэюяёіїє", "бвгджзйклмнпрстфхцчшщґђјљњџ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώϊϋ",
)
#: Capitalised words that end a name: days and months, words that open questions and clauses.
NO_NAMES = frozenset(
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December "
    "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Januar Februar März Mai Juni Juli Oktober Dezember "
    "Who What When Where Why How The This That These Those And But For From Has Had Was Were Will Would Der Die Das Und Period".split()
)
#: What a name follows, in any script.
INTRODUCTIONS = "my name is|My name is|Signed by|signed by|Mein Name ist|mein Name ist|Ich heiße|ich heiße|Je m'appelle|je m'appelle|Me llamo|me llamo|Меня зовут|меня зовут|Με λένε|με λένε"
#: Blocks of IPv4 addresses with a use of their own, none inside another; all other addresses are public.
BLOCKS = [
    ipaddress.ip_network(n)
    for n in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()
]
#: First and last code points of scripts without vowels of their own or without case: a character goes to one of the same range.
RANGES = ((0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x05D0, 0x05EA), (0x0621, 0x063A), (0x0905, 0x0939))

_PLACE = {c: (i, k) for i, a in enumerate(ALPHABETS) for k, c in enumerate(a)}
_HEX, _UPPER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


class Permutation:
    """Keyed permutations without fixed points of {0 .. size - 1}, one for each class name."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _noise(self, name: str, i: int, half: int) -> int:
        return int.from_bytes(blake2b(f"{name}\0{i}\0{half}".encode(), key=self.key, digest_size=64).digest(), "big")

    def _mix(self, x: int, size: int, name: str, back: bool) -> int:
        side = isqrt(size - 1) + 1
        while True:  # a Feistel network on side x side; walk on until inside
            left, right = divmod(x, side)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                left, right = ((right - self._noise(name, i, left)) % side, left) if back else (right, (left + self._noise(name, i, right)) % side)
            x = left * side + right
            if x < size:
                return x

    def __call__(self, x: int, size: int, name: str, ok: Callable[[int], bool] = lambda y: True) -> int:
        """The surrogate of x among the values that are ``ok`` (x is); x itself only where there is no other on its cycle."""
        if size < 2:
            return x
        y = x
        while True:  # back at x at the latest
            y = self._mix((self._mix(y, size, name, False) + 1) % size, size, name, True)
            if y == x or ok(y):
                return y

    def again(self, times: int) -> Permutation:
        """Other permutations under the same key."""
        return Permutation(self.key + times.to_bytes(4, "big"))


def _spell(text: str, at: Permutation, name: str, alphabets: list[str], ok: Callable[[str], bool] = lambda s: True) -> str:
    """Permutes ``text``, whose characters each go to one of the alphabet given for their place. Long texts go piece by piece, which
    keeps different texts different and the numbers within what one hash can shift."""
    if len(text) > PIECE:
        return "".join(_spell(text[i : i + PIECE], at, f"{name}#{i}", alphabets[i : i + PIECE]) for i in range(0, len(text), PIECE))
    x, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        x, size = x * len(a) + a.index(c), size * len(a)

    def word(y: int) -> str:
        out = []
        for a in reversed(alphabets):
            y, k = divmod(y, len(a))
            out.append(a[k])
        return "".join(reversed(out))

    return word(at(x, size, f"{name}:{'/'.join(a if len(a) < 40 else a[0] + a[-1] for a in alphabets)}", lambda y: ok(word(y))))


def _alphabet(c: str) -> str:
    if c in _PLACE:
        return ALPHABETS[_PLACE[c][0]]
    for a, b in RANGES:
        if a <= ord(c) <= b:
            return "".join(map(chr, range(a, b + 1)))
    return c  # other characters stay: part of the format


def _word(word: str, at: Permutation, name: str, ok: Callable[[str], bool] = lambda s: True) -> str:
    """A word of the same script and shape; case is carried over place by place."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
    new = _spell(low, at, name, [_alphabet(c) for c in low], ok)
    return "".join(n.upper() if c != lo and len(n.upper()) == 1 else n for c, lo, n in zip(word, low, new, strict=True))


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _email(m: re.Match, at: Permutation) -> tuple[str, str]:
    local, _, domain = m[0].rpartition("@")
    host, dot, top = domain.rpartition(".")
    return m[0].lower(), f"{_word(local, at, 'mailbox')}@{_word(host, at, 'host.' + top.lower())}{dot}{top}"


def _phone(m: re.Match, at: Permutation) -> tuple[str, str] | None:
    shape = m[0].replace("(0)", "(\0)")  # a trunk prefix is no part of an international number
    digits = re.sub(r"\D", "", shape)
    plus = shape.startswith("+")
    if plus and digits[0] == "1" or not plus and len(digits) == 10 and digits[0] != "0":  # one numbering plan, with or without its code
        head, tail = (digits[:1], digits[1:]) if plus else ("", digits)
        if len(tail) != 10 or tail[0] in "01":
            return None
        middle = ["5", "5", "5"] if tail[3:6] == "555" else ["0123456789"] * 3  # numbers of fiction stay fiction
        new = _spell(tail, at, "phone1", ["23456789", "0123456789", "0123456789", *middle, *["0123456789"] * 4], lambda s: (s[3:6] == "555") == (tail[3:6] == "555"))
        return "+1" + tail, _refill(shape, head + new).replace("\0", "0")
    if plus and 8 <= len(digits) <= 15:
        return "+" + digits, _refill(shape, digits[:2] + _spell(digits[2:], at, "phone" + digits[:2], ["0123456789"] * (len(digits) - 2))).replace("\0", "0")
    if plus or m["national"] is None or not 9 <= len(digits) <= 12 or _DATE.match(shape):
        return None
    return digits, _refill(shape, "0" + _spell(digits[1:], at, "phone0", ["123456789", *["0123456789"] * (len(digits) - 2)]))


def _card(m: re.Match, at: Permutation) -> tuple[str, str] | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or not _luhn(digits):
        return None
    body = digits[0] + _spell(digits[1:-1], at, f"card{digits[0]}{len(digits)}", ["0123456789"] * (len(digits) - 2))
    return digits, _refill(m[0], next(body + c for c in "0123456789" if _luhn(body + c)))


def _ssn(m: re.Match, at: Permutation) -> tuple[str, str]:
    good = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    digits = m[0].replace("-", "")
    return digits, _refill(m[0], _spell(digits, at, "ssn", ["0123456789"] * 9, good if good(digits) else lambda s: True))


def _iban(m: re.Match, at: Permutation) -> tuple[str, str] | None:
    flat = m[0].replace(" ", "")
    check = lambda land, body: 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    if not 15 <= len(flat) <= 34 or check(flat[:2], flat[4:]) != int(flat[2:4]):
        return None
    body = _spell(flat[4:], at, "iban" + flat[:2], ["0123456789" if c.isdigit() else _UPPER[:26] for c in flat[4:]])
    new = iter(f"{flat[:2]}{check(flat[:2], body):02d}{body}")
    return flat, "".join(c if c == " " else next(new) for c in m[0])


def _ip4(m: re.Match, at: Permutation) -> tuple[str, str] | None:
    try:
        ip = ipaddress.IPv4Address(m[0])
    except ValueError:
        return None
    if int(ip) in (0, (1 << 32) - 1):  # nobody's
        return None
    block = next((n for n in BLOCKS if ip in n), None)
    if block:
        first = int(block.network_address)
        return m[0], str(ipaddress.IPv4Address(first + at(int(ip) - first, block.num_addresses, f"ip{block}")))
    public = lambda y: not any(ipaddress.IPv4Address(y) in n for n in BLOCKS)
    return m[0], str(ipaddress.IPv4Address(at(int(ip), 1 << 32, "ip", public)))


def _ip6(m: re.Match, at: Permutation) -> tuple[str, str] | None:
    try:
        ip = ipaddress.IPv6Address(m[0])
    except ValueError:
        return None
    if ip.is_loopback or ip.is_unspecified:  # nobody's
        return None
    free = 96 if int(ip) >> 112 == 0x2001 else 112  # the blocks below 2001::/16 are told by 32 bits, all others by 16 or fewer
    head, tail = divmod(int(ip), 1 << free)
    return str(ip), str(ipaddress.IPv6Address((head << free) + at(tail, 1 << free, f"ip6{head:x}", lambda y: head or y > 1)))


def _secret(m: re.Match, at: Permutation) -> tuple[str, str]:
    value = m["value"]
    hexa = all(c in _HEX for c in value)
    new = _spell(value, at, "hex", [_HEX] * len(value)) if hexa else _word(value, at, "secret")
    return value, m[0][: m.start("value") - m.start()] + new + m[0][m.end("value") - m.start() :]


def _cloud_key(m: re.Match, at: Permutation) -> tuple[str, str]:
    return m[0], m[0][:4] + _spell(m[0][4:], at, "cloud", [_UPPER] * (len(m[0]) - 4))


_LISTED = {n.lower(): (script, g, i) for script, by in GIVEN.items() for g, names in by.items() for i, n in enumerate(names)}
_TITLED = {t: g for g, ts in TITLES.items() for t in ts}
_PARTICLES = "von van der den de da di del della la le bin al"


def _cased(new: str, like: str) -> str:
    return new.upper() if len(like) > 1 and like.isupper() else new.lower() if like.islower() else new


def _name(m: re.Match, at: Permutation) -> tuple[str, str] | None:
    """A name behind a title, an introduction or a listed given name: given names go to those of the same gender and script, surnames
    to words of the same script and shape, particles stay. Each part maps alone and whatever its case, so 'Mr John Smith',
    'Mr JOHN SMITH' and 'Mr Smith' stay one family."""
    parts = re.split(r"(\s+)", m["name"])
    end = next((i for i, w in enumerate(parts) if w in NO_NAMES), len(parts))
    parts, rest = parts[: max(0, end - 1) if end < len(parts) else end], parts[max(0, end - 1) :] if end < len(parts) else []
    words = [w for w in parts[::2] if w not in _PARTICLES.split()]
    if not words or m.start() == m.start("name") and len(words) < 2:  # a given name alone may be any word
        return None
    for i in range(0, len(parts), 2):
        w = parts[i]
        if w.lower() in _LISTED:
            script, g, k = _LISTED[w.lower()]
            names = GIVEN[script][g]
            parts[i] = _cased(names[at(k, len(names), f"given{script}{g}")], w)
        elif w not in _PARTICLES.split():
            parts[i] = _word(w, at, "name", lambda s: s not in _LISTED)
    return " ".join(words).lower(), m[0][: m.start("name") - m.start()] + "".join(parts + rest) + m[0][m.end("name") - m.start() :]


_W = r"[A-ZÀ-ÖØ-ÞΆ-ΫЀ-Я\u3041-\u30fa\u4e00-\u9fa5\uac00-\ud7a3][^\W\d_]*(?:['’\-][^\W\d_]+)*"
#: What may stand between two digits of a phone number with +; dates, which aren't national numbers.
_GAP = r"(?:[ .\-]?\(|\)[ .\-]?|[ .\-/]|\(0\)[ .\-]?)?"
_DATE = re.compile(r"0\d[ /\-]\d{1,2}[ /\-](?:19|20)\d\d(?!\d)")
_MORE = rf"(?:[ \t]+(?:{'|'.join(_PARTICLES.split())}))*[ \t]+{_W}"
_GIVENS = "|".join(sorted({n for by in GIVEN.values() for names in by.values() for name in names for n in (name, name.upper())}, key=len, reverse=True))
_GIVEN_PATTERN = re.compile(rf"(?<!\w)(?P<name>(?:{_GIVENS})(?:[ \t]+(?:{_GIVENS})(?!\w))*{_MORE})(?!\w)")
#: (type, what a text must contain for the pattern to be tried, pattern, surrogate), first come first served where they overlap.
DETECTORS: list[tuple[str, tuple[str, ...], re.Pattern, Callable]] = [
    ("email", ("@",), re.compile(r"(?<![\w.+\-])[A-Za-z0-9][\w.+\-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w\-])"), _email),
    ("cloud_key", ("AKIA", "ASIA"), re.compile(r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"), _cloud_key),
    ("secret", ("password", "passwd", "token", "secret", "api_key", "apikey"), re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|token|secret|api_?key)\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9_\-+/]{8,})"), _secret),
    ("iban", (), re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), _iban),
    ("ipv6", ("::", ":"), re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\w)"), _ip6),
    ("ipv4", (".",), re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\w)"), _ip4),
    ("ssn", ("-",), re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"), _ssn),
    ("card", (), re.compile(r"(?<![\w\-])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5})(?!\w|-\d)"), _card),
    ("phone", (), re.compile(rf"(?<![\w+])(?:\+1(?:{_GAP}[0-9]){{10}}(?!\w)|\+[2-9](?:{_GAP}[0-9]){{7,14}}(?!\w)|(?<![.,:/\-])(?P<national>(?:0[1-9][0-9]{{0,4}}[ /\-]|\(0[1-9][0-9]{{0,4}}\)[ \-]?)[0-9]{{2,8}}(?:[ \-][0-9]{{2,8}}){{0,4}}(?![\w:]))|(?:\(\d{{3}}\)[ .\-]?\d{{3}}[ .\-]|\d{{3}}(?P<gap>[ .\-])\d{{3}}(?P=gap))\d{{4}}(?!\w|[.\-]\d))"), _phone),
    ("name", tuple(_TITLED), re.compile(rf"(?<!\w)(?:{'|'.join(sorted(_TITLED, key=len, reverse=True))})\.?[ \t]+(?P<name>{_W}(?:{_MORE}){{0,2}})(?!\w)"), _name),
    ("name", tuple(INTRODUCTIONS.split("|")), re.compile(rf"(?<!\w)(?:{INTRODUCTIONS})[ \t]+(?P<name>{_W}(?:{_MORE}){{0,2}})(?!\w)"), _name),
    ("name", (), _GIVEN_PATTERN, _name),
]
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"\w+")
_LISTED_WORDS = frozenset(_GIVENS.split("|"))  # each is one word, so behind no word character and before a blank it is a whole one

Entity = tuple[int, int, str, str, str]


def _bare(kind: str, m: re.Match, surrogate: str) -> str:
    """A surrogate without what belongs to the mention rather than to the entity: titles and keywords, blanks, case, format."""
    if kind in ("name", "secret"):
        group = "name" if kind == "name" else "value"
        surrogate = surrogate[m.start(group) - m.start() : len(surrogate) - (m.end() - m.end(group))]
    if kind == "phone":
        digits = re.sub(r"\D", "", surrogate.replace("(0)", ""))
        return f"+{digits}" if surrogate[0] == "+" and digits[0] != "1" else digits if digits[0] == "0" else digits[-10:]
    if kind in ("card", "ssn", "iban"):
        return re.sub(r"\W|_", "", surrogate)
    return surrogate if kind in ("secret", "cloud_key") else " ".join(surrogate.lower().split())


def _detected(text: str, at: Permutation) -> list[tuple[int, int, str, str, str, str]]:
    """As ``entities``, with the bare surrogate."""
    digits, listed = None, None
    starts: list[int] = []
    found: list[tuple[int, int, str, str, str, str]] = []  # in order, as starts
    owner: dict[tuple[str, str], str] = {}
    for kind, needs, pattern, make in DETECTORS:
        if needs:
            if not any(n in text for n in needs) and not (kind == "secret" and any(n in text.lower() for n in needs)):
                continue
        if kind in ("iban", "ipv4", "ipv6", "ssn", "card", "phone"):
            digits = bool(_DIGIT.search(text)) if digits is None else digits
            if not digits:
                continue
        elif kind == "name" and not needs:
            listed = not _LISTED_WORDS.isdisjoint(_WORD.findall(text)) if listed is None else listed
            if not listed:
                continue
        for m in pattern.finditer(text):
            k = bisect_left(starts, m.start())
            if k < len(found) and found[k][0] < m.end() or k and found[k - 1][1] > m.start():
                continue
            got, times = make(m, at), 0
            while got and times < RETRIES and owner.setdefault((kind, _bare(kind, m, got[1])), got[0]) != got[0]:
                times += 1
                got = make(m, at.again(times))
            if got:
                starts.insert(k, m.start())
                found.insert(k, (m.start(), m.end(), kind, *got, _bare(kind, m, got[1])))
    return found


def entities(text: str, at: Permutation) -> list[Entity]:
    """(start, end, type, canonical, surrogate) of what is found in the whole text, in order, without overlaps.

    Two entities of a type have two surrogates: the permutations see to it, and where a surrogate of this text should still stand
    for another entity already, the later one is permuted once more."""
    return [f[:5] for f in _detected(text, at)]


def replaced(text: str | None, at: Permutation) -> tuple[str | None, list[Entity]]:
    """The text with surrogates, and what they stand for."""
    if not text:
        return text, []
    found = entities(text, at)
    out, end = [], 0
    for s, e, _, _, new in found:
        out += [text[end:s], new]
        end = e
    return "".join([*out, text[end:]]), found


def pseudonymise(docs: DataFrame, secret: bytes, text: str = "text", name: str = "pii") -> DataFrame:
    """Adds ``name``: struct(text, n_entities, n_distinct, spans) with the whole text rewritten. A scan without a shuffle.

    spans are (type, start, end, surrogate) in the original text, without the original. Null and empty texts and texts without
    entities stay as they are; very long texts are searched whole. Where patterns overlap the first of DETECTORS has it. Repeated rows
    are rewritten alike. An empty table gives an empty result. Other columns pass through untouched; one called ``name`` is replaced.
    """

    batches_of(docs.sparkSession, 1000)
    span = pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])

    def make():
        at = Permutation(secret)

        def rewritten(texts: pa.Array) -> list[pa.Array]:
            new, found = zip(*[replaced(t, at) for t in texts.to_pylist()], strict=True)
            distinct = [len({(k, o) for _, _, k, o, _ in f}) for f in found]
            spans = [[{"type": k, "start": a, "end": b, "surrogate": n} for a, b, k, _, n in f] for f in found]
            columns = [pa.array(new, pa.string()), pa.array(map(len, found), pa.int32()), pa.array(distinct, pa.int32()), pa.array(spans, pa.list_(span))]
            return [pa.StructArray.from_arrays(columns, ["text", "n_entities", "n_distinct", "spans"])]

        return rewritten

    return with_columns(docs, [text], f"`{name}` struct<text:string,n_entities:int,n_distinct:int,spans:array<struct<type:string,start:int,end:int,surrogate:string>>>", make)


def collisions(docs: DataFrame, secret: bytes, text: str = "text") -> DataFrame:
    """(type, surrogate, n) of surrogates, of every type, that stand for n > 1 entities anywhere in the corpus; empty if all is well.

    An audit: a pass of its own over the whole corpus. Entities are told apart by a keyed digest, so no original leaves its row;
    a task's repeats go before the shuffle. Null and empty texts mention nothing; an empty table gives an empty result.
    """

    def mentioned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = Permutation(secret)
        for p in batches:
            found = {(k, o, n) for t in p["_text"] if t for _, _, k, o, _, n in _detected(t, at)}
            yield pd.DataFrame([(k, n, blake2b(o.encode(), key=at.key, digest_size=16).hexdigest()) for k, o, n in found], columns=["type", "surrogate", "entity"])

    said = docs.select(F.col(text).alias("_text")).mapInPandas(mentioned, "type string, surrogate string, entity string")
    return said.distinct().groupBy("type", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


#: For the registered query and the pipeline; a deployment passes its own.
DEMO_SECRET = b"not a secret: for tests and examples"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonymise(docs.select("doc_id", "text"), DEMO_SECRET).select("doc_id", "pii.text", "pii.n_entities", "pii.n_distinct")
