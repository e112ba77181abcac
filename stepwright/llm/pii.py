"""Personal information in free text: e-mail addresses, phone and identity numbers, street addresses, names.

The extraction is bootstrapped. A scan of every whole text gives candidates: spans that have the
outline of a kind, each with an instance (the span in a normal form) and the lexical patterns it
stands in: the words before it, its mask of digits and separators, its type word, its partner in a
name. A few seeds are certain by their form. From there Spark scores the graph of patterns and
instances in turns: a pattern is as good as its known instances, an instance as its patterns, and
instances above a threshold count as known in the next turn. High-confidence patterns so find
identifiers of forms that no seed has, and what they don't reach isn't reported.

Positions count code points of the text as given. The scan reads a view of the text in which soft
line breaks, quoted-printable bytes, character references, wrongly decoded UTF-8 and quote marks at
line starts are undone, and base64 parts and encoded header words are blanked out; a span is
reported where its first character stands in the given text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize, ship

KINDS = ("email", "phone", "identity", "address", "name")

# Titles, particles of family names, and words that open a seed or a known other number.
TITLES = ("dr", "prof", "mr", "mrs", "ms", "herr", "frau", "mme", "m", "sr", "sra")
PARTICLES = ("van der", "van den", "von der", "de la", "van", "von", "de", "di", "da", "du", "del", "la", "le", "ter", "zu")
FLATS = ("flat", "apt", "apt.", "unit", "suite")
NO_STREET = FLATS + tuple("jan feb mar apr may jun jul aug sep oct nov dec mon tue wed thu fri sat sun".split())
STREET_FIRST = ("rue", "avenue", "impasse", "allée", "boulevard", "chemin", "place", "quai", "cours", "calle", "plaza", "paseo", "avda.", "avenida", "c/", "ronda", "camino", "travesía", "glorieta", "carrer")
STREET_LAST = ("rd", "rd.", "road", "st", "st.", "street", "avenue", "ave", "ave.", "lane", "close", "court", "drive", "way", "terrace", "place", "square")
STREET_END = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer")
OTHER_UNITS = ("room", "raum", "ticket", "version", "build", "lot", "charge", "week", "woche", "semaine", "semana", "channels", "reads", "lauf", "code", "order", "bestellung", "run", "sample", "samples", "rows", "code")

_LETTER = r"[^\W\d_]"
_NAME = rf"{_LETTER}+(?:['’]{_LETTER}+)?(?:-{_LETTER}+)*"

#: What the view undoes or blanks out: base64 lines, encoded header words, soft line breaks, quoted-printable
#: bytes, character references, line ends with quote marks, and wrongly decoded UTF-8. The pattern begins with
#: one set of characters, so the search skips from one of them to the next.
_BASE64 = r"(?:[A-Za-z0-9+/]{60,80}(?:\r?\n|\Z))+(?:[A-Za-z0-9+/]{2,80}={0,2}(?=\r?\n|\Z))?"
_EDITS = re.compile(
    "[\n\r=&\xc2-\xf4](?:"
    rf"(?<=\n)(?:{_BASE64}|[>|][>| ]*)|(?<=\r)\n(?:{_BASE64}|[>| ]*)"
    r"|(?<==)(?:\r?\n|\?[\w-]+\?[bBqQ]\?[^?\s]*(?:\?=)?|[0-9A-F]{2}(?:=[0-9A-F]{2})*)"
    r"|(?<=&)(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,5});"
    "|(?<=[\xc2-\xf4])[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ][\x80-\xf4€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]*)"
)


def _mended(s: str) -> str | None:
    """Text whose UTF-8 bytes were read as Latin-1 or Windows-1252, as it was."""
    for code in ("latin-1", "cp1252"):
        try:
            return s.encode(code).decode("utf-8")
        except UnicodeError:
            pass
    try:
        return b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in s).decode("utf-8")
    except UnicodeError:
        return None


def view(text: str) -> tuple[str, list[int], list[int]]:
    """The text as the scan reads it, with the starts of its unchanged stretches there and in the given text."""
    out, here, there, at, length = [], [0], [0], 0, 0
    for m in _EDITS.finditer(text):
        s = m[0]
        c = s[0]
        if c in "\r\n":
            new = "\n" if len(s) < 60 or not s.strip()[:1].isalnum() and s.strip()[:1] not in "+/" else "\n\x01"
        elif c == "=":
            if s[1] in "\r\n":
                new = ""
            elif s[1] == "?":
                new = "\x01"
            else:
                raw = bytes.fromhex(s.replace("=", ""))
                try:
                    new = raw.decode("utf-8")
                except UnicodeError:
                    new = raw.decode("latin-1")
        elif c == "&":
            new = html.unescape(s)
        else:
            new = _mended(s)
        if new is None or new == s:
            continue
        a, b = m.span()
        out.append(text[at:a])
        length += a - at
        here.append(length)
        there.append(a)
        out.append(new)
        length += len(new)
        here.append(length)
        there.append(b)
        at = b
    if not out:
        return text, here, there
    out.append(text[at:])
    return "".join(out), here, there


_SIGN = re.compile(r"@|\[(?:@|at)\] ?|\(at\) ?")
_SIGN_OR_WORD = re.compile(_SIGN.pattern + r"|at (?=[\w.-]+ dot )")
_DOT = r"(?:\.|\[\.\]|\(\.\)| ?\[dot\] ?| ?\(dot\) ?| dot )"
_HOST = re.compile(rf"[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]*)+")
_DOTS = re.compile(_DOT)
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+-'"
#: Message ids are machines' names for messages: digits of base 16, with counters after dots or without.
_MACHINE = re.compile(r"(?=[a-fA-F]*\d)[0-9a-fA-F]{8,}(?:\.\d+)*")

#: Numbers are searched for from their first digit or letter; the signs before it are looked at afterwards.
_NUMBER = re.compile(r"\d[\d()./ -]{5,24}\d(?:[ -]?[A-Z](?![\w'’]))?(?![\w@:=]|[.-]\w|/\w)")
_LETTERED = re.compile(
    r"[A-Z](?:[A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|-(?<=[XYZ]-)\d{7}-?[A-Z]|\d(?<=[XYZ]\d)\d{6}-?[A-Z])(?!\w)(?![@:=]|[.-]\w|/\w)"
)
_DIGITS = re.compile(r"\d+")
_MASK = str.maketrans({**{d: "9" for d in "012345678"}, **{chr(c): "A" for c in range(65, 91)}})
_MASK_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ012345678", b"A" * 26 + b"9" * 9)
_SIGNS = re.compile(r"\W")
_TWO_NUMBERS = re.compile(r"  +|[ ][-/(]?[ ]")

_IDENTITY_WORDS = re.compile(r"steuer-id|steuernummer|security|sécurité sociale|identidad|\bdni\b|\bnif\b|\bnie\b|passport|insurance number")
#: Every one of them has such a piece.
_IDENTITY_PIECES = ("steuer", "security", "sociale", "identidad", "dni", "nif", "nie", "passport", "insurance")
_FLAT = re.compile(r"(?:Flat|FLAT|flat|Apt\.?|Unit|Suite)[ \n]\d{1,4},?[ \n]\Z")
#: Begins with the number's last digit, so that the search skips the rest; what stands before is looked at afterwards.
#: What may follow the digit is told apart by its first character, so that most digits fail at once.
_HOUSE_FIRST = re.compile(
    r"\d(?:[ \n](?:(?:bis|ter|quater|BIS|TER),?[ \n])?|,[ \n]|[a-zA-Z](?:[ \n](?:bis|ter|quater|BIS|TER))?,?[ \n])"
    rf"((?=[^\W\d_a-z]|{'|'.join(map(re.escape, STREET_FIRST))})(?:{_LETTER}[\w'’.-]*)(?:[ \n]{_LETTER}[\w'’-]*\.?){{1,5}})"
)
#: The number that ends a street line, from the character before its first digit on, and the sign of a number before it
#: with the blank before that.
_HOUSE_LAST = re.compile(r"[ \nº.]\d(?:(?<!\.\d)|(?<=Nr\.\d))\d*+ ?[a-z]?(?![\w:/%])(?![.,-]\d)")
_NUMBER_SIGN = re.compile(r"[ \n](?:n\.º|nº|Nr\.) ?\Z")
_STREET_WORD = r"[^\W\d_a-z][\w'’-]*"
_STREET_WORDS = re.compile(
    rf"(?<![\w-])((?:[^\W\d_a-z][\w'’./-]*)(?:[ \n](?:de|del|la|las|los|el|der|den|dem|am|im|zur|zum|an|{_STREET_WORD})){{0,4}}),?\Z"
)
_STREET_PARTICLES = frozenset("de del la las los el der den dem am im zur zum an".split())
_NO_STREET = frozenset(NO_STREET)


_TOWN = re.compile(r"(?:, (?:Apt\. \d+|\d+º \w|bajo))?(?:,[ \n]|</p>\s*<p>|<br>|\n)\d{5}[ \n][^\W\d_]")
_PARTICLE = "|".join(PARTICLES)
_WORD = re.compile(_NAME)
_AFTER_PLAIN = re.compile(rf"\s({_NAME})")
_PARTICLE_FIRST = frozenset(c for p in PARTICLES for c in (p[0], p[0].upper()))
_AFTER = re.compile(rf"\s(?:({_LETTER})\.\s)?((?:(?i:{_PARTICLE})\s)?)({_NAME})")
_BEFORE = re.compile(rf"(?<![^\W_])((?:(?i:{_PARTICLE})\s)?)({_NAME})(,?)\s\Z")
_DOT_SPACE = re.compile(r"\.(?<![a-z0-9]\.)\s")
_AFTER_INITIAL = re.compile(rf"((?:(?:{_PARTICLE})\s)?)({_NAME})")
_INITIAL_LAST = re.compile(rf",\s({_LETTER}\.)")
_LAST_NAME = re.compile(rf"(?<![\w@-])((?:(?:{_PARTICLE})\s)?)({_NAME})\Z")


_DIGIT = re.compile(r"[0-8]")
_LOWER_9 = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ012345678", b"abcdefghijklmnopqrstuvwxyz" + b"9" * 9)


def _words_before(text: str, at: int, n: int, span: int = 60) -> str:
    """The n words before a position, of so many characters at most, digits as 9; ends of lines and tags are words."""
    left = text[max(0, at - span) : at]
    left = left.encode().translate(_LOWER_9).decode() if left.isascii() else _DIGIT.sub("9", left.lower())
    return " ".join(left.replace("\n", " ¶ ").replace("<", " ¶ ").replace(">", " ¶ ").split()[-n:])


# Number masks that are certain by their form, and words that announce an identity number.
PHONE_MASK = r"^\(?\+"
IDENTITY_MASK = "^(AA ?99 ?99 ?99 ?A|99999999[ -]?A|A-?9999999-?A)$"
OTHER_MASK = r"^(9{4}-9{2,4}-9{2,4}|9{1,3}(\.9{1,3}){1,3}|9{4}-9{1,2}-9{1,2}|9{1,2}[/-]9{1,2}[/-]9{2,4}( .*)?|9{1,6})$"
OTHER_LEFT = "esmtp id$"
_OTHER = re.compile(OTHER_MASK)


def _word_before(text: str, at: int) -> str:
    """The same for one word, without a look at the rest where it stands apart by one blank."""
    c = text[at - 1 : at]
    if c and c in "\n<>":
        return "¶"
    if c == " ":
        left = text[max(0, at - 61) : at - 1]
        word = left[max(left.rfind(" "), left.rfind("\n"), left.rfind("<"), left.rfind(">")) + 1 :]
        if word.isalpha():
            return word.lower()
    return _words_before(text, at, 1)


class Scan:
    """Finds the candidates of one text.

    known tells whether a folded word may be a given name. It may say yes to others: such words only give
    candidates of their own, which the exact join rejects, and take none away from real names.
    """

    def __init__(self, known):
        self.known = known
        self.words = _Pieces(known)

    def emails(self, t: str):
        for m in (_SIGN_OR_WORD if " dot " in t else _SIGN).finditer(t):
            host = _HOST.match(t, m.end())
            if not host:
                continue
            end = m.start()
            if m[0] != "@" and end and t[end - 1] == " ":
                end -= 1
            elif m[0][0] == "a":  # the word at stands apart
                continue
            head = t[max(0, end - 64) : end]
            start = end - len(head) + len(head.rstrip(_LOCAL))
            while start and (t[start - 1].isalnum() or t[start - 1] in "._+-'"):
                start -= 1
            while start < end and not (t[start].isalnum() or t[start] == "_"):
                start += 1
            if start >= end:
                continue
            local, name, sign = t[start:end].lower(), host[0].lower(), m[0].strip()
            if "[" in name or "(" in name or " " in name:  # dots that are written otherwise
                name = _DOTS.sub(".", host[0]).lower()
            if _MACHINE.fullmatch(t, start, end):
                seed, sign, name = 2, "id", "id"  # says nothing about its host
            else:
                top = name[name.rfind(".") + 1 :]
                seed = int((sign == "@" or sign == "at") and len(top) > 1 and top.isalpha())
            yield "email", start, host.end(), f"{local}@{name}", sign, _word_before(t, start), seed, name

    @staticmethod
    def _opens(t: str, a: int) -> int:
        """Where a number that begins at a may open, up to two signs + or ( before it; -1 if it is part of something."""
        c = t[a - 1 : a]
        if c in (" ", "\n"):
            return a
        if c and c not in "+(":
            return -1 if c.isalnum() or c in "_@#=-" or c in "/.:" and t[max(0, a - 2) : a - 1].isdigit() else a
        for b in range(max(0, a - 2), a + 1):
            if all(c in "+(" for c in t[b:a]):
                left = t[b - 1 : b]
                if left and (left.isalnum() or left in "_@#+=-" or left in "/.:" and t[max(0, b - 2) : b - 1].isdigit()):
                    continue
                return b
        return -1

    def numbers(self, t: str):
        at = 0
        while m := _NUMBER.search(t, at):
            a = m.start()
            b = self._opens(t, a)
            if b < 0:  # within a word: its other digits are no beginnings either
                at = _DIGITS.match(t, a).end()
                continue
            s, at = t[b : m.end()], m.end()
            cut = _TWO_NUMBERS.search(s)
            if cut:  # the search goes on behind the sign, as the match may end within the second number
                s, at = s[: cut.start()], b + cut.end()
            s = s.rstrip(" (./-")
            if s[0] == "(" and s.count("(") > s.count(")"):
                s, b = s[1:], b + 1
            bare = self._bare(s)
            if 7 <= len(bare) - bare[-1].isalpha() <= 15:
                yield self._number(t, b, s, bare)
        for m in _LETTERED.finditer(t):
            a = m.start()
            left = t[a - 1 : a]
            if not (left and (left.isalnum() or left in "_@#+=-" or left in "/.:" and t[max(0, a - 2) : a - 1].isdigit())):
                yield self._number(t, a, m[0], self._bare(m[0]))

    @staticmethod
    def _bare(s: str) -> str:
        """A number without its signs."""
        return s.encode().translate(None, b"()./ +-").decode() if s.isascii() else _SIGNS.sub("", s)

    @staticmethod
    def _number(t: str, a: int, s: str, bare: str):
        words = _words_before(t, a, 8)
        told = False
        for piece in _IDENTITY_PIECES:
            if piece in words:
                told = _IDENTITY_WORDS.search(words, words.rfind("9") + 1) is not None
                break
        left = words.rsplit(" ", 2)[-2:]
        mask = s.encode().translate(_MASK_ASCII).decode() if s.isascii() else s.translate(_MASK)
        return "number", a, a + len(s), bare, mask, " ".join(left), int(told), left[-1]

    def streets(self, t: str):
        for m in _HOUSE_FIRST.finditer(t):
            a = m.start()
            while a and t[a - 1].isdigit():
                a -= 1
            if a and (t[a - 1].isalnum() or t[a - 1] in "_.:/-"):
                continue
            words = m[1].replace("\n", " ").split(" ")
            low = [w.lower() for w in words]
            # Five digits and a word are a postcode and a town, unless the line has a type of street.
            long = t[a + 3 : a + 5].isdigit() and t[a + 4 : a + 5] != ""
            if low[0] in STREET_FIRST:  # type first, then one group of words: it ends with the first capitalised one
                n = next((i + 1 for i, w in enumerate(words) if i and not w.islower()), 0)
                if not n:
                    continue
                kind = low[0]
            else:
                last = [i for i, w in enumerate(low) if i and w in STREET_LAST]
                if long and not last:
                    continue
                n = last[0] + 1 if last else min(2, len(words))
                if not (words[0][0].isupper() and words[n - 1][0].isupper()):
                    continue
                kind = low[n - 1].rstrip(".")
            street = " ".join(low[:n]).rstrip(".")
            end = m.start(1) + len(" ".join(words[:n]))
            if long and "\n" in t[a:end]:
                continue
            flat = _FLAT.search(t, max(0, a - 14), a) if t[a - 1 : a].isspace() else None
            a = flat.start() if flat else a
            yield "address", a, end, street, f"first {kind}", _word_before(t, a), int(self._town(t, end)), ""
        for m in _HOUSE_LAST.finditer(t):
            # The last word before the number must be able to end a street; most aren't.
            i = m.start()
            a = i + 1
            if t[i] in "º." or t[i - 1 : i] in ("º", "."):
                sign = _NUMBER_SIGN.search(t, max(0, a - 6), a)
                if sign:
                    i = sign.start()
                elif t[i] in "º.":
                    continue
            j = i - 1 if t[i - 1 : i] == "," else i
            k = t.rfind(" ", 0, j) + 1
            k = max(k, t.rfind("\n", k, j) + 1)
            c = t[k : k + 1]
            if j == k or "a" <= c <= "z" and t[k:j] not in _STREET_PARTICLES or c.isdigit():
                continue
            if t[k:j].lower() in _NO_STREET and (k < 2 or self._apart(t, k - 1)):
                continue
            line = t[max(0, i - 200) : i].rsplit(None, 5)[-5:]
            n = _STREET_WORDS.search(t, i - len(" ".join(line)), i)
            if not n:
                continue
            words = n[1].replace("\n", " ").split(" ")
            low = [w.lower() for w in words]
            first = next((i for i, w in enumerate(low) if w in STREET_FIRST), None)
            if low[-1] in (NO_STREET if first is None else FLATS):
                continue
            if m[0][5:6].isdigit() and (first is not None or j < i or t[i] == "\n" or not low[-1].endswith(STREET_END)):
                continue
            # With a type word the address begins there, else with the last word.
            i = first if first is not None else len(words) - 1
            kind = low[i] if first is not None else "…" + low[i][-5:]
            a = n.start(1) + len(" ".join(words[:i])) + (1 if i else 0)
            yield "address", a, m.end(), " ".join(low[i:]), f"last {kind}", _word_before(t, a), int(self._town(t, m.end())), ""

    @staticmethod
    def _apart(t: str, b: int) -> bool:
        """Whether what stands before the blank at b surely is no word of a street: a number, or it ends with a sign."""
        word = t[t.rfind(" ", 0, b) + 1 : b]
        c = word[-1:]
        return word.isdigit() or not (c.isalnum() or c in "_'’./-")

    @staticmethod
    def _town(t: str, end: int) -> bool:
        """Whether a postcode and a town follow, after the flat and a line end at most."""
        return _TOWN.match(t, end) is not None

    def names(self, t: str):
        """Candidates of names in their order. Those that overlap an earlier one are chained with it, by a number in
        the column seed (0: alone); which of them stands is decided once it is known which words are given names."""
        found = []
        for a, b in self._places(t):
            if a and t[a - 1] in ".@_-+":
                continue
            after = self._after(t, a, b)
            if not after or after[4] != "plain":
                before = self._before(t, a, b)
                if before:
                    found.append(before)
            if after:
                found.append(after)
        for m in _DOT_SPACE.finditer(t):
            a = m.start() - 1
            if a < 0 or not t[a].isupper() or (a and (t[a - 1].isalnum() or t[a - 1] in "_.@-")):
                continue
            n = _AFTER_INITIAL.match(t, m.end())
            if n and n[2][0].isupper():
                found.append((a, n.end(), t[a].lower() + ".", n[2].lower(), "initial"))
        for m in _INITIAL_LAST.finditer(t):
            left = t[max(0, m.start() - 60) : m.start()]
            n = _LAST_NAME.search(left)
            if n and n[2][0].isupper() and m[1][0].isupper():
                found.append((m.start() - len(left) + n.start(), m.end(), m[1][0].lower() + ".", n[2].lower(), "initial"))
        found.sort()
        chain, top, chains = 0, -1, [0] * len(found)
        for i, x in enumerate(found):
            if x[0] < top:
                if not chains[i - 1]:
                    chain += 1
                    chains[i - 1] = chain
                chains[i] = chains[i - 1]
            top = max(top, x[1])
        for c, (start, end, given, family, style) in zip(chains, found):
            yield "name", start, end, family, given, "", c, style

    def _places(self, t: str):
        """Where words stand that may be given names; each different piece of the text is looked up once."""
        for w in self.words(t):
            a = t.find(w)
            while a >= 0:
                b = a + len(w)
                if not (a and (t[a - 1].isalpha() or t[a - 1] == "-")) and not (t[b : b + 1].isalpha() or t[b : b + 1] == "-"):
                    yield a, b
                a = t.find(w, b)

    def _after(self, t: str, a: int, b: int):
        c = t[b + 1 : b + 2]
        if not c.isalnum():
            return None
        if c in _PARTICLE_FIRST or t[b + 2 : b + 3] == ".":  # a particle or an initial may stand between
            m = _AFTER.match(t, b)
            last = m and m[3]
        else:
            m = _AFTER_PLAIN.match(t, b)
            last = m and m[1]
        if not m or t[m.end() : m.end() + 1] in ("@", "_"):
            return None
        plain = last[0].isupper() and t[a].isupper() and "\n" not in m[0]
        return a, m.end(), t[a:b].lower(), last.lower(), "plain" if plain else "loose"

    def _before(self, t: str, a: int, b: int):
        if not t[a - 1 : a].isspace() or not (t[a - 2 : a - 1].isalpha() or t[a - 2 : a - 1] == ","):
            return None
        left = t[max(0, a - 60) : a]
        # A name with its particle is three words at most: the search needn't begin before them.
        words = left.rsplit(None, 3)
        m = _BEFORE.search(left, len(words[0]) if len(words) == 4 else 0)
        if not m or "\n\n" in m[0]:
            return None
        start = a - len(left) + m.start(1)
        if start and t[start - 1] in "@._-":
            return None
        return start, b, t[a:b].lower(), m[2].lower(), "reverse" if m[3] else "loose"

    def __call__(self, text: str) -> list[tuple]:
        t, here, there = view(text)
        found = [*self.emails(t), *self.numbers(t), *self.streets(t), *self.names(t)]
        if len(here) == 1:
            return found
        moved = [b - a for a, b in zip(here, there)]
        return [(c[0], c[1] + moved[bisect_right(here, c[1]) - 1], c[2] + moved[bisect_right(here, c[2]) - 1], *c[3:]) for c in found]


BITS = 1 << 22


CANDIDATE = "doc_id bigint, kind string, start_pos int, end_pos int, instance string, pattern string, left string, seed int, style string"


def candidates(docs: DataFrame, given: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All candidates of all texts, see Scan; given names are looked up in a filter of fixed size, then exactly."""
    ship(docs.sparkSession)
    words = docs.sparkSession.sparkContext.broadcast(_bloom_words(given))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Scan(words.value.has)
        names = [f.split(" ")[0] for f in CANDIDATE.split(", ")]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            docs, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = finder(text)
                found += got
                docs += [doc] * len(got)
            columns = [docs, *(zip(*found) if found else [[]] * (len(names) - 1))]
            # By kind, so that readers of one kind can skip the pages of the others.
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(columns, types)], names).sort_by("kind")

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    return texts.mapInArrow(scan, CANDIDATE)


class _Pieces:
    """The words of a text that may be given names. What each piece without blanks has is remembered for a bounded number
    of pieces, and those that have none, which are most, are passed over together."""

    def __init__(self, known):
        self.known = known
        self.none: set[str] = set()
        self.hits: dict[str, list[str]] = {}

    def __call__(self, t: str) -> set[str]:
        got, known, none, hits = set(), self.known, self.none, self.hits
        if len(none) + len(hits) >= 200_000:
            none.clear()
            hits.clear()
        for piece in set(t.split()) - none:
            words = hits.get(piece)
            if words is None:
                words = [w for w in _WORD.findall(piece) if known(w.lower())]
                if len(piece) <= 64:
                    if words:
                        hits[piece] = words
                    else:
                        none.add(piece)
            got.update(words)
        return got


class _Words:
    """A Bloom filter over words, with what it said remembered for a bounded number of them."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.said: dict[str, bool] = {}

    def has(self, word: str) -> bool:
        got = self.said.get(word)
        if got is None:
            if len(self.said) >= 200_000:
                self.said.clear()
            got = self.said[word] = all(self.bits[h >> 3] & (128 >> (h & 7)) for h in _spots(word))
        return got


def _spots(word: str) -> list[int]:
    import xxhash

    data = word.encode()
    return [xxhash.xxh64_intdigest(data, seed) % BITS for seed in (1, 2)]


def _bloom_words(given: DataFrame) -> _Words:
    """The filter of given names, put together from one filter per partition: its size is fixed."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = {h for b in batches for w in b.column(0).to_pylist() for h in _spots(w)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(spots), pa.int32())], ["spot"])

    bits = np.zeros(BITS, dtype=bool)
    marks = given.select("given").mapInArrow(fill, "spot int").distinct()
    for b in marks.select("spot").toLocalIterator():
        bits[b[0]] = True
    return _Words(np.packbits(bits))


def mailbox_pairs(docs: DataFrame, text_col: str) -> DataFrame:
    """The different pairs of a given and a family name before a mailbox, and whether its local part has the family name."""
    box = (
        r"[\p{Lu}][\p{L}'’-]+ (?:(?:" + "|".join(PARTICLES) + r") )?[\p{Lu}][\p{L}-]+\"? ?(?:<|&lt;<a href=\"mailto:)[\w.+-]+@"
    )
    parts = r"^(\S+) (?:(?:" + "|".join(PARTICLES) + r") )?(\S+?)\"? ?(?:<|&lt;<a href=\"mailto:)([\w.+-]+)@"
    # A box ends with its only @, has a < before that and no end of line: it is looked for in what stands before each @ on a
    # line of its own, not from every letter of the text.
    pieces = F.split(text_col, "@")
    ends = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.substring_index(x, "\n", -1))
    lines = docs.where(F.col(text_col).contains("@")).select(F.explode(ends).alias("line")).where(F.col("line").contains("<"))
    found = lines.select(F.regexp_extract(F.concat("line", F.lit("@")), box, 0).alias("box")).where("box <> ''")
    cut = found.groupBy("box").agg(F.count("*").alias("n")).select(
        F.lower(F.regexp_extract("box", parts, 1)).alias("given"),
        F.lower(F.regexp_extract("box", parts, 2)).alias("family"),
        F.lower(F.regexp_extract("box", parts, 3)).alias("local"),
    )
    runs = F.transform(F.regexp_extract_all("family", F.lit("[a-z]+"), F.lit(0)), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
    longest = F.array_max(runs)
    proof = (longest["n"] >= 4) & F.col("local").contains(longest["r"])
    return cut.where("given <> '' and family <> ''").groupBy("given", "family").agg(F.max(F.coalesce(proof, F.lit(False))).alias("proof"))


def given_names(pairs: DataFrame, least: float = 0.3, support: int = 2) -> DataFrame:
    """Given names from mailbox pairs (given, family, proof): (given).

    Seeds are the families that their mailbox's local part repeats. A given name is as good as the
    share of its families that are known, of at least `support`; a family is known too if a good given
    name stands before it. Turns end when no new given name comes. Names of desks and machines stand
    before one word only.
    """
    known, found, given = pairs.where("proof").select("family").distinct(), -1, None
    while True:
        marked = pairs.join(known.withColumn("is_known", F.lit(1)), "family", "left")
        scored = marked.groupBy("given").agg(F.count("*").alias("n"), F.count("is_known").alias("k"))
        new = materialize(scored.where((F.col("k") >= support) & (F.col("k") >= least * F.col("n"))).select("given"), "given")
        if given is not None:
            discard(given)
        given, n = new, new.count()
        if n == found:
            return given
        found = n
        known = pairs.where("proof").select("family").unionByName(pairs.join(given, "given", "left_semi").select("family")).distinct()


def bootstrap(
    combos: DataFrame, weights: dict[str, float], classes: list[str], turns: int | None = None, least: float = 0.6, need: float = 1.0
) -> DataFrame:
    """Score a graph of patterns and instances; returns the distinct combos with the class each gets, or null.

    combos has the columns of weights, which name the nodes of a combo (its instance among them), and
    seed, its class if its form makes it certain. In each turn every node gets the shares of the
    classes among its known combos of different instances, and every combo the mean of its nodes'
    shares, by weight. Combos of at least `least` for a class, from nodes of at least `need` weight,
    are known from then on. Without turns it goes on until a turn finds nothing new, which it must, as
    each finds at least one combo. Nodes are counted in aggregations, so frequent ones are no hot spots.
    """
    nodes = list(weights)
    state = materialize(combos.groupBy(*nodes).agg(F.max("seed").alias("seed")).withColumn("known", F.col("seed")).withColumn("new", F.lit(False)), "combos")
    while turns is None or turns > 0:
        scored = state
        for c in nodes:
            # Different instances are counted exactly, in two steps with partial sums; combos of one instance count each.
            seen = state.where("known is not null")
            if c != "instance":
                seen = seen.groupBy(c, "instance", "known").agg(F.count("*").alias("n"))
            counts = seen.groupBy(c).agg(*[F.count_if(F.col("known") == k).alias(f"k{i}") for i, k in enumerate(classes)])
            total = sum((F.col(f"k{i}") for i in range(len(classes))), F.lit(0))
            shares = counts.where(F.col(c).isNotNull()).select(c, F.array(*[F.col(f"k{i}") / total for i in range(len(classes))]).alias(f"share_{c}"))
            scored = scored.join(shares, c, "left")
        got = sum((F.when(F.col(f"share_{c}").isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
        score = [
            F.try_divide(sum((F.coalesce(F.col(f"share_{c}")[i] * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0)), got)
            for i in range(len(classes))
        ]
        best: Column = F.lit(None).cast("string")
        for s, k in zip(score, classes):
            best = F.when((s >= least) & (got >= need), F.lit(k)).otherwise(best)
        # Known combos stay as they are; only the others need a score.
        news = scored.where("known is null").select(*nodes, "seed", best.alias("known"), best.isNotNull().alias("new"))
        olds = state.where("known is not null").select(*nodes, "seed", "known", F.lit(False).alias("new"))
        after = materialize(olds.unionByName(news), "combos")
        discard(state)
        state = after
        turns = None if turns is None else turns - 1
        if turns is None and state.where("new").isEmpty():
            break
    return state.drop("new")


def known_families(names: DataFrame, pairs: DataFrame, affix: int = 3, least: float = 0.5, confident: float = 0.3) -> DataFrame:
    """Family names from the candidates of names (family, given, style, sure) and mailbox pairs: (family).

    A graph of words and patterns, in turns until no new family comes. Seeds are the families in
    mailboxes of given names. Patterns are the given names themselves, each as good as the share of
    known families among all words that follow it in mailboxes and texts (from `confident` on, all of
    them are families), and the first and last letters: as good as their share of known families
    among all words that have them and stand beside a given name or an initial. Words with a good
    beginning and a good end, such as a family that only stands before a comma, are known next.
    """
    beside = names.groupBy("family").agg(F.count("*").alias("n")).select("family")
    sure = pairs.join(names.where("sure").select("given").distinct(), "given", "left_semi").select("given", "family")
    edges = materialize(names.where("sure and style = 'plain'").select("given", "family").unionByName(sure).distinct(), "edges")
    words = beside.unionByName(edges.select("family")).distinct().join(sure.select("family", F.lit(True).alias("known")).distinct(), "family", "left")
    cut = [F.substring("family", 1, affix).alias("head"), F.expr(f"right(family, {affix})").alias("tail")]
    state, found = materialize(words.select("family", *cut, F.coalesce("known", F.lit(False)).alias("known")), "words"), -1
    while True:
        n = state.where("known").count()
        if n == found:
            return state.where("known").select("family")
        found = n
        marked = edges.join(state.where("known").select("family", F.lit(1).alias("hit")), "family", "left")
        good_given = marked.groupBy("given").agg((F.count("hit") >= confident * F.count("*")).alias("good")).where("good")
        led = edges.join(good_given, "given", "left_semi").select("family", F.lit(True).alias("led")).distinct()
        shares = {
            c: state.groupBy(c).agg(F.avg(F.col("known").cast("double")).alias(f"of_{c}"), F.count_if("known").alias(f"n_{c}")) for c in ("head", "tail")
        }
        shaped = reduce(lambda a, b: a & b, [(F.col(f"of_{c}") >= least) & (F.col(f"n_{c}") >= 3) for c in shares])
        joined = state.join(led, "family", "left").join(shares["head"], "head").join(shares["tail"], "tail")
        after = materialize(joined.select("family", "head", "tail", (F.col("known") | F.coalesce("led", F.lit(False)) | shaped).alias("known")), "words")
        discard(state)
        state = after


def _classed(rows: DataFrame, nodes: dict[str, float], kinds: list[str], need: float = 1.0) -> DataFrame:
    """Rows (doc_id, start_pos, end_pos, nodes, seed) whose seed, or whose combo in the graph, is of one of the kinds."""
    graph = bootstrap(rows.select(*nodes, "seed"), nodes, ["other", *kinds], need=need)
    at = ["doc_id", "start_pos", "end_pos"]
    own = rows.where(F.col("seed").isin(kinds)).select(*at, F.col("seed").alias("kind"))
    by_graph = rows.where("seed is null").drop("seed").join(graph.where(F.col("known").isin(kinds)), list(nodes))
    return own.unionByName(by_graph.select(*at, F.col("known").alias("kind")))


def _standing(names: DataFrame) -> DataFrame:
    """Without those of the names (…, seed, style) that overlap an earlier one: the words of a name on one line are no
    part of another, and an initial within a name is none itself. Chains are short: they end where words don't touch."""
    at = ["doc_id", "start_pos", "end_pos"]
    spans = names.where("seed > 0").groupBy("doc_id", "seed").agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos", "style"))).alias("spans"))
    kept = F.expr(
        "aggregate(spans, struct(0 as done, 0 as far, array_remove(spans, spans[0]) as kept), (a, x) -> "
        "if(x.start_pos < a.done or (x.style = 'initial' and x.start_pos < a.far), a, struct("
        "if(x.style = 'plain', greatest(a.done, x.end_pos), a.done) as done, if(x.style = 'initial', a.far, greatest(a.far, x.end_pos)) as far, "
        "array_append(a.kept, x) as kept)), a -> slice(a.kept, size(spans), size(a.kept)))"
    )
    chained = spans.select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.start_pos", "x.end_pos")
    return names.where("seed = 0").select(*at).unionByName(chained)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences of personal information: (doc_id, kind, start_pos, end_pos).

    kind is email, phone, identity, address or name; positions count code points of the text from 0,
    end_pos is the one after the last.
    Null, empty and blank texts have none, an empty table gives none; a doc_id that occurs twice with
    the same text has its occurrences once. Other columns aren't read. Phone numbers have 7 to 15
    digits, as the international numbering plan allows.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    pairs = materialize(mailbox_pairs(texts, "text"), "pairs")
    given = given_names(pairs)
    found = materialize(candidates(texts, given, "doc_id", "text"), "candidates")
    at = ["doc_id", "start_pos", "end_pos"]

    form = F.when(F.col("seed") == 2, "other").when(F.col("seed") == 1, "email")
    emails = found.where("kind = 'email'").select(*at, "instance", F.col("pattern").alias("sign"), F.col("style").alias("host"), "left", form.alias("seed"))
    by_email = _classed(emails, {"instance": 2.0, "host": 1.0, "sign": 1.0, "left": 0.5}, ["email"])

    form = (
        F.when(F.col("left").rlike(OTHER_LEFT), "other")
        .when(F.col("pattern").rlike(PHONE_MASK), "phone")
        .when(F.col("pattern").rlike(IDENTITY_MASK) | (F.col("seed") > 0), "identity")
        .when(F.col("pattern").rlike(OTHER_MASK), "other")
    )
    numbers = found.where("kind = 'number'").select(*at, "instance", F.col("pattern").alias("mask"), "left", F.col("style").alias("word"), form.alias("seed"))
    by_number = _classed(numbers, {"instance": 1.0, "mask": 2.0, "left": 1.0, "word": 0.5}, ["phone", "identity"])

    unit = F.split("instance", " ")
    form = F.when(F.array_contains(F.lit(list(OTHER_UNITS)), unit[0]) | F.array_contains(F.lit(list(OTHER_UNITS)), F.element_at(unit, -1)), "other").when(F.col("seed") > 0, "address")
    streets = found.where("kind = 'address'").select(*at, "instance", F.col("pattern").alias("type"), "left", form.alias("seed"))
    by_street = _classed(streets, {"instance": 2.0, "type": 2.0, "left": 0.5}, ["address"], need=2.0)

    names = found.where("kind = 'name'").select(*at, F.col("instance").alias("family"), F.col("pattern").alias("given"), "seed", "style")
    marked = names.join(given.withColumn("sure", F.lit(True)), "given", "left").withColumn("sure", F.coalesce("sure", F.lit(False)))
    family = materialize(known_families(marked.select("family", "given", "style", "sure"), pairs), "families")
    named = marked.where("sure or style = 'initial'").join(family, "family", "left_semi")
    by_name = _standing(named).withColumn("kind", F.lit("name"))
    every = reduce(DataFrame.unionByName, [by_email, by_number, by_street, by_name])
    return every.groupBy("doc_id", "kind", "start_pos").agg(F.max("end_pos").alias("end_pos"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's text with typed placeholders such as [PHONE] for what was found: (doc_id, text, n_replaced).

    A span that begins inside an earlier one is part of it. Texts without finds stay as they are,
    null stays null. doc_id must be unique.
    """
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("spans"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    put = F.expr(
        "aggregate(spans, struct(0 as pos, '' as out, 0 as n), (a, x) -> if(x.start_pos >= a.pos, "
        "struct(x.end_pos as pos, concat(a.out, substring(text, a.pos + 1, x.start_pos - a.pos), '[', upper(x.kind), ']') as out, a.n + 1 as n), a))"
    )
    return (
        texts.join(spans, "doc_id", "left")
        .withColumn("r", F.when(F.col("spans").isNotNull(), put))
        .select("doc_id", F.coalesce(F.concat("r.out", F.expr("substring(text, r.pos + 1)")), F.col("text")).alias("text"), F.coalesce("r.n", F.lit(0)).alias("n_replaced"))
    )
