"""Personal information inside free text.

Offset-preserving deobfuscation: small transducers write look-alike characters, spelled digits and
at/dot disguises plainly while every output character remembers its source span; identifiers are
detected in the plain text and their spans mapped back, so only they are replaced.

Person names are found by shape and context, with given names learned from the corpus itself: words
that stand first in many different name shapes where only names stand (whole author fields, after a
title or an introduction). A short list of common given names is a prior, not a condition.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise, spread
from .visual import _LOOK

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

# Some of the commonest given names; :func:`name_evidence` learns the others from the corpus.
GIVEN = """
james robert john michael david william richard joseph thomas charles christopher daniel matthew anthony mark donald
steven paul andrew joshua kenneth kevin brian george mary patricia jennifer linda elizabeth barbara susan jessica
sarah karen lisa nancy betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa
jean pierre marie anna peter hans maria jose juan carlos luis ana francesco giovanni ivan olga mohammed fatima
""".split()
# Words that follow a lone given name or begin a sentence, kept apart from family names.
PLAIN = """
a about after again all also am an and any are as at be because been before both but by can could did do does for
from had has have he her his honestly how i if in is it its just keep like made may me most my never no nobody not
now of on or our ours out she should so than thanks that the their them there they this to too up us very was we
were what when where which who why will with would you your said says stated told called came owns lives was right
and und wir ich meine nach keiner wenn bevor sehr der die das ehrlich niemand y el la los mi muy nadie si tengo ayer
lo en no le les je mon ma on personne est tres franchement si il elle o a eu eles voce ninguem muito na ontem io mia
molto nessuno ho non w moja bardzo nikt de het ik mijn niemand ze bu ben herkes
motors garage owners club channel brothers user group company inc dealer dealership service shop auto autos
""".split()
TITLES = r"(?:mr|mrs|ms|miss|dr|prof|sr|sra|herr|frau|mme|m)\.?"
_SUFFIX = r"(?:street|str|st|avenue|ave|av|road|rd|lane|ln|drive|dr|court|ct|boulevard|blvd|way|mews|place|pl|terrace|ter|highway|hwy|parkway|pkwy|close|crescent|cres|trail|trl|square|sq|row|circle|cir|alley|loop)"
_FLAGS = regex.IGNORECASE

_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_SPELLED = regex.compile(r"\b(?:(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)\b[\s,.-]*){7,}", _FLAGS)
_SPELLED_ONE = regex.compile("|".join(_DIGITS), _FLAGS)
_AT = regex.compile(r"\s*[(\[{<]\s*at\s*[)\]}>]\s*|\s+@\s+(?=[\p{L}\d-]+(?:\.[\p{L}\d-]+)*\.\p{L}{2,})|\s+at\s+(?=[\p{L}\d-]+(?:\s+dot\s+[\p{L}\d-]+)+)", _FLAGS)
_DOT = regex.compile(r"\s*[(\[{<]\s*dot\s*[)\]}>]\s*|\s+dot\s+", _FLAGS)
_EMAIL = regex.compile(r"(?<![\p{L}\d._%+-])[\p{L}\d][\p{L}\d._%+-]*@(?:[\p{L}\d](?:[\p{L}\d-]*[\p{L}\d])?\.)+\p{L}{2,}(?![\p{L}\d-])", _FLAGS)

_NOT_PERSONAL = regex.compile(r"(?r)(?:part|order|serial|casting|ticket|case|vin|invoice|model|stock|item|claim|tracking|reference|ref|campaign|bulletin|tsb|confirmation)s?\.?\s*(?:no\.?|nos\.?|num(?:ber)?|nr\.?|id|code|#)?\s*(?:is|was|:|#)?\s*", _FLAGS)
_EXT = r"(?:\s*(?:,\s*)?(?:ext\.?|extension|x)\s*\d{1,6})?"
_PHONE = regex.compile(
    r"(?<![\p{L}\d.@/#-])(?:"
    r"(?:\+|00)?1[-.\s]?\(?[2-9]\d{2}\)?[-.\s]?[2-9]\d{2}[-.\s]?\d{4}"
    r"|001[-.\s]\(?[2-9]\d{2}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
    r"|\([2-9]\d{2}\)\s?\d{3}[-.\s]?\d{4}"
    r"|[2-9]\d{2}([-.\s])[2-9]\d{2}[-.\s]\d{4}"
    r"|[2-9]\d{2}[2-9]\d{6}"
    r"|(?:\+|00)[2-9]\d{0,2}(?:[-.\s]?\(?\d{1,6}\)?){2,6}"
    r"|0[1-9]\d{0,4}[-\s/.]\d{3,4}[-\s.]?\d{3,5}"
    r"|0[1-9](?:[\s.-]\d{2}){4}"
    r")" + _EXT + r"(?![\p{L}\d]|[-/.]\d)",
    _FLAGS,
)
_ID_WORD = (
    r"(?:ssn|s\.s\.n\.?|social\s+security(?:\s+(?:number|no\.?|card))?|(?:tax(?:payer)?\s+(?:id|identification))(?:\s+(?:number|no\.?))?|tin|itin|ein|passport(?:\s+(?:number|no\.?|nr\.?))?"
    r"|driver'?s?['’]?s?\s+licen[cs]e(?:\s+(?:number|no\.?))?|licen[cs]e\s+(?:number|no\.?)|dl|dni|nie|nif|curp|rfc|cpf|pesel|bsn|nino|national\s+(?:id|insurance)(?:\s+(?:number|no\.?))?"
    r"|identity\s+(?:card|number)(?:\s+(?:number|no\.?))?|id\s+card(?:\s+(?:number|no\.?))?|personal\s+(?:id|identity)(?:\s+(?:number|no\.?))?|reisepass(?:nummer)?|personalausweis(?:nummer)?|steuer-?id(?:nummer)?|f[uü]hrerschein(?:nummer)?|pasaporte|passeport|permis)"
)
_ID = regex.compile(rf"(?<![\p{{L}}\d]){_ID_WORD}\s*(?:is|was|=|:|#|nr\.?|no\.?|n[º°])*\s*[:#]?\s*(?P<v>(?:[A-Z]{{0,3}}[\s-]?)?\d[\dA-Z]*(?:[-.\s/]\d[\dA-Z]*|-[A-Z](?![\p{{L}}]))*)(?![\p{{L}}\d])", _FLAGS)
_SSN = regex.compile(r"(?<![\p{L}\d.#-])(?P<v>\d{3}[- ]\d{2}[- ]\d{4})(?![\p{L}\d]|-\d)")

_UNIT = r"(?:,?\s+(?i:apt|apartment|unit|suite|ste|floor|fl|flat|#)\.?\s*#?\s*(?=[A-Z]?\d)[\dA-Za-z-]+)"
_CITY_WORD = r"(?:\p{Lu}\p{Ll}[\p{L}'’-]*|\p{Lu}[\p{Lu}'’-]{2,})"
_WORD = r"[\p{L}\d'’-]+\.?"
_STREET = regex.compile(
    rf"(?<![\p{{L}}\d.,/@#$-])(?:(?:flat|apt|apartment|unit)\.?\s*[\dA-Z-]+,?\s+)?(?P<no>\d{{1,6}}[A-Z]?)\s+(?P<name>(?:(?:n|s|e|w|ne|nw|se|sw|north|south|east|west)\.?\s+)?(?:{_WORD}\s+){{0,3}}?{_WORD})\s+(?P<suffix>{_SUFFIX})(?![\p{{L}}\d])(?:\.(?=,))?",
    _FLAGS,
)
_STREET_DE = regex.compile(r"(?<![\p{L}\d])\p{L}[\p{L}-]*(?:allee|stra(?:ß|ss)e|weg|gasse|platz|damm|ufer|str\.)\s+\d{1,4}[a-z]?(?![\p{L}\d])(?:,\s*\d{5}\s+\p{L}[\p{L}-]*)?", _FLAGS)
_STREET_ROMANCE = regex.compile(r"(?<![\p{L}\d])(?:calle|avenida|avda\.?|plaza|rua|via|viale|piazza)\s+(?:\p{L}[\p{L}'.-]*\s+){0,3}\p{L}[\p{L}'.-]*,?\s+(?:n[º°.]?\s*)?\d{1,4}(?![\p{L}\d])|(?<![\p{L}\d])\d{1,4},?\s+(?:rue|boulevard|avenue|chemin|all[ée]e)\s+(?:\p{L}[\p{L}'.-]*\s+){0,3}\p{L}[\p{L}'.-]*", _FLAGS)
_BOX = regex.compile(r"(?<![\p{L}\d])(?:p\.?\s*o\.?\s*box|post\s*office\s*box|postfach|apartado(?:\s+postal)?|bo[iî]te\s+postale)\s*#?\s*\d{1,6}(?![\p{L}\d])", _FLAGS)
_TAIL = regex.compile(rf"{_UNIT}?(?:,\s+{_CITY_WORD}(?:\s+{_CITY_WORD})?(?:,?\s+[A-Z]{{2}}(?!\p{{L}}))?)?(?:,?\s+\d{{5}}(?:-\d{{4}})?(?!\d))?")
_NOT_STREET = set("a an and at by for from i in is it of on or so than the then they to was were when with mile miles mph km kmh year years month months day days hour hours volt volts thousand way mode sport lane rpm lb lbs hp cc psi percent dollars bucks owner owners times".split())
_BEFORE_MODEL = regex.compile(r"(?r)(?:^|[\s,])(?:the|my|our|a|an|this|that|exit|route|highway|hwy|interstate|i-)\s*", _FLAGS)

_GIVEN_SET = frozenset(GIVEN)
_NAME_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’]\p{L}[\p{L}\p{M}]*)?(?:-\p{L}[\p{L}\p{M}]*)*")
# Phrases that introduce a person, and what people are to a writer.
_INTRODUCED = r"my name is|i am called|ich hei(?:ß|ss)e|mein name ist|me llamo|mi nombre es|je m'appelle|mi chiamo|meu nome é|nazywam się|mijn naam is|contact|ask for|pregunta por|demandez|attn\.?|attention|signed|regards|sincerely|cheers|written by"
_RELATED = r"advisor|mechanic|technician|manager|salesman|saleswoman|agent|attorney|officer|owner|neighbou?r|buddy|friend|wife|husband|brother|sister|son|daughter|cousin|uncle|aunt|boss|colleague|guy"
_INTRO = regex.compile(rf"(?<!\p{{L}})(?:{_INTRODUCED})[,:]?\s+|(?<![^\s(,]){TITLES}\s+", _FLAGS)
_ROLE = regex.compile(rf"(?<!\p{{L}})(?:{_RELATED})(?:\s+is)?,?\s+", _FLAGS)
_SHAPED = r"\p{Lu}[\p{L}\p{M}'’]+(?:-\p{L}[\p{L}\p{M}'’]+)*"
_WHOLE_NAME = regex.compile(rf"\s*(?i:{TITLES}\s+)?(?P<name>(?P<g>{_SHAPED}) (?:\p{{Lu}}\. )?(?P<f>{_SHAPED})|(?P<f2>{_SHAPED}), (?P<g2>{_SHAPED})(?: \p{{Lu}}\.)?)\s*")
# Particles of family names.
_PARTICLES = frozenset("de del della di da das do dos du des la le los las van von der den ter ten zu zum zur al el bin ben ibn y e".split())


@lru_cache(maxsize=200_000)
def _bare(word: str) -> str:
    t = unicodedata.normalize("NFKD", word.lower().replace("ı", "i").replace("ł", "l"))
    return "".join(c for c in t if not unicodedata.combining(c))


_PLAIN_SET = frozenset(_bare(w) for w in PLAIN)
_DIGIT = regex.compile(r"\d")
_SPECIAL = regex.compile(r"[^\x00-\x7F\p{L}]|[＀-￯ﬀ-ﬆ\U0001D400-\U0001D7FF]")
_FOREIGN = regex.compile(r"[^\x00-\x7F\p{Latin}\p{Han}\p{Hiragana}\p{Katakana}\p{P}\p{S}\s]")
_BRACKET = regex.compile(r"[(\[{<]")

# What a text needs for a pattern to match, as flags of its words: every branch of the pattern holds one
# of these as a whole run of letters, or at an end of a longer run where a part is listed.
GIVEN_NAME, STREET, TITLE, INTRODUCES, IDENTITY, BOX, SPELLED, DOT, STREET_DE, STREET_ROMANCE = (1 << i for i in range(10))
# Runs of letters in the patterns above.
_RUNS = {
    STREET: "street str st avenue ave av road rd lane ln drive dr court ct boulevard blvd way mews place pl terrace ter highway hwy parkway pkwy close crescent cres trail trl square sq row circle cir alley loop",
    STREET_ROMANCE: "calle avenida avda plaza rua via viale piazza rue boulevard avenue chemin allee allée",
    TITLE: "mr mrs ms miss dr prof sr sra herr frau mme m",
    INTRODUCES: "name called heiße heisse llamo nombre appelle chiamo nome nazywam naam contact ask pregunta demandez attn attention signed regards sincerely cheers written advisor "
    "mechanic technician manager salesman saleswoman agent attorney officer owner neighbour neighbor buddy friend wife husband brother sister son daughter cousin uncle aunt boss colleague guy",
    IDENTITY: "ssn s social tax taxpayer tin itin ein passport driver drivers license licence dl dni nie nif curp rfc cpf pesel bsn nino national identity id personal pasaporte passeport permis",
    BOX: "box pobox postfach apartado postale",
    SPELLED: " ".join(_DIGITS),
    DOT: "dot",
}
# Ends of longer runs.
_PARTS = {STREET_DE: ("allee", "straße", "strasse", "weg", "gasse", "platz", "damm", "ufer", "str"), IDENTITY: ("reisepass", "personalausweis", "steuer", "führerschein", "fuhrerschein", "driver"), BOX: ("box",)}
_FLAG_OF = {}
for _flag, _runs in _RUNS.items():
    for _run in _runs.split():
        _FLAG_OF[_run] = _FLAG_OF.get(_run, 0) | _flag
_RUN = regex.compile(r"\p{L}+")
_ASCII_WORD = re.compile("[A-Za-z]+")
_SAME_LETTER = str.maketrans({"ſ": "s", "K": "k", "İ": "i", "ı": "i"})  # fixed values: letters that count as others without case


class WordFlags(dict):
    """word -> flags of what it may be part of, worked out once per different word."""

    def __init__(self, given: frozenset[str], limit: int = 500_000):
        super().__init__()
        self.given, self.limit = given, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        bare = _bare(word)
        got = GIVEN_NAME if bare in self.given or any(x in self.given for x in bare.split("-")) else 0
        for run in _RUN.findall(word.translate(_SAME_LETTER).lower()):
            got |= _FLAG_OF.get(run, 0)
            for flag, parts in _PARTS.items():
                if run.startswith(parts) or run.endswith(parts):
                    got |= flag
        self[word] = got
        return got

    def of(self, text: str) -> int:
        got = 0
        for word in set(_ASCII_WORD.findall(text) if text.isascii() else _NAME_WORD.findall(text)):
            got |= self[word]
        return got


@lru_cache(maxsize=20_000)
def _plain_char(c: str) -> str:
    """A character written plainly: width and ligature forms as letters, blanks as one blank, ignorable
    characters as nothing. Letters of any script stay."""
    name = unicodedata.name(c, "")
    if not c.isalpha() or name.startswith(("FULLWIDTH", "MATHEMATICAL", "LATIN SMALL LIGATURE")):
        p = c.translate(_LOOK)
        return unicodedata.normalize("NFKC", p) if p else p
    return c


class Plain:
    """A text written plainly, with the source offset of every character. ``flags``: what its words may
    be part of."""

    def __init__(self, text: str, words: WordFlags):
        self.source = text
        self.text, self.at = text, None
        if not text.isascii():
            if _SPECIAL.search(text):
                out, at = [], []
                for i, c in enumerate(text):
                    p = _plain_char(c) if ord(c) > 127 else c
                    out.append(p)
                    at.extend([i] * len(p))
                self.text, self.at = "".join(out), at + [len(text)]
            if _FOREIGN.search(self.text):
                self._lookalikes()
        self.flags = words.of(self.text)
        if self.flags & SPELLED:
            self._rewrite(_SPELLED, lambda m: "".join(_DIGITS[d.lower()] for d in _SPELLED_ONE.findall(m.group())))
        # every disguise has an @, a bracket or the word dot
        if "@" in self.text or self.flags & DOT or _BRACKET.search(self.text):
            self._rewrite(_AT, lambda m: "@")
            if self.flags & DOT and "@" in self.text:
                self._rewrite(_DOT, lambda m: ".")

    def _lookalikes(self) -> None:
        """Letters of other scripts inside a word that also has ASCII letters are written as Latin."""
        chars = list(self.text)
        for m in regex.finditer(r"[\p{L}\d]+", self.text):
            w = m.group()
            if not w.isascii() and any("a" <= c.lower() <= "z" for c in w):
                for i in range(m.start(), m.end()):
                    r = _LOOK.get(ord(chars[i]))
                    if r and len(r) == 1:
                        chars[i] = r
        self.text = "".join(chars)

    def _rewrite(self, pattern, to) -> None:
        parts, at, last, hit = [], [], 0, False
        for m in pattern.finditer(self.text):
            new = to(m)
            if not hit:
                hit = True
                if self.at is None:
                    self.at = list(range(len(self.text) + 1))
            parts += [self.text[last : m.start()], new]
            at += self.at[last : m.start()] + [self.at[m.start()]] * len(new)
            last = m.end()
        if hit:
            parts.append(self.text[last:])
            self.at = at + self.at[last:]
            self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        if self.at is None:
            return start, end
        stop = self.at[end] if end < len(self.at) else len(self.source)
        first = self.at[start]
        return first, max(stop, first + 1)


class Detector:
    """Finds items in one text. ``plain_words``: words too common to be family names; ``given``: given
    names; ``skip`` = False runs every pattern on every text (the same result, slower)."""

    def __init__(self, plain_words: frozenset[str] = frozenset(), given: frozenset[str] = _GIVEN_SET, memo: int = 100_000, skip: bool = True):
        self.given = given
        self.plain = _PLAIN_SET | set(plain_words) - given
        self.words = WordFlags(given)
        self.every = 0 if skip else ~0
        self.memo: dict[str, list[tuple[int, int, str]]] = {}
        self.limit = memo

    def find_cached(self, text: str) -> list[tuple[int, int, str]]:
        """:meth:`find`, remembering short texts (names of makers, components) up to a bound."""
        if len(text) > 80:
            return self.find(text)
        got = self.memo.get(text)
        if got is None:
            if len(self.memo) >= self.limit:
                self.memo.clear()
            got = self.memo[text] = self.find(text)
        return got

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) in the source text, in order, not overlapping."""
        p = Plain(text, self.words)
        t, flags = p.text, p.flags | self.every
        got: list[tuple[int, int, str]] = []

        def free(a: int, b: int) -> bool:
            return all(b <= x or y <= a for x, y, _ in got)

        def take(a: int, b: int, kind: str) -> None:
            if a < b and free(a, b):
                got.append((a, b, kind))

        if "@" in t:
            for m in _EMAIL.finditer(t):
                take(m.start(), m.end(), "EMAIL")
        digits = len(_DIGIT.findall(t))
        if digits >= 5 and flags & IDENTITY:
            for m in _ID.finditer(t):
                v = m.group("v")
                if sum(c.isdigit() for c in v) >= 5:
                    take(*m.span("v"), "ID_NUMBER")
        if digits >= 9:
            for m in _SSN.finditer(t):
                if not _NOT_PERSONAL.match(t, 0, m.start()):
                    take(*m.span("v"), "ID_NUMBER")
        if digits:
            if flags & BOX:
                for m in _BOX.finditer(t):
                    take(m.start(), self._tail(t, m.end()), "ADDRESS")
            if flags & (STREET | STREET_DE | STREET_ROMANCE):
                self._streets(t, flags, take)
        if digits >= 9:
            for m in _PHONE.finditer(t):
                n = sum(c.isdigit() for c in m.group())
                if 9 <= n <= 21 and not _NOT_PERSONAL.match(t, 0, m.start()):
                    extra = m.group().endswith(")") and m.group().count(")") > m.group().count("(")
                    take(m.start(), m.end() - extra, "PHONE")
        if flags & (GIVEN_NAME | TITLE | INTRODUCES):
            self._names(t, flags, take, free)
        return sorted((*p.back(a, b), kind) for a, b, kind in got)

    def find_name_field(self, text: str) -> list[tuple[int, int, str]]:
        """:meth:`find` for a field that names a person or a channel: if nothing else is in it, two
        capitalised words that aren't plain words are a name whatever they are."""
        got = self.find(text)
        m = None if got else _WHOLE_NAME.fullmatch(Plain(text, self.words).text)
        if not m:
            return got
        words = [m.group("g") or m.group("g2"), m.group("f") or m.group("f2")]
        if not all(self._family(w, False) for w in words) or len({w.isupper() for w in words}) > 1:
            return got
        a, b = m.span("name")
        return [(*Plain(text, self.words).back(a, b), "NAME")]

    @staticmethod
    def _tail(t: str, at: int) -> int:
        m = _TAIL.match(t, at)
        return m.end() if m else at

    def _streets(self, t: str, flags: int, take) -> None:
        lower = not any(c.isupper() for c in t)
        at = 0
        while m := flags & STREET and _STREET.search(t, at):
            at = m.start() + 1
            words = [w.strip(".").lower() for w in m.group("name").split()]
            core = [w for w in words if w not in ("n", "s", "e", "w", "ne", "nw", "se", "sw", "north", "south", "east", "west")]
            if not core or any(w in _NOT_STREET for w in core) or _BEFORE_MODEL.match(t, 0, m.start()):
                continue
            if any(ch in m.group("name") for ch in ",;:!?") or any(w.endswith(".") and len(w) > 3 for w in m.group("name").split()):
                continue
            first = m.group("name").split()
            if not lower and not all(w[:1].isupper() or w[:1].isdigit() for w in (*first, m.group("suffix"))):
                continue
            take(m.start(), self._tail(t, m.end()), "ADDRESS")
            at = m.end()
        for pattern, flag in ((_STREET_DE, STREET_DE), (_STREET_ROMANCE, STREET_ROMANCE)):
            for m in pattern.finditer(t) if flags & flag else ():
                if lower or m.group()[:1].isupper() or m.group()[:1].isdigit() or pattern is _STREET_ROMANCE:
                    take(m.start(), m.end(), "ADDRESS")

    def _family(self, w: str, text_lower: bool) -> bool:
        """May this word be a family name (or one of an unknown name)?"""
        if len(w) < 2 or not (text_lower or w[:1].isupper()):
            return False
        return all(_bare(x) not in self.plain for x in w.split("-"))

    def _is_given(self, w: str) -> bool:
        return bool(self.words[w] & GIVEN_NAME) and all(_bare(x) in self.given for x in w.split("-"))

    def _names(self, t: str, flags: int, take, free) -> None:
        """Given [M.] [particles] Family, or Family, Given [M.]: the given name is known, or the words
        follow a title, an introduction or a role."""
        lower = t.islower()
        introduced = set()
        if not lower and flags & (TITLE | INTRODUCES):
            introduced = {m.end() for m in _INTRO.finditer(t)}
            if not t.isupper():
                introduced |= {m.end() for m in _ROLE.finditer(t)}
            introduced = {at for at in introduced if t[at : at + 1].isupper()}
        if not introduced and not flags & GIVEN_NAME:
            return
        words = list(_NAME_WORD.finditer(t))
        gap = lambda j: t[words[j].end() : words[j + 1].start()] if j + 1 < len(words) else ""
        done = 0
        for i, w in enumerate(words):
            g = w.group()
            known = bool(self.words[g] & GIVEN_NAME)
            if i < done or not known and w.start() not in introduced:
                continue
            if not (lower or g[:1].isupper()) or not free(w.start(), w.end()):
                continue
            known = known and self._is_given(g)
            if not known:
                nxt = words[i + 1].group() if gap(i) == " " else ""
                if not (w.start() in introduced and len(g) > 1 and nxt[:1].isupper() and g.isupper() == nxt.isupper() and self._family(g, False) and self._family(nxt, False)):
                    continue
            j, dot = i, 0  # j: last word of the name so far
            if gap(j).startswith(" ") and len(words[j + 1].group()) == 1 and gap(j) == " " and t[words[j + 1].end() : words[j + 1].end() + 1] == ".":
                j, dot = j + 1, 1
            step = lambda j, dot: gap(j)[dot:] == " "
            end = None
            if step(j, dot):
                k, spaced = j + 1, True
                while spaced and (lower or not words[k].group()[:1].isupper()) and words[k].group().lower() in _PARTICLES and words[k].group() not in self.given:
                    spaced = gap(k) == " "
                    k += 1
                particles = k > j + 1
                if spaced and k < len(words) and (not particles or not lower and k - j <= 4) and free(words[k].start(), words[k].end()) and self._family(words[k].group(), lower):
                    if self._is_given(words[k].group()) and not particles and gap(k) == " " and self._family(words[k + 1].group(), lower) and not self._is_given(words[k + 1].group()) and g.isupper() == words[k + 1].group().isupper():
                        k += 1  # two given names
                    end = k
            if end is not None:
                take(w.start(), words[end].end(), "NAME")
                done = end + 1
                continue
            if known and i and t[words[i - 1].end() : w.start()] == ", " and free(words[i - 1].start(), words[i - 1].end()) and self._family(words[i - 1].group(), lower) and not self._is_given(words[i - 1].group()):
                take(words[i - 1].start(), words[j].end() + dot, "NAME")


def json_strings(value) -> Iterator[str]:
    """String values of a parsed record, in text order."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from json_strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from json_strings(v)


def _map_strings(value, to):
    if isinstance(value, str):
        return to(value)
    if isinstance(value, dict):
        return {k: _map_strings(v, to) for k, v in value.items()}
    if isinstance(value, list):
        return [_map_strings(v, to) for v in value]
    return value


def redact(text: str, items: list[tuple[int, int, str]]) -> str:
    """Source text with each item as ``[TYPE]``; the rest is unchanged."""
    out, last = [], 0
    for a, b, kind in items:
        out += [text[last:a], f"[{kind}]"]
        last = b
    return "".join(out) + text[last:]


_SEP = r"(?:\.|\s*[(\[{<]\s*dot\s*[)\]}>]\s*|\s+dot\s+)"
# Links, addresses (plain or disguised) and handles, whose parts aren't words of a text.
_NO_WORDS = (
    r"(?i)(?:https?://|www\.)\S+"
    rf"|(?<![\p{{L}}\d._%+-])[\p{{L}}\d_%+-]+(?:{_SEP}[\p{{L}}\d_%+-]+)*(?:\s*@\s*|\s*[(\[{{<]\s*at\s*[)\]}}>]\s*|\s+at\s+(?=[\p{{L}}\d-]+\s+dot\s))[\p{{L}}\d-]+(?:{_SEP}[\p{{L}}\d-]+)*"
    r"|@[\p{L}\d._-]+"
)
_MAY_HAVE_NO_WORDS = r"(?i)@|https?:|www\.|[(\[{<]\s*at\s*[)\]}>]|\sat\s+[\p{L}\d-]+\s+dot\s"  # saves time only
# A name in title case where only names stand, as 'Given Family' or 'Family, Given'.
_TITLED = r"\p{Lu}\p{Ll}+"
_FAMILY_TITLED = rf"{_TITLED}(?:['’-]{_TITLED})*"
_AS_FIELD = rf"^\s*(?i:{TITLES} )?({_TITLED} (?:\p{{Lu}}\. )?{_FAMILY_TITLED}|{_FAMILY_TITLED}, {_TITLED})(?: \p{{Lu}}\.)?\s*$"
_TWO_TITLED = rf"(?<![\p{{L}}\p{{M}}])({_TITLED} (?:\p{{Lu}}\. )?{_FAMILY_TITLED}|{_FAMILY_TITLED}, {_TITLED})(?!\p{{L}})"
_MAY_BE_TWO = r"\p{Lu}\p{Ll}+,? (?:\p{Lu}\. )?\p{Lu}\p{Ll}"  # saves time only: every name in title case holds it
_AFTER_INTRO = rf"(?:(?<!\p{{L}})(?i:{_INTRODUCED})[,:]?|(?<![^\s(,])(?i:{TITLES}))\s+({_TITLED} (?:\p{{Lu}}\. )?{_FAMILY_TITLED}|{_FAMILY_TITLED}, {_TITLED})(?!\p{{L}})"


@dataclass(frozen=True)
class NameWords:
    """``common``: words too common to be family names. ``given``: given names, known or learned."""

    common: frozenset[str] = frozenset()
    given: frozenset[str] = _GIVEN_SET


def json_values(df: DataFrame, record: str) -> DataFrame:
    """``text``: string values of several words in JSON records (copies of a value differ by its record)."""
    return df.select(F.explode(F.regexp_extract_all(record, F.lit(r':\s*"((?:[^"\\]|\\.)*+)"'), F.lit(1))).alias("text")).filter("text LIKE '% %'")


def _pair(name: Column) -> Column:
    """struct(w: given name, other: family name), both in lower case, of a name in one of the two orders."""
    turned = name.contains(",")
    first, last = F.substring_index(F.regexp_replace(name, ",", ""), " ", 1), F.substring_index(name, " ", -1)
    return F.struct(F.lower(F.when(turned, last).otherwise(first)).alias("w"), F.lower(F.when(turned, first).otherwise(last)).alias("other"))


def name_evidence(texts: DataFrame, text: str, fields: DataFrame | None = None, share: float = 0.002, least: int = 3, partners: int = 3, strong: float = 0.05, cap: int = 200_000, known: frozenset[str] = _GIVEN_SET) -> NameWords:
    """What the corpus tells about the words of names. ``fields``: one column of whole fields that name a
    person or a channel (authors).

    ``common``: words that begin sentences or stand in lower case in at least ``share`` of the different
    texts (and in ``least``, where that is more), except those that more texts have capitalised as the
    family name of a known or introduced given name. ``given``: ``known`` and the words that aren't common,
    stand first in names with ``partners`` different family names where only names stand (a whole field,
    after a title or an introduction), in at least ``strong`` of the different texts that have the word as
    the first of two in title case. Copies count once; links, addresses and handles aren't read. A word can be common only
    about words-per-text / share times, and what reaches the driver is checked (an error beyond ``cap``).
    """
    base = texts.select(F.col(text).alias("t"), F.lit(False).alias("field"))
    if fields is not None:
        base = base.unionByName(fields.select(F.col(fields.columns[0]).alias("t"), F.lit(True).alias("field")))
    base = base.filter("t IS NOT NULL AND t <> ''").distinct()
    base = base.select("field", F.when(F.col("t").rlike(_MAY_HAVE_NO_WORDS), F.regexp_replace("t", _NO_WORDS, " ~ ")).otherwise(F.col("t")).alias("t"))
    none = F.array().cast("array<string>")
    all_of = lambda pattern, where: F.when(where, F.regexp_extract_all("t", F.lit(pattern), F.lit(1))).otherwise(none)
    field, two = F.col("field"), F.col("t").rlike(_MAY_BE_TWO)
    low = all_of(r"(?<![\p{L}])(\p{Ll}[\p{L}]*)", ~field)
    first = F.transform(all_of(r"(?:^|[.!?\n]\s+|[-/\"—]\s+)(\p{L}[\p{L}]*)", ~field), F.lower)
    pairs = F.transform(F.concat(all_of(_AS_FIELD, field & two), all_of(_AFTER_INTRO, ~field & two)), _pair)
    twos = F.transform(all_of(_TWO_TITLED, two), _pair)
    after_known = F.filter(twos, lambda x: x["w"].isin(*sorted(known)) if known else F.lit(False))
    alone = F.lit(None).cast("string")
    other = lambda x: x["other"]
    tagged = [F.transform(F.array_distinct(ws), lambda w: F.struct(w.alias("w"), F.lit(k).alias("k"), alone.alias("other"))) for k, ws in (("l", low), ("f", first), ("n", F.concat(F.transform(after_known, other), F.transform(pairs, other))), ("c", F.transform(twos, lambda x: x["w"])))]
    tagged.append(F.transform(F.array_distinct(pairs), lambda x: F.struct(x["w"].alias("w"), F.lit("s").alias("k"), x["other"].alias("other"))))
    tagged.append(F.array(F.struct(F.lit("").alias("w"), F.when(field, "t").otherwise("l").alias("k"), alone.alias("other"))))  # the empty word counts the texts
    seen = base.select(F.explode(F.concat(*tagged)).alias("x")).groupBy("x.w", "x.k", "x.other").agg(F.count("*").alias("n"))
    sums = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(k) for k in "lfncs"]
    words = materialise(seen.groupBy("w").agg(*sums, F.count_if(F.col("k") == "s").alias("partners")), "words")
    n = words.filter("w = ''").agg(F.coalesce(F.sum("l"), F.lit(0))).first()[0]
    common = (F.greatest("l", "f") >= max(least, share * n)) & (F.col("n") <= F.greatest("l", "f"))
    given = ~common & (F.col("partners") >= partners) & (F.col("s") >= strong * F.col("c"))
    rows = words.select("w", common.alias("common"), given.alias("given")).filter("w <> '' AND (common OR given)").limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError("too many common words and given names")
    return NameWords(frozenset(_bare(r.w) for r in rows if r.common), known | frozenset(b for r in rows if r.given and (b := _bare(r.w)) not in _PLAIN_SET))


_FOUND = "k {kind}, field_name string, pii_type string, nth bigint, start bigint, `end` bigint"


def find_pii(df: DataFrame, key: str, columns: list[str], json_columns: tuple[str, ...] = (), words: NameWords = NameWords(), name_columns: tuple[str, ...] = ()) -> DataFrame:
    """key, field_name, pii_type, nth, start, end: items in each column, nth per type from 1.

    Offsets are in the column's text; for ``json_columns`` all string values are read in order and
    offsets are within the value (records that don't parse give none). ``name_columns`` hold the name of
    a person or a channel and nothing else. Null and empty texts give no row; whole texts are read,
    repeats once per batch.
    """
    kind = df.schema[key].dataType.simpleString()
    base = spread(df.select(F.col(key).alias("k"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]))
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        det = Detector(shared.value.common, shared.value.given)
        for pdf in batches:
            rows = []
            for i, c in enumerate(columns):
                codes, values = pd.factorize(pdf[f"c{i}"])
                found = []
                for v in values:
                    if c in json_columns:
                        try:
                            record = json.loads(v)
                        except (ValueError, RecursionError):
                            found.append([])
                            continue
                        items = [x for s in json_strings(record) for x in det.find_cached(s)]
                    else:
                        items = det.find_name_field(v) if c in name_columns else det.find(v)
                    seen: dict[str, int] = {}
                    out = []
                    for a, b, t in items:
                        seen[t] = seen.get(t, 0) + 1
                        out.append((c, t, seen[t], a, b))
                    found.append(out)
                keys = pdf["k"].tolist()
                rows += [(keys[r], *x) for r, code in enumerate(codes) if code >= 0 for x in found[code]]
            yield pd.DataFrame(rows, columns=["k", "field_name", "pii_type", "nth", "start", "end"])

    return base.mapInPandas(run, _FOUND.format(kind=kind)).withColumnRenamed("k", key)


def redact_pii(df: DataFrame, key: str, columns: list[str], json_columns: tuple[str, ...] = (), words: NameWords = NameWords(), name_columns: tuple[str, ...] = ()) -> DataFrame:
    """key and each column with its items as typed placeholders; JSON stays JSON. Nulls stay null and
    texts without items come out unchanged."""
    kinds = f"k {df.schema[key].dataType.simpleString()}, " + ", ".join(f"c{i} string" for i in range(len(columns)))
    base = spread(df.select(F.col(key).alias("k"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]))
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        det = Detector(shared.value.common, shared.value.given)

        def one(v: str, c: str) -> str:
            if c not in json_columns:
                return redact(v, det.find_name_field(v) if c in name_columns else det.find(v))
            try:
                record = json.loads(v)
            except (ValueError, RecursionError):
                return v
            hit = []

            def swap(s: str) -> str:
                items = det.find_cached(s)
                hit.extend(items)
                return redact(s, items)

            new = _map_strings(record, swap)
            return json.dumps(new, ensure_ascii=False) if hit else v

        for pdf in batches:
            out = {"k": pdf["k"]}
            for i, c in enumerate(columns):
                codes, values = pd.factorize(pdf[f"c{i}"])
                new = [one(v, c) for v in values] + [None]
                out[f"c{i}"] = pd.Series([new[x] for x in codes], dtype=object)
            yield pd.DataFrame(out)

    done = base.mapInPandas(run, kinds)
    return done.select(F.col("k").alias(key), *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
