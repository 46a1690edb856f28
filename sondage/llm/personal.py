"""Personal information inside free text: found, typed and replaced.

Anchor expansion. One Aho-Corasick automaton finds cues (at-signs in plain,
encoded and spoken form, schemes of documents, street and box words, given
names, words that introduce a person); groups of digits that could be a number
are the other anchors. From the position of each anchor a deterministic local
parser expands to the left and to the right up to the boundaries of the mention
and validates it (domain labels, check letters, numbering plans, accounts,
common words). Nothing is learned, no text is cut short, and each text is
handled on its own, so the work is spread evenly.

A person's name is a given name of the list with a family name next to it, or
two capitalised words that follow an introducing word or agree with an email
account of the same text, or an initial with a family name. Family names are
not listed: any word may be one that the vocabulary of a public tokenizer does
not hold as a common word (its lower-case form a token before its capitalised
form). List, cues and vocabulary are parameters (``Lexicon``).

Defined results: null and empty values hold no mention; a value of any length
is read whole; mentions do not overlap (email before address, identity, phone,
name); repeated deliveries (same ``uuid``) count once; an empty table gives an
empty result; extra columns are ignored; without the vocabulary file no word
counts as common but those of a short list. Positions count characters from 0.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widespread given names, by no means all: names outside are known by what stands around them.
GIVEN = (
    "aaron adam agnes ahmed aisha alan albert alex alexander alice alicia amara amina amir amy ana andrea andrew angela anita anja anna"
    " anouk anselm antonio arjun arthur ayumi barbara beatriz ben benjamin bjorn brian brigid bruno camille carla carlos carmen casper"
    " caspian catherine charlotte chiara chloe christian christine claire clara daniel david deepak diana diego dmitri dorota ed edward elena"
    " elisabeth élodie emeka emily emma eric eva farah fatima felix fernando francesca frank gabriel george giulia greta hana hannah hans"
    " hassan heidi helen henrik hugo ibrahim idris igor ilse ines ingrid isabel ivan jack james jan jane javier jennifer jessica joão joe"
    " john jonas josé joseph juan julia jürgen karen karl katarina kenji kevin klaus kofi lars laura layla leila leon liam linda linnea lisa"
    " luca lucia luis magnus marco maren maria marie mark marta martha martin mary mateo matthew max michael miguel mohamed nadia natalia nikolai"
    " nick nina noor olga oliver olivia oskar pablo paloma paolo patricia paul pavel pedro peter pierre priya rachel rahul ravi rebecca renata"
    " richard robert rosa ryan sam samuel sandra sarah selma sergei sofia søren stefan stellan susan sven teodor thomas tim tom tomas ursula viktor"
    " wei william yara yuki zofia zoë"
)
#: Words before a person's name.
INTRODUCING = (
    "by,from,author:,committer:,signed-off-by:,reviewed-by:,co-authored-by:,acked-by:,reported-by:,tested-by:,approved-by:,cc:,to:,from:,"
    "name:,owner:,owner=,author=,user:,contact:,contact,assignee:,assigned to,talked to,spoke with,spoke to,talk to,met with,session with,ask,ping,"
    "regards,regards\\,,cheers,cheers\\,,thanks,thanks\\,,sincerely,sincerely\\,,dear,hello,hi,hey,todo(,fixme(,mr,mr.,mrs,mrs.,ms,ms.,dr,dr.,prof.,herr,herrn,frau,señor,"
    "señora,madame,monsieur,mme,sr.,sra.,commit of,email of,patient,employee,client,applicant,von,an,dossier de,liebe,lieber,hallo,hola,bonjour,cher,chère"
)
#: Accounts that belong to no person.
SHARED = frozenset(
    "admin administrator agent alerts app apps api automation backup billing bot build builder ci ci-bot cicd contact daemon"
    " default deploy deployer dev devbox developer devops docker git github gitlab guest help helpdesk hello hostmaster"
    " info jenkins jobs mail mailer mailer-daemon maintainer maintainers news no-reply noreply nobody office operator ops postgres"
    " postmaster press public root runner sales security service shared staff student support svc sysadmin system team"
    " test tester ubuntu user vagrant vscode webmaster work worker www www-data node ec2-user codespace azureuser"
    " donotreply do-not-reply dependabot renovate release jovyan travis circleci gitpod codespaces coder bamboo teamcity".split()
)
#: Family names that are common words as well; they count next to a listed given name.
DOUBLE = frozenset("baker banks bell berry black brooks brown burns butler carter cook cooper fields fisher fox gray green hall hill hunter king knight lane long marsh mason miller moore page parker potter price rice rose shepherd stone swift taylor turner wagner walker ward waters west white wise wolf wood woods young".split())
#: Words of the trade that are in no general vocabulary, for accounts that are made of them.
TRADE = frozenset("admin agent api app azure bot build ci cd code dev docker git hub lab jenkins linux server test user vm web work box shared space pod runner svc sys ops".split())
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def plain(s: str) -> str:
    """Lower case without accents, for comparing names."""
    s = s.lower().replace("ø", "o").replace("ß", "ss").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[str, int]:
    """Rank of each whole word of a public vocabulary, with its case; empty where the file is not there."""
    if not os.path.exists(path):
        return {}
    with open(path, "rb") as f:
        pieces = ((base64.b64decode(a), int(b)) for a, b in map(bytes.split, f))
        return {p[1:].decode("utf-8", "ignore"): r for p, r in pieces if p[:1] == b" " and len(p) > 1}


@dataclass(frozen=True)
class Lexicon:
    given: tuple[str, ...] = tuple(GIVEN.split())
    introducing: tuple[str, ...] = tuple(x.replace("\\", "") for x in re.split(r"(?<!\\),", INTRODUCING))
    shared: frozenset[str] = SHARED
    vocabulary: str = VOCABULARY

    def given_forms(self) -> set[str]:
        forms = {*self.given, *(plain(g) for g in self.given)}
        return forms | {g.replace("ü", "ue").replace("ö", "oe").replace("ä", "ae").replace("ø", "oe") for g in self.given}

    def common(self, word: str) -> bool:
        """Whether the vocabulary holds the lower-case form before the capitalised one (a word, not a name)."""
        ranks = _ranks(self.vocabulary)
        low = word.lower()
        if not ranks:
            return low in TRADE
        a, b = ranks.get(low), ranks.get(low.capitalize())
        return (a is not None and (b is None or a <= b)) or low in TRADE

    def words_in(self, s: str) -> list[str] | None:
        """The common words that letters are made of, in a row, or None where they are not."""
        ways: list[list[str] | None] = [[]] + [None] * len(s)
        for i in range(len(s)):
            if ways[i] is not None:
                for j in range(i + 2, len(s) + 1):
                    if ways[j] is None and (s[i:j] in TRADE or (j - i > 3 and self.common(s[i:j]))):
                        ways[j] = [*ways[i], s[i:j]]
        return ways[-1]


# --- local parsers -----------------------------------------------------------------------------------------------

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|punkt|punto|point)\s?[\])}]\s?|\s(?:dot|DOT)\s)"
_AT = re.compile(r"@|＠|%40|&#64;|&commat;|\\u0040|\s?[\[({<]\s?(?:at|AT|@|arobase|arroba)\s?[\])}>]\s?|\s(?:at|AT)\s(?=[A-Za-z0-9-]+\s(?:dot|DOT)\s)")
_DOMAIN = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+")
_DOTS = re.compile(_DOT)
_ACCOUNT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+-")
_REMOTE = re.compile(r":[\w./~-]+\.git\b")
AT_CUES = ("@", "＠", "%40", "&#64;", "&commat;", "\\u0040", "[at", "(at", "{at", "<at", "[ at", "( at", "{ at", "< at", "[arob", "(arob", "{arob", "<arob", "[arro", "(arro", "{arro", "<arro", " at ")

_CAP = r"[A-ZÀ-Þ]\w*(?:['’-]\w+)*"
_TOWN = rf"{_CAP}(?: (?:am|an der|im|sur|de la|del|de|la|el)(?= [A-ZÀ-Þ]))?(?: {_CAP}){{0,3}}"
_TAIL = rf"(?:,? *(?:\d{{4,5}} {_TOWN}|{_TOWN}(?:,? [A-Z]{{2}})? \d{{4,5}}\b)|, {_TOWN})?"
_UNIT = r"(?:(?:Apt|Apartment|Flat|Unit|Suite|Ste|Room|Wohnung|Whg|Piso|Appt|Appartement)\.? ?#?\w{1,5},? +)?"
_EN = (
    "Street St Road Rd Avenue Ave Lane Ln Drive Dr Court Ct Row Way Boulevard Blvd Place Pl Square Sq Terrace Close Crescent Highway"
    " Hwy Parkway Pkwy Trail Walk Mews Gardens Hill Grove"
).split()
_FR = "rue avenue boulevard place chemin impasse allée quai cours route square passage".split()
_ES = "Calle C/ Avenida Avda Plaza Paseo Camino Via Rua Carrer".split()
_DE = "straße strasse str. weg gasse allee platz ring damm ufer steig pfad markt".split()
_BOX = "Box|Postfach|Apartado(?: de Correos)?|Casilla|Boîte postale"
_PREP = r"(?:(?:de la|de l['’]|des|du|de|d['’]|del|de los|de las) ?)?"
ADDRESS = re.compile(
    rf"(?<![\w.-]){_UNIT}(?:"
    rf"(?:(?:[Pp]\.? ?[Oo]\.? ?)Box|{_BOX[4:]}) \d{{1,6}}\b"
    rf"|\d{{1,5}}[A-Za-z]?,? (?:[NSEW]\.? )?(?:{_CAP} ){{1,3}}(?:{'|'.join(_EN)})\.?(?![\w-])"
    rf"|\d{{1,4}}(?: ?(?:bis|ter|[a-d])\b)?,? (?:{'|'.join(_FR)}) {_PREP}{_CAP}(?:(?:[ -](?:de|du|des|la|le))?[ -]{_CAP})*"
    rf"|(?:{'|'.join(_ES)})\.? {_PREP}{_CAP}(?: {_CAP})*,? (?:n[.º°]+ ?)?\d{{1,4}} ?[a-zA-Z]?(?![\w-])"
    rf"|(?:[A-ZÄÖÜ][\wäöüß-]*(?:{'|'.join(_DE).replace('.', '[.]')})"
    rf"|[A-ZÄÖÜ][\wäöüß-]* (?:Straße|Strasse|Str\.|Weg|Gasse|Allee|Platz|Ring)) \d{{1,4}} ?[a-z]?(?![\w/-])"
    rf"){_TAIL}"
)
#: What an address is written in: no mention reaches beyond a run of these.
_WRITTEN = re.compile(r"[\w ,.'’#°º/-]+")
ADDRESS_CUES = (
    {f" {x.lower()}{e}" for x in _EN for e in (" ", ".", ",")} | {f" {x.lower()}" for x in _EN}
    | {f" {x} " for x in _FR} | {f"{x.lower()}{e}" for x in _ES for e in (" ", ". ")} | {f"{x} " for x in _DE}
    | {" box ", "postfach ", "apartado ", "casilla ", "postale "}
)

_E = r"(?<![\w.+/:-])"  # nothing before that would make it part of something longer
_X = r"(?![\w-]|\.\d|/\d)"
PHONE = re.compile(
    r"(?<![\w+])(?:\+1|001)[ .-]?(?:\([2-9]\d\d\)|[2-9]\d\d)[ .-]?\d{3}[ .-]?\d{4}(?!\w)|"  # as long as its plan says
    r"(?<![\w+])(?:\+\d{1,3}|00[1-9]\d{0,2})(?:[ .-]?\(\d{1,5}\)|[ .-]\d{1,5}|(?=\d))(?:[ .-]?\d{2,}+){1,5}(?![\w])"
    r"|(?<![\w.+/-])\+\d(?:[ .-]?\d){7,14}(?!\w)"
    rf"|(?<![\w.+:-])\([2-9]\d\d\)[ .-]?\d{{3}}[ .-]\d{{4}}{_X}"
    rf"|{_E}(?:1[ .-])?[2-9]\d\d([.-])\d{{3}}\1\d{{4}}{_X}"
    rf"|{_E}[2-9]\d\d \d{{3}} \d{{4}}{_X}"
    rf"|{_E}0\d{{2,4}}[/-] ?\d{{5,9}}{_X}"
    rf"|{_E}0\d{{4}} \d{{6}}{_X}|{_E}0\d{{3}} \d{{3}} \d{{4}}{_X}"
    rf"|{_E}0[1-9](?:([ .])\d\d)(?:\2\d\d){{3}}{_X}"
    rf"|{_E}0\d{{2,4}} \d{{4,6}} ?\d{{0,4}}{_X}"
)
IDENTITY = re.compile(
    rf"(?P<ssn>{_E}\d{{3}}([- ])\d\d\2\d{{4}}{_X})"
    rf"|(?P<cpf>{_E}\d{{3}}\.\d{{3}}\.\d{{3}}-\d\d{_X})"
    rf"|(?P<nir>{_E}[12] ?\d\d ?(?:0[1-9]|1[0-2]|[2-9]\d) ?(?:\d\d|2[AB]) ?\d{{3}} ?\d{{3}} ?\d\d{_X})"
    rf"|(?P<nino>{_E}[A-CEGHJ-PQR-TW-Z][A-CEGHJ-NPQR-TW-Z] ?\d\d ?\d\d ?\d\d ?[A-D]{_X})"
    rf"|(?P<dni>{_E}[XYZ\d]\d{{7}}-?[A-Z]{_X})"
    rf"|(?P<pass>(?<![\w.+/:-])P<[A-Z]{{0,3}}[A-Z]\d{{6,9}}(?!\w))"
)
#: Digits enough for a number, as written: with what may stand between them. Numbers begin where such a group does.
_GROUP = re.compile(r"\d(?:[ .()/-]{0,3}\d){5,}")
_START = re.compile(r"\d+")
_CHECK = "TRWAGMYFPDXBNJZSQVHLCKE"


def _valid_identity(m: re.Match) -> bool:
    s = m.group()
    if m.lastgroup == "dni":
        s = s.replace("-", "")
        return _CHECK[int(s[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == s[-1]
    if m.lastgroup == "ssn":
        return s[:3] not in ("000", "666") and s[4:6] != "00"
    if m.lastgroup == "cpf":
        d = [int(c) for c in s if c.isdigit()]
        check = lambda n: sum(x * (n + 1 - i) for i, x in enumerate(d[:n])) * 10 % 11 % 10
        return check(9) == d[9] and check(10) == d[10]
    return True


class Taken:
    """Spans that do not overlap, kept in order; what comes first stays."""

    def __init__(self):
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, str]] = []

    def free(self, s: int, e: int) -> bool:
        i = bisect_left(self.starts, e)
        return i == 0 or self.spans[i - 1][1] <= s

    def take(self, s: int, e: int, kind: str) -> None:
        if self.free(s, e):
            i = bisect_left(self.starts, s)
            self.starts.insert(i, s)
            self.spans.insert(i, (s, e, kind))


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*(?:-[^\W\d_]+(?:['’][^\W\d_]+)*)?(?![\w@])")
_GAP = re.compile(r"[  \t]+")
_INITIALS = re.compile(r"(?:[  \t]+[A-ZÀ-Þ]\.(?=[  \t]))*")
_INITIAL_FAMILY = re.compile(r"[A-ZÀ-Þ]\.[  \t]?(?:[A-ZÀ-Þ]\.[  \t]?)*")
_GOES_ON = re.compile(r"[  \t]+\w")
_BEFORE = frozenset("@/\\.%+-_")


class Finder:
    def __init__(self, lexicon: Lexicon | None = None):
        self.lex = lex = lexicon or Lexicon()
        self.given = frozenset(plain(g) for g in lex.given_forms())
        self.login_given = sorted((g for g in self.given if len(g) > 2), key=len, reverse=True)
        self._common: dict[str, bool] = {}
        cues: dict[str, set[str]] = {}
        for kind, words in (("email", AT_CUES), ("address", ADDRESS_CUES), ("given", lex.given_forms()), ("intro", {x if x[-1] in "(=" else f"{x} " for x in lex.introducing} | {f"{x}\n" for x in lex.introducing if x[-1] == "," or x.endswith("ards")}), ("initial", (". ",)), ("scheme", ("p<",))):
            for w in words:
                cues.setdefault(w, set()).add(kind)
        self.cues = ahocorasick.Automaton()
        for w, kinds in cues.items():
            self.cues.add_word(w, (len(w), tuple(sorted(kinds))))
        self.cues.make_automaton()

    def common(self, word: str) -> bool:
        known = self._common.get(word)
        if known is None:
            if len(self._common) > 100_000:
                self._common.clear()
            known = self._common[word] = self.lex.common(word)
        return known

    # --- expansion from anchors

    def anchors(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """The (start, end) of each cue, by kind."""
        low = text.lower()
        if len(low) != len(text):  # some letters get longer
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        out: dict[str, list[tuple[int, int]]] = {}
        for end, (n, kinds) in self.cues.iter(low):
            for k in kinds:
                out.setdefault(k, []).append((end + 1 - n, end + 1))
        return out

    def email(self, text: str, at: int) -> tuple[int, int, bool] | None:
        """From an at-sign to the account on its left and the domain on its right; whether it is a person's."""
        m = _AT.match(text, at)
        if m is None and at and text[at - 1].isspace():
            m = _AT.match(text, at - 1)
        elif m is not None and at and text[at] in "[({<" and text[at - 1].isspace():
            m = _AT.match(text, at - 1) or m
        if m is None:
            return None
        left = m.start()
        while left and text[left - 1] in _ACCOUNT:
            left -= 1
        if left and text[left - 1] == "%":
            return None
        local = text[left : m.start()]
        right = _DOMAIN.match(text, m.end())
        if right is None or not local or not (local[0].isalnum() and local[-1].isalnum()):
            return None
        domain = right.group()
        last = _DOTS.split(domain)[-1]
        ok = last.isalpha() and len(last) >= 2 and plain(local) not in self.lex.shared and text[max(0, left - 3) : left] != "://"
        if ok and text[right.end() : right.end() + 1] == ":" and _REMOTE.match(text, right.end()):
            ok = False
        return left, right.end(), ok

    def _family(self, text: str, at: int, like: str, strict: bool = True) -> int | None:
        """The end of a family name that begins at a position, written like the given name ``like``."""
        m = _WORD.match(text, at)
        if m is None:
            return None
        w = m.group()
        if like.islower() != w.islower() or not (w.islower() or w[0].isupper()) or len(w) < 2:
            return None
        if w.islower() and len(w) < 4:
            return None
        parts = w.split("-")
        if any(self.common(p) and (strict or p.lower() not in DOUBLE) for p in parts):
            return None
        if w.islower() and any(self.lex.words_in(p) for p in parts) and _GOES_ON.match(text, m.end()):
            return None
        return m.end()

    def name_from_given(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """From a listed given name to the family name on its right, or on its left."""
        if (start and (text[start - 1].isalnum() or text[start - 1] in _BEFORE)) or (end < len(text) and (text[end].isalnum() or text[end] == "_")):
            return None
        like = text[start:end]
        if not (like.islower() or like[0].isupper()):
            return None
        at = _INITIALS.match(text, end).end()
        gap = _GAP.match(text, at)
        if gap and (stop := self._family(text, gap.end(), like, strict=False)) is not None:
            word = text[gap.end() : stop]
            if plain(word) in self.given:  # a second given name before the family name
                again = _GAP.match(text, stop)
                further = self._family(text, again.end(), like) if again else None
                stop = further or stop
            return start, stop
        # the family name first, with or without a comma
        left = start
        while left and text[left - 1] in "  \t":
            left -= 1
        if left == start or left == 0:
            return None
        comma = text[left - 1] == ","
        stop = left - comma
        begin = stop
        while begin and (text[begin - 1].isalpha() or text[begin - 1] in "-'’"):
            begin -= 1
        while begin < stop and not text[begin].isalpha():
            begin += 1
        if begin and (text[begin - 1].isalnum() or text[begin - 1] in _BEFORE):
            return None
        if begin < stop and self._family(text, begin, like) == stop and len(text[begin:stop]) > 2 and self._unknown(text[begin:stop]):
            return begin, _INITIALS_END.match(text, end).end()
        return None

    def _unknown(self, word: str) -> bool:
        return not any(self.common(p) for p in re.split(r"[-'’]", word))

    def name_from_cue(self, text: str, at: int) -> tuple[int, int] | None:
        """Two capitalised words or an initial and one, none of them common, after a word that introduces a person."""
        at += len(text[at : at + 1]) if text[at : at + 1] in "'\"(" else 0
        m = _WORD.match(text, at)
        if m is None or not m.group()[0].isupper() or not self._unknown(m.group()) or len(m.group()) < 2:
            return None
        first = m.group()
        if text[m.end() : m.end() + 2] == ", ":
            stop = self._family(text, m.end() + 2, first)
            return (at, stop) if stop and plain(text[m.end() + 2 : stop]) in self.given else None
        gap = _GAP.match(text, _INITIALS.match(text, m.end()).end())
        if gap is None:
            return None
        stop = self._family(text, gap.end(), first)
        if stop is None or (first.isupper() and not text[gap.end() : stop].isupper()):
            return None
        return at, stop

    def name_from_initial(self, text: str, dot: int) -> tuple[int, int] | None:
        """From the point after an initial to the family name on its right, or on its left before a comma."""
        if dot < 1 or not text[dot - 1].isupper():
            return None
        start = dot - 1
        while start >= 3 and text[start - 1] in "  \t" and text[start - 2] == "." and text[start - 3].isupper():
            start -= 3
        if start and (text[start - 1].isalnum() or text[start - 1] in _BEFORE):
            return None
        m = _INITIAL_FAMILY.match(text, start)
        w = _WORD.match(text, m.end()) if m else None
        if w is None or len(w.group()) < 3 or not w.group()[0].isupper() or not self._unknown(w.group()) or (w.group().isupper() and len(w.group()) < 5):
            return None
        return start, w.end()

    def mentions(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of each mention, in order."""
        if not text:
            return []
        back = None
        if "\\" in text:
            text, back = _unescape(text)
        anchors = self.anchors(text)
        groups = [m.span() for m in _GROUP.finditer(text)]
        if not anchors and not groups:
            return []
        taken, accounts, skip = Taken(), [], []
        seen = -1
        for s, _ in anchors.get("email", ()):
            if s >= seen and (found := self.email(text, s)):
                a, z, personal = found
                if personal:
                    taken.take(a, z, "email")
                    accounts.append(text[a:s])
                else:
                    skip.append((a, z))
                seen = z
        seen = -1
        for s, _ in anchors.get("address", ()):
            if s < seen:
                continue
            a = s
            while a > max(seen, 0) and (text[a - 1].isalnum() or text[a - 1] in "_ ,.'’#°º/-"):
                a -= 1
            run = _WRITTEN.match(text, a)
            seen = run.end() if run else s + 1
            if run and any(c.isdigit() for c in run.group()):
                for m in ADDRESS.finditer(text, a, seen):
                    taken.take(*m.span(), "address")
        starts = self._number_starts(text, groups, anchors.get("scheme", ()))
        for i in starts:
            if (m := IDENTITY.match(text, i)) and _valid_identity(m):
                taken.take(*m.span(), "identity")
        for i in starts:
            if (m := PHONE.match(text, i)) and 7 <= sum(c.isdigit() for c in m.group()) <= 17:
                taken.take(*m.span(), "phone")
        self._names(text, anchors, accounts, skip, taken)
        spans = taken.spans
        if back is not None:
            spans = [(back(s), back(e), k) for s, e, k in spans]
        return sorted(spans)

    @staticmethod
    def _number_starts(text: str, groups: list[tuple[int, int]], schemes) -> list[int]:
        """Where a number may begin: at each digit group of an anchor, and at the sign, bracket or letters before it."""
        out = set()
        for lo, hi in groups:
            for m in _START.finditer(text, lo, hi):
                s = m.start()
                out.add(s)
                for n in (1, 2, 3):
                    if s >= n and (text[s - n] in "+(" or (text[s - n].isupper() and n < 4)):
                        out.add(s - n)
        out.update(s for s, _ in schemes)
        return sorted(out)

    def _names(self, text: str, anchors: dict, accounts: list[str], skip: list[tuple[int, int]], taken: Taken) -> None:
        found: list[tuple[int, int]] = []
        for s, e in anchors.get("given", ()):
            if hit := self.name_from_given(text, s, e):
                found.append(hit)
        for s, e in anchors.get("intro", ()):
            if s and text[s - 1].isalnum():
                continue
            if hit := self.name_from_cue(text, e):
                found.append(hit)
        for s, _ in anchors.get("initial", ()):
            if hit := self.name_from_initial(text, s):
                found.append(hit)
        for account in accounts:
            parts = [p for p in re.split(r"[._+-]", re.sub(r"\d+$", "", account)) if len(p) > 2 and p.isalpha()]
            if len(parts) == 2 and not any(self.common(p) for p in parts):
                a, b = map(re.escape, parts)
                found += [m.span() for m in re.finditer(rf"(?<![\w@/\\.%+-])(?:{a}[ \t]+{b}|{b},[ \t]+{a})(?![\w@])", text, re.I)]
        # the longest from each place, from left to right
        for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
            if not any(a < e and s < z for a, z in skip):
                taken.take(s, e, "name")

    def login(self, cwd: str | None) -> tuple[int, int, str] | None:
        """The login of a home directory, where it is formed from a person's name: a given name or an initial with what is no word."""
        m = HOME.match(cwd or "")
        if not m or plain(m.group(1)) in self.lex.shared:
            return None
        parts = [p for p in re.split(r"[^a-z]+", plain(m.group(1))) if p]
        if not parts or any(p in self.lex.shared for p in parts):
            return None
        named = any(p in self.given for p in parts)
        if not named and len(parts) == 1:
            p = parts[0]
            rest = [p[len(g) :] for g in self.login_given if p.startswith(g) and len(p) > len(g) + 1]
            if rest:  # a given name, and a rest that is no word of its own
                named = any(len(r) > 2 and not self.common(r) and not all(x in TRADE for x in self.lex.words_in(r) or "-") for r in rest)
            else:  # an initial with a family name, or one alone
                named = len(p) > 3 and not self.common(p) and not self.lex.words_in(p)
        elif not named:
            named = all(not self.common(p) and not self.lex.words_in(p) for p in parts if len(p) > 1) and max(map(len, parts)) > 3
        return (m.start(1), m.end(1), "name") if named else None


_INITIALS_END = re.compile(r"(?:[  \t]+[A-ZÀ-Þ]\.)*")
HOME = re.compile(r"(?:file://)?(?:/(?:home|Users|export/home|usr/home|var/home)/|(?:/mnt/[a-z]|/[a-z]|[A-Za-z]:)[\\/](?:Users|Documents and Settings|home)[\\/])([^/\\]+)", re.I)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|([nrtbf\"/\\]))")


def _unescape(text: str):
    """Text whose JSON escapes are read, and the way back to positions in the text as stored."""
    if _ESCAPE.search(text) is None:
        return text, None
    out: list[str] = []
    at: list[int] = []  # positions in the result where the shift changes
    shift: list[int] = []
    n = last = 0
    for m in _ESCAPE.finditer(text):
        out.append(text[last : m.start()])
        n += m.start() - last
        # an escaped line end keeps its two characters, so only \u shifts
        new = chr(int(m.group(1), 16)) if m.group(1) else ("\n\n" if m.group(2) in "nr" else "\t\t" if m.group(2) == "t" else "  " if m.group(2) in 'bf"' else m.group(0))
        if m.group(2) == "\\":
            new = "\\\\"
        out.append(new)
        n += len(new)
        last = m.end()
        at.append(n)
        shift.append(last - n)
    out.append(text[last:])
    result = "".join(out)
    if len(result) == len(text):
        return result, None

    def back(i: int) -> int:
        k = bisect_right(at, i) - 1
        return i + (shift[k] if k >= 0 else 0)

    return result, back


@lru_cache(maxsize=4)
def _finder(lexicon: Lexicon) -> Finder:
    return Finder(lexicon)


# --- over tables -------------------------------------------------------------------------------------------------

FIELDS = ("text", "content")
_FOUND = "uuid string, block_no bigint, field_name string, kind string, start_pos bigint, end_pos bigint"


def _scan(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(lexicon)
        logins: dict[str, tuple | None] = {}
        for batch in batches:
            uuid = batch.column(0)
            rows: list[tuple] = []  # (record, block, field, kind, start, end)
            for f, column in zip(FIELDS, batch.columns[2:]):
                sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
                record = np.repeat(np.arange(len(column)), sizes)
                start = np.cumsum(sizes) - sizes
                flat = column.flatten()
                # null lists have no entry in flatten(); their offsets may still span some
                if len(flat) != len(record):
                    sizes = np.array([0 if v is None else len(v) for v in column.to_pylist()])
                    record = np.repeat(np.arange(len(column)), sizes)
                    start = np.cumsum(sizes) - sizes
                for i, t in enumerate(flat.to_pylist()):
                    if t and (found := finder.mentions(t)):
                        r = int(record[i])
                        rows += [(r, i - int(start[r]), f, k, s, e) for s, e, k in found]
            for r, cwd in enumerate(batch.column(1).to_pylist()):
                if cwd is not None:
                    if cwd not in logins:
                        if len(logins) > 50_000:
                            logins.clear()
                        logins[cwd] = finder.login(cwd)
                    if hit := logins[cwd]:
                        rows.append((r, -1, "cwd", hit[2], hit[0], hit[1]))
            if rows:
                rec, *rest = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [uuid.take(pa.array(rec)).cast(pa.string()), pa.array(rest[0], pa.int64()), pa.array(rest[1]), pa.array(rest[2]), pa.array(rest[3], pa.int64()), pa.array(rest[4], pa.int64())],
                    names=["uuid", "block_no", "field_name", "kind", "start_pos", "end_pos"],
                )

    return run


def find_personal(messages: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """One row per mention: uuid, block_no, field_name, kind, start_pos, end_pos."""
    narrow = messages.select("uuid", "cwd", *(F.col(f"message.content.{f}").alias(f) for f in FIELDS))
    found = narrow.mapInArrow(_scan(lexicon), _FOUND)
    return found.dropDuplicates(["uuid", "block_no", "field_name", "kind", "start_pos"])


def redact(messages: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Every message with each mention replaced by its type in brackets; all other text is unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(lexicon)

        def clean(t: str | None) -> str | None:
            for s, e, k in reversed(finder.mentions(t)):
                t = f"{t[:s]}[{k.upper()}]{t[e:]}"
            return t

        def home(t: str | None) -> str | None:
            hit = finder.login(t)
            return f"{t[: hit[0]]}[NAME]{t[hit[1] :]}" if hit else t

        for batch in batches:
            cols = {"uuid": batch.column(0), "cwd": pa.array([home(t) for t in batch.column(1).to_pylist()], pa.string())}
            for f, c in zip(FIELDS, batch.columns[2:]):
                cols[f] = pa.array([None if v is None else [clean(t) for t in v] for v in c.to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(cols)

    narrow = messages.select("uuid", "cwd", *(F.col(f"message.content.{f}").alias(f) for f in FIELDS))
    return narrow.mapInArrow(run, "uuid string, cwd string, text array<string>, content array<string>")
