"""Names of organisations and people: their parts, phonetic codes and comparison.

Which words of a name say what is done and not who does it (foods, roofing) is learned from the names themselves: a word held by a
set share of all distinct names and met beside many different words is generic. Short forms of generic words are recognised by rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import regex

from rowkin.llm.addresses import heard, squeeze
from rowkin.llm.locations import edits
from rowkin.llm.plain_text import fold
from rowkin.llm.scripts import romanise

# Usual first names and their short forms, in English, Spanish, French, German and Indian use.
NICKNAMES = """
abigail: abby; albert: al bert bertie; alejandro: ale alex jandro alexander; alfred: alf fred; andrew: andy drew; anthony: tony antoine toine antonio; barbara: barb babs; benjamin: ben benny; bernard: bernie; catherine: kate cathy kathy katie katherine cat kitty;
charles: charlie chuck chas carlos; christina: chris tina christine; christopher: kit topher; daniel: dan danny; david: dave davey; deborah: deb debbie; donald: don donnie; dorothy: dot dottie; edward: ed eddie ned eduard eduardo; eleanor: ellie nell nora;
elizabeth: liz beth betty eliza lizzie lisa; emanuel: manny manuel manolo; eugene: gene; florence: flo; francis: frank frankie; francisco: fco paco pancho fran; frederick: fred freddy freddie frederic; gabriel: gabe; gerald: gerry; gregory: greg; guadalupe: lupe; harold: hal harry; heinrich: heinz; helen: nelly;
henry: hank; isabella: bella isabel; jacob: jake; james: jim jimmy jamie; jean: jeannot; jennifer: jen jenny; jessica: jess jessie; jesus: chus; john: jack johnny jon; jonathan: jonny; joseph: jos joe joey jo jose josef sepp; joshua: josh; judith: judy; katharina: kathi; kenneth: ken kenny;
krishnan: kris krish krishna; lakshmi: laxmi lakshmy lakshmee; lawrence: larry; leonard: len lenny leo; louis: lou luis; manfred: manni; margaret: peggy maggie meg marge; maria: mari; martin: marty; matthew: matt; maximilian: max; michael: mike mick mickey miguel; muhammad: md mohd mohammed mohammad muhamad mohamed;
nathaniel: nat nate nathan; nicholas: nick nicky nicolas; pamela: pam; patricia: pat trish patty tricia; patrick: paddy; peter: pete pedro; philip: phil; rajesh: raj raju; ramachandran: ram; raymond: ray; rebecca: becky; richard: rick richie rich dick ricky ricardo; robert: rob bob bobby robbie roberto; ronald: ron ronnie; rosario: charo;
samuel: sam sammy; sebastian: seb basti; sophia: sophie; srinivasan: srini; stephen: steve steven; subramanian: subbu mani; susan: sue suzie susie suzy susanna; theodore: theo ted teddy; thomas: tom tommy tomas; timothy: tim; venkatesh: venkat venky; victoria: vicky; vincent: vince; vijayalakshmi: viji; walter: walt; wilhelm: willi; william: will bill billy willie guillermo; zachary: zach
"""
# Legal forms and words in front of or behind a name that do not belong to it.
LEGAL = frozenset("llc ltd limited inc incorporated corp corporation co company pvt private llp lp plc sarl sas sasu eurl gmbh ag kg ug ohg sa sl slu sc srl p pra li".split())
NOISE = frozenset("the ms and sri shri smt maison ets firma casa etablissements wwww www com test example".split())
_BEHIND = regex.compile(r"^.*?\bholdings?\b[^\p{L}]*(?:dba|d b a|d/b/a|trading as|t/a|t a|aka|doing business as)\b")
_AROUND = regex.compile(r"\bwww\.|\.(?:com|test|example|net|org|in|fr|de|es)\b|\bm/s\b")
_WORDS = regex.compile(r"[\p{L}\p{M}‌‍]+|\d+")
_PLAIN_WORDS = re.compile(r"[a-z]+|[0-9]+")
_DOTTED = regex.compile(r"\b(?:\p{L}\.){2,}")


def _short_forms(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for part in text.replace("\n", " ").split(";"):
        name, _, forms = part.partition(":")
        for form in (name.strip(), *forms.split()):
            if form:
                out[form] = f"{out[form]}|{name.strip()}" if form in out else name.strip()
    return out


#: Names by their forms; a form of several names stands for any of them, joined by "|".
GIVEN = _short_forms(NICKNAMES)
_INITIALS: dict[str, set[str]] = {}
for _form, _names in GIVEN.items():
    for _name in _names.split("|"):
        _INITIALS.setdefault(_name, set()).add(_form[0])


class Name(NamedTuple):
    """Parts of a name; ``words`` are what is the name's own, in their order, as heard; ``trades`` the generic words its other words may stand for."""

    given: str
    words: tuple[str, ...]
    trades: frozenset[str]
    foreign: bool


def name_tokens(name: str) -> list[str]:
    """The folded words of a name in any script, without legal forms and words around a name (all words, if nothing else is left)."""
    text = fold(name)
    if "holding" in text:
        text = _BEHIND.sub(" ", text)
    if "." in text or "/" in text:
        text = _DOTTED.sub(lambda m: m.group().replace(".", ""), text)
        text = _AROUND.sub(" ", text)
    tokens = (_PLAIN_WORDS if text.isascii() else _WORDS).findall(text)
    return [t for t in tokens if t not in LEGAL and t not in NOISE] or tokens


class NameReader:
    """Reads names with a set of generic words and of frequent words, of which those that shorten a generic word are its short forms."""

    def __init__(self, generic: Iterable[str], frequent: Iterable[str] = ()):
        self.generic = frozenset(w for w in generic if w not in GIVEN and w.isascii())
        words = sorted(self.generic)
        #: generic words by their first letter, by their code, and by their spellings with a letter left out
        self.by_first: dict[str, list[str]] = {}
        self.by_code: dict[str, set[str]] = {}
        self.short: dict[str, set[str]] = {}
        for w in words:
            self.by_first.setdefault(w[0], []).append(w)
            c = _plain_code(w)
            for key in {c, *(c[:i] + c[i + 1 :] for i in range(len(c)) if len(c) >= 6)}:
                self.by_code.setdefault(key, set()).add(w)
            for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                self.short.setdefault(key, set()).add(w)
        self.forms: dict[str, frozenset[str]] = {}
        for w in frequent:
            if w not in self.generic and w not in GIVEN and w.isascii() and (found := frozenset(g for g in self.by_first.get(w[0], ()) if len(w) < len(g) and _shortens(w, g))):
                self.forms[w] = found
        #: words that may end or begin a word, the longest first, by their last three and first four letters
        self.ends: dict[str, list[str]] = {}
        self.starts: dict[str, list[str]] = {}
        for w in sorted((w for w in (*words, *self.forms) if len(w) >= 3), key=lambda w: (-len(w), w)):
            self.ends.setdefault(w[-3:], []).append(w)
        for w in sorted({w for w in (*words, *GIVEN) if w.isascii() and len(w) >= 4}, key=lambda w: (-len(w), w)):
            self.starts.setdefault(w[:4], []).append(w)
        self._trades: dict[str, frozenset[str]] = {}
        self._names: dict[str, Name] = {}

    def trades_of(self, word: str) -> frozenset[str]:
        """The generic words a word may stand for: itself, one typing error away, the same stem with another ending, or a short form of it."""
        known = self._trades.get(word)
        if known is None:
            known = self._trades[word] = self._find(word)
            if len(self._trades) > 1 << 16:
                self._trades = {}
        return known

    def _find(self, word: str) -> frozenset[str]:
        if word in self.generic:
            # frequent short forms are generic themselves; the same word with other endings counts as the same trade
            return frozenset({word} | {w for w in self.by_first[word[0]] if w != word and (_one_stem(w, word) or len(word) < len(w) and _shortens(word, w))})
        if word in self.forms:
            return self.forms[word]
        if len(word) < 5 or not word.isascii():
            return frozenset()
        out: set[str] = set()
        if len(word) >= 6:
            near = set(self.short.get(word, ()))
            for i in range(len(word)):
                near |= self.short.get(word[:i] + word[i + 1 :], set())
            out |= {t for t in near if edits(t, word, 1) <= 1}
        for w in self.by_first.get(word[0], ()):
            if _one_stem(w, word):
                out.add(w)
        return frozenset(out)

    def by_sound(self, latin: str) -> frozenset[str]:
        """The generic words that a word written in another script may stand for: those with its code, or of long codes one sound away."""
        c = _plain_code(latin)
        out = set(self.by_code.get(c, ()))
        if len(c) >= 6:
            for i in range(len(c)):
                out |= self.by_code.get(c[:i] + c[i + 1 :], set())
        return frozenset(w for w in out if len(w) >= 4 and edits(_plain_code(w), c, 1) <= 1)

    def _unglue(self, word: str) -> tuple[set[str], str, str]:
        """(trades, given name, rest) of words written as one: known words are taken off its ends."""
        trades: set[str] = set()
        given = ""
        again = True
        while again and len(word) >= 9:
            again = False
            for end in self.ends.get(word[-3:], ()):
                if word.endswith(end) and len(word) - len(end) >= 6 and (len(end) >= 4 or not trades):
                    trades |= self.trades_of(end)
                    word = word[: -len(end)]
                    again = True
                    break
            if again:
                continue
            for start in self.starts.get(word[:4], ()):
                if word.startswith(start) and len(word) - len(start) >= 6:
                    if start in self.generic:
                        if len(start) < 5:
                            continue
                        trades |= self.trades_of(start)
                    elif given:
                        continue
                    else:
                        given = GIVEN[start]
                    word = word[len(start) :]
                    again = True
                    break
        return trades, given, word

    def read(self, name: str) -> Name:
        """The parts of a name in any script."""
        known = self._names.get(name)
        if known is None:
            if len(self._names) > 1 << 16:
                self._names = {}
            known = self._names[name] = self.read_tokens(name_tokens(name))
        return known

    def read_tokens(self, tokens: list[str]) -> Name:
        """The parts of a name given as ``name_tokens``. A name of generic words alone keeps them as its own words."""
        given = initial = ""
        words: list[str] = []
        kept: list[str] = []
        strange: list[str] = []
        trades: set[str] = set()
        foreign = False
        skip = False
        for k, t in enumerate(tokens):
            if skip:
                skip = False
                continue
            if k + 1 < len(tokens) and t + tokens[k + 1] in self.generic:
                trades |= self.trades_of(t + tokens[k + 1])
                skip = True
                continue
            latin = t
            if not t.isascii():
                latin = romanise(t)
                if latin != t and latin.isascii():
                    foreign = True
                    if latin not in LEGAL and (sound := self.by_sound(latin)):
                        trades |= sound
                        continue
                elif len(t) > 1 and not latin.isascii():
                    strange.append(t)
                    continue
            if latin in LEGAL and latin != t:
                continue
            if latin in GIVEN and not given and latin not in self.generic and (len(latin) > 3 or not words):
                given = GIVEN[latin]
                continue
            if found := self.trades_of(latin):
                trades |= found
                kept.append(heard(squeeze(latin)))
                continue
            if len(latin) == 1:
                initial = initial or latin
                continue
            if len(latin) >= 12 and len(tokens) <= 3:
                more, first, latin = self._unglue(latin)
                trades |= more
                given = given or first
            words.append(heard(squeeze(latin)))
        if not words and given:
            words, given = [given], ""
        elif not words:
            # words of scripts that are not read count where nothing else names anybody; a scrap of them beside a name does not
            words = strange or kept
        return Name(given or initial, tuple(words), frozenset(trades), foreign)


@lru_cache(maxsize=1 << 14)
def _plain_code(word: str) -> str:
    """The word's code with the sounds of s and z, and of k and ch, at its end written alike."""
    c = squeeze(code(squeeze(word)).replace("C", "k"))
    return squeeze(c[:-1] + "s") if c.endswith("j") else c


def _one_stem(a: str, b: str) -> bool:
    """Whether two words are one word with other endings: at least five and all but three letters of each begin alike."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n >= 5 and len(a) - n <= 3 and len(b) - n <= 3


def _shortens(short: str, word: str) -> bool:
    """Whether ``short`` is a short form of ``word``: letters of it in their order that are its beginning (three letters or more) and any others, or drop mostly vowels."""
    if short[-1] == "y" and word.endswith("ies"):
        word = word[:-3] + "y"
    at = 0
    for c in short:
        at = word.find(c, at) + 1
        if not at:
            return False
    return len(short) >= 3 and word.startswith(short[:3]) or sum(c in "aeiou" for c in short) <= len(short) // 3


@lru_cache(maxsize=8)
def reader(generic: tuple[str, ...], frequent: tuple[str, ...] = ()) -> NameReader:
    """A reader, one per process and set of words."""
    return NameReader(generic, frequent)


# Spellings of one sound, replaced in this order before vowels are dropped.
_CODE = (("x", "ks"), ("chh", "C"), ("ch", "C"), ("ce", "se"), ("ci", "si"), ("ge", "je"), ("gi", "ji"), ("sh", "s"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("jh", "j"), ("zh", "j"), ("ph", "f"), ("z", "j"), ("c", "k"), ("w", "v"))


@lru_cache(maxsize=1 << 17)
def code(word: str) -> str:
    """The word's phonetic code: its consonants, those heard alike written alike."""
    for a, b in _CODE:
        word = word.replace(a, b)
    out = []
    for c in word:
        if c in "aeiouy" or out and out[-1] == c:
            continue
        out.append(c)
    return "".join(out) or word[:1]


@lru_cache(maxsize=1 << 17)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity; two empty words give 1, an empty and another 0."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(n, m) // 2 - 1
    used = [False] * m
    matched = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [b[j] for j in range(m) if used[j]]
    swaps = sum(x != y for x, y in zip(matched, other, strict=True)) / 2
    k = len(matched)
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    prefix = 0
    while prefix < min(4, n, m) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _word_score(a: str, b: str, by_sound: bool) -> float:
    if a == b:
        return 1.0
    if by_sound:
        p, q = code(a), code(b)
        if p == q:
            return 0.97
        return 0.9 if min(len(p), len(q)) >= 4 and edits(p, q, 1) <= 1 else 0.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 4 and len(short) < len(long) and (long.startswith(short) or short[-1] == "k" and long.startswith(short[:-1] + "ch")):
        return 0.9  # cut short
    if 3 <= len(short) < len(long) - 1 and short[0] == long[0] and short[-1] == long[-1] and _shortens(short, long):
        return 0.9  # letters left out between the first and the last
    if len(short) == 3 and len(long) == 3:
        return 0.9 if edits(a, b, 1) <= 1 and code(a) == code(b) else 0.0
    if len(short) < 4 or len(long) - len(short) > 2:
        return 0.0
    e = edits(a, b, 2)
    if e > 2:
        return 0.0
    s = jaro_winkler(a, b)
    return max(0.9, s) if e <= 1 or len(short) >= 7 else s if s >= 0.93 and len(short) >= 5 else 0.0


@lru_cache(maxsize=1 << 17)
def words_score(a: tuple[str, ...], b: tuple[str, ...], by_sound: bool = False) -> float:
    """How alike the own words of two names are, in [0, 1], whatever their order and whether written together."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if len(a) == len(b):
        if len(a) == 1:
            best = _word_score(a[0], b[0], by_sound)
        elif len(a) == 2:
            straight = sorted((_word_score(a[0], b[0], by_sound), _word_score(a[1], b[1], by_sound)))
            best = 0.5 * sum(straight) if straight[0] > 0 else 0.0
            if not best and (cross := _word_score(a[0], b[1], by_sound)) and (other := _word_score(a[1], b[0], by_sound)):
                best = 0.5 * (cross + other)
        else:
            left = list(b)
            total, least = 0.0, 1.0
            for x in a:
                scores = [_word_score(x, y, by_sound) for y in left]
                k = max(range(len(scores)), key=scores.__getitem__)
                total += scores[k]
                least = min(least, scores[k])
                left.pop(k)
            best = total / len(a) if least > 0 else 0.0
        if best > 0:
            return best
    # written together or apart: every turn of the longer list against the other as one word
    p, q = (a, b) if len(a) <= len(b) else (b, a)
    best = 0.0
    if len(p) == 1 and len(q) == 2 and not by_sound:
        # one word cut short before the two were written together
        for first, second in (q, q[::-1]):
            head = p[0].removesuffix(second)
            if head != p[0] and len(head) >= 4 and first.startswith(head) or p[0].startswith(second) and len(p[0]) - len(second) >= 4 and first.startswith(p[0][len(second) :]):
                return 0.9
    if len(q) <= 4:
        x = "".join(p)
        cx = code(x)
        for i in range(len(q)):
            y = "".join(q[i:] + q[:i])
            if by_sound:
                cy = code(y)
                best = max(best, 0.95 if cx == cy else 0.9 if min(len(cx), len(cy)) >= 6 and edits(cx, cy, 1) <= 1 else 0.0)
            elif abs(len(x) - len(y)) <= 2 and min(len(x), len(y)) >= 7 and (e := edits(x, y, 2)) <= 2:
                best = max(best, 0.98 if e == 0 else 0.93 if e == 1 else 0.9 if min(len(x), len(y)) >= 10 else 0.0)
            elif min(len(x), len(y)) >= 8 and cx == code(y):
                best = max(best, 0.9)
    return best


@lru_cache(maxsize=1 << 14)
def given_fits(a: str, b: str) -> bool:
    """Whether two first names may be one: one of their names in common, one an initial of the other, or one missing."""
    if not a or not b or a == b:
        return True
    if len(a) == 1 or len(b) == 1:
        initial, name = sorted((a, b), key=len)
        return len(name) > 1 and any(initial in _INITIALS.get(n, n[0]) for n in name.split("|"))
    return not set(a.split("|")).isdisjoint(b.split("|"))


def trades_fit(a: frozenset[str], b: frozenset[str]) -> bool:
    """Whether two trades may be one: a generic word in common, or one not said."""
    return not a or not b or not a.isdisjoint(b)


def name_score(a: Name, b: Name) -> float:
    """The likeness of two names' own words if first names and trades allow them to be one, else 0."""
    if not given_fits(a.given, b.given) or not trades_fit(a.trades, b.trades):
        return 0.0
    return words_score(a.words, b.words, a.foreign != b.foreign)
