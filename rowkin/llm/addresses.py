"""Parts of a postal address: what names the building, what names the street, what names the place.

Words are read by small tables of usual abbreviations; what no table knows and is neither number, unit, landmark nor place is the street's
own name.
"""

from __future__ import annotations

import re

import pandas as pd
import regex

from rowkin.llm.plain_text import fold

# Street kinds and their abbreviations; written as kind: forms.
STREET_KINDS = """
street: st str street strt strasse strs; road: rd road; avenue: ave av avenue avn aven avda avenida avd; boulevard: blvd boulevard bd boul bvd; lane: ln lane; drive: drive drv; court: ct court crt; cross: crs cross; nagar: ngr nagar; marg: mg marg; colony: col cly colony clny;
place: pl place platz plz pza plaza; chemin: ch che chem chemin; impasse: imp impasse; rue: r rue; weg: weg; allee: allee all; calle: calle cl c; paseo: paseo p po pso; terrace: ter terrace; circle: cir circle; highway: hwy highway; parkway: pkwy parkway; square: sq square; quai: quai; route: rte route; cours: cours; gasse: gasse; ring: ring; damm: damm; camino: camino cno; ronda: ronda; travesia: travesia
"""
# Words in front of a street's own name.
STREET_PREFIXES = """
north: n north; south: south; east: e east; west: w west; old: old; new: new; lake: lake; mill: mill; market: mkt market; mount: mt mount; fort: ft fort; general: gen gral general; captain: cap capt captain capitan capitaine cne cpt; doctor: doctor docteur doktor;
station: stn station; temple: temple; upper: upr upper; lower: lwr lower; inner: inner; outer: outer; grand: gd grand grande; petit: pt petit petite; vieux: vx vieux vieille; haut: ht haut haute; moulin: moulin molino; pont: pont; saint: saint sainte ste sankt skt san santa sta sto;
vordere: vordere vord; hintere: hintere; kurze: kurze; lange: lange; obere: ob obere oberer; untere: unt untere unterer; puente: pte puente; alte: alte; neue: neue; grosse: grosse gr; kleine: kl kleine kleiner; vieja: vieja viejo; alta: alta alto; nueva: nueva nuevo; mayor: mayor
"""
# Words that announce a unit inside a building, a house number, a landmark, and names of countries.
UNIT_WORDS = frozenset("unit ste suite shop flat apt apartment room floor fl batiment bat haus local piso etage bloc block porte puerta bureau office oficina wohnung whg dept".split())
NUMBER_WORDS = frozenset("no number num numero nr hno h door plot house num".split())
ADDITIONS = frozenset("bis ter quater".split())
COUNTRY_WORDS = frozenset("usa us india france deutschland germany espana spain ireland eire belgium belgique belgie austria osterreich oesterreich mexico kenya in bharat".split())
RELATIONS = {
    "opposite": "opp", "oppo": "opp", "opp": "opp", "facing": "opp", "near": "near", "nr": "near", "nearby": "near", "beside": "beside", "next": "beside", "adjacent": "beside", "adj": "beside", "behind": "behind", "bhd": "behind",
}


def _table(text: str) -> dict[str, str]:
    return {form: part.split(":")[0].strip() for part in text.replace("\n", " ").split(";") if ":" in part for form in part.split(":")[1].split()}


KINDS, PREFIXES = _table(STREET_KINDS), _table(STREET_PREFIXES)
_NUMBER = re.compile(r"^([0-9]{1,4})([a-z]?)$")
_UNIT = re.compile(r"[0-9]{1,4}[a-z]?|[a-z]")
_ADDED = re.compile(r"^([0-9]{1,4})(bis|ter|quater)$")
_STREET_END = re.compile(r"(?<=.{4})str(?:as+e)?$")
# Texts that stand for no address.
PLACEHOLDERS = frozenset(("null", "na", "none", "nan", "nil", "unknown"))
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_PLAIN_WORD = re.compile(r"[a-z0-9]+")
_LANDMARK_NOISE = frozenset(("to", "the", "of"))


def _strip(tokens: list[str], part: str) -> list[str]:
    """``tokens`` without the first place where the words of ``part`` stand one after the other."""
    want = part.split()
    if not want:
        return tokens
    for i in range(len(tokens) - len(want) + 1):
        if tokens[i : i + len(want)] == want:
            return tokens[:i] + ["|"] + tokens[i + len(want) :]
    return tokens


def squeeze(word: str) -> str:
    """The word with double letters once."""
    return "".join(c for i, c in enumerate(word) if i == 0 or word[i - 1] != c)


def _usual(word: str) -> str:
    return PREFIXES.get(word) or KINDS.get(word) or word


# Letters heard alike, replaced in this order.
HEARD = (("ph", "f"), ("ck", "k"), ("ee", "i"), ("ow", "au"), ("w", "v"), ("q", "k"), ("y", "i"))


def heard(word: str) -> str:
    """The word with letters heard alike written alike, and double letters once."""
    for a, b in HEARD:
        word = word.replace(a, b)
    out = []
    for i, c in enumerate(word):
        if c == "c" and word[i + 1 : i + 2] != "h":
            c = "k"
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out)


def _words(text: str) -> list[str]:
    text = fold(text)
    return (_PLAIN_WORD if text.isascii() else _WORD).findall(text)


def parse_address(norm: str, city: str, state: str, postcode: str, landmark: str) -> tuple[str, str, str, str, str, str, str]:
    """(anchor, prefix, core, kind, town, post, state) of an address.

    ``anchor`` is the house number with its letter or addition, else the landmark with its relation in front of it, else "" for an address
    that names no building. ``core`` is the street's own name written as one word.
    """
    tokens = _words(norm)
    town = " ".join(_words(city)) if city else ""
    post = postcode if postcode.isdigit() else "".join(c for c in postcode if c.isdigit())
    mark = ""
    words = [w for w in _words(landmark) if w not in _LANDMARK_NOISE] if landmark else []
    at = next((i for i, t in enumerate(tokens) if t in RELATIONS and (not words or RELATIONS[t] == RELATIONS.get(words[0], words[0]))), None)
    if at is not None:
        # the relation, then as many words as the landmark has; two where no column tells
        stop, left = at + 1, max(1, len(words) - 1) if words else 2
        while stop < len(tokens) and (left or tokens[stop] in _LANDMARK_NOISE):
            left -= tokens[stop] not in _LANDMARK_NOISE
            stop += 1
        named = words[1:] or [t for t in tokens[at + 1 : stop] if t not in _LANDMARK_NOISE]
        mark = RELATIONS[tokens[at]] + ":" + "".join(_usual(t) for t in named)
        tokens = [*tokens[:at], "|", *tokens[stop:]]
    elif words:
        mark = RELATIONS.get(words[0], words[0]) + ":" + "".join(_usual(t) for t in words[1:])
    state_words = " ".join(_words(state)) if state else ""
    # the state stands after the town; strip its last occurrence by reversing
    if state_words:
        tokens = _strip(tokens[::-1], " ".join(state_words.split()[::-1]))[::-1]
    if town:
        tokens = _strip(tokens[::-1], " ".join(town.split()[::-1]))[::-1]
    kept: list[str] = []
    number = addition = ""
    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i]
        if t == "|":
            i += 1
            continue
        if t in UNIT_WORDS and i + 1 < n:
            j = i + 1
            if tokens[j] in ("no", "nr") and j + 1 < n:
                j += 1
            if _UNIT.fullmatch(tokens[j]):
                i = j + 1
                continue
        if t.isdigit() and len(t) >= 5 and t == post or post and len(post) >= 4 and t.isdigit() and i + 1 < n and tokens[i + 1].isdigit() and t + tokens[i + 1] == post:
            if t != post:
                i += 1
            i += 1
            continue
        m = _NUMBER.match(t)
        if m and not number and not (post and t == post and len(t) >= 4):
            number, addition = str(int(m.group(1))), m.group(2)
            if not addition and i + 1 < n:
                nxt = tokens[i + 1]
                if nxt in ADDITIONS or len(nxt) == 1 and nxt in "abcdefgh":
                    addition = nxt
                    i += 1
            i += 1
            continue
        if t.isalpha():
            kept.append(t)
            i += 1
            continue
        if not number and (m := _ADDED.match(t)):
            number, addition = m.groups()
            i += 1
            continue
        if any(c.isdigit() for c in t):
            if not post and t.isdigit() and len(t) >= 4:
                post = t
            i += 1
            continue
        kept.append(t)
        i += 1
    if kept and kept[-1] in COUNTRY_WORDS:
        kept.pop()
    own = [k for k, t in enumerate(kept) if t not in KINDS and t not in PREFIXES and t not in NUMBER_WORDS and t not in ("s", "dr", "du", "de", "des", "la", "le", "del", "der", "die", "am", "an", "and")]
    prefix: set[str] = set()
    kind = ""
    if own:
        first, last = own[0], own[-1]
        for k, t in enumerate(kept):
            if k < first and t == "st":
                prefix.add("saint")
            elif t == "s" and k < last:
                prefix.add("s")  # south or saint
            elif t == "dr":
                if k < first:
                    prefix.add("doctor")
                else:
                    kind = kind or "drive"
            elif t in PREFIXES and k < last:
                prefix.add(PREFIXES[t])
            elif t in KINDS:
                kind = kind or KINDS[t]
    core = "".join(kept[k] for k in own)
    bare = _STREET_END.sub("", core)
    if bare != core:
        core, kind = bare, kind or "street"
    anchor = number + addition if number else mark
    return anchor, " ".join(sorted(prefix)), core, kind, town, post, state_words.replace(" ", "")


def parse_columns(address: pd.Series, city: pd.Series, state: pd.Series, postcode: pd.Series, landmark: pd.Series) -> pd.DataFrame:
    """``parse_address`` over columns; nulls and placeholders are empty."""
    rows = []
    for raw, *parts in zip(address, city, state, postcode, landmark, strict=True):
        text = raw or ""
        if len(text) < 12 and "".join(c for c in text.lower() if c.isalnum()) in PLACEHOLDERS:
            text = ""
        rows.append(parse_address(text, *(x or "" for x in parts)))
    return pd.DataFrame(rows, columns=["anchor", "prefix", "core", "kind", "town", "post", "state"])
