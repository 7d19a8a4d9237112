"""Scores for abusive, hateful and sexual content by a weighted finite-state pattern grammar.

A clause runs through transducers in turn, each reading the tape that the one before has written. The first maps every written token to
words of the lexicon, through disguises: look-alike characters, digits for letters, masked letters, separated or repeated letters and
swapped neighbours. The second maps words and phrases to classes: insult, belittling word, threat, person and group as targets, violent
deed, explicit word; names of peoples are recognised by their endings. The third takes the abusive classes off the tape again where they are
reported speech, said of oneself, negated, or part of a harmless compound. The last is a set of weighted automata over classes and words that
accept clauses of insult, threat, hate and explicit content. So a word scores only as part of a clause aimed at somebody.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm import abuse_grammar as g
from rowkin.llm.plain_text import fold

#: A document of at least this score is reported.
THRESHOLD = 0.5
_CLAUSE = regex.compile(r"(?<=[.!?])(?:\s+|$)|\n+|[;…]")
_SPELLED = regex.compile(r"(?<![\w*@$#€])(\p{L}(?:([.\-_*/])\p{L})(?:\2\p{L}){1,})(s|gs|ts|n|en)?(?!\w)")
_SPACED = regex.compile(r"(?<![\w*@$#€])(?:\p{L} {1,3}){2,}\p{L}(?!\w)")
_TOKEN = regex.compile(r"[\p{L}\p{N}@$#*€£!|][\p{L}\p{M}\p{N}@$#*€£|]*(?:-[\p{L}\p{N}]+)*|[:,]")
_DIGITS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "2": "z", "6": "g"}
_SIGNS = {"@": "a", "$": "s", "€": "e", "|": "il", "!": "i"}
_WILD = set("*#@$€£!|")


def _squeeze(word: str) -> str:
    out = []
    for c in word:
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out)


class Lexicon:
    """First and second transducer: written token -> words -> classes."""

    def __init__(self) -> None:
        self.classes: dict[str, set[str]] = {}
        for name, text in (("INSULT", g.INSULT), ("SLUR", g.SLUR), ("PERSON", g.PERSON), ("GROUP", g.GROUP), ("HARM", g.HARM_WORDS), ("EXPLICIT", g.EXPLICIT), ("STRONG", g.STRONG_EXPLICIT), ("REPORT", g.REPORT), ("SELF", g.SELF), ("COPULA", g.COPULA), ("NEGATION", g.NEGATION), ("VIOLENT", g.VIOLENT), ("ILL", g.ILL), ("WISH", g.WISH), ("FUTURE", g.FUTURE), ("EXPEL", g.EXPEL), ("CRIME", g.CRIME)):
            for word in text.split():
                self._put(fold(word), name)
        for word in [w for w, c in self.classes.items() if "INSULT" in c]:
            for tail in ("s", "es", "n", "en", "e"):
                if not (tail in ("n", "en", "e") and len(word) < 4):
                    self._put(word + tail, "INSULT")
            if word.endswith("on"):
                self._put(word[:-2] + "ones", "INSULT")
            if word.endswith("il"):
                self._put(word[:-2] + "iles", "INSULT")
        self.phrases: dict[str, list[tuple[list[str], str]]] = {}
        for name, texts in (("INSULT", g.INSULT_PHRASES), ("GROUP", g.GROUP_PHRASES), ("HARM", g.HARM_PHRASES), ("ILL", g.ILL_PHRASES)):
            for text in texts:
                parts = fold(text).replace("'", " ").split()
                self.phrases.setdefault(parts[0], []).append((parts, name))
                if name == "INSULT":
                    self.phrases[parts[0]].append(([*parts[:-1], parts[-1] + "s"], name))
        literal = {w for _, p in g.PATTERNS for e in p.split() for w in e.split("|") if w.isalpha() and w.islower()} | {w for ps in self.phrases.values() for p, _ in ps for w in p}
        self.known = set(self.classes) | {w for w in literal if len(w) > 3}
        # disguises are undone towards these words only
        self.hidden = {w for w, c in self.classes.items() if c & {"INSULT", "SLUR", "HARM", "EXPLICIT", "STRONG", "CRIME"} and len(w) > 2} | {w for w in literal if len(w) > 4}
        self.peoples = [(regex.compile(pattern), frozenset(before.split())) for pattern, before in g.PEOPLES]
        self.squeezed: dict[str, set[str]] = {}
        self.swapped: dict[str, set[str]] = {}
        #: the hidden words as a tree of letters; the end of a word is marked by ""
        self.tree: dict = {}
        for w in self.hidden:
            self.squeezed.setdefault(_squeeze(w), set()).add(w)
            node = self.tree
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
            if len(w) >= 4:
                for i in range(len(w) == 4, len(w) - 1):
                    other = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
                    if other not in self.known:
                        self.swapped.setdefault(other, set()).add(w)

    def _put(self, word: str, name: str) -> None:
        self.classes.setdefault(word, set()).add(name)

    @lru_cache(maxsize=1 << 17)
    def words(self, token: str) -> frozenset[str]:
        """The lexicon's words a written token may stand for; the token itself if none."""
        if token in self.known:
            return frozenset((token,))
        out: set[str] = set()
        if any(c in _WILD for c in token) or any(c.isdigit() for c in token):
            if token.isdigit() and len(token) < 3 or not any(c.isalpha() or c == "*" for c in token) and not token.isdigit():
                return frozenset((token,))
            out |= self._readings(token)
            plain = "".join((_DIGITS.get(c) or _SIGNS.get(c) or c)[0] for c in token)
            if not token.isdigit():
                out |= {plain} if plain in self.known else self._plain(plain)
        else:
            out |= self._plain(token)
        return frozenset(out or (token,))

    def _readings(self, token: str) -> set[str]:
        """Every hidden word that the token can be read as: digits and signs as the letters they look like, signs also as any letter.

        The token and the tree of words are walked together, so all readings are found and none but those of words are built.
        """
        at = [self.tree]
        wild = token[0].isalpha()
        for c in token:
            letters = (_DIGITS.get(c, "") or _SIGNS.get(c, "")) + c
            after = []
            for node in at:
                if wild and c in _WILD:
                    after += [n for k, n in node.items() if k]
                else:
                    after += [node[k] for k in letters if k in node]
            at = after
        return {node[""] for node in at if "" in node}

    def _plain(self, token: str) -> set[str]:
        if token in self.hidden:
            return {token}
        out = set(self.swapped.get(token, ()))
        narrow = _squeeze(token)
        if narrow != token and (len(narrow) >= 5 or any(token[i] == token[i + 1] == token[i + 2] for i in range(len(token) - 2))):
            out |= self.squeezed.get(narrow, set())
        return out

    def read(self, clause: str) -> list[tuple[frozenset[str], frozenset[str]]]:
        """(words, classes) of each token; a phrase of the lexicon is one token, its words stay readable one by one."""
        clause = _SPACED.sub(lambda m: " ".join(part.replace(" ", "") for part in regex.split(" {2,}", m.group())), clause)
        clause = _SPELLED.sub(lambda m: m.group(1).replace(m.group(2), "") + (m.group(3) or ""), clause)
        tokens = [self.words(t) for t in _TOKEN.findall(clause.replace("'", " ").replace("’", " "))]
        out = [(w, frozenset(c for x in w for c in self.classes.get(x, ()))) for w in tokens]
        for i, w in enumerate(tokens):
            for first in w:
                for parts, name in self.phrases.get(first, ()):
                    if i + len(parts) <= len(tokens) and all(p in tokens[i + k] for k, p in enumerate(parts)):
                        # the class lies on the phrase's first and last token
                        for j in {i, i + len(parts) - 1}:
                            out[j] = (out[j][0], out[j][1] | {name})
        self._mark_peoples(tokens, out)
        return self._scoped(out)

    def _mark_peoples(self, tokens: list[frozenset[str]], out: list) -> None:
        for i, words in enumerate(tokens):
            word = next(iter(words))
            if len(words) > 1 or len(word) < 6 or out[i][1] or word in g.NO_PEOPLE:
                continue
            near = {w for t in tokens[max(0, i - 2) : i] for w in t}
            if any(pattern.fullmatch(word) and (not before or not before.isdisjoint(near)) for pattern, before in self.peoples):
                out[i] = (out[i][0], out[i][1] | {"GROUP"})

    def _scoped(self, tape: list[tuple[frozenset[str], frozenset[str]]]) -> list[tuple[frozenset[str], frozenset[str]]]:
        """The tape without the abusive classes that stand in reported speech, are said of oneself, negated, or begin a harmless compound."""
        drop: set[int] = set()
        for i, (words, classes) in enumerate(tape):
            if "REPORT" in classes:
                before = tape[max(0, i - 3) : i]
                own = any(not w.isdisjoint(("i", "we", "ich", "wir", "je", "j", "yo")) for w, _ in before)
                passive = any("COPULA" in c or not w.isdisjoint(("got", "been", "wurde", "ete", "fui")) for w, c in before[-2:])
                comma = i + 1 < len(tape) and "," in tape[i + 1][0]
                # what the writer says to others is the writer's own; what others say, or the writer is told, is reported
                if not comma and (passive or not own):
                    drop.update(range(i + 1, len(tape)))
            if "SELF" in classes:
                for k in range(i + 1, min(len(tape), i + 4)):
                    if "COPULA" in tape[k][1] and not any(not w.isdisjoint(("you", "du", "tu", "toi")) for w, _ in tape[i:k]):
                        drop.update(range(k + 1, min(len(tape), k + 6)))
                        break
            if "INSULT" in classes or "SLUR" in classes:
                head = tape[max(0, i - 4) : i]
                no = next((k for k in range(len(head) - 1, -1, -1) if "NEGATION" in head[k][1]), None)
                if no is not None and "only" not in {w for t, _ in head[no:] for w in t}:
                    close = [c for _, c in (*tape[max(0, i - 4 + no - 1) : i],)]
                    kein = any(w.startswith("kein") or w in ("ningun", "ninguna", "aucun", "aucune") for w in head[no][0])
                    if (kein or any("COPULA" in c for c in close) or not head[no][0].isdisjoint(("isn", "isnt", "aren", "arent", "wasn", "wasnt"))) and not any("GROUP" in c for _, c in head) and not any("," in w for w, _ in head[no:]):
                        drop.add(i)
            if classes & {"HARM", "ILL", "VIOLENT"} and any("NEGATION" in c for _, c in tape[max(0, i - 3) : i]) and "HARM" not in classes:
                drop.add(i)
            if "INSULT" in classes and not words.isdisjoint(g.DOUBLE) and i + 1 < len(tape):
                after, more = tape[i + 1]
                if all(w.isalpha() for w in after) and after.isdisjoint(g.AFTER) and not more - {"NEGATION"}:
                    drop.add(i)
        return [(w, c - _ABUSIVE) if i in drop else (w, c) for i, (w, c) in enumerate(tape)]


_ABUSIVE = frozenset(("INSULT", "SLUR", "HARM", "ILL", "VIOLENT", "CRIME", "EXPEL"))


def _element(text: str) -> tuple[frozenset[str], frozenset[str]]:
    parts = text.split("|")
    return frozenset(p for p in parts if not (p.isupper() and len(p) > 1)), frozenset(p for p in parts if p.isupper() and len(p) > 1)


class Automaton:
    """A pattern of elements with bounded gaps; accepts if it can be read anywhere in a clause."""

    def __init__(self, weight: float, pattern: str):
        self.weight = weight
        self.steps: list[tuple[int, str | tuple[frozenset[str], frozenset[str]]]] = []
        gap = 0
        for e in pattern.split():
            if e.startswith(".."):
                gap = int(e[2:])
                continue
            self.steps.append((gap, e if e in "^$" else _element(e)))
            gap = 0
        # an element that every accepted clause holds; the rarest kind is chosen
        self.anchor = max((e for _, e in self.steps if not isinstance(e, str)), key=lambda e: (not e[1] & {"PERSON"}, bool(e[1]) and not e[1] & {"GROUP"}, min((len(w) for w in e[0]), default=9)))

    def accepts(self, tokens: list[tuple[frozenset[str], frozenset[str]]]) -> int | None:
        """The place of the first token that the pattern's classes begin at, or None."""
        n = len(tokens)
        ends: dict[int, int] | None = None  # next place -> begin; None: anywhere
        for gap, element in self.steps:
            if element == "^":
                ends = {0: 0}
                continue
            if element == "$":
                ends = {e: b for e, b in (ends or {}).items() if e >= n - gap}
                continue
            words, classes = element
            reached: dict[int, int] = {}
            if ends is None:
                reached = {at + 1: at for at, (w, c) in enumerate(tokens) if not words.isdisjoint(w) or not classes.isdisjoint(c)}
            else:
                for place, begin in ends.items():
                    for at in range(place, min(n, place + gap + 1)):
                        w, c = tokens[at]
                        if not words.isdisjoint(w) or not classes.isdisjoint(c):
                            reached.setdefault(at + 1, begin)
            ends = reached
            if not ends:
                return None
        return min(ends.values()) if ends else None


class Grammar:
    """The three transducers composed."""

    def __init__(self) -> None:
        self.lexicon = Lexicon()
        self.automata = [Automaton(w, p) for w, p in g.PATTERNS]
        self.by_anchor: dict[str, list[int]] = {}
        for k, a in enumerate(self.automata):
            for name in a.anchor[0] | a.anchor[1]:
                self.by_anchor.setdefault(name, []).append(k)

    @lru_cache(maxsize=1 << 15)
    def short_clause(self, clause: str) -> float:
        """``clause`` remembered; reviews repeat many sentences."""
        return self.clause(clause)

    def clause(self, clause: str) -> float:
        """The greatest weight of the automata that accept the clause."""
        tokens = self.lexicon.read(clause)
        possible = {k for w, c in tokens for name in (*w, *c) for k in self.by_anchor.get(name, ())}
        best = 0.0
        for k in sorted(possible):
            a = self.automata[k]
            if a.weight <= best:
                continue
            if a.accepts(tokens) is None:
                continue
            best = a.weight
        return best

    def score(self, text: str) -> float:
        """1 - product over the clauses of (1 - weight)."""
        rest = 1.0
        for part in _CLAUSE.split(fold(text)):
            if part and len(part) > 2:
                rest *= 1.0 - (self.short_clause(part) if len(part) < 400 else self.clause(part))
        return 1.0 - rest


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar()


def abuse_scores(documents: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score`` in [0, 1] of every row; null, empty and blank texts score 0, long texts are read whole.

    One pass without a shuffle. Columns besides ``keep`` are dropped, so their names cannot clash.
    """
    from pyspark.sql.functions import pandas_udf

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar_ = grammar()
        for part in texts:
            yield pd.Series([grammar_.score(t) if t else 0.0 for t in part], dtype="float64")

    score.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return documents.select(*keep, F.col(text_col).cast("string").alias("__text")).select(*keep, pandas_udf(score, "double")("__text").alias("score"))


def abusive_documents(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` of the documents with a score of at least ``threshold``."""
    return abuse_scores(documents, ["doc_id"]).filter(F.col("score") >= threshold).select("doc_id")


def source_rates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(source, n_docs, n_abusive, rate, mean_score)`` per source; a null source is a group of its own."""
    scored = abuse_scores(documents, ["source"])
    out = scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("score") >= threshold).alias("n_abusive"), F.avg("score").alias("mean_score"))
    return out.select("source", "n_docs", "n_abusive", (F.col("n_abusive") / F.col("n_docs")).alias("rate"), "mean_score")
