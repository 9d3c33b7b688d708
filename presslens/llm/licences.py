"""Licence scan: one Aho-Corasick pass for tags and notices, licence expressions by shunting-yard.

A text becomes its lower-cased words joined by single blanks; the automaton finds every
phrase in it that starts and ends at a word border. After an identifier tag the raw text
holds a licence expression such as ``MIT OR (Apache-2.0 WITH LLVM-exception)``; a
shunting-yard parser turns it into postfix form, from which labels and a restriction level
follow: ``or`` offers the mildest side, ``and`` binds to the strictest, ``with`` adds an
exception and halves the level of its left side.

The score is the restriction level of what was found: 0 without a finding, 0.1 for permissive
licences up to 1 for reserved rights; several notices in one text all bind, so the strictest
counts. Null and empty texts have no words, no labels and score 0; a tag whose colon or equals
sign is followed by no readable expression gives the label ``unparsed`` and level 0.5, words of a tag in
prose, without either sign, give nothing. The work is linear in the text. Repeated rows are
scanned alike; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

import ahocorasick
from pyspark.sql import Column

from presslens.llm.common import ascii_lower, text_struct

# Base phrases and the labels they stand for.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notice phrases of well-known licences and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "mit license": "mit",
    "apache license version 2 0": "apache-2.0",
    "apache license 2 0": "apache-2.0",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by 4 0": "cc-by-4.0",
    "cc0": "cc0",
    "public domain": "public-domain",
}
TAGS = ("spdx license identifier", "license identifier", "license expression")
TAG_LABEL = "identifier"
# Restriction levels by the start of a licence name.
LEVELS = {
    "cc0": 0.05, "public-domain": 0.05, "unlicense": 0.05, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "zlib": 0.1,
    "apache": 0.15, "cc-by": 0.2, "mpl": 0.4, "lgpl": 0.45, "epl": 0.4, "cc-by-sa": 0.5, "gpl": 0.6,
    "agpl": 0.7, "cc-by-nd": 0.8, "cc-by-nc": 0.8, "reserved": 1.0,
}
UNKNOWN_LEVEL = 0.5

NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+-]*[A-Za-z0-9+])")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Between a tag and its expression stands a colon or an equals sign.
TAG_MARK = re.compile(r"[\"'\]]?[ \t]*[:=]")
NAME = re.compile(r"[a-z][a-z0-9.+]*(?:-[a-z0-9.+]+)+")


def level(name: str) -> float:
    """Restriction level of a licence by the longest known start of its name."""
    known = [k for k in LEVELS if name == k or name.startswith((k + "-", k + "+"))]
    return LEVELS[max(known, key=len)] if known else UNKNOWN_LEVEL


def postfix(tokens: Sequence[str]) -> list[str] | None:
    """Shunting-yard: postfix form of a licence expression; None if it isn't one."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in tokens:
        t = token.lower()
        if t in PRECEDENCE:
            if operand_next:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[t]:
                out.append(held.pop())
            held.append(t)
            operand_next = True
        elif t == "(":
            if not operand_next:
                return None
            held.append(t)
        elif t == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand_next:
                return None
            out.append(t)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(post: Sequence[str]) -> tuple[set[str], float]:
    """Licence names of a postfix expression and its restriction level."""
    stack: list[tuple[set[str], float]] = []
    for t in post:
        if t not in PRECEDENCE:
            stack.append(({t}, level(t)))
            continue
        (right, r), (left, l) = stack.pop(), stack.pop()
        if t == "or":
            stack.append((left | right, min(l, r)))
        elif t == "and":
            stack.append((left | right, max(l, r)))
        else:
            stack.append(({f"{a}-with-{b}" for a in left for b in right}, l / 2))
    return stack[0]


def expression_at(text: str, start: int) -> list[str] | None:
    """The longest licence expression on the rest of the line after a tag, in postfix form."""
    end = text.find("\n", start)
    rest = text[start : end if end >= 0 else len(text)]
    at = re.match(r"[\s:=\"'*]*", rest).end()
    tokens: list[str] = []
    depth = whole = 0
    operand_next = True
    while m := TOKEN.match(rest, at):
        token, at = m[1], m.end()
        operator = token.lower() in PRECEDENCE
        if (token == "(" or not operator and token != ")") != operand_next or token == ")" and not depth:
            break
        depth += (token == "(") - (token == ")")
        operand_next = operator or token == "("
        tokens.append(token)
        if not operand_next and not depth:
            whole = len(tokens)
    return postfix(tokens[:whole]) if whole else None


def _expression(text: str, start: int) -> tuple[set[str], float]:
    """Names and level of the licence expression after a tag; words that are no licence names make it unparsed."""
    post = expression_at(text, start)
    if not post or not all(t in PRECEDENCE or readable(t) for t in post):
        return {"unparsed"}, UNKNOWN_LEVEL
    return evaluate(post)


def readable(name: str) -> bool:
    """A licence known by the start of its name, or a name in parts like ``OFL-1.1``."""
    return any(name == k or name.startswith((k + "-", k + "+")) for k in LEVELS) or bool(NAME.fullmatch(name))


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICES, *TAGS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    lowered = ascii_lower(text)
    joined = f" {NOT_WORD.sub(' ', lowered).strip(' ')} "
    n_words = joined.count(" ") - 1 if joined != "  " else 0
    starts: list[int] = []
    base: set[str] = set()
    more: set[str] = set()
    levels: list[float] = []
    ends: list[int] = []  # of the words in the text, once a tag needs them
    seen, word = 0, 0  # blanks before `seen`, so words before it
    for end, phrase in automaton().iter(joined):
        at = end - len(phrase) - 1
        # hits come by their ends, so their starts lie near each other
        word += joined.count(" ", seen, at) if at >= seen else -joined.count(" ", at, seen)
        seen = at
        if phrase in BASE_PHRASES:
            starts.append(word)
            base.add(BASE_PHRASES[phrase])
        if phrase in NOTICES:
            more.add(NOTICES[phrase])
        if phrase in TAGS and not (phrase == TAGS[1] and joined.endswith(" spdx", 0, at)):
            ends = ends or [m.end() for m in WORD.finditer(lowered)]
            after = TAG_MARK.match(text, ends[word + phrase.count(" ")])
            if after:
                names, cost = _expression(text, after.end())
                more |= names | {TAG_LABEL}
                levels.append(cost)
    levels += [level(x) for x in base | set(more & set(NOTICES.values()))]
    labels = ",".join(sorted(base | more))
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return n_words, len(starts), first, last, ",".join(sorted(base)), labels, max(levels, default=0.0)


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def licence_scan(text: Column | str = "text") -> Column:
    """The findings of ``scan`` for a text column, as a struct."""
    return text_struct(scan, SCHEMA)(text)
