"""Licence scans: one Aho-Corasick automaton for notices and identifier tags, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from maxentnet.llm._text import encoded

#: Phrase (lower-case words) to label, as the contract has them.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices that the method adds.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "mozilla public license": "mpl",
    "isc license": "isc",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier",)
#: How freely text under a licence may be used again, 0 to 1; other identifiers count as UNKNOWN.
FREEDOM = {"mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 1.0, "cc0": 1.0, "unlicense": 1.0, "cc-by": 0.9, "mpl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0}
UNKNOWN = 0.5
#: A to Z become small, the other ASCII characters that stand in no word become spaces.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_AFTER_TAG = re.compile(rb"[ \t]*[:=]?[ \t]*([^\n]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BLANK = re.compile(r"[ \t]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def automaton(phrases: dict[str, tuple]) -> ahocorasick.Automaton:
    """Each phrase between single spaces, so that it matches whole words only."""
    out = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        out.add_word(f" {phrase} ", (len(phrase) + 1, *value))
    out.make_automaton()
    return out


def to_postfix(text: str) -> list[str]:
    """Shunting-yard: the longest well-formed licence expression at the start of ``text``, operators after their operands; [] if there is none."""
    best: tuple[int, list[str]] = 0, []  # so many of ``out``, then these operators
    out: list[str] = []
    ops: list[str] = []
    operand = False  # whether the last token ended an operand
    at = 0
    while m := _TOKEN.match(text, _BLANK.match(text, at).end()):
        token, low, at = m[0], m[0].lower(), m.end()
        if low in _BINDS:
            if not operand:
                break
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            ops.append(token)
        elif token == ")":
            if not operand or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        else:
            if operand:
                break
            out.append(token.rstrip(".:-"))
            operand = True
        if operand and "(" not in ops:
            best = len(out), ops[::-1]
    return out[: best[0]] + best[1]


def family(identifier: str) -> str:
    """The longest known name that the identifier begins with, else itself in small letters."""
    low = identifier.lower()
    return max((x for x in FREEDOM if low == x or re.match(re.escape(x) + r"[-.+\d]", low)), key=len, default=low)


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Identifiers in small letters and the freedom that the expression gives: or lets one choose the freer side, and binds by the stricter, with eases what it follows by an exception."""
    names: set[str] = set()
    stack: list[float] = []
    for x in postfix:
        if x in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if x == "or" else min(a, b) if x == "and" else min(1.0, a + 0.1))
        else:
            names.add(x.lower())
            stack.append(FREEDOM.get(family(x), UNKNOWN))
    exceptions = {postfix[i - 1].lower() for i, x in enumerate(postfix) if x == "with" and postfix[i - 1] not in _BINDS}
    return names - exceptions, stack[0] if stack else UNKNOWN


class Scanner:
    def __init__(self, base: dict[str, str] | None = None, notices: dict[str, str] | None = None):
        base, notices = BASE if base is None else base, NOTICES if notices is None else notices
        phrases: dict[str, list] = {}
        for kind, table in (("notice", notices), ("base", base), ("tag", dict.fromkeys(TAGS, ""))):
            for phrase, label in table.items():
                phrases.setdefault(phrase, []).append((kind, label))
        self.find = automaton({k: (v,) for k, v in phrases.items()})

    @staticmethod
    def after(tags: list[tuple[int, int]], line: str, text: bytes) -> Iterator[str]:
        """What stands in the text after each tag, up to the next tag or the line's end. Tags are the places of the spaces around them in the line of words."""
        spaces = {m.start(): i for i, m in enumerate(re.finditer(" ", line))}  # place of a space: the word after it
        spans = [m.span() for m in _WORD.finditer(text.translate(_TO_WORDS))]
        places = sorted((spans[spaces[a]][0], spans[spaces[b] - 1][1]) for a, b in tags)
        for (_, end), (following, _) in zip(places, [*places[1:], (len(text), 0)], strict=True):
            yield _AFTER_TAG.match(text, end, max(end, following))[1].decode("utf-8", "replace")

    def __call__(self, text: bytes) -> dict:
        found = text.translate(_TO_WORDS).split()
        line = f" {b' '.join(found).decode('utf-8', 'surrogateescape')} "
        n_base, first, last, tags = 0, None, None, []
        base, labels, freedom = set(), set(), []
        for end, (size, uses) in self.find.iter(line):
            for kind, label in uses:
                if kind == "tag":
                    tags.append((end - size, end))
                    continue
                labels.add(label)
                if kind == "base":
                    start = end - size
                    n_base += 1
                    base.add(label)
                    first = start if first is None else min(first, start)
                    last = start if last is None else max(last, start)
        expressions = []
        for stated in self.after(tags, line, text) if tags else ():
            if postfix := to_postfix(stated):
                names, value = evaluate(postfix)
                labels |= names
                freedom.append(value)
                expressions.append(" ".join(postfix))
        freedom += [FREEDOM.get(family(x), UNKNOWN) for x in labels] if not freedom else []
        return {
            "n_words": len(found),
            "n_base": n_base,
            "first_word": None if first is None else line.count(" ", 0, first),
            "last_word": None if last is None else line.count(" ", 0, last),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(labels)),
            "score": (1 - 0.5 ** (n_base + 2 * len(expressions) + len(labels - base))),
            "freedom": min(freedom) if freedom else None,
            "expressions": expressions,
        }


_OUT = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("freedom", pa.float64()), ("expressions", pa.list_(pa.string()))]
_SQL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double, expressions array<string>"


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per input row, in no shuffle: word count, places of the base phrases, labels of base phrases, added notices and tagged expressions.

    n_words, n_base, first_word, last_word count words of the whole text (a null is an empty text: 0, 0, null, null, "", "");
    labels are distinct, sorted and comma-joined. An expression is the longest well-formed one after an identifier tag (all that the
    automaton finds, whatever separates their words), before the next tag and the line's end. score is the confidence that the text states a licence: 0 without any sign, and
    each base place or added label halves its distance from 1, a parsed expression quarters it. freedom is that of the strictest
    notice or expression, null if none; expressions are in postfix order. Null keys pass through, repeated rows give repeated
    results, an empty table none, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for batch in batches:
            rows = [scanner(x) for x in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in _OUT)], names=[key, *(k for k, _ in _OUT)])

    source = df.select(key, text)
    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, {_SQL}")
