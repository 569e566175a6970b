"""Licence notices and identifier tags in documents.

An Aho-Corasick automaton walks the words of a text once and finds every phrase at its places. Words are runs
of digits, letters and non-ASCII characters, A-Z lower-cased; between two words stands one space, so punctuation
and line breaks inside a notice do not matter. Behind the phrase "spdx license identifier" the original text
holds an expression: identifiers joined by and, or, with and brackets, which a shunting-yard parser turns into
postfix order and evaluates to the licences named and, where asked for, to the alternatives that satisfy it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from notewright.llm.shared import arrow, parts, text_bytes, with_texts

#: Phrases whose places count, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Phrases of the method's own.
MORE = {
    "mit license": "mit", "licensed under mit": "mit", "permission is hereby granted free of charge": "mit",
    "apache 2 0 license": "apache-2", "licensed under the apache license": "apache-2", "www apache org licenses license 2 0": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution 4 0": "cc-by", "cc by 4 0": "cc-by", "cc by sa": "cc-by-sa", "creative commons attribution sharealike": "cc-by-sa", "cc0 1 0": "cc0", "creative commons zero": "cc0",
    "gnu general public license version 3": "gpl-3", "gnu general public license version 2": "gpl-2", "gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "gpl v3": "gpl-3", "gplv3": "gpl-3", "gplv2": "gpl-2",
    "mozilla public license": "mpl", "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd", "3 clause bsd": "bsd-3", "2 clause bsd": "bsd-2", "isc license": "isc", "this is free and unencumbered software": "unlicense", "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Words that alone say that a licence is meant; they only raise the score.
HINTS = ("license", "licence", "licensed", "copyright", "copyleft")

_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x > 127 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
_TAG = re.compile(r"(?i)spdx[^a-z0-9]+license[^a-z0-9]+identifier[^a-z0-9(\n]*")
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str, at: int = 0) -> tuple[list[str], list[frozenset[str]]] | None:
    """(licences named, alternatives that satisfy the expression) of the longest expression at that place of text, or None.

    with binds tightest, then and, then or. An identifier and its exception are one licence. Alternatives double with
    each (a or b) that and joins; who wants the names alone takes licences_named."""
    if (postfix := _to_postfix(text, at)) is None:
        return None
    stack: list[list[frozenset[str]]] = []
    for token in postfix:
        if isinstance(token, tuple):
            stack.append([frozenset(token)])
            continue
        b, a = stack.pop(), stack.pop()
        if token == "or":
            both = a + b
        elif token == "and":
            both = [x | y for x in a for y in b]
        else:
            both = [frozenset(f"{p} with {q}" for p in x for q in y) for x in a for y in b]
        stack.append(list(dict.fromkeys(both)))
    return sorted(_named(postfix)), stack[0]


def licences_named(text: str, at: int = 0) -> set[str]:
    """All licences of the longest expression at that place of text; none if there is no expression."""
    return _named(_to_postfix(text, at) or [])


def _named(postfix: list[tuple[str] | str]) -> set[str]:
    """The names of the operands, each with its exceptions, without the alternatives. Smaller sets go into larger ones."""
    stack: list[set[str]] = [set()]
    for token in postfix:
        if isinstance(token, tuple):
            stack.append(set(token))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            a = {f"{p} with {q}" for p in a for q in b}
        else:
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            a |= b
        stack.append(a)
    return stack[-1]


def _to_postfix(text: str, at: int) -> list[tuple[str] | str] | None:
    """Shunting-yard, once from left to right: operands (as tuples) and operators of the longest expression, or None.

    It stops at the first token that can't go on, at the latest at the end of the line, which no token crosses, and
    goes back to the last place at which the expression was complete."""
    out, operators, depth, operand_next, complete = [], [], 0, True, None
    while m := _TOKEN.match(text, at):
        at, t = m.end(), m[1].lower()
        if t == "(":
            if not operand_next:
                break
            operators.append(t)
            depth += 1
        elif t == ")":
            if operand_next or not depth:
                break
            while operators[-1] != "(":
                out.append(operators.pop())
            operators.pop()
            depth -= 1
        elif t in _BINDS:
            if operand_next:
                break
            while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= _BINDS[t]:
                out.append(operators.pop())
            operators.append(t)
            operand_next = True
        else:
            name = t.rstrip(".:")
            if not operand_next or name in _BINDS:
                break
            out.append((name,))
            operand_next = False
        if not operand_next and not depth:
            complete = len(out), operators[::-1]  # three operators at most: each binds tighter than the one before
    return None if complete is None else out[: complete[0]] + complete[1]


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    values: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE), ("more", MORE), ("tag", {TAG: ""}), ("hint", dict.fromkeys(HINTS, ""))):
        for phrase, label in phrases.items():
            values.setdefault(phrase, []).append((kind, label))
    for phrase, of in values.items():
        found.add_word(f" {phrase} ", (len(phrase), of))
    found.make_automaton()
    return found


def scan(text: bytes, automaton) -> tuple:
    """(n_words, places of base phrases, first and last of them, base labels, all labels, score, expressions) of a UTF-8 text."""
    words = text.translate(_TABLE).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, base, labels, hints, tags, more = [], set(), set(), 0, 0, 0
    for end, (length, of) in automaton.iter(line):
        for kind, label in of:
            if kind == "base":
                places.append(end - length)
                base.add(label)
            elif kind == "more":
                labels.add(label)
                more += 1
            elif kind == "tag":
                tags += 1
            else:
                hints += 1
    expressions = []
    if tags:
        whole = text.decode("utf-8", "replace")
        for m in _TAG.finditer(whole):
            if named := licences_named(whole, m.end()):
                expressions.append(whole[m.start() : m.end()].strip())
                labels.update(named)
    first, last = (line.count(" ", 1, min(places)), line.count(" ", 1, max(places))) if places else (None, None)
    score = 1.0 if base or expressions else 1 - 0.5 ** (2 * more + 0.5 * hints)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score, expressions


_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _scan_all(batches):
    automaton = _automaton()
    for batch in parts(batches):
        rows = [scan(t, automaton)[:7] for t in text_bytes(batch.column("text"))]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], _NAMES)


def licence_labels(docs: DataFrame) -> DataFrame:
    """One row for each of docs (doc_id, text): the places of base phrases, labels and a score from 0 to 1.

    A null or empty text has no words and scores 0; repeated rows each give a row; a null doc_id stays null;
    other columns are ignored; an empty table gives no rows."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return arrow(with_texts(docs), _scan_all, schema)
