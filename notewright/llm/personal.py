"""Personal data: base patterns, high-recall candidates, boosted trees that select among them, and redaction.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Generators propose further spans that
may overlap: written-out addresses, hexadecimal network addresses, spaced or short card numbers and the cards of a
longer run of digits, telephone numbers without a plus sign, account numbers, and secrets (keys, tokens, passwords).
Boosted trees judge each by its format and its context (words before it, characters beside it). They are trained on
examples that this module makes from seeded random numbers: real formats as positive, look-alikes (dates, versions,
prices, checksums, identifiers, order numbers) as negative. Per kind, the threshold is
the smallest calibrated probability that keeps the precision on held-out examples at PRECISION. Selected spans
that overlap a base span or a likelier one are dropped.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notewright.llm.boosting import BoostedTrees
from notewright.llm.shared import arrow, parts, with_texts

BASE = ("email", "ip", "card", "phone")  #: kinds with a fixed pattern
KINDS = (*BASE, "account", "secret")
SECRET = 5  #: its number among KINDS
PRECISION, SEED, EXAMPLES = 0.99, 11, 3600
CONTEXT = 40  #: characters before a candidate that are looked at

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _GROUP = re.compile(r"[0-9]"), re.compile(r"[0-9]+")

_WRITTEN = re.compile(r"(?<=[A-Za-z0-9])[ ]?(?:\[at\]|\(at\)|[ ]at[ ])[ ]?(?P<host>[A-Za-z0-9-]{1,63}(?:[ ]?(?:\[dot\]|\(dot\)|[ ]dot[ ]|\.)[ ]?[A-Za-z0-9-]{2,63}){1,4})(?![A-Za-z0-9-])")
_HEXADECIMAL = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:])")
_LONG_NUMBER = re.compile(r"(?<![0-9A-Za-z.])[0-9]{3,6}(?:[ .-]?[0-9]{3,6}){2,5}(?![0-9A-Za-z])")
_GROUPED = re.compile(r"(?<![0-9A-Za-z.+-])(?:\(?[0-9]{2,4}\)?[ .-]{1,2})[0-9]{3,4}(?:[ .-][0-9]{2,5}){1,3}(?![0-9A-Za-z-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}+(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SOCIAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.,+-])[0-9]{7,14}+(?![0-9A-Za-z-])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{12,}+={0,2}(?![A-Za-z0-9_+/@-])")
_GIVEN = re.compile(r"""(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?[ ]{0,2}[:=][ ]{0,2}["']?([^\s"',;]{6,}+)""")
_ISSUED = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|sk_live_|xox[abp]-|eyJ|AIza|glpat-")  #: fixed value: beginnings of issued keys
_CUES = (re.compile(r"mail|contact|write|reach"), re.compile(r"\bip\b|address|server|host"), re.compile(r"card|visa|credit|payment|\bcc\b"), re.compile(r"phone|tel\b|call|mobile|fax|cell"), re.compile(r"date|version|order|invoice|price|isbn|\bid\b|page|\bno\b"), re.compile(r"account|acct|iban|konto|ssn|social security"), re.compile(r"passw|pwd|secret|token|\bkey\b|[_-]key|credential|bearer|auth"), re.compile(r"commit|sha|md5|hash|digest|checksum|uuid|build|file"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ takes the longest run before it; runs of two @ can't meet, so time is linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) in code points for each kind: leftmost matches without overlap, failing ones dropped."""
    out = {k: [] for k in BASE}
    out["email"] = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end): wide nets, overlaps allowed."""
    out = []
    if "dot" in text or "(at)" in text or "[at]" in text:
        done = 0
        for m in _WRITTEN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            out.append((0, start, m.end()))
            done = m.end()
    if _DIGIT.search(text):
        if ":" in text:
            out.extend((1, *m.span()) for m in _HEXADECIMAL.finditer(text))
        out.extend((2, *m.span()) for m in _LONG_NUMBER.finditer(text))
        out.extend((3, *m.span()) for m in _GROUPED.finditer(text))
        for m in _CARD.finditer(text):
            if len(m[0]) > 19 and len(_digits(m[0])) > 19:
                out.extend((2, m.start() + a, m.start() + b) for a, b in _cards_of_run(m[0]))
        out.extend((4, *m.span()) for m in _IBAN.finditer(text))
        out.extend((4, *m.span()) for m in _SOCIAL.finditer(text))
        out.extend((4, *m.span()) for m in _NUMBER.finditer(text))
    if _DIGIT.search(text) or _ISSUED.search(text):
        out.extend((5, *m.span()) for m in _TOKEN.finditer(text) if _ISSUED.match(m[0]) or _DIGIT.search(m[0]) and any(c.isalpha() for c in m[0]))
    if "=" in text or ":" in text:
        out.extend((5, *m.span(1)) for m in _GIVEN.finditer(text))
    return out


def _cards_of_run(run: str) -> list[tuple[int, int]]:
    """Windows of whole groups (three digits at least) of a run of digits that pass Luhn."""
    groups, out = [m.span() for m in _GROUP.finditer(run)], []
    for i, (start, _) in enumerate(groups):
        size = 0
        for a, b in groups[i : i + 6]:  # six groups of three digits have 18
            size += b - a
            if b - a < 3 or size > 19:
                break
            if size >= 13 and luhn(_digits(run[start:b])):
                out.append((start, b))
    return out


def _remainder(code: str) -> int:
    """Of an international account number, modulo 97: 1 if it is right."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 if code.isascii() and code.isalnum() else 0


def _spread(span: str) -> float:
    """Bits a character, by the characters' own counts."""
    return -sum(n / len(span) * math.log2(n / len(span)) for n in Counter(span).values())


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, before = text[start:end], text[max(0, start - CONTEXT) : start].lower()
    digits = _digits(span)
    groups = _GROUP.findall(span)
    sizes = [len(g) for g in groups] or [0]
    near = [min((len(before) - m.end() for m in cue.finditer(before)), default=CONTEXT) for cue in _CUES]
    left, right = text[start - 1 : start], text[end : end + 1]
    return [
        kind, len(span), len(digits), sum(c.isalpha() for c in span), len(groups), max(sizes), min(sizes), len(set(sizes)), float(sizes == [4, 4, 4, 4] or sizes == [4, 6, 5]), span.count(" "), span.count("-"), span.count("."), span.count(":"), span.count("("),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(digits[:1] in "3456") if digits else 0.0, float("dot" in span or "]" in span), float("::" in span or span.count(":") == 7), float(bool(re.search(r"(?:\.|dot\W?\W?)(?:com|org|net|edu|io|de|fr|es)$", span.strip().lower()))),
        float(len(span) <= 42 and _remainder(span) == 1 and span[:2].isalpha()), sum(c.isupper() for c in span), sum(c.islower() for c in span), _spread(span), float(not span.strip("0123456789abcdef")), float(_ISSUED.match(span) is not None), float(left in ("=", "'", '"')), float(text[max(0, start - 3) : start].strip(" '\"")[-1:] in ("=", ":")), span.count("_") + span.count("/") + span.count("+"),
        *near, float(left in ("", " ", "\n", ":", "(")), float(right in ("", " ", "\n", ",", ".", ";", ")", "!", "?")), float(left == "$" or right == "%"),
    ]


def _examples(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Made-up candidates with labels; all kinds and both labels in turn."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))

    def card(k: int) -> str:
        head = r.choice("3456") + number(k - 2)
        return head + next(c for c in "0123456789" if luhn(head + c))

    def spaced(d: str, by: str) -> str:
        return by.join(d[i : i + 4] for i in range(0, len(d), 4))

    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda k, of=signs: "".join(r.choice(of) for _ in range(k))
    hexadecimal = lambda k: some(k, "0123456789abcdef")

    def mixed(k: int) -> str:
        """Letters and digits, both there."""
        return next(x for x in iter(lambda: some(k), None) if _DIGIT.search(x) and x.strip("0123456789"))

    def iban(right: bool) -> str:
        body = f"{r.choice(['DE', 'FR', 'GB', 'ES', 'NL'])}00{some(r.choice([14, 16, 18]), '0123456789')}"
        code = f"{body[:2]}{98 - _remainder(body) if right else r.randint(0, 97):02d}{body[4:]}"
        return r.choice([code, " ".join(code[i : i + 4] for i in range(0, len(code), 4))])

    good = (
        lambda: f"{letters(r.randint(3, 9))}{r.choice([' at ', ' (at) ', '[at]', '(at)'])}{letters(r.randint(4, 9))}{r.choice([' dot ', '[dot]', ' (dot) '])}{r.choice(['com', 'org', 'net', 'io'])}",
        lambda: r.choice([":".join(f"{r.getrandbits(16):x}" for _ in range(8)), f"fe80::{r.getrandbits(16):x}:{r.getrandbits(16):x}:{r.getrandbits(16):x}", f"2001:db8::{r.getrandbits(16):x}:{r.getrandbits(12):x}"]),
        lambda: r.choice([spaced(card(16), r.choice(". -")), card(16), card(16), card(r.choice([13, 14, 15])), (lambda d: f"{d[:4]} {d[4:10]} {d[10:]}")(card(15))]),
        lambda: r.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(number(3), number(3), number(4)),
        lambda: r.choice([iban(True), f"{number(3)}-{number(2)}-{number(4)}", number(r.randint(7, 14))]),
        lambda: r.choice([lambda: r.choice(["AKIA", "ASIA"]) + some(16, signs[:26] + signs[-10:]), lambda: r.choice(["ghp_", "sk-", "xoxb-", "glpat-"]) + mixed(r.randint(20, 40)), lambda: hexadecimal(r.choice([16, 18, 20, 24, 32, 40, 64])), lambda: mixed(r.randint(12, 44)), lambda: f"{letters(r.randint(4, 8))}{r.choice('!#%&*-_')}{number(r.randint(2, 5))}", lambda: f"{mixed(20)}/{mixed(19)}"])(),
    )
    bad = (
        lambda: f"{letters(r.randint(2, 7))} at {letters(r.randint(2, 7))}{r.choice(['.', '. '])}{letters(r.randint(2, 6))}",
        lambda: r.choice([f"{number(2)}:{number(2)}:{number(2)}", f"{number(2)}:{number(2)}:{number(2)}:{number(2)}", f"{number(1)}:{number(3)}:{number(2)}"]),
        lambda: r.choice([number(3) + "." + number(3) + "." + number(3), number(r.choice([10, 11, 12, 14, 16])), f"{number(4)}-{number(4)}-{number(4)}", f"{number(3)} {number(3)} {number(3)}", "{0}{3}{1}{3}{2}".format(number(3), number(3), number(4), r.choice("-. "))]),
        lambda: r.choice([f"{r.randint(1900, 2030)}-{number(3)}-{number(2)}", f"{number(2)} {number(3)} {number(3)}", f"{number(4)}.{number(3)}.{number(2)}", f"{number(3)} {number(4)} {number(5)} {number(3)}"]),
        lambda: r.choice([iban(False), f"{number(3)}-{number(2)}-{number(4)}", number(r.randint(7, 14))]),
        lambda: r.choice([lambda: hexadecimal(r.choice([16, 32, 40, 64])), lambda: f"{letters(r.randint(4, 9))}_{r.randint(1990, 2030)}{number(4)}_{number(6)}", lambda: f"{hexadecimal(8)}-{hexadecimal(4)}-{hexadecimal(4)}-{hexadecimal(4)}-{hexadecimal(12)}", lambda: f"{letters(5)}-{letters(6)}-{r.randint(1, 99)}", lambda: f"{letters(r.randint(11, 18))}{r.randint(1, 9)}", lambda: f"/{letters(4)}/{letters(6)}/{number(4)}/{number(2)}", lambda: letters(r.randint(6, 14)), lambda: f"{r.randint(1, 9)}{letters(r.randint(11, 16))}"])(),
    )
    cues = ("write to", "server address", "my card", "phone", "account", "secret")
    given = ("password={}", 'token = "{}"', "api_key: {}", "secret='{}'", "pwd: {}", "Authorization Bearer {}", "access key {}")
    neutral = ("commit {}", "sha256 {}", "file {}", "build id {}", "see {}", "uuid {}", "and {} then", "md5: {}")
    x, y = [], []
    for i in range(n):
        kind, label = i % len(KINDS), (i // len(KINDS)) % 2
        span = (good if label else bad)[kind]()
        if label == 0 and kind == 2 and 13 <= len(_digits(span)) <= 19 and luhn(_digits(span)):
            span = span[:-1] + str((int(span[-1]) + 1) % 10)
        if kind == 5:  # an issued key tells by itself; what else looks random is secret where it is given as such
            form = r.choice(given) if label and (not _ISSUED.match(span) or r.random() < 0.3) else r.choice(neutral)
            text = f"{letters(5)} {form.format(span)}{r.choice([' ', '. ', chr(10)])}{letters(5)}"
        else:
            if kind == 4 and not _IBAN.match(span):  # a plain number is an account where it is called so
                context = cues[4] + r.choice([" no", "", " number"]) if label else r.choice(["order no", "date", letters(6), "page", "id"])
            else:
                context = cues[kind] if r.random() < (0.6 if label else 0.1) else "order no" if r.random() < (0.02 if label else 0.4) else letters(6)
            text = f"{letters(5)} {context} {r.choice(['', 'is ', ': '])}{span}{r.choice([' ', '. ', ', '])}{letters(5)}"
        at = text.index(span)
        x.append(features(text, kind, at, at + len(span)))
        y.append(label)
    return np.array(x, float), np.array(y, float)


class Selector:
    """Boosted trees and a threshold for each kind."""

    def __init__(self):
        self.trees = BoostedTrees().fit(*_examples(SEED, EXAMPLES))
        x, y = _examples(SEED + 1, EXAMPLES)
        p = self.trees.probability(x)
        self.threshold = []
        for kind in range(len(KINDS)):
            of = x[:, 0] == kind
            right = [t for t in np.arange(0.5, 1.0, 0.01) if (p[of] >= t).any() and y[of][p[of] >= t].mean() >= PRECISION]
            self.threshold.append(min(right, default=2.0))

    def select(self, text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
        found = candidates(text)
        if not found:
            return []
        taken = sorted(s for spans in base.values() for s in spans)
        reach = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
        starts = [s for s, _ in taken]
        free = [c for c in found if not ((i := bisect.bisect_left(starts, c[2])) and reach[i - 1] > c[1]) or c[0] == SECRET and _holds(c, taken, reach, i)]
        if not free:
            return []
        p = self.trees.probability(np.array([features(text, *c) for c in free], float))
        likely = _without_inner([(q, c) for q, c in zip(p.tolist(), free) if q >= self.threshold[c[0]]])
        chosen: list[tuple[int, int]] = []  # disjoint, by start
        out = []
        for q, (kind, start, end) in sorted(likely, key=lambda x: (-x[0], x[1])):
            i = bisect.bisect_left(chosen, (start, end))
            if i and chosen[i - 1][1] > start or i < len(chosen) and chosen[i][0] < end:
                continue
            chosen.insert(i, (start, end))
            out.append((kind, start, end))
        return out


def _holds(span: tuple[int, int, int], taken: list[tuple[int, int]], reach: list[int], i: int) -> bool:
    """Whether a span has all of the first i taken spans that it meets inside."""
    while i and reach[i - 1] > span[1]:
        i -= 1
        start, end = taken[i]
        if end > span[1] and (start < span[1] or end > span[2]):
            return False
    return True


def _without_inner(likely: list[tuple[float, tuple[int, int, int]]]) -> list[tuple[float, tuple[int, int, int]]]:
    """likely spans but the secrets that lie within a longer secret: of a secret no part may stay."""
    out, end = [], -1
    for q, (kind, a, b) in sorted(likely, key=lambda x: (x[1][1], -x[1][2])):
        if kind != SECRET or b > end:
            out.append((q, (kind, a, b)))
        if kind == SECRET:
            end = max(end, b)
    return out


def find(text: str, selector: Selector) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, int]]]:
    """(base spans by kind, all spans as (kind number, start, end) by kind and start)."""
    base = base_spans(text)
    spans = [(k, *s) for k, kind in enumerate(BASE) for s in base[kind]]
    return base, sorted(spans + selector.select(text, base))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span becomes its kind in square brackets; overlapping spans become one, under the kind of the first."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


_SCHEMA = "doc_id long, base array<struct<kind: string, start: long, end: long>>, spans array<struct<kind: string, start: long, end: long>>"
_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _find_all(selector: Selector):
    def run(batches):
        for batch in parts(batches):
            base, spans = [], []
            for text in batch.column("text").to_pylist():
                b, s = find(text or "", selector)
                base.append([{"kind": k, "start": x, "end": y} for k in BASE for x, y in b[k]])
                spans.append([{"kind": KINDS[k], "start": x, "end": y} for k, x, y in s])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, _LIST), pa.array(spans, _LIST)], ["doc_id", "base", "spans"])

    return run


def personal_spans(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """One row for each of docs (doc_id, text): doc_id, base and spans (all), in code points, by kind as in KINDS and start.

    A null or empty text has no spans; repeated rows each give a row; a null doc_id stays null; other columns are ignored."""
    return arrow(with_texts(docs), _find_all(selector or Selector()), _SCHEMA)


def _redact_all(selector: Selector, names: list[str]):
    def run(batches):
        for batch in parts(batches):
            columns = {n: batch.column(n) for n in names}
            texts = [None if t is None else redact(t, find(t, selector)[1]) for t in batch.column("text").to_pylist()]
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return run


def redact_documents(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """docs with each found span in text replaced by its kind, and n_chars (if there) counted anew; a null text stays null."""
    return arrow(docs, _redact_all(selector or Selector(), docs.columns), docs.schema)
