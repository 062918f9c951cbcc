"""PII by a skip-chain conditional random field.

Base rules find emails, IPv4 addresses, cards and phone numbers. The field's tokens are these spans, each a single token
whatever its white space; texts that read as an address once their signs are written plainly (``a [at] b (dot) c``, ``a at b
dot c``); neighbouring words whose digits together are those of a base span, or its last seven or more; the other
white-space separated words that hold a digit, an ``@`` or a spelled sign; and ``CONTEXT`` words on each side of all these.
Five labels (none and the four kinds) have a unary potential from a token's shape and its neighbours', chain potentials
between neighbouring tokens, and skip potentials between equal or similar tokens anywhere in the document. Tokens are similar
if their letters and digits, in lower case and with plain signs, are equal, or become so by dropping one character from one or
each (of six or more), or end in the same seven digits, or if one is the local part of the other's address. Tokens of base spans are
observed, so what the rules are sure of is evidence for all other mentions. Marginals come from loopy sum-product message
passing in sweeps from the first token to the last and back, until the messages settle. Neighbours with one label make a
span if they can be of that kind when written plainly; base spans always stay.

The field is trained here by pseudo-likelihood on at most ``TRAIN_DOCS`` documents with such tokens, those with the least
hashes, as long as they have ``TRAIN_CHARS`` characters together at most. The base rules' spans are the teachers, and so are
disturbed copies of these documents: spans get a further mention in a form that no base rule takes, spelled out or broken
up, or one which only its likeness to the first gives away (a number without its prefix or with one digit wrong), and just
such forms of numbers and names from nowhere, labelled none, stand beside them.

Defined results: a null text is empty; offsets are code points; repeated rows and null ids are rows like any other; texts of
any length are read whole in linear time; an empty table gives no rows; input columns that clash with output columns are
replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import struct_of, table

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 2000
TRAIN_CHARS = 16_000_000
CONTEXT = 2
DAMPING = 0.3
#: Messages (largest entry 1) have settled when none moves by more; sweeps for messages that swing, which never limit how far evidence reaches.
SETTLED, SWEEPS = 1e-6, 200
LEAST_MARGINAL = 0.5
#: What other labels of an observed token weigh; the most words of a span.
OBSERVED, LONGEST = 1e-9, 12
#: Where skip potentials start from: how much repeated tokens lean to one label before any evidence.
SKIP_PRIOR = 1.0

# Base rules

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        x = ord(ch) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _small_parts(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in text.split("."))


def is_card(text: str) -> bool:
    digits = "".join(_DIGIT.findall(text)) if len(text) < 64 else ""
    return 12 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at)  # no local part reaches over an @
        at = text.find("@", max(at + 1, done))


def base_matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the base spans, sorted, and (start, end) of the matches that fail a check."""
    good, bad = [], []
    if "@" in text:
        good += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if _small_parts(m[0]):
                    good.append((m.start(), 1, m.end()))
                else:
                    bad.append(m.span())
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                n = m[0].count(" ") + m[0].count("-")
                digits = m.end() - m.start() - n
                if 12 <= digits <= 19 and luhn(m[0].replace(" ", "").replace("-", "")):
                    good.append((m.start(), 2, m.end()))
                elif digits >= 12:
                    bad.append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    good.append((m.start(), 3, m.end()))
                else:
                    bad.append(m.span())
    good.sort()
    return good, bad


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# The field

_SIGN = r"(?:at|dot|AT|DOT)"
_SEED = re.compile(rf"[0-9@]+|[\[({{]\s?{_SIGN}\s?[\])}}]|(?<=\s)(?:dot|DOT)(?=\s)")
_EDGE = "\"'`.,;:!?#*$%&|<>=\\/"
_WORD_BEFORE = re.compile(r"([^\s]{1,12})\s?$")
_WORD = re.compile(r"\s*(\S+)")
LABELS = 1 + len(KINDS)
BUCKETS = 1 << 12


_OPEN, _SHUT = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_AT_SIGN = re.compile(rf"{_OPEN}(?:(?i:at)|@){_SHUT}|\s(?i:at)\s|\s?@\s?")
_DOT_SIGN = rf"(?:{_OPEN}(?:(?i:dot)|\.){_SHUT}|\s(?i:dot)\s|\s\.\s|\.)"
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT_SIGN}[A-Za-z0-9-]{{1,63}}){{1,8}}")
_NUMERIC = re.compile(r"[()\[\]._/+-]*[0-9][0-9()\[\]._/+-]*")
_BEFORE, _AFTER = (set(f"{brackets} \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000{''.join(map(chr, range(0x2000, 0x200B)))}") for brackets in ("[({<", "])}>"))
#: The fewest last digits by which a number is known again; the most characters of a local part, and of a number's word.
TAIL, LOCAL, NUMBER = 7, 64, 40


def _at_signs(text: str) -> Iterator[tuple[int, int]]:
    """Disjoint matches of ``_AT_SIGN``, in order; looked for around each @ and each word ``at``, since few texts have many."""
    end = 0
    for core in merge(*(_places_of(text, x) for x in ("@", "at", "AT", "At", "aT"))):
        if text[core] != "@" and not (core and text[core - 1] in _BEFORE and text[core + 2 : core + 3] in _AFTER):
            continue
        for a in range(max(end, core - 3), core + 1):
            m = _AT_SIGN.match(text, a)
            if m and m.end() > core:
                yield m.span()
                end = m.end()
                break


def _places_of(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def _addresses(text: str, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans outside ``base`` that read as an address once their signs are written plainly; signs have one kind of brackets."""
    out, end, k = [], 0, 0
    for start, stop in _at_signs(text):
        a = start
        while a > end and start - a < LOCAL and _LOCAL.match(text, a - 1):
            a -= 1
        host = _HOST.match(text, stop) if a < start else None
        if host and "\n" not in (whole := text[a : host.end()]) and len({c for c in whole if c in "[({<"}) <= 1:
            while k < len(base) and base[k][1] <= a:
                k += 1
            if k == len(base) or base[k][0] >= host.end():
                out.append((a, host.end()))
                end = host.end()
    return out


def _whole(base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Base spans as disjoint ones: those that overlap are one."""
    out: list[tuple[int, int]] = []
    for a, _, b in base:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _shorter(digits: str) -> Iterator[str]:
    """A number with each digit dropped in turn; two that differ in one digit share one of these."""
    return (f"- {digits[:i]}{digits[i + 1 :]}" for i in range(len(digits)))


def _known_digits(text: str, base: list[tuple[int, int, int]]) -> set[str]:
    """Digits of base spans: of IP addresses all; of cards and phones all, the last ones, ``TAIL`` or more, and all but one."""
    out = set()
    for a, k, b in base:
        if k and b - a <= 64:
            digits = "".join(_DIGIT.findall(text[a:b]))
            out.update([digits] if k == 1 else [digits[i:] for i in range(len(digits) - TAIL + 1)])
            out.update(_shorter(digits) if k > 1 else ())
    return out


def _numbers(text: str, spans: list[tuple[int, int]], whole: set[tuple[int, int]], known: set[str]) -> list[tuple[int, int]]:
    """``spans`` with each run of neighbouring numbers, or of numbers with ``dot`` between, that together have known digits as one; the longest from each on. ``whole`` ones stay."""
    if not known:
        return spans
    plain = ["" if s in whole or s[1] - s[0] > NUMBER or not _NUMERIC.fullmatch(text, *s) else "".join(_DIGIT.findall(text, *s)) for s in spans]
    out, i = [], 0
    while i < len(spans):
        digits, last, j = plain[i], i, i + 1
        while digits and len(digits) < 24 and j < len(spans) and j - i < LONGEST and (plain[j] or text[slice(*spans[j])].strip("[](){}").lower() == "dot") and _joins(text[spans[j - 1][1] : spans[j][0]]):
            digits += plain[j]
            if plain[j] and (digits in known or digits.lstrip("0") in known or (len(digits) > TAIL and any(x in known for x in _shorter(digits)))):
                last = j
            j += 1
        out.append((spans[i][0], spans[last][1]))
        i = last + 1
    return out


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while b > a and text[b - 1] in _EDGE:
        b -= 1
    while a < b and text[a] in _EDGE:
        a += 1
    return a, b


def tokens(text: str, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    """Spans of the tokens: base spans, spelled addresses and known numbers as one each, words that hold a digit, an @ or a spelled sign, and ``CONTEXT`` words around; words without the punctuation around each."""
    own = _whole(base)
    whole = sorted(own + _addresses(text, own))
    raw: list[tuple[int, int]] = []
    n, end, more = len(text), 0, 0  # all before ``end`` is taken; words that the last seed still has to its right

    def after(limit: int) -> None:
        nonlocal end, more
        while more and (m := _WORD.match(text, end)) and m.end() <= limit:
            raw.append(m.span(1))
            end, more = m.end(), more - 1

    for a, b in merge((m.span() for m in _SEED.finditer(text)), whole):
        a = max(a, end)
        if b <= end:  # within a word that is taken
            more = CONTEXT
            continue
        while a > end and not text[a - 1].isspace():
            a -= 1
        while b < n and not text[b].isspace():
            b += 1
        after(a)
        before: list[tuple[int, int]] = []
        at = a
        while len(before) < CONTEXT:
            y = at
            while y > end and text[y - 1].isspace():
                y -= 1
            x = y
            while x > end and not text[x - 1].isspace():
                x -= 1
            if x == y:
                break
            before.append((x, y))
            at = x
        raw += before[::-1]
        raw += [(m.start() + a, m.end() + a) for m in re.finditer(r"\S+", text[a:b])]
        end, more = b, CONTEXT
    after(n)
    out, k = [], 0

    def piece(a: int, b: int, cut: bool) -> None:
        a, b = _trimmed(text, a, b)
        if a < b and (not cut or any(c == "@" or c.isdigit() for c in text[a:b])):
            out.append((a, b))

    for a, b in raw:  # words, cut where a whole token lies; of what is left of a cut word, pieces with a digit or an @ are tokens
        cut = False
        while k < len(whole) and whole[k][0] < b:
            x, y = whole[k]
            if y > a:
                piece(a, x, True)
                if out[-1:] != [(x, y)]:
                    out.append((x, y))
                a, cut = y, True
            if y > b:
                break
            k += 1
        piece(a, b, cut)
    return _numbers(text, out, set(whole), _known_digits(text, base))


def _shape(token: str) -> str:
    """Digit runs as their length, letter runs as a, all else as it is; long shapes are cut for the feature only."""
    return re.sub(r"[0-9]+", lambda m: f"<{min(len(m[0]), 20)}>", re.sub(r"[^\W\d_]+", "a", token[:80]))[:40]


def _signs(token: str) -> str:
    """How the signs of a spelled address are written, all brackets alike; empty for others."""
    at = _AT_SIGN.search(token)
    dot = re.search(_DOT_SIGN, token[at.end() :]) if at else None
    return re.sub(r"[\[{<]", "(", re.sub(r"[\]}>]", ")", f"{at[0].strip()}|{dot[0].strip()}".lower())) if dot else ""


def _bucket(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "big") % BUCKETS


def _features(text: str, spans: list[tuple[int, int]], cache: dict[str, int]) -> list[list[int]]:
    shapes = [_shape(text[a:b]) for a, b in spans]
    near = [i > 0 and spans[i][0] - spans[i - 1][1] <= 2 for i in range(len(spans))]
    out = []
    for i, (a, b) in enumerate(spans):
        token = text[a:b]
        digits = sum(c in "0123456789" for c in token[:64])
        names = [
            "bias", f"shape {shapes[i]}", f"digits {min(digits, 24)}", f"at {'@' in token}", f"dots {min(token.count('.'), 5)}", f"letters {any(c.isalpha() for c in token)}",
            f"card {is_card(token)} {digits == len(token)}", f"plus {text[max(0, a - 1):a + 1].count('+') > 0}", f"parens {token[0] == '('}", f"signs {_signs(token)}",
            f"left {shapes[i - 1] if near[i] else ''}", f"right {shapes[i + 1] if i + 1 < len(spans) and near[i + 1] else ''}", f"before {m[1].lower() if (m := _WORD_BEFORE.search(text, max(0, a - 14), a)) else ''}",
            f"ip {token.count('.') == 3 and token.replace('.', '').isdecimal() and token.isascii() and all(token.split('.')) and _small_parts(token)}",
        ]
        row = []
        for name in names:
            if name not in cache:
                if len(cache) > 100_000:
                    cache.clear()
                cache[name] = _bucket(name)
            row.append(cache[name])
        out.append(row)
    return out


_PLAIN = re.compile(r"[\W_]+")


def _similar_keys(token: str) -> list[str]:
    """Two tokens are similar if they share a key. The first key is of equal tokens; short ones and short plain words have none."""
    if any(c in " @[({<" for c in token):
        token = _AT.sub("@", _DOT.sub(".", token))
    key = _PLAIN.sub("", token).lower()
    digits = key.isdecimal() and key.isascii()
    if len(key) < (3 if digits else 4):
        return []
    keys = [f"= {key}"]
    if digits and len(key) >= 7:
        keys.append(f"7 {key[-TAIL:]}")
    if "@" in token and (local := _PLAIN.sub("", token.partition("@")[0]).lower()):
        keys.append(f"= {local}")
    if 6 <= len(key) <= 32 and (digits or any(c.isdigit() for c in key)):
        keys += [f"- {key}", *_shorter(key)]
    return keys


def _edges(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours with white space or a sign between them, and skip edges from each token to the last equal one, or else to the last similar one; as many as tokens at most."""
    chain = [(i - 1, i) for i in range(1, len(spans)) if spans[i][0] - spans[i - 1][1] <= 3 and "\n" not in text[spans[i - 1][1] : spans[i][0]]]
    last: dict[str, int] = {}
    skip = []
    for i, (a, b) in enumerate(spans):
        keys = _similar_keys(text[a:b])
        if keys:
            j = last.get(keys[0], -1)
            if j < 0:
                j = max(last.get(k, -1) for k in keys)
            if j >= 0:
                skip.append((j, i))
            last.update(dict.fromkeys(keys, i))
    return chain, skip


class Field:
    """Unary weights by feature bucket and label; one label-by-label potential for chain edges and one for skip edges."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip
        self.cache: dict[str, int] = {}

    def potentials(self, text: str, spans: list[tuple[int, int]], base: list[tuple[int, int, int]] = ()) -> np.ndarray:
        """The tokens' own weights; those of base spans are observed."""
        score = self.unary[np.array(_features(text, spans, self.cache))].sum(1)
        p = np.exp(np.maximum(score - score.max(1, keepdims=True), -60))
        for i, k in enumerate(_kinds(spans, base)):
            if k >= 0:
                p[i] = OBSERVED
                p[i, k + 1] = 1
        return p

    def marginals(self, text: str, spans: list[tuple[int, int]], base: list[tuple[int, int, int]] = ()) -> np.ndarray:
        """Label probabilities of the tokens, by loopy sum-product."""
        p = self.potentials(text, spans, base)
        edges = _edges(text, spans)
        if any(edges):
            p = self._settled(p, edges)[0]
        return p / p.sum(1, keepdims=True)

    def _settled(self, p: np.ndarray, edges: tuple[list[tuple[int, int]], list[tuple[int, int]]]) -> tuple[np.ndarray, int]:
        """Unscaled beliefs from the tokens' own weights, and the sweeps made. A token has few neighbours: one before it by chain and by likeness, and later one per key."""
        n, own = len(p), list(p)
        weights = [np.exp(np.maximum(w - w.max(), -60)) for w in (self.chain, self.skip)]
        into: list[list[int]] = [[] for _ in range(n)]  # messages that reach a token
        out: list[list[tuple[int, int, int, np.ndarray]]] = [[] for _ in range(n)]  # (message, its reverse, to, weights)
        size = 0
        for w, pairs in zip(weights, edges, strict=True):
            for i, j in pairs:
                out[i].append((size, size + 1, j, w))
                out[j].append((size + 1, size, i, w.T))
                into[j].append(size)
                into[i].append(size + 1)
                size += 2
        message = [np.ones(LABELS)] * size
        ways = ((range(n), lambda i, j: j > i), (range(n - 1, -1, -1), lambda i, j: j < i))
        for sweep in range(1, SWEEPS + 1):
            moved = 0.0
            for order, ahead in ways:
                for i in order:
                    for m, back, j, w in out[i]:
                        if not ahead(i, j):
                            continue
                        new = own[i]
                        for k in into[i]:
                            if k != back:
                                new = new * message[k]
                        new = new @ w
                        new = new / new.max()
                        moved = max(moved, float(abs(new - message[m]).max()))
                        message[m] = new if sweep == 1 else DAMPING * message[m] + (1 - DAMPING) * new
            if moved <= SETTLED:
                break
        belief = np.array(own)
        for i in range(n):
            for k in into[i]:
                belief[i] *= message[k]
            belief[i] /= belief[i].max()
        return belief, sweep

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, all spans) as (start, kind, end), sorted."""
        base, _ = base_matches(text)
        found = tokens(text, base)
        kinds = _kinds(found, base)
        if all(k >= 0 or not _could_be(text, s) for k, s in zip(kinds, found, strict=True)):
            return base, base
        best = self.marginals(text, found, base)
        label = [int(k) - 1 if p >= LEAST_MARGINAL and kind < 0 else -1 for k, p, kind in zip(best.argmax(1), best.max(1), kinds, strict=True)]
        more: list[tuple[int, int, int]] = []
        i = 0
        while i < len(found):
            k, j = label[i], i + 1
            if k < 0:
                i = j
                continue
            while j < len(found) and j - i < LONGEST and label[j] == k and _joins(text[found[j - 1][1] : found[j][0]]):
                j += 1
            while j > i and not _form(k, text[found[i][0] : found[j - 1][1]]):
                j -= 1
            if j > i:
                more.append((found[i][0], k, found[j - 1][1]))
            i = max(j, i + 1)
        more = [s for s in more if not _covered((s[0], s[2]), base)]
        return base, sorted(base + more) if more else base


def _kinds(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """The kind of the first base span that each token lies in or overlaps, or -1; both sorted."""
    out, ends = [], []
    for _, _, b in base:
        ends.append(max(b, ends[-1] if ends else 0))
    for a, b in spans:
        i = bisect_left(ends, a + 1)
        out.append(next((k for x, k, y in base[i : i + 4] if x < b and a < y), -1))
    return out


def _covered(span: tuple[int, int], base: list[tuple[int, int, int]]) -> bool:
    return _kinds([span], base)[0] >= 0


def _could_be(text: str, span: tuple[int, int]) -> bool:
    """Whether a token may be part of a span: it holds a digit, or reads as an address; no form of any kind lacks both."""
    token = text[span[0] : span[1]]
    return any(c == "@" or c.isdigit() for c in token) or _AT_SIGN.search(token) is not None


def _joins(between: str) -> bool:
    return len(between) <= 3 and "\n" not in between


_AT, _DOT = (re.compile(rf"\s*(?:[\[({{<]\s?(?:(?i:{w})|{sign})\s?[\])}}>]|\s(?i:{w})\s|{sign})\s*") for w, sign in (("at", "@"), ("dot", r"\.")))
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HANDLE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+")
_NO_DIGITS = re.compile(r"[\s\x20()\[\]._/+-]+")


def _form(kind: int, text: str) -> bool:
    """Whether a text can be of the kind once it is written plainly; whether it is, the field says."""
    if len(text) > 120:
        return False
    if kind == 0:
        plain = _AT.sub("@", _DOT.sub(".", text))
        return bool(_ADDRESS.fullmatch(plain) or _HANDLE.fullmatch(text))
    if kind == 1:
        parts = _DOT.sub(".", text)
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", parts))
    digits = _NO_DIGITS.sub("", text)
    if not (digits.isascii() and digits.isdecimal()):
        return False
    return 12 <= len(digits) <= 19 if kind == 2 else 7 <= len(digits) <= 15


# Disturbed copies of training documents


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _spelled(r: random.Random, kind: int, value: str) -> tuple[str, int]:
    """A span in a clear form that no base rule takes, and how many of its characters are of its kind."""
    if kind == 0:
        at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" @ ", "."), (" (at) ", " dot ")])
        local, _, domain = value.partition("@")
        made = f"{local}{at}{domain.replace('.', dot)}"
    elif kind == 1:
        made = value.replace(".", r.choice(["[.]", " . ", "(dot)", "[dot]"]))
    elif kind == 2:
        digits, sign = "".join(_DIGIT.findall(value)), r.choice([".", "_", "/"])
        made = sign.join(digits[i : i + 4] for i in range(0, len(digits), 4)) if r.random() < 0.5 else f"{digits} {digits}"
    else:  # the next number makes it too long for the rule
        return f"{value} " + (f"{r.randrange(100, 256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}" if r.random() < 0.5 else _digits(r, 12)), len(value)
    return made, len(made)


def _alike(r: random.Random, kind: int, value: str | None) -> str:
    """A form that only likeness to another mention gives away; of a value from nowhere without one."""
    if kind == 0:
        local = f"{r.choice('abcdeghlmnorst')}{r.choice('aeiou')}.{r.randrange(10, 100)}@mail{r.randrange(10)}" if value is None else ".".join(value.split(".")[:-2]) if "@" in ".".join(value.split(".")[:-2]) else value.split(".")[0]
        return local
    if kind == 1:
        parts = [str(r.randrange(256)) for _ in range(4)] if value is None else value.split(".")
        i = max(range(4), key=lambda x: (len(parts[x]), r.random()))
        parts[i] = f"9{parts[i][1:]}" if len(parts[i]) == 3 else f"9{parts[i]:0>2}"
        return ".".join(parts)
    digits = _digits(r, 16 if kind == 2 else 11) if value is None else "".join(_DIGIT.findall(value))
    if kind == 2:
        i = r.randrange(len(digits))
        wrong = digits[:i] + str((int(digits[i]) + r.randrange(1, 10)) % 10) + digits[i + 1 :]
        return wrong if not luhn(wrong) else digits[:-1]
    tail = digits[-10:]
    return r.choice([f"({tail[:-7]}) {tail[-7:-4]}-{tail[-4:]}", f"{tail[-7:-4]}-{tail[-4:]}", f"{tail[:-7]}-{tail[-7:-4]}-{tail[-4:]}", f"{tail[:-7]}.{tail[-7:-4]}.{tail[-4:]}"])


def _address(r: random.Random) -> str:
    """An address from nowhere."""
    local = r.choice("._-").join("".join(r.choice("abcdefghijklmnoprstuvwyz") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 3)))
    host = "".join(r.choice("abcdefghiklmnoprstuw") for _ in range(r.randrange(3, 9)))
    return f"{local}@{host}.{r.choice(('com', 'org', 'net', 'co.uk', 'de', 'edu'))}"


def disturbed(text: str, seed: int) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with further mentions and as many from nowhere and more, and the spans that a field should find in it beyond the base rules'; kind -1 is none."""
    r = random.Random(seed)
    base, _ = base_matches(text)
    some = sorted({(k, text[a:b]) for a, k, b in base if b - a < 60})
    r.shuffle(some)
    insert: list[tuple[str, int, int]] = []
    for k, value in some[:4]:
        if r.random() < 0.6:
            insert.append((*_spelled(r, k, value), k))
        if r.random() < 0.6:
            made = _alike(r, k, value)
            insert.append((made, len(made), k))
    if r.random() < 0.7:  # clear by its form, whatever else is there
        insert.append((*_spelled(r, 0, _address(r)), 0))
    for _ in range(2 * len(insert) + 1):
        kind = r.randrange(len(KINDS))
        made = _alike(r, kind, None)
        if kind == 0 and r.random() < 0.5:  # prose about a place
            made = f"{r.choice(('us', 'it', 'me', 'them', 'page', 'more'))} at {made.partition('@')[2]}.{r.choice(('com', 'org', 'net'))}"
        insert.append((made, len(made), -1))
    r.shuffle(insert)
    gaps = [m.start() for m in re.finditer(r"(?<=\S)[ \n](?=\S)", text) if not _covered((m.start() - 1, m.end() + 1), base)]
    places = sorted(r.sample(gaps, min(len(gaps), len(insert))))
    out, want, at = [], [], 0
    size = 0
    for place, (value, length, kind) in zip(places, insert, strict=False):
        out += [text[at:place], " ", value]
        start = size + place - at + 1
        size, at = start + len(value), place
        want.append((start, kind, start + length))
    return "".join([*out, text[at:]]), want


def _taught(text: str, spans: list[tuple[int, int]], more: list[tuple[int, int, int]]) -> np.ndarray:
    """The tokens' labels: of base spans and of inserted ones; -1 (unknown) where a base match fails its check."""
    base, bad = base_matches(text)
    y = np.array(_kinds(spans, base), np.int64) + 1
    known = _kinds(spans, [(a, k, b) for a, k, b in more])
    for i, (a, b) in enumerate(spans):
        inside = any(s < b and a < e for s, _, e in more)
        if inside and known[i] >= 0:
            y[i] = known[i] + 1
        elif not y[i] and not inside and any(s < b and a < e for s, e in bad):
            y[i] = -1
    return y


def train(texts: list[str], epochs: int = 12, rate: float = 0.5) -> Field:
    """Pseudo-likelihood: each token's label given its features and its neighbours' labels, by AdaGrad in a fixed order."""
    rows, labels, links, cache = [], [], [], {}
    for k, text in enumerate(texts):
        for text, more in ((text, []), disturbed(text, k)):
            spans = tokens(text, base_matches(text)[0] if more else [])  # as they are, texts teach what words of a span look like
            if not spans:
                continue
            rows += _features(text, spans, cache)
            start = len(labels)
            labels += _taught(text, spans, more).tolist()
            chain, skip = _edges(text, spans)
            links += [(start + i, start + j, 0) for i, j in chain] + [(start + i, start + j, 1) for i, j in skip]
    unary, pair = np.zeros((BUCKETS, LABELS)), np.zeros((2, LABELS, LABELS))
    pair[1] = SKIP_PRIOR * np.eye(LABELS)
    prior = pair.copy()
    if rows:
        x, y = np.array(rows), np.array(labels)
        known = y >= 0
        around = np.zeros((len(y), 2, LABELS))  # counts of neighbours' labels by edge type
        for i, j, t in links:
            if y[j] >= 0:
                around[i, t, y[j]] += 1
            if y[i] >= 0:
                around[j, t, y[i]] += 1
        around = np.minimum(around, 3)
        want = np.eye(LABELS)[np.maximum(y, 0)]
        gu, gp = np.full_like(unary, 1e-8), np.full_like(pair, 1e-8)
        for _ in range(epochs):
            for part in np.array_split(np.flatnonzero(known), max(1, known.sum() // 256)):
                z = unary[x[part]].sum(1) + np.einsum("ntl,tlm->nm", around[part], pair)
                p = np.exp(z - z.max(1, keepdims=True))
                d = (p / p.sum(1, keepdims=True) - want[part]) / max(1, len(part))
                step = np.zeros_like(unary)
                np.add.at(step, x[part].ravel(), np.repeat(d, x.shape[1], 0))
                step += 1e-5 * unary
                gu += step**2
                unary -= rate * step / np.sqrt(gu)
                step = np.einsum("ntl,nm->tlm", around[part], d)
                step = (step + step.transpose(0, 2, 1)) / 2 + 1e-5 * (pair - prior)
                gp += step**2
                pair -= rate * step / np.sqrt(gp)
    return Field(unary, pair[0], pair[1])


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Field:
    """A field trained on at most ``most`` different documents that hold a digit or an @, of ``chars`` characters in all."""
    marked = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("t"))
    total, last = 0, None
    for row in marked.groupBy("h").agg(F.max(F.length("t")).alias("n")).orderBy("h").limit(most).collect():  # two numbers a row
        total += row["n"]
        if total > chars:
            break
        last = row["h"]
    rows = [] if last is None else marked.where(F.col("h") <= last).groupBy("h").agg(F.min("t").alias("t")).collect()
    return train([r["t"] for r in sorted(rows, key=lambda r: r["h"])])


DIGEST = struct_of("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _mapped(docs: DataFrame, text_col: str, field: Field, made: T.StructType, keep_text: bool, row) -> DataFrame:
    rest = [f for f in docs.schema.fields if f.name not in made.names and (keep_text or f.name != text_col)]
    names = [f.name for f in rest] + ([text_col] if text_col not in [f.name for f in rest] else [])
    shared = docs.sparkSession.sparkContext.broadcast((field.unary.astype(np.float32), field.chain, field.skip))  # BUCKETS x LABELS numbers
    types = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        at = names.index(text_col)
        for batch in batches:
            rows = [row(own, t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(rest))], *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=[*[f.name for f in rest], *made.names])

    return docs.select(*names).mapInArrow(run, T.StructType([*rest, *made.fields]))


def found(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts of base spans, the digest of their places, and all spans."""

    def row(own: Field, text: str | None) -> tuple:
        base, every = own.spans(text or "")
        counts = [0] * len(KINDS)
        for _, k, _ in base:
            counts[k] += 1
        return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)

    return _mapped(docs, text_col, field, DIGEST, False, row)


def masked_text(field: Field, text: str | None) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, k, b in field.spans(text)[1]:
        if b > at:
            out += [text[at : max(a, at)], f"[{KINDS[k].upper()}]"]
            at = b
    return "".join([*out, text[at:]]) if out else text


def masked(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets."""
    made = T.StructType([T.StructField("_masked", T.StringType())])
    out = _mapped(docs, text_col, field, made, True, lambda own, text: (masked_text(own, text),))
    return out.select(*[F.col("_masked").alias(c) if c == text_col else c for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return found(docs, fitted(docs))
