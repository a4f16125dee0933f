"""Personal data: exact base patterns, and a skip-chain conditional random field for more.

Tokens with a digit or an at sign are the nodes.  Neighbours in the text share a chain
potential; tokens of one document that repeat, or are the same but for their
punctuation or prefix, share a skip potential however far apart they are.  Loopy message passing over both
makes the labels of a document agree; tokens under base spans are observed.  A token
that comes out as personal data with probability ``sure`` or more adds a span.

Skip edges link each token with the next one like it, so their number is linear in
the tokens.  A node's features are the shape of its token and the kind of thing that the
word before speaks of.  Node weights and the two potentials are fitted together, by
pseudo-likelihood, on ``examples`` generated texts (a bounded, fixed sample; no corpus
row is read for it).

Null text is the empty text.  Texts and tokens of any length are judged whole, base
spans in linear time.  Repeated rows are treated alike; an empty table gives an empty
result; only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)

LOCAL_BACKWARDS = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits are possessive and begin at a run's start: the same matches in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARK = re.compile(r"[0-9@]")
TOKEN_END = re.compile(r"[\x20\x09-\x0D]|\Z")
#: Digits grouped as in telephone numbers.
GROUPED = re.compile(r"(?:\+[0-9]{1,3}[-.])?[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}")
EDGE_CHARS = ".,;:!?()[]{}<>\"'|"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Every match has one at sign: the local part runs back from it, no further than the match before."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        if at > end and (tail := DOMAIN.match(text, at + 1)):
            # Backwards from the sign in growing steps, so that a long text is not copied for each sign.
            reach, start = 128, at
            while True:
                low = max(end, at - reach)
                m = LOCAL_BACKWARDS.match(text[low:at][::-1])
                start = at - (m.end() if m else 0)
                if start > low or low == end:
                    break
                reach *= 4
            if start < at:
                end = tail.end()
                found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str | None) -> list[list[tuple[int, int]]]:
    """Spans by kind, leftmost and not overlapping within a kind; matches that fail their check are dropped."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    if not text:
        return out
    if "@" in text:
        out[0] = emails(text)
    if DIGIT.search(text):
        if "." in text:
            out[1] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out[2].append(m.span())
        if "+" in text:
            out[3] = [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


# --- the field -------------------------------------------------------------


def shape(token: str) -> np.ndarray:
    """Features of one token."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    at, dots, dashes = token.count("@"), token.count("."), token.count("-")
    only = "".join(c for c in token if c.isdigit())
    parts = token.split(".")
    dotted = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return np.array(
        [1, at == 1, at == 1 and dots > 0, at > 1, digits == 0, digits in (1, 2), digits in (3, 4), 5 <= digits <= 6, 7 <= digits <= 8, 9 <= digits <= 12, 13 <= digits <= 19, digits > 19]
        + [letters > 0, letters > digits, dotted, dots == 0, dots in (1, 2), dots == 3, dots > 3, dashes == 1, dashes == 2, dashes > 2, token[:1] == "+", "(" in token, any(c in "=/:_#$%" for c in token), 13 <= digits <= 19 and letters == 0 and luhn(only), GROUPED.fullmatch(token) is not None],
        dtype=np.float64,
    )


#: Words that say what comes after them.
CUES = {
    "email": 0, "mail": 0, "e-mail": 0, "contact": 0, "write": 0, "ip": 1, "host": 1, "server": 1, "address": 1, "login": 1, "card": 2, "visa": 2, "mastercard": 2, "pay": 2, "account": 2,
    "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3, "number": 3, "order": 4, "id": 4, "page": 4, "year": 4, "in": 4, "ref": 4, "item": 4, "version": 4, "of": 4,
}


def word_before(text: str, low: int) -> str:
    """The word before a token, if it may be a cue."""
    said = text[max(0, low - 24) : low].split()
    return said[-1].strip(EDGE_CHARS).lower() if said else ""


def features(token: str, before: str) -> np.ndarray:
    cue = np.zeros(OTHER + 1)
    if before in CUES:
        cue[CUES[before]] = 1
    return np.concatenate((shape(token), cue))


def generated(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``n`` texts with the spans (kind, start, end) of the personal data in them.

    Half of the data comes again, whole or in a barer form that only the first mention
    explains; numbers that are nothing personal come again too.
    """
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    cues = [[c for c, k in CUES.items() if k == kind] for kind in range(OTHER + 1)]

    def card() -> str:
        x = r.choice("3456") + d(r.choice((12, 13, 14, 14, 14)))
        return next(x + str(c) for c in range(10) if luhn(x + str(c)))

    def phone() -> tuple[str, str]:
        a, b, c = d(3), d(3), d(4)
        return r.choice((f"+1-{a}-{b}-{c}", f"+44.{a}.{b}.{c}", f"{a}-{b}-{c}", f"+1{a}{b}{c}")), a + b + c

    def thing() -> tuple[int, str, str]:
        """A kind, a way to write the thing, and a barer one."""
        kind = r.choice((0, 1, 2, 3, 4, 4, 4, 4))
        if kind == 0:
            name = w(r.randint(2, 8)) + r.choice(("", ".", "_")) + r.choice(("x", d(2)))
            return 0, name + "@" + w(5) + "." + r.choice(("com", "org", "net", "de")), name + "@" + w(4)
        if kind == 1:
            x = ".".join(str(r.randint(0, 255)) for _ in range(4))
            return 1, x, x
        if kind == 2:
            x = card()
            return 2, x, "-".join(x[k : k + 4] for k in range(0, len(x), 4))
        if kind == 3:
            return 3, *phone()
        x = r.choice((d(1), d(2), d(4), d(r.randint(5, 12)), d(10), d(r.randint(13, 19)), d(r.randint(20, 40)), w(3) + d(2), w(8) + "=" + d(9) + w(4), f"{d(1)}.{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"${d(3)}.{d(2)}", "@" + w(6), f"{d(3)}-{d(4)}", f"{d(3)}/{d(4)}", f"{w(6)}.{d(2)}"))
        return 4, x, x

    out = []
    for _ in range(n):
        said = []
        for _ in range(r.randint(2, 6)):
            kind, first, bare = thing()
            said.append((kind, first))
            if r.random() < 0.5:
                said.append((kind, r.choice((first, bare, bare))))
        r.shuffle(said)
        text, spans = "", []
        for kind, value in said:
            for _ in range(r.randint(0, 4)):
                text += w(r.randint(2, 9)) + " "
            if r.random() < 0.4:
                text += r.choice(cues[kind]) + r.choice((" ", ": "))
            if kind != OTHER:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + r.choice((" ", ", ", ". "))
        out.append((text, spans))
    return out


def field_of(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int | None]], list[tuple[int, int]], list[int]]:
    """The nodes of a text, as (start, end, kind of the span they lie in, if any), its edges, and of each edge 0 for a chain, 1 for a skip."""
    taken = sorted((s, e, kind) for kind, s, e in spans)
    at, rows, edges, kinds, last = 0, [], [], [], {}
    for low, high in marked_tokens(text):
        while at < len(taken) and taken[at][1] <= low:
            at += 1
        kind = next((t[2] for t in taken[at : at + 4] if t[0] < high and t[1] > low), None)
        i = len(rows)
        rows.append((low, high, kind))
        if i and low - rows[i - 1][1] <= 2:
            edges.append((i - 1, i))
            kinds.append(0)
        if like := likeness(text[low:high] if kind is None or kind != 3 else span_text(text, taken, low, high)):
            if like in last:
                edges.append((last[like], i))
                kinds.append(1)
            last[like] = i
    return rows, edges, kinds


@lru_cache(maxsize=1)
def fitted(examples: int = 1500, steps: int = 400, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Node weights, and the log potentials of chains and skips, by gradient ascent on the pseudo-likelihood; the same on every worker.

    Each node is predicted from its features and its neighbours' true labels: an edge
    adds its potential to the score of the neighbour's label.
    """
    x, y, near = [], [], []
    for text, spans in generated(examples):
        rows, edges, kinds = field_of(text, spans)
        labels = [OTHER if kind is None else kind for *_, kind in rows]
        around = np.zeros((len(rows), 2, OTHER + 1))
        for (i, j), kind in zip(edges, kinds):
            around[i, kind, labels[j]] += 1
            around[j, kind, labels[i]] += 1
        x += [features(text[a:b], word_before(text, a)) for a, b, _ in rows]
        y += labels
        near.append(around)
    x, y, near = np.array(x), np.array(y), np.concatenate(near)
    goal, w, edge = np.eye(OTHER + 1)[y], np.zeros((x.shape[1], OTHER + 1)), np.zeros(2)
    mean, square = [np.zeros_like(w), np.zeros_like(edge)], [np.zeros_like(w), np.zeros_like(edge)]
    for step in range(1, steps + 1):
        score = x @ w + near[:, 0] * edge[0] + near[:, 1] * edge[1]
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        off = goal - p
        slopes = x.T @ off / len(x) - ridge * w, np.array([(near[:, k] * off).sum() for k in (0, 1)]) / len(x) - ridge * edge
        for k, (value, slope) in enumerate(zip((w, edge), slopes)):  # steps scaled by the slopes' running size
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            square[k] = 0.99 * square[k] + 0.01 * slope**2
            value += 0.1 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return w, edge


def messages(scores: np.ndarray, edges: np.ndarray, strength: np.ndarray, rounds: int = 8, damp: float = 0.3) -> np.ndarray:
    """Marginals by loopy sum-product in the log domain; all documents of a batch at once."""
    n, k = scores.shape
    if not len(edges):
        b = scores
    else:
        a, b_ = edges[:, 0], edges[:, 1]
        source, target = np.concatenate([a, b_]), np.concatenate([b_, a])
        m, back = len(edges), np.r_[len(edges) : 2 * len(edges), 0 : len(edges)]
        pull = np.exp(np.concatenate([strength, strength]))[:, None] - 1.0
        sent = np.zeros((2 * m, k))
        for _ in range(rounds):
            total = scores.copy()
            np.add.at(total, target, sent)
            out = total[source] - sent[back]
            out = np.exp(out - out.max(1, keepdims=True))
            out = np.log(out.sum(1, keepdims=True) + pull * out)
            sent = damp * sent + (1 - damp) * (out - out.mean(1, keepdims=True))
        b = scores.copy()
        np.add.at(b, target, sent)
    p = np.exp(b - b.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def likeness(token: str) -> str:
    """Tokens with equal likeness are taken for mentions of one thing; empty: like none."""
    if "@" in token:
        return "@" + token.partition("@")[0].lower()
    digits = "".join(c for c in token if c.isdigit())
    if len(digits) >= 7 and not any(c.isalpha() for c in token):
        return digits[-10:] if len(digits) < 13 else digits
    return ""


def marked_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the words that hold a digit or an at sign, without the punctuation around them."""
    found, end = [], 0
    while m := MARK.search(text, end):
        low = m.start()
        while low > end and text[low - 1] not in " \t\n\x0b\x0c\r":
            low -= 1
        high = TOKEN_END.search(text, m.end()).start()
        end = high
        while low < high and text[low] in EDGE_CHARS:
            low += 1
        while high > low and text[high - 1] in EDGE_CHARS:
            high -= 1
        if high > low:
            found.append((low, high))
    return found


def added_spans(texts: list[str | None], base: list[list[list[tuple[int, int]]]], model: tuple[np.ndarray, np.ndarray] | None = None, sure: float = 0.9) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the field adds to each text's base spans."""
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    scores, edges, strength, where = [], [], [], []
    (w, potential), known = model or fitted(), {}
    for k, text in enumerate(texts):
        if not text or not MARK.search(text):
            continue
        rows, between, kinds = field_of(text, [(kind, s, e) for kind, spans in enumerate(base[k]) for s, e in spans])
        if all(kind is not None for *_, kind in rows):
            continue  # nothing is left to label
        first = len(scores)
        edges += [(first + i, first + j) for i, j in between]
        strength += [potential[e] for e in kinds]
        for low, high, kind in rows:
            if kind is not None:
                row = np.full(OTHER + 1, -20.0)
                row[kind] = 20.0
            else:
                token, before = text[low:high], word_before(text, low)
                before = before if before in CUES else ""
                if (row := known.get((token, before))) is None:
                    row = features(token, before) @ w
                    if len(known) < 50_000:
                        known[token, before] = row
            scores.append(row)
            where.append((k, low, high, kind))
    if scores:
        p = messages(np.array(scores), np.array(edges, dtype=np.int64).reshape(-1, 2), np.array(strength))
        for (k, low, high, kind), row in zip(where, p):
            best = int(row.argmax())
            if kind is None and best != OTHER and row[best] >= sure:
                added[k].append((best, low, high))
    return added


def span_text(text: str, taken: list[tuple[int, int, int]], low: int, high: int) -> str:
    """All of the base span that a token lies in: a phone number has several tokens."""
    return next((text[s:e].replace(" ", "") for s, e, _ in taken if s < high and e > low), text[low:high])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, the number of base spans of each kind, their digest, and all spans."""

    model = fitted()  # some hundred numbers; tasks get them with their code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, model)
            flat = [[(k, s, e) for k, spans in enumerate(b) for s, e in spans] for b in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([len(b[k]) for b in base], pa.int64()) for k in range(4)), pa.array([hashlib.sha256(written(f).encode()).hexdigest() for f in flat]), pa.array([written(f + m) for f, m in zip(flat, more)], pa.string())],
                [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
