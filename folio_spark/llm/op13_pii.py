"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

Candidate segments (runs of digit groups, marks of addresses) form small lattices.  A segment is scored as a whole: digit
count, grouping, check digit, separators, neighbours, the word before it.  Dynamic programming over a lattice chooses
boundaries and kinds jointly; a segment has at most ``MAX_GROUPS`` digit groups or ``MAX_LABELS`` domain labels, so a
lattice of any length costs linear time.  Between lattices only "nothing" is possible, hence cutting there is exact.

The model is trained on lattices of the corpus, labelled by the patterns, and on written-out variants (:func:`variants`).
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import heapq
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.llm.base import cut, lean, table

#: Kinds in the order in which spans are listed; 0 is "nothing" in the model.
KINDS = ("email", "ip", "card", "phone")
MAX_GROUPS = 20
MAX_LABELS = 8
#: Lattices of the corpus a kind (and of none) that training takes at most.
SAMPLE = 400
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 4 and int(s or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns match, leftmost and without overlap per kind; linear in the text."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:  # an address has one @, so each is met once with the letters before it that no earlier match has
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            found.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(_octet(x) for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = only_digits(m.group()) if m.end() - m.start() > 12 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            found.append((2, *m.span()))
    at = text.find("+")
    if at >= 0:
        found += [(3, *m.span()) for m in _PHONE.finditer(text, at) if 9 <= len(only_digits(m.group())) <= 15]
    return found


# -- candidate segments -----------------------------------------------------------------------

_GROUP = re.compile(r"[0-9]+")
_GAP = re.compile(r"[  ]{0,2}(?:[-().,/_‐-―•]{0,2}|\[\.\]|\(\.\)|[\[({]dot[\])}])[  ]{0,2}")
_AT = re.compile(r"@|[\[({<]\s?(?:at|AT|At|@)\s?[\])}>]")
_SAID_AT = re.compile(r"\s(?:at|AT)\s(?=[A-Za-z0-9-]{1,63}\s(?:dot|DOT)\s)")
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|Dot|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s|\s\.\s?)"
_HOST = re.compile(rf"\s?[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,{MAX_LABELS - 1}}}")
_DOT_AT = re.compile(_DOT)
_NAME = re.compile(r"[\w.%+-]{1,64}\s?\Z")
_BEFORE = re.compile(r"([^\W\d_]{2,12})[\s:.#=]{0,3}\Z")


@dataclass(slots=True)
class Segment:
    """A candidate: its kind, bounds and what it is made of (digit groups and the gaps between, or at and dots)."""

    kind: int
    start: int
    end: int
    groups: tuple[str, ...] = ()
    gaps: tuple[str, ...] = ()
    prefix: str = ""


def _free(text: str, start: int, end: int) -> bool:
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def _numbers(text: str) -> Iterator[Segment]:
    """Segments of consecutive digit groups, each start with at most ``MAX_GROUPS`` groups and 19 digits."""
    chain: list[tuple[int, int]] = []
    spans = [m.span() for m in _GROUP.finditer(text)]
    for k, span in enumerate([*spans, None]):
        if chain and (span is None or span[0] - chain[-1][1] > 9 or not _GAP.fullmatch(text, chain[-1][1], span[0])):
            yield from _chain(text, chain)
            chain = []
        if span is not None:
            chain.append(span)


def _chain(text: str, chain: list[tuple[int, int]]) -> Iterator[Segment]:
    for a in range(len(chain)):
        digits, groups, gaps = 0, [], []
        s = chain[a][0]
        lead = s
        while lead and s - lead < 2 and text[lead - 1] in "+(":
            lead -= 1
        for b in range(a, min(len(chain), a + MAX_GROUPS)):
            s2, e = chain[b]
            digits += e - s2
            if digits > 19:
                break
            if b > a:
                gaps.append(text[chain[b - 1][1] : s2])
            groups.append(text[s2:e])
            if digits < 4 or not _free(text, s, e):
                continue
            if b - a == 3 and len(set(gaps)) == 1 and "." in gaps[0].replace("dot", ".") and all(_octet(g) for g in groups):
                yield Segment(1, s, e, tuple(groups), tuple(gaps))
            if digits >= 13:
                yield Segment(2, s, e, tuple(groups), tuple(gaps))
            if 7 <= digits <= 15 and not (lead and lead < s and text[lead - 1].isalnum()):
                yield Segment(3, lead, e, tuple(groups), tuple(gaps), text[lead:s])


def _addresses(text: str) -> Iterator[Segment]:
    marks = [m.span() for m in _AT.finditer(text)]
    if " dot " in text or " DOT " in text:
        marks += [m.span() for m in _SAID_AT.finditer(text)]
    for s, e in marks:
        name, host = _NAME.search(text[max(0, s - 66) : s]), _HOST.match(text, e)
        if not name or not host:
            continue
        start = max(0, s - 66) + name.start()
        local = name.group().rstrip()
        dots = [m for m in _DOT_AT.finditer(text, e, host.end())]
        for k, dot in enumerate(dots):
            end = dots[k + 1].start() if k + 1 < len(dots) else host.end()
            if text[end - 1].isalpha() and end > dot.end() and _free(text, start, end):
                yield Segment(0, start, end, (local, text[dot.end() : end]), (text[s:e].strip(), *(d.group().strip() for d in dots[: k + 1])))


def segments(text: str, taken: list[Span] = ()) -> list[Segment]:
    """Candidates by start, without those that touch a span in ``taken``."""
    found = sorted([*_numbers(text), *_addresses(text)], key=lambda s: (s.start, s.end, s.kind))
    if taken and found:
        spans = sorted((s, e) for _, s, e in taken)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        starts = [s for s, _ in merged]

        def clear(x: Segment) -> bool:
            k = bisect.bisect_left(starts, x.end) - 1
            return k < 0 or merged[k][1] <= x.start

        found = [x for x in found if clear(x)]
    return found


def lattices(found: list[Segment], gap: int = 3) -> Iterator[list[Segment]]:
    """Runs of candidates that overlap or lie within ``gap`` characters."""
    run, end = [], -1
    for x in found:
        if run and x.start > end + gap:
            yield run
            run, end = [], -1
        run.append(x)
        end = max(end, x.end)
    if run:
        yield run


# -- features and model -----------------------------------------------------------------------

#: Words before a span that speak for a kind (fixed values).
CONTEXT = {
    "mail": "email", "email": "email", "write": "email", "contact": "email",
    "ip": "ip", "host": "ip", "server": "ip", "address": "ip",
    "card": "card", "visa": "card", "mastercard": "card", "amex": "card", "credit": "card",
    "tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "telefon": "phone",
    "order": "id", "isbn": "id", "invoice": "id", "version": "id", "date": "id", "page": "id", "pages": "id", "number": "id",
}


def _side(c: str) -> str:
    return "space" if c.isspace() else "word" if c.isalnum() else c if c in "\"'=#$%&*/:.,-+()@" else "other"


def features(text: str, x: Segment) -> list[str]:
    """Names of the features of a whole segment."""
    kind = KINDS[x.kind]
    out = [
        kind,
        f"{kind}<{_side(text[x.start - 1]) if x.start else 'edge'}",
        f"{kind}>{_side(text[x.end]) if x.end < len(text) else 'edge'}",
    ]
    word = _BEFORE.search(text[max(0, x.start - 16) : x.start])
    said = CONTEXT.get(word.group(1).lower()) if word else None
    if said:
        out.append(f"{kind} said {said}")
    if x.kind == 0:
        at, *dots = x.gaps
        out += [f"email at {at.lower()}", f"email tld {min(len(x.groups[1]), 5)}", f"email local {min(len(x.groups[0]), 4)}", f"email alpha {x.groups[0][0].isalpha()}"]
        out += [f"email dot {d.lower()}" for d in sorted(set(dots))]
        return out
    digits = "".join(x.groups)
    shape = "-".join(str(min(len(g), 9)) for g in x.groups[:8])
    kinds = "".join(sorted(set("".join(x.gaps))))
    out += [f"{kind} shape {shape}" if x.kind != 1 else f"ip gap {x.gaps[0]}", f"{kind} gaps {kinds}", f"{kind} digits {len(digits)}"]
    if len({len(g) for g in x.groups}) == 1:
        out.append(f"{kind} even")
    if len(set(x.gaps)) > 1:
        out.append(f"{kind} mixed")
    if len(set(digits)) < 3:
        out.append(f"{kind} flat")
    after, before = text[x.end : x.end + 3], text[max(0, x.start - 3) : x.start]
    ok = f" {luhn(digits)}" if x.kind == 2 else ""
    if re.match(r"[ .,/-]{1,2}[0-9]", after):
        out.append(f"{kind} goes on{ok}")
    if re.search(r"[0-9][ .,/-]{1,2}\Z", before):
        out.append(f"{kind} went before{ok}")
    if x.kind == 2:
        out += [f"card check{ok}", f"card check{ok} {shape}"]
    if x.kind == 3:
        out += [f"phone prefix {x.prefix}", f"phone round {'(' in x.prefix or any('(' in g for g in x.gaps)} {any(')' in g for g in x.gaps)}"]
        out.append(f"phone zero {min(len(digits) - len(digits.lstrip('0')), 2)}")
    return out


class Lattice:
    """Edges of a run of segments between its boundaries: ``(from, to, label, feature ids)``, sorted by ``to``."""

    __slots__ = ("size", "edges")

    def __init__(self, run: list[Segment], feats: list[np.ndarray]):
        bounds = sorted({b for x in run for b in (x.start, x.end)})
        place = {b: k for k, b in enumerate(bounds)}
        self.size = len(bounds)
        none = np.zeros(0, np.int64)
        self.edges = [(k, k + 1, 0, none, -1) for k in range(self.size - 1)]
        self.edges += [(place[x.start], place[x.end], x.kind + 1, f, n) for n, (x, f) in enumerate(zip(run, feats))]
        self.edges.sort(key=lambda e: (e[1], e[0], e[2]))


LABELS = len(KINDS) + 1


@dataclass
class Model:
    """Weights by feature name, transitions between labels, and the score a segment must win by."""

    weights: dict[str, float]
    moves: np.ndarray
    caution: float = 1.0

    def best(self, text: str, run: list[Segment]) -> list[Span]:
        """Viterbi over the lattice of ``run``."""
        scores = [sum(self.weights.get(f, 0.0) for f in features(text, x)) - self.caution for x in run]
        lat = Lattice(run, [None] * len(run))
        value = np.full((lat.size, LABELS), -np.inf)
        value[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int, int]] = {}
        for a, b, y, _, n in lat.edges:
            before = value[a] + self.moves[:, y]
            k = int(before.argmax())
            v = before[k] + (scores[n] if n >= 0 else 0.0)
            if v > value[b, y]:
                value[b, y] = v
                back[b, y] = (a, k, n)
        at, y, out = lat.size - 1, int(value[-1].argmax()), []
        while at:
            a, k, n = back[at, y]
            if n >= 0:
                out.append((run[n].kind, run[n].start, run[n].end))
            at, y = a, k
        return out[::-1]

    def spans(self, text: str, taken: list[Span] = ()) -> list[Span]:
        return [s for run in lattices(segments(text, taken)) for s in self.best(text, run)]


def _expect(lat: Lattice, w: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partition function, each edge's probability and expected transitions, by forward and backward sums."""
    score = np.array([w[f].sum() for *_, f, _ in lat.edges])
    fwd = np.full((lat.size, LABELS), -np.inf)
    fwd[0, 0] = 0.0
    inner = []
    for (a, b, y, _, _), s in zip(lat.edges, score):
        inner.append(np.logaddexp.reduce(fwd[a] + moves[:, y]) + s)
        fwd[b, y] = np.logaddexp(fwd[b, y], inner[-1])
    bwd = np.full((lat.size, LABELS), -np.inf)
    bwd[-1] = 0.0
    total = np.logaddexp.reduce(fwd[-1])
    prob, trans = np.zeros(len(lat.edges)), np.zeros((LABELS, LABELS))
    for k in range(len(lat.edges) - 1, -1, -1):
        a, b, y, _, _ = lat.edges[k]
        prob[k] = np.exp(inner[k] + bwd[b, y] - total)
        trans[:, y] += np.exp(fwd[a] + moves[:, y] + score[k] + bwd[b, y] - total)
        bwd[a] = np.logaddexp(bwd[a], moves[:, y] + score[k] + bwd[b, y])
    return total, prob, trans


def _gold(lat: Lattice, run: list[Segment], spans: set[Span]) -> tuple[list[int], np.ndarray]:
    """Edges and transitions of the labelled path."""
    inside = [(e[0], e[1]) for e in lat.edges if e[4] >= 0 and (run[e[4]].kind, run[e[4]].start, run[e[4]].end) in spans]
    path = []
    for k, (a, b, _, _, n) in enumerate(lat.edges):
        if n >= 0:
            if (run[n].kind, run[n].start, run[n].end) in spans:
                path.append(k)
        elif not any(i <= a and b <= j for i, j in inside):
            path.append(k)
    trans, y = np.zeros((LABELS, LABELS)), 0
    for k in path:
        trans[y, lat.edges[k][2]] += 1
        y = lat.edges[k][2]
    return path, trans


def train(examples: list[tuple[str, list[Span]]], rounds: int = 30, rate: float = 0.2, l2: float = 0.05) -> Model:
    """Maximum conditional likelihood by Adagrad over whole lattices; equal examples give an equal model."""
    names: dict[str, int] = {}
    data = []
    for text, spans in examples:
        for run in lattices(segments(text)):
            feats = [np.array([names.setdefault(f, len(names)) for f in features(text, x)]) for x in run]
            want = {s for s in spans if any((x.kind, x.start, x.end) == s for x in run)}
            if any(s < run[-1].end and e > run[0].start and (k, s, e) not in want for k, s, e in spans):
                continue  # the labelled span is no candidate: nothing to learn from
            lat = Lattice(run, feats)
            data.append((lat, *_gold(lat, run, want)))
    w, moves = np.zeros(len(names)), np.zeros((LABELS, LABELS))
    gw, gm = np.full(len(names), 1e-6), np.full((LABELS, LABELS), 1e-6)
    order = np.random.RandomState(13)
    for _ in range(rounds):
        for at in np.array_split(order.permutation(len(data)), max(1, len(data) // 50)):
            dw, dm = -l2 * w * len(at) / max(len(data), 1), -l2 * moves * len(at) / max(len(data), 1)
            for k in at:
                lat, path, trans = data[k]
                _, prob, expected = _expect(lat, w, moves)
                dm += trans - expected
                prob = -prob
                prob[path] += 1
                for p, (*_, f, _) in zip(prob, lat.edges):
                    if len(f) and abs(p) > 1e-6:
                        dw[f] += p
            gw += dw**2
            gm += dm**2
            w += rate * dw / np.sqrt(gw)
            moves += rate * dm / np.sqrt(gm)
    return Model({n: float(w[k]) for n, k in names.items()}, moves)


# -- training examples ------------------------------------------------------------------------


def variants(seed: int = 13, each: int = 12) -> list[tuple[str, list[Span]]]:
    """Written-out forms that the patterns miss, forms that they know, and look-alikes without a span."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def number(n: int, ok: bool) -> str:
        d = rng.choice("3456") + digits(n - 2)
        check = next(c for c in "0123456789" if luhn(d + c))
        return d + (check if ok else rng.choice([c for c in "0123456789" if c != check]))

    def cut_up(d: str, sizes: list[int], sep: str) -> str:
        at, out = 0, []
        for n in sizes:
            out.append(d[at : at + n])
            at += n
        return sep.join(out)

    word = lambda: "".join(rng.choice(["an", "er", "is", "ol", "ta", "me", "ri", "no"]) for _ in range(rng.randint(1, 3)))
    octets = lambda: [str(rng.randint(0, 255)) for _ in range(4)]
    phone = ["({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "{a} {b} {c}", "1-{a}-{b}-{c}", "+{k} {a} {b} {c}", "+{k}-{a}-{b}-{c}", "+{k} ({a}) {b}-{c}", "+{k}.{a}.{b}.{c}", "00{k} {a} {b} {c}", "+{k}/{a}/{b}-{c}", "({a}){b}-{c}", "+{k} {a} {b}–{c}", "+{k} {a} {b} {c}"]
    mail = ["{n}@{d}.{t}", "{n} [at] {d} [dot] {t}", "{n}(at){d}.{t}", "{n} (at) {d} (dot) {t}", "{n} at {d} dot {t}", "{n} @ {d}.{t}", "{n}[at]{d}[.]{t}", "{n}@{d} . {t}", "{n} [at] {d}.{t}", "{n} at {d} dot co dot {t}"]
    ips = [".", "[.]", " . ", "(.)", "[dot]", "(dot)"]
    groups = [[16], [4, 4, 4, 4], [4, 6, 5], [4, 4, 5], [4, 4, 4, 4, 3]]
    lead = {0: ["mail", "email:", "contact", "", word], 1: ["host", "server", "", word], 2: ["card", "visa", "", word], 3: ["tel", "call", "phone:", "fax", "", word]}

    def around(kind: int | None, s: str) -> tuple[str, list[Span]]:
        head = rng.choice(lead.get(kind, ["", word, word]))
        head = (head() if callable(head) else head) + " "
        tail = rng.choice([" ", ".", ", ", "\n", "", "!!", "%%%"]) + rng.choice(["", " " + word(), " " + word()])
        return head + s + tail, [(kind, len(head), len(head) + len(s))] if kind is not None else []

    out = []
    for _ in range(each):
        for f in phone:
            out.append(around(3, f.format(a=rng.choice("23456789") + digits(2), b=digits(3), c=digits(4), k=rng.choice(["1", "44", "49", "33", "34"]))))
        for f in mail:
            out.append(around(0, f.format(n=rng.choice([word(), word() + "." + word(), word() + digits(2)]), d=word() + rng.choice(["", digits(1)]), t=rng.choice(["com", "org", "net", "de", "io"]))))
        for sep in ips:
            out.append(around(1, sep.join(octets())))
        for sizes in groups:
            for sep in ["", " ", "-", ".", "  ", "/"][: 6 if len(sizes) > 1 else 1]:
                out.append(around(2, cut_up(number(sum(sizes), True), sizes, sep)))
                out += [around(None, cut_up(number(sum(sizes), False), sizes, sep)) for _ in range(2)]
        for joint in (" ", " ", ", ", ", ", " / "):  # two cards, a phone and a card side by side
            a, b = cut_up(number(16, True), rng.choice([[16], [4, 4, 4, 4]]), " "), number(16, True)
            w = word()
            s = len(w) + 1
            out.append((f"{w} {a}{joint}{b} {word()}", [(2, s, s + len(a)), (2, s + len(a) + len(joint), s + len(a) + len(joint) + len(b))]))
            p = rng.choice(phone[:10]).format(a="555", b=digits(3), c=digits(4), k="1")
            text = f"{w} {p}{joint}{b} {word()}"
            out.append((text, [(3, s, s + len(p)), (2, s + len(p) + len(joint), s + len(p) + len(joint) + len(b))]))
        y, m, d = str(rng.randint(1900, 2030)), f"{rng.randint(1, 12):02}", f"{rng.randint(1, 28):02}"
        plain = [
            f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{y}-{m}-{d} {m}:{d}:{m}", f"{y}{m}{d}", f"{y}-{int(y) + 1}", f"{y} {int(y) + 1} {int(y) + 2}",
            ", ".join(digits(rng.randint(1, 4)) for _ in range(5)), " ".join(digits(rng.randint(1, 3)) for _ in range(rng.randint(3, 9))), " ".join(digits(4) for _ in range(rng.randint(2, 7))),
            f"{digits(1)}.{digits(2)}.{digits(1)}", f"{rng.randint(1, 9)},{digits(3)},{digits(3)}.{digits(2)}", f"{digits(3)}-{digits(3)}", f"{digits(7)}", f"{digits(8)}", f"{digits(10)}", f"{digits(12)}",
            f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"0.{digits(8)}", f"{digits(5)}.{digits(6)}", f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.1.2", f"{digits(4)}-{digits(4)}", f"{digits(2)}-{digits(7)}",
            f"{digits(6)} {digits(6)} {digits(6)}", f"{digits(11)}", f"{digits(9)}", f"@{word()}", f"{word()}@", f"{word()} at {word()} dot",
        ]
        out += [around(None, s) for s in plain]
        out.append((f"order {digits(10)} {word()}", []))
        out.append((f"isbn {digits(3)}-{digits(10)} {word()}", []))
    return out


EXCERPTS = "stratum int, hash string, text string"


def excerpts(texts: DataFrame, sample: int = SAMPLE) -> list[tuple[str, list[Span]]]:
    """At most ``sample`` lattices of the corpus for each kind that the patterns find in it and for none, by the smallest hash.

    Equal excerpts count once; every task hands on its own smallest ones, so neither copies nor a hot source fill the sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[str, str]] = [{} for _ in range(LABELS)]
        heaps: list[list] = [[] for _ in range(LABELS)]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                for lattice in lattices(segments(text)):
                    a, b = lattice[0].start, max(x.end for x in lattice)
                    if b - a > 200:
                        continue
                    part = text[max(0, a - 24) : b + 8]
                    base = base_spans(part)
                    k = base[0][0] + 1 if base else 0
                    h = hashlib.md5(part.encode("utf-8", "replace")).hexdigest()
                    if h in kept[k] or (len(kept[k]) >= sample and -int(h, 16) <= heaps[k][0]):
                        continue
                    kept[k][h] = part
                    heapq.heappush(heaps[k], -int(h, 16))
                    if len(kept[k]) > sample:
                        kept[k].pop(f"{-heapq.heappop(heaps[k]):032x}")
        rows = [(k, h, t) for k in range(LABELS) for h, t in kept[k].items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["stratum", "hash", "text"]).cast(pa.schema([("stratum", pa.int32()), ("hash", pa.string()), ("text", pa.string())]))

    found = texts.select(F.col("text").cast("string")).mapInArrow(lean(run), EXCERPTS).distinct()
    found = cut(found)  # one pass over the texts for all strata
    strata = [found.where(F.col("stratum") == k).orderBy("hash").limit(sample) for k in range(LABELS)]
    every = functools.reduce(DataFrame.unionByName, strata)
    return [(r["text"], base_spans(r["text"])) for r in sorted(every.collect(), key=lambda r: (r["stratum"], r["hash"]))]


def train_on(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    return train(excerpts(docs.select(F.col(text_col).alias("text")), sample) + variants())


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_private(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """Spans of personal data -> ``id, base, added`` (arrays of ``kind, start, end`` in code points, end exclusive).

    ``base`` holds what the patterns match, ``added`` what the model finds apart from them (it touches no base span); both
    by kind, then start.  ``redact`` adds ``redacted``: the text with every span replaced by its kind in brackets.

    Edge cases: a null text reads as empty and has no spans; null, repeated ids are rows like others; further columns are
    ignored; an empty table gives no rows.  A text is worked through in time linear in its length.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added, clean = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = base_spans(text)
                more = sorted(model.spans(text, found))
                base.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(found)])
                added.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in more])
                if redact:
                    clean.append(redacted(text, found + more))
            cols = [batch.column(0), pa.array(base, pa.list_(span)), pa.array(added, pa.list_(span))] + ([pa.array(clean, pa.string())] if redact else [])
            yield pa.RecordBatch.from_arrays(cols, ["id", "base", "added"] + (["redacted"] if redact else []))

    schema = f"id {id_type}, base {SPANS}, added {SPANS}" + (", redacted string" if redact else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with its spans replaced; of overlapping ones the first covers all."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def listed(spans):
    """``kind:start:end`` of an array of spans, by kind as in ``KINDS``, then start, joined by commas."""
    def of(kind: str):
        mine = F.filter(spans, lambda s: s["kind"] == kind)
        return F.array_sort(F.transform(mine, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    parts = [of(k) for k in KINDS]
    return F.array_join(F.transform(F.concat(*parts), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text of ``documents``; the counts are those of the patterns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_private(docs, train_on(docs))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added")
    )
