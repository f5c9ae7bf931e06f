"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The model is trained in numpy on labelled spans: matches of the patterns in a bounded sample of documents, and invented
ones put into passages of them in looser writing: addresses with "at" and "dot" in words or brackets, ips with bracketed
or spaced dots, cards grouped by dots or slashes, phones without a plus, and secrets (a fifth kind) assigned to a name.
It reads overlapping windows of `WINDOW` characters. Where two windows overlap, each character takes the emissions of the
window in which it lies further from the edge, and the network reads only up to these; runs of neighbouring windows then have
one best path, so spans are reconciled over the whole text and may cross windows. Long runs pass through in parts, with the
pass's state carried on, so the result is the same and memory stays bounded.

Every window of every text is read. The Viterbi pass leaves out characters whose emissions prove that the best path over the
whole text is outside all spans there, which changes no path. (`every=False` leaves out windows
without a digit, an at sign or a worded dot near them, which each accepted span holds; the pass then begins and ends beside them, and spans may differ.)

Spans that overlap a base span or an earlier added one are dropped, so base spans always stay. Defined cases: a null text
is empty and has no spans; texts of any length are read whole; rows repeated with one id, or without one, give a row each.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import bounded_sample, row_slices, utf8

#: The four kinds of the patterns, and one that only the model finds.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
WINDOW, STEP = 64, 32
#: A character takes the window in which it is further from an edge: borders lie in the middle of the overlap.
CUT = (WINDOW - STEP) // 2
#: Units of a direction of the network.
HIDDEN = 12
#: Windows whose emissions are held at once, and bytes of text that are read at once.
HELD, SLICE = 16_384, 4 << 20
#: Windows that the network reads at once; its tables then stay in a core's cache.
READ = 1024
#: After how many characters states of windows that begin (backward: end) alike are shared; that many classes fit a 64-bit code.
SHARED = (6, 9, 12)
#: Characters of stretches that wait for one Viterbi pass, about.
WAITING = 200_000
#: Scores nearer than this are left to the Viterbi pass.
ROUNDING = 1e-3
#: Documents that the model is fitted on, at most, and the longest of them; the bounds are part of the method.
SAMPLE_ROWS = 1_500
SAMPLE_CHARS = 50_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"""(?i)[a-z_]{2,20}["']?[ ]?[:=][ ]?["']?([A-Za-z0-9+/_-]{16,64})\b""")
_DOT = r"(?: dot |[(\[{ ]dot[)\]} ])"
_CUE = re.compile(rf"[0-9@]|{_DOT}")
_AT = re.compile(r"@| at |[(\[{]at[)\]}]")
#: Every plausible span holds one of these.
_HELD = re.compile(rf"[0-9]|{_AT.pattern}")
_POINT = re.compile(rf"\.|{_DOT}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octet(digits: str) -> bool:
    digits = digits.lstrip("0")  # there may be thousands of zeros
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed patterns, in the order of the kinds and then of the places.

    An address is found from its at sign: its local part is the longest run before it that no earlier match has taken.
    """
    out: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((0, a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _CUE.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(octet(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


#: Characters' classes are the network's input: letters' case, each digit, marks that the kinds use, blanks, others.
_MARKS = "@.+-()_%[]:/#*&$\"'=!,"
_CLASS = np.zeros(0x250, np.uint8)
for _c in range(0x250):
    _s = chr(_c)
    _CLASS[_c] = 1 + ord(_s) - 48 if "0" <= _s <= "9" else 11 if _s in "atdo" else 12 if _s.islower() else 13 if _s.isupper() else 14 if _s == " " else 15 if _s == "\n" else 16 + _MARKS.index(_s) if _s in _MARKS else 0
N_CLASSES = 16 + len(_MARKS)
#: Tags: 0 outside, 1 + 2 k begins and 2 + 2 k continues a span of kind k.
N_TAGS = 1 + 2 * len(KINDS)


def classes(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 0x250, _CLASS[np.minimum(codes, 0x24F)], 12)


def soft(x: np.ndarray) -> np.ndarray:
    """Softsign, in place of tanh: numpy takes several times as long for a tanh."""
    return x / (1 + np.abs(x))


class Tagger:
    """A bidirectional LSTM over character classes, a linear layer to tags, and CRF transitions.

    Its squashing function is the softsign, and (1 + softsign) / 2 for the gates.
    """

    def __init__(self, hidden: int = HIDDEN, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        h = self.hidden = hidden
        f = lambda *shape: r.normal(0, 0.2, shape).astype(np.float32)
        self.p = {"xf": f(N_CLASSES, 4 * h), "hf": f(h, 4 * h), "xb": f(N_CLASSES, 4 * h), "hb": f(h, 4 * h), "o": f(2 * h, N_TAGS), "ob": np.zeros(N_TAGS, np.float32), "t": np.zeros((N_TAGS, N_TAGS), np.float32)}
        for k in ("xf", "xb"):
            self.p[k][:, h : 2 * h] += 0.5  # forget gates start open

    def run(self, x: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Hidden states (time, row, hidden) of one direction over (row, time) classes, and what `back` needs of each step."""
        h = self.hidden
        w, u = self.p["x" + way], self.p["h" + way]
        n, t = x.shape
        out, state, cell, seen = np.zeros((t, n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for k in range(t) if way == "f" else range(t - 1, -1, -1):
            z = soft(w[x[:, k]] + state @ u)
            g, c = 0.5 * z[:, : 3 * h] + 0.5, z[:, 3 * h :]
            new = g[:, h : 2 * h] * cell + g[:, :h] * c
            th = soft(new)
            seen.append((k, state, cell, g, c, th))
            state, cell = g[:, 2 * h :] * th, new
            out[k] = state
        return out, seen

    def read(self, x: np.ndarray, way: str, skip: int, cell: np.ndarray, state: np.ndarray, out: np.ndarray) -> None:
        """Goes on from cells and states, in place, over classes (row, step) in reading order: `run` with both twice as large.
        The states of the steps from `skip` on are put into out.

        The gates' sums are made together and then dealt to an array of each gate, a row's gate as one item, so every step goes over
        whole arrays, in place. Doubled cells and states, with halved weights, save the gates' halving.
        """
        h, n = self.hidden, len(x)
        w, u = self.p["x" + way], self.p["h" + way] * np.float32(0.5)
        x = np.ascontiguousarray(x.T, np.intp)
        given, sums = np.empty((n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32)
        z, add, more = np.empty((4, n, h), np.float32), np.empty((4, n, h), np.float32), np.empty((n, h), np.float32)
        item = np.dtype((np.void, 4 * h))
        parts, gates = sums.view(item).T, z.view(item)[:, :, 0]
        for k in range(len(x)):
            w.take(x[k], 0, given, "clip")
            np.matmul(state, u, out=sums)
            sums += given
            gates[:] = parts
            np.abs(z, out=add)
            add += 1
            z /= add
            z[:3] += 1
            cell *= z[1]
            cell *= 0.5
            cell += np.multiply(z[0], z[3], out=more)
            np.abs(cell, out=more)
            more += 2
            np.divide(cell, more, out=more)
            np.multiply(z[2], more, out=state)
            if k >= skip:
                out[k - skip] = state

    def begun(self, x: np.ndarray, way: str, levels: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Cells and states of rows (row, step) behind as many steps as the last level says. A state depends on the steps before it alone,
        so rows that begin alike are read once."""
        if not levels:
            return np.zeros((len(x), self.hidden), np.float32), np.zeros((len(x), self.hidden), np.float32)
        done, n = (0, *levels)[-2:]
        codes = x[:, :n].astype(np.uint64) @ np.array([N_CLASSES**k for k in range(n)], np.uint64)
        _, one, back = np.unique(codes, return_index=True, return_inverse=True)
        some = x[one]
        cell, state = self.begun(some, way, levels[:-1])
        for a in range(0, len(some), READ):
            b = slice(a, a + READ)
            self.read(some[b, done:n], way, n, cell[b], state[b], cell)
        return cell[back], state[back]

    def between(self, x: np.ndarray, first: int, last: int) -> np.ndarray:
        """Emissions (tag, time, window) of the characters from first to last - 1 of each window, which each direction reads up to them."""
        h, half, size = self.hidden, self.p["o"].T * np.float32(0.5), x.shape[1]
        ways = []
        for way, steps, skip in (("f", x[:, :last], first), ("b", x[:, ::-1][:, : size - first], size - last)):
            levels = tuple(n for n in SHARED if n <= skip)
            done = (0, *levels)[-1]
            ways.append((way, steps[:, done:], skip - done, *self.begun(steps, way, levels)))
        e = np.empty((N_TAGS, last - first, len(x)), np.float32)
        for a in range(0, len(x), READ):
            b = slice(a, a + READ)
            both = []
            for way, steps, skip, cell, state in ways:
                out = np.empty((last - first, len(cell[b]), h), np.float32)
                self.read(steps[b], way, skip, cell[b], state[b], out if way == "f" else out[::-1])
                both.append(out.reshape(-1, h).T)
            some = np.ascontiguousarray(half[:, :h]) @ both[0]
            some += np.ascontiguousarray(half[:, h:]) @ both[1]
            some += self.p["ob"][:, None]
            e[:, :, b] = some.reshape(N_TAGS, last - first, -1)
        return e

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Emissions of each window's middle, which no other window gives."""
        return self.between(x, CUT, CUT + STEP)

    def outside(self, e: np.ndarray) -> np.ndarray:
        """Where emissions (tag, character) alone put the best path outside all spans (tag 0).

        Another tag there can be changed to 0 at the price of two transitions; where 0 leads by more than these can
        give, whatever the neighbours' tags are, no best path has another.
        """
        t = self.p["t"].astype(np.float64)
        gain = np.maximum((t - t[:, :1]).max(0), 0) + np.maximum((t - t[0]).max(1), 0)
        return (e[1:] + gain[1:, None]).max(0) + ROUNDING < e[0]

    def undecided(self, lead: np.ndarray, begins: bool, stops: bool) -> np.ndarray:
        """Where the best path may be inside a span, by the lead of each character's best other tag over tag 0.

        A stretch of other tags gains at most its leads, an entry, an exit and a transition between each two characters.
        If no stretch through a character gains more than 0, changing it to tag 0 makes the path better, so no best path
        has one. The best gains of all stretches up to and from each character are running sums and maxima. `begins` and
        `stops`: whether the text does here, so that a stretch needs no entry or exit; else a tag 0 stands beside.
        """
        t = self.p["t"].astype(np.float64) - float(self.p["t"][0, 0])
        enter, leave, stay = t[0, 1:].max(), t[1:, 0].max(), t[1:, 1:].max()
        gains = lead + stay
        sums = np.cumsum(gains, dtype=np.float64)
        first, last = enter - (sums - gains), leave + sums
        if begins:
            first[0] = max(enter, 0)
        if stops:
            last[-1] = sums[-1] + max(leave, 0)
        # the best beginning before it and the best end behind it, with all between them
        best = np.maximum.accumulate(first) + np.maximum.accumulate(last[::-1])[::-1] - stay
        return best > -ROUNDING

    def back(self, x: np.ndarray, way: str, seen: list, grad: np.ndarray, g: dict) -> None:
        h, u = self.hidden, self.p["h" + way]
        ds, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
        for k, state, cell, gates, c, th in reversed(seen):
            d = grad[k] + ds
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            dn = dc + d * o * (1 - np.abs(th)) ** 2
            slope = 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
            dz = np.concatenate([np.concatenate([dn * c, dn * cell, d * th], 1) * slope, dn * i * (1 - np.abs(c)) ** 2], 1)
            g["x" + way] += (x[:, k] == np.arange(N_CLASSES)[:, None]).astype(np.float32) @ dz
            g["h" + way] += state.T @ dz
            ds, dc = dz @ u.T, dn * f

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tag paths y, and its gradients."""
        n, t = x.shape
        f, sf = self.run(x, "f")
        b, sb = self.run(x, "b")
        both = np.concatenate([f, b], 2)
        e = both @ self.p["o"] + self.p["ob"]
        trans = self.p["t"]
        weight = np.exp(trans.astype(np.float64))
        alpha, beta = np.zeros(e.shape), np.zeros(e.shape)
        alpha[0] = e[0]
        for k in range(1, t):
            top = alpha[k - 1].max(1, keepdims=True)
            alpha[k] = np.log(np.exp(alpha[k - 1] - top) @ weight) + top + e[k]
        for k in range(t - 2, -1, -1):
            ahead = beta[k + 1] + e[k + 1]
            top = ahead.max(1, keepdims=True)
            beta[k] = np.log(np.exp(ahead - top) @ weight.T) + top
        z = np.logaddexp.reduce(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        dt = np.zeros_like(weight)
        gold = np.zeros(n)
        rows = np.arange(n)
        for k in range(t):
            gold += e[k, rows, y[:, k]]
            de[k, rows, y[:, k]] -= 1
            if k:
                gold += trans[y[:, k - 1], y[:, k]]
                top = alpha[k - 1].max(1, keepdims=True)
                dt += weight * (np.exp(alpha[k - 1] - top).T @ np.exp(beta[k] + e[k] + top - z[:, None]))
                np.subtract.at(dt, (y[:, k - 1], y[:, k]), 1)
        de = (de / n).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["t"] = (dt / n).astype(np.float32)
        g["o"], g["ob"] = np.einsum("tnh,tnk->hk", both, de), de.sum((0, 1))
        d = de @ self.p["o"].T
        self.back(x, "f", sf, d[:, :, : self.hidden], g)
        self.back(x, "b", sb, d[:, :, self.hidden :], g)
        return float((z - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 96, rate: float = 0.03, seed: int = 1) -> Tagger:
        """Adam over shuffled batches; the same data and seed give the same model."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, steps = 0, max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                _, g = self.loss(x[rows], y[rows])
                step += 1
                norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
                for k, q in g.items():
                    q = q * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    self.p[k] = (self.p[k] - rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag path of each run of characters (time, tags); runs of like lengths pass together."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(runs)
        order = sorted(range(len(runs)), key=lambda k: -len(runs[k]))
        while order:
            n = max(1, min(len(order), 400_000 // len(runs[order[0]])))
            some, order = order[:n], order[n:]
            long = np.array([len(runs[k]) for k in some])
            e = np.zeros((long[0], n, N_TAGS), np.float32)
            for j, k in enumerate(some):
                e[: long[j], j] = runs[k]
            walk = Viterbi(self.p["t"], long)
            walk.feed(e)
            for k, path in zip(some, walk.paths(), strict=True):
                out[k] = path
        return out


class Viterbi:
    """The pass over runs, longest first (`long`: their lengths), fed with the emissions of one character of each at a time."""

    def __init__(self, trans: np.ndarray, long: np.ndarray) -> None:
        self.trans, self.long, self.t = trans, long, 0
        self.order = -long
        self.score = np.zeros((len(long), N_TAGS), np.float32)
        self.back = np.zeros((int(long[0]), len(long), N_TAGS), np.int8)

    def going(self, t: int) -> int:
        """Runs that have a character t."""
        return int(self.order.searchsorted(-t, "left"))

    def step(self, e: np.ndarray) -> None:
        """The next character of all runs that still have one."""
        m = len(e)
        if self.t:
            s = self.score[:m, :, None] + self.trans
            self.back[self.t, :m] = s.argmax(1)
            e = s.max(1) + e
        self.score[:m] = e - e.max(1, keepdims=True)  # only differences count; sums over a long text would lose them in rounding
        self.t += 1

    def feed(self, e: np.ndarray) -> None:
        """The next characters (time, run, tags)."""
        for x, m in zip(e, self.order.searchsorted(-np.arange(self.t, self.t + len(e)), "left").tolist(), strict=True):
            self.step(x[:m])

    def paths(self) -> list[np.ndarray]:
        """The best path of each run as far as it was fed, followed back."""
        last, tag = self.score.argmax(1), np.zeros(len(self.long), np.int64)
        path = np.zeros((self.t, len(self.long)), np.int8)
        for t in range(self.t - 1, -1, -1):
            on, m = self.going(t + 1) if t + 1 < self.t else 0, self.going(t)
            tag[:on] = self.back[t + 1, np.arange(on), tag[:on]] if on else tag[:on]
            tag[on:m] = last[on:m]
            path[t, :m] = tag[:m]
        return [path[:n, j] for j, n in enumerate(self.long)]


def tagged_spans(path: np.ndarray, start: int) -> list[tuple[int, int, int]]:
    tag = path.astype(np.int64)
    kind, before = (tag - 1) // 2, np.concatenate([[0], tag[:-1]])
    begins = (tag > 0) & ((before == 0) | (tag % 2 == 1) | ((before - 1) // 2 != kind))
    first, stops = np.flatnonzero(begins), np.append(np.flatnonzero(begins | (tag == 0)), len(tag))
    last = stops[np.searchsorted(stops, first, "right")]
    return list(zip(kind[first].tolist(), (start + first).tolist(), (start + last).tolist(), strict=True))


def plausible(kind: int, text: str) -> bool:
    """What a span of the model must hold to be personal data of its kind."""
    groups = re.findall("[0-9]+", text)
    digits = "".join(groups)
    if kind == 0:
        return len(text) >= 6 and len(text) <= 120 and len(_AT.findall(text)) == 1 and _POINT.search(text) is not None
    if kind == 1:
        return len(groups) == 4 and all(octet(g) for g in groups) and len(re.findall(r"[0-9][ \[({]{0,2}(?:\.| ?dot ?)[ \])}]{0,2}(?=[0-9])", text)) == 3
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 8 <= len(digits) <= 15 and len(groups) > 1 and len(text) <= 30
    return 16 <= len(text) <= 128 and bool(groups) and re.fullmatch(r"[A-Za-z0-9+/=_-]+", text) is not None and re.search("[A-Za-z]", text) is not None


def invented(kind: int, r: random.Random) -> tuple[str, int]:
    """A mark of the kind in one of its looser writings, and how many characters before it belong to its context."""
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(a, b)))
    if kind == 0:
        if r.random() < 0.5:
            at, dot = r.choice(["@", " @ ", "@ ", "(@)", " [@] "]), "."
        else:
            at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" at ", "."), ("[at]", ".")])
        name = letters(2, 9) + r.choice(["", "", dot, "_", "-"] if dot == "." else ["", "", dot]) + r.choice([letters(2, 8), number(r.randrange(1, 4))])
        host = r.choice([letters(3, 10), letters(3, 8) + number(1)]) + r.choice([dot + letters(2, 8), ""])
        return name + at + host + dot + r.choice(["com", "org", "net", "de", "io", "edu", letters(2, 4)]), 0
    if kind == 1:
        return r.choice([".", "[.]", "(.)", " . ", "[dot]", " dot "]).join(str(r.randrange(256)) for _ in range(4)), 0
    if kind == 2:
        body = number(15)
        c = next(body + str(k) for k in range(10) if luhn(body + str(k)))
        return r.choice(["", " ", "-", ".", "/", "_", " - "]).join(c[k : k + 4] for k in range(0, 16, 4)), 0
    if kind == 3:
        form = r.choice(["+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "+49 {} {}{}", "{} {} {}", "{}/{}-{}", "{}.{}.{}", "00{} {} {}", "({}){}-{}"])
        return form.format(number(3), number(3), number(4)), 0
    if kind == 4:
        name = r.choice(["token", "secret", "password", "api_key", "key", "access_token", "AUTH", letters(3, 9)])
        joint = r.choice([' = "', "=", ": ", " = ", ':"', "='"])
        lead = name + joint
        chars = r.choice(["0123456789abcdef", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789_-"])
        body = "".join(r.choice(chars) for _ in range(r.randrange(20, 45))) + number(1)
        return lead + body + ('"' if '"' in joint else "'" if "'" in joint else ""), len(lead)
    plain = r.randrange(6)  # what looks like one and is none
    if plain == 0:
        return "".join(r.choice("0123456789abcdef") for _ in range(40)), 0
    if plain == 1:
        return ".".join(number(r.randrange(1, 3)) for _ in range(r.choice([2, 3]))), 0
    if plain == 2:
        return f"{r.randrange(1900, 2100)}-{number(2)}-{number(2)}", 0
    if plain == 3:
        return f"{letters(2, 8)} at {letters(2, 8)} {r.choice(['dot', 'the', 'and'])} {letters(3, 8)}"[: r.randrange(8, 30)], 0
    if plain == 4:
        return f"{letters(3, 8)}{r.choice([' = ', ': ', '='])}{r.choice([letters(3, 12), number(r.randrange(1, 8))])}", 0
    return number(r.randrange(1, 14)), 0


def planted(t: str, kind: int, r: random.Random) -> tuple[str, int, int, int]:
    """A passage of t with an invented mark in it; the mark's start and end, and how far behind the start its span begins."""
    at = t.find(" ", r.randrange(len(t))) + 1
    mark, lead = invented(kind, r)
    text = t[:at][-80:] + mark + r.choice([" ", ". ", ", "]) + t[at:][:80]
    begin = min(at, 80)
    return text, begin, begin + len(mark.rstrip("\"'")) if kind == 4 else begin + len(mark), lead


def labelled(text: str) -> list[tuple[int, int, int]]:
    """Spans that the model learns from a text as it stands: the patterns', and long values assigned to names."""
    return base_spans(text) + [(4, *m.span(1)) for m in _SECRET.finditer(text) if plausible(4, m[1])]


def examples(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows with tags: around pattern matches, around the same kinds in looser writing, and plain ones with digits."""
    r = random.Random(seed)
    xs, ys = [], []

    def add(text: str, spans: list[tuple[int, int, int]], middle: int) -> None:
        a = max(0, min(len(text) - WINDOW, middle - r.randrange(8, WINDOW - 8)))
        n = WINDOW if r.random() > 0.2 else r.randrange(24, WINDOW)  # some windows end with their text
        part = text[a : a + n].ljust(WINDOW)
        y = np.zeros(WINDOW, np.int8)
        for k, s, e in spans:
            lo, hi = max(s - a, 0), min(e - a, n)
            if lo < hi:
                y[lo:hi] = 2 + 2 * k
                if s >= a:
                    y[lo] = 1 + 2 * k
        xs.append(classes(np.frombuffer(part.encode("utf-32-le", "replace"), "<u4")))
        ys.append(y)

    kept = [t for t in texts if t]
    for t in kept:
        spans = labelled(t)
        for s in r.sample(spans, min(len(spans), 4)):
            add(t, spans, r.randrange(s[1], s[2]))
        for m in list(_CUE.finditer(t))[:2]:
            add(t, spans, m.start())
        for kind in (r.randrange(len(KINDS)), r.choice((0, 4)), -1):
            text, begin, end, lead = planted(t, kind, r)
            mark = [(kind, begin + lead, end)] if kind >= 0 else []
            add(text, [s for s in labelled(text) if s[2] <= begin or s[1] >= end] + mark, r.randrange(begin, end))
    if not xs:
        return np.zeros((1, WINDOW), np.uint8), np.zeros((1, WINDOW), np.int8)
    return np.array(xs), np.array(ys)


def fit_tagger(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Tagger:
    """Fits on at most `rows` documents of at most `SAMPLE_CHARS` characters, those with the least hashes of their keys."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sample = bounded_sample(docs.select(F.col(key).alias("k"), t.alias("t")).filter(F.length("t") <= SAMPLE_CHARS), "k", rows, "t")
    x, y = examples([r.t for r in sample.collect()])
    return Tagger().fit(x, y)


def added_spans(texts: list[str], tagger: Tagger, every: bool = True) -> list[list[tuple[int, int, int]]]:
    """The model's spans of each text, by overlapping windows of all texts together. Without `every`, windows without cues are left out.

    Characters that are surely outside all spans part the text: the Viterbi pass goes over each stretch of `undecided` ones by
    itself, and together these are the best path over the whole text.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs: list[tuple[int, int, int, int, bool, bool]] = []  # text, windows, start, end, whether the run begins and ends here
    windows: list[np.ndarray] = []
    zero = np.where(np.arange(N_TAGS) > 0, -1e6, 0).astype(np.float32)[None]  # a character that is outside
    walks: dict[int, tuple[Viterbi, int]] = {}  # a stretch that goes on in the next part, and its start

    def accept(k: int, path: np.ndarray, start: int) -> None:
        for kind, a, b in tagged_spans(path, start) if path.any() else ():
            span = texts[k][a:b]  # without blanks and stops at its ends
            b -= len(span) - len(span.rstrip(" .,;:\n"))
            a += len(span) - len(span.lstrip(" .,;:\n"))
            if plausible(kind, texts[k][a:b]):
                out[k].append((kind, a, b))

    def read(x: np.ndarray, how: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The emissions of distinct windows (tag, character), the place of each window's characters in them, and their leads."""
        distinct, back = np.unique(x.view(np.dtype((np.void, x.shape[1]))).ravel(), return_inverse=True)
        distinct = distinct.view(np.uint8).reshape(-1, x.shape[1])
        e = how(distinct)
        time, n = e.shape[1:]
        lead = np.ascontiguousarray((e[1:].max(0) - e[0]).T)
        return e.reshape(N_TAGS, -1), back.astype(np.int32)[:, None] + np.arange(time, dtype=np.int32) * n, lead[back]

    jobs: list[tuple[int, int]] = []  # text and start of each stretch that waits for the Viterbi pass
    stretches: list[np.ndarray] = []

    def walk_all() -> None:
        """The pass over the stretches that wait: many at once, as each of its steps costs about the same for few as for many."""
        for (k, start), path in zip(jobs, tagger.decode(stretches), strict=True):
            accept(k, path, start)
        jobs.clear()
        stretches.clear()

    def decode() -> None:
        """Decodes the runs gathered so far; some thousand windows at a time bound the memory."""
        if not windows:
            return
        x = np.concatenate(windows)
        ends = np.cumsum([r[1] for r in runs])
        firsts = ends - [r[1] for r in runs]
        (e, at, lead), head, tail = read(x, tagger.emissions), read(x[firsts], lambda w: tagger.between(w, 0, CUT)), read(x[ends - 1], lambda w: tagger.between(w, CUT + STEP, WINDOW))
        e = np.concatenate([e, head[0], tail[0]], 1)
        head[1][:] += e.shape[1] - head[0].shape[1] - tail[0].shape[1]
        tail[1][:] += e.shape[1] - tail[0].shape[1]
        for j, (k, _, start, end, begins, stops) in enumerate(runs):
            place, ahead = (np.concatenate([head[i][j]] * begins + [(at, lead)[i - 1][firsts[j] : ends[j]].ravel()] + [tail[i][j]] * stops)[: end - start] for i in (1, 2))
            lo, hi = 0, len(place)
            sure = None if begins and stops else np.flatnonzero(tagger.outside(e[:, place]))
            if k in walks:  # goes on up to a character that is surely outside
                walk, first = walks[k]
                lo = int(sure[0]) if len(sure) else hi
                walk.feed(e[:, place[:lo]].T[:, None])
                if lo == hi and not stops:
                    continue
                if lo < hi:
                    walk.feed(zero[:, None])
                accept(k, walk.paths()[0], first)
                del walks[k]
                if lo == hi:
                    continue
            if not stops:  # what follows the last such character goes on in the next part
                hi = int(sure[-1]) + 1 if len(sure) else 0
                edge = [] if begins and not hi else [zero]
                walks[k] = Viterbi(tagger.p["t"], np.array([len(texts[k]) + WINDOW])), start + hi - len(edge)
                walks[k][0].feed(np.concatenate([*edge, e[:, place[hi:]].T])[:, None])
                if not hi:
                    continue
            whole = begins and lo == 0
            places = lo + np.flatnonzero(tagger.undecided(ahead[lo:hi], whole, stops))
            for some in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1) if len(places) else ():
                a, b = int(some[0]), int(some[-1]) + 1
                if not _HELD.search(texts[k], start + a, start + b):
                    continue  # whatever its spans are, none is accepted
                before, behind = [zero] * (a > lo or not whole), [zero] * (b < hi or not stops)
                jobs.append((k, start + a - len(before)))
                stretches.append(np.concatenate([*before, e[:, place[a:b]].T, *behind]))
        if sum(map(len, stretches)) >= WAITING:
            walk_all()
        runs.clear()
        windows.clear()

    held = 0
    for k, t in enumerate(texts):
        steps = np.arange(max(1, -(-len(t) // STEP) - 1) if t else 0)
        if not every:
            cues = np.array([m.start() // STEP for m in _CUE.finditer(t)], int)
            steps = np.intersect1d(steps, cues[:, None] + np.arange(-2, 2))
        if not len(steps):
            continue
        codes = classes(np.frombuffer(t.encode("utf-32-le", "replace"), "<u4"))
        padded = np.concatenate([codes, np.full(WINDOW, 14)]).astype(np.uint8)
        view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]
        for run in np.split(steps, np.flatnonzero(np.diff(steps) > 1) + 1):
            for a in range(0, len(run), HELD):  # a long run passes in parts
                part = run[a : a + HELD]
                begins, stops = a == 0, a + HELD >= len(run)
                if held + len(part) > HELD:
                    decode()
                    held = 0
                start, end = int(part[0]) * STEP + CUT * (not begins), min(len(t), int(part[-1]) * STEP + (WINDOW if stops else CUT + STEP))
                runs.append((k, len(part), start, end, begins, stops))
                windows.append(view[part])
                held += len(part)
    decode()
    walk_all()
    return [sorted(spans, key=lambda s: s[1]) for spans in out]


def without_overlaps(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of `more` that overlap no base span and no earlier one of `more`, in time linear in them but for sorting."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], [0, *accumulate((b for _, b in taken), max)]
    kept, end = [], 0
    for kind, a, b in sorted(more, key=lambda s: (s[1], -s[2], s[0])):
        if a >= reach[bisect_left(starts, b)] and a >= end:  # reach: the furthest end of base spans that start before b
            kept.append((kind, a, b))
            end = b
    return kept


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """One row per document row: counts and checksum of the base spans, and all spans as kind:start:end."""
    tagger = tagger or fit_tagger(docs, key, text)

    def spell(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for whole in batches:
            for a, z in row_slices(utf8(whole.column(1))[1], SLICE):
                b = whole.slice(a, z - a)
                texts = [t or "" for t in b.column(1).to_pylist()]
                rows = []
                for t, more in zip(texts, added_spans(texts, tagger), strict=True):
                    base = base_spans(t)
                    more = without_overlaps(base, more)
                    rows.append((*[sum(s[0] == k for s in base) for k in range(BASE_KINDS)], hashlib.sha256(spell(base).encode()).hexdigest(), spell(base + more), len(more), len(base) + len(more)))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [key, *names[1:]])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(job, SCHEMA.replace("doc_id", f"`{key}`", 1))


def mask_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """The same rows and columns, with every span in the text replaced by its kind in brackets; a null text stays null."""
    tagger = tagger or fit_tagger(docs, key, text)
    at = docs.columns.index(text)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, z in row_slices(utf8(whole.column(at))[1], SLICE):
                b = whole.slice(a, z - a)
                raw = b.column(at).to_pylist()
                texts, out = [t or "" for t in raw], []
                for t, more in zip(texts, added_spans(texts, tagger), strict=True):
                    spans, done, parts = base_spans(t), 0, []
                    spans += without_overlaps(spans, more)
                    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
                        if s >= done:
                            parts += [t[done:s], f"[{KINDS[k].upper()}]"]
                        done = max(done, e)
                    out.append("".join(parts) + t[done:])
                masked = pa.array([None if t is None else o for t, o in zip(raw, out, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([masked if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    numbered = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])  # names may have any characters
    return numbered.mapInArrow(job, numbered.schema).toDF(*docs.columns)
