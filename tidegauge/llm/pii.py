"""Operator 8, personal data: fixed patterns, and a character-level bidirectional
LSTM with a CRF on top, trained in numpy from labelled spans.

The network reads every character of every text, in overlapping windows whose labels
are reconciled over the whole text: where two windows meet, each gives the labels of
its own half of the overlap. It is trained on what the fixed patterns find in a sample
of documents and on made-up sentences with personal data that no pattern lists:
addresses spelled out or obfuscated, national phone numbers beside a cue, disguised ip
addresses, card numbers with unusual separators.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

KINDS = ("email", "ip", "card", "phone")
WINDOW, OVERLAP = 512, 64
HIDDEN, EMBED = 10, 12
#: The network is trained on windows of so many characters, at most WINDOWS of each of at
#: most FIT_DOCS documents (those of smallest text hash), and on MADE_UP sentences.
FIT_WINDOW, FIT_DOCS, WINDOWS, MADE_UP = 96, 400, 12, 4000
#: Windows run through the network side by side.
BLOCK = 1024

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, str]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """As the pattern would find them, but without trying every start of a long run."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and _LOCAL_END.match(text[begin - 1]):
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        free = found.end() if found else at + 1
        if found:
            out.append((begin, free, "email"))
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    out = _emails(text)
    if _DIGITS.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def labelled_spans(text: str) -> list[Span]:
    """Base spans without overlaps: what the network learns from documents."""
    out: list[Span] = []
    for s in base_spans(text):
        if all(s[1] <= o[0] or s[0] >= o[1] for o in out):
            out.append(s)
    return sorted(out)


# --- the network -----------------------------------------------------------

N_CHARS = 104
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind


def char_numbers(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.full(len(code), 96)  # beyond ASCII
    plain = (code >= 32) & (code < 127)
    out[plain] = code[plain] - 32
    out[code < 32] = 97
    out[(code >= 0x2000) | (code >= 127) & (code < 0xC0)] = 99  # no letter, mostly
    return out


PAD = 98


def forbidden() -> np.ndarray:
    """Moves that can't be: to the inside of a kind from anything but that kind."""
    out = np.zeros((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = True
        out[[inside - 1, inside], inside] = False
    return out


@dataclass
class Network:
    p: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Windows (n, T) of character numbers -> scores (n, T, TAGS)."""
        n, size = x.shape
        states = []
        for d in ("f", "b"):
            w_in = self.p["embed"] @ self.p[d + "x"] + self.p[d + "0"]  # one row for each character
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            out = np.empty((size, n, HIDDEN), np.float32)
            steps = []
            for t in range(size) if d == "f" else range(size - 1, -1, -1):
                z = w_in[x[:, t]] + h @ self.p[d + "h"]
                s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                g = np.tanh(z[:, 3 * HIDDEN :])
                i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
                before = c
                c = f * c + i * g
                th = np.tanh(c)
                if keep is not None:
                    steps.append((t, i, f, o, g, before, th, h))
                h = o * th
                out[t] = h
            states.append(out)
            if keep is not None:
                keep.append(steps)
        both = np.concatenate(states, axis=2)
        if keep is not None:
            keep.append(both)
        return (both @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """``emissions`` of windows (T, n), as (TAGS, T, n), without what training needs."""
        size, n = x.shape
        p = self.p
        out = np.repeat(p["bias"].astype(np.float32)[:, None], size * n, axis=1)
        for k, d in enumerate("fb"):
            # sigmoid(a) = (tanh(a / 2) + 1) / 2, so one tanh serves all gates.
            half = np.repeat(np.float32([0.5, 1]), [3 * HIDDEN, HIDDEN])
            w_in, w_h = (np.ascontiguousarray(w.T) for w in ((p["embed"] @ p[d + "x"] + p[d + "0"]) * half, p[d + "h"] * half))
            # Gates are rows, so that each lies in one piece for all windows.
            h, c, th = (np.zeros((HIDDEN, n), np.float32) for _ in range(3))
            z, z_in = np.empty((4 * HIDDEN, n), np.float32), np.empty((4 * HIDDEN, n), np.float32)
            states = np.empty((size, HIDDEN, n), np.float32)
            gates, (i, f, o, g) = z[: 3 * HIDDEN], z.reshape(4, HIDDEN, n)
            for t in range(size) if d == "f" else range(size - 1, -1, -1):
                np.take(w_in, x[t], axis=1, out=z_in, mode="clip")
                np.matmul(w_h, h, out=z)
                z += z_in
                np.tanh(z, out=z)
                gates *= 0.5
                gates += 0.5
                c *= f
                i *= g
                c += i
                np.tanh(c, out=th)
                h = np.multiply(o, th, out=states[t])
            out += np.matmul(p["out"][k * HIDDEN : (k + 1) * HIDDEN].T, states).transpose(1, 0, 2).reshape(TAGS, -1)
        return out.reshape(TAGS, size, n)

    def spotted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (T, n) that the best path doesn't pass outside of all spans, and its
        tags there."""
        maybe, scores = self.doubtful(x)
        tags = self.best(scores)
        some = tags.any(axis=1)
        return maybe[some], tags[some]

    def doubtful(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (T, n) whose best path may pass through a span, and their scores. What
        one span can gain over staying outside is found kind by kind; a window in which no
        span can gain needs no search for the best path. (A span that follows another at
        once counts what it saves that one's end.)"""
        scores, moves = self.scores(x), self.moves() - self.p["moves"][0, 0]
        scores[1:] -= scores[0]
        out = moves[1:, 0]
        enter = np.maximum(moves[0, 1::2], (moves[1:, 1::2] - out[:, None]).max(axis=0))[:, None]
        b = np.arange(1, TAGS, 2)
        go, stay = moves[b, b + 1][:, None], moves[b + 1, b + 1][:, None]
        end_b, end_i = (np.maximum(out[k::2], 0)[:, None] for k in (0, 1))  # a text may end inside
        begun = held = np.full((len(KINDS), x.shape[1]), -1e4, np.float32)
        most = begun.copy()
        for t in range(len(x)):
            held = np.maximum(begun + go, held + stay)
            held += scores[2::2, t]
            begun = scores[1::2, t] + (np.maximum(enter, 0) if t == 0 else enter)
            np.maximum(most, begun + end_b, out=most)
            np.maximum(most, held + end_i, out=most)
        scores[1:] += scores[0]
        maybe = np.flatnonzero(most.max(axis=0) >= -1e-2)
        return maybe, np.ascontiguousarray(scores[:, :, maybe].transpose(2, 1, 0))

    def moves(self) -> np.ndarray:
        return np.where(forbidden(), np.float32(-1e4), self.p["moves"])

    def best(self, scores: np.ndarray) -> np.ndarray:
        """The most probable tags (Viterbi) for scores (n, T, TAGS)."""
        moves = self.moves()
        n, size, _ = scores.shape
        best = scores[:, 0].copy()
        best[:, 2::2] = -1e4
        back = np.zeros((size, n, TAGS), np.int8)
        for t in range(1, size):
            all_moves = best[:, :, None] + moves
            back[t] = all_moves.argmax(axis=1)
            best = np.take_along_axis(all_moves, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + scores[:, t]
        tags = np.empty((n, size), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(size - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-likelihood of the tags y."""
    p, keep = net.p, []
    scores, moves = net.emissions(x, keep), net.moves()
    n, size, _ = scores.shape
    fsteps, bsteps, both = keep

    def lse(v, axis):
        m = v.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(v - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0]
    alpha[:, 0, 2::2] -= 1e4
    for t in range(1, size):
        alpha[:, t] = lse(alpha[:, t - 1][:, :, None] + moves, 1) + scores[:, t]
    for t in range(size - 2, -1, -1):
        beta[:, t] = lse(moves + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    z = lse(alpha[:, -1], 1)
    d = np.exp(alpha + beta - z[:, None, None])
    rows = np.arange(n)
    g_moves = np.zeros_like(moves)
    for t in range(1, size):
        g_moves += np.exp(alpha[:, t - 1][:, :, None] + moves + (scores[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(g_moves, (y[:, t - 1], y[:, t]), -1)
    for t in range(size):
        d[rows, t, y[:, t]] -= 1
    d = d.transpose(1, 0, 2) / n
    g = {"moves": np.where(forbidden(), 0, g_moves / n), "out": np.einsum("tnh,tnk->hk", both, d), "bias": d.sum(axis=(0, 1)), "embed": np.zeros_like(p["embed"])}
    dh_all = d @ p["out"].T
    for name, steps, part in (("f", fsteps, slice(0, HIDDEN)), ("b", bsteps, slice(HIDDEN, None))):
        gx, gh, g0 = np.zeros_like(p[name + "x"]), np.zeros_like(p[name + "h"]), np.zeros_like(p[name + "0"])
        dh_next, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for t, i, f, o, gg, before, th, h_before in reversed(steps):
            dh = dh_all[t][:, part] + dh_next
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
            gh += h_before.T @ dz
            g0 += dz.sum(axis=0)
            gx += p["embed"][x[:, t]].T @ dz
            np.add.at(g["embed"], x[:, t], dz @ p[name + "x"].T)
            dh_next, dc = dz @ p[name + "h"].T, dc * f
        g |= {name + "x": gx, name + "h": gh, name + "0": g0}
    return g


def _tags(size: int, spans: list[Span], at: int = 0) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for a, b, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        lo, hi = max(0, a - at), min(size, b - at)
        if lo < hi:
            out[lo:hi] = k + 1
            out[lo] = k
    return out


def made_up(rng: np.random.Generator, n: int, words: list[str]) -> list[tuple[str, list[Span]]]:
    """Sentences of ``words`` with one labelled span of any kind, in forms that the fixed
    patterns know and in forms that they don't, or with what only looks like one."""

    def pick(*of):
        return of[rng.integers(len(of))]

    def word() -> str:
        return words[rng.integers(len(words))]

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(10, size=k)))

    def plain() -> str:
        return re.sub("[^a-z0-9]", "", word().lower())

    def name() -> str:
        return plain() + pick("", "", ".", "_") + pick(plain(), digits(2), "")

    out = []
    for _ in range(n):
        kind, cue = int(rng.integers(9)), ""
        host, end = plain() or "host", pick("com", "org", "net", "de", "io")
        user = name().strip("._") or "user"
        if kind == 0:
            x, label = f"{user}@{host}.{end}", "email"
        elif kind in (1, 2):
            at, dot = pick((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" AT ", " DOT "), (" (at) ", "."), ("[at]", "."), (" @ ", " . "))
            cue = pick("", "", "mail ", "write to ", "contact: ")
            x, label = f"{user}{at}{host}{dot}{end}", "email"
        elif kind == 3:
            dot = pick(".", "[.]", " . ", "(.)")
            x, label = dot.join(str(v) for v in rng.integers(256, size=4)), "ip"
        elif kind == 4:
            x, label = pick(" ", "-", ".", "/", "_").join(pick("4", "5", "37")[:1] + digits(3) if i == 0 else digits(4) for i in range(4)), "card"
        elif kind == 5:
            x, label = pick(f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(6)}"), "phone"
        elif kind == 6:
            cue = pick("call ", "tel ", "tel. ", "phone: ", "phone ", "fax ", "mobile ")
            x, label = pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(3)}/{digits(6)}", f"{digits(3)}-{digits(3)}-{digits(4)}"), "phone"
        elif kind == 7:
            x = pick(digits(int(rng.integers(1, 8))), f"{digits(1)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{word()}{digits(3)}", f"{digits(2)},{digits(3)},{digits(3)}")
            if rng.random() < 0.4:  # keys and hashes
                x = pick('"', "", "") + "".join("0123456789abcdef"[i] for i in rng.integers(16, size=int(rng.integers(8, 41))))
            label = None
        else:
            x, label = pick(f"{word()} at {word()}", f"{word()} dot {word()}", f"at {word()} {word()}", f"the {word()} at the {word()}.", f"{word()} (and {word()})", f"@{word()}", f"[{word()}]", " ".join([word()] * int(rng.integers(2, 12))), f"{word()}. {word()[:2]} {word()}. {word()}"), None
        before = " ".join(word() for _ in range(rng.integers(0, 9))) + pick(" ", " ", "\n", ": ") + cue
        text = before + x + pick(" ", " ", ", ", ". ", "\n", "") + " ".join(word() for _ in range(rng.integers(0, 9)))
        out.append((text, [(len(before), len(before) + len(x), label)] if label else []))
    return out


def fit_windows(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Characters and tags of at most WINDOWS windows of a document: around base spans,
    spread over all of them, and then anywhere, spread over the text."""
    spans = labelled_spans(text)
    near = spans[:: max(1, -(-len(spans) * 2 // WINDOWS))]
    starts = [(a + b - FIT_WINDOW) // 2 + (13 * i) % 31 - 15 for i, (a, b, _) in enumerate(near)]
    free = WINDOWS - len(starts)
    starts += [i * max(1, len(text) - FIT_WINDOW) // free for i in range(free)]
    numbers = char_numbers(text)
    return [(_window(numbers, at), _tags(FIT_WINDOW, spans, at)) for at in dict.fromkeys(starts)] if text else []


def _window(numbers: np.ndarray, at: int) -> np.ndarray:
    out = np.full(FIT_WINDOW, PAD)
    a, b = max(at, 0), min(at + FIT_WINDOW, len(numbers))
    if a < b:
        out[a - at : b - at] = numbers[a:b]
    return out


def train(windows: list[tuple[np.ndarray, np.ndarray]], words: list[str], steps: int = 800, batch: int = 64, seed: int = 5) -> Network:
    """Adam on labelled windows of documents and on made-up sentences of their ``words``,
    half of each batch from either."""
    rng = np.random.default_rng(seed)
    sentences = [(_window(char_numbers(t), at), _tags(FIT_WINDOW, spans, at)) for t, spans in made_up(rng, MADE_UP, words or ["word"]) for at in [int(rng.integers(-8, max(1, len(t) - FIT_WINDOW // 2)))]]
    x, y = (np.stack([w[i] for w in sentences + windows]) for i in (0, 1))
    known = len(sentences)

    def init(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * np.sqrt(1 / shape[0])).astype(np.float32)

    p = {"embed": init(N_CHARS, EMBED) * 3, "out": init(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS, TAGS), np.float32)}
    for d in "fb":
        p |= {d + "x": init(EMBED, 4 * HIDDEN), d + "h": init(HIDDEN, 4 * HIDDEN), d + "0": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)}
    net = Network(p)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        rows = rng.integers(known, size=batch // 2)
        rows = np.concatenate([rows, rng.integers(known, len(x), size=batch - batch // 2) if len(x) > known else rows])
        rate = 0.02 * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for k, g in _gradients(net, x[rows], y[rows]).items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


# --- whole texts -----------------------------------------------------------


def window_starts(size: int) -> list[int]:
    """Starts of overlapping windows over a text; the last one ends with it."""
    if size <= WINDOW:
        return [0] if size else []
    return [*range(0, size - WINDOW, WINDOW - OVERLAP), size - WINDOW]


def reconciled(text: str, starts: list[int], tags: dict[int, np.ndarray]) -> list[Span]:
    """Spans of the whole text from the tags of its windows (by place in ``starts``;
    others lie outside of all spans). Windows that overlap share the overlap by halves."""
    label = np.zeros(len(text), np.int8)
    for k, row in tags.items():
        a = starts[k]
        low = 0 if k == 0 else (starts[k - 1] + WINDOW + a) // 2
        high = len(text) if k == len(starts) - 1 else (a + WINDOW + starts[k + 1]) // 2
        label[low:high] = row[low - a : high - a]
    out, at = [], 0
    places = np.flatnonzero(label)
    while at < len(places):
        begin = end = int(places[at])
        kind = (label[begin] - 1) // 2
        at += 1
        while at < len(places) and places[at] == end + 1 and label[end + 1] == 2 + 2 * kind:
            end, at = end + 1, at + 1
        stretch = text[begin : end + 1]
        if found := stretch.strip():
            begin += len(stretch) - len(stretch.lstrip())
            out.append((begin, begin + len(found), KINDS[kind]))
    return out


def find_all(texts: list[str], net: Network) -> list[tuple[list[Span], list[Span]]]:
    """For each text: base spans, and all spans. The network's spans are added where
    they overlap no base span. What a text gives doesn't depend on the others."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    numbers = np.append(char_numbers("".join(texts)).astype(np.uint8), np.full(WINDOW, PAD, np.uint8))
    starts = [window_starts(len(t)) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in starts])
    place = np.array([a for x in starts for a in x], np.int64)
    first = np.concatenate([[0], np.cumsum([len(x) for x in starts])])
    found: dict[int, dict[int, np.ndarray]] = {}
    windows, scores = [], []  # that wait for the search for their best paths

    def search() -> None:
        for k, tags in zip(np.concatenate(windows).tolist(), net.best(np.concatenate(scores)), strict=True):
            if tags.any():
                i = int(owner[k])
                found.setdefault(i, {})[k - int(first[i])] = tags
        windows.clear()
        scores.clear()

    for at in range(0, len(place), BLOCK):
        own, a = owner[at : at + BLOCK], place[at : at + BLOCK]
        index = (begins[own] + a)[None, :] + np.arange(WINDOW)[:, None]
        x = np.where(index < (begins + sizes)[own], numbers[np.minimum(index, len(numbers) - 1)], PAD)
        maybe, some = net.doubtful(x)
        windows.append(at + maybe)
        scores.append(some)
        if sum(map(len, windows)) >= BLOCK or at + BLOCK >= len(place):
            search()
    out = []
    for i, text in enumerate(texts):
        base = base_spans(text)
        spans = list(base)
        for s in reconciled(text, starts[i], found[i]) if i in found else []:
            if all(s[1] <= b[0] or s[0] >= b[1] for b in base):
                spans.append(s)
        out.append((base, sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def learn(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Network:
    """Trained on at most WINDOWS windows of each of at most ``fit_docs`` documents, those
    of smallest text hash, and on made-up sentences of their words. Texts are not
    collected: the hashes are chosen first, and executors cut the windows.

    Null and empty texts give no windows, equal texts count once, and an empty table
    leaves the made-up sentences.
    """
    texts = docs.select(F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text")).where("text <> ''")
    chosen = texts.select("h").distinct().orderBy("h").limit(fit_docs)

    def kernel(batch: pa.RecordBatch) -> dict[str, object]:
        rows = []
        for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = " ".join(text[:4000].split()[:40])
            rows.append((h, np.stack([np.stack(w) for w in fit_windows(text)]).astype(np.uint8).tobytes(), words))
        return dict(zip(("h", "windows", "words"), map(list, zip(*rows, strict=True)), strict=True))

    rows = map_batches(texts.join(F.broadcast(chosen), "h"), kernel, "h long, windows binary, words string", 1).dropDuplicates(["h"]).orderBy("h").collect()
    windows = [(w[0].astype(np.int64), w[1].astype(np.int64)) for r in rows for w in np.frombuffer(r.windows, np.uint8).reshape(-1, 2, FIT_WINDOW)]
    return train(windows, sorted({w[:20] for r in rows for w in r.words.split()}))


def personal_data(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    The counts and the hash are of the fixed patterns' spans, ``spans`` lists those
    and the network's, by start and then kind, as kind:start:end in code points.
    The patterns and the network read the whole text; null and empty texts have no spans. Null ids,
    repeated rows and extra columns change nothing; an empty table gives none. Rows
    are searched where they are read; only the weights travel.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> dict[str, object]:
        found = find_all([x or "" for x in batch.column(1).to_pylist()], shared.value)
        counts = {f"n_{k}": [sum(s[2] == k for s in base) for base, _ in found] for k in KINDS}
        return {"doc_id": batch.column(0)} | counts | {"base_sha256": [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found], "spans": [listed(s) for _, s in found]}

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_batches(slim, kernel, schema, 1)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data(docs, learn(docs))
