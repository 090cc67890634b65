"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers; their spans stay. The network is trained in numpy
on spans of a labelled generator, and reads every character of every text, in windows that overlap. Emissions of a character
are averaged over its windows, and the best path of the CRF is found over each whole text (outside before and behind it), so
spans agree across windows. The search is exact and still short: where "outside" leads by more than any
transitions can win back, and where no run of characters around could win, the best path is outside, so paths are searched
only between such characters, in chunks whose transfer matrices are chained. A decoded span counts if it does not touch a pattern's span and holds what its kind cannot
be without (holds()). Secrets (keys and tokens) are a further label; report() gives their spans in a column of their own.

Memory is bounded by a step of text (STEP), and of a longer text by a block of windows plus the scores of its
characters that are not surely outside.

Defined cases: a null or empty text has no spans; positions are code points, ends exclusive; repeated documents are each
judged; an empty table gives no rows; further columns are kept only by mask()."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

KINDS = ("email", "ip", "card", "phone")
#: The labels of the network: the kinds, and keys and tokens.
LABELS = (*KINDS, "secret")

# --- the fixed patterns ----------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins at the start of its run of digits, so others need not be tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                end = m.end()
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- labelled spans --------------------------------------------------------------------------------------------------

#: Syllables of the generator's filler words.
SYLLABLES = "the and er on re he in ti es en ed th or st ar to nd at ha ou ent ing ion der die und ver sch ung ein le la de que ent re é è ñ ó ü ä ción".split()


class Generator:
    """Stretches of text with labelled spans."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, *xs):
        return xs[int(self.rng.integers(len(xs)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self) -> str:
        w = "".join(self.pick(*SYLLABLES) for _ in range(int(self.rng.integers(1, 4))))
        if self.rng.random() < 0.1:  # letters of any kind, other scripts included
            w = self.token("abcdefghijklmnopqrstuvwxyzàéîßøñ日本語кир한글😀", int(self.rng.integers(1, 30)))
        return self.pick(w, w, w, w, w.capitalize(), w.upper(), w.capitalize() + w) + self.pick("", "", "", "", "", ",", ".", "!!", "***", "%%%", "$$$", "&&&", "###")

    def token(self, alphabet: str, n: int) -> str:
        return "".join(self.pick(*alphabet) for _ in range(n))

    def positive(self) -> tuple[int, str, str, str]:
        """Kind, the text before the span, the span, the text behind it."""
        d, kind = self.digits, int(self.rng.integers(len(LABELS)))
        plain = lambda: "".join(self.pick(*SYLLABLES[:30]) for _ in range(2))
        before, behind = "", self.pick("", "", "", ",", ".", "!!", "###", "***", "$$$", ";", ")")
        if kind == 0:
            piece = self.pick(f"{plain()}.{d(2)}@mail{d(1)}.example.com", f"{plain()}@{plain()}.org", f"{plain()} @ {plain()}.com", f"{plain()}@{plain()}", f"{plain()}_{d(3)}@{plain()}.co.uk")
        elif kind == 1:
            q = lambda: str(int(self.rng.integers(1, 256)))
            piece = f"{q()}.{q()}.{q()}.{q()}"
        elif kind == 2:
            piece = self.pick(d(16), d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", d(15))
        elif kind == 3:
            piece = self.pick(f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}")
        else:
            hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
            piece = self.pick(self.token(hexes, 40), self.token(hexes, 40), self.token(hexes, 32), f"AKIA{self.token(mixed[:26] + mixed[52:], 16)}", f"ghp_{self.token(mixed, 36)}", f"sk_live_{self.token(mixed, 24)}", self.token(hexes, 40).upper())
            before = self.pick('token = "', 'token = "', "token: ", 'TOKEN = "', "key=", "api_key = '", "secret: ", "")
            behind = {'"': '"', "'": "'"}.get(before[-1:], "") + behind
        return kind, before, piece, behind

    def negative(self) -> str:
        d = self.digits
        return self.pick(f"19{d(2)}", f"20{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(2)},{d(3)}", f"${d(2)}.{d(2)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"20{d(2)}-1{d(1)}-0{d(1)}", f"19{d(2)}-0{d(1)}-2{d(1)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(2)}:{d(2)}", "4.0.", "2.0", "version 3.", f"{d(2)}%", f"{d(5)}", f"@{self.word()}", f"{d(8)}", f"{d(1)} {d(2)} {d(3)}", f"({d(4)})", f"{d(1)}. {d(2)}. {d(4)}", f"#{self.token('0123456789abcdef', 6)}", f"/{self.word()}/{d(4)}.html", "=" * 12, "-" * 9, "_" * 7, f"({self.word()})", f'"{self.word()}"', f"{self.word()} = {d(2)}")

    def stretch(self, least: int) -> tuple[str, np.ndarray]:
        """Text with the label of each character, 0 outside; some stretches are prose without any span."""
        text, tags, gap = "", [], self.pick(" ", " ", " ", " | ", "\n")
        share = self.pick(0.0, 0.08, 0.2, 0.2)
        while len(text) < least:
            roll = self.rng.random()
            kind, before, piece, behind = self.positive() if roll < share else (-1, "", self.negative() if roll < share + self.pick(0.04, 0.25) else self.word(), "")
            text += before + piece + behind + gap
            tags += [0] * len(before) + [kind + 1] * len(piece) + [0] * (len(behind) + len(gap))
        return text[:least], np.array(tags[:least])


# --- the network -----------------------------------------------------------------------------------------------------

EMBED, HIDDEN, TAGS = 10, 12, len(LABELS) + 1
#: Characters of a window, and of its overlap with the next; the last window of a text ends with it.
WINDOW, OVERLAP = 512, 32
STRIDE = WINDOW - OVERLAP
#: Bytes of text read at a time (or one longer text), windows whose scores are made at a time, and that step through the
#: network together: some 40 MB beside the text.
STEP, BLOCK, TOGETHER = 1 << 18, 512, 512
#: Steps whose scores are turned from tags and windows by step to steps by window and tag at a time.
TURNED = 32
#: Characters of a chunk of the search for the best path, and chunks searched together.
CHUNK, CHUNKS = 512, 512
#: Training: stretches and their length, rounds over them, batch, rate, seed.
STRETCHES, STRETCH, EPOCHS, BATCH, RATE, SEED = 2048, 112, 14, 64, 0.02, 11

#: Code of a character by the first byte of its UTF-8: ASCII as it is, 128 for Latin letters beyond, 129 for the rest.
_CODE = np.arange(256, dtype=np.uint8)
_CODE[128:] = 129
_CODE[0xC2:0xCA] = 128


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the characters of UTF-8 rows, and the rows' offsets in characters."""
    first = (data & 0xC0) != 0x80
    return _CODE[data[first]], np.concatenate(([0], np.cumsum(first)))[offsets]


def text_codes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return codes(data, np.array([0, len(data)]))[0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """x: (time, batch, in); gates in the order input, forget, output, candidate."""
    t, n, h = x.shape[0], x.shape[1], u.shape[0]
    pre = (x.reshape(t * n, -1) @ w + b).reshape(t, n, 4 * h)
    hidden, cell = np.zeros((n, h), x.dtype), np.zeros((n, h), x.dtype)
    out, tape = np.empty((t, n, h), x.dtype), []
    for i in range(t):
        z = pre[i] + hidden @ u
        s, g = sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
        before, cell = cell, s[:, h : 2 * h] * cell + s[:, :h] * g
        c = np.tanh(cell)
        tape.append((hidden, before, s, g, c))
        hidden = s[:, 2 * h :] * c
        out[i] = hidden
    return out, tape


def lstm_back(x: np.ndarray, w: np.ndarray, u: np.ndarray, tape: list, d_out: np.ndarray) -> tuple[np.ndarray, ...]:
    t, n, h = d_out.shape
    d_pre, d_u = np.empty((t, n, 4 * h), x.dtype), np.zeros_like(u)
    d_hidden, d_cell = np.zeros((n, h), x.dtype), np.zeros((n, h), x.dtype)
    for i in range(t - 1, -1, -1):
        hidden, before, s, g, c = tape[i]
        si, sf, so = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
        dh = d_out[i] + d_hidden
        dc = d_cell + dh * so * (1 - c * c)
        z = np.concatenate((dc * g * si * (1 - si), dc * before * sf * (1 - sf), dh * c * so * (1 - so), dc * si * (1 - g * g)), 1)
        d_pre[i] = z
        d_u += hidden.T @ z
        d_hidden, d_cell = z @ u.T, dc * sf
    flat = d_pre.reshape(t * n, -1)
    return (flat @ w.T).reshape(x.shape), x.reshape(t * n, -1).T @ flat, d_u, flat.sum(0)


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(a: int, b: int) -> np.ndarray:
        return (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)

    out = {"e": normal(130, EMBED), "v": normal(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
    for side in "fb":
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        out |= {f"w{side}": normal(EMBED, 4 * HIDDEN), f"u{side}": normal(HIDDEN, 4 * HIDDEN), f"b{side}": bias}
    return out


def emissions(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """x: (time, batch) codes; scores (time, batch, tag)."""
    e = p["e"][x]
    f, tape_f = lstm(e, p["wf"], p["uf"], p["bf"])
    r, tape_b = lstm(e[::-1], p["wb"], p["ub"], p["bb"])
    both = np.concatenate((f, r[::-1]), 2)
    return both @ p["v"] + p["c"], (e, tape_f, tape_b, both)


def crf_gradient(score: np.ndarray, move: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood by forward and backward sums."""
    t, n, k = score.shape

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[0] = score[0]
    for i in range(1, t):
        alpha[i] = score[i] + lse(alpha[i - 1][:, :, None] + move, 1)
    for i in range(t - 2, -1, -1):
        beta[i] = lse(move + (score[i + 1] + beta[i + 1])[:, None, :], 2)
    total = lse(alpha[-1], 1)
    d_score = np.exp(alpha + beta - total[None, :, None])
    pair = np.exp(alpha[:-1][:, :, :, None] + move + (score[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None])
    d_move = pair.sum((0, 1))
    at = np.arange(n)
    for i in range(t):
        d_score[i, at, tags[i]] -= 1
    np.subtract.at(d_move, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    return d_score / n, d_move / n


@lru_cache(1)
def weights() -> dict[str, np.ndarray]:
    """The trained network: Adam over generated stretches; the same on every machine up to rounding."""
    make, rng = Generator(SEED), np.random.default_rng(SEED)
    texts = [make.stretch(STRETCH) for _ in range(STRETCHES)]
    x, y = np.stack([text_codes(t) for t, _ in texts], 1).astype(np.int64), np.stack([g for _, g in texts], 1)
    p = start_weights(rng)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(STRETCHES)
        for low in range(0, STRETCHES, BATCH):
            pick = order[low : low + BATCH]
            score, (e, tape_f, tape_b, both) = emissions(p, x[:, pick])
            d_score, d_move = crf_gradient(score.astype(np.float64), p["t"].astype(np.float64), y[:, pick])
            d_score = d_score.astype(np.float32)
            flat = d_score.reshape(-1, TAGS)
            g = {"v": both.reshape(-1, 2 * HIDDEN).T @ flat, "c": flat.sum(0), "t": d_move.astype(np.float32)}
            d_both = d_score @ p["v"].T
            d_e, g["wf"], g["uf"], g["bf"] = lstm_back(e, p["wf"], p["uf"], tape_f, d_both[:, :, :HIDDEN])
            d_r, g["wb"], g["ub"], g["bb"] = lstm_back(e[::-1], p["wb"], p["ub"], tape_b, d_both[::-1, :, HIDDEN:])
            g["e"] = np.zeros_like(p["e"])
            np.add.at(g["e"], x[:, pick].ravel(), (d_e + d_r[::-1]).reshape(-1, EMBED))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + 0.002
            for k in p:
                d = np.clip(g[k], -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return p


# --- reading ---------------------------------------------------------------------------------------------------------


class Reader:
    """The network with windows side by side: the gates of a step are one product of a matrix with the hidden states, the
    embedded characters and a row of ones. They run through tanh alone, as sigmoid(x) = (1 + tanh(x / 2)) / 2; the last
    half is taken of the cells, and in the weights of the hidden states, which are kept doubled. Both are exact."""

    def __init__(self, p: dict[str, np.ndarray]):
        half = np.concatenate((np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN))).astype(np.float32)
        gates = lambda side: np.ascontiguousarray((np.concatenate((p[f"u{side}"] * np.float32(0.5), p[f"w{side}"], p[f"b{side}"][None])) * half).T)
        out = lambda v: np.ascontiguousarray(v.T * np.float32(0.5))
        self.sides = [(gates("f"), out(p["v"][:HIDDEN])), (gates("b"), out(p["v"][HIDDEN:]))]
        self.embedded = np.ascontiguousarray(p["e"].T)
        self.bias, self.move = p["c"], p["t"].astype(np.float32)
        t = p["t"].astype(np.float64)
        # what a path can win by transitions: by one character that is not outside, by each further one, and by a run's ends
        self.swing = max(float((t[:, [k]] + t[[k], :] - t[:, [0]] - t[[0], :]).max()) for k in range(1, TAGS))
        self.more = float(t[1:, 1:].max() - t[0, 0])
        self.ends = float(t[0, 1:].max() + t[1:, 0].max() - 2 * t[0, 0]) - self.more

    def _run(self, steps: np.ndarray, side: int) -> np.ndarray:
        """The scores of one direction, (window, tag, step), of the characters (step, window) in its order."""
        gates, v = self.sides[side]
        n, h = steps.shape[1], HIDDEN
        inputs = np.ones((h + EMBED + 1, n), np.float32)
        hidden, embedded = inputs[:h], inputs[h:-1]
        hidden[:] = 0
        cell, z, fresh = np.zeros((h, n), np.float32), np.empty((4 * h, n), np.float32), np.empty((h, n), np.float32)
        # turned a few steps at a time, while they are at hand
        out, some = np.empty((n, TAGS, len(steps)), np.float32), np.empty((TURNED, TAGS, n), np.float32)
        squashed, take, half = z[: 3 * h], self.embedded.take, np.float32(0.5)
        enter, forget, leave, new = z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
        for low in range(0, len(steps), TURNED):
            part = steps[low : low + TURNED].astype(np.intp)
            for t, now in enumerate(part):
                take(now, 1, embedded, "clip")
                np.matmul(gates, inputs, out=z)
                np.tanh(z, out=z)
                squashed += 1
                np.multiply(enter, new, out=fresh)
                cell *= forget
                cell += fresh
                cell *= half
                np.tanh(cell, out=hidden)
                hidden *= leave
                np.matmul(v, hidden, out=some[t])
            out[:, :, low : low + len(part)] = some[: len(part)].transpose(2, 1, 0)
        return out

    def scores(self, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first place, scores by place and tag) of consecutive parts of rows of characters."""
        size = np.diff(bounds)
        count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
        row = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = bounds[row] + np.minimum(nth * STRIDE, np.maximum(size[row] - WINDOW, 0))
        end = np.minimum(start + WINDOW, bounds[row + 1])
        for a, b in _shares(len(row), BLOCK):
            # windows before and behind reach into the part, which ends where the window behind begins
            first, last = a, b
            while first and nth[first] and end[first - 1] > start[a]:
                first -= 1
            low, high = int(start[first]), int(end[last - 1])
            total, seen = np.zeros((TAGS, high - low), np.float32), np.zeros(high - low + 1, np.int32)
            np.add.at(seen, start[first:last] - low, 1)
            np.add.at(seen, end[first:last] - low, -1)
            order = first + np.argsort(start[first:last] - end[first:last], kind="stable")  # windows of like length
            for k, m in _shares(len(order), TOGETHER):
                w = order[k:m]
                at, till = start[w], end[w]
                own = np.zeros((2, len(w), int(till[0] - at[0])), np.uint8)
                for j, (x, y) in enumerate(zip(at.tolist(), till.tolist(), strict=True)):
                    own[0, j, : y - x] = codes[x:y]
                    own[1, j, : y - x] = codes[x:y][::-1]
                forward, backward = self._run(np.ascontiguousarray(own[0].T), 0), self._run(np.ascontiguousarray(own[1].T), 1)
                for j, (x, y) in enumerate(zip((at - low).tolist(), (till - low).tolist(), strict=True)):
                    own = total[:, x:y]
                    own += forward[j, :, : y - x]
                    own += backward[j, :, : y - x][:, ::-1]
            total /= np.cumsum(seen[:-1]).astype(np.float32)
            total += self.bias[:, None]
            keep, stop = int(start[a]), int(start[b]) if b < len(row) and nth[b] else high
            yield keep, total[:, keep - low : stop - low].T

    def tags(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of characters, and their tags on the best paths of their rows; outside are all others."""
        places, kept = [np.zeros(0, np.int64)], [np.zeros((0, TAGS), np.float32)]
        for low, score in self.scores(codes, bounds):
            open_ = np.flatnonzero(_lead(score) >= -self.swing)
            places.append(open_ + low)
            kept.append(score[open_])
        place, score = np.concatenate(places), np.concatenate(kept)
        row = np.searchsorted(bounds, place, "right")
        heads = lambda: np.flatnonzero(np.concatenate(([True], (np.diff(place) > 1) | (np.diff(row) > 0)))[: len(place)])
        open_ = _best_run(_lead(score) + self.more, heads()) + self.ends >= 0
        place, score, row = place[open_], score[open_], row[open_]
        first = heads()
        return place, best_paths(score, self.move, first, np.diff(np.append(first, len(place))))


def _shares(n: int, most: int) -> Iterator[tuple[int, int]]:
    """Parts of so many, the last up to half as many more: a step through the network costs little less for few windows."""
    a = 0
    while a < n:
        b = n if n - a <= most + most // 2 else a + most
        yield a, b
        a = b


def _lead(score: np.ndarray) -> np.ndarray:
    """By how much the best tag that is not outside leads."""
    best = score[:, 1]
    for k in range(2, TAGS):
        best = np.maximum(best, score[:, k])
    return best - score[:, 0]


def _best_run(gain: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each character the largest sum of gains of a run of its segment that holds it."""
    n = len(gain)
    if not n:
        return gain
    gain, total = gain.astype(np.float64), np.empty(n)
    length = np.diff(np.append(first, n))
    np.cumsum(gain, out=total)
    total -= np.repeat(total[first] - gain[first], length)  # within the segment
    low, high = np.minimum(np.minimum.reduceat(total, first), 0), np.maximum.reduceat(total, first)
    # each segment lower than all that is before it: then least and largest sums of the whole are those of the segment
    base = np.concatenate(([0], np.cumsum(low[:-1] - np.maximum(high[1:], 0))))
    total += np.repeat(base, length)
    before = total - gain  # the sum in front of each character
    return np.maximum.accumulate(total[::-1])[::-1] - np.minimum.accumulate(before)


def _falling(length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of chunks, the longest first, and how many of each still run at each step."""
    order = np.argsort(-length, kind="stable")
    for k in range(0, len(order), CHUNKS):
        group = order[k : k + CHUNKS]
        yield group, np.searchsorted(-length[group], -np.arange(int(length[group[0]])), "left")


def best_paths(score: np.ndarray, move: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The tags of the best path of each segment of scores, from outside to outside. Segments are cut into chunks; those
    of more than one get the best sums from each tag before a chunk to each tag at its end, and are chained by them."""
    count = -(-length // CHUNK)
    segment = np.repeat(np.arange(len(first)), count)
    nth = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    start = first[segment] + nth * CHUNK
    size = np.minimum(CHUNK, first[segment] + length[segment] - start)
    tags, before, behind = len(move), np.zeros(len(segment), np.int64), np.full(len(segment), -1)  # behind: -1 is open
    many = np.flatnonzero(count[segment] > 1)
    if len(many):
        sums = np.empty((len(many), tags, tags), np.float32)
        for group, running in _falling(size[many]):
            own = many[group]
            best = move[None] + score[start[own]][:, None, :]
            for t in range(1, len(running)):
                m = running[t]
                best[:m] = (best[:m, :, :, None] + move).max(2) + score[start[own[:m]] + t][:, None, :]
            sums[group] = best
        at = 0
        while at < len(many):
            n = int(count[segment[many[at]]])
            value, came = np.where(np.arange(tags) == 0, 0.0, -np.inf), np.empty((n, tags), np.int64)
            for i in range(n):
                each = value[:, None] + sums[at + i]
                came[i], value = each.argmax(0), each.max(0)
            now = int((value + move[:, 0]).argmax())
            for i in range(n - 1, -1, -1):
                behind[many[at + i]], now = now, int(came[i, now])
                before[many[at + i]] = now
            at += n
    out = np.empty(len(score), np.int64)
    for own, running in _falling(size):
        best = move[before[own]] + score[start[own]]
        back = np.zeros((len(running), len(own), tags), np.int8)
        last = np.empty((len(own), tags), np.float32)
        for t in range(len(running)):
            m = running[t]
            if t:
                each = best[:m, :, None] + move
                back[t, :m], best = each.argmax(1), each.max(1) + score[start[own[:m]] + t]
            last[:m] = best
        now = np.where(behind[own] >= 0, behind[own], (last + move[:, 0]).argmax(1))
        for t in range(len(running) - 1, -1, -1):
            m = running[t]
            out[start[own[:m]] + t] = now[:m]
            now[:m] = back[t, np.arange(m), now[:m]]
    return out


def decode(p: dict[str, np.ndarray], texts: list[str]) -> list[np.ndarray]:
    """The tags of the characters of each text."""
    code, bounds = codes(*common.buffers(pa.array(texts, pa.string())))
    tags = np.zeros(len(code), np.int64)
    place, own = Reader(p).tags(code, bounds)
    tags[place] = own
    return np.split(tags, bounds[1:-1])


def holds(kind: int, piece: str) -> bool:
    """Whether a decoded span holds what its kind cannot be without. Check digits are not asked for: a card number with a
    misread digit is still somebody's."""
    digits = sum("0" <= c <= "9" for c in piece)
    if kind == 0:
        return 0 < piece.find("@") < len(piece) - 1
    if kind == 1:
        parts = piece.split(".")
        return len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 13 <= digits <= 19
    if kind == 3:
        return 7 <= digits <= 15
    return len(piece) >= 16 and " " not in piece


_EDGES = " \t\r\n,;\"'"


def examine(reader: Reader, column: pa.Array) -> list[tuple[list, list, list]]:
    """For each text its base spans, all spans of the kinds, and the spans of secrets, as (start, kind, end)."""
    data, offsets = common.buffers(column)
    code, bounds = codes(data, offsets)
    place, tag = reader.tags(code, bounds)
    place, tag = place[tag > 0], tag[tag > 0]
    row = np.searchsorted(bounds, place, "right") - 1
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(place) > 1) | (np.diff(tag) != 0) | (np.diff(row) != 0)))[: len(place)])
    last = np.append(cut[1:], len(place))[: len(cut)] - 1
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i, k, a, b in zip(row[cut].tolist(), tag[cut].tolist(), (place[cut] - bounds[row[cut]]).tolist(), (place[last] - bounds[row[cut]]).tolist(), strict=True):
        found.setdefault(i, []).append((a, k - 1, b + 1))
    # no pattern does without a digit or an at sign
    total = np.concatenate(([0], np.cumsum(_HOT[code])))[bounds]
    rows = sorted(set(np.flatnonzero(np.diff(total)).tolist()) | found.keys())
    out: list[tuple[list, list, list]] = [([], [], [])] * len(column)
    for i, text in zip(rows, column.take(pa.array(rows, pa.int64())).to_pylist(), strict=True):
        base = base_spans(text)
        every, secrets = set(base), []
        for a, kind, b in found.get(i, ()):
            while a < b and text[a] in _EDGES:
                a += 1
            while a < b and text[b - 1] in _EDGES:
                b -= 1
            if holds(kind, text[a:b]) and all(b <= s or a >= e for s, _, e in base):
                if kind < len(KINDS):
                    every.add((a, kind, b))
                else:
                    secrets.append((a, kind, b))
        out[i] = (base, sorted(every), secrets)
    return out


_HOT = np.isin(np.arange(256), list(b"0123456789@"))


def find(p: dict[str, np.ndarray], texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and all spans of the kinds."""
    return [(base, every) for base, every, _ in examine(Reader(p), pa.array(texts, pa.string()))]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{LABELS[k]}:{a}:{b}" for a, k, b in spans)


EMPTY = hashlib.sha256(b"").hexdigest()
OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, secrets string, n_private long"


def _report(p: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names = Reader(p), [x.split()[0] for x in OUT.split(", ")]
        for batch in batches:
            _, offsets = common.buffers(batch.column(1))
            for a, b in common.steps(offsets, STEP):
                own = examine(reader, batch.column(1).slice(a, b - a))
                counts = [[sum(k == kind for _, k, _ in base) for base, _, _ in own] for kind in range(len(KINDS))]
                hashes = [hashlib.sha256(joined(base).encode()).hexdigest() if base else EMPTY for base, _, _ in own]
                rest = [[joined(every) for _, every, _ in own], [len(every) for _, every, _ in own], [joined(x) for _, _, x in own], [len(every) + len(x) for _, every, x in own]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(rest[0], pa.string()), pa.array(rest[1], pa.int64()), pa.array(rest[2], pa.string()), pa.array(rest[3], pa.int64())], names)

    return run


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of OUT for each document: counts and digest of the base, all spans of the kinds and their number, the spans
    of secrets, and the number of both."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(common.tidy(_report(weights())), OUT)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by the kind that begins first."""
    out, end = [], 0
    for a, k, b in spans:
        if a >= end:
            out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _mask(p: dict[str, np.ndarray], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(p)
        for batch in batches:
            _, offsets = common.buffers(batch.column(at))
            for a, b in common.steps(offsets, STEP):
                part = batch.slice(a, b - a)
                spans = {i: every for i, (_, every, _) in enumerate(examine(reader, part.column(at))) if every}
                if spans:
                    texts = part.column(at).to_pylist()
                    for i, every in spans.items():
                        texts[i] = masked(texts[i], every)
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part

    return run


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data replaced by the name of its kind; `n_chars`, if there, is counted anew."""
    out = docs.mapInArrow(common.tidy(_mask(weights(), docs.columns.index(text))), docs.schema)
    return out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
