"""Personal data in texts: fixed patterns for addresses and numbers, a linear-chain CRF for the rest.

Patterns (kinds ``email ip card phone``) run over the UTF-8 bytes in linear time. The CRF adds the
kinds ``name address id``: its features are word shapes and a short lexicon of cue words, each of the
word itself and its two neighbours. It is trained on the driver from ``labelled_table()``, some hundred
generated sentences, and decoded by Viterbi over batches of token runs in numpy. Tokens whose margin
for "outside" exceeds all that their transitions can weigh are outside on every best path; only the
runs between them are decoded, which changes no result.

A null text is empty. Each row is judged alone: repeats and ties need no rule. Whole texts are read,
in slices of rows; one very long text is a slice of its own. Positions are in code points.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.common import Reach, text_slices

BASE_KINDS = ("email", "ip", "card", "phone")
CRF_KINDS = ("name", "address", "id")
TAGS = ("O", *(f"{p}-{k}" for k in CRF_KINDS for p in "BI"))

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)

Span = tuple[str, int, int]


def _emails(text: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain; each @ is looked at once, so long runs cost no more."""
    done = 0
    at = text.find(b"@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find(b"@", max(at + 1, done))


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: bytes) -> list[Span]:
    """Byte spans of the fixed patterns, by kind as listed, then start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip(b"0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m.group().split(b".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().translate(None, b" -")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if b"+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(m.group().translate(None, _NOT_DIGIT)) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- the CRF -----------------------------------------------------------------------------------

#: Words that hint at a neighbour's kind.
CUES = ("my", "name", "is", "mr", "mrs", "ms", "dr", "dear", "contact", "called", "signed", "sincerely", "regards", "by", "from", "lives", "live", "at", "address", "residing", "ship", "to", "street", "st", "road", "rd", "avenue", "ave", "lane", "drive", "square", "passport", "ssn", "iban", "licence", "id", "number", "no", "tax", "account", "born", "and", "in", "on", "the", "of")
_FIRST = ("Anna", "Bruno", "Carla", "David", "Elena", "Felix", "Greta", "Hugo", "Irene", "Jonas", "Karin", "Lukas", "Maria", "Nils", "Olga", "Pedro")
_LAST = ("Smith", "Keller", "Moreau", "Garcia", "Brown", "Novak", "Rossi", "Lind", "Weber", "Dubois", "Costa", "Young", "Hall", "King")
_STREETS = ("Oak", "Mill", "Station", "Park", "Church", "High", "Bridge", "Garden")
_SYLLABLES = ("the", "ti", "on", "er", "an", "re", "ou", "sh", "en", "la", "de", "es", "ion", "wh", "or", "ble", "st", "in", "pa", "qu")

#: Shapes: 0 edge of the text, 1 lower case, 2 capitalised, 3 upper case, 4 digits, 5 nnn-nn-nnnn,
#: 6 letters and digits of 6 or more with 4 digits, 7 other with digits, 8 mixed case, 9 none of these,
#: 10 one capital letter, 11 capitalised at the start of a sentence.
SHAPES = 12
_SSN = re.compile(rb"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_TAIL = b".,;:!?)]}\"'"
_KIND = np.full(256, 4, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 other, 5 above ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 5
_KIND[[32, 9, 10, 11, 12, 13]] = 3
_IS_TAIL = np.isin(np.arange(256), np.frombuffer(_TAIL, np.uint8))
_LONGEST_CUE = max(map(len, CUES))
_CUE_KEYS = np.array([sum((c & 31) << (5 * j) for j, c in enumerate(w.encode())) for w in CUES], np.int64)
_CUE_IDS = np.argsort(_CUE_KEYS) + 1
_CUE_KEYS = _CUE_KEYS[_CUE_IDS - 1]


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of white-space words, without closing punctuation (a word of it alone stays)."""
    blank = np.concatenate(([True], _KIND[data] == 3, [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[0::2], edge[1::2].copy()
    for _ in range(3):
        cut = (ends - starts > 1) & _IS_TAIL[data[ends - 1]]
        if not cut.any():
            break
        ends[cut] -= 1
    return starts, ends


def _classes(text: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape and cue (0: none) of each token."""
    kind = _KIND[data]
    size = ends - starts
    upto = [np.concatenate(([0], np.cumsum(kind == k, dtype=np.int32))) for k in (0, 1, 2, 5)]
    low, up, dig, high = ((c[ends] - c[starts]) for c in upto)
    first_up = kind[starts] == 1
    shape = np.full(len(starts), 9, np.int64)
    letters = low + up + high
    shape[(letters > 0) & (up == 0) & (dig == 0)] = 1
    shape[(up > 0) & (dig == 0)] = 8
    shape[first_up & (up == 1) & (letters > 1) & (dig == 0)] = 2
    shape[(up > 1) & (low + high == 0) & (dig == 0)] = 3
    shape[(size == 1) & first_up] = 10
    opens = np.ones(len(starts), bool)
    opens[1:] = np.isin(data[np.maximum(starts[1:] - 2, 0)], (33, 46, 58, 63)) | (data[starts[1:] - 1] == 10)
    shape[(shape == 2) & opens] = 11
    shape[dig > 0] = 7
    shape[(dig > 0) & (dig == size)] = 4
    shape[(dig >= 4) & (up > 0) & (low == 0) & (up + dig == size) & (size >= 6)] = 6
    for i in np.flatnonzero((dig == 9) & (size == 11)):
        if _SSN.fullmatch(text, starts[i], ends[i]):
            shape[i] = 5
    return shape, _cues(data, starts, size, (letters == size) & (high == 0))


def _cues(data: np.ndarray, starts: np.ndarray, size: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Number of the cue word that each token is, 0 for none: five bits of each letter make its key."""
    cue = np.zeros(len(starts), np.int64)
    short = np.flatnonzero(plain & (size <= _LONGEST_CUE))
    key = np.zeros(len(short), np.int64)
    at, n = starts[short], size[short]
    padded = np.concatenate((data, np.zeros(_LONGEST_CUE, np.uint8)))
    for j in range(_LONGEST_CUE):
        key |= np.where(j < n, (padded[at + j] & 31).astype(np.int64), 0) << (5 * j)
    place = np.searchsorted(_CUE_KEYS, key)
    place[place == len(_CUE_KEYS)] = 0
    cue[short] = np.where(_CUE_KEYS[place] == key, _CUE_IDS[place], 0)
    return cue


def labelled_table(seed: int = 11, n: int = 600) -> list[tuple[str, list[Span]]]:
    """(sentence, spans by characters): half with personal data, half without, from fixed parts."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def word() -> str:
        return "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4))))

    def prose(k: int) -> list[tuple[str, str | None]]:
        style = int(rng.integers(7))
        out: list[tuple[str, str | None]] = []
        if style == 1:
            return [(pick((word(), pick(CUES))).capitalize(), None)] * k
        for i in range(k):
            w = word() if rng.random() < 0.75 else pick(CUES)
            w = w.upper() if style == 0 else w.capitalize() if i == 0 or rng.random() < 0.12 else w
            if rng.random() < 0.06:
                w = pick((str(rng.integers(10**6)), f"{word()}{rng.integers(99)}", str(rng.integers(10**15, 10**16)), f"{rng.integers(255)}.{rng.integers(255)}.{rng.integers(255)}.{rng.integers(255)}"))
            out.append((w + pick(("", "", "", "", ",", ".", "***", "!!")), None))
        return out

    def person() -> list[tuple[str, str | None]]:
        full = [pick(_FIRST), pick(_LAST)] if rng.random() < 0.7 else [pick((word(), word())).capitalize(), word().capitalize()]
        return [(w, "name") for w in full]

    def place() -> list[tuple[str, str | None]]:
        return [(str(rng.integers(1, 400)), "address"), (pick(_STREETS), "address"), (pick(("Street", "Road", "Avenue", "Lane", "Drive", "Square")), "address")]

    def number() -> list[tuple[str, str | None]]:
        return [(pick((f"{rng.integers(100, 999)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}", f"{pick('ABCDEFGH')}{rng.integers(10**7, 10**8)}", f"{pick(('DE', 'FR', 'ES'))}{rng.integers(10**17, 10**18)}")), "id")]

    plain = lambda s: [(w, None) for w in s.split()]
    makers = (
        lambda: plain("My name is") + person(),
        lambda: plain(pick(("Mr", "Mrs", "Ms", "Dr"))) + person(),
        lambda: plain("Dear") + person(),
        lambda: plain("Signed by") + person(),
        lambda: plain("contact") + person(),
        lambda: plain(pick(("I live at", "lives at", "residing at", "address is", "ship to"))) + place(),
        lambda: plain(pick(("passport number", "SSN", "IBAN", "tax id", "account no", "licence number"))) + number(),
    )
    table = []
    for i in range(n):
        parts = prose(int(rng.integers(2, 9))) + (pick(makers)() if i % 2 else []) + prose(int(rng.integers(1, 7)))
        at, spans, words = 0, [], []
        for w, kind in parts:
            if kind and spans and spans[-1][0] == kind and spans[-1][2] == at - 1:
                spans[-1] = (kind, spans[-1][1], at + len(w))
            elif kind:
                spans.append((kind, at, at + len(w)))
            words.append(w)
            at += len(w) + 1
        table.append((" ".join(words), spans))
    return table


def _context(x: np.ndarray, edges: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the tokens before and after; ``edge`` at each first and last token of a text."""
    before, after = np.roll(x, 1), np.roll(x, -1)
    before[edges[:-1][edges[:-1] < len(x)]] = edge
    after[edges[1:][edges[1:] > 0] - 1] = edge
    return before, after


class Crf:
    """Weights of shape and cue features of a token and its neighbours, and of transitions."""

    def __init__(self, weights: list[np.ndarray], moves: np.ndarray):
        self.weights, self.moves = weights, moves
        #: What tag y can gain over O by its transitions: from any tag before, and to any tag after.
        self.gain_in, self.gain_out = moves - moves[:, :1], (moves - moves[:1]).T

    def scores(self, shape: np.ndarray, cue: np.ndarray, edges: np.ndarray) -> np.ndarray:
        s, c = _context(shape, edges, 0), _context(cue, edges, 0)
        out = self.weights[0][shape]
        for w, x in zip(self.weights[1:], (cue, s[0], s[1], c[0], c[1]), strict=True):
            out += w[x]
        return out

    def surely_outside(self, scores: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Tokens that are O on every best path: no other tag's score and gains reach that of O.

        What is sure narrows the gains of its neighbours, so this is repeated while it helps.
        """
        lag = scores[:, :1] - scores
        sure = (lag[:, 1:] > (self.gain_in.max(axis=0) + self.gain_out.max(axis=0))[1:]).all(axis=1)
        at_start, at_end = np.zeros(len(scores) + 1, bool), np.zeros(len(scores) + 1, bool)
        at_start[edges[:-1]] = True
        at_end[edges[1:]] = True
        before, after = self.gain_in.max(axis=0), self.gain_out.max(axis=0)
        for _ in range(4):
            left = np.flatnonzero(~sure)
            if not len(left):
                break
            calm_in = at_start[left] | sure[left - 1]
            calm_out = at_end[left + 1] | sure[np.minimum(left + 1, len(sure) - 1)]
            most = np.where(calm_in[:, None], self.gain_in[0], before) + np.where(calm_out[:, None], self.gain_out[0], after)
            now = (lag[left, 1:] > most[:, 1:]).all(axis=1)
            if not now.any():
                break
            sure[left[now]] = True
        return sure

    def decode(self, scores: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Best tag of each token; runs between sure O tokens and text edges are decoded together."""
        tags = np.zeros(len(scores), np.int8)
        open_ = ~self.surely_outside(scores, edges)
        head = open_.copy()
        head[1:] &= ~open_[:-1]
        inner = edges[1:-1]
        inner = inner[inner < len(scores)]
        head[inner] |= open_[inner]
        starts = np.flatnonzero(head)
        if not len(starts):
            return tags
        stop = ~open_
        stop[inner] = True
        stops = np.append(np.flatnonzero(stop), len(scores))
        ends = stops[np.searchsorted(stops, starts, "right")]
        sizes = ends - starts
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            longest = sizes[order[min(len(order), at + 4096) - 1]]
            group = order[at : at + max(1, min(4096, (1 << 18) // int(longest)))]
            at += len(group)
            self._viterbi(scores, starts[group], sizes[group], tags)
        return tags

    def _viterbi(self, scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tags: np.ndarray) -> None:
        steps, moves = int(sizes.max()), self.moves
        best = scores[starts] + moves[0]
        back = np.zeros((steps, len(starts), len(TAGS)), np.int8)
        for t in range(1, steps):
            on = np.flatnonzero(sizes > t)
            options = best[on][:, :, None] + moves[None]
            back[t, on] = options.argmax(axis=1)
            best[on] = options.max(axis=1) + scores[starts[on] + t]
        now = (best + moves[:, 0]).argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            on = np.flatnonzero(sizes > t)
            tags[starts[on] + t] = now[on]
            now[on] = back[t, on, now[on]]


def _encode(table: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shapes, cues, tags and text edges of a labelled table's tokens."""
    shapes, cues, tags, edges = [], [], [], [0]
    for text, spans in table:
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        starts, ends = _tokens(data)
        shape, cue = _classes(raw, data, starts, ends)
        tag = np.zeros(len(starts), np.int64)
        for kind, a, b in spans:
            inside = np.flatnonzero((starts >= a) & (starts < b))
            tag[inside] = TAGS.index(f"I-{kind}")
            tag[inside[:1]] = TAGS.index(f"B-{kind}")
        shapes.append(shape)
        cues.append(cue)
        tags.append(tag)
        edges.append(edges[-1] + len(starts))
    return np.concatenate(shapes), np.concatenate(cues), np.concatenate(tags), np.array(edges)


def train(table: list[tuple[str, list[Span]]], rounds: int = 200, rate: float = 0.2, ridge: float = 2e-4, ridge_moves: float = 2e-2) -> Crf:
    """Maximum likelihood with ridges (transitions are held smaller, so that more tokens are surely outside), by forward-backward over all sentences at once; deterministic."""
    shape, cue, gold, edges = _encode(table)
    k, sizes = len(TAGS), np.diff(edges)
    inputs = [shape, cue, *_context(shape, edges, 0), *_context(cue, edges, 0)]
    dims = [SHAPES, len(CUES) + 1, SHAPES, SHAPES, len(CUES) + 1, len(CUES) + 1]
    params = [np.zeros((d, k)) for d in dims] + [np.zeros((k, k))]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    longest, starts = int(sizes.max()), edges[:-1]
    one = np.eye(k)[gold]
    true_moves = np.zeros((k, k))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        path = np.concatenate(([0], gold[a:b], [0]))
        np.add.at(true_moves, (path[:-1], path[1:]), 1)
    for step in range(1, rounds + 1):
        score = sum(p[x] for p, x in zip(params, inputs, strict=False))
        moves = params[-1]
        peak = moves.max()
        e_moves = np.exp(moves - peak)
        forward = np.zeros((longest, len(sizes), k))
        backward = np.ones((longest, len(sizes), k))
        emit = np.exp(score - score.max(axis=1, keepdims=True))
        for t in range(longest):
            on = np.flatnonzero(sizes > t)
            f = (forward[t - 1, on] @ e_moves if t else np.repeat(e_moves[:1], len(on), 0)) * emit[starts[on] + t]
            forward[t, on] = f / f.sum(axis=1, keepdims=True)
        for t in range(longest - 1, -1, -1):
            last = np.flatnonzero(sizes == t + 1)
            backward[t, last] = e_moves[:, 0]
            on = np.flatnonzero(sizes > t + 1)
            if len(on):
                b = (backward[t + 1, on] * emit[starts[on] + t + 1]) @ e_moves.T
                backward[t, on] = b / b.sum(axis=1, keepdims=True)
        expected, want = np.zeros_like(one), np.zeros((k, k))
        for t in range(longest):
            on = np.flatnonzero(sizes > t)
            both = forward[t, on] * backward[t, on]
            expected[starts[on] + t] = both / both.sum(axis=1, keepdims=True)
            if t:
                pair = forward[t - 1, on][:, :, None] * e_moves[None] * (backward[t, on] * emit[starts[on] + t])[:, None, :]
                want += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        want[0] += expected[starts].sum(axis=0)
        want[:, 0] += expected[edges[1:] - 1].sum(axis=0)
        grads = []
        for p, x in zip(params, inputs, strict=False):
            g = np.zeros_like(p)
            np.add.at(g, x, one - expected)
            grads.append(g / len(sizes) - ridge * p)
        grads.append((true_moves - want) / len(sizes) - ridge_moves * moves)
        for p, g, m, v in zip(params, grads, mean, var, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf([p.astype(np.float32) for p in params[:-1]], params[-1].astype(np.float32))


@functools.lru_cache(maxsize=1)
def default_model() -> Crf:
    return train(labelled_table())


def crf_spans(model: Crf, texts: list[bytes]) -> list[list[Span]]:
    """Byte spans that the model tags in each text."""
    raw = b" ".join([*texts, b""])
    data = np.frombuffer(raw, np.uint8)
    out: list[list[Span]] = [[] for _ in texts]
    starts, ends = _tokens(data)
    if not len(starts):
        return out
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    edges = np.searchsorted(starts, first)
    shape, cue = _classes(raw, data, starts, ends)
    tags = model.decode(model.scores(shape, cue, edges), edges)
    found = np.flatnonzero(tags)
    docs = np.searchsorted(first, starts[found], "right") - 1
    for i, d in zip(found.tolist(), docs.tolist(), strict=True):
        prefix, kind = TAGS[tags[i]].split("-")
        a, b = int(starts[i] - first[d]), int(ends[i] - first[d])
        last = out[d][-1] if out[d] else None
        if prefix == "I" and last and last[0] == kind and i and tags[i - 1] and last[2] == int(ends[i - 1] - first[d]):
            out[d][-1] = (kind, last[1], b)
        else:
            out[d].append((kind, a, b))
    return out


def code_points(text: bytes, spans: list[Span]) -> list[Span]:
    """Byte spans as code point spans."""
    if not spans or text.isascii():
        return spans
    upto = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(k, int(upto[a]), int(upto[b])) for k, a, b in spans]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_name, n_address, n_id) per row."""
    model = model or default_model()
    counts = [f"n_{k}" for k in (*BASE_KINDS, *CRF_KINDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            n: dict[str, list[int]] = {k: [] for k in (*BASE_KINDS, *CRF_KINDS)}
            sha, spans = [], []
            for text, more in zip(texts, crf_spans(model, texts), strict=True):
                base = base_spans(text)
                reach = Reach([(a, b) for _, a, b in base])
                more = [s for s in sorted(more, key=lambda s: (CRF_KINDS.index(s[0]), s[1])) if reach.end(s[2]) <= s[1]]
                every = code_points(text, base + more)
                sha.append(hashlib.sha256(written(every[: len(base)]).encode()).hexdigest())
                spans.append(written(every))
                for k, v in n.items():
                    v.append(sum(s[0] == k for s in every))
            cols = [rows.column(0), *(pa.array(n[k], pa.int64()) for k in BASE_KINDS), pa.array(sha), pa.array(spans), *(pa.array(n[k], pa.int64()) for k in CRF_KINDS)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *counts[:4], "base_sha256", "spans", *counts[4:]])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts[:4]) + ", base_sha256 string, spans string, " + ", ".join(f"{c} long" for c in counts[4:])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redacted(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in brackets. Narrow; null stays null."""
    model = model or default_model()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            new = rows.column(at).to_pylist()
            for i, (text, more) in enumerate(zip(texts, crf_spans(model, texts), strict=True)):
                base = base_spans(text)
                out, last = [], 0
                for k, a, b in sorted([*base, *more], key=lambda s: (s[1], -s[2])):
                    if a >= last:  # of spans that overlap the first, the longest of those
                        out += [text[last:a], b"[" + k.encode() + b"]"]
                        last = b
                if out:
                    new[i] = b"".join([*out, text[last:]]).decode()
            cols = [pa.array(new, c.type) if j == at else c for j, c in enumerate(rows.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=rows.schema.names)

    return docs.mapInArrow(run, docs.schema)


def redact(text: str, spans: str) -> str:
    """The text with each span of ``spans`` replaced by its kind in brackets."""
    parts = sorted(((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)), reverse=True)
    for a, b, k in parts:
        text = f"{text[:a]}[{k}]{text[b:]}"
    return text
