"""Secret scans: base rules, and a character convolutional network over candidates in context.

Candidates are the base rules' findings and all long tokens that are no plain word or
number. A network in numpy (character embedding, convolution, maxima and means over the
candidate and maxima over its surroundings) is trained on labelled findings: secrets of
public formats and tokens that only look like them, made up and set into the corpus's own
wording, and what the corpus holds itself, findings of the base rules and tokens of
harmless forms. Its scores are calibrated, and the threshold is the highest that keeps
the wanted recall on held-back findings of every format. It adds spans; those of the base
rules always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequery.llm.common import change_rows, fitted, hash_share, map_text
from lorequery.llm.secret_shapes import draw

KINDS = ("assign", "access", "hex")
ADDED = "network"
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").finditer
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}").finditer
_HEX = re.compile(r"[0-9a-f]{24,}").finditer
_LONG = re.compile(r"[A-Za-z0-9+/_.=-]{8,}").finditer
_NUMBER = re.compile(r"[0-9+/_.=-]+").fullmatch
#: Parts that are words, with or without a capital, or numbers: no candidates without a digit beside letters.
_PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").fullmatch
_PARTS = re.compile(r"[+/_.=-]+").split
#: Forms that are no secrets, for labels of the corpus's own tokens: addresses, hosts, paths, words with a few digits, codes.
_HARMLESS = re.compile(r"(?:[A-Za-z]+[+/_.=-]+)*(?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,6})(?:[+/_.=-]+(?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,6}))*[+/_.=-]*").fullmatch
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Window of characters about a candidate: of its surroundings before, of itself, of its surroundings after.
BEFORE, INSIDE, AFTER = 24, 48, 8
#: Texts that are sampled for the network's fit, and pieces of them that reach the driver, at most.
MAX_TEXTS, MAX_PIECES = 20_000, 6_000
#: Made-up findings of each format in the fit; the share of them, and of each format, that the threshold keeps.
EACH, RECALL = 160, 0.95
#: Longest piece of a text that the fit sees about one finding.
PIECE = 400


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind as listed: leftmost, not overlapping within a kind."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def candidates(text: str | None, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens of eight characters or more that no base span touches, but for plain words and numbers.

    Plain are letters in one case or with a capital, under 24 of them, such words joined
    by marks, and figures; marks at an end, but for "=" after it, are no part of a token.
    """
    if not text:
        return []
    starts = [a for _, a, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))  # how far the spans up to each one go
    out = []
    for m in _LONG(text):
        token = m[0]
        if token.isalpha() and len(token) < 24 and (token[1:].islower() or token.isupper()):
            continue
        a, b = m.span()
        token = token.rstrip("./_+-").lstrip("./=+")
        a, b = (a + m[0].index(token), a + m[0].index(token) + len(token)) if token else (a, a)
        if b - a < 8 or _NUMBER(token) or all(_PLAIN(p) and len(p) < 24 for p in _PARTS(token) if p):
            continue
        before = bisect_left(starts, b)
        if not (before and reach[before - 1] > a):
            out.append((a, b))
    return out


def _codes() -> np.ndarray:
    """One of 48 codes for each code point below 256: letters with case folded in two sets of classes, digits, marks."""
    out = np.full(257, 1, dtype=np.int64)  # 0 is outside the text, 1 any other character
    for c in range(26):
        out[97 + c] = 2 + c
        out[65 + c] = 28 + c // 7
    for c in range(10):
        out[48 + c] = 32 + c // 5
    for i, c in enumerate(" \n\t=:'\"_-./+,;"):
        out[ord(c)] = 34 + i
    return out


CODES = _codes()


def windows(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, codes): one row for each window of INSIDE characters of a candidate, with its surroundings; the last one ends where the candidate does."""
    owner, rows = [], []
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = CODES[np.minimum(raw, 256)]
    for k, (a, b) in enumerate(spans):
        for begin in (*range(a, b - INSIDE, INSIDE), max(a, b - INSIDE)):
            row = np.zeros(BEFORE + INSIDE + AFTER, dtype=np.int64)
            before = codes[max(0, begin - BEFORE) : begin]
            row[BEFORE - len(before) : BEFORE] = before
            inside = codes[begin : min(b, begin + INSIDE)]
            row[BEFORE : BEFORE + len(inside)] = inside
            after = codes[b : b + AFTER] if b <= begin + INSIDE else codes[:0]
            row[BEFORE + INSIDE : BEFORE + INSIDE + len(after)] = after
            owner.append(k)
            rows.append(row)
    return np.array(owner, dtype=np.int64), np.array(rows, dtype=np.int64).reshape(-1, BEFORE + INSIDE + AFTER)


class Network:
    """Embedding, one convolution of five characters, maxima in and about the candidate and means in it, a logistic unit."""

    WIDTH, SIZE, FILTERS = 5, 8, 32

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.3, (48, self.SIZE))
        self.embed[0] = 0
        self.kernel = r.normal(0, (self.WIDTH * self.SIZE) ** -0.5, (self.WIDTH * self.SIZE, self.FILTERS))
        self.bias = np.zeros(self.FILTERS)
        self.out = r.normal(0, 0.1, 3 * self.FILTERS)
        self.offset = np.zeros(1)
        self.slope, self.shift, self.threshold = 1.0, 0.0, 2.0
        #: on held-back findings: recall of each format of secrets, share of each other format that is taken
        self.recall: dict[str, float] = {}
        self.taken: dict[str, float] = {}

    def _forward(self, x: np.ndarray):
        seen = np.lib.stride_tricks.sliding_window_view(x, self.WIDTH, axis=1)
        grid = self.embed[seen].reshape(*seen.shape[:2], -1)
        act = np.maximum(grid @ self.kernel + self.bias, 0)
        places = np.arange(act.shape[1])
        inside = (places >= BEFORE - 2) & (places < BEFORE + INSIDE - 2)
        own, about = np.where(inside)[0], np.where(~inside)[0]
        top = own[act[:, own].argmax(axis=1)], about[act[:, about].argmax(axis=1)]
        held = np.maximum((x[:, BEFORE : BEFORE + INSIDE] > 0).sum(axis=1), 1)[:, None]
        mean = (act[:, own] * (x[:, own + 2] > 0)[:, :, None]).sum(axis=1) / held
        pooled = np.concatenate([*(np.take_along_axis(act, t[:, None], 1)[:, 0] for t in top), mean], axis=1)
        return seen, grid, act, top, pooled, pooled @ self.out + self.offset[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 14, seed: int = 0) -> None:
        """Adam on the logistic loss, either label weighing as much; in single precision."""
        r, step = np.random.default_rng(seed), 0
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        names = ("embed", "kernel", "bias", "out", "offset")
        for n in names:
            setattr(self, n, getattr(self, n).astype(np.float32))
        weight = weight.astype(np.float32)
        first, second = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2))
        for _ in range(rounds):
            order = r.permutation(len(y))
            for i in range(0, len(y), 64):
                rows = order[i : i + 64]
                seen, grid, act, top, pooled, z = self._forward(x[rows])
                d = (weight[rows] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[rows]) / len(rows)).astype(np.float32)
                back = d[:, None] * self.out
                d_act = np.zeros_like(act)
                for t, part in zip(top, (back[:, : self.FILTERS], back[:, self.FILTERS : 2 * self.FILTERS])):
                    np.put_along_axis(d_act, t[:, None], np.take_along_axis(d_act, t[:, None], 1) + part[:, None], 1)
                own = slice(BEFORE - 2, BEFORE + INSIDE - 2)
                there = (x[rows][:, BEFORE : BEFORE + INSIDE] > 0)[:, :, None]
                d_act[:, own] += back[:, None, 2 * self.FILTERS :] * there / np.maximum(there.sum(axis=1, keepdims=True), 1)
                d_act *= act > 0
                d_grid = (d_act @ self.kernel.T).reshape(*seen.shape, self.SIZE)
                flat, parts = seen.ravel(), d_grid.reshape(-1, self.SIZE)
                d_embed = np.stack([np.bincount(flat, parts[:, k], len(self.embed)) for k in range(self.SIZE)], axis=1)
                d_embed[0] = 0
                grads = d_embed, np.tensordot(grid, d_act, ((0, 1), (0, 1))), d_act.sum(axis=(0, 1)), pooled.T @ d, np.array([d.sum()])
                step += 1
                for n, g in zip(names, grads):
                    g = (g + 1e-4 * getattr(self, n)).astype(np.float32)
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    setattr(self, n, getattr(self, n) - 0.01 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8))

    def calibrate(self, z: np.ndarray, y: np.ndarray, kinds: list[str]) -> None:
        """Platt's slope and shift, then the highest threshold that keeps the wanted recall of every kind of findings with y = 1."""
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(200):
            d = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -50, 50))) - target
            self.slope -= 0.05 * (d * z).mean()
            self.shift -= 0.05 * d.mean()
        p, of, levels = self.probability(z), np.array(kinds), []
        for kind in sorted(set(of[y > 0].tolist())):
            own = np.sort(p[(of == kind) & (y > 0)])[::-1]
            levels.append(float(own[int(np.ceil(RECALL * len(own))) - 1]))
        self.threshold = min(levels, default=2.0)
        taken = p >= self.threshold
        self.recall = {k: float(taken[(of == k) & (y > 0)].mean()) for k in sorted(set(of[y > 0].tolist()))}
        self.taken = {k: float(taken[(of == k) & (y < 1)].mean()) for k in sorted(set(of[y < 1].tolist()))}

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -50, 50)))

    def score(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """Probability of each candidate: that of its likeliest window."""
        if not spans:
            return np.zeros(0)
        owner, x = windows(text, spans)
        out = np.zeros(len(spans))
        np.maximum.at(out, owner, self.probability(self.logits(x)))
        return out


def _windowed(text: str, group: list[tuple[int, int]]) -> np.ndarray:
    """The first and the last window of each span."""
    owner, x = windows(text, group)
    if not len(x):
        return x
    first = np.unique(owner, return_index=True)[1]
    last = len(owner) - 1 - np.unique(owner[::-1], return_index=True)[1]
    return x[np.unique(np.concatenate([first, last]))]


def train(texts: list[str], seed: int = 0) -> Network:
    """Learn from made-up findings set into pieces of texts, and from the findings in the texts themselves.

    Of the texts' own tokens, findings of the base rules are secrets, with their keyword
    before them or blanked, and tokens of harmless forms are none; all others have no
    label. Without any text the network learns from the made-up findings alone.
    """
    r = np.random.default_rng(seed)
    snippets = [t[i : i + 40] for t in texts for i in (0, max(0, len(t) - 40))] or []
    snippets = [s for s in snippets if not base_spans(s)]
    sets = []
    for secret in (True, False):
        for name, text, a, b in draw(r, EACH, snippets, secret):
            if secret or candidates(text, base_spans(text)):
                x = _windowed(text, [(a, b)])[:1]
                sets.append((name, int(secret), x))
    for text in texts:
        base = base_spans(text)
        values = [(m.start(1), m.end(1)) for m in _ASSIGN(text) if m.end(1) - m.start(1) >= 16] if base else []
        for label, group in ((1, [(a, b) for _, a, b in base] + values), (0, [(a, b) for a, b in candidates(text, base) if _HARMLESS(text[a:b])])):
            for x in _windowed(text, group)[:8]:
                sets.append(("corpus, base rules" if label else "corpus, harmless", label, x[None]))
    most = 10 * EACH  # of the corpus's own findings, of either label
    order, count, kept = r.permutation(len(sets)), {}, []
    for i in order:
        count[sets[i][0]] = count.get(sets[i][0], 0) + 1
        if count[sets[i][0]] <= most:
            kept.append(sets[i])
    kinds, y, x = [k for k, _, _ in kept], np.array([v for _, v, _ in kept]), np.concatenate([c for _, _, c in kept])
    # of every fourth finding the surroundings are blanked, so that its own look must count as well
    x[::4, :BEFORE] = 0
    held = np.arange(len(y)) % 4 == 1
    network = Network(seed)
    network.fit(x[~held], y[~held].astype(float), seed=seed)
    network.calibrate(network.logits(x[held]), y[held], [k for k, h in zip(kinds, held) if h])
    return network


def fit(docs: DataFrame, text_col: str = "text", max_texts: int = MAX_TEXTS) -> Network:
    """Learn from a bounded sample of about max_texts different texts at most, even by hash of the text.

    What they hold comes to one task cut to the surroundings of their findings, a few
    hundred characters for each, and one piece of every text; MAX_PIECES of them at most.
    Without any text there is nothing to scan, and the network adds nothing.
    """
    sample = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & hash_share(F.xxhash64("text"), max_texts, docs.count()))

    def start():
        def apply(texts):
            out = []
            for text in texts:
                base = base_spans(text)
                begin = (len(text) * 617) // 1000
                out.append([text[begin : begin + 120]] + [text[max(0, a - 60) : min(b, a + PIECE) + 60] for a, b in [(a, b) for _, a, b in base] + candidates(text, base)])
            return {"near": out}

        return apply

    pieces = map_text(sample, "text", start, "near array<string>").select(F.explode("near").alias("near")).distinct()
    chosen = pieces.orderBy(F.xxhash64("near"), "near").limit(MAX_PIECES)
    return fitted(chosen, lambda rows: train(sorted(r["near"] for r in rows))) or Network()


def spans(text: str | None, network: Network) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans by start then kind)."""
    base = base_spans(text)
    near = candidates(text, base)
    if not near:
        return base, base
    p = network.score(text, near)
    added = [(ADDED, a, b) for (a, b), x in zip(near, p) if x >= network.threshold]
    order = {k: i for i, k in enumerate((*KINDS, ADDED))}
    return base, sorted(base + added, key=lambda s: (s[1], order[s[0]]))


def _said(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_added, base_sha256, spans): one row a document.

    Null and empty texts have no spans (the digest is that of an empty string);
    repeated rows get equal results; empty input none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def start():
        network = shared.value

        def apply(texts):
            out = {n: [] for n in ("n_assign", "n_access", "n_hex", "n_added", "base_sha256", "spans")}
            for text in texts:
                base, all_ = spans(text, network)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["n_added"].append(len(all_) - len(base))
                out["base_sha256"].append(sha256(_said(base).encode()).hexdigest())
                out["spans"].append(_said(all_))
            return out

        return apply

    return map_text(
        docs.select(F.col(id_col), F.col(text_col).alias("__text")), "__text", start, "n_assign long, n_access long, n_hex long, n_added long, base_sha256 string, spans string"
    )


def redacted(text: str | None, network: Network) -> str | None:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    found = spans(text, network)[1]
    if not found:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in found:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind} removed]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, network: Network, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with the secrets in its texts replaced, and length_col, where there is one, brought up to date for texts that change.

    Null and empty texts stay as they are, as do all other columns, whatever they are
    called; repeated rows stay equal; empty input gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def start():
        network = shared.value

        def apply(part: pa.RecordBatch) -> pa.RecordBatch:
            at = part.schema.get_field_index(text_col)
            old = part.column(at).to_pylist()
            new = [redacted(t, network) for t in old]
            columns = list(part.columns)
            columns[at] = pa.array(new, type=part.schema.field(at).type)
            counted = part.schema.get_field_index(length_col)
            if counted >= 0:
                kind = part.schema.field(counted).type
                sizes = [n if a == b or b is None else len(b) for a, b, n in zip(old, new, part.column(counted).to_pylist())]
                columns[counted] = pa.array([str(n) if n is not None and pa.types.is_string(kind) else n for n in sizes], type=kind)
            return pa.RecordBatch.from_arrays(columns, schema=part.schema)

        return apply

    return change_rows(docs, text_col, start)
