"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel counts shared subsequences of three characters, gaps allowed up to a span of
six, each weighted by DECAY to its span; so an insult still matches with a character
put in or left out. A Nyström map on landmark strings makes it a linear machine, and as
the kernel is a dot product of sparse features, machine and landmarks fold into one
weight per subsequence: scoring a string is a sum of table lookups. A sentence scores
as its strongest string; a document by its strongest sentence, and by how many of its
strings are above zero.
"""

from __future__ import annotations

import re
from collections import Counter
from heapq import nsmallest
from math import exp, log
from operator import mul
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequery.llm.common import filter_text, fitted, hash_share, map_text

DECAY = 0.6
#: Pairs of steps between the three characters of a subsequence.
STEPS = [(a, b) for a in range(1, 5) for b in range(1, 5) if a + b <= 5]
FEATURES = 1 << 18
#: Bounds of what the model is fitted on: labelled documents of either kind, their characters, landmarks, negative strings.
MAX_DOCS, MAX_CHARS, LANDMARKS, NEGATIVES = 2000, 20_000, 384, 16_000
#: Strings whose score a task remembers; the longest string read as one (longer ones are read in overlapping parts).
CACHE, LONGEST = 400_000, 64
THRESHOLD = 0.7
#: Telling strings stand in so many times as large a share of toxic documents as of clean ones; so many are taken, above the
#: least log-likelihood, where labels are too few for any to be beyond chance.
TELLING, BEST, CHANCE = 4.0, 20, 4.0
#: Beyond chance: so much times the logarithm of the number of strings tried.
SURE = 0.55
#: Weight of all negative strings together, over that of all positive ones.
OVERWEIGHT = 8.0


def _alphabet() -> np.ndarray:
    """Codes of the code points below 2**16: 1-26 a-z, 27-57 other letters, 0 what only takes up space."""
    out = np.zeros(1 << 16, dtype=np.int64)
    for c in range(1 << 16):
        s = chr(c).lower()
        if len(s) == 1 and "a" <= s <= "z":
            out[c] = ord(s) - 96
        elif s.isalpha():
            out[c] = 27 + ord(s[0]) % 31
    out[2], out[3] = 62, 63  # begin and end of a string
    return out


CODES = _alphabet()
PAD = "\0" * 5
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_MARKS = re.compile(r"[\W_]+")
_DOTTED = re.compile(r"[^\W\d_](?:[\W_]+[^\W\d_]){2,}").fullmatch
_SPELLED = re.compile(r"(?:(?<=\s)|^)(?:\w[\W_]{0,3}\s){2,}\w(?=\W|$)")


def strings(sentence: str) -> set[str]:
    """The strings of a sentence: its words, lowered, without outer marks, and runs of single letters joined."""
    low = sentence.lower()
    out = set(low.split())
    if " " in low[1:2] or any(low[i + 2 : i + 3] == " " and low[i : i + 1] == " " for i in _singles(low)):
        for m in _SPELLED.finditer(low):
            joined = re.sub(r"[\W_]+", "", m[0])
            if len(joined) > 3:
                out.add(joined)
    return out


def _singles(text: str):
    """Places of a space two before another one."""
    i = text.find(" ")
    while i >= 0:
        if text[i + 2 : i + 3] == " ":
            yield i
        i = text.find(" ", i + 1)


def _bare(word: str) -> str:
    """A string without outer marks, and without any where marks stand between all its letters."""
    word = _EDGES.sub("", word)
    return _MARKS.sub("", word) if not word.isalpha() and _DOTTED(word) else word


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin of each word, subsequence ids (steps, places), weights of the steps, norms of the words)."""
    parts = ["\x02" + _bare(w) + "\x03" + PAD for w in words]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = CODES[np.minimum(raw, 65535)]
    begin = np.cumsum(lengths) - lengths
    n = len(codes)
    longer = np.concatenate([codes, np.zeros(5, np.int64)])
    ids = np.zeros((len(STEPS), n), dtype=np.int64)
    weights = np.array([DECAY ** (a + b + 1) for a, b in STEPS])
    norm = np.zeros(n)
    for k, (a, b) in enumerate(STEPS):
        second, third = longer[a : a + n], longer[a + b : a + b + n]
        whole = (codes > 0) & (second > 0) & (third > 0)
        ids[k] = np.where(whole, codes << 12 | second << 6 | third, 0)
        norm += np.where(whole, weights[k] ** 2, 0.0)
    norms = np.sqrt(np.add.reduceat(norm, begin)) if n else np.zeros(0)
    return begin, ids, weights, np.maximum(norms, 1e-9)


def shorten(word: str) -> list[str]:
    """A word in overlapping parts no longer than LONGEST."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - 8, LONGEST - 8)]


class Machine:
    """Folded weights with the offset and the calibration of document scores."""

    def __init__(self, table: np.ndarray, offset: float, calibration: tuple[float, ...]):
        self.table, self.offset, self.calibration = table, offset, calibration

    def margins(self, words: list[str]) -> np.ndarray:
        """Decision values of strings; a long one has that of its strongest part."""
        if not words:
            return np.zeros(0)
        parts = [shorten(w) for w in words]
        flat = [p for ps in parts for p in ps]
        begin, ids, weights, norms = features(flat)
        sums = np.add.reduceat((weights[:, None] * self.table[ids]).sum(axis=0), begin)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.maximum.reduceat(sums / norms, np.cumsum(counts) - counts) + self.offset

    @staticmethod
    def summary(margins: list[float]) -> tuple[float, ...]:
        """A document's measures: its largest margin, if above zero, how many of its different strings are above zero, and how few it has besides, and a constant; all 0 where none is."""
        hits = sum(m > 0 for m in margins)
        return (max(margins), log(1.0 + hits), max(0.0, 10.0 - log(len(margins) + 20.0)), 1.0) if hits else (0.0, 0.0, 0.0, 0.0)

    def probability(self, margins: list[float]) -> float:
        *weights, shift = self.calibration
        return 1 / (1 + exp(-min(50.0, max(-50.0, sum(map(mul, weights, self.summary(margins))) + shift))))


class Landmarks:
    """Nyström map: the features that the landmarks have, one dense column each, and K^-1/2."""

    def __init__(self, landmarks: list[str]):
        begin, ids, weights, norms = features(landmarks)
        self.used = np.unique(np.append(ids, 0))
        #: Column of each subsequence; column 0 is that of all that no landmark has, and stays empty.
        self.column = np.zeros(FEATURES, dtype=np.int32)
        self.column[self.used] = np.arange(len(self.used))
        self.phi = np.zeros((len(self.used), len(landmarks)), dtype=np.float32)
        owner = np.repeat(np.arange(len(landmarks)), np.diff([*begin, ids.shape[1]]))
        for k in range(len(STEPS)):
            np.add.at(self.phi, (self.column[ids[k]], owner), weights[k])
        self.phi[0] = 0
        self.phi /= norms
        values, vectors = np.linalg.eigh((self.phi.T @ self.phi).astype(np.float64))
        keep = values > 1e-6 * values.max()
        self.root = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T

    def map(self, words: list[str]) -> np.ndarray:
        """Nyström features of strings."""
        out = []
        for i in range(0, len(words), 1024):
            begin, ids, weights, norms = features(words[i : i + 1024])
            kernel = sum(weights[k] * np.add.reduceat(self.phi[self.column[ids[k]]], begin, axis=0) for k in range(len(STEPS)))
            out.append(((kernel / norms[:, None]) @ self.root).astype(np.float32))
        return np.concatenate(out)

    def fold(self, w: np.ndarray) -> np.ndarray:
        """The weight of each subsequence under a linear machine on the map."""
        table = np.zeros(FEATURES, dtype=np.float32)
        table[self.used] = self.phi @ (self.root @ w)
        return table


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 30.0, steps: int = 250) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    cw = c * weight
    size = 1 / (1 + 2 * np.linalg.eigvalsh((x1 * cw[:, None]).T @ x1)[-1])
    w, ahead, t = np.zeros(x1.shape[1]), np.zeros(x1.shape[1]), 1.0
    single = lambda v: v.astype(x1.dtype)  # noqa: E731  without it numpy would copy x1 in every step
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ single(ahead)))
        grad = np.r_[ahead[:-1], 0.0] - 2 * (single(cw * slack * y) @ x1)
        new = ahead - size * grad
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (old - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def _altered(word: str, random: np.random.Generator) -> str:
    """The word with a mark put in, a letter doubled or a letter left out."""
    i = int(random.integers(1, max(2, len(word) - 1)))
    kind = int(random.integers(0, 3))
    return word[:i] + "*-._"[int(random.integers(0, 4))] + word[i:] if kind == 0 else word[:i] + word[i - 1] + word[i:] if kind == 1 else word[:i] + "." + word[i + 1 :]


def _bag(text: str) -> Counter:
    """The strings of all sentences of a text with how many sentences hold each, long ones in the parts that they are scored by."""
    out: Counter = Counter()
    for line in re.split(r"\n|(?<=[.!?])\s", text):
        out.update({_EDGES.sub("", p) for s in strings(line) for p in shorten(s)} - {""})
    return out


def _heads(s: str) -> list[str]:
    """A string and its beginnings, as endings vary."""
    return [s, *(s[:k] for k in range(4, min(len(s) - 1, 8) + 1))]


def train(texts: list[str], toxic: list[int], seed: int = 0) -> Machine:
    """Fit on labelled documents; without both labels a machine that scores all 0, or 1 where all are toxic.

    Labels are of documents, so the strings to learn from are found first: those that,
    by themselves or by their beginnings, stand in TELLING times as large a share of
    toxic documents as of clean ones, and beyond what chance makes of so many strings,
    are positive, and the strings of clean documents are negative, each with the weight
    of its frequency; altered copies stand beside the positives and as many negatives. Toxic documents without a telling string teach
    nothing. The clean strings nearest to the positives join the negatives in a second
    round. Then documents calibrate the probability, by their strongest string, by how
    many are above zero and how many there are: a held-back fifth, or all where that
    holds too few of either label.
    """
    if not any(toxic) or all(toxic):
        return Machine(np.zeros(FEATURES, np.float32), -1.0, (0.0, 0.0, 0.0, 0.0, -50.0 if not any(toxic) else 50.0))
    random = np.random.default_rng(seed)
    pool: dict[str, str] = {}  # each string once in memory
    bags = [{pool.setdefault(s, s): n for s, n in sorted(_bag(t).items())} for t in texts]
    y = np.array(toxic)
    held = np.zeros(len(y), bool)
    held[::5] = True
    if min(y[held].sum(), (1 - y[held]).sum()) < 40:  # too few to hold any back: all calibrate
        held[:] = False
    own = [i for i in np.nonzero(~held)[0] if bags[i]]
    # of near copies, which share the least four hashes of their strings, only one counts
    own = list({(*nsmallest(4, (crc32(s.encode()) for s in bags[i])), int(y[i])): i for i in own[::-1]}.values())[::-1]
    bad, good = Counter(), Counter()  # how often strings occur under either label
    with_bad, with_good = Counter(), Counter()  # documents with a head
    for i in own:
        (bad if y[i] else good).update(bags[i])
        if y[i]:
            with_bad.update({h for s in bags[i] for h in _heads(s)})
    for i in own:
        if not y[i]:
            with_good.update({h for s in bags[i] for h in _heads(s) if h in with_bad})
    share = sum(y[i] for i in own) / len(own)
    sure = SURE * np.log(max(2, len(with_bad)))  # so many heads are tried that chance alone gives some of them much

    def tells(h):
        """How far a head's share of toxic documents is beyond chance, as a log-likelihood; 0 where it is not."""
        b = with_bad[h]
        by_chance = share * (b + with_good[h])
        return b * np.log(b / by_chance) - (b - by_chance) if b > by_chance else 0.0

    far = {h: x for h in with_bad if (x := tells(h)) > CHANCE}
    # a few labels leave nothing beyond chance: then the best few strings
    sure = min([sure, *sorted(far.values())[-BEST:][:1]])
    strong = {h: x for h, x in far.items() if x >= sure and with_bad[h] >= TELLING * share / (1 - share) * with_good[h]}
    score = {s: x for s in bad if len(s) > 2 and (x := max((strong.get(h, 0.0) for h in _heads(s)), default=0.0))}
    n_bad, n_good = max(1, sum(bad.values())), max(1, sum(good.values()))
    telling = set(score)
    odds = lambda s: max((strong.get(h, 0.0) for h in _heads(s)), default=0.0)
    names = sorted(telling, key=lambda s: (-bad[s] * score[s] / (1 + good[s]), s))
    if not names:
        return Machine(np.zeros(FEATURES, np.float32), -1.0, (0.0, 0.0, 0.0, 0.0, float(np.log(y.mean() / (1 - y.mean())))))
    spread, of_head = [], Counter()  # landmarks of many beginnings
    for s in names:
        of_head[s[:5]] += 1
        if of_head[s[:5]] <= 6:
            spread.append(s)
    frequent = [s for s, _ in sorted(good.items(), key=lambda x: (-x[1], x[0])) if len(s) > 3 and s not in telling]
    chosen = spread[: LANDMARKS // 2]
    landmarks = Landmarks(chosen + frequent[: LANDMARKS - len(chosen)])
    positives = names[: NEGATIVES // 4]
    near = sorted((s for s in good if odds(s)), key=lambda s: (-odds(s), s))[: NEGATIVES // 4]
    rest = sorted(good.keys() - set(near))
    negatives = near + [rest[i] for i in sorted(random.permutation(len(rest))[: NEGATIVES - len(near)])]
    more = [_altered(s, random) for s in positives[:500] for _ in range(2) if len(s) > 3]
    wrong = [_altered(s, random) for s in (negatives[i] for i in random.permutation(len(negatives))[: 2 * len(more)]) if len(s) > 3]
    mapped, taken = landmarks.map(negatives), set(negatives)
    pos = np.concatenate([landmarks.map(positives), landmarks.map(more)]) if more else landmarks.map(positives)
    off = landmarks.map(wrong) if wrong else pos[:0]
    pos_weight = np.array([bad[s] / n_bad * n_good for s in positives] + [max(1.0, 0.5 * bad[s] / n_bad * n_good) for s in positives[:500] for _ in range(2) if len(s) > 3])
    machine = None
    for last in (False, True):
        x = np.concatenate([mapped, off, pos])
        label = np.r_[-np.ones(len(mapped) + len(off)), np.ones(len(pos))]
        weight = np.r_[np.sqrt([good[s] for s in negatives]), np.ones(len(off)), np.sqrt(pos_weight)]
        for value, total in ((-1, OVERWEIGHT * 50), (1, 50)):  # a document has many clean strings, and the strongest counts
            weight[label == value] *= total / weight[label == value].sum()
        w, offset = _svm(x, label, weight)
        machine = Machine(landmarks.fold(w), offset, (1.0, 0.0, 0.0, 0.0, 0.0))
        if last:
            break
        # the clean strings that it takes for insults join the negatives
        clean = [s for s in good if s not in taken]
        value = machine.margins(clean)
        hard = [clean[i] for i in np.argsort(-value, kind="stable")[: NEGATIVES // 4] if value[i] > -0.9]
        if not hard:
            break
        negatives, mapped = negatives + hard, np.concatenate([mapped, landmarks.map(hard)])
    rows = np.nonzero(held)[0] if held.any() else np.array(own)
    known = sorted(set().union(*(bags[i] for i in rows)))
    value = dict(zip(known, machine.margins(known).tolist()))
    machine.calibration = _calibrate(np.array([machine.summary([value[s] for s in bags[i]]) for i in rows]), y[rows])
    return machine


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic weights of documents' measures and a shift, by Newton steps on smoothed targets; none but the constant's weight is negative."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    used = list(range(x.shape[1]))
    while True:
        z = np.column_stack([x[:, used], np.ones(len(x))])
        w, ridge = np.zeros(z.shape[1]), np.r_[np.full(len(used), 0.05), 1e-3]
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
            hess = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(hess, z.T @ (p - target) + ridge * w)
            w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        real = [i for i, k in enumerate(used) if k < x.shape[1] - 1]
        least = min(real, key=lambda i: w[i], default=0)
        if not real or w[least] >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[*used, -1]] = w
            return tuple(out.tolist())
        used.pop(least)


class Scorer:
    """Probabilities of whole texts; margins of strings seen before are kept within a bound."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}

    def __call__(self, texts: list[str | None]) -> list[float]:
        bags = [strings(t) if t else set() for t in texts]
        used = set().union(*bags)
        fresh = list(used - self.known.keys())
        if len(self.known) + len(fresh) > CACHE:
            self.known = {s: self.known[s] for s in used & self.known.keys()}
        for i in range(0, len(fresh), 20_000):
            self.known.update(zip(fresh[i : i + 20_000], self.machine.margins(fresh[i : i + 20_000]).tolist()))
        get = self.known.__getitem__
        return [self.machine.probability([*map(get, bag)]) for bag in bags]


def fit(docs: DataFrame, labels: DataFrame, train_fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> Machine:
    """Learn from labelled documents for which train_fold holds, a condition on the id.

    At most about max_docs documents of either label, chosen by hash of their id, are
    used, and none over MAX_CHARS characters: a bounded sample, brought to one task. Ids
    labelled both ways count as toxic; null labels and ids are left out; of several
    texts with one id the least counts. Without labels of both kinds all texts get the
    score of the only one there is, or 0.
    """
    wanted = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & train_fold
    marked = labels.filter(wanted).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows, or few
    share = F.lit(False)
    for value, n in sizes.items():
        share = share | ((F.col("toxic") == value) & hash_share(F.xxhash64("id"), max_docs, n))
    chosen = marked.filter(share)
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") <= MAX_CHARS)
        .join(F.broadcast(chosen), "id")  # about 2 * max_docs ids at most
        .groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    )

    def learn(rows: list[dict]) -> Machine:
        rows.sort(key=lambda r: (str(r["id"]), r["text"]))
        return train([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows])

    return fitted(rows, learn) or train([], [])


def _starter(docs: DataFrame, machine: Machine):
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def start():
        scorer = Scorer(shared.value)

        def apply(texts):
            scores = scorer(texts)
            return {"score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

        return apply

    return start


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default: all but the text), score and predicted for every row.

    Null and empty texts score as texts without any string; repeated rows get equal
    results; empty input none. Columns named score or predicted are replaced.
    """
    return map_text(docs, text_col, _starter(docs, machine), "score double, predicted int", keep)


def keep_clean(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with their own columns.

    Null and empty texts hold no string and stay, but where a machine calls all texts
    toxic; repeated rows stay or go together; empty input gives an empty result.
    """
    start = _starter(docs, machine)

    def flags():
        apply = start()
        return lambda texts: [p == 0 for p in apply(texts)["predicted"]]

    return filter_text(docs, text_col, flags)
