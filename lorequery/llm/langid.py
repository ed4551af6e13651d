"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are summed per language on the executors, which also turn them into a row of
log-probabilities each; the matrix (languages by bins, 256 KB a language) is broadcast.
A batch of texts is a sparse matrix, a row of bins and counts for each text, and is
scored as a whole by its product with the log-probabilities, in numpy.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequery.llm.common import filter_text, hash_share, map_text, slices

BINS = 1 << 16
#: Most documents of a language that the model is fitted on: all, or an even sample by hash of their text.
MAX_TRAIN = 10_000
#: Tasks that count; characters whose n-grams are held at once; cells of the product that are.
PARTS, STEP, CELLS = 8, 1 << 19, 1 << 21
#: Added to every count; weight of the mean log-probability in the score.
SMOOTHING, SHARPNESS = 0.5, 12.0
UND = "und"


def _letters() -> np.ndarray:
    """Of each code point below 2**16: its lower-case letter, or a space where it is no letter."""
    out = np.full(1 << 16, 32, dtype=np.uint32)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Grams:
    """Hashed 1- to 3-grams of the letters of texts, all other characters being one space."""

    table: np.ndarray | None = None

    def __init__(self):
        if Grams.table is None:
            Grams.table = _letters()
        self.letters = Grams.table

    def codes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = self.letters[np.minimum(raw, 65535)]
        if len(raw) and raw.max() > 65535:
            kinds, of = np.unique(raw[raw > 65535], return_inverse=True)
            codes[raw > 65535] = np.array([k if unicodedata.category(chr(k))[0] == "L" else 32 for k in kinds.tolist()], dtype=np.uint32)[of]
        return codes

    def bins(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(bins of the n-grams, how often each occurs), in the order of the bins; empty where the text has no letter.

        A long text is read in steps, so that only its own characters are held whole.
        """
        text = text or ""
        dense = np.zeros(BINS, np.int64) if len(text) >= STEP else None
        tail, letters = np.array([32], np.uint32), False
        found = np.zeros(0, np.uint16)
        for at in range(0, len(text) + 1, STEP):
            codes = self.codes(text[at : at + STEP])
            blank = codes == 32
            codes = codes[~(blank & np.concatenate([[tail[-1] == 32], blank[:-1]]))] if len(codes) else codes
            letters = letters or bool((codes != 32).any())
            own = len(codes)  # the space at the end is no gram of its own
            if at + STEP > len(text):
                codes = np.append(codes, np.uint32(32))
            c = np.concatenate([tail, codes])
            new = len(tail)  # grams that end from here on are new
            one = c * np.uint32(2654435761)
            two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) + np.uint32(0x9E3779B9)
            three = (two[:-1] * np.uint32(3266489917)) ^ (c[2:] * np.uint32(668265263))
            out = np.concatenate([one[new : new + own], two[new - 1 :], three[max(0, new - 2) :]])
            out ^= out >> 15
            out *= np.uint32(2246822519)
            found = (out >> np.uint32(16)).astype(np.uint16)
            if dense is not None:
                dense += np.bincount(found, minlength=BINS)
            tail = c[-2:]
        if not letters:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if dense is not None:
            bins = np.nonzero(dense)[0]
            return bins, dense[bins]
        found.sort()
        begin = np.concatenate([[0], np.nonzero(found[1:] != found[:-1])[0] + 1])
        return found[begin].astype(np.int64), np.diff(np.append(begin, len(found)))


def log_shares(counts: np.ndarray) -> np.ndarray:
    """Smoothed log-probabilities of one language's counts."""
    share = counts + SMOOTHING
    return np.log(share / share.sum()).astype(np.float32)


class Model:
    """Log-probabilities (bins, languages) with the languages' names, in their order."""

    def __init__(self, names: list[str], rows: list[np.ndarray]):
        self.names = names
        self.logp = np.ascontiguousarray(np.stack(rows, axis=1)) if names else np.zeros((BINS, 0), np.float32)

    def means(self, bins: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """Mean log-probability (texts, languages) of sparse rows, none of them empty."""
        out, width = np.zeros((len(bins), len(self.names))), max(1, len(self.names))
        at = 0
        while at < len(bins):
            end, cells = at, 0
            while end < len(bins) and (end == at or cells + len(bins[end]) * width <= CELLS):
                cells += len(bins[end]) * width
                end += 1
            held, times = np.concatenate(bins[at:end]), np.concatenate(counts[at:end])
            begin = np.cumsum([0] + [len(b) for b in bins[at : end - 1]])
            product = self.logp[held] * times[:, None]  # in double precision, as times are integers
            out[at:end] = np.add.reduceat(product, begin, axis=0) / np.add.reduceat(times, begin)[:, None]
            at = end
        return out

    def predict(self, grams: Grams, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language and its score, the softmax of the sharpened mean log-probabilities, of each text.

        Ties go to the language that sorts first; no letters, or no language learned: und, 0.
        """
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        rows = [grams.bins(t) for t in texts] if self.names else []
        there = [i for i, (b, _) in enumerate(rows) if len(b)]
        if there:
            mean = self.means([rows[i][0] for i in there], [rows[i][1] for i in there])
            best = mean.argmax(axis=1)
            score = 1 / np.exp(SHARPNESS * (mean - mean.max(axis=1, keepdims=True))).sum(axis=1)
            for i, k, x in zip(there, best.tolist(), score.tolist()):
                names[i], scores[i] = self.names[k], x
        return names, scores


def fit(docs: DataFrame, train: Column, lang_col: str = "lang", text_col: str = "text", max_train: int = MAX_TRAIN) -> Model:
    """Learn from the rows where train holds and neither language nor text is null.

    At most about max_train rows of each language count, chosen by the hash of their
    text, so that a rare language keeps all of its own; every language that has a
    letter in some text is learned. The driver gets the languages' names and sizes and
    256 KB for each. Empty input learns nothing.
    """
    lang, text = F.col(lang_col), F.col(text_col)
    labelled = docs.filter(train & lang.isNotNull() & text.isNotNull()).select(lang.cast("string").alias("lang"), text.alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    chosen = F.lit(True)
    for name, n in sizes.items():
        if n > max_train:
            chosen = chosen & ((F.col("lang") != name) | hash_share(F.xxhash64("text"), max_train, n))

    def count(batches):
        grams, sums = Grams(), {}
        for part in slices(batches, "text"):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                bins, counts = grams.bins(text)
                if len(bins):
                    if lang not in sums:
                        sums[lang] = np.zeros(BINS, np.int64)
                    sums[lang][bins] += counts
        for lang, held in sums.items():  # one row at a time, however many languages
            yield pa.RecordBatch.from_arrays([pa.array([lang], type=pa.string()), pa.array([held.tobytes()], type=pa.binary())], names=["lang", "counts"])

    def finish(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(c, dtype=np.int64) for c in group["counts"])
        return pd.DataFrame({"lang": [key[0]], "logp": [log_shares(counts).tobytes()]})

    parts = labelled.filter(chosen).repartition(PARTS).mapInArrow(count, "lang string, counts binary")
    rows = parts.groupBy("lang").applyInPandas(finish, "lang string, logp binary").collect()  # a language's row is 256 KB
    rows.sort(key=lambda r: r["lang"])
    return Model([r["lang"] for r in rows], [np.frombuffer(r["logp"], dtype=np.float32) for r in rows])


def _starter(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        grams, model = Grams(), shared.value

        def apply(texts):
            names, scores = model.predict(grams, texts)
            return {"lang_pred": names, "score": scores}

        return apply

    return start


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default: all but the text), lang_pred and score for every row.

    Null texts and texts without letters are und with score 0; repeated rows get equal
    results; empty input none. Columns named lang_pred or score are replaced.
    """
    return map_text(docs, text_col, _starter(docs, model), "lang_pred string, score double", keep)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is known with a score of at least `least`, with their own columns.

    Rows with null texts or texts without letters go; repeated rows stay or go together;
    empty input gives an empty result.
    """
    start = _starter(docs, model)

    def flags():
        apply = start()

        def run(texts):
            found = apply(texts)
            return [lang != UND and score >= least for lang, score in zip(found["lang_pred"], found["score"])]

        return run

    return filter_text(docs, text_col, flags)
