"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The distinct words of a batch are merged together: each has a segment tree whose
leaves are the ranks of its adjacent pairs. The root holds the least rank with the
leftmost place; a merge updates the few leaves it touches, each with one path of
logarithmic length, until no root holds a rank. As long as many words go on, each step
is one numpy operation for all of them; the few that still have merges then, long ones
above all, go on one by one in plain numbers. Words are kept with their ids from batch
to batch, within a bound of characters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from hashlib import sha256

import numpy as np

#: Characters of the chunks that a task remembers; longest chunk that it does; cells of all trees that grow at once.
CACHE, REMEMBERED, CELLS = 2_000_000, 100, 1 << 21
#: Words that still have merges, below which they go on one by one.
FEW = 24
NONE = np.int64(1) << 62


class PairTable:
    """Ranks and results of pairs of ids, looked up by sorted keys."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in pairs] or [0], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        values = np.array(list(pairs.values()) or [(0, 0)], dtype=np.int64)
        self.rank, self.result = values[order, 0], values[order, 1]
        if not pairs:
            self.keys[:] = -1
        self._by_key: dict[int, tuple[int, int]] | None = None

    def dictionary(self) -> dict[int, tuple[int, int]]:
        """left << 32 | right to (rank, result), for single pairs."""
        if self._by_key is None:
            self._by_key = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.result.tolist())))
        return self._by_key

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NONE where there is no merge, and its place in the table."""
        want = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), self.rank[at], NONE), at


def merge_all(flat: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge each word's ids, always the leftmost pair of the lowest rank, to the end.

    flat: the ids of all words, one after another. Returned are the ids left, alike,
    and how many each word has.
    """
    out = np.full(len(flat), -1, dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64))
    for b in np.unique(bits):
        members = np.nonzero(bits == b)[0]
        size = 1 << int(b)
        step = max(1, CELLS // size)
        for begin in range(0, len(members), step):
            part = members[begin : begin + step]
            grid = starts[part, None] + np.arange(size)
            inside = np.arange(size) < lengths[part, None]
            ids = np.full((len(part), size + 1), -1, dtype=np.int64)
            ids[:, :-1][inside] = flat[grid[inside]]
            _merge(ids, size, pairs)
            out[grid[inside]] = ids[:, :-1][inside]
    left = np.add.reduceat(out >= 0, starts) if len(starts) else lengths
    return out[out >= 0], left.astype(np.int64)


def _merge(ids: np.ndarray, size: int, pairs: PairTable) -> None:
    """Merge the words in the rows of ids in place; -1 stands where no id is (any more)."""
    n, width = ids.shape
    ids = ids.reshape(-1)
    after = np.tile(np.arange(1, size + 2), n)  # next living id of each place
    before = np.tile(np.arange(-1, size), n)
    # a node holds rank * size + place, so the minimum is the lowest rank and then leftmost
    grid = np.full((n, 2 * size), NONE, dtype=np.int64)
    rank, _ = pairs.find(ids.reshape(n, width)[:, :-1], ids.reshape(n, width)[:, 1:])
    grid[:, size:] = np.where(rank < NONE, rank * size + np.arange(size), NONE)
    for level in range(size.bit_length() - 2, -1, -1):
        a = 1 << level
        grid[:, a : 2 * a] = np.minimum(grid[:, 2 * a : 4 * a : 2], grid[:, 2 * a + 1 : 4 * a : 2])
    tree = grid.reshape(-1)
    rows = np.arange(n)

    def update(rows, leaf, value):
        base, node = rows * (2 * size), leaf + size
        tree[base + node] = value
        for _ in range(size.bit_length() - 1):
            node >>= 1
            below = base + 2 * node
            tree[base + node] = np.minimum(tree[below], tree[below + 1])

    def leaf_value(base, left, right):
        rank, _ = pairs.find(ids[base + left], ids[base + np.minimum(right, size)])
        return np.where(rank < NONE, rank * size + left, NONE)

    while True:
        root = tree[rows * (2 * size) + 1]
        rows = rows[root < NONE]
        if len(rows) < FEW:
            for row in rows.tolist():
                at = slice(row * width, row * width + width)
                ids[at] = _merge_one(ids[at], after[at], before[at], tree[row * 2 * size : (row + 1) * 2 * size], size, pairs.dictionary())
            break
        base, left = rows * width, root[root < NONE] % size
        right = after[base + left]
        _, at = pairs.find(ids[base + left], ids[base + right])
        ids[base + left] = pairs.result[at]
        ids[base + right] = -1
        beyond = after[base + right]
        after[base + left] = beyond
        before[base + beyond] = left
        update(rows, right, NONE)
        update(rows, left, leaf_value(base, left, beyond))
        prior = before[base + left]
        has = prior >= 0
        if has.any():
            update(rows[has], prior[has], leaf_value(base[has], prior[has], left[has]))


def _merge_one(ids: np.ndarray, after: np.ndarray, before: np.ndarray, tree: np.ndarray, size: int, known: dict[int, tuple[int, int]]) -> list[int]:
    """Merge one word to the end, from where its links and tree stand."""
    ids, after, before, tree, none = ids.tolist(), after.tolist(), before.tolist(), tree.tolist(), int(NONE)
    get = known.get

    def update(leaf: int, value: int) -> None:
        node = leaf + size
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a <= b else b
            if tree[node] == least:  # nothing changes further up
                break
            tree[node] = least
            node >>= 1

    def value(left: int, right: int) -> int:
        found = get(ids[left] << 32 | ids[right]) if right < size and ids[right] >= 0 else None
        return found[0] * size + left if found else none

    while tree[1] < none:
        left = tree[1] % size
        right = after[left]
        ids[left] = get(ids[left] << 32 | ids[right])[1]
        ids[right] = -1
        beyond = after[right]
        after[left] = beyond
        before[beyond] = left
        update(right, none)
        update(left, value(left, beyond))
        prior = before[left]
        if prior >= 0:
            update(prior, value(prior, left))
    return ids


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """A BPE with word ends (lower case, white space dropped) read from a tokenizers JSON file.

    Normalising and splitting of chunks beyond plain letters and digits are the
    library's own steps; merging is merge_all(). Ids and strings are exact.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable({(self.vocab[a], self.vocab[b]): (i, self.vocab[a + b]) for i, (a, b) in reversed(list(enumerate(merges)))})
        added = self.library.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.token = {i: s for s, i in self.vocab.items()} | {i: t.content for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # letters of the first 256 code points: their own composed forms, one lower case each
        self.plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]*").fullmatch
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
        letters = byte_letters()
        self.byte = {letter: b for b, letter in enumerate(letters)}
        self.inner = np.array([self.vocab[c] for c in letters])
        self.final = np.array([self.vocab[c + self.suffix] for c in letters])
        self.chunks: dict[str, bytes] = {"": b""}
        self.decoded: dict[str, str] = {"": ""}
        self.words: dict[bytes, tuple[bytes, str]] = {}
        self.held = 0  # characters of the chunks

    def _split(self, chunk: str) -> list[bytes]:
        """The words of a chunk, in UTF-8."""
        if self.plain(chunk):
            return [w.encode() for w in self.split(chunk.lower())]
        chunk = self.library.normalizer.normalize_str(chunk)
        return [bytes([self.byte[c] for c in w]) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def learn(self, chunks: Iterable[str]) -> None:
        """Make the ids of these chunks known, all their new words merged together."""
        parts, words = {}, self.words
        for chunk in chunks:
            if self.cut and "<|" in chunk:
                at = self.cut.split(chunk)
                parts[chunk] = [x for i, p in enumerate(at) for x in ([p] if i % 2 else self._split(p) if p else [])]
            else:
                parts[chunk] = self._split(chunk)
        fresh = list({w for ws in parts.values() for w in ws} - words.keys() - self.special.keys())
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        flat = np.frombuffer(b"".join(fresh), dtype=np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(lengths)
        ids[ends - 1] = self.final[flat[ends - 1]]
        ids, left = merge_all(ids, lengths, self.pairs)
        raw, token, begin = ids.astype("<u4").tobytes(), [self.token[i] for i in ids.tolist()], 0
        long = []
        for word, n in zip(fresh, left.tolist()):
            if len(word) > REMEMBERED:
                long.append(word)
            words[word] = raw[4 * begin : 4 * (begin + n)], " ".join(token[begin : begin + n])
            begin += n
        for word, i in self.special.items():
            words[word] = i.to_bytes(4, "little"), word
        for chunk, ws in parts.items():
            if len(ws) == 1:
                self.chunks[chunk], self.decoded[chunk] = words[ws[0]]
            else:
                found = [words[w] for w in ws]
                self.chunks[chunk], self.decoded[chunk] = b"".join([i for i, _ in found]), " ".join([s for _, s in found])
        for word in long:
            del words[word]

    def decode(self, ids: Iterable[int]) -> str:
        """As a tokenizer without decoder: tokens joined by a space; unknown ids are left out."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids, as little-endian unsigned 32-bit bytes, and the decoded text of each text; null is empty."""
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        used = set().union(*split)
        if self.held > CACHE:  # keep what this batch uses: frequent chunks are among it
            self.chunks = {"": b""} | {c: self.chunks[c] for c in used & self.chunks.keys()}
            self.decoded = {c: self.decoded[c] for c in self.chunks}
            self.words.clear()
            self.held = sum(map(len, self.chunks))
        fresh = used - self.chunks.keys()
        self.learn(fresh)
        ids, decoded = self.chunks.__getitem__, self.decoded.__getitem__
        out = [(b"".join(map(ids, chunks)), " ".join(filter(None, map(decoded, chunks)))) for chunks in split]
        for chunk in fresh:
            if len(chunk) > REMEMBERED:
                del self.chunks[chunk], self.decoded[chunk]
            else:
                self.held += len(chunk)
        return out


def encode_documents(docs, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """(id, ids binary, decoded string): one row a document, null texts as empty ones.

    Repeated rows give repeated results, empty input none; other columns are ignored.
    """
    from pyspark.sql import functions as F

    from lorequery.llm.common import map_text

    def start():
        coder = WordBpe(path)

        def apply(texts):
            found = coder.encode_batch(texts)
            return {"ids": [i for i, _ in found], "decoded": [s for _, s in found]}

        return apply

    return map_text(docs.select(F.col(id_col), F.col(text_col).alias("__text")), "__text", start, "ids binary, decoded string")


def digest(docs, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """(id, n_tokens, ids_sha256, decoded_sha256) of encode_documents()'s ids and texts: null texts as empty ones, one row a row."""
    from pyspark.sql import functions as F

    from lorequery.llm.common import map_text

    def start():
        coder = WordBpe(path)

        def apply(texts):
            found = coder.encode_batch(texts)
            return {
                "n_tokens": [len(i) // 4 for i, _ in found],
                "ids_sha256": [sha256(i).hexdigest() for i, _ in found],
                "decoded_sha256": [sha256(s.encode()).hexdigest() for _, s in found],
            }

        return apply

    return map_text(docs.select(F.col(id_col), F.col(text_col).alias("__text")), "__text", start, "n_tokens long, ids_sha256 string, decoded_sha256 string")
