"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch are laid out as one array of symbols. An index holds, for each mergeable pair, all positions
where it occurs; ranks are applied in ascending order from a heap, all positions of a rank at once, and the lists of the pairs
to the left and right of each merge are updated. Every word is merged once a batch and then looked up.

The vocabulary file is of the kind with an end-of-word suffix, NFC and lower case, and byte-level symbols.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches

#: Fixed by the vocabulary's own pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: Words kept from batch to batch by a worker; the table starts anew beyond that.
KEPT_WORDS = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Vocabulary:
    """Pair ranks, symbol ids and the bytes of each id, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        chars = byte_symbols()
        self.inner = [ids.get(c, -1) for c in chars]
        self.last = [ids.get(c + self.suffix, -1) for c in chars]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([ids[a] << 32 | ids[b] for a, b in merges], dtype=np.int64)
        self.keys, self.ranks = np.unique(key, return_index=True)  # of equal pairs the first rank
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        size = max(max(ids.values()), *self.special.values()) + 1
        self.text: list[str] = [""] * size
        for token, i in ids.items():
            self.text[i] = token
        for token, i in self.special.items():
            self.text[i] = token


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def rank_of(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rank of each pair of symbols; -1 where they don't merge."""
    key = left << 32 | right
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    return np.where((v.keys[at] == key) & (left >= 0) & (right >= 0), v.ranks[at], -1)


def merge_words(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """The ids of each word."""
    length = np.array([len(w) for w in words], dtype=np.int64)
    end = np.cumsum(length)
    raw = np.frombuffer(b"".join(words), np.uint8)
    sym = np.array(v.inner, dtype=np.int64)[raw]
    sym[end - 1] = np.array(v.last, dtype=np.int64)[raw[end - 1]]
    n = len(sym)
    word = np.repeat(np.arange(len(words)), length)
    nxt = np.append(np.arange(1, n), -1)
    nxt[end - 1] = -1
    prev = np.arange(-1, n - 1)
    prev[end - length] = -1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def file_under(at: np.ndarray) -> None:
        """Adds positions to the lists of the pairs that begin there."""
        at = at[nxt[at] >= 0]
        rank = rank_of(v, sym[at], sym[nxt[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    alive = np.ones(n, dtype=bool)
    file_under(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        at = np.unique(np.concatenate(index.pop(r)))
        at = at[alive[at]]
        at = at[nxt[at] >= 0]
        at = at[rank_of(v, sym[at], sym[nxt[at]]) == r]  # others are stale
        if not len(at):
            continue
        if sym[at[0]] == sym[nxt[at[0]]]:  # x x x: left to right, no symbol twice
            at = at[_every_other(at, nxt)]
        right = nxt[at]
        sym[at] = v.merged[r]
        alive[right] = False
        nxt[at] = nxt[right]
        after = nxt[at]
        prev[after[after >= 0]] = at[after >= 0]
        before = prev[at]
        file_under(np.unique(np.concatenate([at, before[before >= 0]])))
    left = np.flatnonzero(alive & (sym >= 0))
    cut = np.searchsorted(word[left], np.arange(1, len(words)))
    return np.split(sym[left].astype(np.uint32), cut)


def _every_other(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of pairs that overlap in a chain, the first, third, and so on."""
    linked = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
    start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
    return (np.arange(len(at)) - start) % 2 == 0


def normalized(text: str) -> str:
    """NFC, then lower case letter by letter (no rule for a final sigma)."""
    text = unicodedata.normalize("NFC", text) if not text.isascii() else text
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class Coder:
    """Encodes and decodes batches of texts; keeps the ids of words that it has met."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        v, known = self.v, self.known
        if len(known) > KEPT_WORDS or not known:
            known.clear()
            known.update((t, np.uint32(i).tobytes()) for t, i in v.special.items())
        parts: list[list[str]] = []
        for text in texts:
            own: list[str] = []
            for piece in v.split_special.split(text) if "<|" in text else (text,):
                own += [piece] if piece in v.special else WORDS.findall(normalized(piece))
            parts.append(own)
        new = list({w for own in parts for w in own}.difference(known))
        if new:
            ids = merge_words(v, [w.encode("utf-8", "surrogatepass") for w in new])
            known.update((w, x.tobytes()) for w, x in zip(new, ids, strict=True))
        return [np.frombuffer(b"".join(map(known.__getitem__, own)), "<u4") for own in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary file names no decoder: the tokens stand as they are, with spaces between."""
        return " ".join(map(self.v.text.__getitem__, ids.tolist()))


#: Texts are worked through in groups of about so many characters, or one text.
GROUP_CHARS = 1_000_000


def groups(texts: list[str], most: int = GROUP_CHARS) -> Iterator[list[str]]:
    own, chars = [], 0
    for t in texts:
        if own and chars + len(t) > most:
            yield own
            own, chars = [], 0
        own.append(t)
        chars += len(t)
    if own:
        yield own


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document; and ids array<int> and decoded string if asked for.

    ``path`` names the vocabulary file on every worker. A null or empty text has no ids and decodes to an empty text. Repeated
    rows and null ids stay; other columns of ``docs`` are left out.
    """
    fields = [("doc_id", pa.int64(), "long"), ("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    fields += [("ids", pa.list_(pa.int32()), "array<int>")] * with_ids + [("decoded", pa.string(), "string")] * with_text

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            at = 0
            for texts in groups([x or "" for x in batch.column(1).to_pylist()]):
                rows = []
                for ids in coder.encode(texts):
                    decoded = coder.decode(ids)
                    row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append((*row, *[ids.astype(np.int32)] * with_ids, *[decoded] * with_text))
                cols = zip(*rows, strict=True)
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), *(pa.array(c, f[1]) for c, f in zip(cols, fields[1:], strict=True))], names=[f[0] for f in fields])
                at += len(texts)

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(code, ", ".join(f"{n} {kind}" for n, _, kind in fields))
