"""BPE encoding by speculation: greedy longest-match proposes the tokens of a word, vectorised checks of every adjacent
pair verify them, and only words that fail are merged exactly.

Why the check is exact: merges inside two neighbouring tokens run as they would alone unless a merge crosses their
border. While the left token grows along its right edge and the right token along its left edge, the border sees a
staircase of token pairs. A sequence is what BPE gives if each token is reachable and no step of any staircase has a
crossing merge that comes before the next merge on either side.

Null text counts as empty: no tokens, the digests of nothing. Repeated rows and an empty table need no care. Words have
no length limit; exact merging keeps a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import map_docs, texts_of

NEVER = np.int64(1 << 40)
NO_RANK = 1 << 40
WORDS_KEPT = 300_000
SHORT = 64
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"


def _ranges(kind: str, top: int) -> str:
    """The characters below `top` of a general category's first letter, as ranges of a character class."""
    chars = "".join(chr(c) if unicodedata.category(chr(c))[0] == kind else " " for c in range(top))
    return "".join(f"{re.escape(run[0])}-{re.escape(run[-1])}" for run in chars.split())


_LATIN_TOP = 0x250
_LETTER, _NUMBER = _ranges("L", _LATIN_TOP), _ranges("N", _LATIN_TOP)
_LATIN_WORDS = re.compile(f"{_CONTRACTED}|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_NOT_LATIN = re.compile(f"[^\\x00-{chr(_LATIN_TOP - 1)}]")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else from 256 upwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordBpe:
    """A word-level BPE vocabulary with an end-of-word suffix, and its tables for the pair check."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in self.letters.items()}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for table in (self.ids, self.special):
            for token, k in table.items():
                self.tokens[k] = token
        self.shown = [t.encode() for t in self.tokens]
        self.longest = max(map(len, self.ids)) + len(self.end)
        self.size = size
        self._merge_tables(spec["model"]["merges"])

    def _merge_tables(self, merges: list) -> None:
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        self.merge = {}
        self.rank = np.full(self.size, -1, np.int64)
        halves = np.full((self.size, 2), -1, np.int64)
        for at, (a, b) in enumerate(pairs):
            left, right = self.ids[a], self.ids[b]
            whole = self.ids[a + b]
            self.merge[left, right] = at, whole
            self.rank[whole], halves[whole] = at, (left, right)
        keys = np.fromiter((a * self.size + b for a, b in self.merge), np.int64, len(self.merge))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter((r for r, _ in self.merge.values()), np.int64, len(self.merge))[order]
        self.right_edge, self.right_size = self._edges(halves[:, 1])
        self.left_edge, self.left_size = self._edges(halves[:, 0])
        self._reachable(halves)

    def _edges(self, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the chain of its outer parts on one side, from the single letter up to itself."""
        chains, now = [np.arange(self.size)], child
        while (now >= 0).any():
            chains.append(now)
            now = np.where(now >= 0, child[now], -1)
        down = np.array(chains).T
        depth = (down >= 0).sum(axis=1)
        up = np.full((self.size, down.shape[1]), -1, np.int64)
        for k in range(down.shape[1]):
            at = depth - 1 - k
            up[:, k] = np.where(at >= 0, down[np.arange(self.size), np.maximum(at, 0)], -1)
        return up, depth

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def crossed(self, left: np.ndarray, right: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """True where a merge crosses the border of two tokens; with `until`, where one does so before that rank."""
        i, j = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        bad, live = np.zeros(len(left), bool), np.arange(len(left))
        while len(live):
            a, b, ia, jb = left[live], right[live], i[live], j[live]
            more_a, more_b = ia + 1 < self.right_size[a], jb + 1 < self.left_size[b]
            next_a = np.where(more_a, self.rank[self.right_edge[a, np.minimum(ia + 1, self.right_edge.shape[1] - 1)]], NEVER)
            next_b = np.where(more_b, self.rank[self.left_edge[b, np.minimum(jb + 1, self.left_edge.shape[1] - 1)]], NEVER)
            joined = self._pair_rank(self.right_edge[a, ia], self.left_edge[b, jb])
            hit = (joined < next_a) & (joined <= next_b) & (joined < (NEVER if until is None else until[live]))
            bad[live[hit]] = True
            on = ~hit & (more_a | more_b)
            step_left = next_a <= next_b
            i[live[on & step_left]] += 1
            j[live[on & ~step_left]] += 1
            live = live[on]
        return bad

    def _reachable(self, halves: np.ndarray) -> None:
        """Tokens that merging their own letters gives back."""
        self.reachable = np.zeros(self.size, bool)
        single = [k for t, k in self.ids.items() if len(t.removesuffix(self.end) or t) == 1]
        self.reachable[single] = True
        made = np.flatnonzero(halves[:, 0] >= 0)
        fine = np.zeros(self.size, bool)
        fine[made] = ~self.crossed(halves[made, 0], halves[made, 1], self.rank[made])
        for k in made[np.argsort(self.rank[made])]:
            self.reachable[k] = fine[k] and self.reachable[halves[k]].all()

    def proposed(self, word: str) -> list[int] | None:
        """Greedy longest match; None where a letter has no token."""
        out, at, n, ids = [], 0, len(word), self.ids
        while at < n:
            to = min(n, at + self.longest)
            while to > at:
                found = ids.get(word[at:to] if to < n else word[at:] + self.end)
                if found is not None:
                    break
                to -= 1
            else:
                return None
            out.append(found)
            at = to
        return out

    def merged(self, word: str) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals: by scanning a short word, with a heap for a long one."""
        parts = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.end]]
        n = len(parts)
        if n <= SHORT:
            none, get = (NO_RANK, -1), self.merge.get
            found = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
            while found:
                best = min(found)
                if best is none:
                    break
                k = found.index(best)
                parts[k : k + 2] = [best[1]]
                del found[k]
                if k < len(found):
                    found[k] = get((parts[k], parts[k + 1]), none)
                if k:
                    found[k - 1] = get((parts[k - 1], parts[k]), none)
            return parts
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*found, k) for k in range(n - 1) if (found := self.merge.get((parts[k], parts[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, whole, k = heapq.heappop(heap)
            right = after[k]
            if parts[k] < 0 or right < 0 or self.merge.get((parts[k], parts[right]), (0, -1))[1] != whole:
                continue
            parts[k], parts[right] = whole, -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
                if found := self.merge.get((whole, parts[after[k]])):
                    heapq.heappush(heap, (*found, k))
            if before[k] >= 0 and (found := self.merge.get((parts[before[k]], whole))):
                heapq.heappush(heap, (*found, before[k]))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[str]) -> tuple[list[np.ndarray], int]:
        """Token ids of each word, and how many words had to be merged exactly."""
        shown = [w.encode().decode("latin-1").translate(self.letters) for w in words]
        found = [self.proposed(w) for w in shown]
        sizes = np.fromiter((len(f) if f else 0 for f in found), np.int64, len(found))
        flat = np.fromiter((t for f in found if f for t in f), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        failed = sizes == 0
        failed[owner[~self.reachable[flat]]] = True
        if len(flat) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            keys, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            failed[owner[inner[self.crossed(keys // self.size, keys % self.size)[back]]]] = True
        out = np.split(flat, np.cumsum(sizes)[:-1]) if len(found) else []
        for k in np.flatnonzero(failed):
            out[k] = np.array(self.merged(shown[k]), np.int64)
        return [x.astype("<u4") for x in out], int(failed.sum())

    def words_of(self, text: str) -> list[str]:
        """Normalised and split as the vocabulary's own normaliser and pre-tokeniser do: directly for Latin texts, by
        the tokenizers library for others, whose letters depend on its version of Unicode."""
        if not _NOT_LATIN.search(text):
            lower = unicodedata.normalize("NFC", text).lower()
            if not _NOT_LATIN.search(lower):
                return _LATIN_WORDS.findall(lower)
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, p)).decode() for p, _ in parts]

    def segments(self, text: str) -> list[list[str]]:
        """Words of each stretch between special tokens, with the special tokens as lists of their own (marked by a
        leading empty string)."""
        parts = self.split.split(text) if self.split else [text]
        return [["", p] if k % 2 else self.words_of(p) for k, p in enumerate(parts)]


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


class Encoder:
    """Encodes and decodes texts; keeps the ids of words seen lately, in two generations of WORDS_KEPT words at most."""

    def __init__(self, path: str):
        self.bpe, self.known, self.older, self.merged_words, self.new_words = word_bpe(path), {}, {}, 0, 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        bpe, split = self.bpe, [self.bpe.segments(t) for t in texts]
        here = {w for segments in split for s in segments if not (s and s[0] == "") for w in s}
        if len(self.known) + len(here) > WORDS_KEPT:
            self.known, self.older = {}, self.known
        new = here - self.known.keys()
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        fresh = sorted(new - again)
        ids, failed = bpe.encode_words(fresh)
        self.merged_words, self.new_words = self.merged_words + failed, self.new_words + len(fresh)
        self.known.update(zip(fresh, (x.tobytes() for x in ids), strict=True))
        get, out = self.known.__getitem__, []
        for segments in split:
            raw = b"".join(np.uint32(bpe.special[s[1]]).astype("<u4").tobytes() if s and s[0] == "" else b"".join(map(get, s)) for s in segments)
            out.append(np.frombuffer(raw, "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The vocabulary has no decoder, so tokens are joined by a space."""
        return b" ".join(map(self.bpe.shown.__getitem__, ids.tolist()))


def _path(path: str | None) -> str:
    import public_tokenizers as public

    return path or public.path("word_bpe_49k.json")


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of whole texts."""
    path = _path(path)

    def make(doc_ids, texts):
        ids = _encoder(path).encode([t or "" for t in texts])
        return {"doc_id": doc_ids, "ids": pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))}

    return map_docs(texts_of(docs), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    path = _path(path)

    def make(doc_ids, ids):
        texts = [_encoder(path).decode(np.array(x or [], np.int64)).decode() for x in ids]
        return {"doc_id": doc_ids, "text": pa.array(texts, pa.string())}

    return map_docs(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def encoded_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes whole texts, decodes the ids, and keeps the count of tokens and the digests of both."""
    path = _path(path)

    def make(doc_ids, texts):
        coder = _encoder(path)
        ids = coder.encode([t or "" for t in texts])
        return {
            "doc_id": doc_ids,
            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string()),
        }

    return map_docs(texts_of(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
