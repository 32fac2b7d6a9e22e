"""BPE encoding and decoding with word ends: speculate, verify, and merge only what fails.

For a distinct word the greedy longest match proposes tokens. A sequence of tokens is the result of
the merges if and only if every adjacent pair, merged alone, stays that pair; all pairs of a batch
of words are tested at once against a sorted table of known pairs. Words with a failing pair are
merged exactly. Texts are normalised and cut as the tokenizer's file says: NFC, white space, lower
case, and its pattern; special tokens inside a text are found first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import types
from itertools import chain, filterfalse
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from attestor.llm.work import pieces, small_batches

WORD_MEMO = 120_000
#: Pairs of tokens whose test is kept, beyond those of one batch.
PAIR_MEMO = 400_000
PAIR_BASE = 1 << 20
#: Words of more letters are merged one by one, the others together.
LONG = 40
#: Below this character, lower case is all that normalisation changes, and classes of characters are certain.
SIMPLE = re.compile("[^\x00-ɏ]")
#: Letters and numbers among the simple characters and their lower-case forms, some of which lie beyond.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ʯⱥⱦ", "0-9²³¹¼½¾"
SIMPLE_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\x20\x09-\x0D\x85\xA0{LETTERS}{NUMBERS}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Words(dict):
    """Distinct words to ids as bytes.

    Filled for whole batches by speculate-and-verify. Two generations of WORD_MEMO words bound the memory and
    keep what recurs.
    """

    def __init__(self, path: str):
        super().__init__()
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.ranks = {self.vocab[a] * PAIR_BASE + self.vocab[b]: r for r, (a, b) in enumerate(model["merges"])}
        self.results = [self.vocab[a + b] for a, b in model["merges"]]
        self.rank_keys = np.array(sorted(self.ranks), np.int64)
        self.rank_values = np.array([self.ranks[k] for k in self.rank_keys.tolist()], np.int64)
        self.result_ids = np.array(self.results, np.int64)
        self.letters = byte_letters()
        self.spelling = dict(enumerate(self.letters))
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.table = (np.zeros(0, np.int64), np.zeros(0, bool))
        self.old: dict[str, bytes] = {}
        self.tried = self.failed = 0
        # Only tokens whose own letters merge to them can be proposed: those that end a word, and the others by prefix.
        self.last: dict[str, int] = {}
        self.prefixes: dict[str, int] = {}
        for token, i in self.vocab.items():
            ends = token.endswith(self.end) and len(token) > len(self.end)
            letters = token[: -len(self.end)] if ends else token
            if self.merged(self.symbols(letters, ends)) != [i]:
                continue
            if ends:
                self.last[letters] = i
            else:
                self.prefixes[letters] = i
                for n in range(1, len(letters)):
                    self.prefixes.setdefault(letters[:n], -1)
        self.longest = max(map(len, self.last), default=0)

    def merged(self, symbols: list[int]) -> list[int]:
        """Exact merging: the lowest-ranked adjacent pair first, the leftmost of equals. A heap of pairs over a linked list, n log n in the letters."""
        rank, none, ids, n = self.ranks.get, len(self.results), list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank(a * PAIR_BASE + b, none)) < none]
        heapq.heapify(heap)
        while heap:
            least, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:  # one of the two has been merged since
                continue
            ids[i], ids[j], after[i] = self.results[least], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank(ids[left] * PAIR_BASE + ids[right], none)) < none:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [t for t in ids if t >= 0]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, that of no merge where there is none."""
        keys = left * PAIR_BASE + right
        at = np.minimum(np.searchsorted(self.rank_keys, keys), len(self.rank_keys) - 1)
        return np.where(self.rank_keys[at] == keys, self.rank_values[at], len(self.results))

    def merged_all(self, many: list[list[int]]) -> list[list[int]]:
        """merged() of many sequences, one merge of each at a time as array operations; long ones go one by one."""
        out: list[list[int]] = [[]] * len(many)
        short = [i for i, x in enumerate(many) if len(x) <= LONG]
        for i in {*range(len(many))}.difference(short):
            out[i] = self.merged(many[i])
        if not short:
            return out
        width, none = max(2, max(len(many[i]) for i in short)), len(self.results)
        ids = np.full((len(short), width), -1, np.int64)
        for row, i in enumerate(short):
            ids[row, : len(many[i])] = many[i]
        near = self.ranks_of(ids[:, :-1], ids[:, 1:])
        near[ids[:, 1:] < 0] = none
        owner = np.array(short)
        while len(ids):
            at = near.argmin(1)
            rows = np.arange(len(ids))
            least = near[rows, at]
            if (over := least == none).any():
                for i, x in zip(owner[over].tolist(), ids[over].tolist(), strict=True):
                    out[i] = [t for t in x if t >= 0]
                live = ~over
                ids, near, owner, at, least = ids[live], near[live], owner[live], at[live], least[live]
                rows = rows[: len(ids)]
                if not len(ids):
                    break
            ids[rows, at] = self.result_ids[least]
            cols = np.arange(width)
            ids = np.take_along_axis(ids, np.minimum(cols + (cols > at[:, None]), width - 1), 1)
            ids[:, -1] = -1
            near = np.take_along_axis(near, np.minimum(cols[:-1] + (cols[:-1] >= at[:, None]), width - 2), 1)
            near[:, -1] = none
            for side in (at - 1, at):
                ok = (side >= 0) & (side < width - 1)
                r, c = rows[ok], side[ok]
                found = self.ranks_of(ids[r, c], ids[r, c + 1])
                found[ids[r, c + 1] < 0] = none
                near[r, c] = found
        return out

    def symbols(self, spelled: str, ends: bool) -> list[int]:
        ids = [self.vocab[c] for c in spelled]
        if ends:
            ids[-1] = self.vocab[spelled[-1] + self.end]
        return ids

    def proposed(self, spelled: str) -> list[int]:
        """Greedy longest match; the last token carries the end of the word."""
        out, i, n, last, prefixes = [], 0, len(spelled), self.last, self.prefixes
        while (token := last.get(spelled[i:]) if n - i <= self.longest else None) is None:
            j, longest = i + 1, i
            while j < n and (found := prefixes.get(spelled[i:j])) is not None:
                if found >= 0:
                    token, longest = found, j
                j += 1
            out.append(token)
            i = longest
        out.append(token)
        return out

    def pairs_stand(self, keys: np.ndarray) -> np.ndarray:
        """Whether the letters of each pair of tokens merge to just that pair."""
        pairs = [(int(k) // PAIR_BASE, int(k) % PAIR_BASE) for k in keys]
        spelled = []
        for a, b in pairs:
            first, last = self.names[a], self.names[b]
            ends = last.endswith(self.end) and len(last) > len(self.end)
            spelled.append(self.symbols(first + (last[: -len(self.end)] if ends else last), ends))
        return np.fromiter((m == [a, b] for m, (a, b) in zip(self.merged_all(spelled), pairs, strict=True)), bool, len(pairs))

    def learn(self, words: list[str]) -> None:
        """Encode new words together."""
        spelled = [w.encode("utf-8").decode("latin-1").translate(self.spelling) for w in words]
        ids = [self.proposed(s) for s in spelled]
        lengths = np.array([len(x) for x in ids])
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum()))
        last = np.zeros(len(flat), bool)
        last[np.cumsum(lengths) - 1] = True
        left = np.flatnonzero(~last)
        keys = flat[left] * PAIR_BASE + flat[left + 1]
        known, good = self.table
        unique = np.unique(keys)
        at = np.searchsorted(known, unique)
        new = unique[(at == len(known)) | (known[np.minimum(at, max(len(known) - 1, 0))] != unique)] if len(known) else unique
        if len(new):
            if len(known) + len(new) > PAIR_MEMO:  # starts anew with this batch's pairs
                known, good, new = known[:0], good[:0], unique
            at = np.searchsorted(known, new)
            self.table = known, good = np.insert(known, at, new), np.insert(good, at, self.pairs_stand(new))
        owner = np.repeat(np.arange(len(words)), lengths)
        failed = np.zeros(len(words), bool)
        if len(keys):
            failed[owner[left[~good[np.searchsorted(known, keys)]]]] = True
        self.tried += len(words)
        self.failed += int(failed.sum())
        wrong = np.flatnonzero(failed).tolist()
        for i, ts in zip(wrong, self.merged_all([self.symbols(spelled[i], True) for i in wrong]), strict=True):
            ids[i] = ts
        for w, ts in zip(words, ids, strict=True):
            self[w] = pack(f"<{len(ts)}I", *ts)

    def parts(self, text: str) -> list[str]:
        """The words that the tokenizer's normaliser and pattern make of a text without special tokens."""
        if SIMPLE.search(text):
            text = self.library.normalizer.normalize_str(text)
            letters = {c: b for b, c in enumerate(self.letters)}
            return [bytes(letters[c] for c in w).decode("utf-8") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)] if SIMPLE.search(text) else SIMPLE_PARTS.findall(text)
        return SIMPLE_PARTS.findall(text.lower())

    def know(self, words: set[str]) -> None:
        """Have all these words in this generation."""
        if len(self) > WORD_MEMO:
            self.old = dict(self)
            self.clear()
        old = self.old
        missing = list(filterfalse(self.__contains__, words))  # set operations with the dictionary's keys would visit all of them
        for w in filter(old.__contains__, missing):
            self[w] = old[w]
        if new := list(filterfalse(old.__contains__, missing)):
            self.learn(new)

    def encoded(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """ids as little-endian unsigned 32-bit integers, and the decoded text, of each text."""
        pieces = [self.special_parts.split(t) if t and self.special_parts and any(s in t for s in self.special) else [t or ""] for t in texts]
        cut = [[p if p in self.special else self.parts(p) for p in row if p] for row in pieces]
        self.know(set().union(*(p for row in cut for p in row if isinstance(p, list))))
        out, name = [], self.names.__getitem__
        for row in cut:
            ids = b"".join([self.special[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(self.__getitem__, p)) for p in row])
            out.append((ids, " ".join(map(name, np.frombuffer(ids, "<u4").tolist()))))
        return out


def load(path: str) -> Words:
    """The tokenizer, loaded once per process and path."""
    kept = sys.modules.setdefault("_attestor_models", types.ModuleType("_attestor_models")).__dict__
    if path not in kept:
        kept[path] = Words(path)
    return kept[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded of every row of docs (doc_id, text); null texts have no ids and decode to ''."""

    def run(batches):
        words = load(path)
        for batch in pieces(batches, 64):
            got = words.encoded(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([np.frombuffer(b, "<u4").astype("int32") for b, _ in got], pa.list_(pa.int32())), pa.array([t for _, t in got], pa.string())], ["doc_id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text).

    Null and empty texts give no tokens and the digests of nothing. Rows are independent of each
    other; an empty table gives an empty result; other columns are left out. path: a tokenizer file
    that every executor can read.
    """

    def run(batches):
        words = load(path)
        for batch in pieces(batches, 64):
            got = words.encoded(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(b) // 4 for b, _ in got], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b, _ in got], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in got], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
