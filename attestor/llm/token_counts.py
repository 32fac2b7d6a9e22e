"""Token counts of a SentencePiece BPE model by the whole-token shortcut.

Offline, every vocabulary piece of the form "word start, then no other space mark" is encoded
alone; those that come back as themselves are proven whole tokens. Texts are cut before every
space mark that follows another character. No piece of the vocabulary spans such a place
(checked when the model is loaded), so no merge crosses it and the counts of the parts add up.
Parts that are proven whole tokens count one; only the rest is merged, once per distinct part.
"""

from __future__ import annotations

import re
import sys
import types

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.work import pieces, small_batches

MARK = "▁"
PARTS = re.compile(f"{MARK}+[^{MARK}]*")
LIMIT = 4096
MEMO = 120_000


def load(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, loaded once per process and path."""
    kept = sys.modules.setdefault("_attestor_models", types.ModuleType("_attestor_models")).__dict__
    if path not in kept:
        kept[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return kept[path]


def whole_tokens(path: str) -> set[str]:
    """Words whose piece (space mark and word) is proven to encode alone as that one token. At most the vocabulary's size."""
    model = load(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces) or len(model.encode("a ")) - 1 != len(model.encode("a")):
        raise ValueError("a piece spans the end of a word: texts can't be cut there")
    words = [(i, p[1:]) for i, p in enumerate(pieces) if len(p) > 1 and p[0] == MARK != p[1]]
    return {w for (i, w), ids in zip(words, model.encode([w for _, w in words], num_threads=1), strict=True) if ids == [i]}


class Counts(dict):
    """Words without a space mark to the number of their tokens after a single mark; two generations bound its size."""

    def __init__(self, model, whole: set[str]):
        super().__init__()
        self.model, self.whole, self.old = model, whole, {}

    def __missing__(self, word: str) -> int:
        n = 1 if word in self.whole else self.old.get(word)
        if n is None:
            n = len(self.model.encode(word))
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[word] = n
        return n


def count(text: str | None, counts: Counts) -> int:
    if not text:
        return 0
    marked = text.replace(" ", MARK)
    if not marked.startswith(MARK) and not marked.endswith(MARK) and MARK + MARK not in marked:
        return sum(map(counts.__getitem__, marked.split(MARK)))
    total = 0
    for part in PARTS.findall(MARK + marked):  # runs of spaces stay with the word that follows
        if part == MARK:
            total += 1
        elif part[1] != MARK:
            total += counts[part[1:]]
        else:
            total += len(counts.model.encode(part[1:].replace(MARK, " ")))
    return total


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text).

    Null texts count as empty: no bytes, no tokens. Rows are independent, so repeated rows count alike
    and an empty table gives an empty result; other columns are left out. path: a .model file that
    every executor can read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches):
        counts = Counts(load(path), shared.value)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array([count(t, counts) for t in batch.column("text").to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
