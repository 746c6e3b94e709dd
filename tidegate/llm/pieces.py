"""Exact encoding with merge-type SentencePiece models, by backtracking (operator 4).

A tokenisation is the one that merging gives exactly when each pair of adjacent
tokens is left as it is when the pair's own text is merged again: as long as no
merge crosses a border, what happens on its two sides does not depend on
anything further away. So the encoder walks from left to right with the longest
vocabulary match (all matches come from one Aho-Corasick pass), accepts a token
if it is compatible with the one before, goes on to shorter matches otherwise,
and drops the last token when none is left. A bitfield of failed positions
ensures that no position is tried twice with the same outcome.

No piece holds a space sign after another character, and no piece holds a
character outside the vocabulary, so a text is cut at both kinds of border and
each distinct cut is encoded once per worker.

Defined cases: a very long text, even without any border, is encoded whole; a null or empty text gives the end id alone and decodes to the
empty text; repeated rows are each encoded; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Entries of a worker's caches, and characters that a cached cut has on average at most, so that long
#: cuts don't fill the memory. A full cache of cuts becomes the older one, from which
#: entries that are met again come back; the cache of pairs is emptied when full.
CACHE_ENTRIES, CACHED_CHARACTERS = 400_000, 20
#: A text by which a model's normaliser is told to add a space sign in front, and to change nothing else.
_PROBE = " A  \ufb01\u00a0e\u0301 \n\t\u3000x "


class MergeEncoder:
    """The ids the sentencepiece library gives, without its encoder."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model, self.end_id = model, model.eos_id()
        self.ids: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            if model.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            self.ids[model.id_to_piece(i)] = i
        #: Merging takes the pair whose joined piece has the highest score, the leftmost of equals.
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normaliser = sentencepiece.SentencePieceNormalizer(model_file=path)
        if normaliser.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
            raise ValueError("models whose normaliser changes the text are not supported")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        letters = set(chain.from_iterable(self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("models with pieces across a space are not supported")
        #: White space and signs that no piece holds: nothing merges across them.
        apart = re.escape("".join(c for c in "\t\n\x0b\x0c\r" if c not in letters))
        self.cuts = re.compile(f"[{apart}]|{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" if apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cache_entries = cache_entries
        self.pairs: dict[tuple[str, str], bool] = {}
        self.characters = 0  # of the cuts in known
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging, for short texts: pairs of tokens and single tokens."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the text of both again leaves these two tokens. left is empty at the start."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > self.cache_entries:
                self.pairs.clear()
            wanted = [left, right] if left else [right]
            found = self.pairs[left, right] = self.merged(left + right) == wanted
        return found

    def tokens(self, text: str) -> list[str]:
        n = len(text)
        sizes: list[list[int]] = [[] for _ in range(n)]
        for last, size in self.automaton.iter(text):
            sizes[last + 1 - size].append(size)
        for at, found in enumerate(sizes):
            if text[at] not in self.ids:
                found.insert(0, 1)  # a character outside the vocabulary stands alone
        tokens: list[str] = []
        trial: list[int] = []  # for each position on the path, how many of its sizes are yet to try
        failed = bytearray((n >> 3) + 1)  # a bit per position
        pos, left = 0, len(sizes[0])
        while pos < n:
            last = tokens[-1] if tokens else ""
            while left:
                left -= 1
                end = pos + sizes[pos][left]  # sizes ascend, so the longest comes first
                if not failed[end >> 3] >> (end & 7) & 1 and self.compatible(last, text[pos:end]):
                    tokens.append(text[pos:end])
                    trial.append(left)
                    pos = end
                    left = len(sizes[pos]) if pos < n else 0
                    break
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                if not tokens:
                    raise ValueError("no tokenisation found")
                pos -= len(tokens.pop())
                left = trial.pop()
        return tokens

    def unit(self, text: str) -> tuple[tuple[int, ...], str]:
        ids: list[int] = []
        for token in self.tokens(text):
            found = self.ids.get(token)
            if found is None:
                ids += [self.bytes[b] for b in token.encode()]
            else:
                ids.append(found)
        return tuple(ids), " ".join(map(str, ids))

    def units(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """Ids and their decimal form for each cut of a text."""
        if not text:
            return []
        known, out = self.known, []
        for cut in self.cuts.findall(SPACE + text.replace(" ", SPACE)):
            found = known.get(cut)
            if found is None:
                if len(known) >= self.cache_entries or self.characters > self.cache_entries * CACHED_CHARACTERS:
                    self.older, self.known, self.characters = known, {}, 0
                    known = self.known
                self.characters += len(cut)
                found = known[cut] = self.older.get(cut) or self.unit(cut)
            out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(u[0] for u in self.units(text)))

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@cache
def merge_encoder(path: str, cache_entries: int = CACHE_ENTRIES) -> MergeEncoder:
    """One encoder for all tasks of a worker."""
    return MergeEncoder(path, cache_entries)


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, end id included.

    cache_entries bounds a worker's memory (about 300 bytes each, with their cuts' characters), not what is encoded.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merge_encoder(model, cache_entries)
        for batch in batches:
            texts = batch.column("text").fill_null("")
            for at in range(0, batch.num_rows, 512):
                counts, ids_hash, text_hash = [], [], []
                for text in texts[at : at + 512].to_pylist():
                    units = encoder.units(text)
                    ids = list(chain.from_iterable(u[0] for u in units))
                    ids.append(encoder.end_id)
                    said = " ".join([*(u[1] for u in units), str(encoder.end_id)])
                    counts.append(len(ids))
                    ids_hash.append(hashlib.sha256(said.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at : at + 512], pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_lists(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with the end id) and decoded text of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merge_encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids = [[*encoder.encode(x or ""), encoder.end_id] for x in batch.column("text")[at : at + 64].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at : at + 64], pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.decode(x) for x in ids], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids array<int>, decoded string")
