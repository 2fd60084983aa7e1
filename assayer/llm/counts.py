"""Token counts by rank-synchronous array merging.

The vocabulary is a list of pieces with scores; a text is split into symbols (characters), and the
neighbours whose joined text is the best-scored piece are merged, leftmost first, until none is left.
Symbols that are no piece count one token per UTF-8 byte.

No piece holds a space mark after another character (checked when the model is read), so no merge crosses
the start of a run of spaces: texts are cut there into pre-tokens. Each partition merges a pre-token
once and keeps its count. New pre-tokens are merged together: their symbols lie in one ragged array, and in
every round each sequence applies its pair of lowest rank, all sequences at the same time. Sequences of over
``LONG`` symbols take the same merges from a priority queue, as rounds over one long sequence would cost the
square of its length.
"""

from __future__ import annotations

import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.llm.tokens import give_back

SPACE = "▁"
LONG = 2_000
#: Pre-tokens remembered by a task before it starts anew; bounds memory, not results.
REMEMBERED = 400_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Merger:
    """Merge tables of one sentencepiece BPE model, and the counts of the pre-tokens seen."""

    def __init__(self, model: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = library.get_piece_size()
        pieces = {
            library.id_to_piece(i): library.get_score(i)
            for i in range(size)
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))
        }
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in pieces):
            raise ValueError("a piece of this model crosses the start of a run of spaces")
        if library.encode("ﬁ  a", out_type=str) != library.encode("ﬁ  a ", out_type=str)[:-1]:
            raise ValueError("this model changes texts before it splits them")
        self.number = {s: i for i, s in enumerate(dict.fromkeys([*pieces, *itertools.chain.from_iterable(pieces)]))}
        self.piece = np.array([s in pieces for s in self.number])
        rank = {score: r for r, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        pairs = {}
        for piece, score in pieces.items():
            for cut in range(1, len(piece)):
                left, right = self.number.get(piece[:cut]), self.number.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (rank[score], self.number[piece])
        self.pairs = pairs
        self.worst = len(rank)
        self.key = np.array(sorted(pairs), np.int64)
        self.rank = np.array([*(pairs[k][0] for k in self.key.tolist()), self.worst], np.int64)
        self.joined = np.array([*(pairs[k][1] for k in self.key.tolist()), 0], np.int64)
        self.seen: dict[str, int] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of neighbouring symbols; the worst rank where they make no piece."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        at[(self.key[at] != wanted) | (left < 0) | (right < 0)] = len(self.key)
        return self.rank[at], self.joined[at]

    def symbols(self, text: str) -> list[int]:
        """Numbers of the characters; one that is in no piece is minus its length in bytes."""
        number = self.number
        return [number[c] if c in number else -len(c.encode()) for c in text]

    def left_over(self, symbols: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
        tokens = np.where(symbols < 0, -symbols, 1)
        loose = np.flatnonzero((symbols >= 0) & ~self.piece[np.maximum(symbols, 0)])
        if len(loose):
            names = list(self.number)
            tokens[loose] = [len(names[i].encode()) for i in symbols[loose].tolist()]
        return np.bincount(owner, tokens, count).astype(np.int64)

    def merge(self, sequences: list[str]) -> np.ndarray:
        """Tokens of each sequence: one merge per sequence and round, until no sequence has a pair left."""
        count = len(sequences)
        parts = [self.symbols(s) for s in sequences]
        lengths = np.fromiter(map(len, parts), np.int64, count)
        symbol = np.fromiter(itertools.chain.from_iterable(parts), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(count), lengths)
        result = np.zeros(count, np.int64)
        while len(symbol):
            inner = owner[1:] == owner[:-1]
            rank, joined = self.look_up(symbol[:-1], symbol[1:])
            rank[~inner] = self.worst
            place = np.arange(len(rank))
            best = np.full(count, (self.worst + 1) << 32, np.int64)
            np.minimum.at(best, owner[:-1], rank << 32 | place)  # of equal ranks the leftmost
            merging = best < (self.worst << 32)
            done = ~merging[owner]
            if done.any():
                result += self.left_over(symbol[done], owner[done], count)
            at = best[merging] & 0xFFFFFFFF
            symbol[at] = joined[at]
            stays = ~done
            stays[at + 1] = False
            symbol, owner = symbol[stays], owner[stays]
        return result

    def merge_long(self, sequence: str) -> int:
        """The same merges for one long sequence, by a priority queue over its neighbours."""
        symbol = self.symbols(sequence)
        after = [*range(1, len(symbol)), -1]
        before = list(range(-1, len(symbol) - 1))
        pairs, queue = self.pairs, []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and symbol[left] >= 0 and symbol[right] >= 0:
                found = pairs.get(symbol[left] << 32 | symbol[right])
                if found:
                    heapq.heappush(queue, (found[0], left, right, symbol[left], symbol[right], found[1]))

        for left in range(len(symbol) - 1):
            offer(left, left + 1)
        alive = [True] * len(symbol)
        while queue:
            _, left, right, was_left, was_right, joined = heapq.heappop(queue)
            if not (alive[left] and alive[right]) or symbol[left] != was_left or symbol[right] != was_right:
                continue
            symbol[left], alive[right] = joined, False
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        rest = np.array([s for s, there in zip(symbol, alive, strict=True) if there], np.int64)
        return int(self.left_over(rest, np.zeros(len(rest), np.int64), 1)[0])

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        split = [_pre_tokens(text) if text else [] for text in texts]
        new = set().union(*split) - self.seen.keys()
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = set().union(*split)
        self.seen.update((s, self.merge_long(s)) for s in new if len(s) > LONG)
        short = sorted((s for s in new if len(s) <= LONG), key=len)
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            self.seen.update(zip(part, self.merge(part).tolist(), strict=True))
        return [sum(map(self.seen.__getitem__, parts)) for parts in split]


def _pre_tokens(text: str) -> list[str]:
    """Cut a text, with the mark put in front of it, before each run of spaces."""
    if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
        return re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
    return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Bytes and tokens per text, and whether the tokens exceed ``limit``.

    ``model`` names a sentencepiece BPE model that every executor has at that path. Nulls are empty texts
    with no byte and no token; a null id stays null; repeated rows are counted each; other columns are dropped.
    """

    def run(batches):
        merger = Merger(model)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(batch), 200):
                part = texts.slice(at, 200).to_pylist()
                tokens = merger.count(part)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(at, 200),
                        "n_bytes": pa.array([len(t.encode()) if t else 0 for t in part], pa.int64()),
                        "n_tokens": pa.array(tokens, pa.int64()),
                        "over_limit": pa.array([n > limit for n in tokens]),
                    }
                )
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
