"""Greedy longest-match token counts by an automaton, without building pieces.

The vocabulary is a trie over bytes, where a byte that ends a word is a symbol of
its own: a token that ends words matches only there, any other only elsewhere. Each
node has a failure link and the number of pieces popped on following it, both computed once,
so a word is counted in time linear in its length: on a symbol without an edge the
count grows by the popped pieces and the state moves along the link. All distinct
words of a chunk step through the automaton together in numpy. A word of more than
``LONG`` bytes is cut into segments that step together too: each first as if it began at
the root, then again from the state in which the one before ends, until that run stands
where the first one stood at the same byte, as from there on both are the same.

Words are runs of bytes other than U+0020 and U+0009 to U+000D, with A-Z lowered.
A word that the vocabulary cannot cover counts as one unknown token.

Cases: a null or empty text has no tokens; texts and words of any length are taken
whole; repeated rows repeat; an empty table stays empty; a column of the input
that has the output's name is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_columns import with_columns
from .byte_bpe import byte_characters
from .words import Words, buffers, chunks

#: Added to a byte that ends a word.
FINAL = 256
#: Bytes of a word that is cut, and of a segment.
LONG, SEGMENT = 256, 128


class LongestMatch:
    def __init__(self, tokens: Iterable[tuple[int, ...]]):
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for token in tokens:
            node = 0
            for symbol in token:
                if symbol not in edges[node]:
                    edges[node][symbol] = len(edges)
                    edges.append({})
                    final.append(False)
                node = edges[node][symbol]
            if node:
                final[node] = True
        link, pops = [-1] * len(edges), [0] * len(edges)
        queue = [0]
        for parent in queue:
            for symbol, node in edges[parent].items():
                queue.append(node)
                if final[node]:
                    link[node], pops[node] = 0, 1
                    continue
                at, popped = link[parent], pops[parent]
                while at >= 0 and symbol not in edges[at]:
                    popped += pops[at]
                    at = link[at]
                if at >= 0:
                    link[node], pops[node] = edges[at][symbol], popped
        inner = [n for n in range(len(edges)) if edges[n]]
        self._row = np.full(len(edges), len(inner), np.int32)  # the last row has no edges
        self._row[inner] = np.arange(len(inner), dtype=np.int32)
        self._next = np.full((len(inner) + 1, 2 * FINAL), -1, np.int32)
        for row, node in enumerate(inner):
            self._next[row, list(edges[node])] = list(edges[node].values())
        self._link, self._pops = np.array(link, np.int32), np.array(pops, np.int64)

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word ``data[start:end]``; 1 where no cover exists."""
        out, long = np.empty(len(start), np.int64), end - start > LONG
        out[~long] = self._short(data, start[~long], end[~long])
        if long.any():
            out[long] = self._long(data, start[long], end[long])
        return out

    def _short(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        order = np.argsort(start - end, kind="stable")  # longest first: those still running are a prefix
        begin, size = start[order], (end - start)[order]
        state, count, bad = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64), np.zeros(len(order), bool)
        for step in range(int(size[0]) if len(size) else 0):
            live = np.searchsorted(-size, -step, "left")
            symbol = data[begin[:live] + step].astype(np.int32)
            symbol[np.searchsorted(-size, -(step + 1), "left") :] += FINAL
            self._move(state, count, bad, np.flatnonzero(~bad[:live]), symbol)
        self._finish(state, count, bad)
        out = np.empty(len(order), np.int64)
        out[order] = np.where(bad, 1, count)
        return out

    def _long(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        parts = -(-(end - start) // SEGMENT)
        word = np.repeat(np.arange(len(start)), parts)
        k = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = start[word] + k * SEGMENT
        stop = np.minimum(begin + SEGMENT, end[word])
        size, ends = stop - begin, stop == end[word]
        n = len(word)
        states, counts = np.empty((SEGMENT, n), np.int32), np.empty((SEGMENT, n), np.int64)

        def symbols(of: np.ndarray, step: int) -> np.ndarray:
            return data[begin[of] + step].astype(np.int32) + FINAL * (ends[of] & (size[of] == step + 1))

        state, count, bad = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
        symbol = np.zeros(n, np.int32)
        for step in range(SEGMENT):
            live = np.flatnonzero(~bad & (step < size))
            symbol[live] = symbols(live, step)
            self._move(state, count, bad, live, symbol)
            states[step], counts[step] = state, count
        first, entry, total = state.copy(), np.zeros(n, np.int32), count.copy()
        while True:  # every round settles at least one more segment of each word
            came = np.where(k == 0, 0, np.roll(state, 1))
            live = np.flatnonzero(came != entry)
            if not len(live):
                break
            entry[live] = came[live]
            now, gone, lost = entry.copy(), np.zeros(n, np.int64), entry < 0
            state[live], total[live] = first[live], 0  # as after meeting the first run
            for step in range(SEGMENT):
                live = live[(step < size[live]) & ~lost[live]]
                symbol[live] = symbols(live, step)
                self._move(now, gone, lost, live, symbol)
                met = now[live] == states[step, live]
                at = live[met]
                total[at] = gone[at] + count[at] - counts[step, at]
                live = live[~met]
                over = live[(size[live] == step + 1) | lost[live]]
                state[over], total[over] = now[over], gone[over]
                if not len(live):
                    break
            state[entry < 0] = -1
        last = np.cumsum(parts) - 1
        bad = np.add.reduceat((state < 0).astype(np.int64), last - parts + 1) > 0
        out, tail = np.add.reduceat(total, last - parts + 1), state[last].copy()
        self._finish(tail, out, bad)
        return np.where(bad, 1, out)

    def _finish(self, state, count, bad) -> None:
        """Count the pieces that the ends of words still hold."""
        todo = np.flatnonzero(~bad & (state != 0))
        while len(todo):
            count[todo] += self._pops[state[todo]]
            state[todo] = self._link[state[todo]]
            bad[todo[state[todo] < 0]] = True
            todo = todo[state[todo] > 0]

    def _move(self, state, count, bad, todo, symbol) -> None:
        while len(todo):
            to = self._next[self._row[state[todo]], symbol[todo]]
            found = to >= 0
            state[todo[found]] = to[found]
            todo = todo[~found]
            count[todo] += self._pops[state[todo]]
            state[todo] = self._link[state[todo]]
            lost = state[todo] < 0
            bad[todo[lost]] = True
            todo = todo[~lost]


def word_end_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Symbols of the tokens of a byte-level vocabulary whose ``</w>`` ends a word; special tokens are left out."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    special = {t["content"] for t in whole.get("added_tokens", [])}
    byte = {c: b for b, c in enumerate(byte_characters())}
    out = []
    for token in whole["model"]["vocab"]:
        if token not in special:
            body = [byte[c] for c in token.removesuffix("</w>")]
            body[-1] += FINAL * token.endswith("</w>")
            out.append(tuple(body))
    return out


@lru_cache(4)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(word_end_vocabulary(path))


def count_tokens(column: pa.Array, matcher: LongestMatch) -> np.ndarray:
    off, data = buffers(column)
    out = np.zeros(len(column), np.int64)
    for a, b in chunks(off):
        words = Words(off, data, a, b, lower=True)
        if not len(words.hash):
            continue
        _, one, which = np.unique(words.hash, return_index=True, return_inverse=True)
        text = words.data.copy()
        capital = (text >= 65) & (text <= 90)
        text[capital] += 32
        total = np.concatenate([[0], np.cumsum(matcher.counts(text, words.start[one], words.end[one])[which])])
        out[a:b] = total[words.first[1:]] - total[words.first[:-1]]
    return out


def with_counts(df: DataFrame, path: str, text: str = "text", name: str = "n_tokens", without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the number of longest-match tokens of ``text`` by the vocabulary at ``path``."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {name: pa.array(count_tokens(batch.column(batch.schema.get_field_index(text)), automaton(path)))}

    return with_columns(df, f"`{name}` long", run, without)
