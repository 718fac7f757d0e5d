"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. At each position its output links name all pieces that end there, longest first;
each relaxes the best score of the position. Characters without a piece of their own cost the penalty of unknown
ones and are written as bytes. Decoding joins the pieces, and bytes to characters.

Pieces and scores are the model file's. Its pieces hold the space mark only in front, so a text falls into
independent parts before each mark, and parts seen before are taken from a bounded memory. New parts are read side by side: at the k-th
step the automaton takes the k-th character of each, and all pieces that end there relax their places together. (The file at hand was made for merging;
segments are the best by its scores, as the library finds them when told that the model is a unigram one. Merging, which the
library does with the file as it is, gives other ids for some texts; decoding is the same.)

Defined results: a null text counts as an empty one and has no pieces; repeated rows get equal results; a text that holds the
mark U+2581 itself decodes to a space there, and its ``round_trip`` is false; texts of any length are encoded whole; an empty table gives an empty one; columns beside doc_id and text are not read
and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, functions as F

from postgrove.llm.common import read_table

MARK = "▁"
PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNKNOWN_PENALTY = 10.0
#: Parts of so many characters are segmented one by one and not remembered; shorter ones together, so many characters at once.
LONG, TOGETHER = 64, 200_000


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start`` to ``start + size`` of each pair, one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Steps:
    """The automaton as arrays, to be stepped for many parts at once. States are the prefixes of pieces, by length."""

    def __init__(self, pieces: dict[str, int]):
        prefixes = sorted({p[:k] for p in pieces for k in range(len(p) + 1)}, key=len)
        number = {p: s for s, p in enumerate(prefixes)}
        parent = np.array([number[p[:-1]] for p in prefixes])
        fail = [0] * len(prefixes)
        ending: list[tuple] = [()] * len(prefixes)
        for s, p in enumerate(prefixes[1:], 1):
            fail[s] = next(number[p[k:]] for k in range(1, len(p) + 1) if p[k:] in number)
            ending[s] = (pieces[p], *ending[fail[s]]) if p in pieces else ending[fail[s]]
        #: Pieces that end in a state, longest first, and whether one of them is a single character.
        self.many = np.array([len(x) for x in ending])
        self.start = np.cumsum(self.many) - self.many
        self.found = np.fromiter(chain.from_iterable(ending), dtype=np.int64)
        self.alone = np.array([bool(p) and p[-1] in pieces for p in prefixes])
        #: Kinds of the characters of longer pieces, 0 for others; and the state of each that is a piece by itself only, which follows on any state.
        chars = sorted({c for p in pieces if len(p) > 1 for c in p})
        kind_of = {c: k for k, c in enumerate(chars, 1)}
        lone = [p for p in pieces if len(p) == 1 and p not in kind_of]
        self.kinds = np.zeros(max(map(ord, "".join(pieces))) + 2, dtype=np.int32)
        self.lone = self.kinds.copy()
        self.kinds[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.lone[[ord(c) for c in lone]] = [number[c] for c in lone]
        # Only states that go on have a row; others step as the state does to which they fall back.
        inner = np.zeros(len(prefixes), dtype=bool)
        inner[parent[1:]] = True
        inner[0] = True
        self.row = np.where(inner, np.cumsum(inner) - 1, 0)
        for s in np.flatnonzero(~inner).tolist():
            self.row[s] = self.row[fail[s]]
        kind = np.array([kind_of.get(p[-1:], 0) for p in prefixes])
        depth, fail = np.array([len(p) for p in prefixes]), np.array(fail)
        self.next = np.zeros((int(inner.sum()), len(chars) + 1), dtype=np.min_scalar_type(len(prefixes)))
        for d in range(depth.max() + 1):
            own = np.flatnonzero(inner & (depth == d))
            if d:
                self.next[self.row[own]] = self.next[self.row[fail[own]]]
            below = np.flatnonzero(depth == d + 1)
            below = below[kind[below] > 0]
            self.next[self.row[parent[below]], kind[below]] = below


class Model:
    def __init__(self, path: str, remember: int = 400_000):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.text = [library.id_to_piece(i) for i in range(n)]
        self.byte = {i: int(self.text[i][3:5], 16) for i in range(n) if library.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        plain = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.unknown = min(library.get_score(i) for i in plain) - UNKNOWN_PENALTY
        self.unknown_id = library.unk_id()
        self.silent = {i for i in range(n) if library.is_control(i)}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.text[i], i)
        self.automaton.make_automaton()
        if any(MARK in self.text[i].lstrip(MARK) for i in plain):
            raise ValueError("the model has pieces with a mark inside")
        self.size = np.array([len(x) for x in self.text])
        self.score = np.array([library.get_score(i) for i in range(n)])
        self.scored = [(len(self.text[i]), library.get_score(i), i) for i in range(n)]
        self.raw = [bytes((self.byte[i],)) if i in self.byte else b"" if i in self.silent else x.encode() for i, x in enumerate(self.text)]
        self.raw_size = np.array([len(x) for x in self.raw])
        self.steps = Steps({self.text[i]: i for i in plain})
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        """The memory of parts: numbers, and by number where the ids start, how many there are and whether they spell the part."""
        self.known: dict[str, int] = {}
        self.ids, self.start, self.count, self.spelt = np.zeros(0, dtype="<i4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def written(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.of_byte[b] for b in char.encode()] if self.of_byte else [self.unknown_id]

    def segment(self, part: str) -> list[int]:
        """Ids of one part, by the best total score; of equal ones, the longest last piece."""
        n = len(part)
        best, back, single = [0.0] + [-np.inf] * n, [None] * (n + 1), bytearray(n + 1)
        done = 0

        def close(upto: int) -> None:
            """Positions up to ``upto`` have had all pieces that end there: an unknown character may end there too."""
            nonlocal done
            for at in range(done + 1, upto + 1):
                if not single[at] and best[at - 1] + self.unknown > best[at]:
                    best[at], back[at] = best[at - 1] + self.unknown, (1, -1)
            done = upto

        for last, found in self.automaton.iter(part):
            size, score, piece = self.scored[found]
            at = last + 1
            if at - 1 > done:
                close(at - 1)
            if size == 1:
                single[at] = 1
            score += best[at - size]
            if score > best[at]:
                best[at], back[at] = score, (size, piece)
        close(n)
        ids, at = [], n
        while at:
            size, piece = back[at]
            ids += [piece] if piece >= 0 else self.written(part[at - 1])[::-1]
            at -= size
        return ids[::-1]

    def segment_all(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What ``segment`` gives for each of some short parts: all ids, and how many are of each part. Places are those of the joined text."""
        char, go = points("".join(parts)), self.steps
        length = np.array([len(p) for p in parts])
        first = np.cumsum(length + 1) - length - 1  # a place more than characters in each part
        known = np.minimum(char, len(go.kinds) - 1)  # the last one is in no piece
        kind, lone = go.kinds[known], go.lone[known]
        best, back = np.zeros(len(char) + len(parts)), np.full(len(char) + len(parts), -1)
        order = np.argsort(-length, kind="stable")
        begin, shift, state = first[order], first[order] - order, np.zeros(len(parts), dtype=np.int64)
        for k, many in enumerate(np.searchsorted(-length[order], -np.arange(1, length.max() + 1), side="right").tolist(), 1):
            here, at = shift[:many] + k - 1, begin[:many] + k
            state = np.maximum(go.next[go.row[state[:many]], kind[here]], lone[here])
            best[at] = best[at - 1] + self.unknown
            n = go.many[state]
            found, heads = go.found[spans(go.start[state], n)], np.cumsum(n) - n
            total = best[np.repeat(at, n) - self.size[found]] + self.score[found]
            some = n > 0
            at, n, heads, alone = at[some], n[some], heads[some], go.alone[state[some]]
            if not len(at):
                continue
            top = np.maximum.reduceat(total, heads)
            tops = np.flatnonzero(total == np.repeat(top, n))
            of = np.repeat(np.arange(len(at)), n)[tops]
            lead = tops[np.append(True, of[1:] != of[:-1])]  # of equal ones the first found stays, which is the longest
            better = alone | (top >= best[at])
            best[at[better]], back[at[better]] = top[better], found[lead[better]]
        of, at, turns = np.arange(len(parts)), first + length, []
        while len(of):
            found = back[at]
            turns.append((of, found, at - 1 - of))
            at = at - np.where(found >= 0, self.size[found], 1)
            going = at > first[of]
            of, at = of[going], at[going]
        of, found, last = (np.concatenate(x) for x in zip(*turns[::-1]))
        order = np.argsort(of, kind="stable")
        of, start, count = of[order], found[order], np.ones(len(order), dtype=np.int64)
        table, bare = np.arange(len(self.text)), np.flatnonzero(start < 0)
        chars = char[last[order[bare]]]
        for c in np.unique(chars).tolist():
            written = self.written(chr(c))
            start[bare[chars == c]], count[bare[chars == c]] = len(table), len(written)
            table = np.append(table, written)
        return table[spans(start, count)].astype("<i4"), np.bincount(of, weights=count, minlength=len(parts)).astype(np.int64)

    def spell(self, parts: list[str], ids: np.ndarray, ends: np.ndarray) -> list[bool]:
        """Whether the ids of each part spell it: by the bytes of all parts at once, and one by one only if these differ."""
        raw, sizes = "".join(parts).encode(), np.cumsum(np.append(0, self.raw_size[ids]))[ends]
        if b"".join([self.raw[i] for i in ids.tolist()]) == raw and (sizes == np.cumsum([len(p.encode()) for p in parts])).all():
            return [True] * len(parts)
        return [self.spelling(ids[a:b].tolist()) == p for p, a, b in zip(parts, [0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, parts: list[str]) -> None:
        """Adds parts to the memory."""
        short, long, held = [[]], [p for p in parts if len(p) >= LONG], 0
        for p in parts:
            if len(p) < LONG:
                short[-1].append(p)
                held += len(p)
                if held >= TOGETHER:
                    short.append([])
                    held = 0
        done = [(some, *self.segment_all(some)) for some in short if some]
        done += [([p], ids := np.array(self.segment(p), dtype="<i4"), np.array([len(ids)])) for p in long]
        for some, ids, count in done:
            ends = np.cumsum(count)
            spelt = self.spell(some, ids, ends)
            self.known.update(zip(some, range(len(self.start), len(self.start) + len(some))))
            self.start, self.count = np.append(self.start, len(self.ids) + ends - count), np.append(self.count, count)
            self.ids, self.spelt = np.append(self.ids, ids), np.append(self.spelt, spelt)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """All ids, how many are of each text, and whether those of each text, decoded, are the text."""
        parts_of = [PARTS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        parts = list(chain.from_iterable(parts_of))
        if len(self.known) >= self.remember or len(self.ids) >= 16 * self.remember:
            self.forget()
        new = list(set(parts).difference(self.known))
        self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts))
        for p in new:
            if len(p) >= LONG:
                del self.known[p]
        count = self.count[number]
        values = self.ids[spans(self.start[number], count)]
        cuts = np.cumsum([0, *map(len, parts_of)])
        ends, wrong = (np.append(0, np.cumsum(x))[cuts] for x in (count, ~self.spelt[number]))
        # Parts that are spelt right make the text: bytes of a character never lie in two parts.
        same = [MARK not in t if not w else self.decode(values[a:b].tolist()) == t for t, w, a, b in zip(texts, np.diff(wrong).tolist(), ends.tolist(), ends[1:].tolist())]
        return values, np.diff(ends), same

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        return self.encode_all([text])[0].tobytes()

    def spelling(self, ids: list[int]) -> str:
        """What pieces and bytes spell, with marks."""
        if self.byte.keys().isdisjoint(ids):
            return "".join([self.text[i] for i in ids if i not in self.silent])
        raw = b"".join([bytes((self.byte[i],)) if i in self.byte else self.text[i].encode() for i in ids if i not in self.silent])
        return raw.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.spelling(ids).replace(MARK, " ").removeprefix(" ")


def points(text: str) -> np.ndarray:
    """The text's characters as numbers."""
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


@lru_cache(maxsize=1)
def model_of(path: str | None) -> Model:
    """The model of a file, with its memory of parts, kept by a worker from task to task."""
    import public_tokenizers

    return Model(path or public_tokenizers.path("piece_bpe_32k.model"))


def encode(docs: DataFrame, model: str | None = None, part_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, ids, n_ids, ids_crc32, round_trip) of ``docs`` (doc_id, text); ``round_trip``: the ids, decoded, are the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)

        def rows(ids_of: list, texts: list[str]) -> pa.RecordBatch:
            values, count, same = m.encode_all(texts)
            ends = np.append(0, np.cumsum(count))
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            return pa.record_batch([pa.array(ids_of, pa.int64()), lists, pa.array(count, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"])

        for batch in batches:
            ids_of, texts, held = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids_of.append(i)
                texts.append(t.as_py() or "")
                held += len(texts[-1])
                if held >= part_chars:
                    yield rows(ids_of, texts)
                    ids_of, texts, held = [], [], 0
            if texts:
                yield rows(ids_of, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of ``encoded`` (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([m.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded, and whether decoding gives them back."""
    return encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
