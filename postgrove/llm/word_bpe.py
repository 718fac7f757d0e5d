"""BPE encoding and decoding by speculation: greedy longest match proposes a word's tokens, and a vectorised check of every
adjacent pair tells whether merging would have given the same.

Merging runs in order of rank, so a token's own merges have a fixed order in time. A sequence of tokens is what merging gives
exactly when no two neighbours would have been joined across their border, and whether two neighbours would depends on them alone:
the check undoes their merges, last one first, and looks at each step whether the symbols that then stood at the border make
a merge that comes earlier than the step just undone. All distinct pairs of a batch are checked at once in arrays; only
words with a failing pair are merged exactly. Texts are cut at the vocabulary's added tokens and at white space; the library's own
normaliser and word pattern are applied to each distinct stretch once, and stretches seen before come from a bounded memory.
Decoding joins the tokens by a space, since the vocabulary names no decoder.

Defined results: a null text counts as an empty one and has no ids; a null list of ids decodes to an empty text; null and unknown ids decode to nothing; a null doc_id is carried along;
repeated rows get equal results; texts and words of any length are encoded whole; an empty table gives an empty one; columns beside doc_id and text (or ids) are not read and may have any name.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postgrove.llm.common import read_table
from postgrove.llm.packing import added_tokens

# The characters of the Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_STRETCH = re.compile(f"[^{SPACES}]+")
#: str.split() parts at these too, though they are no white space of Unicode.
_SEPARATORS = re.compile("[\x1c-\x1f]")
NEVER = np.iinfo(np.int64).max
#: Words of more symbols are merged one at a time.
LONG = 64
#: Below this character the word pattern is applied in its simple form.
SIMPLE = "\u0250"


class Vocabulary:
    """A vocabulary with merges in order, in which a merge always comes after those that made its two sides."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain BPE vocabularies are supported")
        library = Tokenizer.from_file(path)
        if library.decoder is not None:
            raise ValueError("vocabularies with a decoder of their own are not supported")
        self.normalizer, self.words = library.normalizer, library.pre_tokenizer
        self.added, self.end = added_tokens(path), model["end_of_word_suffix"] or ""
        # Which characters are letters and which digits, the library says.
        letters, digits = "", ""
        for c in filter(str.strip, map(chr, range(ord(SIMPLE)))):
            if len(self.words.pre_tokenize_str("a" + c)) == 1:
                letters += c
            elif len(self.words.pre_tokenize_str(c + c)) == 2:
                digits += c
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{SPACES}{letters}{digits}]+")
        # Byte-level symbols: printable characters of Latin-1 stand for themselves, all other bytes for characters from 256 on.
        shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
        self.symbols = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        del self.symbols[ord(" ")], self.symbols[ord("\n")]
        ids = model["vocab"]
        n = self.size = max(*ids.values(), *self.added.values()) + 1
        self.text: list[str] = [""] * n
        for t, i in (*ids.items(), *self.added.items()):
            self.text[i] = t
        self.rank, self.left, self.right = (np.full(n, -1, dtype=np.int64) for _ in range(3))
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(ids[x], ids[y], ids[x + y]) for x, y in merges], dtype=np.int64)
        a, b, made = pairs.T
        at = np.arange(len(pairs))
        self.rank[made], self.left[made], self.right[made] = at, a, b
        if len(np.unique(made)) < len(made) or (self.rank[a] >= at).any() or (self.rank[b] >= at).any():
            raise ValueError("a token has two merges, or one that comes before those of its sides")
        order = np.argsort(a * n + b)
        self.keys, self.key_rank = (a * n + b)[order], at[order]
        self.made = made
        self.merge = {(x, y): (k, z) for k, (x, y, z) in enumerate(pairs.tolist())}
        #: Tokens that merging can give: single symbols and results of merges; those that end a word, and all others.
        given = {t: i for t, i in ids.items() if self.rank[i] >= 0 or len(t.removesuffix(self.end)) == 1}
        self.last = {t.removesuffix(self.end): i for t, i in given.items() if t.endswith(self.end)}
        self.inner = {t: i for t, i in given.items() if not self.end or not t.endswith(self.end)}
        self.longest_last = max(map(len, self.last))
        #: The length of the longest inner token by its first two characters.
        self.reach: dict[str, int] = {}
        for t in self.inner:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))

    def words_of(self, stretches: list[str]) -> list[list[str]]:
        """The words of normalised stretches, as symbols of bytes: by the pattern in its simple form where all characters are of SIMPLE, else as the library cuts them."""
        rare = [k for k, s in enumerate(stretches) if s and max(s) >= SIMPLE]
        if not rare:
            return [x.split() for x in self.cut.sub(r"\g<0> ", "\n".join(stretches)).encode().decode("latin-1").translate(self.symbols).split("\n")]
        by_library = {k: [w for w, _ in self.words.pre_tokenize_str(stretches[k])] for k in rare}
        plain = self.words_of(["" if k in by_library else s for k, s in enumerate(stretches)])
        return [by_library.get(k, p) for k, p in enumerate(plain)]

    def propose(self, word: str) -> list[int]:
        """Greedy: the longest token at each place; the last one must end the word."""
        ids, at, n = [], 0, len(word)
        while True:
            if n - at <= self.longest_last and (found := self.last.get(word[at:])) is not None:
                ids.append(found)
                return ids
            for upto in range(min(n - 1, at + self.reach.get(word[at : at + 2], 1)), at, -1):
                if (found := self.inner.get(word[at:upto])) is not None:
                    ids.append(found)
                    at = upto
                    break
            else:
                raise ValueError(f"no token for {word[at]!r}")

    def ranks_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of tokens, NEVER where there is none."""
        key = x * self.size + y
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.key_rank[k], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging would leave the border between tokens ``a`` and ``b`` alone, for arrays of pairs.

        A merge of rank r happens at the time 3r, 3r+1 or 3r+2, for one inside the left token, across the border or inside the right one: of equal ranks the leftmost comes first."""
        fine, open_ = np.ones(len(a), dtype=bool), np.arange(len(a))
        x, y, undone = a.copy(), b.copy(), np.full(len(a), NEVER)
        while len(open_):
            rank = self.ranks_of(x, y)
            across = np.where(rank < NEVER, 3 * rank + 1, NEVER)
            fine[open_[across < undone]] = False
            one, two = 3 * self.rank[x], 3 * self.rank[y] + 2
            left, right = (self.rank[x] >= 0) & ((one > two) | (self.rank[y] < 0)), self.rank[y] >= 0
            right &= ~left
            go = (across >= undone) & (left | right)
            undone = np.where(left, one, two)[go]
            x, y = np.where(left, self.right[x], x)[go], np.where(right, self.left[y], y)[go]
            open_ = open_[go]
        return fine

    def merged(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word by merging, lowest rank first and of equal ranks the leftmost; a step of all words at once."""
        said: list[list[int]] = [[]] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for k, w in enumerate(words):
            if len(w) > LONG:
                said[k] = self.merged_long(w)
        inner, last = self.inner, self.last
        ids = np.fromiter((i for k in short for i in (*(inner[c] for c in words[k][:-1]), last[words[k][-1]])), dtype=np.int64)
        of = np.repeat(np.array(short, dtype=np.int64), [len(words[k]) for k in short])
        while len(ids):
            rank = np.full(len(ids), NEVER)
            rank[:-1] = np.where(of[1:] == of[:-1], self.ranks_of(ids[:-1], ids[1:]), NEVER)
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            sizes = np.diff(np.append(starts, len(ids)))
            best = np.minimum.reduceat(rank, starts)
            for k, a, n in zip(of[starts[best == NEVER]].tolist(), starts[best == NEVER].tolist(), sizes[best == NEVER].tolist()):
                said[k] = ids[a : a + n].tolist()
            best = np.repeat(best, sizes)
            at = np.flatnonzero((rank == best) & (best < NEVER))
            at = at[np.append(True, of[at[1:]] != of[at[:-1]])] if len(at) else at
            ids[at] = self.made[rank[at]]
            kept = best < NEVER
            kept[at + 1] = False
            ids, of = ids[kept], of[kept]
        return said

    def merged_long(self, word: str) -> list[int]:
        """The same for one word of any length, with a heap of its pairs."""
        ids = [self.inner[c] for c in word[:-1]] + [self.last[word[-1]]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(*self.merge[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        waiting = [(rank, k, x, y, made) for rank, made, k, x, y in waiting]
        heapq.heapify(waiting)
        while waiting:
            _, k, x, y, made = heapq.heappop(waiting)
            other = after[k]
            if ids[k] != x or other >= n or ids[other] != y:
                continue
            ids[k], ids[other] = made, -1
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] < n and (p := (ids[i], ids[after[i]])) in self.merge:
                    rank, made_next = self.merge[p]
                    heapq.heappush(waiting, (rank, i, *p, made_next))
        return [i for i in ids if i >= 0]

    def tokens(self, words: list[str]) -> list[list[int]]:
        """The ids of each word: proposals, and exact merging where a pair of neighbours fails."""
        said = [self.propose(w) for w in words]
        flat = np.fromiter((i for s in said for i in s), dtype=np.int64)
        of = np.repeat(np.arange(len(said)), [len(s) for s in said])
        inside = np.flatnonzero(of[1:] == of[:-1])
        key, at = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        failing = np.unique(of[inside[~self.compatible(key // self.size, key % self.size)[at]]])
        for k, ids in zip(failing.tolist(), self.merged([words[k] for k in failing.tolist()])):
            said[k] = ids
        return said


class Coder:
    """Encodes batches of texts with a memory of stretches that ends with ``remember`` of them or ``held`` characters."""

    def __init__(self, vocabulary: Vocabulary, remember: int = 600_000, held: int = 16_000_000):
        self.v, self.remember, self.most = vocabulary, remember, held
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None
        self.forget()

    def forget(self) -> None:
        self.seen = {t: np.array([i], dtype="<i4").tobytes() for t, i in self.v.added.items()}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def stretches(self, text: str) -> list[str]:
        """A text's stretches without white space, and added tokens."""
        if self.cuts and self.cuts.search(text):
            parts = self.cuts.split(text)
            return [s for k, part in enumerate(parts) for s in ([part] if k % 2 else self.stretches(part))]
        return _STRETCH.findall(text) if _SEPARATORS.search(text) else text.split()

    def learn(self, new: list[str]) -> None:
        """Puts the ids of stretches into the memory. They are normalised and cut into words in one go: neither reaches across a space."""
        parts = self.v.words_of(self.v.normalizer.normalize_str(" ".join(new)).split(" "))
        unknown = list(set().union(*parts) - self.words.keys())
        self.words.update(zip(unknown, [np.array(i, dtype="<i4").tobytes() for i in self.v.tokens(unknown)]))
        word = self.words
        self.seen.update(zip(new, [word[p[0]] if len(p) == 1 else b"".join([word[w] for w in p]) for p in parts]))
        self.held += sum(map(len, new))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers."""
        if len(self.seen) > self.remember or self.held > self.most:
            self.forget()
        parts = [self.stretches(t) for t in texts]
        new = set().union(*parts) - self.seen.keys()
        if new:
            self.learn(list(new))
        said = self.seen.__getitem__
        return [b"".join(map(said, p)) for p in parts]


@lru_cache(2)
def coder_of(path: str) -> Coder:
    """One coder per worker process: tasks that follow each other there share its memory."""
    return Coder(Vocabulary(path))


def encode(docs: DataFrame, vocabulary: str | None = None, part_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, ids) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        coder = coder_of(vocabulary or public_tokenizers.path("word_bpe_49k.json"))

        def rows(at: pa.Array, texts: list[str]) -> pa.RecordBatch:
            blobs = coder.encode(texts)
            ends = np.cumsum([0, *(len(b) // 4 for b in blobs)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), dtype="<i4"), pa.int32()))
            return pa.record_batch([at, ids], ["doc_id", "ids"])

        for batch in batches:
            texts, begin, held = [], 0, 0
            for k, t in enumerate(batch.column(1)):
                texts.append(t.as_py() or "")
                held += len(texts[-1])
                if held >= part_chars:
                    yield rows(batch.column(0).slice(begin, k + 1 - begin), texts)
                    texts, begin, held = [], k + 1, 0
            if texts:
                yield rows(batch.column(0).slice(begin), texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None, part_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, ids, text) of ``encoded`` (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        v = coder_of(vocabulary or public_tokenizers.path("word_bpe_49k.json")).v
        names = np.array(v.text, dtype=object)
        known = names != ""

        def text(row: pa.ListScalar) -> str:
            if not row.is_valid:
                return ""
            ids = row.values.drop_null().to_numpy()
            ids = ids[(ids >= 0) & (ids < v.size)]
            return " ".join(names[ids[known[ids]]].tolist())

        for batch in batches:
            said, begin, held = [], 0, 0
            for k, row in enumerate(batch.column(1)):
                said.append(text(row))
                held += len(row.values) if row.is_valid else 0
                if held >= part_ids or k + 1 == batch.num_rows:
                    yield pa.record_batch([*(c.slice(begin, k + 1 - begin) for c in batch.columns), pa.array(said, pa.string())], ["doc_id", "ids", "text"])
                    said, begin, held = [], k + 1, 0

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def op13_word_bpe(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded, and their ids decoded."""
    said = decode(encode(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return said.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
