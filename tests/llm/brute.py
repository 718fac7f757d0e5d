"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None, size: int) -> frozenset:
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < size else frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def near_duplicates(docs: list[tuple], size: int, percent: int = 80) -> dict:
    """doc_id: (n_shingles, component_id, kept), by all pairs."""
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if not small or small * 100 < percent * large:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (small + large - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def cut_repeats(docs: list[tuple], window: int = 20) -> dict:
    """doc_id: (words, kept words)."""
    first, words = {}, {i: SPACE.findall(t or "") for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), (i, k))
    out = {}
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] != (i, k):
                gone.update(range(k, k + window))
        out[i] = (ws, [w for k, w in enumerate(ws) if k not in gone])
    return out


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
OPAQUE = re.compile("[A-Za-z0-9+/_-]+")
KINDS = ("assign", "access", "hex", "opaque")


def secret_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in order."""
    text = text or ""
    found = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 24]
    found += [(m.start(), 3, m.end(), m[0]) for m in OPAQUE.finditer(text) if len(m[0]) >= 32 and all(re.search(p, m[0]) for p in ("[A-Z]", "[a-z]", "[0-9]"))]
    return sorted(found)


def redacted(docs: list[tuple], marker: str = "[SECRET]", max_owners: int = 2, max_repos: int = 20) -> dict:
    """doc_id: text without live secrets, of (doc_id, source, text)."""
    owners: dict[str, set] = {}
    repos: dict[str, set] = {}
    spans = {i: secret_spans(t) for i, _, t in docs}
    for i, source, _ in docs:
        for *_, value in spans[i]:
            owners.setdefault(value, set()).add(source or "")
            repos.setdefault(value, set()).add(i)
    out = {}
    for i, _, text in docs:
        looks = lambda k, v: re.search("[A-Za-z0-9]", v) and (k < 2 or re.search("[0-9]", v) and re.search("[A-Za-z]", v))
        live = [(a, b) for a, k, b, v in spans[i] if len(owners[v]) <= max_owners and len(repos[v]) <= max_repos and looks(k, v)]
        merged: list[list[int]] = []
        for a, b in live:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            text = text[:a] + marker + text[b:]
        out[i] = text
    return out


def pieces(docs: list[tuple], capacity: int = 1024) -> set:
    """(doc_id, piece, start, length, ids_crc32) by the tokenizers library."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = set()
    for (i, _), e in zip(docs, t.encode_batch([x or "" for _, x in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 2], dtype="<u4")
        n = -(-len(ids) // capacity)
        head = len(ids) - (n - 1) * capacity
        cuts = [0, *(head + capacity * k for k in range(n))]
        out |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    return out


def packed_well(rows: list, capacity: int = 1024) -> int:
    """Asserts that the pieces fill their sequences gapless from 0; gives the number of sequences."""
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for at in held.values():
        upto = 0
        for offset, length in sorted(at):
            assert offset == upto
            upto += length
        assert upto <= capacity
    return len(held)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
