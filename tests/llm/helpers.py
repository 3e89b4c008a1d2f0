"""Small corpora with the awkward cases, and plain versions of the operators to hold results against."""

from __future__ import annotations

import collections
import math
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(rng: random.Random, n: int, size: int = 300) -> str:
    return " ".join(rng.choice("the of and to in is".split()) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) + str(rng.randint(0, size)) for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """Texts of all kinds: nulls in any column, empty, very long, copies, near copies, shared passages, repeated rows, not ASCII."""
    rng = random.Random(seed)
    passage = prose(rng, 90)
    base = prose(rng, 150)
    near = base.split()
    near[70] = "changed"
    rows = [prose(rng, rng.randint(20, 200)) for _ in range(20)]
    rows += [base, " ".join(near), base, base.upper() + " End", passage + " " + prose(rng, 50), prose(rng, 50) + " " + passage, prose(rng, 30) + passage + passage]
    rows += ["", None, " \n\t ", "!!! ???", "one", "Ünï cödé 漢字 😀 " + prose(rng, 20), "x" * 900, "ab" * 700, prose(rng, 4000), "a\\<|b<|end|>", "line one here\n" * 40, "\x00nul\x00 in text"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or "")) for i, t in enumerate(rows)]
    return out + [out[3], out[20], (None, base + " tail", None, None, None), (3, "another text with a doc id that is taken " + prose(rng, 20), "en", "s", 1)]


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(LOWER))


def stripped(texts: list[str | None], length: int) -> list[tuple[int, bytes]]:
    """(bytes removed, bytes kept) per text, by counting every window."""
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((sum(gone), bytes(b for b, g in zip(t, gone) if not g)))
    return out


def near_classes(texts: list[str | None], threshold: float, width: int = 5) -> list[int]:
    """Index of the first text of each text's class, from all pairs."""
    vectors, df = [], collections.Counter()
    for t in texts:
        w = words(t)
        v = collections.Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else collections.Counter()
        vectors.append(v)
        df.update(v.keys())
    n = len(texts)
    weights = [{k: c * (1 + math.log((n + 1) / (df[k] + 1))) for k, c in v.items()} for v in vectors]
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = weights[i], weights[j]
            least = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
            total = sum(a.values()) + sum(b.values()) - least
            if (texts[i] and texts[i] == texts[j]) or (total and least / total >= threshold):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(n)]
