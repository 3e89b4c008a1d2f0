"""Language identification by hyperdimensional profiles.

Each symbol of a folded alphabet has a random vector of +1 and -1. A letter trigram is the product of its letters'
vectors, rotated by their places; a text is the sum of its trigrams' vectors; a language is the sum of its texts.
A text gets the language whose prototype has the largest cosine with it.

A language's sum needs only its trigram counts, which are counted in Spark over all learning rows (at most
languages x 64**3 rows after partial aggregation, independent of the corpus). One task bundles a language's at most 64**3 trigrams; the driver
gets one vector a language.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from ._store import release, small_batches

DIMENSIONS, SYMBOLS, SEED = 1024, 64, 20
#: Languages a model may hold; more are an error, as the profiles are broadcast (4 KB a language).
MAX_LANGUAGES = 20_000
PORTION, TEXTS = 1 << 20, 256


def _symbol_table() -> np.ndarray:
    """Code point -> symbol: 0 for all but letters, 1-26 for a-z of either case, others folded to 27-63; the last entry is for code points from 0x10000."""
    table = np.zeros(0x10001, np.uint8)
    for code in range(0x10000):
        if unicodedata.category(chr(code)).startswith("L"):
            low = chr(code).lower()[0]
            table[code] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 2654435761 % (1 << 32) % 37
    return table


_tables: dict[str, np.ndarray] = {}


def symbol_table() -> np.ndarray:
    if "symbols" not in _tables:
        _tables["symbols"] = _symbol_table()
    return _tables["symbols"]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram code and text index of every trigram with a letter, and whether each text has a letter.

    Runs of other characters count as one boundary symbol; a text has one before and after it.
    """
    table = symbol_table()
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    symbol = table[np.minimum(points, 0x10000)]
    astral = np.flatnonzero(points >= 0x10000)
    for i in astral:
        symbol[i] = (27 + int(points[i]) * 2654435761 % (1 << 32) % 37) if unicodedata.category(chr(points[i])).startswith("L") else 0
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    new_text = np.concatenate([[True], owner[1:] != owner[:-1]])
    letter = symbol != 0
    lettered = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter | np.concatenate([[True], letter[:-1]]) | new_text
    symbol, owner = symbol[keep].astype(np.int64), owner[keep]
    if len(symbol) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
    before = np.concatenate([[0], symbol[:-1]])
    first_of = np.concatenate([[True], owner[1:] != owner[:-1]])
    before[first_of] = 0
    after = np.concatenate([symbol[1:], [0]])
    after[np.concatenate([first_of[1:], [True]])] = 0
    use = symbol != 0
    return (before[use] * SYMBOLS + symbol[use]) * SYMBOLS + after[use], owner[use], lettered


class Space:
    """Vectors of trigrams, made when first asked for."""

    def __init__(self, dimensions: int, seed: int):
        letters = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (SYMBOLS, dimensions)) * 2 - 1
        self.rotated = [np.roll(letters.astype(np.int8), k, axis=1) for k in (2, 1, 0)]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
        return (self.rotated[0][a] * self.rotated[1][b] * self.rotated[2][c]).astype(np.float32)


def bundles(texts: list[str], space: Space) -> tuple[np.ndarray, np.ndarray]:
    """The sum of trigram vectors of each text, and whether it has a letter."""
    codes, owner, lettered = trigrams(texts)
    if not len(codes):
        return np.zeros((len(texts), space.rotated[0].shape[1]), np.float32), lettered
    distinct, at = np.unique(codes, return_inverse=True)
    counts = np.bincount(owner * len(distinct) + at, minlength=len(texts) * len(distinct)).reshape(len(texts), -1)
    out = np.zeros((len(texts), space.rotated[0].shape[1]), np.float32)
    for k in range(0, len(distinct), 4096):
        out += counts[:, k : k + 4096].astype(np.float32) @ space.vectors(distinct[k : k + 4096])
    return out, lettered


def language_counts(rows: DataFrame) -> DataFrame:
    """lang, code, n over rows(text, lang)."""

    def count(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            own = np.array([number[x] for x in langs], np.int64)
            total: dict[int, int] = {}
            for part in T.portions([len(t) for t in texts], 4 * PORTION):
                codes, owner, _ = trigrams(texts[part])
                key, n = np.unique(own[part][owner] * SYMBOLS**3 + codes, return_counts=True)
                for k, v in zip(key.tolist(), n.tolist()):
                    total[k] = total.get(k, 0) + v
            key, n = np.array(list(total), np.int64), np.array(list(total.values()), np.int64)
            yield pa.record_batch([pa.array([names[i] for i in key // SYMBOLS**3], pa.string()), pa.array(key % SYMBOLS**3), pa.array(n)], ["lang", "code", "n"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, of length one, from rows(text, lang); rows without lang don't count."""
    counts = language_counts(rows.where("lang is not null").select("text", "lang"))

    def bundle(table: pa.Table) -> pa.Table:
        space, total = Space(dimensions, seed), np.zeros(dimensions)
        order = np.argsort(table.column("code").to_numpy())
        codes, ns = table.column("code").to_numpy()[order], table.column("n").to_numpy()[order].astype(np.float64)
        for k in range(0, len(codes), 4096):
            total += ns[k : k + 4096] @ space.vectors(codes[k : k + 4096])
        release()
        return pa.table({"lang": table.column("lang").slice(0, 1), "vector": pa.array([(total / max(np.linalg.norm(total), 1e-12)).tolist()])})

    found = counts.groupBy("lang").applyInArrow(bundle, "lang string, vector array<double>").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    found = sorted(found, key=lambda r: r["lang"])
    return [r["lang"] for r in found], np.array([r["vector"] for r in found]).reshape(len(found), dimensions)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], seed: int = SEED) -> DataFrame:
    """docs' columns, then lang_pred and score (the cosine, at least 0) for every row of docs.

    A null text, one without a letter, and any text if the model knows no language, is ``und`` with score 0. Of languages with one
    cosine the first in order wins. Only the text is looked at; columns of docs with the new names are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")))
    at = docs.columns.index("text")
    names, prototypes = model
    held = docs.sparkSession.sparkContext.broadcast((names, prototypes.astype(np.float32)))
    dimensions = prototypes.shape[1]

    def work(batches):
        names, prototypes = held.value
        space = Space(dimensions, seed)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            langs, scores = [], []
            for part in T.portions([max(len(t), PORTION // TEXTS) for t in texts], PORTION):
                vectors, lettered = bundles(texts[part], space)
                norm = np.linalg.norm(vectors, axis=1)
                if names:
                    cosine = (vectors @ prototypes.T) / np.maximum(norm, 1e-9)[:, None]
                    best = cosine.argmax(axis=1)
                    top = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                for i in range(part.stop - part.start):
                    known = bool(names) and bool(lettered[i])
                    langs.append(names[best[i]] if known else "und")
                    scores.append(float(top[i]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])
        release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    return docs.mapInArrow(work, schema)


def held_out(column: str, parts: int, left_out: int):
    """Whether crc32 of the id as text leaves that remainder; rows without id are not left out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == left_out, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; learnt from the documents that are not held out.

    Rows are predicted one by one, so repeated rows get one answer each; each counts in learning. Rows without doc_id are predicted and not learnt
    from. Columns other than doc_id, text and lang are ignored.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    model = fit(rows.where("not held_out and doc_id is not null"))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
