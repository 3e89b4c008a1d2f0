"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays that workers map into memory.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, then one end token per text; the context of the first token is a
start mark. With c the counts, N_k(u.) the continuations of u seen k times, a(w) the number of contexts of w:

    P(w | u) = (c(u w) - D(c(u w))) / c(u.) + (D1 N1(u.) + D2 N2(u.) + D3 N3+(u.)) / c(u.) * P(w)
    P(w)     = (a(w) - E(a(w))) / a(.)      + (E1 n1 + E2 n2 + E3 n3+) / a(.) / (V + 1)

Words are known by 40 bits of their hash where contexts and continuations are added up, by 64 bits where tokens are counted. A pair of words,
80 bits, is mixed one-to-one to 64 + 16 bits; the 64 are its key, the 16 go along while its words are needed. The slice of a pair is a range
of keys, so the pairs of a frequent word are spread evenly. Each task sends one packed, counted array per slice. A slice's task adds
them up, writes its sorted keys and counts to one file of the shared folder, and passes on, per word, what it knows of
contexts and continuations; a second round adds these. To score, a worker maps the model's files, at most MAPS at a time (from a store
that is not mounted they are fetched, mapped and unlinked), and looks up
each portion's sorted hashes. The driver sees a few sums per slice. The model grows with the corpus.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from . import _exchange as X, _text as T
from ._store import map_array, release, shared_folder, small_batches, write_array
from .language_id import held_out

#: Bits of a word's hash in a pair, in contexts and in continuations, and how a pair of them is cut.
WORD_BITS = 40
_DROP, _SPLIT, _KEEP = np.uint64(64 - WORD_BITS), np.uint64(16), np.uint64(24)
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)
START, FINISH = np.uint64(0x51F0A3C1D2B49687), np.uint64(0xE7D1B0A98C3F4265)
#: Bytes of text counted or scored at a time.
PORTION = 6 << 20
#: Files of the model that a process maps at a time.
MAPS = 16_000


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of _text.mix."""
    h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    h = h * np.uint64(pow(int(T._M2), -1, 1 << 64))
    h = h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))
    h = h * np.uint64(pow(int(T._M1), -1, 1 << 64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token with its text's end token, hash of the token before it (or the start mark), and text index."""
    word, _, _, owner = T.words(texts, spaced=True)
    n = len(word) + len(texts)
    counts = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(counts + 1) - 1
    out = np.full(n, FINISH)
    inner = np.ones(n, bool)
    inner[ends] = False
    out[inner] = word
    before = np.concatenate([[START], out[:-1]]) if n else out
    before[ends[:-1] + 1] = START
    return out, before, np.repeat(np.arange(len(texts)), counts + 1)


def short(word: np.ndarray) -> np.ndarray:
    """The WORD_BITS by which contexts and continuations are known."""
    return word >> _DROP


def pair_low(word: np.ndarray) -> np.ndarray:
    """The 16 bits that it takes to get a pair back from its key."""
    return (short(word) & np.uint64(0xFFFF)).astype(np.uint16)


def pair_keys(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return T.mix(((short(before) << _KEEP) | (short(word) >> _SPLIT)) + pair_low(word).astype(np.uint64) * _SPREAD)


def pair_words(keys: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word before and word, by WORD_BITS, of each pair."""
    low = low.astype(np.uint64)
    high = unmix(keys) - low * _SPREAD
    return high >> _KEEP, ((high & np.uint64(0xFFFFFF)) << _SPLIT) | low


def counted_pairs(keys: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their counts, and their 16 bits."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    return keys[first], np.diff(np.append(first, len(keys))), low[order[first]]


def _sliced(keys: np.ndarray, slices: int, kind: int, *columns: np.ndarray):
    cuts = np.append(np.searchsorted(keys, X.slice_bounds(slices)), len(keys))
    for q, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if b > a:
            yield q, kind, X.frame([X.pack_sorted(keys[a:b]), *(X.pack_array(c[a:b]) for c in columns)])


def _joined(*columns: np.ndarray) -> np.ndarray:
    """Columns as one file: the length and width of each, then their bytes, every column at a multiple of 8."""
    raw = [np.ascontiguousarray(c).reshape(-1).view(np.uint8) for c in columns]
    head = np.array([len(raw), *(len(x) for x in raw)], np.int64).view(np.uint8)
    return np.concatenate([head, *(np.concatenate([x, np.zeros(-len(x) % 8, np.uint8)]) for x in raw)])


def _parted(data: np.ndarray, *kinds) -> list[np.ndarray]:
    sizes = data[8 : 8 * (1 + len(kinds))].view(np.int64)
    ends = 8 * (1 + len(kinds)) + np.cumsum(sizes + -sizes % 8)
    return [data[e - (n + -n % 8) : e - (n + -n % 8) + n].view(k) for e, n, k in zip(ends.tolist(), sizes.tolist(), kinds)]


def _sum_by(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    every, at = np.unique(keys, return_inverse=True)
    return every, [np.bincount(at, c, minlength=len(every)).astype(np.int64) for c in columns]


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[float]) -> np.ndarray:
    """D for counts 0, 1, 2, 3+ from the numbers of entries counted 1, 2, 3, 4 times; where these are too few, 0.5, 0.75, 0.9."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(x, 0.01), k - 0.01) for x, k in zip(d, (1, 2, 3)))])


class Model:
    """What scoring needs besides the arrays; made by fit()."""

    def __init__(self, folder: str, slices: int, totals: dict[str, float]):
        self.folder, self.slices, self.totals = folder, slices, totals
        self.pair_discount = discounts([totals[f"pairs_{k}"] for k in (1, 2, 3, 4)])
        self.word_discount = discounts([totals[f"conts_{k}"] for k in (1, 2, 3, 4)])


def fit(docs: DataFrame) -> Model:
    """A model of docs(text); a null text is empty and still has its end token. Every row counts, repeated rows too."""
    spark = docs.sparkSession
    slices = X.partitions_for(docs)
    small_batches(spark)
    folder = f"{shared_folder(spark)}/kneser-ney-{uuid.uuid4().hex}"

    def count(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for part in T.portions([len(t) for t in texts], PORTION):
                word, before, _ = tokens(texts[part])
                rows = []
                keys, counts, low = counted_pairs(pair_keys(word, before), pair_low(word))
                rows += _sliced(keys, slices, 0, counts.astype(np.uint32), low)
                keys, counts = np.unique(word, return_counts=True)
                rows += _sliced(keys, slices, 1, counts.astype(np.uint32))
                q, kind, data = zip(*rows)
                yield pa.record_batch([pa.array(q, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["q", "kind", "data"])
        release()

    def slice_counts(table: pa.Table) -> pa.Table:
        q = table.column("q")[0].as_py()
        kinds, blobs = table.column("kind").to_pylist(), table.column("data").to_pylist()
        rows: list[tuple[int, bytes]] = []
        every = {}
        for kind in (0, 1):
            own = [b for k, b in zip(kinds, blobs) if k == kind]
            every[kind] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if own:
                asked, keys, (counts,) = X.totals(own, 1)
                every[kind] = keys, counts
                if not kind:
                    low = np.zeros(len(keys), np.uint16)
                    for h, data in zip(asked, own):
                        low[np.searchsorted(keys, h)] = X.unpack_array(X.unframe(data)[2], np.uint16)
        (keys, counts), (words, word_counts) = every[0], every[1]
        clipped = [np.minimum(c, 0xFFFFFFFF).astype(np.uint32) for c in (counts, word_counts)]
        write_array(folder, f"counts-{q}", _joined(keys, clipped[0], words, clipped[1]))
        sums = {"tokens": int(word_counts.sum()), "words": len(words)} | {f"pairs_{k}": v for k, v in zip((1, 2, 3, 4), _counts_of_counts(counts))}
        if len(keys):
            before, after = pair_words(keys, low)
            context = _sum_by(before, [counts, counts == 1, counts == 2, counts > 2])
            reached = _sum_by(after, [np.ones(len(after))])
            for at, (words, columns) in enumerate((context, reached)):
                cuts = np.append(np.searchsorted(words, np.array([(i << WORD_BITS) // slices for i in range(slices)], np.uint64)), len(words))
                for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if b > a:
                        rows.append((r, X.frame([bytes([at]), X.pack_sorted(words[a:b]), *(X.pack_array(c[a:b]) for c in columns)])))
        r, data = [x[0] for x in rows] + [-1], [x[1] for x in rows] + [str(sums).encode()]
        release()
        return pa.table({"r": pa.array(r, pa.int32()), "data": pa.array(data, pa.binary())})

    def word_stats(table: pa.Table) -> pa.Table:
        r, blobs = table.column("r")[0].as_py(), table.column("data").to_pylist()
        if r < 0:
            return pa.table({"sums": pa.array([b.decode() for b in blobs], pa.string())})
        keys, parts = [], []
        for blob in blobs:
            at, words, *columns = X.unframe(blob)
            words = X.unpack_sorted(words)
            columns = [X.unpack_array(c, np.int64) for c in columns]
            wide = np.zeros((5, len(words)))
            wide[0 if at[0] == 0 else 4 : 4 if at[0] == 0 else 5] = columns
            keys.append(words)
            parts.append(wide)
        words, columns = _sum_by(np.concatenate(keys), list(np.concatenate(parts, axis=1)))
        write_array(folder, f"words-{r}", _joined(words, np.stack(columns, axis=1).astype(np.float64)))
        reached = columns[4][columns[4] > 0]
        sums = {f"conts_{k}": v for k, v in zip((1, 2, 3, 4), _counts_of_counts(reached))} | {"conts": int(reached.sum()), "reached": len(reached)}
        return pa.table({"sums": pa.array([str(sums)], pa.string())})

    counted = X.by_number(docs.select("text").mapInArrow(count, "q int, kind int, data binary"), slices, "q")
    passed = X.by_number(counted.groupBy("part", "q").applyInArrow(slice_counts, "r int, data binary"), slices, "r")
    rows = passed.groupBy("part", "r").applyInArrow(word_stats, "sums string").collect()
    names = [f"{n}_{k}" for n in ("pairs", "conts") for k in (1, 2, 3, 4)]
    totals = dict.fromkeys(["tokens", "words", "conts", "reached", *names], 0)
    for row in rows:
        for item in row["sums"].strip("{}").split(", "):
            key, value = item.split(": ")
            totals[key.strip("'")] += int(value)
    return Model(folder, slices, totals)


class Tables:
    """The mapped arrays of one model, in files by slice. Slices are ranges, so a sorted query meets them one after another."""

    def __init__(self, model: Model):
        self.model = model
        fs, path = pafs.FileSystem.from_uri(model.folder)
        self.names = {f.base_name for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))}
        self.held: OrderedDict[str, np.ndarray] = OrderedDict()
        self.wide = X.slice_bounds(model.slices)
        self.narrow = np.array([(i << WORD_BITS) // model.slices for i in range(model.slices)], np.uint64)

    def file(self, name: str) -> np.ndarray | None:
        """A file of the model, mapped; the one not used for longest is given up beyond MAPS."""
        if name not in self.names:
            return None
        if name in self.held:
            self.held.move_to_end(name)
        else:
            self.held[name] = map_array(self.model.folder, name, np.uint8)
            if len(self.held) > MAPS:
                self.held.popitem(last=False)
        return self.held[name]

    def pairs(self, q: int):
        data = self.file(f"counts-{q}")
        return None if data is None else _parted(data, np.uint64, np.uint32, np.uint64, np.uint32)[:2]

    def words(self, q: int):
        data = self.file(f"counts-{q}")
        return None if data is None else _parted(data, np.uint64, np.uint32, np.uint64, np.uint32)[2:]

    def stats(self, q: int):
        data = self.file(f"words-{q}")
        if data is None:
            return None
        keys, values = _parted(data, np.uint64, np.float64)
        return keys, values.reshape(-1, 5)

    def look_up(self, table, bounds, keys: np.ndarray, width: int = 0) -> np.ndarray:
        """The values of the keys, 0 where a key is absent."""
        distinct, back = np.unique(keys, return_inverse=True)
        out = np.zeros((len(distinct), width) if width else len(distinct))
        cuts = np.append(np.searchsorted(distinct, bounds), len(distinct))
        for q in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[q], cuts[q + 1]
            found = table(q)
            if found is not None and len(found[0]):
                own, values = found
                at = np.minimum(np.searchsorted(own, distinct[a:b]), len(own) - 1)
                hit = own[at] == distinct[a:b]
                out[a:b][hit] = values[at[hit]]
        return out[back]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and score of each text."""
        m, t = self.model, self.model.totals
        word, before, owner = tokens(texts)
        n = len(texts)
        count = self.look_up(self.words, self.wide, word)
        pair = self.look_up(self.pairs, self.wide, pair_keys(word, before))
        reached = self.look_up(self.stats, self.narrow, short(word), 5)[:, 4]
        context = self.look_up(self.stats, self.narrow, short(before), 5)
        d, e = m.pair_discount, m.word_discount
        conts = max(t["conts"], 1)
        back = (e[1] * t["conts_1"] + e[2] * t["conts_2"] + e[3] * (t["reached"] - t["conts_1"] - t["conts_2"])) / conts if t["conts"] else 1.0
        low = np.maximum(reached - e[np.minimum(reached, 3).astype(np.int64)], 0) / conts + back / (t["words"] + 1)
        seen = context[:, 0]
        high = np.maximum(pair - d[np.minimum(pair, 3).astype(np.int64)], 0)
        rest = d[1] * context[:, 1] + d[2] * context[:, 2] + d[3] * context[:, 3]
        p = np.where(seen > 0, (high + rest * low) / np.maximum(seen, 1), low)
        base = np.log10((count + 1) / (t["tokens"] + (t["words"] + 1)))
        by = lambda v: np.bincount(owner, v, minlength=n)
        return by(None).astype(np.int64), by(count > 0).astype(np.int64), by(base), by(np.log10(p))


_tables: dict[str, Tables] = {}


def tables(model: Model) -> Tables:
    """The mapped model of this process; another model takes its place."""
    if model.folder not in _tables:
        _tables.clear()
        _tables[model.folder] = Tables(model)
    return _tables[model.folder]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns, then n_tokens, n_known, base_score, score and perplexity for every row of docs.

    A null text is empty; an empty text has its end token only. Rows are scored one by one, whatever their ids, so repeated rows have one score.
    Columns of docs with the new names are replaced.
    """
    new = ["n_tokens", "n_known", "base_score", "score", "perplexity"]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new))
    at = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            for part in T.portions([len(t) + 64 for t in texts], PORTION):
                n, known, base, score = tables(model).score(texts[part])
                rows = batch.slice(part.start, part.stop - part.start)
                columns = [pa.array(n), pa.array(known), pa.array(base), pa.array(score), pa.array(10 ** (-score / n))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], [*batch.schema.names, *new])
        release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_tokens long, n_known long, base_score double, score double, perplexity double"
    return docs.mapInArrow(work, schema)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from the documents that are not held out."""
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out("doc_id", 7, 2))
    model = fit(rows.where("not held_out"))
    out = scored(rows, model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.totals["tokens"])).cast("long").alias("train_tokens"), "base_score", "score")
