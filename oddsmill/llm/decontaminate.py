"""Benchmark decontamination: an FM-index per shard of documents, searched for every window of the benchmark.

Words are numbered by the benchmark's vocabulary; a word that no benchmark item has can't be in a window and
becomes a gap. Of each document the index holds the runs between gaps that are long enough for the shortest
window, so nothing that could match is left out. The windows are found by backward search through wavelet-tree
ranks, their places by sampled suffix positions, and overlapping places merge to spans.

The benchmark's windows are built in Spark, in blocks of at most BLOCK_WORDS words (a longer item is several, overlapping by a window less
a word), and written to the shared folder, from where each worker maps them into memory. A shard is searched for one block
after another, so nothing is collected or broadcast, and documents only stream through.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from ._store import map_array, release, shared_folder, small_batches, write_array
from .fm_index import FMIndex

WINDOW = 10
#: Words of benchmark text that are searched for at a time: 8 bytes a word of vocabulary, 4 bytes a word of each window.
BLOCK_WORDS = 200_000
#: Bytes of documents behind one FM-index.
SHARD_BYTES = 4 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


class Windows:
    """All windows of a block of items: the vocabulary by hash, the distinct windows as rows of word numbers, and the items of each.

    The number of a word is 2 and its place in the sorted vocabulary. A shorter row is padded at the left with 0.
    """

    def __init__(self, hashes: np.ndarray, rows: np.ndarray, starts: np.ndarray, items: np.ndarray):
        self.hashes, self.rows, self.starts, self.items = hashes, rows, starts, items
        self.lengths = (rows != 0).sum(axis=1)
        self.least = int(self.lengths.min()) if len(rows) else 0

    @classmethod
    def of(cls, parts: list[tuple[int, np.ndarray]], window: int) -> Windows:
        """From the word hashes of items, or of pieces of items."""
        hashes, numbers = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in parts)]), return_inverse=True)
        rows, own, at = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)], 0
        for item, h in parts:
            ids = (numbers[at : at + len(h)] + 2).astype(np.int32)
            at += len(h)
            if len(ids) >= window:
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            elif len(ids):
                rows.append(np.concatenate([np.zeros(window - len(ids), np.int32), ids])[None])
            else:
                continue
            own.append(np.full(len(rows[-1]), item, np.int64))
        distinct, place = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([place.reshape(-1), np.concatenate(own)], axis=1), axis=0)
        return cls(hashes, distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), np.ascontiguousarray(pairs[:, 1]))

    def packed(self) -> np.ndarray:
        head = np.array([len(self.hashes), len(self.rows), len(self.items), self.rows.shape[1]], np.int64)
        parts = (head, self.hashes, self.starts.astype(np.int64), self.items.astype(np.int64), np.ascontiguousarray(self.rows, np.int32))
        return np.concatenate([np.frombuffer(x.tobytes(), np.uint8) for x in parts])

    @classmethod
    def unpacked(cls, data: np.ndarray) -> Windows:
        n_words, n_rows, n_items, window = data[:32].view(np.int64).tolist()
        cuts = np.cumsum([32, 8 * n_words, 8 * (n_rows + 1), 8 * n_items, 4 * window * n_rows]).tolist()
        hashes, starts, items, rows = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
        return cls(hashes.view(np.uint64), rows.view(np.int32).reshape(n_rows, window), starts.view(np.int64), items.view(np.int64))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 2; 0 for words outside the vocabulary."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 2, 0)

    def items_of(self, rows: np.ndarray) -> set[int]:
        """The items that have any of these windows."""
        return {i for r in np.unique(rows).tolist() for i in self.items[self.starts[r] : self.starts[r + 1]].tolist()}


def shard_hits(hashes: np.ndarray, owner: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every place where a window occurs in words(hash, text): text, first word, words, window."""
    none = np.zeros(0, np.int64)
    if not len(hashes) or not windows.least:
        return none, none, none, none
    numbers = windows.number(hashes)
    edge = np.concatenate([[True], (owner[1:] != owner[:-1]) | ((numbers[1:] != 0) != (numbers[:-1] != 0))])
    begin = np.flatnonzero(edge)
    size = np.diff(np.append(begin, len(numbers)))
    use = (numbers[begin] != 0) & (size >= windows.least)
    begin, size = begin[use], size[use]
    if not len(begin):
        return none, none, none, none
    # the runs one after another, a gap (symbol 1) after each
    into = np.cumsum(size + 1) - (size + 1)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    sequence = np.ones(int((size + 1).sum()), np.int64)
    word_at = np.full(len(sequence), -1, np.int64)
    target = np.repeat(into, size) + step
    word_at[target] = np.repeat(begin, size) + step
    sequence[target] = numbers[word_at[target]]
    # symbols of this shard only: 1 is the gap, windows with other words can't occur here
    present = np.unique(sequence)
    if present[0] != 1:
        present = np.concatenate([[1], present])
    local = np.searchsorted(present, windows.rows)
    known = (local < len(present)) & (present[np.minimum(local, len(present) - 1)] == windows.rows)
    able = np.flatnonzero((known | (windows.rows == 0)).all(axis=1))
    index = FMIndex(np.searchsorted(present, sequence) + 1)
    low, high = index.search(local[able] + 1, windows.lengths[able])
    found = high > low
    able, low, high = able[found], low[found], high[found]
    many = high - low
    rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    word = word_at[index.locate(rows)]
    window = np.repeat(able, many)
    text = owner[word]
    return text, word - np.searchsorted(owner, text), windows.lengths[window], window


def _merge(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(start.tolist(), stop.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def window_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[str, list[str]]:
    """Writes the windows of all items to the shared folder: the folder, and the names of the blocks.

    Items are dealt to about as many groups as there will be blocks; a group's task cuts its words to blocks. Items without words or
    item_id are skipped; repeated items and items with equal texts are as they are.
    """
    spark = benchmark.sparkSession
    folder = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    n_words = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    groups = -(-n_words // block_words)
    if not groups:
        return folder, []
    dealt = rows.where("text is not null").withColumn("deal", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))

    def build(table: pa.Table) -> pa.Table:
        deal = table.column("deal")[0].as_py()
        ids, texts = table.column("item_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
        pieces: list[tuple[int, np.ndarray]] = []
        for part in T.portions([len(t) for t in texts], SHARD_BYTES):
            hashes, _, _, owner = T.words(texts[part])
            cuts = np.searchsorted(owner, np.arange(part.stop - part.start + 1))
            for i, a, b in zip(ids[part], cuts[:-1], cuts[1:]):
                step = max(1, block_words - window + 1)
                pieces += [(i, hashes[c : min(b, c + step + window - 1)]) for c in range(a, max(a + 1, b - window + 1), step) if b > a]
        names = []
        pieces.sort(key=lambda x: (x[0], x[1].tobytes()))
        for k, part in enumerate(T.portions([len(h) for _, h in pieces], block_words)):
            names.append(f"{deal}-{k}")
            write_array(folder, names[-1], Windows.of(pieces[part], window).packed())
        release()
        return pa.table({"name": pa.array(names, pa.string())})

    return folder, sorted(r["name"] for r in dealt.groupBy("deal").applyInArrow(build, "name string").collect())


_mapped: dict[tuple[str, str], Windows] = {}


def mapped_windows(folder: str, name: str) -> Windows:
    """A block, mapped into this process; those of another benchmark are given up."""
    if (folder, name) not in _mapped:
        for key in [k for k in _mapped if k[0] != folder]:
            del _mapped[key]
        _mapped[folder, name] = Windows.unpacked(map_array(folder, name, np.uint8))
    return _mapped[folder, name]


def _fields(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)


def hits_by_text(texts: list[bytes], folder: str, names: list[str]):
    """For each text: its words, the merged spans of its hits, and the items that hit it; texts go into FM-indexes of about SHARD_BYTES."""
    for part in T.portions([len(t) for t in texts], SHARD_BYTES):
        hashes, _, _, owner = T.words(texts[part])
        n = part.stop - part.start
        counts = np.bincount(owner, minlength=n)
        starts, stops, items = ([[] for _ in range(n)] for _ in range(3))
        for name in names:
            windows = mapped_windows(folder, name)
            text, first, size, window = shard_hits(hashes, owner, windows)
            order = np.argsort(text, kind="stable")
            hit, begin = np.unique(text[order], return_index=True)
            for i, a, b in zip(hit.tolist(), begin, np.append(begin[1:], len(order))):
                own = order[a:b]
                starts[i].append(first[own])
                stops[i].append(first[own] + size[own])
                items[i].append(windows.items_of(window[own]))
        for i, words in enumerate(counts.tolist()):
            spans = _merge(np.concatenate(starts[i]), np.concatenate(stops[i])) if starts[i] else []
            yield words, spans, sorted(set().union(*items[i]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs' columns, then n_words, n_hit, spans array<struct<start,stop>> (in words) and items array<long> for every row of docs.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Null and empty texts have no
    words. Items with the same text are all reported; repeated items once. Items without words or item_id are skipped. Rows are searched
    one by one, so repeated rows, ties and null ids change nothing. A column of docs with one of the new names is replaced.
    """
    new = ["n_words", "n_hit", "spans", "items"]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new))
    small_batches(docs.sparkSession)
    folder, names = window_blocks(benchmark, window, block_words)
    at = docs.columns.index("text")

    def search(batches):
        for batch in batches:
            rows = list(hits_by_text([t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()], folder, names))
            columns = [
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array([sum(y - x for x, y in spans) for _, spans, _ in rows], pa.int64()),
                pa.array([[{"start": x, "stop": y} for x, y in spans] for _, spans, _ in rows], pa.list_(_SPAN)),
                pa.array([items for _, _, items in rows], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *new])
        release()

    return docs.mapInArrow(search, _fields(docs) + ", n_words long, n_hit long, spans array<struct<start:long,stop:long>>, items array<long>")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data.translate(_LOWER))]
    edges = [0, *(x for a, b in spans for x in (places[a][0], places[b - 1][1])), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()


def items_digest(items: list[int]) -> str:
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, window)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the words of benchmark passages: hit spans are cut from the text, other text stays as it is, all rows and columns kept.

    A cut takes the words of the span and what stands between them. Documents without a hit, and null and empty texts, are returned unchanged.
    Search and cut are one pass. Rows are cleaned one by one, whatever their ids; no name of a column is special but text.
    """
    names = docs.columns
    renamed = docs.select(*(F.col(f"`{c}`").alias(c if c == "text" else f"_c{i}") for i, c in enumerate(names)))
    small_batches(docs.sparkSession)
    folder, blocks = window_blocks(benchmark, window, block_words)
    at = names.index("text")

    def cut(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            hits = hits_by_text([(t or "").encode() for t in texts], folder, blocks)
            texts = [without_spans(t, spans) if spans else t for t, (_, spans, _) in zip(texts, hits)]
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
        release()

    return renamed.mapInArrow(cut, _fields(renamed)).toDF(*names)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
hits AS (SELECT rid, i, n, item_id FROM (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)) JOIN wins USING (n, win)),
spans AS (SELECT rid, i, i + n AS stop, max(i + n) OVER (PARTITION BY rid ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT rid, i, n FROM hits)),
cover AS (SELECT rid, sum(greatest(0, stop - greatest(i, coalesce(before, 0)))) AS n_hit FROM spans GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)
"""
