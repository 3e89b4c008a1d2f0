"""Byte-level BPE by DuckDB inside each task: recursive contraction to encode, ordered aggregation to decode.

A text is cut by the tokenizer's pattern. A piece that is a token is that token; every other distinct piece becomes
rows (word, position, token) of single bytes, and a recursive query joins neighbours to the merge table and
contracts each word's leftmost pair of least rank, until no pair of the word has a rank. Pieces that were contracted lately are remembered.

Of a long piece the recursion keeps the last state alone (a keyed recursive table), writes just the rows beside a contraction, and contracts
all places of the least rank at once, from the left, unless a pair that this makes has a lower rank; then the leftmost place goes alone, so the
ids are those of one contraction after another.

To decode, the ids of each text are joined to the vocabulary, and their bytes are aggregated in order of position. All state is bounded.

The vocabulary file is named by a path that must exist on every worker; it's read there, never shipped.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
import tempfile
import threading
from collections.abc import Iterable

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from ._store import release, small_batches

#: Bytes of text tokenized at a time, pieces contracted by one recursive query, and pieces remembered per generation.
PORTION, WORDS, KEPT = 2 << 20, 24_000, 500_000
#: Pieces of more bytes go through ENCODE_LONG: ENCODE keeps the rows of every round, which is less work for a few rounds and too much for many.
LONG = 192
#: Ids aggregated into one string of bytes, and ids decoded by one query.
CHUNK, DECODED = 1 << 15, 1 << 18

# One round over rows (wid, pos, tok, nxt) of ``state``: nxt is the token at pos + 1, -1 at a word's end. The least of
# (rank, position) is each word's pair to contract; the row after it goes, and later positions move up.
ENCODE = """
WITH RECURSIVE state(round, wid, pos, tok, nxt) AS (
  SELECT 0, wid, pos, tok, nxt FROM letters
  UNION ALL
  (WITH best AS (
    SELECT s.wid, min((m.merged << 32) | s.pos::BIGINT) AS code
    FROM state s JOIN merges m ON m.pair = s.tok::BIGINT * 65536 + s.nxt GROUP BY s.wid),
  pick AS (
    SELECT best.wid, (code >> 32)::INTEGER AS merged, (code & 4294967295)::INTEGER AS place, r.nxt AS beyond
    FROM best JOIN state r ON r.wid = best.wid AND r.pos = (code & 4294967295)::INTEGER + 1)
  SELECT (s.round + 1)::INTEGER, s.wid,
    CASE WHEN s.pos > b.place THEN s.pos - 1 ELSE s.pos END AS pos,
    CASE WHEN s.pos = b.place THEN b.merged ELSE s.tok END AS tok,
    CASE WHEN s.pos = b.place THEN b.beyond WHEN s.pos = b.place - 1 THEN b.merged ELSE s.nxt END AS nxt
  FROM state s JOIN pick b ON b.wid = s.wid WHERE s.pos <> b.place + 1)
),
final AS (SELECT wid, max(round) AS round FROM state GROUP BY wid)
SELECT s.wid, s.tok FROM state s JOIN final f ON f.wid = s.wid AND f.round = s.round ORDER BY s.wid, s.pos
"""

# Rows (wid, pos, tok, nx, rnk) of a table keyed by word and position: nx is the next live position, rnk the rank of the pair that begins here (-1: none),
# a dead row has tok -1. ``hit`` are the places of a word's least rank, ``pick`` those that don't overlap, counted from the left, ``bad`` the words in which
# a contraction makes a pair of a lower rank.
ENCODE_LONG = """
WITH RECURSIVE state(wid,pos,tok,nx,rnk) USING KEY (wid,pos) AS (
  SELECT l.wid,l.pos,l.tok,CASE WHEN nxt < 0 THEN -1 ELSE pos+1 END, coalesce(m.merged,-1) FROM letters l LEFT JOIN merges m ON m.pair = l.tok::BIGINT * 65536 + l.nxt
  UNION
  (WITH best AS (
    SELECT wid, min(rnk) AS r FROM recurring.state WHERE rnk >= 0 GROUP BY wid),
  hit AS (
    SELECT s.wid, s.pos, s.nx, b.r, lag(s.nx) OVER w IS NOT DISTINCT FROM s.pos AS tied, row_number() OVER w AS rn
    FROM recurring.state s JOIN best b ON b.wid = s.wid AND b.r = s.rnk WINDOW w AS (PARTITION BY s.wid ORDER BY s.pos)),
  pick AS (
    SELECT wid, pos AS place, nx AS gone, r FROM (SELECT *, rn - max(CASE WHEN NOT tied THEN rn END) OVER (PARTITION BY wid ORDER BY pos) AS odd FROM hit) WHERE odd % 2 = 0),
  wide AS (
    SELECT p.*, g.nx AS beyond, n.tok AS ntok, h.pos AS hpos, h.tok AS htok, h.nx AS hnx
    FROM pick p JOIN recurring.state g ON g.wid = p.wid AND g.pos = p.gone
      LEFT JOIN recurring.state n ON n.wid = p.wid AND n.pos = g.nx
      LEFT JOIN recurring.state h ON h.wid = p.wid AND h.nx = p.place AND h.tok >= 0),
  beside AS (
    SELECT w.*, l.place IS NOT NULL AS left_goes, f.place IS NOT NULL AS next_goes
    FROM wide w LEFT JOIN pick l ON l.wid = w.wid AND l.gone = w.hpos LEFT JOIN pick f ON f.wid = w.wid AND f.place = w.beyond),
  bad AS (
    SELECT b.wid, min(b.place) AS first FROM beside b
      LEFT JOIN merges x ON x.pair = b.r::BIGINT * 65536 + b.ntok
      LEFT JOIN merges y ON y.pair = (CASE WHEN left_goes THEN r ELSE htok END)::BIGINT * 65536 + b.r
    GROUP BY b.wid HAVING bool_or(coalesce(x.merged < b.r, false) OR coalesce(y.merged < b.r, false))),
  done AS (
    SELECT b.* REPLACE (left_goes AND v.first IS NULL AS left_goes, next_goes AND v.first IS NULL AS next_goes)
    FROM beside b LEFT JOIN bad v ON v.wid = b.wid WHERE v.first IS NULL OR b.place = v.first),
  changed AS (
    SELECT wid, place AS pos, r AS tok, beyond AS nx, CASE WHEN next_goes THEN r ELSE ntok END AS ntok FROM done
    UNION ALL SELECT wid, gone, -1, -1, NULL FROM done
    UNION ALL SELECT wid, hpos, htok, hnx, r FROM done WHERE hpos IS NOT NULL AND NOT left_goes)
  SELECT c.wid, c.pos, c.tok, c.nx, coalesce(m.merged, -1) FROM changed c LEFT JOIN merges m ON m.pair = c.tok::BIGINT * 65536 + c.ntok)
)
SELECT wid, tok FROM state WHERE tok >= 0 ORDER BY wid, pos
"""

DECODE = """
SELECT t.wid, string_agg(v.hex, '' ORDER BY t.pos) AS hex
FROM tokens t JOIN vocabulary v ON v.tok = t.tok GROUP BY t.wid ORDER BY t.wid
"""


def numbers(joined: str) -> np.ndarray:
    """Ids from their text."""
    return np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32)


class Codec:
    """One vocabulary in one process."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pattern = regex.compile(pattern)
        self.letter = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        # what doesn't fit in memory goes to the worker's own temp folder, for the time of a query
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": os.path.join(tempfile.gettempdir(), f"bpe-{os.getpid()}")})
        if len(self.ranks) > 65536:
            raise ValueError("token ids must fit in 16 bits")
        merges = pa.table({"pair": pa.array(np.array(left, np.int64) * 65536 + np.array(right, np.int64)), "merged": pa.array(merged, pa.int64())})
        vocabulary = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in self.ranks], pa.string())})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("incoming", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
            self.db.unregister("incoming")
        self.known_ids = np.zeros(max(self.ranks.values()) + 1, bool)
        self.known_ids[list(self.ranks.values())] = True
        #: ids joined by commas of the pieces seen lately
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def _letters(self, pieces: list[bytes]) -> pa.Table:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        wid = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        pos = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        tok = self.letter[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt = np.append(tok[1:], -1).astype(np.int32)
        nxt[np.cumsum(sizes) - 1] = -1
        return pa.table({"wid": wid, "pos": pos, "tok": tok, "nxt": nxt})

    def contract(self, pieces: list[bytes], query: str = ENCODE) -> list[list[int]]:
        """Token ids of pieces of at least one byte, none of which need be looked up as a whole."""
        self.db.register("letters", self._letters(pieces))
        found = self.db.execute(query).fetchnumpy()
        self.db.unregister("letters")
        cuts = np.append(np.flatnonzero(np.diff(found["wid"], prepend=-1)), len(found["wid"]))
        toks = found["tok"].tolist()
        return [toks[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def decode_lists(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids; an id outside the vocabulary is an error, an empty list is empty. Long lists are aggregated in chunks."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in lists)])
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.known_ids) or not self.known_ids[flat].all()):
            raise ValueError("an id is not in the vocabulary")
        begin = np.cumsum(sizes) - sizes
        chunks = -(-sizes // CHUNK)
        own = np.repeat(np.arange(len(lists)), chunks)
        start = np.repeat(begin, chunks) + (np.arange(len(own)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK
        stop = np.minimum(start + CHUNK, (begin + sizes)[own])
        parts: list[list[bytes]] = [[] for _ in lists]
        for part in T.portions((stop - start).tolist(), DECODED):
            a, b = start[part], stop[part]
            wid = np.repeat(np.arange(len(a), dtype=np.int32), b - a)
            pos = (np.arange(len(wid)) - np.repeat(a - a[0], b - a)).astype(np.int32)
            self.db.register("tokens", pa.table({"wid": wid, "pos": pos, "tok": flat[a[0] : b[-1]].astype(np.int32)}))
            for i, text in self.db.execute(DECODE).fetchall():
                parts[own[part.start + i]].append(bytes.fromhex(text))
            self.db.unregister("tokens")
        return [x[0] if len(x) == 1 else b"".join(x) for x in parts]

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces that are not known, so that look-ups find them."""
        if len(self.young) > KEPT:
            self.old, self.young = self.young, {}
        fresh = []
        for p in pieces:
            if p not in self.young:
                if p in self.old:
                    self.young[p] = self.old[p]
                else:
                    fresh.append(p)
        for k in range(0, len(fresh), WORDS):
            part = fresh[k : k + WORDS]
            data = [p.encode() for p in part]
            whole = [self.ranks.get(d) for d in data]
            for p, rank in zip(part, whole):
                if rank is not None:
                    self.young[p] = str(rank)
            for query, of in ((ENCODE, lambda n: n <= LONG), (ENCODE_LONG, lambda n: n > LONG)):
                own = [i for i, d in enumerate(data) if whole[i] is None and of(len(d))]
                if own:
                    for i, ids in zip(own, self.contract([data[i] for i in own], query)):
                        self.young[part[i]] = ",".join(map(str, ids))

    def run(self, texts: list[str]):
        """Ids joined by commas, the bytes decoded from the ids, and the number of ids of each text."""
        for part in T.portions([len(t) for t in texts], PORTION):
            pieces = [self.pattern.findall(t) for t in texts[part]]
            self.learn(set().union(*pieces))
            known = self.young
            joined = [",".join(map(known.__getitem__, own)) for own in pieces]
            del pieces
            ids = list(map(numbers, joined))
            yield from zip(joined, self.decode_lists(ids), map(len, ids))


_codecs: dict[tuple[str, str], Codec] = {}
_rest: list[threading.Timer] = []
#: Seconds without work after which a process gives its codec up; other stages then have the memory.
IDLE = 2.0


def codec(path: str, pattern: str) -> Codec:
    """The codec of this process; Python workers are used for many tasks."""
    while _rest:
        _rest.pop().cancel()
    own = _codecs.get((path, pattern))
    if own is None:
        release()
        own = _codecs[path, pattern] = Codec(path, pattern)
    return own


def rest() -> None:
    """The end of a task's work with the codec."""

    def drop() -> None:
        _codecs.clear()
        gc.collect()
        release()

    timer = threading.Timer(IDLE, drop)
    timer.daemon = True
    _rest.append(timer)
    timer.start()


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """docs' columns, then ids array<int> and decoded (the bytes that the ids stand for) for every row of docs.

    A null text is empty; an empty text has no ids. Rows are independent, so repeated rows, ties and extra columns
    change nothing; a column of docs named ids or decoded is replaced.
    """
    path, pattern = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "decoded")))
    at = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", ids array<int>, decoded binary"

    def work(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ids, back = [], []
            for joined, data, _ in own.run(texts):
                ids.append(numbers(joined))
                back.append(data)
            new = [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "ids", "decoded"])
        del own
        rest()

    return docs.mapInArrow(work, schema)


def decode_ids(rows: DataFrame, column: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """rows' columns, then decoded: the bytes of the list of ids; null for a null list."""
    path, pattern = vocabulary or default_vocabulary()
    rows = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c != "decoded"))
    at = rows.columns.index(column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary"

    def work(batches):
        own = codec(path, pattern)
        for batch in batches:
            lists = batch.column(at).to_pylist()
            back = own.decode_lists([np.array(x or (), np.int64) for x in lists])
            new = pa.array([None if x is None else b for x, b in zip(lists, back)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, "decoded"])
        del own
        rest()

    return rows.mapInArrow(work, schema)


def token_digests(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: the same run, with digests taken in the task."""
    path, pattern = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def work(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, ids, back = [], [], []
            for joined, data, n in own.run(texts):
                counts.append(n)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        del own
        rest()

    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
