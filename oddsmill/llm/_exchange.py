"""Ask-and-answer over hash slices, for statistics that need every document but no document's text.

Texts are dealt once into buckets ``p`` by a hash of the whole text, so that copies meet and are
reduced to one text with a count (equal texts of one map task already travel once, so a text that a
third of all rows hold costs one entry per task). Each bucket then asks about its distinct hashes,
slice ``q`` of the hash space by slice, as one sorted and packed array; the task of slice ``q`` adds up
what all buckets said and answers each array by position. A hash that every document holds is asked
about once per bucket, so no key is hot, and nothing is collected or broadcast.

Buckets and slices both grow with the input, so the arrays between them would grow with its square. Beyond ARRAYS of them an array covers
a range of about the square root of the slices, about the square root of the buckets are added up first for each range, and only these
sums are cut to slices; the answers come back the same way. Arrays then grow as the input to the power 1.5, and each holds so many
hashes more.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ._store import release, small_batches

#: Compressed input bytes behind one shuffle partition.
PART_BYTES = 8 << 20
#: Compressed input bytes behind one slice of the hash space.
SLICE_BYTES = 2 << 20
#: Buckets dealt to one shuffle partition; several small ones even out the load and bound a group's memory.
SPREAD = 4
#: Arrays between buckets and slices up to which they are sent straight.
ARRAYS = 2_000_000


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size of df; None where it doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else None


def partitions_for(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Shuffle partitions that grow with the input and never fall under the session's setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(df)
    return max(least, math.ceil(size / part_bytes)) if size is not None else 4 * least


def by_number(df: DataFrame, n: int, number) -> DataFrame:
    """df in n partitions by a number, with its remainder by n as ``part``: consecutive numbers are spread evenly, as they would not be by a hash.

    Grouping by ``part`` and the number then needs no further exchange.
    """
    column = F.col(number) if isinstance(number, str) else number
    return df.withColumn("part", F.pmod(column, F.lit(n)).cast("int")).repartitionById(n, F.col("part"))


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_array(a: np.ndarray) -> bytes:
    """Byte planes, so that bytes which seldom change shrink to nothing."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return pack(np.ascontiguousarray(planes).tobytes())


def unpack_array(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(unpack(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack_array(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(data: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack_array(data, dtype), dtype=dtype)


def pack_texts(ids: list[list], texts: list[bytes]) -> bytes:
    """ids: the doc_ids, some perhaps null, of the rows that hold each text."""
    counts = np.array([len(x) for x in ids], np.int64)
    flat = [y for x in ids for y in x]
    known = np.array([y is not None for y in flat], np.uint8)
    values = np.array([0 if y is None else y for y in flat], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    head = struct.pack("<qq", len(texts), len(flat))
    return pack(b"".join([head, counts.tobytes(), sizes.tobytes(), values.tobytes(), known.tobytes(), *texts]))


def unpack_texts(data: bytes) -> tuple[list[list], list[bytes]]:
    raw = unpack(data)
    n, m = struct.unpack_from("<qq", raw)
    counts, sizes, values = (np.frombuffer(raw, np.int64, k, 16 + 8 * at) for k, at in ((n, 0), (n, n), (m, 2 * n)))
    known = np.frombuffer(raw, np.uint8, m, 16 + 8 * (2 * n + m))
    flat = [int(v) if k else None for v, k in zip(values, known)]
    at, ids, texts = 16 + 8 * (2 * n + m) + m, [], []
    first = 0
    for c, s in zip(counts, sizes):
        ids.append(flat[first : first + c])
        texts.append(raw[at : at + s])
        first, at = first + c, at + s
    return ids, texts


def deal_texts(docs: DataFrame, n: int, spread: int = SPREAD) -> DataFrame:
    """Rows (p, payload): the distinct texts of docs(doc_id, text), dealt to buckets by text, in n partitions; null counts as empty.

    The same frame may be used several times in one plan: its shuffle is then reused.
    """
    buckets = n * spread
    small_batches(docs.sparkSession)

    def deal(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            held: dict[bytes, list] = {}
            for i, t in zip(ids, texts):
                held.setdefault(t or b"", []).append(i)
            by: dict[int, tuple[list, list]] = {}
            for t, own in held.items():
                p = int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") % buckets
                into = by.setdefault(p, ([], []))
                into[0].append(own)
                into[1].append(t)
            if by:
                yield pa.record_batch([pa.array(list(by), pa.int32()), pa.array([pack_texts(*v) for v in by.values()], pa.binary())], ["p", "payload"])
            del ids, texts, held, by
        release()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return by_number(slim.mapInArrow(deal, "p int, payload binary"), n, "p")


def bucket_texts(payloads) -> tuple[list[list], list[bytes]]:
    """The distinct texts of one bucket, in an order that doesn't depend on the order of its rows; ids sorted, nulls last."""
    held: dict[bytes, list] = {}
    for data in payloads:
        for own, t in zip(*unpack_texts(data)):
            held.setdefault(t, []).extend(own)
    texts = sorted(held)
    return [sorted(held[t], key=lambda x: (x is None, x or 0)) for t in texts], texts


def slices_for(df: DataFrame, n: int) -> int:
    """Slices of the hash space: one for SLICE_BYTES of input, at least n. Arrays number buckets x slices at most, and no more than hashes."""
    size = estimated_bytes(df)
    return max(n, math.ceil(size / SLICE_BYTES)) if size is not None else n


def ask(dealt: DataFrame, slices: int, hashes: Callable) -> DataFrame:
    """Rows (p, q, asked): for each bucket and slice, what ``hashes(ids, texts)`` returns as a sorted array and columns of counts beside it.

    ``hashes`` gives (sorted distinct uint64 hashes, [uint32 arrays]). Slices are ranges of the hash.
    """

    def group(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        h, sides = hashes(*bucket_texts(table.column("payload").to_pylist()))
        cuts = np.append(np.searchsorted(h, slice_bounds(slices)), len(h))
        qs, data = [], []
        for q, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                qs.append(q)
                data.append(frame([pack_sorted(h[a:b]), *(pack_array(s[a:b].astype(np.uint32)) for s in sides)]))
        release()
        return pa.table({"p": pa.array([p] * len(qs), pa.int32()), "q": pa.array(qs, pa.int32()), "asked": pa.array(data, pa.binary())})

    return dealt.groupBy("part", "p").applyInArrow(group, "p int, q int, asked binary")


def slice_bounds(slices: int) -> np.ndarray:
    """The least hash of each slice."""
    return np.array([(i << 64) // slices for i in range(slices)], np.uint64)


def frame(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def unframe(data: bytes) -> list[bytes]:
    n = struct.unpack_from("<q", data)[0]
    sizes = struct.unpack_from(f"<{n}q", data, 8)
    at, out = 8 * (n + 1), []
    for s in sizes:
        out.append(data[at : at + s])
        at += s
    return out


def totals(asked: list[bytes], sides: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """The arrays asked about, all distinct hashes of the slice, and the sums of each side over the buckets."""
    arrays, counts = [], [[] for _ in range(sides)]
    for data in asked:
        h, *rest = unframe(data)
        arrays.append(unpack_sorted(h))
        for k in range(sides):
            counts[k].append(unpack_array(rest[k], np.uint32))
    every = np.unique(np.concatenate(arrays))
    sums = [np.zeros(len(every), np.int64) for _ in range(sides)]
    for i, h in enumerate(arrays):
        at = np.searchsorted(every, h)
        for k in range(sides):
            sums[k][at] += counts[k][i]
    return arrays, every, sums


def answer(asked: DataFrame, sides: int, n: int, wrapped: tuple[int, ...] = ()) -> DataFrame:
    """Rows (p, q, answer): for every array asked about, the sums over all buckets, in its order; sides named in wrapped are modulo 2**32, others at most 2**32 - 1."""
    fit = _fit(sides, wrapped)

    def group(table: pa.Table) -> pa.Table:
        arrays, every, sums = totals(table.column("asked").to_pylist(), sides)
        out = []
        for h in arrays:
            at = np.searchsorted(every, h)
            out.append(frame([pack_array(f(s[at])) for f, s in zip(fit, sums)]))
        release()
        return pa.table({"p": table.column("p"), "q": table.column("q"), "answer": pa.array(out, pa.binary())})

    return by_number(asked, n, "q").groupBy("part", "q").applyInArrow(group, "p int, q int, answer binary")


def _fit(sides: int, wrapped: tuple[int, ...]) -> list[Callable]:
    wrap = lambda s: (s & 0xFFFFFFFF).astype(np.uint32)
    clip = lambda s: np.minimum(s, 0xFFFFFFFF).astype(np.uint32)
    return [wrap if k in wrapped else clip for k in range(sides)]


def range_bounds(slices: int, c: int, parts: int) -> np.ndarray:
    """The least hash of each of so many parts of slice c."""
    low, high = (c << 64) // slices, ((c + 1) << 64) // slices
    return np.array([low + k * (high - low) // parts for k in range(parts)], np.uint64)


def sums(dealt: DataFrame, buckets: int, slices: int, sides: int, n: int, hashes: Callable, wrapped: tuple[int, ...] = ()) -> DataFrame:
    """Rows (p, q, answer), in n partitions by p: the answers to what each bucket asks, straight or by way of groups of buckets and ranges of slices."""
    if buckets * slices <= ARRAYS:
        return by_number(answer(ask(dealt, slices, hashes), sides, n, wrapped), n, "p")
    width, coarse = math.isqrt(buckets - 1) + 1, math.isqrt(slices - 1) + 1
    fine = -(-slices // coarse)
    fit = _fit(sides, wrapped)

    def merge(table: pa.Table) -> pa.Table:
        g, c = table.column("g")[0].as_py(), table.column("q")[0].as_py()
        _, every, added = totals(table.column("asked").to_pylist(), sides)
        cuts = np.append(np.searchsorted(every, range_bounds(coarse, c, fine)), len(every))
        rows = [(c * fine + k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        data = [frame([pack_sorted(every[a:b]), *(pack_array(f(s[a:b])) for f, s in zip(fit, added))]) for _, a, b in rows]
        release()
        return pa.table({"p": pa.array([g] * len(rows), pa.int32()), "q": pa.array([r[0] for r in rows], pa.int32()), "asked": pa.array(data, pa.binary())})

    def split(left: pa.Table, right: pa.Table) -> pa.Table:
        arrays = [unpack_sorted(unframe(x)[0]) for x in left.column("asked").to_pylist()]
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *arrays]))
        data = right.column("answer").to_pylist()
        parts = [[unpack_array(x, np.uint32) for x in unframe(data[i])] for i in np.argsort(right.column("q").to_numpy())]
        added = [np.concatenate([np.zeros(0, np.uint32), *(x[k] for x in parts)]) for k in range(sides)]
        out = []
        for h in arrays:
            at = np.searchsorted(every, h)
            out.append(frame([pack_array(s[at]) for s in added]))
        release()
        return pa.table({"p": left.column("p"), "q": left.column("q"), "answer": pa.array(out, pa.binary())})

    asked = ask(dealt, coarse, hashes).withColumn("g", F.floor(F.col("p") / width).cast("int"))
    asked = by_number(asked, n, F.col("g").cast("long") * coarse + F.col("q"))
    answers = answer(asked.groupBy("part", "g", "q").applyInArrow(merge, "p int, q int, asked binary"), sides, n, wrapped)
    back = answers.select(F.col("p").alias("g"), F.floor(F.col("q") / fine).cast("int").alias("c"), "q", "answer")
    back = by_number(back, n, F.col("g").cast("long") * coarse + F.col("c"))
    return by_number(asked.groupBy("part", "g", "q").cogroup(back.groupBy("part", "g", "c")).applyInArrow(split, "p int, q int, answer binary"), n, "p")


def with_answers(dealt: DataFrame, answers: DataFrame, sides: int, work: Callable, schema: str) -> DataFrame:
    """``work(p, ids, texts, sums)`` on each bucket; sums are the answers, in the order of its hashes."""

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("q").to_numpy())
        data = right.column("answer").to_pylist()
        parts = [[unpack_array(x, np.uint32) for x in unframe(data[i])] for i in order]
        sums = [np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.uint32) for k in range(sides)]
        ids, texts = bucket_texts(left.column("payload").to_pylist())
        out = work(left.column("p")[0].as_py(), ids, texts, sums)
        release()
        return out

    return dealt.groupBy("part", "p").cogroup(answers.groupBy("part", "p")).applyInArrow(group, schema)
