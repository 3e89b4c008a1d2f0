"""Exact removal of long repeats: a suffix sort whose comparisons are hash lookups.

A byte goes if a ``length``-byte string over it also starts anywhere else, in any text. Sorting every suffix of the
corpus is not needed to know that:

1. Texts are dealt to buckets and copies reduced to one text (see ``_exchange``); a text with a copy is a repeat as a whole.
2. Every window of ``length`` bytes has an anchor, the leftmost of its ``GRAM``-byte strings with the least hash, which depends on
   the window alone; equal windows have equal anchors at equal offsets. Windows with one anchor are neighbours, a run. Each bucket
   asks how often its anchors' strings, and its whole runs, occur. A run whose anchor's string is unique holds no repeat; a run that
   occurs twice as a whole (same bytes, same offset) is a repeat as a whole, if the sum of the checks (by an independent hash) of all runs
   counted with it is that many times its own; else it's left to 3. Both settle nearly all text, at 20 bytes per 170.
3. What is left are runs at the edges of repeats, and one of each kind of whole repeat whose anchor also has other
   runs, as their windows may have equals at an edge. The windows of these are sorted as suffixes, first in each bucket, where repeats are
   noted and one window of each kind goes on, then over all buckets by anchor (a frequent anchor's windows part by a second
   anchor; what one task gets of equal windows is one from each bucket at most). The suffix sort is a merge sort; two
   suffixes are compared by binary search for their common extension over prefix polynomial hashes. Neighbours in this
   order with a common extension of ``length`` are compared byte by byte before they count, the order of the others is verified by an
   independent hash; if either fails, the windows are told apart without polynomials.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _exchange as X, _text as T
from ._store import fresh, release

LENGTH, GRAM = 400, 64
#: Windows of one text looked at together; their number must stay under 2**POSITION_BITS.
SEGMENT = 1 << 18
POSITION_BITS = np.uint64(24)
_LOW = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
#: Windows of an anchor that occurs more often are told apart by a second one before they meet in a task.
HOT = 1_000
_OTHER = np.uint64(0xA5B35705C36D2E19)
#: Bytes of text whose suffixes are sorted together; the windows of one anchor stay together, however many.
SORTED_BYTES = 1 << 20


def sliding_minimum(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by minima of blocks from both sides."""
    n = len(a) - width + 1
    padded = np.concatenate([a, np.full(-len(a) % width, np.iinfo(a.dtype).max, a.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).reshape(-1)
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def runs(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """first and last window start, anchor position, hash of the anchor's string, hash and check of the run, of all runs of a text."""
    data = np.frombuffer(text, np.uint8)
    parts = []
    for base in range(0, len(data) - length + 1, SEGMENT):
        piece = data[base : base + SEGMENT + length - 1]
        prefix = T.prefix_hash(piece)
        start = np.arange(len(piece) - gram + 1)
        grams = T.slice_hash(prefix, start, start + gram)
        least = sliding_minimum((grams & ~_LOW) | start.astype(np.uint64), length - gram + 1)
        anchor = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:] - 1, len(anchor) - 1)
        at = anchor[first]
        whole = T.mix(T.slice_hash(prefix, first, last + length) ^ T.mix((at - first).astype(np.uint64)))
        check = T.slice_check(T.prefix_check(piece), first, last + length)
        parts.append((first + base, last + base, at + base, T.mix(grams[at]), whole, check))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, np.int64 if k < 3 else np.uint64) for k in range(6))


def second_anchors(text: bytes, first: int, last: int, length: int, gram: int) -> np.ndarray:
    """For each window start from first to last, the least of another hash over the window's strings; it too depends on the window alone."""
    piece = np.frombuffer(text, np.uint8)[first : last + length]
    start = np.arange(len(piece) - gram + 1)
    grams = T.slice_hash(T.prefix_hash(piece), start, start + gram)
    return sliding_minimum(T.mix(grams ^ _OTHER), length - gram + 1)


def common_extension(prefix: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Length, up to limit, to which the suffixes at i and j agree, by binary search over the prefix hashes."""
    inverse = T.inverse_powers(len(prefix))
    hi, hj, ii, ij = prefix[i], prefix[j], inverse[i], inverse[j]
    low, high = np.zeros(len(i), np.int64), np.full(len(i), limit, np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        same = (prefix[i + mid] - hi) * ii == (prefix[j + mid] - hj) * ij
        low, high = np.where(same, mid, low), np.where(same | ~open_, high, mid - 1)


def sorted_suffixes(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in the order of the ``length`` bytes from them (ties by position), and in how many bytes, up to length, each agrees with the one before.

    Text from any start on must have ``length`` bytes. Suffixes are put in order by their first 16 bytes; each group
    of equals is then merge-sorted, all groups in step.
    """
    n = len(starts)
    if not n:
        return starts, np.zeros(0, np.int64)
    prefix = T.prefix_hash(text)
    key = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    depth = min(16, length)
    for k in range(depth):
        key[k // 8] = (key[k // 8] << np.uint64(8)) | text[starts + k].astype(np.uint64)
    order = np.lexsort((starts, key[1], key[0]))
    pos, a, b = starts[order], key[0][order], key[1][order]
    head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, n))
    group = np.repeat(np.arange(len(begin)), size)
    width = 1
    while width < size.max():
        live = np.flatnonzero(size[group] > width)
        rel = live - begin[group[live]]
        block = rel // width
        other = (block ^ 1) * width
        ends = size[group[live]]
        has = other < ends
        live, rel, block, other, ends = live[has], rel[has], block[has], other[has], ends[has]
        base = begin[group[live]]
        low, high = np.zeros(len(live), np.int64), np.minimum(width, ends - other)
        odd = (block & 1).astype(bool)
        while True:
            at = np.flatnonzero(low < high)
            if not len(at):
                break
            mid = (low[at] + high[at]) >> 1
            mine, theirs = pos[live[at]], pos[base[at] + other[at] + mid]
            ext = common_extension(prefix, mine, theirs, length)
            full = ext >= length
            edge = np.minimum(ext, length - 1)
            less = np.where(full, theirs < mine, text[theirs + edge] < text[mine + edge])
            low[at] = np.where(less, mid + 1, low[at])
            high[at] = np.where(less, high[at], mid)
        target = base + np.where(odd, other, block * width) + (rel - block * width) + low
        moved = pos.copy()
        moved[target] = pos[live]
        pos = moved
        width *= 2
    shared = np.zeros(n, np.int64)
    inner = np.flatnonzero(~head)
    shared[inner] = common_extension(prefix, pos[inner - 1], pos[inner], length)
    return pos, shared


def suffix_sort(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in order, and whether each agrees in all ``length`` bytes with the one before, as the hashes say."""
    pos, shared = sorted_suffixes(text, starts, length)
    return pos, shared >= length


def order_holds(text: np.ndarray, pos: np.ndarray, shared: np.ndarray, length: int) -> bool:
    """Collision verification of a suffix sort: neighbours that are said to agree do, byte by byte; of the others, what they share passes
    an independent check and the next bytes are in order. Neighbours that share nothing were put in order by their bytes."""
    at = np.flatnonzero(shared >= length)
    views = np.lib.stride_tricks.sliding_window_view(text, length) if len(text) >= length else None
    for k in range(0, len(at), 4096):
        i = at[k : k + 4096]
        if not (views[pos[i - 1]] == views[pos[i]]).all():
            return False
    at = np.flatnonzero((shared > 0) & (shared < length))
    a, b, n = pos[at - 1], pos[at], shared[at]
    prefix = T.prefix_check(text)
    return bool((text[a + n] < text[b + n]).all() and (T.slice_check(prefix, a, a + n) == T.slice_check(prefix, b, b + n)).all())


def repeated(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start (distinct, ascending): whether its window has an equal among the others, and whether it is the first of its kind."""
    pos, shared = sorted_suffixes(text, starts, length)
    if not order_holds(text, pos, shared, length):
        return _repeated_exactly(np.lib.stride_tricks.sliding_window_view(text, length), starts)
    same = shared >= length
    twin = same | np.append(same[1:], False)
    back = np.searchsorted(starts, pos)
    out, first = np.zeros(len(pos), bool), np.zeros(len(pos), bool)
    out[back], first[back] = twin, ~same
    return out, first


def _repeated_exactly(views: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by a cryptographic digest of every window, for the case of a hash collision."""
    held: dict[bytes, list[int]] = {}
    for i, s in enumerate(starts):
        held.setdefault(hashlib.blake2b(views[s].tobytes(), digest_size=32).digest(), []).append(i)
    out, first = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    for own in held.values():
        first[own[0]] = True
        out[own] = len(own) > 1
    return out, first


def stretches(starts: np.ndarray, breaks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Ascending starts as (index of first, index after last) of consecutive values; a break forces a new stretch."""
    if not len(starts):
        return []
    new = np.concatenate([[True], np.diff(starts) != 1])
    if breaks is not None:
        new |= breaks
    at = np.flatnonzero(new)
    return list(zip(at, np.append(at[1:], len(starts))))


def anchored_portions(anchors: np.ndarray, sizes: np.ndarray, limit: int):
    """Slices of ascending anchors whose sizes add up to about limit; what has one anchor stays together."""
    begin = total = 0
    for i in range(len(anchors)):
        if i > begin and total + sizes[i] > limit and anchors[i] != anchors[i - 1]:
            yield slice(begin, i)
            begin, total = i, 0
        total += int(sizes[i])
    if begin < len(anchors):
        yield slice(begin, len(anchors))


def _pack_table(**columns: np.ndarray) -> bytes:
    return X.frame([X.pack_array(np.asarray(v, np.int64)) for v in columns.values()])


def _covers(text: list[int], start: list[int], stop: list[int]) -> bytes:
    return _pack_table(text=text, start=start, stop=stop)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans array<struct<start,stop>>, kept_sha256, digest (MD5 of the text) and, if asked for, kept (the bytes left) for every row of docs(doc_id, text).

    A null text is empty. Repeated rows are copies of each other. Null doc_ids stay null. Texts under ``length`` bytes lose nothing. Further
    columns are ignored. The bytes left need not be valid UTF-8, as a repeat may end inside a character.
    """
    n = X.partitions_for(docs.select("doc_id", "text"))
    dealt = X.deal_texts(docs.select("doc_id", "text"), n)

    def bucket_runs(texts):
        """Runs per text; of all their anchors' strings and then themselves, text by text, the hash and the check (0 for strings)."""
        found = [runs(t, length, gram) for t in texts]
        empty = np.zeros(0, np.uint64)
        asked = np.concatenate([y for x in found for y in (x[3], x[4])]) if found else empty
        checks = np.concatenate([y for x in found for y in (np.zeros_like(x[5]), x[5])]) if found else empty
        return found, asked, checks

    def hashes(ids, texts):
        _, asked, checks = bucket_runs(texts)
        every, at, count = np.unique(asked, return_inverse=True, return_counts=True)
        return every, [count, np.bincount(at, checks.astype(np.float64), minlength=len(every)).astype(np.int64) & 0xFFFFFFFF]

    answers = X.sums(dealt, n * X.SPREAD, n, 2, n, hashes, wrapped=(1,))

    def settle(p, ids, texts, sums):
        found, asked, checks = bucket_runs(texts)
        place = np.unique(asked, return_inverse=True)[1] if len(asked) else np.zeros(0, np.int64)
        total, proof = sums[0][place].astype(np.int64), sums[1][place].astype(np.int64)
        # all runs counted under one hash have one check, or else they aren't one kind
        sound = (total * checks.astype(np.int64)) & 0xFFFFFFFF == proof
        covers: tuple[list, list, list] = ([], [], [])
        picked: list[tuple[int, int, int, bool]] = []
        sent: set[int] = set()
        at = 0
        for i, (first, last, _, g, whole, _) in enumerate(found):
            n_g, n_run, one_kind = total[at : at + len(g)], total[at + len(g) : at + 2 * len(g)], sound[at + len(g) : at + 2 * len(g)]
            at += 2 * len(g)
            twice = (n_run > 1) & one_kind
            for k in np.flatnonzero(twice):
                for column, value in zip(covers, (i, first[k], last[k] + length)):
                    column.append(int(value))
            for k in np.flatnonzero(~one_kind | ((n_g > 1) & (n_g > n_run))):
                if twice[k]:
                    if int(whole[k]) in sent:
                        continue
                    sent.add(int(whole[k]))
                picked.append((int(g[k]), i, int(k), bool(n_g[k] > HOT)))
        picked.sort()
        edges: dict[int, list] = {}
        for part in anchored_portions([x[0] for x in picked], [int(found[i][1][k] - found[i][0][k]) + length for _, i, k, _ in picked], SORTED_BYTES):
            buffers, starts, owner, origin, anchor, size = [], [], [], [], [], 0
            for g, i, k, hot in picked[part]:
                first, last = int(found[i][0][k]), int(found[i][1][k])
                own = np.arange(first, last + 1)
                buffers.append(texts[i][first : last + length])
                starts.append(own - first + size)
                owner.append(np.full(len(own), i))
                origin.append(own)
                # a frequent anchor's windows part by a second anchor, so that those with text of their own around it spread over the slices
                anchor.append(np.uint64(g) ^ second_anchors(texts[i], first, last, length, gram) if hot else np.full(len(own), g, np.uint64))
                size += last - first + length
            starts, owner, origin, anchor = map(np.concatenate, (starts, owner, origin, anchor))
            text = np.frombuffer(b"".join(buffers), np.uint8)
            twin, kind = repeated(text, starts, length)
            for a, b in stretches(starts[twin]):
                x, y = np.flatnonzero(twin)[[a, b - 1]]
                for column, value in zip(covers, (owner[x], origin[x], origin[y] + length)):
                    column.append(int(value))
            where = np.flatnonzero(kind)
            new_anchor = np.concatenate([[True], (np.diff(anchor[where]) != 0) | (np.diff(origin[where]) != 1) | (np.diff(owner[where]) != 0)]) if len(where) else None
            for a, b in stretches(starts[where], new_anchor):
                x, y = where[a], where[b - 1]
                data = text[starts[x] : starts[y] + length].tobytes()
                edges.setdefault(int(anchor[x] % np.uint64(n)), []).append((int(owner[x]), int(origin[x]), len(data), int(anchor[x].view(np.int64)), data))
        qs, blobs, kinds = [p % n], [_covers(*covers)], [0]
        for q, own in edges.items():
            qs.append(q)
            kinds.append(1)
            columns = {name: [e[k] for e in own] for k, name in enumerate(("owner", "origin", "size", "anchor"))}
            blobs.append(X.frame([_pack_table(**columns), X.pack(b"".join(e[4] for e in own))]))
        return pa.table({"p": pa.array([p] * len(qs), pa.int32()), "q": pa.array(qs, pa.int32()), "kind": pa.array(kinds, pa.int32()), "data": pa.array(blobs, pa.binary())})

    edges = X.with_answers(dealt, answers, 2, settle, "p int, q int, kind int, data binary")

    def sort_edges(table: pa.Table) -> pa.Table:
        out_p, out, heads, texts = [], [], [], []
        for p, kind, data in zip(*(table.column(c).to_pylist() for c in ("p", "kind", "data"))):
            if not kind:
                out_p.append(p)
                out.append(data)
                continue
            head, text = X.unframe(data)
            own, org, sizes, anchors = (X.unpack_array(x, np.int64) for x in X.unframe(head))
            begin = np.cumsum(sizes) - sizes
            heads.append(np.stack([anchors, np.full(len(own), p), own, org, sizes, begin, np.full(len(own), len(texts))]))
            texts.append(X.unpack(text))
        found: dict[int, tuple[list, list, list]] = {}
        if heads:
            every = np.concatenate(heads, axis=1)
            every = every[:, np.argsort(every[0], kind="stable")]
            for part in anchored_portions(every[0], every[4], SORTED_BYTES):
                _, bucket, owner, origin, sizes, begin, held = every[:, part]
                text = np.frombuffer(b"".join(texts[h][b : b + s] for h, b, s in zip(held, begin, sizes)), np.uint8)
                counts = sizes - length + 1
                line = np.repeat(np.arange(len(sizes)), counts)
                step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                starts = np.repeat(np.cumsum(sizes) - sizes, counts) + step
                twin = np.flatnonzero(repeated(text, starts, length)[0])
                for a, b in stretches(starts[twin]):
                    x, y = twin[a], twin[b - 1]
                    for column, value in zip(found.setdefault(int(bucket[line[x]]), ([], [], [])), (owner[line[x]], origin[line[x]] + step[x], origin[line[y]] + step[y] + length)):
                        column.append(int(value))
        for p, columns in found.items():
            out_p.append(p)
            out.append(_covers(*columns))
        del heads, texts
        release()
        return pa.table({"p": pa.array(out_p, pa.int32()), "covers": pa.array(out, pa.binary())})

    covers = X.by_number(X.by_number(edges, n, "q").groupBy("part", "q").applyInArrow(sort_edges, "p int, covers binary"), n, "p")
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string, digest string" + ", kept binary" * with_bytes

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = X.bucket_texts(left.column("payload").to_pylist())
        marks: list[list] = [[] for _ in texts]
        for data in right.column("covers").to_pylist():
            for i, a, b in zip(*(X.unpack_array(x, np.int64).tolist() for x in X.unframe(data))):
                marks[i].append((a, b))
        rows = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "digest", "kept")}
        for own, text, found in zip(ids, texts, marks):
            if len(own) > 1 and len(text) >= length:
                found = [(0, len(text))]
            spans: list[list[int]] = []
            for a, b in sorted(found):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            edges_ = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges_[::2], edges_[1::2]))
            digest = hashlib.sha256(kept).hexdigest()
            md5 = hashlib.md5(text).hexdigest()
            for i in own:
                for k, v in zip(rows, (i, len(text), len(text) - len(kept), [{"start": a, "stop": b} for a, b in spans], digest, md5, kept)):
                    rows[k].append(v)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": span, "kept_sha256": pa.string(), "digest": pa.string(), "kept": pa.binary()}
        release()
        return pa.table({k: pa.array(rows[k], kinds[k]) for k in rows if with_bytes or k != "kept"})

    return dealt.groupBy("part", "p").cogroup(covers.groupBy("part", "p")).applyInArrow(cut, schema)


def stripped_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeats cut out of their texts, all columns kept; bytes of a character of which a part was cut go too.

    Rows that share a doc_id and differ in text are told apart by text.
    """
    found = remove_repeats(docs, length).where("n_removed > 0")
    key, digest, text = fresh(docs.columns, "cut_id", "cut_digest", "cut_text")
    cut = found.select(F.col("doc_id").alias(key), F.col("digest").alias(digest), F.col("kept").alias(text)).dropDuplicates([key, digest])

    def decode(batches):
        for batch in batches:
            texts = [x.decode("utf-8", "ignore") for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], batch.schema.names)

    cut = cut.mapInArrow(decode, f"{key} long, {digest} string, {text} string")
    same = docs["doc_id"].eqNullSafe(cut[key]) & (F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")) == cut[digest])
    out = docs.join(cut, same, "left")
    return out.select(*(F.coalesce(F.col(text), F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


#: Every window counted by its MD5.
SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, i, md5(b[i + 1:i + 400]) AS k FROM (SELECT rid, b, unnest(range(0, octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
r AS (SELECT rid, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
s AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS head FROM r),
g AS (SELECT rid, i, sum(head) OVER (PARTITION BY rid ORDER BY i) AS run FROM s),
p AS (SELECT rid, run, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY 1, 2),
k AS (SELECT rid, run, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY run), 0) AS since FROM p),
t AS (SELECT rid, string_agg(CASE WHEN a > since THEN hex(b[since + 1:a]) ELSE '' END, '' ORDER BY run) AS head, max(z) AS z, count(*) AS n_spans, sum(z - a) AS n_removed FROM k JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || CASE WHEN octet_length(b) > coalesce(z, 0) THEN hex(b[coalesce(z, 0) + 1:octet_length(b)]) ELSE '' END)) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""
