"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, checked by weighted Jaccard similarity.

1. Texts are dealt to buckets, copies reduced to one text (see ``_exchange``). Each bucket asks for the
   document frequency of its five-word shingles over all documents, and in how many different texts
   each stands. Weight of a shingle: occurrences x (1 + ln((N + 1) / (df + 1))), N rows in all.
2. A pair with sum-of-minima / sum-of-maxima >= t shares at least t of either text's weight, so a text
   whose shingles with a second text weigh less than t of it has no partner; this drops most texts and loses
   nothing. Of the others, improved consistent weighted sampling (Ioffe 2010) draws bands x rows samples from the
   shared shingles. (Shingles no other text has cannot match; leaving them out of the draw only raises the chance to meet.)
3. Texts that agree on a band are candidates. First each is compared with the smallest key of its bands, which settles
   most. In bands that then still hold several classes, the texts outside the largest class are a query set that
   is compared in blocks with all texts of those bands; only links leave a task. So every candidate pair is either compared or
   in one class already.
4. A compared pair counts if its exact weighted Jaccard similarity is at least t; classes are connected components of these
   pairs and of equal texts. All joins are on text keys or bands with small rows; hot keys are left to the skew join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import _exchange as X, _text as T
from ._store import fresh, release, written

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 12, 3
#: Texts in a block of a query set, and of the texts it is compared with.
BLOCK = 128
#: Bytes of text hashed at a time.
PORTION = 1 << 20
#: Parts of a class's texts where they are joined to what is known of the class.
SALTS = 16


def text_shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, occurrences, text index, ordered by text and hash."""
    hs, tfs, own = [], [], []
    for part in T.portions([len(t) for t in texts], PORTION):
        word, _, _, owner = T.words(texts[part])
        h, o = T.shingles(word, owner, width)
        order = np.argsort(o, kind="stable")
        h, o = h[order], o[order]
        cuts = np.searchsorted(o, np.arange(part.stop - part.start + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                u, c = np.unique(h[a:b], return_counts=True)
                hs.append(u)
                tfs.append(c)
                own.append(np.full(len(u), part.start + i))
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hs), np.concatenate(tfs), np.concatenate(own)


def weighted_samples(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """samples x texts: for each text the sampled (shingle, level) as one hash. starts: where each text's shingles begin."""
    log_w = np.log(weight)
    sizes = np.diff(np.append(starts, len(h)))
    out = np.empty((samples, len(starts)), np.uint64)
    scale = 1.0 / (1 << 32)
    for k in range(samples):
        one = T.mix(h + np.uint64((k * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
        two = T.mix(one ^ np.uint64(0xD6E8FEB86659FD93))
        low = np.uint64(0xFFFFFFFF)
        u1, u2 = ((one >> np.uint64(32)) + 0.5) * scale, ((one & low) + 0.5) * scale
        u3, u4 = ((two >> np.uint64(32)) + 0.5) * scale, ((two & low) + 0.5) * scale
        beta = (T.mix(two) >> np.uint64(32)) * scale
        r, c = -np.log(u1 * u2), -np.log(u3 * u4)
        level = np.floor(log_w / r + beta)
        rank = np.log(c) - r * (level - beta) - r
        least = np.minimum.reduceat(rank, starts)
        hit = np.flatnonzero(rank == np.repeat(least, sizes))
        first = hit[np.searchsorted(hit, starts)]
        out[k] = T.mix(h[first] ^ T.mix(level[first].astype(np.int64).view(np.uint64)))
    return out


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    """bands x texts."""
    bands = len(samples) // rows
    out = np.zeros((bands, samples.shape[1]), np.uint64)
    for b in range(bands):
        key = np.full(samples.shape[1], np.uint64(b + 1))
        for r in range(rows):
            key = T.mix(key ^ samples[b * rows + r])
        out[b] = key
    return out.view(np.int64)


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return 1.0 + np.log((n + 1.0) / (df + 1.0))


def text_table(docs: DataFrame, width: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """One row per distinct text: key, ids, bands (empty for texts without a possible partner), vector, weight."""
    n_rows = docs.count()
    n = X.partitions_for(docs)
    dealt = X.deal_texts(docs, n)

    def hashes(ids, texts):
        h, _, owner = text_shingles(texts, width)
        every, back = np.unique(h, return_inverse=True)
        copies = np.array([len(x) for x in ids], np.float64)
        return every, [np.bincount(back, minlength=len(every)), np.bincount(back, copies[owner], minlength=len(every)).astype(np.int64)]

    answers = X.sums(dealt, n * X.SPREAD, X.slices_for(docs, n), 2, n, hashes)
    schema = "key long, ids array<long>, digest string, blank boolean, bands array<long>, vector binary, weight double"

    def work(p, ids, texts, sums):
        h, tf, owner = text_shingles(texts, width)
        every, back = np.unique(h, return_inverse=True)
        shared, weight = (sums[0] > 1)[back], tf * idf(sums[1].astype(np.float64), n_rows)[back]
        total = np.bincount(owner, weight, minlength=len(texts))
        common = np.bincount(owner, weight * shared, minlength=len(texts))
        alive = (total > 0) & (common >= threshold * total * (1 - 1e-9))
        keep = shared & alive[owner]
        h, weight, owner = h[keep], weight[keep], owner[keep]
        who, starts = np.unique(owner, return_index=True)
        own: list = [[]] * len(texts)
        vectors: list = [None] * len(texts)
        for part in T.portions(np.diff(np.append(starts, len(h))), 1 << 18):
            a, b = starts[part.start], starts[part.stop] if part.stop < len(starts) else len(h)
            keys = band_keys(weighted_samples(h[a:b], weight[a:b], starts[part] - a, bands * rows), rows)
            for j, i in enumerate(who[part]):
                own[i] = np.unique(keys[:, j])
                x = starts[part.start + j]
                y = starts[part.start + j + 1] if part.start + j + 1 < len(starts) else len(h)
                vectors[i] = X.frame([X.pack_sorted(h[x:y] >> np.uint64(24)), X.pack_array(weight[x:y].astype(np.float32))])
        key = [(p << 32) | i for i in range(len(texts))]
        digest = [hashlib.md5(t).hexdigest() for t in texts]
        return pa.table({"key": pa.array(key, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64())), "digest": pa.array(digest, pa.string()), "blank": pa.array([not t for t in texts], pa.bool_()), "bands": pa.array(own, pa.list_(pa.int64())), "vector": pa.array(vectors, pa.binary()), "weight": pa.array(total, pa.float64())})

    return written(X.with_answers(dealt, answers, 2, work, schema), "near-texts")


def vector_similarity(a: bytes, b: bytes, weight_a: float, weight_b: float) -> float:
    """Weighted Jaccard similarity from the shared shingles of two texts and their whole weights."""
    (ha, wa), (hb, wb) = ((X.unpack_sorted(h), X.unpack_array(w, np.float32)) for h, w in (X.unframe(a), X.unframe(b)))
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    least = float(np.minimum(wa[i], wb[j]).astype(np.float64).sum())
    return least / (weight_a + weight_b - least)


def compared(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    vectors = texts.where("vector is not null").select("key", "vector", "weight")
    sides = pairs.join(vectors.toDF("b", "vb", "wb"), "b").join(vectors.toDF("a", "va", "wa"), "a").select("a", "b", "va", "vb", "wa", "wb")

    def verify(batches):
        for batch in batches:
            a, b, va, vb, wa, wb = (batch.column(i).to_pylist() for i in range(6))
            hit = [i for i in range(len(a)) if vector_similarity(va[i], vb[i], wa[i], wb[i]) >= threshold - 1e-6]
            yield pa.record_batch([pa.array([a[i] for i in hit], pa.int64()), pa.array([b[i] for i in hit], pa.int64())], ["a", "b"])
        release()

    return sides.mapInArrow(verify, "a long, b long")


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(key, label) for every key with an edge: the smallest key it is linked to. labels: classes known before, as (key, label).

    Each round hooks every node to its smallest neighbour, follows parents twice, and contracts; the number of
    live nodes at least halves, and only keys move.
    """
    if labels is not None:
        edges = relabelled(edges, labels)
    edges = written(edges.where("a <> b"), "near-edges")
    found = labels
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).select("node", F.least("node", "parent").alias("parent"))
        for _ in range(2):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            parent = parent.join(up, "parent").select("node", F.col("top").alias("parent"))
        parent = written(parent, "near-parents")
        if found is None:
            found = parent.select(F.col("node").alias("key"), F.col("parent").alias("label"))
        else:
            grown = found.join(parent.withColumnRenamed("node", "label"), "label", "left").select("key", F.coalesce("parent", "label").alias("label"))
            fresh = parent.join(found.select(F.col("key").alias("node")), "node", "left_anti").select(F.col("node").alias("key"), F.col("parent").alias("label"))
            found = written(grown.union(fresh), "near-labels")
        edges = written(relabelled(edges, parent.toDF("key", "label")).where("a <> b").distinct(), "near-edges")
    return found if found is not None else edges.select(F.col("a").alias("key"), F.col("b").alias("label"))


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    one = labels.toDF("a", "la")
    two = labels.toDF("b", "lb")
    return edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))


def text_classes(texts: DataFrame, threshold: float) -> DataFrame | None:
    """(key, label) of the texts that are linked to another text; None if there are no candidates."""
    every = texts.where("size(bands) > 0").select("key", F.explode("bands").alias("band"))
    heads = every.groupBy("band").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "head")
    members = written(every.join(heads, "band").select("band", "key", "head"), "near-members")
    if members.isEmpty():
        return None
    pairs = members.where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b")).distinct()
    labels = components(compared(pairs, texts, threshold))
    classed = members.join(labels, "key", "left").select("band", "key", F.coalesce("label", "key").alias("label"))
    sizes = classed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("band", F.col("top.label").alias("top"))
    mixed = written(classed.join(largest, "band").select("top", "key", "label").distinct(), "near-mixed")
    if mixed.isEmpty():
        return labels
    return components(block_links(mixed, texts, threshold), labels)


def with_salts(rows: DataFrame) -> DataFrame:
    """rows once for each salt, for a merge join: their size is judged before they are copied, so a broadcast would be of SALTS times what Spark allows."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def block_links(mixed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between texts of different classes in mixed(top, key, label), where one is outside the class ``top``.

    Per top, the texts outside it are a query set against all its texts: both are packed into blocks of about BLOCK vectors. Each query block
    goes to all member blocks of its top by their numbers, so a large group is spread over as many keys as it has blocks; a row's texts are
    compared through shared shingles where the blocks meet, and the links alone leave the task.
    """
    vectors = texts.where("vector is not null").select("key", "vector", "weight")
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt")

    def blocks(side: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """How many blocks each top has, and the blocks; texts get their numbers in salted parts of a top, before their vectors are joined to them."""
        count = side.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(f"n_{name}"))
        salted = with_salts(count)
        dealt = side.select("*", salt).join(salted, ["top", "salt"]).select("top", "key", "label", F.pmod(F.xxhash64("key", F.lit(1)), f"n_{name}").alias(name))
        return count, dealt.join(vectors, "key").groupBy("top", name).agg(F.collect_list(F.struct("key", "label", "weight", "vector")).alias(f"{name}s"))

    count, members = blocks(mixed, "member")
    _, queries = blocks(mixed.where("label <> top"), "query")
    asked = queries.join(count, "top").withColumn("member", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_member") - 1)))
    joined = asked.select("top", "member", "querys").join(members, ["top", "member"]).select("members", "querys")

    def compare(batches):
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                for x, y in compared_blocks(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), threshold):
                    a.append(x)
                    b.append(y)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        release()

    return joined.mapInArrow(compare, "a long, b long").distinct()


def compared_blocks(members: list[dict], queries: list[dict], threshold: float):
    """The pairs of texts of different classes whose similarity reaches the threshold; weights are added up over the queries' shingles."""
    hashes, weights, who = [], [], []
    for i, q in enumerate(queries):
        h, w = X.unframe(q["vector"])
        hashes.append(X.unpack_sorted(h))
        weights.append(X.unpack_array(w, np.float32))
        who.append(np.full(len(hashes[-1]), i))
    hashes, weights, who = map(np.concatenate, (hashes, weights, who))
    order = np.argsort(hashes, kind="stable")
    hashes, weights, who = hashes[order], weights[order], who[order]
    total = np.array([q["weight"] for q in queries])
    labels = np.array([q["label"] for q in queries])
    for m in members:
        h, w = X.unframe(m["vector"])
        h, w = X.unpack_sorted(h), X.unpack_array(w, np.float32)
        low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        least = np.bincount(who[at], np.minimum(np.repeat(w, n), weights[at]), minlength=len(queries))
        for i in np.flatnonzero((least / (total + m["weight"] - least) >= threshold - 1e-6) & (labels != m["label"])):
            yield min(m["key"], queries[i]["key"]), max(m["key"], queries[i]["key"])


def near_duplicate_classes(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, class_size, kept, digest (MD5 of the text) for every row of docs(doc_id, text).

    class_id is the smallest doc_id of the class; ``kept`` marks one row of each class, one with that doc_id.
    Equal texts are in one class. A null text, and an empty one, is a class of its own for each row. A text of fewer words than
    ``width`` is one shingle; a text without words is linked to equal texts only. Repeated rows are copies. Rows without a doc_id take part;
    a class of such rows alone has a null class_id. Further columns are ignored.
    """
    texts = text_table(docs.select("doc_id", "text"), width, threshold, bands, rows)
    labels = text_classes(texts, threshold)
    base = texts.where("not blank").select("key", "ids", "digest")
    columns = ["doc_id", "class_id", "class_size", "kept", "digest"]
    # ids are sorted, nulls last, so the first is a text's least
    lone = base if labels is None else base.join(labels, "key", "left_anti")
    out = lone.select(F.posexplode("ids").alias("at", "doc_id"), F.get("ids", F.lit(0)).alias("class_id"), F.size("ids").cast("long").alias("class_size"), "digest").withColumn("kept", F.col("at") == 0).select(columns)
    if labels is not None:
        big = F.lit((1 << 63) - 1)
        linked = base.join(labels, "key")
        first = linked.groupBy("label").agg(F.min(F.struct(F.coalesce(F.get("ids", F.lit(0)), big).alias("id"), "key")).alias("first"), F.sum(F.size("ids")).alias("class_size"))
        # a large class's texts part by a salt
        salted = with_salts(first)
        both = linked.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["label", "salt"])
        rows_of = both.select(F.posexplode("ids").alias("at", "doc_id"), F.nullif(F.col("first.id"), big).alias("class_id"), "class_size", ((F.col("first.key") == F.col("key"))).alias("leads"), "digest")
        out = out.union(rows_of.withColumn("kept", F.col("leads") & (F.col("at") == 0)).select(columns))
    blank = texts.where("blank").select(F.explode("ids").alias("doc_id"), "digest")
    return out.union(blank.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "digest"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, all columns kept. Of rows equal in doc_id and text one stays."""
    key, mark, place = fresh(docs.columns, "kept_id", "kept_digest", "kept_at")
    kept = near_duplicate_classes(docs, **options).where("kept").select(F.col("doc_id").alias(key), F.col("digest").alias(mark)).distinct()
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    same = docs["doc_id"].eqNullSafe(kept[key]) & (F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")) == kept[mark])
    left = docs.join(kept, same, "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("doc_id", digest).orderBy(*(F.xxhash64(F.to_json(F.struct(F.col(f"`{c}`").alias("v")))) for c in others) or [F.lit(0)])
    return left.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, count(*) OVER () AS n FROM documents),
w AS (SELECT rid, n, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
s AS (SELECT rid, n, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
t AS (SELECT rid, n, sh, count(*) AS tf FROM s GROUP BY 1, 2, 3),
f AS (SELECT sh, count(*) AS df FROM t GROUP BY 1),
x AS (SELECT rid, sh, df, tf * (1 + ln((n + 1.0) / (df + 1.0))) AS weight FROM t JOIN f USING (sh)),
total AS (SELECT rid, sum(weight) AS whole FROM x GROUP BY 1),
pairs AS (SELECT a.rid AS a, b.rid AS b, sum(least(a.weight, b.weight)) AS m FROM x a JOIN x b ON a.sh = b.sh AND a.rid < b.rid WHERE a.df > 1 GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN total p ON p.rid = a JOIN total q ON q.rid = b WHERE m / (p.whole + q.whole - m) >= 0.8
  UNION SELECT p.rid, q.rid FROM d p JOIN d q ON p.text = q.text AND p.rid < q.rid WHERE p.text <> ''),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, l.b FROM reach r JOIN ways l ON l.a = r.other),
found AS (SELECT r.rid, min(o.doc_id) AS class_id, count(*) AS class_size FROM reach r JOIN d o ON o.rid = r.other GROUP BY 1)
SELECT doc_id, class_id, class_size::BIGINT AS class_size, doc_id = class_id AS kept FROM d JOIN found USING (rid)
"""
