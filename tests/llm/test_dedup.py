import hashlib

import numpy as np
import pytest

from oddsmill.llm import _text as T, near_dedup, suffix_dedup

from .helpers import DOCS, corpus, near_classes, stripped


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("length", [100, 400])
def test_repeats_as_by_counting_all_windows(spark, rows, docs, length):
    found = suffix_dedup.remove_repeats(docs, length, gram=32).collect()
    want = [(r[0], n, hashlib.sha256(kept).hexdigest()) for r, (n, kept) in zip(rows, stripped([r[1] for r in rows], length))]
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted([(r.doc_id, r.n_removed, r.kept_sha256) for r in found], key=key) == sorted(want, key=key)
    for r in found:
        assert r.n_removed == sum(s.stop - s.start for s in r.spans) and len(r.kept) == r.n_bytes - r.n_removed


def test_stripped_documents_keep_columns_and_rows(spark, rows, docs):
    names = ["doc_id", "text", "lang", "_cut", "kept"]
    out = suffix_dedup.stripped_documents(docs.toDF(*names), 100)
    assert out.columns == names and out.count() == len(rows)


def test_suffix_sort_orders_and_marks():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    starts = np.arange(0, 560)
    pos, same = suffix_dedup.suffix_sort(text, starts, 40)
    raw = text.tobytes()
    assert [raw[p : p + 40] for p in pos] == sorted(raw[s : s + 40] for s in starts)
    assert same.tolist() == [False] + [raw[a : a + 40] == raw[b : b + 40] for a, b in zip(pos, pos[1:])]
    twin, first = suffix_dedup.repeated(text, starts, 8)
    exact = suffix_dedup._repeated_exactly(np.lib.stride_tricks.sliding_window_view(text, 8), starts)
    assert (twin == exact[0]).all() and (first == exact[1]).all()


def test_common_extension_and_hashes_do_not_depend_on_place():
    text = np.frombuffer(b"abcabcabdxabcabcabd", np.uint8)
    prefix = T.prefix_hash(text)
    assert suffix_dedup.common_extension(prefix, np.array([0, 0]), np.array([3, 10]), 9).tolist() == [5, 9]


def test_near_duplicates_as_by_all_pairs(spark, rows, docs):
    found = near_dedup.near_duplicate_classes(docs).collect()
    assert len(found) == len(rows)
    texts = [r[1] for r in rows]
    roots = near_classes(texts, 0.8)
    classes = {}
    for r, root in zip(rows, roots):
        classes.setdefault(root, []).append(r[0])
    want = sorted((r[0] is None, r[0] or 0, len(classes[root]), min((x for x in classes[root] if x is not None), default=-1)) for r, root in zip(rows, roots))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.class_size, -1 if r.class_id is None else r.class_id) for r in found)
    assert got == want
    assert sum(r.kept for r in found) == len(classes)


def test_one_document_of_a_class_stays(spark, rows, docs):
    out = near_dedup.drop_near_duplicates(docs.toDF("doc_id", "text", "class_id", "kept", "label"))
    assert out.columns == ["doc_id", "text", "class_id", "kept", "label"]
    assert out.count() == len(set(near_classes([r[1] for r in rows], 0.8)))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_dedup.near_duplicate_classes(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert near_dedup.drop_near_duplicates(empty).count() == 0
    assert suffix_dedup.stripped_documents(empty).count() == 0


def test_large_group_without_one_centre(spark):
    """Texts that share 70 to 95 % with a base: classes must be those of all pairs, though most fail against the first leader."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            w[rng.randrange(200)] = f"x{i}y{rng.random():.6f}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    roots = near_classes(texts, 0.8)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()}
    assert got == dict(enumerate(roots))


def test_weighted_samples_agree_as_often_as_texts_are_similar():
    h = T.mix(np.arange(400, dtype=np.uint64))
    a, b = h[:300], h[100:]
    w = 1 + (np.arange(400) % 5).astype(float)
    keys = [near_dedup.weighted_samples(x, y, np.array([0]), 600)[:, 0] for x, y in ((a, w[:300]), (b, w[100:]))]
    assert abs((keys[0] == keys[1]).mean() - w[100:300].sum() / w.sum()) < 0.07


def thue_morse(order: int, a: str, b: str) -> str:
    out = a
    for _ in range(order):
        out += out.translate({ord(a): b, ord(b): a})
    return out


def test_strings_that_agree_modulo_a_power_of_two_are_told_apart(spark):
    one, two = thue_morse(10, "a", "b"), thue_morse(10, "b", "a")
    data = [np.frombuffer(x.encode(), np.uint8) for x in (one, two)]
    ends = np.array([0]), np.array([1024])
    assert T.slice_hash(T.prefix_hash(data[0]), *ends) == T.slice_hash(T.prefix_hash(data[1]), *ends)
    assert T.slice_check(T.prefix_check(data[0]), *ends) != T.slice_check(T.prefix_check(data[1]), *ends)
    hashes, _, _, owner = T.words([one.encode(), two.encode(), b"x " + one.encode()])
    assert hashes[0] == hashes[3] != hashes[1]
    assert len(set(T.shingles(hashes, owner, 1)[0].tolist())) == 3
    # as words of documents, as windows and as runs of windows
    texts = [one * 2 + two, two + "middle" + one, one + "x" * 300 + two * 2, "y" + two[:900], "z" + one[:900]]
    for length, hot in ((100, 1_000), (600, 1)):
        suffix_dedup.HOT, kept = hot, suffix_dedup.HOT
        try:
            found = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length, gram=32).collect()
        finally:
            suffix_dedup.HOT = kept
        assert [(r.n_removed, r.kept_sha256) for r in sorted(found)] == [(n, hashlib.sha256(k).hexdigest()) for n, k in stripped(texts, length)]


def test_a_sort_by_colliding_hashes_is_found_out():
    one, two = (thue_morse(10, *x).encode() for x in (("a", "b"), ("b", "a")))
    text = np.frombuffer(b"q" * 20 + one + b"m" + b"q" * 20 + two + b"n" + b"q" * 20 + one + b"l", np.uint8)
    starts = np.arange(0, len(text) - 1040)
    twin, first = suffix_dedup.repeated(text, starts, 1040)
    exact = suffix_dedup._repeated_exactly(np.lib.stride_tricks.sliding_window_view(text, 1040), starts)
    assert (twin == exact[0]).all() and (first == exact[1]).all()
    # what a polynomial modulo 2**64 says of these two: that they agree in 20 + 1024 bytes
    pos = np.array([0, len(one) + 21])
    assert (suffix_dedup.common_extension(T.prefix_hash(text[:20]), pos[:1], pos[:1], 20) == 20).all()
    assert not suffix_dedup.order_holds(text, pos, np.array([0, 1044]), 1044)
    assert not suffix_dedup.order_holds(text, pos, np.array([0, 1000]), 1044)
    assert suffix_dedup.order_holds(text, pos, np.array([0, 20]), 1044)


def test_portions_of_anchors_stay_whole():
    anchors, sizes = np.array([1, 1, 2, 3, 3, 3, 4]), np.array([5, 5, 5, 5, 5, 5, 5])
    got = [(p.start, p.stop) for p in suffix_dedup.anchored_portions(anchors, sizes, 8)]
    assert got == [(0, 2), (2, 3), (3, 6), (6, 7)]


@pytest.fixture
def by_groups(monkeypatch):
    """Arrays go by way of groups of buckets and ranges of slices, as they do between many buckets."""
    from oddsmill.llm import _exchange

    monkeypatch.setattr(_exchange, "ARRAYS", 0)


def test_repeats_by_way_of_groups(spark, rows, docs, by_groups):
    test_repeats_as_by_counting_all_windows(spark, rows, docs, 100)


def test_near_duplicates_by_way_of_groups(spark, rows, docs, by_groups):
    test_near_duplicates_as_by_all_pairs(spark, rows, docs)


def test_arrays_do_not_grow_with_the_square(spark, by_groups, monkeypatch):
    """Four times the texts, buckets and slices: rows between them at most 4**1.5 times as many, and sums are right."""
    from oddsmill.llm import _exchange

    seen = []
    answer = _exchange.answer
    monkeypatch.setattr(_exchange, "answer", lambda asked, *rest: (seen.append(asked.count()), answer(asked, *rest))[1])
    for n in (8, 32):
        docs = spark.createDataFrame([(i, f"word{i} common word{i % 7}") for i in range(40 * n)], "doc_id long, text string")
        dealt = _exchange.deal_texts(docs, n)

        def hashes(ids, texts):
            h, count = np.unique(T.words(texts)[0], return_counts=True)
            return h, [count]

        def work(p, ids, texts, sums):
            import pyarrow as pa

            return pa.table({"n": pa.array([int(sums[0].max())], pa.int64())})

        found = _exchange.with_answers(dealt, _exchange.sums(dealt, 4 * n, 4 * n, 1, n, hashes), 1, work, "n long")
        assert {r.n for r in found.collect()} == {40 * n}
    assert seen[1] <= 8 * seen[0]
