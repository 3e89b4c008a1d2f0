import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import tiktoken

from oddsmill.llm import _text as T, bpe, chat_format, decontaminate, html_extract, kneser_ney, language_id, quality_net, quality_rules
from oddsmill.llm.fm_index import FMIndex

from .helpers import DOCS, corpus, prose, words


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def by_row(found, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in found), key=str)


# --- 1: decontamination


def bench_rows(rows):
    items = [(k, " ".join((rows[k][1] or "").split()[3:40])) for k in range(8)]
    return items + [(8, "The Of"), (9, None), (10, ""), (None, "one"), (0, items[0][1]), (11, "漢字")]


def leaks(rows, items, window=10):
    found = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w and i is not None else 0):
            found[tuple(w[k : k + window])].add(i)
    lengths = {len(k) for k in found}
    out = []
    for r in rows:
        w, hit, own = words(r[1]), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in found:
                    hit |= set(range(k, k + n))
                    own |= found[x]
        digest = hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
        out.append((r[0], len(w), len(hit), len(own), digest, bool(hit)))
    return sorted(out, key=str)


COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_leaks_as_by_all_windows(spark, rows, docs):
    items = bench_rows(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert by_row(decontaminate.leak_report(docs, bench).collect(), *COLUMNS) == leaks(rows, items)


def test_leaks_in_blocks_of_the_benchmark(spark, rows, docs):
    items = bench_rows(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.find_leaks(docs.select("doc_id", "text"), bench)
    many = decontaminate.find_leaks(docs.select("doc_id", "text"), bench, block_words=60)
    assert by_row(one.collect(), "n_words", "n_hit", "spans", "items") == by_row(many.collect(), "n_words", "n_hit", "spans", "items")


def test_cleaning_removes_all_hits(spark, rows, docs):
    items = [x for x in bench_rows(rows) if x[0] not in (8, 11)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = decontaminate.clean_documents(docs.toDF("doc_id", "text", "spans", "items", "n_hit"), bench)
    assert clean.columns == ["doc_id", "text", "spans", "items", "n_hit"] and clean.count() == len(rows)
    assert not [r for r in decontaminate.leak_report(clean, bench).collect() if r.contaminated]


def test_no_benchmark_and_no_documents(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leak_report(docs, bench).where("contaminated").count() == 0
    assert decontaminate.leak_report(docs.limit(0), bench).count() == 0


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 5, 500)
    index = FMIndex(text)
    patterns = [text[i : i + 1 + i % 6] for i in range(0, 480, 7)] + [np.array([1, 9]), np.array([4] * 6)]
    padded = np.array([[0] * (6 - len(p)) + list(p) for p in patterns])
    low, high = index.search(padded, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, b))) == want


# --- 2: chat


def chat_rows():
    return [
        (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c\n"), (2, 0, None, "<|end|>\\<|role|>"), (2, 0, "assistant", None),
        (3, None, "assistant", "</s>\\\\<|"), (3, 1, "assistant", "|next|>"), (3, 1, "assistant", "|next|>"), (None, 1, "user", "😀 <\\|"), (None, 2, "assistant", "😀<"), (None, 3, "assistant", "|text|>"),
    ]


def test_chat_reads_back(spark):
    conversations = spark.createDataFrame(chat_rows(), "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(conversations)).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in chat_rows():
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(found) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        assert [(t.role, t.text) for t in found[c].turns] == [x[2:] for x in turns]
        assert found[c].loss_text == "".join(x[3] for x in turns if x[2] == "assistant")


def test_chat_merges_adjacent_turns_and_masks(spark):
    conversations = spark.createDataFrame([(1, 0, "user", "q", 1), (1, 1, "assistant", "a", 2), (1, 2, "assistant", "b", 3)], "conv_id long, turn long, role string, text string, formatted long")
    r = chat_format.formatted(conversations).collect()[0]
    assert r.formatted == "<|role|>user<|text|>q<|end|><|role|>assistant<|text|>a<|next|>b<|end|>"
    assert len(r.loss_mask) == len(r.formatted) and "".join(c for c, m in zip(r.formatted, r.loss_mask) if m == "1") == "ab"
    assert chat_format.digests(conversations.limit(0)).count() == 0


# --- 3: byte pairs


def reference_tokenizer():
    path, pattern = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_tokens_as_the_library_has_them(spark, rows, docs):
    enc = reference_tokenizer()
    found = bpe.encode_documents(docs.withColumnRenamed("lang", "ids")).collect()
    want = sorted(((r[0], enc.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows), key=str)
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in found), key=str) == want
    digests = by_row(bpe.token_digests(docs).collect(), "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == sorted(((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(data)) for i, ids, data in want), key=str)
    assert bpe.token_digests(docs.limit(0)).count() == 0


def test_long_pieces_and_decoding(spark):
    enc = reference_tokenizer()
    own = bpe.codec(*bpe.default_vocabulary())
    for text in ("=-" * 300, "abcdefghij" * 60, "é" * 200):
        ids = enc.encode_ordinary(text)
        assert [int(x) for x in next(own.run([text]))[0].split(",")] == ids
        assert own.decode_lists([ids, []]) == [text.encode(), b""]
    back = bpe.decode_ids(spark.createDataFrame([(1, enc.encode_ordinary("one two")), (2, None), (3, [])], "k long, ids array<int>")).collect()
    assert [None if r.decoded is None else bytes(r.decoded) for r in sorted(back)] == [b"one two", None, b""]
    with pytest.raises(ValueError):
        own.decode_lists([[10**6]])


def plain_bpe(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
        if not found:
            return [ranks[x] for x in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_contraction_of_any_vocabulary(tmp_path, seed):
    """Ranks in no order, so that contractions make pairs of lower ranks than their own."""
    import base64
    import random

    rng = random.Random(seed)
    more = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(120)}
    tokens = [bytes([i]) for i in range(256)] + rng.sample(sorted(more), len(more))
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    own = bpe.Codec(str(path), r"\w+|\W")
    pieces = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (1, 2, 3, 7, 30, 100, 300)] + [b"a" * 301, b"ab" * 200]
    want = [plain_bpe(own.ranks, p) for p in pieces]
    assert own.contract(pieces) == want and own.contract(pieces, bpe.ENCODE_LONG) == want


def test_a_text_without_a_space():
    import random

    enc, own, rng = reference_tokenizer(), bpe.codec(*bpe.default_vocabulary()), random.Random(4)
    for alphabet, n in (("etaoinshrdlu", 6_000), ("ab", 100_000), ("aé漢ß", 30_000)):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        joined, back, count = next(own.run([text]))
        ids = enc.encode_ordinary(text)
        assert [int(x) for x in joined.split(",")] == ids and count == len(ids) and back == text.encode()


def test_decoded_bytes_come_from_the_ids(monkeypatch):
    own = bpe.Codec(*bpe.default_vocabulary())
    own.young["one"] = ",".join(map(str, reference_tokenizer().encode_ordinary("two")))
    assert next(own.run(["one"]))[1] == b"two"
    monkeypatch.setattr(bpe, "CHUNK", 7)
    monkeypatch.setattr(bpe, "DECODED", 20)
    texts = ["some words, and then some more of them " * 5, "", "x", "漢字 " * 9]
    assert [b for _, b, _ in own.run(texts)] == [t.encode() for t in texts]


# --- 4: language model


def plain_model(rows):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + ["</s>"] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    train = [t for t, h in zip(toks, held) if not h]
    c = collections.Counter(x for t in train for x in t)
    pairs = collections.Counter(p for t in train for p in zip(["<s>"] + t[:-1], t))
    context, reached = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (u, w), n in pairs.items():
        context[u][0] += n
        context[u][min(n, 3)] += 1
        reached[w] += 1
    d, e = (kneser_ney.discounts([sum(v == k for v in x.values()) for k in (1, 2, 3, 4)]) for x in (pairs, reached))
    a, v, n = sum(reached.values()), len(c), sum(c.values())
    back = sum(e[min(x, 3)] for x in reached.values()) / a
    out = []
    for (i, *_), t, h in zip(rows, toks, held):
        score = base = 0.0
        for u, w in zip(["<s>"] + t[:-1], t):
            low_p = max(reached[w] - e[min(reached[w], 3)], 0) / a + back / (v + 1)
            z = context.get(u)
            score += math.log10((max(pairs[u, w] - d[min(pairs[u, w], 3)], 0) + (d[1] * z[1] + d[2] * z[2] + d[3] * z[3]) * low_p) / z[0] if z else low_p)
            base += math.log10((c[w] + 1) / (n + v + 1))
        out.append((str(i), h, len(t), sum(c[w] > 0 for w in t), n, round(base, 6), round(score, 5)))
    return sorted(out)


def test_language_model_as_by_dictionaries(spark, rows, docs):
    found = kneser_ney.scores(docs).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5)) for r in found)
    assert got == plain_model(rows)


def test_language_model_without_texts(spark, docs):
    assert kneser_ney.scores(docs.limit(0)).count() == 0
    one = kneser_ney.scored(docs.limit(2), kneser_ney.fit(docs.limit(0))).collect()
    assert all(np.isfinite(r.score) for r in one)


def test_probabilities_add_up(spark, rows):
    texts = [(t or "").encode() for _, t, *_ in rows[:6]]
    model = kneser_ney.fit(spark.createDataFrame([(t.decode(),) for t in texts], "text string"))
    own = kneser_ney.tables(model)
    vocabulary = sorted({w for t in texts for w in t.lower().split()})
    start = sum(10 ** (own.score([w])[3][0] - (own.score([w])[3][0] - _first(own, w))) for w in vocabulary)
    end = 10 ** own.score([b""])[3][0]
    unknown = 10 ** _first(own, b"never-seen-word")
    assert abs(start + end + unknown - 1) < 1e-6


def _first(own, word):
    """log10 P(word | start): the score of ``word`` less that of its end."""
    p = own.score([word])[3][0]
    word_hash, before, owner = kneser_ney.tokens([word])
    m, t = own.model, own.model.totals
    pair = own.look_up(own.pairs, own.wide, kneser_ney.pair_keys(word_hash, before))
    reached = own.look_up(own.stats, own.narrow, kneser_ney.short(word_hash), 5)[:, 4]
    context = own.look_up(own.stats, own.narrow, kneser_ney.short(before), 5)
    d, e = m.pair_discount, m.word_discount
    back = (e[1] * t["conts_1"] + e[2] * t["conts_2"] + e[3] * (t["reached"] - t["conts_1"] - t["conts_2"])) / t["conts"]
    low = np.maximum(reached - e[np.minimum(reached, 3).astype(int)], 0) / t["conts"] + back / (t["words"] + 1)
    rest = d[1] * context[:, 1] + d[2] * context[:, 2] + d[3] * context[:, 3]
    prob = np.where(context[:, 0] > 0, (np.maximum(pair - d[np.minimum(pair, 3).astype(int)], 0) + rest * low) / np.maximum(context[:, 0], 1), low)
    assert abs(np.log10(prob).sum() - p) < 1e-9
    return math.log10(prob[0])


def test_pairs_can_be_had_back_from_their_keys():
    rng = np.random.default_rng(1)
    word, before = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2), rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    found = kneser_ney.pair_words(kneser_ney.pair_keys(word, before), kneser_ney.pair_low(word))
    assert (found[0] == kneser_ney.short(before)).all() and (found[1] == kneser_ney.short(word)).all()
    keys, counts, low = kneser_ney.counted_pairs(np.tile(kneser_ney.pair_keys(word, before), 3), np.tile(kneser_ney.pair_low(word), 3))
    assert (counts == 3).all() and set(zip(keys.tolist(), low.tolist())) == set(zip(kneser_ney.pair_keys(word, before).tolist(), kneser_ney.pair_low(word).tolist()))


# --- 5: pages

PAGE = """<html><head><title>T</title><script>x("<p>no</p>")</script></head><body><nav><a href=x>menu</a></nav><div class="ad-box ad">buy</div>
<div class="post-12 story"><h1>Head &amp; line</h1><p>One <b>two<br><p>Three
 four &#233;</p><ul><li>a<li>b</ul><div class="comments"><p>nice post</p></div><form><p>mail</p></form></div><div class="cookie-notice">accept</div><footer>f</footer></body></html>"""


def test_page_text_and_paths(spark):
    pages = [(1, "http://h.org/1", PAGE), (2, "http://h.org/2", PAGE.replace("post-12", "post-99")), (3, "http://h.org/3", None), (4, None, "plain < text"), (5, "http://[bad", "<p>x"), (1, "http://h.org/1", PAGE)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = html_extract.main_texts(df).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == 6 and texts == {1: "Head & line\nOne two\nThree four é\na\nb", 2: "Head & line\nOne two\nThree four é\na\nb", 3: "", 4: "plain < text", 5: "x"}
    assert all(r.n_chars == len(r.text) for r in found)
    assert {r.host: r.paths[0] for r in html_extract.host_paths(df).collect()}["h.org"] == "/html/body/div.post-.story"
    clash = html_extract.extracted(df.selectExpr("page_id", "url", "html", "'z' AS text", "1 AS host"))
    assert clash.columns == ["page_id", "url", "host", "text"] and clash.count() == 6
    assert html_extract.main_texts(df.limit(0)).count() == 0


def test_host_path_overrides_a_page_with_a_larger_odd_container(spark):
    usual = "<body><div class=main><p>{}</p></div><div class=extra><p>{}</p></div></body>"
    pages = [(i, "http://h.org", usual.format("story " * 50, "x")) for i in range(5)] + [(9, "http://h.org", usual.format("short story", "trailer " * 60))]
    texts = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert texts[9] == "short story"


def _texts(spark, pages):
    return {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_articles_of_several_containers_are_whole(spark):
    pages = [
        (1, "http://a.org", "<body><article><h1>Title</h1><div class=body><p>{}</p></div></article></body>".format("story " * 50)),
        (2, "http://b.org", "<body><article><section class=intro><p>{}</p></section><section class=main><p>{}</p></section></article></body>".format("intro " * 20, "story " * 50)),
        (3, "http://c.org", "<body><div class=post><h1>Title</h1><div class=text><p>{}</p></div></div><div class=extra><p>x y</p></div></body>".format("story " * 50)),
        (4, "http://d.org", "<body><div class=post><div class=lead><p>{}</p></div><div class=text><p>{}</p></div></div><div class=extra>x y</div></body>".format("intro " * 40, "story " * 50)),
        (5, "http://e.org", "<body><main><h1>Title</h1><article><p>{}</p><div class=comments>no</div></article></main></body>".format("story " * 50)),
    ]
    intro, story = ("intro " * 20).strip(), ("story " * 50).strip()
    assert _texts(spark, pages) == {1: f"Title\n{story}", 2: f"{intro}\n{story}", 3: f"Title\n{story}", 4: f"{intro} {intro}\n{story}", 5: f"Title\n{story}"}


def test_rare_templates_of_a_large_host_have_their_consensus(spark):
    page = "<body><div class=main-{0}><p>{1}</p></div><div class=extra-{0}><p>{2}</p></div></body>"
    names = "abcdefghijklmnopqrst"
    pages = [(k * 10 + i, "http://h.org", page.format(x, "story " * 50, "x")) for k, x in enumerate(names) for i in range(5 if x == "t" else 7)]
    pages.append((999, "http://h.org", page.format("t", "short story", "trailer " * 60)))
    assert _texts(spark, pages)[999] == "short story"


# --- 6: rules


def test_rules_as_by_plain_counting(spark, rows, docs):
    def measures(text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        wins = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)

    found = quality_rules.judged(docs.withColumnRenamed("source", "_words")).collect()
    assert by_row(found, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((r[0], *measures(r[1])) for r in rows), key=str)
    kept = quality_rules.kept_documents(docs.withColumnRenamed("lang", "n_words"))
    assert kept.columns == ["doc_id", "text", "n_words", "source", "n_chars"] and kept.count() == sum(r.kept for r in found)
    assert quality_rules.judged(docs.limit(0)).count() == 0
    assert not [e for e in ("Python", "Arrow", "Pandas") if e in quality_rules.judged(docs)._jdf.queryExecution().optimizedPlan().toString()]


# --- 8 and 10: models


def labelled(n=200):
    import random

    rng = random.Random(9)
    texts, langs = [], []
    for i in range(n):
        letters = "abcdefghij" if i % 2 else "qrstuvwxyzé"
        texts.append(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(30)))
        langs.append("aa" if i % 2 else "qq")
    return [(i, t, x) for i, (t, x) in enumerate(zip(texts, langs))]


def test_languages(spark):
    rows = labelled() + [(900, None, "aa"), (901, "123 !", "qq"), (902, "abc", None), (None, "abc abd", "aa"), (5, labelled()[5][1], "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.predictions(docs).collect()
    truth = {i: x for i, _, x in rows}
    assert len(found) == len(rows)
    assert all(r.lang_pred == truth[r.doc_id] for r in found if r.doc_id is not None and r.doc_id < 900)
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    assert und == {900, 901} and all(0 <= r.score <= 1 for r in found)
    assert language_id.predictions(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.predictions(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_quality(spark):
    rng = __import__("random").Random(4)
    rows = [(i, prose(rng, 60) if i % 3 else prose(rng, 60).upper().replace(" ", "### ")) for i in range(200)] + [(900, None), (901, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_net.predictions(docs, labels).collect()
    held = [r for r in found if r.held_out and r.doc_id < 200]
    assert len(found) == len(rows) and len(held) > 20
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.predicted for r in quality_net.predictions(docs, labels.limit(0)).collect()} == {0}
    assert quality_net.predictions(docs.limit(0), labels).count() == 0


def test_filters_meet_every_byte():
    net = quality_net.Net()
    tops = lambda text: net.pooled(text)[0]
    assert (tops(b"abcdefg") != tops(b"abcdef#")).any()
    even, odd = (tops(b" " * k + b"Qx7#z!" + b" " * (40 - k)) for k in (10, 11))
    assert np.allclose(even, odd)
    long = b"".join(b"%d word, " % i for i in range(300))
    assert np.allclose(tops(long)[1:], tops(long[512:]))


def test_word_hashes_are_those_of_the_words():
    texts = [b"One two one", b"", b"TWO;three\xc3\xa9 one"]
    h, start, end, owner = T.words(texts)
    flat = b" ".join([*texts, b""])
    names = [flat[a:b].lower() for a, b in zip(start, end)]
    assert names == [b"one", b"two", b"one", b"two", b"three\xc3\xa9", b"one"] and owner.tolist() == [0, 0, 0, 2, 2, 2]
    assert len(set(zip(names, h.tolist()))) == len(set(names)) == len(set(h.tolist()))
    assert (kneser_ney.unmix(T.mix(h)) == h).all()
