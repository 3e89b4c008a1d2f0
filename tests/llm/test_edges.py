"""Plain versions of language profiles and the byte convolution, many benchmark blocks, and the awkward cases of each stage."""

import math
import unicodedata
import zlib

import numpy as np
import pytest

import corpus_pipeline
from oddsmill.llm import decontaminate, html_extract, kneser_ney, language_id, quality_net
from oddsmill.llm._store import written

from .helpers import DOCS, corpus, prose, words


# --- 1: many blocks


def plain_leaks(texts, items, window=10):
    wins = {}
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w and item is not None else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for t in texts:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    own |= wins[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(own)))
    return out


def test_many_blocks_and_a_hot_document(spark):
    import random

    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 25, 90]))) for i in range(60)] + [(7, prose(rng, 400)), (None, "no id at all in this one here and more words"), (61, None), (62, "...")]
    hot = prose(rng, 20) + " " + items[3][1] + " " + items[60][1][200:900]
    texts = [hot] * 200 + [prose(rng, 30) + " " + t for _, t in items if t] + [None, "", items[60][1]]
    docs = spark.createDataFrame([(i % 5, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spans long").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontaminate.window_blocks(bench, 10, 60)[1]) >= 20
    # a block never holds more words than asked for
    folder, names = decontaminate.window_blocks(bench, 10, 60)
    for name in names:
        w = decontaminate.mapped_windows(folder, name)
        assert len(w.rows) <= 60 and w.starts[-1] == len(w.items)
    found = decontaminate.find_leaks(docs.withColumnRenamed("spans", "n"), bench, block_words=60).collect()
    want = plain_leaks(texts, items)
    assert sorted((r.n, r.n_words, r.n_hit, list(r.items)) for r in found) == [(i, *x) for i, x in enumerate(want)]
    assert decontaminate.find_leaks(docs, bench, block_words=60).columns == ["doc_id", "text", "n_words", "n_hit", "spans", "items"]
    clean = decontaminate.clean_documents(docs, bench, block_words=60)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    assert {r.text for r in clean.collect() if r.spans < 200} == {r.text for r in decontaminate.clean_documents(docs, bench).collect() if r.spans < 200}


# --- 4: language model


def test_scores_of_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(1, "a b a b c", 5), (1, "a b a b c", 6), (None, "a b", 7), (None, None, 8), (3, "", None), (4, "x " * 3000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    model = kneser_ney.fit(docs)
    out = kneser_ney.scored(docs.withColumnRenamed("score", "_c0").withColumn("n_known", docs["doc_id"]), model)
    assert out.columns == ["doc_id", "text", "_c0", "n_tokens", "n_known", "base_score", "score", "perplexity"]
    by = {r._c0: r for r in out.collect()}
    assert by[5].score == by[6].score and by[8].score == by[None].score and by[8].n_tokens == 1 and by[9].n_tokens == 3001
    assert all(math.isfinite(r.score) and r.score <= 0 for r in by.values())
    assert kneser_ney.scores(docs.limit(0)).count() == 0


# --- 5: pages


def test_pages_of_many_shapes_as_of_few(spark, monkeypatch):
    page = lambda i: f"<html><body><nav>menu</nav><div class='post{'abc'[i % 3]}'><p>Text number {i} of an article, with words.</p></div><div class=side>related</div></body></html>"
    rows = [(i, f"http://h{i % 2}.example/{i}", page(i)) for i in range(40)] + [(90, None, None), (91, "http://h0.example/x", ""), (92, "::bad::[", "<p>only"), (93, "http://h1.example/long", page(1) * 2 + "<p>word " * 20_000)]
    pages = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string")
    few = sorted(map(str, html_extract.main_texts(pages).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    assert sorted(map(str, html_extract.main_texts(pages).collect())) == few and len(few) == len(rows) + 3


# --- 8: language profiles, vector by vector


def plain_trigrams(text):
    def symbol(c):
        if ord(c) > 0xFFFF and unicodedata.category(c).startswith("L"):
            return 27 + ord(c) * 2654435761 % (1 << 32) % 37
        if not unicodedata.category(c).startswith("L"):
            return 0
        low = c.lower()[0]
        return ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 2654435761 % (1 << 32) % 37

    s = [symbol(c) for c in text]
    kept = [x for i, x in enumerate(s) if x or i == 0 or s[i - 1]]
    return [((kept[i - 1] if i else 0), x, (kept[i + 1] if i + 1 < len(kept) else 0)) for i, x in enumerate(kept) if x]


def test_languages_as_by_plain_vectors(spark):
    import random

    rng = random.Random(3)
    voc = {"xx": ["haus", "und", "der", "straße", "ïgel"], "yy": ["the", "house", "and", "of", "to"], "zz": ["漢字", "仮名", "です", "ます"]}
    rows = [(i, " ".join(rng.choice(voc[lang]) for _ in range(rng.choice([1, 4, 40]))), lang) for i, lang in enumerate(rng.choice(list(voc)) for _ in range(60))]
    rows += [(100, None, "xx"), (101, "", "yy"), (102, "123 ... !", "yy"), (103, "the house", None), (104, "The HOUSE, and 😀 of 𝒜𝒷", "yy"), (None, "und der", "xx"), (5, rows[5][1], "yy"), (106, "the " * 30_000, "yy")]
    found = language_id.predictions(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score long").repartition(3)).collect()
    letters = np.random.Generator(np.random.PCG64(language_id.SEED)).integers(0, 2, (64, 1024)) * 2 - 1
    vector = lambda t: sum((np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for (a, b, c) in plain_trigrams(t)), np.zeros(1024))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    vectors = {t: vector(t or "") for _, t, _ in rows}
    profile = {}
    for i, t, lang in rows:
        if i is not None and not held(i) and lang:
            profile[lang] = profile.get(lang, 0) + vectors[t]
    want = []
    for i, t, _ in rows:
        v = vectors[t]
        if not plain_trigrams(t or ""):
            want.append((str(i), held(i), "und", 0.0))
            continue
        cos = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in profile.items()}
        best = max(sorted(cos), key=lambda k: cos[k])
        want.append((str(i), held(i), best, max(0.0, cos[best])))
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in found)
    for a, b in zip(got, sorted(want)):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-4)


# --- 10: byte convolution, window by window


def plain_score(net, text):
    data = list(text) + [32] * max(0, quality_net.WIDTH - len(text))
    windows = np.array([np.concatenate([net.features[b] for b in data[i : i + quality_net.WIDTH]]) for i in range(len(data) - quality_net.WIDTH + 1)])
    value = windows @ net.filters + net.bias
    pooled = np.maximum([value[k : k + quality_net.CHUNK].max(axis=0) for k in range(0, len(value), quality_net.CHUNK)], 0)
    z = np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)]) @ net.out + net.out_bias
    return 1 / (1 + math.exp(-z))


def test_quality_as_by_a_plain_convolution(spark):
    import random

    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(5, 60)) if i % 2 else "@#$ %% 111 " * rng.randint(1, 9), i % 2) for i in range(80)]
    rows += [(200, None, 1), (201, "", 0), (202, "a", 1), (203, "12345", None), (204, "é" * 1100, 0), (205, prose(rng, 3000), 1), (3, rows[3][1], 0), (None, "no id", 1)]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, score long").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(3, 1, 0)], "doc_id long, quality int, text int")
    found = quality_net.predictions(docs, labels).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    net = quality_net.fit(docs.select("doc_id", "text"), labels.where(~language_id.held_out("doc_id", 4, 2)).select("doc_id", "quality"))
    want = sorted((str(i), held(i), plain_score(net, (t or "").encode())) for i, t, _ in rows)
    got = sorted((str(r.doc_id), r.held_out, r.score) for r in found)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-4)
    assert all(r.predicted == (r.score >= 0.7) for r in found)
    # the last byte counts, whether the length is odd or even
    for n in (7, 8, 101, 1000):
        scores = {round(net.score(b"a" * (n - 1) + bytes([c])), 9) for c in b"az0\n%"}
        assert len(scores) > 1 or n > 500


# --- the pipeline


def stages(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), f"edge-{name}")
    return docs


def test_pipeline_on_empty_tables_and_no_benchmark(spark, tmp_path):
    bench = spark.createDataFrame([], "item_id long, text string")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "!!!", "en", "s", 3)], DOCS)
    assert stages(spark, nothing, str(tmp_path)).count() == 0


def test_stages_keep_clashing_columns_and_rows(spark, tmp_path):
    spark.createDataFrame([(1, "some words of an item that no document of the corpus has anywhere in it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["doc_id", "text", "kept", "_words", "n_words", "spans", "cut_text", "label", "_c0"]
    rows = [(i, t, *("x" for _ in names[2:])) for i, t, *_ in corpus(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names[2:])).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, str(tmp_path)), f"clash-{name}")
        assert out.columns == names and 0 < out.count() <= docs.count()
        assert {tuple(r)[2:] for r in out.collect()} == {tuple("x" for _ in names[2:])}
        docs = out


# --- 2: long conversations


def test_a_long_conversation_reads_back(spark):
    from oddsmill.llm import chat_format

    turns = [(7, i, ("user", "assistant", "assistant", None)[i % 4], ("<|end|> \\ é漢😀 " + str(i)) * (400 if i == 50 else 3)) for i in range(3000)]
    conversations = spark.createDataFrame(turns + turns[:2] + [(8, 1, "assistant", "x" * 300_000)], "conv_id long, turn long, role string, text string").repartition(4)
    found = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(conversations)).collect()}
    want = sorted((t, role or "", text) for c, t, role, text in turns + turns[:2])
    assert [(t.role, t.text) for t in found[7].turns] == [x[1:] for x in want]
    assert found[7].loss_text == "".join(x[2] for x in want if x[1] == "assistant") and found[8].loss_text == "x" * 300_000


# --- 5: pages made from known articles


def made_page(rng, i):
    """A page and the text of its article."""
    import html

    def run(n):
        return " ".join(rng.choice(["word", "text", "a&b", "x < y", "naïve", "“quoted”", "tail"]) + str(rng.randint(0, 99)) for _ in range(n))

    blocks, parts = [], []
    for _ in range(rng.randint(3, 8)):
        kind = rng.choice(["p", "p", "p", "h2", "li", "quote", "table"])
        texts = [run(rng.randint(8, 25)) for _ in range(rng.randint(2, 3) if kind in ("li", "table") else 1)]
        blocks += texts
        inline = lambda t: rng.choice(["{}", "<b>{}</b>", "<span class=x>{}</span>", "{}<!-- no -->", "\n  {}\t"]).format(html.escape(t).replace(" ", rng.choice([" ", "  ", "\n", "&#32;"])))
        inner = [inline(t) for t in texts]
        if kind == "li":
            parts.append("<ul>" + "".join(f"<li>{t}</li>" for t in inner) + "</ul>")
        elif kind == "table":
            parts.append("<table>" + "".join(f"<tr><th>{t}</th></tr>" for t in inner) + "</table>")
        elif kind == "quote":
            parts.append(f"<blockquote>{inner[0]}</blockquote>")
        else:
            parts.append(f"<{kind}>{inner[0]}</{kind}>")
    box = [("article", ""), ("div", f' class="story-{i} text"'), ("section", ' class="body"')][i % 3]
    extra = "<script>var a = '<p>no</p>';</script><style>p{}</style><form><p>your mail</p></form><div class='share'>share this</div>"
    page = f"""<!doctype html><html><head><title>t</title></head><body><nav><ul><li><a href=/>home</a></li></ul></nav><header><h1>Site</h1></header>
    <{box[0]}{box[1]}>{''.join(parts)}{extra}</{box[0]}><aside><p>{run(12)}</p></aside><div class="comments"><p>{run(20)}</p></div><div class="cookie-notice">ok?</div><footer>{run(9)}</footer></body></html>"""
    return page, "\n".join(blocks)


def test_made_pages_give_their_articles(spark):
    import random

    rng = random.Random(12)
    made = [made_page(rng, i) for i in range(120)]
    pages = spark.createDataFrame([(i, f"https://host{i % 3}.example/{i}", page) for i, (page, _) in enumerate(made)], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in html_extract.main_texts(pages).collect()}
    assert [got[i].text for i in range(len(made))] == [t for _, t in made]
    assert all(r.n_chars == len(r.text) for r in got.values())
