"""Page extraction, quality, tokens, toxicity, licences and archives on small tables."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import html_graph, html_labelled, license_digest, license_texts, queries, sentencepiece_table, toxicity_cnn, warc_zstd, weak_quality
from barweave.llm.words import tokenize

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, n_tokens string, score string, unit string, digest string, row string, name string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def model():
    return html_labelled.fitted()


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header><nav><ul><li><a href=/>Home</a></li><li><a href=/x>About us</a></li></ul></nav></header>"
    "<div class='cookie-consent'>We use cookies on this site.</div><article><h1>A  title &amp; more</h1><p>First <b>bold</b>\n words.<br>Next line &lt;tag&gt;.<div class='ad'>Buy this now, it is cheap.</div>"
    "<p>Second paragraph with several words in it.</p></article><aside class=sidebar><p>Read these other stories too.</p></aside><section class='comments'><p>I disagree with all of this.</p></section>"
    "<form><label>Your mail</label><input></form><footer>&copy; someone</footer><script>var x = '<p>no</p>';</script></body></html>"
)


def test_page_main_text(model):
    assert model.extract(PAGE) == "A title & more\nFirst bold words. Next line <tag>.\nSecond paragraph with several words in it."


def test_labelled_pages_are_learned(model):
    right = total = 0
    for page in html_labelled.labelled_pages(2, seed=123):
        chance, _ = model.marginals(page)
        for v, text in enumerate(page.text):
            if text is not None:
                right, total = right + ((chance[v] >= 0.5) == page.label[v]), total + 1
    assert right / total > 0.98


def test_marginals_by_enumeration(model):
    page = html_graph.parse("<div class=post><h1>One title</h1><p>Some words here.</p></div>")
    chance, _ = model.marginals(page)
    n, weight = len(page.parent), {}
    for bits in range(1 << n):
        state = [bits >> v & 1 for v in range(n)]
        w = 1.0
        for v, p in enumerate(page.parent):
            e = model._pair(page.kind[v])
            w *= (model._unary(page.features[v]) if state[v] else 1.0) * e[(3 if state[v] else 0) if p < 0 else 2 * state[p] + state[v]]
        weight[bits] = w
    for v in range(n):
        assert chance[v] == pytest.approx(sum(w for b, w in weight.items() if b >> v & 1) / sum(weight.values()))


def test_pages_with_nulls_and_odd_markup(spark, model):
    odd = [(1, "u", None), (2, None, ""), (2, None, ""), (3, "u", "<"), (4, "u", "<p><p></div></p>&am"), (5, "u", "<script>" + "x" * 50_000), (6, "u", "<p>" + "word " * 60_000 + "</p>"), (None, "u", "<article><p>Some words are here.")]
    out = {(r["page_id"], r["n_chars"]) for r in html_graph.extract_pages(spark.createDataFrame(odd, "page_id long, url string, html string").withColumn("text", F.lit("clash")), model).collect()}
    assert {(1, 0), (2, 0), (6, 299_999), (None, 20)} <= out
    assert html_graph.extract_pages(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_quotes_delimit_values_only(model):
    for attributes in ("class=it's", 'class=5"', "title='a > b' class=x", 'data-x="1>2"', "a=b=c'", "'", 'x= "p>q"'):
        page = f"<html><body><article><p {attributes}>The quick brown fox jumps over the dog, and then it sleeps.</p><p>Another sentence of it's text follows here.</p></article></body></html>"
        assert model.extract(page) == "The quick brown fox jumps over the dog, and then it sleeps.\nAnother sentence of it's text follows here."


def test_parsing_is_linear():
    import time

    took = []
    for page in ("<p>a</p>" + "<svg><path d='1'/></svg>" * 16_000, "<p " + "a=" * 60_000 + "x", "<select><option>a</select>" * 16_000, "<p>text</p>" + '<a href="x ' * 64_000, '<a b=">" ' * 64_000, "<a " * 64_000 + 'b=">"', "<!a" * 64_000, "<p>" + "<!a" * 64_000, "<head>" * 32_000, "<a<a" * 64_000, "<select " * 64_000, "<p>x</p>" + "<!--" * 64_000):
        began = time.perf_counter()
        html_graph.parse(page)
        took.append(time.perf_counter() - began)
    assert max(took) < 2, took


def test_tags_without_an_end_are_text():
    for page, text in (('<p b=">" c', ['<p b=">" c']), ("<p>a<!-- <p>b", ["a"]), ("<script><!-- </script><p>a", ["a"]), ("<p>1 < 2 <3", ["1 < 2 <3"]), ("<p title='a>b'>c", ["c"]), ("a<!-->b", ["a"]), ('<p>a</p><b x="', ["a", '<b x="'])):
        assert [x for x in html_graph.parse(page).text if x] == text, (page, html_graph.parse(page).text)


def test_long_texts_are_read_in_parts():
    from barweave.llm import words

    text = b"".join(b"word%d \n" % (i % 5000) for i in range(500_000))
    assert len(text) > 3 * words.SLICE_BYTES
    whole, parts = words._tokenize([b"a b", text, b"", b"c"]), words.tokenize([b"a b", text, b"", b"c"])
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))


def test_tokens_are_the_library_s(spark):
    import sentencepiece

    raw = queries.tokenizer_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["", " ", "  two  spaces ", "\n\na\n b", "▁x▁", "日本\t😀é", "</s> <s>", "x" * 3000, None, "<0x0A> \x00"]
    got = {r["doc_id"]: r for r in sentencepiece_table.encode_documents(docs(spark, enumerate(texts)), raw).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    real = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200")
    made = {r["doc_id"]: r["ids"] for r in sentencepiece_table.encode_ids(real, raw).collect()}
    for r in real.collect():
        assert made[r["doc_id"]] == library.encode(r["text"], add_bos=True, add_eos=True)


def test_chunk_table_may_start_anew():
    table = sentencepiece_table.ChunkTable(queries.tokenizer_model(), most_bytes=700, longest=2)
    texts = ["a b c d e", "f g h", "a z longword", "longword a"]
    assert [x for t in texts for x, _ in table.encode([t])] == [x for t in texts for x, _ in sentencepiece_table.ChunkTable(queries.tokenizer_model()).encode([t])]


def test_quality_finds_the_labelled_junk(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    gold = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fitted = weak_quality.fit(rows)
    out = {r["doc_id"]: r["good"] for r in weak_quality.score(rows, *fitted).collect()}
    bad = [i for i, q in gold.items() if q == 0]
    good = [i for i, q in gold.items() if q == 1]
    assert sum(not out[i] for i in bad) / len(bad) > 0.95
    assert sum(out[i] for i in good) / len(good) > 0.97
    kept = weak_quality.keep_good(rows, *fitted)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {i for i, ok in out.items() if ok}
    assert all(0.9 < a <= 1 for a, _ in fitted[0].accuracies().values())


def test_quality_of_odd_rows(spark):
    rows = docs(spark, [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "The cat sat on the mat."), (4, "A!! " * 20_000)])
    fitted = weak_quality.fit(rows)
    assert weak_quality.score(rows, *fitted).count() == 6
    empty = rows.where("false")
    assert weak_quality.score(empty, *weak_quality.fit(empty)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity_cnn.score(rows, toxicity_cnn.fit(rows, labels)).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in out)
    assert hit / sum(r["toxic"] for r in out) > 0.7
    assert hit / max(1, sum(r["predicted"] for r in out)) > 0.7
    ranked = sorted(out, key=lambda r: r["score"])
    place = [i for i, r in enumerate(ranked) if r["toxic"]]
    n, m = len(place), len(ranked) - len(place)
    assert (sum(place) - n * (n - 1) / 2) / (n * m) > 0.95


def test_toxicity_of_odd_rows_and_without_labels(spark):
    rows = docs(spark, [(1, None), (2, ""), (3, "x " * 50_000), (3, "a"), (None, "b")])
    none = spark.createDataFrame([(None, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity_cnn.score(rows, toxicity_cnn.fit(rows, none)).collect()
    assert len(out) == 5 and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]


@pytest.mark.parametrize("worker_rows", [20_000, 2_000])
def test_toxicity_learns_from_every_labelled_row(spark, worker_rows):
    """A word that only the last rows by hash have is learned, by one worker and by several."""
    ids = spark.range(12_000).where("crc32(cast(id as string)) % 5 <> 0").orderBy(F.xxhash64("id")).toPandas()["id"].tolist()
    rng, toxic = np.random.default_rng(3), ids[::2]
    word = {i: "oldslur" if k < 3_200 else "newslur" for k, i in enumerate(toxic)}
    text = lambda i: " ".join([*(f"plain{k}" for k in rng.integers(0, 300, 12)), *([word[i]] if i in word else []), *(f"plain{k}" for k in rng.integers(0, 300, 6))])
    rows = docs(spark, [(i, text(i)) for i in ids])
    labels = spark.createDataFrame([(i, int(i in word)) for i in ids], "doc_id long, toxic int")
    net = toxicity_cnn.fit(rows, labels, worker_rows=worker_rows)
    late = docs(spark, [(k, "plain1 plain2 plain3 newslur plain4") for k in range(3)] + [(9, "plain1 plain2 plain3 plain4")])
    assert {r["doc_id"]: r["predicted"] for r in toxicity_cnn.score(late, net).collect()} == {0: 1, 1: 1, 2: 1, 9: 0}


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(0)
    samples = [rng.integers(0, 1 << 63, 40).astype(np.uint64) for _ in range(40)]
    samples = [np.concatenate([s, np.array([7, 8], dtype=np.uint64)]) if i % 2 else s for i, s in enumerate(samples)]
    net = toxicity_cnn.train(samples, np.arange(40) % 2 * 1.0, np.ones(40), np.zeros(40, dtype=int), epochs=20)
    tables = net.tables()
    alone = [net.logits(net.index(s), np.array([0, len(s)]), tables)[0] for s in samples]
    first = np.concatenate([[0], np.cumsum([len(s) for s in samples])])
    assert np.allclose(alone, net.logits(net.index(np.concatenate(samples)), first, tables), atol=1e-4)
    assert np.mean((np.array(alone) >= net.thresholds[0]) == np.arange(40) % 2) > 0.9


def test_licences(spark):
    mit = license_texts.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Me\n\n" + mit.upper()), (2, "Words.\nReleased  under the MIT Licence"), (3, None), (4, ""), (5, mit + " More."), (6, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY-NC 4.0."), (None, "x"), (7, "© 2020\nAll rights reserved.")]
    out = license_digest.scan(docs(spark, rows)).collect()
    got = {r["doc_id"]: (r["license"], r["line_licenses"], r["n_lines"]) for r in out}
    assert got == {1: ("MIT", "MIT", 1), 2: (None, "MIT", 2), 3: (None, "", 0), 4: (None, "", 0), 5: (None, "", 1), 6: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), None: (None, "", 1), 7: (None, "", 0)}
    assert len(out) == len(rows)
    assert license_digest.scan(docs(spark, []).where("false")).count() == 0


def test_canonical_forms_agree(spark):
    texts = ["A  b-c; Licence", "HTTP://x.org", "ünï x", "(C) me", "", "sub-license per cent", "Ⅷ ½"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", license_digest.canonical_column(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in frame.collect()} == {t: license_digest.canonical_line(t) for t in texts}


def test_archives_round_trip(spark):
    pages = [(1, "u1", "<p>a</p>"), (9, "u9", "<p>a</p>"), (2, None, None), (3, "u3", ""), (4, "u4", "é" * 100_000), (-5, "u", "x"), (9, "u9", "<p>a</p>"), (None, "n", "x")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, content string")
    archives = warc_zstd.write_archives(frame, 1 << 14)
    out = warc_zstd.read_archives(archives).collect()
    want = []
    for i, _, html in pages:
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        body = (html or "").encode()
        best = max(same)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == best else "revisit", None if i == best else best))
    key = lambda x: repr(x)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=key) == sorted(want, key=key)
    bodies = {r["page_id"]: r["payload"] for r in warc_zstd.read_archives(archives, payload=True).collect() if r["record_type"] == "response"}
    assert bytes(bodies[4]).decode() == "é" * 100_000
    assert warc_zstd.read_archives(warc_zstd.write_archives(frame.where("false"))).count() == 0


def test_urls_come_back(spark):
    urls = [None, "", "http://x/a b", " lead", "http://x/a%20b", "line\r\nbreak: y", "é\u3000ü", "a%\tb"]
    frame = spark.createDataFrame([(i, u, f"p{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert {r["page_id"]: r["url"] for r in warc_zstd.read_archives(warc_zstd.write_archives(frame)).collect()} == dict(enumerate(urls))


def test_archive_files(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"u{i}", f"<p>page {i}</p>" * 50) for i in range(300)], "page_id long, url string, html string")
    assert warc_zstd.export_files(warc_zstd.write_archives(frame), str(tmp_path)).count() >= 1
    assert warc_zstd.read_archives(spark.read.format("binaryFile").load(str(tmp_path / "*.warc.zst"))).count() == 300


@pytest.mark.parametrize("harm", [lambda x: x[:-3], lambda x: x[:-9] + bytes([x[-9] ^ 1]) + x[-8:]])
def test_broken_archives_are_refused(harm):
    records = [warc_zstd.pack_record(i, "u", b"page %d" % i, base64.b32encode(hashlib.sha1(b"page %d" % i).digest()).decode(), i, True) for i in range(3)]
    good = warc_zstd.pack_archive(records)
    assert [warc_zstd.parse_record(x)["page_id"] for x in warc_zstd.unpack_archive(good)] == [0, 1, 2]
    with pytest.raises(Exception):  # noqa: B017
        list(map(warc_zstd.parse_record, warc_zstd.unpack_archive(harm(good))))
    with pytest.raises(ValueError, match="should have"):
        warc_zstd.parse_record(records[0].replace(b"Content-Length: 81", b"Content-Length: 80").replace(b"page 0", b"page 01"))


def test_words_follow_the_contract():
    hashes, starts, ends, first = tokenize([b"", b" Ab cD\x0b", "ab x cd".encode()])
    assert list(first) == [0, 0, 2, 4]
    assert hashes[0] != hashes[2] and hashes[1] == hashes[3]
    assert list(zip(starts, ends, strict=True)) == [(1, 3), (4, 6), (0, 5), (6, 8)]
