"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from tideline.llm import embed_dedup, html_blocks, lang_mix, mpeg, ngram_join, packing, raking, secret_scan, toxicity, url_rules
from tideline.llm.store import stored

PAGES = "page_id long, url string, html string"
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7")]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_ngram_join(odd, empty):
    rows = ngram_join.ngram_jaccard_join(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [got[k]["class_id"] for k in (1, 2, 3)] == [1, 1, 1]
    assert [got[k]["n_links"] for k in (1, 2, 3)] == [2, 2, 2]
    assert got[8]["class_id"] == 7 and not got[8]["kept"]
    assert got[4]["class_id"] == 4 and got[4]["n_links"] == 0 and got[5]["kept"] and got[6]["kept"]
    assert all(r["class_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert got[10]["n_links"] == 1
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_one_of_each_class(odd, empty):
    out = ngram_join.one_of_each_class(odd)
    assert out.columns == odd.columns
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13]
    assert ngram_join.one_of_each_class(empty).count() == 0


def test_language(odd, empty):
    rows = lang_mix.identify(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: r for r in rows}
    assert {k: got[k]["lang_pred"] for k in (4, 5, 6, 9)} == dict.fromkeys((4, 5, 6, 9), "und")
    assert got[12]["lang_pred"] == "en" and 0 <= got[12]["score"] <= 1
    assert lang_mix.identify(empty).count() == 0
    assert {r["lang_pred"] for r in lang_mix.identify(odd.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_mixing(odd, empty):
    rows = raking.mix_report(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["probability"] <= 1 for r in rows)
    assert {r["topic"] for r in rows if r["tokens"] == 1} == {-1}
    assert raking.sampled(odd).columns == odd.columns
    assert raking.sampled(odd, keep=1.0, targets=None).count() <= odd.count()
    assert raking.mix_report(empty).count() == 0 and raking.sampled(empty).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, []), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(*v, 5, 6) for v in vectors], "vec_id long, embedding array<float>, label int, copies int")
    rows = embed_dedup.embedding_near_duplicates(df).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows if r["vec_id"] is not None}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11))
    assert len(rows) == len(vectors)
    assert embed_dedup.embedding_near_duplicates(df.limit(0)).count() == 0


def test_toxicity(odd, empty, labels):
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.without_toxic(odd, labels).columns == odd.columns


def test_secrets(odd, empty):
    rows = secret_scan.secret_report(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: r for r in rows}
    assert (got[13]["n_assign"], got[13]["n_access"], got[13]["n_hex"]) == (1, 1, 1)
    assert got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[4]["spans"] == ""
    clean = {r["doc_id"]: r for r in secret_scan.without_secrets(odd).collect()}
    assert clean[13]["text"].count("[secret]") == 3 and clean[13]["n_chars"] == len(clean[13]["text"])
    assert clean[4]["text"] is None and clean[1]["n_chars"] == 1
    assert secret_scan.secret_report(empty).count() == 0 and secret_scan.without_secrets(odd).count() == odd.count()


def test_media(odd, empty):
    rows = mpeg.media_columns(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: r for r in rows}
    assert got[4]["payload_bytes"] == 576 and got[4]["n_bytes"] == 0 and got[4]["feature"] == got[5]["feature"]
    assert mpeg.media_columns(empty).count() == 0


def test_packing(odd, empty):
    rows = packing.pack(odd).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == 1
    assert sum(r["length"] for r in rows if r["doc_id"] == 12) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 12)
    fills = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fills.get(r["sequence_id"], 0)
        fills[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fills.values()) <= 1024
    assert packing.pack(empty).count() == 0


def test_urls(spark):
    urls = ["http://EXAMPLE.com/en/7?x", "https://a.example.com/en/8#y", "http://notexample.com/en/70", "x", None, "http://com/en/", "ftp://example.com", "http://example.com?/en/7", "a://b.com/en/c://d.net/"]
    df = spark.createDataFrame([(k, u, 1, 2) for k, u in enumerate(urls)], "page_id long, url string, key int, stack int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judged(df, url_rules.rule_table(spark, RULES)).collect()}
    assert got[0] == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == ("a.example.com", "/en/8", "com/en/", "block")
    assert got[2] == ("notexample.com", "/en/70", "com/en/", "block")
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5] == ("com", "/en/", "com/en/", "block")
    assert got[6] == ("example.com", "", None, "allow") and got[7] == ("example.com", "", None, "allow")
    assert got[8] == ("b.com", "/en/c://d.net/", "com/en/", "block")
    assert url_rules.judged(df.limit(0), url_rules.rule_table(spark, RULES)).count() == 0


@pytest.mark.parametrize("html", ["", "<", "<p", "</p></div>", "<script>x", "<!--", "a &lt; b", "<p>a<br>b", "<ul><li>1<li>2</ul>", "<table><tr><td>x<td>y</table>"])
def test_any_html_is_read(html):
    for block in html_blocks.blocks(html):
        assert block.text


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", "<html><body><nav><a>Home</a></nav><article><p>Main &amp; text.</p></article></body></html>"), (3, "u", "<p>" + "long " * 50000 + "</p>")]
    df = spark.createDataFrame(rows, PAGES)
    got = html_blocks.main_text(df).collect()
    assert len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""]
    assert html_blocks.main_text(df.limit(0)).count() == 0


#: Markup that browsers read, with the text that a page shows.
ODD_PAGES = [
    ("<form><datalist><option value=a><option value=b></datalist></form><article><p>Hello there world.</p></article>", ["Hello there world."]),
    ("<select><option>a<option>b</select><p>after</p>", ["after"]),
    ("<select><option>never closed<p>kept</p>", ["never closed", "kept"]),
    ("it's <b title=x'>bold</b> ok", ["it's bold ok"]),
    ('<p class="a>one</p><p>two</p>', ["one", "two"]),
    ("<p title='a > b' data-x=\"1 > 0\">x</p>", ["x"]),
    ("<a href=/x/y/>link</a> text", ["link text"]),
    ("a < b and c > d, 1<2", ["a < b and c > d, 1<2"]),
    ("<ul><li>one<li>two<ul><li>three</ul><li>four</ul>", ["one", "two", "three", "four"]),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", ["t", "d", "u", "e"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<p>first<p>second<div>third</div>", ["first", "second", "third"]),
    ("<svg><text>drawn</text></svg><p>seen</p><svg>", ["seen"]),
    ("<!-- no --><![CDATA[yes & so]]><!doctype html></ bogus>end", ["yes & soend"]),
    ("<script>if (a < b) '</p>'</script>shown<style>p{}", ["shown"]),
    ("text <b unclosed", ["text"]),
    ("<P CLASS=Nav\nID='x'>menu</P >done", ["menu", "done"]),
]


@pytest.mark.parametrize(("html", "texts"), ODD_PAGES)
def test_texts_of_odd_markup(html, texts):
    assert [b.text for b in html_blocks.blocks(html)] == texts


def test_names_of_odd_markup():
    (block,) = html_blocks.blocks("<div class = side-bar id=\"Top\" hidden data-role=no role='search' x=\"id='no'\"><p title=y'>text")
    assert block.path == (("div", "side", "bar", "top", "search"), ("p",))


@pytest.mark.parametrize("html", ["<a " * 350_000, "<a " * 350_000 + ">", '<img alt="' * 100_000, '<img alt="' * 100_000 + '">', "<div>x" * 40_000, "<svg>" * 200_000, "<![CDATA[" * 110_000, "</b>" * 250_000, "<b><div>" * 5000 + "</b>" * 100_000, "<select>" * 50_000])
def test_time_grows_with_length_only(html):
    began = time.process_time()
    html_blocks.blocks(html)
    assert time.process_time() - began < 10  # where it grew with the square it took minutes


def test_pages_with_repeats_and_clashing_columns(spark):
    html = "<html><body><nav><a>Home</a></nav><article><p>Main text of a page.</p></article></body></html>"
    df = spark.createDataFrame([(1, "u", html, "a", 1), (1, "u", html, "b", 2), (2, "v", "<nav><a>Home</a></nav>", "c", 3)], PAGES + ", text string, n_chars int")
    rows = html_blocks.main_text(df).collect()
    assert sorted((r["page_id"], r["text"]) for r in rows) == [(1, "Main text of a page."), (1, "Main text of a page."), (2, "")]


def test_a_ledger_that_holds_a_blob_twice(spark, odd, tmp_path):
    """Two runs that scan at the same time both append."""
    docs = odd.select("doc_id", "text")
    ledger = str(tmp_path / "ledger")
    want = sorted(map(str, secret_scan.secret_report(docs, ledger).collect()))
    spark.read.parquet(ledger).write.mode("append").parquet(str(tmp_path / "twice"))
    spark.read.parquet(ledger).write.mode("append").parquet(str(tmp_path / "twice"))
    again = sorted(map(str, secret_scan.secret_report(docs, str(tmp_path / "twice")).collect()))
    assert again == want and len(again) == docs.count()
    assert secret_scan.without_secrets(docs, ledger=str(tmp_path / "twice")).count() == docs.count()
    assert spark.read.parquet(ledger).count() == docs.select("text").na.fill("").distinct().count()


def test_findings_keep_clashing_columns_apart(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token: abcdefgh1", "mine", "theirs", 7), (2, None, None, None, None)], "path long, text string, spans string, blob string, _known int")
    found = secret_scan.findings(docs, secret_scan.recorded(docs, str(tmp_path / "l")))
    assert found.columns == ["path", "_known", "blob", "spans"]
    rows = {r["path"]: r for r in found.collect()}
    assert len(rows[1]["spans"]) == 1 and rows[1]["blob"] == hashlib.sha256(b"token: abcdefgh1").hexdigest() and rows[1]["_known"] == 7 and rows[2]["spans"] == []


def test_identical_rows_are_packed_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 100)
    docs = spark.createDataFrame([(None, None)] * 4000 + [(1, "a b c")] * 4000, "doc_id long, text string").repartition(3)
    rows = packing.pack(docs).collect()
    assert len(rows) == 8000
    fills = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fills.get(r["sequence_id"], 0)
        fills[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fills.values()) <= 1024 and sorted(fills) == list(range(len(fills)))
    cut = stored(packing.pieces(docs, *_tokenizer(), packing.CAPACITY).withColumn("row", F.monotonically_increasing_id()), "pieces")
    salts = cut.groupBy(F.expr("pmod(xxhash64(doc_id, start, ids_crc32, row), 80)").alias("s")).count().agg(F.max("count"), F.count("*")).first()
    assert salts[1] == 80 and salts[0] < 5 * 100


def _tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
