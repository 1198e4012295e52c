"""Odd tables: clashing names, nulls, empty and very long texts, ties and repeats, through the operators, the opN_ queries and the pipeline; SQL and independent truth on the given tables."""

import html
import os
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoloom.llm import common, gbt, html_extract, mixing, neardup, packing, registry, rules, sharding, substring, topk, warc
from geoloom.llm.common import read
from geoloom.llm.docstats import text_counts
from geoloom.llm.labelled import training_rows

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("spans", "_key", "_sub", "_spans", "key", "n_words", "kept_text", "_source", "_there", "mix_size", "mix_copies", "_copy", "_text", "cluster", "component_id", "score", "shard", "copies")


def odd_rows():
    r = random.Random(21)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(n))
    passage = words(80)
    long = words(60_000)
    texts = [None, "", " \n\t", "one", words(120), passage + " " + words(60), words(50) + " " + passage, long, long + " end", "x" * 300_000, "a " * 5000, "\x00 \x1f nul"]
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", i) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], (None, passage, None, None, None), (None, None, None, None, None), (70, texts[4], "en", "s1", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, odd):
    path = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 1, 0), (10, 0, 0), (11, 0, 1), (None, 1, 0), (6, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(0, [1.0, 2.0]), (100, []), (200, None), (300, [20000.0, 1.0]), (300, [1.0, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [1.0, 1.0]), (9, [None, 1.0]), (10, [float("nan"), 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    pages = [(1, "u", "<p>a"), (2, None, "<p>a"), (2, "v", "<p>a"), (None, "w", "<p>a"), (3, "x", None), (4, "y", ""), (5, "z", "<article><p>" + "Long words here. " * 40_000), (6, "n", "<p>a\x00b")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def with_clashes(df):
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHES})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fresh():
    assert common.fresh(["a", "_A", "b"], "a", "c", "c") == ["__a", "c", "_c"]


def test_clashing_names_stay(spark, odd):
    clashing = with_clashes(odd)
    names = clashing.columns
    first = neardup.keep_first(spark, clashing)
    assert first.columns == names and rows_of(first.select(*odd.columns)) == rows_of(neardup.keep_first(spark, odd))
    mixed = mixing.mix(spark, clashing)
    assert mixed.columns == names and rows_of(mixed.select(*odd.columns)) == rows_of(mixing.mix(spark, odd))
    less = corpus_pipeline.substrings(spark, clashing, "")
    assert less.columns == names and rows_of(less.select(*odd.columns)) == rows_of(corpus_pipeline.substrings(spark, odd, ""))
    for out in (first, mixed, less):
        bad = [F.col(c) != F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHES]
        assert out.where(F.array_contains(F.array(*bad), True)).count() == 0 and out.where(F.array_contains(F.array(*[F.col(c).isNull() for c in CLASHES]), True)).count() == 0
    plan = mixing.repetition_plan(spark, clashing)
    assert set(plan.columns) == set(names) | set(mixing.PLAN) and plan.where("mix_copies is null or mix_size is null").count() == 0
    packed = packing.pack_documents(spark, clashing)
    assert rows_of(packed) == rows_of(packing.pack_documents(spark, odd))
    assert rows_of(sharding.shard_documents(spark, clashing)) == rows_of(sharding.shard_documents(spark, odd))


def test_draws_without_an_id_are_by_text(spark):
    rows = [(None, f"word {i}", "en", "s", 1) for i in range(300)]  # one source, at a rate of 1.5
    got = [r.mix_copies for r in mixing.repetition_plan(spark, spark.createDataFrame(rows, DOC)).collect() if r.doc_id is None]
    assert len(set(got)) == 2


def test_queries_on_odd_tables(spark, folder):
    """Every query gives one row for each row (or query) of an odd table; those with SQL the same as the SQL."""
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    n, got = len(odd_rows()), {}
    for name, q in registry.queries().items():
        got[name] = q(spark, folder).toPandas()
    for name in ("op1_balanced_sharding", "op2_quality_rules", "op3_hyperminhash_neardup", "op4_mixing", "op5_substring_dedup", "op8_quality_classifier"):
        assert len(got[name]) == n, name
    assert set(got["op10_best_fit_packing"].doc_id.dropna()) == {i for i, *_ in odd_rows() if i is not None}
    shards = got["op1_balanced_sharding"]
    counts = shards.groupby("shard").size().reindex(range(16), fill_value=0)
    assert counts.max() - counts.min() <= 1 and sorted(shards.slot[shards.shard == 0]) == list(range(counts[0]))
    assert got["op8_quality_classifier"].score.between(0, 1).all() and got["op2_quality_rules"].kept.notna().all()
    found = got["op6_bit_sliced_topk"]
    assert set(found.query_id) == {0, 100, 300} and found[(found.query_id == 0) & (found["rank"] == 1)].vec_id.tolist() == [300]
    records = got["op9_warc"]
    assert len(records) == 8 and sorted(records.record_type) == ["response"] * 4 + ["revisit"] * 4
    texts = got["op7_html_extraction"]
    assert len(texts) == 8 and texts.n_chars.max() > 600_000
    clean = lambda frame, columns: sorted((tuple(None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)
    for name, sql in registry.oracle_sql().items():
        if name in ("op3_hyperminhash_neardup",):  # ids that repeat are one document there
            continue
        want = c.sql(sql).df()
        assert clean(got[name], sorted(want.columns)) == clean(want, sorted(want.columns)), name


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    clean = lambda frame: sorted((tuple(None if pd.isna(v) else v for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)
    assert sorted(got.columns) == columns and len(want) and clean(got) == clean(want)


def test_pipeline_on_odd_tables(spark, folder, tmp_path, odd):
    placed = corpus_pipeline.run(spark, folder).toPandas()
    assert placed.n_tokens.ge(0).all()
    nothing = str(tmp_path / "none")
    odd.limit(0).write.parquet(f"{nothing}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{nothing}/labels.parquet")
    assert corpus_pipeline.run(spark, nothing).count() == 0
    clashing = str(tmp_path / "clash")
    with_clashes(odd).write.parquet(f"{clashing}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{clashing}/labels.parquet")
    again = corpus_pipeline.run(spark, clashing).toPandas()
    assert again.n_tokens.sum() == placed.n_tokens.sum() and len(again) == len(placed)


def test_no_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_rules_on_the_given_labels(spark, sf):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("no such table")
    x, y = training_rows(spark, read(spark, path, "documents"), read(spark, path, "labels"), only_learn=False)
    learned = rules.learn(x, y)
    caught = np.zeros(len(x), bool)
    for rule in learned:
        caught |= rules.covered(rule, x)
    assert learned and (caught & (y == 0)).sum() >= 0.9 * (y == 0).sum() and (caught & (y == 1)).sum() <= 0.02 * (y == 1).sum()


def test_learning_goes_past_an_imprecise_rule():
    r = np.random.default_rng(8)
    x = r.normal(size=(900, 14))
    hazy = (x[:, 0] > 0.6) & (r.random(900) < 0.6)  # no precise rule
    clear = x[:, 1] > 1.2
    learned = rules.learn(x, (~(hazy | clear)).astype(int), precision=0.95)
    caught = np.zeros(900, bool)
    for rule in learned:
        caught |= rules.covered(rule, x)
    assert (caught & clear).sum() >= 0.9 * clear.sum()


def test_classifier_on_the_given_labels(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no such table")
    got = gbt.op8_quality_classifier(spark, path).join(read(spark, path, "labels"), "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() >= 0.95


def truth(page):
    """The article of the given pages by their own marks, without the extractor's tokeniser."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", re.sub(r"<!--.*?-->", "", article, flags=re.S))
    texts = (" ".join(html.unescape(re.sub(r"<br\s*/?>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in blocks)
    return " ".join(t for t in texts if t)


def test_html_against_the_given_pages(spark):
    pages = {r.page_id: r.html for r in read(spark, SF, "pages").collect()}
    got = {r.page_id: r for r in html_extract.op7_html_extraction(spark, SF).collect()}
    want = {i: truth(p) for i, p in pages.items() if p}
    assert len(want) > 40 and all(re.fullmatch(r"[^<]*", t) for t in want.values())
    assert {i: got[i].text for i in want} == want and all(got[i].n_chars == len(t) for i, t in want.items())


@pytest.mark.parametrize(
    "page, texts",
    [
        ('<p>a</p><script>document.write("<!-- ad");</script><p>rest</p>', ["a", "rest"]),
        ("<div><script>s=\"it's <b\"</script>x</div>", ["x"]),
        ("<p>a <b class=x'>bold</b> c<p>d", ["a bold c", "d"]),
        ("<p>x <math><mi>a</mi> <mo>=</mo> <mi>b</mi></math> y", ["x a = b y"]),
        ("<p>an <object><em>inner</em></object> one", ["an inner one"]),
        ("<p>NUL\x00here", ["NUL\x00here"]),
        ("<p>1 < 2 <3 > </3> x </> y</p>", ["1 < 2 <3 > x y"]),
        ('<p title="x>text</p><p>more', ["text", "more"]),
        ("<p>a<!-- c --!>b<!-->c<!--->d", ["abcd"]),
        ("<p>kept <select><option>gone</select> on", ["kept on"]),
        ("<p>kept <select> open", ["kept open"]),
        ('<p a=b"c=d>x</p><p data-x="a>b">y', ["x", "y"]),
        ("<p>cut <a href='x", ["cut"]),
    ],
)
def test_html_markup(page, texts):
    assert [b[0] for b in html_extract.blocks_of(page)] == texts


def test_html_optional_end_tags_at_any_depth():
    """A list item and a paragraph end where the next one starts, however many elements are open in them."""
    for levels in (3, 700, 5000):
        deep = "<span>" * levels
        got = html_extract.blocks_of(f"<ul><li>a{deep}b<li>c</ul><div><p>d{deep}e<p>f</div><ul><li>g<ul>{deep}<li>h</ul></ul>")
        assert [(b[0], b[2]) for b in got] == [("ab", "li"), ("c", "li"), ("de", "p"), ("f", "p"), ("g", "li"), ("h", "li")]
        assert [b[4] for b in got if b[0] in "cfg"] == [2, 2, 2]


def test_html_takes_time_in_proportion():
    pages = ["<a " * 300_000, '<p title="' * 100_000, "<b>" * 100_000 + "</x>" * 100_000, "<script><!--<script></script>" * 20_000, "<!--" * 200_000, "<p " + "a" * 500_000 + ">x", "<![CDATA[" * 50_000, "<select>" * 50_000]
    pages.append("<article>" + "<p>Some words &amp; more of the <b>text</b> here.</p>" * 100_000 + "</article>")
    field = html_extract.trained_field()
    began = time.time()
    texts = [html_extract.main_text(p, field) for p in pages]
    assert len(texts[-1]) > 3_000_000 and time.time() - began < 120


def test_very_long_texts():
    assert len(neardup.shingle_set(("word%d " * 100_000 % tuple(range(100_000))).encode(), common.WordHashes(), 5)) == 99_996
    w = common.WordHashes().of([b"%d" % (i % 70) for i in range(200_000)])
    fp, s0, s1 = substring.segments(w, 35, 8)
    assert s0[0] == 0 and s1[-1] == 200_000 - 35 and (s0[1:] == s1[:-1] + 1).all()
    many = (b"%d " * 3) % (1, 2, 3) + b" ".join(b"w%d" % i for i in range(300_000))
    assert text_counts(many)[0] == 300_003 and text_counts(many)[4] == 0


def test_warc_of_a_common_payload(spark):
    rows = [(i, f"u{i}", "same page") for i in range(300)] + [(1000 + i, "u", f"p{i}") for i in range(20)]
    got = warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 320 and sum(r.record_type == "revisit" for r in got) == 299 and {r.refers_to for r in got} == {None, 0}
    with pytest.raises(Exception):
        warc.write_archives(spark, spark.createDataFrame([], "page_id long, url string, html string, record_type string, refers_to long"), "nosuch://x/y")


def test_top_k_of_repeated_rows(spark):
    rows = spark.createDataFrame([(5, [1.0, 1.0])] * 700 + [(100, [2.0, 0.0]), (6, [3.0])], "vec_id long, v array<double>")
    got = topk.top_k(spark, rows, rows.where("vec_id = 100"), 3).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 6, 6), (2, 5, 2), (3, 5, 2)]
