"""The block labeller and the quality classifier on rows they have not seen, and the pipeline stage by stage."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from texloom.llm import html_blocks, quality_model


@pytest.fixture(scope="module")
def labeller():
    return html_blocks.fit()


def test_labeller_on_unseen_pages(labeller):
    right = total = 0
    for page, labels in html_blocks.generated(150, 99):
        found = html_blocks.blocks(page)
        assert len(found) == len(labels)
        right += (labeller.label([found])[0] == np.array(labels)).sum()
        total += len(labels)
    assert right / total > 0.985


def test_slopes():
    """Back-propagation against differences."""
    model, r = html_blocks.Labeller(), np.random.default_rng(1)
    x, there = r.random((2, 4, html_blocks.INPUTS)), np.array([[1.0, 1, 1, 1], [1, 1, 0, 0]])
    x *= there[:, :, None]
    y = r.integers(0, 2, (2, 4)).astype(float)
    loss = lambda: float((np.logaddexp(0, z := model.logits(x, there)) - y * z)[there > 0].sum() / there.sum())
    slopes = model.slopes(x, there, y)
    for name, at in (("xf", (3, 5)), ("hb", (2, 40)), ("cf", (20,)), ("o", (7,)), ("hf", (1, 60)), ("xb", (9, 33))):
        keep = model.p[name][at]
        model.p[name][at] = keep + 1e-5
        up = loss()
        model.p[name][at] = keep - 1e-5
        down = loss()
        model.p[name][at] = keep
        assert abs((up - down) / 2e-5 - slopes[name][at]) < 1e-6, name


def test_blocks():
    page = '<html><head><title>no</title></head><body><p>a <b>b<p>c&amp;d<br>e</p></i><script>"</p>"</script><!-- x <p> --><ul><li>1<li>2</ul><div title="a>b">f\xa0 g</div>tail'
    assert [b[0] for b in html_blocks.blocks(page)] == ["a b", "c&d e", "1", "2", "f g", "tail"]
    for odd in ("", "<", "<p", "</p></p>", "<!-- open", "<script>x", "a < b > c", "<p class='x>y", "<" * 2000):
        html_blocks.blocks(odd)


def unlike(n, seed):
    """Pages of layouts that the labeller was not fitted to: (page, texts of the article)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices(["ka", "lo", "mu", "ter", "vin", "os", "qua", "b"], k=r.randint(1, 4)))
    text = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    for _ in range(n):
        good = [text(2, 8), *(text(8, 90) + "." for _ in range(r.randint(2, 9)))]
        body = f"<H2 title=it's>{good[0]}</H2>" + "".join(f"<P align=left>{x}" + r.choice(["</P>", ""]) for x in good[1:])
        menu = "<DIV CLASS=topnav>" + " | ".join(f"<A HREF=/{word()}>{word()}</A>" for _ in range(6)) + "</DIV>"
        side = f'<div class="sidebar-left widget"><h4>{text(1, 2)}</h4><ol>' + "".join(f"<li><a href='{word()}'>{text(1, 4)}</a>" for _ in range(5)) + "</ol></div>"
        note = f'<section id="comments-area"><h3>{text(1, 3)}</h3><div class="comment-body"><p>{text(5, 50)}.</p></div></section>'
        foot = f"<footer role=contentinfo><span>&copy; {text(2, 8)}</span></footer>"
        shape = r.randrange(4)
        if shape == 0:
            page = f"<html><title>{word()}</title><body>{menu}<td class=story>{body}</td>{side}{foot}"
        elif shape == 1:
            page = f"<div id=outer>{menu}<div class=columns><div class=col-8>{body}</div><div class=col-4>{side}</div></div>{note}{foot}</div>"
        elif shape == 2:
            page = body
        else:
            page = f"<body><main role=main><div><div>{body}</div></div>{note}</main><aside>{side}</aside>{foot}</body>"
        yield page, good


def test_labeller_on_other_layouts(labeller):
    right = wrong = missed = 0
    for page, good in unlike(200, 5):
        found = html_blocks.blocks(page)
        kept = [b[0] for b, on in zip(found, labeller.label([found])[0], strict=True) if on]
        right += len(set(kept) & set(good))
        wrong += len(set(kept) - set(good))
        missed += len(set(good) - set(kept))
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_pages_without_a_container(labeller):
    def texts(page):
        found = html_blocks.blocks(page)
        return [b[0] for b, on in zip(found, labeller.label([found])[0], strict=True) if on]

    assert texts("<p>First <a title=it's href=x>link</a> para text.</p>") == ["First link para text."]
    assert texts("<p>Only a plain paragraph of some words, with nothing around it.</p>") == ["Only a plain paragraph of some words, with nothing around it."]
    assert texts("A page of plain text, without any markup at all.") == ["A page of plain text, without any markup at all."]
    assert texts("<nav><a href=x>Home</a></nav><p>The words of the article stand here.</p><footer>&copy; us</footer>") == ["The words of the article stand here."]


def test_long_pages_in_parts(labeller):
    found = html_blocks.blocks("".join(page for page, _ in unlike(60, 9)))
    assert (labeller.label_long(found, 50) == labeller.label([found])[0]).all() and len(found) > 500


@pytest.mark.parametrize("part", ["<script ", "<a ", "<div class=a>a", "<", "<p>", "<i>x", "<!--", "<a x='<b y=\"", "<svg><p>", "<li><b>", "</i><b>"])
def test_cutting_takes_time_in_proportion(part):
    began = time.process_time()
    html_blocks.blocks(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 10


def test_pages(spark, sf_dir, labeller):
    from texloom.llm.queries import op6_html_blocks

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    article = F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1)
    parts = F.transform(F.split(article, "</?(?:p|h1)>"), lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")))
    want = pages.select("page_id", F.replace(F.array_join(F.filter(parts, lambda x: x != ""), "\n\n"), F.lit("&amp;"), F.lit("&")).alias("want"))
    assert op6_html_blocks(spark, sf_dir).join(want, "page_id").where("text <> want or n_chars <> length(want)").count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<p>" * 5000 + "x", "y"), (3, "<p>" * 5000 + "x", "y")], "page_id long, html string, text string")
    got = html_blocks.extract(odd, model=labeller)
    assert got.count() == 4 and got.where("html is null").first().text == "" and html_blocks.extract(odd.where("false"), model=labeller).count() == 0


def test_measures_by_hand():
    """The sizes are those of a compressor made anew for every block."""
    import zstandard

    bad, good = b"buy now!! click here " * 300, b"the river ran slowly past the old mill and the fields " * 200
    r = random.Random(8)
    for n in (0, 1, 40, 900, 5000):
        text = "".join(r.choice(["the river ", "click here ", "Old Mill 12 ", "\u00e9t\u00e9 "]) for _ in range(n))
        raw = text.encode()

        def size(part, held=None):
            args = {"dict_data": zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT), "write_content_size": False} if held else {}
            return len(zstandard.ZstdCompressor(level=quality_model.LEVEL, **args).compress(part))

        shape = lambda b: bytes(97 if chr(c).islower() or c > 127 else 65 if chr(c).isupper() else 48 if chr(c).isdigit() else c for c in b)
        parts = [raw[i : i + quality_model.BLOCK] for i in range(0, len(raw), quality_model.BLOCK)] or [b""]
        want = [(sum(size(p, bad) for p in parts) - sum(size(p, good) for p in parts)) / (len(raw) + 1), (sum(size(shape(p), shape(bad)) for p in parts) - sum(size(shape(p), shape(good)) for p in parts)) / (len(raw) + 1), size(raw) / (len(raw) + 1)]
        assert np.allclose(quality_model.Compressors(bad, good).measures(text), want, atol=0.002)


def made(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices(["an", "er", "th", "on", "re", "de"], k=r.randint(1, 4)))
    rows = []
    for i in range(n):
        good = r.random() < 0.7
        text = " ".join(word() for _ in range(r.randint(20, 200)))
        rows.append((seed * 100_000 + i, text.capitalize() + "." if good else text.upper().replace(" ", "!! "), int(good)))
    return rows


def test_classifier(spark, odd, sf_dir):
    rows = spark.createDataFrame(made(400, 1), "doc_id long, text string, quality int")
    model = quality_model.fit(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    out = quality_model.scored(rows, model).where(quality_model.held_out()).collect()
    assert len(out) > 80 and all((r.score >= 0.5) == bool(r.quality) for r in out)
    flipped = rows.withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_model.fit(rows.select("doc_id", "text"), flipped.select("doc_id", "quality"))
    assert np.allclose(again.weights, model.weights) and again.bad == model.bad  # held-out labels teach nothing
    assert quality_model.scored(odd, model).where("score between 0 and 1").count() == odd.count()
    none = quality_model.fit(rows.select("doc_id", "text"), rows.select("doc_id", "quality").where("false"))
    assert {r.score for r in quality_model.scored(odd, none).collect()} == {0.5}
    from texloom.llm.queries import op7_quality_model

    held = op7_quality_model(spark, sf_dir.replace("0.001", "0.01")).join(spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) > 0.97 * len(good) * len(bad)


def test_pipeline(spark, sf_dir, tmp_path):
    from test_dedup import brute, reached
    from test_rules_and_chat import counts
    from test_scans import brute_spans
    from test_tokens import check_packed

    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = (before.collect(), docs.collect())
    ids = lambda rows: {r.doc_id for r in rows}
    before, after = kept["quality_rules"]
    failed = {r.doc_id for r in before if (c := counts(r.text))[0] < 20 or 100 * c[5] > 30 * c[0]}
    assert not failed & ids(after) and len(after) > 0.75 * len(before)
    before, after = kept["quality_classifier"]
    bad = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    assert bad & ids(before) == bad & ids(after)
    before, after = kept["jaccard_join"]
    rows = [(r.doc_id, r.text) for r in sorted(before)]
    assert ids(after) == {rows[k][0] for k, root in enumerate(reached(len(rows), brute(rows))) if root == k}
    before, after = kept["pii"]
    assert ids(before) == ids(after) and not any(brute_spans(r.text) for r in after)
    clean = {r.doc_id: r.text for r in before if not any(c.isdigit() or c == "@" for c in r.text)}
    assert all(clean[r.doc_id] == r.text for r in after if r.doc_id in clean) and all(r.n_chars == len(r.text) for r in after)
    before, after = kept["packing"]
    check_packed(after, [(r.doc_id, r.text) for r in before])


def test_pipeline_on_an_empty_table(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, sf_dir).count() == 0


def test_blocks_of_formulas_fallbacks_and_pages_without_head_tags():
    texts = lambda page: [b[0] for b in html_blocks.blocks(page)]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>") == ["so x=1 holds"]
    assert texts("<p>a <svg viewBox='0'/> b</p><p>c</p>") == texts("<p>a <svg><path d=1> b</p><p>c</p>") == ["a b", "c"]
    assert texts("<object data=x><p>fall</p></object><noscript><p>n</p></noscript><template><p>t</p></template>z") == ["fall", "n", "t", "z"]
    assert texts("<title>t</title><meta x><p>body</p>") == texts("<head><title>t</title><meta x><p>body</p>") == ["body"]
    assert texts("<html><head><title>t</title>plain text") == ["plain text"]
    assert texts("<p>a</p><script>x<p>y") == ["a"]


def test_near_copies_of_repeated_and_null_ids(spark, sf_dir):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, words(1), "en", "s", 1), (1, words(1), "en", "s", 1), (1, words(2), "en", "s", 1), (None, words(2), "en", "s", 1), (None, words(3), None, None, 1), (None, words(3) + " end", None, None, 1), (None, words(4), "en", "s", 1), (5, words(1), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_copies(spark, docs, sf_dir).collect()
    # a null id counts as the smallest
    assert sorted((r.doc_id or 0, r.text.split("x")[0]) for r in kept) == [(0, "w2"), (0, "w3"), (0, "w4"), (1, "w1")]
