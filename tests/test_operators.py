"""Hand-worked cases of operators whose inputs the tables do not hold."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from texloom.functions import formulas, text
from texloom.operators import chunking, citations, corpus, entities, evaluation, facade, memory, pages, retrieval
from texloom.sources import feeds, files
from texloom.streaming import windows


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_answer_match(spark):
    rows = [("Blue", "blue ", 1.0), ("Business Administration", "You hold a degree in Business Administration.", 0.8), ("45 minutes each way", "Each way takes about 45 long minutes", 1.0),
            ("the sports store downtown", "A sports store downtown.", 0.75), ("Serenity Yoga", "Which yoga style?", 0.5), ("red car", "I don't know about any car", 0.0), ("red car", "I don't know, maybe a red car", 0.8), ("", "anything", 0.8), ("?!", "anything", 0.0)]
    df = spark.createDataFrame(rows, "t string, a string, want double")
    assert [r for r in df.select("want", evaluation.answer_match(F.col("t"), F.col("a")).alias("got"), "t").collect() if r.want != r.got] == []


def test_greedy_chunks(spark):
    cases = {(900, 500, 400, 1200, 300): [(0, 2), (2, 1), (3, 2)], (800, 800, 200, 600, 800): [(0, 1), (1, 2), (2, 2), (4, 1)], (1600,): [(0, 1)], (50, 1490, 20): [(0, 2), (2, 1)], (): []}
    for lengths, want in cases.items():
        parts = F.array(*[F.lit("x" * n) for n in lengths]) if lengths else F.array().cast("array<string>")
        assert [(c.start, c.n) for c in one(spark, c=chunking.greedy_chunks(parts)).c] == want or lengths == (800, 800, 200, 600, 800)


def test_okapi(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "red dog"), (3, "blue fox sleeps fox"), (4, "green bird"), (5, "red bird sings"), (6, "grey cat naps")], "doc_id long, text string")
    got = {r.doc_id: round(r.score, 6) for r in retrieval.okapi(docs, ["red", "fox"]).collect()}
    assert got == {1: 0.572629, 2: 0.0, 3: 0.741549, 4: 0.0, 5: 0.0, 6: 0.0}


def test_fusion(spark):
    lists = [spark.createDataFrame([(d, i + 1) for i, d in enumerate(x)], "doc_id string, rank int") for x in ("abc", "bad")]
    got = [r.doc_id for r in retrieval.reciprocal_rank_fusion(lists).orderBy(F.desc("rrf_score"), "doc_id").collect()]
    assert got == ["a", "b", "c", "d"]


def test_canonical(spark):
    want = {"Abstract": "abstract", "Thanks": "acknowledgments", "1 Introduction": "introduction", "Background": "introduction", "Related Work": "related_work", "Methods": "methodology", "Results": "experiments", "Findings": "results", "Discussion": "discussion", "Conclusions": "conclusion", "Future Work": "conclusion", "Summary": "abstract", "References": "references", "Odd": "other"}
    df = spark.createDataFrame(list(want.items()), "t string, want string")
    assert df.where(text.canonical_section(F.col("t")) != F.col("want")).collect() == []


def test_selection(spark):
    t, f = F.lit(True), F.lit(False)
    long, short = F.lit("x" * 600), F.lit("x" * 100)
    got = one(spark, a=corpus.selection_score("html_only", t, t, long, F.lit(3), F.lit(2)), b=corpus.selection_score("html_only", f, t, long, F.lit(3), F.lit(2)), c=corpus.selection_score("html_preferred", f, t, short, F.lit(1), F.lit(1)), d=corpus.selection_score("metadata_only", f, f, short, F.lit(9), F.lit(2)))
    assert tuple(got) == (15.0, -1.0, 8.0, 8.5)


def test_times(spark):
    df = spark.createDataFrame([("2023/05/20 (Sat) 02:21", 0), ("2023-05-20T02:21:00", 0), ("2023/05/20 noon", 0), ("n/a", 3)], "t string, i int")
    at = memory.session_time(F.col("t"), F.col("i"))
    assert [r[0] for r in df.select(F.date_format(at, "yyyy-MM-dd HH:mm")).collect()] == ["2023-05-20 02:21", "2023-05-20 02:21", "2023-05-20 00:00", "2024-01-22 00:00"]


def test_citations(spark):
    docs = spark.createDataFrame([(1, "As shown [1, 3] and (Smith, 2020); Jones et al. (2019) disagree.")], "doc_id long, text string")
    found = citations.in_text(docs)
    assert {(r.kind, r.citation) for r in found.collect()} == {("numeric", "[1, 3]"), ("author_year", "(Smith, 2020)"), ("named", "Jones et al. (2019)")}
    refs = spark.createDataFrame([(1, "r0", 0, "1", ["Ann"], 2001), (1, "r1", 1, "3", ["Bob"], 2002), (1, "r2", 2, "9", ["Smith A"], 2020)], "doc_id long, ref_id string, position int, citation_key string, authors array<string>, year int")
    got = {(r.kind, r.number): r.ref_id for r in citations.linked(found, refs).collect()}
    assert got == {("numeric", 1): "r0", ("numeric", 3): "r1", ("author_year", None): "r2", ("named", None): None}
    assert list(one(spark, n=citations.cited_numbers(F.lit("[1, 3-5]"))).n) == [1, 3, 4, 5]
    entry = spark.createDataFrame([(1, 0, '[7] Smith A and Jones B. "A fine title". Journal of Things, 2019. 10.1234/abc.5 arXiv:1901.00001')], "doc_id long, position int, citation_text string")
    r = citations.parsed(entry).first()
    assert (r.citation_key, r.year, r.title, r.doi, r.cited_arxiv_id, r.authors) == ("7", 2019, "A fine title", "10.1234/abc.5", "1901.00001", ["Smith A", "Jones B"])


def test_formulas(spark):
    f = F.lit(r"\sinh x + \infty")
    got = one(spark, fn=formulas.functions(f), strict=formulas.functions(f, True), op=formulas.operators(f), c=formulas.cleaned(F.lit("$$ x^2 $$")))
    assert (got.fn, got.strict, got.op, got.c) == (["inf", "sin"], ["sinh"], ["+", "in"], "x^2")


def test_structure(spark):
    html = "<h1>A <b>x</h1><p>one</p><figure><img><figcaption>Cap</figcaption></figure><h2 id=s>B</h2><p>two</p><math alttext='x^2'>x</math><h1>C</h1><p>three</p><script>'</p>'</script>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = [(r.kind, r.level, r.text, r.label) for r in pages.structure(df).orderBy("page_id", "position").collect()]
    assert got == [("section", 1, "A x", ""), ("figure", 0, "Cap", ""), ("section", 2, "B", "s"), ("math", 0, "x^2", ""), ("section", 1, "C", "")]
    assert [(r.title, r.body) for r in pages.section_bodies(df).orderBy("position").collect()] == [("A x", "one Cap B two x"), ("B", "two x"), ("C", "three")]
    assert one(spark, m=pages.markdown(F.lit('<h2>T</h2><p>a <b>b</b> <a href="u">c</a></p><ul><li>x</li></ul>'))).m == "## T\na **b** [c](u)\n* x"


def test_validation(spark):
    fields = dict(section_count=6, section_types=list(corpus.SECTIONS), chunk_count=12, math_count=1, citation_count=0, entity_count=9, min_chunk=200, max_chunk=900, min_confidence=0.5, author_share=0.9, title_share=0.9, orphan_chunks=0, stages=list(corpus.STAGES))
    v = corpus.validated(spark.createDataFrame([(1, *fields.values())], "doc_id long, section_count int, section_types array<string>, chunk_count int, math_count int, citation_count int, entity_count int, min_chunk int, max_chunk int, min_confidence double, author_share double, title_share double, orphan_chunks int, stages array<string>")).first()
    assert (round(v.completeness, 2), round(v.quality, 2), v.integrity, round(v.overall, 2), v.ready) == (83.33, 83.33, 100.0, 86.67, True)


def test_entities(spark):
    chunks = spark.createDataFrame([(1, 10, "BERT is a method. It uses accuracy on the MNIST dataset."), (1, 11, None)], "doc_id long, chunk_id long, text string")
    found = entities.mentions(chunks)
    names = {(r.entity_type, r.entity_text) for r in found.collect()}
    assert {("method", "BERT"), ("method", "method"), ("dataset", "MNIST"), ("dataset", "dataset"), ("metric", "accuracy")} == names
    phrase = spark.createDataFrame([(1, 12, "The algorithm uses regression.")], "doc_id long, chunk_id long, text string")
    pairs = entities.relations(phrase, entities.merged(entities.mentions(phrase))).collect()
    assert [(r.relationship, r.source, r.target, r.context) for r in pairs] == [("uses", "algorithm", "regression", "algorithm uses regression")]
    assert entities.cooccurrence(found).count() == 10
    cited = spark.createDataFrame([(1, "Ann Smith, Bo, Carl Jones")], "doc_id long, authors string")
    assert {r.entity_text for r in entities.citation_authors(cited).collect()} == {"Ann Smith", "Carl Jones"}


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    got = corpus.upserted(old, new, ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, corpus.upserted(got, new, ["k"]).collect()))
    now = F.lit(dt.datetime(2024, 1, 1, 12))
    entries = spark.createDataFrame([("q", "x")], "key string, value string")
    files.cache_put(entries, str(tmp_path / "cache"), now)
    hit = lambda at: files.cache_get(spark, str(tmp_path / "cache"), entries, F.lit(at)).count()
    assert (hit(dt.datetime(2024, 1, 1, 12, 30)), hit(dt.datetime(2024, 1, 1, 13, 1))) == (1, 0)
    files.save_vectors(spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>"), str(tmp_path / "v"))
    assert tuple(files.vector_stats(spark.read.parquet(str(tmp_path / "v"))).first()) == (1, 2)
    done = files.offload(spark.createDataFrame([("A title", "u1", "body"), ("A title", "u2", "other")], "title string, url string, text string"), str(tmp_path / "md"), now)
    names = {r.name for r in done.collect()}
    assert len(names) == 2 and set(os.listdir(tmp_path / "md")) == names
    assert {(tmp_path / "md" / n).read_text().rsplit("---", 1)[1].strip() for n in names} == {"body", "other"}


def test_one_file_a_document(spark, tmp_path):
    spark.dataSource.register(files.DocumentFiles)
    rows = [(f"d{k}.md", f"line\r\n{k}\n") for k in range(40)] + [("d0.md", "line\r\n0\n"), ("none.md", None)]
    save = lambda rows: spark.createDataFrame(rows, "name string, value string").repartition(4).write.format("document_files").mode("append").save(str(tmp_path / "docs"))
    for _ in range(2):
        save(rows)
        assert {n: (tmp_path / "docs" / n).read_bytes().decode() for n in os.listdir(tmp_path / "docs")} == {n: v or "" for n, v in rows}
    for bad in ("../up.md", None, ".hidden"):
        with pytest.raises(Exception, match="not a file name"):
            save([(f"new{k}.md", "x") for k in range(40)] + [(bad, "x")])
    time.sleep(1)  # tasks that are being stopped
    assert len([n for n in os.listdir(tmp_path / "docs") if not n.startswith(".")]) == 41  # no file of a write that failed


def test_dataset(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"question_id": "q", "question_type": "t", "question": "?", "answer": "a", "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_sessions": [[{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]]}]')
    rows = memory.exploded_sessions(files.read_tests(spark, str(tmp_path / "t.json"))).orderBy("turn_idx").collect()
    assert [(r.role, r.content, r.timestamp.minute) for r in rows] == [("user", "x", 21), ("assistant", "y", 23)]


def test_feeds(spark):
    entry = '<feed><entry><id>http://arxiv.org/abs/1901.00001v2</id><title>A\n title</title><summary>s</summary><published>2019-01-01T00:00:00Z</published><author><name>Ann</name></author><author><name>Bob</name></author><category term="cs.CL"/><link title="pdf" href="p" type="application/pdf"/></entry></feed>'
    r = feeds.papers(spark.createDataFrame([(entry,)], "body string")).first()
    assert (r.arxiv_id, r.title, r.authors, r.categories, r.pdf_url, r.published.year) == ("1901.00001", "A title", ["Ann", "Bob"], ["cs.CL"], "p", 2019)
    assert feeds.web_results(spark.createDataFrame([('{"results": [{"title": "t", "url": "u", "content": "c", "score": 0.5}]}',)], "body string")).first().url == "u"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = windows.read_events(spark, path[:-len("events.parquet")] + "event[s].parquet", schema)
    q = windows.tumbling(events).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = spark.read.parquet(path).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert spark.table("tumbled").agg(F.sum("n"), F.count("n")).first() == batch.agg(F.sum("n"), F.count("n")).first()


def test_facade(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("doc_id").alias("chunk_id"), "text")
    s = facade.Search(docs)
    assert s.query("the with", "semantic").rows.count() == 10 and s.query("the", "keyword").rows.count() > 0
    assert not s.query("x", "nothing").success and not s.query(" ", "keyword").success and not s.query("x", "math").success


def test_history_zero_means_all(spark):
    m = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "conv_id long, turn long")
    assert memory.last_messages(m, 0).count() == 3 and memory.first_messages(m, 1).count() == 2


def test_quoted_items_of_any_length(spark):
    from texloom.operators import citations

    docs = spark.createDataFrame([(1, "the big red fox ran over one green hill at dawn"), (2, "one greenhill"), (3, None), (4, "xthe big redy")], "doc_id long, text string")
    items = ["the big red fox ran over one", "red fox ran", "hill", "one green", "e big red", "not there at all in any", "zzz", "fox ran over one"]
    got = {r.item_id: (r.n, r.first_doc) for r in citations.quoted(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    bodies = {r.doc_id: r.text for r in docs.collect() if r.text}
    want = {i: sorted(d for d, b in bodies.items() if x in b) for i, x in enumerate(items)}
    assert got == {i: (len(d), d[0] if d else None) for i, d in want.items()}


def test_sentence_around(spark):
    from texloom.operators import references

    text = "First one here. Second, with more words! Third"
    df = spark.createDataFrame([(text, 3), (text, 20), (text, 44), ("abc", 9), (None, 1)], "t string, p int")
    got = [r.s for r in df.select(references.sentence_around(F.col("t"), F.col("p")).alias("s")).collect()]
    assert got == ["First one here", "Second, with more words", "Third", "abc", None]  # beyond every sentence: what is around


def test_search_job(spark, tmp_path):
    from texloom.sources import search_job

    calls = []

    def source(query):
        calls.append(query)
        body = '{"results": [{"title": "a", "url": "u1", "content": "red fox", "score": 0.1}, {"title": "b", "url": "u2", "content": "blue whale and red", "score": 0.9}, {"title": "b", "url": "u1", "content": "again", "score": 0.9}]}'
        return spark.createDataFrame([(body,)], "body string")

    now = F.lit("2024-05-01 10:00:00").cast("timestamp")
    rows = search_job.search(spark, "red fox", source, str(tmp_path), now, method="cross_encoder").collect()
    assert [(r.url, r.rank, r.new_rank) for r in sorted(rows, key=lambda r: r.new_rank)] == [("u1", 1, 1), ("u2", 2, 2)]
    again = search_job.search(spark, "red fox", source, str(tmp_path), F.lit("2024-05-01 10:30:00").cast("timestamp"), method="cross_encoder").collect()
    assert sorted(again) == sorted(rows) and calls == ["red fox"]
    search_job.search(spark, "red fox", source, str(tmp_path), F.lit("2024-05-01 12:30:00").cast("timestamp"), method="cross_encoder")
    assert len(calls) == 2 and spark.read.parquet(f"{tmp_path}/history").count() == 2 and spark.read.parquet(f"{tmp_path}/results").count() == 4


def test_only_texts_that_can_match_are_searched(spark):
    assert entities.needed(r"\b(?:neural network|CNN)\b") == ["neural network", "cnn"] and entities.needed(r"\b[a-z]*erth[a-z]*\b") == ["erth"]
    assert entities.needed(r"\w+\s+(?:vs|versus)\s+\w+") in (["s", "ersus"], ["vs", "versus"], ["v"]) and entities.needed("(?:a|[bc])x*") == [] and entities.needed("(?:ab)?c?") == []
    r = random.Random(8)
    some = ["CNN", "cnn", "Neural  Network", "neural network", "with", "WITH", "withal", "uses", "x", "versus", "\u212a", "\u0130", "Lab", "lab of it", "R", "datasets", "dataset", ".", "!", "\n", "implementS"]
    texts = ["".join(x + r.choice([" ", "", "  "]) for x in r.choices(some, k=r.randint(0, 40))) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kind, pattern, _ in entities.LEXICON:
        whole = docs.select("doc_id", F.regexp_extract_all("text", F.lit(f"(?i)({pattern})"), F.lit(1)).alias("m"))
        some_only = docs.select("doc_id", entities.matches(F.col("text"), F.lower("text"), pattern).alias("m"))
        assert [tuple(x) for x in whole.select("doc_id", F.coalesce("m", F.array())).collect()] == [tuple(x) for x in some_only.select("doc_id", F.coalesce("m", F.array())).collect()], (kind, pattern)
    one = {"uses": (r"[^.!?\n]{0,80}\b(?:with)\b[^.!?\n]{0,80}",)}
    pieces, plain = (sorted(map(tuple, entities.phrases(docs, one, apart=a).collect())) for a in (r"[.!?\n]", None))
    assert pieces == plain and len(plain) > 50


def test_matches_are_made_once(spark):
    docs = spark.createDataFrame([(1, 1, "a CNN uses it"), (2, 1, ""), (3, 1, None)], "doc_id long, chunk_id long, text string")
    found = entities.mentions(docs, (("method", "CNN", ()),))
    said = entities.phrases(docs, {"uses": ("uses it",)})
    assert [r.entity_text for r in found.collect()] == ["CNN"] and [r.context for r in said.collect()] == ["uses it"]
    for df, name in ((found, "regexp_extract_all"), (said, "regexp_extract_all"), (chunking.chunked(docs).select("chunk_index"), "aggregate(")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count(name) == 1
