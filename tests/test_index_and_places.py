"""The stored index, joins by place and phrase, many-query neighbours, samples by threshold, repeatable writes, streamed messages."""

import hashlib
import random
import re
import shutil
import uuid

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from texloom.operators import citations, evaluation, intervals, memory, neighbours, phrases, retrieval, text_index
from texloom.plans import catalog
from texloom.streaming import deltas, sinks


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(3)
    names = ["a", "bb", "c", "dd", "e"] + [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(r.choices(names, [40, 20, 10, 3, 1] + [1] * 60, k=r.randint(1, 80)))) for i in range(400)] + [(400, ""), (401, None)] + [(402 + i, "a a bb same text") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


@pytest.mark.parametrize("terms,k,share", [(["dd", "e"], 5, 50), (["w3", "dd", "w3"], 20, 16), (["a", "e"], 7, 1000), (["none"], 3, 50), (["a"], 500, 50), (["a", "bb", "w1"], 40, 20), ([], 4, 50)])
def test_index_gives_okapi_top_k(spark, texts, tmp_path, terms, k, share):
    index = text_index.TextIndex(spark, f"ix_{uuid.uuid4().hex}").build(texts, str(tmp_path), buckets=4, share=share)
    want = retrieval.okapi(texts, terms).select("doc_id", F.round("score", 9).alias("s")).orderBy(F.desc("s"), "doc_id").limit(k).collect()
    got = index.top(terms, k).select("doc_id", F.round("score", 9).alias("s")).collect()
    assert [tuple(x) for x in got] == [tuple(x) for x in want]
    within = spark.createDataFrame([(i,) for i in range(0, 460, 7)] * 2, "doc_id long")
    want = retrieval.okapi(texts, terms).join(within.distinct(), "doc_id", "left_semi").select("doc_id", F.round("score", 9).alias("s")).orderBy(F.desc("s"), "doc_id").limit(k).collect()
    assert [tuple(x) for x in index.top(terms, k, within).select("doc_id", F.round("score", 9).alias("s")).collect()] == [tuple(x) for x in want]


def test_index_reads_blocks_not_texts(spark, sf_dir, texts, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = text_index.of(docs, str(tmp_path))
    assert text_index.of(docs, str(tmp_path)) == index and index.exists()
    shown = plan(index.top(["erth", "ening"], 5))
    assert "text:string" not in shown and "SelectedBucketsCount: " in shown and "32 out of 32" not in shown.split("SelectedBucketsCount: ")[1][:20]
    blocks = index.table("postings").where("term in ('the', 'ening')")
    weights, avgdl = index.weights(["the", "ening"])
    if min(weights.values()) >= 0:
        assert index.promising(blocks, weights, avgdl, 3, lambda df: df, 1.5, 0.75).count() < blocks.count()
    again = index.build(docs.limit(10), str(tmp_path))  # in place of what was there
    assert again.table("documents").count() == 10 and again.table("totals").first().n == 10


def test_index_leaves_out_blocks(spark, tmp_path):
    rows = [(i, "rare " * 5 + "x") for i in range(5)] + [(i, "common " + " ".join(f"y{i % 50}{k}" for k in range(i % 40))) for i in range(5, 900)] + [(i, " ".join(f"z{i}_{k}" for k in range(5))) for i in range(900, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = text_index.TextIndex(spark, f"ix_{uuid.uuid4().hex}").build(docs, str(tmp_path), share=100)
    weights, avgdl = index.weights(["rare", "common"])
    blocks = index.table("postings").where("term in ('rare', 'common')")
    kept = index.promising(blocks, weights, avgdl, 3, lambda df: df, 1.5, 0.75)
    assert {r.term for r in kept.select("term").distinct().collect()} >= {"rare"} and kept.where("term = 'common'").count() < blocks.where("term = 'common'").count() / 2


def test_index_is_not_lost_to_others(spark, sf_dir, texts, tmp_path):
    path, folder = str(tmp_path / "documents.parquet"), str(tmp_path / "index")
    texts.repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    want = [tuple(r) for r in retrieval.okapi(docs, ["dd"]).select("doc_id", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(5).collect()]
    top = lambda d: [tuple(r) for r in text_index.of(d, folder).top(["dd"], 5).select("doc_id", F.round("score", 9)).collect()]
    assert top(docs) == want
    index = text_index.of(docs, folder)
    index.build(docs.limit(10), folder)  # something else under its name
    assert top(docs) == want and index.table("totals").first().n == docs.count()
    some = docs.where("doc_id < 100")  # other rows of the same files
    assert text_index.of(some, folder) != index and text_index.of(some, folder).table("totals").first().n == 100
    for part in ("postings", "terms", "documents", "totals"):  # a catalog without the tables, as of a new session: the files are taken up
        spark.sql(f"drop table {index.name}_{part}")
    held = index.spark.read.parquet(f"{folder}/{index.name}/*/totals").where("made_for is not null").first().folder
    assert top(docs) == want and index.table("totals").first().folder == held and "SelectedBucketsCount: " in plan(index.top(["dd"], 5))
    for part in ("terms", "documents"):
        gone = sorted((tmp_path / "index" / index.name / held.rsplit("/", 1)[-1] / part).glob("*.parquet"))[0]
        gone.unlink()  # files that another session took away
        assert top(docs) == want
        held = index.table("totals").first().folder
    held = {index.table("totals").first().folder}
    shutil.rmtree(folder)
    assert top(docs) == want and index.table("totals").first().folder not in held


def test_index_build_shuffles_texts_only(spark, texts, tmp_path):
    dealt = texts.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int")).repartition(5, "share")
    counted = text_index.postings(dealt, "doc_id", "text", text_index.blank_tokens).groupBy("share", "term").agg(F.count(F.lit(1)).alias("n"))
    shown = counted._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange hashpartitioning") == 1 and counted.agg(F.sum("n")).first()[0] == retrieval.postings(texts).count()


def test_located_and_overlapping(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choices("ab$é 1", k=r.randint(0, 80)))) for i in range(200)] + [(200, None), (200, "$$$$"), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for pattern in (r"\$[^$]+\$", "a+", "[0-9]"):
        got = sorted(map(tuple, intervals.located(docs, pattern).collect()))
        assert got == sorted((i, m.start(), m.end(), m[0]) for i, t in rows for m in re.finditer(pattern, t or ""))
    spans = lambda n, seed, long: [(f.randrange(5), s, s + f.choice([0, 1, 3, 17, long]), k) for f in [random.Random(seed)] for k in range(n) for s in [f.randrange(300)]]
    a, b = spans(150, 1, 90) + [(None, 1, 5, 999)], spans(120, 2, 200)
    left, right = (spark.createDataFrame(x, "doc long, start long, end long, n int") for x in (a, b))
    for width in (1, 7, 64, 1000):
        for inside in (False, True):
            fits = (lambda x, y: y[1] <= x[1] and x[2] <= y[2]) if inside else (lambda x, y: x[1] < y[2] and y[1] < x[2])
            want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and fits(x, y))
            found = intervals.overlapping(left, right, "doc", width, inside)
            assert sorted((r.left_n, r.right_n) for r in found.collect()) == want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    long = spark.createDataFrame([(1, "x" * 2000), (2, "y" * 800), (3, ""), (4, None)], "doc_id long, text string")
    assert sorted(tuple(x) for x in intervals.windows(long, 800, 600).collect()) == [(1, 0, 0, 800), (1, 1, 600, 1400), (1, 2, 1200, 2000), (2, 0, 0, 800)]


def test_phrases_in_texts(spark):
    r = random.Random(5)
    some = lambda k: "".join(r.choices("abcé d", k=k))
    rows = [(i, some(r.randint(0, 60))) for i in range(150)] + [(150, None), (0, "abc again"), (None, "abcd")]
    names = [some(r.randint(1, 9)) for _ in range(400)] + ["", None, "abc", "abc"] + [rows[7][1]]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(names)), "phrase_id long, phrase string")
    want = sorted({(p, i) for p, n in enumerate(names) for i, t in rows if n and t and i is not None and n in t})
    for q in (1, 3, 6):
        found = phrases.held(docs, wanted, q)
        assert sorted(map(tuple, found.collect())) == want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert phrases.held(docs, wanted.where("false")).count() == 0 and phrases.held(docs.where("false"), wanted).count() == 0


def test_ten_thousand_phrases_in_one_pass(spark):
    r = random.Random(6)
    names = ["".join(r.choices("abcdefghij", k=r.randint(5, 9))) for _ in range(10_000)]
    rows = [(i, " ".join(r.choices(names, k=12))) for i in range(300)]
    found = phrases.held(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(names)), "phrase_id long, phrase string"))
    pairs = {tuple(x) for x in found.collect()}
    at = {n: k for k, n in enumerate(names)}
    assert {(at[w], i) for i, t in rows for w in t.split()} <= pairs
    assert all(names[p] in rows[i][1] for p, i in pairs)


def test_short_items_need_no_nested_loop(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "xtwo"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two"), (2, "one two"), (3, "two three four"), (4, "none")], "item_id long, text string")
    found = citations.quoted(docs, items)
    assert {r.item_id: (r.n, r.first_doc) for r in found.collect()} == {1: (2, 1), 2: (1, 1), 3: (1, 1), 4: (0, None)}
    assert "NestedLoop" not in plan(found)


@pytest.mark.parametrize("group,block", [("label", 4096), ("label", 20), (None, 33)])
def test_nearest_of_many_queries(spark, group, block):
    r = np.random.default_rng(7)
    x = r.normal(size=(160, 6)).round(2)
    x[40:90] = x[40]  # many ties
    rows = [(i, [float(c) for c in v], None if i == 9 else 0 if i < 120 else i % 3) for i, v in enumerate(x)] + [(160, None, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    asked = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")
    got = sorted((a.query_id, a["rank"], a.vec_id, round(a.distance, 5)) for a in neighbours.nearest_per_query(vectors, asked, 8, group, block).collect())
    flat, want = np.array([np.float32(v) for v in x], np.float64), []
    for q in range(0, 160, 10):
        near = sorted((((flat[q] - flat[i]) ** 2).sum(), i) for i in range(160) if i != q and (group is None or rows[i][2] is not None and rows[i][2] == rows[q][2]))[:8]
        want += [(q, k, i, round(d, 5)) for k, (d, i) in enumerate(near, 1)]
    assert got == sorted(want)


def test_samples_by_threshold(spark, monkeypatch):
    rows = [(i, None if i % 5 == 0 else "big" if i % 5 < 4 else f"s{i % 50}") for i in range(3000)] + [(None, "big")]
    df = spark.createDataFrame(rows, "id long, kind string").withColumn("n", F.lit(1))
    order = lambda i: (hashlib.md5(f"{i}42".encode()).hexdigest(), i)
    for digits in (1, 2, 4):
        monkeypatch.setattr(evaluation, "HASH_DIGITS", digits)
        for find, quota in ((lambda d: evaluation.balanced(d, "kind", "id", 37), lambda n: 37), (lambda d: evaluation.stratified(d, "kind", "id", 0.1), lambda n: max(1, int(n * 0.1)))):
            want = set()
            for kind in {k for _, k in rows}:
                own = [i for i, k in rows if k == kind and i is not None]
                want |= set(sorted(own, key=order)[: quota(len(own) + (kind == "big"))])
            got = [x.id for x in find(df).collect()]
            assert len(got) == len(want) and len(set(got) - want) <= 1  # the null id comes first in its stratum


def test_cascade(spark):
    one = lambda rows, names: spark.createDataFrame(rows, names)
    tables = {"user": one([("a",), ("ab",), ("b",)], "u string"), "session": one([(1, "a"), (2, "ab"), (3, "b"), (4, None)], "s long, u string"), "message": one([(10, 1), (11, 2), (12, 3), (13, None)], "m long, s long"), "vector": one([(7, 10), (8, 12), (9, 12)], "v long, m long")}
    links = [("session", "u", "user", "u"), ("message", "s", "session", "s"), ("vector", "m", "message", "m")]
    left = memory.cascade(tables, links, "user", tables["user"].where("u like 'a%'"))
    assert {n: sorted(r[0] for r in df.collect()) for n, df in left.items()} == {"user": ["b"], "session": [3, 4], "message": [12, 13], "vector": [8, 9]}
    left = memory.cascade(tables, links, "session", tables["session"].where("s = 3"))
    assert {n: df.count() for n, df in left.items()} == {"user": 3, "session": 3, "message": 3, "vector": 1}


def test_writes_that_run_twice(spark, tmp_path):
    batches = [[(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 1), (2, "old", 0)], [(1, "late", 0)]]
    log, put = sinks.append_once(f"{tmp_path}/log"), sinks.upsert(f"{tmp_path}/rows", ["id"], "at", buckets=3)
    for number in (0, 0, 1, 1, 2, 1, 2):  # every batch runs again, one after a later one
        batch = spark.createDataFrame(batches[number], "id long, text string, at int")
        log(batch, number)
        put(batch, number)
    assert sorted((r.batch_id, r.id, r.text) for r in spark.read.parquet(f"{tmp_path}/log").collect()) == sorted((n, i, t) for n, b in enumerate(batches) for i, t, _ in b)
    assert sorted((r.id, r.text) for r in spark.read.parquet(f"{tmp_path}/rows").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    put(spark.createDataFrame([], "id long, text string, at int"), 3)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 3


@pytest.fixture(scope="module")
def spoken(spark):
    r = random.Random(9)
    rows = [(i, k, "".join(r.choices("abcé <>", k=r.choice([0, 1, 7, 40, 95])))) for i in range(6) for k in range(3)]
    at = F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 60 + F.col("msg"))
    return {(i, k): t for i, k, t in rows}, deltas.cut(spark.createDataFrame(rows, "conv_id long, msg long, text string").withColumn("at", at), 10).collect()


def streamed(spark, rows, folder, files, per_batch, **options):
    """The rows dealt to files in the order given, and the messages that the stream gives."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", deltas.STATE_STORE)
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], deltas.DELTA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(deltas.DELTA).option("maxFilesPerTrigger", per_batch).parquet(f"{folder}/in")
    return lambda: sinks.run(deltas.accumulated(stream, **options), sinks.upsert(f"{folder}/out", ["conv_id", "msg"], "at"), f"{folder}/checkpoint")


@pytest.mark.parametrize("files,per_batch", [(1, 1), (5, 1), (5, 2)])
def test_streamed_messages_equal_the_batch(spark, spoken, tmp_path, files, per_batch):
    want, rows = spoken
    rows = [tuple(r) for r in rows]
    random.Random(files).shuffle(rows)
    streamed(spark, rows + rows[:20], str(tmp_path), files, per_batch, late="1 day", keep_ms=10**9)()
    out = {(r.conv_id, r.msg): r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == want
    assert {(r.conv_id, r.msg): r.text for r in deltas.assembled(spark.createDataFrame(rows + rows[:20], deltas.DELTA)).collect()} == want


def test_stream_goes_on_after_a_stop(spark, spoken, tmp_path):
    want, rows = spoken
    rows = [tuple(r) for r in rows]
    half = len(rows) // 2
    streamed(spark, rows[:half], str(tmp_path), 1, 1, late="1 day", keep_ms=10**9)()
    streamed(spark, rows[half:], str(tmp_path), 1, 1, late="1 day", keep_ms=10**9)()
    assert {(r.conv_id, r.msg): r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_state_goes_after_its_time(spark, tmp_path):
    at = lambda s: __import__("datetime").datetime.fromtimestamp(1_700_000_000 + s)
    first = [(1, 1, 0, "never ", False, at(0)), (2, 1, 0, "whole", True, at(0))]
    later = [[(3, k, 0, "x", True, at(4000 * k))] for k in range(1, 4)]
    for rows in [first, *later, [(1, 1, 1, "ends", True, at(16_000))]]:
        streamed(spark, rows, str(tmp_path), 1, 1, late="1 second", keep_ms=1_000_000)()
    out = {(r.conv_id, r.msg): r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {(2, 1): "whole", (3, 1): "x", (3, 2): "x", (3, 3): "x"}  # the first delta of (1, 1) had gone


def test_no_nested_loops_in_place_queries(spark, sf_dir):
    for name in ("formula_in_chunk", "formulas_per_chunk", "phrase_documents", "citation_theta", "knn_per_label_topk", "knn_documents"):
        shown = plan(catalog.QUERIES[name](spark, sf_dir))
        assert "NestedLoop" not in shown and "Cartesian" not in shown, name


def test_whole_messages_leave_no_state():
    class State:
        def __init__(self, calls):
            self.calls = calls

        def __getattr__(self, name):
            return lambda *a, **k: self.calls.append(name) or (self if name.startswith("get") else [] if name == "listTimers" else None)

    calls = []
    one = deltas.Accumulator(1000)
    one.init(State(calls))
    calls.clear()
    at = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"seq": [1, 0, 1, 2], "delta": ["b", "a", "b", "c"], "last": [False, False, False, True], "at": [at] * 4})
    (made,) = one.handleInputRows((1, 2), iter([rows[:2], rows[2:]]), None)
    assert made.to_dict("records") == [{"conv_id": 1, "msg": 2, "text": "abc", "n_deltas": 3, "at": at}] and calls == ["exists"]
    assert list(one.handleInputRows((1, 3), iter([rows[:3]]), None)) == [] and calls.count("updateValue") == 2 and "registerTimer" in calls


@pytest.mark.parametrize("few", [0, 1000])
def test_phrases_by_both_ways(spark, few):
    r = random.Random(9)
    some = lambda k: "".join(r.choices("abcé d", k=k))
    rows = [(i, some(r.randint(0, 60))) for i in range(80)] + [(80, None), (0, "abc again"), (None, "abcd")]
    names = [some(r.randint(1, 9)) for _ in range(200)] + ["", None, "abc", "abc"]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(names)), "phrase_id long, phrase string")
    found = phrases.held(docs, wanted, few=few)
    assert sorted(map(tuple, found.collect())) == sorted({(p, i) for p, n in enumerate(names) for i, t in rows if n and t and i is not None and n in t})
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == (1 if few else 0)


@pytest.mark.parametrize("q,window,sliced", [(1, 16, 40), (3, 7, 1), (4, 1 << 18, 1 << 20), (12, 64, 200)])
def test_phrases_in_bytes_of_texts(monkeypatch, q, window, sliced):
    monkeypatch.setattr(phrases, "WINDOW", window)
    monkeypatch.setattr(phrases, "SLICE", sliced)
    r = random.Random(q)
    some = lambda k: "".join(r.choices("ab\U0001f600é d", k=k))
    texts = [some(r.randint(0, 70)) for _ in range(120)] + ["", None, "a" * 300, "b" * 299 + "a", "ends in th", "en no more", "\0a\0\0b"]
    names = sorted({some(r.randint(1, 25)) for _ in range(150)} | {"a" * k for k in range(1, 120)} | {"b" * 200, "ends in then", "then", "th", "\0\0b", "a\0", texts[3] or "d"})
    finder = phrases.Finder([n.encode() for n in names], q)
    keys = pa.array([None, *map(str, range(1, len(texts)))])
    batch = pa.RecordBatch.from_arrays([keys, pa.array(texts, pa.string())], ["__key", "__text"])
    found = [(k, names[n]) for b in finder.batches(iter([batch.slice(0, 50), batch.slice(50), batch.slice(0, 0)])) for k, n in zip(*(c.to_pylist() for c in b.columns))]
    want = [(k, n) for k, t in zip(keys.to_pylist(), texts) for n in names if t and n in t]
    assert sorted(found, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("few,size", [(0, 1 << 24), (1000, 1 << 24), (1000, 3)])
def test_every_row_meets_its_phrases(spark, monkeypatch, few, size):
    monkeypatch.setattr(phrases, "FEW_BYTES", size)
    rows = [(1, "red fox"), (1, "red fox"), (1, "red"), (None, "a fox"), (None, "fox fox"), (2, None), (3, ""), (4, "é fox")]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("r", "red"), ("f", "fox"), ("g", "fox"), ("n", None)], "phrase_id string, phrase string")
    found = phrases.matches(docs, wanted, few=few)
    want = [(p, i) for p, w in (("r", "red"), ("f", "fox"), ("g", "fox")) for i, t in rows if t and w in t]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert ("mapInArrow" in plan(found) or "MapInArrow" in plan(found)) == (few > 0 and size > 3)


def test_phrase_documents_counts_rows_and_cuts_no_text(spark, tmp_path):
    docs = [(5, "The İstanbul paper"), (5, "the paper"), (None, "Paper then"), (7, None), (8, ""), (3, "\u212aelvin's other; papers" + " x" * 5000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the istanbul PAPER of kelvin"), (2, "\u212aelv İst absent"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = catalog.QUERIES["phrase_documents"](spark, str(tmp_path))
    assert "xxhash64" not in found._jdf.queryExecution().optimizedPlan().toString()  # no text is cut into grams
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(catalog.ORACLE_SQL["phrase_documents"]).fetchall())
