"""The pipeline's stages, each against a plain version of its decision."""

import gc
import os
import random
import time
import tracemalloc

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from cases import frame, rows, sf
from pyspark.sql import functions as F

from tradewire.llm import bpe, common, decontaminate, language, nearcopies, secrets, urls
from tradewire.llm.common import shared_folder


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies(spark):
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    data, family = [], {}
    for f in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 500))]
        for c in range(r.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(0 if c == 0 else r.randint(0, len(w) // 60)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            family[len(data)] = f
            data.append((len(data), " ".join(w)))
    for f in range(60, 90):
        family[len(data)] = f
        data.append((len(data), " ".join(r.choice(vocabulary) for _ in range(150)) + " " + passage))
    df = spark.createDataFrame(data, "doc_id long, text string")
    kept = {x["doc_id"] for x in nearcopies.keep_one(df).collect()}
    first = {}
    for i, f in family.items():
        first.setdefault(f, i)
    assert set(first.values()) <= kept
    extra = [i for i in kept - set(first.values()) if jaccard(data[i][1], data[first[family[i]]][1]) >= 0.8]
    assert not extra


def test_near_copies_on_cases(spark):
    df = frame(spark)
    kept = nearcopies.keep_one(df)
    assert kept.columns == df.columns
    out = kept.collect()
    ids = [x["doc_id"] for x in out]
    assert 0 in ids and 1 not in ids and 2 not in ids and -7 in ids and 3 not in ids and ids.count(7) == 1 and 4 not in ids and None not in ids
    assert nearcopies.keep_one(frame(spark, [])).count() == 0


def test_wide_sketch_counts():
    h = np.random.default_rng(1).integers(0, 1 << 63, 700).astype(np.uint64)
    assert nearcopies.bit_counts(h).tolist() == [int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]


def test_chunks_keep_first_members(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "CHUNK", 4)
    base = " ".join(f"w{i}" for i in range(300))
    data = [(i, base.replace("w150", f"x{i}")) for i in range(40)]
    assert [x["doc_id"] for x in nearcopies.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()] == [0]


def test_other_stages_on_cases(spark):
    df = frame(spark)
    spoken = language.keep_known(df, ((0, 0.0),))
    assert spoken.columns == df.columns and {x["text"] for x in spoken.collect()} == {r[1] for r in rows() if any(c.isalpha() for c in r[1] or "")}
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs along")], "item_id long, text string")
    clean = decontaminate.keep_clean(df, bench)
    want = [x[0] for x in brute.contamination([r[:2] for r in rows()], [(1, bench.first()["text"])]) if not x[5]]
    assert clean.columns == df.columns and sorted(map(str, (x["doc_id"] for x in clean.collect()))) == sorted(map(str, want))
    masked = secrets.mask(df)
    assert masked.count() == len(rows()) and masked.columns == df.columns
    assert not [x for x in masked.collect() if x["text"] and any(k in ("assign", "access", "hex") for _, k, _ in secrets.spans(x["text"].encode()))]
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, df.limit(0), sf("sf0.001")).count() == 0


def test_run(spark):
    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, sf("sf0.001")).collect()}
    docs = {x["doc_id"]: x for x in spark.read.parquet(sf("sf0.001") + "/documents.parquet").collect()}
    items = [tuple(x) for x in spark.read.parquet(sf("sf0.001") + "/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {x[0] for x in brute.contamination([(i, d["text"]) for i, d in docs.items()], items) if x[5]}
    copies = {i for i in docs for j in docs if j < i and docs[i]["text"] == docs[j]["text"]}
    assert not set(out) & (dirty | copies)
    lost = set(docs) - set(out) - dirty
    assert all(any(j != i and jaccard(docs[i]["text"], docs[j]["text"]) >= 0.8 for j in docs) for i in lost)
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    for i, x in out.items():
        text = secrets.redact(docs[i]["text"].encode()).decode()
        assert bpe.decode(np.frombuffer(x["ids"], "<u4"), path, pattern).decode() == text and x["n_tokens"] * 4 == len(x["ids"])


def url_log(spark, data):
    return spark.createDataFrame(data, "key string, on string, action string, page_id int")


def test_urls(spark):
    log = url_log(spark, [("a.com", "2024-01-05", "block", 1), ("a.com", "2024-02-01", "remove", 1), ("b.a.com", "2024-01-10", "allow", 1), ("a.com/x", "2024-01-01", "allow", 1), (None, "2024-01-01", "block", 1), ("a.com", None, "block", 1), ("c.org", "2024-01-05", "allow", 1), ("c.org", "2024-01-05", "block", 1), ("c.org/deep/er", "2024-01-06", "allow", 1), ("nobody.invalid", "2024-01-01", "block", 1)])
    captures = [(1, "http://a.com/", "2024-01-04", "none"), (2, "http://a.com/", "2024-01-05", "block"), (3, "https://U@A.com.:80?q", "2024-01-31", "block"), (4, "http://a.com", "2024-02-01", "none"), (5, "http://b.a.com/x/y", "2024-01-09", "block"), (6, "http://b.a.com/x/y", "2024-01-10", "allow"), (7, "http://a.com/x?z", "2024-01-20", "allow"), (8, None, "2024-01-20", "none"), (9, "", "2024-01-20", "none"), (10, "/rel", "2024-01-20", "none"), (11, "http://a.com/", None, "none"), (12, "http://c.org/", "2024-01-06", "block"), (12, "http://c.org/", "2024-01-06", "block"), (13, "http://b.a.com//x//y" + "/z" * 200000, "2024-01-10", "allow"), (14, "http://" + "h." * 100000 + "a.com/x", "2024-01-20", "block"), (15, "http://c.org/deep/er", "2024-01-20", "allow")]
    df = spark.createDataFrame([(*c, "k") for c in captures], "page_id int, url string, at string, want string, key string")
    got = sorted((x["id"], x["verdict"]) for x in urls.evaluate(df, log, "page_id", "url", "at").collect())
    assert got == sorted((c[0], c[3]) for c in captures)
    assert urls.evaluate(df.limit(0), log, "page_id", "url", "at").count() == 0
    assert {x["verdict"] for x in urls.evaluate(df, log.limit(0), "page_id", "url", "at").collect()} == {"none"}


def kept_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {x["doc_id"] for x in nearcopies.keep_one(df).collect()}


def test_short_near_copies(spark):
    r = random.Random(5)
    texts = []
    while len(texts) < 240:
        w = [f"w{r.randrange(5000)}" for _ in range(r.randint(8, 60))]
        more = max(1, (len(w) - 4) // 4)
        other = [*w, *(f"x{r.randrange(5000)}" for _ in range(more))]
        assert 0.8 <= jaccard(" ".join(w), " ".join(other)) < 0.9
        texts += [" ".join(w), " ".join(other)]
    assert kept_of(spark, texts) == set(range(0, 240, 2))


def test_repeated_lines_are_no_copies(spark):
    r = random.Random(9)
    texts = []
    for _ in range(20):
        line = [f"w{r.randrange(9000)}" for _ in range(12)] * 40
        texts += [" ".join([*(f"w{r.randrange(9000)}" for _ in range(100)), *line]) for _ in range(2)]
    # Near the limit, on both sides of which the sketch alone errs: 0.75 to 0.79.
    for _ in range(20):
        w = [f"w{r.randrange(9000)}" for _ in range(204)]
        while jaccard(" ".join(w), other := " ".join([*w[: 204 - (cut := r.randint(43, 50))]])) >= 0.8 or cut > 50:
            pass
        texts += [" ".join(w), other]
    assert kept_of(spark, texts) == set(range(len(texts)))


def test_copies_near_to_the_original_only(spark):
    r = random.Random(7)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    texts = [" ".join(base)]
    while len(texts) < 400:
        w = list(base)
        for _ in range(6):
            w[r.randrange(300)] = f"w{r.randrange(5000)}"
        if jaccard(" ".join(w), texts[0]) >= 0.8:
            texts.append(" ".join(w))
    assert kept_of(spark, texts) == {0}


def test_languages_that_were_not_learned_go(spark):
    docs = spark.read.parquet(sf("sf0.01") + "/documents.parquet").select("doc_id", "text", "lang").filter("lang is not null")
    long_ = docs.filter("size(array_distinct(split(text, ' '))) >= 100")
    r = random.Random(4)
    noise = spark.createDataFrame([(10**6 + i, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(300)), None) for i in range(40)], docs.schema)
    known = docs.filter("lang <> 'fr'").withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    kept = language.keep_known(known.unionByName(long_.filter("lang = 'fr'").withColumn("lang", F.lit(None).cast("string"))).unionByName(noise))
    out = {x["doc_id"] for x in kept.collect()}
    assert not {i for i in out if i >= 10**6}
    mine = {x["doc_id"]: x["lang"] for x in long_.collect()}
    own, other = [i for i, x in mine.items() if x != "fr"], [i for i, x in mine.items() if x == "fr"]
    assert set(own) <= out and sum(i in out for i in other) <= 0.3 * len(other)


def test_sets_are_compared_on_the_jvm(spark, monkeypatch):
    """Exactly at the similarity too; texts are gone over in small parts."""
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3, 4, 5]), ([1, 2, 3, 4], [1, 2, 3, 5]), ([], [1])], "x array<long>, y array<long>")
    assert [r[0] for r in df.select(nearcopies.similar(F.col("x"), F.col("y"), 0.8)).collect()] == [True, False, False]
    monkeypatch.setattr(nearcopies, "HELD", 100)
    words = [f"w{i}" for i in range(40)]
    data = [(i, " ".join([*words, f"x{i}"])) for i in range(6)] + [(6, None), (7, ""), (8, "another text altogether")]
    assert sorted(x["doc_id"] for x in nearcopies.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()) == [0, 6, 8]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_near_copies_leave_no_files(spark):
    """Of shuffles and stored tables only the groups stay, which the result is read from; texts are dealt once."""
    name, threshold = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.autoBroadcastJoinThreshold"
    before, tables, limit = shuffle_files(spark), set(os.listdir(shared_folder(spark))), spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        df = spark.createDataFrame([(i // 2, f"{' '.join(f'w{j}' for j in range(40))} x{i % 3}") for i in range(30)] + [(None, "alone")] * 2, "doc_id long, text string")
        kept = nearcopies.keep_one(df)
        end = time.time() + 20  # files go shortly after the job
        while shuffle_files(spark) - before and time.time() < end:
            time.sleep(0.2)
        assert not shuffle_files(spark) - before
        assert len([x for x in set(os.listdir(shared_folder(spark))) - tables if x.startswith("tradewire-")]) == 1
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(near copy key") == 2  # of the texts, and of the kept keys
        assert sorted((x["doc_id"] is None, x["doc_id"]) for x in kept.collect()) == [(False, 0), (True, None)]
        assert spark.conf.get(name) == "false"
    finally:
        spark.conf.set(threshold, limit)


def test_parts_leave_nothing_behind():
    """A part of the index is made in little memory, and no words stay until the garbage collector happens to run."""
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(60000)}" for _ in range(500)).encode() for _ in range(400)]
    ids = pa.array(range(len(texts)), pa.int64())
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        made = decontaminate.postings(0, ids, texts, 15)
        kept, peak = tracemalloc.get_traced_memory()
        assert not gc.collect()
    finally:
        tracemalloc.stop()
        gc.enable()
    assert made.num_rows > 50000 and kept < 3 * made.nbytes and peak < 100 * 500 * len(texts)


def test_workers_give_back(spark, monkeypatch):
    """At the end of a task; whole texts are encoded a few at a time."""
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and calls == [1]
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame([(1, "one text"), (None, None), (2, ""), (1, "another text"), (3, "x" * 500)], "doc_id long, text string")
    want = sorted(map(str, bpe.tokenize(df, path, pattern).collect()))
    monkeypatch.setattr(bpe, "SLICE", 10)
    got = bpe.tokenize(df, path, pattern)
    assert len(want) == 5 and sorted(map(str, got.collect())) == want
