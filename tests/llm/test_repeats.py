"""Byte and word repeats, and nearest neighbours, against plain versions."""

import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from cases import frame, rows, sf

from tradewire.llm import neighbours, substring, suffix
from tradewire.llm.common import NULL_ID


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def in_order(spark, data):
    """(doc_id, text) in the order the operators take: id, null last, then the hash, then equal rows."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(r[0], r[1]) for r in data], "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    return [(r[0], r[1]) for r in sorted(df.collect(), key=lambda r: (NULL_ID if r[0] is None else r[0], r[2]))]


def plain(spark, data, how, raw):
    docs = in_order(spark, data)
    out = how([((i, d), (t or "").encode() if raw else t) for i, (d, t) in enumerate(docs)])
    return sorted(((k[1], *rest) for k, *rest in out), key=repr)


def mixed(seed, n, length):
    r = random.Random(seed)
    lines = ["".join(r.choice("abcdé ") for _ in range(r.choice([30, 90, 99, 100, 101, 160, 300]))) for _ in range(12)]
    out = []
    for i in range(n):
        parts = [r.choice(lines) if r.random() < 0.6 else "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, length))) for _ in range(r.randint(0, 6))]
        out.append((r.randint(-3, n), "".join(parts)))
    return out


def test_byte_repeats_on_cases(spark):
    assert got(suffix.repeats(frame(spark))) == plain(spark, rows(), brute.byte_repeats, True)
    assert suffix.repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("hot", "largest", "block"), [(1 << 16, 1 << 16, 1 << 20), (3, 70, 1000), (1 << 16, 70, 99)])
def test_byte_repeats_random(spark, hot, largest, block, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 1500)
    data = [*mixed(1, 120, 200), (500, "z" * 700), (501, "ab" * 500), (502, "y" * 99), (503, "b" + "z" * 300)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert got(suffix.repeats(df, hot=hot, batch=64, largest=largest, block=block)) == plain(spark, data, brute.byte_repeats, True)


@pytest.mark.parametrize("block", [1 << 20, 7, 1])
def test_column_construction(block, tmp_path):
    r = random.Random(4)
    for _ in range(60):
        strings = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 20))]
        size = np.array([len(s) for s in strings])
        data = np.frombuffer(b"".join(strings), np.uint8)
        c = suffix.Columns(data, np.cumsum(size) - size, size, str(tmp_path), block)
        every = sorted(((s[i:], j), s[i - 1] + 1 if i else 0) for j, s in enumerate(strings) for i in range(len(s) + 1))

        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        bwt, lcp = c.read()
        assert bwt.tolist() == [x for _, x in every]
        assert lcp.tolist() == [0] + [common(a[0][0], b[0][0]) for a, b in zip(every, every[1:])]


def test_byte_repeats_on_table(spark):
    docs = spark.read.parquet(sf("sf0.001") + "/documents.parquet").select("doc_id", "text")
    want = plain(spark, [tuple(r) for r in docs.collect()], brute.byte_repeats, True)
    assert got(suffix.op2(spark, sf("sf0.001"))) == want and any(x[2] for x in want)


def test_word_repeats_on_cases(spark):
    assert got(substring.repeats(frame(spark))) == plain(spark, rows(), brute.word_repeats, False)
    assert substring.repeats(frame(spark, [])).count() == 0


def test_word_repeats_random(spark, monkeypatch):
    monkeypatch.setattr(substring, "PIECE", 300)
    r = random.Random(8)
    words = [f"w{i}" for i in range(5)] + ["é", "　x"]
    passages = [" ".join(r.choice(words) for _ in range(r.choice([19, 20, 21, 40]))) for _ in range(8)]
    data = [(r.randint(0, 60), "  ".join(r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 5)))) for _ in range(150)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert got(substring.repeats(df)) == plain(spark, data, brute.word_repeats, False)
    assert got(substring.repeats(df, cells_a_byte=0.0001, hot=3, batch=30, largest=40)) == plain(spark, data, brute.word_repeats, False)


def test_word_repeats_on_table(spark):
    docs = spark.read.parquet(sf("sf0.01") + "/documents.parquet").select("doc_id", "text")
    want = plain(spark, [tuple(r) for r in docs.collect()], brute.word_repeats, False)
    assert got(substring.op3(spark, sf("sf0.01"))) == want and any(x[2] for x in want)


def nearest(data, k=5):
    ok = [(i, np.array(v, np.float64)) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % 50 == 0:
            s = neighbours.cosines(v, m)
            order = np.lexsort((ids, -s))
            out[i] = [(int(ids[j]), float(s[j])) for j in order if ids[j] != i][:k]
    return out


def test_neighbours_on_table(spark):
    data = [tuple(r) for r in spark.read.parquet(sf("sf0.1") + "/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = nearest(data)
    found = {}
    for r in neighbours.op10(spark, sf("sf0.1")).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == set(want) and all(sorted(x) == [1, 2, 3, 4, 5] for x in found.values())
    recall = sum(len({v for v, _ in found[q].values()} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.9, recall
    exact = dict(data)
    for q, near in found.items():
        for v, s in near.values():
            a, b = np.array(exact[q], float), np.array(exact[v], float)
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_neighbours_on_cases(spark):
    r = random.Random(2)
    data = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(130)]
    data += [(1000 + i, [1.0] * 8) for i in range(40)] + [(50000, [1.0] * 8), (1950, None), (2000, []), (2050, [0.0] * 8), (2100, [float("nan")] + [1.0] * 7), (2150, [None] + [1.0] * 7), (2200, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (2250, [1.0, 2.0]), (3, [1.0] * 8)]
    data.append(data[0])
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<double>, key int, v string")
    from pyspark.sql import functions as F

    found = {}
    for x in neighbours.search(df, F.col("id") % 50 == 0).collect():
        found.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    assert set(found) == {0, 50, 100, 1000, 50000}
    assert [v for _, v in sorted(found[1000])] == [3, 1001, 1002, 1003, 1004] and [v for _, v in sorted(found[50000])] == [3, 1000, 1001, 1002, 1003]
    assert neighbours.search(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert [tuple(x)[:3] for x in neighbours.search(df.filter("vec_id in (0, 1)").dropDuplicates(["vec_id"]), F.col("id") % 50 == 0).collect()] == [(0, 1, 1)]


def test_neighbours_ties_and_few_in_a_list(spark):
    from pyspark.sql import functions as F

    r = random.Random(6)
    base = [r.gauss(0, 1) for _ in range(16)]
    data = [(i, [x * 2.0 ** (i % 37 - 18) for x in base]) for i in range(40)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = sorted(tuple(x)[:3] for x in neighbours.search(df, F.col("id") % 50 == 0).collect())
    assert found == [(0, i, i) for i in range(1, 6)]
    # Ties across lists' blocks, behind nearer ones, and more of them than are compared at once.
    data = [(i, [1.0, 0.0, 0.0, 0.0]) for i in (0, 900)] + [(i, [2.0 ** (i % 50 - 25), 2.0 ** (i % 50 - 25) * 0.5, 0.0, 0.0]) for i in range(1, 700)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(tuple(x)[:3] for x in neighbours.search(df, F.col("id") == 0).collect()) == [(0, 1, 900), (0, 2, 1), (0, 3, 2), (0, 4, 3), (0, 5, 4)]
    # One list for each vector, one probe: the probes grow until five are found.
    data = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    out = neighbours.search(df, F.col("id") % 50 == 0, lists=60, probes=1).groupBy("query_id").count().collect()
    assert sorted(map(tuple, out)) == [(0, 5), (50, 5)]


@pytest.mark.parametrize("n", [1, 7, 211])
def test_units_have_tasks_of_their_own(spark, n):
    from pyspark.sql import functions as F

    from tradewire.llm.common import key_of_partition

    df = spark.range(n).select(F.col("id"), key_of_partition(F.col("id")).alias("k"))
    assert not df.filter(F.pmod(F.hash("k"), F.lit(n)) != F.col("id")).count() and df.select("k").distinct().count() == n


def test_pieces_of_sorted_cells(monkeypatch):
    r = np.random.default_rng(2)
    for each, sizes in ((1 << 18, [5, 0, 9]), (7, [40, 0, 1, 60]), (3, [0, 0]), (4, [30])):
        cells = [np.unique(r.integers(0, 90, n).astype(np.uint64)) for n in sizes]
        counts = [r.integers(1, 9, len(c)).astype(np.uint32) for c in cells]
        want: dict[int, int] = {}
        for c, n in zip(cells, counts, strict=True):
            for x, k in zip(c.tolist(), n.tolist(), strict=True):
                want[x] = want.get(x, 0) + k
        found, back = [], [np.zeros(len(c), np.uint64) for c in cells]
        for every, which, own in substring.pieces(cells, each):
            found += zip(every.tolist(), substring.summed(which, counts, own).tolist(), strict=True)
            substring.put(back, own, every[which])
        assert found == sorted(want.items()) and all((a == b).all() for a, b in zip(back, cells, strict=True))


def test_memory_of_a_unit():
    """The windows of a text take seventeen times its bytes at most while a unit is made and counted."""
    r = random.Random(6)
    texts = [" ".join(f"{r.getrandbits(22):x}" for _ in range(9000)) for _ in range(100)]
    t = pa.table({"bucket": pa.array([1] * 100, pa.int32()), "id": list(range(100)), "k2": list(range(100)), "text": texts})
    substring.touched(substring.Unit(t.slice(0, 1), 20), 1 << 26)  # tables of powers are made once
    tracemalloc.start()
    try:
        found = substring.touched(substring.Unit(t, 20), 1 << 26)[0]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) > 1_500_000 and most < 17 * sum(map(len, texts))
