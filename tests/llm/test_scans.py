"""Secrets, decontamination, sharding, SimHash, BPE and language identification against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from cases import frame, rows, sf
from pyspark.sql import functions as F

from tradewire.llm import bpe, decontaminate, language, secrets, shards, simhash


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_secrets_on_cases(spark):
    want = sorted(((r[0], *brute.secrets(r[1])) for r in rows()), key=repr)
    assert got(secrets.scan(frame(spark)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    assert secrets.scan(frame(spark, [])).count() == 0


def test_secrets_on_table(spark):
    docs = spark.read.parquet(sf("sf0.01") + "/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((r[0], *brute.secrets(r[1])) for r in docs), key=repr)
    assert got(secrets.op4(spark, sf("sf0.01")), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    assert any(x[1] for x in want)


def test_secrets_random_text():
    r = random.Random(3)
    bits = ["token", "Secret", "=", ":", " ", '"', "'", "AKIA", "api_key", "APIKEY", "0123456789abcdef", "abc", "password", "é", "ſecret", "K", "f" * 20, "ABC", ".", "ghp_"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 30)))
        found = [x for x in secrets.spans(text.encode()) if x[1] in secrets.KINDS[:3]]
        assert brute.sha(",".join(f"{k}:{s}:{e}" for s, k, e in found)) == brute.secrets(text)[3], text


def test_checksums_and_masks():
    body = b"A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = b"ghp_" + body + secrets.checksum(body)
    bad = good[:-1] + (b"a" if good[-1:] != b"a" else b"b")
    assert [k for _, k, _ in secrets.spans(b"see " + good + b" npm_" + good[4:])] == ["ghp", "npm"]
    assert secrets.spans(bad) == []
    assert secrets.redact(b"x token=abcdefgh y") == b"x [assign] y"


def test_contamination(spark):
    items = [(1, "the quick brown fox jumps over the lazy dog and runs along"), (2, "Once More"), (3, None), (4, ""), (5, "1 2"), (11, "word1 lan1 s word2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contamination([r[:2] for r in rows()], items), key=repr)
    columns = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    assert got(decontaminate.contamination(frame(spark), bench), *columns) == want
    assert got(decontaminate.contamination(frame(spark), bench, segment_bytes=100, block_bytes=150), *columns) == want
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0
    assert got(decontaminate.contamination(frame(spark), bench.limit(0)).filter("contaminated"), "doc_id") == []


def test_items_without_id(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(None, line), (7, line + " end"), (7, "one two"), (None, "one two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, line), (2, "x " + line + " end"), (3, "one two"), (None, None)], "doc_id long, text string")
    out = {r["doc_id"]: tuple(r)[1:4] for r in decontaminate.contamination(docs, bench).collect()}
    assert out == {1: (10, 10, 1), 2: (12, 11, 1), 3: (2, 2, 1), None: (0, 0, 0)}
    only = decontaminate.contamination(docs, bench.filter("item_id is null")).filter("contaminated").orderBy("doc_id").select("doc_id", "n_hit", "n_items").collect()
    assert [tuple(r) for r in only] == [(1, 10, 0), (2, 10, 0), (3, 2, 0)]
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()] == [None]


def test_varied_length_numbers():
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(0, 1 << b, 50) for b in (1, 7, 8, 14, 21, 28, 34)]).astype(np.int64)
    data, size = decontaminate.packed(x)
    assert decontaminate.unpacked(data).tolist() == x.tolist() and int(size.sum()) == len(data)


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta very epsilon zeta eta theta iota kappa"), (2, "kappa alpha"), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "doc_id long, text string")
    out = decontaminate.contamination(docs, bench).orderBy("doc_id").select("n_hit", "n_near").collect()
    assert [tuple(r) for r in out] == [(0, 1), (0, 0), (10, 1)]


def plain_loads(sizes, n):
    """Each group, the largest first, to the least loaded shard."""
    loads = [0] * n
    for x in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += x
    return sorted(loads)


def test_runs_as_item_by_item():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 12)
        runs = sorted({(r.randint(1, 60), r.choice([1, 2, 5, 40, 300])) for _ in range(r.randint(1, 8))}, reverse=True)
        loads = [0] * n
        for (size, count), ends in zip(runs, shards.schedule(runs, n), strict=True):
            taken = [0] * n
            for _ in range(count):
                k = loads.index(min(loads))
                loads[k] += size
                taken[k] += 1
            assert [b - a for a, b in zip(ends, ends[1:])] == taken


@pytest.mark.parametrize(("where", "n", "few"), [("cases", 5, 1 << 20), ("cases", 3, 0), ("table", 40, 1 << 20)])
def test_shards(spark, where, n, few):
    df = frame(spark) if where == "cases" else spark.read.parquet(sf("sf0.01") + "/documents.parquet")
    texts = Counter((r["doc_id"], r["text"]) for r in df.collect())
    out = (shards.assign(df, shards=n, few=few) if where == "cases" else shards.op7(spark, sf("sf0.01"))).collect()
    size = lambda t: len((t or "").encode()) + 16
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sum((Counter({(d, size(t), crc(t)): k}) for (d, t), k in texts.items()), Counter())
    by, load, place, groups = defaultdict(list), Counter(), defaultdict(set), Counter()
    for r in out:
        by[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        place[r["doc_id"], r["text_crc32"]].add(r["shard"])
    for (_, t), k in texts.items():
        groups[t] += size(t) * k
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(n))
    assert sorted(load[k] for k in range(n)) == plain_loads(groups.values(), n)
    together = defaultdict(set)
    for d, t in texts:
        together[t] |= place[d, crc(t)]
    assert all(len(x) == 1 for t, x in together.items() if t)


def test_shards_of_nothing(spark):
    assert shards.assign(frame(spark, [])).count() == 0


def test_simhash(spark):
    want = [(r[0], brute.simhash(r[1])) for r in rows()]
    component = brute.components(want)
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(want, component)), key=repr)
    assert got(simhash.near_duplicates(frame(spark)), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_simhash_on_table(spark):
    docs = spark.read.parquet(sf("sf0.01") + "/documents.parquet").select("doc_id", "text").collect()
    want = [(r[0], brute.simhash(r[1])) for r in docs]
    component = brute.components(want)
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(want, component)), key=repr)
    assert got(simhash.op8(spark, sf("sf0.01")), "doc_id", "fingerprint", "component_id") == want


def test_simhash_links_random(spark, monkeypatch):
    import numpy as np

    r = random.Random(5)
    fps = set()
    for _ in range(60):
        c = r.getrandbits(64)
        for _ in range(12):
            x = c
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
            c = x if r.random() < 0.3 else c
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    pairs = [(i, x) for i, x in enumerate(fps)]
    want = brute.components(pairs)
    found = simhash.components(simhash.links(df)).collect()
    groups = defaultdict(set)
    root = {int(np.int64(x["node"]).view(np.uint64)): int(np.int64(x["root"]).view(np.uint64)) for x in found}
    for i, x in enumerate(fps):
        groups[root.get(x, x)].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(j for j in range(len(fps)) if want[j] == w) for w in set(want))
    # Large buckets are cut further.
    base = r.getrandbits(32)
    own = np.array(sorted({base | (r.getrandbits(8) << 34) | (r.getrandbits(8) << 50) for _ in range(700)}), np.uint64)
    monkeypatch.setattr(simhash, "SMALL", 16)
    cut = simhash.near_groups(own, 3, 32, 32)
    monkeypatch.setattr(simhash, "SMALL", 4096)
    whole = simhash.compare(own, 3)

    def parts(edges):
        up = {int(x): int(x) for x in own}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[root(int(a))] = root(int(b))
        out = defaultdict(set)
        for x in up:
            out[root(x)].add(x)
        return sorted(map(sorted, out.values()))

    assert parts(cut) == parts(whole)


PATH, PATTERN = None, None


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe(spark, vocabulary):
    path, pattern = vocabulary
    enc = bpe.tokenizer(path, pattern)
    want = []
    for r in rows():
        ids = enc.encode_ordinary(r[1] or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((r[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    for spread, overlap in ((1 << 15, 256), (300, 40), (1000, 17)):
        out = bpe.tokenize(frame(spark), path, pattern, spread=spread, overlap=overlap, digests=True)
        assert got(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr), spread
    assert bpe.tokenize(frame(spark, []), path, pattern).count() == 0


def test_bpe_pieces_random(vocabulary):
    path, pattern = vocabulary
    r = random.Random(9)
    bits = ["a", "bc", "'s", "'re", "'", "''", " ", "  ", "\n", "\t ", "12", "é", "漢", "!?", "...", " 　", "'r", "'v", "ll", "😀"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 120)))
        assert bpe.encode(text, path, pattern, chunk=r.choice([20, 33]), overlap=r.choice([9, 15])).tolist() == bpe.encode_piece(text, path, pattern).tolist(), text


def test_bpe_on_table(spark, vocabulary):
    enc = bpe.tokenizer(*vocabulary)
    want = []
    for i, t in spark.read.parquet(sf("sf0.01") + "/documents.parquet").select("doc_id", "text").collect():
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got(bpe.op1(spark, sf("sf0.01")), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_bpe_patterns_say_how_far_they_look(spark, vocabulary):
    path, _ = vocabulary
    words = r"\w+|\W"
    with pytest.raises(ValueError, match="look ahead"):
        bpe.tokenize(frame(spark), path, words)
    assert bpe.encode("ab cd " * 900, path, words, ahead=1).tolist() == bpe.encode_piece("ab cd " * 900, path, words).tolist()


def test_language(spark):
    out = language.op6(spark, sf("sf0.01")).join(spark.read.parquet(sf("sf0.01") + "/documents.parquet"), "doc_id")
    r = out.filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.95 and 0 <= r[1] <= r[2] <= 1
    docs = frame(spark)
    model = language.learn(docs)
    found = language.predict(docs, model, ["doc_id", "text"]).collect()
    assert len(found) == len(rows())
    assert {x["lang_pred"] for x in found if x["text"] in (None, "", " \t\n", "1 2 3")} == {"und"}
    assert {x["lang_pred"] for x in language.predict(docs, language.learn(docs.limit(0)), ["doc_id"]).collect()} == {"und"}
    assert language.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def plain_language(data, dimensions=1024):
    """(lang, score) of each (doc_id, text, lang), one n-gram after another."""

    def bundle(text):
        c = [0]
        for x in (text or "").lower():
            if x.isalpha():
                c.append(ord(x))
            elif c[-1]:
                c.append(0)
        c += [0] if c[-1] else []
        grams = Counter(zip(c, c[1:], c[2:]))
        v = np.zeros(dimensions)
        for g, n in grams.items():
            v += n * np.prod([np.roll(language.letter_vector(x, dimensions), k) for k, x in enumerate(g)], axis=0)
        return v, np.sqrt(sum(n * n for n in grams.values()))

    made = [bundle(t) for _, t, _ in data]
    unit = lambda x: x / (np.linalg.norm(x) or 1)
    total = {}
    for (i, t, lang), (v, size) in zip(data, made):
        if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
            total[lang] = total.get(lang, 0) + v / (size or 1)
    labels = sorted(total)
    proto = [unit(total[x]) for x in labels]
    mean = np.mean(proto, axis=0)
    proto = [unit(x - mean) for x in proto]
    out = []
    for (v, size), (_, t, _) in zip(made, data):
        near = [float(unit(v) @ p) for p in proto]
        k = int(np.argmax(near))
        out.append((labels[k], min(1, max(0, near[k]))) if size else ("und", 0.0))
    return out


def test_language_as_plain(spark):
    data = [tuple(x) for x in spark.read.parquet(sf("sf0.001") + "/documents.parquet").select("doc_id", "text", "lang").collect()]
    data += [(900001, None, "en"), (900002, "12 34", None), (900003, "", "de"), (900004, "É", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    found = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.predict(df, language.learn(df), ["doc_id"]).collect()}
    for (i, *_), (lang, score) in zip(data, plain_language(data)):
        assert abs(found[i][1] - score) < 1e-4 and (found[i][0] == lang or score < 1e-4), i
