"""Collocations, vector codes and sharding against brute force on small tables with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ostraka.llm import phrases, sharding, vectorcodes

DOCS = "doc_id long, text string, lang string, word string, hi long, block long, rank int, __draws string"


def brute_collocations(rows, least, longest, top, cover, scale):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = collections.defaultdict(list)
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, words), a in cands.items():
        inside = lambda long: any(long[i : i + len(words)] == words for i in range(len(long) - len(words) + 1))
        if any(lg == lang and len(w) > len(words) and inside(w) and 100 * b >= cover * a for (lg, w), b in cands.items()):
            continue
        score, _, left, right = min((scale * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, all_ in found.items() for rank, (s, a, p, x, y) in enumerate(sorted(all_)[:top], 1))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    zipf = lambda: f"w{min(40, int(1 / (rng.random() + 0.02)))}"
    rows = []
    for i in range(160):
        words = [zipf() for _ in range(rng.randrange(60))]
        for at in range(0, len(words), 9):
            words[at:at] = rng.choice([["New", "York", "City", "hall"], ["new\tyork"], ["é\x01x", "é"], ["end.", "Of,", "it"], ["a" * 300, "ÀB"], ["x\x0by"], []])
        rows.append((i, rng.choice([" ", "  ", " \t"]).join(words), rng.choice(["en", "en", "fr", None, "und"]), "w", 1, 2, 3, "d"))
    rows += [rows[0]] * 5 + [(None, None, "en", None, None, None, None, None), (1, "", None, None, None, None, None, None), (2, " .,;:!? \n", "zz", None, None, None, None, None), (3, "tick tock " * 3000, "en", None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("longest,block,top", [(4, 1 << 25, 2000), (4, 900, 7), (3, 5000, 2000), (2, 900, 5)])
def test_collocations(spark, texts, longest, block, top):
    found = phrases.collocations(spark.createDataFrame(texts, DOCS), least=6, longest=longest, top=top, block_bytes=block)
    assert sorted(map(tuple, found.collect())) == brute_collocations([(r[2], r[1]) for r in texts], 6, longest, top, 80, 2_000_000)


def test_collocations_of_nothing(spark, texts):
    df = spark.createDataFrame(texts, DOCS)
    assert phrases.collocations(df.limit(0)).collect() == []
    assert phrases.collocations(df.where("text = '' or text is null")).collect() == []
    assert phrases.collocations(df, least=10**6).collect() == []
    with pytest.raises(ValueError):
        phrases.collocations(df, longest=5)


@pytest.mark.parametrize("most", [1, 10, 1 << 20])
def test_runs_over_batches(most, monkeypatch):
    monkeypatch.setattr(phrases.Members.__init__, "__defaults__", (most,))
    rng = random.Random(9)
    for least in (1, 3, 8):
        for keys in (("hi",), ("hi", "lo")):
            rows = sorted((rng.choice([1, 1, 1, 2, 3, 9]), rng.randrange(2) if len(keys) > 1 else 0, rng.randrange(1, 4), rng.randrange(50)) for _ in range(60))
            total, blocks = collections.Counter(), collections.Counter()
            for *key, n, block in rows:
                total[tuple(key)] += n
                blocks[(*key, block)] += 1
            for size in (1, 2, 7, 100):
                batches = [pa.RecordBatch.from_pydict(dict(zip(("hi", "lo", "n", "block"), map(pa.array, zip(*rows[i : i + size]))))) for i in range(0, len(rows), size)]
                f, members = {}, collections.Counter()
                for out in phrases.run_lengths(keys, least, len(keys) == 1)(iter(batches)):
                    columns = {k: pa.array(v).to_pylist() for k, v in out.items()}
                    for i, count in enumerate(columns["f"]):
                        if count is None:
                            members.update((int(k), 0, columns["block"][i]) for k in np.frombuffer(columns["members"][i], np.int64))
                        else:
                            key = (columns["hi"][i], columns["lo"][i] if len(keys) > 1 else 0)
                            assert key not in f
                            f[key] = count
                assert f == {k: v for k, v in total.items() if v >= least}
                assert members == ({k: v for k, v in blocks.items() if k[:2] in f} if len(keys) == 1 else {})


def brute_codes(rows, parts, entries, rounds):
    """rows: (id, vector, label). Plain Python integers."""
    size = collections.Counter(len(v) for _, v, _ in rows if v is not None).most_common(1)[0][0]
    kept = [(i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    raw = {id(k): v for k, v in zip(kept, [v for _, v, _ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)])}
    step = size // parts
    split = [[k[1][p * step : (p + 1) * step] for p in range(parts)] for k in kept]
    first = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, raw[id(kept[j])]))[:entries]
    books = [[list(split[j][p]) for j in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for s in split:
                groups[near(s[p], books[p])[1]].append(s[p])
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for (i, _, label), s in zip(kept, split):
        best = [near(s[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    sums = collections.Counter()
    for _, _, e, label in out:
        sums[label] += e
    most = 2**63 - 1
    return sorted(((str(i), c, min(e, most), min(sums[label], most), sha) for i, c, e, label in out), key=str)


@pytest.mark.parametrize("wide", [1.0, 1e-3, 1e6, 1e30])
def test_vector_codes(spark, wide):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(120, 8)) * wide).astype(np.float32).tolist()
    vectors += [vectors[3]] * 15 + [[0.0] * 8] * 4 + [(np.round(np.array(v)) / 4).tolist() for v in vectors[:20]]
    rows = [(i * 3 % 101, v, (i % 5) or None) for i, v in enumerate(vectors)]
    rows += [(None, vectors[0], 9), (None, vectors[1], None), rows[2], rows[2], (7, None, 1), (8, [float("nan")] + [0.0] * 7, 1), (9, [None] + [0.0] * 7, 1), (10, [float("inf")] * 8, 1), (11, [1.0] * 4, 1), (12, [], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, __n long")
    found = vectorcodes.compress(df, parts=4, entries=16, rounds=3).collect()
    assert sorted(((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in found), key=str) == brute_codes(rows, 4, 16, 3)


def test_vector_codes_of_little(spark):
    df = spark.createDataFrame([(1, [0.5] * 8, 1), (2, [0.25] * 8, None)], "vec_id long, embedding array<double>, label int")
    assert [(r.vec_id, r.code, r.error) for r in sorted(vectorcodes.compress(df).collect())] == [(1, "00000000", 0), (2, "01010101", 0)]
    assert vectorcodes.compress(df.limit(0)).collect() == [] and vectorcodes.compress(df.where("vec_id = 9")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vectorcodes.compress(df, parts=3)


def test_screening_keeps_every_nearest_entry():
    rng = np.random.default_rng(6)
    for most in (3, 2000, 2**27):
        x, book = rng.integers(-most, most, (500, 16)), rng.integers(-most, most, (64, 16))
        book[10:20] = book[0]
        x[:50] = book[rng.integers(0, 64, 50)] + rng.integers(-1, 2, (50, 16))
        exact = ((x[:, None, :].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
        choice, best = vectorcodes.nearest(x, book)
        assert best.tolist() == exact.min(axis=1).tolist()
        assert choice.tolist() == [row.index(min(row)) for row in exact.tolist()]


def test_rare_and_hot_groups(spark):
    df = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 3 else f"g{i}", i) for i in range(300)], "i long, g string, v long")
    sums = collections.Counter()
    for r in df.collect():
        sums[r.g] += r.v
    for share in (1, 4, 1000):
        found = vectorcodes.total_by_group(df, "g", "v", "total", share).collect()
        assert sorted((r.i, r.total) for r in found) == sorted((r.i, sums[r.g]) for r in df.collect())


def brute_shard(key, weights):
    name = "" if key is None else str(key)
    draws = []
    for s, w in enumerate(weights):
        lot = int(hashlib.md5(f"{name}:{s}".encode()).hexdigest()[:13], 16)
        draws.append((math.log((lot + 1) / 16**13) / w if w else -math.inf, -s))
    return -max(draws)[1]


def test_sharding(spark, texts):
    weights = (1.0, 2.0, 0.0, 0.5, 1.0)
    df = spark.createDataFrame(texts * 3 + [(None, "x", None, None, None, None, None, None)] * 40 + [(5, None, None, None, None, None, None, None)] * 300, DOCS)
    found = sharding.sharded(df, weights=weights, added=2.0).collect()
    rows = df.select("doc_id", "text").collect()
    expected = [(str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), "key", brute_shard(r.doc_id, weights), brute_shard(r.doc_id, (*weights, 2.0))) for r in rows]
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found) == sorted(expected)
    assert all(r.grown_shard in (r.shard, len(weights)) for r in found) and not any(r.shard == 2 for r in found)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        sharding.draws(df.doc_id, [])


def test_shards_follow_their_weights(spark):
    n = 40_000
    found = collections.Counter(r.shard for r in sharding.sharded(spark.range(n).selectExpr("id as doc_id", "'x' as text"), weights=(1.0, 3.0, 4.0)).select("shard").collect())
    assert all(abs(found[s] / n - w / 8) < 0.01 for s, w in enumerate((1, 3, 4)))
