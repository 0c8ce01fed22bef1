"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from ostraka.llm import ann, html, packing, pieces, quality, simhash, spans, suffix, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, rank string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(12)]
    texts = [*base, base[0], base[0] + " tail", "x " + base[1], base[2][:300] + words(rng, 60), None, "", "  \n ", "one", "a. b. c.", words(rng, 6000), "aaaa" * 200, "ab" * 300, "日本語 " * 90, base[3] + "\n" + base[3]]
    out = [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return [*out, (None, base[4], None, None, None, None, None), out[5], out[5], (None, None, None, None, None, None, None)]


def bytes_of(text):
    return (text or "").encode()


@pytest.mark.parametrize("crowd", [4096, 1])
def test_suffix_dedup(spark, rows, crowd):
    length, counts = 50, collections.Counter()
    for r in rows:
        b = bytes_of(r[1])
        counts.update(b[i : i + length] for i in range(len(b) - length + 1))
    expected = []
    for r in rows:
        b = bytes_of(r[1])
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        expected.append((str(r[0]), len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    found = suffix.remove_repeats(spark.createDataFrame(rows, DOCS), length=length, crowd=crowd).collect()
    assert sorted((str(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in found) == sorted(expected)


def test_suffix_order_is_right():
    rng = random.Random(1)
    for text in (b"", b"a", b"aaaaaa", b"mississippi", b"abababab", bytes(rng.randrange(3) for _ in range(500))):
        order = suffix.suffix_order(np.frombuffer(text, np.uint8), 600)
        assert order.tolist() == sorted(range(len(text)), key=lambda p: text[p:])


def naive_fp(text, n):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    grams = [b" ".join(parts[i : i + n]) for i in range(max(1, len(parts) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, rows):
    fps = [naive_fp(r[1], 4) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for k, r in zip(label, rows):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    expected = sorted((str(r[0]), f"{f:016x}", str(least.get(k))) for r, f, k in zip(rows, fps, label))
    found = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected


def test_simhash_trees(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64))
    points = np.unique(np.concatenate([base, near]))
    labels = np.arange(len(points))
    for i in range(len(points)):
        j = np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 4)
        labels = simhash.merged(labels, np.full(len(j), i), j)
    old = simhash.LEAF
    simhash.LEAF = 16
    try:
        assert simhash.linked(points, 4).tolist() == labels.tolist()
    finally:
        simhash.LEAF = old
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    got = simhash.links(df, 4, shard_size=32).collect()
    place = {int(x): i for i, x in enumerate(points.view(np.int64))}
    joined = simhash.merged(np.arange(len(points)), np.array([place[r.a] for r in got], int), np.array([place[r.b] for r in got], int))
    assert joined.tolist() == labels.tolist()


@pytest.mark.parametrize("reach,size,near", [(4, 16, True), (7, 64, False), (7, 32, True), (1, 32, True), (0, 16, False)])
def test_simhash_links_in_split_buckets(spark, reach, size, near):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    if near:  # all but sixteen bits agree: every bucket is large
        base = base & np.uint64(0xFFFF) | np.uint64(0xABCDEF0000000000)
    moved = base[:150].copy()
    for _ in range(reach):
        moved ^= np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)
    points = np.unique(np.concatenate([base, moved]))
    labels = np.arange(len(points))
    for i in range(len(points)):
        j = np.flatnonzero(np.bitwise_count(points ^ points[i]) <= reach)
        labels = simhash.merged(labels, np.full(len(j), i), j)
    place = {int(x): i for i, x in enumerate(points.view(np.int64))}
    got = simhash.links(spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long"), reach, shard_size=size).collect()
    assert simhash.merged(np.arange(len(points)), np.array([place[r.a] for r in got], int), np.array([place[r.b] for r in got], int)).tolist() == labels.tolist()


@pytest.mark.parametrize("reach", [4, 7])
def test_simhash_shards_are_bounded(spark, reach):
    values = spark.range(1 << 18).selectExpr("xxhash64(id) as fp")
    sizes = [r["count"] for r in simhash.buckets(values, reach, 2048).groupBy("shard").count().collect()]
    assert sum(sizes) == (reach + 1) << 18 and max(sizes) < 6 * 2048


def test_keep_one_of_each_group(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    kept = simhash.keep_one(df).collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    assert len(ids) == len(set(ids)) and 0 in ids and 12 not in ids and 13 not in ids and 14 not in ids and {3, 4, 6, 7} <= set(ids)
    assert kept[0].asDict().keys() == set(df.columns)


def test_packing(spark, rows):
    path, room = public_tokenizers.path("word_bpe_49k.json"), 64
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    found = packing.pack(spark.createDataFrame(rows, DOCS), path, capacity=room).collect()
    expected = []
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(str(r[0]), p, lo, len(ids[lo : lo + room]), zlib.crc32(ids[lo : lo + room].tobytes())) for p, lo in enumerate(range(0, len(ids), room))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= room


def test_word_ids_are_the_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    known = packing.Words(path)
    for text in ("It's we'll DON'T 're", "Éçole, œuvre! ſtraße İstanbul", "a\u0301 b\u00a0c\u0085d", "x<|endoftext|>y", "1²3½ 42_7 --__--'s", "tab\tnew\nline\x1cend", "日本語 😀", "ŉ Å ª º µ"):
        assert known.ids([text]) == known.whole([text]) == [np.array(known.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()], text


def test_plan_is_whole_and_near_the_bound():
    rng = np.random.default_rng(2)
    counts = np.zeros(4097, np.int64)
    np.add.at(counts, np.clip(rng.lognormal(6.5, 1.0, 20000).astype(int), 1, 4096), 1)
    bins = packing.plan(counts, 4096)
    packed = np.zeros(4097, np.int64)
    for pattern, n in bins:
        assert sum(pattern) <= 4096 and n > 0
        for length in pattern:
            packed[length] += n
    assert (packed == counts).all()
    total = sum(n for _, n in bins)
    assert total <= 1.01 * -(-(np.arange(4097) * counts).sum() // 4096)


def planted_pairs(per_level=60):
    """Pairs of texts with some words replaced one by one, and the exact Jaccard similarity of each pair's five-word shingles."""
    rng, out = random.Random(8), []
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    for changes in (2, 3, 4, 5, 6, 7, 8, 9):
        for _ in range(per_level):
            a = [f"w{rng.randrange(5000)}" for _ in range(240)]
            b = list(a)
            for at in rng.sample(range(0, 240, 8), changes):
                b[at] = f"x{rng.randrange(10**9)}"
            x, y = shingles(a), shingles(b)
            out.append((" ".join(a), " ".join(b), len(x & y) / len(x | y)))
    return out


def test_near_copies_at_the_stated_similarity(spark):
    pairs = planted_pairs()
    df = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    gone = [2 * i + 1 not in kept for i in range(len(pairs))]
    near, far = ([g for g, p in zip(gone, pairs, strict=True) if (p[2] >= 0.8) == want] for want in (True, False))
    print(f"recall {np.mean(near):.4f} of {len(near)}, wrong {np.mean(far):.4f} of {len(far)}, precision {sum(near) / max(1, sum(gone)):.4f}")
    assert np.mean(near) >= 0.99 and not any(far) and all(2 * i in kept for i in range(len(pairs)))


def test_near_copies_brute(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        t = list(base)
        for at in rng.sample(range(120), i % 5):
            t[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(t))
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts]
    labels = np.arange(60)
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                labels[labels == labels[i]] = labels[j]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (8, 512):
        found = simhash.similar(df, block=block).collect()
        groups = collections.defaultdict(set)
        for r in found:
            groups[r.component].add(r.doc_id)
        assert sorted(map(sorted, groups.values())) == sorted(np.flatnonzero(labels == x).tolist() for x in set(labels.tolist()))


def test_keep_one_tells_texts_of_one_id_apart(spark):
    rng = random.Random(10)
    a, b = words(rng, 80), words(rng, 80)
    kept = simhash.keep_one(spark.createDataFrame([(1, a), (1, b), (1, a), (2, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b)])


@pytest.mark.parametrize("module", [topk, ann])
def test_vector_search(spark, module):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[7] = x[6]
    data = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    odd = [(None, [0.5] * 8, "c"), (900, None, "c"), (901, [float("nan")] * 8, "c"), (902, [1.0] * 7, "c"), (903, [None, *[1.0] * 7], "c"), (904, [float("inf")] * 8, "c"), (5, x[5].tolist(), "c")]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, score string")
    exact = x.astype(float)
    found = (module.inner_product_topk(df) if module is topk else module.nearest(df, books=6, words=32)).collect()
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300}
    for q, own in got.items():
        if module is topk:
            w = np.floor(exact * 1024).astype(int)
            score = w @ w[q]
            order = [int(i) for i in np.lexsort((np.arange(400), -score)) if i != q][:10]
        else:
            score = np.sqrt(((exact - exact[q]) ** 2).sum(1))
            order = [int(i) for i in np.lexsort((np.arange(400), score)) if i != q][:10]
        assert own == [(i, score[i]) for i in order]
    empty = df.where("vec_id > 5000")
    assert (module.inner_product_topk(empty) if module is topk else module.nearest(empty)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert (module.inner_product_topk(few) if module is topk else module.nearest(few)).count() == 1


@pytest.mark.parametrize("module", [topk, ann])
def test_vector_search_on_a_grid(spark, module):
    """More than one block of queries and part of candidates; many ties; zero vectors; repeated ids; the whole agrees with brute force."""
    rng = np.random.default_rng(14)
    x = rng.integers(-3, 4, size=(3000, 6)).astype(float)
    x[::7] = x[0] = [1, 2, 3, 1, 2, 3]
    x[50], x[200] = 0, 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(8, x[8].tolist())] * 40, "vec_id long, embedding array<double>")
    run = (lambda d: topk.inner_product_topk(d, block=7, part=500)) if module is topk else (lambda d: ann.nearest(d, block=7, part=500, books=6, words=32, shortlist=1500))
    got = collections.defaultdict(list)
    for r in sorted(run(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    zero = [50, 200] if module is ann else []
    assert set(got) == set(range(0, 3000, 100)) - set(zero)
    for q, own in got.items():
        score = -(x * 1024) @ (x[q] * 1024) if module is topk else np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [int(i) for i in np.lexsort((np.arange(3000), score)) if i != q and i not in zero][:10]
        assert own == [(i, (-score if module is topk else score)[i]) for i in order]


def test_ann_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    found = ann.nearest(df, shortlist=64, books=8, words=64).collect()
    got = collections.defaultdict(set)
    for r in found:
        got[r.query_id].add(r.vec_id)
    hits = sum(len(own & {int(i) for i in np.argsort(((x - x[q]) ** 2).sum(1), kind="stable") if i != q} & set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:11].tolist())) for q, own in got.items())
    assert hits >= 0.9 * 10 * len(got) and len(got) == 60


def test_urls(spark):
    rules = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
    given = {
        "https://A.Example.ORG/es/4?x#y": ("a.example.org", "/es/4", "example.org/es/", "block"), "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://b.org/": ("b.org", "/", "org/", "allow"), "http://b.org": ("b.org", "", None, None), "http://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "no url": ("", "", None, None), None: ("", "", None, None), "http://com/de/": ("com", "/de/", "com/de/", "block"), "a://b?c://d/e": ("b", "", None, None), "": ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(given)], "page_id long, url string, host string")
    found = urls.judge_urls(df, rules).orderBy("page_id").collect()
    for r, (url, (host, path, rule, verdict)) in zip(found, given.items()):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
        assert urls.split_url(url) == (host, path)
    empty = urls.judge_urls(df.limit(0), rules)
    assert empty.count() == 0 and empty.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    odd = spark.createDataFrame([(None, "http://b.org/", "z"), (1, "http://b.org/", "z"), (1, "http://b.org/", "z"), (2, "http://" + "long" * 50000 + ".org/" + "x" * 200000, "z")], "page_id long, url string, host string")
    assert sorted((str(r.page_id), r.rule, r.verdict) for r in urls.judge_urls(odd, rules).collect()) == [("1", "org/", "allow"), ("1", "org/", "allow"), ("2", "org/", "allow"), ("None", "org/", "allow")]


def test_urls_held_out_by_host():
    labelled = urls.labelled_urls()
    # a name stands under several endings: it is held out under all of them
    names = {u: urls.name_of(urls.split_url(u)[0]) for u, _ in labelled}
    assert len(set(names.values())) > 300 and len({u for u, _ in labelled}) == len(labelled)
    right, of, margins = {0: 0, 1: 0}, {0: 0, 1: 0}, {0: [], 1: []}
    for fold in range(4):
        out = {n for n in names.values() if zlib.crc32(n.encode()) % 4 == fold}
        weights, bias = urls.fit([x for x in labelled if names[x[0]] not in out])
        for u, y in labelled:
            if names[u] in out:
                g = urls.grams(*urls.split_url(u))
                of[y] += 1
                margins[y].append(float(weights[g].sum() / np.sqrt(len(g)) + bias))
                right[y] += (margins[y][-1] >= np.log(urls.THRESHOLD / (1 - urls.THRESHOLD))) == bool(y)
    print({y: (right[y], of[y]) for y in of}, np.round(np.quantile(margins[0], [0.5, 0.9, 0.97, 0.99]), 2), np.round(np.quantile(margins[1], [0.03, 0.1, 0.25, 0.5]), 2))
    assert right[0] >= 0.97 * of[0] and right[1] >= 0.75 * of[1]


def test_sentence_spans(spark, rows):
    text = "First sentence has quite a few words in it. Second one has as many words too. "
    more = [(100, text + "Alone here.", None, None, 1, "", ""), (101, "Before it. " + text + "After it.", None, None, 1, "", ""), (99, "Nothing of it. Clean.", None, None, 1, "", "")]
    df = spark.createDataFrame([*rows, *more], DOCS)
    out = {r.doc_id: r for r in spans.remove_repeated_spans(df, min_words=12).collect() if r.doc_id is not None}
    assert out[100].text == text + "Alone here." and out[101].text == "Before it. After it." and out[101].n_removed == 2 and out[99].n_removed == 0
    assert out[16].text is None and out[17].text == "" and out[12].text == "" and out[0].n_removed == 0
    assert len(spans.remove_repeated_spans(df.limit(0)).collect()) == 0
    assert spans.remove_repeated_spans(df).columns == [*df.columns, "n_sentences", "n_removed"]


def test_sentence_spans_brute(spark, rows):
    given = [(r[0], r[1]) for r in rows if r[0] is not None]
    seen, cover = {}, collections.defaultdict(set)
    for i, t in sorted(set((i, t or "") for i, t in given)):
        parts = spans.sentences(t)
        assert "".join(parts) == t
        full = [k for k, p in enumerate(parts) if p.split()][:400]
        for x in range(len(full)):
            for y in range(x + 1, len(full)):
                key = "\n".join(" ".join(parts[k].split()) for k in full[x : y + 1])
                if len(key.split()) >= 12:
                    if key in seen:
                        cover[i] |= set(range(full[x], full[y] + 1))
                    seen.setdefault(key, (i, x))
                    if len(key.split()) > 150:
                        break
    found = {r.doc_id: r for r in spans.remove_repeated_spans(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    for i, t in given:
        parts = spans.sentences(t or "")
        assert found[i].n_removed == len(cover[i])
        assert (found[i].text or "") == "".join(p for k, p in enumerate(parts) if k not in cover[i])


def test_sentence_spans_take_whole_passages(spark):
    rng = random.Random(12)
    plain = lambda n: words(rng, n, 10**6)
    long, short, lone, tail = (plain(n) + ". " for n in (20, 10, 20, 3))
    run_on = plain(300)
    texts = [
        long + short + plain(30) + ".",
        plain(25) + ". " + long + short + plain(31) + ". ",
        plain(22) + ". " + long + short.strip(),
        plain(26) + ". " + lone + plain(27) + ".",
        plain(28) + ". " + lone + plain(29) + ".",
        long + short + tail,
        plain(90) + " " + run_on + " " + plain(90),
        plain(80) + " " + run_on + " " + plain(100),
    ]
    out = {r.doc_id: r.text for r in spans.remove_repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[0] == texts[0] and out[3] == texts[3] and out[4] == texts[4] and out[6] == texts[6]
    assert out[1] == texts[1].replace(long + short, "") and out[2] == texts[2].replace(long + short.strip(), "") and out[5] == tail
    assert len(out[7].split()) < 480 - 100


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a>Home</a></li></ul></nav><div class="ad">Buy now</div>
<article><h1>A &amp; B</h1><p><b>One <i>two</i>three.<br>four<p>Five&nbsp;six<aside>no</aside><div class="comments"><p>reader</p></div></article><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    menu = " ".join(f"menu{i}" for i in range(12))
    bare = [f"<div><p>{menu}</p></div><p>Only on page {i} stands this {i} text.</p><p>{menu}</p>" for i in range(3)]
    pages = [(1, "http://h.com/1", PAGE, "c"), (2, "http://h.com/2", None, "c"), (3, None, "", "c"), (None, "http://h.com/4", "<p>unclosed", "c"), (5, "http://h.com/1", PAGE, "c"), *[(10 + i, f"http://bare.org/{i}", b, "c") for i, b in enumerate(bare)], (20, "http://other.net/", bare[0], "c"), (21, "http://h.com/9", "<script>x", "c"), (22, "http://h.com/8", "<article>cut off <b", "c")]
    found = {r.page_id: r for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()}
    assert found[1].text == "A & B\nOne twothree. four\nFive six" == found[5].text and found[1].n_chars == 33 == len(found[1].text)
    assert found[2].text == "" and found[3].text == "" and found[None].text == "unclosed" and found[21].text == "" and found[22].text == "cut off"
    assert found[11].text == "Only on page 1 stands this 1 text."
    assert found[20].text.count("menu0") == 2


def test_html_names_and_broken_markup():
    text = lambda page: html.blocks(page)[0]
    assert text('<article class="post comments-open"><p>Kept.</p></article>') == ["Kept."]
    assert text('<article><h2 id="search-engines">Search</h2><p class="share-price">12</p><div class="notice-of-meeting">At ten.</div></article>') == ["Search", "12", "At ten."]
    assert text('<article><p>A</p><div class="site-notice">x</div><ul id="related_posts-2"><li>x</ul><div role="navigation">x</div><div class="big ad-slot">x</div><p>B</p></article><article class="comment-body">x</article>') == ["A", "B"]
    assert text('<article><p title="a>Hello</p><p>There</p></article>') == ["Hello", "There"]
    assert text("<article><p data-x=it's>Two</p><p title='a > b' x=\"<i>\">Three</p></article>") == ["Two", "Three"]
    assert text("<article>" + "<div><b>" * 50000 + "deep" + "</i></b></div>" * 50000 + "<p>end</article>") == ["deep", "end"]
    for name in ("post-comments", "user-comments", "reader-comments", "commentlist", "discussion", "adbox"):
        assert text(f'<article><p>A</p><div class="x {name}"><p>out</p></div><section id="{name}">out</section></article>') == ["A"], name
    assert text('<article class="has-comments no-comments"><p>A</p></article><article class="user-comment">out</article>') == ["A"]
    assert text("<body><form id='aspnet'><nav>out</nav><article><p>A</p><form><p>out</p></form><p>B</p></article><p>out</p></form>") == ["A", "B"]
    assert text('<article><p class="search">A</p><p class="alert">B</p><div class="search">out</div><p hidden>out</p><div style="color: red; display: none">out</div><p data-hidden-x="1">C</p></article>') == ["A", "B", "C"]
    long = " ".join(f"w{i}" for i in range(400000))
    assert text(f"<main><p>{long}</p></main>") == [long]
    assert text("<article><p" + ' x="1"' * 100000 + ">a" + "<" * 100000) == ["a" + "<" * 100000]


def test_html_repeats_brute(spark):
    """On pages without an article, the words kept are those that no run repeated on another page of the host covers."""
    rng = random.Random(21)
    shared = [words(rng, n, 10**6) for n in (9, 20, 8, 7)]
    pages = []
    for i in range(40):
        parts = [words(rng, rng.randrange(1, 14), 10**6) if rng.random() < 0.5 else rng.choice(shared) for _ in range(6)]
        pages.append((i, f"http://h{i % 3}.net/{i}", "".join(f"<p>{p}</p>" for p in parts), parts))
    found = {r.page_id: r.text for r in html.main_text(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()}
    streams = {i: [w for p in parts for w in p.split()] for i, _, _, parts in pages}
    for i, _, _, parts in pages:
        own, gone = streams[i], set()
        others = {tuple(s[k : k + 8]) for j, s in streams.items() if j != i and j % 3 == i % 3 and s != own for k in range(len(s) - 7)}
        for k in range(len(own) - 7):
            if tuple(own[k : k + 8]) in others:
                gone |= set(range(k, k + 8))
        at, kept = 0, []
        for p in parts:
            n = len(p.split())
            cover = [k in gone for k in range(at, at + n)]
            runs, k = [], 0
            while k < n:
                e = k
                while e < n and cover[e] == cover[k]:
                    e += 1
                if not cover[k] or e - k < min(8, n):
                    runs += p.split()[k:e]
                k = e
            if runs:
                kept.append(" ".join(runs))
            at += n
        assert found[i] == "\n".join(kept)


def test_pieces(spark, rows):
    model = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([*rows, (300, "▁literal ▁ mark\x00 ſ 𝄞  two", None, None, None, None, None)], DOCS)
    coded = pieces.encode(df, model)
    back = {r.doc_id: r.text for r in pieces.decode(coded, model).collect()}
    for r in df.collect():
        if r.doc_id is not None:
            assert back[r.doc_id] == (r.text or "")
    assert pieces.check(df, model).where("not exact").count() == 0


def test_viterbi_finds_the_best_path():
    rng = random.Random(8)
    alphabet = "abc"
    found = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5))): -rng.random() * 5 for _ in range(25)}
    found["▁"] = -1.0
    vocabulary = pieces.Vocabulary.of(found.items())
    for _ in range(60):
        text = "▁" + "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 10)))

        def score(t):
            best = {0: 0.0}
            for j in range(1, len(t) + 1):
                ways = [best[i] + found[t[i:j]] for i in range(j) if t[i:j] in found and i in best]
                if t[j - 1] not in found and j - 1 in best:
                    ways.append(best[j - 1] + vocabulary.unknown)
                if ways:
                    best[j] = max(ways)
            return best[len(t)]

        one, many = vocabulary.best_one(text.encode()), vocabulary.best_many([text.encode(), b"a"])[0]
        assert one == many
        unknown = [b for b in one if b < 0 and (-1 - b) & 0xC0 != 0x80]
        assert abs(sum(vocabulary.scores[k] for k in one if k >= 0) + vocabulary.unknown * len(unknown) - score(text)) < 1e-9


def test_quality(spark):
    rng = random.Random(3)
    good = [(i, words(rng, 80) + ".", "en", f"s{i % 5}", 500) for i in range(300)]
    bad = [(1000 + i, " ".join(f"W{rng.randrange(90)}!!###" for _ in range(80)), "en", f"s{i % 5}", 500) for i in range(100)]
    odd = [(None, None, None, None, None), (5000, "", None, None, None), (5001, "x" * 50000, "de", "s9", -4)]
    docs = spark.createDataFrame([(*r, "c") for r in good + bad + odd], "doc_id long, text string, lang string, source string, n_chars long, keep string")
    labels = [(r[0], 1) for r in good[::2]] + [(r[0], 0) for r in bad[::2]] + [(None, 1), (good[0][0], None), (7, 0), (7, 1), (9999, 1)]
    found = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    keep = {r.doc_id: r.keep for r in found}
    assert len(found) == len(good + bad + odd)
    held = [(i, 1) for i, *_ in good[1::2]] + [(i, 0) for i, *_ in bad[1::2]]
    assert np.mean([keep[i] == bool(y) for i, y in held]) >= 0.97
    one_sided = quality.classify(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert all(r.keep and r.score is None for r in one_sided)
    assert quality.classify(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert suffix.remove_repeats(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_pipeline_stages(spark, rows, tmp_path):
    import corpus_pipeline

    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert docs.columns == df.columns
            docs = docs.cache()
            assert docs.count() > 0
    assert docs.count() == corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_html_repeats_on_pages_with_an_article(spark):
    """The step over a host's pages is run for pages that have an article, too, and never cuts it."""
    rng = random.Random(22)
    shared = [words(rng, n, 10**6) for n in (8, 11, 30)]
    pages = []
    for i in range(30):
        parts = [words(rng, rng.randrange(1, 14), 10**6) if rng.random() < 0.5 else rng.choice(shared) for _ in range(4)]
        pages.append((i, f"http://h{i % 3}.net/{i}", "".join(f"<div class='ad'>{p}</div>" for p in parts[:2]) + f"<article><p>{shared[2]}</p></article>" + "".join(f"<footer>{p}</footer>" for p in parts[2:]), parts))
    found = {r.page_id: r for r in html.main_text(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()}
    streams = {i: [w for p in parts for w in p.split()] for i, _, _, parts in pages}
    for i, _, _, parts in pages:
        own, gone, at, repeated = streams[i], set(), 0, 0
        others = {tuple(s[k : k + 8]) for j, s in streams.items() if j != i and j % 3 == i % 3 for k in range(len(s) - 7)}
        for k in range(len(own) - 7):
            if tuple(own[k : k + 8]) in others:
                gone |= set(range(k, k + 8))
        for p in parts:
            n = len(p.split())
            for run in "".join("x" if k in gone else " " for k in range(at, at + n)).split():
                repeated += len(run) if len(run) >= min(8, n) else 0
            at += n
        assert (found[i].text, found[i].n_repeated) == (shared[2], repeated)
    assert sum(r.n_repeated for r in found.values()) > 200


def test_short_windows_share_anchors():
    data = np.random.default_rng(5).integers(0, 256, 40000, dtype=np.uint8)
    found = list(suffix.anchored(data, 32))
    assert sum(int(n.sum()) for *_, n in found) == 40000 - 31  # every window, in runs
    assert sum(len(n) for *_, n in found) < 40000 / 6
