"""The whole pipeline against a brute-force version on a small corpus with labels of both kinds."""

import random
import zlib

import numpy as np
import public_tokenizers

from ostraka.llm import spans


def prose(rng, sentences):
    return " ".join(" ".join(rng.choice("aeiou") + rng.choice("bdklmnrst") + rng.choice("aeiou") + str(rng.choice("bdlmnrst")) + rng.choice("aeiou") for _ in range(rng.randrange(8, 15))).capitalize() + "." for _ in range(sentences))


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus():
    rng = random.Random(31)
    good = {i: prose(rng, 10) for i in range(0, 120)}
    passage = prose(rng, 3)
    for i in (5, 17, 40):
        good[i] = good[i] + " " + passage + " " + prose(rng, 2)
    good[90] = good[3]
    for i, base in ((91, 8), (92, 8)):
        words = good[base].split()
        words[50 + i - 91] = "changed"
        good[i] = " ".join(words)
    good[93] = good[7][: len(good[7]) // 2] + prose(rng, 8)
    good[94] = ""
    bad = {200 + i: " | ".join(f"WIN{rng.randrange(90)}!!!###" for _ in range(60)) for i in range(60)}
    return good, bad


def expected(good):
    # one of each group of texts that a chain of similarities of 0.8 joins
    sets = {i: shingles(t) for i, t in good.items()}
    root = {i: i for i in good}
    ids = sorted(good)
    for _ in ids:
        for a in ids:
            for b in ids:
                if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in ids):
            break
    kept = {i: good[i] for i in ids if root[i] == i}
    # every run of two sentences and twelve words that an earlier one equals
    seen, left = set(), {}
    for i, text in sorted(kept.items()):
        parts = spans.sentences(text)
        plain, gone = [" ".join(p.split()) for p in parts], set()
        for a in range(len(parts)):
            for b in range(a + 2, len(parts) + 1):
                key = "\n".join(plain[a:b])
                if len(key.split()) >= 12:
                    if key in seen:
                        gone |= set(range(a, b))
                    seen.add(key)
        left[i] = "".join(p for k, p in enumerate(parts) if k not in gone)
    return left


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    good, bad = corpus()
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in (good | bad).items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i in good), 0) for i in [*range(0, 120, 2), *range(200, 260, 2)] if i != 94]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = expected({i: t for i, t in good.items() if i != 94 or any(r.doc_id == 94 for r in found)})
    assert 90 not in left and 91 not in left and 92 not in left and 93 in left and len(left[17]) < len(good[17])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for i, text in left.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        pieces += [(i, p, lo, len(ids[lo : lo + 4096]), zlib.crc32(ids[lo : lo + 4096].tobytes())) for p, lo in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(pieces)
    assert all(sum(r.length for r in found if r.sequence_id == s) <= 4096 for s in {r.sequence_id for r in found})
