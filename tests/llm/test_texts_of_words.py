"""Chunked piece encoding, importance resampling and spelling variants against the libraries and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import piece_bpe, spelling, target_sampling

DOCS = "doc_id long, text string, lang string, `a b.c` string, word string, ids string, block string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "x", "y", "z", "u") for i, t in enumerate(texts)], DOCS)


def odd_texts():
    rng = random.Random(5)
    letters = "abcdeé ▁　\t\n日本語𝒳ÿ×é<s></s>\x00'"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 90))) for _ in range(120)]
    return made + [None, "", " ", "   ", "\n", "▁", "a" * 3000, " " * 200, "the quick brown fox " * 2000, "xÿ" * 4000, "<0x0A> <unk> <s>", "the quick", "the quick"]


def test_piece_encoding_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(piece_bpe, "HELD", 50)
    monkeypatch.setattr(piece_bpe, "SLICE_CHARS", 300)
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts()
    rows = docs(spark, texts).unionByName(docs(spark, ["again", "again"]))
    found = Counter(map(tuple, piece_bpe.round_trip_digests(rows, PIECES).collect()))
    wanted = Counter()
    for i, t in [*enumerate(texts), (0, "again"), (1, "again")]:
        ids = own.encode(t or "", add_bos=True, add_eos=True)
        wanted[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest())] += 1
    assert found == wanted
    assert piece_bpe.round_trip_digests(docs(spark, []), PIECES).count() == 0
    both = piece_bpe.decode(piece_bpe.encode(docs(spark, texts), PIECES), PIECES).collect()
    assert {r.doc_id: r.decoded for r in both} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}


def test_piece_decoding_of_any_ids():
    rng, own, ours = random.Random(1), sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_bpe.PieceBpe(piece_bpe.load_model(PIECES))
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(262)]) for _ in range(rng.randrange(9))]
        assert ours.decode(np.array(ids, np.int64)) == own.decode(ids), ids


def test_checksums_of_spans():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 70_000).astype(np.uint8)
    start = rng.integers(0, 60_000, 500)
    size = np.concatenate([rng.integers(1, 300, 480), [1, 63, 64, 65, 127, 128, 129, 192, 4096, 4097, 9999, 8191, 8192, 2, 3, 4, 5, 6, 7, 10_000]])
    found = target_sampling.crc32_spans(data, start, start + size)
    assert found.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, size, strict=True)]


def sampled(texts, target, percent=5, least=20):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    each = {i: feats(t) for i, t in texts.items()}
    s, t = Counter(b for _, f in each.values() for b in f), Counter(b for x in target for b in feats(x)[1])
    every_s, every_t = sum(s.values()), sum(t.values())
    rows = {}
    for i, (n, f) in each.items():
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (every_s + 10_000) / ((s[b] + 1) * (every_t + 10_000)))) for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n]
    open_ = sorted((i for i in rows if rows[i][4] >= least), key=lambda i: (-rows[i][2], i))
    for place, i in enumerate(open_[: percent * len(open_) // 100], 1):
        rows[i][3] = place
    return {i: tuple(r[:4]) for i, r in rows.items()}


def test_resampling_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["Äpfel", "the", "x1", "ÜBER", "don", "日本語", "b" * 90, "zz", "A", "q7q"] + [f"w{i}" for i in range(60)]
    made = [rng.choice(["  ", " ", "", "-"]).join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "'"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    texts = [*made, *made[:40], None, "", "...", "one", "y" * 300_000, "k " * 200_000]
    target = [*made[7:9], None, "Äpfel the the"]
    found = target_sampling.resample(docs(spark, texts).repartition(5), docs(spark, target)).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in found} == sampled(dict(enumerate(texts)), target)
    assert len(found) == len(texts) and sum(r["rank"] is not None for r in found) > 10
    assert target_sampling.resample(docs(spark, []), docs(spark, [])).count() == 0
    twice = target_sampling.resample(docs(spark, ["a b " * 20] * 10).unionByName(docs(spark, ["a b " * 20] * 10)), docs(spark, []), percent=50).collect()
    assert sorted(r["rank"] for r in twice if r["rank"]) == list(range(1, 11))


def variants(texts):
    total = Counter()
    for i, t in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    found = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    out, form = {}, {}
    for w, n in found.items():
        others = [x for x in found if near(w, x)]
        best = min(others, key=lambda x: (-found[x], x), default=None)
        good = best is not None and found[best] >= 10 * n
        form[w] = best if good else None
        out[w] = [form[w], None, n, len(others), found[best] if good else None]
    for w, row in out.items():
        root = w
        while form[root]:
            root = form[root]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abÀéÿz") for _ in range(rng.randrange(7, 13))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Abcdefgh"]

    def slip(w):
        at, c = rng.randrange(len(w)), rng.choice("abéz")
        return rng.choice([w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at:] + c])

    pool = [w for i, b in enumerate(base) for w in [b] * 3 ** rng.randrange(7) + [slip(b) for _ in range(25)] + [slip(slip(b)) for _ in range(10)]]
    pool += ["chainone"] * 2 + ["chainonx"] * 30 + ["chainoxx"] * 400 + ["chainxxx"] * 4500
    rng.shuffle(pool)
    texts = [" ".join(pool[i : i + 200]) for i in range(0, len(pool), 200)] + [None, "", "1×2÷3", "verylong" * 5000, "verylong" * 5000, "Short short"]
    found = spelling.variants(docs(spark, texts)).collect()
    wanted = variants(dict(enumerate(texts)))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == wanted and len(found) == len(wanted)
    assert wanted["chainone"][1] == "chainxxx"
    assert spelling.variants(docs(spark, [])).count() == 0
