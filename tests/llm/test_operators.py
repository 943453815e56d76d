import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, chat_format, components, edit_fingerprint, html_extract, mixing, near_dedup, quality_crf, suffix_dedup, toxicity
from tidemark.llm._spark import map_rows, small_batches
from tidemark.llm._text import lean

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, component string"


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", "src0", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def brute(texts, k, num, den):
    sets, parent = {}, {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def test_near_duplicates_against_brute_force(spark):
    """A group of 150 near copies around one text (a bucket too large for all pairs), copies of these, strangers."""
    rng = random.Random(1)
    base = prose(rng, 120)
    texts = [" ".join(edited(rng, base, rng.randrange(9))) for _ in range(150)]
    texts += [" ".join(edited(rng, t.split(), 1)) for t in texts[:40]] + texts[:20] + [" ".join(prose(rng, 60)) for _ in range(30)]
    texts += [None, "", " \n", "one", "ONE", "two words", "two words", "x " * 500]
    rng.shuffle(texts)
    found = near_dedup.near_duplicates(docs(spark, texts), shingle=3, numerator=85, denominator=100).collect()
    wanted = brute(dict(enumerate(texts)), 3, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(texts)


def test_near_duplicates_of_overlapping_groups(spark, monkeypatch):
    """Two groups of 60 near copies with bridges; every bucket goes by its head and the prefix filter."""
    monkeypatch.setattr(near_dedup, "FEW", 0)
    monkeypatch.setattr(near_dedup, "LEADERS", 0)
    rng = random.Random(2)
    a = prose(rng, 120)
    b = edited(rng, a, 9)
    texts = [" ".join(edited(rng, x, rng.randrange(1, 5))) for x in (a, b) for _ in range(60)]
    texts += [" ".join(x if rng.random() < 0.5 else y for x, y in zip(a, b, strict=True)) for _ in range(8)]
    rng.shuffle(texts)
    found = near_dedup.near_duplicates(docs(spark, texts), shingle=3, numerator=85, denominator=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(dict(enumerate(texts)), 3, 85, 100)


def test_near_duplicates_of_odd_tables(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    same = docs(spark, ["a b c d e f", None]).unionByName(docs(spark, ["a b c d e f"])).unionByName(spark.createDataFrame([(None, "a b c d e f", "", "", 1, "", "")], DOCS))
    rows = near_dedup.near_duplicates(same).collect()
    assert len(rows) == 4 and all(r.kept for r in rows)
    kept = near_dedup.drop_near_duplicates(docs(spark, ["a b c d e f", "a b c d e f", "z", None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3] and kept.columns == docs(spark, []).columns


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201)], "a long, b long")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components.components(links.limit(0)).count() == 0


def test_edited_fingerprints(spark):
    texts = ["a" * 9, None, "héllo wörld " * 40, "héllo wörld " * 40, "", "xyz"]
    rows = {r.doc_id: r for r in edit_fingerprint.edited_fingerprints(docs(spark, texts, 5)).collect()}
    import hashlib

    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        after, q = plain[(i + 1) % len(plain)], len(t) // 4
        edit = t[: len(t) - q] + after[:q]
        assert rows[5 + i].n_chars == len(t) and rows[5 + i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
    assert rows[7].fingerprint == rows[8].fingerprint and rows[7].near_next == 1.0 and rows[6].fingerprint == ""
    assert edit_fingerprint.edited_fingerprints(docs(spark, [])).count() == 0
    many = edit_fingerprint.with_next(docs(spark, [str(i) for i in range(1500)])).collect()
    assert {r.id: r.next_text for r in many} == {i: str((i + 1) % 1500) for i in range(1500)}


def test_near_by_edits(spark):
    rng = random.Random(3)
    base = " ".join(prose(rng, 300))
    other = " ".join(prose(rng, 300, 10**6))
    texts = [base, base, base.replace("w1 ", "w1x "), base[:700] + "inserted " + base[700:], other, other[:-5], None, "", "short", "short", "x"]
    got = {r.doc_id: r.component_id for r in edit_fingerprint.near_by_edits(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10}
    assert edit_fingerprint.near_by_edits(docs(spark, [])).count() == 0


def test_near_by_edits_links_all_pairs(spark):
    """Against all pairs: texts of every length with edits, a group of near copies and a bucket of strangers."""
    rng = random.Random(11)
    texts = []
    for size in (2, 5, 9, 14, 20, 33, 60, 61, 64, 90, 130, 190, 260, 900, 4000):
        for n in range(4):
            text = "".join(rng.choice("abcdefgh ") for _ in range(size))
            texts.append(text)
            for _ in range(3):
                at = rng.randrange(size)
                text = text[:at] + rng.choice(["", "q", "xy"]) + text[at + 1 :]
                texts.append(text)
    copy = " ".join(prose(rng, 120))
    texts += [copy[:at] + "!" + copy[at:] for at in range(len(copy) - 60, len(copy))] + ["zzzzzzzz" * 20 + "".join(rng.choice("klmnop") for _ in range(160)) for _ in range(20)]
    prints = edit_fingerprint.embed(texts)
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] and texts[j] and (texts[i] == texts[j] or edit_fingerprint.likeness(prints[i], prints[j]) >= 0.8):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    got = {r.doc_id: r.component_id for r in edit_fingerprint.near_by_edits(docs(spark, texts)).collect()}
    assert got == {i: root(i) for i in range(len(texts))} and len(set(got.values())) < len(texts) * 0.8


def test_near_between():
    """Against the likeness of each pair, of fingerprints of all lengths and of some that differ in few places."""
    rng = random.Random(4)
    prints = ["".join(rng.choice("abc-") for _ in range(n)) for n in (1, 2, 30, 63, 64, 65, 100, 127, 128, 129, 250, 300, 301, 500)]
    prints += [x[: len(x) * 9 // 10 + 1] for x in prints] + ["".join(rng.choice("abc") if rng.random() < share else c for c in x) for x in prints for share in (0.1, 0.25, 0.35)]
    for least in (0.5, 0.8, 1.0):
        i, j = edit_fingerprint.near_between(prints, prints[::-1], least)
        want = {(a, b) for a, x in enumerate(prints) for b, y in enumerate(prints[::-1]) if edit_fingerprint.likeness(x, y) >= least}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) >= len(prints)


def test_near_by_edits_among_strangers_with_a_line(spark, monkeypatch):
    """A large bucket of texts that share a line, some of them near copies: compared in blocks, its pairs are no rows."""
    monkeypatch.setattr(edit_fingerprint, "_BLOCK", 32)
    rng = random.Random(12)
    line = " ".join(prose(rng, 25))
    texts = [line + "\n" + "".join(rng.choice("abcdefghijklm ") for _ in range(80)) for _ in range(200)]
    texts += [t[:at] + "!" + t[at:] for t in texts[::5] for at in (len(t) - 30, len(t) - 3)]
    rng.shuffle(texts)
    written, write = {}, edit_fingerprint.materialize

    def counted(df, name):
        out = write(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(edit_fingerprint, "materialize", counted)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # blocks go on over batches
    try:
        got = {r.doc_id: r.component_id for r in edit_fingerprint.near_by_edits(docs(spark, texts)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    prints, label = edit_fingerprint.embed(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and edit_fingerprint.likeness(prints[i], prints[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert got == dict(enumerate(label)) and 100 < len(set(label)) < 250
    assert sum(written["pairs"]) + sum(written["near"]) < 20 * len(texts) and len(written["components"]) == 2


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row] if row is not None else None) for i, row in zip(ids if ids is not None else range(len(x)), x, strict=True)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("split", [4096, 60])
def test_nearest_recall(spark, monkeypatch, split):
    """With the root's tree alone, and with leaves that are clustered again; most vectors are loosely clustered."""
    monkeypatch.setattr(ann, "SPLIT", split)
    monkeypatch.setattr(ann, "FIT_BIN", min(ann.FIT_BIN, 4 * split))
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:900] = x[100]  # one vector many times
    df = vectors(spark, x)
    found = ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = total = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        own = [r for r in found if r.query_id == q]
        assert [r.rank for r in sorted(own, key=lambda r: (-r.score, r.vec_id))] == [1, 2, 3, 4, 5]
        floor = np.sort(s)[-5]
        hits += sum(s[r.vec_id] >= floor - 1e-9 for r in own)
        total += 5
        if 100 <= q < 900:
            assert [r.vec_id for r in sorted(own, key=lambda r: r.rank)] == [i for i in range(100, 107) if i != q][:5]
    assert hits / total >= 0.9
    assert abs(ann.measured_recall(df, df.where("vec_id % 50 = 0"), spark.createDataFrame(found)) - hits / total) < 0.02


def test_nearest_among_vectors_of_one_length(spark):
    df = vectors(spark, [[1, 0], [1, 0.1], [1, 0, 0], [1, 0, 0.2], [0, 1, 0], [5]])
    assert {(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, df).collect()} == {(0, 1, 1), (1, 1, 0), (2, 1, 3), (2, 2, 4), (3, 1, 2), (3, 2, 4), (4, 1, 2), (4, 2, 3)}


def test_nearest_of_odd_vectors(spark):
    odd = vectors(spark, [[1, 0], [0, 0], None, [float("nan"), 1], [float("inf"), 1], [1, 1], [2, 2]])
    rows = ann.nearest(odd, odd).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in rows} == {(0, 1, 5), (0, 2, 6), (5, 1, 6), (5, 2, 0), (6, 1, 5), (6, 2, 0)}
    assert ann.nearest(odd.limit(0), odd.limit(0)).count() == 0


def repeated(texts, least=50):
    """(document, word) positions in passages of ``least`` words that another document has, and that a smaller one has."""
    where = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        for j in range(len(w) - least + 1):
            where.setdefault(tuple(w[j : j + least]), []).append((i, j))
    every, later = set(), set()
    for places in where.values():
        first = min(i for i, _ in places)
        if any(i != first for i, _ in places):
            for i, j in places:
                every |= {(i, j + k) for k in range(least)}
                if i != first:
                    later |= {(i, j + k) for k in range(least)}
    return every, later


def test_repeated_passages_against_brute_force(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(30, 400), 10**5) for _ in range(60)]
    for n in (50, 51, 60, 90, 300):
        passage = prose(rng, n, 10**5)
        for i in rng.sample(range(60), 8):
            at = rng.randrange(len(texts[i]))
            texts[i][at:at] = passage
    short = prose(rng, 49, 10**5)
    texts += [prose(rng, 20, 10**5) + short, short + prose(rng, 20, 10**5), ["a"] * 200, ["b", "c"] * 90]
    head, tail = prose(rng, 25, 10**5), prose(rng, 25, 10**5)
    for n in (2, 3, 11, 16, 17, 30):  # one run over and over, cut off at other places, with the same or other words beside it
        run = [f"r{n}.{k}" for k in range(n)]
        texts += [prose(rng, 30, 10**5) + head + run * (400 // n) + tail, head + run * (150 // n) + run[:1] + prose(rng, 9, 10**5), run[1:] + run * (230 // n) + tail + prose(rng, 30, 10**5)]
    texts = [" ".join(t) for t in texts] + [None, "", "x"]
    rows = suffix_dedup.repeated_spans(docs(spark, texts)).collect()
    every, later = repeated(texts)
    assert {(r.id, w) for r in rows if not r.later for w in range(r.begin, r.finish)} == every
    mine = {(r.id, w) for r in rows if r.later for w in range(r.begin, r.finish)}
    assert mine == later
    cut = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(docs(spark, texts)).collect()}
    assert cut[len(texts) - 1] == "x" and cut[len(texts) - 3] is None and cut[62] == texts[62]
    for i, t in cut.items():
        if t is not None and i < 60:
            assert t.split() == [w for k, w in enumerate(texts[i].split()) if (i, k) not in mine]


def test_repeats_among_shuffled_lines(spark):
    """Documents of frequent 20-word lines in any order: neighbours in both sort orders share too little."""
    rng = random.Random(5)
    lines = [" ".join(prose(rng, 20, 10**5)) for _ in range(12)]
    texts = [" ".join(rng.choice(lines) for _ in range(rng.randrange(3, 9))) for _ in range(500)]
    rows = suffix_dedup.repeated_spans(docs(spark, texts)).collect()
    every, later = repeated(texts)
    assert {(r.id, w) for r in rows if not r.later for w in range(r.begin, r.finish)} == every
    assert {(r.id, w) for r in rows if r.later for w in range(r.begin, r.finish)} == later


@pytest.mark.parametrize("batch", [1, 7])
def test_repeats_over_partitions_and_batches(spark, batch):
    """The same where runs of the order go on over many partitions and Arrow batches of a few rows."""
    rng = random.Random(batch)
    lines = [" ".join(prose(rng, 20, 10**5)) for _ in range(8)]
    texts = [" ".join([*prose(rng, 9, 10**5), *[rng.choice(lines) for _ in range(rng.randrange(2, 6))]]) for _ in range(120)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = suffix_dedup.repeated_spans(docs(spark, texts)).collect()
    finally:
        for k, v in (("spark.sql.execution.arrow.maxRecordsPerBatch", None), ("spark.sql.shuffle.partitions", "4"), ("spark.sql.adaptive.coalescePartitions.enabled", "true")):
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    every, later = repeated(texts)
    assert {(r.id, w) for r in rows if not r.later for w in range(r.begin, r.finish)} == every
    assert {(r.id, w) for r in rows if r.later for w in range(r.begin, r.finish)} == later


def test_repeats_come_through_the_suffix_order(spark, monkeypatch):
    """Without the neighbours' runs, passages whose surroundings differ aren't found."""
    rng = random.Random(8)
    passage = prose(rng, 55, 10**5)
    texts = [" ".join(prose(rng, 40, 10**5) + passage + prose(rng, 40, 10**5)) for _ in range(6)]
    assert suffix_dedup.repeated_spans(docs(spark, texts)).where("not later").count() == 6
    real = suffix_dedup._in_runs
    monkeypatch.setattr(suffix_dedup, "_in_runs", lambda *a: real(*a).where("false"))
    assert suffix_dedup.repeated_spans(docs(spark, texts)).count() == 0


def test_long_texts_and_odd_names(spark):
    """One word of a million letters, 200,000 words in one text, and names with dots and blanks."""
    rng = random.Random(9)
    long = " ".join(prose(rng, 200_000, 10**4))
    texts = [long, long + " x", "y" * 10**6, "a b c", None]
    odd = docs(spark, texts).select("*", F.lit(1).alias("a b.c"), F.lit(2).alias("x_.y"))
    assert [r.doc_id for r in near_dedup.drop_near_duplicates(odd).orderBy("doc_id").collect()] == [0, 2, 3, 4]
    cut = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(odd).collect()}
    assert cut == {0: long, 1: "x", 2: "y" * 10**6, 3: "a b c", 4: None} and "a b.c" in suffix_dedup.cut_repeats(odd).columns
    field = quality_crf.fit(docs(spark, ["good line here\n" * 3, "bad $$$ %%%\n" * 3] * 20), spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int"))
    assert quality_crf.keep_good(odd, field, 0.0).select("`a b.c`").count() == 5
    assert mixing.mix_sources(odd, {"source": F.col("source")}, {"source": {}}, epochs=1, seed=1).select("`a b.c`").count() >= 3


def test_large_and_small_batches_follow_each_other(spark):
    """A task whose batches of 4 MB give next to nothing, then as much as they hold, then nothing."""
    rng = random.Random(14)
    once, others = " ".join(prose(rng, 60_000, 10**6)), [" ".join(prose(rng, 60_000, 10**6)) for _ in range(11)]
    rows = docs(spark, [once] * 11 + others + [once] * 11).coalesce(1)
    assert {r.doc_id: r.text for r in suffix_dedup.cut_repeats(rows).collect()} == {0: once} | dict(enumerate(others, 11))

    def more(batches):
        for n in [0, *[b.num_rows for b in batches], 20_000, 7]:
            yield pa.RecordBatch.from_arrays([pa.array(["x" * 512] * n, pa.string())], ["c0"])

    small_batches(spark)
    assert map_rows(spark.range(1000, numPartitions=1).select(F.col("id").cast("string")), lean(more)).count() == 21_007


def test_repeats_of_odd_tables(spark):
    assert suffix_dedup.repeated_spans(docs(spark, [])).count() == 0
    assert suffix_dedup.cut_repeats(docs(spark, ["a b", None])).count() == 2
    words = " ".join(f"k{i}" for i in range(80))
    odd = docs(spark, [words] * 30).select("*", F.lit("z").alias("_gone"), F.lit("z").alias("x_gone"), F.lit("z").alias("begin"))
    rows = suffix_dedup.cut_repeats(odd).collect()
    assert [(r.doc_id, r._gone, r.x_gone, r.begin) for r in rows] == [(0, "z", "z", "z")]


def test_bpe_operators(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = docs(spark, ["Hello world", None, "", "a " * 5000])
    coded = bpe.decode(bpe.encode(df, path), path)
    rows = {r.doc_id: r for r in coded.collect()}
    assert rows[0].decoded == "hello</w> world</w>" and rows[1].ids == [] and rows[3].n_tokens == 5000
    digests = {r.doc_id: r.n_tokens for r in bpe.round_trip_digests(df, path).collect()}
    assert digests == {i: rows[i].n_tokens for i in rows} and bpe.encode(df.limit(0), path).count() == 0


def test_quality(spark):
    rng = random.Random(9)
    good = [". ".join(" ".join(prose(rng, 9)).capitalize() for _ in range(6)) + "." for _ in range(80)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 50)) for _ in range(40)] + ["Ab " * 60 for _ in range(40)]
    df = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)], "doc_id long, quality int")
    field = quality_crf.fit(df, labels.where("doc_id % 4 <> 0"))
    scores = {r.doc_id: r.score for r in quality_crf.score(df.unionByName(docs(spark, [None, ""], 500)), field).collect()}
    held = [i for i in range(160) if i % 4 == 0]
    assert sum((scores[i] >= 0.3) == (i < 80) for i in held) >= 0.95 * len(held) and 0 <= scores[500] == scores[501] <= 1
    assert {r.doc_id for r in quality_crf.keep_good(df, field).collect()} == {i for i in range(160) if scores[i] >= 0.3}
    assert quality_crf.fit(df, labels.limit(0)) is None and {r.score for r in quality_crf.score(df, None).collect()} == {0.5}
    assert quality_crf.score(df.limit(0), field).count() == 0


def test_quality_scores_by_enumeration(spark):
    """The score of a text is the mean of its lines' marginals by their characters, over all 2 ** n labellings."""
    rng = np.random.default_rng(12)
    texts = ["One fine line.\n$$$ %% |||\n\nAN OTHER!! ONE!! one one one\n\u00e9t\u00e9 12 34", "x", "", "a b\n" * 7, "Plain words here, and more.\nPlain words here, and more."]
    field = quality_crf.Field([np.sort(rng.random(4)) for _ in range(12)], rng.normal(size=(3, 12, 16)), 0.3, rng.normal(size=(2, 2)))
    found = {r.doc_id: r.score for r in quality_crf.score(docs(spark, texts), field).collect()}
    for i, text in enumerate(texts):
        raw = text.encode()
        x, chars, bounds = quality_crf.line_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        bins, n = field.bins(x), len(text.split("\n"))
        assert bounds.tolist() == [0, n] and chars.tolist() == [len(line) for line in text.split("\n")]
        total, good = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=n):
            weight = sum(field.transitions[states[k], states[k + 1]] for k in range(n - 1))
            for k in range(n):
                near = [(0, k), (1, k - 1), (2, k + 1)]
                weight += states[k] * (field.bias + sum(field.weights[w][f, bins[j, f]] for w, j in near if 0 <= j < n for f in range(12)))
            total += np.exp(weight)
            good += np.exp(weight) * np.array(states)
        want = np.average(good / total, weights=chars + 1e-6)
        assert abs(found[i] - want) < 1e-6, (i, found[i], want)


def test_toxicity(spark):
    rng = random.Random(11)
    texts, marks = [], []
    for i in range(600):
        words = prose(rng, 40, 300)
        toxic = i % 5 == 0
        if toxic:
            for w in rng.choices(["idiot", "moron", f"zuko{rng.randrange(99)}"], k=3):
                words.insert(rng.randrange(40), w)
        texts.append(" ".join(words)), marks.append(int(toxic))
    texts += ["you 1d10t, m0r0n!", None, ""]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    lexicon = toxicity.fit(df, labels.where("doc_id % 3 <> 1"))
    assert any(" zuko".startswith(w) for w in lexicon.weights)
    got = {r.doc_id: r.score for r in toxicity.score(df, lexicon).collect()}
    held = [i for i in range(600) if i % 3 == 1]
    assert sum((got[i] >= 0.3) == bool(marks[i]) for i in held) >= 0.97 * len(held)
    assert got[600] >= 0.3 > got[601] == got[602] and toxicity.score(df.limit(0), lexicon).count() == 0
    assert not toxicity.fit(df, labels.limit(0)).weights


def test_toxicity_spares_phrases_of_clean_documents(spark):
    rng = random.Random(12)
    toxic = ["zorg " + " ".join(prose(rng, 20)) + " zorg" for _ in range(120)]
    clean = [" ".join(prose(rng, 20)) + (" mount zorg" if i % 8 == 0 else "") for i in range(480)]
    df = docs(spark, [*toxic, *clean, "They climbed Mount  Zorg.", "you zorg", "zorg mount"])
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(600)], "doc_id long, toxic int")
    lexicon = toxicity.fit(df, labels)
    assert "mount zorg" in lexicon.exceptions and " zorg " in lexicon.weights
    got = {r.doc_id: (r.hits, r.score) for r in toxicity.score(df, lexicon).collect()}
    assert got[600][0] == 0 and got[600][1] < 0.3 <= min(got[601][1], got[602][1])
    assert toxicity.fit(df, labels, exceptions=()).exceptions == ()


def site(i, extra=""):
    return f"<html><body><div><p>Read more on our site</p><p>text number {i} {extra}</p><p>Terms apply to all</p></div></body></html>"


def test_site_style_tree(spark):
    rows = [(i, f"http://a.org/{i}", site(i)) for i in range(8)] + [(20, "http://b.org/", site(9)), (21, None, None), (22, "http://a.org/x", ""), (23, "http://a.org/y", "<article><p>Read more on our site</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.main_text(df).collect()}
    assert all(got[i][0] == f"text number {i}" for i in range(8))
    assert got[20][0].split("\n")[0] == "Read more on our site" and got[21] == ("", 0) and got[22] == ("", 0) and got[23][0] == "Read more on our site"
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_site_style_tree_in_declared_articles(spark):
    """A site with noise of undeclared classes in and outside its articles, near copies of one page and undeclared pages."""
    rng = random.Random(21)
    note, share = "<p class=x1>Prices may change without warning</p>", "<div class=x2>Tell your friends</div>"

    def story(paragraphs):
        return "".join(f"<p>{p}</p>" for p in paragraphs)

    own = [[" ".join(prose(rng, 30)) for _ in range(rng.randrange(2, 6))] for _ in range(200)]
    pages = [f"<body><div class=x3>Our site</div><article><h1>title {i}</h1>{note}{story(p)}{share}</article></body>" for i, p in enumerate(own)]
    copied = [" ".join(prose(rng, 30)) for _ in range(9)]
    pages += [f"<body><div class=x3>Our site</div><article><h1>same</h1>{note}{story(copied)}<p>end {i % 2}</p>{share}</article></body>" for i in range(12)]
    pages += [f"<body><div class=x3>Our site</div><div><p>plain {i}</p></div></body>" for i in range(2)]
    df = spark.createDataFrame([(i, "http://hot.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html_extract.main_text(df.repartition(4)).collect()}
    assert all(got[i] == [f"title {i}", *p] for i, p in enumerate(own))
    assert all(got[200 + i] == ["same", *copied, f"end {i % 2}"] for i in range(12))
    assert [got[212], got[213]] == [["plain 0"], ["plain 1"]]


def test_importance_against_brute_force(spark):
    """Entropy of presentation and content by hand, on a site of undeclared pages; class names don't matter."""
    from collections import Counter

    rng = random.Random(22)
    pages = []
    for i in range(40):
        blocks = ["<div class=k1>always</div>", f"<div class=k2>{'same' if i % 20 else 'rare'} note</div>", f"<div class=k3>{rng.choice(['a', 'b', 'c'])} kind</div>"]
        blocks += [f"<p>{' '.join(prose(rng, 5))}{'<b>x</b>' * rng.randrange(3)}</p>" for _ in range(rng.randrange(1, 5))] + ["<nav>menu</nav>"]
        pages.append(f"<body>{''.join(blocks)}</body>")
    by: dict = {}
    for page in pages:
        for (node, style, content), (_, _, may) in zip(*(lambda b, f, _: (f, b))(*html_extract.read(page)), strict=True):
            by.setdefault((node, may), []).append((style, content))
    n_log = lambda xs: sum(n * np.log(n) for n in Counter(xs).values())
    low = set()
    for (node, may), seen in by.items():
        m = len(seen)
        if m >= html_extract.PAGES:
            style, content = (1 - n_log([x[k] for x in seen]) / (m * np.log(m)) for k in (0, 1))
            if 0.5 * may + 0.05 * style + 0.45 * content < 0.625:
                low.add(node)
    wanted = ["\n".join(t for node, t, may in html_extract.read(p)[0] if may and node not in low) for p in pages]
    texts = lambda ps: {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame([(i, "http://s.org", p) for i, p in enumerate(ps)], "page_id long, url string, html string")).collect()}
    got = texts(pages)
    assert got == dict(enumerate(wanted)) and not any("always" in t or "same note" in t for t in got.values())
    assert texts([p.replace("k1", "q7").replace("k2", "k1").replace("k3", "zz") for p in pages]) == got


def test_chat_layouts(spark):
    wanted = [("user", "hi"), ("assistant", "yo")]
    turns = lambda df: [[(t.role, t.text) for t in r.turns or []] for r in df.orderBy("conv_id").collect()]
    typed = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")], 3)], "conv_id long, messages array<struct<role:string,content:string>>, extra int")
    assert turns(chat_format.canonical_turns(typed)) == [wanted]
    rows = spark.createDataFrame([(1, 1, "assistant", "yo"), (1, 0, "user", "hi"), (2, 0, None, None)], "conv_id long, turn int, role string, text string")
    assert turns(chat_format.canonical_turns(rows)) == [wanted, [("", "")]]
    records = [
        '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "n": 1}', '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}', '{"prompt": "hi", "response": "yo"}',
        '{"prompt": "hi", "completion": "yo"}', '{"instruction": "hi", "output": "yo"}', '{"instruction": "hi", "input": "", "output": "yo"}', '{"question": "hi", "answer": "yo"}', "not json", None, '{"other": 1}',
    ]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    assert turns(chat_format.canonical_turns(df, record_col="record")) == [wanted] * 7 + [[]] * 3
    beside = rows.select("*", F.lit("p").alias("prompt"), F.lit("r").alias("response"), F.lit(1).alias("t"), F.lit(2).alias("turns"))
    assert turns(chat_format.canonical_turns(beside)) == [wanted, [("", "")]]
    both = spark.createDataFrame([(1, '{"prompt": "x", "turns": [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]}'), (2, '{"system": "s", "prompt": "hi", "response": "yo", "output": 1}')], "conv_id long, record string")
    assert turns(chat_format.canonical_turns(both, record_col="record")) == [wanted, [("system", "s"), *wanted]]
    with pytest.raises(ValueError, match="no layout"):
        chat_format.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, body string"))


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\l\\b\\h\\c < # : \\", "", None, "é\U0001f600\n\n"]
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "us:er\n#", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string")
    formatted = chat_format.format_chat(chat_format.canonical_turns(rows))
    r = chat_format.read_back(formatted).first()
    assert [(t.role, t.text) for t in r.turns] == [("assistant" if i % 2 else "us:er\n#", t or "") for i, t in enumerate(texts)]
    assert r.loss_text == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    f = formatted.first()
    for i, s in enumerate(f.spans):
        assert s.loss == bool(i % 2) and f.formatted[s.start : s.end].replace("\\c", ":").replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\") == (texts[i] or "")
    assert chat_format.read_back(chat_format.format_chat(chat_format.canonical_turns(rows.limit(0)))).count() == 0


def fill(nodes, budget):
    """Brute-force water filling of (weight, limit) by name."""
    given, open_nodes = dict.fromkeys(nodes, 0.0), {k for k, (w, c) in nodes.items() if w and c}
    left = float(budget)
    while open_nodes and left > 1e-6:
        total = sum(nodes[k][0] for k in open_nodes)
        step = min(left / total, min((nodes[k][1] - given[k]) / nodes[k][0] for k in open_nodes))
        for k in list(open_nodes):
            given[k] += step * nodes[k][0]
            if given[k] >= nodes[k][1] - 1e-6:
                open_nodes.remove(k)
        left -= step * total
    return given


def test_budgets(spark):
    rng = random.Random(13)
    leaves = [(a, b, rng.randrange(1, 2000)) for a in "xyz" for b in "pqrs"]
    weights = {"a": {"x": 5, "y": 1, "z": 0}, "b": {"p": 3, "q": 2}}
    for budget in (500, 5000, 10**9):
        df = spark.createDataFrame(leaves, "a string, b string, tokens long")
        got = {(r.a, r.b): r.allotted for r in mixing.budgets(df, ["a", "b"], weights, budget, 2).collect()}
        cap = {a: sum(2 * t for x, _, t in leaves if x == a) for a in "xyz"}
        top = fill({a: (weights["a"][a], cap[a]) for a in "xyz"}, min(budget, cap["x"] + cap["y"]))
        for a in "xy":
            low = fill({b: (weights["b"].get(b, 1), 2 * t) for x, b, t in leaves if x == a}, top[a])
            for b in "pqrs":
                assert abs(got[a, b] - low[b]) <= 6, (budget, a, b, got[a, b], low[b])
        assert all(got["z", b] == 0 for b in "pqrs")


def test_mixing_takes_prefixes_of_seeded_epochs(spark):
    rng = random.Random(17)
    df = spark.createDataFrame([(i, " ".join(prose(rng, rng.randrange(1, 30))), rng.choice(["en", "de", None]), rng.choice("ab")) for i in range(400)] + [(None, None, "en", "a"), (7, "twice", "en", "a")], "doc_id long, text string, lang string, source string")
    rows = mixing.mix_sources(df, {"lang": F.col("lang"), "source": F.col("source")}, {"lang": {"en": 3}}, budget=6000, epochs=2, seed=3).collect()
    plan = {}
    for r in rows:
        plan.setdefault((r._lang, r._source), {}).setdefault(r._epoch, []).append(r)
    given = df.select("*", mixing.count_words(F.col("text")).alias("t"), F.coalesce("lang", F.lit("unknown")).alias("l")).collect()
    import hashlib

    for (lang, source), taken in plan.items():
        own = [g for g in given if (g.l, g.source) == (lang, source)]
        last = max(taken)
        for epoch, got in taken.items():
            order = sorted(own, key=lambda g: (hashlib.md5(f"3:{epoch}:{'' if g.doc_id is None else g.doc_id}".encode()).hexdigest(), g.t))
            ids = [g.doc_id for g in order]
            key = lambda x: (x is None, x or 0)
            assert sorted((r.doc_id for r in got), key=key) == sorted(ids[: len(got)], key=key)
            assert epoch == last or len(got) == len(own)
    assert sum(r._tokens for r in rows) <= 6000 and {"doc_id", "text", "lang", "source"} <= set(rows[0].asDict())
    assert mixing.mix_sources(df.limit(0), {"lang": F.col("lang")}, {}).count() == 0


def test_mixing_of_clashing_columns(spark):
    """Levels and columns named like the operator's own columns, and its own output as input, give the same rows."""
    rng = random.Random(19)
    rows = [(i, " ".join(prose(rng, rng.randrange(1, 20))), rng.choice("pq"), rng.choice("rs")) for i in range(200)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    ids = lambda df: sorted((r.doc_id, r._epoch) for r in df.collect())
    wanted = ids(mixing.mix_sources(plain, levels, {"lang": {"p": 3}}, budget=1500))
    odd = plain.select("*", *[F.lit("z").alias(c) for c in ("_key", "_slice", "_full", "_rest", "_lang", "tokens", "level0", "x_0", "X_tokens", "share", "w.v")])
    mixed = mixing.mix_sources(odd, levels, {"lang": {"p": 3}}, budget=1500)
    assert ids(mixed) == wanted and {"_key", "w.v", "x_0"} <= set(mixed.columns) and {r._key for r in mixed.select("_key").collect()} == {"z"}
    again = mixing.mix_sources(mixed, levels, {})
    assert again.columns == mixed.columns and again.count() > 0
    for names in (("share", "full"), ("b", "c"), ("given", "w"), ("most", "parent")):
        leaves = plain.groupBy(F.col("lang").alias(names[0]), F.col("source").alias(names[1])).agg(F.count(F.lit(1)).alias("tokens"))
        got = {tuple(r)[:2]: r.allotted for r in mixing.budgets(leaves, list(names), {}, 150).collect()}
        assert len(got) == 4 and 146 <= sum(got.values()) <= 150
    with pytest.raises(ValueError, match="tokens"):
        mixing.budgets(leaves, ["tokens"], {})
    nulls = spark.createDataFrame([(None, 5), ("k", None), ("l", 5)], "lang string, tokens long")
    assert {r.lang: r.allotted for r in mixing.budgets(nulls, ["lang"], {}, 6).collect()} == {None: 3, "k": 0, "l": 3}
