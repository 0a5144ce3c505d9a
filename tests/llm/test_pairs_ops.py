"""op6, op8, op10 and the pipeline: operators that compare documents."""

import hashlib
import random
from fractions import Fraction

import pytest
from llm_helpers import SF, documents, query, table_dir, words
from pyspark.sql import functions as F

from residuum.llm import components, decontaminate, ngram_jaccard, substring_dedup


def shingles(text, n=5):
    w = (text or "").encode().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_links(docs):
    """doc -> (class, links) over (id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    group, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in sets}


def variants(rng, n, length=120):
    base = words(rng, length).split()
    out = []
    for _ in range(n):
        w = list(base)
        w[rng.randrange(len(w))] = "zz%d" % rng.randrange(50)
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 7)  # groups of several blocks
    rng = random.Random(7)
    texts = variants(rng, 40) + [words(rng, 100) for _ in range(20)] + ["a b", "a b", "a", "", " \t", None, "a b c"]
    texts += [texts[0]] * 5 + [texts[45] + " tail"]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute_links(list(enumerate(texts)))


def test_near_duplicates_on_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.class_id, r.n_links) for r in query("op6")(spark, SF).collect()}
    assert got == brute_links([(r.doc_id, r.text) for r in docs])


def test_near_duplicates_repeated_ids(spark):
    docs = documents(spark, [(5, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words are here now"), (None, "a b c d e f g")])
    got = sorted(map(str, ngram_jaccard.near_duplicates(docs).collect()))
    assert len(got) == 4 and sum("n_links=1" in g for g in got) == 2 and sum("class_id=None" in g for g in got) == 1
    kept = ngram_jaccard.one_of_each(docs.withColumn("key", F.lit("clash"))).collect()
    # one row for each group of texts, whatever their ids: the other text of id 5 is no copy
    assert sorted((str(r.doc_id), r.text) for r in kept) == [
        ("5", "a b c d e f g"), ("5", "other words are here now"), ("None", "a b c d e f g")]


def test_one_of_each_loses_no_text_of_a_shared_id(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "one two three four five six seven",
               "red orange yellow green blue indigo violet")
    docs = documents(spark, [(3, a), (5, a + " x"), (5, b), (5, c), (5, c), (6, None), (6, None), (7, " "), (None, b)])
    kept = sorted((str(r.doc_id), str(r.text)) for r in ngram_jaccard.one_of_each(docs).collect())
    assert kept == sorted([("3", a), ("5", b), ("5", c), ("6", "None"), ("6", "None"), ("7", " "), ("None", b)])


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.998), (0.5, 0.9), (1.0, 0.99)):
        bands, rows = ngram_jaccard.choose_bands(t, recall)
        assert 1 - (1 - t ** rows) ** bands >= recall and bands * rows <= ngram_jaccard.MAX_HASHES


def test_pair_counting_in_column_slices(monkeypatch):
    import numpy as np
    monkeypatch.setattr(ngram_jaccard, "COLUMNS", 5)
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(40), rng.randint(5, 30))), np.int64) for _ in range(12)]
    got = ngram_jaccard._pairs(sets, Fraction(1, 2))
    for a in range(12):
        for b in range(12):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert got[a, b] == (2 * len(x & y) >= len(x | y))


@pytest.mark.parametrize("large", [0, 1])
def test_chains_are_verified_by_bucket(spark, monkeypatch, large):
    """Texts that change a little from one to the next: one candidate group, few links a text."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 5)
    monkeypatch.setattr(ngram_jaccard, "LARGE", large)
    rng = random.Random(13)
    w, texts = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(120)], []
    for _ in range(70):
        w = w[3:] + [f"w{rng.randint(0, 10 ** 6)}" for _ in range(3)]
        texts.append(" ".join(w))
    texts += texts[:9] + [" ".join(f"v{rng.randint(0, 10 ** 6)}" for _ in range(50)) for _ in range(5)]

    def grams(t):
        x = t.split()
        return {tuple(x[i:i + 5]) for i in range(len(x) - 4)}
    sets = [grams(t) for t in texts]
    links = [[j for j in range(len(sets)) if j != i and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in range(len(sets))]
    got = {r.doc_id: r for r in ngram_jaccard.near_duplicates(documents(spark, texts), max_hashes=2048, recall=0.999999).collect()}
    assert [got[i].n_links for i in range(len(texts))] == list(map(len, links))
    assert all(got[i].class_id == 0 for i in range(79)) and all(got[i].class_id == i for i in range(79, 84))


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_ROWS", 3)
    monkeypatch.setattr(components, "HUBS", 1 << 40)
    rng = random.Random(1)
    e = [(0, i) for i in range(1, 40)] + [(50, i) for i in range(51, 80)] + [(100 + i, 101 + i) for i in range(9)] + [(rng.choice([39, 79]), 200)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    root = {n: n for p in e for n in p}
    for _ in e:
        for a, b in e:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_components(spark):
    e = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (None, 1)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(31)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------ substring dedup


def brute_repeats(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [50, 6, 1])
def test_substring_dedup_equals_brute_force(spark, window):
    rng = random.Random(window)
    passages = [words(rng, 70) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [words(rng, rng.randint(0, 40), "ab", 2)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            a = rng.randint(0, 15)
            parts += [" ".join(p[a:len(p) - rng.randint(0, 15)]), words(rng, rng.randint(0, 10))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (101, None), (102, ""), (103, "x " * 400),
             (104, "x " * 300), (7, passages[0]), (105, "é\u00a0\u2003ü " * 60)]
    docs = documents(spark, rows).withColumn("kept", F.lit("clash"))
    got = substring_dedup.remove_repeats(docs, window)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str)
    assert got == brute_repeats(rows, window)


def test_substring_dedup_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in query("op10")(spark, SF).collect()), key=str)
    assert got == brute_repeats(rows, 50)


# ---------------------------------------------------------- decontamination


def test_decontamination_finds_planted_passages(spark):
    rng = random.Random(9)
    items = [words(rng, rng.randint(16, 60), "abcdefghijkl", 8) for _ in range(30)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "too short"), (0, items[0])],
                                  "item_id long, text string")
    rows = []
    for i, t in enumerate(items):
        w = t.split()
        for k in rng.sample(range(len(w)), len(w) // 10):
            w[k] = "substitute%d" % k
        text = words(rng, 50) + " " + " ".join(w) + " " + words(rng, 50)
        rows.append((i, text.upper() if i % 2 else text.replace(" ", ", ")))
    clean = [(100 + i, words(rng, 150)) for i in range(30)] + [(200, None), (201, ""), (202, "too short")]
    docs = documents(spark, rows + clean)
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(i, i) for i in range(30)}
    kept = decontaminate.clean(docs.withColumn("_judged", F.lit("clash")), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in clean} and "_judged" in kept.columns


def test_short_items_are_matched_whole(spark):
    """Verbatim copies of short items count, parts and changed ones do not; five tokens at least."""
    items = ["one two three four five six seven", "alpha beta gamma delta epsilon", "too short here now"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, ["so One, two three-four five six seven!", "one two three four five six eight", "x alpha beta gamma delta epsilon",
                             "too short here now", items[0], "one two three four five", items[0] + " " + items[1] + " " + items[0], None, ""])
    got = sorted((r.doc_id, r.item_id, r.doc_token, r.n_tokens, r.n_equal) for r in decontaminate.overlaps(docs, bench).collect())
    assert got == [(0, 0, 1, 7, 7), (2, 1, 1, 5, 5), (4, 0, 0, 7, 7), (6, 0, 0, 7, 7), (6, 1, 7, 5, 5)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 3, 5, 7, 8]


def plain_overlaps(text, item):
    """Whether any alignment without gaps holds 13 tokens or more of which 75 % are equal."""
    import re
    a, b = (re.findall("[a-z0-9]+", t.lower()) for t in (text, item))
    for shift in range(-len(b) + 1, len(a)):
        lo, hi = max(0, -shift), min(len(b), len(a) - shift)
        equal = [a[q + shift] == b[q] for q in range(lo, hi)]
        for i in range(len(equal)):
            for j in range(i + 13, len(equal) + 1):
                if 4 * sum(equal[i:j]) >= 3 * (j - i):
                    return True
    return False


def test_decontamination_equals_all_alignments(spark):
    """A random corpus over few words, so that overlaps of all kinds come about by chance too."""
    rng = random.Random(21)
    vocabulary = ["a", "b", "c", "d", "e", "f"]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(13, 30))) for _ in range(12)]
    items += ["q r " * 10, "z " * 40]
    texts = []
    for _ in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        source = rng.choice(items).split()
        cut = source[rng.randint(0, 5):][:rng.randint(8, 40)]
        cut = [x if rng.random() > rng.choice([0, .1, .25, .3]) else rng.choice(vocabulary) for x in cut]
        texts.append(" ".join(w + cut + w[:10]))
    texts += ["q r " * 30, "r q " * 7, "z " * 13, "z " * 12, "z y " * 20]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(documents(spark, texts + texts[:3]), bench).collect()}
    rows = list(enumerate(texts + texts[:3]))
    assert got == {(d, i) for d, t in rows for i, item in enumerate(items) if plain_overlaps(t, item)}


def test_repetitive_texts_stay_bounded(spark):
    import time
    bench = spark.createDataFrame([(0, "la " * 2000), (1, "la di " * 1000)], "item_id long, text string")
    docs = documents(spark, ["la " * 8000, "la di " * 4000, "la di da " * 3000])
    t = time.time()
    got = {(r.doc_id, r.item_id): r.n_tokens for r in decontaminate.overlaps(docs, bench).collect()}
    assert {k: got[k] for k in [(0, 0), (1, 1)]} == {(0, 0): 2000, (1, 1): 2000} and time.time() - t < 20


def test_decontamination_in_blocks(spark, monkeypatch):
    whole = sorted(map(tuple, query("op8")(spark, SF).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 300)
    assert sorted(map(tuple, query("op8")(spark, SF).collect())) == whole and whole


def test_large_benchmark_is_read_by_the_tasks(spark, monkeypatch):
    """Blocks come from the shared folder, for chunks of documents; nothing is broadcast."""
    rng = random.Random(8)
    items = [(i if i % 7 else None, words(rng, 40)) for i in range(60)] + [(61, None), (62, ""), (63, "one two three four five")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [words(rng, 80) + " " + (t or "") for _, t in items] + [None, "", words(rng, 200), "x one two three four five y"]
    docs = documents(spark, [(n if n % 5 else None, t) for n, t in enumerate(texts + texts[:9])]).repartition(2)
    key = lambda r: tuple((v is not None, v) for v in r)
    want = sorted(decontaminate.overlaps(docs, bench).collect(), key=key)
    kept = sorted(decontaminate.clean(docs, bench).collect(), key=key)
    assert len(want) >= 70 and kept
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        monkeypatch.setattr(type(spark.sparkContext), "broadcast", None)
        assert sorted(decontaminate.overlaps(docs, bench).collect(), key=key) == want
        assert sorted(decontaminate.clean(docs, bench).collect(), key=key) == kept
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_chunks_hold_every_batch():
    import pyarrow as pa
    batches = [pa.record_batch([pa.array([str(i) * 100])], ["t"]) for i in range(9)]
    got = list(decontaminate.chunks(iter(batches), 250))
    assert [b for held in got for b in held] == batches and [len(held) for held in got] == [3, 3, 3]
    assert [len(held) for held in decontaminate.chunks(batches, 0)] == [1] * 9 and not list(decontaminate.chunks([], 9))


def test_best_stretch():
    import numpy as np
    bits = np.array([0, 1, 1, 1, 0, 1, 1, 0, 0, 0, 1], bool)
    assert decontaminate.best_stretch(bits) == (1, 7)
    assert decontaminate.best_stretch(np.zeros(3, bool)) == (0, 0)


def found_overlaps(items, texts):
    """Overlaps without Spark: ``(text, item, document token, item token, tokens, equal)``."""
    import pyarrow as pa
    from residuum.llm.common import as_binary, slices
    seeds = decontaminate.Seeds(list(enumerate(items)))
    return [(first + r[0], *r[1:]) for first, data, off in slices(as_binary(pa.array(texts))) for r in seeds.overlaps(data, off)]


@pytest.mark.parametrize("parts", [(13, 8, 9), (13, 12, 13), (20, 18, 20), (13, 8, 0), (20, 18, 0)])
def test_decontamination_with_a_middle_part_replaced(spark, parts):
    head, changed, tail = parts
    item = [f"w{i}" for i in range(sum(parts))]
    copy = item[:head] + [f"x{i}" for i in range(changed)] + item[head + changed:]
    text = " ".join(f"y{i}" for i in range(40)) + " " + " ".join(copy) + " z" * 40
    (row, item_id, doc_token, item_token, n, equal), = found_overlaps([" ".join(item)], [text])
    assert (row, item_id, doc_token - item_token) == (0, 0, 40) and n >= 13 and equal >= max(head, 0.75 * n)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert decontaminate.clean(documents(spark, [text, "y " * 60]), bench).select("doc_id").collect() == [(1,)]


def test_best_stretch_is_the_longest_allowed():
    import numpy as np
    rng = np.random.default_rng(4)
    for _ in range(500):
        bits = rng.random(rng.integers(0, 40)) < rng.choice([0.5, 0.7, 0.8])
        fits = [(z - a, -a) for a in range(len(bits)) for z in range(a + 1, len(bits) + 1)
                if 4 * bits[a:z].sum() >= 3 * (z - a)]
        n, a = max(fits, default=(0, 0))
        assert decontaminate.best_stretch(bits) == (-a, n - a)


@pytest.mark.parametrize("n, unequal", [(13, 3), (16, 4), (20, 5), (24, 6)])
def test_a_mask_fits_every_pattern(n, unequal):
    from itertools import combinations
    spots = [sum(1 << (k + i) for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for k in range(n - len(m) + 1)]
    gone = (sum(1 << i for i in c) for c in combinations(range(n), unequal))
    assert all(any(not s & g for s in spots) for g in gone)


def test_decontamination_finds_every_substituted_copy():
    rng = random.Random(12)
    items, texts = [], []
    for n in (13, 14, 15, 16, 17, 18, 20, 26, 40, 57, 400):
        for gone in [range(k, n, 4) for k in range(4) if n < 40 or not k] + [rng.sample(range(n), share) for _ in range(6)
                                                                          for share in (n // 5, n // 4)]:
            if len(gone) * 4 > n:
                continue
            item = [f"i{len(items)}w{i}" for i in range(n)]
            items.append(" ".join(item))
            texts.append("a " * 20 + " ".join("x" if i in gone else w for i, w in enumerate(item)) + " b" * 20)
    assert [r[:2] for r in found_overlaps(items, texts)] == [(i, i) for i in range(len(items))]


@pytest.mark.parametrize("first", [0x4E00, 0x3041, 0x0E01, 0x1780, 0x20000])
def test_decontamination_in_scripts_without_spaces(first):
    item = "".join(chr(first + i) for i in range(20))
    copy = item[:9] + chr(first + 40) + item[10:]
    texts = ["ab " + chr(first + 41) * 30 + copy + "cd", "ab " + chr(first + 41) * 30 + "cd", "ab" + item + "cd"]
    (_, *one), two = found_overlaps([item], texts)
    assert one == [0, 31, 0, 20, 19] and two == (2, 0, 1, 0, 20, 20)


# ----------------------------------------------------------------- pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(11)
    item = words(rng, 30, "klmnop", 8)
    passage = words(rng, 60)
    base = words(rng, 200)
    rows = [(1, base), (2, base), (3, base + " more"), (4, words(rng, 80) + " " + passage), (5, passage + " " + words(rng, 90)),
            (6, words(rng, 40) + " " + item + " " + words(rng, 40)), (7, "12345 ***"), (8, None), (9, words(rng, 30)), (10, passage)]
    docs = documents(spark, rows).withColumn("kept", F.lit(1)).withColumn("id", F.lit("x"))
    d = table_dir(tmp_path, documents=docs, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    seen, at = [], spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, d).write.parquet(f"{d}/out{k}")
        at = spark.read.parquet(f"{d}/out{k}")
        seen.append(sorted(r.doc_id for r in at.collect()))
        if k < 4:
            assert at.columns == docs.columns
    assert seen == [[1, 2, 3, 4, 5, 6, 9, 10], [1, 4, 5, 6, 9, 10], [1, 4, 5, 6, 9], [1, 4, 5, 9], [1, 4, 5, 9]]
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in at.collect())
    cut = spark.read.parquet(f"{d}/out2").filter("doc_id = 5").first()
    assert passage.split()[30] + " " + passage.split()[31] not in cut.text and cut.n_chars == len(cut.text)


def test_pipeline_query(spark):
    got = query("pipeline")(spark, SF).collect()
    assert 0 < len(got) <= 200 and all(r.round_trip for r in got)
