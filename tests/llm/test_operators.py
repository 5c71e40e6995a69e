"""The ten operators and the pipeline against brute force, on small tables with nulls, empty, long and repeated texts."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from glyphloom.llm import anchors, bpe, common, components, dedup, embeddings, jaccard, licenses, packing, quality, sharding, suffixes, toxicity, urls

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORDS = "the of and to in that was his with as had for her not but at on by which you from all this have said they one were she would".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


LONG = prose(1, 9000)
TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, prose(2, 300)), (5, prose(2, 300)), (6, prose(2, 300) + " and more words here at the end"),
    (7, LONG), (8, prose(3, 150) + " " + prose(2, 300)[:800] + " " + prose(4, 150)), (9, "a" * 3000), (10, "é日本語 ünïcödé\x1c ΣΑΣ <|endoftext|> İ"), (11, prose(5, 120)),
    (12, prose(5, 120).upper()), (13, "Released under the MIT License.\n" + prose(6, 50)), (14, "one two"), (15, (prose(7, 40) + "\n") * 4), (16, "#$% | " * 40 + prose(8, 30)),
]


@pytest.fixture(scope="module")
def docs(spark):
    schema = Y.StructType([Y.StructField("doc_id", Y.LongType()), Y.StructField("text", Y.StringType()), Y.StructField("length", Y.StringType()), Y.StructField("task", Y.IntegerType()), Y.StructField("key", Y.IntegerType()), Y.StructField("size", Y.IntegerType())])
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in TEXTS], schema)


def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, t in TEXTS:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 2048) and r["length"] <= 2048
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    whole = collections.defaultdict(list)
    for r in rows:
        whole[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in whole.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(whole) <= -(-sum(r["length"] for r in rows) // 2048) + 2
    assert packing.pack_documents(empty(spark, docs), path).count() == 0


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(0)
    histogram = dict(collections.Counter(rng.integers(1, 257, 20000).tolist()))
    rows = packing.plan(histogram, 256)
    used = collections.Counter()
    for s, first, n, sequence, offset in rows.tolist():
        for k in range(n):
            used[sequence + k] += s
    assert {s: int(rows[rows[:, 0] == s][:, 2].sum()) for s in histogram} == histogram
    assert max(used.values()) <= 256 and len(used) <= 1.006 * sum(k * v for k, v in histogram.items()) / 256


def one_by_one(histogram, capacity):
    """Sequences, and open bins by gap, of the rule of sums of squares looked at anew for each piece."""
    bins, sequences = [0] * (capacity + 1), 0
    for s in sorted(histogram, reverse=True):
        for _ in range(histogram[s]):
            choices = [(2 * (bins[g - s] - bins[g]) + 2 if g > s else 1 - 2 * bins[g], g) for g in range(s, capacity) if bins[g]]
            g = min(choices)[1] if choices else capacity
            sequences += not choices
            bins[g] -= bool(choices)
            bins[g - s] += g > s
    return sequences, bins[1:capacity]


@pytest.mark.parametrize(("n", "capacity"), [(300, 60), (60_000, 40), (200_000, 40)])
def test_plan_is_that_of_single_pieces_at_any_size(n, capacity):
    rng = np.random.default_rng(n)
    for lengths in (rng.integers(1, capacity + 1, n), rng.lognormal(2.3, 1, n).astype(int).clip(1, capacity)):
        histogram = dict(collections.Counter(lengths.tolist()))
        used = collections.Counter()
        for s, _, m, sequence, offset in packing.plan(histogram, capacity).tolist():
            for k in range(sequence, sequence + m):
                assert used[k] == offset
                used[k] += s
        gaps = collections.Counter(capacity - u for u in used.values())
        assert (len(used), [gaps[g] for g in range(1, capacity)]) == one_by_one(histogram, capacity)


def test_plan_fills_new_sequences():
    assert len({r[3] for r in packing.plan({100: 21}, 2048).tolist()}) == 2  # 20 in one, not one in each


def test_quality(spark, docs):
    rows = {r["doc_id"]: r for r in quality.judge(docs, []).collect()}
    for i, t in TEXTS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = collections.Counter(windows)
        covered = {j for k, w in enumerate(windows) if often[w] > 1 for j in range(k, k + 5)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and r["kept"] == (not r["base_failed"])
    assert quality.judge(empty(spark, docs), []).count() == 0


def test_decision_list_learns_planted_rules():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(quality.RATIOS)))
    bad = (x[:, 0] > 0.8) | ((x[:, 5] > 0.7) & (x[:, 6] < 0.3))
    rules = quality.learn(x, bad)
    said = np.zeros(len(x), bool)
    for r in rules:
        said |= quality.holds(r, x)
    assert len(rules) >= 2 and (said == bad).mean() > 0.95
    assert quality.learn(x[:0], bad[:0]) == [] and quality.learn(x, np.zeros(len(x), bool)) == []


@pytest.mark.parametrize(("copies", "others"), [(5000, 200), (5000, 50), (0, 100), (0, 101), (0, 3000), (0, 0)])
def test_sample_is_the_least_hashes_however_rows_repeat(spark, copies, others):
    hashed = lambda rows: rows.withColumn("h", F.pmod(F.xxhash64("k", "v"), F.lit(common.GRAIN)))
    ids = spark.range(others).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 11 > 0, F.col("id")).alias("k"))
    last = hashed(spark.range(1000).selectExpr("id as k", "0L as v")).orderBy(F.desc("h")).first()["k"]  # its copies come after the others
    rows = ids.select("k", "v").union(spark.range(copies).select(F.lit(last).alias("k"), F.lit(0).cast("long").alias("v")))
    want = sorted((r["h"], str(r["k"]), r["v"]) for r in hashed(rows).collect())[:100]
    assert sorted((r["h"], str(r["k"]), r["v"]) for r in hashed(common.sample_of(rows, 100, "k", "v")).collect()) == want


def test_quality_on_labels(spark):
    d, l = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.judge(d, quality.fit(d, l)).join(l, "doc_id").where("not base_failed").select("quality", "kept").collect()
    assert np.mean([r["quality"] == r["kept"] for r in rows]) > 0.9


def test_licenses(spark, docs):
    rows = licenses.scan_licenses(docs).collect()
    assert [(r["doc_id"], r["start"], r["license"], r["n_lacking"], r["n_added"]) for r in rows] == [(13, 0, "MIT", 0, 0)]
    near = "Text before. This work is licensed under the GNU General Public Licence, version 3. Text after."
    ready = licenses.Templates()
    found = licenses.scan(near, ready)
    assert [(near[f[0] : f[0] + f[1]], f[2], f[5]) for f in found] == [("This work is licensed under the GNU General Public Licence, version 3", "GPL-3.0", 1)]
    assert licenses.scan("A license to print money, and copyright law.", ready) == [] and licenses.scan(None, ready) == []
    assert licenses.scan_licenses(empty(spark, docs)).count() == 0


def test_licenses_against_brute_force():
    """Notices wrapped, edited, in prose and in runs of one another: found where the words differ by no more than is allowed, wherever lines end."""
    ready = licenses.Templates()
    rng = np.random.default_rng(12)
    seen = collections.Counter()
    for trial in range(150):
        name, wording = licenses.TEMPLATES[trial % len(licenses.TEMPLATES)]
        own = re.findall(r"\S+", wording)
        for _ in range(int(rng.integers(0, 2 + len(own) // 4))):
            at = int(rng.integers(0, len(own)))
            own[at : at + 1] = [[], ["zyx"], [own[at], "zyx"]][int(rng.integers(0, 3))]
        lines = "".join(w + ("\n# " if rng.random() < 0.2 else " ") for w in own)
        text = f"{prose(trial, int(rng.integers(0, 200)))} {lines} {prose(trial + 999, int(rng.integers(0, 200)))}"
        wanted = {ready.names[k] for k, w in enumerate(ready.words) if sum(map(len, licenses.differences(w, licenses.words(text))[2:])) <= ready.most[k]}
        got = {f[2] for f in licenses.scan(text, ready)}
        assert got <= wanted and bool(got) == bool(wanted), (text, got, wanted)
        seen[bool(wanted)] += 1
    assert min(seen[True], seen[False]) > 10
    both = " ".join(w for _, w in licenses.TEMPLATES for _ in range(2))  # one run of notices
    assert collections.Counter(f[2] for f in licenses.scan(both, ready)) == collections.Counter(n for n, _ in licenses.TEMPLATES for _ in range(2))
    long = prose(5, 150_000) + licenses.TEMPLATES[3][1].replace(" ", "\n") + prose(6, 1000)
    assert [f[2] for f in licenses.scan(long, ready)] == ["MIT"]


def sets_by_hand(texts):
    out = {}
    for i, t in texts:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def components_by_hand(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_jaccard(spark, docs):
    rng = np.random.default_rng(5)
    base = prose(20, 200).split()
    near = []
    for k in range(60):  # a group of near copies, not all of them alike pair by pair
        w = list(base)
        for at in rng.integers(0, len(w), k % 9):
            w[at] = f"x{k}"
        near.append((100 + k, " ".join(w)))
    texts = [*TEXTS, *near]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sets = sets_by_hand(texts)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(df).collect()}
    want = components_by_hand(sets)
    assert rows == {i: (len(s), want[i]) for i, s in sets.items()}
    assert jaccard.similar_documents(empty(spark, docs)).count() == 0


def test_jaccard_in_blocks(spark, monkeypatch):
    """A group of near copies with pairs of outliers that are alike only to one another, dealt in many small blocks, with and without small groups looked through together."""
    rng = np.random.default_rng(6)
    base, near = prose(21, 120).split(), []
    for k in range(90):
        w = list(base)
        own = k if k % 6 else k - k % 12  # every second pair of outliers shares its changes
        for at in np.random.default_rng(own).integers(0, len(w), 1 + k % 4 if k % 6 else 14):
            w[at] = f"x{own}"
        if not k % 6:
            w[int(rng.integers(0, len(w)))] = f"y{k}"
        near.append((k, " ".join(w)))
    want = components_by_hand(sets_by_hand(near))
    assert 1 < len(set(want.values())) < 40
    df = spark.createDataFrame(near, "doc_id long, text string")
    for block, grams in ((7, 600), (2048, 1 << 20)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "GRAMS", grams)
        assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(df).collect()} == want


def shared(n, common, seed=0):
    """Two sets of n grams with so many in common."""
    x = np.unique(np.random.default_rng(seed).integers(0, 1 << 63, 2 * n + 100, np.uint64) * np.uint64(2))[: 2 * n - common]
    x = np.random.default_rng(seed).permutation(x)
    return np.sort(x[:n]), np.sort(x[n - common :])


def test_slots_part_long_sets_and_lose_none():
    rng = np.random.default_rng(4)
    for n in (20, 900, 1100, 2100, 8000, 20_000):
        kept = [shared(n, -(-75 * 2 * n // 175)), shared(n, n)]
        kept.append((shared(n, n)[0], shared(n, n)[0][: -(-3 * n // 4)]))  # a part, of other slots
        for x, y in kept:
            part = jaccard.Slots([jaccard.slots(x, True), jaccard.slots(y, True)])
            least = np.array([jaccard.needed(len(x), len(y))])
            assert part.allow(0, np.array([1]), least).all() and part.allow(np.array([1]), np.array([0]), least).all()
    for n in (2100, 8000, 20_000):
        sets = [s for seed in rng.integers(0, 1000, 3).tolist() for s in shared(n, n // 8, seed)]
        part = jaccard.Slots([jaccard.slots(x, True) for x in sets])
        assert not part.allow(np.array([0, 2, 4]), np.array([1, 3, 5]), np.full(3, jaccard.needed(n, n))).any()


def test_pairs_are_verified_in_stars(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR", 4)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    texts = [(1, None), (2, "a b c")]
    for i in range(3, 40):  # a hub, and texts that differ from it from word `cut` on
        cut = int(rng.integers(40, 61))
        texts.append((i, " ".join(words[:cut] + [f"x{i}-{k}" for k in range(60 - cut)])))
    texts += [(7, "another text with the id of one of them"), (8, texts[5][1])]
    sets = {i: set(jaccard.gram_set(t).tolist()) for i, t in texts[2:39]}
    classes = {i: jaccard.class_of(jaccard.gram_set(t)) for i, t in texts[2:39]}
    least = {c: min(i for i in classes if classes[i] == c) for c in classes.values()}
    pairs = [(least[c], least[d]) for c in least for d in least if c < d]
    rows = spark.createDataFrame(texts, "id long, t string")
    reps = spark.createDataFrame([(c, i) for c, i in least.items()], "class long, rep long")
    both = spark.createDataFrame([(classes[i], classes[j]) for i, j in pairs], "a long, b long")
    found = {(r["a"], r["b"]) for r in jaccard.verified(both, reps, rows, 5, 75).collect()}
    alike = {tuple(sorted((classes[i], classes[j]))) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert found == alike and 0 < len(alike) < len(pairs)


def test_batches_of_long_rows_are_small(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    jaccard.small_batches(spark)
    rows = spark.range(0, 90, 1, 1).select(F.expr("repeat('x', 200000)").alias("t"))
    assert max(r["n"] for r in rows.mapInArrow(run, "n long").collect()) < 8 << 20


def test_clusters_in_blocks(spark):
    """Sets of one cluster dealt in blocks: the links that come out join what brute force joins, and are no more than that takes."""
    rng = np.random.default_rng(8)
    sets = {c: np.unique(np.concatenate([np.arange(40, dtype=np.uint64), rng.integers(100, 140, 12).astype(np.uint64)])) for c in range(60)}
    rows = [(0, c, c % 5, 1.0, sets[c].tobytes()) for c in sets]
    df = spark.createDataFrame(rows, "cluster long, class long, component long, weight double, grams binary")
    got = [(r["a"], r["b"]) for r in jaccard.links_in_clusters(jaccard.dealt_out(df, "cluster", F.col("weight"), 6, "grams"), 75).collect()]
    alike = {(a, b) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert {tuple(sorted(p)) for p in got} <= alike and len(got) < 600
    joined = lambda pairs: joined_by_hand(range(60), [*pairs, *((c, c % 5) for c in sets)])
    assert joined(got) == joined(alike)


def joined_by_hand(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_hot_grams_meet_across_tasks(spark, monkeypatch):
    """Short texts that are almost only a passage which longer texts have too: all they share are grams dealt to several tasks."""
    monkeypatch.setattr(jaccard, "HOT", 1)
    fixed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in fixed}
    texts = []
    for p in range(6):
        passage = prose(200 + p, 30)
        texts += [(1000 * p + k, f"{passage} end{k}") for k in range(2)]
        texts += [(1000 * p + 10 + k, passage + " " + " ".join(f"w{p}x{k}x{i}" for i in range(200))) for k in range(40)]
    try:
        for k, v in fixed.items():
            spark.conf.set(k, v)
        rows = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == {i: i - 1 if i % 1000 == 1 else i for i, _ in texts}


def test_suffix_array_dedup(spark, docs):
    data = {i: (t or "").encode() for i, t in TEXTS}
    often = collections.Counter(x[k : k + 400] for x in data.values() for k in range(len(x) - 399))
    rows = {r["doc_id"]: r for r in dedup.without_repeats(docs).collect()}
    for i, x in data.items():
        gone = np.zeros(len(x) + 1, int)
        for k in range(len(x) - 399):
            if often[x[k : k + 400]] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(np.frombuffer(x, np.uint8)[~gone])
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(x), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()), i
    assert dedup.without_repeats(empty(spark, docs)).count() == 0


def test_counted_windows_agree_with_shards(spark, docs, monkeypatch):
    want = sorted(tuple(r) for r in dedup.without_repeats(docs).collect())
    monkeypatch.setattr(dedup, "MOST", 1)
    assert sorted(tuple(r) for r in dedup.without_repeats(docs).collect()) == want


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(dedup, "BUFFER", 2000)
    text = prose(9, 3000).encode()
    found = []
    for rows, at, whole, ends in dedup.buffers([b"x", text]):
        for a, lo, hi in zip(at, [0, *ends], ends):
            assert whole[lo:hi] == text[a : a + hi - lo] and rows[0] == 1
            found += range(a, a + hi - lo - 399)
    assert found == [*range(len(text) - 399)]


@pytest.mark.parametrize("depth", [3, 5, 20])
def test_repeated_windows(depth, monkeypatch):
    monkeypatch.setattr(suffixes, "DEPTH", depth)
    rng = np.random.default_rng(depth)
    for _ in range(60):
        letters = [b"a", b"ab", b"abc", bytes(range(256))][rng.integers(4)]
        texts = [bytes(rng.choice(list(letters), rng.integers(0, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        texts += [texts[0][2:] + b"x", b"zz" + texts[0] * 2]
        often = collections.Counter(x[i : i + depth] for x in texts for i in range(len(x) - depth + 1))
        assert [w.tolist() for w in suffixes.repeated_windows(texts, depth)] == [[i for i in range(len(x) - depth + 1) if often[x[i : i + depth]] > 1] for x in texts]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    t = np.append(rng.integers(1, 4, 300), 0).astype(np.uint16)
    assert suffixes.suffix_array(t, 4).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_anchors_are_shared():
    a, b = prose(30, 400).encode(), prose(31, 100).encode() + prose(30, 400).encode()[200:1500]
    seen = []
    for x in (a, b):
        at, grams, first, last = anchors.contexts(np.frombuffer(x, np.uint8), np.array([len(x)]))
        assert first[0] == 0 and last[-1] == len(x) - 400 and (first[1:] == last[:-1] + 1).all()
        seen.append({x[s : s + 400]: g for f, l, g in zip(first, last, grams.tolist()) for s in range(f, l + 1)})
    shared = set(seen[0]) & set(seen[1])
    assert shared and all(seen[0][w] == seen[1][w] for w in shared)


def test_sharding(spark, docs):
    rows = sharding.shard_by_bytes(docs).collect()
    texts = dict(TEXTS)
    assert len(rows) == len(TEXTS)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    shards, groups = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        shards[r["shard"]].append(r["slot"])
        groups[texts[r["doc_id"]] or ""].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and all(len(g) == 1 for g in groups.values())
    assert sharding.shard_by_bytes(empty(spark, docs)).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 500).tolist()
    runs = sharding.best_fit_decreasing(collections.Counter(sizes), 128)
    got = [(size, at) for size, n, at in runs for _ in range(n)]
    bins, want = [], []
    for size in sorted(sizes, reverse=True):
        fit = min(((r, b) for b, r in enumerate(bins) if r >= size), default=None)
        if fit is None:
            fit = (128, len(bins))
            bins.append(128)
        bins[fit[1]] -= size
        want.append((size, fit[1]))
    assert got == want
    loads = collections.Counter()
    for size, n, at in sharding.even_bins({1000: 1, 1: 700}, 8):
        loads[at] += size * n
    assert sorted(loads.values()) == [100] * 7 + [1000]


def test_fixed_capacity(spark):
    """As few shards of a capacity as the packing needs, groups whole, many groups of one size."""
    texts = [(i, "x" * (i % 7 * 10) + str(i // 2)) for i in range(400)] + [(1000 + i, "same") for i in range(30)]
    rows = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string"), None, 200).collect()
    loads, of, slots = collections.Counter(), {}, collections.defaultdict(list)
    by = dict(texts)
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert of.setdefault(by[r["doc_id"]], r["shard"]) == r["shard"]
    assert len(rows) == 430 and max(loads.values()) <= 200 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = collections.Counter()
    for t in by.values():
        groups[t] += len(t) + 1
    assert len(loads) == 1 + max(at for _, _, at in sharding.best_fit_decreasing(collections.Counter(groups.values()), 200))


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    rows = [(i, [float(v) for v in centres[i % 30] + 0.12 * rng.standard_normal(16)], 0) for i in range(240)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [1.0, None] + [0.0] * 14, 0), (304, rows[0][1], 1), (305, rows[0][1], 2), (306, [1.0, 0.0], 0), (307, [2.0, 0.0], 0), (308, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    kept = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, root = collections.Counter(), {i: i for i, _, _ in rows}
    for a in kept:
        for b in kept:
            if a < b and len(kept[a]) == len(kept[b]) and kept[a] @ kept[b] / np.linalg.norm(kept[a]) / np.linalg.norm(kept[b]) >= 0.9:
                links[a] += 1
                links[b] += 1
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * sum(links.values())
    assert all(got[i]["n_links"] <= links[i] for i in root)
    assert got[307]["component_id"] == 306 and got[305]["n_links"] >= 2 and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (300, 301, 302, 303, 308))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [32, 64])
@pytest.mark.parametrize("n", [10_000, 100_000, 1_000_000])
def test_pairs_at_the_threshold_share_a_direction(n, dim):
    """Codes sized for n vectors, on pairs at cosine 0.9 that they were not measured on."""
    code = embeddings.CapCode(n, dim, 0.9)
    rng = np.random.default_rng(77)
    x = embeddings.unit(rng.standard_normal((1000, dim)))
    z = rng.standard_normal((1000, dim))
    y = 0.9 * x + np.sqrt(0.19) * embeddings.unit(z - (z * x).sum(1, keepdims=True) * x)
    met = [len(np.intersect1d(p, q)) > 0 for p, q in zip(code.decode(x), code.decode(y))]
    assert np.mean(met) >= 0.998


def test_embedding_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.standard_normal(24)
    rows = [(i, [float(v) for v in base + 0.03 * rng.standard_normal(24)], 0) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    got = embeddings.near_duplicates(df).collect()
    assert all(r["n_links"] == 89 and r["component_id"] == 0 for r in got)


def test_urls(spark):
    rows = [(0, None), (1, "no scheme"), (2, "HTTP://WWW.Example.NET/en/x?q=1#f"), (3, "http://a.example.com/de/1"), (4, "http://x.org/fr/"), (5, "http://x.org/FR/"), (6, "http://notexample.com/de/1"), (7, "http://foo.net"), (8, "http://foo.net/"), (9, "x://y.com?a=://b.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judge(pages).collect()}
    assert got[0] == got[1] == ("", "", None)
    assert got[2] == ("www.example.net", "/en/x", "example.net/en/") and got[3][2] == "example.com/de/" and got[4][2] == "org/fr/"
    assert got[5][2] is None and got[6][2] is None and got[7] == ("foo.net", "", None) and got[8][2] == "net/" and got[9] == ("y.com", "", None)
    assert urls.judge(pages.limit(0)).count() == 0
    x = np.random.default_rng(0).random((500, len(urls.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    assert (((urls.boost(x, y).margin(x)) > 0) == y).mean() > 0.95


@pytest.mark.parametrize("name", ["quality_base", "url_rules"])
def test_plain_columns_against_sql(spark, name):
    from glyphloom.llm import queries
    from tests.oracle import connect, differences

    assert differences(queries.queries()[name](spark, SF), queries.oracle_sql()[name], connect(SF)) == ""


def test_rules_against_brute_force(spark):
    rng = np.random.default_rng(11)
    hosts = ["net", "a.net", "example.net", "WWW.Example.NET", "xexample.net", "example.com", "sub.example.com", "org", "b.org", "borg", "", "net.com"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/EN/", "/fr/y", "//", "/de//"]
    rows = [(i, f"{rng.choice(['http', 'x', ''])}{rng.choice(['://', ':/'], p=[0.9, 0.1])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/en/', '#/de/', '?x://y.net/'])}") for i in range(400)]

    def by_hand(url):
        rest = url.partition("://")[2] if "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [r for _, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return host, path, max(fit, key=len, default=None)

    judged = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in judged} == {i: by_hand(u) for i, u in rows}
    assert all(r["verdict"] == dict((rule, v) for v, rule in urls.RULES)[r["rule"]] for r in judged if r["rule"])


def test_toxicity_matches_against_brute_force():
    """The composed table against a direct reading of what the three transducers say."""
    rng = np.random.default_rng(13)
    lexicon = toxicity.Lexicon(frozenset(["blorg"]))
    words = ["blorg", "kill", "you", "not", "said", '"', ".", "tree", "house", ","]
    for _ in range(400):
        tokens = rng.choice(words, int(rng.integers(0, 25))).tolist()
        want = [0] * toxicity.KINDS
        denied = aimed = 0
        said = quoted = False
        for t in tokens:
            if t in ("blorg", "kill"):
                want[(denied > 0) + 2 * (said or quoted) + 4 * (aimed > 0) + 8 * (t == "kill")] += 1
            denied, aimed = max(0, denied - 1), max(0, aimed - 1)
            if t == "not":
                denied = toxicity.REACH_NOT
            elif t == "you":
                aimed = toxicity.REACH_AIM
            elif t == "said":
                said = True
            elif t == '"':
                quoted = not quoted
            elif t in ".,":
                denied = aimed = 0
                said = False
        assert lexicon.matches(" ".join(tokens)) == want, tokens


def test_trees_as_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.random((200, len(urls.FEATURES)))
    model = urls.boost(x, (x[:, 3] > 0.4).astype(float))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(urls.FEATURES))
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], model.margin(x))


def test_toxicity_grammar():
    lexicon = toxicity.Lexicon(frozenset(["idiot"]), frozenset(["lowe"]))
    kinds = lambda text: [k for k, n in enumerate(lexicon.matches(text)) for _ in range(n)]
    assert kinds("What an idiot.") == [0] and kinds("loweichen") == [0]
    assert kinds("You are an idiot.") == [4] and kinds("You are not an idiot.") == [5]
    assert kinds('He said it is an idiot. An idiot.') == [0, 2] and kinds('"idiot" idiot') == [0, 2]
    assert kinds("I will kill you.") == [8] and kinds("you I kill") == [12]
    assert kinds(None) == kinds("") == kinds("clean words") == []
    model = toxicity.Model(lexicon)
    counts = np.array([lexicon.matches(t) for t in ("an idiot", "not an idiot", "nothing")], float)
    assert model.score(counts)[0] > model.score(counts)[1] > model.score(counts)[2]


def test_near_copies_count_once_in_the_lexicon(spark):
    clean = [(prose(400 + k, 40), 0) for k in range(20)]
    copies = [(prose(399, 60) + f" copy{k}", 1) for k in range(400)]
    own = [(" ".join(f"w{chr(97 + k)}{chr(97 + i)}q" for i in range(20)) + (" blorgel" if k < 6 else ""), 1) for k in range(26)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame([*clean, *copies, *own], "text string, toxic int"))
    assert lexicon.of_word("blorgel") == toxicity.INSULT  # 6 of 27 families, though 2% of the rows are 8
    assert not any(lexicon.of_word(f"copy{k}") == toxicity.INSULT for k in range(400))


def test_unlike_texts_with_one_least_hash_are_apart(spark):
    least = min((f"x{chr(97 + i)}{chr(97 + j)}{chr(97 + k)}" for i in range(26) for j in range(26) for k in range(26)), key=toxicity.xxhash.xxh3_64_intdigest)
    toxic = [(least + " blorgel " + " ".join(f"w{chr(97 + k)}{chr(97 + i)}q" for i in range(20)), 1) for k in range(12)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame([*toxic, *((prose(400 + k, 40), 0) for k in range(20))], "text string, toxic int"))
    assert lexicon.of_word("blorgel") == toxicity.INSULT


def test_toxicity_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score(d, toxicity.fit(d, l)).join(l, "doc_id").select("toxic", "score", toxicity.held_out().alias("out")).collect()
    own = [(r["toxic"], r["score"]) for r in rows if r["out"]]
    pos, neg = [s for t, s in own if t], [s for t, s in own if not t]
    assert np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]) > 0.8
    assert np.mean([s < 0.3 for s in neg]) > 0.97


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    own = {r["doc_id"]: r for r in bpe.encode_texts(docs, path).collect()}
    short = {r["doc_id"]: r for r in bpe.encode_digests(docs, path).collect()}
    for i, t in TEXTS:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        back = reference.decode(ids, skip_special_tokens=False)
        assert own[i]["ids"] == ids and own[i]["decoded"] == back
        assert short[i]["n_tokens"] == len(ids) and short[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and short[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.encode_digests(empty(spark, docs), path).count() == 0


def test_merge_long_equals_merge():
    b = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(0)
    for _ in range(50):
        raw = bytes(rng.choice(list(b"aeinrst"), 60).astype(np.uint8))
        ids = [b.inner[c] for c in raw]
        assert bpe.merge(list(ids), b.merges) == bpe.merge_long(list(ids), b.merges)


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(500, 560)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component_id"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.settle(stage(spark, now, SF))
        assert now.columns == docs.columns, name
        assert 0 < now.count() <= n
        n = now.count()
    kept = {r["doc_id"]: r["text"] for r in now.collect()}
    sets = sets_by_hand([(r["doc_id"], r["text"]) for r in docs.where(F.col("doc_id").isin(list(kept))).collect()])
    alike = components_by_hand(sets)
    assert all(alike[i] == i for i in kept)  # one of each group
    data = [t.encode() for t in kept.values()]
    assert max(collections.Counter(x[k : k + 400] for x in data for k in range(len(x) - 399)).values(), default=1) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == set(kept)


#: Nulls in every column, empty and long texts, ties, repeated rows, and names that clash or need quotes.
ODD_NAMES = ("my col", "a.b", "q`t", "key", "gram", "class", "id", "component", "k", "t", "size", "kept", "score", "label", "v", "rep", "spans", "__text", "__key", "piece", "length", "host", "rule")


@pytest.fixture(scope="module")
def odd(spark):
    schema = Y.StructType([Y.StructField("doc_id", Y.LongType()), Y.StructField("text", Y.StringType()), *(Y.StructField(n, Y.StringType()) for n in ODD_NAMES), Y.StructField("n_chars", Y.LongType())])
    texts = [(1, None), (2, ""), (3, " \n"), (4, prose(2, 300)), (4, prose(2, 300)), (5, prose(2, 300)), (None, prose(2, 300)), (None, None), (6, prose(3, 200_000)), (7, prose(3, 200_000)), (8, prose(8, 60)), (9, prose(9, 60)), (9, "another text of this id")]
    return spark.createDataFrame([(i, t, *(None if k % 2 else f"x{k}" for k, _ in enumerate(ODD_NAMES)), None) for i, t in texts], schema)


def by_id(rows, *columns):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[0]].append(tuple(r[c] for c in columns))
    return out


def test_odd_table_through_the_operators(spark, odd):
    n = odd.count()
    assert jaccard.similar_documents(odd).count() == n
    parts = by_id(jaccard.similar_documents(odd).collect(), "component_id")
    assert parts[4] == [(4,), (4,)] and parts[5] == [(4,)] and parts[7] == [(6,)] and parts[2] == [(2,)]
    assert by_id(dedup.without_repeats(odd).collect(), "n_removed")[8] == [(0,)] and dedup.without_repeats(odd, keep_columns=ODD_NAMES, with_text=True).columns[1:-5] == list(ODD_NAMES)
    assert dedup.without_repeats(odd, keep_columns=ODD_NAMES).count() == n
    assert packing.pack_documents(odd, public_tokenizers.path("byte_bpe_50k.json")).where("piece = 0").count() == n
    assert bpe.encode_digests(odd, public_tokenizers.path("word_bpe_49k.json")).count() == n
    assert licenses.scan_licenses(odd).count() == 0
    assert sharding.shard_by_bytes(odd).count() == n
    for labels in ([], [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9, None, None), (8, 0, 1), (8, 0, 1)]):
        own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        judged = quality.judge(odd, quality.fit(odd, own)).collect()
        assert len(judged) == n and by_id(judged, "n_words", "base_failed")[1] == [(0, True)]
        found = toxicity.score(odd, toxicity.fit(odd, own)).collect()
        assert len(found) == n and all(0 <= r["score"] <= 1 for r in found) and len({r["score"] for r in found if r["doc_id"] in (4, 5)}) == 1
    vectors = spark.createDataFrame([(i, v, *ODD_NAMES) for i, v in ((1, None), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (4, []))], Y.StructType([Y.StructField("vec_id", Y.LongType()), Y.StructField("embedding", Y.ArrayType(Y.FloatType())), *(Y.StructField(x, Y.StringType()) for x in ODD_NAMES)]))
    assert by_id(embeddings.near_duplicates(vectors).collect(), "n_links", "component_id")[3] == [(1, 2)]
    pages = spark.createDataFrame([(i, u, *ODD_NAMES[:-2]) for i, u in ((1, None), (2, ""), (2, ""), (3, "http://a.net/x"), (None, "x://" + "y" * 100_000))], Y.StructType([Y.StructField("page_id", Y.LongType()), Y.StructField("url", Y.StringType()), *(Y.StructField(x, Y.StringType()) for x in ODD_NAMES[:-2])]))
    assert urls.judge(pages).count() == 5


def test_odd_table_through_the_stages(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(4, 1, 0), (None, None, None), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (odd, odd.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            one = stage(spark, table, str(tmp_path))  # each on the odd table itself
            assert one.columns == odd.columns and one.count() <= table.count(), name
            now = corpus_pipeline.settle(stage(spark, now, str(tmp_path)))
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() >= now.count()
    once = corpus_pipeline.ngram_join(spark, odd, str(tmp_path))
    assert sorted((r["doc_id"] or 0) for r in once.collect()) == [0, 0, 1, 2, 3, 4, 4, 6, 8, 9, 9]
