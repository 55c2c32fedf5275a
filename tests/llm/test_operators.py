"""Each training-data operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm import common, cotraining, exact_dedup, html_text, jaccard_join, mixing, packing, quality_rules, sharding, suffix_dedup, url_filter
from millrace.llm.queries import QUERIES, RULES, tokenizer_file
from millrace.llm.suffix_array import suffix_array

DOC = "doc_id long, text string, lang string, source string, n_chars long, rank int, kept string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}" if k else None, len(t or ""), k, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOC)


def sample(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 5)))
    passage = " ".join(word() for _ in range(90))
    out = [None, "", " \t\n", "one two", "ONE two", "one two", "é\u00a0x y\x0bz " * 3, "a" * 3000]
    base = [" ".join(word() for _ in range(r.randint(5, 150))) for _ in range(8)]
    for _ in range(n):
        t = r.choice(base).split(" ")
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = word()
        out.append(" ".join(t) + (" " + passage if r.random() < 0.4 else ""))
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact_dedup(spark):
    texts = sample() + ["one two"] * 40
    rows = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts), counters=2, min_heavy=2).collect()}
    same = collections.defaultdict(list)
    for i, t in enumerate(texts):
        same[t or ""].append(i)
    for g in same.values():
        for i in g:
            assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (max(g), len(g), i == max(g))
            assert bytes(rows[i].digest) == hashlib.sha256((texts[i] or "").encode()).digest()
    repeated = frame(spark, ["x", "x", "x"], [None, 5, 5])
    assert exact_dedup.keep_one(repeated).count() == 1 and exact_dedup.keep_one(repeated).columns == repeated.columns
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


@pytest.fixture
def moving_splits(spark, monkeypatch):
    """File splits that differ from job to job, as they do when executors are lost or register late."""
    turn = itertools.count()

    def move():
        spark.conf.set("spark.sql.files.minPartitionNum", 1 + 3 * (next(turn) % 3))

    for module in (common, exact_dedup, jaccard_join, suffix_dedup):
        monkeypatch.setattr(module, "staged", lambda df, name, f=common.staged: (f(df, name), move())[0])
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    move()
    yield
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def in_files(spark, path, texts):
    d = frame(spark, texts)
    d.repartition(7, "doc_id").write.parquet(str(path))
    return spark.read.schema(d.schema).parquet(str(path))


def test_exact_dedup_when_splits_move(spark, tmp_path, moving_splits):
    texts = sample() + ["one two"] * 40
    last = {t or "": i for i, t in enumerate(texts)}
    d = in_files(spark, tmp_path / "d", texts)
    assert sorted(r.doc_id for r in exact_dedup.keep_one(d).collect()) == sorted(last.values())
    twice = exact_dedup.keep_one(d.unionByName(d))
    assert sorted(r.doc_id for r in twice.collect()) == sorted(last.values()) and twice.columns == d.columns


def test_jaccard_when_splits_move(spark, tmp_path, moving_splits):
    texts = sample(2)
    want = brute_components(texts)
    d = in_files(spark, tmp_path / "d", texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(d).collect()}
    assert got == want
    assert sorted(r.doc_id for r in jaccard_join.keep_first(d).collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_suffix_dedup_when_splits_move(spark, tmp_path, moving_splits):
    r = random.Random(5)
    line = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = line(500)
    texts = [line(50 + 10 * i) + (f"{i:02}{shared}" if i % 3 == 0 else "") for i in range(30)]
    d = in_files(spark, tmp_path / "d", texts)
    got = {x.doc_id: x for x in suffix_dedup.repeated_spans(d).collect()}
    for i, t in enumerate(texts):
        own = t.removesuffix(shared)
        assert (got[i].n_bytes, got[i].kept_sha256) == (len(t), hashlib.sha256(own.encode()).hexdigest())
    assert {x.doc_id: x.text for x in suffix_dedup.without_repeats(d).collect()} == {i: t.removesuffix(shared) for i, t in enumerate(texts)}


def brute_components(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = words((t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root[i], root[j]))
                root = [x if k == y else k for k in root]
    return {i: (len(sets[i]), root[i]) for i in range(len(texts))}


@pytest.mark.parametrize("common,block,sets,exact", [(32, 1_500_000, 1_000, False), (3, 400, 1_000, False), (3, 1_500_000, 4, True)])
def test_jaccard(spark, monkeypatch, common, block, sets, exact):
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", sets)
    texts = [*sample(2), "very long text " + "again and again " * 60_000]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, texts), exact=exact).collect()}
    assert got == brute_components(texts)


def test_jaccard_edges(spark):
    kept = jaccard_join.keep_first(frame(spark, ["a b", "a b", None, "c"], [7, 7, None, None]))
    assert kept.count() == 3
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_link_sets(seed):
    r = random.Random(seed)
    base = [set(r.sample(range(10**6), r.choice([1, 2, 5, 20, 60]))) for _ in range(3)]
    sets = []
    for _ in range(25):
        b = set(r.choice(base))
        for x in r.sample(sorted(b), min(len(b), r.randint(0, 6))):
            b.discard(x)
            b.add(r.randrange(10**6))
        sets.append(np.array(sorted(b), np.uint64))
    root = list(range(len(sets)))
    linked = lambda a, b: jaccard_join.linked(len(np.intersect1d(a, b)), len(a), len(b))
    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if k == y else k for k in root]
    own = list(range(len(sets)))
    for i, j in jaccard_join.link_sets(own, sets):
        assert linked(sets[i], sets[j])
        x, y = sorted((own[i], own[j]))
        own = [x if k == y else k for k in own]
    assert own == root


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array(seed):
    r = random.Random(seed)
    s = [r.randint(1, r.randint(1, 4)) for _ in range(r.randint(0, 60))] + [0]
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("seed", range(25))
@pytest.mark.parametrize("width", [16, 2])
def test_edges_of_copies(monkeypatch, seed, width):
    """Which strings around an anchor occur twice, against all pairs."""
    r = random.Random(seed)
    monkeypatch.setattr(suffix_dedup, "WIDTH", width)
    monkeypatch.setattr(suffix_dedup, "CHUNK", r.choice([5, 4000]))
    letters, n = r.choice(["ab", "abcdef"]), r.randint(2, 30)
    base = ["".join(r.choice(letters) for _ in range(511)) for _ in range(2)]
    left, right, key = [], [], [r.randint(0, 1) for _ in range(n)]
    for _ in range(n):
        b = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            b[r.randrange(511)] = r.choice(letters)
        left.append("".join(b[: r.choice([255, 255, r.randint(0, 255)])]).encode())
        right.append("".join(b[255:][: r.choice([256, 256, r.randint(0, 256)])]).encode())
    lo, hi = np.array([r.choice([0, 0, 128]) for _ in range(n)]), np.full(n, 255)
    got = suffix_dedup.settle(np.array(key), lo, hi, left, right)
    strings = [{x: left[i][:x] + b"|" + right[i][: 256 - x] for x in range(lo[i], 256) if len(left[i]) >= x and len(right[i]) >= 256 - x} for i in range(n)]
    for i in range(n):
        twice = [x for x, s in strings[i].items() if any(j != i and key[j] == key[i] and strings[j].get(x) == s for j in range(n))]
        assert (got[0][i], got[1][i]) == ((min(twice), max(twice)) if twice else (256, -1))


@pytest.mark.parametrize("most", [4_000, 3])
def test_suffix_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    r = random.Random(5)
    line = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = line(700)
    texts = [None, "", "z" * 900, line(399), shared[:420], shared[:399]] + [line(r.randint(0, 500)) + shared[r.randint(0, 250) : r.randint(420, 700)] + line(r.randint(0, 300)) for _ in range(25)]
    texts += [texts[10], "é" * 450, line(1_200_000) + shared]
    count = collections.Counter(b[p : p + 400] for t in texts for b in [(t or "").encode()] for p in range(len(b) - 399))
    got = {x.doc_id: x for x in suffix_dedup.repeated_spans(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                cover[p] += 1
                cover[p + 400] -= 1
        out = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~out])
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), out.sum(), hashlib.sha256(kept).hexdigest())
        assert len(got[i].spans) == (np.diff(np.concatenate([[0], out.astype(int)])) == 1).sum()
    assert suffix_dedup.repeated_spans(frame(spark, [])).count() == 0
    again = suffix_dedup.repeated_spans(frame(spark, [shared, shared, "x"], [None, None, 1])).collect()
    assert sorted((x.n_bytes, x.n_removed, len(x.spans)) for x in again) == [(1, 0, 0), (700, 700, 1), (700, 700, 1)]
    assert suffix_dedup.without_repeats(frame(spark, ["q" * 500, "short"])).where("text = ''").count() == 1


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = sample(3) + ["word " * 9000, "<|endoftext|> x"]
    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = set()
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want |= {(i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    rows = packing.pack(frame(spark, texts), tokenizer_file()).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) == -(-sum(r.length for r in rows) // 4096)
    assert packing.pack(frame(spark, []), tokenizer_file()).count() == 0


def test_word_tokens_are_the_tokenizers():
    """Taking words apart gives the ids of whole texts, with any characters."""
    words = packing.WordTokens(tokenizer_file())
    assert words.by_words
    rng = random.Random(5)
    pool = "abzAZ'stdvm.,_-|<>0129 \t\n\r\x0b\x1c\x85\xa0\xadéÉç\xb5\xaa²½İıǅſΣςç\u0301\u0307中文한\ufb01\u3000\ufeff\U0001f600\u212b\u212a"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["<|ENDOFTEXT|>x", "<|endoftext|>", "don't WE'LL I'M 'Sample", *("q" + chr(c) + "Q7" for c in range(0x250))]
    for t in texts:
        assert words.ids(t) == np.array(words.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_bin_slack_is_tight():
    assert sum(t for _, t in packing.minimum_bin_slack({6: 4, 4: 4, 5: 4, 10: 2, 1: 1}, 10)) == 9


def test_quality_rules(spark):
    texts = sample(4) + ["x y z\nx y z\n\n \nx y z " * 9, "a | b # c $$$ 9 !!"]
    rows = {r.doc_id: r for r in quality_rules.judge(frame(spark, texts), []).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed, not failed)
    assert quality_rules.judge(frame(spark, []), []).count() == 0


def test_rules_are_learned():
    r = random.Random(1)
    rows = [{f: r.randrange(100) for f in quality_rules.RATIOS} | {"bad": 0} for _ in range(300)]
    rows += [{f: r.randrange(100) for f in quality_rules.RATIOS} | {"symbol_rate": 300 + r.randrange(99), "bad": 1} for _ in range(90)]
    r.shuffle(rows)
    rules = quality_rules.learn_rules(rows)
    assert rules and rules[0].tests[0][:2] == ("symbol_rate", ">=") and rules[0].wrong == 0


def test_rules_of_several_tests_are_grown_pruned_and_ordered(spark):
    r = random.Random(3)
    row = lambda bad, **own: {f: r.randrange(100) for f in quality_rules.RATIOS} | own | {"bad": bad}
    rows = [row(0) for _ in range(400)]
    # bad only where both hold; either alone is good
    rows += [row(1, symbol_rate=300 + r.randrange(99), word_length=300 + r.randrange(99)) for _ in range(120)]
    rows += [row(0, symbol_rate=300 + r.randrange(99)) for _ in range(120)] + [row(0, word_length=300 + r.randrange(99)) for _ in range(120)]
    rows += [row(1, digit_rate=500 + r.randrange(99)) for _ in range(60)]  # a second, smaller kind
    r.shuffle(rows)
    rules = quality_rules.learn_rules(rows)
    assert [sorted(t[0] for t in x.tests) for x in rules] == [["digit_rate"], ["symbol_rate", "word_length"]]
    assert [x.caught for x in rules] == [60, 120] and not any(x.wrong for x in rules)
    # noise of a few rows is not worth a test of its own
    noisy = [row(0) for _ in range(300)] + [row(1, upper_rate=700 + r.randrange(99)) for _ in range(100)] + [row(0, upper_rate=700 + r.randrange(99)) for _ in range(2)]
    assert [len(x.tests) for x in quality_rules.learn_rules(noisy, purity=0.95)] == [1]


def test_verdicts_are_those_of_the_decision_list(spark):
    texts = sample(4, 80) + [" ".join(f"word{i}###!!" for i in range(80)), " ".join(map(str, range(99))), " ".join(f"word{i}" for i in range(80))]
    rules = [quality_rules.Rule((("symbol_rate", ">=", 100), ("bang_rate", ">=", 50)), 1, 0), quality_rules.Rule((("word_length", "<", 2500),), 1, 0)]
    rows = quality_rules.judge(frame(spark, texts), rules).collect()
    for r in rows:
        ratio = {"symbol_rate": 1000 * r.n_symbols // max(r.word_chars, 1), "bang_rate": 1000 * r.n_bangs // max(r.word_chars, 1), "word_length": 1000 * r.word_chars // max(r.n_words, 1)}
        first = 0 if ratio["symbol_rate"] >= 100 and ratio["bang_rate"] >= 50 else 1 if ratio["word_length"] < 2500 else None
        assert r.rule == (None if r.base_failed else first) and r.kept == (not r.base_failed and first is None)
    assert {r.rule for r in rows} == {0, 1, None}


def test_views_teach_each_other(spark):
    r = random.Random(7)
    word = lambda letters: "".join(r.choice(letters) for _ in range(5))
    good = lambda: "\n".join(" ".join(word("abcde ") for _ in range(8)) for _ in range(6))
    bad = lambda: " ".join(word("vwxyz$#") for _ in range(r.randint(60, 90)))
    texts = [bad() if i % 4 == 0 else good() for i in range(1200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)], "doc_id long, quality int")
    model = cotraining.fit(frame(spark, texts), labels)
    assert all(min(given) > 0 for given in model.pseudo.values()), model.pseudo
    assert (model.both[0] >= 0).all()
    w, _ = cotraining.combine(np.array([[3.0, -1], [2, -2], [-2, 1], [-3, 2], [2.5, -1], [-2, 1.5]]), np.array([1.0, 1, 0, 0, 1, 0]))
    assert (w >= 0).all() and w[0] > 0 and w[1] == 0


def test_classifier(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["sun", "rain", "the", "of", "hill."]) for _ in range(80))
    bad = lambda: " ".join(r.choice(["buy$$$", "##", "%%%", "WIN!!"]) for _ in range(80))
    texts = [good() if i % 4 else bad() for i in range(400)] + [None, ""]
    d = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = cotraining.fit(d, labels)
    rows = {x.doc_id: x for x in cotraining.score(d, model).collect()}
    assert all(rows[i].kept == (i % 4 > 0) for i in range(300, 400)) and len(rows) == 402
    assert {x.doc_id for x in cotraining.keep_good(d, labels).collect()} == {i for i, x in rows.items() if x.kept}
    assert cotraining.score(d, cotraining.fit(d, labels.limit(0))).where("kept").count() == 402
    assert cotraining.score(frame(spark, []), model).count() == 0


def test_sharding(spark):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 101)
    assert {*collections.Counter(table).values()} <= {14, 15}
    moved = sum(a != b for a, b in zip(table, sharding.lookup_table(shards[:-1], 101), strict=True) if a != "s6")
    assert moved < 35
    d = frame(spark, ["a", "b", "c", None], [1, None, 3, 3]).withColumnRenamed("kept", "shard")
    rows = sharding.assign_shards(d, shards, size=101).collect()
    assert len(rows) == 4 and all(r.shard == table[int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:8], 16) % 101] for r in rows)
    assert sharding.assign_shards(frame(spark, []), shards).count() == 0


def test_mixing(spark):
    rows = [(i, None if i % 9 == 8 else "big" if i % 2 else f"s{i % 3}", i) for i in range(700)] + [(None, "big", 0), (1, "big", 1)]
    d = spark.createDataFrame(rows, "doc_id long, source string, w int")
    weights = {"big": 3, "*": 2}
    out = sorted(mixing.mix_sources(d, weights, block_docs=4).collect(), key=lambda r: r.mix_position)
    assert len(out) == 702 and len({r.mix_position for r in out}) == 702
    blocks, seen = [], set()
    for r in out:
        if (k := (r.source, r.mix_block)) not in seen:
            seen.add(k)
            blocks.append((r.source, r.mix_phase, r.mix_release, r.mix_deadline))
    first = [b for b in blocks if b[1] == 0]
    total = sum(3 if s == "big" else 2 for s in {b[0] for b in blocks})
    for n in range(1, len(first) + 1):
        for s in {b[0] for b in blocks}:
            assert abs(sum(b[0] == s for b in first[:n]) - n * (3 if s == "big" else 2) / total) < 1
    assert all(b[2] <= i < b[3] for i, b in enumerate(first))
    assert mixing.mix_sources(d.limit(0), weights).count() == 0
    assert mixing.in_mixed_order(d, weights).columns == d.columns


def test_mix_is_the_schedule_of_earliest_deadlines(spark):
    """The order of blocks against a slot-by-slot simulation."""
    sizes, weights, block = {"a": 37, "b": 90, "c": 11, "d": 4}, {"a": 3, "b": 2, "*": 1}, 4
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=block)
    got = [s for s, _ in itertools.groupby(((r.source, r.mix_block) for r in sorted(out.collect(), key=lambda r: r.mix_position)))]
    left, want = {s: -(-n // block) for s, n in sizes.items()}, []
    while any(left.values()):
        live = [s for s in sorted(left) if left[s]]
        w, done, slot = {s: weights.get(s, weights["*"]) for s in live}, dict.fromkeys(live, 0), 0
        while all(left[s] for s in live):
            period = sum(w.values())
            ready = [(-(-(done[s] + 1) * period // w[s]), s) for s in live if done[s] * period // w[s] <= slot]
            s = min(ready)[1]
            want.append(s)
            done[s], left[s], slot = done[s] + 1, left[s] - 1, slot + 1
    assert [s for s, _ in got] == want
    exact = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=block, stop_when_dry=True)
    assert {r.mix_phase for r in exact.collect()} == {0}


def test_many_sources_share_a_lane(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 5)
    d = spark.createDataFrame([(i, "big" if i % 2 else f"s{i}") for i in range(200)], "doc_id long, source string")
    out = sorted(mixing.mix_sources(d, {"big": 3, "*": 1}, block_docs=2).collect(), key=lambda r: r.mix_position)
    assert len(out) == 200 and sum(r.source == "big" for r in out[:80]) == 60
    with pytest.raises(ValueError):
        mixing.mix_sources(d, {"big": 10**6})


def test_many_sources_are_mixed_as_few_are(spark):
    d = spark.createDataFrame([(i, f"s{i:04d}" if i < 1300 else "big") for i in range(2600)], "doc_id long, source string")
    out = sorted(mixing.mix_sources(d, {"big": 300, "*": 1}, block_docs=2).collect(), key=lambda r: r.mix_position)
    assert len(out) == len({r.mix_position for r in out}) == 2600
    assert len({r.mix_phase for r in out}) == 1301 and all(r.mix_block == 0 for r in out if r.source != "big")  # each source dries by itself


def test_url_filter_with_many_rules(spark, monkeypatch):
    r = random.Random(9)
    name = lambda: r.choice(["a", "b", "c.a", "d.b", "www.a", "e"])
    path = lambda: r.choice(["", "/", "/x", "/x/y", "/z"])
    urls = [f"http://{name()}{path()}{r.choice(['', '?q', '#f', '1'])}" for _ in range(300)] + ["http://" + "h." * 2000 + "a/" + "p" * 30_000, None]
    rules = [(name(), path(), r.choice(["allow", "block"])) for _ in range(40)]
    best = {}
    for h, p, v in rules:
        best[h + p] = max(best.get(h + p, ""), v)
    d = spark.createDataFrame(list(enumerate(urls)) + [(7, urls[7])], "page_id long, url string")
    for limit in (200_000, 3):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
        rows = url_filter.judge_urls(d, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
        assert len(rows) == len(urls) + 1
        for x in rows:
            m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", x.url or "")
            host, p = (m[1], m[2]) if m else ("", "")
            fit = [(len(h + q), best[h + q], h + q) for h, q, _ in rules if (host == h or host.endswith("." + h)) and p.startswith(q)]
            assert (x.rule, x.verdict) == ((max(fit)[2], max(fit)[1]) if fit else (None, "allow"))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://example.org/en/2", "x://de.com/de/", "http://com/fr/", "http://notexample.net", "http://example.org?x=/es/", "http://example.org:80/es/", "a://b://c.com/de/1", "http://xorg/"]
    d = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("org", "/", "allow")], "host string, path string, verdict string")
    for r in url_filter.judge_urls(d, rules).collect():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), v, h + p) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, max(fit)[2] if fit else None, max(fit)[1] if fit else "allow")
    assert url_filter.judge_urls(d.limit(0), rules).count() == 0 and url_filter.judge_urls(d, rules.limit(0)).where("rule is null").count() == len(urls)


def test_html(spark):
    page = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>Big &amp; small</h1><p>First  line,
    it goes on.<p>Second &#233; line<br>here.<aside class="ad">Buy now</aside><form><input value=x>Mail</form></p>
    <section class="comments"><h3>Comments</h3><p>Great post, thanks.</p></section></article><div class=sidebar><p>Related</p></div><footer>&copy; me</footer></body></html>"""
    d = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 3), (3, "u", "", 3), (4, "u", "<p", 3), (5, "u", "<article><p>" + "long text, " * 20000, 3)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_text.extract_text(d).collect()}
    assert got[1].text == "Big & small\nFirst line, it goes on.\nSecond é line here."
    assert (got[2].text, got[3].text, got[4].text) == ("", "", "") and got[5].n_chars == 11 * 20000 - 1 and got[1].n_chars == len(got[1].text)
    assert html_text.extract_text(d.limit(0)).count() == 0


def test_html_parse_does_not_depend_on_depth():
    import time

    def took(n):
        began = time.process_time()
        html_text.parse("<div><b>x " * n + "</i></p>" * n)
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 30 * max(took(4_000), 0.02)
    w = html_text.train()
    inside = "<article><h1>Title</h1><p>Let <math><mi>x</mi></math> be a number, as it is. It goes on, and on.</p><ul><li><b><i><u><s><em><a>one</ul></article>"
    assert html_text.main_text(inside, w).split("\n")[:2] == ["Title", "Let x be a number, as it is. It goes on, and on."]
    tags = [n.tag for n in html_text.parse("<head><title>t</title><p>text<ul><li><b><b><b><b><b><b><b>x<li>y</ul>").nodes]
    assert tags == ["#root", "head", "p", "ul", "li", "li"]


def test_messages_are_exact_on_small_trees():
    import itertools
    import math

    w = html_text.train()
    page = html_text.parse("<div class=content><p>Some text, here.</p><ul><li><a href=x>link</a></li></ul></div>")
    own = html_text.unary(html_text.features(page), w)
    p, _ = html_text.marginals(page, own, w)
    total, one = 0.0, [0.0] * len(p)
    for states in itertools.product((0, 1), repeat=len(p)):
        score = sum(own[i] for i, s in enumerate(states) if s)
        score += sum(w.get(f"{html_text._edge(n)}{states[n.parent]}{states[i]}", 0.0) for i, n in enumerate(page.nodes) if i)
        e = math.exp(score)
        total += e
        for i, s in enumerate(states):
            one[i] += e * s
    assert np.allclose(p, [x / total for x in one], atol=1e-9)


def test_html_held_out():
    w, r = html_text.train(), random.Random(4)
    right = total = 0
    for _ in range(60):
        page = html_text.training_page(r)
        for n, x in zip(page.nodes, html_text.marginals(page, html_text.unary(html_text.features(page), w), w)[0], strict=True):
            if n.chars:
                total += 1
                right += (x >= 0.5) == bool(n.content)
    assert right / total > 0.98


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = sample(6, 40)
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    last = {}
    for i, t in enumerate(texts):
        last[t or ""] = i
    unique = sorted(last.values())
    parts = brute_components([texts[i] for i in unique])
    want = {unique[i] for i, (_, c) in parts.items() if c == i}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_workers_keep_no_cache_of_another_operator():
    packing.WordTokens.at(tokenizer_file()).ids("kept words")
    assert list(common.lean(lambda b: b, keep=True)(iter([1, 2]))) == [1, 2] and packing._CACHE
    assert list(common.lean(lambda b: b)(iter([1, 2]))) == [1, 2] and not packing._CACHE


def test_pipeline_keeps_the_mix(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(packing, "WINDOW", 128)
    r = random.Random(8)
    # the weights are 5 : 1 : 1 : 1; src0 has a third of the rows and longer texts
    sources = ["src0" if i % 3 == 0 else f"s{i % 3}{i % 2}" if i % 3 == 1 else "s9" for i in range(1200)]
    texts = [" ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(r.randint(150, 250) if s == "src0" else r.randint(10, 100))) for s in sources]
    d = spark.createDataFrame([(i, t, "en", s) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], "doc_id long, text string, lang string, source string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 1200
    bins = collections.defaultdict(list)
    for x in rows:
        bins[x.sequence_id].append(x)
    assert sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        b.sort(key=lambda x: x.offset)
        assert [x.offset for x in b] == [sum(y.length for y in b[:i]) for i in range(len(b))] and sum(x.length for x in b) <= 4096
    # a window is 8 blocks of 16: one period of the mix, five of them src0's as long as it lasts (400 rows: five windows)
    window, left = [], 5
    for k in sorted(bins):
        window += [sources[x.doc_id] for x in bins[k]]
        if len(window) >= 128 and left:
            assert len(window) == 128 and window.count("src0") == 80
            window, left = [], left - 1
    assert left == 0


def test_pipeline_stages_follow_labels(spark, tmp_path):
    """All five stages on rows with labels: what the classifier rejects goes, copies go, and pieces fill sequences without gaps."""
    import corpus_pipeline

    r = random.Random(12)
    word = lambda letters: "".join(r.choice(letters) for _ in range(5))
    texts = [" ".join(word("vwxyz$#%") for _ in range(90)) if i % 4 == 0 else "\n".join(" ".join(word("abcdefg") for _ in range(9)) for _ in range(8)) for i in range(600)]
    texts[3], texts[5] = texts[1], texts[9] + " end"
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == {i for i in range(600) if i % 4} - {1, 9}
    bins = collections.defaultdict(list)
    for x in out:
        bins[x.sequence_id].append(x)
    for b in bins.values():
        b.sort(key=lambda x: x.offset)
        assert [x.offset for x in b] == list(itertools.accumulate([0, *(x.length for x in b[:-1])])) and sum(x.length for x in b) <= 4096
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_give_a_row_for_each_row(spark, name):
    sf = "/root/testdata/sf0.001"
    d = QUERIES[name](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = d.collect()
    if name.startswith(("op1_", "op2_")):
        assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in spark.read.parquet(f"{sf}/pages.parquet").collect())
        return
    if name != "op7_best_fit_packing":
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    if name == "op3_ngram_jaccard_join":
        docs.sort(key=lambda r: r.doc_id)
        want = brute_components([r.text for r in docs])
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {docs[i].doc_id: (n, docs[c].doc_id) for i, (n, c) in want.items()}
    if name == "op7_best_fit_packing":
        used = collections.Counter()
        for r in rows:
            used[r.sequence_id] += r.length
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs} and max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 1


def test_recent_words_are_bounded_and_made_again_when_forgotten():
    asked = []

    def make(key):
        asked.append(key)
        return key.upper()

    known = packing.Recent(2, make)
    assert [known[k] for k in "abab"] == list("ABAB") and asked == ["a", "b"]
    assert known["c"] == "C" and known["a"] == "A" and asked == ["a", "b", "c"]  # of the old generation
    assert [known[k] for k in "def"] == list("DEF") and len(known) <= 2 and len(known.old) <= 2
    assert known["b"] == "B" and asked.count("b") == 2
    long = "x" * (packing.CACHE_LENGTH + 1)
    assert known[long] == long.upper() and long not in known
