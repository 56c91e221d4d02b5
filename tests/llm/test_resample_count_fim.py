"""Importance resampling, token counts and fill-in-middle against brute force, with nulls, long texts, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loadlark.llm import fim_rope, resync, tokens, word_ids

DOCS = "doc_id long, text string, rank int, row string, _row long"
WORDS = ["the", "Load", "über", "straße", "x1", "don't", "日本", "a", "load", "αβγ", "run-up"]


def sample(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", "\n", ", ", "  "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, sample(rng, rng.randint(1, 60))) for i in range(60)]
    out += [(70, None), (71, ""), (72, " \n\t"), (73, "a<P>b"), (74, "<S>"), (75, "x" * 20_000), (76, sample(rng, 20_000))]
    out += [(80, out[0][1]), (81, out[0][1]), (82, out[3][1]), (82, out[3][1]), (None, out[4][1]), (None, out[5][1])]
    return [(i, t, 7, "r", 1) for i, t in out]


# importance resampling


def brute_features(text, longest):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = Counter(" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    out = Counter()
    for g, n in runs.items():
        out[g] += n
    return len(w), out


def brute_resample(rows, target, plan):
    own = [(i, *brute_features(t, plan.longest)) for i, t, *_ in rows]
    bucket = lambda g: zlib.crc32(g.encode()) % plan.buckets
    s, t = Counter(), Counter()
    for _, _, f in own:
        for g, n in f.items():
            s[bucket(g)] += n
    for text in target:
        for g, n in brute_features(text, plan.longest)[1].items():
            t[bucket(g)] += n
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + plan.buckets) / ((s[b] + 1) * (all_t + plan.buckets)))) for b in range(plan.buckets)]
    scored = []
    for i, n_words, f in own:
        weight = sum(gain[bucket(g)] * n for g, n in f.items())
        h = int(hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((x for x in scored if x[4] >= plan.min_words), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    ranks = {}
    for k, x in enumerate(able[: plan.percent * len(able) // 100], 1):
        ranks.setdefault(x, []).append(k)
    return Counter((*x[:4], ranks[x].pop() if ranks.get(x) else None) for x in scored)


@pytest.mark.parametrize("plan", [word_ids.Plan(percent=30), word_ids.Plan(longest=3, buckets=500, percent=40, min_words=5, kept=20)])
def test_resampling_equals_brute_force(spark, rows, plan):
    target = ["load über load", None, "", "日本 don't run the load"]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = word_ids.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), plan)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute_resample(rows, target, plan)


def test_resampling_of_empty_tables_and_equal_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert word_ids.resample(none, none).count() == 0
    same = spark.createDataFrame([(5, "one two " * 20)] * 40, "doc_id long, text string")
    got = word_ids.resample(same, none, word_ids.Plan(percent=50))
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 21)) and got.select("score").distinct().count() == 1


def test_a_tuple_is_hashed_once_and_the_dictionary_is_bounded():
    known = word_ids.Dictionary(word_ids.Plan(longest=2, kept=50))
    import numpy as np

    data = np.frombuffer(b"a b a b a", np.uint8)
    n, row, bucket, count = known.counted(data, np.array([0, 9]))
    assert n.tolist() == [5] and known.members == [(0,), (1,), (0, 1), (1, 0)] and count.tolist() == [3, 2, 2, 2]
    assert bucket.tolist() == [zlib.crc32(x) % 10_000 for x in (b"a", b"b", b"a b", b"b a")]
    known.counted(data, np.array([0, 9]))
    assert len(known.members) == 4
    many = np.frombuffer(" ".join(f"w{i}" for i in range(100)).encode(), np.uint8)
    known.counted(many, np.array([0, len(many)]))
    known.counted(data, np.array([0, 9]))
    assert len(known.words) == 2


# token counts


ODD = ["é", "́", "한", "ﬁ", "Å", "İ", "ΣΑΣ", "🙂", "'s", "'re", "n't", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startof", "12345", "日本語の文", "　", "!!!'s", "\x00", "á̧"]


@pytest.fixture(scope="module")
def path():
    return tokens.default_path("word_bpe_49k.json")


def brute_counts(rows, path):
    t = resync.tokenizer(path)
    return Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows)


def test_token_counts_equal_the_library(spark, rows, path):
    got = resync.counts(spark.createDataFrame(rows, DOCS), path)
    assert Counter(tuple(r) for r in got.collect()) == brute_counts(rows, path)
    assert resync.counts(spark.createDataFrame([], DOCS), path).count() == 0


def test_small_chunks_of_odd_texts_equal_the_library(spark, path):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD + WORDS + [" ", " ", "\n", "  "]) for _ in range(rng.randint(50, 400))) for _ in range(120)]
    texts += ["word" * 300, " " * 900, "a" * 500 + " b" * 50 + "c" * 700, "é" * 400, "́" * 700, "'s" * 300, "<|endoftext|>" * 60, "日" * 600]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = resync.counts(docs, path, resync.Plan(chunk=90, overlap=70, margin=32))
    assert Counter(tuple(r) for r in got.collect()) == brute_counts(rows, path)


def test_other_tokenizer_and_default_chunks_of_a_very_long_text(spark, rows):
    other = tokens.default_path("byte_bpe_50k.json")
    long = [(1, sample(random.Random(4), 30_000)), (2, "x" * 70_000)]
    got = resync.counts(spark.createDataFrame(long, "doc_id long, text string"), other)
    assert Counter(tuple(r) for r in got.collect()) == brute_counts(long, other)


def test_only_the_failing_pair_is_widened(spark, path):
    plan = resync.Plan(chunk=100, overlap=80, margin=32)
    text = "ab " * 100 + "y" * 250 + " cd" * 100
    texts = spark.createDataFrame([(0, text)], "row long, text string")
    cuts = [0, 100, 200, 300, 400, 500, 600, 700, len(text)]
    pieces = [(0, a, b, 80 if b < len(text) else 0, 80 if a else 0, len(text)) for a, b in zip(cuts, cuts[1:])]
    first = resync.encode(texts, spark.createDataFrame(pieces, resync._PIECE_SQL), path, plan)
    found = resync.spliced(first)
    failed = {r["start"] for r in found.filter("n is null").collect()}
    assert failed and failed <= {200, 300, 400}
    asked = {r["start"]: r for r in resync.widened(found).collect()}
    assert not asked[0]["changed"] and not asked[700]["changed"] and any(r["changed"] for r in asked.values())
    assert sorted(r["start"] for r in asked.values())[0] == 0 and max(r["next"] for r in asked.values()) == len(text)


# fill-in-middle


def brute_fim(i, text, plan):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in plan.marks) or h[2] % 100 >= plan.changed:
        return i, len(units), "plain", None, None, text, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < plan.spm:
        return i, len(units), "spm", len(p), len(m), plan.suffix_mark + s + plan.prefix_mark + p + plan.middle_mark + m, text
    return i, len(units), "psm", len(p), len(m), plan.prefix_mark + p + plan.suffix_mark + s + plan.middle_mark + m, text


@pytest.mark.parametrize("plan", [fim_rope.Plan(), fim_rope.Plan(seed=9, changed=100, spm=50, prefix_mark="«pre|", suffix_mark="«suf|", middle_mark="«mid|")])
def test_fill_in_middle_equals_brute_force(spark, rows, plan):
    got = fim_rope.restore(fim_rope.transform(spark.createDataFrame(rows, DOCS), plan), plan)
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_fim(i, t, plan) for i, t, *_ in rows)
    forms = {r["form"] for r in got.collect()}
    assert forms == {"plain", "psm", "spm"}


def test_empty_table_and_long_text(spark):
    assert fim_rope.restore(fim_rope.transform(spark.createDataFrame([], DOCS))).count() == 0
    text = sample(random.Random(8), 200_000)
    rows = [(i, text) for i in range(4)]
    got = fim_rope.restore(fim_rope.transform(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {(r["doc_id"], r["n"], r["output"], r["restored"]) for r in got.collect()} == {(x[0], x[1], x[5], x[6]) for x in (brute_fim(i, t, fim_rope.Plan()) for i, t in rows)}


def test_rope_splits_at_any_rank_and_keeps_its_counts():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "日", "<"]) * rng.randint(1, 9) for _ in range(rng.randint(0, 60)))
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        rope = fim_rope.Rope.of(text, leaf=7)
        assert (rope.units, rope.chars, str(rope)) == (len(units), len(text), text)
        k = rng.randint(0, len(units))
        a, b = rope.split_units(k)
        assert (str(a), str(b), a.units, b.units, a.chars + b.chars) == ("".join(units[:k]), "".join(units[k:]), k, len(units) - k, len(text))
        c, d = rope.split_chars(len(str(a)))
        assert (str(c), str(d), c.units, d.units) == (str(a), str(b), a.units, b.units)


def test_marks_that_could_arise_across_a_seam_are_refused():
    with pytest.raises(ValueError):
        fim_rope.Plan(prefix_mark="<<P>")
    with pytest.raises(ValueError):
        fim_rope.Plan(prefix_mark="<P>", suffix_mark="<P>")


def test_draws_are_the_digest(spark):
    r = spark.range(1).select(*fim_rope.draws(F.lit(12), 1)).first()
    h = hashlib.sha256(b"1:12").hexdigest()
    assert tuple(r) == tuple(int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
