"""Benchmark decontamination against a plain semi-global edit distance of all pairs; short items, long texts."""

import random

import numpy as np

from loadlark.llm import arrowtext, decontaminate

DOCS = "doc_id long, text string"
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def letters(text):
    return "".join(c for c in text.lower() if c.isascii() and c.isalnum())


def least_edits(item, text):
    """Edits of the whole item against the best part of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, x in enumerate(item, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        if chars[k] != " ":
            rng.choice([lambda: chars.__setitem__(k, rng.choice("abcdefgh")), lambda: chars.pop(k), lambda: chars.insert(k, rng.choice("xyz"))])()
    return "".join(chars)


def test_occurrences_equal_brute_force(spark):
    rng = random.Random(41)
    items = [(i, prose(rng, rng.choice([8, 12, 20, 30]))) for i in range(10)]
    items.append((20, items[0][1]))  # the same item twice
    docs = []
    for i in range(90):
        parts = [prose(rng, rng.randint(0, 20))]
        for _ in range(rng.randint(0, 2)):
            _, text = rng.choice(items)
            n = len(letters(text))
            parts += [edited(rng, text, rng.randint(0, int(0.13 * n))), prose(rng, rng.randint(0, 15))]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    plan = decontaminate.Plan()
    want = {}
    for d, text in docs:
        for it, item in items:
            a = letters(item)
            e = least_edits(a, letters(text))
            if e <= plan.budget(len(a)):
                want[d, it] = e
    d = spark.createDataFrame([(*x, 0, 0) for x in docs], DOCS + ", item_id int, start int")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.occurrences(d, b).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in rows} == want and len(rows) == len(want) > 40
    assert sum(0 < e for e in want.values()) >= 10
    for r in rows:
        part = letters(dict(docs)[r["doc_id"]][r["start"] : r["end"]])
        assert least_edits(letters(dict(items)[r["item_id"]]), part) == r["edits"]
    assert {r["doc_id"] for r in decontaminate.clean(d, b).collect()} == {x for x, _ in docs} - {x for x, _ in want}


def test_short_items_are_searched_exactly_between_word_ends(spark):
    rng = random.Random(31)
    items = [(1, "Why is the sky so blue?"), (2, "H2O"), (3, ""), (4, "?!"), (5, "forty two"), (6, "h2o"), (7, "seven of nine")]
    docs = [(1, prose(rng, 40) + " why is the SKY so blue " + prose(rng, 20)), (2, prose(rng, 40) + " why is the sea so blue " + prose(rng, 20)), (3, "xh2o h2ox (H2O)"), (4, "h2"), (4, "forty-two"),
            (5, "fortytwofold forty twos"), (6, None), (8, "é seven OF nine"), (9, "h2o")]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.occurrences(d, b).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in got) == [(1, 1, 0), (3, 2, 0), (3, 6, 0), (4, 5, 0), (8, 7, 0), (9, 2, 0), (9, 6, 0)]
    at = {(r["doc_id"], r["item_id"]): (r["start"], r["end"]) for r in got}
    assert docs[2][1][slice(*at[3, 2])] == "H2O" and docs[7][1][slice(*at[8, 7])] == "seven OF nine" and docs[0][1][slice(*at[1, 1])] == "why is the SKY so blue"
    assert sorted((r["doc_id"], r["text"] or "") for r in decontaminate.clean(d, b).collect()) == [(2, docs[1][1]), (4, "h2"), (5, docs[5][1]), (6, "")]


def test_very_long_text(spark):
    rng = random.Random(6)
    item = prose(rng, 40)
    long = " ".join([prose(rng, 150_000), item, prose(rng, 1000)])
    docs = spark.createDataFrame([(1, long), (2, "a" * 100_000), (3, "the " * 100_000)], DOCS)
    b = spark.createDataFrame([(1, item), (2, "a" * 60)], "item_id long, text string")
    got = decontaminate.occurrences(docs, b).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in got) == [(1, 1, 0), (2, 2, 0)]
    one = next(r for r in got if r["doc_id"] == 1)
    assert long[one["start"] : one["end"]] == item


def test_folding_equals_the_characters_one_by_one():
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(32, 0x600), *range(0x1E00, 0x2200), *range(0x3000, 0x3100), 0x212A, 0x212B, 0x2C65, 0x2C66, 0x10400, 0x10428, 0x1F600, 0xFF21, 0xFF41, 0x4E2D]]
    back = {"\u2c65": "\u023a", "\u2c66": "\u023e"}  # the lower case is longer

    def one(c):
        forms = [[x for x in f if x.isalnum()] for f in (c.casefold(), c.lower())] if c.isalnum() else []
        return "".join(forms[0] if forms and len(forms[0]) == 1 else forms[1] if forms else "")

    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        chars, at = arrowtext.folded(np.frombuffer(text.encode(), np.uint8))
        want = [back.get(x, x) for x in map(one, text)]
        assert chars.tobytes().decode() == "".join(want)
        ends, end = [], 0
        for c, x in zip(text, want, strict=True):
            end += len(c.encode())
            ends += [end - 1] * bool(x)
        assert [int(at[i]) for i in np.cumsum([len(x.encode()) for x in want if x], dtype=int) - 1] == ends


def test_signs_and_case_of_any_script_hide_nothing(spark):
    items = [
        (1, 'She said "no", he said "yes", and "maybe" was said - twice - by "them" and by "us" at noon'), (2, "Πού βρίσκεται ο μεγαλύτερος ναός της αρχαίας πόλης και ποιος τον έχτισε"),
        (3, "Сколько лет было поэту, когда вышла его первая большая книга стихов"), (4, "Zażółć gęślą jaźń i powiedz: příliš žluťoučký kůň úpěl ďábelské ódy"), (5, "第一回の大会は何年に開かれましたか、そして誰が優勝しましたか"),
    ]
    docs = [
        (1, "x “" + items[0][1].replace('"', "”").replace(" - ", "—").replace(" ", "\u2009") + "” y"), (2, "α " + items[1][1].upper() + "."), (3, items[2][1].upper().replace(" ", "\u00a0")),
        (4, items[3][1].swapcase() + "…"), (5, "「" + items[4][1].replace("、", "・") + "」"), (6, items[1][1].upper()[: len(items[1][1]) // 2]),
    ]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.occurrences(d, b).collect()}
    assert set(got) == {(i, i) for i in range(1, 6)} and all(r["edits"] == 0 for r in got.values())
    assert docs[1][1][got[2, 2]["start"] : got[2, 2]["end"]] == items[1][1].upper() and docs[4][1][got[5, 5]["start"] : got[5, 5]["end"]] == items[4][1].replace("、", "・")
    assert [r["doc_id"] for r in decontaminate.clean(d, b).collect()] == [6]


def test_items_of_sixteen_letters_and_more_may_have_edits(spark):
    """Every item with one wrong letter, as soon as the lemma and the share of errors allow one."""
    rng = random.Random(12)
    plan = decontaminate.Plan()
    assert [plan.budget(n) for n in (0, 8, 15, 16, 24, 25, 36, 40, 100)] == [0, 0, 0, 1, 1, 2, 2, 3, 8]
    items, docs = [(0, "What is the capital city of the country Peru")], [(0, "Ask: what is the capital city of the kountry Peru?")]
    for i in range(1, 80):
        text = prose(rng, 30).replace(" ", "")[: 13 + i % 30]
        at = rng.randrange(len(text))
        items.append((i, text))
        docs.append((i, prose(rng, 12) + " " + text[:at] + "q" + text[at + 1 :] + " " + prose(rng, 9)))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.occurrences(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        for it, item in items:
            e = least_edits(letters(item), letters(text))
            if e <= plan.budget(len(letters(item))) and (e or plan.budget(len(letters(item)))):
                want[d, it] = e
    assert got == want and all((i, i) in got for i, t in items if len(letters(t)) >= 16)
