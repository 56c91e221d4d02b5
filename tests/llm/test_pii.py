"""Personal data: base spans against the plain definition, added spans on held-out planted forms."""

import hashlib
import math
import random
import re

import pytest

from loadlark.llm import pii

DOCS = "doc_id long, text string"
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng, n):
    return " ".join(w + rng.choice(["", "", "", ".", ","]) for w in words(rng, n))


def luhn(d):
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(found))


def noise(rng):
    parts = ["a", "Bc", "1", "23", "255", "256", "4111", "1111", ".", ".", "-", " ", "@", "@", "+", "(", ")", "é", "𝄞", "%", "_", "\n", "4111 1111 1111 1111", "+49 170 1234567", "a@b.c", "10.0.0.1", "x(at)y.com"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    return pii.fit(spark.createDataFrame([(i, prose(rng, 80)) for i in range(1500)], DOCS))


def test_base_spans_equal_the_definition(spark, model):
    rng = random.Random(12)
    rows = [(i, noise(rng)) for i in range(500)] + [(600, None), (601, ""), (602, "4 " * 20_000), (603, "a" * 50_000 + "@" + "b." * 20_000), (604, "1." * 30_000), (7, "+1 (555) 555-0199")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], DOCS + ", kind int, s int")
    for (i, t), r in zip(rows, pii.scan(docs, model).collect(), strict=True):
        want = brute_base(t or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (i, t)
        assert [x for x in r["spans"].split(",") if x and not x.startswith("loose")] == [x for x in want.split(",") if x]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(re.findall(f"{k}:", want)) for k in pii.KINDS]


def planted(rng):
    u, h, t = rng.choice(words(rng, 1)) + str(rng.randrange(100)), words(rng, 1)[0] + "x", rng.choice(["com", "org", "de", "net"])
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    ip = [str(rng.randrange(256)) for _ in range(4)]
    kind = rng.randrange(3)
    if kind == 0:
        cue, form = rng.choice(["mail ", "contact me: ", ""]), rng.choice([f"{u} (at) {h} (dot) {t}", f"{u}[at]{h}.{t}", f"{u} at {h} dot {t}", f"{u} @ {h}.{t}", f"{u}(at){h}(dot){t}"])
    elif kind == 1:
        cue, form = rng.choice(["phone ", "call ", "Tel: "]), rng.choice([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0049 {n(3)} {n(7)}"])
    else:
        cue, form = rng.choice(["server ", "host ", ""]), rng.choice(["[.]".join(ip), "(.)".join(ip), " dot ".join(ip)])
    return kind, cue + form, form


def look_alike(rng):
    n = lambda a, z: str(rng.randint(a, z))
    w = words(rng, 3)
    return rng.choice([
        f"on {n(1990, 2025)}-0{n(1, 9)}-{n(10, 28)} {n(10, 23)} {n(10, 59)}", f"order {n(10_000_000, 19_999_999)}", f"look at {w[0]}.{w[1].capitalize()}", f"version {n(1, 9)}.{n(0, 20)}.{n(256, 900)}.1",
        f"{n(10, 23)}:{n(10, 59)}:{n(10, 59)}:{n(10, 99)}", f"from 1{n(100, 999)}-1{n(100, 999)} on", f"{n(1, 9)} {n(100, 999)} {n(100, 999)} 000", f"{w[0]} at {w[1]}, {w[2]}",
    ])


def test_added_spans_are_found_on_held_out_forms(spark, model):
    rng = random.Random(77)
    assert all(c < math.inf for c in model.cuts)
    found = [(i, *planted(rng)) for i in range(600)]
    rows = [(i, f"{prose(rng, 8)} {text} {prose(rng, 6)}") for i, _, text, _ in found] + [(1000 + i, f"{prose(rng, 8)} {look_alike(rng)} {prose(rng, 6)}") for i in range(600)]
    rows += [(2000 + i, prose(rng, 120)) for i in range(300)]
    got = {r["doc_id"]: r for r in pii.scan(spark.createDataFrame(rows, DOCS), model).collect()}
    texts = dict(rows)
    for kind in range(3):
        own = [(i, form) for i, k, _, form in found if k == kind]
        hits = 0
        for i, form in own:
            a = texts[i].index(form)
            spans = [tuple(map(int, x.split(":")[1:])) for x in got[i]["spans"].split(",") if x.startswith("loose")]
            hits += any(s < a + len(form) and a < e for s, e in spans)
        assert hits >= 0.9 * len(own), (kind, hits, len(own))
    false = sum(got[1000 + i]["n_added"] > 0 for i in range(600))
    assert false <= 12, false
    assert not sum(got[2000 + i]["n_added"] for i in range(300))


def test_every_candidate_shows_its_score(spark, model):
    rows = [(1, "mail a.b (at) cdx (dot) org now, +1 (555) 555-0199, 10.1.2.3 and 4111 1111 1111 1112 too"), (2, "nothing here"), (3, None)]
    got = pii.scan(spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", scores string"), model).collect()
    said = [x.split(":") for x in got[0]["scores"].split(",")]
    assert [int(x[1]) for x in said] == sorted(int(x[1]) for x in said) and {x[0] for x in said} == set(pii.GENERATORS)
    cut = dict(zip(pii.GENERATORS, model.cuts, strict=True))
    base = [tuple(map(int, x.split(":")[1:])) for x in got[0]["spans"].split(",") if not x.startswith("loose")]
    kept = {tuple(x[:3]) for x in said if float(x[3]) >= cut[x[0]] - 0.006 and not any(a < int(x[2]) and int(x[1]) < z for a, z in base)}
    assert kept == {tuple(x.split(":")) for x in got[0]["spans"].split(",") if x.startswith("loose")} and got[0]["n_added"] == len(kept) > 0
    assert any(float(x[3]) < cut[x[0]] for x in said) and got[1]["scores"] == got[2]["scores"] == ""


def test_forms_that_the_trainer_never_plants(spark, model):
    """Other letters, brackets and signs than those it learns from: what is proposed is mostly kept, what isn't a form isn't."""
    rng = random.Random(15)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    forms = [lambda u, h: f"{u} [AT] {h} [DOT] com", lambda u, h: f"<{u}(at){h}.org>", lambda u, h: f"{u} AT {h} DOT net", lambda u, h: f"Fon: ({n(4)}) {n(3)} {n(4)}", lambda u, h: f"{n(3)} {n(3)} {n(4)} (cell)"]
    rows, at = [], []
    for i in range(500):
        form = forms[i % 5](words(rng, 1)[0] + n(2), words(rng, 1)[0] + "x")
        rows.append((i, f"{prose(rng, 8)} {form} {prose(rng, 6)}"))
        at.append(form)
    got = {r["doc_id"]: r["n_added"] > 0 for r in pii.scan(spark.createDataFrame(rows, DOCS), model).collect()}
    share = [sum(got[i] for i in range(k, 500, 5)) for k in range(5)]
    print("found of 100 each:", share)
    assert sum(share) >= 250, share
