"""The secret scan: base spans against the plain definition, the models on held-out strings."""

import base64
import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from loadlark.llm import secrets_markov

DOCS = "doc_id long, text string"
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def brute_base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(found))


def noise(rng):
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "API_KEY", "AKIA", "akia", '"', "'", " ", "  ", ":", "=", "é", "𝄞", "\n", "\t", "x.y", "+/", "_-", "word", "AKIAAKIA"]
    out = []
    for _ in range(rng.randint(0, 40)):
        pick = rng.randrange(10)
        if pick < 7:
            out.append(rng.choice(parts))
        elif pick == 7:
            out.append("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([3, 8, 16, 31, 32, 33, 64]))))
        elif pick == 8:
            out.append("".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(rng.choice([5, 11, 12, 13, 30]))))
        else:
            out.append("".join(rng.choice(string.ascii_letters) for _ in range(rng.choice([1, 7, 8, 9]))))
    return "".join(out)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(21)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 150))) for i in range(200)], DOCS)
    return secrets_markov.fit(docs)


def test_base_spans_equal_the_definition(spark, model):
    rng = random.Random(17)
    rows = [(i, noise(rng)) for i in range(400)] + [(500, None), (501, ""), (502, "a" * 300_000 + " token=" + "Z" * 5000), (7, "secret: token = abcdefghij")]
    docs = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], DOCS + ", s int, spans int, base int")
    for (i, t), r in zip(rows, secrets_markov.scan(docs, model).collect(), strict=True):
        want = brute_base(t or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (i, t)
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if not x.startswith("markov")] == (want.split(",") if want else [])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [want.count(k) for k in ("assign:", "access:", "hex:")]
        covered = [tuple(map(int, x.split(":")[1:])) for x in want.split(",") if x]
        for x in spans:
            if x.startswith("markov"):
                a, z = map(int, x.split(":")[1:])
                assert all(z <= b or e <= a for b, e in covered)


def names(rng):
    w = words(rng, 9)
    return rng.choice([
        "_".join(w[:5]), "-".join(w[:5]), "".join(x.capitalize() for x in w[:6]), "_".join(w[:5]).upper(), "/" + "/".join(w[:5]), "/".join(w[:3]) + "/" + "-".join(w[3:6]),
        "_".join(w[:4]) + "_" + str(rng.randrange(1900, 2030)), w[0] + "".join(x.capitalize() for x in w[1:6]), "-" * 40, "=" * 30,
    ])


def secret(rng):
    raw = rng.randbytes(30)
    letters = string.ascii_letters + string.digits
    return rng.choice([base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw[:24]).decode(), "".join(rng.choice(letters) for _ in range(rng.randint(22, 40))), raw[:14].hex()])


def test_held_out_secrets_are_found_and_identifiers_are_not(spark, model):
    rng = random.Random(99)
    found = [(i, f"{' '.join(words(rng, 6))} {secret(rng)} {' '.join(words(rng, 6))}") for i in range(400)]
    behind = [(1000 + i, f"{' '.join(words(rng, 4))} /{'/'.join(words(rng, 5))}/{secret(rng)} end") for i in range(200)]
    clean = [(2000 + i, f"{' '.join(words(rng, 6))} {names(rng)} {' '.join(words(rng, 6))}") for i in range(1000)]
    got = {r["doc_id"]: r["n_markov"] for r in secrets_markov.scan(spark.createDataFrame(found + behind + clean, DOCS), model).collect()}
    assert sum(got[i] > 0 for i, _ in found) >= 0.95 * len(found)
    assert sum(got[i] > 0 for i, _ in behind) >= 0.9 * len(behind)
    assert sum(got[i] > 0 for i, _ in clean) <= 2


def test_rest_of_an_overlapped_run_is_scored(spark, model):
    key = "q7Zx9KpLm2Vw8RtYb4NcD1sFhJ3"
    text = f"see {'0123456789abcdef' * 2}/{key} ok"
    row = secrets_markov.scan(spark.createDataFrame([(1, text)], DOCS), model).first()
    hex_, markov = (tuple(map(int, x.split(":")[1:])) for x in row["spans"].split(","))
    assert hex_ == (4, 36) and markov[0] >= 36 and text[markov[0] : markov[1]].strip("/") == key


def test_redaction_keeps_columns_of_any_name(spark, model):
    text = "x token: abcdefgh12 y"
    docs = spark.createDataFrame([(1, text, "mine", "own")], DOCS + ", _secret_spans string, spans string")
    row = secrets_markov.redact(docs, model).first()
    assert row.asDict() == {"doc_id": 1, "text": "x [SECRET] y", "_secret_spans": "mine", "spans": "own"}
    assert secrets_markov.redact(docs.select(F.lit(1).alias("doc_id"), F.lit(None).cast("string").alias("text")), model).first()["text"] is None


def test_each_base_span_has_the_ratio_of_the_models(spark, model):
    """The ratio, transition by transition, of the assigned value or the whole span; random values lie above the cut, names below."""
    rng = random.Random(3)
    random_hex = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f"x token={random_hex}, AKIA{'QX7ZJ2KV9WLM4T8R'} y", "password: therein_under_thereof", "api_key=" + "a" * 10, "", None]
    rows = secrets_markov.scan(spark.createDataFrame(list(enumerate(texts)), DOCS), model).collect()
    alphabet, size = secrets_markov.ALPHABET, secrets_markov.SIZE

    def mean(value):
        at = [alphabet.index(c) for c in value]
        ratios = [round(model.ratio[a * size + b], 3) for a, b in zip(at, at[1:], strict=False)]
        windows = [sum(ratios[i : i + secrets_markov.LEAST - 1]) / (secrets_markov.LEAST - 1) for i in range(len(ratios) - secrets_markov.LEAST + 2)]
        return max([sum(ratios) / len(ratios), *windows])

    seen = {}
    for r, t in zip(rows, texts, strict=True):
        for x in r["base_ratios"].split(","):
            if x:
                kind, a, z, ratio = x.split(":")
                value = t[int(a) : int(z)]
                value = re.search("[:=] ?(.+)", value)[1] if kind == "assign" else value
                assert abs(float(ratio) - mean(value)) < 0.011, (x, mean(value))
                seen[kind, value[:5]] = float(ratio)
        assert [x.rpartition(":")[0] for x in r["base_ratios"].split(",") if x] == [x for x in r["spans"].split(",") if x and not x.startswith("markov")]
    assert min(v for (k, x), v in seen.items() if x in (random_hex[:5], "AKIAQ")) > model.cut > seen["assign", "there"]
