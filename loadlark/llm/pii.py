"""Personal data: format rules, and boosted trees over high-recall candidates.

Base spans are those of four fixed formats. Beside them loose generators
propose overlapping candidates: addresses with a written-out, bracketed or spaced
sign, number groups, dotted groups with bracketed or spaced dots. Each has a few
coarse features of its format (sign, digits, groups, separators, how it ends) and
context (the characters on either side, a cue word before it); none says whether
a base format matches.

The trees are trained on all documents. Right are candidates over
planted forms, personal data as people write it around filters, set into pieces
of each document's own text with and without a cue word, and those over base spans;
wrong are the documents' other candidates and planted look-alikes (dates, order
numbers, versions, times, book numbers, a site after "at"). All candidates fall
into cells of equal features, on which boosting of depth-two trees runs. The cells
of every fifth document are held out and calibrate one cut for each generator: the
least score from which the wanted share of candidates is right, were ``prior`` of
all candidates right. Trees are compiled into one expression over features that
are computed once, so the scan is a plain DataFrame expression.

Candidates at or above their cut that overlap no base span are added.

Defined cases: null and empty texts have no spans; repeated rows are scanned
each; an empty table has an empty result and a model that adds nothing; other
columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, let, regex_spans

# Base formats. A match starts at the start of a run of its characters, or where
# the last one ended; loops are possessive: the same matches, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[ -]?[0-9]){13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
GENERATORS = ("loose_email", "loose_number", "loose_dotted")
PATTERNS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:@|\(at\)|\[at\]|(?<= )at(?= )) ?[A-Za-z0-9-]{2,63}+(?:(?:\.| \. | ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z]{2,20}+){1,4}",
    r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,24}(?![0-9A-Za-z])",
    r"(?<![0-9.])[0-9]{1,4}(?:(?:[.:]| \. | ?\[\.\] ?| ?\(\.\) ?| dot )[0-9]{1,4}){3,7}(?![0-9])",
)
#: What each match of the first generator holds, where it isn't a sign of its own.
SPELLED = r" at [A-Za-z0-9-]{2,63}+(?:\.| \. | ?\(dot\)| ?\[dot\]| dot )[A-Za-z]"
CUE = r"(?i)(mail|phone|tel|call|mobile|fax|contact|write|reach|card|visa|account|iban|ip|host|server|addr)[a-z]*[ :.=#-]{0,3}$"
TLDS = ("com", "net", "org", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "nl", "br", "pt", "us", "ca", "au", "jp", "in", "cn")
#: Feature -> number of values. Their product bounds the cells.
FEATURES = {
    "gen": 3, "sign": 4, "digits": 6, "groups": 5, "seps": 4, "lead": 3, "first": 4, "last": 4, "fits": 2, "before": 4, "after": 4, "cue": 2,
}


@dataclass(frozen=True)
class Fit:
    rounds: int = 60
    rate: float = 0.3
    right: float = 0.9
    prior: float = 0.05
    least: int = 20


Tree = tuple[tuple[str, int], tuple[tuple[str, int], float, float], tuple[tuple[str, int], float, float]]


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Tree, ...]
    cuts: tuple[float, ...]

    def score(self, f: Callable[[str], Column]) -> Column:
        """Log odds of a candidate; ``f`` gives the column of each feature."""
        total = F.lit(self.start)
        for (a, x), ((b, y), b0, b1), ((c, z), c0, c1) in self.trees:
            total = total + F.when(f(a) <= x, F.when(f(b) <= y, F.lit(b0)).otherwise(F.lit(b1))).otherwise(
                F.when(f(c) <= z, F.lit(c0)).otherwise(F.lit(c1))
            )
        return total


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _kind(spans: Column, number: int, kind: str, holds=None) -> Column:
    return F.transform(
        F.filter(spans, holds) if holds else spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"),
            s["end"].alias("end"), s["value"].alias("value"),
        ),
    )


NO_SPANS = "cast(array() as array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>)"


def _where(holds: Column, spans: Column) -> Column:
    return F.when(holds, spans).otherwise(F.expr(NO_SPANS))


def base_spans(t: Column) -> Column:
    """``array<struct<start, kind_no, kind, end, value>>`` of the fixed formats in a text that isn't null.

    A format is only looked for where the text has a character that each of its matches has.
    """
    small = lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    card = lambda s: let(_digits(s["value"]), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d))
    phone = lambda s: F.length(_digits(s["value"])).between(10, 15)
    numbers = let(
        t.rlike("[0-9]"),
        lambda has: F.concat(
            _where(has, _kind(regex_spans(t, IP), 1, KINDS[1], small)), _where(has, _kind(regex_spans(t, CARD), 2, KINDS[2], card)),
            _where(has & t.contains("+"), _kind(regex_spans(t, PHONE), 3, KINDS[3], phone)),
        ),
    )
    return F.concat(_where(t.contains("@"), _kind(regex_spans(t, EMAIL), 0, KINDS[0])), numbers)


def candidates(t: Column) -> Column:
    """``array<struct<start, kind_no, kind, end, value, left, right>>`` of the generators, with the text around each."""
    signs = t.contains("@") | t.contains("(at)") | t.contains("[at]") | (t.contains(" at ") & t.rlike(SPELLED))
    digits = t.rlike("[0-9]")
    found = F.concat(*(_where(signs if i == 0 else digits, _kind(regex_spans(t, p), 4 + i, GENERATORS[i])) for i, p in enumerate(PATTERNS)))
    return F.transform(
        found,
        lambda s: s.withField("left", F.substring(t, F.greatest(s["start"] - 15, F.lit(1)), F.least(s["start"], F.lit(16)))).withField(
            "right", F.substring(t, s["end"] + 1, F.lit(1))
        ),
    )


def features(s: Column) -> Column:
    """A struct of small whole numbers, from 0, of a candidate."""
    bins = lambda x, edges: sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0))
    kind = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z0-9]"), 2).otherwise(3)

    def of(v: Column, d: Column, parts: Column) -> Column:
        octets = F.forall(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0)), lambda p: p.cast("int") <= 255)
        made = {
            "gen": s["kind_no"] - 4,
            "sign": F.when(v.rlike(r"[\[(](at|dot|\.)[\])]"), 3).when(v.contains("@"), 2).when(v.rlike(" dot | [.] "), 1).otherwise(0),
            "digits": bins(F.length(d), (3, 7, 9, 12, 15)),
            "groups": bins(F.size(parts), (1, 2, 3, 4)),
            "seps": F.when(v.contains(":"), 3).when(v.contains("."), 2).when(v.rlike("[ -]"), 1).otherwise(0),
            "lead": F.when(v.startswith("+"), 2).when(v.startswith("(") | v.startswith("0"), 1).otherwise(0),
            "first": bins(F.length(parts[0]), (1, 2, 3)),
            "last": bins(F.length(parts[F.size(parts) - 1]), (2, 3, 4)),
            # of each generator its own: ends as hosts do, passes the card check, has octets only
            "fits": F.when(s["kind_no"] == 4, F.lower(parts[F.size(parts) - 1]).isin(*TLDS))
            .when(s["kind_no"] == 5, F.length(d).between(13, 19) & F.call_function("luhn_check", d)).otherwise(octets).cast("int"),
            "before": kind(F.substring(s["left"], -1, 1)),
            "after": kind(s["right"]),
            "cue": F.when(s["left"].rlike(CUE), 1).otherwise(0),
        }
        return F.struct(*(c.cast("int").alias(k) for k, c in made.items()))

    bare = F.regexp_replace(s["value"], "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")
    return let(s["value"], lambda v: let(_digits(v), lambda d: let(F.split(bare, "[^0-9A-Za-z]+"), lambda parts: of(v, d, parts))))


def boost(cells: list[tuple[dict[str, int], float, float]], how: Fit) -> tuple[float, tuple[Tree, ...]]:
    """Trees of depth two on ``(features, right, wrong)`` cells, by Newton steps of the logistic loss."""
    good, bad = (np.array([c[k] for c in cells], float) for k in (1, 2))
    if not good.sum() or not bad.sum():
        return (10.0 if good.sum() else -10.0), ()
    start = math.log(good.sum() / bad.sum())
    values = {f: np.array([c[0][f] for c in cells]) for f in FEATURES}
    score, trees = np.full(len(cells), start), []

    def best(use: np.ndarray, g: np.ndarray, h: np.ndarray):
        total_g, total_h = g[use].sum(), h[use].sum()
        found = (-1.0, ("gen", 0), 0.0, 0.0)
        for f, n in FEATURES.items():
            a = np.cumsum(np.bincount(values[f][use], g[use], n))[:-1]
            b = np.cumsum(np.bincount(values[f][use], h[use], n))[:-1]
            gain = a * a / (b + 1.0) + (total_g - a) ** 2 / (total_h - b + 1.0)
            x = int(np.argmax(gain))
            if gain[x] > found[0] + 1e-12:
                leaves = (how.rate * y / (z + 1.0) for y, z in ((a[x], b[x]), (total_g - a[x], total_h - b[x])))
                found = (gain[x], (f, x), *map(float, leaves))
        return found

    for _ in range(how.rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = good - (good + bad) * p, (good + bad) * p * (1 - p)
        _, (f, x), _, _ = best(np.ones(len(cells), bool), g, h)
        low = values[f] <= x
        sides = [(side, *best(side, g, h)[1:]) for side in (low, ~low)]
        trees.append(((f, x), *(side[1:] for side in sides)))
        for side, (f2, y), l0, l1 in sides:
            score[side] += np.where(values[f2][side] <= y, l0, l1)
    return start, tuple(trees)


def evaluate(start: float, trees: tuple[Tree, ...], f: dict[str, int]) -> float:
    """What :meth:`Model.score` computes, of one cell."""
    total = start
    for (a, x), ((b, y), b0, b1), ((c, z), c0, c1) in trees:
        total += (b0 if f[b] <= y else b1) if f[a] <= x else (c0 if f[c] <= z else c1)
    return total


def _overlaps(s: Column, base: Column) -> Column:
    return F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def _forms(words: Column, seed: Column) -> Column:
    """``array<struct<gen, good, cue, form>>``: personal data as it is written around filters, and what looks like it."""
    pick = lambda n, k: F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(n)).cast("int")
    digits = lambda n, k: F.lpad(pick(10**n, k).cast("string"), n, "0")
    word = lambda k, other: F.lower(F.coalesce(F.get(words, F.pmod(F.xxhash64(seed, F.lit(k)), F.greatest(F.size(words), F.lit(1))).cast("int")), F.lit(other)))
    choose = lambda options, k: F.array(*(F.lit(o) if isinstance(o, str) else o for o in options))[pick(len(options), k)]
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    user = choose([join(word(1, "ann"), ".", word(2, "lee")), join(word(1, "ann"), digits(2, 3)), word(1, "ann"), join(word(1, "ann"), "_", word(2, "lee"))], 4)
    host, tld = choose([word(5, "mail"), join(word(5, "mail"), digits(1, 6)), join(word(5, "mail"), "-", word(7, "box"))], 8), choose(TLDS, 9)
    email = choose(
        [join(user, a, host, d, tld) for a, d in ((" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "."), (" at ", " dot "), (" @ ", "."), (" @ ", " . "), ("(at)", "(dot)"), (" (at) ", "."), ("@", " dot "))],
        10,
    )
    site = join(word(1, "look"), " at ", word(5, "site"), ".", choose([tld, word(2, "then")], 11))
    a, b, c = digits(3, 12), digits(3, 13), digits(4, 14)
    phone = choose(
        [join("(", a, ") ", b, "-", c), join(a, "-", b, "-", c), join(a, ".", b, ".", c), join("00", digits(2, 15), " ", a, " ", b, c), join("0", a, " ", b, c), join("(0", digits(2, 15), ") ", c, " ", digits(4, 16)), join("0", digits(2, 15), "-", b, c)],
        17,
    )
    body = join("4", a, b, c, digits(4, 16))
    valid = join(body, F.filter(F.array(*(F.lit(str(x)) for x in range(10))), lambda x: F.call_function("luhn_check", F.concat(body, x)))[0])
    four = [F.substring(valid, 1 + 4 * k, 4) for k in range(4)]
    card = choose([F.array_join(F.array(*four), "."), F.array_join(F.array(*four), "  "), F.array_join(F.array(*four), " - ")], 18)
    day, hour = join(choose(["19", "20"], 19), digits(2, 20), "-0", digits(1, 21), "-1", digits(1, 22)), join(digits(2, 23), " ", digits(2, 24))
    look = choose(
        [join(day, " ", hour), join("1", digits(7, 25)), join(digits(1, 26), " ", a, " ", b, " 000"), join("1", digits(3, 27), "-1", digits(3, 28)), join("978-", digits(1, 29), "-", digits(2, 15), "-", digits(4, 14), digits(2, 30), "-", digits(1, 31)), join(digits(8, 25), digits(8, 32)), join(digits(2, 20), ".", digits(2, 23), ".", choose(["1998", "2007", "2019"], 33), " ", digits(2, 24))],
        34,
    )
    octets = [pick(256, 35 + k).cast("string") for k in range(4)]
    dotted = choose([F.array_join(F.array(*octets), x) for x in ("[.]", "(.)", " . ", " dot ", " [.] ")], 40)
    version = choose(
        [F.array_join(F.array(digits(2, 41), digits(2, 42), digits(2, 43), digits(2, 44)), ":"), F.array_join(F.array(pick(9, 41).cast("string"), pick(20, 42).cast("string"), pick(700, 43) + 256), "."),
         join(F.lit("20"), digits(2, 20), ".", digits(2, 23), ".", digits(2, 24), ".", digits(2, 41)), F.array_join(F.array(octets[0], octets[1], octets[2], octets[3], octets[0]), ":")],
        45,
    )
    lead = lambda cues, k: choose([*cues, "", "", ""], k)
    one = lambda gen, good, cue, form: F.struct(F.lit(gen).alias("gen"), F.lit(good).alias("good"), cue.alias("cue"), form.alias("form"))
    return F.array(
        one(4, True, lead(("mail ", "contact ", "Email: ", "write to "), 50), email), one(4, False, lead(("we ", "all ", "just "), 51), site),
        one(5, True, lead(("phone ", "call ", "Tel: ", "fax "), 52), phone), one(5, True, lead(("card ", "visa ", "account "), 53), card),
        one(5, False, lead(("on ", "order ", "page "), 54), look), one(5, False, lead(("in ", "from ", "no "), 55), look),
        one(6, True, lead(("host ", "server ", "ip "), 56), dotted), one(6, False, lead(("version ", "at ", "chapter "), 57), version),
    )


def examples(docs: DataFrame) -> DataFrame:
    """``held, source, right, c`` of all documents' candidates ``c``; ``source`` is ``planted``, ``base`` or ``text``. Rows without an id teach nothing."""
    every = docs.select("doc_id", "text").filter("doc_id is not null").select(
        F.xxhash64("doc_id").alias("seed"), (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held"), F.coalesce("text", F.lit("")).alias("text")
    )
    at = F.pmod(F.xxhash64("seed", F.lit(0)), F.greatest(F.length("text") - 40, F.lit(1))).cast("int") + 1
    pieces = every.select(
        "seed", "held",
        F.regexp_replace(F.substring("text", at, F.lit(24)), "^\\S+", "").alias("left"), F.regexp_replace(F.substring("text", at + 24, F.lit(24)), "^\\S+|\\S+$", "").alias("right"),
        F.regexp_extract_all(F.substring("text", at, F.lit(400)), F.lit("[A-Za-z]{3,12}"), F.lit(0)).alias("words"),
    )
    planted = pieces.select("seed", "held", "left", "right", F.explode(_forms(F.col("words"), F.col("seed"))).alias("f")).select(
        "held", "f.gen", "f.good", F.length(F.concat("left", F.lit(" "), "f.cue")).alias("lo"), F.length("f.form").alias("n"),
        F.concat("left", F.lit(" "), "f.cue", "f.form", F.when(F.pmod("seed", F.lit(3)) == 0, ".").otherwise(""), F.lit(" "), "right").alias("t"),
    )
    over = (F.col("c.start") < F.col("lo") + F.col("n")) & (F.col("lo") < F.col("c.end"))
    planted = (
        planted.select("held", "gen", "good", "lo", "n", F.explode(let(F.col("t"), candidates)).alias("c"))
        .filter(over & (F.col("c.kind_no") == F.col("gen")))
        .select("held", F.lit("planted").alias("source"), F.col("good").alias("right"), "c")
    )
    found = every.select("held", let(F.col("text"), lambda x: F.struct(base_spans(x).alias("b"), candidates(x).alias("c"))).alias("s")).filter(F.size("s.c") > 0)
    found = found.select("held", F.col("s.b").alias("b"), F.explode("s.c").alias("c"))
    found = found.select("held", _overlaps(F.col("c"), F.col("b")).alias("right"), "c").select(
        "held", F.when(F.col("right"), "base").otherwise("text").alias("source"), "right", "c"
    )
    return planted.unionByName(found)


def fit(docs: DataFrame, how: Fit = Fit()) -> Model:
    """Counts the candidates of all ``docs(doc_id, text)``; at most a row for each cell comes to the driver."""
    each = examples(docs).select("held", (F.col("source") == "base").alias("base"), "right", features(F.col("c")).alias("f"))
    cells = each.groupBy("held", "base", "f").agg(F.count_if("right").alias("good"), F.count_if(~F.col("right")).alias("bad")).collect()
    train: dict[tuple[int, ...], list[int]] = {}
    test: dict[tuple[int, ...], list[int]] = {}
    for r in cells:
        if r["held"] and r["base"]:
            continue  # such candidates are never added
        cell = (test if r["held"] else train).setdefault(tuple(r["f"]), [0, 0])
        cell[0] += r["good"]
        cell[1] += r["bad"]
    start, trees = boost([(dict(zip(FEATURES, k, strict=True)), *v) for k, v in sorted(train.items())], how)
    cuts = []
    for g in range(len(GENERATORS)):
        own = [(evaluate(start, trees, dict(zip(FEATURES, k, strict=True))), *v) for k, v in test.items() if k[0] == g]
        good, bad = sum(x[1] for x in own), sum(x[2] for x in own)
        weight = how.prior / (1 - how.prior) * max(bad, 1) / max(good, 1)
        ranked = sorted(own, reverse=True)
        cut, a, b, n = math.inf, 0.0, 0, 0
        for k, (s, x, y) in enumerate(ranked):
            a, b, n = a + x * weight, b + y, n + x + y
            last = k + 1 == len(ranked) or ranked[k + 1][0] < s
            if last and n >= how.least and x and s > 0 and a >= how.right * (a + b):
                cut = s
        cuts.append(cut)
    return Model(start, trees, tuple(cuts))


def _judged(model: Model, text: Column) -> Column:
    """``struct<spans, scores>``: base spans and added ones; each candidate with its score."""

    def scored(cands: Column) -> Column:
        return F.transform(
            cands,
            lambda s: let(features(s), lambda f: F.struct(s.alias("s"), model.score(lambda k: f[k]).alias("score"))),
        )

    def chosen(base: Column, rated: Column) -> Column:
        def strong(x: Column) -> Column:
            kind = x["s"]["kind_no"]
            cut = F.when(kind == 4, F.lit(model.cuts[0])).when(kind == 5, F.lit(model.cuts[1])).otherwise(F.lit(model.cuts[2]))
            return ~_overlaps(x["s"], base) & (x["score"] >= cut - 1e-9)

        return F.struct(
            F.concat(base, F.transform(F.filter(rated, strong), lambda x: x["s"].dropFields("left", "right"))).alias("spans"),
            F.transform(rated, lambda x: F.struct(x["s"]["start"], x["s"]["kind_no"], x["s"]["kind"], x["s"]["end"], x["score"].alias("score"))).alias("scores"),
        )

    none = F.expr("cast(array() as array<struct<start:int,kind_no:int,kind:string,end:int,score:double>>)")
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(
            F.struct(base_spans(t).alias("b"), candidates(t).alias("c")),
            lambda x: F.when(F.size(x["c"]) == 0, F.struct(x["b"].alias("spans"), none.alias("scores"))).otherwise(let(scored(x["c"]), lambda r: chosen(x["b"], r))),
        ),
    )


def with_spans(docs: DataFrame, model: Model, name: str = "spans") -> DataFrame:
    """``docs`` with all spans of ``text`` in the column ``name``: base ones, then added ones."""
    return docs.withColumn(name, _judged(model, F.col("text"))["spans"])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, scores`` of ``docs(doc_id, text)``.

    ``scores`` has ``kind:start:end:score`` of every candidate that the generators
    propose, in order of their starts: those that the trees keep, those that they reject,
    and those that overlap a base span, which stays whatever its score.
    """
    short = lambda s: F.struct(s["start"], s["kind_no"], s["kind"], s["end"])
    found = docs.select("doc_id", _judged(model, F.col("text")).alias("j")).select("doc_id", F.transform("j.spans", short).alias("s"), F.sort_array("j.scores").alias("r"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"), F.format_number(x["score"], 2))
    return found.select(
        "doc_id", *map(count, KINDS),
        F.sha2(digest(F.filter("s", lambda x: x["kind_no"] < 4)), 256).alias("base_sha256"),
        digest(F.col("s")).alias("spans"),
        F.size(F.filter("s", lambda x: x["kind_no"] >= 4)).cast("long").alias("n_added"),
        F.array_join(F.transform("r", said), ",").alias("scores"),
    )
