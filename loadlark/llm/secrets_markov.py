"""Secret scan: format rules, and character Markov models for what has no format.

Base spans are those of three fixed formats. Beside them, every long run of key
characters outside of them is scored by two first-order character models, one of
random strings and one of ordinary identifiers: the log-likelihood ratio of its
transitions, by length. A run is reported whole when its mean ratio reaches the
cut, else the part of it that windows of ``LEAST`` characters at or above the cut
cover, so that a key behind a path or a name isn't diluted by ordinary text.

Both models are trained from labelled samples: random strings are values that
the formats marked as secrets and generated digests, ordinary ones are words of
a bounded sample of documents and identifiers made of these words (snake, kebab
and camel case, constants, paths, numbered names) with the sample's own runs of
words and short numbers. Every fifth text and digest is held out: the cut is
above all but one in ten thousand of the held-out ordinary runs. The rest is
plain DataFrame expressions; the model is a table of characters by characters,
whatever the input.

Defined cases: null and empty texts have no spans; runs of fewer than ``LEAST``
characters, or without a letter, are never the method's; repeated rows are
scanned each; spans of one kind never overlap, those of different kinds may; a
method span never overlaps a base one; other columns aren't read by :func:`scan`
and stay in :func:`redact`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest, let, regex_spans

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"  # runs are maximal: shorter ones fail whole
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET)
#: Characters of the shortest run that a ratio can tell, and of a window.
LEAST = 20
#: Maximal runs of the alphabet of that length.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"


#: Words and short numbers between separators: what a run of the sample must be to count as ordinary.
PLAIN = r"^[+/_=-]*([A-Za-z]+|[0-9]{1,4})([+/_=-]+([A-Za-z]+|[0-9]{1,4}))*[+/_=-]*$"
NO_SPANS = "cast(array() as array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>)"


@dataclass(frozen=True)
class Fit:
    """Bounds of the samples; they hold at any input size."""

    max_documents: int = 4_000
    generated: int = 8_192
    #: Identifiers made of the words of a text.
    identifiers: int = 24
    least_ratio: float = 0.2
    backoff: float = 8.0
    false_alarms: float = 1e-4
    margin: float = 0.05
    #: What one transition may say at most, either way.
    most: float = 4.0


@dataclass(frozen=True)
class Model:
    """``ratio[c * SIZE + d]``: log of how much likelier ``d`` follows ``c`` in a random string."""

    ratio: tuple[float, ...]
    cut: float

    def table(self) -> Column:
        return F.split(F.lit(",".join(f"{x:.3f}" for x in self.ratio)), ",").cast("array<double>")


def _kind(spans: Column, number: int, holds=None) -> Column:
    kept = F.filter(spans, holds) if holds else spans
    return F.transform(
        kept,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(number).alias("kind_no"), F.lit(KINDS[number]).alias("kind"),
            s["end"].alias("end"), s["value"].alias("value"),
        ),
    )


def base_spans(text: Column, long: Column | None = None) -> Column:
    """``array<struct<start, kind_no, kind, end, value>>`` of the fixed formats.

    A format is only looked for where the text has what each match of it has: a
    key word, the fixed prefix, a long run (``long``, if known).
    """
    t, none = F.coalesce(text, F.lit("")), F.expr(NO_SPANS)
    named = let(F.lower(t), lambda x: x.contains("passw") | x.contains("secret") | x.contains("token") | x.contains("api"))
    return F.concat(
        F.when(named, _kind(regex_spans(t, ASSIGN), 0, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8)).otherwise(none),
        F.when(t.contains("AKIA"), _kind(regex_spans(t, ACCESS), 1, lambda s: F.length(s["value"]) >= 16)).otherwise(none),
        F.when(t.rlike(CANDIDATE) if long is None else long, _kind(regex_spans(t, HEX), 2)).otherwise(none),
    )


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with a space for each character of the spans."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    merged = F.aggregate(
        F.sort_array(spans), start,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(
                a["out"], F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))),
                F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(a["at"], s["start"]), F.lit(0))),
            ).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, merged).otherwise(text)


def _transitions(strings: DataFrame) -> DataFrame:
    """``random, c, d, n`` of ``random, value``: how often character number ``d`` follows ``c``."""
    codes = F.transform(F.split("value", ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    pairs = strings.select("random", F.filter(codes, lambda k: k >= 0).alias("k")).filter(F.size("k") > 1)
    pairs = pairs.select("random", "k", F.explode(F.sequence(F.lit(0), F.size("k") - 2)).alias("i"))
    return pairs.groupBy("random", F.col("k")[F.col("i")].alias("c"), F.col("k")[F.col("i") + 1].alias("d")).agg(
        F.count("*").alias("n")
    )


def _ratios(value: Column, table: Column) -> Column:
    """The log-likelihood ratio of each transition of a string."""
    codes = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    return let(codes, lambda k: F.transform(F.sequence(F.lit(0), F.size(k) - 2), lambda i: table[k[i] * SIZE + k[i + 1]]))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _windows(ratios: Column) -> Column:
    """The sum of each window, of a string that is longer than one."""
    return F.transform(F.sequence(F.lit(0), F.size(ratios) - (LEAST - 1)), lambda i: _sum(F.slice(ratios, i + 1, F.lit(LEAST - 1))))


def score(value: Column, table: Column) -> Column:
    """The largest mean ratio of a string of two characters or more: of the whole, or of a window."""
    return let(
        _ratios(value, table),
        lambda r: F.greatest(_sum(r) / F.size(r), F.when(F.size(r) >= LEAST, F.array_max(_windows(r)) / (LEAST - 1))),
    )


def _part(value: Column, table: Column, cut: float) -> Column:
    """``from, to`` of what is random in a string: all of it, what its windows cover, or null."""
    none = F.expr("cast(null as struct<from:int,to:int>)")
    part = lambda a, z: F.struct(a.cast("int").alias("from"), z.cast("int").alias("to"))
    covered = lambda r: let(
        let(_windows(r), lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: w[i] >= cut * (LEAST - 1))),
        lambda at: F.when(F.size(at) > 0, part(at[0], at[F.size(at) - 1] + LEAST)).otherwise(none),
    )
    return let(
        _ratios(value, table),
        lambda r: F.when(_sum(r) >= cut * F.size(r), part(F.lit(0), F.size(r) + 1))
        .when(F.size(r) >= LEAST, covered(r)).otherwise(none),
    )


def _identifiers(words: Column, most: int) -> Column:
    """Names made of neighbouring words, each of the next style."""
    def name(i: Column) -> Column:
        w, style = F.slice(words, i * 4 + 1, i % 3 + 2), (i + F.size(words)) % 8
        camel = F.array_join(F.transform(w, lambda x: F.initcap(F.lower(x))), "")
        snake = F.array_join(w, "_")
        return (
            F.when(style == 0, snake).when(style == 1, F.array_join(w, "-")).when(style == 2, camel)
            .when(style == 3, F.upper(snake)).when(style == 4, F.concat(F.lit("/"), F.array_join(w, "/")))
            .when(style == 5, F.concat(snake, F.lit("_"), (F.hash(w[0]) % 1000 + 2000).cast("string")))
            .when(style == 6, F.concat(F.lit("/"), F.array_join(w, "-"), F.lit("/v"), (F.size(words) % 10).cast("string"), F.lit("/"), camel))
            .otherwise(F.concat(F.array_join(w, "-"), F.lit("="), F.lower(camel)))
        )

    n = F.least(F.floor((F.size(words) - 4) / 4).cast("int"), F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), name)).otherwise(F.expr("cast(array() as array<string>)"))


def labelled(docs: DataFrame, how: Fit = Fit()) -> DataFrame:
    """``random, held, value`` of the bounded samples: at most ``max_documents`` texts, by a hash of their ids, and ``generated`` digests."""
    spark: SparkSession = docs.sparkSession
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.max_documents)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held"), F.coalesce("text", F.lit("")).alias("text")
    )
    marked = sample.withColumn("base", base_spans(F.col("text"))).withColumn("text", _masked(F.col("text"), F.col("base")))
    secret = marked.select("held", F.explode("base").alias("b")).select(
        F.lit(True).alias("random"), "held",
        F.when(F.col("b.kind") == "assign", F.regexp_extract("b.value", ASSIGN, 2)).otherwise(F.col("b.value")).alias("value"),
    )
    hex_, sixty = F.sha2(F.col("id").cast("string"), 256), F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256)))
    length = F.lit(LEAST) + (F.hash("id") % 12 + 12).cast("int")
    style = F.pmod(F.hash("id", F.lit(1)), F.lit(4))
    known = spark.range(how.generated).select(
        F.lit(True).alias("random"), (F.col("id") % 5 == 0).alias("held"),
        F.when(style == 0, sixty).when(style == 1, F.substring(hex_, F.lit(1), length))
        .when(style == 2, F.translate(F.substring(sixty, F.lit(1), length), "+/", "-_"))
        .otherwise(F.substring(F.regexp_replace(sixty, "[+/=]", ""), F.lit(1), length)).alias("value"),
    )
    words = F.regexp_extract_all(F.regexp_replace("text", CANDIDATE, " "), F.lit("[A-Za-z][A-Za-z_-]{2,}+"), F.lit(0))
    own = F.filter(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), lambda x: x.rlike(PLAIN))
    lines = F.array(*(F.repeat(F.lit(c), F.lit(24)) for c in "-=_+/"))
    ordinary = marked.select(
        F.lit(False).alias("random"), "held",
        F.explode(F.concat(own, lines, let(words, lambda w: F.concat(w, _identifiers(w, how.identifiers))))).alias("value"),
    )
    return secret.unionByName(known).unionByName(ordinary).filter(F.length("value") > 1)


def fit(docs: DataFrame, how: Fit = Fit()) -> Model:
    """Trains on the samples that aren't held out; the cut is set on those that are."""
    import math

    strings = labelled(docs, how)
    counts = {(r["random"], r["c"], r["d"]): r["n"] for r in _transitions(strings.filter("not held")).collect()}
    logs = {}
    for kind in (True, False):
        into = [sum(counts.get((kind, c, d), 0) for c in range(SIZE)) + 0.5 for d in range(SIZE)]
        for c in range(SIZE):  # towards how common each character is, where a transition is rare
            row = [counts.get((kind, c, d), 0) + how.backoff * into[d] / sum(into) for d in range(SIZE)]
            logs[kind, c] = [math.log(x / sum(row)) for x in row]
    ratio = tuple(max(-how.most, min(how.most, a - b)) for c in range(SIZE) for a, b in zip(logs[True, c], logs[False, c], strict=True))
    held = strings.filter(F.col("held") & ~F.col("random") & (F.length("value") >= LEAST))
    top = held.agg(F.percentile(score(F.col("value"), Model(ratio, 0.0).table()), 1 - how.false_alarms).alias("q")).first()["q"]
    return Model(ratio, how.least_ratio if top is None else max(how.least_ratio, round(top + how.margin, 6)))


def _all_spans(text: Column, model: Model) -> Column:
    table = model.table()

    def random(masked: Column) -> Column:
        parts = F.transform(
            F.filter(regex_spans(masked, CANDIDATE), lambda s: s["value"].rlike("[A-Za-z]")),
            lambda s: F.struct(s.alias("s"), _part(s["value"], table, model.cut).alias("p")),
        )
        return F.transform(
            F.filter(parts, lambda x: x["p"].isNotNull()),
            lambda x: F.struct(
                (x["s"]["start"] + x["p"]["from"]).alias("start"), F.lit(3).alias("kind_no"), F.lit(KINDS[3]).alias("kind"),
                (x["s"]["start"] + x["p"]["to"]).alias("end"), F.substring(x["s"]["value"], x["p"]["from"] + 1, x["p"]["to"] - x["p"]["from"]).alias("value"),
            ),
        )

    def found(t: Column, long: Column) -> Column:
        return let(base_spans(t, long), lambda base: F.when(long, F.concat(base, let(_masked(t, base), random))).otherwise(base))

    return let(F.coalesce(text, F.lit("")), lambda t: let(t.rlike(CANDIDATE), lambda long: found(t, long)))


def with_spans(docs: DataFrame, model: Model, name: str = "spans") -> DataFrame:
    """``docs`` with all spans of ``text`` in the column ``name``; base ones first by kind, then the method's."""
    return docs.withColumn(name, _all_spans(F.col("text"), model))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov, base_ratios`` of ``docs(doc_id, text)``.

    ``base_ratios`` has, in the order of the spans, ``kind:start:end:ratio`` of each base
    span: what the two models say of it (of the value alone where it is assigned, and
    without dots, which they don't know), though a base span stays whatever they say. Above the model's cut they alone would report it;
    a value of one character has no ratio.
    """
    short = lambda s: F.struct(s["start"], s["kind_no"], s["kind"], s["end"])
    table = model.table()

    def rated(s: Column) -> Column:
        value = F.translate(F.when(s["kind"] == KINDS[0], F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"]), ".", "")
        said = let(value, lambda v: F.when(F.length(v) > 1, F.format_number(score(v, table), 2)))
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), said)

    found = with_spans(docs.select("doc_id", "text"), model, "s")
    ordered = F.array_sort(F.filter("s", lambda x: x["kind_no"] < 3), lambda x, y: F.when((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["kind_no"] < y["kind_no"])), -1).otherwise(1))
    found = found.select("doc_id", F.transform("s", short).alias("s"), F.array_join(F.transform(ordered, rated), ",").alias("base_ratios"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, KINDS[:3]),
        F.sha2(digest(F.filter("s", lambda x: x["kind_no"] < 3)), 256).alias("base_sha256"),
        digest(F.col("s")).alias("spans"), count("markov"), "base_ratios",
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    merged = F.aggregate(
        F.sort_array(spans), start,
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, merged).otherwise(text)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with their secrets replaced in ``text``; all rows and columns stay."""
    return docs.withColumn("text", let(_all_spans(F.col("text"), model), lambda spans: redacted(F.col("text"), spans)))
