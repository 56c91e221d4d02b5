"""Fill-in-middle by a rope.

A text becomes a balanced binary tree. Its leaves hold pieces of about ``LEAF``
code points, cut between units (a unit is a run of Latin letters or one other
character), and each node caches how many units and code points are below it.
Two splits at unit ranks give prefix, middle and suffix: only the leaves on the
two paths are looked into. The sub-trees are concatenated in another order with
sentinels between, and no piece is copied. The inverse makes a rope of the
output, splits it at the code points where the sentinels stand, and concatenates
the parts in the order of the text.

A text that holds a sentinel stays plain. In every other output each sentinel
therefore stands once: no mark's first character stands inside of a mark, so
that none can arise across a seam.

Defined cases: a null text counts as empty; an empty text is plain with no units;
a null id is drawn for as the empty string; repeated rows give equal rows; an
empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = 4096
#: Code points of texts in one output batch.
BATCH = 1 << 21
_UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
_LETTERS = re.compile("[A-Za-z]*")


@dataclass(frozen=True)
class Plan:
    """``plain`` of 100 texts stay plain, ``spm`` of 100 others put the suffix first; ``seed`` is part of each draw."""

    seed: int = 1
    changed: int = 90
    spm: int = 20
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    def __post_init__(self):
        if len(set(self.marks)) < 3 or any(not m or {x[0] for x in self.marks if x} & set(m[1:]) for m in self.marks):
            raise ValueError("marks must differ, and no mark's first character may stand inside of one")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.suffix_mark, self.middle_mark


class Rope:
    """A leaf has ``text``, a branch ``left`` and ``right``; both know their ``units`` and ``chars``."""

    __slots__ = ("text", "left", "right", "units", "chars")

    def __init__(self, text: str = "", units: int | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is not None:
            self.units, self.chars = left.units + right.units, left.chars + right.chars
        else:
            self.units, self.chars = len(_UNIT.findall(text)) if units is None else units, len(text)

    @classmethod
    def of(cls, text: str, leaf: int = LEAF) -> Rope:
        level, at = [], 0
        while at < len(text):
            end = min(at + leaf, len(text))
            if _LETTERS.match(text, end - 1, end).end() == end:  # a run of letters stays whole
                end = _LETTERS.match(text, end).end()
            level.append(cls(text[at:end]))
            at = end
        while len(level) > 1:
            level = [join(*level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else cls()

    def split_units(self, rank: int) -> tuple[Rope, Rope]:
        """The first ``rank`` units and the rest."""
        if self.left is None:
            units = _UNIT.findall(self.text)
            return Rope("".join(units[:rank]), rank), Rope("".join(units[rank:]), len(units) - rank)
        if rank < self.left.units:
            a, b = self.left.split_units(rank)
            return a, join(b, self.right)
        a, b = self.right.split_units(rank - self.left.units)
        return join(self.left, a), b

    def split_chars(self, rank: int) -> tuple[Rope, Rope]:
        """The first ``rank`` code points and the rest; the cut must stand between two units."""
        if self.left is None:
            return Rope(self.text[:rank]), Rope(self.text[rank:])
        if rank < self.left.chars:
            a, b = self.left.split_chars(rank)
            return a, join(b, self.right)
        a, b = self.right.split_chars(rank - self.left.chars)
        return join(self.left, a), b

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.left is None:
                yield node.text
            else:
                stack += node.right, node.left

    def __str__(self) -> str:
        return "".join(self.leaves())


def join(*parts: Rope) -> Rope:
    """Concatenation; empty parts add no node."""
    out = None
    for p in parts:
        if p.chars:
            out = p if out is None else Rope(left=out, right=p)
    return out or Rope()


def arranged(text: str, draws: tuple[int, int, int, int], plan: Plan = Plan()) -> tuple[int, str, int | None, int | None, str]:
    """``n, form, prefix_chars, middle_chars, output`` of a text and its four draws."""
    rope = Rope.of(text)
    n = rope.units
    a, b, keep, order = draws
    if not text or any(m in text for m in plan.marks) or keep % 100 >= plan.changed:
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    head, suffix = rope.split_units(high)
    prefix, middle = head.split_units(low)
    p, s, m = map(Rope, plan.marks)
    form = "spm" if order % 100 < plan.spm else "psm"
    out = join(s, suffix, p, prefix, m, middle) if form == "spm" else join(p, prefix, s, suffix, m, middle)
    return n, form, prefix.chars, middle.chars, str(out)


def rebuilt(output: str, form: str, plan: Plan = Plan()) -> str:
    """The text of an output, from its form alone."""
    if form == "plain":
        return output
    first, second = (plan.suffix_mark, plan.prefix_mark) if form == "spm" else (plan.prefix_mark, plan.suffix_mark)
    rest, parts = Rope.of(output), {}
    at = len(first)
    _, rest = rest.split_chars(at)
    for name, mark in ((first, second), (second, plan.middle_mark)):
        end = output.index(mark, at)
        parts[name], rest = rest.split_chars(end - at)
        _, rest = rest.split_chars(len(mark))
        at = end + len(mark)
    return str(join(parts[plan.prefix_mark], rest, parts[plan.suffix_mark]))


def _batches(rows: Iterator[tuple], size_of: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose column ``size_of`` has about ``BATCH`` code points in all."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[size_of]) + 64
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_MADE = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)
_MADE_SQL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]


def transform(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of ``docs(doc_id, text)``."""

    def made(batches):
        def rows():
            for b in batches:
                ids, texts, *h = (c.to_pylist() for c in b.columns)
                for i, t, *four in zip(ids, texts, *h, strict=True):
                    yield (i, *arranged(t, tuple(four), plan))

        return _batches(rows(), 5, _MADE)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    four = [c.alias(f"h{k}") for k, c in enumerate(draws(F.col("doc_id"), plan.seed), 1)]
    return keyed.select("doc_id", "text", *four).mapInArrow(made, _MADE_SQL)


def restore(made: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of ``transform`` with ``restored``, the text that output and form give back."""
    schema = _MADE.append(pa.field("restored", pa.string()))

    def back(batches):
        def rows():
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield (*r, rebuilt(r[5], r[2], plan))

        return _batches(rows(), 5, schema)

    return made.select(*_MADE.names).mapInArrow(back, _MADE_SQL + ", restored string")


#: What the query gives, in DuckDB's SQL, with the plan's defaults.
ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents
),
drawn AS (
  SELECT doc_id, t, units, len(units) AS n,
    ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
),
cut AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:least(a, b)], '') AS prefix,
    array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""
