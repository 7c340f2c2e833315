"""Quality rules whose cutoffs follow each language and source.

Ratios of every document go into quantile sketches: counts per logarithmic bucket of relative width
``accuracy``, which merge by adding, whatever the order. A group's upper fence is its upper quartile plus
``reach`` times that quartile's distance to the median, and at least ``least`` above it; a lower fence mirrors
it. Documents beyond a fence are dropped. Groups of fewer than ``enough`` documents use the sketch of their language, and small
languages that of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathpulse.llm.store import keep
from pathpulse.llm.words import BYTE, SPACE, Text, Words, mix, shingles, span_hashes, texts, words

#: The signs that count as symbols, and the words of a window.
SYMBOLS = b"#*$%&|<>"
REPEAT = 8
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def line_counts(part: Text, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and lines equal to an earlier one, per text."""
    breaks = np.flatnonzero(part.data == 10)
    starts = np.sort(np.concatenate([part.at[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([part.at[1:], breaks]))
    some = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[some], ends[some]
    hashes = span_hashes(lambda a, b: BYTE[part.data[a:b]], starts, ends)
    text = np.searchsorted(part.at, starts, "right") - 1
    _, first = np.unique(hashes ^ mix(text.astype(np.uint64)), return_index=True)
    n = len(part)
    lines = np.bincount(text, minlength=n)
    return lines, lines - np.bincount(text[first], minlength=n)


def repeated_words(w: Words, size: int = REPEAT) -> np.ndarray:
    """Words in windows of ``size`` words that their text holds twice or more, per text."""
    n = len(w.of) - 1
    windows, of = shingles(w, size)
    text = np.repeat(np.arange(n), np.diff(of))
    _, which, counts = np.unique(windows ^ mix(text.astype(np.uint64)), return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[which] > 1)
    begin = w.of[text[again]] + again - of[text[again]]
    marks = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(marks, begin, 1)
    np.add.at(marks, begin + size, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(marks[:-1]) > 0)))
    return np.diff(covered[w.of])


def measures(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every text."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts(batch.column(len(keys))):
                w = words(part)
                sums = [np.concatenate(([0], np.cumsum(x)))[part.at] for x in ((part.data & 0xC0 != 0x80) & ~SPACE[part.data], _SYMBOL[part.data])]
                lines, dup = line_counts(part, w)
                columns = [np.diff(w.of), *map(np.diff, sums), lines, dup, repeated_words(w)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(part.first, len(part)) for k in range(len(keys))] + [pa.array(c, pa.int64()) for c in columns],
                    names=keys + names,
                )

    columns = docs.select(*keys, F.col(text).cast("string").alias("text"))
    kinds = [f"{k} {columns.schema[k].dataType.simpleString()}" for k in keys]
    return columns.mapInArrow(run, ", ".join(kinds + [f"{n} long" for n in names]))


@dataclass(frozen=True)
class Rule:
    """A ratio with the least distance between quartile and fence; ``both`` sets a lower fence too."""

    name: str
    ratio: str
    least: float
    both: bool = False


RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", 0.1),
    Rule("word_length", "word_chars / greatest(n_words, 1)", 1.0, both=True),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 0.35),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", 0.25),
)


@dataclass(frozen=True)
class QualityRules:
    """Base limits, and the settings of the adaptive ones."""

    least_words: int = 20
    most_repeats: int = 30
    accuracy: float = 0.01
    reach: float = 6.0
    enough: int = 200
    rules: tuple[Rule, ...] = field(default=RULES)

    @property
    def gamma(self) -> float:
        return (1 + self.accuracy) / (1 - self.accuracy)


def base_failed(p: QualityRules) -> str:
    return f"n_words < {p.least_words} or 100 * n_repeat_words > {p.most_repeats} * n_words"


#: A value's bucket: 0 for none, else the number of the interval between two powers of gamma (shifted above 0).
SHIFT = 10_000


def _number(x: float) -> str:
    """A double that both SQL dialects read alike."""
    return f"CAST('{x!r}' AS DOUBLE)"


def bucket(ratio: str, p: QualityRules) -> str:
    value = f"CAST({ratio} AS DOUBLE)"
    return f"CASE WHEN {value} <= {_number(1e-9)} THEN 0 ELSE CAST(ceil(ln({value}) / ln({_number(p.gamma)})) AS INT) + {SHIFT} END"


def sketches(rows: DataFrame, p: QualityRules) -> DataFrame:
    """(lang, source, rule, bucket, n): one mergeable sketch for each group and rule."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.expr(bucket(r.ratio, p)).alias("bucket")) for r in p.rules]))
    return (
        rows.select("lang", "source", pairs.alias("x"))
        .groupBy("lang", "source", F.col("x.rule").alias("rule"), F.col("x.bucket").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences_sql(sketch: str, groups: str, p: QualityRules) -> str:
    """SQL for the fences of every group: low_<rule> and high_<rule> per lang and source."""
    gamma, reach = _number(p.gamma), _number(p.reach)
    value = f"CASE WHEN bucket = 0 THEN {_number(0.0)} ELSE 2 * power({gamma}, bucket - {SHIFT}) / ({gamma} + 1) END"
    columns = ", ".join(
        f"max(CASE WHEN rule = '{r.name}' THEN q3 + greatest({reach} * (q3 - q2), {_number(r.least)}) END) AS high_{r.name}, "
        + (f"max(CASE WHEN rule = '{r.name}' THEN q1 - greatest({reach} * (q2 - q1), {_number(r.least)}) END)" if r.both else "CAST(NULL AS DOUBLE)")
        + f" AS low_{r.name}"
        for r in p.rules
    )
    pick = ", ".join(f"CASE WHEN o.n >= {p.enough} THEN o.{c} WHEN l.n >= {p.enough} THEN l.{c} ELSE a.{c} END AS {c}" for r in p.rules for c in (f"high_{r.name}", f"low_{r.name}"))
    return f"""WITH levels AS (
  SELECT 2 AS level, lang, source, rule, bucket, n FROM {sketch}
  UNION ALL SELECT 1, lang, '', rule, bucket, sum(n) FROM {sketch} GROUP BY lang, rule, bucket
  UNION ALL SELECT 0, '', '', rule, bucket, sum(n) FROM {sketch} GROUP BY rule, bucket), ranks AS (
  SELECT *, {value} AS value,
         sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM levels), quartiles AS (
  SELECT level, lang, source, rule, max(total) AS n,
         min(CASE WHEN 4 * upto >= total THEN value END) AS q1,
         min(CASE WHEN 2 * upto >= total THEN value END) AS q2,
         min(CASE WHEN 4 * upto >= 3 * total THEN value END) AS q3 FROM ranks GROUP BY level, lang, source, rule), fences AS (
  SELECT level, lang, source, max(n) AS n, {columns} FROM quartiles GROUP BY level, lang, source), names AS (
  SELECT DISTINCT lang, source FROM {groups})
  SELECT g.lang, g.source, {pick} FROM names g
  LEFT JOIN fences o ON o.level = 2 AND o.lang = g.lang AND o.source = g.source
  LEFT JOIN fences l ON l.level = 1 AND l.lang = g.lang
  LEFT JOIN fences a ON a.level = 0"""


def within(p: QualityRules) -> str:
    """SQL for a document inside all fences; a missing fence excludes nothing."""
    parts = []
    for r in p.rules:
        parts.append(f"coalesce(CAST({r.ratio} AS DOUBLE) <= high_{r.name}, true)")
        parts.append(f"coalesce(CAST({r.ratio} AS DOUBLE) >= low_{r.name}, true)")
    return " AND ".join(parts)


def quality_rules(
    docs: DataFrame, p: QualityRules = QualityRules(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """Measures and verdicts of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    Sketches cover all documents that pass the base limits. A null text has no words and fails; a null lang or
    source counts as the empty name. A value on a fence is kept. Repeated rows and rows without id are judged
    each; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    keys = docs.select(
        F.col(doc_id).alias("doc_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))],
        F.col(text).alias("text"),
    )
    rows = keep(measures(keys, ["doc_id", "lang", "source"]))
    sketch = keep(sketches(rows.where(f"not ({base_failed(p)})"), p))
    fences = spark.sql(fences_sql("{sketch}", "{groups}", p), sketch=sketch, groups=rows)
    joined = rows.join(keep(fences), ["lang", "source"])
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(base_failed(p)).alias("base_failed"),
        F.expr(f"not ({base_failed(p)}) and {within(p)}").alias("kept"),
    )


def quality_rules_sql(p: QualityRules = QualityRules()) -> str:
    """The same result in DuckDB SQL over ``documents``."""
    space = r"[^\x20\x09-\x0D]"
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{r.name}' AS rule, {bucket(r.ratio, p)} AS bucket FROM fit" for r in p.rules)
    fences = fences_sql("sketch", "rows_", p)
    return f"""WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(text, '') AS text FROM documents), w AS (
  SELECT *, regexp_extract_all(text, '{space}+') AS words FROM d), lines AS (
  SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d), line_counts AS (
  SELECT row_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
  WHERE regexp_matches(line, '{space}') GROUP BY row_id), runs AS (
  SELECT row_id, i, array_to_string(words[i:i + {REPEAT - 1}], ' ') AS run
  FROM (SELECT row_id, words, unnest(range(1, len(words) - {REPEAT - 2})) AS i FROM w WHERE len(words) >= {REPEAT})), twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, run) AS n FROM runs) WHERE n > 1), covered AS (
  SELECT row_id, count(DISTINCT word) AS n_repeat_words FROM (SELECT row_id, unnest(range(i, i + {REPEAT})) AS word FROM twice)
  GROUP BY row_id), rows_ AS (
  SELECT w.row_id, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum([length(x) FOR x IN words]), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN line_counts USING (row_id) LEFT JOIN covered USING (row_id)), fit AS (
  SELECT * FROM rows_ WHERE NOT ({base_failed(p)})), sketch AS (
  SELECT lang, source, rule, bucket, count(*) AS n FROM ({pairs}) GROUP BY ALL), fence AS ({fences})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base_failed(p)}) AS base_failed,
       NOT ({base_failed(p)}) AND {within(p)} AS kept
FROM rows_ JOIN fence USING (lang, source)"""
