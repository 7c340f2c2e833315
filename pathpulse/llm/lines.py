"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations throughout.

Lines with equal token sets collapse first. A line's tokens are ordered by rarity: by the magnitude of the
count of their bucket in a sketch of fixed size over all texts, then by hash. Two lines of Jaccard similarity s or
more share one of their first n - ceil(s n) + 1 tokens, the shorter one among its first
n - ceil(2 s n / (1 + s)) + 1; lines that share such a token are compared by lengths, by the token's places and by
parity bitmaps of the tokens from there on, all of which only exclude pairs that cannot match. What is left is
verified on the full sets.

Families of many similar lines would make a pair for each two members. Before the join each line is therefore
held against two pivots for each of two min-hash values, the earliest and the most copied line of that value;
lines found to match an earlier one there are decided, and the join takes only pairs whose later line is undecided.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathpulse.llm.store import keep, release, settled

SPACES = r"[\x20\x09-\x0D]+"
_MASK = (1 << 56) - 1


@dataclass(frozen=True)
class LineDedup:
    """Lines match at 100 * intersection >= percent * union; shorter ones than ``least_tokens`` distinct tokens stay.

    ``buckets`` is the size of the rarity sketch. Up to ``most_broadcast`` bytes of lines to look up or to remove
    are broadcast to the texts; more are joined.
    """

    percent: int = 80
    least_tokens: int = 1
    buckets: int = 1 << 15
    most_broadcast: int = 64 << 20


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, SPACES), "")


def _hashes(line: Column) -> Column:
    """Distinct 56-bit hashes of a line's tokens."""
    return F.array_distinct(F.transform(_words(line), lambda x: F.xxhash64(x).bitwiseAND(F.lit(_MASK))))


def _bit(token: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), token.bitwiseAND(F.lit(63)).cast("int"))


def _bitmap(tokens: Column | str) -> Column:
    """Parity of the tokens that fall on each of 64 bits; differs in no more bits than the sets in tokens."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda seen, x: seen.bitwiseXOR(_bit(x)))


def _half(token: Column) -> Column:
    """Whether a token counts in the second bitmap, which holds half of the tokens."""
    return token.bitwiseAND(F.lit(64)) != 0


def _rests(whole: str, counts=lambda x: F.lit(True)) -> Column:
    """For every place of the prefix the bitmap of the tokens from there to the line's end, and one more.

    ``whole`` is the bitmap of all tokens that ``counts`` is true of.
    """
    last = lambda seen: F.element_at(seen, -1)
    return F.aggregate("prefix", F.array(whole), lambda seen, x: F.array_append(seen, F.when(counts(x), last(seen).bitwiseXOR(_bit(x))).otherwise(last(seen))))


#: Words of the wide bitmap that pairs are held against before their sets.
WIDE = 4


def _wide_bitmap(tokens: Column | str) -> list[Column]:
    """Parity of the tokens on each of 256 bits, in four columns ``w0`` to ``w3``."""
    def part(k: int) -> Column:
        return F.filter(tokens, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(WIDE - 1)) == k)

    return [_bitmap(part(k)).alias(f"w{k}") for k in range(WIDE)]


def _magnitudes(docs: DataFrame, p: LineDedup) -> list[int]:
    """For every bucket of token hashes the number of bits of its count over all texts."""
    tokens = docs.select(F.explode(F.split("text", SPACES)).alias("token"))
    bucket = F.pmod(F.xxhash64("token").bitwiseAND(F.lit(_MASK)), F.lit(p.buckets))
    counts = tokens.groupBy(bucket.alias("bucket")).count()
    table = [0] * p.buckets
    for row in counts.collect():
        table[row[0]] = min(60, int(row[1]).bit_length())
    return table


def _lines(docs: DataFrame, p: LineDedup) -> DataFrame:
    """One row for every line of enough tokens: place, set hashes, size, bitmap, min-hashes and prefix."""
    # one literal of all buckets; an array of literals would be an expression for each of them
    table = F.split(F.lit(",".join(map(str, _magnitudes(docs, p)))), ",").cast("array<long>")

    def ranked(h: Column) -> Column:
        return F.shiftleft(F.get(table, F.pmod(h, F.lit(p.buckets)).cast("int")), 56).bitwiseOR(h)

    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # a generator computes the hashes once; a filter after a projection would compute them again
    enough = F.filter(F.array(_hashes(F.col("line"))), lambda h: F.size(h) >= p.least_tokens)
    hashed = lines.select("doc_id", "line_no", F.explode(enough).alias("hashes"))
    ordered = hashed.select(
        "doc_id", "line_no", F.size("hashes").alias("n"), F.sort_array(F.transform("hashes", ranked)).alias("tokens"),
        F.array_min("hashes").alias("low"), F.array_max("hashes").alias("high"),
    )
    first = F.col("n") - F.floor((F.col("n") * p.percent + 99) / 100) + 1
    return ordered.select(
        "doc_id", "line_no", "n", "low", "high",
        F.xxhash64("tokens").alias("set_a"), F.xxhash64(F.lit(7), "tokens").alias("set_b"),
        _bitmap("tokens").alias("bits"), _bitmap(F.filter("tokens", _half)).alias("half"),
        F.slice("tokens", 1, first.cast("int")).alias("prefix"),
    )


def _needed(p: LineDedup, n: str, m: str) -> str:
    """Least common tokens of two sets that match."""
    return f"(({n} + {m}) * {p.percent} + {99 + p.percent}) div {100 + p.percent}"


def _possible(p: LineDedup) -> str:
    """SQL for two lines that lengths and bitmaps allow to match."""
    return f"""least(l.n, r.n) * 100 >= greatest(l.n, r.n) * {p.percent}
      AND bit_count(l.bits ^ r.bits) <= l.n + r.n - 2 * ({_needed(p, 'l.n', 'r.n')})"""


def _few(df: DataFrame, lists: str, width: int, limit: int) -> DataFrame:
    """``df`` stored, and broadcast if its rows, with lists of items of ``width`` bytes, have at most ``limit`` bytes."""
    df = keep(df)
    size = df.agg(F.sum(F.lit(64) + F.size(lists).cast("long") * width)).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, p: LineDedup) -> DataFrame:
    """id of the later line of every pair of ids (a before b) whose full sets match."""
    pairs = keep(pairs)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    same = ["n", "low", "high", "bits"]
    places = sets.join(ids, "id").groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "id", *same)).alias("wanted"))
    found = docs.join(_few(places, "wanted", 64, p.most_broadcast), "doc_id")
    found = found.select("doc_id", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    # where rows repeat a doc_id, only the row that the line came from has its tokens
    own = F.filter(
        F.array(_hashes(F.get("lines", F.col("w.line_no")))),
        lambda t: F.struct(F.size(t), F.array_min(t), F.array_max(t), _bitmap(t)) == F.struct(*[f"w.{c}" for c in same]),
    )
    full = found.select("w.id", F.explode(own).alias("tokens"))
    full = keep(full.withColumn("brief", F.array_distinct(F.transform("tokens", lambda x: x.bitwiseAND(F.lit(0x7FFF)).cast("short")))))
    # wide bitmaps differ in no more bits than the sets in tokens; they are short, and most pairs end here
    apart = sum((F.bit_count(F.col(f"w{k}_a").bitwiseXOR(F.col(f"w{k}_b"))) for k in range(WIDE)), F.lit(0))
    seen = _both(pairs, full.select("id", F.size("tokens").alias("n"), *_wide_bitmap("tokens")))
    pairs = keep(seen.where((100 + p.percent) * (F.col("n_a") + F.col("n_b") - apart) >= 2 * p.percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"))
    # tokens cut to 15 bits give an upper bound of the common ones; few pairs that pass it don't match
    lost = F.least(F.col("n_a") - F.size("brief_a"), F.col("n_b") - F.size("brief_b"))
    bound = F.size(F.array_intersect("brief_a", "brief_b")) + lost
    met = _both(pairs, full.select("id", F.size("tokens").alias("n"), "brief"))
    met = met.select("a", "b", bound.alias("bound"), (F.col("n_a") + F.col("n_b")).alias("sum"))
    close = keep(met.where((100 + p.percent) * F.col("bound") >= p.percent * F.col("sum")).select("a", "b", "bound"))
    # one match decides a line: its closest pair first, the others only if that one fails
    closest = close.groupBy("b").agg(F.max_by("a", "bound").alias("a"))
    first = keep(_exact(closest, full, p))
    others = close.select("a", "b").join(first.withColumnRenamed("id", "b"), "b", "left_anti")
    return first.unionByName(_exact(others, full, p)).distinct()


def _both(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the other columns of ``rows`` (id, ...) for either side."""
    left, right = (rows.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != "id"]) for x in "ab")
    return pairs.join(left, "a").join(right, "b")


def _exact(pairs: DataFrame, full: DataFrame, p: LineDedup) -> DataFrame:
    """id of the later line of the pairs whose full sets match."""
    met = _both(pairs, full.select("id", "tokens"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    match = (100 + p.percent) * common >= p.percent * (F.size("tokens_a") + F.size("tokens_b"))
    return met.where(match).select(F.col("b").alias("id")).distinct()


def _pivot_pairs(sets: DataFrame, p: LineDedup) -> DataFrame:
    """Every line with the earliest, and the most copied, line that has its lowest, and its highest, token hash."""
    key = F.explode(F.array("low", F.bitwise_not("high")))
    rows = sets.select("id", "n", "bits", "copies", key.alias("key"))
    best = rows.groupBy("key").agg(F.min("id").alias("first"), F.max_by("id", "copies").alias("most"), F.count(F.lit(1)).alias("lines"))
    best = best.where("lines > 1").select("key", F.explode(F.array_distinct(F.array("first", "most"))).alias("pivot"))
    met = rows.join(best, "key").where("id <> pivot").select("id", "n", "bits", "pivot").distinct()
    pivots = sets.select(F.col("id").alias("pivot"), F.col("n").alias("m"), F.col("bits").alias("c"))
    possible = _possible(p).replace("r.n", "m").replace("r.bits", "c").replace("l.", "")
    pairs = met.join(pivots, "pivot").where(possible)
    return pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _joined_pairs(sets: DataFrame, p: LineDedup) -> DataFrame:
    """Pairs whose later line is undecided, that share a prefix token and pass all filters.

    At the first token that two lines share, all before it on either side differ, and those behind differ in as many
    tokens at least as their bitmaps in bits. At later ones this counts too many, but a pair needs to meet once only.
    """
    rows = sets.select("id", "n", "undecided", F.posexplode(F.arrays_zip("prefix", _rests("bits"), _rests("half", _half))).alias("at", "x")).where("x.prefix is not null")
    token = F.col("x.prefix").bitwiseAND(F.lit((1 << 40) - 1))
    rows = rows.select(token.alias("token"), "id", F.col("x.2").alias("half"), F.col("x.1").bitwiseXOR(F.col("x.2")).alias("other"), F.expr("shiftleft(n * 2L + undecided, 32) | at").alias("packed"))
    n, m, i, j = "(l.packed >> 33)", "(r.packed >> 33)", "(l.packed & 4294967295L)", "(r.packed & 4294967295L)"
    short = f"least({n}, {m})"
    # a condition on the later line alone would filter one side before its exchange, and both could not share it
    undecided = "((r.packed | (l.packed & 0L)) & 4294967296L) > 0"
    return sets.sparkSession.sql(
        f"""SELECT DISTINCT l.id AS a, r.id AS b FROM {{rows}} l JOIN {{rows}} r ON l.token = r.token
        WHERE l.id < r.id AND {undecided} AND {short} * 100 >= greatest({n}, {m}) * {p.percent}
          AND (CASE WHEN {n} <= {m} THEN {i} ELSE {j} END) <= {short} - ({_needed(p, short, short)})
          AND least({n} - {i}, {m} - {j}) >= {_needed(p, n, m)}
          AND {n} - {i} + {m} - {j} - bit_count(l.half ^ r.half) - bit_count(l.other ^ r.other) >= 2 * ({_needed(p, n, m)})""",
        rows=rows,
    )


def _numbered(sets: DataFrame, lines: DataFrame) -> DataFrame:
    """``sets`` with an id that ascends with (doc_id, line_no): both packed if they fit, else the place in a sort."""
    low, high, last = lines.agg(F.min("doc_id"), F.max("doc_id"), F.max("line_no")).first()
    if low is None:
        return sets.withColumn("id", F.lit(0).cast("long"))
    width = int(last).bit_length()
    if isinstance(low, int) and (high - low).bit_length() + width <= 62:
        return sets.withColumn("id", F.shiftleft(F.col("doc_id").cast("long") - F.lit(low), width) + F.col("line_no"))
    return sets.orderBy("doc_id", "line_no").withColumn("id", F.monotonically_increasing_id())


def matched_lines(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """(doc_id, line_no) of every line of ``docs`` (doc_id, text) that matches an earlier line; numbers begin at 0."""
    spark = docs.sparkSession
    lines = keep(_lines(docs, p))
    place = F.struct("doc_id", "line_no")
    first = F.min(F.struct("doc_id", "line_no", "n", "bits", "half", "low", "high", "prefix")).alias("first")
    grouped = lines.groupBy("set_a", "set_b").agg(first, F.count(F.lit(1)).alias("copies"))
    sets = keep(_numbered(grouped.select("set_a", "set_b", "copies", "first.*"), lines))
    repeated = sets.where("copies > 1").select("set_a", "set_b", place.alias("first"))
    copies = lines.select("set_a", "set_b", "doc_id", "line_no").join(repeated, ["set_a", "set_b"]).where(place != F.col("first"))
    copies = keep(copies.select("doc_id", "line_no"))
    release(lines)
    # a set too small to lose a token matches its equals only, which are one row here
    able = sets.where(100 * F.col("n") >= p.percent * (F.col("n") + 1))
    decided = settled(spark, lambda: _verified(_pivot_pairs(able, p), able, docs, p))
    marked = able.join(decided.withColumn("decided", F.lit(1)), "id", "left")
    marked = marked.withColumn("undecided", F.expr("CASE WHEN decided IS NULL THEN 1 ELSE 0 END"))
    rest = settled(spark, lambda: _verified(_joined_pairs(marked, p), able, docs, p))
    near = sets.join(decided.unionByName(rest).distinct(), "id")
    return copies.unionByName(near.select("doc_id", "line_no")).distinct()


def without_matched_lines(docs: DataFrame, p: LineDedup = LineDedup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with lines removed that match an earlier line, and n_lines (before) and n_removed.

    Earlier means a smaller (doc_id, line number), whether or not that line stays. Tokens are runs of characters
    other than ASCII white space; lines without any stay. A long text, or many lines of one, is no case of its
    own. A null text stays null without lines; rows without id lose nothing and remove nothing; rows that repeat an id are one document,
    whose lines at the same place are not held against each other. Other columns stay as they are, but
    columns named n_lines and n_removed are replaced; an empty table stays empty.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    removed = settled(
        docs.sparkSession,
        lambda: matched_lines(source, p).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list("line_no").alias("__removed")),
    )
    removed = _few(removed, "__removed", 4, p.most_broadcast)
    # a generator splits a text once; as an expression inside the lambda it would be split for every line
    lines = F.explode(F.array(F.split(text, "\n"))).alias("__lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__removed"))
    left = F.transform(stay, lambda k: F.get("__lines", k))
    return (
        docs.drop("n_lines", "n_removed").join(removed, F.col(doc_id) == F.col("__doc"), "left").select("*", lines)
        .withColumn("n_lines", F.coalesce(F.size("__lines"), F.lit(0)))
        .withColumn("n_removed", F.coalesce(F.size("__removed"), F.lit(0)))
        .withColumn(text, F.when(F.col("__removed").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
        .drop("__doc", "__removed", "__lines")
    )


def without_matched_lines_sql(p: LineDedup = LineDedup()) -> str:
    """doc_id, text, n_lines and n_removed in DuckDB SQL over ``documents``; prefixes by exact token counts."""
    return f"""WITH l AS (
  SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)), t AS (
  SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) AS tokens FROM l), s AS (
  SELECT tokens, min({{'d': doc_id, 'k': line_no}}) AS first, len(tokens) AS n, row_number() OVER () AS id
  FROM t WHERE len(tokens) >= {p.least_tokens} GROUP BY tokens), e AS (
  SELECT id, n, unnest(tokens) AS token FROM s), f AS (
  SELECT token, count(*) AS lines FROM e GROUP BY token), c AS (
  SELECT id, n, token, row_number() OVER (PARTITION BY id ORDER BY lines, token) AS place FROM e JOIN f USING (token)), x AS (
  SELECT id, token FROM c WHERE place <= n - (n * {p.percent} + 99) // 100 + 1), pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.token = b.token AND a.id <> b.id), near AS (
  SELECT DISTINCT b.id FROM pairs JOIN s a ON a.id = pairs.a JOIN s b ON b.id = pairs.b
  WHERE a.first < b.first AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {p.percent}
    AND 100 * len(list_intersect(a.tokens, b.tokens))
        >= {p.percent} * (a.n + b.n - len(list_intersect(a.tokens, b.tokens)))), gone AS (
  SELECT t.doc_id, t.line_no FROM t JOIN s USING (tokens) WHERE {{'d': t.doc_id, 'k': t.line_no}} <> s.first
     OR s.id IN (SELECT id FROM near)), marked AS (
  SELECT l.*, g.doc_id IS NOT NULL AS gone FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text,
       CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed
FROM marked GROUP BY doc_id"""
