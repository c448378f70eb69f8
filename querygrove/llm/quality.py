"""Quality rules as a short-circuit cascade.

The counts that the contract asks for are taken of every text, in one vectorised pass. Each rule
names the further counts that it needs; they are computed when the rule's turn comes, and only of
the texts that all earlier rules passed. On a sample of the whole table each rule's cost, its own
counts included, and its share of rejected documents are measured on the executors; the rules run
in order of rejection per cost. The verdict doesn't depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from . import textkernels as K
from .shared import read, row_count, small_batches

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True

#: Bytes of texts that are counted at a time.
SLICE = 1 << 19
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; all are 0 for
    a null or empty text."""
    buf = K.buffer_of(texts)
    tok = K.words(buf)
    head = (buf.data & 0xC0) != 0x80  # one byte of each code point
    in_words = np.concatenate([[0], np.cumsum(head, dtype=np.int64)])
    chars = in_words[tok.end] - in_words[tok.start]
    out = {
        "n_words": tok.count.astype(np.int64),
        "word_chars": np.bincount(tok.row, weights=chars, minlength=len(tok.count)).astype(np.int64),
        "n_symbols": K.sums(_SYMBOL[buf.data], buf.starts, buf.ends),
    }
    lines = K.spans(buf, _NEWLINE)
    word_starts = np.zeros(len(buf.data) + 1, np.int64)
    word_starts[tok.start + 1] = 1
    seen = np.cumsum(word_starts)
    full = seen[lines.end] > seen[lines.start]
    lh, lrow = K.span_hash(buf.data, lines.start, lines.end)[full], lines.row[full]
    with_word = np.bincount(lrow, minlength=len(tok.count))
    _, distinct = K.distinct_in_rows(lh, with_word)
    out["n_dup_lines"] = (with_word - distinct).astype(np.int64)
    out["n_repeat_words"] = _repeated(K.span_hash(buf.data, tok.start, tok.end), tok)
    return out


def _repeated(h: np.ndarray, tok: K.Tokens, k: int = 3) -> np.ndarray:
    """Words inside k-word windows that occur twice or more in the row."""
    n = np.maximum(tok.count - k + 1, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(len(n), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    begins = np.concatenate([[0], np.cumsum(tok.count)])[:-1]
    at = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n) + begins[row]
    key = np.zeros(total, K.U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            key = key * K.U64(0x2545F4914F6CDD1D) + K.mix(h[at + j] + K.U64(j + 1))
        key = K.mix(key + row.astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(total, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    flag = np.zeros(len(h), bool)
    for j in range(k):
        flag[at[twice] + j] = True
    return np.bincount(tok.row[flag], minlength=len(n)).astype(np.int64)


def letter_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_letters and n_upper (A-Z) of each text."""
    buf = K.buffer_of(texts)
    head = (buf.data & 0xC0) != 0x80
    return {"n_letters": K.sums(_LETTER[buf.data] & head, buf.starts, buf.ends), "n_upper": K.sums(_UPPER[buf.data], buf.starts, buf.ends)}


def mark_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_marks: exclamation marks of each text."""
    buf = K.buffer_of(texts)
    return {"n_marks": K.sums(buf.data == 33, buf.starts, buf.ends)}


def line_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Of the lines with a word: n_lines, n_bullets (the first word begins with -, * or a bullet)
    and n_ellipses (the last word ends with three dots or an ellipsis)."""
    buf = K.buffer_of(texts)
    tok, lines = K.words(buf), K.spans(buf, _NEWLINE)
    rows = len(tok.count)
    first = np.searchsorted(tok.start, lines.start)
    last = np.searchsorted(tok.start, lines.end) - 1
    has = last >= first
    row, first, last = lines.row[has], first[has], last[has]
    begin, end = tok.start[first], tok.end[last]
    data = np.concatenate([buf.data, np.zeros(3, np.uint8)])

    def three(at: np.ndarray, want: bytes) -> np.ndarray:
        return (at >= 0) & (data[at] == want[0]) & (data[at + 1] == want[1]) & (data[at + 2] == want[2])

    bullet = (data[begin] == 45) | (data[begin] == 42) | three(begin, "•".encode())
    inside = end - 3 >= tok.start[last]
    dots = inside & (three(end - 3, b"...") | three(end - 3, "…".encode()))
    n = lambda x: np.bincount(x, minlength=rows).astype(np.int64)
    return {"n_lines": n(row), "n_bullets": n(row[bullet]), "n_ellipses": n(row[dots])}


#: Function words of the languages that the tables hold; a text in any of them has some.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "is", "that", "der", "die", "das", "und", "von", "zu", "le", "la", "les", "de", "et", "des", "el", "los", "que", "en", "un", "une", "est")


def function_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_function: words that are, with A-Z lower-cased, one of FUNCTION_WORDS."""
    buf = K.lowered(K.buffer_of(texts))
    tok = K.words(buf)
    short = tok.end - tok.start <= max(map(len, FUNCTION_WORDS))
    known = K.lowered(K.buffer_of(pa.array(FUNCTION_WORDS)))
    want = np.sort(K.span_hash(known.data, known.starts, known.ends))
    h = K.span_hash(buf.data, tok.start[short], tok.end[short])
    hit = want[np.minimum(np.searchsorted(want, h), len(want) - 1)] == h
    return {"n_function": np.bincount(tok.row[short][hit], minlength=len(tok.count)).astype(np.int64)}


def pair_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_top_pair: how often the commonest pair of words that follow each other occurs."""
    buf = K.buffer_of(texts)
    tok = K.words(buf)
    h = K.span_hash(buf.data, tok.start, tok.end)
    rows = len(tok.count)
    if len(h) < 2:
        return {"n_top_pair": np.zeros(rows, np.int64)}
    inside = tok.row[1:] == tok.row[:-1]
    row = tok.row[1:][inside]
    with np.errstate(over="ignore"):
        pair = K.mix(h[:-1][inside] * K.U64(0x2545F4914F6CDD1D) + h[1:][inside])
    order = np.lexsort((pair, row))
    pair, row = pair[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])])) if len(pair) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(pair)))
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, row[first], size)
    return {"n_top_pair": top}


#: What gives the counts that aren't the contract's.
MEASURES: dict[str, Callable[[pa.Array], dict[str, np.ndarray]]] = {
    "n_letters": letter_counts, "n_upper": letter_counts, "n_marks": mark_counts, "n_lines": line_counts,
    "n_bullets": line_counts, "n_ellipses": line_counts, "n_function": function_counts, "n_top_pair": pair_counts,
}


@dataclass(frozen=True)
class Rule:
    """Rejects where `reject(counts)` is true; `needs` names the counts that it reads."""

    name: str
    needs: tuple[str, ...]
    sql: str
    reject: Callable[[dict[str, np.ndarray]], np.ndarray]


#: Integer arithmetic throughout, so every engine that evaluates `sql` agrees.
RULES: tuple[Rule, ...] = (
    Rule("symbols", ("n_symbols", "n_words"), "10 * n_symbols > 3 * n_words", lambda c: 10 * c["n_symbols"] > 3 * c["n_words"]),
    Rule("short_words", ("word_chars", "n_words"), "word_chars < 2 * n_words", lambda c: c["word_chars"] < 2 * c["n_words"]),
    Rule("long_words", ("word_chars", "n_words"), "word_chars > 12 * n_words", lambda c: c["word_chars"] > 12 * c["n_words"]),
    Rule("duplicate_lines", ("n_dup_lines", "n_words"), "2 * n_dup_lines > n_words", lambda c: 2 * c["n_dup_lines"] > c["n_words"]),
    Rule("shouting", ("n_upper", "n_letters"), "2 * n_upper > n_letters", lambda c: 2 * c["n_upper"] > c["n_letters"]),
    Rule("marks", ("n_marks", "n_words"), "10 * n_marks > 5 * n_words", lambda c: 10 * c["n_marks"] > 5 * c["n_words"]),
    Rule("bullets", ("n_bullets", "n_lines"), "10 * n_bullets > 9 * n_lines", lambda c: 10 * c["n_bullets"] > 9 * c["n_lines"]),
    Rule("ellipses", ("n_ellipses", "n_lines"), "10 * n_ellipses > 3 * n_lines", lambda c: 10 * c["n_ellipses"] > 3 * c["n_lines"]),
    Rule("function_words", ("n_function",), "n_function < 2", lambda c: c["n_function"] < 2),
    Rule("top_pair", ("n_top_pair", "n_words"), "10 * n_top_pair > 2 * n_words", lambda c: 10 * c["n_top_pair"] > 2 * c["n_words"]),
)


def base_failed(c: dict[str, np.ndarray], least_words: int = 50, most_repeated: int = 50) -> np.ndarray:
    return (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeated * c["n_words"])


def _supply(texts: pa.Array, have: dict[str, np.ndarray], needs: Sequence[str]) -> dict[str, np.ndarray]:
    """have, with what is missing of needs computed from the texts."""
    for name in needs:
        if name not in have:
            have = have | MEASURES[name](texts)
    return have


def cascade(texts: pa.Array, counts: dict[str, np.ndarray], rules: Sequence[Rule], tally: dict[str, int] | None = None) -> np.ndarray:
    """True where no rule rejects. A rule's counts are taken of, and the rule sees, only the texts
    that the earlier ones passed; counts that are there already are used again. tally adds up how
    many texts each rule was given."""
    left, have = np.arange(len(texts)), counts
    for rule in rules:
        if not len(left):
            break
        if tally is not None:
            tally[rule.name] = tally.get(rule.name, 0) + len(left)
        have = _supply(texts, have, rule.needs)
        ok = ~rule.reject(have)
        if not ok.all():
            left, have = left[ok], {k: v[ok] for k, v in have.items()}
            texts = texts.take(pa.array(np.flatnonzero(ok)))
    kept = np.zeros(len(counts["n_words"]), bool)
    kept[left] = True
    return kept


def verdicts(texts: pa.Array, rules: Sequence[Rule], tally: dict[str, int] | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The contract's counts, base_failed and kept of each text."""
    parts = []
    for part in K.slices(texts, SLICE):
        c = base_counts(part)
        failed = base_failed(c)
        alive = np.flatnonzero(~failed)
        kept = np.zeros(len(failed), bool)
        kept[alive] = cascade(part.take(pa.array(alive)), {k: v[alive] for k, v in c.items()}, rules, tally)
        parts.append((c, failed, kept))
    return {k: np.concatenate([p[0][k] for p in parts]) for k in COUNTS}, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def measure(docs: DataFrame, rules: Sequence[Rule], rows: int, seed: int = 5) -> dict[str, tuple[int, int, float]]:
    """(texts, rejected, seconds) of each rule, each on all texts of a sample that pass the base
    rule: about `rows` rows drawn over the whole table. Texts stay on the executors; a row per rule
    and task is summed up."""
    total = row_count(docs)
    by_name = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {n: [0, 0, 0.0] for n in by_name}
        for batch in batches:
            for part in K.slices(batch.column(0), SLICE):
                c = base_counts(part)
                alive = np.flatnonzero(~base_failed(c))
                texts, c = part.take(pa.array(alive)), {k: v[alive] for k, v in c.items()}
                for name, rule in by_name.items():
                    began = time.perf_counter()
                    gone = rule.reject(_supply(texts, c, rule.needs))
                    seen[name][2] += time.perf_counter() - began
                    seen[name][0] += len(alive)
                    seen[name][1] += int(gone.sum())
        yield pa.RecordBatch.from_pylist([{"name": n, "texts": a, "rejected": b, "seconds": s} for n, (a, b, s) in seen.items()])

    text = docs.select(F.col("text").cast("string").alias("text"))
    drawn = text.sample(min(1.0, rows / total), seed) if total > rows else text
    got = drawn.mapInArrow(run, "name string, texts long, rejected long, seconds double")
    got = got.groupBy("name").agg(F.sum("texts").alias("texts"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect()
    return {r["name"]: (r["texts"], r["rejected"], r["seconds"]) for r in got}


def order_rules(measured: dict[str, tuple[int, int, float]], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Rules by rejected documents per second of cost, best first. Those that rejected nothing come
    last, the cheap ones first; ties by name."""
    none = (0, 0, 0.0)

    def place(rule: Rule) -> tuple:
        _, rejected, seconds = measured.get(rule.name, none)
        return (-rejected / (seconds + 1e-9), seconds, rule.name)

    return sorted(rules, key=place)


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
#: About this many rows of the whole table are the sample that orders the rules.
SAMPLE_ROWS = 2_000


def annotate(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, into: str = "quality") -> DataFrame:
    """docs with a struct column `into` of the counts, base_failed and kept.

    Nulls: a null text has no words and fails the base rule, as an empty one does; null ids pass
    through. Very long texts are judged whole. Repeated rows are judged alike, so there are no
    ties. An empty table stays empty. Only the text crosses to Python; all other columns stay, and
    one that is called like `into` gives way. `sample_rows` bounds the sample that steers the order
    of the rules; it changes no verdict.
    """
    small_batches(docs.sparkSession)
    ordered = order_rules(measure(docs, rules, sample_rows), rules)

    @arrow_udf(_SCHEMA)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            c, failed, kept = verdicts(texts, ordered)
            yield pa.StructArray.from_arrays([*(pa.array(c[k]) for k in COUNTS), pa.array(failed), pa.array(kept)], [*COUNTS, "base_failed", "kept"])

    return docs.withColumn(into, judge(F.col("text").cast("string")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document; see annotate for nulls, empty and long texts."""
    return annotate(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
b AS (SELECT r, doc_id, text, ws, len(ws) AS n_words,
  coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
  length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters,
  len(list_filter(ws, lambda x: list_contains(""" + str(list(FUNCTION_WORDS)) + r""", translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS n_function FROM w),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')) AS n_bullets,
  count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_ellipses FROM (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
t AS (SELECT r, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] AS tri FROM (
  SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
u AS (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM t),
q AS (SELECT r, max(n) AS n_top FROM (SELECT r, count(*) AS n FROM (SELECT r, ws[i] || chr(0) || ws[i + 1] AS pair FROM (
  SELECT r, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) >= 2)) GROUP BY r, pair) GROUP BY r),
p AS (SELECT r, count(DISTINCT j) AS n_rep FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM u WHERE n > 1) GROUP BY r),
a AS (SELECT b.*, coalesce(l.n_dup, 0) AS n_dup_lines, coalesce(p.n_rep, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_bullets, 0) AS n_bullets,
  coalesce(l.n_ellipses, 0) AS n_ellipses, coalesce(q.n_top, 0) AS n_top_pair FROM b LEFT JOIN l USING (r) LEFT JOIN p USING (r) LEFT JOIN q USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (""" + " OR ".join(f"({r.sql})" for r in RULES) + ") AS kept FROM f"
