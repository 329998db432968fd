"""Quality rules: learned decision lists.

Text statistics are taken of every document in one pass without a shuffle.
Sequential covering grows threshold conjunctions on labelled statistics and
prunes them on held-back rows; the list becomes one ordered Spark
``when``/``otherwise`` expression, so applying it is a plain projection.

Defined results: a null text has no words and all counts 0; a repeated
doc_id gives one row per row; a document whose label rows disagree is
trained on by majority (a tie is good); with no usable label the list is
empty and every document that passes the base rule is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warung.llm import textscan as S

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_alpha", "n_digits", "n_stops", "n_distinct", "n_chars_all"]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80          # a byte that begins a code point
_ALPHA = np.array([chr(b).isalpha() if b < 128 else b >= 0xC3 for b in range(256)]) & _LEAD
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True


def _repeats(h: np.ndarray) -> np.ndarray:
    """Which entries equal an entry elsewhere."""
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    return n[back] > 1


def text_counts(data: bytes | None, window: int = 5) -> list[int]:
    """COUNTS then MORE of one text."""
    if not data:
        return [0] * (len(COUNTS) + len(MORE))
    raw = S.as_array(data)
    starts, ends = S.word_spans(raw)
    prefix = S.prefix_hash(raw)
    words = S.span_hashes(prefix, starts, ends)
    lead = _LEAD[raw]
    chars = np.concatenate(([0], np.cumsum(lead)))
    word_chars = int((chars[ends] - chars[starts]).sum())
    low, high = S.line_spans(raw)
    at = np.searchsorted(starts, low)
    full = (at < len(starts)) & (np.append(starts, len(raw) + 1)[at] < high)
    lines = S.span_hashes(prefix, low[full], high[full])
    dup_lines = len(lines) - len(np.unique(lines))
    repeat = 0
    grams = S.shingle_hashes(words, window)
    if len(grams):
        twice = _repeats(grams)
        if twice.any():
            cover = np.zeros(len(words) + 1, dtype=np.int32)
            at = np.flatnonzero(twice)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            repeat = int((np.cumsum(cover)[:-1] > 0).sum())
    return [len(words), word_chars, int(_SYMBOL[raw].sum()), dup_lines, repeat,
            int(full.sum()), int(_ALPHA[raw].sum()), int(_DIGIT[raw].sum()), int(_STOP[raw].sum()),
            len(np.unique(words)), int(lead.sum())]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the statistics, every one a long."""
    names = COUNTS + MORE

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in S.texts_of(batch, "_text"):
                found = np.array([text_counts(t) for t in texts], dtype=np.int64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), *(pa.array(found[:, j]) for j in range(len(names)))], ["_id", *names])

    pair = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = pair.schema["_id"].dataType.simpleString()
    return pair.mapInArrow(scan, f"_id {kind}, " + ", ".join(f"{n} long" for n in names))


# ------------------------------------------------------------- the features
def features() -> dict[str, Column]:
    """What thresholds are learned on: ratios, so that length alone is no rule."""
    def per(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "word_length": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_chars_all"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "alpha_ratio": per("n_alpha", "n_chars_all"),
        "digit_ratio": per("n_digits", "n_chars_all"),
        "stop_ratio": per("n_stops", "n_words"),
        "distinct_ratio": per("n_distinct", "n_words"),
    }


Rule = list[tuple[str, str, float]]


def _holds(x: dict[str, np.ndarray], rule: Rule, n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for name, op, cut in rule:
        out &= x[name] > cut if op == ">" else x[name] <= cut
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> Rule:
    """Add the condition of the highest information gain until none is wrong."""
    rule: Rule = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most:
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        if not n0 or not p0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None, None)
        for name, edges in cuts.items():
            for cut in edges:
                over = x[name] > cut
                for op, side in ((">", over), ("<=", ~over)):
                    held = inside & side
                    p = (bad & held).sum()
                    if p:
                        gain = p * (np.log2(p / held.sum()) - base)
                        if gain > best[0]:
                            best = (gain, (name, op, float(cut)), held)
        if best[1] is None:
            break
        rule.append(best[1])
        inside = best[2]
    return rule


def _prune(x: dict[str, np.ndarray], bad: np.ndarray, rule: Rule) -> Rule:
    """Drop final conditions while (p - n) / (p + n) on held-back rows does not fall."""
    def worth(r: Rule) -> float:
        held = _holds(x, r, len(bad))
        return (2 * (bad & held).sum() - held.sum()) / max(held.sum(), 1)
    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.9, support: int = 5,
                max_rules: int = 12, max_conditions: int = 3, n_cuts: int = 24, seed: int = 7) -> list[Rule]:
    """Ordered rules that each find bad rows.  Two thirds of the rows grow,
    one third prunes; covering stops when a rule falls below ``precision`` on
    either part, so what no trustworthy rule covers is kept."""
    if not bad.any() or bad.all():
        return []
    grow_part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, n_cuts + 2)[1:-1])) for k, v in x.items()}
    left, rules = np.ones(len(bad), dtype=bool), []
    while len(rules) < max_rules:
        a, b = left & grow_part, left & ~grow_part
        rule = _grow({k: v[a] for k, v in x.items()}, bad[a], cuts, max_conditions)
        if not rule:
            break
        rule = _prune({k: v[b] for k, v in x.items()}, bad[b], rule)
        held = _holds(x, rule, len(bad)) & left
        parts = [(bad & held & side).sum() / max((held & side).sum(), 1) for side in (a, b)]
        if held.sum() < support or min(parts) < precision:
            break
        rules.append(rule)
        left &= ~held
    return rules


def fit_rules(stats: DataFrame, labels: DataFrame, *, label_col: str = "quality", **how) -> list[Rule]:
    """Learn from the joined rows (bounded by the caller's sample of labels)."""
    names = features()
    rows = stats.join(labels, "_id").select(*(c.alias(n) for n, c in names.items()), label_col).toPandas()
    x = {n: rows[n].to_numpy(dtype=float) for n in names}
    return learn_rules(x, (rows[label_col] == 0).to_numpy(dtype=bool), **how)


def rule_expression(rules: list[Rule]) -> Column:
    """The list as one ordered expression: the number of the first rule that
    holds (from 1), else 0."""
    names, out = features(), None
    for k, rule in enumerate(rules, 1):
        held = F.lit(True)
        for name, op, cut in rule:
            held = held & (names[name] > cut if op == ">" else names[name] <= cut)
        out = F.when(held, F.lit(k)) if out is None else out.when(held, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            max_labelled: int = 20_000, **how) -> DataFrame:
    """Statistics, base rule and the learned verdict of every document.

    ``max_labelled`` bounds the labelled rows the list is fitted on (those of
    the smallest hash); statistics and verdicts cover all rows.
    """
    votes = (labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.round(F.avg("quality") + 1e-9).cast("int").alias("quality"))
             .orderBy(F.xxhash64("_id"), "_id").limit(max_labelled))
    chosen = F.broadcast(votes)                   # at most max_labelled rows
    some = docs.join(chosen.select(F.col("_id").alias(id_col)), id_col, "left_semi")
    rules = fit_rules(statistics(some, id_col, text_col).where(~base_failed()), chosen, **how)
    out = statistics(docs, id_col, text_col).withColumn("base_failed", base_failed())
    out = out.withColumn("rule", rule_expression(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).withColumnRenamed("_id", id_col)
