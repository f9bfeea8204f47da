"""Quality rules: a decision list learned by sequential covering over the statistics of labelled texts.

Every whole text is turned into counts (words, symbols, repeated lines and windows, marks); rates are Spark expressions over
them. Two thirds of the labelled rows grow a conjunction of thresholds, condition by condition, for the verdict that is rarer
among the rows not yet covered; the others prune its end and decide whether it stays. Covered rows leave, and so on until no
conjunction is good enough. The list is emitted as one ordered conditional expression, ``CASE WHEN ... THEN ... ELSE ... END``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import materialize, read, set_aside

#: At most about this many labelled rows train the list.
MAX_TRAINING_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS = 24, 4
#: Cut points tried for each statistic, least share of right verdicts and least rows of a rule (both on the pruning rows).
CUTS, LEAST_PRECISION, LEAST_ROWS = 48, 0.9, 3
BASE_WORDS, BASE_REPEATED_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits", "n_upper", "n_marks", "n_ended_lines", "longest_word")
_SYMBOLS, _DIGITS, _UPPER = b"#*$%&|<>", b"0123456789", bytes(range(0x41, 0x5B))
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that stand twice or more in the text, the first one included."""
    n = len(words)
    if n < 3:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:  # the key of three would not fit 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[i : n - 2 + i] |= again
    return int(hit.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """Numbers in the order of COUNTS; all 0 for a null text. Words stand between blanks and the controls 9 to 13."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    without = lambda characters: len(raw) - len(raw.translate(None, characters))
    return (
        len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), without(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words)),
        without(_DIGITS), without(_UPPER), without(_MARKS), sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines), max(map(len, words), default=0),
    )


def counts(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=list(COUNTS))

    return of(text)


def statistics(c: str = "counts") -> dict[str, Column]:
    """The rates that rules may ask for, from a struct column of counts; 0 where there is nothing to divide by."""
    of = lambda a, b: F.coalesce(F.try_divide(F.col(f"{c}.{a}"), F.col(f"{c}.{b}")), F.lit(0.0))
    return {
        "words": F.col(f"{c}.n_words").cast("double"),
        "mean_word": of("word_chars", "n_words"),
        "longest_word": F.col(f"{c}.longest_word").cast("double"),
        "symbols_per_word": of("n_symbols", "n_words"),
        "duplicate_lines": of("n_dup_lines", "n_lines"),
        "repeated_words": of("n_repeat_words", "n_words"),
        "words_per_line": of("n_words", "n_lines"),
        "distinct_words": of("n_distinct", "n_words"),
        "digits": of("n_digits", "word_chars"),
        "capitals": of("n_upper", "word_chars"),
        "marks": of("n_marks", "word_chars"),
        "ended_lines": of("n_ended_lines", "n_lines"),
    }


def base_failed(c: str = "counts") -> Column:
    return (F.col(f"{c}.n_words") < BASE_WORDS) | (100 * F.col(f"{c}.n_repeat_words") > BASE_REPEATED_PERCENT * F.col(f"{c}.n_words"))


@dataclass
class Rule:
    """``conditions``: (statistic, above?, threshold); right and wrong verdicts on the pruning rows it covered."""

    keep: bool
    conditions: list[tuple[str, bool, float]]
    right: int = 0
    wrong: int = 0

    def covers(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        hit = np.ones(n, bool)
        for name, above, t in self.conditions:
            hit &= x[name] > t if above else x[name] <= t
        return hit

    def test(self, of: dict[str, Column]) -> Column:
        hit = F.lit(True)
        for name, above, t in self.conditions:
            hit = hit & (of[name] > t if above else of[name] <= t)
        return hit

    def __str__(self) -> str:
        return f"{'keep' if self.keep else 'drop'} if {' and '.join(f'{c} {'>' if above else '<='} {t:g}' for c, above, t in self.conditions)} ({self.right} right, {self.wrong} wrong)"


@dataclass
class DecisionList:
    """Ordered rules; ``default`` is the verdict of texts that none covers."""

    rules: list[Rule] = field(default_factory=list)
    default: bool = True

    def verdict(self, of: dict[str, Column]) -> Column:
        found = F.when(F.lit(False), F.lit(self.default))
        for rule in self.rules:
            found = found.when(rule.test(of), F.lit(rule.keep))
        return found.otherwise(F.lit(self.default))

    def rule_number(self, of: dict[str, Column]) -> Column:
        """Number of the rule that decides, from 1; 0 for the default."""
        found = F.when(F.lit(False), F.lit(0))
        for i, rule in enumerate(self.rules, 1):
            found = found.when(rule.test(of), F.lit(i))
        return found.otherwise(F.lit(0))


def _grow(x: dict[str, np.ndarray], wanted: np.ndarray, keep: bool) -> Rule:
    """Add the condition with the largest gain of information about ``wanted`` rows until none of the others is left."""
    hit, rule = np.ones(len(wanted), bool), Rule(keep, [])
    while len(rule.conditions) < MAX_CONDITIONS:
        p0, all0 = int(wanted[hit].sum()), int(hit.sum())
        if p0 == all0:
            break
        best = None
        for name, values in x.items():
            mine = np.sort(values[hit])
            cuts = np.unique(mine[np.linspace(0, all0 - 1, CUTS + 1).astype(int)])
            cuts = np.unique([float(f"{(a + b) / 2:.4g}") for a, b in zip(cuts, cuts[1:], strict=False)])
            good = np.sort(values[hit & wanted])
            p = np.searchsorted(good, cuts, side="right")
            t = np.searchsorted(mine, cuts, side="right")
            for above, pa, ta in ((False, p, t), (True, p0 - p, all0 - t)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pa > 0, pa * (np.log2(pa / np.maximum(ta, 1)) - np.log2(p0 / all0)), 0.0)
                if len(gain) and (best is None or gain.max() > best[0] + 1e-9):
                    i = int(gain.argmax())
                    best = (float(gain[i]), name, above, float(cuts[i]))
        if best is None or best[0] <= 1e-9:
            break
        rule.conditions.append(best[1:])
        hit &= Rule(keep, [best[1:]]).covers(x, len(wanted))
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], wanted: np.ndarray) -> Rule:
    """Of the rule's beginnings the one with the best share of right verdicts less wrong ones on the pruning rows; the shorter of equals."""
    best = None
    for n in range(1, len(rule.conditions) + 1):
        cut = Rule(rule.keep, rule.conditions[:n])
        hit = cut.covers(x, len(wanted))
        cut.right, cut.wrong = int((hit & wanted).sum()), int((hit & ~wanted).sum())
        worth = (cut.right - cut.wrong) / max(1, cut.right + cut.wrong)
        if best is None or worth > best[0]:
            best = (worth, cut)
    return best[1] if best else rule


def learn(x: dict[str, np.ndarray], good: np.ndarray, pruning: np.ndarray) -> DecisionList:
    """The list of the rows ``x`` (statistic: values) with labels ``good``; those marked ``pruning`` prune. Ties go to the statistic
    named first, so equal rows give equal lists. Rows of one label alone, or none, give a list without rules."""
    found = DecisionList()
    left = np.ones(len(good), bool)
    while len(found.rules) < MAX_RULES and good[left].any() and not good[left].all():
        rarer = bool(good[left].mean() < 0.5)
        for keep in (rarer, not rarer):
            wanted = good == keep
            grow, prune = left & ~pruning, left & pruning
            rule = _grow({c: v[grow] for c, v in x.items()}, wanted[grow], keep)
            rule = _prune(rule, {c: v[prune] for c, v in x.items()}, wanted[prune])
            if rule.conditions and rule.right >= LEAST_ROWS and rule.right >= LEAST_PRECISION * (rule.right + rule.wrong):
                break
        else:
            break
        found.rules.append(rule)
        left &= ~rule.covers(x, len(good))
    found.default = bool(not left.any() or good[left].mean() >= 0.5)
    return found


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DecisionList:
    """The list for ``labels.quality`` (1: keep), from labelled texts that pass the base rules.

    A document with several labels is good if all say so; null ids and labels are left out. Rows whose crc32(doc_id as text)
    mod 3 is 0 prune. Above ``max_rows`` labelled rows, those with the smallest id hashes are taken, so many that about
    ``max_rows`` remain; their statistics (not the texts) come to the driver.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("own_id")).agg((F.min("quality") > 0).alias("good"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("own_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("own_id"))
    rows = rows.select("own_id", "good", counts(F.col("text")).alias("counts")).where(~base_failed())
    seen = rows.select("own_id", "good", (F.pmod(F.crc32(F.col("own_id").cast("string")), F.lit(3)) == 0).alias("pruning"), *(v.alias(k) for k, v in statistics().items())).toPandas()
    seen = seen.sort_values(list(seen.columns), kind="stable")
    return learn({c: seen[c].to_numpy(float) for c in statistics()}, seen["good"].to_numpy(bool), seen["pruning"].to_numpy(bool))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs``, all columns, with structs ``counts`` and ``quality`` (base_failed, rule, kept) that take the
    place of columns of these names. A null text has no words and fails the base rules; repeated rows are judged row by row; an
    empty table stays empty. ``rule`` is the deciding rule's number, 0 for the default, null where the base rules decide."""
    own, back = set_aside(docs, "text")
    # one evaluation of the counts for all columns made from them
    made = own.withColumn("counts", counts(F.col("text"))).withColumn("failed", base_failed())
    of = statistics()
    kept = ~F.col("failed") & rules.verdict(of)
    quality = F.struct(F.col("failed").alias("base_failed"), F.when(~F.col("failed"), rules.rule_number(of)).alias("rule"), kept.alias("kept"))
    back = [c for c, name in zip(back, docs.columns, strict=True) if name.lower() not in ("counts", "quality")]
    return made.select(*back, "counts", quality.alias("quality"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns, without the texts that fail the base rules or that the learned list drops."""
    own, back = set_aside(docs, "doc_id", "text")
    return judge(own, fit_rules(own, labels)).where("quality.kept").select(*back)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, fit_rules(docs, read(spark, sf_dir, "labels")))
    return judged.select("doc_id", *(f"counts.{c}" for c in COUNTS[:5]), "quality.base_failed", "quality.kept", "quality.rule")
