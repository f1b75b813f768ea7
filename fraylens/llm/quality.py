"""Quality rules: a decision list learned by sequential covering from labelled text statistics.

``statistics`` counts what the rules look at. ``learn`` grows one conjunction of
thresholds at a time against the low-quality class, prunes it on held-out rows,
removes what it covers and goes on. The list is emitted as an ordered Spark
conditional (``DecisionList.rule``), so scoring is a plain projection.

Defined cases: null or blank text has no words and fails the base rule; repeated
rows are judged one by one; a doc_id with several labels counts as its lowest
quality, and one with several texts trains by one of them; labels with nulls are left out; without two classes among the labels
the list is empty and only the base rule decides; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraylens.llm.common import encoded, with_columns_in_arrow

#: The characters that count as symbols, and the white space between words.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
STATS_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in STATS])
#: At most so many labelled documents train the list; the rest of the labels is not read into the driver.
TRAINING_ROWS = 20_000

_IS = np.zeros((4, 256), bool)
_IS[0, list(range(65, 91))] = True  # upper case
_IS[1, list(range(48, 58))] = True  # digits
_IS[2, [33, 63]] = True  # ! and ?
_IS[3, list(SYMBOLS)] = True


def _repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside a three-word window that the text has twice or more, and distinct words."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(ids) < 3:
        return 0, len(number)
    pair = ids[:-2] * len(number) + ids[1:-1]
    if len(number) > 2_000_000:  # three ids would not fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, place, times = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
    step = np.zeros(len(ids) + 1, np.int64)
    again = np.flatnonzero(times[place] > 1)
    np.add.at(step, again, 1)
    np.add.at(step, again + 3, -1)
    return int((np.cumsum(step[:-1]) > 0).sum()), len(number)


def _counted(text: bytes) -> tuple[int, ...]:
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    histogram = np.bincount(raw, minlength=256)
    upper, digits, marks, symbols = (int(histogram[m].sum()) for m in _IS)
    points = int(len(raw) - histogram[128:192].sum())  # bytes that begin a character
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    repeated, distinct = _repeat_words(words)
    return (
        len(words), points - int(histogram[list(SPACES)].sum()), symbols, len(lines) - len(set(lines)), repeated,
        len(lines), upper, digits, marks, distinct,
    )


def _columns(texts: list[bytes]) -> list[list[int]]:
    rows = [_counted(x) for x in texts]
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in STATS]


def statistics(docs: DataFrame, under: str = "stats") -> DataFrame:
    """``docs`` with a struct column of text statistics; one pass, no shuffle."""
    return with_columns_in_arrow(docs, encoded(F.col("text")), STATS_TYPE, _columns, under)


def base_failed(stats: Column) -> Column:
    n = stats["n_words"]
    return (n < 50) | (100 * stats["n_repeat_words"] > 50 * n)


#: Name, numerator and denominator of what a threshold may test.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


def feature(stats: Column, name: str) -> Column:
    over, under = FEATURES[name]
    return stats[over].cast("double") if under is None else stats[over] / F.greatest(stats[under], F.lit(1))


@dataclass(frozen=True)
class Test:
    """``feature > threshold``, or ``<=`` when ``above`` is false."""

    name: str
    above: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        value = feature(stats, self.name)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions; a row is rejected by the first that it meets, and kept by none."""

    rules: list[list[Test]] = field(default_factory=list)

    def rule(self, stats: Column) -> Column:
        """Number of the first rule that holds, from 1; 0 if none does."""
        out = None
        for i, tests in enumerate(self.rules, 1):
            holds = tests[0].column(stats)
            for t in tests[1:]:
                holds = holds & t.column(stats)
            out = F.when(holds, i) if out is None else out.when(holds, i)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join(f"{i}. reject if {' and '.join(map(str, r))}" for i, r in enumerate(self.rules, 1)) + "\notherwise keep"


def _covered(x: np.ndarray, tests: list[Test], names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in tests:
        v = x[:, names.index(t.name)]
        out &= v > t.threshold if t.above else v <= t.threshold
    return out


def _best_test(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: list[np.ndarray]) -> tuple[float, Test | None]:
    """The threshold of the highest information gain over the rows that a rule covers so far."""
    p, n = int(bad.sum()), int((~bad).sum())
    before = np.log2(p / (p + n))
    best: tuple[float, Test | None] = (1e-9, None)
    for j, name in enumerate(names):
        if not len(cuts[j]):
            continue
        slot = np.searchsorted(cuts[j], x[:, j], side="left")  # rows with value <= cuts[i] have slot <= i
        at = len(cuts[j]) + 1
        pos, neg = (np.cumsum(np.bincount(slot[m], minlength=at))[:-1] for m in (bad, ~bad))
        for above, pp, nn in ((False, pos, neg), (True, p - pos, n - neg)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - before), -1.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), Test(name, above, float(cuts[j][i])))
    return best


def grow_and_prune(
    x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.95, least: int = 5, longest: int = 4, most: int = 24
) -> DecisionList:
    """Sequential covering on feature rows ``x`` and labels ``bad``; every third row is held out for pruning.

    ``precision`` is what a rule must reach on held-out rows: clean documents are
    worth more than the last junk. ``least``: covered junk rows a rule needs.
    """
    held = np.arange(len(x)) % 3 == 2
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 129))) if len(x) else np.array([]) for j in range(len(names))]
    left, rules = np.ones(len(x), bool), []
    while len(rules) < most and (bad & left & ~held).sum() >= least:
        tests: list[Test] = []
        inside = left & ~held
        while len(tests) < longest and bad[inside].sum() >= least and (~bad[inside]).any():
            _, test = _best_test(x[inside], bad[inside], names, cuts)
            if test is None:
                break
            tests.append(test)
            inside = inside & _covered(x, [test], names)
        pruning = left & held

        def worth(of: list[Test]) -> tuple[float, int]:
            c = pruning & _covered(x, of, names)
            p, n = int((bad & c).sum()), int((~bad & c).sum())
            return (p - n) / max(p + n, 1), -len(of)

        tests = max((tests[:k] for k in range(1, len(tests) + 1)), key=worth, default=[])
        hit = left & _covered(x, tests, names)
        p, n = int((bad & hit & held).sum()), int((~bad & hit & held).sum())
        if not tests or p < 1 or p < precision * (p + n) or (bad & hit).sum() < least:
            break
        rules.append(tests)
        left &= ~hit
    return DecisionList(rules)


def learn(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, **limits) -> DecisionList:
    """A decision list from at most about ``training_rows`` labelled documents, drawn by the hash of the id."""
    labelled = (
        labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).where("id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("id").agg(F.min("quality").alias("quality"))
    )
    share = min(1.0, 0.97 * training_rows / max(labelled.count(), 1))
    drawn = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(training_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("id"))
    stats = F.col("stats")
    counted = statistics(texts.select("id", "quality", "text")).select("id", F.struct("quality", *[feature(stats, n).alias(n) for n in FEATURES]).alias("one"))
    rows = (  # one text an id, or an id that many rows share would outgrow the bound
        counted.groupBy("id").agg(F.min("one").alias("one")).select(F.xxhash64("id").alias("draw"), "one.*")
        .toPandas().sort_values(["draw", *FEATURES], kind="stable")
    )
    names = list(FEATURES)
    bad = (rows["quality"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return DecisionList()
    return grow_and_prune(rows[names].to_numpy(float), bad, names, **limits)


def judged(docs: DataFrame, rules: DecisionList, under: str = "stats") -> DataFrame:
    """``docs`` with a struct of statistics and the fields ``base_failed``, ``rule`` and ``kept``."""
    stats = F.col(under)
    out = statistics(docs, under)
    failed, rule = base_failed(stats), rules.rule(stats)
    return out.withColumn(under, stats.withField("base_failed", failed).withField("rule", rule).withField("kept", ~failed & (rule == 0)))
