"""Quality rules as a learned decision list.

Text statistics are built-in column expressions over whole texts. From the statistics of a bounded sample of
labelled documents (`sample`, chosen by a hash of the id), sequential covering grows conjunctions of thresholds that pick
out low quality, prunes each on held-back rows, and keeps it if it is precise there; a rule that is not makes way for the best one that
begins with another feature, until none is left. The ordered rules become one Spark conditional expression; the first
rule that fits a document drops it.

Edge cases: null, empty and blank texts have no words, so all statistics are 0 and the base rule fails them; without
labelled rows of both classes no rule is learned and only the base rule holds; repeated rows, and rows without an id, are judged
each; of several labels of an id the lower counts; of tests of equal gain the first by feature and threshold is taken, and
a value that equals a threshold is on its lower side; texts of any length are read whole, in time
proportional to n log n of their words; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, words

SYMBOLS = "#*$%&|<>"
RUN = 8
#: What rules look at: ratios of the statistics, each of which is defined for every text.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines (those with a word), n_dup_lines and n_repeat_words of docs (doc_id, text)."""
    size = lambda c: F.size(c).cast("long")
    text = F.coalesce("text", F.lit(""))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    base = docs.select("doc_id", text.alias("text"))
    base = base.select(
        "doc_id",
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), has_word).alias("lines"),
        words(F.col("text")).alias("words"),
    )
    step = base.select(
        "doc_id", "n_symbols",
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        size("lines").alias("n_lines"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        size("words").alias("n_words"),
        F.when(F.size("words") >= RUN, F.transform("words", lambda w: F.xxhash64(w))).alias("h"),
    )
    # Hashes of runs of 2, then 4, then 8 words, each from two runs of half the length.
    k = 1
    while k < RUN:
        n = F.size("h") - k
        step = step.withColumn("h", F.zip_with(F.slice("h", F.lit(1), n), F.slice("h", F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b)))
        k *= 2
    # Sorted only where some run occurs twice.
    twice = F.size(F.array_distinct("h")) < F.size("h")
    step = step.withColumn("s", F.when(twice, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("h")
    again = lambda j: (F.get("s", j - 1).x == F.get("s", j).x) | (F.get("s", j + 1).x == F.get("s", j).x)
    places = F.transform(F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda j: F.coalesce(again(j), F.lit(False))), lambda j: F.get("s", j).i)
    step = step.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(places))).drop("s")
    # Words under sorted runs: the distance to the next run counts, up to the run's length.
    steps = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.least(b - a, F.lit(RUN)))
    repeat = F.when(F.col("p").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(RUN), lambda a, x: a + x))
    # One generated row each: filters on the statistics must not be pushed down into copies of all of the above.
    stats = F.struct("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeat.cast("long").alias("n_repeat_words"))
    return step.select("doc_id", F.inline(F.array(stats)))


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


@dataclass
class Rule:
    """A conjunction of (feature, `<=` or `>`, threshold), with what it covered of the held-back rows when it was kept."""

    tests: list[tuple[str, str, float]] = field(default_factory=list)
    good: int = 0
    bad: int = 0

    def fits(self, row: dict) -> bool:
        return all((row[f] <= t) if op == "<=" else (row[f] > t) for f, op, t in self.tests)

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.tests:
            value = F.expr(FEATURES[f])
            out = out & ((value <= t) if op == "<=" else (value > t))
        return out


def _thresholds(rows: list[dict], feature: str, most: int) -> list[float]:
    values = sorted({r[feature] for r in rows})
    if len(values) < 2:
        return []
    step = max(1, (len(values) - 1) / most)
    cuts = {int(i * step) for i in range(min(most, len(values) - 1))}
    return [(values[i] + values[i + 1]) / 2 for i in sorted(cuts)]


def _grow(rows: list[dict], max_tests: int, cuts: int, not_first: set[str]) -> Rule:
    """Add the test of the highest information gain until only low quality is covered; the first one is of no feature in `not_first`."""
    rule, covered = Rule(), rows
    while len(rule.tests) < max_tests and any(r["y"] for r in covered):
        p0 = sum(not r["y"] for r in covered)
        if not p0:
            break
        best, gain = None, 0.0
        for f in FEATURES:
            if not rule.tests and f in not_first:
                continue
            ordered = sorted(covered, key=lambda r: r[f])
            bad = [0]
            for r in ordered:
                bad.append(bad[-1] + (not r["y"]))
            at = 0
            for t in _thresholds(covered, f, cuts):
                while at < len(ordered) and ordered[at][f] <= t:
                    at += 1
                for op, p, n in (("<=", bad[at], at), (">", p0 - bad[at], len(ordered) - at)):
                    if p and (g := p * (math.log2(p / n) - math.log2(p0 / len(covered)))) > gain + 1e-9:
                        best, gain = (f, op, t), g
        if best is None:
            break
        rule.tests.append(best)
        covered = [r for r in covered if rule.fits(r)]
    return rule


def _prune(rule: Rule, held: list[dict]) -> Rule:
    """Of the rule's beginnings the one that does best on held-back rows."""

    def worth(tests):
        hit = [r for r in held if Rule(tests).fits(r)]
        bad = sum(not r["y"] for r in hit)
        return (bad - (len(hit) - bad)) / len(hit) if hit else -1.0, bad, len(hit) - bad

    best = max(range(1, len(rule.tests) + 1), key=lambda k: (worth(rule.tests[:k])[0], worth(rule.tests[:k])[1], -k))
    _, bad, good = worth(rule.tests[:best])
    return Rule(rule.tests[:best], good, bad)


def learn_rules(rows: list[dict], max_rules: int = 12, max_tests: int = 4, cuts: int = 40, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Sequential covering of low quality (y = 0). Every third row is held back for pruning; a rule must be `precise` there and cover `least` rows of it."""
    grow, held = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    found: list[Rule] = []
    failed: set[str] = set()
    while len(found) < max_rules and any(not r["y"] for r in grow):
        grown = _grow(grow, max_tests, cuts, failed)
        if not grown.tests:
            break
        rule = _prune(grown, held)
        if rule.bad < least or rule.bad < precision * (rule.bad + rule.good):
            failed.add(grown.tests[0][0])
            continue
        found.append(rule)
        failed.clear()
        grow, held = [r for r in grow if not rule.fits(r)], [r for r in held if not rule.fits(r)]
    return found


def decision_list(rules: list[Rule]) -> Column:
    """True unless a rule drops the document; rules are tried in order."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_statistics(docs: DataFrame, labels: DataFrame, sample: int) -> list[dict]:
    """Features and label y of at most `sample` labelled documents that pass the base rule, in order of a hash of the id."""
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    stats = text_statistics(docs.join(F.broadcast(chosen), "doc_id", "left_semi")).filter(~base_failed())
    rows = stats.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "n_words", "word_chars")
    return [r.asDict() for r in rows.select("y", *(F.expr(e).alias(f) for f, e in FEATURES.items())).limit(2 * sample).collect()]


def judge_quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics, base_failed and kept of each row of docs (doc_id, text)."""
    return text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & decision_list(rules))


def op4_quality_rules(spark: SparkSession, sf_dir: str, sample: int = 10_000) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_rules(labelled_statistics(docs, read(spark, sf_dir, "labels"), sample))
    out = judge_quality(docs, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_BLANK = re.compile(r"[\x20\x09-\x0D]+")


def brute_force(text: str | None) -> tuple[int, int, int, int, int]:
    """The statistics of one text in plain Python, for tests: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = [x for x in _BLANK.split(text) if x]
    lines = [x for x in text.split("\n") if _BLANK.sub("", x)]
    runs: dict[tuple, list[int]] = {}
    for i in range(len(w) - RUN + 1):
        runs.setdefault(tuple(w[i : i + RUN]), []).append(i)
    covered = {j for places in runs.values() if len(places) > 1 for i in places for j in range(i, i + RUN)}
    return len(w), sum(map(len, w)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)
