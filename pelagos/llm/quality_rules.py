"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditional expressions.

Sequential covering in the manner of Cohen's RIPPER ("Fast Effective Rule Induction", 1995): a conjunction of thresholds
is grown on part of the labelled rows by FOIL's gain, pruned on the rest, and added to the list; rows it covers go, and the
next is grown. What no rule covers gets the default verdict.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pelagos.llm.common import own_columns, text_bytes, unused

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Most labelled rows that rules are learned from: those with the least hash of their id.
SAMPLE_ROWS = 10_000


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """STATS of UTF-8 bytes. Words are runs of anything but ASCII white space."""
    words = text.split()
    if not words:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0
    seen: set[bytes] = set()
    lines = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                lines += 1
            elif line.strip():
                seen.add(line)
    return len(words), len(b"".join(words).decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), lines, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words in windows of three that the text has more than once."""
    n = len(words) - 2
    if n < 2:
        return 0
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n + 2)
    pairs = ids[:-1] * len(code) + ids[1:]
    if len(code) > 1 << 20:  # keep the products below 2**63
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(code) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= twice
    return int(covered.sum())


def with_stats(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if None) and STATS, each named with ``prefix``. A null text is empty.

    Only the texts go to Python, each once and pickled, a hundred at a time (``spark.sql.execution.python.udf.maxRecordsPerBatch``):
    an Arrow batch is ten thousand of them, outside the heap, and more than once while its buffers grow.
    """
    told = unused("_stats", docs)
    # not taken for deterministic, so that it runs once for all that reads its fields
    stats = F.udf(lambda text: text_stats(bytes(text)), StructType([StructField(s, LongType()) for s in STATS]), useArrow=False).asNondeterministic()
    rows = docs.select(*(own_columns(docs) if keep is None else keep), stats(text_bytes(text_col)).alias(told))
    return rows.select(*own_columns(rows)[:-1], *(F.col(told)[s].alias(prefix + s) for s in STATS))


#: What rules are about, from STATS; each divisor is at least 1.
FEATURES = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_char": ("n_symbols", "word_chars"),
    "duplicate_lines_per_word": ("n_dup_lines", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
}


def feature(name: str, prefix: str = "") -> Column:
    over, under = FEATURES[name]
    column = F.col(prefix + over).cast("double")
    return column if under is None else column / F.greatest(F.col(prefix + under), F.lit(1))


def _features(stats: np.ndarray) -> np.ndarray:
    by = {n: stats[:, i].astype(float) for i, n in enumerate(STATS)}
    return np.stack([by[o] if u is None else by[o] / np.maximum(by[u], 1) for o, u in FEATURES.values()], axis=1)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # at least the threshold, or below it
    threshold: float

    def column(self, prefix: str = "") -> Column:
        value = feature(self.feature, prefix)
        return value >= self.threshold if self.above else value < self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, list(FEATURES).index(self.feature)]
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass
class RuleList:
    """Rules in order, each a conjunction that rejects; ``default``: whether a row that none covers is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)
    default: bool = True

    def kept(self, prefix: str = "") -> Column:
        """The verdict on a row with STATS, as one ordered conditional expression."""
        out: Column | None = None
        for rule in self.rules:
            met = rule[0].column(prefix)
            for c in rule[1:]:
                met &= c.column(prefix)
            out = F.when(met, F.lit(not self.default)) if out is None else out.when(met, F.lit(not self.default))
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))

    def __str__(self) -> str:
        lines = [f"{' and '.join(map(str, r))} -> {'drop' if self.default else 'keep'}" for r in self.rules]
        return "\n".join([*lines, f"else -> {'keep' if self.default else 'drop'}"])


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best(x: np.ndarray, y: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the most FOIL gain over rows ``x``, of which ``y`` are to be covered."""
    p0, n0 = y.sum(), (~y).sum()
    if not p0 or not n0:
        return 0.0, None
    base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
    for j, name in enumerate(FEATURES):
        order = np.argsort(x[:, j], kind="stable")
        value, hit = x[order, j], y[order]
        cut = np.nonzero(np.diff(value))[0]  # between different values only
        if not len(cut):
            continue
        below = np.cumsum(hit)[cut]
        rows = cut + 1
        for above, p, n in ((False, below, rows - below), (True, p0 - below, n0 - (rows - below))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                middle = (value[cut[i]] + value[cut[i] + 1]) / 2
                best = float(gain[i]), Condition(name, above, float(middle))
    return best


def learn(stats: np.ndarray, good: np.ndarray, part: np.ndarray, precision: float = 0.7, least: int = 5, most_rules: int = 16) -> RuleList:
    """A list that rejects what isn't ``good``. ``stats``: rows of STATS; ``part``: those that rules are grown on, the others prune.

    A rule is taken if, on the rows kept for pruning, at least ``precision`` of what it covers is to be rejected, and if it
    covers at least ``least`` such rows in all. Without both kinds of rows there are no rules and everything is kept. The order
    of the rows doesn't matter: thresholds lie between different values, and the first of equal gains is taken by feature.
    """
    x, y = _features(np.asarray(stats, np.int64).reshape(-1, len(STATS))), ~np.asarray(good, bool)
    part = np.asarray(part, bool)
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(y), bool)
    while len(rules) < most_rules and (y & left).sum() >= least:
        rule: list[Condition] = []
        rows = left & part
        while (y & rows).any() and (~y & rows).any():
            _, condition = _best(x[rows], y[rows])
            if condition is None:
                break
            rule.append(condition)
            rows = rows & condition.holds(x)
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            covered = _covers(rule[:k], x) & left & ~part
            p, n = (y & covered).sum(), (~y & covered).sum()
            worth.append((p - n) / (p + n) if p + n else -1.0)
        rule = rule[: int(np.argmax(worth)) + 1]
        covered = _covers(rule, x) & left
        test = covered & ~part
        if (y & covered).sum() < least or not test.any() or (y & test).sum() < precision * test.sum():
            break
        rules.append(tuple(rule))
        left &= ~covered
    return RuleList(rules)


def base_failed(prefix: str = "") -> Column:
    """Fewer than 50 words, or over half of the words in repeated windows."""
    words = F.col(prefix + "n_words")
    return (words < 50) | (F.col(prefix + "n_repeat_words") * 100 > words * 50)


def learned_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleList:
    """Rules from at most ``sample_rows`` labelled documents that don't fail the base rules; the same for any order of the rows.

    Rows without a label or an id don't count. An id that is labelled more than once is good if all its labels are; of
    documents that repeat an id, that with the least statistics is learned from. Two thirds of the ids, by a hash, grow rules
    and the others prune.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col) != 0).alias("_good"))
    sample = F.broadcast(named.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))  # bounded by sample_rows
    rows = with_stats(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(sample, "_id"), "_t", ["_id", "_good"])
    once = rows.where(~base_failed()).groupBy("_id", "_good").agg(F.min(F.struct(*STATS)).alias("s"))
    grows = F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(3)) != 0
    found = once.select("s.*", "_good", grows.alias("grows")).toArrow()  # one row for each id: sample_rows at most
    return learn(np.stack([found.column(s).to_numpy() for s in STATS], axis=1), found.column("_good").to_numpy(), found.column("grows").to_numpy())


def judged(docs: DataFrame, rules: RuleList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *STATS, base_failed, kept) for every row of ``docs``. Null texts are empty and fail the base rules; an empty table gives an empty one."""
    rows = with_stats(docs, text_col, [id_col])
    return rows.select(id_col, *STATS, base_failed().alias("base_failed"), (~base_failed() & rules.kept()).alias("kept"))


def drop_rejected(docs: DataFrame, rules: RuleList, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the learned ones, with all their columns, whatever their names.

    A null text is empty and fails the base rules; repeated rows stay or go together; an empty table gives an empty one.
    """
    prefix = "_quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    rows = with_stats(docs, text_col, prefix=prefix)
    return rows.where(~base_failed(prefix) & rules.kept(prefix)).drop(*[prefix + s for s in STATS])
