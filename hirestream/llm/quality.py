"""Quality rules as a short-circuit cascade.

A document is rejected by the first rule that it breaks; later rules are not looked at
and what only they need is never computed. On a bounded, documented sample
(about ``SAMPLE_DOCS`` documents, chosen by id hash) every rule is run on
every document: its time is its cost and the set of rules each document breaks gives
selectivities *given* the rules before it. The order is then greedy: next comes the
rule with the most rejections per second among what is left. The verdict does not
depend on the order, only the work does; every document is judged, on its whole text.

Defined results: null or empty text has no words and is rejected; repeated rows are
judged alike; an empty table gives an empty result; other columns are ignored by
``quality`` and kept by ``keep_good``; a very long text is one task's row.
"""
from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trimmed

SAMPLE_DOCS = 2000
SYMBOLS = "#*$%&|<>"


class Features:
    """What rules look at; each value is computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        # code points that are not white space of the word rule
        t = self.text
        return len(t) - sum(t.count(c) for c in " \t\n\x0b\x0c\r")

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def n_lines(self) -> int:
        return sum(1 for x in self.text.split("\n") if x.strip(" \t\n\x0b\x0c\r"))

    @cached_property
    def n_dup_lines(self) -> int:
        """Lines with a word that equal an earlier line."""
        return sum(n - 1 for x, n in Counter(self.text.split("\n")).items() if n > 1 and x.strip(" \t\n\x0b\x0c\r"))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by three-word windows that occur twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in self.words), np.int64, n)
        # Two words, then three, become one number each; both steps are one to one.
        _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        _, at, times = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        hit = times[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k:n - 2 + k] |= hit
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """``breaks`` says that a document is to be rejected."""
    name: str
    breaks: Callable[[Features], bool]


#: Base rules: too short, or mostly repeated three-word windows.
BASE_RULES = (Rule("few_words", lambda d: d.n_words < 50),
              Rule("repeats", lambda d: 100 * d.n_repeat_words > 50 * d.n_words))
#: Further rules: symbols for every tenth word, a third of the lines seen before, words
#: that are on average shorter than two or longer than twenty characters.
MORE_RULES = (Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
              Rule("dup_lines", lambda d: 3 * d.n_dup_lines > d.n_lines),
              Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 20 * d.n_words))
RULES = BASE_RULES + MORE_RULES


def _measure(rules: Sequence[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, broken = [0.0] * len(rules), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                mask = 0
                for i, rule in enumerate(rules):
                    doc = Features(text)  # a rule's cost is what it takes on its own
                    start = time.perf_counter()
                    hit = rule.breaks(doc)
                    seconds[i] += time.perf_counter() - start
                    mask |= hit << i
                broken[mask] += 1
        if broken:
            yield pa.RecordBatch.from_pydict({"mask": list(broken), "n": list(broken.values()),
                                              "seconds": [seconds] + [[0.0] * len(rules)] * (len(broken) - 1)},
                                             schema=pa.schema([("mask", pa.int64()), ("n", pa.int64()),
                                                               ("seconds", pa.list_(pa.float64()))]))
    return run


def greedy_order(broken: dict[int, int], cost: Sequence[float]) -> list[int]:
    """Rule numbers by rejections per cost, each among what the ones before leave.
    ``broken``: documents by the set (bits) of rules they break."""
    left, order = dict(broken), []
    while len(order) < len(cost):
        rest = [i for i in range(len(cost)) if i not in order]
        rejects = {i: sum(n for m, n in left.items() if m >> i & 1) for i in rest}
        best = max(rest, key=lambda i: (rejects[i] / max(cost[i], 1e-9), -cost[i], -i))
        order.append(best)
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return order


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text",
                 sample_docs: int = SAMPLE_DOCS) -> list[Rule]:
    """The rules in the order in which the cascade asks them. At most 2^rules counters per
    task reach the driver."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = docs.filter(chosen).select(F.col(text_col).cast("string")).limit(2 * sample_docs)  # the limit is for repeated ids
    rows = sample.mapInArrow(_measure(rules), "mask long, n long, seconds array<double>").collect()
    broken, cost = Counter(), [0.0] * len(rules)
    for r in rows:
        broken[r["mask"]] += r["n"]
        cost = [a + b for a, b in zip(cost, r["seconds"])]
    return [rules[i] for i in greedy_order(broken, cost)]


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(order: Sequence[Rule], base: Sequence[Rule], stats: bool):
    names = {r.name for r in base}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {"rejected_by": [], "base_failed": []} | ({s: [] for s in _STATS} if stats else {})
            for text in batch.column(batch.num_columns - 1).to_pylist():
                doc = Features(text)
                by = next((r.name for r in order if r.breaks(doc)), None)
                cols["rejected_by"].append(by)
                if stats:
                    cols["base_failed"].append(by in names or any(r.breaks(doc) for r in base))
                    for s in _STATS:
                        cols[s].append(getattr(doc, s))
                else:
                    cols["base_failed"].append(None)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            types = {"rejected_by": pa.string(), "base_failed": pa.bool_()}
            more = [pa.array(v, types.get(k, pa.int64())) for k, v in cols.items()]
            yield pa.RecordBatch.from_arrays(kept + more, names=batch.schema.names[:-1] + list(cols))
    return run


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES, id_col: str = "doc_id",
            text_col: str = "text", stats: bool = False, order: Sequence[Rule] | None = None,
            sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, rejected_by, kept`` per row. With ``stats`` all features are completed
    after the verdict and returned with ``base_failed``."""
    small_batches(docs.sparkSession)
    order = list(order or plan_cascade(docs, rules, id_col, text_col, sample_docs))
    fields = "doc_id long, rejected_by string, base_failed boolean" + "".join(f", {s} long" for s in _STATS if stats)
    out = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
               .mapInArrow(trimmed(_judge(order, base, stats)), fields))
    out = out.withColumn("kept", F.col("rejected_by").isNull())
    return out if stats else out.drop("base_failed")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    order, at = plan_cascade(docs, rules, id_col, text_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [not any(r.breaks(doc) for r in order) for doc in map(Features, batch.column(at).to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
