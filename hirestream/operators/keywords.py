"""Keyword mining over pools of postings.

Phrase scoring is TF-IDF (term count in the document times smoothed inverse
document frequency over the corpus given) instead of a hosted sentence
encoder; the tiering, canonical collapse and share arithmetic follow the
published rules exactly.
"""
from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import stopwords
from ..functions import text as tx
from ..functions.numeric import round_half_up
from ..plans.strategy import top_n_per_group
from ..session import spooled, spread
from . import dealt, frequent, scan
from .batches import lists, small_batches, string_lists

# --- fixed values ------------------------------------------------------------
TIER_THRESHOLDS = [("critical", 0.60), ("recommended", 0.30), ("nice_to_have", 0.10)]
TIER_ORDER = ["critical", "recommended", "nice_to_have"]
CATEGORY_ORDER = ["hard_skill", "tool", "certification", "domain_term", "soft_skill"]
TOKEN_RE = "[a-z0-9]{2,}"
# -----------------------------------------------------------------------------


def _trie_regex(words) -> str:
    """A regex alternation for a word list, factored by common prefixes (a trie), so
    the engine tries a few branches per position instead of every word."""
    trie: dict = {}
    for w in words:
        node = trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        end = "" in node
        kids = sorted(k for k in node if k != "")
        alts = [re.escape(k) + emit(node[k]) for k in kids]
        if not alts:
            return ""
        body = alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"
        if end:
            body = ("(?:" + body + ")" if len(alts) == 1 and len(body) > 1 else body) + "?"
        return body

    return emit(trie)


def stopword_pattern() -> str:
    """One regex matching any stop word as a whole token (a token is a maximal run of
    ``[a-z0-9]``), built as a prefix trie from the list."""
    return "(?<![a-z0-9])(?:" + _trie_regex(stopwords.load("english")) + ")(?![a-z0-9])"


def doc_tokens(docs: DataFrame, text_col: str = "text") -> Column:
    """K2 tokens: cleaned (R1), lower-cased runs of 2+ alphanumerics, stop words removed.

    Stop words are blanked out of the text with one regex before tokenising, so
    the expression has no lambda functions (plans containing it canonicalise
    equal, which lets Spark reuse its shuffle output)."""
    low = F.lower(tx.clean_posting_text(F.col(text_col)))
    return F.regexp_extract_all(F.regexp_replace(low, stopword_pattern(), " "), F.lit(TOKEN_RE), 0)


_URL = re.compile(rb"https?://\S+")
_TOKEN_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_STOP_PHRASES = frozenset(tx.STOP_PHRASES)
_STOP_WORDS = frozenset(stopwords.load("english"))


def text_tokens(text: bytes | None) -> list[str]:
    """K2 tokens of one text in UTF-8, as :func:`doc_tokens` has them: a table maps bytes to
    lower-case letters, digits and blanks, which costs a fraction of the patterns."""
    if not text:
        return []
    if b"http" in text:
        text = _URL.sub(b" ", text)
    if b"@" in text:  # of a run of other than blanks, all goes if there is an @ inside
        text = b" ".join([w for w in text.split() if b"@" not in w[1:-1]])
    return [w for w in text.translate(_TOKEN_BYTES).decode("ascii").split() if len(w) > 1 and w not in _STOP_WORDS]


def token_phrases(toks: list[str]) -> list[str]:
    """1-grams and 2-grams in the order of the text, with repeats (2-grams span removed words)."""
    return toks + [a + " " + b for a, b in zip(toks, toks[1:])]


def phrase_counts(docs: DataFrame, *, id_col: str = "doc_id", pool_col: str = "pool",
                  text_col: str = "text") -> DataFrame:
    """(pool, doc_id, n, phrase, tf): 1-grams and 2-grams (bigrams span removed stop
    words, as a count vectoriser does).

    Documents are dealt by id before they are cut up: what is shuffled is the texts, and a
    document's phrases, many times its size, are counted where they are made. Rows of one id
    and pool lie side by side and count as one document."""
    dealt = (docs.select(F.col(pool_col).alias("pool"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                 .repartition("doc_id").sortWithinPartitions("doc_id", "pool"))
    schema = StructType([dealt.schema["pool"], dealt.schema["doc_id"], StructField("n", IntegerType()), StructField("phrase", StringType()),
                         StructField("tf", LongType())])

    def rows(done: list, types: list[pa.DataType]) -> pa.RecordBatch:
        phrases = [p for _, own in done for p in own]
        of = pa.array([i for i, (_, own) in enumerate(done) for _ in own], pa.int64())
        keys = [pa.array([k[c] for k, _ in done], types[c]).take(of) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([*keys, pa.array([2 if " " in p else 1 for p in phrases], pa.int32()), pa.array(phrases, pa.string()),
                                           pa.array([n for _, own in done for n in own.values()], pa.int64())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts, done, types = None, Counter(), [], []
        for part in small_batches(batches):
            types = types or [c.type for c in part.columns[:2]]
            for *key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()):
                if key != last:
                    done.append((last, counts))
                    last, counts = key, Counter()
                counts.update(token_phrases(text_tokens(text)))
            done = [d for d in done if d[1]]
            if done:
                yield rows(done, types)
            done = []
        if counts:
            yield rows([(last, counts)], types)

    return dealt.mapInArrow(run, schema)


def phrase_sets(docs: DataFrame, *, id_col: str = "doc_id", pool_col: str = "pool", text_col: str = "text") -> DataFrame:
    """(pool, doc_id, phrases): the distinct 1-grams and 2-grams of each document in its row."""
    slim = spread(docs.select(F.col(pool_col).alias("pool"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            rows = [list(dict.fromkeys(token_phrases(text_tokens(t)))) for t in part.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), string_lists(rows)], names=["pool", "doc_id", "phrases"])

    return slim.mapInArrow(run, StructType([slim.schema["pool"], slim.schema["doc_id"], StructField("phrases", ArrayType(StringType()))]))


def docs_per_pool(docs: DataFrame, pool_col: str = "pool") -> DataFrame:
    """(pool, n_docs): every document of the pool, with or without phrases."""
    return docs.groupBy(F.col(pool_col).alias("pool")).agg(F.count(F.lit(1)).alias("n_docs"))


def phrase_scores(counts: DataFrame, pool_sizes: DataFrame) -> DataFrame:
    """K3: tf * (ln((1 + N) / (1 + df)) + 1) with N and df taken within the pool;
    rounded to 9 places for stable ties.

    The weight is computed on the document-frequency table, which is the only thing that
    meets the pool sizes. It grows with the vocabulary, so it is joined back with a
    sort-merge join, never broadcast; a phrase of many documents is a skewed key that
    AQE's skew join splits."""
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + 1.0
    weights = (counts.groupBy("pool", "phrase").agg(F.count(F.lit(1)).alias("df")).join(pool_sizes, "pool")
                     .select("pool", "phrase", idf.alias("idf")))
    return (counts.join(weights.hint("merge"), ["pool", "phrase"])
                  .withColumn("score", F.round(F.col("tf") * F.col("idf"), 9)).drop("idf"))


def kept_phrase(phrase: Column) -> Column:
    """2 to 50 characters and no stop phrase."""
    return F.length(phrase).between(2, 50) & ~phrase.isin(tx.STOP_PHRASES)


def kept_phrases(phrases: list[str]) -> list[bool] | None:
    """R17 of many phrases, inside a task; None if all are kept."""
    if not phrases or min(map(len, phrases)) >= 2 and max(map(len, phrases)) <= 50 and _STOP_PHRASES.isdisjoint(phrases):
        return None
    return [2 <= len(p) <= 50 and p not in _STOP_PHRASES for p in phrases]


def phrases(docs: DataFrame, *, id_col: str = "doc_id", pool_col: str = "pool", text_col: str = "text") -> DataFrame:
    """K2+R17+U5: every phrase of every document, distinct per document. Nothing is
    shuffled, and a document's rows lie side by side."""
    return held_phrases(phrase_sets(docs, id_col=id_col, pool_col=pool_col, text_col=text_col))


def held_phrases(sets: DataFrame) -> DataFrame:
    """(pool, doc_id, phrase) of ``sets`` (see :func:`phrase_sets`) after R17."""
    return sets.select("pool", "doc_id", F.explode("phrases").alias("phrase")).filter(kept_phrase(F.col("phrase")))


def top_phrases(docs: DataFrame, *, top_per_doc: int, id_col: str = "doc_id",
                pool_col: str = "pool", text_col: str = "text") -> DataFrame:
    """K2+K3+F2+R17+U5: the best ``top_per_doc`` phrases per document and n-gram length
    (ranked before R17 removes any); distinct per document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(pool_col).alias("pool"), F.col(text_col).alias("text"))

    def columns(own: StructType) -> StructType:
        return StructType([own["pool"], own["doc_id"], *StructType.fromDDL("n int, phrase string, tf long, score double, rank int").fields])

    schema = columns(StructType([slim.schema["doc_id"], slim.schema["pool"]]))

    def best(documents: list[tuple]) -> pa.Table:
        out = []
        for doc_id, same in groupby(documents, lambda d: d[0]):
            lists: dict[int, list] = {1: [], 2: []}
            for _, pool, phrases in same:
                for p, (tf, score) in phrases.items():
                    lists[2 if " " in p else 1].append((-score, p, pool, tf))
            for n, scored in lists.items():
                top = heapq.nsmallest(top_per_doc, scored, key=lambda r: r[:2])
                keep = kept_phrases([r[1] for r in top]) or [True] * len(top)
                out += [(pool, doc_id, n, p, tf, -s, i) for i, (s, p, pool, tf) in enumerate(top, 1) if keep[i - 1]]
        return dealt.rows(out, schema)

    return dealt.scored(slim, docs_per_pool(docs, pool_col), lambda t: token_phrases(text_tokens(t)), best, columns)


def document_frequency(phrases: DataFrame) -> DataFrame:
    """A3: number of documents per pool whose phrase set holds the phrase. ``phrases`` has a
    phrase once per document, or is the documents (``pool, text``): their phrases after R17
    are counted in tasks and by hash buckets, without a row per phrase and document."""
    if "text" in phrases.columns:
        return dealt.document_frequency(phrases, lambda t: token_phrases(text_tokens(t)), kept_phrases)
    return phrases.groupBy("pool", "phrase").agg(F.count(F.lit(1)).alias("n_docs"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """``phrase``: every phrase of ``docs`` (``text``) after R17, once."""
    return document_frequency(docs.select(F.lit("").alias("pool"), "text")).select("phrase")


def landed_classification(responses: DataFrame, raw_col: str = "raw", single: bool = True) -> DataFrame:
    """Landed model responses (a JSON list of ``keyword, category, canonical``
    objects, fenced or bare) as one row per keyword, lower-cased and trimmed. What does
    not parse gives no rows; of a keyword classified twice the smallest answer holds. Without
    ``single`` a keyword may have several rows, which :func:`market_keywords` of documents
    sorts out where it deals them."""
    item = "array<struct<keyword: string, category: string, canonical: string>>"
    # a response goes through a generator, or what makes it is computed again wherever it is named
    raw = responses.select(F.inline(F.array(F.struct(F.col(raw_col).cast("string").alias("raw")))))
    rows = raw.select(F.inline(F.from_json(tx.strip_code_fences(F.col("raw")), item)))
    clean = {c: F.nullif(F.lower(F.trim(F.col(c))), F.lit("")) for c in ("keyword", "category", "canonical")}
    rows = rows.select(*[v.alias(k) for k, v in clean.items()]).filter("keyword is not null")
    if not single:
        return rows
    # few keywords come twice, so rows are shuffled before they are sorted for the least answer, and not sorted twice
    return (rows.repartition("keyword").groupBy("keyword").agg(F.min(F.struct("category", "canonical")).alias("c"))
                .select("keyword", "c.category", "c.canonical"))


def classify(held: DataFrame, classification: DataFrame | None = None) -> DataFrame:
    """Category and canonical per (pool, doc_id, phrase); phrases that no answer
    names are ``hard_skill`` with the naive canonical form (R3). ``classification`` has
    one row per keyword (see :func:`landed_classification`)."""
    if classification is None:
        return held.select("*", F.lit("hard_skill").alias("category"), tx.naive_canonical(F.col("phrase")).alias("canonical"))
    c = classification.select(F.col("keyword").alias("phrase"), F.col("category").alias("_cat"), F.col("canonical").alias("_can"))
    return held.join(c, "phrase", "left").select(
        "pool", "doc_id", "phrase", F.coalesce(F.col("_cat"), F.lit("hard_skill")).alias("category"),
        F.coalesce(F.col("_can"), tx.naive_canonical(F.col("phrase"))).alias("canonical"))


def market_keywords(phrases: DataFrame, docs_per_pool: DataFrame,
                    classification: DataFrame | None = None) -> DataFrame:
    """A4+A5+F3: canonical keyword records per pool with share and tier.

    ``phrases`` is (pool, doc_id, phrase), or (pool, doc_id, phrases) with a document's set
    in its row (:func:`phrase_sets`), which saves a shuffle, or (pool, doc_id, text): documents,
    which are cut up where their phrases are counted or meet the classes. ``docs_per_pool`` is
    ``(pool, n_docs)`` counting every document of the pool, including those that yielded no
    phrase. Share counts a document when it holds any phrase whose canonical is the keyword
    (noise-labelled phrases included, T13) or the literal keyword itself; ties on display
    length go to the alphabetically first phrase; category comes from the alphabetically
    first synonym.

    A keyword needs the lowest tier's share of its pool, so the keys that can have it are
    found first (:mod:`frequent`): every held phrase stands for its canonical form and for
    itself, and summaries of these keys are kept per task. Only rows of the keys found are
    counted, exactly."""
    sets, share = "phrase" not in phrases.columns, TIER_THRESHOLDS[-1][1]
    texts = "text" in phrases.columns and classification is None
    wanted = None
    if texts:
        own = spread(phrases.select("pool", "text")).filter(F.col("pool").isNotNull())
        wanted = frequent.sent(spooled(frequent.common(own, docs_per_pool, share, words=text_tokens)))
        phrases = phrases if wanted is not None else phrase_sets(phrases)
    elif sets:
        own = phrases.filter(F.col("pool").isNotNull())
        if classification is not None:
            own = spooled(dealt.classified(own, classification, lambda t: token_phrases(text_tokens(t)), kept_phrases, brief=True), "zstd")
        wanted = frequent.sent(spooled(frequent.common(own, docs_per_pool, share)))
    if wanted is not None and texts:
        agg = frequent.text_records(own, wanted, kept_phrases, text_tokens)
    elif wanted is not None:
        agg = frequent.set_records(own, wanted, kept_phrases)
    else:
        if sets and classification is not None:
            each = F.inline(F.arrays_zip(F.col("phrases").alias("phrase"), F.col("categories").alias("category"), F.col("canonicals").alias("canonical")))
            cls = own.select("pool", "doc_id", each).withColumn("canonical", F.coalesce("canonical", "phrase"))
        else:
            held = (held_phrases(phrases) if sets else phrases.select("pool", "doc_id", "phrase")).filter(F.col("pool").isNotNull())
            cls = classify(held, classification)
            if classification is not None:
                cls = spooled(cls)  # joined with the answers once, read twice
        keyed = cls.select("pool", "doc_id", "phrase", "category", "canonical",
                           F.explode(F.array_distinct(F.array("canonical", "phrase"))).alias("key"))
        adjacent = sets and classification is None
        found = spooled(frequent.candidates(keyed, docs_per_pool, share, adjacent))
        live = F.col("canonical") == F.col("key")
        rows = keyed.select("pool", "doc_id", "key", (live & (F.col("category") != "noise")).alias("own"), "phrase", "category")
        agg = frequent.records(frequent.only(rows, found), adjacent)
    r = agg.filter("first is not null").join(docs_per_pool.withColumnRenamed("n_docs", "_all"), "pool")
    freq = F.col("n_docs") / F.col("_all")
    tier = F.lit(None).cast("string")
    for name, least in reversed(TIER_THRESHOLDS):
        tier = F.when(freq >= least, F.lit(name)).otherwise(tier)
    return (r.filter(tier.isNotNull())
            .select("pool", F.col("key").alias("keyword"), F.col("longest.d").alias("display"),
                    F.col("first.category").alias("category"), round_half_up(freq, 3).alias("frequency"),
                    F.col("n_docs").cast("long").alias("raw_count"), tier.alias("tier")))


def report_order() -> list[Column]:
    """tier, category preference, share descending, then keyword."""
    t = F.array_position(F.array(*[F.lit(x) for x in TIER_ORDER]), F.col("tier"))
    c = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in CATEGORY_ORDER]), F.col("category")),
                            F.lit(0)), F.lit(99))
    return [t, c, F.col("frequency").desc(), F.col("keyword")]


def tier_lists(keywords: DataFrame, max_critical: int | None = None, max_recommended: int | None = None) -> DataFrame:
    """(pool, critical, recommended): keyword displays in report order, joined by
    commas; all of them unless the caller sets a limit."""
    def listed(tier: str, n: int | None) -> Column:
        order = report_order()
        entry = F.struct(order[1].alias("c"), (-F.col("frequency")).alias("f"), F.col("keyword").alias("k"), F.col("display").alias("d"))
        arr = F.array_sort(F.collect_list(F.when(F.col("tier") == tier, entry)))
        return F.array_join(F.transform(arr if n is None else F.slice(arr, 1, n), lambda x: x.getField("d")), ", ")
    return keywords.groupBy("pool").agg(listed("critical", max_critical).alias("critical"),
                                        listed("recommended", max_recommended).alias("recommended"))


def keyword_array(keywords: DataFrame) -> DataFrame:
    """(pool, kws): the bounded keyword list of each pool as one sorted array.

    Each keyword needs a 10% share of the pool's documents, so the array has at most ten
    times the phrases of one document. Its join is left to Spark, which broadcasts only
    what it has measured to be small."""
    tier_rank = F.array_position(F.array(*[F.lit(x) for x in TIER_ORDER]), F.col("tier"))
    return keywords.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct(
        tier_rank.alias("tier_rank"), F.col("keyword"), F.col("display"), F.col("tier")))).alias("kws"))


def gap_analysis(candidate_tokens: DataFrame, keywords: DataFrame, max_chars: int = scan.MAX_TERM_CHARS) -> DataFrame:
    """Per candidate, each keyword is ``already_have`` when the keyword or its
    display form is inside any résumé token, else ``must_add`` (critical) or
    ``should_emphasize``. ``candidate_tokens`` = (pool, candidate_id, tokens).

    All tokens are one text, which is scanned once for all keywords of its pool, sent to the
    tasks; keywords of more than ``max_chars`` characters are joined to the row and searched
    for one by one."""
    table = spooled(keyword_array(keywords))
    terms = F.flatten(F.transform("kws", lambda k: F.array(k.getField("keyword"), F.lower(k.getField("display")))))
    chars = table.agg(F.sum(F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: a + F.length(F.coalesce(t, F.lit("")))))).first()[0]
    # a term is searched for once instead of in every token, and cannot run over the separator
    sep = "\x00"
    said = F.when(F.size("tokens") > 0, F.concat(F.lit(sep), F.array_join("tokens", sep))).alias("_said")
    if (chars or 0) > max_chars:
        return _gap_by_row(candidate_tokens, table, said, sep)
    own = table.select("pool", F.col("kws.keyword").alias("k"), terms.alias("t"), F.col("kws.tier").alias("tier"))
    sent = table.sparkSession.sparkContext.broadcast({r["pool"]: (r["k"], r["t"], r["tier"]) for r in own.collect()})
    slim = candidate_tokens.select("pool", "candidate_id", said)
    schema = StructType([slim.schema["pool"], slim.schema["candidate_id"], StructField("gap", ArrayType(StructType.fromDDL("keyword string, bucket string")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[object, _Gap] = {}
        for part in small_batches(batches):
            pools, texts = part.column(0).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()
            for p in set(pools):
                if p not in found:
                    found[p] = _Gap(*(sent.value.get(p, ([], [], [])) if p is not None else ([], [], [])), sep)
            names, base = [], {}
            for p in dict.fromkeys(pools):
                base[p] = sum(map(len, names))
                names.append(found[p].names)
            at = [np.arange(found[p].n) + base[p] for p in pools]
            buckets = [found[p].buckets(t) for p, t in zip(pools, texts)]
            rows = pa.StructArray.from_arrays([pa.concat_arrays(names).take(pa.array(np.concatenate(at))), _BUCKETS.take(pa.array(np.concatenate(buckets)))],
                                              names=["keyword", "bucket"])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(at, rows)], names=schema.names)

    return slim.mapInArrow(run, schema)


_BUCKETS = pa.array(["already_have", "must_add", "should_emphasize"], pa.string())


class _Gap(scan.Terms):
    """The keywords of a pool in a task, and which bucket each has if no token holds it."""

    def __init__(self, names: Sequence[str | None], terms: Sequence[str | None], tiers: Sequence[str | None], sep: str):
        forms = list(zip(terms[::2], terms[1::2]))
        super().__init__([[t for t in own if t and sep not in t] for own in forms])
        self.names, self.blank = pa.array(names, pa.string()), np.array(["" in own for own in forms], bool)  # a blank one is in any token
        self.missed = np.array([1 if t == "critical" else 2 for t in tiers], np.int64)

    def buckets(self, said: bytes | None) -> np.ndarray:
        if said is None:
            return self.missed
        return np.where(self.bits(said.decode("utf-8", "surrogateescape")) | self.blank, 0, self.missed)


def _gap_by_row(candidate_tokens: DataFrame, table: DataFrame, said: Column, sep: str) -> DataFrame:
    j = candidate_tokens.join(table, "pool", "left").withColumn("kws", F.coalesce(
        F.col("kws"), F.array().cast("array<struct<tier_rank:int,keyword:string,display:string,tier:string>>")))
    # made once per row (by a generator)
    j = j.select("pool", "candidate_id", "kws", F.inline(F.array(F.struct(said))))

    def inside(term: Column) -> Column:
        return F.contains(F.col("_said"), term) & ~F.contains(term, F.lit(sep))

    def present(k: Column) -> Column:
        return inside(k.getField("keyword")) | inside(F.lower(k.getField("display")))

    marked = F.transform(F.col("kws"), lambda k: F.struct(
        k.getField("keyword").alias("keyword"),
        F.when(present(k), "already_have").when(k.getField("tier") == "critical", "must_add")
        .otherwise("should_emphasize").alias("bucket")))
    return j.select("pool", "candidate_id", marked.alias("gap"))
