"""Toxicity by a weighted lexicon learned from labels and matched with Aho-Corasick.

Texts are folded first: lower case, homoglyphs to Latin letters, digit and sign
substitutions to letters, separators between three single letters or more dropped. Lexicon
entries are stems at a word's start or whole words. The score is a logistic function of
the weight found, normalised by length; phrases seen around a term in clean texts are
exceptions whose matches count nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small_batches, text_or_empty, tidied
from quern.sources.stage import stage

#: Labelled rows that the lexicon is fitted on at most: those first by a hash of doc_id.
FIT_ROWS = 12_000
THRESHOLD = 0.7
#: Letters of a stem; documents an entry must occur in, at least; its share of toxic ones;
#: entries wanted in each toxic document; entries at most.
STEM, SUPPORT, PURITY, COVER, ENTRIES = (3, 12), 3, 0.9, 4, 2000

#: Look-alike letters in lower case, and digits and signs used as letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнαεορυχικντ", "aeopcyxijsdhkmtbhaeopuxikvt"))
SUBSTITUTES = dict(zip("013457@$!", "oieastasi"))
_FOLD = str.maketrans(HOMOGLYPHS)
_SUBST = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"(?<![^\W\d_])[013457@$!]*[^\W\d_][\w@$!]*")
_HAS = re.compile(r"[013457@$!]")
_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\w)[^\W\d_](?:[.\-_*·][^\W\d_]){2,}(?!\w)")
_SEPARATORS = str.maketrans("", "", ".-_*·")


def fold(text: str | None) -> str:
    """The text in lower case, disguised letters replaced.

    Digits and signs are taken as letters only in words that have letters, and not at a
    word's end, where they are numbers and punctuation. Single letters with one of
    ``.-_*·`` between each two are a word.
    """
    t = (text or "").lower()
    if not t.isascii():
        t = t.translate(_FOLD)
    if _HAS.search(t):
        t = _MIXED.sub(lambda m: _word(m[0]), t)
    return _SPACED.sub(lambda m: m[0].translate(_SEPARATORS), t)


def _word(w: str) -> str:
    body = w.rstrip("013457@$!")
    return body.translate(_SUBST) + w[len(body) :] if body else w


def stems(text: str) -> set[str]:
    """Stems ``x`` and whole words ``x$`` of a folded text."""
    out = set()
    for w in set(_WORD.findall(text)):
        out.add(w + "$")
        for n in range(STEM[0], min(len(w), STEM[1]) + 1):
            out.add(w[:n])
    return out


@dataclass
class Lexicon:
    """Weights by entry, exception phrases (the word before or after an entry's), and the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] = (-4.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for e, w in self.weights.items():
            k = e.rstrip("$")
            old = a.get(k, (len(k), 0.0, 0.0))
            a.add_word(k, (len(k), old[1], w) if e.endswith("$") else (len(k), w, old[2]))
        if self.weights:
            a.make_automaton()
        return a


def matches(text: str, automaton) -> dict[int, tuple[int, float]]:
    """Start of each matched word to its (end, weight): the heaviest entry that fits."""
    found: dict[int, tuple[int, float]] = {}
    n = len(text)
    for end, (k, stem, whole) in automaton.iter(text):
        at = end - k + 1
        if at and text[at - 1].isalpha():
            continue
        w = max(stem, whole) if whole and (end + 1 == n or not text[end + 1].isalpha()) else stem
        if w > found.get(at, (0, 0.0))[1]:
            found[at] = (end + 1, w)
    return found


def phrases(text: str, at: int, end: int) -> list[str]:
    """The entry's word with the word before it, and with the word after it."""
    while end < len(text) and text[end].isalpha():
        end += 1
    before, after = _WORD.findall(text[max(0, at - 40) : at]), _WORD.findall(text[end : end + 40])
    out = [f"{before[-1]} {text[at:end]}"] if before else []
    return [*out, f"{text[at:end]} {after[0]}"] if after else out


def measures(text: str, automaton, exceptions: frozenset[str]) -> tuple[float, float]:
    """log(1 + weight found), and the same of the weight per 100 words."""
    if not len(automaton):
        return 0.0, 0.0
    got = matches(text, automaton)
    total = sum(w for at, (end, w) in got.items() if not exceptions or not exceptions.intersection(phrases(text, at, end)))
    words = 1 + text.count(" ") + text.count("\n")
    return math.log1p(total), math.log1p(100 * total / (words + 20))


def score_of(x: tuple[float, float], curve: tuple[float, ...]) -> float:
    z = curve[0] + curve[1] * x[0] + curve[2] * x[1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_sample(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most ``bound`` labelled rows outside the held-out third, staged."""
    l = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    l = l.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = l.count()
    share = min(1.0, 1.1 * bound / max(1, n))
    ids = l.withColumn("h", F.xxhash64("doc_id", F.lit("fit"))).where(F.pmod("h", F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    ids = ids.orderBy("h", "doc_id").limit(bound).select("doc_id", "toxic")
    return stage(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic"))  # broadcast: at most ``bound`` ids


def _count(sample: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(entry, n): documents of the sample that have each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                s = stems(fold(t))
                c.update(s if wanted is None else s & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["entry", "n"])

    return sample.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Lexicon:
    """Learn entries, exceptions and curve from a bounded sample of labelled rows.

    Candidates are entries of toxic documents that are rarely in clean ones. They are
    chosen greedily, always the one that most documents still lack, until each toxic
    document has some, so a group of near copies, covered by common terms already, adds
    few words of its own. Without toxic or clean rows the lexicon is empty.
    """
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels, bound)
    toxic, clean = sample.where("toxic = 1").select("text").distinct(), sample.where("toxic = 0").select("text").distinct()
    toxic, clean = stage(toxic), stage(clean)
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return Lexicon()
    least = max(SUPPORT, n_toxic // 400)
    # an entry is in a document in its own right, so a bounded sample has a bounded number of frequent ones
    bad = {r[0]: r[1] for r in _count(toxic, None).where(F.col("n") >= least).collect()}
    good = {r[0]: r[1] for r in _count(clean, set(bad)).collect()}
    rate = lambda e: (bad[e] / n_toxic) / (bad[e] / n_toxic + good.get(e, 0) / n_clean)
    pure = {e for e in bad if bad[e] >= PURITY * (bad[e] + good.get(e, 0)) and rate(e) >= PURITY}

    def entries(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(stems(fold(t)) & pure) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["e"]
            )

    each = [r[0] for r in toxic.mapInArrow(entries, "e array<string>").collect()]
    holders: dict[str, set[int]] = {}
    for i, es in enumerate(each):
        for e in es:
            holders.setdefault(e, set()).add(i)
    need, chosen = [COVER] * len(each), []
    left = dict(holders)
    while left and len(chosen) < ENTRIES:
        e = max(left, key=lambda e: (len(left[e]), not e.endswith("$"), len(e), e))
        if len(left[e]) < max(2, n_toxic // 150):
            break
        chosen.append(e)
        done = set()
        for i in left.pop(e):
            need[i] -= 1
            if need[i] == 0:
                done.add(i)
        # a stem and the words that it opens are one piece of evidence
        root = e.rstrip("$")
        left = {x: s - done for x, s in left.items() if not x.startswith(root) and not root.startswith(x.rstrip("$"))}
    weights = {e: math.log((bad[e] + 0.5) / (n_toxic + 1)) - math.log((good.get(e, 0) + 0.5) / (n_clean + 1)) for e in chosen}
    lex = Lexicon({e: w for e, w in weights.items() if w > 0})

    def context(batches):
        a, c = lex.automaton(), Counter()
        for b in batches:
            for t in b.column(0).to_pylist() if len(a) else ():
                f = fold(t)
                c.update({p for at, (end, _) in matches(f, a).items() for p in phrases(f, at, end)})
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["p", "n"])

    tally = lambda d: {
        r[0]: r[1] for r in d.mapInArrow(context, "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).where("n >= 2").collect()
    }
    clean_p = tally(clean)
    toxic_p = tally(toxic) if clean_p else {}
    lex.exceptions = frozenset(p for p in clean_p if p not in toxic_p)

    def features(batches):
        a = lex.automaton()
        for b in batches:
            x = [measures(fold(t), a, lex.exceptions) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x]), pa.array([v[1] for v in x])], names=["a", "b"])

    x, y = [], []
    for d, label in ((toxic, 1.0), (clean, 0.0)):
        got = d.mapInArrow(features, "a double, b double").collect()  # two numbers for a row of the bounded sample
        x += [(1.0, r[0], r[1]) for r in got]
        y += [label] * len(got)
    lex.curve = logistic(np.array(x), np.array(y))
    return lex


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[float, ...]:
    """Coefficients of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
    return tuple(w.tolist())


def scored(docs: DataFrame, lex: Lexicon, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``; a null text scores as an empty one."""
    small_batches(docs.sparkSession)
    kind = docs.withColumn(name, F.lit(0.0)).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lex.automaton()
        for b in batches:
            s = [score_of(measures(fold(t), a, lex.exceptions), lex.curve) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=kind.names)

    return docs.mapInArrow(tidied(run), kind)


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row, repeated ones too.

    Labels come from rows of the other two thirds only (crc32 of doc_id as text, modulo 3);
    held_out is null for a null doc_id. Labels that are null or not 0 or 1 are left out; of
    several for one doc_id the higher counts. Without usable labels, nothing is toxic.
    """
    lex = fit(docs, labels, bound)
    out = scored(docs.select("doc_id", "text"), lex)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """The documents that are not predicted toxic, all columns."""
    return scored(docs, fit(docs, labels, bound), "__score").where(F.col("__score") < THRESHOLD).drop("__score")
