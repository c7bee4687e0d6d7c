"""License scan: fuzzy search for short notices.

A notice of length n may be off by a tenth of its letters, k edits. It is split into k+1
pieces: a text within k edits has one of them unchanged, so an Aho-Corasick automaton of
all pieces finds every candidate. The regex library's bounded-error matching then checks
the window around it and gives the span and its edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, small_batches, tidied

#: Phrases whose exact places count, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Words of common public notices, and labels.
NOTICES = {
    "licensed under the apache license version 2": "apache-2",
    "apache license version 2": "apache-2",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
EDITS = 0.1
#: Words that tell notices apart, which no edit may touch.
KEYS = frozenset("mit cc by nc sa nd 2 3".split())

#: Bytes outside words become spaces: ASCII other than digits and letters.
_SPACES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes | None) -> bytes:
    """The text's words (A-Z in lower case), single-spaced."""
    return b" ".join((text or b"").lower().translate(_SPACES).split())


def split_seeds(notice: str, pieces: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``pieces`` nearly equal parts."""
    cuts = [round(i * len(notice) / pieces) for i in range(pieces + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def _matcher(notices: tuple[tuple[str, str], ...], edits: float):
    import ahocorasick
    import regex

    a, compiled = ahocorasick.Automaton(), []
    for i, (n, label) in enumerate(notices):
        k = int(edits * len(n))
        # whole words: an edit at the rim is spent on the notice, and what follows it is no part of a word
        compiled.append(
            (n, label, k, regex.compile(rf"(?e)(?<![^ ])(?=[^ ])(?:{regex.escape(n)}){{e<={k}}}(?<=[^ ])(?![^ ])"), KEYS.intersection(n.split()))
        )
        for off, seed in split_seeds(n, k + 1):
            a.add_word(seed, (*a.get(seed, ()), (i, off, len(seed))))
    a.make_automaton()
    return a, compiled


def fuzzy_spans(words: str, notices: dict[str, str] | None = None, edits: float = EDITS) -> list[tuple[int, int, str, int, int]]:
    """(start, end, label, edits, notice length) of all notices in single-spaced words.

    Of overlapping matches of one notice the first with fewest edits is given; matches start
    and end at word boundaries and have the notice's KEYS.
    """
    a, compiled = _matcher(tuple((NOTICES if notices is None else notices).items()), edits)
    windows: dict[int, list[list[int]]] = {}
    for end, hits in a.iter(words):
        for i, off, size in hits:
            n, _, k, *_ = compiled[i]
            lo = max(0, end - size + 1 - off - k - 1)
            hi = lo + len(n) + 2 * k + 3
            lo, hi = words.rfind(" ", 0, lo) + 1, words.find(" ", hi)
            hi = len(words) if hi < 0 else hi
            own = windows.setdefault(i, [])
            if own and lo <= own[-1][1]:
                own[-1][1] = max(own[-1][1], hi)
            else:
                own.append([lo, hi])
    out = set()
    for i, spans in windows.items():
        _, label, _, pattern, keys = compiled[i]
        size = len(compiled[i][0])
        for lo, hi in spans:
            for m in pattern.finditer(words[lo:hi]):
                if keys <= set(m[0].split()):
                    out.add((lo + m.start(), lo + m.end(), label, sum(m.fuzzy_counts), size))
    return sorted(out)


def scan(text: bytes | None) -> dict:
    """Counts, places and labels of one text."""
    joined = words_of(text)
    n_words = joined.count(b" ") + 1 if joined else 0
    padded = b" " + joined + b" "
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        p = b" " + phrase.encode() + b" "
        at, last, before = padded.find(p), 0, 0
        while at >= 0:
            before, last = before + padded.count(b" ", last, at), at
            starts.append(before)
            base.add(label)
            at = padded.find(p, at + 1)
    spans = fuzzy_spans(joined.decode("utf-8", "replace"))
    score = max([float(bool(base)), *(1 - e / n for *_, e, n in spans)])
    return {"n_words": n_words, "starts": starts, "base": base, "spans": spans, "score": score}


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    One row per input row; a null text counts as empty, and a text without words has no
    labels (empty strings), null places and score 0. Spans are "from-to label edits" with
    offsets in the text's single-spaced words.
    """
    small_batches(docs.sparkSession)
    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(t) for t in as_bytes(b.column(1))]
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([g["n_words"] for g in got], long),
                    pa.array([len(g["starts"]) for g in got], long),
                    pa.array([min(g["starts"], default=None) for g in got], long),
                    pa.array([max(g["starts"], default=None) for g in got], long),
                    pa.array([",".join(sorted(g["base"])) for g in got], pa.string()),
                    pa.array([",".join(sorted(g["base"] | {s[2] for s in g["spans"]})) for g in got], pa.string()),
                    pa.array([g["score"] for g in got], pa.float64()),
                    pa.array([[f"{s}-{e} {label} {k}" for s, e, label, k, _ in g["spans"]] for g in got], pa.list_(pa.string())),
                ],
                names=names,
            )

    return src.mapInArrow(
        tidied(run),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"
    )
