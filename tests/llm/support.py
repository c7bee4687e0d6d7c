"""Small tables with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int) -> str:
    syllables = "the an er ing tion re st ou wh ea ha en or ti sh".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


def rows(n: int = 120, seed: int = 3) -> list[tuple]:
    """Prose with exact copies, near copies, nulls, blanks, one long text and repeated rows."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = prose(rng, rng.randint(1, 220))
        if i % 10 == 3:
            t = out[rng.randrange(len(out))][1]
        elif i % 10 == 4:
            w = (out[i - 2][1] or "x").split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif i % 10 == 5:
            t = (out[i - 4][1] or "").replace(" ", "\t\n ") + "  "
        out.append((i, t, "en", f"src{i % 4}", len(t or "")))
    out += [(n, None, None, None, None), (n + 1, "", "en", None, 0), (n + 2, " \t\n", "fr", "src1", 3), (n + 3, prose(rng, 9000), "en", "src0", 1)]
    out += [(n + 4, "Ünïcode çà \U0001f600 " * 40, "fr", "é", 1), out[0], (None, "no number at all", "en", "src2", 4)]
    return out


def frame(spark, data: list[tuple], extra: bool = True):
    """The table; with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(data, SCHEMA)
    return d.withColumns({c: F.lit(1) for c in ("size", "digest", "rank", "key", "fp", "score", "part", "h", "bin", "copies")}) if extra else d


def find(parent: dict, a):
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    return a
