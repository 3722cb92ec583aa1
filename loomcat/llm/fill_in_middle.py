"""Fill-in-the-middle training examples.

A text is a row of units: a run of ASCII letters, or any other single code point. Two cuts, ranks of
units taken from a hash of doc_id, part it into prefix, middle and suffix; the example holds them in
one of two orders, each piece behind its marker, or the text as it is.

In a task each text is decoded to an array of UTF-32 code points; a unit starts wherever a code point
or its left neighbour is no letter, so comparing neighbouring classes gives all boundaries at once,
the two ranks are looked up among them, and the pieces are sliced out and encoded again. Nothing is
shuffled. Examples are turned back by column expressions: the markers part them, since a text that
holds one is never cut.

Defined cases: a null or empty text has no units and is plain; a text that holds a marker is plain;
very long texts are cut whole; each row with a doc_id gives a row, so repeated rows give repeated
rows; rows without doc_id go, since their cuts have no source; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: The markers of the three pieces.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Plan:
    """Percentages of texts that are cut at all, and of cut texts that put the suffix first; `seed`
    stands before doc_id in what is hashed."""

    cut: int = 90
    suffix_first: int = 20
    seed: str = "1:"

    def __post_init__(self) -> None:
        if not (0 <= self.cut <= 100 and 0 <= self.suffix_first <= 100):
            raise ValueError("percentages are between 0 and 100")

    def draws(self, doc_id: int) -> tuple[int, int, int, int]:
        digits = hashlib.sha256(f"{self.seed}{doc_id}".encode()).hexdigest()
        return tuple(int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where units start, and the end of the text."""
    folded = points | 32  # both cases of a letter; nothing else becomes one below 128
    letter = (points < 128) & (folded >= ord("a")) & (folded <= ord("z"))
    starts = np.ones(len(points) + 1, bool)
    starts[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts) if len(points) else np.zeros(1, np.int64)


def example(doc_id: int, text: str | None, plan: Plan) -> tuple:
    """One row of SCHEMA."""
    text = text if isinstance(text, str) else ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = boundaries(points)
    n = len(at) - 1
    first, second, whether, order = plan.draws(doc_id)
    if not text or whether % 100 >= plan.cut or any(m in text for m in MARKERS):
        return doc_id, n, "plain", None, None, text
    one, two = sorted((int(at[first % (n + 1)]), int(at[second % (n + 1)])))
    prefix, middle, suffix = (points[s:t].tobytes().decode("utf-32-le", "surrogatepass") for s, t in ((0, one), (one, two), (two, len(points))))
    if order % 100 < plan.suffix_first:
        return doc_id, n, "spm", one, two - one, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return doc_id, n, "psm", one, two - one, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def examples(documents: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if
    plain) and output, the training text."""
    plan = plan or Plan()
    c.session(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [example(int(i), t, plan) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)]
            out = pd.DataFrame(rows, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.mapInPandas(c.freed(run), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made of. No cut text holds a marker and no marker overlaps
    itself or another one, so the three pieces are what stands between the three markers."""
    piece = F.split(output, "|".join(MARKERS), -1)
    return F.when(form == "psm", F.concat(piece[1], piece[3], piece[2])).when(form == "spm", F.concat(piece[2], piece[3], piece[1])).otherwise(output)


def digest(documents: DataFrame) -> DataFrame:
    made = examples(documents)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT doc_id, x, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(u[1:i], '') AS pre, array_to_string(u[i + 1:j], '') AS mid, array_to_string(u[j + 1:], '') AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256 FROM p
"""
