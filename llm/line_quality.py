"""Quality rules, line first: lines that fail a rule are removed, then documents that lost too much text are rejected.

Lines are split at ``\\n``.  A line with a word fails by the first of these rules that holds (``RULES``):

* ``repeated``: it equals an earlier line of its document;
* ``navigation``: it has many separators between its items, or lists short items without a sentence end;
* ``symbols``: it has over ``max_symbols`` characters of ``#*$%&|<>`` a word;
* ``shouting``: it has at least ``shout_words`` words and no lower-case letter;
* ``boilerplate``: it holds a phrase of ``BOILERPLATE``;
* ``punctuation``: it has at least ``sentence_words`` words and does not end as a sentence does (the last line may be cut).

A document fails the base rules with under 10 words, or with over a fifth of its words in 5-word windows that it repeats.
Of the others, those whose removed lines hold over ``max_lost`` of its words' characters are rejected.

Edge cases: a null text is empty; an empty text has no words and fails the base rules; an empty table gives an empty
result; repeated rows and ties are judged row by row; further columns are ignored.  Whole texts are read, however long.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, small_batches
from .textkernel import Words, buffers, slices, windows

RULES = ("repeated", "navigation", "symbols", "shouting", "boilerplate", "punctuation")
SYMBOLS = "#*$%&|<>"
# Phrases of page furniture in four languages.
BOILERPLATE = [
    "accept cookies", "all rights reserved", "alle rechte vorbehalten", "aviso legal", "click here", "cookie policy", "datenschutzerklärung", "haga clic aquí",
    "hier klicken", "impressum", "lorem ipsum", "mentions légales", "politique de confidentialité", "política de privacidad", "privacy policy", "sign up now",
    "subscribe to our newsletter", "terms of service", "terms of use", "todos los derechos reservados", "tous droits réservés", "use of cookies",
]
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_SPACE = " \t\n\r\x0b\x0c"
_ENDS = tuple(".!?…:;\"'”’»)]}。！？")
_SEPARATORS = re.compile(r"[|»›•·]|(?<=\s)[>/-](?=\s)")


def line_rule(line: str, words: int, seen: bool, last: bool, max_symbols: float = 0.25, shout_words: int = 4, sentence_words: int = 12) -> str | None:
    """The rule that a line fails, if any."""
    if seen:
        return "repeated"
    bars = line.count("|") + line.count("»") + line.count("›") + line.count("•") + line.count("·")
    if bars * 4 >= words and bars > 1 or " > " in line and len(_SEPARATORS.findall(line)) * 3 >= words:
        return "navigation"
    if sum(map(line.count, SYMBOLS)) > max_symbols * words:
        return "symbols"
    if words >= shout_words and line.isupper():
        return "shouting"
    if _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if words >= sentence_words and not last and not line.rstrip(_SPACE).endswith(_ENDS):
        return "punctuation"
    return None


def _lines(text: str, rules: dict) -> tuple[int, list[str], dict[str, int], int]:
    """Repeated lines, the lines that stay, characters removed by each rule, characters in words."""
    seen: set[str] = set()
    stay, lost, repeated, total = [], dict.fromkeys(RULES, 0), 0, 0
    lines = text.split("\n")
    for k, line in enumerate(lines):
        parts = _WORDS.findall(line)
        if not parts:
            stay.append(line)
            continue
        again = line in seen
        repeated += again
        seen.add(line)
        chars = sum(map(len, parts))
        total += chars
        rule = line_rule(line, len(parts), again, k + 1 == len(lines), **rules)
        if rule is None:
            stay.append(line)
        else:
            lost[rule] += chars
    return repeated, stay, lost, total


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_words(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of them lie in k-word windows that the text has twice or more."""
    w = Words(raw, offsets)
    n = np.diff(w.offsets)
    h, at = windows(w.hashes(lower=False), w.offsets, k)
    out = np.zeros(len(n), np.int64)
    for t in np.flatnonzero(n > k):
        v = h[at[t] : at[t + 1]]
        s = np.sort(v)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            hit = np.isin(v, twice)
            out[t] = np.count_nonzero(np.convolve(hit.astype(np.int64), np.ones(k, np.int64)))
    return n, out


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5, with_text: bool = True, **rules) -> DataFrame:
    """Per document: the base measures, characters that each rule removed, the verdict and, with with_text, the cleaned text."""
    small_batches(docs.sparkSession)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    lost = [f"lost_{r}" for r in RULES]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in [*base, *lost]) + ", base_failed boolean, kept boolean" + ", clean_text string" * with_text

    def run(batches):
        for batch in batches:
            for b in slices(batch, "t"):
                raw, offsets = buffers(b.column("t"))
                n, again = repeated_words(raw, offsets)
                cols: list[list] = [[] for _ in range(4 + len(RULES) + with_text)]
                for text in b.column("t").to_pylist():
                    text = text or ""
                    repeated, stay, gone, chars = _lines(text, rules)
                    row = [chars, sum(map(text.count, SYMBOLS)), repeated, *gone.values(), chars and sum(gone.values()) > max_lost * chars]
                    for c, x in zip(cols, [*row, *["\n".join(stay)] * with_text], strict=True):
                        c.append(x)
                failed = (n < 10) | (100 * again > 20 * n)
                much = np.array(cols[3 + len(RULES)], bool)
                out = [b.column("d"), pa.array(n.astype(np.int64)), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(again), *(pa.array(c, pa.int64()) for c in cols[3 : 3 + len(RULES)]), pa.array(failed), pa.array(~failed & ~much)]
                if with_text:
                    out.append(pa.array(cols[-1], pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", *base, *lost, "base_failed", "kept", *["clean_text"] * with_text])

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(lean(run), schema)
