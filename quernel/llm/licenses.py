"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser reads licence expressions.

Phrases and tags are matched on whole words, whatever stands between words. From where the automaton found a
tag an expression of licence names, AND, OR, WITH and brackets is read and evaluated: its labels, and whether a
choice (OR) can avoid a copyleft licence. The expression may begin on a later line than its tag, and goes on
across line ends inside brackets, after an operator and before one in capital letters.

Input cases: null text counts as empty: no words, no labels, score 0; very long texts are scanned whole;
repeated rows get equal results; extra columns are ignored, whatever their names; an empty table gives an empty
result; broken expressions give the names that were read before the fault; a tag with nothing after it gives none.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import ship, table, text_or_empty

#: Phrases that the base labels come from.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of the method's own labels.
NOTICES = {
    "creative commons": "cc",
    "licensed under cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "all rights reserved": "proprietary",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
}
#: Tags that a licence expression follows.
TAGS = ("spdx license identifier", "license expression")
#: Licence name beginnings in expressions and the labels they give, longest first.
FAMILIES = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "bsd": "bsd", "isc": "isc", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "cc0": "public-domain", "unlicense": "public-domain", "proprietary": "proprietary"}
COPYLEFT = {"gpl", "agpl", "lgpl", "mpl", "cc-by-sa"}

#: ASCII that isn't part of words becomes a space, A to Z become a to z.
_TO_WORDS = {c: " " for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123)} | {c: chr(c + 32) for c in range(65, 91)}
_WORD = re.compile(r"[^ ]+")
_TOKEN = re.compile(r"\(|\)|\n|[0-9A-Za-z][0-9A-Za-z.+-]*")
#: Operators and how tightly they bind.
_BINDS = {"or": 1, "and": 2, "with": 3}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            a.add_word(f" {phrase} ", (*a.get(f" {phrase} ", ()), (kind, label, len(phrase) + 2)))
    a.make_automaton()
    return a


def label_of(name: str) -> str:
    name = name.lower()
    return next((label for start, label in sorted(FAMILIES.items(), key=lambda x: -len(x[0])) if name.startswith(start)), "other")


def parse(text: str, at: int = 0) -> list[str]:
    """The expression that begins at a place of text in reverse Polish order; what follows a complete expression is left."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether a name or an opening bracket may come next
    ended = False  # whether a line has ended since the last part
    for m in _TOKEN.finditer(text, at):
        token, low = m[0], m[0].lower()
        if token == "\n":
            ended = True
            continue
        if operand:
            if token == "(":
                stack.append(token)
            elif low in _BINDS or token == ")":
                break
            else:
                out.append(token)
                operand = False
        elif low in _BINDS and (not ended or "(" in stack or token.isupper()):
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
        ended = False
    if operand and stack and stack[-1] in _BINDS:
        stack.pop()
    return out + [s for s in reversed(stack) if s != "("]


def evaluate(rpn: list[str]) -> tuple[set[str], bool]:
    """Labels of an expression, and whether one can comply without copyleft."""
    stack: list[tuple[set[str], bool]] = []
    for token in rpn:
        if token in _BINDS:
            if len(stack) < 2:
                break
            b, a = stack.pop(), stack.pop()
            if token == "with":  # the right side is an exception, no licence
                stack.append(a)
            else:
                stack.append((a[0] | b[0], a[1] or b[1] if token == "or" else a[1] and b[1]))
        else:
            label = label_of(token)
            stack.append(({label}, label not in COPYLEFT))
    labels = set().union(*(s[0] for s in stack)) if stack else set()
    return labels, all(s[1] for s in stack)


def scan_text(text: str, finder: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, str, str, float]:
    spaced = text.translate(_TO_WORDS)
    found = [w for w in spaced.split(" ") if w]
    plain = f" {' '.join(found)} "
    starts: list[int] = []
    tags: list[int] = []
    base, own = set(), set()
    for end, hits in finder.iter(plain):
        for kind, label, size in hits:
            if kind == "base":
                starts.append(end - size + 1)
                base.add(label)
            elif kind == "notice":
                own.add(label)
            else:
                tags.append(end)
    free, tagged = True, bool(tags)
    if tagged:
        # The space that ends a tag stands behind its last word: so many words are before what follows the tag.
        ends = [m.end() for m in _WORD.finditer(spaced)]
        before = [0, *itertools.accumulate(c == " " for c in plain)]
        for end in tags:
            labels, free_here = evaluate(parse(text, ends[before[end] - 1]))
            own |= labels
            free &= free_here
    labels = base | own
    first = plain.count(" ", 0, min(starts)) if starts else None
    last = plain.count(" ", 0, max(starts)) if starts else None
    # How sure: a tag's expression is plain, a notice less so; unclear or copyleft expressions take some away.
    score = 0.0 if not labels else min(1.0, 0.5 + 0.2 * bool(base) + 0.3 * tagged - 0.1 * ("other" in labels) - 0.1 * (tagged and not free))
    return len(found), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and what scan_text finds, for every whole text. Narrow."""
    ship(docs.sparkSession)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        for batch in batches:
            rows = [scan_text(t, finder) for t in text_or_empty(batch.column(1).to_pylist())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
