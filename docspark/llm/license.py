"""License scans by fuzzy short-notice search.

Each notice of m characters may differ by k = m // 12 edits (1 at least). It is cut in
k+1 pieces; by the pigeonhole principle any occurrence with k edits holds one piece
unchanged. An Aho-Corasick automaton finds all pieces of all notices in one pass; only
around those seeds does the regex library's bounded-error matching run, which confirms
the edits and gives the span.

Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters; notices
are matched on the words joined by single blanks, so punctuation and line breaks between
words cost nothing. An edit is one code point inserted, left out or replaced, and a match
begins and ends with whole words.

Defined cases: null text is an empty text and gives no words, no labels and score 0;
equal rows give equal results; matches of different notices may overlap; further columns
are ignored; an empty table gives an empty result. Nothing is shuffled.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import bounded_batches
from docspark.llm.textnum import PLAIN, word_spans

BASE = re.compile(rb"(?<![^ ])(?:(?P<cc>cc +by)|(?P<gpl>general +public +license)|(?P<reserved>all +rights +reserved))(?![^ ])")
BASE_LABEL = {"cc": "cc-by", "gpl": "gpl", "reserved": "reserved"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HINTS = (b"cc ", b"public", b"rights")
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc0", "creative commons zero v1 0 universal"),
    ("reserved", "all rights reserved"),
)
CHARS_PER_EDIT = 12
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:int>>"


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 consecutive pieces of about equal length, with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices=NOTICES):
        seeds: dict[str, list[tuple[int, int]]] = {}
        self.notices = []
        for n, (label, notice) in enumerate(notices):
            edits = max(1, len(notice) // CHARS_PER_EDIT)
            for offset, piece in pieces(notice, edits):
                seeds.setdefault(piece, []).append((n, offset))
            self.notices.append((label, len(notice), edits, regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(notice, special_only=True)}){{e<={edits}}}(?![^ ])")))
        self.automaton = ahocorasick.Automaton()
        for piece, at in seeds.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def fuzzy(self, line: str) -> list[tuple[str, int, int, int, int]]:
        """label, start, end, edits, notice length of every match in words joined by blanks."""
        windows: dict[int, list[list[int]]] = {}
        for last, (size, at) in self.automaton.iter(line):
            for n, offset in at:
                _, length, edits, _ = self.notices[n]
                low = last + 1 - size - offset - edits
                w = windows.setdefault(n, [])
                if w and low <= w[-1][1]:
                    w[-1][1] = max(w[-1][1], low + length + 2 * edits)
                else:
                    w.append([low, low + length + 2 * edits])
        out = []
        for n, spans in windows.items():
            label, length, edits, pattern = self.notices[n]
            for low, high in _merged([whole_words(line, *w) for w in spans]):
                # the best match comes first, so what lies to both sides of it is searched again
                parts = [(low, high)]
                while parts:
                    low, high = parts.pop()
                    m = pattern.search(line[low:high])
                    if m and m.end() > m.start():
                        out.append((label, low + m.start(), low + m.end(), sum(m.fuzzy_counts), length))
                        parts += [(a, b) for a, b in ((low, low + m.start()), (low + m.end(), high)) if b - a >= length - edits]
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def scan(self, text: str) -> tuple:
        plain = text.encode().lower().translate(PLAIN)
        starts, ends = word_spans(np.frombuffer(plain, np.uint8) != 32)
        base = [(m.lastgroup, m.start()) for m in BASE.finditer(plain)] if any(h in plain for h in HINTS) else []
        first = [int(np.searchsorted(starts, at)) for _, at in base]
        base_labels = {BASE_LABEL[g] for g, _ in base}
        spans, score = [], 1.0 if base else 0.0
        if len(starts):
            found = self.fuzzy(b" ".join(plain.split()).decode())
            if found:
                # where each word stands in the text, and where it begins in the joined line
                places = [m.span() for m in WORD.finditer(text)]
                at = [0, *itertools.accumulate(b - a + 1 for a, b in places)]
                for label, a, b, edits, length in found:
                    i, j = bisect_right(at, a) - 1, bisect_right(at, b - 1) - 1
                    spans.append((label, places[i][0] + a - at[i], min(places[j][0] + b - at[j], places[j][1]), edits))
                    score = max(score, 1.0 - edits / length)
        labels = base_labels | {s[0] for s in spans}
        return len(starts), len(base), min(first, default=None), max(first, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans


def whole_words(line: str, low: int, high: int) -> tuple[int, int]:
    """The window widened to whole words."""
    low = line.rfind(" ", 0, max(low, 0)) + 1 if low > 0 else 0
    end = line.find(" ", min(high, len(line)))
    return low, len(line) if end < 0 else end


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    for batch in batches:
        rows = [scanner.scan(t.as_py() or "") for t in batch.column(1)]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        columns[-1] = [[dict(zip(("label", "start", "end", "edits"), s, strict=True)) for s in x] for x in columns[-1]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *names])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word count, base phrases, labels, score, fuzzy spans in code points."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan_batches, SCHEMA)
