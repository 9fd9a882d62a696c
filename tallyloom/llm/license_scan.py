"""Fuzzy search for short license notices.

Each notice may be off by a few edits (inserted, deleted or changed characters).  A notice with at most k
edits keeps at least one of any k + 1 pieces unchanged (pigeonhole), so an Aho-Corasick automaton over all
notices' pieces finds every candidate place; the regex library's bounded-error matching then verifies the
text around it, counts the edits and gives the span.  Exact phrases are counted beside that, word by word.

Defined results: a null text counts as empty (no words, no labels, score 0); null or repeated doc_ids stay
as rows of their own; texts are scanned whole, however long; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import text_of

# The phrases whose words are counted exactly, and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices that are searched with errors: label, words, the most edits.
NOTICES = (
    ("agpl", "gnu affero general public license", 3),
    ("apache", "licensed under the apache license", 3),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("cc-by", "creative commons attribution", 3),
    ("gpl", "gnu general public license", 2),
    ("isc", "permission to use copy modify and or distribute this software", 5),
    ("lgpl", "gnu lesser general public license", 3),
    ("mit", "released under the mit license", 3),
    ("mit", "permission is hereby granted free of charge", 4),
    ("mpl", "mozilla public license", 2),
    ("cc-by", "licensed under cc by", 2),
    ("reserved", "all rights reserved", 2),
    ("unlicense", "this is free and unencumbered software", 4),
)

SPANS = "array<struct<label string, start int, end int, edits int, found string>>"
SCHEMA = f"""doc_id long, n_words long, n_base long, first_word long, last_word long,
    base_labels string, labels string, score double, spans {SPANS}"""

# Everything but digits, lower-case letters and the bytes of non-ASCII characters parts words.
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else 32 for b in range(256))


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) for edits + 1 pieces of nearly equal length that make up the notice."""
    n = edits + 1
    cuts = [i * len(notice) // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def compiled(notices: tuple) -> tuple:
    """The automaton over all pieces, and each notice's pattern; built once in each worker."""
    import ahocorasick
    import regex

    at: dict[str, list[tuple[int, int]]] = {}
    for k, (_, words, edits) in enumerate(notices):
        for offset, piece in pieces(words, edits):
            at.setdefault(piece, []).append((k, offset))
    automaton = ahocorasick.Automaton()
    for piece, places in at.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    patterns = [regex.compile(rf"(?be)(?:{regex.escape(words)}){{e<={edits}}}") for _, words, edits in notices]
    return automaton, patterns


def candidates(norm: str, automaton, notices: tuple) -> dict[int, list[list[int]]]:
    """Windows of each notice in which it may stand; those of seeds that may be of one place are one."""
    windows: dict[int, list[list[int]]] = {}
    for end, (length, places) in automaton.iter(norm):
        start = end + 1 - length
        for k, offset in places:
            _, words, edits = notices[k]
            a, b = max(0, start - offset - edits), min(len(norm), start - offset + len(words) + edits)
            own = windows.setdefault(k, [])
            if own and abs(a - own[-1][2]) <= 2 * edits:
                own[-1][0], own[-1][1] = min(a, own[-1][0]), max(b, own[-1][1])
            else:
                own.append([a, b, a])
    return windows


def verified(pattern, norm: str, windows: list[list[int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, edits, found) of one notice's matches that do not overlap: the best of each window, those of
    fewest edits first; then again in what is left of the windows beside them, until nothing is found."""
    starts: list[int] = []
    taken: list[tuple[int, int, int, str]] = []
    parts = {(a, b) for a, b, _ in windows}
    while parts:
        best = {}
        for a, b in parts:
            m = pattern.search(norm, a, b)
            if m and m.end() > m.start():
                best.setdefault((sum(m.fuzzy_counts), m.start(), m.end(), m.group()), []).append((a, b))
        again = set()
        for (edits, start, end, found), own in sorted(best.items()):
            at = bisect(starts, start)
            if (not at or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                starts.insert(at, start)
                taken.insert(at, (start, end, edits, found))
            again.update(own)
        parts = {x for a, b in again for x in _free(a, b, starts, taken)}
    return taken


def _free(a: int, b: int, starts: list[int], taken: list[tuple]) -> Iterator[tuple[int, int]]:
    """The parts of a window that no taken span covers."""
    at = max(0, bisect(starts, a) - 1)
    while a < b:
        start, end = (taken[at][0], taken[at][1]) if at < len(taken) else (b, b)
        if a < min(start, b):
            yield a, min(start, b)
        a, at = max(a, end), at + 1


def fuzzy_spans(norm: str, notices: tuple = NOTICES) -> list[tuple[str, int, int, int, str]]:
    """(label, start, end, edits, found) of verified notices in a normalised text, by place."""
    automaton, patterns = compiled(notices)
    found = set()
    for k, windows in candidates(norm, automaton, notices).items():
        found.update((notices[k][0], *span) for span in verified(patterns[k], norm, windows))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def base_places(padded: str) -> tuple[list[int], set[str]]:
    """Word numbers at which phrases start, and the labels found. ``padded``: words with a space around each."""
    starts, labels = [], set()
    for phrase, label in BASE_PHRASES:
        sought, at, seen, word = f" {phrase} ", -1, 0, 0
        while (at := padded.find(sought, at + 1)) >= 0:
            word += padded.count(" ", seen, at)
            seen = at
            starts.append(word)
            labels.add(label)
    return starts, labels


def scan_text(text: str, notices: tuple = NOTICES) -> tuple:
    """One document's row, without its id."""
    parts = text.encode("utf-8", "surrogatepass").lower().translate(_WORD_BYTES).split()
    padded = f" {b' '.join(parts).decode('utf-8', 'surrogatepass')} "
    starts, base = base_places(padded)
    spans = fuzzy_spans(padded, notices)
    sizes = {label: [] for label, *_ in spans}
    for label, a, b, edits, _ in spans:
        sizes[label].append(1.0 - edits / max(1, b - a))
    score = 1.0 if base else max((max(x) for x in sizes.values()), default=0.0)
    return (
        len(parts), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | set(sizes))), max(0.0, min(1.0, score)),
        [dict(zip(("label", "start", "end", "edits", "found"), s)) for s in spans],
    )


def scan(docs: DataFrame, notices: tuple = NOTICES) -> DataFrame:
    """A row per document: words, exact phrases' places, labels, score, and the verified spans.

    Spans count characters of the normalised text with a space before it.
    """
    schema = docs.sparkSession.createDataFrame([], SCHEMA).schema
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("found", pa.string())]))),
    ])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(i, *scan_text(t.as_py(), notices)) for i, t in zip(ids, batch.column(1))]
            columns = list(zip(*rows)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(scanned, schema)
