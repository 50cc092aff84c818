"""License scans by patience alignment.

A template's words are aligned to a text's: words that occur once in either are
anchors, the longest increasing run of them is kept, and the gaps between kept
anchors are aligned in the same way; neighbours of anchors that agree extend
them.  Coverage is the share of the template's words that are aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import known, through

COVERAGE = 0.8

#: Five short notices, Apache's header, and MIT and ISC without their "AS IS" parts; no other license.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}

#: Bytes that are no part of a word become blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, in which the second rises."""
    tails, ends, before = [], [], []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1] = [b]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _agreeing(text: list[bytes], template: list[bytes], gap: tuple[int, int, int, int], start: bool, end: bool) -> tuple[list[tuple[int, int]], int, int, int, int]:
    """Pairs of an agreeing start and end of the gap, as asked for, and what is left of it."""
    (a, b, c, d), out = gap, []
    while start and a < b and c < d and text[a] == template[c]:
        out.append((a, c))
        a, c = a + 1, c + 1
    while end and a < b and c < d and text[b - 1] == template[d - 1]:
        b, d = b - 1, d - 1
        out.append((b, d))
    return out, a, b, c, d


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Aligned (text position, template position) pairs, rising in both."""
    # start, end: whether an anchor is there; where the text begins or ends, words that agree may be chance.
    out, gaps = [], [((0, len(text), 0, len(template)), False, False)]
    while gaps:
        gap, start, end = gaps.pop()
        pairs, a, b, c, d = _agreeing(text, template, gap, start, end)
        out += pairs
        if a == b or c == d:
            continue
        wanted = Counter(template[c:d])
        places: dict[bytes, list[int]] = {}
        for k in range(a, b):
            if text[k] in wanted:
                places.setdefault(text[k], []).append(k)
        anchors = sorted((places[w][0], k) for k, w in enumerate(template[c:d], c) if wanted[w] == 1 and len(places.get(w, ())) == 1)
        kept = _increasing(anchors)
        if not kept:
            if places:
                loose = _agreeing(text, template, (a, b, c, d), not start, not end)[0]
                out += max(_nearest(places, template, c, d), loose, key=len)
            continue
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        for k, ((p, q), (r, s)) in enumerate(zip(edges, edges[1:], strict=False)):
            if r - p > 1 and s - q > 1:
                gaps.append(((p + 1, r, q + 1, s), start or k > 0, end or k < len(kept)))
    return sorted(set(out))


def _nearest(places: dict[bytes, list[int]], template: list[bytes], c: int, d: int) -> list[tuple[int, int]]:
    """Where a gap has no word unique to both sides: the densest run of template words in order.

    Every place of the template's rarest word in the text starts one try, so a
    notice that a text repeats is found at one of its places.
    """
    rarest = min((w for w in template[c:d] if w in places), key=lambda w: (len(places[w]), w))
    base = template.index(rarest, c, d)
    best: list[tuple[int, int]] = []
    for start in places[rarest]:
        run, at = [(start, base)], start
        for k in range(base + 1, d):
            own = places.get(template[k], ())
            x = bisect_left(own, at + 1)
            if x < len(own) and own[x] - at <= 2 * (d - c):
                at = own[x]
                run.append((at, k))
        at = start
        for k in range(base - 1, c - 1, -1):
            own = places.get(template[k], ())
            x = bisect_left(own, at) - 1
            if x >= 0 and at - own[x] <= 2 * (d - c):
                at = own[x]
                run.append((at, k))
        if len(run) > len(best):
            best = run
        if len(best) == d - c:
            break
    return best


def coverage(text: list[bytes], counts: Counter, template: list[bytes], need: Counter, least: float) -> tuple[float, int, int]:
    """(share of the template that is aligned, first and last aligned text position); 0 where it can't reach ``least``."""
    most = sum(min(n, counts.get(w, 0)) for w, n in need.items())
    if not template or most < least * len(template):
        return 0.0, -1, -1
    pairs = align(text, template)
    # Words far from the rest are chance: only the densest stretch of twice the template's length counts.
    span, best, at, first, last = 2 * len(template), 0, 0, -1, -1
    for k, (p, _) in enumerate(pairs):
        while p - pairs[at][0] >= span:
            at += 1
        if k - at + 1 > best:
            best, first, last = k - at + 1, pairs[at][0], p
    return best / len(template), first, last


def _scan(templates: dict[str, list[bytes]], least: float):
    needs = {name: Counter(words) for name, words in templates.items()}

    def step(texts: list) -> dict:
        out = {"n_words": [], "hits": []}
        for text in known(texts):
            words = words_of(text)
            counts = Counter(words)
            hits = []
            for name, template in templates.items():
                share, first, last = coverage(words, counts, template, needs[name], least)
                if share >= least:
                    hits.append({"license": name, "coverage": share, "first_word": first, "last_word": last})
            hits.sort(key=lambda h: (-h["coverage"], -len(templates[h["license"]]), h["license"]))
            out["n_words"].append(len(words))
            out["hits"].append(hits)
        return out

    return lambda: step


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, n_words, license, coverage, n_licenses, hits), a row per row.

    hits lists each template whose coverage reaches ``least``, with the first
    and last aligned word, best first: by coverage, then by the template's
    length, then by name; license and coverage are the first's, or null and 0.

    Defined cases: null and empty texts have no words and no hits; an empty
    template never hits; whole texts are aligned, however long; rows without
    doc_id and repeated rows are scanned like others; an empty table gives an
    empty result; further columns are ignored.
    """
    chosen = {name: words_of(t.encode()) for name, t in (TEMPLATES if templates is None else templates).items()}
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hit = "struct<license: string, coverage: double, first_word: long, last_word: long>"
    found = through(narrow, f"n_words long, hits array<{hit}>", _scan(chosen, least))
    first = F.get("hits", F.lit(0))
    return found.select(
        "doc_id",
        "n_words",
        first["license"].alias("license"),
        F.coalesce(first["coverage"], F.lit(0.0)).alias("coverage"),
        F.size("hits").cast("long").alias("n_licenses"),
        "hits",
    )
