"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and texts are words (runs of letters and digits; ASCII case does not matter).  Hashes of GRAM words
are winnowed over windows of WINDOW, so that any run of GRAM + WINDOW - 1 words that a text shares with a template
leaves a common fingerprint.  An inverted index of the templates' fingerprints turns hits into anchors (template,
diagonal).  Around each group of anchors a local alignment in a band of diagonals reports the matched words, the
share of the template they cover, and the span of the text.

Templates that differ in a word or two (the headers of the GPL family, BSD with two or three clauses) all match a text
of one of them: a match that is not word for word gives way to an overlapping match that covers more of its template, or as
much of a longer one.

The templates (``license_texts``) are the whole texts of MIT, BSD-2-Clause, BSD-3-Clause, ISC, zlib, BSL-1.0 and Unlicense
(without the last link), the headers of Apache-2.0, GPL-2.0, GPL-3.0, AGPL-3.0, LGPL-2.1, LGPL-3.0, MPL-2.0 and CC0-1.0, and
one line each for Apache-2.0, MIT, GPL-3.0, CC BY-NC 4.0 and CC BY 4.0.  The full Apache, GPL, MPL and CC texts match only if
a caller gives their templates.

Templates are few and fixed, so the index goes to every task; texts are scanned where they are, without a shuffle.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import bounded_batches
from docspark.llm.license_texts import TEMPLATES
from docspark.llm.words import gram_hashes, text_groups, word_hashes

GRAM = 3
WINDOW = 2
BAND = 6
MIN_COVERAGE = 0.7
MATCH, MISMATCH, GAP = 2, -2, -1

_FOLD = bytes(
    i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256)
)
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def winnowed(h):
    """True at the hashes that winnowing keeps: the least of some window of WINDOW (all, where there are fewer)."""
    import numpy as np

    n = len(h)
    keep = np.zeros(n, bool)
    if n < WINDOW:
        keep[:] = True
        return keep
    least = np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(1)
    for i in range(WINDOW):
        keep[i : n - WINDOW + 1 + i] |= h[i : n - WINDOW + 1 + i] == least
    return keep


class TemplateIndex:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]):
        import numpy as np

        self.names = list(templates)
        self.words = [fold(templates[t]).split() for t in self.names]
        if any(len(w) < GRAM for w in self.words):
            raise ValueError(f"a template needs {GRAM} words")
        self.posts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            h = gram_hashes(word_hashes([b" ".join(words)])[0], GRAM)
            for at in np.flatnonzero(winnowed(h)):
                self.posts[int(h[at])].append((t, int(at)))
        self.keys = np.array(sorted(self.posts), np.uint64)
        # one window is not full in a template of so few words: a text's winnowing may leave out its only fingerprint
        short = {key for key, places in self.posts.items() if any(len(self.words[t]) < GRAM + WINDOW - 1 for t, _ in places)}
        self.short = np.array(sorted(short), np.uint64)

    def hits(self, texts: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """{text: [(place, fingerprint)]} of the texts that share a fingerprint with a template."""
        import numpy as np

        words, bounds = word_hashes(texts)
        h = gram_hashes(words, GRAM)
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if not len(h):
            return out
        # windows across the end of a text keep some more, which loses nothing
        kept = np.flatnonzero(winnowed(h) | np.isin(h, self.short))
        at = np.minimum(np.searchsorted(self.keys, h[kept]), len(self.keys) - 1)
        for p in kept[self.keys[at] == h[kept]]:
            i = int(np.searchsorted(bounds, p, side="right")) - 1
            if p + GRAM <= bounds[i + 1]:
                out[i].append((int(p - bounds[i]), int(h[p])))
        return out


def align(text: list[bytes | None], template: list[bytes], diagonal: int, band: int = BAND):
    """Best local alignment with text place - template place within ``band`` of ``diagonal``.

    Returns (matched words, first text word, last text word), or None.  Among equal scores more matches win, then the earliest end.
    No alignment holds a place where ``text`` is None.
    """
    width = 2 * band + 1
    zero = (0, 0, -1)  # score, matched, first
    above = [zero] * (width + 1)
    best, place = zero, -1
    for t, word in enumerate(template):
        row = [zero] * (width + 1)
        for b in range(width):
            i = t + diagonal - band + b
            if not 0 <= i < len(text) or text[i] is None:
                continue
            same = text[i] == word
            score, matched, first = above[b]  # one word back in both
            options = [zero]
            if same:
                options.append((score + MATCH, matched + 1, first if score > 0 else i))
            elif score > 0:
                options.append((score + MISMATCH, matched, first))
            up = above[b + 1]
            if up[0] + GAP > 0:
                options.append((up[0] + GAP, up[1], up[2]))
            if b and row[b - 1][0] + GAP > 0:
                side = row[b - 1]
                options.append((side[0] + GAP, side[1], side[2]))
            row[b] = max(options)
            if same and row[b][:2] > best[:2]:
                best, place = row[b], i
        above = row
    return (best[1], best[2], place) if best[0] > 0 else None


def matches(text: str | None, found: list[tuple[int, int]], index: TemplateIndex, min_coverage: float) -> list[tuple]:
    """(name, coverage, start, end) of one text's matches; overlapping matches of one template are told once.

    The best match comes first; its words are then taken, and the groups of anchors that held them are aligned again.
    """
    spots = list(_WORD.finditer(text or ""))
    words = fold(text).split()
    anchors = defaultdict(set)
    for place, key in found:
        for t, at in index.posts[key]:
            anchors[t].add(place - at)
    out = []
    for t, diagonals in anchors.items():
        template, free, last, heap = index.words[t], list(words), None, []

        def offer(d):
            # no alignment matches more words than the template has in the stretch of text that its band can reach
            near = set(free[max(d - BAND, 0) : max(d + len(template) + BAND, 0)])
            if sum(word in near for word in template) < min_coverage * len(template):
                return
            got = align(free, template, d)
            if got and got[0] >= min_coverage * len(template):
                heapq.heappush(heap, (-got[0], got[1], got[2], d))

        for d in sorted(diagonals):
            if last is not None and d - last <= BAND // 2:
                continue  # in the band of the last one already
            last = d
            offer(d)
        while heap:
            matched, first, end, d = heapq.heappop(heap)
            if None not in free[first : end + 1]:
                out.append((index.names[t], -matched / len(template), spots[first].start(), spots[end].end(), -matched, end - first + 1 == len(template)))
                free[first : end + 1] = [None] * (end + 1 - first)
            offer(d)
    return sorted((r[:4] for r in undisputed(out)), key=lambda r: (r[2], r[3], r[0]))


def undisputed(found: list[tuple]) -> list[tuple]:
    """Of (name, coverage, start, end, matched words, as many words in the span as in the template): those that are word for
    word, or overlap none that covers more of its template, or as much of a longer one."""
    groups: list[list[tuple]] = []
    reach = 0
    for match in sorted(found, key=lambda r: r[2]):
        if groups and match[2] < reach:
            groups[-1].append(match)
        else:
            groups.append([match])
        reach = max(reach, match[3])

    def gives_way(match: tuple, group: list[tuple]) -> bool:
        return any((r[1], r[4]) > (match[1], match[4]) and r[2] < match[3] and match[2] < r[3] for r in group)

    return [m for g in groups for m in g if (m[1] == 1 and m[5]) or not gives_way(m, g)]


def scan_licenses(
    df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """License notices in every whole text.

    Result, one row a document: ``<id_col>``, ``n_matches`` (long), ``coverage`` (the highest, 0 without a match),
    ``licenses`` (distinct names, sorted, joined by commas), ``spans`` (``name:start:end``, code points, joined), and
    ``matches`` (array of license, coverage, start, end).

    Defined cases: a null or empty text has no match; repeated rows each give a row; a text may match several
    templates, and one template several times; an empty table gives no rows; other columns are not read.
    """
    bounded_batches(df.sparkSession)
    templates = TEMPLATES if templates is None else templates
    slim = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def scan(batches):
        import pyarrow as pa

        index = TemplateIndex(templates)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for group in text_groups(batch.column(1).to_pylist()):
                hits = index.hits([fold(t) for t in group])
                for j, t in enumerate(group):
                    got = matches(t, hits[j], index, min_coverage) if j in hits else []
                    rows.append([dict(zip(("license", "coverage", "start", "end"), m)) for m in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["_id", "matches"])

    kind = "array<struct<license:string,coverage:double,start:bigint,end:bigint>>"
    got = slim.mapInArrow(scan, f"_id {dict(slim.dtypes)['_id']}, matches {kind}")
    return got.select(
        F.col("_id").alias(id_col),
        F.size("matches").cast("long").alias("n_matches"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"])), ",").alias("spans"),
        "matches",
    )
