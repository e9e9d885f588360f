"""Sentence units in many languages by a semi-Markov dynamic programme over whole spans.

Every mark that could end a sentence is a candidate (in Thai also a blank between two Thai letters); left out are only those
whose score no length and no quotation could make up for. For each paragraph the programme picks the set of spans with the highest total score. A span is scored by

* its closing word together with the opening word of what follows (JOINT), moved by what the corpus says of both words,
* its length in code points under a log-normal law fitted on the corpus,
* its quotations and brackets: each pair that one of its ends cuts, and a quotation that it ends with but did not open with.

The search is exact; it starts anew only at marks that provably end a span in every best solution (``_certain``).

Null or blank texts give no rows; repeated rows give repeated units; other columns of the input are ignored. Word
statistics cover all texts; words under the relative frequency ``FLOOR`` have none, so at most 1 / FLOOR go to the workers.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Abbreviations that never close a sentence, by the word before the full stop, in lower case.
NEVER_FINAL = frozenset(
    "dr mr mrs ms prof st sr sra dra ing cf approx vs i.e e.g viz rev bzw ca vgl bsp aprox ee dña ex mme mlle "
    "gen col capt lt jan feb mar apr jun jul aug sep sept oct nov dec co डॉ श्री मि मी सं".split()
)
# Abbreviations only before a number.
BEFORE_NUMBER = frozenset("fig figs tab sec no nos vol ch chap nr abs s art pág pag núm p pp n° bd kap".split())
# Abbreviations that may also close a sentence; what follows decides.
MAYBE_FINAL = frozenset("etc ltd inc corp co. p.m a.m u.k u.s usw env uu bros jr".split())
# Words before a German or French ordinal number with a full stop.
ORDINAL_LEAD = frozenset("im am vom zum beim ab bis der dem den des das die seit".split())

OPEN_CLOSE = {"(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "«": "»", "‹": "›", "“": "”", "„": "“", "‘": "’", "《": "》", "（": "）"}
QUOTES = frozenset("「『«‹“„\"")
CLOSERS = frozenset(")]}」』»›”“\"’》）'")

PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
MARK = re.compile(r"[.!?…。！？।]+")
PAIR_CHARS = re.compile(r"[()\[\]「」『』«»“”„\"《》（）]")
LAST_WORD = re.compile(r"[^\s(\[«“„\"「]+$")
NEXT_WORD = re.compile(r"[^\W\d_]+")
THAI_BREAK = re.compile(r"(?<=[฀-๿])[ \t 　]+(?=[฀-๿])")
HAS_THAI = re.compile(r"[฀-๿]")
DEVANAGARI = re.compile(r"[ऀ-ॿ]")
JOINED = re.compile(r"[^\W\d_]{3}[.!?]([^\W\d_][^\s]*)$")
BLANKLESS = re.compile(r"[฀-๿぀-ヿ一-鿿]")
#: Marks that end a sentence wherever they stand before a blank; pieces between them show how long sentences are.
STRONG_END = re.compile(r"[.!?]\s+(?=[A-ZÄÖÜÁÉÍÓÚÑ¿¡])|[。！？।]|[฀-๿]\s+(?=[฀-๿])")

def _pairs(text: str) -> list[tuple[int, int]]:
    """Matched quotations and brackets as (first, last) positions; what stays open is ignored."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in PAIR_CHARS.finditer(text):
        c, at = m.group(), m.start()
        if c == '"':
            if any(s == '"' for s, _ in stack):
                while stack[-1][0] != '"':
                    stack.pop()
                found.append((stack.pop()[1], at))
            else:
                stack.append((c, at))
            continue
        closing = next((k for k in range(len(stack) - 1, -1, -1) if OPEN_CLOSE.get(stack[k][0]) == c), None)
        if closing is not None and not (c == "“" and stack[closing][0] != "„"):
            found.append((stack[closing][1], at))
            del stack[closing:]
        elif c in OPEN_CLOSE:
            stack.append((c, at))
    return found



# Scores of a closing class with an opening class, in nats. A closing class tells what stands before the mark, an opening
# class what stands after it; OTHERWISE holds for the opening classes that a row does not name.
OTHERWISE = "*"
JOINT = {
    "strong": {"particle": -20.0, OTHERWISE: 9.0},
    "shout": {"lower": -9.0, "glued lower": -9.0, "glued": -9.0, OTHERWISE: 8.0},
    "ellipsis": {OTHERWISE: -20.0},
    "word": {"lower": -9.0, "glued script": -9.0, "glued lower": -9.0, "glued": -9.0, "glued quote": 1.0, "glued upper": 4.4, "upper": 4.4, OTHERWISE: 4.0},
    "abbreviation": {OTHERWISE: -9.0},
    "before number": {"lower": -9.0, "glued script": -9.0, "digit": -9.0, "glued lower": -9.0, "glued": -9.0, OTHERWISE: 4.0},
    "either": {"lower": -9.0, "glued script": -9.0, "digit": -1.0, "glued lower": -9.0, "glued": -9.0, OTHERWISE: 3.0},
    "initial": {OTHERWISE: -9.0},
    "dotted": {"lower": -9.0, "glued script": -9.0, "glued lower": -9.0, "glued": -9.0, "glued quote": 0.0, OTHERWISE: -1.5},
    "ordinal": {OTHERWISE: -9.0},
    "short before Devanagari": {OTHERWISE: -9.0},
    "blank": {OTHERWISE: 9.0},
}
CUT_PAIR = -7.0  # for each of the two spans that share a pair of quotes or brackets
FOREIGN_QUOTE = -9.0  # ends with a quotation that it did not open with
LENGTH_WEIGHT = 0.15
LENGTH_LEAST = -4.5
FLOOR = 2e-6
LEAST = 3


class Statistics(NamedTuple):
    """Of the corpus: mean and spread of the log of the length by script, and what words say of a boundary beside them."""

    lengths: dict[str, tuple[float, float]]
    closing: dict[str, float]
    opening: dict[str, float]


PRIOR = Statistics({"spaced": (4.3, 0.65), "blankless": (3.4, 0.65)}, {}, {})


def _script(text: str) -> str:
    return "blankless" if BLANKLESS.search(text) else "spaced"


def _length_score(size: int, law: tuple[float, float]) -> float:
    z = (math.log(max(1, size)) - law[0]) / law[1]
    return max(LENGTH_LEAST, -LENGTH_WEIGHT * z * z)


def _opening(text: str, after: int) -> tuple[str, str, int]:
    """(opening class, opening word, where it starts) of what follows a mark and its closers."""
    size = len(text)
    nxt = after
    while nxt < size and text[nxt].isspace():
        nxt += 1
    blank = nxt > after
    c = text[nxt] if nxt < size else ""
    k = nxt
    while k < size and not text[k].isalnum() and text[k] in "“„«\"‘'¿¡([「":
        k += 1
    if k < size and text[k].isspace() and k > nxt:
        while k < size and text[k].isspace():
            k += 1
    first = text[k] if k < size else ""
    word = NEXT_WORD.match(text, k)
    opening = word.group() if word else ""
    lower = first.islower() and opening == opening.lower()
    if not blank and c == "と":
        return "particle", c, nxt
    if not blank:
        kind = "glued lower" if lower else "glued upper" if first.isupper() and c == first else "glued quote" if c in "“„«\"¿¡" and c else "glued script" if not first.isascii() else "glued"
    else:
        kind = "lower" if lower else "upper" if first.isupper() else "digit" if first.isdigit() else "Devanagari" if DEVANAGARI.match(first) else "other"
    return kind, opening, nxt


def _closing(text: str, start: int, stop: int, after: int, opening: str, danda: bool) -> tuple[str, str]:
    """(closing class, closing word) before a mark text[start:stop] with closers up to ``after``."""
    mark = text[start:stop]
    if "…" in mark or mark.count(".") > 1 and not ("!" in mark or "?" in mark):
        return "ellipsis", ""
    if any(c in "。！？।" for c in mark):
        return "strong", ""
    if "!" in mark or "?" in mark:
        return "shout", ""
    before = LAST_WORD.search(text, max(0, start - 40), start)
    closing = before.group() if before else ""
    joined = JOINED.search(closing)  # the word before may lack its blank
    closing = (joined[1] if joined else closing).lower()
    if closing in NEVER_FINAL:
        return "abbreviation", closing
    if opening.startswith("glued"):
        previous = text[after - 1] if after > stop else (text[start - 1] if start else "")
        ends = previous.islower() or previous.isdigit() or previous in CLOSERS or previous == "%"
        # a missing blank joins nothing: an ordinary word before, a capital or a quotation after
        return ("word" if len(closing) > 1 and (opening == "glued quote" or ends and "." not in closing) else "initial"), closing
    if len(closing) == 1 and closing.isalpha():
        return "initial", closing
    if opening == "Devanagari" and (danda or len(closing) <= 3):
        return "short before Devanagari", closing
    if closing in BEFORE_NUMBER:
        return "before number", closing
    if closing in MAYBE_FINAL:
        return "either", closing
    if "." in closing and not closing[-1].isdigit() and len(closing) <= 6:
        return "dotted", closing
    if closing.isdigit() and len(closing) <= 2 and start > len(closing):
        lead = LAST_WORD.search(text, max(0, start - 40), start - len(closing) - 1)
        if lead and lead.group().lower() in ORDINAL_LEAD:
            return "ordinal", closing
    return "word", closing


def _boundary(text: str, start: int, stop: int, after: int, danda: bool, known: Statistics) -> float:
    """Joint score of the closing word before a mark and the opening word after it."""
    opening, word, _ = _opening(text, after)
    closing, last = _closing(text, start, stop, after, opening, danda)
    row = JOINT[closing]
    score = row.get(opening, row[OTHERWISE])
    if last and closing not in ("abbreviation", "initial"):
        score += known.closing.get(last, 0.0)
    return score + known.opening.get(word, 0.0)


class _End(NamedTuple):
    at: int  # past the end of the span
    score: float
    opened: int  # place of the opener of the quotation that ends here, or -1
    cut: int  # pairs that the boundary cuts
    nxt: int  # where the next span starts


def _candidates(text: str, known: Statistics) -> list[_End]:
    size = len(text)
    pairs = _pairs(text)
    opener = {b: a for a, b in pairs}
    lefts, rights = sorted(a for a, _ in pairs), sorted(b for _, b in pairs)
    danda = "।" in text
    places: list[tuple[int, float, int]] = []
    for m in MARK.finditer(text):
        start, stop = m.span()
        after, opened = stop, -1
        while after < size:
            c = text[after]
            if after in opener and opener[after] < start:
                if c in "”»“\"」』›":
                    opened = opener[after]
                after += 1
            elif c.isspace() and after + 1 < size and text[after + 1] == "»" and after + 1 in opener and opener[after + 1] < start:
                opened = opener[after + 1]
                after += 2
            else:
                break
        if after < size:
            places.append((after, _boundary(text, start, stop, after, danda, known), opened))
    if HAS_THAI.search(text):
        places += [(m.start(), JOINT["blank"][OTHERWISE], -1) for m in THAI_BREAK.finditer(text)]
    places.sort()
    out = []
    closed = {opened for _, _, opened in places}
    for at, score, opened in [*places, (size, 0.0, -1)]:
        nxt = at
        while nxt < size and text[nxt].isspace():
            nxt += 1
        # no solution gains by a cut here: it can win the least length score at most, and what a quotation that starts here is spared
        if at < size and score - LENGTH_LEAST - (FOREIGN_QUOTE if nxt in closed else 0.0) < 0:
            continue
        cut = bisect_left(lefts, at) - bisect_left(rights, at) if at < size else 0
        out.append(_End(at, score, opened, cut, nxt))
    return out


def _certain(ends: list[_End], j: int, before: int, law: tuple[float, float]) -> bool:
    """Whether cutting at ends[j] raises the score of every solution that does not.

    It cuts no pair and ends no quotation. Cutting a span in two changes its length score by no less than the score of the
    parts that are shorter than the mean, and these are at least as long as the stretches to the nearest candidates.
    """
    e = ends[j]
    if e.cut or e.opened >= 0:
        return False
    loss = 0.0
    for size in (e.at - before, ends[j + 1].at - e.nxt):
        if math.log(max(1, size)) < law[0]:
            loss += _length_score(size, law)
    return e.score + loss > 0


def _paragraph(text: str, known: Statistics = PRIOR) -> list[tuple[int, int]]:
    """Spans (first, past the last) of one paragraph without outer blanks: the segmentation of the highest score."""
    ends = _candidates(text, known)
    if len(ends) == 1:
        return [(0, len(text))]
    law = known.lengths.get(_script(text), PRIOR.lengths["spaced"])
    best: list[tuple[float, int]] = [(0.0, -1)]
    firsts, cuts, place = [0], [0], {0: 0}
    low = far = 0  # the search starts at low; spans from before far all have the least length score
    beyond = math.exp(law[0] + law[1] * math.sqrt(-LENGTH_LEAST / LENGTH_WEIGHT))
    top_far = (float("-inf"), -1)
    for j, e in enumerate(ends, 1):
        while far < j and e.at - firsts[far] > beyond:
            value = best[far][0] + CUT_PAIR * cuts[far]
            if value > top_far[0]:
                top_far = (value, far)
            far += 1
        base = e.score + CUT_PAIR * e.cut
        foreign = FOREIGN_QUOTE if e.opened >= 0 else 0.0
        top = (top_far[0] + base + LENGTH_LEAST + foreign, top_far[1])
        own = place.get(e.opened, -1) if foreign else -1
        for i in (*((own,) if low <= own < far else ()), *range(far, j)):
            value = best[i][0] + CUT_PAIR * cuts[i] + base + _length_score(e.at - firsts[i], law)
            if foreign and firsts[i] != e.opened:
                value += foreign
            if value > top[0]:
                top = (value, i)
        best.append(top)
        firsts.append(e.nxt)
        cuts.append(e.cut)
        place[e.nxt] = j
        if j < len(ends) and _certain(ends, j - 1, firsts[j - 1], law):
            low = far = j
            top_far = (float("-inf"), -1)
    spans: list[tuple[int, int]] = []
    j = len(ends)
    while j > 0:
        i = best[j][1]
        spans.append((firsts[i], ends[j - 1].at))
        j = i
    return spans[::-1]


def spans(text: str | None, known: Statistics = PRIOR) -> list[tuple[int, int]]:
    """(start, length) of each unit in code points, in reading order."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    at = 0
    edges = [(m.start(), m.end()) for m in PARAGRAPH.finditer(text)] + [(len(text), len(text))]
    for stop, following in edges:
        part = text[at:stop]
        body = part.strip()
        if body:
            base = at + len(part) - len(part.lstrip())
            for a, b in _paragraph(body, known):
                piece = body[a:b]
                cut = len(piece) - len(piece.lstrip())
                length = len(piece.strip())
                if length:
                    out.append((base + a + cut, length))
        at = following
    return out


# ---- statistics of the corpus ---------------------------------------------------------------------------------------

INNER_DOT = re.compile(r"\.\s+(\S)")
AFTER_MARK = re.compile(r"[!?]\s+([^\W\d_]+)")
INNER_WORD = re.compile(r"(?<=[^\W\d_] )[^\W\d_]+(?![.\w])")


def _count(texts: Iterable[str], counts: dict[str, Counter]) -> None:
    """Adds to ``counts`` what is sure: ends and starts of paragraphs, and marks before a lower-case word; and words inside sentences."""
    ends, opens, goes, inside = (counts[k] for k in ("ends", "opens", "goes on", "inside"))
    for text in texts:
        for part in PARAGRAPH.split(text):
            body = part.strip()
            if not body:
                continue
            end = len(body.rstrip("\"'”’»)"))
            final = LAST_WORD.search(body, max(0, end - 41), end - 1) if body[end - 1 : end] == "." else None
            if final:
                ends[final[0].lower()] += 1
                start = NEXT_WORD.match(body)
                if start:
                    opens[start[0]] += 1
            for m in INNER_DOT.finditer(body):
                if m[1].islower() or m[1] in ",;":
                    word = LAST_WORD.search(body, max(0, m.start() - 40), m.start())
                    if word:
                        goes[word[0].lower()] += 1
            opens.update(AFTER_MARK.findall(body))
            inside.update(INNER_WORD.findall(body))


def fit_statistics(docs: DataFrame, text: str = "text", floor: float = FLOOR) -> Statistics:
    """Word and length statistics over all texts; counts are summed in the workers, frequent words come to the driver."""
    schema = "kind string, word string, n long, total double, squares double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: Counter() for k in ("ends", "opens", "goes on", "inside")}
        sizes: dict[str, list[float]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(k, w, n, 0.0, 0.0) for k, own in counts.items() for w, n in own.items()] + [("length", s, int(v[0]), v[1], v[2]) for s, v in sizes.items()]
            for own in counts.values():
                own.clear()
            sizes.clear()
            columns = list(zip(*rows)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()))], names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            _count(texts, counts)
            for t in texts:
                for part in PARAGRAPH.split(t):
                    body, at = part.strip(), 0
                    inner = [(m.start() + 1, m.end()) for m in STRONG_END.finditer(body)]
                    for end, following in [*inner, (len(body), 0)] if inner else ():  # a paragraph of one piece may be a heading
                        n = len(body[at:end].strip())
                        at = following
                        if n > 8:
                            v = sizes.setdefault(_script(body), [0.0, 0.0, 0.0])
                            x = math.log(n)
                            v[0], v[1], v[2] = v[0] + 1, v[1] + round(x, 3), v[2] + round(x * x, 3)
            if sum(map(len, counts.values())) > 300_000:
                yield flush()
        yield flush()

    found = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(run, schema).groupBy("kind", "word").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    totals = F.sum("n").over(Window.partitionBy("kind"))
    kept = found.withColumn("whole", totals).where((F.col("kind") == "length") | (F.col("n") >= F.greatest(F.lit(LEAST), floor * F.col("whole"))))
    lengths, counts = dict(PRIOR.lengths), {}
    for r in kept.collect():
        if r.kind == "length":
            mean = r.total / r.n
            lengths[r.word] = (round(mean, 2), round(max(0.4, math.sqrt(max(0.0, r.squares / r.n - mean * mean))), 2))
        else:
            counts.setdefault(r.kind, {})[r.word] = r.n
    ends, goes = counts.get("ends", {}), counts.get("goes on", {})
    opens, inside = counts.get("opens", {}), counts.get("inside", {})
    # a word that is often met without a full stop is no abbreviation, whatever stands in lower case after it
    closing = {w: min(0.5, max(-8.0, 2 * math.log((ends.get(w, 0) + inside.get(w, 0) + 1) / (goes.get(w, 0) + 1)))) for w in ends.keys() | goes.keys()}
    opening = {w: min(1.0, max(-1.0, 0.25 * math.log((opens.get(w, 0) + 1) / (inside.get(w, 0) + 1)))) for w in opens.keys() | inside.keys() if not w.islower()}
    return Statistics(lengths, closing, opening)


def sentence_units(docs: DataFrame, key: str = "doc_id", text: str = "text", known: Statistics | None = None) -> DataFrame:
    """One row per unit: key, start_pos, n_chars. Without ``known`` the statistics are those of ``docs``.

    The cutting shuffles nothing: each document is cut where it is read.
    """
    schema = docs.select(key, F.lit(0).cast("long").alias("start_pos"), F.lit(0).cast("long").alias("n_chars")).schema
    sent = docs.sparkSession.sparkContext.broadcast(known or fit_statistics(docs, text))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, statistics = None, sent.value
        for batch in batches:
            ids, starts, sizes = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, n in spans(t, statistics):
                    ids.append(k)
                    starts.append(a)
                    sizes.append(n)
            kinds = kinds or batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(ids, kinds), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=[key, "start_pos", "n_chars"])

    return docs.select(key, text).mapInArrow(cut, schema)
