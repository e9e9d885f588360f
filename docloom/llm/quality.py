"""Per-document text statistics and the form of a text: prose, list, table or junk.

Every line is turned into a distribution over token classes (function words, other words, numbers, codes, item evidence, cell
separators, unreadable tokens). Item evidence is an item mark, or a label with its value, a short entry or a piece of an
itemised run where most of the text is made of such; repeated matter and page navigation count as unreadable. The line's form
is the profile with the least Jensen-Shannon divergence: the prose profile of the text's language or the structural profile
of lists, tables or junk. The text has the form that most of its characters take; nothing overrides the nearest profiles.

Prose profiles are averaged over all running text. Structural profiles start from PROFILES and are fitted to all texts: each
line goes to its nearest profile, and each profile becomes the mean of its lines, with PROFILES counting as ``PRIOR`` of them.

A null text gives no row, a blank one is junk. Repeated rows give one row for each key and text. Ties go to prose, then
list, table, junk. Whole texts are read, however long; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("prose", "list", "table", "junk")
CLASSES = ("function", "word", "number", "code", "mark", "cell", "bad")

# Common function words by language; single characters for scripts without blanks.
COMMON = {
    "en": "the of and to in is a an that for on with as by it this each every our at from be are was were or which not no has have its new former single because under all after before do does if when while we you they there their but into than then so can will must only any more",
    "de": "der die das den dem des und oder ist im in zu von mit für auf ein eine einen einem einer es wird werden nicht am bei nach vor seit aus an als sich dass wer gegen ohne jede während wie auch sind war hat sie durch innerhalb außerhalb",
    "fr": "le la les un une des de du et ou est en dans pour sur avec par que qui ne pas à au aux ce cette se sans selon il elle après avant pendant depuis chaque sont plus son sa ses hors",
    "es": "el la los las un una de del y o es en para con por que no se a al su sus lo como antes durante después según sin cada ha son fuera más este esta",
    "hi": "का की के में है हैं को से पर और यह वह एक ने हर भी नहीं था थी हो कर करता करती लिए बाद पहले",
    "zh": "的了在是和与不而为有由之以及从对个次后前",
    "ja": "のはがをにでとものですますしたてる",
}
COMMON_THAI = re.compile("ที่|ของ|และ|ใน|เป็น|การ|ไม่|มี|ให้|ได้|จาก|กับ|หรือ|เมื่อ|หลัง|ก่อน|โดย|ตาม|คือ|ใคร")
WORDS = {lang: frozenset(v.split()) for lang, v in COMMON.items() if lang not in ("zh", "ja")}
SIGNS = {"zh": frozenset(COMMON["zh"]), "ja": frozenset(COMMON["ja"]), "th": frozenset()}
ANY_WORD = frozenset().union(*WORDS.values())
# Words of page navigation.
NAVIGATION = frozenset("home menu login logout next back top print share cookies ok cart previous search sitemap close << >> (0) > < | more".split())

BLANKLESS = re.compile(r"[฀-๿぀-ヿ一-鿿]")
KANA = re.compile(r"[぀-ヿ]")
HAN = re.compile(r"[一-鿿]")
THAI = re.compile(r"[฀-๿]")
DEVANAGARI = re.compile(r"[ऀ-ॿ]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
MARKER = re.compile(r"\s*(?:[•●▪▫■◦‣∙·*+\-–—]\s+|\(?(?:\d{1,4}[.)]|[a-z][.)]|[A-Z]\)|[ivx]{1,5}[.)]|[IVX]{1,5}[.)])\s+|\d{2,4}\s(?=[^\W\d])|\[[ xX]?\]\s+)(?=\S)")
LABEL = re.compile(r"\s*[^\s:|][^:|.!?]{0,48}?\s?[:：]\s+(?=\S)")
PAGE_LINE = re.compile(r"\s*[-–—]?\s*(?:p(?:age|\.)?\s*)?\d+(?:\s*(?:/|of|von)\s*\d+)?\s*[-–—]?\s*", re.I)
CELLS = re.compile(r"\s*(?<!\|)\|(?!\|)\s*|\t|;(?=\S)|(?<=\S) {3,}(?=\S)|</t[dh]>|\s=\s")
TAGS = re.compile(r"</?(?:table|tr|td|th|tbody|thead)\b[^>]*>", re.I)
NUMBER = re.compile(r"[-+−±]?[\d.,:/%]*\d[\d.,:/%]*(?:[a-zA-Zµ°%]{1,3})?")
CODE = re.compile(r"[A-Z]{1,4}-?\d[\dA-Z\-]*|\(?[A-Z]{2}-\d{3,5}(?:-\w{1,2})?\)?")
VOWEL = re.compile(r"[aeiouyáàâäãåéèêëíìîïóòôöõúùûüýæœøAEIOUYÁÀÂÄÉÈÊËÍÎÏÓÔÖÚÙÛÜÆŒ]")
LATIN = re.compile(r"[A-Za-z]")
REPEATED = re.compile(r"([^\d\s.])\1{3}|(\d)\2{6}")
SIGN = re.compile(r"[\\^~<>{}\[\]$@#=|+/]")
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-\u0900-\u0e7f]|_")
SENTENCE = re.compile(r"[.!?।][\"'”’»“)]*\s|[。！？]")
BROKEN = re.compile(r"[\ufffd¤¶¼½¾©®¬¢Ââ€œÃ]")
EDGE = "\"'“”„«»‘’()[]{}.,;:!?…¡¿。、，！？「」『』।"
END_MARKS = frozenset(".!?…。！？।:;")
AFTER_END = "\"'”’»“)」』"

# Structural profiles over CLASSES from which the fit starts.
PROFILES = {
    "list": (0.04, 0.40, 0.06, 0.06, 0.44, 0.00, 0.00),
    "table": (0.02, 0.22, 0.18, 0.10, 0.00, 0.48, 0.00),
    "junk": (0.01, 0.10, 0.05, 0.02, 0.00, 0.00, 0.82),
}
DEFAULT_PROSE = (0.36, 0.58, 0.03, 0.02, 0.00, 0.00, 0.01)
LEVELS = 12  # steps of a share in the fit
PRIOR = 0.25  # weight of PROFILES against the lines of the fit


class Profiles(NamedTuple):
    prose: dict[str, tuple[float, ...]]
    structure: tuple[tuple[float, ...], ...]  # list, table, junk


UNFITTED = Profiles({}, tuple(PROFILES[k] for k in KINDS[1:]))


def _ended(line: str) -> bool:
    """Whether a line ends in punctuation, perhaps within quotes or brackets."""
    return line.rstrip().rstrip(AFTER_END)[-1:] in END_MARKS and line.strip() != ""


def language(text: str, common: list[str]) -> str:
    """Script, or for Latin letters the language with most of the function words ``common``."""
    if not text.isascii() and BLANKLESS.search(text):
        if KANA.search(text):
            return "ja"
        thai, han = len(THAI.findall(text)), len(HAN.findall(text))
        if 3 * (thai + han) > sum(map(str.isalpha, text)):
            return "th" if thai > han else "zh"
    if not text.isascii() and DEVANAGARI.search(text):
        return "hi"
    votes = {v: sum(map(WORDS[v].__contains__, common)) for v in ("en", "de", "fr", "es")}
    return max(votes, key=votes.get) if any(votes.values()) else "en"


def _readable(token: str) -> bool:
    """A Latin word needs vowels, no broken characters and no case or digit salad; other scripts pass."""
    if BROKEN.search(token) and not token.isalpha() or "\ufffd" in token or REPEATED.search(token):
        return False
    letters = LATIN.findall(token)
    if not letters:
        return True
    if len(token) > 28 and "-" not in token:
        return False
    if len(letters) >= 4 and not VOWEL.search(token) and not (token.isupper() and len(token) <= 5):
        return False
    if len(letters) >= 6 and len(VOWEL.findall(token)) * 7 < len(letters):
        return False
    return True


def _token(token: str) -> tuple[int, float]:
    """Place in CLASSES and weight of a token; an unreadable one weighs by its length. Place -1: nothing."""
    bare = token.strip(EDGE)
    if not bare:
        return (6, 1.0) if len(token) > 2 else (-1, 0.0)
    if bare.lower() in ANY_WORD:
        return 0, 1.0
    if REPEATED.search(bare):
        return 6, 1 + len(bare) / 8
    if NUMBER.fullmatch(bare):
        return 2, 1.0
    if CODE.fullmatch(bare):
        return 3, 1.0
    alpha = sum(map(str.isalpha, bare))
    if not alpha:
        return (6, 1 + len(bare) / 8) if len(bare) > 1 else (-1, 0.0)
    if "-" not in bare and len(bare) >= 6 and any(map(str.isdigit, bare)):
        return 6, 1 + len(bare) / 8
    if SIGN.search(bare) and not bare.startswith("http") and alpha * 3 < len(bare) * 2:
        return 6, 1 + len(bare) / 8
    if not _readable(bare):
        return 6, 1 + len(bare) / 12
    return 1, 1.0


class _Seen(dict):
    """Classes of the tokens met by a worker; emptied when it has grown."""

    def __missing__(self, token: str) -> tuple[int, float]:
        if len(self) > 200_000:
            self.clear()
        value = self[token] = _token(token)
        return value


_seen = _Seen()


def _common_signs(blankless: list[str], text: str, lang: str) -> int:
    """Characters that are, or in Thai belong to, function words."""
    return sum(map(len, COMMON_THAI.findall(text))) if lang == "th" else sum(map(SIGNS[lang].__contains__, blankless))


def _classes(line: str, lang: str) -> list[float]:
    """Weight of each of CLASSES in a line: item marks and cell separators are counted, what remains is cut at blanks."""
    out = [0.0] * 7
    m = MARKER.match(line)
    if m and not PAGE_LINE.fullmatch(line):
        out[4], line = 1.0, line[m.end() :]
    cells = CELLS.findall(line) if "|" in line or "\t" in line or "   " in line or ";" in line or "=" in line or "</t" in line else ()
    if len(cells) >= 2 or len(cells) == 1 and ("\t" in cells[0] or "|" in cells[0]):
        out[5] = float(len(cells))
        line = CELLS.sub(" ", TAGS.sub(" ", line))
    signs = SIGNS.get(lang)
    if signs is not None:
        blankless = BLANKLESS.findall(line)
        out[0] = float(_common_signs(blankless, line, lang))
        out[1] = len(blankless) - out[0]
        line = BLANKLESS.sub(" ", line)
    for place, weight in map(_seen.__getitem__, line.split()):
        if place >= 0:
            out[place] += weight
    return out


def divergence(p: tuple[float, ...], q: tuple[float, ...]) -> float:
    """Jensen-Shannon divergence in bits."""
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        if a:
            total += a * math.log2(a / m)
        if b:
            total += b * math.log2(b / m)
    return total / 2


def _shares(counts: list[float]) -> tuple[float, ...] | None:
    """Distribution of the evidence; item evidence and cell separators weigh about as much as the tokens of their line."""
    function, word, number, code, mark, cell, bad = counts
    plain = function + word + number + code + bad
    if mark:
        mark = max(1.0, plain * 0.8)
    if cell:
        cell = max(cell, plain * 0.9)
    whole = plain + mark + cell
    return (function / whole, word / whole, number / whole, code / whole, mark / whole, cell / whole, bad / whole) if whole else None


def _nearest(p: tuple[float, ...], prose: tuple[float, ...], structure: tuple[tuple[float, ...], ...]) -> tuple[int, float]:
    """Place in KINDS of the nearest profile and the divergence to prose."""
    to_prose = divergence(p, prose)
    best, least = 0, to_prose
    for k, profile in enumerate(structure, 1):
        d = divergence(p, profile)
        if d < least:
            best, least = k, d
    return best, to_prose


@lru_cache(maxsize=100_000)
def _form(counts: tuple[float, ...], prose: tuple[float, ...], structure: tuple[tuple[float, ...], ...]) -> tuple[int, float]:
    p = _shares(counts)
    return (3, 1.0) if p is None else _nearest(p, prose, structure)


@lru_cache(maxsize=100_000)
def _levels(counts: tuple[float, ...]) -> str:
    """The distribution in steps of 1 / LEVELS; empty for a line without evidence."""
    p = _shares(counts)
    return "" if p is None else " ".join(str(round(x * LEVELS)) for x in p)


def _entry(line: str, counts: list[float]) -> bool:
    """A label with its value, or a short entry with a code or number, and no sentence."""
    if LABEL.match(line) and not SENTENCE.search(line):
        return True
    return bool(counts[3] or counts[2]) and counts[0] <= 0.25 * sum(counts) + 0.5 and not _ended(line) and len(line.split()) <= 8


def _runs(text: str) -> tuple[list[str], str]:
    """Pieces of an itemised run: the separator that cuts it into the most short pieces."""
    best: tuple[list[str], str] = ([], "")
    for sep in (", ", "; ", "、", "，", " / ", " • ", " · "):
        if text.count(sep) >= 6:
            pieces = [p.strip(" .") for p in text.replace("\n", " ").split(sep)]
            if len(pieces) > len(best[0]):
                best = (pieces, sep)
    return best


def evidence(lines: list[str], text: str, lang: str, spaced: list[str]) -> list[list[float]]:
    """Weights of CLASSES for each line, given the text around it; ``spaced`` are its tokens between blanks, in lower case."""
    counts = [_classes(line, lang) for line in lines]
    marked = sum(c[4] > 0 for c in counts)
    if marked < 2:  # one marked line is an initial, a year or a page number
        for c in counts:
            c[4] = 0.0
        marked = 0
    # label-value lines, lines of an entry with its code and short lines without any sentence are items where most lines are such
    free = [not c[4] and not c[5] and (2 * c[6] < sum(c) if c[6] else any(c)) for c in counts]
    many = marked + len(lines) >= 4  # fewer lines make no list
    single = [many and f and len(line) <= 90 and _entry(line, c) for f, line, c in zip(free, lines, counts)]
    bare = [many and f and len(line) <= 60 and not c[0] and not _ended(line) for f, line, c in zip(free, lines, counts)]
    strong, weak = marked + sum(single), marked + sum(a or b for a, b in zip(single, bare))
    entries = strong >= 4 and 2 * strong >= len(lines) or weak >= 5 and weak >= 0.8 * len(lines)
    inside = False
    for c, f, line, one, plain in zip(counts, free, lines, single, bare):
        if c[4]:
            inside = True
        elif f and (entries and (one or plain) or inside and 8 * marked >= len(lines) and (line[:1].isspace() or line[:1].islower())):
            c[4] = 1.0
        else:
            inside = False
    # an itemised run: its pieces are items
    pieces, _ = _runs(text)
    distinct = len(set(pieces))
    if len(pieces) >= 7 and distinct > 0.2 * len(pieces) and sum(map(len, pieces)) <= 45 * len(pieces) and len(SENTENCE.findall(text)) <= 1 + 0.05 * len(pieces):
        if sum(len(line) for f, line in zip(free, lines) if f) >= sum(len(line) for c, line in zip(counts, lines) if c[5]):
            for f, c in zip(free, counts):
                if f:
                    c[4] = 1.0
    # page navigation and repeated matter say nothing
    idle = len(spaced) >= 6 and sum(map(NAVIGATION.__contains__, spaced)) >= 0.6 * len(spaced)
    idle = idle or len(pieces) >= 7 and distinct <= 0.2 * len(pieces)
    idle = idle or not marked and (len(spaced) >= 20 and len(set(spaced)) <= max(4, 0.03 * len(spaced)) or len(lines) >= 7 and len(set(lines)) <= 0.2 * len(lines))
    if idle:
        counts = [[0.0] * 6 + [max(1.0, sum(c))] for c in counts]
    return counts


def analyse(text: str, profiles: Profiles = UNFITTED) -> tuple:
    """(n_words, mean_word_length, symbol_ratio, punct_line_share, common_word_share, lang, prose_divergence, kind)."""
    lowered = text.lower()
    tokens = WORD.findall(lowered)
    known = list(filter(ANY_WORD.__contains__, tokens))
    lang = language(text, known)
    prose = profiles.prose.get(lang, DEFAULT_PROSE)
    signs = SIGNS.get(lang)
    blankless = BLANKLESS.findall(text) if signs is not None else []
    spaced = (BLANKLESS.sub(" ", lowered) if blankless else lowered).split()
    n_words = len(blankless) + len(spaced)
    letters = len(blankless) + sum(map(len, spaced))
    symbols = len(SYMBOL.findall(text))
    lines = [ln for ln in text.split("\n") if ln.strip()]
    ended = sum(map(_ended, lines))
    common = (_common_signs(blankless, text, lang) if signs is not None else 0) + len(known)
    counted = len(blankless) + len(tokens)
    stats = (n_words, letters / n_words if n_words else 0.0, symbols / len(text) if text else 0.0, ended / len(lines) if lines else 0.0, min(1.0, common / counted) if counted else 0.0, lang)
    if not lines:
        return (*stats, 1.0, "junk")
    whole = [0.0] * len(CLASSES)
    weight = [0] * len(KINDS)
    for line, counts in zip(lines, evidence(lines, text, lang, spaced)):
        weight[_form(tuple(counts), prose, profiles.structure)[0]] += len(line)
        whole = [a + b for a, b in zip(whole, counts)]
    return (*stats, _form(tuple(whole), prose, profiles.structure)[1], KINDS[weight.index(max(weight))])


#: Token weights are multiples of 1 / WHOLE, so their sums don't depend on the order of rows.
WHOLE = 24


def fit_profiles(texts: DataFrame, running: Column, text: str = "text", rounds: int = 5) -> Profiles:
    """Profiles of all texts, in one pass. ``running`` tells which rows are running prose.

    The workers sum the token classes of running prose by language, and the characters of lines by language and by their
    distribution in steps of 1 / LEVELS, of which there are at most some ten thousand; both sums come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for t, prose in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lowered = t.lower()
                lang = language(t, list(filter(ANY_WORD.__contains__, lowered.split())))
                lines = [ln for ln in t.split("\n") if ln.strip()]
                spaced = (BLANKLESS.sub(" ", lowered) if lang in SIGNS else lowered).split()
                found = evidence(lines, t, lang, spaced)
                if prose:
                    for k in (0, 1, 2, 3, 6):
                        sums["prose", lang, str(k)] += round(sum(c[k] for c in found) * WHOLE)
                for line, counts in zip(lines, found):
                    place = _levels(tuple(counts))
                    if place:
                        sums["line", lang, place] += len(line)
            if len(sums) > 200_000:
                yield flush(sums)
        yield flush(sums)

    def flush(sums: Counter) -> pa.RecordBatch:
        columns = list(zip(*((*k, n) for k, n in sums.items()))) or [()] * 4
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["what", "lang", "place", "n"])

    given = texts.where(F.col(text).isNotNull()).select(text, F.coalesce(running, F.lit(False)).alias("running"))
    found = given.mapInArrow(run, "what string, lang string, place string, n long").groupBy("what", "lang", "place").agg(F.sum("n").alias("n")).collect()
    sums: dict[str, list[float]] = {}
    for r in found:
        if r.what == "prose":
            sums.setdefault(r.lang, [0.0] * len(CLASSES))[int(r.place)] = r.n / WHOLE
    prose = {lang: tuple((x + 0.2) / (sum(v) + 1.0) if k < 4 else x / (sum(v) + 1.0) for k, x in enumerate(v)) for lang, v in sums.items() if sum(v) >= 500}
    lines = []
    for r in sorted((r for r in found if r.what == "line"), key=lambda r: (r.lang, r.place)):
        levels = [int(x) for x in r.place.split(" ")]
        lines.append((tuple(x / sum(levels) for x in levels), prose.get(r.lang, DEFAULT_PROSE), r.n))
    return Profiles(prose, _structure(lines, rounds))


def _structure(lines: list[tuple[tuple[float, ...], tuple[float, ...], int]], rounds: int) -> tuple[tuple[float, ...], ...]:
    """Means of the lines nearest to each structural profile; lines are (distribution, prose profile of the language, weight)."""
    seeds = structure = UNFITTED.structure
    for _ in range(rounds):
        sums, sizes = [[0.0] * len(CLASSES) for _ in seeds], [0.0] * len(seeds)
        for p, prose, n in lines:
            k, _d = _nearest(p, prose, structure)
            if k:
                sizes[k - 1] += n
                sums[k - 1] = [a + n * x for a, x in zip(sums[k - 1], p)]
        fresh = tuple(tuple(PRIOR * x + (1 - PRIOR) * y / size for x, y in zip(seed, own)) if size else seed for seed, own, size in zip(seeds, sums, sizes))
        if fresh == structure:
            break
        structure = fresh
    return structure


COLUMNS = "n_words long, mean_word_length double, symbol_ratio double, punct_line_share double, common_word_share double, lang string, prose_divergence double, kind string"


def text_quality(texts: DataFrame, profiles: Profiles, key: str, text: str = "text") -> DataFrame:
    """key and the columns of COLUMNS for each row with a text; no shuffle."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *analyse(t, profiles)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = list(zip(*rows)) if rows else [()] * 9
            kinds = [batch.schema.field(0).type, pa.int64(), *[pa.float64()] * 4, pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[key, *(c.split()[0] for c in COLUMNS.split(", "))])

    return texts.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, {COLUMNS}")
