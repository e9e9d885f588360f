"""Noise in text from scanned pages: divided words, misread characters, running heads and page numbers.

Input rows are (table_name, item_key, scan_key, page, text); the rows of a scan share scan_key, and a row without a page is
a whole scan whose pages follow each other in its text.

* Misread words: every distinct word is joined to the frequent words through an inverted list of character q-grams of its
  folded form; a boosted ranking, fitted on frequent words with simulated misreadings, takes the best replacement or none.
* Divided words: a boosted classifier of line pairs, fitted on simulated divisions and on compounds, tells a division mark
  from a hyphen of the word.
* Running heads: a boosted classifier of line pairs tells copies of one head, however imperfect, from other lines.

Word statistics cover all rows. What is sent to workers is bounded by construction: words that make up at least
``frequent`` of all words number at most 1 / ``frequent``. Null and blank texts give no rows. Repeated rows count once.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import boosting

FREQUENT = 1e-5
LEAST = 5  # occurrences that make a word a possible replacement
#: A capitalised word that differs by letters only is another name unless the true form is so many times as frequent (one added to both counts). Real near-equal names
#: stay below 12 at sf0.1; nouns there have 70 and more.
NAME_RATIO = 15
Q = 3

# What is read (left) for what was printed (right).
CONFUSIONS = [
    ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("@", "a"), ("@", "â"), ("0", "o"), ("0", "O"), ("5", "s"), ("5", "S"), ("$", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("8", "B"), ("3", "e"),
    ("f", "t"), ("c", "e"), ("c", "é"), ("c", "è"), ("e", "c"), ("b", "h"), ("h", "b"), ("l", "i"), ("i", "l"), ("I", "l"), ("l", "I"), ("B", "ß"), ("·", ""),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("ii", "ü"), ("u", "ii"), ("vv", "w"), ("h", "li"), ("n", "ri"), ("ri", "n"), ("rm", "nn"), ("nn", "rm"), ("li", "h"), ("tt", "ff"), ("fi", "ti"),
]
BY_READ: dict[str, list[str]] = {}
for _read, _printed in CONFUSIONS:
    BY_READ.setdefault(_read, []).append(_printed)

TOKEN = re.compile(r"[^\W_](?:[^\W_]|[@!|$·](?=[^\W\d_]))*(?:-[^\W\d_]+)*|(?<!\S)[@!|$](?=[a-zäöüß]{2})(?:[^\W_]|[@!|$·](?=[^\W\d_]))*")
DIVIDED = re.compile(r"([^\W_](?:[^\W_]|[@!|$·](?=[^\W\d_]))*)([-‐‑¬\xad])[ \t]*[\n\f]\s*([^\W_](?:[^\W_]|[@!|$·](?=[^\W\d_]))*)")
PLAIN = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*")
SPOILT = re.compile(r"[@!|$·](?=[^\W\d_])")
TAIL_ANY = re.compile(r"[-‐‑¬\xad][ \t]*(?:[\n\f]|$)")
TAIL = re.compile(r"([^\W_](?:[^\W_]|[@!|$·](?=[^\W\d_]))*)([-‐‑¬\xad])[ \t]*$")
MARKS = tuple("-‐‑¬\xad")


def _tail(line: str) -> re.Match | None:
    """The divided word that ends a line."""
    return TAIL.search(line) if line.rstrip(" \t").endswith(MARKS) else None


HEAD = re.compile(r"\s*([^\W_](?:[^\W_]|[@!|$·](?=[^\W\d_]))*)")
#: Words that are misread by their shape, whether a replacement is found or not.
BROKEN_WORD = re.compile(r"(?=(?:.*[a-zäöüß]){4})[^\W\d_]+(?:[\d@!|$·][^\W\d_]+)+|(?=(?:.*[a-zäöüß]){5})[^\W\d_]+[015@$]")
LETTER = re.compile(r"[^\W\d_]")
LINE = re.compile(r"[\n\f]")
_NUMBER = r"(?:\d{1,4}|[ivxlc]{1,6}\.?)"
PAGE_WORD = r"(?:p\s?\.|pp\s?\.|page|p a g e|seite|s e i t e|s\s?\.|página|pág\s?\.)"
PAGE = re.compile(rf"\s*(?:[-–—\[(]\s*)?(?:{PAGE_WORD}\s*)?{_NUMBER}(?:\s*(?:/|of|von|de|sur)\s*\d{{1,4}})?(?:\s*[-–—\])])?\s*", re.I)
_BESIDE = rf"(?:[-–—\[(]\s*\d{{1,4}}\s*[-–—\])]|{PAGE_WORD}\s*\d{{1,4}}(?:\s*(?:/|of|von)\s*\d{{1,4}})?|\d{{1,4}}(?:\s*(?:/|of|von)\s*\d{{1,4}})?|(?-i:[ivxlc]{{1,6}})\.)"
PAGE_START = re.compile(rf"^\s*{_BESIDE}(?:\s+|\s*[|•·]\s+)(?=\S)", re.I)
PAGE_END = re.compile(rf"(?:\s+|\s*[|•·]\s+){_BESIDE}\s*$", re.I)
#: Forms that are page numbers wherever they end or start a line that stands alone.
PAGE_SURE = re.compile(rf"(?:^|\s)(?:[-–—]\s*\d{{1,4}}\s*[-–—]|[\[(]\d{{1,4}}[\])]|{PAGE_WORD}\s*\d{{1,4}}(?:\s*(?:/|of|von)\s*\d{{1,4}})?|\d{{1,4}}\s*/\s*\d{{1,4}})\s*$|^\s*(?:[-–—]\s*\d{{1,4}}\s*[-–—]|[\[(]\d{{1,4}}[\])]|{PAGE_WORD}\s*\d{{1,4}})", re.I)
NUMBERED = re.compile(r"\d|[ivxlc]\.\s*$|^\s*[ivxlc]+\.\s")
CLOSED = re.compile(r"[.!?;:,]\s*$")

_SIGNS = str.maketrans({"1": "l", "!": "i", "|": "l", "@": "a", "0": "o", "5": "s", "$": "s", "9": "g", "6": "b", "8": "b", "3": "e", "·": ""})
_SINGLE = str.maketrans({"i": "l", "â": "a", "f": "t", "c": "e", "é": "e", "è": "e", "ß": "b", "h": "b", "ü": "u"})


def fold(word: str) -> str:
    """A form that is the same for a word and for most of its misreadings."""
    w = word.translate(_SIGNS).lower()
    for read, printed in (("rn", "m"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("rm", "nn")):
        w = w.replace(read, printed)
    return w.translate(_SINGLE).replace("ll", "u")


def misreading_cost(read: str, printed: str) -> tuple[float, float]:
    """(cost, edits that no known confusion explains) of reading ``printed`` as ``read``; a known confusion costs 0.25."""
    n, m = len(read), len(printed)
    far = (99.0, 99.0)
    best = [[far] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0.0, 0.0)
    for i in range(n + 1):
        for j in range(m + 1):
            cost, odd = best[i][j]
            if cost > 3:
                continue

            def put(a: int, b: int, c: float, o: float) -> None:
                if a <= n and b <= m and (c, o) < best[a][b]:
                    best[a][b] = (c, o)

            if i < n and j < m and read[i] == printed[j]:
                put(i + 1, j + 1, cost, odd)
            for size in (1, 2):
                if i + size <= n:
                    for p in BY_READ.get(read[i : i + size], ()):
                        if printed.startswith(p, j):
                            put(i + size, j + len(p), cost + 0.25, odd)
            if i < n and j < m:
                put(i + 1, j + 1, cost + 1, odd + 1)
            if i < n:
                put(i + 1, j, cost + 1, odd + 1)
            if j < m:
                put(i, j + 1, cost + 1, odd + 1)
    return best[n][m]


# ---- words ----------------------------------------------------------------------------------------------------------


def composed(text: str) -> str:
    """The text with letters and their marks composed, as words are looked up by letters."""
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def tokens(text: str) -> list[str]:
    return (TOKEN if SPOILT.search(text) else PLAIN).findall(text)


def words(text: str) -> list[str]:
    """Words and compounds of a text without the halves of divided words, over page ends too."""
    if TAIL_ANY.search(text) is None:
        return tokens(text)
    out, pending = [], 0
    for line in LINE.split(text):
        m = _tail(line)
        found = tokens(line[: m.start()] if m else line)
        if pending and line.strip():
            h = HEAD.match(line)
            if h and h[1][:1].islower():
                found, pending = tokens(line[h.end() : m.start() if m else len(line)]), 0
            else:
                pending -= 1
        if m:
            pending = 4
        out += found
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts; words without a letter or with fewer than three signs are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if len(w) > 2 and LETTER.search(w) and sum(map(str.isdigit, w)) < 3]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(words(composed(t)))
            if len(counts) > 500_000:
                yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _grams(word: str) -> tuple[list[str], list[str]]:
    """All q-grams of the folded, padded word, and disjoint ones: of these a single edit spoils at most one."""
    padded = "^" * (Q - 1) + fold(word) + "$" * (Q - 1)
    return sorted({padded[i : i + Q] for i in range(len(padded) - Q + 1)}), sorted({padded[i : i + Q] for i in range(0, len(padded) - Q + 1, Q)})


def _odd(word: str) -> int:
    return sum(not c.isalpha() and c != "-" for c in word)


def ranking_features(read: str, n_read: int, printed: str, n_printed: int, name: bool) -> list[float]:
    """``name``: the replacement is only met with a capital, so it may be a noun or a name; names of like frequency differ by what looks like misreading."""
    cost, odd = misreading_cost(read, printed)
    return [cost, odd, (n_printed + 1) / (n_read + 1), float(_odd(read)), float(len(printed)), float(name and not _odd(read))]


def fit_ranking(frequent: list[tuple[str, int]], seed: int = 5, sample: int = 1500) -> list:
    """Ranking fitted on at most ``sample`` frequent words: their simulated misreadings against pairs of real words."""
    draw = random.Random(seed)
    lower = {w for w, _ in frequent if w.islower()}
    plain = [(w, n) for w, n in frequent if w.isalpha() and len(w) >= 4]
    plain = draw.sample(plain, min(sample, len(plain)))
    x, y = [], []
    by_fold: dict[str, list[tuple[str, int]]] = {}
    for w, n in plain:
        name = w[0].isupper() and w.lower() not in lower
        by_fold.setdefault(fold(w)[:3], []).append((w, n))
        swaps = [(i, r, p) for r, p in CONFUSIONS if p for i in range(len(w)) if w.startswith(p, i)]
        for _ in range(2):
            if swaps:
                i, r, p = draw.choice(swaps)
                bad = w[:i] + r + w[i + len(p) :]
                if bad.lower() != w.lower():
                    shares = (0.0, 0.0005, 0.002, 0.01, 0.04)
                    m = max(1, int(n * draw.choice(shares + (0.08, 0.12, 0.2) if name or not r.isalpha() else shares)))
                    x.append(ranking_features(bad, m, w, n, name))
                    # a name that differs by letters only is another name where both are about as frequent
                    y.append(int(not (name and r.isalpha()) or n + 1 >= NAME_RATIO * (m + 1)))
    for group in by_fold.values():
        for a, n in group[:40]:
            for b, m in draw.sample(group, min(6, len(group))):
                name = b[0].isupper() and b.lower() not in lower
                if a != b:
                    features = ranking_features(a, n, b, m, name)
                    # frequent words hold misreadings too: no real pair is what known confusions explain and the other form outnumbers
                    if features[0] > 1.0 or features[1] or features[2] < NAME_RATIO:
                        x.append(features)
                        y.append(0)
    return boosting.fit(x, y)


def find_fixes(counts: DataFrame, ranking: list, lower: frozenset[str], least: int = LEAST) -> DataFrame:
    """(word, fix): distinct misread words with their replacement; ``lower`` are the frequent words in lower case."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, n, w.replace("-", "").isalpha() and n >= least, *_grams(w)) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["word", "n", "listed", "every", "some"])

    words_ = counts.mapInArrow(lists, "word string, n long, listed boolean, every array<string>, some array<string>")
    listed = words_.where("listed").select(F.col("word").alias("printed"), F.col("n").alias("n_printed"), "every", F.explode("every").alias("gram"))
    # a misreading spoils at most one of a word's disjoint grams, so of any two one is kept: the two rarest find every candidate
    common = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("lists"))
    probes = words_.select("word", F.explode("some").alias("gram")).join(common, "gram", "left").groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("lists", F.lit(0)).alias("lists"), "gram"))), 1, 2).alias("rare"))
    asked = words_.join(probes, "word").select("word", "n", "some", F.explode("rare.gram").alias("gram"))
    shares = F.size(F.array_intersect("some", "every")) >= F.size("some") - 1
    near = (F.col("n_printed") >= 4 * F.col("n")) & (F.col("word") != F.col("printed")) & (F.abs(F.length("word") - F.length("printed")) <= 2)
    pairs = asked.join(listed, "gram").where(near & shares).select("word", "n", "printed", "n_printed").distinct()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, n, p, m in zip(*(batch.column(k).to_pylist() for k in range(4))):
                features = ranking_features(w, n, p, m, p[0].isupper() and p.lower() not in lower)
                if w.lower() != p.lower():
                    score = boosting.probability(ranking, features)
                    if score >= 0.5:
                        out.append((w, p, score - features[0]))
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()))], names=["word", "fix", "score"])

    ranked = pairs.mapInArrow(rank, "word string, fix string, score double")
    return ranked.groupBy("word").agg(F.max_by("fix", F.struct("score", "fix")).alias("fix"))


# ---- line pairs -----------------------------------------------------------------------------------------------------


def division_features(left: str, mark: str, right: str, known: frozenset[str]) -> list[float]:
    joined, compound = left + right, f"{left}-{right}"
    low = lambda w: w in known or w.lower() in known or w.capitalize() in known
    return [
        float(mark in "¬\xad"), float(mark == "‐"), float(low(joined)), float(low(compound)), float(low(left)), float(low(right)),
        float(right[:1].islower()), float(any(map(str.isdigit, left)) or left.isupper() and len(left) <= 3), float(any(map(str.isdigit, right))), float(min(len(left), len(right))),
    ]


def fit_divisions(known: frozenset[str], seed: int = 9, sample: int = 1500) -> list:
    """Classifier fitted on at most ``sample`` words cut at simulated places against compounds with their own hyphen."""
    draw = random.Random(seed)
    ordered = sorted(known)
    single = [w for w in ordered if w.isalpha() and len(w) >= 5 and not w.isupper()]
    double = [w for w in ordered if "-" in w and all(p.isalpha() for p in w.split("-"))]
    x, y = [], []
    for w in draw.sample(single, min(sample, len(single))):
        at = draw.randint(2, len(w) - 2)
        seen = known if draw.random() < 0.8 else known - {w}
        x.append(division_features(w[:at], draw.choice("-----‐¬\xad"), w[at:], seen))
        y.append(1)
    for w in (double * 25)[:sample]:
        left, _, right = w.partition("-")
        x.append(division_features(left, draw.choice("------‐"), right, known if draw.random() < 0.95 else known - {w}))
        y.append(0)
    for a, b in zip(draw.sample(single, min(200, len(single))), draw.sample(single, min(200, len(single)))):
        x.append(division_features(a, "-", b, known))
        y.append(0)
    for k in range(100):  # codes keep their hyphen
        x.append(division_features(draw.choice(["KX", "AB", "T", "SN"]), "-", str(draw.randint(10, 9999)) + draw.choice(["", "A", "K"]), known))
        y.append(0)
    return boosting.fit(x, y)


def is_division(left: str, mark: str, right: str, known: frozenset[str], model: list) -> bool:
    if not LETTER.search(left[-1:]) or not LETTER.search(right[:1]):
        if mark not in "¬\xad":
            return False
    return boosting.probability(model, division_features(left, mark, right, known)) >= 0.5


def strip_page(line: str) -> tuple[str, bool]:
    """A line without a page number at its start or end, and whether there was one beside other matter."""
    if not NUMBERED.search(line):
        return line.strip(), False
    bare = PAGE_END.sub("", PAGE_START.sub("", line))
    return (bare.strip(), True) if bare.strip() and bare.strip() != line.strip() else (line.strip(), False)


def is_page_number(line: str) -> bool:
    return PAGE.fullmatch(line) is not None and (any(map(str.isdigit, line)) or line.strip().endswith("."))


SMALL = re.compile(r"(?:^|\s)[a-zß-öø-ÿ]")


def title_share(line: str) -> float:
    """Share of words that are capitalised, codes or separators."""
    parts = len(line.split())
    return 1 - len(SMALL.findall(line)) / parts if parts else 0.0


LABEL_VALUE = re.compile(r"[^:]{2,40}:\s*(?:[-+]?[\d.,]+(?:\s*\S{1,4})?|[A-Z]{1,4}-\d[\w-]*)\s*$|.*\s(?:EUR|USD|GBP|€|\$)\s?[\d.,]+\s*$")


def may_be_head(line: str) -> bool:
    return len(line) >= 4 and not line[0].islower() and line[-1] not in ".!?;:," and title_share(line) >= 0.4 and LETTER.search(line) is not None and LABEL_VALUE.match(line) is None


def head_key(line: str) -> str:
    return fold(re.sub(r"\s+", "", line))


def _edits(a: str, b: str, most: int) -> int:
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def copy_features(line: str, head: str, copies: int, pages: int) -> list[float]:
    """Line pair: a line and a recurring line of the same scan."""
    a, b = head_key(line), head_key(head)
    most = max(1, len(b) // 3)
    return [_edits(a, b, most) / max(1, len(b)), title_share(line), title_share(head), float(copies), copies / max(1, pages), float(len(b))]


def fit_copies(seed: int = 3) -> list:
    """Classifier of copies of a head, fitted on made-up heads with simulated misreadings against lines of another kind."""
    draw = random.Random(seed)
    syllables = ["ma", "re", "tol", "vin", "dar", "kes", "lo", "ter", "bun", "sil"]
    name = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(2, 4))).capitalize()
    x, y = [], []
    for _ in range(600):
        head = " ".join(name() for _ in range(draw.randint(2, 6)))
        copy = head
        for _ in range(draw.randint(0, 4)):
            r, p = draw.choice(CONFUSIONS)
            if p and p in copy:
                copy = copy.replace(p, r, 1)
        if draw.random() < 0.2:
            at = draw.randrange(len(copy))
            copy = copy[:at] + copy[at + 1 :]
        pages = draw.randint(2, 12)
        copies = draw.randint(2, pages)
        x.append(copy_features(copy, head, copies, pages))
        y.append(1)
        other = " ".join(name() for _ in range(draw.randint(2, 6)))
        x.append(copy_features(other, head, copies, pages))
        y.append(0)
        body = " ".join(name().lower() if draw.random() < 0.75 else name() for _ in range(draw.randint(3, 9)))
        x.append(copy_features(body, body if draw.random() < 0.3 else head, copies, pages))
        y.append(0)
    return boosting.fit(x, y, rounds=30)


# ---- one pass over the texts ----------------------------------------------------------------------------------------


def furniture(lines: list[str], copies: list) -> dict[int, str]:
    """Line number -> head text, for the running heads of a whole scan in one text."""
    marked = {k: strip_page(ln)[0] for k, ln in enumerate(lines) if ln.strip() and not ln.lstrip()[0].islower()}
    possible = {k: b for k, b in marked.items() if may_be_head(b)}
    times = Counter(head_key(b) for b in possible.values())
    heads: dict[str, str] = {}
    for b in possible.values():
        if times[head_key(b)] >= 2:
            heads.setdefault(head_key(b), b)
    pages = max(times.values(), default=1)
    grams: dict[str, list[str]] = {}
    for h in heads:
        for g in {h[i : i + Q] for i in range(len(h) - Q + 1)}:
            grams.setdefault(g, []).append(h)
    order = {h: k for k, h in enumerate(heads)}
    out = {}
    for k, b in possible.items():
        key = head_key(b)
        if key in heads:
            out[k] = heads[key]
            continue
        # a copy that shares no q-gram with a head is spoilt throughout
        near = {h for i in range(len(key) - Q + 1) for h in grams.get(key[i : i + Q], ())}
        for h in sorted(near, key=order.get):
            if abs(len(key) - len(h)) <= len(h) // 3 and boosting.probability(copies, copy_features(b, heads[h], times[h], pages)) >= 0.5:
                out[k] = heads[h]
                break
    return out


def divisions(lines: list[str], skip: set[int], known: frozenset[str], model: list) -> list[tuple[int, int, str, str, str]]:
    """(line, next line, left, mark, right) of the words divided between a line and the next that is no page furniture."""
    out = []
    for k, line in enumerate(lines):
        if k in skip:
            continue
        m = _tail(line)
        if not m:
            continue
        n = k + 1
        while n < len(lines) and (n in skip or not lines[n].strip()):
            n += 1
        if n == len(lines):
            continue
        h = HEAD.match(lines[n])
        if h and is_division(m[1], m[2], h[1], known, model):
            out.append((k, n, m[1], m[2], h[1]))
    return out


def scan_texts(items: DataFrame, known: frozenset[str], division: list, copies: list) -> DataFrame:
    """One row for each finding or open question of a text.

    kind: hyphen_break, page_number, running_head (whole scans), rare (a word to look up; ``alone`` if its shape alone tells that it is misread) and line (a possible head of a
    scan that is spread over rows, or numbered with a number beside it; ``detail`` is the line, ``alone`` whether its row has little else).
    """
    schema = "table_name string, item_key string, scan_key string, page long, kind string, detail string, alone boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for table, key, scan, page, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                text = composed(text)
                lines = LINE.split(text)
                row = (table, key, scan, page)
                numbers = {k for k, ln in enumerate(lines) if is_page_number(ln)}
                heads: dict[int, str] = {}
                if page is None:
                    heads = furniture(lines, copies)
                    if heads:
                        out.append((*row, "running_head", None, False))
                else:
                    filled = [k for k, ln in enumerate(lines) if ln.strip() and k not in numbers]
                    alone = len(filled) <= 3 and sum(len(lines[k]) for k in filled) <= 200
                    for k in filled:
                        if not alone and lines[k].lstrip()[0].islower():
                            continue
                        bare, numbered = strip_page(lines[k])
                        if may_be_head(bare) or alone and len(bare) >= 4 and not CLOSED.search(bare) and LABEL_VALUE.match(bare) is None:
                            out.append((*row, "numbered" if numbered else "line", bare, alone))
                            heads[k] = bare  # taken out below only for words divided over a page end
                    if alone and any(strip_page(lines[k])[1] and PAGE_SURE.search(lines[k]) for k in heads):
                        numbers = numbers or {-1}
                if numbers or page is None and any(strip_page(lines[k])[1] for k in heads):
                    out.append((*row, "page_number", None, False))
                own: set[str] = set()
                if TAIL_ANY.search(text):
                    cut = divisions(lines, numbers | set(heads), known, division)
                    if page is not None:
                        cut += divisions(lines, numbers, known, division)
                    if cut:
                        out.append((*row, "hyphen_break", None, False))
                    own = {left + right for _, _, left, _, right in cut}
                own.update(words(text))
                for w in own - known:
                    if len(w) > 2 and LETTER.search(w) and sum(map(str.isdigit, w)) < 3:
                        out.append((*row, "rare", w, BROKEN_WORD.fullmatch(w) is not None))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return items.select("table_name", "item_key", "scan_key", F.col("page").cast("long"), "text").mapInArrow(run, schema)


def spread_heads(lines: DataFrame, copies: list) -> DataFrame:
    """(table_name, item_key, kind, detail) of lines that copy a head of their scan.

    A head is a line that stands alone on at least one page and recurs, folded, on two or more. Near copies share its first
    or its last signs with it, so that only such pairs of a scan are compared.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [head_key(t) for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(7)), pa.array(keys, pa.string())], names=["table_name", "item_key", "scan_key", "page", "detail", "alone", "kind", "key"])

    keyed = lines.select("table_name", "item_key", "scan_key", "page", "detail", "alone", "kind").mapInArrow(blocks, "table_name string, item_key string, scan_key string, page long, detail string, alone boolean, kind string, key string")
    grouped = keyed.groupBy("scan_key", "key").agg(F.count_distinct("page").alias("pages"), F.max(F.col("alone").cast("int")).alias("alone"), F.min("detail").alias("head"), F.max("page").alias("last"))
    heads = grouped.where("pages >= 2 and alone = 1").select("scan_key", F.col("key").alias("head_key"), "head", "pages", "last")
    both = lambda c: F.array(F.concat(F.lit("<"), F.substring(c, 1, 4)), F.concat(F.lit(">"), F.substring(c, -4, 4)))
    left = keyed.withColumn("block", F.explode(both("key")))
    right = heads.withColumn("block", F.explode(both("head_key")))
    pairs = left.join(right, ["scan_key", "block"]).where(F.abs(F.length("key") - F.length("head_key")) * 3 <= F.length("head_key"))
    exact = pairs.where("key = head_key").select("table_name", "item_key", "kind", "detail")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [boosting.probability(copies, copy_features(a, h, n, max(n, last or n))) >= 0.5 for a, h, n, last in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6)))]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(k) for k in range(4)], names=["table_name", "item_key", "kind", "detail"])

    near = pairs.where("key <> head_key").select("table_name", "item_key", "kind", "detail", "head", "pages", "last").mapInArrow(judge, "table_name string, item_key string, kind string, detail string")
    return exact.unionByName(near).dropDuplicates()


class Models:
    """What the passes over the texts need: fixes stay a table, the rest is bounded and goes to the workers."""

    def __init__(self, items: DataFrame, frequent: float = FREQUENT, least: int = LEAST):
        from docloom.session import cut_lineage

        counts = cut_lineage(count_words(items))
        total = counts.agg(F.sum("n")).first()[0] or 0
        floor = max(least, frequent * total)
        common = [(r.word, r.n) for r in counts.where(F.col("n") >= floor).collect()]  # at most 1 / frequent words
        self.ranking = fit_ranking(sorted(common))
        self.fixes = cut_lineage(find_fixes(counts, self.ranking, frozenset(w for w, _ in common if w.islower()), least))
        # the frequent words that are misread are again at most 1 / frequent
        wrong = {r.word for r in self.fixes.join(counts, "word").where(F.col("n") >= floor).select("word").collect()}
        self.known = frozenset(w for w, _ in common if w not in wrong)
        self.division = fit_divisions(self.known)
        self.copies = fit_copies()


def scan_items(documents: DataFrame, zones: DataFrame) -> DataFrame:
    """The rows of both tables as (table_name, item_key, scan_key, page, text)."""
    whole = documents.where("source = 'scan'").select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("item_key"), F.col("doc_id").cast("string").alias("scan_key"), F.lit(None).cast("long").alias("page"), "text")
    parts = zones.select(F.lit("medcore_text_gt_flat").alias("table_name"), F.col("id").alias("item_key"), F.coalesce("doc_name", "id").alias("scan_key"), F.coalesce(F.col("page").cast("long"), F.lit(0)).alias("page"), F.col("gt_text").alias("text"))
    return whole.unionByName(parts).where(F.trim("text") != "")


def find_noise(items: DataFrame, models: Models) -> DataFrame:
    """Distinct (table_name, item_key, noise)."""
    from docloom.session import cut_lineage

    found = cut_lineage(scan_texts(items, models.known, models.division, models.copies))
    direct = found.where(F.col("kind").isin("hyphen_break", "page_number", "running_head")).select("table_name", "item_key", F.col("kind").alias("noise"))
    rare = found.where("kind = 'rare'").select("table_name", "item_key", F.col("detail").alias("word"))
    misread = rare.join(models.fixes, "word").select("table_name", "item_key", F.lit("misread").alias("noise"))
    misread = misread.unionByName(found.where("kind = 'rare' and alone").select("table_name", "item_key", F.lit("misread").alias("noise")))
    heads = spread_heads(found.where("kind in ('line', 'numbered')"), models.copies)
    spread = heads.select("table_name", "item_key", F.explode(F.when(F.col("kind") == "numbered", F.array(F.lit("running_head"), F.lit("page_number"))).otherwise(F.array(F.lit("running_head")))).alias("noise"))
    return direct.unionByName(misread).unionByName(spread).dropDuplicates()


def repair_text(text: str, heads: frozenset[str], fixes: dict[str, str], whole: bool, known: frozenset[str], division: list, copies: list) -> str:
    """Continuous paragraphs without page furniture; hyphens, codes and numbers of the text are kept."""
    lines = LINE.split(text)
    drop = {k for k, ln in enumerate(lines) if is_page_number(ln)}
    if whole:
        drop |= set(furniture(lines, copies))
    elif heads:
        drop |= {k for k, ln in enumerate(lines) if strip_page(ln)[0] in heads}
    joins = {k: (n, left, right) for k, n, left, _, right in divisions(lines, drop, known, division)}
    paragraphs: list[list[str]] = [[]]
    glue = ""
    last = ""
    for k, line in enumerate(lines):
        if k in drop:
            continue
        bare = line.strip()
        if not bare:
            near = any(j in drop for j in (k - 1, k + 1))
            if not glue and not near and paragraphs[-1]:
                paragraphs.append([])
            continue
        # an indented line starts a paragraph where the line before has ended a sentence
        if not glue and line[:2].isspace() and paragraphs[-1] and CLOSED.search(last):
            paragraphs.append([])
        if glue:
            bare, glue = glue + bare, ""
        if k in joins:
            m = TAIL.search(bare)
            start = bare[: m.start()].rstrip()
            glue = m[1]
            bare = start
        elif TAIL.search(bare):  # a hyphen of the word itself
            m = TAIL.search(bare)
            glue = m[1] + "-"
            bare = bare[: m.start()].rstrip()
        if bare:
            paragraphs[-1].append(bare)
        last = line
    if glue:
        paragraphs[-1].append(glue)
    joined = "\n\n".join(" ".join(p) for p in paragraphs if p)
    return TOKEN.sub(lambda m: fixes.get(m[0], m[0]), joined) if fixes else joined


def repair(items: DataFrame, models: Models) -> DataFrame:
    """(table_name, item_key, repaired) of every item with a text."""
    from docloom.session import cut_lineage

    found = cut_lineage(scan_texts(items, models.known, models.division, models.copies))
    own = ["table_name", "item_key"]
    heads = spread_heads(found.where("kind in ('line', 'numbered')"), models.copies).groupBy(*own).agg(F.collect_set("detail").alias("heads"))
    rare = found.where("kind = 'rare'").select(*own, F.col("detail").alias("word")).join(models.fixes, "word").groupBy(*own).agg(F.map_from_entries(F.collect_set(F.struct("word", "fix"))).alias("fixes"))
    known, division, copies = models.known, models.division, models.copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                repair_text(composed(t), frozenset(h or ()), dict(f or ()), page is None, known, division, copies) for page, t, h, f in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["table_name", "item_key", "repaired"])

    once = items.select(*own, F.col("page").cast("long").alias("page"), "text").dropDuplicates([*own, "text"])
    joined = once.join(heads, own, "left").join(rare, own, "left")
    return joined.mapInArrow(run, "table_name string, item_key string, repaired string")
