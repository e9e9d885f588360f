"""Text functions as Column expressions; all stay in whole-stage code. A null text gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The entity token pattern and its abbreviation expansions.
ENTITY = "[a-z0-9]+(?:[-_./:][a-z0-9]+)*"
ABBREVIATIONS = {
    "temp": "temperature", "max": "maximum", "min": "minimum", "volts": "voltage", "volt": "voltage", "v": "voltage",
    "dia": "diameter", "spec": "specification", "specs": "specification", "capac": "capacity",
}
# Question words and table words of the intent rule.
PROSE_SIGNALS = "what who why how where explain describe according stated which summary clause agreement".split()
TABLE_WORDS = ["table", "column", "row label", "cell value", "grid", "row 0", "column 1"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def entity_tokens(c: Column | str) -> Column:
    """distinct entity tokens in lower case with abbreviations expanded, sorted; empty for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(f"({ENTITY})"), 1)
    table, short = literal_map(ABBREVIATIONS), F.array(*[F.lit(k) for k in ABBREVIATIONS])
    whole = lambda f: F.array_sort(F.array_distinct(F.concat(f, F.transform(F.array_intersect(f, short), lambda t: table[t]))))
    return F.flatten(F.transform(F.array(found), whole))  # the text is cut once


def part_numbers(c: Column | str) -> Column:
    """F2: entity tokens with a digit and a letter, hyphen, underscore or point."""
    return F.filter(entity_tokens(c), lambda t: t.rlike("[0-9]") & t.rlike("[a-z_.-]"))


def alnum_tokens(c: Column | str) -> Column:
    """runs of ASCII letters and digits in lower case, duplicates kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def word_tokens(c: Column | str) -> Column:
    """runs of letters, digits and underscores of any script in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def token_count(c: Column | str) -> Column:
    """words cut at white space; 0 for null or blank."""
    return F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), "[ \t\n\r\f]+"), lambda t: t != ""))


def truncate_tokens(c: Column | str, n: int) -> Column:
    """the first n words, or the text unchanged if it has no more."""
    words = F.filter(F.split(col(c), "[ \t\n\r\f]+"), lambda t: t != "")
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(col(c))


def split_sentences(c: Column | str, least: int = 0) -> Column:
    """pieces after . ! ? and white space, trimmed, at least ``least`` characters long."""
    cut = F.regexp_replace(col(c), "([.!?])[ \t\n\r\f]+", "$1\u0001")
    return F.filter(F.transform(F.split(cut, "\u0001"), lambda s: F.trim(s)), lambda s: F.length(s) > max(0, least - 1))


def window_sentences(c: Column | str) -> Column:
    """Pieces after . ! ? and white space or between line breaks, trimmed, of more than five signs; empty for null."""
    cut = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), "([.!?])[ \t\n\r\f]+", "$1\u0001"), "\n+", "\u0001")
    return F.filter(F.transform(F.split(cut, "\u0001"), lambda s: F.trim(s)), lambda s: F.length(s) > 5)


def repair_hyphens(c: Column | str) -> Column:
    """F8: word halves around a hyphen and white space are joined."""
    return F.regexp_replace(col(c), "([A-Za-z0-9_]+)-[ \t\n\r\f]+([A-Za-z0-9_]+)", "$1$2")


def collapse_space(c: Column | str) -> Column:
    """F9."""
    return F.trim(F.regexp_replace(col(c), "[ \t\n\r\f]+", " "))


def normalize_ocr(c: Column | str) -> Column:
    """white space collapsed, lower case, punctuation kept."""
    return F.lower(collapse_space(c))


def normalize_key(c: Column | str) -> Column:
    """lower case without hyphen, underscore and blank."""
    return F.translate(F.lower(col(c)), "-_ ", "")


def document_slug(name: Column | str, content: Column | str) -> Column:
    """lower case, other characters to single underscores, at most 50 characters, and 8 digits of the content's hash."""
    base = F.regexp_replace(F.regexp_replace(F.lower(col(name)), "[^a-z0-9_]", "_"), "_+", "_")
    return F.concat(F.substring(F.regexp_replace(base, "^_|_$", ""), 1, 50), F.lit("_"), F.substring(F.sha2(col(content), 256), 1, 8))


def section_slug(c: Column | str) -> Column:
    """the first 30 signs in lower case, each other than letters and digits as an underscore, without outer ones; ``sec`` for nothing."""
    low = F.lower(F.regexp_replace(F.substring(F.coalesce(col(c), F.lit("")), 1, 30), "[^a-zA-Z0-9]", "_"))
    slug = F.regexp_replace(low, "^_+|_+$", "")
    return F.when(slug == "", "sec").otherwise(slug)


def chunk_name(stem: Column, strategy: Column, page: Column, seq: Column) -> Column:
    """F14."""
    return F.format_string("%s_%s_%d_%04d", stem, strategy, page, seq)


def heading_level(c: Column | str) -> Column:
    """depth of a leading number such as 2.1.3; 0 without one."""
    number = F.regexp_extract(col(c), r"^[ ]*([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(number == "", 0).otherwise(F.size(F.split(number, r"\.")))


def heading_depth(c: Column | str) -> Column:
    """Number of parts of a heading's numbering (2.1 or A.3 of several parts, or a number or up to three capitals alone); null without one."""
    prefix = F.regexp_extract(F.trim(col(c)), r"^([0-9a-zA-Z]+(?:\.[0-9a-zA-Z]+)*)[ \t\n]+", 1)
    parts = F.size(F.split(prefix, r"\."))
    return F.when((prefix != "") & ((parts > 1) | prefix.rlike("^(?:[0-9]+|[A-Z0-9]{0,2}[A-Z][A-Z0-9]{0,2})$") & (prefix.rlike("^[0-9]+$") | (F.length(prefix) <= 3))), parts)


def citations(c: Column | str) -> Column:
    """F16: numbers of the tables and figures cited, as ``table:n`` and ``figure:n``, distinct and sorted."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    tables = F.regexp_extract_all(low, F.lit(r"(?<![a-z0-9_])(?:table|tab\.)[ \t\n]*([0-9]+)"), 1)
    figures = F.regexp_extract_all(low, F.lit(r"(?<![a-z0-9_])(?:figure|fig\.)[ \t\n]*([0-9]+)"), 1)
    return F.array_sort(F.array_distinct(F.concat(F.transform(figures, lambda n: F.concat(F.lit("figure:"), n)), F.transform(tables, lambda n: F.concat(F.lit("table:"), n)))))


def markdown_rows(c: Column | str) -> Column:
    """rows of a pipe table as arrays of trimmed cells; separator and other lines are skipped."""
    lines = F.filter(F.split(F.coalesce(col(c), F.lit("")), "\n"), lambda s: F.trim(s).startswith("|") & ~s.rlike(r"^[ |:\-]+$"))
    return F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(F.trim(s), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)))


def key_terms(c: Column | str, most: int = 15) -> Column:
    """capitalised words and numbers with a word, over three signs long, the first ``most`` that differ in lower case."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(\b[A-Z][a-zA-Z0-9\-]{2,}\b|\b[0-9]+[.0-9]*[ \t\n\r\f]*[a-zA-Z]+\b)"), 1)
    long = F.filter(found, lambda t: F.length(t) > 3)
    low = F.transform(long, lambda t: F.lower(t))
    return F.slice(F.filter(long, lambda t, i: F.array_position(low, F.lower(t)) == i + 1), 1, most)


# Words of each domain, tried in this order, and parts of a path that name it.
DOMAINS = {
    "medical": (["medical"], ["patient", "clinical", "forceps", "surgical", "treatment", "doctor", "health", "hospital", "anatomy"]),
    "scientific": (["scientific", "arxiv"], ["abstract", "equation", "theorem", "method", "dataset", "framework", "architecture", "experimental"]),
    "financial": (["financial"], ["fiscal", "quarter", "revenue", "profit", "ebitda", "shares", "growth", "annual report", "balance sheet"]),
}


def document_domain(path: Column, text: Column) -> Column:
    """the first domain that the path names or of which the text holds a word; else general."""
    low_path, low_text, out = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(text, F.lit(""))), F.lit("general")
    for name, (paths, words) in reversed(DOMAINS.items()):
        hit = F.lit(False)
        for p in paths:
            hit = hit | low_path.contains(p)
        for w in words:
            hit = hit | low_text.contains(w)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def domain(c: Column | str, rules: list[tuple[str, str]], default: str = "general") -> Column:
    """the first rule (name, pattern) whose pattern occurs in the text in lower case."""
    low, out = F.lower(F.coalesce(col(c), F.lit(""))), None
    for name, pattern in rules:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(default)


def quality_flags(c: Column | str) -> dict[str, Column]:
    """replacement character, a character four times in a row, a hyphen before a blank, a ligature."""
    t = F.coalesce(col(c), F.lit(""))
    return {"bad_char": t.contains("�"), "repeated": t.rlike(r"([a-zA-Z])\1{3}"), "open_hyphen": t.rlike("[a-z]- [a-z]"), "ligature": t.rlike("[ﬀ-ﬄ]")}


def is_spec_query(c: Column | str) -> Column:
    """A code of letters and digits, or a number of five or more digits."""
    return F.coalesce(col(c).rlike(r"(?<![A-Za-z0-9_])[A-Za-z]{1,4}-?[0-9]{3,}") | col(c).rlike("[0-9]{5,}"), F.lit(False))


def query_intent(c: Column | str) -> Column:
    """``table`` for table words; else ``prose`` for a question word or more than five words; else ``table``."""
    low = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    words = F.lit(False)
    for w in TABLE_WORDS:
        words = words | low.contains(w)
    asks = F.arrays_overlap(entity_tokens(low), F.array(*[F.lit(w) for w in PROSE_SIGNALS]))
    return F.when(words, "table").when(asks | (token_count(c) > 5), "prose").otherwise("table")


def page_list(c: Column | str) -> Column:
    """``1-3, 5`` to sorted distinct page numbers; unreadable parts are skipped."""
    parts = F.filter(F.split(F.coalesce(col(c), F.lit("")), "[ ]*,[ ]*"), lambda p: p.rlike("^[0-9]{1,6}(?:-[0-9]{1,6})?$"))
    first = lambda p: F.element_at(F.split(p, "-"), 1).cast("int")
    last = lambda p: F.element_at(F.split(p, "-"), -1).cast("int")
    return F.sort_array(F.array_distinct(F.flatten(F.transform(F.filter(parts, lambda p: first(p) <= last(p)), lambda p: F.sequence(first(p), last(p))))))


def gold_pages(c: Column | str) -> Column:
    """Pages named in evidence as p.3, p.3/5 or p.3-5."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"p\.[ ]?([0-9]+(?:[/-][0-9]+)*)"), 1)
    return page_list(F.array_join(F.transform(found, lambda p: F.replace(p, F.lit("/"), F.lit(","))), ","))


def fenced_json(c: Column | str) -> Column:
    """the outermost braces of a model answer, without thinking tags and fences."""
    bare = F.regexp_replace(F.regexp_replace(col(c), "(?s)<think>.*?</think>", ""), "```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def code_block(c: Column | str) -> Column:
    """the first fenced block of an answer, with or without a language, else the answer; trimmed."""
    found = F.regexp_extract(col(c), r"(?s)```(?:python)?[ \t\n\r\f]*(.*?)```", 1)
    return F.trim(F.when(col(c).rlike(r"(?s)```.*?```"), found).otherwise(col(c)), F.lit(" \t\n\r"))


def groundedness(context: Column, truth: Column) -> Column:
    """0.1 + 0.9 times the share of the truth's words found in the context; 0.1 without words."""
    gold = F.array_distinct(alnum_tokens(truth))
    share = F.size(F.array_intersect(gold, F.array_distinct(alnum_tokens(context)))) / F.nullif(F.size(gold), F.lit(0))
    return F.lit(0.1) + 0.9 * F.coalesce(share, F.lit(0.0))


def uuid5(namespace_hex: str, c: Column | str) -> Column:
    """version 5 UUID of a name in a namespace given as 32 hexadecimal digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(col(c), "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def repeated_trigrams(df: DataFrame, key: str, c: str, times: int = 4, least_words: int = 10) -> DataFrame:
    """keys of texts of at least ``least_words`` words in which some three words in a row occur at least ``times`` times.

    Counted by (key, three words), so that a long text is spread and like grams are combined before the exchange.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[ \t\n\r\f]+"), lambda t: t != "")
    long = df.select(F.col(key), words.alias("_w")).where(F.size("_w") >= least_words)
    # one posexplode and three shifted copies instead of slices of the array for each place
    grams = long.select(key, F.explode(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.size("_w")).alias("b"), F.slice("_w", 3, F.size("_w")).alias("c"))).alias("g")).where("g.c is not null")
    return grams.groupBy(key, "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times).select(key).distinct()
