"""Row filters and small projections of documents, elements and questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import sequences as S

# Detector labels and the element types they stand for; any other label is a paragraph.
ELEMENT_TYPES = {
    "title": "title", "plain text": "paragraph", "figure": "figure", "figure_caption": "paragraph", "table": "table", "table_caption": "paragraph",
    "table_footnote": "paragraph", "isolate_formula": "formula", "formula_caption": "paragraph", "abandon": "boilerplate",
}
# Openings of appendix headings that a detector takes for text.
HEADING_OPENING = r"^(?:[A-Z][ \t\n]*\n?[ \t\n]+[a-zA-Z]|Appendix[ \t\n]+[A-Z])"
# Question types by the form of answer that is asked for; any other type asks for prose.
ANSWER_FORMS = {"multi-span": "multi_span", "span": "short", "count": "short", "arithmetic": "short"}
#: An upload is at most so many bytes and pages.
MOST_BYTES, MOST_PAGES = 50 * 1024 * 1024, 200


def element_type(label: Column, content: Column) -> Column:
    """Element type of a detector label; text that opens like an appendix heading is a title."""
    mapped = F.coalesce(X.literal_map(ELEMENT_TYPES)[label], F.lit("paragraph"))
    return F.when((mapped != "title") & F.coalesce(F.trim(content), F.lit("")).rlike(HEADING_OPENING), F.lit("title")).otherwise(mapped)


def is_boilerplate(label: Column) -> Column:
    """Whether an element is set aside; one flag column instead of two passes. A null label is kept."""
    return F.coalesce(X.literal_map(ELEMENT_TYPES)[label] == "boilerplate", F.lit(False))


def may_read(allowed: Column, roles: Sequence[str]) -> Column:
    """Rows that one of the caller's roles may read; rows without roles are open."""
    return allowed.isNull() | F.arrays_overlap(allowed, F.array(*[F.lit(r) for r in roles]))


def judge_sample(questions: DataFrame, order: list[str], stride: int = 5, key: str = "question_id", wanted: Sequence[str] = ()) -> DataFrame:
    """P10: every ``stride``-th row in order, the first included, and the rows named in ``wanted``."""
    numbered = S.global_number(questions, order, "_n")
    return numbered.where((F.pmod(F.col("_n"), F.lit(stride)) == 0) | F.col(key).isin(list(wanted))).drop("_n")


def answer_form(query_type: Column) -> Column:
    """Name of the prompt that fits a question type."""
    return F.coalesce(X.literal_map(ANSWER_FORMS)[F.lower(F.trim(F.coalesce(query_type, F.lit(""))))], F.lit("prose"))


def upload_fault(content: Column, n_bytes: Column, n_pages: Column) -> Column:
    """Why an upload is refused, or null: too large, not a PDF by its first bytes, too many pages."""
    magic = F.substring(content, 1, 4) == F.lit("%PDF")
    return F.when(n_bytes > MOST_BYTES, "too_large").when(~F.coalesce(magic, F.lit(False)), "not_pdf").when(n_pages > MOST_PAGES, "too_many_pages")


def shifted_pages(pages: Column, doc: Column, offsets: dict[str, int]) -> Column:
    """Printed page numbers turned into those of the file, for documents with a known offset."""
    by = F.coalesce(X.literal_map(offsets)[doc], F.lit(0)) if offsets else F.lit(0)
    return F.transform(pages, lambda p: p + by)


def has_visual_hints(n_drawings: Column, text: Column, words: Sequence[str]) -> Column:
    """P20: a page is sent to the caption model if it has five drawings or names a visual."""
    named = F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(words))
    return (F.coalesce(n_drawings, F.lit(0)) >= 5) | named


def is_figure_only(answer_type: Column, sources: Column) -> Column:
    """The answer rests on images alone. ``sources`` is an array of file names of the evidence used."""
    image = lambda s: F.lower(s).rlike(r"\.(?:jpg|jpeg|png)$")
    return (F.coalesce(answer_type, F.lit("")) == "image_only") | (F.exists(sources, image) & ~F.exists(sources, lambda s: ~image(s)))


def unified(label: Column, names: dict[str, str]) -> Column:
    """Canonical class name; an unknown label stays as it is."""
    return F.coalesce(X.literal_map(names)[F.lower(F.trim(label))], label)


def with_gold_page(questions: DataFrame, linked: DataFrame, doc: str = "doc_stem", pages: str = "gold_pages") -> DataFrame:
    """Questions with a gold page that holds a row of ``linked`` (doc, page); a semi join on both keys."""
    asked = questions.select("question_id", F.col(doc).alias("_doc"), F.explode(pages).alias("_page"))
    hit = asked.join(linked.select(F.col(doc).alias("_doc"), F.col("page").alias("_page")), ["_doc", "_page"], "left_semi").select("question_id").distinct()
    return questions.join(hit, "question_id", "left_semi")
