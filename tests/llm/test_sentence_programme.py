"""The programme against all segmentations, and what length, words and quotations decide together."""

from itertools import combinations

import pytest

from docloom.llm import sentences as S

TEXTS = [
    'He said "Stop. Now!" Then he left. Sec. 4 applies. "It works." The end.',
    "Dr. A. Smith of Acme Ltd. signed it.Next one came on 4 Feb. at noon? Yes! no. 3. Open it.",
    "1. Open the valve. 2. Close it (see Fig. 3). etc. The rest follows... and ends.",
    "Am 30. März lief es. Die Pumpe (vgl. S. 4) steht. „Halt!“ rief er. „Gut.“ Er ging.",
    "これは文です。「終わり。」と彼は言った。次！ OK. 完。",
]


def every_mark(text: str, known: S.Statistics, monkeypatch) -> list:
    """Candidates with none left out."""
    with monkeypatch.context() as m:
        m.setattr(S, "LENGTH_LEAST", -1e9)
        return S._candidates(text, known)


def every_way(text: str, known: S.Statistics, monkeypatch) -> float:
    """The highest score over all subsets of the candidates."""
    ends = every_mark(text, known, monkeypatch)
    law = known.lengths.get(S._script(text), S.PRIOR.lengths["spaced"])
    best = float("-inf")
    for n in range(len(ends)):
        for chosen in combinations(range(len(ends) - 1), n):
            best = max(best, score([*chosen, len(ends) - 1], ends, law))
    return best


def score(chosen: list[int], ends: list, law: tuple[float, float]) -> float:
    total, first, cut = 0.0, 0, 0
    for k in chosen:
        e = ends[k]
        total += e.score + S._length_score(e.at - first, law) + S.CUT_PAIR * (cut + e.cut)
        if e.opened >= 0 and e.opened != first:
            total += S.FOREIGN_QUOTE
        first, cut = e.nxt, e.cut
    return total


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("mean", [2.0, 4.3, 6.0])
def test_no_segmentation_scores_higher(text, mean, monkeypatch):
    known = S.Statistics({"spaced": (mean, 0.5), "blankless": (mean, 0.5)}, {"feb": -4.0, "valve": -2.0}, {"Then": 1.0, "The": 0.7})
    ends = every_mark(text, known, monkeypatch)
    law = known.lengths[S._script(text)]
    at = {e.at: k for k, e in enumerate(ends)}
    chosen = [at[b] for _, b in S._paragraph(text, known)]
    assert score(chosen, ends, law) == pytest.approx(every_way(text, known, monkeypatch))


def test_each_part_of_the_score_decides():
    cut = lambda text, known=S.PRIOR: [text[a:b] for a, b in S._paragraph(text, known)]
    plain = "The new pump was tested on site by the team. Works then begin at the second site of the plant."
    assert len(cut(plain)) == 2
    # corpus statistics of the closing word
    assert len(cut(plain, S.PRIOR._replace(closing={"team": -8.0}))) == 1
    # length: a very short span joins what follows
    assert cut("3. The new pump was tested on site by the team.") == ["3. The new pump was tested on site by the team."]
    # quotations: one that opens inside a sentence never ends it, one that opens a unit does
    assert len(cut('The chief of the site called "Stop the pump!" The team of the second site obeyed at once.')) == 1
    assert len(cut('"Stop the pump at once!" The team of the second site obeyed at once.')) == 2


def test_statistics_cover_all_texts(spark):
    rows = [("Der Bericht liegt vor, bzw. er folgt. Ab Okt. gilt er.\n\nEr gilt ab Okt. und danach, bzw. nie.",)] * 8 + [(None,), ("",)]
    known = S.fit_statistics(spark.createDataFrame(rows, "text string"), floor=0.0)
    assert known.closing["bzw"] < -3 and known.closing["okt"] < 0 and known.closing["nie"] > 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.sentence_units(empty).count() == 0


@pytest.mark.parametrize("unit", ["e.x. ", "A. ", '"a." ', "(b. ", "ab. Cd ", "3. "])
def test_long_texts_without_a_certain_end(unit):
    import time

    began = time.process_time()
    found = S.spans(unit * 20000)
    assert time.process_time() - began < 60 and found[0][0] == 0 and sum(n for _, n in found) > 0
    assert all(a + n <= b for (a, n), (b, _) in zip(found, found[1:]))
