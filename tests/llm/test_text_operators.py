"""Operators that work text by text: sentences, quality, splitting, leaks, mixing."""

import pytest

from docloom.llm import leaks, mixing, quality, sentences, splitting


def units(text):
    return [text[a : a + n] for a, n in sentences.spans(text)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Dr. A signed. See Fig. 2 and Tab. 4. It closes at 2 p.m. Every lamp.", ["Dr. A signed.", "See Fig. 2 and Tab. 4.", "It closes at 2 p.m.", "Every lamp."]),
        ("The label reads “Do not open! Wait.” in red. “Keep dry.” Next.", ["The label reads “Do not open! Wait.” in red.", "“Keep dry.”", "Next."]),
        ('"Is it sealed?" asked the man. Yes.', ['"Is it sealed?" asked the man.', "Yes."]),
        ("Title Here\n\nOne\nline. pH values fell.", ["Title Here", "One\nline.", "pH values fell."]),
        ("Im 3. Quartal sank es. Am 4. März auch.", ["Im 3. Quartal sank es.", "Am 4. März auch."]),
        ("« Garder au sec. » Il part ! Oui.", ["« Garder au sec. »", "Il part !", "Oui."]),
        ("保持干燥。“保持干燥。”标签写着“打开！等待。”几个字。", ["保持干燥。", "“保持干燥。”", "标签写着“打开！等待。”几个字。"]),
        ("ปั๊มน้ำ NC-6430 ในหน้าถัดไป สายไฟใหม่", ["ปั๊มน้ำ NC-6430 ในหน้าถัดไป", "สายไฟใหม่"]),
        ("It ended.The next … and so on: fine; ok.", ["It ended.", "The next … and so on: fine; ok."]),
        ("", []), ("  \n \n ", []), (None, []),
    ],
)
def test_sentences(text, expected):
    assert units(text) == expected


def test_long_text_is_cut_whole():
    text = "The pump stops at once. " * 20_000
    got = sentences.spans(text)
    assert len(got) == 20_000 and all(n == 23 for _, n in got)


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "Oil is in. Go on.", "x"), (2, None, "y"), (1, "Oil is in. Go on.", "x")], "doc_id long, text string, start_pos string")
    assert sorted(map(tuple, sentences.sentence_units(df).collect())) == [(1, 0, 10), (1, 0, 10), (1, 11, 6), (1, 11, 6)]


@pytest.mark.parametrize(
    "text, kind",
    [
        ("The pump is in the room and the lamp is on the wall. It has a new valve for each line.", "prose"),
        ("• First pump\n• Second lamp\n• Third valve\n• Fourth line", "list"), ("a) Pump\nb) Lamp\nc) Valve\nd) Line", "list"), ("sealed pump, flat lamp 3, old valve, new cable, red line 4, long hose, small cap, wide nut", "list"),
        ("| A | B |\n|---|---|\n| KX-12 | 3 |\n| KY-12 | 4 |", "table"), ("A\tB\tC\n1\t2\t3\n4\t5\t6", "table"), ("Row: KX-1 | Size = 3 mm | Power = 4 W\nRow: KX-2 | Size = 5 mm | Power = 1 W", "table"),
        ("kchsnhwttch rstzft trdgsrpzlbb jsqhkgdwqkn drlphxtrcgx", "junk"), ("read more, " * 20, "junk"), ("93c6a6a0 f8f921a4 1400cd59 7b101e6e cc7588b2", "junk"), ("   ", "junk"), ("", "junk"),
    ],
)
def test_forms(text, kind):
    assert quality.analyse(text)[-1] == kind


def test_quality_rows_and_empty_table(spark):
    df = spark.createDataFrame([("a", "It is a pump."), ("b", None), (None, "x")], "k string, text string").selectExpr("k", "text", "'z' as kind")
    got = {r.k: r.n_words for r in quality.text_quality(df, quality.UNFITTED, "k").collect()}
    assert got == {"a": 4, None: 1}
    assert quality.text_quality(df.limit(0), quality.UNFITTED, "k").count() == 0


def test_pieces_cover_the_text_with_overlap():
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(60))
    stretch, got = splitting.pieces(text)
    assert stretch == 30 and all(n <= 400 for _, _, n, _ in got) and got[0][0] == 0 and got[-1][1] == len(text)
    for (_, b, _, _), (a, _, _, _) in zip(got, got[1:]):
        assert len(text[a:b].split()) == 40
    assert not any(forced for *_, forced in got)


def test_forced_and_short_texts(spark):
    df = spark.createDataFrame([("f", "word " * 1000), ("s", "word " * 400), ("n", None), ("n", ""), ("f", "word " * 1000), ("z", "水" * 900)], "chunk_id string, text string").selectExpr("*", "1 as piece_no")
    got = {(r.chunk_id, r.boundary) for r in splitting.split_oversized(df).collect()}
    assert got == {("f", "forced"), ("z", "forced")}


ITEM = "the quick brown fox jumps over the lazy dog near the old river bank today"


def test_leaks_match_brute_force(spark):
    docs = [(1, "x " + ITEM.upper().replace(" ", "  ") + "!"), (2, "the quick brown fox jumps over the lazy dog near the"), (3, ITEM.replace("lazy", "tired")), (4, None), (5, ""), (1, "x " + ITEM), (6, "ﬁne " * 5 + ITEM)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' as lsh_key")
    bank = spark.createDataFrame([("q1", ITEM, None), ("q2", "short", "none"), ("q1", ITEM, None), (None, None, None)], "question_id string, question string, evidence string")
    asked = {tuple(leaks.words(ITEM)[i : i + 12]) for i in range(len(leaks.words(ITEM)) - 11)}
    want = {(d, "q1") for d, t in docs for w in [leaks.words(t)] if any(tuple(w[i : i + 12]) in asked for i in range(len(w) - 11))}
    assert {(r.doc_id, r.question_id) for r in leaks.leaked_windows(df, bank).where("edits = 0").collect()} == want == {(r.doc_id, r.question_id) for r in leaks.leaked_windows(df, bank, max_edits=0, block=1).collect()} == {(1, "q1"), (6, "q1")}
    near = {(r.doc_id, r.edits) for r in leaks.leaked_windows(df, bank, max_edits=1, recall=0.99).collect()}
    assert (3, 1) in near and (1, 0) in near
    assert leaks.leaked_windows(df, bank.limit(0)).count() == 0 and leaks.leaked_windows(df.limit(0), bank).count() == 0


@pytest.mark.parametrize("edits", [1, 2])
def test_near_leak_recall_is_at_least_nine_tenths(spark, edits):
    import random

    draw = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(f"q{i}", " ".join(draw.choices(vocabulary, k=14)), None) for i in range(200)]
    docs = []
    for i, (_, text, _) in enumerate(items):
        w = text.split()[:12]
        at = draw.randrange(12)
        if edits == 1:
            w[at] = "zzz"
        else:
            w = [*w[:at], "zzz", *w[at:]][:12]
        docs.append((i, " ".join(["before", *w, "after"])))
    found = leaks.leaked_windows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "question_id string, question string, evidence string"), max_edits=edits, block=700)
    hit = {(r.doc_id, r.question_id): r.edits for r in found.collect()}
    assert sum((i, f"q{i}") in hit for i in range(200)) >= 180 and max(hit.values()) <= edits
    # no pair beyond the distance: brute force
    for (d, q), n in hit.items():
        a, b = docs[d][1].split(), items[int(q[1:])][1].split()
        assert n == min(leaks.edit_distance(a[i : i + 12], b[j : j + 12], 12) for i in range(len(a) - 11) for j in range(len(b) - 11))


def test_leaks_with_other_key_types(spark):
    df = spark.createDataFrame([(b"a", ITEM), (None, ITEM)], "k binary, body string")
    bank = spark.createDataFrame([(3, ITEM, 1)], "item int, question string, window int")
    rows = leaks.leaked_windows(df, bank, key="k", text="body", item_key="item", item_texts=("question",)).collect()
    assert [(bytes(r.k), r.item, r.edits) for r in rows] == [(b"a", 3, 0)]


def test_recall_out_of_reach_is_an_error():
    with pytest.raises(ValueError, match="repetitions"):
        leaks.bands(12, 6, 0.99, sampled=12, most=8)


def test_mixture_reaches_shares_under_caps(spark, tmp_path):
    rows = [(i, "pump lamp valve " * (1 + i % 5), "a" if i % 3 else "b") for i in range(3000)] + [(9001, None, "a"), (9002, "x", None), (9003, "x", "unknown")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "0 as copy_no")
    targets = spark.createDataFrame([("a", 0.8, 1), ("b", 0.1, 4), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    shares = {r.source: r for r in mixing.shares(docs, targets).collect()}
    # a reaches its cap: it is used whole, and what is short is told
    assert shares["a"].mixed_tokens == shares["a"].source_tokens == shares["a"].wanted_tokens - shares["a"].short_tokens
    assert shares["b"].mixed_tokens == pytest.approx(shares["b"].wanted_tokens, rel=0.02) and shares["none"].actual_share == 0
    kept = {r.source: r for r in mixing.shares(docs, targets, keep_shares=True).collect()}
    assert kept["a"].mixed_tokens / (kept["a"].mixed_tokens + kept["b"].mixed_tokens) == pytest.approx(8 / 9, abs=0.01)
    made = mixing.mixture(docs, targets)
    counts = made.groupBy("source").count().collect()
    assert {r.source: r["count"] for r in counts} == {s: shares[s].copies for s in ("a", "b")}
    assert made.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 4
    assert mixing.mixture(docs.limit(0), targets).count() == 0


def test_poisson_tails_and_caps():
    assert mixing.poisson_tails(1.0, 2) == pytest.approx([0.6321, 0.2642], abs=1e-4) and mixing.poisson_tails(900.0, 3) == pytest.approx([1, 1, 1])
    assert mixing.fit([1.0] * mixing.BINS, 3.0 * mixing.BINS, 3)[1] == [mixing.BINS] * 3
    rate, cuts = mixing.fit([1.0] * mixing.BINS, 0.5 * mixing.BINS, 6)
    assert rate == pytest.approx(0.5, abs=0.01) and sum(cuts) == pytest.approx(0.5 * mixing.BINS, abs=2)


def test_cuts_lie_in_the_deepest_valley_of_their_window():
    import random

    draw = random.Random(8)
    topics = [[f"{t}word{k}" for k in range(12)] for t in "abcdefgh"]
    text = " ".join(" ".join(draw.choices(words, k=10)) + "." for words in topics for _ in range(draw.randint(8, 22)))
    stretch, cut = splitting.pieces(text, 400, 40)
    words = [(m.start(), m.end()) for m in splitting.WORD.finditer(text)]
    starts = [a for a, _ in words]
    places = sorted({next((k for k, a in enumerate(starts) if a >= m.end()), len(starts)) for m in splitting.BOUNDARY.finditer(text)} - {0, len(starts)})
    depths = splitting._depths(splitting._similarities([text[a:b] for a, b in words], places, 60))
    first = 0
    for k, (a, b, n, forced) in enumerate(cut):
        assert starts[first] == a and n <= 400 and not forced
        if k + 1 < len(cut):
            end = first + n
            window = [(d, p) for d, p in zip(depths, places) if first + 200 <= p <= first + 400]
            assert end in places and (depths[places.index(end)], end) == max(window)
            first = end - 40
    assert stretch <= 400 and sum(n for *_, n, _ in cut) - 40 * (len(cut) - 1) == len(words)
