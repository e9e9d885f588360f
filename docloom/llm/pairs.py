"""Broken prompt and response pairs.

* ``empty``: nothing readable, or only a stand-in for no value.
* ``copy``: the query and nothing more, whatever its case, marks, label or emphasis.
* ``refusal``: declines to answer although the ground truth has an answer.
* ``wrong_language``: the posteriors of prompt and response under a naive Bayes model of hashed character n-grams disagree.
* ``truncated``: the words at the end have, in the whole table, nearly always been followed by more text rather than an end.

One type a pair, in that order. A null answer is empty; a pair without a query is judged without the tests that need it.
Repeated rows are judged once. A ground truth that is null or says there is no answer permits a refusal. Texts are whole.

The language model is fitted on a bounded sample of labelled documents (``sample`` rows for each language, drawn by hash) and has a fixed
number of buckets, so its size does not grow with the data. The end statistics are counted over all answers and ground
truths; they are joined to the answers by shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.session import cut_lineage

LANGUAGES = ("en", "de", "fr", "es", "ja", "zh", "hi", "th")
BUCKETS = 1 << 15
SAMPLE = 600
ORDER = 9  # longest context of the end statistics, in tokens

# Stand-ins for no value, without marks and in lower case.
STAND_INS = frozenset(
    "na nil null none nan undefined unknown empty blank notfound noanswer noresponse noresult missing tbd tba keine keineangabe leer unbekannt vide inconnu aucun aucune ninguno vacío vacio desconocido ありません なし 不明 無し 无 未知 空".split()
)
# How an answer says that the source has none.
NO_ANSWER = re.compile(
    r"^(?:not[ _]?found|no answer|n/?a|null|none|(?:the )?(?:document|text|context|source) (?:gives|contains|has) no answer|(?:this is )?not (?:stated|given|mentioned|specified|found|available|answerable)\b.*|im (?:dokument|text) nicht (?:angegeben|genannt|erwähnt)|nicht angegeben"
    r"|non (?:indiqué|précisé|mentionné)\b.*|no (?:consta|figura|se indica|aparece)\b.*|文書に記載(?:なし|がありません|されていません)|記載なし|文件中未(?:说明|提及|提供)|未说明|无答案)[.。]?$",
    re.I,
)
# Openings and cores of refusals by language.
REFUSAL = re.compile(
    r"\b(?:i(?:'m| am) (?:sorry|afraid|unable|not able)|i (?:cannot|can ?not|can't|could not|am unable|must decline|have to decline|have no access|do not have|don't have|won't|will not|would rather not|prefer not)|i(?:'d| would) (?:rather|prefer) not|as an? (?:ai|language model|assistant)"
    r"|(?:does not|doesn't|do not|don't) (?:let|allow|permit|enable) me|not be appropriate|no answer can be given|unable to (?:answer|help|provide|assist)|decline to|i have no (?:access|information)|not allowed to|cannot (?:help|assist|answer|provide|comment)"
    r"|es tut mir leid|tut mir leid|kann ich (?:diese|ihnen|dazu|dabei|das|leider)|leider kann ich|darf ich (?:keine|nicht)|möchte (?:ich )?mich .* nicht äußern|ich möchte .* nicht|als (?:sprachmodell|ki)\b|habe ich keinen zugriff|keine auskunft|nicht beantworten"
    r"|je suis désolée?|désolée?,|je ne (?:peux|suis|puis|sais) pas|je n'ai pas|il m'est impossible|je préfère ne pas|en tant que (?:modèle|ia)|ne pas me prononcer|je refuse"
    r"|lo siento|no puedo|no estoy autorizado|prefiero no|como modelo de lenguaje|no tengo acceso|me es imposible|no me es posible|debo negarme|no podemos responder)\b"
    r"|申し訳|お答えできません|控えさせて|提供することはできません|回答できません|お答えすることはできません|わかりかねます|言語モデル"
    r"|抱歉|无法回答|不能提供|无法提供|作为(?:一个)?(?:语言模型|人工智能|AI)|无权|很遗憾|不便回答|拒绝回答|对不起",
    re.I,
)

TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+(?:[.,]\d+)*|[^\w\s]|_")
CJK = re.compile(r"[぀-ヿ一-鿿฀-๿]")
WORDS = re.compile(r"[぀-ヿ一-鿿฀-๿]+|[^\W\d_぀-ヿ一-鿿฀-๿]+")
CODE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{1,4}-?\d{2,}(?:-[A-Za-z0-9]+)?(?![A-Za-z0-9])")
MEASURE = re.compile(r"\d+(?:[.,]\d+)*\s?[a-zµ°%℃℉]{0,3}(?![^\W\d_])")
FINAL = re.compile(r"[.!?。！？।][\"'”’»“)」』*_]*\s*$")
WRAP = "\"'“”„«»‘’()[]{}*_`#>•·-–—.。!！?？…:：,，;； \t\n​ "
LABELS = re.compile(r"^(?:answer|question|query|response|a|q|antwort|frage|réponse|question|respuesta|pregunta|回答|質問|答|问题|问)\s*[:：]\s*", re.I)


def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def _core(text: str) -> str:
    """Letters, digits and signs of blankless scripts, folded; for comparison regardless of marks and spacing."""
    return re.sub(r"[\W_]+", " ", folded(text)).strip()


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    shown = "".join(c for c in text if unicodedata.category(c)[0] not in "CZ")
    bare = re.sub(r"[\W_]+", "", folded(shown))
    return not bare or bare in STAND_INS


def is_copy(query: str | None, answer: str) -> bool:
    """The query once or several times, with or without a label before it."""
    if not query:
        return False
    asked = _core(query)
    if not asked:
        return False
    given = answer.strip().lstrip(WRAP)
    for _ in range(2):
        given = LABELS.sub("", given).lstrip(WRAP)
    core = _core(given)
    while core.startswith(asked):
        core = core[len(asked) :].strip()
        if not core:
            return True
    return False


def is_refusal(answer: str, query: str | None, truth: str | None) -> bool:
    """A refusal phrase, no value from outside the query, and a ground truth with an answer."""
    if truth is None or is_empty(truth) or NO_ANSWER.match(truth.strip()):
        return False
    text = answer.replace("’", "'")
    if not REFUSAL.search(text):
        return False
    known = set(re.findall(r"\d+(?:[.,]\d+)*", folded(query or "")))
    rest = CODE.sub(" ", folded(answer))
    return all(n in known for n in re.findall(r"\d+(?:[.,]\d+)*", rest))


# ---- languages ------------------------------------------------------------------------------------------------------


def _buckets(word: str) -> np.ndarray:
    """Buckets of the character n-grams of one word (2 to 4 with word edges; 1 and 2 in blankless scripts)."""
    if CJK.match(word):
        out = [*word, *(word[i : i + 2] for i in range(len(word) - 1))]
    else:
        edged = f"<{word}>"
        out = [edged[i : i + n] for n in (2, 3, 4) for i in range(len(edged) - n + 1)]
    return np.fromiter((xxhash.xxh32_intdigest(g) & (BUCKETS - 1) for g in out), np.int32, len(out))


class _Words(dict):
    """Buckets of the words met by a worker; emptied when it has grown."""

    def __missing__(self, word: str) -> np.ndarray:
        if CJK.match(word):  # runs of signs seldom recur
            return _buckets(word)
        if len(self) > 100_000:
            self.clear()
        value = self[word] = _buckets(word)
        return value


_words = _Words()


def grams(text: str) -> np.ndarray:
    """Buckets of the character n-grams of all words of a text."""
    found = [_words[w] for w in WORDS.findall(folded(text))]
    return np.concatenate(found) if found else np.empty(0, np.int32)


def fit_languages(documents: DataFrame, pairs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Log probabilities, languages by buckets.

    Fitted on at most ``sample`` labelled documents of each language; as some labels are wrong, a second time without the
    texts that the first model gives to another language; then adapted to the wording of the pairs by self-training on all
    distinct ones, each read as query and ground truth together; their buckets are summed by guessed language in the workers.
    """
    labelled = documents.where(F.col("text").isNotNull()).select(F.lower("lang").alias("lang"), "text", F.xxhash64("text").alias("_order")).where(F.col("lang").isin(*LANGUAGES))
    # by a hash of the text, so that neither order nor source of the rows matters
    drawn = Window.partitionBy("lang").orderBy("_order", "text")
    rows = labelled.withColumn("_k", F.row_number().over(drawn)).where(F.col("_k") <= sample).select("lang", "text").collect()
    counted = [(LANGUAGES.index(r.lang), grams(r.text)) for r in rows]
    counts = np.zeros((len(LANGUAGES), BUCKETS))
    for k, g in counted:
        counts[k] += np.bincount(g, minlength=BUCKETS)
    model, known = _logs(counts), counts.sum(axis=1) > 0
    counts = np.zeros_like(counts)
    for k, g in counted:
        if _best(model, g, known)[0] == k:
            counts[k] += np.bincount(g, minlength=BUCKETS)
    own = pairs.where("query is not null and ground_truth is not null").select(F.concat_ws(" ", "query", "ground_truth").alias("text")).distinct()
    for _ in range(2):
        counts = counts + _guessed(own, _logs(counts), counts.sum(axis=1) > 0)
    return _logs(counts)


def _guessed(texts: DataFrame, model: np.ndarray, known: np.ndarray, lead: float = 5.0) -> np.ndarray:
    """Bucket counts of all texts by the language that the model gives them with some lead; others count nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = np.zeros(model.shape, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                g = grams(t)
                k, ahead = _best(model, g, known)
                if ahead > lead:
                    np.add.at(more[k], g, 1)
        place = np.flatnonzero(more)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(more.ravel()[place], pa.int64())], names=["place", "n"])

    found = texts.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    more = np.zeros(model.size)
    more[found["place"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return more.reshape(model.shape)


def _best(model: np.ndarray, g: np.ndarray, known: np.ndarray) -> tuple[int, float]:
    """Language of a text, given by its buckets, and its lead over the next."""
    score = np.where(known, model[:, g].sum(axis=1), -np.inf)
    order = np.argsort(score)
    return int(order[-1]), float(score[order[-1]] - score[order[-2]]) if known.sum() > 1 else 1e9


def _logs(counts: np.ndarray, alpha: float = 0.3) -> np.ndarray:
    return np.log((counts + alpha) / (counts.sum(axis=1, keepdims=True) + alpha * BUCKETS)).astype(np.float32)


def _scores(model: np.ndarray, text: str) -> tuple[np.ndarray, int]:
    g = grams(text)
    return model[:, g].sum(axis=1), len(g)


def wrong_language(model: np.ndarray, query: str | None, answer: str, margin: float = 8.0) -> bool:
    """Prompt and response are better explained by two languages than by one; what both share, numbers and codes are left out."""
    if not query:
        return False
    asked, given = (WORDS.findall(MEASURE.sub(" ", CODE.sub(" ", folded(t)))) for t in (query, answer))
    both = {w for w in set(asked) & set(given) if not CJK.match(w)}
    asked = [w for w in asked if w not in both]
    given = [w for w in given if w not in both]
    if not asked or sum(map(len, given)) < (4 if any(CJK.match(w) for w in given) else 8):
        return False
    p, _ = _scores(model, " ".join(asked))
    r, _ = _scores(model, " ".join(given))
    return int(np.argmax(p)) != int(np.argmax(r)) and float(p.max() + r.max() - (p + r).max()) > margin


# ---- ends of texts --------------------------------------------------------------------------------------------------


OTHER = "≠"


def tokens(text: str, query: str | None, ordinary: frozenset[str]) -> list[str]:
    """Words, numbers (as 0), names and codes of the query (as §), marks and single signs of blankless scripts.

    A name or code of the query that is cut short, or a name with another number, is OTHER.
    """
    asked = folded(query or "")
    names = {w for w in WORDS.findall(CODE.sub(" ", asked)) if not CJK.match(w) and w not in ordinary}
    codes, numbers = set(CODE.findall(asked)), set(re.findall(r"\d+", asked))
    out: list[str] = []

    def code(m: re.Match) -> str:
        return " § " if m[0] in codes or not any(c.startswith(m[0]) for c in codes) else f" {OTHER} "

    for t in TOKEN.findall(CODE.sub(code, folded(text)).replace("’", "'")):
        if t[0].isdigit():
            if out and out[-1] == "§":
                if t not in numbers and any(n.startswith(t) for n in numbers):
                    out[-1] = OTHER
                continue
            out.append("0")
        elif CJK.search(t):
            for piece in WORDS.findall(t):
                out += list(piece) if CJK.match(piece) else ["§" if piece in names else piece]
        else:
            out.append("§" if t in names else t)
    return out


def _contexts(seq: list[str], at: int) -> list[int]:
    """Hashes of the 1..ORDER tokens that end at position ``at``."""
    return [xxhash.xxh64_intdigest("\x1f".join(seq[max(0, at - k + 1) : at + 1])) - (1 << 63) for k in range(1, min(ORDER, at + 1) + 1)]


SENTENCE_MARKS = frozenset(".!?。！？।")


def _end_counts(batches: Iterator[pa.RecordBatch], ordinary: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Counts, over the texts of a partition, of contexts followed by an end and by more text."""
    counts: dict[int, list[int]] = {}
    alike: Counter = Counter()  # texts that differ in names and numbers only are counted together

    def count() -> None:
        for seq, times in alike.items():
            for at in range(1, len(seq) - 1):  # an end without a mark is what is to be judged
                if seq[at] in SENTENCE_MARKS:
                    continue
                place = 0 if seq[at + 1] in SENTENCE_MARKS else 1
                for c in _contexts(seq, at):
                    n = counts.get(c)
                    if n is None:
                        n = counts[c] = [0, 0]
                    n[place] += times
        alike.clear()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        values = [counts[k] for k in keys]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())], names=["context", "ends", "goes_on"])

    for batch in batches:
        for query, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                alike[("<", *tokens(text, query, ordinary))] += 1
        if len(alike) > 20_000:
            count()
        if len(counts) > 400_000:
            yield flush()
    count()
    yield flush()


OPEN_TAIL = re.compile(r"(?:^|\s)[(“„«\[「『][^)”“»\]」』]{0,12}$")
BARE = re.compile(r"[-+−~≈]?\d+(?:[.,]\d+)*\s?[a-zA-Zµμ°%℃℉Ω/²³\"]{0,5}\*{0,2}$")


def _open_end(text: str, query: str | None, ordinary: frozenset[str]) -> list[int] | None:
    """Contexts at the end of a text that has no final mark, longest last; None where the text is closed or a bare value.

    A text that breaks off inside a quotation or bracket has no context: an empty list.
    """
    shown = text.rstrip().rstrip("*_` ")
    cut = re.sub(r"(?:\.{2,}|…)[\"'”’»)]*$", "", shown).rstrip()
    if OPEN_TAIL.search(cut) and not BARE.fullmatch(cut):
        return []
    if cut == shown and FINAL.search(shown):
        return None
    own = set(re.findall(r"[^\W_]+", folded(query or "")))
    value = BARE.search(shown)
    if value:
        before = re.findall(r"[^\W_]+", CODE.sub(" ", folded(shown[: value.start()])))
        if all(w in own and w not in ordinary or w.isdigit() for w in before):
            return None
    seq = ["<", *tokens(cut, query, ordinary)]
    return _contexts(seq, len(seq) - 1) if len(seq) > 1 else None


def frequent_words(predictions: DataFrame, share: float = 0.002, least: int = 3) -> frozenset[str]:
    """Words in at least ``share`` of the queries; the words of a query over ``share`` bound their number."""
    words = predictions.select(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"(\p{L}+)"), 1)).alias("w")).where("w is not null")
    n = words.count()
    rows = words.select(F.explode("w").alias("w")).groupBy("w").count().where(F.col("count") >= max(least, share * n)).select("w").collect()
    return frozenset(r.w for r in rows)


def broken_pairs(predictions: DataFrame, documents: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """(query_id, defect_type) of every defective pair.

    ``predictions`` has query_id, query, ground_truth and e2e_prediction (and, if there, oracle_prediction, which adds to the
    end statistics); ``documents`` has lang and text. An open end is truncated if its longest context seen at least twice was
    followed by an end in less than ``least`` of the cases, or if no context was seen.
    """
    spark = predictions.sparkSession
    model = spark.sparkContext.broadcast(fit_languages(documents, predictions, sample))
    ordinary = frequent_words(predictions)
    pairs = predictions.select("query_id", "query", "ground_truth", "e2e_prediction").dropDuplicates()
    texts = [c for c in ("e2e_prediction", "ground_truth", "oracle_prediction") if c in predictions.columns]
    complete = predictions.select("query", F.explode(F.array(*texts)).alias("text")).where("text is not null")
    ends = complete.mapInArrow(lambda batches: _end_counts(batches, ordinary), "context long, ends long, goes_on long").groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, opened = [], [], []
            for qid, query, truth, answer in zip(*(batch.column(k).to_pylist() for k in range(4))):
                contexts: list[int] | None = None
                if is_empty(answer):
                    kind = "empty"
                elif is_copy(query, answer):
                    kind = "copy"
                elif is_refusal(answer, query, truth):
                    kind = "refusal"
                elif wrong_language(model.value, query, answer):
                    kind = "wrong_language"
                else:
                    kind = None
                    if not (REFUSAL.search(answer.replace("’", "'")) or NO_ANSWER.match(answer.strip())):
                        contexts = _open_end(answer, query, ordinary)
                    if contexts is None:
                        continue
                ids.append(qid)
                kinds.append(kind)
                opened.append(contexts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(kinds, pa.string()), pa.array(opened, pa.list_(pa.int64()))], names=["query_id", "defect_type", "contexts"])

    # few rows pass, and they are read twice
    judged = cut_lineage(pairs.mapInArrow(judge, f"query_id {pairs.schema['query_id'].dataType.simpleString()}, defect_type string, contexts array<bigint>"))
    plain = judged.where("defect_type is not null").select("query_id", "defect_type")
    asked = judged.where("defect_type is null").select("query_id", F.posexplode_outer("contexts").alias("k", "context"))
    seen = asked.join(ends, "context", "left")
    enough = F.coalesce(F.col("ends") + F.col("goes_on"), F.lit(0)) >= 2
    share = seen.groupBy("query_id").agg(F.max_by(F.when(enough, F.col("ends") / (F.col("ends") + F.col("goes_on"))), F.when(enough, F.col("k"))).alias("share"))
    truncated = share.where(F.coalesce(F.col("share"), F.lit(0.0)) < least).select("query_id", F.lit("truncated").alias("defect_type"))
    return plain.unionByName(truncated)
