"""Toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts to Latin, digits and signs
that stand for letters back to letters where they touch letters. The lexicon is learned: words that
more labelled toxic than clean documents hold, weighted by their log-odds. Phrases in which a
lexicon word is harmless (seen in clean documents only) are exceptions: their words do not count.
A text's score is a logistic function of the logarithm of its summed weights, normalised by its length.

Null and empty texts get the score of a text without matches. Labels that are null are not learned
from; repeated labels of a document are learned once for each. Without labels of both classes all
scores are next to 0. Repeated rows each give a row with the same score; a null id is scored, and
held out or not as crc32 of no text. Ties do not occur: each row has its own score. Texts of any
length are matched whole. Other columns of either table are not looked at. An empty table gives an
empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigevents.llm.common import id_crc32, stored, tidied

# Letters of other scripts that look like Latin ones, and what they look like.
LOOK_ALIKES = str.maketrans("авекмнорстухіјѕԁɡαεικνορτυχ" + "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ", "abekmhopctyxijsdgaeikvoptux" + "abcdefghijklmnopqrstuvwxyz")
# Signs written for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# A sign that a letter follows, and that a letter, nothing word-like, or a letter and a digit precede.
_sign_in_word = re.compile(r"[0134578@$!](?=[^\W\d_])(?:(?<=[^\W\d_].)|(?<![\w@$!].)(?<!!)|(?<=[^\W\d_][0134578][0134578]))")
_hidden = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_look_alike = re.compile("[" + "".join(map(chr, LOOK_ALIKES)) + "]")
find_words = re.compile(r"[^\W\d_]+").findall


def fold(text: str) -> str:
    """The text as it is read: see the module's docstring."""
    text = text.lower()
    if not text.isascii():
        text = _hidden.sub("", text)
        if _look_alike.search(text):
            text = text.translate(LOOK_ALIKES)
    return _sign_in_word.sub(lambda m: SIGNS[m[0]], text)


def _document_counts(rows: DataFrame, weight: str, words: set[str] | None) -> DataFrame:
    """word, n: the summed ``weight`` of the documents that hold each word (of ``words``, if given)."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text, n in zip(batch.column("text").to_pylist(), batch.column(weight).to_pylist(), strict=True):
                found = find_words(fold(text)) if text else ()
                for w in set(found) if shared.value is None else shared.value.intersection(found):
                    seen[w] += n
            if len(seen) > 300_000:
                yield flush()
                seen.clear()
        if seen:
            yield flush()

    return rows.where(F.col(weight) > 0).select("text", weight).mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def labelled(docs: DataFrame, labels: DataFrame, train: Column, label_rows: int) -> DataFrame:
    """text, pos, neg: the texts of labelled documents and how often each is labelled toxic and clean.

    The fit takes a sample of about ``label_rows`` labelled ids, chosen by a hash, so the side that
    is broadcast is bounded and texts are nowhere shuffled. A repeated label counts once for each.
    """
    marks = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(train)
    marks = stored(marks.groupBy("doc_id").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg")), "marks")
    n = marks.count()
    if n > label_rows:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (label_rows << 20) // n)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id").select("text", "pos", "neg")


def learn(docs: DataFrame, labels: DataFrame, train: Column, min_share: float = 0.006, min_log_odds: float = 2.0, label_rows: int = 1_000_000) -> dict:
    """The lexicon's weights, the exceptions and the logistic constants.

    A word of the lexicon is in ``min_share`` of the toxic documents (in three at least), which keeps
    out the words of a single text and its copies, so candidates are no more than a document's
    distinct words in the mean over ``min_share``. Whole texts are read three times: for the words of
    toxic documents, for the candidates in clean ones, and for the places of the lexicon's words,
    which are stored with their neighbours; exceptions and constants are found from those.
    """
    marked = labelled(docs, labels, train, label_rows)
    n_t, n_c = marked.agg(F.sum("pos"), F.sum("neg")).first()
    if not n_t or not n_c:
        return {"weights": {}, "exceptions": [], "a": -20.0, "b": 0.0}
    min_docs = max(3, math.ceil(min_share * n_t))
    t = {r.word: r.n for r in _document_counts(marked, "pos", None).where(F.col("n") >= min_docs).collect()}
    c = {r.word: r.n for r in _document_counts(marked, "neg", set(t)).collect()}
    odds = {w: math.log((n + 0.5) / (n_t + 1)) - math.log((c.get(w, 0) + 0.5) / (n_c + 1)) for w, n in t.items()}
    # beyond the odds, the words must be rare among clean documents, whatever the copies
    weights = {w: x for w, x in odds.items() if x >= min_log_odds and t[w] >= 4 * c.get(w, 0)}
    places = stored(word_places(marked, weights), "places")
    phrases = places.select("pos", "neg", F.explode(F.array_distinct(F.flatten(F.transform("found", lambda x: F.filter(F.array(x["before"], x["after"]), lambda p: p != ""))))).alias("phrase"))
    phrases = phrases.groupBy("phrase").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where((F.col("pos") == 0) & (F.col("neg") >= min_docs))
    model = {"weights": weights, "exceptions": sorted(r.phrase for r in phrases.collect())}
    return model | fit(places, model)


def automaton(model: dict) -> ahocorasick.Automaton | None:
    """Words and exception phrases in one automaton."""
    if not model["weights"]:
        return None
    auto = ahocorasick.Automaton()
    for w, x in model["weights"].items():
        auto.add_word(w, (w, x))
    for phrase in model["exceptions"]:
        auto.add_word(phrase, (phrase, 0.0))
    auto.make_automaton()
    return auto


def whole_words(folded: str, auto: ahocorasick.Automaton) -> Iterator[tuple[int, int, str, float]]:
    """Matches that no letter adjoins: begin, end (exclusive), what, weight."""
    n = len(folded)
    for last, (what, x) in auto.iter(folded):
        begin, end = last - len(what) + 1, last + 1
        if not ((begin and folded[begin - 1].isalpha()) or (end < n and folded[end].isalpha())):
            yield begin, end, what, x


def normal_length(folded: str) -> float:
    """What summed weights are divided by: 1 up to 50 words, then the fourth root of the words in units of 50."""
    return max(1.0, folded.count(" ") / 50) ** 0.25


def strength(text: str | None, auto: ahocorasick.Automaton | None) -> float:
    """Summed weights of the whole-word matches outside exceptions, normalised by length."""
    if not text or auto is None:
        return 0.0
    folded = fold(text)
    found, harmless = [], []
    for m in whole_words(folded, auto):
        (found if m[3] else harmless).append(m)
    if harmless:
        found = [f for f in found if not any(h[0] <= f[0] and f[1] <= h[1] for h in harmless)]
    return sum(f[3] for f in found) / normal_length(folded) if found else 0.0


def _phrase(folded: str, begin: int, end: int, step: int) -> str:
    """A match with the word before (step -1) or after it, if one space parts them; else empty."""
    at = begin - 1 if step < 0 else end
    if not 0 < at < len(folded) - 1 or folded[at] != " " or not folded[at + step].isalpha():
        return ""
    far = at + step
    while 0 <= far < len(folded) and folded[far].isalpha():
        far += step
    return folded[far + 1 : end] if step < 0 else folded[begin:far]


def word_places(marked: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A row for each labelled document: pos, neg, its normal length, and its lexicon words, each with the phrases it is in."""
    shared = marked.sparkSession.sparkContext.broadcast(weights)
    place = pa.struct([("word", pa.string()), ("before", pa.string()), ("after", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton({"weights": shared.value, "exceptions": []})
        for batch in batches:
            found, length = [], []
            for text in batch.column("text").to_pylist():
                folded = fold(text or "")
                length.append(normal_length(folded))
                found.append([{"word": w, "before": _phrase(folded, b, e, -1), "after": _phrase(folded, b, e, 1)} for b, e, w, _ in whole_words(folded, auto)] if auto and folded else [])
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("neg"), pa.array(length, pa.float64()), pa.array(found, pa.list_(place))], names=["pos", "neg", "length", "found"])

    return marked.select("text", "pos", "neg").mapInArrow(tidied(run), "pos long, neg long, length double, found array<struct<word:string,before:string,after:string>>")


#: Logarithms of strengths are counted in steps of this size for the fit.
STEP = 0.05


def fit(places: DataFrame, model: dict) -> dict:
    """Logistic constants from counts of labelled documents by log strength (a small histogram), by Newton's method."""
    shared = places.sparkSession.sparkContext.broadcast((model["weights"], set(model["exceptions"])))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, harmless), seen = shared.value, Counter()
        for batch in batches:
            for pos, neg, length, found in zip(*(batch.column(c).to_pylist() for c in ("pos", "neg", "length", "found")), strict=True):
                s = sum(weights[x["word"]] for x in found if x["before"] not in harmless and x["after"] not in harmless) / length
                k = round(math.log1p(s) / STEP)
                seen[k, 1] += pos
                seen[k, 0] += neg
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["bin", "y", "n"])

    rows = places.mapInArrow(bins, "bin int, y int, n long").groupBy("bin", "y").agg(F.sum("n").alias("n")).collect()
    a, b = -3.0, 2.0
    for _ in range(100):
        ga = gb = haa = hab = hbb = 0.0
        for r in rows:
            x, y = r.bin * STEP, float(r.y == 1)
            p = 1 / (1 + math.exp(-max(-30, min(30, a + b * x))))
            w = p * (1 - p) + 1e-9
            ga, gb = ga + r.n * (p - y), gb + r.n * (p - y) * x
            haa, hab, hbb = haa + r.n * w, hab + r.n * w * x, hbb + r.n * w * x * x
        gb, hbb, haa = gb + 0.1 * b, hbb + 0.1, haa + 1e-3  # a light pull to zero: classes may be separable
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - max(-2, min(2, da)), b - max(-1, min(1, db))
        if abs(da) + abs(db) < 1e-9:
            break
    return {"a": a, "b": b}


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        auto = automaton(m)
        for batch in batches:
            s = [1 / (1 + math.exp(-max(-30, min(30, m["a"] + m["b"] * math.log1p(strength(t, auto)))))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, score double")


def held_out() -> Column:
    return id_crc32("doc_id") % 3 == 1


def toxicity_table(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = learn(docs, labels, ~held_out())
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
