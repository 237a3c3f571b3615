"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of the words of a bounded sample of
labelled texts, read whole: the words that most of them hold, the commonest last, where they are
cheapest to refer to. A text, without anything but letters and in lower case, is compressed in blocks
of ``block`` bytes with each dictionary; the language that gives the fewest bytes wins. The margin is
the runner-up's excess in parts of the winner's bytes; below ``min_margin`` the prediction is rejected
as unsure.

A null text and one without letters (Unicode category L) is ``und`` with score 0, and rejected. Ties
go to the language that sorts first (margin 0: rejected). With no labelled texts at all everything is
``und``. Whole texts are used, also very long ones; repeated rows each give a row. A null id is no
reason to leave a row out. Other columns are passed on or not looked at, whatever their names. An
empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigevents.llm.common import id_crc32, tidied

_not_letters = re.compile(r"[\W\d_]+")
UND = "und"


def letters_only(text: str | None) -> bytes:
    """Runs of letters, in lower case, with a space between."""
    words = _not_letters.sub(" ", text.lower()).strip() if text else ""
    if not words.isascii() and not words.replace(" ", "").isalpha():  # other numbers, such as fractions
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return words.encode()


def learn_dictionaries(docs: DataFrame, train: Column, rows_per_language: int = 600, dictionary_bytes: int = 1 << 15) -> dict[str, bytes]:
    """Raw content for each language, from the words of about ``rows_per_language`` whole texts.

    The sample is taken by a threshold on a hash of the row, one for each language from its number of
    rows, so no language is gathered or sorted. What the driver gets is bounded by
    ``dictionary_bytes`` a language.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("hash"))
    shares = [(r.lang, min(1.0, rows_per_language / r["count"])) for r in rows.groupBy("lang").count().collect()]
    if not shares:
        return {}
    share = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    picked = rows.join(F.broadcast(share), "lang").where(F.pmod("hash", F.lit(1 << 31)) < F.col("share") * (1 << 31))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, bytes]] = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.update((lang, w) for w in set(letters_only(text).split()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1].decode() for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    words = picked.select("lang", "text").mapInArrow(tidied(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")  # the words of a sample
    top = words.withColumn("r", F.row_number().over(order)).where(F.col("r") <= dictionary_bytes // 2).collect()
    content: dict[str, list[bytes]] = {}
    for r in sorted(top, key=lambda r: (r.lang, -r.r)):
        content.setdefault(r.lang, []).append(r.word.encode())
    return {k: b" ".join(v)[-dictionary_bytes:] for k, v in content.items()}


class Classifier:
    """Compressors with the languages' dictionaries, loaded once."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = 4096):
        self.names, self.block = list(dictionaries), block
        self.squeeze = []
        for raw in dictionaries.values():
            # matches of four bytes: parts of words are what tells languages apart
            how = zstandard.ZstdCompressionParameters.from_level(5, dict_size=len(raw), source_size=block, strategy=zstandard.STRATEGY_GREEDY, min_match=4, write_checksum=False, write_content_size=False, write_dict_id=False)
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.squeeze.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress)

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score in 0..1, margin."""
        raw = letters_only(text)
        if not raw or not self.names:
            return UND, 0.0, 0.0
        parts = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        cost = np.array([sum([len(f(p)) for p in parts]) for f in self.squeeze], float)
        best = int(cost.argmin())
        others = np.delete(cost, best)
        margin = float((others.min() - cost[best]) / cost[best]) if len(others) else 1.0
        score = 1 / np.exp(-20 * (cost - cost[best]) / cost[best]).sum()
        return self.names[best], float(score), margin


def judged(docs: DataFrame, train: Column, block: int = 4096, **bounds: int):
    """For mapInArrow tasks: what gives the judgements of a batch's texts, by dictionaries learned from ``docs``."""
    dictionaries, held = docs.sparkSession.sparkContext.broadcast(learn_dictionaries(docs, train, **bounds)), []

    def judge(batch: pa.RecordBatch) -> list[tuple[str, float, float]]:
        if not held:
            held.append(Classifier(dictionaries.value, block))
        return [held[0].judge(t) for t in batch.column("text").to_pylist()]

    return judge


def identify(docs: DataFrame, train: Column, min_margin: float = 0.002, **how: int) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of ``docs`` (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    judge = judged(docs, train, **how)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = judge(batch)
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] == UND or g[2] < min_margin for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(tidied(predict), "doc_id long, lang_pred string, score double, rejected boolean")


def of_known_language(docs: DataFrame, train: Column, min_margin: float = 0.002, **how: int) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is not rejected."""
    judge = judged(docs, train, **how)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([g[0] != UND and g[2] >= min_margin for g in judge(batch)], pa.bool_()))

    return docs.mapInArrow(tidied(keep), docs.schema)


def held_out() -> Column:
    return id_crc32("doc_id") % 4 == 2


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    found = identify(docs, ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
