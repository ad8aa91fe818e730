"""Language identification by compression.

One raw-content zstandard dictionary is filled for every language from a bounded sample of labelled texts. A text is
cut into segments, each segment is compressed with every dictionary, and the language whose dictionary gives the
smallest total wins. A text whose runner-up is nearly as small is rejected.

Edge cases: a null text, an empty one or one without a letter (Unicode category L: numerals like ½ or ① are none) gets
`und`, score 0, and is rejected. With no labelled row nothing can be learned and every row gets `und`. Equal sizes go to
the language that sorts first. Rows that repeat are judged alike, each on its own; a null doc_id is kept. Long texts are
read whole, a segment at a time. Other columns of the input are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.operators.scratch import small

from .common import first_by_hash, held_out

UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_REPEATED_WORD = re.compile(r"(?<!\S)(\S+)(?: \1(?!\S))+")


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary content by language; segment and level are those of the compressor."""

    dictionaries: dict[str, bytes]
    segment: int = 8192
    level: int = 6
    #: (runner-up - best) / best, below which a text is rejected.
    min_margin: float = 0.004
    _tools: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_tools": []}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def _compressors(self) -> list:
        if not self._tools:
            for _, content in sorted(self.dictionaries.items()):
                content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(level=self.level)
                self._tools.append(zstandard.ZstdCompressor(level=self.level, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self._tools

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin, and whether the text is accepted."""
        plain = normalised(text)
        if not self.dictionaries or not _LETTER.search(plain):
            return UNKNOWN, 0.0, 0.0, False
        raw = plain.encode("utf-8", "replace")
        segments = [raw[i : i + self.segment] for i in range(0, len(raw), self.segment)]
        sizes = [sum(len(tool.compress(s)) for s in segments) for tool in self._compressors()]
        best = min(sizes)
        lang = sorted(self.dictionaries)[sizes.index(best)]
        if len(sizes) == 1:
            return lang, 1.0, 1.0, True
        margin = (sorted(sizes)[1] - best) / best
        score = 1.0 / sum(math.exp(-min(40.0 * (s - best) / best, 700.0)) for s in sizes)
        return lang, score, margin, margin >= self.min_margin


def normalised(text: str | None) -> str:
    """Lower case, every run of other characters than letters and their marks as one space, a word that follows itself once."""
    return _REPEATED_WORD.sub(r"\1", _NOT_LETTERS.sub(" ", (text or "").lower()))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents_per_language: int = 400, dictionary_bytes: int = 1 << 17, **options) -> LanguageModel:
    """Fill the dictionaries from documents_per_language labelled rows of each language, the first by a hash of the id.

    Held-out rows are never read; of rows that repeat a chosen id the excerpt that sorts first counts. Every sampled text gives an excerpt from a place set by its id's hash, all of one
    length, so that the dictionary holds as many documents as were sampled.
    """
    excerpt = max(64, dictionary_bytes // documents_per_language)
    named = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(~held_out(F.col("id")) & F.col("lang").isNotNull())
    named = named.withColumn("h", F.xxhash64(F.col("id").cast("string")))
    chosen = first_by_hash(named.select("lang", "id", "h"), "lang", documents_per_language).select("lang", "id")
    # At most documents_per_language ids a language.
    sample = named.join(small(chosen), ["lang", "id"], "left_semi")
    start = F.pmod("h", F.greatest(F.length("text") - excerpt, F.lit(0)) + 1).cast("int") + 1
    # One excerpt an id, so rows that repeat a chosen id can't add up.
    rows = sample.where("text is not null").groupBy("lang", "id", "h").agg(F.min(F.substring(F.col("text"), start, F.lit(excerpt))).alias("part")).collect()
    parts: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.h, r.part)):
        parts.setdefault(row.lang, []).append(normalised(row.part).strip())
    filled = {lang: " ".join(p for p in texts if p).encode()[:dictionary_bytes] for lang, texts in parts.items()}
    return LanguageModel({lang: content for lang, content in filled.items() if len(content) >= 8}, **options)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, accepted) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            langs, scores, margins, kept = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(kept, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "margin", "accepted"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, margin double, accepted boolean")


def keep_accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language was accepted. Nothing is shuffled."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.predict(t.as_py())[3] for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
