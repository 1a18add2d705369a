"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sampled texts.  A text is cut into
blocks, each block is compressed with every dictionary, and the language with the
smallest total wins: a dictionary of the text's own language has the words to refer to.
Blocks keep the dictionaries at work throughout long texts.  The score is 1 - best/second.
A text is rejected if it is null, has no letter, or its margin is narrow (below
``min_margin``).

The dictionaries come from at most ``per_language`` labelled documents of each language,
taken whole by the smallest hashes of their texts (copies count once): a fitting sample only, every text is
judged whole.  The driver holds that sample; a column of more than ``max_languages``
languages (a dirty one, most likely) is refused with an error before anything is gathered.

Edges: null or letterless texts give ``und``, score 0, rejected; ties go to the language
first in the alphabet and have score 0; without labelled texts every text is ``und``;
repeated rows are judged alike; rows with a null id are left out; ill-formed UTF-8 is read as
U+FFFD, which is no letter.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import frugal, texts_of

UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def _letters(text: str) -> str:
    """Lower-case words by single spaces: capitals, digits and punctuation tell no language."""
    return _NO_LETTERS.sub(" ", text.lower())


def fit(labelled: DataFrame, per_language: int = 96, max_languages: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary bytes by language; a bounded sample of each language goes to the driver."""
    own = labelled.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    marks = own.select(F.xxhash64(text_col).alias("h"), F.col(lang_col).alias("lang"))
    if marks.select("lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"{lang_col} has more than {max_languages} values")
    # A common language is first ranked in 32 shares of its partitions: no task gets the candidates of all of them.
    picked = marks.distinct().withColumn("share", F.spark_partition_id() % 32)
    for by in (["lang", "share"], ["lang"]):
        picked = picked.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("k") <= per_language).drop("k")
    picked = picked.select("h", "lang")
    texts = own.select(F.xxhash64(text_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    by_lang: dict[str, set[str]] = {}
    # At most per_language * max_languages hashes: the texts stay where they are.
    for r in texts.join(F.broadcast(picked), ["h", "lang"]).distinct().collect():
        by_lang.setdefault(r["lang"], set()).add(bytes(r["text"]).decode("utf-8", "replace"))
    return {lang: " ".join(map(_letters, sorted(texts))).encode() for lang, texts in sorted(by_lang.items())}


class Judge:
    def __init__(self, dictionaries: dict[str, bytes], block: int = 2000, level: int = 3) -> None:
        self.langs, self.block = sorted(dictionaries), block
        params = zstandard.ZstdCompressionParameters.from_level(level, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.press = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.press.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        data = _letters(text).encode()
        blocks = [data[at : at + self.block] for at in range(0, len(data), self.block)]
        return [sum(len(p.compress(b)) for b in blocks) for p in self.press]

    def __call__(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        order = sorted(zip(self.sizes(text), self.langs))
        if len(order) == 1:
            return order[0][1], 1.0
        return order[0][1], 1 - order[0][0] / order[1][0]


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.003, id_col: str = "doc_id", text_col: str = "text",
    names: tuple[str, str, str] = ("lang_pred", "score", "rejected"),
) -> DataFrame:
    """All columns of ``docs`` plus the language, its score and whether it is rejected, under ``names``.

    A column of ``docs`` that has such a name already is an error: give others.
    """
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have columns {sorted(clash)} already")
    keep = docs.filter(F.col(id_col).isNotNull())
    at = keep.columns.index(text_col)
    clean = [f"c{i}" for i in range(len(keep.columns))]  # any column names
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(clean, keep.schema.fields))
    cast = keep.toDF(*clean)

    def run(batches):
        judge = Judge(dictionaries)
        for b in batches:
            found = [judge(t) for t in texts_of(b.column(at))]
            langs, scores = [x[0] for x in found], [x[1] for x in found]
            rejected = [lang == UNKNOWN or s < min_margin for lang, s in found]
            yield pa.record_batch([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*clean, "r0", "r1", "r2"])

    return cast.mapInArrow(frugal(run), f"{schema}, r0 string, r1 double, r2 boolean").toDF(*keep.columns, *names)
