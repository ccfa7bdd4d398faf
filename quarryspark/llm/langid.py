"""Language identification by compression (operator 3).

Each language has a zstandard raw-content dictionary made of training texts. A text is lower-cased and cut into blocks of 4 KB, every
block is compressed with each dictionary, and the language with the smallest total wins. The margin to the second is
taken per byte of text; a narrow one rejects.

Training rows: of each language the `per_language` rows that come first by a hash of the id, of longer texts the first
`most_bytes` characters, until `dictionary_bytes` are full; the text that overfills a dictionary is cut there. Lines that
several languages have stay out, unless a language has no others. A language whose texts are blank gets no dictionary,
and a warning names it.

Defined results: a null text or one without a letter is `und` with score 0 and is rejected; ties go to the language that
sorts first and are rejected; no training rows: every text is `und` and is rejected; repeated rows, rows without an id and
several texts of one id are each judged by their own text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, labelled_sample

BLOCK, LEVEL, DICTIONARY_BYTES, PER_LANGUAGE, MOST_BYTES = 4096, 6, 112 << 10, 300, 64 << 10
#: Bytes saved per byte of text, against the second language, below which a text is rejected.
NARROW = 0.002


def dictionaries(texts, langs, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary per language: training texts in their order until it is full, without lines that several languages have."""
    out: dict[str, bytearray] = {}
    of_line: dict[str, set[str]] = {}
    rows = [((text or "").lower().split("\n"), lang) for text, lang in zip(texts, langs)]
    for lines, lang in rows:
        for line in lines:
            of_line.setdefault(line, set()).add(lang)
    own = {lang for lines, lang in rows if any(x.strip() and len(of_line[x]) == 1 for x in lines)}
    for lines, lang in rows:
        raw, have = "\n".join(x for x in lines if lang not in own or len(of_line[x]) == 1).encode("utf-8", "replace") + b"\n", out.setdefault(lang, bytearray())
        have += raw[: dictionary_bytes - len(have)]
    empty = sorted(k for k, v in out.items() if not v.strip())
    if empty:
        warnings.warn(f"no text to make a dictionary of for: {', '.join(empty)}", stacklevel=2)
    # zstandard takes raw content from 8 bytes on.
    return {k: bytes(v).ljust(9) for k, v in sorted(out.items()) if k not in empty}


class Judge:
    def __init__(self, content: dict[str, bytes]):
        import zstandard as z

        self.langs, self.coders = list(content), []
        for raw in content.values():
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected."""
        if not text or not self.coders or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        raw = text.lower().encode("utf-8", "replace")
        blocks = [raw[a : a + BLOCK] for a in range(0, len(raw), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.coders]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        margin = (sizes[order[1]] - sizes[order[0]]) / len(raw) if len(order) > 1 else 1.0
        return self.langs[order[0]], 1 - math.exp(-30 * margin), margin <= NARROW


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_bytes: int = MOST_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries from the rows of docs that have a language; docs: doc_id, text, lang, without rows kept back for tests."""
    rows = labelled_sample(docs, docs.select("doc_id", F.col("lang").alias("y")), per_language, most_bytes, cut=True)
    return dictionaries(rows["text"], rows["y"], dictionary_bytes)


def identify(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    known = docs.sparkSession.sparkContext.broadcast(content)  # a few languages of dictionary_bytes each

    def run(batches):
        judge = Judge(known.value)
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column("text")]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def judged(docs: DataFrame) -> DataFrame:
    """identify() with dictionaries learnt from four fifths of the same rows, and which rows were held out."""
    kept_back = held(F.col("doc_id"), 5, 0)
    return identify(docs, fit(docs.where(~kept_back))).withColumn("held_out", held(F.col("doc_id"), 5, 0))


def drop_unknown(docs: DataFrame) -> DataFrame:
    """docs without the rows that are rejected; all columns stay. Each row's own text decides, so nothing is shuffled."""
    known = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held(F.col("doc_id"), 5, 0))))

    @F.arrow_udf("boolean")
    def fits(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = Judge(known.value)
        for some in texts:
            yield pa.array([not judge(t.as_py())[2] for t in some], pa.bool_())

    return docs.where(fits("text"))
