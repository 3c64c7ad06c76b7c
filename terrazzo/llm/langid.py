"""Language identification by compression.

Each language has one raw-content zstandard dictionary: whole texts of a bounded sample of its
training rows, in order of hash, until ``most_bytes`` are reached. Shorter texts than that are
asked first, so one overlong text never fills a dictionary unless a language has no other. A
text, whole, is lower-cased and compressed in blocks against every dictionary; the
language whose blocks come out smallest is chosen. The margin is the saving over the second
smallest as a share of it; a margin below ``reject`` rejects the text.

Defined cases: a null text, or one without a letter (category L), is ``und``, rejected, with
score 0;
ties go to the language first in order of name; a table without labelled texts gives ``und``
everywhere; repeated rows get equal results.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import annotate, quoted

#: Bounds of the labelled sample: rows and bytes per language (a dictionary ends with the text that reaches them).
MOST_TEXTS, MOST_BYTES = 96, 98_304
#: Bytes that are compressed at once: short, so that the dictionary outweighs the text itself.
BLOCK = 1_024
REJECT = 0.004
_LETTER = regex.compile(r"\p{L}")
_SEED = 20_011


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", most_texts: int = MOST_TEXTS, most_bytes: int = MOST_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, from the training rows with the smallest hashes.

    The count of rows per language sets a threshold on the hash, so that about twice
    ``most_texts`` rows of each language leave the scan, however large the table is.
    """
    rows = docs.filter(train & quoted(lang).isNotNull() & quoted(text).isNotNull()).select(quoted(lang).cast("string").alias("l"), quoted(text).alias("t"), F.xxhash64(F.lit(_SEED), quoted(key)).alias("h"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy("l").collect()}
    if not counts:
        return {}
    # hashes are even over 2^20 slots; the floor of twice the texts keeps small tables whole
    share = F.element_at(F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1 << 20, (1 << 20) * (2 * most_texts + 16) // n + 1))]), F.col("l"))
    some = rows.filter((F.col("h").bitwiseAND(F.lit((1 << 20) - 1)) < share)).withColumn("size", F.octet_length("t"))
    order = W.partitionBy("l").orderBy(F.col("size") > most_bytes, "h", "t")
    some = some.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most_texts).withColumn("before", F.sum("size").over(W.partitionBy("l").orderBy("k")) - F.col("size"))
    out: dict[str, bytes] = {}
    for r in some.filter(F.col("before") < most_bytes).select("l", "k", "t").orderBy("l", "k").collect():
        out[r["l"]] = out.get(r["l"], b"") + r["t"].lower().encode() + b"\n"
    return {k: v for k, v in sorted(out.items()) if len(v) >= 8}


def _compressors(dictionaries: dict[str, bytes]) -> list[zstd.ZstdCompressor]:
    """One compressor per dictionary: short matches, greedy, so that common syllables count."""
    form = zstd.ZstdCompressionParameters(window_log=16, hash_log=15, chain_log=15, search_log=3, min_match=4, target_length=8, strategy=zstd.STRATEGY_FAST, write_checksum=0, write_content_size=0, write_dict_id=0)
    out = []
    for content in dictionaries.values():
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=form)
        out.append(zstd.ZstdCompressor(compression_params=form, dict_data=d))
    return out


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", reject: float = REJECT, keep: list[str] | None = None) -> DataFrame:
    """Append lang_pred, score (0.5 where the margin equals ``reject``), margin and rejected."""
    names = list(dictionaries)

    def run(texts: pa.Array) -> list:
        made = _compressors(dictionaries)
        langs, scores, margins, rejected = [], [], [], []
        for t in texts.to_pylist():
            if not t or not names or not _LETTER.search(t):
                langs.append("und"), scores.append(0.0), margins.append(0.0), rejected.append(True)
                continue
            data = memoryview(t.lower().encode())
            parts = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
            sizes = [sum([len(c.compress(p)) for p in parts]) for c in made]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            rest = min([s for i, s in enumerate(sizes) if i != best], default=2 * sizes[best])
            margin = (rest - sizes[best]) / rest
            langs.append(names[best]), scores.append(margin / (margin + reject) if margin else 0.0), margins.append(margin), rejected.append(margin < reject)
        return [langs, scores, margins, rejected]

    fields = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return annotate(df, run, [text], fields, keep)
