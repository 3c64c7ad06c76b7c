"""The pipeline's stages on the small sample, each against what it must keep."""

import random
import re
import unicodedata
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrazzo.llm import langid, quality_rules
from terrazzo.llm.columns import bucket_of

from .test_corpus_operators import _classes_of_all_pairs, _plain_verdicts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages_return_the_columns_of_documents(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.count() > 0


def test_filters_only_drop(stages):
    for before, after in zip(stages[:3], stages[1:4]):
        assert after.exceptAll(before).count() == 0


def test_clean_documents_stay(spark, stages):
    clean = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").join(stages[0].filter(F.size(F.split("text", r"\s+")) > 40), "doc_id")
    kept = stages[2].join(clean, "doc_id", "left_semi").count()
    assert kept >= 0.93 * clean.count()


def test_cut_texts_come_from_their_documents(stages):
    assert stages[4].count() == stages[3].count()
    both = stages[4].alias("a").join(stages[3].alias("b"), "doc_id")
    assert both.filter(F.length("a.text") > F.length("b.text")).count() == 0
    assert both.filter(F.col("a.n_chars") != F.length("a.text")).count() == 0


def test_every_document_is_packed(stages):
    assert stages[5].select("doc_id").distinct().count() == stages[4].count()
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def _plain_language(table, fitted):
    """Texts whose smallest dictionary leads by enough, block by block."""
    makers = langid._compressors(fitted)
    out = []
    for row in table:
        data = (row[1] or "").lower().encode()
        if not any(unicodedata.category(c).startswith("L") for c in row[1] or ""):
            continue
        sizes = sorted(sum(len(c.compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK)) for c in makers)
        if (sizes[1] - sizes[0]) / sizes[1] >= langid.REJECT:
            out.append(row)
    return out


def _plain_cut(table):
    """Texts without the bytes that a 100-byte string covers which starts earlier."""
    seen, out = set(), []
    for k, t, lang in sorted(table):
        data, gone = t.encode(), set()
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone.update(range(i, i + 100))
            seen.add(w)
        runs = "".join(" " if i in gone else "x" for i in range(len(data)))
        kept = [data[m.start() : m.end()].decode(errors="ignore") for m in re.finditer("x+", runs)]
        out.append((k, "".join(kept), lang))
    return out


def test_the_whole_run_is_that_of_plain_stages(spark, tmp_path):
    r = random.Random(31)
    lists = {"en": "the of and to in is that it for was on are as with", "de": "der die und in den von zu das mit sich des auf", "es": "de la que el en y los del se las por un con", "fr": "de la le et les des en un une du est que pour"}
    ends = {"en": ["ing", "tion", "er"], "de": ["ung", "lich", "en"], "es": ["ado", "mente", "ar"], "fr": ["eau", "aient", "eux"]}
    word = lambda x: r.choice(lists[x].split()) if r.random() < 0.5 else "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(2)) + r.choice(ends[x])
    text = lambda x, n: " ".join(word(x) for _ in range(n)).capitalize() + "."
    table = [(k, text(x, r.randint(12, 160)), x) for k, x in enumerate(sorted(lists) * 12)]
    passage = text("en", 40)
    table += [(100 + k, f"{text('en', 30)} {passage} {text('en', 30)}", "en") for k in range(5)]
    near = table[1][1].split()
    table += [(120, table[0][1], table[0][2]), (121, " ".join([*near[:-2], "changed", near[-1]]), table[1][2]), (122, None, "en"), (123, "", None), (124, "²½ 12 !!", None)]
    table += [(130 + k, " ".join(r.choice(["$$##", "17,5", "XX|", "QQZZ"]) + str(i) for i in range(60)), "en") for k in range(2)] + [(140, "the same words again here " * 12, "en"), (141, "too short to keep", "en")]
    rows = [(k, t, x, "s", len(t or "")) for k, t, x in table]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    kept = _plain_language(table, langid.fit(docs, F.coalesce(bucket_of(F.col("doc_id"), 5) != 0, F.lit(False))))
    good = [row for row, (_, ok) in zip(kept, _plain_verdicts([(t, x) for _, t, x in kept], quality_rules.Limits()), strict=True) if ok]
    classes = _classes_of_all_pairs(sorted((k, t) for k, t, _ in good))
    cut = _plain_cut([row for row in good if classes[row[0]] == row[0]])
    assert len(table) > len(kept) > len(good) > len(cut) > 30 and sum(len(t) for _, t, _ in cut) < sum(len(t) for k, t, _ in good if k in dict((c[0], 0) for c in cut))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t, _ in cut}
    assert {(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in found} == {(k, 0, 0, len(v), zlib.crc32(v.tobytes())) for k, v in ids.items()}
    by = {}
    for x in found:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in by.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096
    assert len(by) <= -(-sum(map(len, ids.values())) // 4096) + 1


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, id string, sequence_id long, rejected int"


def test_an_empty_table_goes_through_all_stages(spark):
    docs = spark.createDataFrame([], EXTRA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == EXTRA.replace(" long", "").replace(" string", "").replace(" boolean", "").replace(" int", "").split(", ")
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_columns_named_like_results_stay_as_they_are(spark, stages):
    some = stages[0].limit(120)
    docs = some.withColumn("size", F.lit(7).cast("long")).withColumn("id", F.lit("x")).withColumn("sequence_id", F.lit(3).cast("long")).withColumn("class_id", F.lit(5))
    wide, plain = docs, some
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide, plain = stage(spark, wide, SF).cache(), stage(spark, plain, SF).cache()
        assert wide.columns == docs.columns
        assert sorted(r.doc_id for r in wide.collect()) == sorted(r.doc_id for r in plain.collect())
    assert wide.filter((F.col("size") == 7) & (F.col("id") == "x") & (F.col("sequence_id") == 3) & (F.col("class_id") == 5)).count() == wide.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() == corpus_pipeline.STAGES[-1][1](spark, plain, SF).count()
