"""Spelling variants, collocations and tiered packing against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from terrazzo.llm import collocations, spelling, tiers

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("tier", T.StringType()), T.StructField("id", T.StringType()), T.StructField("phrase", T.StringType())])


def _rows():
    r = random.Random(5)
    syllables = "the an tion ing er re on at en nd ing tha".split()
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(120)]
    words += [w[:2] + w[3:] for w in words[:40]] + [w + "s" for w in words[:20]] + ["Écolière", "ÉCOLIÈRE", "écolièrs", "école—école", "naïveté", "naivetés", "×÷ßßßß", "aabbcc", "abbcc", "aabbccc"]
    texts = [" ".join(r.choice(words) + r.choice(["", "", "", ".", ", ", "\n", "\t"]) for _ in range(r.randint(1, 400))) for _ in range(60)]
    texts += [None, "", " \n\t ", ".,;:!?\r\n", "x" * 70_000, "Naïveté naïveté " * 300, "new york city " * 40 + "new york. " * 5, "The THE the\x00the\x0bthe", " ".join(words * 40), texts[0], texts[1]]
    rows = [(k, t, ["en", "fr", None][k % 3], "w", 1, "t", "x", None) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[4], "en", None, None, None, None, "p")]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11 -- spelling variants


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def _variants(table, one_in, ratio=5):
    n = Counter()
    for key, text in table:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = _lower(w)
            h = zlib.crc32(f"{key}:{w}".encode())
            if key is not None and one_in and h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    letters = {c for w in n for c in w}
    out, form = {}, {}
    for w in n:
        near = {w[:i] + c + w[i + j :] for i in range(len(w) + 1) for j in (0, 1) for c in [*letters, ""]} & n.keys() - {w}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = [form[w], None, n[w], len(near), n.get(form[w])]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return out


@pytest.mark.parametrize("range_words", [20_000, 7])
@pytest.mark.parametrize("one_in", [199, 3, None])
def test_variants_are_those_of_all_edits(docs, rows, one_in, range_words):
    found = spelling.group_variants(docs, drop_one_in=one_in, range_words=range_words).collect()
    assert {r["word"]: [r["form"], r["root"], r["n"], r["n_near"], r["form_n"]] for r in found} == _variants([r[:2] for r in rows], one_in)
    assert len(found) == len({r["word"] for r in found})


def test_roots_are_at_the_end_of_their_chains(spark):
    chain = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15_625}
    docs = spark.createDataFrame([(1, " ".join(w for w, n in chain.items() for _ in range(n)))], "doc_id long, text string")
    found = {r["word"]: (r["form"], r["root"]) for r in spelling.group_variants(docs, drop_one_in=None).collect()}
    words = list(chain)
    assert found == {w: (words[k + 1] if k + 1 < len(words) else None, "abbbbb") for k, w in enumerate(words)}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=60), st.binary(min_size=2, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)))
def test_automata_number_words_and_find_one_error(words, asked):
    words = sorted(words)
    own = spelling.Automaton(words)
    assert [own.number(w) for w in words] == list(range(len(words)))
    assert own.number(asked) == (words.index(asked) if asked in words else None)
    kept = len(asked) // 2
    near = {asked[:i] + c + asked[i + j :] for i in range(kept, len(asked) + 1) for j in (0, 1) for c in (b"a", b"b", b"c", b"")} - {asked}
    assert {words[k] for k in own.one_error(asked, kept)} == near & set(words)


def test_automata_share_endings():
    assert len(spelling.Automaton(sorted(a + b"ation" for a in (b"cre", b"don", b"loc", b"not"))).arcs) < 20


def test_no_words(empty):
    assert spelling.group_variants(empty).collect() == []


# 12 -- collocations


def _collocations(table, top=2000):
    f, n = Counter(), Counter()
    for text, lang in table:
        for piece in re.split("[.,;:!?\n-\r]", _lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2 or a < 10 or any(x[0] == lang and len(x[1]) > len(w) and w in (x[1][:2], x[1][1:]) and b >= 10 and 100 * b >= 50 * a for x, b in f.items() if len(x[1]) == 3):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    out.sort()
    seen, ranked = Counter(), []
    for lang, score, a, phrase, l, r, total in out:  # noqa: E741
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, l, r, total, -score))
    return ranked


@pytest.mark.parametrize("block_words", [1 << 21, 500])
def test_collocations_are_those_of_plain_counts(docs, rows, block_words, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(collocations, "BUCKET_KEYS", 4_000)
    found = sorted(tuple(r) for r in collocations.collocations(docs).collect())
    plain = _collocations([(r[1], r[2]) for r in rows])
    assert len(plain) > 50
    assert found == sorted(plain)


def test_first_phrases_only(docs, rows):
    assert sorted(tuple(r) for r in collocations.collocations(docs, top=7).collect()) == sorted(_collocations([(r[1], r[2]) for r in rows], 7))


def test_longer_phrases(spark):
    docs = spark.createDataFrame([(k, "a b c d e. b c d x. e a b c d") for k in range(12)], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    totals, tables = collocations.phrases(docs, longest=5)
    found = {" ".join(r["words"]): (r["f"], r["before"], r["after"]) for t in tables for r in t.collect()}
    assert found["a b c d e"] == (12, [24, 24, 24, 24], [24, 12, 12, 12])
    assert found["b c d"] == (36, [36, 36], [36, 36])
    assert "e b" not in found
    assert totals.first()["n"] == 12 * 14


def test_collocations_by_sql(docs, rows, spark):
    db = duckdb.connect()
    documents = docs.toPandas()
    db.register("documents", documents)
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == sorted(db.execute(collocations.ORACLE).fetchall())


def test_scores_are_exact_beyond_64_bits(spark):
    r = random.Random(2)
    counts = [(a, a + r.randrange(10**k), a + r.randrange(10**k)) for k in range(1, 13) for a in (r.randrange(1, 10**k), 10**k - 1)]
    found = spark.createDataFrame(counts, "a long, l long, r long").select("a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x["s"] == 1_000_000 * x["a"] ** 2 // (x["l"] * x["r"]) for x in found)


def test_no_phrases(empty):
    assert collocations.collocations(empty).collect() == []


# 13 -- tiers


def _checked(found, ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["tier"] == own[0]["tier"] and r["step_group"] == own[0]["step_group"]
            at += r["length"]
        assert at == own[0]["tier"] <= 2048 and at & (at - 1) == 0
    return by_doc, by_sequence


def test_tiers_hold_every_id_once(docs, rows):
    found = tiers.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, _ = _checked(found, None)
    texts = defaultdict(list)
    for k, t, *_ in rows:
        texts[k].append(t)
    assert by_doc.keys() == texts.keys()
    for k, own in by_doc.items():
        if len(set(texts[k])) == 1:
            ids = np.array([*tokenizer.encode(texts[k][0] or "", add_special_tokens=False).ids, 1], "<u4")
            spans = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in own)
            covered = Counter(x for s, n, *_ in spans for x in range(s, s + n))
            assert covered == dict.fromkeys(range(len(ids)), len(texts[k]))
            assert all(crc == zlib.crc32(ids[s : s + n].tobytes()) and total == len(ids) for s, n, crc, total in spans)


def test_no_tiers(empty):
    assert tiers.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_ids_are_the_tokenizers():
    own, tokenizer = tiers.byte_tokens(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    odd = "aZé中\U0001f600 \t\n\r\x0b  ‍0٣½'sS<|endoftext|>-_ςΣ́한\x00\x7f͸"
    for _ in range(4_000):
        text = "".join(r.choice([*odd, "<|endoftext|>", "word", " the", "'ll", "  "]) for _ in range(r.randint(0, 25)))
        assert own.ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], repr(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 9_000), st.integers(1, 300)), max_size=80))
def test_blocks_are_packed_without_padding(lengths):
    found = tiers.pack_block(lengths)
    covered = Counter((d, x) for own in found for d, s, n in own for x in range(s, s + n))
    assert covered == {(d, x): 1 for d, n in enumerate(lengths) for x in range(n)}
    sizes = Counter(sum(n for *_, n in own) for own in found)
    assert all(n & (n - 1) == 0 and n <= 2048 for n in sizes)
    # what is left over at the end is one sequence for each power of two
    assert sum(sizes[n] for n in sizes if n < 256) <= 8
    # each window is cut once at most
    assert sum(len(own) for own in found) - len(lengths) <= 2 * len(found)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.sampled_from([2048, 1024, 512, 256, 64, 1]), st.integers(0, 5_000)), st.integers(1, 90))
def test_step_groups_are_alike(counts, groups):
    load, dealt = np.zeros(groups, np.int64), Counter()
    for tier, rank, each, first, n in tiers.deal(counts, groups):
        assert rank == dealt[tier] and first + n <= groups
        dealt[tier] += each * n
        load[first : first + n] += each * tier
    assert dealt == {t: n for t, n in counts.items() if n}
    assert load.max() - load.min() <= max((t for t, n in counts.items() if n), default=0)
