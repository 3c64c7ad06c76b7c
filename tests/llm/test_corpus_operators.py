"""Each corpus operator against a plain version, on small tables with every odd case."""

import base64
import bisect
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from terrazzo.llm import bpe, knn_quality, langid, maxent_lm, media, packing, probminhash, quality_rules, suffix_dedup, url_filter

WORDS = "the of and to in is that it for was der die und den von la de que el en".split()
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("size", T.LongType()), T.StructField("id", T.StringType())])


def _prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "er", "ing", "."]) for _ in range(n))


def _texts():
    base = _prose(1, 120)
    near = base.split()
    near[60] = "changed"
    long = "\n".join(_prose(s, 40) for s in range(30))
    return [base, base, " ".join(near), None, "", " \n\t ", "word", "a b c", "####", "ünï çödé   中文 \U0001f600 don't we'll", _prose(2, 80) + " " + base[:400], long, long, "x" * 5000, "ab " * 300, "line one\nline one\nline two\n\nline one", _prose(3, 15), "THE OF AND!! " * 20, "9" * 130 + " " + "9" * 130]


@pytest.fixture(scope="module")
def rows():
    out = [(k, t, "en" if k % 3 else None, "s", None, "clash", 1, "x") for k, t in enumerate(_texts())]
    return [*out, (None, "no id here but some words to keep in mind", "en", None, 1, None, None, None), out[0], (3, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


# 1 -- near-duplicates


def _set(text):
    w = (text or "").lower().encode().split()
    return {tuple(w[i : i + 5]): 0 for i in range(max(1, len(w) - 4))}.keys() if w else set()


def test_probability_jaccard_is_the_defining_sum():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 30, r.integers(1, 25)).astype(np.uint32)) for _ in range(2))
        wa, wb = (dict(zip(x.tolist(), r.integers(1, 5, len(x)) / 1.5)) for x in (a, b))
        every = wa.keys() | wb.keys()
        plain = sum(1 / sum(max(wa.get(d, 0) / wa[e], wb.get(d, 0) / wb[e]) for d in every) for e in wa.keys() & wb.keys())
        found = probminhash.probability_jaccard((a, np.array([wa[x] for x in a.tolist()])), (b, np.array([wb[x] for x in b.tolist()])))
        assert math.isclose(plain, found, abs_tol=1e-9)


def test_signatures_agree_as_often_as_the_similarity_says():
    a = [f"w{i}" for i in range(100)]
    b = a[:80] + [f"v{i}" for i in range(20)]
    rows_ = [" ".join(x).encode() for x in (a, b)]
    row, h, count = probminhash.shingles(rows_, words=1)
    sig = probminhash.signatures(row, h, probminhash.weights(count), 2, registers=2048)
    assert abs((sig[0] == sig[1]).mean() - 80 / 120) < 0.05


def test_near_duplicates_are_the_components_of_similar_texts(docs, rows):
    found = {(r.doc_id, r.class_id, r.kept) for r in probminhash.classes(docs).collect()}
    texts = sorted({(r[0] if r[0] is not None else -1, r[1] or "") for r in rows})
    first = {}
    for k, t in texts:
        own = _set(t)
        first[k, t] = next((first[x] for x in first if own and _set(x[1]) and len(own & _set(x[1])) / len(own | _set(x[1])) >= 0.8), k)
    plain = {(None if k < 0 else k, None if c < 0 else c) for (k, _), c in first.items()}
    assert {(a, b) for a, b, _ in found} == plain
    assert all(kept == (a == b) for a, b, kept in found)


def test_one_document_of_each_class_stays(docs, rows):
    kept = probminhash.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == sorted({(r[0] is None, r[0] or 0) for r in rows} - {(False, 1), (False, 2), (False, 12)})


def _classes_of_all_pairs(table, threshold=0.8):
    """Components of all pairs with a weighted J_P of the threshold or more, by the defining sum."""
    bags = []
    for _, t in table:
        w = t.lower().split()
        bags.append({x: 1 + math.log(n) for x, n in Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))).items()})
    root = list(range(len(table)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            both = a.keys() & b.keys()
            if len(both) < 0.3 * min(len(a), len(b)):
                continue
            x, y = (np.array([bag.get(d, 0.0) for d in a.keys() | b.keys()]) for bag in (a, b))
            jp = sum(1 / np.maximum(x / a[e], y / b[e]).sum() for e in both)
            if jp >= threshold:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {table[k][0]: table[top(k)][0] for k in range(len(table))}


def test_classes_are_those_of_all_weighted_pairs(spark):
    r = random.Random(17)
    table = []
    for base in range(25):
        words = [f"b{base}w{r.randrange(25)}" for _ in range(r.randint(30, 160))]  # shingles repeat, so weights differ
        words += words[: r.randint(0, 40)]
        for _ in range(r.randint(1, 7)):
            own = words[:]
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = f"x{r.randrange(9)}"
            table.append(own if r.random() < 0.8 else own[: -r.randint(1, 12)])
    table = [(k, " ".join(x)) for k, x in enumerate(table)]
    found = {x.doc_id: x.class_id for x in probminhash.classes(spark.createDataFrame(table, "doc_id long, text string").repartition(5)).collect()}
    plain = _classes_of_all_pairs(table)
    assert found == plain and 25 <= len(set(plain.values())) < len(table)


def test_a_chain_of_near_copies_is_one_class(spark):
    words = [f"w{i}" for i in range(200)]
    chain = []
    for k in range(30):  # each changes one more word: the ends are unlike, neighbours alike
        words = words[:]
        words[6 * k] = f"c{k}"
        chain.append((k, " ".join(words)))
    found = probminhash.classes(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert {r.class_id for r in found} == {0}


def _star(copies, seed=5):
    """An original and copies at about 0.85 of it, which are unlike each other."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(240)]
    out = [words]
    for k in range(copies):
        own = words[:]
        for e, at in enumerate(r.sample(range(10, 230, 5), 4)):
            own[at] = f"c{k}x{e}"
        out.append(own)
    return [(k, " ".join(x)) for k, x in enumerate(out)]


def test_a_star_of_more_copies_than_leaders_is_one_class(spark, monkeypatch):
    star = _star(1200)
    middle, one, two = (_set(star[k][1]) for k in (0, 1, 2))
    assert len(middle & one) / len(middle | one) >= 0.8 > len(one & two) / len(one | two)
    monkeypatch.setattr(probminhash, "BLOCK", 250)  # several tiles a bucket
    found = probminhash.classes(spark.createDataFrame(star, "doc_id long, text string")).collect()
    assert len(found) == len(star)
    assert {r.class_id for r in found} == {0}


def test_bounds_are_never_below_the_similarity():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        h = np.unique(r.integers(0, 60, 40).astype(np.uint32))
        sets.append((h, probminhash.weights(r.integers(1, 6, len(h)))))
    found = probminhash.bounds(sets[:15], sets[15:])
    exact = np.array([[probminhash.probability_jaccard(a, b) for b in sets[15:]] for a in sets[:15]])
    assert (found >= exact - 1e-5).all()
    even = [(h, np.ones(len(h))) for h, _ in sets]
    assert np.allclose(probminhash.bounds(even[:15], even[15:]), [[probminhash.probability_jaccard(a, b) for b in even[15:]] for a in even[:15]], atol=1e-5)


# 2 -- quality rules


def _base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_base_counts_are_exact(docs):
    found = quality_rules.judge(docs, quality_rules.learn_references(docs)).collect()
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _base(r.text)
        assert not (r.base_failed and r.kept)


def _plain_verdicts(table, limits):
    """Verdicts by the definition: shares of common words and classes, Jensen-Shannon distances, limits by length."""
    bare = lambda t: [w.lower().strip(b".,;:!?\"'()") for w in (t or "").encode().split()]
    words = {}
    for t, lang in table:
        if lang is not None and bare(t):
            words.setdefault(lang, Counter()).update(bare(t))
    common = sorted({w for c in words.values() for w, n in c.items() if w and n >= quality_rules.COMMON_SHARE * c.total()})

    def kind(c):
        for k, chars in enumerate(("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", ".,;:!?'\"()-", "#*$%&|<>")):
            if c in chars:
                return k
        return 9 if ord(c) > 127 else 8

    def shares(t):
        a, b = Counter(map(kind, t or "")), Counter(w if w in common else None for w in bare(t))
        return {k: n / a.total() for k, n in a.items()}, {k: n / b.total() for k, n in b.items()}

    def distance(p, q):
        mid = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in p.keys() | q.keys()}
        return math.sqrt(max(0, sum(x.get(k, 0) * math.log2(x[k] / m) for x in (p, q) for k, m in mid.items() if x.get(k)) / 2))

    refs = {}
    for lang in sorted(words):
        own = [shares(t) for t, x in table if x == lang and bare(t)]
        refs[lang] = [{k: sum(s[i].get(k, 0) for s in own) / len(own) for k in {k for s in own for k in s[i]}} for i in (0, 1)]
    out = []
    for t, _ in table:
        n, *_, failed = _base(t)
        good = True
        if n >= limits.min_words and refs:
            found = [[distance(x, y) for x, y in zip(shares(t), r)] for r in refs.values()]
            near, far = min(found, key=sum)
            good = near <= limits.class_floor + limits.class_noise / math.sqrt(n) and far <= limits.common_floor + limits.common_noise / math.sqrt(n)
        out.append((t, good and not failed))
    return out


def test_verdicts_are_those_of_the_definition(spark, docs):
    lists = {"en": "the of and to in is that it for was", "de": "der die und in den von zu das mit sich", "es": "de la que el en y los del se las"}
    made = [(_prose(k, 15 + 9 * k, (x.split() + [f"{x[:3]}{i}" for i in range(40)])), lang) for lang, x in lists.items() for k in range(12)]
    odd = [(" ".join(["$$##", "17,5", "XX", "|", "QQZZ"][random.Random(k).randrange(5)] + str(i) for i in range(60)), "en" if k else None) for k in range(3)]
    odd += [("ZAP POW BAM " + " ".join(f"W{i}" for i in range(50)), None), (_prose(5, 30, lists["de"].split()).upper(), None), (" ".join(f"café{i}" for i in range(25)), "xx"), ("", "yy"), (None, "yy")]
    table = made + odd
    df = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(table)], "doc_id long, text string, lang string").repartition(5)
    found = sorted(quality_rules.judge(df, quality_rules.learn_references(df)).collect(), key=lambda r: r.doc_id)
    plain = _plain_verdicts(table, quality_rules.Limits())
    assert [(r.text, r.kept) for r in found] == plain
    assert {k for _, k in plain} == {True, False}
    assert found[0].asDict().keys() >= {"kept", "class_jsd"} and list(found[0].asDict())[3:10] == ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_summaries_miss_no_frequent_word():
    r = random.Random(12)
    s = quality_rules.Summary(room=20)
    whole = Counter()
    for _ in range(60):
        part = Counter(r.choice(["the", "of", f"w{r.randrange(5000)}", f"w{r.randrange(5000)}", f"w{r.randrange(5000)}"]) for _ in range(400))
        whole.update(part)
        s.add(part)
    s.trim()
    assert len(s.counts) <= 20 and s.lost <= whole.total() / 21
    assert all(n - s.lost <= s.counts[w] <= n for w, n in whole.items())


def test_distance_is_bounded_and_symmetric():
    p, q = np.array([[0.5, 0.5, 0]]), np.array([[0, 0, 1.0]])
    assert quality_rules.js_distance(p, q)[0, 0] == pytest.approx(1)
    assert quality_rules.js_distance(p, p)[0, 0] == pytest.approx(0)


# 3 -- packing


def test_packing_is_whole_gapless_and_tight(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack(docs, path, capacity=64).collect()
    tok = Tokenizer.from_file(path)
    plain = []
    for r in rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        plain += [(r[0], k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], key=key) == sorted(plain, key=key)
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= math.ceil(sum(r.length for r in found) / 64) + 2


def _best_fit(sizes, capacity):
    """Sequences that best-fit decreasing uses, one piece at a time."""
    gaps, n = [], 0
    for x in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, x)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        n += gap == capacity
        bisect.insort(gaps, gap - x)
    return n


def _places(items, met, capacity=4096):
    whole = items.join(met, "id", "left").select("id", "length", F.coalesce("seq", "id").alias("seq"), F.coalesce("at", F.lit(0)).alias("at")).collect()
    assert len(whole) == items.count()
    by = {}
    for x in whole:
        by.setdefault(x.seq, []).append((x["at"], x.length))
    for own in by.values():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert at <= capacity
    return whole, by


@pytest.mark.parametrize("rows_a_range", [15, 400, 100_000])
def test_supersteps_over_any_ranges_lose_nothing(spark, rows_a_range, monkeypatch):
    r = random.Random(4)
    items = spark.createDataFrame([(k, r.choice([3, 5, 700, 1500, 2100, r.randint(1, 4095)])) for k in range(3000)], "id long, length long")
    tables = []
    write = packing.Scratch.write
    monkeypatch.setattr(packing.Scratch, "write", lambda self, df, name: tables.append(name) or write(self, df, name))
    met = packing.place(items, packing.Scratch(spark, "test"), range_rows=rows_a_range)
    assert len(tables) == 2 * packing.SUPERSTEPS + 2  # 1 or 200 ranges
    whole, by = _places(items, met)
    assert len(by) <= _best_fit([x.length for x in whole], 4096) * 1.01 + 1


@pytest.mark.parametrize("ranges", [1, 200])
def test_most_pieces_are_placed_by_sweeps(spark, ranges, monkeypatch):
    r = random.Random(5)
    sizes = [min(4095, int(r.lognormvariate(6, 1)) + 1) for _ in range(8_000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, length long")
    by_counts = []
    told = packing.match_by_rank
    monkeypatch.setattr(packing, "match_by_rank", lambda p, g, c: by_counts.append(sum(p.values())) or told(p, g, c))
    _, by = _places(items, packing.place(items, packing.Scratch(spark, "test"), range_rows=8_000 // ranges))
    assert len(by) <= math.ceil(sum(sizes) / 4096) + 1  # the lower bound and one
    assert by_counts[0] < len(sizes) / 2
    # as many pieces are left, wherever ranges are cut
    assert abs(by_counts[0] - (len(sizes) - _swept(sizes))) <= 40


def _swept(sizes, capacity=4096, supersteps=packing.SUPERSTEPS):
    """Pieces that open a sequence, and those that plain stacks place in all supersteps (ties of the last size that opens aside)."""
    need = sum(sizes) // capacity
    need -= need // 100
    order = sorted(sizes, reverse=True)
    opened = max(need, sum(2 * x > capacity for x in order))
    gaps, left = [capacity - x for x in order[:opened]], order[opened:]
    placed = opened
    for _ in range(supersteps):
        stack, new, rest = [], [], []
        for size, kind in sorted([(g, 1) for g in gaps if g] + [(x, 0) for x in left], reverse=True):
            if kind:
                stack.append(size)
            elif stack:
                new.append(stack.pop() - size)
                placed += 1
            else:
                rest.append(size)
        gaps, left = stack + new, rest
    return placed


def test_ranges_are_matched_as_brackets():
    r = random.Random(11)
    for _ in range(60):
        left = [(k, r.randint(0, 4), r.randint(0, 4)) for k in range(r.randint(1, 7))]
        pieces_, gaps_ = packing.match_ranges(left)
        pairs = {}
        for at, first, match, n in pieces_:
            pairs |= {match + i: [(at, first + i)] for i in range(n)}
        for at, first, match, n in gaps_:
            for i in range(n):
                pairs[match + i].append((at, first - i))
        stack, plain = [], []
        for at, wanting, gaps in left:
            for k in range(wanting):
                if stack:
                    plain.append([(at, k), stack.pop()])
            stack += [(at, k) for k in range(gaps)]
        assert sorted(pairs.values()) == sorted(plain)


def test_matching_by_rank_is_best_fit_decreasing():
    r = random.Random(8)
    for k in range(40):
        sizes = [min(255, int(r.lognormvariate(3, 1)) + 1) if k % 2 else r.choice([9, 30, 31, 70, r.randint(1, 255)]) for _ in range(r.randint(1, 800))]
        told, _, opened = packing.match_by_rank(dict(Counter(sizes)), {}, 256)
        assert sum(opened.values()) == _best_fit(sizes, 256)
        places = {}
        for s, first, n, per, seq, at in told:
            for i in range(n):
                places.setdefault(seq + i // per, []).append((at + i % per * s, s))
        assert sorted(s for own in places.values() for _, s in own) == sorted(sizes)
        for own in places.values():
            ends = np.cumsum([s for _, s in sorted(own)])
            assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 256


def test_words_have_the_ids_of_the_whole_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), packing.WordTokens(path)
    r = random.Random(3)
    alphabet = [*"aAsvlrtmedSTI' \n\t.,!?;:)]$%&09", "İ", "ı", "Σ", "ß", "é", "e\u0301", "\u0307", "ﬁ", "\u3000", "\xa0", "中", "\U0001f600", "²", "'s", "'ll", "Å", "\u212b", "<|endoftext|>", "<|"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    for t, x in zip(texts, own.encode(pa.array(texts)), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


# 4 -- language


def test_language_is_the_smallest_dictionary(spark):
    lists = {"en": "the of and to in is that it for was on".split(), "fr": "de la le et les des en un une du est que".split(), "de": "der die und in den von zu das mit sich".split(), "es": "de la que el en y los del se las por".split()}
    table = [(i, _prose(i, 60, lists[lang]), lang) for i, lang in enumerate(list(lists) * 40)] + [(900, None, "en"), (901, "1234 !!", "de"), (902, "", None), (903, "² ½ ① Ⅳ _", "de")]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
    fitted = langid.fit(docs, F.col("doc_id") % 5 != 0)
    assert list(fitted) == sorted(lists) and all(len(x) <= 2 * langid.MOST_BYTES for x in fitted.values())
    found = langid.identify(docs, fitted).collect()
    own = [r for r in found if r.doc_id < 900 and r.doc_id % 5 == 0]
    assert sum(r.lang == r.lang_pred for r in own) >= 0.95 * len(own)
    assert {r.lang_pred for r in found if r.doc_id >= 900} == {"und"}
    assert all(0 <= r.score <= 1 for r in found)


def test_dictionaries_are_whole_texts_and_texts_are_read_to_the_end(spark):
    long = _prose(1, 40_000)
    docs = spark.createDataFrame([(1, long, "en", 5), (2, _prose(2, 50), "de", 6), (3, "", "fr", 7), (4, None, "fr", 8)], "doc_id long, text string, lang string, score int")
    fitted = langid.fit(docs, F.lit(True))
    assert fitted["en"].decode() == long.lower() + "\n" and set(fitted) == {"de", "en"}  # no other text of its language
    tail = " ".join(f"zq{i}" for i in range(30_000))
    both = spark.createDataFrame([(1, long[:2000] + tail), (2, long[:2000])], "doc_id long, text string")
    a, b = (r.margin for r in langid.identify(both, fitted).orderBy("doc_id").collect())
    assert a < b  # what comes late counts
    assert [r.score for r in langid.identify(docs, fitted).filter("doc_id > 2").collect()] == [0, 0]  # replaces a column of its name


# 5 -- repeats


def _removed(rows_):
    seen, out = set(), []
    for k, t in sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows_}):
        data = t.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((None if k < 0 else k, len(data), sum(gone), sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return set(out)


def test_repeated_bytes_go_and_no_others(docs, rows):
    found = suffix_dedup.remove_repeats(docs, keep=["doc_id"]).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == _removed(rows)


def test_passages_shared_by_random_texts(spark):
    r = random.Random(9)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randint(90, 260))) for _ in range(6)]
    table = [(k, "".join(r.choice(["", "zq" * r.randint(0, 80), "a" * r.randint(0, 230)]) + r.choice(passages)[r.randint(0, 40) :] for _ in range(r.randint(0, 5)))) for k in range(80)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(table, "doc_id long, text string").repartition(7), keep=["doc_id"]).collect()
    assert {(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found} == _removed(table)


@pytest.mark.parametrize("in_bucket, splitters", [(40, 3), (4, 4096), (12, 1)])
def test_crowded_leading_tokens_are_split(spark, monkeypatch, in_bucket, splitters):
    """One phrase in most texts between unlike ones, a whole passage, copies; buckets far too small for them."""
    monkeypatch.setattr(suffix_dedup, "IN_BUCKET", in_bucket)
    monkeypatch.setattr(suffix_dedup, "SPLITTERS", splitters)
    r = random.Random(21)
    noise = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    phrase, passage = noise(88), noise(150)
    table = [(k, noise(r.randint(0, 150)) + phrase + noise(r.randint(0, 30)) + (passage if k % 3 else phrase) + noise(r.randint(0, 120))) for k in range(120)]
    table += [(200, table[3][1]), (201, table[4][1] + "x"), (202, ""), (203, None), (204, "q" * 700)]
    tables = []
    write = suffix_dedup.Scratch.write
    monkeypatch.setattr(suffix_dedup.Scratch, "write", lambda self, df, name: tables.append(name) or write(self, df, name))
    found = suffix_dedup.remove_repeats(spark.createDataFrame(table, "doc_id long, text string").repartition(6), keep=["doc_id"]).collect()
    assert {(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found} == _removed(table)
    assert "first" in tables  # there were crowds
    s = suffix_dedup.Suffixes([passage.encode() + b"0123456789"], 100, 32)
    _, place, h0, h1 = s.windows(np.arange(len(s.at)), 100)
    assert sorted(place.tolist()) == list(range(len(s.data) - 99))  # every window picked one suffix
    assert len(set(zip(h0.tolist(), h1.tolist()))) == len(place)


def test_cut_texts_keep_whole_characters(docs):
    cut = suffix_dedup.remove_repeats(docs, keep=docs.columns, cut_text=True)
    assert cut.columns[: len(docs.columns)] == docs.columns
    for r in cut.collect():
        assert r.text is None or len(r.text.encode()) <= r.n_bytes - r.n_removed


# 6 -- media


def test_pictures_come_back_and_shrink_by_area():
    r = np.random.default_rng(1)
    grey, colour = r.integers(0, 256, (13, 9), np.uint8), r.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()
    assert media.decode(b"P1\n# note\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 15 0 15").tolist() == [[0, 255]]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4 9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]
    fine = np.kron(grey, np.ones((9, 5)))  # every cell of the shrink is a mean of whole blocks
    assert np.allclose(media.shrink(fine, 13, 9), grey)
    assert media.shrink(grey, 1, 1)[0, 0] == pytest.approx(grey.mean())


def test_texts_are_stored_losslessly(docs, rows, spark):
    for r in media.media_digest(docs).collect():
        data = (r.text or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    odd = spark.createDataFrame([(None,), (b"",), (b"P5 9",), (b"BMxx",)], "media binary")
    assert [r.error is None for r in media.media_features(odd).orderBy("media").collect()] == [True, False, False, False]


# 7 -- quality classifier


def test_neighbours_tell_held_out_quality(spark):
    r = random.Random(2)
    table = [(k, _prose(k, 40) if k % 3 else " ".join(r.choice(["BUY!!", "NOW!!", "%%%", "$$$", "ZZ"]) for _ in range(40))) for k in range(300)]
    docs = spark.createDataFrame([*table, (1000, ""), (1001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(5, None), (7777, 1), (1, 1)], "doc_id long, quality int")
    model = knn_quality.fit(docs, labels, F.col("doc_id") % 4 != 2)
    found = {x.doc_id: x for x in knn_quality.score(docs, model).collect()}
    assert all(found[k].predicted == int(k % 3 > 0) for k in range(2, 300, 4))
    assert found[1000].score == found[1001].score == pytest.approx(model.labels.mean())


def test_terms_are_those_of_each_word():
    rows_ = [b"The the THE cat-42 aaa!!! $$$ Ab12cd\tx" + b"y" * 70_000 + " é\n\nüß ".encode(), b"", b" \n ", b"one"]
    found = knn_quality.counts(rows_)

    def shape(w):
        w = re.sub(rb"[0-9]+", b"0", re.sub(rb"(?:[a-z]|[\x80-\xff])+", b"\x01", re.sub(rb"[A-Z]+", b"\x02", w)))
        return re.sub(rb"([^\x01\x020])\1+", rb"\1\1", w)

    for data, row in zip(rows_, found):
        plain = Counter()
        own = data.lower().split()
        for w, x in zip(own, data.split()):
            plain[zlib.crc32(w) % knn_quality.WORD_TERMS] += 1
            plain[knn_quality.WORD_TERMS + zlib.crc32(shape(x)) % (knn_quality.SHAPE_TERMS - 1)] += 1
        plain[knn_quality.TERMS - 1] += sum(a == b for a, b in zip(own, own[1:]))
        assert {k: int(v) for k, v in enumerate(row) if v} == {k: v for k, v in plain.items() if v}


def test_ties_at_the_last_place_go_to_the_first():
    points = np.array([[1, 0], [0, 1], [1, 0], [1, 0], [0, 1]], np.float32)
    m = knn_quality.Model(None, None, points, np.array([1, 0, 0, 0, 1], np.float32))
    assert knn_quality.votes(m, np.array([[1, 0]], np.float32), 2)[0] == 0.5  # rows 0 and 2
    assert knn_quality.votes(m, np.array([[0, 1]], np.float32), 1)[0] == 0


def test_blocked_products_are_exact():
    r = np.random.default_rng(4)
    m = knn_quality.Model(None, None, knn_quality._unit(r.standard_normal((40, 6))), r.integers(0, 2, 40).astype(float))
    own = knn_quality._unit(r.standard_normal((9, 6)))
    for v, s in zip(own, knn_quality.votes(m, own, 5)):
        best = sorted(range(40), key=lambda i: -float(v @ m.points[i]))[:5]
        w = [max(float(v @ m.points[i]), 0) ** 4 for i in best]
        assert s == pytest.approx(sum(a * m.labels[i] for a, i in zip(w, best)) / sum(w))


# 8 -- language model


def test_counts_are_the_corpus_counts_and_scores_are_probabilities(docs):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    found = maxent_lm.score(docs.withColumn("held", held), "held").collect()
    low = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    tokens = [(r.doc_id, r.text, [*re.findall(r"[^\x20\x09-\x0D]+", low(r.text)), None]) for r in docs.collect()]
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    count = Counter(w for k, _, own in tokens if not out(k) for w in own)
    n, v = sum(count.values()), len(count)
    plain = sorted((k if k is not None else -1, out(k), len(own), sum(w in count for w in own), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), 6)) for k, _, own in tokens)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == plain
    assert all(r.score < 0 for r in found)


def _trained(texts):
    t = maxent_lm.tokens([x.encode() for x in texts])
    count = Counter(t.word.tolist())
    by_class, words = (np.bincount(t.classes[list(count)], w, minlength=maxent_lm.CLASSES) for w in (list(count.values()), None))
    ranked = sorted(count, key=lambda w: (t.classes[w], -count[w], int(t.hashes[w])))
    place = Counter()
    heads = []
    for w in ranked:
        place[t.classes[w]] += 1
        if place[t.classes[w]] < maxent_lm.SLOTS:
            heads.append((int(t.classes[w]), int(t.hashes[w]), count[w]))
    slots = maxent_lm.Slots.of(heads, by_class, words)
    weights, squares = (np.zeros((maxent_lm.WEIGHTS, maxent_lm.CLASSES), np.float32) for _ in range(2))
    of_class, of_slot = maxent_lm.features(t)
    kind = t.classes[t.word]
    before = maxent_lm.token_logs(weights, slots, t).mean()
    for _ in range(3):
        maxent_lm.train_part(weights, squares, of_class, kind)
        maxent_lm.train_part(weights, squares, of_slot, slots.find(t.hashes)[0][t.word], slots.closed, kind)
    return t, count, slots, weights, before


def test_sums_of_groups_are_plain_sums():
    r = np.random.default_rng(6)
    for n in (1, 50, 3_000):
        rows, key = r.normal(size=(n, 32)).astype(np.float32), np.sort(r.integers(0, max(1, n // 4), n) ** 2 // max(1, n // 8))
        order = r.permutation(n)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        assert np.allclose(maxent_lm._sums(rows, order, first), np.add.reduceat(rows[order], first, axis=0), atol=1e-4)


def test_logits_that_lie_far_apart_are_shifted_one_by_one():
    r = np.random.default_rng(7)
    found = r.integers(0, 40, (3, 500))
    for scale in (1, 60):
        weights = (scale * r.normal(size=(40, 32))).astype(np.float32)
        z = weights[found].astype(float).sum(0)
        plain = z[:, 5] - z.max(1) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))
        assert np.allclose(maxent_lm.log_share(weights, found, np.full(500, 5)), plain, atol=1e-3, rtol=1e-4)


def test_words_of_a_history_are_a_distribution_and_training_helps():
    words = [f"{a}{b}{c}" for a in "klmnp" for b in ("a", "er", "ing", "ot") for c in ("", "n", "s", "t", "um")]
    t, count, slots, weights, before = _trained([_prose(k, 300, WORDS + words) for k in range(20)])
    assert maxent_lm.token_logs(weights, slots, t).mean() > before + 0.02
    assert 0 < sum(n == 0 for n in slots.closed.ravel()) < slots.closed.size
    known = {int(t.hashes[w]): n for w, n in count.items()}
    vocabulary = {w: None for k in range(20) for w in _prose(k, 300, WORDS + words).split()}
    unseen = {}  # a word of every class that never occurred
    for a in "abcdefghijklmnopqrstuvwxyz":
        for b in "abcdefghijklmnopqrstuvwxyz":
            unseen.setdefault(1 + zlib.crc32((a + b).encode()) % (maxent_lm.CLASSES - 1), f"zzz{a}{b}")
    assert len(unseen) == maxent_lm.CLASSES - 1
    for history in ("", "the of", "unknown words", "der die"):
        total = 0.0
        for w in [*vocabulary, *unseen.values(), None]:
            u = maxent_lm.tokens([f"{history} {w or ''}".encode()])
            at = len(u.word) - 1 - (w is not None)
            total += 10 ** float(maxent_lm.token_logs(weights, slots, u)[at]) * (known.get(int(u.hashes[u.word[at]]), 0) + 1)
        assert abs(total + _unseen_end(weights, slots, history) - 1) < 1e-4


def _unseen_end(weights, slots, history):
    """The place for unseen words in the class of the end token, which has none."""
    u = maxent_lm.tokens([history.encode()])
    of_class, of_slot = maxent_lm.features(u)
    zero = np.zeros(1, np.int64)
    return float(np.exp(maxent_lm.log_share(weights, of_class[:, -1:], zero) + maxent_lm.log_share(weights, of_slot[:, -1:], zero, slots.closed[:1]))[0] / 10 ** slots.rest[0])


def _plain_words(rows):
    known = {b"\xff": 0}
    return known, [known.setdefault(w, len(known)) for x in rows for w in [*x.split(), b"\xff"]]


def test_words_are_numbered_classed_and_hashed_as_one_by_one():
    r = random.Random(8)
    alphabet = [bytes([k]) for k in range(128)] + ["é".encode(), "ß".encode(), "語".encode(), "🙂".encode()]
    words = [b"".join(r.choices(alphabet, k=r.choice((1, 2, 3, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200)))) for _ in range(400)]
    words += [b"a" * k for k in range(1, 70)] + [b"a" + b"\0" * k for k in range(9)] + [b"!", b"!?", b"a!", b"ab...", b"." * 64, b"." * 65, b"ab" + b"." * 90]
    rows = [b"", b" ", b"\x1c\x1f", *[b" ".join(r.choices(words, k=r.randrange(60))) for _ in range(60)], b"\t\n", b"\n ".join(words), b""]
    t = maxent_lm.tokens(rows)
    known, plain = _plain_words(rows)
    assert t.word.tolist() == plain and t.sizes.tolist() == [len(x.split()) + 1 for x in rows] and t.row.tolist() == [k for k, x in enumerate(rows) for _ in range(len(x.split()) + 1)]
    assert t.classes.tolist() == [0, *(1 + zlib.crc32(w.rstrip(b".,;:!?")[-2:]) % (maxent_lm.CLASSES - 1) for w in list(known)[1:])]
    hashes = dict(zip(known, t.hashes.tolist(), strict=True))
    assert len(set(hashes.values())) == len(known)
    again = maxent_lm.tokens(rows[::-1])
    assert dict(zip(_plain_words(rows[::-1])[0], again.hashes.tolist(), strict=True)) == hashes
    empty = maxent_lm.tokens([b""])
    assert empty.word.tolist() == [0] and [x.shape for x in maxent_lm.features(empty)] == [(5, 1), (3, 1)]


def test_hashes_of_words_spread_over_all_bits():
    h = maxent_lm.tokens([" ".join(f"w{k}" for k in range(20_000)).encode()]).hashes
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).mean(0)
    assert len(set(h.tolist())) == 20_001 and np.all(abs(ones - 0.5) < 0.02)
    assert np.bincount((h >> np.uint64(58)).astype(int), minlength=64).max() < 400


def _cost(run, times=5):
    def once():
        start = time.process_time()
        run()
        return time.process_time() - start

    return min(once() for _ in range(times))


def test_numbering_words_costs_less_than_a_dictionary_of_them():
    r = random.Random(9)
    words = [f"{r.randrange(10**8)}" for _ in range(40_000)]
    rows = [" ".join(r.choices(words, k=300)).encode() for _ in range(600)]
    maxent_lm.tokens(rows[:1])
    assert _cost(lambda: maxent_lm.tokens(rows)) < _cost(lambda: _plain_words(rows))


def test_steps_are_the_same_for_near_and_far_logits(monkeypatch):
    t, _, slots, weights, _ = _trained([_prose(k, 300) for k in range(10)])
    of_class, of_slot = maxent_lm.features(t)
    kind, slot = t.classes[t.word], slots.find(t.hashes)[0][t.word]

    def run():
        w, squares = weights.copy(), np.zeros_like(weights)
        maxent_lm.train_part(w, squares, of_class, kind)
        maxent_lm.train_part(w, squares, of_slot, slot, slots.closed, kind)
        return w, maxent_lm.token_logs(w, slots, t)

    near = run()
    monkeypatch.setattr(maxent_lm, "WIDE", 0)
    far = run()
    assert np.abs(near[0]).max() > 0.1
    assert np.allclose(near[0], far[0], atol=1e-4) and np.allclose(near[1], far[1], atol=1e-4)


def test_context_lifts_held_out_scores(spark):
    pairs = [("the", "cat"), ("der", "hund"), ("el", "gato"), ("le", "chat")]
    r = random.Random(7)
    table = [(k, " ".join(w for _ in range(60) for w in pairs[r.randrange(4)])) for k in range(200)]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumn("held", F.col("doc_id") % 7 == 2)
    held = [x for x in maxent_lm.score(docs, "held").collect() if x.held_out]
    assert np.mean([(x.score - x.base_score) / x.n_tokens for x in held]) > 0.05


# 9 -- byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_library_s_and_decode(docs, encoding):
    path, library = encoding
    for r in bpe.digest(docs, path).collect():
        ids = library.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    back = bpe.decode(bpe.encode(docs, path), path)
    for r in back.collect():
        assert bytes(r.decoded) == (r.text or "").encode()
        assert all(a <= b for a, b in zip(r.offsets, r.offsets[1:]))


def test_pieces_of_random_strings(encoding):
    path, library = encoding
    r = random.Random(5)
    alphabet = [*"aAsvlrtmed' \n\t.,!09", "  ", "'s", "'ll", "'re", "é", "\u3000", "\xa0", "中", "\U0001f600", "²", "\u0301", "\r\n"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(1500)]
    found, ends = bpe.pieces(texts)
    coded = bpe.vocabulary(path).encode(found)
    for k, t in enumerate(texts):
        assert [i for x in coded[ends[k] : ends[k + 1]] for i in x[0]] == library.encode_ordinary(t)


# 10 -- URL filters


URLS = [None, "", "no scheme/path", "http://", "HTTP://Sub.EXAMPLE.org/es/1", "http://example.org/en/12?x=/es/", "https://a.org", "https://a.org/", "x://b.com/de/login", "x://com/de/", "x://xcom/de/", "http://net.xxx/a", "http://h.net/login#top", "http://h.net/wp-admin/x", "http://h.net/robots.txt", "http://h.net/x/991234a.html", "http://h.net/a?sessionid=3", "http://h.net/é/setup.exe", "http://h.net?q", "http://h.net#f", "http://a@b.org:80/x"]


def test_verdicts_match_the_sql(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    found = {tuple(r) for r in url_filter.filter_urls(pages, keep=["page_id"]).select("page_id", "host", "path", "rule", "glob", "verdict").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    assert found == set(con.execute(url_filter.ORACLE).fetchall())


def test_a_query_lends_no_path_to_a_host(spark):
    urls = ["https://tracker.com?ref=example.org/es/x", "https://a.com?u=b.com/de/", "https://a.org?u=/", "https://a.example.org/es/x?u=b.com/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {tuple(r) for r in url_filter.filter_urls(pages, keep=["page_id"]).select("page_id", "host", "path", "rule", "glob", "verdict").collect()}
    assert {(r[0], r[3], r[5]) for r in found} == {(0, None, "allow"), (1, None, "allow"), (2, None, "allow"), (3, "example.org/es/", "block")}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    assert found == set(con.execute(url_filter.ORACLE).fetchall())


def test_globs_match_like_regular_expressions():
    r = random.Random(6)
    globs = ["".join(r.choice(["a", "b", "/", "*", "**", "?", "ab"]) for _ in range(r.randint(1, 9))) for _ in range(60)]
    texts = ["".join(r.choice("ab/") for _ in range(r.randint(0, 12))) for _ in range(300)]
    hit = url_filter.Automaton.of([g.encode() for g in globs]).match([t.encode() for t in texts])
    for j, g in enumerate(globs):
        form = re.compile("".join({"**": ".*", "*": "[^/]*", "?": "."}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", g)))
        assert hit[:, j].tolist() == [bool(form.fullmatch(t)) for t in texts], g


# all of them


def test_batches_are_bounded_by_bytes(spark):
    from terrazzo.llm.columns import BATCH_BYTES, annotate

    long = spark.range(60, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = annotate(long, lambda texts: [[texts.nbytes] * len(texts)], ["text"], T.StructType([T.StructField("held", T.LongType())]), []).collect()
    assert len(sizes) == 60 and max(r.held for r in sizes) <= BATCH_BYTES + (2 << 20)


@pytest.fixture(scope="module")
def clashing(spark):
    """Very long, empty and null texts under columns named like results."""
    long = _prose(4, 60_000) + "\n" + "word " * 20_000
    table = [(1, long, "en", 1, "a", 0.5, True), (2, "", "de", 2, "b", None, None), (3, None, None, 3, None, 0.1, False), (4, _prose(6, 60), "en", 4, "c", 0.2, True)]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, n_tokens int, lang_pred string, score double, held_out boolean")


def test_long_texts_and_clashing_names(clashing, spark, encoding):
    by = lambda df: {r.doc_id: r for r in df.collect()}
    rows_ = by(clashing)
    langs = by(langid.identify(clashing, langid.fit(clashing, F.lit(True))))
    assert langs[1].lang_pred == "en" and langs[2].lang_pred == langs[3].lang_pred == "und" and langs[1].n_tokens == 1
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int")
    scored = by(knn_quality.score(clashing, knn_quality.fit(clashing, labels, F.lit(True))))
    assert len(scored) == 4 and all(0 <= r.score <= 1 for r in scored.values())
    lm = by(maxent_lm.score(clashing, "held_out"))
    assert {k: r.n_tokens for k, r in lm.items()} == {k: len((r.text or "").split()) + 1 for k, r in rows_.items()}
    path, library = encoding
    assert {k: r.n_tokens for k, r in by(bpe.digest(clashing, path)).items()} == {k: len(library.encode_ordinary(r.text or "")) for k, r in rows_.items()}
    cut = by(suffix_dedup.remove_repeats(clashing.withColumnRenamed("score", "n_spans")))
    assert {(k, r.n_removed) for k, r in cut.items()} == {(x[0], x[2]) for x in _removed([(k, r.text) for k, r in rows_.items()])}
    assert {r.class_id for r in probminhash.classes(clashing).collect()} == {1, 2, 3, 4}
    assert by(quality_rules.judge(clashing, quality_rules.learn_references(clashing)))[1].base_failed
    path3 = public_tokenizers.path("word_bpe_49k.json")
    ids = Tokenizer.from_file(path3).encode(rows_[1].text, add_special_tokens=False).ids
    assert sum(r.length for r in packing.pack(clashing, path3).collect() if r.doc_id == 1) == len(ids) + 1
    stored = clashing.withColumnRenamed("score", "media_sha256").withColumnRenamed("n_tokens", "n_bytes").withColumnRenamed("lang_pred", "feature")
    for k, r in by(media.media_digest(stored)).items():
        payload = (rows_[k].text or "").encode()
        padded = payload + bytes(-len(payload) % 64 or (0 if payload else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert len(r.media_sha256) == 64 and r.feature != "a"
    pages = spark.createDataFrame([(1, "http://a.org/" + "x/" * 50_000, "h", "p", "r")], "page_id long, url string, host string, path string, rule string")
    assert [(r.host, r.rule, len(r.path)) for r in url_filter.filter_urls(pages).collect()] == [("a.org", "org/", 100_001)]


def test_empty_tables(empty, spark):
    path9, path3 = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        probminhash.classes(empty), probminhash.first_of_each(empty), quality_rules.judge(empty, quality_rules.learn_references(empty)), packing.pack(empty, path3),
        langid.identify(empty, langid.fit(empty, F.lit(True))), suffix_dedup.remove_repeats(empty), media.media_digest(empty), knn_quality.score(empty, knn_quality.fit(empty, labels, F.lit(True))),
        maxent_lm.score(empty.withColumn("held", F.lit(False)), "held"), bpe.digest(empty, path9), url_filter.filter_urls(empty.withColumnRenamed("text", "url")),
    ):
        assert df.count() == 0
