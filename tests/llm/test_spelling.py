"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.llm import spelling

SMALL = "/root/testdata/sf0.001"


def edits(word, letters):
    for i in range(len(word) + 1):
        if i < len(word):
            yield word[:i] + word[i + 1 :]
        for a in letters:
            yield word[:i] + a + word[i:]
            if i < len(word):
                yield word[:i] + a + word[i + 1 :]


def brute(rows):
    count = Counter()
    for i, text in rows:
        for m in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            m = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m)
            h = zlib.crc32(f"{'' if i is None else i}:{m}".encode())
            if h % 97 == 0:
                m = m[: h % len(m)] + m[h % len(m) + 1 :]
            if len(m) >= 5:
                count[m] += 1
    count = {w: n for w, n in count.items() if n >= 3}
    letters = sorted({c for w in count for c in w})
    form, near = {}, {}
    for w, n in count.items():
        own = {e for e in edits(w, letters) if e in count and e != w}
        best = min(own, key=lambda v: (-count[v], v), default=None)
        near[w], form[w] = len(own), best if best and count[best] >= 2 * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, near[w], form[w], count[form[w]] if form[w] else None, root))
    return sorted(out, key=str)


def rows_of(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(2)
    words = ["naïve", "über", "ÉCOLE", "aaaaa", "aaaaaa", "aaaaab", "zzzzz", "ÿÿÿÿÿ", "abcde", "abcd", "×÷×÷×", "x" * 9000, "x" * 9001]
    rows += [(10**6 + k, " ".join(rng.choices(words, k=30))) for k in range(40)]
    return rows + [(None, "naïve naïve naïve école"), (None, None), (7, None), (8, ""), (9, "chain " * 3 + "chaine " * 6 + "chained " * 12), (9, "one")]


@pytest.mark.parametrize("chars", [1 << 20, 20000])
def test_variants(spark, monkeypatch, chars):
    monkeypatch.setattr(spelling, "SHARD_CHARS", chars)
    monkeypatch.setattr(spelling, "GROUP_BYTES", 1 << 20)
    monkeypatch.setattr(spelling, "STATES", 1000 if chars < 1 << 20 else 1 << 17)
    rows = rows_of(spark)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("odd") for c in ("word", "n", "form", "at", "root")})
    got = spelling.spelling_variants(df.repartition(4)).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_without_words(spark):
    df = spark.createDataFrame([(1, "a bb ccc"), (2, None), (None, "")], "doc_id bigint, text string")
    assert spelling.spelling_variants(df).collect() == [] == spelling.spelling_variants(df.limit(0)).collect()


def test_trie():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abzàÿé", k=rng.randint(1, 5))) for _ in range(400)})
    trie = spelling.Trie.build(words)
    place, near = spelling.neighbours(trie, words)
    got = {(words[a], words[b]) for a, b in zip(place.tolist(), near.tolist(), strict=True)}
    known = set(words)
    assert got == {(w, e) for w in words for e in edits(w, "abzàÿé") if e in known and e != w}
    assert len(place) == len(got)
