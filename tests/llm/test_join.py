"""The n-gram join on texts made to be near its bounds, and the queries that SQL can express."""

import random

import duckdb
import numpy as np
import pytest

from brindle.llm import ngram_join, queries


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_word_hashes_tell_words_apart():
    words = [thue_morse(n) for n in (64, 128, 1024, 2048, 4096)]
    words += [w.translate(str.maketrans("ab", "ba")) for w in words] + ["a" * n for n in range(1, 300)] + ["a" * n + "\x00" for n in range(1, 20)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    h, at = ngram_join.word_hashes(data, np.array([0, len(data)]))
    assert len(set(h.tolist())) == len(words) and at.tolist() == [0, len(words)]
    again, _ = ngram_join.word_hashes(np.frombuffer(" \n".join(words).upper().encode(), np.uint8), np.zeros(1, np.int64))
    assert again.tolist() == h.tolist()


def shingles(text, size):
    w = text.lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def test_similar_is_exact():
    rng = random.Random(2)
    texts = ["", " ", "a", "A b", "a b c", "a b a b a b", "a b c d e", "a b c d e f"] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    for a in texts:
        for b in texts:
            for size, percent in ((3, 90), (5, 80), (2, 30)):
                x, y = shingles(a, size), shingles(b, size)
                assert ngram_join.similar(a.encode(), b.encode(), size, percent) == bool(x and y and 100 * len(x & y) >= percent * len(x | y))


def components(texts, size, percent):
    own = [shingles(t, size) for t in texts]
    up = list(range(len(own)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(own):
        for j in range(i):
            if a and own[j] and 100 * len(a & own[j]) >= percent * len(a | own[j]):
                lo, hi = sorted((top(i), top(j)))
                up[hi] = lo
    return [top(i) for i in range(len(own))]


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_many_texts_near_the_threshold(spark, size, percent):
    """Edits of one text, so many that most pairs are just below the threshold, beside texts that share a long passage, and words of equal polynomial hashes."""
    rng = random.Random(size)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts = []
    for _ in range(150):
        w = list(base)
        for k in rng.sample(range(300), rng.choice([3, 6, 8, 9, 10, 11, 12] if size == 5 else [3, 4, 5, 6, 7])):
            w[k] = f"e{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join([*(f"u{rng.randint(0, 10**6)}" for _ in range(rng.choice([5, 12, 40, 200]))), passage]) for _ in range(100)]
    texts += [f"{thue_morse(1024)} x y z", f"{thue_morse(1024).translate(str.maketrans('ab', 'ba'))} x y z"]
    want = components(texts, size, percent)
    assert 10 < len(set(want[:150])) < 150
    got = ngram_join.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4), size, percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(want))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())
