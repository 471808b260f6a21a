"""Near copies of the pipeline's stage against all pairs worked out one by one."""

import random
from itertools import combinations

import corpus_pipeline
from terratile.llm import near_copies

SF = "/root/testdata/sf0.001"


def planted():
    """Originals, copies with some words replaced (similarity 0.7 to 1), and texts of few words."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    texts = []
    for n in [30, 60, 200, 200, 400, 400, 1500] * 6:
        words = [word() for _ in range(n)]
        texts.append(" ".join(words))
        for share in (0.005, 0.01, 0.015, 0.02, 0.03, 0.04):
            copy = list(words)
            for at in draw.sample(range(n), max(1, round(n * share))):
                copy[at] = word()
            texts.append(" ".join(copy))
    # a chain: neighbours are similar, its ends are not
    chain = [word() for _ in range(200)]
    texts += [" ".join(chain[8 * i : 8 * i + 130]) for i in range(8)]
    return texts + ["a b", "A  b", "a b c", "", None, " \n", *["same words here and there again"] * 3]


def kept_by_pairs(texts):
    sets = [near_copies.shingles(t) for t in texts]
    part = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or near_copies.jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((part[i], part[j]))
            part = [a if p == b else p for p in part]
    return {i for i, p in enumerate(part) if i == p}


def test_stage_keeps_one_of_each_group_of_similar_texts(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = kept_by_pairs(texts)
    got = [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.doc_id for r in near_copies.keep_first_similar(docs, group_bytes=3000).collect()} == want


def test_shingles_are_five_words_as_a_set():
    assert near_copies.shingles("A b c  d\ne f") == {b"a b c d e", b"b c d e f"}
    assert near_copies.shingles("x y") == {b"x y"} and near_copies.shingles(None) == set()


def test_columns_that_clash_stay(spark):
    rows = [(1, "a b", 5, 6, "d", None), (2, "A b", 7, 8, "e", 1), (None, None, 0, 0, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_no long, fp long, digest string, size long")
    assert set(map(tuple, near_copies.keep_first_similar(docs).collect())) == {rows[0], rows[2]}
