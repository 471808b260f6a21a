"""Very long texts, other scripts, many files, chains of candidates, and clashing columns."""

import zlib
from collections import Counter

import numpy as np
import pytest

from terratile.llm import decontaminate, language, near_copies, pieces, quality_crf, quality_rules, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def lattice():
    import public_tokenizers

    return pieces.Lattice(str(public_tokenizers.path("piece_bpe_32k.model")), pieces.ALPHA, pieces.SEED)


def han(seed, n):
    return "".join(map(chr, np.random.default_rng(seed).integers(0x4E00, 0x6000, n)))


def test_a_long_text_is_cut_the_same_in_runs(lattice):
    text = "  The cat's naïve ▁plan\n" * 40 + han(1, 50) + " 日本語のテキスト\n\n" + "x" * 300 + " end\udc41".replace("\udc41", "")
    ids, sizes = lattice.sample([text], np.array([77], np.uint64))
    for most in (10, 100, 10**6):
        got, back = lattice.sample_long(text, 77, most)
        assert (got == ids).all() and back == text
    assert lattice.decode(ids, sizes) == [text]


def test_units_of_any_script_have_exact_chances(lattice):
    """Forward sums of the trie against sums over all paths."""
    for unit in ("▁日本", "▁añb", "日本語の", "▁" + "ab" * 30, "▁\U0001f600x"):
        back, node, what = lattice._edges_of(unit)
        assert (np.diff(node) >= 0).all() and set(node.tolist()) == set(range(1, len(unit) + 1))
        weight = [lattice.weight[p] if p >= 0 else lattice.weight[lattice.spelling[-1 - p]].sum() for p in what.tolist()]
        total = np.zeros(len(unit) + 1)
        for j in range(1, len(unit) + 1):
            total[j] = np.logaddexp.reduce([total[i] + w for i, n, w in zip(back, node, weight, strict=True) if n == j])
        lattice.learn([unit] if unit not in lattice.unit else [])
        first = lattice.first[lattice.unit[unit]]
        for j in range(1, len(unit) + 1):
            at = lattice.enter[first + j]
            run = 0.0
            for i, n, w in zip(back, node, weight, strict=True):
                if n == j:
                    run += np.exp(total[i] + w - total[j])
                    assert lattice.up_to[at] == 2.0 or abs(lattice.up_to[at] - run) < 1e-5
                    at += 1
            assert abs(run - 1) < 1e-9


def test_very_long_units_and_texts_are_lossless(spark):
    import public_tokenizers

    texts = [han(2, 30_000), "y" * 20_000, ("lorem ipsum " * 100 + "\n") * 1200, None, ""]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    rows = {r.doc_id: r for r in pieces.sampled_pieces(docs, str(public_tokenizers.path("piece_bpe_32k.model"))).collect()}
    assert all(rows[i].lossless and rows[i].text == (t or "") and rows[i].n_pieces == len(rows[i].ids) for i, t in enumerate(texts))
    assert rows[2].n_pieces > 100_000


def test_long_texts_have_the_same_repeats():
    rng = np.random.default_rng(4)
    for text in ("a b c d e f a b c d e x", " ".join(f"w{k}" for k in rng.integers(0, 9, 4000)), "one", "", "a b c d e " * 300, "é ü\t" * 50):
        words = text.encode().split()
        old, quality_rules.LONG = quality_rules.LONG, 64
        try:
            assert quality_rules.long_repeat_words(text.encode() or b" ") == (len(words), quality_rules.repeat_words(words))
            short = quality_rules.counts(text)
        finally:
            quality_rules.LONG = old
        assert short == quality_rules.counts(text)


def test_a_long_labelled_text_gives_a_bounded_automaton(spark):
    rng = np.random.default_rng(6)
    words = {k: ["".join(chr(97 + int(c)) for c in rng.integers(a, a + 10, 5)) for _ in range(60)] for k, a in (("aa", 0), ("bb", 12))}
    long_text = " ".join(words["aa"][int(k)] for k in rng.integers(0, 60, 900_000))  # about 5 MB
    rows = [(0, long_text, "aa", "", 0)] + [(i, " ".join(words[k][int(j)] for j in rng.integers(0, 60, 50)), k, "", 0) for i, k in enumerate(["aa", "bb"] * 20, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    arrays = language.automata(docs)
    assert all(a[3] <= language.DOCS * (language.MOST + 1) for a in arrays.values()) and max(a[3] for a in arrays.values()) < 40_000
    assert all(r.lang_pred == lang for r, (_, _, lang, *_) in zip(sorted(language.languages(docs).collect(), key=lambda r: r.doc_id), rows, strict=True))
    spread = language.share(np.arange(10**6, dtype=np.uint32))
    assert len(spread) == language.MOST and spread[0] == 0 and spread[-1] == 10**6 - 1
    low = "Ab, c\n9d " * 300
    old, language.PIECE = language.PIECE, 7
    try:
        cut = language.letters(low)
    finally:
        language.PIECE = old
    assert (cut == language.letters(low)).all()


def test_many_files_and_segments_hold_the_same_ids(spark, monkeypatch):
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, f"Document number {i} has words {'x' * (i % 7)} " * (i % 11), "", "", 0) for i in range(300)] + [(None, "no id", "", "", 0), (5, "again", "", "", 0), (6, None, "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    few = sorted(map(str, token_files.token_digests(docs, path).collect()))
    monkeypatch.setattr(token_files, "FILE_BYTES", 5000)
    monkeypatch.setattr(token_files, "SEGMENT", 500)
    monkeypatch.setattr(token_files, "SLICE", 1000)
    manifest = token_files.write_token_files(docs, path, token_files.shared_dir(spark, "tokens"))
    files = manifest.groupBy("part").count().collect()
    assert len(files) > 5 and max(r["count"] for r in files) > 1
    assert sorted(map(str, token_files.read_token_files(manifest).collect())) == few


def boilerplate_chain(n, words=60):
    """Texts that share half of their shingles with the one before, none more."""
    parts = [" ".join(f"p{k}w{j}" for j in range(words)) for k in range(n + 1)]
    return [f"{parts[k]} {parts[k + 1]}" for k in range(n)]


def test_candidates_that_are_no_copies_make_no_group(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "RADIUS", 64)
    texts = boilerplate_chain(60)
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts + [texts[7] + " end"])], DOCS)
    sent = []
    link = near_copies._links

    def links(rows, nodes, least, radius, group_bytes):
        banded = nodes.select("node", "fp", "size", "marks", near_copies.F.explode("bands").alias("band"))
        stars = near_copies._dealt(banded, "band", spark.createDataFrame([], "band long, chunks int"), "node").mapInPandas(near_copies._candidates(64, 0.3), "a long, b long")
        sent.append(stars.distinct().count())
        return link(rows, nodes, least, radius, group_bytes)

    monkeypatch.setattr(near_copies, "_links", links)
    kept = near_copies.keep_first_similar(docs, radius=64).count()
    assert kept == 60 and sent[0] <= 6  # the copy, and hardly any pair of neighbours, whose similarity is a third


PLAIN = """The river ran slowly past old mills and quiet farms before it reached our town.
Nobody remembers when people first built a bridge there, yet everyone crosses it daily.
Children fish below while carts, bicycles and small cars roll overhead until evening comes."""


def test_clashing_columns_stay_as_they_are(spark):
    rows = [(i, PLAIN if i % 3 else "### " * 30, "en", "s", 1, 0.5, "c", 7) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS + ", score double, kept string, n_words int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of this stands anywhere at all")], "item_id long, text string")
    for out in (quality_rules.keep_good(docs), quality_crf.keep_predicted(docs, labels), decontaminate.drop_contaminated(docs, bench), near_copies.keep_first_similar(docs)):
        assert out.columns == docs.columns
        assert {(r.score, r.kept, r.n_words) for r in out.collect()} == {(0.5, "c", 7)}
    assert quality_rules.keep_good(docs).count() == 40 and near_copies.keep_first_similar(docs).count() == 2


def test_token_crc_is_of_whole_documents(spark):
    import public_tokenizers
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    text = "Some words, and some more words.\n" * 50
    docs = spark.createDataFrame([(1, text, "", "", 0)], DOCS)
    got = token_files.token_digests(docs, str(public_tokenizers.path("word_bpe_49k.json"))).first()
    ids = tok.encode(text, add_special_tokens=False).ids + [1]
    assert (got.n_tokens, got.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and Counter(ids)[1] >= 1
