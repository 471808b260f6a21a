"""The fitted, written and sampled operators against brute force, round trips and held-out labels."""

import gzip
import hashlib
import io
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from terratile.llm import chat, language, pieces, quality_crf, queries, sampling, token_files, warc

SF = "/root/testdata/sf0.001"
WORDS, MODEL = (str(public_tokenizers.path(x)) for x in ("word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", " ", "\n", "a", "it's 12 o'clock, İstanbul <|endoftext|> ok?!", "  two  blanks ", "▁mark▁ \x00 \t\r\n", "日本語 テキスト", "é É ﬁ",
    "word, " * 5000, "x" * 3000, "same same", "same same",
]


def odd_docs(spark):
    rows = [(i, t, "en", "x", "y") for i, t in enumerate(ODD)] + [(None, "null id", None, None, None), (3, "again", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, label string, score string")


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 50_000, 2**32):
            v = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            v[rng.random(n) < 0.03] = 2**32 - 1
            assert (token_files.unpack(token_files.pack(v), n) == v).all()
    skewed = np.full(1280, 7, np.uint32)
    skewed[::100] = 2**31
    parts = token_files.pack(skewed)
    assert parts["width"].max() == 0 and len(parts["over"]) == 13


def test_reader_goes_to_single_blocks():
    rng = np.random.default_rng(2)
    values = [rng.integers(0, 50_000, n, dtype=np.uint64).astype(np.uint32) for n in (1000, 128, 3)]
    for v in values:
        v[rng.random(len(v)) < 0.1] = 2**31
    out, places = io.BytesIO(), []
    for v in values:
        places.append(out.tell())
        token_files.write_segment(out, np.arange(2), np.ones(2, bool), np.array([1, len(v) - 1]), v)
    for at, v in zip(places, values, strict=True):
        n = -(-len(v) // token_files.BLOCK)
        for a in range(n):
            for b in range(a + 1, n + 1):
                assert (token_files.read_blocks(out, at, a, b) == v[a * 128 : b * 128]).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    docs = odd_docs(spark)
    got = token_files.token_digests(docs, WORDS).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ids = {(r.doc_id, r.text): [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows}
    want = Counter((r.doc_id, len(x := ids[(r.doc_id, r.text)]), zlib.crc32(np.array(x, "<u4").tobytes())) for r in rows)
    assert Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == want
    in_order = sorted(got, key=lambda g: g.start)
    assert [g.doc_id for g in in_order] == [r.doc_id for r in rows]
    assert [g.start for g in in_order] == np.cumsum([0, *(g.n_tokens for g in in_order)])[:-1].tolist()
    assert token_files.token_digests(docs.limit(0), WORDS).count() == 0


def test_warc(spark):
    big, small = "é" * 600, "x" * 999
    rows = [(i, f"http://h/{i}\r\n%41", h) for i, h in enumerate([big, small, big, small, None, "", big, "y" * 300_000])]
    rows += [(None, None, big), (6, "again", big), (9, "u", "a" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = warc.shared_dir(spark, "warc")
    warc.write_warc(pages, folder)
    want = Counter()
    for page, url, html in rows:
        data = (html or "").encode()
        revisit = html == big and page != 6
        want[(page, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 6 if revisit else None, None if revisit else data)] += 1
    for split in (64, 1000, 1 << 23):
        got = Counter(
            (r.page_id, r.url, r.payload_bytes, r.payload_sha1, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
            for r in warc.read_warc(spark, folder, split).collect()
        )
        assert got == want
    assert warc.archived(pages.limit(0)).count() == 0


def read_all(data, step):
    return [r for a in range(0, len(data), step) for r in warc.read_range(lambda at, n: data[at : at + n], a, min(a + step, len(data)))]


def test_range_reader_owns_each_record_once():
    data = b"".join(warc.record(i, f"u{i}", bytes([31, 139, 8]) * i, "00" * 20, warc.record_id(i)) for i in range(30))
    for step in (1, 7, 100, len(data)):
        assert [r[1] for r in read_all(data, step)] == list(range(30))


def test_cut_archives_and_those_of_others():
    data = b"".join(warc.record(i, "u", b"x" * 500, "00" * 20, warc.record_id(i)) for i in range(3))
    with pytest.raises(EOFError, match="cut off"):
        read_all(data[:-20], 50)
    other = (
        b"WARC/1.0\r\nwarc-type: revisit\r\nWARC-Target-URI:  http://a/%41\r\nWARC-Refers-To: <urn:uuid:1>\r\nWARC-Payload-Digest: sha1:" + b"0a" * 20 + b"\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: warcinfo\r\ncontent-length: 5\r\n\r\na: b\n\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n",
    )
    rows = read_all(b"".join(gzip.compress(x) for x in other), 9)
    assert rows[0] == ("revisit", None, "http://a/%41", None, "0a" * 20, None, None)
    assert rows[1][0] == "warcinfo" and rows[1][6] == b"a: b\n" and rows[2][0] == "response" and rows[2][6] == b"hi"


def test_revisits_name_their_response():
    pages = [record for page, refers in ((6, None), (1, 6)) for record in [warc.record(page, "u", b"p", "00" * 20, warc.record_id(page), refers, refers and warc.record_id(refers))]]
    head = [gzip.decompress(p).decode() for p in pages]
    own = re.search("WARC-Record-ID: (.*)\r", head[0])[1]
    assert f"WARC-Refers-To: {own}\r" in head[1] and own.startswith("<urn:uuid:")


def text_of(points):
    return "".join(map(chr, points))


def brute_phrases(sample, text):
    n, at = 0, 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        at, n = max(end, at + 1), n + 1
    return n


@pytest.mark.parametrize("parse", [3, 50, 1024])
def test_cross_parsing(monkeypatch, parse):
    """Phrases of the whole text, also where one is longer than a block, in any script."""
    monkeypatch.setattr(language, "PARSE", parse)
    samples = {"a": ["the cat sat on the mat", "and the rat ran " * 20], "b": ["der hund und die katze", "日本語の文章です", "это текст"]}
    model = language.Model(samples)
    held = {k: " ".join(text_of(language.letters(t)) for t in v) + " " for k, v in samples.items()}
    texts = ["the hat", "das ist der hund", "", "zz", "mat cat und katze " * 100, "and the rat ran " * 19, "日本の文", "x" * 200, "это cat " * 9]
    clean = [language.letters(t) for t in texts]
    got = model.phrases(clean)
    for i, c in enumerate(clean):
        assert got[i].tolist() == [brute_phrases(held[k], text_of(c)) for k in ("a", "b")]
    names, scores = model.predict(["The cat!", "und die Katze", None, "12 !?", "½ ² ① ⅷ", "x", "文章"])
    assert names == ["a", "b", "und", "und", "und", names[5], "b"] and all(0 <= s <= 1 for s in scores)


def test_samples_are_the_first_ids_by_hash(spark):
    rows = [(i, "ab"[i % 3 == 0]) for i in range(3000)] + [(None, "a"), (5, None), (7, "a"), (7, "b")]
    table = spark.createDataFrame(rows, "doc_id long, label string")
    got = {(r.doc_id, r.label) for r in sampling.sample_ids(table, 40).collect()}
    kept = {}
    for i, label in rows:
        if i is not None and label is not None and zlib.crc32(str(i).encode()) % 5:
            kept[i] = min(label, kept.get(i, label))
    order = {r.doc_id: r.h % 2**64 for r in table.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    want = {(i, x) for x in "ab" for i in sorted((i for i in kept if kept[i] == x), key=order.get)[:40]}
    assert got == want


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language.languages(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out and r.lang]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    odd = language.languages(odd_docs(spark)).collect()
    assert len(odd) == len(ODD) + 2 and {r.lang_pred for r in odd} == {"en", "und"}
    assert language.languages(docs.limit(0)).count() == 0


def test_marginals_against_all_paths():
    rng = np.random.default_rng(3)
    counts = np.array([3, 1, 4])
    scores, moves = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    prob, pairs, weight = quality_crf.marginals(scores, moves, counts)
    for c, (at, n) in enumerate(zip([0, 3, 4], counts, strict=True)):
        total, each, move = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for path in range(2**n):
            s = [path >> i & 1 for i in range(n)]
            w = math.exp(sum(scores[at + i, s[i]] for i in range(n)) + sum(moves[s[i], s[i + 1]] for i in range(n - 1)))
            total += w
            for i in range(n):
                each[i, s[i]] += w
            for i in range(n - 1):
                move[s[i], s[i + 1]] += w
        assert np.allclose(prob[at : at + n], each / total) and np.allclose(pairs[c], move / total) and np.isclose(weight[c], math.log(total))


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_crf.quality_scores(docs, labels).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got.values())
    assert np.mean([g.predicted == q for g, q in held]) > 0.9
    assert np.mean([g.predicted for g, q in held if q == 1]) > 0.97
    odd = quality_crf.quality_scores(odd_docs(spark), labels)
    assert odd.count() == len(ODD) + 2
    kept = quality_crf.keep_predicted(odd_docs(spark), labels)
    assert kept.columns == odd_docs(spark).columns
    assert quality_crf.quality_scores(docs.limit(0), labels.limit(0)).count() == 0
    named, marks = (x.withColumn("doc_id", x.doc_id.cast("string")) for x in (docs.limit(50), labels))
    assert quality_crf.quality_scores(named, marks).count() == 50


def test_layouts():
    def turns(x):
        return chat.canonical(json.dumps(x))

    pair = [("user", "q"), ("assistant", "a")]
    assert turns({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}) == pair
    assert turns({"conversations": [{"from": "human", "value": "q"}, {"value": "a", "from": "gpt"}]}) == pair
    assert turns({"instruction": "q", "output": "a"}) == pair
    assert turns({"instruction": "q", "input": "i", "output": "a", "system": "s"}) == [("system", "s"), ("user", "q"), ("user", "i"), ("assistant", "a")]
    assert turns({"prompt": "q", "completion": "a"}) == turns({"prompt": "q", "response": "a"}) == turns({"question": "q", "answer": "a"}) == pair
    assert turns({"role": "user"}) == [("user", "")] and turns({"messages": []}) == [] and chat.canonical(None) == []
    assert turns({"role": "gpt", "text": 5}) == [("gpt", "5")] and turns({"text": "x"}) == [("", "x")]
    assert turns({"messages": [{"role": "user", "content": "q", "name": {"first": "x"}}], "id": 1}) == [("user", "q")]
    for bad in ({"other": 1}, [], 3, {"messages": [1]}, {"prompt": "a", "answer": "b"}):
        layout, reason, found = chat.read_record(json.dumps(bad))
        assert layout == "none" and reason and not found
    assert chat.read_record("{not json")[0] == "none" and chat.read_record('{"text": "\\ud800"}')[2] == [("", "?")]


def test_odd_records_do_not_end_the_job(spark):
    rows = [(1, 0, '{"prompt": "q", "completion": "a"}'), (1, 1, "oops"), (2, 0, "[1]"), (3, 0, None)]
    pieces_ = chat.format_records(spark.createDataFrame(rows, "conv_id long, turn long, record string"))
    assert Counter(r.layout for r in pieces_.collect()) == {"prompt": 2, "none": 2}
    assert {r.conv_id: r.n_turns for r in chat.digests(pieces_).collect()} == {1: 2, 2: 0}


@pytest.mark.parametrize("role", ["a\nb", "a\\nb", "<|im_end|>\n", "\\", "", "gpt"])
def test_roles_come_back(role):
    assert list(chat.parse(chat.piece(role, "t")[0] + chat.piece("assistant", "u")[0])) == [(role, "t"), ("assistant", "u")]


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|", "<\\\\|x|>", "<", "a<|b<\\|c\n<|im_start|>user\n", "<\\", "|>"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    whole, a, b = chat.piece("assistant", text)
    assert list(chat.parse(whole)) == [("assistant", text)] and chat.unescape(whole[a:b]) == text


def test_conversations(spark):
    got = {r.conv_id: r for r in queries.op8_chat(spark, SF).collect()}
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    convs[-1] = [(0, "user", t := "<|im_end|><|im_start|>assistant ok"), (1, "assistant", t)]
    assert set(got) == set(convs)
    for k, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[k].n_turns, got[k].turns_sha256) == (len(turns), want)
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[k].formatted_chars == sum(len(chat.piece(r, t)[0]) for _, r, t in turns)
    rows = [(None, 1, "user", None), (None, None, None, "x"), (5, 0, "assistant", "long " * 50_000)]
    odd = {r.conv_id: r for r in chat.formatted_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert odd[None].n_turns == 2 and odd[5].loss_chars == 250_000


def test_pieces_lossless_and_repeatable(spark):
    docs = odd_docs(spark)
    a = pieces.sampled_pieces(docs, MODEL).collect()
    b = pieces.sampled_pieces(docs.repartition(5), MODEL).collect()
    assert all(r.lossless and len(r.ids) == r.n_pieces for r in a)
    assert Counter((r.doc_id, r.ids_crc32, r.text) for r in a) == Counter((r.doc_id, r.ids_crc32, r.text) for r in b)
    assert Counter(r.text for r in a) == Counter(r.text or "" for r in docs.collect())
    assert pieces.sampled_pieces(docs.limit(0), MODEL).count() == 0


def test_sampling_follows_path_weights():
    lattice = pieces.Lattice(MODEL)
    n, unit = 20_000, "▁then"
    ids, sizes = lattice.sample(["then"] * n, np.arange(n).astype(np.uint64) * np.uint64(7919))
    seen = Counter(tuple(x) for x in np.split(ids, np.cumsum(sizes)[:-1]))

    def paths(at):
        if at == len(unit):
            return [((), 0.0)]
        return [((i, *p), w + lattice.weight[i]) for k in range(at + 1, len(unit) + 1) if (i := lattice.piece.get(unit[at:k])) for p, w in paths(k)]

    every = paths(0)
    total = sum(math.exp(w) for _, w in every)
    assert set(seen) <= {p for p, _ in every}
    for p, w in every:
        assert abs(seen[p] / n - math.exp(w) / total) < 0.02
