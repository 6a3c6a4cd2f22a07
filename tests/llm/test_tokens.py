import random

import pytest
import regex

from barloom.llm import tokens

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, text string, id int, ids int, start int, head int, tail int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 1, 1, 1, 1) for i, t in enumerate(texts)], SCHEMA)


def some_texts(seed, n=40):
    r = random.Random(seed)
    parts = ["the ", "court", "'s", "'re", "'", " ", "  ", "\n", "\n\n", "\t", "12", "é", "ü ", "…", "§ ", "日本", "\U0001f600", "x" * 30, " " * 40, "<|endoftext|>", " ", "​", "\x1c"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 120))) for _ in range(n)]


def test_ids_equal_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = [None, "", " ", "<|endoftext|> it's", *some_texts(1)]
    whole = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in tokens.encoded(frame(spark, texts), "doc_id", "text", PATH).collect()}
    assert got[0] == [] and got[1] == [] and len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == whole.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk, overlap", [(40, 30), (64, 20), (25, 12), (11, 10), (30, 9)])
def test_stitched_chunks_equal_the_whole(spark, chunk, overlap):
    texts = [*some_texts(chunk, 150), "a\n\n'b" * 60, "a" * 500, " " * 300 + "x", "a b" * 200, None, ""]
    got = {r.doc_id: r.ids for r in tokens.encoded(frame(spark, texts), "doc_id", "text", PATH, chunk, overlap).collect()}
    want = {r.doc_id: r.ids for r in tokens.encoded(frame(spark, texts), "doc_id", "text", PATH).collect()}
    assert got == want


def test_only_chunks_around_a_long_run_are_joined(spark, monkeypatch):
    monkeypatch.setattr(tokens, "written", lambda df, name: sizes.append(df.cache()) or sizes[-1])
    sizes = []
    texts = ["word and " * 60 + "=" * 130 + " more words" * 60, "x y " * 100 + "z"]
    got = {r.doc_id: r.ids for r in tokens.encoded(frame(spark, texts), "doc_id", "text", PATH, 50, 20).collect()}
    assert got == {i: tokens.encode(PATH, t) for i, t in enumerate(texts)}
    first, last = (sorted(r.size for r in df.where("id = 0").collect()) for df in (sizes[0], sizes[-1]))
    assert set(first) == {50} and len(sizes) > 1 and last[0] == 50 and max(last) <= 250 and len(last) > len(first) - 6
    assert sum(last) == sum(first)


@pytest.mark.parametrize("more", [0, 1, 2, 19, 20, 21, 29, 30])
def test_texts_a_little_longer_than_chunks(spark, more):
    texts = [("ab cd " * 40)[: 50 * k + more] for k in (1, 2, 3)]
    got = {r.doc_id: r.ids for r in tokens.encoded(frame(spark, texts), "doc_id", "text", PATH, 50, 20).collect()}
    assert got == {i: tokens.encode(PATH, t) for i, t in enumerate(texts)}


def test_repeated_rows_have_a_row_each(spark):
    long, other = "one two three " * 20, "four five " * 30
    rows = [(1, long), (1, long), (1, other), (None, long), (2, "x"), (2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(k), tokens.encode(PATH, t)) for k, t in rows)
    assert sorted((str(r.doc_id), r.ids) for r in tokens.encoded(df, "doc_id", "text", PATH, 60, 20).collect()) == want


def test_boundaries_fall_in(spark):
    text = "The court's ruling of 12 May, he said,   was\n\nfinal. " * 20
    true = {m.start() for m in regex.finditer(tokens.PATTERN, text)}
    for start in range(0, 200, 7):
        part = text[start : start + 150]
        head, tail = tokens.boundaries(part, start, 100, 50)
        settled = next(b for b in head if b in true)
        assert all(b in true for b in [*head, *tail] if b >= settled)


def test_round_trip_and_very_long_runs(spark):
    texts = [*some_texts(3, 10), " " * 1_200_000 + "x", "ab" * 100_000]
    coded = tokens.encoded(frame(spark, texts), "doc_id", "text", PATH)
    back = {r.doc_id: r.text for r in tokens.decoded(coded, "doc_id", "ids", PATH).collect()}
    assert back == dict(enumerate(texts))


def test_empty_table_and_parameters(spark):
    assert tokens.encoded(frame(spark, []), "doc_id", "text", PATH).count() == 0
    with pytest.raises(ValueError):
        tokens.encoded(frame(spark, []), "doc_id", "text", PATH, 100, 100)
    assert tokens.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), "doc_id", "ids", PATH).orderBy("doc_id").collect()[0].text is None
