import random

import pytest
import sentencepiece

from palimpsest.llm import pieces


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.load())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


HARD = [None, "", " ", "  ", "a", " a", "a ", "Hello  world\n\ntab\tx  ", "\r\n", " " * 40 + "x" + " " * 33, "\U0001f600é梦\u0000", "aaaaaaaaaaaaaaaaaaaaaaaaa", "abababab" * 300, "<s></s><unk><0x0A>", "é"]


def test_ids_equal_the_library(codec, library):
    random.seed(4)
    letters = "abcdeinorst THEé\n .,-_0123梦ßüñ"
    texts = [t or "" for t in HARD] + ["".join(random.choices(letters, k=random.randint(1, 60))) for _ in range(3000)]
    assert codec.encode(texts) == library.encode(texts)
    for t in texts:
        assert codec.decode(library.encode(t)) == t


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pieces.report(docs).collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.lossless and r.n_tokens == len(r.ids)


def test_mark_and_unknown(codec):
    for t in ("▁a", "a▁▁ b", "x▁"):
        assert codec.decode(codec.encode([t])[0]) == t


def test_forgetting_changes_nothing(codec, monkeypatch):
    texts = ["the cat sat on the mat", "a cat", "dogs and cats"] * 3
    want = codec.encode(texts)
    monkeypatch.setattr(pieces, "REMEMBERED", 2)
    monkeypatch.setattr(pieces, "PAIRS", 2)
    assert [codec.encode([t])[0] for t in texts] == want


def test_unigram_is_plain_viterbi():
    vocab = [("a", -2.0, "piece"), ("b", -2.0, "piece"), ("ab", -3.0, "piece"), ("aba", -3.5, "piece"), ("▁", -1.0, "piece"), ("ba", -1.5, "piece")]
    codec = pieces.Codec([*vocab, *((f"<0x{i:02X}>", 0.0, "byte") for i in range(256))], merges=False)
    score = {p: s for p, s, _ in vocab}

    def best(t):
        return max(((s + best(t[len(p) :])[0], [p, *best(t[len(p) :])[1]]) for p, s in score.items() if t.startswith(p)), default=(0.0, [])) if t else (0.0, [])

    for t in ("ab", "aba", "abab", "babab", "bba"):
        assert [vocab[i][0] for i in codec.encode([t])[0]] == best("▁" + t)[1]


def test_frames(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(HARD)] + [(0, "again", 1), (0, "again", 1)], "doc_id long, text string, ids int")
    got = pieces.encode(docs)
    assert got.columns == ["doc_id", "text", "ids", "n_tokens", "lossless"] and got.where("not lossless").count() == 0
    back = pieces.decode(got.withColumnRenamed("text", "before"))
    assert back.where("text != coalesce(before, '')").count() == 0 and back.count() == len(HARD) + 2
    assert pieces.report(docs.limit(0)).collect() == []
    assert spark.createDataFrame([(None,)], "ids array<int>").transform(pieces.decode).collect()[0].text == ""


def test_one_edge_is_admissible(codec):
    """With the edges that merging allows, every prefix has one piece that may end it, so the greatest score is the only one."""
    random.seed(7)
    words = [" " + "".join(random.choices("abcdeinorsthé", k=random.randint(1, 14))) for _ in range(400)] + [" international", " the", "aaaaaaaa", " ababab"]
    for word in words:
        last = [-1]
        for end in range(1, len(word) + 1):
            edges = [t for begin in range(end) if (t := codec.ids.get(word[begin:end])) is not None and codec.follows(last[begin], t)]
            assert len(edges) <= 1, (word, end)
            last.append(edges[0] if edges else -1)
        path, end = [], len(word)
        while end:
            path.append(last[end])
            end -= len(codec.text[last[end]]) if last[end] >= 0 else 1
        if -1 not in path:
            assert pieces.np.frombuffer(codec.encode_words([word])[word], "int32").tolist() == path[::-1]
