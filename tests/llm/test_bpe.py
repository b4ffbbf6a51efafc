import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.bpe import PATTERN, WIDEST, Encoder, encode_corpus, vocabulary
from corpusloom.llm.common import TOKENIZERS

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    v = vocabulary(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return Encoder(v), tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(v)}, special_tokens={})


def same(both, texts):
    enc, ref = both
    ids, n = enc.encode(texts)
    assert n.tolist() == enc.count_ids(texts).tolist()
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [ref.encode_ordinary(t) if t else [] for t in texts]


def test_known_texts(both):
    same(both, ["Hello world", None, "", " ", "\n\n", "<|endoftext|> x", "don't  stop\n now", " lead", "trail ", "a" * (WIDEST + 50), "ab" * 700, "ශ්‍රී ලංකා", "日本語 テキスト", "\x00\x1c a b", "tab\tx  y"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
def test_any_text(both, texts):
    same(both, [t.encode("utf-8", "ignore").decode() for t in texts])


def test_table_is_started_anew(both, monkeypatch):
    import corpusloom.llm.bpe as B

    monkeypatch.setattr(B, "KEPT", 3)
    for k in range(4):
        same(both, [f"word{k} other{k} third{k}", "again and again"])


def test_operator(spark, both):
    d = spark.createDataFrame([(1, "some text", "x"), (2, None, "x"), (3, "", "x"), (4, "some text", "x"), (4, "some text", "x"), (None, "y", "x")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in encode_corpus(d).collect()]
    want = both[1].encode_ordinary("some text")
    assert sorted(got, key=str) == sorted([(1, want), (2, []), (3, []), (4, want), (4, want), (None, both[1].encode_ordinary("y"))], key=str)
    assert encode_corpus(d.limit(0)).count() == 0
