import random

import public_tokenizers
import pytest
import sentencepiece
from conftest import frame, invented
from hypothesis import given, settings
from hypothesis import strategies as st

from matrelate.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
CODEC = pieces.PieceCodec(pieces.load_model(PATH))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def agrees(text):
    ids = LIBRARY.encode(text)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids)
    got, cuts = CODEC.run(["a b", text, ""])
    assert CODEC.decode_all(got, cuts) == ["a b", LIBRARY.decode(ids), ""]
    assert CODEC.joined(got, cuts).to_pylist()[1] == ",".join(map(str, ids))


@pytest.mark.parametrize("text", ["", " ", "  ", "a", "  a  b ", "\n", "\n\n a\n", "▁", "▁▁ ▁x", "<s></s><unk><0x0A>", "漢字かな🎉", "\x00\x01\x7f", "a" * 300, " " * 1000, "ab" * 500, "=" * 77, "\t\r\n\x0b"])
def test_cases(text):
    agrees(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        agrees(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "of", "tion", "er", "ss", "aa", "▁", "  ", " ", "\n", "é", "'s", "1", "00", "ing", "ed"]), max_size=40))
def test_merging_alphabet(parts):
    agrees("".join(parts))


def test_runs_of_spaces():
    for n in range(120):
        for before, after in (("", ""), ("a", "the"), ("\n", "\n"), ("é", "▁x")):
            agrees(before + " " * n + after)


def test_decoding_reads_the_ids():
    """Ids that no text would give decode to their surfaces."""
    ids = [CODEC.id_of["▁the"], CODEC.id_of["s"], CODEC.id_of["▁▁"], CODEC.byte[10], 1, CODEC.id_of["the"]]
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


def test_pieces_joined():
    r = random.Random(3)
    known = list(CODEC.id_of)
    for _ in range(3000):
        agrees("".join(r.choice(known) for _ in range(r.randint(1, 6))))


def test_documents(spark, corpus, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_SEGMENTS", 50)
    rows = {}
    out = pieces.encode_documents(frame(spark, corpus), PATH).collect()
    assert len(out) == len(corpus)
    for r in out:
        text = r["record"]["text"] or ""
        ids = LIBRARY.encode(text)
        assert r["ids"] == ",".join(map(str, ids)) and r["n_tokens"] == len(ids) and r["decoded"] == LIBRARY.decode(ids)
        rows[r["record"]["doc_id"]] = r["record"]["bucket"]
    assert set(rows.values()) == {7}
    assert pieces.encode_documents(frame(spark, []), PATH).count() == 0


def test_long_text():
    text = invented(8, 50_000)
    assert CODEC.encode(text) == LIBRARY.encode(text)
