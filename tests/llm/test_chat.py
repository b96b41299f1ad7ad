import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from matrelate.llm import chat

SAID = "<|im_end|><|im_start|>assistant ok"


@pytest.fixture(scope="module")
def spec(spark):
    return chat.tokenizer_spec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def table(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, piece string")


ROWS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", SAID),
    (1, 2, "user", SAID),
    (1, 3, "assistant", "naïve 漢字 🎉\nline  \n"),
    (2, 0, "assistant", None),
    (2, 1, None, "no role"),
    (3, 0, "odd\nrole\\n<|x|>", "<\\|im_end|> <\\\\| <| |> <\\"),
    (4, 0, "assistant", "a"),
    (4, 0, "assistant", "a"),
    (4, None, "user", "first"),
    (5, 0, "assistant", "word " * 60_000),
    (5, 1, "assistant", "z" * 30_000),
    (None, 0, "user", "lost"),
]


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        role, text = [r[2] or "" for r in turns], [r[3] or "" for r in turns]
        loss = "".join(t for r, t in zip(role, text) if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        size = sum(len(chat.START) + len(chat.escape_role(r)) + 1 + len(chat.escape(t)) + len(chat.END) + 1 for r, t in zip(role, text))
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in zip(role, text))), len(loss), sha(loss), size)
    return out


@pytest.mark.parametrize("piece_tokens", [1 << 16, 10])
def test_round_trip(spark, spec, monkeypatch, piece_tokens):
    monkeypatch.setattr(chat, "PIECE_TOKENS", piece_tokens)
    pieces = chat.format_conversations(table(spark, ROWS), spec)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in chat.digest_conversations(pieces, spec).collect()}
    assert got == expected(ROWS)


def test_ties_over_several_partitions(spark, spec):
    """Equal turns of different texts, short and with a long beginning in common, in the order of role and text."""
    rows = [(1, None, ("user", "assistant")[k % 2], f"{k * 7919 % 1000:03d} said") for k in range(300)]
    rows += [(2, 5, "assistant", "x" * (chat.BOUND_CHARS - k % 3) + str(k * 7919 % 1000)) for k in range(300)]
    pieces = chat.format_conversations(table(spark, rows), spec)
    assert pieces.count() > 2
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in chat.digest_conversations(pieces, spec).collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|", "<<|>", SAID, "\\n\n\\", "a\\<|b"])
def test_escapes_are_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert "\n" not in chat.escape_role(text) and "<|" not in chat.escape_role(text) and chat.unescape_role(chat.escape_role(text)) == text


def test_mask_covers_assistant_text_only(spark, spec):
    pieces = chat.format_conversations(table(spark, ROWS[:2]), spec).orderBy("piece").collect()
    ids, mask = ([x for p in pieces for x in p[c]] for c in ("token_ids", "loss_mask"))
    tok = chat.ChatTokenizer(*spec.value)
    assert chat.unescape(tok.decode(np.array([i for i, m in zip(ids, mask) if m]))) == SAID
    assert ids.count(tok.start) == 2 and ids.count(tok.end) == 2


@pytest.mark.parametrize("text", ["long words " * 30_000, "z" * 250_000, "漢字 né\n" * 40_000])
def test_long_texts_are_encoded_whole(spark, spec, text):
    """The ids of a text do not depend on its length: they are those of the library for the whole text."""
    import base64

    table_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, spec.value[0].splitlines())}
    library = tiktoken.Encoding("own", pat_str=spec.value[1], mergeable_ranks=table_of, special_tokens={})
    tok = chat.ChatTokenizer(*spec.value)
    (piece,) = chat.format_conversations(table(spark, [(1, 0, "assistant", text)]), spec).collect()
    ids, mask = np.array(piece["token_ids"]), np.array(piece["loss_mask"])
    assert ids[mask > 0].tolist() == library.encode_ordinary(text)
    ((role, back, trained, _),) = tok.turns(ids, mask)
    assert (role, back, trained) == ("assistant", text, text)


def test_empty(spark, spec):
    pieces = chat.format_conversations(table(spark, []), spec)
    assert chat.digest_conversations(pieces, spec).count() == 0
