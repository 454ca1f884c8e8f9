import base64
import hashlib
import random

import public_tokenizers
import regex
import tiktoken

from glossaudit.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples():
    r = random.Random(3)
    return ["", " ", "\n\n  a", "a" * 3000, " " * 500 + "x", "日本語テスト 漢字", "👍🏽 émoji ñ ﷺ", "''''s 'll I'm", "<|endoftext|>",
            "\r\n\t" * 50, "-" * 400, "1234567890" * 50, "The quick brown fox isn't lazy, it's 2 fast.",
            "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(4000)),
            "".join(r.choice("abcdefghij klmnop") for _ in range(20000)),
            " ".join("".join(r.choice("thonerlyst") for _ in range(r.randint(1, 14))) for _ in range(3000))]


def test_transducer_gives_the_ids_of_the_merges():
    pieces, pattern, known = bpe.kept_pieces(PATH), regex.compile(public_tokenizers.PATTERN), library()
    for text in samples():
        got = [i for groups, _ in bpe.encode_text(text, pattern, pieces) for ids in groups for i in ids]
        assert got == known.encode_ordinary(text)


def test_pair_test_agrees_with_merging():
    transducer, r = bpe.kept_pieces(PATH).transducer, random.Random(9)
    for _ in range(20000):
        a, b = r.randrange(20000), r.randrange(20000)
        if transducer._follows(-1, a) and transducer._follows(-1, b):
            joined = transducer.bytes_of[a] + transducer.bytes_of[b]
            assert transducer._follows(a, b) == (bpe.merged(joined, transducer.ranks) == [a, b])


def test_few_remembered_steps_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "STEPS_MOST", 50)
    monkeypatch.setattr(bpe, "PIECES_MOST", 20)
    pieces, pattern = bpe.Pieces(bpe.Transducer(bpe.read_ranks(PATH))), regex.compile(public_tokenizers.PATTERN)
    for text in samples()[-4:]:
        got = [i for groups, _ in bpe.encode_text(text, pattern, pieces) for ids in groups for i in ids]
        assert got == library().encode_ordinary(text)


def test_blocks_cut_where_no_piece_is_cut(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 40)
    for text in samples():
        parts = list(bpe.blocks(text))
        assert "".join(parts) == text
        assert [p for part in parts for p in regex.findall(public_tokenizers.PATTERN, part)] == regex.findall(
            public_tokenizers.PATTERN, text)


def test_stream_decoder_holds_back_unfinished_characters():
    data = "aé日👍🏽z".encode()
    for size in (1, 2, 3, 5):
        stream, out = bpe.Utf8Stream(), ""
        for i in range(0, len(data), size):
            out += stream.feed(data[i:i + size])
        assert out + stream.close() == data.decode()
    broken = bpe.Utf8Stream()
    assert broken.feed(b"a\xff\xe6\x97") + broken.close() == "a��"


def test_round_trip_of_a_table(spark):
    rows = [(i, t) for i, t in enumerate(samples())] + [(99, None), (None, "no id"), (99, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS tokens", "2 AS n_tokens")
    got = sorted(bpe.bpe_round_trip(table).collect(), key=str)
    known = library()
    want = [(i, known.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    want = sorted(((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(data).hexdigest(), len(data.decode())) for i, ids, data in want), key=str)
    assert sorted(map(tuple, got), key=str) == want
    tokens = {r.doc_id: r.tokens for r in bpe.bpe_encode(table).collect()}
    assert tokens[12] == known.encode_ordinary(samples()[12]) and tokens[99] == []
    assert bpe.bpe_round_trip(table.limit(0)).count() == 0
