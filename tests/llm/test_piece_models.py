"""Models other than the file at hand, written as protobufs: unigram and BPE, with and without a character map."""

import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from perkline.llm.piece_codec import BPE, BYTE, CONTROL, MARK, NORMAL, UNIGRAM, UNKNOWN, PieceCodec, proto_fields, read_charsmap


def varint(n):
    return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])


def field(number, value):
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def charsmap(rule):
    """A public rule's character map, as the library ships it."""
    proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    return dict(proto_fields(dict(proto_fields(proto))[3]))[2]


def model(kind, fallback, rule, squeeze):
    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL)]
    if fallback:
        pieces += [(f"<0x{i:02X}>", 0.0, BYTE) for i in range(256)]
    words = [MARK, *"abcdefgh<>s/0x41kmÅé", "ab", "bc", "abc", MARK + "a", MARK + "ab", "de", "fg", "defg", MARK + "de", "km", "ha", "haha", MARK + "s", "bcd", "efgh"]
    pieces += [(w, -1.0 - 0.37 * i if kind == UNIGRAM else -float(i), NORMAL) for i, w in enumerate(words)]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in pieces)
    out += field(2, field(3, kind) + field(35, int(fallback)))
    return out + field(3, field(1, b"own") + (field(2, charsmap(rule)) if rule else b"") + field(3, 1) + field(4, int(squeeze)) + field(5, 1))


MODELS = [(k, f, r, q) for k in (UNIGRAM, BPE) for f in (True, False) for r, q in ((None, False), ("nmt_nfkc", True), ("nmt_nfkc_cf", True), ("nfkc", False))]
ODD = ["", " ", "  abc  de ", "<s>abc</s>", "<0x41>", "ＡＢＣ ｆｇ", "㎞ ㌔ ﬁ Å Å é", "a\tb\nc　d​e", "abcdefgh" * 30, "zzz漢字 abc q", "İ ẞ ſ", "가 각", "́a ｶﾞ", "ハ゛ ハ゜"]


@pytest.mark.parametrize(("kind", "fallback", "rule", "squeeze"), MODELS)
def test_parity_with_the_library(kind, fallback, rule, squeeze):
    data = model(kind, fallback, rule, squeeze)
    codec, judge = PieceCodec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert [x.tolist() for x in codec.encode(ODD)] == judge.encode(ODD)

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("abcdefgh  <>0x41km"), st.characters(blacklist_categories=("Cs",), blacklist_characters="▁\x00")), max_size=40))
    def same(text):
        ids = codec.encode([text])[0]
        assert ids.tolist() == judge.encode(text) and codec.decode(ids) == judge.decode(ids.tolist())

    same()


def test_character_map_of_the_library():
    table = read_charsmap(charsmap("nmt_nfkc"))
    assert table["ﬁ"] == "fi" and table["Ａ"] == "A" and table["㎞"] == "km" and table["\t"] == " " and table["ｶﾞ"] == "ガ" and len(table) > 4000
    assert read_charsmap(b"") == {} and np.array([len(k) for k in table]).max() > 1


def test_words_remembered_and_forgotten():
    """Texts of both kinds in one call, words of the generation before met again, and the turn of generations."""
    data = model(BPE, True, None, False)
    mine, theirs = PieceCodec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    mine.REMEMBERED = 40
    rng = np.random.default_rng(5)
    turns = 0
    for call in range(30):
        texts = [" ".join("".join(rng.choice(list("abcdefgh\n"), rng.integers(1, 3))) for _ in range(rng.integers(1, 9))) for _ in range(12)]
        texts += ["", " ", "abc", "abc ", " abc de", "abc  de", "a" + MARK + "b", texts[0], texts[0] + " " + texts[1]]
        before = mine.before
        for text, ids in zip(texts, mine.encode(texts), strict=True):
            assert ids.tolist() == theirs.encode(text), text
        turns += mine.before is not before
    assert turns > 1
    assert [x.tolist() for x in mine.encode([])] == []
    assert [x.tolist() for x in mine.encode(["", ""])] == [[], []]
